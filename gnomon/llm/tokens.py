"""Tokenizer ids of whole texts by the tokenizers library, with a bounded memory of pieces.

A byte-pair tokenizer never merges across the pieces its pattern cuts a text into,
so a text's ids are those of its pieces. Pieces recur: each distinct one is encoded
once and remembered, up to a fixed number; then the memory is emptied.
"""

from __future__ import annotations

import os
import re

import numpy as np

from gnomon.llm.common import kept

REMEMBERED = 1_000_000  # pieces

# A run of Latin letters with at most one space before it that no other letter follows, or else all up
# to the next space or line end, or white space at the end. Pieces end only where every pattern of the
# vocabularies in use ends one, as long as a text has no other white space.
_PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7F])|[ \n]*[^ \n]++|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
# Bytes that such white space begins with in UTF-8: texts without any of them need no search.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """ids(texts) for the tokenizer file at ``path``; strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        new: list[str] = []

        class Known(dict):
            def __missing__(self, piece: str) -> int:
                new.append(piece)
                self[piece] = n = len(self)
                return n

        self.known, self.new = Known(), new
        self.size = np.zeros(1 << 16, np.int64)
        self.start = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self) -> None:
        """Encode the pieces seen for the first time."""
        if not self.new:
            return
        got = [e.ids for e in self.tokenizer.encode_batch_fast(self.new, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        total, a, b = int(size.sum()), len(self.known) - len(got), len(self.known)
        while b > len(self.size):
            self.size, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[a:b] = size
        self.start[a:b] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + total] = [i for x in got for i in x]
        self.used += total
        self.new.clear()

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the texts, one after the other; how many each text has). A null text has none."""
        if len(self.known) > self.remembered:
            self._forget()
        at: list[int] = []
        n = np.zeros(len(texts), np.int64)
        whole: dict[int, list[int]] = {}
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        found = np.flatnonzero(_MAYBE_SPACE[np.frombuffer(b"".join(raw), np.uint8)])
        maybe = set(np.searchsorted(np.cumsum([len(x) for x in raw]), found, "right").tolist())
        for k, t in enumerate(texts):
            if not t:
                continue
            if k in maybe and _OTHER_SPACE.search(t):
                whole[k] = self.tokenizer.encode(t, add_special_tokens=False).ids
                continue
            before = len(at)
            at.extend(map(self.known.__getitem__, _PIECE.findall(t)))
            n[k] = len(at) - before
        self._learn()
        place = np.array(at, np.int64)
        size = self.size[place]
        edge = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.repeat(self.start[place] - edge[:-1], size) + np.arange(edge[-1])]
        piece = np.concatenate([[0], np.cumsum(n)])
        count = edge[piece[1:]] - edge[piece[:-1]]
        if whole:
            cut = np.concatenate([[0], np.cumsum(count)])
            parts = [np.array(whole[k], np.uint32) if k in whole else out[cut[k] : cut[k + 1]] for k in range(len(texts))]
            for k, x in whole.items():
                count[k] = len(x)
            out = np.concatenate(parts)
        return out, count


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; a worker keeps it, with what it remembers, until a task of another kind begins."""
    return kept(path, lambda: Encoder(path))


def text_runs(texts: list[str | None], limit: int = 1_000_000):
    """Runs [a, b) of texts of about ``limit`` characters, or of one longer text."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b] or "") <= limit):
            held += len(texts[b] or "")
            b += 1
        yield a, b
        a = b
