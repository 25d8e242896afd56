"""Personal data: patterns, and a semi-Markov conditional random field for what they miss.

The patterns give the base spans. The field looks at what is left around every digit, ``@`` and
written-out "at" or "dot": each run of up to REACH tokens there is a candidate with features of the whole
span (digits and their groups, check digit, octets, separators, what touches it). Dynamic
programming over segments of bounded length chooses boundaries and kinds together. Weights are
learned by likelihood from a bounded sample of stretches of the corpus: the base spans in them, the same
spans written in ways that the patterns don't know, and decoys made of them.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gnomon.llm.common import documents, release, table

KINDS = ("email", "ip", "card", "phone")
REACH = 24  # tokens of a span that the field adds, at most
AROUND = 100  # code points on either side of a seed in which such a span lies, on to the next white space
FURTHER = 256  # code points to that white space, at most
SAMPLE = 240  # stretches of the corpus that weights are learned from, at most
STRETCH = 60  # code points of a stretch on either side of a seed
TURNS = 80  # of learning

# Fixed patterns; runs that cannot end otherwise are possessive, so that time is linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SEED = re.compile(r"[0-9]+|@|[\[({]\x20?(?i:at|dot)\x20?[\])}]")
_PERSONAL = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(text: str) -> bool:
    text = text.lstrip("0")
    return len(text) < 4 and int(text or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Of each @, the run to its left and the domain to its right: what the pattern finds, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed: leftmost, not overlapping within a kind, in code points."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _PERSONAL.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def regions(text: str, around: int = AROUND, further: int = FURTHER) -> Iterator[tuple[int, int]]:
    """Stretches around seeds, joined where they meet, from white space to white space where it is near."""
    start = end = -1

    def wide(a: int, b: int) -> tuple[int, int]:
        a, b = max(0, a - around), min(len(text), b + around)
        low, high = max(0, a - further), min(len(text), b + further)
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < high and not text[b].isspace():
            b += 1
        return a, b

    for m in _SEED.finditer(text):
        if start >= 0 and m.start() - around - further <= end + around + further:
            end = m.end()
            continue
        if start >= 0:
            yield wide(start, end)
        start, end = m.span()
    if start >= 0:
        yield wide(start, end)


# Classes of tokens.
_DIGITS, _LETTERS, _AT, _DOT, _HYPHEN, _PLUS, _OPEN, _CLOSE, _LOWLINE, _OTHER = range(10)
_CLASS = {"@": _AT, ".": _DOT, "-": _HYPHEN, "+": _PLUS, "(": _OPEN, "[": _OPEN, "{": _OPEN, ")": _CLOSE, "]": _CLOSE, "}": _CLOSE, "_": _LOWLINE, "%": _LOWLINE}
_AT_WORD, _DOT_WORD = 10, 11  # "at" and "dot" written out

# What is told of a whole span.
_FEATURES = [
    "any",
    *(f"digits {x}" for x in ("0", "1-3", "4-6", "7-9", "10-11", "12-13", "14-19", "20-")),
    *(f"letter runs {x}" for x in ("0", "1-2", "3-")),
    *(f"tokens {x}" for x in ("1", "2-3", "4-6", "7-9", "10-")),
    *(f"digit groups {x}" for x in ("0", "1", "2", "3", "4", "5-")),
    *(f"spaces {x}" for x in ("0", "1-3", "4-")),
    "one at", "more ats", "dot after at", "two dots after at", "letters end it after at", "letters follow at", "starts at at",
    "check digit right", "check digit wrong", "four octets", "four groups beyond octets", "three dots or dot words", "hyphens", "brackets", "starts with plus", "low line or percent",
    "groups of three, three and four", "groups of four", "leading zero pair", "starts with digit", "starts with letter", "starts with bracket", "ends with digit", "ends with letter", "ends with bracket",
    "touched before", "touched after", "mark before", "mark after that goes on", "word before", "word after",
]


class Tokens:
    """Tokens of a stretch: places, classes and running counts from which any span's features are differences."""

    def __init__(self, text: str, covered: list[tuple[int, int]] = ()):
        found = np.fromiter((x for m in _TOKEN.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
        self.n = n = len(found)
        self.start, self.end = found[:, 0].copy(), found[:, 1].copy()
        kind = np.empty(n, np.int64)
        value = np.full(n, 1 << 20, np.int64)  # of digit groups of at most three
        odd, even, digits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        zeros = np.zeros(n, bool)
        for k, (a, b) in enumerate(zip(self.start.tolist(), self.end.tolist(), strict=True)):
            c = text[a]
            if "0" <= c <= "9":
                kind[k], digits[k] = _DIGITS, b - a
                zeros[k] = b - a > 1 and c == "0" and text[a + 1] == "0"
                if b - a <= 3:
                    value[k] = int(text[a:b])
                if b - a <= 19:  # sums of digits by their place from the group's end
                    for j, d in enumerate(reversed(text[a:b])):
                        v = ord(d) - 48
                        w = 2 * v - 9 * (v > 4)
                        even[k] += v if j % 2 == 0 else w
                        odd[k] += w if j % 2 == 0 else v
            elif c.isalpha():
                word = text[a:b].lower() if b - a <= 3 else ""
                kind[k] = _AT_WORD if word == "at" else _DOT_WORD if word == "dot" else _LETTERS
            else:
                kind[k] = _CLASS.get(c, _OTHER)
        for k in np.flatnonzero(np.isin(kind, (_AT_WORD, _DOT_WORD))).tolist():  # only in brackets: else they are words
            if not (0 < k < n - 1 and kind[k - 1] == _OPEN and kind[k + 1] == _CLOSE):
                kind[k] = _LETTERS
        self.kind, self.value, self.digits, self.odd, self.even, self.zeros = kind, value, digits, odd, even, zeros
        gap = np.zeros(n + 1, np.int64)  # before each token; none counts as far at either end
        gap[1:n] = self.start[1:] - self.end[:-1] if n else 0
        gap[0] = gap[n] = 9
        self.gap = gap
        spaced = gap.copy()
        for k in np.flatnonzero(gap[1:n] == 1) + 1 if n else []:
            if text[self.end[k - 1]] != " ":
                spaced[k] = 9
        letters, bound = np.append(kind == _LETTERS, False), np.append(np.isin(kind, (_AT, _OPEN, _CLOSE)), False)
        self.far = spaced > 1  # no span goes on there, nor over a space beside a word, but for one to an at or a bracket
        if n:
            self.far[1:n] |= (gap[1:n] == 1) & ((letters[: n - 1] & ~bound[1:n]) | (letters[1:n] & ~bound[: n - 1]))
        self.covered = np.zeros(n, bool)
        for a, b in covered:
            self.covered[np.searchsorted(self.end, a, "right") : np.searchsorted(self.start, b, "left")] = True

    def candidates(self, low: int, high: int, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
        """(first token, token after the last) of the spans that start in [low, high): seeds, marks of the four kinds, and words only beside an at."""
        i = np.repeat(np.arange(low, high), reach)
        j = i + np.tile(np.arange(1, reach + 1), high - low)
        ok = j <= self.n
        i, j = i[ok], j[ok]
        far, cover = _running(self.far[: self.n]), _running(self.covered)
        seeds = _running((self.kind == _DIGITS) | (self.kind == _AT) | (self.kind == _AT_WORD) | (self.kind == _DOT_WORD))
        first, last = self.kind[i], self.kind[j - 1]
        starts, ends = np.zeros(12, bool), np.zeros(12, bool)
        starts[[_DIGITS, _LETTERS, _PLUS, _OPEN]] = ends[[_DIGITS, _LETTERS]] = True
        other, words, ats = _running(self.kind == _OTHER), _running(self.kind == _LETTERS), _running((self.kind == _AT) | (self.kind == _AT_WORD))
        ok = (far[j] - far[i + 1] == 0) & (cover[j] == cover[i]) & (seeds[j] > seeds[i]) & starts[first] & ends[last] & (other[j] == other[i]) & ((words[j] == words[i]) | (ats[j] > ats[i]))
        return i[ok], j[ok]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A row of _FEATURES for each span [i, j)."""
        n, kind = self.n, self.kind

        def within(flags: np.ndarray) -> np.ndarray:
            total = _running(flags)
            return total[j] - total[i]

        def steps(x: np.ndarray, *edges: int) -> list[np.ndarray]:
            k = np.searchsorted(edges, x, "right")
            return [k == e for e in range(len(edges) + 1)]

        isdigits = kind == _DIGITS
        digits, groups = within(self.digits), within(isdigits)
        at, dot = np.isin(kind, (_AT, _AT_WORD)), np.isin(kind, (_DOT, _DOT_WORD))
        ats, dots = within(at), within(dot)
        # the last place of an at before each span's end, and dots beyond it
        place = np.maximum.accumulate(np.concatenate([[-1], np.where(at, np.arange(n), -1)]))[j]
        has = place >= i
        total = _running(dot)
        beyond = np.where(has, total[j] - total[np.maximum(place, 0)], 0)
        follows = np.minimum(np.maximum(place, 0) + 1 + (kind[np.maximum(place, 0)] == _AT_WORD), n - 1)
        last, first = kind[j - 1], kind[i]
        # check digits: a group's digits double by how many digits of the span stand behind it
        behind = _running(self.digits)
        odd_before = behind[1:] % 2  # digits up to each group's end, by parity
        same, other = np.where(odd_before == 0, self.even, self.odd), np.where(odd_before == 0, self.odd, self.even)
        total_same, total_other = within(same), within(other)
        sums = np.where(behind[j] % 2 == 0, total_same, total_other)
        right = (digits >= 14) & (digits <= 19) & (sums % 10 == 0)
        octets, small = within(isdigits & (self.value <= 255)), groups == 4
        # lengths of the last three digit groups
        index = np.flatnonzero(isdigits)
        rank = _running(isdigits)
        length = np.concatenate([self.digits[index], [0]])
        tail = [np.where(groups > k, length[np.clip(rank[j] - 1 - k, 0, len(index))], 0) for k in range(3)]
        fours = within(isdigits & (self.digits == 4))
        spaces = _running(np.append(self.gap[1:n] == 1, False)) if n else np.zeros(1, np.int64)
        spaced = spaces[j - 1] - spaces[i]
        before, after = np.where(i > 0, kind[i - 1], _OTHER), np.where(j < n, kind[np.minimum(j, n - 1)], _OTHER)
        joined, onward = self.gap[i] == 0, self.gap[j] == 0
        wordlike = np.zeros(12, bool)
        wordlike[[_DIGITS, _LETTERS, _AT_WORD, _DOT_WORD, _LOWLINE]] = True
        goes = onward & ~wordlike[after] & (self.gap[np.minimum(j + 1, n)] == 0) & (j + 1 < n) & wordlike[np.where(j + 1 < n, kind[np.minimum(j + 1, n - 1)], _OTHER)]
        columns = [
            np.ones(len(i), bool),
            *steps(digits, 1, 4, 7, 10, 12, 14, 20),
            *steps(within(kind == _LETTERS), 1, 3),
            *steps(j - i, 2, 4, 7, 10),
            *steps(groups, 1, 2, 3, 4, 5),
            *steps(spaced, 1, 4),
            ats == 1, ats > 1, has & (beyond >= 1), has & (beyond >= 2), has & (last == _LETTERS) & (beyond >= 1), has & np.isin(kind[follows], (_LETTERS, _DIGITS)), has & (place == i),
            right, (digits >= 13) & ~right, small & (octets == 4) & (ats == 0), small & (octets < 4), dots == 3, within(kind == _HYPHEN) > 0, within(np.isin(kind, (_OPEN, _CLOSE))) > 0, first == _PLUS, within(kind == _LOWLINE) > 0,
            (tail[0] == 4) & (tail[1] == 3) & (tail[2] == 3), (groups > 1) & (fours == groups), self.zeros[i], first == _DIGITS, first == _LETTERS, first == _OPEN, last == _DIGITS, last == _LETTERS, last == _CLOSE,
            joined & wordlike[before], onward & wordlike[after], joined & ~wordlike[before], goes, ~joined & (before == _LETTERS), ~onward & (after == _LETTERS),
        ]
        return np.stack(columns, 1).astype(np.float32)


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


class Field:
    """Weights of whole-span features by kind, and of a kind next to a kind."""

    def __init__(self, weights: np.ndarray | None = None, follow: np.ndarray | None = None):
        self.weights = np.zeros((len(_FEATURES), len(KINDS))) if weights is None else weights
        self.follow = np.zeros((len(KINDS), len(KINDS))) if follow is None else follow

    def fit(self, examples: list[tuple[str, list[tuple[int, str, int]]]], turns: int = TURNS, rate: float = 0.25, ridge: float = 0.02) -> Field:
        """Raise the likelihood of the marked segmentations: gold counts less expected counts, by forward and backward sums."""
        at, rows, gold = [], [], []
        for text, spans in examples:
            t = Tokens(text)
            i, j = t.candidates(0, t.n)
            where = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(t.start[i], t.end[j - 1], strict=True))}
            if not len(i) or any((a, b) not in where for a, _, b in spans):  # longer than REACH, or it ends in a mark
                continue
            at.append(np.stack([np.full(len(i), len(at)), i, j], 1))
            rows.append(t.features(i, j))
            gold.append(np.full(len(i), -1))
            for a, kind, b in spans:
                gold[-1][where[a, b]] = KINDS.index(kind)
        at, x, y = np.concatenate(at), np.concatenate(rows), np.concatenate(gold)
        told = x[y >= 0].T @ np.eye(len(KINDS))[y[y >= 0]]
        order = np.flatnonzero(y >= 0)
        order = order[np.lexsort((at[order, 1], at[order, 0]))]
        met = np.zeros_like(self.follow)
        for p, q in zip(order[:-1], order[1:], strict=True):
            if at[p, 0] == at[q, 0] and at[p, 2] == at[q, 1]:
                met[y[p], y[q]] += 1
        n, step = len(rows), [np.zeros_like(self.weights), np.zeros_like(self.follow)]
        seen = [np.zeros_like(self.weights), np.zeros_like(self.follow)]
        by_start, by_end = (_grouped(at, side, int(at[:, 2].max()) + 1) for side in (1, 2))
        for turn in range(1, turns + 1):
            expected, pairs = self._expected(at, x, n, by_start, by_end)
            for k, (w, g) in enumerate(((self.weights, (told - expected) / n - ridge * self.weights / 10), (self.follow, (met - pairs) / n - ridge * self.follow))):
                step[k] = 0.9 * step[k] + 0.1 * g
                seen[k] = 0.99 * seen[k] + 0.01 * g * g
                w += rate * (step[k] / (1 - 0.9**turn)) / (np.sqrt(seen[k] / (1 - 0.99**turn)) + 1e-8)
        return self

    def _expected(self, at: np.ndarray, x: np.ndarray, n: int, by_start: list, by_end: list) -> tuple[np.ndarray, np.ndarray]:
        """(features, neighbours) that segmentations have on average under the weights, over all examples."""
        kinds, length = len(KINDS), len(by_end) - 1
        row, i, j = at.T
        score = x @ self.weights
        # logarithms of sums over all segmentations up to a place that end outside, in each kind, or before a span of each kind
        out, ent, enter = np.full((length + 1, n), -np.inf), np.full((length + 1, n, kinds), -np.inf), np.full((length + 1, n, kinds), -np.inf)
        out[0] = 0
        for p in range(length + 1):  # only examples in which a span ends or starts at a place change there
            if p:
                out[p] = out[p - 1]
                which, cut = by_end[p - 1]
                if len(which):
                    here = row[which[cut]]
                    out[p, here] = np.logaddexp(out[p, here], _sum(ent[p - 1, here], 1))
            enter[p] = out[p][:, None]
            which, cut = by_end[p]
            if len(which):
                here = row[which[cut]]
                ent[p, here] = np.logaddexp.reduceat(enter[i[which], row[which]] + score[which], cut)
                enter[p, here] = np.logaddexp(out[p, here][:, None], _sum(ent[p, here][:, :, None] + self.follow, 1))
        whole = np.logaddexp(out[length], _sum(ent[length], 1))
        # and over all that follows a place after a span of each kind, or a token outside
        end, rest, pairs = np.zeros((length + 1, n, kinds)), np.zeros((length + 1, n)), np.zeros((kinds, kinds))
        for p in range(length - 1, -1, -1):
            rest[p], end[p] = rest[p + 1], rest[p + 1][:, None]
            which, cut = by_start[p]
            if len(which):
                here = row[which[cut]]
                go = np.logaddexp.reduceat(end[j[which], row[which]] + score[which], cut)
                rest[p, here] = np.logaddexp(rest[p + 1, here], _sum(go, 1))
                end[p, here] = np.logaddexp(rest[p + 1, here][:, None], _sum(self.follow + go[:, None, :], 2))
                pairs += np.exp(ent[p, here][:, :, None] + self.follow + go[:, None, :] - whole[here][:, None, None]).sum(0)
        return x.T @ np.exp(enter[i, row] + score + end[j, row] - whole[row][:, None]), pairs

    def decode(self, text: str, covered: list[tuple[int, int]] = (), block: int = 2048) -> list[tuple[int, str, int]]:
        """The best segmentation's spans, none over what is covered. A span that helps no segmentation is left out of the sums; time is linear in the text."""
        t = Tokens(text, covered)
        spare = 2 * max(0.0, float(self.follow.max()))
        ends: dict[int, list] = {}
        for low in range(0, t.n, block):
            i, j = t.candidates(low, min(t.n, low + block))
            if not len(i):
                continue
            score = t.features(i, j) @ self.weights
            for r, k in zip(*np.nonzero(score + spare > 0), strict=True):
                ends.setdefault(int(j[r]), []).append((int(i[r]), int(k), float(score[r, k])))
        if not ends:
            return []
        best, of = {0: (0.0, -1)}, {}  # at a place: the best sum and the kind that ends there (-1: outside); of[place, kind]: (sum, start, kind before)
        places = sorted({0, *ends, *(i for x in ends.values() for i, _, _ in x)})
        outside = {0: 0.0}
        for a, b in zip(places[:-1], places[1:], strict=True):
            outside[b] = best[a][0]
            for i, k, score in ends.get(b, ()):
                options = [(outside[i], -1), *((of[i, p][0] + self.follow[p, k], p) for p in range(len(KINDS)) if (i, p) in of)]
                value, before = max(options)
                if (b, k) not in of or of[b, k][0] < value + score:
                    of[b, k] = (value + score, i, before)
            best[b] = max([(outside[b], -1), *((of[b, k][0], k) for k in range(len(KINDS)) if (b, k) in of)])
        at, kind, found = len(places) - 1, best[places[-1]][1], []
        index = {p: k for k, p in enumerate(places)}
        while at:
            if kind < 0:
                at -= 1
                kind = best[places[at]][1]
            else:
                _, i, before = of[places[at], kind]
                found.append((int(t.start[i]), KINDS[kind], int(t.end[places[at] - 1])))
                at, kind = index[i], before
        return found[::-1]


def _grouped(at: np.ndarray, side: int, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place: the candidates that start (or end) there by example, and where each example's begin."""
    order = np.lexsort((at[:, 0], at[:, side]))
    out = []
    for which in np.split(order, np.searchsorted(at[order, side], np.arange(1, length))):
        row = at[which, 0]
        out.append((which, np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), row[1:] != row[:-1]]))))
    return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


# Learning.


def _written(kind: str, span: str, r: random.Random) -> str:
    """The same datum in a way that the patterns do not know."""
    if kind == "email":
        local, domain = span.split("@", 1)
        at, dot = r.choice([(" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), (" @ ", "."), ("(at)", "(dot)"), (" {at} ", " {dot} ")])
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", r.choice(["[.]", "(.)", " . ", "[dot]", "(dot)"]))
    d = _digits(span)
    if kind == "card":
        return r.choice(". ").join(d[k : k + 4] for k in range(0, len(d), 4))
    d = d[-10:]
    return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "00" + str(r.randrange(1, 99)) + " {} {} {}", "({}){}-{}"]).format(d[:3], d[3:6], d[6:])


def _decoy(kind: str, span: str, r: random.Random) -> str:
    """Something like it that is none."""
    d = _digits(span) or "7"
    if kind == "email":
        return r.choice(["@" + span.split("@")[0], span.split("@")[1], span.replace("@", "/"), "@ " + d, span.split("@")[0] + "@"])
    if kind == "ip":
        parts = span.split(".")
        return r.choice([".".join(parts[:3]), ".".join(parts[:2]), ".".join([str(300 + int(parts[0][-3:] or 0)), *parts[1:]]), "v" + parts[0] + "." + parts[1], ":".join(parts[:3])])
    if kind == "card":
        wrong = d[:-1] + str((int(d[-1]) + r.randrange(1, 10)) % 10)
        return r.choice([wrong, wrong, " ".join(wrong[k : k + 4] for k in range(0, len(wrong), 4)), wrong[:12], hashlib.md5(d.encode()).hexdigest(), d[:4] + "-" + d[4:8], d[:9], wrong + d, ".".join(wrong[k : k + 4] for k in range(0, len(wrong), 4))])
    return r.choice([f"20{d[:2]}-0{d[2]}-1{d[3]}", f"{d[:1]},{d[1:4]},{d[4:7]}", f"1{d[0]}:3{d[1]}:{d[2:4]}", d[:7], f"{d[:3]}.{d[3:5]}", f"{d[:4]}/{d[4:6]}", f"{d[:2]}.0{d[2]}.19{d[3:5]}", f"+{d[0]}", f"{d[:2]} {d[2:4]} {d[4:6]}", f"978-{d[:1]}-{d[1:5]}", f"{d[:3]}-{d[3:5]}"])


def _made(r: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    """A stretch with one datum of each kind, for corpora that hold none."""
    words = [["send", "it", "to", "call", "from", "und", "la", "Ref", "is", "at"][r.randrange(10)] for _ in range(20)]
    card = "".join(str(r.randrange(10)) for _ in range(15))
    card += next(c for c in "0123456789" if luhn(card + c))
    local = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9)))
    values = [
        ("email", f"{local}{r.choice(['', '.' + words[0].lower(), str(r.randrange(100))])}@{words[3].lower()}{r.choice(['', str(r.randrange(9)), '-' + words[4].lower()])}.{r.choice(['com', 'org', 'co.uk', 'example.com', 'de'])}"),
        ("ip", ".".join(str(r.randrange(256)) for _ in range(4))),
        ("card", card),
        ("phone", f"+{r.randrange(1, 99)} ({r.randrange(100, 1000)}) {r.randrange(100, 1000)}-{r.randrange(1000, 10000)}"),
    ]
    r.shuffle(values)
    text, spans = "", []
    for k, (kind, value) in enumerate(values):
        text += " ".join(words[5 * k : 5 * k + r.randrange(1, 6)]) + r.choice([" ", ": ", ", ", " (", "\n", " "])
        spans.append((len(text), kind, len(text) + len(value)))
        text += value + r.choice([" ", ". ", ", ", ") ", "\n", " "])
    return text, spans


def _rewritten(text: str, spans: list[tuple[int, str, int]], how, marked: bool, r: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    out, done, new = "", 0, []
    for a, kind, b in spans:
        if a < done:
            continue
        out += text[done:a]
        value = how(kind, text[a:b], r)
        if marked:
            new.append((len(out), kind, len(out) + len(value)))
        out += value
        done = b
    return out + text[done:], new


def examples(stretches: list[str]) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Marked stretches: as they are, with data rewritten, with decoys; and as many made ones."""
    r = random.Random(7)
    pool = [(t, base_spans(t)) for t in stretches]
    pool += [_made(r) for _ in range(max(24, len(pool) // 8))]
    out = []
    for text, spans in pool:
        clear = [x for k, x in enumerate(spans) if all(x[0] >= y[2] or y[0] >= x[2] for m, y in enumerate(spans) if m != k)]
        out.append((text, spans))
        if clear and len(clear) == len(spans):
            out.append(_rewritten(text, spans, _written, True, r))
            out.append(_rewritten(text, spans, _decoy, False, r))
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands around seeds; of seeds near each other one stretch."""
    release()
    for batch in batches:
        out: list[str] = []
        for text in batch.column("text").to_pylist():
            last = -STRETCH
            for m in _SEED.finditer(text or ""):
                if m.start() >= last + STRETCH:
                    out.append(text[max(0, m.start() - STRETCH) : m.start() + 2 * STRETCH])
                    last = m.start()
                if len(out) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(out)], names=["stretch"])
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["stretch"])


def train(docs: DataFrame, sample: int = SAMPLE, turns: int = TURNS) -> Field:
    """Learn from ``sample`` stretches of the corpus, half of them with what may be base spans, chosen by hash and each text once.

    A stretch has at most 3 * STRETCH code points, so the sample is bounded in bytes too. A corpus without any
    gives a field learned from made stretches alone.
    """
    pieces = documents(docs).select("text").filter("text rlike '[0-9@]'").mapInArrow(_stretches, "stretch string")
    known = F.col("stretch").rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|\+[0-9]|[0-9]([ -]?[0-9]){13}")
    once = pieces.select(known.alias("known"), F.xxhash64("stretch").alias("chance"), "stretch").groupBy("known", "chance").agg(F.min("stretch").alias("stretch"))
    rank = F.row_number().over(Window.partitionBy("known").orderBy("chance"))
    rows = once.withColumn("rank", rank).filter(F.col("rank") <= sample // 2).orderBy("known", "rank").collect()
    return Field().fit(examples([r["stretch"] for r in rows]), turns)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    ``spans`` holds the base spans and those the field adds, none of which overlaps a base span,
    as kind:start:end in code points, the end exclusive, by start and then kind. Null texts are empty
    texts: no spans, the digest of nothing. Repeated and null doc_ids keep a row each; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((field.weights, field.follow)))  # a fixed size
    order = {k: n for n, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = Field(*pickle.loads(shared.value))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                added = []
                if text and _SEED.search(text):
                    for a, b in regions(text):
                        inside = [(max(x, a) - a, min(y, b) - a) for x, _, y in base if x < b and y > a] if base else []
                        added += [(x + a, k, y + a) for x, k, y in model.decode(text[a:b], inside)]
                line = lambda spans: ",".join(f"{k}:{x}:{y}" for x, k, y in spans)
                count = [sum(k == kind for _, k, _ in base) for kind in KINDS]
                rows.append([*count, hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(base + added, key=lambda s: (s[0], order[s[1]], s[2]))), len(added)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()], strict=True))], names=[x.split()[0] for x in _FOUND.split(", ")])

    return documents(docs).mapInArrow(run, _FOUND)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
