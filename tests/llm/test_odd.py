"""Every operator on texts, on rows that repeat an id, beside columns that have its results' names: megabytes, nulls, one row a row."""

from __future__ import annotations

import random
import zlib

import pytest

R = random.Random(12)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
LONG = " ".join(f"{R.choice(WORDS)}{R.randrange(3000)}" for _ in range(120_000))  # a megabyte
ROWS = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "another text of the same id"), (2, LONG), (3, None), (4, ""), (5, "x" * 300_000), (6, "word " * 100_000), (None, "a null id"), (7, LONG[:2000]), (8, LONG[:2000])]
CLASH = {"op1": "n_words longest kept text_key", "op3": "lang_pred score known n_grams", "op4": "fingerprint component_id fp key", "op5": "start length ids_crc32 sequence_id offset part", "op6": "start n_tokens ids_crc32 block file", "op7": "n_words hits row items", "op8": "score sizes held_out", "op9": "n_bytes n_spans kept", "op10": "payload_bytes media feature", "op11": "spans n_email", "near": "kept component_id ident low"}


def docs(spark, op, rows=ROWS):
    names = CLASH[op].split()
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, t, "aa", *("odd" for _ in names)) for i, t in rows], schema).repartition(4)


def run(spark, op, rows=ROWS):
    d = docs(spark, op, rows)
    if op == "op1":
        from gnomon.llm.substring import substring_dedup

        return substring_dedup(d, grow=True)
    if op == "op3":
        from gnomon.llm.langid import identify, train

        return identify(d, train(d))
    if op == "op4":
        from gnomon.llm.simhash import simhash_groups

        return simhash_groups(d)
    if op == "op5":
        from gnomon.llm.packing import pack

        return pack(d)
    if op == "op6":
        from gnomon.llm.bitpack import read_ids, write_ids

        return read_ids(write_ids(d))
    if op == "op7":
        from gnomon.llm.decontam import contamination

        return contamination(d, spark.createDataFrame([(1, LONG[:300]), (None, None)], "item_id long, text string"))
    if op == "op8":
        from gnomon.llm.quality import score, train

        return score(d, train(d, spark.createDataFrame([(k, k % 2, "x") for k in range(9)], "doc_id long, quality int, score string")))
    if op == "op9":
        from gnomon.llm.suffix import suffix_dedup

        return suffix_dedup(d)
    if op == "op10":
        from gnomon.llm.webp import media

        return media(d)
    if op == "op11":
        from gnomon.llm.pii import Field, find

        return find(d, Field())
    from gnomon.llm.simhash import near_duplicates

    return near_duplicates(d)


@pytest.mark.parametrize("op", CLASH)
def test_odd_texts(spark, op):
    got = [r.asDict() for r in run(spark, op).collect()]
    if op == "op5":  # a row a piece: every id of every row is in one
        tokens = {}
        for r in got:
            tokens.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        alike = sorted(tokens[1, min(n for i, n in tokens if i == 1)])
        assert {i for i, _ in tokens} == {i for i, _ in ROWS} and alike[::2] == alike[1::2]
        assert all(sum(n for _, n in x) % total == 0 for (_, total), x in tokens.items())
        return
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    if op == "op6":
        assert len({r["n_tokens"] for r in got if r["doc_id"] == 1}) == 2 and max(r["n_tokens"] for r in got) > 100_000
    elif op == "op10":
        assert {r["n_bytes"] for r in got if r["doc_id"] == 2} == {len(LONG)} and [r["payload_sha256"] for r in got if r["doc_id"] == 7] == [r["payload_sha256"] for r in got if r["doc_id"] == 8]
    elif op == "op4":
        assert {r["component_id"] for r in got if r["doc_id"] in (7, 8)} == {7} and {r["component_id"] for r in got if r["doc_id"] in (3, 4)} == {3}
    elif op == "op9":
        assert {r["n_bytes"] for r in got if r["doc_id"] == 2} == {len(LONG)} and {r["n_removed"] for r in got if r["doc_id"] in (7, 8)} == {2000}
    elif op == "op7":
        assert [r["contaminated"] for r in got if r["doc_id"] == 7] == [True] and {r["n_words"] for r in got if r["doc_id"] == 2} == {120_000}
    elif op == "op1":
        assert {r["n_removed"] for r in got if r["doc_id"] == 8} == {len(LONG[:2000].split())} - {0}
    elif op == "near":
        assert sum(r["kept"] for r in got if r["doc_id"] in (7, 8)) == 1
    elif op == "op3":
        assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4)} == {"und"}
    elif op == "op11":
        assert {r["spans"] for r in got} == {""}
    elif op == "op8":
        assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1


@pytest.mark.parametrize("op", CLASH)
def test_odd_empty_tables(spark, op):
    assert run(spark, op, []).count() == 0


def test_odd_stages(spark, tmp_path):
    """Stages of the pipeline on the same rows: columns stay as they are, long texts and repeated ids go through."""
    import corpus_pipeline

    rows = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 2 else "aa", "s", 1, "k") for i, t in ROWS]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    spark.createDataFrame([(1, LONG[:300])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, d = d, stage(spark, d, str(tmp_path))
        if k < 4:
            assert d.columns == before.columns
            d.write.parquet(str(tmp_path / f"stage{k}"))
            d = spark.read.parquet(str(tmp_path / f"stage{k}"))
            assert d.filter("doc_id = 2").count() == 1 or k >= 3
    assert d.count() > 0
