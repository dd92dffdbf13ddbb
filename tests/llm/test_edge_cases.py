"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    common, decontamination, embedding_dedup, language, licenses, lm_scoring, near_duplicates, packing, quality,
    substring_dedup, suffix_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, w string, n int, doc string"
LONG = " ".join(f"word{i}" for i in range(20_000))
TEXTS = [None, "", " \n\t ", "one", "the same text twice here", "the same text twice here", LONG, "x" * 50_000, "***", "é ñ ü"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None, 1, "w", 2, "d") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "a text without an id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "word7 word8")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (6, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_licenses(odd, none):
    found = licenses.spans(odd)
    assert found.agg(F.sum("copies")).first()[0] == len(TEXTS) + 3
    assert by_id(found, "n_words")[6] == (20_000,)
    assert by_id(found, "n_words")[0] == (0,)
    assert licenses.spans(none).count() == 0


def test_licenses_in_a_very_long_text(spark):
    """A million words with a phrase in the middle and at the end: work follows the hits, not their square."""
    text = "word " * 500_000 + "mit license " + "word " * 500_000 + "apache license"
    row = licenses.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_words == 1_000_004
    assert sorted((p.label, p.start) for p in row.places if p.base) == [("apache", 1_000_002), ("mit", 500_000)]


def test_language(odd, none):
    model = language.learn(language.training_rows(odd))
    rows = by_id(language.identify(odd, model), "held_out", "lang_pred", "score")
    assert rows[0][1:] == rows[1][1:] == rows[2][1:] == rows[8][1:] == ("und", 0.0)
    assert rows[6][1:] == ("en", 1.0) and rows[None][0] is False
    assert language.identify(odd, model).count() == len(TEXTS) + 3
    assert language.identify(none, language.learn(none)).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.learn(none)).collect()} == {"und"}
    carried = language.identify(odd, model, with_rows=True).select("doc.*")
    assert carried.schema == odd.schema and carried.exceptAll(odd).count() == 0


def test_near_duplicates(odd, none):
    rows = by_id(near_duplicates.linked(odd), "n", "component_id")
    assert rows[0] == (0, 0) and rows[2] == (0, 2) and rows[3] == (1, 3)
    assert rows[4] == rows[5] == (1, 4) and rows[6] == (19_996, 6)
    assert near_duplicates.linked(odd).count() == len(TEXTS) + 3
    left = near_duplicates.one_of_each(odd)
    assert left.schema == odd.schema
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 6, 7, 8, 9, None]))
    assert near_duplicates.linked(none).count() == 0 and near_duplicates.one_of_each(none).count() == 0


def test_substring_dedup(odd, none, spark):
    rows = by_id(substring_dedup.removed(odd), "total", "n_removed", "kept")
    assert rows[0] == (0, 0, b"") and rows[6][:2] == (20_000, 0)
    assert substring_dedup.removed(odd).count() == len(TEXTS) + 3
    assert substring_dedup.deduplicated(odd).schema == odd.schema
    assert substring_dedup.deduplicated(none).count() == 0
    twice = spark.createDataFrame([(5, LONG), (5, LONG), (7, "head " + LONG + " tail"), (None, LONG)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.removed(twice).collect())
    assert got == [("5", 0), ("5", 0), ("7", 20_000), ("None", 0)]


def test_suffix_dedup(odd, none, spark):
    rows = by_id(suffix_dedup.removed(odd), "total", "n_removed", "n_spans")
    assert rows[0] == (0, 0, 0) and rows[7] == (50_000, 50_000, 1) and rows[4] == (24, 0, 0)
    assert suffix_dedup.removed(none).count() == 0
    twice = spark.createDataFrame([(5, LONG), (5, LONG), (6, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.removed(twice).collect()) == [0, len(LONG), len(LONG)]


def test_suffix_dedup_of_many_equal_rows(spark):
    text = " ".join(f"word{i}" for i in range(1500))
    rows = spark.createDataFrame([(7, text)] * 2000 + [(8, "other")], "doc_id long, text string")
    got = suffix_dedup.removed(rows).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(7, len(text), 2000), (8, 0, 1)]


def test_suffix_dedup_of_passages_around_the_limit(spark):
    """Passages of over 50 words in unrelated documents: 400 bytes go from every copy, the first too; 399 stay, unless less is asked for."""
    rows = []
    for first, size in ((0, 399), (5, 400)):
        passage = " ".join(f"{'st'[size - 399]}{k:05d}" for k in range(60))[:size]
        for i in range(first, first + 5):
            filler = " ".join(f"d{i}w{k}" for k in range(80 + 7 * i))
            rows.append((i, f"{filler} {'abcdefghij'[i]}{passage}{'ABCDEFGHIJ'[i]} {filler[::-1]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(suffix_dedup.removed(docs), "n_removed", "n_spans") == {i: (0, 0) if i < 5 else (400, 1) for i in range(10)}
    assert by_id(suffix_dedup.removed(docs, 300, 200), "n_removed", "n_spans") == {i: (399 if i < 5 else 400, 1) for i in range(10)}


def test_long_words_that_a_polynomial_confuses(spark):
    """The Thue-Morse word over two letters and its complement have equal polynomial hashes modulo 2^64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.removed(df).collect()} == {0}
    two = spark.createDataFrame([(1, f"{a} {a}"), (2, f"{b} {b}")], "doc_id long, text string")
    assert by_id(near_duplicates.linked(two), "component_id") == {1: (1,), 2: (2,)}
    encoder = packing.tokenizer(packing.public_path()).encoder
    found = {}
    for r in sorted(packing.packed(df, packing.public_path()).collect(), key=lambda r: r.start):
        found[r.doc_id] = found.get(r.doc_id, []) + r.ids
    assert found == {i: encoder.encode(t, add_special_tokens=False).ids + [packing.END_ID] for i, t in ((1, f"{a} {tail}"), (2, f"{b} {tail}"))}


def test_decontamination(odd, none, items):
    rows = by_id(decontamination.scan(odd, items), "n_words", "spans", "items")
    assert rows[0] == (0, [], []) and rows[4] == (5, [(1, 3)], ["3"])
    assert rows[6] == (20_000, [(7, 9)], [""])
    assert decontamination.scan(odd, items).count() == len(TEXTS) + 3
    clean = decontamination.remove_documents(odd, items)
    assert clean.schema == odd.schema and clean.count() == len(TEXTS) + 3 - 5
    cut = by_id(decontamination.remove_spans(odd, items), "text")
    assert cut[4] == ("the  twice here",) and cut[0] == (None,)
    assert decontamination.scan(none, items).count() == 0
    assert decontamination.scan(odd, items.limit(0)).where("size(spans) > 0").count() == 0


def test_decontamination_in_blocks_equals_one_block(odd, items):
    one = decontamination.scan(odd, items).select("row", "n_words", decontamination.n_hit().alias("h"), "items")
    some = decontamination.scan(odd, items, block_bytes=8).select("row", "n_words", decontamination.n_hit().alias("h"), "items")
    assert sorted(map(str, one.collect())) == sorted(map(str, some.collect()))


def test_quality_and_lm(odd, none, labels):
    rows = quality.labelled(odd, labels)
    assert quality.scored(rows, quality.train(rows)).count() == len(TEXTS) + 3
    empty = quality.labelled(none, labels)
    assert quality.scored(empty, quality.train(empty)).count() == 0
    rows = lm_scoring.target_rows(odd, labels)
    got = by_id(lm_scoring.scored(rows, lm_scoring.counts(rows)), "n_tokens", "score")
    assert got[0] == (0, None) and got[6][0] == 20_000 and got[6][1] is not None
    empty = lm_scoring.target_rows(none, labels)
    assert lm_scoring.scored(empty, lm_scoring.counts(empty)).count() == 0


def test_packing_round_trip(odd, none):
    encoder = packing.tokenizer(packing.public_path()).encoder
    pieces = packing.packed(odd.where("doc_id not in (4, 5)"), packing.public_path(), pool_tokens=5_000).collect()
    sequences, documents = {}, {}
    for p in pieces:
        assert len(p.ids) == p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        documents.setdefault(p.doc_id, []).append((p.start, p.ids))
    for parts in sequences.values():
        total = 0
        for offset, length in sorted(parts):
            assert offset == total
            total += length
        assert total <= packing.LENGTH and (total == packing.LENGTH or total & (total - 1) == 0)
    for doc_id, text in enumerate(TEXTS):
        if doc_id not in (4, 5):
            ids = [x for _, part in sorted(documents[doc_id]) for x in part]
            assert ids == encoder.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
    assert packing.packed(none, packing.public_path()).count() == 0


def test_packing_takes_the_cheapest_sequence_with_room():
    """Plain version: one document after another, by falling length, ties in order of reading."""
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 90, 60), np.array([7, 7, 7, 7, 50, 50, 64, 64, 130]), np.ones(9, dtype=np.int64)):
        room, rest = 64, int(lengths.sum()) % 64
        sizes = [room] * (int(lengths.sum()) // room) + [1 << b for b in range(6, -1, -1) if rest >> b & 1]
        used, cost = [0] * len(sizes), [0.0] * len(sizes)
        expected, opened = [], 0
        for doc in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
            start, n = 0, int(lengths[doc])
            while n >= room and opened < len(sizes) and sizes[opened] == room and used[opened] == 0:
                expected.append((doc, start, room, opened, 0))
                used[opened], opened, start, n = room, opened + 1, start + room, n - room
            while n:
                free = [i for i in range(len(sizes)) if sizes[i] - used[i] >= n] or [i for i in range(len(sizes)) if used[i] < sizes[i]]
                i = min(free, key=lambda i: (cost[i], i))
                size = min(n, sizes[i] - used[i])
                expected.append((doc, start, size, i, used[i]))
                used[i] += size
                cost[i] += size + size * size / packing.QUADRATIC_AT
                start, n = start + size, n - size
        assert packing.pack(lengths.astype(np.int64), room) == expected


def test_odd_rows_pass_the_whole_pipeline(odd, none, spark, tmp_path):
    spark.createDataFrame([(1, "word7 word8 word9"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = spark.createDataFrame([(20 + i, "the quick brown fox jumps over the lazy dog again and " * 3 + str(i), "en", "s", 1, 1, "w", 2, "d")
                                  for i in range(3)], SCHEMA)
    for rows in (odd.unionByName(long), none):
        docs = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.written(stage(spark, docs, str(tmp_path)), "odd-pipeline")
            if k < 4:
                assert docs.columns == odd.columns
        assert docs.where("length <= 0").count() == 0 and (docs.count() > 0) == (rows is not none)


def test_columns_named_like_internal_ones(spark):
    names = ("chunk", "target", "spots", "row", "bad", "held_out", "gram", "tid", "ids", "s", "ext", "copies", "words", "start", "pos", "here")
    rows = [(i, f"a mit license text number {i % 2} of some words", "en", *("x",) * len(names)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    assert licenses.spans(docs).count() >= 2 and near_duplicates.one_of_each(docs).columns == docs.columns
    assert substring_dedup.deduplicated(docs).columns == docs.columns and suffix_dedup.removed(docs).count() == 4
    assert decontamination.remove_documents(docs, items).count() == 0 and packing.packed(docs, packing.public_path()).count() >= 4
    assert language.identify(docs, language.learn(language.training_rows(docs))).count() == 4
    rows = lm_scoring.target_rows(docs, labels)
    assert lm_scoring.scored(rows, lm_scoring.counts(rows)).count() == 4
    rows = quality.labelled(docs, labels)
    assert quality.scored(rows, quality.train(rows)).count() == 4


def test_embeddings(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1),
            (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.0, 1.0], 1),
            (11, [], 1), (12, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()))
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1)]
    assert all(g[1] == 0 and g[2] in (g[0], None) for g in got if g[0] not in (1, 2, 3))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
