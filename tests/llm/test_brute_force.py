"""Queries that SQL cannot express, against plain versions, round trips and held-out figures on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import catalog, lm_scoring, packing, quality
from tidemark.llm.common import table

FOLDER = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def tokens():
    encoder = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return lambda text: [*encoder.encode(text or "", add_special_tokens=False).ids, 2]


def run(spark, name):
    return catalog.QUERIES[name](spark, FOLDER)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_suffix_dedup_equals_brute_force(spark, docs):
    texts = [(d["doc_id"], (d["text"] or "").encode()) for d in docs]
    starts = Counter(hash(b[i : i + 400]) for _, b in texts for i in range(len(b) - 399))
    expected = []
    for doc_id, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if starts[hash(b[i : i + 400])] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        expected.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = run(spark, "op2_suffix_array_dedup").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert any(e[2] for e in expected)


def test_language_of_held_out_documents(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op4_language_id").collect()}
    learned = {d["lang"] for d in docs if d["lang"] is not None and not held_out(d["doc_id"])}
    right = asked = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == held_out(d["doc_id"]) and 0 <= r.score <= 1
        if any(c.isalpha() for c in d["text"] or ""):
            assert r.lang_pred in learned
            if r.held_out and d["lang"] is not None:
                asked += 1
                right += r.lang_pred == d["lang"]
        else:
            assert r.lang_pred == "und"
    assert len(got) == len(docs) and asked > 20 and right >= 0.95 * asked


def test_packing_is_a_round_trip(spark, docs, tokens):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in run(spark, "op8_packing").collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for d in docs:
        ids, at = tokens(d["text"]), 0
        for p in sorted(pieces[d["doc_id"]], key=lambda p: p.start):
            part = np.array(ids[at : at + p.length], dtype="<u4")
            assert (p.start, p.length, p.doc_tokens, p.ids_crc32) == (at, len(part), len(ids), zlib.crc32(part.tobytes()))
            at += p.length
        assert at == len(ids)
    padded = used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        used += at
        padded += at if at & (at - 1) == 0 else 4096
    assert len(pieces) == len(docs) and used >= 0.99 * padded


def test_packing_of_texts_with_added_tokens_is_a_round_trip(spark, tokens):
    texts = ["one <|endoftext|> two", "<|startoftext|>", "a<|endoftext|>b", "a<|ENDOFTEXT|>b", "<<|endoftext|>>!", "<|endoftext|><|endoftext|>x",
             "It<|endoftext|>'s", "é<|startoftext|>\u0301 z", "<|endof<|endoftext|>text|>", "ends in <|endof", "text|> begins", "endoftext", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {p.doc_id: [] for p in docs.collect()}
    for p in sorted(packing.packed(docs, packing.public_path()).collect(), key=lambda p: p.start):
        got[p.doc_id] += p.ids
    assert got == {i: tokens(text) for i, text in enumerate(texts)}
    assert got[0] == [637, 49407, 1237, 2]


def test_expectation_maximisation_equals_one_vote_at_a_time():
    rng = np.random.default_rng(5)
    truth = rng.random(300) < 0.3
    each = np.stack([np.where(rng.random(300) < 0.2, 2, np.where(rng.random(300) < a, truth, ~truth)) for a in (0.9, 0.8, 0.6)], axis=1)
    patterns, back, n = np.unique(each, axis=0, return_inverse=True, return_counts=True)
    start = np.where((patterns == 1).any(axis=1), 0.6, 0.2)
    got = quality.expectation_maximisation(patterns, n.astype(float), start, rounds=15, tolerance=0.0)
    p = [float(start[b]) for b in back.ravel()]
    for _ in range(15):
        share = [(sum(1 - x for x in p) + 1) / 302, (sum(p) + 1) / 302]
        chance = [[[(8.0 if v == c else 1.0) for v in range(3)] for c in (0, 1)] for _ in range(3)]
        for row, x in zip(each, p, strict=True):
            for k, v in enumerate(row):
                chance[k][0][v] += 1 - x
                chance[k][1][v] += x
        chance = [[[v / sum(side) for v in side] for side in labeller] for labeller in chance]
        p = []
        for row in each:
            sides = [share[c] * math.prod(chance[k][c][v] for k, v in enumerate(row)) for c in (0, 1)]
            p.append(sides[1] / sum(sides))
    assert np.allclose(got.posterior(patterns)[back.ravel()], p)


def test_quality_of_documents_whose_labels_are_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels")
    known = labels.where(F.expr("crc32(cast(doc_id as string)) % 4 <> 2"))
    rows = quality.labelled(table(spark, folder, "documents"), known)
    got = quality.scored(rows, quality.train(rows)).join(labels.where(F.expr("crc32(cast(doc_id as string)) % 4 = 2")).select(
        "doc_id", F.col("quality").alias("good"), "toxic"), "doc_id").collect()
    clean = [r.kept for r in got if r.good == 1 and r.toxic == 0]
    bad = [r.kept for r in got if r.good == 0 or r.toxic == 1]
    assert len(clean) > 20 and sum(clean) >= 0.97 * len(clean)
    assert bad and sum(bad) <= 0.4 * len(bad)
    assert all(r.kept == (r.quality >= 0.5) and 0 <= r.quality <= 1 for r in got)


def test_toxic_documents_of_every_language_are_found_without_their_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents")
    rows = quality.labelled(docs, labels.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    got = quality.scored(rows, quality.train(rows)).join(
        labels.where("crc32(cast(doc_id as string)) % 4 = 2 and toxic = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        kept = [r.kept for r in got if r.lang == lang]
        assert len(kept) > 10 and sum(kept) <= 0.3 * len(kept)


def test_learnt_words_leave_out_the_document_judged(spark):
    docs = [(i, "bad word", 1) for i in range(3)] + [(i, "fine word", 0) for i in range(3, 63)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    lexicon = quality.toxic_words(rows)
    (block,) = quality.T.blocks(pa.array(["bad word", "bad word", "fine word"]))
    assert len(lexicon.words) == 1 and lexicon.documents == (3, 60)
    assert lexicon.hits(quality.style(block), np.array([-1, 1, 0])).tolist() == [1, 0, 0]


def test_lm_scoring_equals_brute_force(spark):
    good = ["the river runs to the sea", "a quiet river meets the sea at night", "the sea is quiet"]
    other = ["buy now buy now", "the offer ends at night buy the offer", "river", "", "sea sea sea sea"]
    texts = [*good, *other]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(good))], "doc_id long, quality int, toxic int")
    rows = lm_scoring.target_rows(docs, labels)
    got = {r.doc_id: r for r in lm_scoring.scored(rows, lm_scoring.counts(rows)).collect()}
    words = [PLAIN.findall(t) for t in texts]

    def tally(some):
        uni, pair = Counter(), Counter()
        for ws in some:
            uni.update(ws)
            pair.update(zip([None, *ws], ws))  # noqa: B905
        return uni, pair

    scale = sum(map(len, words[:3])) / sum(map(len, words))
    vocabulary = len({w for ws in words for w in ws}) + 1
    for i, ws in enumerate(words):
        if not ws:
            assert got[i].n_tokens == 0 and got[i].score is None
            continue
        means = []
        for some, by in ((words[:3], 1.0), (words, scale)):
            uni, pair = tally(some)
            if i < 3 or some is words:
                mine = tally([ws])
                uni.subtract(mine[0])
                pair.subtract(mine[1])
            total, loss = sum(uni.values()), 0.0
            for before, w in zip([None, *ws], ws):  # noqa: B905
                p = (uni[w] * by + lm_scoring.SMOOTHING) / (total * by + lm_scoring.SMOOTHING * vocabulary)
                if before is not None and uni[before] > 0:
                    p = lm_scoring.BIGRAM * min(1.0, pair[before, w] / uni[before]) + (1 - lm_scoring.BIGRAM) * p
                loss -= math.log(p)
            means.append(loss / len(ws))
        assert got[i].target_loss == pytest.approx(means[0], abs=1e-4)
        assert got[i].background_loss == pytest.approx(means[1], abs=1e-4)
        assert got[i].score == pytest.approx(means[1] - means[0], abs=2e-4)


def test_lm_counts_stay_exact_with_many_distinct_grams(spark):
    """Words and pairs far beyond what a table of 2^20 or 2^21 slots keeps apart, in more than one chunk."""
    rng = np.random.default_rng(3)
    words = [[f"w{x}" for x in (rng.random(3000) ** 2 * 60_000).astype(int)] for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(words)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id long, quality int, toxic int")
    rows = lm_scoring.target_rows(docs, labels)
    got = {r.doc_id: r for r in lm_scoring.scored(rows, lm_scoring.counts(rows, chunk_bytes=100_000)).collect()}
    assert len(got) == len(words)
    vocabulary = len({w for ws in words for w in ws}) + 1
    for i in (0, 14, 15, 39):
        for some, loss in ((words[:15], got[i].target_loss), (words, got[i].background_loss)):
            by = 1.0 if some is not words else 15 / 40
            others = [ws for ws in some if ws is not words[i]]
            uni = Counter(w for ws in others for w in ws)
            pair = Counter(p for ws in others for p in zip(ws, ws[1:]))  # noqa: B905
            total = sum(uni.values()) * by
            expected = 0.0
            for before, w in zip([None, *words[i]], words[i]):  # noqa: B905
                p = (uni[w] * by + lm_scoring.SMOOTHING) / (total + lm_scoring.SMOOTHING * vocabulary)
                if before is not None and uni[before]:
                    p = lm_scoring.BIGRAM * pair[before, w] / uni[before] + (1 - lm_scoring.BIGRAM) * p
                expected -= math.log(p)
            assert loss == pytest.approx(expected / len(words[i]), abs=1e-9)


def test_lm_totals_count_every_distinct_word(spark):
    rows = spark.createDataFrame([(1, "One two 3", True), (2, "two four", False), (3, None, True), (4, "", False)],
                                 "doc_id long, text string, target boolean")
    assert lm_scoring.totals(rows, 5) == ((5, 3), 4)


def one_of_each(docs):
    sets, kept = {}, {}
    for d in docs:
        ws = SPACED.findall((d["text"] or "").translate(LOWER))
        kept.setdefault((d["doc_id"], d["text"]), d)
        sets[d["doc_id"]] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((root(a), root(b)))
            least[b] = a
    return [d for d in kept.values() if root(d["doc_id"]) == d["doc_id"]]


def without_earlier_passages(docs):
    words = {d["doc_id"]: SPACED.findall(d["text"] or "") for d in docs}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    out = []
    for d in docs:
        ws = words[d["doc_id"]]
        gone = set()
        for p in range(len(ws) - 49):
            if first[tuple(ws[p : p + 50])] < d["doc_id"]:
                gone.update(range(p, p + 50))
        if not gone:
            out.append(d)
        elif len(gone) < len(ws):
            out.append({**d, "text": " ".join(w for i, w in enumerate(ws) if i not in gone)})
    return out


def without_benchmark(docs, items):
    def words(text):
        return PLAIN.findall((text or "").translate(LOWER))

    windows = {tuple(ws[i : i + 10]) for ws in map(words, items) if ws for i in range(max(1, len(ws) - 9))}
    sizes = {len(w) for w in windows}
    return [d for d in docs if not any(tuple(ws[i : i + n]) in windows for ws in [words(d["text"])] for n in sizes for i in range(len(ws) - n + 1))]


def test_pipeline_equals_brute_force(spark, docs, tokens):
    start = table(spark, FOLDER, "documents")
    left = [r.asDict() for r in corpus_pipeline.language_id(spark, start, FOLDER).collect()]
    gone = {d["doc_id"] for d in docs} - {d["doc_id"] for d in left}
    assert {d["doc_id"] for d in docs if not any(c.isalpha() for c in d["text"] or "")} <= gone
    left = without_earlier_passages(one_of_each(left))
    left = without_benchmark(left, pq.read_table(f"{FOLDER}/benchmark.parquet")["text"].to_pylist())
    got = defaultdict(list)
    for p in corpus_pipeline.run(spark, FOLDER).collect():
        got[p.doc_id].append((p.start, list(p.ids)))
    assert {i: [x for _, ids in sorted(parts) for x in ids] for i, parts in got.items()} == {d["doc_id"]: tokens(d["text"]) for d in left}
    assert 0 < len(left) < len(docs)
