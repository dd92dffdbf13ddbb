"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all training text.

Words are runs of ASCII letters and digits and of any non-ASCII characters, with A-Z lower-cased. A window of an
item is `n` consecutive words; an item with fewer words (but not none) is one window of all its words. A document
word inside any occurrence of a window is hit.

Defined cases: null or empty text has no words (0 hits); an item without words has no window; repeated items and
repeated document rows are treated alike (one output row for each document row); item ids may repeat (an id counts
once) or be null (its windows hit, it is listed as an empty id); an empty benchmark leaves every document clean;
other columns are ignored by `scan` and carried through by `remove_documents` and `remove_spans`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.common import giving_back, table

#: Benchmark bytes that one broadcast holds at most; a larger benchmark is scanned in several such blocks. A block
#: takes about seven times its text: 20 bytes a window, 16 a word, and the text itself.
BLOCK_BYTES = 16_000_000
SCAN = "row long, doc_id {id}, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


class TestGrams:
    """Windows of a block of items: for each window length, sorted hashes with the first word and the item of each.

    Words are places in the items' joined text, so that a window takes a few bytes whatever its length.
    """

    def __init__(self, ids: list[str], texts: pa.Array, n: int) -> None:
        self.ids = ids
        raws, starts, ends = [], [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        n_bytes = n_words = 0
        for block in T.blocks(texts):
            w = T.words(block, T.ALNUM, lower=True)
            rolling = T.Rolling(w.hashes())
            short = np.flatnonzero((w.counts > 0) & (w.counts < n))
            whole = T.window_starts(w.first, n)
            sides = [(n, whole, np.searchsorted(w.first, whole, side="right") - 1)]
            sides += [(int(k), w.first[i], i) for k in np.unique(w.counts[short]) for i in (short[w.counts[short] == k],)]
            for k, at, item in sides:
                found[k].append((rolling.of(at, at + k), (n_words + at).astype(np.int64), (block.lo + item).astype(np.int32)))
            raws.append(w.raw)
            starts.append(n_bytes + w.start)
            ends.append(n_bytes + w.end)
            n_bytes, n_words = n_bytes + len(w.raw), n_words + len(w.start)
        self.raw, self.start, self.end = (np.concatenate(x) if x else np.zeros(0, t) for x, t in (
            (raws, np.uint8), (starts, np.int64), (ends, np.int64)))
        self.by_length = {}
        for k, parts in sorted(found.items()):
            hashes, at, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, dtype=bool)
            bits[hashes >> np.uint64(44)] = True
            self.by_length[k] = hashes[order], at[order], item[order], bits
        self.seen: dict[tuple[int, int], list[tuple[tuple[bytes, ...], set[str]]]] = {}

    def _windows(self, k: int, low: int, high: int) -> list[tuple[tuple[bytes, ...], set[str]]]:
        """(words, items) of the different windows behind one hash; kept for hashes that have been hit."""
        if (k, low) not in self.seen:
            _, at, item, _ = self.by_length[k]
            known: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
            for p, i in zip(at[low:high].tolist(), item[low:high].tolist(), strict=True):
                words = tuple(self.raw[a:b].tobytes() for a, b in zip(self.start[p : p + k], self.end[p : p + k], strict=True))
                known[words].add(self.ids[i])
            self.seen[k, low] = list(known.items())
        return self.seen[k, low]

    def occurrences(self, w: T.Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, length, items) of every window occurrence in a block; hash hits are compared word by word."""
        rolling = T.Rolling(w.hashes())
        for k, (hashes, _, _, bits) in self.by_length.items():
            at = T.window_starts(w.first, k)
            h = rolling.of(at, at + k)
            likely = bits[h >> np.uint64(44)]
            at, h = at[likely], h[likely]
            low, high = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
            hit = high > low
            for p, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                here = tuple(w.bytes_of(p, p + k))
                for content, items in self._windows(k, a, b):
                    if content == here:
                        yield p, k, items


def _scanner(grams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = grams.value
        for batch in batches:
            n_words, spans, items = [], [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for block in T.blocks(batch.column("text")):
                w = T.words(block, T.ALNUM, lower=True)
                n_words.append(w.counts)
                for p, k, ids in test.occurrences(w):
                    i = int(np.searchsorted(w.first, p, side="right")) - 1
                    spans[block.lo + i].append((p - int(w.first[i]), p - int(w.first[i]) + k))
                    items[block.lo + i] |= ids
            for i, found in enumerate(spans):
                if found:
                    a, b = T.merged(*(np.array(x, dtype=np.int64) for x in zip(*found, strict=True)))
                    spans[i] = [{"s": x, "e": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"),
                 pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "spans", "items"])
    return run


def _item_blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[str], pa.Array]]:
    """All items in blocks of about `limit` bytes: a benchmark of any size, each broadcast bounded."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        got = mine.toArrow()
        yield got["id"].to_pylist(), got["text"].combine_chunks()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, n_words, spans, items) for every document row.

    spans: merged ranges of hit words (from 0, end exclusive); items: ids whose windows occur. row is the content
    key of (doc_id, text).
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    passes = []
    for ids, texts in _item_blocks(benchmark, block_bytes):
        grams = spark.sparkContext.broadcast(TestGrams(ids, texts, n))
        passes.append(source.mapInArrow(giving_back(_scanner(grams)), SCAN.format(id=id_type)))
    if len(passes) == 1:
        return passes[0]
    # several benchmark blocks: identical rows would meet in one group, so their number is carried along
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    return (
        every.groupBy("row", "doc_id", "n_words")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
             (F.count("*") / len(passes)).cast("int").alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select("row", "doc_id", "n_words", "spans", "items")
    )


def n_hit() -> Column:
    """Number of words covered by the (sorted, possibly overlapping) spans."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
    return F.aggregate(
        F.array_sort("spans"), start,
        lambda a, x: F.struct(
            (a["total"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["reach"]))).alias("total"),
            F.greatest(a["reach"], x["e"]).alias("reach")),
        lambda a: a["total"].cast("long"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of docs without any hit; all columns kept."""
    found = scan(docs, benchmark, n).where(F.size("spans") > 0).select(F.col("row").alias("bad")).distinct()
    kept = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("row"))
    return kept.join(found, kept["row"] == found["bad"], "left_anti").select("doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, text) with hit words, and what stands between the words of a hit span, taken out of the text."""
    share = docs.sparkSession.sparkContext.broadcast
    tests = [share(TestGrams(ids, texts, n)) for ids, texts in _item_blocks(benchmark, BLOCK_BYTES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in T.blocks(batch.column("text")):
                w = T.words(block, T.ALNUM, lower=True)
                hits = sorted((p, p + k) for t in tests for p, k, _ in t.value.occurrences(w))
                a, b = T.merged(np.array([h[0] for h in hits], dtype=np.int64),
                                np.array([h[1] for h in hits], dtype=np.int64))
                keep = np.ones(len(block.raw), dtype=bool)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    # a merged span may touch the next document's words; cut document by document
                    for i in range(int(np.searchsorted(w.first, x, side="right")) - 1, len(block)):
                        lo, hi = max(x, int(w.first[i])), min(y, int(w.first[i + 1]))
                        if lo < hi:
                            keep[w.start[lo] : w.end[hi - 1]] = False
                        if y <= w.first[i + 1]:
                            break
                for i in range(len(block)):
                    part = slice(int(block.at[i]), int(block.at[i + 1]))
                    out.append(block.raw[part][keep[part]].tobytes().decode("utf-8"))
            null = batch.column("text").is_null().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([None if z else x for x, z in zip(out, null, strict=True)], pa.string())],
                names=["doc_id", "text"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {id_type}, text string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op5: one row for each document."""
    found = scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, len(ws)) AS k,
         array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS gram
  FROM iw, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS u(p) WHERE len(ws) > 0),
places AS (
  SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS gram
  FROM w, (SELECT DISTINCT k FROM grams) AS ks, unnest(generate_series(1, len(ws) - k + 1)) AS u(p)
  WHERE len(ws) >= k),
hits AS (SELECT DISTINCT doc_id, item_id, k, p FROM places JOIN grams USING (k, gram)),
covered AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM hits, unnest(generate_series(p, p + k - 1)) AS u(i) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
