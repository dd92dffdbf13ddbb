"""Substring dedup: passages of at least 50 words that stand in an earlier document are taken out of later ones.

Anchored blocks of 25 words are the index, the documents' own blocks are the probes, and hits are extended to
maximal exact repeats: a hit whose whole stretch of windows (extent) equals an earlier one is extended by comparing
the two stretches at once; where stretches differ, each of their 50-word windows is compared. Blocks are chosen by
content instead of at every 25th word, because fixed places would need a probe from every rolling window of the
corpus in the exchange (README: Corpus operators).

A window is removed when its word sequence also starts in a document with a smaller doc_id; windows are judged on
the input. Words `[^\\x20\\x09-\\x0D]+` are taken unchanged and compared as 64-bit hashes.

Defined cases: null text has no words and stays null where text is returned; documents of fewer than 50 words keep
everything; rows with the same doc_id do not remove each other; a null doc_id removes and loses nothing; repeated
windows inside one document stay; of equal windows that of the smallest doc_id stays; texts of any length are read whole,
one document in one task; an empty table gives no rows; other columns are ignored by `removed` and carried through by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm import text as T
from tidemark.llm.common import giving_back, split_join, table, written

WINDOW = 50
BLOCK = 25


def _windows(docs: DataFrame, spots: DataFrame, window: int) -> DataFrame:
    """(ext, o, w): hash w of the o-th window of every extent to compare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spots")
            for block in T.blocks(batch.column("text")):
                symbols, first = repeats.word_symbols(block)
                rolling = T.Rolling(symbols)
                mine = column.slice(block.lo, len(block))
                flat = mine.flatten()
                base = np.repeat(first[:-1], [len(x) for x in mine])
                s, n = (flat.field(f).to_numpy().astype(np.int64) for f in ("s", "n"))
                place = np.repeat(np.arange(len(s)), n)
                offset = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
                at = (base + s)[place] + offset
                yield pa.RecordBatch.from_arrays(
                    [flat.field("ext").take(pa.array(place)), pa.array(offset.astype(np.int32)),
                     pa.array(T.signed(rolling.of(at, at + window)))], names=["ext", "o", "w"])

    return repeats.texts_with(docs, spots).select("text", "spots").mapInArrow(giving_back(run), "ext long, o int, w long")


def ranges(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(key, s, n): windows s .. s + n - 1 to remove from the document row with that content key."""
    found = repeats.repeated_anchors(docs.where("doc_id is not null"), repeats.word_symbols, window, block, True, "word-anchors")
    extents = written(
        found.groupBy("ext").agg(F.min("doc_id").alias("first"), F.max("varied").alias("varied"),
                                 F.min(F.struct("key", "s", "n")).alias("rep")), "word-extents")
    windows = written(_windows(docs, repeats.copies_to_compare(extents), window), "word-windows")
    dated = windows.join(extents.select("ext", "first"), "ext")
    earliest = dated.groupBy("w").agg(F.min("first").alias("since"), F.max("first").alias("until")).where("since < until")
    # windows that an extent of an earlier document has too
    partly = split_join(dated, earliest.select("w", "since"), "w").where("since < first").groupBy("ext").agg(
        F.collect_list(F.struct("o", "since")).alias("partly"))
    known = extents.select("ext", "first").join(partly, "ext", "left")
    # an extent seen first in this document, with no earlier window, removes nothing
    placed = split_join(found, known, "ext").where("first < doc_id or partly is not null")
    whole = placed.where("first < doc_id").select("key", "s", "n")
    some = (
        placed.where("first >= doc_id").select("key", "doc_id", "s", F.explode("partly").alias("p"))
        .where("p.since < doc_id").select("key", (F.col("s") + F.col("p.o")).alias("s"), F.lit(1).alias("n"))
    )
    return whole.union(some).distinct()


def removed(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, total, n_removed, n_spans, kept, null_text) for every row; kept: the words left, joined by spaces."""
    return repeats.kept_parts(docs, ranges(docs, window, block), window, words=True)


def deduplicated(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with repeated passages taken out of text (untouched where nothing is); documents left empty go."""
    parts = repeats.kept_parts(docs, ranges(docs, window, block), window, words=True, keep=docs.columns)
    left = parts.where("n_removed = 0 or n_removed < total")
    fields = [F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("doc.text")).alias("text")
              if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return left.select(*fields)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op9: one row for each document."""
    return removed(table(spark, folder, "documents")).select(
        "doc_id", F.col("total").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (
  SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS win
  FROM w, unnest(generate_series(1, len(ws) - 49)) AS u(p) WHERE len(ws) >= 50),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win),
g AS (SELECT DISTINCT doc_id, i FROM p JOIN f USING (win), unnest(generate_series(p, p + 49)) AS u(i) WHERE first < doc_id),
r AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
         CASE WHEN n IS NULL THEN array_to_string(ws, ' ')
              ELSE array_to_string(list_filter(ws, lambda x, i : NOT list_contains(gone, i)), ' ') END AS kept
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
