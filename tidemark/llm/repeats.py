"""Exact repeats of fixed length over all documents: what substring dedup and suffix-array dedup have in common.

Every window of a document has an anchor: the gram in it with the least hash. Equal windows have equal anchors at
equal places, so only windows around anchors whose gram occurs again can repeat. The windows of one anchor are one
stretch, identified by its content (the extent):

* extents with equal content repeat each other as a whole, and are counted without looking at their windows;
* where a gram has several different extents, one copy of each extent gives its windows, which are compared.

So no pair of copies is formed anywhere: groups of any size are counts and minima, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.common import bounded, content_key, giving_back, split_join, written

#: Spots (24 bytes each, some 100 MB as a relation) and removed ranges that are broadcast at most; with more, texts
#: and ranges meet by shuffle. Ranges follow the text even where little of it is compared, so they are shuffled early.
BROADCAST_SPOTS = 2_000_000
BROADCAST_RANGES = 100_000

#: Symbols of a block and its documents' offsets into them: bytes or words.
Symbols = Callable[[T.Block], tuple[np.ndarray, np.ndarray]]


def byte_symbols(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    return T.byte_symbols(block.raw), block.at


def word_symbols(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    w = T.words(block, T.NONSPACE, lower=False)
    return w.hashes(), w.first


def anchor_rows(docs: DataFrame, symbols: Symbols, window: int, gram: int, block_bytes: int) -> DataFrame:
    """(key, doc_id, gram, extent, s, n): anchor windows s .. s + n - 1 of every document row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column("text"), block_bytes):
                a = T.anchors(*symbols(block), window, gram)
                rows = pa.array(a.doc + block.lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(rows), batch.column("doc_id").take(rows), pa.array(T.signed(a.gram)),
                     pa.array(T.signed(a.extent)), pa.array(a.first.astype(np.int32)),
                     pa.array((a.last - a.first + 1).astype(np.int32))],
                    names=["key", "doc_id", "gram", "extent", "s", "n"])

    return docs.select(content_key().alias("key"), "doc_id", "text").mapInArrow(
        giving_back(run), f"key long, doc_id {id_type}, gram long, extent long, s int, n int")


def repeated_anchors(docs: DataFrame, symbols: Symbols, window: int, gram: int, across: bool, purpose: str,
                     block_bytes: int = T.BLOCK_BYTES) -> DataFrame:
    """Written table of the anchors whose gram occurs again (across: in a document of another id).

    (key, doc_id, gram, ext, s, n, varied): ext identifies gram and extent; varied: the gram has several extents.
    """
    rows = anchor_rows(docs, symbols, window, gram, block_bytes)
    grams = rows.groupBy("gram").agg(
        F.count("*").alias("times"), F.min("extent").alias("lo"), F.max("extent").alias("hi"),
        *([F.min("doc_id").alias("first"), F.max("doc_id").alias("last")] if across else []))
    again = grams.where("first < last" if across else "times > 1").select("gram", F.expr("lo <> hi").alias("varied"))
    return written(
        split_join(rows, again, "gram").select("key", "doc_id", "gram", F.xxhash64("gram", "extent").alias("ext"), "s", "n", "varied"), purpose)


def copies_to_compare(extents: DataFrame) -> DataFrame:
    """(key, spots): for the documents that stand for the extents of varied grams, where these extents lie.

    extents: (ext, varied, rep) with rep = (key, s, n) of one copy. A document lists each of its stretches once.
    """
    return extents.where("varied").select("ext", "rep.*").groupBy("key").agg(
        F.collect_list(F.struct("ext", "s", "n")).alias("spots"))


def texts_with(docs: DataFrame, keyed: DataFrame, how: str = "inner") -> DataFrame:
    """(key, doc_id, text) of docs joined with the spots of keyed; broadcast only below the checked number of spots."""
    texts = docs.select(content_key().alias("key"), "doc_id", "text")
    spots = keyed.agg(F.sum(F.size("spots"))).first()[0] or 0
    return texts.join(bounded(keyed, spots, BROADCAST_SPOTS), "key", how)


def kept_parts(docs: DataFrame, ranges: DataFrame, window: int, words: bool, keep: list[str] | None = None) -> DataFrame:
    """Takes the windows named in ranges (key, s, n: windows s .. s + n - 1) out of every document row.

    (doc_id, n, n_removed, n_spans, kept, null_text[, doc]): n and n_removed count symbols; kept is what is left, as
    bytes, or as words joined by one space. keep: columns of docs to carry along as the struct doc.
    """
    found = ranges.groupBy("key").agg(F.collect_list("s").alias("s"), F.collect_list("n").alias("n"))
    found = written(found, "repeat-ranges")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, sizes = batch.column("s"), batch.column("n")
            for block in T.blocks(batch.column("text")):
                total, removed, spans, kept = [], [], [], []
                w = T.words(block, T.NONSPACE, lower=False) if words else None
                at = w.first if words else block.at
                for i in range(len(block)):
                    count = int(at[i + 1] - at[i])
                    a = b = np.zeros(0, np.int64)
                    if starts[block.lo + i].is_valid:
                        a = starts[block.lo + i].values.to_numpy().astype(np.int64)
                        a, b = T.merged(a, a + sizes[block.lo + i].values.to_numpy() - 1 + window)
                    total.append(count)
                    removed.append(int((b - a).sum()))
                    spans.append(len(a))
                    left = np.ones(count, dtype=bool)
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        left[x:y] = False
                    if words:
                        low = int(at[i])
                        kept.append(b" ".join(block.raw[w.start[low + j] : w.end[low + j]].tobytes() for j in np.flatnonzero(left)))
                    else:
                        kept.append(block.raw[at[i] : at[i + 1]][left].tobytes())
                rows = batch.slice(block.lo, len(block))
                columns = [rows.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                           pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), rows.column("text").is_null()]
                names = ["doc_id", "total", "n_removed", "n_spans", "kept", "null_text"]
                if keep:
                    columns.append(rows.column("doc"))
                    names.append("doc")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    row = [F.struct(*keep).alias("doc")] if keep else []
    texts = docs.select(content_key().alias("key"), "doc_id", "text", *row)
    entries = found.agg(F.sum(F.size("s"))).first()[0] or 0
    joined = texts.join(bounded(found, entries, BROADCAST_RANGES), "key", "left").drop("key")
    schema = f"doc_id {id_type}, total long, n_removed long, n_spans long, kept binary, null_text boolean"
    if keep:
        schema += f", doc {joined.schema['doc'].dataType.simpleString()}"
    return joined.mapInArrow(giving_back(run), schema)
