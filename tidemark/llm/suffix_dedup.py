"""Suffix-array dedup: bytes of 400-byte strings that start more than once are taken out.

The suffixes that can share 400 bytes with another are found first (anchors, see `repeats`): suffixes whose leading
stretch occurs again as a whole need no sorting. The others are sorted across the cluster by a merge sort that knows
common prefixes: a task sorts its suffixes (24 bytes of text, closed by a fingerprint of the 400 bytes) into a run,
front-codes it (length of the prefix shared with the one before, and the rest), and cuts it at splitters; a range of
all runs meets in one task, where a loser tree merges them, comparing strings only behind the prefix known to be
common. Neighbours that agree in full are 400-byte repeats.

Strings are judged on the input; a byte is removed when any 400-byte string that covers it also starts elsewhere,
in the same document or another; overlaps count; matches never cross documents.

Defined cases: null text is empty; shorter texts keep everything; repeated rows repeat each other and lose every byte
that lies in a 400-byte string; cuts may fall inside a character, so what is kept is bytes; texts of any length are
judged whole, one document in one task; equal strings are no tie to break, all go; an empty table gives no rows; other
columns are ignored.
Text beyond the 24 leading bytes is compared through 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import repeats
from tidemark.llm import text as T
from tidemark.llm.common import split_join, table, written

WINDOW = 400
GRAM = 280
HEAD = 24
WIDTH = HEAD + 8
#: Bytes of text in one anchor block: small, as its arrays should stay in the processor's cache.
ANCHOR_BLOCK = 1 << 18
#: Suffixes that a task sorts into one run.
RUN_SUFFIXES = 1_000_000
RUN = "range int, prefix binary, rest binary, ext binary, o binary"


def front_coded(strings: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths and remaining bytes of sorted rows of a byte matrix."""
    shared = np.zeros(len(strings), dtype=np.uint8)
    if len(strings) > 1:
        differ = strings[1:] != strings[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    rest = np.arange(strings.shape[1])[None, :] >= shared[:, None]
    return shared, strings[rest].tobytes()


class Run:
    """A front-coded run, read from its start: the string, and the prefix it shares with the one before."""

    def __init__(self, prefix: bytes, rest: bytes, ext: bytes, o: bytes) -> None:
        self.prefix, self.rest = prefix, rest
        self.ext, self.o = np.frombuffer(ext, dtype=np.int64), np.frombuffer(o, dtype=np.int16)
        self.place, self.at, self.string = -1, 0, b""

    def step(self) -> int:
        """Moves on; the length of the prefix shared with the string before, or -1 at the end."""
        self.place += 1
        if self.place >= len(self.prefix):
            return -1
        shared = self.prefix[self.place]
        size = WIDTH - shared
        self.string = self.string[:shared] + self.rest[self.at : self.at + size]
        self.at += size
        return shared


def merge(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """(run, shared prefix with the output before) in sorted order, by a loser tree that keeps common prefixes.

    Every node holds the loser of its match and the length of the prefix that it shares with the winner. Of two
    strings that share different lengths with the last output, the longer one is smaller; only for equal lengths
    are bytes compared, from that length on.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    lost = [-1] * size  # run that lost at the node
    lcp = [0] * k  # prefix that a run's string shares with the string it was last compared with
    done = [False] * k
    for i in range(k):
        done[i] = runs[i].step() < 0

    def plays(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs that have been compared with the same string before."""
        if b < 0 or done[b]:
            return a, b
        if a < 0 or done[a]:
            return b, a
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y, n = runs[a].string, runs[b].string, lcp[a]
        while n < WIDTH and x[n] == y[n]:
            n += 1
        if n == WIDTH or x[n] < y[n]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        winner, loser = plays(build(2 * node), build(2 * node + 1))
        lost[node] = loser
        return winner

    now = build(1) if size > 1 else 0
    while now >= 0 and not done[now]:
        yield now, lcp[now]
        n = runs[now].step()
        done[now] = n < 0
        lcp[now] = max(n, 0)
        node = (now + size) // 2
        while node:
            now, lost[node] = plays(now, lost[node])
            node //= 2


def _runs(docs: DataFrame, spots: DataFrame, splitters: list[int], window: int) -> DataFrame:
    """Sorted, front-coded runs of the suffixes to compare, cut at the splitters."""
    head = min(HEAD, window)
    cuts = np.array([x << 8 for x in splitters], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[np.ndarray] = []
        exts: list[np.ndarray] = []
        offsets: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not strings:
                return
            m, ext, o = np.concatenate(strings), np.concatenate(exts), np.concatenate(offsets)
            strings.clear(), exts.clear(), offsets.clear()
            order = np.lexsort(tuple(m[:, i : i + 8].copy().view(">u8").reshape(-1) for i in range(WIDTH - 8, -1, -8)))
            m, ext, o = m[order], ext[order], o[order]
            place = np.searchsorted(cuts, m[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64), side="right")
            edges = np.searchsorted(place, np.arange(len(cuts) + 2))
            rows: list[list] = [[], [], [], [], []]
            for r in range(len(cuts) + 1):
                lo, hi = edges[r], edges[r + 1]
                if lo == hi:
                    continue
                shared, rest = front_coded(m[lo:hi])
                for column, value in zip(rows, (r, shared.tobytes(), rest, ext[lo:hi].tobytes(), o[lo:hi].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])],
                names=["range", "prefix", "rest", "ext", "o"])

        held = 0
        for batch in batches:
            column = batch.column("spots")
            for block in T.blocks(batch.column("text")):
                rolling = T.Rolling(T.byte_symbols(block.raw))
                mine = column.slice(block.lo, len(block))
                flat = mine.flatten()
                base = np.repeat(block.at[:-1], [len(x) for x in mine])
                s, n = (flat.field(f).to_numpy().astype(np.int64) for f in ("s", "n"))
                place = np.repeat(np.arange(len(s)), n)
                offset = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
                at = (base + s)[place] + offset
                m = np.zeros((len(at), WIDTH), dtype=np.uint8)
                m[:, :head] = block.raw[at[:, None] + np.arange(head)[None, :]]
                m[:, HEAD:] = rolling.of(at, at + window).astype(">u8").view(np.uint8).reshape(-1, 8)
                strings.append(m)
                exts.append(flat.field("ext").to_numpy()[place])
                offsets.append(offset.astype(np.int16))
                held += len(at)
                if held >= RUN_SUFFIXES:
                    yield from flush()
                    held = 0
        yield from flush()

    return repeats.texts_with(docs, spots).select("text", "spots").mapInArrow(run, RUN)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes that agree with a neighbour in full, over all runs of each range."""
    ranges: dict[int, list[Run]] = {}
    for batch in batches:
        for r, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ranges.setdefault(r, []).append(Run(*parts))
    for runs in ranges.values():
        exts: list[int] = []
        offsets: list[int] = []
        last: tuple[int, int] | None = None
        told = False
        for which, shared in merge(runs):
            run = runs[which]
            here = (int(run.ext[run.place]), int(run.o[run.place]))
            if shared == WIDTH and last is not None:
                for x in (here,) if told else (last, here):
                    exts.append(x[0])
                    offsets.append(x[1])
                told = True
            else:
                told = False
            last = here
            if len(exts) >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(exts, pa.int64()), pa.array(offsets, pa.int32())], names=["ext", "o"])
                exts, offsets = [], []
        yield pa.RecordBatch.from_arrays([pa.array(exts, pa.int64()), pa.array(offsets, pa.int32())], names=["ext", "o"])


def splitters(docs: DataFrame, parts: int) -> list[int]:
    """Leading seven bytes (as numbers) that cut the suffixes into about equal ranges, from one place in each document's text."""
    size = F.octet_length("text")
    place = (F.pmod(F.xxhash64("doc_id", "text"), F.greatest(size - 8, F.lit(1))) + 1).cast("int")
    head = F.hex(F.substring(F.encode("text", "UTF-8"), place, F.lit(7)))
    value = F.conv(head, 16, 10).cast("long")
    found = docs.where(size >= 8).select(value.alias("v")).agg(
        F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else None
    return sorted(set(found or []))


def ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, s, n): suffixes s .. s + n - 1 whose first `window` bytes start elsewhere too."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = repeats.repeated_anchors(docs, repeats.byte_symbols, window, gram, False, "byte-anchors", ANCHOR_BLOCK)
    extents = written(
        found.groupBy("ext").agg(F.count("*").alias("times"), F.max("varied").alias("varied"),
                                 F.min(F.struct("key", "s", "n")).alias("rep")), "byte-extents")
    runs = _runs(docs, repeats.copies_to_compare(extents), splitters(docs, parts), window)
    equal = runs.repartition(parts, "range").mapInArrow(_merged, "ext long, o int")
    # neighbouring offsets of an extent become one range
    sorted_set = equal.groupBy("ext").agg(F.array_sort(F.collect_set("o")).alias("os"))
    opens = F.filter("os", lambda x, i: (i == 0) | (F.get("os", i - 1) < x - 1))
    closes = F.filter("os", lambda x, i: F.coalesce(F.get("os", i + 1) > x + 1, F.lit(True)))
    partly = sorted_set.select("ext", F.arrays_zip(opens.alias("lo"), closes.alias("hi")).alias("partly"))
    known = extents.select("ext", "times").join(partly, "ext", "left").where("times > 1 or partly is not null")
    placed = split_join(found.select("key", "ext", "s", "n"), known, "ext")
    whole = placed.where("times > 1").select("key", "s", "n")
    some = placed.where("times = 1").select("key", F.explode("partly").alias("p"), "s").select(
        "key", (F.col("s") + F.col("p.lo")).alias("s"), (F.col("p.hi") - F.col("p.lo") + 1).alias("n"))
    return whole.union(some).distinct()  # equal rows share a key, and each has found the same ranges


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, total, n_removed, n_spans, kept, null_text) for every row, in bytes."""
    return repeats.kept_parts(docs, ranges(docs, window, gram), window, words=False)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op2: one row for each document."""
    return removed(table(spark, folder, "documents")).select(
        "doc_id", F.col("total").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = None
