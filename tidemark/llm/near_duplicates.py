"""N-gram Jaccard join: documents linked by the Jaccard similarity of their word-shingle sets, with signature trees.

1. Shingle sets. Documents with equal sets become one node (hash of the set), so exact copies cost one row each.
2. Blocks. Sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each under any one global order.
   The order puts rare shingles first: document frequencies of all shingles are summed into a sketch of bounded size,
   so a common line or passage stands at the end of every set and is hardly ever probed, and a shingle known to be
   in one document only is not sent at all. Nodes of compatible size that share a prefix shingle are a pair; a pair
   whose common prefix shingles are too few for the threshold is dropped. Where a shingle has many such pairs its
   nodes are chained by size instead. Connected nodes form a block, and every link lies inside one block.
3. Signature trees. A block is cut by set size into leaves of bounded membership; compatible leaf pairs are dealt
   out as tasks. A task builds a tree over each leaf whose nodes hold the OR of the members' token bitmaps and the
   range of their sizes, and walks both trees together: a node pair is dropped when its largest possible overlap
   cannot reach the threshold, or when all its members are connected already; single pairs are verified exactly.
4. The verified links that connect something new give the components.

No pair is lost: dropped node pairs hold no link, or only links between documents that are connected anyway.

Defined cases: null text, empty text and text of white space have an empty set and are linked with nothing; fewer
words than a shingle give one shingle of all words; repeated rows and equal texts share a set and are linked; a null
doc_id is never the smallest of a component; texts of any length are read whole; an
empty table gives no rows; other columns are ignored by `linked` and
carried through by `one_of_each`. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.common import bounded, components, content_key, giving_back, split_join, table, written

#: Cells of the frequency sketch, as powers of two, and slices that are added up in one task each.
LEAST_BITS, MOST_BITS, SLICE_BITS = 16, 26, 6
#: Shingles that a task counts before it sends their cells on.
HELD_SHINGLES = 2_000_000
LEAF = 256
BITS = 4096
#: Ratio between the size classes into which a block is cut.
SIZE_STEP = 1.1
#: Nodes that share a prefix shingle are paired if they are at most GROUP and their pairs at most PAIRS for each of them.
GROUP, PAIRS = 64, 2
#: Probes that a task pairs at a time, and pairs that it looks at together.
HELD_PROBES, HELD_PAIRS = 200_000, 1_000_000


def shingle_sets(block: T.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a block, ascending, and the documents' offsets into them."""
    w = T.words(block, T.NONSPACE, lower=True)
    rolling = T.Rolling(w.hashes())
    at = T.window_starts(w.first, k)
    doc = np.searchsorted(w.first, at, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    grams = np.concatenate([rolling.of(at, at + k), rolling.of(w.first[short], w.first[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(block) + 1))


#: Document counts that a cell of the sketch tells apart: level i means at least LEVELS[i] and less than the next.
LEVELS = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 32, 64, 128, 512, 2048, 16384, 1 << 20])


@dataclass
class Sketch:
    """Document frequencies of all shingles, summed in 2**bits cells and kept as four-bit levels.

    A shingle in a cell of level 1 stands in one document only. The size follows the corpus up to MOST_BITS (32 MB);
    it decides how many probes are made, not which links are found.
    """

    bits: int
    packed: np.ndarray

    def level(self, grams: np.ndarray) -> np.ndarray:
        cell = (grams >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.packed[cell >> 1] >> ((cell & 1) << 2).astype(np.uint8)) & np.uint8(15)


def frequency_sketch(docs: DataFrame, k: int) -> Sketch:
    """Sums over the whole table: tasks send the counts of their cells, every slice of cells is added up in one task."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // 8).bit_length()))
    width = 1 << (bits - SLICE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            edges = np.searchsorted(cells, np.arange((1 << SLICE_BITS) + 1) * width)
            some = np.flatnonzero(np.diff(edges))
            pack = zstandard.ZstdCompressor(level=1).compress
            gaps = np.diff(cells, prepend=0).astype("<u4")
            gaps[edges[:-1][some]] = cells[edges[:-1][some]] - some * width
            n = np.minimum(n, 2**31).astype("<u4")
            ranges = [(edges[i], edges[i + 1]) for i in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([pack(gaps[x:y].tobytes()) for x, y in ranges], pa.binary()),
                 pa.array([pack(n[x:y].tobytes()) for x, y in ranges], pa.binary())], names=["part", "gaps", "n"])

        waiting = 0
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                held.append((shingle_sets(block, k)[0] >> np.uint64(64 - bits)).astype(np.int64))
                waiting += len(held[-1])
                if waiting >= HELD_SHINGLES:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, gaps, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part not in total:
                    total[part] = np.zeros(width, dtype=np.int64)
                total[part][np.cumsum(np.frombuffer(unpack(gaps), dtype="<u4").astype(np.int64))] += np.frombuffer(unpack(n), dtype="<u4")
        levels = [(np.searchsorted(LEVELS, x, side="right") - 1).astype(np.uint8) for x in total.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([(x[::2] | (x[1::2] << 4)).tobytes() for x in levels], pa.binary())],
            names=["part", "levels"])

    rows = docs.select("text").mapInArrow(giving_back(count), "part int, gaps binary, n binary").repartition("part").mapInArrow(
        giving_back(add), "part int, levels binary").toArrow()
    packed = np.zeros((1 << SLICE_BITS, width // 2), dtype=np.uint8)
    for part, levels in zip(rows["part"].to_pylist(), rows["levels"].to_pylist(), strict=True):
        packed[part] = np.frombuffer(levels, dtype=np.uint8)
    return Sketch(bits, packed.reshape(-1))


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-num * n // den) + 1


def signed_documents(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, doc_id, n, node, last, prefix): set size, identity of the set, and its rarest shingles, for every row.

    last is the place of the prefix's last shingle in the global order, to 32 bits.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, k))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                grams, at = shingle_sets(block, k)
                n = np.diff(at)
                doc = np.repeat(np.arange(len(block)), n)
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(T.mix(grams), dtype=np.uint64)])
                node = T.mix((sums[at[1:]] - sums[at[:-1]]) + n.astype(np.uint64))
                level = often.level(grams)
                order = np.lexsort((grams, level, doc))
                rank = np.arange(len(grams)) - np.repeat(at[:-1], n)
                size = np.where(n > 0, prefix_length(n, num, den), 0)
                # a shingle of this document alone meets no other document: it takes its place but need not be sent
                sent = (rank < np.repeat(size, n)) & (level[order] > 1)
                chosen = grams[order][sent]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[sent], minlength=len(block)))]).astype(np.int32)
                last = np.zeros(len(block), dtype=np.int64)
                some = np.flatnonzero(np.diff(offsets))
                place = (level[order][sent].astype(np.int64) << 28) | (chosen >> np.uint64(36)).astype(np.int64)
                last[some] = place[offsets[1:][some] - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(block.lo, len(block)), batch.column("doc_id").slice(block.lo, len(block)),
                     pa.array(n.astype(np.int64)), pa.array(T.signed(node), mask=n == 0), pa.array(last),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(T.signed(chosen)))],
                    names=["key", "doc_id", "n", "node", "last", "prefix"])

    return docs.select(content_key().alias("key"), "doc_id", "text").mapInArrow(
        giving_back(run), f"key long, doc_id {id_type}, n long, node long, last long, prefix array<long>")


def _candidates(token: np.ndarray, node: np.ndarray, size: np.ndarray, hot: int | None, num: int, den: int) -> list[np.ndarray]:
    """(a, b, need) of nodes that share a shingle, from probes in order of token, size and node; hot is only chained.

    need is the least number of common prefix shingles with which the pair can reach the threshold. Of two prefixes
    the one that ends first in the global order lies whole before the end of the other, so what it has in common with
    the other set it has in common with the other prefix: the overlap is at most that plus its set's rest.
    """
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, size = token[new], node[new], size[new]
    n, last = size >> 32, size & 0xFFFFFFFF
    rest = n - prefix_length(n, num, den)
    same = token[1:] == token[:-1]
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    count = np.diff(np.append(start, len(token)))
    chain = (count > GROUP) | (False if hot is None else token[start] == hot)
    found: list[list[np.ndarray]] = [[], [], []]
    for c in np.unique(count[(count > 1) & ~chain]):
        i, j = np.triu_indices(c, 1)
        groups, step = np.flatnonzero((count == c) & ~chain), max(1, HELD_PAIRS // len(i))
        for at in range(0, len(groups), step):
            lo = start[groups[at : at + step]]
            x, y = lo[:, None] + i, lo[:, None] + j
            fits = n[x] * den >= n[y] * num
            dense = fits.sum(axis=1) > PAIRS * c
            chain[groups[at : at + step]] = dense
            fits[dense] = False
            x, y = x[fits], y[fits]
            most = np.where(last[x] < last[y], rest[x], np.where(last[x] > last[y], rest[y], np.maximum(rest[x], rest[y])))
            least = -(-num * (n[x] + n[y]) // (num + den))
            for column, values in zip(found, (node[x], node[y], least - most), strict=True):
                column.append(values)
    # nodes of compatible size are connected by those of sizes between them
    x = np.flatnonzero(chain.repeat(count)[:-1] & same & (n[:-1] * den >= n[1:] * num))
    for column, values in zip(found, (node[x], node[x + 1], np.zeros(len(x), dtype=np.int64)), strict=True):
        column.append(values)
    return [np.concatenate(column) for column in found]


def _pairs(num: int, den: int):
    """Reads probes sorted by token, size and node and yields the candidate pairs of each token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        hot: int | None = None

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal hot
            token, node, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # the last token's probes wait for the rest of them; if it alone fills what is held, it is chained on from its last
            now = keep = len(token) if final else int(np.searchsorted(token, token[-1]))
            if now == 0:
                now, keep, hot = len(token), len(token) - 1, token[-1]
            held.append([x[keep:] for x in (token, node, size)])
            a, b, need = _candidates(token[:now], node[:now], size[:now], hot, num, den)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], names=["a", "b", "need"])

        waiting = 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            waiting += batch.num_rows
            if waiting >= HELD_PROBES:
                yield from out(False)
                waiting = 0
        if held:
            yield from out(True)
    return run


def candidate_pairs(signed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of nodes that connect all links; a link is a pair itself or connected by chains."""
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # two different sets of n and more shingles are at most n / (n + 1) similar
    probes = signed.where("node is not null").where(F.col("n") * (den - num) >= num).select(
        F.explode("prefix").alias("token"), "node", F.expr("shiftleft(n, 32) | last").alias("size"))
    pairs = probes.repartition(parts, "token").sortWithinPartitions("token", "size", "node").mapInArrow(
        giving_back(_pairs(num, den)), "a long, b long, need long")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("need").alias("need")).where("common >= need").select("a", "b")


class Tree:
    """A binary tree over members in order of size; a node is a range of members with its OR bitmap and size range."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), BITS), dtype=bool)
        for i, s in enumerate(sets):
            bits[i, (s >> np.uint64(52)).astype(np.int64)] = True
        self.excess = self.size - bits.sum(axis=1)  # tokens that share a bit with another of the same set
        self.leaf_bits = np.packbits(bits, axis=1).view(np.uint64)
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int, int]] = {}

    def node(self, lo: int, hi: int) -> tuple[np.ndarray, int, int, int]:
        """(OR bitmap, least size, largest size, largest excess)"""
        known = self.nodes.get((lo, hi))
        if known is None:
            if hi - lo == 1:
                known = (self.leaf_bits[lo], int(self.size[lo]), int(self.size[lo]), int(self.excess[lo]))
            else:
                a, b = self.node(lo, (lo + hi) // 2), self.node((lo + hi) // 2, hi)
                known = (a[0] | b[0], min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
            self.nodes[lo, hi] = known
        return known


def new_links(a: Tree, b: Tree | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links (member of a, member of b; both of a if b is None) that connect what was not connected before."""
    same = b is None
    b = a if b is None else b
    shift = 0 if same else len(a.sets)
    label = np.arange(len(a.sets) + (0 if same else len(b.sets)))
    stack = [(0, len(a.sets), 0, len(b.sets))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        if same and (alo, ahi) == (blo, bhi):
            if ahi - alo > 1:
                mid = (alo + ahi) // 2
                stack += [(alo, mid, mid, ahi), (mid, ahi, mid, ahi), (alo, mid, alo, mid)]
            continue
        first = label[alo]
        if (label[alo:ahi] == first).all() and (label[blo + shift : bhi + shift] == first).all():
            continue
        abits, amin, amax, aexcess = a.node(alo, ahi)
        bbits, bmin, bmax, bexcess = b.node(blo, bhi)
        shared = int(np.bitwise_count(abits & bbits).sum())
        most = min(amax, bmax, shared + min(aexcess, bexcess))
        # J >= num/den needs den * overlap >= num * (|A| + |B| - overlap)
        if (den + num) * most < num * (amin + bmin):
            continue
        if ahi - alo == 1 and bhi - blo == 1:
            overlap = len(np.intersect1d(a.sets[alo], b.sets[blo], assume_unique=True))
            if den * overlap >= num * (amin + bmin - overlap):
                yield alo, blo
                label[label == label[blo + shift]] = first
            continue
        if ahi - alo >= bhi - blo:
            mid = (alo + ahi) // 2
            stack += [(mid, ahi, blo, bhi), (alo, mid, blo, bhi)]
        else:
            mid = (blo + bhi) // 2
            stack += [(alo, ahi, mid, bhi), (alo, ahi, blo, mid)]


def _pair_links(num: int, den: int):
    """Reads rows sorted by pair and yields the new links of each pair of leaves."""
    def links(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int]]:
        sides: list[dict[int, np.ndarray]] = [{}, {}]
        for side, node, tokens in rows:
            sides[side][node] = np.frombuffer(tokens, dtype=np.uint64)
        ordered = [sorted(s.items(), key=lambda x: (len(x[1]), x[0])) for s in sides if s]
        trees = [Tree([t for _, t in s]) for s in ordered]
        other = ordered[1] if len(trees) > 1 else ordered[0]
        for i, j in new_links(trees[0], trees[1] if len(trees) > 1 else None, num, den):
            yield ordered[0][i][0], other[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            found = list(links(rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            columns = [batch.column(c) for c in ("side", "node", "tokens")]
            for i in range(batch.num_rows):
                if pair[i] != now:
                    if held:
                        yield out(held)
                    now, held = pair[i], []
                held.append(tuple(c[i].as_py() for c in columns))
        if held:
            yield out(held)
    return run


def linked(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, doc_id, n, component_id) of every row: sets are linked when den * overlap >= num * union.

    component_id is the smallest doc_id reachable by links, the row's own if there are none.
    """
    signed = written(signed_documents(docs, k, num, den), "shingle-prefixes")
    blocks = components(candidate_pairs(signed, num, den), "shingle-blocks")
    # leaves: by size class, and by hash within a class
    sizes = signed.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("key").alias("key"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    members = written(sizes.join(blocks, "node").select("node", "n", "key", F.col("component").alias("block")), "shingle-members")
    large = members.groupBy("block").agg(F.count("*").alias("members")).where(F.col("members") > LEAF).select("block", F.lit(True).alias("large"))
    # a block that fits is one leaf
    members = members.join(bounded(large, large.count()), "block", "left").withColumn(
        "class", F.when(F.col("large"), step).otherwise(F.lit(-1)))
    classes = members.groupBy("block", "class").agg(
        F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("largest"))
    leaves = classes.withColumn("parts", F.ceil(F.col("size") / LEAF).cast("long")).select(
        "block", "class", "parts", "least", "largest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    one = leaves.select("block", F.struct("class", "part").alias("x"), F.col("least").alias("xl"), F.col("largest").alias("xh"))
    two = leaves.select("block", F.struct("class", "part").alias("y"), F.col("least").alias("yl"), F.col("largest").alias("yh"))
    # leaf pairs whose size ranges allow the similarity
    pairs = one.join(two, "block").where("x <= y").where(
        (F.col("xh") * den >= F.col("yl") * num) & (F.col("yh") * den >= F.col("xl") * num))
    pairs = pairs.select("block", F.xxhash64("block", "x", "y").alias("pair"), F.explode(F.when(
        F.expr("x = y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("leaf")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("leaf")), F.struct(F.lit(1).alias("side"), F.col("y").alias("leaf"))))).alias("s"))
    pairs = pairs.select("block", "pair", "s.side", "s.leaf.class", "s.leaf.part")
    placed = members.join(classes.select("block", "class", F.ceil(F.col("size") / LEAF).cast("long").alias("parts")), ["block", "class"]) \
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    tasks = written(placed.join(pairs, ["block", "class", "part"]).groupBy("key", "node").agg(
        F.collect_list(F.struct("pair", "side")).alias("tasks")), "shingle-pairs")
    dealt = _token_sets(docs, tasks, k)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(giving_back(_pair_links(num, den)), "a long, b long")
    joined = components(links, "shingle-links")
    return _with_components(signed, joined)


def _token_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(pair, side, node, tokens): the whole shingle set of each member, for every task that it belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                grams, at = shingle_sets(block, k)
                nodes = batch.column("node").slice(block.lo, len(block)).to_pylist()
                # of repeated rows one is enough
                new = [i for i in range(len(block)) if nodes[i] not in seen and not seen.add(nodes[i])]
                tasks = [(i, t["pair"], t["side"]) for i in new for t in batch.column("tasks")[block.lo + i].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for _, p, _ in tasks], pa.int64()), pa.array([s for _, _, s in tasks], pa.int32()),
                     pa.array([nodes[i] for i, _, _ in tasks], pa.int64()),
                     pa.array([grams[at[i] : at[i + 1]].tobytes() for i, _, _ in tasks], pa.binary())],
                    names=["pair", "side", "node", "tokens"])

    texts = docs.select(content_key().alias("key"), "text").join(bounded(members, members.count()), "key")
    return texts.select("text", "node", "tasks").mapInArrow(giving_back(run), "pair long, side int, node long, tokens binary")


def _with_components(signed: DataFrame, joined: DataFrame) -> DataFrame:
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    known = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("total")).where("total > 1")
    named = known.join(ids, "component").select("node", "component_id")
    return split_join(signed.select("key", "doc_id", "n", "node"), named, "node", "left").select(
        "key", "doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without those whose component holds a smaller doc_id; of equal rows one stays."""
    found = linked(docs, k, num, den)
    gone = written(found.where("component_id < doc_id or doc_id is null and component_id is not null").select("key").distinct(), "shingle-gone")
    every = docs.select(F.struct(*docs.columns).alias("doc"), content_key().alias("key"))
    left = every.select("key").join(bounded(gone, gone_rows := gone.count()), "key", "left_anti")
    twice = written(left.groupBy("key").count().where("count > 1").select("key"), "shingle-twice")
    # one join decides about whole rows: beyond a broadcast it moves every text
    other = bounded(gone.union(twice), gone_rows + (twice_rows := twice.count()))
    repeated = every.join(bounded(twice, twice_rows), "key").groupBy("key").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return every.join(other, "key", "left_anti").select("doc.*").unionByName(repeated.select("doc.*"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op3: one row for each document."""
    return linked(table(spark, folder, "documents"), 3, 90, 100).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 2], ' ') AS shingle
  FROM w, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS u(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s AS a JOIN s AS b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS root FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(w.doc_id, min(root)), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id, n
"""
