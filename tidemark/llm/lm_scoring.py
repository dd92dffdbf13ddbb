"""Cross-entropy difference: documents scored by two matched n-gram models over one vocabulary.

The target model counts the documents labelled good and not toxic, the background model all documents; both have the
same order (bigrams interpolated with unigrams), the same vocabulary, the same smoothing, and background counts
are scaled to the target's number of tokens. A token's loss difference is its background loss minus its target loss;
a document's score is the mean over its tokens: the higher, the more it reads like the target. A document's own counts
are left out of the models that score it, so that target documents have no advantage by having been counted.

Counts are exact sums over the whole corpus of every word and pair of words (as 64-bit hashes), none dropped or merged.
Documents are dealt into chunks by content. A chunk counts its distinct grams and sends them, packed by slices of the
hash range; a slice adds up what all chunks sent and answers each chunk with the sums of its grams, in their order; the
chunk, tokenised again, scores its documents. The numbers of chunks and slices grow with the text, so what a task
holds is bounded; a gram goes to its slice once for each chunk, however common it is. Nothing is broadcast or collected.

Words are runs of letters and digits, A-Z lower-cased, and of any non-ASCII characters.

Defined cases: null and empty text have no tokens, and null losses and score; without target documents both models are
the smoothing alone and the background; repeated rows get equal rows; several labels rows of a doc_id count by their
minimum quality and maximum toxic; texts of any length are scored whole, one document in one chunk; equal scores need no
order, nothing is ranked; an empty table gives no rows; other columns are ignored. The smoothing's vocabulary is the
counted words and one more for all unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.common import content_key, table
from tidemark.llm.quality import labelled

#: Text of a chunk of documents, and of the corpus for each slice of the hash range.
CHUNK_BYTES = 4 << 20
#: Weight of the bigram model where its history has been seen, against the unigram model.
BIGRAM = 0.6
SMOOTHING = 0.5


@dataclass
class Models:
    """What the grams of every chunk count in the whole corpus, and tokens (background, target) and vocabulary."""

    chunks: int
    answers: DataFrame  # (chunk, slice, sums)
    tokens: tuple[int, int]
    words: int


@dataclass
class Grams:
    """Tokens of a chunk's documents: distinct grams in order, and each token's word and pair as places among them."""

    grams: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    first: np.ndarray  # the token opens its document
    n: np.ndarray  # tokens of each document

    def bounds(self, slices: int) -> np.ndarray:
        """Slice i has the grams bounds[i] to bounds[i + 1]."""
        return np.searchsorted(_slice(self.grams, slices), np.arange(slices + 1))


def _slice(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def _grams(text: pa.ChunkedArray) -> Grams:
    """A pair is the previous word, or the document start, and the word behind."""
    words, pairs, firsts, counts = ([np.zeros(0, kind)] for kind in (np.uint64, np.uint64, bool, np.int64))
    for block in T.blocks(text):
        w = T.words(block, T.ALNUM, lower=True)
        h = w.hashes()
        first = np.zeros(len(h), dtype=bool)
        first[w.first[:-1][w.counts > 0]] = True
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        before[first] = np.uint64(0x51ED270B)
        for whole, part in ((words, h), (pairs, T.mix(h + T.mix(before))), (firsts, first), (counts, w.counts)):
            whole.append(part)
    word = np.concatenate(words)
    grams, at = np.unique(np.concatenate([word, *pairs]), return_inverse=True)
    return Grams(grams, at[: len(word)], at[len(word) :], np.concatenate(firsts), np.concatenate(counts))


def _packed(x: np.ndarray) -> bytes:
    """Counts as planes of bytes behind the number of planes; planes of zeros take next to nothing once compressed."""
    size = np.min_scalar_type(int(x.max(initial=0))).itemsize
    return bytes([size]) + x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    size = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def chunked(rows: DataFrame, chunks: int) -> DataFrame:
    return rows.select("doc_id", "text", "target", F.pmod(content_key(), F.lit(chunks)).cast("int").alias("chunk"))


def totals(rows: DataFrame, slices: int) -> tuple[tuple[int, int], int]:
    """Tokens of the background and of the target, and the number of distinct words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for block in T.blocks(batch.column("text")):
                w = T.words(block, T.ALNUM, lower=True)
                distinct = np.unique(w.hashes())
                own = _slice(distinct, slices)
                at = np.flatnonzero(np.diff(own, prepend=np.uint64(slices)))
                sums = np.zeros((2, len(at)), dtype=np.int64)
                if len(at):
                    sums[:, 0] = w.counts.sum(), w.counts[target[block.lo : block.hi]].sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at].astype(np.int32)), pa.array(sums[0]), pa.array(sums[1]),
                     pa.array([x.tobytes() for x in np.split(distinct, at[1:])][: len(at)], pa.binary())],
                    names=["slice", "background", "target", "words"])

    def add(group: pa.Table) -> pa.Table:
        distinct = np.unique(np.frombuffer(b"".join(group["words"].to_pylist()), np.uint64))
        return pa.table({c: [sum(group[c].to_pylist())] for c in ("background", "target")} | {"words": [len(distinct)]})

    parts = rows.select("text", "target").mapInArrow(count, "slice int, background long, target long, words binary")
    got = parts.groupBy("slice").applyInArrow(add, "background long, target long, words long").agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in ("background", "target", "words"))).first()
    return (got[0], got[1]), got[2]


def counts(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Models:
    """Exact background and target counts of every gram of the corpus, for every chunk that has it."""
    chunks = slices = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes

    def ask(group: pa.Table) -> pa.Table:
        g = _grams(group["text"])
        mine = np.repeat(group["target"].to_numpy(), g.n)
        sums = [np.bincount(g.word[some], minlength=len(g.grams)) + np.bincount(g.pair[some], minlength=len(g.grams))
                for some in (slice(None), mine)]
        at = g.bounds(slices)
        full = np.flatnonzero(np.diff(at)).tolist()
        return pa.table([
            pa.array([i for i in full], pa.int32()), pa.array([group["chunk"][0].as_py()] * len(full), pa.int32()),
            *(pa.array([f(x[at[i] : at[i + 1]]) for i in full], pa.binary())
              for x, f in ((g.grams, np.ndarray.tobytes), (sums[0], _packed), (sums[1], _packed)))],
            names=["slice", "chunk", "grams", "background", "target"])

    def answer(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        cuts = np.cumsum([len(x) for x in parts])[:-1]
        sums = []
        for side in ("background", "target"):
            total = np.zeros(int(at.max()) + 1, dtype=np.int64)
            np.add.at(total, at, np.concatenate([_unpacked(x) for x in group[side].to_pylist()]))
            sums.append([_packed(x) for x in np.split(total[at], cuts)])
        return pa.table([group["chunk"], group["slice"], *(pa.array(x, pa.binary()) for x in sums)],
                        names=["chunk", "slice", "background", "target"])

    asked = chunked(rows, chunks).groupBy("chunk").applyInArrow(
        ask, "slice int, chunk int, grams binary, background binary, target binary")
    answers = asked.groupBy("slice").applyInArrow(answer, "chunk int, slice int, background binary, target binary")
    tokens, words = totals(rows, slices)
    return Models(chunks, answers, tokens, words + 1)  # one more for all words that are not in the corpus


def own_counts(doc: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """How often the slot of each token occurs in the token's document."""
    _, back, n = np.unique((doc.astype(np.int64) << 32) | slot, return_inverse=True, return_counts=True)
    return n[back].astype(np.float64)


def losses(table_: np.ndarray, total: np.ndarray, word: np.ndarray, pair: np.ndarray, history: np.ndarray, first: np.ndarray,
           scale: float, own: tuple[np.ndarray, np.ndarray, np.ndarray], vocabulary: int) -> np.ndarray:
    """-log P of every token under one model without its own document; history: slot of the word before.

    total and own (counts of word, pair and history in the token's document) are given for every token.
    """
    words, pairs, before = (np.maximum(0, table_[at] - mine) * scale for at, mine in zip((word, pair, history), own, strict=True))
    uni = (words + SMOOTHING) / (np.maximum(0, total) * scale + SMOOTHING * vocabulary)
    seen = np.where(first, 0.0, before)
    part = np.where(seen > 0, BIGRAM * np.minimum(1.0, pairs / np.maximum(seen, 1e-9)) + (1 - BIGRAM) * uni, uni)
    return -np.log(part)


def scored(rows: DataFrame, model: Models) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row."""
    totals_, vocabulary = model.tokens, model.words
    scale = totals_[1] / totals_[0] if totals_[0] and totals_[1] else 1.0
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g = _grams(docs["text"])
        answers = answers.sort_by("slice")
        background, target = (np.concatenate([np.zeros(0, np.int64), *map(_unpacked, answers[c].to_pylist())]).astype(np.float64)
                              for c in ("background", "target"))
        history = np.zeros_like(g.word)
        history[1:] = g.word[:-1]
        n = g.n
        doc = np.repeat(np.arange(len(n)), n)
        mine = own_counts(doc, g.word)
        # the history is the word before: its own count is that token's, last word of the document included
        own = (mine, own_counts(doc, g.pair), np.concatenate([mine[:1], mine[:-1]]))
        in_target = docs["target"].to_numpy()[doc].astype(np.float64)
        each = []
        for counted, total, by, part in ((target, totals_[1], 1.0, in_target), (background, totals_[0], scale, 1.0)):
            loss = losses(counted, total - n[doc] * part, g.word, g.pair, history, g.first, by, tuple(x * part for x in own), vocabulary)
            each.append(np.bincount(doc, weights=loss, minlength=len(n)) / np.maximum(1, n))
        none = n == 0
        return pa.table([docs["doc_id"], pa.array(n), pa.array(each[0], mask=none), pa.array(each[1], mask=none),
                         pa.array(each[1] - each[0], mask=none)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return chunked(rows, model.chunks).groupBy("chunk").cogroup(model.answers.groupBy("chunk")).applyInArrow(
        run, f"doc_id {id_type}, n_tokens long, target_loss double, background_loss double, score double")


def target_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled(docs, labels).select("doc_id", "text", F.expr("quality = 1 and toxic = 0").alias("target"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op10: one row for each document."""
    rows = target_rows(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored(rows, counts(rows))


SQL = None
