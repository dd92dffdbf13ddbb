"""Language identification of mixed text: script ranges, per-word scores, and Viterbi with a switching penalty.

A word is a run of letters (a-z after lower-casing, or non-ASCII). Its score in a language is the log-likelihood of
its byte trigrams and of the word itself, both in hashed tables of fixed size, counted over every training document.
The script of a word (from its bytes) narrows the languages to those whose training text uses that script. Viterbi
then labels the words of a document, paying `PENALTY` for each change of language; the spans of equal labels are the
result, and the language of most letters is the language of the document, with its share of letters as score.

Defined cases: null text, empty text and text without any letter give `und` with score 0 and no span; a null lang is
never learned; a null doc_id is never learned and not held out; ties go to the language first in alphabetical order;
without any training document everything is `und`; repeated rows get one row each; texts of any length are
labelled whole; an empty table gives no rows; other columns are ignored. Words share 2^16 cells of the model, whatever the
corpus: of words that meet in a cell the more frequent decides, which costs accuracy, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.common import giving_back, table

SLOTS = 1 << 16  # for trigrams, and as many again for words
SCRIPTS = 16
PENALTY = 12.0
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Words whose scores are held at once.
HELD_WORDS = 400_000

LETTERS = T._bytes_in((0x61, 0x7A), (0x80, 0xFF))
#: Script classes by leading UTF-8 byte (fixed values): Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic and
#: South-East Asian, other three-byte scripts, Kana, Han, Hangul, supplementary planes.
_RANGES = ((0x61, 0x7A, 1), (0xC3, 0xCA, 1), (0xCE, 0xCF, 2), (0xD0, 0xD3, 3), (0xD4, 0xD6, 4), (0xD7, 0xD7, 5),
           (0xD8, 0xDF, 6), (0xE0, 0xE0, 7), (0xE1, 0xE1, 8), (0xE3, 0xE3, 9), (0xE4, 0xE9, 10), (0xEA, 0xED, 11),
           (0xF0, 0xF4, 12))
_SCRIPT = np.zeros(256, dtype=np.uint8)
for _low, _high, _class in _RANGES:
    _SCRIPT[_low : _high + 1] = _class


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Features:
    """Hashed features of the words of a block."""

    def __init__(self, block: T.Block) -> None:
        raw = T._LOWER[block.raw]
        if len(raw) > 1:  # capital letters of the Latin-1 range
            high = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
            raw[high] += 0x20
        self.words = w = T.words(T.Block(block.lo, block.hi, raw, block.at), LETTERS, lower=False)
        inside = LETTERS[raw]
        self.bytes = np.flatnonzero(inside)
        shown = np.where(inside, raw, 0x20).astype(np.uint32)
        padded = np.concatenate([[0x20], shown, [0x20]]).astype(np.uint32)
        # a document's first or last byte must not see its neighbour document
        grams = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
        full = np.diff(block.at) > 0
        grams[block.at[:-1][full]] = (grams[block.at[:-1][full]] & np.uint32(0xFFFF)) | np.uint32(0x200000)
        grams[block.at[1:][full] - 1] = (grams[block.at[1:][full] - 1] & np.uint32(0xFFFF00)) | np.uint32(0x20)
        self.grams = ((grams[self.bytes] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
        self.sizes = w.end - w.start
        self.starts = np.cumsum(self.sizes) - self.sizes  # of each word among self.bytes
        self.slots = (w.hashes() >> np.uint64(48)).astype(np.int32) + SLOTS if len(w.start) else np.zeros(0, np.int32)
        kinds = _SCRIPT[raw[self.bytes]]
        self.scripts = np.maximum.reduceat(kinds, self.starts) if len(w.start) else np.zeros(0, np.uint8)


TOTAL = 2 * SLOTS + SCRIPTS


def counts(docs: DataFrame) -> DataFrame:
    """(lang, feature, n): feature counts of every row of docs, by its lang. Partial sums in tasks, then one shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])],
                    names=["lang", "feature", "n"])
            sums.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for block in T.blocks(batch.column("text")):
                f = Features(block)
                names, which = np.unique(np.array(langs[block.lo : block.hi], dtype=object).astype(str), return_inverse=True)
                word_lang = np.repeat(which, f.words.counts)
                byte_lang = np.repeat(word_lang, f.sizes)
                for i, lang in enumerate(names.tolist()):
                    if lang not in sums:
                        if len(sums) >= 64:
                            yield from emptied()
                        sums[lang] = np.zeros(TOTAL, dtype=np.int64)
                    mine = word_lang == i
                    sums[lang] += np.bincount(f.grams[byte_lang == i], minlength=TOTAL)
                    sums[lang] += np.bincount(f.slots[mine], minlength=TOTAL)
                    sums[lang][2 * SLOTS :] += np.bincount(f.scripts[mine], minlength=SCRIPTS)
        yield from emptied()

    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(giving_back(run), "lang string, feature int, n long")
    return rows.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihood tables of fixed size for each learned language."""

    def __init__(self, langs: list[str], n: np.ndarray) -> None:
        self.langs = langs
        tables = []
        for part in (n[:SLOTS], n[SLOTS : 2 * SLOTS]):
            smooth = part + SMOOTHING
            tables.append(np.log(smooth / smooth.sum(axis=0)))
        self.scores = np.concatenate(tables).astype(np.float32)
        # differences decide: the mean over languages is taken out, so that unseen features weigh nothing
        self.scores -= self.scores.mean(axis=1, keepdims=True)
        script = n[2 * SLOTS :]
        uses = script >= 0.001 * np.maximum(1, script.sum(axis=0))
        uses &= script > 0
        uses[~uses.any(axis=1)] = True  # no language is known for the script: it narrows nothing
        self.barred = np.where(uses, 0, -60).astype(np.float32)

    def word_scores(self, f: Features) -> np.ndarray:
        if not len(f.starts):
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        out = self.scores[f.slots] + self.barred[f.scripts]
        for i in range(len(self.langs)):
            out[:, i] += np.add.reduceat(self.scores[:SLOTS, i][f.grams], f.starts)
        return out


def learn(docs: DataFrame) -> Model:
    """Counts over all given rows; the driver receives one number for each language and table slot (bounded)."""
    got = counts(docs).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    n = np.zeros((TOTAL, max(1, len(langs))), dtype=np.float64)
    if len(langs):
        column = got["lang"].combine_chunks().dictionary_encode()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        order = np.array([langs.index(x) for x in column.dictionary.to_pylist()])
        n[got["feature"].to_numpy(), order[column.indices.to_numpy()]] = got["n"].to_numpy()
    return Model(langs, n)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; first[i]..first[i+1] are the words of sequence i. All sequences advance together."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    n, langs = scores.shape
    back = np.zeros((n, langs), dtype=np.uint8 if langs < 256 else np.int32)
    own = np.arange(langs, dtype=back.dtype)[None, :]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    value = np.zeros((len(sizes), langs), dtype=np.float64)
    for t in range(longest):
        k = int(active[t])
        at = begin[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(axis=1)
            jump = v[np.arange(k), best] - penalty
            better = jump[:, None] > v
            back[at] = np.where(better, best[:, None].astype(back.dtype), own)
            v = np.where(better, jump[:, None], v)
        value[:k] = v + scores[at]
    label = np.zeros(n, dtype=np.int32)
    now = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = int(active[t])
        at = begin[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return label


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("lang", pa.string())]))
RESULT = "doc_id {id}, held_out boolean, lang_pred string, score double, spans array<struct<s:int,e:int,lang:string>>"


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, with_spans: bool = True,
             with_rows: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans): spans are ranges of words (from 0, end exclusive) of one language.

    with_rows adds `doc`, the whole row of docs as a struct.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def labelled(texts: pa.Array) -> Iterator[tuple[str, float, list]]:
        m = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # scores, words of each document, word sizes

        def flush() -> Iterator[tuple[str, float, list]]:
            if not held:
                return
            scores, per_doc, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            first = np.concatenate([[0], np.cumsum(per_doc)])
            label = viterbi(scores, first, penalty)
            letters = np.zeros((len(per_doc), len(m.langs)))
            np.add.at(letters, (np.repeat(np.arange(len(per_doc)), per_doc), label), sizes)
            best = letters.argmax(axis=1)
            share = letters[np.arange(len(best)), best] / np.maximum(1, letters.sum(axis=1))
            for i in range(len(per_doc)):
                if not per_doc[i]:
                    yield UNDETERMINED, 0.0, []
                    continue
                runs: list[dict] = []
                if with_spans:
                    mine = label[first[i] : first[i + 1]]
                    turn = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1, [len(mine)]])
                    runs = [{"s": a, "e": b, "lang": m.langs[mine[a]]}
                            for a, b in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True)]
                yield m.langs[best[i]], float(share[i]), runs

        waiting = 0
        for block in T.blocks(texts):
            if not m.langs:
                yield from [(UNDETERMINED, 0.0, [])] * len(block)
                continue
            f = Features(block)
            held.append((m.word_scores(f), f.words.counts, f.sizes))
            waiting += len(f.sizes)
            if waiting >= HELD_WORDS:
                yield from flush()
                waiting = 0
        yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            pred, score, spans = [], [], []
            for i, (lang, s, runs) in enumerate(labelled(texts)):
                # words of signs only (non-ASCII punctuation) are no letters
                if s and not batch.column("ascii")[i].as_py() and not any(c.isalpha() for c in texts[i].as_py()):
                    lang, s, runs = UNDETERMINED, 0.0, []
                pred.append(lang)
                score.append(s)
                spans.append(runs)
            columns = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                       "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()),
                       "spans": pa.array(spans, SPANS)}
            if with_rows:
                columns["doc"] = batch.column("doc")
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    row = [F.struct(*docs.columns).alias("doc")] if with_rows else []
    source = docs.select(*row, "doc_id", "text", held_out().alias("held_out"),
                         F.coalesce(F.col("text").rlike("[A-Za-z]"), F.lit(False)).alias("ascii"))
    schema = RESULT.format(id=id_type) + (f", doc {source.schema['doc'].dataType.simpleString()}" if with_rows else "")
    return source.mapInArrow(giving_back(run), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out())


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op4: one row for each document."""
    docs = table(spark, folder, "documents")
    return identify(docs, learn(training_rows(docs)), with_spans=False).drop("spans")


SQL = None
