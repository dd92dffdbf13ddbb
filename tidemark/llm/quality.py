"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Two properties are judged: `fit` (prose rather than junk) and `toxic`. For each,

1. overlapping heuristic labellers vote yes, no or abstain on every document; the labels table votes where it has a row;
2. votes are counted by pattern over all documents, and EM over the patterns (a few hundred at most, whatever the
   size of the corpus) estimates each labeller's accuracy and the posterior of every pattern;
3. a linear scorer over hashed words and style figures is trained on posteriors of a bounded sample
   (`SAMPLE` documents with the least key hashes and as many with a labels row), and scores every document.

Words of abuse in any language are learnt: those far more frequent in documents labelled toxic than in others (Spark
counts over all labelled documents); a labelled document is left out of the counts by which it is judged itself. Word
labellers that find nothing abstain.

A document's quality is P(fit) * (1 - P(toxic)), each probability the mean of posterior and scorer; where all labellers
of toxicity abstain the scorer alone decides. It is kept from 0.5.

Defined cases: null text is empty text: no words, all style labellers vote against it or abstain, and it is scored like
any other; repeated rows get one row each with equal values; several labels rows of a doc_id count by their minimum
quality and maximum toxic; a null doc_id has no labels; without labels the heuristics alone decide; texts of any length are
scored whole; equal posteriors need no order, a document at exactly 0.5 is kept; the sample is of the smallest content
keys, each once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.common import bounded, content_key, table

SLOTS = 1 << 16
#: Documents in each half of the training sample.
SAMPLE = 3000
#: Words whose use against a reader marks abuse (fixed values).
ABUSE = ("clown", "disgusting", "dumb", "filthy", "garbage", "hate", "idiot", "imbecile", "loser", "moron", "pathetic",
         "scum", "stupid", "trash", "ugly", "vermin", "worthless")
STYLE = ("signs", "capitals", "bars", "exclaims", "word_length", "short_words", "words", "repeated_words", "abuse", "abuse_kinds",
         "sign_runs", "marks", "echoes")
FIT = ("echoes", "signs", "sign_runs", "marks", "capitals", "bars", "shouting", "usual_words", "function_words", "length", "varied", "labels")
TOXIC = ("any_abuse", "several_abuses", "dense_abuse", "learnt_word", "learnt_words", "labels")
#: A learnt word is in so many toxic documents at least, and so many times as frequent there as in others.
LEARNT_DOCUMENTS = 3
LEARNT_RATIO = 16
_ALPHA = T._bytes_in((0x61, 0x7A), (0x80, 0xFF))
_SIGN = ~T._bytes_in((0x09, 0x0D), (0x20, 0x20), (0x2C, 0x2E), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Style:
    """Style figures of each document of a block (columns as in STYLE), and hashed distinct words."""

    values: np.ndarray
    slots: np.ndarray
    at: np.ndarray
    words: np.ndarray  # hashes, as slots


def _abuse_hashes() -> np.ndarray:
    (block,) = T.blocks(pa.array([" ".join(ABUSE)]))
    return np.sort(T.words(block, T.ALNUM, lower=True).hashes())


_ABUSE = _abuse_hashes()


def style(block: T.Block) -> Style:
    n = len(block)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[block.at[1:]] - sums[block.at[:-1]]).astype(np.float64)

    size = np.maximum(1, np.diff(block.at)).astype(np.float64)
    w = T.words(block, T.ALNUM, lower=True)
    counts = w.counts.astype(np.float64)
    some = np.maximum(1, counts)
    h = w.hashes()
    doc = w.doc()
    lengths = (w.end - w.start).astype(np.float64)

    def word_sum(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=n)

    signs = _SIGN[block.raw]
    runs = np.zeros(len(signs), dtype=bool)
    runs[1:] = signs[1:] & signs[:-1]
    runs[block.at[:-1][np.diff(block.at) > 0]] = False
    capitals = per_doc((block.raw >= 0x41) & (block.raw <= 0x5A))
    letters = np.maximum(1, per_doc(_ALPHA[block.raw]) + capitals)
    echo = np.zeros(len(h), dtype=bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct_doc, distinct = doc[order][first], h[order][first]
    found = _ABUSE[np.minimum(np.searchsorted(_ABUSE, h), len(_ABUSE) - 1)] == h
    kinds = _ABUSE[np.minimum(np.searchsorted(_ABUSE, distinct), len(_ABUSE) - 1)] == distinct
    values = np.stack([
        per_doc(signs) / size, capitals / letters, per_doc(block.raw == 0x7C) / some, per_doc(block.raw == 0x21) / some,
        word_sum(lengths) / some, word_sum(lengths <= 3) / some, np.log1p(counts),
        1 - np.bincount(distinct_doc, minlength=n) / some, word_sum(found), np.bincount(distinct_doc[kinds], minlength=n),
        per_doc(runs) / some, per_doc(signs) / some, word_sum(echo) / some,
    ], axis=1)
    return Style(values, (distinct >> np.uint64(48)).astype(np.int32), np.searchsorted(distinct_doc, np.arange(n + 1)), distinct)


@dataclass
class ToxicWords:
    """Learnt words in order, their numbers of toxic and other labelled documents, and how many there are of these."""

    words: np.ndarray
    toxic: np.ndarray
    other: np.ndarray
    documents: tuple[int, int]

    def hits(self, s: Style, label: np.ndarray) -> np.ndarray:
        """Learnt words in each document, by the counts without it; label: 1 toxic, 0 other, -1 none."""
        n = len(s.at) - 1
        doc = np.repeat(np.arange(n), np.diff(s.at))
        if not len(self.words):
            return np.zeros(n, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, s.words), len(self.words) - 1)
        found = self.words[at] == s.words
        doc, at = doc[found], at[found]
        mine, own = label[doc] == 1, label[doc] == 0
        toxic, other = self.toxic[at] - mine, self.other[at] - own
        enough = (toxic >= LEARNT_DOCUMENTS) & (
            (toxic + 0.5) * (self.documents[1] - own + 1) >= LEARNT_RATIO * (other + 0.5) * (self.documents[0] - mine + 1))
        return np.bincount(doc[enough], minlength=n)


def toxic_words(rows: DataFrame) -> ToxicWords:
    """All words that some document may count as learnt."""
    known = rows.where("toxic >= 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy()
            for block in T.blocks(batch.column("text")):
                s = style(block)
                bad = np.repeat(label[block.lo : block.hi] == 1, np.diff(s.at))
                words, at = np.unique(s.words, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(words)), *(pa.array(np.bincount(at[x], minlength=len(words))) for x in (bad, ~bad))],
                    names=["word", "n_toxic", "n_other"])

    n = known.agg(*(F.coalesce(F.sum((F.col("toxic") == x).cast("long")), F.lit(0)) for x in (1, 0))).first()
    # the bounds of ToxicWords.hits for a document of the other kind, which is left out of n_other
    got = known.select("text", "toxic").mapInArrow(count, "word long, n_toxic long, n_other long").groupBy("word").agg(
        F.sum("n_toxic").alias("t"), F.sum("n_other").alias("o")).where(
        (F.col("t") >= LEARNT_DOCUMENTS)
        & ((F.col("t") + 0.5) * F.lit(n[1] + 1) >= LEARNT_RATIO * (F.greatest(F.col("o") - 1, F.lit(0)) + 0.5) * F.lit(n[0]))).toArrow()
    words = got["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return ToxicWords(words[order], got["t"].to_numpy()[order], got["o"].to_numpy()[order], (n[0], n[1]))


def votes(s: np.ndarray, quality: np.ndarray, toxic: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (0 no, 1 yes, 2 abstain) of all labellers of FIT and TOXIC; quality and toxic: -1 where there is no label; learnt: learnt words."""
    signs, capitals, bars, exclaims, length, short, words, repeated, abuse, kinds, runs, marks, echoes = s.T
    never = np.zeros(len(s), dtype=bool)

    def vote(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        return np.where(yes, 1, np.where(no, 0, 2))

    known = np.where(quality < 0, 2, quality)
    # detectors of one kind of junk vote no or abstain; judges of prose vote both ways
    fit = np.stack([
        vote(never, echoes > 0.2), vote(never, signs > 0.08), vote(never, runs > 0.2), vote(never, marks > 0.5), vote(never, capitals > 0.4),
        vote(never, bars > 0.1), vote(never, exclaims > 0.15), vote((length > 3) & (length < 8), (length < 1.5) | (length > 14)),
        vote(short > 0.15, short < 0.01), vote(words > np.log1p(50), never), vote(repeated < 0.6, repeated > 0.9), known,
    ], axis=1)
    bad = np.stack([
        vote(abuse > 0, never), vote(kinds > 1, never), vote(abuse > 0.01 * np.expm1(words), never),
        vote(learnt > 0, never), vote(learnt > 2, never),
        np.where(toxic < 0, 2, toxic)], axis=1)
    return fit, bad


@dataclass
class LabelModel:
    """Class share and, for each labeller, P(vote | class); from counts of vote patterns."""

    share: np.ndarray
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(yes) of rows of votes."""
        like = np.log(self.share)[None, :] + sum(np.log(self.table[k][:, patterns[:, k]]).T for k in range(patterns.shape[1]))
        like -= like.max(axis=1, keepdims=True)
        p = np.exp(like)
        return p[:, 1] / p.sum(axis=1)


def _starts_fit(patterns: np.ndarray) -> np.ndarray:
    """Fit unless a labeller objects."""
    return np.where((patterns == 0).any(axis=1), 0.15, 0.95)


def _starts_toxic(patterns: np.ndarray) -> np.ndarray:
    """Toxic if a labeller says so."""
    return np.where((patterns == 1).any(axis=1), 0.85, 0.05)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, p: np.ndarray, rounds: int = 200,
                             tolerance: float = 1e-7) -> LabelModel:
    """From starting posteriors p of the patterns; a little prior weight keeps labellers better than chance."""
    prior = np.full((patterns.shape[1], 2, 3), 1.0)
    prior[:, 0, 0] = prior[:, 1, 1] = 8.0
    model = None
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        table_ = prior.copy()
        for k in range(patterns.shape[1]):
            for c in (0, 1):
                table_[k, c] += np.bincount(patterns[:, k], weights=weight[c], minlength=3)
        table_ /= table_.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        model = LabelModel(share, table_)
        q = model.posterior(patterns)
        moved, p = np.abs(q - p).max(initial=0.0), q
        if moved < tolerance:
            break
    return model


@dataclass
class Scorer:
    weights: np.ndarray  # of the slots, then of the style figures, then the constant
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, s: Style) -> np.ndarray:
        n = len(s.values)
        doc = np.repeat(np.arange(n), np.diff(s.at))
        words = np.bincount(doc, weights=self.weights[s.slots], minlength=n) / np.sqrt(np.maximum(1, np.diff(s.at)))
        return words + ((s.values - self.mean) / self.scale) @ self.weights[SLOTS:-1] + self.weights[-1]


def train_scorer(s: Style, target: np.ndarray, epochs: int = 300, rate: float = 1.0, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by full gradients with per-weight steps."""
    model = Scorer(np.zeros(SLOTS + len(STYLE) + 1), s.values.mean(axis=0), s.values.std(axis=0) + 1e-6)
    n = len(target)
    doc = np.repeat(np.arange(n), np.diff(s.at))
    each = (1 / np.sqrt(np.maximum(1, np.diff(s.at))))[doc]
    scaled = (s.values - model.mean) / model.scale
    seen = np.full(len(model.weights), 1e-8)
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-np.clip(model.logit(s), -30, 30))) - target
        grad = np.concatenate([np.bincount(s.slots, weights=error[doc] * each, minlength=SLOTS), scaled.T @ error, [error.sum()]]) / n
        grad += decay * model.weights
        seen += grad * grad
        model.weights -= rate * grad / np.sqrt(seen) * 0.1
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, key, quality, toxic) with -1 where there is no label."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    none = F.lit(-1)
    return docs.select("doc_id", "text", content_key().alias("key")).join(bounded(known, labels.count()), "doc_id", "left").select(
        "doc_id", "text", "key", F.coalesce(F.col("quality").cast("int"), none).alias("quality"),
        F.coalesce(F.col("toxic").cast("int"), none).alias("toxic"))


def _known(batch: pa.RecordBatch, block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy()[block.lo : block.hi] for c in ("quality", "toxic"))


def vote_patterns(rows: DataFrame, lexicon: ToxicWords) -> DataFrame:
    """(kind, votes, n): number of documents with each combination of votes."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = {}
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                s, known = style(block), _known(batch, block)
                for kind, v in zip(("fit", "toxic"), votes(s.values, *known, shared.value.hits(s, known[1])), strict=True):
                    patterns, n = np.unique(v, axis=0, return_counts=True)
                    for row, k in zip(patterns, n.tolist(), strict=True):
                        key = (kind, "".join(map(str, row)))
                        sums[key] = sums.get(key, 0) + k
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in sums], pa.string()), pa.array([v for _, v in sums], pa.string()),
             pa.array(list(sums.values()), pa.int64())], names=["kind", "votes", "n"])

    return rows.select("text", "quality", "toxic").mapInArrow(run, "kind string, votes string, n long").groupBy(
        "kind", "votes").agg(F.sum("n").alias("n"))


@dataclass
class QualityModel:
    fit: LabelModel
    toxic: LabelModel
    fit_scorer: Scorer
    toxic_scorer: Scorer
    lexicon: ToxicWords


def _first(rows: DataFrame, sample: int) -> DataFrame:
    """The rows of the smallest keys, each key once: the keys are chosen without their texts."""
    keys = rows.select("key").distinct().orderBy("key").limit(sample)
    return rows.join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(
        *(F.first(c).alias(c) for c in rows.columns if c != "key")).select(*rows.columns)


def train(rows: DataFrame, sample: int = SAMPLE) -> QualityModel:
    lexicon = toxic_words(rows)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    got = vote_patterns(rows, lexicon).toArrow().to_pandas()
    models = []
    for kind, width, start in (("fit", len(FIT), _starts_fit), ("toxic", len(TOXIC), _starts_toxic)):
        some = got[got["kind"] == kind]
        patterns = np.array([list(map(int, v)) for v in some["votes"]], dtype=np.int64).reshape(-1, width)
        models.append(expectation_maximisation(patterns, some["n"].to_numpy(dtype=np.float64), start(patterns)))
    chosen = _first(rows, sample).union(_first(rows.where("quality >= 0"), sample))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                s = style(block)
                parts = [s.slots[s.at[i] : s.at[i + 1]] for i in range(len(block))]
                q, t = _known(batch, block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(list(s.values), pa.list_(pa.float64())),
                     pa.array(q), pa.array(t), pa.array(shared.value.hits(s, t))], names=["slots", "style", "quality", "toxic", "learnt"])

    # text of the sample stays on the executors; the driver gets its features
    data = chosen.select("text", "quality", "toxic").mapInArrow(
        featured, "slots binary, style array<double>, quality int, toxic int, learnt long").toArrow()
    parts = [np.frombuffer(x, dtype=np.int32) for x in data["slots"].to_pylist()]
    s = Style(np.array(data["style"].to_pylist(), dtype=np.float64).reshape(-1, len(STYLE)),
              np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64),
              np.zeros(0, np.uint64))
    if not len(parts):
        s.values = np.zeros((1, len(STYLE)))
        s.at = np.zeros(2, dtype=np.int64)
        v = votes(s.values, np.array([-1]), np.array([-1]), np.array([0]))
    else:
        v = votes(s.values, data["quality"].to_numpy(), data["toxic"].to_numpy(), data["learnt"].to_numpy())
    scorers = [train_scorer(s, m.posterior(x)) for m, x in zip(models, v, strict=True)]
    return QualityModel(*models, *scorers, lexicon)


def scored(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, fit_posterior, fit_score, toxic_posterior, toxic_score, quality, kept) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["fit_posterior", "fit_score", "toxic_posterior", "toxic_score", "quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                s = style(block)
                known = _known(batch, block)
                fit, toxic = votes(s.values, *known, m.lexicon.hits(s, known[1]))
                sides = []
                for x, labels, scorer in ((fit, m.fit, m.fit_scorer), (toxic, m.toxic, m.toxic_scorer)):
                    sides += [labels.posterior(x), 1 / (1 + np.exp(-np.clip(scorer.logit(s), -30, 30)))]
                toxicity = np.where((toxic == 2).all(axis=1), sides[3], (sides[2] + sides[3]) / 2)
                quality = (sides[0] + sides[1]) / 2 * (1 - toxicity)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.lo, len(block)), *(pa.array(x) for x in [*sides, quality]), pa.array(quality >= 0.5)],
                    names=["doc_id", *names, "kept"])

    return rows.select("doc_id", "text", "quality", "toxic").mapInArrow(
        run, f"doc_id {id_type}, {', '.join(f'{x} double' for x in names)}, kept boolean")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op7: one row for each document."""
    rows = labelled(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored(rows, train(rows))


SQL = None
