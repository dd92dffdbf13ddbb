"""Byte-level BPE over Arrow batches: ids and character offsets of whole texts, and texts of ids.

A file of ranks (a base64 token and its rank on each line) becomes a model of the tokenizers library: every byte is
written as one printable character, so tokens are strings, and the merge that makes a token is the pair left when its
bytes are merged by all lower ranks. Where every token of the file has such a pair, merging by pairs and merging by
the rank of the result give the same ids, because two neighbours whose union is a token can only be its own pair;
a file for which this does not hold is refused. A match of the split pattern that is a token itself is that token.

The model is built once on the driver and sent as text (its size is that of the rank file); a Python worker keeps it.
Texts are cut before they are encoded, only where white space follows something else: a match of the pattern ends there
whatever comes next. So each distinct word is encoded once for as long as a worker remembers it (a bound in characters),
and beside the ids the memory of a task follows its longest word, not its longest text.

Decoding reverses the byte table. A character may be split over several tokens: offsets name for each token the first
and the last character that it has a byte of, and bytes are joined over all tokens (and all pieces of a document)
before they are read as characters; bytes that are no whole character become U+FFFD.

Defined cases: null text is empty text and has no ids; null ids decode to null, an id outside the vocabulary makes its
row's text null; repeated rows are encoded each for itself; texts of any length are encoded whole; an empty table gives
no rows; other columns are ignored. There are no ties: of equal ranks the leftmost pair is merged, as in the file's
own library. Special tokens do not exist; their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import giving_back, table

#: Characters after which a text is cut at the next safe place, and characters that are encoded together.
PART_CHARS = 1 << 16
GROUP_CHARS = 1 << 18
#: Characters of words and tokens that a codec remembers before it forgets them all.
MEMORY_CHARS = 1 << 22
# The characters that the split pattern takes as white space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where white space follows anything else, a match of the split pattern ends whatever comes next.
_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
_WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_characters() -> list[str]:
    """The printable character of every byte: itself where it has one, else the next unused one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """What stands before the merge that makes the token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [ranks.get(a + b, len(ranks) << 8) for a, b in zip(parts, parts[1:])]  # noqa: B905
        least = min(joined)
        if least >= ranks[token]:
            raise ValueError(f"token {token!r} is not made of tokens of lower rank")
        i = joined.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if any(p not in ranks for p in parts):
        raise ValueError(f"token {token!r} has a byte without a rank")
    return parts[0], parts[1]


def model(path: str) -> str:
    """The rank file as a model of the tokenizers library, in its JSON form."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    shown = byte_characters()
    text = {t: "".join(shown[b] for b in t) for t in ranks}
    pairs = [last_pair(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()},
                                merges=[(text[a], text[b]) for a, b in pairs], ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made.to_str()


def _ranges(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges at..at+size of a pool, one after another."""
    end = np.cumsum(size)
    return pool[np.repeat(at - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


class Codec:
    """Encodes texts and decodes ids by a model. Words with the white space before them are encoded once and remembered."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab()
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(of[c] for c in token)
        self.size = np.array([len(t) for t in tokens] or [0], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.word_at = np.zeros(0, dtype=np.int64)
        self.word_size = np.zeros(0, dtype=np.int64)
        self.word_ids = np.zeros(0, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.word_at = np.concatenate([self.word_at, len(self.word_ids) + np.cumsum(size) - size])
        self.word_size = np.concatenate([self.word_size, size])
        self.word_ids = np.concatenate([self.word_ids, np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))])
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.held += sum(map(len, words))

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        words = [_WORD.findall(p) for p in parts]
        self._learn([w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.place])
        out = []
        for w in words:
            at = np.fromiter(map(self.place.__getitem__, w), np.int64, len(w))
            out.append(_ranges(self.word_ids, self.word_at[at], self.word_size[at]))
        if self.held > MEMORY_CHARS:
            self.forget()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group, owner, waiting = [], [], 0

        def flush() -> None:
            for i, ids in zip(owner, self._encode(group), strict=True):
                out[i].append(ids)

        for i, text in enumerate(texts):
            for part in cut(text):
                group.append(part)
                owner.append(i)
                waiting += len(part)
                if waiting >= GROUP_CHARS:
                    flush()
                    group, owner, waiting = [], [], 0
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, "<u4") for x in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, joined."""
        return _ranges(self.bytes, self.at[ids], self.size[ids]).tobytes()

    def known(self, ids: np.ndarray) -> bool:
        return not len(ids) or bool(ids.min() >= 0 and ids.max() < len(self.size) and self.size[ids].all())

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every token: the first character it has a byte of, and the one behind the last."""
        data = np.frombuffer(self.decode(ids), dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        end = np.cumsum(self.size[ids]) if len(ids) else np.zeros(0, np.int64)
        start = end - self.size[ids] if len(ids) else end
        return character[start], character[end - 1] + 1


def cut(text: str) -> Iterator[str]:
    """Parts of a text whose ids, one after another, are the ids of the text."""
    lo = 0
    while lo < len(text):
        found = _CUT.search(text, lo + PART_CHARS) if len(text) - lo > PART_CHARS else None
        hi = found.end() if found else len(text)
        yield text[lo:hi]
        lo = hi


_kept: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The codec of a model, made once in a Python worker."""
    if spec not in _kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on every core
        _kept.clear()
        _kept[spec] = Codec(spec)
    return _kept[spec]


def _by_text(docs: DataFrame, spec: str, rows, schema: str) -> DataFrame:
    """Maps rows over (codec, texts) of every batch; doc_id is carried along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(codec(spec), [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], schema=None,
                                             names=["doc_id", *(c.split()[0] for c in schema.split(", "))])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), f"doc_id {id_type}, {schema}")


def encoded(docs: DataFrame, spec: str) -> DataFrame:
    """(doc_id, ids, starts, ends): token ids of every text and the characters that each token touches."""
    def rows(c: Codec, texts: list[str]) -> list[pa.Array]:
        ids = c.encode(texts)
        places = [c.offsets(x) for x in ids]
        return [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                *(pa.array([p[k].astype(np.int32) for p in places], pa.list_(pa.int32())) for k in (0, 1))]

    return _by_text(docs, spec, rows, "ids array<int>, starts array<int>, ends array<int>")


def _plain(data: bytes | None) -> str | None:
    return None if data is None else data.decode("utf-8", errors="replace")


def _bytes_of(c: Codec, ids: pa.Array) -> list[bytes | None]:
    arrays = [None if x is None or None in x else np.array(x, dtype=np.int64) for x in ids.to_pylist()]
    return [c.decode(x) if x is not None and c.known(x) else None for x in arrays]


def decoded(rows: DataFrame, spec: str) -> DataFrame:
    """(doc_id, bytes, text) of rows with ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _bytes_of(codec(spec), batch.column("ids"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(data, pa.binary()), pa.array([_plain(x) for x in data], pa.string())],
                names=["doc_id", "bytes", "text"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, bytes binary, text string")


def decoded_pieces(pieces: DataFrame, spec: str) -> DataFrame:
    """(doc_id, text) of documents whose ids are spread over pieces (doc_id, start, ids): a character may be split
    between two pieces, so their bytes are joined in order of start before they are read. A document is one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(_bytes_of(codec(spec), batch.column("ids")), pa.binary())],
                names=["doc_id", "start", "bytes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [None if None in parts else b"".join(parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_plain(x) for x in whole], pa.string())],
                                             names=["doc_id", "text"])

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    data = pieces.select("doc_id", F.col("start").cast("long"), "ids").mapInArrow(run, f"doc_id {id_type}, start long, bytes binary")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "bytes"))), lambda p: p["bytes"])
    return data.groupBy("doc_id").agg(ordered.alias("parts")).mapInArrow(read, f"doc_id {id_type}, text string")


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    def rows(c: Codec, texts: list[str]) -> list[pa.Array]:
        n, of_ids, of_text = [], [], []
        for ids in c.encode(texts):
            n.append(len(ids))
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    return _by_text(docs, spec, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op11: one row for each document."""
    return digests(table(spark, folder, "documents"), model(public_path()))


SQL = None
