"""Cost-balanced packing of tokenised documents into training sequences of at most 4096 tokens.

Every document is tokenised and closed by an end token, then documents are taken in descending length and each is
assigned to the sequence of lowest estimated cost (linear plus quadratic in piece length, the attention cost) that
has room for it. A document longer than a sequence first gives whole sequences; one that fits nowhere is cut at the
room of the cheapest sequences. A pool of documents therefore fills floor(tokens / 4096) sequences completely, and
what is left over is packed into sequences whose lengths are powers of two, so nothing is padded.

Pools are cut from the rows of a partition as they are read (about `POOL_TOKENS` tokens each), so memory is bounded,
no text is shuffled, and a lost task repeats exactly its own sequences.

Defined cases: null text is empty text, whose document is the end token alone; repeated rows are separate documents;
equal lengths keep the order of reading; an empty table gives no pieces; very long texts become many sequences;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import text as T
from tidemark.llm.common import giving_back, table

LENGTH = 4096
END_ID = 2
POOL_TOKENS = 2_000_000
#: Estimated cost of a piece of n tokens: n + n * n / QUADRATIC_AT (equal shares at QUADRATIC_AT tokens).
QUADRATIC_AT = 2048
#: Bytes of distinct words and their ids that a Python worker remembers before it forgets them all.
MEMORY_BYTES = 32 << 20

_LETTER = T._bytes_in((0x61, 0x7A))
_SPACE = ~T.NONSPACE


class WordTokenizer:
    """Token ids of whole texts through a memory of words, equal to encoding the whole text.

    The vocabulary's rules drop white space and never join across it, lower-case everything, and end a token between
    an ASCII letter and an ASCII sign other than an apostrophe (contractions). Text is cut at these places into
    words; each distinct word is encoded once and remembered. A literal occurrence of an added token is a word of its own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        added = self.encoder.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that are not found literally are not supported")
        # of several that begin at one place the encoder takes the longest
        texts = sorted((t.content.encode() for t in added if t.content), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, texts)) or b"(?!)")
        self.forget()

    def _added(self, block: T.Block) -> list[tuple[int, int]]:
        """Byte ranges of added tokens, each inside one document."""
        data = block.raw.tobytes()
        if not self.added.search(data):
            return []
        at = block.at.tolist()
        return [m.span() for a, b in zip(at, at[1:]) for m in self.added.finditer(data, a, b)]  # noqa: B905

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, place: np.ndarray, parts: list[str]) -> None:
        """Remembers the ids of words whose rising keys belong at these places."""
        encoded = self.encoder.encode_batch_fast(parts, add_special_tokens=False)
        ids = [e.ids for e in encoded]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        new = int(size.sum())
        if self.used + new > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(new, self.used), dtype=np.uint32)])
        self.pool[self.used : self.used + new] = np.fromiter(chain.from_iterable(ids), np.uint32, new)
        at = self.used + np.cumsum(size) - size
        self.used += new
        self.keys, self.at, self.size = (np.insert(old, place, more) for old, more in
                                         ((self.keys, keys), (self.at, at), (self.size, size)))

    def encode(self, block: T.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and each document's number of ids."""
        raw = T._LOWER[block.raw]
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(block), np.int64)
        inside = ~_SPACE[raw]
        letter = _LETTER[raw]
        sign = inside & ~letter & (raw < 0x80) & (raw != 0x27)
        cut = np.zeros(n + 1, dtype=bool)  # a word may not go on across this place
        cut[1:n] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        cut[block.at] = True
        for a, b in self._added(block):
            raw[a:b] = block.raw[a:b]
            inside[a:b] = True
            cut[a : b + 1] = False
            cut[[a, b]] = True
        starts = inside & (cut[:n] | ~np.concatenate([[False], inside[:-1]]))
        ends = inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        keys = T.word_hashes(raw, start, end)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if 24 * len(self.keys) + 4 * self.used > MEMORY_BYTES:
            self.forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == distinct
        if not known.all():
            new = np.flatnonzero(~known)
            parts = [raw[a:b].tobytes().decode("utf-8") for a, b in
                     zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            self._learn(distinct[new], place[new], parts)
            place = np.searchsorted(self.keys, distinct)
        at, size = self.at[place][back], self.size[place][back]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(at - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        upto = np.concatenate([[0], total])[np.searchsorted(start, block.at)]
        return ids, np.diff(upto)


_kept: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, with its memory of words; made once in a Python worker."""
    if path not in _kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on every core
        _kept.clear()
        _kept[path] = WordTokenizer(path)
    return _kept[path]


def cost(n: np.ndarray | int) -> np.ndarray | float:
    return n + n * n / QUADRATIC_AT


def pack(lengths: np.ndarray, room: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with the given lengths, all at least 1."""
    total = int(lengths.sum())
    full = total // room
    rest = total - full * room
    capacity = [room] * full + [1 << b for b in range(room.bit_length() - 1, -1, -1) if rest >> b & 1]
    left = np.array(capacity, dtype=np.int64)
    used = left * 0
    costs = np.zeros(len(left))
    pieces = []
    opened = 0
    for doc in np.argsort(-lengths, kind="stable").tolist():
        start, n = 0, int(lengths[doc])
        while n >= room and opened < full and used[opened] == 0:
            pieces.append((doc, start, room, opened, 0))
            used[opened], left[opened], costs[opened] = room, 0, np.inf
            opened, start, n = opened + 1, start + room, n - room
        while n:
            fits = np.where(left >= n, costs, np.inf)
            seq = int(fits.argmin())
            if not np.isfinite(fits[seq]):
                seq = int(np.where(left > 0, costs, np.inf).argmin())
            size = min(n, int(left[seq]))
            pieces.append((doc, start, size, seq, int(used[seq])))
            used[seq] += size
            left[seq] -= size
            costs[seq] = costs[seq] + cost(size) if left[seq] else np.inf
            start, n = start + size, n - size
    return pieces


PIECES = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids array<int>")


def packed(docs: DataFrame, tokenizer_path: str, room: int = LENGTH, end_id: int = END_ID,
           with_ids: bool = True, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row for each piece: where it comes from, where it stands, a checksum, and its token ids if asked for."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        task = TaskContext.get().partitionId() << 33
        sequence = 0
        ids: list[np.ndarray] = []
        keys: list[pa.Array] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, ids, keys
            if not ids:
                return
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            rows = pack(lengths, room)
            doc, start, size, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            parts = [ids[d][a : a + n] for d, a, n, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start), pa.array(size),
                 pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(lengths[doc]),
                 pa.array(task + sequence + seq), pa.array(offset),
                 pa.array([x.astype(np.int32) for x in parts] if with_ids else [None] * len(parts), pa.list_(pa.int32()))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            sequence += int(seq.max()) + 1
            ids, keys = [], []

        waiting = 0
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                got, counts = encoder.encode(block)
                for part in np.split(got, np.cumsum(counts)[:-1]):
                    ids.append(np.append(part, np.uint32(end_id)).astype("<u4"))
                keys.append(batch.column("doc_id").slice(block.lo, len(block)))
                waiting += len(got) + len(block)
                if waiting >= pool_tokens:
                    yield from flush()
                    waiting = 0
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), PIECES.format(id=id_type))


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op8: one row for each piece of every document."""
    return packed(table(spark, folder, "documents"), public_path(), with_ids=False).drop("ids")


SQL = None
