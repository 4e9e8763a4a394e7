"""Packing along a Hilbert curve: neighbours in meaning become neighbours in a training sequence."""

from __future__ import annotations

import os
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, running_order, ship, shuffle_partitions

LENGTH = 2048
#: The id that ends each document.
END_ID = 1
BUCKETS, DIMENSIONS, BITS, SEED = 1024, 3, 13, 20_240_601
#: Texts are encoded together until they hold so many distinct words, or bytes.
DISTINCT, TOGETHER = 400_000, 32 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What simple words don't hold. They are of ASCII and precomposed Latin-1 letters, which neither composition nor lower-casing by
#: character changes otherwise than str.lower does, and hold no added token; so their parts are found without the tokenizer's own normalisation.
_ODD = re.compile("[^\\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\\|")
#: The pretokenizer's pattern on such words in lower case.
_PARTS = re.compile("\\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: What marks a part's end in the vocabulary, and the byte that stands for it here; no simple word holds that byte.
END_MARK, END_BYTE = "</w>", "\x01"


class WordEncoder:
    """Encodes distinct words, many at once: the tokenizer splits at white space, so that the ids of a text are those of its words.

    Simple words go through a byte-pair encoder over the same vocabulary in which the mark of a part's end is a byte of its own: its merges
    with a part's last byte come before all others, as in the tokenizer, whose first symbols hold the mark. All other words go through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids need more than two bytes")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte_of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(sorted({*range(256)}.difference(plain)))}
        ranks = {}
        for token, i in vocabulary.items():
            ends = token.endswith(END_MARK)
            ranks[bytes(map(byte_of.__getitem__, token[: -len(END_MARK)] if ends else token)) + END_BYTE.encode() * ends] = i
        self.line = ranks[b"\n" + END_BYTE.encode()]
        self.parse = tiktoken.Encoding("words", pat_str=f"[^{END_BYTE}]+{END_BYTE}", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        probe = "The 2nd WORD's \u00e9t\u00c9, n\u00f1-x** it'll".split()
        self.simple = all((a == b).all() for a, b in zip(self._simple(probe), self._whole(probe), strict=True))  # else the file holds another kind of tokenizer

    def _simple(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        ids = self.parse(END_BYTE.join(_PARTS.findall("\n".join([*words, ""]).lower())) + END_BYTE) if words else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.line)
        return ids[ids != self.line].astype("<u2"), np.diff(ends, prepend=-1) - 1

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), "<u2"), np.array(list(map(len, ids)), np.int64)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of UTF-8 words one behind the other in any order; where each word's begin, and how many it has."""
        joined = b"\n".join(words).decode()
        texts = joined.split("\n") if words else []
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        is_odd = np.full(len(words), not self.simple)
        is_odd[np.searchsorted(ends, [m.start() for m in _ODD.finditer(joined)], "right")] = True
        odd, order = np.flatnonzero(is_odd).tolist(), np.argsort(is_odd, kind="stable")
        (ids, n), (more, m) = self._simple([w for w, x in zip(texts, is_odd.tolist(), strict=True) if not x] if odd else texts), self._whole([texts[k] for k in odd])
        n = np.concatenate([n, m])
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[order], size[order] = np.cumsum(n) - n, n
        return np.concatenate([ids, more]), start, size

    def encode(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For ever so many texts in turn: their ids one behind the other, and how many each text has. Memory holds the words of one turn alone."""
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        held, size = [], 0

        def turn() -> tuple[np.ndarray, np.ndarray]:
            ids, start, n = self.words(list(index))
            at = np.concatenate(held)
            counts = n[at]
            ends = np.cumsum(counts)
            out = ids[np.repeat(start[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
            before = np.concatenate([[0], ends])
            return out, np.diff(before[np.cumsum([0, *map(len, held)])])

        for t in texts:
            words = t.split()  # bytes: ASCII white space
            held.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            size += len(t)
            if len(index) >= DISTINCT or size >= TOGETHER:
                yield turn()
                index.clear()
                held, size = [], 0
        if held:
            yield turn()


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def _projection(vocabulary: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each id (a multiplicative hash) and the direction of each bucket."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    bucket = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64) % BUCKETS
    return bucket, np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))


def document_points(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each document the hashed, root-scaled, unit-length count vector of its ids, projected to a few dimensions. ids: of all documents, n each."""
    bucket, directions = _projection()
    out, ends = np.empty((len(n), DIMENSIONS)), np.cumsum(n)
    for first in range(0, len(n), 256):
        last = min(first + 256, len(n))
        own = ids[ends[first] - n[first] : ends[last - 1]]
        of = np.repeat(np.arange(last - first) * BUCKETS, n[first:last])
        v = np.sqrt(np.bincount(of + bucket[own], minlength=(last - first) * BUCKETS).reshape(-1, BUCKETS))
        out[first:last] = v @ directions / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    return out


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each point on the Hilbert curve. points: any reals; a logistic map takes them to the cube."""
    n = points.shape[1]
    x = np.minimum((1 / (1 + np.exp(-1.7 * points)) * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    # axes to transposed index: undo the rotations from the highest bit down, then Gray code
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of `length` tokens: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    ids: the piece's ids as little-endian unsigned 32-bit numbers. Documents lie one behind the other in the order of their Hilbert
    keys (ties: doc_id, then place in the input) and are cut wherever a sequence is full, so only the last sequence is shorter.
    A null or empty text is its end id alone; repeated rows are packed each; a null doc_id stays null; an empty table gives
    no pieces; very long texts are cut into as many pieces as they need; extra columns don't matter.

    Texts are read and encoded once. Ids wait as two bytes each in the shared folder; only (key, row, count) is
    sorted, and running sums per range partition give every document its place without a single-task window.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, docs_read = TaskContext.get().partitionId() << 36, deque()

        def texts() -> Iterator[bytes]:
            for b in batches:
                docs_read.extend(b.column(0).to_pylist())
                for t in b.column(1):
                    yield t.as_py() or b""

        for ids, n in _encoder(path).encode(texts()):
            ends = np.cumsum(n + 1)
            ids = np.insert(ids, ends - np.arange(1, len(n) + 1), END_ID)
            key = hilbert_key(document_points(ids, n + 1))
            of = [docs_read.popleft() for _ in range(len(n))]
            for first in range(0, len(n), 500):
                last = min(first + 500, len(n))
                begin = int(ends[first] - n[first] - 1)
                offsets = np.concatenate([[0], ends[first:last] - begin]).astype(np.int32) * 2
                raw = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(offsets), pa.py_buffer(ids[begin : ends[last - 1]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row + first, row + last)), pa.array(of[first:last], pa.int64()), pa.array(key[first:last]), pa.array(n[first:last] + 1), raw], names=["row", "doc_id", "key", "n", "ids"])
            row += len(n)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    encoded = Stored(source.mapInArrow(encode, "row long, doc_id long, key long, n long, ids binary"), "packing-ids").read()
    places, _ = running_order(encoded.select("key", "doc_id", "row", "n"), ["key", "doc_id", "row"], "n", shuffle_partitions(spark), "packing-order")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for b in batches:
            out: list[tuple] = []
            for doc, n, pos, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids, at = np.frombuffer(raw, "<u2"), 0
                while at < n:
                    sequence, offset = divmod(pos + at, length)
                    size = min(n - at, length - offset)
                    out.append((doc, at, size, n, sequence, offset, ids[at : at + size].astype("<u4").tobytes()))
                    at += size
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    joined = encoded.select("row", "doc_id", "n", "ids").join(places.select("row", "pos"), "row").select("doc_id", "n", "pos", "ids")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
