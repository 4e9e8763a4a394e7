"""Language-model scores by deleted interpolation: n-gram estimates mixed by buckets of context frequency, weights by EM."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, bucket_of, pair_hash, ship, shuffle_partitions

#: Of the crc32 of doc_id modulo FOLDS: documents that are not learned from, and learned documents whose counts EM holds out.
FOLDS, TEST, DELETED = 5, 1, 0
#: Tokens that close a block: the unit that is counted, asked for and scored at once.
BLOCK_TOKENS = 1_000_000
#: N-grams that one counting group takes (about; groups are hash ranges, so they are even).
GROUP_ENTRIES = 2_000_000
#: Context frequencies are bucketed by powers of two.
CONTEXTS = 48
#: Estimates' ratios are kept in steps of 1 / STEP in natural logs while weights are learned.
STEP = 4
EM_ROUNDS, PRIOR = 60, 2.0

#: Words never hold a space, so that these are no words.
END, START = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start"))


def squeeze(a: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def loosen(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def loosen_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(loosen(raw, "<u8"), dtype=np.uint64)


class Block:
    """Documents of one fold group as indices into the block's own words."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[b" end"]  # noqa: B018  index 0
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, fold: int, text: bytes | None) -> None:
        words = (text or b"").lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space only
        ids = np.zeros(len(words) + 1, np.int32)
        ids[:-1] = list(map(self.words.__getitem__, words))
        self.ids.append(ids)
        self.docs.append((doc_id, fold, len(ids)))
        self.tokens += len(ids)

    def row(self, number: int) -> dict:
        hashes = np.array([END, *map(xxhash.xxh64_intdigest, list(self.words)[1:])], np.uint64)
        doc, fold, n = zip(*self.docs, strict=True)
        learned = sum(k for _, f, k in self.docs if f != TEST)
        kept = sum(k for _, f, k in self.docs if f not in (TEST, DELETED))
        return {
            "block": number * 2 + (fold[0] == DELETED), "deleted": fold[0] == DELETED, "tokens": self.tokens, "learned": learned, "kept": kept,
            "starts": sum(f != TEST for f in fold), "kept_starts": sum(f not in (TEST, DELETED) for f in fold),
            "doc_id": list(doc), "fold": list(fold), "n": list(n), "hashes": squeeze(hashes), "ids": squeeze(np.concatenate(self.ids)),
        }


BLOCK_TYPE = "block long, deleted boolean, tokens long, learned long, kept long, starts long, kept_starts long, doc_id array<long>, fold array<int>, n array<long>, hashes binary, ids binary"
_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("deleted", pa.bool_()), *[(x, pa.int64()) for x in ("tokens", "learned", "kept", "starts", "kept_starts")], ("doc_id", pa.list_(pa.int64())), ("fold", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("hashes", pa.binary()), ("ids", pa.binary())]
)


class Grams:
    """What a block asks for: its distinct words and word pairs, sorted by hash, and where its tokens find them."""

    def __init__(self, row: dict):
        words, ids = loosen(row["hashes"], "<u8"), loosen(row["ids"], "<i4")
        n = np.array(row["n"], np.int64)
        self.ends = np.cumsum(n)
        fold = np.repeat(np.array(row["fold"]), n)
        order = np.argsort(words, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.one, self.one_at = words[order], place[ids]
        before = np.empty(len(ids), np.uint64)
        before[1:] = words[ids[:-1]]
        self.first = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        before[self.first] = START
        self.two, self.two_at = np.unique(pair_hash(before, words[ids]), return_inverse=True)
        kept, deleted = (fold != TEST) & (fold != DELETED), fold == DELETED
        count = lambda at, size, which: np.bincount(at[which], minlength=size).astype(np.uint32)
        self.counts = [(g, count(at, len(g), kept), count(at, len(g), deleted)) for g, at in ((self.one, self.one_at), (self.two, self.two_at))]


def _range(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Borders of the hash ranges in a sorted array."""
    at = [(i << 64) // groups for i in range(1, groups)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(at, np.uint64)), [len(hashes)]]).astype(np.int64)


def _buckets(contexts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(contexts.astype(np.float64) + 1).astype(np.int64), CONTEXTS - 1)


def learn_weights(histogram: np.ndarray) -> np.ndarray:
    """Expectation-maximisation. histogram: context bucket, log ratio of the word's and the pair's estimate to the uniform one (times STEP; below
    zero by far: none), count. Returns weights (uniform, word, pair) by bucket; PRIOR tokens a bucket follow the weights of all.
    Bucket 0 holds the contexts that were never met: they have no pair estimate, and so no weight for it."""

    def em(ratio: np.ndarray, count: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = ratio * w
            share *= (count / share.sum(1))[:, None]
            w = share.sum(0) + prior
            w /= w.sum()
        return w

    def without_pair(weights: np.ndarray) -> np.ndarray:
        weights[0, 2] = 0.0
        weights[0] /= weights[0].sum()
        return weights

    if not len(histogram):
        return without_pair(np.tile([1 / 3, 1 / 3, 1 / 3], (CONTEXTS, 1)))
    q = histogram[:, 1:3].astype(float) / STEP
    ratio = np.hstack([np.ones((len(q), 1)), np.where(histogram[:, 1:3] <= -1000, 0.0, np.exp(q))])
    count = histogram[:, 3].astype(float)
    overall = em(ratio, count, np.full(3, 0.1))
    out = np.tile(overall, (CONTEXTS, 1))
    for b in np.unique(histogram[:, 0]):
        own = histogram[:, 0] == b
        out[b] = em(ratio[own], count[own], PRIOR * overall)
    return without_pair(out)


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Words are lower-cased (A-Z) runs without ASCII white space, and each text ends with one end token. Word and word-pair counts come from all
    documents but those whose crc32 of the id is 1 modulo 5. score is the log10 probability of the text: pair estimate, word
    estimate and uniform share, mixed by the frequency of the word before (without the pair estimate where that word was never met, so that all words and one unseen word have a sum of 1); the weights are learned by EM from the counts of one
    fold of the learned documents against estimates from the others. base_score: words alone, add one half. Null and empty texts
    are an end token; very long texts are one document of a block; repeated rows come back repeated and count each; a null id counts as an empty one;
    an empty table gives an empty result; extra columns don't matter.

    Blocks of texts become sorted arrays of distinct hashes, so a frequent word costs one entry a block and no key is hot.
    Each hash range is one counting group: it sums what all blocks hold and answers every block in that block's own order.
    """
    spark = docs.sparkSession
    ship(spark)

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, open_blocks = TaskContext.get().partitionId() << 31, {True: Block(), False: Block()}
        for b in batches:
            for doc_id, fold, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                block = open_blocks[fold == DELETED]
                block.add(doc_id, fold, text)
                if block.tokens >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([block.row(number)], schema=_BLOCK_ARROW)
                    number, open_blocks[fold == DELETED] = number + 1, Block()
        for block in open_blocks.values():
            if block.docs:
                yield pa.RecordBatch.from_pylist([block.row(number)], schema=_BLOCK_ARROW)
                number += 1

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), bucket_of(id_col, FOLDS).cast("int").alias("fold"), F.col(text).cast("string").cast("binary").alias("t"))
    blocks = Stored(source.mapInArrow(blocks_of, BLOCK_TYPE), "lm-blocks").read()
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "learned", "kept", "starts", "kept_starts")]).first()
    groups = max(shuffle_partitions(spark), -(-sums.tokens // GROUP_ENTRIES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for order, (hashes, kept, deleted) in enumerate(Grams(row).counts, 1):
                    at = _range(hashes, groups)
                    rows = [(g, row["block"], order, squeeze_sorted(hashes[s:e]), squeeze(kept[s:e]), squeeze(deleted[s:e])) for g, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if s < e]
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    for i in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=["part", "block", "gram", "hashes", "kept", "deleted"])

    def answer(table: pa.Table) -> pa.Table:
        rows, out, known = table.to_pylist(), [], 0
        for order in (1, 2):
            own = [r for r in rows if r["gram"] == order]
            if not own:
                continue
            hashes = [loosen_sorted(r["hashes"]) for r in own]
            distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = [np.bincount(at, np.concatenate([loosen(r[c], "<u4") for r in own]), len(distinct)).astype(np.uint64) for c in ("kept", "deleted")]
            if order == 1:
                known = int(((totals[0] + totals[1]) > 0).sum())
            start = 0
            for r, h in zip(own, hashes, strict=True):
                place = at[start : start + len(h)]
                start += len(h)
                out.append((r["block"], order, r["part"], *(squeeze(t[place]) for t in totals), 0))
        out.append((-1, 0, rows[0]["part"], b"", b"", known))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "gram", "part", "kept", "deleted", "known"])

    asked = blocks.select("block", "fold", "n", "hashes", "ids").mapInArrow(ask, "part int, block long, gram int, hashes binary, kept binary, deleted binary")
    answers = Stored(asked.groupBy("part").applyInArrow(answer, "block long, gram int, part int, kept binary, deleted binary, known long"), "lm-counts").read()
    kinds_known = answers.where("block < 0").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    all_tokens, kept_tokens, starts, kept_starts = sums.learned, sums.kept, sums.starts, sums.kept_starts

    def counted(row: dict, replies: list[dict]) -> tuple[Grams, list[list[np.ndarray]]]:
        """The block's grams and, for words and for pairs, the counts of each in the kept and in the deleted documents."""
        grams, got = Grams(row), []
        for order in (1, 2):
            own = sorted((r for r in replies if r["gram"] == order), key=lambda r: r["part"])
            got.append([np.concatenate([loosen(r[c], "<u8") for r in own]).astype(np.int64) for c in ("kept", "deleted")])
        return grams, got

    def contexts(grams: Grams, word_counts: np.ndarray, first: int) -> np.ndarray:
        out = np.empty(len(grams.one_at), np.int64)
        out[1:] = word_counts[grams.one_at[:-1]]
        out[grams.first] = first
        return out

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            grams, (one, two) = counted(row, right.to_pylist())
            before, word, pair = contexts(grams, one[0], kept_starts), one[0][grams.one_at], two[0][grams.two_at]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratios = [np.log(x * (kinds_known + 1.0)) for x in (word / max(1, kept_tokens), np.where(before > 0, pair / before, 0.0))]
            steps = [np.where(np.isfinite(x), np.round(np.where(np.isfinite(x), x, 0) * STEP), -1000).astype(np.int64) for x in ratios]
            key, n = np.unique((_buckets(before) * 4096 + steps[0] + 1500) * 4096 + steps[1] + 1500, return_counts=True)
            parts.append(np.stack([key // 4096 // 4096, key // 4096 % 4096 - 1500, key % 4096 - 1500, n], 1))
        rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
        return pa.table([pa.array(rows[:, i], pa.int64()) for i in range(4)], names=["bucket", "word", "pair", "n"])

    needed = blocks.select("block", "deleted", "doc_id", "fold", "n", "hashes", "ids")
    replies = answers.where("block >= 0").select("block", "gram", "part", "kept", "deleted")
    tallied = needed.where("deleted").groupBy("block").cogroup(replies.where("block % 2 = 1").groupBy("block")).applyInArrow(tally, "bucket long, word long, pair long, n long")
    histogram = np.array([tuple(r) for r in tallied.groupBy("bucket", "word", "pair").agg(F.sum("n")).collect()], np.int64).reshape(-1, 4)  # quantised: bounded
    weights = learn_weights(histogram)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            grams, (one, two) = counted(row, right.to_pylist())
            words = one[0] + one[1]
            before, word, pair = contexts(grams, words, starts), words[grams.one_at], (two[0] + two[1])[grams.two_at]
            w = weights[_buckets(before)]
            p = w[:, 0] / (kinds_known + 1) + w[:, 1] * word / max(1, all_tokens) + w[:, 2] * pair / np.maximum(before, 1)
            base = np.log10((word + 0.5) / (all_tokens + 0.5 * (kinds_known + 1)))
            known, base, own = (np.add.reduceat(x, grams.first) for x in ((word > 0).astype(np.int64), base, np.log10(p)))
            out += zip(row["doc_id"], [f == TEST for f in row["fold"]], row["n"], known.tolist(), [all_tokens] * len(known), base.tolist(), own.tolist(), strict=True)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return needed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(judge, result)
