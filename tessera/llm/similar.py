"""Near copies by the Jaccard similarity of word shingles: SimHash with a wide radius, bit-sliced comparison, then whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, only, pair_hash, shuffle_partitions, sized, ship, stored_alone
from tessera.llm.components import connected_components
from tessera.llm.simhash import Forest, deal, majority, near_pairs, whole_tasks

#: Differing bits of 64 up to which fingerprints of sets are looked at closely. Of sets with a similarity of 0.8, each bit differs with
#: odds of 0.152 (the angle of the sets' cosine, 0.889), so that one pair in 10^8 differs in more.
RADIUS = 28
#: Bits of the least hashes under so many permutations; each bit of sets with a similarity of 0.8 differs with odds of 0.1 at most. One pair in 10^8
#: differs in more than so many bits, and one pair in 7 million of unrelated sets in no more.
SKETCH, SKETCH_RADIUS = 128, 35
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, SKETCH, np.uint64) << np.uint64(1) | np.uint64(1)
#: Documents (in expectation, by hash) and shingles that say which shingles are frequent. This decides the order of shingles only, never the links.
ORDER_DOCUMENTS, ORDER_SHINGLES = 5_000, 300_000
#: Rounds that look at a spanning forest of candidates alone; a document's nearest candidates that the next one looks at, and by how much each one after looks at more.
FORESTS, NEAREST, MORE = 2, 8, 16


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted. Words as in fingerprints; fewer words than a shingle are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = h[:n]
    for k in range(1, min(width, len(h))):
        out = pair_hash(out, h[k : k + n])
    return np.unique(out).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of a set's least hash under each permutation, as two words."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(hashes), 256):
        np.minimum(least, (hashes[first : first + 256, None] * _FACTORS).min(0), out=least)
    least ^= least >> np.uint64(31)
    return np.packbits((least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.uint8), bitorder="little").view(np.int64)


def _sets(rows: DataFrame, text: str, width: int) -> DataFrame:
    """(node, hashes): the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 200):
                part = b.slice(first, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), width) for t in part.column(1)], pa.list_(pa.int64()))], names=["node", "hashes"])

    return rows.select("node", F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(run, "node long, hashes array<long>")


def _frequent(rows: DataFrame, text: str, width: int) -> np.ndarray:
    """Shingles that a sample of documents repeats, the most frequent last."""
    n = rows.count()
    some = rows if n <= ORDER_DOCUMENTS else rows.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * ORDER_DOCUMENTS / n))
    counts = _sets(some, text, width).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    top = counts.orderBy(F.desc("c"), "h").limit(ORDER_SHINGLES).toPandas()  # bounded by ORDER_SHINGLES
    return top["h"].to_numpy(np.int64)[::-1].copy()


def _signatures(rows: DataFrame, text: str, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(node, key, n, fp, s, t, prefix) for every row: its text's digest, how many shingles it has, their SimHash, their sketch, and the first shingles in the order rare first, of which two sets so similar share one."""
    order = np.argsort(frequent, kind="stable")
    known = frequent[order]

    def sign(text: bytes | None) -> tuple:
        h = shingle_set(text, width)
        n = len(h)
        fp, (s, t) = (majority(h.view(np.uint64)), sketch(h.view(np.uint64))) if n else (0, (0, 0))
        if n and len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            h = h[np.argsort(np.where(known[at] == h, order[at] + 1, 0), kind="stable")]
        return n, fp, s, t, h[: n + percent * n // -100 + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 200):
                part = b.slice(first, 200)
                n, fp, s, t, prefix = zip(*(sign(t.as_py()) for t in part.column(2)), strict=True)
                fps = pa.array(np.array(fp, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), fps, pa.array(s, pa.int64()), pa.array(t, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=["node", "key", "n", "fp", "s", "t", "prefix"])

    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return rows.select("node", F.unhex(F.sha2(t, 256)).alias("key"), t.alias("t")).mapInArrow(run, "node long, key binary, n int, fp long, s long, t long, prefix array<long>")


def similar_components(rows: DataFrame, text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root) for every row of rows, whose `node` (long) tells them apart: root is the smallest node that links reach.

    Rows link if the Jaccard similarity of their sets of distinct shingles is at least `similarity` (of whole percents). Texts without words
    are all alike; a text of fewer words than a shingle is one shingle; equal texts are compared once.

    Candidates: in any common order of shingles, sets of n shingles that are so similar share one of their first n - ceil(similarity * n) + 1,
    and have enough shingles left after the first they share. So the documents of a shingle are a group, and no pair is missed. Groups are compared by the
    bit planes of their fingerprints; candidates within RADIUS bits, and SKETCH_RADIUS bits of their sketches, are compared by their whole sets. What links have joined already isn't compared
    again: first each document meets two of each of its groups; then rounds look at spanning forests of the candidates that are left, then at ever more of each document's nearest ones, until none is left. Each round after the first takes only documents that had candidates left.
    """
    percent = round(100 * similarity)
    ship(rows.sparkSession)
    all_signed = Stored(_signatures(rows, text, width, percent, _frequent(rows, text, width)), "similar-signatures").read()
    texts = Stored(all_signed.groupBy("key").agg(F.min("node").alias("first")), "similar-texts").read()
    signed = all_signed.join(texts.select(F.col("first").alias("node")), "node", "left_semi")
    places = signed.select("node", F.posexplode("prefix").alias("place", "h"))
    groups = places.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    shared = places.join(groups, "h", "left_semi")
    posts = Stored(shared.join(all_signed.select("node", "n", "fp", "s", "t"), "node").select("h", "node", "n", (F.col("n") - F.col("place")).alias("rest"), "fp", "s", "t"), "similar-posts")

    partitions = shuffle_partitions(rows.sparkSession)
    with sized(rows.sparkSession, posts.read().count()):  # what follows is small beside the texts, or as large as the posts are
        roots = stored_alone(rows.sparkSession, "similar-roots", lambda: _rounds(posts.read(), signed, rows, text, width, percent, partitions))
    posts.drop()
    named = texts.join(roots, texts["first"] == roots["node"], "left").select("key", F.coalesce("root", "first").alias("root"))
    return all_signed.select("node", "key").join(named, "key").select("node", "root")


def _similar(pairs: DataFrame, rows: DataFrame, text: str, width: int, percent: int, partitions: int) -> DataFrame:
    """The pairs (u, v) whose whole sets have the similarity. Only their texts are read again."""
    need = Stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "similar-need").read()
    with sized(rows.sparkSession, 1 << 60, partitions):  # texts move if no bitmap holds their numbers
        sets = Stored(_sets(only(rows, need, "node", "similar-bits"), text, width), "similar-sets").read()
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "uv")
    same = F.size(F.array_intersect("hu", "hv"))
    return pairs.join(a, "u").join(b, "v").where(same * (100 + percent) >= (F.size("hu") + F.size("hv")) * percent).select("u", "v")


def _rounds(posts: DataFrame, signed: DataFrame, rows: DataFrame, text: str, width: int, percent: int, partitions: int) -> DataFrame:
    """(node, root) of all nodes with links. posts: (h, node, n, rest, fp, s, t), the members of groups."""

    def may_link(n: Column, m: Column, rest: Column, other: Column) -> Column:
        return F.least(rest, other) * (100 + percent) >= (n + m) * percent

    wordless = signed.where("n = 0").select("node")
    links = Stored(wordless.crossJoin(F.broadcast(wordless.agg(F.min("node").alias("v")))).select(F.col("node").alias("u"), "v"), "similar-links")  # one row is broadcast

    def learn(pairs: DataFrame, links: Stored, tested: DataFrame | None) -> tuple[Stored, DataFrame, DataFrame]:
        """Tests what is not tested yet; gives the links, all tested pairs and the components."""
        new = Stored(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "similar-pairs").read()
        found = Stored(links.read().union(_similar(new, rows, text, width, percent, partitions)), "similar-links")
        return found, new if tested is None else tested.union(new), connected_components(found.read(), "similar-components")

    # every document meets two of each of its groups: the first, and one that a hash picks
    pick = lambda *by: F.min(F.struct(*by, "node", "n", "rest", "fp", "s", "t"))
    picks = posts.groupBy("h").agg(pick().alias("p"), pick(F.xxhash64("node").alias("by")).alias("q"))
    met = posts.join(picks, "h").select("node", "n", "rest", "fp", "s", "t", F.explode(F.array("p", F.struct("q.node", "q.n", "q.rest", "q.fp", "q.s", "q.t"))).alias("p"))
    met = met.where((F.col("node") != F.col("p.node")) & may_link(F.col("n"), F.col("p.n"), F.col("rest"), F.col("p.rest")))
    apart_by = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col(f"p.{c}")))
    met = met.where((apart_by("fp") <= RADIUS) & (apart_by("s") + apart_by("t") <= SKETCH_RADIUS))
    links, tested, roots = learn(met.select(F.least("node", "p.node").alias("u"), F.greatest("node", "p.node").alias("v")).distinct(), links, None)

    turn, left = 0, None
    while True:
        nearest = NEAREST * MORE ** (turn - FORESTS) if turn >= FORESTS else 0
        now = (posts if left is None else posts.join(left, "node", "left_semi")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = now.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
        apart = Stored(now.join(mixed, "h", "left_semi"), "similar-apart")
        found = Stored(_nearest(apart.read(), percent, nearest), "similar-nearest").read()
        links, tested, roots = learn(found.where("u >= 0").distinct(), links, tested)
        apart.drop()
        left = Stored(found.where("u < 0").select(F.col("v").alias("node")).distinct(), "similar-left").read()
        if left.isEmpty():
            return roots
        turn += 1


def _nearest(posts: DataFrame, percent: int, nearest: int) -> DataFrame:
    """Candidates (u, v) of unlike roots: in each comparison those that join unlike roots, the nearest first, and each document's `nearest`; a row (-1, document) for each that has others."""
    dealt = deal(posts, ["h"], "node", "root").select("task", "side", "node", "n", "rest", "fp", "s", "t", "root")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            task, side, node, n, rest, fp, s, t, root = (c.to_numpy() for c in table.columns)
            n, rest = n.astype(np.int64), rest.astype(np.int64)
            for i, j in near_pairs(fp.view(np.uint64), task, side, RADIUS):
                unlike = root[i] != root[j]
                i, j = i[unlike], j[unlike]
                can = (np.bitwise_count((s[i] ^ s[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((t[i] ^ t[j]).view(np.uint64)) <= SKETCH_RADIUS) & (np.minimum(rest[i], rest[j]) * (100 + percent) >= (n[i] + n[j]) * percent)
                i, j = i[can], j[can]
                if not len(i):
                    continue
                apart = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)).astype(np.int64)
                row, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
                order = np.lexsort((np.tile(apart, 2), row))
                begins = np.flatnonzero(np.diff(row[order], prepend=-1))
                rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
                keep = np.zeros(len(i), bool)
                keep[pair[order[rank < nearest]]] = True
                roots, of = np.unique(np.concatenate([root[i], root[j]]), return_inverse=True)
                forest, a, b = Forest(len(roots)), of[: len(i)], of[len(i) :]
                for d in np.unique(apart):
                    own = np.flatnonzero(apart == d)
                    keep[own[forest.joining(a[own], b[own])]] = True
                u, v = node[i[keep]], node[j[keep]]
                others = np.unique(np.concatenate([node[i[~keep]], node[j[~keep]]]))
                u, v = np.append(u, np.full(len(others), -1)), np.append(v, others)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "u long, v long")
