"""Embedding near-duplicates: an exact epsilon grid order join on cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, ship, shuffle_partitions
from tessera.llm.components import connected_components
from tessera.llm.simhash import Forest

SIMILARITY = 0.95
#: Vectors in one block (a sequence interval that travels as one row) and in a leaf of the recursion. A block travels once for each block it may link with, so large ones travel less.
BLOCK, LEAF = 8192, 512
#: Principal dimensions that make the grid order, that boxes are kept for, and that blocks are matched by.
ORDER_DIMENSIONS, BOX_DIMENSIONS, MATCH_DIMENSIONS = 6, 16, 2
#: Vectors that principal dimensions are taken from at most (they only steer the pruning, never the result).
PCA_SAMPLE = 50_000


def _valid(v: list | None) -> bytes | None:
    """The vector scaled by a power of two, which changes no cosine, so that its norm neither over- nor underflows; None if it is null, empty, zero or holds null
    or non-finite components. Four bytes a component if they hold all of it, else eight, after a byte that tells."""
    if not v or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    most = np.abs(a).max()
    if not np.isfinite(a).all() or most == 0:
        return None
    a = np.ldexp(a, -int(np.frexp(most)[1])) + 0.0  # no negative zero
    short = a.astype("<f4")
    return b"4" + short.tobytes() if (short == a).all() else b"8" + a.astype("<f8").tobytes()


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if raw[:1] == b"4" else "<f8", offset=1).astype(np.float64)


def _length(raw: bytes) -> int:
    return (len(raw) - 1) // (4 if raw[:1] == b"4" else 8)


def _directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, orthonormal principal dimensions (as columns), from a bounded sample, which is stored before it is summed."""
    n = vectors.count()
    part = vectors if n <= PCA_SAMPLE else vectors.where(F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * PCA_SAMPLE / n))
    sample = Stored(part.select("vec"), "vector-sample")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            own: dict[int, list] = {}
            for raw in b.column(0).to_pylist():
                own.setdefault(_length(raw), []).append(_vector(raw))
            for d, rows in own.items():
                a = np.array(rows)
                a /= np.linalg.norm(a, axis=1)[:, None]
                t = total.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
                total[d] = [t[0] + len(a), t[1] + a.sum(0), t[2] + a.T @ a]
        rows = [(d, t[0], t[1].tobytes(), t[2].tobytes()) for d, t in total.items()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["d", "n", "s", "m"])

    out: dict[int, list] = {}
    for r in sample.read().coalesce(8).mapInArrow(sums, "d long, n long, s binary, m binary").collect():  # 8 tasks over the sample, a matrix each
        t = out.setdefault(r.d, [0, 0.0, 0.0])
        t[0] += r.n
        t[1] = t[1] + np.frombuffer(r.s)
        t[2] = t[2] + np.frombuffer(r.m).reshape(r.d, r.d)
    sample.drop()
    return {d: np.linalg.eigh(t[2] / t[0] - np.outer(t[1], t[1]) / t[0] ** 2)[1][:, ::-1][:, :BOX_DIMENSIONS].copy() for d, t in out.items()}


class Interval:
    """A block's vectors with their coordinates on the principal dimensions, in grid order."""

    def __init__(self, exact: np.ndarray, p: np.ndarray | None):
        self.exact = exact
        self.norm = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        unit = exact / self.norm[:, None]
        self.at = unit @ (np.eye(exact.shape[1])[:, :BOX_DIMENSIONS] if p is None else p)
        self.unit = unit.astype(np.float32)

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at[a:b].min(0), self.at[a:b].max(0)


def _block(raw: bytes, wide: bool, d: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if wide else "<f4").reshape(-1, d).astype(np.float64)


def _apart(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Squared distance of two boxes: no two of their vectors are nearer."""
    gap = np.maximum(0, np.maximum(x[0] - y[1], y[0] - x[1]))
    return float(gap @ gap)


def linked(a: Interval, b: Interval, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all vectors of a and of b with a cosine of `least` or more, in parts; of one interval with itself, each pair once.

    Recursive: both intervals are halved, and halves that are provably too far apart are skipped.
    """
    reach, same = 2 - 2 * least + 1e-6, a is b
    boxes: dict[tuple[bool, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(of_b: bool, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (of_b, i, j) not in boxes:
            boxes[of_b, i, j] = (b if of_b else a).box(i, j)
        return boxes[of_b, i, j]

    def join(i: int, j: int, k: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if same and m <= i or _apart(box(False, i, j), box(True, k, m)) > reach:
            return
        if j - i <= LEAF and m - k <= LEAF:
            near = a.unit[i:j] @ b.unit[k:m].T
            x, y = np.nonzero(near >= least - 1e-4)
            sure = near[x, y] >= least + 1e-4
            if not sure.all():  # single precision can't tell: double decides
                s, t = i + x[~sure], k + y[~sure]
                sure[~sure] = np.einsum("ij,ij->i", a.exact[s], b.exact[t]) / (a.norm[s] * b.norm[t]) >= least
            x, y = i + x[sure], k + y[sure]
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
        elif j - i >= m - k:
            yield from join(i, (i + j) // 2, k, m)
            yield from join((i + j) // 2, j, k, m)
        else:
            yield from join(i, j, k, (k + m) // 2)
            yield from join(i, j, (k + m) // 2, m)

    yield from join(0, len(a.unit), 0, len(b.unit))


def near_duplicates(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", least: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors link if their cosine, in double precision, is `least` or more; only vectors of equal length can. n_links counts other rows
    linked directly; component_id is the smallest vec_id that links reach; kept: vec_id = component_id. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Equal vectors are compared once and counted with their number. Repeated rows are
    vectors of their own; a null vec_id becomes a component_id only if its whole component has none, and is kept then; an empty table gives an empty
    result; extra columns don't matter.
    """
    spark = vectors.sparkSession
    ship(spark)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_valid(v) for v in b.column(1).to_pylist()], pa.binary())], names=["vec_id", "vec"])

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    checked = Stored(source.mapInArrow(check, "vec_id long, vec binary").withColumn("uid", F.sha2("vec", 256)), "vectors").read()
    distinct = checked.where("vec is not null").groupBy("uid").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("vec").alias("vec"))
    distinct = Stored(distinct, "distinct-vectors").read()
    principal = _directions(distinct)
    side = math.sqrt(max(2 - 2 * least, 1e-12))
    members_type = "array<struct<node:long,uid:string,least:long,many:long>>"

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for raw in b.column(3).to_pylist():
                a = _vector(raw)
                p = principal.get(len(a))
                at = (a if p is None else a @ p)[:ORDER_DIMENSIONS] / np.linalg.norm(a)
                cell = np.clip(np.floor(at / side), -2000, 2000).astype(int) + 2000
                keys.append([len(a), *cell.tolist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int32()))], names=["uid", "least", "many", "vec", "cells"])

    placed = Stored(distinct.select("uid", "least", "many", "vec").mapInArrow(coordinates, "uid string, least long, many long, vec binary, cells array<int>"), "placed-vectors").read()
    ordered = placed.repartitionByRange(shuffle_partitions(spark), "cells", "uid").sortWithinPartitions("cells", "uid")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def made() -> pa.RecordBatch:
            nonlocal number, held
            vectors, d = np.array([_vector(r["vec"]) for r in held]), held[0]["cells"][0]
            wide = any(r["vec"][:1] == b"8" for r in held)
            raw = vectors.astype("<f8" if wide else "<f4").tobytes()
            lo, hi = Interval(vectors, principal.get(d)).box(0, len(held))
            members = [{"node": number * BLOCK + i, "uid": r["uid"], "least": r["least"], "many": r["many"]} for i, r in enumerate(held)]
            member = pa.struct([("node", pa.int64()), ("uid", pa.string()), ("least", pa.int64()), ("many", pa.int64())])
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([d], pa.int64()), pa.array([lo.tolist()]), pa.array([hi.tolist()]), pa.array([members], pa.list_(member)), pa.array([wide]), pa.array([raw], pa.binary())], names=["block", "d", "lo", "hi", "members", "wide", "vecs"])
            number, held = number + 1, []
            return out

        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) == BLOCK or held[0]["cells"][0] != r["cells"][0]):
                    yield made()
                held.append(r)
        if held:
            yield made()

    blocks = Stored(ordered.mapInArrow(block, f"block long, d long, lo array<double>, hi array<double>, members {members_type}, wide boolean, vecs binary"), "vector-blocks").read()

    # blocks that may hold links: they share a cell of the coarse grid or lie in neighbouring cells, and their boxes are near
    cells = lambda k, wide: F.sequence(F.floor(F.element_at("lo", k) / side) - wide, F.floor(F.element_at("hi", k) / side) + wide)
    dims = [k for k in range(1, MATCH_DIMENSIONS + 1) if all(len(principal[d].T) >= k for d in principal)]

    def spread(wide: int, name: str) -> DataFrame:
        out = blocks.select(F.col("block").alias(name), "d", F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"), *[cells(k, wide).alias(f"c{k}") for k in dims])
        for k in dims:
            out = out.withColumn(f"{name}{k}", F.element_at(f"c{k}", 1)).withColumn(f"c{k}", F.explode(f"c{k}"))
        return out

    gap = F.zip_with(F.zip_with("a_lo", "b_hi", lambda x, y: x - y), F.zip_with("b_lo", "a_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    met = spread(1, "a").join(spread(0, "b"), ["d", *[f"c{k}" for k in dims]]).where("a <= b")
    for k in dims:  # of the cells that a pair shares, the first
        met = met.where(F.col(f"c{k}") == F.greatest(f"a{k}", f"b{k}"))
    pairs = met.where(apart <= 2 - 2 * least + 1e-6).select("a", "b")
    own = blocks.select("block", "d", F.transform("members", lambda m: m["many"]).alias("many"), "wide", "vecs")
    first = own.select(F.col("block").alias("a"), "d", F.col("many").alias("a_many"), F.col("wide").alias("a_wide"), F.col("vecs").alias("a_vecs"))
    second = own.select(F.col("block").alias("b"), F.col("many").alias("b_many"), F.col("wide").alias("b_wide"), F.col("vecs").alias("b_vecs"))
    tasks = pairs.join(first, "a").join(second, "b").select("a", "b", "d", "a_many", "b_many", "a_wide", "b_wide", "a_vecs", "b_vecs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                p, one = principal.get(r["d"]), r["a"] == r["b"]
                x = Interval(_block(r["a_vecs"], r["a_wide"], r["d"]), p)
                y = x if one else Interval(_block(r["b_vecs"], r["b_wide"], r["d"]), p)
                # rows: the vectors of a, then those of b
                n, after = len(x.unit), 0 if one else len(x.unit)
                node = r["a"] * BLOCK + np.arange(n)
                node, many = (node, np.array(r["a_many"])) if one else (np.append(node, r["b"] * BLOCK + np.arange(len(y.unit))), np.array(r["a_many"] + r["b_many"]))
                counts, forest, us, vs = np.zeros(len(node), np.int64), Forest(len(node)), [], []
                for i, j in linked(x, y, least):
                    j = j + after
                    counts += np.bincount(i, many[j], len(node)).astype(np.int64) + np.bincount(j, many[i], len(node)).astype(np.int64)
                    u, v = forest.add(i, j)
                    us.append(node[u])
                    vs.append(node[v])
                some = counts > 0
                u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(node[some], u)), pa.array(np.append(np.full(some.sum(), -1), v)), pa.array(np.append(counts[some], np.zeros(len(u), np.int64)))], names=["u", "v", "n"])

    found = Stored(tasks.repartition(F.xxhash64("a", "b")).mapInArrow(compare, "u long, v long, n long"), "vector-links").read()
    roots = connected_components(found.where("v >= 0").select("u", "v"), "vector-components")
    links = found.where("v < 0").groupBy("u").agg(F.sum("n").alias("n"))
    nodes = blocks.select(F.inline("members"))
    nodes = nodes.join(links, nodes.node == links.u, "left").drop("u").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    nodes = nodes.select("uid", "least", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    result = nodes.join(smallest, "root").select(F.col("uid").alias("of_uid"), "n_links", "component_id")
    out = checked.select("vec_id", "uid").join(result, F.col("uid") == F.col("of_uid"), "left")
    component = F.when(F.col("of_uid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
