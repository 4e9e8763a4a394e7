"""SimHash fingerprints and exact near-duplicate components by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, only, ship, stored_alone
from tessera.llm.components import connected_components

SEED = 42
#: The 64 bits in four bands; fingerprints within two bits agree on two bands at least.
BANDS = ((0, 16), (16, 16), (32, 16), (48, 16))
#: Fingerprints in one bit-sliced block: one machine word a plane.
LANE = 64
#: Members of a group that meet as one chunk. Every group is cut so; most are one chunk.
CHUNK = 2048
#: Pairs of a fingerprint and a block that are compared at once, planes between two looks at what can be abandoned, and rows that a task compares at once.
SLAB, STEP, ROWS = 1 << 14, 16, 1 << 15
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int = 3) -> list[int]:
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space only
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is 1 if over half of the hashes have it."""
    total, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, total, 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a text's shingles; 0 for a text without words or a null."""
    hashes = shingle_hashes(text or b"", width)
    return majority(np.array(hashes, np.uint64)) if hashes else 0


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; other columns of docs are left behind."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    return source.mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Fingerprints stored vertically: word w of plane k holds bit k of fingerprints 64 w to 64 w + 63. As many as fill whole words."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # row: fingerprint, column: bit
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class Counters:
    """Vertical counters, one for each bit of a row of words: `bits` exact binary digits, and what has passed them."""

    def __init__(self, size: int, bits: int):
        self.digits = [np.zeros(size, np.uint64) for _ in range(bits)]
        self.over = np.zeros(size, np.uint64)

    def add(self, words: list[np.ndarray]) -> None:
        """Adds all words by carry-save: three words of one digit make one of it and one of the next."""
        for i, digit in enumerate(self.digits):
            carries = []
            for x, y in zip(words[::2], words[1::2], strict=False):
                half = x ^ y
                carries.append(x & y | half & digit)
                digit ^= half  # in place: self.digits[i]
            if len(words) % 2:
                carries.append(digit & words[-1])
                digit ^= words[-1]
            words = carries
        for x in words:
            self.over |= x

    def passed(self, limit: int) -> np.ndarray:
        """Which counters are over the limit."""
        more, equal = self.over.copy(), ~self.over
        for i in reversed(range(len(self.digits))):
            if limit >> i & 1:
                equal &= self.digits[i]
            else:
                more |= equal & self.digits[i]
                equal &= ~self.digits[i]
        return more

    def keep(self, which: np.ndarray) -> None:
        self.digits = [x[which] for x in self.digits]
        self.over = self.over[which]


def near_pairs(fps: np.ndarray, task: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs at most radius bits apart, of one task each, in parts.

    Rows are sorted by task. side: 0, 1 or, in tasks of one chunk, 2; fingerprints of side 0 meet those of side 1, those of side 2 each other.
    Those that are met fill the words of the bit planes, task after task; a mask tells a task's own in a word. Each plane in which a fingerprint
    differs adds one to its vertical counter. After each few planes, pairs of a fingerprint and a word whose counters have all passed the radius are abandoned.
    """
    met = np.flatnonzero(side > 0)
    of, start, many = np.unique(task[met], return_index=True, return_counts=True)
    lanes = np.zeros(-(-len(met) // LANE) * LANE, np.uint64)
    lanes[: len(met)] = fps[met]
    sliced = planes(lanes)
    asks = np.flatnonzero(side != 1)
    at = np.searchsorted(of, task[asks])
    found = at < len(of)
    found[found] = of[at[found]] == task[asks][found]
    asks, at = asks[found], at[found]
    begin, stop = start[at], start[at] + many[at]
    first_word = begin // LANE
    size = (stop - 1) // LANE - first_word + 1
    ends = np.cumsum(size)
    first = 0
    while first < len(asks):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first] - size[first]) + SLAB, "right")))
        n = size[first:last]
        ask = np.repeat(asks[first:last], n)
        word = np.repeat(first_word[first:last] - (np.cumsum(n) - n), n) + np.arange(len(ask))
        foreign = ~(_below(np.repeat(stop[first:last], n) - word * LANE) & ~_below(np.repeat(begin[first:last], n) - word * LANE))
        first = last
        counters = Counters(len(ask), max(1, int(radius + 1).bit_length()))
        for plane in range(0, 64, STEP):
            own = fps[ask]
            counters.add([sliced[k][word] ^ (np.uint64(0) - (own >> np.uint64(k) & np.uint64(1))) for k in range(plane, plane + STEP)])
            live = (counters.passed(radius) | foreign) != _FULL
            if not live.all():
                ask, word, foreign = ask[live], word[live], foreign[live]
                counters.keep(live)
            if not len(ask):
                break
        if len(ask):
            near = ~(counters.passed(radius) | foreign)
            hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            i, j = ask[hit // LANE], met[word[hit // LANE] * LANE + hit % LANE]
            one = (side[i] == 0) | (i < j)
            yield np.minimum(i, j)[one], np.maximum(i, j)[one]


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose first n bits are set."""
    n = np.clip(n, 0, LANE)
    return np.where(n == LANE, _FULL, (np.uint64(1) << np.minimum(n, LANE - 1).astype(np.uint64)) - np.uint64(1))


class Forest:
    """Which of n rows are linked so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def joining(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Links pairs; gives the places of those that join what was apart, at most one a row over all calls."""
        out, at = [], np.arange(len(i))
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, at, low, high = i[apart], j[apart], at[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            top, first = np.unique(high, return_index=True)
            out.append(at[first])
            self.root[top] = low[first]
            while not np.array_equal(self.root, further := self.root[self.root]):
                self.root = further
        return np.concatenate(out) if out else at[:0]

    def add(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that joining() gives."""
        at = self.joining(i, j)
        return i[at], j[at]


def deal(rows: DataFrame, keys: list[str], member: str, label: str | None = None) -> DataFrame:
    """Rows of groups (equal keys) of two or more as comparison tasks (task long, side int), with their columns.

    A group is cut into chunks of about CHUNK members, by hash; each chunk meets itself and each other chunk, so no task holds more than two
    chunks, whatever the group's size. With a label, members of the group's most frequent label are chunks of their own, which don't meet each other.
    """
    if label is None:
        major, groups = F.lit(False), rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.lit(0).alias("_most")).where("_all > 1")
    else:
        counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
        groups = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", label)).alias("_top")).where("_all > 1")
        groups = groups.select(*keys, "_all", F.col("_top._n").alias("_most"), F.col(f"_top.{label}").alias("_major"))
        major = F.col(label) == F.col("_major")
    chunks = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    groups = groups.withColumn("_minor_chunks", chunks(F.col("_all") - F.col("_most"))).withColumn("_major_chunks", chunks(F.col("_most")))
    spread = F.xxhash64(member, F.lit(7))
    own = F.when(major, F.col("_minor_chunks") + F.pmod(spread, F.col("_major_chunks"))).otherwise(F.pmod(spread, F.col("_minor_chunks"))).cast("int")
    others = F.col("_minor_chunks") + F.when(major, F.lit(0)).otherwise(F.col("_major_chunks"))
    found = rows.join(groups, keys).withColumn("_own", own).where(others > 0)
    dealt = found.withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
    a, b = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(a == b, F.lit(2)).otherwise((F.col("_own") == b).cast("int"))
    return dealt.select(F.xxhash64(*keys, a, b).alias("task"), side.alias("side"), *rows.columns)


def whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column as tables of about ROWS rows or more that end with a task."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            task = table.column(0).to_numpy()
            cut = int(np.searchsorted(task, task[-1]))  # the last task may go on
            if cut:
                yield table.slice(0, cut)
            held, size = table.slice(cut).to_batches(), 0  # looked at again when as many rows have come
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_edges(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints within radius bits of each other.

    Candidates share two of four 16-bit bands (pigeonhole for radius up to 2: no link is missed). Groups of candidates, of any size, are compared
    bit-sliced, many at once. Tasks emit spanning forests, not pairs.
    """
    if radius > 2:
        raise ValueError("the bands find links of up to two bits")
    ship(fps.sparkSession)
    keys = []
    for n, (x, y) in enumerate(combinations(range(4), 2)):
        band = lambda k: F.shiftrightunsigned("fp", BANDS[k][0]).bitwiseAND(F.lit((1 << BANDS[k][1]) - 1))
        keys.append(F.struct(F.lit(n).alias("n"), (F.shiftleft(band(x), 16).bitwiseOR(band(y))).alias("key")))
    rows = fps.select("fp").distinct().select("fp", F.inline(F.array(*keys)))
    dealt = deal(rows, ["n", "key"], "fp").select("task", "side", "fp")
    tasks = dealt.repartition("task").sortWithinPartitions("task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            task, side, fp = (c.to_numpy() for c in table.columns)
            forest, own = Forest(len(fp)), fp.view(np.uint64)
            for i, j in near_pairs(own, task, side, radius):
                u, v = forest.add(i, j)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], names=["u", "v"])

    return tasks.mapInArrow(compare, "u long, v long")


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Fingerprint: 16 lowercase hex digits. Documents link if their fingerprints differ in at most radius bits; component_id is the smallest
    doc_id that links reach. Null, empty and blank texts have fingerprint zero and link like any other; texts of fewer words than
    a shingle are one shingle; long texts count whole. Repeated rows come back repeated. A null doc_id never
    becomes a component_id unless its whole component has none. An empty table gives an empty result; extra columns don't matter.
    """
    table = Stored(fingerprints(docs, text, id_col, width), "fingerprints").read()
    least = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_edges(table, radius), "fp-components")
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select(F.col("fp").alias("of_fp"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return table.join(of, table.fp == of.of_fp).select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = 2, similarity: float | None = None, width: int | None = None) -> DataFrame:
    """The rows of docs that stay: one of each component, that with the smallest id; all columns of docs, no others.

    Links: fingerprints (of three words) within radius bits or, with a similarity, sets of shingles (of five words) of that Jaccard similarity or more.
    Rows are documents of their own, whatever their ids: rows that share an id, or have none, stay unless they are near copies. Of
    equal ids in a component the first row stays; one without an id only if no row of its component has one.
    """
    rows = Stored(docs.withColumn("_tessera_row", F.monotonically_increasing_id()), "documents").read()
    own = rows.select(F.col("_tessera_row").alias("node"), F.col(id_col).alias("_id"), F.col(text).alias("t"))

    def kept() -> DataFrame:
        if similarity is None:
            of = simhash_components(own, "t", "node", radius, width or 3).select(F.col("doc_id").alias("node"), F.col("component_id").alias("root"))
        else:
            from tessera.llm.similar import similar_components

            of = similar_components(own.select("node", "t"), "t", width or 5, similarity)
        named = own.select("node", "_id").join(of, "node")
        least = named.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "node")).alias("least"))
        return least.select(F.col("least.node").alias("_tessera_row"))

    keep = stored_alone(docs.sparkSession, "kept-rows", kept)
    return only(rows, keep, "_tessera_row", "kept-bits").select(*docs.columns)
