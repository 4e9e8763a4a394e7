"""Sharding by balanced label propagation: linked documents move together under quotas, shards stay equally large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, running_order, shuffle_partitions

SHARDS = 8
#: Rounds in a row without fewer split groups, each under new lots, after which what is split counts as settled.
PATIENCE = 6
#: Parts of a group that move as one are a shard's rows by so many at most (about); so a group of any size moves part by part, and one that no shard holds fills several.
FINE = 64
#: Lots in which a round's moves are admitted, shared among the shards they come from: the driver sees one row a pair of shards and lot.
LOTS = 1024
#: A shard may pass its quota by one row in so many during the rounds, so that full shards can exchange parts of unequal size.
SLACK = 100
STEPS = 1_000_000


def _by_share(shares: list[tuple[int, float]], key: Column) -> Column:
    """A shard for a hash of the key, in proportion to the shares."""
    total = sum(max(0.0, x) for _, x in shares) or 1.0
    u, out, upto = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(STEPS)), F.lit(shares[-1][0]), 0.0
    cuts = []
    for shard, x in shares[:-1]:
        upto += max(0.0, x)
        cuts.append((int(STEPS * upto / total), shard))
    for cut, shard in reversed(cuts):
        out = F.when(u < cut, F.lit(shard)).otherwise(out)
    return out.cast("int")


def _admit(asked: dict[tuple[int, int], list[tuple[int, int]]], free: dict[int, int]) -> dict[tuple[int, int], int]:
    """The last lot admitted of each pair (from, to), -1 for none. asked: lots with their rows; free: what each shard has room for.

    Lots of all pairs take turns. A lot moves if its target has room, which those that leave the target make; else it is swapped
    with the next lot of the opposite direction, if the difference fits.
    """
    free, at, out = dict(free), dict.fromkeys(asked, 0), dict.fromkeys(asked, -1)

    def move(pair: tuple[int, int]) -> None:
        lot, n = asked[pair][at[pair]]
        free[pair[0]] += n
        free[pair[1]] -= n
        at[pair] += 1
        out[pair] = lot

    again = True
    while again:
        again = False
        for a, b in asked:
            if at[a, b] == len(asked[a, b]):
                continue
            n = asked[a, b][at[a, b]][1]
            if n <= free[b]:
                move((a, b))
            elif at.get((b, a), 0) < len(asked.get((b, a), ())) and n - (m := asked[b, a][at[b, a]][1]) <= max(0, free[b]) and m - n <= max(0, free[a]):
                move((a, b))
                move((b, a))
            else:
                continue
            again = True
    return out


def propagate(state: DataFrame, capacity: int, shards: int) -> tuple[DataFrame, dict[int, int]]:
    """Rounds of label propagation on (gid, first, sub, shard, n): parts of groups, by the shard they began in and a number, with the shard they are in.

    In each round every part wants to be where most of its group is, among the shards with room; ties fall anew each round. Wants are admitted in lots, by a hash that changes each round,
    as long as the target's quota (capacity less what it holds) lasts; opposite wants of full shards are swapped. After a round that brought
    no group together, wants go to any of a group's shards, by hash, so that neither direction is alone. The rounds end when no group is split, or
    when PATIENCE rounds in a row leave no fewer split. Returns the last state and each shard's load.
    """
    at = Stored(state, "sharding-state")
    lots = max(16, LOTS // shards)
    fewest, idle, step = None, 0, 0
    while True:
        now = at.read()
        load = dict.fromkeys(range(shards), 0)
        for r in now.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
            load[r.shard] += r.n
        sizes = now.groupBy("gid", "shard").agg(F.sum("n").alias("n"))
        room = F.element_at(F.array(*[F.lit(load[s] < capacity) for s in range(shards)]), F.col("shard") + 1)
        weight = F.lit(0).cast("long") if idle else F.col("n")
        best = sizes.groupBy("gid").agg(F.max(F.struct(room.alias("room"), weight.alias("n"), F.xxhash64("gid", "shard", F.lit(step)), "shard")).alias("b")).select(F.col("gid").alias("g"), F.col("b.shard").alias("to"))
        lot = F.pmod(F.xxhash64("gid", "sub", F.lit(step)), F.lit(lots)).cast("int")
        wants = now.join(best, now.gid == best.g).select("gid", "first", "sub", "shard", "n", "to", lot.alias("lot"))
        wants = Stored(wants, "sharding-wants")
        apart = wants.read().where("shard != to").groupBy("gid", "sub", "shard", "to", "lot").agg(F.sum("n").alias("n"))
        rows = apart.groupBy("shard", "to", "lot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).orderBy("shard", "to", "lot").collect()  # at most lots a pair
        parts = sum(r.parts for r in rows)  # 0: no group is split
        if fewest is None or parts < fewest:
            fewest, idle = parts, 0
        else:
            idle += 1
        if not parts or idle >= PATIENCE:
            wants.drop()
            break
        asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in rows:
            asked.setdefault((r.shard, r.to), []).append((r.lot, r.n))
        upto = _admit(asked, {s: capacity + max(1, capacity // SLACK) - load[s] for s in range(shards)})
        limits = F.array(*[F.lit(upto.get((s, t), -1)) for s in range(shards) for t in range(shards)])
        limit = F.element_at(limits, F.col("shard") * shards + F.col("to") + 1)
        moved = wants.read().select("gid", "first", "sub", F.when(F.col("lot") <= limit, F.col("to")).otherwise(F.col("shard")).alias("shard"), "n")
        old, at = at, Stored(moved, "sharding-state")
        old.drop()
        wants.drop()
        step += 1
    return at.read(), load


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", id_col: str = "doc_id", link: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs; law `rows`: counts differ by one at most.

    Documents are linked if their `link` values are equal (default: equal texts). Linked ones are brought together by label
    propagation under quotas, groups of any size part by part; one that is larger than a shard fills shards one after the other. Documents without links fill
    what is left. At last all rows, in the order of their shards, are cut at equal ranks, which moves documents without links over
    the borders first. slot: gapless from 0 in each shard. A null text counts as empty (size 1); repeated rows are placed each; a null doc_id
    stays null; fewer rows than shards leave shards empty; an empty table gives an empty result; extra columns don't matter.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    gid = F.sha2(t.cast("binary"), 256) if link is None else F.sha2(link.cast("string").cast("binary"), 256)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.coalesce(gid, F.uuid()).alias("gid"))
    rows = Stored(base.withColumn("spread", F.xxhash64("doc_id", F.monotonically_increasing_id())), "sharding-rows").read()  # equal ids, and none, spread too
    sizes = Stored(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("total")).where("total > 1"), "sharding-groups").read()
    n = rows.count()
    capacity = -(-n // shards)
    first = F.pmod(F.xxhash64("spread", F.lit(17)), F.lit(shards)).cast("int")
    sub = F.pmod(F.xxhash64("spread", F.lit(31)), F.ceil(F.col("total") / F.lit(max(1, capacity // FINE)))).cast("int")
    known = rows.join(sizes, "gid", "left").withColumn("first", first).withColumn("sub", F.when(F.col("total") * FINE > F.lit(capacity), sub).otherwise(0))
    linked = known.where("total is not null").groupBy("gid", "first", "sub").agg(F.count(F.lit(1)).alias("n"))
    state, load = propagate(linked.select("gid", "first", "sub", F.col("first").alias("shard"), "n"), capacity, shards)
    parts = state.select(F.col("gid").alias("g"), F.col("first").alias("f"), F.col("sub").alias("u"), F.col("shard").alias("label"))
    labelled = known.join(parts, (known["gid"] == parts["g"]) & (known["first"] == parts["f"]) & (known["sub"] == parts["u"]), "left").drop("g", "f", "u")
    alone = F.col("label").isNull()
    filler = _by_share([(s, capacity - load[s]) for s in range(shards)], F.concat_ws("-", F.col("spread").cast("string"), F.col("text_crc32").cast("string")))
    half = F.pmod(F.xxhash64("spread", F.lit(29)), F.lit(2)) * 2
    labelled = labelled.withColumn("kind", F.when(alone, half).otherwise(1).cast("int")).withColumn("label", F.coalesce("label", filler))
    keys = ["label", "kind", "gid", "doc_id"]
    placed, total = running_order(labelled.select("doc_id", "size", "text_crc32", "gid", "label", "kind"), keys, None, shuffle_partitions(spark), "sharding-order")
    number = F.expr(f"((pos + 1) * {shards} - 1) div {max(1, total)}")
    out = placed.withColumn("shard", number.cast("int"))
    start = F.expr(f"(shard * {total}L) div {shards}")
    out = out.withColumn("slot", (F.col("pos") - start).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
