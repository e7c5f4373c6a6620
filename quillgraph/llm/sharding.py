"""Balanced sharding by label propagation under capacity quotas.

Ugander and Backstrom, "Balanced label propagation for partitioning massive
graphs" (2013), and Kabiljo et al., "Social hash partitioner" (2017). Linked
nodes start in shards drawn by hash. In each round a Spark join gives a node its
neighbours' shards; the one that holds most of them (in every other round, of those
with room) is where it would go. Movers from s to t are accepted at the rate that the movers from t to
s and the room left under t's quota allow. Rounds go on while fewer links are cut.

Documents of equal text are linked. Every group of two and more takes part: its rows are
dealt by salt into at most 64 nodes, so that a row of a small group is a node of its own,
and a large group is nodes of some rows each, which can fill a shard to its quota and go
on in another. Rows without an equal, which no shard must hold together with anything,
fill the room that is left, by hash. A last exact step moves the few rows that are over,
rows without an equal first, until row counts differ by one at most.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SALTS = 64
IDLE = 4

log = logging.getLogger(__name__)


def hashed(n: int, *on) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(n)).cast("int")


def propagate(nodes: DataFrame, links: DataFrame, shards: int, cap: float, rounds: int = 50) -> DataFrame:
    """node, weight, shard: label propagation over ``nodes`` (node, weight) and
    ``links`` (node, hub): nodes with a hub in common are neighbours. Hubs must
    have a bounded number of nodes each. No shard takes nodes beyond ``cap``, but it
    may start above.

    It ends when ``IDLE`` rounds in a row cut no fewer links (first of groups that a shard can hold, then of all), or after ``rounds``, which the
    log then says; the state that cuts fewest is returned. A round's state is a written
    table. What reaches the driver is shards x shards numbers a round.
    """
    state = cut(nodes.withColumn("shard", hashed(shards, "node", F.lit(1))))
    best, fewest, idle, first = state, None, 0, None
    for step in range(rounds + 1):
        at_hub = cut(links.join(state, "node").groupBy("hub", "shard").agg(F.sum("weight").alias("held")))
        # pairs of rows with a hub in common, less those together; first of groups that a shard can hold
        pairs = at_hub.groupBy("hub").agg(((F.pow(F.sum("held"), F.lit(2)) - F.sum(F.pow("held", F.lit(2)))) / 2).alias("cut"), (F.sum("held") <= cap).alias("fits"))
        now = tuple(pairs.agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("cut"))), F.lit(0.0)), F.coalesce(F.sum("cut"), F.lit(0.0))).head())
        first = now if first is None else first
        if fewest is None or now < fewest:
            best, fewest, idle = state, now, 0
        else:
            idle += 1
        if not now[1] or idle == IDLE or step == rounds:
            break
        load = {r["shard"]: r["w"] for r in state.groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
        load = [load.get(s, 0) for s in range(shards)]
        room = F.element_at(F.array(*[F.lit(float(cap - x)) for x in load]), F.col("shard") + 1)
        votes = links.join(at_hub, "hub").groupBy("node", "shard").agg(F.sum("held").alias("held"), F.min("hub").alias("hub"))
        own = state.select("node", "weight", F.col("shard").alias("at"))
        votes = votes.join(own, "node")
        if step % 2 == 0:  # in turn to shards with room, and to full ones, by swaps
            votes = votes.where((F.col("shard") == F.col("at")) | (room >= F.col("weight")))
        # of equally held shards a hub's nodes agree on one, drawn by the hub
        to = votes.groupBy("node").agg(F.max(F.struct("held", F.xxhash64("hub", "shard", F.lit(step)).alias("tie"), "shard")).alias("best")).select("node", F.col("best.shard").alias("wanted"))
        moving = cut(state.join(to, "node", "left").withColumn("wanted", F.coalesce("wanted", "shard")))
        light = F.col("weight") * SALTS <= cap  # of a group that a shard can hold: it goes first
        wants = {(r.shard, r.wanted, r.light): r.w for r in moving.where("shard <> wanted").groupBy("shard", "wanted", light.alias("light")).agg(F.sum("weight").alias("w")).collect()}
        both = {(s, t): wants.get((s, t, True), 0) + wants.get((s, t, False), 0) for s, t, _ in wants}
        rate = {(0, 0): (0.0, 0.0)}
        for t in range(shards):
            over = {s: w - min(w, both.get((t, s), 0)) for (s, to_), w in both.items() if to_ == t}
            spread = sum(over.values())
            for s, extra in over.items():
                taken = both[s, t] - extra + (extra * min(1.0, max(0.0, cap - load[t]) / spread) if spread else 0.0)
                first_, rest = wants.get((s, t, True), 0), wants.get((s, t, False), 0)
                rate[s, t] = min(1.0, taken / first_) if first_ else 0.0, min(1.0, max(0.0, taken - first_) / rest) if rest else 0.0
        at = F.try_element_at(F.map_from_arrays(F.array(*[F.lit(s * shards + t) for s, t in rate]), F.array(*[F.array(*map(F.lit, r)) for r in rate.values()])), F.col("shard") * shards + F.col("wanted"))
        draw = hashed(1 << 20, "node", F.lit(100 + step)) / F.lit(float(1 << 20))
        accepted = (F.col("shard") != F.col("wanted")) & (draw < F.coalesce(F.when(light, at[0]).otherwise(at[1]), F.lit(0.0)))
        state = cut(moving.select("node", "weight", F.when(accepted, F.col("wanted")).otherwise(F.col("shard")).alias("shard")))
    log.info("%d rounds%s: pairs of linked rows in different shards from %d to %d", step, " (no more allowed)" if step == rounds and now[1] else "", first[1], fewest[1])
    return gathered(best, links, cap) if fewest[0] else best


def gathered(state: DataFrame, links: DataFrame, cap: float) -> DataFrame:
    """A last round without quotas, of the groups that a shard can hold and that are still
    split: each goes to where it has most. What is then over moves in the exact step."""
    at_hub = cut(links.join(state, "node").groupBy("hub", "shard").agg(F.sum("weight").alias("held")))
    most = F.max(F.struct("held", F.xxhash64("hub", "shard").alias("tie"), "shard"))["shard"]
    home = at_hub.groupBy("hub").agg(most.alias("home"), F.sum("held").alias("size"), F.count(F.lit(1)).alias("n")).where((F.col("size") <= cap) & (F.col("n") > 1))
    to = links.join(home, "hub").groupBy("node").agg(F.max(F.struct("size", "home")).alias("best")).select("node", F.col("best.home").alias("home"))
    return cut(state.join(to, "node", "left").select("node", "weight", F.coalesce("home", "shard").alias("shard")))


def numbered(rows: DataFrame, shards: int, buckets: int) -> DataFrame:
    """``rows`` (shard, rank bucket ``b``, order columns ``o1``, ``row``) with
    ``slot``: gapless from 0 in each shard, by bucket. Windows are over (shard,
    bucket), so none grows with the shard."""
    local = rows.withColumn("local", F.row_number().over(Window.partitionBy("shard", "b").orderBy("o1", "row")) - 1)
    sizes = rows.groupBy("shard", "b").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "b", "before")
    return local.join(before, ["shard", "b"]).withColumn("slot", F.col("local") + F.col("before")).drop("local", "before")


def shard_rows(docs: DataFrame, shards: int = 8, rounds: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null).

    Linked: rows of equal text (nulls are equal to one another, and count as
    empty in size and checksum). Every row is placed, repeated rows and null ids
    as well; row counts of any two shards differ by one at most; slots are
    gapless from 0 in each. An empty table gives no rows; other columns are
    ignored. Texts are read once; what is joined is some 40 bytes a row.
    """
    text = F.col(text_col).cast("string")
    known = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(known, "utf-8")).cast("long").alias("text_crc32"),
        F.struct(text.isNull().alias("none"), F.xxhash64(known).alias("a"), F.xxhash64(F.lit("second"), known).alias("b")).alias("hub"),
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    members = cut(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("members")))
    salted = rows.join(members.where("members > 1").select("hub"), "hub").withColumn("salt", hashed(SALTS, "row"))
    nodes = cut(salted.groupBy(F.struct("hub", "salt").alias("node")).agg(F.count(F.lit(1)).alias("weight")))
    links = nodes.select("node", F.col("node.hub").alias("hub"))
    placed = propagate(nodes, links, shards, n // shards, rounds)

    # rows without an equal go where there is room, by hash
    load = {r["shard"]: r["w"] for r in placed.groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
    room = [max(0.0, n / shards - load.get(s, 0)) for s in range(shards)]
    at = [sum(room[:s]) / max(1.0, sum(room)) for s in range(shards)]
    draw = hashed(1 << 30, "hub", F.lit(3)) / F.lit(float(1 << 30))
    filled = reduce(lambda c, s: F.when(draw >= F.lit(at[s]), F.lit(s)).otherwise(c), (s for s in range(shards) if room[s] > 0), F.lit(0))
    by_node = placed.select(F.col("node.hub").alias("hub"), F.col("node.salt").alias("salt"), F.col("shard").alias("own"), (F.col("weight") * SALTS > n // shards).alias("heavy"))
    rows = rows.withColumn("salt", hashed(SALTS, "row")).join(by_node, ["hub", "salt"], "left")

    # rows without an equal come last in a shard and are the first to be over, then those of groups that no shard holds
    buckets = max(16, n // 20_000 + 1)
    kind = F.when(F.col("own").isNull(), 2).when(F.col("heavy"), 1).otherwise(0)
    rows = rows.withColumn("shard", F.coalesce("own", filled)).withColumn("b", kind * buckets + hashed(buckets, "hub", "row"))
    rows = cut(numbered(rows.select("doc_id", "size", "text_crc32", "row", "shard", "b", F.col("hub.a").alias("o1")), shards, buckets).drop("b", "o1"))
    load = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    load = [load.get(s, 0) for s in range(shards)]
    # the extra row of n % shards shards goes to those that hold most
    extra = sorted(range(shards), key=lambda s: (-load[s], s))[: n % shards]
    quota = [n // shards + (s in extra) for s in range(shards)]
    over, free, at, moved = [], [], 0, 0
    for s in range(shards):
        over.append(moved)
        moved += max(0, load[s] - quota[s])
        if quota[s] > load[s]:
            free.append((at, s, load[s]))
            at += quota[s] - load[s]
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)
    surplus = F.when(F.col("slot") >= pick(quota), pick(over) + F.col("slot") - pick(quota))
    to_shard = reduce(lambda c, x: F.when(F.col("surplus") >= x[0], F.lit(x[1])).otherwise(c), free, F.lit(None).cast("int"))
    to_slot = reduce(lambda c, x: F.when(F.col("surplus") >= x[0], F.col("surplus") - x[0] + x[2]).otherwise(c), free, F.lit(None).cast("long"))
    rows = rows.withColumn("surplus", surplus)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.coalesce(to_shard, "shard").cast("int").alias("shard"), F.coalesce(to_slot, "slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
