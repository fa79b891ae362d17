"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard by
hash; then, round by round, Spark joins count each group's members by shard, a
group's part in one shard asks to move to the shard that holds most of the
group, and asks are admitted up to the room that shard has under its quota. A
part moves as a whole, so cut edges only fall. Then groups are settled whole,
the largest first: one that is whole stays while its shard has room, any other
goes to the shard with the least room that holds it. Groups for which no shard
has room, fewer than there are shards, and groups larger than a shard fill the
last shards one behind the other; documents without links fill the rest, up to
the exact quota.

The law is ``rows``: shard sizes differ by one document at most.

Groups are only ever aggregated by (group, shard); numbers within a shard come
from prefix sums over hash buckets of bounded size, so no shard, group or table
is held by one task or the driver. The driver sees counts by pair of shards, and counts
of groups by shard and size, of which there are few: n different sizes need
n * n / 2 documents.

Cases: a null text counts as empty with size 1; null ids and repeated rows are
documents like any other (equal texts are linked); an empty table gives no
rows; ties go by hash; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

BUCKET_ROWS = 4096
ROUNDS = 6


def _numbered(rows: DataFrame, by: list[str], total: int, name: str) -> DataFrame:
    """Add a gapless number from 0 within each combination of ``by``, from prefix sums over hash buckets."""
    buckets = max(1, total // BUCKET_ROWS)
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(F.lit(name), "rid"), F.lit(buckets)))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, "__b").orderBy("rid")
    rows = rows.withColumn("__r", F.row_number().over(inside)).join(starts, [*by, "__b"])
    return rows.withColumn(name, F.col("__start") + F.col("__r") - 1).drop("__b", "__r", "__start")


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """Move linked rows (``rid, g, shard``) towards their groups' shards; ``shard`` changes only."""
    group = ["g", "size", "text_crc32"]
    for turn in range(rounds):
        cells = linked.groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("c"))
        tie = F.xxhash64("g", "shard")
        best = cells.groupBy(*group).agg(F.max(F.struct("c", tie.alias("t"), "shard")).alias("best"))
        asks = cells.join(best, group).select(*group, "shard", "c", F.col("best.shard").alias("to")).where(F.col("shard") != F.col("to"))
        asks = save(asks, "asks")
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        asked = {r["to"]: r["n"] for r in asks.groupBy("to").agg(F.sum("c").alias("n")).collect()}
        room = {t: max(0, quota - held.get(t, 0)) for t in asked}
        if not any(room.values()):
            break
        share = F.create_map(*[F.lit(x) for t, n in asked.items() for x in (t, min(1.0, room[t] / n))])
        space = F.create_map(*[F.lit(x) for t in asked for x in (t, room[t])])
        draw = F.shiftrightunsigned(F.xxhash64("g", "shard", F.lit(turn)), 11) / F.lit(float(1 << 53))
        moves = asks.where((draw < share[F.col("to")]) & (F.col("c") <= space[F.col("to")])).select(*group, "shard", "to")
        linked = linked.join(moves, [*group, "shard"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
        linked = save(linked, "linked")
        if sum(asked.values()) == 0:
            break
    return linked


def plan(groups: dict[tuple[int, int], int], quotas: list[int]):
    """Where groups go whole: ``home, n, first, last, shard`` for numbers of groups of a home and a size, and the rooms left.

    ``groups`` counts them by home (-1: none) and size. A group is left out only
    if no shard has room for it, which larger groups and those planned so far fill.
    """
    room, out = list(quotas), []
    at = dict.fromkeys(groups, 0)

    def put(key, t):
        k = min(groups[key] - at[key], room[t] // key[1])
        if k > 0:
            out.append((*key, at[key], at[key] + k, t))
            at[key] += k
            room[t] -= k * key[1]

    for n in sorted({n for _, n in groups}, reverse=True):
        same = sorted(key for key in groups if key[1] == n)
        for key in same:
            if key[0] >= 0:
                put(key, key[0])
        for key in same:
            for t in sorted(range(len(room)), key=lambda t: (room[t], t)):
                put(key, t)
    return out, room


def settle(linked: DataFrame, quotas: list[int]):
    """A shard for each group of ``linked`` that fits whole, and the rooms left."""
    group = ["g", "size", "text_crc32"]
    ends = linked.groupBy(*group).agg(F.min("shard").alias("a"), F.max("shard").alias("b"), F.count(F.lit(1)).alias("n"))
    home = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(-1).alias("home")
    ends = save(ends.select(*group, home, "n", F.monotonically_increasing_id().alias("rid")), "groups")
    counts = {(r["home"], r["n"]): r["count"] for r in ends.groupBy("home", "n").count().collect()}
    moves, room = plan(counts, quotas)
    moves = linked.sparkSession.createDataFrame(moves, "home int, n long, first long, last long, shard int")
    numbered = _numbered(ends, ["home", "n"], sum(counts.values()), "at")
    settled = numbered.join(F.broadcast(moves), ["home", "n"]).where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("last")))
    return settled.select(*group, "shard"), room


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, and ``group_size`` and ``text_hash`` of the equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"),
    )
    base = save(base.withColumn("rid", F.monotonically_increasing_id()), "shard-base")
    group = ["g", "size", "text_crc32"]
    groups = base.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))
    base = save(base.join(groups, group), "shard-groups")
    total = base.count()
    quotas = [total // shards + (t < total % shards) for t in range(shards)]
    start = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard")
    fits = F.col("group_size").between(2, max(1, max(quotas)))
    linked = save(base.where(fits).select("rid", *group, start), "linked")
    linked = propagate(linked, shards, min(quotas))

    # groups that fit stay whole; documents without links form the pool that fills the shards
    settled, room = settle(linked, quotas)
    placed = save(base.where(F.col("group_size") > 1).select("rid", *group, "group_size").join(settled, group, "left"), "placed")
    stays = F.col("shard").isNotNull()
    pool = base.where(F.col("group_size") == 1).select("rid")
    pool = save(_numbered(pool, [], total, "at"), "pool").select("rid", "at")
    # groups that no shard holds fill what is left one behind the other
    large = placed.where(~stays)
    at = pool.count()
    for r in large.select(*group, "group_size").distinct().orderBy(*group).collect() if total else []:
        one = large.where((F.col("g") == r["g"]) & (F.col("size") == r["size"]) & (F.col("text_crc32") == r["text_crc32"])).select("rid")
        pool = pool.unionByName(_numbered(one, [], total, "at").select("rid", (F.col("at") + at).alias("at")))
        at += r["group_size"]
    ends, at = [], 0
    for t in range(shards):
        at += room[t]
        ends.append(at)
    fill = F.lit(shards - 1)
    for t in reversed(range(shards)):
        fill = F.when(F.col("at") < ends[t], F.lit(t)).otherwise(fill)
    final = placed.where(stays).select("rid", "shard").unionByName(pool.select("rid", fill.cast("int").alias("shard")))
    out = base.select("rid", "doc_id", "size", "text_crc32", "group_size", "g").join(final, "rid")
    out = _numbered(save(out, "sharded"), ["shard"], total, "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "group_size", F.col("g").alias("text_hash"),
    )


def quality(placed: DataFrame) -> DataFrame:
    """One row: ``groups, whole_groups, linked, cut``, groups of equal texts and their documents; cut ones are not where most of their group is."""
    cells = placed.where(F.col("group_size") > 1).groupBy("text_hash", "size", "text_crc32", "shard").agg(F.count(F.lit(1)).alias("c"))
    groups = cells.groupBy("text_hash", "size", "text_crc32").agg(F.sum("c").alias("n"), F.max("c").alias("most"))
    zero = F.lit(0).cast("long")
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") == F.col("most")).alias("whole_groups"),
        F.coalesce(F.sum("n"), zero).alias("linked"), F.coalesce(F.sum(F.col("n") - F.col("most")), zero).alias("cut"),
    )


def op4_sharding(spark, sf_dir) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
