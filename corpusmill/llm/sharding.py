"""Balanced label propagation: documents move to their neighbours' shards under capacity quotas.

Documents are linked when they share a link key (by default, equal texts). A key is a hyperedge: its members are counted by
shard, so a group of any size is one row of counts, and labels propagate on those rows, never on pairs.

All documents begin in shards by a hash. Each round, every linked group proposes to move its members to the shard that
holds most of them, of those that have room for all; a shard takes proposals, those that bring the most members together first, until its
quota is full, and what it refuses proposes to its next best shard with room. Rounds go on until no proposal can be accepted; then no
group that is cut would fit into any shard. Groups too large for that (over 1/64 of a shard: no more than 64 a shard) go first,
the largest of all first: into the shard with most of their members and room, or, if none has room, over the emptiest shards, whole
ones as long as they last. Documents without neighbours cut no edge wherever they are: they fill what is left of each shard, so the
counts of the shards differ by one at most (the law `rows`).

Defined cases: null and empty texts are documents of their own group (null with null, empty with empty); groups that fit into no
shard fill what room there is; repeated rows are separate rows; an empty table gives no rows; ties are settled by a hash of
the link key; other columns pass through unless they have the names of added ones, which replace them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.shared import discard, globally_ranked, materialize, shuffle_partitions

LARGE = 64  # groups over 1 / LARGE of a shard are placed one by one: at most num_shards * LARGE rows reach the driver


def place_large(groups: list[tuple[int, list[int]]], room: list[int]) -> list[list[int]]:
    """Rows a shard of each group (size, members by shard), largest first; room is used up."""
    out = []
    for size, by in groups:
        taken = [0] * len(room)
        fits = [s for s, r in enumerate(room) if r >= size]
        if fits:
            order = [max(fits, key=lambda s: (by[s], -s))]
        else:
            order = sorted(range(len(room)), key=lambda s: (-room[s], -by[s], s))
        left = size
        for at, s in enumerate(order):
            rest = [t for t in order[at:] if room[t] >= left]
            if rest:  # the last part goes where most members are, of the shards that hold all of it
                s = max(rest, key=lambda t: (by[t], -room[t]))
            taken[s] += min(left, room[s])
            left -= taken[s]
            if not left:
                break
        for s, n in enumerate(taken):
            room[s] -= n
        out.append(taken)
    return out


def _aim(room: list[int]) -> Column:
    """The shard that holds most members, of those with room for all; null if there is none. Ties spread by the key."""
    n = len(room)
    turn = F.pmod(F.xxhash64("__key"), F.lit(n))
    rooms = F.array(*(F.lit(r).cast("long") for r in room))
    fit = F.transform("__by", lambda c, i: F.when(F.get(rooms, i) >= F.col("__n"), F.struct(c.alias("n"), (-F.pmod(i - turn, F.lit(n))).alias("s"))))
    best = F.array_max(F.filter(fit, lambda x: x.isNotNull()))
    return F.pmod(turn - best["s"], F.lit(n)).cast("int")


def _running(df: DataFrame, by: str, order: list[Column], size: str, label: str) -> DataFrame:
    """df with `__upto`, the running sum of `size` within `by` in an order, without a task for all of one `by`.

    Rows are range-partitioned and sorted, summed inside partitions, and shifted by the sums of the partitions before:
    a few small rows a partition are all that is gathered.
    """
    spark = df.sparkSession
    order = [F.col(by), *order]
    laid = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    laid = materialize(laid.withColumn("__place", F.monotonically_increasing_id()), label)
    laid = laid.withColumn("__part", F.shiftright("__place", 33))
    sums = laid.groupBy(by, "__part").agg(F.sum(size).alias("s")).collect()  # partitions times shards at most
    before, starts = {}, []
    for r in sorted(sums, key=lambda r: (r[by], r["__part"])):
        starts.append((r[by], r["__part"], before.get(r[by], 0)))
        before[r[by]] = before.get(r[by], 0) + r["s"]
    starts = F.broadcast(spark.createDataFrame(starts, f"{by} int, __part long, __before long"))
    inside = F.sum(size).over(Window.partitionBy(by, "__part").orderBy("__place"))
    out = laid.join(starts, [by, "__part"]).withColumn("__upto", inside + F.col("__before")).drop("__place", "__part", "__before")
    return out


def propagate(groups: DataFrame, room: list[int]) -> tuple[DataFrame, DataFrame]:
    """Groups (__key, __n, __by) -> (__key, shard) of those that found a shard and the groups that fit into none; room is used up."""
    placed = None
    open_ = groups
    while True:
        aimed = materialize(open_.withColumn("shard", _aim(room)), "aims")
        asked = {r["shard"]: r["n"] for r in aimed.filter("shard IS NOT NULL").groupBy("shard").agg(F.sum("__n").alias("n")).collect()}  # a row a shard
        if not asked:
            return placed if placed is not None else aimed.filter("shard IS NOT NULL").select("__key", "shard"), aimed
        tight = [s for s, n in asked.items() if n > room[s]]
        take = aimed.filter(F.col("shard").isNotNull() & ~F.col("shard").isin(tight))
        if tight:
            gain = F.expr("__n - __by[shard]")  # the fewer have to move for a whole group, the more one move brings together
            ranked = _running(aimed.filter(F.col("shard").isin(tight)), "shard", [gain, F.col("__n").desc(), F.col("__key")], "__n", "proposals")
            limit = reduce(lambda other, s: F.when(F.col("shard") == s, room[s]).otherwise(other), tight, F.lit(0))
            take = take.select("__key", "__n", "shard").union(ranked.filter(F.col("__upto") <= limit).select("__key", "__n", "shard"))
        take = materialize(take.select("__key", "__n", "shard"), "accepted")
        for r in take.groupBy("shard").agg(F.sum("__n").alias("n")).collect():
            room[r["shard"]] -= r["n"]
        before = open_
        open_ = materialize(aimed.drop("shard").join(take.select("__key"), "__key", "left_anti"), "open")
        discard(aimed, before)
        new = take.select("__key", "shard")
        placed = new if placed is None else placed.union(new)
        if open_.isEmpty():
            return placed, open_


def cut_links(placed: DataFrame, text_col: str, shard_col: str = "shard") -> DataFrame:
    """One row (links, cut_links, groups, cut_groups): pairs of equal texts, and those that lie in different shards."""
    cells = placed.groupBy(text_col, shard_col).agg(F.count("*").alias("c"))
    groups = cells.groupBy(text_col).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("shards")).filter("n > 1")
    pairs = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return groups.agg(
        pairs(F.expr("n * (n - 1) div 2")).alias("links"), pairs(F.expr("(n * n - same) div 2")).alias("cut_links"),
        F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("cut_groups"),
    )


def balanced_shards(
    docs: DataFrame, num_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", link_key: Column | None = None
) -> DataFrame:
    """One row per document: id_col, size, text_crc32, shard, slot; linked documents share shards where quotas allow.

    link_key: what linked documents have in common; None: their whole text.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    key = F.sha2(F.coalesce(text_col, F.lit("")), 256) if link_key is None else link_key.cast("string")
    null_text = F.col(text_col).isNull()
    rows = docs.select(
        F.col(id_col).alias("__id"),
        size.alias("__size"),
        F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("__crc"),
        F.concat(F.when(null_text, "null:").otherwise("text:"), F.coalesce(key, F.lit(""))).alias("__name"),
    )
    # 128 bits of the key keep the rows of every later join short
    rows = rows.select("__id", "__size", "__crc", F.xxhash64("__name").alias("__k1"), F.unhex(F.md5("__name")).alias("__key"))
    rows = globally_ranked(rows, [F.col("__k1"), F.col("__key"), F.col("__id"), F.col("__crc")], "__row", "rows")
    rows = materialize(rows.drop("__k1"), "rows")  # members of a group have ranks that follow each other
    total = rows.count()
    target = [total // num_shards + (s < total % num_shards) for s in range(num_shards)]
    room = target[:]
    start = F.pmod(F.xxhash64("__row"), F.lit(num_shards))
    counts = [F.count_if(start == s) for s in range(num_shards)]
    groups = rows.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"), F.array(*counts).alias("__by"))
    groups = materialize(groups.filter("__n > 1"), "groups")
    large = groups.filter(F.col("__n") * LARGE > max(target, default=0)).orderBy(F.desc("__n"), "__key").collect()  # num_shards * LARGE at most
    parts = place_large([(r["__n"], list(r["__by"])) for r in large], room)
    ends = [[sum(p[: s + 1]) for s in range(num_shards)] for p in parts]
    apart = F.broadcast(docs.sparkSession.createDataFrame([(r["__key"], r["__first"], e) for r, e in zip(large, ends, strict=True)], "__key binary, __first long, __ends array<long>"))
    found, lost = propagate(groups.join(apart, "__key", "left_anti").select("__key", "__n", "__by"), room)
    # a group's rows stand together: their places in it decide where a split group is cut
    place = F.col("__row") - F.col("__first")
    within = F.size(F.filter("__ends", lambda e: e <= place)).cast("int")
    split = rows.select("__row", "__key").join(apart, "__key").select("__row", within.alias("shard"))
    lost = _running(lost.withColumn("__all", F.lit(0)), "__all", [F.col("__key")], "__n", "lost").join(groups.select("__key", "__first"), "__key")
    rooms = F.array(*(F.lit(sum(room[: s + 1])).cast("long") for s in range(num_shards)))
    at = F.col("__upto") - F.col("__n") + place
    over = lost.select("__key", "__first", "__upto", "__n")
    rest = rows.select("__row", "__key").join(apart, "__key", "left_anti")
    split = split.union(rest.join(over, "__key").select("__row", F.size(F.filter(rooms, lambda e: e <= at)).cast("int").alias("shard")))
    linked = split.union(rest.join(found, "__key").select("__row", "shard"))
    linked = materialize(linked, "linked")
    held = {r[0]: r[1] for r in linked.groupBy("shard").count().collect()}
    # documents without neighbours fill the shards
    lone = rows.join(linked.select("__row"), "__row", "left_anti")
    lone = globally_ranked(lone.select("__row"), [F.col("__row")], "__deal", "lone")
    ends, end = [], 0
    for s in range(num_shards):
        end += target[s] - held.get(s, 0)
        ends.append(end)
    fill = reduce(lambda otherwise, s: F.when(F.col("__deal") < ends[s], s).otherwise(otherwise), range(num_shards - 1, -1, -1), F.lit(num_shards - 1))
    placed = linked.select("__row", "shard").union(lone.select("__row", fill.cast("int").alias("shard")))
    ranked = globally_ranked(placed, [F.col("shard"), F.col("__row")], "__at", "slots")
    first = reduce(lambda otherwise, s: F.when(F.col("shard") == s, sum(target[:s])).otherwise(otherwise), range(num_shards), F.lit(0))
    slots = ranked.select("__row", "shard", (F.col("__at") - first).cast("long").alias("slot"))
    return rows.join(slots, "__row").select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "shard", "slot"
    )
