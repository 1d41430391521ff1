"""Sharding by balanced label propagation.

Nodes are documents, links join those that should share a shard (in the query: each document with the hub of its group of
equal texts). A group larger than a shard cannot share one; it is cut by capacity first, into as few shards as hold it, and
what it takes comes off their quotas. All other linked documents start in hashed shards, in proportion to the quotas, and
move in rounds: joins bring each node its neighbours' shards, and it asks for the one that most of them are in. Requests are granted bucket by
bucket while the target's quota lasts; then in cycles of shards, as many from each to the next, so that full shards exchange nodes. A coin for each
neighbourhood and round tells whether its local minimum asks or the others do, so an end of a link stays while the other moves, and as many ask in one direction as in
the other. Unlinked documents are ballast: after the last round they fill what is
left, so that shard sizes obey the law `rows` exactly: counts differ by one at most.

What reaches the driver in a round is a count for each (from, to, bucket), at most shards^2 * BUCKETS numbers.

Defined results: a null text is empty and of size 8, and equals the empty text; repeated rows and null ids are documents of their own;
texts of any length count by their hash; of shards with as many neighbours the node's own is taken, then the least; columns other than doc_id and text are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, save, table

SHARDS, ROUNDS, BUCKETS, ROWS_A_RANK = 24, 8, 128, 5_000


def _cycle(flow: dict[int, dict[int, int]], start: int) -> list[int] | None:
    """The shortest way from start back to it."""
    came, queue = {}, deque([start])
    while queue:
        x = queue.popleft()
        for y in flow.get(x, {}):
            if y == start:
                way = [x]
                while way[-1] != start:
                    way.append(came[way[-1]])
                return way[::-1]
            if y not in came:
                came[y] = x
                queue.append(y)
    return None


def exchanges(asked: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """asked (from, to, bucket, count): those that together leave every shard's load as it is, found as cycles of requests between the shards, the shortest
    first."""
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, bucket, count in sorted(asked, key=lambda x: (x[3], x[2])):
        groups.setdefault((a, b), []).append((count, bucket))
    out = []
    for size in sorted({c for g in groups.values() for c, _ in g}):  # requests of one size can take each other's places
        rest = {e: [bucket for c, bucket in g if c == size] for e, g in groups.items()}
        flow: dict[int, dict[int, int]] = {}
        for (a, b), buckets in rest.items():
            if buckets:
                flow.setdefault(a, {})[b] = len(buckets)
        for longest in (2, 3, len(flow)):
            for start in list(flow):
                while (way := _cycle(flow, start)) and len(way) <= longest:
                    edges = list(zip(way, way[1:] + way[:1], strict=True))
                    most = min(flow[a][b] for a, b in edges)
                    for a, b in edges:
                        out += [(a, b, rest[a, b].pop(0)) for _ in range(most)]
                        flow[a][b] -= most
                        if not flow[a][b]:
                            del flow[a][b]
    return out


def propagate(nodes: DataFrame, links: DataFrame, quota: list[int], rounds: int = ROUNDS, buckets: int = BUCKETS) -> DataFrame:
    """nodes (node), links (a, b): (node, shard) with at most quota[s] nodes in shard s as far as the start allows it, and
    few links between shards."""
    spark, n = nodes.sparkSession, len(quota)
    both = save(links.where("a <> b").select("a", "b").unionAll(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    state = nodes.join(low, nodes["node"] == low["a"], "left").select("node", F.least("node", F.coalesce("low", "node")).alias("anchor"))
    dealt, start, at = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(max(1, sum(quota)))), F.lit(n - 1), sum(quota)
    for s in reversed(range(n)):
        start, at = F.when(dealt >= at, start).otherwise(s), at - quota[s]
    state = save(state.withColumns({"minimum": F.col("anchor") == F.col("node"), "bucket": F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int"), "shard": start.cast("int")}), "state")
    idle = 0
    for r in range(rounds):
        load = dict(state.groupBy("shard").count().collect())
        load = [load.get(s, 0) for s in range(n)]
        turn = F.col("minimum") == (F.pmod(F.xxhash64("anchor", F.lit(r)), F.lit(2)) == 1)
        there = state.select(F.col("node").alias("b"), F.col("shard").alias("to"))
        votes = both.join(there, "b").groupBy("a", "to").count()
        asks = votes.join(state.where(turn), votes["a"] == state["node"])
        best = asks.groupBy("node").agg(F.max(F.struct("count", (F.col("to") == F.col("shard")).alias("stay"), (-F.col("to")).alias("minus"), "shard", "bucket", "to")).alias("m"))
        best = save(best.select("node", "m.shard", "m.bucket", "m.to").where("to <> shard"), "asks")
        asked = best.groupBy("shard", "to", "bucket").count().collect()
        weight: dict[tuple[int, int], int] = {}
        for x in asked:
            weight[x["to"], x["bucket"]] = weight.get((x["to"], x["bucket"]), 0) + x["count"]
        granted = []
        for x in sorted(asked, key=lambda x: (-weight[x["to"], x["bucket"]], x["to"], x["bucket"], -x["count"], x["shard"])):
            if load[x["to"]] + x["count"] <= quota[x["to"]]:
                load[x["to"]] += x["count"]
                load[x["shard"]] -= x["count"]
                granted.append((x["shard"], x["to"], x["bucket"]))
        done = set(granted)
        granted += exchanges([(x["shard"], x["to"], x["bucket"], x["count"]) for x in asked if (x["shard"], x["to"], x["bucket"]) not in done])
        if not granted:
            forget(best)
            idle += 1
            if idle == 3:
                break
            continue
        idle = 0
        leave = spark.createDataFrame(granted, "shard int, to int, bucket int")
        moves = best.join(F.broadcast(leave), ["shard", "to", "bucket"]).select("node", "to")  # at most n * n * buckets rows
        after = save(state.join(moves, "node", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "state")
        forget(state)
        forget(best)
        state = after
    forget(both)
    return state.select("node", "shard")


def _cut_large(linked: DataFrame, large: list[tuple[bytes, int]], quota: list[int]) -> tuple[DataFrame | None, list[int]]:
    """Groups larger than a shard: (node, shard), by the share of the group's hashes that each shard takes; what is left of
    the quotas. Shards are filled to 95 percent, as hashes fall unevenly, unless these groups need more."""
    if not large:
        return None, quota
    level = max(0.95, sum(n for _, n in large) / max(1, sum(quota)))
    room, s, cuts = [q * level for q in quota], 0, []
    for g, n in large:
        left = float(n)
        while left > 1e-9:
            take = min(left, room[s]) if s < len(room) - 1 else left
            left, room[s] = left - take, room[s] - take
            cuts.append((g, 1 - left / n, s))
            s += room[s] <= 1e-9 and s < len(room) - 1
    spark = linked.sparkSession
    table_ = spark.createDataFrame(cuts, "g binary, upto double, shard int").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("cuts"))
    share = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    at = F.get(F.filter("cuts", lambda c: share < c["upto"]), F.lit(0))
    spread = save(linked.join(F.broadcast(table_), "g").select("node", F.coalesce(at["shard"], F.lit(len(quota) - 1)).alias("shard")), "large")  # large: below the number of shards
    taken = dict(spread.groupBy("shard").count().collect())
    return spread, [max(0, q - taken.get(k, 0)) for k, q in enumerate(quota)]


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("g"))
    rows = save(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = save(rows.select("node", "g").join(groups, "g").select("node", "g", "n"), "linked")
    large = groups.where(F.col("n") > quota[-1]).orderBy(F.desc("n"), "g").collect()  # fewer than there are shards
    spread, quota_left = _cut_large(linked.where(F.col("n") > quota[-1]), [(bytes(r["g"]), r["n"]) for r in large], quota)
    small = linked.where(F.col("n") <= quota[-1])
    hubs = small.groupBy("g").agg(F.min("node").alias("hub"))
    links = small.join(hubs, "g").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    placed = propagate(small.select("node"), links, quota_left, rounds)
    if spread is not None:
        placed = placed.unionByName(spread)
    # ranks without a window over all rows of a shard: within ranges of hashed nodes, plus the counts of the ranges before
    ranges = max(1, total // ROWS_A_RANK)
    kind = rows.join(placed, "node", "left").select("node", "doc_id", "size", "text_crc32", F.coalesce("shard", F.lit(-1)).alias("kind"), F.pmod(F.xxhash64("node", F.lit(9)), F.lit(ranges)).cast("int").alias("rng"))
    kind = save(kind, "kinds")
    counts = kind.groupBy("kind", "rng").count()
    before = counts.select("kind", "rng", F.coalesce(F.sum("count").over(Window.partitionBy("kind").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = kind.withColumn("i", F.row_number().over(Window.partitionBy("kind", "rng").orderBy("node"))).join(before, ["kind", "rng"])
    ranked = ranked.select("doc_id", "size", "text_crc32", "kind", (F.col("i") - 1 + F.col("before")).alias("rank"))
    load = dict(kind.groupBy("kind").count().collect())
    over, fill = load.get(-1, 0), F.when(F.col("kind") == -1, F.col("rank"))
    for s in range(shards):  # beyond its quota a shard's documents become ballast
        fill = fill.when((F.col("kind") == s) & (F.col("rank") >= quota[s]), F.col("rank") - quota[s] + over)
        over += max(0, load.get(s, 0) - quota[s])
    ranked = ranked.withColumn("fill", fill)
    shard, slot, at = F.when(F.col("fill").isNull(), F.col("kind")), F.when(F.col("fill").isNull(), F.col("rank")), 0
    for s in range(shards):
        taken = min(load.get(s, 0), quota[s])
        end = at + quota[s] - taken
        shard = shard.when(F.col("fill") < end, s)
        slot = slot.when(F.col("fill") < end, F.col("fill") - at + taken)
        at = end
    return ranked.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
