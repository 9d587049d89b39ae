"""Resharding by minimum-cost flow.

Old shard sizes are supplies, new capacities are demands, and a byte that stays costs nothing.
The flow says how many bytes go from each old shard to each new one. Large rows are dealt out first,
each along the flow to the shard that lacks most; small rows then fill what is left of the flow,
by their place in a fixed order of each old shard, so that a transfer is a stretch of blocks.
The driver sees sizes of blocks and of large rows, whose numbers are bounded, and no other row.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cairn.llm.common import scratch, stored

#: Blocks of an old shard. More make smaller tasks; the result stays near equal with any number.
BLOCKS = 512
#: A row is large from this share of a shard on, and there are at most so many large ones.
LARGE, MOST_LARGE = 1024, 1 << 18


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest whole flow from supplies to demands of the same sum, by successive shortest paths.

    cost(i, j): cost of a unit from supply i to demand j, 0 or more. Returns the flows over 0.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    m, n = len(supply), len(demand)
    left, need, flow = list(supply), list(demand), {}
    price = [0] * (m + n)
    while any(left):
        # Dijkstra from all supplies with something left, over reduced costs.
        dist, back = [None] * (m + n), [None] * (m + n)
        heap = [(0 - price[i], i) for i in range(m) if left[i]]
        base = min((d for d, _ in heap), default=0)
        heap = [(d - base, v) for d, v in heap]
        for d, v in heap:
            dist[v] = d
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            if v < m:
                edges = [(m + j, cost(v, j)) for j in range(n)]
            else:
                edges = [(i, -cost(i, v - m)) for i in range(m) if flow.get((i, v - m))]
            for w, c in edges:
                e = d + c + price[v] - price[w]
                if dist[w] is None or e < dist[w]:
                    dist[w], back[w] = e, v
                    heapq.heappush(heap, (e, w))
        far = max(d for d in dist if d is not None)
        price = [p + (far if d is None else d) for p, d in zip(price, dist, strict=True)]
        end = min((m + j for j in range(n) if need[j] and dist[m + j] is not None), key=lambda v: (dist[v], v))
        path = [end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:], strict=False))
        amount = min([left[path[0]], need[end - m], *(flow[b, a - m] for a, b in steps if a >= m)])
        for a, b in steps:
            key, sign = ((a, b - m), 1) if a < m else ((b, a - m), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[path[0]] -= amount
        need[end - m] -= amount
    return {k: v for k, v in flow.items() if v}


def plan_transfers(old: list[int], shards: int, cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes to go from each old shard to each new one so that new sizes differ by a byte at most."""
    each, more = divmod(sum(old), shards)
    return min_cost_flow(old, [each + (j < more) for j in range(shards)], cost)


def deal_large(sizes: list[tuple[int, int]], flow: dict[tuple[int, int], int]) -> tuple[list[int], dict[tuple[int, int], int]]:
    """New shards of rows (old shard, size), largest first, and what is left of the flow.

    A row goes along the transfer of its old shard with most left, of equals to its own shard. What
    it has beyond that transfer is taken from the ones with most left, so that new sizes change
    by no more than that.
    """
    left: dict[int, dict[int, int]] = {}
    for (i, j), v in flow.items():
        left.setdefault(i, {})[j] = v
    to = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k][1], sizes[k][0], k)):
        i, size = sizes[k]
        mine = left[i]
        to[k] = j = max(mine, key=lambda b: (mine[b], b == i, -b))
        while size and mine[j]:
            taken = min(size, mine[j])
            mine[j] -= taken
            size -= taken
            j = max(mine, key=lambda b: (mine[b], b == i, -b))
    return to, {(i, j): v for i, mine in left.items() for j, v in mine.items() if v}


def reshard(rows: DataFrame, shards: int, size: Column, old: Column, order: Column, blocks: int = BLOCKS) -> DataFrame:
    """One row for each of rows: row (all its columns, as a struct), size, old, shard and slot; the fewest bytes move.

    size: bytes of a row, 1 or more; old: its old shard, from 0; order: a long that spreads rows
    evenly, the place within an old shard. A small row goes where its middle byte goes, so that
    shards are off by half a small row, under 1/2048 of a shard, for each transfer that they take
    part in, and by what large rows force. Slots of a shard have no gaps. Equal rows are dealt
    out like others; an empty table stays empty.
    """
    spark = rows.sparkSession
    with scratch(spark):
        hashed = rows.select(F.struct(*rows.columns).alias("row"), size.alias("size"), old.alias("old"), order.alias("order"))
        hashed = stored(hashed.withColumn("h", F.pmod("order", F.lit(blocks)).cast("int")), "rows")
        totals = {r["old"]: r["b"] for r in hashed.groupBy("old").agg(F.sum("size").alias("b")).collect()}
        if not totals:
            return stored(hashed.select("row", "size", "old", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")), "placed", keep=True)
        olds = [totals.get(i, 0) for i in range(1 + max(totals))]
        flow = plan_transfers(olds, shards)
        bound = max(1, -(-sum(olds) // min(shards * LARGE, MOST_LARGE)))

        # Equal rows have equal ranks among themselves in any order of them.
        ranked = Window.partitionBy("old").orderBy(F.desc("size"), "order")
        large = hashed.filter(F.col("size") > bound).withColumn("rank", F.row_number().over(ranked))
        known = large.select("old", "rank", "size").collect()
        to, flow = deal_large([(r["old"], r["size"]) for r in known], flow)
        dealt = spark.createDataFrame([(r["old"], r["rank"], j) for r, j in zip(known, to, strict=True)], "old int, rank int, shard int")
        large = large.join(F.broadcast(dealt), ["old", "rank"]).select("row", "size", "old", F.lit(-1).alias("block"), "shard", F.col("rank").cast("long").alias("before"))

        small = hashed.filter(F.col("size") <= bound)
        stats = small.groupBy("old", "h").agg(F.sum("size").alias("b")).collect()
        starts, at = [], {}
        for r in sorted(stats, key=lambda r: (r["old"], r["h"])):
            starts.append((r["old"], r["h"], at.get(r["old"], 0)))
            at[r["old"]] = at.get(r["old"], 0) + r["b"]
        cuts = []
        for i in range(len(olds)):
            # Large rows may have taken more than their transfers had; the last cut takes all that is there.
            targets = sorted((j for a, j in flow if a == i), key=lambda j, i=i: (j != i, j)) or [min(i, shards - 1)]
            low = 0
            for j in targets:
                high = at.get(i, 0) + 1 if j == targets[-1] else low + flow[i, j]
                cuts.append((i, j, low, high))
                low = high
        where = spark.createDataFrame(starts, "old int, h int, start long")
        ways = spark.createDataFrame(cuts, "old int, shard int, low long, high long")
        within = Window.partitionBy("old", "h").orderBy("order", "size")
        before = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        small = small.withColumn("before", before).join(F.broadcast(where), ["old", "h"]).withColumn("middle", F.col("start") + F.col("before") + F.floor(F.col("size") / 2))
        small = small.join(F.broadcast(ways), "old").filter("middle >= low AND middle < high").select("row", "size", "old", F.col("h").alias("block"), "shard", "before")

        counted = Window.partitionBy("old", "block", "shard").orderBy("before")
        placed = small.unionByName(large).withColumn("n", F.row_number().over(counted) - 1)
        placed = stored(placed.select("row", "size", "old", "block", "shard", "n"), "placed", keep=True)
        firsts, seen = [], {}
        for r in sorted(placed.groupBy("shard", "old", "block").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["shard"], r["old"], r["block"])):
            firsts.append((r["shard"], r["old"], r["block"], seen.get(r["shard"], 0)))
            seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
        first = spark.createDataFrame(firsts, "shard int, old int, block int, first long")
        out = placed.join(F.broadcast(first), ["shard", "old", "block"])
        return out.select("row", "size", "old", "shard", (F.col("first") + F.col("n")).cast("long").alias("slot"))


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def reshard_files(source: DataFrame, out: str, shards: int, old: str = "shard") -> dict[int, str]:
    """Rewrites the shards of a table that gain or lose rows; returns where each affected shard is.

    source has doc_id, text and the column `old` (int). Shards that the result does not name keep
    their files. Rewritten rows have the column `old` anew and slot, which a column of source of
    that name gives way to. A lost task writes its files again; nothing of source is deleted.
    """
    order = F.xxhash64(F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    with scratch(source.sparkSession):
        done = reshard(source, shards, text_bytes(), F.col(old), order)
        moves = done.filter("old != shard").select("old", "shard").distinct().collect()
        touched = sorted({x for r in moves for x in r})
        if touched:
            kept = [F.col("row")[c].alias(c) for c in source.columns if c.lower() not in (old.lower(), "slot")]
            rows = done.filter(F.col("shard").isin(touched)).select(*kept, "slot", F.col("shard").alias(old))
            rows.repartition(max(1, len(touched) * 4), old, F.pmod("slot", F.lit(4))).write.partitionBy(old).parquet(out)
    return {s: f"{out}/{old}={s}" for s in touched}


#: The layout that op1 starts from: 12 shards by a hash of the rows.
OLD_SHARDS, NEW_SHARDS = 12, 16


def op1(documents: DataFrame) -> DataFrame:
    """All rows with the shard (0 to 15) and slot that they go to, under the law `bytes`.

    Null ids and texts are rows like others; repeated rows each have a slot; an empty table gives no
    rows. Columns beyond doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), text_bytes().alias("size"))
    order = F.xxhash64("doc_id", "text_crc32", "size")
    old = F.pmod(F.shiftright(order, 32), F.lit(OLD_SHARDS)).cast("int")
    done = reshard(rows, NEW_SHARDS, F.col("size"), old, order)
    return done.select(
        "row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"), F.col("old").alias("old_shard")
    )
