"""Balanced label propagation: linked documents move towards their neighbours' shards, and counts stay even.

Method. Links are equal texts: each group hangs on its centre. A group of more than a small share of a shard is given
its home before the first round, largest first, in the shard whose room it fills best; it is cut only where no shard has
room for all of it, and then as few parts as the rooms allow go to the shards with most room. There are at most shards /
share such groups, so the driver plans them. All other documents start in what room is left (a numbering by hash), so
counts are at most one apart. In each round every linked document looks, by joins, at its chunk's counts in each shard
and asks for the shard that has most of them. Moves are granted under quotas: as many documents go from shard a to b as
from b to a, first those that asked, then documents without links, which lose nothing. So the law `rows` (counts at
most one apart) holds after each round. The quotas are a table of shards x shards; nothing that grows with the input
is broadcast or collected. Rounds end when none moves a document; cut_edges() tells what links are still cut.

Sizes are bytes of the text in UTF-8 plus 16. Nulls: a null text has no links and the size 16; null ids are documents
like any other. Repeated rows are documents of their own. Very long texts are taken whole; an empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, numbered, own

#: Groups of more than this share of a shard's rows get their home from the driver.
LARGE_SHARE = 0.05


def homes(sizes: list[tuple[str, int]], room: list[int]) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """(group, begin, end, shard) of each part of each group's numbered rows, and the room that is left."""
    left = sorted((n, shard) for shard, n in enumerate(room))
    out = []
    for same, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        begin = 0
        while begin < size:
            # the least room that is enough, else the most there is
            n, shard = left.pop(min(bisect_left(left, (size - begin, -1)), len(left) - 1))
            end = min(size, begin + n)
            out.append((same, begin, end, shard))
            insort(left, (n - (end - begin), shard))
            begin = end
    return out, [n for n, _ in sorted(left, key=lambda x: x[1])]


def start(docs: DataFrame, scratch: Scratch, shards: int) -> DataFrame:
    """(row, doc_id, size, text_crc32, chunk, kin, shard): chunk and kin, the group, are null where a document has no link."""
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.md5(body)).alias("same"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows, "rows")
    total = rows.count()
    groups = scratch.keep(rows.filter("same is not null").groupBy("same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    large = groups.filter(F.col("n") > total / shards * LARGE_SHARE).collect()  # at most shards / LARGE_SHARE rows
    parts, room = homes([(r.same, r.n) for r in large], [total // shards + (k < total % shards) for k in range(shards)])
    plan = F.broadcast(spark.createDataFrame(parts, "same string, begin long, end long, shard int"))
    out = ["row", "doc_id", "size", "text_crc32", "chunk", "kin", "shard"]
    cut = F.broadcast(plan.select("same").distinct())  # at most shards / LARGE_SHARE rows
    order = [F.xxhash64("row"), F.col("row")]
    planned = numbered(rows.join(cut, "same", "left_semi"), ["same"], order, "number", 64)
    planned = planned.join(plan, "same").filter("number >= begin and number < end").withColumn("chunk", F.xxhash64("same", "begin")).withColumn("kin", F.xxhash64("same"))
    small = groups.join(cut, "same", "left_anti").select("same", F.xxhash64("same").alias("chunk"))
    # groups that are left are small, and what has no text needs no group, so no key of this join has many rows
    others = rows.join(cut, "same", "left_anti")
    none = others.filter("same is null").withColumn("chunk", F.lit(None).cast("long"))
    others = others.filter("same is not null").join(small, "same", "left").unionByName(none).withColumn("kin", F.col("chunk"))
    # the others' numbers are dealt by the room; cells of numbers make that a join on equal keys
    width, ends = total // shards + 1, [0]
    for n in room:
        ends.append(ends[-1] + n)
    cells = [(cell, a, b, k) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b for cell in range(a // width, (b - 1) // width + 1)]
    rooms = F.broadcast(spark.createDataFrame(cells, "cell long, begin long, end long, shard int"))
    dealt = numbered(others.select("row", "doc_id", "size", "text_crc32", "chunk", "kin"), [], order, "number", 256)
    dealt = dealt.withColumn("cell", F.floor(F.col("number") / width)).join(rooms, "cell").filter("number >= begin and number < end")
    return scratch.keep(planned.select(out).union(dealt.select(out)), "start")


def wishes(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, shard, wish) of each linked document whose chunk has more of its documents elsewhere."""
    counts = placed.filter("chunk is not null").groupBy("chunk", "shard").agg(F.count(F.lit(1)).alias("n"))
    # a table of its own: Spark splits a chunk of very many rows in a join of two exchanges, not below an aggregate
    best = scratch.keep(counts.groupBy("chunk").agg(F.max_by("shard", F.struct("n", F.xxhash64("chunk", "shard"))).alias("wish")), "best")
    asked = placed.filter("chunk is not null").select("row", "shard", "chunk").join(best, "chunk")
    return asked.filter("shard <> wish").select("row", "shard", "wish")


def quotas(asked: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b, granted, fill_from, fill_to): moves granted from a to b, and which of b's unlinked documents go back to a."""
    n = F.count(F.lit(1))
    flows = asked.groupBy(F.col("shard").alias("a"), F.col("wish").alias("b")).agg(n.alias("x"))
    back = flows.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("x").alias("y"))
    both = flows.join(back, ["a", "b"], "full").na.fill(0, ["x", "y"])
    free = placed.filter("chunk is null").groupBy(F.col("shard").alias("b")).agg(n.alias("free"))
    both = both.join(free, "b", "left").na.fill(0, ["free"]).withColumn("surplus", F.greatest(F.col("x") - F.col("y"), F.lit(0)))
    upto = Window.partitionBy("b").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("end", F.least(F.sum("surplus").over(upto), F.col("free")))
    both = both.withColumn("begin", F.least(F.sum("surplus").over(upto) - F.col("surplus"), F.col("free")))
    return both.select("a", "b", (F.least("x", "y") + F.col("end") - F.col("begin")).alias("granted"), F.col("begin").alias("fill_from"), F.col("end").alias("fill_to"))


def round_of(placed: DataFrame, scratch: Scratch, turn: int) -> tuple[DataFrame, int]:
    """One round: the new table, and how many documents moved."""
    asked = scratch.keep(wishes(placed, scratch), f"asked{turn}")
    limits = scratch.keep(quotas(asked, placed), f"quotas{turn}")  # at most shards x shards rows
    order = [F.xxhash64("row"), F.col("row")]
    ranked = numbered(asked.select("row", F.col("shard").alias("a"), F.col("wish").alias("b")), ["a", "b"], order, "rank", 16)
    granted = ranked.join(F.broadcast(limits.select("a", "b", "granted")), ["a", "b"]).filter("rank < granted").select("row", F.col("b").alias("to"))
    free = numbered(placed.filter("chunk is null").select("row", F.col("shard").alias("b")), ["b"], order, "rank", 64)
    fills = F.broadcast(limits.filter("fill_to > fill_from").select("b", "a", "fill_from", "fill_to"))
    back = free.join(fills, "b").filter("rank >= fill_from and rank < fill_to").select("row", F.col("a").alias("to"))
    moves = scratch.keep(granted.union(back), f"moves{turn}")
    moved = moves.count()
    after = placed.join(moves, "row", "left").withColumn("shard", F.coalesce("to", "shard")).select(placed.columns)
    after = scratch.keep(after, f"placed{turn}")
    scratch.drop(asked, limits, moves)
    return after, moved


def placed_rows(spark: SparkSession, docs: DataFrame, shards: int = 40, rounds: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, size, text_crc32, chunk, kin, shard) after the last round: the first that moves nothing, if `rounds` are enough."""
    scratch = Scratch(spark)
    placed = start(docs.select(own(id_column).cast("long").alias("doc_id"), own(text_column).cast("string").alias("text")), scratch, shards)
    for turn in range(rounds):
        after, moved = round_of(placed, scratch, turn)
        scratch.drop(placed)
        placed = after
        if not moved:
            break
    return placed


def cut_edges(placed: DataFrame) -> DataFrame:
    """One row (links, cut): links of documents to their group's centre, and those that lead to another shard."""
    n = F.count(F.lit(1))
    sizes = placed.filter("kin is not null").groupBy("kin", "shard").agg(n.alias("n")).groupBy("kin").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return sizes.agg(F.coalesce(F.sum(F.col("all") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut"))


def sharded(spark: SparkSession, docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each document; law is `rows`. For options see placed_rows()."""
    placed = placed_rows(spark, docs, shards, **options)
    slots = numbered(placed, ["shard"], [F.xxhash64("row"), F.col("row")], "slot", 64)
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
