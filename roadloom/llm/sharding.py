"""Operator 10: shards by balanced label propagation.

Documents that share a hub (here: the same text) are linked.  From a seeded even start, each round joins the links with the bytes that each hub has
in each shard, and documents ask for the shard that holds most of their neighbours, of those with room for the rest of them.  Capacity bounds what moves:
buckets of hubs go to their shard as long as it has room, what leaves it and all unlinked documents counting as room, and one that doesn't fit holds up
no other.  Rounds end when nothing is split, or twice running nothing fits.  A last pass evens out the sizes, with unlinked documents first, since
moving them cuts no link.  DataFrame operations only; what reaches the driver is one number for each pair of shards.

Defined cases: a null text has size 1 (like an empty one), checksum 0 and no links; an empty text is a text like any other; repeated rows are rows of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import bucket_bits, held, join_hot, running, table

SEED, ROUNDS, SLACK = 17, 8, 0.01
#: Movers to a shard are let through by the first bits of a hash of their hub, so many at once.
BUCKET_BITS = 9


def documents_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, size, text_crc32, h) and links (row, hub): documents with equal texts share a hub, single texts have none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = held(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(SEED), "text").alias("b"))).alias("key"),
            F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text")), 1).alias("h"),
        )
    )
    shared = rows.where("key is not null").groupBy("key").count().where("count > 1").select("key", F.xxhash64("key").alias("hub"))
    links = join_hot(rows.where("key is not null").select("row", "key"), shared, ["key"]).select("row", "hub")
    return rows.drop("key"), links


def _let_through(steps: list, size: list[int], capacity: float) -> list[tuple[int, int]]:
    """The (to, bucket) that move: those that their target has room for, with what leaves it making room; one that doesn't fit holds up no other."""
    moves: dict[tuple[int, int], list] = {}
    for r in steps:
        moves.setdefault((r["to"], r["bucket"]), []).append(r)
    size, out, left = list(size), [], sorted(moves, key=lambda m: (m[1], m[0]))
    while left:
        waiting = []
        for to, bucket in left:
            n = sum(r["n"] for r in moves[to, bucket])
            if size[to] + n > capacity:
                waiting.append((to, bucket))
                continue
            size[to] += n
            for r in moves[to, bucket]:
                size[r["shard"]] -= r["n"]
            out.append((to, bucket))
        if len(waiting) == len(left):
            break
        left = waiting
    return out


def _by_shard(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row a shard
    return [found.get(k, 0) for k in range(shards)]


def propagate(rows: DataFrame, links: DataFrame, shards: int = 8, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """rows (row, size, h, ...) and links (row, hub) to rows with `shard` and `linked`.  A row may have several hubs."""
    member = held(links.groupBy("row").agg(F.min("hub").alias("first")))
    start = rows.join(member, "row", "left").withColumn("linked", F.col("first").isNotNull())
    state = held(start.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED + 1), "h", "row"), F.lit(shards)).cast("int")))
    total = sum(_by_shard(state, shards))
    linked = held(links.join(rows.select("row", "size", "h"), "row"))
    now = held(state.where("linked").select("row", "shard"))
    linked_size = _by_shard(state.where("linked"), shards)
    # unlinked rows make room afterwards; beyond the mean, linked ones would have to go again
    capacity = max(total / shards, (1 + slack) * sum(linked_size) / shards)
    idle = 0
    for turn in range(rounds):
        placed = linked.join(now, "row")
        # bytes of each hub in each shard: partial sums come first, so a hot hub is a few rows for each task
        held_by = placed.groupBy("hub").agg(*(F.sum(F.when(F.col("shard") == k, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(shards)))
        score = join_hot(placed, held_by, ["hub"]).groupBy("row").agg(F.first("size").alias("size"), F.first("shard").alias("shard"), F.min("hub").alias("first"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(shards)))
        # most bytes win among the shards with room for the others; ties by an order of the shards that the hub decides, so both ends of a link ask for the same shard
        all_of = sum((F.col(f"s{k}") for k in range(1, shards)), F.col("s0"))
        fits = [all_of - F.col(f"s{k}") <= max(0.0, capacity - linked_size[k]) for k in range(shards)]
        best = F.array_max(F.array(*(F.struct(fits[k].alias("f"), F.col(f"s{k}").alias("n"), F.pmod(F.col("first") + k, F.lit(shards)).alias("o"), F.lit(k).alias("k")) for k in range(shards))))["k"]
        # the rows of a hub share a bucket, so they move together; other buckets each round
        bucket = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + turn), "first"), 64 - BUCKET_BITS).cast("int")
        asked = held(score.select("row", "size", "shard", best.alias("to"), bucket.alias("bucket")))
        steps = asked.where("shard != to").groupBy("shard", "to", "bucket").agg(F.sum("size").alias("n")).collect()  # at most shards² * 2**BUCKET_BITS numbers
        if not steps:
            break
        through = _let_through(steps, linked_size, capacity)
        idle = 0 if through else idle + 1
        if idle > 1:
            break
        if through:
            go = F.broadcast(asked.sparkSession.createDataFrame(through, "to int, bucket int").withColumn("go", F.lit(True)))  # at most shards * 2**BUCKET_BITS rows
            now = held(asked.join(go, ["to", "bucket"], "left").select("row", F.when(F.col("go"), F.col("to")).otherwise(F.col("shard")).alias("shard")))
            linked_size = _by_shard(now.join(rows.select("row", "size"), "row"), shards)
    return state.drop("first").withColumnRenamed("shard", "_s").join(now, "row", "left").withColumn("shard", F.coalesce("shard", "_s")).drop("_s")


def cut_links(state: DataFrame, links: DataFrame) -> DataFrame:
    """How many hubs there are, and how many of them have rows in several shards: hubs, cut."""
    each = links.join(state.select("row", "shard"), "row").groupBy("hub").agg((F.min("shard") != F.max("shard")).alias("cut"))
    return each.agg(F.count("*").alias("hubs"), F.count_if("cut").alias("cut"))


def even_out(state: DataFrame, shards: int) -> DataFrame:
    """Moves rows from shards above the mean size to those below it until they differ by about a document; unlinked rows go first."""
    sizes = _by_shard(state, shards)
    mean = sum(sizes) / shards
    over, under = [[k, n - mean] for k, n in enumerate(sizes) if n > mean], [[k, mean - n] for k, n in enumerate(sizes) if n < mean]
    spans: dict[int, list[tuple[float, float, int]]] = {}
    for k, excess in over:
        at = 0.0
        for u in under:
            if (give := min(excess - at, u[1])) > 0:
                spans.setdefault(k, []).append((at, at + give, u[0]))
                at, u[1] = at + give, u[1] - give
    if not spans:
        return state
    # a row's order within its shard: unlinked rows by hash, then the others
    ordered = state.withColumn("_h", F.shiftrightunsigned(F.xxhash64("h"), 2) + F.when(F.col("linked"), F.lit(2**62)).otherwise(F.lit(0)))
    placed = running(ordered, ["shard"], "_h", "row", F.col("size"), "_at", bucket_bits(state.count()))
    to = F.col("shard")
    for k, own in spans.items():
        for low, high, b in own:
            middle = F.col("_at") + F.col("size") / 2
            to = F.when((F.col("shard") == k) & (middle >= low) & (middle < high), F.lit(b)).otherwise(to)
    return placed.withColumn("shard", to.cast("int")).drop("_h", "_at")


def sharded(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, linked, shard and slot (its place in its shard, gapless from 0) for every row of docs."""
    rows, links = documents_of(docs)
    state = held(even_out(propagate(rows, links, shards, rounds, slack), shards))
    slots = running(state, ["shard"], "h", "row", F.lit(1), "slot", bucket_bits(state.count()))
    return slots.select("doc_id", "size", "text_crc32", "linked", "shard", F.col("slot").cast("long").alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
