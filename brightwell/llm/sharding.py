"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Rows with equal texts form an indivisible group. Groups are dealt by hash into buckets; each
bucket is differenced into as many bundles as there are shards, and the bundles, beside the few
groups too large for a bucket, are differenced again until few enough remain for one last,
exact run of the same method. Only sums travel: a group is one row whatever its number of
copies, and no text is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightwell.llm.shared import drop_path, written

#: Items that the last run takes at most, and groups that one bucket takes in a usual table.
LAST_ITEMS, BUCKET_ITEMS = 16_384, 256


def difference(sizes: list[int], n_shards: int) -> list[int]:
    """Shard of each item: combine the two partial partitions of largest spread, oppositely ordered.

    Deterministic: ties go to the partial partition made first. O(n (log n + k log k)).
    """
    if not sizes:
        return []
    # A partial partition: sums in descending order, with the tree node of each part.
    heap: list[tuple] = []
    parent: list[int] = []  # union of parts as a forest over nodes: items first, then joined parts

    def node() -> int:
        parent.append(-1)
        return len(parent) - 1

    for i in range(len(sizes)):
        node()
    order = 0
    for i, x in enumerate(sizes):
        heap.append((-x, order, [(x, i)] + [(0, -1)] * (n_shards - 1)))
        order += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = []
        for (x, p), (y, q) in zip(a, reversed(b), strict=True):
            if p < 0 or q < 0:
                parts.append((x + y, max(p, q)))
            else:
                top = node()
                parent[p] = parent[q] = top
                parts.append((x + y, top))
        parts.sort(key=lambda t: -t[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), order, parts))
        order += 1
    shard_of = [0] * len(parent)
    for s, (_, top) in enumerate(heap[0][2]):
        if top >= 0:
            shard_of[top] = s
    for v in range(len(parent) - 1, -1, -1):
        if parent[v] >= 0:
            shard_of[v] = shard_of[parent[v]]
    return shard_of[: len(sizes)]


def _bundle(n_shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets arrive in order; each is held whole, and is of bounded size."""
        waiting: list[pd.DataFrame] = []

        def flush():
            pdf = pd.concat(waiting).sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
            waiting.clear()
            part = difference(pdf["bytes"].tolist(), n_shards)
            return pd.DataFrame({"item": pdf["item"], "bundle": pdf["bucket"].to_numpy() * n_shards + part, "bytes": pdf["bytes"]})

        for batch in batches:
            for _, piece in batch.groupby("bucket", sort=False):
                if waiting and waiting[0]["bucket"].iloc[0] != piece["bucket"].iloc[0]:
                    yield flush()
                waiting.append(piece)
        if waiting:
            yield flush()

    return run


def assign_groups(groups: DataFrame, n_shards: int, last_items: int = LAST_ITEMS, bucket_items: int = BUCKET_ITEMS) -> tuple[DataFrame, list[str]]:
    """Shard of each group of (item binary, bytes long): (item, shard), and the paths written.

    bucket_items grows with the table so that a level divides the items by at least
    bucket_items / n_shards; levels follow until last_items remain. Groups of over
    1/last_items of all bytes, fewer than last_items, pass to the last run as they are.
    """
    spark, paths, levels = groups.sparkSession, [], []
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    items, big = groups.select(F.hex("item").alias("item"), "bytes"), None
    level = 0
    while count > last_items or level == 0:
        limit = max(1, total // last_items)
        large = items.where(F.col("bytes") > limit)
        big = large if big is None else big.unionByName(large)
        per = max(bucket_items, min(50_000, -(-count // (last_items // n_shards // 2))))
        n_buckets = max(1, -(-count // per))
        small = items.where(F.col("bytes") <= limit).withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(n_buckets)))
        tied = small.repartition(min(n_buckets, 100_000), "bucket").sortWithinPartitions("bucket").mapInPandas(_bundle(n_shards), "item string, bundle long, bytes long")
        tied, path = written(tied, "shard-level")
        paths.append(path)
        levels.append(tied.select(F.col("item"), F.concat(F.lit(f"L{level}:"), "bundle").alias("bundle")))
        items = tied.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).select(F.concat(F.lit(f"L{level}:"), "bundle").alias("item"), "bytes")
        count = items.count()
        level += 1
    # Each level passes on fewer than last_items large groups; the last run's size is bounded.
    last = items.unionByName(big).orderBy(F.desc("bytes"), "item").collect()
    shard = difference([r["bytes"] for r in last], n_shards)
    known = spark.createDataFrame([(r["item"], s) for r, s in zip(last, shard, strict=True)], "item string, shard int")
    deeper = None
    for pairs in reversed(levels):
        placed = known if deeper is None else deeper.unionByName(known)
        deeper = pairs.join(placed.withColumnsRenamed({"item": "bundle"}), "bundle").select("item", "shard")
    whole = known.where(~F.col("item").startswith("L")) if deeper is None else deeper.unionByName(known.where(~F.col("item").startswith("L")))
    return whole.select(F.unhex("item").alias("item"), "shard"), paths


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    Size is UTF-8 bytes plus 1. A null text counts as the empty text and is in its group. Rows
    that repeat each get a slot of their own; a null id is a row like any other. An empty table
    gives an empty table. Slots count from 0 without gaps within a shard, by id and checksum:
    numbered within hash buckets, then moved up by the buckets before, so that no task takes a
    whole shard. Other columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("item"),
    )
    rows, rows_at = written(rows, "shard-rows")
    n_rows = rows.count()
    groups, groups_at = written(rows.groupBy("item").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed, _ = assign_groups(groups, n_shards)
    placed = rows.join(placed, "item").drop("item")
    n_buckets = max(64, n_rows // 200_000)
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    placed, placed_at = written(placed.withColumn("bucket", F.pmod(spread, F.lit(n_buckets)).cast("int")), "shard-placed")
    drop_path(docs.sparkSession, groups_at)
    # One row for each shard and bucket: the buckets' counts, summed up in order.
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")) - 1
    numbered = placed.withColumn("number", number).join(before, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
