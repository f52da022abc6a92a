"""Sharding by Karmarkar-Karp differencing: indivisible groups go to shards of near-equal bytes.

A partial partition is a tuple of shard sums. Differencing repeatedly takes the two with the largest spread and adds them
in opposite order. It applies to partial partitions as well as to single groups, so it runs as a tree: each task reduces
a bounded number of groups to one partial partition, tasks of the next levels combine a bounded number of those, and the
driver the last ones.

Defined results: null texts count as empty; equal texts form one group and share a shard (a group above an even share
cannot be divided, the others then even out around it); repeated rows each get a slot; an empty table gives an empty
table; other columns are ignored, whatever their names. Ties are broken by the group's hash.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsieve.llm.common import Scratch, documents, materialise, partitions, text_key

#: Groups that one task differences, about, and partial partitions that are combined together.
BUCKET, FAN = 50_000, 5_000


def difference(parts: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions (lists of k sums). Returns for each the shard of each of its positions, and the sums."""
    if not parts:
        return [], []
    k = len(parts[0])
    nodes: list[tuple] = []  # leaf: (order,); inner: (left, right, order), order[j] = position before sorting
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda j: -sums[j])
        nodes.append((order,))
        heap.append((sums[order[-1]] - sums[order[0]], i, [sums[j] for j in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [x + y for x, y in zip(left, reversed(right), strict=True)]
        order = sorted(range(k), key=lambda j: -sums[j])
        nodes.append((a, b, order))
        heapq.heappush(heap, (sums[order[-1]] - sums[order[0]], len(nodes) - 1, [sums[j] for j in order]))
    place: list = [None] * len(nodes)
    place[heap[0][1]] = list(range(k))
    for i in range(len(nodes) - 1, -1, -1):
        order, sorted_place = nodes[i][-1], place[i]
        own = [0] * k
        for j, was in enumerate(order):
            own[was] = sorted_place[j]
        if len(nodes[i]) == 3:
            place[nodes[i][0]], place[nodes[i][1]] = own, own[::-1]
            place[i] = None
        else:
            place[i] = own
    return place[: len(parts)], heap[0][2]


def _combined(shards: int):
    """Of the partial partitions of one parent: where each of their positions goes, with its bytes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="bucket", columns="local", values="total").reindex(columns=range(shards)).fillna(0).astype("int64").sort_index()
        place, _ = difference(wide.to_numpy().tolist())
        to = {(b, j): s for b, own in zip(wide.index, place, strict=True) for j, s in enumerate(own)}
        return frame.assign(to=[to[x] for x in zip(frame["bucket"], frame["local"], strict=True)])

    return run


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """Per row: the id column, size (UTF-8 bytes plus 1), text_crc32, shard and slot (gapless from 0 in each shard).

    Equal texts are counted before any shuffle of groups; the copies of a hot group meet their shard in a join that
    adaptive execution splits. Slots come from counts per (shard, hash chunk), so no task numbers a whole shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text_key(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    scratch = Scratch()
    groups = scratch(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    count = groups.count()
    buckets = max(partitions(spark), -(-count // bucket))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        place, _ = difference([[int(b)] + [0] * (shards - 1) for b in frame["bytes"]])
        return pd.DataFrame({"bucket": frame["bucket"], "key": frame["key"], "bytes": frame["bytes"], "local": [p[0] for p in place]})

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    placed = scratch(dealt.groupBy("bucket").applyInPandas(local, "bucket int, key binary, bytes long, local int"))
    sums = placed.groupBy("bucket", "local").agg(F.sum("bytes").alias("total"))
    levels = []
    while buckets > fan:
        buckets = -(-buckets // fan)
        up = sums.withColumn("up", F.pmod(F.xxhash64("bucket", F.lit(len(levels))), F.lit(buckets)).cast("int"))
        step = scratch(up.groupBy("up").applyInPandas(_combined(shards), "bucket int, local int, total long, up int, to int"))
        levels.append(step.select("bucket", "local", "up", "to"))
        sums = step.groupBy(F.col("up").alias("bucket"), F.col("to").alias("local")).agg(F.sum("total").alias("total"))
    last: dict[int, list[int]] = {}
    for name, where, total in sums.collect():  # fan * shards rows at most
        last.setdefault(name, [0] * shards)[where] = total
    names = sorted(last)
    merged, _ = difference([last[b] for b in names])
    moves = F.broadcast(spark.createDataFrame(
        [(b, j, s) for b, place in zip(names, merged, strict=True) for j, s in enumerate(place)] or [(0, 0, 0)], "bucket int, local int, shard int"
    ))
    for step in reversed(levels):
        above = moves.select(F.col("bucket").alias("up"), F.col("local").alias("to"), "shard")
        moves = step.join(above, ["up", "to"]).select("bucket", "local", "shard")
    homes = placed.join(moves, ["bucket", "local"]).select("key", "shard")
    chunk = F.pmod(F.xxhash64("id", "key"), F.lit(4 * max(partitions(spark), -(-count // bucket)))).cast("int")
    dealt = materialise(rows.join(homes, "key").withColumn("chunk", chunk))
    scratch.drop()
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "key")) - 1
    return (
        dealt.withColumn("nth", nth)
        .join(firsts, ["shard", "chunk"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
