"""Exact deduplication through an extendible-hash index on shared files. DataFrame functions only.

Index entries (hash key, digest, lengths) are written to the shared folder. A directory over the leading bits of the key
doubles, and splits the overfull buckets, until none holds more distinct keys than its capacity. The rows of repeated
keys are dealt out by bucket: the task that owns a bucket has the chains of its keys and compares their texts byte for
byte. A chain longer than `chain_rows` rows is cut in parts that may have owners of their own; what the parts
found is compared again, one entry for each text and task.

Defined results: a null text equals the empty one; rows that repeat a doc_id are rows of their own, of
which one stays; a null doc_id loses ties against any other, and of rows equal in id and length the first read stays; a
very long text is one row like any other; an empty table gives an empty result; further columns of the input, whatever
their names, play no part.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, numbered, text_of, without_rows, without_space, written

#: The directory never has more slots than 2 ** MAX_DEPTH, so it can be sent to every task. Capacities follow the number
#: of keys, MOST_BUCKETS being aimed at beyond LEAST_CAPACITY keys each, so that depth is not reached.
MAX_DEPTH, MOST_BUCKETS, LEAST_CAPACITY = 16, 8192, 500


def directory(cells: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """(global depth, bucket of each slot). cells: distinct keys by their leading max_depth bits."""
    width = 1 << max_depth
    below = [0] * (width + 1)
    for cell in range(width):
        below[cell + 1] = below[cell] + cells.get(cell, 0)
    depth, slots = 0, [0]
    todo, buckets = [(0, 0, 0)], 1  # (bucket, local depth, leading bits)
    while todo:
        bucket, d, bits = todo.pop()
        step = width >> d
        if d >= max_depth or below[(bits + 1) * step] - below[bits * step] <= capacity:
            continue
        if d == depth:  # the directory doubles
            slots, depth = [b for b in slots for _ in (0, 1)], depth + 1
        run = 1 << depth - d - 1  # the slots of each half
        first = (2 * bits + 1) * run
        slots[first : first + run] = [buckets] * run
        todo += [(bucket, d + 1, 2 * bits), (buckets, d + 1, 2 * bits + 1)]
        buckets += 1
    return depth, slots


def owned(normal: DataFrame, keys: DataFrame, capacity: int | None = None, chain_rows: int = 64) -> DataFrame:
    """The rows of normal (key, normal, ...) whose key repeats in keys (key, n), by the owner of their bucket and chain part."""
    spark = normal.sparkSession
    cell = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    cells = {r["cell"]: r["n"] for r in keys.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 ** MAX_DEPTH rows at most
    depth, slots = directory(cells, capacity or max(LEAST_CAPACITY, -(-sum(cells.values()) // MOST_BUCKETS)))
    slot_rows = F.from_json(F.lit(json.dumps([{"slot": i, "bucket": b} for i, b in enumerate(slots)])), "array<struct<slot:bigint,bucket:bigint>>")
    lookup = spark.range(1).select(F.inline(slot_rows))
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    chains = keys.where("n > 1").select("key", "n", slot.alias("slot"), F.ceil(F.col("n") / chain_rows).alias("parts"))
    chains = written(chains.join(F.broadcast(lookup), "slot").select("key", "n", "bucket", "parts"), "chains")
    members = hot_join(normal.withColumn("at", F.monotonically_increasing_id()), chains.drop("n"), "key", "inner", chains)  # a hot text's rows go to their parts at once
    return members.withColumn("part", F.pmod("at", "parts")).drop("at", "parts").repartition("bucket", "part")


def _groups(base: DataFrame, capacity: int | None, chain_rows: int = 64) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256 for each row of base (row, doc_id, text)."""
    normal = base.select("row", "doc_id", F.char_length("text").alias("n_cp"), without_space(F.col("text")).alias("normal"))
    entries = written(normal.select("row", "doc_id", "n_cp", F.xxhash64("normal").alias("key"), F.sha2("normal", 256).alias("text_sha256")), "entries")
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    members = owned(normal.drop("row").withColumn("key", F.xxhash64("normal")), keys, capacity, chain_rows)
    best = F.struct("n_cp", (-F.col("doc_id")).alias("less"))
    # The owner's partitioning is kept: equal texts of a part are found where they are.
    found = members.groupBy("bucket", "part", "key", "normal").agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("best"))
    groups = found.groupBy("bucket", "key", "normal").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    groups = written(groups.select("key", F.sha2("normal", 256).alias("text_sha256"), "group_size", F.col("best.n_cp").alias("keep_cp"), (-F.col("best.less")).alias("keep_id")), "groups")

    on = ["key", "text_sha256"]
    repeated = groups.select(*on, F.col("group_size").alias("n"))
    stay = hot_join(entries, groups, on, "inner", repeated).where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))).groupBy(*on).agg(F.min("row").alias("keep_row"))
    groups = written(groups.join(stay, on), "stay")
    alone = F.col("keep_row").isNull()
    return hot_join(entries, groups, on, "left", repeated).select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def exact_groups(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row: of equal texts, the longest original stays."""
    return _groups(text_of(docs).withColumn("row", F.monotonically_increasing_id()), capacity).drop("row")


def exact_dedup(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """The rows that stay, as they were; a row without doc_id stays if its text stands alone."""
    rows = numbered(docs)
    groups = _groups(text_of(rows.select("__row", "__doc.doc_id", "__doc.text"), "__row").withColumnRenamed("__row", "row"), capacity)
    return without_rows(rows, written(groups.where(~F.col("kept")).select(F.col("row").alias("__row")), "dropped"))


#: DuckDB SQL for the rows of exact_groups.
SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n_cp DESC, doc_id) AS keep_id FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
