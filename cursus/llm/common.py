"""What the training-data operators share: input normalisation and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract in this subpackage: space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, text) with a null text as the empty one, after the key columns; others, whatever their names, are left out."""
    return docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def without_space(text: Column) -> Column:
    """The text less every white-space character; byte-wise replacement is cheaper than a regex here."""
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine (tests) one of our own where the session names none; on a
    cluster that is an error, as each executor would write to its own disk."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="cursus-")
        spark.sparkContext.setCheckpointDir(place)
    return place


#: The tables that the code now running owns; where no owner is named, tables stay.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, by this thread, go when the block ends, also by an error. Nobody else's are touched."""
    paths: list[str] = []
    before = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(before)
        for path in paths:
            remove(spark, path)


def written_at(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """The table written to the shared folder and read back, and its place: lineage ends there, and each row is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cursus/{name}-{uuid.uuid4().hex}"
    if (paths := _OWNED.get()) is not None:
        paths.append(path)  # first, so that a failed write goes too
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(docs: DataFrame) -> DataFrame:
    """__row, a row key, and __doc, the whole row of docs, so no name of a column of docs can clash; written, so that
    every later reading has the same keys."""
    return written(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")), "rows")


def without_rows(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """The numbered rows but for those of drop (__row), with their own columns. A merge join at every size: what is
    dropped grows with the corpus, and the plan should not change with it."""
    return rows.join(drop.hint("merge"), "__row", "left_anti").select("__doc.*")


def one_per_component(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The numbered rows as they were: of each root's rows in roots (__row, root) the first by doc_id, nulls last,
    then by key; rows that are in no component all stay."""
    ids = rows.select("__row", F.col("__doc.doc_id").cast("long").alias("id")).join(roots, "__row")
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("first"))
    # By row key, so a large component is no burden to a task.
    drop = written(roots.select("__row").join(first.select(F.col("first.__row").alias("__row")), "__row", "left_anti"), "dropped")
    return without_rows(rows, drop)


#: Keys that hold more than one in so many rows are hot, so there are never more hot keys than that; but a key with so few
#: rows is no burden to a task.
HOT_SHARE, HOT_ROWS = 1000, 4096


def hot_join(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """big join small (a row for each key at most), left or inner. The rows of hot keys, at most HOT_SHARE keys, don't move:
    their rows of small are sent to them. counts: (key, n), big's rows by key or by those keys that may be hot, if known."""
    keys = [key] if isinstance(key, str) else key
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    least = max(HOT_ROWS, (sizes["all"] or 0) // HOT_SHARE)
    if (sizes["most"] or 0) <= least:
        return big.join(small, keys, how)
    hot = written(counts.where(F.col("n") > least).select(*keys), "hot")
    few = written(small.join(F.broadcast(hot), keys, "left_semi"), "few")
    rest = big.join(F.broadcast(hot), keys, "left_anti").join(small, keys, how)
    return rest.unionByName(big.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how))
