"""Sinks: runs side by side, labels that are never overwritten, parts by a predicate, JSON artifacts, caches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_run(df: DataFrame, path: str, run_id: str) -> str:
    """The table as one run of many: earlier runs stay as they are, so no copy is needed before a write."""
    place = f"{path.rstrip('/')}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(place)
    return place


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The run whose id is last in order."""
    runs = spark.read.parquet(path)
    last = runs.agg(F.max("run_id")).first()[0]
    return runs.where(F.col("run_id") == last).drop("run_id")


def write_split(df: DataFrame, path: str, accepted: str) -> None:
    """Accepted and rejected rows from one pass, as parts of one table; the whole is the table itself."""
    df.write.mode("overwrite").partitionBy(accepted).parquet(path)


def read_split(spark: SparkSession, path: str, accepted: str) -> DataFrame:
    """The whole table; the part's name, which is a string on disk, is a boolean again."""
    return spark.read.parquet(path).withColumn(accepted, F.col(accepted).cast("boolean"))


def write_new_only(df: DataFrame, path: str, suffix: str) -> str:
    """Where the table went: path, or path and suffix where there is a table already. Neither is overwritten."""
    place = f"{path}_{suffix}" if exists(df.sparkSession, path) else path
    df.write.mode("errorifexists").parquet(place)
    return place


def write_splits(df: DataFrame, path: str, split: Column) -> DataFrame:
    """The table in parts by split, and rows by split as a small DataFrame."""
    df.withColumn("split", split).write.mode("overwrite").partitionBy("split").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


def write_records(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder for each value of `by` where it is given; numbers stay numbers."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(values, ensure_ascii=False, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_bundle(spark: SparkSession, model, metadata: dict, path: str) -> None:
    """A fitted pipeline and its metadata."""
    model.write().overwrite().save(f"{path}/model")
    write_metadata(spark, metadata, f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str):
    """(fitted pipeline, metadata)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), read_metadata(spark, f"{path}/metadata")


def cached_embeddings(texts: DataFrame, column: str, path: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(digest, embedding) for each distinct text. Only texts that the table at path lacks are embedded and appended.

    embed adds a column `embedding` to (digest, column). A null text counts as empty.
    """
    spark = texts.sparkSession
    text = F.coalesce(F.col(column), F.lit(""))
    asked = texts.select(F.sha2(text, 256).alias("digest"), text.alias(column)).dropDuplicates(["digest"])
    try:
        held = spark.read.parquet(path).select("digest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = asked
    else:
        new = asked.join(held, "digest", "left_anti")
    embed(new).select("digest", "embedding").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(asked.select("digest"), "digest", "left_semi")


def append_checkpoint(rows: DataFrame, path: str, batch: int) -> None:
    """Rows of one batch added to a table; read it back with read_checkpoint."""
    rows.withColumn("__batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row for each key: that of the latest batch, and of equals in it the greatest."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "__batch")]
    last = rows.groupBy(key).agg(F.max(F.struct("__batch", *rest)).alias("last"))
    return last.select(*[F.col(key) if c == key else F.col(f"last.{c}") for c in rows.columns if c != "__batch"])


def write_predictions(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Predictions as CSV with a header, or as JSON lines."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind {kind!r}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def save_index(chunks: DataFrame, path: str) -> None:
    """A vector index: chunk_id, category, subject, content, embedding, metadata as JSON."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", "category", "subject", "content", "embedding")]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    chunks.select("chunk_id", "category", "subject", "content", "embedding", meta.alias("metadata")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; where the session names none (one machine), a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors with folders of their own
            raise ValueError("spark.checkpoint.dir names no shared folder")
        place = "file://" + tempfile.mkdtemp(prefix="cursus-")
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


def run_id() -> str:
    """Eight random hex digits, drawn once on the driver."""
    return uuid.uuid4().hex[:8]


def markdown_report(title: str, facts: dict[str, str], sections: dict[str, list[str]]) -> str:
    """Small results as text; sections without lines are left out."""
    lines = [f"# {title}", "", *[f"- **{k}**: {v}" for k, v in facts.items()]]
    for name, items in sections.items():
        if items:
            lines += ["", f"## {name}", "", *[f"- {i}" for i in items]]
    return "\n".join(lines) + "\n"
