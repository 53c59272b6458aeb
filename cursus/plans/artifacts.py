"""Queries of what is written and read again, of streams and of fitted models with a known answer, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lessons as O
from ..operators import models as M
from ..operators import practices as P
from ..operators import retrieval as V
from ..operators import statistics as S
from ..sources import remote, sinks
from ..sources.tables import table
from ..streaming.snapshots import windowed_counts
from .catalogue import query


@query("SELECT p_partkey, lpad(CAST(p_size * 70 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_size * 70 % 60 AS VARCHAR), 2, '0') AS clock, CASE p_size % 3 WHEN 0 THEN 'Maths' WHEN 1 THEN 'Physics' ELSE 'History & Geography' END AS subject FROM part")
def clocks_and_subjects(spark, sf_dir):
    given = F.when(F.col("p_size") % 3 == 0, " Mathematics ").when(F.col("p_size") % 3 == 1, "PHYSICS").otherwise("geography")
    return table(spark, sf_dir, "part").select("p_partkey", C.clock(F.col("p_size") * 70).alias("clock"), O.canonical_subject(given).alias("subject"))


@query("SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def json_records_round_trip(spark, sf_dir):
    place = sinks.scratch(spark, "records")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    sinks.write_records(rows, place, by="nation")
    return spark.read.schema("id long, nation int, balance double").json(place)


@query("SELECT o_orderstatus AS split, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share, 'é' || o_orderstatus AS name FROM orders GROUP BY 1")
def metadata_round_trip(spark, sf_dir):
    """The sizes of the orders' splits as metadata of numpy numbers, written as JSON and read again."""
    import numpy as np

    place, rows = sinks.scratch(spark, "meta"), table(spark, sf_dir, "orders").groupBy("o_orderstatus").count().collect()  # a row for each status
    total = sum(r["count"] for r in rows)
    sinks.write_metadata(spark, {r["o_orderstatus"]: {"n": np.int64(r["count"]), "share": np.float64(r["count"] / total), "name": f"é{r['o_orderstatus']}"} for r in rows}, place)
    got = sinks.read_metadata(spark, place)
    return spark.createDataFrame([(k, int(v["n"]), float(v["share"]), v["name"]) for k, v in got.items()], "split string, n long, share double, name string")


@query("SELECT 'first' AS source, count(*) AS n FROM nation UNION ALL SELECT 'second', count(*) FROM region")
def labels_never_overwritten(spark, sf_dir):
    place = sinks.scratch(spark, "labels")
    first = sinks.write_new_only(table(spark, sf_dir, "nation").select("n_name"), place, "new")
    second = sinks.write_new_only(table(spark, sf_dir, "region").select("r_name"), place, "new")
    count = lambda path, name: spark.read.parquet(path).agg(F.lit(name).alias("source"), F.count("*").alias("n"))
    return count(first, "first").unionByName(count(second, "second"))


@query("SELECT CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1")
def splits_round_trip(spark, sf_dir):
    k = F.col("o_orderkey") % 10
    return sinks.write_splits(table(spark, sf_dir, "orders"), sinks.scratch(spark, "splits"), F.when(k < 6, "train").when(k < 8, "valid").otherwise("test"))


@query("SELECT sha256(p_name) AS digest, CAST(16 AS BIGINT) AS size FROM (SELECT DISTINCT p_name FROM part)")
def embedding_cache(spark, sf_dir):
    place = sinks.scratch(spark, "cache")
    embed = V.hashing_embedder(16)
    parts = table(spark, sf_dir, "part").select("p_name")
    sinks.cached_embeddings(parts.where("p_name LIKE 'red%'"), "p_name", place, lambda df: df.withColumn("embedding", embed(F.col("p_name"))))
    got = sinks.cached_embeddings(parts, "p_name", place, lambda df: df.withColumn("embedding", embed(F.col("p_name"))))
    return got.select("digest", F.size("embedding").cast("long").alias("size"))


@query("SELECT p_name, count(*) AS n, true AS unit FROM part GROUP BY 1")
def embedded_once(spark, sf_dir):
    df = V.embedded(table(spark, sf_dir, "part").select("p_name"), "p_name", V.hashing_embedder())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return df.groupBy("p_name").agg(F.count("*").alias("n"), F.bool_and(F.abs(norm - 1) < 1e-5).alias("unit"))


@query("SELECT o_orderkey, CAST(2 * (o_orderkey % 97) + 1 AS DOUBLE) AS predicted FROM orders")
def bundle_round_trip(spark, sf_dir):
    """A ridge without penalty on an exact line, saved and loaded."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).cast("double").alias("x"), (2.0 * (F.col("o_orderkey") % 97) + 1).alias("y"))
    model, _, _ = S.train(df, "o_orderkey", ["x"], "y", "ridge", regParam=0.0)
    place = sinks.scratch(spark, "bundle")
    sinks.save_bundle(spark, model, {"features": ["x"]}, place)
    loaded, meta = sinks.load_bundle(spark, place)
    assert meta == {"features": ["x"]}
    return loaded.transform(df).select("o_orderkey", (F.round("predicted", 2) + 0.0).alias("predicted"))


@query("SELECT count(*) AS n, round(avg(y), 4) AS predicted FROM (SELECT CAST(2 * (o_orderkey % 97) + 1 AS DOUBLE) AS y FROM orders)")
def lasso_of_a_constant(spark, sf_dir):
    """A lasso whose penalty leaves nothing but the mean."""
    df = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).cast("double").alias("x"), (2.0 * (F.col("o_orderkey") % 97) + 1).alias("y"))
    model = S.pipeline(["x"], "y", "lasso", regParam=1e6).fit(df)
    return model.transform(df).agg(F.count("*").alias("n"), F.round(F.avg("predicted"), 4).alias("predicted"))


@query("SELECT CASE WHEN p_brand LIKE '%#1%' OR p_brand LIKE '%#2%' THEN 'first' WHEN p_brand LIKE '%#3%' THEN 'middle' ELSE 'other' END AS category, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 6) AS importance FROM part GROUP BY 1")
def importance_by_category(spark, sf_dir):
    """Each brand's share of all prices stands for a feature's importance."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("w")).collect()  # a row for each brand
    total = sum(r["w"] for r in rows)
    got = M.importance_by_category({f"tfidf_{r['p_brand']}": r["w"] / total for r in rows}, {"first": ("#1", "#2"), "middle": ("#3",)})
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "category string, importance double")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    """The windowed counts as a stream over the files, run until all of them are read; the latest result is a table of files."""
    place = sinks.scratch(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    latest = lambda counts, batch: counts.write.mode("overwrite").parquet(f"{place}/out")
    stream = windowed_counts(rows).writeStream.outputMode("complete").foreachBatch(latest).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{place}/out").select(F.col("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def streamed_first_of_key(spark, sf_dir):
    """The first event of each user and type by a stream that forgets keys after the watermark."""
    place = sinks.scratch(spark, "first")
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    once = rows.withWatermark("ts", "400 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    stream = once.select("user_id", "event_type").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    seen = spark.read.parquet(f"{place}/out")
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return seen.join(first, ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, CAST(s AS BIGINT) AS spent FROM (SELECT *, sum(CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey) AS s FROM orders) WHERE s <= 5000")
def requests_within_budget(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "search").when(F.col("o_orderstatus") == "O", "list").otherwise("odd")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))
    return remote.within_budget(asked, 5000, "o_orderkey").select("o_orderkey", F.col("spent").cast("long").alias("spent"))


_SIGNS = {"marks": "[#$%&*]", "shouting": "!!", "bars": "[|]", "digits": "[0-9]"}


@query("WITH d AS (SELECT text, quality = 0 AS high FROM documents JOIN labels USING (doc_id)), s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS form, avg(CASE WHEN regexp_matches(text, '{p}') THEN 100.0 ELSE 0.0 END) FILTER (high) AS h, avg(CASE WHEN regexp_matches(text, '{p}') THEN 100.0 ELSE 0.0 END) FILTER (NOT high) AS l FROM d" for n, p in _SIGNS.items()) + """
), f AS (SELECT *, CASE WHEN l > 0 THEN (h - l) / l * 100 WHEN h > 0 THEN 100 ELSE 0 END AS lift FROM s)
SELECT CAST(row_number() OVER (ORDER BY lift DESC, form) AS INTEGER) AS place, printf('- ''%s'' stands in %.0f %% of strong titles, %.0f %% of weak ones', form, h, l) AS line FROM f WHERE lift > 20 AND h >= 5""")
def report_of_practices(spark, sf_dir):
    """The report of what sets poor documents apart, rendered from the small result and read back line by line."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("level", F.when(F.col("quality") == 0, "High").otherwise("Low"))
    forms = [r.asDict() for r in P.usage(df, {n: F.col("text").rlike(p) for n, p in _SIGNS.items()}).collect()]  # a row for each form
    place = sinks.scratch(spark, "report")
    spark.createDataFrame([(P.report("Documents", {"forms": len(forms)}, P.recommendations(forms, [], [], None)),)], "value string").coalesce(1).write.text(place)
    lines = [x for x in spark.read.text(place, wholetext=True).first()[0].split("\n") if x.startswith("- '")]
    return spark.createDataFrame(list(enumerate(lines, 1)), "place int, line string")
