"""Queries of fitted and saved feature matrices, with their SQL."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import matrix as X
from ..sources import sinks
from ..sources.tables import table
from .catalogue import QUERIES, query


def saved(spark, fitted, name: str) -> PipelineModel:
    """The pipeline as it comes back from where it was saved."""
    place = sinks.scratch(spark, name)
    fitted.write().overwrite().save(place)
    return PipelineModel.load(place)


@query("""WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_]{2,}') AS w FROM part),
a AS (SELECT p_partkey, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w), u AS (SELECT p_partkey, unnest(g) AS term FROM a),
tf AS (SELECT p_partkey, term, count(*) AS tf FROM u GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM part),
c AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), k AS (SELECT term, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM c, n WHERE df >= 10 AND df <= 0.5 * n ORDER BY total DESC, term LIMIT 30),
x AS (SELECT p_partkey, term, (1 + ln(tf)) * idf AS v FROM tf JOIN k USING (term)), s AS (SELECT p_partkey, 'tfidf_' || term AS feature, v / sqrt(sum(v * v) OVER (PARTITION BY p_partkey)) AS v FROM x),
z AS (SELECT p_partkey, 'p_size' AS feature, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () FROM part)
SELECT p_partkey, feature, round(v, 5) + 0.0 AS value FROM (FROM s UNION ALL FROM z) WHERE round(v, 5) <> 0""")
def feature_matrix(spark, sf_dir):
    """Each part's features that aren't 0, from a pipeline that was fitted, saved and loaded; a copy and a constant are left out."""
    df = table(spark, sf_dir, "part").repartition("p_partkey").withColumn("twice", F.col("p_size") * 2).withColumn("constant", F.lit(3))
    fitted = saved(spark, X.feature_matrix(["p_size", "p_retailprice", "twice", "constant"], "p_name").fit(df), "matrix")
    names = F.array(*map(F.lit, X.feature_names(fitted)))
    rows = fitted.transform(df).select("p_partkey", F.explode(F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("v"))).alias("x"))
    return rows.select("p_partkey", "x.feature", (F.round("x.v", 5) + 0.0).alias("value")).where("value <> 0")


@query("""WITH m AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY i)
SELECT vec_id, round(sum((embedding[i]::DOUBLE - m) * (embedding[i]::DOUBLE - m)), 4) AS size FROM embeddings, m GROUP BY vec_id""")
def component_sizes(spark, sf_dir):
    """The squared length of all components of each embedding: rotating the centred vectors leaves it as it was."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = saved(spark, X.Pipeline(stages=[X.Components(most=64)]).fit(df), "components")
    size = F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x)
    return fitted.transform(df).select("vec_id", F.round(size, 4).alias("size"))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('order:' || o_orderkey), o_orderkey) AS r, sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY md5('order:' || o_orderkey), o_orderkey) - o_totalprice AS s, avg(o_totalprice) OVER () AS m FROM orders)
SELECT o_orderkey, round((s + m) / r, 3) AS before, round(avg(y) OVER (PARTITION BY o_orderpriority) * count(*) OVER (PARTITION BY o_orderpriority) / (count(*) OVER (PARTITION BY o_orderpriority) + 1) + m / (count(*) OVER (PARTITION BY o_orderpriority) + 1), 3) AS whole FROM o""")
def target_statistics(spark, sf_dir):
    """Each order's priority as a number: from the orders before it, to learn from, and from all, for new ones."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    whole = B.target_statistics(df, "o_orderpriority", "o_totalprice").withColumnRenamed("statistic", "whole")
    before = B.ordered_target_statistics(df, "o_orderkey", "o_orderpriority", "o_totalprice", "before")
    return before.join(F.broadcast(whole), F.col("o_orderpriority") == F.col("value")).select("o_orderkey", F.round("before", 3).alias("before"), F.round("whole", 3).alias("whole"))  # a row for each priority


def leafwise_predictions(spark, sf_dir):
    """Parts' prices by trees that grow leaf by leaf; models have no SQL."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.length("p_name").alias("letters"), "p_retailprice")
    return B.fit_leafwise(df, ["p_size", "letters"], "p_retailprice", trees=3, leaves=4).transform(df).select("p_partkey", F.round("predicted", 4).alias("predicted"))


QUERIES["leafwise_predictions"] = leafwise_predictions
