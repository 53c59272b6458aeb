"""Queries on planned videos: all questions of all plans in one plan of Spark's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import planning as P
from ..operators import vector_index as I
from ..sources import sinks
from ..sources.tables import table
from .catalogue import query

# A plan is every row whose id is divisible by 50; it asks with its own vector and those of the five rows behind it, where there are such.
PLANS_SQL = """WITH base AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE label WHEN 0 THEN NULL WHEN 1 THEN 'global' ELSE CAST(label AS VARCHAR) END AS subject, CAST(label AS VARCHAR) AS own FROM embeddings
), plans AS (SELECT vec_id AS plan_id, own AS subject FROM base WHERE vec_id % 50 = 0
), asked AS (SELECT plan_id, p.subject, nr, b.e, [3, 3, 2, 2, 2, 1][nr + 1] AS k FROM plans p, range(6) r(nr) JOIN base b ON b.vec_id = plan_id + nr
), ranked AS (SELECT plan_id, a.subject, nr, k, vec_id, b.subject AS of, round(list_cosine_similarity(b.e, a.e), 6) AS score FROM asked a, base b
), hits AS (SELECT *, row_number() OVER (PARTITION BY plan_id, nr ORDER BY score DESC, vec_id) AS r FROM ranked QUALIFY r <= k
), once AS (SELECT *, CASE WHEN of IS NULL THEN 2 WHEN of = 'global' THEN 1 WHEN of = subject THEN 0 END AS tier FROM hits QUALIFY row_number() OVER (PARTITION BY plan_id, vec_id ORDER BY nr, r) = 1
), counted AS (SELECT *, count(*) FILTER (tier = 0) OVER (PARTITION BY plan_id) AS own, count(*) FILTER (tier = 1) OVER (PARTITION BY plan_id) AS general FROM once
), usable AS (SELECT *, count(*) OVER (PARTITION BY plan_id) AS candidates, row_number() OVER (PARTITION BY plan_id ORDER BY round(score, 4) DESC, tier, nr, r) AS place FROM counted WHERE tier IN (0, 2) OR (tier = 1 AND own < 3))
"""


@query(PLANS_SQL + "SELECT plan_id, CAST(place AS INTEGER) AS place, vec_id, ['own', 'general', 'any'][tier + 1] AS bucket, CAST(nr AS INTEGER) AS nr, round(score, 4) AS score, CAST(own AS INTEGER) AS own, own < 3 AND general > 0 AS general_used, CAST(candidates AS INTEGER) AS candidates FROM usable WHERE place <= 5")
def planned_retrieval(spark, sf_dir):
    """The five best practices of each plan from all its questions."""
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("string")
    base = e.select("vec_id", "embedding", F.when(F.col("label") == 1, "global").when(F.col("label") != 0, label).alias("subject"))
    plans = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("plan_id"), label.alias("subject"))
    parts = F.array(*[F.struct(F.lit(nr).alias("nr"), F.lit(k).alias("k")) for nr, (_, _, k) in enumerate(P.QUESTIONS)])
    asked = plans.select("plan_id", "subject", F.inline(parts)).join(e.select(F.col("vec_id").alias("of"), F.col("embedding").alias("asked")), F.col("of") == F.col("plan_id") + F.col("nr"))
    return P.planned_practices(asked, base, "vec_id")


@query("""WITH b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT q.vec_id AS question_id, b.vec_id, round(list_cosine_similarity(b.e, q.e), 6) AS score FROM b, b AS q WHERE q.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, b.vec_id) <= 10""")
def vector_index_search(spark, sf_dir):
    """The ten nearest of all rows for every 50th, through inverted lists that bounds leave open."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    place = sinks.scratch(spark, "index")
    I.build(e, "vec_id", place)
    found = I.search(spark, place, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("asked")), 10, exact=True)
    return found.select("question_id", F.col("k").alias("vec_id"), "score")


@query("""WITH b AS (SELECT p_brand AS s, count(*) AS n, count(*) FILTER (p_size > 25) AS h, min(p_type) AS a, max(p_type) AS z, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)
SELECT s || '_summary' AS chunk_id, 'subject_summary' AS category, 'subject_summary' AS type, s AS subject, array_to_string(['Subject: ' || s, 'Total videos: ' || n, 'High performers: ' || h, 'Average engagement: N/A', ''], chr(10)) AS content FROM b
UNION ALL SELECT s || '_title_optimization_recommendations', 'title_optimization', 'recommendations', s, array_to_string(['Subject: ' || s, 'Category: title_optimization', 'Recommendations:', 'use ' || a, 'avoid ' || z], chr(10)) FROM b
UNION ALL SELECT s || '_title_optimization_title_length', 'title_optimization', 'statistical_analysis', s, array_to_string(['Subject: ' || s, 'Category: title_optimization', 'Metric: title_length', 'High performers median: ' || hi, 'Low performers median: ' || lo, 'Difference: N/A%', ''], chr(10)) FROM b""")
def practice_chunks(spark, sf_dir):
    """A file of practices for each brand, as JSON, and its chunks."""
    by_brand = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("h"), F.min("p_type").alias("a"), F.max("p_type").alias("z"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    said = F.array(F.concat(F.lit("use "), "a"), F.concat(F.lit("avoid "), "z"))
    title = F.struct(said.alias("recommendations"), F.struct(F.col("hi").alias("high_median"), F.col("lo").alias("low_median")).alias("title_length"))
    files = by_brand.select(F.col("p_brand").alias("name"), F.to_json(F.struct(F.col("n").alias("total_videos"), F.col("h").alias("high_performers"), title.alias("title_optimization"))).alias("value"))
    names = tuple(r["p_brand"] for r in by_brand.select("p_brand").collect())  # a row for each brand
    return K.practice_chunks(files, names)
