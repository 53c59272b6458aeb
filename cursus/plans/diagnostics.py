"""Queries on how values are distributed and on what a filter lost, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import practices as P
from ..operators import preparation as Q
from ..operators import statistics as S
from ..sources import sinks
from ..sources.tables import VIDEOS_SQL, table, videos
from .catalogue import SCORED_SQL, query, scored
from .lessons import rounded


def _poly_sql(coefficients: tuple, x: str) -> str:
    out = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def probit_sql(p: str) -> str:
    tail = lambda s: f"{_poly_sql(D._TAIL, f'sqrt(-2 * ln({s}))')} / {_poly_sql(D._TAIL_BELOW, f'sqrt(-2 * ln({s}))')}"
    q = f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    return f"CASE WHEN {p} < {D._LOW} THEN {tail(p)} WHEN {p} > 1 - {D._LOW} THEN -({tail(f'(1 - {p})')}) ELSE {_poly_sql(D._MIDDLE, q)} * ({p} - 0.5::DOUBLE) / {_poly_sql(D._MIDDLE_BELOW, q)} END"


@query(VIDEOS_SQL + """, x AS (SELECT CAST(views AS DOUBLE) + 0.01 AS x FROM videos WHERE views + 0.01 > 0), l AS (SELECT CAST(k AS DOUBLE) / 10 AS power FROM range(-20, 21) r(k))
SELECT power, count(*) AS n, round((power - 1) * sum(ln(x)) - count(*) / 2 * ln(CASE WHEN power = 0 THEN var_pop(ln(x)) ELSE var_pop(pow(x, power)) / (power * power) END), 3) AS likelihood FROM x, l GROUP BY power""")
def power_likelihoods(spark, sf_dir):
    """How likely each power makes the views normal, from one pass."""
    return rounded(D.power_likelihoods(videos(spark, sf_dir), "views", 0.01), "likelihood", digits=3)


@query(SCORED_SQL + f""", r AS (SELECT score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS k, count(*) OVER () AS n FROM scored WHERE score IS NOT NULL
), p AS (SELECT score AS v, n, (k - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM r), m AS (SELECT v, n, {probit_sql('p')} AS m FROM p)
SELECT max(n) AS n, round(corr(m, v) * corr(m, v), 6) AS statistic FROM m""")
def score_normality(spark, sf_dir):
    return rounded(D.normality(scored(spark, sf_dir), "score"), "statistic")


@query(SCORED_SQL + f""", q AS (SELECT k / 20.0::DOUBLE AS share, (SELECT quantile_cont(score, list_transform(range(1, 20), lambda i: i / 20.0)) FROM scored)[k] AS value FROM range(1, 20) r(k))
SELECT round(share, 6) AS share, round({probit_sql('share')}, 6) AS normal, round(value, 6) AS value FROM q""")
def score_qq_points(spark, sf_dir):
    return rounded(D.qq_points(scored(spark, sf_dir), "score", 19), "share", "normal", "value")


# The videos that a filter kept are the parts of an even key, the right answer is by size; letters become Arabic ones.
_LOST = "translate(p_name, 'aeiou', 'اىوءه')"
_MARKERS = ("red", "blue", "old", "none")


@query(f"""WITH lost AS (SELECT p_brand AS category, {_LOST} AS title, lower({_LOST} || ' ' || p_type) AS t FROM part WHERE p_partkey % 2 = 1 AND p_size > 20), n AS (SELECT count(*) AS total FROM lost
), w AS (SELECT unnest(regexp_extract_all(title, '[؀-ۿ]+')) AS w FROM lost
), c AS (SELECT 'category' AS part, category AS value, count(*) AS n FROM lost GROUP BY 2 UNION ALL SELECT 'marker', m, count(*) FILTER (contains(t, m)) FROM lost, (SELECT unnest({list(_MARKERS)}) AS m) GROUP BY 2
  UNION ALL FROM (SELECT 'word', w, count(*) AS n FROM w GROUP BY 2 ORDER BY n DESC, w LIMIT 15))
SELECT part, value, c.n AS n, round(c.n * 100.0 / total, 6) AS pct FROM c, n""")
def lost_videos(spark, sf_dir):
    """What was wrongly rejected: by category, by marker, and the commonest Arabic words of the titles."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("category"), F.translate("p_name", "aeiou", "اىوءه").alias("title"), F.col("p_type").alias("description"),
        (F.col("p_partkey") % 2 == 0).alias("kept"), (F.col("p_size") > 20).alias("wanted"))
    return rounded(P.lost_profile(rows, "kept", "wanted", "category", _MARKERS), "pct")


@query("""WITH v AS (SELECT p_partkey AS id, p_brand AS channel_id, CAST(p_size AS DOUBLE) AS x FROM part), t AS (SELECT avg(x) AS mx, avg(3 * x + 2) AS my, covar_pop(x, 3 * x + 2) / var_pop(x) AS b FROM v WHERE id % 3 > 0)
SELECT id, round(my + b * (x - mx), 4) AS predicted FROM v, t""")
def saved_predictor(spark, sf_dir):
    """A model that is fitted on two thirds, saved, loaded, and asked for all: what it learns is a line, so SQL can state it."""
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x")).withColumn("y", 3 * F.col("x") + 2)
    place = sinks.scratch(spark, "predictor")
    sinks.save_bundle(spark, S.pipeline(["x"], "y", "ridge", regParam=0.0).fit(df.where("id % 3 > 0")), {"features": ["x"]}, place)
    model, meta = sinks.load_bundle(spark, place)
    assert meta["features"] == ["x"]
    return model.transform(df.drop("y")).select("id", F.round("predicted", 4).alias("predicted"))
