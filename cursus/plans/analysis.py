"""The study of all subjects at once over the driver tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import practices as P
from .catalogue import LEVELLED_SQL, levelled, query
from .lessons import _ERFC, rounded


def features() -> dict:
    return {
        "title_length": F.length("title"), "duration_minutes": F.col("duration_sec") / 60, "is_weekday": F.weekday("published") < 5,
        "likes": F.col("likes"), "comments": F.when(F.col("comments") > 0, F.col("comments")), "views": F.col("views"),
    }


#: Each level row under its subject and under 'global'.
SCOPED_SQL = LEVELLED_SQL + """, enough AS (SELECT subject FROM levelled GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (level = 'High') >= 10
), scoped AS (SELECT *, subject AS scope FROM levelled WHERE subject IN (SELECT subject FROM enough) UNION ALL SELECT *, 'global' FROM levelled
)"""


def _scoped(spark, sf_dir):
    return A.studied(levelled(spark, sf_dir), "subject", "level")


@query(SCOPED_SQL + f""", x AS (SELECT scope, level, unnest(['title_length', 'duration_minutes', 'is_weekday', 'likes', 'comments', 'views']) AS feature,
  unnest([CAST(length(title) AS DOUBLE), duration_sec / 60.0::DOUBLE, CAST(isodow(published) < 6 AS DOUBLE), CAST(likes AS DOUBLE), CASE WHEN comments > 0 THEN CAST(comments AS DOUBLE) END, CAST(views AS DOUBLE)]) AS v FROM scoped WHERE level <> 'Medium'
), two AS (SELECT * FROM x WHERE v IS NOT NULL
), ranked AS (SELECT *, rank() OVER (PARTITION BY scope, feature ORDER BY v) + (count(*) OVER (PARTITION BY scope, feature, v) - 1) / 2.0::DOUBLE AS k, CAST(count(*) OVER (PARTITION BY scope, feature, v) AS DOUBLE) AS c FROM two
), o AS (SELECT scope, feature, count(*) FILTER (level = 'High') AS n1, count(*) FILTER (level = 'Low') AS n0, avg(v) FILTER (level = 'High') AS m1, avg(v) FILTER (level = 'Low') AS m0, stddev(v) FILTER (level = 'High') AS s1, stddev(v) FILTER (level = 'Low') AS s0,
  median(v) FILTER (level = 'High') AS d1, median(v) FILTER (level = 'Low') AS d0, sum(k) FILTER (level = 'High') AS r1, sum(c * c - 1) AS tt FROM ranked GROUP BY 1, 2
), z AS (SELECT *, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n0 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n0 / 2 - 0.5) / nullif(sqrt(CAST(n1 * n0 AS DOUBLE) / 12 * (n1 + n0 + 1 - tt / ((n1 + n0) * (n1 + n0 - 1.0::DOUBLE)))), 0) AS z, sqrt((s1 * s1 + s0 * s0) / 2) AS pooled FROM o
), y AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z
), r AS (SELECT *, CASE WHEN z IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN z >= 0 THEN {_ERFC} ELSE 2 - {_ERFC} END) END AS p, CASE WHEN pooled = 0 THEN 0.0::DOUBLE ELSE (m1 - m0) / pooled END AS d FROM y)
SELECT scope, feature, n1 AS n_high, n0 AS n_low, round(m1, 5) AS high_mean, round(m0, 5) AS low_mean, round(d1, 5) AS high_median, round(d0, 5) AS low_median, round(coalesce((m1 - m0) / nullif(m0, 0) * 100, 0), 5) AS diff_pct,
  round(p, 5) AS p_value, round(d, 5) AS cohens_d, p < 0.05 AS significant, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM r""")
def subject_comparisons(spark, sf_dir):
    """Every test of every subject and of all videos, with p and d."""
    found = A.comparisons(_scoped(spark, sf_dir), features(), "level")
    return rounded(found, "high_mean", "low_mean", "high_median", "low_median", "diff_pct", "p_value", "cohens_d", digits=5)


_KEYWORDS = ("urgent", "low", "not", "2024")


@query(SCOPED_SQL + """, f AS (SELECT scope, level, unnest(['question', 'number', 'urgent', 'low', 'not', '2024']) AS form, unnest([contains(title, '?'), regexp_matches(title, '[0-9]'), contains(lower(title), 'urgent'), contains(lower(title), 'low'), contains(lower(title), 'not'), contains(lower(title), '2024')]) AS has FROM scoped
), s AS (SELECT scope, form, coalesce(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END) FILTER (level = 'High'), 0) AS h, coalesce(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END) FILTER (level = 'Low'), 0) AS l FROM f GROUP BY 1, 2)
SELECT scope, form, round(h * 100, 6) AS high_pct, round(l * 100, 6) AS low_pct, round(CASE WHEN l > 0 THEN (h - l) / l * 100 WHEN h > 0 THEN 100 ELSE 0 END, 6) AS lift_pct FROM s""")
def subject_forms(spark, sf_dir):
    return rounded(A.forms(_scoped(spark, sf_dir), P.title_forms(F.col("title"), _KEYWORDS), "level"), "high_pct", "low_pct", "lift_pct")


@query(SCOPED_SQL + """, p AS (SELECT scope, score, views, unnest(['day', 'hour', 'minutes']) AS part, unnest([dayname(published), CAST(hour(published) AS VARCHAR),
  CASE WHEN duration_sec <= 0 THEN NULL WHEN duration_sec <= 300 THEN '0-5' WHEN duration_sec <= 600 THEN '5-10' WHEN duration_sec <= 900 THEN '10-15' WHEN duration_sec <= 1200 THEN '15-20' WHEN duration_sec <= 1800 THEN '20-30' WHEN duration_sec <= 3600 THEN '30-60' ELSE '60+' END]) AS value FROM scoped
), g AS (SELECT scope, part, value, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(views), 6) AS mean_views FROM p WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, CAST(row_number() OVER (PARTITION BY scope, part ORDER BY mean_score DESC, value) AS INTEGER) AS place FROM g""")
def subject_timing(spark, sf_dir):
    return rounded(A.timing(_scoped(spark, sf_dir), "published", F.col("duration_sec") / 60, "score", "views"), "mean_score", "mean_views")


@query(SCOPED_SQL + """, c AS (SELECT scope, channel_id, round(avg(score), 6) AS mean_score, count(*) AS n FROM scoped GROUP BY 1, 2), o AS (SELECT scope, count(*) AS videos, count(*) FILTER (level = 'High') AS high, round(avg(score), 6) AS mean_of_all FROM scoped GROUP BY 1)
SELECT scope, videos, high, mean_of_all, channel_id, mean_score, n, CAST(row_number() OVER (PARTITION BY scope ORDER BY mean_score DESC, channel_id) AS INTEGER) AS place FROM c JOIN o USING (scope) QUALIFY place <= 5""")
def subject_channels(spark, sf_dir):
    scoped = _scoped(spark, sf_dir)
    whole = rounded(A.overview(scoped, "level", "score"), "mean_score").withColumnRenamed("mean_score", "mean_of_all")
    return whole.join(A.channels(scoped, "channel_id", "score"), "scope")
