"""Queries of practices, models, remote collection and further relational forms, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import models as M
from ..operators import practices as P
from ..operators import statistics as S
from ..operators.tuning import tuned
from ..sources import remote
from ..sources.tables import VIDEOS_SQL, table, videos
from ..streaming import retries
from .catalogue import LEVELLED_SQL, QUERIES, SCORED_SQL, levelled, query, scored
from .lessons import distinct_sql, rounded, total_sql

MARKERS = ("the ", "und", "les", "ing", "?")
NAMES = ("urgent", "low", "medium", "zzz")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def registry_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, TRY_CAST(event_type AS BIGINT) IS NULL AS bad FROM events WHERE coalesce(event_type, '') <> ''")
def clean_casts(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0).cast("long"))
    return table(spark, sf_dir, "events").where(F.coalesce("event_type", F.lit("")) != "").select("event_id", k.alias("k"), F.col("event_type").try_cast("long").isNull().alias("bad"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS high FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("high"))


@query("SELECT page_id, CAST(length(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')) AS BIGINT) AS plain_chars, md5(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')) AS digest FROM pages")
def strip_tags(spark, sf_dir):
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]+>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).cast("long").alias("plain_chars"), F.md5(plain.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, {distinct_sql('lower(text)', MARKERS)} AS distinct_markers, {total_sql('lower(text)', MARKERS)} AS occurrences FROM documents")
def marker_counts(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", C.distinct_markers(low, list(MARKERS)).alias("distinct_markers"), C.total(low, MARKERS).alias("occurrences"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 0)
SELECT term, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 15""")
def false_negative_terms(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 0 AND toxic = 0"), "doc_id")
    return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(15)


@query(VIDEOS_SQL + " SELECT subject, " + ", ".join(f"count(*) FILTER (WHERE title = '{t}') AS \"{t}\"" for t in ("1-URGENT", "2-HIGH", "5-LOW")) + " FROM videos GROUP BY 1")
def subject_pivot(spark, sf_dir):
    return videos(spark, sf_dir).groupBy("subject").pivot("title", ["1-URGENT", "2-HIGH", "5-LOW"]).count().na.fill(0)


@query("SELECT CAST(h AS BIGINT) AS hour, count(event_id) AS n, round(coalesce(avg(value), 0), 6) AS mean FROM range(24) t(h) LEFT JOIN events ON hour(ts) = h GROUP BY 1")
def hour_counts(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return spark.range(24).withColumnRenamed("id", "hour").join(F.broadcast(found), "hour", "left").na.fill(0)


@query("SELECT o_orderkey, 'PT' || CAST(o_custkey % 3 AS VARCHAR) || 'H' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS VARCHAR) || 'M7S' AS iso, CAST((o_custkey % 3) * 3600 + (CAST(floor(o_totalprice) AS BIGINT) % 60) * 60 + 7 AS BIGINT) AS seconds FROM orders")
def iso_duration(spark, sf_dir):
    iso = F.concat(F.lit("PT"), F.col("o_custkey") % 3, F.lit("H"), F.floor("o_totalprice") % 60, F.lit("M7S"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iso.alias("iso"), C.duration_seconds(iso).alias("seconds"))


@query("SELECT o_orderkey, ('0x' || substr(md5('s:' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 20 AS held FROM orders")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.in_test("o_orderkey", "s").alias("held"))


@query("""WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders), s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'both' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'idle', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'any', k FROM (SELECT k FROM a UNION SELECT k FROM s)""")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    parts = {"both": a.intersect(b), "idle": a.exceptAll(b.distinct()), "any": a.union(s).distinct()}
    one, two, three = (df.select(F.lit(n).alias("part"), "k") for n, df in parts.items())
    return one.union(two).union(three)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1")
def sliding_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


_FORMS = {"question": "contains(title, '?')", "number": "regexp_matches(title, '[0-9]')"} | {k: f"contains(lower(title), '{k}')" for k in NAMES}


@query(LEVELLED_SQL + ", s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS form, avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END) FILTER (WHERE level = 'High') AS h, avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END) FILTER (WHERE level = 'Low') AS l FROM levelled" for n, t in _FORMS.items()) + """)
SELECT form, round(h * 100, 6) AS high_pct, round(l * 100, 6) AS low_pct, round(CASE WHEN l > 0 THEN (h - l) / l * 100 WHEN h > 0 THEN 100.0 ELSE 0.0 END, 6) AS lift_pct FROM s""")
def title_usage(spark, sf_dir):
    return rounded(P.usage(levelled(spark, sf_dir), P.title_forms(F.col("title"), NAMES)), "high_pct", "low_pct", "lift_pct")


@query(LEVELLED_SQL + " SELECT subject, round(quantile_cont(duration_sec / 60, 0.25), 6) AS q1, round(quantile_cont(duration_sec / 60, 0.5), 6) AS median, round(quantile_cont(duration_sec / 60, 0.75), 6) AS q3, count(*) AS n FROM levelled WHERE level = 'High' GROUP BY 1 HAVING count(*) >= 10")
def subject_durations(spark, sf_dir):
    df = levelled(spark, sf_dir).withColumn("minutes", F.col("duration_sec") / 60)
    return rounded(P.subject_durations(df, "subject", "minutes"), "q1", "median", "q3")


@query(SCORED_SQL + " SELECT count(*) AS total_videos, min(published) AS first, max(published) AS last, count(DISTINCT channel_id) AS channels, count(DISTINCT subject) AS subjects, round(avg(score), 6) AS mean_score FROM scored")
def data_summary(spark, sf_dir):
    return rounded(P.summary(scored(spark, sf_dir), "published", "subject", "channel_id", "score"), "mean_score")


@query(SCORED_SQL + ", f AS (SELECT title IN ('1-URGENT', '2-HIGH') AS f, score FROM scored) SELECT round(avg(score) FILTER (WHERE f), 6) AS focused_mean, round(avg(score) FILTER (WHERE NOT f), 6) AS other_mean, round((avg(score) FILTER (WHERE f) - avg(score) FILTER (WHERE NOT f)) / avg(score) FILTER (WHERE NOT f) * 100, 5) AS lift_pct FROM f")
def focus_impact(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("focused", F.col("title").isin("1-URGENT", "2-HIGH").cast("int"))
    out = P.focus_impact(df, "focused", "score")
    return out.select(F.round("focused_mean", 6).alias("focused_mean"), F.round("other_mean", 6).alias("other_mean"), F.round("lift_pct", 5).alias("lift_pct"))


@query(LEVELLED_SQL + ", g AS (SELECT subject FROM levelled GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (WHERE level = 'High') >= 10) SELECT subject, level, count(*) AS n FROM levelled SEMI JOIN g USING (subject) GROUP BY 1, 2")
def studied_subjects(spark, sf_dir):
    return P.enough_videos(levelled(spark, sf_dir), "subject").groupBy("subject", "level").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'none' WHEN n_chars < 50 THEN 'short' WHEN n_chars < 200 THEN 'medium' ELSE 'long' END AS band FROM documents")
def length_bands(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n.isNull(), "none").when(n < 50, "short").when(n < 200, "medium").otherwise("long").alias("band"))


@query("""WITH g AS (SELECT p_partkey, lower(p_name) AS t FROM part), w AS (SELECT p_partkey, regexp_extract_all(t, '[a-z0-9_]{2,}') AS w FROM g),
a AS (SELECT p_partkey, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w), u AS (SELECT p_partkey, unnest(g) AS term FROM a),
tf AS (SELECT p_partkey, term, count(*) AS tf FROM u GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM part),
c AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), k AS (SELECT term, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM c, n WHERE df >= 10 AND df <= 0.5 * n ORDER BY total DESC, term LIMIT 30),
x AS (SELECT p_partkey, term, (1 + ln(tf)) * idf AS v FROM tf JOIN k USING (term)), s AS (SELECT p_partkey, term, v / sqrt(sum(v * v) OVER (PARTITION BY p_partkey)) AS v FROM x)
SELECT term, count(*) AS n, round(avg(v), 6) AS mean FROM s GROUP BY 1""")
def tfidf_terms(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    idf = M.fit_tfidf(df, "p_name")
    terms = F.array(*map(F.lit, idf)) if idf else F.array().cast("array<string>")
    pairs = M.tfidf(df, "p_name", idf).select(F.explode(F.arrays_zip(terms.alias("term"), F.col("tfidf").alias("v"))).alias("p")).select("p.term", "p.v").where("v > 0")
    return pairs.groupBy("term").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


_GUESS = "p AS (SELECT score AS y, ln(1 + likes) AS a, ln(1 + comments) AS b FROM scored)"


def guessed(spark, sf_dir):
    return scored(spark, sf_dir).select(F.col("score").alias("y"), F.log1p("likes").alias("a"), F.log1p("comments").alias("b"))


@query(SCORED_SQL + f", {_GUESS}, e AS (SELECT 'equal' AS blend, y, 0.5 * a + 0.5 * b AS p FROM p UNION ALL SELECT 'first', y, 0.8 * a + 0.2 * b FROM p) SELECT blend, round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 5) AS r2 FROM e GROUP BY 1")
def blended_metrics(spark, sf_dir):
    out = M.blends(guessed(spark, sf_dir), "y", {"equal": {"a": 0.5, "b": 0.5}, "first": {"a": 0.8, "b": 0.2}})
    return rounded(rounded(out, "mae", "mse", "rmse"), "r2", digits=5)


@query(SCORED_SQL + f", {_GUESS} SELECT round(avg(y - a), 6) AS mean, round(stddev_pop(y - a), 6) AS std, round(min(y - a), 6) AS low, round(max(y - a), 6) AS high FROM p")
def residual_stats(spark, sf_dir):
    return rounded(M.residuals(guessed(spark, sf_dir), "y", "a"), "mean", "std", "low", "high")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def label_codes(spark, sf_dir):
    return M.label_codes(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "code")[1].select("p_partkey", "code")


@query("WITH m AS (SELECT s_suppkey, s_acctbal AS a, avg(s_acctbal) OVER (PARTITION BY s_nationkey) AS w FROM supplier) SELECT s_suppkey, CASE WHEN abs(w - a) < 0.01 THEN 'No change' WHEN w > a THEN 'Increase' ELSE 'Decrease' END AS way FROM m")
def suggestions(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").withColumn("w", F.avg("s_acctbal").over(Window.partitionBy("s_nationkey")))
    return df.select("s_suppkey", F.regexp_replace(M.suggestion(F.col("s_acctbal"), F.col("w")), " by .*", "").alias("way"))


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN 'add text' WHEN p_size < 1 THEN 'increase' WHEN p_size > 5 THEN 'reduce' ELSE 'good' END AS word_count_advice, CASE WHEN p_retailprice < 80 THEN 'increase' WHEN p_retailprice > 180 THEN 'reduce' ELSE 'good' END AS brightness_advice FROM part")
def thumbnail_bands(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("word_count"), F.col("p_retailprice").alias("brightness"))
    return P.thumbnail_advice(df).select("p_partkey", "word_count_advice", "brightness_advice")


@query("""WITH a AS (SELECT *, event_type <> 'error' AS ok FROM events), r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS f FROM r)
SELECT event_id, CAST(f AS BIGINT) AS failures, CASE WHEN f >= 4 THEN 'stop' WHEN f > 0 AND f % 2 = 0 THEN 'pause' ELSE 'go on' END AS advice FROM f""")
def failure_breaker(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return retries.breaker(df, "user_id", "event_id", "ok", 2, 4).select("event_id", "failures", "advice")


@query("""WITH a AS (SELECT user_id AS v, ts AS t, event_type <> 'error' AS ok FROM events), d AS (SELECT v, max(t) FILTER (WHERE ok) AS d FROM a GROUP BY 1),
o AS (SELECT v, count(*) AS n, max(t) AS t FROM a JOIN d USING (v) WHERE NOT ok AND (d IS NULL OR t > d) GROUP BY 1)
SELECT v AS video_id, CAST(n AS INTEGER) AS attempts, CASE WHEN n > 2 THEN 'skipped' WHEN t + INTERVAL 5 SECOND < TIMESTAMP '2024-01-20' THEN 'retry' ELSE 'wait' END AS action FROM o""")
def retry_table(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), F.lit(None).cast("string").alias("error"))
    return retries.retry_table(df, "2024-01-20")


_KINDS = "CASE event_type WHEN 'error' THEN 'search' WHEN 'click' THEN 'list' ELSE 'details' END"


@query(f"SELECT kind, count(*) AS requests, CAST(sum(CASE kind WHEN 'search' THEN 100 ELSE 1 END) AS BIGINT) AS units FROM (SELECT {_KINDS} AS kind FROM events) GROUP BY 1")
def quota_units(spark, sf_dir):
    return remote.units(table(spark, sf_dir, "events").select(F.expr(_KINDS).alias("kind")))


@query(f"SELECT event_id, CAST(spent AS BIGINT) AS spent FROM (SELECT event_id, sum(CASE kind WHEN 'search' THEN 100 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM (SELECT *, {_KINDS} AS kind FROM events)) WHERE spent <= 300")
def within_quota(spark, sf_dir):
    return remote.within_budget(table(spark, sf_dir, "events").withColumn("kind", F.expr(_KINDS)), 300, "event_id", group="user_id").select("event_id", "spent")


def principal_components(spark, sf_dir):
    """Size of the embeddings' first components; their signs are arbitrary and the solver is iterative."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return M.components(M.fit_components(df, "embedding", 4), df, "embedding").select("vec_id", F.round(F.abs(F.get("components", F.lit(0))), 4).alias("first"))


def _modelled(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "score", *[F.col(c).cast("double").alias(c) for c in ("views", "likes", "duration_sec")])


def searched_parameters(spark, sf_dir):
    """Trials of boosted trees by validation score; models have no SQL."""
    tried = M.trials({"maxDepth": (2, 4), "stepSize": (0.05, 0.3), "maxIter": [5]}, 3)
    found = M.search(_modelled(spark, sf_dir), "video_id", ["views", "likes", "duration_sec"], "score", "boosted", tried)
    return spark.createDataFrame([(i, t["params"]["maxDepth"], round(t["score"], 6)) for i, t in enumerate(found)], "place long, max_depth int, score double")


def tuned_parameters(spark, sf_dir):
    """Boosted trees by halving: trials start with few rounds, and the best third goes on; models have no SQL."""
    found = tuned(_modelled(spark, sf_dir), "video_id", ["views", "likes", "duration_sec"], "score", "boosted", {"maxDepth": (2, 4), "stepSize": (0.05, 0.3)}, 3, effort=("maxIter", 2, 6))
    return spark.createDataFrame([(i, t["params"]["maxDepth"], t["params"]["maxIter"], round(t["score"], 6)) for i, t in enumerate(found)], "place long, max_depth int, rounds int, score double")


def stacked_predictions(spark, sf_dir):
    """Out-of-fold predictions of two models and of the one above them; models have no SQL."""
    bases = {"by_line": ("ridge", {}), "by_trees": ("forest", {"numTrees": 4, "maxDepth": 4})}
    _, second, folds = M.stack(_modelled(spark, sf_dir), "video_id", ["views", "likes", "duration_sec"], "score", bases, folds=3)
    return second.transform(folds).select("video_id", *[F.round(c, 6).alias(c) for c in ("by_line", "by_trees", "predicted")])


QUERIES |= {f.__name__: f for f in (principal_components, searched_parameters, tuned_parameters, stacked_predictions)}
