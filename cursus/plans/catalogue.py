"""Queries over the driver tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as R
from ..sources.tables import VIDEOS_SQL, table, videos

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos(spark, sf_dir).withColumn("score", C.engagement_score(F.col("views"), F.col("likes"), F.col("comments")))


SCORED_SQL = VIDEOS_SQL + ", scored AS (SELECT *, ln(1 + (3 * comments + likes) / sqrt(greatest(views, 1))) AS score FROM videos)"


def levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    cuts = R.exact_quantiles(df, "score", [0.33, 0.67])
    return df.crossJoin(F.broadcast(cuts)).withColumn("level", C.level(F.col("score"), F.get("q", F.lit(0)), F.get("q", F.lit(1)))).drop("q")


LEVELLED_SQL = SCORED_SQL + """, cuts AS (SELECT quantile_cont(score, 0.33) AS lo, quantile_cont(score, 0.67) AS hi FROM scored
), levelled AS (SELECT scored.*, CASE WHEN score >= hi THEN 'High' WHEN score >= lo THEN 'Medium' ELSE 'Low' END AS level FROM scored, cuts)"""


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_snapshots(spark, sf_dir):
    out = R.latest_per_key(table(spark, sf_dir, "events"), "user_id", F.desc_nulls_last("ts"), F.desc("event_id"))
    return out.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@query(SCORED_SQL + " SELECT video_id, views, likes, comments, round(score, 6) AS score FROM scored")
def engagement_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "views", "likes", "comments", F.round("score", 6).alias("score"))


@query(LEVELLED_SQL + " SELECT subject, level, count(*) AS n, round(avg(score), 6) AS mean_score FROM levelled GROUP BY subject, level")
def engagement_levels(spark, sf_dir):
    return levelled(spark, sf_dir).groupBy("subject", "level").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(SCORED_SQL + " SELECT video_id, channel_id, round((likes + comments) * 100.0 / views, 6) AS rate FROM scored WHERE views > 1000 ORDER BY rate DESC, video_id LIMIT 10")
def top_engagement_rate(spark, sf_dir):
    rate = F.round(C.share((F.col("likes") + F.col("comments")) * 100, F.col("views")), 6)
    return videos(spark, sf_dir).where("views > 1000").select("video_id", "channel_id", rate.alias("rate")).orderBy(F.desc("rate"), "video_id").limit(10)


@query(VIDEOS_SQL + " SELECT channel_id, mode(subject) AS subject, count(*) AS n_videos, round(avg(views), 6) AS mean_views, min(published) AS first_published, count(DISTINCT title) AS titles FROM videos GROUP BY channel_id")
def channel_table(spark, sf_dir):
    return videos(spark, sf_dir).groupBy("channel_id").agg(F.mode("subject", True).alias("subject"), F.count("*").alias("n_videos"), F.round(F.avg("views"), 6).alias("mean_views"), F.min("published").alias("first_published"), F.countDistinct("title").alias("titles"))


@query(VIDEOS_SQL + """ SELECT channel_id, count(*) AS total, count(*) FILTER (WHERE title IN ('1-URGENT', '2-HIGH')) AS n_marked, count(*) FILTER (WHERE title = '5-LOW') AS n_other,
  round(count(*) FILTER (WHERE title IN ('1-URGENT', '2-HIGH')) * 1.0 / greatest(count(*) FILTER (WHERE title IN ('1-URGENT', '2-HIGH', '5-LOW')), 1), 6) AS p_marked FROM videos GROUP BY channel_id""")
def channel_priors(spark, sf_dir):
    marked, other = F.col("title").isin("1-URGENT", "2-HIGH"), F.col("title") == "5-LOW"
    return videos(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("total"), F.count_if(marked).alias("n_marked"), F.count_if(other).alias("n_other"), F.round(F.count_if(marked) / F.greatest(F.count_if(marked | other), F.lit(1)), 6).alias("p_marked"))


@query(VIDEOS_SQL + """ SELECT video_id, CASE WHEN duration_sec < 300 THEN 'too_short' WHEN title = '5-LOW' THEN 'non_exam' WHEN title IN ('1-URGENT', '2-HIGH') THEN 'exam' WHEN p >= 0.6 THEN 'exam_ambiguous' ELSE 'unknown' END AS category
  FROM videos JOIN (SELECT channel_id AS c, avg(CASE WHEN title IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END) AS p FROM videos GROUP BY 1) ON c = channel_id""")
def filter_ladder(spark, sf_dir):
    df = videos(spark, sf_dir)
    marked = F.col("title").isin("1-URGENT", "2-HIGH")
    priors = df.groupBy("channel_id").agg(F.avg(marked.cast("double")).alias("p"))
    ladder = F.when(F.col("duration_sec") < 300, "too_short").when(F.col("title") == "5-LOW", "non_exam").when(marked, "exam").when(F.col("p") >= 0.6, "exam_ambiguous").otherwise("unknown")
    return df.join(priors, "channel_id").select("video_id", ladder.alias("category"))


@query("SELECT event_type, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def value_shares(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def event_mix(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("SELECT round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(avg(value), 6) AS mean, round(stddev(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n FROM events")
def describe_values(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = events.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev("value"), 6).alias("std"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.count("*").alias("n"))
    out = out.crossJoin(F.broadcast(R.exact_quantiles(events, "value", [0.25, 0.5, 0.75])))
    return out.select(*[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "mean", "std", "low", "high", "n")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders), b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high, count(*) FILTER (WHERE o_totalprice < low OR o_totalprice > high) AS outliers, count(*) AS total FROM orders, b GROUP BY ALL""")
def iqr_outliers(spark, sf_dir):
    out = R.iqr_outliers(table(spark, sf_dir, "orders"), "o_totalprice")
    return out.select(*[F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")], "outliers", "total")


@query(VIDEOS_SQL + " SELECT * FROM (SELECT subject, video_id, views, row_number() OVER (PARTITION BY subject ORDER BY views DESC, video_id) AS rank FROM videos) WHERE rank <= 3")
def top_videos_per_subject(spark, sf_dir):
    return R.top_per_group(videos(spark, sf_dir).select("subject", "video_id", "views"), "subject", 3, F.desc("views"), F.col("video_id"))


@query(VIDEOS_SQL + " SELECT subject, video_id FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY md5('7' || CAST(video_id AS VARCHAR)), video_id) AS r FROM videos) WHERE r <= 20")
def validation_sample(spark, sf_dir):
    return R.exact_sample(videos(spark, sf_dir).select("subject", "video_id"), "subject", "video_id", 20, "7")


@query("SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS flagged, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, round(count(*) FILTER (WHERE quality = 1 AND toxic = 0) * 1.0 / greatest(count(*) FILTER (WHERE toxic = 0), 1), 6) AS precision, round(avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def score_against_labels(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    right, said = F.col("quality") == 1, F.col("toxic") == 0
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("flagged"), F.count_if(right & said).alias("tp"), F.round(F.count_if(right & said) / F.greatest(F.count_if(said), F.lit(1)), 6).alias("precision"), F.round(F.avg((right == said).cast("double")), 6).alias("accuracy"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def not_yet_labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_flag(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    orders = table(spark, sf_dir, "orders")
    return orders.join(returned, orders.o_orderkey == returned.l_orderkey, "left_semi").select("o_orderkey")


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS BIGINT) AS words, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS the_count, CAST(contains(text, 'the') AS BIGINT) + CAST(contains(text, 'und') AS BIGINT) + CAST(contains(text, '###') AS BIGINT) AS markers, CAST(greatest(len(list_filter(regexp_split_to_array(text, '[.!?؟。]+'), lambda x: trim(x) <> '')), 1) AS BIGINT) AS sentences, length(text) AS chars FROM documents")
def text_features(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", C.word_count(t).alias("words"), C.occurrences(t, "the").alias("the_count"), C.distinct_markers(t, ["the", "und", "###"]).alias("markers"), C.sentences(t).alias("sentences"), F.length(t).cast("long").alias("chars"))


@query(r"SELECT page_id, length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS plain_chars, CAST(contains(lower(html), '<script') AS BIGINT) + CAST(contains(lower(html), 'function') AS BIGINT) AS code_markers, length(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g')) AS no_breaks FROM pages")
def page_code(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace(html, "<[^>]+>", " ")).cast("long").alias("plain_chars"), C.distinct_markers(F.lower(html), ["<script", "function"]).alias("code_markers"), F.length(F.regexp_replace(html, r"(?i)<br\s*/?>", " ")).cast("long").alias("no_breaks"))


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NULL OR role IS DISTINCT FROM b")
def caption_repeats(spark, sf_dir):
    return R.drop_repeats(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role")


@query(VIDEOS_SQL + " SELECT date_trunc('month', published) AS month, count(*) AS n, round(avg(views), 6) AS mean_views FROM videos GROUP BY 1")
def monthly_counts(spark, sf_dir):
    return videos(spark, sf_dir).groupBy(F.date_trunc("month", "published").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("views"), 6).alias("mean_views"))


@query(SCORED_SQL + " SELECT dayname(published) AS day, CAST(dayofweek(published) NOT IN (5, 6) AS BIGINT) AS is_weekday, count(*) AS n, round(avg(score), 6) AS mean_score, round(sin(2 * pi() * month(published) / 12), 6) + 0.0 AS month_sin FROM scored GROUP BY 1, 2, 5")
def timing_practices(spark, sf_dir):
    at = F.col("published")
    keys = F.date_format(at, "EEEE").alias("day"), (~F.dayofweek(at).isin(6, 7)).cast("long").alias("is_weekday"), (F.round(F.sin(2 * F.pi() * F.month(at) / 12), 6) + 0.0).alias("month_sin")
    return scored(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(VIDEOS_SQL + " SELECT CASE WHEN duration_sec <= 300 THEN '0-5' WHEN duration_sec <= 600 THEN '5-10' WHEN duration_sec <= 1200 THEN '10-20' WHEN duration_sec <= 1800 THEN '20-30' ELSE '30+' END AS bin, count(*) AS n, round(avg(likes), 6) AS mean_likes FROM videos WHERE duration_sec > 0 GROUP BY 1")
def duration_bins(spark, sf_dir):
    d = F.col("duration_sec")
    bins = F.when(d <= 300, "0-5").when(d <= 600, "5-10").when(d <= 1200, "10-20").when(d <= 1800, "20-30").otherwise("30+")
    return videos(spark, sf_dir).where(d > 0).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("likes"), 6).alias("mean_likes"))


@query(LEVELLED_SQL + " SELECT title, round(avg(CASE WHEN level = 'High' THEN 100.0 ELSE 0.0 END), 6) AS pct_high, round(avg(CASE WHEN level = 'Low' THEN 100.0 ELSE 0.0 END), 6) AS pct_low, count(*) AS n FROM levelled GROUP BY title")
def title_lifts(spark, sf_dir):
    pct = lambda v: F.round(F.avg(F.when(F.col("level") == v, 100.0).otherwise(0.0)), 6)
    return levelled(spark, sf_dir).groupBy("title").agg(pct("High").alias("pct_high"), pct("Low").alias("pct_low"), F.count("*").alias("n"))


@query("SELECT 'c_acctbal' AS column_name, count(*) - count(c_acctbal) AS missing, round((count(*) - count(c_acctbal)) * 100.0 / count(*), 6) AS missing_pct FROM customer UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment), round((count(*) - count(c_mktsegment)) * 100.0 / count(*), 6) FROM customer")
def missing_profile(spark, sf_dir):
    return R.missing_profile(table(spark, sf_dir, "customer").select("c_acctbal", "c_mktsegment"))


@query(VIDEOS_SQL + " SELECT round(corr(views, likes), 6) AS r, round(regr_slope(likes, views), 9) AS slope, round(regr_intercept(likes, views), 6) AS intercept FROM videos")
def trend_line(spark, sf_dir):
    return videos(spark, sf_dir).agg(F.round(F.corr("views", "likes"), 6).alias("r"), F.round(F.regr_slope("likes", "views"), 9).alias("slope"), F.round(F.regr_intercept("likes", "views"), 6).alias("intercept"))


@query("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS duplicates, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def duplicate_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    by_text = docs.groupBy("text").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"))
    return by_text.crossJoin(docs.agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs")))


@query("SELECT a AS channel_id FROM (SELECT o_custkey AS a FROM orders WHERE o_orderkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1) EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 2")
def split_key_sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("channel_id"))
    part = lambda k: orders.where(F.col("o_orderkey") % 3 == k).select("channel_id")
    return part(0).intersect(part(1)).subtract(part(2))


@query(SCORED_SQL + " , r AS (SELECT subject, rank() OVER (ORDER BY views) + (count(*) OVER (PARTITION BY views) - 1) / 2.0 AS k FROM scored) SELECT subject, round(sum(k), 4) AS rank_sum, count(*) AS n FROM r GROUP BY subject")
def rank_sums(spark, sf_dir):
    ranked = R.mid_ranks(videos(spark, sf_dir).select("subject", "views"), "views")
    return ranked.groupBy("subject").agg(F.round(F.sum("mid_rank"), 4).alias("rank_sum"), F.count("*").alias("n"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 10""")
def vector_top_k(spark, sf_dir):
    """Top ten by cosine; the question is one row."""
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    asked = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("asked")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("embedding", "asked") / F.sqrt(dot("embedding", "embedding") * dot("asked", "asked"))
    return e.crossJoin(asked).select("vec_id", "label", F.round(cosine, 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(10)


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    from ..streaming.snapshots import windowed_counts

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events).select(F.col("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT coalesce(r_name, 'Unknown') AS region, c_mktsegment AS subject, count(*) AS channels, round(avg(c_acctbal), 6) AS mean_balance FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 > 0 LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def channel_coverage(spark, sf_dir):
    """All channels; those of nations that the table of nations lacks have no region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    df = c.join(n.where("n_nationkey % 5 > 0"), c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return df.groupBy(F.coalesce("r_name", F.lit("Unknown")).alias("region"), F.col("c_mktsegment").alias("subject")).agg(F.count("*").alias("channels"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, word LIMIT 15")
def common_title_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query(SCORED_SQL + " SELECT video_id, coalesce(CASE WHEN channel_id % 10 = 0 THEN NULL ELSE subject END, 'Unknown') AS subject, coalesce(round(t.mean_views, 6), round((SELECT median(m) FROM (SELECT avg(views) AS m FROM scored WHERE channel_id % 10 <> 0 GROUP BY channel_id)), 6)) AS channel_views, t.c IS NOT NULL AS known_channel FROM scored LEFT JOIN (SELECT channel_id AS c, avg(views) AS mean_views FROM scored WHERE channel_id % 10 <> 0 GROUP BY 1) t ON t.c = channel_id")
def planned_lookup(spark, sf_dir):
    """State lookup with the table's median for channels that it lacks."""
    df = videos(spark, sf_dir)
    state = df.where("channel_id % 10 <> 0").groupBy("channel_id").agg(F.avg("views").alias("mean_views"))
    median = R.exact_quantiles(state, "mean_views", [0.5]).select(F.get("q", F.lit(0)).alias("m"))
    known = F.col("mean_views").isNotNull()
    out = df.join(state, "channel_id", "left").crossJoin(F.broadcast(median))
    return out.select("video_id", F.when(F.col("channel_id") % 10 == 0, "Unknown").otherwise(F.coalesce("subject", F.lit("Unknown"))).alias("subject"), F.round(F.coalesce("mean_views", "m"), 6).alias("channel_views"), known.alias("known_channel"))
