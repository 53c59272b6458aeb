"""Queries of cleaning, feature tables, registry, data quality, sources and sinks over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicons as L
from ..operators import lessons as O
from ..operators import practices as P
from ..operators import preparation as Q
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators.statistics import correlations_of
from ..sources import sinks
from ..sources.tables import VIDEOS_SQL, csv_table, json_records, table, table_or_empty, videos
from .catalogue import LEVELLED_SQL, SCORED_SQL, levelled, query, scored
from .lessons import CONFIG, FILTERED_SQL, REFERENCE, any_sql, distinct_sql, filtered, rounded

VALID_SQL = rf"(regexp_matches(coalesce(text, ''), '[^ \t\n\r\f\x0B]') AND {distinct_sql('lower(text)', L.PAGE_CODE)} < 2)"


def raw_videos(spark, sf_dir):
    """Parts as raw videos, as a CSV reader gives them: counts and dates are text, some of it none."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("video_id"), F.col("p_name").alias("title"), F.when(key % 5 > 0, F.col("p_type")).alias("description"), F.when(key % 7 > 0, F.col("p_brand")).alias("tags"), F.col("p_brand").alias("channel_id"),
        F.when(key % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("view_count"), F.concat((F.col("p_size") % 9).cast("string"), F.lit(".0")).alias("like_count"), F.lit(None).cast("string").alias("comment_count"), (F.col("p_size") * 30).cast("string").alias("duration_sec"),
        F.when(key % 11 == 0, "soon").otherwise(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), (key % 300).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("publish_date"),
    )


RAW_SQL = """WITH raw AS (SELECT p_partkey AS video_id, p_name AS title, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS description, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS tags, p_brand AS channel_id,
  CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS views, p_size % 9 AS likes, CAST(p_size * 30 AS BIGINT) AS s, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(DATE '1999-01-01' + CAST(p_partkey % 300 AS INTEGER) AS TIMESTAMP) END AS pub FROM part)"""


def transcript_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("video_id"), (F.col("quality") == 1).alias("transcript_available"), F.col("text").alias("transcript_text"), F.col("lang").alias("failure_reason"))


@query(RAW_SQL + f"""SELECT video_id, coalesce(description, '') AS description, coalesce(tags, '') AS tags, CAST(views AS BIGINT) AS view_count, CAST(likes AS BIGINT) AS like_count, CAST(0 AS BIGINT) AS comment_count, s AS duration_sec, strftime(pub, '%Y-%m-%d') AS day,
  EXISTS (SELECT 1 FROM documents JOIN labels USING (doc_id) WHERE doc_id = video_id AND quality = 1 AND {VALID_SQL}) AS has_transcript FROM raw""")
def cleaned_videos(spark, sf_dir):
    out = Q.clean_videos(raw_videos(spark, sf_dir), transcript_rows(spark, sf_dir))
    return out.select("video_id", "description", "tags", "view_count", "like_count", "comment_count", "duration_sec", F.date_format("publish_date", "yyyy-MM-dd").alias("day"), "has_transcript")


@query(f"SELECT doc_id AS video_id, length(text) AS chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND {VALID_SQL}")
def cleaned_transcripts(spark, sf_dir):
    out = Q.clean_transcripts(transcript_rows(spark, sf_dir))
    assert "failure_reason" not in out.columns
    return out.select("video_id", F.length("transcript_text").cast("long").alias("chars"))


_SUBJECT = "CASE WHEN channel_id = 'Brand#9' THEN NULL WHEN video_id % 2 = 0 THEN title END"
CHANNELS_SQL = RAW_SQL + f""", v AS (SELECT *, {_SUBJECT} AS given FROM raw
), m AS (SELECT channel_id, given, row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, given) AS r FROM v WHERE given IS NOT NULL GROUP BY 1, 2
), ch AS (SELECT channel_id, count(*) AS channel_video_count, avg(views) AS channel_avg_views, date_sub('day', min(pub), TIMESTAMP '{REFERENCE}') AS channel_age_days FROM v GROUP BY 1
), chs AS (SELECT ch.*, coalesce(given, 'Unknown') AS subject FROM ch LEFT JOIN m ON m.channel_id = ch.channel_id AND r = 1)"""


def subject_videos(spark, sf_dir):
    return Q.clean_videos(raw_videos(spark, sf_dir)).withColumn("subject", F.expr(_SUBJECT))


@query(CHANNELS_SQL + " SELECT channel_id, subject, channel_video_count, round(channel_avg_views, 6) AS channel_avg_views, channel_age_days FROM chs")
def learned_channels(spark, sf_dir):
    return rounded(Q.learn_channels(subject_videos(spark, sf_dir), REFERENCE), "channel_avg_views")


KNOWN_SQL = CHANNELS_SQL + """, k AS (SELECT * FROM chs WHERE channel_id <> 'Brand#3'), d AS (SELECT median(channel_video_count) AS c, median(channel_avg_views) AS a, median(channel_age_days) AS g FROM k)"""


@query(KNOWN_SQL + f"""SELECT video_id, coalesce(given, k.subject, 'Unknown') AS subject, CAST(coalesce(channel_video_count, d.c) AS DOUBLE) AS channel_video_count, round(coalesce(channel_avg_views, d.a), 6) AS channel_avg_views, CAST(coalesce(channel_age_days, d.g) AS DOUBLE) AS channel_age_days,
  greatest(0, date_sub('day', coalesce(pub, TIMESTAMP '{REFERENCE}'), TIMESTAMP '{REFERENCE}')) AS days_since_publish, CAST(length(title) AS BIGINT) AS title_length, CAST(length(coalesce(description, '')) AS BIGINT) AS description_length, CAST({any_sql('lower(title)', L.EXAM_FOCUS)} AS INTEGER) AS is_exam_focused, 1 AS has_transcript, CAST(2 AS BIGINT) AS transcript_word_count
  FROM v LEFT JOIN k ON k.channel_id = v.channel_id, d""")
def video_features(spark, sf_dir):
    df = subject_videos(spark, sf_dir)
    channels = Q.learn_channels(df, REFERENCE).where("channel_id <> 'Brand#3'")
    out = Q.video_features(df.withColumn("transcript_text", F.col("title")), channels, REFERENCE)
    as_double = [F.round(F.col(c).cast("double"), 6).alias(c) for c in Q.CHANNEL_FEATURES]
    return out.select("video_id", "subject", *as_double, "days_since_publish", "title_length", "description_length", "is_exam_focused", "has_transcript", "transcript_word_count")


@query(CHANNELS_SQL + """, s AS (SELECT video_id, coalesce(given, chs.subject) AS subject, likes / greatest(views, 1) AS like_ratio, video_id % 7 / greatest(views, 1) AS comment_ratio, ln(1 + (3 * (video_id % 7) + likes) / sqrt(greatest(views, 1))) AS score FROM v JOIN chs ON chs.channel_id = v.channel_id
), c AS (SELECT quantile_cont(score, 0.33) AS lo, quantile_cont(score, 0.67) AS hi FROM s)
SELECT video_id, subject, round(like_ratio, 6) AS like_ratio, round(comment_ratio, 6) AS comment_ratio, round(score, 6) AS engagement_score, CASE WHEN score >= hi THEN 'High' WHEN score >= lo THEN 'Medium' ELSE 'Low' END AS engagement_category FROM s, c""")
def engineered_export(spark, sf_dir):
    commented = subject_videos(spark, sf_dir).withColumn("comment_count", F.col("video_id") % 7)
    out = Q.engineered_export(commented, REFERENCE)
    return rounded(out.select("video_id", "subject", "like_ratio", "comment_ratio", "engagement_score", "engagement_category"), "like_ratio", "comment_ratio", "engagement_score")


# --- the channel filter ---

MARKS = O.FilterConfig(exam=("red", "blue"), other=("old", "plate"), strong=("promo",), heavy_min=0.4, other_max=0.9, min_seconds=90, require_duration=False)


def part_videos(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_brand").alias("channel_id"), (F.col("p_size") * 10).cast("long").alias("duration_sec"))


TERMS_SQL = f"""WITH pv AS (SELECT p_partkey AS id, p_name AS title, p_brand AS channel_id, p_size * 10 AS s, lower(p_name || ' ' || p_type || ' ') AS t FROM part
), mk AS (SELECT *, {any_sql('t', MARKS.exam)} AS e, {any_sql('t', MARKS.other)} AS o, {any_sql('t', MARKS.strong)} AS i FROM pv), d AS (SELECT id, title, e AS positive FROM mk WHERE e <> o
), z AS (SELECT count(*) AS n, count(*) FILTER (WHERE positive) AS np, count(*) FILTER (WHERE NOT positive) AS nn FROM d
), w AS (SELECT id, positive, ' ' || unnest(string_split(title, ' ')) || ' ' AS w FROM d), g AS (SELECT id, positive, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_transform(range(1, length(w)), lambda i: substr(w, i, 2)))) AS term FROM w
), tf AS (SELECT id, positive, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1
), k AS (SELECT id, positive, tf.term, np, nn, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df ON df.term = tf.term, z WHERE df >= 5 AND df <= 0.8 * n AND np >= 50 AND nn >= 20
), u AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS u FROM k), r AS (SELECT term, coalesce(sum(u) FILTER (WHERE positive), 0) / min(np) - coalesce(sum(u) FILTER (WHERE NOT positive), 0) / min(nn) AS diff FROM u GROUP BY term
), terms AS (SELECT term, diff FROM r WHERE diff > 1e-9 ORDER BY diff DESC, term LIMIT 12)"""


@query(TERMS_SQL + " SELECT term, round(diff, 6) AS diff FROM terms")
def discover_terms(spark, sf_dir):
    df = part_videos(spark, sf_dir)
    text = O.searched_text(df)
    exam, other = C.any_of(text, MARKS.exam), C.any_of(text, MARKS.other)
    titles = df.where(exam != other).select(F.col("video_id").alias("id"), F.col("title").alias("text"), exam.alias("positive"))
    return rounded(O.discover_terms(titles, top_n=12), "diff")


@query(TERMS_SQL + """, n AS (SELECT channel_id, count(*) FILTER (WHERE e) / greatest(count(*) FILTER (WHERE e OR o), 1) AS pe, count(*) FILTER (WHERE o) / greatest(count(*) FILTER (WHERE e OR o), 1) AS po FROM mk GROUP BY 1
), h AS (SELECT *, EXISTS (SELECT 1 FROM terms WHERE contains(t, term)) AS hit FROM mk JOIN n USING (channel_id))
SELECT id AS video_id, CASE WHEN o AND NOT e AND i THEN 'bac_3as' WHEN o AND NOT e THEN 'non_bac' WHEN e AND o AND i THEN 'bac_3as' WHEN e AND o THEN 'non_bac' WHEN e THEN 'bac_3as' WHEN NOT (pe >= 0.4 AND po <= 0.9) THEN 'unknown' WHEN s >= 90 OR hit THEN 'bac_3as_ambiguous' ELSE 'unknown' END AS filter_category,
  CASE WHEN o AND NOT e AND i THEN 'Strong Bac intent overrides non-Bac markers' WHEN o AND NOT e THEN 'Non-Bac grade markers detected' WHEN e AND o AND i THEN 'Both markers present, strong Bac intent resolves conflict' WHEN e AND o THEN 'Both Bac and non-Bac markers present, no strong intent' WHEN e THEN 'Explicit Bac markers detected' WHEN NOT (pe >= 0.4 AND po <= 0.9) THEN 'No markers, channel not Bac-heavy'
    WHEN s >= 90 OR hit THEN 'Bac-heavy channel + soft positives (' || concat_ws(', ', CASE WHEN s >= 90 THEN 'duration >= 90s' END, CASE WHEN hit THEN 'TF-IDF term hit' END) || ')' ELSE 'Bac-heavy channel but no soft positives (no soft positives)' END AS filter_reason FROM h""")
def run_filter(spark, sf_dir):
    return O.run_filter(part_videos(spark, sf_dir), MARKS, top_n=12).select("video_id", "filter_category", "filter_reason")


@query(FILTERED_SQL + """SELECT filter_category, video_id, '' AS human_label, '' AS notes FROM (SELECT *, row_number() OVER (PARTITION BY filter_category ORDER BY md5('42' || CAST(video_id AS VARCHAR)), video_id) AS r FROM f)
 WHERE r <= CASE filter_category WHEN 'bac_3as' THEN 100 WHEN 'bac_3as_ambiguous' THEN 100 WHEN 'non_bac' THEN 50 ELSE 0 END""")
def label_sample(spark, sf_dir):
    return O.label_sample(filtered(spark, sf_dir).select("video_id", "filter_category"), CONFIG)


@query(FILTERED_SQL + " SELECT subject, count(*) AS accepted, round(count(*) * 100.0 / (SELECT count(*) FROM f), 6) AS pct_of_all FROM f WHERE filter_category LIKE 'bac%' GROUP BY 1")
def accepted_subjects(spark, sf_dir):
    df = filtered(spark, sf_dir)
    total = df.agg(F.count("*").alias("t"))
    return df.where("is_bac_3as").groupBy("subject").agg(F.count("*").alias("accepted")).crossJoin(F.broadcast(total)).select("subject", "accepted", F.round(F.col("accepted") * 100.0 / F.col("t"), 6).alias("pct_of_all"))


@query("""SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE q AND t) / greatest(count(*) FILTER (WHERE q), 1), 6) AS precision, round(count(*) FILTER (WHERE q AND t) / greatest(count(*) FILTER (WHERE t), 1), 6) AS recall,
  round(count(*) FILTER (WHERE NOT q AND t) / greatest(count(*) FILTER (WHERE NOT q), 1), 6) AS fn_rate, round(count(*) FILTER (WHERE q AND NOT t) / greatest(count(*) FILTER (WHERE q), 1), 6) AS fp_rate, round(avg(CAST(q = t AS DOUBLE)), 6) AS accuracy FROM (SELECT lang, quality = 1 AS q, toxic = 0 AS t FROM documents JOIN labels USING (doc_id)) GROUP BY lang""")
def review_rates(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("q"), (F.col("toxic") == 0).alias("t"))
    q, t = F.col("q"), F.col("t")
    rate = lambda a, b: F.round(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 6)
    return df.groupBy("lang").agg(F.count("*").alias("n"), rate(q & t, q).alias("precision"), rate(q & t, t).alias("recall"), rate(~q & t, ~q).alias("fn_rate"), rate(q & ~t, q).alias("fp_rate"), F.round(F.avg((q == t).cast("double")), 6).alias("accuracy"))


# --- registry and snapshots ---


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer""")
def merged_keep_last(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return Q.merged_by_position(old, old.where("key % 2 = 0").withColumn("balance", F.col("balance") + 1), "key")


BOOT_SQL = "WITH reg AS (SELECT user_id AS key, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1)"


def registry(spark, sf_dir):
    return Q.bootstrap(table(spark, sf_dir, "events"), "user_id", "ts")


@query(BOOT_SQL + " SELECT key, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM reg")
def registry_bootstrap(spark, sf_dir):
    return registry(spark, sf_dir).select("key", *[F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in (("first_seen", "first_us"), ("last_seen", "last_us"))])


@query(BOOT_SQL + " SELECT key FROM reg WHERE key NOT IN (SELECT user_id FROM events WHERE event_id % 40 = 0) ORDER BY first_seen, key LIMIT 7")
def ids_for_enrichment(spark, sf_dir):
    held = table(spark, sf_dir, "events").where("event_id % 40 = 0").select(F.col("user_id").alias("key"))
    return Q.ids_for_enrichment(registry(spark, sf_dir), held, 7).select("key")


@query("SELECT c_nationkey AS channel_id, count(*) AS n FROM customer GROUP BY 1")
def counts_by_channel(spark, sf_dir):
    return Q.counts_by_channel(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "channel_id"))


@query("SELECT r_name AS region, n_name AS nation, count(c_custkey) AS channels, round(avg(c_acctbal), 6) AS mean_balance FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1, 2")
def nation_coverage(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rich = c.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("channels"), F.avg("c_acctbal").alias("mean_balance"))
    df = n.join(r, n.n_regionkey == r.r_regionkey).join(rich, n.n_nationkey == rich.c_nationkey, "left")
    return df.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.coalesce("channels", F.lit(0).cast("long")).alias("channels"), F.round("mean_balance", 6).alias("mean_balance"))


# --- data quality ---

CUSTOMERS_SQL = "WITH x AS (SELECT c_custkey AS key, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, CASE WHEN c_acctbal > 9000 THEN c_nationkey END AS nation, c_mktsegment AS segment FROM customer)"


def holed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_acctbal") > 9000, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("segment"))


@query(CUSTOMERS_SQL + """, s AS (SELECT (key % 10) AS key, segment, nation FROM x), t AS (SELECT 'rows' AS measure, count(*) AS n FROM s UNION ALL SELECT 'repeated rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) FROM s UNION ALL SELECT 'repeated keys', count(key) - count(DISTINCT key) FROM s
 UNION ALL SELECT 'missing key', count(*) - count(key) FROM s UNION ALL SELECT 'missing segment', count(*) - count(segment) FROM s UNION ALL SELECT 'missing nation', count(*) - count(nation) FROM s), p AS (SELECT measure, n, round(n * 100.0 / (SELECT count(*) FROM s), 6) AS pct FROM t)
SELECT 'customer' AS table_name, measure, n, pct, CASE WHEN measure NOT LIKE 'missing%' THEN NULL WHEN pct > 50 THEN 'high' WHEN pct > 20 THEN 'medium' WHEN pct > 0 THEN 'low' ELSE 'none' END AS severity FROM p""")
def data_quality(spark, sf_dir):
    return Q.quality_rows(holed(spark, sf_dir).select((F.col("key") % 10).alias("key"), "segment", "nation"), "customer", "key")


@query(CUSTOMERS_SQL + " SELECT CAST(key IS NULL AS INTEGER) AS key, CAST(balance IS NULL AS INTEGER) AS balance, CAST(nation IS NULL AS INTEGER) AS nation, CAST(segment IS NULL AS INTEGER) AS segment FROM x")
def missing_matrix(spark, sf_dir):
    return Q.missing_matrix(holed(spark, sf_dir))


@query(CUSTOMERS_SQL + " SELECT column_name FROM (SELECT 'key' AS column_name, avg(CAST(key IS NULL AS DOUBLE)) AS m FROM x UNION ALL SELECT 'balance', avg(CAST(balance IS NULL AS DOUBLE)) FROM x UNION ALL SELECT 'nation', avg(CAST(nation IS NULL AS DOUBLE)) FROM x) WHERE m < 0.5")
def numeric_columns(spark, sf_dir):
    df = holed(spark, sf_dir)
    return spark.createDataFrame([(c,) for c in Q.numeric_columns(df)], "column_name string")


@query(CUSTOMERS_SQL + " SELECT key, coalesce(balance, -1) AS balance, coalesce(nation, 99) AS nation FROM x")
def filled_by_pattern(spark, sf_dir):
    return Q.filled_by_pattern(holed(spark, sf_dir), {"bal": -1.0, "nat": 99}).select("key", "balance", "nation")


@query("SELECT CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' WHEN contains(p_name, 'hot') THEN 'heat' ELSE 'other' END AS reason, count(*) AS n FROM part GROUP BY 1")
def reason_taxonomy(spark, sf_dir):
    why = C.reason(F.col("p_name"), {"red": "colour", "Blue": "colour", "hot": "heat"})
    return table(spark, sf_dir, "part").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 4) AS mean, round(stddev(n_chars), 4) AS std, min(n_chars) AS low, round(quantile_cont(n_chars, 0.25), 4) AS q25, round(median(n_chars), 4) AS median, round(quantile_cont(n_chars, 0.75), 4) AS q75, max(n_chars) AS high FROM documents GROUP BY lang")
def describe_by_group(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("lang", "n_chars")
    c = F.col("n_chars")
    one = df.groupBy("lang").agg(F.sum(c).alias("total"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev(c), 4).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))
    q = R.group_quantiles(df, "lang", "n_chars", [0.25, 0.5, 0.75])
    return one.join(q, "lang").select("lang", "n", "total", "mean", "std", "low", *[F.round(F.get("q", F.lit(i)), 4).alias(n) for i, n in enumerate(("q25", "median", "q75"))], "high")


@query(VIDEOS_SQL + " SELECT CASE WHEN m <= 5 THEN '0-5' WHEN m <= 10 THEN '5-10' WHEN m <= 15 THEN '10-15' WHEN m <= 20 THEN '15-20' WHEN m <= 30 THEN '20-30' WHEN m <= 60 THEN '30-60' ELSE '60+' END AS bin, count(*) AS n, round(avg(likes), 6) AS mean_likes FROM (SELECT duration_sec / 30 AS m, likes FROM videos) WHERE m > 0 GROUP BY 1")
def seven_duration_bins(spark, sf_dir):
    return videos(spark, sf_dir).groupBy(P.duration_bin(F.col("duration_sec") / 30).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("likes"), 6).alias("mean_likes")).where("bin IS NOT NULL")


@query("SELECT 'day' AS part, dayname(ts) AS value, count(*) AS n, round(avg(value), 6) AS mean_score FROM events GROUP BY 2 UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*), round(avg(value), 6) FROM events GROUP BY 2")
def timing_table(spark, sf_dir):
    return rounded(P.timing(table(spark, sf_dir, "events"), "ts", "value"), "mean_score")


@query("SELECT CAST(hour(ts) AS VARCHAR) AS hour, round(avg(value), 6) AS mean_score FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 5")
def best_hours(spark, sf_dir):
    hours = P.timing(table(spark, sf_dir, "events"), "ts", "value").where("part = 'hour'").select(F.col("value").alias("hour"), "mean_score")
    return rounded(R.limited(hours, 5, F.desc("mean_score"), "hour"), "mean_score")


@query("WITH o AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders WHERE month(o_orderdate) % 3 > 0 GROUP BY 1) SELECT strftime(x, '%Y-%m') AS month, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT CAST(min(m) AS TIMESTAMP) FROM o), (SELECT CAST(max(m) AS TIMESTAMP) FROM o), INTERVAL 1 MONTH)) AS x) LEFT JOIN o ON o.m = x")
def every_month(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.month("o_orderdate") % 3 > 0).select(F.col("o_orderdate").cast("timestamp").alias("at"))
    return R.every_month(orders, "at").select(F.date_format("month", "yyyy-MM").alias("month"), "n")


_SPLIT_SQL = "CAST(('0x' || substr(md5('s:' || CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20"


@query(f"SELECT CASE WHEN {_SPLIT_SQL} THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS low, round(max(o_totalprice), 4) AS high FROM orders GROUP BY 1")
def split_statistics(spark, sf_dir):
    from ..operators.statistics import in_test

    y = F.col("o_totalprice")
    split = F.when(in_test("o_orderkey", "s"), "test").otherwise("train")
    return rounded(table(spark, sf_dir, "orders").groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev(y).alias("std"), F.min(y).alias("low"), F.max(y).alias("high")), "mean", "std", "low", "high", digits=4)


@query("WITH x AS (SELECT ln(1 + o_totalprice) AS v FROM orders), b AS (SELECT min(v) AS lo, max(v) AS hi FROM x) SELECT CAST(least(floor((v - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM x, b GROUP BY 1")
def log_histogram(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.log1p("o_totalprice").alias("v"))
    ends = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50), F.lit(49))
    return x.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


@query(SCORED_SQL + """, c AS (SELECT unnest(['views-likes', 'views-comments', 'views-score', 'likes-comments', 'likes-score', 'comments-score']) AS pair, unnest([corr(views, likes), corr(views, comments), corr(views, score), corr(likes, comments), corr(likes, score), corr(comments, score)]) AS r FROM scored) SELECT pair, round(r, 6) AS r FROM c WHERE abs(r) > 0.5 ORDER BY abs(r) DESC""")
def strong_correlations(spark, sf_dir):
    pairs = correlations_of(scored(spark, sf_dir), ["views", "likes", "comments", "score"])
    return pairs.where(F.abs("r") > 0.5).orderBy(F.desc(F.abs("r"))).select(F.concat_ws("-", "a", "b").alias("pair"), F.round("r", 6).alias("r"))


@query("(SELECT 'head' AS part, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) UNION ALL (SELECT 'tail', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5)")
def head_and_tail(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    head = R.limited(orders, 5, "o_totalprice", "o_orderkey").select(F.lit("head").alias("part"), "o_orderkey")
    tail = R.limited(orders, 5, F.desc("o_totalprice"), F.desc("o_orderkey")).select(F.lit("tail").alias("part"), "o_orderkey")
    return head.unionByName(tail)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY md5('9' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 12")
def seeded_sample(spark, sf_dir):
    return R.seeded_sample(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", 12, "9")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AS nations_in_regions, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT event_id FROM events)) = 0 AS orders_in_events")
def subset_tests(spark, sf_dir):
    of = lambda t, c: table(spark, sf_dir, t).select(F.col(c).cast("long").alias("k"))
    got = R.is_subset(of("nation", "n_regionkey"), of("region", "r_regionkey")), R.is_subset(of("orders", "o_orderkey"), of("events", "event_id"))
    return spark.createDataFrame([got], "nations_in_regions boolean, orders_in_events boolean")


# --- practices ---


@query(LEVELLED_SQL + """, t AS (SELECT level, CASE WHEN video_id % 4 = 0 THEN 'see http://x 1:30 #tag' WHEN video_id % 4 = 1 THEN 'Instagram ☀' ELSE title END AS d FROM levelled), f AS (SELECT level, unnest(['link', 'timestamp', 'hashtag', 'emoji', 'social']) AS form, unnest([contains(lower(d), 'http'), regexp_matches(d, '[0-9]{1,2}:[0-9]{2}'), contains(d, '#tag'), contains(d, '☀'), contains(lower(d), 'instagram')]) AS y FROM t
), s AS (SELECT form, coalesce(avg(CAST(y AS DOUBLE)) FILTER (WHERE level = 'High'), 0) AS h, coalesce(avg(CAST(y AS DOUBLE)) FILTER (WHERE level = 'Low'), 0) AS l FROM f GROUP BY 1) SELECT form, round(h * 100, 6) AS high_pct, round(l * 100, 6) AS low_pct, round(CASE WHEN l > 0 THEN (h - l) / l * 100 WHEN h > 0 THEN 100 ELSE 0 END, 6) AS lift_pct FROM s""")
def description_forms(spark, sf_dir):
    v = F.col("video_id") % 4
    df = levelled(spark, sf_dir).withColumn("d", F.when(v == 0, "see http://x 1:30 #tag").when(v == 1, "Instagram ☀").otherwise(F.col("title")))
    return rounded(P.usage(df, C.description_forms(F.col("d"))), "high_pct", "low_pct", "lift_pct")


@query(LEVELLED_SQL + """, t AS (SELECT subject, level, contains(lower(title), 'high') AS y FROM levelled), s AS (SELECT subject, coalesce(avg(CAST(y AS DOUBLE)) FILTER (WHERE level = 'High'), 0) AS h, coalesce(avg(CAST(y AS DOUBLE)) FILTER (WHERE level = 'Low'), 0) AS l FROM t GROUP BY 1) SELECT subject, 'high' AS form, round(h * 100, 6) AS high_pct, round(l * 100, 6) AS low_pct, round(CASE WHEN l > 0 THEN (h - l) / l * 100 WHEN h > 0 THEN 100 ELSE 0 END, 6) AS lift_pct FROM s""")
def subject_title_words(spark, sf_dir):
    return rounded(P.usage_by(levelled(spark, sf_dir), "subject", {"high": F.contains(F.lower("title"), F.lit("high"))}), "high_pct", "low_pct", "lift_pct")


# --- small functions ---


@query("SELECT doc_id, substr(text, 1, 200) AS head, round(exp(n_chars / 100000.0) - 1, 6) AS e, round(n_chars / 365.25, 6) AS y, lang AS bucket FROM documents")
def small_functions(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", C.truncated(F.col("text"), 200).alias("head"), F.round(F.expm1(n / 100000.0), 6).alias("e"), F.round(C.years(n), 6).alias("y"), F.col("lang").alias("bucket"))


@query("SELECT vec_id, round(list_sum(list_transform(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x), lambda p: -p * log2(p + 1e-6))), 5) AS entropy, round(list_avg([CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)]), 6) AS pooled, CASE WHEN embedding[1] >= 0 THEN 'plus' ELSE 'minus' END AS side, CAST(embedding[3] AS DOUBLE) AS third FROM embeddings WHERE embedding[1] <> 0")
def vector_functions(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    df = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e")).where(F.get("e", F.lit(0)) != 0)
    pairs = F.array(F.slice("e", 1, 1), F.slice("e", 2, 1))
    side = C.nearest([F.get("e", F.lit(0))], {"plus": (0.5,), "minus": (-0.5,)})
    df = df.select("vec_id", F.round(C.entropy(F.transform("e", lambda x: x * x)), 5).alias("entropy"), F.round(F.get(C.mean_pooled(pairs), F.lit(0)), 6).alias("pooled"), side.alias("side"), F.array(F.slice("e", 1, 2), F.slice("e", 3, 2)).alias("nested"))
    return Q.flattened(df, "nested", 3).select("vec_id", "entropy", "pooled", "side", F.col("nested_2").alias("third"))


@query("SELECT p_partkey, CAST(contains(p_name, 'red') AS INTEGER) AS w_red, CAST(contains(p_name, 'ring') AS INTEGER) AS w_ring, CASE WHEN p_size > 40 THEN p_type WHEN p_size > 20 THEN p_brand ELSE p_name END AS url, CAST(2 AS BIGINT) AS arabic, CAST(2 * length(p_name) AS BIGINT) AS grams FROM part")
def list_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    thumbs = F.struct(F.when(F.col("p_size") > 40, F.col("p_type")).alias("medium"), F.when(F.col("p_size") > 20, F.col("p_brand")).alias("default"), F.col("p_name").alias("high"))
    df = Q.binarised(p.withColumn("w", F.split("p_name", " ")), "w", ["red", "ring"]).withColumn("t", thumbs)
    words = C.arabic_words(F.concat(F.col("p_name"), F.lit(" درس في "), F.col("p_type")))
    return df.select("p_partkey", "w_red", "w_ring", C.first_present(F.col("t"), ("medium", "default", "high")).alias("url"), F.size(words).cast("long").alias("arabic"), (F.size(C.char_grams(F.col("p_name"))) - 4).cast("long").alias("grams"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def coerced_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("not a date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(C.utc_timestamp(text), "yyyy-MM-dd").alias("day"))


@query("SELECT event_type || event_id || ':k' AS chunk_id, 'k' AS category, event_type || event_id AS subject, json_extract_string(props, '$.k') AS content FROM events")
def knowledge_chunks(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(F.concat("event_type", F.col("event_id").cast("string")).alias("subject"), F.col("props").alias("value"))
    return Q.knowledge_chunks(files)


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS minutes, round(p_retailprice, 2) AS wpm, CAST(CASE WHEN p_size % 2 = 0 THEN 12.5 END AS DOUBLE) AS percent, CASE p_type WHEN 'PROMO' THEN 'title' WHEN 'SMALL' THEN 'timing' ELSE 'general' END AS bucket FROM part")
def benchmark_figures(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.lit(" minutes at "), F.format_string("%.2f", "p_retailprice"), F.lit(" WPM"), F.when(F.col("p_size") % 2 == 0, ", 12.5 % more").otherwise(""))
    kind = F.when(F.col("p_type") == "PROMO", "Title_impact").when(F.col("p_type") == "SMALL", "best_day").otherwise("misc")
    return table(spark, sf_dir, "part").select("p_partkey", Q.benchmark_figures(text).alias("f"), Q.bucketed(kind).alias("bucket")).select("p_partkey", "f.*", "bucket")


@query("SELECT p_partkey, CAST(unnest(range(0, 6)) AS INTEGER) AS nr, unnest([3, 3, 2, 2, 2, 1]) AS k FROM part WHERE p_size > 48")
def sub_questions(spark, sf_dir):
    asked = Q.sub_questions(F.col("p_type"), F.col("p_name"), F.col("p_size"))
    return table(spark, sf_dir, "part").where("p_size > 48").select("p_partkey", F.inline(asked)).select("p_partkey", "nr", "k")


@query("""WITH q AS (SELECT vec_id AS question_id, embedding AS asked FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT question_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(asked AS DOUBLE[])), 6) + 0.0 AS score FROM embeddings, q)
SELECT question_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def vector_search_all(spark, sf_dir):
    """Every row whose id is divisible by 50 asks for its five nearest rows."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("asked"))
    return V.best_per_question(asked, base, "vec_id", 5).select("question_id", "vec_id", "score")


@query(VIDEOS_SQL + f""", a AS (SELECT video_id, published AS p, greatest(0, date_sub('day', published, TIMESTAMP '{REFERENCE}')) AS d FROM videos)
SELECT video_id, CAST(hour(p) AS INTEGER) AS publish_hour, CAST(day(p) AS INTEGER) AS publish_day_of_month, round(sin(2 * pi() * hour(p) / 24), 6) + 0.0 AS publish_hour_sin, round(cos(2 * pi() * hour(p) / 24), 6) + 0.0 AS publish_hour_cos, round(sin(2 * pi() * month(p) / 12), 6) + 0.0 AS publish_month_sin, round(cos(2 * pi() * day(p) / 31), 6) + 0.0 AS publish_day_of_month_cos, d * hour(p) AS days_since_publish_x_hour, CAST(CAST(dayofweek(p) NOT IN (5, 6) AS INTEGER) * hour(p) AS INTEGER) AS is_weekday_x_hour FROM a""")
def temporal_features_more(spark, sf_dir):
    df = O.temporal_features(videos(spark, sf_dir).select("video_id", "published"), "published", REFERENCE)
    flat = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return df.select("video_id", "publish_hour", "publish_day_of_month", *map(flat, ("publish_hour_sin", "publish_hour_cos", "publish_month_sin", "publish_day_of_month_cos")), "days_since_publish_x_hour", "is_weekday_x_hour")


@query(f"""WITH a AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' exam bac') AS t, lower(p_type || ' exam bac') AS d, CAST(length(p_type || ' exam bac') AS BIGINT) AS description_length FROM part)
SELECT p_partkey, description_length, round({distinct_sql('t', L.EXAM_MARKERS)} / 5.0, 6) AS exam_keyword_intensity, {distinct_sql('d', L.TEACHING)} AS desc_pedagogical_markers FROM a""")
def title_features_more(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.concat("p_type", F.lit(" exam bac")).alias("description"))
    return rounded(O.title_features(df).select("p_partkey", "description_length", "exam_keyword_intensity", "desc_pedagogical_markers"), "exam_keyword_intensity")


@query("SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS \"c_mktsegment_BUILDING\", CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS \"c_mktsegment_HOUSEHOLD\" FROM customer")
def one_hot_segments(spark, sf_dir):
    from ..operators.statistics import one_hot

    return one_hot(table(spark, sf_dir, "customer"), "c_mktsegment", ["HOUSEHOLD", "AUTOMOBILE", "BUILDING"]).select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_HOUSEHOLD")


@query(SCORED_SQL + """, v AS (SELECT CAST(score > 1 AS INTEGER) AS focused, likes + 0.0 AS speech_rate_wpm, views + 0.0 AS question_density FROM scored), t AS (SELECT CASE focused WHEN 1 THEN 'High' ELSE 'Low' END AS level, unnest(['speech_rate_wpm', 'question_density']) AS feature, unnest([CASE WHEN speech_rate_wpm > 0 THEN speech_rate_wpm END, question_density]) AS x FROM v)
SELECT feature, count(x) FILTER (WHERE level = 'High') AS n_high, count(x) FILTER (WHERE level = 'Low') AS n_low, round(median(x) FILTER (WHERE level = 'High'), 6) AS high_median, round(median(x) FILTER (WHERE level = 'Low'), 6) AS low_median,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM (SELECT *, (avg(x) FILTER (WHERE level = 'High') OVER w - avg(x) FILTER (WHERE level = 'Low') OVER w) / sqrt((var_samp(x) FILTER (WHERE level = 'High') OVER w + var_samp(x) FILTER (WHERE level = 'Low') OVER w) / 2) AS d FROM t WINDOW w AS (PARTITION BY feature)) GROUP BY feature, d""")
def delivery_comparison(spark, sf_dir):
    df = scored(spark, sf_dir).select(F.when(F.col("score") > 1, "High").otherwise("Low").alias("level"), F.col("likes").cast("double").alias("speech_rate_wpm"), F.col("views").cast("double").alias("question_density"))
    return rounded(P.delivery(df).select("feature", "n_high", "n_low", "high_median", "low_median", "effect"), "high_median", "low_median")


# --- sources and sinks: written, and read back ---


@query("SELECT p_partkey AS key, p_name || chr(10) || '\"' || p_type || '\"' AS text, p_size AS size, CAST(p_size + 1.5 AS DOUBLE) AS total, 'a|' || p_brand AS tags FROM part")
def csv_round_trip(spark, sf_dir):
    place = sinks.scratch(spark, "csv")
    text = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('"'))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.alias("text"), F.col("p_size").alias("size"), F.format_string("[%d.0, 1.5]", "p_size").alias("vector"), F.concat(F.lit("a , "), "p_brand").alias("tags"))
    rows.write.option("header", True).option("escape", '"').csv(place)
    schema = T.StructType([T.StructField(n, t) for n, t in (("key", T.LongType()), ("text", T.StringType()), ("size", T.IntegerType()), ("vector", T.StringType()), ("tags", T.StringType()))])
    got = Q.converted(csv_table(spark, place, schema), ("vector",), ("tags",))
    return got.select("key", "text", "size", (F.get("vector", F.lit(0)) + F.get("vector", F.lit(1))).alias("total"), F.array_join("tags", "|").alias("tags"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def json_round_trip(spark, sf_dir):
    place = sinks.scratch(spark, "json")
    rows = table(spark, sf_dir, "region").agg(F.to_json(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))).alias("value"))
    rows.coalesce(1).write.text(place)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    return json_records(spark, place, schema).unionByName(table_or_empty(spark, f"{place}-none", schema))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer")
def checkpoint_round_trip(spark, sf_dir):
    place = sinks.scratch(spark, "batches")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    sinks.append_checkpoint(rows, place, 1)
    sinks.append_checkpoint(rows.where("id % 3 = 0").withColumn("balance", F.col("balance") + 1), place, 2)
    return sinks.read_checkpoint(spark, place, "id")


@query("SELECT o_orderkey AS id, o_orderstatus = 'F' AS accepted FROM orders")
def split_round_trip(spark, sf_dir):
    place = sinks.scratch(spark, "split")
    sinks.write_split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("accepted")), place, "accepted")
    return sinks.read_split(spark, place, "accepted")


@query("SELECT s_suppkey AS id, s_acctbal AS predicted FROM supplier")
def prediction_round_trip(spark, sf_dir):
    place = sinks.scratch(spark, "predictions")
    sinks.write_predictions(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("predicted")), place)
    return csv_table(spark, place, T.StructType([T.StructField("id", T.LongType()), T.StructField("predicted", T.DoubleType())]))


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'c' || CAST(label AS VARCHAR) AS category, '{\"vec_id\":' || CAST(vec_id AS VARCHAR) || '}' AS metadata, CAST(len(embedding) AS BIGINT) AS size FROM embeddings")
def index_round_trip(spark, sf_dir):
    place = sinks.scratch(spark, "index")
    e = table(spark, sf_dir, "embeddings")
    sinks.save_index(e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), F.lit("s").alias("subject"), F.lit("t").alias("content"), "embedding", "vec_id"), place)
    return sinks.load_index(spark, place).select("chunk_id", "category", "metadata", F.size("embedding").cast("long").alias("size"))


@query("SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS price FROM orders WHERE o_orderkey % 2 = 0")
def run_round_trip(spark, sf_dir):
    place = sinks.scratch(spark, "runs")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    sinks.write_run(rows, place, "2024-01-01")
    sinks.write_run(rows.where("id % 2 = 0"), place, "2024-01-02")
    return sinks.latest_run(spark, place)


@query("SELECT conv_id AS video_id, string_agg(trim(text), ' ' ORDER BY turn) AS text, 'x' AS language, CAST(max(turn + 1) AS DOUBLE) AS seconds FROM conversations GROUP BY 1")
def joined_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text", F.lit("x").alias("language"))
    return Q.joined_segments(c)
