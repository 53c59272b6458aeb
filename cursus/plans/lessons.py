"""Queries of the lesson operators over the driver tables, each beside its SQL; models have none."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..operators import lessons as O
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import statistics as S
from ..sources.tables import VIDEOS_SQL, table, videos
from .catalogue import LEVELLED_SQL, QUERIES, SCORED_SQL, levelled, query, scored

SPACE = r"[ \t\n\r\f\x0B]+"
REFERENCE = "2000-01-01 00:00:00"
CONFIG = O.FilterConfig(exam=(" with ", " pour "), other=(" was ", " nicht "), strong=(" that ",), heavy_min=0.3, other_max=0.5)


def any_sql(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m.lower()}')" for m in markers) + ")"


def distinct_sql(x: str, markers) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{m.lower()}') AS BIGINT)" for m in markers) + ")"


def total_sql(x: str, markers) -> str:
    return "(" + " + ".join(f"CAST((length({x}) - length(replace({x}, '{m}', ''))) / {len(m)} AS BIGINT)" for m in markers) + ")"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def document_videos(spark, sf_dir):
    """Documents as videos: the source is the channel, the text the description, 15 characters a second."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.col("source").alias("channel_id"), F.col("text").alias("description"), F.floor(F.col("n_chars") / 15).cast("long").alias("duration_sec"))


DOC_VIDEOS_SQL = f"""WITH v AS (SELECT doc_id AS video_id, source AS channel_id, lower(' ' || coalesce(text, '') || ' ') AS t, CAST(floor(n_chars / 15) AS BIGINT) AS s FROM documents
), m AS (SELECT *, {any_sql('t', CONFIG.exam)} AS e, {any_sql('t', CONFIG.other)} AS o, {any_sql('t', CONFIG.strong)} AS i FROM v
), n AS (SELECT channel_id, count(*) AS total, count(*) FILTER (WHERE e) AS n_exam, count(*) FILTER (WHERE o) AS n_other, count(*) FILTER (WHERE e OR o) AS n_any FROM m GROUP BY 1
), p AS (SELECT *, n_exam * 1.0 / greatest(n_any, 1) AS p_exam, n_other * 1.0 / greatest(n_any, 1) AS p_other FROM n
), h AS (SELECT *, p_exam >= 0.3 AND p_other <= 0.5 AS heavy FROM p)"""


@query(DOC_VIDEOS_SQL + " SELECT channel_id, total, n_exam, n_other, n_any, round(p_exam, 6) AS p_exam, round(p_other, 6) AS p_other, heavy FROM h")
def channel_marks(spark, sf_dir):
    return rounded(O.channel_priors(document_videos(spark, sf_dir), CONFIG), "p_exam", "p_other")


FILTERED_SQL = DOC_VIDEOS_SQL + """, c AS (SELECT source AS channel_id, min(lang) AS subject FROM documents WHERE source <> 'src0' GROUP BY 1
), f AS (SELECT video_id, CASE WHEN s < 120 THEN 'non_bac' WHEN o AND NOT e AND i THEN 'bac_3as' WHEN o AND NOT e THEN 'non_bac' WHEN e AND o AND i THEN 'bac_3as' WHEN e AND o THEN 'non_bac' WHEN e THEN 'bac_3as' WHEN NOT heavy THEN 'unknown' ELSE 'bac_3as_ambiguous' END AS filter_category,
  CASE WHEN s < 120 THEN 0.8 WHEN o AND NOT e AND i THEN 0.7 WHEN o AND NOT e THEN 0.9 WHEN e AND o AND i THEN 0.75 WHEN e AND o THEN 0.5 WHEN e THEN 0.95 WHEN NOT heavy THEN 0.4 ELSE 0.65 END AS filter_confidence, coalesce(subject, 'Unknown') AS subject
  FROM m JOIN h USING (channel_id) LEFT JOIN c USING (channel_id))"""


def filtered(spark, sf_dir):
    channels = table(spark, sf_dir, "documents").where("source <> 'src0'").groupBy(F.col("source").alias("channel_id")).agg(F.min("lang").alias("subject"))
    return O.filter_videos(document_videos(spark, sf_dir), CONFIG, channels)


@query(FILTERED_SQL + " SELECT video_id, filter_category LIKE 'bac%' AS is_bac_3as, filter_category, CAST(filter_confidence AS DOUBLE) AS filter_confidence, subject FROM f")
def filter_videos(spark, sf_dir):
    return filtered(spark, sf_dir).select("video_id", "is_bac_3as", "filter_category", "filter_confidence", "subject")


@query(FILTERED_SQL + " SELECT filter_category, count(*) AS n, count(*) FILTER (WHERE filter_category LIKE 'bac%') AS accepted, round(avg(filter_confidence), 6) AS mean, round(stddev(CAST(filter_confidence AS DOUBLE)), 6) + 0.0 AS std, CAST(min(filter_confidence) AS DOUBLE) AS low, CAST(max(filter_confidence) AS DOUBLE) AS high FROM f GROUP BY 1")
def filter_statistics(spark, sf_dir):
    return rounded(O.filter_statistics(filtered(spark, sf_dir)), "mean", "std")


@query(FILTERED_SQL + """, judged AS (SELECT *, filter_category LIKE 'bac%' AS kept FROM f), reviewed AS (SELECT count(*) AS reviews, avg(CAST(kept = (video_id % 3 = 0) AS DOUBLE)) AS accuracy FROM judged WHERE video_id % 4 = 0), sizes AS (SELECT filter_category AS category, count(*) AS n FROM judged GROUP BY 1)
SELECT category, n, total_videos, kept_videos, round(kept_pct, 6) AS kept_pct, round(sure, 6) AS mean_confidence_kept, round(unsure, 6) AS mean_confidence_rejected, reviews, round(accuracy, 6) AS accuracy
FROM sizes, reviewed, (SELECT count(*) AS total_videos, count(*) FILTER (kept) AS kept_videos, count(*) FILTER (kept) * 100.0 / count(*) AS kept_pct, avg(filter_confidence) FILTER (kept) AS sure, avg(filter_confidence) FILTER (NOT kept) AS unsure FROM judged)""")
def filter_summary(spark, sf_dir):
    """The summary of a filter's output with the reviews of every fourth video, a row for each category."""
    df = filtered(spark, sf_dir)
    reviews = df.select("video_id", F.when(F.col("video_id") % 4 == 0, F.col("video_id") % 3 == 0).alias("wanted"))
    one = rounded(O.filter_summary(df, reviews), "kept_pct", "mean_confidence_kept", "mean_confidence_rejected", "accuracy")
    return one.withColumnRenamed("kept", "kept_videos").select("*", F.explode("categories").alias("category", "n")).drop("categories")


_T = "lower(text)"
_EVERY = tuple(dict.fromkeys(m.lower() for c in L.CURRICULA.values() for m in c))
TRANSCRIPTS_SQL = rf"""WITH a AS (SELECT doc_id, text, lower(text) AS t, CAST(floor(n_chars / 15) AS BIGINT) AS s, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS w FROM documents
), b AS (SELECT *, len(w) AS n, greatest(len(list_filter(regexp_split_to_array(text, '[.!?؟。]+'), lambda x: trim(x) <> '')), 1) AS k, list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouéèêëàâùûôîïœæ]+')), 1)) AS y,
  len(list_distinct(list_transform(list_filter(w, lambda x: length(x) > 2), lambda x: lower(x)))) AS u FROM a WHERE regexp_matches(text, '[^ \t\n\r\f\x0B]') AND {distinct_sql('lower(text)', L.PAGE_CODE)} < 2
), f AS (SELECT doc_id, CAST(n AS BIGINT) AS transcript_word_count, CAST(k AS BIGINT) AS transcript_sentence_count, n / k AS ws, list_sum(y) / n AS yw, CAST(u AS BIGINT) AS unique_word_count, u / n AS lexical_diversity, len(list_filter(y, lambda x: x >= 3)) / n AS hard,
  length(array_to_string(w, '')) / n AS cw, CASE WHEN s > 0 THEN n / s * 60 END AS speech_rate_wpm, {total_sql('t', ('?', '؟'))} AS question_count, {total_sql('t', L.EXAMPLES)} AS example_count, {total_sql('t', L.EXAMPLES)} / k AS example_density,
  {total_sql('t', L.EXPLANATIONS)} / n AS explanation_density, {total_sql('t', L.CONTRASTS)} / k AS contrast_density, {total_sql('t', L.TECHNICAL)} AS technical_term_count, {distinct_sql('t', _EVERY)} AS domain_keyword_count, {distinct_sql('t', L.EXAM_MARKERS)} AS bac_marker_count, {distinct_sql('t', L.TEACHING)} AS pedagogical_marker_count FROM b)"""
_SHOWN = ("avg_words_per_sentence", "lexical_diversity", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog_index", "automated_readability_index", "speech_rate_wpm", "example_density", "explanation_density", "contrast_density")


def transcripts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("n_chars") / 15).cast("long").alias("duration_sec"))
    return O.transcript_features(docs).where("transcript_word_count IS NOT NULL")


@query(TRANSCRIPTS_SQL + """ SELECT doc_id, transcript_word_count, transcript_sentence_count, unique_word_count, question_count, example_count, technical_term_count, domain_keyword_count, bac_marker_count, pedagogical_marker_count, CAST(speech_rate_wpm BETWEEN 120 AND 180 AS INTEGER) AS speech_rate_optimal, CAST(speech_rate_wpm < 100 AS INTEGER) AS speech_rate_below_optimal,
  round(ws, 6) AS avg_words_per_sentence, round(lexical_diversity, 6) AS lexical_diversity, round(206.835::DOUBLE - 1.015::DOUBLE * ws - 84.6::DOUBLE * yw, 6) AS flesch_reading_ease, round(0.39::DOUBLE * ws + 11.8::DOUBLE * yw - 15.59::DOUBLE, 6) AS flesch_kincaid_grade, round(0.4::DOUBLE * (ws + 100 * hard), 6) AS gunning_fog_index, round(4.71::DOUBLE * cw + 0.5::DOUBLE * ws - 21.43::DOUBLE, 6) AS automated_readability_index,
  round(speech_rate_wpm, 6) AS speech_rate_wpm, round(example_density, 6) AS example_density, round(explanation_density, 6) AS explanation_density, round(contrast_density, 6) AS contrast_density FROM f""")
def transcript_features(spark, sf_dir):
    counts = ("transcript_word_count", "transcript_sentence_count", "unique_word_count", "question_count", "example_count", "technical_term_count", "domain_keyword_count", "bac_marker_count", "pedagogical_marker_count", "speech_rate_optimal", "speech_rate_below_optimal")
    return transcripts(spark, sf_dir).select("doc_id", *counts, *[F.round(c, 6).alias(c) for c in _SHOWN])


@query(TRANSCRIPTS_SQL + """ SELECT doc_id, CASE WHEN speech_rate_wpm < 95 THEN 'slow' WHEN speech_rate_wpm > 115 THEN 'fast' WHEN speech_rate_wpm IS NOT NULL THEN 'optimal' END AS pace, CASE WHEN lexical_diversity >= 0.36 THEN 'excellent' WHEN lexical_diversity >= 0.315 THEN 'moderate' ELSE 'low' END AS diversity, CASE WHEN ws < 10 THEN 'too_short' WHEN ws > 20 THEN 'too_long' ELSE 'good' END AS sentence FROM f""")
def metric_ladder(spark, sf_dir):
    of = lambda name: V.metric_status(name, F.col(name))
    return transcripts(spark, sf_dir).select("doc_id", of("speech_rate_wpm").alias("pace"), of("lexical_diversity").alias("diversity"), of("avg_words_per_sentence").alias("sentence"))


@query(VIDEOS_SQL + f""", a AS (SELECT video_id, published AS p, greatest(0, date_sub('day', published, TIMESTAMP '{REFERENCE}')) AS d, CAST(dayofweek(published) NOT IN (5, 6) AS INTEGER) AS wd FROM videos)
SELECT video_id, d AS days_since_publish, dayname(p) AS publish_day_of_week, CAST(month(p) AS INTEGER) AS publish_month, CAST(year(p) AS INTEGER) AS publish_year, wd AS is_weekday, CAST(hour(p) BETWEEN 17 AND 21 AS INTEGER) AS is_evening_upload, round(sin(2 * pi() * day(p) / 31), 6) + 0.0 AS publish_day_of_month_sin, round(cos(2 * pi() * month(p) / 12), 6) + 0.0 AS publish_month_cos, d * d AS days_since_publish_squared, round(ln(1 + d), 6) AS log_days_since_publish, d * wd AS days_since_publish_x_is_weekday FROM a""")
def temporal_features(spark, sf_dir):
    df = O.temporal_features(videos(spark, sf_dir).select("video_id", "published"), "published", REFERENCE)
    flat = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return df.select("video_id", "days_since_publish", "publish_day_of_week", "publish_month", "publish_year", "is_weekday", "is_evening_upload", flat("publish_day_of_month_sin"), flat("publish_month_cos"), "days_since_publish_squared", F.round("log_days_since_publish", 6).alias("log_days_since_publish"), "days_since_publish_x_is_weekday")


@query(f"SELECT p_partkey, length(p_name) AS title_length, CAST(len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS BIGINT) AS title_word_count, CAST(len(string_split(p_type, ',')) AS BIGINT) AS tag_count, CAST({any_sql('lower(p_name)', L.EXAM_FOCUS)} AS INTEGER) AS is_exam_focused, CAST(p_name LIKE '%?' AS INTEGER) AS is_title_question, {distinct_sql('lower(p_name)', L.EXAM_MARKERS)} AS title_bac_markers FROM part")
def title_features(spark, sf_dir):
    df = O.title_features(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("tags")))
    return df.select("p_partkey", "title_length", "title_word_count", "tag_count", "is_exam_focused", "is_title_question", "title_bac_markers")


@query(f"SELECT p_partkey, CASE WHEN length(p_name) < 30 THEN 'title_short' WHEN length(p_name) > 80 THEN 'title_long' ELSE 'title_ok' END || ',' || CASE WHEN {any_sql('lower(p_name)', L.TIP_KEYWORDS)} THEN 'keywords_ok' ELSE 'keywords_add' END || CASE WHEN p_size = 0 THEN '' WHEN p_size < 5 THEN ',duration_short' WHEN p_size > 60 THEN ',duration_long' ELSE ',duration_ok' END || CASE WHEN p_type = '' THEN ',description_add' WHEN length(p_type) < 100 THEN ',description_short' ELSE '' END || CASE WHEN contains(p_name, 'red') THEN ',exam_focus' ELSE '' END AS tips FROM part")
def quick_tips(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", O.quick_tips(F.col("p_name"), F.col("p_size"), F.col("p_type"), F.contains("p_name", F.lit("red"))).alias("tips"))


@query(f"SELECT kind, valid, count(*) AS n FROM (SELECT kind, coalesce(regexp_matches(t, '[^ \\t\\n\\r\\f\\x0B]') AND {distinct_sql('lower(t)', L.PAGE_CODE)} < 2, false) AS valid FROM (SELECT 'document' AS kind, text AS t FROM documents UNION ALL SELECT 'page', html FROM pages)) GROUP BY ALL")
def valid_transcripts(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("text").alias("t")).unionByName(table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("t")))
    return both.groupBy("kind", O.valid_transcript(F.col("t")).alias("valid")).agg(F.count("*").alias("n"))


_CUT = r"[ \t\n\r\f\x0B]+"
@query(rf"""WITH a AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^{_CUT}|{_CUT}$', '', 'g')),
  lambda x: x <> '' AND NOT starts_with(x, 'WEBVTT') AND NOT starts_with(x, 'NOTE') AND NOT contains(x, '-->') AND NOT regexp_matches(x, '^\d+:\d+') AND {distinct_sql('lower(x)', L.PAGE_CODE)} = 0), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), ' ')) AS digest FROM a""")  # fmt: skip
def clean_captions(spark, sf_dir):
    return O.clean_captions(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def halves(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return events.where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), events.where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10') GROUP BY 1")
def merge_append(spark, sf_dir):
    return O.merge_snapshots(*halves(spark, sf_dir), "append", "user_id", "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def merge_dedupe(spark, sf_dir):
    return O.merge_snapshots(*halves(spark, sf_dir), "dedupe", "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("WITH a AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00' GROUP BY 1), b AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.f, b.f) AS first_seen, coalesce(b.l, a.l) AS last_seen, a.user_id IS NULL AS is_new FROM a FULL JOIN b ON a.user_id = b.user_id")
def registry_upsert(spark, sf_dir):
    events, at = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at")), "TIMESTAMP_NTZ '2024-01-01 06:00:00'"
    known = events.where(f"at < {at}").groupBy("key").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    return O.registry_upsert(known, events.where(f"at >= {at}")).withColumnRenamed("key", "user_id")


_ERFC = "t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x)"


@query(LEVELLED_SQL + f""", two AS (SELECT level, CAST(duration_sec AS DOUBLE) AS v FROM levelled WHERE level <> 'Medium'
), ranked AS (SELECT level, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS k, CAST(count(*) OVER (PARTITION BY v) AS DOUBLE) AS c FROM two
), o AS (SELECT count(*) FILTER (WHERE level = 'High') AS n1, count(*) FILTER (WHERE level = 'Low') AS n0, avg(v) FILTER (WHERE level = 'High') AS m1, avg(v) FILTER (WHERE level = 'Low') AS m0, stddev(v) FILTER (WHERE level = 'High') AS s1, stddev(v) FILTER (WHERE level = 'Low') AS s0,
  median(v) FILTER (WHERE level = 'High') AS d1, median(v) FILTER (WHERE level = 'Low') AS d0, sum(k) FILTER (WHERE level = 'High') AS r1, sum(c * c - 1) AS tt FROM ranked
), z AS (SELECT *, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n0 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n0 / 2 - 0.5) / sqrt(CAST(n1 * n0 AS DOUBLE) / 12 * (n1 + n0 + 1 - tt / ((n1 + n0) * (n1 + n0 - 1.0::DOUBLE)))) AS z FROM o
), y AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z)
SELECT n1 AS n_high, n0 AS n_low, round(m1, 6) AS high_mean, round(m0, 6) AS low_mean, round(d1, 6) AS high_median, round(d0, 6) AS low_median, round((m1 - m0) / m0 * 100, 6) AS diff_pct, round(least(1.0::DOUBLE, CASE WHEN z >= 0 THEN {_ERFC} ELSE 2 - {_ERFC} END), 6) AS p_value, round((m1 - m0) / sqrt((s1 * s1 + s0 * s0) / 2), 6) AS cohens_d FROM y""")
def compare_groups(spark, sf_dir):
    out = S.compare_groups(levelled(spark, sf_dir), "level", "High", "Low", "duration_sec")
    return rounded(out, "high_mean", "low_mean", "high_median", "low_median", "diff_pct", "p_value", "cohens_d")


_KEYS = ("urgent", "low", "not", "zzz")


@query(LEVELLED_SQL + ", k AS (SELECT unnest(['urgent', 'low', 'not', 'zzz']) AS keyword), r AS (SELECT keyword, avg(CASE WHEN contains(lower(title), keyword) THEN 1.0 ELSE 0.0 END) FILTER (WHERE level = 'High') AS h, avg(CASE WHEN contains(lower(title), keyword) THEN 1.0 ELSE 0.0 END) FILTER (WHERE level = 'Low') AS l FROM levelled, k GROUP BY keyword) SELECT keyword, round(h * 100, 6) AS high_pct, round(l * 100, 6) AS low_pct, round(CASE WHEN l > 0 THEN (h - l) / l * 100 WHEN h > 0 THEN 100 ELSE 0 END, 6) AS lift_pct FROM r")
def keyword_lift(spark, sf_dir):
    """One pass with two averages a keyword, then a row for each keyword."""
    has = lambda k: F.contains(F.lower("title"), F.lit(k)).cast("double")
    one = levelled(spark, sf_dir).agg(*[F.avg(F.when(F.col("level") == g, has(k))).alias(f"{g}{i}") for i, k in enumerate(_KEYS) for g in ("High", "Low")])
    rows = one.selectExpr(f"stack({len(_KEYS)}, " + ", ".join(f"'{k}', High{i}, Low{i}" for i, k in enumerate(_KEYS)) + ") AS (keyword, h, l)")
    lift = F.when(F.col("l") > 0, (F.col("h") - F.col("l")) / F.col("l") * 100).when(F.col("h") > 0, 100.0).otherwise(0.0)
    return rows.select("keyword", F.round(F.col("h") * 100, 6).alias("high_pct"), F.round(F.col("l") * 100, 6).alias("low_pct"), F.round(lift, 6).alias("lift_pct"))


_PATTERNS = {"links": "http", "timestamps": "[0-9]{1,2}:[0-9]{2}", "hashtags": "#[A-Za-z0-9_]+", "social": "(instagram|facebook|twitter|telegram|tiktok)"}


@query("SELECT toxic, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN regexp_matches(lower(text), '{p}') THEN 100.0 ELSE 0.0 END), 6) AS {k}" for k, p in _PATTERNS.items()) + " FROM documents JOIN labels USING (doc_id) GROUP BY toxic")
def description_practices(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return df.groupBy("toxic").agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(F.rlike(F.lower("text"), F.lit(p)), 100.0).otherwise(0.0)), 6).alias(k) for k, p in _PATTERNS.items()])


@query(LEVELLED_SQL + ", c AS (SELECT subject, channel_id, avg(score) AS m, count(*) AS n FROM levelled GROUP BY 1, 2), g AS (SELECT subject FROM levelled GROUP BY 1 HAVING count(*) >= 50 AND count(*) FILTER (WHERE level = 'High') >= 10) SELECT * FROM (SELECT subject, channel_id, round(m, 6) AS mean_score, n, row_number() OVER (PARTITION BY subject ORDER BY round(m, 6) DESC, channel_id) AS rank FROM c JOIN g USING (subject)) WHERE rank <= 3")
def subject_practices(spark, sf_dir):
    df = levelled(spark, sf_dir)
    wide = df.groupBy("subject").agg(F.count("*").alias("a"), F.count_if(F.col("level") == "High").alias("b")).where("a >= 50 AND b >= 10").select("subject")
    means = df.groupBy("subject", "channel_id").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n")).join(wide, "subject", "left_semi")
    return R.top_per_group(means, "subject", 3, F.desc("mean_score"), F.col("channel_id"))


@query("SELECT l_returnflag, round(skewness(l_extendedprice), 5) AS skewness, round(kurtosis(l_extendedprice), 5) AS kurtosis FROM lineitem GROUP BY 1")
def describe_shape(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*S.shape("l_extendedprice")), "skewness", "kurtosis", digits=5)


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a, b in _PAIRS))
def correlation_pairs(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").agg(*[(F.round(F.corr(a, b), 6) + 0.0).alias(f"r{i}") for i, (a, b) in enumerate(_PAIRS)])
    return one.selectExpr(f"stack({len(_PAIRS)}, " + ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(_PAIRS)) + ") AS (a, b, r)")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(CAST({a} AS DOUBLE) * {b}) / count(*), 4) AS dot FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i:]))
def gram_matrix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return S.gram(lines, list(_NUMBERS)).crossJoin(F.broadcast(lines.agg(F.count("*").alias("n")))).select("a", "b", F.round(F.col("dot") / F.col("n"), 4).alias("dot"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) + 0.0 AS o_totalprice FROM orders")
def standardised(spark, sf_dir):
    df = S.standardised(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return df.select("o_orderkey", (F.round("o_totalprice", 6) + 0.0).alias("o_totalprice"))


_TEST = "CAST('0x' || substr(md5('42:' || CAST(video_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20"


@query(SCORED_SQL + f", s AS (SELECT score AS y, {_TEST} AS test FROM scored), m AS (SELECT avg(y) AS p FROM s WHERE NOT test) SELECT round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) ** 2), 6) AS mse, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM s, m WHERE test")
def regression_metrics(spark, sf_dir):
    df = scored(spark, sf_dir).select("score", S.in_test("video_id", "42").alias("test"))
    mean = df.where("NOT test").agg(F.avg("score").alias("predicted"))
    return rounded(S.regression_metrics(df.where("test").crossJoin(F.broadcast(mean)), "score", "predicted"), "mae", "mse", "rmse", "r2")


@query("WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM orders, b GROUP BY 1")
def histogram_50(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    edges = orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    place = F.least(F.floor((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50), F.lit(49)).cast("long")
    return orders.crossJoin(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS day) SELECT day, count(o_orderkey) AS n FROM d LEFT JOIN orders ON dayname(o_orderdate) = day AND o_orderpriority = '1-URGENT' GROUP BY day")
def weekday_counts(spark, sf_dir):
    """Every day has a row, also one without orders."""
    days = spark.createDataFrame([(d,) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")], "day string")
    n = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.date_format("o_orderdate", "EEEE").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").na.fill(0)


@query("SELECT user_id, max(run) AS longest FROM (SELECT user_id, island, count(*) FILTER (WHERE event_type = 'error') AS run FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) GROUP BY ALL) GROUP BY 1")
def consecutive_failures(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    events = table(spark, sf_dir, "events").withColumn("island", F.sum((F.col("event_type") != "error").cast("long")).over(w))
    return events.groupBy("user_id", "island").agg(F.count_if(F.col("event_type") == "error").alias("run")).groupBy("user_id").agg(F.max("run").alias("longest"))


@query("SELECT CASE WHEN k < 25 THEN 'no transcript' WHEN k < 50 THEN 'page code' WHEN k < 75 THEN 'network' ELSE 'other' END AS reason, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error') GROUP BY 1")
def failure_taxonomy(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    reason = F.when(k < 25, "no transcript").when(k < 50, "page code").when(k < 75, "network").otherwise("other")
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, round(avg(CASE WHEN (quality = 0) = (toxic = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(count(*) FILTER (WHERE toxic = 1 AND quality = 1) * 1.0 / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS fp_rate, CASE WHEN avg(CASE WHEN (quality = 0) = (toxic = 1) THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'KEEP' WHEN avg(CASE WHEN (quality = 0) = (toxic = 1) THEN 1.0 ELSE 0.0 END) >= 0.7 THEN 'MONITOR' WHEN avg(CASE WHEN (quality = 0) = (toxic = 1) THEN 1.0 ELSE 0.0 END) >= 0.6 THEN 'REVIEW' ELSE 'REMOVE' END AS recommendation FROM documents JOIN labels USING (doc_id) GROUP BY source")
def channel_accuracy(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    truth, said = F.col("quality") == 0, F.col("toxic") == 1
    out = df.groupBy("source").agg(F.count("*").alias("n"), F.avg((truth == said).cast("double")).alias("a"), F.round(F.try_divide(F.count_if(said & ~truth), F.count_if(said)), 6).alias("fp_rate"))
    advice = F.when(F.col("a") >= 0.8, "KEEP").when(F.col("a") >= 0.7, "MONITOR").when(F.col("a") >= 0.6, "REVIEW").otherwise("REMOVE")
    return out.select("source", "n", F.round("a", 6).alias("accuracy"), "fp_rate", advice.alias("recommendation"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("WITH a AS (SELECT *, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE - INTERVAL 1 MICROSECOND AS gap FROM events), b AS (SELECT *, sum(CASE WHEN coalesce(gap, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS began, count(*) AS n FROM b GROUP BY user_id, s")
def user_sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("began"), F.count("*").alias("n")).drop("w")


@query("SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS score FROM embeddings WHERE label = 2 ORDER BY score DESC, vec_id LIMIT 10")
def vector_top_k_filtered(spark, sf_dir):
    """The category filters before the ranking; the question is one vector."""
    base = table(spark, sf_dir, "embeddings")
    asked = base.where("vec_id = 0").first()["embedding"]
    return V.retrieve(base, asked, 10, "vec_id", F.col("label") == 2).select("vec_id", "label", "score")


@query("""WITH h AS (SELECT vec_id, CASE label WHEN 1 THEN 'global' ELSE CAST(label AS VARCHAR) END AS subject, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50
), t AS (SELECT *, CASE subject WHEN '2' THEN 0 WHEN 'global' THEN 1 ELSE 2 END AS tier FROM h), c AS (SELECT count(*) FILTER (tier = 0) AS own, count(*) FILTER (tier = 1) AS general FROM t)
SELECT vec_id, subject, score, tier FROM t, c WHERE tier = 0 OR (tier = 1 AND own < 3) OR (tier = 2 AND own + general = 0) ORDER BY score DESC, vec_id LIMIT 5""")
def retrieval_priority(spark, sf_dir):
    """One question's fifty best, its subject before the general ones; planned_retrieval does it for many questions of many plans."""
    base = table(spark, sf_dir, "embeddings").withColumn("subject", F.when(F.col("label") == 1, "global").otherwise(F.col("label").cast("string")))
    return V.prioritised(V.retrieve(base, base.where("vec_id = 0").first()["embedding"], 50, "vec_id"), "vec_id", "subject", "2", 5)


def vif_selection(spark, sf_dir):
    """The lines' columns that survive selection, with a copy and a constant to drop; the algorithm is iterative."""
    df = table(spark, sf_dir, "lineitem").select(*_NUMBERS, (F.col("l_quantity") * 2).alias("twice"), F.lit(1.0).alias("constant"))
    return spark.createDataFrame([(c,) for c in S.select_by_vif(df, df.columns)], "column_name string")


def forest_predictions(spark, sf_dir):
    """Held-out predictions of a small forest; the published size is the default of the operator."""
    df = scored(spark, sf_dir).select("video_id", "score", *[F.col(c).cast("double").alias(c) for c in ("views", "likes", "duration_sec")])
    _, _, predictions = S.train(df, "video_id", ["views", "likes", "duration_sec"], "score", numTrees=8, maxDepth=6)
    return predictions.select("video_id", F.round("predicted", 6).alias("predicted"))


QUERIES |= {f.__name__: f for f in (vif_selection, forest_predictions)}
