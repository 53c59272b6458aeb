"""Cleaning, composed feature tables, the registry's readings, the predictor, data quality, knowledge chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .lessons import temporal_features, title_features, transcript_features, valid_transcript

COUNTS = ("view_count", "like_count", "comment_count", "duration_sec")
CHANNEL_FEATURES = ("channel_video_count", "channel_avg_views", "channel_age_days")
UNKNOWN = "Unknown"


def clean_videos(videos: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """Text nulls empty, counts whole numbers (0 where they are none), publish_date a UTC timestamp, and has_transcript:
    whether transcripts (video_id, transcript_available, transcript_text) has a valid one."""
    if transcripts is None:
        out = videos.withColumn("has_transcript", F.lit(False))
    else:
        good = clean_transcripts(transcripts).select("video_id", F.lit(True).alias("__has")).distinct()
        out = videos.join(good, "video_id", "left").withColumn("has_transcript", F.coalesce("__has", F.lit(False))).drop("__has")
    kinds = dict(out.dtypes)
    made = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("description", "tags") if c in kinds}
    made |= {c: F.coalesce(F.col(c).try_cast("double").try_cast("long"), F.lit(0).cast("long")) for c in COUNTS if c in kinds}
    if kinds.get("publish_date") == "string":
        made["publish_date"] = C.utc_timestamp(F.col("publish_date"))
    return out.withColumns(made)


def clean_transcripts(transcripts: DataFrame) -> DataFrame:
    """The rows that are marked available and hold a valid transcript, without failure_reason."""
    ok = F.coalesce(F.col("transcript_available"), F.lit(False)) & F.coalesce(valid_transcript(F.col("transcript_text")), F.lit(False))
    return transcripts.where(ok).drop("failure_reason")


def learn_channels(videos: DataFrame, reference: str) -> DataFrame:
    """A row for each channel: commonest subject (the first in order of equals), videos, mean views, age in days."""
    subject = F.coalesce(F.mode("subject", True), F.lit(UNKNOWN)) if "subject" in videos.columns else F.lit(UNKNOWN)
    age = F.expr(f"timestampdiff(DAY, min(publish_date), TIMESTAMP '{reference}')")
    return videos.where("channel_id IS NOT NULL").groupBy("channel_id").agg(
        subject.alias("subject"), F.count("*").alias("channel_video_count"), F.avg("view_count").alias("channel_avg_views"), age.alias("channel_age_days"))


def channel_defaults(channels: DataFrame) -> DataFrame:
    """One row: the median of each channel feature, for videos of unknown channels. Features are ranked in bins, so no
    task holds the values of all channels."""
    from .relational import group_quantiles

    each = channels.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in CHANNEL_FEATURES])).alias("x")).select("x.*")
    medians = group_quantiles(each, "name", "v", [0.5])  # a row for each feature
    return medians.agg(*[F.max(F.when(F.col("name") == c, F.get("q", F.lit(0)))).alias(c) for c in CHANNEL_FEATURES])


def video_features(videos: DataFrame, channels: DataFrame, reference: str) -> DataFrame:
    """videos with temporal, title, transcript and channel features. A given subject goes before the channel's, and
    Unknown stands where there is neither; channel features that are missing take the median over channels."""
    known = channels.select("channel_id", F.col("subject").alias("__subject"), *[F.col(c).alias(f"__{c}") for c in CHANNEL_FEATURES])
    medians = channel_defaults(channels).select(*[F.col(c).alias(f"__d_{c}") for c in CHANNEL_FEATURES])
    given = F.col("subject") if "subject" in videos.columns else F.lit(None).cast("string")
    df = videos.join(known, "channel_id", "left").crossJoin(F.broadcast(medians))
    df = df.withColumn("subject", F.coalesce(given, F.col("__subject"), F.lit(UNKNOWN)))
    df = df.withColumns({c: F.coalesce(f"__{c}", f"__d_{c}") for c in CHANNEL_FEATURES}).drop("__subject", *[f"__{c}" for c in CHANNEL_FEATURES], *[f"__d_{c}" for c in CHANNEL_FEATURES])
    at = F.expr(f"coalesce(publish_date, TIMESTAMP '{reference}')")  # a planned video counts as published at the reference
    df = title_features(temporal_features(df.withColumn("publish_date", at), "publish_date", reference))
    if "transcript_text" not in df.columns:
        df = df.withColumn("transcript_text", F.lit(None).cast("string"))
    df = df.withColumn("has_transcript", valid_transcript(F.col("transcript_text")).cast("int"))
    return transcript_features(df, "transcript_text", "duration_sec", "subject")


def ratios(df: DataFrame) -> DataFrame:
    """df with like_ratio and comment_ratio, per view; no views count as one."""
    views = F.greatest(F.coalesce("view_count", F.lit(0)), F.lit(1))
    return df.withColumns({f"{c}_ratio": F.coalesce(f"{c}_count", F.lit(0)) / views for c in ("like", "comment")})


def engineered_export(videos: DataFrame, reference: str) -> DataFrame:
    """The feature table of all videos with ratios, engagement score and category; channels are learned on all of them."""
    from .relational import exact_quantiles

    df = ratios(video_features(videos, learn_channels(videos, reference), reference))
    of = lambda c: F.coalesce(c, F.lit(0))
    df = df.withColumn("engagement_score", C.engagement_score(of("view_count"), of("like_count"), of("comment_count")))
    cuts = exact_quantiles(df, "engagement_score", [0.33, 0.67])
    category = C.level(F.col("engagement_score"), F.get("q", F.lit(0)), F.get("q", F.lit(1)))
    return df.crossJoin(F.broadcast(cuts)).withColumn("engagement_category", category).drop("q")


def counts_by_channel(registry: DataFrame) -> DataFrame:
    return registry.groupBy("channel_id").agg(F.count("*").alias("n"))


def ids_for_enrichment(registry: DataFrame, held: DataFrame, n: int | None = None) -> DataFrame:
    """Registered ids that held lacks, oldest first, then by key; at most n, all where n is 0 or None."""
    todo = registry.join(held.select("key").distinct(), "key", "left_anti").orderBy("first_seen", "key")
    return todo.limit(n) if n else todo


def bootstrap(videos: DataFrame, key: str, at: str) -> DataFrame:
    """A registry of videos that were collected without one."""
    return videos.groupBy(F.col(key).alias("key")).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def merged_by_position(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Without a date to order by, the new rows go before the existing ones of the same key."""
    from .relational import latest_per_key

    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [F.desc(c) for c in sorted(both.columns) if c not in (key, "__new")]
    return latest_per_key(both, key, F.desc("__new"), *rest).drop("__new")


def numeric_columns(df: DataFrame, most_missing: float = 0.5) -> list[str]:
    """Numeric columns of which less than most_missing is null, in order; one row comes to the driver."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    if not names:
        return []
    row = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if row["__n"] and 1 - row[c] / row["__n"] < most_missing]


def missing_matrix(df: DataFrame) -> DataFrame:
    """1 where a cell is null, else 0."""
    return df.select(*[F.col(c).isNull().cast("int").alias(c) for c in df.columns])


def filled_by_pattern(df: DataFrame, tokens: dict[str, float]) -> DataFrame:
    """Nulls of numeric columns whose name holds a token become its value; the first token that fits counts."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    chosen = {c: next((v for t, v in tokens.items() if t in c), None) for c in names}
    return df.na.fill({c: v for c, v in chosen.items() if v is not None})


def quality_rows(df: DataFrame, name: str, key: str) -> DataFrame:
    """(table_name, measure, n, pct, severity): rows, repeated rows, repeated keys, and nulls by column with their severity; one scan
    for the counts and one shuffle by key."""
    n = F.count("*")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in df.columns]
    one = df.agg(n.alias("rows"), (n - F.count_distinct(F.struct(*df.columns))).alias("repeated rows"), (F.count(key) - F.count_distinct(F.col(key))).alias("repeated keys"), *nulls)
    checks = [c for c in one.columns]
    stacked = ", ".join(f"'{c}', `{c}`" for c in checks)
    total = F.max(F.when(F.col("measure") == "rows", F.col("n")))
    rows = one.selectExpr(f"stack({len(checks)}, {stacked}) AS (measure, n)")
    rows = rows.crossJoin(F.broadcast(rows.agg(total.alias("total"))))
    pct = F.coalesce(F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 6), F.lit(0.0))
    return rows.select(F.lit(name).alias("table_name"), "measure", "n", pct.alias("pct")).withColumn("severity", F.when(F.col("measure").startswith("missing"), C.severity(F.col("pct"))))


def binarised(df: DataFrame, labels: str, classes: list[str]) -> DataFrame:
    """df with a 0/1 column for each class of an array column; a null array has none."""
    return df.withColumns({f"{labels}_{c}": F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("int") for c in classes})


def flattened(df: DataFrame, nested: str, n: int) -> DataFrame:
    """df with the first n values of a nested list as columns."""
    flat = F.flatten(F.col(nested))
    return df.withColumns({f"{nested}_{i}": F.get(flat, F.lit(i)) for i in range(n)})


def converted(df: DataFrame, vectors: tuple = (), lists: tuple = ()) -> DataFrame:
    """CSV text as values: literal lists of numbers as arrays, comma lists as arrays of trimmed words."""
    made = {c: F.from_json(c, "array<double>") for c in vectors}
    made |= {c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "") for c in lists}
    return df.withColumns(made)


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of image files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


#: Segments as a speech recogniser writes them.
SEGMENT = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("language", T.StringType())])


def joined_segments(segments: DataFrame) -> DataFrame:
    """(video_id, text, language, seconds): a video's segments in order of their start."""
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
    out = segments.groupBy("video_id").agg(parts.alias("p"), F.mode("language", True).alias("language"), F.max("end").alias("seconds"))
    return out.select("video_id", F.array_join(F.transform("p", lambda x: F.trim(x["text"])), " ").alias("text"), "language", "seconds")


class EngagementPredictor:
    """A fitted pipeline with its channel table: features of planned or published videos in, predicted scores out."""

    def __init__(self, model, channels: DataFrame, features: list[str], reference: str):
        self.model, self.channels, self.features, self.reference = model, channels, features, reference

    @classmethod
    def fit(cls, videos: DataFrame, features: list[str], reference: str, model: str = "forest", **params) -> EngagementPredictor:
        """Videos without views teach nothing and are left out."""
        from .statistics import pipeline

        seen = videos.where("view_count > 0")
        channels = learn_channels(seen, reference)
        df = video_features(seen, channels, reference)
        df = df.withColumn("engagement_score", C.engagement_score(F.col("view_count"), F.coalesce("like_count", F.lit(0)), F.coalesce("comment_count", F.lit(0))))
        return cls(pipeline(features, "engagement_score", model, **params).fit(df.na.fill(0.0, features).na.fill(0, features)), channels, features, reference)

    def predict_batch(self, videos: DataFrame) -> DataFrame:
        """videos with predicted; every row is kept."""
        df = video_features(videos, self.channels, self.reference).na.fill(0.0, self.features).na.fill(0, self.features)
        return self.model.transform(df).select(*videos.columns, "predicted")

    def save(self, path: str) -> None:
        from ..sources.sinks import save_bundle

        spark = self.channels.sparkSession
        save_bundle(spark, self.model, {"features": self.features, "reference": self.reference}, path)
        self.channels.write.mode("overwrite").parquet(f"{path}/channels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EngagementPredictor:
        from ..sources.sinks import load_bundle

        model, meta = load_bundle(spark, path)
        return cls(model, spark.read.parquet(f"{path}/channels"), meta["features"], meta["reference"])


def knowledge_chunks(files: DataFrame) -> DataFrame:
    """(chunk_id, category, subject, content) from JSON texts (subject, value).

    Each section is a chunk; a section that is an object of objects, such as the impact of each keyword, gives a chunk
    for each of them instead. Texts that are no JSON object give none.
    """
    sections = files.select("subject", F.explode(F.from_json("value", "map<string,string>")).alias("category", "section"))
    inner = F.from_json("section", "map<string,string>")
    nested = F.coalesce(F.size(F.filter(F.map_values(inner), lambda v: v.startswith("{"))) == F.size(inner), F.lit(False)) & (F.size(inner) > 0)
    entries = F.when(nested, F.map_entries(inner)).otherwise(F.array(F.struct(F.lit("").alias("key"), F.col("section").alias("value"))))
    out = sections.select("subject", "category", F.explode(entries).alias("e"))
    return out.select(F.concat_ws(":", "subject", "category", F.nullif(F.col("e.key"), F.lit(""))).alias("chunk_id"), "category", "subject", F.col("e.value").alias("content"))


#: How many rows each of the six sub-questions asks for.
ASKED = (3, 3, 2, 2, 2, 1)


def sub_questions(subject: Column, title: Column, minutes: Column) -> Column:
    """Up to six questions on a planned video, each with its number of rows."""
    texts = [F.concat(F.lit("title practices "), subject), F.concat(F.lit("best duration "), subject), F.concat(F.lit("description practices "), subject), F.concat(F.lit("publishing time "), subject), F.concat(F.lit("speech rate "), subject), title]
    rows = [F.struct(F.lit(i).alias("nr"), t.alias("question"), F.lit(k).alias("k")) for i, (t, k) in enumerate(zip(texts, ASKED, strict=True))]
    rows[1] = F.when(minutes.isNotNull(), rows[1])
    return F.array_compact(F.array(*rows))


def benchmark_figures(text: Column) -> Column:
    """Figures that a benchmark text states, null where it states none."""
    number = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double")
    return F.struct(
        number(r"(?i)([0-9]+(?:[.][0-9]+)?) *(?:minutes|min)").alias("minutes"), number(r"(?i)([0-9]+(?:[.][0-9]+)?) *wpm").alias("wpm"), number(r"([0-9]+(?:[.][0-9]+)?) *%").alias("percent"))


def bucketed(category: Column) -> Column:
    """The part of the prompt that a practice belongs to, by what its category's name holds."""
    return C.reason(category, {"title": "title", "duration": "duration", "timing": "timing", "day": "timing", "transcript": "delivery", "content": "delivery", "description": "description"}, "general")


def prompt(question: str, practices: list[tuple[str, str]], most_chars: int = 500) -> str:
    """The practices (bucket, content) by bucket under a question; each is cut to most_chars characters."""
    lines = [question]
    for name in dict.fromkeys(b for b, _ in practices):
        lines += ["", f"[{name}]", *[f"- {c[:most_chars]}" for b, c in practices if b == name]]
    return "\n".join(lines)


def advise(question: str, practices: list[tuple[str, str]], call) -> str:
    """What the callable makes of the prompt; it holds the network client and its settings."""
    return call(prompt(question, practices))
