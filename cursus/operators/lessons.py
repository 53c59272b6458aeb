"""Operators on videos, channels and transcripts: the channel filter, features, captions, registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..sources.sinks import scratch


@dataclass(frozen=True)
class FilterConfig:
    """The channel filter's lists and thresholds. An empty list matches nothing."""

    exam: tuple = L.EXAM
    other: tuple = L.OTHER_GRADES
    strong: tuple = L.STRONG_INTENT
    heavy_min: float = 0.5
    other_max: float = 0.1
    min_seconds: int = 120
    require_terms: bool = False
    require_duration: bool = True
    allow_subject: bool = True
    samples: dict = field(default_factory=lambda: {"bac_3as": 100, "bac_3as_ambiguous": 100, "non_bac": 50, "conflict": 50})

    @classmethod
    def from_yaml(cls, path: str) -> FilterConfig:
        """A missing file or an empty marker list is an error."""
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
        lists = {"exam": raw["markers"].get("bac"), "other": raw["markers"].get("non_bac"), "strong": raw["markers"].get("strong_bac_intent")}
        if missing := [k for k, v in lists.items() if not v]:
            raise ValueError(f"empty marker lists: {missing}")
        prior, soft, v = raw.get("channel_prior", {}), raw.get("soft_positives", {}), raw.get("validation", {})
        found = {
            "heavy_min": prior.get("bac_threshold", 0.7), "other_max": prior.get("non_bac_max", 0.1), "min_seconds": soft.get("duration_min", 120),
            "require_terms": soft.get("require_tfidf", False), "require_duration": soft.get("require_duration", False), "allow_subject": soft.get("allow_channel_subject", True),
        }
        sizes = {"bac_3as": v.get("sample_bac_3as", 100), "bac_3as_ambiguous": v.get("sample_bac_ambiguous", 100), "non_bac": v.get("sample_non_bac", 50), "conflict": v.get("sample_conflict", 50)}
        return cls(**{k: tuple(map(str, x)) for k, x in lists.items()}, **found, samples=sizes)


def searched_text(df: DataFrame) -> Column:
    """Title, description and tags in lower case, absent or null ones empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in ("title", "description", "tags")]
    return F.lower(F.concat_ws(" ", *parts))


def channel_priors(videos: DataFrame, config: FilterConfig) -> DataFrame:
    """Marked videos by channel, the share of exam marks among marked ones, and whether the channel is heavy."""
    text = F.col("__text")
    exam, other = C.any_of(text, config.exam), C.any_of(text, config.other)
    n = videos.withColumn("__text", searched_text(videos)).groupBy("channel_id").agg(
        F.count("*").alias("total"), F.count_if(exam).alias("n_exam"), F.count_if(other).alias("n_other"), F.count_if(exam | other).alias("n_any"))
    of = lambda c: F.col(c) / F.greatest("n_any", F.lit(1))
    out = n.withColumns({"p_exam": of("n_exam"), "p_other": of("n_other")})
    return out.withColumn("heavy", (F.col("p_exam") >= config.heavy_min) & (F.col("p_other") <= config.other_max))


def filter_videos(videos: DataFrame, config: FilterConfig, channels: DataFrame | None = None, priors: DataFrame | None = None, terms: tuple = ()) -> DataFrame:
    """Videos with is_bac_3as, filter_category, filter_confidence, filter_reason and subject.

    channels (channel_id, subject) may be None. One CASE gives all outputs; channels are one equi-join each, on
    tables with a row a channel. A null duration counts as 0.
    """
    priors = channel_priors(videos, config) if priors is None else priors
    df = videos.join(priors.select("channel_id", "heavy"), "channel_id", "left")
    if channels is not None:
        known = channels.groupBy("channel_id").agg(F.min("subject").alias("__subject"))
        df = df.join(known, "channel_id", "left")
    else:
        df = df.withColumn("__subject", F.lit(None).cast("string"))
    df = df.withColumn("__text", searched_text(videos)).withColumn("__seconds", F.coalesce(F.col("duration_sec"), F.lit(0)))
    text, seconds, subject = F.col("__text"), F.col("__seconds"), F.coalesce(*([F.col("subject")] if "subject" in videos.columns else []), F.col("__subject"), F.lit("Unknown"))
    exam, other, strong = (C.any_of(text, m) for m in (config.exam, config.other, config.strong))
    long_enough, hit, has_subject = seconds >= config.min_seconds, C.any_of(text, terms), F.lit(config.allow_subject) & F.col("__subject").isNotNull()
    wanted = [c for c, on in ((hit, config.require_terms), (long_enough, config.require_duration)) if on]
    passed = (wanted[0] & wanted[1] if len(wanted) == 2 else wanted[0]) if wanted else long_enough | hit | has_subject
    found = F.array_compact(F.array(F.when(long_enough, f"duration >= {config.min_seconds}s"), F.when(hit, "TF-IDF term hit"), F.when(has_subject, F.concat(F.lit("channel subject: "), subject))))
    soft = F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("no soft positives")

    def verdict(yes: bool, category: str, confidence: float, reason) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(yes).alias("is_bac_3as"), F.lit(category).alias("filter_category"), F.lit(confidence).alias("filter_confidence"), why.alias("filter_reason"))

    # The reasons are part of the output's format.
    short = F.format_string(f"Video too short (%.0fs < {config.min_seconds}s minimum)", seconds.cast("double"))
    rules = F.when(F.lit(config.require_duration) & ~long_enough, verdict(False, "non_bac", 0.8, short))
    rules = rules.when(other & ~exam & strong, verdict(True, "bac_3as", 0.7, "Strong Bac intent overrides non-Bac markers"))
    rules = rules.when(other & ~exam, verdict(False, "non_bac", 0.9, "Non-Bac grade markers detected"))
    rules = rules.when(exam & other & strong, verdict(True, "bac_3as", 0.75, "Both markers present, strong Bac intent resolves conflict"))
    rules = rules.when(exam & other, verdict(False, "non_bac", 0.5, "Both Bac and non-Bac markers present, no strong intent"))
    rules = rules.when(exam, verdict(True, "bac_3as", 0.95, "Explicit Bac markers detected"))
    rules = rules.when(~F.coalesce("heavy", F.lit(False)), verdict(False, "unknown", 0.4, "No markers, channel not Bac-heavy"))
    rules = rules.when(passed, verdict(True, "bac_3as_ambiguous", 0.65, F.concat(F.lit("Bac-heavy channel + soft positives ("), soft, F.lit(")"))))
    rules = rules.otherwise(verdict(False, "unknown", 0.35, F.concat(F.lit("Bac-heavy channel but no soft positives ("), soft, F.lit(")"))))
    kept = [c for c in videos.columns if c != "subject"]
    return df.withColumn("__v", rules).select(*kept, "__v.*", subject.alias("subject"))


def filter_statistics(filtered: DataFrame) -> DataFrame:
    c = F.col("filter_confidence")
    return filtered.groupBy("filter_category").agg(F.count("*").alias("n"), F.count_if("is_bac_3as").alias("accepted"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))


def filter_summary(filtered: DataFrame, reviews: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    """One row on a filter's whole output: videos, kept ones and their share, the categories' sizes, mean confidence of kept and
    rejected ones and, with reviews (key, wanted), how many were reviewed and the share of right decisions. A null review is none."""
    kept, c = F.coalesce(F.col("is_bac_3as"), F.lit(False)), F.col("filter_confidence")
    one = filtered.agg(
        F.count("*").alias("total_videos"), F.count_if(kept).alias("kept"), (F.count_if(kept) * 100 / F.count("*")).alias("kept_pct"),
        F.avg(F.when(kept, c)).alias("mean_confidence_kept"), F.avg(F.when(~kept, c)).alias("mean_confidence_rejected"))
    sizes = filtered.groupBy("filter_category").agg(F.count("*").alias("n"))
    sizes = sizes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("filter_category", "n")))).alias("categories"))  # few categories
    out = one.crossJoin(F.broadcast(sizes))
    if reviews is not None:
        both = filtered.select(key, kept.alias("__kept")).join(reviews.where("wanted IS NOT NULL").select(key, "wanted"), key)
        out = out.crossJoin(F.broadcast(both.agg(F.count("*").alias("reviews"), F.avg((F.col("__kept") == F.col("wanted")).cast("double")).alias("accuracy"))))
    return out


def discover_terms(texts: DataFrame, min_df: int = 5, max_df: float = 0.8, top_n: int = 100, min_positive: int = 50, min_negative: int = 20, grams: tuple = (1, 2)) -> DataFrame:
    """Character n-grams inside words whose mean TF-IDF is higher in texts with positive = true: (term, diff).

    texts (id, text, positive). Smoothed idf, raw counts, unit vectors. Below the least numbers of texts no term is found.
    Texts are dealt out by id once and their terms are counted, weighted and scaled where they lie: a text's terms are many
    times its size, which the planner can't see, and no join moves them. What each task gets whole are the terms with their
    frequencies, written first, so that no broadcast waits for the reading of all texts.
    """
    size = texts.agg(F.count("*").alias("n"), F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn")).first()
    n, enough = size["n"], size["np"] >= min_positive and size["nn"] >= min_negative
    terms = F.explode(C.char_grams(F.coalesce("text", F.lit("")), *grams)).alias("term")
    tf = texts.select("id", "positive", "text").repartition("id").select("id", "positive", terms).groupBy("id", "positive", "term").agg(F.count("*").alias("tf"))
    place = scratch(texts.sparkSession, "terms")
    tf.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n) & F.lit(enough)).write.parquet(place)
    df = texts.sparkSession.read.parquet(place)
    weight = tf.join(F.broadcast(df), "term").withColumn("w", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    unit = weight.withColumn("u", F.col("w") / norm)
    mean = lambda side, of: F.coalesce(F.sum(F.when(side, F.col("u"))), F.lit(0.0)) / of
    diff = unit.groupBy("term").agg((mean(F.col("positive"), size["np"]) - mean(~F.col("positive"), size["nn"])).alias("diff"))
    return diff.where("diff > 0").orderBy(F.desc("diff"), "term").limit(top_n)


def run_filter(videos: DataFrame, config: FilterConfig, channels: DataFrame | None = None, priors: DataFrame | None = None, terms: tuple | None = None, top_n: int = 100) -> DataFrame:
    """filter_videos with the priors and the terms that the videos themselves show, unless they are given.

    Terms come from titles that hold exam marks alone against those that hold other marks alone; at most top_n of them, a
    row each, are brought to the driver.
    """
    priors = channel_priors(videos, config) if priors is None else priors
    if terms is None:
        text = searched_text(videos)
        exam, other = C.any_of(text, config.exam), C.any_of(text, config.other)
        titles = videos.where(exam != other).select(F.col("video_id").alias("id"), F.col("title").alias("text"), exam.alias("positive"))
        terms = tuple(r["term"] for r in discover_terms(titles, top_n=top_n).collect())
    return filter_videos(videos, config, channels, priors, terms)


def label_sample(filtered: DataFrame, config: FilterConfig, seed: str = "42") -> DataFrame:
    """As many videos of each category as config.samples says, or all where there are fewer, with empty label columns."""
    size = F.create_map(*[F.lit(x) for kv in config.samples.items() for x in kv])
    draw = F.md5(F.concat(F.lit(seed), F.col("video_id").cast("string")).cast("binary"))
    ranked = filtered.withColumn("__r", F.row_number().over(Window.partitionBy("filter_category").orderBy(draw, "video_id")))
    kept = ranked.where(F.col("__r") <= F.coalesce(F.try_element_at(size, F.col("filter_category")), F.lit(0)))
    return kept.drop("__r").withColumns({"human_label": F.lit(""), "notes": F.lit("")})


def valid_transcript(text: Column) -> Column:
    """Not blank and fewer than two markers of page code."""
    blank = F.coalesce(F.regexp_count(text, F.lit(r"\S")), F.lit(0)) == 0
    return F.when(blank, False).otherwise(C.distinct_markers(F.lower(text), list(L.PAGE_CODE)) < 2)


def clean_captions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Caption files as running text: (key, text). Headers, cue times, code, tags and consecutive repeats go.

    A file is one row, so its lines stay in one expression and nothing is shuffled.
    """
    line = lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))
    raw = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    drop = lambda x: (x == "") | x.startswith("WEBVTT") | x.startswith("NOTE") | F.contains(x, F.lit("-->")) | F.rlike(x, F.lit(r"^\d+:\d+")) | (C.distinct_markers(F.lower(x), list(L.PAGE_CODE)) > 0)
    lines = F.filter(F.transform(F.filter(raw, lambda x: ~drop(x)), line), lambda x: x != "")
    kept = F.filter(F.col("__l"), lambda x, i: (i == 0) | (x != F.get(F.col("__l"), i - 1)))
    return df.withColumn("__l", lines).select(key, F.array_join(kept, " ").alias("text"))


def transcript_features(df: DataFrame, text: str = "text", seconds: str = "duration_sec", subject: str | None = None, curricula: dict = L.CURRICULA) -> DataFrame:
    """df with the transcript's 30 features; all null where the transcript is not valid.

    Syllables are runs of vowels, so the readability scores are approximations. Densities of explanations, technical
    terms, domain, exam and teaching markers are by word; those of questions, examples and contrasts by sentence.
    """
    t, low = F.col(text), F.col("__low")
    base = df.withColumn("__ok", valid_transcript(t)).withColumn("__low", F.lower(t)).withColumn("__w", F.array_remove(F.split(t, r"\s+"), ""))
    w = F.col("__w")
    # Each word's syllables and each count are columns of their own, so that what uses them twice finds them once.
    syllables = lambda x: F.greatest(F.regexp_count(F.lower(x), F.lit("[aeiouéèêëàâùûôîïœæ]+")), F.lit(1))
    base = base.withColumn("__y", F.transform(w, syllables)).withColumns({
        "__words": F.size(w).cast("long"), "__sentences": C.sentences(t), "__unique": F.size(F.array_distinct(F.transform(F.filter(w, lambda x: F.length(x) > 2), F.lower))).cast("long"),
        "__syll": F.aggregate("__y", F.lit(0).cast("long"), lambda a, x: a + x), "__hard": F.size(F.filter("__y", lambda x: x >= 3)).cast("long"),
        "__chars": F.length(F.array_join(w, "")).cast("long"),
    })
    words, sentences = F.col("__words"), F.col("__sentences")
    per = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    ws, yw = per(words, sentences), per(F.col("__syll"), words)
    wpm = F.when(F.col(seconds) > 0, words / F.col(seconds) * 60)
    every = tuple(dict.fromkeys(m.lower() for c in curricula.values() for m in c))
    domain = C.distinct_markers(low, list(every))
    if subject:
        cases = F
        for name, markers in curricula.items():
            cases = cases.when(F.col(subject) == name, C.distinct_markers(low, [m.lower() for m in markers]))
        domain = cases.otherwise(domain)
    counts = {
        "question": C.occurrences(low, "?") + C.occurrences(low, "؟"), "example": C.total(low, L.EXAMPLES), "explanation": C.total(low, L.EXPLANATIONS), "contrast": C.total(low, L.CONTRASTS),
        "technical_term": C.total(low, L.TECHNICAL), "domain_keyword": domain, "bac_marker": C.distinct_markers(low, list(L.EXAM_MARKERS)), "pedagogical_marker": C.distinct_markers(low, list(L.TEACHING)),
    }
    base = base.withColumns({f"__n_{name}": F.when(F.col("__ok"), n) for name, n in counts.items()})
    out = {
        "transcript_word_count": words, "transcript_char_count": F.length(t).cast("long"), "transcript_sentence_count": sentences, "avg_words_per_sentence": ws,
        "unique_word_count": F.col("__unique"), "lexical_diversity": per(F.col("__unique"), words),
        "flesch_reading_ease": 206.835 - 1.015 * ws - 84.6 * yw, "flesch_kincaid_grade": 0.39 * ws + 11.8 * yw - 15.59,
        "gunning_fog_index": 0.4 * (ws + 100 * per(F.col("__hard"), words)), "automated_readability_index": 4.71 * per(F.col("__chars"), words) + 0.5 * ws - 21.43,
        "speech_rate_wpm": wpm, "speech_rate_optimal": wpm.between(120, 180).cast("int"), "speech_rate_above_optimal": (wpm > 180).cast("int"), "speech_rate_below_optimal": (wpm < 100).cast("int"),
    }
    for name in counts:
        n = F.col(f"__n_{name}")
        out[f"{name}_count"] = n
        out[f"{name}_density"] = per(n, sentences if name in ("question", "example", "contrast") else words)
    out |= {"subject_keyword_count": F.col("__n_domain_keyword"), "subject_keyword_density": per(F.col("__n_domain_keyword"), words)}
    return base.withColumns({k: F.when(F.col("__ok"), v) for k, v in out.items()}).select(*df.columns, *out)


def temporal_features(df: DataFrame, at: str, reference: str) -> DataFrame:
    """df with the 19 features of the publishing time; reference is a literal time, so runs repeat."""
    t, hour = F.col(at), F.hour(at)
    days = F.greatest(F.lit(0).cast("long"), F.expr(f"timestampdiff(DAY, `{at}`, CAST('{reference}' AS {dict(df.dtypes)[at]}))"))
    week = (~F.dayofweek(t).isin(6, 7)).cast("int")
    turn = lambda f, x, n: f(2 * F.pi() * x / n)
    return df.withColumns({
        "days_since_publish": days, "publish_hour": hour, "publish_day_of_week": F.date_format(t, "EEEE"), "publish_month": F.month(t), "publish_year": F.year(t), "publish_day_of_month": F.dayofmonth(t),
        "is_evening_upload": hour.between(17, 21).cast("int"), "is_weekday": week,
        **{f"publish_{n}_{k}": turn(f, x, m) for n, x, m in (("hour", hour, 24), ("month", F.month(t), 12), ("day_of_month", F.dayofmonth(t), 31)) for k, f in (("sin", F.sin), ("cos", F.cos))},
        "days_since_publish_squared": days * days, "log_days_since_publish": F.log1p(days), "days_since_publish_x_hour": days * hour, "is_weekday_x_hour": week * hour, "days_since_publish_x_is_weekday": days * week,
    })


def title_features(df: DataFrame) -> DataFrame:
    """df with the nine features of title, description and tags; nulls count as empty."""
    title, about, tags = (F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in ("title", "description", "tags"))
    words = C.word_count(title)
    exam = C.distinct_markers(F.lower(F.concat_ws(" ", title, about)), list(L.EXAM_MARKERS))
    end = F.regexp_replace(title, r"\s+$", "")
    return df.withColumns({
        "title_length": F.length(title).cast("long"), "description_length": F.length(about).cast("long"), "title_word_count": words,
        "tag_count": F.when(tags == "", 0).otherwise(F.size(F.split(tags, ",", -1))).cast("long"), "is_exam_focused": C.any_of(F.lower(title), L.EXAM_FOCUS).cast("int"),
        "is_title_question": (end.endswith("?") | end.endswith("؟")).cast("int"), "exam_keyword_intensity": F.coalesce(F.try_divide(exam.cast("double"), (words + C.word_count(about)).cast("double")), F.lit(0.0)),
        "title_bac_markers": C.distinct_markers(F.lower(title), list(L.EXAM_MARKERS)), "desc_pedagogical_markers": C.distinct_markers(F.lower(about), list(L.TEACHING)),
    })


def quick_tips(title: Column, minutes: Column, about: Column, focused: Column) -> Column:
    """Codes of the tips that a planned video gets, comma-joined; the page renders them in its own language."""
    n = F.length(title)
    return F.array_join(F.array_compact(F.array(
        F.when(n < 30, "title_short").when(n > 80, "title_long").otherwise("title_ok"),
        F.when(C.any_of(F.lower(title), L.TIP_KEYWORDS), "keywords_ok").otherwise("keywords_add"),
        F.when(F.coalesce(minutes, F.lit(0)) == 0, F.lit(None)).when(minutes < 5, "duration_short").when(minutes > 60, "duration_long").otherwise("duration_ok"),
        F.when(F.coalesce(about, F.lit("")) == "", "description_add").when(F.length(about) < 100, "description_short"),
        F.when(focused, "exam_focus"),
    )), ",")


def merge_snapshots(existing: DataFrame, new: DataFrame, mode: str, key: str, order: str, tie: str) -> DataFrame:
    """append keeps all rows; dedupe the newest of each key, ties by the higher tie column."""
    both = existing.unionByName(new, allowMissingColumns=True)
    if mode == "append":
        return both
    if mode != "dedupe":
        raise ValueError(f"unknown mode {mode!r}")
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc(tie))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def registry_upsert(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, first_seen, last_seen): known keys are touched, others inserted once. seen is (key, at)."""
    latest = seen.groupBy("key").agg(F.min("at").alias("__first"), F.max("at").alias("__last"))
    out = registry.join(latest, "key", "full_outer")
    return out.select("key", F.coalesce("first_seen", "__first").alias("first_seen"), F.greatest("last_seen", "__last").alias("last_seen"), F.col("first_seen").isNull().alias("is_new"))


def canonical_subject(name: Column) -> Column:
    """The subject's one spelling; an unknown name raises when the row is evaluated."""
    key = F.lower(F.trim(name))
    known = {s.lower(): s for s in L.SUBJECTS} | L.ALIASES
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.raise_error(F.concat(F.lit("unknown subject "), name)).cast("string"))
