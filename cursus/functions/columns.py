"""Column functions: text, dates, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), "")).cast("long")


def occurrences(text: Column, marker: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def distinct_markers(text: Column, markers: list[str]) -> Column:
    """How many of the markers occur."""
    return sum((F.contains(text, F.lit(m)).cast("long") for m in markers), F.lit(0).cast("long"))


def sentences(text: Column) -> Column:
    parts = F.filter(F.split(text, "[.!?؟。]+"), lambda x: F.trim(x) != "")
    return F.greatest(F.size(parts), F.lit(1)).cast("long")


def duration_seconds(iso: Column) -> Column:
    """PT#H#M#S in seconds; what doesn't match is 0."""
    part = lambda unit: F.coalesce(F.regexp_extract(iso, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0))
    return F.when(iso.rlike(r"^PT(\d+H)?(\d+M)?(\d+S)?$"), part("H") * 3600 + part("M") * 60 + part("S")).otherwise(F.lit(0)).cast("long")


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)


def engagement_score(views: Column, likes: Column, comments: Column) -> Column:
    return F.log1p((3 * comments + likes) / F.sqrt(F.greatest(views, F.lit(1))))


def level(score: Column, low: Column, high: Column) -> Column:
    return F.when(score >= high, "High").when(score >= low, "Medium").otherwise("Low")


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def any_of(text: Column, markers) -> Column:
    """Whether a marker occurs, whatever its case; text is in lower case. No markers: false. Null text: false."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(text, F.lit(m.lower()))
    return F.coalesce(hit, F.lit(False))


def total(text: Column, markers) -> Column:
    """Occurrences of all markers, each counted for itself."""
    return sum((occurrences(text, m) for m in markers), F.lit(0).cast("long"))


def truncated(text: Column, n: int) -> Column:
    return F.substr(text, F.lit(1), F.lit(n))


def years(days: Column) -> Column:
    return days / 365.25


def available(text: Column) -> Column:
    """1 where there is a text that isn't blank."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"\S")), F.lit(0)) > 0).cast("int")


def utc_timestamp(text: Column) -> Column:
    """ISO 8601 text as a timestamp; what is none becomes null."""
    return F.try_to_timestamp(text)


def first_present(struct: Column, names) -> Column:
    """The first of the nested fields that isn't null, in the given order."""
    return F.coalesce(*[struct[n] for n in names])


def severity(pct: Column) -> Column:
    return F.when(pct > 50, "high").when(pct > 20, "medium").when(pct > 0, "low").otherwise("none")


def reason(text: Column, ladder: dict[str, str], other: str = "other") -> Column:
    """The class of the first marker that the text holds, whatever its case."""
    out = F
    for marker, name in ladder.items():
        out = out.when(F.contains(F.lower(text), F.lit(marker.lower())), name)
    return out.otherwise(other)


def entropy(shares: Column) -> Column:
    """Of an array of shares, in bits; a millionth keeps the logarithm of 0 away."""
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p + 1e-6))


def nearest(values: list[Column], labels: dict[str, tuple]) -> Column:
    """The label whose point is nearest; of equal distances the first in order of names."""
    square = lambda point: sum(((v - float(x)) * (v - float(x)) for v, x in zip(values, point, strict=True)), F.lit(0.0))
    return F.array_min(F.array(*[F.struct(square(p).alias("d"), F.lit(n).alias("n")) for n, p in sorted(labels.items())]))["n"]


def mean_pooled(vectors: Column) -> Column:
    """The mean of equally long vectors, place by place; null for none."""
    n = F.size(vectors)
    total = lambda i: F.aggregate(vectors, F.lit(0.0), lambda a, v: a + F.get(v, i).cast("double"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.size(F.get(vectors, F.lit(0))) - 1), lambda i: total(i) / n))


def char_grams(text: Column, least: int = 1, most: int = 2) -> Column:
    """Character n-grams inside words, each word between two spaces."""
    padded = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    of = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
    words = F.transform(F.array_remove(F.split(F.lower(text), r"\s+"), ""), padded)
    return F.flatten(F.transform(words, lambda w: F.concat(*[of(w, n) for n in range(least, most + 1)])))


def arabic_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[\u0600-\u06FF]+"), 0)


#: Pattern tests of descriptions. The sites that count as social, and the emoji ranges.
SOCIAL = ("facebook", "instagram", "telegram", "tiktok", "twitter", "whatsapp")
EMOJI = "[\U0001F300-\U0001FAFF\u2600-\u27BF]"


def description_forms(text: Column) -> dict[str, Column]:
    return {
        "link": F.contains(F.lower(text), F.lit("http")), "timestamp": text.rlike("[0-9]{1,2}:[0-9]{2}"), "hashtag": text.rlike(r"#[\p{L}\p{N}_]"),
        "emoji": text.rlike(EMOJI), "social": F.lower(text).rlike("|".join(SOCIAL)),
    }
