"""Quality rules as a short-circuit cascade. DataFrame functions only.

Each rule's cost, net of what starting a job takes, and its rejection rate are measured on a hashed sample; the rules
then run in the order of rejection per cost, and a document that one rule rejects is not looked at by later ones. Costs
that the measurement cannot tell apart, by its own spread from turn to turn, count as one. The order changes the time and
`rejected_by`, never the verdict.

Defined results: a null text has no words and is rejected; an empty table gives an empty result; repeated
rows are judged each by itself; a very long text is judged whole; rules of equal rejection per cost are tried by name;
further columns, whatever their names, pass through unread.
"""

from __future__ import annotations

import math
import time
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

WINDOW = 5
#: Turns of a measurement that count: a loaded machine only ever slows one down.
QUICKEST = 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\r\x0b\x0c")) != "")


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_words(w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    return _bind(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words inside windows of five words that occur twice or more; hashes only rule out texts without any."""
    positions = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = F.transform(positions, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(hits: Column) -> Column:
        step = F.transform(hits, lambda p, k: F.least(F.coalesce(F.get(hits, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def twice(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(rows, k)["w"] == x["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    exact = _bind(_bind(F.sort_array(F.transform(positions, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i")))), twice), covered)
    found = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact).otherwise(F.lit(0)))
    return F.when(F.size(w) > WINDOW, found).otherwise(F.lit(0)).cast("long")


def n_stutters(w: Column) -> Column:
    """Words equal to the word after them."""
    return F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i + 1), F.lit(False))))


def alpha_words(w: Column) -> Column:
    return F.size(F.filter(w, lambda x: F.rlike(x, F.lit(r"\p{L}"))))


#: name -> whether the document fails it. The first two are the base; the others are wide enough for clean prose.
RULES = {
    "too_few_words": lambda text, w: F.size(w) < 10,
    "repeated_windows": lambda text, w: 100 * n_repeat_words(w) > 20 * n_words(w),
    "symbols": lambda text, w: 10 * n_symbols(text) > 3 * n_words(w),
    "word_length": lambda text, w: ~word_chars(w).between(2 * n_words(w), 20 * n_words(w)),
    "repeated_lines": lambda text, w: 2 * n_dup_lines(text) > F.size(_lines(text)),
    "stutter": lambda text, w: 10 * n_stutters(w) > 4 * F.size(w),
    "few_letters": lambda text, w: 10 * alpha_words(w) < 6 * F.size(w),
}

BASE = ("too_few_words", "repeated_windows")


def rejected_by(text: Column, order: list[str]) -> Column:
    """The first rule that the text fails, null if none: the branches of one CASE, each tried only after the ones
    before it. The words are bound inside, so the expression can move into a filter without being repeated."""

    def cascade(w: Column) -> Column:
        out = F
        for name in order:
            out = out.when(RULES[name](text, w), F.lit(name))
        return out

    return _bind(words(text), cascade)


def sampled(docs: DataFrame, sample_rows: int, sample_bytes: int = 65_536) -> DataFrame:
    """The rows (t, w) of at most sample_rows texts of up to sample_bytes, those that come first by a hash of doc_id."""
    total = docs.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // (8 * sample_rows)))) == 0
    short = docs.select("doc_id", "text").where(drawn & (F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes))
    rows = short.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample_rows).select("text").collect()
    made = docs.sparkSession.createDataFrame(rows, short.select("text").schema).coalesce(1)
    return made.select(_text().alias("t"), words(_text()).alias("w"))


def measured(docs: DataFrame, sample_rows: int = 256, turns: int = 5, repeat: int = 8) -> dict[str, tuple[list[float], float]]:
    """Seconds, turn by turn, and share of rejected documents by rule. They settle the order only.

    In each turn every rule runs `repeat` times over the sample in a job of its own; the quickest job without a rule is
    what starting a job costs. A first turn, in which code is compiled, doesn't count.
    """
    sample = sampled(docs, sample_rows).persist()
    try:
        rows = sample.count()
        many = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

        def run(failed: Column) -> tuple[float, int]:
            began = time.perf_counter()
            n = many.select(F.sum(F.when(failed, 1).otherwise(0))).first()[0] or 0
            return time.perf_counter() - began, n

        tests = {"": F.size("w") < 0} | {name: fails(F.col("t"), F.col("w")) for name, fails in RULES.items()}
        took = [{name: run(test) for name, test in tests.items()} for _ in range(turns + 1)][1:] if rows else []
        idle = sorted(turn[""][0] for turn in took)[:QUICKEST] or [0.0]
        noise = max(idle[-1] - idle[0], 1e-6)  # a rule that costs less counts as this dear
        return {name: ([max(turn[name][0] - idle[0], noise) / repeat for turn in took], took[0][name][1] / (rows * repeat) if took else 0.0) for name in RULES}
    finally:
        sample.unpersist()


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def cost_classes(figures: dict[str, tuple[list[float], float]]) -> dict[str, float]:
    """A cost for each rule, of its quickest turn, and one for all rules that the measurement can't tell apart.

    The rules' usual spread among their quickest turns is how far one figure may be off; costs are told apart where they
    differ by more than two such figures can.
    """
    quick = {r: sorted(turns)[:QUICKEST] for r, (turns, _) in figures.items()}
    apart = median(q[-1] / q[0] for q in quick.values()) ** 2
    classes: list[list[str]] = []
    for r in sorted(quick, key=lambda r: (quick[r][0], r)):
        if classes and quick[r][0] <= apart * quick[classes[-1][-1]][0]:
            classes[-1].append(r)
        else:
            classes.append([r])
    return {r: math.exp(sum(math.log(quick[x][0]) for x in its) / len(its)) for its in classes for r in its}


def cascade_order(figures: dict[str, tuple[list[float], float]]) -> list[str]:
    """The most rejection per cost first; rules that reject none by cost, and by name where that is equal."""
    if not all(turns for turns, _ in figures.values()):  # an empty table has nothing to measure on
        return sorted(figures)
    cost = cost_classes(figures)
    return sorted(figures, key=lambda r: (-figures[r][1] / cost[r], cost[r], r))


def quality_filter(docs: DataFrame, sample_rows: int = 256) -> DataFrame:
    """The documents that no rule rejects, with the columns of docs."""
    return docs.where(rejected_by(_text(), cascade_order(measured(docs, sample_rows))).isNull())


def quality_report(docs: DataFrame, sample_rows: int = 256) -> DataFrame:
    """The counts behind the rules, base_failed and kept for each row."""
    order = cascade_order(measured(docs, sample_rows))
    text, w = F.col("t"), F.col("w")
    counts = docs.select("doc_id", _text().alias("t")).select("doc_id", "t", words(text).alias("w")).select(
        "doc_id", n_words(w).alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"), "t", "w",
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rest = F
    for name in order:
        if name not in BASE:
            rest = rest.when(RULES[name](text, w), False)
    kept = F.when(F.col("base_failed"), False).otherwise(rest.otherwise(True))
    return counts.withColumn("base_failed", failed).withColumn("kept", kept).drop("t", "w")


#: DuckDB SQL for the rows of quality_report.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CAST(len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS BIGINT) AS alpha,
         CAST(len(list_filter(w, lambda x, i: x = w[i + 1])) AS BIGINT) AS stutters
  FROM t
), g AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM t
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i : i + 4]) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM c WHERE n > 1) GROUP BY doc_id
), k AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, alpha, stutters
  FROM m LEFT JOIN r ON r.doc_id = m.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * stutters > 4 * n_words OR 10 * alpha < 6 * n_words) AS kept
FROM b
"""
