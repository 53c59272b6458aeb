"""A paginated remote listing as a Spark source, enrichment in batches, and what both cost.

The client is the caller's: a function, named "module:function", that takes (list id, page token) and gives a page as
(records, next token or None). Each list is a partition, so lists are read side by side and a lost executor rereads its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module
from importlib.util import module_from_spec, spec_from_file_location

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..operators.relational import bins_for, cuts_of

#: Units that a request of each kind costs.
UNITS = {"lookup": 1, "list": 1, "search": 100, "details": 1}


def named(function: str) -> Callable:
    """"module:function", or "/path/file.py:function" of a file that is in the same place on every machine."""
    module, _, name = function.rpartition(":")
    if not module.endswith(".py"):
        return getattr(import_module(module), name)
    spec = spec_from_file_location("client", module)
    loaded = module_from_spec(spec)
    spec.loader.exec_module(loaded)
    return getattr(loaded, name)


class PagedSource(DataSource):
    """Options: client, lists (comma-separated ids), most (records of a list at most; all where it is absent), and for streams
    follow, a function "module:function" of (list id, page token) that gives the next page's token alone; without it, the
    client is asked and its records are not used."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "list_id string, page int, record string"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushdown") == "true" else PagedReader)(options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return PagedStream(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.client, self.lists = options["client"], [x for x in options.get("lists", "").split(",") if x]
        self.most = int(options["most"]) if "most" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.lists] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        fetch, token, page, given = named(self.client), None, 0, 0
        while True:
            records, token = fetch(partition.value, token)
            for record in records:
                if self.most is not None and given >= self.most:
                    return
                given += 1
                yield partition.value, page, record
            page += 1
            if token is None or (self.most is not None and given >= self.most):
                return


class FilteringReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Lists that a filter rules out are not asked for."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("list_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.lists = [x for x in self.lists if x in wanted]
            else:
                yield f


class PagedStream(DataSourceStreamReader):
    """A listing that only grows at its end, as a stream. An offset says of each list how many pages are read and the token of
    the page after them; each page between two offsets is a partition, so a page is read once, by an executor, and a
    restart goes on from the offset. The driver only follows the tokens."""

    def __init__(self, options: dict):
        self.client, self.lists, self.follow = options["client"], [x for x in options.get("lists", "").split(",") if x], options.get("follow")
        self.at = self.initialOffset()

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's names
        return {x: [0, None] for x in self.lists}

    def _next(self, list_id: str, token):
        return named(self.follow)(list_id, token) if self.follow else named(self.client)(list_id, token)[1]

    def latestOffset(self) -> dict:  # noqa: N802
        """All pages but an open last one: a page without a successor may still get records."""
        for x, (pages, token) in self.at.items():
            while (after := self._next(x, token)) is not None:
                pages, token = pages + 1, after
            self.at[x] = [pages, token]
        return {x: list(v) for x, v in self.at.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for x, (last, _) in end.items():
            first, token = start.get(x, [0, None])
            for page in range(first, last):
                out.append(InputPartition((x, page, token)))
                token = self._next(x, token)
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        list_id, page, token = partition.value
        for record in named(self.client)(list_id, token)[0]:
            yield list_id, page, record

    def commit(self, end: dict) -> None:
        pass


def paged_stream(spark: SparkSession, client: str, lists: list[str], follow: str | None = None) -> DataFrame:
    """(list_id, page, record) of pages as they are filled, as a stream."""
    spark.dataSource.register(PagedSource)
    reader = spark.readStream.format("paged").option("client", client).option("lists", ",".join(lists))
    return (reader.option("follow", follow) if follow else reader).load()


def paged(spark: SparkSession, client: str, lists: list[str], most: int | None = None) -> DataFrame:
    """(list_id, page, record): the records are JSON strings. Where spark.sql.python.filterPushdown.enabled is true, lists that a filter
    rules out are not asked for; Spark has readers with filters only then."""
    spark.dataSource.register(PagedSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    reader = spark.read.format("paged").option("client", client).option("lists", ",".join(lists)).option("pushdown", pushed)
    return (reader if most is None else reader.option("most", str(most))).load()


def paged_or_searched(spark: SparkSession, client: str, search: str, lists: list[str], most: int | None = None) -> DataFrame:
    """(list_id, page, record, mode): lists whose client gives no record are searched for instead, which costs 100 units a
    page. The first answers are kept while the second ones come, so nothing is asked twice unless an executor is lost."""
    found = paged(spark, client, lists, most).withColumn("mode", F.lit("list")).persist()
    answered = {r["list_id"] for r in found.select("list_id").distinct().collect()}  # of the caller's own lists
    rest = [x for x in lists if x not in answered]
    return found.unionByName(paged(spark, search, rest, most).withColumn("mode", F.lit("search"))) if rest else found


def flat_videos(records: DataFrame, record: str = "record") -> DataFrame:
    """Nested items as flat rows; absent text is empty and absent or unreadable numbers are 0."""
    item = "id string, snippet struct<title:string,description:string,publishedAt:string,channelId:string,channelTitle:string,tags:array<string>>, contentDetails struct<duration:string>, statistics struct<viewCount:string,likeCount:string,commentCount:string>"
    of = records.select(F.from_json(record, item).alias("r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    number = lambda c: F.coalesce(F.col(f"r.statistics.{c}").try_cast("long"), F.lit(0).cast("long"))
    return of.select(
        F.col("r.id").alias("video_id"), text("snippet.title").alias("title"), text("snippet.description").alias("description"), F.col("r.snippet.publishedAt").alias("publish_date"),
        F.col("r.snippet.channelId").alias("channel_id"), text("snippet.channelTitle").alias("channel_title"), F.coalesce("r.contentDetails.duration", F.lit("PT0S")).alias("duration"),
        number("viewCount").alias("view_count"), number("likeCount").alias("like_count"), number("commentCount").alias("comment_count"), F.array_join(F.coalesce("r.snippet.tags", F.array()), ",").alias("tags"),
    )


def top_comments(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """(key, text, likes) for each comment of a nested answer."""
    item = "items array<struct<snippet:struct<topLevelComment:struct<snippet:struct<textDisplay:string,likeCount:long>>>>>"
    each = records.select(key, F.explode(F.from_json(record, item)["items"]).alias("c"))
    comment = F.col("c.snippet.topLevelComment.snippet")
    return each.select(key, comment["textDisplay"].alias("text"), F.coalesce(comment["likeCount"], F.lit(0).cast("long")).alias("likes"))


def caption_choice(tracks: DataFrame, key: str, languages: tuple = ("ar", "fr", "en"), formats: tuple = ("vtt", "json3")) -> DataFrame:
    """One track of each video: manual before automatic, then by language, then by format; others come last by name."""
    place = lambda c, options: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, options)), c), F.lit(0)), F.lit(len(options) + 1))
    listed = F.col("language").isin(*languages)
    order = [F.when(listed, 0).otherwise(1), F.col("automatic").cast("int"), place(F.col("language"), languages), place(F.col("format"), formats), F.col("language"), F.col("format"), F.col("url")]
    return tracks.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def enriched(ids: DataFrame, key: str, client: str, schema: str, size: int = 50, batches: int = 64) -> DataFrame:
    """Rows of the client for the ids, asked `size` at a time. A batch that fails gives one row with the error and the
    ids that it held, all else null; schema is of the client's rows, which are mappings."""

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, names, held = named(client), [f.split()[0] for f in schema.split(", ")], []

        def answered(some: list) -> pd.DataFrame:
            try:
                rows = [{**r, "failed_ids": None, "error": None} for r in fetch(some)]
            except (OSError, RuntimeError, ValueError) as e:  # what clients raise; a mistake in a program is no answer
                rows = [{"failed_ids": ",".join(map(str, some)), "error": f"{type(e).__name__}: {e}"}]
            return pd.DataFrame(rows, columns=[*names, "failed_ids", "error"])

        for frame in frames:
            held += frame[key].tolist()
            while len(held) >= size:
                some, held = held[:size], held[size:]
                yield answered(some)
        if held:
            yield answered(held)

    return ids.select(key).distinct().repartition(batches, key).mapInPandas(asked, f"{schema}, failed_ids string, error string")


def units(requests: DataFrame, kind: str = "kind") -> DataFrame:
    """Requests and units by kind; an unknown kind costs nothing."""
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return requests.groupBy(kind).agg(F.count("*").alias("requests")).withColumn("units", F.col("requests") * F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(0)))


def within_budget(requests: DataFrame, budget: int, order: str, kind: str = "kind", group: str | None = None, bins: int | None = None) -> DataFrame:
    """The requests, in order within each group (a key or a day), up to the one that would go beyond the budget.

    Without a group, sums run inside bins of the order, and only the bins' totals meet in one task.
    """
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    costs = requests.withColumn("__u", F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(0)))
    if group:
        parts, before = Window.partitionBy(group), F.lit(0)
    else:
        cuts = costs.agg(cuts_of(F.col(order).cast("double"), bins_for(requests, bins)).alias("__cuts"))
        costs = costs.crossJoin(F.broadcast(cuts)).withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col(order).cast("double")))).drop("__cuts")
        sums = costs.groupBy("__bin").agg(F.sum("__u").alias("__s"))
        earlier = F.sum("__s").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
        costs = costs.join(F.broadcast(sums.select("__bin", F.coalesce(earlier, F.lit(0)).alias("__before"))), "__bin")
        parts, before = Window.partitionBy("__bin"), F.col("__before")
    w = parts.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("spent", before + F.sum("__u").over(w)).where(F.col("spent") <= budget).select(*requests.columns, "spent")


def failure_kind(error: Column) -> Column:
    """permanent, or retry."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.when(e.contains("no transcript") | e.contains("html") | e.contains("js code"), "permanent").otherwise("retry")
