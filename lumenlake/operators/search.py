"""Filters, lookups and sorted listings of a catalog table (``media``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.paths import is_under
from lumenlake.functions.tags import HIDDEN, UNTAGGED, fuzzy_score, tokenize_query
from lumenlake.operators.tables import materialise

SORT_KEYS = {"name": "name", "date": "taken_at", "size": "size_bytes"}


def filter_folder(df: DataFrame, folder: str) -> DataFrame:
    return df.where(is_under(F.col("path"), folder))


def exclude_hidden(df: DataFrame) -> DataFrame:
    return df.where(~F.array_contains("tags", HIDDEN))


def filter_untagged(df: DataFrame) -> DataFrame:
    return df.where(F.size("tags") == 0)


def token_hit(token: str) -> Column:
    return F.array_contains("tags", token) | F.array_contains("auto_tags", token) | F.lower("name").contains(token)


def match_tokens(df: DataFrame, tokens: list[str], mode: str = "all") -> DataFrame:
    if not tokens:
        return df
    return df.where(reduce(Column.__and__ if mode == "all" else Column.__or__, map(token_hit, tokens)))


def sort_order(key: str = "name", desc: bool = False) -> list[Column]:
    """Rows without a value come last ascending and first descending; ties by path in the same direction."""
    c = F.col(SORT_KEYS[key])
    return [c.desc_nulls_first(), F.desc("path")] if desc else [c.asc_nulls_last(), F.asc("path")]


def sort_media(df: DataFrame, key: str = "name", desc: bool = False) -> DataFrame:
    """Sorted by range over all partitions."""
    return df.orderBy(*sort_order(key, desc))


def with_position(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """The place of each row in a total order, from 0, without a window over all rows in one task: rows are
    range-partitioned and written with their number within the partition, and the partitions' sizes are added up. The
    range-partitioned rows are a table because a second plan of them might be cut at other boundaries."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    ranged = materialise(ranged, "ranged").select("row", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("number"))
    sizes = ranged.groupBy("part").count()
    # one row for each partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    placed = ranged.join(starts, "part").select("row", (F.col("start") + F.col("number")).alias("place"))
    return placed.select("row.*", F.col("place").alias(out)) if out not in df.columns else placed.select(F.col("row").withField(out, F.col("place")).alias("row")).select("row.*")


def search_media(df: DataFrame, q: str = "", folder: str | None = None, sort: str = "name", desc: bool = False, match: str = "all") -> DataFrame:
    """Filters first, so that they reach the scan, then the sort. ``untagged`` in q is a filter of its own in
    either mode; rows tagged hidden show only if q has that word."""
    tokens = tokenize_query(q)
    if folder:
        df = filter_folder(df, folder)
    if HIDDEN not in tokens:
        df = exclude_hidden(df)
    if UNTAGGED in tokens:
        df = filter_untagged(df)
    return sort_media(match_tokens(df, [t for t in tokens if t != UNTAGGED], match), sort, desc)


def get_media(df: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(path) with the catalog's row and ``found``."""
    return keys.join(df.withColumn("found", F.lit(True)), "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def audio_as_media(audio: DataFrame, photos: DataFrame) -> DataFrame:
    """audio in the columns of photos; what a sound has not is null."""
    return photos.limit(0).unionByName(audio.select(*[x for x in audio.columns if x in photos.columns]), allowMissingColumns=True)


def all_media(photos: DataFrame, audio: DataFrame) -> DataFrame:
    return photos.unionByName(audio_as_media(audio, photos))


def filter_tag_names(stats: DataFrame, text: str) -> DataFrame:
    return stats.where(F.col("name").contains(text.strip().lower()))


def suggest_tags(stats: DataFrame, q: str, chosen: list[str] = (), k: int = 8) -> DataFrame:
    """The k tags that q hits best; ties by name. A top-k report."""
    scored = stats.where((F.col("kind") != "system") & ~F.col("name").isin(list(chosen) or [""])).groupBy("name").agg(F.max("count").alias("count"))
    return scored.withColumn("score", fuzzy_score(q, F.col("name"))).where("score IS NOT NULL").orderBy(F.desc("score"), "name").limit(k)


def select_range(positioned: DataFrame, anchor: str, target: str) -> DataFrame:
    """Rows between two paths in the order of pos, either way round; the target alone if the anchor is missing."""
    ends = positioned.where(F.col("path").isin(anchor, target)).agg(
        F.min(F.when(F.col("path") == target, F.col("pos"))).alias("t"), F.min(F.when(F.col("path") == anchor, F.col("pos"))).alias("a")
    )
    ends = ends.select(F.least("t", F.coalesce("a", "t")).alias("_low"), F.greatest("t", F.coalesce("a", "t")).alias("_high"))
    return positioned.join(F.broadcast(ends)).where(F.col("pos").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")  # one row
