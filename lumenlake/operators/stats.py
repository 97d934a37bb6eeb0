"""Aggregates of a catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.paths import base_name, parent_dir, upwards
from lumenlake.functions.tags import UNTAGGED


def tag_stats(df: DataFrame, hidden: DataFrame, include_hidden: bool = False, include_auto: bool = False) -> DataFrame:
    """(name, count, kind, hidden): the virtual row ``untagged`` and a row for each tag. hidden(name)."""
    system = df.agg(F.count_if(F.size("tags") == 0).alias("count")).select(F.lit(UNTAGGED).alias("name"), "count", F.lit("system").alias("kind"), F.lit(False).alias("hidden"))
    user = df.select(F.explode("tags").alias("name")).groupBy("name").count()
    flags = hidden.select("name").distinct().withColumn("hidden", F.lit(True))
    user = user.join(flags, "name", "full" if include_hidden else "left")
    user = user.select("name", F.coalesce("count", F.lit(0)).alias("count"), F.lit("user").alias("kind"), F.coalesce("hidden", F.lit(False)).alias("hidden"))
    if not include_hidden:
        user = user.where(~F.col("hidden"))
    out = system.unionByName(user)
    if include_auto:
        auto = df.select(F.explode("auto_tags").alias("name")).groupBy("name").count()
        out = out.unionByName(auto.select("name", "count", F.lit("auto").alias("kind"), F.lit(False).alias("hidden")))
    return out


def folder_tree(df: DataFrame, include_audio: bool = False) -> DataFrame:
    """(path, parent, name, count, total): direct files and all below, for each directory above a file."""
    if not include_audio:
        df = df.where("media_kind <> 'audio'")
    folders = df.groupBy(parent_dir(F.col("path")).alias("own")).agg(F.count(F.lit(1)).alias("n"))  # only folders go up the tree
    each = folders.select("own", "n", F.explode(upwards(F.col("own"))).alias("path"))
    nodes = each.groupBy("path").agg(F.sum(F.when(F.col("own") == F.col("path"), F.col("n")).otherwise(0)).alias("count"), F.sum("n").alias("total"))
    return nodes.select("path", parent_dir(F.col("path")).alias("parent"), base_name(F.col("path")).alias("name"), "count", "total")


def untagged_by_folder(df: DataFrame) -> DataFrame:
    """(folder, count, path, name): untagged rows with their folder's count. Rows stay rows, since a folder may
    hold a third of them."""
    own = df.where(F.size("tags") == 0).select(parent_dir(F.col("path")).alias("folder"), "path", "name")
    return own.join(own.groupBy("folder").agg(F.count(F.lit(1)).alias("count")), "folder")


def tagging_progress(df: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: total, tagged, untagged, and the most untagged members of a duplicate cluster."""
    one = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("tags") > 0).alias("tagged"))
    most = duplicates.agg(F.coalesce(F.max("untagged"), F.lit(0)).alias("largest_untagged"))
    return one.withColumn("untagged", F.col("total") - F.col("tagged")).join(F.broadcast(most))  # one row each


def reclaim_summary(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """One row: clusters, members, members beyond the first of each, and the bytes of those."""
    n = clusters.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("extras"))
    size = members.where("NOT keep").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("reclaim_bytes"))
    return n.join(F.broadcast(size))  # one row each


def selection_summary(df: DataFrame) -> DataFrame:
    """(tag, n, bytes): the tags common to all rows, one row each, or a row with a null tag if there is none."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    tags = df.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("m"))
    return total.join(tags, F.col("m") == F.col("n"), "left").select("tag", "n", "bytes")


def tag_exists(df: DataFrame, hidden: DataFrame, names: DataFrame) -> DataFrame:
    """names(name) with ``exists``: a user tag, or a hidden name that no row carries."""
    known = df.select(F.explode("tags").alias("name")).union(hidden.select("name")).distinct().withColumn("exists", F.lit(True))
    return names.join(known, "name", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def media_count(df: DataFrame) -> DataFrame:
    return df.groupBy("media_kind").agg(F.count(F.lit(1)).alias("count"))


def batch_outcome(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def folder_selection_state(untagged: DataFrame, selected: DataFrame) -> DataFrame:
    """(folder, state): whether none, some or all of a folder's untagged rows are among selected(path)."""
    own = untagged.join(selected.select("path").distinct().withColumn("_on", F.lit(1)), "path", "left")
    n = own.groupBy("folder").agg(F.count("_on").alias("on"), F.count(F.lit(1)).alias("n"))
    return n.select("folder", F.when(F.col("on") == 0, "none").when(F.col("on") == F.col("n"), "all").otherwise("some").alias("state"))
