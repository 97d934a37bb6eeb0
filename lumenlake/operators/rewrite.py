"""Bulk rewrites: a table in, a new table and what changed out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.paths import base_name, is_under
from lumenlake.functions.tags import HIDDEN, UNTAGGED, normal_tag, normalize_tags
from lumenlake.operators.tables import materialise, spent

#: Fixed value: operations that can be undone.
DEPTH = 32


def counted(df: DataFrame, **counts: Column) -> DataFrame:
    return df.agg(*[F.count_if(v).alias(k) for k, v in counts.items()])


def set_tags(df: DataFrame, new: DataFrame) -> DataFrame:
    """df with the tags of new(path, tags), normalised, where it has the path."""
    given = new.select("path", normalize_tags(F.col("tags")).alias("_new"))
    return df.join(given, "path", "left").withColumn("tags", F.coalesce("_new", "tags")).drop("_new")


def _gain(df: DataFrame, on: Column, tags: list[str]) -> DataFrame:
    add = normalize_tags(F.array(*[F.lit(t) for t in tags]).cast("array<string>"))
    out = df.withColumn("_tags", F.when(on, F.array_union("tags", add)).otherwise(F.col("tags")))
    out = out.withColumn("_changed", F.size("_tags") > F.size("tags"))
    return out.withColumn("tags", F.col("_tags")).drop("_tags")


def add_tags(df: DataFrame, keys: DataFrame, tags: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df, counts): tags merged into the rows of keys(path); counts.updated are those that gained one."""
    marked = df.join(keys.select("path").distinct().withColumn("_on", F.lit(True)), "path", "left")
    out = _gain(marked, F.coalesce("_on", F.lit(False)), tags).drop("_on")
    return out.drop("_changed"), counted(out, updated=F.col("_changed"))


def add_tags_to_folder(df: DataFrame, folder: str, tags: list[str]) -> tuple[DataFrame, DataFrame]:
    out = _gain(df, is_under(F.col("path"), folder), tags)
    return out.drop("_changed"), counted(out, updated=F.col("_changed"))


def _replace(df: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    has, both = F.array_contains("tags", old), F.array_contains("tags", new)
    tags = F.when(has & both, F.array_remove("tags", old)).when(has, F.transform("tags", lambda x: F.when(x == old, F.lit(new)).otherwise(x))).otherwise(F.col("tags"))
    return df.withColumn("tags", tags), counted(df, renamed=has & ~both, absorbed=has & both)


def _checked(old: str, new: str) -> tuple[str, str]:
    old, new = normal_tag(old), normal_tag(new)
    if not old or not new or old == new or new == UNTAGGED:
        raise ValueError("a tag is renamed to another one that is neither empty nor reserved")
    return old, new


def rename_tag(df: DataFrame, hidden: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(df, hidden, counts): in its place, or dropped where the new one is there already; the hidden flag moves."""
    old, new = _checked(old, new)
    out, counts = _replace(df, old, new)
    return out, hidden.select(F.when(F.col("name") == old, new).otherwise(F.col("name")).alias("name")).distinct(), counts


def merge_tags(df: DataFrame, hidden: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As rename_tag, but the source's hidden flag goes and the target's stays."""
    source, target = _checked(source, target)
    out, counts = _replace(df, source, target)
    return out, hidden.where(F.col("name") != source), counts


def delete_tag(df: DataFrame, hidden: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    name = normal_tag(name)
    return df.withColumn("tags", F.array_remove("tags", name)), hidden.where(F.col("name") != name), counted(df, affected=F.array_contains("tags", name))


def set_tag_hidden(df: DataFrame, hidden: DataFrame, name: str, flag: bool) -> DataFrame:
    """hidden(name) with or without name. Only a user tag can be hidden; blank and "hidden" are refused."""
    name = normal_tag(name)
    if not name or name == HIDDEN:
        raise ValueError("this name cannot be hidden")
    if not flag:
        return hidden.where(F.col("name") != name)
    if df.where(F.array_contains("tags", name)).isEmpty() and hidden.where(F.col("name") == name).isEmpty():
        raise ValueError(f"no user tag {name}")
    return hidden.select("name").union(df.sparkSession.createDataFrame([(name,)], "name string")).distinct()


def remove_folder(df: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed)"""
    inside = is_under(F.col("path"), folder)
    return df.where(~inside), df.where(inside).select("path")


def plan_moves(df: DataFrame, sources: DataFrame, dest: str) -> tuple[DataFrame, DataFrame]:
    """(results, df): results(path, success, error, new_path) for each of sources(path, seq). A row fails if the
    catalog lacks it, or the destination is taken, by a row or by an earlier source."""
    known = df.select("path", F.lit(True).alias("_known"))
    own = sources.join(known, "path", "left").withColumn("new_path", F.concat(F.lit(dest.rstrip("/") + "/"), base_name(F.col("path"))))
    taken = df.select(F.col("path").alias("new_path"), F.lit(True).alias("_taken"))
    own = own.join(taken, "new_path", "left")
    ready = F.col("_known").isNotNull() & F.col("_taken").isNull()
    first = F.row_number().over(Window.partitionBy("new_path", ready).orderBy("seq"))
    error = F.when(F.col("_known").isNull(), "not in catalog").when(F.col("_taken").isNotNull() | (first > 1), "destination exists")
    results = own.withColumn("error", error).select("path", F.col("error").isNull().alias("success"), "error", F.when(F.col("error").isNull(), F.col("new_path")).alias("new_path"))
    moved = results.where("success").select("path", F.col("new_path").alias("_to"))
    out = df.join(moved, "path", "left").withColumn("name", F.when(F.col("_to").isNotNull(), base_name(F.col("_to"))).otherwise(F.col("name")))
    return results, out.withColumn("path", F.coalesce("_to", "path")).drop("_to")


def plan_deletes(df: DataFrame, paths: DataFrame, permanent: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, df, trash) for paths(path); unknown paths fail; trash is empty if permanent."""
    own = paths.select("path").distinct()
    results = own.join(df.select("path", F.lit(True).alias("_k")), "path", "left").select("path", F.col("_k").isNotNull().alias("success"), F.when(F.col("_k").isNull(), "not in catalog").alias("error"))
    trash = df.join(own, "path", "left_semi").select(F.sha2("path", 256).alias("id"), F.col("path").alias("original_path"), "hash")
    return results, df.join(own, "path", "left_anti"), trash.limit(0) if permanent else trash


def _undo_map(moves: DataFrame, starts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(ends, met): where the undone moves(s, new_path, old_path) take each of starts(path, t), and the moves that take
    any. An element at a path when the operations from t on are undone goes with the latest earlier move to that path.

    Moves are nodes of chains; after r rounds a node knows the end, or the node 2^r moves further on, and which nodes
    are met within so many. An operation moves a path once, so a path has at most ``most`` moves.
    """
    mark = moves.select(F.col("new_path").alias("path"), F.col("s").alias("t"), F.col("s").alias("mark"), F.lit(None).cast("string").alias("who"), F.lit(None).cast("long").alias("own"))
    asks = moves.select(F.col("old_path").alias("path"), F.col("s").alias("t"), F.lit(None).cast("long").alias("mark"), F.col("new_path").alias("who"), F.col("s").alias("own"))
    first = starts.select("path", "t", F.lit(None).cast("long").alias("mark"), F.col("path").alias("who"), F.lit(None).cast("long").alias("own"))
    before = Window.partitionBy("path").orderBy("t", F.col("mark").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)  # at equal t asks come first
    asked = mark.union(asks).union(first).withColumn("next", F.last("mark", ignorenulls=True).over(before)).where("who IS NOT NULL")
    asked = materialise(asked, "undo-asked")
    jump = asked.where("own IS NOT NULL").select(F.col("own").alias("s"), F.col("who").alias("new_path"), F.col("path").alias("end"), "next")
    met = asked.where("own IS NULL AND next IS NOT NULL").select(F.col("next").alias("s"), F.col("path").alias("new_path")).distinct()
    spare = [asked]
    for k in range(max(1, most - 1).bit_length()):
        jump, met = materialise(jump, f"undo-jump{k}"), materialise(met, f"undo-met{k}")
        spare += [jump, met]
        further = jump.select(F.col("s").alias("next"), F.col("new_path").alias("end"), F.col("end").alias("end2"), F.col("next").alias("next2"))
        seen = met.join(jump, ["s", "new_path"]).where("next IS NOT NULL").select(F.col("next").alias("s"), F.col("end").alias("new_path"))
        met = met.union(seen).distinct()
        jump = jump.join(further, ["next", "end"], "left").select("s", "new_path", F.coalesce("end2", "end").alias("end"), F.col("next2").alias("next"))
    elements = asked.where("own IS NULL").select("path", "t", F.col("next").alias("s"), F.col("path").alias("new_path"))
    ends = elements.join(jump.select("s", "new_path", "end"), ["s", "new_path"], "left").select("path", "t", F.coalesce("end", "path").alias("end"))
    ends, met = materialise(ends, "undo-ends"), materialise(met, "undo-met")
    spent(*spare)
    return ends, met


def plan_undo(df: DataFrame, undo: DataFrame, trash: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(results, df): the last k operations of undo(op_seq, kind, old_path, new_path) reversed, the last first.

    Moves swap back; trashed rows return with path, name and hash only, and without tags; permanent deletes never do. A
    row that several of the operations moved goes back along all of them, one that was moved and then trashed too. A
    reversed move fails if nothing is at its new path by then, a restore if trash(original_path, hash) lacks the row; if
    a path was trashed more than once, trash also needs op_seq. results(op_seq, path, success) has each item, path its
    old path. A stack holds DEPTH operations, k is at most that.
    """
    if not 1 <= k <= DEPTH:
        raise ValueError(f"1 to {DEPTH} operations can be undone at once")
    numbers = [r.op_seq for r in undo.select("op_seq").distinct().orderBy(F.desc("op_seq")).limit(k).collect()]
    last = undo.where(F.col("op_seq").isin(numbers)).withColumn("s", F.col("op_seq").cast("long"))
    moves = last.where("kind = 'move'").select("s", "new_path", "old_path")
    gone = last.where("kind = 'delete'").select("s", F.col("old_path").alias("path"))
    there = trash.withColumnRenamed("original_path", "path")
    there = there.select("path", "hash", F.col("op_seq").cast("long").alias("s")) if "op_seq" in trash.columns else there.select("path", "hash")
    restored = materialise(gone.join(there, ["path", "s"] if "s" in there.columns else ["path"]).select("s", "path", "hash"), "undo-restored")
    final = F.lit(2**63 - 1)
    starts = df.select("path").join(moves.select(F.col("new_path").alias("path")).distinct(), "path", "left_semi").select("path", final.alias("t"))
    ends, met = _undo_map(moves, starts.union(restored.select("path", F.col("s").alias("t"))).distinct(), len(numbers))
    to = ends.where(F.col("t") == final).select("path", F.col("end").alias("_to"))
    out = df.join(to, "path", "left").withColumn("name", F.when(F.col("_to").isNotNull() & (F.col("_to") != F.col("path")), base_name(F.col("_to"))).otherwise(F.col("name")))
    out = out.withColumn("path", F.coalesce("_to", "path")).drop("_to")
    back = restored.join(ends.withColumnRenamed("t", "s"), ["path", "s"]).select(F.col("end").alias("path"), base_name(F.col("end")).alias("name"), "hash")
    done = met.join(moves, ["s", "new_path"]).select("s", "old_path").union(restored.select("s", F.col("path").alias("old_path"))).distinct().withColumn("_ok", F.lit(True))
    results = last.join(done, ["s", "old_path"], "left").select("op_seq", F.col("old_path").alias("path"), F.coalesce("_ok", F.lit(False)).alias("success"))
    out = out.unionByName(back, allowMissingColumns=True)
    lists = [x for x in ("tags", "auto_tags") if x in out.columns]
    return results, out.withColumns({x: F.coalesce(x, F.array().cast("array<string>")) for x in lists})
