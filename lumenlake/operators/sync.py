"""Keeping a catalog in step with a listing of files, and with roots that are watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.paths import ancestors, is_under, parent_dir, upwards
from lumenlake.operators.search import with_position

# Directories that a listing leaves out.
SKIPPED_NAMES = ["node_modules", "__pycache__", "cdk.out", "vendor"]
SKIPPED_SUFFIXES = [".app", ".bundle", ".framework", ".kext", ".xpc", ".plugin", ".photoslibrary", ".musiclibrary", ".tvlibrary", ".aplibrary", ".photolibrary"]
SYSTEM_PREFIXES = ["/proc", "/sys", "/dev", "/run", "/var", "/boot"]


def skipped_dir(x):
    dotted = x.startswith(".") & ~x.isin(".", "..")
    ends = F.lit(False)
    for s in SKIPPED_SUFFIXES:
        ends = ends | F.lower(x).endswith(s)
    return dotted | x.isin(SKIPPED_NAMES) | ends


def path_policy(df: DataFrame, system_prefixes: list[str] | None = None) -> DataFrame:
    """Rows of df(path) without a skipped directory on the way and not below a system prefix."""
    path = F.col("path")
    system = F.lit(False)
    for p in SYSTEM_PREFIXES if system_prefixes is None else system_prefixes:
        system = system | (path == p) | is_under(path, p)
    return df.where(~system & ~F.exists(F.split(path, "/"), skipped_dir))


def discover_dirs(listing: DataFrame, root: str) -> DataFrame:
    """Every directory at or below root that holds a file at some depth."""
    dirs = folders_above(listing).withColumnRenamed("path", "dir")
    return dirs.where((F.col("dir") == root) | is_under(F.col("dir"), root))


def folders_above(df: DataFrame) -> DataFrame:
    """(path): every directory above a file of df(path). Files are reduced to their folders before these go up."""
    own = df.select(parent_dir(F.col("path")).alias("own")).distinct()
    return own.select(F.explode(upwards(F.col("own"))).alias("path")).distinct()


def detect_changes(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, status): new, changed, unchanged or missing; times compare by the millisecond."""
    a = listing.select("path", F.col("size_bytes").alias("a_size"), F.date_trunc("millisecond", "mod_time").alias("a_time"), F.lit(True).alias("a"))
    b = catalog.select("path", F.col("size_bytes").alias("b_size"), F.date_trunc("millisecond", "mod_time").alias("b_time"), F.lit(True).alias("b"))
    same = F.col("a_size").eqNullSafe(F.col("b_size")) & F.col("a_time").eqNullSafe(F.col("b_time"))
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", status.alias("status"))


def prune_missing(catalog: DataFrame, listing: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows that the listing lacks go, only those under root if one is given. A listing without a
    row (there) is taken for a failed one and refused: it would remove everything."""
    inside = F.lit(True) if root is None else is_under(F.col("path"), root)
    own = listing.where(inside).select("path")
    if own.isEmpty():
        raise ValueError("the listing has no row; nothing is pruned")
    kept = catalog.where(~inside).unionByName(catalog.where(inside).join(own, "path", "left_semi"))
    return kept, catalog.where(inside).join(own, "path", "left_anti").select("path")


def covered_by_roots(folders: DataFrame, roots: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """folders(path) that equal or lie below one of roots(path), or, if media(path) is given, hold any of it."""
    root, own = roots.select(F.col("path").alias("up")), folders.select("path", parent_dir(F.col("path")).alias("own"))
    inside = own.select("own").distinct().select("own", F.explode(upwards(F.col("own"))).alias("up")).join(root, "up", "left_semi").select("own").distinct()
    found = own.join(root, F.col("path") == F.col("up"), "left_semi").select("path").union(own.where("path <> '/'").join(inside, "own", "left_semi").select("path"))
    if media is not None:
        found = found.union(folders.select("path").join(folders_above(media), "path", "left_semi"))
    return found.distinct()


def drop_ignored(paths: DataFrame, ignored: DataFrame) -> DataFrame:
    """paths(path) neither equal to nor below one of ignored(path)."""
    return paths.join(covered_by_roots(paths, ignored), "path", "left_anti")


def scan_summary(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, status, count) of changes(path, status) below each of roots(path)."""
    folders = changes.where("status <> 'missing'").groupBy(parent_dir(F.col("path")).alias("own"), "status").agg(F.count(F.lit(1)).alias("n"))
    up = folders.select("status", "n", F.explode(upwards(F.col("own"))).alias("root"))
    return up.join(roots.select(F.col("path").alias("root")).distinct(), "root").groupBy("root", "status").agg(F.sum("n").alias("count"))


def latest_per_path(df: DataFrame, seq: str) -> DataFrame:
    """The last row of each path by seq; of equal ones the greatest by its other columns."""
    names = [x for x in df.columns if x not in ("path", seq)]
    return df.groupBy("path").agg(F.max(F.struct(seq, *names)).alias("_r")).select("path", "_r.*")


def additive_scan(catalog: DataFrame, scanned: DataFrame) -> DataFrame:
    """scanned over catalog, unrelated rows kept. A row without tags has an empty list of them."""
    out = scanned.unionByName(catalog.join(scanned.select("path"), "path", "left_anti"), allowMissingColumns=True)
    lists = [x for x in ("tags", "auto_tags") if x in out.columns]
    return out.withColumns({x: F.coalesce(x, F.array().cast("array<string>")) for x in lists})


def upsert_catalog(catalog: DataFrame, built: DataFrame, preserve_tags: bool = False) -> DataFrame:
    """built over catalog. A rebuilt row has no tags, as in a fresh scan, unless they are preserved."""
    fresh = built.withColumn("tags", F.array().cast("array<string>"))
    if preserve_tags:
        fresh = fresh.drop("tags").join(catalog.select("path", "tags"), "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return additive_scan(catalog, fresh)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed between two snapshots, by the columns that both have. Nulls are equal
    to nulls alone."""
    names = sorted(x for x in set(old.columns) & set(new.columns) if x != "path")
    values = F.struct(*[F.col(f"`{x}`") for x in names]) if names else F.lit(True)
    a = old.select("path", values.alias("a"), F.lit(True).alias("in_a"))
    b = new.select("path", values.alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def snapshot_counts(diff: DataFrame) -> DataFrame:
    """(change, count) of snapshot_diff."""
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("count"))


def journal_pending(journal: DataFrame) -> DataFrame:
    """The last entry of each id by seq, if it is still pending."""
    names = [x for x in journal.columns if x != "id"]
    return journal.groupBy("id").agg(F.max_by(F.struct(*names), "seq").alias("_r")).select("id", "_r.*").where("state = 'pending'")


def recovery_plan(pending: DataFrame, listing: DataFrame, trash: DataFrame) -> DataFrame:
    """(id, kind, outcome, state, message, catalog_action) of each pending entry(id, kind, path, old_path, new_path)."""
    there = listing.select(F.col("path").alias("_p"), F.lit(True).alias("_there"))
    out = pending
    for column in ("old_path", "new_path", "path"):
        out = out.join(there.select(F.col("_p").alias(column), F.col("_there").alias(f"_{column}")), column, "left")
    out = trash_match(out, trash).withColumnRenamed("in_trash", "_trash")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    src, dst, here, trashed = yes("_old_path"), yes("_new_path"), yes("_path"), yes("_trash")
    kind = F.col("kind")
    cases = [
        ((kind == "move") & ~src & dst, "forwarded", "complete", None, "rename"),
        ((kind == "move") & src & ~dst, "rolled", "failed", "the move never began: source in place", "none"),
        ((kind == "move") & src & dst, "rolled", "failed", "both ends exist: the unfinished copy is dropped", "none"),
        (kind == "move", "skipped", "failed", "neither end of the move exists", "remove"),
        ((kind == "delete") & here, "rolled", "failed", "the delete never began: file in place", "none"),
        ((kind == "delete") & trashed, "forwarded", "complete", None, "remove"),
        (kind == "delete", "skipped", "failed", "the file is gone and the trash lacks it", "remove"),
        ((kind == "permanent-delete") & here, "rolled", "failed", "the file still exists", "none"),
        (kind == "permanent-delete", "forwarded", "complete", None, "remove"),
    ]
    row = F.struct(F.lit("skipped").alias("outcome"), F.lit("pending").alias("state"), F.lit(None).cast("string").alias("message"), F.lit("none").alias("catalog_action"))
    for when, *what in reversed(cases):
        row = F.when(when, F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("outcome", "state", "message", "catalog_action"), what)])).otherwise(row)
    return out.select("id", "kind", row.alias("_r")).select("id", "kind", "_r.*")


def rescan_order(roots: DataFrame) -> DataFrame:
    """roots(path, last_scanned_at) by pos, least recently scanned first. Roots are few."""
    return roots.withColumn("pos", F.row_number().over(Window.orderBy(F.asc_nulls_first("last_scanned_at"), "path")) - 1)


def trash_match(pending: DataFrame, trash: DataFrame) -> DataFrame:
    """pending(path) with in_trash, whether trash has a row of that original_path."""
    there = trash.select(F.col("original_path").alias("path")).distinct().withColumn("in_trash", F.lit(True))
    return pending.join(there, "path", "left").withColumn("in_trash", F.coalesce("in_trash", F.lit(False)))


def trash_list(trash: DataFrame, listing: DataFrame) -> DataFrame:
    """Trash rows whose file is in listing(path), with pos: newest first, then by id, from 0."""
    own = trash.join(listing.select(F.col("path").alias("trash_path")).distinct(), "trash_path", "left_semi")
    return with_position(own, [F.desc("trashed_at"), F.asc("id")])


def upsert_roots(roots: DataFrame, ignored: DataFrame, origin: str, dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, added): roots(path, origin, last_scanned_at) with those of dirs(path) that are new, not blank and not
    ignored; added are the new ones."""
    new = drop_ignored(dirs.where("trim(path) <> ''").select("path").distinct(), ignored).join(roots.select("path"), "path", "left_anti")
    return roots.unionByName(new.withColumn("origin", F.lit(origin)), allowMissingColumns=True), new


def decompose_roots(roots: DataFrame, listing: DataFrame) -> DataFrame:
    """roots with the directories, as the listing shows them, below each root that is its own origin and has none."""
    own = F.coalesce("origin", "path") == F.col("path")
    parents = roots.where(~own).select(F.col("origin").alias("path")).distinct()
    whole = roots.where(own).join(parents, "path", "left_anti").select(F.col("path").alias("origin"))
    dirs = folders_above(listing).where(~F.exists(F.split("path", "/"), skipped_dir))
    below = dirs.select("path", F.explode(ancestors(F.col("path"))).alias("origin")).join(whole, "origin")
    new = below.groupBy("path").agg(F.max("origin").alias("origin")).join(roots.select("path"), "path", "left_anti")  # the nearest: the longest
    return roots.unionByName(new, allowMissingColumns=True)


def remove_roots(roots: DataFrame, ignored: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(roots, ignored) without path and all that has it as origin; path is ignored from now on."""
    left = roots.where((F.col("path") != path) & (F.coalesce("origin", F.lit("")) != path))
    return left, ignored.select("path").union(roots.sparkSession.createDataFrame([(path,)], "path string")).distinct()


def mark_scanned(roots: DataFrame, scanned: DataFrame) -> DataFrame:
    """roots with the later of last_scanned_at and scanned(path, at)."""
    at = scanned.groupBy("path").agg(F.max("at").alias("_at"))
    return roots.join(at, "path", "left").withColumn("last_scanned_at", F.greatest("last_scanned_at", "_at")).drop("_at")
