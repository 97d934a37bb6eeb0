"""Scratch tables in the shared checkpoint folder, and connected components computed through them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_scopes: list[list[DataFrame]] = []
#: A node with more edges than this, and more than all edges by MOST_HUBS, is a hub.
HUB, MOST_HUBS = 1000, 10_000
SHUFFLED_GOES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session may do without: it gets a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lumenlake-"))
    return _own[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    Cuts the lineage in a way that survives lost executors, and runs what stands above it once. The files stay
    until ``spent`` takes them away, or as long as the folder; what was shuffled for them goes at once, else it would
    stay on the executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLED_GOES)
    spark.conf.set(SHUFFLED_GOES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLED_GOES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that ``materialise`` makes inside are removed at the end, but for those put into the list that it gives.

    Results are lazy and read such tables: write what is wanted before the end.
    """
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        made = _scopes.pop()
        names = {x.scratch_path for x in kept}
        spent(*[x for x in made if x.scratch_path not in names])
        if _scopes:
            _scopes[-1] += [x for x in made if x.scratch_path in names]


def spent(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` gave and that no later job reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_least(edges: DataFrame, n: int) -> DataFrame:
    """edges(a, b), n at most, with m, the least b of each a.

    The edges of a node with very many, a hub, meet in no task: hubs have more than limit edges each, so there are at
    most MOST_HUBS of them, and their least neighbours are broadcast. Edges of other nodes are joined by a shuffle.
    """
    limit = max(HUB, n // MOST_HUBS)
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(low.where(F.col("n") > limit).select("a", F.col("m").alias("hub_m")))
    near = edges.join(hubs, "a", "left")
    rest = near.where("hub_m IS NULL").select("a", "b").join(low.where(F.col("n") <= limit).select("a", "m"), "a")
    return near.where("hub_m IS NOT NULL").select("a", "b", F.col("hub_m").alias("m")).union(rest.select("a", "b", "m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes; the driver sees a
    count and a checksum for each round. Nodes without an edge to another node do not appear.
    """
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = materialise(edges.where("a <> b").selectExpr("least(a, b) AS b", "greatest(a, b) AS a").distinct(), "edges")
    seen = state(now)
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, 2 * seen[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small, "edges")
        spent(now)
        now, before, seen = after, seen, state(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
