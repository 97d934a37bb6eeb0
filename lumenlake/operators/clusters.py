"""Byte-identical and perceptually similar media: exact groups, pairs within a Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.hashes import cluster_fingerprint, cluster_id, hamming64
from lumenlake.operators.rewrite import add_tags
from lumenlake.operators.search import with_position
from lumenlake.operators.tables import components, materialise

DUPLICATE, SIMILAR = 5, 12


def exact_clusters(df: DataFrame) -> DataFrame:
    """(id, size, untagged, first) for each content hash of two rows or more. Members stay rows of
    ``exact_members``; a group may hold a third of all rows."""
    own = df.where("hash IS NOT NULL AND hash <> ''").groupBy("hash")
    own = own.agg(F.count(F.lit(1)).alias("size"), F.count_if(F.size("tags") == 0).alias("untagged"), F.min("path").alias("first"))
    return own.where("size > 1").select(F.concat(F.lit("exact-"), "hash").alias("id"), "size", "untagged", "first")


def exact_members(df: DataFrame) -> DataFrame:
    """(id, path, size_bytes, keep): keep marks the first path of each cluster."""
    own = df.where("hash IS NOT NULL AND hash <> ''").withColumn("id", F.concat(F.lit("exact-"), "hash"))
    found = exact_clusters(df).select("id", "first")
    return own.join(found, "id").select("id", "path", "size_bytes", (F.col("path") == F.col("first")).alias("keep"))


def fingerprints(members: DataFrame) -> DataFrame:
    """(id, fingerprint) of clusters given as members(id, path), each path once."""
    return members.groupBy("id").agg(cluster_fingerprint(F.col("path")).alias("fingerprint"))


def drop_dismissed(clusters: DataFrame, members: DataFrame, dismissed: DataFrame) -> DataFrame:
    """clusters but those whose fingerprint is in dismissed(fingerprint)."""
    gone = fingerprints(members.select("id", "path")).join(dismissed, "fingerprint", "left_semi")
    return clusters.join(gone, "id", "left_anti")


def keeper_and_extras(members: DataFrame) -> DataFrame:
    return members.select("id", "path", F.when(F.col("keep"), "keep").otherwise("extra").alias("role"))


def slices_of(n: int) -> list[int]:
    """The 64 bits cut into n slices of about one width, each as a mask, the lowest first."""
    at, out = 0, []
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        out.append(((1 << width) - 1) << at)
        at += width
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shared_keys(threshold: int, equal: int = 3) -> Column:
    """Masks, an array of (number, mask, last), of which two hashes within threshold agree under at least one: of threshold
    + equal slices at most threshold differ, so some ``equal`` of them agree. Three slices together have 24 bits or so,
    which keeps buckets small. last is the highest slice of a mask. The array is constant, so each row is little code."""
    own = slices_of(threshold + equal)
    keys = [(number, signed(sum(own[i] for i in some)), some[-1]) for number, some in enumerate(combinations(range(len(own)), equal))]
    return F.array(*[F.struct(F.lit(number).alias("number"), F.lit(mask).cast("long").alias("mask"), F.lit(last).alias("last")) for number, mask, last in keys])


def first_shared(a: Column, b: Column, last: Column, threshold: int, equal: int = 3) -> Column:
    """Whether a mask under which both hashes agree, with this last slice, is the first such of shared_keys: up to its last
    slice no other agrees."""
    agree = [(a.bitwiseXOR(b).bitwiseAND(F.lit(signed(mask)).cast("long")) == 0) & (last >= i) for i, mask in enumerate(slices_of(threshold + equal))]
    return reduce(lambda x, y: x + y, [x.cast("int") for x in agree]) == equal


#: Hashes that meet in one task of a comparison of all: when pairs are wanted, and when only what they connect is.
PAIRS_SIDE, LINKS_SIDE = 16_384, 65_536
#: A component grows from the largest one of a sample of so many hashes, if that has an eighth of them or more.
CORE, SHARE = 32_768, 8
#: Hashes that look for a neighbour in one task, and members of the component that they meet there.
SOUGHT_SIDE, MEMBERS_SIDE = 32_768, 262_144


def _close(own: np.ndarray, other: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the hashes of own and other within threshold, i < j if they are the same; what is held at once
    is bounded."""
    same = own is other
    for top in range(0, len(own), 32):
        rows = own[top : top + 32, None]
        for left in range(top // 4096 * 4096 if same else 0, len(other), 4096):
            i, j = np.nonzero(np.bitwise_count(rows ^ other[None, left : left + 4096]) <= threshold)
            i, j = i + top, j + left
            yield (i[i < j], j[i < j]) if same else (i, j)


def _linked(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each node reaches, given those before the links (i, j)."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := root[root], root):
            root = up


def _connected(first: np.ndarray, second: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of first and second, once if they are the same, and the place of the least that pairs of one of each
    connect with it; links that are held at once are bounded."""
    both = first if second is first else np.concatenate([first, second])
    shift = 0 if second is first else len(first)
    root, held, size = np.arange(len(both)), [], 0
    for i, j in _close(first, second, threshold):
        new = root[i] != root[j + shift]
        if new.any():
            held.append((i[new], j[new] + shift))
            size += len(held[-1][0])
        if size > 1 << 16:
            root, held, size = _linked(root, *map(np.concatenate, zip(*held))), [], 0
    return both, _linked(root, *map(np.concatenate, zip(*held))) if held else root


def _near_any(own: np.ndarray, members: np.ndarray, threshold: int) -> np.ndarray:
    """Whether each hash of own is within threshold of some member; one that has found a member asks no further."""
    found, left, at, width = np.zeros(len(own), bool), np.arange(len(own)), 0, 512
    apart, bits = np.empty(32 * 4096, np.uint64), np.empty(32 * 4096, np.uint8)
    while at < len(members) and len(left):
        some = members[at : at + width]
        for top in range(0, len(left), 32):
            rows = own[left[top : top + 32], None]
            shape, n = (len(rows), len(some)), len(rows) * len(some)
            x = np.bitwise_xor(rows, some, out=apart[:n].reshape(shape))
            found[left[top : top + 32]] = np.bitwise_count(x, out=bits[:n].reshape(shape)).min(1) <= threshold
        left = left[~found[left]]
        at, width = at + width, min(4096, 2 * width)
    return found


def compared(hashes: DataFrame, threshold: int, links: bool = False) -> DataFrame:
    """(kind, a, b) of the distinct hashes within threshold, by comparing all: hashes are dealt to blocks, every two blocks
    meet in a task of bounded size. With links, of each task only so many pairs (chains of pairs, not all within
    threshold) as connect the same hashes."""
    most = LINKS_SIDE if links else PAIRS_SIDE
    n = hashes.groupBy("kind").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks = max(-(-n // most), min(8, -(-n // 2048)), 1)

    def meet(key, table):
        block, phash = table.column("block").to_numpy(), table.column("phash").to_numpy().view(np.uint64)
        first = phash[block == key[1].as_py()]
        second = first if key[1].as_py() == key[2].as_py() else phash[block == key[2].as_py()]
        if links:
            both, root = _connected(first, second, threshold)
            a, b = both[root], both
        else:
            found = [(first[i], second[j]) for i, j in _close(first, second, threshold) if len(i)]
            a, b = map(np.concatenate, zip(*found)) if found else (first[:0], first[:0])
        a, b = a.view(np.int64), b.view(np.int64)
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        return pa.table({"kind": pa.array([key[0].as_py()] * len(a), pa.string()), "a": a, "b": b})

    block = F.pmod(F.xxhash64("phash"), F.lit(blocks)).cast("int")
    own = hashes.select("kind", "phash", block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = own.select("kind", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "phash")
    # few bytes are much work, so the number of tasks is not left to their size
    own = own.repartition(min(2000, blocks * (blocks + 1)), "kind", "i", "j")
    return own.groupBy("kind", "i", "j").applyInArrow(meet, "kind string, a long, b long")


def reached(rest: DataFrame, members: DataFrame, threshold: int, sizes: tuple[int, int]) -> DataFrame:
    """(kind, phash, center) of rest(kind, phash): center is that of the members(kind, phash, center) if one is within
    threshold, else null. sizes are the greatest numbers of both of a kind; tasks are bounded."""
    chunks = max(-(-sizes[0] // SOUGHT_SIDE), min(16, -(-sizes[0] // 1024)), 1)
    blocks = max(-(-sizes[1] // MEMBERS_SIDE), 1)

    def meet(own, other):
        hits = _near_any(own.column("phash").to_numpy().view(np.uint64), other.column("phash").to_numpy().view(np.uint64), threshold)
        center = np.full(len(hits), other.column("center")[0].as_py() if len(other) else 0, np.int64)
        return pa.table({"kind": own.column("kind"), "phash": own.column("phash"), "center": pa.array(center, mask=~hits)})

    place = lambda n: F.pmod(F.xxhash64("phash"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(2000, 4 * chunks * blocks)  # few bytes are much work, so the number of tasks is not left to their size
    own = rest.select("kind", "phash", place(chunks).alias("i"), every(blocks).alias("j")).repartition(tasks, "kind", "i", "j")
    other = members.select("kind", "phash", "center", every(chunks).alias("i"), place(blocks).alias("j")).repartition(tasks, "kind", "i", "j")
    found = own.groupBy("kind", "i", "j").cogroup(other.groupBy("kind", "i", "j")).applyInArrow(meet, "kind string, phash long, center long")
    return found.groupBy("kind", "phash").agg(F.max("center").alias("center"))


def grown(hashes: DataFrame, threshold: int) -> tuple[list[DataFrame], DataFrame]:
    """(components, rest) of the distinct hashes(kind, phash): whole components, as tables (kind, phash, center) whose
    members of a kind and center are connected, and the hashes in none of them.

    Pairs within a component are not needed once its hashes are known to be in it. So of each kind the largest component of
    a sample is taken, and all other hashes look for a neighbour in it, those that found one become members that the others
    have still to look at, until no member is left to look at. A hash stops at its first neighbour, and members are looked
    at in steps that grow eightfold, so only hashes with few neighbours or none meet all members. No pair between a component and
    the rest is left out. What is left is taken again, as long as a sample shows a component of a good share of it.
    """
    out, aside, rest, turn = [], [], hashes.select("kind", "phash"), 0
    # a row for each kind
    sizes = lambda df, found=F.lit(False): {(x["kind"], x["found"]): x["count"] for x in df.groupBy("kind", found.alias("found")).count().collect()}

    def start(key, table):
        phash = np.sort(table.column("phash").to_numpy()).view(np.uint64)
        _, root = _connected(phash, phash, threshold)
        first, own = np.bincount(root).argmax(), phash.view(np.int64)
        own = own[root == first] if np.count_nonzero(root == first) * SHARE >= len(own) else own[:0]
        return pa.table({"kind": pa.array([key[0].as_py()] * len(own), pa.string()), "phash": own, "center": own[:1].repeat(len(own))})

    while left := {kind: n for (kind, _), n in sizes(rest).items() if n > LINKS_SIDE}:
        parts = F.create_map(*[F.lit(x) for kind, n in left.items() for x in (kind, -(-n // CORE))])
        sample = rest.where(F.pmod(F.xxhash64(F.lit(turn), "phash"), parts[F.col("kind")]) == 0)
        core = materialise(sample.groupBy("kind").applyInArrow(start, "kind string, phash long, center long"), "members")
        n = {kind: m for (kind, _), m in sizes(core).items()}
        aside.append(rest.where(~F.col("kind").isin(*n)))
        if not n:
            return out, reduce(DataFrame.union, aside)
        rest = materialise(rest.where(F.col("kind").isin(*n)).join(core.hint("merge"), ["kind", "phash"], "left_anti"), "rest")
        out.append(core)
        waiting, most, turn = [(core, n)], CORE, turn + 1
        while waiting and left:
            df, n = waiting.pop(0)
            if (cut := -(-max(n.values()) // most)) > 1:
                part = F.pmod(F.xxhash64(F.lit(-turn), "phash"), F.lit(cut))
                waiting.insert(0, (df.where(part > 0), {kind: m - m // cut for kind, m in n.items()}))
                df, n = df.where(part == 0), {kind: m // cut for kind, m in n.items()}
            found = materialise(reached(rest, df, threshold, (max(left.values()), max(n.values()))), "reached")
            rest, new = found.where("center IS NULL").select("kind", "phash"), found.where("center IS NOT NULL")
            own = sizes(found, F.col("center").isNotNull())
            left = {kind: m for (kind, hit), m in own.items() if not hit}
            if n := {kind: m for (kind, hit), m in own.items() if hit}:
                out.append(new)
                waiting.append((new, n))
            most, turn = 8 * most, turn + 1
    return out, reduce(DataFrame.union, aside, rest)


def distinct_hashes(df: DataFrame) -> DataFrame:
    """One row for each kind of media (photos and videos are one) and hash; null and zero are "none"."""
    kind = F.when(F.col("media_kind") == "audio", "audio").otherwise("photo")
    own = df.where("phash IS NOT NULL AND phash <> 0").withColumn("kind", kind)
    return own.groupBy("kind", "phash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first"))


def near_hashes(hashes: DataFrame, threshold: int) -> DataFrame:
    """(kind, a, b, dist), a < b, all pairs of distinct hashes within threshold, losing none.

    Up to eight: hashes that agree in some three of threshold + 3 slices meet. The join shuffles both sides, since
    exploded keys are many times the size that the planner expects of them. A pair that shares many keys is kept at the
    first of them, so none is there twice. Beyond, slices are too few bits, and all hashes are compared.
    """
    if threshold > 8:
        return compared(hashes, threshold).withColumn("dist", hamming64(F.col("a"), F.col("b")))
    keyed = lambda name: hashes.select("kind", F.col("phash").alias(name), F.inline(shared_keys(threshold))).withColumn("key", F.col(name).bitwiseAND(F.col("mask")))
    left, right = keyed("a").drop("mask"), keyed("b").select("kind", "b", "number", "key")
    pairs = left.join(right.hint("merge"), ["key", "number", "kind"]).where("a < b")
    pairs = pairs.withColumn("dist", hamming64(F.col("a"), F.col("b"))).where(F.col("dist") <= threshold)
    return pairs.where(first_shared(F.col("a"), F.col("b"), F.col("last"), threshold)).select("kind", "a", "b", "dist")


def near_links(hashes: DataFrame, threshold: int) -> DataFrame:
    """(kind, a, b): links that connect the same hashes as the pairs of near_hashes, no more than a few for each hash and
    block where all are compared."""
    return near_hashes(hashes, threshold) if threshold <= 8 else compared(hashes, threshold, links=True)


def near_labels(hashes: DataFrame, threshold: int) -> DataFrame:
    """(node, root): the smallest unsigned hash, with its kind, that links within threshold reach from each hash; hashes
    without links may be missing. Beyond eight bits only hashes outside of the large components are compared with all."""
    key = lambda x: F.concat(F.col("kind"), F.lit(":"), F.lower(F.lpad(F.hex(x), 16, "0")))
    whole, rest = grown(hashes, threshold) if threshold > 8 else ([], hashes)
    labels = components(near_links(rest, threshold).select(key("a").alias("a"), key("b").alias("b")))
    if whole:
        own = reduce(DataFrame.union, whole).select("kind", "center", key("phash").alias("node"))
        # a row for each of the large components
        roots = F.broadcast(own.groupBy("kind", "center").agg(F.min("node").alias("root")))
        labels = labels.union(own.join(roots, ["kind", "center"]).select("node", "root"))
    return labels


def near_pairs(df: DataFrame, threshold: int = DUPLICATE) -> DataFrame:
    return near_hashes(materialise(distinct_hashes(df), "hashes"), threshold)


def near_groups(df: DataFrame, threshold: int = DUPLICATE) -> DataFrame:
    """(path, phash, untagged, group): each row with the smallest unsigned hash that links of its kind reach."""
    hashes = materialise(distinct_hashes(df), "hashes")
    key = lambda x: F.concat(F.col("kind"), F.lit(":"), F.lower(F.lpad(F.hex(x), 16, "0")))
    labels = near_labels(hashes, threshold)
    kind = F.when(F.col("media_kind") == "audio", "audio").otherwise("photo").alias("kind")
    own = df.where("phash IS NOT NULL AND phash <> 0").select("path", "phash", kind, (F.size("tags") == 0).alias("untagged"), "size_bytes").withColumn("node", key("phash"))
    return own.join(labels.hint("merge"), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root", "node", "kind")


def clusters_of(groups: DataFrame) -> DataFrame:
    """(group, id, size, untagged, first) of each group of two rows or more, from near_groups."""
    found = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.count_if("untagged").alias("untagged"), F.min("path").alias("first"))
    least = F.conv(F.substring_index("group", ":", -1), 16, -10).cast("long")
    return found.where("size > 1").select("group", cluster_id(least, F.col("first")).alias("id"), "size", "untagged", "first")


def near_clusters(df: DataFrame, threshold: int = DUPLICATE) -> DataFrame:
    """(id, size, untagged, first) of each group of two rows or more; the id is that of the group's smallest hash."""
    return clusters_of(near_groups(df, threshold)).drop("group")


def near_members(df: DataFrame, threshold: int = DUPLICATE) -> DataFrame:
    """(id, path, size_bytes, keep): the rows of near_clusters; keep marks the first path of each."""
    groups = materialise(near_groups(df, threshold), "groups")
    return groups.join(clusters_of(groups).select("group", "id", "first"), "group").select("id", "path", "size_bytes", (F.col("path") == F.col("first")).alias("keep"))


def clusters_needing_tags(clusters: DataFrame) -> DataFrame:
    return clusters.where("untagged > 0")


def clusters_min_size(clusters: DataFrame, n: int, page: int | None = None, rows: int = 50) -> DataFrame:
    """Clusters of n members or more; with page, counted from 0, only that page of ``rows`` of them, largest first."""
    own = clusters.where(F.col("size") >= n)
    if page is None:
        return own
    return with_position(own, [F.desc("size"), F.asc("id")]).where(F.col("pos").between(page * rows, (page + 1) * rows - 1))


def apply_similar_scope(df: DataFrame, duplicates: DataFrame, similar: DataFrame, cluster: str, tags: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df, counts): tags merged into all members of a duplicate cluster, and of the looser clusters that hold one of
    them. duplicates and similar are members(id, path)."""
    own = duplicates.where(F.col("id") == cluster).select("path")
    wider = similar.join(similar.join(own, "path", "left_semi").select("id").distinct(), "id", "left_semi").select("path")
    return add_tags(df, own.union(wider), tags)


def dismiss(dismissed: DataFrame, members: DataFrame) -> DataFrame:
    """dismissed(fingerprint) and the fingerprints of members(id, path), clusters of two or more."""
    many = members.groupBy("id").agg(cluster_fingerprint(F.col("path")).alias("fingerprint"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return dismissed.union(many.select("fingerprint")).distinct()


def undismiss(dismissed: DataFrame, fingerprints: DataFrame) -> DataFrame:
    return dismissed.join(fingerprints, "fingerprint", "left_anti")


#: Points at different spots that make a cell crowded, and the parts that each side of such a cell is cut into.
CROWDED, FINER = 100_000, 8


def nearest_place(points: DataFrame, cities: DataFrame, max_km: float = 50.0, cell: float = 1.0) -> DataFrame:
    """points(id, lat, lon) with place, country and km of the nearest of cities(place, country, lat, lon) within
    max_km; ties by name. Cities are sent to all cells that the radius reaches, so the join is on equal keys;
    a cell's width in longitude shrinks with latitude, which the reach allows for.

    Points at one spot are looked up once. Crowded cells are cut into FINER x FINER, to which only the cities within reach
    of the part are sent. There are at most 360 x 180 / cell^2 cells, so the crowded ones are broadcast.
    """
    reach = max_km / 111.0
    up = int(reach / cell) + 1
    row = F.floor(F.col("lat") / cell)
    far = F.greatest(F.lit(0.02), F.cos(F.radians(F.least(F.abs("lat") + up * cell, F.lit(89.0)))))
    wide = F.least(F.ceil(F.lit(reach / cell) / far).cast("int") + 1, F.lit(int(180 / cell)))
    wide = F.when(F.abs("lat") + up * cell >= 90, F.lit(int(180 / cell))).otherwise(wide)  # a pole within reach: all longitudes
    turns = int(360 / cell)
    column = F.floor((F.col("lon") + 180.0) / cell)
    city = cities.select("place", "country", F.col("lat").alias("clat"), F.col("lon").alias("clon"), row.alias("r"), column.alias("c"), wide.alias("w"))
    city = city.select("place", "country", "clat", "clon", "c", "w", F.explode(F.sequence(F.col("r") - up, F.col("r") + up)).alias("r"))
    city = city.select("place", "country", "clat", "clon", "r", F.explode(F.array_distinct(F.transform(F.sequence(F.col("c") - F.col("w"), F.col("c") + F.col("w")), lambda x: F.pmod(x, F.lit(turns))))).alias("c"))

    within = lambda x, n: F.least(F.floor((x / cell - F.floor(x / cell)) * FINER), F.lit(n - 1)).cast("int")
    spots = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct().withColumns({"r": row, "c": F.pmod(column, F.lit(turns))})
    spots = materialise(spots, "spots")
    crowd = F.broadcast(spots.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("r", "c", F.lit(True).alias("crowded")))
    none = F.lit(-1)
    own = spots.join(crowd, ["r", "c"], "left")
    own = own.withColumns({"i": F.when(F.col("crowded"), within(F.col("lat"), FINER)).otherwise(none), "j": F.when(F.col("crowded"), within(F.col("lon") + 180.0, FINER)).otherwise(none)}).drop("crowded")
    sides = F.sequence(F.lit(0), F.lit(FINER - 1))
    parts = F.flatten(F.transform(sides, lambda i: F.transform(sides, lambda j: F.struct(i.alias("i"), j.alias("j")))))
    city = city.join(crowd, ["r", "c"], "left").withColumn("x", F.explode(F.when(F.col("crowded"), parts).otherwise(F.array(F.struct(none.alias("i"), none.alias("j"))))))
    low = F.col("r") * cell + F.col("x.i") * (cell / FINER)
    left = F.col("c") * cell - 180.0 + F.col("x.j") * (cell / FINER)
    gap = F.greatest(F.lit(0.0), low - F.col("clat"), F.col("clat") - (low + cell / FINER))
    turn = F.pmod(left - F.col("clon"), F.lit(360.0))  # east of the city by so much, to the part's edge
    side = F.when(turn + cell / FINER >= 360.0, 0.0).otherwise(F.least(turn, F.lit(360.0) - turn - cell / FINER))
    top = F.abs("clat") + reach
    near_lon = (top >= 89.0) | (side * F.cos(F.radians(F.least(top, F.lit(89.0)))) <= reach)
    city = city.where(F.col("crowded").isNull() | ((gap <= reach) & near_lon)).select("place", "country", "clat", "clon", "r", "c", "x.i", "x.j")
    near = own.join(city, ["r", "c", "i", "j"])
    half = lambda a, b: F.pow(F.sin(F.radians(F.col(a) - F.col(b)) / 2), 2)
    h = half("lat", "clat") + F.cos(F.radians("lat")) * F.cos(F.radians("clat")) * half("lon", "clon")
    near = near.withColumn("km", 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))).where(F.col("km") <= max_km)
    best = near.groupBy("lat", "lon").agg(F.min_by(F.struct("place", "country", "km"), F.struct(F.round("km", 6), F.col("place"))).alias("b")).select("lat", "lon", "b.*")
    # written, so that the points of one spot can be split over tasks
    return points.join(materialise(best, "nearest"), ["lat", "lon"], "left").select(*points.columns, "place", "country", "km")


#: Vectors and queries that meet in one task of semantic_neighbours.
VECTORS_SIDE, QUERIES_SIDE = 32_768, 4_096


def _lengths(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the embeddings of each length; null ones and those with a null component are left out."""
    column = column.combine_chunks()
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()])
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        flat = column.take(pa.array(rows)).flatten()
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n).any(1)
        yield rows[whole], flat.cast(pa.float64()).fill_null(0.0).to_numpy().reshape(-1, n)[whole]


def semantic_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, most_queries: int | None = None) -> DataFrame:
    """(query, vec_id, score, rank): for each of queries(vec_id, embedding), a stated set, its k nearest of all
    vectors by cosine, ties by vec_id; a pair without a cosine (null or zero embeddings, other lengths) comes last.
    More than most_queries are refused if that is given. Blocks of queries and blocks of vectors meet in tasks of bounded size,
    each of which keeps k for each query before anything is shuffled by query."""
    asked = queries.count()
    if most_queries is not None and asked > most_queries:
        raise ValueError(f"{asked} queries; at most {most_queries} at once")
    n = vectors.count()
    across, down = max(-(-n // VECTORS_SIDE), min(16, -(-n // 1024)), 1), max(-(-asked // QUERIES_SIDE), 1)

    def meet(key, own, sought):
        ids, names = own.column("vec_id").to_numpy(), sought.column("vec_id").to_numpy()
        mine, theirs = dict((m.shape[1], (r, m)) for r, m in _lengths(own.column("embedding"))), list(_lengths(sought.column("embedding")))
        # pairs without a cosine: of each query the k smallest ids are enough
        out = [(names[q : q + 1].repeat(len(few)), few, np.full(len(few), np.nan)) for q in range(len(names)) for few in [low[low != names[q]][:k]]] if len(low := np.sort(ids)[: k + 1]) else []
        for rows, block in theirs:
            if block.shape[1] not in mine:
                continue
            held, matrix = mine[block.shape[1]]
            norms = np.einsum("ij,ij->i", matrix, matrix)
            for top in range(0, len(rows), 64):
                some = block[top : top + 64]
                with np.errstate(all="ignore"):
                    score = some @ matrix.T / np.sqrt(np.einsum("ij,ij->i", some, some)[:, None] * norms)
                score[names[rows[top : top + 64]][:, None] == ids[held]] = np.nan
                score = np.where(np.isfinite(score), score, -np.inf)
                last = np.partition(score, -k, 1)[:, -k] if score.shape[1] > k else np.full(len(score), -1e9)
                i, j = np.nonzero((score >= last[:, None] - 2e-9) & (score > -np.inf))
                order = np.lexsort((ids[held[j]], -np.round(score[i, j], 9), i))
                i, j = i[order], j[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[best], j[best]
                out.append((names[rows[top + i]], ids[held[j]], score[i, j]))
        q, v, s = map(np.concatenate, zip(*out)) if out else (names[:0], ids[:0], np.zeros(0))
        return pa.table({"query": q, "vec_id": v, "score": pa.array(s, mask=np.isnan(s))})

    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(2000, 2 * across * down)  # few bytes are much work, so the number of tasks is not left to their size
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", block(across).alias("i"), every(down).alias("j")).repartition(tasks, "i", "j")
    q = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", every(across).alias("i"), block(down).alias("j")).repartition(tasks, "i", "j")
    found = own.groupBy("i", "j").cogroup(q.groupBy("i", "j")).applyInArrow(meet, "query long, vec_id long, score double")
    # a pair may be there with its cosine and without
    found = found.groupBy("query", "vec_id").agg(F.round(F.max("score"), 9).alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def tagging_queue(members: DataFrame, df: DataFrame) -> DataFrame:
    """(pos, id, size, untagged, first, shared) of clusters with an untagged member, largest first: the first path
    stands for the cluster, shared are the auto tags that all members have. members(id, path)."""
    own = members.select("id", "path").join(df.select("path", "auto_tags", "tags"), "path")
    n = own.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.size("tags") == 0).alias("untagged"), F.min("path").alias("first")).where("untagged > 0")
    tags = own.select("id", F.explode(F.array_distinct("auto_tags")).alias("tag")).groupBy("id", "tag").agg(F.count(F.lit(1)).alias("m"))
    # no more tags than one row has
    shared = n.join(tags, "id").where("m = size").groupBy("id").agg(F.array_sort(F.collect_list("tag")).alias("shared"))
    out = n.join(shared, "id", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    return with_position(out, [F.desc("size"), F.asc("id")])
