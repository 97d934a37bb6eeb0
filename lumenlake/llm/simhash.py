"""SimHash near-dedup: fingerprints, and all pairs within a Hamming distance by vantage-point trees.

The top of the tree, built from a bounded sample of fingerprints, routes every distinct fingerprint to the
shard that holds it and, where a branch lies within the radius of a boundary, also as a visitor to the shards
behind that boundary. Each shard orders what it holds by the distance to a vantage point of its own and looks,
by the triangle bound, only at those whose distance differs by at most the radius. All pairs are found.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.arrays import as_bytes, union
from lumenlake.llm.common import components, materialise, spent

SEED = 42
#: Least Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Counts that stand for a set of shingles; the more, the closer the bound, above all for short texts.
BINS = 128
#: A token of more rows is dense: its pairs are held against the counts too.
DENSE = 64
#: Where a row of a token that many share is compared.
BOTH, HOME, ASKS = 0, 1, 2


def fingerprint(data: bytes, width: int = 3) -> int:
    """Of one whole text: bit b is 1 if it is set in over half of the shingles' hashes."""
    words = data.lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    n = len(words) - width + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    n, hashes = len(hashes), hashes.view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 13):
        counts += np.unpackbits(hashes[at : at + (1 << 13)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(text: Column, width: int = 3) -> Column:
    """64-bit fingerprint as a signed long; a null or wordless text has fingerprint zero."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(as_bytes(texts[i : i + 1])[0], width) for i in range(len(texts))], np.uint64).view(np.int64))

    return prints(text)


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def plant(sample: np.ndarray, leaves: int, seed: int = 11) -> list:
    """Tree over the sample with about so many leaves: nodes (vantage, median, near, far), leaves as numbers.

    Of a few vantage points and of the distances near their medians, those are taken that have the fewest of the
    sample about the boundary.
    """
    r = np.random.default_rng(seed)
    nodes: list = []

    def grow(points: np.ndarray, most: int):
        if most < 2 or len(points) < 8:
            nodes.append(None)
            return len(nodes) - 1
        best = None
        for v in r.choice(points, min(24, len(points)), replace=False):
            d = distance(points, v)
            below = np.cumsum(np.bincount(d, minlength=65)) / len(d)
            for cut in np.flatnonzero((below >= 0.35) & (below <= 0.65)):
                score = below[min(64, cut + 3)] - below[max(0, cut - 3)]
                if best is None or score < best[0]:
                    best = (score, v, int(cut), d <= cut)
        if best is None:
            nodes.append(None)
            return len(nodes) - 1
        _, v, cut, inside = best
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (v, cut, grow(points[inside], most // 2), grow(points[~inside], most - most // 2))
        return at

    grow(sample, leaves)
    return nodes


def route(nodes: list, points: np.ndarray, radius: int, home: bool = True):
    """Yields (leaf, places of points, whether they are at home there); each point has one home, or with home false
    none: all are visitors from the start.

    A pair on two sides of a boundary is found where the farther one is at home, so a point at home goes as a
    visitor from the near side to the far side only; a visitor goes to both.
    """
    todo = [(0, np.arange(len(points)), home)]
    while todo:
        at, own, home = todo.pop()
        if not len(own):
            continue
        if nodes[at] is None:
            yield at, own, home
            continue
        v, cut, near, far = nodes[at]
        d = distance(points[own], v)
        todo.append((near, own[d <= cut] if home else own[d <= cut + radius], home))
        if home:
            todo.append((far, own[d > cut], True))
            todo.append((far, own[(d <= cut) & (d > cut - radius)], False))
        else:
            todo.append((far, own[d > cut - radius], False))


def leaf_pairs(homes: np.ndarray, visitors: np.ndarray, radius: int, among: bool):
    """Yields (places in homes then visitors, places in homes) of the pairs of one small leaf within radius."""
    asks = [(0, homes)] if among else []
    for base, asking in [*asks, (len(homes), visitors)]:
        for at in range(0, len(asking), 512):
            i, j = np.nonzero(np.bitwise_count(np.bitwise_xor(asking[at : at + 512][:, None], homes[None])) <= radius)
            yield base + at + i, j


def shard_links(homes: np.ndarray, visitors: np.ndarray, radius: int, among: bool, leaf: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links of one shard as (member, root): a forest over all pairs home-visitor and, if among, home-home.

    The shard's homes make a tree of their own, of leaves of about ``leaf`` points; both sides go down it, and the
    triangle bound keeps them out of the leaves that hold nothing within the radius.
    """
    points = np.concatenate([homes, visitors])
    labels = np.arange(len(points))
    nodes = plant(homes, max(1, len(homes) // leaf))
    at_home: dict[int, np.ndarray] = {}
    guests: dict[int, list[np.ndarray]] = {}
    for at, own, home in route(nodes, homes, radius):
        if home:
            at_home[at] = own
        elif among:
            guests.setdefault(at, []).append(own)
    for at, own, _ in route(nodes, visitors, radius, False):
        guests.setdefault(at, []).append(len(homes) + own)
    found, size = [], 0
    for at, own in at_home.items():
        other = np.concatenate([own[:0], *guests.get(at, [])])
        places = np.concatenate([own, other])
        for i, j in leaf_pairs(points[own], points[other], radius, among):
            found.append((places[i], own[j]))
            size += len(i)
            if size > 1 << 20:
                labels, found, size = union(labels, *map(np.concatenate, zip(*found))), [], 0
    if found:
        labels = union(labels, *map(np.concatenate, zip(*found)))
    linked = np.flatnonzero(labels != np.arange(len(points)))
    return points[linked], points[labels[linked]]


def dealt(points: DataFrame, radius: int, leaves: Callable[[int], int], key: str = "fp", per_task: int = 16384, most_guests: int = 1 << 20, most_sample: int = 1 << 16) -> DataFrame:
    """points with shard, part, chunk and home: each row once where it is at home and wherever it visits.

    leaves gives the number of shards from that of points. The driver sees at most most_sample fingerprints, and two
    counts for each shard of the tree, which has at most a sixteenth of that many. A shard of more than twice per_task
    points at home is dealt to parts, the points of one visiting the later ones, and its visitors to chunks of about
    most_guests, each of which meets all parts; the long column key decides. No pair is lost, and no task holds more
    than a part and a chunk.
    """
    n = points.count()
    wanted = max(1, leaves(n))
    size = min(most_sample, max(4096, 16 * wanted))
    sample = points.orderBy(F.xxhash64(key, F.lit(1)), key).limit(size).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = plant(sample, min(wanted, max(1, size // 16)))

    def visits(batches):
        for batch in batches:
            own_fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at, own, home in route(nodes, own_fp, radius):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "homes": [len(own) if home else 0], "guests": [0 if home else len(own)]})

    sizes = points.select("fp").mapInArrow(visits, "shard int, homes long, guests long").groupBy("shard").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests")).collect()
    parts, chunks = {}, {}
    for x in sizes:
        parts[x.shard] = max(1, round(x.homes / per_task)) if x.homes > 2 * per_task else 1
        chunks[x.shard] = -(-(x.guests + (x.homes if parts[x.shard] > 1 else 0)) // most_guests) or 1

    def deal(batches):
        for batch in batches:
            own_fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            dealer = batch.column(key).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

            def rows(here, at, part, chunk, home):
                place = [np.full(len(here), x, t) for x, t in ((at, np.int32), (part, np.int32), (chunk, np.int32), (home, bool))]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in place] + batch.take(pa.array(here)).columns, ["shard", "part", "chunk", "home", *batch.schema.names])

            for at, own, home in route(nodes, own_fp, radius):
                k, v = parts.get(at, 1), chunks.get(at, 1)
                part = (dealer[own] >> np.uint64(40)).astype(np.int64) % k
                chunk = (dealer[own] >> np.uint64(20)).astype(np.int64) % v
                for p in range(k):
                    if home:
                        for c in range(v):
                            yield rows(own[part == p], at, p, c, True)
                    guest = part < p if home else np.ones(len(own), bool)
                    for c in range(v):
                        if (some := guest & (chunk == c)).any():
                            yield rows(own[some], at, p, c, False)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(deal, f"shard int, part int, chunk int, home boolean, {kinds}")


def near_links(prints: DataFrame, radius: int = 3, shards: Callable[[int], int] = lambda n: math.isqrt(n) // 8) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, whose components are those of all pairs within radius.

    A point visits about the 0.7th power of the number of shards, which therefore grows with the root of the number of
    points only; what is more lies in the trees within shards.
    """

    def search(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        among = table.column("chunk")[0].as_py() == 0
        a, b = shard_links(np.unique(points[home]), np.unique(points[~home]), radius, among) if home.any() else (points[:0], points[:0])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt(prints, radius, shards).groupBy("shard", "part", "chunk").applyInArrow(search, "a long, b long")


def token_pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray, fp: np.ndarray, group: np.ndarray, side: np.ndarray, spread: np.ndarray, place: np.ndarray, radius: int, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that share a token, of fingerprints within radius, other groups and sizes n (of dense tokens spreads
    too, of a row at its place) that allow the least similarity: all, or of each row the ``nearest`` few. Rows of side
    ASKS need not meet each other."""
    order = np.lexsort((n, token))
    token, node, n, fp, group, side, place = (x[order] for x in (token, node, n, fp, group, side, place))
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(token)].astype(np.int64)
    p, q = SIMILAR
    found = [np.empty((0, 3), np.int64)]

    def hold(i, j):
        far = np.bitwise_count(np.bitwise_xor(fp[i], fp[j]))
        fits = (far <= radius) & (group[i] != group[j]) & (q * np.minimum(n[i], n[j]) >= p * np.maximum(n[i], n[j]))
        return np.stack([i[fits], j[fits], far[fits]], 1).astype(np.int64)

    def near(some):
        close = [np.empty(0, bool)]
        for s in range(0, len(some), 1 << 14):
            i, j = some[s : s + (1 << 14), 0], some[s : s + (1 << 14), 1]
            apart = np.abs(spread[place[i]].astype(np.int16) - spread[place[j]]).sum(1)
            close.append(apart * (p + q) <= (n[i] + n[j]) * (q - p))
        return some[np.concatenate(close)]

    def closest(some):
        if nearest is None:
            return some
        some = some[np.lexsort((node[some[:, 1]], some[:, 2], some[:, 0]))]
        return some[np.arange(len(some)) - np.searchsorted(some[:, 0], some[:, 0]) < nearest]

    small = ends - starts <= DENSE
    left = np.repeat(ends * small, ends - starts) - np.arange(len(token)) - 1  # rows of the token behind each row
    run = np.repeat(starts >> 12, ends - starts)  # tokens of about 4096 rows at once
    for at in np.unique(run[left > 0]):
        own, few = np.flatnonzero((run == at) & (left > 0)), [found[0]]
        for step in range(1, DENSE):
            own = own[left[own] >= step]
            if not len(own):
                break
            some = hold(own, own + step)
            few += [some, some[:, [1, 0, 2]]]
        found.append(closest(np.concatenate(few))[:, :2])
    for lo, hi in zip(starts[~small], ends[~small]):
        homes, asking = lo + np.flatnonzero(side[lo:hi] != ASKS), lo + np.flatnonzero(side[lo:hi] != HOME)
        sizes = n[homes]
        for at in range(0, len(asking), 128):
            own = asking[at : at + 128]
            low, high = np.searchsorted(sizes, -(-n[own[0]] * p // q)), np.searchsorted(sizes, n[own[-1]] * q // p, "right")
            some = [found[0]]
            for k in range(low, high, 4096):  # a dense token fills a block of 128 x 4096, no more
                other = homes[k : min(high, k + 4096)]
                i, j = np.nonzero(np.bitwise_count(np.bitwise_xor(fp[own][:, None], fp[None, other])) <= radius)
                some = [closest(np.concatenate([*some, near(hold(own[i], other[j]))]))]
            found += [x[:, :2] for x in some]
    pairs = np.concatenate([x[:, :2] for x in found])
    a, b = node[pairs[:, 0]], node[pairs[:, 1]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_pairs(tokens: DataFrame, radius: int, nearest: int | None = None, per_task: int = 16384) -> DataFrame:
    """Pairs (a, b), a < b, of tokens(token, node, n, fp, spread, group) that share a token and lie within radius, but for those of
    one group or of sizes too far apart: all, or of each node the ``nearest`` few by each token.

    Tokens whose rows are all of one group have no pair. The rows of a token of more than per_task are dealt: those
    outside its largest group are at home, all rows ask them, each part of the one meeting each chunk of the other; for
    the ``nearest`` few, parts do not meet. So no task holds more than a part and a chunk, and a large group costs what
    its rows and the few others are.
    """
    of_group = tokens.groupBy("token", "group").agg(F.count(F.lit(1)).alias("rows"))
    of_token = of_group.groupBy("token").agg(F.sum("rows").alias("m"), F.max(F.struct("rows", "group")).alias("top"), F.count(F.lit(1)).alias("groups"))
    of_token = of_token.where("groups > 1").select(F.col("token").alias("_token"), "m", "top")
    rows = tokens.join(of_token, F.col("token") == F.col("_token")).withColumn("dealer", F.pmod(F.xxhash64("node", "token"), F.lit(1 << 30)).cast("int"))
    total = F.lit(max(1, -(-tokens.count() // (4 * per_task))))
    parts = lambda x: F.greatest(F.lit(1), F.ceil(x / per_task)).cast("int")
    place = lambda side, part, chunk: F.struct(F.lit(side).cast("byte").alias("side"), part.alias("part"), chunk.alias("chunk"))
    alone = F.array(place(BOTH, F.lit(-1), F.lit(-1)))
    if nearest is None:
        k, v = parts(F.col("m") - F.col("top.rows")), parts(F.col("m"))
        asks = F.transform(F.sequence(F.lit(0), k - 1), lambda x: place(ASKS, x, F.col("dealer") % v))
        at_home = F.transform(F.sequence(F.lit(0), v - 1), lambda x: place(HOME, F.col("dealer") % k, x))
        many = F.when(F.col("group") == F.col("top.group"), asks).otherwise(F.concat(asks, at_home))
    else:
        many = F.array(place(BOTH, F.col("dealer") % parts(F.col("m")), F.lit(-1)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("m") <= per_task, alone).otherwise(many)))
    shard = F.when(F.col("m") <= per_task, F.pmod(F.xxhash64("token"), total)).otherwise(F.col("token"))
    rows = rows.select(shard.alias("shard"), "at.part", "at.chunk", "at.side", "token", "node", "n", "fp", "spread", "group")

    def search(table: pa.Table) -> pa.Table:
        token, node, n, fp, group, side = (table.column(x).to_numpy() for x in ("token", "node", "n", "fp", "group", "side"))
        told = table.column("spread").is_valid().to_numpy()
        spread = np.frombuffer(b"".join(table.column("spread").drop_null().to_pylist()), np.uint8).reshape(-1, BINS)
        a, b = token_pairs(token, node, n, fp.view(np.uint64), group, side, spread, np.cumsum(told) - 1, radius, nearest)
        return pa.table({"a": a, "b": b})

    return rows.groupBy("shard", "part", "chunk").applyInArrow(search, "a long, b long").distinct()


def near_roots(keyed: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root) of the different fingerprints of keyed(doc_id, fp): smallest doc_id, and a name of the component."""
    prints = materialise(keyed.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(near_links(prints.select("fp"), radius))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialise(named, "roots")


def near_components(keyed: DataFrame, radius: int = 3) -> DataFrame:
    """keyed(doc_id, fp) with component_id, the smallest doc_id that links reach.

    Equal fingerprints are one point. Null keys count as larger than all others; repeated rows keep their
    places; an empty table gives an empty one.
    """
    named = near_roots(keyed, radius)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return keyed.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def keyed_roots(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> DataFrame:
    """(doc_id, text_hash, root) of every row of docs."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), simhash(F.col(text_col), width).alias("fp"))
    keyed = materialise(keyed, "keyed")
    return keyed.join(near_roots(keyed, radius).select("fp", "root"), "fp").select("doc_id", "text_hash", "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs; other columns are left out, whatever their names.

    Null and wordless texts have fingerprint zero and link with each other like any equal fingerprints.
    """
    keyed = materialise(docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col), width).alias("fp")), "keyed")
    return near_components(keyed, radius)


def kept_of(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one document of each group of found(doc_id, text_hash, root): the one with the smallest key, nulls last,
    then the smallest hash."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key"), F.xxhash64(text_col).alias("hash"))
    return rows.join(kept, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_semi").select("row.*")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """docs with one document of each group: the one with the smallest key, nulls last; of a key that is repeated the text
    of the smallest hash. Rows that repeat key and text are one document, and stay together. Columns keep their names."""
    return kept_of(docs, keyed_roots(docs, id_col, text_col, width, radius), id_col, text_col)


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """Of one whole text, repeats included; a wordless text has none, one of fewer words a single one."""
    words = data.lower().split()
    count = max(1, len(words) - width + 1) if words else 0
    parts = map(b" ".join, zip(*[words[i:] for i in range(width)])) if count > 1 or len(words) == width else [b" ".join(words)] * count
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, count)


def shingled(text: Column, width: int) -> Column:
    """The distinct shingles' hashes of each text."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(as_bytes(texts[k : k + 1])[0], width)).view(np.int64) for k in range(len(texts))]
        return pa.array(sets, pa.list_(pa.int64()))

    return of(text)


def frequent_shingles(docs: DataFrame, text_col: str, width: int, texts: int = 4096, most: int = 1 << 17) -> np.ndarray:
    """Hashes of shingles that three or more of about so many different texts share, the most frequent ones. They only
    order the shingles of a text: which texts are taken changes the work, not the result."""
    every = max(1, docs.count() // texts)
    few = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")).where(F.pmod(F.xxhash64("hash"), F.lit(every)) == 0)
    shared = few.dropDuplicates(["hash"]).select(F.explode(shingled(F.col("text"), width)).alias("x")).groupBy("x").count().where("count > 2")
    return np.sort(np.array([r.x for r in shared.orderBy(F.desc("count"), "x").limit(most).collect()], np.int64).view(np.uint64))


def sketched(text: Column, width: int, last: np.ndarray) -> Column:
    """Struct of the SimHash ``fp``, the number ``n`` of distinct shingles, a hash ``unit`` of them all, how many have each
    remainder by BINS (``spread``, one byte each, 255 for more: a bound still) and the first n - ceil(0.8 n) + 1 of them
    (``prefix``). Two sets differ in no fewer shingles than their spreads. Shingles stand in one order in all texts: by
    hash, those of the sorted array ``last`` behind all others. A wordless text has no shingle. The rest of the shingles
    is not told: they are many times the size of this, and only few texts are ever compared by them."""
    p, q = SIMILAR

    @F.arrow_udf("struct<fp:bigint, unit:bigint, n:bigint, spread:binary, prefix:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        prints, units, sizes, spreads, firsts = [], [], [], [], []
        for k in range(len(texts)):
            own = shingle_hashes(as_bytes(texts[k : k + 1])[0], width)
            prints.append(majority(own))
            own = np.unique(own)
            units.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            sizes.append(len(own))
            spreads.append(np.minimum(np.bincount((own % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
            if len(last):
                often = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                own = np.concatenate([own[~often], own[often]])
            firsts.append(own[: len(own) + (-len(own) * p // q) + 1].view(np.int64))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        columns = [signed(prints), signed(units), pa.array(sizes, pa.int64()), pa.array(spreads, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["fp", "unit", "n", "spread", "prefix"])

    return of(text)


def shared_tokens(points: DataFrame) -> DataFrame:
    """(token, node, n, fp, spread) of points(node, n, fp, spread, prefix), for tokens that two or more of them have; the
    spread is null where the token is not dense."""
    each = points.select("node", F.explode("prefix").alias("token"))
    often = materialise(each.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("dense", F.col("m") > DENSE).select("token", "dense"), "often")
    kept = each.join(often, "token").join(points.select("node", "n", "fp", "spread"), "node")
    kept = materialise(kept.select("token", "node", "n", "fp", F.when(F.col("dense"), F.col("spread")).alias("spread")), "tokens")
    spent(often)
    return kept


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, n, shingles) of wanted(node, mark), mark the hash of a row's key and text. Rows that repeat both are one."""
    rows = docs.select(F.xxhash64(id_col, text_col).alias("mark"), F.col(text_col).alias("text"))
    rows = rows.join(wanted, "mark").groupBy("mark").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    rows = rows.select("node", shingled(F.col("text"), width).alias("shingles"))
    return rows.select("node", F.size("shingles").cast("long").alias("n"), "shingles")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b) of nodes of sets those whose shingles have the least similarity, exactly."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
    p, q = SIMILAR
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.where(F.size(F.array_intersect("sa", "sb")) * (p + q) >= (F.col("na") + F.col("nb")) * p).select("a", "b")


def near_copy_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 16, nearest: int = 8) -> DataFrame:
    """(doc_id, text_hash, root) of every row of docs; links are pairs whose shingles have the least similarity.

    Candidates are the pairs of fingerprints within radius, each held against the exact similarity. At a
    similarity of 0.8 two sets of one size differ in 9.7 of 64 bits on average, and in over 16 in about 1 of 100
    pairs. At so wide a radius fingerprints alone do not part the texts, so they are compared where two texts share
    one of their first shingles: with all shingles in one order, two sets of n shingles or more that share 0.8 share one
    of the first n - ceil(0.8 n) + 1 of each, so no link is lost. Texts of equal shingles are one node. Three steps: links
    within 3 bits; then of each node the ``nearest`` few candidates by each shingle; then all candidates that are left. Each asks only for
    pairs that those before have not joined, so a large group of near copies is mostly one before all its pairs are asked
    for; none is left out. All shingles are written only of the texts that stand in a pair, in each step from another
    reading of docs, which must give the same rows.
    """
    last = frequent_shingles(docs, text_col, width)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.xxhash64(id_col, text_col).alias("mark"), F.monotonically_increasing_id().alias("row"), sketched(F.col(text_col), width, last).alias("s"))
    sketches = materialise(own.select("doc_id", "text_hash", "mark", "row", "s.*"), "sketches")
    points = sketches.groupBy("unit").agg(F.min("row").alias("node"), F.min("mark").alias("mark"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("spread").alias("spread"), F.first("prefix").alias("prefix"))
    points = materialise(points, "points")
    keyed = materialise(sketches.select("doc_id", "text_hash", "unit"), "keyed")
    spent(sketches)
    tokens = shared_tokens(points)
    nodes = materialise(points.select("unit", "node", "mark", "fp"), "nodes")
    spent(points)

    def linked(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = materialise(shingle_sets(docs, nodes.select("node", "mark").join(ends, "node"), id_col, text_col, width), "sets")
        links = materialise(alike(pairs, sets), "links")
        spent(sets)
        return links

    prints = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    stars = nodes.join(prints, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    names = [prints.select(F.col("fp").alias(x), F.col("least").alias(y)) for x, y in (("a", "x"), ("b", "y"))]
    forest = near_links(prints.select("fp")).join(names[0], "a").join(names[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = materialise(stars.union(forest).where("a <> b").distinct(), "pairs")
    links = linked(pairs)
    spare = [keyed, nodes, tokens, prints, pairs, links]
    for few in (nearest, None):
        grouped = tokens.join(components(links).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        grouped = materialise(grouped.select("token", "fp", "node", "n", "spread", F.coalesce("root", "node").alias("group")), "grouped")
        pairs = materialise(near_pairs(grouped, radius, few), "pairs")
        more = linked(pairs)
        links = links.union(more)
        spare += [grouped, pairs, more]
    roots = components(links)
    named = nodes.join(roots, "node", "left").select("unit", F.coalesce("root", "node").alias("root"))
    named = materialise(keyed.select("doc_id", "text_hash", "unit").join(named, "unit").select("doc_id", "text_hash", "root"), "named")
    spent(*spare)
    return named


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 16) -> DataFrame:
    """(doc_id, component_id) of every row of docs, component_id the smallest doc_id that links reach."""
    named = near_copy_roots(docs, id_col, text_col, width, radius)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "component_id")


def near_copy_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 16) -> DataFrame:
    """docs with one document of each group of near copies, as simhash_dedup takes it."""
    return kept_of(docs, near_copy_roots(docs, id_col, text_col, width, radius), id_col, text_col)
