"""Embedding near-dedup by randomised-rotation binary codes.

Each unit vector is rotated at random and kept as its signs with a correction factor, the inner product of the
vector and its code. The code times another rotated vector, over that factor, is an unbiased estimate of the
two vectors' inner product, with an error bound that the factor gives; only pairs that the bound cannot rule
out are computed again in double precision. Candidate pairs are those that share a band of further rotations'
sign bits; the number of bands follows from the recall asked for.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.arrays import union
from lumenlake.llm.common import components, materialise


@lru_cache(maxsize=1024)
def rotation(dim: int, k: int, seed: int) -> np.ndarray:
    """Made once in each Python worker."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan_bands(n: int, threshold: float, recall: float, bucket: int = 64) -> tuple[int, int]:
    """(bits of a band, bands): about ``bucket`` of n random vectors share a band's value, so buckets do not grow with
    n; a pair at the threshold shares at least one band with probability recall."""
    bits = max(4, math.ceil(math.log2(max(2, n) / bucket)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def band_keys(unit: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """(rows, bands) values of each band; as many rotations as the bands need."""
    dim = unit.shape[1]
    need = -(-bits * bands // dim)
    signs = np.concatenate([unit @ rotation(dim, 1 + k, seed).T >= 0 for k in range(need)], 1)[:, : bits * bands]
    return signs.reshape(len(unit), bands, bits) @ (1 << np.arange(bits))


def codes(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes (signs over root dim) and the correction factors."""
    turned = unit @ rotation(unit.shape[1], 0, seed).T
    code = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned.astype(np.float32), code.astype(np.float32), (turned * code).sum(1)


def lowest_estimate(factor: np.ndarray, dim: int, threshold: float, width: float) -> np.ndarray:
    """The estimate below which a pair is ruled out: the error of the estimate is at most width standard
    deviations, of root((1 - threshold^2)(1 - factor^2) / (dim - 1)) / factor each."""
    spread = np.sqrt(np.maximum(0, 1 - factor**2) * (1 - threshold**2) / max(1, dim - 1)) / factor
    return threshold - width * spread


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def bucket_links(band: int, rows: np.ndarray, part: np.ndarray, low: int, high: int, v: np.ndarray, norm: np.ndarray, turned: np.ndarray, code: np.ndarray, factor: np.ndarray, lowest: np.ndarray, threshold: float, keys_of):
    """Yields (i, j, new) of the linked pairs of one tile of a bucket: rows of part low against rows of part high.
    new: whether the two share no band before this one, where the pair has been counted already."""
    left, right = rows[part[rows] == low], rows[part[rows] == high]
    for at in range(0, len(left), 512):
        own = left[at : at + 512]
        i, j = np.nonzero((code[own] @ turned[right].T) / factor[own, None] >= lowest[own, None])
        i, j = own[i], right[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            near = (v[a] * v[b]).sum(1) / (norm[a] * norm[b]) >= threshold
            a, b = a[near], b[near]
            if len(a):
                who, at_who = np.unique(np.concatenate([a, b]), return_inverse=True)
                before = keys_of(who)[:, :band]
                yield a, b, ~(before[at_who[: len(a)]] == before[at_who[len(a) :]]).any(1)


def vector_links(classes: DataFrame, dim: int, n: int, threshold: float, recall: float, width: float, seed: int, most: int, packed: int = 5) -> DataFrame:
    """classes(cid, copies, v) -> rows (cid, links, root): of some buckets, how many vectors (copies counted) each
    class links with there and nowhere before, and the root of its links there.

    A task's group is 2^packed neighbouring buckets, or one tile of a bucket of over ``most`` classes.
    """
    bits, bands = plan_bands(n, threshold, recall)

    def keyed(batches):
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column("v")]))
            keys = band_keys(v / np.linalg.norm(v, axis=1, keepdims=True), bits, bands, seed)
            cid = np.repeat(batch.column("cid").to_numpy(zero_copy_only=False), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), len(v))
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.string()), pa.array(band), pa.array(keys.ravel().astype(np.int64))], ["cid", "band", "value"])

    keys = materialise(classes.select("cid", "v").mapInArrow(keyed, "cid string, band int, value long"), "bands")
    sizes = keys.groupBy("band", "value").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    placed = keys.join(sizes, ["band", "value"]).withColumn("parts", F.ceil(F.col("m") / most).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    tile = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pack = F.when(F.col("parts") == 1, F.shiftright("value", packed)).otherwise(-1 - F.col("value"))
    placed = placed.withColumn("other", tile).select("cid", "band", "value", pack.alias("pack"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part")
    rows = placed.join(classes, "cid")

    def group_links(table: pa.Table) -> pa.Table:
        band, low, high = (table.column(x)[0].as_py() for x in ("band", "low", "high"))
        table = table.sort_by("value")
        v = _matrix(table.column("v"))
        copies, part, value = (table.column(x).to_numpy() for x in ("copies", "part", "value"))
        norm = np.linalg.norm(v, axis=1)
        unit = v / norm[:, None]
        turned, code, factor = codes(unit, seed)
        lowest = lowest_estimate(factor, dim, threshold, width).astype(np.float32)
        labels, links = np.arange(len(v)), np.zeros(len(v), np.int64)
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(v)]
        keys_of = lambda who: band_keys(unit[who], bits, bands, seed)
        for a, b in zip(cuts, cuts[1:]):
            for i, j, new in bucket_links(band, np.arange(a, b), part, low, high, v, norm, turned, code, factor.astype(np.float32), lowest, threshold, keys_of):
                labels = union(labels, i, j)
                np.add.at(links, i[new], copies[j[new]])
                np.add.at(links, j[new], copies[i[new]])
        hit = np.flatnonzero((links > 0) | (labels != np.arange(len(v))))
        cid = table.column("cid").take(pa.array(hit))
        return pa.table({"cid": cid, "links": links[hit], "root": table.column("cid").take(pa.array(labels[hit]))})

    return rows.groupBy("band", "pack", "low", "high").applyInArrow(group_links, "cid string, links long, root string")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.998, width: float = 4.0, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 17, most: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; other columns are left out, whatever their names.

    A vector that is null, empty, zero, or holds a null or a component that is not finite links with nothing
    and is its own component. Vectors of different lengths do not link. Equal vectors are one class whose
    copies count; repeated rows link with each other. recall is the least expected share of the pairs at the
    threshold that meet in a band (closer pairs are likelier to); what is found is exact. A bucket of over
    ``most`` classes is dealt to tasks by tiles, all pairs of parts.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    wide = F.hex(F.xxhash64(v)), F.hex(F.xxhash64(F.lit("second"), v))
    own = vectors.select(F.col(id_col).alias("vec_id"), F.when(sound, F.concat(*wide)).alias("cid"), F.when(sound, v).alias("v"))
    own = materialise(own, "vectors")
    classes = own.where("cid IS NOT NULL").groupBy("cid").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
    classes = materialise(classes, "classes")
    found = None
    # lengths are few: one search for each, over the vectors of that length alone
    for dim, n in sorted((x.dim, x.n) for x in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()):
        some = vector_links(classes.where(F.size("v") == dim).select("cid", "copies", "v"), dim, n, threshold, recall, width, seed, most)
        found = some if found is None else found.union(some)
    if found is None:
        found = spark.createDataFrame([], "cid string, links long, root string")
    found = materialise(found, "tiles")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "copies", "first").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(sums, "cid", "left")
    named = materialise(named.select("cid", "first", F.coalesce("root", "cid").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = named.join(least, "root").select("cid", "n_links", "component_id")
    alone = own.where("cid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = own.where("cid IS NOT NULL").select("vec_id", "cid").join(by_class, "cid").select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
