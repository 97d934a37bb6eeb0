"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import materialise, running_total

#: Hexadecimal digits of the key's hash that name a bucket of a shard's rows: 4,096 buckets.
BUCKET_DIGITS = 3


def draw(key: Column, shard: int, weight: float) -> Column:
    """Struct (draw, shard): an exponential variable of rate weight, fixed by md5 of "key:shard"."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / float(weight)).alias("draw"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The least draw, with its shard. Each shard wins in proportion to its weight, and the draw of a shard depends on no
    other shard: one more shard takes rows only into itself, one less spreads only its own rows. Ties go to the smaller
    shard."""
    draws = [draw(key, shard, weight) for shard, weight in enumerate(weights) if weight > 0]
    if not draws:
        raise ValueError("a shard of positive weight is needed")
    return F.array_min(F.array(*draws))


def shard_records(docs: DataFrame, shards: int = 40, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each record: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key alone decides the shard; grown_shard is the shard with one more of mean weight. slot counts the
    shard's rows without gaps, in the order of the first digits of md5(key), then key, size and checksum. A null
    key is a key of its own, told from the text "null"; a null text has no bytes; rows that repeat a key lie in
    one shard, in slots of their own. Other columns are left out, whatever their names.
    """
    weights = list(weights or [1.0] * shards)
    text = F.col(text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\\N"))
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        key.alias("_key"),
    )
    own = own.withColumns({
        "_won": rendezvous(F.col("_key"), weights),
        "_new": draw(F.col("_key"), len(weights), sum(weights) / len(weights)),
        "_bucket": F.substring(F.md5("_key"), 1, BUCKET_DIGITS),
        "_one": F.lit(1),
    })
    own = own.withColumns({"shard": F.col("_won.shard"), "grown_shard": F.least("_won", "_new")["shard"]}).drop("_won", "_new")
    own = materialise(own, "shards")
    order = [F.col(x) for x in ("_key", "size", "text_crc32")]
    out = running_total(own, ["shard"], "_bucket", order, "_one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
