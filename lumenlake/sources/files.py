"""File trees, journals, roots and snapshots as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.paths import AUDIO_EXTENSIONS, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, extension
from lumenlake.operators.sync import path_policy

BINARY = "path string, modificationTime timestamp, length long, content binary"
JOURNAL = "id string, kind string, state string, ts timestamp, old_path string, new_path string, path string, trash_path string, photo_hash string, error string"
ROOTS = "path string, origin string, added_at timestamp, last_scanned_at timestamp"


def plain_path(uri: Column) -> Column:
    """Both file:/a and file:///a as /a."""
    return F.regexp_replace(uri, "^file:/*", "/")


def _listed(df: DataFrame) -> DataFrame:
    out = df.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mod_time"))
    return out.where(extension(F.col("path")).isin(IMAGE_EXTENSIONS + VIDEO_EXTENSIONS + AUDIO_EXTENSIONS))


def list_media(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, mod_time) of all media below root; contents are not read."""
    return _listed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def stream_listing(spark: SparkSession, root: str) -> DataFrame:
    return _listed(spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(root))


def content_hash(df: DataFrame, column: str = "content") -> DataFrame:
    return df.withColumn("hash", F.sha2(F.col(column).cast("binary"), 256))


def hashed_media(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """(path, hash) of the files below root, or of those in only(path)."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(plain_path(F.col("path")).alias("path"), "content")
    own = own if only is None else own.join(only.select("path"), "path", "left_semi")
    return content_hash(own).select("path", "hash")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)


def dims_of(images: DataFrame) -> DataFrame:
    """(path, width, height) of decoded pictures, as the image source gives them, in a column ``image``."""
    return images.select(plain_path(F.col("image.origin")).alias("path"), "image.width", "image.height")


def image_dims(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height); files that cannot be decoded are left out."""
    return dims_of(read_images(spark, root))


def probe_fields(df: DataFrame, column: str = "probe") -> DataFrame:
    """df with width, height, creation_time, codec, channels, duration_sec and bitrate_kbps of a probe's JSON;
    the stream's value first, the container's where that is missing or zero."""
    schema = (
        "streams array<struct<codec_type:string, codec_name:string, channels:int, width:int, height:int, duration:string, bit_rate:string, tags:struct<creation_time:string>>>, "
        "format struct<duration:string, bit_rate:string, tags:struct<creation_time:string>>"
    )
    out = df.withColumn("_p", F.from_json(column, schema))
    kind = lambda k: F.get(F.filter("_p.streams", lambda s: s["codec_type"] == k), F.lit(0))
    video, audio = kind("video"), kind("audio")
    number = lambda x: F.nullif(x.try_cast("double"), F.lit(0.0))
    out = out.withColumns({
        "width": F.nullif(video["width"], F.lit(0)),
        "height": F.nullif(video["height"], F.lit(0)),
        "creation_time": F.coalesce(video["tags"]["creation_time"], F.col("_p.format.tags.creation_time")),
        "codec": audio["codec_name"],
        "channels": F.nullif(audio["channels"], F.lit(0)),
        "duration_sec": F.coalesce(number(audio["duration"]), number(F.col("_p.format.duration"))),
        "bitrate_kbps": F.floor(F.coalesce(number(audio["bit_rate"]), number(F.col("_p.format.bit_rate"))) / 1000).cast("int"),
    })
    return out.drop("_p")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``seq``, which sorts them by their file's time and name, then as they stand in it; torn lines
    and lines without an id are dropped."""
    own = spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)
    file = F.col("_metadata")
    # within one block of a file the identifiers rise as the lines do; across files they follow the scan's packing
    seq = F.struct(file["file_modification_time"].alias("at"), file["file_path"].alias("file"), file["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))
    return own.withColumn("seq", seq).where("id IS NOT NULL AND id <> ''")


def read_roots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(roots, ignored) of a file that is a bare array of roots or an object {roots, ignored}."""
    text = spark.read.text(path, wholetext=True)
    root = f"array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in ROOTS.split(','))}>>"
    bare = F.from_json("value", root)
    both = F.from_json("value", f"roots {root}, ignored array<string>")
    array = F.ltrim("value").startswith("[")
    own = text.select(F.when(array, bare).otherwise(both["roots"]).alias("roots"), F.when(~array, both["ignored"]).alias("ignored"))
    roots = own.select(F.inline("roots")).withColumn("origin", F.coalesce(F.nullif("origin", F.lit("")), "path"))
    return path_policy(roots), own.select(F.explode("ignored").alias("path"))
