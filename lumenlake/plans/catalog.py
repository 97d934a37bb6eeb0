"""A media catalog derived from the given tables, in Spark and, for the oracle, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.hashes import dhash64
from lumenlake.functions.paths import base_name, media_kind
from lumenlake.functions.tags import audio_auto_tags, photo_auto_tags

TEXTS = ["path", "name", "media_kind", "hash", "size_bytes", "mod_time", "taken_at", "tags", "auto_tags"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, phash: bool = False) -> DataFrame:
    """One row for each document, as if it were a media file; with phash also the hash of its words' grid."""
    c, n = F.col, F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ext = F.element_at(F.array(*map(F.lit, [".jpg", ".png", ".mp4", ".mp3", ".JPEG"])), (n % 5 + 1).cast("int"))
    maker = lambda *x: F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, x)), (n % 4 + 1).cast("int"))
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/doc_"), n.cast("string"), ext)
    df = docs.withColumn("path", path).withColumn("media_kind", media_kind(c("path")))
    audio = c("media_kind") == "audio"
    plus = lambda start, unit: F.timestamp_add(unit, n.cast("int"), F.to_timestamp(F.lit(start)))
    df = df.withColumns({
        "name": base_name(c("path")),
        "hash": F.sha2("text", 256),
        "size_bytes": F.octet_length("text").cast("long"),
        "mod_time": plus("2024-01-01 00:00:00", "MINUTE"),
        "taken_at": F.when(~audio & (n % 7 != 0), plus("2019-01-01 00:00:00", "HOUR")),
        "camera_make": maker("Canon", "NIKON CORPORATION", "Sony"),
        "camera_model": maker("EOS R5", "NIKON Z 6", "ILCE-7M3"),
        "lens": F.when(n % 3 == 0, "RF 24-70mm F2.8"),
        "iso": (n % 40 * 100).cast("int"),
        "orientation": (n % 9).cast("int"),
        "flash": (n % 32).cast("int"),
        "width": F.when(~audio, 1000 + c("n_chars") % 3000).cast("int"),
        "height": F.when(~audio, 1000 + n % 3000).cast("int"),
        "codec": F.lit(None).cast("string"),
        "duration_sec": F.when(audio, c("n_chars") / 10.0),
        "bitrate_kbps": F.when(audio, n % 400).cast("int"),
        "channels": F.when(audio, n % 7).cast("int"),
        "tags": F.array_compact(F.array(F.when(c("quality") == 1, "good"), F.when(c("quality") == 0, "junk"), F.when(c("toxic") == 1, "hidden"))),
    })
    seen = photo_auto_tags(df).withColumnRenamed("auto_tags", "_photo")
    df = audio_auto_tags(seen).withColumn("auto_tags", F.when(audio, c("auto_tags")).otherwise(c("_photo"))).drop("_photo")
    names = ["doc_id", *TEXTS, "width", "height", "camera_make", "camera_model", "lens", "iso", "orientation", "flash", "codec", "duration_sec", "bitrate_kbps", "channels"]
    if not phash:
        return df.select(*names)
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), "[ \\t\\n\\r\\f]+")).alias("word")).where("word <> ''")
    cells = words.select("doc_id", cell_of(F.col("word")).alias("cell")).groupBy("doc_id", "cell").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("counts"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0)))
    own = df.select(*names).join(counts, "doc_id", "left").select(*names, F.explode(F.array(grid)).alias("_grid"))  # a generator keeps the array from being computed again for each bit
    return own.select(*names, dhash64(F.col("_grid")).alias("phash"))


def cell_of(word):
    """The cell of an 8 x 9 grid that a word falls into by its md5."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % 72).cast("int")


def hidden_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select(F.explode(F.array(F.lit("junk"), F.lit("ghost"))).alias("name")).distinct()


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = catalog(spark, sf_dir).where("doc_id % 10 <> 0")
    own = own.select("path", (F.col("size_bytes") + F.when(F.col("doc_id") % 10 == 1, 1).otherwise(0)).alias("size_bytes"), "mod_time")
    new = table(spark, sf_dir, "pages").select(F.concat(F.lit("/lib/new/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"), F.lit(1).cast("long").alias("size_bytes"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("mod_time"))
    return own.union(new)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    seen = F.when(number % 2 == 0, F.timestamp_add("HOUR", number, F.to_timestamp(F.lit("2024-02-01 00:00:00"))))
    top = F.concat(F.lit("/lib/"), "source")
    return own.select(top.alias("path"), top.alias("origin"), seen.alias("last_scanned_at")).union(own.select(F.concat(top, F.lit("/"), "lang"), top, seen)).distinct()


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.create_map(*[F.lit(x) for x in ("view", "write", "click", "create", "signup", "chmod", "purchase", "rename", "error", "remove")])
    path = F.concat(F.lit("/lib/src"), (F.col("user_id") % 8).cast("string"), F.lit("/en/u"), F.col("user_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "events").select(path.alias("path"), op[F.col("event_type")].alias("op"), "ts")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["move", "delete", "permanent-delete", "restore"]))
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("purchase", "signup"), "complete").otherwise("pending")
    u = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        u.alias("id"), F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int")).alias("kind"), state.alias("state"), F.col("event_id").alias("seq"),
        F.concat(F.lit("/lib/new/"), u, F.lit(".jpg")).alias("old_path"), F.concat(F.lit("/lib/new/"), (F.col("user_id") * 2).cast("string"), F.lit(".jpg")).alias("new_path"),
        F.concat(F.lit("/lib/new/"), u, F.lit(".jpg")).alias("path"), "ts",
    )


CATALOG = r"""
base AS (SELECT d.*, l.quality, l.toxic, ['.jpg', '.png', '.mp4', '.mp3', '.JPEG'][(doc_id % 5 + 1)::INT] AS ext FROM documents d LEFT JOIN labels l USING (doc_id)),
pathed AS (SELECT *, '/lib/' || source || '/' || lang || '/doc_' || doc_id || ext AS path, CASE doc_id % 5 WHEN 2 THEN 'video' WHEN 3 THEN 'audio' ELSE 'photo' END AS media_kind FROM base),
described AS (SELECT doc_id, text, path, 'doc_' || doc_id || ext AS name, media_kind, sha256(text) AS hash, strlen(text)::BIGINT AS size_bytes,
  TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS mod_time,
  CASE WHEN media_kind <> 'audio' AND doc_id % 7 <> 0 THEN TIMESTAMP '2019-01-01' + doc_id * INTERVAL 1 HOUR END AS taken_at,
  [NULL, 'Canon', 'NIKON CORPORATION', 'Sony'][(doc_id % 4 + 1)::INT] AS camera_make, [NULL, 'EOS R5', 'NIKON Z 6', 'ILCE-7M3'][(doc_id % 4 + 1)::INT] AS camera_model,
  CASE WHEN doc_id % 3 = 0 THEN 'RF 24-70mm F2.8' END AS lens, (doc_id % 40 * 100)::INT AS iso, (doc_id % 9)::INT AS orientation, (doc_id % 32)::INT AS flash,
  CASE WHEN media_kind <> 'audio' THEN (1000 + n_chars % 3000)::INT END AS width, CASE WHEN media_kind <> 'audio' THEN (1000 + doc_id % 3000)::INT END AS height,
  CASE WHEN media_kind = 'audio' THEN n_chars / 10.0 END AS duration_sec, CASE WHEN media_kind = 'audio' THEN (doc_id % 400)::INT END AS bitrate_kbps,
  CASE WHEN media_kind = 'audio' THEN (doc_id % 7)::INT END AS channels,
  list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN quality = 0 THEN 'junk' END, CASE WHEN toxic = 1 THEN 'hidden' END], lambda x: x IS NOT NULL) AS tags FROM pathed),
catalog AS (SELECT *, list_sort(list_distinct(list_filter(CASE WHEN media_kind = 'audio' THEN [
    'kind:audio', 'codec:mp3',
    CASE WHEN duration_sec > 1800 THEN 'duration:long' WHEN duration_sec >= 300 THEN 'duration:medium' WHEN duration_sec > 0 THEN 'duration:short' END,
    CASE WHEN bitrate_kbps > 256 THEN 'bitrate:high' WHEN bitrate_kbps >= 128 THEN 'bitrate:mid' WHEN bitrate_kbps > 0 THEN 'bitrate:low' END,
    CASE WHEN channels > 2 THEN 'channels:surround' WHEN channels = 2 THEN 'channels:stereo' WHEN channels = 1 THEN 'channels:mono' END,
    'year:' || strftime(mod_time, '%Y')]
  ELSE ['kind:' || media_kind, 'year:' || strftime(taken_at, '%Y'), 'month:' || strftime(taken_at, '%Y-%m'),
    CASE camera_make WHEN 'Canon' THEN 'camera:canon' WHEN 'Sony' THEN 'camera:sony' WHEN 'NIKON CORPORATION' THEN 'camera:nikon-corporation' END,
    CASE camera_make WHEN 'Canon' THEN 'camera:canon-eos-r5' WHEN 'Sony' THEN 'camera:sony-ilce-7m3' WHEN 'NIKON CORPORATION' THEN 'camera:nikon-corporation-nikon-z-6' END,
    CASE WHEN lens IS NOT NULL THEN 'lens:rf-24-70mm-f2.8' END,
    CASE WHEN iso > 1600 THEN 'iso:high' WHEN iso > 200 THEN 'iso:mid' WHEN iso > 0 THEN 'iso:low' END,
    CASE WHEN flash % 2 = 1 THEN 'flash:on' END,
    CASE WHEN orientation BETWEEN 5 AND 8 THEN 'orientation:portrait' WHEN orientation BETWEEN 1 AND 4 THEN 'orientation:landscape' WHEN height > width THEN 'orientation:portrait' ELSE 'orientation:landscape' END]
  END, lambda x: x IS NOT NULL))) AS auto_tags FROM described)
"""

HASHED = CATALOG + r""",
words AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 72 AS cell FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f]+')) AS w FROM documents) WHERE w <> ''),
cells AS (SELECT doc_id, cell, count(*) AS n FROM words GROUP BY ALL),
grid AS (SELECT d.doc_id, i, coalesce(n, 0) AS n FROM (SELECT doc_id, unnest(range(72)) AS i FROM documents) d LEFT JOIN cells c ON c.doc_id = d.doc_id AND c.cell = d.i),
bits AS (SELECT a.doc_id, a.i - a.i // 9 AS k, (a.n < b.n)::INT AS v FROM grid a JOIN grid b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.i % 9 < 8),
sums AS (SELECT doc_id, sum(v::HUGEINT << (63 - k)::INT) AS u FROM bits GROUP BY doc_id),
hashed AS (SELECT c.*, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS phash FROM catalog c JOIN sums USING (doc_id))
"""

LISTING = CATALOG + r""",
listing AS (SELECT path, size_bytes + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS size_bytes, mod_time FROM catalog WHERE doc_id % 10 <> 0
  UNION ALL SELECT '/lib/new/' || page_id || '.jpg', 1, TIMESTAMP '2024-01-01' FROM pages)
"""

ROOTS = r"""
pairs AS (SELECT DISTINCT source, lang, regexp_extract(source, '([0-9]+)$', 1)::INT AS k FROM documents),
roots AS (SELECT DISTINCT '/lib/' || source || x AS path, '/lib/' || source AS origin, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2024-02-01' + k * INTERVAL 1 HOUR END AS last_scanned_at
  FROM (SELECT *, unnest(['', '/' || lang]) AS x FROM pairs))
"""

EVENTS = r"""
change_events AS (SELECT '/lib/src' || (user_id % 8) || '/en' AS dir, '/lib/src' || (user_id % 8) || '/en/u' || user_id || '.jpg' AS path,
  CASE event_type WHEN 'view' THEN 'write' WHEN 'click' THEN 'create' WHEN 'signup' THEN 'chmod' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'remove' END AS op, ts FROM events),
journal AS (SELECT user_id::VARCHAR AS id, ['move', 'delete', 'permanent-delete', 'restore'][(user_id % 4 + 1)::INT] AS kind,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('purchase', 'signup') THEN 'complete' ELSE 'pending' END AS state, event_id AS seq,
  '/lib/new/' || user_id || '.jpg' AS old_path, '/lib/new/' || (user_id * 2) || '.jpg' AS new_path, '/lib/new/' || user_id || '.jpg' AS path FROM events)
"""
