"""Column functions over tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.paths import base_name, extension, media_kind, parent_dir

UNTAGGED, HIDDEN = "untagged", "hidden"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def normalize_tags(tags: Column) -> Column:
    """Lower case, trimmed, distinct in the order first seen, without empty ones and the reserved name."""
    return F.array_distinct(F.filter(F.transform(tags, lambda x: F.lower(trimmed(x))), lambda x: x.isNotNull() & (x != "") & (x != UNTAGGED)))


def normal_tag(name: str) -> str:
    return name.strip().lower()


def tokenize_query(q):
    """Lower-case tokens between white space: a list of a string, an array column of a column."""
    if isinstance(q, str):
        return q.lower().split()
    return F.filter(F.split(F.lower(q), "(?U)\\s+"), lambda x: x != "")


def tag_slug(prefix: str, value: Column) -> Column:
    """prefix:value in lower case, runs of blanks, underscores and slashes as one dash; null if blank."""
    slug = F.lower(trimmed(value))
    dashed = F.regexp_replace(F.concat(F.lit(prefix + ":"), F.regexp_replace(slug, "[ \\t_/\\\\]+", "-")), "-+$", "")
    return F.when(slug != "", dashed)


def sorted_tags(*tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))


def photo_auto_tags(df: DataFrame, folder_tags: bool = False, places: bool = False) -> DataFrame:
    """df(path, taken_at, camera_make, camera_model, lens, iso, orientation, flash, width, height) with
    ``auto_tags``; with places also place and country columns, as nearest_place gives them."""
    c = F.col
    make, model = F.coalesce("camera_make", F.lit("")), F.coalesce("camera_model", F.lit(""))
    whole = F.when((make != "") & ~F.lower(model).startswith(F.lower(make)), F.concat(make, F.lit(" "), model)).otherwise(model)
    tags = [
        F.concat(F.lit("kind:"), media_kind(c("path"))),
        F.concat(F.lit("year:"), F.date_format("taken_at", "yyyy")),
        F.concat(F.lit("month:"), F.date_format("taken_at", "yyyy-MM")),
        tag_slug("camera", make),
        F.when(model != "", tag_slug("camera", whole)),
        tag_slug("lens", c("lens")),
        F.when(c("iso") > 1600, "iso:high").when(c("iso") > 200, "iso:mid").when(c("iso") > 0, "iso:low"),
        F.when(flash_fired(c("flash")), "flash:on"),
        F.when(c("orientation").between(5, 8), "orientation:portrait")
        .when(c("orientation").between(1, 4), "orientation:landscape")
        .when((c("width") > 0) & (c("height") > c("width")), "orientation:portrait")
        .when((c("width") > 0) & (c("height") > 0), "orientation:landscape"),
    ]
    if folder_tags:
        folder = base_name(parent_dir(c("path")))
        tags.append(F.when(~folder.isin("", ".", "/"), tag_slug("folder", folder)))
    if places:
        tags += [tag_slug("place", c("place")), tag_slug("country", c("country"))]
    return df.withColumn("auto_tags", sorted_tags(*tags))


def audio_auto_tags(df: DataFrame) -> DataFrame:
    """df(path, mod_time, codec, duration_sec, bitrate_kbps, channels) with ``auto_tags``."""
    c = F.col
    codec = F.lower(trimmed(F.coalesce("codec", F.lit(""))))
    codec = F.when(codec != "", codec).otherwise(F.regexp_replace(extension(c("path")), "^\\.", ""))
    return df.withColumn("auto_tags", sorted_tags(
        F.lit("kind:audio"),
        tag_slug("codec", codec),
        F.when(c("duration_sec") > 1800, "duration:long").when(c("duration_sec") >= 300, "duration:medium").when(c("duration_sec") > 0, "duration:short"),
        F.when(c("bitrate_kbps") > 256, "bitrate:high").when(c("bitrate_kbps") >= 128, "bitrate:mid").when(c("bitrate_kbps") > 0, "bitrate:low"),
        F.when(c("channels") > 2, "channels:surround").when(c("channels") == 2, "channels:stereo").when(c("channels") == 1, "channels:mono"),
        F.concat(F.lit("year:"), F.date_format("mod_time", "yyyy")),
    ))


DESCRIBED = {
    "taken_at": "timestamp", "camera_make": "string", "camera_model": "string", "lens": "string", "iso": "int", "orientation": "int", "flash": "int",
    "width": "int", "height": "int", "codec": "string", "duration_sec": "double", "bitrate_kbps": "int", "channels": "int",
}


def with_auto_tags(df: DataFrame) -> DataFrame:
    """df(path, mod_time) and whatever else is known, with name, media_kind and ``auto_tags``; what is not known of a
    file (DESCRIBED) gives no tag."""
    path = F.col("path")
    known = df.withColumns({k: F.lit(None).cast(t) for k, t in DESCRIBED.items() if k not in df.columns})
    kind = media_kind(path)
    photo = photo_auto_tags(known).select("*", F.col("auto_tags").alias("photo_tags")).drop("auto_tags")
    both = audio_auto_tags(photo).withColumn("auto_tags", F.when(kind == "audio", F.col("auto_tags")).otherwise(F.col("photo_tags")))
    new = {"name": base_name(path), "media_kind": kind, "auto_tags": F.col("auto_tags")}
    return both.select(*[x for x in df.columns if x not in new], *[v.alias(k) for k, v in new.items()])


def flash_fired(flash: Column) -> Column:
    return F.coalesce(flash.bitwiseAND(1) == 1, F.lit(False))


# What a hit counts, at the start, behind a boundary, and less for each character of the target.
HIT, AT_START, AT_BOUNDARY, A_CHARACTER = 1, 4, 2, 0.01


def fuzzy_score(q: str | Column, target: Column) -> Column:
    """How well the letters of q, in order, hit the target; null if they don't all occur."""
    q = F.lit(q) if isinstance(q, str) else q
    wanted = F.filter(F.split(F.lower(q), ""), lambda x: x != "")
    text = F.lower(target)
    letters = F.split(text, "")
    at = F.zip_with(letters, F.concat(F.array(F.lit("")), letters), lambda x, before: F.struct(x.alias("x"), before.alias("before")))
    zero = F.struct(F.lit(0).alias("qi"), F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(False).alias("hit"))

    def step(acc, c):
        hit = F.coalesce(c["x"] == F.get(wanted, acc["qi"]), F.lit(False))
        run = F.when(hit & acc["hit"], acc["run"] + 1).otherwise(0)
        place = F.when(c["before"] == "", AT_START).when(c["before"].rlike("[\\s\\-_./]"), AT_BOUNDARY).otherwise(0)
        gain = F.when(hit, HIT + place + run).otherwise(0)
        return F.struct((acc["qi"] + hit.cast("int")).alias("qi"), (acc["score"] + gain).alias("score"), F.when(hit, run).otherwise(acc["run"]).alias("run"), hit.alias("hit"))

    end = F.aggregate(F.filter(at, lambda c: c["x"].isNotNull() & (c["x"] != "")), zero, step)
    score = F.when(end["qi"] == F.size(wanted), end["score"] - F.length(text) * F.lit(A_CHARACTER))
    return F.when(q == "", F.lit(0.0)).otherwise(score)
