"""Column functions over perceptual hashes. Hashes are longs whose 64 bits count; null is "none"."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, COLUMNS = 8, 9


def dhash64(grid: Column) -> Column:
    """64 bits of an 8 x 9 grid of brightness, row by row, first bit highest: 1 where left < right."""
    cell = lambda i: F.get(grid, (F.floor(i / 8) * COLUMNS + i % 8).cast("int"))
    bit = lambda i: F.when(cell(i) < F.get(grid, (F.floor(i / 8) * COLUMNS + i % 8).cast("int") + 1), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))


def _shape_prints(px: np.ndarray) -> np.ndarray:
    """Hashes of pictures (n, height, width, channels), blue first, of one shape."""
    _, h, w, c = px.shape
    y = np.clip((np.arange(ROWS) + 0.5) * h / ROWS - 0.5, 0, h - 1)
    x = np.clip((np.arange(COLUMNS) + 0.5) * w / COLUMNS - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    at = lambda a, b: px[:, a][:, :, b].astype(np.float64)
    small = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    small = small[..., [2, 1, 0]] if c >= 3 else np.repeat(small[..., :1], 3, -1)
    luma = (small.round().astype(np.int64) * [299, 587, 114]).sum(-1) // 1000
    bits = np.packbits((luma[..., :-1] < luma[..., 1:]).reshape(len(px), 64), axis=1)
    return bits.copy().view(">i8")[:, 0].astype(np.int64)


def image_dhash(images: DataFrame) -> DataFrame:
    """(path, phash) of decoded pictures, as Spark's image source gives them: bilinear 9 x 8, integer luma."""

    def prints(batches):
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            for (h, w, c), where in pdf.groupby(["height", "width", "nChannels"]).indices.items():
                for at in range(0, len(where), 64):  # pictures of one shape together, a bounded number at a time
                    own = where[at : at + 64]
                    px = np.stack([np.frombuffer(pdf["data"].iat[i], np.uint8).reshape(h, w, c) for i in own])
                    out[own] = _shape_prints(px)
            yield pd.DataFrame({"path": pdf["origin"], "phash": out})

    flat = images.select("image.*").where("width > 0 AND height > 0")
    return flat.mapInPandas(prints, "path string, phash long")


def audio_fold64(fingerprint: Column) -> Column:
    """Comma-separated integers: with 40 or more, the 9th to 40th fold by exclusive or into two halves."""
    parts = F.split(fingerprint, ",")
    middle = F.transform(F.slice(parts, 9, 32), lambda x, i: F.struct(F.trim(x).try_cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v"), i.alias("i")))
    half = lambda odd: F.aggregate(F.filter(middle, lambda x: x["i"] % 2 == odd), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["v"]))
    return F.when(F.size(parts) >= 40, F.shiftleft(half(1), 32).bitwiseOR(half(0))).otherwise(F.lit(0).cast("long"))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cluster_fingerprint(path: Column) -> Column:
    """Aggregate: of a group's different paths, whatever their order; empty for none. Four 60-bit pieces of each path's
    checksum are joined by exclusive or, so that partial results merge and no group is ever gathered."""
    digest = F.sha2(path, 256)
    pieces = [F.bit_xor(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")).cast("string") for k in range(4)]
    return F.when(F.count(path) > 0, F.sha2(F.concat_ws(":", F.count(path).cast("string"), *pieces), 256)).otherwise("")


def fnv1a32(text: Column) -> Column:
    digits = F.hex(F.encode(text, "UTF-8"))
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.length(digits).cast("int")), lambda i: F.substring(digits, i * 2 + 1, F.lit(2))), lambda x: x != "")
    return F.aggregate(pairs, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.conv(x, 16, 10).cast("long")) * 16777619) % 4294967296)


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def cluster_id(phash: Column, first_path: Column) -> Column:
    return F.concat(hex64(phash), F.lit("-"), F.lower(F.lpad(F.hex(fnv1a32(first_path)), 8, "0")))
