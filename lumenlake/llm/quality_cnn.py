"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over the whole document and are max-pooled over overlapping chunks of two
halves; the mean, the maximum and the minimum of the pooled filters over all chunks go through a hidden layer into one
probability. The minimum tells of chunks in which what is common elsewhere is missing, as in runs of one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, FILTERS, HALF, HIDDEN, STEP = 6, 16, 64, 16, 128


def symbols(data: bytes) -> np.ndarray:
    """The bytes of one document, padded with zeros to whole half-chunks."""
    n = max(1, -(-len(data) // HALF)) * HALF
    x = np.zeros(n, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    return x


def pooled(sym: np.ndarray, tables: np.ndarray, where: bool = False):
    """Maximum of every filter over each half-chunk of sym, (halves, FILTERS); with where also its place."""
    halves, parts, places = len(sym) // HALF, [], []
    padded = np.concatenate([sym, np.zeros(WIDTH - 1, sym.dtype)])
    out, tap = np.empty((2, STEP * HALF, FILTERS), np.float32)  # small enough to stay in the cache
    for at in range(0, halves, STEP):
        to = min(halves, at + STEP)
        n = (to - at) * HALF
        np.take(tables[0], padded[at * HALF : at * HALF + n], axis=0, out=out[:n], mode="clip")
        for k in range(1, WIDTH):
            np.take(tables[k], padded[at * HALF + k : at * HALF + k + n], axis=0, out=tap[:n], mode="clip")
            out[:n] += tap[:n]
        block = out[:n].reshape(to - at, HALF, FILTERS)
        if where:
            best = block.argmax(1)
            places.append(best + (np.arange(at, to) * HALF)[:, None])
            parts.append(np.take_along_axis(block, best[:, None], 1)[:, 0])
        else:
            half = HALF
            while half > 1:
                half //= 2
                np.maximum(block[:, :half], block[:, half : 2 * half], out=block[:, :half])
            parts.append(block[:, 0].copy())
    top = np.concatenate(parts)
    return (top, np.concatenate(places)) if where else top


def chunked(top: np.ndarray) -> np.ndarray:
    """Maxima over chunks of two halves each, overlapping by one half."""
    return np.maximum(top[:-1], top[1:]) if len(top) > 1 else top


def start(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {
        "tables": r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.full(FILTERS, -1.0, np.float32),
        "w1": r.normal(0, 0.4, (3 * FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": r.normal(0, 0.4, HIDDEN).astype(np.float32),
        "b2": np.zeros(1, np.float32),
    }


def probability(model: dict, data: bytes) -> float:
    """Of one whole document, the empty one included."""
    act = np.tanh(chunked(pooled(symbols(data), model["tables"])) + model["bias"])
    hidden = np.tanh(np.concatenate([act.mean(0), act.max(0), act.min(0)]) @ model["w1"] + model["b1"])
    return float(1 / (1 + np.exp(-np.clip(float(hidden @ model["w2"]) + float(model["b2"][0]), -30, 30))))


def fit(texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Train on the driver from a bounded list; every epoch sees each document whole."""
    r = np.random.default_rng(seed)
    model = start(seed)
    if not texts:
        return model
    share = min(max(float(np.mean(labels)), 0.01), 0.99)
    model["b2"][0] = np.log(share / (1 - share))
    docs = [symbols(t) for t in texts]
    y = np.array(labels, np.float32)
    mean = {k: np.zeros_like(v) for k, v in model.items()}
    var = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = r.permutation(len(docs))
        for at in range(0, len(order), batch):
            grad = {k: np.zeros_like(v) for k, v in model.items()}
            own = order[at : at + batch]
            for d in own:
                sym = docs[d]
                top, place = pooled(sym, model["tables"], True)
                if len(top) > 1:
                    second = top[1:] > top[:-1]
                    place = np.where(second, place[1:], place[:-1])
                act = np.tanh(chunked(top) + model["bias"])
                best, worst = act.argmax(0), act.argmin(0)
                both = np.concatenate([act.mean(0), act.max(0), act.min(0)])
                hidden = np.tanh(both @ model["w1"] + model["b1"])
                p = 1 / (1 + np.exp(-np.clip(float(hidden @ model["w2"]) + float(model["b2"][0]), -30, 30)))
                g = (p - y[d]) / len(own)
                grad["b2"] += g
                grad["w2"] += g * hidden
                gh = g * model["w2"] * (1 - hidden**2)
                grad["b1"] += gh
                grad["w1"] += np.outer(both, gh)
                gf = model["w1"] @ gh
                ga = np.repeat(gf[None, :FILTERS] / len(act), len(act), 0)
                ga[best, np.arange(FILTERS)] += gf[FILTERS : 2 * FILTERS]
                ga[worst, np.arange(FILTERS)] += gf[2 * FILTERS :]
                ga *= 1 - act**2
                grad["bias"] += ga.sum(0)
                padded = np.concatenate([sym, np.zeros(WIDTH - 1, sym.dtype)])
                column = np.broadcast_to(np.arange(FILTERS), place.shape)
                for k in range(WIDTH):
                    np.add.at(grad["tables"][k], (padded[place + k], column), ga)
            step += 1
            for k in model:
                mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                var[k] = 0.999 * var[k] + 0.001 * grad[k] ** 2
                model[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, most_rows: int = 2000, most_bytes: int = 1 << 25) -> tuple[list[bytes], list[int]]:
    """At most most_rows labelled texts, whole, in the order of a hash of their key, until they have most_bytes.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 may be learned from; the rest is held out. The rows
    are first chosen by key among the labels alone, so that text is read for a bounded number of keys; of rows that
    repeat a key the text of the least hash counts. So the driver gets most_bytes and one document at most.
    """
    named = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    named = named.where(~held_out(F.col("doc_id")))
    ids = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size"))
    own = own.groupBy("doc_id", "quality").agg(F.min("mark").alias("mark"), F.min_by("size", "mark").alias("size"))
    chosen, so_far = [], 0
    for x in own.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # most_rows numbers
        if so_far < most_bytes:
            chosen.append((x.doc_id, x.quality, x.mark))
        so_far += x.size
    if not chosen:
        return [], []
    keys = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int, mark long"))
    rows = texts.withColumn("mark", F.xxhash64("text")).join(keys, ["doc_id", "mark"])
    # equal texts: one of each key
    rows = rows.groupBy("doc_id", "quality").agg(F.collect_set("text").alias("texts")).collect()
    place = {x[0]: i for i, x in enumerate(chosen)}
    rows = sorted(rows, key=lambda x: place[x.doc_id])
    return [x.texts[0].encode() for x in rows], [x.quality for x in rows]


def held_out(doc_id):
    """True where crc32 of the key as text is divisible by five; a null key counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 2000, **options) -> dict[str, np.ndarray]:
    return fit(*training_sample(docs, labels, most_rows), **options)


def quality_score(model: dict[str, np.ndarray], text):
    """Column: probability in [0, 1] that the whole text is of quality 1; a null text counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([probability(model, x) for x in map(_bytes, texts)], pa.float64())

    return score(text)


def _bytes(x: pa.Scalar) -> bytes:
    return memoryview(b"") if not x.is_valid else x.as_buffer()


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 2000, text_col: str = "text") -> DataFrame:
    """docs with ``score`` and ``predicted`` (1 from the threshold on).

    Null and empty texts get the score of the empty document; repeated rows get equal scores; an empty table
    gives an empty one; columns of docs named score or predicted are replaced. Without labelled rows the
    untrained network answers. most_rows: labelled rows to learn from, at most.
    """
    model = train(docs, labels, most_rows)
    return docs.withColumn("score", quality_score(model, F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
