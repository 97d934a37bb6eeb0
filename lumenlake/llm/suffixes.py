"""Removal of long byte strings that occur more than once, by a distributed suffix array over sampled suffixes.

Not every suffix is sorted. Of the tokens (``TOKEN`` bytes) that start in a string of ``length`` bytes the one of least
hash, the leftmost of equals, is its anchor. That depends on the string alone, so equal strings have equal anchors at
equal offsets, and all strings of one anchor are windows of its context, the bytes from the first of them to the end of
the last. An anchor's suffix stands for all of them; there is about one for 85 bytes.

- Suffixes whose leading token no other anchor has are dropped: no string at them can be repeated. Suffixes with equal
  contexts are one row with a count; strings in a context that occurs twice are repeated.
- What is left, different contexts of a shared token, is range-partitioned by the bytes from the anchor on (then those
  before it) at splitters that Spark samples. Contexts differ, so a token that a third of all documents have is split
  over many buckets. Each bucket sorts its windows by multikey quicksort, eight bytes a step, and neighbours that
  agree over the whole length are repeated.
- Windows of the first and the last token of a bucket may have equals across its boundary. Runs of eight windows of a
  context are compared by the bytes that all of them share, and only where two buckets have those the windows
  themselves, all by 128-bit hashes and one row for each different window of a bucket.

Tokens are compared by 64-bit hashes, contexts by those and 64 bits more, texts by 128 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import materialise, shared_dir, spent

#: Bytes of the leading token, bytes of text that are hashed at once, bytes of contexts that a bucket should hold.
TOKEN, PIECE, BUCKET = 32, 1 << 17, 2 << 20
#: Windows that cross a bucket's boundary together.
RUN = 8
POSITION = 22  # bits for a place within a piece; the rest of an anchor's rank is its hash
ODD = np.random.default_rng(7).integers(1 << 62, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BYTES = np.random.default_rng(8).integers(0, 1 << 63, 256).astype(np.uint64)
NAMES = ["h1", "h2"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    return x ^ (x >> np.uint64(29))


def block_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """The hash of each run of so many bytes, by doubling; sizes are powers of two in ascending order."""
    out, h, size, step = [], BYTES[data], 1, 1
    while size <= sizes[-1]:
        if size in sizes:
            out.append(h)
        h = mixed(h[:-size] * ODD[step] + h[size:] * ODD[step + 1])
        size, step = 2 * size, step + 2
    return out


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes the place of the least, the leftmost of equals; at most 2^POSITION hashes."""
    mask = np.uint64((1 << POSITION) - 1)
    rank = hashes & ~mask | np.arange(len(hashes), dtype=np.uint64)
    n = len(rank) - width + 1
    rank = np.append(rank, np.full(-len(rank) % width, np.iinfo(np.uint64).max)).reshape(-1, width)
    before = np.minimum.accumulate(rank, axis=1).ravel()
    after = np.minimum.accumulate(rank[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & mask).astype(np.int64)


def contexts_of(texts: list[bytes], length: int, token: int) -> tuple[np.ndarray, ...]:
    """Of texts together shorter than 2^POSITION: (text, first window, last window, anchor, token hash, context hash)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum([0, *map(len, texts)])
    at, end = begins[:-1], begins[1:] - length + 1  # windows of a text start in [at, end)
    own = end > at
    if not own.any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    block = 1 << (length.bit_length() - 1)
    by_token, by_block = block_hashes(data, tuple(sorted({token, block}))) if token != block else 2 * block_hashes(data, (token,))
    anchor = window_anchors(by_token, length - token + 1)
    valid = np.zeros(len(data) + 1, np.int8)
    valid[at[own]] += 1
    valid[end[own]] -= 1
    start = np.flatnonzero(np.cumsum(valid, dtype=np.int8)[: len(anchor)])
    anchor = anchor[start]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    lo, hi, anchor = start[first], start[np.append(first[1:], len(start)) - 1], anchor[first]
    size = hi - lo + length
    context = size.astype(np.uint64) * ODD[60]
    for k in range(4):  # a context is shorter than four blocks
        context = mixed(context * ODD[61] + by_block[lo + (size - block) * k // 3])
    which = np.searchsorted(begins, lo, side="right") - 1
    return which, lo - begins[which], hi - begins[which], anchor - begins[which], by_token[anchor], context


def cut_texts(rows: Iterable[tuple], length: int, most: int = PIECE) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Groups of texts of about most bytes; a longer text in pieces that overlap so that each window is in one."""
    held, size = [], 0
    for name, text in rows:
        for begin in range(0, max(len(text) - length + 1, 1), most):
            piece = text[begin : begin + most + length - 1]
            if size + len(piece) > most and held:
                yield [x[0] for x in held], [x[1] for x in held]
                held, size = [], 0
            held.append(((*name, begin), piece))
            size += len(piece)
    if held:
        yield [x[0] for x in held], [x[1] for x in held]


def anchored(texts: DataFrame, length: int, token: int) -> DataFrame:
    """texts(h1, h2, text) -> (token, context, h1, h2, lo, hi, at): a row for each anchor. lo, hi: the first and the
    last window that it stands for; at: its own place."""

    def find(batches):
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for who, group in cut_texts(zip(names, batch.column(2).to_pylist()), length):
                which, lo, hi, at, own, context = contexts_of(group, length, token)
                h1, h2, base = (np.array([x[k] for x in who], np.int64)[which] for k in range(3))
                columns = [own.view(np.int64), context.view(np.int64), h1, h2, *((x + base).astype(np.int32) for x in (lo, hi, at))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "context", *NAMES, "lo", "hi", "at"])

    return texts.select(*NAMES, "text").mapInArrow(find, "token long, context long, h1 long, h2 long, lo int, hi int, at int")


def bytes_of(asked: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """asked(h1, h2, lo, hi, at, many) -> (lead, back, h1, h2, lo, many): lead has the bytes of a context from the anchor
    on, then the ``back`` bytes before it from right to left: the order in which suffixes are dealt to buckets."""
    by_text = asked.groupBy(*NAMES).agg(F.collect_list(F.struct("lo", "hi", "at", "many")).alias("asked"))  # as many as a text has anchors

    def read(batches):
        for batch in batches:
            for h1, h2, asked, text in zip(*(batch.column(k) for k in range(4))):
                text, rows = text.as_py(), asked.as_py()
                for k in range(0, len(rows), 4096):
                    own = rows[k : k + 4096]
                    lead = [text[x["at"] : x["hi"] + length] + text[x["lo"] : x["at"]][::-1] for x in own]
                    columns = [pa.array(lead, pa.binary()), pa.array([x["at"] - x["lo"] for x in own], pa.int32()), pa.array([h1.as_py()] * len(own)), pa.array([h2.as_py()] * len(own)), pa.array([x["lo"] for x in own], pa.int32()), pa.array([x["many"] for x in own])]
                    yield pa.RecordBatch.from_arrays(columns, ["lead", "back", *NAMES, "lo", "many"])

    both = by_text.join(texts.select(*NAMES, "text"), NAMES).select(*NAMES, "asked", "text")
    return both.mapInArrow(read, "lead binary, back int, h1 long, h2 long, lo int, many boolean")


def words_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as numbers that sort like the bytes."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[places].view(">u8").ravel()


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, classes): those of the strings data[start : start + length] that have an equal, in order, by class.

    All classes of strings that agree so far are parted together, by their next eight bytes; a class whose strings all
    agree in them is passed on as it is, a string alone in its class is done.
    """
    places = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for depth in (*range(0, length - 8, 8), length - 8):
        if not len(places):
            break
        word = words_at(data, starts[places] + depth)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        apart = np.logical_or.reduceat(word != word[first][group], first)[group]  # groups are numbered from 0 in order
        if not apart.any():
            continue
        sort = np.flatnonzero(apart)
        order = sort[np.lexsort((word[sort], group[sort]))]
        word[sort], places[sort] = word[order], places[order]
        new = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        places, group = places[tied], group[tied]
        group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1 if len(group) else group
    return places, group


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.full(len(starts), ODD[40]), np.full(len(starts), ODD[41])
    for depth in (*range(0, length - 8, 8), length - 8):
        word = words_at(data, starts + depth).astype(np.uint64)
        a, b = mixed(a * ODD[42] + word), mixed((b ^ word) * ODD[43])
    return a.view(np.int64), b.view(np.int64)


FOUND = "h1 long, h2 long, begin int, end int, core1 long, core2 long, windows array<struct<begin: int, a: bigint, b: bigint>>"
OPEN = pa.list_(pa.struct([("begin", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))


def compare_bucket(rows: pa.Table, length: int, token: int) -> Iterator[pa.RecordBatch]:
    """FOUND of a bucket: spans of repeated bytes; and, of each run of windows that may have equals in another bucket, a
    hash of the bytes that all of them share, and of each window its hash, with begin -1 if it needs no answer."""
    names = [*NAMES, "begin", "end", "core1", "core2", "windows"]
    leads, back, many = rows.column("lead").to_pylist(), rows.column("back").to_numpy(), rows.column("many").to_numpy()
    h1, h2, lo = (rows.column(x).to_numpy() for x in (*NAMES, "lo"))
    data = np.frombuffer(b"".join(x[len(x) - n :][::-1] + x[: len(x) - n] for x, n in zip(leads, back)), np.uint8)
    sizes = np.fromiter(map(len, leads), np.int64, len(leads))
    windows = sizes - length + 1
    row = np.repeat(np.arange(len(leads)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    context = np.cumsum(sizes) - sizes
    starts = context[row] + offset
    places, group = multikey_quicksort(data, starts, length)
    repeated = many[row]
    repeated[places] = True
    at = np.flatnonzero(repeated)
    if len(at):
        first = np.flatnonzero(np.append(True, (row[at][1:] != row[at][:-1]) | (offset[at][1:] != offset[at][:-1] + 1)))
        a, z = at[first], at[np.append(first[1:], len(at)) - 1]
        who, none = row[a], pa.nulls(len(a), pa.int64())
        spans = [h1[who], h2[who], (lo[who] + offset[a]).astype(np.int32), (lo[who] + offset[z] + length).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, spans), none, none, pa.nulls(len(a), OPEN)], names)
    heads = [x[:token] for x in leads]
    edges = {min(heads), max(heads)}
    edge = np.fromiter((x in edges for x in heads), bool, len(heads))[row]
    spare = np.zeros(len(row), bool)  # of equal windows one is enough
    spare[places[np.flatnonzero(group[1:] == group[:-1]) + 1]] = True
    run = min(RUN, length - 7)
    number = (back[row] - offset) // run  # counted from the anchor, so that equal windows are in equal runs
    open_at = np.flatnonzero(edge & ~spare)
    for part in np.split(open_at, np.flatnonzero(np.diff(row[open_at] >> 10)) + 1):
        if not len(part):
            continue
        who = row[part]
        first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (np.diff(number[part]) != 0)))
        a, b = window_hashes(data, starts[part], length)
        begin = np.where(repeated[part], -1, lo[who] + offset[part]).astype(np.int32)
        held = pa.StructArray.from_arrays([pa.array(begin), pa.array(a), pa.array(b)], ["begin", "a", "b"])
        own = who[first]
        core = window_hashes(data, context[own] + back[own] - run * number[part[first]], length - run + 1)
        none = pa.nulls(len(own), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(part)).astype(np.int32)), held)
        yield pa.RecordBatch.from_arrays([pa.array(h1[own]), pa.array(h2[own]), none, none, *map(pa.array, core), lists], names)


def sorted_spans(contexts: DataFrame, length: int, token: int) -> tuple[DataFrame, DataFrame]:
    """(spans, scratch table): (h1, h2, begin, end) of the windows of different contexts that are repeated."""
    size = contexts.agg(F.coalesce(F.sum(F.octet_length("lead")), F.lit(0))).first()[0]
    dealt = contexts.repartitionByRange(max(1, -(-size // BUCKET)), "lead")

    def compare(batches):
        bucket = pa.Table.from_batches(batches, schema=pa.schema([("lead", pa.binary()), ("back", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("lo", pa.int32()), ("many", pa.bool_())]))
        if bucket.num_rows:
            yield from compare_bucket(bucket, length, token)

    found = materialise(dealt.mapInArrow(compare, FOUND).withColumn("bucket", F.spark_partition_id()), "suffix-buckets")
    runs = found.where("core1 IS NOT NULL")
    shared = runs.groupBy("core1", "core2").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).where("low < high")
    hashed = runs.join(shared, ["core1", "core2"]).select(*NAMES, F.explode("windows").alias("x")).select(*NAMES, "x.*")
    twice = hashed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    across = hashed.where("begin >= 0").join(twice, ["a", "b"]).select(*NAMES, "begin", (F.col("begin") + length).alias("end"))
    return found.where("core1 IS NULL").select(*NAMES, "begin", "end").union(across), found


def kept_bytes(texts: DataFrame, spans: DataFrame, length: int, with_kept: bool) -> DataFrame:
    """(h1, h2, n_bytes, n_removed, spans, kept_sha256[, kept]) of each different text; a text of two documents goes whole."""
    by_text = spans.groupBy(*NAMES).agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    names = [*NAMES, "n_bytes", "n_removed", "begins", "ends", "kept_sha256", *["kept"] * with_kept]

    def cut(batches):
        for batch in batches:
            rows = []
            for h1, h2, n, text, found in zip(*(batch.column(k) for k in range(5))):
                text, runs = text.as_py(), []
                if n.as_py() > 1 and len(text) >= length:
                    runs = [[0, len(text)]]
                else:
                    for x in sorted((x["begin"], x["end"]) for x in found.as_py() or ()):
                        if runs and x[0] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], x[1])
                        else:
                            runs.append([*x])
                edges = [0, *(y for x in runs for y in x), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2])) if runs else text
                rows.append((h1.as_py(), h2.as_py(), len(text), len(text) - len(kept), [x[0] for x in runs], [x[1] for x in runs], hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    both = texts.join(by_text, NAMES, "left").select(*NAMES, "n", "text", "found")
    kinds = "h1 long, h2 long, n_bytes long, n_removed long, begins array<long>, ends array<long>, kept_sha256 string"
    return both.mapInArrow(cut, kinds + ", kept binary" * with_kept)


def dedup_substrings(docs: DataFrame, length: int = 200, token: int = TOKEN, text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """docs, and of each row n_bytes, n_removed, spans (begin, end of each maximal removed run of bytes), kept_sha256 and
    kept, the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or another;
    strings are judged on the texts as given and never cross them. A null text counts as empty; texts shorter than length
    stay whole; rows that repeat a text of that length lose all of it, each of them. Cuts may fall within a character,
    so kept is binary. token: a power of two, at most length; length: 8 at least. Other columns stay, whatever their
    names; columns of docs named like an added one are replaced. The texts are read as one row each, as long as they are.
    """
    if token > length or token & (token - 1) or length < 8:
        raise ValueError("token must be a power of two, at most length, and length 8 at least")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    whole = docs.select(*names, text.cast("binary").alias("text"))
    whole = whole.groupBy(*NAMES).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    # bucketed by name: what is joined to the texts below is shuffled, they are not
    table, path = f"suffix_texts_{uuid.uuid4().hex}", f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole.write.bucketBy(buckets, *NAMES).option("path", path).saveAsTable(table)
    texts = spark.read.table(table)
    texts.scratch_path = path

    own = anchored(texts, length, token)
    tokens = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1")
    # written, so that the join reads two plain exchanges and the anchors of a frequent token can be split over tasks
    tokens = materialise(tokens.select("token", (F.col("least") != F.col("most")).alias("differ")), "suffix-tokens")
    shared = materialise(own.join(tokens.hint("merge"), "token"), "suffixes")
    differ = shared.where("differ")
    each = differ.groupBy("token", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*NAMES, "lo", "hi", "at")).alias("x"))
    each = materialise(each.select("token", "context", (F.col("n") > 1).alias("many"), "x.*"), "suffix-classes")
    contexts = materialise(bytes_of(each, texts, length), "suffix-contexts")
    again = differ.join(each.where("many").select("token", "context").hint("merge"), ["token", "context"])
    equal = shared.where("NOT differ").select(*NAMES, "lo", "hi").union(again.select(*NAMES, "lo", "hi"))
    equal = equal.select(*NAMES, F.col("lo").alias("begin"), (F.col("hi") + length).alias("end"))
    spans, buckets = sorted_spans(contexts, length, token)
    found = materialise(kept_bytes(texts, equal.union(spans), length, with_kept), "suffix-kept")
    spark.sql(f"DROP TABLE {table}")
    spent(texts, tokens, shared, each, contexts, buckets)

    added = ["n_bytes", "n_removed", "spans", "kept_sha256", *["kept"] * with_kept]
    spans = F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end"))
    found = found.withColumn("spans", spans).select(*NAMES, F.struct(*added).alias("found"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)
    out = rows.join(found.hint("merge"), NAMES)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *[f"found.{c}" for c in added])
