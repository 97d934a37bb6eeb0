"""Phrases that occur together more often than their parts suggest, for each language.

Each word is counted once, as the first of the longest window it leads: itself and the words after it in its piece,
padded where the piece ends. A phrase is a prefix of the windows that its places lead, so ROLLUP over a window's
columns gives the counts of all shorter phrases from those of the longest; no n-gram of another length is ever made.

Nearly all windows hold a phrase too rare to be part of any candidate. Before the windows are counted, phrases of two
words, then of three and so on are counted by 40-bit hashes, each size only where its shorter parts are frequent, and
those that occur often enough are put into a Bloom filter. A window is padded behind its longest prefix that may be
frequent. A wrong hit keeps a window longer than needed, a miss cannot happen: no count of a candidate or of its parts
changes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import materialise

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of text that are counted together in a task.
BLOCK = 16 << 20
#: Bits of the Bloom filter, 16 MB: its size is fixed. When frequent phrases are too many for it, it lets more pass.
FILTER_BITS, PROBES, CHUNK = 1 << 27, 3, 1 << 15
#: Bits of a phrase's hash; bytes of text for each slice of hashes that is counted together, and slices at least.
HASH_BITS, SLICE, SLICES = 40, 64 << 20, 64
#: Two levels of partial ranks, so that no task sorts all candidates of a language.
SALTS = 256

KIND = np.zeros(256, np.uint8)
KIND[list(BREAKS)] = 2
KIND[list(BLANKS)] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def parts(text: bytes, most: int) -> Iterator[bytes]:
    """A long text cut at breaks, into parts of about most bytes or, without breaks, longer ones."""
    begin = 0
    while len(text) - begin > most:
        cut = max(text.rfind(BREAKS[k : k + 1], begin, begin + most) for k in range(len(BREAKS)))
        if cut < 0:
            after = [at for k in range(len(BREAKS)) if (at := text.find(BREAKS[k : k + 1], begin + most)) >= 0]
            cut = min(after, default=len(text) - 1)
        yield text[begin : cut + 1]
        begin = cut + 1
    yield text[begin:]


def blocks(batches: Iterable[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[str, bytes]]:
    """(lang, texts of it joined by a break), of about most bytes; when many languages are held, the fullest goes first."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for k, lang in enumerate(langs):
            for part in parts((texts[k].as_py() or "").encode(), most):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 1
                if sum(size.values()) >= most:
                    most_of = max(size, key=size.get)
                    del size[most_of]
                    yield most_of, b"\n".join(held.pop(most_of))
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def tokens(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a block, lower-cased; the number of each place's word; whether a piece ends behind it."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    kind = KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    breaks = np.flatnonzero(kind == 2)
    last = np.ones(len(ends), bool)
    last[:-1] = np.searchsorted(breaks, ends[:-1]) < np.searchsorted(breaks, starts[1:])
    return words.dictionary, words.indices.to_numpy().astype(np.int64), last


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places for each hash, as columns."""
    x = mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
    return np.stack([(low + np.uint64(k) * high) & np.uint64(bits - 1) for k in range(PROBES)], 1).astype(np.int64)


def phrases(lang: str, words: pa.Array, ids: np.ndarray, last: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For m from 2 to size: (hash of the phrase of m words at each place, whether it lies in a piece and both its parts
    of m - 1 words may be frequent). The second array is written to by the caller's filter of size m."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    own = np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words.to_pylist()), np.uint64, len(words))[ids]
    h, ok = own, np.ones(len(ids), bool)
    for m in range(2, size + 1):
        h = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[m - 1 :])
        ok = ok[:-1] & ok[1:] & ~last[m - 2 : max(len(ids) - 1, 0)]
        yield h >> np.uint64(64 - HASH_BITS), ok


def filtered(h: np.ndarray, ok: np.ndarray, likely: np.ndarray) -> None:
    """Take from ok the places whose hash the Bloom filter lacks."""
    at = np.flatnonzero(ok)
    seen, back = np.unique(h[at], return_inverse=True)
    where = bit_places(seen, 8 * len(likely))
    hit = (likely[where >> 3] >> (where & 7).astype(np.uint8) & 1).all(1)
    ok[at] = hit[back]


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending values and counts below 256, as planes of bytes of the differences; zstandard does the rest."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]
    return pa.compress(np.ascontiguousarray(np.concatenate([planes.T, counts.astype(np.uint8)[None]])).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    width = HASH_BITS // 8
    planes = np.frombuffer(pa.decompress(data, n * (width + 1), "zstd", asbytes=True), np.uint8).reshape(width + 1, n)
    steps = sum(planes[k].astype(np.uint64) << np.uint64(8 * k) for k in range(width))
    return np.cumsum(steps, dtype=np.uint64), planes[width].astype(np.int64)


def frequent_phrases(texts: DataFrame, size: int, least: int, slices: int, likely: np.ndarray | None, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter, as bytes, of the phrases of ``size`` words that occur least times or more; likely is that of all
    shorter ones. Hashes are counted in slices of their range, whose number grows with the texts."""
    shared = texts.sparkSession.sparkContext.broadcast(likely)
    part = (1 << HASH_BITS) // slices
    ceiling = min(least, 255)  # that many in one block are enough, and counts add up

    def count(batches):
        for lang, text in blocks(batches):
            words, ids, last = tokens(text)
            for m, (h, ok) in enumerate(phrases(lang, words, ids, last, size), 2):
                if m < size:
                    filtered(h, ok, shared.value)
            seen, n = np.unique(h[ok], return_counts=True)
            cuts = np.searchsorted(seen, np.arange(slices + 1, dtype=np.uint64) * np.uint64(part))
            used = np.flatnonzero(np.diff(cuts))
            rows = [packed(seen[a:z], np.minimum(n[a:z], ceiling)) for a, z in zip(cuts[used], cuts[used + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.diff(cuts)[used].astype(np.int32)), pa.array(rows, pa.binary())], ["slice", "n", "packed"])

    def places(table):
        own = [unpacked(x, n) for x, n in zip(table.column("packed").to_pylist(), table.column("n").to_pylist())]
        seen, back = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
        total = np.bincount(back, np.concatenate([n for _, n in own]))
        at = np.unique(bit_places(seen[total >= ceiling], bits))
        return pa.table([pa.array((at // CHUNK).astype(np.int32)), pa.array((at % CHUNK).astype(np.int32))], ["chunk", "bit"])

    counted = texts.mapInArrow(count, "slice int, n int, packed binary")
    word, one = F.floor(F.col("bit") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    set_bits = counted.groupBy("slice").applyInArrow(places, "chunk int, bit int").groupBy("chunk", word.alias("word")).agg(F.bit_or(one).alias("bits"))
    chunks = set_bits.groupBy("chunk").agg(F.collect_list(F.struct("word", "bits")).alias("words"))  # at most CHUNK / 64 words, and bits / CHUNK chunks
    out = np.zeros(bits // 64, np.int64)
    for row in chunks.toLocalIterator():
        at = np.array([(x.word, x.bits) for x in row.words], np.int64)
        out[row.chunk * (CHUNK // 64) + at[:, 0]] = at[:, 1]
    shared.destroy()
    return out.view(np.uint8) if likely is None else out.view(np.uint8) | likely


def windows(texts: DataFrame, longest: int, likely: np.ndarray) -> DataFrame:
    """(lang, w1 ... w_longest, n): the longest window that each word leads, counted for each block of texts; padded with
    empty strings where the piece ends, or behind the longest prefix that may be frequent."""
    shared = texts.sparkSession.sparkContext.broadcast(likely)
    names = [f"w{k}" for k in range(1, longest + 1)]

    def count(batches):
        for lang, text in blocks(batches):
            words, ids, last = tokens(text)
            pad = len(words)
            lead = [ids]
            for m, (h, ok) in enumerate(phrases(lang, words, ids, last, longest), 2):
                filtered(h, ok, shared.value)
                column = np.full(len(ids), pad, np.int64)
                at = np.flatnonzero(ok)
                column[at] = ids[at + m - 1]
                lead.append(column)
            number = lead[0]
            for column in lead[1:]:  # number the different windows, a column at a time
                _, number = np.unique(number * (pad + 1) + column, return_inverse=True)
            first = np.zeros(number.max() + 1 if len(number) else 0, np.int64)
            first[number] = np.arange(len(number))
            n = np.bincount(number, minlength=len(first))
            padded = pa.concat_arrays([words, pa.array([""], pa.large_string())])
            for k in range(0, len(first), 1 << 17):
                own = first[k : k + (1 << 17)]
                columns = [padded.take(pa.array(column[own])).cast(pa.string()) for column in lead]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), *columns, pa.array(n[k : k + (1 << 17)].astype(np.int64))], ["lang", *names, "n"])

    return texts.mapInArrow(count, f"lang string, {', '.join(f'{x} string' for x in names)}, n long")


def phrase_counts(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, size, phrase, f): of phrases that occur least times or more; size 0 and an empty phrase: all words."""
    names = [f"w{k}" for k in range(1, longest + 1)]
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = 1 << max(SLICES - 1, -(-size // SLICE) - 1).bit_length()
    likely = None
    for m in range(2, longest + 1):
        likely = frequent_phrases(texts, m, least, slices, likely)
    own = windows(texts, longest, likely)
    rolled = own.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))  # a bit of level for each column summed over
    size = F.coalesce(*[F.when(F.col("level") == (1 << (longest - k)) - 1, k) for k in range(longest + 1)])
    rolled = rolled.withColumn("size", size).where("size IS NOT NULL")  # all languages together: not asked
    padded = F.coalesce(*[F.when(F.col("size") == k + 1, F.col(name) == "") for k, name in enumerate(names)], F.lit(False))
    rolled = rolled.where(~padded & ((F.col("size") == 0) | (F.col("f") >= least)))
    return rolled.select("lang", "size", F.concat_ws(" ", *names).alias("phrase"), "f")


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact for counts up to 3 * 10^15."""
    d = lambda x: x.cast("decimal(16,0)")
    above = (d(a) * d(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    below = (d(left) * d(right)).cast("decimal(32,0)")
    return F.call_function("div", above, below)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Pieces end at any of .,;:!? and line ends, words at blanks and tabs; A-Z are lower-cased. Candidates: phrases of 2
    to longest words that occur least times or more, a. A candidate's cut gives l and r, the counts of its two parts,
    and floor(1000000 a a / (l r)); the lowest score counts, ties to the first cut. Candidates whose words lie inside a
    longer candidate with percent of a or more are dropped. n: all words of the language. A null lang counts as
    ``und``, a null or empty text has no words; a row that is repeated counts each time; an empty table gives no rows.
    Ties in the order: score and a descending, then the phrase by its bytes. Other columns are not read.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.col(text_col).alias("text"))
    counts = materialise(phrase_counts(texts, longest, least), "phrases")
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    piece = lambda begin, n: F.array_join(F.slice(words, begin, n), " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda side, name: counts.where("size >= 1").select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cut = cut.join(of("left", "l").hint("merge"), ["lang", "left"]).join(of("right", "r").hint("merge"), ["lang", "right"])
    cut = cut.withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    shorter = candidates.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    shorter = shorter.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inside = shorter.select("lang", piece(F.col("begin"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    best = best.join(inside.hint("merge"), ["lang", "phrase"], "left").where("around IS NULL OR 100 * around < %d * a" % percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    near = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
