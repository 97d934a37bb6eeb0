"""Byte-level BPE encoding and decoding by chunks that overlap.

A long document is cut into chunks that overlap, which tasks share; each is pre-tokenised on its own; where two
neighbours agree on the end of a pre-token, the first hands over to the second, because the pattern looks at nothing
before a pre-token's start. The pieces so found are merged by rank, all new ones of a block at once. Decoding puts the
tokens' raw bytes behind one another.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import materialise

#: A pre-token's end is certain only if the pattern could see so many characters behind it ('re, 've, 'll).
LOOK = 3
NONE = np.int64(1) << 40


class RegexSplitter:
    """Ends of the pre-tokens of a text under any pattern that looks at nothing before a pre-token's start."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern)

    def ends(self, text: str) -> np.ndarray:
        return np.cumsum([len(x) for x in self.find.findall(text)], dtype=np.int64)


#: The pattern that ClassSplitter stands for.
CLASS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0


class ClassSplitter:
    """The ends under CLASS_PATTERN from the class of each character, without a call for each pre-token.

    A pre-token is a run of one class; a space before a run of letters, numbers or others joins it; of white
    space before such a run, all but the last character stands alone; a contraction takes its letters from the
    run behind the apostrophe.
    """

    def __init__(self):
        self.kind = np.zeros(0x110000, np.int8)
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
            found = "".join(regex.findall(pattern, every))
            self.kind[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind

    def ends(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        n = len(code)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[code]
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        stops = np.append(starts[1:], n)
        blank = kind[starts] == BLANK
        cut = starts[~blank & (starts > 0)]  # where a run of another class begins
        after_blank = kind[cut - 1] == BLANK
        spaced = after_blank & (code[cut - 1] == 32)
        pieces = [cut[~spaced], cut[spaced] - 1]  # a space goes with the run
        whole = blank & (stops < n) & (stops - starts > 1)  # white space but for its last character
        pieces += [starts[blank & (starts > 0)], stops[whole] - 1, [n]]
        quote = starts[(kind[starts] == OTHER) & (stops - starts == 1) & (code[starts] == 39)]
        quote = quote[quote + 1 < n]
        quote = quote[(quote == 0) | (code[quote - 1] != 32)]
        drop = []
        if len(quote):
            one = code[quote + 1]
            two = np.where(quote + 2 < n, code[np.minimum(quote + 2, n - 1)], 0)
            single = np.isin(one, [115, 116, 109, 100])  # s t m d
            double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            hit = single | double
            drop = quote[hit] + 1
            pieces.append(np.where(single, quote + 2, quote + 3)[hit])
        marks = np.zeros(n + 1, bool)
        for x in pieces:
            marks[x] = True
        marks[drop] = False
        marks[0] = False
        return np.flatnonzero(marks)


class Ranks:
    """A rank file and what is derived from it. Pieces already encoded are kept, at most ``most_kept`` of them."""

    def __init__(self, path: str, pattern: str, most_kept: int = 100_000):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {v: k for k, v in self.rank.items()}
        self.splitter = ClassSplitter() if pattern == CLASS_PATTERN else RegexSplitter(pattern)
        self.kept: dict[str, bytes] = {}
        self.most_kept = most_kept
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        top = max(self.token) + 1
        self.sizes = np.array([len(self.token.get(i, b"")) for i in range(top)], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(top)), np.uint8)
        self.shift = max(self.rank.values()).bit_length()
        pairs = {}
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << self.shift) | b] = r
        size = 1 << (4 * len(pairs)).bit_length()
        self.mask = size - 1
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.slot_key, self.slot_value = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        at, self.probes = self._slot(keys), 1
        while len(keys):  # open addressing, one round of probes at a time
            free = self.slot_key[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.slot_key[at[first]], self.slot_value[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask
            self.probes += bool(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B1)) >> np.int64(15)) & self.mask

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into, NONE if there is none."""
        keys = (a << self.shift) | b
        at = self._slot(keys)
        out = np.where(self.slot_key[at] == keys, self.slot_value[at], NONE)
        open_ = np.flatnonzero((self.slot_key[at] != keys) & (self.slot_key[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            hit = self.slot_key[at[open_]] == keys[open_]
            out[open_[hit]] = self.slot_value[at[open_[hit]]]
            open_ = open_[~hit & (self.slot_key[at[open_]] >= 0)]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: the lowest-ranked pair merges first, the leftmost of equals, until none merges."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[i] = np.array([r], "<u4")
            elif len(p) > 48:
                out[i] = np.array(self.merge_long(p), "<u4")
            else:
                by_length.setdefault(len(p), []).append(i)
        for n, which in by_length.items():
            ids = self.byte[np.frombuffer(b"".join(pieces[i] for i in which), np.uint8).reshape(-1, n)]
            ranks = self.of_pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, n - 1)
            which = np.array(which)
            while len(which):
                best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(which), np.intp)
                low = ranks[np.arange(len(which)), best] if ranks.shape[1] else np.full(len(which), NONE)
                done = low >= NONE
                if done.any():
                    rows = ids[done].astype("<u4")
                    for i, row in zip(which[done].tolist(), rows):
                        out[i] = row
                    go = ~done
                    which, ids, ranks, best, low = which[go], ids[go], ranks[go], best[go], low[go]
                    if not len(which):
                        break
                row, col = np.arange(len(which)), best
                ids[row, col] = low
                k = np.arange(ids.shape[1] - 1)
                ids = ids[row[:, None], k + (k > col[:, None])]
                k = np.arange(ranks.shape[1] - 1)
                ranks = ranks[row[:, None], k + (k >= col[:, None])]
                left = np.flatnonzero(col > 0)
                ranks[left, col[left] - 1] = self.of_pairs(ids[left, col[left] - 1], ids[left, col[left]])
                right = np.flatnonzero(col < ranks.shape[1])
                ranks[right, col[right]] = self.of_pairs(ids[right, col[right]], ids[right, col[right] + 1])
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece, with a heap over a linked list: n log n."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, rank, token = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank, self.token
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(self.of_pairs(np.array(ids[:-1]), np.array(ids[1:])).tolist()) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if i < n else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := rank.get(token[ids[x]] + token[ids[y]])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_block(self, found: list[list[str]]) -> list[bytes]:
        """Ids of each list of pieces as little-endian 32-bit integers; all new pieces are merged together."""
        out = []
        if len(self.kept) > self.most_kept:
            self.kept.clear()
        got = [list(map(self.kept.get, pieces)) for pieces in found]
        new = list({p for pieces, ids in zip(found, got) for p, x in zip(pieces, ids) if x is None})
        for p, ids in zip(new, self.merge_many([p.encode() for p in new])):
            self.kept[p] = ids.tobytes()
        for pieces, ids in zip(found, got):
            out.append(b"".join(self.kept[p] if x is None else x for p, x in zip(pieces, ids)) if None in ids else b"".join(ids))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of the tokens behind one another."""
        own = np.frombuffer(ids, "<u4")
        sizes = self.sizes[own]
        ends = np.cumsum(sizes)
        return self.raw[np.repeat(self.places[own] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def certain(splitter, text: str, start: int, end: int) -> np.ndarray:
    """Ends of the pre-tokens of text[start:end], from start on, that no text behind end can change."""
    ends = splitter.ends(text[start:end]) + start
    return ends if end >= len(text) else ends[ends <= end - LOOK]


def pretoken_ends(splitter, text: str, chunk: int = 1 << 16, overlap: int = 256) -> np.ndarray:
    """Ends of all pre-tokens of text, found by chunks and stitched where the chunks' boundaries meet.

    Chunk k covers [k * chunk, (k + 1) * chunk + overlap) and is split on its own. From the first boundary in
    the overlap that both chunks have, the later chunk is right, since a pre-token depends on nothing before
    its start. Where a pre-token is longer than the overlap and no boundary meets, the text from the last
    certain boundary on is split in windows that double.
    """
    if len(text) <= chunk + overlap:
        return splitter.ends(text)
    parts = [certain(splitter, text, k, min(len(text), k + chunk + overlap)) for k in range(0, len(text), chunk)]
    out, at = [], 0  # all before at is settled
    for k, ends in enumerate(parts):
        start, stop = k * chunk, min(len(text), (k + 1) * chunk + overlap)
        if at >= stop or len(ends) and ends[-1] <= at:
            continue
        shared = [start] if at == start else np.intersect1d(out[-1], ends)[:1] if out else []
        if len(shared):
            if out:
                out[-1] = out[-1][out[-1] <= shared[0]]
            ends = ends[ends > shared[0]]
        else:
            width, ends = chunk + overlap, np.zeros(0, np.int64)
            while not len(ends):
                ends = certain(splitter, text, at, min(len(text), at + width))
                width *= 2
        if len(ends):
            out.append(ends)
            at = int(ends[-1])
    while at < len(text):
        ends = certain(splitter, text, at, len(text))
        out.append(ends)
        at = int(ends[-1])
    return np.concatenate(out)


def pretokenise(splitter, text: str, chunk: int = 1 << 16, overlap: int = 256) -> list[str]:
    ends = pretoken_ends(splitter, text, chunk, overlap).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


_loaded: dict[tuple, Ranks] = {}


def ranks_of(path: str, pattern: str) -> Ranks:
    """Loaded once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks(path, pattern)
    return _loaded[path, pattern]


RESULT = "struct<ids:binary, n_tokens:bigint, ids_sha256:string, decoded_sha256:string>"
NAMES = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]


def _results(ranks: Ranks, ids: list[bytes], with_ids: bool) -> list[pa.Array]:
    """The columns of RESULT."""
    n, first = [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids]
    second = [hashlib.sha256(ranks.decode(x)).hexdigest() for x in ids]
    return [pa.array(ids if with_ids else [None] * len(ids), pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]


def _blocks(texts: pa.Array, most: int):
    """Neighbouring texts of about most characters together; a null counts as empty."""
    block, size = [], 0
    for x in texts:
        block.append(x.as_py() or "")
        size += len(block[-1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def bpe_encoded(text: Column, path: str, pattern: str, chunk: int = 1 << 16, overlap: int = 256, with_ids: bool = True) -> Column:
    """Struct column: ids (little-endian unsigned 32-bit), n_tokens, ids_sha256 and, after decoding the ids,
    decoded_sha256. Without with_ids, ids is null. path: a tiktoken rank file that every executor can read. All chunks of
    a text are read in one task; encode_documents deals those of long texts to many."""

    @F.arrow_udf(RESULT)
    def encode(texts: pa.Array) -> pa.Array:
        ranks = ranks_of(path, pattern)
        own = [x for block in _blocks(texts, 1 << 20) for x in ranks.encode_block([pretokenise(ranks.splitter, t, chunk, overlap) for t in block])]
        return pa.StructArray.from_arrays(_results(ranks, own, with_ids), NAMES)

    return encode(text)


def chunk_rows(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """texts(id, text) as (id, k, last, part): chunk k with the overlap behind it."""

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for k in range(0, len(text), chunk):
                    row = {"id": [key], "k": pa.array([k // chunk], pa.int32()), "last": [k + chunk >= len(text)], "part": [text[k : k + chunk + overlap]]}
                    yield pa.RecordBatch.from_pydict(row)

    return texts.mapInArrow(cut, "id long, k int, last boolean, part string")


def stitched(parts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """chunk_rows(...) with start and end, places in the part between which its pieces lie: the first boundaries that
    it shares with its neighbours in the overlaps, null where there is none. Only boundaries in overlaps are sorted by
    document."""

    @F.arrow_udf("struct<head:array<int>, tail:array<int>>")
    def edges(part: pa.Array, last: pa.Array) -> pa.Array:
        splitter, heads, tails = ranks_of(path, pattern).splitter, [], []
        for text, end in zip(part.to_pylist(), last.to_pylist()):
            ends = splitter.ends(text)
            ends = ends if end else ends[ends <= len(text) - LOOK]
            heads.append(ends[ends < overlap].astype(np.int32))
            tails.append(ends[(ends >= chunk) & (ends < chunk + overlap)].astype(np.int32) - chunk)
        return pa.StructArray.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)], ["head", "tail"])

    own = parts.select("id", "k", "last", edges("part", "last").alias("e")).select("id", "k", "last", "e.*")
    by_doc = Window.partitionBy("id").orderBy("k")
    shared = F.array_min(F.array_intersect("tail", F.lead("head").over(by_doc)))
    own = own.withColumn("shared", shared)
    start = F.when(F.col("k") == 0, 0).otherwise(F.lag("shared").over(by_doc))
    own = own.select("id", "k", start.alias("start"), F.when(~F.col("last"), F.col("shared") + chunk).alias("end"), (F.col("last") | F.col("shared").isNotNull()).alias("joined"))
    return parts.join(own, ["id", "k"])


def encode_long(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int, with_ids: bool) -> DataFrame:
    """texts(id, text) as (id, x), x as bpe_encoded gives it, chunks of one text in many tasks. A text with a pre-token
    longer than an overlap, where two chunks share no boundary, is read in one task instead."""
    parts = materialise(stitched(materialise(chunk_rows(texts, chunk, overlap), "chunks").repartition("id", "k"), path, pattern, chunk, overlap), "stitched")
    apart = materialise(parts.where("NOT joined").select("id").distinct(), "apart")

    @F.arrow_udf("binary")
    def encode(part: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        ranks, pieces = ranks_of(path, pattern), []
        for text, a, b in zip(part.to_pylist(), start.to_pylist(), end.to_pylist()):
            ends = ranks.splitter.ends(text[a:]) + a
            ends = ends[ends <= (len(text) if b is None else b)].tolist()
            pieces.append([text[i:j] for i, j in zip([a, *ends], ends)])
        return pa.array(ranks.encode_block(pieces), pa.binary())

    def whole(table: pa.Table) -> pa.Table:
        ranks = ranks_of(path, pattern)
        own = b"".join(table.sort_by("k").column("ids").to_pylist())
        return pa.table({"id": table.column("id").slice(0, 1), "x": pa.StructArray.from_arrays(_results(ranks, [own], with_ids), NAMES)})

    good = parts.join(apart, "id", "left_anti").select("id", "k", encode("part", "start", "end").alias("ids"))
    good = good.groupBy("id").applyInArrow(whole, f"id long, x {RESULT}")
    return good.union(texts.join(apart, "id", "left_semi").select("id", bpe_encoded(F.col("text"), path, pattern, chunk, overlap, with_ids)))


def bpe_decoded(ids: Column, path: str, pattern: str) -> Column:
    """Binary column: the tokens' raw bytes behind one another. Null ids give null."""

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        ranks = ranks_of(path, pattern)
        return pa.array([None if x is None else ranks.decode(x) for x in column.to_pylist()], pa.binary())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = True, chunk: int = 1 << 16, overlap: int = 256) -> DataFrame:
    """docs with ids, n_tokens, ids_sha256 and decoded_sha256; columns of these names are replaced.

    A null or empty text has no ids. Repeated rows give equal rows. An empty table gives an empty one. Every
    text is encoded whole, whatever its length: those of more than a chunk of characters by chunks in many tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    is_long = F.length(text) > chunk + overlap
    short = docs.where(~is_long).select(F.struct("*").alias("row"), bpe_encoded(text, path, pattern, chunk, overlap, with_ids).alias("x"))
    large = materialise(docs.where(is_long).select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")), "long")
    long = encode_long(large.select("id", F.col(f"row.{text_col}").alias("text")), path, pattern, chunk, overlap, with_ids)
    both = short.union(large.join(long, "id").select("row", "x"))
    names = NAMES if with_ids else NAMES[1:]
    row = F.col("row")
    for x in names:
        row = row.withField(x, F.col(f"x.{x}"))
    return both.select(row.alias("row")).select("row.*")
