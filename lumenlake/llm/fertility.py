"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures each whole text: characters per token, the share of tokens that
are fallback bytes, and the entropy of its tokens; a byte-level one measures its characters per token too. Bands for each
language (or, where none is given, for each script) come from the medians and spreads over all documents; a text outside
a band is rejected. Base rules count words, symbols, repeated lines and repeated three-word windows.
"""

from __future__ import annotations

import base64
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.arrays import as_bytes
from lumenlake.llm.common import materialise

SYMBOLS = b"#*$%&|<>"
MEASURES = "struct<n_words:bigint, word_chars:bigint, n_symbols:bigint, n_dup_lines:bigint, n_repeat_words:bigint, chars_per_token:double, fallback_share:double, entropy:double, chars_per_byte_token:double, script:string>"
#: Measures with bands; the number of half-spreads to their ends, and the least distance of an end from the median.
BANDS = {"chars_per_token": (10.0, 0.6), "chars_per_byte_token": (10.0, 0.6), "fallback_share": (10.0, 0.02), "entropy_rate": (10.0, 0.06)}
#: Lower ends of their own: junk breaks into more tokens than clean text, and repeats them.
LOWER = {"chars_per_token": (5.0, 0.1), "chars_per_byte_token": (6.0, 0.12), "entropy_rate": (3.8, 0.06)}

#: Scripts told apart where a row names no language.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai")


class Vocabulary:
    """A sentencepiece model; ids of each word are kept, at most most_kept of them. No piece spans a blank, so a
    text's tokens are those of its words."""

    def __init__(self, path: str, most_kept: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.fallback = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(size)])
        self.kept: dict[bytes, bytes] = {}
        self.most_kept = most_kept

    def encode(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.kept) > self.most_kept:
            self.kept.clear()
        got = [list(map(self.kept.get, words)) for words in texts]
        new = list({w for words, ids in zip(texts, got) for w, x in zip(words, ids) if x is None})
        for w, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1) if new else []):
            self.kept[w] = np.array(ids, "<i4").tobytes()
        return [np.frombuffer(b"".join(self.kept[w] if x is None else x for w, x in zip(words, ids)), "<i4") for words, ids in zip(texts, got)]


class ByteVocabulary:
    """A byte-level rank file: the number of tokens of a word behind a blank; those of most_kept words are kept."""

    def __init__(self, path: str, pattern: str, most_kept: int = 200_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[bytes, int] = {}
        self.most_kept = most_kept

    def count(self, words: list[bytes]) -> int:
        if len(self.kept) > self.most_kept:
            self.kept.clear()
        found = list(map(self.kept.get, words))
        if None in found:
            for w in {w for w, n in zip(words, found) if n is None}:
                self.kept[w] = len(self.encoding.encode_ordinary(" " + w.decode()))
            found = map(self.kept.__getitem__, words)
        return sum(found)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first find included."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = own[:-1] * len(number) + own[1:]
    _, pair = np.unique(pair, return_inverse=True)
    _, which, count = np.unique(pair[:-1] * len(number) + own[2:], return_inverse=True, return_counts=True)
    hit = count[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : n + k] |= hit
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


_SCRIPT = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]
_ASCII = bytes(range(128))
_NOT_LETTER = bytes(x for x in range(256) if not chr(x).isalpha() or x >= 128)


def script_of(data: bytes) -> str:
    """The script of most characters; ASCII letters count as Latin, ties go to the first in SCRIPTS."""
    rest = data.translate(None, _ASCII).decode()
    if not rest:
        return "Latin"
    plain = len(data.translate(None, _NOT_LETTER))
    sizes = [len(p.findall(rest)) + (plain if s == "Latin" else 0) for s, p in _SCRIPT]
    return SCRIPTS[int(np.argmax(sizes))] if max(sizes) else "other"


_loaded: dict = {}


def fertility_measures(text: Column, vocabulary: str, byte_vocabulary: str, pattern: str) -> Column:
    """Struct column of the measures; a null text has no words. The vocabularies: files that every executor can read."""

    @F.arrow_udf(MEASURES)
    def measure(texts: pa.Array) -> pa.Array:
        if vocabulary not in _loaded:  # once in each Python worker
            _loaded[vocabulary] = Vocabulary(vocabulary)
        if (byte_vocabulary, pattern) not in _loaded:
            _loaded[byte_vocabulary, pattern] = ByteVocabulary(byte_vocabulary, pattern)
        vocab, plain = _loaded[vocabulary], _loaded[byte_vocabulary, pattern]
        rows = []
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and size < 1 << 22:
                block.append(as_bytes(texts[at : at + 1])[0])
                size += len(block[-1])
                at += 1
            split = [x.split() for x in block]
            for data, words, ids in zip(block, split, vocab.encode(split)):
                chars = sum(map(len, words)) - len(data.translate(None, _NOT_CONTINUED))
                _, counts = np.unique(ids, return_counts=True)
                p = counts / max(1, len(ids))
                rows.append(
                    (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), repeated_lines(data), repeated_words(words))
                    + ((chars / len(ids), float(vocab.fallback[ids].mean()), float(-(p * np.log2(p)).sum())) if len(ids) else (None, None, None))
                    + (chars / n if (n := plain.count(words)) else None, script_of(data))
                )
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_per_token", "fallback_share", "entropy", "chars_per_byte_token", "script"]
        kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.string()]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else repeat([], 10), kinds)], names)

    return measure(text)


#: All bytes but those that continue a UTF-8 character.
_NOT_CONTINUED = bytes(x for x in range(256) if not 0x80 <= x < 0xC0)


def bands(measured: DataFrame, ends: dict, lower: dict) -> DataFrame:
    """For each group the lower and upper ends of its bands: the median and so many half-spreads (half the distance of
    the quartiles) from it, but no nearer than the least distance; lower ends by ``lower`` where it has the measure.
    Texts that fail a base rule do not count. One row for each language, so the result is small; the percentiles are
    Spark's mergeable sketches over all rows."""
    sound = measured.where("NOT base_failed")
    middle = sound.groupBy("band_group").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in ends])
    wide = lambda x, w, m: F.greatest((F.col(x)[2] - F.col(x)[0]) / 2 * F.lit(w), F.lit(m))
    each = ((F.col(x)[1] - wide(x, *lower.get(x, end)), F.col(x)[1] + wide(x, *end)) for x, end in ends.items())
    return middle.select("band_group", *chain.from_iterable((a.alias(f"{x}_low"), b.alias(f"{x}_high")) for x, (a, b) in zip(ends, each)))


def fertility_rules(docs: DataFrame, vocabulary: str, byte_vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50, most_repeated: int = 50, ends: dict = BANDS, lower: dict = LOWER) -> DataFrame:
    """One row for each document: the measures, ``base_failed``, ``kept`` and ``reason``.

    Base rules: fewer than least_words words, or over most_repeated in 100 words in repeated windows. The
    method's bands: characters per token of both vocabularies, share of fallback bytes, and entropy over the logarithm
    of the text's number of tokens (``entropy_rate``, which hardly depends on length), each with ends from all documents
    of the row's language, or of its script where the language is null. reason: ``base``, or the first measure outside
    its band. Null and empty texts fail the base rule; repeated rows get equal verdicts; other columns of docs are left
    out, whatever their names.
    """
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).alias("doc_id"), lang.alias("_lang"), fertility_measures(F.col(text_col), vocabulary, byte_vocabulary, pattern).alias("_m"))
    own = own.select("doc_id", "_lang", "_m.*")
    tokens = F.col("word_chars") / F.col("chars_per_token")
    own = own.withColumn("band_group", F.coalesce(F.concat(F.lit("lang:"), "_lang"), F.concat(F.lit("script:"), "script")))
    own = own.withColumn("entropy_rate", F.col("entropy") / F.log2(tokens + 1)).drop("_lang")
    own = own.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    own = materialise(own, "fertility")
    names = list(ends)
    found = materialise(bands(own, ends, lower), "bands")
    side = F.broadcast(found) if found.count() <= 10_000 else found  # one row for each language
    joined = own.join(side, "band_group", "left")
    outside = [F.when(~F.col(x).between(F.col(f"{x}_low"), F.col(f"{x}_high")), F.lit(x)) for x in names]
    reason = F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce(*outside))
    return joined.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop(*[f"{x}_{e}" for x in names for e in ("low", "high")])
