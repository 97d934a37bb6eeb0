"""Audit of how filters act together: what each removes, in every order in which they could be applied.

A document fails some of the filters; that is all an order's effect depends on. So documents are counted once, into a
tensor for each part with one axis of (pass, fail) for each filter, and the tensor is contracted: at a step the
filters applied before select "pass" on their axes, the step's own selects "pass" or "fail", the others "all".
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{x} bigint" for x in COUNTS)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(words_of(text)) < least


def few_distinct(text: Column, percent: int = 50) -> Column:
    words = words_of(text)
    return F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(percent).cast("long") * F.size(words)


def many_capitals(text: Column, percent: int = 2) -> Column:
    return F.lit(100).cast("long") * F.length(F.regexp_replace(text, "[^A-Z]", "")) > F.lit(percent).cast("long") * F.length(text)


def has_symbols(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Name and failure condition of each filter on a text alone.
FILTERS = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": has_symbols}
#: Name of the filter that a text fails if a document of smaller id has the same text.
COPIES = "E"


@cache
def steps(names: str) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    """Of all orders: (order, step), the number of the step's filter, and what each step selects: for each of kept,
    removed, failing at all and failing alone an array (step, axis, pass or fail)."""
    n = len(names)
    where, own, picks = [], [], [[], [], [], []]
    for order in permutations(range(n)):
        for k, f in enumerate(order):
            where.append(("".join(names[i] for i in order), k + 1))
            own.append(f)
            before, alone = set(order[:k]), set(range(n)) - {f}
            for kind, (passed, last) in enumerate(((before, PASS), (before, FAIL), (set(), FAIL), (alone, FAIL))):
                picks[kind].append([last if i == f else PASS if i in passed else ALL for i in range(n)])
    return where, np.array(own), np.array(picks, np.int64)


def contract(counts: np.ndarray, names: str) -> tuple[list[tuple[str, int]], np.ndarray]:
    """counts[which, pass or fail of each filter], which: all, good, toxic documents -> COUNTS of each step."""
    where, own, picks = steps(names)
    axes = "abcdefghijklmnop"[: len(names)]
    sums = lambda tensor, pick: np.einsum(f"{axes},{','.join('z' + x for x in axes)}->z", tensor, *np.moveaxis(pick, 1, 0))
    every, good, toxic = counts
    kept, removed, fails, alone = (sums(every, pick) for pick in picks)
    shapley = np.zeros(len(names), np.int64)
    np.add.at(shapley, own, removed)
    return where, np.stack([kept, removed, fails - removed, alone, sums(good, picks[1]), sums(toxic, picks[1]), shapley[own]])


def tensors(docs: DataFrame, labels: DataFrame, filters: dict, copies: str, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents for each part and set of failed filters, bit i for the i-th filter.

    Copies of a text fail the same filters, so the earliest of them is found among counts: the rows of one text that
    meet in a task are one for each part and kind of label, however many copies there are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(f(F.col("text")), 1 << i).otherwise(0) for i, f in enumerate(filters.values())), F.lit(0))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.select("id", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), mask.alias("mask"))
    is_one = lambda x: F.max(F.coalesce((F.col(x) == 1).cast("int"), F.lit(0)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    own = own.join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    kind = ["h1", "h2", "part", "mask", "good", "toxic"]
    each = own.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy(*kind, F.col("id").isNull().alias("unnamed")).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("h1", "h2"))
    fresh = F.when(F.col("unnamed"), F.col("n")).when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    each = each.withColumn("least", least).withColumn("fresh", fresh)
    copy = F.lit(1 << list([*filters, copies]).index(copies))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    cells = each.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict | None = None, copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row for
    each part, order of the filters and step, zeros included.

    filters: name, one letter, to a function from the text's column to its failure condition; at most 8 with the copies'.
    A null text counts as empty, a null part as the empty string. Of rows with one text that of the smallest id is no
    copy; rows that repeat this id are none either, nor are rows with a null id, which have no smaller one. A label
    counts as 1 if any row of the id has it; ids without labels are neither good nor toxic. An empty table gives no
    rows. Other columns of docs and labels are not read, whatever their names.
    """
    filters = FILTERS if filters is None else filters
    names = "".join([*filters, copies])
    if len(names) != len(filters) + 1 or len(set(names)) != len(names) or len(names) > 8:
        raise ValueError("filters need different names of one letter, at most 8 with that of the copies")
    cells = tensors(docs, labels, filters, copies, id_col, text_col, part_col)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^filters cells

    def each_part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.zeros((3, *[2] * len(names)), np.int64)
                for x in row["cells"]:
                    at = tuple(x["mask"] >> i & 1 for i in range(len(names)))
                    counts[(slice(None), *at)] = x["n"], x["good"], x["toxic"]
                where, found = contract(counts, names)
                order, step = zip(*where)
                columns = [pa.array([row["part"]] * len(where), pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32()), *map(pa.array, found)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])

    return by_part.mapInArrow(each_part, RESULT)
