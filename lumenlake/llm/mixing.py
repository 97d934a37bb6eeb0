"""Mixing sources to target weights along a curriculum.

Each source has a weight that varies over training, linear from a start to an end value. Its integral is the
source's demand for words up to a time; a document's place in its source's stream of words, passes repeated,
is turned into a time by inverting that demand, and the documents are sorted by that time, by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import WORD, materialise, running_total

WEIGHTS = (5.0, 2.0, 1.0)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """sources(_source, source_size) with weight and target.

    Sources by code point, null last, weigh ``weights``, repeating. A target is the source's share of all
    sizes, at most ``most`` times its source's size; what is over is shared again by weight. With all
    sources sorted by size / weight, those that reach their most come first: source k is capped if, with the
    capped ones before it taken out, its share is still above its most. One row for each source, so the
    windows over all of them are small.
    """
    n = len(weights)
    by_name = Window.orderBy("_source")
    rank = F.pmod(F.row_number().over(by_name) - 1, F.lit(n))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    own = sources.withColumn("weight", weight).withColumn("_most", F.col("source_size") * float(most))
    by_need = Window.orderBy(F.col("_most") / F.col("weight"), "_source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    zero = F.lit(0.0)
    left_size = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_most").over(before), zero)
    left_weight = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("_share", left_size / left_weight)  # words for one unit of weight, if the ones before are capped
    own = own.withColumn("_capped", F.col("_share") * F.col("weight") > F.col("_most"))
    level = F.min(F.when(~F.col("_capped"), F.struct((F.col("_most") / F.col("weight")).alias("k"), F.col("_source").alias("s"), F.col("_share").alias("share")))).over(all_rows)["share"]
    return own.withColumn("target", F.when(F.col("_capped"), F.col("_most")).otherwise(level * F.col("weight"))).drop("_share", "_capped", "_most")


def time_of(demand: Column, slope: Column) -> Column:
    """The time in [0, 1] at which a source has given the share ``demand`` of its words, if its weight runs
    linearly from 1 - slope to 1 + slope of its mean: the inverse of t -> (1 - slope) t + slope t^2."""
    straight = F.abs(slope) < 1e-12
    root = F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * demand, F.lit(0.0)))
    return F.when(straight, demand).otherwise((root - (1 - slope)) / (2 * slope))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs as (doc_id, mark, _source, size, _hash, _bucket). mark is a hash of the text; the hash that orders a
    source's stream is of the key, and of the text where the key is null, so that null keys do not share a bucket."""
    source, key, text = F.col(source_col), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        key.alias("doc_id"),
        F.xxhash64(F.col(text_col).isNull(), text).alias("mark"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string"))).alias("_source"),
        words_in(F.col(text_col)).alias("size"),
        F.substring(F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("\\N"), F.md5(text)))), 1, 8).alias("_hash"),
    )
    return own.withColumn("_bucket", F.substring("_hash", 1, 3))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, slope: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, mark, size, source_size, target, taken, copies, position, positions.

    A source's documents form one stream of words in the order of a hash of their key; it is read from the
    start, up to ``most`` passes, until the target is met, so only the document at the end is taken in part and
    a source's taken words equal its target but for less than one word. positions has for each pass that takes at
    least half of the document the time of its first word by its source's schedule (heavy sources rise over training
    by ``slope``, light ones fall); position is the first of them, else null; copies counts them. mark is a hash of
    the text. A null text has no words; a null source is one of its own and comes last; rows that repeat a key follow
    each other by size; reruns give the same rows. Other columns are left out, whatever their names.
    """
    own = materialise(sized(docs, id_col, text_col, source_col), "sizes")
    goal = targets(own.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, most)
    order = [F.col("_hash"), F.col("doc_id"), F.col("size"), F.col("mark")]
    placed = running_total(own, ["_source"], "_bucket", order, "size", "_start")
    # one row for each source; Spark broadcasts it if its size allows, else splits the hot source by AQE
    placed = placed.join(goal, "_source")
    words = F.floor("target")
    lean = F.when(F.col("weight") >= max(weights), F.lit(slope)).when(F.col("weight") <= min(weights), F.lit(-slope)).otherwise(F.lit(0.0))
    taken, times = F.lit(0), []
    for k in range(most):
        place = F.col("source_size") * k + F.col("_start")
        part = F.greatest(F.least(words - place, F.col("size")), F.lit(0))
        taken = taken + part
        times.append(F.when((part > 0) & (2 * part >= F.col("size")), time_of(place / F.col("target"), lean)))
    placed = placed.withColumn("positions", F.array_compact(F.array(*times)))
    first = F.when(F.size("positions") > 0, F.element_at("positions", 1))
    return placed.select("doc_id", "mark", "size", "source_size", "target", taken.cast("long").alias("taken"), F.size("positions").alias("copies"), first.alias("position"), "positions")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, slope: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as training reads them, each as often as the mix takes it, by range of position.

    The last document of a source counts if at least half of it is taken. Rows of equal key and text are copies: the
    first of them by its other columns stands for all, at the places of all. Columns keep their names.
    """
    plan = plan_mix(docs, weights, most, slope, id_col, text_col, source_col).where("copies > 0")
    plan = plan.groupBy("doc_id", "mark").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("key"), F.xxhash64(text.isNull(), F.coalesce(text, F.lit(""))).alias("mark"), F.struct("*").alias("row"))
    own = own.join(plan, F.col("key").eqNullSafe(F.col("doc_id")) & (own["mark"] == plan["mark"])).select("key", own["mark"], "row", "positions")
    own = own.groupBy("key", "mark").agg(F.min("row").alias("row"), F.first("positions").alias("positions"))
    out = own.select("key", "mark", "row", F.explode("positions").alias("position"))
    return out.orderBy("position", "key", "mark").select("row.*")
