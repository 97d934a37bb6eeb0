"""Line dedup by a deletion-neighbourhood join, with DataFrame operations only.

An edit inserts, deletes or substitutes one character, in lines of every length, or one word, in lines of ``WORDS`` words
or more, where it is so small a part; the bound is one edit. A line is a row of units, its characters or its words. A
variant of it is the row without one unit, keyed by the length of the longer line of a pair and by the place of the gap:
two lines are within one edit exactly if a variant of one, or the line itself with a gap put in, has the key of a variant
of the other. Lines that meet in a key are compared, and a line goes if an earlier one is within the bound.

Most lines have no near neighbour, so variants are only made where one can be: a pair within the bound agrees
outside the half that holds the edit, and outside the piece of about root n units of that half that holds it.
Both are joins on equal hashes that lose no pair, and a variant costs a hash of its piece, not of its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import materialise, spent

#: Lines of so many words or more may also differ by a whole word.
WORDS = 8
BLANKS, SPACE = " \t\n\x0b\f\r", "[\\x20\\x09-\\x0D]+"
WORDED = "[^\\x20\\x09-\\x0D]"
#: A null key counts as the largest. A line's place is its key, its number and 31 bits of its text's hash, as one number.
NULL_KEY, STEP = 2**63 - 1, 2**31


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_KEY))


def identity(id_col: str, text_col: str) -> list[Column]:
    """A row's identity: its key d and its text's hash t. Rows that share both are one document."""
    return [key_of(F.col(id_col)).alias("d"), F.xxhash64(text_col).alias("t")]


def place_of(key: Column, number: Column, text_hash: Column) -> Column:
    """One number that sorts by key, line number, then text; unlike a struct it is aggregated by hashing."""
    step, square = F.lit(STEP).cast("decimal(11,0)"), F.lit(STEP * STEP).cast("decimal(19,0)")
    place = key.cast("decimal(19,0)") * square + number.cast("decimal(11,0)") * step + F.shiftrightunsigned(text_hash, 33).cast("decimal(11,0)")
    return place.cast("decimal(38,0)")


def key_and_number(place: str) -> list[Column]:
    step, square = F.lit(STEP).cast("decimal(11,0)"), F.lit(STEP * STEP).cast("decimal(19,0)")
    within = F.pmod(F.col(place), square)
    return [F.call_function("div", F.col(place) - within, square).alias("d"), F.call_function("div", within, step).cast("int").alias("l")]


def left(x: Column, n: Column, words: bool) -> Column:
    return F.slice(x, F.lit(1), n) if words else F.left(x, n)


def right(x: Column, n: Column, words: bool) -> Column:
    return F.slice(x, F.size(x) - n + 1, n) if words else F.right(x, n)


def length(x: Column, words: bool) -> Column:
    return F.size(x) if words else F.length(x)


def words_of(line: Column) -> Column:
    """Of a line that has a word."""
    return F.split(F.btrim(line, F.lit(BLANKS)), SPACE)


def half_keys(units: Column, words: bool) -> list[Column]:
    """For the line as one of the longer length, and as one that lacks a unit of it: a key of what lies outside the
    first half, and of what lies outside the second. Two lines within one edit share at least one."""
    keys = []
    for more in (0, 1):
        longer = length(units, words) + more
        middle = F.ceil(longer / 2).cast("int")
        kind = 2 * words
        keys += [F.xxhash64(F.lit(kind), longer, right(units, longer - middle, words)), F.xxhash64(F.lit(kind + 1), longer, left(units, middle, words))]
    return keys


def first_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, id2, d, t, l, halves): each different line with a word, named by two hashes, where it comes first. halves are
    four keys of its characters and, if it has words enough, four of its words, else nulls."""
    own = docs.select(*identity(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("number", "line"))
    own = own.where(F.col("line").rlike(WORDED))
    names = [f"h{k}" for k in range(8)]
    line, at = F.col("line"), place_of(F.col("d"), F.col("number"), F.col("t"))
    own = own.select(F.xxhash64(line).alias("id"), F.hash(line).alias("id2"), at.alias("at"), "t", "line", words_of(line).alias("words"))
    enough = F.size("words") >= WORDS
    keys = [*half_keys(F.col("line"), False), *[F.when(enough, x) for x in half_keys(F.col("words"), True)]]
    own = own.select("id", "id2", "at", "t", *[x.alias(name) for x, name in zip(keys, names)])
    first = own.groupBy("id", "id2").agg(F.min("at").alias("at"), F.min_by("t", "at").alias("t"), *[F.first(x).alias(x) for x in names])
    return first.select("id", "id2", "at", "t", *key_and_number("at"), F.array(*names).alias("halves"))


def shared_only(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows whose key another row has too, a scratch table). The shared keys are written, so that the join reads two
    plain exchanges and the rows of a key that many lines have can be split over tasks."""
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    many = materialise(many, "shared-keys")
    return rows.join(many.hint("merge"), key, "left_semi"), many


def pieces(lines: DataFrame, words: bool) -> DataFrame:
    """lines(id, id2, at, units, half), half as half_keys numbers them -> (id, id2, at, full, outside, gaps, piece): the
    half cut into root-of-its-length pieces, each with a hash of all that is outside it. full: the line is of the longer
    length, and a piece loses a unit; else it lacks one, and a gap is put in."""
    units = F.col("units")
    own = lines.withColumn("full", F.col("half") < 2).withColumn("longer", length(units, words) + F.when(F.col("half") < 2, 0).otherwise(1))
    own = own.withColumn("middle", F.ceil(F.col("longer") / 2).cast("int")).withColumn("second", F.col("half") % 2)
    own = own.withColumn("low", F.col("middle") * F.col("second")).withColumn("width", F.when(F.col("second") == 1, F.col("longer") - F.col("middle")).otherwise(F.col("middle")))
    own = own.where("width > 0").withColumn("parts", F.ceil(F.sqrt("width")).cast("int"))
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    edge = lambda k: F.col("low") + F.ceil(k * F.col("width") / F.col("parts")).cast("int")
    own = own.withColumn("a", edge(F.col("part"))).withColumn("b", edge(F.col("part") + 1))
    outside = F.xxhash64(F.lit(words), "longer", "second", "part", left(units, F.col("a"), words), right(units, F.col("longer") - F.col("b"), words))
    size = F.col("b") - F.col("a") - F.when(F.col("full"), 0).otherwise(1)
    piece = F.slice(units, F.col("a") + 1, size) if words else F.substr(units, F.col("a") + 1, size)
    return own.select("id", "id2", "at", "full", outside.alias("outside"), (F.col("b") - F.col("a")).alias("gaps"), piece.alias("piece"))


def variants(found: DataFrame, words: bool) -> DataFrame:
    """pieces(...) as (id, id2, at, outside, variant): one row for each place of the gap."""
    own = found.withColumn("gap", F.explode(F.sequence(F.lit(0), F.col("gaps") - 1)))
    behind = F.col("gap") + F.when(F.col("full"), 2).otherwise(1)
    piece = F.col("piece")
    rest = right(piece, F.greatest(length(piece, words) - behind + 1, F.lit(0)), words)
    return own.select("id", "id2", "at", "outside", F.xxhash64("gap", left(piece, F.col("gap"), words), rest).alias("variant"))


def agree(a: Column, b: Column, end, words: bool) -> Column:
    """How many units two lines share from their left or right ``end``: bits of the number from the highest."""
    least = F.least(length(a, words), length(b, words))
    powers = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(powers, F.lit(0), lambda n, k: F.when((n.cast("long") + k <= least) & (end(a, n + k, words) == end(b, n + k, words)), n + k).otherwise(n))


def within_one(a: Column, b: Column, words: bool) -> Column:
    """Whether two lines are at most one unit apart: what they share from both ends is all but one unit of the longer.
    Unlike a table of distances this takes n log n for long lines."""
    m, n = length(a, words), length(b, words)
    return (F.abs(m - n) <= 1) & (agree(a, b, left, words) + agree(a, b, right, words) >= F.greatest(m, n) - 1)


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, l) of each line with a word that stays: key (null as the largest long), text hash and line number.

    Of equal lines the earliest by (key, line number, text hash) stays. A line also goes if a different line within one
    edit of it comes earlier, whether or not that one stays.
    """
    first = materialise(first_places(docs, id_col, text_col), "lines")
    halves = first.select("id", F.posexplode("halves").alias("half", "h")).where("h IS NOT NULL")
    shared, halves_twice = shared_only(halves, "h")
    asked = shared.groupBy("id").agg(F.collect_set("half").alias("asked"))
    asked = materialise(asked.join(first.select("id", "id2", "at", "d", "t", "l"), "id"), "asked")
    by_doc = asked.groupBy("d", "t").agg(F.collect_list(F.struct("l", "at", "id", "id2", "asked")).alias("asked"))
    by_doc = materialise(by_doc, "asked-by-doc")
    # both sides grow with the data, so no broadcast at any size
    texts = docs.select(*identity(id_col, text_col), F.col(text_col).alias("text")).join(by_doc.hint("merge"), ["d", "t"])
    texts = texts.select(F.split("text", "\n").alias("lines"), F.explode("asked").alias("x")).select(F.get("lines", F.col("x.l")).alias("line"), "x.*")
    same = (F.xxhash64("line") == F.col("id")) & (F.hash("line") == F.col("id2"))
    texts = texts.where(same).select("id", "id2", "at", "line", "asked").dropDuplicates(["at", "id", "id2"])  # rows that are repeated whole
    texts = materialise(texts, "texts")
    keyed, spare = [], [halves_twice, asked, by_doc, texts]
    for words in (False, True):
        half = F.explode(F.transform(F.filter("asked", lambda k: (k >= 4) == words), lambda k: k % 4))
        own = texts.select("id", "id2", "at", (words_of(F.col("line")) if words else F.col("line")).alias("units"), half.alias("half"))
        found = materialise(pieces(own, words), "pieces")
        shared, twice = shared_only(found, "outside")
        keyed.append(variants(shared, words))
        spare += [found, twice]
    keyed = materialise(keyed[0].union(keyed[1]), "variants")
    earliest = keyed.groupBy("outside", "variant").agg(F.min("at").alias("e"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pairs = keyed.join(earliest, ["outside", "variant"]).where("at > e").select("id", "id2", "e").distinct()
    pairs = pairs.join(texts.select("id", "id2", "line"), ["id", "id2"]).join(texts.select(F.col("at").alias("e"), F.col("line").alias("earlier")), "e")
    # a generator keeps the words from being split again at each step of the comparison
    pairs = pairs.withColumn("w", F.explode(F.array(F.struct(words_of(F.col("line")).alias("a"), words_of(F.col("earlier")).alias("b")))))
    worded = (F.size("w.a") >= WORDS) & (F.size("w.b") >= WORDS) & within_one(F.col("w.a"), F.col("w.b"), True)
    near = within_one(F.col("line"), F.col("earlier"), False) | worded
    gone = materialise(pairs.where(near).select("id", "id2").distinct(), "gone")
    spent(*spare, keyed)
    return first.join(gone, ["id", "id2"], "left_anti").select("d", "t", "l")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text reduced to the lines that stay, and n_lines, n_removed.

    A line ends at a line feed or at the text's end. Blank lines stay where they are. A null text stays null, with
    no lines; an empty one stays empty; an empty table gives an empty one. Keys are longs; a null key counts as the
    largest. Rows that repeat a key with another text are documents of their own; rows that repeat key and text are one,
    and stay equal. Other columns stay, whatever their names; columns of docs named n_lines or n_removed are replaced.
    """
    kept = kept_lines(docs, id_col, text_col)
    word, bit = F.floor(F.col("l") / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l") % 64)
    bits = kept.groupBy("d", "t", word.alias("w")).agg(F.bit_or(bit).alias("bits"))
    by_doc = bits.groupBy("d", "t").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("bits"), F.max("w").alias("last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("long")))
    by_doc = by_doc.select("d", "t", dense.alias("bits"))
    out = docs.select(F.struct("*").alias("row"), *identity(id_col, text_col)).join(by_doc.hint("merge"), ["d", "t"], "left")
    out = out.withColumn("lines", F.split(F.col(f"row.{text_col}"), "\n"))
    flag = lambda i: F.coalesce(F.getbit(F.get("bits", F.floor(i / 64).cast("int")), i % 64) == 1, F.lit(False))
    stays = F.filter("lines", lambda x, i: flag(i) | ~x.rlike(WORDED))
    out = out.withColumn("stay", stays)
    n = F.coalesce(F.size(F.filter("lines", lambda x: x.rlike(WORDED))), F.lit(0))
    lost = F.coalesce(F.size("lines") - F.size("stay"), F.lit(0))
    nothing = F.col("lines").isNull()
    row = F.col("row").withField(text_col, F.array_join("stay", "\n"))
    row = row.withField("n_lines", F.when(nothing, 0).otherwise(n).cast("long")).withField("n_removed", F.when(nothing, 0).otherwise(lost).cast("long"))
    return out.select(row.alias("row")).select("row.*")
