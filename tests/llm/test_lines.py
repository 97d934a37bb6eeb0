"""Line dedup against a plain version, and its odd inputs."""

import random
import re

from lumenlake.llm import linededup

BLANKS = " \t\n\x0b\f\r"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    p = next((i for i in range(least) if a[i] != b[i]), least)
    q = next((i for i in range(least) if a[-1 - i] != b[-1 - i]), least)
    return p + q >= max(len(a), len(b)) - 1


def plain_dedup(rows):
    """{key: (text, lines, removed)} of (key, text) rows with different keys, no nulls."""
    firsts = {}
    for d, t in rows:
        for i, x in enumerate(t.split("\n")):
            if x.strip(BLANKS):
                firsts[x] = min(firsts.get(x, (d, i)), (d, i))
    words = {x: re.findall(r"[^\x20\x09-\x0D]+", x) for x in firsts}

    def near(x, y):
        return within_one(x, y) or min(len(words[x]), len(words[y])) >= 8 and within_one(words[x], words[y])

    stay = {p for x, p in firsts.items() if not any(q < p and near(x, y) for y, q in firsts.items())}
    out = {}
    for d, t in rows:
        lines = t.split("\n")
        kept = [x for i, x in enumerate(lines) if not x.strip(BLANKS) or (d, i) in stay]
        out[d] = ("\n".join(kept), sum(bool(x.strip(BLANKS)) for x in lines), len(lines) - len(kept))
    return out


def varied_lines(r, letters="abé🙂 c"):
    base = ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(50)]

    def line():
        x = r.choice(base)
        for _ in range(r.randrange(0, 3)):
            k = r.randrange(len(x) + 1)
            x = r.choice([x[:k] + r.choice("abz") + x[k:], x[:k] + x[k + 1 :], x[:k] + "q" + x[k + 1 :]])
        return x

    return line


def test_lines_equal_the_plain_version(spark):
    r = random.Random(1)
    line = varied_lines(r)
    rows = [(d, "\n".join(line() for _ in range(r.randrange(0, 9)))) for d in range(90)]
    rows += [(1000 + k, "x" * k) for k in range(1, 6)]
    base = [[f"w{r.randrange(9)}" for _ in range(r.randrange(5, 14))] for _ in range(12)]
    for d in range(2000, 2080):  # words changed, dropped and put in
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 3)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = r.choice([["longer words"], []])
        rows.append((d, r.choice(["", " "]) + r.choice([" ", "  "]).join(w)))
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in got} == plain_dedup(rows)


def test_long_lines_and_many_lines(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh ") for _ in range(200_000))
    rows = [(1, long), (2, long[:70_000] + long[70_001:]), (3, "#" + long[1:-1] + "#"), (4, "\n".join(f"line of number {k * 7919}" for k in range(1500)) + "\n" + long)]
    got = {x.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == long and got[2].text == "" and got[2].n_removed == 1 and got[3].text == rows[2][1]
    assert got[4].n_lines == 1501 and not got[4].text.endswith(long)
    few = plain_dedup([(4, rows[3][1][: -len(long) - 1])])
    assert got[4].text == few[4][0]


def test_lines_odd(spark):
    kinds = "doc_id long, text string, _kept string, d string, lines string, n_lines string, row string"
    more = ("k", "d", "l", "n", "r")
    rows = [(1, None), (2, ""), (3, "same\nsame\n\nother line"), (3, "same\nsame\n\nother line"), (None, "other line"), (5, "  \n\t"), (6, "samE")]
    df = spark.createDataFrame([(*x, *more) for x in rows], kinds)
    got = linededup.dedup_lines(df).collect()
    assert sorted((str(x.doc_id), x.text, x.n_lines, x.n_removed) for x in got if x.text is not None) == [
        ("2", "", 0, 0), ("3", "same\n\nother line", 3, 1), ("3", "same\n\nother line", 3, 1), ("5", "  \n\t", 0, 0), ("6", "", 1, 1), ("None", "", 1, 1),
    ]
    assert [(x.doc_id, x.n_lines) for x in got if x.text is None] == [(1, 0)]
    assert all((x._kept, x.d, x.lines, x.row) == ("k", "d", "l", "r") for x in got)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_rows_that_repeat_a_key_rerun_alike(spark):
    rows = [(1, "first one\nsecond"), (1, "another\nsecond"), (2, "first one\nanother\nthird")]
    runs = [sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(x, "doc_id long, text string")).collect())) for x in (rows, rows[::-1])]
    assert runs[0] == runs[1] and runs[0][2] == (2, "third", 3, 2)
    assert sorted(x[1] for x in runs[0][:2]) in (["another", "first one\nsecond"], ["another\nsecond", "first one"])


def test_rows_of_one_key_are_documents_of_their_own(spark):
    rows = [(1, "a dup line here\nx1 one"), (9, "nine"), (9, "a dup line here"), (None, "first text alone\nother words"), (None, "a dup line here\nzzz yyy")]
    got = {(r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "a dup line here\nx1 one", 0), (9, "nine", 0), (9, "", 1), (None, "first text alone\nother words", 0), (None, "zzz yyy", 1)}


def test_rows_repeated_whole_stay_equal(spark):
    rows = [(3, "page one of it\nown words")] * 4 + [(4, "page two of it\npage one of it\nrest")] * 3 + [(None, "own wordz\nlast of all")] * 2
    got = sorted(map(tuple, linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(3, "page one of it\nown words", 2, 0)] * 4 + [(4, "page two of it\nrest", 3, 1)] * 3 + [(None, "last of all", 2, 1)] * 2


def test_places_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(-(2**63), 0, -1), (-5, 2**31 - 1, 2**63 - 1), (2**63 - 1, 2**31 - 1, -(2**63)), (0, 7, 0)]
    df = spark.createDataFrame(rows, "k long, n int, t long").withColumn("at", linededup.place_of(F.col("k"), F.col("n"), F.col("t")))
    assert [(r.k, r.n) for r in df.orderBy("at").collect()] == [(k, n) for k, n, _ in sorted(rows)]
    assert all((r.k, r.n) == (r.d, r.l) for r in df.select("k", "n", *linededup.key_and_number("at")).collect())
