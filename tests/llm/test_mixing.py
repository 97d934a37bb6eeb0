"""The mix against a plain version of its plan, and its odd inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumenlake.llm import mixing

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """{source: target} of {source: size}, by sharing again until no target is above its most."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return share | {s: float(most * sizes[s]) for s in capped}, weight
        capped |= over


def plain_plan(rows, slope=0.5, most=3):
    """[(key, size, taken, positions)] of (key, text, source) rows with different keys."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    by = defaultdict(list)
    for d, _, s in rows:
        by[s].append(d)
    sizes = {s: sum(size[d] for d in ds) for s, ds in by.items()}
    goal, weight = plain_targets(sizes)
    out = []
    for s, ds in by.items():
        at, lean = 0, {5.0: slope, 1.0: -slope}.get(weight[s], 0.0)
        for d in sorted(ds, key=lambda d: (hashlib.md5(str(d).encode()).hexdigest()[:8], d)):
            taken, times = 0, []
            for k in range(most):
                place = sizes[s] * k + at
                part = max(0, min(math.floor(goal[s]) - place, size[d]))
                taken += part
                if part > 0 and 2 * part >= size[d]:
                    x = place / goal[s]
                    times.append(x if not lean else (math.sqrt(max((1 - lean) ** 2 + 4 * lean * x, 0)) - (1 - lean)) / (2 * lean))
            at += size[d]
            out.append((d, size[d], taken, times))
    return out


def test_the_plan_equals_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {d: x for d, *x in plain_plan([(r.doc_id, r.text, r.source) for r in docs.collect()])}
    plan = mixing.plan_mix(docs).collect()
    for r in plan:
        size, taken, times = want[r.doc_id]
        assert (r.size, r.taken, r.copies) == (size, taken, len(times)) and r.taken <= 3 * r.size
        assert all(abs(a - b) < 1e-9 for a, b in zip(r.positions, times)) and (r.position is None) == (not times)
    sources = {r.doc_id: r.source for r in docs.collect()}
    taken = Counter()
    for r in plan:
        taken[sources[r.doc_id]] += r.taken
    for r in plan:
        assert 0 <= r.target - taken[sources[r.doc_id]] < 1 or r.target == 0
    assert abs(sum(taken.values()) - sum(r.size for r in plan)) <= len(taken)


def test_the_schedule_moves_documents_not_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plans = [{r.doc_id: r for r in mixing.plan_mix(docs, slope=x).collect()} for x in (0.5, 0.0)]
    assert {k: v.taken for k, v in plans[0].items()} == {k: v.taken for k, v in plans[1].items()}
    assert {k: v.position for k, v in plans[0].items()} != {k: v.position for k, v in plans[1].items()}


def test_the_mix_reads_as_the_plan_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.plan_mix(docs).collect() if r.copies}
    got = [r.doc_id for r in mixed.collect()]
    assert Counter(got) == copies
    first = {r.doc_id: r.position for r in mixing.plan_mix(docs).collect()}
    seen = list(dict.fromkeys(got))
    assert seen == sorted(seen, key=lambda d: (first[d], d))


def test_repeated_rows_and_odd_columns(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _position string, row string, key string, mark string, position string"
    more = ("p", "r", "k", "m", "q")
    rows = [(7, "a b c d", None, "s", 1, *more)] * 3 + [(7, "other text", None, "s", 1, *more), (None, "x y", "en", None, 1, *more), (None, "z", "en", None, 1, *more), (1, None, "en", "s", 0, *more), (2, "", "en", "t", 0, *more)]
    df = spark.createDataFrame(rows, kinds)
    plan = mixing.plan_mix(df).collect()
    assert len(plan) == len(rows)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and all((r._position, r.row, r.key, r.mark, r.position) == more for r in mixed.collect())
    words = mixed.select(F.sum(mixing.words_in(F.col("text")))).first()[0]
    assert words == sum(r.size * r.copies for r in plan)
    assert mixing.plan_mix(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0
