"""URL templates against a plain tree, and rules."""

import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lumenlake.llm import queries, urlfilter


def plain_templates(urls, fan=16, share=0.05, least=5, z=1.96, prior=0.5, strength=10.0):
    """{(host, look): (template, purity)} of (host, look, label) triples, by recursion over each host's tree."""
    hosts = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for host, look, label in urls:
        x = hosts[host][look]
        x[0] += 1
        x[1] += label is not None
        x[2] += label or 0
    out = {}

    def smooth(b, n, p):
        return (b + strength * p) / (n + strength)

    def grow(host, paths, members, template, n_labels, n_bad, q, level):
        purity = smooth(n_bad, n_labels, q)
        segs = {k: [x for x in k.split("/") if x] for k in members}
        if len(members) == 1:
            out[host, members[0]] = ("/".join([template, *segs[members[0]][level:]]), purity)
            return
        kids = defaultdict(list)
        for k in members:
            if len(segs[k]) > level:
                kids[segs[k][level]].append(k)
            else:
                out[host, k] = (template, purity)

        def sums(ks):
            r = [0] * 5
            for k in ks:
                n, labels, bad = paths[k]
                after = segs[k][level + 1] if len(segs[k]) > level + 1 else None
                r = [a + c for a, c in zip(r, (n, labels, bad, 0 if after else n, n if after and "#" in after else 0))]
            return r

        p = sums([k for v in kids.values() for k in v])
        to = defaultdict(list)
        for seg, ks in kids.items():
            c = sums(ks)

            def enough(i):
                return c[i] >= least and p[i] - c[i] >= least

            def near(i, j):
                rate, rest = p[i] / p[j], p[j] - c[j]
                return abs(c[i] / c[j] - (p[i] - c[i]) / rest) <= z * math.sqrt(max(rate * (1 - rate), 0.01) * (1 / c[j] + 1 / rest))

            alike = near(2, 1) if enough(1) else enough(0) and near(3, 0) and near(4, 0)
            to["*" if alike or len(kids) > fan and c[0] < share * p[0] else seg] += ks
        for name, ks in to.items():
            c = sums(ks)
            grow(host, paths, ks, f"{template}/{name}", c[1], c[2], smooth(n_bad - c[2], n_labels - c[1], q), level + 1)

    for host, paths in hosts.items():
        grow(host, paths, list(paths), "", sum(x[1] for x in paths.values()), sum(x[2] for x in paths.values()), prior, 0)
    return out


def test_templates_equal_the_plain_tree(spark):
    r, rows = random.Random(4), []
    for h in range(8):
        for _ in range(r.randrange(1, 160)):
            parts = [r.choice(["a", "b", "spam", f"x{r.randrange(40)}", f"{r.randrange(99)}", "deadbeef01"]) for _ in range(r.randrange(0, 13))]
            path = "/" + "/".join(parts) + r.choice(["", "/", ".html"])
            rows.append((len(rows), f"http://h{h}.test{path}", None if r.random() < 0.5 else int("spam" in path) if r.random() < 0.9 else 1))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {x.page_id: x for x in urlfilter.filter_urls(df, [], label=F.col("bad")).collect()}
    names = []
    for _, u, label in rows:
        host, path = re.match("http://([^/]*)(.*)", u).groups()
        names.append((host, re.sub("[0-9]+", "#", re.sub("(?i)(?=[a-f]*[0-9])[0-9a-f]{8,}", "#", path)), label))
    want = plain_templates(names)
    for (i, *_), (host, look, _) in zip(rows, names):
        template, purity = want[host, look]
        assert got[i].template == template and abs(got[i].template_purity - purity) < 1e-12
        assert got[i].verdict == ("block" if purity >= 0.8 else "allow")


def test_templates_decide_without_a_rule(spark):
    """A labelled bad branch takes an unlabelled one of its kind along; a host of good labels, or of none, stays."""
    rows = [(i, f"http://bad.test/buy{i % 3}/item/{i}", 1 if i % 3 < 2 else None) for i in range(90)]
    rows += [(100 + i, f"http://good.test/buy{i % 3}/item/{i}", 0 if i % 3 < 2 else None) for i in range(90)]
    rows += [(200 + i, f"http://none.test/buy{i % 3}/item/{i}", None) for i in range(90)]
    rows += [(300 + i, f"http://mixed.test/{'spam' if i % 2 else 'news'}/{'abcdefghij'[i // 2 % 10]}x{i}", i % 2) for i in range(120)]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, bad int"), [], label=F.col("bad")).collect()
    assert {(x.host, x.verdict) for x in got if x.host != "mixed.test"} == {("bad.test", "block"), ("good.test", "allow"), ("none.test", "allow")}
    assert {(x.verdict, x.path.split("/")[1]) for x in got if x.host == "mixed.test"} == {("block", "spam"), ("allow", "news")}


def test_rules_and_odd_urls(spark):
    urls = [(1, "http://A.Example.com/en/7?x"), (2, "http://a.example.com/en/8"), (3, "https://b.net/de/1"), (4, "https://example.net/de/81#t"), (5, None), (6, "no scheme"), (7, "http://xcom/en/"), (7, "http://h.org/es/")]
    urls += [(None, "http://h.org/es/"), (8, "http://deep.test/" + "a/" * 3000), (9, "http://deep.test/" + "a/" * 3000 + "b")]
    df = spark.createDataFrame([(*x, "h", "t") for x in urls], "page_id long, url string, host string, template string")
    out = urlfilter.filter_urls(df, queries.RULES)
    rows = out.where("page_id < 8").collect()
    got = {x.page_id: x for x in rows}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert [got[k].rule for k in (2, 3, 4, 5, 6)] == ["com/en/", "net/de/", "example.net/de/8", None, None] and got[5].host == got[6].path == ""
    assert sorted(str(x.rule) for x in rows if x.page_id == 7) == ["None", "org/es/"]
    assert urlfilter.filter_urls(df.limit(0), queries.RULES).count() == 0
