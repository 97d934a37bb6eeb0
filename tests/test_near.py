"""Joins of near hashes: what they broadcast, and links against all pairs when there are many blocks."""

import random
import struct

import pytest

from lumenlake.operators import clusters
from lumenlake.operators.tables import components, materialise


@pytest.fixture(scope="module")
def hashes(spark):
    r = random.Random(5)
    values = [r.getrandbits(64) for _ in range(30)]
    for v in list(values) * 3:
        values.append(v ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 14))))
    signed = {struct.unpack("<q", struct.pack("<Q", v))[0] for v in values}
    rows = [(k, v) for v in signed for k in ("audio", "photo")]
    return materialise(spark.createDataFrame(rows, "kind string, phash long"), "hashes")


@pytest.mark.parametrize("t", [5, 12])
def test_exploded_keys_are_not_broadcast(hashes, t):
    assert "Broadcast" not in clusters.near_hashes(hashes, t)._jdf.queryExecution().executedPlan().toString()


def test_links_of_blocks_connect_what_pairs_connect(hashes, monkeypatch):
    for name in ("PAIRS_SIDE", "LINKS_SIDE"):
        monkeypatch.setattr(clusters, name, 50)
    pairs = clusters.near_hashes(hashes, 12)
    found = {tuple(x) for x in pairs.collect()}
    values = [x.phash for x in hashes.where("kind = 'photo'").collect()]
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(k, a, b, apart(a, b)) for k in ("audio", "photo") for a in values for b in values if a < b and apart(a, b) <= 12}
    assert found == want and pairs.count() == len(want)
    groups = [{tuple(x) for x in components(df.where("kind = 'audio'").select("a", "b")).collect()} for df in (pairs, clusters.near_links(hashes, 12))]
    assert groups[0] == groups[1] and groups[0]


def test_large_components_are_not_compared_with_themselves(spark, monkeypatch):
    for name, n in (("CORE", 60), ("LINKS_SIDE", 100), ("SOUGHT_SIDE", 40), ("MEMBERS_SIDE", 30)):
        monkeypatch.setattr(clusters, name, n)
    r = random.Random(6)
    near = lambda v, n: v ^ sum(1 << b for b in r.sample(range(64), n))
    values = []
    for size in (250, 150):  # two large components about hashes near each other, then small ones
        own = [r.getrandbits(64)]
        while len(own) < size:
            own.append(near(r.choice(own[:8]), r.randrange(1, 8)))
        values += own
    for _ in range(40):
        v = r.getrandbits(64)
        values += [v, near(v, 12), near(v, 13)]
    signed = sorted({struct.unpack("<q", struct.pack("<Q", v))[0] for v in values})
    rows = [("photo", v) for v in signed] + [("audio", v) for v in signed[::3]]
    df = materialise(spark.createDataFrame(rows, "kind string, phash long"), "hashes")
    met, compared = [], clusters.compared
    monkeypatch.setattr(clusters, "compared", lambda hashes, *x, **y: met.append(hashes.count()) or compared(hashes, *x, **y))
    got = {x.node: x.root for x in clusters.near_labels(df, 12).collect()}
    want = {}
    for kind in ("photo", "audio"):
        left = {v & (2**64 - 1) for k, v in rows if k == kind}
        while left:
            group, todo = set(), {min(left)}
            while todo:
                left -= todo
                group |= todo
                todo = {x for x in left if any((x ^ y).bit_count() <= 12 for y in todo)}
            want |= {f"{kind}:{v:016x}": f"{kind}:{min(group):016x}" for v in group}
    assert {v: got.get(v, v) for v in want} == want and set(got) <= set(want)
    assert met and sum(met) < len(rows) / 2


@pytest.mark.parametrize("t", [5, 8])
def test_pairs_that_share_many_keys_are_made_once(hashes, t):
    pairs = clusters.near_hashes(hashes, t)
    values = [x.phash for x in hashes.where("kind = 'audio'").collect()]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = sorted((k, a, b, apart(a, b)) for k in ("audio", "photo") for a in values for b in values if a < b and apart(a, b) <= t)
    assert sorted(tuple(x) for x in pairs.collect()) == want and want
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
