import os
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import hashes, paths, tags
from lumenlake.operators import clusters, rewrite, search, stats, sync, tables
from lumenlake.plans import registry
from lumenlake.sources import files, store
from lumenlake.streaming import changes

SF = "/root/testdata/sf0.001"
CHEAP = ["path_parts", "photo_auto_tags", "audio_auto_tags", "search_media", "tag_stats", "folder_tree", "exact_clusters", "detect_changes", "plan_moves", "rename_tag", "journal_pending", "debounce_changes_hourly"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(x):
    return str(sorted(map(str, x)) if isinstance(x, (list, tuple)) else x)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*names).collect())
    want = sorted(tuple(plain(x) for x in r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_tags(spark):
    df = spark.createDataFrame([("Olympus  OM_1 / Rev 2", [" Dunes", "dunes", "", "untagged", "Low tide"])], "v string, t array<string>")
    r = df.select(tags.tag_slug("camera", F.col("v")), tags.normalize_tags(F.col("t"))).first()
    assert r[0] == "camera:olympus-om-1-rev-2" and r[1] == ["dunes", "low tide"]


def test_fuzzy_score(spark):
    df = spark.createDataFrame([("camera:canon",), ("xyz",)], "t string")
    a, b = [r[0] for r in df.select(tags.fuzzy_score("can", F.col("t"))).collect()]
    # c at the start 5, a behind it 2, n on its own 1, less a hundredth for each of twelve letters
    assert abs(a - 7.88) < 1e-9 and b is None


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.JPG",), ("/x",), ("/",)], "p string")
    got = [tuple(r) for r in df.select(paths.parent_dir(F.col("p")), paths.base_name(F.col("p")), paths.extension(F.col("p")), paths.ancestors(F.col("p"))).collect()]
    assert got == [("/a/b", "c.JPG", ".jpg", ["/", "/a", "/a/b"]), ("/", "x", "", ["/"]), ("", "/", "", [])]


def test_folder_filter_and_tree(spark):
    df = spark.createDataFrame([(p, p.rsplit("/", 1)[1], "photo") for p in ("/vault/sea/p1", "/vault/sea/p2", "/vault/sea/deep/p3", "/vault/hill/p4")], "path string, name string, media_kind string")
    assert search.filter_folder(df, "/vault/sea/").count() == 3 and search.filter_folder(df, "/vau").count() == 0
    tree = {r.path: (r["count"], r.total, r.parent) for r in stats.folder_tree(df).collect()}
    assert tree["/vault/sea"] == (2, 3, "/vault") and tree["/vault"] == (0, 4, "/") and tree["/"] == (0, 4, "")


def test_rename_counts(spark):
    df = spark.createDataFrame([("/1", ["duns"]), ("/2", ["duns", "dunes"]), ("/3", [])], "path string, tags array<string>")
    hidden = spark.createDataFrame([("duns",)], "name string")
    out, flags, counts = rewrite.rename_tag(df, hidden, "Duns", "dunes")
    assert rows(out) == [("/1", ["dunes"]), ("/2", ["dunes"]), ("/3", [])] and rows(flags) == [("dunes",)] and tuple(counts.first()) == (1, 1)
    with pytest.raises(ValueError):
        rewrite.rename_tag(df, hidden, "dunes", "Dunes")


def test_near_pairs_equal_all_pairs(spark):
    import random

    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(3):
            values.append(v ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 14))))
    signed = [struct.unpack("<q", struct.pack("<Q", v))[0] for v in values]
    df = spark.createDataFrame([(f"/{i}", v, "photo", []) for i, v in enumerate(signed)], "path string, phash long, media_kind string, tags array<string>")
    for t in (5, 12):
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= t}
        assert {(x.a, x.b) for x in clusters.near_pairs(df, t).collect()} == want


def test_undo_is_the_inverse_of_move(spark):
    df = spark.createDataFrame([("/a/x.jpg", "x.jpg", "h1"), ("/a/y.jpg", "y.jpg", "h2")], "path string, name string, hash string")
    results, moved = rewrite.plan_moves(df, df.select("path", F.lit(1).alias("seq")), "/b")
    undo = results.where("success").select(F.lit(1).alias("op_seq"), F.lit("move").alias("kind"), F.col("path").alias("old_path"), "new_path")
    trash = spark.createDataFrame([], "original_path string, hash string")
    assert rows(rewrite.plan_undo(moved, undo, trash)[1].select("path", "name", "hash")) == rows(df)


def png(path, w, h):
    raw = b"".join(b"\0" + bytes((x * x * 37 + y * 91 + w) % 256 for x in range(w)) for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def plain_dhash(image):
    """Bilinear 9 x 8, a cell at a time."""
    at = lambda y, x: [image.data[(y * image.width + x) * image.nChannels + (k if image.nChannels >= 3 else 0)] for k in range(3)]
    spot = lambda i, n, size: min(max((i + 0.5) * size / n - 0.5, 0), size - 1)
    grid = []
    for i in range(8):
        row = []
        for j in range(9):
            y, x = spot(i, 8, image.height), spot(j, 9, image.width)
            y0, x0 = int(y), int(x)
            y1, x1, fy, fx = min(y0 + 1, image.height - 1), min(x0 + 1, image.width - 1), y - y0, x - x0
            mix = [(a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy for a, b, c, d in zip(at(y0, x0), at(y0, x1), at(y1, x0), at(y1, x1))]
            b, g, r = [round(v) for v in mix]
            row.append((299 * r + 587 * g + 114 * b) // 1000)
        grid += [row[k] < row[k + 1] for k in range(8)]
    u = sum(1 << (63 - k) for k, bit in enumerate(grid) if bit)
    return u - (1 << 64) if u >> 63 else u


def test_files(spark, tmp_path):
    root = tmp_path / "m"
    png(root / "a/one.png", 20, 16)
    png(root / "b/vendor/two.png", 9, 8)
    (root / "a/bad.jpg").write_bytes(b"no picture")
    (root / "a/note.txt").write_text("x")
    found = files.list_media(spark, str(root))
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} == {"one.png", "two.png", "bad.jpg"}
    assert {r.path.rsplit("/", 1)[1] for r in sync.path_policy(found, []).collect()} == {"one.png", "bad.jpg"}
    assert {(r.width, r.height) for r in files.image_dims(spark, str(root)).collect()} == {(20, 16), (9, 8)}
    pictures = files.read_images(spark, str(root))
    got = {r.path.rsplit("/", 1)[1]: r.phash for r in hashes.image_dhash(pictures).collect()}
    want = {r.image.origin.rsplit("/", 1)[1]: plain_dhash(r.image) for r in pictures.collect()}
    assert got == want and len(want) == 2 and len(set(want.values())) == 2
    assert files.hashed_media(spark, str(root)).count() == 4


def test_journal_and_roots(spark, tmp_path):
    (tmp_path / "j").write_text('{"id":"1","kind":"move","state":"pending"}\n{"id":"1","kind":"move","state":"complete"}\n\n{"id":"2","kind":"delete","state":"pending","path":"/x"}\n{"id":"3","ki')
    pending = sync.journal_pending(files.read_journal(spark, str(tmp_path / "j")))
    assert [r.id for r in pending.collect()] == ["2"]
    for name, state, when in (("b", "pending", 1000), ("a", "complete", 2000)):  # the later file is the last word
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / name).write_text(f'{{"id":"7","kind":"move","state":"{state}"}}\n')
        os.utime(tmp_path / "many" / name, (when, when))
    assert sync.journal_pending(files.read_journal(spark, str(tmp_path / "many"))).count() == 0
    (tmp_path / "bare").write_text('[{"path":"/a","origin":""}]')
    assert [(r.path, r.origin) for r in files.read_roots(spark, str(tmp_path / "bare"))[0].collect()] == [("/a", "/a")]
    (tmp_path / "r").write_text('{"roots":[{"path":"/a","origin":""},{"path":"/a/vendor"}],"ignored":["/a/b"]}')
    roots, ignored = files.read_roots(spark, str(tmp_path / "r"))
    assert [(r.path, r.origin) for r in roots.collect()] == [("/a", "/a")] and rows(ignored) == [("/a/b",)]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(f"/a/{k}.jpg", t) for k, t in ((1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:02"), (3, "2024-01-01 00:01:00"), (9, "2024-01-01 02:00:00"))], "path string, t string")
    events = events.select("path", F.to_timestamp("t").alias("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = changes.debounce_changes(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r.first_event), r.events) for r in spark.table("debounced").collect()}
    every = {(str(r.first_event), r.events) for r in changes.debounce_changes(events).collect()}
    assert got == every - {("2024-01-01 02:00:00", 1)} and len(every) == 3  # the last session is still open


def test_ingest_stream(spark, tmp_path):
    png(tmp_path / "m/one.png", 9, 8)
    (tmp_path / "m/two.mp3").write_bytes(b"sound")
    catalog = spark.createDataFrame([("/old.jpg", 1, None, ["kept"], None, None)], "path string, size_bytes long, mod_time timestamp, tags array<string>, auto_tags array<string>, camera_make string")
    store.save_catalog({"media": catalog}, str(tmp_path / "c"))
    describe = lambda df: df.withColumn("camera_make", F.lit("Sony"))
    q = changes.ingest_stream(files.stream_listing(spark, str(tmp_path / "m")), str(tmp_path / "c"), catalog.schema, str(tmp_path / "ck"), describe=describe)
    q.awaitTermination(60)
    got = {r.path.rsplit("/", 1)[1]: r for r in store.load_catalog(spark, str(tmp_path / "c"), {"media": catalog.schema})["media"].collect()}
    assert sorted(got) == ["old.jpg", "one.png", "two.mp3"] and got["old.jpg"].tags == ["kept"]
    assert got["one.png"].auto_tags == ["camera:sony", "kind:photo"] and "codec:mp3" in got["two.mp3"].auto_tags and got["two.mp3"].tags == []


def test_scan_progress_steps(spark):
    df = spark.createDataFrame([("/a", f"/a/{k}") for k in range(60)] + [("/b", "/b/1")], "root string, path string")
    assert rows(changes.scan_progress(df)) == [("/a", 50, 60)]


def test_positions_are_gapless_over_wide_rows(spark):
    """More rows and columns than one partition of the sort, so that two plans of it could differ."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.concat(F.lit("x" * 200), F.col("id").cast("string")).alias("wide"), F.lit(1).alias("at"), F.lit(2).alias("part"))
    got = search.with_position(df.repartition(13), [F.col("k")]).select("k", "pos", "wide", "at", "part").collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.k)] == list(range(20_000))
    again = search.with_position(df.withColumn("pos", F.lit("old")), [F.desc("k")])
    assert again.columns == ["k", "wide", "at", "part", "pos"] and again.agg(F.countDistinct("pos"), F.max("pos")).first() == (20_000, 19_999)


def test_scanned_and_restored_rows_show(spark):
    df = spark.createDataFrame([("/a/x.jpg", "x.jpg", "h1", ["t"]), ("/a/y.jpg", "y.jpg", "h2", [])], "path string, name string, hash string, tags array<string>")
    scanned = spark.createDataFrame([("/a/z.jpg", "z.jpg", "h3")], "path string, name string, hash string")
    whole = sync.additive_scan(df, scanned)
    assert search.exclude_hidden(whole).count() == 3 and rows(search.filter_untagged(whole).select("path")) == [("/a/y.jpg",), ("/a/z.jpg",)]
    results, left, trash = rewrite.plan_deletes(df, df.select("path"))
    undo = results.select(F.lit(1).alias("op_seq"), F.lit("delete").alias("kind"), F.col("path").alias("old_path"), F.lit(None).cast("string").alias("new_path"))
    assert search.exclude_hidden(rewrite.plan_undo(left, undo, trash)[1]).count() == 2
    assert rewrite.plan_deletes(df, df.select("path"), permanent=True)[2].count() == 0


def test_an_empty_listing_prunes_nothing(spark):
    df = spark.createDataFrame([("/a/x.jpg",), ("/b/y.jpg",)], "path string")
    for root in (None, "/a"):
        with pytest.raises(ValueError):
            sync.prune_missing(df, df.where("path LIKE '/c/%'"), root)
    assert rows(sync.prune_missing(df, df.where("path LIKE '/b/%'"))[1]) == [("/a/x.jpg",)]


def test_two_sources_of_one_name_clash(spark):
    df = spark.createDataFrame([("/a/x.jpg", "x.jpg"), ("/b/x.jpg", "x.jpg"), ("/d/q.jpg", "q.jpg")], "path string, name string")
    sources = spark.createDataFrame([("/a/x.jpg", 2), ("/b/x.jpg", 1), ("/none.jpg", 3)], "path string, seq int")
    results, moved = rewrite.plan_moves(df, sources, "/d")
    assert [(r.path, r.success) for r in results.orderBy("path").collect()] == [("/a/x.jpg", False), ("/b/x.jpg", True), ("/none.jpg", False)]
    assert rows(moved.select("path")) == [("/a/x.jpg",), ("/d/q.jpg",), ("/d/x.jpg",)]


def test_too_many_queries_are_refused(spark):
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        clusters.semantic_neighbours(v, v, 1, most_queries=4)


def test_no_temporary_folder_on_a_cluster(spark):
    class Remote:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        tables.shared_dir(Remote)


def test_nearest_place_reaches_across_a_pole(spark):
    points = spark.createDataFrame([(1, 89.5, 0.0), (2, -90.0, 10.0), (3, 0.0, 0.0)], "id int, lat double, lon double")
    cities = spark.createDataFrame([("north", "x", 89.5, 180.0), ("south", "y", -89.0, -170.0)], "place string, country string, lat double, lon double")
    got = {r.id: r.place for r in clusters.nearest_place(points, cities, 300.0).collect()}
    assert got == {1: "north", 2: "south", 3: None}


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root}


@pytest.mark.parametrize("hub", [3, 50, 10**6])
def test_components_with_hubs(spark, monkeypatch, hub):
    """A star of a third of all nodes, two hubs that share neighbours, a chain, loops and repeated edges."""
    monkeypatch.setattr(tables, "HUB", hub)
    pairs = [(900, k) for k in range(1000, 1300)] + [(k, 2000) for k in range(1250, 1400)] + [(k, k + 1) for k in range(40)] + [(5, 5), (7, 8), (8, 7), (3000, 3001)]
    got = {(r.node, r.root) for r in tables.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == plain_components([p for p in pairs if p[0] != p[1]])
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_a_hub_meet_in_no_task(spark, monkeypatch):
    monkeypatch.setattr(tables, "HUB", 100)
    pairs = [(0, k) for k in range(1, 5000)] + [(k, k + 1) for k in range(5000, 15000)]
    out = tables.with_least(spark.createDataFrame(pairs, "a long, b long").repartition(8), len(pairs))
    at = out.withColumn("task", F.spark_partition_id()).where("a = 0").groupBy("task").count().collect()
    assert len(at) >= 8 and max(r["count"] for r in at) < 1250 and sum(r["count"] for r in at) == 4999


def test_folders_go_up_once(spark):
    df = spark.createDataFrame([("/x.jpg", "new"), ("/a/1.jpg", "new"), ("/a/2.jpg", "missing"), ("/a/b/c/3.jpg", "changed")], "path string, status string")
    assert rows(sync.folders_above(df)) == [("/",), ("/a",), ("/a/b",), ("/a/b/c",)]
    roots = spark.createDataFrame([("/",), ("/a/b",), ("/zzz",)], "path string")
    assert rows(sync.scan_summary(df, roots)) == [("/", "changed", 1), ("/", "new", 2), ("/a/b", "changed", 1)]
    asked = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/ab",), ("/",)], "path string")
    assert rows(sync.covered_by_roots(asked, roots.where("path = '/a/b'"))) == [("/a/b",), ("/a/b/c",)]
    assert rows(sync.covered_by_roots(asked, roots.where("path = '/'"))) == [("/",), ("/a",), ("/a/b",), ("/a/b/c",), ("/ab",)]
    assert rows(sync.covered_by_roots(asked, roots.where("path = '/zzz'"), df)) == [("/",), ("/a",), ("/a/b",), ("/a/b/c",)]


@pytest.mark.parametrize("crowded", [3, 10**6])
def test_crowded_cells_find_the_same_places(spark, monkeypatch, crowded):
    import math
    import random

    monkeypatch.setattr(clusters, "CROWDED", crowded)
    rng = random.Random(2)
    dense = [(rng.uniform(47.9, 49.1), rng.uniform(1.9, 3.1)) for _ in range(80)] + [(48.5, 2.5)] * 30 + [(0.0, 179.99), (0.0, -179.99), (89.9, 10.0), (-89.95, 120.0), (-12.5, -180.0), (12.0, 180.0)]
    dense += [(rng.uniform(-1, 1), rng.choice([179.6, -179.8]) + rng.uniform(-0.2, 0.2)) for _ in range(20)] + [(rng.uniform(88, 90), rng.uniform(-180, 180)) for _ in range(20)]
    points = [(k, *p) for k, p in enumerate(dense)] + [(900, None, 2.0), (901, 48.0, None)]
    cities = [(f"c{k}", "x", rng.uniform(47, 50), rng.uniform(1, 4)) for k in range(60)] + [("w", "x", 0.1, -179.7), ("e", "x", -0.2, 179.7), ("n", "x", 89.8, -170.0), ("s", "x", -89.9, -60.0)]

    def km(a, b, c, d):
        h = math.sin(math.radians(a - c) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(b - d) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1, h)))

    want = {}
    for k, lat, lon in points:
        all_ = sorted((round(km(lat, lon, c, d), 6), name) for name, _, c, d in cities) if lat is not None and lon is not None else []
        want[k] = all_[0][1] if all_ and all_[0][0] <= 50 else None
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    got = clusters.nearest_place(df, spark.createDataFrame(cities, "place string, country string, lat double, lon double"))
    assert {r.id: r.place for r in got.collect()} == want and sum(x is not None for x in want.values()) > 60


def test_scratch_tables_go_at_the_end(spark):
    there = lambda df: os.path.exists(df.scratch_path.removeprefix("file:"))
    with tables.scratch() as outer:
        first = tables.materialise(spark.range(3), "first")
        with tables.scratch() as inner:
            second, third = (tables.materialise(first.where(f"id < {k}"), "more") for k in (2, 1))
            inner.append(third)
        assert there(first) and not there(second) and there(third)
        outer.append(first)
    assert there(first) and not there(third) and first.count() == 3
    tables.spent(first)
    assert not there(first)
