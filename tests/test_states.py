"""Streams that forget: several micro-batches, late rows, and the number of rows in the state."""

import pytest
from pyspark.sql import functions as F

from lumenlake.streaming import changes

KEY = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def fed(spark, tmp_path):
    """Run a stream, one batch of rows after another from the same checkpoint; the rows of each, and of the state."""
    spark.conf.set(KEY, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(kinds, make, *batches):
        out, kept = [], []
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, kinds).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            schema = spark.read.parquet(str(tmp_path / "in")).schema
            stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            got = []
            q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, n, got=got: got.extend(df.collect())).start()
            q.awaitTermination(180)
            out.append([tuple(r) for r in got])
            kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        return out, kept

    yield run
    spark.conf.unset(KEY)


def test_settled_ids_leave_the_state(spark, fed):
    many = [(f"n{k}", "complete", k, "2024-01-01 00:00:00") for k in range(300)]
    batches = [
        [*many, ("a", "pending", 1, "2024-01-01 00:00:00"), ("b", "complete", 2, "2024-01-01 00:00:00"), ("b", "pending", 1, "2024-01-01 00:00:00")],
        [("a", "failed", 4, "2024-01-01 00:30:00"), ("a", "pending", 3, "2024-01-01 00:31:00"), ("c", "pending", 9, "2024-01-01 03:00:00")],
        [("b", "pending", 5, "2024-01-01 00:00:01"), ("n1", "failed", 0, "2024-01-01 03:00:00"), ("c", "complete", 8, "2024-01-01 03:00:00")],
        [("c", "failed", 10, "2024-01-01 04:00:00"), ("d", "pending", 1, "2024-01-02 00:00:00")],
    ]
    out, kept = fed("id string, state string, seq long, ts string", changes.journal_state_stream, *batches)
    first, second, third, fourth = out
    assert {r for r in first if r[0] in "ab"} == {("a", "pending", 1, False), ("b", "complete", 2, False)} and len(first) >= 302
    assert ("a", "failed", 4, False) in second and ("c", "pending", 9, False) in second and ("b", "complete", 2, True) in second
    assert ("a", "failed", 4, True) in second + third and sum(r[3] for r in first + second + third) == 302
    assert not [r for r in third if r[0] == "b"]  # older than the watermark
    assert ("n1", "failed", 0, False) in third and not [r for r in third if r[0] == "c"]  # opened anew; an entry that is not the last
    assert {("c", "failed", 10, False), ("c", "failed", 10, True), ("n1", "failed", 0, True)} <= set(fourth)
    assert kept[0] >= 300 and kept[-1] <= 4  # d is pending; a value and its timers count apart
    rows = [(*r[:3], r[3]) for b in batches for r in b if r != ("b", "pending", 5, "2024-01-01 00:00:01") and r[0] != "n1"]
    plain = spark.createDataFrame(rows, "id string, state string, seq long, ts string")
    want = {tuple(r)[:3] for r in changes.journal_state_stream(plain).collect()}
    seen = spark.createDataFrame([r for b in out for r in b if r[0] != "n1"], "id string, state string, seq long, closed boolean")
    assert {tuple(r) for r in seen.groupBy("id").agg(F.max_by("state", "seq"), F.max("seq")).collect()} == want


def test_idle_shows_before_the_next_event(spark, fed):
    batches = [
        [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:00:30")],
        [(2, "2024-01-01 00:30:00")],
        [(1, "2024-01-01 00:40:00"), (1, "2024-01-01 00:40:30"), (2, "2024-01-01 00:05:00"), (2, "2024-01-01 00:25:00")],
    ]
    out, _ = fed("user_id long, ts string", lambda df: changes.idle_stream(df, "2 minutes"), *batches)
    text = [{(u, str(a)[11:], b and str(b)[11:]) for u, a, b in rows} for rows in out]
    assert text[0] == set()
    assert (2, "00:00:30", "00:30:00") in text[1] and (1, "00:01:00", None) in text[1]  # no event of user 1 was needed
    assert (1, "00:01:00", "00:40:00") in text[2] and not [r for r in text[2] if r[2] == "00:05:00"]  # too late
    ended = {(u, str(a)[11:], str(b)[11:]) for rows in out for u, a, b in rows if b}
    assert {(1, "00:01:00", "00:40:00"), (2, "00:00:30", "00:30:00")} <= ended


def test_late_rows_open_no_session(spark, fed):
    batches = [[("/a/1.jpg", "2024-01-01 00:00:00"), ("/a/2.jpg", "2024-01-01 00:00:01"), ("/b/1.jpg", "2024-01-01 01:00:00")], [("/a/3.jpg", "2024-01-01 00:00:02"), ("/b/2.jpg", "2024-01-01 02:00:00")]]
    out, _ = fed("path string, ts string", changes.debounce_changes, *batches)
    got = {(r[0], r[3]) for rows in out for r in rows}
    assert got == {("/a", 2), ("/b", 1)}  # /a/3.jpg came behind the watermark
