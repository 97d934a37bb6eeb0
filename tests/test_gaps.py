"""A pause of exactly the gap ends a session; one of a microsecond less does not."""

from pyspark.sql import functions as F

from lumenlake.streaming import changes

ROWS = [(1, "/a/x", "00:00:00"), (1, "/a/x", "00:00:03"), (2, "/b/x", "00:00:00"), (2, "/b/x", "00:00:02.999999")]


def test_a_pause_of_exactly_the_gap_ends_a_session(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(ROWS, "user_id int, path string, t string").withColumn("ts", F.concat(F.lit("2024-01-01 "), "t").cast(kind))
        out = changes.debounce_changes(df).orderBy("dir", "first_event").select("dir", F.date_format("due", "ss.SSSSSS"), "events")
        assert [tuple(x) for x in out.collect()] == [("/a", "03.000000", 1), ("/a", "06.000000", 1), ("/b", "05.999999", 2)]
        assert [tuple(x) for x in changes.idle_periods(df, "3 seconds").selectExpr("user_id", "second(idle_from)", "second(idle_to)").collect()] == [(1, 0, 3)]
