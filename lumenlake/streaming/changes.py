"""File-change events and scans as streams; every function also takes a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions.paths import parent_dir
from lumenlake.functions.tags import with_auto_tags
from lumenlake.operators.sync import detect_changes, latest_per_path, upsert_catalog
from lumenlake.operators.tables import materialise, spent
from lumenlake.sources import store
from lumenlake.streaming.states import IdleStates, JournalStates, milliseconds

RESCAN_OPS = ["create", "write", "rename", "chmod"]


def timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ts, and ts as microseconds in ``at``."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.withColumn("at", F.unix_micros("ts"))


def quiet_window(gap: str) -> Column:
    """Sessions of ts that a pause of gap ends. Spark's own still take in an event that comes exactly gap after the last
    one, so they get a gap that is a microsecond less; their end is as much too early."""
    return F.session_window("ts", f"{gap} -1 microseconds")


def debounce_changes(events: DataFrame, gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """(dir, first_event, due, events): one rescan of a directory when it has been quiet for gap. events(path, ts)."""
    own = events.select(parent_dir(F.col("path")).alias("dir"), "ts")
    own = timed(own, late) if events.isStreaming else own
    out = own.groupBy("dir", quiet_window(gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select("dir", F.col("w.start").alias("first_event"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("due"), "events")


def route_changes(events: DataFrame, roots: DataFrame) -> DataFrame:
    """(action, path) for events(path, op, is_dir) whose parent or self is one of roots(path), a static table."""
    root = roots.select(F.col("path").alias("_root")).distinct()
    own = events.withColumn("_parent", parent_dir(F.col("path")))
    watched = own.join(root, F.col("_parent") == F.col("_root"))
    action = F.when((F.col("op") == "create") & F.col("is_dir"), "register").when(F.col("op").isin(RESCAN_OPS), "rescan")
    inner = watched.select(action.alias("action"), F.when(action == "register", F.col("path")).otherwise(F.col("_parent")).alias("path"))
    gone = own.where("op = 'remove'").join(root, F.col("path") == F.col("_root")).select(F.lit("drop_root").alias("action"), "path")
    return inner.where("action IS NOT NULL").union(gone)


def scan_progress(listing: DataFrame, every: int = 25) -> DataFrame:
    """(root, processed, total) over a stream or batch of (root, path): files so far in steps of ``every``, and their
    number, -1 as long as the listing goes on. Output mode update or complete."""
    own = listing.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    total = F.lit(-1).cast("long") if listing.isStreaming else F.col("n")
    return own.where(F.col("n") >= every).select("root", (F.floor(F.col("n") / every) * every).cast("long").alias("processed"), total.alias("total"))


def journal_state_stream(journal: DataFrame, keep: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(id, state, seq, closed): the last entry, by seq, of each id of journal(id, state, seq, ts).

    A batch gives one row for each id, closed false. A stream (mode append) gives a row whenever the last entry of an id
    changes. An id whose last entry is settled, complete or failed, is forgotten when event time, less ``late``, has
    passed that entry's ts by ``keep``; it then gives its row once more, closed. Entries older than the watermark are
    dropped; a younger one of a forgotten id opens it anew, whatever its seq. Pending ids stay. Rows reduced by
    max_by(state, seq) are what a batch gives. Streams need the RocksDB state store.
    """
    if not journal.isStreaming:
        last = journal.groupBy("id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))
        return last.withColumn("closed", F.lit(False))
    own = timed(journal.select("id", "state", F.col("seq").cast("long").alias("seq"), "ts").where("id IS NOT NULL"), late)
    return own.groupBy("id").transformWithState(JournalStates(milliseconds(keep)), "id string, state string, seq long, closed boolean", "append", "eventTime")


def take_batch(
    df: DataFrame, number: int, directory: str, schema: T.StructType, query: str,
    describe: Callable[[DataFrame], DataFrame] | None = None, preserve_tags: bool = False, table: str = "media",
) -> int:
    """Take batch ``number`` of a listing into the store at ``directory``; the number of the commit that holds it.

    New and changed files are described (describe adds what is known of them, such as hash and camera), get their
    automatic tags and replace the catalog's rows. Only parts with such a file are written. The commit names the batch
    in its ledger, so a batch that is run again, whole or after a crash at any point, is taken once. If another writer
    commits in between, the batch is worked out again on what that one left.
    """
    spark = df.sparkSession
    rows = materialise(latest_per_path(df, "mod_time"), "ingest")
    try:
        while True:
            before = store.head(spark, directory)
            if before["batches"].get(query, -1) >= number:
                return before["number"]
            part = store.part_of(F.col("path"), before["parts"])
            folders = before["tables"].get(table, {})
            asked = {str(r.p) for r in rows.select(part.alias("p")).distinct().collect()}  # at most one for each part
            catalog = store.read_parts(spark, [f for p, f in folders.items() if p in asked], schema)
            fresh = detect_changes(rows, catalog).where("status IN ('new', 'changed')").select("path")
            touched = {r.p for r in fresh.select(part.alias("p")).distinct().collect()}
            written = {}
            if touched:
                built = rows.join(fresh, "path", "left_semi")
                out = upsert_catalog(catalog.where(part.isin(*touched)), with_auto_tags(describe(built) if describe else built), preserve_tags)
                out = out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in schema])
                written = store.write_parts(out, directory, before["parts"])
            try:
                return store.commit(spark, directory, before, before["tables"] | {table: folders | written}, {query: number})
            except store.Conflict:
                continue
    finally:
        spent(rows)


def ingest_stream(
    listing: DataFrame, directory: str, schema: T.StructType, checkpoint: str, query: str | None = None,
    describe: Callable[[DataFrame], DataFrame] | None = None, preserve_tags: bool = False, table: str = "media",
):
    """A query that takes a streamed listing into a store, batch by batch, each once; see take_batch. query names it in
    the ledger; it must be another one when the checkpoint is, and is the checkpoint's path if none is given."""

    def batch(df: DataFrame, number: int) -> None:
        take_batch(df, number, directory, schema, query or checkpoint, describe, preserve_tags, table)

    return listing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idle_stream(events: DataFrame, threshold: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, idle_from, idle_to) over a stream of events(user_id, ts): as soon as event time, less ``late``, has
    passed a user's last event by threshold a row without idle_to says that the user is idle; the next event ends it, in
    a row with idle_to. Rows with idle_to are those of idle_periods. Events older than the watermark are dropped. Of
    each user one time is kept. Mode append; needs the RocksDB state store."""
    own = timed(events.select("user_id", "ts").where("user_id IS NOT NULL"), late)
    kind = events.schema["user_id"].dataType.simpleString()
    out = own.groupBy("user_id").transformWithState(IdleStates(milliseconds(threshold)), f"user_id {kind}, idle_from long, idle_to long", "append", "eventTime")
    return out.select("user_id", F.timestamp_micros("idle_from").alias("idle_from"), F.timestamp_micros("idle_to").alias("idle_to"))


def idle_periods(events: DataFrame, threshold: str = "2 minutes") -> DataFrame:
    """(user_id, idle_from, idle_to): gaps of threshold or more between a user's events(user_id, ts)."""
    sessions = events.groupBy("user_id", quiet_window(threshold).alias("w")).agg(F.max("ts").alias("last"))
    after = F.lead("w.start").over(Window.partitionBy("user_id").orderBy("w.start"))
    return sessions.select("user_id", F.col("last").alias("idle_from"), after.alias("idle_to")).where("idle_to IS NOT NULL")
