"""Structured Streaming forms of the batch rules: hourly bars, upserts, alert suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.ingest import upsert
from barloom.sources.files import scratch


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream of files, with instants as event time; the schema is that of the files there are."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_bars(events: DataFrame, late: str) -> DataFrame:
    """Tumbling hourly bars by event type, final when the watermark has passed their end."""
    rows = events.where("value is not null").withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    ).select(F.col("event_type").alias("instrument"), F.col("window.start").alias("bar_time"), "open", "high", "low", "close", "volume")


#: Groups of keys whose state is held together.
GROUPS = 4096


def gone_out(key: np.ndarray, at: np.ndarray, last: np.ndarray, has: np.ndarray, gap: int) -> np.ndarray:
    """Places of the alerts that go out, of rows sorted by key (numbers from 0) and instant: all keys step on to their next one at once.

    last, has: each key's last instant that went out, and whether there is one.
    """
    edge = np.searchsorted(key, np.arange(len(last) + 1))
    # instants as ranks, so that key and instant are one number in order
    times = np.unique(at)
    whole = key * (len(times) + 1) + np.searchsorted(times, at)

    def after(keys: np.ndarray, instants: np.ndarray) -> np.ndarray:
        return np.searchsorted(whole, keys * (len(times) + 1) + np.searchsorted(times, instants + gap, "right"))

    keys = np.arange(len(last))
    places, out = np.where(has, after(keys, last), edge[:-1]), []
    while True:
        alive = places < edge[keys + 1]
        keys, places = keys[alive], places[alive]
        if not len(keys):
            return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
        out.append(places)
        places = after(keys, at[places])


def suppressed(alerts: DataFrame, hours: int, key: list[str], late: str = "1 hour") -> DataFrame:
    """event_id of the alerts that go out: one goes out unless an equal one went out in the `hours` before it.

    The state of a key is the time of its last alert that went out, so that alerts passed over don't prolong the silence.
    It goes when the watermark is `hours` past that time: whatever comes then goes out anyway. Keys are dealt over GROUPS
    groups by their hash; a group's keys and times are one state (an Arrow stream), so that a micro-batch calls Python once a
    group, not once a key, and so does the watermark. What one micro-batch holds of a group is sorted in one
    task. An alert older than the last one that went out, or than the watermark, or without an instant is passed over.
    """
    gap = hours * 3_600_000_000

    def run(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else None
        if state.hasTimedOut:
            held = before
        else:
            new = pa.concat_tables([pa.Table.from_pandas(p[[*key, "at", "event_id"]], preserve_index=False) for p in parts], promote_options="permissive")
            first = 0 if before is None else before.num_rows
            rows = new if before is None else pa.concat_tables([before, new], promote_options="permissive")
            numbers = rows.select(key).to_pandas().groupby(key, dropna=False, sort=False).ngroup().to_numpy()  # keys held come first, in order
            at, ids, number = new.column("at").to_numpy(), new.column("event_id").to_numpy(), numbers[first:]
            order = np.lexsort((ids, at, number))
            size = int(numbers.max()) + 1
            last, has = np.zeros(size, np.int64), np.arange(size) < first
            if first:
                last[:first] = before.column("at").to_numpy()
            at, number = at[order], number[order]
            out = gone_out(number, at, last, has, gap)
            last[number[out]] = at[out]  # places are in order: a key's latest stays
            one = np.unique(numbers, return_index=True)[1]
            held = rows.select(key).take(one).append_column("at", pa.array(last))
            yield pd.DataFrame({"event_id": ids[order[out]]})
        now = state.getCurrentWatermarkMs()
        ends = (held.column("at").to_numpy() + gap) // 1000 + 1
        held = held.filter(pa.array(ends > now))
        if not held.num_rows:
            state.remove()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held.schema) as writer:
            writer.write_table(held)
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(int(ends[ends > now].min()))

    rows = alerts.withWatermark("ts", late).where("ts is not null").select(F.pmod(F.xxhash64(*key), F.lit(GROUPS)).alias("key_group"), *key, "ts", F.unix_micros("ts").alias("at"), "event_id")
    return rows.groupBy("key_group").applyInPandasWithState(run, "event_id bigint", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over all there is, to Parquet with a checkpoint, and reads the result."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}_state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _versions(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """part, batch: the batch that wrote each part last (before a batch)."""
    listed = spark.read.schema("part bigint, batch bigint").parquet(f"{table}/parts")
    return (listed if before is None else listed.where(F.col("batch") < before)).groupBy("part").agg(F.max("batch").alias("batch"))


def current(spark: SparkSession, table: str) -> DataFrame:
    """The table as its last batch left it: of each part the version written last. The driver lists parts, not rows."""
    return spark.read.parquet(*[f"{table}/rows/batch={r['batch']}/part={r['part']}" for r in _versions(spark, table).collect()])


def upserted(stream: DataFrame, name: str, key: list[str], fields: tuple[str, ...], part: Column, table: str | None = None) -> DataFrame:
    """Upserts every micro-batch into a table in parts and tells what changed: batch, the key, change.

    part: a whole number made from the key alone. A batch reads the parts of its rows in their last versions and writes new
    versions of those alone in which a row is new or changed. Versions, the list of parts and changes are folders by batch
    number and a batch reads those of earlier ones only, so that one that is run again overwrites its own.
    """
    spark = stream.sparkSession
    table, changes, work = table or scratch(spark, f"{name}_table"), scratch(spark, name), scratch(spark, f"{name}_work")
    columns = [*key, *fields]

    def write(batch: DataFrame, number: int) -> None:
        numbered = F.coalesce(part.cast("bigint"), F.lit(-1))
        touched = [r[0] for r in batch.select(numbered).distinct().collect()]  # as many numbers as parts
        paths = [f"{table}/rows/batch={r['batch']}/part={r['part']}" for r in _versions(spark, table, number).where(F.col("part").isin(touched)).collect()] if number and touched else []
        stored = spark.read.schema(batch.schema).parquet(*paths) if paths else batch.limit(0)
        upsert(stored, batch, key, fields).select(*key, "row", "change", numbered.alias("part")).write.mode("overwrite").parquet(f"{work}/{number}")
        after = spark.read.parquet(f"{work}/{number}")
        changed = after.where("change in ('inserted', 'updated')").select("part").distinct()
        rows = after.join(F.broadcast(changed), "part", "left_semi")  # one number per part
        rows.select(*key, "row.*", "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/rows/batch={number}")
        changed.write.mode("overwrite").parquet(f"{table}/parts/batch={number}")
        after.where("change != 'kept'").select(*key, "change").write.mode("overwrite").parquet(f"{changes}/batch={number}")

    query = stream.select(*columns).writeStream.foreachBatch(write).option("checkpointLocation", scratch(spark, f"{name}_state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(changes)
