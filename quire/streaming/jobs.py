"""Event streams of jobs: once-only ledger rows, progress, and rate limits, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire import scratch
from quire.plans.dialect import Catalog
from quire.plans.state import hits, walk

catalog = Catalog()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, its time as an event-time column."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a glob of the one table, since a stream reads folders
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, label: str = "once") -> DataFrame:
    """The first row of each user and type, by time and event_id among those that came in one micro-batch; later batches add new pairs only."""
    spark, path = stream.sparkSession, scratch.new_path(stream.sparkSession, label)
    keys, columns = ["user_id", "event_type"], stream.columns

    def add(rows: DataFrame, batch: int) -> None:
        first = rows.groupBy(*keys).agg(F.min(F.struct("ts", "event_id", *[c for c in columns if c not in ("ts", "event_id", *keys)])).alias("r")).select(*keys, "r.*").select(*columns)
        if batch:
            first = first.join(spark.read.schema(stream.schema).parquet(path).select(*keys), keys, "left_anti")
        # a batch that runs again writes its own folder again
        first.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.option("checkpointLocation", scratch.new_path(spark, f"{label}-state")).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def progress(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("value").alias("done"), F.count("*").alias("n"))


def rate_limit(events: DataFrame, most: int = 5, seconds: int = 86400) -> DataFrame:
    """user_id, hits, over: how many hits of a user went beyond ``most`` in a window that its first hit opens."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, n, hits, over = state.get if state.exists else (None, 0, 0, 0)
        # a user's rows come in several frames, which are in no order
        times = [(f["ts"].astype("int64") // 10**9 if str(f["ts"].dtype).startswith("datetime64[ns") else f["ts"].map(lambda x: int(x.timestamp()))).to_numpy() for f in frames]
        for t in np.sort(np.concatenate(times)) if times else ():
            if since is None or t - since > seconds:
                since, n = int(t), 0
            n, hits = n + 1, hits + 1
            over += n > most
        state.update((since, n, hits, int(over)))
        yield pd.DataFrame({"user_id": [key[0]], "hits": [hits], "over": [int(over)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, hits long, over long", "since long, n long, hits long, over long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read what it wrote; of an updating stream, each batch's rows."""
    spark, path = stream.sparkSession, scratch.new_path(stream.sparkSession, label)
    writer = stream.writeStream.option("checkpointLocation", scratch.new_path(spark, f"{label}-state")).trigger(availableNow=True).outputMode(mode)
    writer.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def last_of(updates: DataFrame, key: str, by: str) -> DataFrame:
    """The last row of each key of an updating stream, whose ``by`` never falls."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*[c for c in updates.columns if c != key]), by).alias("r")).select(key, "r.*")


catalog.add("stream_once", lambda spark, sf: once(event_stream(spark, sf)).select("user_id", "event_type", "event_id"), lambda d: "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) e WHERE k = 1")
catalog.add("stream_progress", lambda spark, sf: last_of(drain(progress(event_stream(spark, sf)), "progress", "update"), "user_id", "n"), lambda d: "SELECT user_id, max(value) AS done, count(*) AS n FROM events GROUP BY user_id")
catalog.add("stream_rate_limit", lambda spark, sf: last_of(drain(rate_limit(event_stream(spark, sf)), "limits", "update"), "user_id", "hits"), lambda d: f"SELECT user_id, count(*) AS hits, CAST(sum(CASE WHEN over THEN 1 ELSE 0 END) AS BIGINT) AS over FROM ({walk(d, hits(d), 'user_id', 't, id', {'since': 'x.t', 'n': '1'}, {'since': 'CASE WHEN x.t - s.since > 86400 THEN x.t ELSE s.since END', 'n': 'CASE WHEN x.t - s.since > 86400 THEN 1 ELSE s.n + 1 END'}, 'user_id, t, id, =n > 5 AS over')}) w GROUP BY user_id")
