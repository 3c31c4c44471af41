"""Structured Streaming forms of the stateful operators (S5's landing folder, T1, T11-T13, G1, G5, A7, K4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from flowquarry.operators.stats import EVENT_KEY

NEW_FLOW = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ts timestamp, pkt_no long, is_new boolean"


def read_landing(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Records that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, width: str, late: str = "30 seconds") -> DataFrame:
    """Event counts by tumbling window; a window is final when the watermark passes it."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *EVENT_KEY).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("w.start").alias("window_start"), *EVENT_KEY, "count")


def write_windows(counts: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", available_now: bool = False):
    """Finished windows as gzipped JSON lines, a folder's worth of files for each trigger."""
    writer = counts.select(F.to_json(F.struct("*")).alias("value")).writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("compression", "gzip")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).format("text").start(path)


def flow_is_new(packets: DataFrame, timeout_s: int = 3600, late: str = "30 seconds") -> DataFrame:
    """Packets with `is_new`; the state of a flow is the time of its last packet, and it ends after timeout_s."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "pkt_no"], kind="stable")
        times = rows["ts"].dt.as_unit("us").astype("int64").tolist()
        new = []
        for t in times:
            new.append(last is None or t - last > timeout_s * 1_000_000)
            last = t if last is None else max(t, last)
        state.update((last,))
        watermark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(last // 1000 + timeout_s * 1000, watermark + 1))
        yield rows[["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ts", "pkt_no"]].assign(is_new=new)

    keyed = packets.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.col("ts").cast("timestamp").alias("ts"), "pkt_no").withWatermark("ts", late)
    return keyed.groupBy("src_ip", "dst_ip", "src_port", "dst_port", "protocol").applyInPandasWithState(
        update, NEW_FLOW, "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def first_sightings(rows: DataFrame, key: str, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark's reach; later ones are duplicates."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def proxy_pairs(handshakes: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Outbound handshakes joined with inbound ones of the same random that went to their source not long before."""
    private = F.col("src_ip").rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
    to_private = F.col("dst_ip").rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
    inbound = handshakes.filter(~private & to_private).select(F.col("random").alias("r"), F.col("dst_ip").alias("host"), F.col("ts").alias("in_ts")).withWatermark("in_ts", within)
    outbound = handshakes.filter(private & ~to_private).withWatermark("ts", within)
    near = (F.col("random") == F.col("r")) & (F.col("src_ip") == F.col("host")) & (F.col("in_ts") <= F.col("ts")) & (F.col("in_ts") >= F.col("ts") - F.expr(f"interval {within}"))
    return outbound.join(inbound, near).select("src_ip", "dst_ip", "random", "ts")
