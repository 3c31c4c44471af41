"""Flow state as window functions (T1-T3, T11, F5, D10) over packets (flow key, ts, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def flow_is_new(packets: DataFrame, key: list[str] = FLOW_KEY, order: str = "pkt_no", timeout: float = 3600) -> DataFrame:
    """Packets with `is_new`: the first of their flow, or more than timeout seconds after its last one."""
    w = Window.partitionBy(*key).orderBy("ts", order)
    gap = _seconds(F.col("ts")) - _seconds(F.lag("ts").over(w))
    return packets.withColumn("is_new", F.coalesce(gap > timeout, F.lit(True)))


def tcp_first_data(packets: DataFrame, key: list[str] = FLOW_KEY, order: str = "pkt_no", timeout: float = 30) -> DataFrame:
    """Data packets (syn, fin, rst, seq, length) with `is_first`.

    The first data packet of a flow has the sequence number after the last SYN; a SYN older than
    timeout counts as if it matched (H14). A FIN or RST ends the entry.
    """
    past = Window.partitionBy(*key).orderBy("ts", order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("syn"), F.struct(F.lit(True).alias("open"), F.pmod(F.col("seq") + 1, F.lit(1 << 32)).alias("next"), "ts")).when(
        F.col("fin") | F.col("rst"), F.struct(F.lit(False).alias("open"), F.lit(None).cast("long").alias("next"), "ts")
    )
    last = F.last(mark, ignorenulls=True).over(past)
    old = _seconds(F.col("ts")) - _seconds(last["ts"]) > timeout
    rows = packets.withColumn("__fq_last", last)
    last = F.col("__fq_last")
    old = _seconds(F.col("ts")) - _seconds(last["ts"]) > timeout
    first = F.coalesce(last["open"] & (old | (last["next"] == F.col("seq"))), F.lit(False))
    return rows.filter(~F.col("syn") & (F.col("length") > 0)).withColumn("is_first", first).drop("__fq_last")


def seen_before(rows: DataFrame, key: str, order: list[str], out: str = "seen_before") -> DataFrame:
    """Rows with a column out: whether an earlier row, by the columns of order, had the key.

    The first place of every key is an aggregate, combined before the shuffle and joined back, so no
    task holds all rows of a frequent key. Rows that tie for the first place are all first; null is a
    key, and a null in order comes before all else.
    """
    place = F.struct(*order)
    first = rows.groupBy(F.col(key).alias("__fq_key")).agg(F.min(place).alias("__fq_first"))
    joined = rows.join(first, F.col(key).eqNullSafe(F.col("__fq_key")))
    return joined.withColumn(out, place > F.col("__fq_first")).drop("__fq_key", "__fq_first")


def direction(src_port: Column, dst_port: Column) -> Column:
    """To the lower port is from the client; equal ports too."""
    return F.when(dst_port <= src_port, "client").otherwise("server")


def unrecognised_first(packets: DataFrame, key: list[str] = FLOW_KEY, order: str = "pkt_no") -> DataFrame:
    """the first data of flows of no known protocol, whole; only a CBOR record cuts it to 256 bytes."""
    w = Window.partitionBy(*key).orderBy("ts", order)
    return packets.withColumn("__fq_n", F.row_number().over(w)).filter("__fq_n = 1 and msg_type is null").drop("__fq_n")
