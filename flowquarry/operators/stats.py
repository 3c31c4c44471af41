"""Aggregation and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.fingerprints import fp_type
from flowquarry.functions.ip import is_private_v4, v4_to_int
from flowquarry.functions.names import bare_name

EVENT_KEY = ["src_ip", "fp", "ua", "dst", "kind"]
FINGERPRINT_TYPES = ("tls", "quic", "tofsee", "http", "stun", "ssh", "ssh_init")


def dst_context(sni: Column, ip: Column, port: Column) -> Column:
    """`(name)(address)(port)`."""
    return F.concat(F.lit("("), F.coalesce(sni, F.lit("")), F.lit(")("), ip, F.lit(")("), port.cast("string"), F.lit(")"))


def fingerprint_events(flows: DataFrame) -> DataFrame:
    """An event for each flow with a fingerprint of a kind that is counted; tofsee swaps the two ends."""
    bot = fp_type(F.col("fp")) == "tofsee"
    return flows.filter(fp_type(F.col("fp")).isin(*FINGERPRINT_TYPES)).select(
        F.when(bot, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("src_ip"),
        "fp",
        F.when(bot, F.col("src_ip")).otherwise(F.coalesce("ua", F.lit(""))).alias("ua"),
        dst_context(F.col("sni"), F.when(bot, F.col("src_ip")).otherwise(F.col("dst_ip")), F.col("dst_port")).alias("dst"),
        F.lit("fingerprint").alias("kind"),
        "ts",
    )


def cert_label_events(certs: DataFrame) -> DataFrame:
    """An event for each certificate name whose source is private."""
    return certs.filter(is_private_v4(v4_to_int(F.col("src_ip")))).select(
        "src_ip", F.col("common_name").alias("fp"), F.lit("").alias("ua"), F.lit("").alias("dst"), F.lit("cert_label").alias("kind"), "ts"
    )


def snmp_events(packets: DataFrame) -> DataFrame:
    """An event for each object identifier of a message."""
    return packets.select(
        "src_ip", F.explode("oids").alias("fp"), F.lit("").alias("ua"), F.lit("").alias("dst"), F.lit("snmp_oid").alias("kind"), "ts"
    )


def count_events(events: DataFrame) -> DataFrame:
    """G1: how often each event occurred; counted before the shuffle and after it."""
    return events.groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("count"))


def capped_counts(events: DataFrame, limit: int) -> DataFrame:
    """Counts of the first `limit` distinct events by first sighting; a documented limit of the report."""
    seen = events.groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"))
    return seen.orderBy("first_ts", *EVENT_KEY).limit(limit).select(*EVENT_KEY, "count")


def tumbling_counts(events: DataFrame, width: str) -> DataFrame:
    """Counts by window of time."""
    w = events.groupBy(F.window("ts", width).alias("w"), *EVENT_KEY).agg(F.count(F.lit(1)).alias("count"))
    return w.select(F.col("w.start").alias("window_start"), *EVENT_KEY, "count")


def nested_stats(counts: DataFrame) -> DataFrame:
    """One row per source: device_info and fingerprints, with sessions by user agent and destination counts."""
    fps = counts.filter("kind = 'fingerprint'")
    dests = fps.groupBy("src_ip", "fp", "ua").agg(F.sort_array(F.collect_list(F.struct("dst", "count"))).alias("dest_info"))
    sessions = dests.groupBy("src_ip", "fp").agg(
        F.sort_array(F.collect_list(F.struct(F.when(F.col("ua") != "", F.col("ua")).alias("user_agent"), "dest_info"))).alias("sessions")
    )
    own = F.when(F.col("kind") == "fingerprint", F.struct(F.col("fp").alias("str_repr"), "sessions"))
    others = counts.filter("kind <> 'fingerprint'").select("src_ip", "fp", "kind", "count", F.lit(None).cast(sessions.schema["sessions"].dataType).alias("sessions"))
    rows = sessions.select("src_ip", "fp", F.lit("fingerprint").alias("kind"), F.lit(0).cast("long").alias("count"), "sessions").unionByName(others)

    def labels(kind: str, name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("fp").alias(name), "count"))))

    out = rows.groupBy("src_ip").agg(labels("cert_label", "common_name").alias("c"), labels("snmp_oid", "oid").alias("s"), F.sort_array(F.collect_list(own)).alias("fingerprints"))
    return out.select("src_ip", F.struct(F.col("c").alias("cert_labels"), F.col("s").alias("snmp_labels")).alias("device_info"), "fingerprints")


def flat_stats(nested: DataFrame) -> DataFrame:
    """The nested rows as counts again, to compare with a recount."""
    f = nested.select("src_ip", F.explode("fingerprints").alias("f"))
    s = f.select("src_ip", F.col("f.str_repr").alias("fp"), F.explode("f.sessions").alias("s"))
    return s.select("src_ip", "fp", F.coalesce("s.user_agent", F.lit("")).alias("ua"), F.explode("s.dest_info").alias("d")).select(
        "src_ip", "fp", "ua", "d.dst", "d.count"
    )


def host_os_profile(counts: DataFrame, db: DataFrame, coefficients: DataFrame) -> DataFrame:
    """The most likely system of each source.

    counts (src_ip, protocol, fp, count), db (protocol, fp, os, share), coefficients (protocol, os,
    target, weight): shares are added, made to sum to 1 by protocol, weighted and put through softmax.
    """
    mass = counts.join(db, ["protocol", "fp"]).groupBy("src_ip", "protocol", "os").agg(F.sum(F.col("count") * F.col("share")).alias("mass"))
    w = Window.partitionBy("src_ip", "protocol")
    normal = mass.withColumn("mass", F.col("mass") / F.sum("mass").over(w))
    scored = normal.join(coefficients, ["protocol", "os"]).groupBy("src_ip", "target").agg(F.sum(F.col("mass") * F.col("weight")).alias("z"))
    host = Window.partitionBy("src_ip")
    e = F.exp(F.col("z") - F.max("z").over(host))
    p = scored.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(host))
    first = p.withColumn("r", F.row_number().over(host.orderBy(F.desc("p"), "target"))).filter("r = 1")
    return first.select("src_ip", F.col("target").alias("os"), "p")


def distinct_names(names: DataFrame) -> DataFrame:
    """Distinct server names (protocol, name) by protocol, trailing dots off."""
    return names.groupBy("protocol").agg(F.countDistinct(bare_name(F.col("name"))).alias("n_names"))


def names_not_in(names: DataFrame, protocol: str, other: str) -> DataFrame:
    """Names of one protocol that the other has not."""
    rows = names.select("protocol", bare_name(F.col("name")).alias("name"))
    mine = rows.filter(F.col("protocol") == protocol).select("name").distinct()
    return mine.join(rows.filter(F.col("protocol") == other).select("name").distinct(), "name", "left_anti")


def correlation_object(records: DataFrame, *keep: str) -> DataFrame:
    """The flat projection by which records of several observers are matched, behind the columns to keep."""
    return records.select(
        *keep, "src_ip", "dst_ip", "src_port", "dst_port", F.coalesce("protocol", F.lit(6)).alias("protocol"), "ip_id", "tls_random", "tls_sni",
        "http_host", "http_xff", "dns_id", F.array_join("dns_names", ";").alias("dns_names"),
    )


def mean_and_deviation(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """G13."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"))


def key_groups(certs: DataFrame, key: str, order: str) -> DataFrame:
    """Certs with `key_group`, numbered by first sighting, and how many share the key.

    First sightings are one row for each distinct key; they are numbered range by range.
    """
    firsts = certs.groupBy(key).agg(F.min(order).alias("__fq_first"), F.count(F.lit(1)).alias("key_count"))
    numbered = dense_codes(firsts, "__fq_first", "key_group")
    return certs.join(numbered.drop("__fq_first"), key)


def dense_codes(rows: DataFrame, col: str, out: str) -> DataFrame:
    """Rows with a dense code 0, 1, ... in the order of a unique column.

    Ranges of values are numbered on their own and shifted by the counts of the ranges before.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.stat.approxQuantile(col, [i / n for i in range(1, n)], 0.001) if n > 1 else []
    bucket = F.lit(0)
    for b in sorted(set(bounds)):
        bucket = bucket + (F.col(col) > b).cast("int")
    dealt = rows.withColumn("__fq_b", bucket)
    sizes = dealt.groupBy("__fq_b").agg(F.count(F.lit(1)).alias("__fq_n"))
    before = Window.orderBy("__fq_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = sizes.select("__fq_b", F.coalesce(F.sum("__fq_n").over(before), F.lit(0)).alias("__fq_s"))
    inside = F.row_number().over(Window.partitionBy("__fq_b").orderBy(col)) - 1
    return dealt.withColumn("__fq_i", inside).join(shifts, "__fq_b").withColumn(out, F.col("__fq_s") + F.col("__fq_i")).drop("__fq_b", "__fq_i", "__fq_s")
