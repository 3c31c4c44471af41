"""Building and checking resource tables (S8, G8, G9, B6, VERSION rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.ip import normalize_ip
from flowquarry.functions.names import normalize_server_name, registered_domain

#: Default feature weights.
WEIGHTS = {"as": 0.13924, "domain": 0.15590, "port": 0.00528, "ip": 0.56735, "sni": 0.96941, "ua": 1.0}

#: The names of the features' counts in a resource file.
CLASSES = {"domain": "classes_hostname_domains", "sni": "classes_hostname_sni", "port": "classes_port_port", "as": "classes_ip_as", "ip": "classes_ip_ip", "ua": "classes_user_agent"}


def feature_values(flows: DataFrame, *keep: str) -> DataFrame:
    """Long form: the columns keep, and (feature, value) for each of the six features of a flow with `asn`."""
    flows = flows.withColumn("__fq_name", normalize_server_name(F.coalesce("sni", F.lit("None")), detail=True))
    name = F.col("__fq_name")
    pairs = {
        "as": F.col("asn").cast("string"),
        "domain": registered_domain(name),
        "port": F.col("dst_port").cast("string"),
        "ip": normalize_ip(F.col("dst_ip")),
        "sni": name,
        "ua": F.coalesce("ua", F.lit("")),
    }
    return flows.select(*keep, F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in pairs.items()])).alias("f")).select(
        *keep, "f.feature", "f.value"
    )


def build_processes(flows: DataFrame) -> DataFrame:
    """(fp, process, proc_idx, count, total): how often each process has shown each fingerprint."""
    counts = flows.groupBy("fp", "process").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("fp").agg(
        F.sum("count").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "process"))).alias("order")
    )
    placed = totals.select("fp", "total", F.posexplode("order").alias("proc_idx", "p"))
    return placed.select("fp", F.col("p.process").alias("process"), "proc_idx", (-F.col("p.n")).alias("count"), "total")


def build_features(flows: DataFrame) -> DataFrame:
    """(fp, process, feature, value, count); equal normalised values are summed before any logarithm."""
    return feature_values(flows, "fp", "process").groupBy("fp", "process", "feature", "value").agg(F.count(F.lit(1)).alias("count"))


def prevalence(flows: DataFrame, top: int = 1000) -> DataFrame:
    """The TLS fingerprints seen most; a top-k report."""
    tls = flows.filter(F.startswith("fp", F.lit("tls/")))
    return tls.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fp").limit(top)


def version_ok(text: str) -> bool:
    """A resource version has exactly one qualifier behind a semicolon, and it is lite, full or dual."""
    parts = text.strip().split(";")
    return len(parts) == 2 and any(q in parts[1] for q in ("lite", "full", "dual"))


def fp_db_json(processes: DataFrame, features: DataFrame) -> DataFrame:
    """One JSON line for each fingerprint, with process_info and all value counts, the ASN's too."""
    maps = features.groupBy("fp", "process").agg(
        *[
            F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("feature") == k, F.struct("value", "count"))))).alias(v)
            for k, v in CLASSES.items()
        ]
    )
    rows = processes.join(maps, ["fp", "process"]).groupBy("fp").agg(
        F.first("total").alias("total_count"),
        F.collect_list(F.struct("process", "count", *CLASSES.values())).alias("process_info"),
    )
    return rows.select(F.to_json(F.struct(F.col("fp").alias("str_repr"), F.substring_index("fp", "/", 1).alias("fp_type"), "total_count", "process_info")).alias("value"))
