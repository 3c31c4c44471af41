"""Weighted naive-Bayes classification of flows.

A model is two tables: processes (fp, process, proc_idx, count, total, and optionally malware and
attributes) and features (fp, process, feature, value, count). Scoring is an equi-join on the model,
another on (model, feature, value), and one aggregation by flow and process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.operators.resources import WEIGHTS, feature_values

GENERIC_DMZ = "generic dmz process"


def _weight(weights: dict[str, float], feature: Column) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(feature == name, F.lit(float(w))).otherwise(out)
    return out


def base_prior(total: Column) -> Column:
    """C1."""
    return F.log(F.lit(0.1) / total)


def priors(processes: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Processes with `prior`."""
    share = F.log(F.col("count") / F.col("total"))
    return processes.withColumn("prior", F.greatest(share, F.log(F.lit(0.1))) + base_prior(F.col("total")) * F.lit(float(sum(weights.values()))))


def updates(processes: DataFrame, features: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(fp, process, feature, value, upd): what a hit adds to a process's score."""
    totals = processes.select("fp", "total").distinct()
    upd = (F.log(F.col("count") / F.col("total")) - base_prior(F.col("total"))) * _weight(weights, F.col("feature"))
    return features.join(totals, "fp").select("fp", "process", "feature", "value", upd.alias("upd"))


def scores(flows: DataFrame, processes: DataFrame, features: DataFrame, weights: dict[str, float] = WEIGHTS, minimize: bool = False, key: str = "event_id") -> DataFrame:
    """(key, fp, process, proc_idx, score) for every process of a flow's fingerprint.

    Other weights give another model of the same counts. minimize leaves the address out.
    """
    weights = {k: v for k, v in weights.items() if not (minimize and k == "ip")} if minimize else weights
    seen = feature_values(flows, key, "fp")
    hits = seen.join(updates(processes, features, weights), ["fp", "feature", "value"]).groupBy(key, "fp", "process").agg(F.sum("upd").alias("upd"))
    every = flows.select(key, "fp").join(priors(processes, weights), "fp")
    return every.join(hits, [key, "fp", "process"], "left").select(
        *every.columns, (F.col("prior") + F.coalesce("upd", F.lit(0.0))).alias("score")
    )


def probabilities(scored: DataFrame, key: str = "event_id") -> DataFrame:
    """Scored with `p`, the softmax, and `rank`; the first process wins ties."""
    w = Window.partitionBy(key)
    e = F.exp(F.col("score") - F.max("score").over(w))
    ranked = scored.withColumn("e", e).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "proc_idx")))
    return ranked.withColumn("p", F.col("e") / F.sum("e").over(w))


def classify(scored: DataFrame, tags: list[str] = (), key: str = "event_id", carry: list[str] = ()) -> DataFrame:
    """One row per flow: process, score, p_malware, and p_<tag> of the winner's tags.

    scored may have boolean columns malware and one for each tag. If the winner is the generic dmz
    process, and malware labels exist, and the second is no malware, the second wins, and
    probabilities other than p_malware are shares of what is left. carry names columns of scored,
    such as os_info (C14), of which the winner's values are kept.
    """
    ranked = probabilities(scored, key)
    bad = F.col("malware") if "malware" in scored.columns else F.lit(False)
    labels = "malware" in scored.columns
    rows = ranked.groupBy(key).agg(
        F.sum("e").alias("sum"),
        F.sum(F.when(F.col("rank") != 1, F.col("e")).otherwise(0.0)).alias("rest"),
        F.sum(F.when(bad, F.col("e")).otherwise(0.0)).alias("bad"),
        F.max(bad).alias("any_bad"),
        # one row has the rank; first takes columns that have no order, too
        *[F.first(F.when(F.col("rank") == n, F.struct("process", "e", bad.alias("malware"), *tags, *carry)), ignorenulls=True).alias(name) for n, name in ((1, "top"), (2, "next"))],
        *[F.sum(F.when(F.col(t), F.col("e")).otherwise(0.0)).alias(f"sum_{t}") for t in tags],
        *[F.sum(F.when(F.col(t) & (F.col("rank") != 1), F.col("e")).otherwise(0.0)).alias(f"rest_{t}") for t in tags],
    )
    swap = F.lit(labels) & (F.col("top.process") == GENERIC_DMZ) & F.col("next").isNotNull() & ~F.col("next.malware")
    win = F.when(swap, F.col("next")).otherwise(F.col("top"))
    total = F.when(swap, F.col("rest")).otherwise(F.col("sum"))
    out = [
        F.col(key),
        win["process"].alias("process"),
        F.when(total > 0, win["e"] / total).otherwise(win["e"]).alias("score"),
        win["malware"].alias("malware"),
        (F.col("bad") / F.col("sum")).alias("p_malware"),
    ]
    out += [win[c].alias(c) for c in carry]
    for t in tags:
        mass = F.when(swap, F.col(f"rest_{t}")).otherwise(F.col(f"sum_{t}"))
        out.append(F.when(win[t], F.when(total > 0, mass / total).otherwise(mass)).alias(f"p_{t}"))
    return rows.select(*out)


def reclassify_rows(records: DataFrame) -> DataFrame:
    """Saved JSON records as classifier input, by kind of fingerprint, with None where a name is absent."""
    fps = F.col("fingerprints")
    kinds = records.schema["fingerprints"].dataType.names

    def of(kind: str, name: str, agent: str) -> Column:
        if kind not in kinds:
            return F.lit(None).cast("struct<fp:string,sni:string,ua:string>")
        fp = F.when(F.startswith(fps[kind], F.lit("(")), F.concat(F.lit(f"{kind}/"), fps[kind])).otherwise(fps[kind])
        return F.when(
            fps[kind].isNotNull(),
            F.struct(fp.alias("fp"), F.coalesce(F.get_json_object("doc", name), F.lit("None")).alias("sni"), F.coalesce(F.get_json_object("doc", agent), F.lit("None")).alias("ua")),
        )

    doc = records.withColumn("doc", F.to_json(F.struct("*")))
    found = F.coalesce(
        of("tls", "$.tls.client.server_name", "$.none"),
        of("http", "$.http.request.host", "$.http.request.user_agent"),
        of("quic", "$.tls.client.server_name", "$.quic.user_agent"),
    )
    return doc.withColumn("f", found).filter("f is not null").select(
        "event_start", "src_ip", "dst_ip", "src_port", "dst_port", "f.fp", "f.sni", "f.ua"
    )
