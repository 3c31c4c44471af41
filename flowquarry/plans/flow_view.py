"""A deterministic flow table over the supplied tables, and its SQL twin.

The supplied tables hold no packets, so each event becomes one flow to the host of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.session import table

FLOW_SQL = r"""flow AS (SELECT e.event_id, e.ts, e.user_id, e.event_type,
  '10.' || (user_id % 4) || '.' || (user_id % 16) || '.' || (user_id % 250) AS src_ip,
  (11 + event_id % 180) || '.' || (event_id % 7) || '.' || (event_id % 11) || '.' || (event_id % 251) AS dst_ip,
  regexp_extract(p.url, '^[a-z]+://([^/:?#]+)', 1) AS sni,
  CAST(1024 + user_id % 5000 AS INTEGER) AS src_port,
  CAST(CASE event_type WHEN 'error' THEN 80 WHEN 'signup' THEN 8443 WHEN 'click' THEN 9001 ELSE 443 END AS INTEGER) AS dst_port,
  CASE event_type WHEN 'view' THEN 'tls/1/(0303)(1301130' || (user_id % 5) || ')[(0000)(000a000400020017)(000b00020100)]'
    WHEN 'purchase' THEN 'tls/(0303)(0a0ac02bc02' || (user_id % 5) || ')((0000)(0017)(ff01000100))'
    WHEN 'click' THEN 'quic/(00000001)(0303)(130' || (user_id % 5) || ')[(0000)(0010)]'
    WHEN 'signup' THEN 'http/(474554)(485454502f312e31)((486f737' || (user_id % 5) || '))'
    ELSE 'stun/1/(00)(01)(2112a442)((802' || (user_id % 5) || '))' END AS fp,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'agent/' || (user_id % 7) END AS ua,
  'proc' || (user_id % 6) AS process
FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: addresses, server name, ports, fingerprint, user agent and process."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("sni"))
    n = pages.count()
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    u, i = F.col("user_id"), F.col("event_id")

    def dotted(*parts) -> F.Column:
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    k = (u % 5).cast("string")
    kind = F.col("event_type")
    fp = (
        F.when(kind == "view", F.concat(F.lit("tls/1/(0303)(1301130"), k, F.lit(")[(0000)(000a000400020017)(000b00020100)]")))
        .when(kind == "purchase", F.concat(F.lit("tls/(0303)(0a0ac02bc02"), k, F.lit(")((0000)(0017)(ff01000100))")))
        .when(kind == "click", F.concat(F.lit("quic/(00000001)(0303)(130"), k, F.lit(")[(0000)(0010)]")))
        .when(kind == "signup", F.concat(F.lit("http/(474554)(485454502f312e31)((486f737"), k, F.lit("))")))
        .otherwise(F.concat(F.lit("stun/1/(00)(01)(2112a442)((802"), k, F.lit("))")))
    )
    port = F.when(kind == "error", 80).when(kind == "signup", 8443).when(kind == "click", 9001).otherwise(443)
    return (
        events.withColumn("page_id", i % n)
        .join(pages, "page_id")
        .select(
            "event_id", "ts", "user_id", "event_type",
            dotted(F.lit(10), u % 4, u % 16, u % 250).alias("src_ip"),
            dotted(11 + i % 180, i % 7, i % 11, i % 251).alias("dst_ip"),
            "sni",
            (1024 + u % 5000).cast("int").alias("src_port"),
            port.cast("int").alias("dst_port"),
            fp.alias("fp"),
            F.when(u % 3 != 0, F.concat(F.lit("agent/"), (u % 7).cast("string"))).alias("ua"),
            F.concat(F.lit("proc"), (u % 6).cast("string")).alias("process"),
        )
    )


SUBNET_SQL = """subnet AS (SELECT net, len, min(asn) AS asn, min(domain) AS domain, max(exempt) AS exempt FROM (
  SELECT CAST((((11 + s_suppkey % 180) * 256 + s_suppkey % 7) * 256 + s_suppkey % 11) * 256 AS BIGINT) // CAST(pow(2, 32 - len) AS BIGINT) * CAST(pow(2, 32 - len) AS BIGINT) AS net, len,
    64500 + s_suppkey AS asn, 'd' || (s_suppkey % 5) || '.example.com' AS domain, CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS exempt
  FROM (SELECT s_suppkey, CAST(CASE s_suppkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 24 END AS INTEGER) AS len FROM supplier)) GROUP BY net, len)"""


def subnets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes with a system number, a domain and an exception flag, from the suppliers."""
    k = F.col("s_suppkey")
    size = F.when(k % 3 == 0, 8).when(k % 3 == 1, 16).otherwise(24)
    net = (((11 + k % 180) * 256 + k % 7) * 256 + k % 11) * 256
    return (
        table(spark, sf_dir, "supplier")
        .select(
            F.shiftleft(F.expr("shiftright((((11 + s_suppkey % 180) * 256 + s_suppkey % 7) * 256 + s_suppkey % 11) * 256, 32 - CASE s_suppkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 24 END)"), 0).alias("short"),
            size.alias("len"), (64500 + k).alias("asn"),
            F.concat(F.lit("d"), (k % 5).cast("string"), F.lit(".example.com")).alias("domain"),
            F.when(k % 10 == 0, 1).otherwise(0).alias("exempt"), net.alias("_net"),
        )
        .select(F.expr("shiftleft(short, 32 - len)").alias("net"), "len", "asn", "domain", "exempt")
        .groupBy("net", "len")
        .agg(F.min("asn").alias("asn"), F.min("domain").alias("domain"), F.max("exempt").alias("exempt"))
    )
