"""One object for the usual steps: configuration, records, analysis and statistics (the public API)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators import classify, detect, lookup, packets, resources, stats
from flowquarry.sources.archive import read_archive
from flowquarry.sources.pcap import read_pcap


@dataclass
class Config:
    """What a configuration string can say."""

    select: str = "all"
    resources: str = ""
    format: str = "tls,quic"
    reassembly: bool = False
    metadata: bool = False
    minimize_ram: bool = False
    stats: bool = False
    dns_json: bool = False
    certs_json: bool = False
    crypto_assess: str = ""
    raw_features: str = ""
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        """`key=value;key;...`: a key alone is true. Unknown keys are kept in `extra`."""
        out = cls()
        for part in filter(None, (p.strip() for p in text.split(";"))):
            key, mark, value = part.partition("=")
            key = key.strip().replace("-", "_")
            if key == "extra" or not hasattr(out, key):
                out.extra[key] = value.strip() if mark else "true"
            elif isinstance(getattr(out, key), bool):
                setattr(out, key, not mark or value.strip().lower() in ("1", "true", "yes", "on"))
            else:
                setattr(out, key, value.strip())
        return out


class Engine:
    """Records, analysis and statistics with one set of resource tables."""

    def __init__(self, spark: SparkSession, config: Config | str = "", tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.config = Config.parse(config) if isinstance(config, str) else config
        self.tables = dict(tables or {})
        if self.config.resources:
            self.tables = read_archive(spark, self.config.resources) | self.tables

    def packets(self, path: str) -> DataFrame:
        return read_pcap(self.spark, path)

    def records(self, rows: DataFrame) -> DataFrame:
        """Parsed records of packets; with `reassembly`, of messages over several segments or datagrams too."""
        parse = packets.parse_reassembled if self.config.reassembly else packets.parse_packets
        return parse(rows, self.config.select, self.config.format, dns_json=self.config.dns_json, certs_json=self.config.certs_json)

    def lines(self, records: DataFrame) -> DataFrame:
        return records.select(packets.record_json(self.config.metadata).alias("value"))

    def model(self, labelled: DataFrame) -> None:
        """Builds the classifier's tables from labelled flows."""
        rows = lookup.with_asn(labelled, self.tables["asn"]) if "asn" in self.tables else labelled.withColumn("asn", F.lit(0))
        self.tables["processes"], self.tables["features"] = resources.build_processes(rows), resources.build_features(rows)

    def analyze(self, flows: DataFrame, weights: dict[str, float] | None = None, key: str = "event_id") -> DataFrame:
        """flows with the status of their fingerprint, and process, score and malware probability where a model has it.

        Models with os_info add the winner's. Columns of those names that flows come with are replaced.
        """
        rows = lookup.with_asn(flows, self.tables["asn"]) if "asn" in self.tables else flows.withColumn("asn", F.lit(0))
        processes = self.tables["processes"]
        prevalent = self.tables.get("prevalence", processes.select("fp").limit(0))
        rows = lookup.with_status(rows, processes, prevalent, ["tls", "http", "quic"])
        scored = classify.scores(rows, processes, self.tables["features"], weights or resources.WEIGHTS, self.config.minimize_ram, key)
        carry = [c for c in ("os_info",) if c in processes.columns]
        return rows.drop("asn", "process", "score", "malware", "p_malware", *carry).join(classify.classify(scored, key=key, carry=carry), key, "left")

    def detailed(self, flows: DataFrame, key: str = "event_id") -> DataFrame:
        """Every process of a flow's fingerprint with its probability."""
        rows = lookup.with_asn(flows, self.tables["asn"]) if "asn" in self.tables else flows.withColumn("asn", F.lit(0))
        return classify.probabilities(classify.scores(rows, self.tables["processes"], self.tables["features"], key=key), key)

    def detect(self, flows: DataFrame) -> DataFrame:
        """flows with encrypted_dns and domain_faking, as far as there are tables for them."""
        out = flows
        if "watchlist" in self.tables:
            out = detect.encrypted_dns(out, self.tables["watchlist"])
        if "mappings" in self.tables:
            out = lookup.with_domain_faking(out, self.tables["mappings"])
        return out

    def stats(self, flows: DataFrame) -> DataFrame:
        """The nested statistics of each source."""
        return stats.nested_stats(stats.count_events(stats.fingerprint_events(flows)))
