"""Resource archives and code tables."""

from __future__ import annotations

import gzip
import io
import json
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.ip import normalize_ip
from flowquarry.functions.names import normalize_server_name
from flowquarry.operators.lookup import fingerprint_aliases
from flowquarry.operators.resources import CLASSES, version_ok
from flowquarry.parse.aes import Aes

#: Members of an archive and the tables that they become.
MEMBERS = {
    "fingerprint_db": "models", "fp_prevalence_tls": "prevalence", "doh-watchlist": "watchlist", "pyasn": "asn", "domain-mappings": "mappings", "VERSION": "version",
}
MODEL = (
    "str_repr string, str_repr_array array<string>, fp_type string, total_count long, feature_weights struct<as:double,domain:double,port:double,ip:double,sni:double,ua:double>,"
    " process_info array<struct<process:string,count:long,malware:boolean,attributes:map<string,boolean>,os_info:map<string,long>,classes_hostname_domains:map<string,long>,"
    "classes_hostname_sni:map<string,long>,classes_port_port:map<string,long>,classes_ip_as:map<string,long>,classes_ip_ip:map<string,long>,classes_user_agent:map<string,long>>>"
)


def archive_lines(data: bytes, key: bytes | None = None) -> dict[str, list[str]]:
    """The lines of each known member of a tar, a gzipped tar, or one that is encrypted with a key as well."""
    if key is not None:
        data = Aes(key).cbc_decrypt(data[16:], data[:16])
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out: dict[str, list[str]] = {}
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for member in tar:
            name = member.name.rpartition("/")[2]
            own = next((v for k, v in MEMBERS.items() if name.startswith(k)), None)
            if own and member.isfile():
                text = tar.extractfile(member).read()
                text = gzip.decompress(text) if name.endswith(".gz") else text
                out[own] = text.decode("utf-8", "replace").splitlines()
    return out


def tables(spark: SparkSession, lines: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Spark tables of an archive's members; the version must fit.

    An archive is one file that its users load whole; its size is that of the archive.
    """
    if not version_ok("".join(lines.get("version", []))):
        raise ValueError("the archive's version has no single qualifier lite, full or dual")
    out: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        return spark.createDataFrame([(i, x) for i, x in enumerate(lines.get(name, [])) if x.strip()], "i long, value string")

    out["models"] = frame("models").select(F.col("i").alias("model"), F.from_json("value", MODEL).alias("m")).select("model", "m.*")
    fp = F.when(F.startswith("value", F.lit("(")), F.concat(F.lit("tls/"), "value")).otherwise(F.col("value"))
    out["prevalence"] = frame("prevalence").select(fp.alias("fp"))
    out["watchlist"] = watchlist(frame("watchlist"))
    out["asn"] = prefixes(frame("asn").select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.col("p")[0].alias("subnet"), F.col("p")[1].try_cast("long").alias("asn")))
    m = frame("mappings").select(F.from_json("value", "subnet string, type string, tag string").alias("m")).select("m.*")
    m = m.filter(F.col("type").isin("domain_mapping", "proxy", "sinkhole"))
    out["mappings"] = prefixes(m.select("subnet", F.when(F.col("type") == "domain_mapping", F.col("tag")).alias("domain"), (F.col("type") != "domain_mapping").cast("int").alias("exempt")))
    return out


def read_archive(spark: SparkSession, path: str, key: bytes | None = None) -> dict[str, DataFrame]:
    """The tables of an archive on any file system that Spark reads, with processes and features beside the models."""
    data = spark.read.format("binaryFile").load(path).select("content").first()
    if data is None:
        raise FileNotFoundError(path)
    out = tables(spark, archive_lines(bytes(data[0]), key))
    return out | dict(zip(("processes", "features"), model_tables(out["models"]), strict=True))


def model_tables(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classifier's processes and features of an archive's models, under every name of a fingerprint.

    Counts of values that are equal once normalised are added up (G9).
    """
    named = fingerprint_aliases(models).join(models, "model").select("fp", F.col("total_count").alias("total"), F.posexplode("process_info").alias("proc_idx", "p"))
    processes = named.select("fp", "p.process", "proc_idx", "p.count", "total", F.coalesce("p.malware", F.lit(False)).alias("malware"), "p.os_info")

    def counts(feature: str, column: str) -> Column:
        entries = F.map_entries(F.coalesce(f"p.{column}", F.create_map().cast("map<string,long>")))
        return F.transform(entries, lambda e: F.struct(F.lit(feature).alias("feature"), e["key"].alias("value"), e["value"].alias("count")))

    values = [counts(feature, column) for feature, column in CLASSES.items()]
    rows = named.select("fp", "p.process", F.explode(F.concat(*values)).alias("v")).select("fp", "process", "v.*")
    value = F.when(F.col("feature") == "sni", normalize_server_name(F.col("value"), detail=True)).when(F.col("feature") == "ip", normalize_ip(F.col("value"))).otherwise(F.col("value"))
    features = rows.withColumn("value", value).groupBy("fp", "process", "feature", "value").agg(F.sum("count").alias("count"))
    return processes, features


def watchlist(rows: DataFrame) -> DataFrame:
    """(kind, value): addresses and names, without comments."""
    value = F.trim("value")
    kind = F.when(value.rlike(r"^[0-9.]+$") | F.contains(value, F.lit(":")), "address").otherwise("name")
    return rows.filter(~F.startswith(value, F.lit("#")) & (value != "")).select(kind.alias("kind"), value.alias("value"))


def prefixes(rows: DataFrame) -> DataFrame:
    """IPv4 rows with a subnet, as net and len; the other columns stay."""
    from flowquarry.functions.ip import v4_to_int

    part = F.split("subnet", "/")
    out = rows.filter(F.contains("subnet", F.lit("."))).withColumn("len", F.coalesce(F.get(part, F.lit(1)).try_cast("int"), F.lit(32)))
    net = F.expr("shiftleft(shiftright(__fq_n, 32 - len), 32 - len)")
    return out.withColumn("__fq_n", v4_to_int(F.get(part, F.lit(0)))).filter("__fq_n is not null and len between 0 and 32").withColumn("net", net).drop("__fq_n", "subnet")


def code_table(spark: SparkSession, path: str, code: str, name: str) -> DataFrame:
    """(code, name) of a CSV file; codes may be hexadecimal, and ranges or reserved rows are dropped."""
    rows = spark.read.option("header", True).option("comment", "/").csv(path)
    c = F.trim(F.col(code))
    value = F.when(c.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substring(c, 3, 16), 16, 10)).when(c.rlike(r"^\d+$"), c)
    return rows.select(value.cast("long").alias("code"), F.trim(F.col(name)).alias("name")).filter("code is not null and name is not null")


def parse_lines(text: str) -> list[dict]:
    """S9 for text already in memory: JSON lines; those that are none are skipped."""
    out = []
    for line in text.splitlines():
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return out
