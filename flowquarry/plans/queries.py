"""The engine's registered queries over the supplied tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions import fingerprints as fpf
from flowquarry.functions import ip, names, text
from flowquarry.operators import classify, detect, gcd, lookup, resources, state, stats, strings
from flowquarry.plans.flow_view import FLOW_SQL, SUBNET_SQL, flows, subnets
from flowquarry.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


FLOW = f"WITH {FLOW_SQL}"
V4_SQL = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"


def ip_sql(col: str) -> str:
    return " + ".join(f"CAST(split_part({col}, '.', {i + 1}) AS BIGINT) * {1 << (24 - 8 * i)}" for i in range(4))


def private_sql(col: str) -> str:
    n = ip_sql(col)
    return f"(({n}) BETWEEN 167772160 AND 184549375 OR ({n}) BETWEEN 2886729728 AND 2887778303 OR ({n}) BETWEEN 3232235520 AND 3232301055)"


def norm_ip_sql(col: str) -> str:
    return f"CASE WHEN {private_sql(col)} THEN '10.0.0.1' ELSE {col} END"


# --- scalar functions -------------------------------------------------------------------------------

_FORMS = """forms AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN sni WHEN 1 THEN sni || ':8443' WHEN 2 THEN dst_ip WHEN 3 THEN src_ip || ':53'
  WHEN 4 THEN split_part(sni, '.', 1) WHEN 5 THEN '' WHEN 6 THEN sni || '.' ELSE '@' || sni END AS name FROM flow)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 8
    name = (
        F.when(k == 0, F.col("sni")).when(k == 1, F.concat("sni", F.lit(":8443"))).when(k == 2, F.col("dst_ip"))
        .when(k == 3, F.concat("src_ip", F.lit(":53"))).when(k == 4, F.substring_index("sni", ".", 1)).when(k == 5, F.lit(""))
        .when(k == 6, F.concat("sni", F.lit("."))).otherwise(F.concat(F.lit("@"), "sni"))
    )
    return flows(spark, sf_dir).select("event_id", name.alias("name"))


_HOST_SQL = r"regexp_extract(name, '^([A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*)\.?(:\d+.*)?$', 1)"


def _norm_name_sql(detail: bool) -> str:
    port = "CASE WHEN regexp_extract(name, ':(\\d+)', 1) <> '' THEN '_' || regexp_extract(name, ':(\\d+)', 1) || '.' ELSE '' END" if detail else "''"
    addr = f"replace({norm_ip_sql('v4')}, '.', '-') || '.'" if detail else "''"
    return rf"""{FLOW}, {_FORMS}, h AS (SELECT *, {_HOST_SQL} AS host, regexp_extract(name, '^({V4_SQL})(:\d+)?$', 1) AS v4 FROM forms)
SELECT event_id, CASE WHEN name = '' THEN 'missing.alt' WHEN v4 <> '' THEN {port} || {addr} || 'address.alt'
  WHEN host <> '' AND NOT contains(host, '.') THEN {port} || 'unqualified.alt' WHEN host <> '' THEN {port} || host ELSE 'other.alt' END AS normalized FROM h"""


@query("normalize_server_name", _norm_name_sql(False))
def normalize_server_name(spark, sf_dir):
    return _forms(spark, sf_dir).select("event_id", names.normalize_server_name(F.col("name")).alias("normalized"))


@query("normalize_server_name_detail", _norm_name_sql(True))
def normalize_server_name_detail(spark, sf_dir):
    return _forms(spark, sf_dir).select("event_id", names.normalize_server_name(F.col("name"), detail=True).alias("normalized"))


@query("server_port", rf"{FLOW}, {_FORMS} SELECT event_id, CAST(nullif(regexp_extract(name, ':(\d+)$', 1), '') AS INTEGER) AS port FROM forms")
def server_port(spark, sf_dir):
    return _forms(spark, sf_dir).select("event_id", names.server_port(F.col("name")).alias("port"))


@query(
    "registered_domain",
    rf"""{FLOW} SELECT event_id, CASE WHEN len(string_split(sni, '.')) > 2 THEN array_to_string(string_split(sni, '.')[-2:], '.') ELSE sni END AS domain,
  CASE WHEN len(string_split(sni, '.')) > 2 THEN array_to_string(string_split(sni, '.')[-2:], '.') WHEN contains(sni, '.') THEN '.' || string_split(sni, '.')[-1] ELSE '' END AS legacy FROM flow""",
)
def registered_domain(spark, sf_dir):
    return flows(spark, sf_dir).select("event_id", names.registered_domain(F.col("sni")).alias("domain"), names.legacy_domain(F.col("sni")).alias("legacy"))


@query(
    "ip_functions",
    f"""{FLOW} SELECT event_id, {ip_sql('dst_ip')} AS dst_int, {private_sql('src_ip')} AS src_private, {private_sql('dst_ip')} AS dst_private,
  {norm_ip_sql('src_ip')} AS src_norm, {norm_ip_sql('dst_ip')} AS dst_norm, replace(dst_ip, '.', '-') AS label FROM flow""",
)
def ip_functions(spark, sf_dir):
    src, dst = F.col("src_ip"), F.col("dst_ip")
    return flows(spark, sf_dir).select(
        "event_id", ip.v4_to_int(dst).alias("dst_int"), ip.is_private_v4(ip.v4_to_int(src)).alias("src_private"),
        ip.is_private_v4(ip.v4_to_int(dst)).alias("dst_private"), ip.normalize_ip(src).alias("src_norm"), ip.normalize_ip(dst).alias("dst_norm"),
        F.translate(ip.int_to_v4(ip.v4_to_int(dst)), ".", "-").alias("label"),
    )


@query(
    "port_app",
    f"""{FLOW} SELECT dst_port, CASE dst_port WHEN 443 THEN 'https' WHEN 8443 THEN 'alt-https' WHEN 9001 THEN 'tor' ELSE 'unknown' END AS app,
  count(*) AS n FROM flow GROUP BY ALL""",
)
def port_app(spark, sf_dir):
    return flows(spark, sf_dir).groupBy("dst_port", text.port_app(F.col("dst_port")).alias("app")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fp_parts",
    rf"""{FLOW} SELECT event_id, split_part(fp, '/', 1) AS fp_type, CAST(coalesce(nullif(regexp_extract(fp, '^[^/]*/(\d+)/', 1), ''), '0') AS INTEGER) AS fp_version,
  substr(sha256(fp), 1, 32) AS fp_hash, CASE WHEN starts_with(fp, 'tls') THEN split_part(split_part(fp, '(', 3), ')', 1) WHEN starts_with(fp, 'quic') THEN split_part(split_part(fp, '(', 4), ')', 1) ELSE '' END AS suites,
  regexp_extract(fp, '^[^(]*', 0) || 'randomized' AS random_key FROM flow""",
)
def fp_parts(spark, sf_dir):
    fp = F.col("fp")
    return flows(spark, sf_dir).select(
        "event_id", fpf.fp_type(fp).alias("fp_type"), fpf.fp_version(fp).alias("fp_version"), fpf.fp_hash(fp).alias("fp_hash"),
        fpf.ciphersuites(fp).alias("suites"), fpf.randomized_key(fp).alias("random_key"),
    )


_HEXES = "hexes AS (SELECT event_id, printf('%x%xaa', event_id % 16, event_id % 11) AS raw FROM events)"


@query(
    "fp_degrease",
    """WITH c AS (SELECT event_id, lower(printf('%x', CAST(event_id % 16 AS INTEGER))) AS d FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '0a0a' ELSE d || 'b' || d || 'b' END || '1301' AS degreased FROM c""",
)
def fp_degrease(spark, sf_dir):
    d = F.lower(F.hex(F.col("event_id") % 16))
    odd = F.when(F.col("event_id") % 3 == 0, "a").otherwise("b")
    return table(spark, sf_dir, "events").select("event_id", fpf.degrease_hex(F.concat(d, odd, d, odd, F.lit("1301"))).alias("degreased"))


@query(
    "fp_sort_extensions",
    """WITH e AS (SELECT event_id, lower(printf('%x', CAST(event_id % 16 AS INTEGER))) AS d FROM events), x AS (SELECT event_id, unnest(['00' || d || '0', d || 'a' || d || 'a00', '0000', '00' || d || '1ff']) AS raw FROM e),
k AS (SELECT event_id, CASE WHEN regexp_full_match(substr(raw, 1, 4), '(0a0a|1a1a|2a2a|3a3a|4a4a|5a5a|6a6a|7a7a|8a8a|9a9a|aaaa|baba|caca|dada|eaea|fafa)') THEN '0a0a' ELSE substr(raw, 1, 4) END AS kind, length(raw) AS n, substr(raw, 5) AS rest FROM x)
SELECT event_id, '[' || string_agg('(' || kind || rest || ')', '' ORDER BY kind, n, kind || rest) || ']' AS sorted FROM k GROUP BY event_id""",
)
def fp_sort_extensions(spark, sf_dir):
    d = F.lower(F.hex(F.col("event_id") % 16))
    ext = F.array(F.concat(F.lit("00"), d, F.lit("0")), F.concat(d, F.lit("a"), d, F.lit("a00")), F.lit("0000"), F.concat(F.lit("00"), d, F.lit("1ff")))
    return table(spark, sf_dir, "events").select("event_id", fpf.sorted_extensions(ext).alias("sorted"))


@query("fp_well_formed", f"{FLOW} SELECT event_id, event_id % 2 = 0 AS ok FROM flow")
def fp_well_formed(spark, sf_dir):
    broken = F.when(F.col("event_id") % 2 == 0, F.col("fp")).otherwise(F.concat("fp", F.lit(")")))
    return flows(spark, sf_dir).select("event_id", fpf.is_well_formed(broken).alias("ok"))


@query(
    "fp_ja3",
    f"""{FLOW} SELECT event_id, CASE WHEN event_type = 'view' THEN '771,4865-' || (4864 + user_id % 5) || ',0-10-11,2-23,0' ELSE '771,49195-' || (49184 + user_id % 5) || ',0-23-65281,,' END AS ja3,
  md5(CASE WHEN event_type = 'view' THEN '771,4865-' || (4864 + user_id % 5) || ',0-10-11,2-23,0' ELSE '771,49195-' || (49184 + user_id % 5) || ',0-23-65281,,' END) AS ja3_hash
FROM flow WHERE event_type IN ('view', 'purchase')""",
)
def fp_ja3(spark, sf_dir):
    rows = flows(spark, sf_dir).filter(F.col("event_type").isin("view", "purchase"))
    return rows.select("event_id", fpf.ja3(F.col("fp")).alias("ja3"), fpf.ja3_hash(F.col("fp")).alias("ja3_hash"))


@query(
    "byte_profile",
    r"""SELECT event_id, CAST(strlen(props) AS BIGINT) AS n_bytes, CAST(length(regexp_replace(props, '[^\x20-\x7e]', '', 'g')) AS BIGINT) AS n_printable,
  CAST(length(regexp_replace(props, '[^\x21-\x7e]', '', 'g')) AS BIGINT) AS n_graphical, CAST(0 AS BIGINT) AS n_line_ends, CAST(len(r) AS BIGINT) AS n_runs,
  CAST(list_max(list_transform(r, lambda x: length(x))) AS BIGINT) AS longest_run, round(list_sum(list_transform(r, lambda x: length(x))) / len(r), 6) AS mean_run
FROM (SELECT event_id, props, list_filter(string_split(regexp_replace(props, '[^\x21-\x7e]+', ' ', 'g'), ' '), lambda x: x <> '') AS r FROM events)""",
)
def byte_profile(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.byte_profile(F.col("props")).alias("p")).select("event_id", "p.*")


@query("syslog_priority", "SELECT event_id, CAST(event_id % 192 // 8 AS INTEGER) AS facility, CAST(event_id % 192 % 8 AS INTEGER) AS severity FROM events")
def syslog_priority(spark, sf_dir):
    p = F.col("event_id") % 192
    return table(spark, sf_dir, "events").select("event_id", text.syslog_facility(p).alias("facility"), text.syslog_severity(p).alias("severity"))


@query(
    "encodings",
    "SELECT event_id, base64(encode(event_type)) AS b64, lower(hex(event_type)) AS hexed, sha1(event_type) AS s1, sha256(event_type) AS s2, event_type AS back FROM events",
)
def encodings(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.base64(t.cast("binary")).alias("b64"), F.lower(F.hex(t)).alias("hexed"), F.sha1(t).alias("s1"), F.sha2(t, 256).alias("s2"),
        F.unbase64(F.base64(t.cast("binary"))).cast("string").alias("back"),
    )


# --- lookups ----------------------------------------------------------------------------------------

_LPM = f"""{FLOW}, {SUBNET_SQL}, hit AS (SELECT event_id, max_by(s.asn, s.len) AS asn, max_by(s.domain, s.len) AS domain, max_by(s.exempt, s.len) AS exempt FROM flow f
  JOIN subnet s ON ({ip_sql('dst_ip')}) // CAST(pow(2, 32 - s.len) AS BIGINT) = s.net // CAST(pow(2, 32 - s.len) AS BIGINT) GROUP BY event_id)"""


@query("lpm_asn", f"{_LPM} SELECT f.event_id, CAST(coalesce(asn, 0) AS BIGINT) AS asn FROM flow f LEFT JOIN hit USING (event_id)")
def lpm_asn(spark, sf_dir):
    return lookup.with_asn(flows(spark, sf_dir), subnets(spark, sf_dir)).select("event_id", F.col("asn").cast("long").alias("asn"))


@query(
    "domain_faking",
    f"""{_LPM}, n AS (SELECT event_id, 'd' || (event_id % 7) || '.example.com' AS name FROM flow)
SELECT n.event_id, name IN (SELECT domain FROM subnet) AND NOT (coalesce(hit.domain = name, false) OR coalesce(hit.exempt = 1, false)) AS domain_faking FROM n LEFT JOIN hit USING (event_id)""",
)
def domain_faking(spark, sf_dir):
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "www.").otherwise(""), F.lit("d"), (F.col("event_id") % 7).cast("string"), F.lit(".example.com"))
    rows = flows(spark, sf_dir).withColumn("name", name)
    return lookup.with_domain_faking(rows, subnets(spark, sf_dir), "name").select("event_id", "domain_faking")


_SUFFIX = """s AS (SELECT reg AS suffix, max_by(v, seq) AS value FROM (SELECT array_to_string(string_split(h, '.')[-2:], '.') AS reg, 'R' || (page_id % 7) AS v, page_id AS seq FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages) WHERE page_id % 2 = 0) GROUP BY reg)"""


@query(
    "suffix_match",
    f"{FLOW}, {_SUFFIX} SELECT event_id, s.suffix, s.value FROM flow LEFT JOIN s ON s.suffix = array_to_string(string_split(sni, '.')[-2:], '.') AND contains(sni, '.')",
)
def suffix_match(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    own = table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select(
        F.substring_index(host, ".", -2).alias("suffix"), F.concat(F.lit("R"), (F.col("page_id") % 7).cast("string")).alias("value"), F.col("page_id").alias("seq")
    )
    return lookup.longest_suffix(flows(spark, sf_dir).select("event_id", "sni"), "sni", own).select("event_id", "suffix", "value")


_WATCH = "w AS (SELECT 'name' AS kind, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS value FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT 'address', (11 + s_suppkey % 180) || '.' || (s_suppkey % 7) || '.' || (s_suppkey % 11) || '.' || (s_suppkey % 251) FROM supplier)"


def _watchlist(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    hosts = table(spark, sf_dir, "pages").filter("page_id % 5 = 0").select(F.lit("name").alias("kind"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("value"))
    addr = F.concat_ws(".", *[x.cast("string") for x in (11 + k % 180, k % 7, k % 11, k % 251)])
    return hosts.union(table(spark, sf_dir, "supplier").select(F.lit("address").alias("kind"), addr.alias("value")))


@query(
    "encrypted_dns",
    f"""{FLOW}, {_WATCH} SELECT event_id, (sni IN (SELECT value FROM w WHERE kind = 'name') OR dst_ip IN (SELECT value FROM w WHERE kind = 'address')) AND split_part(fp, '/', 1) IN ('tls', 'quic') AS encrypted_dns FROM flow""",
)
def encrypted_dns(spark, sf_dir):
    return detect.encrypted_dns(flows(spark, sf_dir), _watchlist(spark, sf_dir)).select("event_id", "encrypted_dns")


@query("code_decode", "SELECT event_id, coalesce(n_name, lower(printf('%x', CAST(event_id % 40 AS INTEGER)))) AS name FROM events LEFT JOIN nation ON n_nationkey = event_id % 40")
def code_decode(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 40).alias("code"))
    return lookup.decode(rows, "code", codes, "name").select("event_id", "name")


_MODELS = "m AS (SELECT DISTINCT fp FROM flow WHERE event_id % 2 = 0 AND user_id % 5 < 3), p AS (SELECT fp FROM flow WHERE user_id % 5 = 3 GROUP BY fp)"


def _status_sql(first: bool) -> str:
    again = "row_number() OVER (PARTITION BY flow.fp ORDER BY ts, event_id) > 1" if first else "false"
    return f"""{FLOW}, {_MODELS} SELECT event_id, CASE WHEN m.fp IS NOT NULL THEN 'labeled' WHEN split_part(flow.fp, '/', 1) = 'stun' THEN 'unanalyzed'
  WHEN split_part(flow.fp, '/', 1) <> 'tls' THEN 'unlabeled' WHEN p.fp IS NOT NULL OR {again} THEN 'unlabeled' ELSE 'randomized' END AS status
FROM flow LEFT JOIN m ON flow.fp = m.fp LEFT JOIN p ON flow.fp = p.fp"""


def _status(spark, sf_dir, first: bool) -> DataFrame:
    rows = flows(spark, sf_dir)
    models = rows.filter("event_id % 2 = 0 and user_id % 5 < 3").select("fp").distinct()
    prevalent = rows.filter("user_id % 5 = 3").select("fp").distinct()
    return lookup.with_status(rows, models, prevalent, ["tls", "http", "quic"], first).select("event_id", "status")


@query("fp_lookup_status", _status_sql(False))
def fp_lookup_status(spark, sf_dir):
    return _status(spark, sf_dir, False)


@query("fp_status_first_seen", _status_sql(True))
def fp_status_first_seen(spark, sf_dir):
    return _status(spark, sf_dir, True)


@query("fp_prevalence_topk", f"{FLOW} SELECT fp, count(*) AS n FROM flow WHERE starts_with(fp, 'tls/') GROUP BY fp ORDER BY n DESC, fp LIMIT 1000")
def fp_prevalence_topk(spark, sf_dir):
    return resources.prevalence(flows(spark, sf_dir))


@query(
    "label_join_fallback",
    f"""{FLOW}, conn AS (SELECT src_ip, src_port, dst_ip, dst_port, min(process) AS process FROM flow WHERE event_id % 3 = 0 GROUP BY ALL),
alone AS (SELECT CAST(1024 + user_id % 5000 AS INTEGER) AS src_port, min('svc' || (user_id % 4)) AS process FROM events WHERE event_id % 7 = 0 GROUP BY 1),
pk AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN src_ip ELSE dst_ip END AS a, CASE WHEN event_id % 2 = 0 THEN src_port ELSE dst_port END AS ap,
  CASE WHEN event_id % 2 = 0 THEN dst_ip ELSE src_ip END AS b, CASE WHEN event_id % 2 = 0 THEN dst_port ELSE src_port END AS bp FROM flow)
SELECT event_id, coalesce(c1.process, c2.process, alone.process) AS process FROM pk LEFT JOIN conn c1 ON a = c1.src_ip AND ap = c1.src_port AND b = c1.dst_ip AND bp = c1.dst_port
LEFT JOIN conn c2 ON a = c2.dst_ip AND ap = c2.dst_port AND b = c2.src_ip AND bp = c2.src_port LEFT JOIN alone ON ap = alone.src_port""",
)
def label_join_fallback(spark, sf_dir):
    rows = flows(spark, sf_dir).withColumn("protocol", F.lit(6))
    conn = rows.filter("event_id % 3 = 0").select("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "process")
    alone = table(spark, sf_dir, "events").filter("event_id % 7 = 0").select(
        F.lit(None).cast("string").alias("src_ip"), (1024 + F.col("user_id") % 5000).cast("int").alias("src_port"), F.lit(None).cast("string").alias("dst_ip"),
        F.lit(None).cast("int").alias("dst_port"), F.lit(6).alias("protocol"), F.concat(F.lit("svc"), (F.col("user_id") % 4).cast("string")).alias("process"),
    )
    even = F.col("event_id") % 2 == 0
    swap = {"src_ip": "dst_ip", "src_port": "dst_port", "dst_ip": "src_ip", "dst_port": "src_port"}
    packets = rows.select("event_id", "protocol", *[F.when(even, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in swap.items()])
    return lookup.label_by_connection(packets, conn.union(alone)).select("event_id", "process")


@query(
    "record_diff",
    f"""{FLOW}, a AS (SELECT event_id, process FROM flow WHERE event_id % 5 <> 0), b AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'other' ELSE process END AS process FROM flow WHERE event_id % 7 <> 0)
SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'missing_left' WHEN b.event_id IS NULL THEN 'missing_right' WHEN a.process IS NOT DISTINCT FROM b.process THEN 'match' ELSE 'mismatch' END AS result
FROM a FULL JOIN b ON a.event_id = b.event_id""",
)
def record_diff(spark, sf_dir):
    rows = flows(spark, sf_dir).select("event_id", "process")
    right = rows.filter("event_id % 7 <> 0").withColumn("process", F.when(F.col("event_id") % 4 == 0, "other").otherwise(F.col("process")))
    return lookup.record_diff(rows.filter("event_id % 5 <> 0"), right, ["event_id"], "process")


# --- classification ---------------------------------------------------------------------------------

_W = ", ".join(f"('{k}', {v})" for k, v in resources.WEIGHTS.items())
_CUSTOM = {"as": 0.5, "domain": 0.25, "port": 0.1, "ip": 1.0, "sni": 1.5, "ua": 0.75}


def _nb_sql(weights: dict[str, float], tail: str) -> str:
    w = ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in weights.items())
    host = "CASE WHEN contains(sni, '.') THEN sni ELSE 'unqualified.alt' END"
    return f"""{_LPM}, fa AS (SELECT flow.*, coalesce(hit.asn, 0) AS asn FROM flow LEFT JOIN hit USING (event_id)), w(feature, w) AS (VALUES {w}),
fv AS (SELECT event_id, fp, process, unnest([{{'f': 'as', 'v': CAST(asn AS VARCHAR)}}, {{'f': 'domain', 'v': array_to_string(string_split({host}, '.')[-2:], '.')}}, {{'f': 'port', 'v': CAST(dst_port AS VARCHAR)}},
  {{'f': 'ip', 'v': dst_ip}}, {{'f': 'sni', 'v': {host}}}, {{'f': 'ua', 'v': coalesce(ua, '')}}]) AS x FROM fa),
pc AS (SELECT fp, process, count(*) AS count FROM flow WHERE event_id % 2 = 0 GROUP BY fp, process),
pt AS (SELECT fp, process, count, CAST(sum(count) OVER (PARTITION BY fp) AS BIGINT) AS total, row_number() OVER (PARTITION BY fp ORDER BY count DESC, process) - 1 AS proc_idx FROM pc),
ft AS (SELECT fp, process, x.f AS feature, x.v AS value, count(*) AS count FROM fv WHERE event_id % 2 = 0 GROUP BY ALL),
pr AS (SELECT *, greatest(ln(count / total), ln(0.1)) + ln(0.1 / total) * (SELECT sum(w) FROM w) AS prior FROM pt),
up AS (SELECT ft.fp, ft.process, ft.feature, value, (ln(ft.count / total) - ln(0.1 / total)) * w.w AS upd FROM ft JOIN pt ON ft.fp = pt.fp AND ft.process = pt.process JOIN w ON w.feature = ft.feature),
hs AS (SELECT event_id, fv.fp, up.process, sum(upd) AS upd FROM fv JOIN up ON fv.fp = up.fp AND x.f = up.feature AND x.v = up.value WHERE event_id % 2 = 1 GROUP BY ALL),
sc AS (SELECT f.event_id, f.fp, pr.process, pr.proc_idx, pr.prior + coalesce(hs.upd, 0) AS score FROM flow f JOIN pr ON f.fp = pr.fp LEFT JOIN hs ON hs.event_id = f.event_id AND hs.process = pr.process WHERE f.event_id % 2 = 1),
so AS (SELECT *, exp(score - max(score) OVER (PARTITION BY event_id)) AS e, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, proc_idx) AS rank FROM sc),
sp AS (SELECT *, e / sum(e) OVER (PARTITION BY event_id) AS p FROM so)
{tail}"""


def _model(spark, sf_dir):
    rows = lookup.with_asn(flows(spark, sf_dir), subnets(spark, sf_dir))
    train = rows.filter("event_id % 2 = 0")
    return rows, resources.build_processes(train), resources.build_features(train)


def _scored(spark, sf_dir, weights=resources.WEIGHTS):
    rows, processes, features = _model(spark, sf_dir)
    # scores that differ by rounding alone are ties
    return classify.scores(rows.filter("event_id % 2 = 1"), processes, features, weights).withColumn("score", F.round("score", 9))


@query("fpdb_processes", _nb_sql(resources.WEIGHTS, "SELECT fp, process, CAST(proc_idx AS INTEGER) AS proc_idx, CAST(count AS BIGINT) AS count, total FROM pt"))
def fpdb_processes(spark, sf_dir):
    return _model(spark, sf_dir)[1]


@query("fpdb_features", _nb_sql(resources.WEIGHTS, "SELECT fp, process, feature, value, CAST(count AS BIGINT) AS count FROM ft"))
def fpdb_features(spark, sf_dir):
    return _model(spark, sf_dir)[2]


@query("nb_priors", _nb_sql(resources.WEIGHTS, "SELECT fp, process, round(prior, 6) AS prior FROM pr"))
def nb_priors(spark, sf_dir):
    return classify.priors(_model(spark, sf_dir)[1]).select("fp", "process", F.round("prior", 6).alias("prior"))


@query("nb_scores", _nb_sql(resources.WEIGHTS, "SELECT event_id, process, round(score, 4) AS score FROM sc"))
def nb_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("event_id", "process", F.round("score", 4).alias("score"))


@query("nb_custom_weights", _nb_sql(_CUSTOM, "SELECT event_id, process, round(score, 4) AS score FROM sc"))
def nb_custom_weights(spark, sf_dir):
    return _scored(spark, sf_dir, _CUSTOM).select("event_id", "process", F.round("score", 4).alias("score"))


@query("nb_detailed", _nb_sql(resources.WEIGHTS, "SELECT event_id, process, CAST(rank AS INTEGER) AS rank, round(p, 6) AS p FROM sp"))
def nb_detailed(spark, sf_dir):
    return classify.probabilities(_scored(spark, sf_dir)).select("event_id", "process", "rank", F.round("p", 6).alias("p"))


_CLASSIFY = """, fl AS (SELECT *, process IN ('proc1', 'proc4') AS malware, process IN ('proc2', 'proc4') AS tag FROM (SELECT * REPLACE (CASE WHEN process = 'proc0' THEN 'generic dmz process' ELSE process END AS process) FROM so)),
one AS (SELECT event_id, sum(e) AS total, sum(e) FILTER (rank <> 1) AS rest, sum(CASE WHEN malware THEN e ELSE 0 END) AS bad, sum(CASE WHEN tag THEN e ELSE 0 END) AS st, sum(CASE WHEN tag AND rank <> 1 THEN e ELSE 0 END) AS rt,
  max(process) FILTER (rank = 1) AS p1, max(process) FILTER (rank = 2) AS p2, max(e) FILTER (rank = 1) AS e1, max(e) FILTER (rank = 2) AS e2, bool_or(malware) FILTER (rank = 1) AS m1, bool_or(malware) FILTER (rank = 2) AS m2, bool_or(tag) FILTER (rank = 1) AS t1, bool_or(tag) FILTER (rank = 2) AS t2 FROM fl GROUP BY event_id),
z AS (SELECT *, p1 = 'generic dmz process' AND p2 IS NOT NULL AND NOT m2 AS swap FROM one)
SELECT event_id, CASE WHEN swap THEN p2 ELSE p1 END AS process, round(CASE WHEN swap THEN e2 / rest ELSE e1 / total END, 6) AS score, CASE WHEN swap THEN m2 ELSE m1 END AS malware, round(bad / total, 6) AS p_malware,
  round(CASE WHEN swap AND t2 THEN rt / rest WHEN NOT swap AND t1 THEN st / total END, 6) AS p_tag FROM z"""


@query("nb_classify", _nb_sql(resources.WEIGHTS, _CLASSIFY))
def nb_classify(spark, sf_dir):
    dmz = F.when(F.col("process") == "proc0", F.lit(classify.GENERIC_DMZ)).otherwise(F.col("process"))
    scored = _scored(spark, sf_dir).withColumn("malware", F.col("process").isin("proc1", "proc4")).withColumn("tag", F.col("process").isin("proc2", "proc4"))
    out = classify.classify(scored.withColumn("process", dmz), ["tag"])
    return out.select("event_id", "process", F.round("score", 6).alias("score"), "malware", F.round("p_malware", 6).alias("p_malware"), F.round("p_tag", 6).alias("p_tag"))


# --- detectors --------------------------------------------------------------------------------------


@query("faketls", "SELECT event_id, event_id % 4 IN (2, 3) AS fake FROM events")
def faketls(spark, sf_dir):
    k = F.col("event_id") % 4
    suites = (
        F.when(k == 0, F.array(F.lit("1301"), F.lit("ffee"))).when(k == 1, F.array(F.lit("3a3a"), F.lit("ffee"))).when(k == 2, F.array(F.lit("ffee"), F.lit("fffd"))).otherwise(F.array().cast("array<string>"))
    )
    return table(spark, sf_dir, "events").select("event_id", detect.is_faketls(suites, ["1301", "1302", "0a0a"]).alias("fake"))


@query(
    "crypto_assessment",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'all' WHEN event_id % 3 = 1 THEN 'none' ELSE 'some' END AS allowed,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'c02b,1301' ELSE '1303' END AS not_allowed FROM events""",
)
def crypto_assessment(spark, sf_dir):
    k = F.col("event_id") % 3
    suites = F.when(k == 0, F.array(F.lit("1302"), F.lit("dada"))).when(k == 1, F.array(F.lit("c02b"), F.lit("1301"))).otherwise(F.array(F.lit("1302"), F.lit("1303")))
    a = detect.assessment(suites, detect.CNSA_SUITES, F.col("event_id") % 9 == 0)
    return table(spark, sf_dir, "events").select("event_id", a.alias("a")).select("event_id", "a.allowed", F.array_join("a.not_allowed", ",").alias("not_allowed"))


_LINES = [
    ("http", "Authorization: Basic dTpw", "exposed_credentials_plaintext"), ("http", "Authorization: Bearer abc", "exposed_credentials_token"),
    ("http", "Authorization: Digest u", "exposed_credentials_derived"), ("http", "Host: a", None), ("ftp", "PASS secret", "exposed_credentials_plaintext"),
    ("ftp", "USER bob", None), ("imap", "a1 LOGIN bob pw", "exposed_credentials_plaintext"), ("imap", "a1 AUTHENTICATE CRAM-MD5", "exposed_credentials_derived"),
    ("imap", "a1 AUTHENTICATE XOAUTH2 z", "exposed_credentials_token"), ("redis", "AUTH pw", "exposed_credentials_plaintext"), ("snmp", "community public", "exposed_credentials_plaintext"),
]


@query(
    "exposed_creds",
    "WITH l(i, protocol, kind) AS (VALUES " + ", ".join(f"({i}, '{p}', {'NULL' if k is None else repr(k)})" for i, (p, _, k) in enumerate(_LINES)) + f") SELECT event_id, protocol, kind FROM events JOIN l ON event_id % {len(_LINES)} = i",
)
def exposed_creds(spark, sf_dir):
    i = (F.col("event_id") % len(_LINES)).cast("int")
    protocol, line = (F.get(F.array(*[F.lit(x[n]) for x in _LINES]), i) for n in (0, 1))
    return table(spark, sf_dir, "events").select("event_id", protocol.alias("protocol"), detect.exposed_credentials(protocol, line).alias("kind"))


_HELLO = """hello AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN '8.8.' || (user_id % 5) || '.1' ELSE '10.0.0.' || (user_id % 9) END AS src_ip,
  CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (event_id % 9) ELSE '9.9.9.' || (event_id % 4) END AS dst_ip, event_id % 997 AS random FROM events)"""


def _hello(spark, sf_dir):
    third = F.col("event_id") % 3 == 0
    s = [F.col("user_id"), F.col("event_id")]
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        F.when(third, F.concat(F.lit("8.8."), (s[0] % 5).cast("string"), F.lit(".1"))).otherwise(F.concat(F.lit("10.0.0."), (s[0] % 9).cast("string"))).alias("src_ip"),
        F.when(third, F.concat(F.lit("10.0.0."), (s[1] % 9).cast("string"))).otherwise(F.concat(F.lit("9.9.9."), (s[1] % 4).cast("string"))).alias("dst_ip"),
        (s[1] % 997).alias("random"),
    )


@query(
    "residential_proxy",
    f"""WITH {_HELLO}, f AS (SELECT *, first_value(CASE WHEN event_id % 3 = 0 THEN dst_ip END IGNORE NULLS) OVER (PARTITION BY random ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM hello)
SELECT event_id, coalesce(event_id % 3 <> 0 AND d = src_ip, false) AS residential_proxy FROM f""",
)
def residential_proxy(spark, sf_dir):
    return detect.residential_proxy(_hello(spark, sf_dir)).select("event_id", "residential_proxy")


# --- statistics -------------------------------------------------------------------------------------

_EV = f"{FLOW}, ev AS (SELECT src_ip, fp, coalesce(ua, '') AS ua, '(' || sni || ')(' || dst_ip || ')(' || dst_port || ')' AS dst, ts FROM flow)"


@query("stats_events", f"{_EV} SELECT src_ip, fp, ua, dst, 'fingerprint' AS kind, count(*) AS count FROM ev GROUP BY ALL")
def stats_events(spark, sf_dir):
    return stats.count_events(stats.fingerprint_events(flows(spark, sf_dir)))


@query("stats_nested_flat", f"{_EV} SELECT src_ip, fp, ua, dst, count(*) AS count FROM ev GROUP BY ALL")
def stats_nested_flat(spark, sf_dir):
    return stats.flat_stats(stats.nested_stats(stats_events(spark, sf_dir)))


@query(
    "stats_cap",
    f"{_EV} SELECT src_ip, fp, ua, dst, 'fingerprint' AS kind, count FROM (SELECT src_ip, fp, ua, dst, count(*) AS count, min(ts) AS t FROM ev GROUP BY ALL ORDER BY t, src_ip, fp, ua, dst LIMIT 500)",
)
def stats_cap(spark, sf_dir):
    return stats.capped_counts(stats.fingerprint_events(flows(spark, sf_dir)), 500)


@query(
    "stats_tumbling",
    f"{_EV} SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, src_ip, fp, ua, dst, 'fingerprint' AS kind, count(*) AS count FROM ev GROUP BY ALL",
)
def stats_tumbling(spark, sf_dir):
    return stats.tumbling_counts(stats.fingerprint_events(flows(spark, sf_dir)), "6 hours")


@query("cert_labels", f"{FLOW} SELECT src_ip, sni AS fp, '' AS ua, '' AS dst, 'cert_label' AS kind, count(*) AS count FROM flow WHERE event_id % 2 = 0 GROUP BY ALL")
def cert_labels(spark, sf_dir):
    src = F.when(F.col("event_id") % 2 == 0, F.col("src_ip")).otherwise(F.col("dst_ip"))
    rows = flows(spark, sf_dir).select(src.alias("src_ip"), F.col("sni").alias("common_name"), "ts")
    return stats.count_events(stats.cert_label_events(rows))


_NAMES = f"{FLOW}, nm AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'dns' ELSE 'tls' END AS protocol, CASE WHEN event_id % 2 = 0 THEN event_id % 500 || '.' || sni ELSE event_id % 500 || '.' || sni || '.' END AS name FROM flow)"


def _names(spark, sf_dir):
    i = F.col("event_id")
    name = F.concat((i % 500).cast("string"), F.lit("."), "sni", F.when(i % 2 == 0, "").otherwise("."))
    return flows(spark, sf_dir).select(F.when(i % 3 == 0, "dns").otherwise("tls").alias("protocol"), name.alias("name"))


@query("distinct_names", f"{_NAMES} SELECT protocol, count(DISTINCT rtrim(name, '.')) AS n_names FROM nm GROUP BY protocol")
def distinct_names(spark, sf_dir):
    return stats.distinct_names(_names(spark, sf_dir))


@query("tls_not_dns", f"{_NAMES} SELECT DISTINCT rtrim(name, '.') AS name FROM nm WHERE protocol = 'tls' AND rtrim(name, '.') NOT IN (SELECT rtrim(name, '.') FROM nm WHERE protocol = 'dns')")
def tls_not_dns(spark, sf_dir):
    return stats.names_not_in(_names(spark, sf_dir), "tls", "dns")


@query(
    "correlation_object",
    f"""{FLOW} SELECT event_id, src_ip, dst_ip, src_port, dst_port, 6 AS protocol, event_id % 65536 AS ip_id, CASE WHEN starts_with(fp, 'tls') THEN md5(CAST(event_id AS VARCHAR)) END AS tls_random,
  CASE WHEN starts_with(fp, 'tls') THEN sni END AS tls_sni, CASE WHEN starts_with(fp, 'http') THEN sni END AS http_host, CAST(NULL AS VARCHAR) AS http_xff, event_id % 7 AS dns_id, sni || ';' || process AS dns_names FROM flow""",
)
def correlation_object(spark, sf_dir):
    f = flows(spark, sf_dir)
    tls, http = F.startswith("fp", F.lit("tls")), F.startswith("fp", F.lit("http"))
    rows = f.select(
        "event_id", "src_ip", "dst_ip", "src_port", "dst_port", F.lit(6).alias("protocol"), (F.col("event_id") % 65536).alias("ip_id"),
        F.when(tls, F.md5(F.col("event_id").cast("string"))).alias("tls_random"), F.when(tls, F.col("sni")).alias("tls_sni"), F.when(http, F.col("sni")).alias("http_host"),
        F.lit(None).cast("string").alias("http_xff"), (F.col("event_id") % 7).alias("dns_id"), F.array("sni", "process").alias("dns_names"),
    )
    return stats.correlation_object(rows, "event_id")


@query("mean_and_deviation", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY event_type")
def mean_and_deviation(spark, sf_dir):
    out = stats.mean_and_deviation(table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


@query(
    "key_groups",
    "WITH k AS (SELECT o_orderkey AS id, o_custkey % 300 AS k FROM orders), g AS (SELECT k, dense_rank() OVER (ORDER BY f) - 1 AS key_group, n FROM (SELECT k, min(id) AS f, count(*) AS n FROM k GROUP BY k)) SELECT id, CAST(key_group AS BIGINT) AS key_group, n AS key_count FROM k JOIN g USING (k)",
)
def key_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 300).alias("k"))
    return stats.key_groups(rows, "k", "id").select("id", F.col("key_group").cast("long").alias("key_group"), "key_count")


@query(
    "host_os_profile",
    f"""{FLOW}, c AS (SELECT src_ip, split_part(fp, '/', 1) AS protocol, fp, count(*) AS count FROM flow WHERE event_type IN ('view', 'signup') GROUP BY ALL),
d AS (SELECT DISTINCT split_part(fp, '/', 1) AS protocol, fp, 'os' || o AS os, CAST(1 + (user_id % 5 + o) % 3 AS DOUBLE) / 4 AS share FROM flow, (VALUES (0), (1), (2)) t(o)),
m AS (SELECT src_ip, c.protocol, os, sum(count * share) AS mass FROM c JOIN d ON c.fp = d.fp AND c.protocol = d.protocol GROUP BY ALL),
n AS (SELECT *, mass / sum(mass) OVER (PARTITION BY src_ip, protocol) AS mm FROM m),
z AS (SELECT src_ip, 't' || t AS target, sum(mm * CASE WHEN os = 'os' || t THEN 2.0 WHEN protocol = 'tls' THEN 0.5 ELSE 0.25 END) AS z FROM n, (VALUES (0), (1), (2)) q(t) GROUP BY ALL),
p AS (SELECT *, exp(z - max(z) OVER (PARTITION BY src_ip)) AS e FROM z)
SELECT src_ip, round(max(e) / sum(e), 6) AS p FROM p GROUP BY src_ip""",
)
def host_os_profile(spark, sf_dir):
    f = flows(spark, sf_dir)
    proto = fpf.fp_type(F.col("fp")).alias("protocol")
    counts = f.filter(F.col("event_type").isin("view", "signup")).groupBy("src_ip", proto, "fp").agg(F.count(F.lit(1)).alias("count"))
    db = f.select(proto, "fp", (F.col("user_id") % 5).alias("u"), F.explode(F.array(*map(F.lit, range(3)))).alias("o")).distinct()
    db = db.select("protocol", "fp", F.concat(F.lit("os"), F.col("o").cast("string")).alias("os"), ((1 + (F.col("u") + F.col("o")) % 3) / 4.0).alias("share"))
    rows = [(p, f"os{o}", f"t{t}", 2.0 if o == t else 0.5 if p == "tls" else 0.25) for p in ("tls", "http") for o in range(3) for t in range(3)]
    coefficients = spark.createDataFrame(rows, "protocol string, os string, target string, weight double")
    return stats.host_os_profile(counts, db, coefficients).select("src_ip", F.round("p", 6).alias("p"))


# --- state ------------------------------------------------------------------------------------------


@query(
    "flow_is_new_1h",
    "SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) > 3600, true) AS is_new FROM events",
)
def flow_is_new_1h(spark, sf_dir):
    return state.flow_is_new(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("event_id", "is_new")


@query(
    "tcp_first_data",
    """WITH p AS (SELECT event_id, ts, user_id, event_type = 'signup' AS syn, event_type = 'error' AS fin, CASE WHEN event_type = 'signup' THEN 99 ELSE 100 + event_id % 2 END AS seq FROM events),
l AS (SELECT *, last_value(CASE WHEN syn THEN {'open': true, 'next': seq + 1, 't': ts} WHEN fin THEN {'open': false, 'next': NULL, 't': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM p)
SELECT event_id, coalesce(s.open AND (epoch(ts) - epoch(s.t) > 30 OR s.next = seq), false) AS is_first FROM l WHERE NOT syn""",
)
def tcp_first_data(spark, sf_dir):
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", (kind == "signup").alias("syn"), (kind == "error").alias("fin"), F.lit(False).alias("rst"), F.lit(1).alias("length"),
        F.when(kind == "signup", 99).otherwise(100 + F.col("event_id") % 2).cast("long").alias("seq"),
    )
    return state.tcp_first_data(rows, ["user_id"], "event_id").select("event_id", "is_first")


@query("flow_direction", f"{FLOW} SELECT event_id, CASE WHEN dst_port <= src_port THEN 'client' ELSE 'server' END AS direction FROM flow")
def flow_direction(spark, sf_dir):
    return flows(spark, sf_dir).select("event_id", state.direction(F.col("src_port"), F.col("dst_port")).alias("direction"))


# --- strings and numbers ----------------------------------------------------------------------------


@query("levenshtein_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey")
def levenshtein_pairs(spark, sf_dir):
    return strings.pair_distances(table(spark, sf_dir, "nation"), "edit", key="n_nationkey", value="n_name")


@query(
    "hamming_pairs",
    "WITH h AS (SELECT n_nationkey AS k, md5(n_name) AS m FROM nation) SELECT a.k AS a, b.k AS b, (SELECT CAST(sum(bit_count(xor(('0x' || substr(a.m, 2 * i + 1, 2))::BIGINT, ('0x' || substr(b.m, 2 * i + 1, 2))::BIGINT))) AS BIGINT) FROM range(16) t(i)) AS d FROM h a JOIN h b ON a.k > b.k",
)
def hamming_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.md5("n_name").alias("m"))
    return strings.pair_distances(rows, "hamming", key="k", value="m")


@query("average_distance", "SELECT a.n_nationkey AS n_nationkey, round(sum(levenshtein(a.n_name, b.n_name)) / (SELECT count(*) FROM nation), 6) AS average FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey GROUP BY a.n_nationkey")
def average_distance(spark, sf_dir):
    out = strings.average_distances(table(spark, sf_dir, "nation"), "edit", "n_nationkey", "n_name")
    return out.select("n_nationkey", F.round("average", 6).alias("average"))


@query("mask_value", "SELECT xor(bit_and(v), bit_or(v)) AS differ, bit_and(v) AS ones FROM (SELECT s_suppkey * 64 + 4096 AS v FROM supplier)")
def mask_value(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 64 + 4096).alias("v"))
    m = strings.common_mask(rows)
    return m.select(F.bitwise_not("mask").bitwiseAND(F.lit((1 << 63) - 1)).alias("differ"), F.col("value").alias("ones"))


@query(
    "batch_gcd",
    """WITH m AS (SELECT s_suppkey AS line, (2 * s_suppkey + 101) * (2 * (s_suppkey % 37) + 10007) AS n FROM supplier), u AS (SELECT n, min(line) AS line FROM m GROUP BY n)
SELECT a.line, b.line AS other, lower(printf('%x', gcd(a.n, b.n))) AS factor FROM u a JOIN u b ON a.line <> b.line WHERE gcd(a.n, b.n) > 1""",
)
def batch_gcd(spark, sf_dir):
    k = F.col("s_suppkey")
    n = (2 * k + 101) * (2 * (k % 37) + 10007)
    rows = table(spark, sf_dir, "supplier").select(k.alias("line"), F.hex(n).alias("hex"))
    return gcd.shared_factors(gcd.read_moduli(rows), 8)


# --- packets ----------------------------------------------------------------------------------------

_OPTIONS = "020405b40103030701010402"


def _packets(spark, sf_dir) -> DataFrame:
    """A packet for each flow, put together from its columns: an HTTP request, a DNS query or a SYN."""
    k = F.col("event_id") % 3

    def hex_of(n, digits):
        return F.lpad(F.hex(n), digits, "0")

    request = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), "sni", F.lit("\r\nAccept: */*\r\n\r\n"))
    labels = F.array_join(F.transform(F.split("sni", r"\."), lambda x: F.concat(hex_of(F.length(x), 2), F.hex(x))), "")
    query_ = F.concat(hex_of(F.col("event_id") % 65536, 4), F.lit("01000001000000000000"), labels, F.lit("0000010001"))
    tcp_head = F.concat(hex_of(F.col("src_port"), 4), hex_of(F.col("dst_port"), 4), F.lit("0000000100000001"))
    http = F.concat(tcp_head, F.lit("5018faf000000000"), F.hex(request))
    syn = F.concat(tcp_head, F.lit("8002faf000000000"), F.lit(_OPTIONS))
    dns = F.concat(hex_of(F.col("src_port"), 4), F.lit("0035"), hex_of(8 + F.length(query_) / 2, 4), F.lit("0000"), query_)
    body = F.when(k == 0, http).when(k == 1, dns).otherwise(syn)

    def address(c):
        return hex_of(ip.v4_to_int(F.col(c)), 8)

    rows = flows(spark, sf_dir).withColumn("body", body)
    size = hex_of((20 + F.length("body") / 2).cast("long"), 4)
    head = F.concat(F.lit("00" * 12 + "08004500"), size, F.lit("0000000040"), F.when(k == 1, "11").otherwise("06"), F.lit("0000"), address("src_ip"), address("dst_ip"))
    return rows.select(
        F.lit("made").alias("file"), F.col("event_id").alias("pkt_no"), F.lit(0).cast("long").alias("ts_sec"), F.lit(0).alias("ts_nanos"), F.lit(1).alias("linktype"),
        F.unhex(F.concat(head, "body")).alias("data"),
    )


@query(
    "packet_parse",
    f"""{FLOW} SELECT event_id, src_ip, dst_ip, src_port, CAST(CASE WHEN event_id % 3 = 1 THEN 53 ELSE dst_port END AS INTEGER) AS dst_port,
  CASE event_id % 3 WHEN 0 THEN 'http_request' WHEN 1 THEN 'dns' ELSE 'tcp_syn' END AS msg_type, CASE event_id % 3 WHEN 0 THEN sni WHEN 1 THEN sni || '.' END AS server_name,
  CASE event_id % 3 WHEN 0 THEN 'http/(474554)(485454502f312e31)((486f7374)(4163636570743a202a2f2a))' WHEN 2 THEN 'tcp/(40)(00)(40)(faf0)((020405b4)(01)(030307)(01)(01)(04))' END AS fingerprint FROM flow""",
)
def packet_parse(spark, sf_dir):
    from flowquarry.operators.packets import parse_packets

    cols = ["src_ip", "dst_ip", "src_port", "dst_port", "msg_type", "server_name", "fingerprint"]
    return parse_packets(_packets(spark, sf_dir), "http,dns,tcp").select(F.col("pkt_no").alias("event_id"), *cols)


@query(
    "packet_selection",
    f"{FLOW} SELECT 'http_request' AS msg_type, count(*) AS n FROM flow WHERE event_id % 3 = 0",
)
def packet_selection(spark, sf_dir):
    from flowquarry.operators.packets import kept_packets, parse_packets

    made = _packets(spark, sf_dir)
    records = parse_packets(made, "http.request")
    kept = kept_packets(made, records).select("pkt_no").join(records.select("pkt_no", "msg_type"), "pkt_no")
    return kept.groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"))
