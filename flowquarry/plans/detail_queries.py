"""Registered queries on operators that work on the details of one flow, packet or string."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions import fingerprints as fpf
from flowquarry.functions import headers, text
from flowquarry.operators import classify, detect, lookup, resources, state
from flowquarry.plans.flow_view import flows
from flowquarry.plans.queries import _CLASSIFY, FLOW, _model, _nb_sql, _scored, nb_classify, query
from flowquarry.session import table

# --- strings ----------------------------------------------------------------------------------------


def _nation_pairs(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("s"))
    a, b = rows.select(F.col("k").alias("a"), F.col("s").alias("x")), rows.select(F.col("k").alias("b"), F.col("s").alias("y"))
    return a.join(b, F.col("a") > F.col("b"))


@query(
    "common_strings",
    """SELECT a.n_nationkey AS a, b.n_nationkey AS b,
  (SELECT CAST(coalesce(max(n), 0) AS INTEGER) FROM range(1, 26) s(i), range(1, 26) t(n) WHERE i + n <= length(a.n_name) + 1 AND contains(b.n_name, substr(a.n_name, i, n))) AS longest,
  (SELECT string_agg(CASE WHEN substr(a.n_name, i, 1) = substr(b.n_name, i, 1) THEN substr(a.n_name, i, 1) ELSE '*' END, '' ORDER BY i) FROM range(1, 26) s(i) WHERE i <= least(length(a.n_name), length(b.n_name))) AS matching
FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey""",
)
def common_strings(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return _nation_pairs(spark, sf_dir).select("a", "b", text.common_substring(x, y).alias("longest"), text.matching_characters(x, y).alias("matching"))


_BYTES = "(SELECT string_agg(lower(printf('%02x', {op}(('0x' || substr(md5(n_name), 2 * i + 1, 2))::INTEGER, ('0x' || substr(md5(n_comment), 2 * i + 1, 2))::INTEGER))), '' ORDER BY i) FROM range(16) t(i))"


@query(
    "byte_logic",
    f"""WITH x AS (SELECT n_nationkey, md5(n_name) AS m, {_BYTES.format(op='xor')} AS differ, {_BYTES.format(op='').replace('::INTEGER, ', '::INTEGER & ')} AS both_set FROM (SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_comment FROM nation))
SELECT n_nationkey, differ, both_set, (SELECT CAST(sum(bit_count(('0x' || substr(m, 2 * i + 1, 2))::BIGINT)) AS BIGINT) FROM range(16) t(i)) AS weight FROM x""",
)
def byte_logic(spark, sf_dir):
    a, b = F.md5("n_name"), F.md5(F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.bytes_xor(a, b).alias("differ"), text.bytes_and(a, b).alias("both_set"), text.hamming_weight(a).alias("weight"))


@query("jwt_split", """SELECT event_id, '{"alg":"HS' || (event_id % 3) || '"}' AS header, '{"sub":"' || user_id || '","t":"' || event_type || '?>~"}' AS payload, 's-' || event_id AS signature FROM events""")
def jwt_split(spark, sf_dir):
    def part(x):
        return F.regexp_replace(F.translate(F.base64(x.cast("binary")), "+/", "-_"), "=+$", "")

    k = F.col("event_id").cast("string")
    head = F.concat(F.lit('{"alg":"HS'), (F.col("event_id") % 3).cast("string"), F.lit('"}'))
    body = F.concat(F.lit('{"sub":"'), F.col("user_id").cast("string"), F.lit('","t":"'), F.col("event_type"), F.lit('?>~"}'))
    token = F.concat_ws(".", part(head), part(body), F.concat(F.lit("s-"), k))
    return table(spark, sf_dir, "events").select("event_id", text.jwt_parts(token).alias("j")).select("event_id", "j.header", "j.payload", "j.signature")


@query(
    "http_headers",
    f"""{FLOW} SELECT event_id, sni AS host, CASE WHEN user_id % 3 = 0 THEN NULL ELSE ua END AS agent,
  'Host=' || sni || ';Authorization;X-Own' || CASE WHEN ua IS NULL THEN '' ELSE ';User-Agent=' || ua END AS shown,
  'Host=' || sni || ';Authorization=Basic ' || user_id || ';X-Own' || CASE WHEN ua IS NULL THEN '' ELSE ';User-Agent=' || ua END AS shown_all FROM flow""",
)
def http_headers(spark, sf_dir):
    agent = F.when(F.col("ua").isNull(), F.lit("")).otherwise(F.concat(F.lit("User-Agent:"), "ua", F.lit("\r\n")))
    raw = F.concat(F.lit("Host: "), "sni", F.lit("\r\nAuthorization: Basic "), F.col("user_id").cast("string"), F.lit("\r\nno header\r\nX-Own: 1:2\r\n"), agent, F.lit("\r\nHost: body"))
    rows = flows(spark, sf_dir).select("event_id", headers.header_list(raw).alias("h"))

    def line(mode):
        shown = F.transform(headers.reported_headers(F.col("h"), mode), lambda x: F.concat_ws("=", x["name"], x["value"]))
        return F.array_join(shown, ";")

    return rows.select(
        "event_id", headers.header_value(F.col("h"), "host").alias("host"), headers.header_value(F.col("h"), "user-agent").alias("agent"),
        line("non_sensitive").alias("shown"), line("all").alias("shown_all"),
    )


@query(
    "fp_pattern",
    f"""{FLOW} SELECT event_id, coalesce(regexp_full_match(regexp_extract(fp, '\\(([0-9a-f]*)\\)', 1), '030[13]') AND event_type = 'purchase' AND user_id % 5 IN (0, 2), false) AS matches FROM flow WHERE starts_with(fp, 'tls/')""",
)
def fp_pattern(spark, sf_dir):
    tls = flows(spark, sf_dir).filter("startswith(fp, 'tls/')")
    return tls.select("event_id", F.coalesce(fpf.ja3_parts_match(F.col("fp"), "030[13]", "0a0ac02bc02[02]"), F.lit(False)).alias("matches"))


# --- lookups and flow state -------------------------------------------------------------------------


@query(
    "lpm_asn_v6",
    """WITH p AS (SELECT DISTINCT substr(h, 1, n) AS net, n * 4 AS len, asn FROM (SELECT '20010db8' || lower(printf('%04x', CAST(s_suppkey % 50 AS INTEGER))) || lower(printf('%04x', CAST(s_suppkey % 20 AS INTEGER))) AS h,
    CASE s_suppkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 12 ELSE 16 END AS n, 64500 + CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN s_suppkey % 50 ELSE 1000 * (s_suppkey % 20) + s_suppkey % 50 END AS asn FROM supplier)),
a AS (SELECT event_id, '20010db8' || lower(printf('%04x', CAST(event_id % 60 AS INTEGER))) || lower(printf('%04x', CAST(event_id % 25 AS INTEGER))) AS h FROM events),
g AS (SELECT event_id, max_by(asn, len) AS asn FROM a JOIN p ON substr(h, 1, 9) = substr(net, 1, 9) AND starts_with(h, net) GROUP BY event_id)
SELECT event_id, CAST(asn AS BIGINT) AS asn FROM a LEFT JOIN g USING (event_id)""",
)
def lpm_asn_v6(spark, sf_dir):
    k = F.col("s_suppkey")

    def four(n):
        return F.lpad(F.lower(F.hex(n)), 4, "0")

    digits = F.concat(F.lit("20010db8"), four(k % 50), four(k % 20))
    n = F.when(k % 3 == 0, 9).when(k % 3 == 1, 12).otherwise(16)
    asn = 64500 + F.when(k % 3 == 0, 0).when(k % 3 == 1, k % 50).otherwise(1000 * (k % 20) + k % 50)
    prefixes = table(spark, sf_dir, "supplier").select(F.rpad(digits.substr(F.lit(1), n), 32, "0").alias("net"), (n * 4).alias("len"), asn.cast("long").alias("asn")).distinct()
    i = F.col("event_id")
    address = F.concat(F.lit("2001:db8:"), F.lower(F.hex(i % 60)), F.lit(":"), F.lower(F.hex(i % 25)), F.lit("::1"))
    rows = table(spark, sf_dir, "events").select("event_id", address.alias("dst_ip"))
    return lookup.longest_prefix_v6(rows, F.col("dst_ip"), prefixes, ["asn"]).select("event_id", "asn")


@query(
    "first_unrecognised",
    "SELECT event_id, event_type AS data FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 AND event_type NOT IN ('view', 'click')",
)
def first_unrecognised(spark, sf_dir):
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", kind.alias("data"), F.when(kind.isin("view", "click"), kind).alias("msg_type"))
    return state.unrecognised_first(rows, ["user_id"], "event_id").select("event_id", "data")


# --- classification ---------------------------------------------------------------------------------

_WITHOUT_IP = {k: v for k, v in resources.WEIGHTS.items() if k != "ip"}


@query("nb_minimized", _nb_sql(_WITHOUT_IP, "SELECT event_id, process, round(score, 4) AS score FROM sc"))
def nb_minimized(spark, sf_dir):
    rows, processes, features = _model(spark, sf_dir)
    scored = classify.scores(rows.filter("event_id % 2 = 1"), processes, features, minimize=True)
    return scored.select("event_id", "process", F.round("score", 4).alias("score"))


_HEAD, _LAST = _CLASSIFY.rsplit("\nSELECT", 1)
_WINNERS = f"{_HEAD}, won AS (SELECT{_LAST})"


@query(
    "nb_os_info",
    _nb_sql(resources.WEIGHTS, f"{_WINNERS} SELECT won.event_id, won.process, 'cpe:' || pt.process AS cpe, CAST(pt.count AS BIGINT) AS n FROM won JOIN flow f ON f.event_id = won.event_id JOIN pt ON pt.fp = f.fp AND pt.process = CASE WHEN won.process = 'generic dmz process' THEN 'proc0' ELSE won.process END"),
)
def nb_os_info(spark, sf_dir):
    system = F.array(F.struct(F.concat(F.lit("cpe:"), "process").alias("cpe"), F.col("count").alias("count")))
    dmz = F.when(F.col("process") == "proc0", F.lit(classify.GENERIC_DMZ)).otherwise(F.col("process"))
    scored = _scored(spark, sf_dir).withColumn("os_info", system).withColumn("malware", F.col("process").isin("proc1", "proc4")).withColumn("process", dmz)
    won = classify.classify(scored, carry=["os_info"])
    return won.select("event_id", "process", F.col("os_info")[0]["cpe"].alias("cpe"), F.col("os_info")[0]["count"].alias("n"))


@query(
    "attribute_tags",
    _nb_sql(
        resources.WEIGHTS,
        f"""{_WINNERS}, tagged AS (SELECT f.event_id, starts_with(f.fp, 'tls/') AND coalesce(won.malware, false) AS channel, f.user_id % 4 = 0 AS faked, won.event_id IS NOT NULL AS analysed, won.p_malware FROM flow f LEFT JOIN won USING (event_id))
SELECT event_id, CASE WHEN channel THEN p_malware END AS channel, concat_ws(',', CASE WHEN channel THEN 'encrypted_channel' END, CASE WHEN faked THEN 'domain_faking' END) AS names, analysed OR channel OR faked AS written FROM tagged""",
    ),
)
def attribute_tags(spark, sf_dir):
    won = nb_classify(spark, sf_dir).select("event_id", "process", "malware", "p_malware")
    rows = flows(spark, sf_dir).select("event_id", "fp", "user_id").join(won, "event_id", "left")
    channel, faked = detect.encrypted_channel(F.col("fp"), F.col("malware"), F.col("p_malware")), F.col("user_id") % 4 == 0
    names = detect.attributes({"domain_faking": faked, "encrypted_channel": channel.isNotNull()})
    return rows.select("event_id", channel.alias("channel"), F.array_join(names, ",").alias("names"), detect.has_analysis(F.col("process"), channel.isNotNull(), faked).alias("written"))


# --- packets ----------------------------------------------------------------------------------------


def _hello_packets(spark, sf_dir, pieces: int) -> DataFrame:
    """A TLS client hello for each flow, in one segment or two; of odd flows the extensions come the other way round."""
    odd = F.col("event_id") % 2 == 1

    def sized(digits, size):
        return F.concat(F.lpad(F.hex((F.length(digits) / 2).cast("long")), 2 * size, "0"), digits)

    name = F.concat(F.lit("0000"), sized(sized(F.concat(F.lit("00"), sized(F.hex("sni"), 2)), 2), 2))
    ticket, own = F.lit("00170000"), F.lit("FE99000101")
    body = F.concat(F.lit("0303" + "00" * 32 + "000004C02B13010100"), sized(F.when(odd, F.concat(own, ticket, name)).otherwise(F.concat(name, ticket, own)), 2))
    record = F.concat(F.lit("160301"), sized(F.concat(F.lit("01"), sized(body, 3)), 2))
    rows = flows(spark, sf_dir).select("event_id", "src_ip", "dst_ip", "src_port", record.alias("record"))
    part = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("part")
    rows = rows.select("*", part) if pieces > 1 else rows.withColumn("part", F.lit(0))
    cut = 80 if pieces > 1 else 1 << 20
    payload = F.when(F.col("part") == 0, F.substring("record", 1, cut)).otherwise(F.substring("record", cut + 1, 1 << 20))
    sequence = F.when(F.col("part") == 0, F.lit("00000001")).otherwise(F.lpad(F.hex(F.lit(1 + cut // 2)), 8, "0"))
    segment = F.concat(F.lpad(F.hex("src_port"), 4, "0"), F.lit("01BB"), sequence, F.lit("000000005018faf000000000"), payload)
    # the address stands for the flow, so that every flow has segments of its own
    source = F.concat(F.lit("0A"), F.lpad(F.hex(F.col("event_id") % (1 << 24)), 6, "0"))
    size = F.lpad(F.hex((20 + F.length(segment) / 2).cast("long")), 4, "0")
    packet = F.concat(F.lit("00" * 12 + "08004500"), size, F.lit("0000000040060000"), source, F.lit("08080808"), segment)
    return rows.select(
        F.lit("made").alias("file"), (F.col("event_id") * pieces + F.col("part")).alias("pkt_no"), F.col("part").cast("long").alias("ts_sec"), F.lit(0).alias("ts_nanos"),
        F.lit(1).alias("linktype"), F.unhex(packet).alias("data"),
    )


_WIRE = "CASE WHEN event_id % 2 = 1 THEN '((fe99)(0017)(0000))' ELSE '((0000)(0017)(fe99))' END"


@query(
    "fp_tls_formats",
    f"""{FLOW} SELECT event_id, 'tls/(0303)(c02b1301)' || {_WIRE} AS wire, 'tls/1/(0303)(c02b1301)[(0000)(0017)(fe99)]' AS sorted,
  'tls/2/(0303)(c02b1301)[(0000)(0017)(003e)]' AS assigned FROM flow""",
)
def fp_tls_formats(spark, sf_dir):
    from flowquarry.operators.packets import parse_packets

    made = _hello_packets(spark, sf_dir, 1)

    def of(fmt, name):
        return parse_packets(made, "tls.client_hello", fmt).select(F.col("pkt_no").alias("event_id"), F.col("fingerprint").alias(name))

    return of("tls", "wire").join(of("tls/1", "sorted"), "event_id").join(of("tls/2", "assigned"), "event_id")


@query(
    "reassembly_parse",
    f"{FLOW} SELECT 2 * event_id AS pkt_no, sni AS server_name, 'reassembled' AS reassembly, 'tls/(0303)(c02b1301)' || {_WIRE} AS fingerprint FROM flow",
)
def reassembly_parse(spark, sf_dir):
    from flowquarry.operators.packets import parse_reassembled

    return parse_reassembled(_hello_packets(spark, sf_dir, 2), "tls.client_hello").select("pkt_no", "server_name", "reassembly", "fingerprint")
