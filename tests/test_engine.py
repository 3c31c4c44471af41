"""Archives, records of flows, configuration and the facade."""

import io
import json
import struct
import tarfile

import pytest

from flowquarry.engine import Config, Engine
from flowquarry.operators import resources
from flowquarry.parse import cbor, quic, tls, web
from flowquarry.parse.aes import Aes
from flowquarry.plans import queries as plans
from flowquarry.plans.flow_view import flows
from flowquarry.sources import archive
from tests.test_parse import ETH, hello, ip, sized, tcp, udp

SF = "/root/testdata/sf0.001"


def test_cbor():
    for x in (0, 23, 24, 65536, -1, -500, True, None, b"ab", "é", [1, [2]], {"a": {"b": [1.5]}}):
        assert cbor.decode(cbor.encode(x)) == x
    assert cbor.decode(b"\x9f\x01\x02\xff") == [1, 2] and cbor.decode(b"\x7f\x61a\x61b\xff") == "ab" and cbor.decode(b"\x5a") is None
    fp = "tls/(0303)(1301)((0000)(002b0302))"
    assert cbor.fingerprint_string(cbor.fingerprint_tree(fp)) == fp
    assert cbor.read_flow_record(cbor.flow_record([fp], "ua", "a.b", "1.2.3.4", 443))["fingerprints"] == [fp]
    assert cbor.fingerprint_tree("tls/(0") is None


def test_archive(spark):
    members = {
        "VERSION": "2024.01.01;full\n", "fp_prevalence_tls.txt": "(0303)()\ntls/(0304)()\n", "doh-watchlist.txt": "# list\n1.1.1.1\ndns.example\n", "pyasn.db": "10.0.0.0/8\t64500\n8.8.8.0/24 15169\n",
        "domain-mappings.json": '{"subnet":"8.8.8.0/24","type":"domain_mapping","tag":"dns.example"}\n{"subnet":"9.0.0.0/8","type":"proxy","tag":"x"}\n',
        "fingerprint_db.json": json.dumps({"str_repr": "tls/(0303)()", "total_count": 3, "process_info": [{"process": "p", "count": 3}]}) + "\n",
    }
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(f"resources/{name}")
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    t = archive.tables(spark, archive.archive_lines(out.getvalue()))
    assert {r.fp for r in t["prevalence"].collect()} == {"tls/(0303)()", "tls/(0304)()"}
    assert {(r.kind, r.value) for r in t["watchlist"].collect()} == {("address", "1.1.1.1"), ("name", "dns.example")}
    assert {(r.net, r.len, r.asn) for r in t["asn"].collect()} == {(10 << 24, 8, 64500), ((8 << 24) + (8 << 16) + (8 << 8), 24, 15169)}
    assert t["models"].first()["process_info"][0]["process"] == "p" and t["mappings"].filter("exempt = 1").count() == 1
    assert not resources.version_ok("1.0") and not resources.version_ok("1;2;full") and resources.version_ok("1;lite")


def test_config():
    c = Config.parse("select=tls,http;resources=/x;reassembly;metadata=false;other=1")
    assert (c.select, c.resources, c.reassembly, c.metadata, c.extra) == ("tls,http", "/x", True, False, {"other": "1"})


def test_facade(spark):
    rows = flows(spark, SF)
    e = Engine(spark)
    e.model(rows.filter("event_id % 2 = 0"))
    got = e.analyze(rows.filter("event_id % 2 = 1"))
    assert got.filter("status = 'labeled' and process is null").count() == 0 and got.count() == rows.filter("event_id % 2 = 1").count()
    assert e.stats(rows).count() == rows.select("src_ip").distinct().count()
    assert abs(e.detailed(rows.limit(20)).groupBy("event_id").sum("p").first()[1] - 1) < 1e-9
    lines = resources.fp_db_json(*plans._model(spark, SF)[1:])
    assert all(json.loads(r.value)["process_info"] for r in lines.collect())


def test_no_python_in_relational_plans(spark):
    for name in ("nb_classify", "lpm_asn", "stats_nested_flat", "residential_proxy", "normalize_server_name_detail", "fp_ja3"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def _segment(data, seq, src=40000):
    return ETH + ip(struct.pack(">HHIIBBHHH", src, 443, seq, 1, 5 << 4, 0x18, 0xFAF0, 0, 0) + data, 6)


def test_formats_and_reassembly(spark):
    """A hello in one segment, and one that is split over two, which come in order and out of it."""
    whole = hello()
    sent = [_segment(whole, 1, 1000), _segment(whole[:40], 1, 1001), _segment(whole[40:], 41, 1001), ETH + ip(tcp(b"", flags=2), 6)]
    rows = [("f", n, 100 + n, 0, 1, data) for n, data in enumerate(sent)]
    df = spark.createDataFrame(rows, "file string, pkt_no long, ts_sec long, ts_nanos int, linktype int, data binary")
    for number in ("", "/1", "/2"):
        want = tls.parse_tls(whole, int(number[1:] or 0))["fingerprint"]
        engine = Engine(spark, f"select=tls,tcp;format=tls{number},quic;reassembly")
        got = {r.pkt_no: r for r in engine.records(df).collect()}
        assert sorted(got) == [0, 1, 3] and got[3].msg_type == "tcp_syn"
        assert got[0].fingerprint == got[1].fingerprint == want and want.startswith(f"tls{number}/(")
        assert (got[0].reassembly, got[1].reassembly, got[1].server_name, got[1].truncated) == ("none", "reassembled", "a.example", False)
    assert [r.pkt_no for r in Engine(spark, "select=tls").records(df).collect()] == [0]  # single packets show the whole one only
    with pytest.raises(ValueError, match="unknown fingerprint format"):
        Engine(spark, "format=tls/7").records(df)


def _capture(spark, sent):
    rows = [("f", n, 100 + n, 0, 1, data) for n, data in enumerate(sent)]
    return spark.createDataFrame(rows, "file string, pkt_no long, ts_sec long, ts_nanos int, linktype int, data binary")


def test_key_exchange_over_segments(spark):
    """A version line and a key exchange in three segments of their own give one record; a line alone stays one."""
    lists = b"".join(sized(4, x) for x in (b"curve25519-sha256", b"ssh-ed25519", b"aes256-ctr", b"aes256-ctr", b"hmac-sha2-256", b"hmac-sha2-256", b"none", b"none", b"", b""))
    body = b"\x04\x14" + bytes(16) + lists + bytes(5) + bytes(4)
    kex = len(body).to_bytes(4, "big") + body
    line = b"SSH-2.0-client_1\r\n"
    sent = [_segment(line, 1, 2000), _segment(kex[:50], 1 + len(line), 2000), _segment(kex[50:], 51 + len(line), 2000), _segment(line, 1, 2001)]
    got = {r.pkt_no: r for r in Engine(spark, "select=ssh;reassembly").records(_capture(spark, sent)).collect()}
    assert sorted(got) == [0, 3] and (got[0].reassembly, got[3].reassembly) == ("reassembled", "none")
    assert got[0].fingerprint == web.parse_ssh(line + kex)["fingerprint"] and got[0].fingerprint.startswith(f"ssh/({line.strip().hex()})(")
    assert got[3].msg_type == "ssh_init"


def _dtls(kind, number, whole, start, end):
    head = bytes([kind]) + len(whole).to_bytes(3, "big") + number.to_bytes(2, "big") + start.to_bytes(3, "big") + (end - start).to_bytes(3, "big")
    return b"\x16\xfe\xfd" + bytes(8) + (12 + end - start).to_bytes(2, "big") + head + whole[start:end]


def _initial(dcid, frames):
    key, iv, hp = quic.client_keys(1, dcid)
    frames += bytes(1162 - len(frames))
    head = b"\xc1\0\0\0\1" + bytes([len(dcid)]) + dcid + b"\0\0" + (0x4000 | len(frames) + 18).to_bytes(2, "big")
    number, nonce = b"\0\7", bytes(a ^ b for a, b in zip(iv, bytes(11) + b"\7"))
    sealed = Aes(key).counter(frames, nonce)
    sealed += Aes(key).tag(sealed, nonce, head + number)
    mask = Aes(hp).encrypt((number + sealed)[4:20])
    return bytes([head[0] ^ mask[0] & 15]) + head[1:] + bytes(a ^ b for a, b in zip(number, mask[1:])) + sealed


def test_messages_over_datagrams(spark):
    """DTLS fragments of one number and CRYPTO data of one connection meet; other numbers and connections do not."""
    body = hello()[9:]
    with_cookie = body[:35] + b"\0" + body[35:]  # no cookie, behind the empty session identifier
    whole = tls.parse_dtls(_dtls(1, 0, with_cookie, 0, len(with_cookie)))
    sent = [ETH + ip(udp(_dtls(1, n, with_cookie, a, b), src, 4433), 17) for src, n, a, b in ((5000, 0, 30, len(with_cookie)), (5000, 0, 0, 30), (5001, 0, 0, 30), (5001, 1, 30, len(with_cookie)))]
    message = hello()[5:]

    def crypto(start, end):
        return b"\x06" + start.to_bytes(1, "big") + (0x4000 | end - start).to_bytes(2, "big") + message[start:end]

    for src, first, second in ((6000, b"12345678", b"12345678"), (6001, b"12345678", b"87654321")):
        sent += [ETH + ip(udp(_initial(first, crypto(40, len(message))), src, 443), 17), ETH + ip(udp(_initial(second, crypto(0, 40)), src, 443), 17)]
    got = [r for r in Engine(spark, "select=dtls,quic;reassembly").records(_capture(spark, sent)).collect() if r.reassembly == "reassembled"]
    by = {r.src_port: r for r in got}
    assert sorted(by) == [5000, 6000] and len(got) == 2
    assert by[5000].fingerprint == whole["fingerprint"] and by[5000].server_name == "a.example" and by[5000].pkt_no == 0
    assert by[6000].fingerprint == quic.parse_stream(1, message)["fingerprint"] and by[6000].server_name == "a.example"


def test_resources_of_the_configuration(spark, tmp_path):
    """An archive that the configuration names gives the model; a process's systems go with it."""
    process = {"process": "p", "count": 6, "malware": False, "os_info": {"cpe:/o:x": 5}, "classes_hostname_sni": {"a.example": 3, "b": 1, "c": 2}, "classes_port_port": {"443": 6}}
    other = {"process": "q", "count": 4, "malware": True, "os_info": {"cpe:/o:y": 4}, "classes_hostname_sni": {"z.example": 4}}
    db = {"str_repr": "tls/(0303)()", "str_repr_array": ["tls/(0301)()"], "total_count": 10, "process_info": [process, other]}
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in {"VERSION": "1;full\n", "fingerprint_db.json": json.dumps(db) + "\n", "pyasn.db": "8.0.0.0/8\t64500\n"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "r.tgz").write_bytes(out.getvalue())
    engine = Engine(spark, f"resources={tmp_path}/r.tgz")
    counts = {(r.fp, r.feature, r.value): r["count"] for r in engine.tables["features"].filter("process = 'p'").collect()}
    assert counts["tls/(0301)()", "sni", "unqualified.alt"] == 3 and counts["tls/(0303)()", "sni", "a.example"] == 3
    rows = [(1, "tls/(0303)()", "a.example"), (2, "tls/(0301)()", "z.example"), (3, "tls/(0000)()", "a.example")]
    df = spark.createDataFrame([(*r, "8.8.8.8", 443, None) for r in rows], "event_id long, fp string, sni string, dst_ip string, dst_port int, ua string")
    got = {r.event_id: r for r in engine.analyze(df).collect()}
    assert (got[1].process, got[1].os_info, got[1].malware) == ("p", {"cpe:/o:x": 5}, False)
    assert (got[2].process, got[2].os_info, got[2].malware, got[3].process, got[3].status) == ("q", {"cpe:/o:y": 4}, True, None, "randomized")


def test_dns_and_certificates_in_records(spark):
    """DNS is base64 unless dns_json; what is no certificate stays base64 with certs_json."""
    query = bytes.fromhex("0001010000010000000000000161076578616d706c650000010001")
    certificate = b"\x0b" + sized(3, sized(3, sized(3, b"\x30\x03\x02\x01\x01")))
    sent = [ETH + ip(udp(query), 17), _segment(b"\x16\x03\x03" + sized(2, certificate), 1)]
    df = _capture(spark, sent)
    plain = {r.pkt_no: json.loads(r.fields) for r in Engine(spark, "select=dns,tls").records(df).collect()}
    shown = {r.pkt_no: json.loads(r.fields) for r in Engine(spark, "select=dns,tls;dns-json;certs-json").records(df).collect()}
    assert list(plain[0]) == ["base64"] and shown[0]["question"][0]["name"] == "a.example."
    assert plain[1]["certs"] == shown[1]["certs"] == [{"base64": "MAMCAQE="}]
