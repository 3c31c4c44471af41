"""Packets put together by hand, files written and read back, and odd bytes."""

import random
import socket
import struct

from flowquarry.operators import packets as ops
from flowquarry.parse import link, others, packet, tls, web
from flowquarry.sources import pcap

ETH = b"\0" * 12 + b"\x08\x00"


def ip(payload, proto, src="10.0.0.1", dst="8.8.8.8"):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 0, 0, 64, proto, 0, socket.inet_aton(src), socket.inet_aton(dst)) + payload


def tcp(data, src=40000, dst=443, flags=0x18, options=b""):
    return struct.pack(">HHIIBBHHH", src, dst, 1, 1, (20 + len(options)) // 4 << 4, flags, 0xFAF0, 0, 0) + options + data


def udp(data, src=40000, dst=53):
    return struct.pack(">HHHH", src, dst, 8 + len(data), 0) + data


def sized(n, b):
    return len(b).to_bytes(n, "big") + b


def hello(extensions=None, suites=b"\x0a\x0a\x13\x01\xc0\x2b"):
    ext = extensions or [(0x3A3A, b""), (0, sized(2, b"\0" + sized(2, b"a.example"))), (23, b""), (10, sized(2, b"\x2a\x2a\x00\x1d")), (43, sized(1, b"\x4a\x4a\x03\x04"))]
    body = b"\x03\x03" + bytes(32) + sized(1, b"") + sized(2, suites) + sized(1, b"\0") + sized(2, b"".join(k.to_bytes(2, "big") + sized(2, v) for k, v in ext))
    return b"\x16\x03\x01" + sized(2, b"\x01" + sized(3, body))


def test_tcp_syn():
    options = bytes.fromhex("020405b40402080a000000010000000001030307")
    got = packet.parse_packet(ETH + ip(tcp(b"", flags=2, options=options), 6))
    assert got["fingerprint"] == "tcp/(40)(00)(40)(faf0)((020405b4)(04)(08)(01)(030307))"
    assert got["msg_type"] == "tcp_syn" and (got["src_ip"], got["dst_port"]) == ("10.0.0.1", 443)


def test_tls_formats():
    got = tls.parse_tls(hello())
    assert got["fingerprint"] == "tls/(0303)(0a0a1301c02b)((0a0a)(0000)(0017)(000a000600040a0a001d)(002b0005040a0a0304))"
    assert tls.parse_tls(hello(), 1)["fingerprint"] == "tls/1/(0303)(0a0a1301c02b)[(0000)(000a000600040a0a001d)(0017)(002b0005040a0a0304)(0a0a)]"
    two = tls.parse_tls(hello([(9999, b""), (21, b"\0"), (65300, b""), (0, b"")]), 2)["fingerprint"]
    assert two == "tls/2/(0303)(0a0a1301c02b)[(0000)(003e)(ff00)]"
    assert got["server_name"] == "a.example" and not got["truncated"]
    assert tls.parse_tls(hello()[:-3])["truncated"]


def test_http():
    got = web.parse_http(b"GET / HTTP/1.1\r\nHost: a.b\r\nAccept: */*\r\nX-Other: 1\r\nAuthorization: Basic dTpw\r\n\r\n")
    assert got["fingerprint"] == f"http/({b'GET'.hex()})({b'HTTP/1.1'.hex()})(({b'Host'.hex()})({b'Accept: */*'.hex()})({b'Authorization'.hex()}))"
    assert got["exposed"] == "exposed_credentials_plaintext" and got["server_name"] == "a.b"
    got = web.parse_http(b"HTTP/1.1 200 OK\r\nServer: x\r\nDate: y\r\n\r\nbody")
    assert got["fingerprint"].startswith(f"http_server/({b'HTTP/1.1'.hex()})({b'200'.hex()})({b'OK'.hex()})")


def test_dns_and_tunnel():
    q = bytes.fromhex("000101000001000000000000") + b"\x01a\x07example\x00" + b"\0\x01\0\x01"
    got = packet.parse_packet(ETH + ip(udp(q), 17))
    assert got["msg_type"] == "dns" and got["server_name"] == "a.example."
    inner = ip(udp(q), 17, "1.1.1.1", "2.2.2.2")
    got = packet.parse_packet(ETH + ip(b"\0\0\x08\0" + inner, 47))
    assert got["encapsulations"] == [{"type": "gre", "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "protocol_type": "47"}] and got["src_ip"] == "1.1.1.1"


def test_ssh_dhcp_stun_credentials():
    assert web.parse_ssh(b"SSH-2.0-OpenSSH_9 x\r\n")["fingerprint"] == f"ssh_init/({b'SSH-2.0-OpenSSH_9 x'.hex()})"
    dhcp = bytes(236) + b"\x63\x82\x53\x63" + b"\x35\x01\x03" + b"\x37\x02\x01\x03" + b"\x0c\x01a" + b"\xff"
    assert web.parse_dhcp(dhcp)["fingerprint"] == "dhcp/((350103)(37020103)(0c)(ff))"
    stun = b"\0\x01" + (8).to_bytes(2, "big") + b"\x21\x12\xa4\x42" + bytes(12) + b"\x80\x22\0\x04abcd"
    assert web.parse_stun(stun)["fingerprint"] == "stun/1/(00)(0001)(01)((8022))"
    assert others.parse_ftp(b"PASS x\r\n")["exposed"] and others.parse_imap(b"a LOGIN u p\r\n")["exposed"] and others.parse_redis(b"*2\r\n$4\r\nAUTH\r\n$1\r\nx\r\n")["exposed"]
    snmp = b"\x30\x26\x02\x01\x01\x04\x06public\xa0\x19\x02\x01\x01\x02\x01\0\x02\x01\0\x30\x0e\x30\x0c\x06\x08\x2b\x06\x01\x02\x01\x01\x01\0\x05\0"
    assert others.parse_snmp(snmp)["fields"]["oids"] == ["1.3.6.1.2.1.1.1.0"]
    binding = b"\x30\x0f\x06\x03\x2b\x06\x01\x04\x08\x06\x04\x2b\x06\x01\x02\x01\x01"  # a string that looks like an identifier
    second = b"\x30\x09\x06\x03\x88\x37\x03\x06\x02\x2a\x03"  # a name under 2.999, and a value that is an identifier
    body = b"\x02\x01\x01\x02\x01\0\x02\x01\0\x30" + sized(1, binding + second)
    pdu = b"\xa2" + sized(1, body)
    reply = b"\x30" + sized(1, b"\x02\x01\x01\x04\x06public" + pdu)
    assert others.parse_snmp(reply)["fields"]["oids"] == ["1.3.6.1", "2.999.3", "1.2.3"]


def test_odd_bytes_never_raise():
    r = random.Random(7)
    starts = [b"", hello(), b"GET / HTTP/1.1\r\n", b"SSH-2.0-x\r\n", b"\x30\x82", b"*3\r\n$", b"HTTP/1.1 ", b"\x05\x64", b"220 x\r\n"]
    for _ in range(4000):
        s = r.choice(starts)
        data = bytearray(s + r.randbytes(r.randrange(60)))
        for _ in range(r.randrange(4)):
            if data:
                data[r.randrange(len(data))] = r.randrange(256)
        packet.record(ETH + ip(tcp(bytes(data), r.choice([21, 25, 143, 40000]), r.choice([443, 3306, 1194, 49])), 6), 1)
        packet.record(ETH + ip(udp(bytes(data), 40000, r.choice([53, 67, 161, 443, 500, 69, 1900])), 17), 1)
        packet.record(bytes(data), r.choice([0, 1, 9, 101, 113, 276]))


def test_files_round_trip(spark, tmp_path):
    rows = [(100 + i, 5000 + i, ETH + ip(tcp(hello()), 6)) for i in range(5)] + [(200, 7, ETH + ip(tcp(b"", flags=2), 6)), (201, 0, b"\0\1")]
    with open(tmp_path / "a.pcap", "wb") as f:
        assert pcap.write_packets(f, ((s, n, len(d), d) for s, n, d in rows)) == len(rows)
    ng = struct.pack("<IIIHHq", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1) + struct.pack("<I", 28) + struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
    data = rows[0][2] + b"\0" * (-len(rows[0][2]) % 4)
    n = 32 + len(data)
    ng += struct.pack("<IIIIIII", 6, n, 0, 0, 1_500_000, len(rows[0][2]), len(rows[0][2])) + data + struct.pack("<I", n)
    (tmp_path / "b.pcapng").write_bytes(ng)
    df = pcap.read_pcap(spark, str(tmp_path)).cache()
    assert df.count() == 8
    assert df.filter("file like '%pcapng'").first()["ts_nanos"] == 500_000_000
    records = ops.parse_packets(df, "tls,tcp")
    assert records.count() == 7
    line = records.filter("msg_type = 'tls_client_hello'").select(ops.record_json(True)).first()[0]
    import json

    got = json.loads(line)
    assert got["fingerprints"]["tls"].startswith("tls/(0303)") and got["tls_client_hello"]["server_name"] == "a.example" and got["dst_port"] == 443
    assert ops.kept_packets(df, records).count() == 7 and ops.rejected_packets(df, records).count() == 1
    out = pcap.write_pcap(ops.kept_packets(df, records), f"file://{tmp_path}/out").collect()
    assert sum(r["packets"] for r in out) == 7
    assert pcap.read_pcap(spark, f"file://{tmp_path}/out").count() == 7
    assert ops.selected("none") == [] and ops.selected("all") is None


def test_link_types():
    body = ip(tcp(b"", flags=2), 6)
    for linktype, frame in ((link.RAW, body), (link.NULL, b"\2\0\0\0" + body), (link.PPP, b"\xff\x03\0\x21" + body), (link.SLL, bytes(14) + b"\x08\0" + body), (link.SLL2, b"\x08\0" + bytes(18) + body), (link.ETHERNET, b"\0" * 12 + b"\x81\0\0\1\x08\0" + body)):
        assert packet.parse_packet(frame, linktype)["msg_type"] == "tcp_syn"


def test_kerberos_request():
    """A request shows its names, realm and types; one that is cut inside the body keeps its kind."""

    def tlv(tag, *parts):
        return bytes([tag]) + sized(1, b"".join(parts))

    def name(kind, *names):
        return tlv(0x30, tlv(0xA0, tlv(2, bytes([kind]))), tlv(0xA1, tlv(0x30, *(tlv(0x1B, n) for n in names))))

    body = tlv(0x30, tlv(0xA1, name(1, b"user")), tlv(0xA2, tlv(0x1B, b"EXAMPLE")), tlv(0xA3, name(2, b"krbtgt", b"EXAMPLE")), tlv(0xA7, tlv(2, b"\1\0")), tlv(0xA8, tlv(0x30, tlv(2, b"\x12"), tlv(2, b"\x80"))))
    request = tlv(0x6A, tlv(0x30, tlv(0xA1, tlv(2, b"\5")), tlv(0xA2, tlv(2, b"\x0a")), tlv(0xA4, body)))
    got = others.parse_kerberos(request)["fields"]
    assert got["msg_type"] == "as_req" and got["body"] == {
        "cname": {"type": 1, "names": ["user"]}, "realm": "EXAMPLE", "sname": {"type": 2, "names": ["krbtgt", "EXAMPLE"]}, "nonce": 256, "etype": [18, -128],
    }
    assert others.parse_kerberos(tlv(0x6A, b"\x30\x05\xa4\x03\x30\x01"))["fields"] == {"msg_type": "as_req"}
