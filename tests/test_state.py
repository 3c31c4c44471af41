"""Reassembly and streams."""

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from flowquarry.operators import reassembly as ra
from flowquarry.operators import state, stats
from flowquarry.plans import queries as plans
from flowquarry.streaming import flows as st
from tests.test_parse import hello


def test_segments():
    assert ra.join_segments([(10, b"abc"), (13, b"def")], 10, 6) == (b"abcdef", {"out_of_order": False, "overlap": False, "missing": False})
    assert ra.join_segments([(10, b"abc"), (16, b"g"), (13, b"def")], 10, 7)[0] == b"abcdefg"
    assert ra.join_segments([(10, b"abc"), (12, b"XYZ")], 10, 9) == (b"abcYZ", {"out_of_order": False, "overlap": True, "missing": False})
    assert ra.join_segments([(10, b"abc"), (15, b"zz")], 10, 9) == (b"abc", {"out_of_order": True, "overlap": False, "missing": True})
    assert ra.join_segments([(0xFFFFFFFE, b"abcd"), (2, b"ef")], 0xFFFFFFFE, 6)[0] == b"abcdef"  # numbers wrap


def test_reassembly(spark):
    data = hello([(21, bytes(900))])
    cut = [(0, 0.0, 1000, data[:400]), (1, 0.1, 1800, data[800:]), (2, 0.2, 1400, data[400:800])]
    late = [(3, 0.0, 1, data[:400]), (4, 99.0, 401, data[400:])]
    one = [(5, 0.0, 1, b"GET / HTTP/1.1\r\n\r\n")]
    rows = [("a", "b", p, 443, 6, *r) for p, group in ((1, cut), (2, late), (3, one)) for r in group]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, pkt_no long, ts double, seq long, payload binary")
    got = {(r.src_port, r.pkt_no): r for r in ra.reassemble(df).collect()}
    assert bytes(got[1, 0].data) == data and got[1, 0].status == "reassembled" and got[1, 0].out_of_order
    assert got[2, 3].status == "truncated" and got[3, 5].status == "none"


def test_windows_and_new_flows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("10.0.0.1", "8.8.8.8", 1, 443, 6, t0 + timedelta(seconds=s), s) for s in (0, 10, 3000, 7000, 20000)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ts timestamp, pkt_no long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.read_landing(spark, str(tmp_path / "in"), df.schema)
    q = st.flow_is_new(stream).writeStream.format("memory").queryName("new_flows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert {r.pkt_no: r.is_new for r in spark.table("new_flows").collect()} == {0: True, 10: False, 3000: False, 7000: True, 20000: True}
    events = stream.select("src_ip", F.lit("tls/(0303)()()").alias("fp"), F.lit("").alias("ua"), F.lit("d").alias("dst"), F.lit("fingerprint").alias("kind"), "ts")
    q = st.write_windows(st.windowed_counts(events, "1 hour"), str(tmp_path / "out"), str(tmp_path / "c2"), available_now=True)
    q.awaitTermination(120)
    done = sum(int(F and __import__("json").loads(r.value)["count"]) for r in spark.read.text(str(tmp_path / "out")).collect())
    batch = stats.tumbling_counts(df.select("src_ip", F.lit("tls/(0303)()()").alias("fp"), F.lit("").alias("ua"), F.lit("d").alias("dst"), F.lit("fingerprint").alias("kind"), "ts"), "1 hour")
    assert done == batch.agg(F.sum("count")).first()[0] - 1  # the last window is still open


def test_well_formed_and_ja3(spark):
    from flowquarry.functions import fingerprints as fpf

    fp = "(0301)(002f00350005000ac009c00ac013c0140032003800130004)((0000)(000a0006001700180019)(000b00020000))"
    df = spark.createDataFrame([("tls/" + fp,), ("tls/(0301)(00040005000a00090064006200030006001300120063)()",), (fp,)], "f string")
    got = df.select(fpf.ja3(F.col("f")).alias("j"), fpf.ja3_hash(F.col("f")).alias("h")).collect()
    assert got[0].j == got[2].j == "769,47-53-5-10-49161-49162-49171-49172-50-56-19-4,0-10-11,23-24-25,0"
    assert got[0].h == "ada70206e40642a3e4461f35503241d5" and got[1].j == "769,4-5-10-9-100-98-3-6-19-18-99,,,"
    assert got[1].h == "de350869b8c85de67a350c8d186f11e6"
    odd = ["tls/(0303)((00)[01])", "tls/1/(03", "TLS/(03)", "tls/(0G)", "tofsee/1/generic", "tls/())("]
    df = spark.createDataFrame([(x,) for x in odd], "f string")
    assert [r[0] for r in df.select(fpf.is_well_formed(F.col("f"))).collect()] == [True, False, False, False, True, False]


def test_gcd_report(spark):
    from flowquarry.operators import gcd

    def report(lines):
        df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line long, hex string")
        return gcd.report(gcd.read_moduli(df), 4)

    p, q, r, s = 1009, 1013, 1019, 1021
    assert report([format(p * q, "x"), format(p * r, "X"), "0", format(p * q, "x"), format(s, "x")]) == [
        "Zero modulus ignored: line 3", f"Vulnerable modulus on line 1: {p * q:x} has factors {p:x} and {q:x}",
        f"Vulnerable modulus on line 2: {p * r:x} has factors {p:x} and {r:x}", "1,2",
    ]
    got = report([format(p, "x"), format(p * q, "x")])
    assert got[0] == f"Modulus on line 1 divides another modulus: {p:x}" and got[-1] == "1,2"


def test_gcd_small_numbers(spark):
    """Moduli 1 to 9, zero, and 9 again."""
    from flowquarry.operators import gcd

    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate("1234567890")] + [(11, "9")], "line long, hex string")
    assert gcd.report(gcd.read_moduli(df), 3) == [
        "Zero modulus ignored: line 10", "Modulus on line 2 divides another modulus: 2", "Modulus on line 3 divides another modulus: 3",
        "Vulnerable modulus on line 4: 4 has factors 2 and 2", "Vulnerable modulus on line 6: 6 has factors 2 and 3",
        "Vulnerable modulus on line 8: 8 has factors 2 and 4", "Vulnerable modulus on line 9: 9 has factors 3 and 3", "2,4,6,8;3,6,9",
    ]


def test_ciphers_and_quic_keys():
    """Published vectors of AES-128, GCM and the Initial keys."""
    from flowquarry.parse import aes, quic

    keys = quic.client_keys(1, bytes.fromhex("8394c8f03e515708"))
    assert [k.hex() for k in keys] == ["1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2"]
    a = aes.Aes(bytes(range(16)))
    c = a.encrypt(bytes.fromhex("00112233445566778899aabbccddeeff"))
    assert c.hex() == "69c4e0d86a7b0430d8cdb78070b4c55a" and a.decrypt(c).hex() == "00112233445566778899aabbccddeeff"
    g = aes.Aes(bytes(16))
    sealed = g.counter(bytes(16), bytes(12))
    assert (sealed.hex(), g.tag(sealed, bytes(12), b"").hex()) == ("0388dace60b6a392f328c2b971b2fe78", "ab6e47d42cec13bdf53a67b21257bddf")


def test_quic_round_trip():
    """A hello sealed by hand is opened, and a changed byte is noticed."""
    from flowquarry.parse import quic
    from flowquarry.parse.aes import Aes

    message = hello()[5:]
    frames = b"\x06" + b"\x00" + (0x4000 | len(message)).to_bytes(2, "big") + message
    frames += bytes(1162 - len(frames))
    dcid = b"12345678"
    key, iv, hp = quic.client_keys(1, dcid)
    length = len(frames) + 2 + 16
    head = b"\xc1\0\0\0\1" + b"\x08" + dcid + b"\0\0" + (0x4000 | length).to_bytes(2, "big")
    number = b"\0\7"
    nonce = bytes(a ^ b for a, b in zip(iv, bytes(10) + number))
    sealed = Aes(key).counter(frames, nonce)
    sealed += Aes(key).tag(sealed, nonce, head + number)
    mask = Aes(hp).encrypt((number + sealed)[4:20])
    packet = bytes([head[0] ^ mask[0] & 15]) + head[1:] + bytes(a ^ b for a, b in zip(number, mask[1:])) + sealed
    got = quic.parse_initial(packet)
    assert got["server_name"] == "a.example" and got["fingerprint"].startswith("quic/(00000001)(0303)(0a0a1301c02b)[(0000)")
    assert quic.parse_initial(packet[:200] + b"x" + packet[201:]) is None


def test_unrecognised_data_is_whole(spark):
    df = spark.createDataFrame([("a", "b", 1, 2, 6, 0, 0.0, None, b"x" * 700), ("a", "b", 1, 2, 6, 1, 1.0, None, b"y")], "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, pkt_no long, ts double, msg_type string, data binary")
    assert [bytes(r.data) for r in state.unrecognised_first(df).collect()] == [b"x" * 700]


def test_batch_gcd_takes_every_supplier(spark, tmp_path):
    keys = [*range(1, 30), *range(290, 420)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    line = {}
    for k in keys:
        line.setdefault((2 * k + 101) * (2 * (k % 37) + 10007), k)
    want = {(a, b, format(math.gcd(m, n), "x")) for m, a in line.items() for n, b in line.items() if a != b and math.gcd(m, n) > 1}
    got = [tuple(r) for r in plans.QUERIES["batch_gcd"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(want)[0] > 300


def test_gcd_block_pairs_have_tasks_of_their_own(spark):
    """Numbers of a word, at its border and longer ones, against brute force; no task has all pairs."""
    from flowquarry.operators import gcd

    primes = [3, 5, 10007, (1 << 31) - 1, (1 << 61) - 1, (1 << 89) - 1, (1 << 107) - 1]
    numbers = sorted({p * q for p in primes for q in primes} | {1, 7, (1 << 63) - 1, 1 << 63, 3 << 63, 7 << 200, *range(2001, 2101, 2)})
    df = spark.createDataFrame([(i, format(n, "x")) for i, n in enumerate(numbers)], "line long, hex string")
    got = gcd.shared_factors(gcd.read_moduli(df), 4).withColumn("task", F.spark_partition_id()).collect()
    want = {(a, b, format(math.gcd(m, n), "x")) for a, m in enumerate(numbers) for b, n in enumerate(numbers) if a != b and math.gcd(m, n) > 1}
    assert len(got) == len(want) and {tuple(r)[:3] for r in got} == want
    tasks = [sum(r.task == t for r in got) for t in {r.task for r in got}]
    assert len(tasks) == 10 and max(tasks) < len(got) / 4


def test_messages_of_packets_without_a_file_in_one_pass(spark):
    """Packets are read and parsed once; a packet without a file name is part of its message too."""
    from flowquarry.operators.packets import parse_reassembled

    data = hello([(21, bytes(900))])

    def packet(port, seq, payload):
        tcp = port.to_bytes(2, "big") + bytes([1, 187]) + seq.to_bytes(4, "big") + bytes(4) + b"\x50\x18" + bytes(6) + payload
        return bytes(12) + b"\x08\0\x45\0" + (20 + len(tcp)).to_bytes(2, "big") + bytes(4) + b"\x40\x06\0\0" + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + tcp

    request = b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"
    rows = [(None, 0, 0, packet(1, 1, data[:400])), (None, 1, 2, packet(1, 801, data[800:])), ("f", 2, 1, packet(1, 401, data[400:800])), (None, 3, 0, packet(1, 99, b"")), (None, 4, 30, packet(1, 9, request)), ("f", 5, 0, packet(2, 1, data))]
    df = spark.createDataFrame([(f, n, t, 0, 1, d) for f, n, t, d in rows], "file string, pkt_no long, ts_sec long, ts_nanos int, linktype int, data binary")
    out = parse_reassembled(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("Scan") == 1
    got = {r.pkt_no: (r.file, r.msg_type, r.truncated, r.reassembly) for r in out.collect()}
    assert got == {0: (None, "tls_client_hello", False, "reassembled"), 4: (None, "http_request", None, "none"), 5: ("f", "tls_client_hello", False, "none")}
