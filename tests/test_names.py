"""Value vectors of server names, domains and addresses."""

import pytest
from pyspark.sql import functions as F

from flowquarry.functions import ip, names

#: One input for each rule: input, normalised name, port.
PLAIN = [
    ("www.example.com", "www.example.com", None),
    (" www.example.net", "www.example.net", None),
    ("example.org.", "example.org", None),
    ("mail.example.org:8025", "mail.example.org", 8025),
    ("example.org.:993", "example.org", 993),
    ("example.org:993abc", "example.org", 993),
    ("example.org:abc", "other.alt", None),
    ("localhost:631", "localhost", 631),
    ("*.example.com", "*.example.com", None),
    ("*example.com", "other.alt", None),
    ("www.*.example.com", "other.alt", None),
    ("example.com*", "other.alt", None),
    ("203.0.113.7", "address.alt", None),
    ("198.51.100.20:8080", "address.alt", 8080),
    ("203.0.113.7.example.net", "203.0.113.7.example.net", None),
    ("2001:db8::53", "address.alt", None),
    ("[2001:db8:1::9]", "address.alt", None),
    ("[2001:db8:1::9]:8443", "address.alt", 8443),
    ("::ffff:203.0.113.9", "address.alt", None),
    ("None", "missing.alt", None),
    ("", "missing.alt", None),
    ("host", "unqualified.alt", None),
    ("12345", "other.alt", None),
    ("host.name.42", "other.alt", None),
    ("!?#", "other.alt", None),
    ("203.0.113.7.alt", "203.0.113.7.alt", None),
]
#: One input for each rule: input, normalised name in detail.
DETAIL = [
    ("198.51.100.20", "198-51-100-20.address.alt"),
    ("198.51.100.20:8080", "_8080.198-51-100-20.address.alt"),
    ("192.168.77.3", "10-0-0-1.address.alt"),
    ("2001:db8::53", "2001-db8--53.address.alt"),
    ("[2001:db8:1::]", "2001-db8-1--.address.alt"),
    ("[2001:db8:1::9]:8443", "_8443.2001-db8-1--9.address.alt"),
    ("::ffff:203.0.113.9", "--ffff-cb00-7109.address.alt"),
    ("fe80::7", "fd00--1.address.alt"),
    ("example.org:993", "_993.example.org"),
    ("example.org.:993", "_993.example.org"),
    ("example.org:abc", "other.alt"),
    (":8080", "_8080.missing.alt"),
]


def test_server_names(spark):
    df = spark.createDataFrame(PLAIN, "s string, want string, port int")
    got = df.select("s", "want", "port", names.normalize_server_name(F.col("s")).alias("n"), names.server_port(F.col("s")).alias("p")).collect()
    assert [(r.s, r.n, r.p) for r in got] == [(s, w, p) for s, w, p in PLAIN]


def test_server_names_in_detail(spark):
    df = spark.createDataFrame(DETAIL, "s string, want string")
    got = df.select("s", names.normalize_server_name(F.col("s"), detail=True).alias("n")).collect()
    assert [(r.s, r.n) for r in got] == DETAIL


def test_domains(spark):
    rows = [("www.example.com", "example.com", "example.com"), ("cdn.example.net", "example.net", "example.net"), ("example.com", "example.com", ".com"), ("localhost", "localhost", "")]
    df = spark.createDataFrame(rows, "s string, a string, b string")
    got = df.select("s", names.registered_domain(F.col("s")).alias("a"), names.legacy_domain(F.col("s")).alias("b")).collect()
    assert [tuple(r) for r in got] == rows


@pytest.mark.parametrize(
    ("text", "want"),
    [("192.168.77.3", "10.0.0.1"), ("203.0.113.7", "203.0.113.7"), ("2001:db8::1", "2001:db8::1"), ("fe80::1", "fd00::1"), ("1.2.3", ""), ("1.2.3.4x", ""), ("", ""), ("2001:0db8:0:0:1:0:0:1", "2001:db8::1:0:0:1")],
)
def test_normalize_ip(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(ip.normalize_ip(F.col("s"))).first()[0] == want
