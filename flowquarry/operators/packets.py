"""Packets to records, and records to lines and files."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.reassembly import KEY, arrow_schema, batches_of, by_flow, datagram_messages, likely_fragment, rows_of, stream_messages
from flowquarry.parse.packet import NAMES, RECORD, formats, message, parse_packet, record
from flowquarry.parse.x509 import parse_certificate

#: Selector names and the message types that they stand for.
SELECTORS = {
    "tls": ["tls_client_hello", "tls_server_hello", "tls_certificate"], "tls.client_hello": ["tls_client_hello"], "tls.server_hello": ["tls_server_hello"],
    "tls.server_certificate": ["tls_certificate"], "dtls": ["dtls_client_hello", "dtls_server_hello", "dtls_hello_verify_request"], "http": ["http_request", "http_response"],
    "http.request": ["http_request"], "http.response": ["http_response"], "ssh": ["ssh_init", "ssh_kex"], "smtp": ["smtp_client", "smtp_server"], "tcp": ["tcp_syn", "tcp_syn_ack"],
    "tcp.message": ["tcp_syn", "tcp_syn_ack"], "quic": ["quic_initial"], "ftp": ["ftp_request", "ftp_response"], "imap": ["imap_request", "imap_response"],
    "redis": ["redis_request", "redis_response"], "smb": ["smb1", "smb2"], "mysql": ["mysql_server", "mysql_login"], "socks": ["socks4", "socks5", "socks5_req_resp"],
    "bittorrent": ["bittorrent", "bittorrent_dht", "bittorrent_lsd"], "dns": ["dns"], "mdns": ["mdns"], "nbns": ["nbns"], "icmp": ["icmp", "icmpv6"],
    **{n: [n] for n in ("dhcp", "stun", "snmp", "krb5", "ldap", "tacacs_plus", "telnet", "rdp", "vnc", "dnp3", "iec60870_5_104", "wireguard", "ike", "openvpn_tcp", "ssdp", "syslog", "tftp", "arp", "cdp", "lldp", "ospf", "sctp", "esp", "nbds", "nbss", "tofsee_initial_message")},
}

PACKETS = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, file string, pkt_no long, ts double, linktype int, data binary, seq long, payload binary"


def selected(select: str | None) -> list[str] | None:
    """the message types of a comma list; all of them for nothing or `all`, none for `none`."""
    names = [n.strip() for n in (select or "all").split(",") if n.strip()]
    if "none" in names:
        return []
    if "all" in names:
        return None
    unknown = [n for n in names if n not in SELECTORS]
    if unknown:
        raise ValueError(f"unknown selectors: {', '.join(unknown)}")
    return sorted({t for n in names for t in SELECTORS[n]})


def _shown(row: dict[str, Any], dns_json: bool, certs_json: bool) -> dict[str, Any]:
    """A record whose DNS messages are base64 unless dns_json, and whose certificates are decoded if certs_json."""
    if not dns_json and row["msg_type"] in SELECTORS["dns"] + SELECTORS["mdns"] + SELECTORS["nbns"] and row.get("payload"):
        return row | {"fields": json.dumps({"base64": base64.b64encode(row["payload"]).decode()})}
    if certs_json and row["fields"] and '"certs"' in row["fields"]:
        fields = json.loads(row["fields"])
        # what is no certificate stays as it is
        fields["certs"] = [{"cert": got} if (got := parse_certificate(base64.b64decode(c["base64"]))) else c for c in fields["certs"]]
        return row | {"fields": json.dumps(fields, sort_keys=True, default=str)}
    return row


def parse_packets(packets: DataFrame, select: str | None = None, fmt: str = "", every: bool = False, dns_json: bool = True, certs_json: bool = False) -> DataFrame:
    """One record for each packet (file, pkt_no, ts_sec, ts_nanos, linktype, data) that has one of the types.

    The selection runs inside the parsing stage, so other packets never leave it. Narrow: no shuffle.
    fmt chooses fingerprint formats (FP22); every keeps packets above IP without a message too.
    Without dns_json the fields of a DNS message are its bytes in base64; with certs_json those of
    certificates are decoded.
    """
    wanted, chosen = selected(select), formats(fmt)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, no, sec, nanos, linktype, data in zip(*(frame[c] for c in ("file", "pkt_no", "ts_sec", "ts_nanos", "linktype", "data")), strict=True):
                row = record(bytes(data), int(linktype), chosen) if data is not None else None
                if every and row is not None or row is not None and row["msg_type"] is not None if wanted is None else row is not None and row["msg_type"] in wanted:
                    rows.append({"file": file, "pkt_no": no, "event_start": sec + round(nanos / 1000) / 1e6, **_shown(row, dns_json, certs_json)})
            out = pd.DataFrame(rows, columns=["file", "pkt_no", "event_start", *NAMES])
            yield out.astype({c: "Int64" for c in ("src_port", "dst_port", "protocol", "ip_version", "ttl", "ip_id", "seq", "flags")})

    return packets.select("file", "pkt_no", "ts_sec", "ts_nanos", "linktype", "data").mapInPandas(run, f"file string, pkt_no long, event_start double, {RECORD}")


def parse_reassembled(packets: DataFrame, select: str | None = None, fmt: str = "", dns_json: bool = True, certs_json: bool = False) -> DataFrame:
    """The records of parse_packets, with `reassembly`, where messages over several segments or datagrams are put together first.

    The record of such a message stands at its first packet, and its other packets have none. One
    shuffle of the packets that can have a message, by flow; messages are parsed behind it, once.
    """
    wanted, chosen = selected(select), formats(fmt)
    schema = f"file string, pkt_no long, event_start double, {RECORD}, reassembly string"
    seen_types, types = arrow_schema(PACKETS), arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[Any, ...]]:
            for file, no, sec, nanos, linktype, data in rows_of(batches):
                got = parse_packet(data, linktype, look=False) if data is not None else None
                if got is None:
                    continue
                protocol, payload = got.get("protocol"), got.get("payload")
                if protocol in (6, 17) and not payload and not (got.get("flags") or 0) & 2:
                    continue  # nothing that could be a message
                joins = payload and (protocol == 6 or protocol == 17 and likely_fragment(payload))
                key = [got[k] for k in KEY] if joins else [None] * len(KEY)
                yield (*key, file, no, sec + round(nanos / 1000) / 1e6, linktype, data, got["seq"] if joins and protocol == 6 else None, payload if joins else None)

        return batches_of(rows(), seen_types)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(packet: tuple[Any, ...], new: dict[str, Any] | None = None, status: str = "none") -> Iterator[tuple[Any, ...]]:
            file, no, ts, linktype, data = packet
            row = record(data, linktype, chosen, new is None)
            row = _shown(row, dns_json, certs_json) if new is None else row | _shown(new, dns_json, certs_json)
            if row["msg_type"] is not None and (wanted is None or row["msg_type"] in wanted):
                yield (file, no, ts, *(row[n] for n in NAMES), status)

        def rows() -> Iterator[tuple[Any, ...]]:
            for (_, _, src, dst, protocol), group in groupby(rows_of(batches), key=lambda r: r[:5]):
                if protocol is None:
                    for row in group:
                        yield from own(row[5:10])
                elif protocol == 6:
                    for members, data, status, _ in stream_messages((r[5:10], r[7], r[10], r[11]) for r in group):
                        new = message(data, src, dst, chosen) if len(members) > 1 else None
                        if new and new["msg_type"] is not None:
                            yield from own(members[0], new, status)
                        else:
                            for packet in members:
                                yield from own(packet)
                else:
                    for packet, messages in datagram_messages((r[5:10], r[7], r[11]) for r in group):
                        found = [(members[0], message(data, src, dst, chosen, kind)) for members, kind, data in messages if len(members) > 1]
                        found = [(first, new) for first, new in found if new["msg_type"] is not None]
                        for first, new in found:
                            if first == packet:
                                yield from own(packet, new, "reassembled")
                        if not found:
                            yield from own(packet)

        return batches_of(rows(), types)

    seen = packets.select("file", "pkt_no", "ts_sec", "ts_nanos", "linktype", "data").mapInArrow(decode, PACKETS)
    return by_flow(seen, "file", "pkt_no", "ts", "linktype", "data", "seq", "payload").mapInArrow(parse, schema)


def record_json(metadata: bool = False) -> Column:
    """K1: a record as a JSON line; keys without a value are left out."""
    kind = F.substring_index("fingerprint", "/", 1)
    tail = F.struct("src_ip", "dst_ip", "protocol", "src_port", "dst_port", "event_start")
    ip = F.struct(F.col("ip_version").alias("version"), "ttl", F.col("ip_id").alias("id"))
    parts = [
        F.when(F.col("fingerprint").isNotNull(), F.concat(F.lit('"fingerprints":{"'), kind, F.lit('":'), F.to_json(F.struct(F.col("fingerprint").alias("f"))).substr(F.lit(6), F.length("fingerprint") + 2), F.lit("}"))),
        F.when(F.col("fields").isNotNull(), F.concat(F.lit('"'), F.col("msg_type"), F.lit('":'), F.col("fields"))),
        F.when(F.lit(metadata), F.concat(F.lit('"ip":'), F.to_json(ip))),
        F.when(F.size("encapsulations") > 0, F.concat(F.lit('"encapsulations":'), F.to_json("encapsulations"))),
        F.regexp_extract(F.to_json(tail), r"^\{(.*)\}$", 1),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def write_records(records: DataFrame, path: str, per_file: int | None = None, compression: str = "none") -> None:
    """K1, K3, K4: JSON lines; a file has at most per_file records."""
    out = records.select(record_json(metadata=True).alias("value")).write.option("compression", compression)
    (out.option("maxRecordsPerFile", per_file) if per_file else out).text(path)


def kept_packets(packets: DataFrame, records: DataFrame) -> DataFrame:
    """The packets that made a record."""
    return packets.join(records.select("file", "pkt_no"), ["file", "pkt_no"], "left_semi")


def rejected_packets(packets: DataFrame, records: DataFrame) -> DataFrame:
    """The packets that made none."""
    return packets.join(records.select("file", "pkt_no"), ["file", "pkt_no"], "left_anti")
