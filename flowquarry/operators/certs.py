"""Certificate audit (B2, S10, J14, F7, G14's input)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.detect import weak_certificate
from flowquarry.parse.x509 import parse_certificate

SCHEMA = (
    "id long, sha256 string, subject string, issuer string, not_before string, not_after string, key_alg string, key_bits int, exponent_bits int, curve string,"
    " sig_alg string, self_issued boolean, modulus string, alt_names array<string>, complete boolean"
)
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


def parse_certificates(certs: DataFrame) -> DataFrame:
    """Rows (id, base64 or der) as parsed certificates; one that cannot be read is incomplete."""
    der = F.col("der") if "der" in certs.columns else F.try_to_binary(F.col("base64"), F.lit("base64"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, data in zip(frame["id"], frame["der"], strict=True):
                try:
                    got = parse_certificate(bytes(data)) if data is not None else None
                except (IndexError, ValueError):
                    got = None
                row = {k: got.get(k) for k in FIELDS} if got else dict.fromkeys(FIELDS)
                if got:
                    row |= {k: json.dumps(got[k], sort_keys=True) for k in ("subject", "issuer")}
                rows.append(row | {"id": i, "complete": got is not None})
            out = pd.DataFrame(rows, columns=FIELDS)
            yield out.astype({"key_bits": "Int32", "exponent_bits": "Int32"})

    return certs.select("id", der.alias("der")).mapInPandas(run, SCHEMA)


def with_weakness(certs: DataFrame, roots: DataFrame, at: Column | None = None) -> DataFrame:
    """Certs with `trusted`, whether a root (subject) issued them by name, and `weak`."""
    now = at if at is not None else F.current_timestamp()
    own = roots.select(F.col("subject").alias("__fq_r")).distinct()
    rows = certs.join(own, F.col("issuer") == F.col("__fq_r"), "left").withColumn("trusted", F.col("__fq_r").isNotNull()).drop("__fq_r")
    valid = F.coalesce((F.to_timestamp("not_before") <= now) & (F.to_timestamp("not_after") >= now), F.lit(False))
    conformant = F.col("complete") & F.col("not_before").isNotNull() & F.col("not_after").isNotNull()
    weak = weak_certificate(F.col("key_alg"), F.col("key_bits"), F.col("exponent_bits"), F.col("curve"), F.col("sig_alg"), valid, conformant, F.col("self_issued"), F.col("trusted"))
    return rows.withColumn("weak", F.coalesce(weak, F.lit(True)))
