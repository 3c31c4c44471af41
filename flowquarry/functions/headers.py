"""HTTP header lines (X22) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Request headers whose values may be reported, and those of them that are sensitive.
REPORTED = (
    "user-agent", "host", "x-forwarded-for", "via", "upgrade", "referer", "authorization", "content-type", "content-length", "accept", "accept-encoding",
    "accept-language", "content-disposition", "cookie", "cache-control", "connection",
)
SENSITIVE = ("authorization", "cookie")
MODES = ("none", "non_sensitive", "all")


def header_list(raw: Column) -> Column:
    """(name, value) of the header lines before the first empty line, in order; lines without a colon are left out.

    Null stays null.
    """
    lines = F.filter(F.split(F.split(raw, r"\r?\n\r?\n").getItem(0), r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    return F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))


def header_value(headers: Column, name: str) -> Column:
    """The value of the first header of that name, whatever its case; else null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def reported_headers(headers: Column, mode: str) -> Column:
    """Every header's name, with its value if it is a known one that is not sensitive, or, in mode all, any known one."""
    if mode not in MODES:
        raise ValueError(f"unknown mode of headers {mode}")
    if mode == "none":
        return F.array().cast("array<struct<name:string,value:string>>")
    shown = [n for n in REPORTED if mode == "all" or n not in SENSITIVE]
    return F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.when(F.lower(h["name"]).isin(shown), h["value"]).alias("value")))


def body_sample(body: Column, most: int = 0) -> Column:
    """The first bytes of a body, 2048 at most; nothing unless asked for."""
    return F.substring(body, 1, min(most, 2048))
