"""Scalar functions on URIs, dates and names, all built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "yyyy")
OFFSET = "(?<=:[0-9]{2}(?:[.][0-9]{3})?)(Z|[+-][0-9]{2}:?[0-9]{2})$"
IRI = '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s<>"{}|^`\\\\]+$'


def local_name(uri: Column) -> Column:
    """The part after the last #, else after the last /."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def base_of(uri: Column) -> Column:
    return F.substring(uri, F.lit(1), F.length(uri) - F.length(local_name(uri)))


def readable_name(uri: Column) -> Column:
    """The local name in words: other characters become blanks, capitals start a word."""
    words = F.regexp_replace(local_name(uri), "[^A-Za-z0-9]+", " ")
    return F.trim(F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1 $2"))


def is_valid_iri(uri: Column) -> Column:
    return F.coalesce(uri.rlike(IRI), F.lit(False))


def safe_date(text: Column) -> Column:
    """Timestamp by the first format that fits; null without a four-digit year. A time may end in Z or an offset such as +02:00
    or -0500; without one it is UTC, whatever the session's zone."""
    offset = F.regexp_extract(text, OFFSET, 1)
    named = F.when(offset.isin("", "Z"), "+00:00").otherwise(F.regexp_replace(offset, "^(.[0-9]{2}):?([0-9]{2})$", "$1:$2"))
    zoned = F.concat(F.regexp_replace(text, OFFSET, ""), named)
    return F.when(text.rlike("[0-9]{4}"), F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f"{f}XXX")) for f in DATE_FORMATS]))


def iso(ts: Column) -> Column:
    """The instant in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def doc_id(dataset: Column, uri: Column) -> Column:
    """One record in two datasets is two documents."""
    return F.md5(F.concat(dataset, uri))


def route_language(lang: Column, supported: list[str]) -> Column:
    """A supported tag stays; any other, or none, becomes the first supported one."""
    return F.when(lang.isin(supported), lang).otherwise(F.lit(supported[0]))


def tokens(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def query_words(text: str) -> list[str]:
    """The words of a query, cut as tokens() cuts texts."""
    return re.findall(r"[^\W_]+", text.lower())


def expand_prefix(name: Column, prefixes: dict[str, str]) -> Column:
    """prefix:name as a full URI where the prefix is known; anything else stays."""
    out = name
    for prefix, uri in prefixes.items():
        out = F.when(name.startswith(f"{prefix}:"), F.concat(F.lit(uri), F.substring(name, len(prefix) + 2, 1 << 30))).otherwise(out)
    return out


def resolve_reference(value: Column, base: str, prefixes: dict[str, str] | None = None) -> Column:
    """@@x is an external URI (a known prefix is expanded), @x a record of this dataset, anything else stays; @@ is tested
    first."""
    external = expand_prefix(F.substring(value, 3, 1 << 30), prefixes or {})
    return F.when(value.startswith("@@"), external).when(value.startswith("@"), F.concat(F.lit(base), F.substring(value, 2, 1 << 30))).otherwise(value)


def great_circle_km(lat1: Column, long1: Column, lat2: Column, long2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(long2 - long1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
