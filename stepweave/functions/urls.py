"""URLs as Column expressions."""

from __future__ import annotations

import hashlib
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stepweave.functions.text import col, filled

# The pieces of a public suffix that are looked for, longest first. A fuller list is a parameter.
SUFFIXES = ["com.sg", "com.au", "co.uk", "co.jp", "com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "example", "test"]


def with_scheme(c: Column | str) -> Column:
    return F.when(col(c).rlike(r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"), col(c)).otherwise(F.concat(F.lit("http://"), col(c)))


def scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"^([a-zA-Z][a-zA-Z0-9+\-.]*)://", 1))


def host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"://([^/?#]*)", 1))


def path(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"://[^/?#]*([^?#]*)", 1)


def query(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"\?([^#]*)", 1)


def fragment(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"#(.*)$", 1)


def bare_host(c: Column | str, suffixes: list[str] = SUFFIXES) -> Column:
    """The host without a leading www and without its public suffix: other suffixes compare equal."""
    suffix = "|".join(s.replace(".", r"\.") for s in suffixes)
    return F.regexp_replace(F.regexp_replace(col(c), rf"\.({suffix})$", ""), r"^www\.", "")


def normalized_url(c: Column | str, full: bool = True, suffixes: list[str] = SUFFIXES) -> Column:
    """Scheme and host lower-cased, www and suffix dropped, a lone slash dropped; full keeps query and fragment."""
    own = with_scheme(c)
    place = F.when(path(own) == "/", "").otherwise(path(own))
    out = F.concat(scheme(own), F.lit("://"), bare_host(host(own), suffixes), place)
    if full:
        out = F.concat(out, F.when(query(own) != "", F.concat(F.lit("?"), query(own))).otherwise(""), F.when(fragment(own) != "", F.concat(F.lit("#"), fragment(own))).otherwise(""))
    return out


def equal_urls(a: Column | str, b: Column | str, full: bool = True, suffixes: list[str] = SUFFIXES) -> Column:
    """Nulls are equal to each other alone."""
    return normalized_url(a, full, suffixes).eqNullSafe(normalized_url(b, full, suffixes))


def without_query(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\?[^#]*", "")


def parameter(c: Column | str, key: str) -> Column:
    """A query parameter's first value, decoded; null without it."""
    return F.try_url_decode(filled(F.regexp_extract(col(c), rf"[?&]{key}=([^&#]*)", 1)))


def path_part(c: Column | str, n: int) -> Column:
    """Part n, from 0, of the URL split at slashes, without a query; negative n counts from the end."""
    parts = F.split(F.regexp_replace(col(c), r"[?#].*$", ""), "/")
    return F.try_element_at(parts, F.lit(n + 1 if n >= 0 else n))


def path_pairs(c: Column | str, keys_at: int, values_at: int) -> Column:
    """A map of two comma lists that stand in two parts of the path."""
    keys, values = F.split(path_part(c, keys_at), ","), F.split(path_part(c, values_at), ",")
    return F.when(F.size(keys) == F.size(values), F.map_from_arrays(keys, values))


def is_url(c: Column | str) -> Column:
    return F.coalesce((scheme(c) != "") & (host(c) != ""), F.lit(False))


def matches_all(c: Column | str, patterns: list[str]) -> Column:
    found = F.lit(True)
    for pattern in patterns:
        found = found & col(c).rlike(pattern)
    return F.coalesce(found, F.lit(False))


@F.pandas_udf(StringType())
def file_name(url: pd.Series) -> pd.Series:
    """host_base_hash: as much of the hash as fits, eight digits at most, in a name of 255."""

    def one(u):
        if u is None:
            return None
        host, base = urlsplit(u).netloc, u.rsplit("/", 1)[-1]
        room = 254 - len(host) - len(base)
        return f"{host}_{base}_{hashlib.blake2b(u.encode()).hexdigest()[: min(8, room)]}"

    return url.map(one)
