"""URLs: resolving, canonical form, patterns."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import let, trim

# Query parameters that only track visitors, besides utm_*.
TRACKING = ["gh_src", "source", "ref", "fbclid", "gclid", "mc_cid", "mc_eid"]

#: An absolute http(s) URL that needs no resolving: scheme, login, host, port, path, query, fragment.
_PARTS = r"^([hH][tT][tT][pP][sS]?)://(?:([^/?#@]*)@)?([^/?#@:\[\]\s]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PLAIN = r"^[hH][tT][tT][pP][sS]?://(?:[!-~&&[^/?#@:\[\]\\]]*(?::[!-~&&[^/?#@\\]]*)?@)?[A-Za-z0-9.\-_]+(?::\d*)?(?:/[!-~&&[^?#\\\"<>`{}]]*)?(?:\?[!-~&&[^#\"<>]]*)?(?:#[!-~]*)?$"
_DOTS = r"/(?:\.|%2[eE]){1,2}(?:/|$|\?|#)"


@F.pandas_udf(T.StringType())
def _resolve(values: pd.Series, bases: pd.Series) -> pd.Series:
    """Relative and unusual URLs, by the standard library: http(s) only, host in lower case, odd characters escaped."""

    def one(value: str | None, base: str | None) -> str | None:
        if value is None:
            return None
        try:
            got = urlsplit(urljoin(base or "", value.replace("\\", "/")))
            port = got.port
        except ValueError:
            return None
        if got.scheme not in ("http", "https") or not got.hostname or any(c.isspace() for c in got.netloc):
            return None
        try:
            host = got.hostname if got.hostname.isascii() else got.hostname.encode("idna").decode()
        except UnicodeError:
            return None
        login = f"{got.netloc.rpartition('@')[0]}@" if "@" in got.netloc else ""
        own = "" if port in (None, {"http": 80, "https": 443}[got.scheme]) else f":{port}"
        escape = lambda s, safe: quote(s, safe=f"%!$&'()*+,;=:@/~-._[]|^{safe}")
        query = f"?{escape(got.query, '?`{}')}" if got.query else ""
        part = f"#{escape(got.fragment, '?{}')}" if got.fragment else ""
        return f"{got.scheme}://{login}{host}{own}{escape(got.path, '') or '/'}{query}{part}"

    return pd.Series([one(v, b) for v, b in zip(values, bases, strict=True)], dtype=object)


def _normal(url: Column) -> Column:
    """A plain absolute URL with scheme and host in lower case, without its default port and with a path."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, port = F.lower(part(1)), part(4)
    login = F.when(part(2) != "", F.concat(part(2), F.lit("@"))).otherwise("")
    own = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    query = F.when(part(6) != "", F.concat(F.lit("?"), part(6))).otherwise("")
    fragment = F.when(part(7) != "", F.concat(F.lit("#"), part(7))).otherwise("")
    return F.concat(scheme, F.lit("://"), login, F.lower(part(3)), own, F.when(part(5) == "", "/").otherwise(part(5)), query, fragment)


def absolute_url(value: Column, base: Column | None = None) -> Column:
    """value resolved against base; null unless it is an http(s) URL. Plain URLs stay in the JVM."""
    value = trim(value)
    base = F.lit(None).cast("string") if base is None else base

    def test(v: Column, b: Column) -> Column:
        """1 for a plain URL, 2 for a path from the root of a plain base, else 0."""
        rooted = v.rlike(r"^/(?!/)[!-~&&[^?#\\\"<>`{}]]*(?:\?[!-~&&[^#\"<>]]*)?(?:#[!-~]*)?$") & b.rlike(_PLAIN)
        return F.when(v.rlike(_DOTS), 0).when(v.rlike(_PLAIN), 1).when(rooted, 2).otherwise(0)

    known = F.struct(value.alias("v"), base.alias("b"), test(value, base).alias("k"))
    ready = let(known, lambda x: F.when(x["k"] == 1, x["v"]).when(x["k"] == 2, F.concat(F.regexp_extract(x["b"], r"^([^:]+://[^/?#]*)", 1), x["v"])))
    resolved = _resolve(F.when(test(value, base) == 0, value), base)
    return F.coalesce(let(ready, _normal), resolved)


def canonicalize_url(value: Column, base: Column | None = None) -> Column:
    """The form of a URL that names a posting: no login, fragment, tracking or trailing slash, parameters in order."""
    return let(absolute_url(value, base), _canonical)


def _canonical(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    pairs = F.transform(F.filter(F.split(part(6), "&"), lambda p: p != ""), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("pair")))
    kept = F.filter(pairs, lambda p: ~(F.lower(p["name"]).startswith("utm_") | F.lower(p["name"]).isin(TRACKING)))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: p["pair"]), "&")
    port = let(part(4), lambda p: F.when(p != "", F.concat(F.lit(":"), p)).otherwise(""))
    path = let(F.regexp_replace(part(5), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
    asked = let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(part(1), F.lit("://"), part(3), port, path, asked)


def domain_of(url: Column) -> Column:
    """Host in lower case, '' for what is no URL."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def publicise_url(url: Column) -> Column:
    """Origin and path: nothing that a query or fragment may hold. '' for what is no URL."""
    return F.coalesce(F.regexp_extract(absolute_url(url), r"^([^?#]*)", 1), F.lit(""))


def url_origin(url: Column) -> Column:
    """Scheme, host and port; null for what is no http(s) URL."""
    pattern = r"^(https?://)(?:[^/?#@]*@)?([^/?#]*)"
    return let(absolute_url(url), lambda full: F.concat(F.regexp_extract(full, pattern, 1), F.regexp_extract(full, pattern, 2)))


def url_wait_pattern(url: Column, typed: Column | None = None) -> Column:
    """A glob for the page of a URL, without what differs between runs: ids, typed words, queries."""
    words = F.coalesce(typed if typed is not None else F.array().cast("array<string>"), F.array().cast("array<string>"))
    return let(F.struct(absolute_url(url).alias("url"), F.filter(words, lambda w: w != "").alias("words")), lambda x: _wait_pattern(x["url"], x["words"]))


def _wait_pattern(full: Column, words: Column) -> Column:
    part = lambda i: F.regexp_extract(full, _PARTS, i)
    varies = lambda s: s.rlike(r"^\d+$|\d{4,}|^[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|[*?\[\]{}\\]") | (F.length(s) > 40) | F.array_contains(words, s) | F.array_contains(words, F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    path = F.array_join(F.transform(F.split(part(5), "/"), lambda s: F.when(F.coalesce(varies(s), F.lit(False)), "*").otherwise(s)), "/")
    tail = lambda p: F.when(part(6) != "", "?*").when(part(7) != "", "#**").when(p.endswith("*"), "").otherwise("*")
    return let(path, lambda p: F.concat(F.lit("**"), p, tail(p)))


def glob_regex(pattern: Column) -> Column:
    """** any characters, * any but /, the rest as it stands."""
    quoted = F.regexp_replace(pattern, r"[.+?^${}()|\[\]\\]", r"\\$0")
    deep = F.replace(quoted, F.lit("**"), F.lit("\u0001"))
    return F.concat(F.lit("^"), F.replace(F.replace(deep, F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def glob_matches(pattern: Column, url: Column) -> Column:
    return F.regexp_like(url, glob_regex(pattern))
