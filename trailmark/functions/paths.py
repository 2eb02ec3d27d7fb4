"""URL paths and untrusted text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trailmark.sources.registry import lookup

_SAFE = r"^[A-Za-z0-9._~/-]*$"


def _reencode(segment: Column) -> Column:
    """Percent-decode and encode again, so every spelling of a segment is the same text."""
    literal = F.regexp_replace(segment, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.replace(literal, F.lit("+"), F.lit("%2B")))
    encoded = F.url_encode(F.coalesce(decoded, segment))
    for had, want in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(had), F.lit(want))
    return encoded


def normalize_path(uri: Column) -> Column:
    """Canonical path of a URL or request target: the key that joins requests, pages and history."""
    full = uri.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")
    path = F.when(full, F.regexp_extract(uri, r"(?s)^[^:]+://[^/?#]*([^?#]*)", 1)).otherwise(
        F.regexp_replace(uri, r"(?s)[?#].*$", "")
    )
    path = F.regexp_replace(F.concat(F.lit("/"), path), r"/{2,}", "/")
    path = F.when(path.rlike(_SAFE), path).otherwise(
        F.array_join(F.transform(F.split(path, "/"), _reencode), "/")
    )
    trimmed = F.regexp_replace(path, r"/+$", "")
    return F.when(trimmed == "", F.lit("/")).otherwise(trimmed)


def url_hash(path: Column) -> Column:
    return F.md5(F.lower(path))


def path_kind(path: Column) -> Column:
    # Labels of special paths, first match wins.
    p = F.lower(path)
    return (
        F.when(p == "/robots.txt", "robots")
        .when(p.isin("/llms.txt", "/llms-full.txt"), "llms")
        .when(p.rlike(r"sitemap[^/]*\.xml$|^/wp-sitemap"), "sitemap")
        .when(p.rlike(r"/feed$|/feed/|/rss$"), "feed")
        .when(p.startswith("/wp-json"), "api")
        .when(p.rlike(r"\.(?:jpe?g|png|gif|webp|avif|svg|css|js|woff2?|ico|pdf|mp4)$"), "asset")
        .otherwise("")
    )


def clean(text: Column, max_bytes: int | None = None) -> Column:
    """Valid UTF-8 on one line without control characters; for display, cut at a character boundary."""
    one_line = F.trim(F.regexp_replace(F.make_valid_utf8(text), r"[\x00-\x1F\x7F]+", " "))
    if max_bytes is None:
        return one_line
    head = F.make_valid_utf8(F.substring(one_line.cast("binary"), 1, max_bytes).cast("string"))
    return F.when(F.octet_length(one_line) <= max_bytes, one_line).otherwise(
        F.regexp_replace(head, "�+$", "")
    )


def excluded(uri: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        if p:
            out = out | uri.startswith(p)
    return out


def contains_text(col: Column, needle: str) -> Column:
    """Literal case-insensitive search; % and _ mean themselves."""
    return F.lower(col).contains(needle.lower())


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))


def same_site(host: Column, home: Column) -> Column:
    www = F.lit("www.")
    return (host == home) | (F.concat(www, host) == home) | (host == F.concat(www, home))


def referral_source(registry, referer: Column, uri: Column | None = None) -> Column:
    """Assistant that sent a visit: the referring host, else (live requests) utm_source."""
    by_host = lookup(registry.hosts, url_host(referer))
    if uri is None:
        return by_host
    utm = F.lower(F.substring(F.try_url_decode(F.regexp_extract(uri, r"[?&]utm_source=([^&#]*)", 1)), 1, 40))
    return F.coalesce(by_host, lookup(registry.utm, utm))


def csv_cell(value: Column) -> Column:
    """Neutralise text a spreadsheet would run as a formula."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
