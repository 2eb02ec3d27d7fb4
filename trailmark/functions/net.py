"""Addresses: IPv4 as longs, IPv6 as 32 lower-case hex digits (text order is address order)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_V6_SHAPE = r"^[0-9a-fA-F:]+$"


def is_v4(ip: Column) -> Column:
    return ip.rlike(_V4)


def v4_number(ip: Column) -> Column:
    part = lambda i: F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
    number = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    return F.when(is_v4(ip), number)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, so long rules stay small expressions."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _plain_groups(ip: Column) -> Column:
    """Lower-case IPv6 text with a dotted tail written as two groups."""
    dotted = r"\d+\.\d+\.\d+\.\d+$"
    rewritten = let(v4_number(F.regexp_extract(ip, dotted, 0)), lambda n: F.concat(
        F.regexp_replace(ip, dotted, ""), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535))))
    return F.lower(F.when(ip.contains("."), rewritten).otherwise(ip))


def v6_hex(ip: Column) -> Column:
    """Expanded IPv6 address, or null when the text is not one."""
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    none = F.array().cast("array<string>")

    def expand(text: Column) -> Column:
        halves = F.struct(
            groups(F.split_part(text, F.lit("::"), F.lit(1))).alias("l"),
            F.when(text.contains("::"), groups(F.split_part(text, F.lit("::"), F.lit(2)))).otherwise(none).alias("r"))
        shape = text.rlike(_V6_SHAPE) & ~text.rlike(r"::.*::|:::|[0-9a-f]{5}|^:[^:]|[^:]:$")

        def join(h: Column) -> Column:
            missing = F.lit(8) - F.size(h["l"]) - F.size(h["r"])
            full = F.concat(h["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), h["r"])
            fits = F.when(text.contains("::"), missing >= 1).otherwise(missing == 0)
            return F.when(shape & fits, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

        return let(halves, join)

    return F.when(ip.contains(":"), let(_plain_groups(ip), expand))


def is_ip(ip: Column) -> Column:
    return F.coalesce(is_v4(ip), F.lit(False)) | v6_hex(ip).isNotNull()


def ip_key(ip: Column) -> Column:
    """Address in comparable text form: '4' + 8 hex digits or '6' + 32 hex digits; null if invalid."""
    v4 = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(v4_number(ip))), 8, "0"))
    return F.when(is_v4(ip), v4).otherwise(F.concat(F.lit("6"), v6_hex(ip)))


def cidr_bounds(cidr: Column) -> Column:
    """struct(lo, hi, len) of a CIDR or single address in `ip_key` form; null when invalid."""
    def bounds(p: Column) -> Column:
        key, length = p["key"], p["len"]
        family, digits = F.substring(key, 1, 1), F.substr(key, F.lit(2))
        width = F.length(key) - 1
        whole, rest = F.floor(length / 4).cast("int"), length % 4
        nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
        mask = F.when(rest == 1, 8).when(rest == 2, 12).when(rest == 3, 14).otherwise(0)
        head = F.substr(digits, F.lit(1), whole)
        low = F.when(rest > 0, F.lower(F.hex(nibble.bitwiseAND(mask)))).otherwise("")
        high = F.when(rest > 0, F.lower(F.hex(nibble.bitwiseAND(mask).bitwiseOR(F.lit(15) - mask)))).otherwise("")
        return F.when(
            key.isNotNull() & length.between(0, width * 4),
            F.struct(F.concat(family, F.rpad(F.concat(head, low), width, "0")).alias("lo"),
                     F.concat(family, F.rpad(F.concat(head, high), width, "f")).alias("hi"), length.alias("len")))

    text = F.trim(cidr)
    suffix = F.split_part(text, F.lit("/"), F.lit(2))
    given = F.struct(
        F.when(text.rlike(r"^[^/]+(/\d*)?$"), ip_key(F.split_part(text, F.lit("/"), F.lit(1)))).alias("key"),
        suffix.alias("suffix"))
    sized = lambda g: F.struct(
        g["key"].alias("key"),
        F.when(g["suffix"] == "", (F.length(g["key"]) - 1) * 4).otherwise(g["suffix"].try_cast("int")).alias("len"))
    return let(given, lambda g: let(sized(g), bounds))


def python_bounds(cidr: str) -> tuple[str, str] | None:
    """Bounds of one configured CIDR, for literal predicates over short settings lists."""
    import ipaddress

    try:
        net = ipaddress.ip_network(cidr.strip(), strict=False)
    except ValueError:
        return None
    width = 8 if net.version == 4 else 32
    f = lambda a: f"{net.version}{int(a):0{width}x}"
    return f(net.network_address), f(net.broadcast_address)


def ip_in_list(ip: Column, cidrs) -> Column:
    """Is the address inside any of a short, configured list of CIDRs?"""
    key = ip_key(ip)
    bounds = [b for b in map(python_bounds, cidrs) if b]

    def inside(k: Column) -> Column:
        hit = F.lit(False)
        for lo, hi in bounds:
            hit = hit | ((F.length(k) == len(lo)) & k.between(lo, hi))
        return hit

    return F.coalesce(let(key, inside), F.lit(False))


def ip_network(ip: Column) -> Column:
    """IPv4 /24 or IPv6 /48 of an address; '' when invalid."""
    v4 = F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))

    def prefix(h: Column) -> Column:
        group = lambda i: F.coalesce(F.nullif(F.regexp_replace(F.substr(h, F.lit(i), F.lit(4)), "^0+", ""), F.lit("")), F.lit("0"))
        joined = F.concat_ws(":", group(1), group(5), group(9))
        # zero groups at the end of the prefix belong to the "::" run, as in the usual text form
        return F.when(h.isNotNull(), F.concat(F.regexp_replace(joined, "(^|:)0(:0)*$", ""), F.lit("::/48"))).otherwise("")

    return F.when(is_v4(ip), v4).when(ip.contains(":"), let(v6_hex(ip), prefix)).otherwise("")


def ip_hash(ip: Column, secret: str) -> Column:
    """First 16 hex digits of HMAC-SHA256(secret, ip); the pads are computed once on the driver."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, ip.cast("binary")), 256))
    return F.when(ip == "", F.lit("")).otherwise(F.substring(F.sha2(F.concat(outer, first), 256), 1, 16))


def client_ip(remote: Column, forwarded: Column, cdn_header: Column, config, cdn_ranges=()) -> Column:
    """struct(ip, forwarded): the client address behind trusted proxies."""
    if not config.proxy_header:
        via_cdn = (cdn_header != "") & is_ip(cdn_header) & ip_in_list(remote, cdn_ranges)
        via_cdn = F.coalesce(via_cdn, F.lit(False))
        return F.struct(
            F.when(via_cdn, cdn_header).otherwise(remote).alias("ip"), via_cdn.alias("forwarded")
        )
    parts = F.transform(F.reverse(F.split(F.coalesce(forwarded, F.lit("")), ",")), lambda x: F.trim(x))
    outside = F.filter(parts, lambda p: is_ip(p) & ~ip_in_list(p, config.trusted_proxies))
    found = F.when(ip_in_list(remote, config.trusted_proxies), F.get(outside, F.lit(0)))
    return F.struct(F.coalesce(found, remote).alias("ip"), found.isNotNull().alias("forwarded"))


def proxy_suspected(forwarded: Column, *headers: Column) -> Column:
    """Forwarding headers are present but the connection's own address is in use."""
    seen = F.lit(False)
    for h in headers:
        seen = seen | (F.coalesce(h, F.lit("")) != "")
    return ~forwarded & seen
