"""Column expressions for URL identity and host safety."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# IPv4 ranges that no fetch may reach (first, last).
BLOCKED_V4 = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("168.63.129.16", "168.63.129.16"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
]
# Name endings that stay inside a network.
RESERVED_SUFFIXES = ("local", "internal", "localhost", "home.arpa")

#: scheme, authority, path, query, fragment.
SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
AUTHORITY = r"^(?:.*@)?(\[[^\]]*\]|[^:\[\]]*)(?::(\d*))?$"
MAX_PORT = 65535


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, SPLIT, i)


def _authority(url: Column) -> tuple[Column, Column]:
    """(host in lower case without brackets, '' where there is none; port number, null where there is none, -1 where it is none that can be)."""
    authority = _part(url, 2)
    host = F.lower(F.regexp_extract(authority, AUTHORITY, 1))
    digits = F.ltrim(F.regexp_extract(authority, AUTHORITY, 2), F.lit("0"))
    port = F.when(F.length(digits) > 5, -1).otherwise(digits.try_cast("int"))
    port = F.when(port > MAX_PORT, -1).when(F.regexp_extract(authority, AUTHORITY, 2).rlike("^0+$"), 0).otherwise(port)
    return F.regexp_replace(host, r"^\[|\]$", ""), port


def canonical_url(url: Column) -> Column:
    """Absolute http(s) URL with lower-case scheme and host, without default port and fragment; null for others, and for ports over 65535."""
    url = F.trim(url)
    scheme = F.lower(_part(url, 1))
    host, port = _authority(url)
    default = port.isNull() | (port == 0) | ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    path = F.coalesce(F.nullif(_part(url, 3), F.lit("")), F.lit("/"))
    query = F.when(_part(url, 4) == "?", "").otherwise(_part(url, 4))
    ok = scheme.isin("http", "https") & (host != "") & (F.coalesce(port, F.lit(0)) >= 0)
    return F.when(ok, F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port.cast("string"))), path, query))


def _number(address: str) -> int:
    return int(ipaddress.IPv4Address(address))


@F.pandas_udf(BooleanType())
def _safe_v6(values: pd.Series) -> pd.Series:
    def safe(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            ip = ipaddress.IPv6Address(text)
        except ValueError:
            return False
        inner = ip.ipv4_mapped or (ipaddress.IPv4Address(ip.packed[12:]) if ip in ipaddress.ip_network("64:ff9b::/96") else None)
        if inner is not None:
            return inner.is_global and not inner.is_multicast and str(inner) != "168.63.129.16"
        tunnels = ("64:ff9b:1::/48", "2002::/16", "2001::/32")
        return ip.is_global and not (ip.is_multicast or ip.is_reserved) and not any(ip in ipaddress.ip_network(n) for n in tunnels)

    return values.map(safe)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def safe_host(host: Column, v6: bool = False) -> Column:
    """Whether a host is a public name or address. IPv6 literals count as unsafe unless ``v6`` asks for the Arrow check."""
    host = F.rtrim(F.lower(host), F.lit("."))
    six = F.coalesce(_safe_v6(F.when(host.contains(":"), host)), F.lit(False)) if v6 else F.lit(False)
    return F.coalesce(F.when(host.contains(":"), six).otherwise(let(host, _safe_name)), F.lit(False))


def _safe_name(host: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    is_v4 = host.rlike(rf"^{octet}(\.{octet}){{3}}$")
    number = F.aggregate(F.split(host, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + part.try_cast("long"))
    blocked = let(number, lambda n: reduce(lambda a, b: a | b, [n.between(_number(first), _number(last)) for first, last in BLOCKED_V4]))
    numeric = host.rlike(r"^(0[xX][0-9a-fA-F]+|0[oO][0-7]+|[0-9]+)(\.(0[xX][0-9a-fA-F]+|0[oO][0-7]+|[0-9]+))*$")
    reserved = host.rlike(rf"(^|\.)({'|'.join(s.replace('.', chr(92) + '.') for s in RESERVED_SUFFIXES)})$")
    name = host.contains(".") & ~numeric & ~reserved & (host != "localhost.localdomain")
    return F.when(is_v4, ~blocked).otherwise(name)


def safe_url(url: Column, v6: bool = False) -> Column:
    """struct(url, reason): the canonical URL if it may be fetched, else why it may not."""
    scheme = F.lower(_part(url, 1))
    authority = _part(url, 2)
    host, port = _authority(url)
    host = F.rtrim(host, F.lit("."))
    bare_v6 = (F.length(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), "[^:]", "")) > 1) & ~F.regexp_replace(authority, r"^.*@", "").startswith("[")
    reason = (
        F.when(bare_v6, "target host is not allowed")
        .when(~scheme.isin("http", "https"), "only http and https URLs are allowed")
        .when(authority.contains("@") & ~authority.rlike("^:?@"), "userinfo in URL is not allowed")
        .when((host == "") | ~safe_host(host, v6), "target host is not allowed")
        .when(port.isNotNull() & ~port.isin(80, 443), "non-standard ports are not allowed")
    )
    reason = F.when(url.isNull() | (_part(url, 1) == ""), "only http and https URLs are allowed").otherwise(reason)
    default = port.isNull() | ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    path = F.coalesce(F.nullif(_part(url, 3), F.lit("")), F.lit("/"))
    full = F.concat(scheme, F.lit("://"), shown, F.when(default, "").otherwise(F.concat(F.lit(":"), port.cast("string"))), path, F.when(_part(url, 4) == "?", "").otherwise(_part(url, 4)))
    return F.struct(F.when(reason.isNull(), full).alias("url"), reason.alias("reason"))


def url_key(url: Column) -> Column:
    """Identity key: case folded, without fragment and trailing slashes; relative URLs stay."""
    text = F.nullif(F.lower(F.trim(url)), F.lit(""))
    absolute = _part(text, 1) != ""
    query = F.when(_part(text, 4) == "?", "").otherwise(_part(text, 4))
    return F.when(absolute, F.concat(_part(text, 1), F.lit("://"), _part(text, 2), F.rtrim(_part(text, 3), F.lit("/")), query)).otherwise(F.rtrim(text, F.lit("/")))


def target_key(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a hex digest: its first 64 bits, unsigned, modulo ``shards``."""
    return (F.conv(F.substring(key, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(shards)).cast("int")
