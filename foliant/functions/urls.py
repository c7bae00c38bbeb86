"""URL functions as Columns: resolution, the guard against internal addresses, path and client-address checks."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed list: name services that answer with any address.
TUNNELS = (".nip.io", ".sslip.io", ".dns.army", ".dnsdojo.net", ".xip.io", ".localtest.me", ".vcap.me", ".lvh.me", ".fuf.me", ".encr.app")
PORTS = {"http": "80", "https": "443"}


def host_of(url: Column) -> Column:
    """The lower-case host without port, user and one final dot; null if the text isn't an absolute URL."""
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^[^@]*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def is_safe_url(url: Column) -> Column:
    """Whether an http(s) URL names a public host: no tunnel, local or private name or address, in any notation."""
    host = host_of(url)
    bare = F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), "^::ffff:", "")
    dotted = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
    private4 = r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.168\.|^(?:22[4-9]|2[3-9]\d|[3-9]\d\d)\."
    private6 = r"^::1?$|^fe80:|^f[cdf]"
    named = reduce(Column.__or__, [host.endswith(t) for t in (*TUNNELS, ".local", ".internal")]) | host.isin("localhost", "localhost.localdomain")
    numeric = host.rlike(r"^0[0-7]+(?:\.|$)|^0x[0-9a-f]+(?:\.|$)|^\d+$|^\d+(?:\.\d+){1,2}$|\.0x[0-9a-f]+$")
    address = F.when(bare.rlike(dotted), ~bare.rlike(private4)).when(host.contains(":") | host.startswith("["), ~bare.rlike(private6)).otherwise(~numeric)
    good = F.lower(url).rlike("^https?://") & ~named & address
    return F.coalesce(good, F.lit(False))


def _resolve(base: str | None, link: str | None) -> str | None:
    if link is None:
        return None
    try:
        parts = urlsplit(urljoin(base or "", link.strip()))
        if parts.scheme not in PORTS or not parts.hostname:
            return parts.geturl() if parts.scheme else link
        host, port = parts.hostname, f"{parts.port}" if parts.port else ""
        user = parts.netloc.rpartition("@")[0]
        place = (f"{user}@" if user else "") + (f"[{host}]" if ":" in host else host) + (f":{port}" if port and port != PORTS[parts.scheme] else "")
        return urlunsplit((parts.scheme, place, parts.path or "/", parts.query, parts.fragment))
    except ValueError:
        return link


@F.pandas_udf(StringType())
def resolve_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link made absolute; host lower-cased, default port dropped, an empty path '/'. Bad input stays as it is."""
    return pd.Series([_resolve(b, x) for b, x in zip(base, link, strict=True)])


def is_save_path(c: Column) -> Column:
    """A cover's file path: a .webp of a plain name below the covers folder, no way up."""
    flat = F.regexp_replace(c, "/+", "/")
    return c.startswith("/") & ~c.contains("..") & flat.rlike(r"^/app/public/covers/(?:[^/]+/)*[a-zA-Z0-9_-]+\.webp$") & (F.length(flat) <= 4096)


def public_path(c: Column) -> Column:
    """A stored path cut to 500 characters if it lies below the public folder, else null."""
    cut = F.substring(c, 1, 500)
    return F.when((cut == "") | (cut.startswith("/app/public/") & ~cut.contains("..")), cut)


def client_address(real_ip: Column, forwarded: Column) -> Column:
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(F.nullif(F.trim(real_ip), F.lit("")), F.nullif(last, F.lit("")))
