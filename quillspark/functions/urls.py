"""URLs: canonical form, safety, hosts and addresses.

Canonical form needs IDNA and Python's query encoding, so it is a pandas UDF; each distinct value of
a batch is worked out once.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ports that a scheme implies, and names of tracking parameters (besides ``utm_*``).
DEFAULT_PORTS = {"ftp": 21, "http": 80, "https": 443, "ws": 80, "wss": 443}
TRACKING = ("_ga", "_gl", "dclid", "fbclid", "gclid", "igshid", "li_fat_id", "mc_cid", "mc_eid", "msclkid", "s_cid", "ttclid", "twclid", "yclid")
#: Fixed value: signs that a path holds as they are; letters beyond ASCII, blanks and the rest are escaped.
PATH_SIGNS = "/%:@!$&'()*+,;=-._~%"


def fold_percent(text: str) -> str:
    """Escapes of unreserved characters decoded, others in upper case, and stray signs escaped."""

    def one(m: re.Match[str]) -> str:
        if not m[1]:
            return "%25"
        ch = chr(int(m[1], 16))
        return ch if ch.isascii() and (ch.isalnum() or ch in "-._~") else m[0].upper()

    return re.sub("%([0-9A-Fa-f]{2})?", one, text)


def fold_path(path: str) -> str:
    """Dot segments and repeated slashes resolved; a slash at the end stays."""
    kept: list[str] = []
    parts = fold_percent(path).split("/")
    for part in parts:
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    return "/" + "/".join(kept) + ("/" if kept and not parts[-1] else "")


def canonical(url: str | None) -> str | None:
    """The canonical form of one absolute URL, or None if it has no scheme, host or valid port."""
    try:
        at = urlsplit((url or "").strip())
        host, port = at.hostname, at.port
        if not re.fullmatch("[a-z][a-z0-9+.-]*", at.scheme) or not host:
            return None
        host = f"[{host}]" if ":" in host else host.encode("idna").decode("ascii").lower()
    except ValueError:
        return None
    user, mark, _ = at.netloc.rpartition("@")
    place = user + mark + host + ("" if port in (None, DEFAULT_PORTS.get(at.scheme)) else f":{port}")
    pairs = sorted((k, v) for k, v in parse_qsl(at.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in TRACKING))
    return urlunsplit((at.scheme, place, quote(fold_path(at.path), safe=PATH_SIGNS), urlencode(pairs), ""))


@F.pandas_udf(T.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    """Canonical URLs; null where there is none."""
    return urls.map({u: canonical(u) for u in urls.unique()})


def normalize_url_ascii(url: Column) -> Column:
    """The canonical form in SQL, for plain ASCII http(s) URLs without user, escapes or dot segments."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    host = F.regexp_replace(host, F.when(scheme == "https", ":443$").otherwise(":80$"), F.lit(""))
    path = F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)), "/+", "/")
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """Links resolved against their base."""
    return pd.Series([urljoin(b or "", u) if u is not None else b for b, u in zip(base, link, strict=True)])


def safe_link(c: Column) -> Column:
    """Whether a link may be shown: a host, or a scheme of documents, and no script or data."""
    scheme = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]+)", 1)
    return F.coalesce(~scheme.isin("javascript", "data", "") & ((host != "") | scheme.isin("doi", "fixture", "mailto")), F.lit(False))


def forbidden(address: str | None) -> bool:
    """Whether an address is not a public one; what cannot be read is forbidden."""
    try:
        ip = ipaddress.ip_address((address or "").strip("[]").partition("%")[0])
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return not ip.is_global or ip.is_multicast or ip.is_reserved or ip.is_unspecified


@F.pandas_udf(T.BooleanType())
def is_forbidden_ip(addresses: pd.Series) -> pd.Series:
    return addresses.map(forbidden).astype(bool)
