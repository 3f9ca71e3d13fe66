"""Request safety: which URLs, hosts, types and sizes may be read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import urls

#: Media types that may be read, and bounds of a response.
MEDIA_TYPES = ("application/atom+xml", "application/json", "application/rss+xml", "application/xml", "text/html", "text/plain", "text/xml")
MAX_BYTES = 10 * 1024 * 1024
MAX_REDIRECTS = 3


class ResponseTooLarge(ValueError):
    """A body over the bound."""


def url_parts(url: Column) -> Column:
    """struct(scheme, host, port), the port that the scheme implies where none is given."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.rtrim(F.lower(F.regexp_extract(place, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)), F.lit("."))
    port = F.regexp_extract(place, r":(\d+)$", 1).try_cast("int")
    implied = F.element_at(F.create_map(*[F.lit(x) for pair in urls.DEFAULT_PORTS.items() for x in pair]), scheme)
    return F.struct(scheme.alias("scheme"), host.alias("host"), F.coalesce(port, implied).alias("port"), place.contains("@").alias("has_user"))


def check_urls(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``url_error``: why a URL may not be read, or null.

    ``rules`` (host, scheme, port; null matches any) is a small table: every rule of a host is joined on
    the host, so no pair of other hosts is looked at.
    """
    row = df.withColumn("_at", url_parts(F.col(url))).withColumn("_host", F.col("_at.host"))
    allowed = rules.select(F.lower("host").alias("_host"), F.struct("scheme", "port").alias("_rule")).groupBy("_host").agg(F.collect_set("_rule").alias("_rules"))
    row = row.join(allowed, "_host", "left")
    match = F.exists(F.coalesce("_rules", F.array().cast("array<struct<scheme:string,port:int>>")), lambda r: (r["scheme"].isNull() | (r["scheme"] == F.col("_at.scheme"))) & (r["port"].isNull() | (r["port"] == F.col("_at.port"))))
    error = (
        F.when(F.col(url).rlike(r"[\x00-\x20\x7f]") | F.col(url).isNull(), "malformed_url")
        .when(~F.col("_at.scheme").isin("http", "https", "fixture"), "unsupported_scheme")
        .when(F.col("_at.has_user"), "credentials_in_url")
        .when(~match, "host_not_allowed")
    )
    return row.withColumn("url_error", error).drop("_at", "_host", "_rules")


def check_addresses(df: DataFrame, addresses: str = "addresses") -> DataFrame:
    """``df`` with ``address_error`` where no address, or any address, is not public."""
    rows = df.select(F.monotonically_increasing_id().alias("_row"), "*").withColumn("_ip", F.explode_outer(addresses))
    judged = rows.withColumn("_bad", urls.is_forbidden_ip(F.col("_ip")))
    out = judged.groupBy(*[c for c in judged.columns if c not in ("_ip", "_bad")]).agg(F.bool_or("_bad").alias("_bad"))
    return out.withColumn("address_error", F.when(F.coalesce("_bad", F.lit(True)), "forbidden_address")).drop("_row", "_bad")


def allowed_media(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1)))).isin(*MEDIA_TYPES)


def allowed_length(header: Column, most: int = MAX_BYTES) -> Column:
    """A length header that is absent or a number within the bound, which can only be lowered."""
    n = header.try_cast("long")
    return header.isNull() | F.coalesce((n >= 0) & (n <= min(most, MAX_BYTES)), F.lit(False))


def consume_limited(pieces: Iterable[bytes], most: int = MAX_BYTES) -> bytes:
    """The pieces as one body; more than ``most`` bytes raise before they are kept."""
    held, size = [], 0
    for piece in pieces:
        size += len(piece)
        if size > min(most, MAX_BYTES):
            raise ResponseTooLarge(f"more than {min(most, MAX_BYTES)} bytes")
        held.append(piece)
    return b"".join(held)


def redirects(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` (url, location, hops) with ``target`` and ``url_error``: each hop is checked like a first URL."""
    out = check_urls(df.withColumn("target", urls.join_url("url", "location")), rules, "target")
    return out.withColumn("url_error", F.when(F.col("hops") >= MAX_REDIRECTS, "too_many_redirects").otherwise(F.col("url_error")))


def rate_limit_waits(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """``requests`` (source_id, requested_at) with ``allowed_at``, spaced by the source's token bucket.

    Request n of a source may start at the latest, over all k up to n, of requested_at(k) plus the
    intervals between k and n, the burst taken off; that is a running maximum, not a loop.
    """
    order = Window.partitionBy("source_id").orderBy("requested_at").rowsBetween(Window.unboundedPreceding, 0)
    limits = sources.select("source_id", (F.lit(60.0) / F.col("requests_per_minute")).alias("_gap"), F.greatest("burst", F.lit(1)).alias("_burst"))
    rows = requests.join(F.broadcast(limits), "source_id").withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("requested_at")))
    seconds = F.unix_micros("requested_at") / 1e6
    first = F.max(seconds - F.col("_n") * F.col("_gap")).over(order)
    allowed = F.greatest(seconds, first + (F.col("_n") - F.col("_burst") + 1) * F.col("_gap"))
    return rows.withColumn("allowed_at", F.timestamp_micros((allowed * 1e6).cast("long"))).drop("_gap", "_burst", "_n")


def iter_fixture(path: str, size: int = 1 << 16) -> Iterator[bytes]:
    """A file in pieces, for consume_limited."""
    with open(path, "rb") as f:
        while piece := f.read(size):
            yield piece
