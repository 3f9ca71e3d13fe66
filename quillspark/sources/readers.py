"""Connectors: responses to items.

A response is a row (source_id, base_url, status, body, etag, last_modified); an item is a row of
ITEM.  A 304 gives no items.  Formats are parsed by Spark's own XML and JSON functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import html, text, timing, urls

ITEM = ("source_id", "item_id", "url", "title", "body", "author", "license", "published_at", "updated_at", "source_version_ref", "position")

_RSS = "channel struct<item:array<struct<guid:string,link:string,title:string,description:string,author:string,pubDate:string>>>"
_LINK = "struct<_href:string,_rel:string,_VALUE:string>"
_ATOM = f"entry array<struct<id:string,title:string,summary:string,content:string,link:array<{_LINK}>,author:array<struct<name:string>>,published:string,updated:string,rights:string>>"


def responses(spark: SparkSession, path: str, source_id: str, base_url: str) -> DataFrame:
    """Files of a folder as responses of one source, for recorded or landed bodies."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.lit(source_id).alias("source_id"), F.lit(base_url).alias("base_url"), F.lit(200).alias("status"), F.col("content").cast("string").alias("body"), F.lit(None).cast("string").alias("etag"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_modified"))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _version(df: DataFrame) -> Column:
    return F.coalesce(F.col("etag"), F.col("last_modified"))


def _items(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"published_at": "timestamp", "updated_at": "timestamp", "position": "int"}
    return df.select(*[columns.get(k, F.lit(None)).cast(kinds.get(k, "string")).alias(k) for k in ITEM])


def rss_items(df: DataFrame) -> DataFrame:
    parsed = df.where("status <> 304").withColumn("_x", F.from_xml("body", _RSS, {"mode": "PERMISSIVE"}))
    rows = parsed.select("*", F.posexplode("_x.channel.item").alias("position", "i"))
    link = _filled(F.col("i.link"))
    identity = F.coalesce(_filled(F.col("i.guid")), link, _filled(F.col("i.title")))
    return _items(rows, source_id=F.col("source_id"), item_id=identity, url=urls.join_url("base_url", F.coalesce(link, identity)), title=_filled(F.col("i.title")), body=_filled(F.col("i.description")), author=_filled(F.col("i.author")), published_at=text.parse_time("i.pubDate"), source_version_ref=_version(rows), position=F.col("position"))


def atom_items(df: DataFrame) -> DataFrame:
    parsed = df.where("status <> 304").withColumn("_x", F.from_xml("body", _ATOM, {"mode": "PERMISSIVE"}))
    rows = parsed.select("*", F.posexplode("_x.entry").alias("position", "i"))
    links = F.filter(F.col("i.link"), lambda x: F.coalesce(x["_rel"], F.lit("")).isin("alternate", ""))
    link = _filled(F.coalesce(F.get(links, F.lit(0))["_href"], F.get(links, F.lit(0))["_VALUE"]))
    identity = F.coalesce(_filled(F.col("i.id")), link, _filled(F.col("i.title")))
    return _items(rows, source_id=F.col("source_id"), item_id=identity, url=urls.join_url("base_url", F.coalesce(link, identity)), title=_filled(F.col("i.title")), body=F.coalesce(_filled(F.col("i.summary")), _filled(F.col("i.content"))), author=_filled(F.get(F.col("i.author"), F.lit(0))["name"]), license=_filled(F.col("i.rights")), published_at=text.parse_time("i.published"), updated_at=text.parse_time("i.updated"), source_version_ref=_version(rows), position=F.col("position"))


def feed_items(df: DataFrame, window_start: Column | None = None, window_end: Column | None = None) -> DataFrame:
    """Items of RSS and Atom responses, one for each identity, in the closed window if one is given."""
    is_atom = F.col("body").rlike(r"(?s)^\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*)*<(?:\w+:)?feed[\s>]")
    items = deduplicate(rss_items(df.where(~is_atom)).unionByName(atom_items(df.where(is_atom))))
    return items if window_start is None else items.where(timing.in_closed(F.coalesce("updated_at", "published_at"), window_start, window_end))


def deduplicate(items: DataFrame, keys: tuple[str, ...] = ("source_id", "item_id"), time: Column | None = None, position: str = "position") -> DataFrame:
    """Of rows with one identity the latest; of equal times, or without one, the earliest row.

    ``position`` of a kept row is that of the first row of its identity, so the order of first sight
    can be had again.
    """
    at = F.coalesce("updated_at", "published_at") if time is None else time
    every = Window.partitionBy(*keys)
    ranked = items.withColumn("_rank", F.row_number().over(every.orderBy(at.desc_nulls_last(), F.col(position))))
    ranked = ranked.withColumn("_first", F.min(position).over(every)).where("_rank = 1")
    return ranked.withColumn(position, F.col("_first")).drop("_rank", "_first")


_RECORD = "struct<DOI:string,URL:string,title:string,author:string,abstract:string,license:string,issued:struct<`date-parts`:array<array<int>>>,published:struct<`date-parts`:array<array<int>>>,updated:string>"


def metadata_records(body: Column) -> Column:
    """The records of a payload: message.items, message, a list, or the payload itself."""
    records = lambda path: F.from_json(F.get_json_object(body, path), f"array<{_RECORD}>")
    one = lambda path: F.array(F.from_json(F.get_json_object(body, path), _RECORD))
    is_list = F.trim(body).startswith("[")
    return F.when(is_list, F.from_json(body, f"array<{_RECORD}>")).when(F.get_json_object(body, "$.message.items").isNotNull(), records("$.message.items")).when(F.get_json_object(body, "$.message").isNotNull(), one("$.message")).when(F.get_json_object(body, "$.items").isNotNull(), records("$.items")).otherwise(F.array(F.from_json(body, _RECORD)))


def _first_text(c: Column) -> Column:
    """Text, or the first element of a JSON list of texts."""
    return F.coalesce(F.get_json_object(c, "$[0]"), c)


def json_items(df: DataFrame, window_start: Column | None = None, window_end: Column | None = None) -> DataFrame:
    """Items of bibliographic JSON; the window filters only if it is given."""
    rows = df.where("status <> 304").select("*", F.posexplode(metadata_records(F.col("body"))).alias("position", "i")).where("i IS NOT NULL")
    parts = F.coalesce(F.get(F.col("i.published.date-parts"), F.lit(0)), F.get(F.col("i.issued.date-parts"), F.lit(0)))
    author = F.coalesce(F.nullif(F.concat_ws(" ", F.get_json_object("i.author", "$[0].given"), F.get_json_object("i.author", "$[0].family")), F.lit("")), F.get_json_object("i.author", "$[0].name"), F.col("i.author"))
    title = _first_text(F.col("i.title"))
    licence = F.coalesce(F.get_json_object("i.license", "$[0].URL"), F.col("i.license"))
    identity = F.coalesce(_filled(F.col("i.DOI")), _filled(F.col("i.URL")), _filled(title))
    url = F.coalesce(_filled(F.col("i.URL")), F.concat(F.lit("https://doi.org/"), _filled(F.col("i.DOI"))))
    items = _items(rows, source_id=F.col("source_id"), item_id=identity, url=url, title=_filled(title), body=_filled(F.col("i.abstract")), author=author, license=licence, published_at=text.date_parts(parts), updated_at=text.parse_time("i.updated"), source_version_ref=_version(rows), position=F.col("position"))
    items = deduplicate(items)
    return items if window_start is None else items.where(timing.in_closed(F.coalesce("updated_at", "published_at"), window_start, window_end))


_RELEASES = "array<struct<id:long,tag_name:string,name:string,html_url:string,body:string,target_commitish:string,published_at:string,created_at:string>>"
_README = "struct<sha:string,html_url:string,content:string,encoding:string>"


def release_items(df: DataFrame) -> DataFrame:
    """Items of release lists and README files.

    The latest release with a commit is the one whose time is largest as text, and its commit is the
    version of every item of the source.
    """
    df = df.where("status <> 304")
    listed = df.where(F.trim("body").startswith("[")).withColumn("_r", F.from_json("body", _RELEASES))
    rows = listed.select("source_id", "base_url", F.posexplode("_r").alias("position", "i"))
    stamp = F.coalesce(_filled(F.col("i.published_at")), _filled(F.col("i.created_at")))
    latest = rows.where(_filled(F.col("i.target_commitish")).isNotNull()).groupBy("source_id").agg(F.max_by("i.target_commitish", stamp).alias("_commit"))
    released = _items(rows, source_id=F.col("source_id"), item_id=F.concat(F.lit("release:"), F.coalesce(F.col("i.id").cast("string"), F.col("i.tag_name"), F.col("i.html_url"))), url=F.col("i.html_url"), title=F.coalesce(_filled(F.col("i.name")), F.col("i.tag_name")), body=F.col("i.body"), published_at=text.parse_time(stamp), position=F.col("position"))
    read = df.where(~F.trim("body").startswith("[")).withColumn("i", F.from_json("body", _README))
    content = F.when(F.col("i.encoding") == "base64", F.unbase64(F.regexp_replace("i.content", r"\s", "")).cast("string")).otherwise(F.col("i.content"))
    readme = _items(read, source_id=F.col("source_id"), item_id=F.lit("readme"), url=F.col("i.html_url"), title=F.lit("README"), body=content, position=F.lit(1 << 30))
    items = released.unionByName(readme).join(latest, "source_id", "left")
    return items.withColumn("source_version_ref", F.col("_commit")).select(*ITEM)


def html_items(df: DataFrame) -> DataFrame:
    """A page as one item, its body made inert before anything else sees it."""
    rows = df.where("status <> 304")
    return _items(rows, source_id=F.col("source_id"), item_id=F.col("base_url"), url=F.col("base_url"), title=html.html_title("body"), body=html.sanitize_html("body"), source_version_ref=F.coalesce(_version(rows), text.sha256_tagged("body")), position=F.lit(0))
