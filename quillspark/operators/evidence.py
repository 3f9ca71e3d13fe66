"""Claims tied to bounded, verbatim evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

MOST_QUOTES = 2
QUOTE_CHARS = 300


def accepted(provenance: DataFrame) -> Column:
    """Whether a provenance row counts: its first boolean marker, else its status, else yes."""
    have = [F.col(c) for c in ("accepted", "source_verified", "verified") if c in provenance.columns]
    status = F.lower(F.trim("status")).isin("accepted", "verified", "valid") if "status" in provenance.columns else F.lit(None).cast("boolean")
    return F.coalesce(*have, status, F.lit(True))


def within_limits(df: DataFrame, by: list[str], quote: str = "quote", order: str = "quote", most: int = MOST_QUOTES, chars: int = QUOTE_CHARS) -> DataFrame:
    """``df`` with ``in_limits``: the quote has 1 to ``chars`` characters and is one of the first ``most``.

    Quotes of other lengths take no place.
    """
    fits = F.length(F.trim(quote)).between(1, chars)
    place = F.row_number().over(Window.partitionBy(*by, F.coalesce(fits, F.lit(False))).orderBy(order))
    return df.withColumn("in_limits", F.coalesce(fits & (place <= most), F.lit(False)))


def match_provenance(requested: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each request (request_id, field_name, quote, document_version_id) with its first provenance row.

    They meet on the field and the trimmed quote; a version must be the same or not given.
    """
    known = provenance.where(accepted(provenance)).select(F.col("field_name"), F.trim("quote").alias("_quote"), F.col("document_version_id").alias("_version"), "provenance_id")
    pairs = requested.withColumn("_quote", F.trim("quote")).join(known, ["field_name", "_quote"], "left")
    fits = F.col("_version").isNull() | F.col("document_version_id").isNull() | (F.col("_version") == F.col("document_version_id"))
    best = pairs.withColumn("provenance_id", F.when(fits, F.col("provenance_id"))).groupBy(*requested.columns).agg(F.min("provenance_id").alias("provenance_id"))
    return best


def link(requested: DataFrame, provenance: DataFrame, versions: DataFrame, most: int = MOST_QUOTES, chars: int = QUOTE_CHARS) -> DataFrame:
    """Requests with evidence_error: no provenance, a quote out of bounds, or not in the version's text.

    versions: document_version_id, body.  Rows without an error are the evidence to store.
    """
    row = match_provenance(requested, provenance).join(versions.select("document_version_id", F.col("body").alias("_body")), "document_version_id", "left")
    row = within_limits(row, ["candidate_id", "field_name"], order="request_id", most=most, chars=chars)
    error = F.when(F.col("_body").isNull(), "unknown_version").when(F.col("provenance_id").isNull(), "no_provenance").when(~F.col("in_limits"), "quote_limits").when(~text.quote_in_source(F.col("quote"), F.col("_body")), "quote_not_in_source")
    return row.withColumn("evidence_error", error).withColumn("evidence_id", F.sha2(F.concat_ws("|", "candidate_id", "field_name", "document_version_id", F.trim("quote")), 256)).drop("_body", "in_limits")


def _confirm(places: DataFrame, probes: DataFrame, docs: DataFrame, quote: str, body: str) -> DataFrame:
    """Pairs that meet on a probe and hold: places are (_text, _probe), texts come back only for places that meet."""
    met = places.join(probes.select("_probe").distinct(), "_probe", "left_semi").join(probes, "_probe").drop("_probe")
    return met.join(docs.withColumn("_text", F.sha2(body, 256)), "_text").where(F.contains(body, quote)).drop("_text")


def contained(quotes: DataFrame, docs: DataFrame, quote: str = "quote", body: str = "text") -> DataFrame:
    """All pairs of quotes and documents that hold them, without comparing each with each.

    A quote and a text meet on the inner word of the quote, one with a space on either side, that the
    fewest texts hold, and each meeting is then confirmed.  Quotes without an inner word meet texts on
    their first characters, 12 or all they have; without such quotes no text is cut at every place.
    Texts go by their hash until they meet a quote, so words travel without them.
    """
    inner = F.filter(F.split(quote, " "), lambda w, i: (w != "") & (i > 0) & (i < F.size(F.split(quote, " ")) - 1))
    key = F.sha2(quote, 256)
    asked = quotes.select(key.alias("_quote"), F.explode(F.array_distinct(inner)).alias("_probe")).distinct()
    texts = docs.select(F.sha2(body, 256).alias("_text"), F.explode(F.array_distinct(F.split(body, " "))).alias("_probe"))
    held = texts.join(asked.select("_probe").distinct(), "_probe", "left_semi")
    seen = held.groupBy("_probe").agg(F.count("*").alias("_n"))
    # a word that no text holds rules its quote out
    rarest = asked.join(seen, "_probe", "left").groupBy("_quote").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_probe").alias("w"))).alias("_best")).where("_best.n > 0").select("_quote", F.col("_best.w").alias("_probe"))
    by_word = _confirm(held.distinct(), quotes.withColumn("_quote", key).join(rarest, "_quote").drop("_quote"), docs, quote, body)
    short = quotes.where((F.size(inner) == 0) & F.col(quote).isNotNull()).withColumn("_probe", F.substring(quote, 1, 12))
    sizes = short.select(F.length("_probe").alias("_size")).distinct()  # at most 13 rows
    starts = F.sequence(F.lit(1), F.greatest(F.length(body) - F.col("_size") + 1, F.lit(1)))
    cut = docs.join(F.broadcast(sizes), F.length(body) >= F.col("_size"))
    places = cut.select(F.sha2(body, 256).alias("_text"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(body), i, F.col("_size"))))).alias("_probe")).distinct()
    return by_word.unionByName(_confirm(places, short, docs, quote, body))


def contained_by_prefix(quotes: DataFrame, docs: DataFrame, quote: str = "quote", body: str = "text", prefix: int = 12) -> DataFrame:
    """``contained`` for quotes of any words: they meet texts on their first ``prefix`` characters.

    A text has such a beginning at every place, so this is for short texts or few quotes; shorter quotes
    are not looked for.
    """
    probes = quotes.where(F.length(quote) >= prefix).withColumn("_probe", F.substring(quote, 1, prefix))
    starts = F.sequence(F.lit(1), F.greatest(F.length(body) - prefix + 1, F.lit(1)))
    places = docs.select(F.sha2(body, 256).alias("_text"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(body), i, F.lit(prefix))))).alias("_probe")).distinct()
    return _confirm(places, probes, docs, quote, body)
