"""Gates in front of publication: items, sensitive names, and whole reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text, urls
from quillspark.operators import lint
from quillspark.operators.evidence import MOST_QUOTES, QUOTE_CHARS

#: Folded names of columns that hold full texts, and parts of names that hold secrets.
FULL_TEXT = frozenset("body bodytext content documentbody documentcontent documenttext fullbody fulltext html htmlbody normalizedbody normalizedhtml normalizedtext originalbody originaldocument originaldocumentbody originalfulltext originaltext rawbody rawhtml rawtext sourcebody sourcetext".split())
SENSITIVE = ("apikey", "credential", "password", "secret", "token")


def _names(kind: T.DataType) -> list[str]:
    if isinstance(kind, T.StructType):
        return [n for f in kind.fields for n in (f.name, *_names(f.dataType))]
    if isinstance(kind, T.ArrayType):
        return _names(kind.elementType)
    return _names(kind.valueType) if isinstance(kind, T.MapType) else []


def folded_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def forbidden_columns(df: DataFrame) -> list[str]:
    """Columns, nested ones too, whose names say that they hold full texts or secrets."""
    return [n for n in _names(df.schema) if folded_name(n) in FULL_TEXT or any(s in folded_name(n) for s in SENSITIVE)]


def forbidden_keys(m: Column) -> Column:
    """The keys of a map that name full texts or secrets."""
    fold = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    return F.filter(F.map_keys(m), lambda k: fold(k).isin(*sorted(FULL_TEXT)) | fold(k).rlike("|".join(SENSITIVE)))


def asserts_nothing(claim: Column, status: Column) -> Column:
    """An item with an empty claim whose status says so needs no evidence; a missing claim is not empty."""
    return F.coalesce(claim.isNotNull() & (F.trim(claim) == "") & status.isin("unknown", "not_applicable"), F.lit(False))


def item_violations(df: DataFrame, most: int = MOST_QUOTES, chars: int = QUOTE_CHARS, rendered: Sequence[str] = ("claim",)) -> DataFrame:
    """``df`` (claim, status, quotes, version_ids, source_link) with the names of broken rules, in order."""
    needs = ~asserts_nothing(F.col("claim"), F.col("status"))
    quotes = F.coalesce("quotes", F.array().cast("array<string>"))
    versions = F.coalesce("version_ids", F.array().cast("array<string>"))
    rules = [
        F.when(needs & (F.size(quotes) == 0), "missing_evidence"),
        F.when(F.size(quotes) > most, "too_many_quotes"),
        F.when(F.exists(quotes, lambda q: ~F.coalesce(F.length(F.trim(q)).between(1, chars), F.lit(False))), "quote_length"),
        F.when(needs & (F.size(F.filter(versions, text.present)) < F.size(quotes)), "missing_version"),
        F.when(needs & ~urls.safe_link(F.col("source_link")), "unsafe_source_link"),
        F.when(~lint.is_clean(F.concat_ws("\n", *rendered, quotes)), "banned_phrase"),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*rules)))


def publishable(items: DataFrame, by: Sequence[str] = ("briefing_id",)) -> DataFrame:
    """A row for each report: whether all of its items pass, and how many do not."""
    judged = items.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(F.size("violations") > 0).alias("blocked"))
    return judged.withColumn("publishable", F.col("blocked") == 0)


def gate_briefings(briefings: DataFrame, items: DataFrame, deliveries: DataFrame) -> DataFrame:
    """``briefings`` with gate_error, the first rule that is broken, or null.

    briefings: briefing_id, window_start, window_end, approval, internal_draft, content_hash,
    resend_reason, resend_approved_by; items: briefing_id, item_id, identity, related, approval,
    source_allowed, metadata (a string map); deliveries: briefing_id, content_hash, status.
    """
    keys = ["briefing_id"]
    twins = items.groupBy("briefing_id", "identity").agg(F.count("*").alias("n"), F.bool_and("related").alias("related")).where("n > 1 AND NOT related AND identity IS NOT NULL").select(*keys).distinct().withColumn("_twins", F.lit(True))
    state = items.groupBy(*keys).agg(F.bool_and(F.coalesce("source_allowed", F.lit(False))).alias("_sources"), F.bool_and(F.col("approval").isin("approved", "published")).alias("_approved"), F.bool_or(F.size(forbidden_keys(F.col("metadata"))) > 0).alias("_sensitive"))
    sent = deliveries.where("status = 'sent'").select("briefing_id", "content_hash").distinct().withColumn("_sent", F.lit(True))
    row = briefings.join(state, keys, "left").join(twins, keys, "left").join(sent, ["briefing_id", "content_hash"], "left")
    fine = F.col("approval").isin("approved", "published") & F.coalesce("_approved", F.lit(True)) | F.coalesce("internal_draft", F.lit(False))
    resend = text.present("resend_reason") & text.present("resend_approved_by")
    rules = [
        F.when(~F.coalesce("_sources", F.lit(True)), "source_not_allowed"),
        F.when(F.col("window_start").isNull() | F.col("window_end").isNull() | (F.col("window_start") > F.col("window_end")), "invalid_data_window"),
        F.when(F.coalesce("_sensitive", F.lit(False)), "sensitive_information"),
        F.when(F.coalesce("_twins", F.lit(False)), "unrelated_duplicates"),
        F.when(~F.coalesce(fine, F.lit(False)), "not_approved"),
        F.when(F.coalesce("_sent", F.lit(False)) & ~resend, "already_delivered"),
    ]
    return row.withColumn("gate_error", F.coalesce(*rules)).select(*briefings.columns, "gate_error")


def check_map(values: Mapping[str, str]) -> list[str]:
    """Forbidden keys of one plain mapping."""
    return [k for k in values if folded_name(k) in FULL_TEXT or any(s in folded_name(k) for s in SENSITIVE)]
