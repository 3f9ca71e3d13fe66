"""The value score: five explainable criteria that add up to at most 100.

Every criterion is a struct (score, max_score, reason); the input is flat, one column a field, as
``flatten`` lays it out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import novelty

#: Weights, and the terms that scoring looks for.
WEIGHTS = {"source_reliability": 30, "reproducibility": 25, "relevance": 20, "recency": 15, "novelty": 10}
OFFICIAL = ("academic", "broker", "exchange", "government", "official", "peer reviewed", "peer-reviewed", "regulator", "research institution", "university")
MICROSTRUCTURE = ("imbalance", "l1", "l2", "l3", "liquidity", "market depth", "microstructure", "order book", "order flow", "order-flow", "orderbook", "queue", "spread", "tick")
ULTRA_SHORT = ("millisecond", "milliseconds", "minute", "minutes", "second", "seconds", "sub-second", "subsecond", "tick", "ultra-short", "ultrashort")
SHORT = ("hour", "hours", "intraday", "short horizon", "short-horizon")
FAST = ("1 min", "1m", "millisecond", "minute", "second", "sub-second", "subsecond", "tick")
NOVELTY = {"changed": 8, "duplicate": 0, "new": 10, "new_evidence": 8, "unknown": 5, "variant": 6}
AGES = ((1, 10), (7, 8), (14, 6), (30, 4), (90, 2))

#: The columns that scoring reads, with the names each may come under, first name first.
FIELDS = {
    "source_type": ("source_type", "source_kind", "source_category", "publisher_type", "type", "name"),
    "official": ("official", "is_official"),
    "source_confidence": ("source_confidence", "source_reliability"),
    "author": ("author_or_org", "author", "publisher", "organization", "institution"),
    "published": ("published_at", "publication_date", "issued_at", "created_at"),
    "license": ("license", "licence"),
    "trace": ("canonical_url", "source_url", "original_url", "document_version_id", "source_version_ref", "source_id"),
    "frequency": ("required_frequency", "data_frequency", "sampling_frequency", "timeframe"),
    "market": ("market_types", "asset_classes", "market_scope", "venue"),
    "horizon": ("holding_horizon", "time_horizon", "holding_period"),
    "range": ("time_range", "data_window", "observation_window", "sample_period"),
    "micro": ("microstructure_level", "market_types", "tags", "strategy_families"),
    "required_data": ("required_data",),
    "relevance_status": ("relevance_status",),
    "last_briefing": ("last_successful_briefing_at", "last_successful_briefing", "last_briefing_at"),
}
TIMES = ("updated_at", "last_updated_at", "modified_at", "published_at", "publication_date", "issued_at", "retrieved_at")


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.array_join(F.col(name).cast("array<string>"), " ") if kind == "array" else F.col(name).cast("string")


def flatten(df: DataFrame, names: Sequence[str]) -> Column:
    """The first present value, as text, of the columns that ``df`` has of ``names``."""
    found = [F.when(text.present(_text(df, n)), _text(df, n)) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def status_quality(df: DataFrame, field: str) -> Column:
    """0 absent or conflicting, 1 unknown or inferred, 2 given."""
    parts = [F.col(f"{field}_status")] if f"{field}_status" in df.columns else []
    if "field_status" in df.columns:
        parts.append(F.col("field_status")[field])
    status = F.lower(F.trim(F.coalesce(*parts, F.lit("explicit"))))
    value = text.present(_text(df, field)) if field in df.columns else F.lit(False)
    return F.when(~value | (status == "conflicting"), 0).when(status.isin("unknown", "inferred", "not_applicable", ""), 1).otherwise(2)


def _criterion(most: int, points: Sequence[tuple[Column, Column]]) -> Column:
    """struct(score, max_score, reason) of points and what each is given for."""
    total = sum((p for p, _ in points), F.lit(0))
    reason = F.concat_ws("; ", *[F.concat(why, F.lit(" "), p.cast("string")) for p, why in points])
    return F.struct(text.clamp_score(total.cast("double"), most).alias("score"), F.lit(most).alias("max_score"), reason.alias("reason"))


def _if(c: Column, points: int) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)


def reliability(df: DataFrame) -> Column:
    """Up to 30: official or confident source 10, author 5, date 4, licence 3, trace 8."""
    kind, confidence = flatten(df, FIELDS["source_type"]), text.number(flatten(df, FIELDS["source_confidence"]))
    official = F.lower(F.trim(flatten(df, FIELDS["official"]))).isin("true", "yes", "1") | text.contains_any(kind, OFFICIAL)
    first = F.when(confidence.between(0, 1), text.clamp_score(confidence * 10, 10)).when(F.coalesce(official, F.lit(False)), 10).when(kind.isNotNull(), 6).otherwise(0)
    return _criterion(30, [(first, F.lit("source")), (_if(flatten(df, FIELDS["author"]).isNotNull(), 5), F.lit("author")), (_if(text.parse_time(flatten(df, FIELDS["published"])).isNotNull(), 4), F.lit("date")), (_if(flatten(df, FIELDS["license"]).isNotNull(), 3), F.lit("licence")), (_if(flatten(df, FIELDS["trace"]).isNotNull(), 8), F.lit("trace"))])


def reproducibility(df: DataFrame) -> Column:
    """Up to 25: the quality of core fields, and frequency, market, horizon and range being given."""
    quality = {f: status_quality(df, f) for f in text.CORE_FIELDS}
    points = []
    for field, most in (("core_hypothesis", 2), ("signal_inputs", 2), ("entry_logic", 3), ("exit_logic", 3), ("required_data", 4)):
        points.append((F.when(quality[field] == 2, most).when(quality[field] == 1, max(1, most // 2)).otherwise(0), F.lit(field)))
    points += [(_if(flatten(df, FIELDS[k]).isNotNull(), n), F.lit(k)) for k, n in (("frequency", 2), ("market", 2), ("horizon", 2), ("range", 1))]
    least, most = F.least(*quality.values()), F.greatest(*quality.values())
    points.append((F.when(least == 2, 4).when(most > 0, 2).otherwise(0), F.lit("completeness")))
    return _criterion(25, points)


def relevance(df: DataFrame) -> Column:
    """Up to 20: horizon 6, data 5, microstructure 4, entry and exit 3, relevance 2."""
    horizon = flatten(df, FIELDS["horizon"])
    entry, leave = status_quality(df, "entry_logic"), status_quality(df, "exit_logic")
    status = F.lower(F.coalesce(flatten(df, FIELDS["relevance_status"]), F.lit("")))
    return _criterion(
        20,
        [
            (F.when(text.contains_any(horizon, ULTRA_SHORT), 6).when(text.contains_any(horizon, SHORT), 3).otherwise(0), F.lit("horizon")),
            (_if(flatten(df, FIELDS["required_data"]).isNotNull(), 3) + _if(text.contains_any(flatten(df, FIELDS["frequency"]), FAST), 2), F.lit("data")),
            (_if(text.contains_any(flatten(df, FIELDS["micro"]), MICROSTRUCTURE), 4), F.lit("microstructure")),
            (entry + _if(leave == 2, 1), F.lit("logic")),
            (F.when(status == "relevant", 2).when(status == "background_only", 1).otherwise(0), F.lit("relevance")),
        ],
    )


def age_points(days: Column) -> Column:
    """Points of an age in days: the younger the more."""
    out = F.when(days <= AGES[0][0], AGES[0][1])
    for bound, points in AGES[1:]:
        out = out.when(days <= bound, points)
    return out.otherwise(0)


def recency(df: DataFrame, as_of: Column) -> Column:
    """Up to 15: the age of the latest time 10, newer than the last report 5; nothing without a time."""
    times = [text.parse_time(_text(df, n)) for n in TIMES if n in df.columns]
    latest = F.greatest(*times) if len(times) > 1 else (times[0] if times else F.lit(None).cast("timestamp"))
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(latest)) / 86_400_000_000)
    last = text.parse_time(flatten(df, FIELDS["last_briefing"]))
    return _criterion(15, [(F.when(latest.isNull(), 0).otherwise(age_points(days)), F.lit("age")), (_if(latest > last, 5), F.lit("newer"))])


def novelty_points(status: Column) -> Column:
    """Points of a novelty status; anything else is neutral."""
    table = F.create_map(*[F.lit(x) for pair in NOVELTY.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.trim(status))), F.lit(NOVELTY["unknown"]))


def _closest(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with best, the least struct(order, b) over the other ids of ``b``; null if none shares a token.

    Sets of tokens meet once for all ids that have them.  Tokens are put in order, rarest first.  What
    shares a set's rarest token gives a least similarity; after that only pairs meet that can still
    reach it: by their places, the rest of both sets holds enough tokens.
    """
    kind = [*keys, "tokens"]
    lowest = b.where("candidate_id IS NOT NULL").select(*kind, "candidate_id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*kind).orderBy("candidate_id"))).where("_n <= 2")
    there = lowest.groupBy(*kind).agg(F.min("candidate_id").alias("first"), F.when(F.count("*") > 1, F.max("candidate_id")).alias("second"))
    # an id changes what its row finds only if it would be found itself
    found = there.select(F.col("first").alias("skip")).distinct()
    rows = a.join(found, F.col("candidate_id") == F.col("skip"), "left")
    asked = rows.where("candidate_id IS NOT NULL").select(*kind, "skip").distinct()
    common = there.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("df"))

    def ordered(sets: DataFrame) -> DataFrame:
        each = sets.withColumn("token", F.explode("tokens")).join(common, [*keys, "token"])
        out = each.groupBy(*sets.columns).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
        return out.withColumn("ts", F.transform("ts", lambda t: t["token"]))

    right = ordered(there).select(*keys, "first", "second", F.col("ts").alias("us"), F.posexplode("ts").alias("at_b", "token"))
    n, m, na, nb = F.size("ts"), F.size("us"), F.size("tokens"), F.size("us")
    other = F.when(F.col("skip").isNull() | (F.col("skip") != F.col("first")), F.col("first")).otherwise(F.col("second"))

    def similarities(met: DataFrame) -> DataFrame:
        # as the element of an array, or filters on it would be moved before it and evaluate it again
        both = met.withColumn("_s", F.size(F.array_intersect("ts", "us"))).withColumn("both", F.explode(F.array("_s")))
        return both.withColumn("b", other).withColumn("similarity", F.when(F.col("b").isNull(), 0.0).otherwise(F.col("both") / (na + nb - F.col("both"))))

    left = ordered(asked)
    rarest = novelty.spread(left.withColumn("token", F.get("ts", F.lit(0)))).join(right, [*keys, "token"])
    least = similarities(rarest).groupBy(*kind, "skip", "ts").agg(F.max("similarity").alias("least"))
    places = least.select("*", F.posexplode("ts").alias("at_a", "token")).where((n - F.col("at_a")) / na >= F.col("least"))
    rest = F.least(n - F.col("at_a"), m - F.col("at_b"))
    near = novelty.spread(places).join(right, [*keys, "token"]).where(rest / (na + nb - rest) >= F.col("least"))
    pairs = similarities(near).where((F.col("similarity") >= F.col("least")) & F.col("b").isNotNull())
    best = pairs.groupBy(*kind, "skip").agg(F.min(F.struct((-F.col("similarity")).alias("order"), F.col("b"))).alias("best"))
    best = best.select(*[F.col(k).alias(f"_{k}") for k in (*kind, "skip")], "best")
    same = [F.col(k) == F.col(f"_{k}") for k in kind]
    return rows.join(best, reduce(Column.__and__, same, F.col("candidate_id").isNotNull() & F.col("skip").eqNullSafe(F.col("_skip"))), "left").select(*a.columns, "best")


def token_novelty(candidates: DataFrame, existing: DataFrame, fields: Sequence[str], block: Sequence[str] | None = None) -> DataFrame:
    """(candidate_id, best_id, similarity, status, points): each candidate against all others.

    An equal name is a duplicate; else the best Jaccard similarity of all tokens decides.  Only pairs
    that share a token can be similar, and only those meet that may be the best.  ``block`` names
    further columns that both sides must share.
    """
    keys = list(block or ())

    def tokens(df: DataFrame) -> DataFrame:
        joined = F.concat_ws(" ", *[_text(df, f) for f in fields if f in df.columns])
        return df.select("candidate_id", *keys, text.score_name("canonical_name").alias("name"), F.sort_array(text.score_tokens(joined)).alias("tokens"))

    a, b = tokens(candidates), tokens(existing)
    names = b.where("name <> ''").groupBy(*keys, "name").agg(F.min("candidate_id").alias("same_1"), F.max("candidate_id").alias("same_2"))
    out = _closest(a, b, keys).join(names, [*keys, "name"], "left")
    twin = F.when(F.col("same_1") != F.col("candidate_id"), F.col("same_1")).when(F.col("same_2") != F.col("candidate_id"), F.col("same_2"))
    similarity = F.coalesce(-F.col("best.order"), F.lit(0.0))
    status = F.when(twin.isNotNull(), "duplicate").when(similarity >= 0.35, "variant").otherwise("new")
    points = F.when(twin.isNotNull(), 0).when(similarity >= 0.65, 3).when(similarity >= 0.35, 6).otherwise(10)
    return out.select("candidate_id", F.coalesce(twin, F.col("best.b")).alias("best_id"), F.round(similarity, 6).alias("similarity"), status.alias("status"), points.alias("points"))


def score(df: DataFrame, as_of: Column) -> DataFrame:
    """``df`` with value_score and score_breakdown, a map of criteria."""
    status = F.col("novelty_status") if "novelty_status" in df.columns else F.lit(None).cast("string")
    parts = {"source_reliability": reliability(df), "reproducibility": reproducibility(df), "relevance": relevance(df), "recency": recency(df, as_of), "novelty": _criterion(10, [(novelty_points(status), F.lit("novelty"))])}
    out = df.withColumn("score_breakdown", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]))
    return out.withColumn("value_score", sum((F.col("score_breakdown")[k]["score"] for k in WEIGHTS), F.lit(0)))


def best_of(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group, ranked from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
