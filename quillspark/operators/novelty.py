"""Novelty: how a candidate relates to those that exist.

Names, profiles (families, assets, horizon) and the six core fields are compared.  Related candidates
share a name, or a family, an asset and a unit of the horizon, so pairs are made on these; no other pair
is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text

#: The unit that a horizon word names, in rising order, and the least similarity of a variant.
HORIZON = {"hour": 3, "hours": 3, "hr": 3, "hrs": 3, "day": 4, "days": 4, "millis": 0, "millisecond": 0, "milliseconds": 0, "min": 2, "mins": 2, "minute": 2, "minutes": 2, "month": 6, "months": 6, "ms": 0, "sec": 1, "second": 1, "seconds": 1, "secs": 1, "subsecond": 0, "week": 5, "weeks": 5}
RELATED = 0.35
#: Ids of equal rows that stand in one row at most while pairs are made.
PART = 512
#: Strongest first.
RELATIONS = ("duplicate", "new_evidence", "changed", "variant")


def horizon_units(folded: Column) -> Column:
    """The ranks of the units that folded text names."""
    words = F.regexp_extract_all(folded, F.lit("(?<![a-z])(" + "|".join(sorted(HORIZON, key=len, reverse=True)) + ")(?![a-z])"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in HORIZON.items() for x in pair])
    return F.transform(words, lambda w: F.element_at(table, w))


def prepare(df: DataFrame, fold=text.fold_unicode) -> DataFrame:
    """The folded columns that comparison reads, once a row."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def flat(c: str) -> Column:
        return F.array_join(F.col(c).cast("array<string>"), " ") if kinds[c] == "array" else F.col(c).cast("string")

    def many(c: str) -> Column:
        # a pandas UDF cannot run inside a transform, so values are folded as one text, a line each
        values = F.col(c).cast("array<string>") if kinds[c] == "array" else F.array(F.col(c).cast("string"))
        folded = F.split(lines(F.array_join(F.transform(values, lambda v: F.regexp_replace(v, "\n", " ")), "\n")), "\n")
        return F.array_sort(F.array_distinct(F.filter(folded, lambda v: v != "")))

    lines = text.fold_lines_unicode if fold is text.fold_unicode else text.fold_lines_ascii
    horizon = fold(flat("holding_horizon"))
    cols = [F.col("candidate_id"), F.col("document_version_ids").cast("array<string>").alias("versions") if "document_version_ids" in kinds else F.array().cast("array<string>").alias("versions")]
    cols += [fold(flat("canonical_name")).alias("name"), many("strategy_families").alias("families"), many("asset_classes").alias("assets"), horizon.alias("horizon"), horizon_units(horizon).alias("units")]
    cols += [text.words_of(fold(flat(f))).alias(f) if f in kinds else F.array().cast("array<string>").alias(f) for f in text.CORE_FIELDS]
    return df.select(*cols)


def core_similarity(a: str, b: str) -> Column:
    """The mean Jaccard similarity of the six core fields; two empty fields are equal."""

    def one(f: str) -> Column:
        # the common words stand where Spark evaluates them once
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        both = F.size(F.array_intersect(x, y))
        return F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(1.0))

    each = [one(f) for f in text.CORE_FIELDS]
    return F.round(sum(each[1:], each[0]) / len(each), 6)


def _ranges(a: str, b: str) -> tuple[Column, Column]:
    """(same horizon, horizons overlap)."""
    ua, ub = F.col(f"{a}.units"), F.col(f"{b}.units")
    both = (F.size(ua) > 0) & (F.size(ub) > 0)
    equal = F.col(f"{a}.horizon") == F.col(f"{b}.horizon")
    same = F.when(both, (F.array_min(ua) == F.array_min(ub)) & (F.array_max(ua) == F.array_max(ub))).otherwise(equal)
    overlap = F.when(both, F.greatest(F.array_min(ua), F.array_min(ub)) <= F.least(F.array_max(ua), F.array_max(ub))).otherwise(equal & (F.col(f"{a}.horizon") != ""))
    return same, overlap


def _gathered(df: DataFrame, by: str, ids: str) -> DataFrame:
    """(by, ids, keys): rows that comparison cannot tell apart, once each, with all their ids."""
    columns = [c for c in df.columns if c != "candidate_id"]
    rows = df.where("candidate_id IS NOT NULL").groupBy(*columns).agg(F.collect_list("candidate_id").alias(ids))
    return rows.select(F.struct(*columns).alias(by), ids, _keys().alias(f"{by}_keys"))


def _parts(df: DataFrame, ids: str) -> DataFrame:
    """A row for each PART of its ids, so that no row or pair of rows stands for more than that."""
    slices = F.transform(F.sequence(F.lit(1), F.size(ids), F.lit(PART)), lambda i: F.slice(ids, i, PART))
    return df.withColumn(ids, F.explode(slices))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all tasks: few bytes are much work here, which is no size that Spark would go by."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` and ``right`` side by side where x and y share a key, once a pair, by the first of their keys."""
    met = spread(left.withColumn("key", F.explode("x_keys"))).join(right.withColumn("key", F.explode("y_keys")), "key")
    return met.where(F.col("key") == F.get(F.array_intersect("x_keys", "y_keys"), F.lit(0))).drop("key", "x_keys", "y_keys")


def _related(pairs: DataFrame) -> DataFrame:
    """Pairs x, y with their similarity and relation, where there is one; ``equal`` is a duplicate of its own id, new evidence of others."""
    # as the element of an array, or the filter on relations would be moved before it and evaluate it again
    row = pairs.withColumn("_s", core_similarity("x", "y")).withColumn("similarity", F.explode(F.array("_s"))).drop("_s")
    same_horizon, overlap = _ranges("x", "y")
    name = (F.col("x.name") != "") & (F.col("x.name") == F.col("y.name"))
    profile = (F.col("x.families") == F.col("y.families")) & (F.col("x.assets") == F.col("y.assets")) & same_horizon
    related = F.arrays_overlap("x.families", "y.families") & F.arrays_overlap("x.assets", "y.assets") & overlap
    exact = F.when((F.size("x.versions") > 0) & (F.size("y.versions") > 0), F.when(F.arrays_overlap("x.versions", "y.versions"), "duplicate").otherwise("new_evidence")).otherwise("equal")
    relation = F.when(name & profile & (F.col("similarity") == 1.0), exact).when(name & profile, "changed").when((F.col("similarity") >= RELATED) & (related | name), "variant")
    return row.withColumn("relation", relation).drop("x", "y").where("relation IS NOT NULL")


def relations(candidates: DataFrame, existing: DataFrame, fold=text.fold_unicode) -> DataFrame:
    """(a, b, similarity, relation) of related pairs; ``existing`` is taken as given, self included.

    Rows are compared once for all ids that have them; the ids are paired at the very end, within a
    task, so what is dealt out grows with rows and pairs of different rows only.
    """
    left, right = _gathered(prepare(candidates, fold), "x", "a"), _gathered(prepare(existing, fold), "y", "b")
    found = _related(_meet(_parts(left, "a"), _parts(right, "b")))
    pairs = spread(found).withColumn("a", F.explode("a")).withColumn("b", F.explode("b"))
    own = F.when(F.col("a") == F.col("b"), "duplicate").otherwise("new_evidence")
    return pairs.select("a", "b", "similarity", F.when(F.col("relation") == "equal", own).otherwise(F.col("relation")).alias("relation"))


def _keys() -> Column:
    """What related candidates share at least one of; horizons overlap if their ranges of units do, or are equal texts."""
    names = F.when(F.col("name") != "", F.array(F.concat(F.lit("n:"), F.col("name")))).otherwise(F.array().cast("array<string>"))
    given = F.when(F.col("horizon") != "", F.array(F.concat(F.lit("t:"), F.col("horizon")))).otherwise(F.array().cast("array<string>"))
    ranks = F.when(F.size("units") > 0, F.transform(F.sequence(F.array_min("units"), F.array_max("units")), lambda u: F.concat(F.lit("u:"), u.cast("string"))))
    spans = F.coalesce(F.array_union(ranks, given), given)
    profiles = F.flatten(F.transform("families", lambda f: F.flatten(F.transform("assets", lambda a: F.transform(spans, lambda s: F.concat_ws("|", F.lit("p:"), f, a, s))))))
    return F.array_union(names, profiles)


def classify(candidates: DataFrame, existing: DataFrame, fold=text.fold_unicode, separator: str | None = None) -> DataFrame:
    """(candidate_id, novelty_status, related_ids): the strongest relation and who stands in it.

    A duplicate names those with new evidence too.  Candidates with the same rows have the same related
    ids, which are made once for all of them, and as one text if a ``separator`` is given.
    """
    pa, pb = prepare(candidates, fold), prepare(existing, fold)
    columns = [c for c in pa.columns if c != "candidate_id"]
    rows = pa.groupBy("candidate_id").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("rows"), F.count("*").cast("int").alias("n"))
    own = _related(pa.select("candidate_id", F.struct(*columns).alias("x")).join(pb.select("candidate_id", F.struct(*columns).alias("y")), "candidate_id")).where("relation = 'equal'").select("candidate_id", F.lit(True).alias("own")).distinct()
    classes = rows.join(own, "candidate_id", "left").groupBy("rows", F.coalesce("own", F.lit(False)).alias("own")).agg(F.collect_list(F.struct("candidate_id", "n")).alias("members"))
    left = rows.where("candidate_id IS NOT NULL").select("rows").distinct().select("rows", F.explode("rows").alias("x")).select("rows", "x", "x.*").select("rows", "x", _keys().alias("x_keys"))
    found = _related(_meet(left, _parts(_gathered(pb, "y", "b"), "b")))
    ids = lambda *names: F.flatten(F.collect_list(F.when(F.col("relation").isin(*names), F.col("b"))))
    kinds = found.groupBy("rows").agg(F.max(F.col("relation") == "duplicate").alias("seen"), ids("duplicate", "new_evidence", "equal").alias("exact"), ids("changed").alias("changed"), ids("variant").alias("variant"))
    best = F.when(F.size("exact") > 0, F.col("exact")).when(F.size("changed") > 0, F.col("changed")).otherwise(F.col("variant"))
    status = F.when(F.size("exact") > 0, F.when(F.col("seen"), "duplicate").otherwise("new_evidence")).when(F.size("changed") > 0, "changed").otherwise("variant")
    related = F.sort_array(F.array_distinct(best))
    made = kinds.select("rows", status.alias("status"), (related if separator is None else F.array_join(related.cast("array<string>"), separator)).alias("ids"))
    none = F.lit("") if separator is not None else F.array().cast(f"array<{existing.schema['candidate_id'].dataType.simpleString()}>")
    named = F.col("candidate_id").isNotNull() & F.col("status").isNotNull()
    out = classes.join(made, "rows", "left").select("own", "status", "ids", F.inline("members")).select("candidate_id", F.when(named, F.when(F.col("own"), "duplicate").otherwise(F.col("status"))).otherwise("new").alias("novelty_status"), F.when(named, F.col("ids")).otherwise(none).alias("related_ids"), "n")
    return out.select("candidate_id", "novelty_status", "related_ids", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
