"""Small shapers of records that the larger operators lean on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text, urls

LABELS = ("relevant", "irrelevant", "background_only")


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first non-blank value, as text, of the columns that ``df`` has."""
    have = [F.when(text.present(n), F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def document_target(df: DataFrame) -> Column:
    """The URL to judge: that of the request, else the item's unless recorded, else the source's."""
    item = first_filled(df, "url")
    return F.coalesce(first_filled(df, "request_url", "fetch_url"), F.when(~item.startswith("fixture:"), item), first_filled(df, "base_url"))


def robots_target(url: Column) -> Column:
    """The rule file of a URL's origin."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/robots.txt"))


def with_robots_text(items: DataFrame, files: DataFrame) -> DataFrame:
    """``items`` with the rule file of their host, null where it could not be had."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return items.withColumn("host", host).join(files.select("host", F.col("body").alias("robots_text")), "host", "left")


def allow_rules(spark: SparkSession, entries: Sequence[str]) -> DataFrame:
    """(host, scheme, port) of allowlist entries: a host, host:port, or the beginning of a URL."""
    rules = []
    for entry in entries:
        scheme, mark, rest = entry.strip().partition("://")
        place = (rest if mark else scheme).partition("/")[0].rpartition("@")[2]
        host, _, port = place.partition(":") if not place.startswith("[") else (place.partition("]")[0] + "]", "", place.partition("]:")[2])
        if host:
            rules.append((host.rstrip(".").encode("idna").decode() if host[0] != "[" else host, scheme.lower() if mark else None, int(port) if port.isdigit() else None))
    return spark.createDataFrame(sorted(set(rules), key=str), "host string, scheme string, port int")


def requests_per_minute(policy: Column) -> Column:
    """The rate of a policy map: given, or derived from an interval or a wait in seconds."""
    n = lambda k: text.number(policy[k])
    rate = F.coalesce(n("requests_per_minute"), F.lit(60.0) / n("interval_seconds"), F.lit(60.0) / n("retry_after_seconds"))
    return F.when(rate > 0, rate)


def cursor_time(cursor: Column) -> Column:
    """The end of the last window that a cursor names."""
    return F.coalesce(*[text.parse_time(cursor[k]) for k in ("window_end", "end", "last_success_at", "updated_at", "value")])


def advance_cursor(runs: DataFrame, occurrences: DataFrame, initial_days: int = 14, max_days: int = 30) -> DataFrame:
    """Windows and next cursors: occurrences (scheduled_for, run_status) after earlier runs.

    runs: window_end, run_status, position.  A window starts where the latest success before it ended;
    the cursor moves to its end only if the run succeeds, so windows of successes tile time.

    The latest success is looked up by day: among those of the same day, else the last of the days before,
    which are one row each.
    """
    good = runs.where("run_status = 'success' AND window_end IS NOT NULL").select(F.col("window_end").alias("_end"), F.to_date("window_end").alias("_day"))
    daily = good.groupBy("_day").agg(F.max("_end").alias("_last"))
    days = daily.unionByName(occurrences.select(F.to_date("scheduled_for").alias("_day"), F.lit(None).cast(good.schema["_end"].dataType).alias("_last"))).where("_day IS NOT NULL").groupBy("_day").agg(F.max("_last").alias("_last"))
    before = days.select("_day", F.max("_last").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    asked = occurrences.withColumn("_day", F.to_date("scheduled_for"))
    same = asked.join(good, "_day").where(F.col("_end") <= F.col("scheduled_for")).groupBy("scheduled_for").agg(F.max("_end").alias("_today"))
    last = asked.distinct().join(before, "_day", "left").join(same, "scheduled_for", "left").withColumn("previous_end", F.coalesce("_today", "_earlier")).drop("_day", "_earlier", "_today")
    asked = F.coalesce("previous_end", F.col("scheduled_for") - F.make_dt_interval(F.lit(initial_days)))
    floor = F.col("scheduled_for") - F.make_dt_interval(F.lit(max_days))
    cut = F.col("previous_end").isNotNull() & (asked < floor)
    out = last.withColumn("requested_start", asked).withColumn("truncated", cut).withColumn("window_start", F.when(cut, floor).otherwise(F.col("requested_start")))
    return out.withColumn("window_end", F.col("scheduled_for")).withColumn("cursor", F.when(F.col("run_status") == "success", F.col("scheduled_for")).otherwise(F.col("previous_end")))


def raw_body(df: DataFrame, bodies: Sequence[str] = ("raw_body", "body", "normalized_body")) -> Column:
    """The raw body, else the raw record, else all other columns as JSON."""
    rest = [c for c in sorted(df.columns) if c not in bodies]
    have = [F.col(c).cast("string") for c in ("raw_body", "raw_record") if c in df.columns]
    return F.coalesce(*have, F.to_json(F.struct(*rest)))


def _over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def merge_maps(*maps: Column) -> Column:
    """One map; of equal keys the last counts."""
    out = maps[0]
    for m in maps[1:]:
        out = _over(out, m)
    return out


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` and the rows of ``new`` whose key it lacks; what is stored wins."""
    first = new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    return stored.unionByName(first.select(*stored.columns))


def upsert_briefings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` reports with those of ``new``: the same id is the next attempt and waits for approval again."""
    again = new.join(stored.select("briefing_id", F.col("run_attempt").alias("_n")), "briefing_id", "left")
    again = again.withColumns({"run_attempt": F.coalesce("_n", F.lit(0)) + 1, "publication_status": F.lit("pending_approval")}).drop("_n")
    return stored.join(new.select("briefing_id"), "briefing_id", "left_anti").unionByName(again.select(*stored.columns))


def model_label(answer: Column) -> Column:
    """One of the three labels from a model's answer, plain or as {"status": ...}; else null."""
    label = F.lower(F.trim(F.coalesce(F.get_json_object(answer, "$.status"), F.get_json_object(answer, "$.label"), answer)))
    return F.when(label.isin(*LABELS), label)


def last_usage(lines: DataFrame, key: str, line_no: str = "line_no", event: str = "event") -> DataFrame:
    """(key, usage) of the last event of each call that reports usage."""
    usage = F.get_json_object(event, "$.usage")
    return lines.where(usage.isNotNull()).groupBy(key).agg(F.max_by(usage, F.col(line_no)).alias("usage"))


def evidence_rows(df: DataFrame, key: str, quotes: str = "quotes") -> DataFrame:
    """(key, field_name, quote) of a map from field to quotes."""
    return df.select(key, F.explode(quotes).alias("field_name", "_q")).select(key, "field_name", F.explode("_q").alias("quote"))


def within_item_limit(existing: Column, new: Column, most: int = 2) -> Column:
    if not 1 <= most <= 2:
        raise ValueError("an item has one or two quotes")
    return existing + new <= most


def identities(df: DataFrame) -> Column:
    """What an item is the same as another by: candidate, strategy and field, else name, else its own id."""
    field = F.coalesce(first_filled(df, "field_name"), F.lit(""))
    strong = F.array_compact(F.array(F.concat_ws("|", F.lit("candidate"), first_filled(df, "candidate_id"), field), F.concat_ws("|", F.lit("strategy"), first_filled(df, "strategy_id"), field)))
    strong = F.filter(strong, lambda x: F.size(F.split(x, r"\|")) == 3)
    weak = F.coalesce(F.concat(F.lit("name|"), F.nullif(text.fold_ascii(first_filled(df, "canonical_name")), F.lit(""))), F.concat(F.lit("item|"), first_filled(df, "item_id")))
    return F.when(F.size(strong) > 0, strong).otherwise(F.array_compact(F.array(weak)))


def source_links(df: DataFrame) -> Column:
    """All links that a record has, safe ones only, first names first."""
    names = ("source_url", "original_link", "original_url", "canonical_url", "document_url")
    have = F.array_compact(F.array(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(None).cast("string")))
    return F.filter(have, urls.safe_link)


def bounded(c: Column, most: int = 200) -> Column:
    """Masked text of at most ``most`` characters, for summaries."""
    return F.substring(text.mask_secrets(c), 1, most)


def observation_window(supplied_start: Column, supplied_end: Column, start: Column, end: Column, scheduled_for: Column) -> Column:
    """struct(start, end): as supplied, else the report's window, else two weeks before the slot."""
    return F.when(supplied_start.isNotNull() & supplied_end.isNotNull(), F.struct(supplied_start.alias("start"), supplied_end.alias("end"))).when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end"))).otherwise(F.struct((scheduled_for - F.make_dt_interval(F.lit(14))).alias("start"), scheduled_for.alias("end")))


def expansion_blockers(metrics: DataFrame, windows: DataFrame, metric_ids: Sequence[str], required: int = 4) -> DataFrame:
    """(window_id, metric_id, reason) of everything that keeps the last windows from passing."""
    last = windows.orderBy(F.desc("end"), F.desc("window_id")).limit(required).select("window_id")
    want = last.withColumn("metric_id", F.explode(text.literals(metric_ids)))
    rows = want.join(metrics.select("window_id", "metric_id", "verdict", "meets_target"), ["window_id", "metric_id"], "left")
    reason = F.when(F.col("verdict").isNull() | (F.col("verdict") == "insufficient_data"), "insufficient_data").when(~F.coalesce("meets_target", F.lit(False)), "breached")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("window_id", "metric_id", "reason")


def delivery_mode(modes: Mapping[str, str]) -> str:
    """``dry_run`` unless a setting names another mode."""
    return next((v for v in modes.values() if v and v != "dry_run"), "dry_run")
