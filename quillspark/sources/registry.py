"""The source registry as a small table, and cursors as maps.

Policies are validated on the driver, where they are read; everything after that is columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import readers

SOURCE = "source_id string, name string, type string, base_url string, connector_type string, active boolean, fixture boolean, requests_per_minute double, burst int, retry_after double, robots string, cursor map<string,string>, last_success_at timestamp"

#: Names that a cursor entry goes by.
CURSOR_ALIASES = {"if-none-match": "etag", "etag": "etag", "if-modified-since": "last_modified", "last-modified": "last_modified", "last_modified": "last_modified"}

#: Connector types and their readers; a source's ``type`` never picks one.
CONNECTORS: dict[str, Callable[..., DataFrame]] = {
    "rss": readers.feed_items,
    "atom": readers.feed_items,
    "feed": readers.feed_items,
    "json_meta": readers.json_items,
    "paper_metadata": readers.json_items,
    "github": readers.release_items,
    "html": readers.html_items,
}


class SourcePolicyError(ValueError):
    """A policy that breaks a rule."""


class SourceInactive(ValueError):
    """A source that must not be read."""


@dataclass(frozen=True)
class Settings:
    """Everything that can be set; unknown names are rejected, and live modes need an approval."""

    initial_lookback_days: int = 14
    max_lookback_days: int = 30
    max_collect_retries: int = 3
    candidate_score_threshold: float = 60.0
    extraction_confidence_min: float = 0.7
    briefing_max_items: int = 7
    quote_max_chars: int = 300
    response_max_bytes: int = 10 * 1024 * 1024
    timeout_seconds: float = 20.0
    max_redirects: int = 3
    delivery_dry_run: bool = True
    live_llm: bool = False
    live_http: bool = False
    approvals: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for name, needed in (("live_llm", self.live_llm), ("live_http", self.live_http), ("live_delivery", not self.delivery_dry_run)):
            if needed and name not in self.approvals:
                raise ValueError(f"{name} needs an approval")
        if not 1 <= self.quote_max_chars <= 300:
            raise ValueError("quotes have 1 to 300 characters")

    @classmethod
    def load(cls, values: Mapping[str, object], environ: Mapping[str, str] | None = None, prefix: str = "QUILLSPARK_") -> Settings:
        """Settings from defaults, then ``values``, then the environment; text is read as JSON."""
        known = {f.name: f for f in fields(cls)}
        given = dict(values)
        for name, text in (environ or {}).items():
            if name.startswith(prefix):
                key = name.removeprefix(prefix).lower()
                try:
                    given[key] = json.loads(text)
                except ValueError:
                    given[key] = text
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        out = cls(approvals=tuple(given.pop("approvals", ())))
        for key, value in given.items():
            kind = type(getattr(out, key))
            if kind is bool and not isinstance(value, bool):
                raise ValueError(f"{key} is true or false")
        return replace(out, **{k: type(getattr(out, k))(v) for k, v in given.items()})


def load_policy(path: str) -> dict:
    """A policy file, JSON or YAML, validated."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        policy = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as exc:
            raise SourcePolicyError("a YAML policy needs the yaml package") from exc
        policy = yaml.safe_load(text)
    validate_policy(policy)
    return policy


def validate_policy(policy: Mapping, fixtures: tuple[str, ...] = (), least_real: int = 0) -> None:
    """Raise if a source lacks an id or connector, is listed twice, or a named fixture is not active."""
    sources = policy.get("sources")
    if not isinstance(sources, list) or not sources:
        raise SourcePolicyError("a policy lists sources")
    ids = [s.get("source_id") for s in sources]
    if not all(ids) or len(set(ids)) < len(ids):
        raise SourcePolicyError("every source has an id of its own")
    for s in sources:
        if s.get("connector_type") not in CONNECTORS:
            raise SourcePolicyError(f"{s['source_id']}: no connector {s.get('connector_type')!r}")
        limit = s.get("rate_limit") or {}
        if float(limit.get("requests_per_minute", 60)) <= 0 or int(limit.get("burst", 1)) < 1:
            raise SourcePolicyError(f"{s['source_id']}: rate limits are positive")
    active = {s["source_id"] for s in sources if s.get("active") is True}
    if missing := [x for x in fixtures if x not in active]:
        raise SourcePolicyError(f"fixture sources are not active: {', '.join(missing)}")
    if sum(not s.get("fixture", False) for s in sources) < least_real:
        raise SourcePolicyError(f"fewer than {least_real} real sources")


def source_table(spark: SparkSession, policy: Mapping) -> DataFrame:
    """The registry: a row for each source of a valid policy."""
    validate_policy(policy)
    rows = []
    for s in policy["sources"]:
        limit = s.get("rate_limit") or {}
        rows.append((s["source_id"], s.get("name"), s.get("type"), s.get("base_url"), s["connector_type"], s.get("active") is True, bool(s.get("fixture", False)), float(limit.get("requests_per_minute", 60)), int(limit.get("burst", 1)), limit.get("retry_after_seconds"), (s.get("access_policy") or {}).get("robots"), None, None))
    return spark.createDataFrame(rows, SOURCE)


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where("active")


def inactive_candidates(sources: DataFrame) -> DataFrame:
    """Real sources that are not read yet."""
    return sources.where("NOT active AND NOT fixture")


def read(spark: SparkSession, sources: DataFrame, source_id: str, responses: DataFrame, **options: object) -> DataFrame:
    """The items of one source's responses by its connector; an inactive source raises before any read."""
    row = sources.where(F.col("source_id") == source_id).select("connector_type", "active").first()
    if row is None:
        raise KeyError(source_id)
    if not row["active"]:
        raise SourceInactive(source_id)
    return CONNECTORS[row["connector_type"]](responses.where(F.col("source_id") == source_id), **options)


def coerce_cursor(text: Column) -> Column:
    """Null, a JSON object or a bare string as a cursor map, names folded to one spelling."""
    parsed = F.from_json(text, "map<string,string>")
    bare = F.when(F.trim(text).startswith("{"), None).when(F.trim(text) != "", F.map_from_arrays(F.array(F.lit("value")), F.array(text)))
    return fold_cursor(F.coalesce(F.when(F.trim(text).startswith("{"), parsed), bare, F.from_json(F.lit("{}"), "map<string,string>")))


def fold_cursor(cursor: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CURSOR_ALIASES.items() for x in pair])
    entries = F.transform(F.map_entries(cursor), lambda e: F.struct(F.coalesce(F.element_at(names, F.lower(e["key"])), F.lower(e["key"])).alias("key"), e["value"].alias("value")))
    # of names that fold to one the first stays
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(first)


def conditional_headers(cursor: Column) -> Column:
    """The request headers that a cursor asks for."""
    pairs = F.array(F.struct(F.lit("If-None-Match").alias("key"), cursor["etag"].alias("value")), F.struct(F.lit("If-Modified-Since").alias("key"), cursor["last_modified"].alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def response_cursor(before: Column, etag: Column, last_modified: Column) -> Column:
    """The cursor after a response: what it names replaces what was there."""
    new = F.map_from_entries(F.filter(F.array(F.struct(F.lit("etag").alias("key"), etag.alias("value")), F.struct(F.lit("last_modified").alias("key"), last_modified.alias("value"))), lambda p: p["value"].isNotNull()))
    old = F.coalesce(before, F.from_json(F.lit("{}"), "map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def sync_sources(stored: DataFrame, policy: DataFrame) -> DataFrame:
    """The stored registry with the active sources that it lacks; stored rows stay as they are."""
    return stored.unionByName(policy.where("active").join(stored, "source_id", "left_anti"))


def persist_cursors(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """The stored registry with the cursors and times of ``updates`` (source_id, cursor, last_success_at)."""
    new = updates.select("source_id", F.col("cursor").alias("_cursor"), F.col("last_success_at").alias("_at"))
    out = stored.join(new, "source_id", "left").withColumns({"cursor": F.coalesce("_cursor", "cursor"), "last_success_at": F.coalesce("_at", "last_success_at")})
    return out.select(*stored.columns)
