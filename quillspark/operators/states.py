"""The pipeline's state machine, as a table of edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states that may follow each state; a state without any is terminal.
EDGES: Mapping[str, Sequence[str]] = {
    "discovered": ("collected", "access_denied", "failed"),
    "collected": ("normalized", "failed"),
    "normalized": ("deduplicated", "duplicate"),
    "deduplicated": ("classified", "failed"),
    "classified": ("extracted", "irrelevant", "background_only"),
    "extracted": ("validated", "failed"),
    "validated": ("needs_review", "rejected"),
    "needs_review": ("approved", "rejected", "archived"),
    "approved": (),
    "rejected": (),
    "archived": (),
    "duplicate": (),
    "irrelevant": (),
    "background_only": (),
    "access_denied": (),
    "failed": (),
}


def can_transition(current: Column, target: Column, edges: Mapping[str, Sequence[str]] = EDGES) -> Column:
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, out in edges.items() for b in out]
    return F.exists(F.array(*pairs), lambda e: (e["a"] == current) & (e["b"] == target))


def is_terminal(state: Column, edges: Mapping[str, Sequence[str]] = EDGES) -> Column:
    return state.isin(*[a for a, out in edges.items() if not out])


def violations(history: DataFrame, by: Sequence[str], order: Sequence[str], state: str = "state", edges: Mapping[str, Sequence[str]] = EDGES) -> DataFrame:
    """Steps of a history that no edge allows: the keys, from_state, to_state."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    steps = history.withColumn("from_state", before).where("from_state IS NOT NULL")
    return steps.where(~F.coalesce(can_transition(F.col("from_state"), F.col(state), edges), F.lit(False))).withColumnRenamed(state, "to_state")


def advance(rows: DataFrame, requests: DataFrame, key: str, state: str = "state", edges: Mapping[str, Sequence[str]] = EDGES) -> DataFrame:
    """``rows`` after ``requests`` (key, target): allowed steps are taken, others give transition_error."""
    out = rows.join(requests.select(key, F.col("target").alias("_target")), key, "left")
    ok = can_transition(F.col(state), F.col("_target"), edges)
    return out.withColumn("transition_error", F.when(F.col("_target").isNotNull() & ~F.coalesce(ok, F.lit(False)), F.concat_ws(" -> ", state, "_target"))).withColumn(state, F.when(F.col("_target").isNotNull() & ok, F.col("_target")).otherwise(F.col(state))).drop("_target")
