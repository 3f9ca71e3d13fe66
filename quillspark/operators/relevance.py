"""Relevance by explainable term rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text


@dataclass(frozen=True)
class Terms:
    """Fixed values by default: the four term lists, and words that stand for a short horizon."""

    microstructure: Sequence[str] = ("execution", "imbalance", "l1", "l2", "l3", "liquidity", "market depth", "microstructure", "order book", "order flow", "order-flow", "orderbook", "queue", "spread", "tick", "trade")
    strategy: Sequence[str] = ("arbitrage", "breakout", "entry", "exit", "holding horizon", "holding period", "market making", "market-making", "mean reversion", "mean-reversion", "momentum", "scalp", "scalping", "short horizon", "short-horizon", "signal")
    background: Sequence[str] = ("liquidity", "market depth", "market microstructure", "order book", "price formation")
    irrelevant: Sequence[str] = ("dividend", "fundamental analysis", "long term investment", "long-term investment", "portfolio allocation", "retirement", "valuation")
    horizon: Sequence[str] = ("minutes", "seconds")


SIGNALS = ("microstructure", "strategy", "background", "irrelevant")


def classify(docs: DataFrame, terms: Terms = Terms(), body: str = "text", title: str | None = None, explain: bool = True) -> DataFrame:
    """``docs`` with ``relevance`` and, if asked for, the matched terms and snippets of each list.

    A term of the irrelevant list decides only where no strategy term stands; a strategy term needs a
    microstructure or horizon term beside it; microstructure or background alone is background.
    """
    whole = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in (title, body) if c])
    out = docs.withColumn("_text", whole)
    for name in SIGNALS:
        out = out.withColumn(f"{name}_terms", text.matched_terms(F.col("_text"), getattr(terms, name)))
    has = {name: F.size(f"{name}_terms") > 0 for name in SIGNALS}
    rule = F.when(has["irrelevant"] & ~has["strategy"], "irrelevant").when(has["strategy"] & (has["microstructure"] | text.contains_any("_text", terms.horizon)), "relevant").when(has["microstructure"] | has["background"], "background_only").otherwise("irrelevant")
    out = out.withColumn("relevance", rule)
    if explain:
        for name in SIGNALS:
            out = out.withColumn(f"{name}_snippets", F.array_compact(F.transform(F.slice(f"{name}_terms", 1, 3), lambda t: text.snippet(F.col("_text"), t))))
    return out.drop("_text")


def next_state(relevance: Column) -> Column:
    """The pipeline state that a relevance leads to."""
    return F.when(relevance == "relevant", "extracted").otherwise(relevance)


def classifiable(docs: DataFrame, state: str = "state") -> DataFrame:
    """Rows that may still be classified: early states, or none."""
    return docs.where(F.col(state).isNull() | F.col(state).isin("collected", "normalized", "deduplicated", "classified"))
