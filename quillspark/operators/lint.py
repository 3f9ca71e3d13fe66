"""Phrases that must not be published."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of banned phrases by category, in Korean and English.
BANNED: Mapping[str, Sequence[str]] = {
    "investment_recommendation": (
        r"투자\s*(?:추천|권유)|(?:매수|매도)\s*(?:추천|권유)",
        r"\b(?:investment|stock)\s+(?:recommendation|advice)\b|\b(?:buy|sell)\s+(?:recommendation|tip)\b",
    ),
    "trading_signal": (
        r"(?:매수|매도|매매)\s*신호|(?:매수|매도)\s*타점",
        r"\b(?:buy|sell|trading|entry|exit)\s+signal\b",
    ),
    "return_guarantee": (
        r"(?:수익|수익률|원금)\s*(?:을|이)?\s*보장|무손실|확정\s*수익|고수익\s*보장",
        r"\bguaranteed?\s+(?:return|returns|profit|profits|income)\b|\b(?:return|returns|profit|profits|income)\s+guaranteed\b|\b(?:return|returns|profit|income)\s+guarantee\b|\b(?:risk[- ]free|no[- ]loss|principal\s+guaranteed)\b",
    ),
}


def phrases(c: Column, patterns: Mapping[str, Sequence[str]] = BANNED) -> Column:
    """All matches as structs (category, phrase), by category and pattern."""
    found = [F.transform(F.regexp_extract_all(c, F.lit(f"(?i)({p})"), F.lit(1)), lambda m, k=k: F.struct(F.lit(k).alias("category"), m.alias("phrase"))) for k, ps in patterns.items() for p in ps]
    return F.concat(*found)


def is_clean(c: Column, patterns: Mapping[str, Sequence[str]] = BANNED) -> Column:
    """Whether text holds no banned phrase; null text holds none."""
    hit = F.lit(False)
    for p in (p for ps in patterns.values() for p in ps):
        hit = hit | F.coalesce(c.rlike(f"(?i){p}"), F.lit(False))
    return ~hit


def find(df: DataFrame, key: str, body: str, patterns: Mapping[str, Sequence[str]] = BANNED) -> DataFrame:
    """(key, category, phrase, start, end): every match with its place, in order of place."""
    compiled = [(k, re.compile(p, re.IGNORECASE)) for k, ps in patterns.items() for p in ps]

    @F.pandas_udf("array<struct<category:string,phrase:string,start:int,end:int>>")
    def places(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            found = [(m.start(), m.end(), k, m[0]) for k, p in compiled for m in p.finditer(t or "")]
            return [{"category": k, "phrase": w, "start": a, "end": b} for a, b, k, w in sorted(found)]

        return texts.map(one)

    # only texts with a match leave the JVM
    return df.where(~is_clean(F.col(body), patterns)).select(key, F.inline(places(body)))
