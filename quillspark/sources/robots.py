"""Robots rules as a table, and decisions by a join.

Rule files are small and parsed once each; a decision joins URLs to the rules of their host and takes
the longest matching pattern, an allow before a disallow of equal length.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = T.ArrayType(T.StructType([T.StructField("agent", T.StringType()), T.StructField("allow", T.BooleanType()), T.StructField("pattern", T.StringType()), T.StructField("regex", T.StringType())]))


def _regex(pattern: str) -> str:
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(x) for x in pattern.removesuffix("$").split("*")) + ("$" if end else "")


def parse(body: str | None) -> list[tuple[str, bool, str, str]] | None:
    """(agent, allow, pattern, regex) of a rule file: agents share the rules that follow them."""
    if body is None:
        return None
    agents: list[str] = []
    rules: list[tuple[str, bool, str, str]] = []
    open_ = False
    for line in body.splitlines():
        line = line.partition("#")[0].strip()
        name, sign, value = (x.strip() for x in line.partition(":"))
        if not line:
            agents, open_ = [], False
        elif sign and name.lower() == "user-agent":
            agents = [value.lower()] if not open_ else [*agents, value.lower()]
            open_ = True
            rules.append((value.lower(), True, "", ""))  # an agent without rules is still known
        elif sign and name.lower() in ("allow", "disallow"):
            open_ = False
            if value:
                rules += [(a, name.lower() == "allow", value, _regex(value)) for a in agents]
    return rules


@F.pandas_udf(RULE)
def parse_rules(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if (r := parse(b)) is None else [dict(zip(("agent", "allow", "pattern", "regex"), x, strict=True)) for x in r])


def agent_score(agent: Column, user_agent: str) -> Column:
    """0 for ``*``, the length of an agent that begins the product name, null for others."""
    product = user_agent.lower().split("/")[0].strip()
    return F.when(agent == "*", 0).when((agent != "") & F.lit(product).startswith(agent), F.length(agent))


def rule_table(files: DataFrame, user_agent: str = "*") -> DataFrame:
    """(host, known, allow, pattern, regex) of ``files`` (host, body): the rules of the best agents only.

    A host whose file is null has no row; a host without a matching agent has one row without rule.
    """
    rows = files.where("body IS NOT NULL").select("host", F.explode_outer(parse_rules("body")).alias("r"))
    rows = rows.select("host", "r.*").withColumn("score", agent_score(F.col("agent"), user_agent))
    best = rows.groupBy("host").agg(F.max("score").alias("best"))
    kept = rows.join(best, "host").where("score IS NULL AND best IS NULL OR score = best")
    return kept.select("host", F.when(F.col("score").isNotNull() & (F.col("pattern") != ""), F.struct("allow", "pattern", "regex")).alias("rule")).distinct()


def decide(df: DataFrame, rules: DataFrame, path: str = "path", host: str = "host") -> DataFrame:
    """``df`` with robots_allowed (true, false, unknown) and robots_rule.

    A host without rules is unknown; a path that no rule matches is allowed.  Rules are few to a host, so
    they are gathered per host and joined once; each path tests the rules of its host alone.
    """
    gathered = rules.groupBy(F.col("host").alias(host)).agg(F.collect_set("rule").alias("_rules"), F.lit(True).alias("_known"))
    row = df.join(gathered, host, "left")
    hits = F.filter("_rules", lambda r: F.regexp_like(F.col(path), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"), r["pattern"].alias("pattern"))))
    row = row.withColumn("_best", best)
    allowed = F.when(F.col("_known").isNull(), "unknown").when(F.col("_best").isNull() | F.col("_best.allow"), "true").otherwise("false")
    return row.withColumn("robots_allowed", allowed).withColumn("robots_rule", F.col("_best.pattern")).drop("_rules", "_known", "_best")
