"""Review at the command line: lists, details and decisions over Parquet tables in a folder.

The folder holds ``candidates``, ``reviews``, ``evidence`` and ``briefings``.  A decision writes the table
anew beside the old one and then takes its place, so a broken run leaves the old table.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import review, validation
from quillspark.session import session

REVIEW = "candidate_id string, reviewer_id string, decision string, comment string, reviewed_at timestamp"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m quillspark.review_cli", description="Review candidates and reports.")
    out.add_argument("--tables", required=True, help="folder of the Parquet tables")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name, key in (("list", ""), ("show", "candidate_id"), ("decide", "candidate_id"), ("briefing-list", ""), ("briefing-decide", "briefing_id")):
        verb = verbs.add_parser(name)
        if key:
            verb.add_argument(key)
        else:
            verb.add_argument("--status")
        if name.endswith("decide"):
            verb.add_argument("decision", choices=("approved", "rejected", "archived", "needs_review"))
        if name == "decide":
            verb.add_argument("--reviewer", required=True)
            verb.add_argument("--comment", default="")
    return out


def _replace(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(make(path), True)
    fs.rename(make(f"{path}.new"), make(path))


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The lines that a command prints; a decision that is not allowed raises ValueError."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{args.tables}/{name}")

    def lines(df: DataFrame) -> list[str]:
        return [r[0] for r in df.select(F.to_json(F.struct(*df.columns))).toLocalIterator()]

    if args.verb == "list":
        return lines(review.list_candidates(table("candidates"), args.status).select("candidate_id", "canonical_name", "review_status", "value_score"))
    if args.verb == "briefing-list":
        return lines(review.list_briefings(table("briefings"), args.status).select("briefing_id", "publication_status", "scheduled_for"))
    if args.verb == "show":
        one = table("candidates").where(F.col("candidate_id") == args.candidate_id)
        return lines(validation.candidate_view(one, table("evidence")).orderBy("position"))
    if args.verb == "briefing-decide":
        asked = spark.createDataFrame([(args.briefing_id, args.decision)], "briefing_id string, decision string")
        after = review.decide_briefings(table("briefings"), asked)
        if wrong := after.where("transition_error IS NOT NULL").select("transition_error").first():
            raise ValueError(wrong[0])
        _replace(after.drop("transition_error"), f"{args.tables}/briefings")
        return [f"{args.briefing_id}: {args.decision}"]
    asked = spark.createDataFrame([(args.candidate_id, args.reviewer, args.decision, args.comment, datetime.now(UTC).replace(tzinfo=None))], REVIEW)
    after, recorded = review.decide(table("candidates"), asked)
    if not recorded.count():
        raise ValueError(f"{args.candidate_id}: not allowed")
    recorded.write.mode("append").parquet(f"{args.tables}/reviews")
    _replace(after, f"{args.tables}/candidates")
    return [f"{args.candidate_id}: {args.decision}"]


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("local[2]", spark_ui_enabled="false")
    try:
        print("\n".join(run(spark, args)))
    except ValueError as exc:
        print(exc, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
