"""Review decisions as appends and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import states

#: Where a decision on a report may lead from.
BRIEFING_EDGES = {"draft": ("approved", "rejected", "archived"), "pending_approval": ("approved", "rejected", "archived"), "approved": (), "rejected": (), "archived": ()}


def list_candidates(candidates: DataFrame, status: str | None = None) -> DataFrame:
    rows = candidates if status is None else candidates.where(F.col("review_status") == status)
    return rows.orderBy("created_at", "candidate_id")


def list_briefings(briefings: DataFrame, status: str | None = None) -> DataFrame:
    rows = briefings if status is None else briefings.where(F.col("publication_status") == status)
    return rows.orderBy("scheduled_for", "briefing_id")


def decide(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, reviews) after decisions (candidate_id, reviewer_id, decision, comment, reviewed_at).

    Only allowed decisions change a status; the reviews that are appended are those.
    """
    request = decisions.select("candidate_id", F.col("decision").alias("target"))
    after = states.advance(candidates, request, "candidate_id", "review_status")
    bad = after.where("transition_error IS NOT NULL").select("candidate_id")
    return after.drop("transition_error"), decisions.join(bad, "candidate_id", "left_anti")


def decide_briefings(briefings: DataFrame, decisions: DataFrame) -> DataFrame:
    """``briefings`` after decisions (briefing_id, decision); what is not open stays, with transition_error."""
    return states.advance(briefings, decisions.select("briefing_id", F.col("decision").alias("target")), "briefing_id", "publication_status", BRIEFING_EDGES)


def amend(amendments: DataFrame, proposals: DataFrame) -> DataFrame:
    """``amendments`` with proposals (candidate_id, reviewer_id, field_name, proposed_value, reason) of core fields.

    Candidates themselves do not change.
    """
    return amendments.unionByName(proposals.where(F.col("field_name").isin(*text.CORE_FIELDS)).select(*amendments.columns))


def candidate_versions(candidates: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions of each candidate, in the order in which it names them."""
    named = candidates.select("candidate_id", F.posexplode("document_version_ids").alias("position", "document_version_id"))
    return named.join(versions, "document_version_id").orderBy("candidate_id", "position")
