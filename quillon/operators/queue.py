"""The curation queue as tables: tasks, and the changes that workers and curators ask for.

Each operator takes tasks and asks as DataFrames and returns (tasks afterwards, refusals with reasons); all asks of a batch
are settled by joins on the task, so the same batch gives the same result however it is dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in which a verdict stands.
TERMINAL = ("accepted", "edited", "rejected")


def claimable(now: Column) -> Column:
    """Whether a task may be claimed: pending, or leased until no later than now."""
    return (F.col("status") == "pending") | ((F.col("status") == "in_progress") & (F.col("lease_expires_at") <= now))


def claim(tasks: DataFrame, workers: DataFrame, now: Column, lease_seconds: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Lease the next tasks, by priority, age and id, to workers (worker_id) in their order, one each; returns (tasks, claims).

    Of all claimable tasks only the first `most` are ordered, which must be as many as there are workers. A claim counts
    as an attempt. A task goes to one worker; workers beyond the tasks get none.
    """
    if lease_seconds <= 0:
        raise ValueError("a lease takes time")
    order = ["priority", "created_at", "task_id"]
    first = tasks.where(claimable(now)).orderBy(*order).limit(most)
    turn = lambda df, *by: df.withColumn("_turn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)))  # noqa: E731  # `most` rows
    given = turn(first.select(*order), *order).join(turn(workers.where(F.trim("worker_id") != "").orderBy("worker_id").limit(most), "worker_id"), "_turn")
    claims = given.select("task_id", "worker_id", now.alias("claimed_at"), (now + F.expr(f"INTERVAL {lease_seconds} SECONDS")).alias("expires"))
    j = tasks.join(F.broadcast(claims), "task_id", "left")
    mine = F.col("worker_id").isNotNull()
    out = j.withColumns({
        "status": F.when(mine, "in_progress").otherwise(F.col("status")), "claimed_by": F.when(mine, F.col("worker_id")).otherwise(F.col("claimed_by")),
        "lease_expires_at": F.when(mine, F.col("expires")).otherwise(F.col("lease_expires_at")), "attempts": F.col("attempts") + F.when(mine, 1).otherwise(0),
    })
    return out.select(tasks.columns), claims


def _held(tasks: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asks (task_id, worker_id) of workers who hold the task, refusals of the others)."""
    j = asks.join(tasks.select("task_id", "status", "claimed_by", F.lit(True).alias("_there")), "task_id", "left")
    held = (F.col("status") == "in_progress") & (F.col("claimed_by") == F.col("worker_id"))
    why = F.when(F.col("_there").isNull(), "no_such_task").otherwise("lease_lost")
    return j.where(held).select(asks.columns), j.where(~F.coalesce(held, F.lit(False))).select("task_id", "worker_id", why.alias("reason"))


def heartbeat(tasks: DataFrame, beats: DataFrame, now: Column, lease_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Lengthen the leases of workers (task_id, worker_id) who hold them; whoever doesn't is told that the lease is lost."""
    good, refused = _held(tasks, beats)
    j = tasks.join(good.select("task_id", F.lit(True).alias("_beat")).distinct(), "task_id", "left")
    until = F.when(F.col("_beat"), now + F.expr(f"INTERVAL {lease_seconds} SECONDS")).otherwise(F.col("lease_expires_at"))
    return j.withColumn("lease_expires_at", until).select(tasks.columns), refused


def release(tasks: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give tasks back to the queue (task_id, worker_id, reason): pending again, which is no rejection. A reason is needed."""
    mute = F.trim(F.coalesce("reason", F.lit(""))) == ""
    good, refused = _held(tasks, asks.where(~mute))
    j = tasks.join(good.select("task_id", F.lit(True).alias("_back")).distinct(), "task_id", "left")
    back = F.coalesce("_back", F.lit(False))
    out = j.withColumns({"status": F.when(back, "pending").otherwise(F.col("status")), "claimed_by": F.when(~back, F.col("claimed_by")), "lease_expires_at": F.when(~back, F.col("lease_expires_at"))})
    return out.select(tasks.columns), refused.union(asks.where(mute).select("task_id", "worker_id", F.lit("no_reason")))


def decide(tasks: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settle verdicts (task_id, action, curator, curator_kind, reason, edited_payload, decided_at): accept, edit or reject.

    Refused, in this order: an action that is none, no reason, a curator who isn't human, an unknown task, one that has a
    verdict, a curator who wrote the proposal (for accept and edit), an edit without a payload, and all but the first
    verdict on a task.
    """
    status = F.create_map(*map(F.lit, ("accept", "accepted", "edit", "edited", "reject", "rejected")))
    j = verdicts.join(tasks.select("task_id", F.col("status").alias("_status"), F.col("proposed_by").alias("_by"), F.lit(True).alias("_there")), "task_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = (
        F.when(F.try_element_at(status, F.col("action")).isNull(), "no_such_action").when(blank("reason"), "no_reason").when(F.coalesce("curator_kind", F.lit("")) != "human", "not_human")
        .when(F.col("_there").isNull(), "no_such_task").when(F.col("_status").isin(*TERMINAL), "already_resolved").when(F.col("action").isin("accept", "edit") & F.col("_by").eqNullSafe(F.col("curator")), "self_review")
        .when((F.col("action") == "edit") & blank("edited_payload"), "no_payload")
    )
    j = j.withColumn("_why", why)
    first = j.where("_why IS NULL").groupBy("task_id").agg(F.min(F.struct("decided_at", "curator", "action", "reason", "edited_payload")).alias("v"))
    refused = j.join(first, "task_id", "left").where(F.col("_why").isNotNull() | (F.struct("decided_at", "curator", "action") != F.struct("v.decided_at", "v.curator", "v.action")))
    done = tasks.join(first, "task_id", "left")
    new = F.col("v").isNotNull()
    out = done.withColumns({
        "status": F.when(new, F.element_at(status, F.col("v.action"))).otherwise(F.col("status")), "claimed_by": F.when(~new, F.col("claimed_by")), "lease_expires_at": F.when(~new, F.col("lease_expires_at")),
    }).select(*tasks.columns, F.col("v.curator").alias("curator"), F.col("v.reason").alias("resolution_reason"), F.col("v.edited_payload").alias("edited_payload"))
    return out, refused.select("task_id", "curator", "action", F.coalesce("_why", F.lit("already_resolved")).alias("refusal"))


def install_decisions(held: DataFrame, decisions: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(decisions in force, counts by outcome) after new screening decisions (key, decision, decided_by_kind, decided_at).

    A decision on an unknown publication is skipped, never made to fit; a model's verdict doesn't replace a human's; of
    several for one key the latest counts, a human's before a model's.
    """
    d = decisions.withColumn(key, F.lower(key)).join(known.select(F.lower(key).alias(key), F.lit(True).alias("_known")).distinct(), key, "left")
    d = d.join(held.where("decided_by_kind = 'human'").select(F.lower(key).alias(key), F.lit(True).alias("_human")).distinct(), key, "left")
    outcome = F.when(F.col("_known").isNull(), "no_such_publication").when((F.col("decided_by_kind") == "model") & F.col("_human"), "kept_human_verdict").otherwise("written")
    d = d.withColumn("outcome", outcome)
    row = F.struct((F.col("decided_by_kind") == "human").alias("human"), "decided_at", "decision", "decided_by_kind")
    new = d.where("outcome = 'written'").groupBy(key).agg(F.max(row).alias("r")).select(key, "r.decision", "r.decided_by_kind", "r.decided_at")
    kept = held.withColumn(key, F.lower(key)).join(new.select(key), key, "left_anti")
    return kept.unionByName(new), d.groupBy("outcome").agg(F.count("*").alias("n"))


def write_contexts(writes: DataFrame, vocabulary: DataFrame, approved_by: str, approver_kind: str, reason: str, kinds: Sequence[str] = ("human",)) -> tuple[DataFrame, DataFrame]:
    """(facet rows to write (label, facet, value, shadow), refusals (label, reason)) of contexts (label, facets map).

    A context with a facet that the vocabulary (facet, has_column) lacks, or without facets, is refused, and then nothing
    is written. A facet without a column of its own is written as a shadow row. Contexts that would be told apart only by
    dropped facets are thus kept apart.
    """
    if approver_kind not in kinds or not approved_by.strip() or not reason.strip():
        raise ValueError("contexts are written for a named approver of a known kind, with a reason")
    empty = writes.where(F.coalesce(F.size("facets"), F.lit(0)) <= 0).select("label", F.lit("no_facets").alias("reason"))
    rows = writes.select("label", F.explode("facets").alias("facet", "value")).join(F.broadcast(vocabulary), "facet", "left")
    unknown = rows.where("has_column IS NULL").groupBy("label").agg(F.concat(F.lit("unknown_facets: "), F.array_join(F.array_sort(F.collect_set("facet")), ", ")).alias("reason"))
    refusals = empty.union(unknown)
    clean = F.broadcast(refusals.agg((F.count("*") == 0).alias("_clean")))  # a single row: all or nothing
    out = rows.crossJoin(clean).where("_clean").select("label", "facet", "value", (~F.col("has_column")).alias("shadow"))
    return out, refusals


def running_budget(calls: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, limit: float) -> DataFrame:
    """calls with spent (before each) and allowed: a call is made while its group's earlier calls leave budget."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumn("spent", F.coalesce(F.sum(cost).over(before), F.lit(0.0)))
    return out.withColumn("allowed", F.col("spent") + F.col(cost) <= limit)


#: Judged states of a record, and the bases of a candidate, the strongest first.
JUDGED, BASES = ("accepted", "edited"), ("same_span", "same_strain_as_reported", "unattributed")


def context_groups(records: DataFrame, known_facets: Sequence[str]) -> DataFrame:
    """(publication_id, task_id, key, basis, members, unknown_facet): the candidate context of each judged record.

    records are (publication_id, task_id, status, span_start, span_end, strain, facet). A record goes by the strongest
    fact that it shares with others of its publication: its span, if at least two records have it; else its reported
    strain; else it stands alone. Each is in one candidate. `members` counts the candidate's records, of which a strain's may be
    one. Groups are counted in each task before they are shuffled. Nothing is written: a proposal is no context.
    """
    r = records.where(F.col("status").isin(*JUDGED))
    span = ["publication_id", "span_start", "span_end"]
    shared = r.where("span_start IS NOT NULL AND span_end IS NOT NULL").groupBy(*span).agg(F.count("*").alias("_n")).where("_n > 1")
    r = r.join(shared, span, "left")
    by_span, strain = F.col("_n").isNotNull(), F.coalesce("strain", F.lit(""))
    key = F.when(by_span, F.concat(F.lit("span:"), F.col("span_start").cast("string"), F.lit("-"), F.col("span_end").cast("string"))).when(strain != "", F.concat(F.lit("strain:"), strain))
    key = F.coalesce(key, F.concat(F.lit("facet:"), F.col("task_id").cast("string")))
    basis = F.when(by_span, BASES[0]).when(strain != "", BASES[1]).otherwise(BASES[2])
    unknown = F.coalesce(F.col("facet") != "", F.lit(False)) & ~F.col("facet").isin(*known_facets)
    placed = r.select("publication_id", "task_id", key.alias("key"), basis.alias("basis"), unknown.alias("unknown_facet"))
    sizes = placed.groupBy("publication_id", "key").agg(F.count("*").alias("members"))
    return placed.join(sizes, ["publication_id", "key"]).select("publication_id", "task_id", "key", "basis", "members", "unknown_facet")
