"""Curation as batches of commands applied to state tables. A command that cannot be applied goes to a table of rejects."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import shared_table

#: What a review does to a fact's status; a comment leaves it.
REVIEW_STATUS = {"verify": "verified", "reject": "rejected", "contradict": "contradicted", "supersede": "superseded"}
SEVERITY = ("low", "medium", "high", "critical")


def review_facts(facts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, reviews, rejects) after commands (seq, fact_id, reviewer, role, action, comment, at). A fact takes the status of its
    last command that has one; who verified it and when is set by verification alone. Repeats of one command count once."""
    commands = commands.dropDuplicates(["fact_id", "reviewer", "action", "comment", "at"])
    known = commands.join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    valid = known.where(F.col("action").isin(*REVIEW_STATUS, "comment"))
    rejects = commands.join(valid.select("seq"), "seq", "left_anti").withColumn("reason", F.lit("unknown fact or action"))
    status = F.create_map(*(F.lit(x) for pair in REVIEW_STATUS.items() for x in pair))
    changing = valid.where("action <> 'comment'")
    last = changing.groupBy("fact_id").agg(F.max_by("action", "seq").alias("_action"), F.max_by("reviewer", "seq").alias("_by"), F.max_by("at", "seq").alias("_at"))
    verified = F.col("_action") == "verify"
    out = facts.join(last.withColumnRenamed("fact_id", "id"), "id", "left")
    out = out.withColumns({
        "status": F.coalesce(F.try_element_at(status, "_action"), F.col("status")),
        "verified_by": F.when(verified, F.col("_by")).otherwise(F.col("verified_by")),
        "verified_at": F.when(verified, F.col("_at")).otherwise(F.col("verified_at")),
    })
    return out.select(*facts.columns), valid, rejects


def assign_facts(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments, rejects) from commands (seq, fact_id, action assign or release or complete, assignee, at). An assignment lasts
    until the next command on its fact; so at most one is active. A release or completion needs an active one."""
    own = Window.partitionBy("fact_id").orderBy("seq")
    told = commands.withColumns({"_before": F.lag("action").over(own), "_next": F.lead("action").over(own), "_until": F.lead("at").over(own)})
    bad = F.col("action").isin("release", "complete") & ~F.col("_before").eqNullSafe("assign")
    rejects = told.where(bad).select(*commands.columns).withColumn("reason", F.lit("no active assignment"))
    status = F.when(F.col("_next").isNull(), "active").when(F.col("_next") == "complete", "completed").otherwise("released")
    return told.where("action = 'assign'").select("seq", "fact_id", "assignee", F.col("at").alias("assigned_at"), F.col("_until").alias("released_at"), status.alias("status")), rejects


def close_assignments(assignments: DataFrame, decided: DataFrame) -> DataFrame:
    """assignments (as from assign_facts) after decisions (fact_id, at) on their facts, reviews that change a status or
    replacements: an active one is completed by the first decision that is not before it."""
    when = decided.select("fact_id", F.col("at").alias("_at"))
    active = assignments.where("status = 'active'").join(when, "fact_id").where(F.col("_at") >= F.col("assigned_at"))
    first = active.groupBy("seq").agg(F.min("_at").alias("_closed"))
    out = assignments.join(first, "seq", "left")
    done = F.col("_closed").isNotNull()
    return out.withColumns({"status": F.when(done, "completed").otherwise(F.col("status")), "released_at": F.coalesce("_closed", "released_at")}).select(*assignments.columns)


def settle_disputes(commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(disputes, comments, reviews, rejects) after commands (dispute_id, fact_id, seq, action open, comment, escalate, assign or resolve, severity, assignee,
    actor, due_at, resolution, fact_status, at) in the order of seq.

    A dispute begins with its first opening, which makes its fact contradicted, and ends with the first resolution after it, which may set another
    status; in between it can be escalated, to a named severity or by one step, and assigned; comments count until after its end. All else is
    rejected. Openings and resolutions are reviews of the fact. These are extremes and counts, combined before the shuffle, so that a
    dispute with any number of commands is no group."""
    named = F.when(F.col("severity") != "", F.col("severity"))
    opened = commands.where("action = 'open'").groupBy("dispute_id").agg(F.min("seq").alias("_open"), F.min_by(F.struct("fact_id", "severity", "assignee", "due_at"), "seq").alias("_first"))
    after = commands.join(opened.select("dispute_id", "_open"), "dispute_id").where("seq >= _open")
    ended = after.where("action = 'resolve'").groupBy("dispute_id").agg(F.min("seq").alias("_end"))
    told = after.join(ended, "dispute_id", "left")
    before_end = F.col("_end").isNull() | (F.col("seq") < F.col("_end"))
    stands = (F.col("seq") == F.col("_open")) | (F.col("action") == "comment") | (F.col("seq") == F.col("_end")) | (F.col("action").isin("escalate", "assign") & before_end)
    valid = told.where(stands & ((F.col("seq") > F.col("_open")) | (F.col("action") == "open"))).drop("_open", "_end")
    of = lambda action: F.col("action") == action
    last = valid.groupBy("dispute_id").agg(
        F.count_if(of("comment")).alias("n_comments"), F.max(F.when(of("escalate"), F.col("seq"))).alias("_escalated"), F.max_by(F.when(of("escalate"), F.col("at")), F.when(of("escalate"), F.col("seq"))).alias("escalated_at"),
        F.max(F.when(of("escalate") & named.isNotNull(), F.struct("seq", named.alias("severity")))).alias("_named"), F.max(F.when(of("assign"), F.struct("seq", "assignee"))).alias("_assigned"),
        F.max(F.when(of("resolve"), F.struct("seq", "actor", "at", "resolution", "fact_status"))).alias("_done"),
    )
    # steps since the last severity that was named
    steps = valid.where(of("escalate") & named.isNull()).join(last.select("dispute_id", F.coalesce("_named.seq", F.lit(-1)).alias("_since")), "dispute_id").where("seq > _since").groupBy("dispute_id").agg(F.count("*").alias("_steps"))
    joined = opened.join(last, "dispute_id").join(steps, "dispute_id", "left")
    level = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, name in enumerate(SEVERITY) for x in (name, i))), F.coalesce("_named.severity", "_first.severity")), F.lit(0))
    raised = F.element_at(F.array(*map(F.lit, SEVERITY)), F.least(level + F.col("_steps").cast("int"), F.lit(len(SEVERITY) - 1)) + 1)
    disputes = joined.select(
        "dispute_id", "_first.fact_id", F.when(F.col("_steps") > 0, raised).otherwise(F.coalesce("_named.severity", "_first.severity")).alias("severity"),
        F.when(F.col("_done").isNotNull(), "resolved").when(F.col("_escalated").isNotNull(), "escalated").otherwise("open").alias("status"),
        F.when(F.col("_assigned").isNotNull(), F.col("_assigned.assignee")).otherwise(F.col("_first.assignee")).alias("assignee"), "_first.due_at", "escalated_at", F.col("_done.actor").alias("resolved_by"),
        F.col("_done.at").alias("resolved_at"), F.col("_done.resolution").alias("resolution"), F.coalesce(F.when(F.col("_done.fact_status") != "", F.col("_done.fact_status")), F.lit("contradicted")).alias("fact_status"), "n_comments",
    )
    comments = valid.where(of("comment")).select("dispute_id", F.col("seq").alias("comment_id"), F.col("actor").alias("author"), "at")
    kinds = F.when(of("open"), "open_dispute").when(of("resolve"), "resolve_dispute")
    reviews = valid.withColumn("_kind", kinds).where("_kind IS NOT NULL").join(opened.select("dispute_id", F.col("_first.fact_id").alias("_fact")), "dispute_id").select("seq", F.col("_fact").alias("fact_id"), F.col("actor").alias("reviewer"), F.col("_kind").alias("action"), F.col("resolution").alias("comment"), "at")
    return disputes, comments, reviews, commands.join(valid.select("dispute_id", "seq"), ["dispute_id", "seq"], "left_anti")


def fold_disputes(commands: DataFrame) -> DataFrame:
    """The disputes of settle_disputes, and for each dispute_id of commands the numbers of its rejected ones, in order."""
    disputes, _, _, rejects = settle_disputes(commands)
    listed = rejects.groupBy("dispute_id").agg(F.array_sort(F.collect_list("seq")).alias("rejected"))
    ids = commands.select("dispute_id").distinct()
    return ids.join(disputes, "dispute_id", "left").join(listed, "dispute_id", "left").withColumns({"n_comments": F.coalesce("n_comments", F.lit(0)), "rejected": F.coalesce("rejected", F.array().cast("array<long>"))})


def dispute_list(disputes: DataFrame, comments: DataFrame, as_of: Column) -> DataFrame:
    """Disputes with the state of their deadline and number of comments; gravest first, then by due date, missing ones last."""
    n = comments.groupBy("dispute_id").agg(F.count("*").alias("n_comments"))
    state = F.when(F.col("status") == "resolved", "closed").when(F.col("due_at").isNull(), "unassigned_sla").when(F.col("due_at") < as_of, "overdue").otherwise("within_sla")
    gravity = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, s in enumerate(SEVERITY) for x in (s, i))), F.col("severity")), F.lit(-1))
    joined = disputes.join(n, disputes["id"] == n["dispute_id"], "left").drop("dispute_id")
    return joined.withColumns({"sla_state": state, "n_comments": F.coalesce("n_comments", F.lit(0))}).orderBy(gravity.desc(), F.col("due_at").asc_nulls_last(), F.col("id").desc())


def supersede_facts(facts: DataFrame, commands: DataFrame) -> DataFrame:
    """Facts after commands (old_id, new_id): the old becomes superseded; the new links to it, and its version is its own or one
    more than the longest chain of replacements that leads to it, whichever is larger."""
    old = commands.select(F.col("old_id").alias("id"), F.lit(True).alias("_old")).distinct()
    links = commands.groupBy(F.col("new_id").alias("id")).agg(F.max("old_id").alias("_from"))
    before = facts.select(F.col("id").alias("_from"), F.col("version").alias("_old_version"))
    out = facts.join(old, "id", "left").join(links, "id", "left").join(before, "_from", "left")
    return out.withColumns({
        "status": F.when(F.col("_old"), "superseded").otherwise(F.col("status")),
        "version": F.when(F.col("_from").isNotNull(), F.greatest("version", F.col("_old_version") + 1)).otherwise(F.col("version")),
        "supersedes_fact_id": F.coalesce("_from", "supersedes_fact_id"),
    }).select(*facts.columns)


def fact_history(facts: DataFrame, reviews: DataFrame, assignments: DataFrame, disputes: DataFrame) -> DataFrame:
    """Facts with their reviews, assignments and disputes as arrays in order of seq or id, and what supersedes them."""
    def listed(df: DataFrame, name: str, order: str) -> DataFrame:
        return df.groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in df.columns if c not in ("fact_id", order))))).alias(name))

    after = facts.where("supersedes_fact_id IS NOT NULL").groupBy(F.col("supersedes_fact_id").alias("id")).agg(F.min("id").alias("superseded_by"))
    out = facts
    for rows in (listed(reviews, "reviews", "seq"), listed(assignments, "assignments", "seq"), listed(disputes, "disputes", "dispute_id"), after):
        out = out.join(rows, "id", "left")
    return out


def supersede_chains(facts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, reviews, rejects) after commands (seq, old_id, new_id, reviewer, role, comment), applied in the order of seq, chains of any length
    in one call.

    The old fact becomes superseded and is reviewed as such; the new one links to the old of its last command; its version is its own, or one more
    than the old one's at that time, if that is more. A command whose facts are the same or unknown is rejected.

    What a command gives its new fact is the longest way to it through earlier commands, each of which made the next one's old fact. Ways double in
    length each round: a command hands what it knows to those 1, 2, 4, ... steps on, so a chain of a thousand links takes ten rounds. Every round
    is checkpointed; only whether any way is left comes to the driver."""
    known = facts.select("id", F.coalesce("version", F.lit(1)).alias("_version"))
    valid = commands.where("old_id <> new_id").join(known.select(F.col("id").alias("new_id")), "new_id", "left_semi").join(known.withColumnsRenamed({"id": "old_id", "_version": "_old_version"}), "old_id")
    gives = shared_table(valid.select("seq", "old_id", "new_id", (F.col("_old_version") + 1).alias("value")))
    made, takes = gives.select("seq", F.col("new_id").alias("fact")), gives.select(F.col("seq").alias("to"), F.col("old_id").alias("fact"))
    ways, step = shared_table(made.join(takes, "fact").where("seq < to").select("seq", "to").distinct()), 1
    while not ways.isEmpty():
        told = ways.join(gives.select("seq", "value"), "seq").groupBy(F.col("to").alias("seq")).agg((F.max("value") + step).alias("more"))
        gives = shared_table(gives.join(told, "seq", "left").withColumn("value", F.greatest("value", F.coalesce("more", "value"))).drop("more"))
        ways, step = shared_table(ways.join(ways.select(F.col("seq").alias("to"), F.col("to").alias("on")), "to").select("seq", F.col("on").alias("to")).distinct()), 2 * step
    new = gives.groupBy(F.col("new_id").alias("id")).agg(F.max("value").alias("_value"), F.max_by("old_id", "seq").alias("_from"))
    old = gives.select(F.col("old_id").alias("id"), F.lit(True).alias("_old")).distinct()
    out = facts.join(old, "id", "left").join(new, "id", "left").withColumns({
        "status": F.when(F.col("_old"), "superseded").otherwise(F.col("status")),
        "version": F.greatest("version", "_value"),
        "supersedes_fact_id": F.coalesce("_from", "supersedes_fact_id"),
    }).select(*facts.columns)
    done = commands.join(gives.select("seq"), "seq", "left_semi")
    reviews = done.select("seq", F.col("old_id").alias("fact_id"), "reviewer", "role", F.lit("mark_superseded").alias("action"), "comment")
    return out, reviews, commands.join(gives.select("seq"), "seq", "left_anti").withColumn("reason", F.lit("same or unknown facts"))


def chains(facts: DataFrame) -> DataFrame:
    """(id, root, place): the first fact of each fact's chain of replacements, and how many links lead to it, by pointer doubling over
    supersedes_fact_id. A link to an unknown fact ends a chain there; facts of a circle, and those that lead into one, have neither."""
    facts = shared_table(facts.select("id", "supersedes_fact_id"))
    ids = facts.select("id")
    links = facts.where("supersedes_fact_id IS NOT NULL").select("id", F.col("supersedes_fact_id").alias("to")).join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    at = shared_table(ids.join(links, "id", "left").select("id", F.coalesce("to", "id").alias("root"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("to").isNull().alias("done")))
    # a way of more links than there are facts is a circle
    for _ in range(max(1, at.count()).bit_length() + 1):
        if at.where("NOT done").isEmpty():
            break
        # what has reached its root meets the root's own row, which leaves it as it is
        beyond = at.select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("place").alias("_place"), F.col("done").alias("_done"))
        at = shared_table(at.join(beyond, "root").select("id", F.col("_root").alias("root"), (F.col("place") + F.col("_place")).alias("place"), F.col("_done").alias("done")))
    return at.select("id", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("place")).alias("place"))


def history_rows(facts: DataFrame, reviews: DataFrame, assignments: DataFrame, disputes: DataFrame, comments: DataFrame) -> DataFrame:
    """(id, kind, ref, actor, said) of everything that happened to each fact, in long form, so that a fact of any length of history is no
    group: reviews (fact_id, seq, reviewer, action), assignments (fact_id, seq, assignee, status), disputes (fact_id, dispute_id, severity, status),
    their comments (dispute_id, comment_id, author, comment), the fact that it supersedes, those that supersede it, and its chain (root, and its place)."""
    row = lambda df, kind, ref, actor, said: df.select(F.col("fact_id").alias("id"), F.lit(kind).alias("kind"), F.col(ref).cast("long").alias("ref"), F.col(actor).cast("string").alias("actor") if actor else F.lit(None).cast("string").alias("actor"), said.cast("string").alias("said"))
    # used seven times: what gives the facts is computed once
    facts = shared_table(facts.select("id", "supersedes_fact_id", "status"))
    own = facts.select(F.col("id").alias("fact_id"))
    of = lambda df: df.join(own, "fact_id", "left_semi")
    links = facts.where("supersedes_fact_id IS NOT NULL").select(F.col("id").alias("fact_id"), "supersedes_fact_id", "status")
    back = links.select(F.col("supersedes_fact_id").alias("fact_id"), F.col("fact_id").alias("by"), "status")
    placed = chains(facts).where("place > 0").select(F.col("id").alias("fact_id"), "root", "place")
    parts = [
        row(of(reviews), "review", "seq", "reviewer", F.col("action")), row(of(assignments), "assignment", "seq", "assignee", F.col("status")), row(of(disputes), "dispute", "dispute_id", None, F.concat_ws(" ", "severity", "status")),
        row(of(disputes).select("fact_id", "dispute_id").join(comments, "dispute_id"), "dispute_comment", "comment_id", "author", F.col("comment")),
        row(links, "supersedes", "supersedes_fact_id", None, F.col("status")), row(of(back), "superseded_by", "by", None, F.col("status")), row(placed, "chain", "root", None, F.col("place")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def pending_queue(facts: DataFrame, assignments: DataFrame, limit: int = 100) -> DataFrame:
    """Facts that wait for a decision, surest first, with the active assignee."""
    active = assignments.where("status = 'active'").groupBy(F.col("fact_id").alias("id")).agg(F.max_by("assignee", "seq").alias("assignee"))
    waiting = facts.where(F.col("status").isNull() | F.col("status").isin("candidate", "contradicted"))
    return waiting.join(active, "id", "left").orderBy(F.col("confidence").desc_nulls_last(), F.col("id").desc()).limit(limit)


def batches(commands: DataFrame) -> Iterator[DataFrame]:
    """One batch for each link of the longest chain in commands (seq, old_id, new_id), so that chains apply in order."""
    left = commands
    while not left.isEmpty():
        # a command waits while an earlier one makes its old fact
        earlier = left.select(F.col("new_id").alias("old_id"), F.col("seq").alias("_seq"))
        waiting = left.join(earlier, "old_id").where("_seq < seq").select("seq").distinct()
        yield left.join(waiting, "seq", "left_anti")
        left = left.join(waiting, "seq", "left_semi")
