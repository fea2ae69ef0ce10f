"""Chains of replacements: long ones in one call, out of order, merged, circular; and disputes with odd commands."""

import random

from pyspark.sql import functions as F

from lodestone.operators import curate

FACTS = "id long, status string, version int, supersedes_fact_id long"
COMMANDS = "seq long, old_id long, new_id long, reviewer string, role string, comment string"


def brute(facts, commands):
    state, rejected = {f[0]: list(f) for f in facts}, []
    for seq, old, new, *_ in sorted(commands):
        if old == new or old not in state or new not in state:
            rejected.append(seq)
            continue
        state[old][1] = "superseded"
        state[new][3] = old
        state[new][2] = max(state[new][2] or 1, (state[old][2] or 1) + 1) if state[new][2] is not None else (state[old][2] or 1) + 1
    return sorted(map(tuple, state.values())), sorted(rejected)


def test_a_thousand_links_in_one_call(spark):
    facts = [(i, "candidate", 1, None) for i in range(1001)]
    commands = [(i, i, i + 1, "r", "analyst", "c") for i in range(1000)]
    out, reviews, rejects = curate.supersede_chains(spark.createDataFrame(facts, FACTS), spark.createDataFrame(commands, COMMANDS))
    rows = {r.id: r for r in out.collect()}
    assert rows[1000].version == 1001 and rows[1000].status == "candidate" and rows[999].status == "superseded" and rows[500].supersedes_fact_id == 499
    assert reviews.count() == 1000 and rejects.count() == 0


def test_places_in_a_chain_of_a_thousand(spark):
    linked = spark.createDataFrame([(i, "x", 1, i - 1 if i else None) for i in range(1001)], FACTS)
    placed = {r.id: (r.root, r.place) for r in curate.chains(linked).collect()}
    assert placed == {i: (0, i) for i in range(1001)}


def test_commands_apply_in_their_order(spark):
    rnd = random.Random(3)
    facts = [(i, "candidate", rnd.randrange(1, 6), None) for i in range(30)]
    commands = [(seq, rnd.randrange(32), rnd.randrange(32), "r", "analyst", None) for seq in rnd.sample(range(500), 60)]
    out, _, rejects = curate.supersede_chains(spark.createDataFrame(facts, FACTS), spark.createDataFrame(commands, COMMANDS))
    want, rejected = brute(facts, commands)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert sorted(r.seq for r in rejects.collect()) == rejected and rejected


def test_circles_have_no_root(spark):
    facts = [(1, "x", 1, 2), (2, "x", 1, 1), (3, "x", 1, 2), (4, "x", 1, None), (5, "x", 1, 4), (6, "x", 1, 99), (7, "x", 1, 7)]
    got = {r.id: (r.root, r.place) for r in curate.chains(spark.createDataFrame(facts, FACTS)).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (4, 0), 5: (4, 1), 6: (6, 0), 7: (None, None)}


def test_disputes_settle_whatever_comes(spark):
    schema = "dispute_id long, fact_id long, seq long, action string, severity string, assignee string, actor string, due_at timestamp, resolution string, fact_status string, at timestamp"
    step = lambda d, seq, action, severity=None, who=None: (d, d * 10, seq, action, severity, who, "me", None, None, None, None)
    commands = [
        step(1, 1, "comment"), step(1, 2, "open", "medium", "a"), step(1, 3, "open", "low"), step(1, 4, "escalate"), step(1, 5, "escalate"), step(1, 6, "escalate"), step(1, 7, "assign", None, "b"), step(1, 8, "assign", None, None),
        step(2, 1, "open", "odd"), step(2, 2, "escalate", "high"), step(2, 3, "escalate", ""), step(2, 4, "resolve"), step(2, 5, "resolve"), step(2, 6, "escalate"), step(2, 7, "comment"), step(2, 8, None),
        step(3, 1, "resolve"), step(4, 1, "open", None, "c"), step(4, 2, "escalate"),
    ]
    disputes, comments, reviews, rejects = curate.settle_disputes(spark.createDataFrame(commands, schema))
    got = {r.dispute_id: (r.status, r.severity, r.assignee, r.fact_status, r.n_comments) for r in disputes.collect()}
    assert got == {1: ("escalated", "critical", None, "contradicted", 0), 2: ("resolved", "critical", None, "contradicted", 1), 4: ("escalated", "medium", "c", "contradicted", 0)}
    assert sorted((r.dispute_id, r.seq) for r in rejects.collect()) == [(1, 1), (1, 3), (2, 5), (2, 6), (2, 8), (3, 1)]
    assert sorted((r.fact_id, r.action) for r in reviews.collect()) == [(10, "open_dispute"), (20, "open_dispute"), (20, "resolve_dispute"), (40, "open_dispute")]
    assert [r.comment_id for r in comments.collect()] == [7]
    empty = curate.settle_disputes(spark.createDataFrame([], schema))
    assert [df.count() for df in empty] == [0, 0, 0, 0] and curate.fold_disputes(spark.createDataFrame(commands, schema)).where(F.col("dispute_id") == 3).first().rejected == [1]


def test_history_computes_its_facts_once(spark):
    facts = spark.range(1, 7).select("id", F.lit("candidate").alias("status"), F.when(F.col("id") % 3 != 1, F.col("id") - 1).alias("supersedes_fact_id"))
    reviews = spark.createDataFrame([(1, 1, "a", "verify"), (9, 2, "a", "reject")], "fact_id long, seq long, reviewer string, action string")
    assignments = spark.createDataFrame([(2, 3, "b", "active")], "fact_id long, seq long, assignee string, status string")
    disputes = spark.createDataFrame([(3, 4, "low", "open")], "fact_id long, dispute_id long, severity string, status string")
    comments = spark.createDataFrame([(4, 5, "c", "said")], "dispute_id long, comment_id long, author string, comment string")
    got = curate.history_rows(facts, reviews, assignments, disputes, comments)
    kinds = {}
    for r in got.collect():
        kinds.setdefault(r.kind, set()).add((r.id, r.ref))
    assert kinds == {"review": {(1, 1)}, "assignment": {(2, 3)}, "dispute": {(3, 4)}, "dispute_comment": {(3, 5)}, "supersedes": {(2, 1), (3, 2), (5, 4), (6, 5)}, "superseded_by": {(1, 2), (2, 3), (4, 5), (5, 6)}, "chain": {(2, 1), (3, 1), (5, 4), (6, 4)}}
    assert "Range (" not in got._jdf.queryExecution().toString()
