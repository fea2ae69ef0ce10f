"""Governance on data: content inspection, classification, export decisions, approvals, policies, directory, encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.access import LEVELS, ROLES, may_export, rank_of
from .graph import shared_table

#: Our own default rules: (name, pattern, action, classification).
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "mask", "internal"),
    ("card", r"(?:^|[^0-9])[0-9]{16}(?:[^0-9]|$)", "block", "confidential"),
    ("secret", r"(?i)(?:password|secret|token|api_?key) *[:=] *[\"']?[A-Za-z0-9+/_.=-]{8,}", "block", "secret"),
]


def string_paths(df: DataFrame, key: str) -> DataFrame:
    """(key, path, text) of every string in df, in nested structs and arrays too."""
    def texts(kind: T.DataType, value: Column, path: Column) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(F.struct(path.alias("path"), value.alias("text")))
        if isinstance(kind, T.StructType):
            found = [x for f in kind if (x := texts(f.dataType, value[f.name], F.concat(path, F.lit(f".{f.name}")))) is not None]
            return F.concat(*found) if found else None
        if isinstance(kind, T.ArrayType):
            probe = texts(kind.elementType, F.lit(None), path)
            return None if probe is None else F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), lambda v, i: texts(kind.elementType, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return None

    parts = [x for f in df.schema if f.name != key and (x := texts(f.dataType, F.col(f"`{f.name}`"), F.lit(f.name))) is not None]
    return df.select(key, F.explode(F.concat(*parts)).alias("t")).select(key, "t.path", "t.text").where("text IS NOT NULL")


def inspect(texts: DataFrame, rules: list[tuple[str, str, str, str]] = RULES, most: int = 5) -> DataFrame:
    """(rule, action, classification, matches, paths) of (key, path, text): matches over all texts and the first paths with one.

    Each rule is one pattern count, made once and written; counts are summed in each task first, and only `most` paths a rule
    are kept there too."""
    key = [c for c in texts.columns if c not in ("path", "text")]
    counted = texts.select(*key, "path", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(a).alias("action"), F.lit(c).alias("classification"), F.regexp_count("text", F.lit(p)).alias("n")) for n, p, a, c in rules))).alias("r")).select(*key, "path", "r.*").where("n > 0")
    counted = shared_table(counted)
    totals = counted.groupBy("rule", "action", "classification").agg(F.sum("n").alias("matches"))
    where = F.concat_ws(":", *(F.col(k).cast("string") for k in key), "path")
    first = counted.withColumn("_nth", F.row_number().over(Window.partitionBy("rule").orderBy(*key, "path"))).where(F.col("_nth") <= most)
    listed = first.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", where.alias("where")))), lambda x: x["where"]).alias("paths"))
    return totals.join(listed, "rule")


def classify(rows: DataFrame, group: str, level: str = "confidentiality") -> DataFrame:
    """(group, levels, max_level) of a payload's rows."""
    name = F.when(rank_of(F.col(level), LEVELS) >= 0, F.lower(level)).otherwise("internal")
    top = F.element_at(F.array(*(F.lit(n) for n in LEVELS)), F.max(rank_of(name, LEVELS)) + 1)
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(name)).alias("levels"), top.alias("max_level"))


def export_decisions(requests: DataFrame) -> DataFrame:
    """requests (role, max_level, blocked) with allowed and reason."""
    allowed = may_export(F.col("max_level"), F.col("role"), F.col("blocked"))
    reason = F.when(F.coalesce("blocked", F.lit(False)), "blocked_by_rule").when(allowed, "allowed").otherwise("role_below_level")
    return requests.withColumns({"allowed": allowed, "reason": reason})


def payload_hash(rows: DataFrame, group: str) -> DataFrame:
    """(group, payload_hash): SHA-256 of the sorted hashes of the rows, whose columns are taken by name; the order of rows does not
    count. A payload is one export, whose rows are few."""
    names = sorted(c for c in rows.columns if c != group)
    one = F.sha2(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ""), 256).alias("payload_hash"))


APPROVAL_KEYS = ("requester", "action", "export_format", "object_type", "object_id", "payload_hash")


def review_approvals(approvals: DataFrame, commands: DataFrame) -> DataFrame:
    """Approvals after commands (seq, id, decision approved or rejected): the first decision on a pending one counts."""
    first = commands.where(F.col("decision").isin("approved", "rejected")).groupBy("id").agg(F.min_by("decision", "seq").alias("_decision"))
    out = approvals.join(first, "id", "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("_decision").isNotNull(), F.col("_decision")).otherwise(F.col("status"))).select(*approvals.columns)


def consume_approvals(approvals: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approvals, outcomes) for uses (seq, id, the six keys, at): an approved, unexpired approval whose keys all agree is consumed by
    its first use; other uses get a reason."""
    theirs = approvals.select("id", "status", "expires_at", *(F.col(k).alias(f"_{k}") for k in APPROVAL_KEYS))
    same = F.lit(True)
    for k in APPROVAL_KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    told = uses.join(theirs, "id", "left").withColumn("_reason", F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "used", "already_used").when(F.col("status") != "approved", "not_approved").when(F.col("expires_at") <= F.col("at"), "expired").when(~same, "mismatch"))
    nth = F.row_number().over(Window.partitionBy("id", F.col("_reason").isNull()).orderBy("seq"))
    told = told.withColumn("_nth", nth)
    reason = F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(F.col("_nth") > 1, "already_used").otherwise("used")
    outcomes = told.select(*uses.columns, reason.alias("outcome"))
    used = outcomes.where("outcome = 'used'").select("id", F.col("at").alias("_at"))
    after = approvals.join(used, "id", "left")
    after = after.withColumns({"status": F.when(F.col("_at").isNotNull(), "used").otherwise(F.col("status")), "consumed_at": F.coalesce("_at", "consumed_at")})
    return after.select(*approvals.columns), outcomes


def policy_decisions(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests (action, role) with allowed and reason, by policies (action, roles); an action without a policy is refused."""
    joined = requests.join(policies.select("action", F.col("roles").alias("_roles")), "action", "left")
    allowed = F.coalesce(F.array_contains("_roles", F.col("role")), F.lit(False))
    return joined.withColumns({"allowed": allowed, "reason": F.when(F.col("_roles").isNull(), "unknown_action").when(allowed, "role_allowed").otherwise("role_not_allowed")}).drop("_roles")


def log_page(log: DataFrame, limit: int = 500, order: str = "created_at", **equal: object) -> DataFrame:
    """The newest rows of a log that meet the given equalities, 500 at most."""
    for name, value in equal.items():
        if value is not None:
            log = log.where(F.col(name) == value)
    return log.orderBy(F.col(order).desc(), *(F.col(c).desc() for c in log.columns if c == "id")).limit(min(limit, 500))


def append_audit(rows: DataFrame, path: str) -> None:
    """Appends actions to an audit table, a folder for each day."""
    rows.withColumn("date", F.to_date("created_at")).write.mode("append").partitionBy("date").parquet(path)


PREFIX = "enc:v1:"


def encrypt(value: Column, key: Column) -> Column:
    """A value sealed with AES-GCM, bound to the prefix; sealed and null values stay as they are."""
    sealed = F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.lit(PREFIX).cast("binary"))))
    return F.when(value.isNull() | value.startswith(PREFIX), value).otherwise(sealed)


def decrypt(value: Column, key: Column | None) -> Column:
    """The plain value; a placeholder without the key; unsealed values stay as they are."""
    if key is None:
        return F.when(value.startswith(PREFIX), F.lit("[ENCRYPTED]")).otherwise(value)
    plain = F.aes_decrypt(F.unbase64(F.substring(value, len(PREFIX) + 1, 1 << 30)), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(PREFIX).cast("binary")).cast("string")
    return F.when(value.startswith(PREFIX), plain).otherwise(value)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): created, updated, unchanged or missing, of a directory snapshot against the stored table."""
    columns = sorted(c for c in new.columns if c != key)
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(name))
    both = digest(old, "_old").join(digest(new, "_new"), key, "full")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "missing").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return both.select(key, change.alias("change"))


def sync_users(users: DataFrame, snapshot: DataFrame, as_of: Column, deactivate_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(users, rejects) after upserting a snapshot (id, user_name, role, department, active) into users (also deactivated_at). Unknown
    roles are rejected; the first time of deactivation is kept; missing users may be deactivated."""
    fields = ("user_name", "role", "department", "active")
    good = snapshot.where(F.lower("role").isin(*ROLES)).withColumn("role", F.lower("role"))
    rejects = snapshot.where(~F.coalesce(F.lower("role").isin(*ROLES), F.lit(False))).withColumn("reason", F.lit("unknown role"))
    new = good.select("id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_there"))
    both = users.join(new, "id", "full")
    values = {c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    if deactivate_missing:
        values["active"] = F.when(F.col("_there"), F.col("_active")).otherwise(F.lit(False))
    out = both.withColumns(values).withColumn("deactivated_at", F.when(F.col("active"), F.lit(None)).otherwise(F.coalesce("deactivated_at", as_of)))
    return out.select(*users.columns), rejects


def replace_members(members: DataFrame, commands: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, rejects) after each group of commands (group_id, user_id) got exactly those users; unknown users are rejected."""
    known = commands.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi").select("group_id", "user_id").distinct()
    rejects = commands.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    kept = members.join(commands.select("group_id").distinct(), "group_id", "left_anti").select("group_id", "user_id")
    return kept.unionByName(known), rejects


def apply_group_commands(groups: DataFrame, members: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, members, rejects) after commands (seq, action upsert or delete, group_id, display_name, role, external_id) on groups (id, display_name, role,
    external_id) and members (group_id, user_id), in the order of seq.

    A group goes by its id, else its name, else its external id; its name is its id where it has none; its role must be known, if it has one. A
    deletion needs a group that is there at that time, and takes its members, who do not come back with a later upsert. All other commands are rejected."""
    named = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    key = F.coalesce(named("group_id"), F.when(F.col("action") == "upsert", F.coalesce(named("display_name"), named("external_id"))))
    told = commands.withColumns({"_id": key, "_role": F.lower(F.trim("role"))})
    fits = F.coalesce((F.col("action") == "delete") | ((F.col("action") == "upsert") & (F.coalesce("_role", F.lit("")).isin("", *ROLES))), F.lit(False)) & F.col("_id").isNotNull()
    there = groups.select(F.col("id").alias("_id"), F.lit(True).alias("_there"))
    # a deletion finds what the last upsert or deletion before it has left
    before = told.where(fits).join(there, "_id", "left").withColumn("_before", F.lag("action").over(Window.partitionBy("_id").orderBy("seq")))
    valid = before.where((F.col("action") == "upsert") | F.coalesce(F.col("_before") == "upsert", F.col("_there"), F.lit(False)))
    last = valid.groupBy("_id").agg(F.max_by(F.struct("action", F.coalesce(named("display_name"), F.col("_id")).alias("display_name"), F.when(F.col("_role") != "", F.col("_role")).alias("role"), "external_id"), "seq").alias("_c"), F.bool_or(F.col("action") == "delete").alias("_gone"))
    both = groups.join(last.withColumnRenamed("_id", "id"), "id", "full").where(F.col("_c").isNull() | (F.col("_c.action") == "upsert"))
    new = F.col("_c").isNotNull()
    out = both.select("id", *(F.when(new, F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) for c in ("display_name", "role", "external_id")))
    kept = members.join(last.where("_gone").select(F.col("_id").alias("group_id")), "group_id", "left_anti")
    return out, kept.select(*members.columns), commands.join(valid.select("seq"), "seq", "left_anti").withColumn("reason", F.lit("no such group, no name, or unknown role or action"))


def find_users(users: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id) for asked names: by id, else user_name, else external_id."""
    hits = None
    for place, column in enumerate(("id", "user_name", "external_id")):
        one = asked.join(users.select("id", F.col(column).alias("asked")), "asked").select("asked", "id", F.lit(place).alias("place"))
        hits = one if hits is None else hits.unionByName(one)
    return hits.groupBy("asked").agg(F.min_by("id", F.struct("place", "id")).alias("id"))


def effective_roles(users: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(id, role) of active users: the highest valid role of their own and their groups'; users without one are left out."""
    active = users.where("active")
    own = active.select("id", "role")
    theirs = members.join(groups.select(F.col("id").alias("group_id"), "role"), "group_id").select(F.col("user_id").alias("id"), "role").join(active.select("id"), "id", "left_semi")
    ranked = own.unionByName(theirs).withColumn("rank", rank_of(F.col("role"), ROLES)).where("rank >= 0")
    return ranked.groupBy("id").agg(F.max_by(F.lower("role"), "rank").alias("role"))


def claim_keys(claim: Column) -> Column:
    """The forms in which a group claim may be mapped: itself, its tail after / or \\, and its CN."""
    tail, cn = F.regexp_extract(claim, r"[/\\]([^/\\]+)$", 1), F.regexp_extract(claim, r"(?i)cn=([^,]+)", 1)
    return F.filter(F.array_distinct(F.transform(F.array(claim, tail, cn), lambda c: F.lower(F.trim(c)))), lambda c: c != "")


def roles_of_claims(claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """(user_id, role): the highest role that a user's group claims map to (mapping: claim, role)."""
    keyed = claims.select("user_id", F.explode(claim_keys(F.col("claim"))).alias("_key"))
    named = mapping.select(F.lower(F.trim("claim")).alias("_key"), F.lower("role").alias("role")).distinct()
    return keyed.join(named, "_key").withColumn("rank", rank_of(F.col("role"), ROLES)).where("rank >= 0").groupBy("user_id").agg(F.max_by("role", "rank").alias("role"))
