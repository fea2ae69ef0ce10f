"""Row access, field masking and export rules as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import redact

#: Confidentiality levels and roles in rising order, and the highest level that a role may see or export.
LEVELS = ("public", "internal", "confidential", "secret")
ROLES = ("external_partner", "researcher", "analyst", "manager", "admin")
SEES = {"external_partner": "public", "researcher": "internal", "analyst": "confidential", "manager": "secret", "admin": "secret"}
EXPORTS = {"external_partner": "public", "researcher": "internal", "analyst": "confidential", "manager": "confidential", "admin": "secret"}


def rank_of(value: Column, names: Sequence[str]) -> Column:
    """The place of a name among names, from 0; -1 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))), F.lower(value)), F.lit(-1))


def level_of_role(role: Column, table: dict[str, str] = SEES) -> Column:
    """The rank of the highest level that a role may reach; -1 for an unknown role."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for r, level in table.items() for x in (r, LEVELS.index(level)))), F.lower(role)), F.lit(-1))


def may_see(confidentiality: Column, role: str, include_internal: bool = True) -> Column:
    """The confidentiality filter of a role, as a predicate that reaches the scan."""
    top = LEVELS.index(SEES[role]) if include_internal else 0
    return F.coalesce(confidentiality, F.lit("internal")).isin(*LEVELS[: top + 1])


def may_access(confidentiality: Column, departments: Column, projects: Column, min_clearance: Column, role: Column, department: Column, project: Column, clearance: Column) -> Column:
    """The attribute filter: level by role, then, but for admins, department and project lists and least clearance."""
    listed = lambda allowed, own: allowed.isNull() | (F.size(allowed) == 0) | F.coalesce(F.array_contains(F.transform(allowed, lambda a: F.lower(a)), F.lower(own)), F.lit(False))
    level = rank_of(F.coalesce(confidentiality, F.lit("internal")), LEVELS) <= level_of_role(role)
    cleared = min_clearance.isNull() | (rank_of(F.coalesce(clearance, role), ROLES) >= rank_of(min_clearance, ROLES))
    return level & ((F.lower(role) == "admin") | (listed(departments, department) & listed(projects, project) & cleared))


def may_export(level: Column, role: Column, blocked: Column | None = None) -> Column:
    """Whether a role may export content of a level; a blocking rule always denies."""
    allowed = (rank_of(level, LEVELS) >= 0) & (rank_of(level, LEVELS) <= level_of_role(role, EXPORTS))
    return allowed if blocked is None else allowed & ~F.coalesce(blocked, F.lit(False))


def mask_fields(df: DataFrame, role: str, cut_abstract: bool = False) -> DataFrame:
    """Masks columns by name, nested fields too: secret-like names always, paths and contacts but for admins and analysts;
    other text is redacted. With cut_abstract an abstract keeps its first 300 characters."""
    trusted = role in ("admin", "analyst")

    def mask(name: str, kind: T.DataType, value: Column) -> Column:
        low = name.lower()
        if any(w in low for w in ("password", "secret", "token", "api_key")):
            return F.when(value.isNotNull(), F.lit("[SECRET]"))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*(mask(f.name, f.dataType, value[f.name]).alias(f.name) for f in kind)))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda v: mask(name, kind.elementType, v))
        if not isinstance(kind, T.StringType):
            return value
        if low in ("path", "contact", "email", "phone") and not trusted:
            return F.when(value.isNotNull(), F.lit("[MASKED]"))
        out = redact(value, contacts=not trusted)
        return F.substring(out, 1, 300) if low == "abstract" and cut_abstract else out

    return df.select(*(mask(f.name, f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema))
