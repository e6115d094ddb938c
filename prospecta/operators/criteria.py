"""Segments: declarative criteria and tag rules as column predicates.

Criteria are ``{"all": [...], "any": [...], "not": [...]}`` of ``{"field", "op", "value"}``.
They are validated whole before any plan is made; an unknown field, operator or value
shape is refused, never dropped.  One compiled predicate serves batch and stream.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import contactable

FIELDS = (
    "department_code", "region_code", "size_category", "sector_main", "best_email_confidence", "prospection_status",
    "quality_score", "relation_type", "lifecycle_stage", "naf", "tags", "has_email",
)
OPERATORS = ("eq", "neq", "gt", "lt", "gte", "lte", "in", "not_in", "is_null", "is_not_null", "contains_any")
#: Unknown on null, where a negation must keep the row.
NULL_SENSITIVE = ("eq", "in", "gt", "lt", "gte", "lte")
#: What a comparison needs to be joined for: flags that ``with_flags`` adds.
TAGS, HAS_EMAIL = "_tags", "_has_email"


class InvalidCriteria(ValueError):
    """Criteria that can't be compiled."""


def validate(criteria: dict[str, Any]) -> None:
    if not isinstance(criteria, dict) or set(criteria) - {"all", "any", "not"}:
        raise InvalidCriteria(f"unknown blocks in {criteria!r}")
    for block, conditions in criteria.items():
        if not isinstance(conditions, list):
            raise InvalidCriteria(f"{block} is not a list")
        for c in conditions:
            field, op, value = (c.get(k) for k in ("field", "op", "value")) if isinstance(c, dict) else (None, None, None)
            if field not in FIELDS:
                raise InvalidCriteria(f"unknown field {field!r}")
            if op not in OPERATORS:
                raise InvalidCriteria(f"unknown operator {op!r}")
            if op in ("in", "not_in") and not isinstance(value, list):
                raise InvalidCriteria(f"{op} needs a list")
            if field == "has_email" and op != "eq":
                raise InvalidCriteria("has_email knows eq only")


def condition(field: str, op: str, value: Any) -> Column:
    """A condition's positive predicate."""
    if field == "tags":
        slugs = [v for v in value if isinstance(v, str)] if op == "contains_any" and isinstance(value, list) else []
        wanted = F.array(*map(F.lit, slugs)) if slugs else None
        return F.coalesce(F.arrays_overlap(F.col(TAGS), wanted), F.lit(False)) if slugs else F.lit(False)
    if field == "has_email":
        return F.col(HAS_EMAIL) if value else ~F.col(HAS_EMAIL)
    c = F.col(field)
    return {
        "eq": lambda: c == value,
        "neq": lambda: (c != value) | c.isNull(),
        "gt": lambda: c > value,
        "lt": lambda: c < value,
        "gte": lambda: c >= value,
        "lte": lambda: c <= value,
        "in": lambda: c.isin(value) if value else F.lit(False),
        "not_in": lambda: ~c.isin(value) | c.isNull() if value else F.lit(True),
        "is_null": lambda: c.isNull(),
        "is_not_null": lambda: c.isNotNull(),
        "contains_any": lambda: F.lit(False),
    }[op]()


def compile_criteria(criteria: dict[str, Any]) -> Column:
    """One predicate: all of all, any of any (an empty any asks for nothing), none of not."""
    validate(criteria)
    made = lambda c: condition(c["field"], c["op"], c.get("value"))
    parts = [made(c) for c in criteria.get("all", [])]
    if criteria.get("any"):
        parts.append(reduce(Column.__or__, [made(c) for c in criteria["any"]]))
    parts += [~F.coalesce(made(c), F.lit(False)) if c["op"] in NULL_SENSITIVE else ~made(c) for c in criteria.get("not", [])]
    return reduce(Column.__and__, parts, F.lit(True))


def fields_of(criteria: dict[str, Any]) -> set[str]:
    return {c["field"] for block in criteria.values() for c in block}


def with_flags(companies: DataFrame, contacts: DataFrame, company_tag: DataFrame, fields: set[str]) -> DataFrame:
    """Companies with the columns that conditions on tags and addresses read; only what is asked for is joined."""
    if "has_email" in fields:
        reachable = contacts.where(contactable(F.col("email_status"))).select(F.col("company_id").alias("_cid")).distinct()
        companies = companies.join(reachable, companies["id"] == reachable["_cid"], "left").withColumn(HAS_EMAIL, F.col("_cid").isNotNull() | F.col("email_generic").isNotNull()).drop("_cid")
    if "tags" in fields:
        tags = company_tag.groupBy("company_id").agg(F.collect_set("slug").alias(TAGS)).withColumnRenamed("company_id", "_tid")
        companies = companies.join(tags, companies["id"] == tags["_tid"], "left").drop("_tid")
    return companies


def segment(companies: DataFrame, contacts: DataFrame, company_tag: DataFrame, criteria: dict[str, Any]) -> DataFrame:
    """The companies of an audience."""
    validate(criteria)
    return with_flags(companies, contacts, company_tag, fields_of(criteria)).where(compile_criteria(criteria)).drop(TAGS, HAS_EMAIL)


def audience_members(segment_: DataFrame, contacts: DataFrame, audience_id: int) -> DataFrame:
    """One row for each contact that can be written to, or one without contact for a company that has none."""
    people = contacts.where(contactable(F.col("email_status"))).select(F.col("company_id").alias("_cid"), F.col("id").alias("contact_id"))
    return segment_.select("id", "workspace_id").join(people, F.col("id") == F.col("_cid"), "left").select(F.lit(audience_id).alias("audience_id"), F.col("id").alias("company_id"), "contact_id", "workspace_id")


def many_audiences(companies: DataFrame, contacts: DataFrame, company_tag: DataFrame, audiences: dict[int, dict]) -> DataFrame:
    """(company_id, audience_id) for many audiences in one pass over the companies."""
    fields = set().union(*(fields_of(c) for c in audiences.values()))
    flagged = with_flags(companies, contacts, company_tag, fields)
    hits = F.array_compact(F.array(*[F.when(compile_criteria(c), F.lit(i)) for i, c in audiences.items()]))
    return flagged.select(F.col("id").alias("company_id"), F.explode(hits).alias("audience_id"))


# --- tag rules: another operator alphabet, unknown operators never match


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def rule_condition(rule: dict[str, Any]) -> Column:
    """Paths go into JSON columns: ``signals.recent[0].kind``."""
    path, op, value = rule.get("field", ""), rule.get("op", "="), rule.get("value")
    head, *rest = re.split(r"\.|(?=\[)", path.strip(".[]") + ("]" if path.endswith("]") else ""), maxsplit=1)
    c = F.get_json_object(F.col(head), "$" + (rest[0] if rest[0].startswith("[") else "." + rest[0])) if rest else F.col(head)
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    same = lambda: _number(c) == float(value) if numeric else (c.isNull() if value is None else c.cast("string") == str(value))
    text = c.cast("string")
    if op == "regex":
        body, _, flags = str(value)[1:].rpartition(str(value)[:1] or "/")
        return F.coalesce(text.rlike(f"(?{''.join(f for f in flags if f in 'imsx')}){body}" if flags else body), F.lit(False))
    tests = {
        "=": same,
        "!=": lambda: ~F.coalesce(same(), F.lit(False)),
        ">": lambda: _number(c) > float(value),
        ">=": lambda: _number(c) >= float(value),
        "<": lambda: _number(c) < float(value),
        "<=": lambda: _number(c) <= float(value),
        "in": lambda: text.isin([str(v) for v in value]) if isinstance(value, list) and value else F.lit(False),
        "starts_with": lambda: text.startswith(str(value)),
        "ends_with": lambda: text.endswith(str(value)),
        "contains": lambda: F.contains(text, F.lit(str(value))),
    }
    return F.coalesce(tests[op](), F.lit(False)) if op in tests else F.lit(False)


def compile_rule(rules: dict[str, Any]) -> Column:
    """``all`` goes before ``any``; without either the rule is one condition."""
    if isinstance(rules.get("all"), list):
        return reduce(Column.__and__, map(rule_condition, rules["all"]), F.lit(True))
    if isinstance(rules.get("any"), list):
        return reduce(Column.__or__, map(rule_condition, rules["any"]), F.lit(False))
    return rule_condition(rules)


def apply_rules(companies: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """(company_id, slug) for each tag whose rule a company meets, in one pass."""
    slugs = F.array_compact(F.array(*[F.when(compile_rule(r), F.lit(s)) for s, r in rules.items()]))
    return companies.select(F.col("id").alias("company_id"), F.explode(slugs).alias("slug"))
