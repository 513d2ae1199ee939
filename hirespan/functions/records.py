"""Parsing stored model responses: one JSON text per row into typed columns.

Every parser takes a table with a ``response`` column and returns ``(records, rejects)``.
Numbers may be given as numbers or as text; what cannot be read takes the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirespan.functions.scoring import rank_tier
from hirespan.functions.text import let, strip_fence, strip_fence_marks
from hirespan.operators.skew import with_value

# Defaults for missing fields.
DEFAULT_SCORE = 50
DEFAULT_VERDICT = "Analysis complete."
DEFAULT_ROAST = "Failed to generate roast. Your resume broke the AI. That's... actually impressive."


def to_variant(text: Column) -> Column:
    """The parsed text; blank counts as an empty object and broken text gives null."""
    return let(text, lambda t: F.try_parse_json(F.when(F.trim(t) == "", F.lit("{}")).otherwise(t)))


def read_number(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "double")


def read_score(node: Column, path: str) -> Column:
    """A whole number kept within 0..100; 50 if there is none."""
    value = F.coalesce(read_number(node, path), F.lit(float(DEFAULT_SCORE)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)).cast("int")


def is_container(node: Column) -> Column:
    kind = F.schema_of_variant(node)
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def read_text(node: Column, path: str, default: str) -> Column:
    """Text at ``path``: the default if there is none, '' for a list or an object."""

    def shown(text: Column) -> Column:
        nested = text.rlike(r"\A[\[{]") & is_container(F.try_variant_get(node, path, "variant"))
        return F.when(text.isNull(), default).when(nested, "").otherwise(text)

    return let(F.try_variant_get(node, path, "string"), shown)


def element_text(node: Column) -> Column:
    """Text of a list element: nested values give '' and null gives ``null``."""

    def shown(text: Column) -> Column:
        # Looking at the kind is costly, so only texts which look nested are looked at.
        nested = text.rlike(r"\A[\[{]") & is_container(node)
        return F.when(text.isNull(), "null").when(nested, "").otherwise(text)

    return let(F.try_variant_get(node, "$", "string"), shown)


def read_list(node: Column, path: str) -> Column:
    """A list of texts; anything but a list gives an empty one."""
    items = F.try_variant_get(node, path, "array<variant>")
    return F.coalesce(F.transform(items, element_text), F.array().cast("array<string>"))


def read_score_map(node: Column, path: str) -> Column:
    entries = F.try_variant_get(node, path, "map<string,variant>")
    return F.coalesce(
        F.transform_values(entries, lambda _, value: read_score(value, "$")),
        F.create_map().cast("map<string,int>"),
    )


def read_sections(node: Column, path: str) -> Column:
    """The entries of an object, each a list of texts or a text; null if there is no object."""

    def section(value: Column) -> Column:
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), element_text)
        return F.struct(F.when(items.isNull(), read_text(value, "$", "")).alias("text"), items.alias("items"))

    entries = F.try_variant_get(node, path, "map<string,variant>")
    return F.transform_values(entries, lambda _, value: section(value))


def read_objects(node: Column, path: str, build, schema: str) -> Column:
    items = F.try_variant_get(node, path, "array<variant>")
    return F.coalesce(F.transform(items, build), F.array().cast(schema))


def _split(responses: DataFrame, cleaned: Column) -> tuple[DataFrame, DataFrame]:
    parsed = with_value(responses, "_node", to_variant(cleaned))
    good = parsed.where(F.col("_node").isNotNull())
    bad = parsed.where(F.col("_node").isNull()).drop("_node").withColumn("reason", F.lit("unreadable response"))
    return good, bad


def parse_analyses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resume analyses with scores, lists, bullet feedback and the recruiter's view."""
    good, bad = _split(responses, strip_fence(F.col("response")))
    node = F.col("_node")

    def bullet(item: Column) -> Column:
        return F.struct(
            read_text(item, "$.original", "").alias("original"),
            read_score(item, "$.score").alias("score"),
            read_text(item, "$.issue", "").alias("issue"),
            read_text(item, "$.improved", "").alias("improved"),
        )

    def section(item: Column) -> Column:
        return F.struct(
            read_text(item, "$.section", "").alias("section"),
            read_text(item, "$.grade", "").alias("grade"),
            read_text(item, "$.comment", "").alias("comment"),
            read_list(item, "$.red_flags").alias("red_flags"),
        )

    records = good.select(
        *[c for c in responses.columns if c != "response"],
        read_score(node, "$.overall_score").alias("overall_score"),
        read_score(node, "$.ats_score").alias("ats_score"),
        read_list(node, "$.ats_issues").alias("ats_issues"),
        read_score_map(node, "$.section_scores").alias("section_scores"),
        read_objects(
            node,
            "$.bullet_feedback",
            bullet,
            "array<struct<original:string,score:int,issue:string,improved:string>>",
        ).alias("bullet_feedback"),
        read_list(node, "$.strengths").alias("strengths"),
        read_list(node, "$.improvements").alias("improvements"),
        read_text(node, "$.summary_verdict", DEFAULT_VERDICT).alias("summary_verdict"),
        read_sections(node, "$.ats_parsed_sections").alias("ats_parsed_sections"),
        read_objects(
            node,
            "$.recruiter_take",
            section,
            "array<struct<section:string,grade:string,comment:string,red_flags:array<string>>>",
        ).alias("recruiter_take"),
    )
    return records, bad


def parse_fits(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resume-to-job fits."""
    good, bad = _split(responses, strip_fence(F.col("response")))
    node = F.col("_node")
    records = good.select(
        *[c for c in responses.columns if c != "response"],
        read_score(node, "$.fit_score").alias("fit_score"),
        read_list(node, "$.matched_skills").alias("matched_skills"),
        read_list(node, "$.missing_skills").alias("missing_skills"),
        read_text(node, "$.fit_summary", DEFAULT_VERDICT).alias("fit_summary"),
    )
    return records, bad


def parse_profiles(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resume profiles. An unreadable response still gives an (empty) profile, and a reject row."""
    parsed = with_value(responses, "_node", to_variant(strip_fence_marks(F.col("response"))))
    node = F.col("_node")
    number = read_number(node, "$.yearsExperience")
    given = F.try_variant_get(node, "$.yearsExperience", "string").isNotNull()
    records = parsed.select(
        *[c for c in responses.columns if c != "response"],
        read_list(node, "$.skills").alias("skills"),
        # A value that is no number counts as 0 years; no value stays unknown.
        F.when(given, F.coalesce(number, F.lit(0.0)).cast("int")).alias("years_experience"),
        F.try_variant_get(node, "$.educationLevel", "string").alias("education_level"),
        F.lit("PARSED").alias("status"),
    )
    bad = parsed.where(node.isNull()).drop("_node").withColumn("reason", F.lit("unreadable response"))
    return records, bad


def parse_roasts(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roasts with a rank and its tier."""
    good, bad = _split(responses, F.coalesce("response", F.lit("")))
    node = F.col("_node")
    given = F.try_variant_get(node, "$.top_dog_rank", "variant").isNotNull()
    number = F.coalesce(read_number(node, "$.top_dog_rank"), F.lit(0.0))
    rank = F.when(given, F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)).cast("int")).otherwise(
        F.lit(DEFAULT_SCORE)
    )
    records = good.select(
        *[c for c in responses.columns if c != "response"],
        read_text(node, "$.brutal_roast_text", DEFAULT_ROAST).alias("roast_text"),
        read_list(node, "$.missing_dependencies").alias("missing_dependencies"),
        rank.alias("top_dog_rank"),
        rank_tier(rank).alias("tier_name"),
    )
    return records, bad
