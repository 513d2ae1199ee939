"""Skills of postings and candidates over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from hirespan.functions.scoring import round_half_up
from hirespan.functions.text import let, normal_skills, skill_columns

# Category of each known skill, and the order categories are shown in.
SKILL_CATEGORIES = {
    "java": "Languages", "python": "Languages", "javascript": "Languages", "typescript": "Languages",
    "go": "Languages", "rust": "Languages", "c++": "Languages", "c#": "Languages", "sql": "Languages",
    "r": "Languages",
    "react": "Frameworks", "vue": "Frameworks", "angular": "Frameworks", "node": "Frameworks",
    "express": "Frameworks", "spring": "Frameworks", "django": "Frameworks", "flask": "Frameworks",
    "nextjs": "Frameworks", "next.js": "Frameworks",
    "docker": "Infrastructure", "kubernetes": "Infrastructure", "aws": "Infrastructure",
    "gcp": "Infrastructure", "azure": "Infrastructure", "terraform": "Infrastructure",
    "ci/cd": "Infrastructure", "jenkins": "Infrastructure", "linux": "Infrastructure",
    "postgresql": "Databases", "mysql": "Databases", "mongodb": "Databases", "redis": "Databases",
    "elasticsearch": "Databases", "nosql": "Databases",
    "rest": "Concepts", "graphql": "Concepts", "grpc": "Concepts", "microservices": "Concepts",
    "distributed systems": "Concepts", "agile": "Concepts", "machine learning": "Concepts",
    "ml": "Concepts", "ai": "Concepts",
}
CATEGORY_ORDER = ["Languages", "Frameworks", "Infrastructure", "Databases", "Concepts", "Other"]


def requirement_profiles(jobs: DataFrame, **options) -> DataFrame:
    """``job_id, required_skills, preferred_skills, extraction_method`` from ``description_text``."""
    found = skill_columns(F.col("description_text"), **options)
    return jobs.select("job_id", found.alias("_skills")).select(
        "job_id",
        F.col("_skills.required").alias("required_skills"),
        F.col("_skills.preferred").alias("preferred_skills"),
        F.lit("KEYWORD").alias("extraction_method"),
    )


def category_of(skill: Column, categories: dict[str, str] | None = None) -> Column:
    """Category of a skill by a small fixed table; ``Other`` if it has none."""
    pairs = (categories or SKILL_CATEGORIES).items()
    table = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(skill))), F.lit("Other"))


def skill_tree(
    rows: DataFrame, keys: list[str], categories: dict[str, str] | None = None
) -> DataFrame:
    """Wanted and matched skills per category, from three skill arrays of the same row.

    ``rows`` holds ``required_skills, preferred_skills, user_skills``. All is computed inside the
    row, so nothing is shuffled. Categories without a skill are left out.
    """

    def simple(name: str) -> Column:
        skills = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.transform(skills, lambda skill: F.lower(F.trim(skill)))

    wanted = F.array_union(simple("required_skills"), simple("preferred_skills"))

    def by_category(names: Column) -> Column:
        return F.transform(names, lambda skill: category_of(skill, categories))

    def both(sides: Column) -> Column:
        matched = F.array_intersect(sides["wanted"], sides["user"])
        return F.struct(by_category(sides["wanted"]).alias("wanted"), by_category(matched).alias("matched"))

    # Per row: the category of each wanted and of each matched skill.
    sides = let(F.struct(wanted.alias("wanted"), simple("user_skills").alias("user")), both)
    prepared = rows.withColumn("_sides", sides)
    total, hits = F.size("_sides.wanted"), F.size("_sides.matched")

    def count_of(side: str, category: str) -> Column:
        return F.size(f"_sides.{side}") - F.size(F.array_remove(f"_sides.{side}", category))

    def group(position: int, category: str) -> Column:
        return F.struct(
            F.lit(position).alias("category_position"),
            F.lit(category).alias("category"),
            count_of("wanted", category).alias("wanted"),
            count_of("matched", category).alias("matched"),
        )

    groups = F.array(*[group(position, category) for position, category in enumerate(CATEGORY_ORDER)])
    percentage = F.when(total > 0, round_half_up(hits / F.greatest(total, F.lit(1)) * 100.0)).otherwise(0)
    return (
        prepared.select(
            *keys,
            hits.alias("match_count"),
            total.alias("total_count"),
            percentage.alias("percentage"),
            F.explode(groups).alias("_group"),
        )
        .where("_group.wanted > 0")
        .select(*keys, "match_count", "total_count", "percentage", "_group.*")
    )


def _contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The skills of ``_asked`` that are somewhere in ``_text``; rows without one are left out."""
    kind = pa.list_(pa.binary())
    for batch in batches:
        rows = zip(batch.column("_asked").to_pylist(), batch.column("_text").to_pylist(), strict=True)
        found = [[skill for skill in asked if skill in text] for asked, text in rows]
        some = [k for k, hit in enumerate(found) if hit]
        ids = batch.column("job_id").take(pa.array(some, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([found[k] for k in some], kind)], ["job_id", "_found"])


def pair_match(pairs: DataFrame, profiles: DataFrame, jobs: DataFrame, chunks: int = 16) -> DataFrame:
    """Keyword match percentage for many ``(user_id, job_id)`` pairs, one row each.

    ``profiles`` is ``user_id, skills`` and ``jobs`` is ``job_id, description_text``. The distinct skills asked of
    a job are gathered first and looked for in its text once, however many users share them, in at most
    ``chunks`` rows a job; only those found are joined back to the pairs. A user or a job with very many pairs
    meets one row in either join, which Spark splits.
    """
    normal = profiles.select("user_id", normal_skills(F.col("skills")).alias("_skills"))
    wanted = pairs.select("user_id", "job_id").join(normal, "user_id", "left")
    asked = wanted.select("job_id", F.explode("_skills").alias("skill"))
    asked = asked.groupBy("job_id", F.pmod(F.xxhash64("skill"), F.lit(chunks)).alias("chunk")).agg(F.collect_set("skill").alias("_asked"))
    texts = jobs.select("job_id", F.lower("description_text").alias("_text"))
    # As bytes, which is what Spark's own search for substrings looks at.
    texts = texts.where("_text is not null").select("job_id", F.col("_text").cast("binary").alias("_text"))
    asked = asked.withColumn("_asked", F.transform("_asked", lambda skill: skill.cast("binary")))
    both = asked.join(texts, "job_id").select("_asked", "_text", "job_id")
    hits = both.mapInArrow(_contained, StructType([both.schema["job_id"]]).add("_found", ArrayType(BinaryType())))
    hits = hits.withColumn("_found", F.transform("_found", lambda skill: skill.cast("string")))
    hits = hits.groupBy("job_id").agg(F.flatten(F.collect_list("_found")).alias("_found"))
    none = F.array().cast("array<string>")
    total = F.size(F.coalesce("_skills", none))
    matched = F.size(F.array_intersect(F.coalesce("_skills", none), F.coalesce("_found", none)))
    share = F.floor(matched / F.greatest(total, F.lit(1)) * 100.0 + 0.5).cast("int")
    return wanted.join(hits, "job_id", "left").select("user_id", "job_id", share.alias("match_percentage"))
