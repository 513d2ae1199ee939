"""Text expressions: clean-up, entity decoding, links, hashes, skills in text."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The keywords looked for in postings, and the cue words of a line.
SKILL_KEYWORDS = [
    "java", "python", "javascript", "typescript", "go", "golang", "rust", "c++", "c#",
    "react", "vue", "angular", "node", "nodejs", "express", "spring", "django", "flask",
    "postgresql", "mysql", "mongodb", "redis", "elasticsearch",
    "docker", "kubernetes", "aws", "gcp", "azure", "terraform",
    "git", "ci/cd", "jenkins", "github actions",
    "rest", "graphql", "grpc", "api",
    "linux", "bash", "shell",
    "machine learning", "ml", "ai", "deep learning", "tensorflow", "pytorch",
    "sql", "nosql", "database",
    "microservices", "distributed systems",
    "agile", "scrum",
]
REQUIRED_CUES = ["required", "must have", "must be", "essential", "mandatory"]
PREFERRED_CUES = ["preferred", "nice to have", "bonus", "plus", "desired", "ideal"]

# Titles counted as internships; link prefixes that are not an employer's own.
INTERNSHIP_MARKS = ["intern", "co-op", "coop"]
AGGREGATOR_LINKS = ["simplify.jobs/p/", "simplify.jobs/c/"]

# Entities decoded without leaving the JVM; anything else goes to one vectorised function.
COMMON_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&nbsp;": "\u00a0"}

WORD = "[0-9A-Za-z_]"
# Everything up to the blank counts as white space when skills and texts are trimmed.
CONTROL = "".join(chr(code) for code in range(0x21))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trim_space(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    """Tags become blanks and blanks collapse; entities stay as they are."""
    return collapse_spaces(F.regexp_replace(text, "<[^>]*>", " "))


def _unescape_udf():
    # Made inside a function so that it travels to executors which lack this package.
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(unescape, StringType())


def unescape_entities(text: Column) -> Column:
    """Decode HTML entities. Only texts holding an uncommon entity are sent to Python."""
    simple = text
    for entity, character in COMMON_ENTITIES.items():
        simple = F.replace(simple, F.lit(entity), F.lit(character))
    simple = F.replace(simple, F.lit("&amp;"), F.lit("&"))
    common = "|".join(["&amp;", *COMMON_ENTITIES])
    uncommon = F.regexp_replace(text, common, "").rlike("&#?[0-9A-Za-z]")
    # The Python side sees null for every other row, so little is transferred.
    decoded = _unescape_udf()(F.when(uncommon, text))
    return F.when(uncommon, decoded).otherwise(simple)


def unescape_common(text: Column) -> Column:
    """As ``unescape_entities`` but for the common entities only, all in the JVM."""
    for entity, character in COMMON_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def drop_markup(text: Column) -> Column:
    """Line breaks become a comma, other tags vanish: a table cell before entity decoding."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", ", "), "<[^>]+>", "")


def tidy_cell(text: Column) -> Column:
    """Drop the flame sign and collapse white space: a table cell after entity decoding."""
    return collapse_spaces(F.replace(text, F.lit("🔥"), F.lit("")))


def clean_cell(text: Column) -> Column:
    return tidy_cell(unescape_entities(drop_markup(text)))


def links(text: Column) -> Column:
    """All absolute link targets of a text, still escaped."""
    return F.regexp_extract_all(text, F.lit('href="(https?://[^"]+)"'), F.lit(1))


def apply_link(text: Column) -> Column:
    """The first link that is not an aggregator's own page, or ''."""

    def is_employer(link: Column) -> Column:
        kept = F.lit(True)
        for mark in AGGREGATOR_LINKS:
            kept = kept & ~link.contains(mark)
        return kept

    found = F.filter(F.transform(links(text), unescape_common), is_employer)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def contains_any(text: Column, marks: list[str]) -> Column:
    hit = F.lit(False)
    for mark in marks:
        hit = hit | text.contains(mark)
    return hit


def is_internship(title: Column) -> Column:
    return contains_any(F.lower(title), INTERNSHIP_MARKS)


def is_internship_posting(title: Column, commitment: Column) -> Column:
    return is_internship(title) | F.coalesce(F.lower(commitment).contains("intern"), F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def whole_word(keyword: str, sensible_edges: bool = False) -> str:
    """Pattern for a keyword with ASCII word edges.

    An edge beside a sign such as the ``+`` of ``c++`` asks for a word character there, as the
    plain edge rule has it; ``sensible_edges`` asks for none instead.
    """
    quoted = "".join(ch if ch.isalnum() or ch in " _/" else "\\" + ch for ch in keyword)
    first = keyword[0].isalnum() or keyword[0] == "_"
    last = keyword[-1].isalnum() or keyword[-1] == "_"
    none_before, none_after = f"(?<!{WORD})", f"(?!{WORD})"
    before = none_before if first or sensible_edges else f"(?<={WORD})"
    after = none_after if last or sensible_edges else f"(?={WORD})"
    return before + quoted + after


def keywords_in(text: Column, keywords: list[str], sensible_edges: bool = False) -> Column:
    """Sorted array of the keywords found in a lower-case text as whole words.

    All keywords of word characters only are looked for by one pattern, in one pass. For the others a plain search
    comes first, so the pattern is tried only where the keyword occurs at all.
    """
    plain = sorted(word for word in set(keywords) if re.fullmatch(f"{WORD}+", word))
    tests = [
        F.when(text.contains(word) & text.rlike(whole_word(word, sensible_edges)), F.lit(word))
        for word in sorted(set(keywords).difference(plain))
    ]
    none = F.array().cast("array<string>")
    signed = F.array_compact(F.array(*tests)) if tests else none
    # With a word edge on either side no two matches overlap, so each word of the text is met.
    pattern = f"(?<!{WORD})(?:{'|'.join(plain)})(?!{WORD})"
    found = F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), none) if plain else none
    return F.array_sort(F.concat(found, signed))


def skill_columns(
    description: Column,
    keywords: list[str] | None = None,
    required_cues: list[str] | None = None,
    preferred_cues: list[str] | None = None,
    sensible_edges: bool = False,
) -> Column:
    """A struct of the ``required`` and ``preferred`` skills of a posting, as sorted arrays.

    Each line counts for one side: required if it has a required cue or no cue at all, else
    preferred. Lines of a side are put together again, so each keyword is tested twice per
    posting, not once per line, and nothing needs to be shuffled.
    """
    keywords = SKILL_KEYWORDS if keywords is None else keywords
    required_cues = REQUIRED_CUES if required_cues is None else required_cues
    preferred_cues = PREFERRED_CUES if preferred_cues is None else preferred_cues

    def is_preferred(line: Column) -> Column:
        return ~contains_any(line, required_cues) & contains_any(line, preferred_cues)

    def by_line(text: Column) -> Column:
        lines = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), is_preferred(line).alias("soft")))
        return let(
            lines,
            lambda all_lines: F.struct(
                join_lines(F.filter(all_lines, lambda item: ~item["soft"])).alias("required"),
                join_lines(F.filter(all_lines, lambda item: item["soft"])).alias("preferred"),
            ),
        )

    def join_lines(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda item: item["line"]), "\n")

    def two_sides(text: Column) -> Column:
        # Without a preferred cue anywhere all lines are of the required side.
        whole = F.struct(text.alias("required"), F.lit("").alias("preferred"))
        return F.when(contains_any(text, preferred_cues), by_line(text)).otherwise(whole)

    def found(sides: Column) -> Column:
        return F.struct(
            keywords_in(sides["required"], keywords, sensible_edges).alias("required"),
            keywords_in(sides["preferred"], keywords, sensible_edges).alias("preferred"),
        )

    def without_required(both: Column) -> Column:
        return F.struct(
            both["required"].alias("required"),
            F.array_except(both["preferred"], both["required"]).alias("preferred"),
        )

    both = let(let(F.lower(description), two_sides), found)
    return let(both, without_required)


def strip_fence(text: Column) -> Column:
    """Remove a code fence: all of its first line and the closing marks. Null gives ``{}``."""

    def bare(trimmed: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(trimmed, r"\A[^\n]*\n", ""), r"```\z", "")
        return F.when(trimmed.startswith("```"), _trim_control(body)).otherwise(trimmed)

    return F.coalesce(let(_trim_control(text), bare), F.lit("{}"))


def strip_fence_marks(text: Column) -> Column:
    """As ``strip_fence`` but only the marks and a language name are removed."""

    def bare(trimmed: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(trimmed, r"\A```[a-zA-Z]*\n?", ""), r"```\z", "")
        return F.when(trimmed.startswith("```"), _trim_control(body)).otherwise(trimmed)

    return F.coalesce(let(_trim_control(text), bare), F.lit("{}"))


def _trim_control(text: Column) -> Column:
    """Trim everything up to the blank (U+0020) from both ends."""
    return F.btrim(text, F.lit(CONTROL))


def normal_skills(skills: Column) -> Column:
    """Lower-case, trimmed, distinct skills without blanks; null gives an empty array."""
    kept = F.filter(
        F.transform(skills, lambda skill: _trim_control(F.lower(skill))),
        lambda skill: skill.isNotNull() & (skill != ""),
    )
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


# Codes for the marks that part packed texts; % first, so that no code is coded again.
PACKING = {"%": "%25", "|": "%7C", "~": "%7E"}


def escaped(text: Column) -> Column:
    for mark, code in PACKING.items():
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for mark, code in reversed(PACKING.items()):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def packed_skills(skills: Column) -> Column:
    """Skills in normal form as one escaped text, a fraction of the list's bytes in a shuffle."""
    return F.array_join(F.transform(skills, escaped), "|")


def unpacked_skills(packed: Column) -> Column:
    """The list that ``packed_skills`` was given."""
    listed = F.transform(F.split(packed, "[|]"), unescaped)
    return F.when(packed == "", F.array().cast("array<string>")).otherwise(listed)


def packed_texts(*texts: Column) -> Column:
    """Escaped texts in one; a lone % stands for null."""
    return F.concat_ws("~", *[F.coalesce(text, F.lit("%")) for text in texts])


def unpacked_texts(packed: Column) -> Column:
    """The texts that ``packed_texts`` was given, still escaped, as a list."""
    return F.transform(F.split(packed, "~"), lambda text: F.nullif(text, F.lit("%")))


def keyword_match(skills: Column, text: Column) -> Column:
    """Percentage of (normalised) skills found in the text as substrings; an empty side gives 0."""
    def share(inputs: Column) -> Column:
        wanted, lowered = inputs["skills"], inputs["text"]
        found = F.size(F.filter(wanted, lambda skill: F.contains(lowered, skill)))
        percentage = F.floor(found / F.greatest(F.size(wanted), F.lit(1)) * 100.0 + 0.5).cast("int")
        empty = wanted.isNull() | (F.size(wanted) == 0) | lowered.isNull() | (_trim_control(lowered) == "")
        return F.when(empty, F.lit(0)).otherwise(percentage)

    return let(F.struct(skills.alias("skills"), F.lower(text).alias("text")), share)
