"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each row of ``Rule`` names a measure, the counts it divides, and its bounds. ``measured`` adds the
counts, ``judged`` the verdict; both are narrow projections, so no text is shuffled.

Defined results: a null text has no words and fails the base rules; so does an empty one. Rows are
judged one by one, so repeated rows get equal verdicts, an empty table gives an empty table, and
columns of the input are carried on unless they bear the name of a result, which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirespan.llm.tables import set_aside

SPACE = "\\x20\\x09-\\x0D"
# Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "a an and are as at be by for from he in is it not of on or she that the this to was were what when which with you "
    "au aux avec ce dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui se son sur un une "
    "aber als auch auf aus bei das dem den der des die ein eine einen er es für im in ist mit nicht oder sich sie und "
    "von war wie wird zu zum zur "
    "al como con de del el ella en entre es esta este la las lo los más no o para pero por que se sin su sus un una y ya"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= part / whole <= high``; a whole of 0 counts as 1."""

    name: str
    part: str
    whole: str
    low: float = 0.0
    high: float = float("inf")


#: The threshold table in use. Counts are those of ``measured``.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("loud_words", "n_loud", "n_words", high=0.2),
    Rule("stop_words", "n_stop", "n_words", low=0.06),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.6),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.45),
)
MIN_WORDS = 50
MOST_REPEATED = 50  # per cent
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_loud", "n_stop")


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns worked out once per row: a generator keeps projections below it apart."""
    named = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.select("*", F.inline(F.array(named)))


def _count(pattern: str, text: Column) -> Column:
    """Characters of ``text`` outside of ``pattern``'s matches are what is left."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``COUNTS`` (long) beside its columns.

    Words are runs of other than white space (bytes 9 to 13 and 32). ``n_repeat_words`` counts words in
    windows of three that occur twice or more. Windows are compared by a 64-bit hash. Only a text with
    equal hashes has its (hash, position) pairs sorted, as one long each; each position kept then adds the words that the
    one before it does not cover yet.
    """
    docs, back = set_aside(docs.drop(*COUNTS), {"_words", "_lines", "_windows", "_bits", "_low", "_pairs", "_found"})
    plain = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(plain, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(plain, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    step = once(docs, _words=words, _lines=lines)
    n = F.size("_words")
    windows = F.when(
        n > 2,
        F.transform(
            F.slice("_words", 1, n - 2),
            lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    stop = sorted({form for word in STOP_WORDS for form in (word, word.capitalize())})
    step = once(
        step,
        n_words=n.cast("long"),
        word_chars=F.length(F.regexp_replace(plain, f"[{SPACE}]+", "")).cast("long"),
        n_symbols=_count("[#*$%&|<>]+", plain).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_loud=_count("[!?]+", plain).cast("long"),
        n_stop=F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long"),
        _windows=windows,
    ).drop("_words", "_lines")
    # A pair is one long: the hash's upper bits, and the position in as many lower bits as it needs.
    bits = F.length(F.bin(F.size("_windows")))
    step = once(step, _bits=bits, _low=F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    pairs = F.sort_array(
        F.transform("_windows", lambda h, i: h.bitwiseAND(F.bitwise_not("_low")).bitwiseOR(i.cast("long")))
    )
    step = once(step, _pairs=F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs))

    def hash_of(pair: Column) -> Column:
        return F.get(F.col("_windows"), pair.bitwiseAND(F.col("_low")).cast("int"))

    def same(other: Column, pair: Column) -> Column:
        close = F.call_function("shiftrightunsigned", other.bitwiseXOR(pair), F.col("_bits")) == 0
        return F.coalesce(close & (hash_of(other) == hash_of(pair)), F.lit(False))

    found = F.filter(
        "_pairs", lambda pair, j: same(F.get(F.col("_pairs"), j - 1), pair) | same(F.get(F.col("_pairs"), j + 1), pair)
    )
    places = F.sort_array(F.transform(found, lambda pair: pair.bitwiseAND(F.col("_low")).cast("int")))
    step = once(step, _found=places).drop("_pairs", "_windows", "_low", "_bits")
    new = F.transform("_found", lambda p, j: F.least(F.lit(3), p - F.coalesce(F.get(F.col("_found"), j - 1), F.lit(-3))))
    covered = F.aggregate(new, F.lit(0).cast("long"), lambda total, x: total + x)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_found")
    return step.withColumnsRenamed(back)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition: all rules hold."""
    fits = F.lit(True)
    for rule in rules:
        whole = F.greatest(F.col(rule.whole), F.lit(1))
        if rule.low > 0:
            fits = fits & (F.col(rule.part) >= F.lit(rule.low) * whole)
        if rule.high < float("inf"):
            fits = fits & (F.col(rule.part) <= F.lit(rule.high) * whole)
    return fits


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """``measured`` with ``base_failed`` (too short, or mostly repeated windows) and ``kept``."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        measured(docs.drop("base_failed", "kept"), text)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))
    )


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    return judged(docs, text, rules, min_words).where("kept").select(*docs.columns)
