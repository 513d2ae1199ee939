"""Personal data in text: patterns propose spans, checksums confirm them, words nearby raise or lower a score.

All of it is built-in functions on one row, so nothing is shuffled. Spark gives the matches of a
pattern but not their places; splitting by the same pattern gives what lies between, and running
lengths of both give places in code points.

Base kinds: ``email``, ``ip`` (parts at most 255), ``card`` (12 to 19 digits passing Luhn) and ``phone``
(9 to 15 digits); they stand whatever their score. The method adds ``iban`` (mod 97 is 1), ``pan`` (a
card number beside further digits, so that the run as a whole is no card) and ``ssn``, which has no
checksum and so needs a word nearby that names it.

Patterns are written so that matching takes time in proportion to the text: a run is only tried at
its start, and groups repeat possessively, which Java does without recursion.

Defined results: null and empty texts have no spans; a row gives a row, so repeated rows give equal
ones and an empty table an empty one; columns of the input are carried on unless they bear the name
of a result, which then wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirespan.llm.tables import set_aside

from hirespan.llm.quality import once

# In the order in which kinds at one start are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "pan", "ssn")
_PAN = "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}"
PATTERNS = {
    # Tried where a run of its first class starts, or right behind the match before.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # Whole runs of digits with single separators, of the right length only.
    "card": "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "pan": f"(?<![0-9])(?:(?<=[0-9][ -]){_PAN}(?![0-9])|{_PAN}(?=[ -][0-9]))",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
# Words whose presence just before a span raises its score.
NEARBY = {
    "email": "mail|contact|write|reach|address",
    "ip": "ip|host|server|address|client",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "pan": "card|visa|mastercard|credit|debit|payment",
    "ssn": "ssn|social|security|insurance",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "pan": 0.6, "ssn": 0.2}
RAISE, LEAST, WINDOW = 0.4, 0.5, 30
COUNTS = tuple(f"n_{kind}" for kind in BASE)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether letters as numbers, country and check digits last, leave 1 when divided by 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return (rest * F.when(is_digit, 10).otherwise(100) + F.ascii(c) - F.when(is_digit, 48).otherwise(55)) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """What a match must pass besides its pattern."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind in ("card", "pan"):
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod_97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def split_up(kind: str, text: Column) -> tuple[Column, Column]:
    """The matches of a kind, and the pieces of text before, between and behind them."""
    tried = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]{2}")
    none = F.array().cast("array<string>")
    matches = F.when(tried, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)
    pieces = F.when(tried, F.split(text, PATTERNS[kind], -1)).otherwise(F.array(text))
    return matches, pieces


def running(lengths: Column) -> Column:
    """Running sums of an array of longs.

    Built in blocks of about the root of its size, as an array that grows in a fold is copied at each step.
    """
    empty = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    size = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))

    def sums(block: Column) -> Column:
        return F.aggregate(
            block,
            empty,
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")),
            lambda acc: acc["a"],
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / size).cast("int") - 1, F.lit(0))),
        lambda b: sums(F.slice(lengths, b * size + 1, size)),
    )
    before = F.aggregate(
        blocks,
        empty,
        lambda acc, b: F.struct(
            (acc["s"] + F.coalesce(F.get(b, F.size(b) - 1), F.lit(0).cast("long"))).alias("s"),
            F.concat(acc["a"], F.array(acc["s"])).alias("a"),
        ),
        lambda acc: acc["a"],
    )
    return F.flatten(F.zip_with(blocks, before, lambda b, offset: F.transform(b, lambda x: x + offset)))


def is_named(kind: str, piece: Column) -> Column:
    """Whether a word that goes with the kind stands in the last characters of the piece before a match."""
    return F.lower(F.substring(piece, -WINDOW, WINDOW)).rlike(f"(?:^|[^a-z])(?:{NEARBY[kind]})")


def _scored(kind: str, rank: int) -> Column:
    """The spans of one kind from its matches, pieces and ends."""

    def span(x: Column) -> Column:
        return F.struct(
            (x["e"] - F.length(x["m"])).alias("start"),
            F.lit(rank).alias("rank"),
            x["e"].alias("end"),
            F.lit(kind).alias("kind"),
            F.round(F.lit(SCORES[kind]) + F.when(is_named(kind, x["p"]), RAISE).otherwise(0.0), 2).alias("score"),
        )

    zipped = F.arrays_zip(
        F.col(f"_{kind}_m").alias("m"),
        F.slice(f"_{kind}_p", 1, F.size(f"_{kind}_m")).alias("p"),
        F.col(f"_{kind}_e").alias("e"),
    )
    passed = F.transform(F.filter(zipped, lambda x: confirmed(kind, x["m"])), span)
    if kind not in BASE:
        passed = F.filter(passed, lambda span: span["score"] >= LEAST)
    return F.when(F.size(f"_{kind}_m") == 0, None).otherwise(passed)


def _shown(kind: str):
    """A piece and the match behind it, the match by its kind if it is confirmed."""

    def one(match: Column, piece: Column) -> Column:
        named = F.lit(True) if kind in BASE or SCORES[kind] >= LEAST else is_named(kind, piece)
        return F.concat(piece, F.when(confirmed(kind, match) & named, F.lit(f"[{kind.upper()}]")).otherwise(match))

    return one


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``found``: an array of (start, rank, end, kind, score) by start, then kind."""
    plain = F.coalesce(F.col(text), F.lit(""))
    step, back = set_aside(docs.drop("found"), {f"_{kind}_{n}" for kind in KINDS for n in "mpe"})
    arrays = {}
    parts = {kind: split_up(kind, plain) for kind in KINDS}
    step = once(step, **{f"_{k}_{n}": c for k, both in parts.items() for n, c in zip("mp", both, strict=True)})
    for kind in KINDS:
        matches, pieces = F.col(f"_{kind}_m"), F.col(f"_{kind}_p")
        lengths = F.zip_with(
            matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: (F.length(m) + F.length(p)).cast("long")
        )
        # Most texts have no match: nothing is summed for them.
        ends = F.when(F.size(matches) == 0, F.array().cast("array<bigint>")).otherwise(running(lengths))
        arrays[f"_{kind}_e"] = ends
    step = once(step, **arrays)
    spans = [_scored(kind, rank) for rank, kind in enumerate(KINDS)]
    nothing = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
    step = once(step, found=F.sort_array(F.concat(*[F.coalesce(s, nothing) for s in spans])))
    return step.drop(*[f"_{kind}_{n}" for kind in KINDS for n in "mpe"]).withColumnsRenamed(back)


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the base kinds, ``base_sha256`` and ``spans``."""
    step = found(docs.drop(*COUNTS, "base_sha256", "spans"), text)
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    for rank, kind in enumerate(BASE):
        ranks = F.transform("found", lambda s: s["rank"])
        step = step.withColumn(f"n_{kind}", (F.size(ranks) - F.size(F.array_remove(ranks, rank))).cast("long"))
    return step.withColumn("base_sha256", F.sha2(listed(base), 256)).withColumn("spans", listed(F.col("found")))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each confirmed span of ``text`` replaced by its kind in brackets.

    Kinds are replaced one after the other; phones a second time, as a number behind them may be gone by then.
    A text without any stays as it is, a null one null.
    """
    step, back = set_aside(docs, {"_m", "_p"})
    for kind in ("email", "phone", "ip", "card", "pan", "iban", "ssn", "phone"):
        matches, pieces = split_up(kind, F.col(text))
        step = once(step, _m=matches, _p=pieces)
        joined = F.concat(
            F.array_join(F.zip_with("_m", F.slice("_p", 1, F.size("_m")), _shown(kind)), ""), F.get("_p", F.size("_m"))
        )
        step = step.withColumn(text, F.when(F.size("_m") == 0, F.col(text)).otherwise(joined)).drop("_m", "_p")
    return step.withColumnsRenamed(back).select(*docs.columns)
