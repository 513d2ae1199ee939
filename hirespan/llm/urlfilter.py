"""URL rules in a sorted array of digests, which tasks map into memory and search by bisection.

A rule is a host and the start of a path (``example.net/en/``); it fits the host and all its subdomains
if the path of a url starts with the rule's, and the longest fitting rule decides. Rules are stored by
the 64-bit hash of their full string: sorted keys, the rule strings they stand for end to end, and their
verdicts. Every host suffix of a url is looked up among the hosts first; only a host that has rules is
tried with the path lengths that occur. A key found is confirmed against the stored string, and all
entries of an equal key are looked at, so a collision never decides.

The file goes to the executors once, by Spark's own file distribution; it is mapped, not loaded, and rules
that take more than ``MOST_BYTES`` are refused with an error. A rule's host counts in lower case, and is reported
so; a rule without a slash is an error.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits it. A url
no rule fits is allowed. Repeated rows are judged alike, an empty table gives an empty one, and columns
of the input are carried on unless they bear the name of a result. Of rules given twice the last counts.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hirespan.llm.tables import small_batches

VERDICTS = ("allow", "block")
MOST_BYTES = 4 << 30
_SENT: set[tuple[str, str]] = set()  # by application and name


def key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def store(rules: list[tuple[str, str]]) -> bytes:
    """The digest array of (rule, verdict) pairs: counts, sorted keys, ends, verdicts, path lengths, strings.

    A host's own entry is its name without a path; its verdict says that it has rules (2).
    """
    if unclear := [rule for rule, _ in rules if "/" not in rule]:
        raise ValueError(f"rules need a slash behind the host: {unclear[:5]}")
    split = [(rule.partition("/"), verdict) for rule, verdict in rules]
    # Of bytes, lower() is for A-Z only.
    entries = {host.encode().lower() + b"/" + path.encode(): VERDICTS.index(verdict) for (host, _, path), verdict in split}
    lengths = sorted({len(rule) - rule.index(b"/") for rule in entries})
    entries |= {rule[: rule.index(b"/")]: 2 for rule in list(entries)}
    ordered = sorted((key(text), text, verdict) for text, verdict in entries.items())
    ends = np.cumsum([len(text) for _, text, _ in ordered])
    return b"".join(
        [
            np.array([len(ordered), len(lengths)], "<u8").tobytes(),
            np.array([k for k, _, _ in ordered], "<u8").tobytes(),
            np.array(ends, "<u8").tobytes(),
            np.array(lengths, "<u8").tobytes(),
            np.array([v for _, _, v in ordered], "u1").tobytes(),
            b"".join(text for _, text, _ in ordered),
        ]
    )


class Rules:
    """A stored array, mapped into memory."""

    def __init__(self, path: str) -> None:
        whole = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in whole[:16].view("<u8"))
        at = np.cumsum([16, 8 * n, 8 * n, 8 * m, n])
        self.keys, self.ends = whole[at[0] : at[1]].view("<u8"), whole[at[1] : at[2]].view("<u8")
        self.lengths = whole[at[2] : at[3]].view("<u8").astype(int).tolist()
        self.verdicts, self.strings = whole[at[3] : at[4]], whole[at[4] :]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """The verdict stored for each text, -1 where there is none."""
        keys = np.fromiter((key(t) for t in texts), "<u8", len(texts))
        first = np.searchsorted(self.keys, keys, "left")
        found = np.full(len(texts), -1)
        for k in np.flatnonzero((first < len(self.keys)) & (self.keys[np.minimum(first, len(self.keys) - 1)] == keys)):
            at = int(first[k])
            while at < len(self.keys) and self.keys[at] == keys[k]:
                start = int(self.ends[at - 1]) if at else 0
                if self.strings[start : int(self.ends[at])].tobytes() == texts[k]:
                    found[k] = self.verdicts[at]
                    break
                at += 1
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        """The rule that decides, and the verdict, of each url."""
        suffixes, owner = [], []
        for k, host in enumerate(hosts):
            labels = host.encode().split(b".") if host else []
            for n in range(len(labels)):
                suffixes.append(b".".join(labels[n:]))
                owner.append(k)
        # Of the distinct suffixes, those that have rules.
        distinct = list(dict.fromkeys(suffixes))
        ruled = {d for d, v in zip(distinct, self.find(distinct), strict=True) if v == 2}
        tried = []
        for k, suffix in zip(owner, suffixes, strict=True):
            if suffix in ruled:
                path = paths[k].encode()
                tried += [(k, suffix + path[:n]) for n in self.lengths if n <= len(path) and path[:1] == b"/"]
        best: list[tuple[str | None, str]] = [(None, "allow")] * len(hosts)
        size = [0] * len(hosts)
        for (k, text), verdict in zip(tried, self.find([t for _, t in tried]), strict=True):
            if verdict >= 0 and len(text) > size[k]:
                size[k], best[k] = len(text), (text.decode(), VERDICTS[int(verdict)])
        return best


@lru_cache(maxsize=4)
def rules_at(path: str) -> Rules:
    return Rules(path)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` (A-Z lower-cased) and ``path`` of the url."""
    rest = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.drop("host", "path").withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, lower),
            "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        }
    )


def judged(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, the ``rule`` that decides (null if none) and the ``verdict``."""
    spark = pages.sparkSession
    raw = store(rules)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"rules take {len(raw)} bytes, at most {MOST_BYTES} are possible")
    name = f"rules-{xxhash.xxh3_128_hexdigest(raw)}.bin"
    if (spark.sparkContext.applicationId, name) not in _SENT:
        path = os.path.join(tempfile.mkdtemp(prefix="hirespan-rules-"), name)
        with open(path, "wb") as file:
            file.write(raw)
        spark.sparkContext.addFile(path)  # the driver serves it; executors keep a copy each
        _SENT.add((spark.sparkContext.applicationId, name))
    parts = with_parts(pages.drop("rule", "verdict"), url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules_at(SparkFiles.get(name))
        for batch in batches:
            found = known.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            columns = [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "rule", "verdict"])

    small_batches(spark)
    schema = StructType([*parts.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return parts.mapInArrow(run, schema)
