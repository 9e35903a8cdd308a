"""Secret scans: known shapes, and sliding-window entropy of candidate strings per character class."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrad.llm.common import id_and_text, read_table

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is the run that [0-9a-f]+ finds
#: Candidate strings: runs of key characters at least a window long.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Character class -> (characters, least entropy of a window in bits per character).
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("alphanumeric", frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 3.8),
    ("base64", frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"), 3.8),
)
#: Strings that look random and aren't secrets. Every pattern has one way to match a string, so it takes linear time.
ALLOW_LIST = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[0-9+/_=-]+"),  # numbers, dates, rules
    re.compile(r"[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*"),  # words, paths of words
    re.compile(r"[A-Z]+(?:[-_/][A-Z]+)*"),  # words in capitals
)
#: What a placeholder contains somewhere.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|dummy|xxxx|your[-_]", re.IGNORECASE)


def windows_above(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows whose Shannon entropy is at least ``least`` bits a character.

    Counts change by one character in and one out per step, and the sum of c * log2(c) with them:
    entropy = log2(window) - sum / window.
    """
    clog = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, entering in enumerate(text):
        c = counts.get(entering, 0)
        counts[entering] = c + 1
        total += clog[c + 1] - clog[c]
        if i >= window:
            leaving = text[i - window]
            c = counts[leaving]
            counts[leaving] = c - 1
            total += clog[c - 1] - clog[c]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def entropy_spans(candidate: str) -> list[tuple[int, int]]:
    """High-entropy parts of a candidate, by the narrowest character class that holds all of it."""
    if PLACEHOLDER.search(candidate) or any(p.fullmatch(candidate) for p in ALLOW_LIST):
        return []
    letters = set(candidate)
    for _, members, least in CLASSES:
        if letters <= members:
            # Letters alone are words run together more often than keys: a key mixes in digits.
            return windows_above(candidate, WINDOW, least) if any(c.isdigit() for c in letters) else []
    return []


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that entropy adds) of a whole text: (kind, start, end) in code points."""
    base = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    # Both lists are in order of their starts: a base span holds (a, b) if the furthest end so far does.
    added, at, furthest = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        for start, end in entropy_spans(m.group()):
            a, b = m.start() + start, m.start() + end
            while at < len(base) and base[at][1] <= a:
                furthest = max(furthest, base[at][2])
                at += 1
            if furthest < b:
                added.append(("entropy", a, b))
    return base, added


FINDINGS = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("n_entropy", T.LongType()),
        T.StructField("base", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def findings_column(text: Column) -> Column:
    @F.pandas_udf(FINDINGS)
    def findings(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base, added = scan(text)
                kinds = [k for k, _, _ in base]
                spans = sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append((*(kinds.count(k) for k in KINDS[:3]), len(added), _joined(base), _joined(spans)))
            yield pd.DataFrame(rows, columns=FINDINGS.names)

    return findings(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts per kind, ``base`` and ``spans`` (kind:start:end, comma-joined) of every row.

    Base kinds are matched leftmost and without overlaps per kind over the whole text; matches that
    are too short go. Entropy adds spans that no base span holds; strings shorter than a window are no
    candidates. The time is linear in the length of a text. Null text counts as empty: no spans.
    Every row, repeated ones too, gets its own result; other columns are ignored. No rows in, none out.
    """
    base = id_and_text(docs, id_col, text_col)
    return base.select("doc_id", findings_column(F.col("text")).alias("f")).select("doc_id", "f.*")


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy"
    )
