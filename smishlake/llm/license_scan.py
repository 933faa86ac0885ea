"""Operator 7: license scans by ordered signature rules.

The rules (license_rules.py, written by hand) are regexes over normalised words (lower case, anything that is no word
character becomes one space), each with a keyword that must occur before the regex is tried, and in order of priority.
Overlapping detections are resolved by priority, then length: a detection inside a stronger one's interval is suppressed.
The three base phrases are counted apart.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from smishlake.llm.common import map_rows, table
from smishlake.llm.license_rules import TIERS

#: Phrases and labels of the contract (fixed values).
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))


def keyword(pattern: str) -> str:
    """The longest literal stretch that every match of a rule holds."""
    return max(re.split(r"\(\?:[^)]*\)\??|\[[^\]]*\](?:\{[0-9,]+\})?", pattern), key=len).strip()


@lru_cache(maxsize=1)
def signatures() -> list[tuple[int, str, float, str, re.Pattern]]:
    """(priority, label, weight, keyword, regex) of each rule, in order."""
    out = []
    for tier in TIERS:
        for line in tier.strip().splitlines():
            label, weight, pattern = line.split(" ", 2)
            out.append((len(out), label, float(weight), keyword(pattern), re.compile(rf"(?<!\S){pattern}(?!\S)")))
    return out


@lru_cache(maxsize=1)
def gate() -> tuple[ahocorasick.Automaton, list]:
    rules, by = signatures(), {}
    for i, r in enumerate(rules):
        by.setdefault(r[3], []).append(i)
    words = ahocorasick.Automaton()
    for k, ids in by.items():
        words.add_word(k, ids)
    words.make_automaton()
    return words, rules


_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def places(flat: bytes, phrase: bytes) -> list[int]:
    """Offsets of a phrase in words that single spaces part and surround."""
    out, at, key = [], 0, b" " + phrase + b" "
    while (at := flat.find(key, at)) >= 0:
        out.append(at)
        at += 1
    return out


def suppress(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Stronger detections first; one whose interval lies in that of a kept one goes."""
    kept: list = []
    reach: list[tuple[int, int]] = []
    for d in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0], d[3])):
        if not any(a <= d[0] and d[1] <= b for a, b in reach):
            kept.append(d)
            reach.append((d[0], d[1]))
    return sorted(kept)


def detections(flat: str) -> list[tuple[int, int, int, str, float]]:
    """(start, end, priority, label, weight) of what the rules find, in offsets of the normalised text."""
    words, rules = gate()
    hot = sorted({i for _, ids in words.iter(flat) for i in ids})
    found = {}
    for i in hot:
        priority, label, weight, _, rx = rules[i]
        for m in rx.finditer(flat):
            found.setdefault((m.start(), m.end(), label), (m.start(), m.end(), priority, label, weight))
    out: list = []
    near: list = []
    end = -1
    for d in sorted(found.values()):  # detections that touch form one run, so suppression stays local
        if d[0] > end and near:
            out += suppress(near)
            near = []
        near.append(d)
        end = max(end, d[1])
    return out + suppress(near) if near else out


def scan(text: str) -> tuple:
    words = normalised(text)
    flat = b" " + b" ".join(words) + b" "
    base: list[int] = []
    labels = []
    for phrase, label in BASE:
        if got := places(flat, phrase):
            base += got
            labels.append(label)
    string = flat.decode("utf-8", "surrogatepass")
    hits = detections(string)
    if not base and not hits:
        return len(words), 0, None, None, "", "", 0.0, []
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    first, last = (int(np.searchsorted(gaps, f(base))) for f in (min, max)) if base else (None, None)
    char_gaps = gaps if len(string) == len(flat) else np.flatnonzero(np.frombuffer(string.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    spans = [(int(np.searchsorted(char_gaps, a)), int(np.searchsorted(char_gaps, b)), label, weight) for a, b, _, label, weight in hits]
    both = sorted({*labels, *(h[3] for h in hits)})
    score = 1.0 - float(np.prod([1.0 - 0.9 * w for w in [*(h[4] for h in hits), *[0.9] * len(labels)]]))
    return len(words), len(base), first, last, ",".join(sorted(labels)), ",".join(both), score, spans


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, labels, score and spans (first word, word after the last, label, weight).

    Null text counts as empty; empty texts give zero words, null places and empty labels. Repeated rows give repeated
    rows; other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(ids: list, texts: list) -> tuple:
        rows = [scan(t or "") for t in texts]
        cols = [list(c) for c in zip(*rows, strict=True)]
        cols[-1] = [[{"begin": a, "end": b, "label": k, "weight": w} for a, b, k, w in s] for s in cols[-1]]
        return ids, *cols

    schema = f"{id_col} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<begin: bigint, end: bigint, label: string, weight: double>>"
    return map_rows(df, run, schema, id_col, text_col)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
