"""What the patterns of scores, brands and evidence find in a message, all in one Arrow pass."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from smishlake.functions import constants as C
from smishlake.functions.scan import Detector, Scanner
from smishlake.operators.text import CLEANED, CLEANED_LOGGED, clean_all, in_columns

PARTS = ("scores", "brands", "evidence")
#: Patterns of the scores; all but two are looked for in the normalised and in the raw text.
SCORES = {"fear_high": C.FEAR_HIGH, "fear_low": C.FEAR_LOW, "urgency": C.URGENCY, **{f"family_{name}": p for name, p, _ in C.FAMILIES}, "credential": C.CREDENTIAL, "financial": C.FINANCIAL, "link": C.LINK, "call_to_action": C.CALL_TO_ACTION}
RAW_ONLY, CLEAN_ONLY = ("link",), ("call_to_action",)
#: Places of the bits of `scores`.
BITS = {name: i for i, name in enumerate(SCORES)}
#: Built without a session: workers import this module. claims has a bit for each organisation, spans follow C.EVIDENCE.
SIGNALS = T.StructType([T.StructField("scores", T.LongType()), T.StructField("claims", T.LongType()), T.StructField("threat", T.BooleanType()), T.StructField("spans", T.ArrayType(T.StringType()))])
SIGNAL_FIELDS = list(to_arrow_schema(SIGNALS))


#: Between word boundaries for all scripts; RE2 has no look-around.
_BOUNDED = r"(?:^|[^\p{L}\p{N}_])(?:%s)(?:$|[^\p{L}\p{N}_])"
ALIASES = ["|".join(re.escape(a.lower()) for a in o[2]) for o in C.ORGANISATIONS]


@lru_cache(maxsize=1)
def evidence_scanner() -> Scanner:
    return Scanner([Detector(name, p, "first", bounded) for name, p, *_, bounded in C.EVIDENCE])


def _has(texts: pa.Array, pattern: str, known: np.ndarray | None = None) -> np.ndarray:
    """Which texts the pattern matches somewhere (or are known to be hit); RE2, so the time is linear in the text."""
    if known is None:
        return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    out, rest = known.copy(), np.flatnonzero(~known)
    if len(rest):
        out[rest] = _has(texts.take(pa.array(rest)) if len(rest) < len(texts) else texts, pattern)
    return out


def signals_of(raws: list[str], cleans: list[str], parts: tuple[str, ...], lows: list[str] | None = None) -> tuple[list, list, list, list]:
    """Columns of SIGNALS for raw texts and what normalisation made of them; lows are the latter in lower case."""
    clean, raw = (pa.array(x, pa.large_string()) for x in (lows or [c.lower() for c in cleans], [r.lower() for r in raws]))
    scores, claims, threat = (np.zeros(len(raws), kind) for kind in (np.int64, np.int64, bool))
    if "scores" in parts:
        for name, pattern in SCORES.items():
            hit = None if name in RAW_ONLY else _has(clean, pattern)
            scores |= (hit if name in CLEAN_ONLY else _has(raw, pattern, hit)).astype(np.int64) << BITS[name]
    if "brands" in parts:
        threat = _has(clean, _BOUNDED % C.BRAND_THREAT)
        some = np.flatnonzero(_has(raw, "|".join(ALIASES), _has(clean, "|".join(ALIASES))))
        clean, raw = clean.take(pa.array(some)), raw.take(pa.array(some))
        for i, aliases in enumerate(ALIASES):  # only of texts that have any
            claims[some] |= _has(raw, aliases, _has(clean, _BOUNDED % aliases)).astype(np.int64) << i
    spans: list = [[]] * len(raws)
    if "evidence" in parts:
        exact = evidence_scanner()
        spans = [s if r == c else exact.scan(r, s) for r, c, s in zip(raws, cleans, map(exact.scan, cleans), strict=True)]
    return scores.tolist(), claims.tolist(), threat.tolist(), spans


def scan_messages(raw: Column, clean: Column, parts: tuple[str, ...] = PARTS) -> Column:
    """SIGNALS of a message. A text that is null counts as empty."""

    @F.arrow_udf(SIGNALS)
    def scan(raws: pa.Array, cleans: pa.Array) -> pa.Array:
        return in_columns(lambda r, c: signals_of(r, c, parts), SIGNALS, raws, cleans)

    return scan(raw, clean)


def cleaned_and_scanned(parts: tuple[str, ...], log: bool, max_chars: int | None = None, keep_text: bool = True, vectors: Callable | None = None) -> Callable[[Column], Column]:
    """What normalize() and scan_messages() find in raw texts, in one pass: a text comes to one Python worker, once. Without
    keep_text the normalised texts stay there. vectors(texts, the same in lower case) gives a vector of each normalised text."""
    made = [T.StructField("vector", T.ArrayType(T.DoubleType()))] if vectors else []
    kind = T.StructType([*(CLEANED_LOGGED if log else CLEANED).fields, T.StructField("signals", SIGNALS), *made])

    def found(raws: list[str]) -> list:
        (texts, *rest), cleans, lows = clean_all([r[:max_chars] for r in raws] if max_chars else raws, log)
        signals = [pa.array(c, f.type) for c, f in zip(signals_of(raws, cleans, parts, lows), SIGNAL_FIELDS, strict=True)]
        return [texts if keep_text else [None] * len(raws), *rest, pa.StructArray.from_arrays(signals, fields=SIGNAL_FIELDS), *([vectors(cleans, lows)] if vectors else [])]

    @F.arrow_udf(kind)
    def both(raws: pa.Array) -> pa.Array:
        return in_columns(found, kind, raws)

    return both


def with_signals(df: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Adds _signals to messages(raw_text, normalized_text), unless they are there."""
    return df if "_signals" in df.columns else df.withColumn("_signals", scan_messages(F.col("raw_text"), F.col("normalized_text"), parts))


def score_bit(name: str) -> Column:
    return F.getbit(F.col("_signals.scores"), F.lit(BITS[name])) == 1
