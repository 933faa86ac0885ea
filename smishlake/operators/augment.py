"""Adversarial variants of messages and how well scoring holds up against them.

Random choices are drawn by whole-number arithmetic from message, perturbation, seed and position, so results do not
depend on partitioning, and any engine can follow them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from smishlake.functions import constants as C
from smishlake.functions.columns import markup_escape
from smishlake.operators.scoring import score_messages
from smishlake.operators.signals import SIGNAL_FIELDS, SIGNALS, signals_of
from smishlake.operators.text import CLEANED, clean_all, in_small_batches, language_of, slices

FIXED = ("whitespace_manipulation", "phonetic_transliteration", "hinglish_synthesis", "mixed_scripts", "punctuation_insertion", "informal_abbreviations", "multilingual_switching", "ocr_corruption", "domain_obfuscation", "sender_id_mutation")
RANDOM = ("vowel_deletion", "adjacent_swap", "number_substitution", "repeated_chars", "unicode_confusables", "zero_width_chars", "unicode_normalization", "nested_obfuscation", "realistic_typos")
PERTURBATIONS = FIXED + RANDOM
#: Messages whose variants are Python objects at once.
SLICE = 64
DETECTED_AT = 40
#: Draws are numbers below this prime, over it; what multiplies the positions in a text and in a word.
PRIME, STEPS = 2_147_483_647, (1_000_003, 69_621)


def _level(intensity: str, low, medium, high):
    return {"low": low, "medium": medium}.get(intensity, high)


#: White space as it splits words: that of Unicode, without the four separators that only Python takes for it.
_WHITE = re.compile(r"[^\S\x1C-\x1F]+")
_MARKS = re.compile(r"[^\w\s\u200C\u200D]|[\x1C-\x1F]")
_ZERO_WIDTH_MARKS = ("\u200b", "\u200c", "\u200d", "\ufeff")
_LEET, _LOOKALIKE = (str.maketrans(a, b) for a, b in ((C.ADD_LEET_FROM, C.ADD_LEET_TO), (C.ADD_LOOKALIKE_FROM, C.ADD_LOOKALIKE_TO)))


@lru_cache(maxsize=2 * SLICE)
def _words(text: str) -> list[str]:
    """The words of a text, for all kinds of a slice; nobody changes the list."""
    return [w for w in _WHITE.split(text) if w]


def code_of(name: str) -> int:
    return zlib.crc32(name.encode()) % PRIME


def _draws(key: int, name: str, *at: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that follow from the row, the perturbation and the positions; products stay within 64 bits."""
    h = np.int64(key * 48_271 + code_of(name))
    for step, i in zip(STEPS, at, strict=False):
        h = h + i.astype(np.int64) * step
    h = h % PRIME
    return ((h * h % PRIME) * 16_807 + h) % PRIME / PRIME


@lru_cache(maxsize=1 << 14)
def _key(w: str) -> str:
    return _MARKS.sub("", w.lower())


def _links(w: str) -> bool:
    return "http" in w or "bit.ly" in w


def _swapped_letters(text: str, hit: np.ndarray, table: dict) -> str:
    """text with the characters at the places of hit translated."""
    return "".join([b if h else a for a, b, h in zip(text, text.translate(table), hit.tolist(), strict=True)])


def perturb(text: str, kind: str, key: int, intensity: str = "medium") -> str:
    """One perturbation of a text; intensity is low, medium, or anything else for high. Draws of all words or characters
    of a text are made at once."""
    if kind in CHANCE_BY_CHARACTER:
        if kind == "unicode_normalization":
            text = unicodedata.normalize("NFD", text)
            hit = _draws(key, kind, np.arange(len(text))) < 0.5
            return "".join([c + "\u0301" if h and c.lower() in _VOWELS else c for c, h in zip(text, hit.tolist(), strict=True)])
        leet = kind == "number_substitution"
        p = _level(intensity, 0.4, 0.7, 0.9 if leet else 0.95)
        return _swapped_letters(text, _draws(key, kind, np.arange(len(text))) < p, _LEET if leet else _LOOKALIKE)
    if kind == "nested_obfuscation":
        one = perturb(text, "number_substitution", key, "high")
        return perturb(perturb(one, "unicode_confusables", key, "medium"), "zero_width_chars", key, "low")
    if kind in CHANCE_BY_WORD:
        words = _words(text)
        return " ".join(CHANCE_BY_WORD[kind](words, key, intensity))
    if kind == "whitespace_manipulation":
        words = _words(text)
        if intensity == "low":
            return " ".join(words).replace(". ", ".")
        if intensity == "medium":
            return "".join([w if i % 2 else w + " " for i, w in enumerate(words)])
        return "".join([w[:1].upper() + w[1:].lower() for w in words])
    if kind in _BY_WORD:
        return " ".join(map(_BY_WORD[kind], _words(text)))
    if kind == "punctuation_insertion":
        sep = _level(intensity, ".", "_", "-")
        return " ".join([sep.join(w) if len(w) >= 3 and "http" not in w else w for w in _words(text)])
    if kind == "hinglish_synthesis":
        low = text.lower()
        return next(template for words, template in C.HINGLISH_TEMPLATES if any(w in low for w in words.split("|")))
    if kind == "multilingual_switching":
        return C.SWITCHED
    if kind in REPLACED:
        for a, b in REPLACED[kind]:
            text = text.replace(a, b)
        return text
    if kind == "sender_id_mutation":
        return C.SENDER_MUTATION + text
    raise ValueError(kind)


CHANCE_BY_CHARACTER = ("number_substitution", "unicode_confusables", "unicode_normalization")
REPLACED = {
    "ocr_corruption": (("rn", "m"), ("cl", "d"), ("vv", "w"), ("l", "1"), ("O", "0")),
    "domain_obfuscation": (("sbi.co.in", "sbi[.]co[.]in"), (".com", "[.]com"), ("http://", "h**p://")),
}
_VOWELS = frozenset("aeiou")


def _mapped(values: dict[str, str], tail: bool):
    """A function of a word: what values has for its key, with what stands behind so many characters as the key has."""

    def change(w: str) -> str:
        low = w.lower()
        key = low if low.isalpha() else _key(w)  # letters hold no marks
        return values[key] + (w[len(key) :] if tail else "") if key in values else w

    return change


_BY_WORD = {"phonetic_transliteration": _mapped(C.TO_HINGLISH, True), "informal_abbreviations": _mapped(C.TO_ABBREVIATION, True), "mixed_scripts": _mapped(C.TO_DEVANAGARI, False)}


def _picks(words: list[str], key: int, name: str, less: int = 0) -> list[int]:
    """A place in each word, or in so many characters less."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) - less
    return np.floor(_draws(key, name, np.arange(len(words))) * sizes).astype(np.int64).tolist()


def _without_vowels(words: list[str], key: int, intensity: str) -> list[str]:
    p, out = _level(intensity, 0.4, 0.7, 0.95), list(words)
    long = [i for i, w in enumerate(words) if len(w) > 3 and not _links(w)]
    sizes = np.array([len(words[i]) - 1 for i in long], np.int64)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gone = (_draws(key, "vowel_deletion", np.repeat(np.array(long, np.int64), sizes), inside) <= p).tolist()
    at = 0
    for i in long:
        w = words[i]
        out[i] = w[0] + "".join([c for c, g in zip(w[1:], gone[at : at + len(w) - 1], strict=True) if not (g and c.lower() in _VOWELS)])
        at += len(w) - 1
    return out


def _adjacent_swap(words: list[str], key: int, intensity: str) -> list[str]:
    p, at = _level(intensity, 0.3, 0.5, 0.8), _picks(words, key, "swap_at", 2)
    stays = (_draws(key, "adjacent_swap", np.arange(len(words))) > p).tolist()
    return [w if stay or len(w) <= 3 or _links(w) else w[: i + 1] + w[i + 2] + w[i + 1] + w[i + 3 :] for w, i, stay in zip(words, at, stays, strict=True)]


def _repeated_chars(words: list[str], key: int, intensity: str) -> list[str]:
    n = _level(intensity, 3, 4, 6)
    return [w if len(w) <= 3 or "http" in w else w[:i] + w[i] * n + w[i + 1 :] for w, i in zip(words, _picks(words, key, "repeated_chars"), strict=True)]


def _zero_width_chars(words: list[str], key: int, intensity: str) -> list[str]:
    marks = np.floor(_draws(key, "zw_mark", np.arange(len(words))) * 4).astype(np.int64).tolist()
    return [w[: i + 1] + _ZERO_WIDTH_MARKS[m] + w[i + 1 :] if len(w) >= 3 else w for w, i, m in zip(words, _picks(words, key, "zw_at", 1), marks, strict=True)]


def _realistic_typos(words: list[str], key: int, intensity: str) -> list[str]:
    slips = (_draws(key, "realistic_typos", np.arange(len(words))) < 0.6).tolist()
    which = _draws(key, "typo_key", np.arange(len(words))).tolist()
    out = []
    for w, i, slip, x in zip(words, _picks(words, key, "typo_at"), slips, which, strict=True):
        near = C.KEY_NEIGHBOURS.get(w[i].lower()) if slip and len(w) > 3 and "http" not in w else None
        out.append(w[:i] + near[int(x * len(near))] + w[i + 1 :] if near else w)
    return out


CHANCE_BY_WORD = {"vowel_deletion": _without_vowels, "adjacent_swap": _adjacent_swap, "repeated_chars": _repeated_chars, "zero_width_chars": _zero_width_chars, "realistic_typos": _realistic_typos}


def augment_messages(messages: DataFrame, kinds=PERTURBATIONS, intensity: str = "medium", seed: int = 0) -> DataFrame:
    """msg_id, perturbation, raw_text (the variant), sender_id: one row per message and kind, few messages at once."""
    text, key = F.coalesce("raw_text", F.lit("")), F.pmod(F.pmod("msg_id", F.lit(PRIME)) * 7_919 + seed, F.lit(PRIME))
    kinds = tuple(kinds)
    rows = messages.select("msg_id", "sender_id", text.alias("raw_text"), key.cast("long").alias("_key"))
    schema = T.StructType([rows.schema["msg_id"], T.StructField("perturbation", T.StringType()), T.StructField("raw_text", T.StringType()), rows.schema["sender_id"]])

    def variants(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts, keys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                again = pa.array(np.repeat(np.arange(batch.num_rows), len(kinds)))
                made = pa.array([None if k is None and kind in RANDOM else perturb(t, kind, k, intensity) for t, k in zip(texts, keys, strict=True) for kind in kinds], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array(kinds * batch.num_rows, pa.string()), made, batch.column(1).take(again)], names=schema.names)

    return rows.mapInArrow(variants, schema)


def scored_variants(messages: DataFrame, kinds=PERTURBATIONS, intensity: str = "medium", seed: int = 0, keep_text: bool = False) -> DataFrame:
    """augment_messages() with the columns of normalize() and score_messages(), in one pass: a message goes to a worker once,
    and its variants stay there but for keep_text. Equal variants of a slice of messages are normalised and scanned once."""
    text, key = F.coalesce("raw_text", F.lit("")), F.pmod(F.pmod("msg_id", F.lit(PRIME)) * 7_919 + seed, F.lit(PRIME))
    kinds = tuple(kinds)
    rows = in_small_batches(messages).select("msg_id", text.alias("raw_text"), key.cast("long").alias("_key"))
    flags = [f for f in CLEANED.fields if f.name != "text"]
    schema = T.StructType([rows.schema["msg_id"], T.StructField("perturbation", T.StringType()), T.StructField("raw_text", T.StringType()), *flags, T.StructField("_signals", SIGNALS)])
    types = [f.type for f in to_arrow_schema(T.StructType(flags))]

    def variants(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                made = [None if k is None and kind in RANDOM else perturb(t, kind, k, intensity) for kind in kinds for t, k in zip(texts, keys, strict=True)]
                places: dict[str, int] = {}
                of = pa.array([places.setdefault(v or "", len(places)) for v in made])
                found = [[] for _ in range(len(flags) + 1)]
                for (some,) in slices(pa.array(list(places), pa.large_string())):
                    (_, *columns), cleans, lows = clean_all(some)
                    columns = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    signals = [pa.array(c, f.type) for c, f in zip(signals_of(some, cleans, ("scores",), lows), SIGNAL_FIELDS, strict=True)]
                    for known, c in zip(found, [*columns, pa.StructArray.from_arrays(signals, fields=SIGNAL_FIELDS)], strict=True):
                        known.append(c)
                again = pa.array(np.tile(np.arange(batch.num_rows), len(kinds)))
                names = pa.array(np.repeat(np.array(kinds, object), batch.num_rows), pa.string())
                kept = pa.array(made, pa.string()) if keep_text else pa.nulls(len(made), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), names, kept, *(pa.concat_arrays(c).take(of) for c in found)], names=schema.names)

    df = rows.mapInArrow(variants, schema)
    df = df.withColumn("n_transformations", F.col("n")).withColumn("text_confidence", F.greatest(F.lit(0.1), 1 - 0.03 * F.col("n")))
    return score_messages(language_of(df, F.col("marked"), F.col("deva"), F.col("latin"))).drop("n", "marked", "deva", "latin", "_signals")


def robustness(scored: DataFrame, at: int = DETECTED_AT) -> DataFrame:
    """Rates per perturbation, per language and over all, from one pass with grouping sets.

    scored(perturbation, language, risk_score)
    """
    d = scored.withColumn("detected", F.col("risk_score") >= at)
    out = d.groupingSets([["perturbation"], ["language"], []], "perturbation", "language").agg(
        F.grouping("perturbation").alias("_gp"), F.grouping("language").alias("_gl"), F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("true_positives"), F.count_if(~F.col("detected")).alias("false_negatives"))
    level = F.when(F.col("_gp") == 0, "perturbation").when(F.col("_gl") == 0, "language").otherwise("all")
    return out.select(level.alias("level"), F.coalesce("perturbation", "language", F.lit("all")).alias("name"), "n", "true_positives", "false_negatives", F.bround(100.0 * F.col("true_positives") / F.col("n"), 1).alias("robustness"))


def hardest(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k variants with the least risk; a top-k, not a full sort."""
    return scored.orderBy("risk_score", "msg_id", "perturbation").limit(k)


def failures(scored: DataFrame, at: int = DETECTED_AT) -> DataFrame:
    """perturbation, escaped: distinct variants that went undetected, with markup characters as references."""
    return scored.filter(F.col("risk_score") < at).select("perturbation", "raw_text").distinct().select("perturbation", markup_escape(F.col("raw_text")).alias("escaped"))
