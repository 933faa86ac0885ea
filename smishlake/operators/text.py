"""Text normalisation: undo obfuscation in eleven passes, log what was done, detect script and language."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from smishlake.functions import constants as C
from smishlake.functions.columns import barrier, text_literals

LETTER = r"a-zA-Zऀ-ॿ"
#: Characters outside this class may change under NFKC; only texts that hold one are normalised.
NFKC_STABLE = r"\x00-\x9F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏऀ-ॗॠ-ॿ"


_STAND_INS = frozenset(C.LEET_FROM)
_LEET = str.maketrans(C.LEET_FROM, C.LEET_TO)
_LISTED, _MARKERS = frozenset({*C.VOWEL_DELETED, *C.KEYBOARD_TYPOS, *C.ABBREVIATIONS}), frozenset(C.HINGLISH_MARKERS)
_NOT_ALNUM = re.compile("[^a-z0-9]+")


def _titled(word: str) -> bool:
    """Every run of letters is one capital and then small letters, and there is a run."""
    inside, any_ = False, False
    for c in word:
        kind = unicodedata.category(c)
        if kind[0] != "L":
            inside = False
        elif kind != ("Ll" if inside else "Lu"):
            return False
        else:
            inside = any_ = True
    return any_


def _recased(word: str, new: str) -> str:
    if word.upper() == word and word.lower() != word:
        return new.upper()
    return " ".join(x[:1].upper() + x[1:].lower() for x in new.split(" ")) if _titled(word) else new


def _leet(w: str) -> str | None:
    return w.translate(_LEET) if not _STAND_INS.isdisjoint(w) and any(map(str.isalpha, w)) else None


def _vowels(w: str) -> str | None:
    key = _NOT_ALNUM.sub("", w.lower())
    return _recased(w, C.VOWEL_DELETED[key]) if key in C.VOWEL_DELETED else None


def _typo(w: str) -> str | None:
    return C.KEYBOARD_TYPOS.get(w.lower().strip(".,!?;:"))


def _abbreviation(w: str) -> str | None:
    key = w.lower().strip(".,!?;:")
    return _recased(w, C.ABBREVIATIONS[key]) if key in C.ABBREVIATIONS else None


#: The passes word by word, in their order: what a word becomes, or None where it stays.
WORD_PASSES = (("LEET", _leet), ("VOWELS_DROPPED", _vowels), ("KEYBOARD_TYPO", _typo), ("ABBREVIATION", _abbreviation))


def restore_word(word: str) -> tuple[str, tuple]:
    """A word after all passes, and for each pass the (before, after) of the words that it hit."""
    new = _leet(word)  # most words are hit by the first pass or by none
    low = (new or word).lower()
    key = low.strip(".,!?;:")
    if " " not in word and key not in C.KEYBOARD_TYPOS and key not in C.ABBREVIATIONS and _NOT_ALNUM.sub("", low) not in C.VOWEL_DELETED:
        return (word, ()) if new is None else (new, ([(word, new)], [], [], []))
    parts, hits = [word], []
    for _, change in WORD_PASSES:
        new = [(w, change(w)) for w in parts]
        hits.append([(w, x) for w, x in new if x is not None])
        parts = " ".join(w if x is None else x for w, x in new).split(" ")
    return " ".join(parts), tuple(hits) if any(hits) else ()


#: Built without a session: workers import this module. n counts what the log lists; marked: holds a Hinglish marker; deva
#: and latin: holds a letter of that script.
_PLAIN = [T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.BooleanType()) for c in ("marked", "deva", "latin"))]
CLEANED = T.StructType(_PLAIN)
CLEANED_LOGGED = T.StructType([*_PLAIN, T.StructField("log", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("type", "original", "transformed")])))])
#: Longest word that a worker remembers; texts that are Python objects at once, and their bytes but for a longer one.
WORD_KNOWN_CHARS, SLICE, SLICE_CHARS = 64, 512, 4_000_000
#: Bytes of the texts that a worker is sent at once.
BATCH_BYTES = 8_000_000

_ZERO_WIDTH, _ODD = re.compile(f"[{C.ZERO_WIDTH}]+"), re.compile(f"[^{NFKC_STABLE}]")
_LOOKALIKES = {a: b for a, b in reversed(list(zip(C.CONFUSABLE_FROM, C.CONFUSABLE_TO, strict=True)))}
_LOOKALIKE = re.compile(f"[{C.CONFUSABLE_FROM}]")
#: The lookbehind stands last, so that a search goes from one of the first characters to the next.
_SPACER, _DOT = re.compile(rf"[.\-_*~^](?=[{LETTER}])(?<=[{LETTER}].)"), re.compile(C.BRACKETED_DOT)
_ZERO, _ONE = re.compile("0(?=[a-zA-Z])(?<=[a-zA-Z]0)"), re.compile("1(?=[a-zA-Z])(?<=[a-zA-Z]1)")
_SEPARATORS, _WHITE = re.compile(r"[\x1C-\x1F]"), re.compile(r"[^\S\x1C-\x1F]+")  # those four are white space to Python only


def _without_repeats(text: str) -> tuple[str, list[str]]:
    """A text with one ASCII letter for each run of three or more, in any case, and these runs."""
    whole = text.encode("utf-8", "surrogatepass")
    b, own = np.frombuffer(whole.lower(), np.uint8), np.frombuffer(whole, np.uint8)
    same = b[1:] == b[:-1]
    at = np.flatnonzero(same[1:] & same[:-1])
    at = at[(b[at] >= 97) & (b[at] <= 122)]
    if not len(at):
        return text, []
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    ends = at[np.r_[first[1:] - 1, len(at) - 1]] + 3
    kept = np.ones(len(b), bool)
    kept[at + 1] = kept[at + 2] = False
    runs = [whole[a:z].decode("ascii") for a, z in zip(at[first].tolist(), ends.tolist(), strict=True)]
    return own[kept].tobytes().decode("utf-8", "surrogatepass"), runs


#: What a key of a word leaves out: all bytes but small letters, and the digits and marks that may stand for letters. A key
#: of letters that is not listed belongs to a word that no pass changes; the listed ones are letters and digits only.
_MARKS = "".join(c for c in C.LEET_FROM if c.isascii())
_NO_KEY = bytes(set(range(256)) - set(f"abcdefghijklmnopqrstuvwxyz {_MARKS}".encode()))
_MARK = np.isin(np.arange(256), np.frombuffer(_MARKS.encode(), np.uint8))
_OTHER_MARKS = [c for c in C.LEET_FROM if not c.isascii()]
_DEVANAGARI, _LATIN = "[ऀ-ॿ]", "[a-zA-Z]"
_MARKED = f"(^| )({'|'.join(C.HINGLISH_MARKERS)})($| )"


def _suspects(texts: list[str]) -> list[list[int]]:
    """For each text the numbers of the words, between spaces, that a pass may change. All keys are looked up at once."""
    lows = [t.lower() for t in texts]
    for c in _OTHER_MARKS:
        lows = [t if t.isascii() else t.replace(c, _MARKS[0]) for t in lows]
    keys = [t.encode("utf-8", "replace").translate(None, _NO_KEY) for t in lows]
    line, starts = b" ".join(keys), np.cumsum([0, *(k.count(b" ") + 1 for k in keys)])
    letters = np.frombuffer(line, np.uint8)
    marked = np.searchsorted(np.flatnonzero(letters == 32), np.flatnonzero(_MARK[letters]))
    listed = pc.is_in(pc.split_pattern(pa.array([line], pa.large_binary()), b" ").values, pa.array([w.encode() for w in _LISTED], pa.large_binary()))
    found = np.union1d(marked, np.flatnonzero(listed.to_numpy(zero_copy_only=False)))
    ends = np.searchsorted(found, starts)
    return [(found[a:z] - at).tolist() for at, a, z in zip(starts, ends, ends[1:], strict=False)]


@lru_cache(maxsize=1 << 14)
def _known(word: str) -> tuple[str, tuple]:
    return restore_word(word)


def _characters(text: str, passed: Callable[[str, str, str], str], repeats: Callable[[str], str]) -> str:
    """A text after the passes that look at characters, not at words."""
    if not text.isascii():
        text = passed("ZERO_WIDTH", text, _ZERO_WIDTH.sub("", text))
        new = unicodedata.normalize("NFKC", text) if not unicodedata.is_normalized("NFKC", text) and _ODD.search(text) else text
        text = passed("CONFUSABLE", text, _LOOKALIKE.sub(lambda m: _LOOKALIKES[m[0]], new))
    text = passed("PUNCTUATION", text, _SPACER.sub("", text))
    if "[" in text or "(" in text or "{" in text:
        text = passed("DOMAIN_BRACKETS", text, _DOT.sub(".", text))
    text = repeats(text)
    new = _ZERO.sub("o", text) if "0" in text else text
    return passed("OCR_DIGIT", text, _ONE.sub("l", new) if "1" in new else new)


def clean_all(texts: list[str], log: bool = False) -> tuple[list, list[str], list[str]]:
    """(columns of CLEANED or CLEANED_LOGGED, the texts after all passes, the same in lower case). A pass over the whole text has one entry in the log, with the first 80 characters before and after."""
    counts, logs, found = [0] * len(texts), [[] for _ in texts], []

    def passed(kind: str, before: str, after: str) -> str:
        if before != after:
            counts[i] += 1
            if log:
                logs[i].append((kind, before[:80], after[:80]))
        return after

    def repeats(text: str) -> str:
        after, runs = _without_repeats(text)
        counts[i] += len(runs)
        if log:
            logs[i] += [("REPEATED", r, r[:1]) for r in runs]
        return after

    for i, text in enumerate(texts):
        found.append(_characters(text, passed, repeats))
    for i, suspects in enumerate(_suspects(found)):
        text, hits = found[i], []
        if suspects:
            words = text.split(" ")
            for at in suspects:
                word, hit = _known(words[at]) if len(words[at]) <= WORD_KNOWN_CHARS else restore_word(words[at])
                if hit:
                    words[at] = word
                    hits.append(hit)
        if hits:
            text = " ".join(words)
            counts[i] += sum(len(x) for h in hits for x in h)
            if log:
                logs[i] += [(kind, a, b) for k, (kind, _) in enumerate(WORD_PASSES) for h in hits for a, b in h[k]]
        found[i] = passed("WHITE_SPACE", text, _WHITE.sub(" ", text).strip(" ") if _SEPARATORS.search(text) else " ".join(text.split()))
    lows = [t.lower() for t in found]
    done, low = pa.array(found, pa.large_string()), pa.array(lows, pa.large_string())
    flags = [pc.match_substring_regex(t, p) for t, p in ((low, _MARKED), (done, _DEVANAGARI), (done, _LATIN))]
    return [done, counts, *flags, *([logs] if log else [])], found, lows


def slices(*texts: pa.Array) -> Iterator[tuple[list[str], ...]]:
    """Arrow arrays slice by slice, as Python objects: SLICE texts at most, or SLICE_CHARS bytes. A null text counts as empty."""
    sizes = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts)
    before, at = np.r_[0, np.cumsum(sizes)], 0
    while at < len(texts[0]):
        n = min(SLICE, max(1, int(np.searchsorted(before, before[at] + SLICE_CHARS, "right")) - 1 - at))
        yield tuple([x or "" for x in t.slice(at, n).to_pylist()] for t in texts)
        at += n


def in_columns(found: Callable[..., list], kind: T.StructType, *texts: pa.Array) -> pa.Array:
    """The columns that found() gives of the texts of each slice, as structs: only so many texts, and what is found in them,
    are Python objects at once."""
    fields = list(to_arrow_schema(kind))
    parts = []
    for some in slices(*texts):
        columns = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(found(*some), fields, strict=True)]
        parts.append(pa.StructArray.from_arrays(columns, fields=fields))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))


def in_slices(row, kind: T.StructType, *texts: pa.Array) -> pa.Array:
    """row(text, ...) of Arrow arrays; see in_columns()."""
    return in_columns(lambda *some: zip(*(row(*x) for x in zip(*some, strict=True)), strict=True), kind, *texts)


def _sliced(texts: pa.Array, kind: T.StructType, log: bool) -> pa.Array:
    """clean_all() of an Arrow array."""
    return in_columns(lambda some: clean_all(some, log)[0], kind, texts)


@F.arrow_udf(CLEANED)
def cleaned(texts: pa.Array) -> pa.Array:
    """The passes over whole texts, with the number of log entries."""
    return _sliced(texts, CLEANED, False)


@F.arrow_udf(CLEANED)
def detected(texts: pa.Array) -> pa.Array:
    """cleaned() without the texts."""
    return in_columns(lambda some: [[None] * len(some), *clean_all(some)[0][1:]], CLEANED, texts)


@F.arrow_udf(CLEANED_LOGGED)
def cleaned_logged(texts: pa.Array) -> pa.Array:
    """The passes over whole texts, with their log."""
    return _sliced(texts, CLEANED_LOGGED, True)


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows. From now on their session sends BATCH_BYTES at once to a Python worker at most, but for a longer row: what
    a worker holds is then bounded by this, not by the length of 10 000 texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def normalize(df: DataFrame, text_col: str = "raw_text", max_chars: int | None = None, log: bool = True, passes: Callable | None = None, keep_text: bool = True, vectors: bool = False) -> DataFrame:
    """Adds normalized_text, transformations (log), n_transformations, text_confidence, language and scripts.

    A projection, no shuffle: the texts go through one Arrow pass, in small slices. max_chars cuts the text first, as a
    service with a message limit would. Without log, transformations are only counted; without keep_text the normalised text
    is left in the worker. A null text counts as empty. passes is what the texts go through instead of clean_all(), if it
    finds more than that; what it finds is then in _signals, and with vectors in embedding.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = in_small_batches(df)
    if passes:
        found = passes(F.col(text_col))
    else:
        found = (cleaned_logged if log else cleaned if keep_text else detected)(F.substring(text, 1, max_chars) if max_chars else text)
    df = df.withColumn("_c", found).withColumn("n_transformations", F.col("_c.n")).withColumns({f"_{c}": F.col(f"_c.{c}") for c in ("marked", "deva", "latin")})
    if keep_text:
        df = df.withColumn("normalized_text", F.col("_c.text"))
    if log:
        df = df.withColumn("transformations", F.col("_c.log"))
    if passes:
        df = df.withColumn("_signals", F.col("_c.signals"))
    if vectors:
        df = df.withColumn("embedding", F.col("_c.vector"))
    df = df.drop("_c").withColumn("text_confidence", F.greatest(F.lit(0.1), 1 - 0.03 * F.col("n_transformations")))
    df = barrier(df, *(["normalized_text"] if keep_text else []), "n_transformations", "text_confidence", "_marked", "_deva", "_latin", *(["transformations"] if log else []), *(["_signals"] if passes else []), *(["embedding"] if vectors else []))
    return language_of(df, F.col("_marked"), F.col("_deva"), F.col("_latin")).drop("_marked", "_deva", "_latin")


def detect_language(df: DataFrame, text_col: str = "normalized_text") -> DataFrame:
    """Adds language (hi, hinglish, en, unknown) and scripts."""
    t = F.col(text_col)
    return language_of(df, F.arrays_overlap(F.split(F.lower(t), r"(?U)\s+"), text_literals(C.HINGLISH_MARKERS)), t.rlike(_DEVANAGARI), t.rlike(_LATIN))


def language_of(df: DataFrame, marked: Column, deva: Column, latin: Column) -> DataFrame:
    """Adds language and scripts; marked: holds a Hinglish marker, deva and latin: a letter of that script."""
    language = F.when(deva, "hi").when(latin & marked, "hinglish").when(latin, "en").otherwise("unknown")
    return barrier(df.withColumn("language", language).withColumn("scripts", F.array_compact(F.array(F.when(deva, F.lit("Deva")), F.when(latin, F.lit("Latn"))))), "language", "scripts")
