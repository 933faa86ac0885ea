"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"


def barrier(df: DataFrame, *derived: str) -> DataFrame:
    """The same rows with the derived columns (all, where none are named) behind a generator: what is built on them is not
    rewritten into their long expressions. Other columns pass by it, so they are still left out where nothing reads them."""
    derived = derived or tuple(df.columns)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in derived]
    return df.select(*rest, F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in derived)))))


def half_even(c: Column, digits: int) -> Column:
    """Rounded half to even, after ninth decimals have gone, so that sums of decimals round as decimals do."""
    return F.bround(F.round(c, 9), digits)


def words(pattern: str) -> str:
    """A pattern between word boundaries that hold for all scripts, whatever the Java version makes of \\b."""
    return rf"(?<![{WORD}])(?:{pattern})(?![{WORD}])"


def text_literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def text_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def first_match(column: Column, pattern: str, group: int = 0) -> Column:
    """What the pattern finds first, or null."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def mapped(key: Column, values: dict[str, str], otherwise: Column) -> Column:
    """values[key], else otherwise. The set test is hashed; only hits search the map."""
    return F.when(key.isin(*values), F.try_element_at(text_map(values), key)).otherwise(otherwise)


def url_part(url: Column, part: str) -> Column:
    """scheme, userinfo, host, port, path, query or fragment of a URL, or null; after RFC 3986, appendix B."""
    group = {"scheme": 1, "userinfo": 2, "host": 3, "port": 4, "path": 5, "query": 6, "fragment": 7}[part]
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]?|[^/?#:]*)(?::([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", group)


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"), url).otherwise(F.concat(F.lit("http://"), url))


def html_escape(c: Column) -> Column:
    """Trimmed, with the five markup characters as references."""
    return markup_escape(F.trim(c))


def markup_escape(c: Column) -> Column:
    """The five markup characters as references."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(ref))
    return c
