"""Security views of a text: what it says once look-alike characters, one layer of escapes and punctuation are seen through.

A text's views are, without repeats: its compatibility form, that without marks, both after one layer of escapes is
undone, and the token view of each. A text of printable ASCII without '%', '&' or '\\' has two views at most, which are
made in the JVM; for such rows the Arrow function gets a null and does nothing. Null texts have no views.
"""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.functions import shipping

# What stands for the end of a sentence in a token view, what ends one, apostrophes, dots.
BREAK, ENDS = "", ".!?;\n\r"
APOSTROPHES = dict.fromkeys((0x02BC, 0x2018, 0x2019, 0x201B), "'")
DOTS = dict.fromkeys((0x3002, 0xFF0E, 0xFF61), ".")
MINUS = "⁃−"

_ESCAPE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|%u([0-9A-Fa-f]{4})|\\([0-7]{3})")
_STOP, _SIGN, _BLANK = re.compile(f"[{re.escape(ENDS)}]"), regex.compile(r"[\p{P}\p{S}]"), re.compile(r"\s+")
#: texts beyond this need Python
SPECIAL = r"[^\x09\x0A\x0D\x20-\x7E]|[%&\\]"


def compatible(text: str) -> str:
    """Compatibility form with plain apostrophes."""
    return text if text.isascii() else unicodedata.normalize("NFKC", text).translate(APOSTROPHES)


def unmarked(text: str) -> str:
    """Decomposed compatibility form without marks."""
    return text if text.isascii() else regex.sub(r"\p{M}", "", unicodedata.normalize("NFKD", compatible(text)))


def decoded(text: str) -> str:
    """text with one layer of percent, entity and backslash escapes undone."""

    def sign(m: re.Match[str]) -> str:
        code = int(m[m.lastindex], 8 if m.lastindex == 5 else 16)
        return m[0] if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)

    return _ESCAPE.sub(sign, html.unescape(unquote(text))) if {*"%&\\"} & {*text} else text


def tokens(text: str) -> str:
    """text with sentence ends as BREAK and other punctuation and signs as spaces."""
    return _BLANK.sub(" ", _SIGN.sub(" ", _STOP.sub(f" {BREAK} ", text))).strip()


def views_of(text: str) -> list[str]:
    forms = [compatible(text), unmarked(text)]
    for form in [decoded(f) for f in forms]:
        forms += [compatible(form), unmarked(form)]
    return list(dict.fromkeys([*forms, *map(tokens, dict.fromkeys(forms))]))


def with_views(df: DataFrame, text_col: str, out: str = "views") -> DataFrame:
    """df with the distinct normal forms of a text column, the compatible and the unmarked one; null texts have none."""
    shipping.send(df.sparkSession)
    odd = F.col(text_col).rlike("[^\\x00-\\x7F]")
    own = F.when(F.col(text_col).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(text_col)))
    return df.withColumn(out, F.when(odd, _forms(F.when(odd, F.col(text_col)))).otherwise(own))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _forms(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else list(dict.fromkeys([compatible(t), unmarked(t)])) for t in texts.to_pylist()], pa.list_(pa.string()))


def contact_form(text: str) -> str:
    """Compatibility form in which all decimal digits, dashes and ideographic full stops are ASCII."""
    text = compatible(text).translate(DOTS)
    return text if text.isascii() else regex.sub(rf"[\p{{Pd}}{MINUS}]", "-", regex.sub(r"\p{Nd}", lambda m: str(unicodedata.decimal(m[0])), text))


def phone_form(text: str) -> str:
    """text with numbers of one digit as ASCII digits and each run of punctuation, signs and spaces, but '+', as one dash."""

    def digit(m) -> str:
        value = unicodedata.numeric(m[0], -1)
        return str(int(value)) if value in range(10) else m[0]

    plain = text if text.isascii() else regex.sub(r"[\p{N}\p{Lo}]", digit, text)
    return regex.sub(r"(?:[^\P{P}]|[^\P{S}+]|[\p{Z}\s])+", "-", plain)


def id_form(text: str) -> str:
    """Compatibility form of an identifier with its separators as spaces."""
    return re.sub(r"[._:-]+", " ", compatible(text))


def compact_forms(text: str) -> list[str]:
    """The case-folded views of a text without white space: whole, without signs at the ends, and word by word."""
    out: list[str] = []
    for view in views_of(text):
        parts = [p.casefold() for p in view.split()]
        for form in ["".join(parts), *parts]:
            out += [form, form.strip("".join(c for c in set(form) if not c.isalnum()))]
    return [f for f in dict.fromkeys(out) if f]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _special(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else views_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def token_view(text: Column) -> Column:
    """The token view of an ASCII text."""
    signs = F.regexp_replace(F.regexp_replace(text, "[.!?;\\n\\r]", f" {BREAK} "), "[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]", " ")
    return F.trim(F.regexp_replace(signs, "\\s+", " "))


def plain(text: Column) -> Column:
    """array<string>: a text and its token view, without Python; what views() gives for ordinary ASCII."""
    return F.array_distinct(F.array(text, token_view(text)))


def views(text: Column) -> Column:
    """array<string>: the views of text; null for null. shipping.send() must have run for Python to find this module."""
    odd = text.rlike(SPECIAL)
    return F.when(odd, _special(F.when(odd, text))).otherwise(plain(text))
