"""Column functions on log lines: tokens, categories, structure, identifiers.

A token is a maximal run of one character class.  Classes are those of bytes in
the C locale, so text is looked at as bytes: `as_bytes` turns it into a string
with one character a byte, and `from_bytes` turns pieces of it back.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: place, alpha, digit, symbol, space and other runs, in this order
TOKEN = r"(\$+|[A-Za-z]+|[0-9]+|[!-#%-/:-@\[-`{-~]+|[ \t\n\x0B\f\r]+|[^\x21-\x7E \t\n\x0B\f\r]+)"
_TOKEN = re.compile(TOKEN)
#: one-letter categories
ALPHA, DIGITS, SYMBOL, SPACE, PLACE, NONE = "A", "D", "@", "S", "$", "N"
#: fixed values: foreground colours in the order in which placeholders take them, and the reset
PALETTE = ["\x1b[0;31m", "\x1b[0;32m", "\x1b[0;33m", "\x1b[0;34m", "\x1b[0;35m", "\x1b[0;36m", "\x1b[1;31m", "\x1b[1;32m", "\x1b[1;33m", "\x1b[1;34m", "\x1b[1;35m", "\x1b[1;36m", "\x1b[1;30m"]
RESET, BULLET_COLOUR, ALERT_COLOUR = "\x1b[0m", "\x1b[1;33m", "\x1b[1;31m"
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
WHITE = r"[ \t\n\x0B\f\r]"


def as_bytes(c: Column) -> Column:
    """Text as one character a byte; bytes that are not UTF-8 keep their values."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def from_bytes(c: Column) -> Column:
    """Back from one character a byte, to the very bytes."""
    return F.encode(c, "ISO-8859-1").cast("string")


def trim(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def tokens(c: Column) -> Column:
    """array<string> of a line's tokens, one character a byte; empty for an empty line."""
    return F.regexp_extract_all(as_bytes(c), F.lit(TOKEN), F.lit(1))


def _class_of(c: str) -> str:
    """Category of a byte's character, by the classes of TOKEN."""
    if c == "$":
        return PLACE
    if c.isascii() and c.isalpha():
        return ALPHA
    if c.isascii() and c.isdigit():
        return DIGITS
    if "!" <= c <= "~":
        return SYMBOL
    return SPACE if c in " \t\n\x0b\f\r" else NONE


_BYTES = "".join(map(chr, range(256)))
_CLASSES = "".join(map(_class_of, _BYTES))


def category(token: Column) -> Column:
    return F.translate(F.substring(token, 1, 1), _BYTES, _CLASSES)


def structure(tokens_: Column) -> Column:
    """array<struct<cat, len>>: what distances between lines look at."""
    return F.transform(tokens_, lambda t: F.struct(category(t).alias("cat"), F.length(t).alias("len")))


def signature(tokens_: Column) -> Column:
    """The structure as one string, such as A5S1D3; equal exactly for equal structures."""
    return F.array_join(F.transform(tokens_, lambda t: F.concat(category(t), F.length(t).cast("string"))), "")


def token_rows(tokens_: Column) -> Column:
    """array<struct<pos, lower, upper, cat, text>>: tokens with their byte intervals."""
    before = lambda i: F.aggregate(F.slice(tokens_, F.lit(1), i), F.lit(0), lambda a, t: a + F.length(t))
    return F.transform(tokens_, lambda t, i: F.struct(i.alias("pos"), before(i).alias("lower"), (before(i) + F.length(t)).alias("upper"), category(t).alias("cat"), t.alias("text")))


def strip_ansi(c: Column, carriage_returns: bool = False) -> Column:
    """Without terminal control sequences, and without carriage returns if asked."""
    return F.regexp_replace(c, ANSI + (r"|\r" if carriage_returns else ""), "")


def identifier(c: Column) -> Column:
    """The five characters of the first `$XXXXX,`, else UNKNOWN."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\$([A-Z0-9]{5})(?=,)", 1), F.lit("")), F.lit("UNKNOWN"))


def subset_text(tokens_: Column, offset: Column, length: Column) -> Column:
    """Text of `length` tokens from `offset` (0-based)."""
    return F.array_join(F.slice(tokens_, offset + 1, length), "")


# the same on the driver, for template files and reports

def split_tokens(text: str) -> list[str]:
    """Tokens of a text, one character a byte."""
    return _TOKEN.findall(text.encode().decode("latin-1"))


def shown(token_list: list[str]) -> str:
    return "".join(token_list).encode("latin-1").decode("utf-8", "replace")
