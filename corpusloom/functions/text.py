"""Text columns: words, white space, lines and paragraphs, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, digits and underscores of any script (Java's ``\w`` is ASCII only).
WORD = r"[\p{L}\p{N}_]+"
#: What Python's ``str.strip`` takes off.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PARAGRAPH = r"\n{2,}"


def words(text: Column) -> Column:
    """Lower-cased words in order, repeats included; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def paragraphs(text: Column) -> Column:
    return F.split(text, PARAGRAPH)


def newlines(text: Column) -> Column:
    """How many line feeds a text holds."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clipped(text: Column, most: int, mark: str) -> Column:
    """A text's first ``most`` characters with ``mark`` behind, or the text if it is no longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def preview(text: Column, most: int = 200) -> Column:
    """The beginning of a text on one line, always with an ellipsis."""
    return F.concat(strip(F.translate(F.substring(text, 1, most), "\n", " ")), F.lit("…"))
