"""Column expressions on text that several operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the output contracts.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text, as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, unchanged and in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast built-in serves texts of ASCII characters only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator``, which returns the columns it is given, for rows whose columns may be named like its own.

    Its own begin with an underscore, so the given ones that do are called otherwise meanwhile.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        named = {*(a for a in args if isinstance(a, str)), *(a for a in kwargs.values() if isinstance(a, str))}
        names = []
        for i, c in enumerate(docs.columns):
            if c.startswith("_") and c not in named:
                c = f"given_{i}"
                while c in taken:
                    c += "_"
            names.append(c)
        return operator(docs.toDF(*names), *args, **kwargs).toDF(*docs.columns)

    return run
