"""Quality rules as a short-circuit cascade.

Every rule is a native expression that says whether a document is rejected. On a bounded sample of rows each rule is
timed and its share of rejections counted; the rules then run in the order of rejections per second, and a document
that one rule rejects is not looked at by the later ones. The order changes only the work: the verdict is that of all
rules together, so a rerun with another order gives the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.text import SPACE_CHARS, WORD, text_or_empty, words
from vigil.shared import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"  # fixed by the output contract

#: Rejections: name and expression over the text column ``text`` and the base columns.
RULES: dict[str, Column | Callable[[], Column]] = {
    "too many symbols": lambda: F.col("n_symbols") > 0.2 * F.col("n_words"),
    "words too short or too long": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    "lines repeat": lambda: F.col("n_dup_lines") > 0.5 * F.size(F.split("text", "\n", -1)),
    "mostly capitals": lambda: _octets_without("[A-Z]+") > 0.5 * F.col("word_chars"),
    "exclamations": lambda: _octets_without("!+") > 0.5 * F.col("n_words"),
    "few letters": lambda: F.char_length(F.regexp_replace("text", r"[^\p{L}]+", "")) < 0.5 * F.col("word_chars"),
}


def _octets_without(pattern: str) -> Column:
    """How many ASCII characters of the text match ``pattern``."""
    return F.octet_length("text") - F.octet_length(F.regexp_replace("text", pattern, ""))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(tokens: Column) -> Column:
    """Number of words that stand in a 3-word window found twice or more in the array; windows compare by hash."""

    def covered(hashes: Column) -> Column:
        at = _bound(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"]))
                    | F.coalesce(F.get(s, k + 1)["h"] == F.get(s, k)["h"], F.lit(False)),
                ),
                lambda k: F.get(s, k)["i"],
            ),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

    hashes = _bound(tokens, windows)
    count = _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(tokens) < 3, F.lit(0)).otherwise(count).cast("long")


def base_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null: empty) and the base columns of the output contract."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.octet_length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    return (
        rows.withColumns({"_words": words(F.col("text")), "_lines": lines})
        .select(
            "id", "text",
            F.size("_words").cast("long").alias("n_words"),
            F.char_length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
            _octets_without(SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_words")).alias("n_repeat_words"),
        )
        .withColumn(
            "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        )
    )


def rule_order(sample: DataFrame, rules: dict[str, Column], clock: Callable[[], float] = time.perf_counter) -> list[str]:
    """Rule names by rejected share of the sample per second, the best first."""
    rows = max(sample.count(), 1)
    worth = {}
    for name, rule in rules.items():
        began = clock()
        rejected = sample.agg(F.count_if(rule)).first()[0]
        worth[name] = rejected / rows / max(clock() - began, 1e-6)
    return sorted(rules, key=lambda name: (-worth[name], name))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """True if no rule rejects; a later rule is computed only where the earlier ones passed."""
    out = F.lit(True)
    for name in reversed(order):
        out = F.when(rules[name], F.lit(False)).otherwise(out)
    return out


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict | None = None, sample_rows: int = 2000
) -> DataFrame:
    """One row per document: id, the base columns, base_failed and kept.

    A null or empty text has no words, so it fails the base. Repeated rows each get their own result; an empty table
    gives an empty one. Whole texts are measured, whatever their length; other columns are not read. At most about
    ``sample_rows`` rows serve to order the rules; the verdict does not depend on them.
    """
    named = {name: rule() if callable(rule) else rule for name, rule in (RULES if rules is None else rules).items()}
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    picked = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 53)) < int(share * (1 << 53)))
    sample = written(base_columns(picked, id_col, text_col), "sample")
    order = rule_order(sample, named)
    rows = base_columns(docs, id_col, text_col)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(cascade(named, order), F.lit(True)))
    return rows.withColumn("kept", kept).drop("text").withColumnRenamed("id", id_col)
