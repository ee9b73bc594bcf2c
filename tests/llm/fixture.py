"""A small table of documents with the cases that operators must bear."""

import random

from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key string, n string, "
    "words string, size string, `batch` string, kept string, label string"
)
EXTRA = (7, "r", "k", "n", "w", "s", "b", "k", "l")


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows():
    rng = random.Random(5)
    english = [a + b for a in ("the", "and", "of", "ing", "ly", "was", "with") for b in ("", "tion", "er", "est", "ous", "ment")]
    german = [a + b for a in ("der", "und", "sch", "ver", "ein", "ge") for b in ("", "ung", "heit", "keit", "lich", "öst")]
    base = prose(rng, 120, english)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    line = "A common line that stands in many of these documents."
    passage = prose(rng, 60, english)
    texts = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", "a"), (4, None, "en", "a"), (5, "", None, None),
        (6, "   \n\t ", "en", "b"), (7, "one two three", "en", "b"), (8, "one two three", "de", "b"),
        (9, "word " * 3000, "en", "c"), (10, "All rights reserved. CC BY 4.0\nReleased under the MIT License", "en", "c"),
        (11, "cc by cc by the GNU General Public License", "en", None), (12, "\U0001f600 Ünïcode ÀÉ\x1c\x85 text here", "fr", "a"),
        (13, "12 34 56", None, "b"), (14, "x" * 5000, "en", "b"), (15, "tail\n\n\n", "en", "b"), (None, base, "en", "a"),
        (None, "no id here", "en", None), (7, "one two three", "en", "b"),
    ]
    for i in range(20, 32):
        texts.append((i, f"  {line.upper() if i % 2 else line}\t\n{prose(rng, 40 + i, english)}\nshort", "en", "abc"[i % 3]))
    for i in range(40, 50):
        texts.append((i, prose(rng, 70, german), "de", "d"))
    texts += [(60, prose(rng, 30, english) + " " + passage + " " + prose(rng, 20, english), "en", "d"),
              (61, prose(rng, 10, german) + " " + passage + " " + prose(rng, 25, german), "de", "d")]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return documents(spark).filter(F.lit(False))


def texts():
    return [(r[0], r[1]) for r in rows()]
