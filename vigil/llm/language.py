"""Language identification by nearest centroids.

A text is a vector of hashed byte n-grams (one to three bytes, letters folded, everything that is no letter a space),
weighted by TF-IDF and normalised. Each language has several centroids, found by clustering the vectors of a bounded
sample of its labelled texts; a text gets the language of the centroid with the largest cosine. A text is rejected when
its distance to that centroid is beyond what all but a hundredth of the language's own texts of about that length or
longer showed, with a margin.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.llm.arrow_text import lean, slices, utf8
from vigil.llm.text import apart
from vigil.shared import written

DIMS = 8192
MAX_LABELS = 1000  # bounds the table of labels and the centroids, which go to every task
LENGTHS = 24  # classes of text length, by powers of two
FLOOR_TEXTS = 20  # that a floor is taken from, at least
PART, ROWS = 1_000_000, 64  # bytes of text, and rows of counts, that a prediction holds at a time
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a"):ord("z") + 1] = _FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _spread(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - 13)


class Grams:
    """The hashed n-grams of several texts and their counts by text."""

    def __init__(self, column: pa.Array):
        data, self.offsets = utf8(column)
        folded = _FOLD[data]
        two = folded[:-1] << np.uint32(8) | folded[1:]
        three = two[:-1] << np.uint32(8) | folded[2:]
        self.coded = [_spread(folded), _spread(two | np.uint32(1 << 24)), _spread(three | np.uint32(1 << 25))]
        self.ascii_letter = (folded != 0x20) & (folded < 0x80)
        self.other = data >= 0x80
        self.column = column

    def has_letter(self, i: int) -> bool:
        a, b = self.offsets[i:i + 2]
        return bool(self.ascii_letter[a:b].any()) or (
            bool(self.other[a:b].any()) and any(map(str.isalpha, self.column[i].as_py()))
        )

    def counts(self, i: int) -> np.ndarray:
        a, b = self.offsets[i:i + 2]
        out = np.zeros(DIMS, np.int64)
        for n, codes in enumerate(self.coded):
            if b - n > a:
                out += np.bincount(codes[a:b - n], minlength=DIMS)
        return out


def _normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _length_class(grams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(grams, 1)).astype(int), LENGTHS - 1)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _normalised(np.log1p(counts) * idf).astype(np.float32)


def _clusters(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from centres that lie far apart; the centroids and each row's cosine to the nearest."""
    centres = _normalised(x.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        centres = _normalised(np.vstack([x[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))]))
    return centres.astype(np.float32), (x @ centres.T).max(axis=1)


def _floors(cosine: np.ndarray, lengths: np.ndarray, low: float, margin: float) -> np.ndarray:
    """Per length class the least cosine that is accepted: the quantile ``low`` of the sample's texts of this or any longer class, less a margin.

    Where fewer than FLOOR_TEXTS are that long, the longest FLOOR_TEXTS count.
    """
    longest = cosine[np.argsort(-lengths, kind="stable")]
    n = np.array([np.count_nonzero(lengths >= c) for c in range(LENGTHS)])
    floors = np.array([np.quantile(longest[:k], low) for k in np.maximum(n, min(FLOOR_TEXTS, len(longest)))])
    shorter = np.arange(LENGTHS) < lengths.min()
    floors[shorter] *= 0.5 ** (lengths.min() - np.arange(LENGTHS)[shorter])  # shorter than all that was seen: ask for less
    return floors * (1 - margin)


class Model(NamedTuple):
    """Languages by number, their centroids (one row each), the floors by length, and the n-gram weights."""

    languages: list[str]
    language: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray


def _sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows (id, text, lang) of each language, those of the smallest hashes."""
    hashed = docs.withColumn("h", F.xxhash64(F.lit("language"), F.col("id")))
    counts = written(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "_lang"), "labels")
    if counts.count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    near = hashed.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).filter(share * F.col("n") < 2 * per_language)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("id", "text", "lang", "rank")


def fit(docs: DataFrame, per_language: int = 300, clusters: int = 4, rounds: int = 8, low: float = 0.01, margin: float = 0.2) -> Model:
    """A model from labelled rows (id, text, lang); rows without text, letter or label are no help and are left out.

    The sample is bounded by ``per_language`` rows for each label; what reaches the driver are the n-gram weights and
    ``clusters`` centroids for each label, of a fixed width.
    """
    sample = _sampled(docs.filter("text is not null and lang is not null"), per_language)

    def vectorise(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                grams = Grams(batch.column("text"))
                keep = [i for i in range(batch.num_rows) if grams.has_letter(i)]
                counts = [grams.counts(i) for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang").take(pa.array(keep, pa.int64())), batch.column("rank").take(pa.array(keep, pa.int64())),
                        pa.array([np.flatnonzero(c).astype(np.int32) for c in counts], pa.list_(pa.int32())),
                        pa.array([c[c > 0] for c in counts], pa.list_(pa.int64())),
                    ],
                    names=["lang", "rank", "dims", "counts"],
                )

    vectors = written(sample.mapInArrow(lean(vectorise), "lang string, rank int, dims array<int>, counts array<long>"), "ngrams")
    texts = vectors.count()
    idf = np.full(DIMS, np.log1p(texts), np.float64)
    for row in vectors.select(F.explode("dims").alias("dim")).groupBy("dim").count().collect():
        idf[row["dim"]] = np.log1p(texts / row["count"])

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        counts = np.zeros((len(rows), DIMS))
        for i, (dims, n) in enumerate(zip(rows["dims"], rows["counts"], strict=True)):
            counts[i, dims] = n
        centres, cosine = _clusters(_vectors(counts, idf), clusters, rounds)
        floors = _floors(cosine, _length_class(counts.sum(axis=1)), low, margin)
        return pd.DataFrame({
            "lang": rows["lang"].iloc[0], "cluster": np.arange(len(centres)), "centroid": list(centres),
            "floors": [floors] * len(centres),
        })

    schema = "lang string, cluster int, centroid array<float>, floors array<double>"
    fitted = sorted(vectors.groupBy("lang").applyInPandas(cluster, schema).collect(), key=lambda r: (r["lang"], r["cluster"]))
    languages = sorted({r["lang"] for r in fitted})
    return Model(
        languages, np.array([languages.index(r["lang"]) for r in fitted], int),
        np.array([r["centroid"] for r in fitted], np.float32).reshape(len(fitted), DIMS),
        np.array([r["floors"] for r in fitted]).reshape(len(fitted), LENGTHS), idf,
    )


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with _lang, _score and _accepted; ``und``, 0 and false for a null text or one without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size fixed by the labels and the width

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text_col, PART):
                column = batch.column(text_col)
                grams = Grams(column)
                lang = np.full(batch.num_rows, "und", object)
                score, accepted = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
                usable = [i for i in range(batch.num_rows) if len(m.languages) and grams.has_letter(i)]
                for at in range(0, len(usable), ROWS):
                    part = usable[at:at + ROWS]
                    counts = np.array([grams.counts(i) for i in part])
                    cosine = _vectors(counts, m.idf) @ m.centroids.T
                    best = cosine.argmax(axis=1)
                    top = np.clip(cosine[np.arange(len(part)), best].astype(float), 0, 1)
                    lang[part] = [m.languages[m.language[b]] for b in best]
                    score[part] = top
                    accepted[part] = top >= m.floors[best, _length_class(counts.sum(axis=1))]
                out = batch
                for name, values in (("_lang", pa.array(lang, pa.string())), ("_score", pa.array(score)), ("_accepted", pa.array(accepted))):
                    out = out.append_column(name, values)
                yield out

    rows = docs.drop("_lang", "_score", "_accepted")
    schema = StructType(list(rows.schema)).add("_lang", "string").add("_score", "double").add("_accepted", "boolean")
    return rows.mapInArrow(lean(run), schema)


def held_out(id_col: str) -> Column:
    """Fixed by the output contract: the third of the documents that is never learned from."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """Learned from the rows outside the held-out third; rows without an id are not learned from either."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("out")
    )
    return fit(rows.filter("not out and id is not null").drop("out"), **options)


def language_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, accepted.

    ``lang_pred`` is the nearest language even where the distance says reject; ``und`` stands for texts that are null or
    have no letter. Repeated rows each get a result, an empty table gives none, and whole texts are read.
    """
    model = trained(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return predict(rows, model, "text").select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"), F.col("_accepted").alias("accepted"),
    )


@apart
def accepted_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; the columns stay as they are."""
    model = trained(docs, id_col, text_col, lang_col, **options)
    return predict(docs, model, text_col).filter("_accepted").select(*[F.col(f"`{c}`") for c in docs.columns])
