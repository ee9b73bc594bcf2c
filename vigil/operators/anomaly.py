"""Unusual incidents by an isolation forest (Liu, Ting and Zhou, 2008)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.expr import clean_value, has_weapon, is_yes, rounded, time_period
from vigil.operators.cleaning import stored_codes_of_values
from vigil.operators.learning import prepare_features
from vigil.ordered import quantile_by_step
from vigil.shared import written

CATEGORIES = [
    "crime_type", "crime_category", "crime_severity", "district", "weapon_used", "domestic_related", "gang_related",
    "time_category",
]
NUMBERS = ["latitude", "longitude", "estimated_loss"]


def anomaly_features(df: DataFrame) -> DataFrame:
    """``df`` with a code for each category and the numbers as doubles."""
    return prepare_features(df, CATEGORIES, NUMBERS)


FEATURES = [f"{c}_code" for c in CATEGORIES] + NUMBERS


def _depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, path), leaves with feature -1; the root is node 0."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, level + _depth(len(rows))))
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        split = np.flatnonzero(high > low)
        if level < limit and len(rows) > 1 and len(split):
            f = int(rng.choice(split))
            t = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] <= t
            nodes[at] = (f, t, build(rows[left], level + 1), build(rows[~left], level + 1), 0.0)
        return at

    build(x, 0)
    return nodes


def train_isolation_forest(df: DataFrame, features: list[str], key: str, trees: int = 200, sample: int = 256, seed: int = 42, total: int | None = None) -> DataFrame:
    """The node table (tree, node, feature, threshold, left, right, path).

    Each tree has ``sample`` rows (the method's own parameter) drawn uniformly from the whole table: every tree takes
    each row with a chance that gives about twice as many, the least hashes of these are kept, and the chance doubles
    until every tree has its sample. One hash per row is the gate that tells whether any tree takes it, which is all
    that nearly every row needs; of the others a second hash names the first tree, and one each decides on later trees. ``total`` is the number of
    rows, counted where it isn't given.
    """
    total = df.count() if total is None else total
    want = min(sample, total)
    share = 2.0 * want / max(total, 1)
    rows = df.select(F.col(key).alias("_key"), *features)
    unit = lambda *x: F.shiftrightunsigned(F.xxhash64(*x, F.col("_key")), 11) / F.lit(float(2**53))
    while True:
        if share >= 1.0:
            taken = F.sequence(F.lit(0), F.lit(trees - 1))
            drawn = rows
        else:
            any_tree = -math.expm1(trees * math.log1p(-share))
            drawn = rows.filter(unit(F.lit(f"{seed} gate")) < any_tree)
            first = F.floor(F.log1p(-unit(F.lit(f"{seed} first")) * any_tree) / math.log1p(-share))
            later = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: (t > F.col("_first")) & (unit(F.lit(f"{seed} later"), t) < share))
            drawn = drawn.withColumn("_first", F.least(first.cast("int"), F.lit(trees - 1)))
            taken = F.concat(F.array("_first"), later)
        drawn = drawn.withColumn("tree", F.explode(taken)).withColumn("_h", F.xxhash64(F.lit(f"{seed} order"), "tree", "_key"))
        drawn = written(drawn.select("_key", *features, "tree", "_h"), "forest")
        if share >= 1.0 or drawn.groupBy("tree").count().filter(F.col("count") >= want).count() == trees:
            break
        share *= 2
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_h", "_key"))
    chosen = drawn.withColumn("_rank", rank).filter(F.col("_rank") <= want)
    deepest = math.ceil(math.log2(max(want, 2)))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = rows.sort_values(["_h", "_key"])[features].to_numpy(float)
        nodes = _grow(x, np.random.default_rng([seed, tree]), deepest)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    schema = "tree int, node int, feature int, threshold double, left int, right int, path double"
    return written(chosen.groupBy("tree").applyInPandas(grow, schema), "nodes")


def _even(tree: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as one with all leaves at ``depth``: feature and threshold by place, 1 for the root and 2p and 2p + 1 below p,
    and the path by leaf. Below a leaf of the tree all have its path and any way is right."""
    feature, threshold, path = np.zeros(2**depth, int), np.full(2**depth, np.inf), np.zeros(2**depth)
    here = {1: 0}
    for _ in range(depth):
        below = {}
        for place, node in here.items():
            f, t, left, right, _path = tree[node]
            if f >= 0:
                feature[place], threshold[place] = int(f), t
                below |= {2 * place: int(left), 2 * place + 1: int(right)}
            else:
                below |= {2 * place: node, 2 * place + 1: node}
        here = below
    for place, node in here.items():
        path[place - 2**depth] = tree[node, 4]
    return feature, threshold, path


def _depth_of(tree: np.ndarray) -> int:
    level, depth = np.zeros(len(tree), int), 0
    for node, (f, _t, left, right, _path) in enumerate(tree):  # a node comes before those below it
        if f >= 0:
            level[int(left)] = level[int(right)] = level[node] + 1
            depth = max(depth, int(level[node]) + 1)
    return depth


class _Ways(NamedTuple):
    """A forest laid out for ``_path_lengths``: the sorted thresholds of each feature; per tree a list of levels, and the path
    by leaf. A level has, for each place of it that splits, where its threshold stands among those of all features in a row,
    and which of the places below, those to the left before those to the right, split as well. Bit k of a leaf's number
    tells whether level k went right; where a tree ends early, none of the further bits is set."""

    cuts: list[np.ndarray]
    trees: list[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]]


def _ways(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], features: int) -> _Ways:
    used = lambda f: [t[(feature == f) & (t < np.inf)] for feature, t, _path in trees]
    cuts = [np.unique(np.concatenate([np.zeros(0), *used(f)])) for f in range(features)]
    start = np.cumsum([0, *map(len, cuts)])
    out = []
    for feature, threshold, path in trees:
        leaf, here, levels = np.array([1]), np.array([1]), []
        while len(leaf) < len(path):
            at = [start[f] + np.searchsorted(cuts[f], t) for f, t in zip(feature[here], threshold[here], strict=True)]
            leaf, below = np.concatenate([2 * leaf, 2 * leaf + 1]), np.concatenate([2 * here, 2 * here + 1])
            split = np.flatnonzero(threshold[below] < np.inf) if len(leaf) < len(path) else np.zeros(0, int)
            levels.append((np.array(at, int), split))
            here = below[split]
        out.append((levels, path[leaf - len(path)]))
    return _Ways(cuts, out)


def _beyond(x: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets of rows, a bit each: those above a threshold; and for each threshold, which of the sets it has.

    Thresholds between the same two values of ``x`` share a set, and a set is the one before it without the rows between.
    """
    n = x.shape[1]
    words, row = -(-n // 64), np.arange(n)
    word, bit = row >> 6, np.left_shift(np.uint64(1), (row & 63).astype(np.uint64))
    sets, which, start = [], [], 0
    for values, cut in zip(x, cuts, strict=True):
        rank = np.searchsorted(cut, np.where(np.isnan(values), np.inf, values))  # what is no number goes right
        upto = np.cumsum(np.bincount(rank, minlength=len(cut) + 1) > 0)
        some = np.zeros((upto[-1] + 1, words), np.uint64)
        some[0] = ~np.uint64(0)
        np.add.at(some.reshape(-1), upto[rank] * words + word, bit)
        np.bitwise_xor.accumulate(some, axis=0, out=some)
        sets.append(some)
        which.append(start + upto[:-1])
        start += len(some)
    return np.concatenate(sets), np.concatenate(which)


def _path_lengths(x: np.ndarray, ways: _Ways | list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The paths of all trees summed, for the columns of ``x`` (feature, row): each place of a tree that splits has the set of
    rows that get there, a bit each, and what goes right at a level is a bit of the rows' leaf."""
    n = x.shape[1]
    total = np.zeros(n)
    if not n:
        return total
    ways = ways if isinstance(ways, _Ways) else _ways(ways, len(x))
    sets, which = _beyond(x, ways.cuts)
    most = max((len(split) for levels, _path in ways.trees for _at, split in levels), default=0)
    most = max(most, 1)
    here, above, below = (np.empty((k * most, sets.shape[1]), np.uint64) for k in (1, 1, 2))
    for levels, path in ways.trees:
        depth = len(levels)
        if not depth:
            total += path[0]
            continue
        right = np.empty((depth, sets.shape[1]), np.uint64)
        here[0] = ~np.uint64(0)
        for k, (at, split) in enumerate(levels):
            h = len(at)
            np.take(sets, which[at], axis=0, out=above[:h], mode="clip")
            np.bitwise_and(here[:h], above[:h], out=below[h:2 * h])
            np.bitwise_or.reduce(below[h:2 * h], axis=0, out=right[k])
            if len(split):
                np.bitwise_xor(here[:h], below[h:2 * h], out=below[:h])
                np.take(below[:2 * h], split, axis=0, out=here[:len(split)], mode="clip")
        bits = np.unpackbits(right.astype("<u8", copy=False).view(np.uint8), axis=1, count=n, bitorder="little")
        bits = bits.astype(np.min_scalar_type(len(path) - 1), copy=False)
        leaf = bits[-1]
        for k in reversed(range(depth - 1)):  # doubling adds bytes many at a time, shifting would not
            leaf += leaf
            leaf |= bits[k]
        total += path.take(leaf, mode="clip")
    return total


#: Rows that go down the trees together.
_TOGETHER = 40_000


def path_scores(df: DataFrame, nodes: DataFrame, features: list[str], sample: int = 256) -> DataFrame:
    """``df`` with ``raw``: the forest's decision value, small for unusual rows.

    The node table has at most trees times twice the sample rows, whatever the input, so it goes to every task. Only the
    features go to the Python workers.
    """
    forest = nodes.toPandas().sort_values(["tree", "node"])
    trees = [(t[["feature", "threshold", "left", "right", "path"]].to_numpy(float)) for _, t in forest.groupby("tree")]
    ways = _ways([_even(t, _depth_of(t)) for t in trees], len(features))
    shared = df.sparkSession.sparkContext.broadcast((ways, _depth(sample)))

    @F.arrow_udf("double")
    def raw(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        ways, usual = shared.value

        def decided(parts: list[np.ndarray]) -> pa.Array:
            x = np.concatenate(parts, axis=1)
            paths = [_path_lengths(x[:, i:i + _TOGETHER], ways) for i in range(0, x.shape[1], _TOGETHER)]
            mean = np.concatenate([np.zeros(0), *paths]) / max(len(ways.trees), 1)
            return pa.array(-np.power(2.0, -mean / max(usual, 1e-9)), pa.float64())

        parts = []
        for batch in batches:
            parts.append(np.stack([column.to_numpy(zero_copy_only=False).astype(float) for column in batch]))
            if sum(x.shape[1] for x in parts) >= _TOGETHER:
                yield decided(parts)
                parts = []
        if parts:
            yield decided(parts)

    return df.withColumn("raw", raw(*features))


class Forest(NamedTuple):
    """What scoring needs of the training rows: the node table, the low quantile of their values, the rows per tree."""

    nodes: DataFrame
    offset: DataFrame
    features: list[str]
    sample: int


def _fitted(train: DataFrame, features: list[str], key: str, kept: list[str], contamination: float, total: int | None = None, **options) -> tuple[Forest, DataFrame]:
    """The forest, and the ``kept`` columns of all training rows with their ``raw``, stored."""
    total = train.count() if total is None else total
    nodes = train_isolation_forest(train, features, key, total=total, **options)
    sample = min(options.get("sample", 256), total)
    known = written(path_scores(train.select(*dict.fromkeys([*kept, *features])), nodes, features, sample).select(*kept, "raw"), "raw")
    offset = written(quantile_by_step(known, "raw", contamination, "offset", 2.0**-16), "offset")
    return Forest(nodes, offset, features, sample), known


def fit_forest(train: DataFrame, features: list[str], key: str, contamination: float = 0.05, **options) -> Forest:
    """The forest and its offset, the low quantile of the values of all training rows; both are computed here, once.

    Where ``total``, the number of training rows, isn't given, they are counted, so they should be cheap to count.
    """
    return _fitted(train, features, key, [], contamination, **options)[0]


def _rated(scored: DataFrame, offset: DataFrame) -> DataFrame:
    decision = F.col("raw") - F.col("offset")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - decision))
    rated = scored.crossJoin(F.broadcast(offset)).withColumns({"is_anomaly": decision < 0, "anomaly_score": rounded(score, 4)})
    return rated.drop("raw", "offset")


def forest_scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows`` with is_anomaly and anomaly_score; every row is scored."""
    return _rated(path_scores(rows, forest.nodes, forest.features, forest.sample), forest.offset)


def score_isolation_forest(train: DataFrame, rows: DataFrame, features: list[str], key: str, contamination: float = 0.05, **options) -> DataFrame:
    """``rows`` with is_anomaly and anomaly_score; the offset is the low quantile of all training rows.

    Training rows that are themselves to be rated go down the trees once.
    """
    if rows is train:
        forest, known = _fitted(train, features, key, train.columns, contamination, **options)
        return _rated(known, forest.offset)
    return forest_scores(rows, fit_forest(train, features, key, contamination, **options))


class IncidentForest(NamedTuple):
    """The forest of a history, and its codes of each category, with that of ``Unknown``."""

    forest: Forest
    codes: dict[str, DataFrame]
    unknown: dict[str, int]


def _coded_history(history: DataFrame, key: str, kept: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, DataFrame], dict[str, int]]:
    """The key, the ``kept`` columns and the features of a history, and its codes; a feature that it lacks is ``Unknown`` or 0
    throughout.

    The history's own values have their codes as they stand, so that no value is cleaned again for each row.
    """
    absent = {c: F.lit("Unknown") for c in CATEGORIES} | {c: F.lit(0.0) for c in NUMBERS}
    rows = history.withColumns({c: v for c, v in absent.items() if c not in history.columns})
    rows = rows.select(*dict.fromkeys([key, *kept, *CATEGORIES, *NUMBERS]))
    codes, given, unknown = stored_codes_of_values(rows, CATEGORIES)
    return coded(rows, given, unknown, F.col), codes, unknown


def incident_forest(history: DataFrame, key: str = "incident_id", **options) -> IncidentForest:
    """Learned from the whole history; a feature that it lacks is ``Unknown`` or 0 throughout.

    The history is read several times, so it should be a stored table. It is counted without its codes, and the codes go to
    the few rows drawn for trees and, once, to all rows that go down them.
    """
    train, codes, unknown = _coded_history(history, key)
    return IncidentForest(fit_forest(train, FEATURES, key, total=history.count(), **options), codes, unknown)


def rated_history(history: DataFrame, kept: tuple[str, ...] = (), key: str = "incident_id", contamination: float = 0.05, **options) -> DataFrame:
    """The key of every row of a stored history, is_anomaly, anomaly_score and the ``kept`` columns, none of them a number.

    Every row goes down the trees once, for its own score and for the offset.
    """
    train, _codes, _unknown = _coded_history(history, key, kept)
    forest, known = _fitted(train, FEATURES, key, [key, *kept], contamination, history.count(), **options)
    return _rated(known, forest.offset).select(key, "is_anomaly", "anomaly_score", *kept)


def coded(rows: DataFrame, codes: dict[str, DataFrame], unknown: dict[str, int], by: Callable[[str], Column] = lambda c: clean_value(F.col(c))) -> DataFrame:
    """The features of incidents, by the codes (value, code) of a history, whose values stand for ``by`` of a column."""
    out = rows.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMBERS})
    for c in CATEGORIES:
        out = out.join(codes[c].toDF("_value", f"_code_{c}"), by(c) == F.col("_value"), "left").drop("_value")
    out = out.withColumns({f"{c}_code": F.coalesce(f"_code_{c}", F.lit(unknown[c]).cast("long")).cast("long") for c in CATEGORIES})
    return out.drop(*NUMBERS, *[f"_code_{c}" for c in CATEGORIES]).withColumnsRenamed({f"_{c}": c for c in NUMBERS})


def score_records(records: DataFrame, known: IncidentForest) -> DataFrame:
    """Incident records with is_anomaly and anomaly_score; the part of the day comes from the time of the incident."""
    kept = records.columns
    rows = records.withColumns({f"_was_{c}": F.col(c) for c in NUMBERS} | {"time_category": time_period(F.col("occurred_time"))})
    scored = forest_scores(coded(rows, known.codes, known.unknown), known.forest)
    return scored.select(*[F.col(f"_was_{c}").alias(c) if c in NUMBERS else c for c in kept], "is_anomaly", "anomaly_score")


def anomaly_explanation(flag: Column, score: Column) -> Column:
    """What the flag rests on, in one text."""
    return F.concat_ws(
        " ",
        F.when(flag, "Unusual for the history.").otherwise("Within the usual range."),
        F.when(F.col("crime_severity") == "Felony", "Severity is high."),
        F.when(has_weapon(F.col("weapon_used"), ["unknown", "none", "no", "", "nan"]), F.concat(F.lit("Weapon: "), F.col("weapon_used"), F.lit("."))),
        F.when(F.col("district").isNotNull(), F.concat(F.lit("District "), F.col("district"), F.lit("."))),
        F.when(is_yes(F.col("gang_related")), "Gang case."),
        F.concat(F.lit("Score "), F.format_string("%.3f", rounded(score, 3)), F.lit(".")),
    )


def anomaly_summary(df: DataFrame) -> DataFrame:
    """Rows, flagged rows, and their share; 0 of nothing is 0."""
    n = F.count_if(F.col("is_anomaly"))
    rate = rounded(F.coalesce(F.try_divide(n.cast("double"), F.count(F.lit(1))), F.lit(0.0)), 4)
    return df.agg(F.count(F.lit(1)).alias("total"), n.alias("anomalies"), rate.alias("rate"))

