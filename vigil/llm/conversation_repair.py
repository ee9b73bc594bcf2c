"""Conversation structure repair: the cheapest edits after which user and assistant alternate, behind at most one system turn.

A depth-first branch-and-bound search decides the edits of a conversation: an explicit stack, lower bounds on what the
remaining turns must cost, the incumbent (cost, audit), and for each (turn, state) the best prefix that has come there,
which eliminates worse ones. Conversations of a bounded size are read whole, one after the other, from sorted
partitions. Longer ones are cut into segments; the search gives each segment's cheapest edits for every pair of the
state before and after it, and these are chained.

Edits, by the letter in the audit: Keep, Rerole to user or assistant, Delete, Insert an empty user or assistant turn.
Repeated rows are turns of their own; turns of the same number go by role, then text. Null roles and texts read as one
space. A role that is empty or starts with another letter than s, u or a can't be kept. A null conversation id is an id
of its own. Further columns are not returned. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.text import SPACE_CHARS
from vigil.ordered import running_sum
from vigil.shared import written

LONG_ROWS = 2_000  # rows of a conversation that are read whole, at most
LONG_BYTES = 32_000_000  # and the bytes of their texts
SEGMENT = 500  # rows of a segment of a longer one

# Fixed values of the output contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")

# What the turns so far end with. NEXT continues by a user or an assistant turn.
BEGIN, SYSTEM, USER, REPLY = range(4)
NEXT = {BEGIN: USER, SYSTEM: USER, REPLY: USER, USER: REPLY}
KEEP = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, REPLY: USER}, "a": {USER: REPLY}}
LEGAL_ENDS = (BEGIN, REPLY)
#: Letters of a script: K keep, D delete, U and A rerole, u and a insert; the audit doesn't name the role.
AUDIT = str.maketrans("UAua", "RRII")
NAMES = {"U": "user", "A": "assistant", "u": "user", "a": "assistant"}

OK, BLANK, DUPLICATE, CUT = "o", "b", "d", "t"


@functools.cache
def moves(initial: str, fault: str) -> tuple[tuple[tuple[int, str, str, int], ...], ...]:
    """What a state may do with such a turn: (cost, letter of the script, of the audit, next state)."""
    out = []
    for state in (BEGIN, SYSTEM, USER, REPLY):
        own = [(DELETE, "D", "D", state)]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            if state in KEEP.get(initial, {}):
                own.append((extra, "K", "K", KEEP[initial][state]))
            own.append((extra + REROLE, "U" if NEXT[state] == USER else "A", "R", NEXT[state]))
        out.append(tuple(own))
    return tuple(out)


def suffix_bounds(turns: list[tuple[str, str]], ends: tuple[int, ...]) -> list[list[int]]:
    """For each turn and state what the rest costs at least.

    The relaxation takes a system turn for an assistant's, so that a system turn alone is legal.
    """
    far = 1 << 60
    alike = (BEGIN, REPLY, USER, REPLY)

    def with_inserts(v):
        begin, _, user, reply = v
        user, reply = min(user, INSERT + reply), min(reply, INSERT + user)
        return [min(begin, INSERT + user), reply, user, reply]

    reached = {alike[e] for e in ends}
    v = with_inserts([0 if s in reached else far for s in alike])
    out = [v]
    for initial, fault in reversed(turns):
        options = moves(initial, fault)
        v = with_inserts([min(cost + v[alike[to]] for cost, _, _, to in options[s]) for s in alike])
        out.append(v)
    return out[::-1]


def cheapest(turns: list[tuple[str, str]], entry: int = BEGIN, ends: tuple[int, ...] = LEGAL_ENDS) -> tuple[int, str, str] | None:
    """(cost, audit, script) of the cheapest edits of turns (initial, fault) from a state to one of the ends.

    Among equal costs the audit that is least in ASCII; none if no edits lead there.
    """
    bounds = suffix_bounds(turns, ends)
    incumbent: tuple[int, str, str] | None = None
    dominance: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "", "")]
    while stack:
        at, state, cost, audit, script = stack.pop()
        if incumbent and (cost + bounds[at][state], audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        if dominance.get((at, state), (1 << 60, "")) <= (cost, audit):
            continue
        dominance[at, state] = (cost, audit)
        if at == len(turns) and state in ends and (not incumbent or (cost, audit) < incumbent[:2]):
            incumbent = (cost, audit, script)
        children = [(INSERT, "u" if NEXT[state] == USER else "a", "I", NEXT[state], at)]
        if at < len(turns):
            children += [(*move, at + 1) for move in moves(*turns[at])[state]]
        ranked = sorted((cost + c + bounds[to_at][to], letter, c, mark, to, to_at) for c, mark, letter, to, to_at in children)
        stack.extend(
            (to_at, to, cost + c, audit + letter, script + mark) for least, letter, c, mark, to, to_at in reversed(ranked) if least < 1 << 60
        )
    return incumbent


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def apply_script(script: str, turns: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns from the (role, text) that the script was made for."""
    rest = iter(turns)
    for letter in script:
        if letter in "ua":
            yield "I", NAMES[letter], ""
            continue
        role, text = next(rest)
        if letter != "D":
            yield letter.translate(AUDIT), NAMES.get(letter, role), text


def _typed(df: DataFrame, id_col: str) -> str:
    return f"id {df.schema[id_col].dataType.simpleString()}"


def _prepared(conversations: DataFrame, id_col: str) -> DataFrame:
    """(id, turn, role, text, blank, cut); cut: the last character that is no space doesn't end a sentence."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    bare = F.rtrim(text, F.lit(SPACE_CHARS))
    return conversations.select(
        F.col(f"`{id_col}`").alias("id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches: Iterator[pa.RecordBatch], with_turns: bool) -> Iterator[tuple]:
    """One row per conversation of sorted (id, turn, role, text, blank, cut)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=itemgetter(0)):
        seen, turns, said, numbers = set(), [], [], []
        for _, turn, role, text, blank, cut in group:
            fault = BLANK if blank else DUPLICATE if (role, text) in seen else CUT if cut else OK
            seen.add((role, text))
            turns.append((role[:1], fault))
            said.append((role, text))
            if turn is not None:
                numbers.append(turn)
        cost, audit, script = cheapest(turns)
        repaired = list(apply_script(script, said))
        if with_turns:
            yield key, [e for e, _, _ in repaired], [r for _, r, _ in repaired], [t for _, _, t in repaired]
            continue
        faults = [f for _, f in turns]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in repaired).encode()).hexdigest()
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        yield key, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal_pairs([i for i, _ in turns]), cost, audit, digest


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _short(rows: DataFrame, with_turns: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spec = f"{_typed(rows, 'id')}, " + ("edits array<string>, roles array<string>, texts array<string>" if with_turns else STATS)
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], spec).schema)
    most = 10 if with_turns else 2_000
    ordered = rows.select("id", "turn", "role", "text", "blank", "cut").repartition("id").sortWithinPartitions("id", *_order())
    return ordered.mapInArrow(lambda batches: _batched(_whole(batches, with_turns), schema, most), spec)


def _segment_edits(rows: pd.DataFrame) -> pd.DataFrame:
    """The cheapest edits of a segment for every state before and after it, and its own counts."""
    rows = rows.sort_values("rank")
    turns = list(zip(rows["initial"], rows["fault"], strict=True))
    faults = rows["fault"].tolist()
    own = {
        "segment": int(rows["segment"].iloc[0]), "first": turns[0][0], "last": turns[-1][0],
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": illegal_pairs([i for i, _ in turns]),
    }
    out = []
    for entry in (BEGIN, SYSTEM, USER, REPLY):
        for end in (BEGIN, SYSTEM, USER, REPLY):
            if found := cheapest(turns, entry, (end,)):
                out.append({"id": rows["id"].iloc[0], **own, "entry": entry, "end": end, "cost": found[0], "audit": found[1], "script": found[2]})
    return pd.DataFrame(out)


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """The segments' edits on the cheapest way through all of them."""
    frontier = {BEGIN: (0, "", ())}
    kept, last = [], None
    for at, (_, options) in enumerate(rows.sort_values("segment").groupby("segment", sort=True)):
        options = options.to_dict("records")
        kept.append((options[0], 0 if last is None else int(last + options[0]["first"] not in LEGAL)))
        last = options[0]["last"]
        reached: dict[int, tuple] = {}
        for o in options:
            if o["entry"] in frontier:
                cost, audit, way = frontier[o["entry"]]
                new = (cost + o["cost"], audit + o["audit"], (way, o))
                if o["end"] not in reached or new[:2] < reached[o["end"]][:2]:
                    reached[o["end"]] = new
        frontier = reached
    _, _, way = min((frontier[e] for e in LEGAL_ENDS if e in frontier), key=lambda x: x[:2])
    chosen = []
    while way:
        way, o = way
        chosen.append(o)
    out = pd.DataFrame(chosen[::-1])
    out["illegal"] += [joint for _, joint in kept]
    return out[["id", "segment", "blank", "duplicate", "truncated", "illegal", "cost", "script"]]


def _sha(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, hash) of the lines of each id, joined by newlines, as they come."""

    def hashes():
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, group in groupby(rows, key=itemgetter(0)):
            digest, first = hashlib.sha256(), True
            for _, line in group:
                digest.update((line if first else "\n" + line).encode())
                first = False
            yield key, digest.hexdigest()

    yield from _batched(hashes(), schema, 1_000)


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest rows, lines (id, rank, at, edit, role, text)) of the conversations that are cut into segments."""
    key = ["id", "turn", "role", "text"]
    unique = rows.groupBy(*key, "blank", "cut").agg(F.count(F.lit(1)).alias("copies"))
    number = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = unique.groupBy("id", "role", "text").agg(F.min(number).alias("first"))
    first = first.select(F.col("id").alias("_id"), F.col("role").alias("_role"), F.col("text").alias("_text"), "first")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    copies = unique.join(first, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    repeated = (F.col("copy") > 1) | (number != F.col("first"))
    fault = F.when(F.col("blank"), BLANK).when(repeated, DUPLICATE).when(F.col("cut"), CUT).otherwise(OK)
    order = [*_order(), F.col("copy")]
    spread = copies.select(*key, "copy", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"), F.lit(1).cast("long").alias("one"))
    spread = written(spread.repartitionByRange(F.col("id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    ranked = running_sum(spread, ["id"], "part", order, "one", "start", "rank")
    ranked = written(ranked.withColumn("segment", F.floor(F.col("rank") / SEGMENT)).select(*key, "initial", "fault", "rank", "segment"), "ranked")

    kind = _typed(rows, "id")
    counts = "blank long, duplicate long, truncated long, illegal long"
    edits = ranked.select("id", "segment", "rank", "initial", "fault").groupBy("id", "segment").applyInPandas(
        _segment_edits, f"{kind}, segment long, first string, last string, {counts}, entry int, end int, cost long, audit string, script string"
    )
    chosen = written(
        written(edits, "segments").groupBy("id").applyInPandas(_chained, f"{kind}, segment long, {counts}, cost long, script string"), "chosen"
    )
    part = chosen.select(F.col("id").alias("_id"), F.col("segment").alias("_segment"), "script")
    placed = ranked.join(part, F.col("id").eqNullSafe(F.col("_id")) & (F.col("segment") == F.col("_segment")))
    marks = F.regexp_extract_all("script", F.lit("[ua]*[KDUA](?:[ua]+$)?"), F.lit(0))
    marks = F.split(F.get(marks, (F.col("rank") % SEGMENT).cast("int")), "")
    lines = placed.select("id", "rank", "role", "text", F.posexplode(marks).alias("at", "mark")).filter("mark not in ('D', '')")
    lines = lines.select(
        "id", "rank", "at", F.translate("mark", "UAua", "RRII").alias("edit"),
        F.when(F.upper("mark") == "U", "user").when(F.upper("mark") == "A", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(F.col("mark").isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
    )
    spec = f"{kind}, repaired_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], spec).schema)
    in_order = lines.repartition("id").sortWithinPartitions("id", "rank", "at").select("id", F.concat_ws(":", "role", "text").alias("line"))
    hashes = in_order.mapInArrow(lambda batches: _sha(batches, schema), spec).withColumnRenamed("id", "_h")
    script = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "script"))), lambda x: x["script"]), "")
    totals = chosen.groupBy("id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.translate(script, "UAua", "RRII").alias("audit")
    )
    turns = rows.groupBy("id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps")).withColumnRenamed("id", "_t")
    digest = totals.join(turns, F.col("id").eqNullSafe(F.col("_t"))).join(hashes, F.col("id").eqNullSafe(F.col("_h")), "left")
    return digest.select(
        "id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    ), lines


def _divided(conversations: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations that are read whole, and those of the longer ones if there are any."""
    rows = _prepared(conversations, id_col)
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = written(sizes.filter((F.col("n") > LONG_ROWS) | (F.col("size") > LONG_BYTES)).select(F.col("id").alias("_long")), "long")
    if long.isEmpty():
        return rows, None
    same = F.col("id").eqNullSafe(F.col("_long"))
    return rows.join(long, same, "left_anti"), written(rows.join(long, same, "left_semi"), "long-rows")


def repair_report(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): its faults, the cost and letters of the edits, a hash of the result.

    gaps are turn numbers that are missing between the least and the largest; blank, duplicate and truncated turns are
    counted by their first fault in this order; illegal counts neighbours whose roles don't follow each other.
    """
    short, long = _divided(conversations, id_col)
    out = _short(short, with_turns=False)
    if long is not None:
        out = out.unionByName(_long(long)[0])
    return out.withColumnRenamed("id", id_col)


def repaired_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The turns after repair: (conv_id, rank, at, edit, role, text), in the order of rank, then at."""
    short, long = _divided(conversations, id_col)
    out = _short(short, with_turns=True).select(
        "id", F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("rank", "turn")
    ).select("id", F.col("rank").cast("long").alias("rank"), F.lit(0).alias("at"), "turn.edits", "turn.roles", "turn.texts")
    out = out.toDF("id", "rank", "at", "edit", "role", "text")
    if long is not None:
        out = out.unionByName(_long(long)[1])
    return out.withColumnRenamed("id", id_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """The stated damage: of 20 remainders of a checksum, one each drops, empties, unends, repeats or re-roles a turn; nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    return rows.filter("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """``repair_report`` of the damaged conversations, with a row for every id, also if no turn is left of it."""
    found = repair_report(damaged(conversations)).withColumnRenamed("conv_id", "_found")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
