import hashlib
import random
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from conftest import same_rows

from vigil.llm import prefix_trie as tries
from vigil.llm.conversation_queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, id long, shard long, depth long, p1 string, part string, code string"
EXTRA = (1, 2, 3, "p", "q", "c")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows(seed=1):
    """Families that share turns, equal conversations, a long one, ties, nulls, ids whose first is absent or themselves negative."""
    rng = random.Random(seed)
    out = [(None, 0, "user", "No id"), (None, None, None, None)]
    for c in [*range(60), *range(101, 105), -3, -5, 10**12]:
        for t in range(rng.randint(1, 10)):
            out.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"])))
    out += [(c, t, "user", "same") for c in range(200, 290) for t in range(4)]
    out += [(300, t, "user", "on and on") for t in range(150)] + [(301, t, "user", "on and on") for t in range(155)]
    out += [(302, 0, "user", "x")] * 3
    return [(*r, *EXTRA) for r in out]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def said(data):
    out = defaultdict(list)
    for c, turn, role, text, *_ in data:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(x)] for c, x in out.items()}


def rebuilt(data):
    own, out = said(data), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (c % 5 if c >= 0 else -(-c % 5))  # the remainder has the sign of the id, as in SQL
        out[c] = own.get(family, [])[:h] + turns[h:]
    return out


def brute_force(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        size = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += size
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(sequences[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [14, 3])
def test_rebuilt_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(tries, "SHARD_BITS", bits)
    want = brute_force(rebuilt(rows()))
    assert max(x[1] for x in want) > 140 and max(x[3] for x in want) > 150
    assert found(tries.conversation_trie(frame(spark, rows()))) == want


def test_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(tries, "SHARD_BITS", 4)
    assert found(tries.trie_of(frame(spark, rows(2)))) == brute_force(said(rows(2)))


def test_against_sql(spark, duck):
    data = pd.DataFrame([r[:4] for r in rows(3)], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    duck.register("own_conversations", data)
    sql = ORACLES["op13_prefix_trie"].replace("from conversations", "from own_conversations")
    same_rows(tries.conversation_trie(frame(spark, rows(3))), duck.sql(sql))


def test_turnless_and_empty(spark):
    assert tries.conversation_trie(frame(spark, [])).count() == 0
    c = next(i for i in range(1, 100) if i % 5 and zlib.crc32(str(i).encode()) % 9 > 1)
    got = found(tries.conversation_trie(frame(spark, [(c, 0, "user", "gone", *EXTRA)])))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_subtrees_of_a_long_path(spark):
    data = [(5, t, "user", f"t{t}", *EXTRA) for t in range(37)]
    got = {x[1]: x for x in found(tries.trie_of(frame(spark, [*data, *[(6, *r[1:]) for r in data[:20]]])))}
    assert len(got) == 38 and all(x[5] == 1 for x in got.values())
    assert got[0][6] == sum(len(f"t{t}") for t in range(20)) and got[21][6] == 0 and got[19][6] == 6 and got[20][6] == 3
