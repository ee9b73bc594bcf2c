import hashlib
import itertools
import random
import zlib

import pytest
from conftest import same_rows

from vigil.llm import conversation_repair as repair
from vigil.llm.conversation_queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, id long, rank string, segment string, part long, script string, cost string"
EXTRA = (1, "r", "s", 2, "x", "c")
EDITS = {"K": 0, "R": 1, "D": 2}


def rows(seed=3):
    """Conversations with nulls, repeats, ties, odd roles, gaps, blanks and a few long ones."""
    rng = random.Random(seed)
    out = [(7, t, "user", "same.") for t in range(300)] + [(None, 1, "user", "No id."), (None, 2, "assistant", "Yes!")]
    out += [(8, t, "ua"[t % 2] + "x", "x" * 5000 + ".") for t in range(12)] + [(9, None, None, None), (9, None, None, None)]
    for c in range(20, 90):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "Tool", "agent"])
            text = rng.choice(["Yes.", "No", "", None, " \t", "Why? ", "été !", f"Turn {t}.", f"Turn {t}\n"])
            turn = None if rng.random() < 0.1 else t + (5 if rng.random() < 0.1 else 0)
            out.append((c, turn, role, text))
            if rng.random() < 0.2:
                out.append((c, turn, role, text))
    return [(*r, *EXTRA) for r in out]


def conversations(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def damaged_rows(data):
    out = {}
    for c, turn, role, text, *_ in data:
        role, text = (" " if x is None else x for x in (role, text))
        kept = out.setdefault(c, [])
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, turn)).encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "o" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def legal(roles):
    rest = roles[1:] if roles[:1] == ["s"] else roles
    return not roles or bool(rest) and len(rest) % 2 == 0 and all(r == "ua"[i % 2] for i, r in enumerate(rest))


def brute_force(turns):
    """Every choice of edits, inserts included, of a few turns."""
    faults, best = faults_of(turns), None
    gaps = list(itertools.product(["", "u", "a", "ua", "au"], repeat=len(turns) + 1)) if len(turns) < 4 else [("",) * (len(turns) + 1)]
    for edits in itertools.product("KUAD", repeat=len(turns)):
        if any(e != "D" and f in "bd" for e, f in zip(edits, faults)):
            continue
        cost = sum({"K": 0, "D": 2}.get(e, 1) + (5 if f == "t" and e != "D" else 0) for e, f in zip(edits, faults))
        for inserted in gaps:
            audit, said = "I" * len(inserted[0]), [(r, "") for r in inserted[0]]
            for e, (_, role, text), more in zip(edits, turns, inserted[1:]):
                audit += {"U": "R", "A": "R"}.get(e, e) + "I" * len(more)
                said += [] if e == "D" else [({"U": "user", "A": "assistant"}.get(e, role), text)]
                said += [(r, "") for r in more]
            if legal([r[:1] for r, _ in said]):
                names = {"u": "user", "a": "assistant"}
                found = (cost + 5 * audit.count("I"), audit, [(names.get(r, r), t) for r, t in said])
                best = min(best, found) if best else found
    return best


def expected(data):
    out = {}
    for c, turns in damaged_rows(data).items():
        faults, initials = faults_of(turns), [r[:1] for _, r, _ in turns]
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (gaps, *(faults.count(f) for f in "bdt"), illegal)
        if len(turns) <= 7:
            cost, audit, said = brute_force(turns) if turns else (0, "", [])
            out[c] += (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digest(spark, data=None):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_digest(conversations(spark, data)).collect()}


def test_repair_against_brute_force(spark):
    found, want = digest(spark), expected(rows())
    assert found.keys() == want.keys()
    assert {c: x[: len(want[c])] for c, x in found.items()} == want
    assert sum(len(x) == 8 for x in want.values()) > 40


def test_repair_against_sql(spark, duck):
    import pandas as pd

    data = pd.DataFrame([r[:4] for r in rows(5)], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    duck.register("own", data)
    sql = ORACLES["op11_conversation_repair"].replace("from conversations", "from own")
    same_rows(repair.repair_digest(conversations(spark, rows(5))), duck.sql(sql))


def test_segments_of_long_conversations_give_the_same(spark, monkeypatch):
    usual = digest(spark)
    turns = sorted(map(tuple, repair.repaired_turns(repair.damaged(conversations(spark))).drop("at", "rank").collect()), key=repr)
    monkeypatch.setattr(repair, "LONG_ROWS", 3)
    monkeypatch.setattr(repair, "SEGMENT", 4)
    assert digest(spark) == usual
    cut = repair.repaired_turns(repair.damaged(conversations(spark)))
    assert sorted(map(tuple, cut.drop("at", "rank").collect()), key=repr) == turns
    monkeypatch.setattr(repair, "LONG_ROWS", 2_000)
    monkeypatch.setattr(repair, "LONG_BYTES", 100)
    assert digest(spark) == usual


def test_search_is_optimal_and_ties_are_least():
    rng = random.Random(2)
    for _ in range(120):
        turns = [(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["A.", "B", "", "C."])) for i in range(rng.randint(0, 5))]
        cost, audit, script = repair.cheapest([(r[0], f) for (_, r, _), f in zip(turns, faults_of(turns))])
        said = [(r, t) for _, r, t in repair.apply_script(script, [(r, t) for _, r, t in turns])]
        assert (cost, audit, said) == brute_force(turns)


def test_search_stays_small_on_bad_input(monkeypatch):
    turns = [(r, "o") for r in "s" * 200 + "uu" * 150 + "sa" * 50]
    cost, audit, _ = repair.cheapest(turns)
    assert cost < 2 * len(turns) and len(audit) == len(turns)


def test_inserts_where_they_are_cheap(monkeypatch):
    monkeypatch.setattr(repair, "DELETE", 9)
    repair.moves.cache_clear()
    assert repair.cheapest([("u", "o")])[:2] == (5, "KI")
    assert repair.cheapest([("a", "o")])[:2] == (5, "IK")
    repair.moves.cache_clear()


def test_empty_conversations(spark):
    assert repair.repair_digest(conversations(spark, [])).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = digest(spark, [(gone, 0, "user", "Hello.", *EXTRA)])
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("text", ["", " ", ".", "a.\n", "a .", "a!?", "?"])
def test_faults(spark, text):
    row = repair.repair_report(conversations(spark, [(1, 0, "user", text, *EXTRA), (1, 1, "user", text, *EXTRA)])).collect()[0]
    want = faults_of([(0, "user", text), (1, "user", text)])
    assert (row.blank, row.duplicate, row.truncated) == tuple(want.count(f) for f in "bdt")
