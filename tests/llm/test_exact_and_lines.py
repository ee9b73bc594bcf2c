import hashlib
from collections import defaultdict

from fixture import documents, empty, texts

from vigil.llm.exact_dedup import exact_duplicates
from vigil.llm.line_dedup import LineRuns, kept_lines, line_digest

SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_against_brute_force(spark):
    groups = defaultdict(list)
    for i, t in texts():
        groups[t or ""].append(i)
    expected = sorted(
        ((i, max((x for x in ids if x is not None), default=None), len(ids), sha(t)) for t, ids in groups.items() for i in ids), key=repr
    )
    out = exact_duplicates(documents(spark)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=repr) == expected
    kept = defaultdict(int)
    for r in out:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_with_a_full_filter_gives_the_same(spark):
    few = sorted(map(tuple, exact_duplicates(documents(spark), max_bits=32768).drop("kept").collect()), key=repr)
    assert few == sorted(map(tuple, exact_duplicates(documents(spark)).drop("kept").collect()), key=repr)


def test_empty_tables(spark):
    assert exact_duplicates(empty(spark)).count() == 0
    assert line_digest(empty(spark)).count() == 0


def lower(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def test_lines_against_brute_force(spark):
    docs, last = defaultdict(int), {}
    for i, t in texts():
        if i is None:
            continue
        for k in {lower(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                docs[k] += 1
                last[k] = max(last.get(k, i), i)
    expected = []
    for i, t in texts():
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or docs[lower(x)] < 5 or last[lower(x)] == i]
        expected.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert any(x[2] for x in expected)
    out = line_digest(documents(spark)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)


def test_lines_keep_the_columns_and_batches_do_not_matter(spark):
    docs = documents(spark)
    one = kept_lines(docs, batches=1).select("doc_id", "_kept")
    many = kept_lines(docs, batches=7, fanout=2)
    assert many.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.select("doc_id", "_kept").collect()), key=repr)


def test_runs_are_levelled_and_every_key_has_one_entry(spark):
    runs = LineRuns(fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(b, b"common"), (b, b"common"), (b, bytes([b]))], "id long, key binary"))
    assert [len(level) for level in runs.levels.values()] == [1, 0, 1]
    held = [bytes(r.key) for run in runs.runs() for r in run.collect()]
    assert len(held) == len(set(held)) == 6
    found = {bytes(r.key): (r.documents, r.last) for r in runs.entries().collect()}
    assert found[b"common"] == (5, 4) and found[b"\x02"] == (1, 2)


def test_counts_need_the_anti_join(spark, monkeypatch):
    """A key that a run holds and that were entered once more would count twice."""
    def most():
        runs = LineRuns()
        for ids in ([1], [2, 3, 4]):
            runs.add(spark.createDataFrame([(i, b"line") for i in ids], "id long, key binary"))
        return max(r.documents for r in runs.entries().collect())

    assert most() == 4
    frame = type(spark.range(1))
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, on=None, how=None: self if how == "left_anti" else join(self, other, on, how))
    assert most() == 6


def test_rows_of_one_id_are_one_document(spark, duck):
    import pandas as pd
    from conftest import same_rows

    from vigil.llm.queries import ORACLES

    line = "A line that stands in several rows of few documents, repeatedly."
    rows = [(i % 3, f"{line}\n{i}") for i in range(9)] + [(10 + i, f"{line.upper()} Again.\nrow {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.n_dropped) for r in line_digest(docs).collect()}
    assert out == {(0, 0), (1, 0), (2, 0), (10, 1), (11, 1), (12, 1), (13, 1), (14, 0)}
    single = [(i, t) for i, t in rows if i >= 10] + rows[:3]
    duck.register("own_lines", pd.DataFrame(single, columns=["doc_id", "text"]))
    sql = ORACLES["op6_line_dedup"].replace("from documents", "from own_lines")
    same_rows(line_digest(spark.createDataFrame(single, "doc_id long, text string")), duck.sql(sql))
