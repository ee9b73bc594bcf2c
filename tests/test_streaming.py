import pytest
from conftest import DATA
from pyspark.sql import functions as F

from vigil.operators.hotspots import emerging_hotspots
from vigil.operators.anomaly import FEATURES, anomaly_features, score_isolation_forest, score_records
from vigil.operators import live
from vigil.operators.cleaning import validate_basic
from vigil.operators.live import knowledge, process_incidents, scored
from vigil.functions.expr import date_of
from vigil.plans.risk import CHAIN_COLUMNS
from vigil.sources.incidents import history, incoming
from vigil.streaming.folded import Folded
from vigil.streaming.live import recent_counts, start_daily_counts, start_pipeline, stored, stream_incidents


@pytest.fixture(scope="module")
def known(spark):
    return knowledge(history(spark, f"{DATA}/sf0.001", CHAIN_COLUMNS).persist())


def arrivals(spark):
    return incoming(spark, f"{DATA}/sf0.001").drop("event_id", "reasons").withColumn("submitted_at", F.date_trunc("second", F.col("submitted_at").cast("timestamp")))


def test_one_batch_equals_the_batch_job(spark, known, tmp_path):
    df = arrivals(spark)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    start_pipeline(stream_incidents(spark, str(tmp_path / "in"), df.schema), known, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batch = process_incidents(known, df)
    for name in batch._fields:
        ours = stored(spark, f"{tmp_path}/out/{name}").drop("batch")
        columns = sorted(c for c in ours.columns if c != "anomaly_score")
        got = sorted((str(tuple(r)) for r in ours.select(columns).collect()))
        assert got == sorted(str(tuple(r)) for r in getattr(batch, name).select(columns).collect()), name


def test_repeats_and_retries_are_stored_once(spark, known, tmp_path):
    df = arrivals(spark)
    first, second = df.filter("submitted_at < '2024-01-12'"), df.filter("submitted_at >= '2024-01-10'")
    first.coalesce(1).write.json(str(tmp_path / "in"))
    arriving = lambda: stream_incidents(spark, str(tmp_path / "in"), df.schema)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    start_pipeline(arriving(), known, out, check).awaitTermination()
    second.unionByName(first.limit(5)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    start_pipeline(arriving(), known, out, check).awaitTermination()
    ids = [r.incident_id for r in stored(spark, f"{out}/arrived").collect()]
    assert len(ids) == len(set(ids)) == df.count()
    alerts = [r.alert_id for r in stored(spark, f"{out}/alerts").collect()]
    assert len(alerts) == len(set(alerts))
    # the last batch, tried again as if its end had not been noted, changes nothing
    last = max(p.name for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for name in (last, f".{last}.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    start_pipeline(arriving(), known, out, check).awaitTermination()
    again = [r.incident_id for r in stored(spark, f"{out}/arrived").collect()]
    assert len(again) == len(set(again)) == df.count()


def test_daily_counts_take_late_rows(spark, tmp_path):
    df = arrivals(spark)
    late = F.col("occurred_date") < "2024-01-28"
    df.filter(~late).coalesce(1).write.json(str(tmp_path / "in"))
    start_daily_counts(stream_incidents(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    df.filter(late | late.isNull()).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    start_daily_counts(stream_incidents(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    dated = df.select("district", date_of(F.col("occurred_date")).alias("occurred_date"))
    for days in (7, 14):
        batch = emerging_hotspots(dated, dated, days).filter("recent_count > 0")
        expected = {r.location: r.recent_count for r in batch.collect()}
        assert {r.district: r.recent_count for r in recent_counts(spark, str(tmp_path / "out"), days).collect()} == expected


def test_the_chain_scores_by_the_forest(spark, known):
    df = arrivals(spark)
    none = {"is_anomaly": F.lit(False), "anomaly_score": F.lit(None).cast("double")}
    plain = {r.incident_id: r for r in scored(known, df.withColumns(none)).collect()}
    out = {r.incident_id: r for r in scored(known, df).collect()}
    assert set(out) == set(plain) and all(r.anomaly_score is not None for r in out.values())
    odd = [r for r in out.values() if r.is_anomaly]
    assert odd and all(r.is_anomaly == (r.anomaly_score > 0.5) for r in out.values() if r.anomaly_score != 0.5)
    for r in out.values():
        assert r.dynamic_risk == pytest.approx(min(plain[r.incident_id].dynamic_risk + 12 * r.is_anomaly, 100.0))
        assert any(x.startswith("Unusual profile, score") for x in r.reasons) == r.is_anomaly
    done = process_incidents(known, df)
    assert {r.incident_id for r in done.assessments.filter("anomaly_flag and anomaly_score is not null").collect()} == {r.incident_id for r in odd}
    assert {r.incident_id for r in done.alerts.collect()} == {r.incident_id for r in out.values() if r.risk_level in ("HIGH", "CRITICAL")}


def test_a_history_row_scores_the_same_in_the_chain(spark, known):
    rows = known.history.limit(200).withColumns({
        "occurred_time": F.element_at(F.create_map(*map(F.lit, ["Morning", "8:00", "Afternoon", "13:00", "Evening", "18:00", "Night", "23:00"])), F.col("time_category"))})
    whole = score_isolation_forest(anomaly_features(known.history), anomaly_features(known.history), FEATURES, "incident_id")
    expected = {r.incident_id: (r.is_anomaly, r.anomaly_score) for r in whole.collect()}
    out = score_records(rows, known.anomalies).collect()
    assert len(out) == 200 and all((r.is_anomaly, r.anomaly_score) == expected[r.incident_id] for r in out)


def test_given_flags_are_kept(spark):
    past = history(spark, f"{DATA}/sf0.001", CHAIN_COLUMNS)
    flagged = arrivals(spark).withColumns({"is_anomaly": F.lit("true"), "anomaly_score": F.lit("0.75")})
    without = knowledge(past, anomalies=False)
    rows = scored(without, flagged).collect()
    assert rows and all(r.is_anomaly and r.anomaly_score == 0.75 for r in rows)
    with pytest.raises(ValueError):
        scored(without, arrivals(spark))
    assert process_incidents(knowledge(past.limit(0)), arrivals(spark)).assessments.count() == 0


def _run_by_file(spark, df, known, tmp_path, files, **options):
    """Every frame a file, every file a batch."""
    for i, part in enumerate(files):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        arriving = stream_incidents(spark, str(tmp_path / "in"), df.schema)
        start_pipeline(arriving, known, str(tmp_path / "out"), str(tmp_path / "check"), **options).awaitTermination()


def test_a_batch_reads_neither_history_nor_stored_incidents(spark, tmp_path):
    """After knowledge() the history may be gone, and so may what earlier batches stored."""
    import shutil

    df = arrivals(spark)
    past = tmp_path / "past"
    history(spark, f"{DATA}/sf0.001", CHAIN_COLUMNS).write.parquet(str(past))
    known = knowledge(spark.read.parquet(str(past)))
    shutil.rmtree(past)
    first, second = df.filter("submitted_at < '2024-01-15'").persist(), df.filter("submitted_at >= '2024-01-15'").persist()
    _run_by_file(spark, df, known, tmp_path, [first])
    early = stored(spark, str(tmp_path / "out/assessments")).count()
    for name in ("arrived", "incidents", "assessments"):
        shutil.rmtree(tmp_path / "out" / name)
    _run_by_file(spark, df, known, tmp_path, [second.unionByName(first.limit(7))])
    again = stored(spark, str(tmp_path / "out/arrived")).select(df.columns)
    assert again.count() == second.count()  # repeats of a batch whose files are gone are known by the state
    whole = {r.incident_id: (r.dynamic_risk, r.risk_level) for r in scored(known, df).collect()}
    late = {r.incident_id: (r.dynamic_risk, r.risk_level) for r in stored(spark, str(tmp_path / "out/assessments")).collect()}
    assert early + len(late) == len(whole) and all(whole[i] == x for i, x in late.items())


def test_a_repeat_many_batches_later_is_dropped(spark, known, tmp_path):
    df = arrivals(spark).limit(40).persist()
    parts = [df.filter(F.pmod(F.xxhash64("incident_id"), F.lit(4)) == i) for i in range(4)]
    _run_by_file(spark, df, known, tmp_path, [*parts, parts[0].unionByName(parts[2])])
    ids = [r.incident_id for r in stored(spark, str(tmp_path / "out/arrived")).collect()]
    assert len(ids) == len(set(ids)) == df.count()


def _counts(spark, rows, tmp_path):
    spark.createDataFrame(rows, "district string, occurred_date string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    arriving = stream_incidents(spark, str(tmp_path / "in"), spark.createDataFrame([], "district string, occurred_date string").schema)
    start_daily_counts(arriving, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()


def test_daily_counts_write_what_changed(spark, tmp_path):
    _counts(spark, [(f"d{i}", f"2024-01-{1 + i % 28:02d}") for i in range(200)], tmp_path)
    _counts(spark, [("d3", "2024-01-04"), ("d3", "2024-01-04"), ("new", "2023-12-01")], tmp_path)
    parts = sorted((tmp_path / "out").glob("batch=*"))
    rows = [spark.read.parquet(str(p)).count() for p in parts]
    assert rows == [200, 2]
    assert {r.district: r.recent_count for r in recent_counts(spark, str(tmp_path / "out"), 60).collect()}["d3"] == 3


@pytest.mark.parametrize("newest", [False, True])
def test_folded_parts_stay_few(spark, tmp_path, newest):
    table = Folded(spark, str(tmp_path / "t"), ["k"], "n", "k string, n bigint", newest, every=3)
    want = {}
    for batch in range(11):
        rows = [(f"k{batch % 4}", batch + 1), ("all", 1)]
        for _ in range(2):  # a batch that is tried again replaces itself
            table.put(spark.createDataFrame(rows, "k string, n bigint"), batch)
        for k, n in rows:
            want[k] = n if newest else want.get(k, 0) + n
        assert {r.k: r.n for r in table.upto(batch).collect()} == want
        assert len(list((tmp_path / "t").glob("*=*"))) <= 3 * 3 + 2
    assert {r.k: r.n for r in table.upto().collect()} == want


def test_rows_of_one_file_are_checked_by_many_tasks(spark, known):
    df = arrivals(spark)
    checked = live._checked(known, df.coalesce(1))
    assert checked.select(F.spark_partition_id()).distinct().count() > 4
    expected = validate_basic(df, known.domains)
    assert checked.exceptAll(expected).isEmpty() and expected.exceptAll(checked).isEmpty()
    counts = live._daily(df)
    assert counts.exceptAll(live.arrived_counts(df)).isEmpty() and live.arrived_counts(df).exceptAll(counts).isEmpty()
    plan = scored(known, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1  # dealt before the checks, and not again before the trees
