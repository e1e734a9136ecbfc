"""Contracts, run log, comparison, claims and evaluation aggregates."""

import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from auditframe.errors import RefusedError
from auditframe.operators.joins import join_diagnostics
from auditframe.plans import verify
from auditframe.plans.analytics import FACT_SCHEMA, run_plan
from auditframe.functions.identity import content_fingerprint
from auditframe.plans.runlog import RunLog
from auditframe.plans.runs import (
    DriftError, category_changes, check_contract, contract_of, diagnostic_changes, duplicate_changes, input_changes,
    metric_changes, missing_changes, row_count_changes, run_by_period, run_diagnostics, run_facts, snapshot_input, step_changes,
    verification_status, warning_changes,
)
from auditframe.plans.specs import AnalyticsPlan, JoinSpec, Metric

AUGUST = [("North", "Alice", 900, 2000), ("North", "Alice", 450, 2000), ("South", "Bob", 800, 1000)]
SEPTEMBER = [("North", "Alice", 1025, 2000), ("North", "Alice", 500, 2000), ("South", "Bob", 950, 1000), ("East", "Cara", 300, 600)]
SCHEMA = "region string, salesperson string, net_sales long, target long"
PLAN = AnalyticsPlan("metrics", group_by=["region"], metrics=[Metric("sum", "net_sales")])


@pytest.fixture()
def months(spark):
    return spark.createDataFrame(AUGUST, SCHEMA), spark.createDataFrame(SEPTEMBER, SCHEMA)


def by(df, key="input_key"):
    return {r[key]: r for r in df.collect()}


def test_metric_changes(months):
    previous, current = (run_facts([run_plan(m, PLAN).facts]) for m in months)
    changes = {r["absolute_change"]: r for r in metric_changes(previous, current).collect()}
    assert changes[175.0]["percent_change"] == pytest.approx(12.962962963)
    assert changes[None]["status"] == "added" and changes[None]["previous"] is None and "not treated as zero" in changes[None]["percent_change_reason"]
    assert changes[150.0]["status"] == "changed" and len(changes) == 3


def test_zero_to_something_has_no_percentage(spark):
    rows = lambda v: spark.createDataFrame([("k", "m", v, "l", "d", "c", 1, "{}", None)], FACT_SCHEMA)
    change = metric_changes(run_facts([rows(0.0)]), run_facts([rows(5.0)])).first()
    assert change["absolute_change"] == 5 and change["percent_change"] is None and "zero" in change["percent_change_reason"]
    with pytest.raises(RefusedError, match="changed meaning"):
        metric_changes(run_facts([rows(1.0)]), run_facts([rows(1.0).withColumn("unit", F.lit("percent"))]))
    with pytest.raises(RefusedError, match="repeated fact"):
        run_facts([rows(1.0).union(rows(2.0))])
    with pytest.raises(RefusedError, match="non-finite"):
        run_facts([rows(float("inf"))])
    assert run_facts([rows(1.0), rows(1.0)]).count() == 2


def test_drift(spark, months):
    contract = contract_of(months[0])
    check_contract(months[1], contract, "in")
    with pytest.raises(DriftError) as caught:
        check_contract(months[0].drop("target"), contract, "in")
    assert caught.value.finding.kind == "schema"
    with pytest.raises(DriftError) as caught:
        check_contract(months[0].withColumn("target", F.col("target").cast("double")), contract, "in")
    assert caught.value.finding.kind == "type" and caught.value.status == "blocked"
    with pytest.raises(DriftError):
        check_contract(months[0].select("salesperson", "region", "net_sales", "target"), contract, "in")


def test_quality_and_category_changes(spark, as_rows):
    schema = "id long, category string, value double"
    first = spark.createDataFrame([(1, "A", None), (2, "B", None), (2, "B", None)], schema)
    second = spark.createDataFrame([(1, "A", 1.0), (2, "C", 2.0), (3, "C", None)], schema)
    p, c = snapshot_input(first, "in", "a"), snapshot_input(second, "in", "b")
    assert by(missing_changes(p.missing, c.missing), "column_name")["value"]["absolute_change"] == -2
    assert duplicate_changes(p.inputs, c.inputs).first()["absolute_change"] == -1
    row = category_changes(p.categories, c.categories).first()
    assert (row["added"], row["removed"], row["values_complete"]) == (["C"], ["B"], True)
    assert row_count_changes(p.inputs, c.inputs).first()["percent_change"] == 0


def test_large_category_sets_give_counts_only(spark):
    small = spark.createDataFrame([("a",)], "category string")
    large = spark.range(101).select(F.concat(F.lit("v"), "id").alias("category"))
    row = category_changes(snapshot_input(small, "in", "a").categories, snapshot_input(large, "in", "b").categories).first()
    assert (row["previous_unique_count"], row["current_unique_count"], row["added"], row["values_complete"]) == (1, 101, [], False)


def test_input_changes(spark, months):
    august, september = months
    widened = august.withColumn("extra", F.lit(1)).withColumn("target", F.col("target").cast("double")).drop("salesperson")

    def inputs(**frames):
        parts = [snapshot_input(df, key, key).inputs for key, df in frames.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    found = by(input_changes(inputs(same=august, changed=august, shape=august, gone=august), inputs(same=august, changed=september, shape=widened, new=august)))
    assert {k: r["status"] for k, r in found.items()} == {
        "same": "unchanged", "changed": "content_changed", "shape": "incompatible", "gone": "removed", "new": "added"
    }
    assert (found["shape"]["added_columns"], found["shape"]["removed_columns"], found["shape"]["type_changes"]) == (["extra"], ["salesperson"], ["target"])


def test_warnings_steps_and_diagnostics(spark, as_rows):
    w = lambda *texts: spark.createDataFrame([(t,) for t in texts], "warning string")
    assert as_rows(warning_changes(w("a", "a", "b"), w("a", "b", "c"))) == [("a", 2, 1, -1), ("c", 0, 1, 1)]
    step = "step int, tool_name string, status string, warning_count int, artifact_count int"
    one = spark.createDataFrame([(1, "join", "succeeded", 2, 0)], step)
    two = spark.createDataFrame([(1, "join", "failed", 0, 1), (2, "rank", "succeeded", 0, 0)], step)
    assert as_rows(step_changes(one, two)) == [(1, "join", "succeeded", "failed", -2, 1), (2, "rank", None, "succeeded", 0, 0)]
    with pytest.raises(RefusedError, match="tool identity"):
        step_changes(one, one.withColumn("tool_name", F.lit("other")))
    left, right = spark.range(10), spark.range(7)
    accounts = [run_diagnostics([(1, "join_diagnostics", join_diagnostics(left, r, JoinSpec(["id"], ["id"], "left")))]) for r in (right, left)]
    found = by(diagnostic_changes(*accounts), "diagnostic_id")
    row = found["step.1.join_diagnostics.left_unmatched_rows"]
    assert (row["previous"], row["current"], row["section"], row["unit"]) == (3.0, 0.0, "join", "count")
    assert found["step.1.join_diagnostics.many_to_many_detected"]["current"] == 0.0


def test_run_log(spark, months, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    for name, df in zip(("r1", "r2"), months):
        snap = snapshot_input(df, "step.1.input", name)
        log.save(
            name, "w", facts=run_facts([run_plan(df, PLAN).facts]), inputs=snap.inputs, missing=snap.missing, categories=snap.categories,
            warnings=["late file"] if name == "r2" else [],
        )
    with pytest.raises(RefusedError, match="immutable"):
        log.save("r1", "w")
    try:
        check_contract(months[0].drop("target"), contract_of(months[0]), "in")
    except DriftError as drift:
        log.save("r3", "w", status="failed", error=str(drift), drift=drift.finding)
    with pytest.raises(RefusedError, match="no facts"):
        log.save("r4", "w", status="failed", facts=months[0])
    page = log.page("w", limit=2).collect()
    assert [r["run_id"] for r in page] == ["r3", "r2"] and page[0]["drift_kind"] == "schema" and page[0]["fact_count"] == 0
    assert [r["verification"] for r in page] == ["failed", "verified_with_warnings"]
    assert [r["run_id"] for r in log.page("w", limit=2, offset=2).collect()] == ["r1"]
    changes = log.compare("r1", "r2")
    assert changes["metrics"].count() == 3 and changes["inputs"].first()["status"] == "content_changed"
    assert changes["row_counts"].first()["absolute_change"] == 1 and changes["warnings"].first()["change"] == 1
    for pair in (("r1", "r1"), ("r1", "r3"), ("r1", "nope")):
        with pytest.raises(RefusedError):
            log.compare(*pair)


def test_recurring_plan(spark, months):
    df = months[0].withColumn("period", F.lit("08")).unionByName(months[1].withColumn("period", F.lit("09")))
    result = run_by_period(df, PLAN, "period", contract_of(df))
    assert {(r["period"], r["region"]): r["sum_net_sales"] for r in result.table.collect()} == {
        ("08", "North"): 1350, ("08", "South"): 800, ("09", "North"): 1525, ("09", "South"): 950, ("09", "East"): 300
    }
    with pytest.raises(DriftError):
        run_by_period(df.drop("target"), PLAN, "period", contract_of(df))
    with pytest.raises(RefusedError, match="keyed by period"):
        run_by_period(df, AnalyticsPlan("distribution", value_column="target"), "period", contract_of(df))


def test_verification_status():
    assert [verification_status(*a) for a in ((0, 0), (1, 0), (1, 2), (1, 0, True))] == ["not_run", "verified", "verified_with_warnings", "failed"]


CLAIMS = "claim_id string, kind string, value double, unit string, evidence_keys array<string>, source_ids array<string>"


def statuses(spark, claims, facts, sources=(), values=None):
    found = verify.verify_claims(
        spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(facts, "key string, value double, unit string"),
        spark.createDataFrame([(s,) for s in sources], "source_id string"),
        None if values is None else spark.createDataFrame([(v,) for v in values], "value double"),
    )
    return {r["claim_id"]: r["status"] for r in found.collect()}


def test_claims(spark):
    facts = [("a", 100.0, None), ("b", 12.5, "Percent"), ("twice", 1.0, None), ("twice", 1.0, None), ("commission.Ann", 5.0, None), ("big", 1e12, None)]
    claims = [
        ("ok", "numeric", 100.0000005, None, ["a"], []),
        ("wrong", "numeric", 100.1, None, ["a"], []),
        ("all keys", "numeric", 100.0, None, ["a", "b"], []),
        ("missing key", "numeric", 100.0, None, ["a", "zz"], []),
        ("unit ok", "numeric", 12.5, "percent", ["b"], []),
        ("unit lost", "numeric", 12.5, None, ["b"], []),
        ("ambiguous", "numeric", 1.0, None, ["twice"], []),
        ("commission cited", "numeric", 5.0, None, ["commission.Ann"], ["s1"]),
        ("commission bare", "numeric", 5.0, None, ["commission.Ann"], []),
        ("commission foreign", "numeric", 5.0, None, ["commission.Ann"], ["s1", "s9"]),
        ("no value", "numeric", None, None, ["a"], []),
        ("no key", "numeric", 100.0, None, [], []),
        ("relative", "numeric", 1e12 + 500, None, ["big"], []),
        ("doc ok", "document", None, None, [], ["s1", "s2"]),
        ("doc foreign", "document", None, None, [], ["s1", "s9"]),
        ("doc bare", "document", None, None, [], []),
    ]
    assert statuses(spark, claims, facts, ["s1", "s2"], [100.0]) == {
        "ok": "verified", "wrong": "unsupported", "all keys": "unsupported", "missing key": "unsupported", "unit ok": "verified",
        "unit lost": "unsupported", "ambiguous": "unsupported", "commission cited": "verified", "commission bare": "insufficient_evidence",
        "commission foreign": "insufficient_evidence", "no value": "unsupported", "no key": "unsupported", "relative": "verified",
        "doc ok": "verified", "doc foreign": "unsupported", "doc bare": "insufficient_evidence",
    }


def test_claims_without_named_facts_may_match_any_value(spark):
    observed = [0.0, 5.0, 999.9999999, 1000.0000001, -2e9, 123456789.123, 1e300]
    stated = [0.0000009, 5.000002, 1000.0, -2e9 - 1, -2e9 - 3, 123456789.2, 1e300, 7.0, 999.99999901]
    expected = [any(abs(s - o) <= max(1e-9 * max(abs(s), abs(o)), 1e-6) for o in observed) for s in stated]
    claims = [(str(i), "numeric", s, None, [], []) for i, s in enumerate(stated)]
    got = statuses(spark, claims, [], values=observed)
    assert [got[str(i)] == "verified" for i in range(len(stated))] == expected


def test_overall_status(spark):
    def overall(*statuses, warnings=0):
        return verify.overall_status(spark.createDataFrame([(s,) for s in statuses], "status string"), warnings).first()["status"]

    assert overall("verified", "unsupported", "insufficient_evidence") == "unsupported"
    assert overall("verified", "failed", "conflicting") == "failed"
    assert overall("verified") == "verified" and overall("verified", warnings=1) == "verified_with_warnings"
    assert overall() == "insufficient_evidence"


def test_usage(spark):
    calls = [("m", float(v), None if v == 3 else v, v) for v in (4, 1, 3, 2)] + [("n", float(v), 10, 1) for v in range(1, 11)]
    df = spark.createDataFrame(calls, "model string, latency_ms double, input_tokens long, output_tokens long")
    found = {r["model"]: r for r in verify.call_usage(df, ["model"], 1.0, 2.0).collect()}
    assert (found["m"]["latency_ms_p95"], found["m"]["latency_ms_median"], found["m"]["input_tokens"], found["m"]["cost"]) == (4.0, 2.5, None, None)
    assert (found["n"]["latency_ms_p95"], found["n"]["latency_ms_median"], found["n"]["input_tokens"]) == (10.0, 5.5, 100)
    assert found["n"]["cost"] == pytest.approx((100 + 20) / 1e6)


def test_scores_and_judgements(spark):
    results = spark.createDataFrame([(1, True, True, 0), (2, False, True, 2)], "case_id long, passed boolean, tool boolean, extra int")
    row = verify.score_results(results, ["tool"], ["extra"]).first()
    assert (row["passed_count"], row["task_success_rate"], row["rate_tool"], row["extra"]) == (1, 0.5, 1.0, 2)
    judged = spark.createDataFrame([(1, 4)], "case_id long, score int")
    assert tuple(verify.judgement_mean(results, judged).first()) == ("partial", 4.0, 1)
    assert verify.judgement_mean(results, judged.limit(0)).first()["status"] == "not_supplied"
    with pytest.raises(RefusedError, match="unknown cases"):
        verify.judgement_mean(results, spark.createDataFrame([(9, 4)], "case_id long, score int"))
    with pytest.raises(RefusedError, match="unique"):
        verify.judgement_mean(results, judged.union(judged))


def test_ids_of_digits_stay_text(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    for run_id in ("1", "001", "abc"):
        log.save(run_id, "7")
    assert sorted(r["run_id"] for r in log.page("7").collect()) == ["001", "1", "abc"]


def test_one_of_two_saves_at_once_is_kept(spark, tmp_path):
    """Both write their tables first; only one can create the commit."""
    log = RunLog(spark, str(tmp_path / "log"))
    gate, outcomes = threading.Barrier(2), []
    create = log.files.create

    def held(name, text):
        if name.startswith("commits/"):
            gate.wait(60)
        return create(name, text)

    log.files.create = held

    def save(warning):
        try:
            log.save("r", "w", warnings=[warning])
            outcomes.append(warning)
        except RefusedError as refusal:
            assert "immutable" in str(refusal)

    threads = [threading.Thread(target=save, args=(x,)) for x in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(outcomes) == 1 and [r["warning"] for r in log.table("warnings", "r").collect()] == outcomes
    assert [(r["run_id"], r["position"]) for r in log.page("w").collect()] == [("r", 0)]


def test_an_attempt_without_commit_is_no_run(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    log.files.create, create = (lambda name, text: (_ for _ in ()).throw(OSError("lost"))), log.files.create
    with pytest.raises(OSError):
        log.save("r", "w", warnings=["first try"])
    log.files.create = create
    assert log.page("w").count() == 0 and log.commit_of("r") is None
    log.save("r", "w", warnings=["second try"])
    assert log.table("warnings", "r").first()["warning"] == "second try" and log.page("w").count() == 1


def test_a_page_opens_only_the_segments_it_needs(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for i in range(6):
        log.save(f"r{i}", "w", started_at=start + timedelta(days=i))
        if i % 2:
            assert log.compact("w") == 2
    log.save("late", "w", started_at=start + timedelta(days=1, hours=1))
    log.save("other", "x")
    assert log.compact("nothing") == 0 and len(log.segments_for("w", 2)) == 1 and len(log.segments_for("w", 3)) == 2
    assert [r["run_id"] for r in log.page("w", limit=2).collect()] == ["r5", "r4"]
    assert [(r["run_id"], r["position"]) for r in log.page("w", limit=3, offset=3).collect()] == [("r2", 3), ("late", 4), ("r1", 5)]
    log.compact("w")
    assert [r["run_id"] for r in log.page("w", limit=10).collect()] == ["r5", "r4", "r3", "r2", "late", "r1", "r0"]


def test_a_moved_null_changes_the_content(spark):
    kinds = "a string, b string"
    one, other = spark.createDataFrame([("x", None)], kinds), spark.createDataFrame([(None, "x")], kinds)
    assert content_fingerprint(one).first()["fingerprint"] != content_fingerprint(other).first()["fingerprint"]
