"""Rules by hand: plans and drivers, singletons, aliases, claims, pages, statement readers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.operators.goals import Fit, least_shifts, needed, sensitivity
from tallyflow.operators.payees import merged_aliases, refined_singletons, without_aliases
from tallyflow.plans.relations import SPARK, build
from tallyflow.sources.sinks import claimed, decisions, page_of
from tallyflow.sources.statements import Locked, details, lines_of, reloaded


def test_a_plan_by_hand(spark):
    baseline = spark.createDataFrame([(1, 100, 50.0, 1000, 24300)], "user_id int, per_month long, std double, anchor long, last_idx int")
    bounded = spark.createDataFrame([(1, "a", "X", 30.0, 20.3, 90.0, None, None, 9), (1, "b", None, 7.0, 5.4, 90.0, None, None, 9), (2, "c", None, 7.0, 5.4, 90.0, None, None, 2)],
                                    "user_id int, slug string, category string, claimed double, impact double, ceiling double, cv double, seen long, months long")
    path = {r.month_no: r for r in build(spark, "rp3_projection", baseline=baseline, bounded=bounded).collect()}
    assert len(path) == 12 and path[12].baseline_p50 == 2200 and path[12].plan_p50 == 1000 + 126 * 12 and path[12].month_idx == 24312
    assert path[4].baseline_p10 == round(1400 - 1.2816 * 50 * 2) and path[4].baseline_p90 == round(1400 + 1.2816 * 50 * 2)
    by = {(r.slug, r.month_no): r for r in build(spark, "rp3_by_recommendation", baseline=baseline, bounded=bounded).collect()}
    assert len(by) == 24 and by["a", 3].p50 == 1361 and by["b", 3].p50 == 1316 and {r.gap_12m for r in by.values()} == {308}
    assert (by["a", 1].impact, by["a", 1].annual_impact, by["b", 1].annual_impact) == (20, 244, 65)
    monthly = spark.createDataFrame([(1, "2024-01", 24289, 200.0, 150.0, 50.0, 25.0), (1, "2024-02", 24290, 0.0, 20.0, -20.0, 0.0), (2, "2024-01", 24289, 100.0, 90.0, 10.0, 10.0)], "user_id int, month string, month_idx int, income double, expenses double, net double, rate double")
    months = {(r.user_id, r.month): (r.net, r.rate) for r in build(spark, "planned_months", baseline=baseline, bounded=bounded, monthly=monthly).collect()}
    assert months == {(1, "2024-01"): (76.0, 38.0), (1, "2024-02"): (6.0, 0.0), (2, "2024-01"): (10.0, 10.0)}


def test_drivers_match_by_key(spark):
    kind = "user_id int, savings double, cash_flow double, money_at_risk double, committed_spending double"
    now, before = spark.createDataFrame([(1, 50.0, 20.0, 40.0, 100.0), (2, 1.0, 2.0, 3.0, 4.0)], kind), spark.createDataFrame([(1, 60.0, 10.0, 40.0, 80.0)], kind)
    got = {(r.user_id, r.driver): (r.contribution, r.trend) for r in build(spark, "hs5_driver_trends", health_drivers=now, drivers_before=before).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "savings"): (15, -3), (1, "cash_flow"): (6, 3), (1, "money_at_risk"): (10, 0), (1, "committed_spending"): (15, 3)}
    assert all(got[2, k][1] is None for k in ("savings", "cash_flow", "money_at_risk", "committed_spending"))


def test_names_whose_words_all_stand_in_a_text(spark):
    rows = spark.createDataFrame([("Orla Quist", "log transfers to orla and bea quist"), ("Orla Quist", "log transfers to orla"), ("Q O", "q o"), ("O Quist", "to quist"), ("", "x")], "name string, text string")
    assert [r.v for r in rows.selectExpr(f"{SPARK.all_words('lower(name)', 'text')} AS v").collect()] == [True, False, False, True, False]


def test_singletons_take_after_their_nearest_cluster(spark):
    at = {10: (0, 1.0, 0.0), 11: (0, 0.96, 0.28), 20: (20, 0.8, 0.6), 30: (30, -1.0, 0.0), 40: (40, 0.0, -1.0), 41: (40, 0.1, -0.99)}
    members = spark.createDataFrame([(1, i, s, [x, y]) for i, (s, x, y) in at.items()], "group long, id long, seed long, vector array<double>")
    clusters = spark.createDataFrame([(1, 0, "shop", "p0", "Food", 0.5), (1, 20, "own", "p20", "Other", 0.4), (1, 30, "far", "p30", "Other", 0.4), (1, 40, "none", "p40", None, 0.9)], "group long, seed long, merchant string, payee string, category string, confidence double")
    got = {r.seed: (r.merchant, r.payee, r.category, round(r.confidence, 9), r.refined) for r in refined_singletons(members, clusters).collect()}
    assert got == {0: ("shop", "p0", "Food", 0.5, False), 20: ("shop", "p20", "Food", 0.4, True), 30: ("far", "p30", "Other", 0.4, False), 40: ("none", "p40", None, 0.9, False)}


def test_aliases_are_pointed_on(spark):
    kind = "user_id int, canonical string, alias string, txn_count long"
    known = spark.createDataFrame([(1, "Bea", "B", 3), (1, "Cy", "C", 1), (2, "Bea", "B", 9)], kind)
    found = spark.createDataFrame([(1, "Bea Tov", "Bea", 4), (1, "Bea Tov", "Bea Tov", 9), (1, "Cyr", "C", 5)], kind)
    merged = merged_aliases(known, found)
    assert {(r.user_id, r.alias): (r.canonical, r.txn_count) for r in merged.collect()} == {(1, "Bea"): ("Bea Tov", 4), (1, "B"): ("Bea Tov", 3), (1, "C"): ("Cyr", 5), (2, "B"): ("Bea", 9)}
    assert sorted((r.user_id, r.alias, r.canonical) for r in merged_aliases(merged, found).collect()) == sorted((r.user_id, r.alias, r.canonical) for r in merged.collect())
    patterns = spark.createDataFrame([(1, "B", 5), (1, "Bea Tov", 5), (1, None, 5), (2, "Bea", 5)], "user_id int, payee string, v int")
    assert sorted((r.user_id, str(r.payee)) for r in without_aliases(patterns, merged).collect()) == [(1, "Bea Tov"), (1, "None"), (2, "Bea")]


def test_sensitivity(spark):
    net = np.array([100.0, 110, 90, 105, 95, 100, 102])
    goals = spark.createDataFrame([(1, "accumulate", net.tolist(), 12, 1500.0), (2, "accumulate", net.tolist(), 0, 1500.0), (3, "accumulate", [1.0], 5, 9.0)], "goal_id long, kind string, net array<double>, months int, target double")
    rows = sorted(sensitivity(goals).collect(), key=lambda r: r.k)
    assert len(rows) == 40 and {r.goal_id for r in rows} == {1} and [r.probability for r in rows] == sorted(r.probability for r in rows)
    assert rows[0].probability == 0.0 and rows[-1].probability >= 0.9
    fit = Fit(net)
    steps = fit.draw(np.random.default_rng(1), (3000, 12))
    x = needed(fit, steps, 1500.0, 0.9) - fit.centre + 0.5
    assert ((np.cumsum(steps + x, axis=1).max(axis=1)) >= 1500.0).mean() == (least_shifts(steps, 1500.0) <= x).mean() >= 0.9


def test_claims_decisions_and_pages(spark):
    rows = spark.createDataFrame([(1, "new"), (2, "taken"), (3, "new"), (4, None)], "id int, status string")
    now, won = claimed(rows, rows.filter("id <> 3").union(rows.filter("id = 1")), "id", "status", "new", "taken")
    assert [(r.id, r.status) for r in now.orderBy("id").collect()] == [(1, "taken"), (2, "taken"), (3, "new"), (4, None)] and [r.id for r in won.collect()] == [1]
    log = decisions(rows.filter("id = 1"), F.lit("keep"), ["id", "status"], F.lit("2024-01-01"))
    assert [tuple(r) for r in log.collect()] == [("keep", "2024-01-01", 1, "new")] and log.columns == ["decision", "decided_at", "seen_id", "seen_status"]
    assert [r.id for r in page_of(rows, [F.desc("id")], page=2, limit=3).collect()] == [1]
    for page, limit in ((0, 5), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            page_of(rows, [F.col("id")], page, limit)


def test_statement_files(spark):
    def read(content, password):
        text = content.decode()
        if text.startswith("locked") and password != "open":
            raise Locked("password needed")
        if text.startswith("broken"):
            raise ValueError("no file of this kind")
        return [(1, 0, 0.0, i, float(i), 1.0, 9.0, t) for i, t in enumerate(text.split("\n"))]

    def vision(content, password):
        if content.startswith(b"broken twice"):
            raise ValueError("unseen")
        return [(1, 0, 0.0, 0, 0.0, 1.0, 9.0, "seen")]

    long = "Bank of Ostrava statement\nAccount no. XXXXXX4821 of some customer of the bank\nthe end"
    files = spark.createDataFrame([("a", long.encode(), None), ("b", b"locked " + long.encode(), "open"), ("c", b"locked", "wrong"), ("d", b"short", None), ("e", b"broken", None), ("f", b"broken twice", None), ("g", None, None)], "path string, content binary, password string")
    got = {}
    lines = lines_of(files, read, vision)
    for r in lines.collect():
        got.setdefault(r.statement, []).append((r.status, r.text))
    assert [s for s, _ in got["a"]] == ["ok"] * 3 and len(got["b"]) == 3 and got["c"] == [("locked", None)]
    assert got["d"] == got["e"] == [("vision", "seen")] and got["f"] == got["g"] == [("failed", None)]
    assert {r.status for r in lines_of(files.drop("password").filter("path IN ('d', 'b')"), read).collect()} == {"failed", "locked"}
    about = {r.statement: (r.bank, r.last4) for r in details(lines, {"Ostrava": "ostrava", "Lima": "bank of lima"}).collect()}
    assert about["a"] == ("Ostrava", "4821") and about["d"] == (None, None)
    assert {r.statement for r in reloaded(lines, files.select(F.col("path").alias("statement")).filter("path = 'a'")).collect()} == {"a"}


def test_flags_of_a_run_replace_those_in_its_scope(spark):
    from tallyflow.operators.recurring import COLUMNS, replaced_flags

    def flags(*rows):
        return spark.createDataFrame([(u, k, kind, "high", m, None, None, "x", "y", 1.0) for u, k, kind, m in rows], "user_id int, dedupe_key string, kind string, severity string, month string, txn_id string, cluster_id string, label string, category string, amount double").select(*COLUMNS.split(", "))

    old = flags((1, "a", "fee_or_interest", "2024-01"), (1, "b", "fee_or_interest", "2024-02"), (1, "c", "balance_risk", "2023-01"), (2, "d", "balance_risk", "2024-02"), (2, "e", "fee_or_interest", "2024-02"), (1, "n", "fee_or_interest", None))
    new = flags((1, "z", "fee_or_interest", "2024-02"), (1, "y", "balance_risk", "2024-02"))
    months = spark.createDataFrame([(1, "2024-02"), (1, "2024-02")], "user_id int, month string")
    once = replaced_flags(old, new, months)
    assert sorted(r.dedupe_key for r in once.collect()) == ["a", "d", "e", "n", "y", "z"]
    assert sorted(map(str, replaced_flags(once, new, months).collect())) == sorted(map(str, once.collect()))


def test_detectors_look_into_the_months_of_their_run(spark):
    ledger = spark.createDataFrame([(1, f"t{m}", f"2024-0{m}", 600) for m in (1, 2, 3)], "user_id int, txn_id string, month string, x int").selectExpr(
        "user_id", "txn_id", "month", "CAST(x AS DECIMAL(18,2)) AS debit", "'LATE FEE' AS description", "CAST(NULL AS STRING) AS merchant", "CAST(NULL AS STRING) AS payee", "CAST(NULL AS STRING) AS category")
    months = spark.createDataFrame([(1, "2024-02"), (2, "2024-01")], "user_id int, month string")
    assert [(r.txn_id, r.severity) for r in build(spark, "fl4_fees", ledger=ledger, detector_months=months).collect()] == [("t2", "high")]
