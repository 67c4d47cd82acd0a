"""Relations against the same SQL on DuckDB, and operators against hand-computed values."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyflow.functions.text import jaro, jaro_winkler
from tallyflow.operators.goals import Fit, chance, needed
from tallyflow.operators.payees import Spellings, assigned, group_names
from tallyflow.plans.catalog import names, oracle_sql, queries
from tallyflow.plans.relations import TABLES, build
from tallyflow.sources.sinks import scoped_replace, upserted

SF = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    tidy = lambda v: None if v is None or v != v else round(float(v), 4) + 0.0 if isinstance(v, float) else str(v)
    return sorted(str([tidy(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["wn_monthly_category_trends", "ag06_top_merchants", "ry_rhythm", "rec1_debit_merchant", "rec3_credit_merchant", "fl8_flags", "nrm12_dates", "nrm10_conservation", "wn14_smoothed", "jn7_overlap", "fn16_money", "sm7_sessions"])
def test_same_as_duckdb(spark, duck, name):
    assert rows(queries()[name](spark, SF).toPandas()) == rows(duck.sql(oracle_sql()[name]).df())


def test_every_relation_is_a_query():
    assert set(names()) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_tenants_do_not_touch_each_other(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "supplier", "part")}
    every = build(spark, "category_trend", **tables).filter("user_id = 3").toPandas()
    alone = build(spark, "category_trend", **(tables | {"supplier": tables["supplier"].filter("s_nationkey = 3")})).toPandas()
    assert rows(every) == rows(alone)


def test_dates_roll_and_years_turn(spark):
    raw = spark.createDataFrame([(1, "31/02/2024"), (2, "01/02/51"), (3, "01/02/50"), (4, "1 Apr 2024"), (5, "April 1, 2024"), (6, "2024-04-01"), (7, "no date")], "temp_id long, date string")
    got = {r["temp_id"]: r["day"] for r in build(spark, "nrm12_dates", raw_rows=raw).collect()}
    assert got == {1: "2024-03-02", 2: "1951-02-01", 3: "2050-02-01", 4: "2024-04-01", 5: "2024-04-01", 6: "2024-04-01", 7: None}


def test_name_similarity_by_hand():
    # five and six letters, four matched in order: (4/5 + 4/6 + 1) / 3; no common beginning
    assert round(jaro("table", "stabled"[1:]), 6) == round((5 / 5 + 5 / 6 + 1) / 3, 6)
    # one pair of six out of order: (1 + 1 + 5/6) / 3, and three equal letters at the front
    assert round(jaro("sander", "sanedr"), 6) == round((1 + 1 + 5 / 6) / 3, 6)
    assert round(jaro_winkler("sander", "sanedr"), 6) == round(17 / 18 + 3 * 0.1 / 18, 6)
    assert jaro("abc", "xyz") == 0.0 and jaro_winkler("kettle", "kettle") == 1.0


def test_names_are_cut_by_the_fewest_known_words():
    known = Spellings(["Orla Quist", "Orlaq Uist", "Belinda Tov", "belindatov", "mrbelindatov"])
    assert known.cut("orlaquist") == ("orlaq", "uist")  # two pieces either way: the longest first
    assert known.cut("quistbel") == ("quist", "bel") and known.cut("quistb") == ("quist", "b") and known.cut("quistzzz") == ()
    assert known.words("belindatov") == ("belindatov",)  # a spelling of its own is a word like others
    assert Spellings(["Belinda Tov", "MrBelindaTov"]).words("MrBelindaTov") == ("belinda", "tov")  # without the title


def test_names_match_by_assignment():
    same = Spellings([]).same
    assert same("Quist O", "Orla Quist") and same("Orla Quist", "Quist Orla") and same("Dr Orla Quist", "Orla Quist")
    assert not same("Q O", "Orla Quist")  # no real word anchors, two initials
    assert not same("Orla Quist", "Orla Brandt") and not same("Quist", "Orla Quist")  # a real word is left
    assert same("Orla Quist T", "Orla Quist") and not same("O Q Tovmann", "Orla Quist Tovmann")
    assert assigned(("tov", "orla"), ("orlando", "tov")) is False  # jaro-winkler 0.914 of a beginning is no anchor
    assert group_names(["Ms Orla Quist", "Orla Quist", "Quist O", "Belinda Tov"], [1, 5, 2, 9]) == [
        ("Belinda Tov", "Belinda Tov"), ("Orla Quist", "Orla Quist"), ("Orla Quist", "Quist O"), ("Orla Quist", "Ms Orla Quist")]


def test_goal_paths():
    fit = Fit(np.array([100.0, 110, 90, 105, 95, 100, 102]))
    steps = fit.draw(np.random.default_rng(1), (4000, 12))
    assert fit.normal and abs(fit.mean - 100.2857) < 0.01
    assert chance(steps, 600.0) == 1.0 and chance(steps, 2400.0) == 0.0
    assert abs(needed(fit, steps, 1200.0, 0.5) - 100) <= 2


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, None, 5), (2, "x", 6)], "u int, m string, v int")
    new = spark.createDataFrame([(1, None, 7), (3, "y", 8)], "u int, m string, v int")
    once = upserted(old, new, ["u", "m"])
    assert sorted((r.u, r.v) for r in once.collect()) == [(1, 7), (2, 6), (3, 8)]
    assert sorted((r.u, r.v) for r in upserted(once, new, ["u", "m"]).collect()) == [(1, 7), (2, 6), (3, 8)]
    assert sorted((r.u, r.v) for r in scoped_replace(old, new, F.col("m") == "x").collect()) == [(1, 5), (1, 7), (3, 8)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_new_vectors_join_the_nearest_of_all_members(spark, tmp_path):
    from math import cos, radians, sin

    from tallyflow.operators.payees import cl2_incremental, clusters_of, joined_clusters

    turns = {0: 0, 2: 70, 1: 140, 3: 220}  # 1 is near 2, no seed, and far from 0, the seed
    rows = spark.createDataFrame([(5, i, [cos(radians(t)), sin(radians(t))]) for i, t in turns.items()], "group long, id long, vector array<double>")
    old = clusters_of(rows.filter("id % 2 = 0"), 0.3).join(rows, ["group", "id"])
    assert {(r.group, r.id): r.seed for r in joined_clusters(old, rows.filter("id % 2 = 1"), 0.3).collect()} == {(5, 1): 0, (5, 3): 3}
    assert cl2_incremental(spark, SF).select("group", "seed").distinct().count() > 5
    rnd = np.random.default_rng(3)
    old, new = (rnd.normal(size=(n, 3)) / 2 for n in (40, 30))
    pool = spark.createDataFrame([(g, int(i % 7), old[i].tolist()) for i in range(40) for g in (1, 2)], "group long, seed long, vector array<double>")
    seen = joined_clusters(pool, spark.createDataFrame([(1, i, new[i].tolist()) for i in range(30)], "group long, id long, vector array<double>"), 0.5, block=8)
    top = (new @ old.T).max(1)
    got = {r.id: r.seed for r in seen.collect()}
    assert len(got) == 30 and all(got[i] == int((new[i] @ old.T).argmax() % 7) for i in range(30) if top[i] >= 0.5)


def test_a_batch_replayed_after_a_crash_between_the_writes(spark, tmp_path):
    from tallyflow.streaming.incremental import recompute

    batch = spark.createDataFrame([(1, 7, "2024-01", 5), (2, 7, "2024-01", 6)], "txn_id long, user_id long, month string, x int").selectExpr("txn_id", "user_id", "CAST(x AS DECIMAL(18,2)) AS amount", "month")
    ledger, mart = f"file://{tmp_path}/ledger", f"file://{tmp_path}/mart"
    batch.write.mode("append").partitionBy("month").parquet(ledger)  # and then it stopped
    for _ in range(2):
        recompute(batch, ledger, mart)
        assert [(r.user_id, float(r.total), r.n) for r in spark.read.parquet(mart).collect()] == [(7, 11.0, 2)]
        assert spark.read.parquet(ledger).count() == 2


def test_impulse_buying_and_cancellability_by_hand(spark):
    rows = [(u, f"{u}-{i}", "2024-01", x) for u, xs in ((1, [50] * 5 + [10] * 30), (2, [45] * 5 + [25] * 11), (3, [70] * 5 + [50] * 3), (4, [9, 9])) for i, x in enumerate(xs)]
    shopping = spark.createDataFrame(rows, "user_id int, txn_id string, month string, debit int").selectExpr("user_id", "txn_id", "month", "CAST(debit AS DECIMAL(18,2)) AS debit")
    got = {r.user_id: (r.share, r.badge) for r in build(spark, "bh4_impulse", shopping=shopping).collect()}
    assert got == {1: (round(250 / 550, 6), "Moderate"), 2: (0.45, "Moderate"), 3: (0.7, "High")}
    kinds = {"LARGE": "cancellable", "ECONOMY": "pausable", "STANDARD": "essential", "SMALL": "essential", "PROMO": "obligation", "MEDIUM": "obligation"}
    ledger = spark.createDataFrame([(1, m, c) for c in kinds for m in (1, 2, 3)], "user_id int, m int, category string").selectExpr(
        "user_id", "make_date(2024, m, 1) AS ts", "24288 + m AS month_idx", "CAST(9 AS DECIMAL(18,2)) AS debit", "CAST(0 AS DECIMAL(18,2)) AS credit", "category AS merchant", "CAST(NULL AS STRING) AS payee", "category", "category AS cluster_id")
    assert {r.merchant: r.cancellability for r in build(spark, "rec1_debit_merchant", ledger=ledger).collect()} == kinds
