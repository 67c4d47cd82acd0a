"""Monthly marts and the windows over them."""

from __future__ import annotations

from ..plans.relations import Spark, dbl, js_round, mart, nearest_rank, r6, relation


LABEL = "coalesce(merchant, payee, cluster_id)"


@relation
def enriched(d: Spark) -> str:
    """AG1: the one enriched input that the monthly aggregates share."""
    return f"""
SELECT txn_id, user_id, ts, month, month_idx, debit, credit, merchant, payee, coalesce(category, 'Other') AS category,
       {d.dow('ts')} IN (1, 7) AS weekend, CASE WHEN day(ts) <= 7 THEN 1 WHEN day(ts) <= 14 THEN 2 WHEN day(ts) <= 21 THEN 3 ELSE 4 END AS week
FROM ledger"""


@relation
def closing(d: Spark) -> str:
    return """
SELECT user_id, month, balance AS closing FROM (
  SELECT user_id, month, balance, row_number() OVER (PARTITION BY user_id, month ORDER BY ts DESC, txn_id DESC) AS rn FROM ledger_balance) AS b WHERE rn = 1"""


@mart()
def month_totals(d: Spark) -> str:
    """AG2-AG4, AG7, AG8: one pass of conditional sums."""
    weeks = ",\n".join(f"sum(CASE WHEN week = {w} THEN debit ELSE 0 END) AS week{w}, count(CASE WHEN week = {w} AND debit > 0 THEN 1 END) AS week{w}_n" for w in (1, 2, 3, 4))
    return f"""
SELECT user_id, month, month_idx, sum(credit) AS income, sum(debit) AS expenses,
       sum(CASE WHEN credit > 0 AND merchant IS NOT NULL THEN credit ELSE 0 END) AS refunds, count(CASE WHEN credit > 0 AND merchant IS NOT NULL THEN 1 END) AS refund_n,
       sum(CASE WHEN weekend THEN debit ELSE 0 END) AS weekend, count(CASE WHEN weekend AND debit > 0 THEN 1 END) AS weekend_n,
       sum(CASE WHEN NOT weekend THEN debit ELSE 0 END) AS weekday, count(CASE WHEN NOT weekend AND debit > 0 THEN 1 END) AS weekday_n,
       {weeks}
FROM enriched GROUP BY user_id, month, month_idx"""


@relation
def ag02_month_totals(d: Spark) -> str:
    return f"""
SELECT m.user_id, m.month, {dbl('income')} AS income, {dbl('expenses')} AS expenses, {dbl('closing')} AS closing_balance
FROM month_totals m JOIN closing c ON m.user_id = c.user_id AND m.month = c.month"""


@relation
def monthly(d: Spark) -> str:
    """AG3: net savings and their rate."""
    return f"""
SELECT user_id, month, month_idx, {dbl('income')} AS income, {dbl('expenses')} AS expenses, {dbl('income - expenses')} AS net,
       CASE WHEN income > 0 THEN {dbl('income - expenses')} / {dbl('income')} * 100 ELSE 0e0 END AS rate FROM month_totals"""


@relation
def ag03_savings(d: Spark) -> str:
    return f"SELECT user_id, month, net AS net_savings, {r6('rate')} AS savings_rate FROM monthly"


@relation
def ag04_refunds(d: Spark) -> str:
    return f"SELECT user_id, month, {dbl('refunds')} AS total_refunds, refund_n AS refund_count FROM month_totals"


@mart()
def monthly_category(d: Spark) -> str:
    return """
SELECT user_id, month, month_idx, category, sum(debit) AS spend, count(*) AS n FROM enriched WHERE debit > 0 GROUP BY user_id, month, month_idx, category"""


@relation
def ag05_category_breakdown(d: Spark) -> str:
    return f"""
SELECT user_id, month, category, {dbl('spend')} AS total_spend, n AS txn_count, {r6(f"{dbl('spend')} / n")} AS avg_txn,
       {r6(f"{dbl('spend')} / {dbl('sum(spend) OVER (PARTITION BY user_id, month)')} * 100")} AS share_of_total FROM monthly_category"""


@relation
def top_merchants(d: Spark) -> str:
    """AG6: ten merchants a month."""
    return """
SELECT user_id, month, merchant, category, spend, n, rn FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, month ORDER BY spend DESC, merchant, category) AS INTEGER) AS rn FROM (
    SELECT user_id, month, merchant, category, sum(debit) AS spend, count(*) AS n FROM enriched WHERE debit > 0 AND merchant IS NOT NULL
    GROUP BY user_id, month, merchant, category) AS g) AS r WHERE rn <= 10"""


@relation
def ag06_top_merchants(d: Spark) -> str:
    return f"SELECT user_id, month, merchant, category, {dbl('spend')} AS total_spend, n AS txn_count, rn AS place FROM top_merchants"


@relation
def ag07_weekday_weekend(d: Spark) -> str:
    return f"""
SELECT user_id, month, {dbl('weekday')} AS weekday_spend, weekday_n, {r6(f"CASE WHEN weekday_n > 0 THEN {dbl('weekday')} / weekday_n ELSE 0 END")} AS weekday_avg,
       {dbl('weekend')} AS weekend_spend, weekend_n, {r6(f"CASE WHEN weekend_n > 0 THEN {dbl('weekend')} / weekend_n ELSE 0 END")} AS weekend_avg FROM month_totals"""


@relation
def ag08_week_buckets(d: Spark) -> str:
    return f"SELECT user_id, month, {', '.join(f'CAST(week{w} AS DOUBLE) AS week{w}, week{w}_n' for w in (1, 2, 3, 4))} FROM month_totals"


@relation
def ag09_affected_months(d: Spark) -> str:
    return "SELECT DISTINCT user_id, statement_id, month FROM ledger"


@relation
def ag10_cascade_months(d: Spark) -> str:
    """The affected months of a statement and the next month after its last, if there is one."""
    return """
SELECT a.user_id, a.statement_id, a.month FROM ag09_affected_months a
UNION
SELECT l.user_id, l.statement_id, m.month FROM (SELECT user_id, statement_id, max(month_idx) AS last_idx FROM ledger GROUP BY user_id, statement_id) AS l
JOIN month_totals m ON m.user_id = l.user_id AND m.month_idx = l.last_idx + 1"""


@relation
def category_grid(d: Spark) -> str:
    """Every month that has transactions by every category of the user, zero where it is missing."""
    return """
SELECT m.user_id, m.month, m.month_idx, c.category, coalesce(s.spend, 0) AS spend, s.n
FROM (SELECT user_id, month, month_idx FROM month_totals) AS m
JOIN (SELECT DISTINCT user_id, category FROM monthly_category) AS c ON m.user_id = c.user_id
LEFT JOIN monthly_category s ON s.user_id = m.user_id AND s.month_idx = m.month_idx AND s.category = c.category"""


@mart()
def category_trend(d: Spark) -> str:
    """WN2-WN5 over the grid; the window of six rows includes the month itself."""
    return f"""
SELECT user_id, month, month_idx, category, {dbl('spend')} AS spend, n, {dbl('spend - coalesce(p1, 0)')} AS delta,
       CASE WHEN coalesce(p1, 0) > 0 THEN {dbl('spend - p1')} / {dbl('p1')} * 100 ELSE 0e0 END AS delta_pct,
       {dbl('s6')} / n6 AS rolling, {dbl('spend')} > {dbl('s6')} / n6 * 2 AS spiked,
       CASE WHEN spend > coalesce(p1, spend) AND coalesce(p1, spend) > coalesce(p2, spend) THEN 'rising'
            WHEN spend < coalesce(p1, spend) AND coalesce(p1, spend) < coalesce(p2, spend) THEN 'falling' ELSE 'stable' END AS trend
FROM (SELECT *, lag(spend, 1) OVER w AS p1, lag(spend, 2) OVER w AS p2, sum(spend) OVER (PARTITION BY user_id, category ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s6,
             count(*) OVER (PARTITION BY user_id, category ORDER BY month_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n6
      FROM category_grid WINDOW w AS (PARTITION BY user_id, category ORDER BY month_idx)) AS g
WHERE n IS NOT NULL"""


@relation
def wn_monthly_category_trends(d: Spark) -> str:
    return f"""
SELECT t.user_id, t.month, t.category, t.spend AS total_spend, t.n AS txn_count, {r6('t.spend / t.n')} AS avg_txn, {r6('t.spend / m.expenses * 100')} AS share_of_total,
       {r6('t.delta')} AS mom_delta_amount, {r6('t.delta_pct')} AS mom_delta, {r6('t.rolling')} AS rolling_avg_6m, t.spiked AS is_spiked, t.trend AS trend_direction
FROM category_trend t JOIN monthly m ON t.user_id = m.user_id AND t.month = m.month"""


@relation
def ag19_category_totals(d: Spark) -> str:
    return f"SELECT user_id, category, {dbl('sum(spend)')} AS total_spend, CAST(sum(n) AS BIGINT) AS txn_count FROM monthly_category GROUP BY user_id, category"


@relation
def ag20_merchant_totals(d: Spark) -> str:
    """Over the monthly top tens only."""
    return f"SELECT user_id, merchant, {dbl('sum(spend)')} AS total_spend, CAST(sum(n) AS BIGINT) AS txn_count FROM top_merchants GROUP BY user_id, merchant"


@relation
def ag21_account_rhythm_totals(d: Spark) -> str:
    return f"SELECT user_id, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in ('weekday', 'weekend', 'week1', 'week2', 'week3', 'week4'))} FROM month_totals GROUP BY user_id"


@relation
def recent_months(d: Spark) -> str:
    """WN15: months numbered back from each user's last."""
    return """
SELECT user_id, month, month_idx, income, expenses, net, rate, CAST(row_number() OVER (PARTITION BY user_id ORDER BY month_idx DESC) AS INTEGER) AS back,
       CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS months FROM monthly"""


@relation
def wn15_last_six(d: Spark) -> str:
    return "SELECT user_id, month, net, back FROM recent_months WHERE back <= 6"


@relation
def ag22_recent_categories(d: Spark) -> str:
    return f"""
SELECT c.user_id, c.category, {dbl('sum(c.spend)')} AS total_spend, {r6(f"{dbl('sum(c.spend)')} / max(least(r.months, 6))")} AS avg_per_month
FROM monthly_category c JOIN recent_months r ON c.user_id = r.user_id AND c.month_idx = r.month_idx WHERE r.back <= 6 GROUP BY c.user_id, c.category"""


@relation
def ag32_uncategorised(d: Spark) -> str:
    return "SELECT user_id, month, share_of_total FROM ag05_category_breakdown WHERE category = 'Uncategorized' AND share_of_total > 15"


@relation
def wn07_recent_vs_prior(d: Spark) -> str:
    """Zero-filled averages of the last three months and those before."""
    return f"""
SELECT user_id, category, {r6('recent')} AS recent_avg, {r6('prior')} AS prior_avg, {r6('CASE WHEN prior > 0 THEN (recent - prior) / prior * 100 END')} AS delta_pct, prior = 0 AND recent > 0 AS is_new
FROM (SELECT g.user_id, g.category, {dbl('sum(CASE WHEN r.back <= 3 THEN g.spend ELSE 0 END)')} / max(least(r.months, 3)) AS recent,
             CASE WHEN max(r.months) > 3 THEN {dbl('sum(CASE WHEN r.back > 3 THEN g.spend ELSE 0 END)')} / (max(r.months) - 3) ELSE 0e0 END AS prior
      FROM category_grid g JOIN recent_months r ON g.user_id = r.user_id AND g.month_idx = r.month_idx GROUP BY g.user_id, g.category) AS a"""


@relation
def wn10_cumulative(d: Spark) -> str:
    run = "sum(CAST(net AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY month_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SELECT user_id, month, {js_round(dbl(run))} AS cumulative FROM monthly"


@relation
def wn14_smoothed(d: Spark) -> str:
    """Gaussian kernel over the months' expenses: four samples a step, width max(1, sqrt(n) / 3)."""
    return f"""
SELECT p.user_id, p.x, {r6("sum(exp(-0.5e0 * pow((p.x - m.i) / p.h, 2)) * m.expenses) / sum(exp(-0.5e0 * pow((p.x - m.i) / p.h, 2)))")} AS value
FROM (SELECT user_id, h, s / 4e0 AS x FROM (SELECT user_id, greatest(1e0, sqrt({dbl('months')}) / 3e0) AS h, {d.count_up('0', '(months - 1) * 4')} AS s
      FROM recent_months WHERE back = 1 AND months >= 3) AS g) AS p
JOIN (SELECT user_id, months - back AS i, expenses FROM recent_months) AS m ON p.user_id = m.user_id GROUP BY p.user_id, p.x"""


@relation
def wn13_lead_week(d: Spark) -> str:
    return f"""
SELECT user_id, month, month_idx, total, CASE WHEN total <= 0 THEN NULL WHEN week1 >= week2 AND week1 >= week3 AND week1 >= week4 THEN 'week1' WHEN week2 >= week3 AND week2 >= week4 THEN 'week2'
       WHEN week3 >= week4 THEN 'week3' ELSE 'week4' END AS lead_week, {r6('CASE WHEN total > 0 THEN greatest(week1, week2, week3, week4) / total ELSE 0 END')} AS lead_share, week1, week2, week3, week4
FROM (SELECT user_id, month, month_idx, {', '.join(f'CAST(week{w} AS DOUBLE) AS week{w}' for w in (1, 2, 3, 4))}, {dbl('week1 + week2 + week3 + week4')} AS total FROM month_totals) AS t"""


@relation
def ag34_usual_week(d: Spark) -> str:
    return """
SELECT user_id, lead_week AS usual_week, n, months FROM (SELECT user_id, lead_week, n, months, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_idx) AS rn FROM (
  SELECT user_id, lead_week, count(*) AS n, min(month_idx) AS first_idx, max(months) AS months FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS months FROM wn13_lead_week) AS w
  WHERE lead_week IS NOT NULL GROUP BY user_id, lead_week) AS c) AS r WHERE rn = 1"""


@relation
def weekend_fences(d: Spark) -> str:
    """FN9, FN11: nearest-rank quartiles and fences of each user's weekend shares."""
    return f"""
SELECT user_id, {nearest_rank('share', 0.5)} AS med, {nearest_rank('share', 0.25)} AS q1, {nearest_rank('share', 0.75)} AS q3, max(n) AS n FROM (
  SELECT user_id, share, row_number() OVER (PARTITION BY user_id ORDER BY share) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM weekend_share) AS r GROUP BY user_id"""


@relation
def weekend_share(d: Spark) -> str:
    return f"SELECT user_id, month, {dbl('weekend')} / {dbl('weekday + weekend')} AS share FROM month_totals WHERE weekday + weekend > 0"


@relation
def rhythm(d: Spark) -> str:
    return f"""
SELECT s.user_id, s.month, CASE WHEN s.share > f.med THEN 'weekend_heavy' ELSE 'weekday_heavy' END AS kind, {js_round('s.share', 3)} AS value, {js_round('f.med', 3)} AS baseline, {js_round('abs(s.share - f.med)', 3)} AS deviation
FROM weekend_share s JOIN weekend_fences f ON s.user_id = f.user_id
WHERE f.n >= 4 AND (s.share < f.q1 - 1.5e0 * (f.q3 - f.q1) OR s.share > f.q3 + 1.5e0 * (f.q3 - f.q1)) AND abs(s.share - f.med) >= 0.12e0
UNION ALL
SELECT user_id, month, 'timing_shift' AS kind, {js_round('lead', 3)} AS value, {js_round('usual', 3)} AS baseline, {js_round('lead - usual', 3)} AS deviation FROM (
  SELECT w.user_id, w.month, greatest(w.week1, w.week2, w.week3, w.week4) / w.total AS lead,
         CASE u.usual_week WHEN 'week1' THEN w.week1 WHEN 'week2' THEN w.week2 WHEN 'week3' THEN w.week3 ELSE w.week4 END / w.total AS usual
  FROM wn13_lead_week w JOIN ag34_usual_week u ON w.user_id = u.user_id JOIN weekend_fences f ON f.user_id = w.user_id
  WHERE f.n >= 4 AND u.n * 2 >= u.months AND w.lead_week <> u.usual_week) AS t WHERE lead - usual >= 0.12e0"""


@relation
def ry_rhythm(d: Spark) -> str:
    """RY1, RY2: the three largest anomalies of each user."""
    return """
SELECT user_id, month, kind, value, baseline, deviation FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY deviation DESC, month, kind) AS rn FROM rhythm) AS r WHERE rn <= 3"""


@relation
def ag17_category_detail(d: Spark) -> str:
    """AG17, CD1: totals, the largest payment and the account's share of each category."""
    return f"""
SELECT user_id, category, {dbl('sum(debit)')} AS total_spend, count(*) AS txn_count, {dbl('max(debit)')} AS largest, count(DISTINCT month) AS months,
       {r6(f"{dbl('sum(debit)')} / {dbl('sum(sum(debit)) OVER (PARTITION BY user_id)')} * 100")} AS share_of_total FROM enriched WHERE debit > 0 GROUP BY user_id, category"""


@relation
def cd1_months(d: Spark) -> str:
    return f"SELECT user_id, category, month, {dbl('spend')} AS spend, coalesce(n, 0) AS n FROM category_grid"


@relation
def cd1_largest(d: Spark) -> str:
    return f"""
SELECT user_id, category, txn_id, {dbl('debit')} AS amount, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, category ORDER BY debit DESC, txn_id) AS INTEGER) AS place
FROM enriched WHERE debit > 0) AS r WHERE place <= 5"""


@relation
def cd2_week_pattern(d: Spark) -> str:
    """Each category's weekend share against the account's: five points either way lean."""
    return f"""
SELECT user_id, category, {r6('share')} AS weekend_share, {r6('account')} AS account_share, CASE WHEN share - account > 5 THEN 'weekend' WHEN share - account < -5 THEN 'weekday' ELSE 'even' END AS lean
FROM (SELECT user_id, category, {dbl('sum(CASE WHEN weekend THEN debit ELSE 0 END)')} / {dbl('sum(debit)')} * 100 AS share,
             {dbl('sum(sum(CASE WHEN weekend THEN debit ELSE 0 END)) OVER (PARTITION BY user_id)')} / {dbl('sum(sum(debit)) OVER (PARTITION BY user_id)')} * 100 AS account
      FROM enriched WHERE debit > 0 GROUP BY user_id, category) AS s"""


@relation
def cd2_days(d: Spark) -> str:
    """Seven days from Monday, zero-filled."""
    return f"""
SELECT c.user_id, c.category, w.day, coalesce({dbl('s.spend')}, 0e0) AS spend, coalesce(s.n, 0) AS n
FROM (SELECT DISTINCT user_id, category FROM monthly_category) AS c CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6), (7)) AS v(day)) AS w
LEFT JOIN (SELECT user_id, category, CAST(({d.dow('ts')} + 5) % 7 + 1 AS INTEGER) AS day, sum(debit) AS spend, count(*) AS n FROM enriched WHERE debit > 0
           GROUP BY user_id, category, ({d.dow('ts')} + 5) % 7 + 1) AS s ON s.user_id = c.user_id AND s.category = c.category AND s.day = w.day"""


@relation
def ag18_merchants(d: Spark) -> str:
    """AG18, FN2: counterparties by label, kind and category; the first 25 of each user."""
    return f"""
SELECT user_id, name, kind, category, {dbl('spend')} AS total_spend, n AS txn_count, {r6(f"{dbl('spend')} / n")} AS avg_txn, last_date FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spend DESC, name, category) AS rn FROM (
    SELECT user_id, {LABEL} AS name, CASE WHEN merchant IS NOT NULL THEN 'merchant' WHEN payee IS NOT NULL THEN 'person' ELSE 'unnamed' END AS kind, coalesce(category, 'Other') AS category,
           sum(debit) AS spend, count(*) AS n, CAST(CAST(max(ts) AS DATE) AS STRING) AS last_date FROM ledger WHERE debit > 0
    GROUP BY user_id, {LABEL}, CASE WHEN merchant IS NOT NULL THEN 'merchant' WHEN payee IS NOT NULL THEN 'person' ELSE 'unnamed' END, coalesce(category, 'Other')) AS g) AS r WHERE rn <= 25"""
