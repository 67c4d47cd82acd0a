"""Behaviour, context, trends, health and recovery, read from the monthly marts."""

from __future__ import annotations

from ..plans.relations import Spark, band, dbl, js_round, nearest_rank, r6, relation
from ..sources.adapters import ESSENTIALS, INVESTMENT, TRANSFER, names


def confidence(x: str, zero: float, full: float) -> str:
    """FN8: 40 to 97 by the share of evidence."""
    return js_round(f"40 + 57 * {band(x, zero, full, 1.0)}")


@relation
def bh1_discipline(d: Spark) -> str:
    return f"""
SELECT user_id, CASE WHEN cv <= 0.2e0 AND spikes = 0 THEN 'Good' WHEN cv <= 0.4e0 THEN 'Fair' ELSE 'Volatile' END AS badge, {js_round('cv * 100')} AS variation_pct, months, spikes, txns AS evidence,
       {confidence(dbl('months'), 2, 12)} AS confidence
FROM (SELECT user_id, count(*) AS months, CASE WHEN avg(spend) > 0 THEN stddev_samp(spend) / avg(spend) ELSE 0e0 END AS cv, CAST(sum(spiked) AS BIGINT) AS spikes, CAST(sum(n) AS BIGINT) AS txns FROM (
  SELECT user_id, month, sum(spend) AS spend, sum(n) AS n, max(CASE WHEN spiked THEN 1 ELSE 0 END) AS spiked FROM category_trend WHERE category IN ({names(ESSENTIALS)}) GROUP BY user_id, month) AS m
  WHERE spend > 0 GROUP BY user_id HAVING count(*) >= 3) AS s"""


@relation
def bh2_lifestyle(d: Spark) -> str:
    """The category whose last three present months exceed its earlier ones most, by over 30 %."""
    return f"""
SELECT user_id, category, {r6('recent')} AS recent_avg, {r6('prior')} AS prior_avg, {r6('(recent - prior) / prior * 100')} AS delta_pct, {js_round('(recent - prior) * 12')} AS impact, months AS evidence,
       {confidence(dbl('months'), 4, 12)} AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round((recent - prior) / prior, 9) DESC, category) AS rn FROM (
  SELECT user_id, category, count(*) AS months, avg(CASE WHEN back <= 3 THEN spend END) AS recent, avg(CASE WHEN back > 3 THEN spend END) AS prior FROM (
    SELECT user_id, category, {dbl('spend')} AS spend, row_number() OVER (PARTITION BY user_id, category ORDER BY month_idx DESC) AS back FROM monthly_category
    WHERE spend > 0 AND category NOT IN ({names((TRANSFER, INVESTMENT, *ESSENTIALS))})) AS b GROUP BY user_id, category HAVING count(*) >= 4) AS a
  WHERE prior > 0 AND (recent - prior) / prior * 100 > 30) AS r WHERE rn = 1"""


@relation
def bh3_refunds(d: Spark) -> str:
    """What came back, the largest month, and duplicates not yet recovered."""
    return f"""
SELECT m.user_id, {dbl('m.refunds')} AS refunds, m.n, m.largest_month, {r6('greatest(0e0, coalesce(f.dup, 0e0) - CAST(m.refunds AS DOUBLE))')} AS unrecovered FROM (
  SELECT user_id, sum(refunds) AS refunds, CAST(sum(refund_n) AS BIGINT) AS n, max(CASE WHEN rn = 1 THEN month END) AS largest_month FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY refunds DESC, month) AS rn FROM month_totals) AS r GROUP BY user_id HAVING sum(refunds) > 0) AS m
LEFT JOIN (SELECT user_id, sum(amount) AS dup FROM flags WHERE kind = 'duplicate_charge' GROUP BY user_id) AS f ON m.user_id = f.user_id"""


@relation
def shopping_facet(d: Spark) -> str:
    """AG16: total, the five largest payments, the months."""
    return f"""
SELECT user_id, {dbl('sum(debit)')} AS total, count(*) AS n, {dbl('sum(CASE WHEN rn <= 5 THEN debit ELSE 0 END)')} AS top5 FROM (
  SELECT user_id, debit, row_number() OVER (PARTITION BY user_id ORDER BY debit DESC, txn_id) AS rn FROM shopping) AS r GROUP BY user_id"""


@relation
def ag16_shopping(d: Spark) -> str:
    return f"""
SELECT s.user_id, s.total, s.n, s.top5, t.month1, t.month2 FROM shopping_facet s JOIN (
  SELECT user_id, max(CASE WHEN rn = 1 THEN month END) AS month1, max(CASE WHEN rn = 2 THEN month END) AS month2 FROM (
    SELECT user_id, month, row_number() OVER (PARTITION BY user_id ORDER BY sum(debit) DESC, month) AS rn FROM shopping GROUP BY user_id, month) AS m GROUP BY user_id) AS t ON s.user_id = t.user_id"""


@relation
def bh4_impulse(d: Spark) -> str:
    return f"""
SELECT user_id, {r6('top5 / total')} AS share, CASE WHEN top5 / total >= 0.7e0 THEN 'High' ELSE 'Moderate' END AS badge, n AS evidence, {confidence(dbl('n'), 3, 20)} AS confidence
FROM shopping_facet WHERE n >= 3 AND total > 0 AND top5 / total >= 0.45e0"""


@relation
def context_rows(d: Spark) -> str:
    """Category months with spending, numbered back from the last; missing months don't count."""
    return """
SELECT user_id, category, month, month_idx, spend, n, spend / n AS avg_txn, spiked OR (rolling > 0 AND spend > rolling * 1.3e0) AS up, rolling > 0 AND spend < rolling * 0.7e0 AS down,
       CAST(row_number() OVER (PARTITION BY user_id, category ORDER BY month_idx DESC) AS INTEGER) AS back FROM category_trend WHERE spend > 0"""


@relation
def context_runs(d: Spark) -> str:
    """WN8: length of the run from the end that is up, and that is down."""
    return """
SELECT user_id, category, coalesce(min(CASE WHEN NOT up THEN back END), max(back) + 1) - 1 AS up_run, coalesce(min(CASE WHEN NOT down THEN back END), max(back) + 1) - 1 AS down_run
FROM context_rows GROUP BY user_id, category"""


@relation
def event_months(d: Spark) -> str:
    """CX3: months up by a few payments far larger than the category's typical one."""
    return f"""
SELECT c.user_id, c.category, c.month, c.spend FROM context_rows c JOIN (
  SELECT user_id, category, {nearest_rank('avg_txn', 0.5, 'n1', 'r1')} AS med_txn FROM (
    SELECT user_id, category, avg_txn, row_number() OVER (PARTITION BY user_id, category ORDER BY avg_txn) AS r1, count(*) OVER (PARTITION BY user_id, category) AS n1 FROM context_rows WHERE NOT up AND avg_txn > 0) AS a
  GROUP BY user_id, category) AS t ON c.user_id = t.user_id AND c.category = t.category JOIN (
  SELECT user_id, category, {nearest_rank('n', 0.5, 'n2', 'r2')} AS med_n FROM (
    SELECT user_id, category, n, row_number() OVER (PARTITION BY user_id, category ORDER BY n) AS r2, count(*) OVER (PARTITION BY user_id, category) AS n2 FROM context_rows) AS b
  GROUP BY user_id, category) AS k ON c.user_id = k.user_id AND c.category = k.category
WHERE c.up AND t.med_txn > 0 AND c.avg_txn >= t.med_txn * 2.2e0 AND c.n <= greatest(2e0, k.med_n * 0.6e0)"""


@relation
def financial_context(d: Spark) -> str:
    return f"""
SELECT r.user_id, r.category, 'habit' AS classification, CASE WHEN r.up_run >= 3 THEN 'up' ELSE 'down' END AS direction, CAST(CASE WHEN r.up_run >= 3 THEN r.up_run ELSE r.down_run END AS BIGINT) AS months, {js_round('sum(c.spend)')} AS amount
FROM context_runs r JOIN context_rows c ON c.user_id = r.user_id AND c.category = r.category AND c.back <= CASE WHEN r.up_run >= 3 THEN r.up_run ELSE r.down_run END
WHERE r.up_run >= 3 OR r.down_run >= 3 GROUP BY r.user_id, r.category, r.up_run, r.down_run
UNION ALL
SELECT e.user_id, e.category, 'event', 'up', count(*), {js_round('sum(e.spend)')} FROM event_months e JOIN context_runs r ON r.user_id = e.user_id AND r.category = e.category
WHERE r.up_run < 3 AND r.down_run < 3 GROUP BY e.user_id, e.category"""


@relation
def cx_financial_context(d: Spark) -> str:
    """CX1-CX3."""
    return "SELECT user_id, category, classification, direction, months, amount FROM financial_context"


@relation
def bh5_merged_patterns(d: Spark) -> str:
    """Lifestyle inflation, but not of a category that is an event."""
    return "SELECT b.user_id, b.category, b.impact FROM bh2_lifestyle b WHERE NOT EXISTS (SELECT 1 FROM financial_context c WHERE c.user_id = b.user_id AND c.category = b.category AND c.classification = 'event')"


@relation
def trend_candidates(d: Spark) -> str:
    """WN9: six months against those before from eight months on, three from five on."""
    win = "CASE WHEN r.months >= 8 THEN 6 ELSE 3 END"
    return f"""
SELECT r.user_id, 'Net savings' AS label, 'net_savings' AS kind, avg(CASE WHEN r.back <= {win} THEN r.net END) AS recent, avg(CASE WHEN r.back > {win} THEN r.net END) AS prior, 1 AS sign
FROM recent_months r WHERE r.months >= 5 GROUP BY r.user_id
UNION ALL
SELECT r.user_id, g.category, 'category', avg(CASE WHEN r.back <= {win} THEN {dbl('g.spend')} END), avg(CASE WHEN r.back > {win} THEN {dbl('g.spend')} END), CASE WHEN g.category = '{INVESTMENT}' THEN 1 ELSE -1 END
FROM recent_months r JOIN category_grid g ON g.user_id = r.user_id AND g.month_idx = r.month_idx WHERE r.months >= 5 GROUP BY r.user_id, g.category"""


@relation
def tr1_recent_trends(d: Spark) -> str:
    """The best improvement and the worst deterioration of at least 500 and 15 %."""
    return f"""
SELECT user_id, CASE WHEN gain > 0 THEN 'good' ELSE 'bad' END AS side, label, kind, {r6('recent')} AS recent_avg, {r6('prior')} AS prior_avg FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, gain > 0 ORDER BY round(abs(gain), 6) DESC, label) AS rn FROM (
    SELECT *, (recent - prior) * sign AS gain FROM trend_candidates
    WHERE abs(recent - prior) >= 500 AND abs(recent - prior) / greatest(prior, recent, 1e0) >= 0.15e0) AS c WHERE gain <> 0) AS r WHERE rn = 1"""


def _health_inputs(months: str) -> str:
    def med(x: str) -> str:
        return f"max(CASE WHEN rn_{x} = least(CAST(floor(0.5 * n) AS BIGINT) + 1, n) THEN {x} END)"

    return f"""
SELECT m.user_id, m.months, m.deficits, m.shortfall, m.med_income, m.med_expenses, m.med_rate, m.mean_net, m.std_net, coalesce(e.exposure, 0e0) AS exposure, coalesce(e.high, 0) AS high, coalesce(s.committed, 0e0) AS committed
FROM (SELECT user_id, count(*) AS months, count(CASE WHEN net < 0 THEN 1 END) AS deficits, avg(CASE WHEN net < 0 THEN -net END) AS shortfall, {med('income')} AS med_income, {med('expenses')} AS med_expenses, {med('rate')} AS med_rate,
             avg(net) AS mean_net, coalesce(stddev_samp(net), 0e0) AS std_net
      FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY income) AS rn_income, row_number() OVER (PARTITION BY user_id ORDER BY expenses) AS rn_expenses,
                   row_number() OVER (PARTITION BY user_id ORDER BY rate) AS rn_rate FROM {months}) AS r GROUP BY user_id) AS m
LEFT JOIN exposure e ON m.user_id = e.user_id LEFT JOIN ag27_recurring_summary s ON m.user_id = s.user_id"""


@relation
def health_inputs(d: Spark) -> str:
    return _health_inputs("monthly")


def _health_drivers(inputs: str) -> str:
    cv = "CASE WHEN abs(mean_net) > 0 THEN std_net / abs(mean_net) END"
    return f"""
SELECT user_id, {band('med_rate', 0, 30)} AS savings,
       0.6e0 * {band(f"{dbl('deficits')} / months", 0.5, 0)} + 0.4e0 * CASE WHEN {cv} IS NULL THEN 50e0 ELSE {band(cv, 2, 0.5)} END AS cash_flow,
       greatest(0e0, {band('CASE WHEN med_expenses > 0 THEN exposure / med_expenses ELSE 0e0 END', 1, 0)} - least(20, high * 4)) AS money_at_risk,
       CASE WHEN med_income > 0 THEN {band('committed / CASE WHEN med_income > 0 THEN med_income ELSE 1e0 END', 0.6, 0.2)} ELSE 50e0 END AS committed_spending FROM {inputs}"""


@relation
def health_drivers(d: Spark) -> str:
    """HS1-HS4."""
    return _health_drivers("health_inputs")


@relation
def hs_drivers(d: Spark) -> str:
    return f"SELECT user_id, {', '.join(f'{r6(c)} AS {c}' for c in ('savings', 'cash_flow', 'money_at_risk', 'committed_spending'))} FROM health_drivers"


TOTAL = "savings * 0.3e0 + cash_flow * 0.3e0 + money_at_risk * 0.25e0 + committed_spending * 0.15e0"


@relation
def hs5_health(d: Spark) -> str:
    """Score, FN22 risk level and each driver's contribution."""
    return f"""
SELECT user_id, score, CASE WHEN score >= 70 THEN 'low' WHEN score >= 45 THEN 'medium' ELSE 'high' END AS risk, {js_round('savings * 0.3e0')} AS savings_part, {js_round('cash_flow * 0.3e0')} AS cash_flow_part,
       {js_round('money_at_risk * 0.25e0')} AS risk_part, {js_round('committed_spending * 0.15e0')} AS committed_part FROM (SELECT *, {js_round(f'round({TOTAL}, 9)')} AS score FROM health_drivers) AS h"""


@relation
def planned_months(d: Spark) -> str:
    """Every month as it would have been with the plan's bounded impact; users without a projection keep theirs."""
    return """
SELECT m.user_id, m.month, m.month_idx, m.income, m.expenses, m.net + coalesce(p.uplift, 0e0) AS net,
       CASE WHEN coalesce(p.uplift, 0e0) > 0 AND m.income > 0 THEN (m.net + p.uplift) / m.income * 100 ELSE m.rate END AS rate
FROM monthly m LEFT JOIN (SELECT user_id, greatest(CAST(with_plan - per_month AS DOUBLE), 0e0) AS uplift FROM plan) AS p ON p.user_id = m.user_id"""


@relation
def planned_inputs(d: Spark) -> str:
    return _health_inputs("planned_months")


@relation
def planned_drivers(d: Spark) -> str:
    return _health_drivers("planned_inputs")


@relation
def hs5_after_plan(d: Spark) -> str:
    """The same score over the planned months, beside the score as it is."""
    after = js_round(f"round({TOTAL}, 9)")
    return f"""
SELECT a.user_id, h.score, a.after, a.after - h.score AS gain, CASE WHEN a.after >= 70 THEN 'low' WHEN a.after >= 45 THEN 'medium' ELSE 'high' END AS risk_after
FROM (SELECT user_id, {after} AS after FROM planned_drivers) AS a JOIN hs5_health h ON h.user_id = a.user_id"""


@relation
def months_before(d: Spark) -> str:
    """What the report before this one knew: all months but the last."""
    return "SELECT user_id, month, month_idx, income, expenses, net, rate FROM recent_months WHERE back > 1"


@relation
def inputs_before(d: Spark) -> str:
    return _health_inputs("months_before")


@relation
def drivers_before(d: Spark) -> str:
    return _health_drivers("inputs_before")


#: The drivers' keys with their weights.
WEIGHTS = {"savings": 0.3, "cash_flow": 0.3, "money_at_risk": 0.25, "committed_spending": 0.15}


def _by_driver(rows: str) -> str:
    return " UNION ALL ".join(f"SELECT user_id, '{k}' AS driver, {js_round(f'round({k} * {w}e0, 9)')} AS contribution FROM {rows}" for k, w in WEIGHTS.items())


@relation
def hs5_driver_trends(d: Spark) -> str:
    """JN11: each driver's movement since the report before, matched by its key; null without one."""
    return f"""
SELECT n.user_id, n.driver, n.contribution, n.contribution - o.contribution AS trend
FROM ({_by_driver('health_drivers')}) AS n LEFT JOIN ({_by_driver('drivers_before')}) AS o ON o.user_id = n.user_id AND o.driver = n.driver"""


@relation
def recommendations(d: Spark) -> str:
    """Stand-ins for the advisor's list: a tenth off each of a user's three largest categories, a
    claim beyond any ceiling, one without a category, and one that names a known payee."""
    return """
SELECT user_id, concat('trim-', category) AS slug, category, CASE WHEN rn = 1 THEN 1e9 ELSE total / 10 / months END AS claimed, concat('Spend a tenth less on ', category) AS action FROM (
  SELECT user_id, category, CAST(sum(spend) AS DOUBLE) AS total, count(*) AS months, row_number() OVER (PARTITION BY user_id ORDER BY sum(spend) DESC, category) AS rn FROM monthly_category GROUP BY user_id, category) AS c WHERE rn <= 3
UNION ALL SELECT DISTINCT user_id, 'move-idle-cash', CAST(NULL AS STRING), 750e0, 'Move idle cash' FROM month_totals
UNION ALL SELECT user_id, 'pay-less', min(category), 500e0, concat('Log transfers to ', min(payee), ' and send less') FROM recurring WHERE payee IS NOT NULL AND category IS NOT NULL GROUP BY user_id"""


@relation
def bounded(d: Spark) -> str:
    """RP1, RP2: claims stay below the category's median month, else the median expenses; evidence scores."""
    return f"""
SELECT r.user_id, r.slug, r.category, r.claimed, least(greatest(r.claimed, 0e0), coalesce(c.med, e.med)) AS impact, coalesce(c.med, e.med) AS ceiling, c.cv, c.n AS seen, m.months
FROM recommendations r JOIN (SELECT user_id, med FROM expense_medians) AS e ON r.user_id = e.user_id JOIN (SELECT user_id, count(*) AS months FROM month_totals GROUP BY user_id) AS m ON r.user_id = m.user_id
LEFT JOIN (SELECT user_id, category, {nearest_rank(dbl('spend'), 0.5)} AS med, CASE WHEN count(*) >= 2 AND avg({dbl('spend')}) > 0 THEN stddev_samp({dbl('spend')}) / avg({dbl('spend')}) END AS cv, count(*) AS n FROM (
  SELECT user_id, category, spend, row_number() OVER (PARTITION BY user_id, category ORDER BY spend) AS rn, count(*) OVER (PARTITION BY user_id, category) AS n FROM monthly_category) AS s GROUP BY user_id, category) AS c
ON c.user_id = r.user_id AND c.category = r.category"""


@relation
def rp2_confidence(d: Spark) -> str:
    steady = f"CASE WHEN cv IS NULL THEN 0.5e0 ELSE {band('cv', 1, 0.25, 1.0)} END"
    seen = f"CASE WHEN seen IS NULL THEN 0.5e0 ELSE {band(f'CAST(seen AS DOUBLE) / months', 0.25, 0.75, 1.0)} END"
    room = f"CASE WHEN ceiling > 0 THEN {band('impact / ceiling', 0.75, 0.15, 1.0)} ELSE 0.5e0 END"
    weighted = f"0.35e0 * CASE WHEN impact < claimed THEN 0 ELSE 1 END + 0.25e0 * {steady} + 0.2e0 * {seen} + 0.2e0 * {room}"
    return f"SELECT user_id, slug, {r6('impact')} AS impact, impact < claimed AS clamped, {js_round(f'round(40 + 57 * ({weighted}), 9)')} AS confidence FROM bounded"


@relation
def baseline(d: Spark) -> str:
    """FN10, FN11: mean of the last six months without low outliers (if three are left), and the spread of all."""
    return f"""
SELECT w.user_id, {js_round("CASE WHEN count(CASE WHEN NOT low THEN 1 END) >= 3 THEN avg(CASE WHEN NOT low THEN net END) ELSE avg(net) END")} AS per_month, max(s.std) AS std, max(s.anchor) AS anchor, max(s.last_idx) AS last_idx
FROM (SELECT r.user_id, r.net, q.q3 > q.q1 AND r.net < q.q1 - 1.5e0 * (q.q3 - q.q1) AS low FROM recent_months r JOIN (
  SELECT user_id, {nearest_rank('net', 0.25)} AS q1, {nearest_rank('net', 0.75)} AS q3 FROM (SELECT user_id, net, row_number() OVER (PARTITION BY user_id ORDER BY net) AS rn, count(*) OVER (PARTITION BY user_id) AS n
  FROM recent_months WHERE back <= 6) AS o GROUP BY user_id) AS q ON q.user_id = r.user_id WHERE r.back <= 6) AS w
JOIN (SELECT user_id, coalesce(stddev_samp(net), 0e0) AS std, {js_round('CAST(sum(CAST(net AS DECIMAL(18,2))) AS DOUBLE)')} AS anchor, max(month_idx) AS last_idx FROM monthly GROUP BY user_id HAVING count(*) >= 3) AS s ON s.user_id = w.user_id GROUP BY w.user_id"""


@relation
def plan(d: Spark) -> str:
    """Of users with three months or more: the baseline, and the baseline with all bounded impacts, rounded."""
    return f"""
SELECT b.user_id, b.per_month, b.std, b.anchor, b.last_idx, p.impact, {js_round('round(b.per_month + p.impact, 9)')} AS with_plan
FROM baseline b JOIN (SELECT user_id, sum(impact) AS impact FROM bounded GROUP BY user_id) AS p ON p.user_id = b.user_id"""


@relation
def rp3_projection(d: Spark) -> str:
    """Twelve months of the baseline with its tenth and ninetieth percentiles, and of the plan."""
    return f"""
SELECT user_id, k AS month_no, last_idx + k AS month_idx, anchor + per_month * k AS baseline_p50, {js_round('round(anchor + per_month * k - 1.2816e0 * std * sqrt(k), 4)')} AS baseline_p10,
       {js_round('round(anchor + per_month * k + 1.2816e0 * std * sqrt(k), 4)')} AS baseline_p90, anchor + with_plan * k AS plan_p50
FROM (SELECT p.*, CAST(v.k AS INTEGER) AS k FROM plan p CROSS JOIN (SELECT {d.count_up('1', '12')} AS k) AS v) AS g"""


@relation
def rp3_by_recommendation(d: Spark) -> str:
    """Each recommendation's own twelve months, what it saves in a year, and the whole plan's gap by then."""
    return f"""
SELECT g.user_id, g.slug, g.k AS month_no, {js_round('round(g.anchor + (g.per_month + g.impact) * g.k, 4)')} AS p50, {js_round('round(g.impact, 6)')} AS impact, {js_round('round(g.impact * 12, 6)')} AS annual_impact, c.confidence, {js_round('round(g.total * 12, 4)')} AS gap_12m
FROM (SELECT b.user_id, b.slug, b.impact, p.anchor, p.per_month, p.impact AS total, CAST(v.k AS INTEGER) AS k FROM bounded b JOIN plan p ON p.user_id = b.user_id CROSS JOIN (SELECT {d.count_up('1', '12')} AS k) AS v) AS g
JOIN rp2_confidence c ON c.user_id = g.user_id AND c.slug = g.slug"""


@relation
def rv1_valid_recommendations(d: Spark) -> str:
    """Only categories seen in the last six months that are not one-off events, and no known payee named
    (FN24: all of the name's words of three letters or more stand in the text). One without a category stays."""
    return f"""
SELECT r.user_id, r.slug FROM recommendations r WHERE r.category IS NULL OR (
  EXISTS (SELECT 1 FROM monthly_category c JOIN recent_months m ON m.user_id = c.user_id AND m.month_idx = c.month_idx WHERE m.back <= 6 AND c.user_id = r.user_id AND c.category = r.category)
  AND NOT EXISTS (SELECT 1 FROM recurring p WHERE p.user_id = r.user_id AND p.payee IS NOT NULL AND {d.all_words('lower(p.payee)', 'lower(r.action)')})
  AND NOT EXISTS (SELECT 1 FROM financial_context x WHERE x.user_id = r.user_id AND x.category = r.category AND x.classification = 'event'))"""


@relation
def ir1_report(d: Spark) -> str:
    """One row for each user out of the marts; FN21 tier by months of history."""
    return f"""
SELECT h.user_id, h.score, h.risk, i.months, CASE WHEN i.months = 1 THEN 1 WHEN i.months < 6 THEN 2 ELSE 3 END AS tier, {r6('i.med_rate')} AS median_rate, {r6('i.exposure')} AS exposure, coalesce(c.n, 0) AS contexts, p.plan_p50 AS plan_12m
FROM hs5_health h JOIN health_inputs i ON i.user_id = h.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM financial_context GROUP BY user_id) AS c ON c.user_id = h.user_id
LEFT JOIN (SELECT user_id, plan_p50 FROM rp3_projection WHERE month_no = 12) AS p ON p.user_id = h.user_id"""


@relation
def ir1_chart(d: Spark) -> str:
    """The report's monthly chart rows."""
    return f"""
SELECT m.user_id, m.month, m.income, m.expenses, m.net AS net_savings, {r6('m.rate')} AS savings_rate, c.closing_balance, t.total_refunds, t.refund_count
FROM monthly m JOIN ag02_month_totals c ON c.user_id = m.user_id AND c.month = m.month JOIN ag04_refunds t ON t.user_id = m.user_id AND t.month = m.month"""


@relation
def ir2_depths(d: Spark) -> str:
    """A report at each depth: the score always; the first recommendation or all; charts from the summary
    on; forecasts in full only; and the plan that unlocks the next depth."""
    return """
SELECT r.user_id, x.depth, r.score, r.risk, r.tier, CASE x.level WHEN 1 THEN least(v.n, 1) ELSE v.n END AS recommendations, CASE WHEN x.level > 1 THEN CAST(r.months AS DOUBLE) END AS chart_months, CASE WHEN x.level = 3 THEN CAST(r.plan_12m AS DOUBLE) END AS plan_12m,
       x.level < 3 AS redacted, CASE x.level WHEN 1 THEN 'glow' WHEN 2 THEN 'radiant' END AS unlocked_by
FROM ir1_report r JOIN (SELECT user_id, count(*) AS n FROM rv1_valid_recommendations GROUP BY user_id) AS v ON v.user_id = r.user_id
CROSS JOIN (SELECT * FROM (VALUES ('headline', 1), ('summary', 2), ('full', 3)) AS t(depth, level)) AS x"""


@relation
def plans(d: Spark) -> str:
    """PL1's catalogue, fixed values: monthly price, price a month by the year, statements and goals
    (null: any number), depth of reports."""
    return """
SELECT * FROM (VALUES ('first', 0, 0, 1, 0, 'headline'), ('glow', 499, 399, CAST(NULL AS INTEGER), 0, 'summary'), ('radiant', 999, 799, NULL, CAST(NULL AS INTEGER), 'full')) AS t(plan, monthly, annual, statements, goals, depth)"""


@relation
def pl1_entitlements(d: Spark) -> str:
    """Each customer's plan by name; an unknown name reads as the free plan. May the next statement come in?"""
    return """
SELECT u.c_custkey, p.plan, p.monthly, p.depth, coalesce(u.used < p.statements, true) AS may_upload
FROM (SELECT c.c_custkey, CASE WHEN k.plan IS NULL THEN 'first' ELSE k.plan END AS plan, coalesce(o.used, 0) AS used
      FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'glow' WHEN 'MACHINERY' THEN 'radiant' ELSE lower(c_mktsegment) END AS named FROM customer) AS c LEFT JOIN plans k ON k.plan = c.named
      LEFT JOIN (SELECT o_custkey, count(*) AS used FROM orders GROUP BY o_custkey) AS o ON o.o_custkey = c.c_custkey) AS u JOIN plans p ON p.plan = u.plan"""


@relation
def ir2_headline(d: Spark) -> str:
    """FN25: the least depth of a report; forecasts and drivers are left out."""
    return "SELECT user_id, score, risk, tier FROM ir1_report"
