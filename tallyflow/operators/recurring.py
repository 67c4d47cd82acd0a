"""Recurring patterns and the flags of the seven detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relations import DUCK, Spark, dbl, mart, nearest_rank, query, r6, ranked, relation, statement
from ..sources.adapters import ESSENTIALS, INVESTMENT, SUBSCRIPTION, TRANSFER, names

#: The words of a fee, penalty or interest charge, in any case and anywhere.
FEES = (
    r"late\s*fee", r"late\s*payment", "penal", "penalty", "fine", "bounce", "bounced", r"return\s*charge", r"ecs\s*(rtn|return)", r"chq\s*(rtn|return)",
    r"cheque\s*return", "insuff", "dishonour", "dishonor", r"od\s*interest", "overdraft", r"over\s*limit", "overlimit", r"interest\s*charge", r"finance\s*charge",
    r"annual\s*fee", r"joining\s*fee", r"amc\b", r"service\s*charge", r"processing\s*fee", r"convenience\s*fee", r"min(imum)?\s*due", r"atm\s*decl", r"cash\s*adv",
)


@relation
def user_span(d: Spark) -> str:
    """AG15: months from first to last, and the last transaction."""
    return "SELECT user_id, max(month_idx) - min(month_idx) AS span, max(month_idx) AS last_idx, max(ts) AS max_ts FROM ledger GROUP BY user_id"


#: WN11: the mean gap between distinct months telescopes to their range.
FREQUENCY = """CASE WHEN gap <= 1.5e0 THEN 'monthly' WHEN gap <= 3.5e0 THEN 'quarterly' WHEN gap > 10e0 AND span >= 24 THEN 'annually' END"""


@relation
def debit_candidates(d: Spark) -> str:
    """AG11: name and exact amount over three months or more (REC1, REC2)."""
    return """
SELECT user_id, 'debit' AS type, merchant, payee, amount, min(category) AS category, count(*) AS months, min(month_idx) AS first_idx, max(month_idx) AS last_seen, max(last_ts) AS last_ts FROM (
  SELECT user_id, merchant, CASE WHEN merchant IS NULL THEN payee END AS payee, debit AS amount, month_idx, min(category) AS category, max(ts) AS last_ts FROM ledger
  WHERE debit > 0 AND (merchant IS NOT NULL OR payee IS NOT NULL) GROUP BY user_id, merchant, CASE WHEN merchant IS NULL THEN payee END, debit, month_idx) AS m
GROUP BY user_id, merchant, payee, amount HAVING count(*) >= 3"""


@relation
def recurring_debit(d: Spark) -> str:
    """REC1, REC2, REC7, FN17, WN12."""
    return f"""
SELECT user_id, type, merchant, payee, category, {dbl('amount')} AS amount, CAST(NULL AS DOUBLE) AS range_min, CAST(NULL AS DOUBLE) AS range_max, CAST(NULL AS STRING) AS credit_label, frequency, months,
       CASE WHEN payee IS NOT NULL THEN 'obligation' WHEN category = '{SUBSCRIPTION}' THEN 'cancellable' WHEN category = '{INVESTMENT}' THEN 'pausable'
            WHEN category IN ({names(ESSENTIALS)}) THEN 'essential' ELSE 'obligation' END AS cancellability,
       last_seen >= last_idx - 1 AS is_active, last_ts
FROM (SELECT c.*, s.last_idx, s.span, {FREQUENCY.replace('gap', '(CAST(c.last_seen - c.first_idx AS DOUBLE) / (c.months - 1))').replace('span >=', 's.span >=')} AS frequency
      FROM debit_candidates c JOIN user_span s ON c.user_id = s.user_id) AS f WHERE frequency IS NOT NULL"""


@relation
def credit_months(d: Spark) -> str:
    """AG12: monthly credits of a source: merchant, else payee, else cluster; over 500 each."""
    return """
SELECT user_id, merchant, CASE WHEN merchant IS NULL THEN payee END AS payee, CASE WHEN merchant IS NULL AND payee IS NULL THEN cluster_id END AS cluster_key,
       month_idx, sum(credit) AS total, max(ts) AS last_ts, min(category) AS category
FROM ledger WHERE credit > 500 GROUP BY user_id, merchant, CASE WHEN merchant IS NULL THEN payee END, CASE WHEN merchant IS NULL AND payee IS NULL THEN cluster_id END, month_idx"""


@relation
def credit_candidates(d: Spark) -> str:
    """FN19: nearest-rank quartiles, population variation."""
    keys = "user_id, merchant, payee, cluster_key"
    return f"""
SELECT {keys}, count(*) AS months, min(month_idx) AS first_idx, max(month_idx) AS last_seen, max(last_ts) AS last_ts, min(category) AS category,
       {nearest_rank('x', 0.5)} AS med, {nearest_rank('x', 0.25)} AS q1, {nearest_rank('x', 0.75)} AS q3, CASE WHEN avg(x) > 0 THEN stddev_pop(x) / avg(x) ELSE 0e0 END AS cv
FROM (SELECT *, {dbl('total')} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY total) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM credit_months) AS r
GROUP BY {keys} HAVING count(*) >= 3"""


@relation
def recurring_credit(d: Spark) -> str:
    """REC3-REC5, FN18: income of a name or an unnamed cluster."""
    return f"""
SELECT user_id, 'credit' AS type, merchant, payee, category, med AS amount, CASE WHEN q3 > q1 THEN greatest(0e0, q1 - 0.5e0 * (q3 - q1)) ELSE med * 0.95e0 END AS range_min,
       CASE WHEN q3 > q1 THEN q3 + 0.5e0 * (q3 - q1) ELSE med * 1.05e0 END AS range_max,
       CASE WHEN payee IS NOT NULL THEN 'transfer_in' WHEN category = '{INVESTMENT}' THEN 'investment_return' WHEN med > 20000 AND cv < 0.15e0 THEN 'salary'
            WHEN med > 10000 AND cv < 0.4e0 THEN 'rental_income' WHEN cv > 0.4e0 THEN 'freelance' ELSE 'unknown' END AS credit_label,
       frequency, months, CAST(NULL AS STRING) AS cancellability, last_seen >= last_idx - 1 AS is_active, last_ts, cluster_key
FROM (SELECT c.*, s.last_idx, {FREQUENCY.replace('gap', '(CAST(c.last_seen - c.first_idx AS DOUBLE) / (c.months - 1))').replace('span >=', 's.span >=')} AS frequency
      FROM credit_candidates c JOIN user_span s ON c.user_id = s.user_id) AS f WHERE frequency IS NOT NULL"""


@mart()
def recurring(d: Spark) -> str:
    """ST5: the five passes as one table."""
    return """
SELECT user_id, type, merchant, payee, CAST(NULL AS STRING) AS cluster_key, category, amount, range_min, range_max, credit_label, frequency, months, cancellability, is_active, last_ts FROM recurring_debit
UNION ALL
SELECT user_id, type, merchant, payee, cluster_key, category, amount, range_min, range_max, credit_label, frequency, months, cancellability, is_active, last_ts FROM recurring_credit"""


def _rec(where: str) -> str:
    return f"""
SELECT user_id, merchant, payee, cluster_key, category, {r6('amount')} AS amount, {r6('range_min')} AS range_min, {r6('range_max')} AS range_max, credit_label, frequency, months, cancellability, is_active, CAST(CAST(last_ts AS DATE) AS STRING) AS last_date
FROM recurring WHERE {where}"""


@relation
def rec1_debit_merchant(d: Spark) -> str:
    return _rec("type = 'debit' AND merchant IS NOT NULL")


@relation
def rec2_debit_payee(d: Spark) -> str:
    return _rec("type = 'debit' AND payee IS NOT NULL")


@relation
def rec3_credit_merchant(d: Spark) -> str:
    return _rec("type = 'credit' AND merchant IS NOT NULL")


@relation
def rec4_credit_payee(d: Spark) -> str:
    return _rec("type = 'credit' AND payee IS NOT NULL")


@relation
def rec5_credit_cluster(d: Spark) -> str:
    return _rec("type = 'credit' AND cluster_key IS NOT NULL")


@mart()
def affected_months(d: Spark) -> str:
    """The months that new statements touched, an input of a run: here each user's last two."""
    return "SELECT DISTINCT m.user_id, m.month FROM month_totals m JOIN user_span s ON m.user_id = s.user_id WHERE m.month_idx >= s.last_idx - 1"


@relation
def run_months(d: Spark) -> str:
    return "SELECT user_id, month FROM affected_months"


@relation
def rec6_gate(d: Spark) -> str:
    """JN3, REC6: patterns of the counterparties seen in the affected months, over full history."""
    return f"""
SELECT user_id, type, merchant, payee, {r6('amount')} AS amount, months FROM recurring r WHERE EXISTS (
  SELECT 1 FROM ledger e JOIN affected_months a ON e.user_id = a.user_id AND e.month = a.month WHERE e.user_id = r.user_id AND coalesce(e.merchant, e.payee) = coalesce(r.merchant, r.payee))"""


@relation
def rec7_deactivated(d: Spark) -> str:
    """SNK6: patterns last seen before the month before the user's last."""
    return f"SELECT user_id, type, coalesce(merchant, payee, cluster_key) AS name, {r6('amount')} AS amount, CAST(CAST(last_ts AS DATE) AS STRING) AS last_date FROM recurring WHERE NOT is_active"


@relation
def price_changes(d: Spark) -> str:
    """JN8, REC8: the latest retired pattern of a name with exactly one live one."""
    return """
SELECT o.user_id, o.name, o.amount AS old_amount, l.amount AS new_amount, l.category, l.frequency, l.last_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY last_ts DESC, amount DESC) AS rn FROM (
    SELECT user_id, coalesce(merchant, payee) AS name, amount, last_ts FROM recurring WHERE coalesce(type, 'debit') = 'debit' AND NOT is_active) AS r) AS o
JOIN (SELECT user_id, coalesce(merchant, payee) AS name, max(amount) AS amount, max(category) AS category, max(frequency) AS frequency, max(last_ts) AS last_ts
      FROM recurring WHERE coalesce(type, 'debit') = 'debit' AND is_active GROUP BY user_id, coalesce(merchant, payee) HAVING count(*) = 1) AS l
ON o.user_id = l.user_id AND o.name = l.name WHERE o.rn = 1"""


@relation
def rec8_price_changes(d: Spark) -> str:
    return f"SELECT user_id, name, {r6('old_amount')} AS old_amount, {r6('new_amount')} AS new_amount, {r6('abs(new_amount - old_amount)')} AS change FROM price_changes WHERE new_amount <> old_amount"


@relation
def ag27_recurring_summary(d: Spark) -> str:
    """FN20: amounts per month; committed and cancellable debits, income floor and median."""
    per = "CASE frequency WHEN 'annually' THEN amount / 12 WHEN 'quarterly' THEN amount / 3 ELSE amount END"
    low = "CASE frequency WHEN 'annually' THEN range_min / 12 WHEN 'quarterly' THEN range_min / 3 ELSE range_min END"
    return f"""
SELECT user_id, {r6(f"sum(CASE WHEN is_active AND type = 'debit' THEN {per} ELSE 0 END)")} AS committed, {r6(f"sum(CASE WHEN is_active AND cancellability = 'cancellable' THEN {per} ELSE 0 END)")} AS cancellable,
       {r6(f"sum(CASE WHEN is_active AND type = 'credit' THEN {low} ELSE 0 END)")} AS income_floor, {r6(f"sum(CASE WHEN is_active AND type = 'credit' THEN {per} ELSE 0 END)")} AS income_median,
       count(CASE WHEN is_active THEN 1 END) AS active, count(CASE WHEN NOT is_active THEN 1 END) AS inactive FROM recurring GROUP BY user_id"""


@relation
def ag27_by_label(d: Spark) -> str:
    return f"SELECT user_id, type, coalesce(cancellability, credit_label) AS label, count(*) AS n, {r6('sum(amount)')} AS amount FROM recurring WHERE is_active GROUP BY user_id, type, coalesce(cancellability, credit_label)"


@relation
def jn12_occurrences(d: Spark) -> str:
    """A pattern's transactions: debits by name and exact amount, credits by name or cluster."""
    return f"""
SELECT r.user_id, r.type, coalesce(r.merchant, r.payee, r.cluster_key) AS name, {r6('r.amount')} AS pattern_amount, count(*) AS occurrences, {dbl('sum(e.debit + e.credit)')} AS total
FROM recurring r JOIN ledger e ON e.user_id = r.user_id AND coalesce(r.merchant, r.payee, r.cluster_key) = coalesce(e.merchant, e.payee, e.cluster_id)
 AND ((r.type = 'debit' AND e.debit > 0 AND {dbl('e.debit')} = r.amount) OR (r.type = 'credit' AND e.credit > 0))
GROUP BY r.user_id, r.type, coalesce(r.merchant, r.payee, r.cluster_key), r.amount"""


COLUMNS = "user_id, dedupe_key, kind, severity, month, txn_id, cluster_id, label, category, amount"
SPEND = "coalesce(merchant, payee, description)"
LABEL_ = "coalesce(merchant, payee, cluster_id)"


#: Kinds of flags that are found over full history, whatever the months of a run.
GLOBAL_KINDS = ("subscription_price_hike", "balance_risk")


@relation
def detector_months(d: Spark) -> str:
    """The months a run of the detectors looks into (all but those of the global kinds): by default all."""
    return "SELECT user_id, month FROM month_totals"


def _looked_into(rows: str) -> str:
    return f"EXISTS (SELECT 1 FROM detector_months s WHERE s.user_id = {rows}.user_id AND s.month = {rows}.month)"


def _first(order: str, most: int, body: str) -> str:
    return f"SELECT {COLUMNS}, detector FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn FROM ({body}) AS b) AS t WHERE rn <= {most}"


@relation
def fl1_duplicates(d: Spark) -> str:
    """AG13: one exact amount over 1000 twice or more in a month and cluster; the extra is at stake."""
    return _first("unit DESC, dedupe_key", 40, f"""
SELECT user_id, concat('duplicate_charge:', cluster_id, ':', CAST(CAST(debit AS DECIMAL(18,2)) AS STRING), ':', month) AS dedupe_key, 'duplicate_charge' AS kind, 'high' AS severity, month,
       min(txn_id) AS txn_id, cluster_id, min({LABEL_}) AS label, min(category) AS category, {dbl('debit')} * (count(*) - 1) AS amount, {dbl('debit')} AS unit, 1 AS detector
FROM ledger l WHERE debit > 1000 AND cluster_id IS NOT NULL AND {_looked_into('l')} GROUP BY user_id, cluster_id, debit, month HAVING count(*) >= 2""")


@relation
def cluster_medians(d: Spark) -> str:
    """AG14: nearest-rank median of a cluster's debits, four or more."""
    return f"SELECT user_id, cluster_id, {dbl('x')} AS med, n FROM ({ranked('user_id, cluster_id', 'debit', 'ledger WHERE debit > 0', 0.5)}) AS q WHERE n >= 4"


@relation
def fl2_outliers(d: Spark) -> str:
    return _first("amount DESC, dedupe_key", 40, f"""
SELECT l.user_id, concat('merchant_outlier:', l.txn_id) AS dedupe_key, 'merchant_outlier' AS kind, CASE WHEN {dbl('l.debit')} / m.med >= 5 THEN 'high' ELSE 'medium' END AS severity, l.month,
       l.txn_id, l.cluster_id, {SPEND} AS label, coalesce(l.category, 'Other') AS category, {dbl('l.debit')} AS amount, 2 AS detector
FROM ledger l JOIN cluster_medians m ON l.user_id = m.user_id AND l.cluster_id = m.cluster_id WHERE m.med > 0 AND {dbl('l.debit')} / m.med >= 3 AND l.debit >= 1000 AND {_looked_into('l')}""")


@relation
def fl3_spike_contributors(d: Spark) -> str:
    """WN6: the three largest payments of each spiked month and category."""
    return f"""
SELECT {COLUMNS}, detector FROM (
  SELECT e.user_id, concat('category_spike_contributor:', e.txn_id) AS dedupe_key, 'category_spike_contributor' AS kind, 'medium' AS severity, e.month, e.txn_id, CAST(NULL AS STRING) AS cluster_id,
         coalesce(e.merchant, e.payee, 'unnamed') AS label, e.category, {dbl('e.debit')} AS amount, 3 AS detector, row_number() OVER (PARTITION BY e.user_id, e.month, e.category ORDER BY e.debit DESC, e.txn_id) AS rn
  FROM enriched e JOIN category_trend t ON t.user_id = e.user_id AND t.month = e.month AND t.category = e.category WHERE t.spiked AND e.debit > 0 AND {_looked_into('e')}) AS r WHERE rn <= 3"""


@relation
def fl4_fees(d: Spark) -> str:
    """NRM26, FN1."""
    return _first("amount DESC, dedupe_key", 40, f"""
SELECT user_id, concat('fee_or_interest:', txn_id) AS dedupe_key, 'fee_or_interest' AS kind, CASE WHEN debit > 500 THEN 'high' ELSE 'medium' END AS severity, month, txn_id, CAST(NULL AS STRING) AS cluster_id,
       {SPEND} AS label, coalesce(category, 'Other') AS category, {dbl('debit')} AS amount, 4 AS detector FROM ledger l WHERE debit > 0 AND {d.matches('description', '(?i)' + '|'.join(FEES))} AND {_looked_into('l')}""")


@relation
def fl5_price_hikes(d: Spark) -> str:
    return f"""
SELECT user_id, concat('subscription_price_hike:', name, ':', CAST(CAST(old_amount AS DECIMAL(18,2)) AS STRING), ':', CAST(CAST(new_amount AS DECIMAL(18,2)) AS STRING)) AS dedupe_key,
       'subscription_price_hike' AS kind, 'medium' AS severity, {d.month_name('last_ts')} AS month, CAST(NULL AS STRING) AS txn_id, CAST(NULL AS STRING) AS cluster_id, name AS label, category, (new_amount - old_amount) * 12 AS amount, 5 AS detector
FROM price_changes WHERE new_amount - old_amount >= 20 AND (new_amount - old_amount) / old_amount * 100 >= 5"""


@relation
def expense_medians(d: Spark) -> str:
    return f"""
SELECT user_id, {nearest_rank('expenses', 0.5)} AS med FROM (SELECT user_id, expenses, row_number() OVER (PARTITION BY user_id ORDER BY expenses) AS rn, count(*) OVER (PARTITION BY user_id) AS n
FROM monthly WHERE expenses > 0) AS r GROUP BY user_id"""


@relation
def fl6_balance_risk(d: Spark) -> str:
    """Debits that leave less than five days of the median month's spending."""
    return _first("balance, dedupe_key", 25, f"""
SELECT l.user_id, concat('balance_risk:', l.txn_id) AS dedupe_key, 'balance_risk' AS kind, 'high' AS severity, l.month, l.txn_id, CAST(NULL AS STRING) AS cluster_id, {SPEND} AS label,
       coalesce(l.category, 'Other') AS category, {dbl('l.debit')} AS amount, l.balance, 6 AS detector
FROM ledger_balance l JOIN expense_medians m ON l.user_id = m.user_id WHERE l.debit > 0 AND l.balance >= 0 AND {dbl('l.balance')} < m.med / 30 * 5""")


@relation
def fl7_opaque_transfers(d: Spark) -> str:
    """Transfers above the 95th percentile of the user's own debits, from 20 on."""
    return _first("amount DESC, dedupe_key", 25, f"""
SELECT l.user_id, concat('large_opaque_transfer:', l.txn_id) AS dedupe_key, 'large_opaque_transfer' AS kind, 'medium' AS severity, l.month, l.txn_id, CAST(NULL AS STRING) AS cluster_id, {SPEND} AS label,
       l.category, {dbl('l.debit')} AS amount, 7 AS detector FROM ledger l JOIN (
  {ranked('user_id', 'debit', 'ledger WHERE debit > 0', 0.95)}) AS q ON l.user_id = q.user_id WHERE q.n >= 20 AND l.category = '{TRANSFER}' AND l.debit > q.x AND {_looked_into('l')}""")


DETECTORS = ("fl1_duplicates", "fl2_outliers", "fl3_spike_contributors", "fl4_fees", "fl5_price_hikes", "fl6_balance_risk", "fl7_opaque_transfers")


@mart()
def flags(d: Spark) -> str:
    """FL8, ST1, ST2: all detectors; of one key the last detector's row stays."""
    union = " UNION ALL ".join(f"SELECT {COLUMNS}, detector FROM {n}" for n in DETECTORS)
    return f"SELECT {COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, dedupe_key ORDER BY detector DESC) AS rn FROM ({union}) AS u) AS r WHERE rn = 1"


@relation
def fl8_flags(d: Spark) -> str:
    return f"SELECT user_id, dedupe_key, kind, severity, month, txn_id, cluster_id, label, category, {r6('amount')} AS amount FROM flags"


@relation
def so3_flag_page(d: Spark) -> str:
    """SO2, SO3: severity by rank, then amount; the second page of 20 over all users."""
    return f"""
SELECT user_id, dedupe_key, severity, {r6('amount')} AS amount FROM flags
ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, round(amount, 6) DESC, dedupe_key, user_id LIMIT 20 OFFSET 20"""


#: AG23: of one payment's flags in a group the largest amount counts; flags without one all do.
PAYMENT = "coalesce(txn_id, concat('-', dedupe_key))"
AT_STAKE = "max(greatest(amount, 0e0)) AS amount, count(*) AS n, count(CASE WHEN severity = 'high' THEN 1 END) AS high"


@relation
def ag23_flag_tally(d: Spark) -> str:
    return f"""
SELECT user_id, 'kind' AS cut, kind AS value, CAST(sum(n) AS BIGINT) AS n, {r6('sum(amount)')} AS amount FROM (
  SELECT user_id, kind, {PAYMENT} AS payment, {AT_STAKE} FROM flags GROUP BY user_id, kind, {PAYMENT}) AS t GROUP BY user_id, kind"""


@relation
def exposure(d: Spark) -> str:
    """AG24."""
    return f"""
SELECT user_id, sum(amount) AS exposure, sum(n) AS flags, sum(high) AS high FROM (
  SELECT user_id, {PAYMENT} AS payment, {AT_STAKE} FROM flags GROUP BY user_id, {PAYMENT}) AS t GROUP BY user_id"""


@relation
def ag24_exposure(d: Spark) -> str:
    return f"SELECT user_id, {r6('exposure')} AS exposure, CAST(flags AS BIGINT) AS flags, CAST(high AS BIGINT) AS high FROM exposure"


@relation
def ag25_faceted_cuts(d: Spark) -> str:
    """Cuts under the filters severity = high and kind = merchant_outlier: each ignores its own. One
    pass over the flags, each in the cuts whose other filters it meets."""
    cuts = d.unnest("array('severity', 'kind', 'month', 'category')" if d.name == "spark" else "['severity', 'kind', 'month', 'category']")
    value = "CASE cut WHEN 'severity' THEN severity WHEN 'kind' THEN kind WHEN 'month' THEN month ELSE category END"
    return f"""
SELECT user_id, cut, value, CAST(sum(n) AS BIGINT) AS n, {r6('sum(amount)')} AS amount FROM (
  SELECT user_id, cut, {value} AS value, {PAYMENT} AS payment, {AT_STAKE} FROM (SELECT *, {cuts} AS cut FROM flags) AS f
  WHERE (cut = 'severity' OR severity = 'high') AND (cut = 'kind' OR kind = 'merchant_outlier') GROUP BY user_id, cut, {value}, {PAYMENT}) AS t
GROUP BY user_id, cut, value"""


@relation
def ag26_flag_summary(d: Spark) -> str:
    """By kind: counts, total and the labels of the four largest."""
    top = ", ".join(f"max(CASE WHEN rn = {k} THEN label END) AS example{k}" for k in (1, 2, 3, 4))
    return f"""
SELECT user_id, kind, count(*) AS n, count(CASE WHEN severity = 'high' THEN 1 END) AS high, {r6('sum(amount)')} AS total, {top} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY round(amount, 6) DESC, dedupe_key) AS rn FROM flags) AS r GROUP BY user_id, kind"""


@relation
def jn4_flag_transactions(d: Spark) -> str:
    """Flags with their payments, if they have one."""
    return f"SELECT f.user_id, f.dedupe_key, f.kind, l.txn_id, {dbl('l.debit')} AS debit, CAST(CAST(l.ts AS DATE) AS STRING) AS day FROM flags f LEFT JOIN ledger l ON f.user_id = l.user_id AND f.txn_id = l.txn_id"


@relation
def st_cluster_pool(d: Spark) -> str:
    """ST3, ST4: counterparties of debits that no flag names."""
    return "SELECT DISTINCT l.user_id, l.cluster_id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM flags f WHERE f.user_id = l.user_id AND f.cluster_id = l.cluster_id)"


def replaced_flags(old: DataFrame, new: DataFrame, months: DataFrame) -> DataFrame:
    """SNK4 over flags: of the users in ``months`` (user_id, month), flags in those months and all of the
    global kinds go, whatever their keys; ``new`` comes in. Replaying it changes nothing."""
    looked, users = months.select("user_id", "month").distinct(), months.select("user_id").distinct()
    left = old.filter(~F.col("kind").isin(*GLOBAL_KINDS)).join(looked, ["user_id", "month"], "left_anti")
    others = old.filter(F.col("kind").isin(*GLOBAL_KINDS)).join(users, "user_id", "left_anti")
    return left.select(new.columns).unionByName(others.select(new.columns)).unionByName(new)


def snk4_replaced_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags after a run over the affected months: a run has caps of its own, so it may find more."""
    months = query("run_months")(spark, sf_dir)
    out = replaced_flags(query("flags")(spark, sf_dir), query("flags", detector_months=months)(spark, sf_dir), months)
    return out.select("user_id", "dedupe_key", "kind", "month", "severity", F.round("amount", 6).alias("amount"))


def queries() -> dict:
    return {"snk4_replaced_flags": snk4_replaced_flags}


def oracles() -> dict[str, str]:
    kinds = names(GLOBAL_KINDS)
    return {"snk4_replaced_flags": f"""WITH old AS ({statement('flags', DUCK)}), months AS ({statement('affected_months', DUCK)}),
new AS ({statement('flags', DUCK, swap={'detector_months': 'affected_months'})})
SELECT user_id, dedupe_key, kind, month, severity, round(amount, 6) AS amount FROM (
  SELECT {COLUMNS} FROM old WHERE CASE WHEN kind IN ({kinds}) THEN user_id NOT IN (SELECT user_id FROM months) ELSE (user_id, month) NOT IN (SELECT (user_id, month) FROM months) END
  UNION ALL SELECT {COLUMNS} FROM new) AS f"""}
