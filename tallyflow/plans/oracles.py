"""SQL for DuckDB that states rules anew, over lists and from the ledger's rows alone.

The other checks run a relation's own text in both dialects, which tells engines apart but not
a wrong rule. These share no text with the relations but the adapter that makes the ledger.
"""

from __future__ import annotations

from ..operators.recurring import FEES
from ..sources.adapters import ESSENTIALS, INVESTMENT, SUBSCRIPTION, TRANSFER, names
from .relations import DUCK, statement



def at(xs: str, p: float) -> str:
    """The value at floor(p n), counted from 0, of a sorted list."""
    return f"{xs}[1 + least(CAST(floor({p} * len({xs})) AS INT), len({xs}) - 1)]"


def _ledger() -> str:
    return f"l AS (SELECT *, year(ts) * 12 + month(ts) AS ym FROM ({statement('ledger', DUCK)}) AS a)"


def _patterns() -> str:
    """d: debit patterns; c: credit patterns; both with frequency and whether they are live."""
    often = """CASE WHEN gap <= 1.5 THEN 'monthly' WHEN gap <= 3.5 THEN 'quarterly' WHEN gap > 10 AND span >= 24 THEN 'annually' END"""
    gap = "list_avg(list_transform(range(1, len(ms)), lambda i: ms[i + 1] - ms[i]))"
    live = "(list_contains(ms, top) OR list_contains(ms, top - 1))"
    return f"""{_ledger()},
u AS (SELECT user_id, max(ym) AS top, max(ym) - min(ym) AS span FROM l GROUP BY user_id),
d0 AS (SELECT user_id, merchant, if(merchant IS NULL, payee, NULL) AS payee, debit, list_sort(list_distinct(list(ym))) AS ms, max(ts) AS last, min(category) AS category
       FROM l WHERE debit > 0 AND coalesce(merchant, payee) IS NOT NULL GROUP BY ALL),
d AS (SELECT *, {often} AS frequency, {live} AS live FROM (SELECT d0.*, top, span, {gap} AS gap FROM d0 JOIN u USING (user_id) WHERE len(ms) >= 3) WHERE frequency IS NOT NULL),
c0 AS (SELECT user_id, merchant, if(merchant IS NULL, payee, NULL) AS payee, if(merchant IS NULL AND payee IS NULL, cluster_id, NULL) AS cluster_key, ym, sum(credit) AS total, max(ts) AS last, min(category) AS category
       FROM l WHERE credit > 500 GROUP BY ALL),
c1 AS (SELECT user_id, merchant, payee, cluster_key, list_sort(list(ym)) AS ms, list_sort(list(CAST(total AS DOUBLE))) AS xs, max(last) AS last, min(category) AS category FROM c0 GROUP BY ALL HAVING count(*) >= 3),
c2 AS (SELECT *, list_avg(xs) AS mean, {at('xs', 0.5)} AS mid, {at('xs', 0.25)} AS lo, {at('xs', 0.75)} AS hi FROM c1),
c AS (SELECT *, {often} AS frequency, {live} AS live, if(mean > 0, sqrt(list_avg(list_transform(xs, lambda x: (x - mean) * (x - mean)))) / mean, 0) AS cv
      FROM (SELECT c2.*, top, span, {gap} AS gap FROM c2 JOIN u USING (user_id)) WHERE frequency IS NOT NULL)"""


def _debits(where: str) -> str:
    return f"""WITH {_patterns()}
SELECT user_id, merchant, payee, CAST(NULL AS VARCHAR) AS cluster_key, category, round(CAST(debit AS DOUBLE), 6) AS amount, CAST(NULL AS DOUBLE) AS range_min, CAST(NULL AS DOUBLE) AS range_max,
       CAST(NULL AS VARCHAR) AS credit_label, frequency, len(ms) AS months,
       CASE WHEN payee IS NOT NULL THEN 'obligation' ELSE coalesce(MAP {{'{SUBSCRIPTION}': 'cancellable', '{INVESTMENT}': 'pausable', '{ESSENTIALS[0]}': 'essential', '{ESSENTIALS[1]}': 'essential', '{TRANSFER}': 'obligation'}}[category], 'obligation') END AS cancellability,
       live AS is_active, CAST(CAST(last AS DATE) AS VARCHAR) AS last_date FROM d WHERE {where}"""


def _credits(where: str) -> str:
    return f"""WITH {_patterns()}
SELECT user_id, merchant, payee, cluster_key, category, round(mid, 6) AS amount, round(if(hi > lo, greatest(0, lo - (hi - lo) / 2), mid * 0.95), 6) AS range_min, round(if(hi > lo, hi + (hi - lo) / 2, mid * 1.05), 6) AS range_max,
       CASE WHEN payee IS NOT NULL THEN 'transfer_in' WHEN category = '{INVESTMENT}' THEN 'investment_return' WHEN mid > 20000 AND cv < 0.15 THEN 'salary' WHEN mid > 10000 AND cv < 0.4 THEN 'rental_income'
            WHEN cv > 0.4 THEN 'freelance' ELSE 'unknown' END AS credit_label, frequency, len(ms) AS months, CAST(NULL AS VARCHAR) AS cancellability, live AS is_active, CAST(CAST(last AS DATE) AS VARCHAR) AS last_date FROM c WHERE {where}"""


def _flag(kind: str, key: str, severity: str, rest: str, detector: int) -> str:
    return f"SELECT user_id, '{kind}:' || {key} AS dedupe_key, '{kind}' AS kind, {severity} AS severity, {rest}, {detector} AS detector"


def _top(n: int, order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {order}, dedupe_key) <= {n}"


def independent() -> dict[str, str]:
    spend = "coalesce(merchant, payee, description) AS label, coalesce(category, 'Other') AS category, CAST(debit AS DOUBLE) AS amount"
    fees = " OR ".join(f"regexp_matches(lower(description), '{p}')" for p in FEES)
    return {
        "rec1_debit_merchant": _debits("merchant IS NOT NULL"),
        "rec2_debit_payee": _debits("payee IS NOT NULL"),
        "rec3_credit_merchant": _credits("merchant IS NOT NULL"),
        "rec4_credit_payee": _credits("payee IS NOT NULL"),
        "rec5_credit_cluster": _credits("cluster_key IS NOT NULL"),
        "fl1_duplicates": f"""WITH {_ledger()}, g AS (SELECT user_id, cluster_id, debit, month, list_sort(list(txn_id)) AS ids, min(coalesce(merchant, payee, cluster_id)) AS label, min(category) AS category
  FROM l WHERE debit > 1000 GROUP BY ALL HAVING len(ids) >= 2)
{_flag('duplicate_charge', "cluster_id || ':' || debit || ':' || month", "'high'", "month, ids[1] AS txn_id, cluster_id, label, category, CAST(debit * (len(ids) - 1) AS DOUBLE) AS amount", 1)} FROM g {_top(40, 'debit DESC')}""",
        "fl2_outliers": f"""WITH {_ledger()}, g AS (SELECT user_id, cluster_id, list_sort(list(CAST(debit AS DOUBLE))) AS xs FROM l WHERE debit > 0 GROUP BY ALL HAVING count(*) >= 4),
m AS (SELECT l.*, debit / {at('xs', 0.5)} AS ratio FROM l JOIN g USING (user_id, cluster_id) WHERE debit >= 1000)
{_flag('merchant_outlier', 'txn_id', "if(ratio >= 5, 'high', 'medium')", f"month, txn_id, cluster_id, {spend}", 2)} FROM m WHERE ratio >= 3 {_top(40, 'debit DESC')}""",
        "fl4_fees": f"""WITH {_ledger()}
{_flag('fee_or_interest', 'txn_id', "if(debit > 500, 'high', 'medium')", f"month, txn_id, CAST(NULL AS VARCHAR) AS cluster_id, {spend}", 4)} FROM l WHERE debit > 0 AND ({fees}) {_top(40, 'debit DESC')}""",
        "fl5_price_hikes": f"""WITH {_patterns()}, n AS (SELECT *, coalesce(merchant, payee) AS name FROM d),
live AS (SELECT user_id, name, any_value(debit) AS new, any_value(category) AS category, any_value(last) AS last FROM n WHERE live GROUP BY ALL HAVING count(*) = 1),
gone AS (SELECT user_id, name, arg_max(debit, (last, debit)) AS old FROM n WHERE NOT live GROUP BY ALL)
{_flag('subscription_price_hike', "name || ':' || old || ':' || new", "'medium'", "strftime(last, '%Y-%m') AS month, CAST(NULL AS VARCHAR) AS txn_id, CAST(NULL AS VARCHAR) AS cluster_id, name AS label, category, CAST((new - old) * 12 AS DOUBLE) AS amount", 5)}
FROM live JOIN gone USING (user_id, name) WHERE new - old >= 20 AND (new - old) * 100 >= 5 * old""",
        "fl6_balance_risk": f"""WITH {_ledger()}, b AS (SELECT *, sum(credit - debit) OVER (PARTITION BY user_id ORDER BY ts, txn_id ROWS UNBOUNDED PRECEDING) AS balance FROM l),
e AS (SELECT user_id, list_sort(list(x)) AS xs FROM (SELECT user_id, CAST(sum(debit) AS DOUBLE) AS x FROM l GROUP BY user_id, ym) WHERE x > 0 GROUP BY user_id)
{_flag('balance_risk', 'txn_id', "'high'", f"month, txn_id, CAST(NULL AS VARCHAR) AS cluster_id, {spend}", 6)} FROM b JOIN e USING (user_id) WHERE debit > 0 AND balance >= 0 AND balance < {at('xs', 0.5)} / 6 {_top(25, 'balance')}""",
        "fl7_opaque_transfers": f"""WITH {_ledger()}, q AS (SELECT user_id, list_sort(list(debit)) AS xs FROM l WHERE debit > 0 GROUP BY user_id HAVING count(*) >= 20)
{_flag('large_opaque_transfer', 'txn_id', "'medium'", f"month, txn_id, CAST(NULL AS VARCHAR) AS cluster_id, {spend}", 7)} FROM l JOIN q USING (user_id) WHERE category = '{TRANSFER}' AND debit > {at('xs', 0.95)} {_top(25, 'debit DESC')}""",
        "bh4_impulse": """WITH g AS (SELECT o_custkey AS user_id, list_reverse_sort(list(CAST(o_totalprice AS DECIMAL(18,2)))) AS xs FROM orders WHERE o_totalprice > 0 GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT *, CAST(list_sum(xs[1:5]) AS DOUBLE) / CAST(list_sum(xs) AS DOUBLE) AS share, len(xs) AS n FROM g)
SELECT user_id, round(share, 6) AS share, if(share >= 0.7, 'High', 'Moderate') AS badge, n AS evidence, CAST(floor(40 + 57 * greatest(0, least(1, (n - 3) / 17)) + 0.5) AS BIGINT) AS confidence FROM s WHERE share >= 0.45""",
        "ag24_exposure": f"""WITH f AS (SELECT * FROM ({statement('flags', DUCK)}) AS x)
SELECT user_id, round(sum(money), 6) AS exposure, CAST(sum(n) AS BIGINT) AS flags, CAST(sum(hot) AS BIGINT) AS high FROM (
  SELECT user_id, list_max(list(greatest(amount, 0))) AS money, count(*) AS n, count(*) FILTER (severity = 'high') AS hot FROM f WHERE txn_id IS NOT NULL GROUP BY user_id, txn_id
  UNION ALL SELECT user_id, greatest(amount, 0), 1, CAST(severity = 'high' AS INT) FROM f WHERE txn_id IS NULL) AS t GROUP BY user_id""",
        "bh1_discipline": f"""WITH {_ledger()}, m AS (SELECT user_id, ym, CAST(sum(debit) AS DOUBLE) AS spend, count(*) AS n FROM l WHERE debit > 0 AND category IN ({names(ESSENTIALS)}) GROUP BY ALL),
k AS (SELECT user_id, category, ym, sum(debit) AS spend FROM l WHERE debit > 0 AND category IN ({names(ESSENTIALS)}) GROUP BY ALL),
h AS (SELECT user_id, list_sort(list(DISTINCT ym)) AS yms FROM l GROUP BY user_id),
p AS (SELECT k.user_id, k.ym, max(CASE WHEN k.spend > 2 * (SELECT CAST(coalesce(sum(o.spend), 0) AS DOUBLE) / len(w) FROM k o WHERE o.user_id = k.user_id AND o.category = k.category AND list_contains(w, o.ym)) THEN 1 ELSE 0 END) AS spike
      FROM (SELECT k.*, list_filter(h.yms, lambda x: x <= k.ym)[-6:] AS w FROM k JOIN h USING (user_id)) AS k GROUP BY ALL),
s AS (SELECT user_id, count(*) AS months, stddev_samp(spend) / avg(spend) AS cv, CAST(sum(n) AS BIGINT) AS evidence, CAST(sum(spike) AS BIGINT) AS spikes FROM m JOIN p USING (user_id, ym) GROUP BY user_id HAVING count(*) >= 3)
SELECT user_id, CASE WHEN cv <= 0.2 AND spikes = 0 THEN 'Good' WHEN cv <= 0.4 THEN 'Fair' ELSE 'Volatile' END AS badge, CAST(floor(cv * 100 + 0.5) AS BIGINT) AS variation_pct, months, spikes, evidence,
       CAST(floor(40 + 57 * greatest(0, least(1, (months - 2) / 10)) + 0.5) AS BIGINT) AS confidence FROM s""",
    }
