"""Raw statement rows to typed transactions, and checks on them."""

from __future__ import annotations

from ..plans.relations import Spark, dbl, r6, relation

#: The forms of amounts and dates that rows may have.
AMOUNT = r"^(₹|Rs[.]?|INR)?\s*[-+]?([0-9]{1,3}(,[0-9]{2,3})*|[0-9]+)([.][0-9]{1,2})?\s*(Cr|Dr|CR|DR|cr|dr)?$"
DATE = "|".join((r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}", r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2,4}", r"^[0-9]{1,2} [A-Za-z]{3,9},? [0-9]{2,4}", r"^[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"))


@relation
def raw_rows(d: Spark) -> str:
    """SRC14: statement rows as text, in several date forms, with planted faults, from the orders."""
    k = "o_orderkey"
    return f"""
SELECT {k} AS temp_id, c_nationkey AS user_id, concat(CAST(c_nationkey AS STRING), '-', CAST(year(o_orderdate) AS STRING)) AS statement_id,
       CASE {k} % 8 WHEN 0 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))
         WHEN 1 THEN concat(CAST(day(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-', lpad(CAST(year(o_orderdate) % 100 AS STRING), 2, '0'))
         WHEN 2 THEN concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
         WHEN 3 THEN concat('31/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING)) WHEN 4 THEN concat(CAST(day(o_orderdate) AS STRING), ' Apr ', CAST(year(o_orderdate) AS STRING))
         WHEN 5 THEN concat('Mar ', CAST(day(o_orderdate) AS STRING), ', ', CAST(year(o_orderdate) AS STRING)) WHEN 6 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/51')
         ELSE CASE WHEN {k} % 16 = 7 THEN 'opening balance' ELSE concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', CAST(day(o_orderdate) AS STRING)) END END AS date,
       concat(o_orderpriority, ' Paid  to ', c_name) AS description,
       CASE WHEN o_orderstatus = 'O' THEN '' WHEN {k} % 11 = 0 THEN 'abc' WHEN {k} % 13 = 0 THEN concat('₹', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) ELSE concat(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ' Dr') END AS debit,
       CASE WHEN o_orderstatus = 'O' THEN concat('1,', lpad(CAST({k} % 1000 AS STRING), 3, '0'), '.50') ELSE '' END AS credit,
       CASE WHEN {k} % 17 = 0 THEN concat(CAST({k} % 900 AS STRING), '.00 23,445.00') WHEN {k} % 19 = 0 THEN '' ELSE concat(CAST({k} AS STRING), '.25 Cr') END AS balance
FROM orders JOIN customer ON o_custkey = c_custkey"""


@relation
def fixed_rows(d: Spark) -> str:
    """NRM5-NRM7: rows without a date are summaries and go; a merged balance gives its first value to the credit column."""
    return f"""
SELECT temp_id, user_id, statement_id, date, description, debit, CASE WHEN {d.matches('balance', '^[0-9.,]+ [0-9.,]+$')} THEN split_part(balance, ' ', 1) ELSE credit END AS credit,
       CASE WHEN {d.matches('balance', '^[0-9.,]+ [0-9.,]+$')} THEN split_part(balance, ' ', 2) ELSE balance END AS balance FROM raw_rows WHERE NOT {d.matches('date', '(?i)(opening|closing) balance')}"""


@relation
def nrm5_actions(d: Spark) -> str:
    return f"""
SELECT temp_id, CASE WHEN {d.matches('date', '(?i)(opening|closing) balance')} THEN 'remove' WHEN {d.matches('balance', '^[0-9.,]+ [0-9.,]+$')} THEN 'incorrect' WHEN debit = '' AND credit = '' THEN 'incorrect' ELSE 'keep' END AS action FROM raw_rows"""


@relation
def nrm6_split_values(d: Spark) -> str:
    return "SELECT f.temp_id, f.credit, f.balance FROM fixed_rows f JOIN raw_rows r ON r.temp_id = f.temp_id WHERE r.balance <> f.balance"


@relation
def checked_rows(d: Spark) -> str:
    """NRM8-NRM10."""
    return f"""
SELECT *, {d.matches('trim(credit)', AMOUNT)} OR {d.matches('trim(debit)', AMOUNT)} AS amount_ok, {d.matches('trim(date)', DATE)} AS date_ok, {d.matches('trim(balance)', AMOUNT)} AS balance_ok FROM fixed_rows"""


def amount(d: Spark, x: str) -> str:
    """NRM11: without commas and a trailing Cr or Dr; a prefix of a number counts, none is null."""
    return f"try_cast(nullif({d.extract(d.replace(d.replace(x, ',', ''), '(?i)\\s*(Cr|Dr)$', ''), '^[-+]?[0-9]+([.][0-9]+)?')}, '') AS DOUBLE)"


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parsed_date(d: Spark, x: str) -> str:
    """NRM12, NRM13: forms in turn; days and months beyond the calendar roll on; null if none fits."""
    num = lambda p, g: f"try_cast(nullif({d.extract(x, p, g)}, '') AS INTEGER)"
    year = lambda p, g: f"{num(p, g)} + CASE WHEN {num(p, g)} >= 100 THEN 0 WHEN {num(p, g)} > 50 THEN 1900 ELSE 2000 END"
    # a month's place in ",jan,feb,...": one search, as the text of twelve comparisons outgrows generated code
    word = lambda p, g: f"CAST((nullif(position(concat(',', lower(substr({d.extract(x, p, g)}, 1, 3))) IN ',{','.join(MONTHS)}'), 0) + 3) / 4 AS INTEGER)"
    dmy, iso = "^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})", "^([0-9]{4})-([0-9]{2})-([0-9]{2})"
    dmon, mond = "^([0-9]{1,2}) ([A-Za-z]{3,9}),? ([0-9]{2,4})", "^([A-Za-z]{3,9}) ([0-9]{1,2}), ([0-9]{4})"
    return f"""CASE WHEN {d.matches(x, iso)} THEN {d.rolled(num(iso, 1), num(iso, 2), num(iso, 3))} WHEN {d.matches(x, dmy)} THEN {d.rolled(f'({year(dmy, 3)})', num(dmy, 2), num(dmy, 1))}
      WHEN {d.matches(x, dmon)} THEN {d.rolled(f'({year(dmon, 3)})', f'({word(dmon, 2)})', num(dmon, 1))} WHEN {d.matches(x, mond)} THEN {d.rolled(num(mond, 3), f'({word(mond, 1)})', num(mond, 2))} END"""


@relation
def normalized(d: Spark) -> str:
    return f"""
SELECT temp_id, user_id, statement_id, coalesce({parsed_date(d, 'trim(date)')}, DATE '1970-01-01') AS day, description, coalesce({amount(d, 'credit')}, 0e0) AS credit, coalesce({amount(d, 'debit')}, 0e0) AS debit,
       {amount(d, 'balance')} AS balance FROM checked_rows WHERE amount_ok AND date_ok AND balance_ok"""


@relation
def nrm11_normalized(d: Spark) -> str:
    return "SELECT temp_id, CAST(day AS STRING) AS day, credit, debit, balance FROM normalized"


@relation
def nrm10_exceptions(d: Spark) -> str:
    return f"SELECT temp_id, CAST({parsed_date(d, 'trim(date)')} AS STRING) AS day, credit, debit, balance, amount_ok, date_ok, balance_ok FROM checked_rows WHERE NOT (amount_ok AND date_ok AND balance_ok)"


@relation
def nrm10_conservation(d: Spark) -> str:
    return """
SELECT r.statement_id, r.n AS raw_rows, coalesce(v.n, 0) AS valid, coalesce(x.n, 0) AS exceptions, r.n - f.n AS removed FROM (SELECT statement_id, count(*) AS n FROM raw_rows GROUP BY statement_id) AS r
JOIN (SELECT statement_id, count(*) AS n FROM fixed_rows GROUP BY statement_id) AS f ON f.statement_id = r.statement_id
LEFT JOIN (SELECT statement_id, count(*) AS n FROM normalized GROUP BY statement_id) AS v ON v.statement_id = r.statement_id
LEFT JOIN (SELECT statement_id, count(*) AS n FROM checked_rows WHERE NOT (amount_ok AND date_ok AND balance_ok) GROUP BY statement_id) AS x ON x.statement_id = r.statement_id"""


@relation
def nrm12_dates(d: Spark) -> str:
    return f"SELECT temp_id, date, CAST({parsed_date(d, 'trim(date)')} AS STRING) AS day FROM raw_rows"


@relation
def nrm14_descriptions(d: Spark) -> str:
    """Digits go, other characters become blanks, blanks join; no trim."""
    step = d.replace(d.replace(d.replace("description", "[0-9]", ""), "[^a-zA-Z ]", " "), " +", " ")
    return f"SELECT temp_id, lower({step}) AS cleaned FROM raw_rows"


@relation
def nrm15_periods(d: Spark) -> str:
    return "SELECT statement_id, CAST(period_start AS STRING) AS period_start, CAST(period_end AS STRING) AS period_end FROM periods"


@relation
def periods(d: Spark) -> str:
    return "SELECT statement_id, min(day) AS period_start, max(day) AS period_end FROM normalized WHERE day > DATE '1970-01-01' GROUP BY statement_id"


@relation
def nrm03_spans(d: Spark) -> str:
    """Statements that span more than twelve months."""
    return "SELECT statement_id, (year(period_end) - year(period_start)) * 12 + month(period_end) - month(period_start) AS months FROM periods WHERE (year(period_end) - year(period_start)) * 12 + month(period_end) - month(period_start) > 12"


@relation
def nrm16_last4(d: Spark) -> str:
    squeezed = d.replace("c_name", "[ #]", "")
    return f"SELECT c_custkey, nullif(right({squeezed}, 4), '') AS last4 FROM customer"


@relation
def nrm17_file_names(d: Spark) -> str:
    return f"SELECT page_id, substr({d.extract('url', '([^/]*)/?$', 1)}, 1, 200) AS file_name FROM pages"


@relation
def nrm18_content_dedup(d: Spark) -> str:
    """One document of each source and content hash: the first."""
    return f"SELECT source, content_hash, doc_id FROM (SELECT source, {d.sha256('text')} AS content_hash, doc_id, row_number() OVER (PARTITION BY source, {d.sha256('text')} ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) AS t WHERE rn = 1"


@relation
def nrm20_ledger_page(d: Spark) -> str:
    """NRM19, NRM20, SO2: one user's debits of a half-open span and category, newest first, second page."""
    return f"""
SELECT txn_id, CAST(CAST(ts AS DATE) AS STRING) AS day, merchant, category, {dbl('debit')} AS debit FROM ledger WHERE user_id = 3 AND ts >= TIMESTAMP '1996-01-01 00:00:00' AND ts < TIMESTAMP '1999-01-01 00:00:00' AND category = 'PROMO'
 AND debit BETWEEN 20000 AND 80000 ORDER BY ts DESC, txn_id LIMIT 10 OFFSET 10"""


@relation
def nrm20_ledger_count(d: Spark) -> str:
    return "SELECT count(*) AS total FROM ledger WHERE user_id = 3 AND ts >= TIMESTAMP '1996-01-01 00:00:00' AND ts < TIMESTAMP '1999-01-01 00:00:00' AND category = 'PROMO' AND debit BETWEEN 20000 AND 80000"


@relation
def nrm21_statement_rows(d: Spark) -> str:
    return f"SELECT txn_id, {dbl('credit')} AS credit FROM ledger WHERE statement_id = '3-1998' AND credit > 0"


@relation
def nrm22_contains(d: Spark) -> str:
    return "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%mer#00000001%'"


@relation
def nrm23_in_sets(d: Spark) -> str:
    return "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND o_custkey IS NOT NULL AND NOT o_orderpriority = '1-URGENT'"


@relation
def nrm24_legacy_null(d: Spark) -> str:
    return "SELECT user_id, count(*) AS n FROM recurring WHERE type = 'debit' OR type IS NULL GROUP BY user_id"


@relation
def nrm25_date_range(d: Spark) -> str:
    return "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'"


@relation
def nrm26_fee_words(d: Spark) -> str:
    from .recurring import FEES

    return f"SELECT category, count(*) AS n FROM ledger WHERE {d.matches('description', '(?i)' + '|'.join(FEES))} GROUP BY category"


@relation
def wn01_balance_gaps(d: Spark) -> str:
    """Rows whose balance moved otherwise than their amounts say, by over a hundredth."""
    return f"""
SELECT statement_id, temp_id, round(gap, 2) AS gap FROM (SELECT statement_id, temp_id, abs(move) - CASE WHEN move < 0 THEN debit WHEN move > 0 THEN credit ELSE 0e0 END AS gap FROM (
  SELECT statement_id, temp_id, debit, credit, balance - lag(balance) OVER (PARTITION BY statement_id ORDER BY day, temp_id) AS move FROM normalized) AS m WHERE move IS NOT NULL) AS g WHERE abs(gap) > 0.01"""


@relation
def ag33_confidence(d: Spark) -> str:
    return f"""
SELECT c.statement_id, round(greatest(0e0, 1 - 0.8e0 * c.exceptions / (c.valid + c.exceptions) - 0.2e0 * least({dbl('coalesce(g.n, 0)')} / greatest(c.valid - 1, 1), 1e0)), 4) AS confidence
FROM nrm10_conservation c LEFT JOIN (SELECT statement_id, count(*) AS n FROM wn01_balance_gaps GROUP BY statement_id) AS g ON g.statement_id = c.statement_id WHERE c.valid + c.exceptions > 0"""


@relation
def jn7_overlap(d: Spark) -> str:
    """Rows inside another statement's period of the same user and bank; the anti-join drops them before any write."""
    return """
SELECT user_id, statement_id, count(*) AS kept FROM ledger l WHERE NOT EXISTS (
  SELECT 1 FROM statements s WHERE s.user_id = l.user_id AND s.statement_id <> l.statement_id AND s.statement_id LIKE '%again' AND CAST(l.ts AS DATE) BETWEEN s.period_start AND s.period_end) GROUP BY user_id, statement_id"""


@relation
def jn7_overlapping_statements(d: Spark) -> str:
    return "SELECT a.statement_id AS a, b.statement_id AS b FROM statements a JOIN statements b ON a.user_id = b.user_id AND a.bank = b.bank AND a.statement_id < b.statement_id AND a.period_start <= b.period_end AND a.period_end >= b.period_start"


@relation
def jn1_left_lookup(d: Spark) -> str:
    return f"""
SELECT l.user_id, coalesce(c.merchant, c.payee, 'Unknown') AS label, count(*) AS n, {dbl('sum(l.debit)')} AS spend FROM ledger l LEFT JOIN (SELECT * FROM clusters WHERE cluster_length > 20) AS c
ON l.user_id = c.user_id AND l.cluster_id = c.cluster_id GROUP BY l.user_id, coalesce(c.merchant, c.payee, 'Unknown')"""


@relation
def jn2_inner_lookup(d: Spark) -> str:
    return "SELECT l.user_id, c.merchant, count(*) AS n FROM ledger l JOIN clusters c ON l.user_id = c.user_id AND l.cluster_id = c.cluster_id WHERE c.merchant IS NOT NULL GROUP BY l.user_id, c.merchant"


@relation
def jn5_group_labels(d: Spark) -> str:
    return f"SELECT g.user_id, g.cluster_id, coalesce(c.merchant, c.payee, g.cluster_id) AS label, {dbl('g.spend')} AS spend FROM (SELECT user_id, cluster_id, sum(debit) AS spend FROM ledger GROUP BY user_id, cluster_id) AS g LEFT JOIN clusters c ON g.user_id = c.user_id AND g.cluster_id = c.cluster_id"


@relation
def jn6_admin_rows(d: Spark) -> str:
    """Users with their plan and number of statements; PL1: an unknown plan reads as the free one."""
    return """
SELECT u.c_custkey, u.c_name, coalesce(p.plan, 'free') AS plan, coalesce(p.statements_allowed, 3) AS allowed, coalesce(s.n, 0) AS orders_n FROM customer u
LEFT JOIN (SELECT * FROM (VALUES ('BUILDING', 'plus', 12), ('MACHINERY', 'pro', 60)) AS t(segment, plan, statements_allowed)) AS p ON p.segment = u.c_mktsegment
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS s ON s.o_custkey = u.c_custkey"""


@relation
def jn9_knn(d: Spark) -> str:
    """CL6's join: the three most similar vectors of the same label, for the query set of a search: every id divisible by 20."""
    dot = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))" if d.name == "duckdb" else "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"
    return f"""
SELECT vec_id, other, {r6('score')} AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, other) AS INTEGER) AS place FROM (
  SELECT a.vec_id, b.vec_id AS other, {dot} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) AS s) AS r WHERE place <= 3"""


@relation
def ag29_bank_coverage(d: Spark) -> str:
    return "SELECT user_id, bank, CAST(min(period_start) AS STRING) AS covered_from, CAST(max(period_end) AS STRING) AS covered_to, count(*) AS statements FROM statements GROUP BY user_id, bank"


@relation
def ag30_usage(d: Spark) -> str:
    return "SELECT user_id, count(*) AS statements, count(DISTINCT bank) AS banks, CAST(sum(total_rows) AS BIGINT) AS total_rows FROM statements GROUP BY user_id"


@relation
def ag31_spellings(d: Spark) -> str:
    return "SELECT user_id, payee AS name, CAST(sum(cluster_length) AS BIGINT) AS weight, count(*) AS clusters FROM clusters WHERE payee IS NOT NULL GROUP BY user_id, payee"


@relation
def ag14_ratios(d: Spark) -> str:
    return f"SELECT l.txn_id, {r6(f'{dbl("l.debit")} / m.med')} AS ratio FROM ledger l JOIN cluster_medians m ON l.user_id = m.user_id AND l.cluster_id = m.cluster_id WHERE l.debit > 0 AND m.med > 0"


@relation
def ag15_spans(d: Spark) -> str:
    return "SELECT user_id, span, CAST(CAST(max_ts AS DATE) AS STRING) AS last_day FROM user_span"


@relation
def so1_top_payments(d: Spark) -> str:
    return f"SELECT txn_id, user_id, {dbl('debit')} AS debit FROM ledger WHERE debit > 0 ORDER BY debit DESC, txn_id, user_id LIMIT 40"


@relation
def so5_latest(d: Spark) -> str:
    return f"SELECT user_id, txn_id, {dbl('balance')} AS balance FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, txn_id DESC) AS rn FROM ledger_balance) AS b WHERE rn = 1"


@relation
def fn05_months(d: Spark) -> str:
    """Month arithmetic: the rolling date one and three months on, and days to it."""
    return f"""
SELECT o_orderkey, CAST({d.rolled('year(o_orderdate)', 'month(o_orderdate) + 1', 'day(o_orderdate)')} AS STRING) AS next_month, CAST({d.rolled('year(o_orderdate)', 'month(o_orderdate) + 3', 'day(o_orderdate)')} AS STRING) AS next_quarter,
       (2025 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) AS months_remaining FROM orders WHERE day(o_orderdate) > 27"""


@relation
def fn13_names(d: Spark) -> str:
    name = f"trim({d.replace(d.replace('lower(p_name)', '[^a-z ]', ' '), ' +', ' ')})"
    return f"SELECT p_partkey, {name} AS name, CAST({d.size(d.words(name))} AS BIGINT) AS tokens FROM part"


@relation
def fn16_money(d: Spark) -> str:
    """en-IN digit groups: the last three, then twos; a real minus sign before the symbol."""
    whole = "CAST(abs(floor(c_acctbal + 0.5)) AS BIGINT)"
    s = f"CAST({whole} AS STRING)"
    grouped = f"CASE WHEN {whole} < 1000 THEN {s} WHEN {whole} < 100000 THEN concat(CAST(CAST(floor({whole} / 1000) AS BIGINT) AS STRING), ',', right({s}, 3)) ELSE concat(CAST(CAST(floor({whole} / 100000) AS BIGINT) AS STRING), ',', substr(right({s}, 5), 1, 2), ',', right({s}, 3)) END"
    return f"SELECT c_custkey, concat(CASE WHEN floor(c_acctbal + 0.5) < 0 THEN '−' ELSE '' END, '₹', {grouped}) AS money FROM customer"


@relation
def fn23_freshness(d: Spark) -> str:
    return """
SELECT user_id, gap, CASE WHEN gap <= 1 THEN 'fresh' WHEN gap <= 3 THEN 'recent' WHEN gap <= 6 THEN 'stale' ELSE 'very_stale' END AS status FROM (
  SELECT user_id, 2002 * 12 + 1 - max(month_idx) AS gap FROM order_ledger GROUP BY user_id) AS g"""


@relation
def order_categories(d: Spark) -> str:
    """The order adapter: monthly spend by segment."""
    return f"SELECT user_id, month, category, {dbl('sum(debit)')} AS spend, count(*) AS n FROM order_ledger WHERE debit > 0 GROUP BY user_id, month, category"


@relation
def src12_scan(d: Spark) -> str:
    return "SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase' AND value > 50"


@relation
def event_days(d: Spark) -> str:
    """The event adapter: the day is the period."""
    return f"SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, event_type, count(*) AS n, {r6('sum(CAST(value AS DECIMAL(18,2)))')} AS total FROM events GROUP BY user_id, CAST(ts AS DATE), event_type"
