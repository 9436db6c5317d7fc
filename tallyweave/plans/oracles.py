"""The SQL that checks the queries: the same questions asked of the same tables, in DuckDB's words."""

from __future__ import annotations

from tallyweave.config import DISPOSITION

# The reconciliation problem made from orders and customer.
_BASE = """
base AS (
  SELECT *, CASE WHEN cents < 0 THEN -1 ELSE 1 END AS sg, abs(cents) AS size,
    CASE WHEN s < 64 THEN 'clean' WHEN s < 70 THEN 'batch' WHEN s < 80 THEN 'lag' WHEN s < 88 THEN 'split' WHEN s < 92 THEN 'typo' ELSE 'missing' END AS scenario,
    lpad(CAST(k AS VARCHAR), 9, '0') AS kk
  FROM (
    SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE -1 END AS cents,
      concat(c_nationkey, '-', c_mktsegment) AS scope, concat(c_mktsegment, ' ', c_name) AS nm, CAST(o_orderdate AS DATE) AS d,
      ((o_orderkey // 100) * 37 + 19 * o_orderkey + 13) % 100 AS s
    FROM orders JOIN customer ON o_custkey = c_custkey)
), mates AS (
  SELECT *, (10037 + (31 * k) % 900000) * sg AS x, CASE WHEN k % 5 = 0 THEN (20011 + (17 * k) % 700000) * sg END AS y FROM base WHERE scenario = 'batch'
), ledger AS (
  SELECT scope, 'E' || kk AS entry_id, d AS date, nm || ' invoice ' || (100 + k % 900) AS description, cents, CASE WHEN k % 10 = 0 THEN 'INV-' || k END AS reference, k * 10 AS ord FROM base
  UNION ALL SELECT scope, 'X' || kk, d + CAST(k % 2 AS INTEGER), nm || ' invoice ' || (100 + (7 * k) % 900), x, NULL, k * 10 + 1 FROM mates
  UNION ALL SELECT scope, 'Y' || kk, d, nm || ' invoice ' || (100 + (11 * k) % 900), y, NULL, k * 10 + 2 FROM mates WHERE y IS NOT NULL
), texts AS (
  SELECT *, CASE WHEN k % 7 = 0 THEN upper(substr('WIRE ' || nm, 1, 22)) WHEN k % 5 = 0 THEN nm ELSE 'CARD ' || nm END AS txt FROM base
), statement AS (
  SELECT scope, 'S' || kk || 'a' AS line_id, d AS date, txt AS description, cents, CASE WHEN k % 20 = 0 THEN 'INV-' || k END AS reference, k * 10 AS ord FROM texts WHERE scenario = 'clean'
  UNION ALL SELECT scope, 'S' || kk || 'a', d + CAST(k % 2 AS INTEGER), ['COMBINED TRANSFER', 'GROUPED SETTLEMENT RUN', 'PAYROLL FILE'][CAST(k % 3 AS INTEGER) + 1], cents + x + coalesce(y, 0), NULL, k * 10 FROM mates
  UNION ALL SELECT scope, 'S' || kk || 'a', d + CAST(1 + k % 3 AS INTEGER), txt, cents, NULL, k * 10 FROM texts WHERE scenario = 'lag'
  UNION ALL SELECT scope, 'S' || kk || 'a', d, txt, (CASE WHEN k % 5 = 0 THEN size // 5 ELSE 2 * size // 5 END) * sg, NULL, k * 10 FROM texts WHERE scenario = 'split'
  UNION ALL SELECT scope, 'S' || kk || 'b', d, txt, (CASE WHEN k % 5 = 0 THEN 2 * size // 5 ELSE size - 2 * size // 5 END) * sg, NULL, k * 10 + 1 FROM texts WHERE scenario = 'split'
  UNION ALL SELECT scope, 'S' || kk || 'c', d, txt, (size - size // 5 - 2 * size // 5) * sg, NULL, k * 10 + 2 FROM texts WHERE scenario = 'split' AND k % 5 = 0
  UNION ALL SELECT scope, 'S' || kk || 'a', d, txt, CASE WHEN (size // 10) % 10 = size % 10 THEN size + 100 ELSE (size // 100) * 100 + (size % 10) * 10 + (size // 10) % 10 END * sg, NULL, k * 10 FROM texts WHERE scenario = 'typo'
  UNION ALL SELECT scope, 'D' || kk, d, txt, cents, NULL, k * 10 + 3 FROM texts WHERE scenario = 'clean' AND k % 97 = 0
  UNION ALL SELECT scope, 'F' || kk, d, 'MONTHLY ACCOUNT FEE', -(5000 + k % 45000), NULL, k * 10 + 4 FROM texts WHERE k % 50 = 1
), pairs AS (
  SELECT k, scope, CASE WHEN scenario = 'batch' AND k % 5 = 0 THEN ['E' || kk, 'X' || kk, 'Y' || kk] WHEN scenario = 'batch' THEN ['E' || kk, 'X' || kk] ELSE ['E' || kk] END AS entry_ids,
    CASE WHEN scenario = 'split' AND k % 5 = 0 THEN ['S' || kk || 'a', 'S' || kk || 'b', 'S' || kk || 'c'] WHEN scenario = 'split' THEN ['S' || kk || 'a', 'S' || kk || 'b'] ELSE ['S' || kk || 'a'] END AS line_ids
  FROM base WHERE scenario IN ('clean', 'batch', 'lag', 'split')
), faults AS (
  SELECT 'ledger' AS side, 'E' || kk AS record_id, 'amount_mismatch_suspect' AS category, 'S' || kk || 'a' AS related_id FROM base WHERE scenario = 'typo'
  UNION ALL SELECT 'statement', 'S' || kk || 'a', 'amount_mismatch_suspect', 'E' || kk FROM base WHERE scenario = 'typo'
  UNION ALL SELECT 'ledger', 'E' || kk, 'missing_in_statement', NULL FROM base WHERE scenario = 'missing'
  UNION ALL SELECT 'statement', 'F' || kk, 'missing_in_ledger', NULL FROM base WHERE k % 50 = 1
  UNION ALL SELECT 'statement', 'D' || kk, 'duplicate_suspect', 'S' || kk || 'a' FROM base WHERE scenario = 'clean' AND k % 97 = 0
)"""


def _tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: t <> ''))"


# Ledger and statement with token lists, and the candidates of the four tiers.
_TIERS = f"""
lt AS (SELECT *, {_tokens("description")} AS tk FROM ledger),
st AS (SELECT *, {_tokens("description")} AS tk FROM statement),
eq AS (
  SELECT l.entry_id, s.line_id, abs(date_diff('day', l.date, s.date)) AS gap, l.reference IS NOT NULL AND l.reference = s.reference AS same_ref,
    CAST(len(list_intersect(l.tk, s.tk)) AS DOUBLE) / least(len(l.tk), len(s.tk)) AS sim
  FROM lt l JOIN st s ON l.scope = s.scope AND l.cents = s.cents AND abs(date_diff('day', l.date, s.date)) <= 3
), t12 AS (
  SELECT [entry_id] AS entry_ids, [line_id] AS line_ids, CASE WHEN gap = 0 THEN 1 ELSE 2 END AS tier,
    CASE WHEN gap = 0 AND coalesce(same_ref, false) THEN 1.0::DOUBLE WHEN gap = 0 THEN 0.95::DOUBLE ELSE 0.6::DOUBLE + 0.3::DOUBLE * sim * (1.0::DOUBLE - gap / 4.0::DOUBLE) END AS confidence
  FROM eq WHERE (gap = 0 AND coalesce(same_ref, false)) OR sim >= 0.55
), w3 AS (
  SELECT l.entry_id, l.cents AS total, s.line_id, s.cents, CAST(len(list_intersect(l.tk, s.tk)) AS DOUBLE) / least(len(l.tk), len(s.tk)) AS sim
  FROM lt l JOIN st s ON l.scope = s.scope AND (l.cents < 0) = (s.cents < 0) AND abs(date_diff('day', l.date, s.date)) <= 3
  QUALIFY row_number() OVER (PARTITION BY l.entry_id ORDER BY s.line_id) <= 12
), t3 AS (
  SELECT [a.entry_id] AS entry_ids, [a.line_id, b.line_id] AS line_ids, 3 AS tier, 0.55::DOUBLE + 0.15::DOUBLE * ((a.sim + b.sim) / 2) - 0.05::DOUBLE * 0 AS confidence
  FROM w3 a JOIN w3 b ON a.entry_id = b.entry_id AND a.line_id < b.line_id WHERE a.cents + b.cents = a.total
  UNION ALL SELECT [a.entry_id], [a.line_id, b.line_id, c.line_id], 3, 0.55::DOUBLE + 0.15::DOUBLE * ((a.sim + b.sim + c.sim) / 3) - 0.05::DOUBLE * 1
  FROM w3 a JOIN w3 b ON a.entry_id = b.entry_id AND a.line_id < b.line_id JOIN w3 c ON a.entry_id = c.entry_id AND b.line_id < c.line_id WHERE a.cents + b.cents + c.cents = a.total
), w4 AS (
  SELECT s.line_id, s.cents AS total, l.entry_id, l.cents, CAST(len(list_intersect(l.tk, s.tk)) AS DOUBLE) / least(len(l.tk), len(s.tk)) AS sim
  FROM st s JOIN lt l ON l.scope = s.scope AND (l.cents < 0) = (s.cents < 0) AND abs(date_diff('day', l.date, s.date)) <= 3
  QUALIFY row_number() OVER (PARTITION BY s.line_id ORDER BY l.entry_id) <= 12
), t4 AS (
  SELECT [a.entry_id, b.entry_id] AS entry_ids, [a.line_id] AS line_ids, 4 AS tier, 0.55::DOUBLE + 0.15::DOUBLE * ((a.sim + b.sim) / 2) - 0.05::DOUBLE * 0 AS confidence
  FROM w4 a JOIN w4 b ON a.line_id = b.line_id AND a.entry_id < b.entry_id WHERE a.cents + b.cents = a.total
  UNION ALL SELECT [a.entry_id, b.entry_id, c.entry_id], [a.line_id], 4, 0.55::DOUBLE + 0.15::DOUBLE * ((a.sim + b.sim + c.sim) / 3) - 0.05::DOUBLE * 1
  FROM w4 a JOIN w4 b ON a.line_id = b.line_id AND a.entry_id < b.entry_id JOIN w4 c ON a.line_id = c.line_id AND b.entry_id < c.entry_id WHERE a.cents + b.cents + c.cents = a.total
), cands AS (SELECT * FROM t12 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4)"""


def _greedy(source: str, order: str, uses: str, prefix: str, rounds: int) -> str:
    """CTEs that end in ``{prefix}won``: rounds of candidates that come first for all they use."""
    out = [f"{prefix}0 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS rk, {uses} AS uses FROM {source})"]
    for i in range(rounds):
        out.append(f"{prefix}u{i} AS (SELECT rk, unnest(uses) AS u FROM {prefix}{i})")
        out.append(f"{prefix}m{i} AS (SELECT u, min(rk) AS m FROM {prefix}u{i} GROUP BY u)")
        out.append(f"{prefix}a{i} AS MATERIALIZED (SELECT rk FROM {prefix}u{i} JOIN {prefix}m{i} USING (u) GROUP BY rk HAVING bool_and(rk = m))")
        out.append(f"{prefix}s{i} AS (SELECT DISTINCT u FROM {prefix}u{i} WHERE rk IN (SELECT rk FROM {prefix}a{i}))")
        out.append(f"{prefix}g{i} AS (SELECT DISTINCT rk FROM {prefix}u{i} WHERE u IN (SELECT u FROM {prefix}s{i}))")
        out.append(f"{prefix}{i + 1} AS MATERIALIZED (SELECT * FROM {prefix}{i} WHERE rk NOT IN (SELECT rk FROM {prefix}g{i}))")
    won = " UNION ALL ".join(f"SELECT rk FROM {prefix}a{i}" for i in range(rounds))
    out.append(f"{prefix}won AS MATERIALIZED (SELECT * FROM {prefix}0 WHERE rk IN ({won}))")
    return ",\n".join(out)


_MATCHED = _greedy("cands", "-confidence, tier, entry_ids, line_ids", "list_concat(list_transform(entry_ids, lambda x: 'E:' || x), list_transform(line_ids, lambda x: 'L:' || x))", "mx", 6)

_TEXT = "CASE WHEN {c} < 0 THEN '-' ELSE '' END || (abs({c}) // 100) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0')"
_DIGITS = "list_filter(string_split(regexp_replace({t}, '[^0-9]', '', 'g'), ''), lambda x: x <> '')"

_BREAKS = (
    f"""
oe AS (SELECT *, {_TEXT.format(c="cents")} AS txt FROM lt WHERE entry_id NOT IN (SELECT unnest(entry_ids) FROM mxwon)),
ol AS (SELECT *, {_TEXT.format(c="cents")} AS txt FROM st WHERE line_id NOT IN (SELECT unnest(line_ids) FROM mxwon)),
od AS (
  SELECT e.entry_id, s.line_id, e.ord AS eo, s.ord AS lo, e.txt AS et, s.txt AS lt, {_DIGITS.format(t="e.txt")} AS da, {_DIGITS.format(t="s.txt")} AS db, e.cents AS ec, s.cents AS lc
  FROM oe e JOIN ol s ON e.scope = s.scope AND (e.cents < 0) = (s.cents < 0) AND abs(date_diff('day', e.date, s.date)) <= 3
  WHERE CAST(len(list_intersect(e.tk, s.tk)) AS DOUBLE) / least(len(e.tk), len(s.tk)) >= 0.55
), nm AS (
  SELECT entry_id, line_id, eo, lo, et, lt FROM od
  WHERE abs(ec - lc) * 100 <= abs(ec) OR (list_sort(da) = list_sort(db) AND len(list_filter(range(1, len(da) + 1), lambda i: da[i] <> db[i])) <= 2)
),
"""
    + _greedy("nm", "eo, lo, entry_id, line_id", "['E:' || entry_id, 'L:' || line_id]", "nx", 5)
    + """,
twins AS (
  SELECT m.date, m.cents, m.description, m.scope, max_by(line_id, key) AS twin
  FROM (SELECT unnest(line_ids) AS line_id, {'e': entry_ids, 'p': generate_subscripts(line_ids, 1)} AS key FROM mxwon) JOIN st m USING (line_id)
  GROUP BY ALL
), restl AS (
  SELECT o.*, t.twin FROM ol o LEFT JOIN twins t ON o.scope = t.scope AND o.date = t.date AND o.cents = t.cents AND o.description = t.description
  WHERE o.line_id NOT IN (SELECT line_id FROM nxwon)
), brk AS (
  SELECT 'ledger' AS side, entry_id AS record_id, 'amount_mismatch_suspect' AS category, 'amounts disagree: ledger ' || et || ' vs statement ' || lt || ' — check for a keying error or an absorbed fee' AS suggestion, line_id AS related_id FROM nxwon
  UNION ALL SELECT 'statement', line_id, 'amount_mismatch_suspect', 'amounts disagree: ledger ' || et || ' vs statement ' || lt || ' — check for a keying error or an absorbed fee', entry_id FROM nxwon
  UNION ALL SELECT 'statement', line_id, 'duplicate_suspect', 'identical to matched line ' || twin || ' — possible double presentation', twin FROM restl WHERE twin IS NOT NULL
  UNION ALL SELECT 'statement', line_id, 'missing_in_ledger', 'no ledger entry for ' || txt || ' on ' || strftime(date, '%Y-%m-%d') || ' — record it (bank fees and interest are the usual culprits)', NULL FROM restl WHERE twin IS NULL
  UNION ALL SELECT 'ledger', entry_id, 'missing_in_statement', 'ledger expects ' || txt || ' around ' || strftime(date, '%Y-%m-%d') || ' but the bank never saw it — payment may have failed or is still in transit', NULL FROM oe WHERE entry_id NOT IN (SELECT entry_id FROM nxwon)
)"""
)

# Both sides as benchmark records.
_RECORDS = """
mid AS (SELECT 'M' || k AS match_id, unnest(entry_ids) AS rec_id FROM pairs UNION ALL SELECT 'M' || k, unnest(line_ids) FROM pairs),
ra AS (
  SELECT 'A' AS side, entry_id AS rec_id, coalesce(match_id, 'U' || entry_id) AS match_id, abs(cents) AS minor, strftime(date, '%Y-%m-%d') AS value_date, CASE WHEN cents < 0 THEN 'CR' ELSE 'DR' END AS direction,
    coalesce(reference, '') AS reference, description AS attributes, 'USD' AS currency, scope AS account, ord, 'USD_' || strftime(date, '%Y-%m-%d') || '_' || scope || '_' || description AS allocation, '' AS target
  FROM ledger LEFT JOIN mid ON entry_id = rec_id
), goals AS (SELECT match_id, list_sort(list_distinct(list(allocation))) AS t FROM ra GROUP BY match_id),
rb AS (
  SELECT 'B' AS side, line_id AS rec_id, coalesce(m.match_id, 'U' || line_id) AS match_id, abs(cents) AS minor, strftime(date, '%Y-%m-%d') AS value_date, CASE WHEN cents < 0 THEN 'DR' ELSE 'CR' END AS direction,
    coalesce(reference, '') AS reference, description AS attributes, 'USD' AS currency, scope AS account, ord, '' AS allocation,
    CASE WHEN t IS NULL THEN '' WHEN len(t) = 1 THEN t[1] ELSE '[' || array_to_string(t, ',') || ']' END AS target, coalesce(t, []) AS goal
  FROM statement LEFT JOIN mid m ON line_id = rec_id LEFT JOIN goals g ON coalesce(m.match_id, 'U' || line_id) = g.match_id
), recs AS (SELECT * FROM ra UNION ALL SELECT * EXCLUDE (goal) FROM rb),
shape AS (
  SELECT match_id, count(*) FILTER (side = 'A') AS na, count(*) FILTER (side = 'B') AS nb, count(DISTINCT minor) = 1 AS one FROM recs GROUP BY match_id
), tru AS (
  SELECT rec_id AS b_id, goal AS target, CASE WHEN nb = 0 THEN 'A-only' WHEN na = 0 THEN 'unmatched' WHEN na = 1 AND nb = 1 THEN '1:1' WHEN na = 1 THEN '1:N' WHEN nb = 1 THEN 'N:1' ELSE 'N:M' END AS cardinality,
    CASE WHEN one THEN 'single-amount' ELSE 'multi-amount' END AS amount_class
  FROM rb JOIN shape USING (match_id)
), dirs AS (SELECT currency, account, value_date, minor, list(DISTINCT direction) AS ds FROM rb GROUP BY ALL),
cel AS (
  SELECT r.currency, r.account, r.value_date, r.minor, count(*) FILTER (side = 'A') AS n_a, count(*) FILTER (side = 'B') AS n_b,
    coalesce(list_sort(list_distinct(list(allocation) FILTER (side = 'A' AND NOT list_contains(coalesce(ds, []), direction)))), []) AS predicted, min(ord) AS mo
  FROM recs r LEFT JOIN dirs d ON r.currency = d.currency AND r.account = d.account AND r.value_date = d.value_date AND r.minor = d.minor GROUP BY ALL
), cels AS (SELECT *, (n_a - n_b) * minor AS imbalance, n_a = n_b AND n_a > 0 AS balanced FROM cel),
oc AS (
  SELECT rec_id AS b_id, b.currency, b.account, b.value_date, b.minor, c.n_a, c.n_b, predicted, t.target, cardinality, amount_class,
    CASE WHEN len(predicted) = 0 THEN 'NO_PREDICTION' WHEN predicted = t.target THEN 'EXACT' WHEN len(list_filter(predicted, lambda x: NOT list_contains(t.target, x))) = 0 THEN 'STRICT_SUBSET'
      WHEN len(list_filter(t.target, lambda x: NOT list_contains(predicted, x))) = 0 THEN 'STRICT_SUPERSET' WHEN len(list_intersect(predicted, t.target)) > 0 THEN 'OVERLAP' ELSE 'DISJOINT' END AS outcome
  FROM rb b JOIN cels c ON b.currency = c.currency AND b.account = c.account AND b.value_date = c.value_date AND b.minor = c.minor JOIN tru t ON t.b_id = b.rec_id
)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join([_BASE, *parts]) + "\n" + select


def _wilson(k: str, n: str) -> str:
    p, m = f"(CAST({k} AS DOUBLE) / {n})", f"CAST({n} AS DOUBLE)"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE ({p} + 2.706025 / (2 * {m}) - 1.645 * sqrt({p} * (1 - {p}) / {m} + 2.706025 / (4 * {m} * {m}))) / (1 + 2.706025 / {m}) END"


def _candidates(cte: str) -> str:
    return f"SELECT array_to_string(entry_ids, ',') AS entry_ids, array_to_string(line_ids, ',') AS line_ids, CAST(tier AS INTEGER) AS tier, round(confidence, 9) AS confidence FROM {cte}"


_MATCHES = (_TIERS, _MATCHED)
_OUT = ("exact", "strict_subset", "strict_superset", "overlap", "disjoint", "no_prediction")
_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o.upper()}') AS {o}" for o in _OUT)
_STRATA = "CASE WHEN GROUPING(cardinality) = 1 THEN 'ALL' WHEN GROUPING(amount_class) = 1 THEN cardinality ELSE cardinality || ' / ' || amount_class END AS stratum"
_SETS = "GROUP BY GROUPING SETS ((), (cardinality), (cardinality, amount_class))"
_PRF = """
  SELECT {by} round(CASE WHEN p > 0 THEN h / p WHEN g = 0 THEN 1.0 ELSE 0.0 END, 9) AS precision, round(CASE WHEN g > 0 THEN h / g WHEN p = 0 THEN 1.0 ELSE 0.0 END, 9) AS recall,
    round(CASE WHEN h = 0 THEN CASE WHEN p = 0 AND g = 0 THEN 1.0 ELSE 0.0 END ELSE 2 * (h / p) * (h / g) / (h / p + h / g) END, 9) AS f1
  FROM ({inner})"""
_PAIR_COUNTS = """SELECT CAST((SELECT count(*) FROM (SELECT entry_ids, line_ids FROM mxwon INTERSECT SELECT list_sort(entry_ids), list_sort(line_ids) FROM pairs)) AS DOUBLE) AS h,
    CAST((SELECT count(*) FROM (SELECT DISTINCT entry_ids, line_ids FROM mxwon)) AS DOUBLE) AS p, CAST((SELECT count(*) FROM pairs) AS DOUBLE) AS g"""
_CATS = "(VALUES ('ALL'), ('missing_in_ledger'), ('missing_in_statement'), ('amount_mismatch_suspect'), ('duplicate_suspect')) c(category)"
_BREAK_COUNTS = f"""SELECT c.category, CAST(count(DISTINCT CASE WHEN pp AND gg THEN side || record_id || z.category END) AS DOUBLE) AS h, CAST(count(DISTINCT CASE WHEN pp THEN side || record_id || z.category END) AS DOUBLE) AS p, CAST(count(DISTINCT CASE WHEN gg THEN side || record_id || z.category END) AS DOUBLE) AS g
  FROM {_CATS} LEFT JOIN (SELECT side, record_id, category, bool_or(q = 'p') AS pp, bool_or(q = 'g') AS gg FROM (SELECT side, record_id, category, 'p' AS q FROM brk UNION ALL SELECT side, record_id, category, 'g' FROM faults) GROUP BY ALL) z ON c.category = 'ALL' OR c.category = z.category GROUP BY c.category"""
_AMR = """SELECT CASE WHEN count(k) = 0 THEN 0.0 ELSE round(max(k)::DOUBLE / (SELECT count(*) FROM pairs), 9) END AS rate, coalesce(round(max_by(confidence, (k, -confidence)), 9), 1.0) AS threshold, coalesce(round(max_by(k::DOUBLE / n, (k, -confidence)), 9), 1.0) AS precision_at
  FROM (SELECT confidence, sum(n) OVER w AS n, sum(k) OVER w AS k FROM (SELECT confidence, count(*) AS n, count(g.k) AS k FROM mxwon m LEFT JOIN pairs g ON list_sort(g.entry_ids) = m.entry_ids AND list_sort(g.line_ids) = m.line_ids GROUP BY confidence) WINDOW w AS (ORDER BY confidence DESC))
  WHERE k::DOUBLE / n + 1e-12 >= 0.99 AND k > 0"""

_SCOPE = """
cand AS (
  SELECT b.rec_id AS b_id, b.target, count(a.rec_id) FILTER (a.direction <> b.direction) AS n, count(a.rec_id) FILTER (a.direction = b.direction) AS removed,
    min(a.rec_id) FILTER (a.direction <> b.direction) AS a1, min(a.allocation) FILTER (a.direction <> b.direction) AS al, min(a.direction) FILTER (a.direction <> b.direction) AS ad, b.currency, b.account, b.value_date, b.minor
  FROM rb b LEFT JOIN ra a ON a.currency = b.currency AND a.account = b.account AND a.value_date = b.value_date AND a.minor = b.minor GROUP BY ALL
), candm AS (
  SELECT c.*, n = 1 AND (SELECT count(*) FROM rb x WHERE x.currency = c.currency AND x.account = c.account AND x.value_date = c.value_date AND x.minor = c.minor AND x.direction <> c.ad) = 1 AS mutual FROM cand c
)"""
_RULES = f"""SELECT rule, stratum, predicted, correct, matchable, total, false_on_unmatched, round(CASE WHEN predicted > 0 THEN correct::DOUBLE / predicted END, 9) AS precision, round({_wilson("correct", "predicted")}, 9) AS wilson_lb,
    CASE WHEN predicted = 0 THEN 'n/a' WHEN {_wilson("correct", "predicted")} >= 0.998 THEN 'PASS' ELSE 'fail' END AS verdict FROM (
  SELECT rule, CASE WHEN GROUPING(cardinality) = 1 THEN 'ALL' ELSE cardinality END AS stratum, count(*) FILTER (said) AS predicted, count(*) FILTER (said AND has AND al = target) AS correct, count(*) FILTER (has) AS matchable, count(*) AS total, count(*) FILTER (said AND NOT has) AS false_on_unmatched
  FROM (SELECT 'unique' AS rule, n = 1 AS said, target <> '' AS has, al, target, cardinality FROM candm JOIN (SELECT b_id, cardinality FROM tru) USING (b_id) UNION ALL SELECT 'mutual', mutual, target <> '', al, target, cardinality FROM candm JOIN (SELECT b_id, cardinality FROM tru) USING (b_id))
  GROUP BY GROUPING SETS ((rule), (rule, cardinality)))"""

_FIELDS = " UNION ALL ".join(f"SELECT side, '{f}' AS field, CAST({f} AS VARCHAR) AS v FROM recs" for f in ("minor", "value_date", "reference", "attributes", "currency", "account", "direction"))
_O2O = """
o2o AS (SELECT match_id FROM shape WHERE na = 1 AND nb = 1),
oa AS (SELECT * FROM ra WHERE match_id IN (SELECT match_id FROM o2o)), ob AS (SELECT * EXCLUDE (goal) FROM rb WHERE match_id IN (SELECT match_id FROM o2o))"""
_NORM8 = "substr(trim(regexp_replace(lower({t}.attributes), '\\s+', ' ', 'g')), 1, 8)"


def _block(name: str, keys: str) -> str:
    """``keys`` with {t} for the table's alias."""
    eq = " AND ".join(f"{k.format(t='x')} = {k.format(t='b')}" for k in keys.split("; "))
    hit = " AND ".join(f"{k.format(t='a')} = {k.format(t='b')}" for k in keys.split("; "))
    cols = ", ".join(f"{k.format(t='x')}" for k in keys.split("; "))
    names = ", ".join(f"k{i}" for i in range(len(keys.split("; "))))
    on = " AND ".join(f"z.k{i} = {k.format(t='b')}" for i, k in enumerate(keys.split("; ")))
    del eq
    return f"""SELECT '{name}' AS key, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS recall, min(size) FILTER (rn > least(n - 1, floor(0.5 * n))) AS p50, min(size) FILTER (rn > least(n - 1, floor(0.95 * n))) AS p95, min(size) FILTER (rn > least(n - 1, floor(0.99 * n))) AS p99, max(size) AS largest
  FROM (SELECT hit, size, row_number() OVER (ORDER BY size) AS rn, count(*) OVER () AS n FROM (
    SELECT {hit} AS hit, coalesce(z.c, 0) AS size FROM ob b JOIN oa a USING (match_id) LEFT JOIN (SELECT {cols.replace("x.", "x.")}, count(*) AS c FROM ra x GROUP BY ALL) z({names}, c) ON {on}))"""


_BLOCKS = " UNION ALL ".join(
    [_block("amount", "{t}.minor"), _block("amount_date", "{t}.minor; {t}.value_date"), _block("amount_date_reference", "{t}.minor; {t}.value_date; {t}.reference"), _block("attributes_prefix", _NORM8)]
)

_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(attributes || ' ' || reference), '\\s+'), lambda t: t <> ''))"
_WITNESS = f"""
rt AS (SELECT *, {_TOK} AS tk FROM recs),
ctok AS (
  SELECT currency, account, value_date, minor, list(token) AS common FROM (
    SELECT currency, account, value_date, minor, token, count(*) AS c FROM (SELECT currency, account, value_date, minor, rec_id, unnest(tk) AS token FROM rt WHERE side = 'A') GROUP BY ALL) JOIN cels USING (currency, account, value_date, minor)
  WHERE c = n_a GROUP BY ALL
), place AS (SELECT currency, account, value_date, minor, min({{'s': side, 'o': ord}}) AS po FROM recs GROUP BY ALL),
ci AS (SELECT c.*, coalesce(common, []) AS common, po FROM cels c LEFT JOIN ctok USING (currency, account, value_date, minor) JOIN place USING (currency, account, value_date, minor)),
via AS (
  SELECT a.currency, a.account, a.value_date, a.minor, min_by(b.minor, b.po) AS wm,
    min_by(CASE WHEN a.n_a = 0 THEN len(b.common) > 0 ELSE len(list_intersect(a.common, b.common)) > 0 END, b.po) AS shares
  FROM ci a JOIN ci b ON a.currency = b.currency AND a.account = b.account AND a.value_date = b.value_date AND a.minor <> b.minor AND b.balanced GROUP BY ALL
), turn AS (
  SELECT a.currency, a.account, a.value_date, a.minor, min_by(y.minor, y.po) AS cm
  FROM ci a JOIN ci y ON a.currency = y.currency AND a.account = y.account AND a.value_date = y.value_date AND a.minor <> y.minor
    JOIN ci x ON a.currency = x.currency AND a.account = x.account AND a.value_date = x.value_date AND a.minor <> x.minor AND x.minor <> y.minor AND x.imbalance = -y.imbalance AND x.po < y.po GROUP BY ALL
), wit AS (
  SELECT ci.*, CASE WHEN wm IS NOT NULL AND shares THEN 'L2_balance_token' WHEN wm IS NOT NULL OR cm IS NOT NULL THEN 'L1_balance' ELSE 'none' END AS witness, coalesce(wm, cm) AS witness_minor
  FROM ci LEFT JOIN via USING (currency, account, value_date, minor) LEFT JOIN turn USING (currency, account, value_date, minor)
)"""

_QGRAM = "CASE WHEN length({s}) = 0 THEN [] WHEN length({s}) < {q} THEN [{s}] ELSE list_distinct(list_transform(range(1, length({s}) - {q} + 2), lambda i: substr({s}, i, {q}))) END"


def _jac(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len(list_distinct(list_concat({x}, {y}))) ELSE 0.0 END"


# Names of equal segment and nation: ambiguous blocks, as in ranking candidates by text.
_NAMES = f"""
cn AS (SELECT c_custkey, c_nationkey, c_mktsegment, lower(c_name) AS s FROM customer),
cg AS (SELECT *, {_QGRAM.format(s="s", q=2)} AS g2, {_QGRAM.format(s="s", q=3)} AS g3 FROM cn),
cp AS (
  SELECT a.c_custkey AS a_key, b.c_custkey AS b_key, round({_jac("a.g2", "b.g2")}, 9) AS qgram2, round({_jac("a.g3", "b.g3")}, 9) AS qgram3
  FROM cg a JOIN cg b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey
)"""

_FRONT = f"""
sc AS (SELECT b_id, CASE WHEN outcome = 'EXACT' THEN 1 ELSE 0 END AS label, (n_a + n_b) * 1000 + minor % 997 AS score FROM oc WHERE len(predicted) > 0),
rk AS (SELECT row_number() OVER w AS n, sum(label) OVER (ORDER BY score DESC, b_id ROWS UNBOUNDED PRECEDING) AS exact, CAST(score AS DOUBLE) AS threshold FROM sc WINDOW w AS (ORDER BY score DESC, b_id)),
fr AS (SELECT n, round(n::DOUBLE / (SELECT count(*) FROM rb), 9) AS coverage, CAST(exact AS BIGINT) AS exact, round({_wilson("exact", "n")}, 9) AS lb, threshold FROM rk)"""


# Subset sums over whole windows, without the cut to twelve.
_UNCAPPED = _TIERS.replace("QUALIFY row_number() OVER (PARTITION BY l.entry_id ORDER BY s.line_id) <= 12", "").replace("QUALIFY row_number() OVER (PARTITION BY s.line_id ORDER BY l.entry_id) <= 12", "")

_REASON = """CASE WHEN bool_and(outcome = 'EXACT') THEN 'NONE_ALL_EXACT' ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN bool_or(outcome = 'STRICT_SUBSET') THEN 'FRAGMENTED_MULTI_AMOUNT_GROUP' END, CASE WHEN bool_or(outcome = 'STRICT_SUPERSET') THEN 'MERGED_FOREIGN_RECORDS' END, CASE WHEN bool_or(outcome = 'OVERLAP') THEN 'PARTIAL_CELL_COLLISION' END, CASE WHEN bool_or(outcome = 'DISJOINT') THEN 'WRONG_CELL' END], lambda x: x IS NOT NULL), '+'), ''), 'MIXED') END"""
_EVIDENCE = f"""
ids AS (
  SELECT currency, account, value_date, minor, coalesce(string_agg(rec_id, ' ' ORDER BY rec_id) FILTER (side = 'A'), '') AS a_ids, coalesce(string_agg(rec_id, ' ' ORDER BY rec_id) FILTER (side = 'B'), '') AS b_ids FROM recs GROUP BY ALL
), ev AS (
  SELECT currency, account, value_date, minor, min(n_a) AS n_a, min(n_b) AS n_b, min(len(predicted)) AS n_predicted_allocations, array_to_string(list_sort(list(DISTINCT cardinality)), ' ') AS true_cardinalities,
    array_to_string(list_sort(list(DISTINCT amount_class)), ' ') AS true_amount_classes, count(*) AS n_b_total, {_REASON} AS collision_reason, {", ".join(f"count(*) FILTER (outcome = '{x.upper()}') AS outcome_{x}" for x in _OUT)}
  FROM oc WHERE len(predicted) > 0 GROUP BY currency, account, value_date, minor
)"""
_EVIDENCE_ROWS = f"""SELECT concat_ws('|', currency, account, value_date, minor) AS component_id, currency, account, value_date, minor, n_a, n_b, n_a || ':' || n_b AS shape, '{{' || minor || '}}x' || (n_a + n_b) AS amount_multiset, 1 AS distinct_amounts,
  n_predicted_allocations, a_ids, b_ids, '{DISPOSITION}' AS disposition, true_cardinalities, true_amount_classes, collision_reason, outcome_exact AS n_b_exact, n_b_total, {", ".join(f"outcome_{x}" for x in _OUT)}
  FROM ev JOIN ids USING (currency, account, value_date, minor)"""

# The tiered matcher's allocations for each line, scored as exact sets.
_TIERED = """
guess AS (SELECT l AS b_id, list_sort(list(DISTINCT allocation)) AS predicted FROM (SELECT unnest(line_ids) AS l, entry_ids FROM mxwon) m, unnest(entry_ids) u(e) JOIN ra ON rec_id = e GROUP BY l),
scored AS (SELECT CASE WHEN len(target) = 0 THEN 'true-unmatched' WHEN len(target) = 1 THEN 'single-A' ELSE 'multi-A' END AS st, coalesce(predicted, []) = target AS hit, len(coalesce(predicted, [])) > 0 AS o FROM tru LEFT JOIN guess USING (b_id))"""


def _set_scores(source: str) -> str:
    return f"SELECT stratum, n, exact, emitted, emitted_exact, round(exact::DOUBLE / n, 9) AS match_rate, round(CASE WHEN emitted > 0 THEN emitted_exact::DOUBLE / emitted ELSE 0 END, 9) AS precision, round({_wilson('emitted_exact', 'emitted')}, 9) AS wilson_lb FROM (SELECT CASE WHEN GROUPING(st) = 1 THEN 'ALL' ELSE st END AS stratum, count(*) AS n, count(*) FILTER (hit) AS exact, count(*) FILTER (o) AS emitted, count(*) FILTER (hit AND o) AS emitted_exact FROM {source} GROUP BY GROUPING SETS ((), (st)))"


def _longest(x: str, y: str) -> str:
    """The longest common run of two texts: its length, and its first place in x, then in y, as negatives."""
    return f"list_max(flatten(list_transform(range(1, length({x}) + 1), lambda i: list_transform(range(1, length({x}) - i + 2), lambda n: {{'k': CASE WHEN contains({y}, substr({x}, i, n)) THEN n ELSE 0 END, 'i': -i, 'j': -strpos({y}, substr({x}, i, n))}}))))"


# The character ratio by its definition: the longest common run, then the same left and right of it.
_RATIOS = f"""
nm AS (SELECT a.c_custkey, a.c_mktsegment || ' ' || a.c_name AS own, b.c_mktsegment || ' ' || b.c_name AS other FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1),
pr AS (SELECT c_custkey AS id, 'ratio' AS kind, own AS x, other AS y FROM nm UNION ALL SELECT c_custkey, 'reverse', other, own FROM nm UNION ALL SELECT c_custkey, 'low', lower(own), lower(other) FROM nm),
seg AS (
  SELECT id, kind, x, y, {_longest("x", "y")} AS m FROM pr
  UNION ALL
  SELECT id, kind, c.x, c.y, {_longest("c.x", "c.y")} FROM (
    SELECT id, kind, unnest([{{'x': substr(x, 1, -m.i - 1), 'y': substr(y, 1, -m.j - 1)}}, {{'x': substr(x, m.k - m.i), 'y': substr(y, m.k - m.j)}}]) AS c FROM seg WHERE m.k > 0)
), rat AS (SELECT p.id, p.kind, 2.0::DOUBLE * sum(coalesce(m.k, 0)) / min(length(p.x) + length(p.y)) AS r FROM pr p JOIN seg s ON s.id = p.id AND s.kind = p.kind GROUP BY ALL),
tok AS (SELECT c_custkey, {_tokens("own")} AS a, {_tokens("other")} AS b FROM nm)"""
_RATIO_ROWS = """SELECT c_custkey, round(max(r) FILTER (kind = 'ratio'), 9) AS ratio, round(max(r) FILTER (kind = 'reverse'), 9) AS reverse,
  round(greatest(max(r) FILTER (kind = 'low'), max(len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)))), 9) AS sim FROM tok JOIN rat ON id = c_custkey GROUP BY c_custkey"""

# The four tiers with the whole similarity, which is worked out for pairs of texts that need it.
_FULL_TIERS = f"""
near AS (
  SELECT l.entry_id, s.line_id, l.cents AS lc, s.cents AS sc, lower(l.description) AS x, lower(s.description) AS y, abs(date_diff('day', l.date, s.date)) AS gap, coalesce(l.reference = s.reference, false) AS same_ref
  FROM ledger l JOIN statement s ON l.scope = s.scope AND (l.cents < 0) = (s.cents < 0) AND abs(date_diff('day', l.date, s.date)) <= 3
), eq AS (SELECT * FROM near WHERE lc = sc),
w3 AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY line_id) <= 12),
w4 AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY entry_id) <= 12),
hit AS (
  SELECT 3 AS tier, [a.entry_id] AS entry_ids, [a.line_id, b.line_id] AS line_ids, [a.x, b.x] AS xs, [a.y, b.y] AS ys FROM w3 a JOIN w3 b ON a.entry_id = b.entry_id AND a.line_id < b.line_id WHERE a.sc + b.sc = a.lc
  UNION ALL SELECT 3, [a.entry_id], [a.line_id, b.line_id, c.line_id], [a.x, b.x, c.x], [a.y, b.y, c.y] FROM w3 a JOIN w3 b ON a.entry_id = b.entry_id AND a.line_id < b.line_id JOIN w3 c ON a.entry_id = c.entry_id AND b.line_id < c.line_id WHERE a.sc + b.sc + c.sc = a.lc
  UNION ALL SELECT 4, [a.entry_id, b.entry_id], [a.line_id], [a.x, b.x], [a.y, b.y] FROM w4 a JOIN w4 b ON a.line_id = b.line_id AND a.entry_id < b.entry_id WHERE a.lc + b.lc = a.sc
  UNION ALL SELECT 4, [a.entry_id, b.entry_id, c.entry_id], [a.line_id], [a.x, b.x, c.x], [a.y, b.y, c.y] FROM w4 a JOIN w4 b ON a.line_id = b.line_id AND a.entry_id < b.entry_id JOIN w4 c ON a.line_id = c.line_id AND b.entry_id < c.entry_id WHERE a.lc + b.lc + c.lc = a.sc
), parts AS (SELECT row_number() OVER () AS no, * FROM hit), flat AS (SELECT no, unnest(xs) AS x, unnest(ys) AS y, generate_subscripts(xs, 1) AS pos FROM parts),
pr AS MATERIALIZED (SELECT row_number() OVER () AS id, 'low' AS kind, x, y FROM (SELECT x, y FROM eq UNION SELECT x, y FROM flat)),
seg AS (
  SELECT id, kind, x, y, {_longest("x", "y")} AS m FROM pr
  UNION ALL
  SELECT id, kind, c.x, c.y, {_longest("c.x", "c.y")} FROM (
    SELECT id, kind, unnest([{{'x': substr(x, 1, -m.i - 1), 'y': substr(y, 1, -m.j - 1)}}, {{'x': substr(x, m.k - m.i), 'y': substr(y, m.k - m.j)}}]) AS c FROM seg WHERE m.k > 0)
), sm AS MATERIALIZED (
  SELECT p.x, p.y, greatest(2.0::DOUBLE * sum(coalesce(m.k, 0)) / min(length(p.x) + length(p.y)), max(len(list_intersect({_tokens("p.x")}, {_tokens("p.y")}))::DOUBLE / least(len({_tokens("p.x")}), len({_tokens("p.y")})))) AS sim
  FROM pr p JOIN seg s ON s.id = p.id GROUP BY p.id, p.x, p.y
), means AS (SELECT no, fsum(sim ORDER BY pos) / count(*) AS sim FROM flat JOIN sm USING (x, y) GROUP BY no),
cands AS (
  SELECT [entry_id] AS entry_ids, [line_id] AS line_ids, CASE WHEN gap = 0 THEN 1 ELSE 2 END AS tier,
    CASE WHEN gap = 0 AND same_ref THEN 1.0::DOUBLE WHEN gap = 0 THEN 0.95::DOUBLE ELSE 0.6::DOUBLE + 0.3::DOUBLE * sim * (1.0::DOUBLE - gap / 4.0::DOUBLE) END AS confidence
  FROM eq JOIN sm USING (x, y) WHERE (gap = 0 AND same_ref) OR sim >= 0.55
  UNION ALL SELECT entry_ids, line_ids, tier, 0.55::DOUBLE + 0.15::DOUBLE * sim - 0.05::DOUBLE * (len(xs) - 2) FROM parts JOIN means USING (no)
)"""

# The features, family by family, in the words of their definitions.
_SAME = "x.currency = b.currency AND x.account = b.account AND x.value_date = b.value_date"
_CELLMATE = _SAME + " AND x.minor = b.minor"
_SIBLING = "(SELECT count(DISTINCT x.rec_id) FROM rt x WHERE " + _SAME + " AND x.side = '{s}' AND x.minor <> b.minor AND list_has_any(x.tk, (SELECT list_distinct(flatten(list(y.tk))) FROM rt y WHERE y.side = '{s}' AND y.currency = b.currency AND y.account = b.account AND y.value_date = b.value_date AND y.minor = b.minor)))"
_FEATURE_SQL = {
    "n_a": "b.n_a", "n_b": "b.n_b", "shape_balanced": "b.n_a = b.n_b", "pred_size": "len(b.predicted)",
    "witness_count": f"(SELECT count(*) FROM ci x WHERE {_SAME} AND x.balanced AND x.minor <> b.minor)",
    "witness_token_count": f"(SELECT count(*) FROM ci x WHERE {_SAME} AND x.balanced AND x.minor <> b.minor AND list_has_any(x.common, b.common))",
    "date_cells": f"(SELECT count(*) FROM cels x WHERE {_SAME})", "date_balanced_cells": f"(SELECT count(*) FROM cels x WHERE {_SAME} AND x.balanced)", "date_records": f"(SELECT count(*) FROM recs x WHERE {_SAME})",
    "amount_minor": "b.minor", "log_amount": "CASE WHEN b.minor > 0 THEN log10(b.minor) ELSE 0 END", "round_unit": "b.minor % 100 = 0", "round_ten": "b.minor % 1000 = 0", "round_hundred": "b.minor % 10000 = 0",
    "amount_global_freq": "(SELECT count(*) FROM recs x WHERE x.minor = b.minor)", "amount_date_freq": f"(SELECT count(*) FROM recs x WHERE {_CELLMATE})", "amount_alone_on_date": f"(SELECT count(*) FROM recs x WHERE {_CELLMATE}) = b.n_a + b.n_b",
    "amount_window_freq": "(SELECT count(*) FROM cels x WHERE x.minor = b.minor AND abs(date_diff('day', CAST(x.value_date AS DATE), CAST(b.value_date AS DATE))) <= 3)",
    "ab_qgram3_max": f"(SELECT max({_jac('x.g3', 'b.g3')}) FROM fa x WHERE x.side = 'A' AND {_CELLMATE})", "ab_token_overlap": f"(SELECT max(len(list_intersect(x.tk, b.tk))) FROM fa x WHERE x.side = 'A' AND {_CELLMATE})",
    "ab_shares_token": f"(SELECT max(len(list_intersect(x.tk, b.tk))) FROM fa x WHERE x.side = 'A' AND {_CELLMATE}) > 0",
    "b_attr_len": "length(b.attributes)", "a_attr_len": f"(SELECT avg(length(x.attributes)) FROM ra x WHERE {_CELLMATE})", "b_attr_empty": "trim(b.attributes) = ''", "b_has_ref": "trim(b.reference) <> ''",
    "a_has_ref": f"(SELECT avg(CASE WHEN trim(x.reference) <> '' THEN 1.0 ELSE 0.0 END) FROM ra x WHERE {_CELLMATE})",
    "a_sib_token_diffamt": _SIBLING.format(s="A"), "a_sib_any_diffamt": f"(SELECT count(*) FROM recs x WHERE {_SAME} AND x.minor <> b.minor)", "b_sib_token_diffamt": _SIBLING.format(s="B"), "b_sib_any_diffamt": f"(SELECT count(*) FROM recs x WHERE {_SAME} AND x.minor <> b.minor)",
    "b_dir_dr": "b.direction = 'DR'",
}
_FEATURES = f"""
fa AS (SELECT *, lower(attributes) AS s, {_QGRAM.format(s="lower(attributes)", q=3)} AS g3 FROM rt),
fb AS (SELECT o.b_id, o.outcome, o.predicted, o.n_a, o.n_b, ci.common, f.* FROM oc o JOIN fa f ON f.rec_id = o.b_id JOIN ci ON ci.currency = o.currency AND ci.account = o.account AND ci.value_date = o.value_date AND ci.minor = o.minor WHERE len(o.predicted) > 0)"""


def oracle_sql() -> dict[str, str]:
    line = "SELECT scope, {i}, date, description, cents, reference FROM {t}"
    return {
        "recon_ledger": _with(select=line.format(i="entry_id", t="ledger")),
        "recon_statement": _with(select=line.format(i="line_id", t="statement")),
        "recon_truth": _with(select="SELECT scope, array_to_string(entry_ids, ',') AS entry_ids, array_to_string(line_ids, ',') AS line_ids FROM pairs"),
        "tier12_exact_and_lagged": _with(_TIERS, select=_candidates("t12")),
        "tier3_splits": _with(_TIERS, select=_candidates("t3")),
        "tier4_batches": _with(_TIERS, select=_candidates("t4")),
        "tier34_uncapped": _with(_UNCAPPED, select=_candidates("(SELECT * FROM t3 UNION ALL SELECT * FROM t4)")),
        "match_greedy_rounds": _with(*_MATCHES, select=_candidates("mxwon")),
        "rendered_report": _with(*_MATCHES, select="SELECT array_to_string(entry_ids, ', ') AS ledger, array_to_string(line_ids, ', ') AS statement, CAST(tier AS INTEGER) AS tier, round(confidence, 3) AS confidence FROM mxwon"),
        "tier_accuracy": _with(*_MATCHES, select="SELECT CAST(tier AS INTEGER) AS tier, count(*) AS predicted, count(g.k) AS correct, round(count(g.k)::DOUBLE / count(*), 9) AS precision FROM mxwon m LEFT JOIN pairs g ON list_sort(g.entry_ids) = m.entry_ids AND list_sort(g.line_ids) = m.line_ids GROUP BY tier"),
        "cell_evidence": _with(_RECORDS, _EVIDENCE, select=_EVIDENCE_ROWS),
        "tiered_set_score": _with(*_MATCHES, _RECORDS, _TIERED, select=_set_scores("scored")),
        "frontier_features": _with(_RECORDS, _WITNESS, _FEATURES, select="SELECT b_id, CAST(outcome = 'EXACT' AS INTEGER) AS label, " + ", ".join(f"round(CAST({e} AS DOUBLE), 9) AS {n}" for n, e in _FEATURE_SQL.items()) + " FROM fb b"),
        "frontier_at_coverage": _with(_RECORDS, _FRONT, select="SELECT * FROM fr WHERE coverage >= 0.5 ORDER BY n LIMIT 1"),
        "match_greedy": _with(*_MATCHES, select=_candidates("mxwon")),
        "breaks": _with(*_MATCHES, _BREAKS, select="SELECT * FROM brk"),
        "break_counts": _with(*_MATCHES, _BREAKS, select="SELECT category, side, count(*) AS n FROM brk GROUP BY ALL"),
        "recon_summary": _with(*_MATCHES, _BREAKS, select="SELECT (SELECT count(*) FROM ledger) AS n_entries, (SELECT count(*) FROM statement) AS n_lines, (SELECT count(DISTINCT e) FROM (SELECT unnest(entry_ids) AS e FROM mxwon)) AS n_matched_entries, (SELECT count(*) FROM brk) AS n_breaks, round((SELECT count(DISTINCT e) FROM (SELECT unnest(entry_ids) AS e FROM mxwon))::DOUBLE / (SELECT count(*) FROM ledger), 9) AS match_rate"),
        "pair_prf": _with(*_MATCHES, select=_PRF.format(by="", inner=_PAIR_COUNTS)),
        "break_prf": _with(*_MATCHES, _BREAKS, select=_PRF.format(by="category,", inner=_BREAK_COUNTS)),
        "auto_match_rate": _with(*_MATCHES, select=_AMR),
        "wilson_bounds": f"SELECT n, k, round({_wilson('k', 'n')}, 9) AS lb FROM (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS k FROM customer GROUP BY 1)",
        "min_n_bound": f"SELECT min(n) AS min_n FROM range(1, 20001) t(n) WHERE {_wilson('n', 'n')} >= 0.998",
        "group_split": "SELECT o_orderkey, CASE WHEN list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 38, 4), lambda p: CAST('0x' || substr(sha1('M' || o_orderkey), p, 4) AS BIGINT))), lambda a, x: (a * 65536 + x) % 10000) < 7000 THEN 'dev' ELSE 'val' END AS split FROM orders",
        "token_containment": f"SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, round(CAST(len(list_intersect(a.tk, b.tk)) AS DOUBLE) / least(len(a.tk), len(b.tk)), 9) AS sim FROM (SELECT p_partkey, p_brand, {_tokens('p_name')} AS tk FROM part) a JOIN (SELECT p_partkey, p_brand, {_tokens('p_name')} AS tk FROM part) b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND b.p_partkey - a.p_partkey <= 50",
        "qgram_jaccard": "WITH " + _NAMES + " SELECT * FROM cp WHERE a_key < b_key",
        "argmax_by_text": "WITH " + _NAMES + " SELECT b_key, min_by(a_key, (-qgram3, a_key)) AS a_key FROM cp GROUP BY b_key",
        "char_ratio_names": "WITH RECURSIVE " + _RATIOS + _RATIO_ROWS,
        "match_desc_sim": "WITH RECURSIVE " + _with(_FULL_TIERS, _MATCHED, select=_candidates("mxwon")).removeprefix("WITH "),
        "scope_candidates": _with(_RECORDS, _SCOPE, select="SELECT b_id, n, removed, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'impossible' END AS class, CASE WHEN n = 1 THEN a1 END AS sole_a, mutual FROM candm"),
        "scope_rules": _with(_RECORDS, _SCOPE, select=_RULES),
        "cells": _with(_RECORDS, select="SELECT currency, account, value_date, minor, n_a, n_b, imbalance, balanced, array_to_string(predicted, ',') AS predicted FROM cels"),
        "cell_outcomes": _with(_RECORDS, select=f"SELECT {_STRATA}, {_COUNTS} FROM oc {_SETS}"),
        "cell_rates": _with(_RECORDS, select=f"SELECT stratum, total, predicted, exact, round(exact::DOUBLE / total, 9) AS recall, round(CASE WHEN predicted > 0 THEN exact::DOUBLE / predicted ELSE 0 END, 9) AS precision, round({_wilson('exact', 'predicted')}, 9) AS wilson_lb FROM (SELECT {_STRATA}, count(*) AS total, count(*) FILTER (outcome <> 'NO_PREDICTION') AS predicted, count(*) FILTER (outcome = 'EXACT') AS exact FROM oc {_SETS})"),
        "cell_collisions": _with(_RECORDS, select="SELECT reason AS collision_reason, count(*) AS components, CAST(sum(nb) AS BIGINT) AS records FROM (SELECT count(*) AS nb, CASE WHEN bool_and(outcome = 'EXACT') THEN 'NONE_ALL_EXACT' ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN bool_or(outcome = 'STRICT_SUBSET') THEN 'FRAGMENTED_MULTI_AMOUNT_GROUP' END, CASE WHEN bool_or(outcome = 'STRICT_SUPERSET') THEN 'MERGED_FOREIGN_RECORDS' END, CASE WHEN bool_or(outcome = 'OVERLAP') THEN 'PARTIAL_CELL_COLLISION' END, CASE WHEN bool_or(outcome = 'DISJOINT') THEN 'WRONG_CELL' END], lambda x: x IS NOT NULL), '+'), ''), 'MIXED') END AS reason FROM oc WHERE len(predicted) > 0 GROUP BY currency, account, value_date, minor) GROUP BY reason"),
        "exact_set_score": _with(_RECORDS, select=f"SELECT stratum, n, exact, emitted, emitted_exact, round(exact::DOUBLE / n, 9) AS match_rate, round(CASE WHEN emitted > 0 THEN emitted_exact::DOUBLE / emitted ELSE 0 END, 9) AS precision, round({_wilson('emitted_exact', 'emitted')}, 9) AS wilson_lb FROM (SELECT CASE WHEN GROUPING(st) = 1 THEN 'ALL' ELSE st END AS stratum, count(*) AS n, count(*) FILTER (hit) AS exact, count(*) FILTER (o) AS emitted, count(*) FILTER (hit AND o) AS emitted_exact FROM (SELECT CASE WHEN len(target) = 0 THEN 'true-unmatched' WHEN len(target) = 1 THEN 'single-A' ELSE 'multi-A' END AS st, predicted = target AS hit, len(predicted) > 0 AS o FROM oc) GROUP BY GROUPING SETS ((), (st)))"),
        "field_profile": _with(_RECORDS, select=f"SELECT side, field, round(sum(c) FILTER (v NOT IN ('', '0'))::DOUBLE / sum(c), 9) AS non_null_rate, count(*) AS distinct_values, round(max(c)::DOUBLE / sum(c), 9) AS modal_share FROM (SELECT side, field, v, count(*) AS c FROM ({_FIELDS}) GROUP BY ALL) GROUP BY side, field"),
        "blocking_recall": _with(_RECORDS, _O2O, select=_BLOCKS),
        "cardinality_histogram": _with(_RECORDS, select="SELECT na AS n_a, nb AS n_b, count(*) AS groups FROM shape GROUP BY ALL ORDER BY groups DESC, n_a, n_b LIMIT 10"),
        "direction_crosstab": _with(_RECORDS, _O2O, select="SELECT b.direction AS b_direction, a.direction AS a_direction, count(*) AS pairs, count(*) FILTER (a.minor = b.minor) AS amount_equal, count(*) FILTER (a.value_date = b.value_date) AS date_equal, count(*) FILTER (a.minor = b.minor AND a.value_date = b.value_date) AS both_equal FROM ob b JOIN oa a USING (match_id) GROUP BY ALL"),
        "invariants": _with(_RECORDS, select="SELECT (SELECT count(DISTINCT currency) FROM recs) AS currencies, (SELECT count(DISTINCT account) FROM recs) AS accounts, (SELECT count(*) FROM ra WHERE currency || '_' || value_date || '_' || account || '_' || attributes = allocation) AS rebuilt, (SELECT count(*) FROM ra) AS n_a, (SELECT count(*) FROM rb WHERE target <> '' AND target IN (SELECT allocation FROM ra WHERE ra.match_id = rb.match_id)) AS linked, (SELECT count(*) FROM rb WHERE target <> '') AS targets"),
        "witness_levels": _with(_RECORDS, _WITNESS, select="SELECT currency, account, value_date, minor, witness, witness_minor FROM wit"),
        "identifiability": _with(_RECORDS, _WITNESS, select=f"SELECT witness, coverage, emitted, exact, round({_wilson('exact', 'emitted')}, 9) AS wilson_lb, round(coverage::DOUBLE / sum(coverage) OVER (), 9) AS share, round(CASE WHEN sum(emitted - exact) OVER () > 0 THEN (emitted - exact)::DOUBLE / sum(emitted - exact) OVER () ELSE 0 END, 9) AS error_share FROM (SELECT witness, count(*) AS coverage, count(*) FILTER (len(o.predicted) > 0) AS emitted, count(*) FILTER (outcome = 'EXACT') AS exact FROM oc o JOIN wit w USING (currency, account, value_date, minor) GROUP BY witness)"),
        "amount_window_frequency": _with(_RECORDS, select="SELECT a.currency, a.account, a.value_date, a.minor, count(*) AS amount_window_freq FROM cels a JOIN cels b ON a.minor = b.minor AND abs(date_diff('day', CAST(a.value_date AS DATE), CAST(b.value_date AS DATE))) <= 3 GROUP BY ALL"),
        "sibling_tokens": _with(_RECORDS, _WITNESS, select="SELECT c.side, c.currency, c.account, c.value_date, c.minor, count(DISTINCT p.rec_id) AS n FROM (SELECT DISTINCT side, currency, account, value_date, minor, unnest(tk) AS token FROM rt) c JOIN (SELECT side, currency, account, value_date, minor, rec_id, unnest(tk) AS token FROM rt) p ON c.side = p.side AND c.currency = p.currency AND c.account = p.account AND c.value_date = p.value_date AND c.token = p.token AND c.minor <> p.minor GROUP BY ALL"),
        "coverage_frontier": _with(_RECORDS, _FRONT, select="SELECT * FROM fr"),
        "frontier_best": _with(_RECORDS, _FRONT, select="SELECT * FROM fr WHERE lb >= 0.9 ORDER BY n DESC LIMIT 1"),
        "frontier_first_error": _with(_RECORDS, _FRONT, select="SELECT n, coverage, exact, lb, threshold FROM (SELECT *, lag(exact, 1, 0) OVER (ORDER BY n) AS before FROM fr) WHERE exact = before AND n > 1 ORDER BY n LIMIT 1"),
        "frontier_buckets": _with(_RECORDS, _FRONT, select="SELECT CAST(floor(coverage * 100 / 5) AS INTEGER) AS bucket, min(n) AS n, min_by(exact, n) AS exact, min_by(lb, n) AS lb FROM fr WHERE floor(coverage * 100 / 5) > 0 GROUP BY 1"),
        "adapter_signed_amount": "SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE -1 END * CAST(round(value * 100) AS BIGINT) AS cents, 'T' || lpad(CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR), 4, '0') AS line_id FROM events",
        "transpositions": f"SELECT o_orderkey, len(list_filter(range(1, len(da) + 1), lambda i: da[i] <> db[i])) <= 2 AND list_sort(da) = list_sort(db) AS swapped FROM (SELECT o_orderkey, {_DIGITS.format(t='a')} AS da, {_DIGITS.format(t='b')} AS db FROM (SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS a, substr(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 2, 1) || substr(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 1, 1) || substr(CAST(CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey % 2 AS VARCHAR), 3) AS b FROM orders))",
        "target_lists": "SELECT k, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(trim(raw), '^\\[(.*)\\]$', '\\1'), ','), lambda x: x <> ''))), '|') AS target FROM (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || c_name || ' ' ELSE '[' || c_name || ',' || c_mktsegment || ',,' || c_name || ']' END AS raw FROM customer)",
        "regression_gate": _with(
            *_MATCHES, _BREAKS,
            select="SELECT metric, value, baseline FROM (SELECT 'auto_match_rate' AS metric, rate AS value, 0.958734772::DOUBLE AS baseline FROM (" + _AMR + ") UNION ALL SELECT 'pair_f1', f1, 0.978635262 FROM ("
            + _PRF.format(by="", inner=_PAIR_COUNTS) + ") UNION ALL SELECT 'break_f1', f1, 0.833677491 FROM (" + _PRF.format(by="category,", inner=_BREAK_COUNTS) + ") WHERE category = 'ALL') WHERE value < baseline - 0.01",
        ),
    }
