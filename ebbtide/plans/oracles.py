"""DuckDB twins of the registered queries, for the correctness check only."""

from __future__ import annotations

from itertools import combinations

from ebbtide.fixtures import CUSTOMERS_SQL
from ebbtide.functions.features import ENGINEERED_COLUMNS
from ebbtide.schema import (
    BOX_COLUMNS, GAUGE_COLORS, HISTOGRAM_COLUMNS, NOMINAL_COLUMNS,
    NOMINAL_COLUMNS_DROP_FIRST, NUMERIC_COLUMNS, ORDINAL_CODES, ORDINAL_LEVELS, OUTLIER_COLUMNS,
    RAW_SCHEMA, REQUEST_FIELDS, RISK_DESCRIPTIONS, RISK_LEVELS, RISK_RECOMMENDATIONS,
    SEGMENT_ACTIONS, SENTINELS, VALUE_COUNT_COLUMNS, numeric_fields, string_fields,
)

COLUMNS = RAW_SCHEMA.names
NUMBERS = numeric_fields(RAW_SCHEMA)
TEXTS = string_fields(RAW_SCHEMA)

GIVEN = """, given AS (
  SELECT CustomerID, Churn AS y_true, s AS y_score,
    CASE WHEN CustomerID % 97 <> 0 THEN s END AS p,
    CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS y_pred, CASE WHEN s >= 0.4 THEN 1 ELSE 0 END AS v1,
    CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS v2,
    CASE WHEN CustomerID % 7 = 0 OR s >= 0.6 THEN 1 ELSE 0 END AS v3
  FROM (SELECT *, cast(least(Recency, 700) + (CustomerID * 37) % 301 AS DOUBLE) / 1000 AS s
        FROM customers))
"""

CURVE = GIVEN + """, g AS (
  SELECT p AS score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true <> 1) AS neg
  FROM given WHERE p IS NOT NULL GROUP BY p),
w AS (
  SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER () AS ap,
    sum(neg) OVER () AS an, lead(pos) OVER o AS npos, lead(neg) OVER o AS nneg,
    row_number() OVER o AS rn
  FROM g WINDOW o AS (ORDER BY score DESC))
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _customers(select: str, more: str = "") -> str:
    return CUSTOMERS_SQL + more + select


def _each(columns: list[str], select) -> str:
    return " UNION ALL ".join(select(c) for c in columns)


def _bands(value: str, edges: list, labels: list[str], missing: str) -> str:
    whens = " ".join(f"WHEN {value} < {e} THEN {_text(x)}" for e, x in zip(edges, labels))
    return f"CASE WHEN {value} IS NULL THEN {missing} {whens} ELSE {_text(labels[-1])} END"


def _risk(labels: list[str], missing: str = "NULL") -> str:
    return _bands("p", [0.2, 0.4, 0.6], labels, missing)


def _repaired(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' WHEN {c} = 'Inconn' THEN 'Inconnu' ELSE {c} END"


def _coded(c: str) -> str:
    if c not in SENTINELS:
        return c
    codes = ", ".join(map(str, SENTINELS[c]))
    return f"CASE WHEN {c} NOT IN ({codes}) THEN {c} END"


def _ordinal(c: str) -> str:
    whens = " ".join(f"WHEN {_text(x)} THEN {i}" for i, x in enumerate(ORDINAL_LEVELS[c]))
    return f"CASE {_repaired(c)} {whens} ELSE {len(ORDINAL_LEVELS[c])} END"


IP_SQL = """CASE WHEN LastLoginIP IS NULL THEN 'Unknown'
  WHEN LastLoginIP LIKE '10.%' OR LastLoginIP LIKE '172.16.%' OR LastLoginIP LIKE '192.168.%'
    THEN 'Class_A'
  WHEN regexp_full_match(split_part(LastLoginIP, '.', 1), '[0-9]+')
    AND try_cast(split_part(LastLoginIP, '.', 1) AS INTEGER) BETWEEN 1 AND 126 THEN 'Class_B'
  ELSE 'Class_C' END"""

ENGINEERED = {
    "AvgValuePerTransaction": "MonetaryAvg / nullif(AvgQuantityPerTransaction, 0)",
    "MonetaryCV": "MonetaryStd / (abs(MonetaryAvg) + 1e-6)",
    "ReturnRatioSquared": "ReturnRatio * ReturnRatio",
    "BasketDepth": "AvgLinesPerInvoice / nullif(AvgQuantityPerTransaction, 0)",
    "CancellationRate": "CancelledTransactions / (TotalTransactions + 1)",
}


def _processed() -> str:
    numbers = {c: _coded(c) for c in NUMERIC_COLUMNS}
    numbers.update({c: ENGINEERED[c] for c in ENGINEERED_COLUMNS})
    numbers.update({c: _ordinal(c) for c in ORDINAL_LEVELS})
    hot = ", ".join(f"'{c}_' || ({_repaired(c)})" for c in NOMINAL_COLUMNS)
    values = ", ".join(f"cast({e} AS DOUBLE) AS {c}" for c, e in numbers.items())
    filled = ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM u)) AS {c}" for c in numbers)
    return _customers(
        f"SELECT CustomerID, Churn, hot, {filled} FROM u",
        f", u AS (SELECT CustomerID, Churn, {values}, concat_ws(',', {hot}, 'IPClass_' || ({IP_SQL}), "
        "'Country_' || Country) AS hot FROM customers)")


SPLIT = """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY Churn ORDER BY md5(CustomerID || ':42')) AS r,
    count(*) OVER (PARTITION BY Churn) AS nc FROM customers),
split AS (
  SELECT *, CASE WHEN r <= floor(0.2 * nc + 0.5) THEN 'test' ELSE 'train' END AS split FROM ranked)
"""


def _missing() -> str:
    rows = _each(COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
                                    "count(*) AS total FROM customers")
    return _customers(f'SELECT "column", missing, round(missing / total * 100, 2) AS percent '
                      f"FROM ({rows}) WHERE missing > 0")


def _describe() -> str:
    def one(c: str) -> str:
        v = f"cast({c} AS DOUBLE)"
        q = ", ".join(f"round(quantile_cont({v}, {p / 100}), 4) AS q{p}" for p in (25, 50, 75))
        return (f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({v}), 4) AS mean, "
                f"round(stddev_samp({v}), 4) AS std, round(min({v}), 4) AS min, {q}, "
                f"round(max({v}), 4) AS max FROM customers")
    return _customers(_each(NUMBERS, one))


FENCES = """q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3
  FROM customers)"""


def _outliers() -> str:
    def one(c: str) -> str:
        return (f"SELECT '{c}' AS \"column\", round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence, "
                f"(SELECT count(*) FROM customers WHERE {c} < lo OR {c} > hi) AS outliers "
                f"FROM (SELECT {FENCES.format(v=c)})")
    return _customers(_each(OUTLIER_COLUMNS, one))


def _box() -> str:
    def one(c: str) -> str:
        v = _coded(c)
        return (f"SELECT '{c}' AS \"column\", "
                f"(SELECT min(cast({v} AS DOUBLE)) FROM customers WHERE ({v}) BETWEEN lo AND hi) AS whisker_low, "
                f"q1, q2 AS median, q3, "
                f"(SELECT max(cast({v} AS DOUBLE)) FROM customers WHERE ({v}) BETWEEN lo AND hi) AS whisker_high, "
                f"(SELECT count(*) FROM customers WHERE ({v}) < lo OR ({v}) > hi) AS outliers "
                f"FROM (SELECT q1, q2, q3, {FENCES.format(v=v)})")
    return _customers(_each(BOX_COLUMNS, one))


def _histogram() -> str:
    def one(c: str) -> str:
        v = f"cast({c} AS DOUBLE)"
        return (f"SELECT '{c}' AS \"column\", b.bin, round(lo + (hi - lo) / 50 * b.bin, 6) AS bin_low, "
                f"round(lo + (hi - lo) / 50 * (b.bin + 1), 6) AS bin_high, count(v) AS n "
                f"FROM (SELECT min({v}) AS lo, max({v}) AS hi FROM customers) m "
                f"CROSS JOIN (SELECT unnest(range(50))::INTEGER AS bin) b LEFT JOIN "
                f"(SELECT {v} AS v, least(floor(({v} - l) / (h - l) * 50), 49)::INTEGER AS bin FROM customers, "
                f"(SELECT min({v}) AS l, max({v}) AS h FROM customers) WHERE {c} IS NOT NULL) x "
                f"ON x.bin = b.bin GROUP BY b.bin, lo, hi")
    return _customers(_each(HISTOGRAM_COLUMNS, one))


def _pairs() -> str:
    cells = ", ".join(
        f"{{'x': '{a}', 'y': '{b}', 'x_pos': {NUMBERS.index(a)}, 'y_pos': {NUMBERS.index(b)}, "
        f"'c': corr({a}, {b})}}" for a, b in combinations(NUMBERS, 2))
    return (f", pairs AS (SELECT e.x, e.y, e.x_pos, e.y_pos, CASE WHEN NOT isnan(e.c) THEN e.c END AS c "
            f"FROM (SELECT unnest([{cells}]) AS e FROM customers))")


def _one_hot(columns: list[str], value, drop_first: bool = False) -> str:
    def one(c: str) -> str:
        v = value(c)
        first = f"AND level > (SELECT min({v}) FROM customers)" if drop_first else ""
        return (f"SELECT CustomerID, '{c}_' || level AS feature, "
                f"CASE WHEN ({v}) = level THEN 1 ELSE 0 END AS value FROM customers CROSS JOIN "
                f"(SELECT DISTINCT {v} AS level FROM customers) l WHERE level IS NOT NULL {first}")
    return _customers(_each(columns, one))


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM customers WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


def _medians(clean: bool) -> str:
    values = ", ".join(f"cast({_coded(c) if clean else c} AS DOUBLE) AS {c}" for c in NUMERIC_COLUMNS)
    filled = ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM u)) AS {c}" for c in NUMERIC_COLUMNS)
    return (f", u AS (SELECT CustomerID, {values} FROM customers), "
            f"f AS (SELECT CustomerID, {filled} FROM u)")


def _scaled() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC_COLUMNS)
    cells = ", ".join(
        f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}"
        for c in NUMERIC_COLUMNS)
    return _customers(f"SELECT CustomerID, {cells} FROM f, (SELECT {stats} FROM f)", _medians(False))


def _rules(skip_ratio: bool) -> str:
    rules = []
    for f in REQUEST_FIELDS:
        if skip_ratio and f.name == "ReturnRatio":
            continue
        v = f.name
        rules.append(f"CASE WHEN {v} IS NULL THEN '{v}:required' END")
        if f.integral:
            rules.append(f"CASE WHEN {v} <> floor({v}) THEN '{v}:integer' END")
        if f.low is not None:
            rules.append(f"CASE WHEN {v} < {f.low} THEN '{v}>={f.low}' END")
        if f.high is not None:
            rules.append(f"CASE WHEN {v} > {f.high} THEN '{v}<={f.high}' END")
    return f"concat_ws(',', {', '.join(rules)})"


def _violations() -> str:
    return _customers(
        "SELECT CustomerID, violations, 0.05::DOUBLE AS ReturnRatio, violations = '' AS valid FROM "
        f"(SELECT CustomerID, {_rules(True)} AS violations FROM customers)")


# A row scores only if every number it brings, after cleaning, is there.
COMPLETE = " AND ".join(f"({_coded(c)}) IS NOT NULL" for c in NUMERIC_COLUMNS) + "".join(
    f" AND ({e}) IS NOT NULL" for e in ENGINEERED.values())


REPORT = GIVEN + """, c AS (
  SELECT cast(count(*) FILTER (y_true = 0 AND y_pred = 0) AS DOUBLE) AS a,
    cast(count(*) FILTER (y_true = 0 AND y_pred = 1) AS DOUBLE) AS b,
    cast(count(*) FILTER (y_true = 1 AND y_pred = 0) AS DOUBLE) AS c,
    cast(count(*) FILTER (y_true = 1 AND y_pred = 1) AS DOUBLE) AS d FROM given),
s AS (SELECT *, coalesce(a / nullif(a + c, 0), 0) AS p0, coalesce(d / nullif(b + d, 0), 0) AS p1,
  coalesce(a / nullif(a + b, 0), 0) AS r0, coalesce(d / nullif(c + d, 0), 0) AS r1,
  a + b AS s0, c + d AS s1 FROM c),
t AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
  coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM s)
"""

REPORT_ROWS = """
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1,
  s0::BIGINT AS support FROM t
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1::BIGINT FROM t
UNION ALL SELECT 'accuracy', NULL, NULL, round((a + d) / (s0 + s1), 6), (s0 + s1)::BIGINT FROM t
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6),
  round((f0 + f1) / 2, 6), (s0 + s1)::BIGINT FROM t
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6),
  round((r0 * s0 + r1 * s1) / (s0 + s1), 6), round((f0 * s0 + f1 * s1) / (s0 + s1), 6),
  (s0 + s1)::BIGINT FROM t
"""

LEVEL = _risk(RISK_LEVELS, "'Unknown'")


def _dtypes() -> str:
    # The declared types of the fixture text, under the names Spark gives them.
    types = " UNION ALL ".join(f"SELECT max(typeof({c})) AS t, count({c}) AS n FROM customers" for c in COLUMNS)
    return _customers(
        "SELECT CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(t) END AS dtype, "
        f"count(*) AS n_columns, sum(n)::BIGINT AS n_filled FROM ({types}) GROUP BY t")


ORACLES: dict[str, str] = {
    "customers": _customers("SELECT * FROM customers"),
    "scan_customers": _customers("SELECT * FROM customers"),
    "roundtrip_processed": _processed(),
    "train_test_read": _customers(
        "SELECT CustomerID, Churn, MonetaryTotal FROM split WHERE split = 'test'", SPLIT),
    "profile_shape": _customers(f"SELECT count(*) AS n_rows, {len(COLUMNS)} AS n_columns FROM customers"),
    "profile_dtypes": _dtypes(),
    "missing_report": _missing(),
    "remaining_nulls": _customers(
        "SELECT " + " + ".join(f"count(*) - count({c})" for c in COLUMNS) + " AS missing FROM customers"),
    "describe_numeric": _describe(),
    "class_distribution": _customers(
        "SELECT Churn, count(*) AS n, count(*) / (SELECT count(*) FROM customers) AS share "
        "FROM customers GROUP BY Churn"),
    "class_distribution_by_split": _customers(
        "SELECT split, Churn, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share "
        "FROM split GROUP BY split, Churn", SPLIT),
    "iqr_outliers": _outliers(),
    "histogram": _histogram(),
    "value_counts": _customers(_each(
        VALUE_COUNT_COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", {c} AS level, count(*) AS n "
                                       f"FROM customers WHERE {c} IS NOT NULL GROUP BY {c}")),
    "correlation_matrix": _customers(
        "SELECT x, y, x_pos, y_pos, round(c, 6) AS corr FROM pairs", _pairs()),
    "churn_correlation": _customers(
        "SELECT CASE WHEN x = 'Churn' THEN y ELSE x END AS \"column\", round(c, 6) AS corr FROM pairs "
        "WHERE x = 'Churn' OR y = 'Churn' UNION ALL SELECT 'Churn', 1.0", _pairs()),
    "multicollinear": _customers(
        "SELECT DISTINCT y AS \"column\", y_pos AS position FROM pairs WHERE abs(c) > 0.8 AND y <> 'Churn'",
        _pairs()),
    "duplicate_rows": _customers(
        "SELECT (SELECT count(*) FROM customers) - (SELECT count(*) FROM "
        "(SELECT DISTINCT * EXCLUDE (CustomerID) FROM customers)) AS duplicates"),
    "duplicate_rows_attributes": _customers(
        "SELECT (SELECT count(*) FROM customers) - (SELECT count(*) FROM "
        f"(SELECT DISTINCT {', '.join(ORDINAL_LEVELS)}, Gender FROM customers)) AS duplicates"),
    "box_stats": _box(),
    "preview": _customers("SELECT * FROM customers ORDER BY CustomerID LIMIT 5"),
    "drop_columns": _customers(
        "SELECT * EXCLUDE (RegistrationDate, NewsletterSubscribed, LastLoginIP) FROM customers"),
    "engineer_features": _customers(
        "SELECT CustomerID, " + ", ".join(f"{e} AS {c}" for c, e in ENGINEERED.items()) + " FROM customers"),
    "sentinel_to_null": _customers(
        "SELECT CustomerID, " + ", ".join(f"{_coded(c)} AS {c}" for c in SENTINELS) + " FROM customers"),
    "ordinal_encode": _customers(
        "SELECT CustomerID, " + ", ".join(f"{_ordinal(c)} AS {c}" for c in ORDINAL_LEVELS) + " FROM customers"),
    "ordinal_encode_mapped": _customers("SELECT CustomerID, " + ", ".join(
        f"CASE {c} " + " ".join(f"WHEN {_text(x)} THEN {i}" for x, i in codes.items())
        + f" ELSE 0 END AS {c}_encoded" for c, codes in ORDINAL_CODES.items()) + " FROM customers"),
    "one_hot": _one_hot(NOMINAL_COLUMNS, _repaired),
    "one_hot_drop_first": _one_hot(
        NOMINAL_COLUMNS_DROP_FIRST, lambda c: f"coalesce({c}, {_mode(c)})", drop_first=True),
    "one_hot_residual": _one_hot(["Country"], lambda c: c).replace(
        "(Country) = level", "(Country) IS NOT DISTINCT FROM level"),
    "ip_class": _customers(
        "SELECT CustomerID, i AS IPClass, " + ", ".join(
            f"CASE WHEN i = 'Class_{x}' THEN 1 ELSE 0 END AS IPClass_Class_{x}" for x in "ABC")
        + f" FROM (SELECT CustomerID, {IP_SQL} AS i FROM customers)"),
    "risk_level": _customers(f"SELECT CustomerID, {LEVEL} AS level FROM given", GIVEN),
    "risk_description": _customers(
        f"SELECT CustomerID, {_risk(RISK_DESCRIPTIONS['service'])} AS service, "
        f"{_risk(RISK_DESCRIPTIONS['api'])} AS api FROM given", GIVEN),
    "risk_recommendation": _customers(
        f"SELECT CustomerID, {_risk(RISK_RECOMMENDATIONS['service'])} AS service, "
        f"{_risk(RISK_RECOMMENDATIONS['api'])} AS api FROM given", GIVEN),
    "segment_action": _customers(
        "SELECT CustomerID, segment, CASE segment "
        + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in SEGMENT_ACTIONS.items())
        + " END AS action FROM (SELECT CustomerID, CASE WHEN Churn = 1 THEN "
          "'Clients à risque (Churn=1)' ELSE RFMSegment END AS segment FROM customers)"),
    "gauge_band": _customers(
        f"SELECT CustomerID, {_bands('(p * 100)', [20, 40, 60, 80], GAUGE_COLORS, 'NULL')} AS band FROM given",
        GIVEN),
    "align_features": _customers(
        "SELECT CustomerID, Recency, Frequency, 0.0::DOUBLE AS NotInTheTable, MonetaryTotal, "
        "0.0::DOUBLE AS Gender_M FROM customers"),
    "validate_requests": _violations(),
    "predictions_agree": _customers(
        "SELECT CustomerID, coalesce(CASE WHEN CustomerID % 89 <> 0 THEN y_pred END = v3, false) "
        "AS predictions_agree FROM given", GIVEN),
    "impute_median": _customers(
        "SELECT CustomerID, " + ", ".join(NUMERIC_COLUMNS) + " FROM f", _medians(True)),
    "impute_mode": _customers(
        "SELECT CustomerID, " + ", ".join(f"coalesce({c}, {_mode(c)}) AS {c}" for c in TEXTS) + " FROM customers"),
    "standard_scale": _scaled(),
    "stratified_split": _customers("SELECT CustomerID, Churn, split FROM split", SPLIT),
    "stratified_folds": _customers(
        "SELECT CustomerID, Churn, (ntile(5) OVER (PARTITION BY Churn ORDER BY md5(CustomerID || ':42')) "
        "- 1)::INTEGER AS fold FROM customers"),
    "sample_n": _customers(
        "SELECT CustomerID, Churn FROM customers ORDER BY md5(CustomerID || ':42') LIMIT 3000"),
    "smote_counts": _customers(
        "SELECT Churn, count(*) AS before, max(count(*)) OVER () AS after FROM split "
        "WHERE split = 'train' GROUP BY Churn", SPLIT),
    "nearest_minority": _customers(
        "SELECT a AS CustomerID, round(max(CASE WHEN rn = 1 THEN dist END), 6) AS nearest, "
        "round(max(CASE WHEN rn = 5 THEN dist END), 6) AS fifth FROM ("
        "SELECT p.id AS a, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS dist, row_number() OVER "
        "(PARTITION BY p.id ORDER BY (p.x - q.x) ** 2 + (p.y - q.y) ** 2, q.id) AS rn "
        "FROM pts p JOIN pts q ON p.id <> q.id) GROUP BY a",
        ", pts AS (SELECT min(CustomerID) AS id, cast(Recency AS DOUBLE) AS x, "
        "cast(UniqueProducts AS DOUBLE) AS y FROM customers WHERE Churn = 1 GROUP BY x, y)"),
    "wide_levels": _customers(
        "SELECT CustomerID, " + ", ".join(
            f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END AS {c}_position"
            for c in ("LastLoginIP", "RegistrationDate")) + " FROM customers"),
    "export_predictions": _customers(
        f"SELECT CustomerID, y_pred AS churn_prediction, y_score AS churn_probability, {LEVEL} AS churn_risk_level FROM given", GIVEN),
    "malformed_cells": _customers(
        f"SELECT CustomerID, ({COMPLETE}) AND CustomerID % 11 <> 0 AND CustomerID % 13 <> 0 AND CustomerID % 17 <> 0 "
        "AND CustomerID % 19 <> 0 AS success, concat_ws('; ', "
        f"CASE WHEN CustomerID % 17 = 0 THEN 'too many cells: {len(COLUMNS) + 1} of {len(COLUMNS)}' "
        f"WHEN CustomerID % 19 = 0 THEN 'too few cells: {len(COLUMNS) - 3} of {len(COLUMNS)}' END, "
        + ", ".join(f"CASE WHEN CustomerID % {n} = 0 THEN '{c}: {text}' END" for c, n, text in sorted(
            [("Age", 11, "not a number (abc)"), ("UniqueProducts", 13, "not a whole number (12.5)")], key=lambda x: COLUMNS.index(x[0])))
        + ") AS problems FROM customers"),
    "silhouettes": _customers(
        "SELECT assignment, round(avg(CASE WHEN own_n > 1 AND b IS NOT NULL AND greatest(a, b) > 0 "
        "THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, count(*) AS n FROM ("
        "SELECT assignment, id, max(own_n) AS own_n, max(CASE WHEN same THEN total / greatest(n - 1, 1) END) AS a, "
        "min(CASE WHEN NOT same THEN total / n END) AS b FROM ("
        "SELECT assignment, id, c = label AS same, max(own_n) AS own_n, sum(dist) AS total, count(*) AS n FROM ("
        "SELECT p.assignment, p.id, p.label, q.label AS c, count(*) FILTER (q.label = p.label) "
        "OVER (PARTITION BY p.assignment, p.id) AS own_n, "
        "sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS dist "
        "FROM pts p JOIN pts q ON p.assignment = q.assignment) GROUP BY assignment, id, label, c) "
        "GROUP BY assignment, id) GROUP BY assignment",
        ", raw AS (SELECT CustomerID AS id, cast(Recency AS DOUBLE) AS x, cast(UniqueProducts AS DOUBLE) AS y, "
        "cast(Frequency AS DOUBLE) AS z, least(Recency // 150, 4) AS l1, CASE WHEN Frequency > 5 THEN 1 ELSE 0 END AS l2, "
        "CustomerID % 3 AS l3 FROM customers), pts AS ("
        + " UNION ALL ".join(f"SELECT '{a}' AS assignment, id, x, y, z, {c} AS label FROM raw"
                             for a, c in (("by_recency", "l1"), ("by_frequency", "l2"), ("by_id", "l3"))) + ")"),
    "model_roundtrip": _customers("SELECT count(*) AS n, 0 AS mismatches FROM customers"),
    "score_batch_counts": _customers(
        f"SELECT count(*) AS total, count(*) FILTER (ok) AS success_count, "
        f"count(*) FILTER (NOT ok) AS error_count FROM (SELECT {COMPLETE} AS ok FROM customers)"),
    "stream_counts": _customers(
        "SELECT CustomerID, CASE WHEN violations <> '' THEN 'rejected' WHEN ok THEN 'scored' "
        f"ELSE 'failed' END AS landed FROM (SELECT CustomerID, {COMPLETE} AS ok, {_rules(False)} "
        "AS violations FROM customers)"),
    "vote": _customers(
        "SELECT CustomerID, CASE WHEN v1 + v2 + v3 >= 2 THEN 1 ELSE 0 END AS vote FROM given", GIVEN),
    "confusion_matrix": _customers(
        "SELECT t.v AS y_true, p.v AS y_pred, count(given.y_true) AS n FROM (VALUES (0), (1)) t(v) "
        "CROSS JOIN (VALUES (0), (1)) p(v) LEFT JOIN given ON given.y_true = t.v AND given.y_pred = p.v "
        "GROUP BY t.v, p.v", GIVEN),
    "classification_report": _customers(REPORT_ROWS, REPORT),
    "roc_curve": _customers(
        "SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL "
        "SELECT round(score, 6), round(fp / nullif(an, 0), 6), round(tp / nullif(ap, 0), 6) FROM w "
        "WHERE rn = 1 OR npos IS NULL OR pos <> npos OR neg <> nneg", CURVE),
    "roc_auc": _customers(
        "SELECT round(sum(neg * (2.0 * tp - pos)) / nullif(2.0 * max(ap) * max(an), 0), 6)::DOUBLE AS auc FROM w",
        CURVE),
    "pr_curve": _customers(
        "SELECT NULL::DOUBLE AS threshold, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS recall UNION ALL "
        "SELECT round(score, 6), round(tp / (tp + fp), 6), round(tp / ap, 6) FROM w", CURVE),
    "average_precision": _customers(
        "SELECT round(sum(pos * tp / (tp + fp)) / max(ap), 6) AS average_precision FROM w", CURVE),
    "batch_summary": _customers(
        "SELECT round(avg(y_pred), 6) AS churn_rate, round(avg(y_score), 6) AS avg_probability, "
        f"count(*) FILTER ({LEVEL} IN ('High', 'Critical')) AS high_risk FROM given", GIVEN),
    "indexed_batch": _customers(
        f"SELECT row_number() OVER (ORDER BY CustomerID) - 1 AS index, CustomerID, {LEVEL} "
        "AS churn_risk_level FROM given", GIVEN),
    "risk_distribution": _customers(
        f"SELECT {LEVEL} AS churn_risk_level, count(*) AS n FROM given GROUP BY 1", GIVEN),
}

