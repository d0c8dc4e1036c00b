"""Oracle SQL (DuckDB dialect) for the registered queries.

Each text inlines the fixture ledger as a ``gl`` CTE (only base tables are registered on
the DuckDB side) and restates the operator's logic in plain SQL, separately from the
Spark code, so the two implementations check each other.
"""
from __future__ import annotations

from .. import constants as K
from ..constants import (ACTION_BOTH, ACTION_NONE, ACTION_ONE, CROSS_FOOTING_SUMMARY,
                         DATE_PERIOD_NULLS, DATE_PERIOD_SUMMARY, ESCALATION_NOTE,
                         HASH_TOTAL_SUMMARY, HIGH_ITEMS, LABEL_HIGH, LABEL_MEDIUM, LABEL_MONITOR,
                         MAPPING_CODES, MAPPING_NAMES, MAPPING_OK, MEDIUM_ITEMS, NO_FLAGS_TEXT,
                         OVERRIDE_NOTE, POPULATION_TEXT, QUALITY_TEXT, QUEUE_TEXT, SKIP_HASH)
from ..functions.text import fill_sql
from ..operators.dates import CANDIDATES
from ..sources.sinks import EXPORT_BASE_COLUMNS

TIERS = ["Monitor", "Low", "Medium", "High"]

GL_DEBIT = """gl0 AS (
  SELECT
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
      CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)          AS journal_ref,
    CASE WHEN l_quantity = 1 AND l_linenumber = 7 THEN NULL
         ELSE CAST(l_shipdate AS DATE) END                                   AS date,
    CASE WHEN l_returnflag = 'R' THEN -1.0e0 ELSE 1.0e0 END *
    CASE WHEN l_linenumber = 7 AND l_quantity >= 40 THEN CAST(floor(l_extendedprice / 100) AS DOUBLE) * 100
         WHEN l_linenumber = 5 AND l_quantity = 45  THEN l_extendedprice * 5
         ELSE l_extendedprice END                                            AS amount,
    CASE WHEN l_linenumber = 2 AND l_quantity = 50 AND p_type = 'PROMO' THEN '6999'
         WHEN p_type = 'ECONOMY' THEN '50' WHEN p_type = 'LARGE' THEN '61'
         WHEN p_type = 'MEDIUM'  THEN '64' WHEN p_type = 'PROMO' THEN '66'
         WHEN p_type = 'SMALL'   THEN '40' ELSE '20' END ||
    CASE WHEN l_linenumber = 2 AND l_quantity = 50 AND p_type = 'PROMO' THEN ''
         ELSE lpad(replace(p_brand, 'Brand#', ''), 2, '0') END                AS account_code,
    p_type || ' / ' || p_brand                                               AS account_name,
    CASE WHEN l_tax = 0.08 AND l_linenumber = 6 THEN NULL
         WHEN l_quantity = 50 AND l_linenumber = 1 THEN s_name || ' #' || CAST(l_partkey AS VARCHAR)
         ELSE s_name END                                                     AS vendor,
    CASE WHEN l_discount = 0.10 AND l_linenumber <= 2 THEN ''
         WHEN l_discount = 0.10 AND l_linenumber = 3 THEN NULL
         ELSE p_name END                                                     AS description,
    CASE WHEN p_type IN ('SMALL', 'STANDARD') THEN 'C' ELSE 'D' END          AS side,
    CASE WHEN l_quantity > 45 THEN 'Non_Standard' ELSE 'standard' END        AS dr_cr_pattern
  FROM lineitem
  JOIN part     ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
),
gl AS (
  SELECT journal_ref, date, amount, account_code, account_name, vendor, description,
         CASE WHEN side = 'D' THEN abs(amount) ELSE 0.0 END AS debit_amount,
         CASE WHEN side = 'C' THEN abs(amount) ELSE 0.0 END AS credit_amount,
         dr_cr_pattern
  FROM gl0
)"""

CLEAN_DEBIT = """clean AS (
  SELECT journal_ref, date,
         CASE WHEN isnan(amount) THEN NULL ELSE amount END            AS amount,
         abs(CASE WHEN isnan(amount) THEN NULL ELSE amount END)       AS abs_amount,
         account_code, account_name, vendor, description,
         coalesce(CASE WHEN isnan(debit_amount) THEN NULL ELSE debit_amount END, 0.0)   AS debit_amount,
         coalesce(CASE WHEN isnan(credit_amount) THEN NULL ELSE credit_amount END, 0.0) AS credit_amount,
         dr_cr_pattern
  FROM gl
)"""

CLEAN_CODE = """clean AS (
  SELECT journal_ref, date,
         CASE WHEN isnan(amount) THEN NULL ELSE amount END            AS amount,
         abs(CASE WHEN isnan(amount) THEN NULL ELSE amount END)       AS abs_amount,
         account_code, account_name, vendor, description, dr_cr_pattern
  FROM gl
)"""

BASIS_DEBIT = "debit_amount"
BASIS_CODE = ("CASE WHEN regexp_full_match(account_code, '[567][0-9]{3}') "
              "THEN abs_amount ELSE 0.0 END")

WS = r"'^\s+|\s+$'"


def feature_ctes(basis: str = BASIS_DEBIT, period_end: str | None = "DATE '2001-10-31'") -> str:
    end = period_end or "(SELECT max(date) FROM clean)"
    return f"""f_acct AS (
  SELECT account_name, avg(abs_amount) AS m, stddev_pop(abs_amount) AS sd,
         min(abs_amount) AS mn, max(abs_amount) AS mx, count(abs_amount) AS n
  FROM clean WHERE account_name IS NOT NULL GROUP BY account_name
),
f_vcnt AS (SELECT coalesce(vendor, 'UNKNOWN') AS vk, count(*) AS c FROM clean GROUP BY 1),
f_mon AS (
  SELECT account_name, date_trunc('month', date) AS mth,
         coalesce(sum(CAST(abs_amount AS DECIMAL(28,10))), 0) AS s
  FROM clean WHERE account_name IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2
),
f_mon2 AS (SELECT account_name, mth, s, lag(s) OVER (PARTITION BY account_name ORDER BY mth) AS ps FROM f_mon),
f_pop AS (
  SELECT account_name, mth,
         CASE WHEN ps IS NULL THEN 0.0
              WHEN ps = 0 AND s = 0 THEN 0.0
              WHEN ps = 0 THEN NULL
              ELSE (CAST(s AS DOUBLE) / CAST(ps AS DOUBLE) - 1.0) * 100.0 END AS pop
  FROM f_mon2
),
f_basis AS (SELECT vendor, {basis} AS b FROM clean),
f_vtot AS (SELECT coalesce(sum(CAST(b AS DECIMAL(28,10))), 0) AS t FROM f_basis),
f_vdis AS (SELECT vendor, sum(CAST(b AS DECIMAL(28,10))) AS d FROM f_basis WHERE vendor IS NOT NULL GROUP BY vendor),
f_bounds AS (SELECT {end} AS pe, {end} - INTERVAL 9 DAY AS pcut),
feat1 AS (
  SELECT c.*,
    CASE WHEN c.account_name IS NULL THEN NULL
         WHEN a.n = 0 OR a.mn = a.mx OR a.sd = 0 THEN 0.0
         ELSE (c.abs_amount - a.m) / a.sd END                                  AS amount_zscore_by_account,
    CASE WHEN c.abs_amount % 100 = 0 THEN 1 ELSE 0 END                          AS is_round_number,
    CASE WHEN isodow(c.date) IN (6, 7) THEN 1 ELSE 0 END                        AS is_weekend_posting,
    CASE WHEN c.description IS NULL
           OR regexp_replace(c.description, {WS}, '', 'g') = ''
           OR lower(regexp_replace(c.description, {WS}, '', 'g')) = 'nan' THEN 1 ELSE 0 END
                                                                                AS missing_description,
    v.c                                                                         AS vendor_txn_count,
    CASE WHEN v.c < 3 THEN 1 ELSE 0 END                                         AS is_new_vendor,
    CASE WHEN (c.abs_amount >= 4750 AND c.abs_amount < 5000)
           OR (c.abs_amount >= 9500 AND c.abs_amount < 10000)
           OR (c.abs_amount >= 23750 AND c.abs_amount < 25000) THEN 1 ELSE 0 END AS is_near_approval_threshold,
    p.pop                                                                       AS period_over_period_pct,
    CASE WHEN (SELECT t FROM f_vtot) <= 0 THEN 0.0
         ELSE coalesce(CAST(d.d AS DOUBLE) / CAST((SELECT t FROM f_vtot) AS DOUBLE) * 100.0, 0.0) END
                                                                                AS vendor_concentration_pct,
    CASE WHEN c.date >= (SELECT pcut FROM f_bounds) AND c.date <= (SELECT pe FROM f_bounds)
         THEN 1 ELSE 0 END                                                      AS is_year_end_concentration,
    CASE WHEN lower(c.dr_cr_pattern) = 'non_standard' THEN 1 ELSE 0 END         AS is_non_standard_pattern
  FROM clean c
  LEFT JOIN f_acct a ON c.account_name = a.account_name
  LEFT JOIN f_vcnt v ON coalesce(c.vendor, 'UNKNOWN') = v.vk
  LEFT JOIN f_pop  p ON c.account_name = p.account_name AND date_trunc('month', c.date) = p.mth
  LEFT JOIN f_vdis d ON c.vendor = d.vendor
),
feat AS (
  SELECT *,
    missing_description + is_weekend_posting AS control_gap_score,
    is_round_number + is_weekend_posting + missing_description + is_new_vendor
      + is_near_approval_threshold AS fraud_flag_count,
    CASE WHEN is_round_number + is_weekend_posting + missing_description + is_new_vendor
      + is_near_approval_threshold >= 2 THEN 1 ELSE 0 END AS fraud_risk_flag
  FROM feat1
)"""


def rank(t: str) -> str:
    return f"(CASE {t} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(TIERS)) + " END)"


def up(t: str) -> str:
    return (f"(CASE {t} WHEN 'Monitor' THEN 'Low' WHEN 'Low' THEN 'Medium' "
            f"WHEN 'Medium' THEN 'High' WHEN 'High' THEN 'High' ELSE {t} END)")


def down(t: str) -> str:
    return f"(CASE {t} WHEN 'High' THEN 'Medium' WHEN 'Medium' THEN 'Low' ELSE 'Monitor' END)"


PERF, TXN = 40000.0, 64000.0

SCORE_CTES = f"""sc0 AS (
  SELECT *,
    round(CAST(0.05 AS DOUBLE) - CAST(0.08 AS DOUBLE) * CAST(fraud_flag_count AS DOUBLE)
          - CAST(0.03 AS DOUBLE) * abs(coalesce(amount_zscore_by_account, 0.0)), 6) AS anomaly_score,
    round(least(CAST(1.0 AS DOUBLE), CAST(0.2 AS DOUBLE) * CAST(fraud_flag_count AS DOUBLE)
          + CAST(0.15 AS DOUBLE) * abs(coalesce(amount_zscore_by_account, 0.0))), 6) AS fraud_probability
  FROM feat
),
sc1 AS (
  SELECT *, CASE WHEN anomaly_score <= -0.15 THEN 'High' WHEN anomaly_score <= -0.05 THEN 'Medium'
                 WHEN anomaly_score IS NOT NULL THEN 'Low' END AS raw_tier
  FROM sc0
),
sc2 AS (
  SELECT *,
    CASE WHEN abs_amount >= {TXN} THEN raw_tier
         WHEN abs_amount >= {PERF} THEN {down('raw_tier')}
         ELSE 'Monitor' END AS t_mat,
    {up('raw_tier')} AS up_raw
  FROM sc1
),
sc3 AS (
  SELECT *, coalesce(fraud_risk_flag = 1 AND {rank('up_raw')} > {rank('t_mat')}, false) AS ov FROM sc2
),
sc4 AS (
  SELECT *,
    CASE WHEN ov THEN up_raw ELSE t_mat END AS t_ov,
    CASE WHEN ov THEN 1 ELSE 0 END AS is_qualitative_override,
    CASE WHEN ov THEN {fill_sql(OVERRIDE_NOTE, escalated="up_raw", count="fraud_flag_count",
                                 raw="raw_tier", current="t_mat")} ELSE '' END
      AS qualitative_override_note
  FROM sc3
),
sc5 AS (SELECT *, {up('t_ov')} AS up_cur FROM sc4),
sc6 AS (
  SELECT *, coalesce(coalesce(fraud_probability, 0.0) >= 0.5 AND is_qualitative_override = 0
                     AND {rank('up_cur')} > {rank('t_ov')}, false) AS es
  FROM sc5
),
scored AS (
  SELECT *,
    CASE WHEN es THEN up_cur ELSE t_ov END AS final_tier,
    CASE WHEN es THEN 1 ELSE 0 END AS is_supervised_escalation,
    CASE WHEN es THEN {fill_sql(ESCALATION_NOTE, escalated="up_cur", threshold="'0.50'",
                                 score="format('{:.2f}', coalesce(fraud_probability, 0.0))")}
         ELSE '' END AS supervised_escalation_note,
    CASE WHEN (CASE WHEN es THEN up_cur ELSE t_ov END) = 'High' THEN '{LABEL_HIGH}'
         WHEN (CASE WHEN es THEN up_cur ELSE t_ov END) = 'Medium' THEN '{LABEL_MEDIUM}'
         ELSE '{LABEL_MONITOR}' END AS pcaob_label,
    CASE WHEN coalesce(abs_amount, 0) >= {TXN} THEN 'Exceeds Transaction Materiality'
         WHEN coalesce(abs_amount, 0) >= {PERF} THEN 'Below Transaction Materiality'
         ELSE 'Below Performance Materiality' END AS materiality_annotation,
    coalesce(nullif(concat_ws('; ',
        CASE WHEN abs(amount_zscore_by_account) >= 2 THEN 'Unusual amount for account' END,
        CASE WHEN is_round_number = 1 THEN 'Round number amount' END,
        CASE WHEN is_weekend_posting = 1 THEN 'Weekend posting' END,
        CASE WHEN missing_description = 1 THEN 'Missing description' END,
        CASE WHEN is_new_vendor = 1 THEN 'New vendor' END,
        CASE WHEN is_near_approval_threshold = 1 THEN 'Near approval threshold' END), ''),
      '{NO_FLAGS_TEXT}') AS active_flags,
    CASE WHEN (CASE WHEN es THEN up_cur ELSE t_ov END) IN ('High', 'Medium') THEN 'Flagged'
         ELSE 'Monitor' END AS flagged_status
  FROM sc6
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def feat_sql(select: str, basis: str = BASIS_DEBIT, period_end: str | None = "DATE '2001-10-31'",
             clean: str = CLEAN_DEBIT) -> str:
    return with_(GL_DEBIT, clean, feature_ctes(basis, period_end)) + select


def scored_sql(select: str) -> str:
    return with_(GL_DEBIT, CLEAN_DEBIT, feature_ctes(), SCORE_CTES) + select


def r6(c: str, alias: str | None = None) -> str:
    return f"(round({c}, 6) + 0.0) AS {alias or c}"


def money_fmt(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)))"


ORACLE: dict[str, str] = {}

ORACLE["clean_gl"] = feat_sql(
    "SELECT journal_ref, date, amount, abs_amount, account_code, account_name, vendor, description, "
    "debit_amount, credit_amount, dr_cr_pattern FROM clean")

ORACLE["nonfinite_to_null"] = feat_sql(
    "SELECT journal_ref, (round(CASE WHEN isinf(period_over_period_pct) OR isnan(period_over_period_pct) "
    "THEN NULL ELSE period_over_period_pct END, 6) + 0.0) AS period_over_period_pct, "
    "CASE WHEN period_over_period_pct IS NULL THEN 1 ELSE 0 END AS is_null FROM feat")


def _fcols(*cols: str, doubles=("abs_amount", "amount", "amount_zscore_by_account",
                                "period_over_period_pct", "vendor_concentration_pct")) -> str:
    parts = ["journal_ref"] + [r6(c) if c in doubles else c for c in cols]
    return "SELECT " + ", ".join(parts) + " FROM feat"


T1 = ["amount_zscore_by_account", "is_round_number", "is_weekend_posting", "missing_description",
      "vendor_txn_count", "is_new_vendor", "is_near_approval_threshold"]
T2 = ["control_gap_score", "fraud_flag_count", "fraud_risk_flag", "period_over_period_pct",
      "vendor_concentration_pct", "is_year_end_concentration", "is_non_standard_pattern"]

ORACLE["round_number"] = feat_sql(_fcols("abs_amount", "is_round_number"))
ORACLE["weekend_posting"] = feat_sql(_fcols("date", "is_weekend_posting"))
ORACLE["missing_description"] = feat_sql(_fcols("description", "missing_description"))
ORACLE["vendor_txn_count"] = feat_sql(_fcols("vendor", "vendor_txn_count"))
ORACLE["new_vendor"] = feat_sql(_fcols("vendor", "is_new_vendor"))
ORACLE["near_threshold"] = feat_sql(_fcols("abs_amount", "is_near_approval_threshold"))
ORACLE["amount_zscore"] = feat_sql(_fcols("account_name", "amount_zscore_by_account"))
ORACLE["tier1_features"] = feat_sql(_fcols(*T1))
ORACLE["control_gap_score"] = feat_sql(_fcols("control_gap_score"))
ORACLE["fraud_flag_count"] = feat_sql(_fcols("fraud_flag_count"))
ORACLE["fraud_risk_flag"] = feat_sql(_fcols("fraud_risk_flag"))
ORACLE["period_over_period"] = feat_sql(_fcols("account_name", "date", "period_over_period_pct"))
ORACLE["vendor_concentration_debit"] = feat_sql(_fcols("vendor", "vendor_concentration_pct"))
ORACLE["vendor_concentration_code"] = with_(GL_DEBIT, CLEAN_CODE, feature_ctes(BASIS_CODE)) + \
    _fcols("vendor", "account_code", "vendor_concentration_pct")
ORACLE["year_end_window"] = feat_sql(_fcols("date", "is_year_end_concentration"))
ORACLE["year_end_window_default"] = feat_sql(_fcols("date", "is_year_end_concentration"),
                                             period_end=None)
ORACLE["non_standard_pattern"] = feat_sql(_fcols("dr_cr_pattern", "is_non_standard_pattern"))
ORACLE["tier2_features"] = feat_sql(_fcols(*T2))
ORACLE["engineer_features"] = feat_sql(_fcols("date", "amount", "abs_amount", "account_code",
                                              "account_name", "vendor", *T1, *T2))

_FIRING = [("t1", 0, "is_round_number", "sum(is_round_number)"),
           ("t1", 1, "is_weekend_posting", "sum(is_weekend_posting)"),
           ("t1", 2, "missing_description", "sum(missing_description)"),
           ("t1", 3, "is_new_vendor", "sum(is_new_vendor)"),
           ("t1", 4, "is_near_approval_threshold", "sum(is_near_approval_threshold)"),
           ("t2", 0, "control_gap_ge_1", "count(*) FILTER (WHERE control_gap_score >= 1)"),
           ("t2", 1, "fraud_risk_flag", "sum(fraud_risk_flag)"),
           ("t2", 2, "is_year_end_concentration", "sum(is_year_end_concentration)"),
           ("t2", 3, "is_non_standard_pattern", "sum(is_non_standard_pattern)")]
FIRING_CTE = "firing AS (\n" + "\n  UNION ALL ".join(
    f"SELECT '{t}' AS tier, {i} AS feature_order, '{f}' AS feature, CAST(coalesce({e}, 0) AS BIGINT) AS n FROM feat"
    for t, i, f, e in _FIRING) + "\n)"

ORACLE["feature_firing"] = with_(GL_DEBIT, CLEAN_DEBIT, feature_ctes(), FIRING_CTE) + \
    "SELECT tier, feature_order, feature, n FROM firing"
ORACLE["firing_summary"] = with_(GL_DEBIT, CLEAN_DEBIT, feature_ctes(), FIRING_CTE) + (
    "SELECT count(*) FILTER (WHERE tier = 't1' AND n > 0) AS t1_active, "
    "count(*) FILTER (WHERE tier = 't2' AND n > 0) AS t2_active, "
    "CAST(sum(n) AS BIGINT) AS total_firings FROM firing")

# ---------------------------------------------------------------- scoring rules
ORACLE["materiality"] = feat_sql(
    "SELECT threshold, (round(t, 6) + 0.0) AS amount, count(*) FILTER (WHERE abs_amount >= t) AS n_over, "
    "round(CAST(coalesce(sum(CAST(abs_amount AS DECIMAL(28,10))) FILTER (WHERE abs_amount >= t), 0) AS DOUBLE), 4) AS sum_over "
    "FROM clean, (VALUES ('fs', 80000.0::DOUBLE), ('performance', 40000.0), ('transaction', 64000.0)) AS v(threshold, t) GROUP BY threshold, t")


def _scols(*cols: str, doubles=("anomaly_score", "fraud_probability", "abs_amount")) -> str:
    parts = ["journal_ref"] + [r6(c) if c in doubles else c for c in cols]
    return "SELECT " + ", ".join(parts) + " FROM scored"


ORACLE["raw_tier"] = scored_sql(_scols("anomaly_score", "raw_tier"))
ORACLE["shift_tier"] = scored_sql(
    f"SELECT journal_ref, raw_tier, {down('raw_tier')} AS tier_down, {up('raw_tier')} AS tier_up, "
    f"{down('final_tier')} AS final_down, {up('final_tier')} AS final_up FROM scored")
ORACLE["materiality_filter"] = scored_sql(
    f"SELECT journal_ref, (round(abs_amount, 6) + 0.0) AS abs_amount, raw_tier, t_mat AS materiality_tier FROM scored")
ORACLE["materiality_annotation"] = scored_sql(_scols("abs_amount", "materiality_annotation"))
ORACLE["active_flags"] = scored_sql(_scols("active_flags"))
ORACLE["qualitative_override"] = scored_sql(_scols("raw_tier", "fraud_flag_count",
                                                   "is_qualitative_override", "qualitative_override_note"))
ORACLE["supervised_escalation"] = scored_sql(_scols("fraud_probability", "final_tier",
                                                    "is_supervised_escalation", "supervised_escalation_note"))
ORACLE["review_label"] = scored_sql(_scols("final_tier", "pcaob_label"))
ORACLE["flagged_status"] = scored_sql(_scols("final_tier", "flagged_status"))
APPLY_COLS = ["anomaly_score", "fraud_probability", "raw_tier", "final_tier", "pcaob_label",
              "materiality_annotation", "active_flags", "flagged_status", "is_qualitative_override",
              "qualitative_override_note", "is_supervised_escalation", "supervised_escalation_note"]
ORACLE["apply_scoring"] = scored_sql(_scols(*APPLY_COLS))
QUEUE = ["journal_ref", "date", "account_name", "vendor", "amount", "anomaly_score", "raw_tier",
         "final_tier", "pcaob_label", "materiality_annotation", "active_flags", "control_gap_score",
         "fraud_risk_flag", "period_over_period_pct", "vendor_concentration_pct",
         "is_year_end_concentration", "is_non_standard_pattern", "fraud_probability",
         "is_qualitative_override", "qualitative_override_note", "is_supervised_escalation",
         "supervised_escalation_note"]
_QD = ("amount", "anomaly_score", "period_over_period_pct", "vendor_concentration_pct", "fraud_probability")
ORACLE["flagged_queue"] = scored_sql(
    "SELECT " + ", ".join(r6(c) if c in _QD else c for c in QUEUE)
    + ", row_number() OVER (ORDER BY anomaly_score, journal_ref) - 1 AS queue_position"
    + " FROM scored WHERE flagged_status = 'Flagged'")

# ---------------------------------------------------------------- integrity
GLOBAL_CTE = """g AS (
  SELECT count(*) AS n_rows,
         coalesce(sum(CAST(abs_amount AS DECIMAL(28,10))), 0) AS sum_abs,
         coalesce(sum(CAST(debit_amount AS DECIMAL(28,10))), 0) AS sum_d,
         coalesce(sum(CAST(credit_amount AS DECIMAL(28,10))), 0) AS sum_c,
         count(date) AS n_dates,
         count(*) FILTER (WHERE date < DATE '1996-01-01' OR date > DATE '2001-10-31') AS n_oob
  FROM clean
)"""

HASH_SQL = ("SELECT 1 AS check_order, 'Hash total' AS name, "
            "CASE WHEN abs(sum_abs - (sum_d + sum_c)) <= 0.01 THEN 'Pass' ELSE 'Warning' END AS status, "
            + fill_sql(HASH_TOTAL_SUMMARY, sum_abs=money_fmt("sum_abs"), sum_dc=money_fmt("sum_d + sum_c"),
                       diff=money_fmt("abs(sum_abs - (sum_d + sum_c))")) + " AS summary FROM g")
CROSS_SQL = ("SELECT 2 AS check_order, 'Cross-footing' AS name, "
             "CASE WHEN abs(sum_d - sum_c) <= 0.01 THEN 'Pass' ELSE 'Warning' END AS status, "
             + fill_sql(CROSS_FOOTING_SUMMARY, sum_d=money_fmt("sum_d"), sum_c=money_fmt("sum_c"),
                        diff=money_fmt("abs(sum_d - sum_c)"),
                        pct="format('{:.2f}', CAST(abs(sum_d - sum_c) AS DOUBLE) / "
                            "greatest(CAST(sum_d AS DOUBLE), 1.0) * 100.0)") + " AS summary FROM g")
PERIOD_SQL = ("SELECT 3 AS check_order, 'Date in period' AS name, "
              "CASE WHEN n_oob = 0 AND n_rows - n_dates = 0 THEN 'Pass' ELSE 'Warning' END AS status, "
              + fill_sql(DATE_PERIOD_SUMMARY, n_oob="n_oob", n_total="n_dates", start="'1996-01-01'",
                         end="'2001-10-31'")
              + " || CASE WHEN n_rows - n_dates > 0 THEN "
              + fill_sql(DATE_PERIOD_NULLS, n_null="n_rows - n_dates") + " ELSE '' END || '.' AS summary FROM g")
MAP_CTES = """pairs AS (
  SELECT DISTINCT account_code, account_name FROM clean
  WHERE account_code IS NOT NULL AND account_name IS NOT NULL
),
bad_codes AS (SELECT account_code, count(*) AS n_names FROM pairs GROUP BY 1 HAVING count(*) > 1),
bad_names AS (SELECT account_name, count(*) AS n_codes FROM pairs GROUP BY 1 HAVING count(*) > 1),
mapping AS (
  SELECT (SELECT count(*) FROM bad_codes) AS nc, (SELECT count(*) FROM bad_names) AS nn,
         (SELECT string_agg(account_code, ''', ''' ORDER BY account_code)
            FROM (SELECT account_code FROM bad_codes ORDER BY account_code LIMIT 3)) AS c3,
         (SELECT string_agg(account_name, ''', ''' ORDER BY account_name)
            FROM (SELECT account_name FROM bad_names ORDER BY account_name LIMIT 3)) AS n3
)"""
_EX_C = "'[''' || c3 || ''']'"
_EX_N = "'[''' || n3 || ''']'"
MAP_SQL = ("SELECT 4 AS check_order, 'Account mapping' AS name, "
           "CASE WHEN nc = 0 AND nn = 0 THEN 'Pass' ELSE 'Warning' END AS status, "
           f"CASE WHEN nc = 0 AND nn = 0 THEN '{MAPPING_OK}' ELSE "
           "concat_ws('; ', CASE WHEN nc > 0 THEN " + fill_sql(MAPPING_CODES, n="nc", examples=_EX_C) + " END, "
           "CASE WHEN nn > 0 THEN " + fill_sql(MAPPING_NAMES, n="nn", examples=_EX_N)
           + " END) || '.' END AS summary FROM mapping")
REPORT_CTE = ("report AS (\n" + HASH_SQL + "\nUNION ALL " + CROSS_SQL + "\nUNION ALL " + PERIOD_SQL +
              "\nUNION ALL " + MAP_SQL + "\n)")


def integrity_sql(select: str) -> str:
    return with_(GL_DEBIT, CLEAN_DEBIT, GLOBAL_CTE, MAP_CTES, REPORT_CTE) + select




def _detail_sql(sql: str, source: str = "g", **columns: str) -> str:
    """A finding with the numbers of its detail."""
    cols = ", ".join(f"round(CAST({x} AS DOUBLE), 4) AS {c}" for c, x in columns.items())
    return f"SELECT a.*, {cols} FROM ({sql}) a, {source}"


ORACLE["hash_total"] = with_(GL_DEBIT, CLEAN_DEBIT, GLOBAL_CTE) + _detail_sql(
    HASH_SQL, sum_abs="g.sum_abs", sum_dc="g.sum_d + g.sum_c", diff="abs(g.sum_abs - (g.sum_d + g.sum_c))")
ORACLE["hash_total_skipped"] = with_(GL_DEBIT, CLEAN_CODE) + (
    "SELECT 1 AS check_order, 'Hash total' AS name, 'Pass' AS status, "
    f"'{SKIP_HASH}' AS summary "
    "FROM (SELECT count(*) FROM clean)")
ORACLE["cross_footing"] = with_(GL_DEBIT, CLEAN_DEBIT, GLOBAL_CTE) + _detail_sql(
    CROSS_SQL, sum_d="g.sum_d", sum_c="g.sum_c", diff="abs(g.sum_d - g.sum_c)",
    pct="CAST(abs(g.sum_d - g.sum_c) AS DOUBLE) / greatest(CAST(g.sum_d AS DOUBLE), 1.0) * 100")
ORACLE["date_in_period"] = with_(GL_DEBIT, CLEAN_DEBIT, GLOBAL_CTE) + _detail_sql(
    PERIOD_SQL, n_total="g.n_dates", n_out_of_bounds="g.n_oob", n_null="g.n_rows - g.n_dates")
ORACLE["account_mapping_codes"] = with_(GL_DEBIT, CLEAN_DEBIT, MAP_CTES) + "SELECT account_code, n_names FROM bad_codes"
ORACLE["account_mapping_names"] = with_(GL_DEBIT, CLEAN_DEBIT, MAP_CTES) + "SELECT account_name, n_codes FROM bad_names"
ORACLE["account_mapping"] = with_(GL_DEBIT, CLEAN_DEBIT, MAP_CTES) + _detail_sql(
    MAP_SQL, "(SELECT 1)", n_bad_codes="(SELECT count(*) FROM bad_codes)", n_bad_names="(SELECT count(*) FROM bad_names)")
ORACLE["integrity_report"] = integrity_sql("SELECT check_order, name, status, summary FROM report")
COUNTS_CTE = """icounts AS (
  SELECT s.status_order, s.status, CAST(count(r.status) AS BIGINT) AS n
  FROM (VALUES (0, 'Pass'), (1, 'Warning'), (2, 'Fail')) AS s(status_order, status)
  LEFT JOIN report r ON r.status = s.status
  GROUP BY s.status_order, s.status
)"""
ORACLE["integrity_counts"] = with_(GL_DEBIT, CLEAN_DEBIT, GLOBAL_CTE, MAP_CTES, REPORT_CTE, COUNTS_CTE) + \
    "SELECT status_order, status, n FROM icounts"
ORACLE["quality_exceptions"] = integrity_sql(
    "SELECT check_order, name, status, summary FROM report WHERE status <> 'Pass'")

# ---------------------------------------------------------------- result aggregates
SUMMARY_CTE = """summ AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE flagged_status = 'Flagged') AS flagged,
         CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE flagged_status = 'Flagged') / count(*) * 100.0
              ELSE 0.0 END AS pct
  FROM scored
)"""
ORACLE["review_summary"] = with_(GL_DEBIT, CLEAN_DEBIT, feature_ctes(), SCORE_CTES, SUMMARY_CTE) + (
    "SELECT total, flagged, round(pct, 2) AS flagged_pct, "
    "CASE WHEN pct > 5 THEN 'Elevated' WHEN pct > 2 THEN 'Moderate' ELSE 'Low' END AS risk_rating FROM summ")
ORACLE["tier_distribution"] = scored_sql(
    f"SELECT l.label_order, l.label, CAST(count(s.pcaob_label) AS BIGINT) AS count "
    f"FROM (VALUES (0, '{LABEL_HIGH}'), (1, '{LABEL_MEDIUM}'), (2, '{LABEL_MONITOR}')) AS l(label_order, label) "
    f"LEFT JOIN scored s ON s.pcaob_label = l.label GROUP BY l.label_order, l.label")
ORACLE["top_accounts"] = scored_sql(
    "SELECT account_name, round(CAST(sum(CAST(abs_amount AS DECIMAL(28,10))) AS DOUBLE), 4) AS flagged_amount "
    "FROM scored WHERE flagged_status = 'Flagged' AND account_name IS NOT NULL "
    "GROUP BY account_name ORDER BY sum(CAST(abs_amount AS DECIMAL(28,10))) DESC, account_name LIMIT 10")
ORACLE["escalation_counts"] = scored_sql(
    "SELECT CAST(sum(is_qualitative_override) AS BIGINT) AS n_qualitative_override, "
    "CAST(sum(is_supervised_escalation) AS BIGINT) AS n_supervised_escalation, "
    "CASE WHEN count(*) FILTER (WHERE fraud_risk_flag = 1) < 5 THEN 'skipped_insufficient_positives' "
    "WHEN count(*) FILTER (WHERE fraud_risk_flag = 0) = 0 THEN 'skipped_single_class' ELSE 'trained' END AS status, "
    "count(*) FILTER (WHERE fraud_risk_flag = 1) AS n_positive, "
    "count(*) FILTER (WHERE fraud_risk_flag = 0) AS n_negative FROM scored")
ORACLE["train_guards"] = feat_sql(
    "SELECT CASE WHEN count(*) FILTER (WHERE fraud_risk_flag = 1) < 5 THEN 'skipped_insufficient_positives' "
    "WHEN count(*) FILTER (WHERE fraud_risk_flag = 0) = 0 THEN 'skipped_single_class' ELSE 'trained' END AS status, "
    "count(*) FILTER (WHERE fraud_risk_flag = 1) AS n_positive, "
    "count(*) FILTER (WHERE fraud_risk_flag = 0) AS n_negative FROM feat")
_ORDER = ["Unusual amount for account", "Round number amount", "Weekend posting",
          "Missing description", "New vendor", "Near approval threshold"]
ORACLE["top_drivers"] = scored_sql(
    "SELECT flag, n FROM (SELECT trim(f) AS flag, count(*) AS n FROM "
    "(SELECT unnest(string_split(active_flags, ';')) AS f FROM scored WHERE flagged_status = 'Flagged') "
    f"WHERE trim(f) <> '' AND trim(f) <> '{NO_FLAGS_TEXT}' GROUP BY 1) "
    "ORDER BY n DESC, CASE flag " + " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(_ORDER)) +
    " ELSE 99 END, flag LIMIT 3")


def _plural(n: str, word: str) -> str:
    return f"(CAST({n} AS VARCHAR) || ' {word}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END)"


_HI, _ME = _plural('n_high', HIGH_ITEMS), _plural('n_medium', MEDIUM_ITEMS)
ORACLE["suggested_action"] = scored_sql(
    "SELECT n_high, n_medium, CASE "
    f"WHEN n_high > 0 AND n_medium > 0 THEN {fill_sql(ACTION_BOTH, high=_HI, medium=_ME)} "
    f"WHEN n_high > 0 THEN {fill_sql(ACTION_ONE, items=_HI)} "
    f"WHEN n_medium > 0 THEN {fill_sql(ACTION_ONE, items=_ME)} "
    f"ELSE '{ACTION_NONE}' END AS suggested_action "
    "FROM (SELECT count(*) FILTER (WHERE final_tier = 'High') AS n_high, "
    "count(*) FILTER (WHERE final_tier = 'Medium') AS n_medium FROM scored WHERE flagged_status = 'Flagged')")
ORACLE["packet_header"] = with_(GL_DEBIT, CLEAN_DEBIT, feature_ctes(), SCORE_CTES, SUMMARY_CTE,
                                GLOBAL_CTE, MAP_CTES, REPORT_CTE, COUNTS_CTE) + (
    "SELECT '1996-01-01' AS period_start, '2001-10-31' AS period_end, '01/01/1996 – 10/31/2001' AS review_period, "
    "s.total AS population, s.flagged AS queue_size, "
    "(SELECT n FROM icounts WHERE status = 'Pass') AS n_pass, "
    "(SELECT n FROM icounts WHERE status = 'Warning') AS n_warning, "
    "(SELECT n FROM icounts WHERE status = 'Fail') AS n_fail, "
    + fill_sql(POPULATION_TEXT, n="format('{:,}', s.total)") + " AS population_text, "
    + fill_sql(QUEUE_TEXT, n="format('{:,}', s.flagged)") + " AS queue_text, "
    + fill_sql(QUALITY_TEXT, passed=_plural("(SELECT n FROM icounts WHERE status = 'Pass')", "check"),
               warnings=_plural("(SELECT n FROM icounts WHERE status = 'Warning')", "warning"),
               failures=_plural("(SELECT n FROM icounts WHERE status = 'Fail')", "failure"))
    + " AS quality_text FROM summ s")

# ---------------------------------------------------------------- memo tables
RANK_CTES = """q AS (SELECT * FROM scored WHERE flagged_status = 'Flagged'),
qk AS (
  SELECT *,
    CASE final_tier WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 WHEN 'Monitor' THEN 3 ELSE 99 END AS k0,
    CASE WHEN coalesce(is_qualitative_override, 0) = 1 THEN 0 ELSE 1 END AS k1,
    CASE WHEN coalesce(fraud_risk_flag, 0) = 1 THEN 0 ELSE 1 END AS k2,
    coalesce(anomaly_score, 0.0) AS k3, -coalesce(amount, 0.0) AS k4
  FROM q
),
ranked AS (
  SELECT * EXCLUDE (rn), CAST(rn - 1 AS INTEGER) AS position FROM (
    SELECT *, row_number() OVER (ORDER BY k0, k1, k2, k3, k4, journal_ref NULLS FIRST, date NULLS FIRST,
                                 account_name NULLS FIRST, vendor NULLS FIRST, amount NULLS FIRST) AS rn
    FROM qk)
)"""


def _lst(items):
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]::VARCHAR[]"


def _cat(lists):
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


def _first_two(pairs, default):
    picked = _cat([f"CASE WHEN contains(fl, '{p}') THEN {_lst(v)} ELSE []::VARCHAR[] END" for p, v in pairs])
    return (f"(CASE WHEN len({picked}) = 0 THEN {_lst(default)} ELSE "
            f"list_filter({picked}, lambda x, i: list_position({picked}, x) = i)[1:2] END)")


def _memo_ctes():
    from ..constants import ASSERTION_DEFAULT, ASSERTION_MAP, COSO_DEFAULT, COSO_MAP
    from ..constants import (AMOUNT_PLACEHOLDER, DISCLAIMER, FLAGS_PLACEHOLDER, FOLLOW_UP_BASE,
                             FOLLOW_UP_CONDITIONAL, FOLLOW_UP_OVERRIDE, LIKELIHOOD_FEW, LIKELIHOOD_MANY,
                             MAGNITUDE_LARGE, MAGNITUDE_OPEN, MAGNITUDE_SMALL, MEMO_ASSERTIONS, MEMO_CONTROLS,
                             MEMO_SUMMARY)
    conds = []
    for pats, item in FOLLOW_UP_CONDITIONAL:
        c = " OR ".join(f"contains(fl, '{p}')" for p in pats)
        conds.append(f"CASE WHEN {c} THEN {_lst([item])} ELSE []::VARCHAR[] END")
    conds.append(f"CASE WHEN coalesce(is_qualitative_override, 0) = 1 THEN {_lst([FOLLOW_UP_OVERRIDE])} "
                 "ELSE []::VARCHAR[] END")
    fu = _cat([_lst(FOLLOW_UP_BASE)] + conds)
    return f"""mt AS (
  SELECT *,
    list_filter(list_transform(string_split(coalesce(active_flags, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS parts0,
    lower(coalesce(active_flags, '')) AS fl,
    CASE WHEN amount IS NULL THEN '{AMOUNT_PLACEHOLDER}' ELSE '$' || format('{{:,.2f}}', amount) END AS amt,
    CASE WHEN lower(trim(coalesce(materiality_annotation, ''))) LIKE '%exceeds%' THEN 'exceeds'
         WHEN lower(trim(coalesce(materiality_annotation, ''))) LIKE '%below%' THEN 'below' ELSE 'other' END AS mkind,
    coalesce(is_qualitative_override, 0) = 1 AS ovr
  FROM ranked
),
mt2 AS (
  SELECT *, list_transform(CASE WHEN len(parts0) = 0 THEN ['{FLAGS_PLACEHOLDER}']
                                ELSE parts0 END, lambda x: lower(x)) AS lp,
         CASE WHEN len(parts0) = 0 THEN 1 ELSE len(parts0) END AS nflags,
         {_first_two(ASSERTION_MAP, ASSERTION_DEFAULT)} AS asr,
         {_first_two(COSO_MAP, COSO_DEFAULT)} AS coso,
         list_filter({fu}, lambda x, i: list_position({fu}, x) = i)[1:5] AS fu
  FROM mt
),
mt3 AS (
  SELECT *,
    CASE WHEN len(lp) = 1 THEN lp[1] WHEN len(lp) = 2 THEN lp[1] || ' and ' || lp[2]
         ELSE array_to_string(lp[1:len(lp) - 1], ', ') || ', and ' || lp[len(lp)] END AS flags_clause
  FROM mt2
),
memo AS (
  SELECT *,
    {fill_sql(MEMO_SUMMARY, amount="amt", flags="flags_clause")} AS m_risk,
    {fill_sql(MEMO_ASSERTIONS, assertions="array_to_string(asr, ' and ')")} AS m_assert,
    CASE mkind WHEN 'exceeds' THEN {fill_sql(MAGNITUDE_LARGE, amount="amt")}
               WHEN 'below' THEN {fill_sql(MAGNITUDE_SMALL, amount="amt")}
               ELSE {fill_sql(MAGNITUDE_OPEN, amount="amt")} END AS m_mag,
    CASE WHEN ovr OR nflags >= 3 THEN {fill_sql(LIKELIHOOD_MANY)} ELSE {fill_sql(LIKELIHOOD_FEW, n="nflags")} END AS m_like,
    {fill_sql(MEMO_CONTROLS, components="array_to_string(coso, ' and ')")} AS m_ctrl,
    {fill_sql(DISCLAIMER)} AS m_disc
  FROM mt3
)"""


def memo_sql(select: str, extra: tuple = ()) -> str:
    return with_(GL_DEBIT, CLEAN_DEBIT, feature_ctes(), SCORE_CTES, RANK_CTES, _memo_ctes(), *extra) + select


ORACLE["memo_rank"] = memo_sql(
    "SELECT position, journal_ref, final_tier, is_qualitative_override, fraud_risk_flag, "
    "(round(anomaly_score, 6) + 0.0) AS anomaly_score, (round(amount, 6) + 0.0) AS amount FROM memo "
    "WHERE position < 20")
ORACLE["memo_keys"] = memo_sql(
    "SELECT position, date, account_name, vendor, (round(amount, 6) + 0.0) AS amount FROM memo")
ORACLE["flags_clause"] = memo_sql("SELECT position, active_flags, flags_clause, amt AS amount_text FROM memo")
ORACLE["assertions"] = memo_sql("SELECT position, active_flags, array_to_string(asr, '|') AS assertions FROM memo")
ORACLE["coso_components"] = memo_sql(
    "SELECT position, active_flags, array_to_string(coso, '|') AS coso_components FROM memo")
ORACLE["follow_ups"] = memo_sql(
    "SELECT position, active_flags, is_qualitative_override, array_to_string(fu, '; ') AS recommended_follow_up FROM memo")
ORACLE["risk_summary"] = memo_sql(
    "SELECT position, m_risk || CASE WHEN ovr THEN " + fill_sql(K.SUMMARY_OVERRIDE)
    + " WHEN coalesce(fraud_risk_flag, 0) = 1 THEN " + fill_sql(K.SUMMARY_COMBINED)
    + " ELSE '' END || CASE mkind WHEN 'exceeds' THEN " + fill_sql(K.SUMMARY_LARGE) + " WHEN 'below' THEN "
    + fill_sql(K.SUMMARY_SMALL) + " ELSE '' END || " + fill_sql(K.SUMMARY_CLOSE) + " AS risk_summary FROM memo")
ORACLE["full_memo"] = memo_sql(
    "SELECT position, m_risk AS risk_summary, m_assert AS assertion_consideration, m_mag AS magnitude_assessment, "
    "m_like AS likelihood_assessment, m_ctrl AS control_or_coso_consideration, "
    "array_to_string(fu, '; ') AS recommended_follow_up, m_disc AS disclaimer FROM memo")

_NL = "chr(10)"


def _fact(label, value):
    return f"'{label} = ' || coalesce(CAST({value} AS VARCHAR), 'unknown') || {_NL}"


def _yes(column):
    return f"CASE WHEN coalesce({column}, 0) = 1 THEN 'yes' ELSE 'no' END"


_FACTS = {"sum": "'$' || format('{:,.2f}', amount)", "ledger account": "account_name", "counterparty": "vendor",
          "checks": "active_flags", "queue label": "pcaob_label", "tier": "final_tier",
          "size note": "materiality_annotation", "control gaps of 2": "coalesce(control_gap_score, 0)",
          "checks combine": _yes("fraud_risk_flag"), "raised by combination": _yes("is_qualitative_override"),
          "likeness to rule-flagged entries, 0 to 1": "format('{:.2f}', fraud_probability)"}
_BODY = (fill_sql(K.PROMPT_HEAD, entity="'Private for-profit'", start="'1996-01-01'", end="'2001-10-31'") + " || "
         + " || ".join(_fact(k, v) for k, v in _FACTS.items()))
ORACLE["memo_prompts"] = memo_sql(
    f"SELECT position, 'summary' AS kind, {_BODY} || {fill_sql(K.PROMPT_SUMMARY)} AS prompt FROM memo "
    f"UNION ALL SELECT position, 'memo' AS kind, {_BODY} || {fill_sql(K.PROMPT_MEMO)} AS prompt FROM memo")

_MUT = ["good", "missing_key", "wrong_type", "too_few_items", "banned_phrase", "wrong_disclaimer", "name_leak",
        "not_json", "extra_key", "short_text", "empty_item"]
CAND_CTE = """cand0 AS (SELECT *, """ + "[" + ", ".join(f"'{m}'" for m in _MUT) + """][position % 11 + 1] AS mutation FROM memo
  UNION ALL SELECT *, 'twin' AS mutation FROM memo WHERE position % 11 = 0),
cand AS (
  SELECT position, mutation,
    CASE mutation WHEN 'banned_phrase' THEN m_risk || ' This proves fraud.' WHEN 'good' THEN 'Second reading: ' || m_risk
      WHEN 'short_text' THEN 'Too short.' ELSE m_risk END AS f_risk,
    m_assert AS f_assert, m_mag AS f_mag,
    CASE WHEN mutation = 'missing_key' THEN NULL ELSE m_like END AS f_like,
    CASE WHEN mutation = 'name_leak' THEN m_ctrl || ' The manager should explain the entry.' ELSE m_ctrl END AS f_ctrl,
    CASE mutation WHEN 'too_few_items' THEN fu[1:2] WHEN 'empty_item' THEN list_concat([' '], fu[2:]) ELSE fu END AS f_fu,
    CASE WHEN mutation = 'wrong_disclaimer' THEN 'This analysis is indicative only.' ELSE m_disc END AS f_disc
  FROM cand0
)"""
CHECK_CTE = """chk AS (
  SELECT position, mutation, CASE
    WHEN mutation = 'not_json' THEN 'not valid JSON'
    WHEN mutation = 'extra_key' THEN 'extra keys: [''note'']'
    WHEN mutation = 'short_text' THEN 'risk_summary length 10 out of bounds [40, 600]'
    WHEN mutation = 'empty_item' THEN 'recommended_follow_up[0] is empty'
    WHEN f_like IS NULL THEN 'missing keys: [''likelihood_assessment'']'
    WHEN mutation = 'wrong_type' THEN 'recommended_follow_up must be a list, got str'
    WHEN len(f_fu) NOT BETWEEN 3 AND 5 THEN 'recommended_follow_up has ' || CAST(len(f_fu) AS VARCHAR) || ' items, expected 3-5'
    WHEN f_disc <> 'This analysis identifies risk indicators only. It does not determine intent, fraud, or an audit conclusion.'
      THEN 'disclaimer does not match the required verbatim string'
    WHEN list_filter(BANNED, lambda p: contains(lower(concat_ws(chr(10), f_risk, f_assert, f_mag, f_like, f_ctrl, array_to_string(f_fu, chr(10)), f_disc)), p))[1] IS NOT NULL
      THEN 'banned phrase detected: ''' || list_filter(BANNED, lambda p: contains(lower(concat_ws(chr(10), f_risk, f_assert, f_mag, f_like, f_ctrl, array_to_string(f_fu, chr(10)), f_disc)), p))[1] || ''''
    WHEN list_filter(LEAKS, lambda p: contains(lower(concat_ws(chr(10), f_risk, f_assert, f_mag, f_like, f_ctrl, array_to_string(f_fu, chr(10)), f_disc)), p))[1] IS NOT NULL
      THEN 'name-leakage pattern detected: ''' || list_filter(LEAKS, lambda p: contains(lower(concat_ws(chr(10), f_risk, f_assert, f_mag, f_like, f_ctrl, array_to_string(f_fu, chr(10)), f_disc)), p))[1] || ''''
    END AS reason
  FROM cand
)"""


def _check_cte():
    from ..constants import BANNED_PHRASES, NAME_LEAK_PATTERNS
    return CHECK_CTE.replace("BANNED", _lst(BANNED_PHRASES)).replace("LEAKS", _lst(NAME_LEAK_PATTERNS))


def _scan_cte():
    from ..constants import BANNED_PHRASES, NAME_LEAK_PATTERNS
    txt = ("lower(concat_ws(chr(10), f_risk, f_assert, f_mag, f_like, f_ctrl, "
           "CASE WHEN mutation = 'wrong_type' THEN array_to_string(f_fu, '; ') ELSE array_to_string(f_fu, chr(10)) END, f_disc))")
    return (f"scan AS (SELECT position, mutation, list_filter({_lst(BANNED_PHRASES)}, lambda p: contains({txt}, p))[1] AS banned_phrase, "
            f"list_filter({_lst(NAME_LEAK_PATTERNS)}, lambda p: contains({txt}, p))[1] AS name_pattern FROM cand)")


ORACLE["validate_memos"] = memo_sql(
    "SELECT position, mutation, reason IS NULL AS is_valid, coalesce(reason, '') AS reason FROM chk",
    (CAND_CTE, _check_cte()))
ORACLE["phrase_scan"] = memo_sql("SELECT position, mutation, banned_phrase, name_pattern FROM scan",
                                 (CAND_CTE, _scan_cte()))
_BEST = "best AS (SELECT position, bool_or(reason IS NULL) AS ok FROM chk GROUP BY position)"
ORACLE["accept_or_fallback"] = memo_sql(
    "SELECT c.position, m.journal_ref, CASE WHEN c.ok THEN 'GPT' ELSE 'Fallback' END AS narrative_status, "
    "CASE WHEN c.ok THEN 'Second reading: ' ELSE '' END || m.m_risk AS risk_summary, m.m_disc AS disclaimer "
    "FROM best c JOIN memo m ON c.position = m.position", (CAND_CTE, _check_cte(), _BEST))
ORACLE["memo_tallies"] = memo_sql(
    "SELECT count(*) AS top_n_used, count(*) FILTER (WHERE ok) AS n_gpt, "
    "count(*) FILTER (WHERE NOT ok) AS n_fallback FROM best", (CAND_CTE, _check_cte(), _BEST))
ORACLE["attach_memos"] = memo_sql(
    "SELECT q.journal_ref, CASE WHEN m.position IS NULL THEN 'Not generated' ELSE 'Fallback' END AS narrative_status, "
    "m.m_risk AS risk_summary FROM q LEFT JOIN memo m ON q.journal_ref = m.journal_ref")
ORACLE["attach_memos_by_keys"] = memo_sql(
    "SELECT q.journal_ref, CASE WHEN mk.position IS NULL THEN 'Not generated' ELSE 'Fallback' END AS narrative_status, "
    "mk.m_risk AS risk_summary FROM q LEFT JOIN (SELECT date, account_name, vendor, amount, "
    "arg_max(m_risk, position) AS m_risk, max(position) AS position FROM memo GROUP BY ALL) mk "
    "ON q.date IS NOT DISTINCT FROM mk.date AND q.account_name IS NOT DISTINCT FROM mk.account_name "
    "AND q.vendor IS NOT DISTINCT FROM mk.vendor AND q.amount IS NOT DISTINCT FROM mk.amount")

# ---------------------------------------------------------------- sources, sinks, scaling
ORACLE["read_gl_csv"] = feat_sql(
    "SELECT journal_ref, date, (round(amount, 6) + 0.0) AS amount, account_code, account_name, vendor, "
    "CASE WHEN description = '' THEN NULL ELSE description END AS description, "
    "(round(debit_amount, 6) + 0.0) AS debit_amount, (round(credit_amount, 6) + 0.0) AS credit_amount, "
    "dr_cr_pattern FROM clean")
ORACLE["read_gl_csv_us_dates"] = ORACLE["read_gl_csv"]
ORACLE["date_votes"] = feat_sql(
    "SELECT candidate, CASE candidate WHEN 'month/day/yyyy' THEN n WHEN 'day/month/yyyy' THEN low ELSE 0 END AS n_parsed, "
    "n AS n_values FROM (SELECT count(date) AS n, count(*) FILTER (day(date) <= 12) AS low FROM clean), "
    f"(SELECT unnest([{', '.join(repr(name) for name, _, _ in CANDIDATES)}]) AS candidate)")
_EXPORT_DOUBLES = ["amount", "anomaly_score", "period_over_period_pct", "vendor_concentration_pct"]
_EXPORT_INTS = ["control_gap_score", "fraud_risk_flag", "is_year_end_concentration", "is_non_standard_pattern"]
_EXPORT_MEMO = {"risk_summary": "m.m_risk", "assertion_consideration": "m.m_assert", "magnitude_assessment": "m.m_mag",
                "likelihood_assessment": "m.m_like", "control_or_coso_consideration": "m.m_ctrl",
                "recommended_follow_up": "array_to_string(m.fu, '; ')", "disclaimer": "m.m_disc"}
ORACLE["export_csv"] = memo_sql(
    "SELECT row_number() OVER (ORDER BY q.anomaly_score, q.journal_ref) - 1 AS position, CAST(q.date AS VARCHAR) AS date, "
    + ", ".join(r6(f"q.{c}", c) if c in _EXPORT_DOUBLES else f"CAST(q.{c} AS INTEGER) AS {c}" if c in _EXPORT_INTS
                else f"nullif(q.{c}, '') AS {c}" for c in EXPORT_BASE_COLUMNS if c != "date")
    + ", CASE WHEN m.position IS NULL THEN 'Not generated' ELSE 'Fallback' END AS narrative_status, "
    + ", ".join(f"nullif({x}, '') AS {c}" for c, x in _EXPORT_MEMO.items())
    + " FROM q LEFT JOIN memo m ON q.journal_ref = m.journal_ref")
PACKET = ["review_summary", "tier_distribution", "integrity_counts", "integrity_report", "quality_exceptions", "top_accounts",
          "feature_firing", "firing_summary", "account_mapping_codes", "account_mapping_names", "materiality", "escalation_counts",
          "flagged_queue", "top_drivers", "suggested_action", "packet_header", "memo_rank", "full_memo"]
ORACLE["write_packet"] = " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM ({ORACLE[name]})" for name in PACKET)
_SC = ["amount_zscore_by_account", "is_round_number", "is_weekend_posting", "missing_description",
       "is_new_vendor", "is_near_approval_threshold"]
ORACLE["standard_scale"] = feat_sql(
    "SELECT journal_ref, " + ", ".join(
        f"(round(CASE WHEN min(coalesce({c}, 0.0)) OVER () = max(coalesce({c}, 0.0)) OVER () THEN 0.0 "
        f"ELSE (coalesce({c}, 0.0) - avg(coalesce({c}, 0.0)) OVER ()) / stddev_pop(coalesce({c}, 0.0)) OVER () END, 6) + 0.0) AS {c}"
        for c in _SC) + " FROM feat")


def _literal_forest_sql() -> str:
    """Path lengths of the fixed three-tree forest as CASE expressions."""
    import math
    from ..constants import TIER1_FEATURES
    from .catalog import LITERAL_FOREST

    def c(n):
        if n <= 1:
            return 0.0
        if n == 2:
            return 1.0
        return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n

    feats = [f"coalesce(CAST({x} AS DOUBLE), 0.0)" for x in TIER1_FEATURES]
    trees = {}
    for t, n, f, th, lft, rgt, k, _ in LITERAL_FOREST:
        trees.setdefault(t, {})[n] = (f, th, lft, rgt, k)

    def expr(t, n, d):
        f, th, lft, rgt, k = trees[t][n]
        if f < 0:
            return repr(d + c(k))
        return f"(CASE WHEN {feats[f]} <= {th!r} THEN {expr(t, lft, d + 1)} ELSE {expr(t, rgt, d + 1)} END)"
    mean = " + ".join(expr(t, 0, 0) for t in sorted(trees))
    return f"-power(2.0, -(({mean}) / {len(trees)}.0) / {c(256)!r})"


ORACLE["iforest_score_literal"] = feat_sql(
    f"SELECT journal_ref, (round({_literal_forest_sql()}, 6) + 0.0) AS raw_score FROM feat")

ORACLE["read_gl_parquet"] = feat_sql(
    "SELECT journal_ref, date, (round(amount, 6) + 0.0) AS amount, account_code, account_name, vendor, "
    "description, (round(debit_amount, 6) + 0.0) AS debit_amount, (round(credit_amount, 6) + 0.0) AS credit_amount, "
    "dr_cr_pattern FROM clean")

ORACLE["order_by_anomaly"] = scored_sql(
    "SELECT row_number() OVER (ORDER BY anomaly_score, journal_ref) - 1 AS queue_position, journal_ref, "
    "(round(anomaly_score, 6) + 0.0) AS anomaly_score FROM scored")
