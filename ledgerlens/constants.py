"""Fixed values shared by the operators.

FIXED VALUES: every list, label and threshold below must stay exactly as written
so that results agree with the review tool this engine re-implements. They are
kept together, in their natural order, as plain text.
"""
from __future__ import annotations

# --- FIXED VALUES: ledger contract -------------------------------------------
REQUIRED_COLUMNS = ["date", "amount", "account_code", "account_name", "vendor",
                    "description", "journal_ref"]
OPTIONAL_COLUMNS = ["debit_amount", "credit_amount", "dr_cr_pattern"]

# Missing-value words of the CSV reader (pandas 2.x defaults).
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
            "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
            "n/a", "nan", "null"]

# --- FIXED VALUES: feature parameters -----------------------------------------
APPROVAL_THRESHOLDS = [5000, 10000, 25000]
NEAR_THRESHOLD_BAND = 0.95
NEW_VENDOR_MIN_TXNS = 3
CO_OCCURRENCE_MIN_FLAGS = 2
YEAR_END_WINDOW_DAYS = 10
UNKNOWN_VENDOR = "UNKNOWN"
DISBURSEMENT_CODE_PATTERN = r"^[567]\d{3}$"
NON_STANDARD_PATTERN = "non_standard"

TIER1_FEATURES = ["amount_zscore_by_account", "is_round_number", "is_weekend_posting",
                  "missing_description", "is_new_vendor", "is_near_approval_threshold"]
FRAUD_FLAG_COLUMNS = ["is_round_number", "is_weekend_posting", "missing_description",
                      "is_new_vendor", "is_near_approval_threshold"]
TIER2_FEATURES = ["control_gap_score", "fraud_flag_count", "fraud_risk_flag",
                  "period_over_period_pct", "vendor_concentration_pct",
                  "is_year_end_concentration", "is_non_standard_pattern"]
SUPERVISED_FEATURES = ["abs_amount", "amount_zscore_by_account", "period_over_period_pct",
                       "vendor_concentration_pct", "is_year_end_concentration",
                       "is_non_standard_pattern", "vendor_txn_count"]

# --- FIXED VALUES: model parameters -------------------------------------------
SENSITIVITY = {"Conservative (0.03)": 0.03, "Balanced (0.05)": 0.05,
               "Aggressive (0.10)": 0.10}
RAW_TIER_HIGH_MAX = -0.15     # score <= -0.15 -> High
RAW_TIER_MEDIUM_MAX = -0.05   # -0.15 < score <= -0.05 -> Medium, else Low
IFOREST_TREES = 200
IFOREST_MAX_SAMPLES = 256
FOREST_TREES = 200
FOREST_MAX_DEPTH = 8
FOREST_MIN_LEAF = 10
MIN_POSITIVE_EXAMPLES = 5
SIMILARITY_THRESHOLD = 0.50
UNUSUAL_Z = 2.0
INTEGRITY_TOLERANCE = 0.01

# --- FIXED VALUES: materiality ------------------------------------------------
ENTITY_TYPES = ["Private for-profit", "Public company", "Non-profit", "Fund"]
FS_PCT_PUBLIC = 0.05
FS_PCT_OTHER = 0.04
PERFORMANCE_SHARE = 0.50
TRANSACTION_SHARE = 0.80

# --- FIXED VALUES: tiers and labels -------------------------------------------
TIER_ORDER = ["Monitor", "Low", "Medium", "High"]
FLAGGED_TIERS = ["High", "Medium"]
LABEL_HIGH = "Potential Material Weakness Indicator"
LABEL_MEDIUM = "Potential Significant Deficiency"
LABEL_MONITOR = "Monitor — Below Escalation Threshold"
REVIEW_LABELS = {"High": LABEL_HIGH, "Medium": LABEL_MEDIUM, "Low": LABEL_MONITOR,
                 "Monitor": LABEL_MONITOR}
LABEL_ORDER = [LABEL_HIGH, LABEL_MEDIUM, LABEL_MONITOR]

ANNOTATION_EXCEEDS = "Exceeds Transaction Materiality"
ANNOTATION_BELOW_TXN = "Below Transaction Materiality"
ANNOTATION_BELOW_PERF = "Below Performance Materiality"

UNUSUAL_AMOUNT_TEXT = "Unusual amount for account"
FLAG_TEXTS = [("is_round_number", "Round number amount"),
              ("is_weekend_posting", "Weekend posting"),
              ("missing_description", "Missing description"),
              ("is_new_vendor", "New vendor"),
              ("is_near_approval_threshold", "Near approval threshold")]
NO_FLAGS_TEXT = "Statistical anomaly only"
FLAG_SEPARATOR = "; "

# Note formats of the two escalation rules.
OVERRIDE_NOTE = ("Escalated to {escalated}: {count} fraud indicators co-occur "
                 "(qualitative materiality, PCAOB AS 2401). Raw ML tier {raw}; "
                 "materiality alone would assign {current}.")
ESCALATION_NOTE = ("Escalated to {escalated}: risk-pattern similarity={score} >= {threshold}. "
                   "Pattern resembles rule-flagged transactions in continuous features.")

# Integrity finding summaries.
HASH_TOTAL_SUMMARY = "Σ|amount| = {sum_abs}; Σ(debit+credit) = {sum_dc}; diff = {diff}."
CROSS_FOOTING_SUMMARY = "ΣDebit = {sum_d}; ΣCredit = {sum_c}; diff = {diff} ({pct}%)."
DATE_PERIOD_SUMMARY = "{n_oob} of {n_total} rows fall outside [{start} .. {end}]"
DATE_PERIOD_NULLS = "; {n_null} rows have an unparseable date"
MAPPING_CODES = "{n} account_code(s) map to multiple names (e.g. {examples})"
MAPPING_NAMES = "{n} account_name(s) map to multiple codes (e.g. {examples})"
MAPPING_OK = "Account code ↔ name mapping is consistent."
SKIP_HASH = "Hash-total check skipped (no debit_amount / credit_amount columns)."
SKIP_CROSS = "Cross-footing check skipped (no debit_amount / credit_amount columns)."
SKIP_PERIOD = "Period bounds not provided — check skipped."
SKIP_MAPPING = "Account mapping check skipped (columns missing)."

# --- FIXED VALUES: review-packet texts ------------------------------------------
ACTION_BOTH = "Review the {high} first, then the {medium}."
ACTION_ONE = "Review the {items}."
ACTION_NONE = "No High or Medium priority items — the review queue is clear."
HIGH_ITEMS, MEDIUM_ITEMS = "High-priority item", "Medium-priority item"
POPULATION_TEXT = "{n} GL transactions"
QUEUE_TEXT = "{n} flagged for follow-up"
QUALITY_TEXT = "{passed} passed · {warnings} · {failures}"

# Summary rating cut-offs on the flagged percentage.
RATING_ELEVATED_ABOVE = 5
RATING_MODERATE_ABOVE = 2

# Integrity check names, in report order.
CHECK_NAMES = ["Hash total", "Cross-footing", "Date in period", "Account mapping"]
STATUSES = ["Pass", "Warning", "Fail"]

TOP_ACCOUNTS_N = 10
TOP_DRIVERS_N = 3
# Of this library: most anomalous first, ties by reference.
QUEUE_ORDER = ["anomaly_score", "journal_ref", "row_id"]

# --- FIXED VALUES: memo contract ----------------------------------------------
MEMO_FIELDS = ["risk_summary", "assertion_consideration", "magnitude_assessment",
               "likelihood_assessment", "control_or_coso_consideration",
               "recommended_follow_up", "disclaimer"]
MEMO_LENGTH_BOUNDS = {"risk_summary": (40, 600), "assertion_consideration": (40, 600),
                      "magnitude_assessment": (30, 500), "likelihood_assessment": (40, 600),
                      "control_or_coso_consideration": (40, 600)}
FOLLOW_UP_ITEMS = (3, 5)
FOLLOW_UP_ITEM_LENGTH = (10, 250)
MEMO_TOP_N_DEFAULT = 10
MEMO_TOP_N_MAX = 20
DISCLAIMER = ("This analysis identifies risk indicators only. "
              "It does not determine intent, fraud, or an audit conclusion.")
# Memo status values: a valid externally generated memo, the rule-built memo, none.
STATUS_CANDIDATE, STATUS_FALLBACK, STATUS_NONE = "GPT", "Fallback", "Not generated"
TIER_MEMO_RANK = {"High": 0, "Medium": 1, "Low": 2, "Monitor": 3}
TIER_MEMO_RANK_UNKNOWN = 99

BANNED_PHRASES = ["fraud occurred", "this is fraudulent", "this is fraud",
                  "this proves fraud", "proves fraud", "confirms fraud",
                  "confirmed misstatement", "confirms a material weakness",
                  "confirms a significant deficiency", "the vendor is suspicious",
                  "the perpetrator", "management committed fraud",
                  "employee committed fraud", "definitively", "the transaction is fake",
                  "this is a pcaob violation", "the employee stole", "the manager stole"]
NAME_LEAK_PATTERNS = ["the employee", "the manager", "the controller", "the cfo", "the ceo",
                      "the bookkeeper", "the accountant who", "the preparer", "mr.", "mrs.",
                      "ms. "]

# Flag pattern -> financial-statement assertions, in match order.
ASSERTION_MAP = [("new vendor", ["Occurrence", "Rights and Obligations"]),
                 ("missing description", ["Occurrence", "Accuracy", "Completeness"]),
                 ("weak documentation", ["Occurrence", "Accuracy", "Completeness"]),
                 ("unusual amount", ["Accuracy", "Valuation", "Classification"]),
                 ("weekend posting", ["Cutoff", "Occurrence"]),
                 ("near approval", ["Occurrence"]),
                 ("round number", ["Accuracy"]),
                 ("account coding", ["Classification"])]
ASSERTION_DEFAULT = ["Occurrence", "Accuracy"]

# Flag pattern -> internal-control components, in match order.
COSO_MAP = [("missing description", ["Information and Communication"]),
            ("weak documentation", ["Information and Communication"]),
            ("near approval", ["Control Activities"]),
            ("weekend posting", ["Control Activities"]),
            ("new vendor", ["Control Activities", "Risk Assessment"]),
            ("year-end concentration", ["Monitoring Activities"]),
            ("non-standard", ["Risk Assessment"]),
            ("management override", ["Control Environment"])]
COSO_DEFAULT = ["Control Activities"]

# Texts of the rule memos: this library's own sentences, one plan per field. They are filled by
# functions.text.fill (Spark) and fill_sql (oracle).
FLAGS_PLACEHOLDER = "a check that left no name"
AMOUNT_PLACEHOLDER = "an amount not on file"
MEMO_SUMMARY = ("Checks on this entry of {amount} raised: {flags}. Trace it to its support before relying "
                "on the account.")
SUMMARY_OVERRIDE = " Some of these checks strengthen each other, so the entry moved up in the queue."
SUMMARY_COMBINED = " Two or more of the combined-risk checks fired."
SUMMARY_LARGE = " Its size alone matters to the statements."
SUMMARY_SMALL = " Its size alone would not matter to the statements."
SUMMARY_CLOSE = " These are screening results; they do not explain why the entry was made."
MEMO_ASSERTIONS = "If the entry is wrong, {assertions} would be affected first, so aim the tests there."
MAGNITUDE_LARGE = "{amount} is over the materiality figure of this engagement: size by itself calls for a test."
MAGNITUDE_SMALL = "{amount} is under the materiality figure of this engagement: test it for its kind, not its size."
MAGNITUDE_OPEN = "No comparison with a materiality figure is on file for {amount}; weigh size and kind together."
LIKELIHOOD_MANY = ("Separate checks point at the same entry, so chance is a weaker explanation for it than for "
                   "most; take it early.")
LIKELIHOOD_FEW = "Number of checks behind this entry: {n}. The usual review steps should be enough to settle it."
MEMO_CONTROLS = "Ask how {components} should have prevented or shown an entry like this one, and test that it did."
FOLLOW_UP_BASE = ["Match the entry to its source document and to the payment or receipt behind it",
                  "Ask for an explanation of the entry and keep the answer together with its evidence",
                  "Find out who entered and who approved it, and whether the duties were kept apart"]
FOLLOW_UP_CONDITIONAL = [
    (("new vendor",), "Search the vendor master for when, how and by whom this vendor was added"),
    (("missing description", "weak documentation"), "Have the reason for the entry written down and test it against other records"),
    (("near approval",), "Add up this vendor's entries of the same weeks and hold the sum against the approval limit"),
    (("weekend posting",), "Look up the log-in times of that day and who was scheduled to work"),
    (("unusual amount",), "Chart the account's entries of the year and explain where this one lies"),
]
FOLLOW_UP_OVERRIDE = "Test the entry and its neighbours as one group, since several checks met on it"

# Request text for an externally written memo: the facts of the row under this library's labels.
PROMPT_HEAD = "Company kind: {entity}\nBooks: {start} to {end}\nOne ledger entry\n"
PROMPT_SUMMARY = "Say in one or two careful sentences what a reviewer should look at."
PROMPT_MEMO = "Answer with one JSON object that has the seven memo fields."
