import math
import random

import pytest

from ledgerlens.operators.clean import clean_gl
from ledgerlens.operators.exact import sum_by
from ledgerlens.operators.integrity import cross_footing, hash_total
from ledgerlens.operators.stats import compute_stats
from ledgerlens.operators.summary import top_accounts

CASES = {
    "small": [4e-11, 4e-11, 1e-5], "large": [1e18, 1.0, -1e18, 4e-11], "huge": [1e30, 1e30, 0.1, -1e30], "extreme": [1e300, -1e300, 5e-324, 1.5],
    "tiny": [5e-324] * 7 + [2.2250738585072014e-308], "cents": [0.1] * 1000 + [0.2] * 17, "powers": [2.0**k for k in range(-200, 200, 7)],
    "edges": [s * math.nextafter(2.0**k, d) for k in (-48, -24, 0, 24, 48) for d in (0.0, math.inf) for s in (1, 1, -1)],
    "zeros": [0.0, -0.0], "missing": [None, None], "some": [None, 3.25], "over": [1.7e308, 1.7e308],
}


@pytest.mark.parametrize("seed", [0, 1])
def test_sums_equal_fsum_in_any_order(spark, seed):
    rng = random.Random(seed)
    cases = CASES | {"mixed": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(400)]}
    rows = [(k, x) for k, v in cases.items() for x in v]
    rng.shuffle(rows)
    got = {r.k: r.s for r in sum_by(spark.createDataFrame(rows, "k string, x double").repartition(7), ["k"], "x", "s").collect()}
    want = {k: math.fsum(x for x in v if x is not None) for k, v in cases.items() if k != "over"} | {"over": math.inf}
    assert got == want


def test_totals_of_a_ledger_are_exact(spark, ledger):
    def row(amount, debit, credit, account="a"):
        return ("2024-01-05", amount, "6000", account, "v", "d", "j", debit, credit)
    cols = ["date", "amount", "account_code", "account_name", "vendor", "description", "journal_ref", "debit_amount", "credit_amount"]
    rows = [row("1e18", "1e18", "0"), row("-1e30", "", "1e30", "b"), row("4e-11", "4e-11", ""), row("0.1", "0.1", ""), row("-0.3", "0", "0.3")]
    st = compute_stats(clean_gl(ledger(rows, cols)))
    assert st.globals["sum_abs"] == math.fsum([1e18, 1e30, 4e-11, 0.1, 0.3]) and st.globals["abs_less_debit_credit"] == 0.0
    assert st.globals["debit_less_credit"] == math.fsum([1e18, 4e-11, 0.1, -1e30, -0.3])
    assert hash_total(st).first().status == "Pass" and cross_footing(st).first().status == "Warning"
    assert {r.account_name: r.month_sum for r in st.month.collect()} == {"a": math.fsum([1e18, 4e-11, 0.1, 0.3]), "b": 1e30}
    assert st.vendor.first().vendor_disb == math.fsum([1e18, 4e-11, 0.1])
    off = compute_stats(clean_gl(ledger([row("1e18", "1e18", ""), row("1e18", "1e18", ""), row("0.02", "", "")], cols)))
    assert off.globals["abs_less_debit_credit"] == 0.02 and hash_total(off).first().status == "Warning"


def test_merged_moments(spark, ledger):
    amounts = [1e9 + k / 7 for k in range(40)] + [5.0, -5.0]
    rows = [(f"2024-0{1 + k % 9}-05", repr(a), str(6000 + k % 3), "a" if k < 40 else "b", f"v{k % 4}", "d", "j") for k, a in enumerate(amounts)]
    st = compute_stats(clean_gl(ledger(rows)))
    got = {r.account_name: r for r in st.account.collect()}
    mean = math.fsum(amounts[:40]) / 40
    sd = math.sqrt(math.fsum((a - mean) ** 2 for a in amounts[:40]) / 40)
    assert got["a"].acc_mean == mean and abs(got["a"].acc_sd - sd) < 1e-6 and got["a"].acc_n == 40 and got["a"].acc_max == amounts[39]
    assert got["b"].acc_sd == 0.0 and got["b"].acc_min == got["b"].acc_max == 5.0
    empty = compute_stats(clean_gl(ledger([])))
    assert empty.globals["n_rows"] == 0 and empty.globals["sum_abs"] == 0.0 and empty.account.count() == 0


def test_top_accounts_sum_any_amount(spark):
    rows = [("a", 1e30, "Flagged"), ("a", 4e-11, "Flagged"), ("b", 1e18, "Flagged"), ("b", -0.5, "Flagged"), ("c", 9.0, "Clear"), (None, 1.0, "Flagged")]
    df = spark.createDataFrame(rows, "account_name string, abs_amount double, flagged_status string")
    assert [tuple(r) for r in top_accounts(df).collect()] == [("a", 1e30), ("b", 1e18)]
