"""Memo validator: rule memos pass; the six faults are rejected with the right reason."""
import json

from pyspark.sql import functions as F

from ledgerlens.constants import DISCLAIMER
from ledgerlens.operators.memos import full_memo, validate_memos


def _good():
    return {"risk_summary": "The posting shows a weekend entry and a round amount that warrant follow-up.",
            "assertion_consideration": "The pattern bears on the Occurrence assertion for this posting.",
            "magnitude_assessment": "At $9,700.00 the amount is below the threshold.",
            "likelihood_assessment": "With two indicators present, a moderate level of review is indicated.",
            "control_or_coso_consideration": "The pattern mainly concerns Control Activities and approvals.",
            "recommended_follow_up": ["Inspect the invoice and documents", "Confirm receipt of the goods",
                                      "Discuss the entry with management"],
            "disclaimer": DISCLAIMER}


def _check(spark, memos):
    rows = [(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(memos)]
    df = spark.createDataFrame(rows, "position int, memo_json string")
    return [(r["is_valid"], r["reason"]) for r in validate_memos(df).orderBy("position").collect()]


def test_mutants(spark):
    g = _good()
    missing = dict(g); del missing["likelihood_assessment"]
    wrong_type = dict(g, recommended_follow_up="one; two; three")
    few = dict(g, recommended_follow_up=["Inspect the invoice", "Confirm the receipt"])
    banned = dict(g, risk_summary=g["risk_summary"] + " This proves fraud.")
    disc = dict(g, disclaimer="Indicative only.")
    leak = dict(g, control_or_coso_consideration=g["control_or_coso_consideration"] + " The CFO approved it.")
    extra = dict(g, note="x")
    out = _check(spark, [g, missing, wrong_type, few, banned, disc, leak, extra, "[1, 2]", "not json",
                         dict(g, magnitude_assessment="short"), dict(g, risk_summary=5)])
    assert out[0] == (True, "")
    assert out[1] == (False, "missing keys: ['likelihood_assessment']")
    assert out[2] == (False, "recommended_follow_up must be a list, got str")
    assert out[3] == (False, "recommended_follow_up has 2 items, expected 3-5")
    assert out[4] == (False, "banned phrase detected: 'this proves fraud'")
    assert out[5] == (False, "disclaimer does not match the required verbatim string")
    assert out[6] == (False, "name-leakage pattern detected: 'the cfo'")
    assert out[7] == (False, "extra keys: ['note']")
    assert out[8] == (False, "top-level value is not a JSON object (got list)")
    assert out[9] == (False, "not valid JSON")
    assert out[10] == (False, "magnitude_assessment length 5 out of bounds [30, 500]")
    assert out[11] == (False, "risk_summary must be a string, got int")


def test_rule_memos_always_valid(spark):
    flags = ["Statistical anomaly only", "New vendor", "Weekend posting; Missing description",
             "Unusual amount for account; Round number amount; Weekend posting; Missing description; "
             "New vendor; Near approval threshold", None, ""]
    rows = [(i, f, a, o, k, ann) for i, f in enumerate(flags) for a in (None, -5.0, 123456.789)
            for o in (0, 1) for k in (0, 1)
            for ann in ("Exceeds Transaction Materiality", "Below Performance Materiality", None)]
    df = spark.createDataFrame(rows, "i int, active_flags string, amount double, "
                               "is_qualitative_override int, fraud_risk_flag int, materiality_annotation string")
    memos = df.select(F.to_json(full_memo()).alias("memo_json"))
    bad = validate_memos(memos).filter(~F.col("is_valid")).select("reason").distinct().collect()
    assert bad == []


def test_each_candidate_is_parsed_once(spark):
    df = spark.createDataFrame([(0, json.dumps(_good()))], "position int, memo_json string")
    checked = validate_memos(df)
    assert checked.columns == ["position", "memo_json", "is_valid", "reason"]
    for df in (checked, checked.filter(~F.col("is_valid"))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson(memo_json") == 1


def test_odd_values_and_blanks(spark):
    g = _good()
    wide = "\u2003\u00a0\u3000\n"
    out = _check(spark, [
        dict(g, risk_summary=wide + g["risk_summary"] + wide, disclaimer=wide + DISCLAIMER + "\x85"),
        dict(g, risk_summary=wide), dict(g, risk_summary=None), dict(g, recommended_follow_up={"a": 1}),
        dict(g, recommended_follow_up=g["recommended_follow_up"][:2] + [7]),
        dict(g, recommended_follow_up=[wide] + g["recommended_follow_up"][1:]), '{"risk_summary": [1]}', "5", ""])
    assert out == [
        (True, ""), (False, "risk_summary is empty"), (False, "risk_summary must be a string, got NoneType"),
        (False, "recommended_follow_up must be a list, got dict"), (False, "recommended_follow_up[2] must be a string"),
        (False, "recommended_follow_up[0] is empty"),
        (False, "missing keys: ['assertion_consideration', 'control_or_coso_consideration', 'disclaimer', "
                "'likelihood_assessment', 'magnitude_assessment', 'recommended_follow_up']"),
        (False, "top-level value is not a JSON object (got int)"), (False, "not valid JSON")]


def test_phrases_are_tested_by_compiled_steps(spark):
    """The first phrase of the list wins, not the first in the text; no phrase is looked for by an interpreted function."""
    from ledgerlens.operators.memos import phrase_scan
    texts = ["The Manager stole; this PROVES fraud.", "Mr. X, definitively", "ms x", "", None, "this is frau", "MS. Y and the ceo"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    banned, leak = phrase_scan(F.col("t"))
    found = df.select("i", banned.alias("banned"), leak.alias("leak"))
    assert [(r.banned, r.leak) for r in found.orderBy("i").collect()] == [
        ("this proves fraud", "the manager"), ("definitively", "mr."), (None, None), (None, None), (None, None), (None, None),
        (None, "the ceo")]
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_queue_is_ranked_once_for_candidates_and_memos(spark, monkeypatch, tmp_path):
    """The tallies sorted and wrote the whole queue twice."""
    from ledgerlens.operators import memos as M
    from ledgerlens.plans import catalog as K
    queue = spark.createDataFrame([(i, f"j{i}", None, "acc", "v", 10.0 * i, -0.1 * (i % 3), "Low", "High", "label", "note",
                                    "Round number", 0, 0, 0.0, 0.0, 0, 0, 0.1, 0, "", 0, "") for i in range(22)],
                                  "row_id long, journal_ref string, date date, account_name string, vendor string, amount double, "
                                  "anomaly_score double, raw_tier string, final_tier string, pcaob_label string, "
                                  "materiality_annotation string, active_flags string, control_gap_score int, fraud_risk_flag int, "
                                  "period_over_period_pct double, vendor_concentration_pct double, is_year_end_concentration int, "
                                  "is_non_standard_pattern int, fraud_probability double, is_qualitative_override int, "
                                  "qualitative_override_note string, is_supervised_escalation int, supervised_escalation_note string")
    monkeypatch.setattr(K, "_queue", lambda spark, sf_dir: queue)
    ranked, rank = [], M.memo_rank
    monkeypatch.setattr(M, "memo_rank", lambda *a: ranked.append(a) or rank(*a))
    tallies = K.QUERIES["memo_tallies"](spark, "unused").first()
    assert len(ranked) == 1
    assert (tallies.top_n_used, tallies.n_gpt, tallies.n_fallback) == (22, 2, 20)
