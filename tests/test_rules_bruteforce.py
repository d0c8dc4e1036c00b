"""Randomised check of the row-local rules against a plain-Python statement of them."""
import random

from ledgerlens.operators.scoring import apply_scoring

TIERS = ["Monitor", "Low", "Medium", "High"]
FLAGS = [("is_round_number", "Round number amount"), ("is_weekend_posting", "Weekend posting"),
         ("missing_description", "Missing description"), ("is_new_vendor", "New vendor"),
         ("is_near_approval_threshold", "Near approval threshold")]
PERF, TXN = 40000.0, 64000.0


def expected(raw, amt, flags, z, fp):
    a = amt if amt is not None else 0.0
    r = TIERS.index(raw)
    if a >= TXN:
        t = raw
    elif a >= PERF:
        t = TIERS[max(0, r - 1)]
    else:
        t = "Monitor"
    ffc = sum(flags)
    ov = 0
    if ffc >= 2:
        up = TIERS[min(3, r + 1)]
        if TIERS.index(up) > TIERS.index(t):
            t, ov = up, 1
    es = 0
    if fp >= 0.5 and not ov and TIERS.index(t) < 3:
        t, es = TIERS[TIERS.index(t) + 1], 1
    parts = (["Unusual amount for account"] if z is not None and abs(z) >= 2 else []) + \
        [txt for (c, txt), f in zip(FLAGS, flags) if f]
    return t, ov, es, "; ".join(parts) or "Statistical anomaly only"


def test_rules_match_plain_python(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(3000):
        raw = rnd.choice(["High", "Medium", "Low"])
        amt = rnd.choice([None, rnd.uniform(0, 100000), 40000.0, 64000.0, 39999.99])
        flags = [rnd.random() < 0.3 for _ in FLAGS]
        z = rnd.choice([None, rnd.uniform(-4, 4), 2.0, -2.0])
        fp = rnd.choice([0.0, 0.5, rnd.random()])
        rows.append((raw, amt, *[int(f) for f in flags], sum(flags), int(sum(flags) >= 2), z, fp))
    cols = ("raw_tier string, abs_amount double, " + ", ".join(f"{c} int" for c, _ in FLAGS) +
            ", fraud_flag_count int, fraud_risk_flag int, amount_zscore_by_account double, fraud_probability double")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + cols)
    got = {r["i"]: r for r in apply_scoring(df, PERF, TXN).collect()}
    for i, r in enumerate(rows):
        raw, amt, *fl, ffc, frf, z, fp = r
        t, ov, es, flags_text = expected(raw, amt, fl, z, fp)
        g = got[i]
        assert (g["final_tier"], g["is_qualitative_override"], g["is_supervised_escalation"],
                g["active_flags"]) == (t, ov, es, flags_text), (r, g)
