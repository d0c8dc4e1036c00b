import re

from helpers import WORDS, base_counts, divergence, odd_docs, same_as_oracle

from ledgerlens.llm import quality_rules as Q


def test_oracle(spark):
    same_as_oracle(spark, "op4_quality_rules")


def brute(rows, rules):
    def classes(text):
        kept = [len(re.sub(runs, "", text or "")) for runs in Q.CLASS_RUNS.values()]
        return [base_counts(text)[1] - sum(kept), *kept]
    refs = {}
    for lang in {r.lang for r in rows}:
        own = [r.text or "" for r in rows if r.lang == lang]
        sums = [sum(x) for x in zip(*[classes(t) for t in own if base_counts(t)[1] >= rules.min_chars], strict=True)]
        words = [w for t in own if len(WORDS.findall(t)) >= rules.min_words for w in WORDS.findall(t)]
        if not sums or len(words) < rules.min_reference_words:
            continue
        n = {}
        for w in words:
            n[w] = n.get(w, 0) + 1
        top = sorted((w for w in n if w.isalpha()), key=lambda w: (-n[w], w))[:rules.n_common]
        marks = sum(c for w, c in n.items() if not any(ch.isalpha() for ch in w))
        p = [n[w] / len(words) for w in top] + [marks / len(words)]
        refs[lang] = ([x / sum(sums) for x in sums], top, [*p, 1 - sum(p)])
    out = {}
    for r in rows:
        words, counts = WORDS.findall(r.text or ""), base_counts(r.text)
        failed = counts[0] < rules.min_n_words or 100 * counts[4] > rules.max_repeat_pct * counts[0]
        js = (None, None)
        if len(words) >= rules.min_words and counts[1] >= rules.min_chars and r.lang in refs:
            ref_c, top, ref_p = refs[r.lang]
            h = [words.count(w) / len(words) for w in top]
            h.append(sum(not any(c.isalpha() for c in w) for w in words) / len(words))
            js = (divergence([x / counts[1] for x in classes(r.text)], ref_c), divergence([*h, 1 - sum(h)], ref_p))
        bad = js[0] is not None and (js[0] > rules.max_class_js or js[1] > rules.max_word_js)
        out.setdefault(r.doc_id, set()).add((*counts, *(None if x is None else round(x, 6) for x in js), failed, not failed and not bad))
    return out


def test_odd_rows_equal_brute_force(spark):
    docs = odd_docs(spark)
    rules = Q.Rules(min_reference_words=20)
    got = Q.apply_rules(docs, rules)
    assert set(docs.columns) - set(Q.ADDED) <= set(got.columns) and got.select("_t").distinct().collect()[0][0] == "mine"
    rows = got.collect()
    want = brute(docs.select("doc_id", "text", "lang").collect(), rules)
    assert len(rows) == docs.count()
    for r in rows:
        js = [None if x is None else round(x, 6) for x in (r.class_js, r.word_js)]
        assert want[r.doc_id] == {(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, *js, r.base_failed, r.kept)}


def test_empty_table(spark):
    assert Q.apply_rules(odd_docs(spark).limit(0)).count() == 0


def test_verdicts_survive_a_filter(spark):
    docs = odd_docs(spark)
    rules = Q.Rules(min_reference_words=20)
    kept = Q.apply_rules(docs, rules)
    assert kept.where("kept").count() == sum(r.kept for r in kept.collect())


def test_common_words_of_any_length(spark):
    words = ["nicht"] * 30 + ["w" * 5000] * 20 + ["zwischen"] * 10 + ["---------"] * 5 + [f"x{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(words), "de") for k in range(12)], "doc_id long, text string, lang string")
    rules = Q.Rules(min_reference_words=20, n_common=3)
    ref = Q.references(docs, rules).first()
    assert ref.ref_words == ["nicht", "w" * 5000, "zwischen"]
    assert [round(105 * x) for x in ref.ref_p] == [30, 20, 10, 5, 40]
    assert {r.word_js for r in Q.apply_rules(docs, rules).collect()} == {0.0}
