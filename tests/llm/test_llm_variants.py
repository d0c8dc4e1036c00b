import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, odd_docs

import __spark_entry__ as E
from ledgerlens.llm import variants as V


def counted(docs, slips=True):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            total[run] += 1
    return total


def grouped(total, min_length=6, min_count=5):
    """Brute force: words that share a gap pattern, checked letter by letter."""
    n = {w: c for w, c in total.items() if len(w) >= min_length and c >= min_count}
    holes = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k] + "*" + w[k + 1:]].add(w)       # replaced letters meet here
            holes[w[:k] + w[k + 1:]].add(w)             # inserted ones here
        holes[w].add(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    near = defaultdict(set)
    for some in holes.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_one_edit_and_tree():
    rng = np.random.default_rng(0)
    some = sorted({"".join(rng.choice(list("abcé"), 6)) for _ in range(700)})
    longer = sorted({"".join(rng.choice(list("abcé"), 7)) for _ in range(700)})
    tree = V.Tree(longer)
    assert len(tree.nodes) > 20

    def pairs(a, b):
        return {(x, y) for x in a for y in b if (sum(p != q for p, q in zip(x, y, strict=True)) == 1 if len(x) == len(y)
                                                 else any(y[:k] + y[k + 1:] == x for k in range(len(y))))}
    for asked in (some, longer):
        found = [(asked[i], longer[j]) for q, p in tree.near(V.codes(asked)) for i, j in zip(q, p, strict=True)]
        assert len(found) == len(set(found)) and set(found) == pairs(asked, longer)


@pytest.mark.parametrize("leaf_rows,sample_rows", [(1 << 15, 1 << 16), (20, 200), (3, 60)])
def test_leaves_lose_no_pair(spark, leaf_rows, sample_rows):
    rng = np.random.default_rng(3)
    some = ["".join(rng.choice(list("abcdef"), rng.integers(4, 8))) for _ in range(700)]
    rows = [(i, " ".join(rng.choice(some, 60)) + " abcabc" * 30) for i in range(80)]
    rows += [(99, ("x" * 300 + " ") * 5 + ("x" * 299 + "y ") * 30 + ("x" * 298 + "yy ") * 200)]     # a chain of long words
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = V.group(df, 4, 2, leaf_rows=leaf_rows, sample_rows=sample_rows)
    want = grouped(counted(rows, slips=False), 4, 2)
    assert rows_of(got) == want and any(w[2] != w[1] for w in want if w[1])


def test_chains_of_forms(spark):
    chain = [("a" * k + "bcdefgh", 3 * 5 ** k) for k in range(6)]
    df = spark.createDataFrame([(1, " ".join((w + " ") * n for w, n in chain))], "doc_id long, text string")
    got = rows_of(V.group(df, slips_every=None, min_count=1))
    assert got == grouped(Counter(dict(chain)), min_count=1) and {r[2] for r in got} == {chain[-1][0]}


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark, "word n form near cell own reached")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = V.group(docs, 2, 1, slips_every=199, leaf_rows=4)
    assert rows_of(got) == grouped(counted(rows), 2, 1)
    assert V.group(docs.limit(0)).count() == 0
    assert V.group(docs.where("doc_id < 3")).count() == 0


def test_query_against_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = grouped(counted(rows))
    assert rows_of(E.queries()["op12_variants"](spark, sf)) == want and sum(r[1] is not None for r in want) > 100
