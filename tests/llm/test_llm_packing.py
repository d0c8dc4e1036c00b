import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SF, odd_docs
from tokenizers import Tokenizer

import __spark_entry__ as E
from ledgerlens.llm import packing as P
from ledgerlens.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(sizes, capacity):
    """Remaining capacities after best-fit decreasing, piece by piece."""
    left = []
    for size in sorted(sizes, reverse=True):
        fit = [k for k, r in enumerate(left) if r >= size]
        if fit:
            left[min(fit, key=lambda k: left[k])] -= size
        else:
            left.append(capacity - size)
    return sorted(left)


def expected(docs, library, capacity):
    """doc_id, piece, start, length, crc of every piece."""
    out = []
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                for k, a in enumerate(range(0, len(ids), capacity))]
    return Counter(out)


def check_layout(rows, capacity):
    """Sequences are gapless from 0, none is over capacity, and there are as many as best fit makes."""
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in x) for x in spans.values()) == one_by_one([r.length for r in rows], capacity)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_packing_one_by_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 130))
    sizes = rng.integers(1, capacity, rng.integers(1, 500), endpoint=True)
    if seed % 2:
        sizes = np.minimum(sizes, rng.integers(1, 1 + capacity // 3 + 1, len(sizes)))
    runs = P.best_fit(Counter(sizes.tolist()), capacity)
    fill, seen = defaultdict(list), Counter()
    for length, first, n, each, sequence, begin in runs:
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            fill[sequence + k // each].append((begin + k % each * length, length))
    assert seen == Counter(sizes.tolist())
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in x) for x in fill.values()) == one_by_one(sizes, capacity)


def test_runs_are_bounded_for_any_number_of_pieces():
    rng = np.random.default_rng(0)
    few = len(P.best_fit({n: int(c) for n, c in enumerate(rng.integers(1, 10, 2048), 1)}, 2048))
    many = len(P.best_fit({n: int(c) for n, c in enumerate(rng.integers(1, 10**9, 2048), 1)}, 2048))
    assert few < 40_000 and many < 40_000
    assert P.best_fit({}, 2048) == []


def test_words_encode_as_the_whole_text():
    library, own = Tokenizer.from_file(PATH), P.WordEncoder(PATH)
    assert own.words is not None
    rng = np.random.default_rng(1)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "Bc", "The", "'s", "'S", "é", "é", "İ", "Σ", "É", "ß", "h\u0331", "H\u0331", ".", "?!", "日本", "😀", "1", ",", "<|endoftext|>",
            "<|startoftext|>", "<|", "　", "\x85", "​", "ﷺ", "가"]
    for _ in range(300):
        texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(5)] + [None]
        want = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert [x.tolist() for x in own.encode(pa.array(texts, pa.string()), together=7)] == want


def test_other_tokenizers_get_whole_texts(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not P.cuts_at_blanks(path)
    library, own = Tokenizer.from_file(path), P.WordEncoder(path)
    texts = ["a  b\n c", None, "", " x"]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [library.encode(x or "").ids for x in texts]
    model = json.load(open(PATH, encoding="utf-8"))
    model["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(model))
    assert not P.cuts_at_blanks(str(tmp_path / "t.json"))


def test_odd_rows(spark):
    docs = odd_docs(spark, "part place length sequence_id offset start piece payload base first")
    path = scratch_path(spark, "test-pieces")
    P.write(docs.repartition(5), path, PATH, 0, capacity=100)
    rows = P.assign(spark.read.parquet(path), 100).collect()
    want = expected([(r.doc_id, r.text) for r in docs.collect()], Tokenizer.from_file(PATH), 100)
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.payload)) for r in rows) == want
    check_layout(rows, 100)
    for s in P.sequences(spark, path, 100).collect():
        assert len(s.payload) == 4 * s.n_tokens and s.n_tokens <= 100
        own = [(x.doc_id, x.piece, x.start, x.length, zlib.crc32(s.payload[4 * x.offset:4 * (x.offset + x.length)])) for x in s.spans]
        assert all(x in want for x in own) and sum(x[3] for x in own) == s.n_tokens
    empty = scratch_path(spark, "test-pieces")
    P.write(docs.limit(0), empty, PATH, 0)
    assert P.assign(spark.read.parquet(empty)).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = E.queries()["op13_packing"](spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected(docs, Tokenizer.from_file(PATH), 2048)
    check_layout(rows, 2048)
