import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SF, odd_docs
from tokenizers import AddedToken, Tokenizer, normalizers, pre_tokenizers

import __spark_entry__ as E
from ledgerlens.llm import separators as S
from ledgerlens.llm import tokenfile as T
from ledgerlens.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(docs, library, end_id):
    out, start = [], 0
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 1023, 1024, 1025, 40_000):
        for high in (0, 1, 300, 50_000, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype="u4", endpoint=True)
            if n > 100:
                ids[rng.integers(0, n, 9)] = 4_000_000_000
            data = T.pack(ids)
            assert (T.unpack(data) == ids).all() and len(T.unpack(data)) == n
            assert (T.unpack(data, 2, 5) == ids[2048:5120]).all()
    rare = np.full(1024, 5, "u4")
    rare[::100] = 1 << 30       # outliers go to the exception list, the block stays narrow
    assert len(T.pack(rare)) < 200
    with pytest.raises(ValueError):
        T.unpack(b"x" * 40)


def test_numbers_of_every_width():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2**32, (3, 16), dtype="u4")
    for w in range(1, 33):
        low = rows & np.uint32(2**w - 1)
        bits = ["".join(format(x, f"0{w}b") for x in row) for row in low.tolist()]
        data = T.narrow(rows, w)
        assert [x.tobytes() for x in data] == [int(x, 2).to_bytes(2 * w, "big") for x in bits]
        assert (T.widen(data, w) == low).all()


def test_chunks_encode_as_the_whole_text(library):
    rng = np.random.default_rng(1)
    bits = [" ", "  ", "\n", "\t", "a", "bc", "the", "'s", "é", "日", "😀", "1", ",", "<|endoftext|>", " ", "　", "​", "\x85"]
    own = T.ChunkEncoder(PATH)
    for _ in range(300):
        texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(5)] + [None]
        want = [np.array(library.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert list(own.encode(pa.array(texts, pa.string()), together=7)) == want


def test_new_words_reach_the_library_together(library):
    words = [f"{x}{k}" for k in range(200) for x in ("word", "of.\nLine", "Tab\tß", "'s,", "a\n\nb<|endoftext|>")]
    own, given = T.ChunkEncoder(PATH), []
    whole = own.whole
    own.whole = lambda texts: given.extend(texts) or whole(texts)
    texts = ["x " + " ".join(words[a:a + 100]) for a in range(0, 1000, 100)]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(own.encode(pa.array(texts))) == want
    assert len(given) < 30 and len("".join(given)) <= sum(len(x) + 1 for x in words) + 4
    given.clear()
    assert list(own.encode(pa.array(texts))) == want and not given     # known words are not asked for again
    own.tails.most = 20
    for _ in range(3):
        assert list(own.encode(pa.array(texts))) == want
    with pytest.raises(ValueError):
        own.joined(["a", "b c"])


def test_tokenizers_that_do_not_cut_at_blanks_get_whole_texts(tmp_path):
    texts = ["one two three four", " the  end.\n the end", "", "ﬁn e\u0301t\u00e9 of it"]

    def added(x):
        x.add_tokens([AddedToken("two three", normalized=False), AddedToken(".", lstrip=True, rstrip=True)])

    def normal(x):
        x.normalizer = normalizers.Replace(" t", "x")

    def prefix(x):
        x.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)

    for k, change in enumerate((added, normal, prefix)):
        other = Tokenizer.from_file(PATH)
        change(other)
        other.save(str(tmp_path / f"{k}.json"))
        want = [np.array(other.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert list(T.ChunkEncoder(str(tmp_path / f"{k}.json")).encode(pa.array(texts))) == want
    assert T.starts_at_blanks(PATH)


def test_query_equals_library(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in E.queries()["op7_tokenfile"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(docs, library, 2)


def test_odd_rows_in_small_segments(spark, library):
    docs = odd_docs(spark, "start")
    path = scratch_path(spark, "test-tokens")
    T.write(docs, path, PATH, 2, segment=50)
    got = sorted((tuple(r) for r in T.read(spark, path).collect()), key=lambda r: r[1])
    ids = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [i for i, _ in ids]
    assert sorted(x[2:] for x in got) == sorted(x[2:] for x in expected(ids, library, 2))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    empty = scratch_path(spark, "test-tokens")
    T.write(docs.limit(0), empty, PATH, 2)
    assert T.read(spark, empty).count() == 0


@pytest.mark.parametrize("block", [11, 1 << 20])
def test_separator_scan(spark, library, block):
    docs = odd_docs(spark)
    path = scratch_path(spark, "test-flat")
    S.write_flat(docs.where("doc_id < 10 or doc_id is null"), path, RANKS, public_tokenizers.PATTERN, 50256, block, ordered=True)
    rows = docs.where("doc_id < 10 or doc_id is null").collect()
    got = sorted(S.counts(spark.read.parquet(path), 50256).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in got] == list(range(len(rows))) and all(r.closed for r in got)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    size = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows}
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    assert all(r.n_tokens == size[r.doc_id] for r in got)


def test_separator_query(spark, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in E.queries()["op8_separators"](spark, SF).collect())
    assert got == [(i, n, True) for i, _, n, _ in expected(docs, library, 50256)]


def test_plain_files_with_open_tail_and_empty_blocks(spark, tmp_path):
    np.array([1, 2, 9, 9, 3], "<u2").tofile(tmp_path / "a")
    np.array([], "<u2").tofile(tmp_path / "b")
    np.array([4, 9, 5, 6], "<u2").tofile(tmp_path / "c")
    for block in (1, 2, 100):
        got = sorted(tuple(r) for r in S.counts(S.read_files(spark, str(tmp_path), block), 9).collect())
        assert got == [(0, 0, 3, True), (1, 3, 1, True), (2, 4, 3, True), (3, 7, 2, False)]
    assert S.counts(spark.createDataFrame([], "file int, block int, payload binary"), 9).count() == 0
