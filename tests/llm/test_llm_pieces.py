import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import SF, odd_docs
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as E
from ledgerlens.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op6_pieces"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_spans_cover_odd_texts(spark, library):
    docs = odd_docs(spark, "begins ends decoded")
    found = P.encode(docs, MODEL)
    rows = found.collect()
    assert len(rows) == docs.count() and rows[0]["kept"] == "mine" and "text" not in found.columns
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    for r in rows:
        text = next(iter(texts[r.doc_id]))
        assert r.ids == library.encode(text)
        raw = text.encode()
        assert r.begins[:1] in ([], [0]) and r.ends[-1:] in ([], [len(raw)]) and r.begins[1:] == r.ends[:-1]
        for i, a, b in zip(r.ids, r.begins, r.ends, strict=True):
            name = library.id_to_piece(i)
            want = bytes([int(name[3:5], 16)]) if library.is_byte(i) else name.replace("▁", " ").encode()
            assert raw[a:b] == want or a == 0 and raw[a:b] == want[1:]
    decoded = {(r.doc_id, r.decoded) for r in P.decode(found, MODEL).collect()}
    assert decoded == {(i, t) for i, own in texts.items() for t in own}
    assert P.encode(docs.limit(0), MODEL).count() == 0


def compiled(pairs: dict[bytes, bytes]) -> bytes:
    """A small double-array trie in the model's format, one block of 256 units a node."""
    nodes, strings, leaf = [{}], b"", {}
    for key, value in pairs.items():
        node = 0
        for byte in key:
            node = nodes[node].setdefault(byte, None) or nodes[node].update({byte: len(nodes)}) or nodes.append({}) or len(nodes) - 1
        leaf[node] = len(strings)
        strings += value + b"\0"
    at = {0: 0}
    units = [0] * (256 * (len(nodes) + 2))
    # children of node k stand in block k + 1, at block start xor byte; byte 0 is the leaf

    def offset(place, k):
        return place ^ (256 * (k + 1))
    todo = [0]
    while todo:
        k = todo.pop()
        place = at[k]
        units[place] |= (offset(place, k) << 10) | (0x100 if k in leaf else 0)
        if k in leaf:
            units[256 * (k + 1)] = leaf[k] | 0x80000000
        for byte, child in nodes[k].items():
            at[child] = 256 * (k + 1) ^ byte
            units[at[child]] |= byte
            todo.append(child)
    return struct.pack("<I", 4 * len(units)) + np.array(units, "<u4").tobytes() + strings


def test_longest_prefix_and_alignment():
    pairs = {"ａ".encode(): b"a", "ﬁ".encode(): b"fi", "é".encode(): "é".encode(), b"\t": b" ", b"ab": b"X", b"abc": b"Y"}
    char_map = P.CharMap(compiled(pairs))
    assert char_map.longest(b"abcd", 0) == (3, b"Y") and char_map.longest(b"abd", 0) == (2, b"X")
    assert char_map.longest(b"zab", 0) is None and char_map.longest(b"zab", 1) == (2, b"X")
    text = "ﬁ éａ\tz".encode()
    norm, at = P.Normaliser(char_map, prefix=False, strip=False, escape=False).normalise(text)
    assert norm.decode() == "fi éa z"
    assert at.tolist() == [0, 0, 3, 4, 4, 7, 10, 11, 12]
    norm, at = P.Normaliser(char_map, prefix=True, strip=True, escape=True).normalise(b"  a \t z ")
    assert norm.decode() == "▁a▁z" and at.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 7]


def test_word_by_word_is_exact(library):
    own = P.Encoder(MODEL)
    assert own.by_word
    texts = ["", " ", "a", " a", "a ", "a  b", "▁", "x ▁y z", "new\nline two\t", "the of  and", "日本 語 the"]
    assert [x.tolist() for x in own.ids(pa.array(texts))] == library.encode(texts)


def varint(value):
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def changed_model(path, pairs, symbols=()):
    """The public model without byte pieces, with a character map and user-defined symbols: fields that
    are added at the end of a message replace earlier ones."""
    out, n = b"", 0
    with open(MODEL, "rb") as f:
        whole = list(P.fields(f.read()))
    for number, value in whole:
        if number == 1:
            own = dict(P.fields(value))
            if own.get(3) == 6:
                value += varint(3 << 3) + b"\x01"
                if n < len(symbols):
                    value += varint(1 << 3 | 2) + varint(len(symbols[n])) + symbols[n] + varint(3 << 3) + bytes([P.USER_DEFINED])
                    n += 1
        elif number == 2:
            value += varint(35 << 3) + b"\0"
        elif number == 3:
            blob = compiled(pairs) if pairs else b""
            value += varint(2 << 3 | 2) + varint(len(blob)) + blob + varint(4 << 3) + bytes([bool(pairs)])
        out += varint(number << 3 | 2) + varint(len(value)) + value
    path.write_bytes(out)
    return str(path)


TEXTS = ["", " ", "plain words", "ﬁne  éclair\tａbc", "𓀀𓀁𓀂 the 𓀀𓀁", "的的x的 ", "  ab abc<sep>abc  ", "\n\u2581 é", "𝄞𝄞 end𝄞"]
PAIRS = {"ａ".encode(): b"a", "ﬁ".encode(): b"fi", b"\t": b" ", b"\n": b" ", b"abc": b"the"}


@pytest.mark.parametrize("pairs, symbols", [({}, ()), (PAIRS, ()), (PAIRS, (b"<sep>", b"abc<"))])
def test_models_with_a_map_symbols_and_unknown_characters(spark, tmp_path, pairs, symbols):
    path = changed_model(tmp_path / "changed.model", pairs, symbols)
    library = SentencePieceProcessor(model_file=path)
    assert library.unk_id() in library.encode("𓀀𓀁𓀂")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in P.encode(docs, path, decoded=True).collect()}
    for k, text in enumerate(TEXTS):
        r, raw = rows[k], text.encode()
        assert r.ids == library.encode(text) and r.decoded == library.decode(r.ids)
        for piece, a, b in zip(library.encode(text, out_type=str), r.begins, r.ends, strict=True):
            assert 0 <= a <= b <= len(raw)
            if piece in ("<sep>", "𓀀𓀁𓀂", "𓀀𓀁"):
                assert raw[a:b].decode() == piece
        normal = P.Encoder(path).normaliser.normalise(raw)[0].decode()
        assert "".join(library.encode(text, out_type=str)) == normal
