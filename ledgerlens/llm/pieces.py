"""SentencePiece encoding with byte offsets into the original text, and decoding.

The model's own compiled character map (a double-array trie of UTF-8 prefixes and a block
of replacement strings) is read from the model file. ``normalise`` walks a text by the
longest prefix the map holds and records, for each normalised byte, the original byte it
came from; the dummy prefix and escaped spaces are part of that alignment. Every piece of
the encoding is then projected from its normalised bytes to its original byte span. The
piece ids are the sentencepiece library's for the same text, checked against the alignment:
the pieces' bytes must cover the normalised text exactly.

A task loads the model once and works batch by batch (Arrow batches are bounded in rows and
bytes); nothing is shuffled. The model file is a path parameter that every machine must be
able to open.

Characters outside the vocabulary of a model without byte pieces become its unknown piece, one for a
run of them; its span is that run. Symbols that a model's user defined are left as they stand by the
character map.

Defined cases: texts of any length are encoded whole; null and empty texts have no pieces and decode to the empty text; repeated
rows are each encoded; an empty table gives an empty result; columns whose names clash with
the results are replaced, others pass through.
"""
from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from ledgerlens.llm.chunks import Gather, Memory, flat_ids, known_texts, slices, words_of

SPACE = "▁".encode()
USER_DEFINED = 4        # type of a piece in the model file


class CharMap:
    """A compiled character map: little-endian length of the trie, its units, the strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``text[at:]`` in the map, and its replacement."""
        best, node = None, 0
        if not self.units:
            return None
        unit = self.units[0]
        for k in range(at, len(text)):
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            node ^= text[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            if unit >> 8 & 1:
                leaf = self.units[node ^ ((unit >> 10) << ((unit & 0x200) >> 6))] & 0x7FFFFFFF
                best = (k + 1 - at, self.strings[leaf:self.strings.index(b"\0", leaf)])
        return best


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class Normaliser:
    """The normaliser settings of a model: character map, dummy prefix, white-space rules."""

    def __init__(self, char_map: CharMap, prefix: bool = True, strip: bool = True, escape: bool = True,
                 symbols: tuple[bytes, ...] = ()):
        self.char_map, self.prefix, self.strip, self.escape = char_map, prefix, strip, escape
        self.symbols = re.compile(b"|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None

    @classmethod
    def of_model(cls, model: bytes) -> Normaliser:
        spec = dict(fields(next((v for k, v in fields(model) if k == 3), b"")))
        listed = [dict(fields(v)) for k, v in fields(model) if k == 1]
        symbols = tuple(x[1] for x in listed if x.get(3) == USER_DEFINED)
        return cls(CharMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), symbols)

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte offset."""
        space = SPACE if self.escape else b" "
        if not text:
            return b"", np.zeros(1, "i8")
        out, k = [], 0
        while k < len(text):
            symbol = self.symbols and self.symbols.match(text, k)
            found = None if symbol else self.char_map.longest(text, k)
            if symbol:
                size, new = len(symbol[0]), symbol[0]
            elif found:
                size, new = found
            else:
                size = 1 + (text[k] >= 0xC0) + (text[k] >= 0xE0) + (text[k] >= 0xF0)
                new = text[k:k + size]
            out.append((new, k, bool(found)))
            k += size
        chars = []      # (bytes, original offset, original end) after white-space rules
        for n, (new, start, mapped) in enumerate(out):
            end = out[n + 1][1] if n + 1 < len(out) else len(text)
            for j, byte in enumerate(new):
                one = new[j:j + 1]
                if self.strip and byte == 0x20 and (not chars or chars[-1][0] == b" "):
                    continue
                chars.append((one, start if mapped else start + j, end))
        while self.strip and chars and chars[-1][0] == b" ":
            chars.pop()
        if not chars:
            return b"", np.zeros(1, "i8")
        norm, at = [], []
        if self.prefix:
            norm.append(space)
            at += [chars[0][1]] * len(space)
        for one, start, _ in chars:
            new = space if one == b" " else one
            norm.append(new)
            at += [start] * len(new)
        return b"".join(norm), np.array([*at, chars[-1][2]], "i8")

    def aligned(self, texts: list[bytes]) -> tuple[list[int], np.ndarray]:
        """For a model without character map and white-space removal: the normalised length of every
        text, and for each normalised byte of all texts the original one, in sequence."""
        lead = len(SPACE if self.escape else b" ") if self.prefix else 0
        raw = np.frombuffer(b"".join(texts), "u1")
        width = np.ones(len(raw), "i8")
        if self.escape:
            width[raw == 0x20] = len(SPACE)
        full = np.array([len(x) for x in texts], "i8")
        width[(np.cumsum(full) - full)[full > 0]] += lead
        lengths = np.concatenate([[0], np.cumsum(width)])[np.cumsum(full)]
        return np.diff(lengths, prepend=0).tolist(), np.repeat(np.arange(len(raw)), width)


class Encoder:
    """Encodes batches of texts. Where no piece of the model holds a blank behind another character,
    merges never cross from word to word; then the words of a text whose blanks are single encode
    as they do alone, and each distinct word is asked for once. Other texts are encoded whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser.of_model(self.model.serialized_model_proto())
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.width = np.array([1 if self.model.is_byte(i) else len(x.encode()) for i, x in enumerate(names)], "i4")
        rules = self.normaliser
        self.plain = not rules.char_map.units and not rules.strip
        self.unknown = self.model.unk_id()
        # a blank that is itself unknown would join the unknown runs of two words
        self.by_word = self.plain and self.model.piece_to_id("\u2581") != self.unknown and rules.prefix and rules.escape and not any(
            "\u2581" in x.lstrip("\u2581") or x.startswith("\u2581\u2581") and x.strip("\u2581") for x in names)
        self.words = Memory()

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Piece ids of every text."""
        if not self.by_word:
            return [np.array(x, "<u4") for x in self.model.encode([x or "" for x in texts.to_pylist()], num_threads=1)]
        self.words.trim()
        at, words, edge = words_of(texts)
        distinct = words.to_pylist()
        usable = [bool(x) and "\u2581" not in x for x in distinct]
        ids = self.words.ids(distinct, usable, lambda new: self.words.learn(
            new, lambda chunks: flat_ids(self.model.encode(chunks, num_threads=1))))
        plain = known_texts(ids, at, edge)
        flat, ends = Gather(ids)(at)
        ends = np.concatenate([[0], ends])
        whole = np.flatnonzero(~plain)
        other = dict(zip(whole, self.model.encode([texts[int(k)].as_py() or "" for k in whole], num_threads=1), strict=True))
        return [flat[ends[a]:ends[b]] if ok else np.array(other[k], "<u4")
                for k, (a, b, ok) in enumerate(zip(edge[:-1], edge[1:], plain, strict=True))]

    def spans(self, texts: pa.Array, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every piece, all texts in sequence, in the UTF-8 bytes of its text."""
        raw = [(x.as_py() or "").encode() for x in texts]
        if self.plain:      # one alignment for all texts
            joined, at = self.normaliser.aligned(raw)
            before = np.cumsum([0, *map(len, raw)])[:-1]
        else:
            found = [self.normaliser.normalise(x) for x in raw]
            joined = [len(x) for x, _ in found]
            before = np.cumsum([0, *map(len, raw)])[:-1]
            at = np.concatenate([np.zeros(0, "i8"), *[a[:-1] + b for (_, a), b in zip(found, before, strict=True)]])
            stop = [int(a[-1]) for _, a in found]
        counts = np.array([len(x) for x in ids], "i8")
        flat = np.concatenate([np.zeros(0, "<u4"), *ids])
        width = self.width[flat]
        edge = np.concatenate([[0], np.cumsum(counts)])
        for k in np.unique(np.searchsorted(edge, np.flatnonzero(flat == self.unknown), "right") - 1):
            surface = self.model.encode(texts[int(k)].as_py(), out_type=str, num_threads=1)
            unknown = np.flatnonzero(ids[k] == self.unknown)
            width[edge[k] + unknown] = [len(surface[j].encode()) for j in unknown]
        end = np.cumsum(width, dtype="i8")
        last = np.cumsum(counts) - 1
        covered = np.concatenate([[0], end])[last + 1]
        if (covered != np.cumsum(joined)).any():
            raise ValueError("the pieces do not cover the normalised text")
        shift = np.repeat(before, counts)
        begins = at[end - width] - shift
        ends = np.empty(len(flat), "i8")
        ends[:-1] = begins[1:]
        full = counts > 0
        ends[last[full]] = np.array([len(x) for x in raw] if self.plain else stop, "i8")[full]
        return begins.astype("i4"), ends.astype("i4")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``ids``, ``begins`` and ``ends`` (arrays: piece ids and their byte spans in the UTF-8
    original) to every row, and on demand ``decoded``, as ``decode`` would. ``text`` itself is left
    out; join it back by id if wanted."""
    kept = [c for c in docs.columns if c not in (text, "ids", "begins", "ends", "decoded")]
    names = [*kept, "ids", "begins", "ends", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, len(kept), 2_000_000):
                texts = part.column(len(kept))
                ids = own.ids(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4"))
                columns = [np.concatenate([np.zeros(0, "<u4"), *ids]).astype("i4"), *own.spans(texts, ids)]
                columns = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
                if decoded:
                    columns.append(pa.array([own.model.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names)

    schema = docs.select(*kept).schema
    for name in ("ids", "begins", "ends"):
        schema = schema.add(name, ArrayType(IntegerType()))
    if decoded:
        schema = schema.add("decoded", "string")
    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the library's text for ``ids``; begins and ends are left out."""
    kept = [c for c in encoded.columns if c not in ("begins", "ends", "decoded")]
    at = kept.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.model.decode(x.as_py() or []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, encoded.select(*kept).schema.add("decoded", "string"))
