"""Encoding texts by their distinct words: shared by the token-id operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of up to ``most`` bytes of the column (texts or binaries), or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    first = held = 0
    for k, n in enumerate(size):
        if k > first and held + n > most:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if batch.num_rows:
        yield batch.slice(first)


def flat_ids(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Id lists in sequence, and their lengths."""
    return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), "i8", len(ids))


class Memory:
    """Ids of chunks, learnt once and kept up to ``most`` characters in all."""

    def __init__(self, most: int = 6_000_000):
        self.most, self.size = most, 0
        self.known: dict[str, bytes] = {}

    def trim(self) -> None:
        if self.size > self.most:
            self.known, self.size = {}, 0

    def learn(self, chunks: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        if chunks:
            flat, sizes = encode(chunks)
            flat, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            self.known.update(zip(chunks, map(flat.__getitem__, map(slice, [0, *ends], ends)), strict=True))
            self.size += len("".join(chunks))


    def ids(self, distinct: list[str], usable: list[bool], learn: Callable[[list[str]], None]) -> list[bytes]:
        """Ids of each chunk; ``learn`` is given the usable ones not yet known, others get none."""
        get = self.known.get
        ids = list(map(get, distinct, repeat(b"")))
        places = [k for k, (x, ok) in enumerate(zip(ids, usable, strict=True)) if ok and not x]
        new = [distinct[k] for k in places]
        learn(new)
        for k, x in zip(places, map(get, new, repeat(b"")), strict=True):
            ids[k] = x
        return ids


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The texts cut at blanks: number of the distinct word at each place, the distinct words, and
    the place of each text's first word (and the end)."""
    words = pc.split_pattern(pc.fill_null(texts, ""), " ")
    edge = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
    coded = words.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, edge


def known_texts(ids: list[bytes], at: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which texts have only words with ids."""
    good = np.fromiter(map(len, ids), "i8", len(ids)) > 0
    return np.logical_and.reduceat(good[at], edge[:-1]) if len(at) else np.zeros(0, bool)


class Gather:
    """Ids of distinct words, laid end to end once."""

    def __init__(self, ids: list[bytes]):
        self.size = np.fromiter(map(len, ids), "i8", len(ids)) // 4
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(ids), "<u4")

    def __call__(self, at: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words ``at`` in sequence, and the end of each place in it; places in
        ``skip`` are left out."""
        n = self.size[at]
        if skip is not None:
            n[skip] = 0
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        kind = "i4" if max(total, len(self.flat)) < 1 << 31 else "i8"
        shift = (self.begin[at] - ends + n).astype(kind)
        return self.flat[np.repeat(shift, n) + np.arange(total, dtype=kind)], ends


def ranges(edge: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to ``most`` words together, or one text."""
    first = 0
    while first < len(edge) - 1:
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + most, "right")) - 1)
        yield first, last
        first = last
