"""Words of whole texts as numbers, counted batch by batch inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """(first row, rows) in runs of at most ``limit`` bytes, or of one longer text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, texts.slice(start, stop - start)
        start = stop


def content(texts: pa.LargeStringArray) -> tuple[np.ndarray, bytes]:
    """The bounds of each text, from 0, and the bytes of all."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return offsets - offsets[0], data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None else b""


def words(bounds: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the dictionary number of every word, and the dictionary.

    Words are what lies between white space (0x20 and 0x09 to 0x0D).
    """
    texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data))
    split = pc.ascii_split_whitespace(texts)
    rows = np.repeat(np.arange(len(split)), np.diff(np.asarray(split.offsets)))
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    dictionary = coded.dictionary
    blank = pc.index(dictionary, pa.scalar("", dictionary.type)).as_py()  # before and after the white space at a text's ends
    if blank >= 0:
        real = codes != blank
        rows, codes = rows[real], codes[real]
        codes = codes - (codes > blank)
        dictionary = pa.concat_arrays([dictionary.slice(0, blank), dictionary.slice(blank + 1)])
    return rows, codes, dictionary


def counted(rows: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, code) pairs in order, and how often each occurs."""
    cells, times = np.unique(rows * max(1, width) + codes, return_counts=True)
    return cells // max(1, width), cells % max(1, width), times
