"""Encoding of blocks of texts: each distinct word of a block is looked up once, ids are put together by numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space before a space, by whichever definition of white space; texts with it take the slow way.
DOUBLE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "


def slices(texts: pa.Array, most: int = 1024, size: int = 4 << 20):
    """(start, length) of blocks of at most ``most`` texts and, but for one text that is larger alone, ``size`` bytes."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, x in enumerate(n.tolist()):
        if i > start and (i - start >= most or held + x > size):
            yield start, i - start
            start, held = i, 0
        held += x
    if len(n) > start:
        yield start, len(n) - start


def encode(texts: pa.Array, odd: np.ndarray, words: Callable[[list[str]], list[bytes]], firsts: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids (uint32) of texts. ``words`` gives the ids (as bytes) of words after a space, ``firsts`` those of the
    words that texts begin with, ``whole`` those of a text marked in ``odd``; ``end`` is put after each text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    rest = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
    lists = pc.split_pattern(rest, " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    begins = lists.offsets.to_numpy().astype(np.int64)
    begins -= begins[0]
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.to_pylist()
    first = coded.dictionary.take(pa.array(index[begins[:-1]])).to_pylist() if n else []
    raw = words(distinct) + firsts(first)
    for i in np.flatnonzero(odd).tolist():
        raw[len(distinct) + i] = whole(texts[i].as_py())
    index[begins[:-1]] = len(distinct) + np.arange(n)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    flat = np.frombuffer(b"".join(raw), "<u4")
    at = np.cumsum(sizes) - sizes
    lengths = sizes[index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    place = np.repeat((at[index] - (ends - lengths)).astype(kind), lengths)
    place += np.arange(total, dtype=kind)
    ids = flat[place]
    offsets = np.concatenate(([0], ends[begins[1:] - 1])) if n else np.zeros(1, np.int64)
    if end is not None:
        ids = np.insert(ids, offsets[1:], np.uint32(end))
        offsets = offsets + np.arange(n + 1)
    return offsets, ids
