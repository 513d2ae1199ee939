"""Words of whole texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit values (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z lower-cased, split at bytes 9 to 13 and 32), and where texts start."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.split_pattern(pc.replace_substring_regex(texts, r"[\x09-\x0D]", " "), " ")
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    encoded = split.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    words = [w.encode().lower() for w in encoded.dictionary.to_pylist()]  # of bytes, lower() is for A-Z only
    values = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    if b"" in words:  # what lies between spaces next to each other
        full = codes != words.index(b"")
        at, codes = np.append(0, np.cumsum(full))[at], codes[full]
    return (values[codes] if len(words) else np.empty(0, np.uint64)), at


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each place on; places too near the end are left out."""
    n = max(0, len(hashes) - width + 1)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mixed(out * _MULTIPLY + hashes[k : k + n])
    return out


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted: runs of ``width`` words, or all words if there are fewer."""
    hashes, at = hashed(texts)
    every = runs(hashes, width)
    out = []
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if end - start >= width:
            out.append(np.unique(every[start : end - width + 1]))
        else:
            out.append(runs(hashes[start:end], end - start) if end > start else hashes[:0])
    return out
