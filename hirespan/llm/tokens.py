"""Token ids of whole texts by a given tokenizer, each distinct word of a slice of texts encoded once.

A text is cut where the tokenizer's own pre-splitting must cut in any case, whatever stands around:
before a single space that is followed by something else than white space, between a letter or digit
and ASCII punctuation, and behind a lone line break. The ids of the text are then those of the pieces,
one after the other. Words between spaces are gathered from a slice of texts, and the distinct ones are handed
to the tokenizer many at a time, as one string with a space before each: a word's ids start where a token
starts with that space, as no word holds another. Nothing is remembered from slice to slice.

Special strings of the tokenizer are cut out first and give their own ids, as the tokenizer itself does; with
``ordinary`` they are text like any other. Tests hold the ids against those of whole texts.

Defined results: a null or empty text has no ids; equal texts have equal ids; no texts give no ids.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 0
LONGEST = 64  # characters of a word that is encoded together with others
TOGETHER = 512  # words in a string
SLICE = 8_000_000  # bytes of texts whose distinct words are encoded once
CUTS = re.compile(r"""(?= \S)|(?<=[^\W_])(?=[!-/:-@\[-^`{-~])|(?<=\S\n)(?=\S)""")
BARE_SPACE = r" [\s\p{Z}\x{85}\x0B\x1C-\x1F]| $"  # perhaps a space that belongs to no word


class Encoder:
    def __init__(self, path: str, ordinary: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        # A token that starts with the byte of a space starts with this letter.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        with open(path, encoding="utf-8") as file:
            added = {} if ordinary else {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.special = {x: np.array([i], "<u4").tobytes() for x, i in added.items()}
        longest_first = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        self.specials = re.compile(f"({longest_first})") if added else None

    def _ids(self, strings: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _plain(self, strings: list[str]) -> list[bytes]:
        """Ids of each string; a long one is cut first, as the tokenizer holds much for each id of a string."""
        cut = [CUTS.split(x) if len(x) > LONGEST else (x,) for x in strings]
        pieces = list(chain.from_iterable(cut))
        sizes, flat = [], []
        for at in range(0, len(pieces), 2048):
            ids = self._ids(pieces[at : at + 2048])
            sizes += map(len, ids)
            flat.append(np.fromiter(chain.from_iterable(ids), "<u4").tobytes())
        ends = 4 * np.append(0, np.cumsum(sizes, dtype=np.int64))[np.cumsum([0, *map(len, cut)])]
        joined = b"".join(flat)
        return [joined[start:end] for start, end in pairwise(ends.tolist())]

    def _strings(self, strings: list[str]) -> list[bytes]:
        """Ids of each string by itself, special strings included."""
        if not self.specials or not any(self.specials.search(x) for x in strings):
            return self._plain(strings)
        parts = [self.specials.split(x) for x in strings]
        ordinary = iter(self._plain([x for part in parts for x in part[::2]]))
        return [b"".join(next(ordinary) if k % 2 == 0 else self.special[x] for k, x in enumerate(part)) for part in parts]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words``, each with a space before it, and how many each has."""
        short = [k for k, word in enumerate(words) if len(word) <= LONGEST]
        flat, sizes = [], []
        for at in range(0, len(short), 64 * TOGETHER):
            some = [words[k] for k in short[at : at + 64 * TOGETHER]]
            strings = [" " + " ".join(some[k : k + TOGETHER]) for k in range(0, len(some), TOGETHER)]
            ids = np.fromiter(chain.from_iterable(self._ids(strings)), "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some) or starts[0]:
                raise RuntimeError("the tokenizer did not cut at single spaces")
            flat.append(ids)
            sizes.append(np.diff(starts, append=len(ids)))
        lengths = np.zeros(len(words), np.int64)
        lengths[short] = np.concatenate(sizes) if sizes else 0
        if len(short) == len(words):
            return (np.concatenate(flat) if flat else np.empty(0, "<u4")), lengths
        long = [k for k, word in enumerate(words) if len(word) > LONGEST]
        found = self._plain([" " + words[k] for k in long])
        lengths[long] = [len(x) // 4 for x in found]
        ends = np.cumsum(lengths)
        out = np.empty(ends[-1], "<u4")
        of_long = np.zeros(len(words), bool)
        of_long[long] = True
        of_long = np.repeat(of_long, lengths)
        out[of_long] = np.frombuffer(b"".join(found), "<u4")
        out[~of_long] = np.concatenate(flat) if flat else np.empty(0, "<u4")
        return out, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order (unsigned 32-bit), and where each text's ids start; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # A text with a bare space or a special string is taken by itself.
        alone = pc.match_substring_regex(texts, BARE_SPACE)
        for special in self.special:
            alone = pc.or_(alone, pc.match_substring(texts, special))
        own = {int(k): texts[k].as_py() for k in np.flatnonzero(alone.to_numpy(zero_copy_only=False))}
        if own:
            texts = pc.if_else(alone, "", texts)
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        encoded = split.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy().astype(np.int64)
        words = encoded.dictionary.to_pylist()
        heads = [own[k] if k in own else words[code] for k, code in enumerate(codes[at].tolist())]
        codes[at] = len(words) + np.arange(len(at))  # the first word has no space before it
        wanted = np.bincount(codes, minlength=len(words))[: len(words)] > 0
        flat, lengths = self._words([word for word, needed in zip(words, wanted.tolist(), strict=True) if needed])
        first = self._strings(heads)
        size = np.zeros(len(words) + len(at), np.int64)
        size[: len(words)][wanted] = lengths
        size[len(words) :] = [len(x) // 4 for x in first]
        flat = np.concatenate([flat, np.frombuffer(b"".join(first), "<u4")])
        lengths = size[codes]
        ends = np.cumsum(lengths)
        place = np.repeat((np.cumsum(size) - size)[codes] - (ends - lengths), lengths)
        place += np.arange(len(place))
        return flat[place], np.append((ends - lengths)[at], len(place)) if len(at) else np.zeros(1, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker, kept for all its tasks until an operator without tokens runs there."""
    return Encoder(path)


def without_encoder() -> None:
    """Let go of this worker's encoders; the worker may have been another operator's before."""
    encoder.cache_clear()


def parts_of(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1)] if len(part) else []
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(start), int(end - start))
        pa.default_memory_pool().release_unused()  # several workers share what an executor has


def with_end(ids: np.ndarray, starts: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id behind each text's ids."""
    ends = starts[1:] + np.arange(len(starts) - 1)
    out = np.empty(len(ids) + len(ends), "<u4")
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask], out[ends] = ids, end
    return out, starts + np.arange(len(starts))
