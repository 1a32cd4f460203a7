"""Token ids of many texts with a public tokenizer, through a table of distinct words.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its white-space chunks in order. Each distinct chunk is encoded once
per worker (up to ``CACHED`` of them are kept); texts become ids by lookup.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks kept per worker, about 40 bytes each.
CACHED = 600_000
#: Chunks of these letters alone are one pre-token each, unchanged by normalisation.
_PLAIN = "^[a-zß-öø-ÿ]+$"
#: A pre-token ends between a letter and these marks, so a space there changes nothing.
_MARKS = "([a-z])([.,!?;:]+)"


class WordEncoder:
    """Vectorised front of one tokenizer file; the result equals encoding each text as a whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per chunk."""
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        found: list[np.ndarray | None] = [None] * len(chunks)
        words, at = chunks.filter(pa.array(plain)).to_pylist(), np.flatnonzero(plain)
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            ids = np.array(self._whole([" ".join(part)])[0], dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            own = np.split(ids, stops[:-1]) if len(stops) == len(part) else [np.array(i, np.uint32) for i in self._whole(part)]
            for i, values in zip(at[start : start + 20_000], own, strict=True):
                found[i] = values
        for i, values in zip(np.flatnonzero(~plain), self._whole(chunks.filter(pa.array(~plain)).to_pylist()), strict=True):
            found[i] = np.array(values, dtype=np.uint32)
        counts = np.fromiter((len(v) for v in found), np.int64, len(found))
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():  # strings of special tokens: encode those texts as they are
            plain_ids, plain_counts = self.encode(texts.filter(pa.array(~special)))
            whole = [np.array(i, np.uint32) for i in self._whole(texts.filter(pa.array(special)).to_pylist())]
            counts = np.zeros(len(texts), np.int64)
            counts[~special], counts[special] = plain_counts, [len(w) for w in whole]
            parts, done, ends = iter(whole), iter(np.split(plain_ids, np.cumsum(plain_counts)[:-1]) if len(plain_counts) else []), special
            return np.concatenate([next(parts) if s else next(done) for s in ends]).astype(np.uint32), counts
        spaced = pc.replace_substring_regex(pc.ascii_lower(texts), _MARKS, "\\1 \\2")
        lists = pc.ascii_split_whitespace(spaced)
        chunks, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
        keep = pc.greater(pc.binary_length(chunks), 0)
        chunks, rows = chunks.filter(keep), rows.filter(keep).to_numpy(zero_copy_only=False)
        coded = chunks.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known) if len(self.known) else pa.nulls(len(coded.dictionary), pa.int32())
        new = coded.dictionary.filter(pc.is_null(found))
        new_flat, new_counts = self._encode(new)
        where = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        where[where < 0] = len(self.known) + np.arange(len(new))
        flat = np.concatenate([self.flat, new_flat])
        counts = np.concatenate([self.counts, new_counts])
        starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(new_counts) - new_counts])
        if len(self.known) + len(new) <= CACHED:
            self.known, self.flat, self.counts, self.starts = pa.concat_arrays([self.known, new]), flat, counts, starts
        chunk = where[coded.indices.to_numpy(zero_copy_only=False)]
        per_chunk = counts[chunk]
        ends = np.cumsum(per_chunk)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts[chunk] - (ends - per_chunk), per_chunk)
        return flat[at], np.bincount(rows, weights=per_chunk, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return WordEncoder(path)
