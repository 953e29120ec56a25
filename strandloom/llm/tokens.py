"""Token ids of whole texts by a public tokenizer, with a bounded per-process cache of words.

The tokenizer drops white space and never merges across it, so a text's ids are
those of its space-separated chunks in order. A chunk that is a Latin word with
ASCII punctuation behind it splits further, into the lower-cased word and the
punctuation, which that tokenizer also never merges. All other chunks go through
the tokenizer as they are.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

# A word of letters that lower-case one to one and stand in composed form, then
# punctuation without the apostrophe, which can open a contraction.
PLAIN = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
# Cached strings per process; the cache starts anew beyond it.
CACHE = 500_000


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """This process's words and their ids; a reused worker keeps them from task to task."""
    return WordIds(path)


class WordIds:
    """Ids per distinct word, kept in one flat array."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        state = json.loads(self.whole.to_str())
        vocabulary = state["model"]["vocab"]
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # The same model for words that need no normalising, given with spaces between.
        self.bare = Tokenizer.from_str(json.dumps(state | {"normalizer": None, "added_tokens": []}))
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[bool, dict[str, int]] = {True: {}, False: {}}
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def places(self, strings: list[str], plain: bool) -> np.ndarray:
        """Index of each string's ids; ``plain`` strings are words or punctuation that need no normalising."""
        known = self.known[plain]
        new = [s for s in strings if s not in known]
        if new:
            for i, s in enumerate(new, len(self.ends) - 1):
                known[s] = i
            if plain:
                ids = np.array(self.bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
                stops = np.flatnonzero(self.word_end[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
                if len(stops) != len(new):
                    raise ValueError("the tokenizer does not end every word with an end mark")
                self._append(ids, np.diff(stops, prepend=0))
            else:
                encoded = [e.ids for e in self.whole.encode_batch_fast(new, add_special_tokens=False)]
                self._append(np.array([i for e in encoded for i in e], np.int64), np.array([len(e) for e in encoded], np.int64))
        return np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) one after the other, and where each text ends."""
        if len(self.ends) > CACHE:
            self.forget()
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = chunks.flatten().dictionary_encode()
        unique = words.dictionary
        parts = pc.extract_regex(unique, PLAIN)
        simple = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        first = np.zeros(len(unique), np.int64)
        second = np.zeros(len(unique), np.int64)
        rest = unique.filter(pa.array(~simple))
        first[~simple] = self.places(rest.to_pylist(), False)
        empty = self.places([""], False)[0]
        second[~simple] = empty
        if simple.any():
            parts = parts.filter(pa.array(simple))
            head = pc.utf8_lower(parts.field("word")).dictionary_encode()
            tail = parts.field("tail").dictionary_encode()
            marks = tail.dictionary.to_pylist()
            at = np.full(len(marks), empty)
            at[[i for i, m in enumerate(marks) if m]] = self.places([m for m in marks if m], True)
            first[simple] = self.places(head.dictionary.to_pylist(), True)[head.indices.to_numpy()]
            second[simple] = at[tail.indices.to_numpy()]
        lengths = np.diff(self.ends)
        used = words.indices.to_numpy()
        pair = np.stack([first[used], second[used]], axis=1).ravel()
        pair = pair[lengths[pair] > 0]
        ids = self.flat[ragged(self.ends[pair], lengths[pair])]
        per_chunk = (lengths[first] + lengths[second])[used]
        stops = np.cumsum(chunks.value_lengths().to_numpy())
        return ids, np.r_[0, np.cumsum(per_chunk)][stops]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ..., then those of the next range, and so on; no length is zero."""
    if not len(starts):
        return np.zeros(0, np.int64)
    steps = np.ones(int(lengths.sum()), np.int64)
    firsts = np.cumsum(lengths)[:-1]
    steps[0] = starts[0]
    steps[firsts] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(steps)
