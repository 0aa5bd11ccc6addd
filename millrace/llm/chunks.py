"""Byte-level BPE of whole texts through a cache of space-delimited chunks.

The pre-token pattern of byte-level BPE starts a new pre-token at every space that a non-space follows. A text
may therefore be cut at those spaces: the ids of the text are the ids of its chunks in order. A chunk is one or a
few pre-tokens ("word.\\nNext"), and few distinct ones make up most of a corpus, so a worker looks them up and
hands only the ones it has not seen to the tokenizer library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat

import numpy as np

BEFORE_SPACE = re.compile(r" \s")
CUT = re.compile(r" (?=\S)")
#: Marks the first chunk of a text, which has no space before it. No other chunk begins with a space.
FIRST = " "


def chunks(text: str) -> list[str]:
    """The chunks of a text without the space before each; the first is marked."""
    if not text:
        return []
    found = CUT.split(text) if BEFORE_SPACE.search(text) else text.split(" ")
    found[0] = FIRST + found[0]
    return found


def spelled(chunk: str) -> str:
    """The piece of text that a chunk stands for."""
    return chunk[1:] if chunk[:1] == FIRST else " " + chunk


#: Chunks without inner spaces in Latin, Greek, Cyrillic or Armenian. For others only the tokenizers library itself is
#: asked: tables of Unicode classes differ between versions for scripts that are still being extended.
PLAIN = re.compile(r"[^\s\u0590-\u1fff\u2070-\U0010ffff][^ \u0590-\u1fff\u2070-\U0010ffff]*")


def rank_encoder(spec: dict):
    """A tiktoken encoder of a byte-level BPE file, if its merges are in the order of its ids; else None."""
    import tiktoken
    from public_tokenizers import PATTERN

    from .bpe import byte_symbols

    model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
    plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space")
    if not plain or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(model["merges"])):
        return None
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("of file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Library:
    """A tokenizer file, read by the tokenizers library, and the strings it treats as special.

    New chunks of the common alphabetic scripts go, many at once, to a tiktoken encoder of the same vocabulary, which
    gives the same ids several times as fast; all others go to the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        with open(path, encoding="utf-8") as file:
            self.ranks = rank_encoder(json.load(file))
        if self.ranks is not None:
            self.begins = np.array([self.ranks.decode_single_token_bytes(i)[:1] == b" " for i in range(self.ranks.n_vocab)], bool)

    def parts(self, text: str) -> list[str]:
        """The chunks of a text, special strings as parts of their own."""
        if self.split is None or not any(s in text for s in self.special):
            return chunks(text)
        # a special string is marked as a first chunk: it is spelled without a space
        return list(chain.from_iterable([FIRST + p] if p in self.special else chunks(p) for p in self.split.split(text)))

    def encode(self, keys: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The keys in the order of their ids, the ids one key after another, and how many each has.

        Plain chunks are encoded as one text: each begins with its space, and no token inside it does.
        """
        plain, others = [], []
        for k in keys:
            (plain if self.ranks is not None and PLAIN.fullmatch(k) else others).append(k)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([spelled(k) for k in others], add_special_tokens=False)]
        flat, counts = np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        if plain:
            found = np.array(self.ranks.encode_ordinary(" " + " ".join(plain)), np.uint32)
            starts = np.flatnonzero(self.begins[found])
            flat = np.concatenate([found, flat])
            counts = np.concatenate([np.diff(np.append(starts, len(found))), counts])
        return plain + others, flat, counts


#: Chunks, and characters of them, that a worker's cache holds before it starts anew (a batch more at most).
LIMIT, LIMIT_CHARS = 300_000, 6_000_000


class LengthCache:
    """Token counts of chunks: a table of frequent ones that never changes, then a bounded cache of the others."""

    def __init__(self, library: Library, frequent: dict[str, int], limit: int = LIMIT):
        self.library, self.frequent, self.limit = library, frequent, limit
        self.known, self.others, self.chars = dict(frequent), 0, 0

    def counts(self, texts: list[str]) -> np.ndarray:
        each = [self.library.parts(t) for t in texts]
        flat = list(chain.from_iterable(each))
        found = looked_up(self.known, flat)
        if len(new := np.flatnonzero(found < 0)):
            missing = [flat[i] for i in new.tolist()]
            if self.others > self.limit or self.chars > LIMIT_CHARS:
                self.known, self.others, self.chars = dict(self.frequent), 0, 0
            keys, _, counts = self.library.encode(list(dict.fromkeys(missing)))
            self.known.update(zip(keys, counts.tolist()))
            self.others, self.chars = self.others + len(keys), self.chars + sum(map(len, keys))
            found[new] = looked_up(self.known, missing)
        return sums(found, [len(p) for p in each])


class IdCache:
    """Ids of chunks, kept in one flat array; texts come back as arrays of ids."""

    def __init__(self, library: Library, limit: int = LIMIT):
        self.library, self.limit = library, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.lengths, self.starts, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def add(self, keys: list[str]) -> None:
        keys, ids, lengths = self.library.encode(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(ids)
        self.chars += sum(map(len, keys))
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        each = [self.library.parts(t) for t in texts]
        flat = list(chain.from_iterable(each))
        if len(self.known) > self.limit or self.chars > LIMIT_CHARS:
            self.clear()
        index = looked_up(self.known, flat)
        if len(new := np.flatnonzero(index < 0)):
            missing = [flat[i] for i in new.tolist()]
            self.add(list(dict.fromkeys(missing)))
            index[new] = looked_up(self.known, missing)
        lengths = self.lengths[index]
        out = self.flat[spread(self.starts[index], lengths)]
        return np.split(out, np.cumsum(sums(lengths, [len(p) for p in each]))[:-1]) if texts else []


def looked_up(known: dict[str, int], keys: list[str]) -> np.ndarray:
    """The values of keys, -1 for those that are not known."""
    return np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))


def sums(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of consecutive runs of values; a run may be empty."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - np.asarray(counts, np.int64)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
