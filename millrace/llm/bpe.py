"""Word-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up every adjacent pair by binary search over the
sorted pair keys, takes in each word the pair of lowest rank, merges all its places and drops the words in which
no pair is left. A very long word would need a round for almost every pair of its own; its first pairs are looked up in
the same way, then only the pairs beside a merge, taken from a heap by rank and place. A worker keeps the ids of the space-delimited chunks it has seen, so that a round only meets new
words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import id_and_text, slices, texts_of, vocabulary
from .chunks import spread, sums

#: Rank of a pair that is not in the table.
NONE = np.int64(1 << 40)
#: Characters from which a word is merged by itself; chunks, and characters of them, that a worker's cache holds.
LONG, LIMIT, LIMIT_CHARS = 200, 200_000, 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordBPE:
    """A byte-level BPE vocabulary with a word-end suffix, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = dict(sorted({i: s for s, i in [*vocab.items(), *self.special.items()]}.items()))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.base = max(self.strings) + 1
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([a * self.base + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.sorted_keys = array("q", keys[order].tobytes())
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), np.array([c for _, _, c in pairs], np.int64)[order]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split["pattern"]["Regex"])
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def normalise(self, text: str) -> str:
        """NFC and lower case, character by character (a final sigma is an ordinary one)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if any(len(w) > LONG for w in words):
            long = np.array([len(w) > LONG for w in words])
            flat, size = self.merge([w for w in words if len(w) <= LONG])
            parts = iter(np.split(flat, np.cumsum(size)[:-1]) if len(size) else [])
            each = [self.merge_long(w) if is_long else next(parts) for w, is_long in zip(words, long.tolist())]
            return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        coded = [w.encode() for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(size) - 1
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, starts), counts)
            if (still := best < NONE).sum() < len(best):
                done.append((word[~still], symbols[~still]))
            take = still & (rank == best)
            # of adjacent places of one pair (a a a) every second is merged, from the left
            places = np.flatnonzero(take)
            if len(places):
                new_run = np.append(True, np.diff(places) > 1)
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run_start) % 2 == 0]
                symbols[places] = self.merged[at[places]]
                still[places + 1] = False
            symbols, word = symbols[still], word[still]
        word, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: str) -> np.ndarray:
        """The ids of one long word: every merge looks up the two pairs that it makes, so the time hardly exceeds the length's."""
        data = np.frombuffer(word.encode(), np.uint8)
        found = self.inner[data]
        found[-1] = self.last[data[-1]]
        key = found[:-1] * self.base + found[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        first = np.flatnonzero(self.keys[at] == key)
        heap = list(zip(self.ranks[at[first]].tolist(), first.tolist(), at[first].tolist()))
        heapq.heapify(heap)
        symbols, n = found.tolist(), len(found)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        now = dict(zip(first.tolist(), at[first].tolist()))  # the pair that stands at a place

        def look_up(i: int) -> None:
            j = after[i]
            pair = symbols[i] * self.base + symbols[j] if j < n else -1
            k = bisect_left(self.sorted_keys, pair)
            if k < len(self.sorted_keys) and self.sorted_keys[k] == pair:
                now[i] = k
                heapq.heappush(heap, (int(self.ranks[k]), i, k))
            else:
                now.pop(i, None)

        while heap:
            _, i, k = heapq.heappop(heap)
            if now.get(i) != k:  # one of its symbols is merged already
                continue
            j = after[i]
            symbols[i], symbols[j] = int(self.merged[k]), -1
            now.pop(j, None)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            look_up(i)
            if before[i] >= 0:
                look_up(before[i])
        return np.array([x for x in symbols if x >= 0], np.int64)

    def decode(self, ids: list[int]) -> str:
        """The token strings joined by spaces, specials kept: what a tokenizer file without a decoder gives."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


class ChunkIds:
    """Ids and decoded strings of the chunks a worker has seen."""

    def __init__(self, bpe: WordBPE, limit: int = LIMIT):
        self.bpe, self.limit = bpe, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.decoded: list[str] = []
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, keys: list[str]) -> None:
        """Encode chunks: special strings by themselves, all words of the others in one run of merge rounds."""
        bpe = self.bpe
        words = [[k] if k in bpe.special else bpe.words_of.findall(bpe.normalise(k)) for k in keys]
        distinct = list(dict.fromkeys(chain.from_iterable(w for k, w in zip(keys, words) if k not in bpe.special)))
        ids, size = bpe.merge(distinct)
        ids, size = np.append(ids, list(bpe.special.values())), np.append(size, np.ones(len(bpe.special), np.int64))
        index = dict(zip(distinct, range(len(distinct))))
        specials = {s: len(distinct) + i for i, s in enumerate(bpe.special)}
        picked = np.array([specials[k] if k in specials else index[w] for k, ws in zip(keys, words) for w in ws], np.int64)
        flat = ids[spread((np.cumsum(size) - size)[picked], size[picked])].astype(np.int32)
        counts = sums(size[picked], [len(w) for w in words])
        ends = np.cumsum(counts)
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])
        self.chars += sum(map(len, keys))
        listed = flat.tolist()
        self.decoded += [bpe.decode(listed[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))

    def parts(self, text: str) -> list[str]:
        if not any(s in text for s in self.bpe.special):
            return text.split(" ")
        return list(chain.from_iterable([p] if p in self.bpe.special else p.split(" ") for p in self.bpe.split.split(text)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids, ids per text, and each text decoded from its ids."""
        each = [self.parts(t) for t in texts]
        if len(self.known) > self.limit or self.chars > LIMIT_CHARS:
            self.clear()
        flat = list(chain.from_iterable(each))
        found = list(map(self.known.get, flat))
        if None in found:
            self.add(list({k for k, v in zip(flat, found) if v is None}))
            found = list(map(self.known.__getitem__, flat))
        index = np.array(found, np.int64)
        size = self.counts[index] if len(index) else index
        ids = self.flat[spread(self.starts[index] if len(index) else index, size)]
        decoded, strings, at = [], self.decoded, 0
        for part in each:
            decoded.append(" ".join([s for s in [strings[i] for i in found[at : at + len(part)]] if s]))
            at += len(part)
        return ids, sums(size, [len(p) for p in each]), decoded


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded of every row: the whole text's ids, and the text decoded from them.

    Special strings inside a text are their special ids, and no others are added. A null text counts as empty
    (no ids, empty string); a very long text or word is encoded whole; of pairs of one rank in a word the first is merged first; a null id stays null; repeated rows come back as often as they occur; an empty table
    gives no rows. Other columns are left out, whatever their names.
    """
    path = tokenizer_path or vocabulary("word_bpe_49k.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkIds(WordBPE(path))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts, decoded = cache.encode(texts_of(part, "text"))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(df, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>, decoded string")
