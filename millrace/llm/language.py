"""Language identification by a linear-chain conditional random field over words.

Every word has a label, a language. Emission scores are sums of learned weights of hashed affixes and character
n-grams of the word and of its place in per-language lexicons; transition scores are learned with them. Forward-
backward gives each word's label probabilities, so a text may switch between languages; a document's score for a
language is the mean probability of its words. Training sequences are spliced from spans of labelled documents, so
that the transitions see switches. Long texts are labelled in windows of words, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, slices, texts_of
from .chunks import sums

#: Hash buckets of features; words of a window and of a training span.
BUCKETS, WINDOW, SPAN = 1 << 17, 64, 16
#: Words scored and windows labelled at once; tokens, and characters of them, whose scores a worker keeps.
SCORED, LABELLED, KEPT, KEPT_CHARS = 4096, 512, 150_000, 3_000_000
#: Bounds of the training sample: documents a language, characters of a document (from a place drawn by hash), spans a document.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_SPANS = 200, 20_000, 30
#: Languages that are learned at most.
LANGUAGES = 100
#: Words of a language's lexicon, their least count in the sample, and the least share of the language among them.
LEXICON, LEXICON_COUNT, LEXICON_SHARE = 5_000, 3, 0.8
STEPS, RATE, DECAY = 25, 0.4, 1e-4
UNKNOWN = "und"


def letters(token: str) -> str:
    """The letters of a white-space token in lower case; a token without any is not a word."""
    return token.lower() if token.isalpha() else "".join(c for c in token.lower() if c.isalpha())


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Bucket numbers of 64-bit hashes."""
    h = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of the features of words, the word that each belongs to, and a hash of each whole word."""
    chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts, word = np.cumsum(size) - size, np.repeat(np.arange(len(words)), size)
    ends = starts + size
    left = np.repeat(ends, size) - np.arange(len(chars))  # characters from here to the word's end
    prime = np.uint64(1_000_003)
    found, owner, grams = [], [], chars
    for n in range(1, 4):  # n-grams, boundaries included
        if n > 1:
            grams = grams[:-1] * prime + chars[n - 1 :]
        inside = left[: len(grams)] >= n
        found.append(mixed(grams[inside], n))
        owner.append(word[: len(grams)][inside])
    for n in range(2, 5):  # affixes without the boundary mark
        longer = np.flatnonzero(size - 2 > n)
        for salt, first in ((10 + n, starts[longer] + 1), (20 + n, ends[longer] - 1 - n)):
            h = np.zeros(len(longer), np.uint64)
            for i in range(n):
                h = h * prime + chars[first + i]
            found.append(mixed(h, salt))
            owner.append(longer)
    whole = np.zeros(len(words), np.uint64)
    if len(words):
        rank = (np.arange(len(chars)) - np.repeat(starts, size)).astype(np.uint64)
        whole = np.add.reduceat((chars + np.uint64(7)) * (rank * prime + np.uint64(1)) * (chars ^ np.uint64(0x9E3779B97F4A7C15)), starts)
    return np.concatenate(found), np.concatenate(owner), whole


def forward_backward(emit: np.ndarray, active: np.ndarray, move: np.ndarray, first: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of windows, steps first; at step t the first active[t] windows go on.

    counts, where given, gets the expected transitions added.
    """
    steps, n, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a, b = np.zeros_like(e), np.ones_like(e)
    now = first * e[0]
    a[0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        m = active[t]
        now = (a[t - 1, :m] @ move) * e[t, :m]
        a[t, :m] = now / now.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        m = active[t + 1]
        ahead = e[t + 1, :m] * b[t + 1, :m]
        now = ahead @ move.T
        b[t, :m] = now / now.sum(axis=1, keepdims=True)
        if counts is not None and m:
            pair = a[t, :m, :, None] * move * ahead[:, None, :]
            counts += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    out = a * b
    return out / np.maximum(out.sum(axis=2, keepdims=True), 1e-300)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of so many words: where each starts among all words, its length, longest first; and their texts."""
    pieces = -(-counts // WINDOW)
    text = np.repeat(np.arange(len(counts)), pieces)
    within = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOW
    start = (np.cumsum(counts) - counts)[text] + within
    length = np.minimum(WINDOW, counts[text] - within)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order], text[order]


@dataclass
class Model:
    """Languages, feature weights (buckets, then one per lexicon), transition and first-label scores, lexicon hashes."""

    languages: list[str]
    weights: np.ndarray
    move: np.ndarray
    first: np.ndarray
    lexicon: np.ndarray
    lexicon_of: np.ndarray

    def in_lexicon(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that are in a lexicon, and their features' numbers."""
        if not len(self.lexicon):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        hit = np.flatnonzero(self.lexicon[at] == whole)
        return hit, BUCKETS + self.lexicon_of[at[hit]]

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for i in range(0, len(words), SCORED):
            part = out[i : i + SCORED]
            found, owner, whole = features(words[i : i + SCORED])
            hit, number = self.in_lexicon(whole)
            for k in range(len(self.languages)):
                part[:, k] = np.bincount(owner, self.weights[found, k], len(part))
            part[hit] += self.weights[number]
        return out

    def label(self, emit: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each text's mean label probabilities, from its words' emission scores."""
        start, length, text = windows(counts)
        totals = np.zeros((len(counts), len(self.languages)))
        move, first = np.exp(self.move - self.move.max()), np.exp(self.first - self.first.max())
        for i in range(0, len(start), LABELLED):
            s, n, t = start[i : i + LABELLED], length[i : i + LABELLED], text[i : i + LABELLED]
            steps = np.arange(n[0])
            at = np.minimum(s[None, :] + steps[:, None], len(emit) - 1)
            inside = steps[:, None] < n[None, :]
            labels = forward_backward(emit[at], inside.sum(axis=1), move, first)
            labels *= inside[:, :, None]
            summed = labels.sum(axis=0)
            for k in range(totals.shape[1]):
                totals[:, k] += np.bincount(t, summed[:, k], len(counts))
        return totals / np.maximum(counts, 1)[:, None]


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """A model learned from texts and their languages; None if there is no word to learn from."""
    names = sorted(set(languages))
    spans: list[tuple[int, list[str]]] = []
    rng = np.random.default_rng(7)
    for text, language in zip(texts, languages):
        words = [w for w in map(letters, text.split()) if w]
        cut = [words[i : i + SPAN] for i in range(0, len(words), SPAN)]
        picked = rng.permutation(len(cut))[:TRAIN_SPANS]
        spans += [(names.index(language), cut[i]) for i in picked]
    if not spans:
        return None
    spans = [spans[i] for i in rng.permutation(len(spans))]
    flat = list(chain.from_iterable(w for _, w in spans))
    gold = np.repeat([k for k, _ in spans], [len(w) for _, w in spans])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter(map(vocabulary.__getitem__, flat), np.int64, len(flat))
    found, owner, whole = features(list(vocabulary))
    k = len(names)
    share = np.stack([np.bincount(word[gold == i], minlength=len(vocabulary)) for i in range(k)], axis=1)
    chosen: dict[int, int] = {}
    for i in range(k):
        fit_words = np.flatnonzero((share[:, i] >= LEXICON_COUNT) & (share[:, i] >= LEXICON_SHARE * share.sum(axis=1)))
        for j in fit_words[np.lexsort((fit_words, -share[fit_words, i]))][:LEXICON].tolist():
            chosen[int(whole[j])] = i
    keys = np.array(sorted(chosen), np.uint64)
    model = Model(names, np.zeros((BUCKETS + k, k)), np.zeros((k, k)), np.zeros(k), keys, np.array([chosen[int(x)] for x in keys], np.int64))
    hit, number = model.in_lexicon(whole)
    found, owner = np.concatenate([found, number]), np.concatenate([owner, hit])
    # windows of WINDOW words over the spliced spans, the rest of an incomplete one left out unless it is the only one
    steps = min(WINDOW, len(flat))
    n = len(flat) // steps
    at = np.arange(n * steps).reshape(n, steps).T
    active, y = np.full(steps, n), gold[at]
    true_moves = np.bincount((y[:-1] * k + y[1:]).ravel(), minlength=k * k).reshape(k, k)
    params = [model.weights, model.move, model.first]
    squares = [np.full_like(p, 1e-8) for p in params]
    for _ in range(STEPS):
        scores = np.stack([np.bincount(owner, model.weights[found, i], len(vocabulary)) for i in range(k)], axis=1)
        expected = np.zeros((k, k))
        labels = forward_backward(scores[word[at]], active, np.exp(model.move), np.exp(model.first), expected)
        gap = -labels
        np.put_along_axis(gap, y[:, :, None], np.take_along_axis(gap, y[:, :, None], 2) + 1, 2)
        per_word = np.stack([np.bincount(word[at].ravel(), gap[:, :, i].ravel(), len(vocabulary)) for i in range(k)], axis=1)
        by_feature = np.stack([np.bincount(found, per_word[owner, i], len(model.weights)) for i in range(k)], axis=1)
        for p, q, g in zip(params, squares, (by_feature - DECAY * len(flat) * model.weights / k, true_moves - expected, gap[0].sum(axis=0))):
            q += g * g
            p += RATE * g / np.sqrt(q)
    return model


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of keep), lang_pred and score of every row; see identify."""
    learned = df.sparkSession.sparkContext.broadcast(model)
    columns = [F.col(c) for c in keep] if keep else [F.col(id_col).cast("long").alias("doc_id")]
    rows = bounded(df).select(*columns, F.col(text_col).cast("string").alias("text of"))
    names = [f.name for f in rows.schema.fields if f.name != "text of"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learned.value
        known: dict[str, int] = {}
        chars = 0
        emit = np.zeros((0, len(model.languages) if model else 1))
        real = np.zeros(0, bool)
        for batch in batches:
            for part in slices(batch, "text of"):
                texts = texts_of(part, "text of")
                each = [t.split() for t in texts]
                tokens = list(chain.from_iterable(each))
                if len(known) > KEPT or chars > KEPT_CHARS:
                    known, chars, emit, real = {}, 0, emit[:0].copy(), real[:0].copy()
                index = list(map(known.get, tokens))
                if None in index:
                    new = list({t for t, i in zip(tokens, index) if i is None})
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    chars += sum(map(len, new))
                    words = list(map(letters, new))
                    real = np.concatenate([real, np.fromiter(map(bool, words), bool, len(words))])
                    emit = np.concatenate([emit, model.emissions(words) if model else np.zeros((len(words), 1))])
                    index = list(map(known.__getitem__, tokens))
                at = np.array(index, np.int64)
                is_word = real[at] if len(at) else np.zeros(0, bool)
                counts = sums(is_word.astype(np.int64), [len(e) for e in each])
                shares = model.label(emit[at[is_word]], counts) if model and len(at) else np.zeros((len(texts), 1))
                best = shares.argmax(axis=1)
                sure = (counts > 0) & (model is not None)
                languages = [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), sure.tolist())]
                score = np.where(sure, np.clip(shares[np.arange(len(texts)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(languages, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text of")
    return rows.mapInArrow(label, schema + ", lang_pred string, score double")


def held_out(id_col: str) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS) -> Model | None:
    """Fit on a sample of at most `docs` documents of each language, of those that are not held out.

    The sample is drawn for each language by itself, by a hash of the id from all labelled rows; an id counts once in a language,
    however often its rows are repeated (with its least text). Of a longer text it takes TRAIN_CHARS characters from a place
    that the hash gives. Rows whose id, language or text is null are not drawn. Learned are the LANGUAGES languages with the most ids (ties: the first
    by name), so that the sample stays bounded where the column holds other things too.
    """
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = labelled.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    ids = labelled.select("lang", "id").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in ids.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    place = (F.xxhash64("id", "lang") / F.lit(float(1 << 64)) + 0.5).alias("place")
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(2.0, 1.5 * docs / n))) for k, n in counts.items()))  # over 1: all
    drawn = labelled.filter(F.col("lang").isin(list(counts))).withColumn("place", place).filter(F.col("place") < share[F.col("lang")])
    start = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.length("text") - TRAIN_CHARS)).cast("int") + 1
    drawn = drawn.select("id", F.substring(F.col("text"), start, F.lit(TRAIN_CHARS)).alias("text"), "lang", "place")
    once = drawn.groupBy("lang", "place", "id").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id"))  # of about 1.5 * docs rows a language
    sample = once.withColumn("k", first).filter(F.col("k") <= docs).orderBy("place", "id", "lang").collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from a model learned on the rows that are not held out.

    Predictions use the whole text alone. lang_pred is `und` with score 0 where the text is null or has no letter,
    or where no row is labelled; else a learned language (the first in the alphabet on a tie) and the mean probability of
    its label over the words. A very long text is labelled in windows, all of them. A null id is not held out and not learned from; repeated rows come back as often as they occur; an empty table
    gives no rows. Other columns are left out, whatever their names.
    """
    found = predict(df, train(df, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
