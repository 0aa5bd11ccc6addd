"""Secret scans through a trigram inverted index.

For each rule's regular expression a Boolean query over trigrams is derived: any match must satisfy it. The trigrams of a
batch of texts are taken out in one pass; those that occur in the queries get a posting list of texts, the queries are
answered by intersecting and uniting postings, and only the candidates are searched with the expression itself.
A rule whose expression has no mandatory trigram is searched for in every text. Index and search stay inside the
task that holds the texts, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as sre  # the parse tree of the standard library's expressions
from re import _parser

from ._common import bounded, slices, texts_of


@dataclass(frozen=True)
class Rule:
    """An expression and what its matches must have: a group of at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The three base rules, then further well-known credential formats.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)

# A query is True (every text), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple[str, frozenset]
#: Exact string sets larger than this are given up for a query.
MOST_EXACT = 64


def both(a: Query, b: Query) -> Query:
    if a is True or b is True:
        return b if a is True else a
    return a if a == b else ("and", frozenset({a, b}))


def either(parts: Sequence[Query]) -> Query:
    found = frozenset(parts)
    if True in found:
        return True
    return next(iter(found)) if len(found) == 1 else ("or", found)


def of_string(text: str) -> Query:
    """All trigrams of a string that every match contains."""
    query: Query = True
    for i in range(len(text) - 2):
        query = both(query, text[i : i + 3])
    return query


def of_strings(strings: set[str]) -> Query:
    return either([of_string(s) for s in sorted(strings)])


def char_set(items: list) -> set[str] | None:
    """The lower-cased characters of a class, or None where it is negated or large."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST_EXACT:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def analyse(tree) -> tuple[set[str], Query, bool]:
    """The exact strings of a part's last run without a gap, the query of what precedes it, and whether that run is the whole."""
    exact: set[str] = {""}
    query: Query = True
    whole = True
    for op, value in tree:
        part, implied = analyse_one(op, value)
        query = both(query, implied)
        if part is not None and len(exact) * len(part) <= MOST_EXACT:
            exact = {a + b for a, b in product(exact, part)}
        else:
            query, exact, whole = both(query, of_strings(exact)), part or {""}, False
    return exact, query, whole


def analyse_one(op, value) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, True
    if op is sre.IN:
        return char_set(value), True
    if op is sre.SUBPATTERN:
        return closed(value[3])
    if op is sre.BRANCH:
        parts = [closed(t) for t in value[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_EXACT:
            return set().union(*(e for e, _ in parts)), True
        return None, either([both(q, of_strings(e) if e is not None else True) for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, tree = value
        exact, query = closed(tree)
        if high == 1 and exact is not None:
            return exact | ({""} if low == 0 else set()), query if low else True
        if low == 0:
            return None, True
        return None, both(query, of_strings(exact) if exact is not None else True)
    if op is sre.AT:
        return {""}, True
    return None, True


def closed(tree) -> tuple[set[str] | None, Query]:
    """The exact strings of a part, or None and a query that holds all its trigrams."""
    exact, query, whole = analyse(tree)
    return (exact, query) if whole else (None, both(query, of_strings(exact)))


def trigram_query(rule: Rule) -> Query:
    """The Boolean trigram query of a rule, over lower-cased text; True where it has no mandatory trigram."""
    exact, query, _ = analyse(_parser.parse(rule.pattern))
    return both(query, of_strings(exact))


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(trigrams, query[1]))


def answer(query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The texts that satisfy a query, as positions in order."""
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return postings[query]
    lists = sorted((answer(q, postings, n) for q in query[1]), key=len)
    out = lists[0]
    for other in lists[1:]:
        out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        if query[0] == "and" and not len(out):
            break
    return out


class Scanner:
    """Rules with their expressions and queries, to be used on many batches."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r, self.search(r), trigram_query(r)) for r in rules]
        self.indexed = sorted(set().union(*(trigrams(q) for _, _, q in self.rules)))
        # the number of each ASCII trigram of a query, at its code of three times seven bits; 0 for all others
        self.table = np.zeros(1 << 21, np.int16)
        for i, g in enumerate(self.indexed):
            if g.isascii():
                self.table[ord(g[0]) << 14 | ord(g[1]) << 7 | ord(g[2])] = i + 1

    @staticmethod
    def search(rule: Rule) -> re.Pattern:
        """The rule's expression; a run of one class that must be long is searched for as a long run at once."""
        if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
            rule = Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least, rule.ignore_case)
        return rule.compiled()

    def index(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Posting lists of the trigrams that some query needs, from one pass over all characters."""
        lowered = [t.lower() for t in texts]
        chars = np.minimum(np.frombuffer("\x7f\x7f".join(lowered).encode("utf-32-le"), np.uint32), 127).astype(np.int32)
        numbers = self.table[chars[:-2] << 14 | chars[1:-1] << 7 | chars[2:]] if len(chars) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(numbers)
        starts = np.cumsum([0, *(len(t) + 2 for t in lowered)])[:-1]
        pairs = np.unique(numbers[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, side="right") - 1)
        ends = np.searchsorted(pairs, np.arange(1, len(self.indexed) + 2) * len(texts))
        found = {g: pairs[a:b] % len(texts) for g, a, b in zip(self.indexed, ends[:-1], ends[1:])}
        return found | {g: np.array([i for i, t in enumerate(lowered) if g in t], np.int64) for g in self.indexed if not g.isascii() or "\x7f" in g}

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule, end) of all matches, by start and then rule."""
        if not texts:
            return []
        postings = self.index(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in answer(query, postings, len(texts)).tolist():
                for m in expression.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        return [sorted(found) for found in out]


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def scan_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base_rules: Sequence[Rule] = BASE_RULES,
    more_rules: Sequence[Rule] = MORE_RULES,
    redact: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """doc_id (or the columns of keep) and spans of every row, ordered by start and then by rule.

    Offsets are code points, ends exclusive. Matches of one rule are leftmost and do not overlap; those of different
    rules may. With redact a column `redacted` holds the text with every covered stretch replaced. A null text counts
    as empty and has no spans (its redacted text stays null); a very long text is scanned whole; a null id stays null; repeated rows come back as often as
    they occur; an empty table gives no rows. Other columns are left out, whatever their names.
    """
    rules, n_base = [*base_rules, *more_rules], len(base_rules)
    kinds = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    columns = [F.col(c) for c in keep] if keep else [F.col(id_col).cast("long").alias("doc_id")]
    rows = bounded(df).select(*columns, F.col(text_col).cast("string").alias("text of"))
    names = [f.name for f in rows.schema.fields if f.name != "text of"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in slices(batch, "text of"):
                texts = texts_of(part, "text of")
                found = scanner.scan(texts)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = [x for f in found for x in f]
                fields = [[kinds[k] for _, k, _ in flat], [s for s, _, _ in flat], [e for _, _, e in flat], [k < n_base for _, k, _ in flat]]
                spans = pa.StructArray.from_arrays([pa.array(c, span.field(i).type) for i, c in enumerate(fields)], fields=list(span))
                out = [*(part.column(i) for i in range(len(names))), pa.ListArray.from_arrays(offsets, spans)]
                if redact is not None:
                    out.append(pa.array([None if t is None else replaced(t, f, redact) for t, f in zip(part.column("text of").to_pylist(), found)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*names, "spans", *["redacted"] * (redact is not None)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text of")
    return rows.mapInArrow(scan, f"{schema}, spans {SPANS}" + ", redacted string" * (redact is not None))


def replaced(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """A text with each covered stretch replaced by one mark."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
