"""Problem 3: free-entered values mapped to a canonical list.

An Aho-Corasick automaton over the spellings of the canonical names' words and
their aliases finds these in a value; stretches of them that follow each other
and spell a name, by a trie over the names, are mentions. A name with many
aliases needs no list of its variants. Of overlapping mentions the longest
counts. What holds no mention goes to token-set similarity: the words of a name
are looked for among the value's words, in any order, allowing for spelling
errors; values whose words run together are compared by their letter pairs.

Values are mapped once each, however many rows have them. The list and the
aliases are small reference tables; their rows are counted before they are sent
to the executors.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.session import cut, sent

#: Rows of the reference tables at most; all are sent to every executor.
REFERENCE_ROWS = 100_000


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) that turn a into b, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _within(short: str, long: str) -> int:
    """Edits that turn ``short`` into some substring of ``long``."""
    row = [0] * (len(long) + 1)
    for i, x in enumerate(short, 1):
        new = [i]
        for j, y in enumerate(long, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def _pairs(text: str) -> set[str]:
    text = f"^{text}$"
    return {text[i : i + 2] for i in range(len(text) - 1)}


def _bag(words: list[str]) -> np.ndarray:
    """How often each letter and digit stands in each word."""
    out = np.zeros((len(words), 36), np.int16)
    for i, word in enumerate(words):
        for sign in word:
            out[i, ord(sign) - (97 if sign >= "a" else 22)] += 1
    return out


class Mapper:
    """Maps values of one kind. ``terms``: (term_id, name); ``aliases``: (other spelling, words)."""

    def __init__(self, terms: list[tuple[int, str]], aliases: list[tuple[str, str]], least_word: float = 0.6, least_value: float = 0.72, least_run: float = 0.74):
        self.least_word, self.least_value, self.least_run = least_word, least_value, least_run
        self.literal = {name for _, name in terms}
        self.terms = [(term_id, _words(name)) for term_id, name in sorted(terms) if _words(name)]
        self.names: dict = {}
        self.turned: dict = {}
        for term_id, words in self.terms:
            self._plant(self.names, words, term_id)
        for term_id, words in self.terms:
            for turn in range(len(words) if len(words) > 1 else 0):
                self._plant(self.turned, words[turn:] + words[:turn], term_id)
        own = {word for _, words in self.terms for word in words}
        spelled: dict[str, set[tuple[str, ...]]] = {word: {(word,)} for word in own}
        for spelling, meant in aliases:
            words = tuple(_words(meant))
            if words and _words(spelling) and own.issuperset(words):
                spelled.setdefault(" ".join(_words(spelling)), set()).add(words)
        self.spaced = self._automaton({f" {s}{ending} ": w for s, w in spelled.items() for ending in ("s", "")})
        self.joined = self._automaton({s.replace(" ", "") + ending: w for s, w in spelled.items() for ending in ("s", "")})
        self.spellings = {s: {w for words in meant for w in words} for s, meant in spelled.items() if " " not in s}
        self.near_names = sorted(self.spellings)
        self.bags, self.sizes = _bag(self.near_names), np.array([len(s) for s in self.near_names], int)
        self.by_word = defaultdict(list)
        for place, (_, words) in enumerate(self.terms):
            for word in words:
                self.by_word[word].append(place)
        runs = [(i, "".join(words[n:] + words[:n])) for i, (_, words) in enumerate(self.terms) for n in range(len(words))]
        self.bits = {pair: 1 << i for i, pair in enumerate(sorted({p for _, run in runs for p in _pairs(run)}))}
        self.runs = []
        for i, run in runs:
            # Each edit takes two pairs at most, and so do the ends of a name that stands within a value.
            least = len(_pairs(run)) - 2 * int(len(run) * (1 - self.least_run) + 1e-9) - 2
            self.runs.append((i, run, self._mask(run), least))
        self.known_words: dict[str, dict[str, float]] = {}

    @staticmethod
    def _plant(trie: dict, words: list[str], term_id: int) -> None:
        for word in words:
            trie = trie.setdefault(word, {})
        trie.setdefault(None, term_id)

    @staticmethod
    def _automaton(patterns: dict[str, set[tuple[str, ...]]]):
        import ahocorasick

        out = ahocorasick.Automaton()
        for pattern, meant in patterns.items():
            out.add_word(pattern, (len(pattern), sorted(meant)))
        if len(out):
            out.make_automaton()
        return out

    def _mask(self, text: str) -> int:
        mask = 0
        for pair in _pairs(text):
            mask |= self.bits.get(pair, 0)
        return mask

    @staticmethod
    def mentions(automaton, trie: dict, text: str, step: int) -> list[tuple[int, int, int]]:
        """(start, end, term id) of the longest mentions that don't overlap; a word's spelling begins ``step`` behind the end of the one before."""
        if not len(automaton):
            return []
        starts = defaultdict(list)
        for end, (size, meant) in automaton.iter(text):
            starts[end - size + 1].append((end, meant))
        found = set()
        for start in starts:
            open_ends = [(start, trie)]
            while open_ends:
                at, branch = open_ends.pop()
                for end, meant in starts.get(at, ()):
                    for words in meant:
                        node = branch
                        for word in words:
                            node = node.get(word)
                            if node is None:
                                break
                        else:
                            if None in node:
                                found.add((start, end, node[None]))
                            if len(node) > (None in node):
                                open_ends.append((end + step, node))
        taken: list[tuple[int, int, int]] = []
        for start, end, term_id in sorted(found, key=lambda x: (x[0] - x[1], x[0], x[2])):
            if all(end + step <= s or start >= e + step for s, e, _ in taken):
                taken.append((start, end, term_id))
        return taken

    def _near(self, word: str) -> dict[str, float]:
        """The canonical words that a value's word may stand for, with their likeness."""
        if word in self.known_words:
            return self.known_words[word]
        out = {w: 1.0 for w in self.spellings.get(word, ())}
        forms = {word, word[:-1]} if word.endswith("s") and len(word) > 3 else {word}
        for form in forms:
            for w in self.spellings.get(form, ()):
                out[w] = max(out.get(w, 0), 0.98)
        if not out and len(word) > 2 and not word.isdigit() and self.near_names:
            size = np.maximum(self.sizes, len(word))
            most = np.maximum((size * (1 - self.least_word)).astype(int), 2)
            for form in forms:
                # Edits are at least the letters that one of the two has and the other lacks.
                apart = self.bags - _bag([form])
                lack = np.maximum(np.where(apart > 0, apart, 0).sum(1), np.where(apart < 0, -apart, 0).sum(1))
                for i in np.flatnonzero(lack <= most):
                    spelling, longer = self.near_names[i], int(size[i])
                    # Two errors in a short word still leave it known by its first and last letter.
                    framed = 3 <= longer <= 5 and form[0] == spelling[0] and form[-1] == spelling[-1]
                    limit = max(int(longer * (1 - self.least_word)), 2 * framed)
                    d = distance(form, spelling, limit)
                    if d <= limit:
                        for w in self.spellings[spelling]:
                            out[w] = max(out.get(w, 0), 1 - d / longer, self.least_word * framed)
        if len(self.known_words) > 200_000:
            self.known_words.clear()
        self.known_words[word] = out
        return out

    def _similar(self, words: list[str]) -> int | None:
        found: dict[str, float] = {}
        for word in words:
            for canonical, likeness in self._near(word).items():
                found[canonical] = max(found.get(canonical, 0), likeness)
        best = None
        for place in sorted({p for word in found for p in self.by_word[word]}):
            term_id, parts = self.terms[place]
            weight = sum(map(len, parts))
            score = sum(len(p) * found.get(p, 0.0) for p in parts) / weight
            missing = sum(p not in found for p in parts)
            # One word of several may be spelled past recognition, if the others are certain.
            if missing and not (missing == 1 and len(parts) > 2 and len(words) >= len(parts) and score >= 0.6):
                continue
            if missing == 0 and score < self.least_value:
                continue
            rank = (missing == 0, score, weight)
            if best is None or rank > best[0]:
                best = (rank, term_id)
        return best[1] if best else None

    def _run(self, text: str) -> int | None:
        """The name that stands in a value whose words run together or are broken, by its letter pairs and then its edits."""
        if len(text) < 5:
            return None
        mask, best = self._mask(text), None
        for i, run, own, least in self.runs:
            if (own & mask).bit_count() >= max(least, 1):
                score = 1 - _within(run, text) / len(run)
                if score >= self.least_run and (best is None or score > best[0]):
                    best = (score, self.terms[i][0])
        return best[1] if best else None

    def map(self, value: str | None) -> int | None:
        """The term id, 0 for none; null where the value is null, blank or literally a name."""
        if value is None or not value.strip() or value in self.literal:
            return None
        words = _words(value)
        if not words or not self.terms:
            return 0
        found = self.mentions(self.spaced, self.names, f" {' '.join(words)} ", 0) or self.mentions(self.joined, self.turned, "".join(words), 1)
        return found[0][2] if found else self._similar(words) or self._run("".join(words)) or 0


def _reference(df: DataFrame, *columns: str) -> list[tuple]:
    rows = df.select(*columns).limit(REFERENCE_ROWS + 1).collect()
    if len(rows) > REFERENCE_ROWS:
        raise ValueError(f"a reference table has more than {REFERENCE_ROWS} rows")
    return [tuple(r) for r in rows if None not in tuple(r)]


def _mapping(terms: list[tuple[int, str, str]], aliases: list[tuple[str, str]]):
    @F.pandas_udf("long")
    def mapped(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        mappers = {kind: Mapper([(t, name) for t, k, name in terms if k == kind], aliases) for kind in {k for _, k, _ in terms}}
        for kinds, values in batches:
            yield pd.Series([mappers[k].map(v) if k in mappers else 0 for k, v in zip(kinds, values, strict=True)], dtype="Int64")

    return mapped


def mapped_elements(df: DataFrame, canonical: DataFrame, aliases: list[DataFrame], fields: dict[str, str], record_id: str) -> DataFrame:
    """(record_id, field_name, pos, value, term_id) of each free-entered element."""
    terms = _reference(canonical, "term_id", "kind", "term")
    other = [row for table in aliases for row in _reference(table, *table.columns[:2])]
    rows = None
    for field, kind in fields.items():
        one = df.select(F.col(record_id).cast("string").alias("record_id"), F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), F.posexplode(F.col(field)).alias("pos", "value"))
        rows = one if rows is None else rows.unionByName(one)
    literal = canonical.select("kind", F.col("term").alias("value"))
    free = rows.filter(F.col("record_id").isNotNull() & F.col("value").rlike(r"[^\s\p{Z}\p{Cntrl}]")).join(F.broadcast(literal), ["kind", "value"], "left_anti")
    values = cut(free.select("kind", "value").distinct().withColumn("term_id", _mapping(terms, other)("kind", "value")))
    return free.join(sent(values), ["kind", "value"]).select("record_id", "field_name", F.col("pos").cast("long").alias("pos"), "value", "term_id")


def map_values(df: DataFrame, canonical: DataFrame, aliases: list[DataFrame], fields: dict[str, str], record_id: str = "record_id") -> DataFrame:
    """(record_id, field_name, pos, term_id) of each free-entered element of the array columns.

    ``fields`` names the kind of each column; ``canonical`` is (term_id, kind,
    term), ``aliases`` are two-column tables (other spelling, words). term_id is
    0 where nothing fits. Null arrays and null, blank or literally canonical
    elements, and rows without an id, give nothing; repeated rows count once.
    Elements of any length are searched whole. Other columns are ignored.
    """
    return mapped_elements(df, canonical, aliases, fields, record_id).select("record_id", "field_name", "pos", "term_id").filter("term_id is not null").distinct()


def unmatched_values(df: DataFrame, canonical: DataFrame, aliases: list[DataFrame], fields: dict[str, str], record_id: str = "record_id") -> DataFrame:
    """(field_name, value, records): the values that fit no entry, with the number of records that have them."""
    found = mapped_elements(df, canonical, aliases, fields, record_id).filter("term_id = 0")
    return found.select("field_name", "value", "record_id").distinct().groupBy("field_name", "value").agg(F.count("*").alias("records"))
