"""What built-in functions can't express: typed tokens with places, alignments, number words. Arrow batches throughout."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarlake.functions import fixed

# Signs that are written plainly.
PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\xa0": " ", "﻿": "", "°": "*"}
# Patterns of the kinds of tokens, of which the first that fits counts, and the names under which two of them go.
KINDS = (
    ("wslash", r"[wW]/[oO]?(?![A-Za-z])"),
    ("slash", r"[A-Za-z]{1,4}/[A-Za-z]{1,4}"),
    ("numref", r"\#\s?\d+[A-Za-z]?"),
    ("word", r"[A-Za-z]+(?:'[A-Za-z]+)?"),
    ("num", r"\d+(?:[.,/]\d+)?"),
    ("sym", r"""[&@+*=>"'#]"""),
    ("ws", r"\s+"),
    ("punct", r"[^\sA-Za-z0-9]"),
)
KIND_NAMES = {"wslash": "slash", "sym": "symbol"}


def vectorized(kind: str):
    """A pandas function made when first used, as types are read by a session."""

    def wrap(function):
        return lambda *columns: F.pandas_udf(function, kind)(*columns)

    return wrap


_TOKEN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in KINDS))


def plain(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").translate(str.maketrans(PLAIN))


def typed_tokens(text: str | None) -> list[tuple[str, int, int, str]]:
    return [(m.group(), m.start(), m.end(), KIND_NAMES.get(m.lastgroup, m.lastgroup)) for m in _TOKEN.finditer(plain(text))]


def rendered(words: list[str]) -> str:
    return re.sub(r"\s{2,}", " ", re.sub(r"\s+([,.;:!?])", r"\1", " ".join(w for w in words if w))).strip()


@vectorized("struct<tokens:array<struct<text:string,begin:int,end:int,kind:string>>,rendered:string>")
def _typed(texts: pd.Series) -> pd.DataFrame:
    rows = [typed_tokens(t) for t in texts]
    return pd.DataFrame({"tokens": [[{"text": a, "begin": b, "end": c, "kind": k} for a, b, c, k in r if k != "ws"] for r in rows], "rendered": [rendered([a for a, _, _, k in r if k != "ws"]) for r in rows]})


def with_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens, rendered): typed tokens with their places in the plainly written text, and the text from them."""
    return df.select(key, _typed(text).alias("t")).select(key, "t.tokens", "t.rendered")


@vectorized("string")
def nfkc_key(texts: pd.Series) -> pd.Series:
    """A label's canonical form: compatible characters, folded case, single blanks, no outer signs."""
    return texts.map(lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").casefold()).strip(" \t\r\n.,;:-"))


_SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000}
_VALUES = {w: i for i, w in enumerate(fixed.ONES)} | {w: 20 + 10 * i for i, w in enumerate(fixed.TENS)}


def number_of(words: list[str]) -> int:
    """The value of a phrase of number words, by the grammar: what stands before a scale is multiplied by it, what stands behind is added."""
    for at, word in enumerate(words):
        if word in ("thousand", "million"):
            return (number_of(words[:at]) or 1) * _SCALES[word] + number_of(words[at + 1 :])
    head, scale, tail = "\n".join(words).rpartition("hundred")
    return (number_of(head.split()) or 1) * 100 + number_of(tail.split()) if scale else sum(_VALUES[w] for w in words)


def _number_phrase() -> re.Pattern:
    """Number words that belong together: signs that divide a list end a phrase, "and" goes on with one after a scale."""
    around, dividing = r'[.()"]*', r'[.,;:()"]*'
    units, scales = "|".join(_VALUES), "|".join(_SCALES)
    inner = rf"(?:{around}(?:{units}){around}|{around}(?:{scales}){around}(?:\s{around}and{around}(?!\S))?)"
    return re.compile(rf"(?<!\S)(?:{inner}\s)*(?:{inner}|{dividing}(?:{units}|{scales}){dividing})(?!\S)", re.I)


_PHRASE = _number_phrase()


def digitized(text: str | None) -> str:
    """Number words as digits; signs behind the last one stay."""

    def digits(phrase: re.Match) -> str:
        words = [w for w in re.findall("[a-z]+", phrase.group().lower()) if w != "and"]
        return str(number_of(words)) + re.sub(r'[^.,;:)"]', "", phrase.group().split()[-1])

    return _PHRASE.sub(digits, " ".join((text or "").split()))


def _below_thousand(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    small = fixed.ONES[rest] if rest < 20 else " ".join([fixed.TENS[rest // 10 - 2], *([fixed.ONES[rest % 10]] if rest % 10 else [])])
    return " and ".join([*([f"{fixed.ONES[hundreds]} hundred"] if hundreds else []), *([small] if rest else [])])


def number_in_words(n: int) -> str:
    """A number below a million in words; larger ones stay digits."""
    if n >= 1_000_000:
        return str(n)
    groups = ((n // 1000, " thousand"), (n % 1000, ""))
    return " ".join(_below_thousand(part) + name for part, name in groups if part) or fixed.ONES[0]


def spelled(text: str | None) -> str:
    """Whole numbers of up to six digits in words; signs behind one stay."""
    return re.sub(r'(?<!\S)[.,;:()"]*([0-9]{1,6})([.,;:)"]*)(?!\S)', lambda m: number_in_words(int(m[1])) + m[2], " ".join((text or "").split()))


@vectorized("struct<digits:string,words:string>")
def number_forms(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"digits": [digitized(t) for t in texts], "words": [spelled(t) for t in texts]})


def word_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def changes(source: list[str], target: list[str]) -> Counter:
    """The edits that turn one word list into another, as a multiset."""
    steps = SequenceMatcher(None, source, target, autojunk=False).get_opcodes()
    return Counter((tag, tuple(source[a:b]), tuple(target[c:d])) for tag, a, b, c, d in steps if tag != "equal")


_STATISTICS = "edits long, units long, raw_edits long, exact long, hit long, predicted long, gold long"


@vectorized(f"struct<{_STATISTICS.replace(' long', ':long')}>")
def _statistics(raw: pd.Series, hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
    rows = []
    for s, h, r in zip(raw, hypothesis, reference, strict=True):
        a, b, c = (s or "").split(), (h or "").split(), (r or "").split()
        ours, theirs = changes(a, b), changes(a, c)
        rows.append((word_distance(b, c), len(c), word_distance(a, c), int(h == r), sum((ours & theirs).values()), sum(ours.values()), sum(theirs.values())))
    return pd.DataFrame(rows, columns=["edits", "units", "raw_edits", "exact", "hit", "predicted", "gold"])


def row_statistics(df: DataFrame) -> DataFrame:
    """The additive statistics of each (raw, hypothesis, reference): resampling adds them up and never scores again."""
    return df.withColumn("s", _statistics("raw", "hypothesis", "reference")).select("*", "s.*").drop("s")


def pair_statistics(df: DataFrame) -> DataFrame:
    sums = row_statistics(df).agg(F.count("*").alias("pairs"), *[F.sum(c).alias(c) for c in ("edits", "units", "raw_edits", "exact", "hit", "predicted", "gold")])
    rate = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return sums.select("*", rate("edits", "units").alias("wer"), rate("raw_edits", "units").alias("raw_wer"), rate("hit", "predicted").alias("change_precision"), rate("hit", "gold").alias("change_recall"))


def exchanged(source: list[str], target: list[str]) -> list[tuple[str, str]]:
    """The words that stand for each other between stretches that agree but for case, where as many were taken out as put in."""
    agreeing = SequenceMatcher(None, [w.lower() for w in source], [w.lower() for w in target], autojunk=False).get_matching_blocks()
    out, i, k = [], 0, 0
    for block in agreeing:
        left, right = source[i : block.a], target[k : block.b]
        out += zip(left, right, strict=True) if len(left) == len(right) else []
        i, k = block.a + block.size, block.b + block.size
    return out


@vectorized("array<struct<source:string,target:string>>")
def replaced_words(raw: pd.Series, reference: pd.Series) -> pd.Series:
    pairs = (exchanged((s or "").split(), (t or "").split()) for s, t in zip(raw, reference, strict=True))
    return pd.Series([[{"source": a.lower(), "target": b} for a, b in found] for found in pairs])


@vectorized("double")
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the signs in agreeing stretches over the signs of both texts, in lower case."""
    return pd.Series([SequenceMatcher(None, (s or "").lower(), (t or "").lower(), autojunk=len(t or "") >= 200).ratio() for s, t in zip(a, b, strict=True)])


def greedy_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that don't overlap: the longest first, then the earliest, then by name."""
    taken: list[tuple[int, int, str]] = []
    for begin, end, name in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(end <= a or begin >= b for a, b, _ in taken):
            taken.append((begin, end, name))
    return sorted(taken)


def lexicon_spans(names: list[tuple[str, str]], patterns: list[tuple[str, str]], text: Column) -> Column:
    """Spans of names (kind, name) and of patterns (kind, regular expression) in a text, without overlaps; all names are looked for in one pass."""
    compiled = [(kind, re.compile(pattern)) for kind, pattern in patterns]

    @F.pandas_udf("array<struct<begin:int,end:int,name:string>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, name in names:
            if name:
                automaton.add_word(name.lower(), (len(name), kind))
        if len(automaton):
            automaton.make_automaton()
        for batch in texts:
            rows = []
            for t in batch:
                low = (t or "").lower()
                hits = [(end - size + 1, end + 1, kind) for end, (size, kind) in automaton.iter(low)] if len(automaton) else []
                spans = [h for h in hits if not (h[0] and low[h[0] - 1].isalnum()) and not (h[1] < len(low) and low[h[1]].isalnum())]
                spans += [(m.start(), m.end(), kind) for kind, p in compiled for m in p.finditer(low) if m.end() > m.start()]
                rows.append([{"begin": a, "end": b, "name": c} for a, b, c in greedy_spans(spans)])
            yield pd.Series(rows)

    return found(text)
