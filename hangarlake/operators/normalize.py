"""Dictionaries, the rule normalizer and its guards."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarlake.functions import align
from hangarlake.functions import text as x

#: Entries of a dictionary at most: it becomes a literal map of the plan.
ENTRIES = 50_000
#: Number words that a guard reads as numbers.
NUMBER_WORDS = {w: str(i) for i, w in enumerate(x.fixed.ONES)} | {w: str(20 + 10 * i) for i, w in enumerate(x.fixed.TENS)}


def dictionary(abbreviations: DataFrame, misspellings: DataFrame, keep: tuple[str, ...] = (), least_size: int = 4) -> DataFrame:
    """(key, expansion, kind): lower-case keys with one expansion; kept words and ambiguous keys are left out, abbreviations go before misspellings."""
    one = lambda df, kind, ok: (
        df.toDF("key", "expansion").filter(ok).groupBy(F.lower("key").alias("key")).agg(F.count_distinct("expansion").alias("n"), F.min("expansion").alias("expansion"))
        .select("key", "expansion", F.lit(kind).alias("kind"), "n")
    )
    first = one(abbreviations.select("abbrev", "expansion"), "abbreviation", F.lit(True))
    second = one(misspellings.select("misspelling", "correction"), "misspelling", F.length("key") >= least_size).join(first.select("key"), "key", "left_anti")
    return first.unionByName(second).filter((F.col("n") == 1) & ~F.col("key").isin(*keep)).select("key", "expansion", "kind")


def entries(words: DataFrame) -> dict[str, str]:
    rows = words.select("key", "expansion").limit(ENTRIES + 1).collect()
    if len(rows) > ENTRIES:
        raise ValueError(f"a dictionary has more than {ENTRIES} entries")
    return dict(sorted((r[0], r[1]) for r in rows if None not in r))


def expanded(text: str, words: DataFrame) -> Column:
    """The text's words in lower case, each replaced by its entry; other signs are dropped."""
    pairs = entries(words) | {"&": "and"}
    table = F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])
    return F.array_join(F.transform(x.tokens(text, "[a-z0-9]+|&"), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def normalized_by_rules(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, raw, rules, applied): upper-case text with entries, number signs and symbols written out.

    Identifiers, measurements, directions and negations stay as they are.
    ``applied`` counts the entries that were used.
    """
    pairs = entries(words)
    symbols = {"&": "and", "@": "at", "+": "plus", "=": "equals"}
    guards = [re.compile(p, re.I) for p in x.fixed.PROTECTED]

    @F.pandas_udf("struct<rules:string,applied:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in texts:
            plain, used, out = align.plain(raw), 0, []
            kept = [m.span() for g in guards for m in g.finditer(plain)]
            for token, begin, end, kind in align.typed_tokens(plain):
                guarded = any(a <= begin and end <= b for a, b in kept)
                low = token.lower()
                if kind == "ws" or token in "()":
                    out.append(" ")
                elif kind == "numref":
                    out.append(" NUMBER " + re.sub(r"[^0-9A-Za-z]", "", token).upper() + " ")
                elif low in pairs and not guarded:
                    used += 1
                    out.append(pairs[low].upper())
                elif token in symbols:
                    used += 1
                    out.append(f" {symbols[token].upper()} ")
                else:
                    out.append(token.upper())
            rows.append((align.rendered("".join(out).split()), used))
        return pd.DataFrame(rows, columns=["rules", "applied"])

    return df.select(key, F.col(text).alias("raw"), run(text).alias("r")).select(key, "raw", "r.rules", "r.applied")


def aligned_by_rules(df: DataFrame, key: str, text: str, words: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """(key, normalized, steps, expansions): lower-case text with phrases mended first, then entries, number signs and symbols word by word.

    Brackets are dropped. ``steps`` has each token of the mended text with its
    place, what it became and the rule that applied.
    """
    pairs = entries(words)
    kinds = dict((r[0], r[1]) for r in words.select("key", "kind").limit(ENTRIES + 1).collect())
    mended = [(re.compile(rf"\b{re.escape(a)}\b", re.I), b) for a, b in sorted((phrases or {}).items(), key=lambda p: (-len(p[0]), p[0]))]
    symbols = {"&": "and", "@": "at", "+": "plus", "=": "equals", "#": "number"}

    def became(token: str, kind: str) -> tuple[str, str]:
        low = token.lower()
        if token in "()":
            return "", "drop_bracket"
        if kind == "numref":
            return f"number {low.lstrip('#').strip()}", "numref"
        if kind == "symbol" and token in symbols:
            return symbols[token], "symbol"
        return (pairs[low], kinds.get(low, "entry")) if kind in ("word", "slash") and low in pairs else (low, "keep")

    @F.pandas_udf("struct<normalized:string,steps:array<struct<token:string,begin:int,end:int,target:string,rule:string>>,expansions:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in texts:
            plain = align.plain(raw)
            for pattern, right in mended:
                plain = pattern.sub(right, plain)
            steps = [(t, b, e, *became(t, k)) for t, b, e, k in align.typed_tokens(plain) if k != "ws"]
            rows.append((align.rendered([s[3] for s in steps]), [dict(zip(("token", "begin", "end", "target", "rule"), s, strict=True)) for s in steps], sum(s[4] not in ("keep", "drop_bracket") for s in steps)))
        return pd.DataFrame(rows, columns=["normalized", "steps", "expansions"])

    return df.select(key, run(text).alias("r")).select(key, "r.*")


def shielded_by_rules(text: Column, words: DataFrame) -> Column:
    """Upper-case text with entries, longest first, and number signs written out; protected values come through letter for letter.

    A text is taken apart into protected values and what lies between, and only the latter is rewritten.
    """
    shield = "|".join(f"(?:{p})" for p in x.fixed.PROTECTED)
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?is)({shield})|((?:(?!{shield}).)+)"), F.lit(0))

    def rewritten(piece: Column) -> Column:
        out = piece
        for a, b in sorted(entries(words).items(), key=lambda p: (-len(p[0]), p[0])):
            out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z0-9_]){re.escape(a)}(?![A-Za-z0-9_])", b.replace("\\", "\\\\").replace("$", "\\$"))
        return F.upper(F.regexp_replace(out, r"#\s*([0-9]+)", "number $1"))

    each = F.transform(pieces, lambda v: F.when(v.rlike(rf"(?i)^(?:{shield})$"), v).otherwise(rewritten(v)))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(each, ""), r"\s+", " "), r"\s+([,.;:!?])", "$1"))


def rewrite_problems(source: Column, rules: Column, candidate: Column) -> Column:
    """What speaks against a rewriting that a model made: numbers, identifiers or directions that changed, new number words, a length out of all proportion."""
    number = r"[0-9]+(?:[.,][0-9]+)?"
    values = lambda c, p: F.array_sort(F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(p), F.lit(0)), lambda v: F.replace(v, F.lit(","), F.lit("."))))
    words = r"\b(?:" + "|".join((*x.fixed.ONES, *x.fixed.TENS, "hundred", "thousand", "million")) + r")\b"
    parts = r"\b(?=[a-z0-9-]*[0-9])(?=[a-z0-9-]*[a-z])[a-z0-9-]{4,}\b"
    directions = r"\b(?:left|right|upper|lower|front|rear|forward|aft|inboard|outboard|top|bottom)\b"
    sets = lambda c, p: F.array_distinct(values(c, p))
    size = F.length(F.coalesce(rules, F.lit("")))
    checks = {
        "empty": F.trim(F.coalesce(candidate, F.lit(""))) == "",
        "numbers": values(source, number) != values(candidate, number),
        "number_words": F.size(F.array_except(sets(candidate, words), sets(rules, words))) > 0,
        "identifiers": values(source, parts) != values(candidate, parts),
        "directions": F.array_sort(sets(rules, directions)) != F.array_sort(sets(candidate, directions)),
        "too_long": F.length(candidate) > F.greatest(F.lit(5000), size * 3 + 80),
        "too_short": F.length(candidate) < F.greatest(F.lit(3), F.floor(size * 0.35)),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda v: v.isNotNull())


def numbers_in(text: Column) -> Column:
    """The numbers of a text, written in digits or as a word up to twenty or a ten."""
    text = F.coalesce(text, F.lit(""))
    spelled = F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(NUMBER_WORDS) + r")\b"), F.lit(1))
    table = F.create_map(*[F.lit(v) for kv in NUMBER_WORDS.items() for v in kv])
    return F.concat(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), F.transform(spelled, lambda w: F.element_at(table, w)))


def guarded(source: Column, candidate: Column) -> Column:
    """Whether a rewriting keeps every protected value, as a word of its own or a direction's other form, and adds no number; number words count as numbers."""
    upper = F.upper(F.coalesce(candidate, F.lit("")))
    forms = F.transform(x.protected(F.upper(source)), lambda v: F.regexp_replace(v, r"[./-]+$", ""))
    same = {"LH": "LEFT", "RH": "RIGHT", "L/H": "LEFT", "R/H": "RIGHT"}
    alone = lambda v: F.regexp_like(upper, F.concat(F.lit(r"(^|[^A-Z0-9])\Q"), v, F.lit(r"\E($|[^A-Z0-9])")))
    kept = F.forall(forms, lambda v: alone(v) | alone(x.mapped(v, same)))
    return kept & (F.size(F.array_except(numbers_in(upper), numbers_in(source))) == 0)


def safest(df: DataFrame) -> DataFrame:
    """(..., text, choice): the candidate if it is safe, else the rules' text if it is, else the raw one."""
    a, b = guarded(F.col("raw"), F.col("candidate")), guarded(F.col("raw"), F.col("rules"))
    return df.withColumn("text", F.when(a, F.col("candidate")).when(b, F.col("rules")).otherwise(F.col("raw"))).withColumn("choice", F.when(a, "candidate").when(b, "rules").otherwise("raw"))


def pair_category(raw: str, reference: str, ratio: Column | None = None) -> Column:
    """How a reference differs from its raw text; the first category that fits. ``ratio`` is the likeness of both, without which many added words alone tell an addition."""
    a, b = x.tokens(raw, "[a-z0-9]+"), x.tokens(reference, "[a-z0-9]+")
    last_a, last_b = F.get(a, F.size(a) - 1), F.get(b, F.size(b) - 1)
    r, t = F.col(raw), F.col(reference)
    completed = (F.size(a) > 0) & (F.size(b) > 0) & last_b.startswith(last_a) & (F.length(last_b) >= F.length(last_a) + 2) & ~r.rlike(r"[.!?]$")
    added = F.greatest(F.lit(0), F.size(b) - F.size(a))
    much = added / F.greatest(F.lit(1), F.size(a)) > 0.35
    if ratio is not None:
        much = much | ((ratio < 0.55) & (added > 2))
    opened = F.exists(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: (F.length(z["a"]) <= 5) & (F.length(z["b"]) > 5))
    return (
        F.when((r == "") | (t == ""), "unmatched_or_empty").when(r == t, "unchanged").when(F.lower(r) == F.lower(t), "formatting_only")
        .when(completed, "possible_truncation_reconstruction").when(much, "possible_unsupported_addition")
        .when(F.coalesce(opened, F.lit(False)), "possible_abbreviation_expansion").otherwise("lexical_edit")
    )


def flagged_category(category: Column, edit: Column, same_source: Column) -> Column:
    """A category under an editor's flags: another source goes before a completion, that before an anonymized text, that before a cut one."""
    edit = F.coalesce(edit, F.lit(""))
    return (
        F.when(~F.coalesce(same_source, F.lit(False)), "source_mismatch").when(F.contains(edit, F.lit("ANON")), "anonymized_completion")
        .when(F.contains(edit, F.lit("CUTOFF - C")), "reference_completion").when(F.contains(edit, F.lit("CUTOFF - T")), "reference_truncation").otherwise(category)
    )


def numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, align.number_forms(text).alias("n")).select(key, "n.digits", "n.words")


def learned_replacements(pairs: DataFrame) -> DataFrame:
    """(source, target, n): for each replaced word its most frequent replacement, ties to the smaller."""
    found = pairs.select(F.explode(align.replaced_words("raw", "reference")).alias("r")).groupBy("r.source", "r.target").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("target", "n"), F.struct("n", F.reverse(F.col("target"))))
    return found.groupBy("source").agg(best.alias("b")).select("source", "b.target", "b.n")


def replaced(df: DataFrame, key: str, text: str, learned: DataFrame) -> DataFrame:
    """(key, text, reference, applied): words exchanged by a table of replacements; it may be large, so the words are joined with it."""
    words = df.select(key, text, "reference", F.posexplode(F.split(text, r"\s+")).alias("_at", "_w"))
    found = words.join(learned.select(F.col("source").alias("_k"), "target"), F.lower("_w") == F.col("_k"), "left")
    again = found.groupBy(key, text, "reference").agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("target", "_w").alias("w")))).alias("_l"))
    return again.select(key, text, "reference", F.array_join(F.transform("_l", lambda v: v["w"]), " ").alias("applied"))


def layered(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, expansion, origin): entries of several dictionaries; of a key's the earliest one counts."""
    rows = None
    for place, (origin, df) in enumerate(parts):
        one = df.select("key", F.struct(F.lit(place).alias("place"), "expansion", F.lit(origin).alias("origin")).alias("_e"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("key").agg(F.min("_e").alias("_e")).select("key", "_e.expansion", "_e.origin")


def names(terms: DataFrame, kind: str) -> list[str]:
    """The names of a list's kind in lower case, longest first; more than a literal of the plan may hold is a ValueError."""
    rows = terms.filter(F.col("kind") == kind).select(F.lower("term")).distinct().limit(ENTRIES + 1).collect()
    if len(rows) > ENTRIES:
        raise ValueError(f"a list has more than {ENTRIES} names")
    return sorted((r[0] for r in rows if r[0]), key=lambda t: (-len(t), t))


def named_components(df: DataFrame, terms: DataFrame, key: str, text: str, kind: str = "component", synonyms: DataFrame | None = None) -> DataFrame:
    """(key, components): the distinct names of a list in a text, in order, the longest first where names overlap.

    ``synonyms`` (key, expansion) are other spellings of words of the names; a
    name found in such a spelling counts as itself.
    """
    known = names(terms, kind)
    if not known:
        return df.select(key, F.array().cast("array<string>").alias("components"))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    if synonyms is not None:
        words = entries(synonyms)
        low = F.array_join(F.transform(F.regexp_extract_all(low, F.lit(r"[a-z0-9]+|[^a-z0-9]+"), F.lit(0)), lambda w: x.mapped(w, words)), "")
    pattern = r"\b(" + "|".join(re.escape(t) for t in known) + r")\b"
    return df.select(key, F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1))).alias("components"))
