"""Column builders for text: all stay in the JVM, inside generated code where Spark allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hangarlake.functions import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x) -> Column:
    """Null to empty, runs of white space of any kind to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[\s\p{Z}]+", " "))


def canonical_id(x) -> Column:
    """An id as text, without the ".0" that number columns leave."""
    return F.regexp_replace(F.trim(_c(x)), r"^(\d+)\.0$", "$1")


def fingerprint(x) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+", " "))


def stable_hash(prefix: str, x, size: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(_c(x), 256), 1, size))


def near_key(x) -> Column:
    """Lower case without positions, numbers and signs; the order of the steps matters."""
    out = F.lower(F.coalesce(_c(x), F.lit("")))
    for pattern in (r"#\s?[0-9]+[a-z]?", r"\bnumber [0-9]+\b", r"[0-9]+", r"[^a-z ]", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def normalized_problem(x) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^A-Za-z0-9_\s#]", " "), r"\s+", " "))


def tokens(x, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(pattern), F.lit(group))


def any_of(x, patterns) -> Column:
    return _c(x).rlike("|".join(f"(?:{p})" for p in patterns))


def first_family(x, families, otherwise: str | None) -> Column:
    """The first family, in order, of which a pattern occurs."""
    low = F.lower(F.coalesce(_c(x), F.lit("")))
    return reduce(lambda out, f: F.when(any_of(low, f[1]), F.lit(f[0])).otherwise(out), reversed(families), F.lit(otherwise))


def action_family(x) -> Column:
    return first_family(x, fixed.ACTION_FAMILIES, "Other")


def issue_family(x) -> Column:
    return first_family(x, fixed.ISSUE_FAMILIES, None)


def action_role(family) -> Column:
    return F.when(_c(family).isin(*fixed.DIAGNOSTIC_FAMILIES), "diagnostic").otherwise("corrective")


def outcome(x) -> Column:
    low = F.lower(F.coalesce(_c(x), F.lit("")))
    good, bad = any_of(low, fixed.GOOD_OUTCOME), any_of(low, fixed.BAD_OUTCOME)
    return F.when(good & bad, "mixed").when(bad, "negative").when(good, "positive").otherwise("unknown")


def mapped(x, pairs: dict[str, str]) -> Column:
    """The value of ``pairs`` for x, else x."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv]), x), x)


def locations(x) -> Column:
    """Distinct position designators in order, in canonical form."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(fixed.LOCATION), F.lit(1))
    plain = F.transform(found, lambda v: F.regexp_replace(F.trim(v), r"\s+", " "))
    known = F.transform(plain, lambda v: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in fixed.LOCATION_FORMS.items() for y in kv]), F.replace(v, F.lit(" "), F.lit(""))), v))
    return F.array_distinct(F.transform(known, lambda v: F.regexp_replace(v, r"^(?:no\.?|number)\s*([0-9])", "#$1")))


def ascii_upper(x) -> Column:
    """Upper case of a-z alone, so that lengths stay."""
    return F.translate(_c(x), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def imperative(x) -> Column:
    """A leading past-tense verb as an imperative; the first that fits."""
    out = _c(x)
    for past, now in reversed(fixed.IMPERATIVES):
        pattern = rf"(?i)^{past}\b"
        out = F.when(_c(x).rlike(pattern), F.regexp_replace(_c(x), pattern, now)).otherwise(out)
    return out


def combined(a, b) -> Column:
    """Two parts as one text: a blank after a closing sign, else a full stop between them."""
    a, b = clean(a), clean(b)
    return F.when(a == "", b).when(b == "", a).when(a.rlike(r"[.!?]$"), F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, F.lit(". "), b))


def protected(x) -> Column:
    parts = [F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit("(?i)" + p), F.lit(0)) for p in fixed.PROTECTED]
    return F.concat(*parts)


def word_shape(x) -> Column:
    out = F.regexp_replace(_c(x), "[A-Z]", "X")
    return F.regexp_replace(F.regexp_replace(out, "[a-z]", "x"), "[0-9]", "d")


def ngrams(words, n: int) -> Column:
    """Runs of n elements of an array, joined by blanks."""
    last = F.size(words) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def char_grams(x, least: int = 3, most: int = 5) -> Column:
    """Runs of 3 to 5 characters within each word and the blanks around it, with repeats (scikit-learn's char_wb)."""
    def runs(word):
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.concat(*[of(n) for n in range(least, most + 1)])

    return F.flatten(F.transform(F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda w: w != ""), runs))
