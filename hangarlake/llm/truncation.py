"""Problem 2: text fields that lost their end.

For every source and field the lengths are taken as a right-censored sample: a
two-part normal mixture is fitted by maximum likelihood with the values at a
candidate limit counted as "at least so long". Where that explains the lengths
better than an uncensored fit, the limit holds, and a value at the limit is cut
with the posterior S(L) / (S(L) + f(L)). A value one short of a limit may have
been cut at a blank. Cuts at other lengths, as of broken transfers, have a rate
of their own for each source.

The evidence of an ending is how often a cut anywhere in all texts would leave
it, over how often whole texts have it. A cut within a word or at its end
leaves a beginning of the word; a cut behind it leaves the whole word and the
signs that follow it inside texts. Marks that a transfer puts behind a cut are
learned from the values that the words give away. All counts are over all rows.

A word seen fewer than ``COMMON`` times or with a digit, such as a serial number, counts by its length
only, unless it is the last one and begins a common word.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangarlake.session import cut, sent

_PARTS = re.compile("([a-z0-9]+)")
#: Occurrences from which a word counts as itself.
COMMON = 5
#: Cuts at other lengths than a limit, before any evidence.
CUT_RATE = 0.015
#: Letters from which a word counts by its length only; lengths beyond the second figure count alike.
_LONGEST, _LONGEST_SHAPE = 40, 12
_HELD = 200_000
#: How many times the usual number of cuts is allowed for in the counts of whole texts.
_SLACK = 4
#: Kinds of a value: elsewhere, one short of its limit, at its limit.
_ELSEWHERE, _SHORT, _FULL = 0, 1, 2


def _normal(x, mean, sd):
    return np.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))


def _beyond(x, mean, sd):
    return np.array([0.5 * math.erfc((x - m) / (s * math.sqrt(2))) for m, s in zip(mean, sd, strict=True)])


def fit_lengths(size: np.ndarray, n: np.ndarray, limit: int | None) -> tuple[float, float]:
    """(log likelihood, posterior of being cut at ``limit``) of a two-part normal mixture, by expectation maximization.

    With a limit the values of that length count half as seen, half as censored at first; the share is then refitted.
    """
    size, n = size.astype(float), n.astype(float)
    total = n.sum()
    mean0 = (size * n).sum() / total
    sd0 = max(1.0, math.sqrt((n * (size - mean0) ** 2).sum() / total))
    mean, sd, weight = np.array([mean0 - 0.7 * sd0, mean0 + 0.7 * sd0]), np.array([sd0, sd0]) * 0.7, np.array([0.5, 0.5])
    at = size == limit if limit is not None else np.zeros(len(size), bool)
    cut = 0.5
    for _ in range(60):
        dense = np.maximum(weight * np.stack([_normal(size, m, s) for m, s in zip(mean, sd, strict=True)], 1), 1e-300)
        share = dense / dense.sum(1, keepdims=True)
        seen = np.where(at, n * (1 - cut), n)
        part = share * seen[:, None]
        first, second = share * size[:, None], share * size[:, None] ** 2
        mass, sum1, sum2 = part.sum(0), (first * seen[:, None]).sum(0), (second * seen[:, None]).sum(0)
        if limit is not None:
            # What lies beyond the limit has the moments of a normal's upper tail.
            tail = np.maximum(weight * _beyond(limit + 0.5, mean, sd), 1e-300)
            own = n[at].sum() * cut * tail / tail.sum()
            z = (limit + 0.5 - mean) / sd
            hazard = _normal(z, 0, 1) / np.maximum(_beyond(limit + 0.5, mean, sd), 1e-12)
            mass, sum1 = mass + own, sum1 + own * (mean + sd * hazard)
            sum2 = sum2 + own * (mean**2 + sd**2 + sd * hazard * (limit + 0.5 + mean))
            f, s = dense[at].sum(), tail.sum()
            cut = s / (s + f)
        mass = np.maximum(mass, 1e-6)
        mean = sum1 / mass
        sd = np.sqrt(np.maximum(sum2 / mass - mean**2, 1.0))
        weight = mass / mass.sum()
    dense = np.maximum((weight * np.stack([_normal(size, m, s) for m, s in zip(mean, sd, strict=True)], 1)).sum(1), 1e-300)
    if limit is not None:
        dense = np.where(at, dense + max((weight * _beyond(limit + 0.5, mean, sd)).sum(), 1e-300), dense)
    return float((n * np.log(dense)).sum()), float(cut)


def _limit(rows: pd.DataFrame, least_share: float = 0.003, least_gain: float = 10.0) -> pd.DataFrame:
    """The field limit of one source and field (-1 if it has none), with the posterior of a cut there.

    A limit holds at least ``least_share`` of the values, and longer ones are
    stray: fewer than a thousandth of those at it. So there are few candidates.
    """
    rows = rows.sort_values("size")
    size, n = rows["size"].to_numpy(), rows["n"].to_numpy()
    beyond = n.sum() - np.cumsum(n)
    plain, best = None, None
    for i in np.flatnonzero((n >= least_share * n.sum()) & (beyond <= 0.001 * n)):
        plain = fit_lengths(size, n, None)[0] if plain is None else plain
        gain, share = fit_lengths(size[: i + 1], n[: i + 1], int(size[i]))
        if gain - plain > least_gain and (best is None or gain > best[0]):
            best = (gain, int(size[i]), share)
    return pd.DataFrame({"limit": [best[1] if best else -1], "cut": [best[2] if best else 0.0]})


def _counts(batches):
    """Word pairs and separators of (field, at the edge, lowered text).

    Pairs (field, word before, word): how often they go on, end a text, end it
    with signs, end it at or by its limit. Separators: before is null.
    """
    schema = ["field", "before", "word", "goes_on", "ends", "signed", "at_edge"]
    types = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4]

    def folded(words):
        return [w if w.isalpha() and len(w) <= _LONGEST else "#" * min(len(w), _LONGEST_SHAPE) for w in words]

    def out(found):
        rows = [[], [], [], [], [], [], []]
        for kind, counts in enumerate(found):
            for (field, before, word), n in counts.items():
                for column, value in zip(rows, (field, before, word, *(n if k == kind else 0 for k in range(4))), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], schema)

    found = [Counter() for _ in range(4)]
    for batch in batches:
        for field, edge, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = _PARTS.split(text)
            words = folded(parts[1::2])
            befores = ["^", *words]
            same = [field] * len(words)
            found[0].update(zip(same, befores, words[:-1]))
            found[0].update(zip(same, [None] * len(words), parts[2:-1:2]))
            found[3 if edge else 1][field, befores[-2], words[-1]] += 1
            if parts[-1] and not edge and not parts[-1].isspace():
                found[2][field, befores[-2], words[-1]] += 1
        if sum(map(len, found)) > _HELD:
            yield out(found)
            found = [Counter() for _ in range(4)]
    if any(found):
        yield out(found)


def _prior(rows: pd.DataFrame, rounds: int = 40) -> float:
    """The share of cuts in one source, field and kind, by expectation maximization; the start weighs as much as twenty values."""
    n, ratio = rows["n"].to_numpy(float), np.exp2(rows["bits"].to_numpy(float))
    start = p = float(rows["start"].iloc[0])
    for _ in range(rounds):
        odds = p / (1 - p) * ratio
        p = min(max(((n * odds / (1 + odds)).sum() + 20 * start) / (n.sum() + 20), 1e-5), 0.999)
    return p


def _unspaced(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\p{Z}]+", "")


def _shaped(pairs: DataFrame, words: DataFrame, column: str) -> DataFrame:
    """``pairs`` with every word of the column that is not common folded to its length."""
    common = words.select(F.col("word").alias("_w"), F.lit(True).alias("_common"))
    folded = F.repeat(F.lit("#"), F.least(F.length(column), F.lit(_LONGEST_SHAPE)))
    keep = F.col("_common").isNotNull() | F.col(column).rlike("^[#^]")
    return pairs.join(common, F.col(column) == F.col("_w"), "left").withColumn(column, F.when(keep, F.col(column)).otherwise(folded)).drop("_w", "_common")


def _of(values: dict, default: float = 1.0) -> Column:
    """The value for the row's field."""
    pairs = [F.lit(x) for f, v in values.items() for x in (f, max(float(v or 0), 1.0))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("field")), F.lit(default)) if pairs else F.lit(default)


def _endings(counted: DataFrame) -> tuple[DataFrame, float]:
    """(field, before, word, inside, behind, inside_short, ...) for every ending that occurs; share of cuts behind a word.

    ``inside``: log2 of how much likelier the ending is where a word was cut or
    left bare than in a whole text; ``behind``: where the cut came after the word.
    """
    pairs = counted.filter("before is not null")
    sums = [F.sum(c).alias(c) for c in ("goes_on", "ends", "signed", "at_edge")]
    words = cut(pairs.filter("word not like '#%'").groupBy("word").agg(F.sum(F.col("goes_on") + F.col("ends")).alias("n")).filter(F.col("n") >= COMMON).select("word"))
    shaped = cut(_shaped(_shaped(pairs, words, "word"), words, "before").groupBy("field", "before", "word").agg(*sums))

    def starts(of: DataFrame) -> DataFrame:
        return of.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))).alias("start"))

    whole_word = F.col("start") == F.col("word")
    table = cut(
        starts(shaped).groupBy("field", "before", F.col("start").alias("word")).agg(
            F.sum(F.when(whole_word, F.col("goes_on") + F.col("signed")).otherwise(F.col("goes_on") + F.col("ends"))).alias("inside"),
            F.sum(F.when(whole_word, F.col("goes_on")).otherwise(0)).alias("behind"),
            F.sum(F.when(whole_word, F.col("ends")).otherwise(0)).alias("ends"),
        )
    )
    counts = ("inside", "behind", "ends")
    total = {r.field: r for r in table.groupBy("field").agg(*[F.sum(c).alias(c) for c in counts]).collect()}
    of = {c: _of({f: r[c] for f, r in total.items()}) for c in counts}
    by_before = table.groupBy("field", "before").agg(*[F.sum(c).alias(f"{c}_b") for c in counts])
    by_word = table.groupBy("field", "word").agg(*[F.sum(c).alias(f"{c}_w") for c in counts])

    begun = starts(words).select(F.col("start").alias("_s")).distinct()
    met = pairs.filter(F.col("ends") + F.col("at_edge") > 0).select("field", "before", "word")
    met = met.withColumns({"_before": F.col("before"), "_word": F.col("word")})
    met = _shaped(met, words, "before").join(begun, F.col("word") == F.col("_s"), "left")
    folded = F.repeat(F.lit("#"), F.least(F.length("word"), F.lit(_LONGEST_SHAPE)))
    met = met.withColumn("word", F.when(F.col("_s").isNotNull() | F.col("word").startswith("#"), F.col("word")).otherwise(folded)).drop("_s")
    for lookup, keys in ((table, ["field", "before", "word"]), (by_before, ["field", "before"]), (by_word, ["field", "word"])):
        met = met.join(lookup, keys, "left")
    met = met.na.fill(0)

    def bits(kind: str, own: int) -> Column:
        """The last word given the one before, smoothed by the last word alone; then the one before. A value's own count is left out."""
        rare, weight = 0.05, 5.0

        def whole(ends, inside):
            # What cuts may have added to the ends: nothing against a word that does end texts.
            return F.greatest(ends - own - _SLACK * CUT_RATE * of["ends"] * inside / of["inside"], F.lit(0.0))

        word_cut = (F.col(f"{kind}_w") + rare) / of[kind]
        word_whole = (whole(F.col("ends_w"), F.col("inside_w")) + rare) / of["ends"]
        before_cut, before_whole = F.col(f"{kind}_b"), whole(F.col("ends_b"), F.col("inside_b"))
        both_cut = (F.col(kind) + weight * word_cut) / (before_cut + weight)
        both_whole = (F.least(whole(F.col("ends"), F.col("inside")), before_whole) + weight * word_whole) / (before_whole + weight)
        ratio = both_cut / both_whole * ((before_cut + 0.5) / of[kind]) / ((before_whole + 0.5) / of["ends"])
        return F.greatest(F.lit(-14.0), F.least(F.lit(14.0), F.log2(ratio)))

    met = met.select("field", F.col("_before").alias("before"), F.col("_word").alias("word"), *[bits(k, own).alias(f"{k}_{own}") for k in ("inside", "behind") for own in (0, 1)])
    inside, behind = (sum(float(r[k] or 0) for r in total.values()) for k in ("inside", "behind"))
    return met, behind / max(inside + behind, 1.0)


def _signs(values: DataFrame, counted: DataFrame, share_behind: float, rounds: int = 2) -> DataFrame:
    """(field, tail, mark, apart, closing): shares of the signs put behind a cut, between words, behind whole texts."""
    between = counted.filter("before is null").select("field", _unspaced("word").alias("tail"), F.col("goes_on").alias("n"))
    # A separator of several signs may be cut behind each of them.
    cut_tails = F.transform(F.sequence(F.least(F.lit(1), F.length("tail")), F.length("tail")), lambda i: F.substring("tail", F.lit(1), i))
    apart = between.select("field", F.explode(cut_tails).alias("tail"), "n").groupBy("field", "tail").agg(F.sum("n").alias("apart"))
    bins = ["field", "tail", F.round("inside").alias("inside"), F.round("behind").alias("behind")]
    histogram = cut(values.filter(F.col("kind") == _ELSEWHERE).groupBy(*bins).agg(F.count("*").alias("n")))
    table, start = None, CUT_RATE / (1 - CUT_RATE)
    for _ in range(rounds):
        if table is None:
            scored = histogram.withColumn("odds", start * F.pow(F.lit(2.0), "inside"))
        else:
            scored = histogram.join(table, ["field", "tail"]).withColumn("odds", start * _ratio(share_behind))
        post = F.col("odds") / (1 + F.col("odds"))
        seen = scored.groupBy("field", "tail").agg(F.sum(F.col("n") * post).alias("mark"), F.sum(F.col("n") * (1 - post)).alias("closing"))
        both = cut(seen.join(apart, ["field", "tail"], "full").na.fill(0))
        sums = {r.field: r for r in both.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("mark", "apart", "closing")]).collect()}
        of = {c: _of({f: r[c] for f, r in sums.items()}) for c in ("mark", "apart", "closing")}
        # What cuts may have added to the signs behind whole texts, at four times their number, as with the words.
        added = _SLACK * of["mark"] * share_behind * F.col("apart") / of["apart"]
        both = both.withColumn("closing", F.greatest(F.col("closing") - added, F.lit(0.0)))
        table = both.select("field", "tail", *[((F.col(c) + add) / of[c]).alias(c) for c, add in (("mark", 0.1), ("apart", 0.05), ("closing", 0.5))])
    return cut(table)


def _ratio(share_behind: float) -> Column:
    """How much likelier a value that lies elsewhere is after a cut."""
    inside, behind = (F.pow(F.lit(2.0), c) for c in ("inside", "behind"))
    return ((1 - share_behind) * inside * F.col("mark") + share_behind * behind * F.col("apart")) / F.col("closing")


def scored_endings(df: DataFrame, record_id: str, source: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, source, field, posterior of a cut) of the values, (source, field, limit, cut) of the sources."""
    texts = F.array(*[F.col(f).cast("string") for f in fields])
    base = df.select(F.col(record_id).cast("string").alias("id"), F.col(source).cast("string").alias("source"), F.posexplode(texts).alias("field", "text"))
    base = base.select("id", "source", "field", F.length("text").alias("size"), F.lower("text").alias("text")).filter(F.col("text").rlike("[a-z0-9]"))
    lengths = base.groupBy("source", "field", "size").agg(F.count("*").alias("n"))
    fitted = cut(
        lengths.groupBy("source", "field").applyInPandas(
            lambda key, rows: _limit(rows).assign(source=key[0], field=key[1])[["source", "field", "limit", "cut"]],
            "source string, field int, limit int, cut double",
        )
    )
    limit = sent(fitted.filter("limit > 0").select(F.col("source").alias("_s"), F.col("field").alias("_f"), "limit", "cut"))
    placed = base.join(limit, F.col("source").eqNullSafe(F.col("_s")) & (F.col("field") == F.col("_f")), "left")
    kind = F.when(F.col("size") == F.col("limit"), _FULL).when(F.col("size") == F.col("limit") - 1, _SHORT).otherwise(_ELSEWHERE)
    placed = placed.select("id", "source", "field", "text", kind.alias("kind"), "cut")

    counted = placed.select("field", F.col("kind") != _ELSEWHERE, "text").mapInArrow(_counts, "field int, before string, word string, goes_on long, ends long, signed long, at_edge long")
    counted = cut(counted.groupBy("field", "before", "word").agg(*[F.sum(c).alias(c) for c in ("goes_on", "ends", "signed", "at_edge")]))
    endings, share_behind = _endings(counted)

    last = F.regexp_extract(F.reverse("text"), "^[^a-z0-9]*+[a-z0-9]++(?:[^a-z0-9]++[a-z0-9]++)?", 0)
    found = placed.withColumn("last", last).drop("text")
    folded = lambda c: F.when(c.rlike("^[a-z]+$") & (F.length(c) <= _LONGEST), c).otherwise(F.repeat(F.lit("#"), F.least(F.length(c), F.lit(_LONGEST_SHAPE))))
    word, before = (F.reverse(F.regexp_extract("last", "^[^a-z0-9]*+([a-z0-9]++)(?:[^a-z0-9]++([a-z0-9]++))?", i)) for i in (1, 2))
    found = found.select(
        "id", "source", "field", "kind", "cut", _unspaced(F.reverse(F.regexp_extract("last", "^[^a-z0-9]*+", 0))).alias("tail"),
        folded(word).alias("word"), F.when(before == "", "^").otherwise(folded(before)).alias("before"),
    )
    elsewhere = F.col("kind") == _ELSEWHERE
    evidence = [F.coalesce(F.when(elsewhere, F.col(f"{k}_1")).otherwise(F.col(f"{k}_0")), F.lit(0.0)).alias(k) for k in ("inside", "behind")]
    values = cut(found.join(sent(cut(endings)), ["field", "before", "word"], "left").select("id", "source", "field", "kind", "cut", "tail", *evidence))

    signs = sent(_signs(values, counted, share_behind))
    rare = {"mark": 1e-6, "apart": 1e-6, "closing": 1e-6}
    scored = values.join(signs, ["field", "tail"], "left").na.fill(rare)
    behind = F.pow(F.lit(2.0), "behind") * F.col("apart") / F.col("closing")
    bare = F.when(F.col("tail") == "", (1 - share_behind) * F.pow(F.lit(2.0), "inside") / F.col("closing")).otherwise(share_behind * behind)
    bits = F.log2(F.when(elsewhere, _ratio(share_behind)).when(F.col("kind") == _SHORT, behind).otherwise(bare))
    start = F.when(elsewhere, CUT_RATE).when(F.col("kind") == _SHORT, F.col("cut") * share_behind).otherwise(F.col("cut"))
    scored = scored.select("id", "source", "field", "kind", F.greatest(F.lit(1e-4), F.least(F.lit(0.99), start)).alias("start"), F.greatest(F.lit(-40.0), F.least(F.lit(40.0), bits)).alias("bits"))
    groups = scored.groupBy("source", "field", "kind", F.round("bits", 1).alias("bits")).agg(F.count("*").alias("n"), F.first("start").alias("start"))
    prior = cut(groups.groupBy("source", "field", "kind").applyInPandas(lambda key, rows: pd.DataFrame([[*key, _prior(rows)]], columns=["s", "f", "k", "prior"]), "s string, f int, k int, prior double"))
    joined = scored.join(sent(prior), F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col("kind") == F.col("k")))
    odds = F.col("prior") / (1 - F.col("prior")) * F.pow(F.lit(2.0), "bits")
    return joined.select("id", "source", "field", (odds / (1 + odds)).alias("posterior")), fitted


def truncated_fields(df: DataFrame, record_id: str = "record_id", source: str = "dataset_id", fields: tuple[str, ...] = ("problem_text", "action_text"), least: float = 0.5) -> DataFrame:
    """(record_id, field_name): each field that was cut off, with a posterior of at least ``least``.

    Null and blank values and values without a letter or digit are never cut;
    rows without an id give nothing, a null source is a source of its own.
    Repeated rows of an id count once in the result. Other columns are ignored.
    """
    scored, _ = scored_endings(df, record_id, source, list(fields))
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return scored.filter((F.col("posterior") >= least) & F.col("id").isNotNull()).select(F.col("id").alias("record_id"), name.alias("field_name")).distinct()


def truncation_rates(df: DataFrame, record_id: str = "record_id", source: str = "dataset_id", fields: tuple[str, ...] = ("problem_text", "action_text"), least: float = 0.5) -> DataFrame:
    """(source, field_name, records, truncated, rate, field_limit): how often each source cuts; field_limit is null where none was found."""
    scored, fitted = scored_endings(df, record_id, source, list(fields))
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    one = scored.filter("id is not null").groupBy("source", "field", "id").agg(F.max("posterior").alias("p"))
    rates = one.groupBy("source", "field").agg(F.count("*").alias("records"), F.sum((F.col("p") >= least).cast("long")).alias("truncated"))
    rates = rates.alias("r").join(fitted.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.field") == F.col("f.field")), "left")
    return rates.select("r.source", "r.field", "records", "truncated", F.nullif("limit", F.lit(-1)).alias("field_limit")).select("source", name.alias("field_name"), "records", "truncated", (F.col("truncated") / F.col("records")).alias("rate"), "field_limit")
