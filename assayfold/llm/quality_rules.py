"""Quality rules: a table of thresholds compiled into one projection of ratios, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

#: Words of a window whose repetition counts.
WINDOW = 8
#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a an and as at be but by for from in is it not of on or that the this to was with "
    "au aux ce dans de des du en est et il la le les ne pas pour que qui se sur un une "
    "das dem den der die ein eine für im ist mit nicht sich und von zu "
    "con del el es las los no para por su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the table: the measure must lie between low and high (None: open)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: A measure is a column that measures() adds, or a ratio of two of them.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("repeated windows", "n_repeat_words / n_words", None, 0.3),
    Rule("word length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / n_words", None, 0.25),
    Rule("exclamation", "n_exclamations / n_words", None, 0.35),
    Rule("capitals", "n_capitals / word_chars", None, 0.5),
    Rule("stop words", "n_stop_words / n_words", 0.02, None),
    Rule("repeated lines", "n_dup_lines / n_lines", None, 0.5),
)
#: The first two are the base: their verdict is a column of its own.
BASE = ("length", "repeated windows")


def _chars_only(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def let(value: Column, then) -> Column:
    """then(value), with the value evaluated once a row however often `then` uses it, and wherever the optimizer moves
    the whole: a lambda's variable is bound, a projected column would be written out at each of its uses."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeated(words: Column, window: int) -> Column:
    """Words in windows found twice or more.

    The hashes of a text's windows are compared for equality, and only where two are equal are they sorted with their
    positions; the words that flagged windows cover are then added up gap by gap: n log n in the words, whatever repeats.
    """
    starts = F.sequence(F.lit(1), F.size(words) - window + 1)
    hashes = F.when(F.size(words) >= window, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window))))

    def covered(pairs: Column) -> Column:
        same = lambda i, k: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, k)["h"], F.lit(False))
        flagged = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        ordered = F.array_sort(F.transform(flagged, lambda i: F.get(pairs, i)["i"]))
        gap = lambda at, s, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - s, F.lit(window)))
        return let(ordered, lambda at: F.aggregate(F.transform(at, lambda s, k: gap(at, s, k)), F.lit(0).cast("long"), lambda a, x: a + x))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, covered))

    return F.coalesce(let(hashes, counted), F.lit(0)).cast("long")


#: The counts that rules may use, in the order of the verdict's fields.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_capitals", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(text: Column, window: int = WINDOW) -> Column:
    """A struct of MEASURES (long each). Null text has no words and counts of zero."""

    def counts(t: Column) -> Column:
        split = F.filter(F.split(t, SPACE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        stops = lambda w: F.size(F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: x.isin(STOP_WORDS)))
        of_words = let(split, lambda w: F.struct(F.size(w).alias("n"), stops(w).alias("stops"), _repeated(w, window).alias("repeated")))
        of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))

        def named(w: Column, x: Column) -> Column:
            found = {
                "n_words": w["n"],
                "word_chars": F.length(t) - F.length(F.regexp_replace(t, WORD, "")),
                "n_symbols": _chars_only(t, "#*$%&|<>"),
                "n_exclamations": _chars_only(t, "!"),
                "n_capitals": _chars_only(t, "\\p{Lu}"),
                "n_stop_words": w["stops"],
                "n_lines": x["n"],
                "n_dup_lines": x["again"],
                "n_repeat_words": w["repeated"],
            }
            return F.struct(*[found[k].cast("long").alias(k) for k in MEASURES])

        return let(of_words, lambda w: let(of_lines, lambda x: named(w, x)))

    return let(F.coalesce(text, F.lit("")), counts)


def failed(rule: Rule, of: Column) -> Column:
    """True where the measure of the struct `of` is out of bounds; a ratio over nothing is not."""
    top, _, bottom = (x.strip() for x in rule.measure.partition("/"))
    value = of[top].cast("double")
    if bottom:
        value = value / F.when(of[bottom] != 0, of[bottom].cast("double"))
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (value < rule.low)
    if rule.high is not None:
        bad = bad | (value > rule.high)
    return F.coalesce(bad, F.lit(False))


def verdict(text: Column, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE, window: int = WINDOW) -> Column:
    """A struct of MEASURES, `failed_rules` (names, in the table's order), `base_failed` and `kept`, computed once a row
    even where a filter on one of its fields is pushed below everything else."""

    def ruled(m: Column) -> Column:
        names = F.array_compact(F.array(*[F.when(failed(r, m), F.lit(r.name)) for r in rules])) if rules else F.expr("cast(array() as array<string>)")
        judged = lambda f: (
            f.alias("failed_rules"),
            F.arrays_overlap(f, F.array(*map(F.lit, base)).cast("array<string>")).alias("base_failed"),
            (F.size(f) == 0).alias("kept"),
        )
        return let(names, lambda f: F.struct(*[m[k].alias(k) for k in MEASURES], *judged(f)))

    return let(measures(text, window), ruled)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE, window: int = WINDOW) -> DataFrame:
    """docs with the measures, `failed_rules`, `base_failed` and `kept`.

    One narrow projection: no shuffle, no user function; rows, repeated or not, stand for themselves. A null or empty
    text has no words and so fails the length rule; a very long one is one row's work, n log n in its words. Input
    columns with a measure's name are replaced, all others are kept whatever their names (`verdict` beside them keeps
    all); an empty table stays empty.
    """
    added = [*MEASURES, "failed_rules", "base_failed", "kept"]
    own = [c for c in docs.columns if c not in added]
    taken = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(own)], verdict(docs["text"], rules, base, window).alias("v"))
    return taken.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *[F.col("v")[c].alias(c) for c in added])
