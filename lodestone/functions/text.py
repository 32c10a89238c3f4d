"""Column functions on text: lines, stems, numbers, tokens; all built of Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import MULTIPLIERS, NUMBER_WORDS, STOP, SUFFIXES


def ascii_borders(pattern: str) -> str:
    """``pattern`` with ``\\b`` at ASCII word characters only, as ``\\w`` has them; Java 17's own also knows other letters."""
    return pattern.replace("\\b", "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))")


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "^['-]+|['-]+$", "")


def _cut(s: Column) -> Column:
    rules = ((s.endswith(x) & (F.length(s) - len(x) >= 4), F.substring(s, F.lit(1), F.length(s) - len(x))) for x in SUFFIXES)
    return reduce(lambda acc, r: F.when(r[0], r[1]).otherwise(acc), list(rules)[::-1], s)


def stem(word: Column) -> Column:
    """Lower case without outer ' and -; the first suffix that leaves four or more characters goes."""
    return _cut(_bare(word))


def stems(text: Column) -> Column:
    """The stems of the words with content, in order.

    The bare words are an array of their own, as within one function Spark makes a word bare again for each use of it by a suffix.
    """
    words = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'-]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOP))
    return F.transform(F.transform(kept, _bare), _cut)


# Fixed value: the pattern of numbers with their units and of number words.
_NUMBER = (
    "(?i)(?<![\\w.])(\\d+(?:[.,]\\d+)*)(?:\\s?([A-Za-z]{1,4}))?(?![\\w])|(?<![\\w-])(" + "|".join(NUMBER_WORDS) + ")(?![\\w-])"
)


def numbers(text: Column) -> Column:
    """Array of (value double, version string): numbers with multipliers, number words, and dotted versions as text."""
    groups = [F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(i)) for i in (1, 2, 3)]
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))])
    factors = F.create_map(*[F.lit(x) for kv in MULTIPLIERS.items() for x in kv])

    def one(z: Column) -> Column:
        raw, unit, word = z["raw"], z["unit"], z["word"]
        dots = F.length(raw) - F.length(F.replace(raw, F.lit("."), F.lit("")))
        value = F.when(word != "", words[F.lower(word)]).when(
            dots <= 1, F.replace(raw, F.lit(","), F.lit("")).cast("double") * F.coalesce(factors[unit], F.lit(1.0))
        )
        return F.struct(value.alias("value"), F.when((word == "") & (dots > 1), raw).alias("version"))

    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("raw", "unit", "word"), strict=True)])
    return F.array_distinct(F.transform(zipped, one))


def tokens(text: Column) -> Column:
    """Distinct white-space tokens in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "\\s+"), lambda t: t != ""))


def word_count(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "\\s+")))
