"""English stemming (Porter, 1980) as a chain of built-in column expressions.

Every step is one projection, so that no step's expression is repeated inside
the next, and the suffixes of a step are found by one pattern: the generated
method stays below the size up to which the JVM compiles it (a branch for each
suffix is an order of magnitude slower for that reason alone).

The rules live in plain tables so that the check SQL can be made from the same
rows; ``tests/test_analysis.py`` holds the tables against an independent
implementation and against the published examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published rules, longest suffix first where suffixes nest.
# Words of one or two letters stay as they are; "bli" and "logi" follow the
# author's own later revision of the paper.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("logi", "log"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

# The paper's measure conditions as look-around-free patterns.
# A word is [C](VC)^m[V]; y is a consonant at the start and after a vowel.
_HEAD = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*"
_CONSONANTS = "[^aeiou][^aeiouy]*"
_VOWELS = "[aeiouy][aeiou]*"
HAS_VOWEL = "[aeiou]|.y"
MEASURE_OVER_0 = f"{_HEAD}[^aeiou]"
MEASURE_OVER_1 = f"{_HEAD}{_CONSONANTS}{_VOWELS}[^aeiou]"
MEASURE_IS_1 = f"{_HEAD}{_CONSONANTS}(?:{_VOWELS})?$"
SHORT_SYLLABLE = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"
DOUBLE_Y = "(?:[^aeiouy]|(?:^|[aeiou])y)(?:yy)+$"
NOT_UNDOUBLED = ["a", "e", "i", "o", "u", "y", "l", "s", "z"]

_WORD = "_word"


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - F.lit(n))


def _suffix_length(word: Column, suffixes: list[str]) -> Column:
    """Length of the longest listed suffix the word ends in, 0 for none.

    Looked up from the end of the word, so that one anchored match does it.
    """
    backwards = sorted((suffix[::-1] for suffix in suffixes), key=len, reverse=True)
    return F.length(F.regexp_extract(F.reverse(word), f"^(?:{'|'.join(backwards)})", 0))


def _replace_suffix(df: DataFrame, rules: list[tuple[str, str]], measure: str) -> DataFrame:
    """The longest fitting suffix decides; the measure of the rest may refuse it."""
    word, n = F.col(_WORD), F.col("_n")
    new_ends = F.create_map(*[F.lit(part) for rule in rules for part in rule])
    stem = F.left(word, F.length(word) - n)
    changed = F.concat(stem, F.element_at(new_ends, F.right(word, n)))
    return df.withColumn("_n", _suffix_length(word, [suffix for suffix, _ in rules])).withColumn(
        _WORD, F.when((n > 0) & stem.rlike(measure), changed).otherwise(word)
    )


def _step_1a(word: Column) -> Column:
    return (
        F.when(~word.endswith("s"), word)
        .when(word.endswith("sses") | word.endswith("ies"), _cut(word, 2))
        .when(word.endswith("ss"), word)
        .otherwise(_cut(word, 1))
    )


def _step_1b_base(word: Column) -> Column:
    """The word without -ed or -ing where a vowel remains, else null."""
    return (
        F.when(word.endswith("eed"), F.lit(None))
        .when(word.endswith("ed") & _cut(word, 2).rlike(HAS_VOWEL), _cut(word, 2))
        .when(word.endswith("ing") & _cut(word, 3).rlike(HAS_VOWEL), _cut(word, 3))
    )


def _step_1b(word: Column, base: Column) -> Column:
    last = F.right(base, F.lit(1))
    doubled = (
        (F.length(base) >= 2)
        & (last == F.left(F.right(base, F.lit(2)), F.lit(1)))
        & ~last.isin(NOT_UNDOUBLED)
    ) | base.rlike(DOUBLE_Y)
    needs_e = base.endswith("at") | base.endswith("bl") | base.endswith("iz")
    return (
        F.when(
            base.isNull(),
            F.when(word.endswith("eed") & _cut(word, 3).rlike(MEASURE_OVER_0), _cut(word, 1)).otherwise(word),
        )
        .when(needs_e, F.concat(base, F.lit("e")))
        .when(doubled, _cut(base, 1))
        .when(base.rlike(SHORT_SYLLABLE), F.concat(base, F.lit("e")))
        .otherwise(base)
    )


def _step_1c(word: Column) -> Column:
    stem = _cut(word, 1)
    return F.when(word.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(word)


def _step_4(df: DataFrame) -> DataFrame:
    word, n = F.col(_WORD), F.col("_n")
    # -ion only comes off after s or t, so those two are looked up as its forms.
    suffixes = [suffix for suffix in STEP_4 if suffix != "ion"] + ["sion", "tion"]
    length = _suffix_length(word, suffixes)
    stem = F.left(word, F.length(word) - n)
    return df.withColumn("_n", F.when(word.endswith("ion"), F.least(length, F.lit(3))).otherwise(length)).withColumn(
        _WORD, F.when((n > 0) & stem.rlike(MEASURE_OVER_1), stem).otherwise(word)
    )


def _step_5a(word: Column) -> Column:
    stem = _cut(word, 1)
    removable = stem.rlike(MEASURE_OVER_1) | (stem.rlike(MEASURE_IS_1) & ~stem.rlike(SHORT_SYLLABLE))
    return F.when(word.endswith("e") & removable, stem).otherwise(word)


def _step_5b(word: Column) -> Column:
    return F.when(word.endswith("ll") & word.rlike(MEASURE_OVER_1), _cut(word, 1)).otherwise(word)


def with_stem(df: DataFrame, word: str, stem: str = "term") -> DataFrame:
    """Add ``stem`` holding the English stem of the lower-case ``word`` column."""
    w = F.col(_WORD)
    out = df.withColumn(_WORD, _step_1a(F.col(word)))
    out = out.withColumn("_base", _step_1b_base(w))
    out = out.withColumn(_WORD, _step_1b(w, F.col("_base"))).drop("_base")
    out = out.withColumn(_WORD, _step_1c(w))
    out = _replace_suffix(out, STEP_2, MEASURE_OVER_0)
    out = _replace_suffix(out, STEP_3, MEASURE_OVER_0)
    out = _step_4(out)
    out = out.withColumn(_WORD, _step_5a(w)).withColumn(_WORD, _step_5b(w))
    result = F.when(F.length(F.col(word)) <= 2, F.col(word)).otherwise(w)
    # A filter on the stem stays above a generator.  Above plain projections the
    # optimizer would move it to the words, writing all steps into each other.
    return out.withColumn(stem, F.explode(F.array(result))).drop(_WORD, "_n")
