"""Column expressions over text: words, sentences, numbers, scripts, syllables.

All patterns use Unicode category classes and possessive quantifiers. The classes
keep the meaning independent of the regex engine's idea of a "word" character;
the possessive form matches the same strings here and runs without recursion, so
a document of a million hyphen-joined letters cannot overflow a task's stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped or
# split on blanks.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Letters accepted in a Cyrillic word (Russian alphabet plus the
# Kazakh letters beyond it; U+049B is deliberately not among them) and the vowels
# that form syllables.
CYRILLIC_LETTERS = "а-яёіїңғүұәөһ"
VOWELS = "аеёиоуыэюя"

LETTER_CLASS = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTER_CLASS}++(?:['’\-]{LETTER_CLASS}++)*+"
SENTENCE = r"[^.!?]++[.!?]*+"
NUMBER = r"\p{Nd}++(?:[.,]\p{Nd}++)*+"
NON_BLANK = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]++"
TERM = r"[\p{L}\p{N}_]{2,}+"


def _find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    A column used inside a lambda is otherwise computed again for every element, even
    when it comes from an earlier projection, because the optimizer merges projections.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def strip(text: Column) -> Column:
    """Unicode white-space trim (the plain `trim` removes only spaces)."""
    return F.trim(text, F.lit(WHITESPACE))


def strip_lower(text: Column) -> Column:
    return F.lower(strip(text))


def words(text: Column) -> Column:
    """Runs of letters, optionally joined by apostrophe or hyphen, in order."""
    return _find_all(text, WORD)


def blank_split(text: Column) -> Column:
    """Tokens between runs of white space."""
    return _find_all(text, NON_BLANK)


def sentences(text: Column) -> Column:
    """Stripped runs up to and including their terminators; blank ones dropped."""
    return F.filter(
        F.transform(_find_all(text, SENTENCE), strip), lambda s: s != F.lit("")
    )


def numbers(text: Column) -> Column:
    """Digit runs with inner dot or comma groups, in order, duplicates kept."""
    return _find_all(text, NUMBER)


def words_without_numbers(word_list: Column, number_list: Column) -> Column:
    """Words that are not number strings; order and duplicates kept.

    A word never contains a decimal digit and a number starts with one, so this
    changes nothing for lists made by `words` and `numbers`.
    """
    return let(
        number_list, lambda found: F.filter(word_list, lambda w: ~F.array_contains(found, w))
    )


def is_cyrillic(token: Column, letters: str = CYRILLIC_LETTERS) -> Column:
    """Whole token made of Cyrillic letter groups joined by apostrophe or hyphen."""
    normal = F.replace(strip_lower(token), F.lit("’"), F.lit("'"))
    return normal.rlike(rf"^[{letters}]++(?:['\-][{letters}]++)*+$")


def is_informative(token: Column, letters: str = CYRILLIC_LETTERS) -> Column:
    """Token worth keeping as evidence.

    Empty, symbol-only and digit-led tokens are not, and it has to be a Cyrillic
    word. Every Cyrillic word starts with a letter, so the second test says it all.
    """
    return is_cyrillic(token, letters)


def syllables(word: Column, vowels: str = VOWELS) -> Column:
    """Number of vowel groups, at least one for a non-empty word.

    A word with more than one group loses one when it ends in the Latin "e" or
    "es".
    """
    lowered = F.lower(word)
    groups = F.regexp_count(lowered, F.lit(f"[{vowels}]++"))
    silent = ((groups > 1) & (lowered.endswith("e") | lowered.endswith("es"))).cast("int")
    return F.when(lowered == "", F.lit(0)).otherwise(F.greatest(F.lit(1), groups - silent))


def terms(text: Column, ngram_max: int = 1) -> Column:
    """Lower-cased tokens of two or more word characters, as 1..n-grams."""
    tokens = _find_all(F.lower(text), TERM)
    return ngrams(tokens, ngram_max)


def ngrams(tokens: Column, ngram_max: int) -> Column:
    """The token list followed by its 2..n-grams (joined by one space)."""

    def grams(bound: Column, n: int) -> Column:
        # Starts 1..size-n+1. The filter keeps the list empty for short texts, for which
        # `sequence` would count downwards.
        last = F.size(bound) - (n - 1)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last
        )
        return F.transform(
            starts, lambda i: F.array_join(F.slice(bound, i, F.lit(n)), " ")
        )

    if ngram_max == 1:
        return tokens
    return let(
        tokens,
        lambda bound: F.concat(bound, *[grams(bound, n) for n in range(2, ngram_max + 1)]),
    )


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; zero when the denominator is zero or missing."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )
