"""Text cleanup and word tokens as Column expressions.

Everything here stays inside the JVM; nothing needs a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bind

# The characters Unicode counts as whitespace, as used for
# stripping and splitting text. Spark's one-argument trim only knows the space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# Runs to be replaced by one space; a single space between words is left alone,
# which spares a replacement per word.
WHITESPACE_RUN = r"(?U)(?! [^\s\x1c-\x1f])[\s\x1c-\x1f]++"

# The 32 ASCII punctuation marks, as a character class.
PUNCTUATION_RUN = r"[!-/:-@\[-`{-~]+"

# Words the Treebank tokeniser splits in two, and the typographic
# quotes it separates from their neighbours. Its other rules need ASCII
# punctuation, which cleaned text no longer has.
TOKEN_BREAKS = (
    r"(?U)([«“‘„»”’]"
    r"|\b(?:can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\b)))"
)

# Every text a break applies to contains one of these.
_BREAK_HINTS = ("annot", "mme", "nna", "gotta", *"«“‘„»”’")

# The common English stopword list of 179 words.
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours
    yourself yourselves he him his himself she she's her hers herself it it's its
    itself they them their theirs themselves what which who whom this that that'll
    these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all
    any both each few more most other some such no nor not only own same so than too
    very s t can will just don don't should should've now d ll m o re ve y ain aren
    aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
    haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
    shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

ALPHANUMERIC = r"^[\p{L}\p{N}]+$"


def clean_basic(col: Column) -> Column:
    """Null to empty, lower case, strip both ends; inner text untouched."""
    return F.trim(F.lower(F.coalesce(col, F.lit(""))), F.lit(WHITESPACE))


def clean_punct(col: Column) -> Column:
    """Null to empty, lower case, ASCII punctuation deleted, whitespace collapsed."""
    kept = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), PUNCTUATION_RUN, "")
    return F.trim(F.regexp_replace(kept, WHITESPACE_RUN, " "))


def _spaced(cleaned: Column) -> Column:
    # plain substring search is far cheaper than the pattern, and most texts have no break
    def broken(text: Column) -> Column:
        hinted = reduce(or_, [F.contains(text, F.lit(hint)) for hint in _BREAK_HINTS])
        spread = F.regexp_replace(text, TOKEN_BREAKS, " $1 ")
        return F.split(F.when(hinted, spread).otherwise(text), " ", -1)

    return bind(cleaned, broken)


def tokens(cleaned: Column) -> Column:
    """Word tokens of text that went through :func:`clean_punct`."""
    return F.filter(_spaced(cleaned), lambda token: token != "")


def raw_tokens(cleaned: Column) -> Column:
    """As :func:`tokens`, empty strings included.

    For use below ``explode``, where :func:`is_alnum` drops the empty strings
    inside generated code instead of in a lambda.
    """
    return _spaced(cleaned)


def is_alnum(col: Column) -> Column:
    """True when every character is a Unicode letter or number."""
    return col.rlike(ALPHANUMERIC)


def is_stopword(col: Column, words: Iterable[str] = ENGLISH_STOPWORDS) -> Column:
    """Membership in ``words``; always false for an empty list."""
    words = list(words)
    return col.isin(words) if words else F.lit(False)


def kept_tokens(
    cleaned: Column, remove_stopwords: bool = True, words: Iterable[str] = ENGLISH_STOPWORDS
) -> Column:
    """Alphanumeric tokens in order, stopwords dropped on request."""
    return kept_of(_spaced(cleaned), remove_stopwords, words)


def kept_of(
    raw: Column, remove_stopwords: bool = True, words: Iterable[str] = ENGLISH_STOPWORDS
) -> Column:
    """As :func:`kept_tokens`, of :func:`raw_tokens` already at hand."""
    words = list(words) if remove_stopwords else []
    return F.filter(raw, lambda token: is_alnum(token) & ~is_stopword(token, words))


def truncate_tokens(col: Column, max_len: int = 128) -> Column:
    """The first ``max_len`` tokens."""
    if max_len < 1:
        raise ValueError("max_len must be at least 1")
    return F.slice(col, 1, max_len)


def char_length(col: Column) -> Column:
    """Length in code points, 0 for null."""
    return F.length(F.coalesce(col, F.lit("")))


def word_length(cleaned: Column) -> Column:
    """Number of tokens, non-alphanumeric ones included, 0 for null."""
    return F.size(tokens(F.coalesce(cleaned, F.lit(""))))
