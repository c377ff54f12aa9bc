"""Text column expressions: tokens, counts, cleaning. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpometer.functions.words import (
    ENGLISH_STOP_WORDS,
    FAILED_GENERATION_PREFIX,
    SPECIAL_TOKENS,
    accent_table,
)

# The patterns below name their characters one by one or by Unicode property, so that Java's and
# RE2's regular expressions agree on them; `\s` and `\w` are ASCII-only in both unless asked.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ALPHABETIC = r"[\p{L}\p{Nl}\p{No}_]+"
WORD_RUN = r"[\p{L}\p{N}_]{2,}"
LETTERS_ONLY = r"^\p{L}+$"
# Word tokeniser: negated and shortened forms, then punctuation that stands apart from words.
FUSED = r"\b(?:(can)(not)|(gon|wan)(na)|(got)(ta)|(lem|gim)(me))\b"  # two words written as one
SHORTENED = r"(^|" + SPACE + r")['’]t(is|was)\b"
CONTRACTION = r"(?:n't|'(?:s|m|d|ll|re|ve))(" + SPACE + r"|[.,:;?!)]|$)"
APART = r"[\[\](){}<>\"“”«»‘’,:;?!@#$%&]|--|\.\.+|`+|''"
CLOSING = r"[.']+(" + SPACE + r"|$)"
OPENING = r"(^|" + SPACE + r")'+"
# What the tokenisers run: the patterns above, with a test first that a plain letter fails at once, and with spaces that
# stand before a mark looked back at from the mark. They match and leave the same text, in less time.
SPACES = "(?![!-~])" + SPACE + "+"
FUSED_FAST = "(?=[cglw])" + FUSED
SHORTENED_FAST = "['’](?<=(?:^|" + SPACE + r")['’])t(is|was)\b"
APART_FAST = "(?![a-z])(?:" + APART + ")"
OPENING_FAST = "'(?<=(?:^|" + SPACE + ")')'*"


def _col(text) -> Column:
    return text if isinstance(text, Column) else F.col(text)


def strip(text) -> Column:
    """Take white space of any kind off both ends."""
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def space_tokens(text) -> Column:
    """Lower-case tokens between runs of white space."""
    return F.array_remove(F.split(F.lower(_col(text)), SPACES), "")


def word_count(text) -> Column:
    """Number of tokens between runs of white space."""
    return F.size(F.array_remove(F.split(_col(text), SPACES), "")).cast("bigint")


def single_space_count(text) -> Column:
    """Number of pieces between single spaces; empty pieces count."""
    body = _col(text)
    return (F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def without_words(tokens: Column, stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS) -> Column:
    """Tokens that are not in ``stop_words``."""
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(*stop_words))


def simple_tokens(
    text, stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS, shortest: int = 2, longest: int = 15
) -> Column:
    """Accent-free lower-case alphabetic tokens of 2 to 15 characters, stop words out."""
    source, target = accent_table()
    lowered = F.lower(_col(text))
    # A text of as many bytes as characters is ASCII, in which no letter has an accent.
    plain = F.when(F.octet_length(lowered) == F.length(lowered), lowered).otherwise(F.translate(lowered, source, target))
    tokens = F.regexp_extract_all(plain, F.lit(ALPHABETIC), 0)

    def kept(token: Column) -> Column:
        fits = F.length(token).between(shortest, longest) & ~F.startswith(token, F.lit("_"))
        return fits & ~token.isin(*stop_words) if stop_words else fits

    return F.filter(tokens, kept)


def word_pieces(text) -> Column:
    """Word tokens of the lower-cased text, punctuation and short forms set apart and left out."""
    spaced = F.regexp_replace(F.lower(_col(text)), FUSED_FAST, "$1$3$5$7 $2$4$6$8")
    spaced = F.regexp_replace(spaced, SHORTENED_FAST, "$1")
    spaced = F.regexp_replace(spaced, CONTRACTION, " $1")
    spaced = F.regexp_replace(spaced, APART_FAST, " ")
    spaced = F.regexp_replace(spaced, CLOSING, "$1")
    spaced = F.regexp_replace(spaced, OPENING_FAST, "")
    return F.array_remove(F.split(spaced, SPACES), "")


def is_alphabetic(token: Column) -> Column:
    """True for a token made of letters only."""
    return token.rlike(LETTERS_ONLY)


def alphabetic_words(text, stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS) -> Column:
    """Word tokens that hold letters only, stop words out."""
    return without_words(F.filter(word_pieces(text), is_alphabetic), stop_words)


def tfidf_tokens(text, stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS) -> Column:
    """Lower-case runs of two or more word characters, stop words out."""
    return without_words(F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_RUN), 0), stop_words)


TOKENIZERS = {
    "space": lambda text, stop_words=None: without_words(space_tokens(text), stop_words),
    "simple": simple_tokens,
    "word": alphabetic_words,
    "tfidf": tfidf_tokens,
}


def tokenize(text, tokenizer: str = "space", **options) -> Column:
    """Tokens of ``text`` by one of the named tokenisers: space, simple, word, tfidf."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"Unknown tokenizer '{tokenizer}'. Available: {sorted(TOKENIZERS)}")
    return TOKENIZERS[tokenizer](text, **options)


def has_text(text) -> Column:
    """True for a text that is neither null nor empty."""
    body = _col(text)
    return body.isNotNull() & (body != "")


def generation_failed(text) -> Column:
    """True for a row that stores an error message instead of an article."""
    return F.startswith(_col(text), F.lit(FAILED_GENERATION_PREFIX))


def without_special_tokens(text, tokens: Sequence[str] = SPECIAL_TOKENS) -> Column:
    """Take chat and end-of-text markers out of generated text."""
    escaped = (t.replace("|", r"\|") for t in tokens)
    return F.regexp_replace(_col(text), "|".join(escaped), "")


# Byline and dateline shapes at the head of an article, taken off in this order. A printed date
# line may hold the time of publishing and the time of a later change, so its shape comes twice.
_DATE_LINE = (
    r"^[\s.|]*(?:PUBLISHED|UPDATED|Published|Updated):[\s.]*(?:\d{1,2}:\d{2}\s*(?:EST|EDT|GMT|BST)?[\s,.]*)?"
    r"\d{1,2}\s+[A-Z][a-z]+\s+\d{4}[\s.|]*"
)
_NAME = r"[A-Z][\p{L}'-]+(?: +[A-Z][\p{L}'.-]*){1,3}"
BYLINE_PATTERNS: tuple[str, ...] = (
    r"^By\s+\.\s+[^\n.]{1,120}\.\s+",
    rf"^By +{_NAME}(?: +and +{_NAME})?(?:, +CNN)? *\n+",
    _DATE_LINE,
    _DATE_LINE,
    r"^(?:[A-Z][\p{L} .,'-]{0,60})?\(CNN\)\s*(?:--?|—)?\s*",
    r"^(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},\s+\d{4}\s*(?:--?|—|\n)?\s*",
)


def without_byline(text, patterns: Sequence[str] = BYLINE_PATTERNS) -> Column:
    """Take authors and dates off the head of an article."""
    body = _col(text)
    for pattern in patterns:
        body = F.regexp_replace(body, pattern, "")
    return body


def first_words(text, k: int = 100) -> Column:
    """The first ``k`` words with their case kept, one space between them."""
    words = F.array_remove(F.split(_col(text), SPACES), "")
    return F.array_join(F.slice(words, 1, k), " ")


def preview(text, width: int = 200) -> Column:
    """The first ``width`` characters."""
    return F.substring(_col(text), 1, width)
