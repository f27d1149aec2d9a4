"""Tokenisation and small numeric functions as native columns."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that the lexical index leaves out.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "not", "no", "nor",
    "is", "am", "are", "was", "were", "be", "been", "being",
    "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "as", "into", "through", "during", "before", "after",
    "it", "its", "this", "that", "these", "those",
    "i", "we", "you", "he", "she", "they", "me", "him", "her", "us", "them",
    "my", "our", "your", "his", "their",
    "do", "does", "did", "has", "have", "had", "will", "would",
    "shall", "should", "can", "could", "may", "might", "must",
    "if", "then", "else", "when", "where", "how", "what", "which", "who",
    "so", "than", "too", "very", "just", "about", "above", "below", "over",
    "all", "each", "every", "both", "few", "more", "most", "some", "any",
    "other", "such", "only", "own", "same",
]
# Word and identifier boundaries.  ASCII classes are spelled out: \b and \w differ between engines.
WORD = "[A-Za-z0-9_]+"
CAMEL = "([a-z])([A-Z])"
CAPS = "([A-Z]+)([A-Z][a-z])"
SYMBOL_QUERY = r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*$"


def _is_stop(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def tokens_of_word(word: Column) -> Column:
    """Lower-cased word, unless it is a stop word; an identifier adds its parts.

    Plain words, nearly all, take the last branch, which compiles; only identifiers
    with an inner boundary are split by lambdas."""
    none = F.array().cast("array<string>")
    low = F.lower(word)
    snake = F.filter(F.split(low, "_"), lambda p: (p != "") & ~_is_stop(p))
    snake = F.when(F.size(snake) > 1, F.concat(F.array(low), snake)).otherwise(F.array(low))
    camel = F.split(F.regexp_replace(F.regexp_replace(word, CAMEL, "$1 $2"), CAPS, "$1 $2"), " ")
    camel = F.concat(F.array(low), F.filter(F.transform(camel, F.lower), lambda p: ~_is_stop(p)))
    return F.when(_is_stop(low), none).when(F.contains(word, F.lit("_")), snake).when(word.rlike("[a-z][A-Z]|[A-Z]{2}[a-z]"), camel).otherwise(F.array(low))


class WordTokens:
    """tokens_of_word for the words of whole texts inside a task; the words met so far keep their tokens, up to a number."""

    MOST = 200_000

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}
        self.plain: set[str] = set()
        self.find, self.stop = re.compile(WORD).findall, frozenset(STOP_WORDS)
        self.camel, self.caps, self.inner = re.compile(CAMEL), re.compile(CAPS), re.compile("[a-z][A-Z]|[A-Z]{2}[a-z]")

    def of(self, word: str) -> tuple[str, ...]:
        low = word.lower()
        if low in self.stop:
            return ()
        if "_" in word:
            parts = [p for p in low.split("_") if p and p not in self.stop]
            return (low, *parts) if len(parts) > 1 else (low,)
        if self.inner.search(word):
            spaced = self.caps.sub(r"\1 \2", self.camel.sub(r"\1 \2", word)).lower()
            return (low, *(p for p in spaced.split(" ") if p not in self.stop))
        return (low,)

    def counts(self, text: str) -> Counter[str]:
        """How often each token is in a text."""
        out = Counter(self.find(text))
        # Words that are their own single token stay as they were counted; the others are taken out first, as their tokens may be words too.
        for word, n in [(w, out.pop(w)) for w in out.keys() - self.plain]:
            tokens = self.known.get(word)
            if tokens is None:
                if len(self.known) + len(self.plain) >= self.MOST:
                    self.known.clear()
                    self.plain.clear()
                tokens = self.of(word)
                if tokens == (word,):
                    self.plain.add(word)
                else:
                    self.known[word] = tokens
            for t in tokens:
                out[t] += n
        return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """The tokens of a text as one array; whole corpora are counted by WordTokens (see lexical.forward)."""
    return F.flatten(F.transform(words(text), tokens_of_word))


def expand_identifiers(query: Column) -> Column:
    """The query with the parts of each identifier after it: snake, else camel, else capitals."""

    def of(token: Column) -> Column:
        snake = F.filter(F.split(token, "_"), lambda p: p != "")
        camel = F.split(F.regexp_replace(token, CAMEL, "$1 $2"), " ")
        caps = F.split(F.regexp_replace(token, CAPS, "$1 $2"), " ")
        several = lambda parts: F.when(F.size(parts) > 1, F.transform(parts, F.lower)).otherwise(F.array().cast("array<string>"))
        parts = F.when(F.contains(token, F.lit("_")), several(snake)).when(token.rlike("[a-z][A-Z]"), several(camel)).when(token.rlike("[A-Z]{2,}[a-z]"), several(caps))
        return F.concat(F.array(token), F.coalesce(parts, F.array().cast("array<string>")))

    given = F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda t: t != "")
    return F.array_join(F.flatten(F.transform(given, of)), " ")


def is_symbol_query(query: Column) -> Column:
    return F.trim(F.coalesce(query, F.lit(""))).rlike(SYMBOL_QUERY)


def fast_sigmoid(x: Column) -> Column:
    """The rational curve that the index's entropy uses, as it stands."""
    cube = x * x * x
    return F.when(x >= 8.0, 1.0).when(x <= -8.0, 0.0).otherwise((cube + 6.0 * x + 12.0) / (cube + 12.0 * x + 48.0))


def round4(x: Column) -> Column:
    """Half-up rounding to four decimals, as floor(10000 x + 0.5) / 10000."""
    return F.floor(x * 10000 + 0.5) / 10000


def order_key(x: Column) -> Column:
    """Scores to nine decimals, so that sums in another order rank alike."""
    return F.floor(x * 1e9 + 0.5)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def first_filled(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])
