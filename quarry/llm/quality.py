"""Quality rules, line first [native: DataFrame functions only].

Each line of a text is judged by three rules (punctuation, navigation,
boilerplate).  Failing lines are removed; a document is rejected when too small
a share of its word characters survives, or when a base rule fails.

Defined results: a null text counts as empty; an empty text has no words and is
rejected by the base rule; repeated rows are judged one by one; ids may be null
or repeated; further columns of the input, whatever their names, are not read.
Nothing is shuffled: every rule looks at one row, and texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word definition [^\x20\x09-\x0D]+ .
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document must keep this share (in percent) of its word characters.
MIN_KEPT_PERCENT = 50
#: A line whose symbols exceed this share of its characters fails.
MAX_SYMBOL_PERCENT = 10
#: A line of fewer words must end with a punctuation mark.
SHORT_LINE = 5
ENDS_WELL = r"[.!?:;,…。！？\"'”’»)\]]$"
NAVIGATION = (
    r"(\|[^|]*\|[^|]*\|)|(»[^»]*»)|(>[^>]*>[^>]*>)|(•[^•]*•)"
    r"|^(home|menu|next|previous|back|login|log in|sign in|sign up|register|search|share|tweet|contact|about us|site map|read more|skip to content)[ .:»>]*$"
)
BOILERPLATE = (
    r"all rights reserved|licen[sc]ed under|released under|terms of (use|service)|privacy policy|cookie policy"
    r"|(uses|accept) cookies|enable javascript|lorem ipsum|subscribe to our|click here to"
)
BOILERPLATE_WORDS = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes of their words' 64-bit hashes."""
    one = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))

    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))

    def covered(hashes: Column) -> Column:
        marked = let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
            lambda s: F.filter(
                F.transform(s, lambda x, i: F.when(same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x), x["at"])), lambda at: at.isNotNull()
            ),
        )
        add = lambda acc, at: F.struct(
            (acc["covered"] + F.lit(window) - F.greatest(F.lit(0), acc["end"] - at)).alias("covered"), (at + F.lit(window)).alias("end")
        )
        return F.aggregate(F.sort_array(marked), one, add, lambda acc: acc["covered"])

    def of(hashed: Column) -> Column:
        n = F.size(hashed)
        grams = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(window)]))
        return F.when(n < window + 1, F.lit(0)).otherwise(
            let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def without_space(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def line_passes(line: Column) -> Column:
    """A line without words neither passes nor counts."""
    low = F.lower(F.btrim(line, F.lit(SPACE)))
    size, n_words = F.length(low), F.size(F.split(low, r"[\x20\x09-\x0D]+"))
    symbols = size - F.length(F.translate(low, SYMBOLS, ""))
    punctuation = (symbols * 100 <= size * MAX_SYMBOL_PERCENT) & ((n_words >= SHORT_LINE) | low.rlike(ENDS_WELL))
    boilerplate = (n_words <= BOILERPLATE_WORDS) & low.rlike(BOILERPLATE)
    return (low != "") & punctuation & ~low.rlike(NAVIGATION) & ~boilerplate


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the figures of both levels, cleaned text and verdict for every row."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    figures = whole.select(
        "doc_id",
        "text",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(without_space(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(
            F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.array_join(F.filter(x, line_passes), "\n").alias("clean_text"),
            ),
        ).alias("lines"),
    )
    n, r = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)
    return figures.select(
        "doc_id", "w.n_words", "word_chars", "n_symbols", "lines.n_dup_lines", "w.n_repeat_words", "lines.clean_text",
        F.length(without_space(F.col("lines.clean_text"))).cast("long").alias("kept_chars"),
    ).select(
        "*",
        failed.alias("base_failed"),
        (~failed & (F.col("kept_chars") * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT)).alias("kept"),
    )
