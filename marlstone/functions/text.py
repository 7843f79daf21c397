"""Columns of text: pages, sentences, chunks, tokens."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is taken out of a page, in this order.
PAGE_PARTS = [r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<[^>]*>"]
SENTENCE_END = "[.!?。！？]+"
#: Scripts that are written without spaces: Han, Hiragana, Katakana.
UNSPACED = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
WORD = r"[\p{L}\p{M}\p{N}]+"


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    bare = reduce(lambda c, part: F.regexp_replace(c, part, " "), PAGE_PARTS, html)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def chunks(text: Column, size: int = 200, step: int = 150) -> Column:
    """Overlapping pieces of size characters that start every step; an empty text has one empty chunk, a null one null.

    The text is cut once into parts that size and step are made of, and chunks are put together from neighbours, so
    that time is in proportion to the text (substring would count from the start each time)."""
    part = gcd(size, step)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{part}}}"), F.lit(0))

    def put_together(parts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(step // part))
        return F.transform(starts, lambda at: F.array_join(F.slice(parts, at + 1, F.lit(size // part)), ""))

    # an array of one element, so that the text is cut once and not once a chunk
    return F.when(text.isNotNull(), F.transform(F.array(cut), put_together)[0])


def bigrams(run: Column) -> Column:
    """The overlapping pairs of a run's characters; one character stands alone. In time in proportion to the run."""
    pairs = lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.concat(a, b))
    # an array of one element, so that the run is split once
    return F.when(F.char_length(run) < 2, F.array(run)).otherwise(F.transform(F.array(F.split(run, "")), pairs)[0])


def tokens(text: Column) -> Column:
    """Lower-cased words in order: runs of letters, marks and digits of any script; of scripts that are written without
    spaces, each run's pairs of characters. A null text has null.

    Texts in ASCII are split by a simpler pattern, and only those that have an unspaced script are looked at for pairs."""
    low = F.lower(text)
    plain = F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")
    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    apart = words(F.regexp_replace(low, f"([{UNSPACED}]+)", " $1 "))
    paired = F.flatten(F.transform(apart, lambda w: F.when(w.rlike(f"^[{UNSPACED}]"), bigrams(w)).otherwise(F.array(w))))
    return F.when(F.octet_length(text) == F.char_length(text), plain).when(text.rlike(f"[{UNSPACED}]"), paired).otherwise(words(low))


def normal(text: Column) -> Column:
    """Tokens with a space before, between and after: a phrase in this form is contained where its tokens follow."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def token_shingles(text: Column, n: int) -> Column:
    """The distinct runs of n tokens."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size(words))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))

    return F.when(text.isNotNull(), F.transform(F.array(tokens(text)), runs)[0])
