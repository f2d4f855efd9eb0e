"""Text expressions: every function takes and returns Spark columns and stays in the JVM unless its name says so."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Leading words that a phrase's canonical form drops.
LEADING = ("the", "a", "an", "more", "better")
#: Function words that split stop from content words where no list is given.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: What de-identification of forum posts removes or replaces, in this order.
FOOTERS = (r"(?is)_{3,}.*?Happy CMVing!?\*?", r"(?is)(Hello,?\s*users of|This is a footnote from the moderators).*?Happy CMVing!?\*?")
DELTAS = r"[∆Δ]"
SCRUB = (
    (r"(?i)changemyview", " this forum "),
    (r"(?i)cmv\w*:?", " "),
    (r"(?i)/?r/\s*\w+", " a forum "),
    (r"(?i)subreddit\w*", " forum "),
    (r"(?i)\breddit(ors?)?\b", " "),
    (r"(?i)\bdelta\s*bot\b", " "),
    (r"(?i)!?\bdeltas?\b", " point "),
    (DELTAS, " "),
    (r"(?i)\baward(ed|ing|s)?\b\s*(a\s*)?(point|view|change)?", " "),
)
SPACE = r"(?U)\s+"


def re2(pattern: str) -> str:
    """A pattern of RE2 (DuckDB's) for Java: classes and word bounds are ASCII, blanks without U+000B.

    Ignoring case goes by Unicode in RE2, its ``\\w`` included: the long s and the Kelvin sign match s and k. Java's own
    ``\\b`` (before 19) takes all letters for word characters.
    """
    folded = "(?i)" in pattern
    word = r"(?-iu:[0-9A-Za-z_])"
    bound = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    kinds = {r"\b": bound, r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", r"\w": r"[0-9A-Za-z_\u017F\u212A]" if folded else word}
    return re.sub(r"\\.", lambda m: kinds.get(m[0], m[0]), pattern.replace("(?i)", "(?iu)"))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once per row, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Words between any Unicode blanks, none of them empty."""
    return F.filter(F.split(text_or_empty(c), SPACE), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def normalise_phrase(c: Column) -> Column:
    """Trimmed, lower-cased, without leading articles and comparatives, blanks collapsed; a bare article stays."""
    lead = "|".join(LEADING)
    t = F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(t, rf"(?U)^(?:(?:{lead})\s+)+", ""), SPACE, " ")


def letter_tokens(c: Column) -> Column:
    """Runs of a-z in the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z]+"), 0)


def truncated(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def cut_at(tokens: Column, part: int, parts: int = 4) -> Column:
    """The ``part``-th of ``parts`` contiguous pieces of an array; bounds are rounded down."""
    n = F.size(tokens).cast("double")
    lo = F.floor(F.lit(float(part)) * (n / parts)).cast("int")
    hi = F.floor(F.lit(float(part + 1)) * (n / parts)).cast("int")
    return F.slice(tokens, lo + 1, hi - lo)


def quarters(tokens: Column) -> Column:
    return F.array(*[cut_at(tokens, i) for i in range(4)])


def quarter_texts(c: Column) -> Column:
    """Four contiguous quarters of the words as texts; four copies of the whole below four words; ``.`` where empty."""
    dot = lambda t: F.when(t == "", ".").otherwise(t)
    whole = lambda w: F.array_repeat(dot(F.array_join(w, " ")), 4)
    return let(words(c), lambda w: F.when(F.size(w) < 4, whole(w)).otherwise(F.transform(quarters(w), lambda q: dot(F.array_join(q, " ")))))


def overlap(a: Column, o: Column) -> Column:
    """Common words, their share of a, of o, and of the union, for two arrays taken as sets; 0 where a set is empty."""

    def measures(n: Column) -> Column:
        common, na, no = n[0], n[1], n[2]
        share = lambda of: F.when(of > 0, common / of).otherwise(0.0)
        return F.array(common, share(na), share(no), share(na + no - common))

    sizes = F.array(F.size(F.array_intersect(a, o)).cast("double"), F.size(F.array_distinct(a)).cast("double"), F.size(F.array_distinct(o)).cast("double"))
    return let(sizes, measures)


def word_set_overlap(a: Column, o: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Overlap of stop words, content words and all words: twelve numbers."""
    s = F.array(*map(F.lit, stop))
    return F.concat(overlap(F.array_intersect(a, s), F.array_intersect(o, s)), overlap(F.array_except(a, s), F.array_except(o, s)), overlap(a, o))


def interplay(a: Column, o: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """36 numbers: overlap of whole texts, then the largest and the smallest over the 4 by 4 grid of their quarters."""

    def of(x: Column, y: Column) -> Column:
        grid = F.flatten(F.transform(quarters(x), lambda i: F.transform(quarters(y), lambda j: word_set_overlap(i, j, stop))))
        pick = lambda g, f: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: f(F.transform(g, lambda v: F.get(v, m))))
        return F.concat(word_set_overlap(x, y, stop), let(grid, lambda g: F.concat(pick(g, F.array_max), pick(g, F.array_min))))

    return let(a, lambda x: let(o, lambda y: of(x, y)))


def sentence_chunks(c: Column, max_words: int = 60, max_chunks: int = 64) -> Column:
    """Sentences packed greedily into chunks of at most ``max_words`` words; longer sentences are cut; ``.`` if none."""
    sentences = F.transform(F.split(text_or_empty(c), r"(?<=[.!?])\s+|\n+"), words)
    last = lambda w: F.greatest(F.lit(0), F.floor((F.size(w) - 1) / max_words)).cast("int")
    pieces = F.flatten(F.transform(sentences, lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: F.slice(w, i * max_words + 1, max_words))))
    pieces = F.filter(pieces, lambda w: F.size(w) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))

    def step(acc: Column, w: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (F.size(acc["now"]) + F.size(w) > max_words)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, w).otherwise(F.concat(acc["now"], w)).alias("now"),
        )

    packed = F.aggregate(pieces, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]))
    return F.when(F.size(packed) == 0, F.array(F.lit("."))).otherwise(F.slice(packed, 1, max_chunks))


def deidentified(c: Column, footers: tuple[str, ...] = FOOTERS, scrub: tuple[tuple[str, str], ...] = SCRUB, url: str = r"https?://\S+", edge: str | None = None) -> Column:
    """Without footers, links, addresses (``url``) and what ``scrub`` replaces; blanks collapsed, and cut off both ends.

    ``edge``: the characters cut off both ends (by default all Unicode blanks).
    """
    t = text_or_empty(c)
    for pattern in footers:
        t = F.regexp_replace(t, pattern, " ")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, url, " ")
    for pattern, new in scrub:
        t = F.regexp_replace(t, pattern, new)
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "") if edge is None else F.btrim(t, F.lit(edge))


def item_blob(title: Column, body: Column, challenge: Column) -> Column:
    return F.concat(F.lit("[OP VIEW]\n"), text_or_empty(title), F.lit("\n"), text_or_empty(body), F.lit("\n\n[CHALLENGE]\n"), text_or_empty(challenge))


def blob_challenge(blob: Column) -> Column:
    """What follows the challenge marker; an error where there is none."""
    mark = "[CHALLENGE]\n"
    at = F.instr(blob, mark)
    return F.when(at == 0, F.raise_error("a blob has no challenge marker")).otherwise(F.substring(blob, at + len(mark), F.length(blob)))


def digit_multiset(c: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(text_or_empty(c), F.lit("[0-9]+"), 0)), ",")


@F.pandas_udf(StringType())
def html_unescaped(s: pd.Series) -> pd.Series:
    """All HTML entities (Arrow batches in Python: Spark has no such function); null becomes empty."""
    return s.fillna("").map(_html.unescape)
