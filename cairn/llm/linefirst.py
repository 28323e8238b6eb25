"""Line-first quality rules, in DataFrame operations only.

Every line is judged by itself, failing lines are removed, and a document that loses too much of its text by that is
rejected. A line fails if it is

* unpunctuated: ``MIN_WORDS`` words or more without any sentence mark;
* navigation: at least one separator (``|``, ``»``, ``›``, ``•``) for every ``WORDS_PER_SEPARATOR`` words, and two at least;
* boilerplate: it contains a phrase of ``BOILERPLATE``;
* noisy: a symbol of ``[#*$%&|<>]`` for every ``CHARS_PER_SYMBOL`` characters or more;
* shouting: at least ``MIN_WORDS`` words and an exclamation mark for every other word.

A line without a word is neither kept nor lost.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 8
WORDS_PER_SEPARATOR = 3
CHARS_PER_SYMBOL = 10
#: A document goes if the lines left hold less than this share of the characters of all lines, in percent.
KEEP_PERCENT = 50
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "sign up", "log in", "subscribe to our", "click here", "read more", "back to top", "skip to content", "share on", "follow us on",
    "powered by", "page not found", "add to cart", "lorem ipsum",
)

_BLANK = r"[\x20\x09-\x0D]+"
_SYMBOL = "[#*$%&|<>]"
_SEPARATOR = "[|»›•]"
_MARK = r"[.!?…。！？]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_passes(line: Column, lowered: Column) -> Column:
    """Whether a line (without its newline) is kept; ``lowered`` is the line in lower case.

    A cheap test stands before each count, so most lines are counted by no rule.
    """
    words = _count(line, r"[^\x20\x09-\x0D]+")
    unpunctuated = ~line.rlike(_MARK) & (words >= MIN_WORDS)
    navigation = line.rlike(f"{_SEPARATOR}[^|»›•]*{_SEPARATOR}") & (_count(line, _SEPARATOR) * WORDS_PER_SEPARATOR >= words)
    noisy = line.rlike(_SYMBOL) & (_count(line, _SYMBOL) * CHARS_PER_SYMBOL >= F.length(line))
    shouting = line.contains("!") & (words >= MIN_WORDS) & (_count(line, "!") * 2 >= words)
    return ~(reduce(or_, (lowered.contains(phrase) for phrase in BOILERPLATE)) | unpunctuated | navigation | noisy | shouting)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, the base verdict, the cleaned text and the final verdict.

    Columns: ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, line_chars,
    clean_chars, kept``. Words are ``[^\\x20\\x09-\\x0D]+``. ``n_repeat_words`` counts the words that lie in a three-word
    window found twice or more in the text. ``base_failed``: fewer than 50 words, or more than half of them repeated.
    Null and empty texts have no words and fail. Rows are judged one by one: ids may be null or repeated, other
    columns are ignored, an empty table gives an empty result, and no shuffle takes place. A text is whole in one row's
    memory, with arrays of its words, lines and windows: about ten times its size. Ties of a threshold pass (a share of
    ``KEEP_PERCENT`` is kept) or fail as the comparisons above say.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    step = step.select("id", "text", F.array_remove(F.split("text", _BLANK), "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    # windows as 64-bit hashes; inside one text, different windows agree with a chance of n**2 / 2**65
    grams = F.expr("CASE WHEN size(w) >= 3 THEN transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])) ELSE array() END")
    step = step.select(
        "id",
        "lines",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), _SYMBOL).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.cast("array<bigint>").alias("g"),
        F.filter(F.transform("lines", lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"))), lambda x: line_passes(x["line"], x["low"])).alias("good"),
    ).withColumn("good", F.col("good.line"))
    step = step.withColumn("s", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x AS x, i AS i))) END"))
    twice = "(k > 0 AND s[k - 1].x = e.x) OR (k + 1 < size(s) AND s[k + 1].x = e.x)"
    step = step.withColumn("p", F.expr(f"sort_array(transform(filter(s, (e, k) -> {twice}), e -> e.i))"))
    repeated = F.expr("coalesce(aggregate(transform(p, (v, k) -> IF(k + 1 < size(p), least(3, p[k + 1] - v), 3)), 0L, (a, b) -> a + b), 0L)")
    chars = "aggregate({0}, 0L, (a, b) -> a + length(b))"
    step = step.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), F.array_join("good", "\n").alias("clean_text"),
        F.expr(chars.format("lines")).alias("line_chars"), F.expr(chars.format("good")).alias("clean_chars"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    step = step.withColumn("base_failed", failed)
    return step.withColumn("kept", ~F.col("base_failed") & (100 * F.col("clean_chars") >= KEEP_PERCENT * F.col("line_chars")))
