"""Quality rules: simple counts, and the distance of a text's histograms from its language's. Columns only.

Two histograms describe a text: shares of character classes, and shares of its language's common words among all
words. The references are the sums over all texts of a language. A text is turned down if the Jensen-Shannon distance
(square root of the divergence in bits) of either histogram exceeds its threshold. Guards: the character histogram
counts from ``MIN_CHARS`` code points on, the word histogram from ``MIN_WORDS`` words on and for languages with a word
list; shorter texts pass that test.

The counts of a text are made in one narrow pass; the pass writes a small row per text, from which references and
verdicts follow. References have one row per language.

Defined results: a null text has no words and no lines with words; a null language is a language of its own, without
a word list; rows are kept one by one; an empty table gives an empty result; other columns are ignored; texts are
read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicegrad.llm.common import SPACES, WORD, saved, text_of
from slicegrad.session import bounded_broadcast

# Character classes (the rest is one more class) and the most common words of some languages.
CHAR_CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "space": SPACES,
    "sign": r".,;:!?'\"()-",
    "symbol": r"#*$%&|<>@^~_+=/\\{}\[\]",
}
COMMON_WORDS = {
    "en": "the of and to in is that for it as with was on be by are".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_BASE_WORDS = 50
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.45


def length_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more in the text, each word once.

    Windows are hashed and sorted with their positions, so equal ones are neighbours; no step is quadratic.
    """
    n = F.size(words) - WINDOW + 1
    hashed = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("at")),
    )

    def flagged(runs: Column) -> Column:
        same = lambda x, j: x["h"].eqNullSafe(F.get(runs, j)["h"])
        return F.transform(F.filter(runs, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["at"])

    places = F.get(F.transform(F.array(F.sort_array(hashed)), flagged), F.lit(0))
    covered = F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["stop"])).alias("n"), (p + WINDOW).alias("stop")),
        lambda acc: acc["n"],
    )
    return F.when(n > 1, covered).otherwise(F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))
    return F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")


def count_word(padded: Column, word: str) -> Column:
    """Occurrences of ``word`` in a text whose words have a space on either side."""
    return ((F.char_length(padded) - F.char_length(F.replace(padded, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("long")


def text_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, lang``, the base counts, and the two histograms (the word histogram is null without a word list)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), text_of(text).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    body = F.col("text")
    classes = [length_without(body, f"[^{inside}]+") for inside in CHAR_CLASSES.values()]
    rows = rows.select(
        "key", "lang", F.size("words").cast("long").alias("n_words"), length_without(body, f"[{SPACES}]+").alias("word_chars"),
        length_without(body, f"[^{SYMBOLS}]+").alias("n_symbols"), duplicate_lines(body).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"), F.char_length(body).cast("long").alias("n_chars"),
        F.array(*classes).alias("classes"),
        F.lower(F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).alias("padded"),
    )
    listed = F.lit(None).cast("array<bigint>")
    for name, words in COMMON_WORDS.items():
        listed = F.when(F.col("lang") == name, F.array(*[count_word(F.col("padded"), w) for w in words])).otherwise(listed)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    rows = rows.withColumn("listed", listed).drop("padded")
    return rows.select(
        "key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
        F.concat("classes", F.array(F.col("n_chars") - total("classes"))).alias("chars"),
        F.concat("listed", F.array(F.col("n_words") - total("listed"))).alias("common"),
    )


def references(counts: DataFrame) -> DataFrame:
    """``ref_lang, ref_chars, ref_common``: summed histograms of each language, one row per language."""
    def summed(column: str, bins: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(column, F.lit(k))), F.lit(0)) for k in range(bins)])

    bins = max(map(len, COMMON_WORDS.values())) + 1
    return counts.groupBy(F.col("lang").alias("ref_lang")).agg(
        summed("chars", len(CHAR_CLASSES) + 1).alias("ref_chars"), summed("common", bins).alias("ref_common")
    )


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms, from 0 (alike) to 1; zero if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    both = F.zip_with(counts, reference, lambda c, r: F.struct((c / total(counts)).alias("p"), (r / total(reference)).alias("q")))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    divergence = F.aggregate(
        both, F.lit(0.0), lambda acc, x: acc + part(x["p"], (x["p"] + x["q"]) / 2) / 2 + part(x["q"], (x["p"] + x["q"]) / 2) / 2
    )
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(0.0))


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
          max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The base counts of each document, ``base_failed``, both distances (null where guarded), and ``kept``."""
    counts, _ = saved(text_counts(docs, key=key, text=text, lang=lang), "text-counts")
    refs, _ = saved(references(counts), "references")
    refs = bounded_broadcast(refs, refs.count(), 40)
    rows = counts.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")))
    char = F.when(F.col("n_chars") >= MIN_CHARS, distance(F.col("chars"), F.col("ref_chars")))
    word = F.when((F.col("n_words") >= MIN_WORDS) & F.col("common").isNotNull(), distance(F.col("common"), F.col("ref_common")))
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select(
        "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        char.alias("char_distance"), word.alias("word_distance"),
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return rows.withColumn("kept", ~F.col("base_failed") & near)
