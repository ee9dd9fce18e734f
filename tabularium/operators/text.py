"""Token, lexicon and TF-IDF analytics over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.guarded import col, string_columns, wide_to_long
from .lookup import join_lookup
from .ordered import row_numbers
from .similarity import saved

# letters, numbers and underscore of any script; everything else separates tokens
SEPARATOR = r"[^\p{L}\p{N}_]+"
#: tables of at most so many terms are broadcast
LOOKUP_ROWS = 100_000
ARABIC = r"[^\x{0600}-\x{06FF}]"


def text_columns(df: DataFrame, min_average: float = 20.0) -> DataFrame:
    """(column, average_length, is_text) of the string columns."""
    columns = string_columns(df)
    row = df.agg(*[F.avg(F.length(col(c))).alias(f"a{i}") for i, c in enumerate(columns)])
    table = wide_to_long(row, {c: {"average_length": F.col(f"a{i}")} for i, c in enumerate(columns)})
    return table.withColumn("is_text", F.coalesce(F.col("average_length") > min_average, F.lit(False)))


def arabic_share(c: str) -> Column:
    return F.try_divide(F.length(F.regexp_replace(col(c), ARABIC, "")).cast("double"), F.length(col(c)))


def detect_language(df: DataFrame, column: str, name: str = "language") -> DataFrame:
    return df.withColumn(name, F.when(arabic_share(column) > 0.3, "ar").when(col(column).isNotNull(), "en"))


def corpus_language(df: DataFrame, column: str) -> DataFrame:
    """(texts, average_length, arabic_share, language) of the whole column."""
    texts = df.filter(col(column).isNotNull())
    arabic = F.sum(F.length(F.regexp_replace(col(column), ARABIC, ""))).cast("double")
    row = texts.agg(
        F.count(F.lit(1)).alias("texts"),
        F.round(F.avg(F.length(col(column))), 2).alias("average_length"),
        F.try_divide(arabic, F.sum(F.length(col(column))) + F.count(F.lit(1)) - 1).alias("arabic_share"),
    )
    language = F.when(F.col("texts") == 0, "unknown").when(F.col("arabic_share") > 0.3, "ar").otherwise("en")
    return row.withColumn("language", language)


def tokens(c: str) -> Column:
    return F.array_remove(F.split(F.lower(col(c)), SEPARATOR), "")


def tokenise(df: DataFrame, column: str, name: str = "tokens") -> DataFrame:
    return df.withColumn(name, tokens(column))


def _words(df: DataFrame, column: str, stop: list[str], min_length: int) -> DataFrame:
    words = df.select(F.explode(tokens(column)).alias("word"))
    return words.filter(~F.col("word").isin(stop) & (F.length("word") >= min_length))


def word_counts(df: DataFrame, column: str, language: str = "en", k: int | None = 50) -> DataFrame:
    """(word, count): most frequent words of three or more letters that are not stop words."""
    stop = lexicon.STOP_AR if language == "ar" else lexicon.STOP_EN
    counts = _words(df, column, stop, 3).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), "word")
    return ordered.limit(k) if k else ordered


def topics(df: DataFrame, column: str, language: str = "en") -> DataFrame:
    return word_counts(df, column, language, 10)


def _lexicons(language: str) -> tuple[list[str], list[str]]:
    return (lexicon.POSITIVE_AR, lexicon.NEGATIVE_AR) if language == "ar" else (lexicon.POSITIVE_EN, lexicon.NEGATIVE_EN)


def with_sentiment(df: DataFrame, column: str, language: str = "en", name: str = "sentiment") -> DataFrame:
    """positive, negative or neutral by the number of distinct lexicon words present."""
    positive, negative = _lexicons(language)
    hits = lambda words: F.size(F.array_intersect("__tokens", F.array(*[F.lit(w) for w in words])))
    counted = df.withColumn("__tokens", tokens(column)).withColumn("__gap", hits(positive) - hits(negative))
    label = F.when(F.col("__gap") > 0, "positive").when(F.col("__gap") < 0, "negative").otherwise("neutral")
    return counted.withColumn(name, F.when(col(column).isNotNull(), label)).drop("__tokens", "__gap")


def sentiment_summary(df: DataFrame, column: str, language: str = "en") -> DataFrame:
    """(positive, negative, neutral, positive_pct, negative_pct) over the texts."""
    labelled = with_sentiment(df.select(col(column)), column, language, "__s").filter("__s IS NOT NULL")
    count = lambda s: F.count_if(F.col("__s") == s)
    share = lambda s: F.round(F.coalesce(F.try_divide(count(s) * 100.0, F.count(F.lit(1))), F.lit(0.0)), 1)
    return labelled.agg(
        count("positive").alias("positive"),
        count("negative").alias("negative"),
        count("neutral").alias("neutral"),
        share("positive").alias("positive_pct"),
        share("negative").alias("negative_pct"),
    )


def cleaned(c: str, ascii_only: bool = False) -> Column:
    """Lower case without punctuation, digits and repeated spaces; or ASCII letters and spaces only."""
    text = F.lower(col(c))
    if ascii_only:
        text = F.regexp_replace(text, r"[^a-z\s]", "")
    else:
        text = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), r"\p{Nd}+", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(df: DataFrame, column: str, name: str | None = None, ascii_only: bool = False) -> DataFrame:
    return df.withColumn(name or column, cleaned(column, ascii_only))


def terms(c: str, ngrams: int, stop: list[str]) -> Column:
    """Tokens of two or more characters without stop words, plus neighbouring pairs when ``ngrams`` is 2."""
    words = F.filter(tokens(c), lambda w: (F.length(w) >= 2) & ~w.isin(stop)) if stop else F.filter(tokens(c), lambda w: F.length(w) >= 2)
    if ngrams == 1:
        return words
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, F.when(b.isNotNull(), b)))
    pairs = F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(words, pairs)


def _pairs(df: DataFrame, keys: list[str], column: str, stop: list[str]) -> DataFrame:
    """(keys, __w, __n): each word and the one that follows it, null behind the last."""
    worded = df.select(*[col(k) for k in keys], terms(column, 1, stop).alias("__w"))
    following = F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0)))
    zipped = worded.withColumn("__n", following).select(*keys, F.explode(F.arrays_zip("__w", "__n")).alias("z"))
    return zipped.select(*keys, "z.__w", "z.__n")


def _joined() -> Column:
    return F.concat(F.col("__w"), F.lit(" "), F.col("__n"))


def term_rows(df: DataFrame, key: str, column: str, ngrams: int, stop: list[str]) -> DataFrame:
    """(key, term), one row per occurrence; pairs are formed after the explode, inside generated code."""
    if ngrams == 1:
        return df.select(col(key), F.explode(terms(column, 1, stop)).alias("term"))
    both = F.array(F.col("__w"), _joined())
    return _pairs(df, [key], column, stop).select(key, F.explode(both).alias("term")).filter(F.col("term").isNotNull())


def frequent_terms(df: DataFrame, column: str, ngrams: int, k: int, stop: list[str]) -> DataFrame:
    """(term): the ``k`` terms of highest corpus count, ties by term.

    A pair is no more frequent than its words. With the count of the k-th word as a bound, only pairs of two words that reach
    it can be among the k, so no other pair is counted: k words at that count or above are there already.
    """
    words = saved(df.select(F.explode(terms(column, 1, stop)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "words")
    best = words.orderBy(F.desc("n"), "term").limit(k)
    if ngrams == 1:
        return best.select("term")
    # at most k rows, and those words that tie with the last of them
    low = best.agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low")).first()
    bound = low["low"] if low["rows"] == k else 0
    common = words.filter(F.col("n") >= F.lit(bound)).select(F.col("term").alias("__w"))
    # many words tie only where most are rare; Spark then sees the size at run time
    small = F.broadcast if common.count() <= LOOKUP_ROWS else lambda x: x
    pairs = _pairs(df, [], column, stop).join(small(common), "__w").join(small(common.withColumnRenamed("__w", "__n")), "__n")
    counted = pairs.groupBy("__w", "__n").agg(F.count(F.lit(1)).alias("n")).select(_joined().alias("term"), "n")
    return words.unionByName(counted).groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(k).select("term")


def vocabulary(df: DataFrame, key: str, column: str, ngrams: int, k: int | None, stop: list[str]) -> DataFrame:
    """(term): the ``k`` terms of highest corpus count, ties by term; all of them without ``k``.

    For many terms, where most words are as rare as pairs: all are counted, and only those at the count of the k-th or above are
    put in order, by ranges if they are many. ``frequent_terms`` would gather ``k`` rows of every task in one.
    """
    counted = saved(term_rows(df, key, column, ngrams, stop).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")
    if k is None:
        return counted.select("term")
    above, low = 0, 0
    # one row for each different count
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("n")).collect():
        above, low = above + r["terms"], r["n"]
        if above >= k:
            break
    counted = counted.filter(F.col("n") >= low)
    if above > k:
        placed = row_numbers(counted.withColumn("__rare", -F.col("n")), [], ["__rare", "term"], "__place")
        counted = placed.filter(F.col("__place") <= k)
    return saved(counted.select("term"), "vocabulary")


def tfidf(df: DataFrame, key: str, column: str, ngrams: int = 1, max_features: int | None = None, stop: list[str] | None = None) -> DataFrame:
    """(key, term, tf, df, weight): count * (ln((1+N)/(1+df)) + 1), L2-normalised per document.

    ``max_features`` keeps the terms of highest corpus count (ties by term); then only those are counted by document.
    """
    stop = lexicon.STOP_EN if stop is None else stop
    n = df.filter(col(column).isNotNull()).count()
    rows = term_rows(df, key, column, ngrams, stop)
    small = F.broadcast if max_features and max_features <= LOOKUP_ROWS else lambda x: x
    if max_features:
        rows = rows.join(small(saved(frequent_terms(df, column, ngrams, max_features, stop), "terms")), "term")
    # written once: the vocabulary and the join read the counts, not the texts again
    counts = saved(rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")), "tfidf")
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.col("tf") * (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    joined = counts.join(small(vocabulary), "term").withColumn("__raw", raw)
    # a document's terms are bounded by the document itself
    norm = F.sqrt(F.sum(F.col("__raw") * F.col("__raw")).over(Window.partitionBy(key)))
    return joined.select(key, "term", "tf", "df", (F.col("__raw") / norm).alias("weight"))


def top_terms_by_class(weights: DataFrame, labels: DataFrame, key: str, label: str, k: int = 10) -> DataFrame:
    """(label, term, mean_weight, rank): highest mean weight over all documents of the class, absent terms counting 0."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    sums = weights.join(labels, key).groupBy(label, "term").agg(F.sum("weight").alias("__s"))
    means = join_lookup(sums, sizes, [label]).select(label, "term", (F.col("__s") / F.col("__n")).alias("mean_weight"))
    order = Window.partitionBy(label).orderBy(F.desc(F.round("mean_weight", 9)), "term")
    return means.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
