"""Term features of texts, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"(?U)\b\w\w+\b"


def words(text: str, stop_words: list[str] | None = None, pattern: str = WORD) -> Column:
    """The lower-cased words of two characters or more of a text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def grams(found: str, ngrams: tuple[int, int]) -> Column:
    """The n-grams of the array of words in column found."""
    size = F.size(found)

    def of(n: int) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return F.flatten(F.array(*map(of, range(ngrams[0], ngrams[1] + 1))))


def counts(docs: DataFrame, key: str, text: str, ngrams: tuple[int, int] = (1, 1), **options: object) -> DataFrame:
    """(key, term, n) of each term of a document: its words, or n-grams of them; options as in `words`."""
    if ngrams == (1, 1):
        each = docs.select(key, F.explode(words(text, **options)).alias("term"))
    else:  # out of an array of one, the words are made once, not again for each gram
        each = docs.select(key, F.explode(F.array(words(text, **options))).alias("_words")).select(key, F.explode(grams("_words", ngrams)).alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("n"))


def vocabulary(found: DataFrame, n_docs: int, min_df: float = 1, max_df: float = 1.0, listed: list[str] | None = None) -> DataFrame:
    """(term, df) of the terms in at least min_df and at most max_df documents (shares where they are floats)."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    if listed is not None:
        return df.where(F.col("term").isin(*listed))
    low, high = (v if isinstance(v, int) else v * n_docs for v in (min_df, max_df))
    return df.where((F.col("df") >= low) & (F.col("df") <= high))


def tf_idf(found: DataFrame, key: str, n_docs: int, vocab: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): counts times ln((1 + docs) / (1 + df)) + 1, each document's weights of length 1."""
    vocab = vocab if vocab is not None else vocabulary(found, n_docs)
    raw = found.join(vocab, "term").select(key, "term", (F.col("n") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def matrix(weights: DataFrame, key: str, value: str, terms_wanted: list[str]) -> DataFrame:
    """A row for each document, a column for each of the terms wanted, 0 where it has none."""
    return weights.groupBy(key).pivot("term", terms_wanted).agg(F.first(value)).na.fill(0)
