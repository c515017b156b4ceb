"""Vectors of unknown words from their character n-grams.

A word that has no vector of its own gets the mean of the vectors of its
character n-grams.  The word is put between ``<`` and ``>``, every run of
``min_n`` to ``max_n`` characters is one n-gram (repeats count), and an
n-gram's vector is the row of a bucket table that its 32-bit FNV-1a hash
falls on.

All of it is expressions, one join and one partially aggregated mean over
the *distinct unknown words*, so the work grows with the vocabulary, not
with the text.  N-grams are cut by a look-ahead pattern in time
proportional to the word, however long it is, and (word, bucket) pairs are
counted before the join.  A digest stands for the word from the cut to the
mean, so that a long word is not copied with each of its n-grams.  A frequent n-gram is one hot bucket; the bucket
table has one row per key, so AQE can split the other side.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readpaths.operators.text import mean_word_vectors, vector_size, word_counts
from readpaths.session import stored

# The 32-bit FNV-1a offset and prime, and what extends a byte of 128 or more
# as a signed number, which published sub-word models do before they mix it in.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295
SIGN_EXTENSION = 4294967040

MIN_N, MAX_N = 3, 6
N_BUCKETS = 2_000_000


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, bytes taken as signed, as a non-negative bigint (null: null)."""
    c = F.col(text) if isinstance(text, str) else text
    octets = F.transform(F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))

    def mix(h: Column, b: Column) -> Column:
        signed = b + F.when(b >= 128, F.lit(SIGN_EXTENSION)).otherwise(F.lit(0))
        return (h.bitwiseXOR(signed.cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK_32).cast("long"))

    return F.aggregate(octets, F.lit(FNV_OFFSET).cast("long"), mix)


def character_ngrams(word: Column | str, min_n: int = MIN_N, max_n: int = MAX_N) -> Column:
    """All n-grams of ``<word>``, by length and then position, repeats included (null: null)."""
    if not 2 <= min_n <= max_n:
        raise ValueError("n-grams have 2 or more characters, and min_n is at most max_n")
    c = F.col(word) if isinstance(word, str) else word
    marked = F.concat(F.lit("<"), c, F.lit(">"))
    # the look-ahead captures n characters, the dot moves on by one
    return F.concat(*(F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in range(min_n, max_n + 1)))


def subword_vectors(words: DataFrame, buckets: DataFrame, n_buckets: int = N_BUCKETS, min_n: int = MIN_N,
                    max_n: int = MAX_N, digits: int | None = None) -> DataFrame:
    """``word, vector`` (array<double>) of each distinct word from its n-grams.

    ``buckets`` holds ``bucket, vector``.  N-grams whose bucket has no row
    are skipped; a word without any other n-gram, a null or an empty word
    has no row.
    """
    keyed = stored(words.select("word").where(F.length("word") > 0).distinct().withColumn("key", F.sha2("word", 256)), "unknown")
    grams = (keyed.select("key", character_ngrams("word", min_n, max_n).alias("grams")).select("key", F.explode("grams").alias("gram"))
             .groupBy("key", "gram").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("key", (fnv1a("gram") % F.lit(n_buckets)).alias("bucket")).agg(F.sum("n").cast("double").alias("n")))
    rows = buckets.select(F.col("bucket").cast("long").alias("bucket"), array_to_vector("vector").alias("v"))
    mean = (grams.join(rows, "bucket").groupBy("key").agg(Summarizer.mean(F.col("v"), F.col("n")).alias("m"))
            .join(keyed, "key").select("word", vector_to_array("m").alias("vector")))
    return mean if digits is None else mean.withColumn("vector", F.transform("vector", lambda x: F.round(x, digits)))


def unknown_words(words: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """The distinct words without a row in ``word_vectors``."""
    return words.select("word").distinct().join(word_vectors.select("word"), "word", "left_anti")


def text_vectors_subwords(texts: DataFrame, word_vectors: DataFrame, buckets: DataFrame, n_buckets: int = N_BUCKETS,
                          min_n: int = MIN_N, max_n: int = MAX_N, id_col: str = "page_id", text_col: str = "text",
                          digits: int | None = 6) -> DataFrame:
    """``text.text_vectors`` in which unknown words take part with their sub-word vectors.

    Word counts are stored once, as the vocabulary and the mean both read
    them.  A text without a word that has any vector gets zeros.
    """
    counts = stored(word_counts(texts, id_col, text_col), "word_counts")
    vocabulary = counts.select("word").distinct()
    known = word_vectors.join(vocabulary, "word", "left_semi").select("word", F.col("vector").cast("array<double>").alias("vector"))
    others = subword_vectors(unknown_words(vocabulary, word_vectors), buckets, n_buckets, min_n, max_n)
    ids = texts.select(F.col(id_col).alias("page_id"))
    size = vector_size(word_vectors) or vector_size(buckets)
    return mean_word_vectors(ids, counts, known.unionByName(others), size, digits)
