"""Small frames with the awkward cases that every operator must take."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    vocabulary = [f"w{i}" for i in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(spark, seed=1, n=60, parts=4):
    """Documents with exact copies, near copies, shared passages, junk, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    passage, base = prose(rng, 70), [prose(rng, rng.randint(5, 300)) for _ in range(n)]
    for i, text in enumerate(base):
        words = text.split()
        kind = i % 10
        if kind == 1:
            text = base[i - 1]
        elif kind == 2:
            words = base[i - 2].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = f"{' '.join(words[:40])}\n{passage} {' '.join(words[40:80])}"
        elif kind == 4:
            text = " ".join(w + "###" for w in words)
        elif kind == 5:
            text = f"{words[0]} " * 80
        rows.append((i, text, ("en", "de", None)[i % 3], "hot" if i % 2 else f"s{i % 7}", len(text)))
    rows += [(n, None, "en", None, None), (n + 1, "", None, "s1", 0), (n + 2, " \t\n\v", "de", "s1", 4), (n + 3, "one", "en", "s1", 3), (n + 4, "one two", "en", "s1", 7),
             (n + 5, "Ünï cödé   𝔘 text\r\nline\nline\n", "fr", "s2", 30), (None, prose(rng, 90), "en", "s1", 5), (3, rows[3][1], "de", "hot", 1), (3, rows[3][1], "de", "hot", 1),
             (n + 6, prose(rng, 20_000), "en", "s3", 1), (-7, base[0] + " " + passage, "en", "s1", 1), (n + 7, "x" * 70_000, "en", "s1", 70_000), (n + 8, "a\x00b \x00 c", "en", "s1", 6)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def clashing(df, *names):
    """``df`` with more columns whose names operators use themselves."""
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
