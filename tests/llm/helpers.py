import random
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator must bear: null and empty texts, null ids, repeated rows, a very long text and odd letters.
EDGES = [(1, None), (2, ""), (3, " \t\n "), (None, "no id here"), (5, "same row"), (5, "same row"), (6, "x" * 300_000), (7, "word " * 60_000), (8, "日本語 😀 é\u0000   ﬁ"), (9, "<|endoftext|> a")]


def docs(spark, rows, *more):
    """A frame of (doc_id, text) rows, with clashing further columns if asked for."""
    full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in more:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, share):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), int(len(w) * share)):
        w[i] = "zz" + str(rng.randrange(10**6))
    return " ".join(w)


def rng(seed=1):
    return random.Random(seed)
