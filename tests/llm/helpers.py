"""Small tables with nulls, empties, repeats, long texts and columns whose names clash with the operators' own."""

import random

RNG = random.Random(5)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "über", "naïve", "the", "of", "and", "x", "42", "zeta", "eta", "theta", "iota", "Kappa"]


def prose(n, seed=None):
    rng = random.Random(seed) if seed is not None else RNG
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def tricky_texts():
    return [None, "", " ", "\n\t", "one", "One two", prose(30, 1), prose(30, 1), prose(40, 2) + ".\n" + prose(5, 3), "É" * 50, "a" * 5000, prose(6000, 4), "<|endoftext|> it's 3.5% — naïve x\x1cy", "日本語 テキスト"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, row string, fp long, key string, bucket int, items string"


def documents(spark, texts=None, ids=None):
    texts = tricky_texts() if texts is None else texts
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None, None, 0.5, "l", "r", 1, "k", 2, "it") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def repeated(spark):
    """Repeated rows, an id with two texts, and a null id."""
    texts = [prose(20, 1), prose(20, 1), prose(25, 2), prose(25, 3), None, None]
    return documents(spark, texts, [4, 4, 7, 7, None, 9])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
