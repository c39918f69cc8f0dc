"""Awkward rows and brute-force helpers for the tests of the text operators."""

import re

import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = ["row_", "key_", "size_", "n_words", "kept", "class_", "words_", "copies", "taken", "sequence_id", "text_", "doc"]


def words(text):
    return WORD.findall(text or "")


def prose(n, seed=0):
    """n made-up words; different seeds share hardly any run of words."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join(chr(97 + (x >> s) % 26) for s in (3, 7, 11, 15, 19)))
    return out


def awkward():
    """Rows with nulls, empty and very long texts, ties and repeats."""
    base = " ".join(prose(120, 1))
    long = " ".join(prose(9000, 2)) + "\n" + " ".join(prose(30, 3))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, long, "de", "b"),
        (6, base.replace(" ", "\n", 3) + " extra tail", "xx", "a"), (6, "same id, other text " + " ".join(prose(60, 4)), "fr", "c"),
        (7, "one", "es", None), (8, " \t\n ", "en", ""), (9, "The same line\nThe same line\n\nThe same line", "en", "c"),
        (None, "without id " + " ".join(prose(40, 5)), "en", "a"), (None, None, None, None), (10, base, "en", "a"), (10, base, "en", "a"),
        (11, "mail a.b@c.example.com card 4111 1111 1111 1111 on 2001-02-03 from 10.0.0.255", "en", "b"),
        (12, "é ü ñ \U0001F600 " * 40, "fr", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def frame(spark, rows=None, clashes=True):
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})
    return df


def documents(folder):
    return pd.read_parquet(f"{folder}/documents.parquet")
