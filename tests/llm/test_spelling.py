"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from cases import DOCS, documents, frame
from shelfprice.llm import spelling
from shelfprice.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def described(counts):
    """Rows by comparing the words of like length and letters with each other."""
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    found, form = {}, {}
    for w, n in counts.items():
        others = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        found[w] = len(others)
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, found[w], counts.get(form[w])))
    return rows


def got(df):
    assert df.columns == NAMES
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark, folder):
    docs = documents(folder)
    counts = counted(zip(docs.doc_id, docs.text))
    assert got(QUERIES["op11_spelling_variants"](spark, folder)) == described(counts)


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_few_letters_many_neighbours(spark, ranges):
    """Words of two or three letters: runs of equal letters, shared prefixes that cross ranges, chains of forms."""
    pick = random.Random(3)
    words = ["".join(pick.choice("aabé") for _ in range(pick.randint(1, 8))) for _ in range(900)]
    counts = {w: int(3 * 2 ** pick.uniform(0, 9)) for w in dict.fromkeys(words)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        assert got(spelling.forms(spark.createDataFrame(list(counts.items()), "word string, n long"))
                   .select(*NAMES)) == described(counts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_words_of_every_letter(spark):
    """One skipped place with every letter of the alphabet, and the word without it."""
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    counts = {f"abcd{x}efg": 3 + k for k, x in enumerate(letters)} | {"abcdefg": 500}
    assert got(spelling.forms(spark.createDataFrame(list(counts.items()), "word string, n long")).select(*NAMES)) == described(counts)


def test_awkward_rows(spark):
    rows = [(1, "Colour colour COLOUR, color;color color×", "en", "a", 1), (1, "Colour colour", "en", "a", 1),
            (None, "colour Éclair éclair Éclair Éclair", None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0),
            (4, "x" * 70_000 + " " + "x" * 69_999 + " " + "y" * 20_000, "en", "a", 0)] + [
            (5, "x" * 70_000, "en", "a", 0)] * 3 + [(6, "x" * 69_999 + " 中colour中", "en", "a", 0)] * 3
    counts = counted([(r[0], r[1]) for r in rows])
    want = described(counts)
    assert got(spelling.variants(frame(spark, rows))) == want
    assert got(spelling.variants(spark.createDataFrame([], DOCS))) == set()


def test_counts_are_flushed(spark, folder, monkeypatch):
    docs = documents(folder)
    want = counted(zip(docs.doc_id, docs.text))
    monkeypatch.setattr(spelling, "MOST_HELD", 50)
    found = spelling.word_counts(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert {r["word"]: r["n"] for r in found} == want
