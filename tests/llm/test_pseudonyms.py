"""Format-preserving pseudonyms: formats, links, permutations, clean texts."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from cases import frame
from shelfprice.llm import pseudonyms, queries
from shelfprice.llm.common import table

KEY = "test"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


@pytest.fixture
def replaced(spark):
    def run(*texts, key=KEY):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return {r["doc_id"]: r for r in pseudonyms.pseudonymise(df, key).collect()}
    return run


def test_formats(replaced):
    texts = ["4111 1111 1111 1111", "4785380592391139", "+1 (743) 555-3824", "28.132.74.175", "1984-02-29", "29/02/1984",
             "31.12.1999", "123-45-6789", "hein.19@mail5.example.com", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    rows = replaced(*texts)
    for i, text in enumerate(texts):
        new = rows[i]["text"]
        assert new != text and rows[i]["n_found"] == 1
        if "." not in text or "@" in text:  # octets may change their length
            assert [c for c in text if not c.isalnum()] == [
                c for c in new if not c.isalnum()]
            assert len(new) == len(text)
    assert luhn(re.sub(r"\D", "", rows[0]["text"]))
    assert luhn(texts[1]) == luhn(rows[1]["text"])
    assert all(0 <= int(x) <= 255 for x in rows[3]["text"].split("."))
    datetime.date.fromisoformat(rows[4]["text"])
    datetime.datetime.strptime(rows[5]["text"], "%d/%m/%Y")
    datetime.datetime.strptime(rows[6]["text"], "%d.%m.%Y")
    assert rows[8]["text"].endswith(".com") and re.fullmatch("[0-9a-f]{40}", rows[9]["text"])


def test_links_and_keys(replaced):
    rows = replaced("card 4111 1111 1111 1111.", "4111-1111-1111-1111", "1984-02-29", "29/02/1984", "x@y.org and x@y.org")
    digits = [re.sub(r"\D", "", rows[i]["text"]) for i in (0, 1)]
    assert digits[0] == digits[1]
    assert rows[2]["text"].split("-") == rows[3]["text"].split("/")[::-1]
    first, last = rows[4]["text"].split(" and ")
    assert first == last
    assert replaced("4111-1111-1111-1111", key="other")[0]["text"] != rows[1]["text"]


@pytest.mark.parametrize("n", [2, 3])
def test_digit_strings_are_permuted(spark, n):
    got = spark.range(10 ** n).select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), n, "0"), "k").alias("d"))
    assert sorted(r["d"] for r in got.collect()) == [str(i).zfill(n) for i in range(10 ** n)]


def test_numbers_are_permuted(spark):
    got = spark.range(27 * 41).select(
        pseudonyms.permuted_number(F.col("id"), F.lit(27).cast("long"), F.lit(41).cast("long"), "k").alias("d"))
    assert sorted(r["d"] for r in got.collect()) == list(range(27 * 41))


def test_texts_are_permuted(spark):
    letters = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    df = spark.createDataFrame([(x,) for x in letters], "t string")
    assert sorted(r[0] for r in df.select(pseudonyms.permuted_text(F.col("t"), "k")).collect()) == letters


def test_clean_text_stays(replaced):
    clean = ["No numbers here.", "Version 2.0. and 3. of 4.0.", "in 1999 there were 12,000 of 345", "a@b", "99/99/2000", "", None,
             "300.1.2.3.4", "word1 word22"]
    rows = replaced(*clean)
    assert [rows[i]["text"] for i in range(len(clean))] == clean


def test_query_leaves_no_private_string(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    patterns = [r"[\w.]+@mail\d\.example\.com", r"\+1 \(\d{3}\) 555-\d{4}", r"\b\d{16}\b", r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
                r"\b[0-9a-f]{40}\b"]
    for r in queries.op2_pseudonyms(spark, folder).collect():
        before = docs[r["doc_id"]]
        private = {m for p in patterns for m in re.findall(p, before, re.I)}
        assert not any(m in r["text"] for m in private)
        if not private:
            assert r["text"] == before


def test_awkward_rows(spark):
    docs = frame(spark)
    kept = pseudonyms.replace_in(docs, KEY)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert pseudonyms.pseudonymise(frame(spark, []), KEY).count() == 0


def test_secrets_of_letters_only(spark):
    """A secret without digits is replaced in a text without digits, and alike in one with a digit."""
    secrets = ["sk-" + "abcdefghijKLMNOP", "pk_" + "q" * 20, "ghp_" + "abcdEFGH" * 3, "gho-" + "x" * 16, "xoxb-" + "lmnop" * 4,
               "AKIA" + "ABCDEFGHIJKLMNOP", "ASIA" + "QRSTUVWXYZABCDEF", "abcdef" * 6, "ABCDEF" * 6]
    rows = [(2 * k + d, f"key {s} here" + " 7" * d, "en", "a", 0) for k, s in enumerate(secrets) for d in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    for k, secret in enumerate(secrets):
        bare, digit = got[2 * k], got[2 * k + 1]
        assert bare["n_secret"] == digit["n_secret"] == 1 and secret not in bare["text"]
        assert bare["text"] + " 7" == digit["text"]


def test_spellings_of_a_value_stay_linked(replaced):
    """Case of an address and punctuation of a telephone number do not matter; format and capitals are kept."""
    texts = ["Ann.Lee@Mail.com", "ann.lee@mail.com", "ANN.LEE@MAIL.com", "+1 555-123-4567", "+15551234567", "555-123-4567",
             "+44 20 7946 0958", "+442079460958", "+44 20 7946 0959", "\u00c9va@x.org", "\u00e9va@x.org"]
    new = [r["text"] for _, r in sorted(replaced(*texts).items())]
    assert all(a != b for a, b in zip(new, texts, strict=True))
    assert new[0].lower() == new[1] == new[2].lower() and new[2] == new[1][:-3].upper() + "com"
    assert [c.isupper() for c in new[0]] == [c.isupper() for c in texts[0]]
    digits = ["".join(c for c in t if c.isdigit()) for t in new]
    assert digits[3] == digits[4] == "1" + digits[5] and new[3].startswith("+1 ") and new[4].startswith("+1")
    assert digits[6] == digits[7] != digits[8] and new[6].startswith("+44 ") and new[7].startswith("+44")
    assert new[9].lower() == new[10] and new[9][0].isupper()


def test_key_is_needed(spark):
    with pytest.raises(ValueError, match="key"):
        pseudonyms.pseudonymise(frame(spark, []), "")
