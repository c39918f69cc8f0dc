"""Quality rules against a plain Python version."""

import math
from collections import Counter, defaultdict

import pytest

from cases import awkward, frame, words
from shelfprice.llm import queries, quality_rules
from shelfprice.llm.common import table

RANGES = [
    lambda c: "a" <= c <= "z", lambda c: c in " \t\n\x0b\x0c\r", lambda c: c in "#*$%&|<>", lambda c: "0" <= c <= "9",
    lambda c: "A" <= c <= "Z", lambda c: c in ".,;:!?", lambda c: c in "'\"()[]{}-",
]


def base(text):
    tokens = words(text)
    grams = [tuple(tokens[i:i + 3]) for i in range(len(tokens) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    lines, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in lines
            lines.add(line)
    return (len(tokens), sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered))


def histograms(text, lang):
    classes = [0] * 8
    for c in text or "":
        classes[next((k for k, r in enumerate(RANGES) if r(c)), 7)] += 1
    if lang not in quality_rules.COMMON_WORDS:
        return classes, None
    listed = quality_rules.COMMON_WORDS[lang].split()[:quality_rules.N_WORDS]
    count = Counter(words(text))
    common = [count[w] for w in listed]
    return classes, [*common, len(words(text)) - sum(common)]


def distance(p, q):
    if not p or not q or not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def expected(rows):
    limits, out, sums = quality_rules.Limits(), [], defaultdict(lambda: [[0] * 8, None])
    for _, text, lang in rows:
        measures = base(text)
        failed = measures[0] < 50 or 100 * measures[4] > 50 * measures[0]
        classes, common = histograms(text, lang)
        out.append((measures, failed, classes, common))
        if not failed:
            total = sums[lang]
            total[0] = [a + b for a, b in zip(total[0], classes)]
            if common:
                total[1] = [a + b for a, b in zip(total[1] or [0] * len(common), common)]
    found = []
    for (doc_id, _, lang), (measures, failed, classes, common) in zip(rows, out):
        reference = sums[lang] if lang in sums else [None, None]
        far = (distance(classes, reference[0]) > limits.class_distance and measures[1] >= limits.class_least_chars) or (
            distance(common, reference[1]) > limits.word_distance and measures[0] >= limits.word_least_words)
        found.append((doc_id, *measures, failed, not failed and not far))
    return sorted(found, key=str)


def got(df):
    rows = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text", "lang").collect()]
    assert got(queries.op7_quality_rules(spark, folder)) == expected(rows)


def test_awkward_rows(spark):
    rows = [(i, t, lang) for i, t, lang, _, _ in awkward()]
    assert got(quality_rules.quality(frame(spark))) == expected(rows)


def test_filter_keeps_columns_and_good_rows(spark, folder):
    docs = frame(spark)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in docs.collect()}


def test_labels(spark, folder):
    """Hand labels: good documents that pass the base rules stay, most bad ones go."""
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    rows = queries.op7_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) == len(good)
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_empty(spark):
    assert quality_rules.quality(frame(spark, [])).count() == 0
    assert quality_rules.keep_good(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["a b c a b c", "x x x x", "a b a b a b c", "a b c d a b c e b c d"])
def test_repeated_words(spark, text):
    assert quality_rules.quality(frame(spark, [(1, text, "en", "a", 1)])).first()["n_repeat_words"] == base(text)[4]


def test_documents_stay_where_they_are(spark):
    plan = quality_rules.keep_good(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
