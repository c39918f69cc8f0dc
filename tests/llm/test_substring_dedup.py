"""Substring dedup against a plain version that remembers every window."""

import hashlib
import random

from cases import awkward, frame, prose, words
from shelfprice.llm import queries, substring_dedup
from shelfprice.llm.common import table


def expected(docs):
    """Rows in order of id: removed words are those of windows seen at an earlier place."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k:k + 20])
            if window in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_query(spark, folder):
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert got(queries.op6_substring_dedup(spark, folder)) == expected(docs)


def test_shared_passages_and_rims(spark):
    rng, rows = random.Random(5), []
    passage, other = prose(45, 50), prose(60, 51)
    for i in range(120):
        own = prose(rng.randint(0, 60), 1000 + i)
        middle = passage if i % 2 else other[rng.randint(0, 20):rng.randint(35, 60)]
        rows.append((i, " ".join([*own, *middle, *prose(rng.randint(0, 30), 3000 + i)]), "en", "a", 0))
    rows.append((500, " ".join(["same"] * 100), "en", "a", 0))
    rows.append((501, " ".join(prose(30, 7) * 4), "en", "a", 0))
    assert got(substring_dedup.removed(frame(spark, rows))) == expected([r[:2] for r in rows])


def test_hot_runs_change_nothing(spark):
    rows = [(i, " ".join([*prose(15, i), *prose(40, 99), *prose(15, 500 + i)]), "en", "a", 0) for i in range(300)]
    df = frame(spark, rows)
    hot = substring_dedup.hot_runs(df)
    assert len(hot) >= 30
    assert got(substring_dedup.removed(df)) == expected([r[:2] for r in rows])


def test_awkward_rows(spark):
    docs = [(i, t) for i, t, *_ in awkward() if i is not None and i not in (6, 10)]
    rows = [r for r in awkward() if r[0] is not None and r[0] not in (6, 10)]
    assert got(substring_dedup.removed(frame(spark, rows))) == expected(docs)
    every = got(substring_dedup.removed(frame(spark)))
    assert len(every) == len(awkward())
    twice = [r for r in every if r[0] == 10]
    assert twice[0] == twice[1] and twice[0][2] == 120
    assert substring_dedup.removed(frame(spark, [])).count() == 0


def test_kept_text_is_returned(spark):
    text = " ".join(prose(25, 1))
    rows = substring_dedup.removed(frame(spark, [(1, text, "en", "a", 0), (2, "x " + text + " y", "en", "a", 0)])).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in rows) == [(1, text), (2, "x y")]


def test_automaton():
    rng = random.Random(2)
    for _ in range(200):
        automaton, texts = substring_dedup.SuffixAutomaton(), []
        for _ in range(3):
            query = [rng.randint(0, 2) for _ in range(rng.randint(1, 12))]
            known = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a, len(t) + 1)}
            want = [max(n for n in range(j + 2) if n == 0 or tuple(query[j + 1 - n:j + 1]) in known) for j in range(len(query))]
            assert automaton.matches(query) == want
            texts.append([rng.randint(0, 2) for _ in range(rng.randint(1, 12))])
            automaton.add(texts[-1])


def test_texts_without_id_whose_hashes_begin_alike(spark):
    """Rows of one id are told apart by more than the first 24 bits of the hash of their text."""
    import xxhash

    passage, seen, n = " ".join(prose(60, 11)), {}, 0
    other = " ".join(prose(25, 12))

    def begin(text):
        return xxhash.xxh3_64_intdigest(text.encode(), seed=1) >> 40

    for k in range(20_000):
        seen.setdefault(begin(f"{passage} a{k}"), f"{passage} a{k}")
    while begin(f"{other} b{n}") not in seen:
        n += 1
    long, short = seen[begin(f"{other} b{n}")], f"{other} b{n}"
    rows = [(1, passage, "en", "a", 0), (None, long, "en", "a", 0), (None, short, "en", "a", 0)]
    want = expected([r[:2] for r in rows])
    assert got(substring_dedup.removed(frame(spark, rows))) == want
    assert [r[1:3] for r in want] == [(60, 0), (26, 0), (61, 60)]
