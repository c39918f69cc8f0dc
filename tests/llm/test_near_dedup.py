"""Near duplicates against all pairs of a small corpus, and planted copies."""

import itertools
from collections import Counter, defaultdict

from cases import awkward, frame, prose, words
from shelfprice.llm import near_dedup, queries
from shelfprice.llm.common import table


def shingles(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def all_pairs(docs):
    """Plain Jaccard similarity of every pair of texts that share a shingle."""
    first = {}
    for i, t in docs:
        first.setdefault(t, i)
    sets = {i: shingles(t) for t, i in first.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter(p for ids in where.values() for p in itertools.combinations(sorted(ids), 2))
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in common.items()}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    rows = {r["doc_id"]: r for r in queries.op1_near_dedup(spark, folder).collect()}
    assert len(rows) == len(docs)
    classes = defaultdict(set)
    for r in rows.values():
        classes[r["class_id"]].add(r["doc_id"])
    assert all(k == min(v) for k, v in classes.items())
    texts = dict(docs)
    copies = defaultdict(set)
    for i, t in docs:
        copies[t].add(rows[i]["class_id"])
    assert all(len(x) == 1 for x in copies.values())
    similar = all_pairs(docs)
    for (a, b), j in similar.items():
        if j >= 0.8:
            assert rows[a]["class_id"] == rows[b]["class_id"]
    for members in classes.values():  # every class hangs together by links that are nearly similar enough
        distinct = {texts[i]: i for i in sorted(members, reverse=True)}
        todo, seen = [min(members)], set()
        while todo:
            a = todo.pop()
            seen.add(a)
            todo += [b for b in distinct.values() if b not in seen and similar.get((min(a, b), max(a, b)), 0) >= 0.7]
        assert set(distinct.values()) <= seen


def planted(n_copies=40):
    base = prose(200, 9)
    rows = [(0, " ".join(base), "en", "a", 0)]
    for k in range(1, n_copies):  # each differs from the base in one place
        own = list(base)
        own[(k * 5) % 200] = f"changed{k}"
        rows.append((k, " ".join(own), "en", "a", 0))
    rows += [(1000 + k, " ".join(prose(150, 100 + k)), "en", "b", 0) for k in range(30)]
    chain = prose(200, 77)
    for k in range(4):  # each is near the one before, the ends are not near each other
        rows.append((2000 + k, " ".join(chain), "en", "c", 0))
        for j in range(4):
            chain[(50 * k + 11 * j) % 200] = f"step{k}x{j}"
    return rows


def test_planted_groups(spark):
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, planted())).collect()}
    assert {rows[k]["class_id"] for k in range(40)} == {0}
    assert all(rows[1000 + k]["class_id"] == 1000 + k and rows[1000 + k]["n_links"] == 0 for k in range(30))
    assert {rows[2000 + k]["class_id"] for k in range(4)} == {2000}
    assert rows[0]["n_in_class"] == 40


def test_one_of_each(spark):
    docs = frame(spark, planted())
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(1000, 1030), 2000]


def test_awkward_rows(spark):
    rows = near_dedup.near_duplicates(frame(spark)).collect()
    assert len(rows) == len(awkward())
    by = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert by[1] == by[2] == by[10] == 1 and by[3] == by[4] == 3
    kept = [tuple(r) for r in near_dedup.one_of_each(frame(spark)).select("doc_id", "text").collect()]
    assert len(kept) == len({r["class_id"] for r in rows}) + sum(r["class_id"] is None for r in rows) - (
        1 if any(r["class_id"] is None for r in rows) else 0)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.one_of_each(frame(spark, [])).count() == 0


def test_sampling_agrees_with_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    sampler, idf = near_dedup.Sampler(), np.ones(1 << near_dedup.COUNTER_BITS)
    for share in (0.9, 0.6, 0.3):
        same = []
        for _ in range(60):
            a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            b = np.concatenate([a[:int(400 * share)], rng.integers(0, 1 << 63, 400 - int(400 * share), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            wa, wb = 1 + (a % np.uint64(3)).astype(float), 1 + (b % np.uint64(3)).astype(float)
            same.append((sampler.draw(a, wa) == sampler.draw(b, wb)).mean()
                        - near_dedup.weighted_jaccard((a, wa), (b, wb)))
        assert abs(np.mean(same)) < 0.04
    assert len(idf)


def common_passage(n_apart=120, n_close=60):
    """Texts that share half of their words and are not alike, and near copies of one of them, a tenth of them by chains."""
    passage = prose(100, 5)
    rows = [(k, " ".join(passage + prose(100, 500 + k)), "en", "a", 0) for k in range(n_apart)]
    base = passage + prose(100, 500)
    for k in range(n_close):  # near copies of document 0
        own = list(base)
        own[(k * 3) % 200] = f"close{k}"
        rows.append((5000 + k, " ".join(own), "en", "a", 0))
    for k in range(12):  # two texts that are near each other only, in the same hot bands
        pair = passage + prose(100, 9000 + k)
        rows.append((7000 + 2 * k, " ".join(pair), "en", "a", 0))
        pair[150] = f"other{k}"
        rows.append((7001 + 2 * k, " ".join(pair), "en", "a", 0))
    return rows


def test_common_passage(spark):
    rows = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, common_passage())).collect()}
    assert {rows[5000 + k] for k in range(60)} == {0}
    assert all(rows[7000 + 2 * k] == rows[7001 + 2 * k] == 7000 + 2 * k for k in range(12))
    assert all(rows[k] == k for k in range(120))


def test_comparisons_grow_with_the_texts(spark):
    """Texts with one common passage: late pairs per text do not grow with their number."""
    from pyspark.sql import functions as F

    def late(n):
        docs = frame(spark, common_passage(n, 0))
        idf = near_dedup.inverse_frequencies(*near_dedup.document_frequencies(docs))
        nodes = near_dedup.sketches(docs, idf).select("key", "samples")
        bands = nodes.select("key", F.col("key").alias("root"), F.posexplode(near_dedup._bands(F.col("samples"))).alias("k", "group"))
        rows = bands.select("group", "key", "root", F.pow(F.lit(2), F.col("k")).cast("int").alias("mask"))
        return near_dedup._late_pairs(rows, nodes).count() / n

    assert late(600) < 2 * late(150) + 2


def test_crowded_band_loses_no_pair(spark, monkeypatch):
    """Texts that agree in one band only, with many others that share a passage."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_dedup, "_bands", lambda samples: F.array(
        F.lit(0).cast("long"), *[F.xxhash64(F.lit(k), samples) for k in range(1, near_dedup.BANDS)]))
    docs = common_passage(60, 20)
    rows = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert {rows[5000 + k] for k in range(20)} == {0}
    assert all(rows[7000 + 2 * k] == rows[7001 + 2 * k] == 7000 + 2 * k for k in range(12))
    assert all(rows[k] == k for k in range(60))
