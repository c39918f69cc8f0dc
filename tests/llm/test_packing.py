"""Packing: pieces, checksums, sequences, and the linear program."""

import random
import zlib

import numpy as np
import pytest

from cases import awkward, frame
from shelfprice.llm import packing, queries
from shelfprice.llm.common import table

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, docs, reference, most_padding):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id in {i for i, _ in docs}:
        texts = [t for i, t in docs if i == doc_id]
        own = sorted(by[doc_id], key=lambda r: (r["start"], r["length"], r["ids_crc32"]))
        pieces = sorted((k, min(2048, len(ids) - k), zlib.crc32(ids[k:k + 2048].tobytes()), len(ids))
                        for ids in map(reference, texts) for k in range(0, len(ids), 2048))
        assert [(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own] == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(r["length"] for r in rows)
    assert len(sequences) * 2048 - used <= most_padding * used + 2048


def test_query(spark, folder, reference):
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    check(queries.op9_packing(spark, folder).collect(), docs, reference, 0.02)


def test_awkward_rows(spark, reference):
    rows = packing.pack(frame(spark), PATH).collect()
    check(rows, [(i, t) for i, t, *_ in awkward()], reference, 1.0)
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_words_apart_are_words_together(reference):
    own, rng = packing.WordTokenizer(PATH), random.Random(3)
    letters = "aZ\u00e9\u00df\u0130\u03a3'_-.,!<|>0\u0663\u00bd \t\n\x0b\x1c\x85\u00a0\u3000\u0301\U0001F600"
    texts = ["".join(rng.choices(letters, k=40)) for _ in range(400)]
    for text in [*texts, "it's I'LL 'll", "a<|endoftext|>b <|startoftext|>"]:
        assert own.encode(text) == reference(text)[:-1].tobytes(), repr(text)


def test_forgetting_changes_nothing():
    made = []
    kept = packing.Remembered(lambda k: made.append(k) or k * 2, 3)
    assert [kept[k] for k in [1, 2, 3, 1, 4, 1, 5, 6, 7, 1]] == [2, 4, 6, 2, 8, 2, 10, 12, 14, 2]
    assert len(kept) <= 3 and made.count(1) <= 2


def test_workers_keep_no_words_after_a_task(spark, folder):
    import pyarrow as pa

    def kept(batches):
        for batch in batches:
            every = [len(c) + len(c._older) for t in packing._TOKENIZERS.values() for c in (t._words, t._parts)]
            yield pa.RecordBatch.from_arrays([pa.array([len(every)]), pa.array([sum(every)])], ["caches", "words"])

    packing.pack(table(spark, folder, "documents"), PATH).collect()
    rows = spark.range(0, 400, 1, 4).mapInArrow(kept, "caches long, words long").collect()
    assert sum(r["caches"] for r in rows) and not sum(r["words"] for r in rows)


def test_column_generation_meets_the_bound():
    widths, demand = np.array([3, 5, 7]), np.array([30.0, 20.0, 10.0])
    patterns, multiples = packing.column_generation(widths, demand, 10)
    assert np.allclose(patterns @ multiples, demand)
    assert (widths @ patterns <= 10).all()
    assert multiples.sum() == pytest.approx(80 / 3, abs=0.01)  # 10 of 7+3, 10 of 5+5, 20/3 of 3+3+3
    plan = packing.rounded(widths, demand, patterns, multiples, 10)
    assert sum(t * p for p, t in plan).tolist() == demand.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_plans_take_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    widths = np.sort(rng.choice(np.arange(1, 257), 60, replace=False))
    demand = rng.integers(1, 400, 60).astype(float)
    patterns, multiples = packing.column_generation(widths, demand, 256)
    plan = packing.rounded(widths, demand, patterns, multiples, 256)
    assert sum(t * p for p, t in plan).tolist() == demand.tolist()
    assert all((p * widths).sum() <= 256 for p, _ in plan)
    assert multiples.sum() >= (widths * demand).sum() / 256 - 1e-6
    assert sum(t for _, t in plan) <= multiples.sum() + 30  # what rounding 60 patterns can cost
    for width, starts, firsts, counts in packing.slots(widths, plan):
        assert starts == sorted(starts) and len(starts) == len(firsts) == len(counts)
