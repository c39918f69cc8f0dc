"""Language-model scores: base against brute force, the model's gradients, distribution and gain."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from cases import awkward, frame, words
from shelfprice.llm import gated_lm, lm_scoring, queries
from shelfprice.llm.common import table
from shelfprice.llm.gated_lm import Shape

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_base(rows, docs):
    token = lambda t: [*words((t or "").translate(UPPER)), "\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if not held(i) for w in token(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(token(t)), sum(w in counts for w in token(t)), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token(t)), 5)) for i, t in docs)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))
                 for r in rows)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-4)


def test_query(spark, folder):
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    rows = queries.op10_lm_scoring(spark, folder).collect()
    check_base(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # learns more than frequencies
    assert all(r["score"] < 0 for r in rows)


def test_rare_words_are_joined(spark, folder):
    """With a high share few words are sent to the tasks; the counts of the others come by the join."""
    docs = table(spark, folder, "documents")
    rows = lm_scoring.scores(docs, Shape.even(64, 8, 8), frequent=1e-3, rounds=1).collect()
    check_base(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    check_base(lm_scoring.scores(frame(spark), rounds=1).collect(), [(i, t) for i, t, *_ in awkward()])
    assert lm_scoring.scores(frame(spark, [])).count() == 0


def tiny(shape):
    rng = np.random.default_rng(0)
    weights = gated_lm.initial(np.array([9.0, 5, 4, 3, 2, 2, 1, 1]), 4.0, shape)
    return {k: (v + rng.normal(0, 0.2, v.shape) * (v > -20)).astype(np.float64) for k, v in weights.items()}


def test_distribution_adds_up_to_one():
    shape = Shape.even(8, 4, 5)
    weights, hidden = tiny(shape), np.random.default_rng(1).normal(size=(1, 5))
    log_p = [gated_lm.log_probabilities(weights, hidden, np.array([w]), shape)[0][0] for w in range(9)]
    assert np.exp(log_p).sum() == pytest.approx(1)


def test_gradients_by_differences():
    shape, rng = Shape.even(8, 4, 5), np.random.default_rng(2)
    weights = tiny(shape)
    inputs, fresh = rng.integers(0, 9, (4, 3)), rng.random((4, 3)) < 0.3
    targets = rng.integers(0, 9, (4, 3))
    start = np.zeros((3, 5))

    def loss(w):
        hidden, _, _ = gated_lm.states(w, inputs, fresh, start, keep=False)
        return -gated_lm.log_probabilities(w, hidden.reshape(-1, 5).astype(np.float64), targets.ravel(), shape)[0].sum()

    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    hidden, _, kept = gated_lm.states(weights, inputs, fresh, start, keep=True)
    _, slope = gated_lm.log_probabilities(weights, hidden.reshape(-1, 5).astype(np.float64), targets.ravel(), shape, grads)
    gated_lm._back(weights, inputs, fresh, kept, slope.reshape(4, 3, 5), grads)
    for name, value in weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
            up[name][at] += 1e-2
            down[name][at] -= 1e-2
            assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(grads[name][at], abs=2e-2, rel=2e-2)


def test_layout_does_not_change_scores():
    """The state is carried through a whole text, whatever lanes and windows it falls in."""
    shape, rng = Shape.even(8, 4, 5), np.random.default_rng(3)
    weights = {k: v.astype(np.float32) for k, v in tiny(shape).items()}
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 70, 3, 40, 2, 150)]
    got = []
    for lanes, steps in ((1, 7), (3, 32), (6, 1000)):
        inputs, targets, fresh, owner = gated_lm.laid_out(texts, lanes)
        got.append(gated_lm.score(weights, shape, inputs, targets, fresh, owner, len(texts), steps))
    assert np.allclose(got[0], got[1], rtol=1e-4) and np.allclose(got[0], got[2], rtol=1e-4)


def test_vocabulary_follows_the_counts(spark, monkeypatch):
    """Every frequent word has an input and an output of its own, however many there are."""
    rng, made = np.random.default_rng(6), []
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 3000, 900)), "en", "a", 0) for i in range(40)]
    train = lm_scoring.trained

    def spy(docs, vocabulary, rounds):
        made.append((vocabulary, train(docs, vocabulary, rounds)))
        return made[0][1]

    monkeypatch.setattr(lm_scoring, "trained", spy)
    got = lm_scoring.scores(frame(spark, rows), rounds=1).collect()
    check_base(got, [r[:2] for r in rows])
    (vocabulary, weights), = made
    twice = int((vocabulary.counts > 1).sum())
    assert twice > 2900 and vocabulary.shape.words >= twice and weights["input"].shape[0] > twice
    sizes = np.diff(vocabulary.shape.starts)
    assert len(weights["word"]) >= twice and sizes.min() > 0 and sizes.max() < 200 and vocabulary.shape.classes < 100


def test_update_of_touched_rows_is_that_of_all():
    """A window leaves the words and classes it does not have as they were, and no gradient behind."""
    shape, rng = Shape.even(32, 4, 5), np.random.default_rng(4)
    start = gated_lm.initial(np.arange(32.0, 0, -1), 4.0, shape)
    trainer = gated_lm.Trainer(start, shape)
    trainer.learn(*gated_lm.laid_out([rng.integers(0, 9, 30).astype(np.int32) for _ in range(4)], 2)[:3])
    assert np.array_equal(trainer.weights["input"][9:], start["input"][9:])
    assert np.array_equal(trainer.weights["word"][12:], start["word"][12:])
    assert not np.array_equal(trainer.weights["word"][:9], start["word"][:9])
    assert not np.array_equal(trainer.weights["input"][:9], start["input"][:9])
    assert not any(g.any() for g in trainer._grads.values())


def test_classes_hold_equal_shares_of_root_counts():
    """Frequent words lie in small classes; every word is in one class, in order."""
    counts = 1e6 / np.arange(1, 40_001)
    shape = Shape.following(counts)
    sizes = np.diff(shape.starts)
    assert shape.words == len(counts) == sizes.sum() and sizes.min() > 0
    assert np.array_equal(shape.class_of, np.append(np.repeat(np.arange(shape.classes), sizes), shape.classes))
    shares = np.add.reduceat(counts, shape.starts[:-1]) / counts.sum()
    assert shape.classes + (sizes * shares).sum() < 0.7 * 2 * np.sqrt(len(counts))
    for few in (np.array([5.0]), np.array([3.0, 2.0]), np.array([0.0])):
        assert Shape.following(few).words == len(few)


def test_large_weights_do_not_overflow():
    shape = Shape.even(8, 4, 5)
    weights, hidden = tiny(shape), np.random.default_rng(1).normal(size=(1, 5))
    for shift in (500.0, -500.0):
        moved = {k: v.copy() for k, v in weights.items()}
        moved["class"][:, -1] += shift
        moved["word"][:, -1] += shift
        for w in range(9):
            a, b = (gated_lm.log_probabilities(x, hidden, np.array([w]), shape)[0][0] for x in (weights, moved))
            assert a == pytest.approx(b, abs=1e-9)


def plain_score(w, shape, text):
    """Log-likelihood of one text, number by number."""
    h, state, total = shape.hidden, [0.0] * shape.hidden, 0.0
    logistic = lambda v: 1 / (1 + math.exp(-v))
    for before, word in zip([0, *text[:-1]], text, strict=True):
        x = [float(w["input"][before][i] + w["gate_bias"][i]) for i in range(3 * h)]
        r_in = [sum(state[j] * float(w["recur"][j][i]) for j in range(h)) for i in range(3 * h)]
        z = [logistic(x[i] + r_in[i]) for i in range(h)]
        r = [logistic(x[h + i] + r_in[h + i]) for i in range(h)]
        new = [math.tanh(x[2 * h + i] + r[i] * r_in[2 * h + i]) for i in range(h)]
        state = [z[i] * state[i] + (1 - z[i]) * new[i] for i in range(h)]

        def share(rows, at, state=state):
            logits = [sum(a * float(b) for a, b in zip(state, row[:-1], strict=True)) + float(row[-1]) for row in rows]
            return logits[at] - math.log(sum(math.exp(v) for v in logits))

        k = next((k for k in range(shape.classes) if word < shape.starts[k + 1]), shape.classes)
        total += share(w["class"], k)
        if k < shape.classes:
            total += share(w["word"][shape.starts[k]:shape.starts[k + 1]], word - shape.starts[k])
    return total


def test_scores_against_plain_arithmetic():
    shape, rng = Shape((0, 1, 3, 8), 5), np.random.default_rng(8)
    weights = tiny(shape)
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 40, 3, 17, 65)]
    got = gated_lm.score(weights, shape, *gated_lm.laid_out(texts, 3), len(texts))
    assert got == pytest.approx([plain_score(weights, shape, t.tolist()) for t in texts], rel=1e-4)


def test_updates_work_in_place():
    """An update of all words is plain Adam, and takes a part of the weights' memory, not copies of them."""
    shape, rng = Shape.even(40_000, 200), np.random.default_rng(9)
    start = gated_lm.initial(np.arange(40_000.0, 0, -1), 4.0, shape)
    trainer = gated_lm.Trainer(start, shape)
    mean = square = np.zeros_like(start["word"])
    want, n = start["word"], 500
    for k in (1, 2):
        g = rng.normal(0, 1, want.shape).astype(np.float32)
        trainer._grads["word"][:] = g
        trainer._classes[:], trainer._gathered = True, n
        tracemalloc.start()
        trainer._update_words()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < want.nbytes / 4
        g = g * np.float32(min(1.0, n / np.sqrt(float(np.vdot(g, g)))) / n)
        mean, square = mean + np.float32(0.1) * (g - mean), square + np.float32(0.01) * (g * g - square)
        rate = np.float32(0.01 * np.sqrt(1 - 0.99 ** k) / (1 - 0.9 ** k))
        want = want - rate * mean / (np.sqrt(square) + np.float32(1e-6))
        assert np.allclose(trainer.weights["word"], want, rtol=1e-5, atol=1e-7)
        assert not trainer._grads["word"].any()


def test_words_seen_once_and_often_get_their_gradients():
    """Rows of the input are summed over all places of a word, in whatever mix of single and repeated words."""
    shape, rng = Shape.even(8, 4, 5), np.random.default_rng(10)
    weights = tiny(shape)
    for inputs in ([[1, 2], [3, 4]], [[1, 1], [1, 1]], [[5, 1], [5, 0]]):
        x, fresh = np.array(inputs), np.zeros((2, 2), bool)
        _, _, kept = gated_lm.states(weights, x, fresh, np.zeros((2, 5)), keep=True)
        grads = {k: np.zeros_like(v) for k, v in weights.items()}
        gated_lm._back(weights, x, fresh, kept, rng.normal(size=(2, 2, 5)), grads)
        assert np.allclose(grads["input"].sum(axis=0), grads["gate_bias"])
        assert set(np.flatnonzero(grads["input"].any(axis=1))) == set(x.ravel())
