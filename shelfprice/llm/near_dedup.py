"""Near duplicates by improved consistent weighted sampling of TF-IDF shingles.

A text is its 5-word shingles, each weighted by the logarithm of its count (plus 1) times an
inverse document frequency. Consistent weighted sampling draws, for each of 36 samples, one shingle and a
quantised weight such that two texts draw the same with the probability of their weighted
Jaccard similarity. Samples are grouped in 12 bands of 3; texts that agree in a band are
candidates, and a pair is linked if the weighted Jaccard similarity of its whole texts is
at least the threshold. Classes are the connected components of the links.

How it scales:

* Document frequencies are counted over all texts in a table of fixed size (shingles share
  2^17 counters), which is what every task gets. The more different shingles share a counter,
  the less their weights differ: in a very large corpus all weigh nearly the same.
* Equal texts are one node from the start: their copies are combined map-side.
* In a band, texts are compared with the band's first text, not with each other. What neither that
  nor another band puts in one class is compared further: texts that are not of the least class of
  their band with all of the band that is not of their own. Only pairs that agree in at
  least half of their samples are read as texts.
* The texts of bands with more than ``STRAYS`` texts outside their least class are not paired off: they share a
  passage, or are much alike without being near. They are paired by the shingles that can be the first they share, rare
  ones first: near texts share at least the threshold of their weight, so such a shingle lies in the first
  0.22 of the weight of both. This is exact for all these texts, whichever bands they agree in.
* Components come from large-star and small-star rounds, which are joins and minima over
  the links; nothing is collected but counts.

Defined results: a null text is an empty text; texts without words are alike only if equal;
shorter texts are one shingle of all their words; the class is named by its smallest
``doc_id`` (nulls last); repeated rows are in one class; other columns are kept by
``one_of_each``, which keeps one row of every class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.llm.common import packed
from shelfprice.llm.shingles import mixed, windows, word_hashes
from shelfprice.operators.staging import stage

SHINGLE_WORDS = 5
#: Weights lie between LEAST_IDF and 1 (times the damped count), so a pair of texts that share 0.8 of
#: their shingles, each as often in both, has a weighted similarity of at least 0.8 * 0.9 / (0.8 * 0.9 + 0.2) = 0.783.
THRESHOLD = 0.78
BANDS, BAND_ROWS = 12, 3
SAMPLES = BANDS * BAND_ROWS
COUNTER_BITS = 17
LEAST_IDF = 0.9
#: Pairs that agree in a smaller share of their samples are not read as texts.
LEAST_AGREEMENT = 0.5
#: The texts of bands with more texts outside their least class are paired by their rare shingles.
STRAYS = 8
#: Texts of a rare shingle with which the others are compared first, before those of different classes are paired off.
HUBS = 8
#: Sums of weights are compared with this much room for rounding.
SLACK = 1e-6
_TABLE_BITS = 16
_BLOCK = 2048


def text_key(text: Column) -> Column:
    """128-bit key of equal texts."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def weighted_shingles(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and their weights."""
    found, counts = np.unique(windows(hashes, SHINGLE_WORDS), return_counts=True)
    return found, (1 + np.log(counts)) * idf[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every > 0 else 0.0


class Sampler:
    """Improved consistent weighted sampling with random numbers from tables.

    For each shingle and sample a hash picks a row of a table of r, ln c (gamma variates of
    shape 2) and beta (uniform); the shingle with the least ln a = ln c - r (t - beta + 1),
    t = floor(ln w / r + beta), is drawn together with its t.
    """

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        size = 1 << _TABLE_BITS
        self._r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self._log_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self._beta = rng.random(size).astype(np.float32)
        self._odd = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 32-bit number per sample; of no shingles, zeros."""
        best = np.full(SAMPLES, np.inf, np.float32)
        drawn, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
        log_w = np.log(weights).astype(np.float32)
        for k in range(0, len(shingles), _BLOCK):
            part = shingles[k:k + _BLOCK]
            row = ((part[:, None] * self._odd[None, :]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int32)
            r, beta = self._r[row], self._beta[row]
            t = np.floor(log_w[k:k + _BLOCK, None] / r + beta)
            log_a = self._log_c[row] - r * (t - beta + np.float32(1))
            at = log_a.argmin(axis=0)
            low = log_a[at, np.arange(SAMPLES)]
            better = low < best
            best[better] = low[better]
            drawn[better] = part[at[better]]
            level[better] = t[at[better], np.flatnonzero(better)].astype(np.int64)
        if not len(shingles):
            return np.zeros(SAMPLES, np.uint32)
        return (mixed(drawn + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield (text.as_py() or "").encode("utf-8", "surrogatepass")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which a shingle of each counter occurs, and the number of documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << COUNTER_BITS, np.int64), 0
        for batch in batches:
            for raw in _texts(batch.column(0)):
                found = windows(word_hashes(raw), SHINGLE_WORDS) >> np.uint64(64 - COUNTER_BITS)
                total[found.astype(np.int64)] += 1  # adds once for every different counter
                n += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(total[used], n), pa.int64())],
            ["counter", "n"])

    rows = docs.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    found = np.array([(r["counter"], r["n"]) for r in rows.collect()], dtype=np.int64).reshape(-1, 2)  # 2^17 at most
    frequencies = np.zeros(1 << COUNTER_BITS, np.int64)
    real = found[:, 0] >= 0
    frequencies[found[real, 0]] = found[real, 1]
    return frequencies, int(found[~real, 1].sum())


def inverse_frequencies(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Weight per counter: 1 for the usual counter, less for those of frequent shingles, ``LEAST_IDF`` at least."""
    usual = max(1.0, float(np.median(frequencies)))
    idf = np.log((n + 2) / (frequencies + 1)) / np.log((n + 2) / (usual + 1)) if n + 2 > usual + 1 else np.ones(len(frequencies))
    return np.clip(idf, LEAST_IDF, 1.0).astype(np.float64)


def frequency_ranks(frequencies: np.ndarray) -> np.ndarray:
    """Rank per counter, by which shingles are put in order: how often its number of documents can be halved."""
    return np.log2(np.maximum(frequencies, 1)).astype(np.int64)


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``doc_id``, key of the text and its samples as 4-byte numbers, one row per document."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weights = Sampler(), table.value
        for batch in batches:
            keys, samples = [], []
            for raw in _texts(batch.column(1)):
                keys.append(hashlib.md5(raw, usedforsecurity=False).digest())
                samples.append(sampler.draw(*weighted_shingles(word_hashes(raw), weights)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(samples, pa.binary())],
                ["doc_id", "key", "samples"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        draw, "doc_id long, key binary, samples binary")


def _agreement(a: Column, b: Column) -> Column:
    same = F.lit(0)
    for k in range(SAMPLES):
        same = same + (F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int")
    return same / SAMPLES


def _bands(samples: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(k), F.substring(samples, 4 * BAND_ROWS * k + 1, 4 * BAND_ROWS))
                     for k in range(BANDS)])


def _promising() -> Column:
    """Whether the samples of a pair of rows agree often enough for its texts to be read."""
    return _agreement(F.col("a_samples"), F.col("b_samples")) >= LEAST_AGREEMENT


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Pairs ``a``, ``b`` with a weighted Jaccard similarity of their whole texts of at least the threshold."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = table.value
        last: tuple[bytes, tuple] | None = None
        for batch in batches:
            a, b, kept, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for i, (text_a, text_b) in enumerate(zip(_texts(batch.column(2)), _texts(batch.column(3)), strict=True)):
                if last is None or last[0] != a[i]:
                    last = a[i], weighted_shingles(word_hashes(text_a), weights)
                other = weighted_shingles(word_hashes(text_b), weights)
                similarity = weighted_jaccard(last[1], other)
                if similarity >= threshold:
                    kept.append(i)
                    found.append(similarity)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in kept], pa.binary()), pa.array([b[i] for i in kept], pa.binary()),
                 pa.array(found, pa.float64())], ["a", "b", "similarity"])

    def text(name: str) -> DataFrame:
        return texts.select(F.col("key").alias(name), F.col("text").alias(f"text_{name}"))

    both = pairs.join(text("b"), "b").join(text("a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """``key`` and ``root`` (the least key) of every node of a graph of links ``a``, ``b``."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # large star: neighbours above a node point to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: lower neighbours of a node, and itself, point to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == now:
            break
        state = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("key"), "root").unionByName(
        edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())


def _rooted(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """``rows`` with the root of node ``name``, which is the node itself if it has no link."""
    return rows.join(roots.select(F.col("key").alias(name), F.col("root").alias("r_")), name, "left").withColumn(
        f"{name}_root", F.coalesce("r_", name)).drop("r_")


def _across(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Promising pairs ``a``, ``b`` of different roots within groups of ``rows`` (``group``, ``key``, ``root``)."""
    sampled = stage(rows.join(nodes.select("key", "samples"), "key"))
    a = sampled.where("root <> low").select("group", F.col("key").alias("a"), F.col("root").alias("ra"),
                                            F.col("samples").alias("a_samples"))
    b = sampled.select("group", F.col("key").alias("b"), F.col("root").alias("rb"), F.col("samples").alias("b_samples"))
    return _in_order(a.join(b, "group").where("ra <> rb").where(_promising()))


def _live(banded: DataFrame) -> DataFrame:
    """Rows of groups with more than one root, with the group's least root and the number of rows outside it."""
    sizes = banded.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low <> high").drop("high")
    live = stage(banded.join(sizes, "group"))
    strays = live.where("root <> low").groupBy("group").agg(F.count(F.lit(1)).alias("strays"))
    return stage(live.join(strays, "group"))


def _late_pairs(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different roots to be verified after the stars, from bands with few strays; ``_rare_links`` has the rest."""
    if "strays" not in live.columns:
        live = _live(live)
    return _across(live.where(F.col("strays") <= STRAYS), nodes)


def _first_shingles(texts: DataFrame, idf: np.ndarray, ranks: np.ndarray, threshold: float) -> DataFrame:
    """Of texts with a number ``no``, the shingles that can be the first that two near texts share.

    Shingles are in one order for all texts: by the rank of their counter, then by the number of texts that have
    them, rare ones first. Near texts share at least ``threshold`` of the weight of each, so the first
    shingle they share has no more than the rest of either text's weight before it. ``rest`` is the weight from a shingle on.
    """
    table = texts.sparkSession.sparkContext.broadcast((idf, ranks))

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rank_of = table.value
        for batch in batches:
            for no, raw in zip(batch.column(0), _texts(batch.column(1)), strict=True):
                found, weight = weighted_shingles(word_hashes(raw), weights)
                rank, total = rank_of[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], weight.sum()
                # ranks are the same for all texts, so what lies behind this much weight can be left out
                by_rank = np.cumsum(np.bincount(rank, weights=weight))
                kept = np.flatnonzero(rank <= np.searchsorted(by_rank, (1 - threshold) * total * (1 + SLACK)))
                n = len(kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no.as_py()] * n, pa.int64()), pa.array(np.full(n, total)), pa.array(rank[kept].astype(np.int32)),
                     pa.array(found[kept].view(np.int64)), pa.array(weight[kept])], ["no", "total", "rank", "shingle", "weight"])

    rows = texts.select("no", "text").mapInArrow(early, "no long, total double, rank int, shingle long, weight double")
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shingle")))
    before = Window.partitionBy("no").orderBy("rank", "n", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("rest", F.col("total") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).where(
        (F.col("n") > 1) & (F.col("rest") >= F.col("total") * (threshold * (1 - SLACK))))
    return placed.select("no", "total", "shingle", "rest")


def _rare_pairs(rows: DataFrame, threshold: float, hubs: int | None) -> DataFrame:
    """Pairs ``a``, ``b`` of different roots that can have one of the shingles of ``rows`` as the first they share.

    With ``hubs`` only those of the texts of a shingle with so many of them: those with the least of their own before it,
    which are nearest to the others.
    """
    low = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").drop("high")
    live = rows.join(low, "shingle")
    if hubs is not None:
        nearest = Window.partitionBy("shingle").orderBy(F.desc(F.col("rest") / F.col("total")), "key")
        live = live.withColumn("turn", F.row_number().over(nearest))
    live = stage(live)

    def side(name: str, kept: str) -> DataFrame:
        return live.where(kept).select("shingle", F.col("key").alias(name), F.col("root").alias(f"r{name}"), *[
            F.col(c).alias(f"{c}_{name}") for c in ("total", "rest")])

    both = side("a", "root <> low" if hubs is None else f"turn <= {hubs}").join(side("b", "true"), "shingle").where("ra <> rb")
    shared = threshold / (1 + threshold) * (1 - SLACK)
    return _in_order(both.where(F.least("rest_a", "rest_b") >= (F.col("total_a") + F.col("total_b")) * shared))


def _rare_links(keys: DataFrame, texts: DataFrame, idf: np.ndarray, ranks: np.ndarray, threshold: float,
                tried: DataFrame) -> DataFrame:
    """Links among the texts ``keys`` (``key``, ``root``) that put all near ones in one class; ``tried`` pairs are left out.

    The texts of a shingle are compared with ``HUBS`` of them first; those that are then still in different classes are
    paired off.
    """
    hot = stage(keys.withColumn("no", F.monotonically_increasing_id()))
    rows = stage(_first_shingles(hot.join(texts, "key"), idf, ranks, threshold).join(hot, "no").select(
        "shingle", "key", "root", "total", "rest"))
    tried, links = _in_order(tried), None
    for hubs in (HUBS, None):
        pairs = stage(_rare_pairs(rows, threshold, hubs).join(tried, ["a", "b"], "left_anti"))
        found = stage(verified(pairs, texts, idf, threshold))
        links = found if links is None else links.unionByName(found)
        if hubs is not None:
            tried = tried.unionByName(pairs)
            of = rows.select("key", "root").distinct()
            joined = found.join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b").select(
                F.col("ra").alias("a"), F.col("rb").alias("b"))
            rows = stage(_rooted(rows, components(joined), "root").drop("root").withColumnRenamed("root_root", "root"))
    return links


def node_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``doc_id``, ``key``), nodes (``key``, ``id``, ``copies``, ``class``) and the verified links."""
    frequencies, n = document_frequencies(docs)
    idf, ranks = inverse_frequencies(frequencies, n), frequency_ranks(frequencies)
    rows = stage(sketches(docs, idf))
    nodes = stage(rows.groupBy("key").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("samples").alias("samples")))
    empty = F.lit(bytes(4 * SAMPLES))
    every = nodes.where(F.col("samples") != empty).select(
        "key", "samples", F.explode(_bands(F.col("samples"))).alias("group"))
    first = every.groupBy("group").agg(
        F.min(F.struct("key", "samples")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    banded = stage(every.join(first.select("group"), "group").select("group", "key"))
    candidates = stage(every.join(first, "group").where("key <> first.key").select(
        F.col("first.key").alias("a"), F.col("key").alias("b"),
        F.col("first.samples").alias("a_samples"), F.col("samples").alias("b_samples")).where(
        _promising()).select("a", "b").distinct())
    shared = banded.select("key").distinct().join(nodes.select("key", "id"), "key")
    texts = stage(
        docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("id"), "text")
        .join(shared.select("key", F.col("id").alias("own")), "key").where(F.col("id").eqNullSafe(F.col("own")))
        .select("key", "text").dropDuplicates(["key"]))
    links = stage(verified(candidates, texts, idf, threshold))
    roots = stage(components(links))
    live = _live(_rooted(banded, roots, "key").withColumnRenamed("key_root", "root"))
    late = _late_pairs(live, nodes).join(_in_order(candidates), ["a", "b"], "left_anti")
    crowded = live.where(F.col("strays") > STRAYS).select("key", "root").distinct()
    late = stage(verified(late, texts, idf, threshold).unionByName(_rare_links(crowded, texts, idf, ranks, threshold, candidates)))
    links = links.unionByName(late)
    roots = stage(components(links))
    return rows, _rooted(nodes.select("key", "id", "copies"), roots, "key"), links


def _classes(nodes: DataFrame) -> DataFrame:
    """Per class: its root, the node and id that stand for it, and its number of documents."""
    return nodes.groupBy("key_root").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("m"),
        F.sum("copies").alias("n_in_class")).select(
        F.col("key_root").alias("root"), F.col("m.id").alias("class_id"), F.col("m.key").alias("class_key"), "n_in_class")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``class_id``, size of the class, and ``n_links``, for every document.

    ``n_links`` counts the links of the text that the search verified: enough to connect the class, not all there are.
    """
    rows, nodes, links = node_classes(docs, threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(_classes(nodes), F.col("key_root") == F.col("root")).join(
        degree, F.col("key") == F.col("of"), "left")
    return rows.select("doc_id", "key").join(
        named.select("key", "class_id", "n_in_class", F.coalesce("n_links", F.lit(0)).alias("n_links")), "key").select(
        "doc_id", "class_id", "n_in_class", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest ``doc_id``; all columns are kept."""
    _, nodes, _ = node_classes(docs, threshold)
    kept = _classes(nodes).select(F.col("class_key").alias("key_"), F.col("class_id").alias("id_"))
    rows = packed(docs, key_=text_key(F.col("text")), doc_=F.col("doc_id").cast("long"))
    chosen = rows.join(kept, "key_").where(F.col("doc_").eqNullSafe(F.col("id_")))
    turn = Window.partitionBy("key_").orderBy("doc_")
    return chosen.withColumn("turn_", F.row_number().over(turn)).where("turn_ = 1").select("row_.*")
