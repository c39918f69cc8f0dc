"""Boosted regression trees: the trees that Spark ML grows, from arrays of bins instead of objects.

Spark ML leads every row down the tree anew for each level of each tree, as an object of its own. Here the bins of
a feature are bytes of an array, and numpy adds up what a level needs. Candidate splits, samples of rows and
of features, sums, gains and pruning are those of Spark ML (Spark's own code finds the candidates), drawn from the
same seeds; the result is its model, to the last bit where the rows are one partition. With more, sums of
partitions are added in another order, as Spark adds them in any.

How it scales: up to ``ROWS_PER_TASK`` rows are one task that grows all trees. More rows stay in Spark's storage in as many tasks as
there are cores, some 31 bytes each with 14 features, and each level is a job; a task holds one block, which is a partition of the
rows, and returns sums whose size depends on features, bins and nodes of a level, not on rows: up to 300 kB with 32 nodes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.operators.staging import delete, new_path
from shelfprice.session import enable_checkpoints

#: Fixed values of Spark ML: the gain of a split that is not allowed, and what counts as no impurity.
NO_GAIN = -np.finfo(np.float64).max
NO_IMPURITY = 2.0 ** -52
#: Rows between two starting points of the random numbers of a block.
STRIDE = 512
#: Trees whose samples are drawn at once.
DRAWN = 10
#: Rows up to which one task grows all trees of a fit; a job for each level of each tree costs more.
ROWS_PER_TASK = 500_000

MASK = (1 << 64) - 1
BLOCK = "part int, bins binary, labels binary"
NODE = "id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int"
SPLIT = "featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int"


# random numbers of Spark and Java

def hashed_seed(seed: int) -> int:
    """The first state of Spark's ``XORShiftRandom``: two rounds of Murmur3 over the bytes of the seed."""
    words = [int.from_bytes((seed & MASK).to_bytes(8, "big")[k:k + 4], "little") for k in (0, 4)]

    def murmur(h: int) -> int:
        for k in words:
            k = k * 0xCC9E2D51 & 0xFFFFFFFF
            k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
            h ^= k
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    low = murmur(0x3C074A61)
    return murmur(low) << 32 | low


def _shifted(state):
    """The next state of ``XORShiftRandom``, of a number or an array of them."""
    if isinstance(state, int):
        state ^= state << 21 & MASK
        state ^= state >> 35
        return state ^ (state << 4 & MASK)
    state = state ^ state << np.uint64(21)
    state ^= state >> np.uint64(35)
    state ^= state << np.uint64(4)
    return state


def _java_longs(seed: int) -> Iterator[int]:
    """``nextLong`` of ``java.util.Random``."""
    state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1
    while True:
        words = []
        for _ in range(2):
            state = state * 0x5DEECE66D + 0xB & (1 << 48) - 1
            word = state >> 16
            words.append(word - (1 << 32) if word >> 31 else word)
        yield (words[0] << 32) + words[1]


def _subset(n: int, size: int, longs: Iterator[int]) -> list[int]:
    """``size`` of ``n`` features by reservoir sampling, in the order of Spark's ``SamplingUtils``; all need no seed."""
    kept, state = list(range(size)), hashed_seed(next(longs)) if size < n else 0
    for item in range(size, n):
        state = _shifted(state)
        high = state & (1 << 26) - 1
        state = _shifted(state)
        at = int(((high << 27) + (state & (1 << 27) - 1)) * 2.0 ** -53 * (item + 1))
        if at < size:
            kept[at] = item
    return kept


def samples(n: int, rate: float, seeds: list[int]) -> np.ndarray:
    """Which of ``n`` rows each seed takes, as packed bits: a random double per row and seed, in the order of the rows.

    The generator is linear in the bits of its state, so the state after a stride follows from those of the single bits.
    """
    units = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for _ in range(2 * STRIDE):
        units = _shifted(units)
    state = np.array([hashed_seed(s) for s in seeds], dtype=np.uint64)
    starts = []
    for _ in range(-(-n // STRIDE)):
        starts.append(state)
        state = np.bitwise_xor.reduce([unit * (state >> np.uint64(b) & np.uint64(1)) for b, unit in enumerate(units)])
    lanes = np.array(starts, dtype=np.uint64).reshape(-1, len(seeds))
    taken = np.empty((STRIDE, *lanes.shape), dtype=bool)
    for k in range(STRIDE):
        lanes = _shifted(lanes)
        high = lanes & np.uint64((1 << 26) - 1)
        lanes = _shifted(lanes)
        taken[k] = ((high << np.uint64(27)) + (lanes & np.uint64((1 << 27) - 1))).astype(np.float64) * 2.0 ** -53 < rate
    return np.packbits(taken.transpose(2, 1, 0).reshape(len(seeds), -1)[:, :n], axis=1)


# growing trees

@dataclass(frozen=True)
class Plan:
    """What a fit does, as Spark reads it from the estimator and its rows."""

    rounds: int
    step: float
    depth: int
    rate: float
    seed: int
    n_features: int
    per_node: int
    least_rows: int
    least_gain: float
    bins: int
    splits: tuple[int, ...]
    thresholds: tuple[tuple[float, ...] | None, ...]
    arity: tuple[int, ...]
    n_rows: int


@dataclass
class Node:
    """A node of a tree that grows; ``stats`` are number, sum and sum of squares of its labels."""

    level: int
    stats: np.ndarray | None = None
    impurity: float = 0.0
    gain: float = -1.0
    feature: int = -1
    values: list[float] = field(default_factory=list)
    children: tuple[int, int] | None = None

    @property
    def prediction(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0


def impurity(stats: np.ndarray) -> np.ndarray:
    """Variance from number, sum and sum of squares."""
    n, total, squares = stats[..., 0], stats[..., 1], stats[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (squares - total * total / n) / n)


class Block:
    """The rows of one partition while trees grow on them."""

    def __init__(self, plan: Plan, part: int, bins: bytes, labels: bytes, predicted: bytes | None = None, taken: np.ndarray | None = None):
        self.plan, self.part, self.taken = plan, part, taken
        self.labels = np.frombuffer(labels, dtype=np.float64)
        self.n = len(self.labels)
        self.bins = np.frombuffer(bins, dtype=np.uint8).reshape(plan.n_features, self.n)
        self.predicted = np.zeros(self.n) if predicted is None else np.frombuffer(predicted, dtype=np.float64)

    def kept(self) -> tuple:
        return self.part, self.bins.tobytes(), self.labels.tobytes(), self.predicted.tobytes(), self.taken

    def draw(self, m: int) -> Block:
        """The samples of ``DRAWN`` trees from tree ``m`` on, as each starts from a seed of its own."""
        if self.plan.rate < 1 and m % DRAWN == 0:
            first = self.plan.seed + self.part + 1
            self.taken = samples(self.n, self.plan.rate, [first + k for k in range(m, min(m + DRAWN, self.plan.rounds))])
        return self

    def begin(self, m: int) -> None:
        """The sample of tree ``m``, whose labels are the slopes of the squared error after the first."""
        values = self.labels if m == 0 else 2.0 * (self.labels - self.predicted)
        self.chosen = None if self.taken is None else np.flatnonzero(np.unpackbits(self.taken[m % DRAWN], count=self.n))
        self.values = values if self.chosen is None else values[self.chosen]
        self.squares = self.values * self.values
        self.own = self.bins if self.chosen is None else self.bins[:, self.chosen]

    def root(self) -> None:
        self.nodes, self.rows = np.zeros(self.n, dtype=np.int64), np.arange(self.n)

    def sums(self, places: np.ndarray, n_places: int) -> np.ndarray:
        """Number, sum and squares of the sampled labels by node, feature and bin; ``places`` numbers the nodes."""
        bins, n = self.plan.bins, len(self.values)
        first = places[self.nodes if self.chosen is None else self.nodes[self.chosen]] * bins
        size, at = (n_places + 1) * bins, np.empty(n, dtype=np.int64)
        found = np.empty((n_places, self.plan.n_features, bins, 3))
        for k in range(self.plan.n_features):
            np.add(first, self.own[k], out=at)
            for j, weights in enumerate((None, self.values, self.squares)):
                found[:, k, :, j] = np.bincount(at, weights, size)[:n_places * bins].reshape(n_places, bins)
        return found

    def move(self, feature: np.ndarray, child: np.ndarray) -> None:
        """All rows to the child of their node, by the node's feature and the row's bin of it."""
        at = feature[self.nodes] * self.n
        at += self.rows
        own = self.bins.ravel()[at]
        self.nodes = child.ravel()[self.nodes * self.plan.bins + own]

    def end(self, m: int, values: np.ndarray) -> Block:
        self.predicted = self.predicted + values[self.nodes] * (1.0 if m == 0 else self.plan.step)
        return self


def _picked(sums: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of each node the features that it may be split by."""
    return sums[np.arange(len(chosen))[:, None], chosen]


class Held:
    """The rows of a fit in the memory of one task."""

    def __init__(self, plan: Plan, blocks: Iterable[tuple]):
        self.blocks = [Block(plan, *b) for b in sorted(blocks, key=lambda b: b[0])]

    def begin(self, m: int) -> None:
        for block in self.blocks:
            block.draw(m).begin(m)
            block.root()

    def sums(self, places: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return sum(_picked(block.sums(places, len(chosen)), chosen) for block in self.blocks)

    def move(self, feature: np.ndarray, child: np.ndarray) -> None:
        for block in self.blocks:
            block.move(feature, child)

    def end(self, m: int, values: np.ndarray) -> None:
        for block in self.blocks:
            block.end(m, values)


def _block_sums(blocks: Iterable[tuple], plan: Plan, m: int, moves: list, places: np.ndarray, chosen: np.ndarray) -> Iterator[bytes]:
    total = None
    for kept in blocks:
        block = Block(plan, *kept)
        block.begin(m)
        block.root()
        for step in moves:
            block.move(*step)
        own = block.sums(places, len(chosen))
        total = own if total is None else total + own
    if total is not None:
        yield _picked(total, chosen).tobytes()


def _block_after(kept: tuple, plan: Plan, m: int, moves: list, values: np.ndarray) -> tuple:
    block = Block(plan, *kept)
    block.root()
    for step in moves:
        block.move(*step)
    return block.end(m, values).draw(m + 1).kept()


class Spread:
    """The rows of a fit in Spark's storage: a job for each level, whose tasks read their blocks and return sums.

    What is kept is written anew after each tree, with the predictions of all trees so far, and cut off from its
    history in the checkpoint folder every ``DRAWN`` trees.
    """

    def __init__(self, plan: Plan, blocks: RDD):
        self.plan, self.moves, self.m, self.folder, self.older = plan, [], 0, None, None
        self.kept = blocks.map(lambda b: Block(plan, *b).draw(0).kept()).persist(StorageLevel.MEMORY_AND_DISK)

    def begin(self, m: int) -> None:
        self.m, self.moves = m, []

    def sums(self, places: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        plan, m, moves = self.plan, self.m, self.moves
        said = self.kept.mapPartitions(lambda blocks: _block_sums(blocks, plan, m, moves, places, chosen)).collect()
        if self.older is not None:
            self._forget()
        return sum(np.frombuffer(one, dtype=np.float64) for one in said).reshape(*chosen.shape, plan.bins, 3)

    def move(self, feature: np.ndarray, child: np.ndarray) -> None:
        self.moves = [*self.moves, (feature, child)]

    def end(self, m: int, values: np.ndarray) -> None:
        plan, moves = self.plan, self.moves
        self.older, self.kept = self.kept, self.kept.map(lambda b: _block_after(b, plan, m, moves, values)).persist(StorageLevel.MEMORY_AND_DISK)
        if m % DRAWN == DRAWN - 1:
            self.kept.checkpoint()

    def _forget(self) -> None:
        """What the newest rows were made of, once they are there."""
        self.older.unpersist()
        self.older, folder = None, self.kept.getCheckpointFile()
        if folder is not None:
            self._delete()
            self.folder = folder

    def _delete(self) -> None:
        if self.folder is not None:
            delete(SparkSession.active(), self.folder)

    def release(self) -> None:
        for rows in filter(None, (self.older, self.kept)):
            rows.unpersist()
        self._delete()


def _split(node: Node, features: np.ndarray, sums: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Set gain and split of a node; the bins that go left, and the sums of both children, if it has a gain.

    Bins of a number are in order, those of a category by their mean label. The first of equal gains counts.
    """
    order = np.broadcast_to(np.arange(plan.bins), (len(features), plan.bins)).copy()
    for i, k in enumerate(features):
        if plan.thresholds[k] is None:
            own = sums[i, :plan.arity[k]]
            means = [s[1] / s[0] if s[0] else np.finfo(np.float64).max for s in own]
            order[i, :plan.arity[k]] = np.argsort(means, kind="stable")
    below = np.cumsum(np.take_along_axis(sums, order[:, :, None], axis=1), axis=1)
    left = below[:, :-1]
    right = below[:, -1:] - left
    splits = np.array([plan.splits[k] for k in features])
    if node.stats is None:
        first = int(np.argmax(splits > 0))
        node.stats = left[first, 0] + right[first, 0]
        node.impurity = float(impurity(node.stats))
    n_left, n_right = left[..., 0], right[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        n = n_left + n_right
        gain = node.impurity - n_left / n * impurity(left) - n_right / n * impurity(right)
    refused = (n_left < plan.least_rows) | (n_right < plan.least_rows) | ~(gain >= plan.least_gain)
    gain = np.where(refused, NO_GAIN, gain)
    gain[np.arange(plan.bins - 1)[None, :] >= splits[:, None]] = -np.inf
    i, at = np.unravel_index(int(gain.argmax()), gain.shape)
    node.gain = float(gain[i, at])
    if node.gain <= NO_GAIN:
        node.impurity = -1.0
    if node.gain <= 0 or node.level == plan.depth:
        return None
    node.feature = int(features[i])
    goes = order[i, :at + 1]
    known = plan.thresholds[node.feature]
    node.values = [float(v) for v in goes] if known is None else [known[at]]
    return goes, left[i, at], right[i, at]


def _tree(rows: Held | Spread, m: int, plan: Plan) -> list[Node]:
    """Tree ``m``, level by level; nodes that wait are taken last come, first served, as their features are drawn in that order."""
    nodes, waiting, longs = [Node(0)], [0], _java_longs(plan.seed + m)
    rows.begin(m)
    while waiting:
        chosen = np.array([_subset(plan.n_features, plan.per_node, longs) for _ in waiting])
        places = np.full(len(nodes), len(waiting))
        places[waiting] = np.arange(len(waiting))
        sums = rows.sums(places, chosen)
        grown, waiting = waiting, []
        feature = np.zeros(len(nodes), dtype=np.int64)
        child = np.repeat(np.arange(len(nodes))[:, None], plan.bins, axis=1)
        for k, features, own in zip(grown, chosen, sums, strict=True):
            node = nodes[k]
            found = _split(node, features, own, plan)
            if found is None:
                continue
            goes, *parts = found
            node.children = len(nodes), len(nodes) + 1
            feature[k] = node.feature
            child[k] = node.children[1]
            child[k, goes] = node.children[0]
            for number, stats in zip(node.children, parts, strict=True):
                nodes.append(Node(node.level + 1, stats, float(impurity(stats))))
                if node.level + 1 < plan.depth and abs(nodes[number].impurity) >= NO_IMPURITY:
                    waiting.insert(0, number)
        if len(nodes) > len(feature):
            rows.move(feature, child)
    rows.end(m, np.array([node.prediction for node in nodes]))
    return nodes


def _pruned(nodes: list[Node], k: int = 0) -> None:
    """Children that are leaves of one value are no split."""
    if nodes[k].children:
        for c in nodes[k].children:
            _pruned(nodes, c)
        left, right = (nodes[c] for c in nodes[k].children)
        if not left.children and not right.children and left.prediction == right.prediction:
            nodes[k].children = None


def _saved(nodes: list[Node], arity: tuple[int, ...]) -> list[tuple]:
    """The nodes of a tree as Spark saves them, numbered from the root, left before right."""
    rows: list[tuple] = []

    def put(k: int) -> int:
        node, number = nodes[k], len(rows)
        stats = [float(v) for v in node.stats]
        rows.append(())
        if node.children is None:
            last = (-1.0, -1, -1, (-1, [], -1))
        else:
            left, right = (put(c) for c in node.children)
            last = (node.gain, left, right, (node.feature, node.values, arity[node.feature] or -1))
        rows[number] = (number, node.prediction, node.impurity, stats, int(stats[0]), *last)
        return number

    _pruned(nodes)
    put(0)
    return rows


def grow(rows: Held | Spread, plan: Plan) -> list[tuple[int, list[tuple]]]:
    """All trees of a fit."""
    return [(m, _saved(_tree(rows, m, plan), plan.arity)) for m in range(plan.rounds)]


# Spark

def _blocks(rows: DataFrame, features: str, label: str, plan: Plan) -> DataFrame:
    """One row per partition that has any: the bins of its rows, feature by feature, and its labels."""
    thresholds = [None if t is None else np.array(t, dtype=np.float64) for t in plan.thresholds]

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, labels = [], []
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), plan.n_features)
            bins.append(np.array([
                flat[:, k].astype(np.uint8) if t is None else np.searchsorted(t, flat[:, k]).astype(np.uint8)
                for k, t in enumerate(thresholds)]))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        if sum(map(len, labels)):
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate(bins, axis=1).tobytes()], pa.binary()),
                pa.array([np.concatenate(labels).tobytes()], pa.binary())], ["part", "bins", "labels"])

    return rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(binned, BLOCK)


def _plan(estimator: GBTRegressor, rows: DataFrame) -> Plan:
    """Settings and candidate splits, as Spark's own code finds them."""
    jvm = rows.sparkSession._jvm
    ml = jvm.org.apache.spark.ml
    estimator._transfer_params_to_java()
    java, get = estimator._java_obj, estimator.getOrDefault
    categories = ml.util.MetadataUtils.getCategoricalFeatures(rows._jdf.schema().apply(get("featuresCol")))
    strategy = java.getOldBoostingStrategy(categories, jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression())
    utils, forest = (getattr(getattr(package, f"{name}$"), "MODULE$") for package, name in ((ml.util, "DatasetUtils"), (ml.tree.impl, "RandomForest")))
    instances = utils.extractInstances(java, rows._jdf, getattr(utils, "extractInstances$default$3")())
    metadata = ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy.treeStrategy(), 1, get("featureSubsetStrategy"))
    found = forest.findSplits(instances, metadata, get("seed"))
    n = metadata.numFeatures()
    splits = tuple(metadata.numSplits(k) for k in range(n))
    numbers = [metadata.isContinuous(k) for k in range(n)]
    return Plan(
        get("maxIter"), get("stepSize"), get("maxDepth"), get("subsamplingRate"), get("seed"), n, metadata.numFeaturesPerNode(),
        get("minInstancesPerNode"), get("minInfoGain"), max(max(splits) + 1, 2), splits,
        tuple(tuple(found[k][j].threshold() for j in range(splits[k])) if numbers[k] else None for k in range(n)),
        tuple(0 if numbers[k] else metadata.numBins()[k] for k in range(n)), metadata.numExamples())


def _model(spark: SparkSession, estimator: GBTRegressor, plan: Plan, trees: list[tuple[int, list[tuple]]]) -> GBTRegressionModel:
    """Spark's model of the trees, by way of the files in which Spark keeps such models."""
    def metadata(kind: str, uid: str, hidden: tuple[str, ...] = (), **more) -> str:
        def named(params: dict) -> dict:
            return {p.name: v for p, v in params.items() if p.name not in hidden}

        return json.dumps({
            "class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
            "paramMap": named(estimator._paramMap), "defaultParamMap": named(estimator._defaultParamMap), **more})

    boosting = ("maxIter", "stepSize", "subsamplingRate", "featureSubsetStrategy", "lossType", "validationTol")
    path = new_path(spark)
    text = metadata("GBTRegressionModel", estimator.uid, numFeatures=plan.n_features, numTrees=len(trees))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(m, metadata("DecisionTreeRegressionModel", f"dtr_{estimator.uid}_{m}", boosting), plan.step if m else 1.0) for m, _ in trees]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [(m, node) for m, tree in trees for node in tree]
    schema = f"treeID int, nodeData struct<{NODE}, split struct<{SPLIT}>>"
    spark.createDataFrame(nodes, schema).coalesce(1).write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


def _is_plain(estimator: GBTRegressor) -> bool:
    """Whether a fit needs nothing but what is here: equal weights, squared errors, bins that are bytes."""
    set_ = {p.name for p in estimator.extractParamMap()}
    return not {"weightCol", "validationIndicatorCol"} & set_ and estimator.getLossType() == "squared" and (
        estimator.getMaxBins() <= 256 and estimator.getMinWeightFractionPerNode() == 0)


def fit(estimator: GBTRegressor, rows: DataFrame) -> GBTRegressionModel:
    """The model that ``estimator.fit(rows)`` gives; ``rows`` should be cached, as they are read four times."""
    spark = rows.sparkSession
    if not _is_plain(estimator):
        return estimator.fit(rows)
    enable_checkpoints(spark)
    plan = _plan(estimator, rows)
    blocks = _blocks(rows, estimator.getFeaturesCol(), estimator.getLabelCol(), plan).rdd
    tasks = min(spark.sparkContext.defaultParallelism, -(-plan.n_rows // ROWS_PER_TASK))
    dealt = blocks.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2])))).partitionBy(tasks, lambda part: part).map(lambda b: (b[0], *b[1]))
    if tasks <= 1:
        trees = dealt.mapPartitions(lambda own: grow(Held(plan, own), plan)).collect()
    else:
        spread = Spread(plan, dealt)
        try:
            trees = grow(spread, plan)
        finally:
            spread.release()
    return _model(spark, estimator, plan, trees)
