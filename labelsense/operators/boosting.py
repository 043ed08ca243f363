"""Boosted trees of all labels, one against the rest, grown together on counted rows of 0/1 features.

Spark's ``OneVsRest`` fits the labels one after the other, and each passes over the rows once for every level of every
tree. Here a pass serves one level of the trees of all labels. Rows alike in label and features are counted, their features
are packed into bits, and their margins (the sums of the trees so far) are stored after each round. A task sums
targets by open node and feature; sums are added up by label, where the best splits are found too, so the driver sees
splits only. Labels, targets, splits, limits, leaf values and weights are those of Spark's classifier.

Targets are rounded to a binary fraction so small that all their sums are whole numbers a double holds: results do not
depend on how rows were dealt or tasks were ordered. Of equally good splits the first feature wins, as in Spark, where the
last digit of a sum may decide otherwise.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsense.operators.scale import stored

PIECE_CELLS = 1 << 17
ROWS = "label int, n bigint, held binary, margin binary"
#: Params of ``GBTClassifier`` that a fit takes; others must have their defaults, but for those without effect here.
TAKEN = {"maxDepth", "maxIter", "stepSize", "minInstancesPerNode", "minInfoGain", "maxMemoryInMB"}
NO_EFFECT = {
    "seed", "cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "predictionCol", "rawPredictionCol",
    "probabilityCol", "leafCol", "impurity", "maxBins", "validationTol",
}


class Tree:
    """Nodes in the order they were made: the feature that divides them, the two children (itself for a leaf), the value."""

    def __init__(self, feature=(0,), children=((0, 0),), value=(0.0,)):
        self.feature, self.children, self.value = list(feature), [list(c) for c in children], list(value)

    def leaf(self, value: float) -> int:
        at = len(self.value)
        self.feature.append(0)
        self.children.append([at, at])
        self.value.append(value)
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int32), np.array(self.children, np.int32).ravel(), np.array(self.value)


def _reached(feature: np.ndarray, children: np.ndarray, held: np.ndarray, steps: int) -> np.ndarray:
    """The node that each row is in after so many steps from the root."""
    flat, start = held.ravel(), np.arange(len(held)) * held.shape[1]
    node = np.zeros(len(held), np.int32)
    for _ in range(steps):
        node = children.take(2 * node + flat.take(start + feature.take(node)))
    return node


def _places(features: Column) -> Column:
    """Which entries of a vector are not 0."""
    vector = F.unwrap_udt(features)
    values = vector["values"]
    at = F.when(vector["type"] == 0, vector["indices"]).when(
        F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)
    )
    return F.filter(F.coalesce(at, F.array().cast("array<int>")), lambda _, i: F.get(values, i) != 0)


def _held(lists: pa.ListArray, width: int) -> np.ndarray:
    """One row of 0 and 1 for each list of places."""
    out = np.zeros((len(lists), width), np.uint8)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    out[row, lists.flatten().to_numpy()] = 1
    return out


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    first, last = column.offset, column.offset + len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[first] : ends[last]].view(kind).reshape(len(column), width)


def _bits(column: pa.Array, width: int) -> np.ndarray:
    return np.unpackbits(_matrix(column, np.uint8, -(-width // 8)), axis=1, count=width)


def _targets(label: np.ndarray, k: int, margin: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree of a label is to predict: its sign, then the gradient of the loss."""
    sign = np.where(label == k, 1.0, -1.0)
    if first:
        return sign
    with np.errstate(over="ignore"):
        return 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin[:, k]))


def _packed(rows: DataFrame, width: int, labels: int) -> DataFrame:
    """Counted rows (label, n, places) as bits, with margins of 0."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = bytes(8 * labels)
        for batch in batches:
            bits = np.packbits(_held(batch.column("places"), width), axis=1)
            held = pa.array([row.tobytes() for row in bits], pa.binary())
            margin = pa.array([nothing] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("n"), held, margin], ["label", "n", "held", "margin"])

    return rows.mapInArrow(read, ROWS)


def _splits(rows: DataFrame, grown: dict, labels: int, width: int, level: int, first: bool, unit: float, limits: tuple) -> dict[int, list]:
    """For the open nodes of each label: best feature or -1, rows and sum of targets of the node and of those without and
    with the feature. ``grown`` has for each label feature and children of the nodes, and the numbers of those open."""
    shared = rows.sparkSession.sparkContext.broadcast(grown)
    least_rows, least_gain = limits
    # Sums are handed on by pieces of about 1 MB, so that adding them up takes little memory.
    piece = max(1, PIECE_CELLS // (2 * (width + 1)))
    schema = pa.schema([("k", pa.int32()), ("low", pa.int32()), ("total", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((2, len(nodes) + 1, width + 1)) for k, (_, _, nodes) in shared.value.items()}
        for batch in batches:
            label, n = batch.column("label").to_numpy(), batch.column("n").to_numpy().astype(float)
            bits = _bits(batch.column("held"), width)
            # Row and feature of every 1; a first column of the sums counts the rows of a node.
            ones = bits.sum(axis=1, dtype=np.int64)
            row = np.repeat(np.arange(len(bits)), ones)
            place = np.flatnonzero(bits.view(bool)) - row * width + 1
            margin, weight = _matrix(batch.column("margin"), np.float64, labels), n.take(row)
            for k, (feature, children, nodes) in shared.value.items():
                order = np.full(len(feature), len(nodes))
                order[nodes] = np.arange(len(nodes))
                at = order.take(_reached(feature, children, bits, level))
                target = n * np.rint(_targets(label, k, margin, first) * unit)
                start = at * (width + 1)
                if level and np.count_nonzero(at < len(nodes)) * 2 < len(at):
                    open_ = np.flatnonzero((at < len(nodes)).take(row))
                    some = row.take(open_)
                    cell, each, sought = start.take(some) + place.take(open_), weight.take(open_), target.take(some)
                else:
                    cell, each, sought = np.repeat(start, ones) + place, weight, np.repeat(target, ones)
                for own, of_row, of_cell in zip(sums[k], (n, target), (each, sought), strict=True):
                    own += np.bincount(cell, of_cell, own.size).reshape(own.shape)
                    own[:, 0] += np.bincount(at, of_row, len(own))
        out = [(k, low, a[:, low : min(low + piece, a.shape[1] - 1)].tobytes()) for k, a in sums.items() for low in range(0, a.shape[1] - 1, piece)]
        yield pa.RecordBatch.from_pylist([{"k": k, "low": low, "total": total} for k, low, total in out], schema)

    def best(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("total").to_pylist()).reshape(2, -1, width + 1)
        (n, with_n), (s, with_s) = ((a[:, :1], a[:, 1:]) for a in total)
        without_n, without_s = n - with_n, s - with_s
        with np.errstate(divide="ignore", invalid="ignore"):
            # The fall of the variance, in a form that is exactly 0 for equal means and alike if the sides are swapped.
            gain = without_n * with_n * ((without_s / without_n - with_s / with_n) / unit / n) ** 2
        gain[~((without_n >= least_rows) & (with_n >= least_rows) & (gain >= least_gain) & (gain > 0))] = -1.0
        feature = gain.argmax(axis=1)
        at = (np.arange(len(gain)), feature)
        found = [np.where(gain[at] > 0, feature, -1), n[:, 0], s[:, 0], without_n[at], without_s[at], with_n[at], with_s[at]]
        keys = table.select(["k", "low"]).slice(0, 1)
        return keys.append_column("found", pa.array([np.stack(found, axis=1).tobytes()], pa.binary()))

    sums = rows.mapInArrow(read, "k int, low int, total binary")
    sent = sums.groupBy("k", "low").applyInArrow(best, "k int, low int, found binary").collect()  # seven numbers per open node
    shared.unpersist()
    every: dict[int, list] = {}
    for row in sorted(sent, key=lambda row: row["low"]):
        every.setdefault(row["k"], []).extend(np.frombuffer(row["found"]).reshape(-1, 7).tolist())
    return every


def _parts(open_: dict[int, list[int]], most: int) -> Iterator[dict[int, list[int]]]:
    """Open nodes of all labels in parts of at most so many nodes."""
    every = [(k, node) for k, nodes in open_.items() for node in nodes]
    for low in range(0, len(every), most):
        part: dict[int, list[int]] = {}
        for k, node in every[low : low + most]:
            part.setdefault(k, []).append(node)
        yield part


def _round(rows: DataFrame, labels: int, width: int, first: bool, unit: float, classifier: GBTClassifier) -> list[Tree]:
    """The next tree of every label, a level at a time."""
    trees, limits = [Tree() for _ in range(labels)], (classifier.getMinInstancesPerNode(), classifier.getMinInfoGain())
    open_ = {k: [0] for k in range(labels)}
    most = max(1, (classifier.getMaxMemoryInMB() << 20) // (16 * (width + 1)))
    for level in range(max(1, classifier.getMaxDepth())):
        following: dict[int, list[int]] = {}
        for part in _parts(open_, most):
            grown = {k: (*trees[k].arrays()[:2], np.array(nodes)) for k, nodes in part.items()}
            for k, found in _splits(rows, grown, labels, width, level, first, unit, limits).items():
                tree = trees[k]
                for node, (feature, n, s, *sides) in zip(part[k], found, strict=True):
                    tree.value[node] = s / n / unit
                    if feature >= 0 and classifier.getMaxDepth():
                        tree.feature[node] = int(feature)
                        tree.children[node] = [tree.leaf(sides[i + 1] / sides[i] / unit) for i in (0, 2)]
                        # A node of one row can't be divided.
                        following.setdefault(k, []).extend(c for i, c in zip((0, 2), tree.children[node], strict=True) if sides[i] > 1)
        open_ = {k: nodes for k, nodes in following.items() if nodes}
        if not open_:
            break
    return trees


def _advanced(rows: DataFrame, trees: list[Tree], weight: float, width: int, depth: int) -> DataFrame:
    """The rows with the trees of a round added to their margins, stored."""
    shared = rows.sparkSession.sparkContext.broadcast([tree.arrays() for tree in trees])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column("held"), width)
            margin = _matrix(batch.column("margin"), np.float64, len(shared.value)).copy()
            for k, (feature, children, value) in enumerate(shared.value):
                margin[:, k] += weight * value.take(_reached(feature, children, bits, depth))
            yield batch.set_column(3, "margin", pa.array([row.tobytes() for row in margin], pa.binary()))

    out = stored(rows.mapInArrow(read, ROWS))
    shared.unpersist()
    return out


class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Margins of all labels in ``rawPrediction``, the label of the largest, the first of equals, in ``prediction``."""

    trees = Param(Params._dummy(), "trees", "for each label, weight, features, children and values of its trees")
    width = Param(Params._dummy(), "width", "number of features")

    @keyword_only
    def __init__(self, *, trees=None, width=0, featuresCol="features", predictionCol="prediction", rawPredictionCol="rawPrediction"):
        super().__init__()
        self._setDefault(trees=None, width=0)
        self._set(**self._input_kwargs)

    def setPredictionCol(self, value):
        return self._set(predictionCol=value)

    def _transform(self, dataset):
        width = self.getOrDefault("width")
        grown = [[(w, *Tree(*nodes).arrays()) for w, *nodes in trees] for trees in self.getOrDefault("trees")]
        # Further than any leaf is no harm: leaves lead to themselves.
        depth = max((_depth(children) for trees in grown for _, _, children, _ in trees), default=0)

        @F.arrow_udf("array<double>")
        def margins(lists: pa.Array) -> pa.Array:
            held, out = _held(lists, width), np.zeros((len(lists), len(grown)))
            for k, trees in enumerate(grown):
                for weight, feature, children, value in trees:
                    out[:, k] += weight * value.take(_reached(feature, children, held, depth))
            ends = pa.array(np.arange(0, out.size + 1, len(grown)), pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

        raw, name = self.getRawPredictionCol(), self.getPredictionCol()
        scored = dataset.withColumn(raw, margins(_places(F.col(self.getFeaturesCol()))))
        scored = scored.withColumn(name, (F.array_position(raw, F.array_max(raw)) - 1).cast("double"))
        return scored.withColumn(raw, array_to_vector(raw))


def _depth(children: np.ndarray) -> int:
    """Steps to the deepest leaf; children come after their parents."""
    below = np.zeros(len(children) // 2, int)
    for node, pair in enumerate(children.reshape(-1, 2)):
        for child in pair:
            if child != node:
                below[child] = below[node] + 1
    return int(below.max())


class BoostedTogether(Estimator):
    """Fits what ``OneVsRest`` of a ``GBTClassifier`` fits, for vectors of 0 and 1, in one pass per level for all labels."""

    def __init__(self, estimator: OneVsRest):
        super().__init__()
        classifier = estimator.getClassifier()
        if not isinstance(classifier, GBTClassifier):
            raise TypeError(f"not boosted trees: {classifier}")
        plain = GBTClassifier()
        for param in classifier.params:
            usual = plain.hasDefault(param.name) and classifier.isDefined(param) and classifier.getOrDefault(param) == plain.getOrDefault(param.name)
            if param.name not in TAKEN | NO_EFFECT and classifier.isSet(param) and not usual:
                raise ValueError(f"{param.name} is not taken here; fit the estimator itself")
        if estimator.isDefined("weightCol"):
            raise ValueError("weightCol is not taken here; fit the estimator itself")
        self.estimator = estimator

    def _fit(self, dataset):
        one, classifier = self.estimator, self.estimator.getClassifier()
        label, features = F.col(one.getLabelCol()), F.col(one.getFeaturesCol())
        values = F.unwrap_udt(features)
        plain = dataset.select(
            label.cast("int").alias("label"), _places(features).alias("places"),
            F.when(values["type"] == 0, values["size"]).otherwise(F.size(values["values"])).alias("width"),
            (F.forall(values["values"], lambda v: v.isin(0.0, 1.0)) & (label == F.floor(label)) & (label >= 0)).alias("fine"),
        )
        # Rows alike are counted once; passes are long for the size of the rows: as many files as cores.
        counted = plain.groupBy("label", "places", "width").agg(F.count(F.lit(1)).alias("n"), F.every(F.coalesce("fine", F.lit(False))).alias("fine"))
        counted = stored(counted.repartition(dataset.sparkSession.sparkContext.defaultParallelism))
        total, fine, least, width, most = counted.agg(F.sum("n"), F.every("fine"), F.min("width"), F.max("width"), F.max("label")).first()
        if not total:
            raise ValueError("no row to learn from")
        if not fine or least != width:
            raise ValueError("labels must be whole numbers from 0, and features 0 or 1 in vectors of one size")
        labels = most + 1
        # Targets are at most 4: their sums stay below 2 ** 51.
        unit = 2.0 ** min(40, 49 - int(total).bit_length())
        rows = stored(_packed(counted.select("label", "n", "places"), width, labels))
        trees: list[list] = [[] for _ in range(labels)]
        for i in range(classifier.getMaxIter()):
            weight = classifier.getStepSize() if i else 1.0
            found = _round(rows, labels, width, i == 0, unit, classifier)
            for own, tree in zip(trees, found, strict=True):
                own.append([weight, tree.feature, tree.children, tree.value])
            if i + 1 < classifier.getMaxIter():
                rows = _advanced(rows, found, weight, width, classifier.getMaxDepth())
        return BoostedTreesModel(
            trees=trees, width=width, featuresCol=one.getFeaturesCol(), predictionCol=one.getPredictionCol(),
            rawPredictionCol=one.getRawPredictionCol(),
        )
