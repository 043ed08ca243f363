"""Training of a network on counted pairs of a one-hot word and a label.

Rows of a corpus repeat the same pairs of word and label: a table of them has at most words times
labels rows, however many texts there are. Spark's perceptron takes no weights, so it passes over every
repetition; here a pass goes over the distinct pairs and weighs them by their number. Initial weights, layers,
loss, the quasi-Newton steps with their line search, and the model are those of Spark's classifier; only its
mean over blocks of rows, which depends on how rows were dealt, is a mean over the rows.

The driver holds the weights and the last ten steps, as Spark's trainer does; tasks send one gradient each.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

CORRECTIONS, SEARCHES, ZOOMS = 10, 10, 10
#: Pairs that a task multiplies at once.
BLOCK = 2048


class SearchFailed(Exception):
    """No step along the direction lowers the loss enough."""


def _layers(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (input by output) and bias of each layer, as views."""
    out, at = [], 0
    for inner, outer in zip(sizes, sizes[1:], strict=False):
        matrix = weights[at : at + inner * outer].reshape(inner, outer)
        at += inner * outer
        out.append((matrix, weights[at : at + outer]))
        at += outer
    return out


def gradient(weights: np.ndarray, sizes: list[int], word: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the pairs of their loss and its gradient, each pair counted ``n`` times."""
    total = np.zeros_like(weights)
    layers, sums = _layers(weights, sizes), _layers(total, sizes)
    outputs = []
    z = layers[0][0][word] + layers[0][1]
    for matrix, bias in layers[1:]:
        outputs.append(1.0 / (1.0 + np.exp(-z)))
        z = outputs[-1] @ matrix + bias
    z -= z.max(axis=1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows = np.arange(len(label))
    loss = -float((n * logs[rows, label]).sum())
    delta = np.exp(logs)
    delta[rows, label] -= 1.0
    delta *= n[:, None]
    for i in range(len(layers) - 1, 0, -1):
        sums[i][0][:] += outputs[i - 1].T @ delta
        sums[i][1][:] += delta.sum(axis=0)
        delta = (delta @ layers[i][0].T) * outputs[i - 1] * (1 - outputs[i - 1])
    np.add.at(sums[0][0], word, delta)
    sums[0][1][:] += delta.sum(axis=0)
    return loss, total


def _objective(pairs: DataFrame, sizes: list[int], total: float) -> Callable:
    """Mean loss over all rows and its gradient, by one pass over the distinct pairs."""

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = pairs.sparkSession.sparkContext.broadcast(weights)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, sums = 0.0, np.zeros(len(shared.value))
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(low, BLOCK)
                    word, label, n = (part.column(c).to_numpy() for c in ("word", "label", "n"))
                    more, slope = gradient(shared.value, sizes, word, label, n.astype(float))
                    loss, sums = loss + more, sums + slope
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([sums.tobytes()], pa.binary())], ["loss", "sums"])

        sent = pairs.mapInArrow(read, "loss double, sums binary").collect()  # one per task of a bounded table
        shared.unpersist()
        return sum(r["loss"] for r in sent) / total, sum(np.frombuffer(r["sums"]) for r in sent) / total

    return at


def _between(low: tuple, high: tuple) -> float:
    """Minimum of the cubic through two points (step, loss, slope), kept off both ends."""
    d1 = low[2] + high[2] - 3 * (low[1] - high[1]) / (low[0] - high[0])
    d2 = np.sqrt(max(d1 * d1 - low[2] * high[2], 0.0))
    width = high[0] - low[0]
    step = high[0] - width * (high[2] + d2 - d1) / (high[2] - low[2] + 2 * d2)
    return float(np.clip(step, low[0] + 0.1 * width, low[0] + 0.9 * width))


def _search(phi: Callable, start: tuple, step: float) -> tuple:
    """A step that meets the strong Wolfe conditions, as (step, loss, slope, gradient)."""
    _, loss, slope, _ = low = start
    if slope > 0:
        raise SearchFailed("not a descent")

    def zoom(low: tuple, high: tuple) -> tuple:
        for _ in range(ZOOMS):
            c = phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > loss + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed("zoom")

    for i in range(SEARCHES):
        c = phi(step)
        if not np.isfinite(c[1]):
            step /= 2
            continue
        if c[1] > loss + 1e-4 * step * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return c
        if c[2] >= 0:
            return zoom(c, low)
        low, step = c, step * 1.5
    raise SearchFailed("search")


def _direction(slope: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton direction from the last steps and changes of the gradient, the latest first."""
    out, shares = slope.copy(), []
    for step, change in history:
        shares.append((step @ out) / (step @ change))
        out -= shares[-1] * change
    if history:
        step, change = history[0]
        out *= (step @ change) / (change @ change)
    for (step, change), share in zip(reversed(history), reversed(shares), strict=True):
        out += (share - (change @ out) / (step @ change)) * step
    return -out


def minimised(objective: Callable, x: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """The point after at most ``steps`` steps; a search that fails starts once more without history."""
    loss, slope = objective(x)
    history, failed, done = [], False, 0
    while done < steps and np.linalg.norm(slope) > max(tolerance * loss, 1e-8):
        try:
            way = _direction(slope, history)

            def phi(step: float, x=x, way=way) -> tuple:
                value, grad = objective(x + step * way)
                return step, value, float(grad @ way), grad

            start = (0.0, loss, float(slope @ way), slope)
            step, value, _, grad = _search(phi, start, 1.0 if done else 1.0 / np.linalg.norm(way))
            if step * np.linalg.norm(slope) < 1e-10:
                raise SearchFailed("step too small")
        except SearchFailed:
            if failed:
                break
            history, failed = [], True
            continue
        history = [(step * way, grad - slope), *history][:CORRECTIONS]
        x, loss, slope, failed, done = x + step * way, value, grad, False, done + 1
    return x


def fit_counted(classifier: MultilayerPerceptronClassifier, pairs: DataFrame) -> MultilayerPerceptronClassificationModel:
    """The classifier fitted on pairs (word, label, n): a one-hot word's place, the number of its label, and how often."""
    sizes = list(classifier.getLayers())
    pairs = pairs.selectExpr("cast(word as int) word", "cast(label as int) label", "cast(n as bigint) n")
    total = pairs.groupBy().sum("n").first()[0]
    if not total:
        raise ValueError("no pair to learn from")
    # Without a step Spark's own fit gives its initial weights, and a model of given ones.
    columns = [classifier.getFeaturesCol(), classifier.getLabelCol()]
    one = pairs.sparkSession.createDataFrame([(Vectors.sparse(sizes[0], {0: 1.0}), 0.0)], columns)
    still = classifier.copy({classifier.maxIter: 0})
    given = classifier.getInitialWeights() if classifier.isDefined("initialWeights") else still.fit(one).weights
    found = minimised(
        _objective(pairs, sizes, float(total)), np.array(given.toArray()), classifier.getMaxIter(), classifier.getTol()
    )
    return still.copy({classifier.initialWeights: Vectors.dense(found)}).fit(one)
