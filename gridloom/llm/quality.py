"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features and those of the lines before and after
it score the two states, and a transition table ties neighbours together. The
field is fitted on a bounded sample of labelled documents (all lines of a
document take its label); forward-backward marginals, weighted by the lengths
of the lines, give the quality of a document.

Scoring is one map over whole texts without a shuffle. Features are sums over
the bytes of many lines at once; the two-state recursions run on odds, one
number per line. The fitted weights are a few dozen numbers in the closure.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.common import chunks, whole

# Labelled documents (of those with the smallest hashes of their ids) and the
# longest text that the fit takes; scoring has no such bounds.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 100_000
STEPS, RATE, RIDGE = 120, 0.15, 1e-3
CHUNK_CHARS = 4_000_000
LIMIT = 25.0
THRESHOLD = 0.3

_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(65, 91)]] = 1
_KINDS[[*range(97, 123), *range(128, 256)]] = 2
_KINDS[[*range(48, 58)]] = 3
_KINDS[[ord(c) for c in "!?"]] = 4
_KINDS[[ord(c) for c in ".,;:'\"()-"]] = 5
_KINDS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
OWN = 11


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes of each line, lines of each text). A text without line
    breaks is one line, so an empty text is one empty line."""
    split = [t.encode("utf-8", "replace").split(b"\n") for t in texts]
    per_text = np.array([len(s) for s in split])
    lines = [line for s in split for line in s]
    sizes = np.array([len(line) for line in lines])
    kinds = _KINDS[np.frombuffer(b"".join(line + b" " for line in lines), np.uint8)]
    starts = np.cumsum(sizes + 1) - sizes - 1
    share = [np.add.reduceat(kinds == k, starts, dtype=np.int64) / np.maximum(sizes, 1) for k in range(1, 7)]
    words = [line.split() for line in lines]
    count = np.array([len(w) for w in words])
    different = np.array([len(set(w)) for w in words])
    seen = []
    for s in split:
        times = Counter(s)
        seen += [times[line] > 1 for line in s]
    own = np.stack(
        [
            *share,
            np.where(count > 0, 1 - different / np.maximum(count, 1), 0),
            np.minimum(sizes / np.maximum(count, 1), 40) / 10,
            np.log1p(count) / 5,
            np.array(seen, float) * (sizes > 0),
            (count == 0).astype(float),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = np.cumsum(per_text) - per_text
    before[first] = 0
    after[first + per_text - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))]), sizes, per_text


def odds(scores: list[float], table: list[list[float]], per_text: list[int]) -> tuple[list[float], list[float]]:
    """Forward and backward odds of good against bad for every line."""
    (t00, t01), (t10, t11) = table
    ahead, back = [0.0] * len(scores), [1.0] * len(scores)
    begin = 0
    for n in per_text:
        r = ahead[begin] = scores[begin]
        for i in range(begin + 1, begin + n):
            r = ahead[i] = scores[i] * (t01 + r * t11) / (t00 + r * t10)
        b = 1.0
        for i in range(begin + n - 2, begin - 1, -1):
            x = scores[i + 1] * b
            b = back[i] = (t10 + x * t11) / (t00 + x * t01)
        begin += n
    return ahead, back


def marginals(x: np.ndarray, per_text: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
    """P(good) of every line, with the parts that the gradient needs."""
    scores = np.exp(np.clip(x @ weights, -LIMIT, LIMIT))
    ahead, back = odds(scores.tolist(), np.exp(transitions).tolist(), per_text.tolist())
    ahead, back = np.array(ahead), np.array(back)
    both = ahead * back
    return both / (1 + both), scores, ahead, back


def fit(x: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = STEPS):
    """Weights and transitions of the largest penalised likelihood (Adam steps).
    ``labels`` holds one label per text."""
    y = np.repeat(labels, per_text).astype(float)
    theta, first, second = (np.zeros(x.shape[1] + 4) for _ in range(3))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per_text) - 1] = False
    left = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[left].astype(int), y[left + 1].astype(int)), 1)
    for step in range(1, steps + 1):
        weights, transitions = theta[:-4], theta[-4:].reshape(2, 2)
        p, scores, ahead, back = marginals(x, per_text, weights, transitions)
        table, coming = np.exp(transitions), scores[left + 1] * back[left + 1]
        cells = np.stack([np.full(len(left), table[0, 0]), table[0, 1] * coming, table[1, 0] * ahead[left], table[1, 1] * ahead[left] * coming])
        pairs = (cells / cells.sum(axis=0)).sum(axis=1)
        gradient = np.r_[x.T @ (y - p), seen.ravel() - pairs] / len(y) - RIDGE * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def line_means(p: np.ndarray, sizes: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Mean P(good) of the lines of each text, every line weighing its bytes plus one."""
    first = np.cumsum(per_text) - per_text
    return np.clip(np.add.reduceat(p * (sizes + 1), first) / np.add.reduceat(sizes + 1, first), 0, 1)


def calibrated(means: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    """Line means on the probability scale: a rising logistic curve over their log odds."""
    inner = np.clip(means, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-np.clip(scale[0] * np.log(inner / (1 - inner)) + scale[1], -LIMIT, LIMIT)))


def fit_scale(means: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """The logistic curve of the largest penalised likelihood (Newton steps). A
    document may hold good lines and still be bad, so means are not probabilities."""
    inner = np.clip(means, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(inner / (1 - inner)), np.ones(len(means))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -LIMIT, LIMIT)))
        gradient = x.T @ (labels - p) - 0.1 * (theta - [1, 0])
        theta = theta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
        theta = np.clip(theta, [0.05, -50], [20, 50])
    return float(theta[0]), float(theta[1])


def held_out(id_col: str | Column) -> Column:
    """True for the fifth of the ids that no fit may see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS):
    """Weights, transitions and scale from labelled documents outside the held-out fifth.

    ``labels`` has doc_id and quality; null qualities do not count, and of
    repeated labels the smallest. At most ``sample_docs`` ids are taken, those of
    the smallest hashes, so the joined side is bounded. Without any labelled row
    the weights are zero and every score is one half.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    text = whole("text")
    sample = docs.select("doc_id", text.alias("text")).filter(F.length(text) <= sample_chars)
    rows = sample.join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def work(batches):
        for batch in batches:
            x, sizes, per_text = line_features(batch.column(0).to_pylist())
            x = np.hstack([x, sizes[:, None]])
            # Numbers leave the task, not texts.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a.astype("<f4").tobytes() for a in np.split(x, np.cumsum(per_text)[:-1])], pa.binary()),
                    batch.column(1).cast(pa.int32()),
                ],
                names=["x", "label"],
            )

    got = rows.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(work, "x binary, label int").collect()
    width = 3 * OWN + 1
    if not got:
        return np.zeros(width), np.zeros((2, 2)), (1.0, 0.0)
    # The order of the rows must not decide the sums' last digits.
    got = sorted((bytes(r.x), r.label) for r in got)
    arrays = [np.frombuffer(x, "<f4").reshape(-1, width + 1) for x, _ in got]
    per_text, labels = np.array([len(a) for a in arrays]), np.array([y for _, y in got])
    x = np.vstack(arrays).astype(float)
    x, sizes = x[:, :-1], x[:, -1]
    weights, transitions = fit(x, per_text, labels)
    means = line_means(marginals(x, per_text, weights, transitions)[0], sizes, per_text)
    return weights, transitions, fit_scale(means, labels)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, good_lines, n_lines) of every row's whole text.

    ``score`` is the length-weighted mean P(good) of the lines on the probability
    scale; ``good_lines`` counts the lines above one half. Null texts are empty texts, which
    are one empty line and get the score of such a line. Null ids and repeated
    rows stay; other columns are not read.
    """
    weights, transitions, scale = model
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, [len(t) for t in texts], CHUNK_CHARS):
                x, sizes, per_text = line_features(texts[a:b])
                p = marginals(x, per_text, weights, transitions)[0]
                first = np.cumsum(per_text) - per_text
                total = calibrated(line_means(p, sizes, per_text), scale)
                good = np.add.reduceat(p > 0.5, first, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(arrow), pa.array(total), pa.array(good), pa.array(per_text, pa.int64())],
                    names=["id", "score", "good_lines", "n_lines"],
                )

    schema = f"id {kind.simpleString()}, score double, good_lines long, n_lines long"
    return docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)
