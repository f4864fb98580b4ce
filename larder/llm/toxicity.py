"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased; characters other than ASCII letters, digits and non-ASCII ones separate words.
Its features are the distinct n-grams of 4 to 7 characters within words, a word's borders included,
hashed to ``1 << BITS`` buckets. Each bucket is scaled by the smoothed log ratio of its document counts
in toxic and other training texts; a logistic regression with an L2 penalty is fitted on the scaled
features by L-BFGS.

Defined results: null and empty texts have no features and score the intercept; without labels the score
is 0.5 for all, with one class its smoothed share; a null ``doc_id`` is scored and not held out; rows that
repeat an id are scored one by one; an empty table gives an empty result; other columns are not read.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.base import query, table
from larder.llm.training import fitted, held_out, labelled_sample, scored

SAMPLE = 5000          # labelled documents a model is fitted on, at most
BITS = 20
SIZES = (4, 5, 6, 7)
LEAST_DOCS = 5         # buckets in fewer training texts are ignored
SMOOTHING, PENALTY = 1.0, 4.0
THRESHOLD = 0.3
MODULUS, REMAINDER = 4, 2

SPACE = 32
FOLD = np.array([c if chr(c).isalnum() else SPACE for c in range(128)], np.uint64)
STEP, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> np.ndarray:
    """The buckets of all n-grams, repeats included."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ascii_ = chars < 128
    chars[ascii_] = FOLD[chars[ascii_]]
    inner = chars != SPACE
    hashes, whole, found = chars.copy(), None, []
    for n in range(2, max(SIZES) + 1):
        m = len(chars) - n + 1
        if m < 1:
            break
        hashes = hashes[:m] * STEP + chars[n - 1:]
        if n >= 3:
            whole = inner[1:m + 1] if whole is None else whole[:m] & inner[n - 2:n - 2 + m]
            if n in SIZES:
                found.append(((hashes + np.uint64(n)) * MIX >> np.uint64(64 - BITS))[whole])
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


class Distinct:
    """Distinct values below a bound in linear time."""

    def __init__(self, size: int):
        self.last = np.zeros(size, np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = np.arange(len(values))
        self.last[values] = at
        return values[self.last[values] == at]


def minimise(f, x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; ``f(x)`` gives value and gradient."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, kept = grad.copy(), []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            direction += (a - (y @ direction) / (s @ y)) * s
        slope, size = grad @ direction, 1.0 if steps else 1.0 / max(1.0, np.abs(grad).sum())
        while size > 1e-10:
            new = x - size * direction
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def fit(texts: list[str], labels: list[int]) -> bytes:
    """Scaled weights of all buckets and the intercept, as float32."""
    y = np.array(labels, np.float64)
    size = 1 << BITS
    share = (y.sum() + 1) / (len(y) + 2)
    model = np.zeros(size + 1, np.float32)
    model[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return model.tobytes()
    distinct = Distinct(size)
    rows = [distinct(buckets(t)).astype(np.int32) for t in texts]
    number = np.zeros(size, np.int64)
    for r in rows:
        number[r] += 1
    kept = np.flatnonzero(number >= LEAST_DOCS)
    if not len(kept):
        return model.tobytes()
    place = np.full(size, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    lengths = np.array([len(r) for r in rows])
    columns, row = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    toxic = SMOOTHING + np.bincount(columns, y[row], len(kept))
    other = SMOOTHING + np.bincount(columns, (1 - y)[row], len(kept))
    ratio = np.log(toxic / (y.sum() + 2 * SMOOTHING)) - np.log(other / ((1 - y).sum() + 2 * SMOOTHING))

    def loss(w):
        z = np.bincount(row, (ratio * w[:-1])[columns], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        value = np.logaddexp(0, np.where(y > 0, -z, z)).sum() + PENALTY / 2 * (w[:-1] @ w[:-1])
        grad = np.bincount(columns, (p - y)[row], len(kept)) * ratio + PENALTY * w[:-1]
        return value, np.append(grad, (p - y).sum())

    w = minimise(loss, np.append(np.zeros(len(kept)), model[-1]))
    model[kept] = ratio * w[:-1]
    model[-1] = w[-1]
    return model.tobytes()


def load(model: bytes) -> tuple[np.ndarray, Distinct]:
    return np.frombuffer(model, np.float32), Distinct(1 << BITS)


def score(model: tuple[np.ndarray, Distinct], texts: list[str]) -> np.ndarray:
    weights, distinct = model
    z = np.array([weights[distinct(buckets(t))].sum(dtype=np.float64) for t in texts], np.float64) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, text, held_out and the toxicity score of every document."""
    held = held_out(MODULUS, REMAINDER)
    model = fitted(labelled_sample(docs, labels, "toxic", held, limit), fit)
    out = scored(docs.select("doc_id", "text"), model, load, score)
    return out.select("doc_id", "text", held.alias("held_out"), "score")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
