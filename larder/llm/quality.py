"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only documents have labels. Each passage gives the
shares of its pairs of character kinds (letters by case, digits, kinds of marks, spaces) and measures of
its words (distinct, repeated, lengths); a tanh layer encodes them. A gated attention
``softmax(w (tanh(V h) * sigmoid(U h)))`` weighs the passages of a document, and a logistic unit scores
the weighted sum of their encodings. All layers are learnt together from the document labels with Adam.

Defined results: null and empty texts are one empty passage; without labels the score is 0.5 for all,
with one class its smoothed share; a null ``doc_id`` is scored and not held out; rows that repeat an id
are scored one by one; an empty table gives an empty result; other columns are not read.
"""

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.base import free_name, query, table
from larder.llm.training import fitted, held_out, labelled_sample, scored

SAMPLE = 4000          # labelled documents a model is fitted on, at most
PASSAGE = 64
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE, DECAY = 20, 64, 3e-3, 1e-4
THRESHOLD = 0.5
MODULUS, REMAINDER = 3, 1
PIECE_BYTES = 1 << 22  # of a document whose passages are encoded at a time

KINDS = (" \t\r\v\f", "\n", ".?", ",;:", "!", "'\"`", "()[]{}", "-_/", "|", "#$%&*@^~+=<>\\")
N_KINDS = len(KINDS) + 5


def _kinds() -> np.ndarray:
    table = np.full(256, N_KINDS - 1, np.int64)  # control characters
    for kind, chars in enumerate(KINDS):
        table[[ord(c) for c in chars]] = kind
    for kind, chars in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100))):
        table[list(chars)] = len(KINDS) + kind
    return table


KIND = _kinds()
N_PAIRS = N_KINDS * N_KINDS
N_FEATURES = N_PAIRS + 6


def passages(text: str) -> np.ndarray:
    """One row of features per passage of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, -(-len(words) // PASSAGE))
    out = np.zeros((n, N_FEATURES))
    if not words:
        return out
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(data, np.uint8)
    inside = KIND[raw] > 1
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])[::PASSAGE]
    bounds = np.r_[0, starts[1:], len(raw)]
    at = 0
    while at < n:
        # Passages one after another until they hold PIECE_BYTES, to bound the working memory.
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE_BYTES, "right")) - 1)
        to = min(to, n)
        kinds = KIND[raw[bounds[at]:bounds[to] + 1]]
        owner = np.repeat(np.arange(to - at), np.diff(bounds[at:to + 1]))[:len(kinds) - 1]
        pair = owner * N_PAIRS + kinds[:-1] * N_KINDS + kinds[1:]
        counts = np.bincount(pair, minlength=(to - at) * N_PAIRS).reshape(to - at, N_PAIRS)
        out[at:to, :N_PAIRS] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        at = to
    owner = np.arange(len(words)) // PASSAGE
    number = np.bincount(owner, minlength=n)
    hashes = np.fromiter(map(hash, words), np.int64, len(words))
    order = np.lexsort((hashes, owner))
    fresh = np.r_[True, (np.diff(hashes[order]) != 0) | (np.diff(owner[order]) != 0)]
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])]
    mean = np.bincount(owner, sizes, n) / number
    extra = (np.bincount(owner[order], fresh, n) / number, np.bincount(owner, again, n) / number, mean / 10,
             np.sqrt(np.maximum(np.bincount(owner, sizes.astype(float) ** 2, n) / number - mean ** 2, 0)) / 10,
             np.log1p(number) / 5, np.full(n, len(set(words)) / len(words)))
    out[:, N_PAIRS:] = np.stack(extra, axis=1)
    return out


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
    return {"W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION),
            "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1)}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def forward(p: dict, x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> dict:
    """Encodings, attention and scores; ``first`` is each bag's first passage, ``bag`` each passage's bag."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": sigmoid(z @ p["c"] + p["d"][0])}


def gradients(p: dict, x: np.ndarray, first: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean cross-entropy."""
    f = forward(p, x, first, bag)
    h, t, s, a = f["h"], f["t"], f["s"], f["a"]
    out = (f["p"] - y) / len(y)
    dz = (out[:, None] * p["c"])[bag]
    da = (h * dz).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[bag])
    gate = de[:, None] * p["w"]
    dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de,
            "c": f["z"].T @ out, "d": np.array([out.sum()])}


def bags(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.r_[0, np.cumsum(n)[:-1]], np.repeat(np.arange(len(rows)), n)


def fit(texts: list[str], labels: list[int]) -> bytes:
    """The parameters of the network and the scale of its inputs."""
    y, rng = np.array(labels, np.float64), np.random.default_rng(7)
    p, mean, scale = initial(rng), np.zeros(N_FEATURES), np.ones(N_FEATURES)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        p["c"][:] = 0
        p["d"][:] = np.log(share / (1 - share))
    else:
        rows = [passages(t).astype(np.float32) for t in texts]
        ends = np.cumsum([len(r) for r in rows])
        every = np.concatenate(rows)
        mean, scale = every.mean(0, dtype=np.float64), np.maximum(every.std(0, dtype=np.float64), 1e-3)
        every -= mean.astype(np.float32)
        every /= scale.astype(np.float32)
        rows = np.split(every, ends[:-1])
        p["d"][:] = np.log(share / (1 - share))
        m, v, step = {k: 0 * x for k, x in p.items()}, {k: 0 * x for k, x in p.items()}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at:at + BATCH]
                grads, step = gradients(p, *bags([rows[i] for i in part]), y[part]), step + 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
                                          + DECAY * p[k])
    held = io.BytesIO()
    np.savez(held, mean=mean, scale=scale, **p)
    return held.getvalue()


def load(model: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(model)) as stored:
        return dict(stored)


def score(model: dict, texts: list[str]) -> np.ndarray:
    out = []
    for at in range(0, len(texts), 256):
        rows = [(passages(t) - model["mean"]) / model["scale"] for t in texts[at:at + 256]]
        out.append(forward(model, *bags(rows))["p"])
    return np.concatenate(out) if out else np.empty(0)


def quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``, the quality of every document."""
    sample = labelled_sample(docs, labels, "quality", held_out(MODULUS, REMAINDER), limit)
    return scored(docs, fitted(sample, fit), load, score, into)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score as good, unchanged."""
    score_name = free_name("score", docs)
    return quality(docs, labels, into=score_name).where(F.col(score_name) >= THRESHOLD).drop(score_name)


@query("op10_quality")
def op10_quality(spark, sf_dir):
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(MODULUS, REMAINDER).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
