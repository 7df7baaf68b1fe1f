"""Quality by a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes, ``STRIDE`` apart, are max-pooled over chunks of two halves of ``HALF``
bytes; chunks overlap by one half and cover the whole document. A hidden layer judges every chunk by
what its filters found; the mean and the maximum of its units over all chunks
give one probability. Nothing but the bytes goes in: their embedding, the filters and both layers are learned.

A filter over embedded bytes is a sum of ``WIDTH`` table rows, one for each offset, so
scoring is table lookups and sums, without an unfolded input.

Training: Adam on at most about ``PER_CLASS`` documents of each label, whole texts (a bounded, documented
sample of rows); every epoch reads one window of each, drawn anew anywhere in the text. Scores read whole
texts and nothing else.

Cases: a null or empty text is one chunk of padding and gets a score; without labels
of both kinds the score is the fold's share of label 1 (0.5 without labels); rows that
share a doc_id are scored each by its own text; further columns are ignored; an empty
table gives no rows. A chunk's padding behind the text is byte 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import training_sample
from .langid import held_out
from .storage import document_batches, lean
from .textkernel import as_bytes, slices

PER_CLASS = 1500
WINDOWS = (256, 2048)
WIDTH = 8
STRIDE = 2
HALF = 32
FILTERS = 24
EMBED = 8
HIDDEN = 16
EPOCHS = 32
BATCH = 64
RATE = 0.01


@dataclass
class Model:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    constant: float | None = None


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each text padded to whole halves, and its first half's number."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // HALF)))])
    out = np.zeros(int(first[-1]) * HALF + WIDTH, np.uint8)
    for text, f in zip(texts, first.tolist(), strict=False):
        out[f * HALF : f * HALF + len(text)] = np.frombuffer(text, np.uint8)
    return out, first


def _convolve(code: np.ndarray, tables: np.ndarray) -> np.ndarray:
    n = (len(code) - WIDTH) // STRIDE
    out = tables[0][code[: n * STRIDE : STRIDE]]
    for j in range(1, WIDTH):
        out += tables[j][code[j : j + n * STRIDE : STRIDE]]
    return out


def _pool(half: np.ndarray, first: np.ndarray):
    """Chunk maxima from half maxima: chunk i of a text joins its halves i and i + 1 (the last stands alone)."""
    chunk = half.copy()
    last = np.zeros(len(half), bool)
    last[first[1:] - 1] = True
    inner = np.flatnonzero(~last)
    chunk[inner] = np.maximum(half[inner], half[inner + 1])
    # The last half is inside the chunk before it already, unless it is the only one.
    alone = first[1:] - first[:-1] == 1
    keep = ~last
    keep[first[:-1][alone]] = True
    return chunk, np.flatnonzero(keep)


def _documents(unit: np.ndarray, keep: np.ndarray, first: np.ndarray):
    """First chunk and number of chunks of each text, mean and maximum of its chunks' units."""
    begin = np.searchsorted(keep, first[:-1])
    count = np.diff(np.append(begin, len(keep)))
    return begin, count, np.add.reduceat(unit, begin, axis=0) / count[:, None], np.maximum.reduceat(unit, begin, axis=0)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def forward(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores of some texts."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    out = []
    for lo, hi in slices(texts, 1 << 20):
        code, first = padded(texts[lo:hi])
        half = np.empty((int(first[-1]), FILTERS), np.float32)
        step = 1 << 12  # halves at a time: temporaries stay small for texts of any length
        for a in range(0, len(half), step):
            b = min(len(half), a + step)
            conv = _convolve(code[a * HALF : b * HALF + WIDTH], model.tables)
            half[a:b] = conv.reshape(b - a, HALF // STRIDE, FILTERS).max(axis=1)
        chunk, keep = _pool(half + model.bias, first)
        unit = np.tanh(np.maximum(chunk[keep], 0) @ model.w1 + model.b1)
        _, _, mean, most = _documents(unit, keep, first)
        out.append(_probability(np.concatenate([mean, most], axis=1) @ model.w2 + model.b2))
    return np.concatenate(out).astype(float) if out else np.zeros(0)


def gradients(p: dict[str, np.ndarray], texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean log loss of some texts and its derivatives."""
    code, first = padded(texts)
    tables = np.einsum("se,jef->jsf", p["e"], p["f"])
    conv = _convolve(code, tables.astype(np.float32)).reshape(-1, HALF // STRIDE, FILTERS)
    where = conv.argmax(axis=1)
    half = np.take_along_axis(conv, where[:, None], axis=1)[:, 0].astype(float) + p["fb"]
    chunk, keep = _pool(half, first)
    act = np.maximum(chunk[keep], 0)
    unit = np.tanh(act @ p["w1"] + p["b1"])
    begin, count, mean, most = _documents(unit, keep, first)
    x = np.concatenate([mean, most], axis=1)
    out = _probability(x @ p["w2"] + p["b2"][0])
    loss = -float((weight * np.log(np.where(y == 1, out, 1 - out) + 1e-12)).mean())
    dz = (out - y) * weight / len(y)
    dx = dz[:, None] * p["w2"]
    owner = np.repeat(np.arange(len(y)), count)
    du = (dx[:, :HIDDEN] / count[:, None])[owner] + np.where(unit == most[owner], dx[:, HIDDEN:][owner], 0.0)
    dh = du * (1 - unit**2)
    g = {"w2": x.T @ dz, "b2": np.array([dz.sum()]), "w1": act.T @ dh, "b1": dh.sum(axis=0)}
    da = (dh @ p["w1"].T) * (act > 0)
    # A chunk's gradient goes to the half that had its maximum, and there to the bytes under the best place.
    right = np.minimum(keep + 1, len(half) - 1)[:, None]
    to = np.where(half[keep] >= chunk[keep], keep[:, None], right)
    column = np.broadcast_to(np.arange(FILTERS), to.shape)
    dhalf = np.bincount((to * FILTERS + column).ravel(), da.ravel(), half.size).reshape(half.shape)
    g["fb"] = dhalf.sum(axis=0)
    n, f = np.nonzero(dhalf)
    at, value = n * HALF + where[n, f] * STRIDE, dhalf[n, f]
    dt = np.stack([np.bincount(code[at + j].astype(np.int64) * FILTERS + f, value, 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
    g["e"], g["f"] = np.einsum("jsf,jef->se", dt, p["f"]), np.einsum("jsf,se->jef", dt, p["e"])
    return loss, g


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "e": rng.normal(0, 0.5, (256, EMBED)),
        "f": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)),
        "fb": np.zeros(FILTERS),
        "w1": rng.normal(0, 0.3, (FILTERS, HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 0.3, 2 * HIDDEN),
        "b2": np.zeros(1),
    }


def train(sample: list[tuple[str, int]], counts: dict[int, int], seed: int = 5) -> Model:
    """Fit on (text, quality) pairs; ``counts`` are the labels' true frequencies."""
    y = np.array([v for _, v in sample], float)
    if len(y) == 0 or y.min() == y.max():
        total = sum(counts.values())
        none = (np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros((FILTERS, HIDDEN)), np.zeros(HIDDEN), np.zeros(2 * HIDDEN), 0.0)
        return Model(*none, constant=counts.get(1, 0) / total if total else 0.5)
    rng = np.random.default_rng(seed)
    p = initial(rng)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    share = {0: counts.get(0, 1) / (1 - y).sum(), 1: counts.get(1, 1) / y.sum()}
    weight = np.where(y == 1, share[1], share[0])
    weight = np.sqrt(weight / weight.mean())  # half way between the classes' balance and their true shares
    texts = as_bytes([t for t, _ in sample])
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (0.1 ** (epoch / EPOCHS))
        order = rng.permutation(len(y))
        size = rng.integers(*WINDOWS, len(y))
        begin = (rng.random(len(y)) * np.maximum(1, np.fromiter(map(len, texts), np.int64, len(y)) - size + 1)).astype(np.int64)
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            _, g = gradients(p, [texts[i][begin[i] : begin[i] + size[i]] for i in pick.tolist()], y[pick], weight[pick])
            step += 1
            for k, v in g.items():
                if k in ("w1", "w2"):
                    v = v + 1e-3 * p[k]
                m, s = moment[k]
                m[:] = 0.9 * m + 0.1 * v
                s[:] = 0.999 * s + 0.001 * v * v
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    tables = np.einsum("se,jef->jsf", p["e"], p["f"]).astype(np.float32)
    return Model(tables, p["fb"].astype(np.float32), p["w1"], p["b1"], p["w2"], float(p["b2"][0]))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(*training_sample(docs, labels, "quality", per_class))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (doc_id, text)."""
    document_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = forward(held.value, as_bytes(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA)
