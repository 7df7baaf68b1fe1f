"""A recurrent head over evidence sequences, trained by data-parallel epochs that resume where they stopped.

A step holds every channel's value, availability and confidence (missing: zeros). They are normalised over the step, a gated recurrent
unit runs along the sequence up to its last step with evidence, and two layers give the logit of its state there.

Sequences are packed once into shards, a row each. An epoch maps over the shards (forward and backward through time,
one shard's gradient each), adds gradients in order of shards, in two levels, and takes one step of Adam on the driver, which
sees a few vectors of the model's size and no sequence. After every epoch weights, moments, the best weights so far and the history are a table below
the given path: a run that is stopped goes on from there and ends with the same bits as one that was not.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import stored

#: Sequences of one shard, and shards whose gradients one task adds up.
SHARD, FAN = 256, 64
EPSILON = 1e-5


@dataclass(frozen=True)
class Shape:
    channels: int
    hidden: int = 32

    def sizes(self) -> list[tuple[str, tuple[int, ...]]]:
        i, h = 3 * self.channels, self.hidden
        return [("gain", (i,)), ("shift", (i,)), ("wi", (3 * h, i)), ("wh", (3 * h, h)), ("bi", (3 * h,)), ("bh", (3 * h,)), ("w1", (h, h)), ("b1", (h,)), ("w2", (h,)), ("b2", (1,))]

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in self.sizes():
            n = int(np.prod(size))
            out[name], at = flat[at : at + n].reshape(size), at + n
        return out

    def flat(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.asarray(parts[name], float).ravel() for name, _ in self.sizes()])

    def start(self, seed: int) -> np.ndarray:
        rng, bound = np.random.default_rng(seed), 1 / np.sqrt(self.hidden)
        parts = {name: rng.uniform(-bound, bound, size) for name, size in self.sizes()}
        parts["gain"], parts["shift"] = np.ones_like(parts["gain"]), np.zeros_like(parts["shift"])
        return self.flat(parts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(shape: Shape, flat: np.ndarray, x: np.ndarray, length: np.ndarray):
    """Logits of sequences x (n, steps, 3 x channels) and what the way back needs. The state stands still behind a sequence's length."""
    p, h = shape.split(flat), shape.hidden
    mean, var = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    unit = (x - mean) / np.sqrt(var + EPSILON)
    inputs = (unit * p["gain"] + p["shift"]) @ p["wi"].T + p["bi"]
    state, trail = np.zeros((len(x), h)), []
    for t in range(x.shape[1]):
        back = state @ p["wh"].T + p["bh"]
        r, z = _sigmoid(inputs[:, t, :h] + back[:, :h]), _sigmoid(inputs[:, t, h : 2 * h] + back[:, h : 2 * h])
        n = np.tanh(inputs[:, t, 2 * h :] + r * back[:, 2 * h :])
        live = (t < length)[:, None]
        trail.append((state, r, z, n, back[:, 2 * h :], live))
        state = np.where(live, (1 - z) * n + z * state, state)
    hidden = state @ p["w1"].T + p["b1"]
    return np.maximum(hidden, 0) @ p["w2"] + p["b2"][0], (unit, var, trail, state, hidden)


def gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of the logits, and its gradient."""
    p, h = shape.split(flat), shape.hidden
    logit, (unit, var, trail, state, hidden) = forward(shape, flat, x, length)
    loss = float((np.logaddexp(0, logit) - y * logit).sum())
    g = {name: np.zeros(size) for name, size in shape.sizes()}
    d = _sigmoid(logit) - y
    g["b2"][0], g["w2"] = d.sum(), np.maximum(hidden, 0).T @ d
    dh = np.outer(d, p["w2"]) * (hidden > 0)
    g["w1"], g["b1"] = dh.T @ state, dh.sum(0)
    ds, scaled = dh @ p["w1"], unit * p["gain"] + p["shift"]
    dx = np.zeros_like(scaled)
    for t in range(len(trail) - 1, -1, -1):
        before, r, z, n, bn, live = trail[t]
        dn, dz = ds * (1 - z) * (1 - n * n) * live, ds * (before - n) * z * (1 - z) * live
        dr = dn * bn * r * (1 - r)
        di, db = np.concatenate([dr, dz, dn], 1), np.concatenate([dr, dz, dn * r], 1)
        g["wi"] += di.T @ scaled[:, t]
        g["bi"] += di.sum(0)
        g["wh"] += db.T @ before
        g["bh"] += db.sum(0)
        dx[:, t] = di @ p["wi"]
        ds = np.where(live, ds * z, ds) + db @ p["wh"]
    g["gain"], g["shift"] = (dx * unit).sum((0, 1)), dx.sum((0, 1))
    return loss, shape.flat(g)


# --- sequences as shards -------------------------------------------------------------------------


def _blob(**arrays) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def pack_sequences(steps: DataFrame, channels: list[str], names: dict[str, str]) -> DataFrame:
    """(shard, fold, content): whole sequences of up to about ``SHARD`` ids a shard.

    Steps: sequence_id, step, fold (``train``, ``validation`` or another), label (0 or 1), and for every channel the columns ``{channel}{suffix}`` of
    ``names`` (value, confidence). A missing or non-finite value is unavailable; a confidence is held to 0..1 (missing: 0). A sequence without any
    evidence is one step of zeros.
    """
    per_fold = {r["fold"]: r["n"] for r in steps.groupBy("fold").agg(F.count_distinct("sequence_id").alias("n")).collect()}
    shards = F.lit(1)
    for fold, n in per_fold.items():
        shards = F.when(F.col("fold") == fold, F.lit(max(1, n // SHARD))).otherwise(shards)
    value, confidence = ([f"{c}{names[k]}" for c in channels] for k in ("value", "confidence"))
    rows = steps.select(F.col("sequence_id").cast("string").alias("sequence_id"), "step", "fold", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(value)], *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(confidence)])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("sequence_id"), shards).cast("int"))
    k = len(channels)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "step"])
        v, c = (pdf[[f"{a}{i}" for i in range(k)]].to_numpy(float) for a in "vc")
        known = np.isfinite(v)
        x = np.hstack([np.where(known, v, 0.0), known, np.where(known, np.clip(np.nan_to_num(c, nan=0.0), 0, 1), 0.0)])
        ids = pdf["sequence_id"].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        size = np.diff(np.append(begin, len(ids)))
        content = _blob(ids=ids[begin].astype(str), x=x.astype(np.float32), size=size, y=pdf["label"].to_numpy(float)[begin])
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "content": [content]})

    return stored(rows.groupBy("fold", "shard").applyInPandas(pack, "fold string, shard int, content binary"), "sequences")


def _padded(content: bytes):
    """(ids, x, length, y) of a shard: padded to its longest sequence, lengths up to the last step with evidence."""
    with np.load(io.BytesIO(content)) as f:
        ids, flat, size, y = (f[n] for n in ("ids", "x", "size", "y"))
    k, steps = flat.shape[1] // 3, int(size.max())
    x = np.zeros((len(ids), steps, flat.shape[1]))
    row = np.repeat(np.arange(len(ids)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    x[row, at] = flat
    seen = x[:, :, k : 2 * k].any(-1)
    length = np.where(seen.any(1), steps - seen[:, ::-1].argmax(1), 1)
    return ids, x, length, y


def _epoch(packed: DataFrame, fold: str, shape: Shape, flat: np.ndarray, with_gradient: bool) -> tuple[float, int, np.ndarray]:
    """Mean loss over a fold, its sequences, and the mean gradient."""
    held = packed.sparkSession.sparkContext.broadcast(flat)  # the model: its size is the shape's

    def one(batches):
        for pdf in batches:
            out = []
            for shard, content in zip(pdf["shard"], pdf["content"], strict=True):
                _, x, length, y = _padded(content)
                if with_gradient:
                    loss, g = gradient(shape, held.value, x, length, y)
                else:
                    logit, _ = forward(shape, held.value, x, length)
                    loss, g = float((np.logaddexp(0, logit) - y * logit).sum()), np.zeros(0)
                out.append((shard // FAN, shard, loss, len(y), g.tobytes()))
            yield pd.DataFrame(out, columns=["part", "shard", "loss", "n", "g"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        g = np.sum([np.frombuffer(b) for b in pdf["g"]], axis=0)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "loss": [float(np.sum(pdf["loss"].to_numpy()))], "n": [int(pdf["n"].sum())], "g": [g.tobytes()]})

    schema = "part int, loss double, n long, g binary"
    parts = packed.where(F.col("fold") == fold).select("shard", "content").mapInPandas(one, "part int, shard int, loss double, n long, g binary")
    rows = sorted(parts.groupBy("part").applyInPandas(add, schema).collect(), key=lambda r: r["part"])
    n = sum(r["n"] for r in rows)
    if not n:
        return float("nan"), 0, np.zeros(len(flat))
    total = np.sum([np.frombuffer(bytes(r["g"])) for r in rows], axis=0)
    return sum(r["loss"] for r in rows) / n, n, total / n if with_gradient else total


# --- the loop ------------------------------------------------------------------------------------


def _done(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _save(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(bytearray(_blob(**state)),)], "state binary").coalesce(1).write.mode("overwrite").parquet(path)


def _load(spark: SparkSession, path: str) -> dict:
    with np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["state"]))) as f:
        return {k: f[k] for k in f.files}


@dataclass
class Head:
    shape: Shape
    weights: np.ndarray
    best_epoch: int
    #: (training loss, validation loss) of every epoch.
    history: np.ndarray


def train(packed: DataFrame, shape: Shape, path: str, epochs: int = 20, rate: float = 0.02, seed: int = 0) -> Head:
    """Fit on the fold ``train``; the epoch with the least validation loss (the earlier of equals) gives the weights.

    ``path`` (in the shared folder) holds one table an epoch. A call with a path that already has some goes on behind the last complete one.
    Without a validation fold the training loss decides.
    """
    spark = packed.sparkSession
    first = 0
    while first < epochs and _done(spark, f"{path}/epoch-{first + 1:05d}"):
        first += 1
    if first:
        s = _load(spark, f"{path}/epoch-{first:05d}")
    else:
        w = shape.start(seed)
        s = {"w": w, "m": np.zeros_like(w), "v": np.zeros_like(w), "best": w, "best_loss": np.array(np.inf), "best_epoch": np.array(0), "history": np.zeros((0, 2))}
    for epoch in range(first + 1, epochs + 1):
        loss, n, g = _epoch(packed, "train", shape, s["w"], True)
        if not n:
            raise ValueError("there are no training sequences")
        m, v = 0.9 * s["m"] + 0.1 * g, 0.999 * s["v"] + 0.001 * g * g
        w = s["w"] - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        judged, held, _ = _epoch(packed, "validation", shape, w, False)
        judged = judged if held else loss
        better = judged < float(s["best_loss"])
        s = {
            "w": w, "m": m, "v": v, "best": w if better else s["best"], "best_loss": np.array(judged if better else s["best_loss"]), "best_epoch": np.array(epoch if better else s["best_epoch"]),
            "history": np.vstack([s["history"], [[loss, judged]]]),
        }
        _save(spark, f"{path}/epoch-{epoch:05d}", s)
    return Head(shape, s["best"], int(s["best_epoch"]), s["history"])


def score(packed: DataFrame, head: Head, threshold: float = 0.5) -> DataFrame:
    """sequence_id, fold, label, probability, predicted of every sequence."""
    held = packed.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for pdf in batches:
            for fold, content in zip(pdf["fold"], pdf["content"], strict=True):
                ids, x, length, y = _padded(content)
                logit, _ = forward(held.value.shape, held.value.weights, x, length)
                p = _sigmoid(logit)
                yield pd.DataFrame({"sequence_id": ids, "fold": fold, "label": y, "probability": p, "predicted": (p >= threshold).astype(np.int32)})

    return packed.select("fold", "content").mapInPandas(run, "sequence_id string, fold string, label double, probability double, predicted int")
