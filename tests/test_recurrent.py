"""The recurrent head: numeric gradients, planted sequences, and a stopped run."""

import numpy as np
import pytest

from tessella.operators import recurrent


def test_gradient_is_numeric():
    rng = np.random.default_rng(0)
    shape = recurrent.Shape(2, 3)
    flat = shape.start(1) + rng.normal(0, 0.1, len(shape.start(1)))
    x, length, y = rng.normal(size=(5, 4, 6)), np.array([4, 1, 3, 2, 4]), np.array([1.0, 0, 1, 1, 0])
    loss, g = recurrent.gradient(shape, flat, x, length, y)
    for i in range(len(flat)):
        d = np.zeros_like(flat)
        d[i] = 1e-6
        up, down = (recurrent.gradient(shape, flat + s * d, x, length, y)[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    # What stands behind a sequence's length has no effect.
    x[1, 1:] = 99.0
    assert recurrent.gradient(shape, flat, x, length, y)[0] == pytest.approx(loss)


@pytest.fixture(scope="module")
def packed(spark):
    """A sequence is positive if its first channel rises: the order of steps decides, not their sum."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        n = int(rng.integers(4, 9))
        v = np.sort(rng.normal(size=n)) if k % 2 else np.sort(rng.normal(size=n))[::-1]
        fold = ("train", "train", "validation", "test")[k // 2 % 4]
        for t in range(n):
            missing = rng.random() < 0.1
            rows.append((k, t, fold, k % 2, None if missing else float(v[t]), float("nan") if missing else 0.9, float(rng.normal()), 0.5))
    rows.append((9999, 0, "test", 0, None, None, float("nan"), None))
    df = spark.createDataFrame(rows, "sequence_id long, step int, fold string, label int, a_value double, a_confidence double, b_value double, b_confidence double").repartition(3)
    return recurrent.pack_sequences(df, ["a", "b"], {"value": "_value", "confidence": "_confidence"})


def test_head_learns_order(spark, packed, tmp_path):
    shape = recurrent.Shape(2, 8)
    head = recurrent.train(packed, shape, f"file://{tmp_path}/run", epochs=25, rate=0.05)
    assert head.history[-1, 0] < head.history[0, 0] and head.history[head.best_epoch - 1, 1] == head.history[:, 1].min()
    got = recurrent.score(packed, head).toPandas()
    assert len(got) == 901 and got.sequence_id.nunique() == 901
    held = got[(got.fold == "test") & (got.sequence_id != "9999")]
    p, n = held[held.label == 1].probability.to_numpy(), held[held.label == 0].probability.to_numpy()
    auc = (p[:, None] > n[None]).mean()
    assert auc > 0.9


def test_stopped_run_ends_with_the_same_bits(spark, packed, tmp_path):
    shape = recurrent.Shape(2, 4)
    whole = recurrent.train(packed, shape, f"file://{tmp_path}/whole", epochs=4)
    recurrent.train(packed, shape, f"file://{tmp_path}/stopped", epochs=2)
    resumed = recurrent.train(packed, shape, f"file://{tmp_path}/stopped", epochs=4)
    assert (whole.weights == resumed.weights).all() and (whole.history == resumed.history).all() and whole.best_epoch == resumed.best_epoch
