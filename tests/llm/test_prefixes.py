"""op13 against whole lists of turns in DuckDB and plain Python."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm import ordered, prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks():
    """Shared openings, copies, a conversation of many turns and one that leaves it late, nulls and repeated rows."""
    rng = random.Random(5)
    rows = []
    for c in [*range(-3, 70), 400, 401, 419]:
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["hello there", "yes", "no\tnever", None, "é ü"])))
    long = [(t, "user", f"w{t} x") for t in range(150)]
    for c, leave in ((100, 150), (120, 150), (140, 97), (160, 33), (180, 32), (200, 64), (220, 65)):
        rows += [(c, *turn) for turn in long[:leave]]
        rows += [(c, leave + i, "assistant", f"c{c} {i % 3}") for i in range(c % 7 * 9)]
    rows += [(7, None, "user", "before all"), (7, None, "user", "before all"), (9, 0, "user", "same turn"), (None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def found(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(talks(), SCHEMA).withColumn("_part", F.lit("x")).withColumn("depth", F.lit(None).cast("long"))
        yield prefixes.prefix_trie(df).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_op13_oracle(found):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(talks(), columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(prefixes.ORACLE).df()
    a, b = (t[COLUMNS].sort_values(["conv_id", "depth"]).reset_index(drop=True) for t in (found, want))
    assert len(a) == len(b)
    for c in COLUMNS:
        assert (a[c].fillna(-(10**9)) == b[c].fillna(-(10**9))).all(), c


def test_op13_intervals(found):
    """Preorder is a permutation, children lie inside their parents, and rebuilt heads come from the base."""
    assert sorted(found.preorder) == list(range(len(found)))
    node = {(r.conv_id, r.depth): r for r in found.itertuples()}
    for r in found.itertuples():
        assert r.subtree_end > r.preorder
        if r.depth:
            p = node[(int(r.parent_conv_id), r.depth - 1)]
            assert p.preorder < r.preorder and r.subtree_end <= p.subtree_end
    assert found.depth.max() > 4 * prefixes.BLOCK
    root = found[found.depth == 0].iloc[0]
    assert root.n_convs == len({r[0] for r in talks()} - {None})
    assert all(zlib.crc32(str(c).encode()) % 4 in (0, 1, 2, 3) for c in range(9))


def test_op13_turnless_and_empty(spark):
    few = [(c, 0, "user", "only") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    got = prefixes.prefix_trie(spark.createDataFrame(few, SCHEMA)).collect()
    assert len(got) == 1 and got[0]["n_convs"] == len(few) and got[0]["n_leaves"] == 1 and got[0]["depth"] == 0
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_of_a_large_node(spark):
    ids = list(range(5, 60_000, 3))
    df = spark.createDataFrame(pd.DataFrame({"x1": 7, "x2": np.int64(9), "conv_id": np.array(ids, np.int64)})).repartition(4)
    import hashlib

    got = prefixes.member_digests(df).collect()
    assert [(r["x1"], r["sha"]) for r in got] == [(7, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_numbered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    got = ordered.numbered(df, "numbers", [F.col("v").desc()]).orderBy("_place").collect()
    assert [r["_place"] for r in got] == list(range(5000))
    assert [r["v"] for r in got] == sorted((r["v"] for r in got), reverse=True)
