"""Connected components of an edge table, without any node's neighbours in one place.

Each round runs a union-find inside every partition of the edges (bounded by the
partition), which leaves stars (node, local root), then lets every node that
several partitions know join its local roots by their minimum. What remains is a
much smaller graph among roots. The rounds' node -> root maps are composed at the
end. Rounds end when no edge is left; their tables lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, lean, materialize


class UnionFind:
    """Union-find over 64-bit keys; a root is the smallest key of its set."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


#: Nodes a task holds at once; beyond them it begins anew, and a later round joins the parts.
NODES = 500_000


def _local(batches):
    import pyarrow as pa

    def stars(uf):
        nodes = list(uf.up)
        for lo in range(0, len(nodes), 65536):
            part = nodes[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([uf.find(x) for x in part], pa.int64())], names=["node", "root"])

    uf = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uf.union(a, b)
        if len(uf.up) > NODES:
            yield from stars(uf)
            uf = UnionFind()
    yield from stars(uf)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b: long); the
    component is its smallest node. Nodes without an edge don't appear."""
    spark = edges.sparkSession
    rest = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    maps: list[DataFrame] = []
    while True:
        stars = materialize(rest.mapInArrow(lean(_local), "node long, root long"), f"{name}-stars")
        least = materialize(stars.groupBy("node").agg(F.min("root").alias("up")), f"{name}-least")
        maps.append(least)
        # Local roots of one node are one component: link each with the least.
        links = stars.join(least, "node").where("root <> up").select(F.col("root").alias("a"), F.col("up").alias("b")).distinct()
        rest = materialize(links.repartition("a"), f"{name}-links")
        if rest.isEmpty():
            break
    out = maps[0].select("node", F.col("up").alias("component"))
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), F.col("up").alias("_up"))
        out = out.join(step, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    out = materialize(out, name) if len(maps) > 1 else out
    if len(maps) > 1:
        discard(*maps)
    return out
