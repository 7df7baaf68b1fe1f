"""The trie of conversation prefixes by preorder intervals.

A node is a distinct sequence of first turns. Turns are 120-bit digests of role and
text; a prefix is named by 128 bits, the exclusive or of mixed (depth, turn) digests. Every node
gives two rows of a sort, one at its path and one at the path followed by a turn above
all others: the first is its place in lexicographic preorder, the second its subtree's end. What a subtree sums up
(leaves, saved tokens) is then the difference of two prefix sums over that order.

Paths are ordered by at most ``BLOCK`` turns at a time. What longer ones have beyond their first block is ranked in rounds, each doubling the
block: a block's rank is that of its halves' ranks, so a trie of depth d takes log2(d / BLOCK) rounds over its deep nodes only, and no row
ever holds a whole long conversation. All positions, names and sums come from range sorts with sums
carried over their parts (``ordered``): a conversation or node with any share of the rows spreads over tasks.
The digest of a node's members is a chain over their ids: ids are joined to chunks where they are sorted, and only the chunks of nodes that
cross a part's edge meet again, to be read as a stream.

Cases: null roles and texts are empty ones; null turns come first; rows of one conversation with equal turns follow the
order of their digests; repeated rows are turns each; rows without a conv_id are no conversation and left out; a base whose
conversation is absent gives no turns; further columns are ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from operator import add, xor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carried, carried_runs, sort_written
from .storage import document_batches, lean, materialize
from .textkernel import U64, mix

BLOCK = 32
#: Bytes of joined ids in one chunk of a node's members.
CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
GROUP, HEADS = 20, 4
_LAST = b"\xff" * 16


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, f1, f2 (digest of role and text), words: narrow rows instead of texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    half = lambda at: F.conv(F.substring("_d", at, 15), 16, 10).cast("long")
    slim = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("_d"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return slim.select("conv_id", "turn", half(1).alias("f1"), half(16).alias("f2"), "words")


def _positions(batches):
    """Number inside each run of conv_id in this part, and whether the run is the part's first."""
    import pyarrow as pa

    first = last = None
    seen = 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        number = np.arange(1, len(conv) + 1) - np.repeat(begins, np.diff(np.append(begins, len(conv))))
        if last == conv[0]:
            number[: begins[1] if len(begins) > 1 else len(conv)] += seen
        first, last, seen = conv[0] if first is None else first, conv[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(number), *(batch.column(c) for c in ("f1", "f2", "words")), pa.array(conv == first)], names=["conv_id", "number", "f1", "f2", "words", "open"])


def in_turn_order(slim: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), f1, f2, words."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("f1"), F.col("f2")]
    table = sort_written(slim, "turn-order", order, scan=_positions, schema="conv_id long, number long, f1 long, f2 long, words long, open boolean")
    more = carried_runs(table, ["conv_id"], "number", ["number"], add, ["_more"])
    pos = F.col("number") + F.when(F.col("open"), F.col("_more")).otherwise(F.lit(0))
    return table.join(F.broadcast(more), "_part").select("conv_id", pos.alias("pos"), "f1", "f2", "words")


def rebuild(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, f1, f2, words) of the rebuilt conversations, and the ids of all, even turnless ones.

    Conversation c begins with the first crc32(c) % 4 turns of conversation c - c % 20.
    """
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = materialize(convs.withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS), "convs")
    lengths = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lengths, "base", "left").withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    heads = own.where((F.col("conv_id") == base) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "f1", "f2", "words")
    heads = convs.where("given > 0").select("base", "conv_id", "given").join(heads, "base").where("pos <= given")
    tails = own.join(convs.select("conv_id", "h", "given"), "conv_id").where("pos > h")
    rows = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "f1", "f2", "words")
    rows = rows.unionByName(heads.select("conv_id", F.col("pos").alias("depth"), "f1", "f2", "words"))
    return materialize(rows, "rebuilt"), convs.select("conv_id")


def _mixed(f: np.ndarray, depth: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(f.astype(U64) ^ mix(depth.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed)))


_NAMED = "conv_id long, depth long, words long, x1 long, x2 long, y1 long, y2 long, a1 long, a2 long, path binary, open boolean"


def _names(batches):
    """Inside a part: prefix names x, the prefixes one turn shorter y and at the block's begin a, and the turns since then."""
    import pyarrow as pa

    first = last = None
    state = np.zeros(2, U64)
    kept = None  # the rows of the block that the last batch ended in: (conv, depth, turns as bytes)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, depth, f1, f2 = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "f1", "f2"))
        n = len(conv)
        begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
        after, before = np.empty((2, n), U64), np.empty((2, n), U64)
        for i, f in enumerate((f1, f2)):
            total = np.concatenate([[U64(0)], np.bitwise_xor.accumulate(_mixed(f, depth, i + 1))])
            start = total[begins].copy()
            if last == conv[0]:
                start[0] ^= state[i]
            after[i], before[i] = total[1:] ^ start[run], total[:-1] ^ start[run]
        first, last, state = conv[0] if first is None else first, conv[-1], after[:, -1].copy()
        # A block never crosses a part, but it may cross a batch.
        place = (depth - 1) % BLOCK
        spell = np.stack([f1, f2], 1).astype(">u8").view(np.uint8).reshape(n, 16)
        lead = 0
        begin = np.empty_like(before)
        if kept is not None and place[0]:
            lead, spell = len(kept[0]), np.concatenate([kept[0], spell])
        at = np.arange(n) + lead
        row0 = at - place
        inside = row0 >= lead
        begin[:, inside] = before[:, row0[inside] - lead]
        if not inside.all():  # rows of the block carried over
            begin[:, ~inside] = kept[1][:, None]
        size = place + 1
        flat = np.repeat(row0 - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        path = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size * 16)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(spell[flat]))])
        kept = (spell[row0[-1] : at[-1] + 1].copy(), begin[:, -1].copy())
        cols = [pa.array(v.view(np.int64)) for pair in (after, before, begin) for v in pair]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), batch.column("words"), *cols, path, pa.array(conv == first)], names=[c.split()[0] for c in _NAMED.split(",")])


def name_prefixes(rows: DataFrame) -> DataFrame:
    """Every rebuilt turn with the names of its prefix (x), its parent (y) and its block's begin (a), and the block's turns."""
    block = F.floor((F.col("depth") - 1) / BLOCK)
    table = sort_written(rows, "prefix-names", [F.col("conv_id"), block], [F.col("conv_id"), F.col("depth")], _names, _NAMED)
    more = carried_runs(table, ["conv_id"], "depth", ["x1", "x2"], xor, ["_m1", "_m2"])
    named = table.join(F.broadcast(more), "_part")
    fix = lambda c: F.when(F.col("open"), F.col(c).bitwiseXOR(F.col(f"_m{c[1]}"))).otherwise(F.col(c)).alias(c)
    return named.select("conv_id", "depth", "words", *[fix(c) for c in ("x1", "x2", "y1", "y2", "a1", "a2")], "path")


def distinct_nodes(named: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: x, y, a, path, depth, conv_id (smallest member), n_convs, own (what its last turn saves)."""
    same = lambda c: F.max(c).alias(c)
    nodes = named.groupBy("x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[same(c) for c in ("depth", "words", "y1", "y2", "a1", "a2")], F.first("path").alias("path"))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select("*", *[zero(c) for c in ("x1", "x2", "depth", "words", "y1", "y2", "a1", "a2")], F.lit(b"").alias("path"))
    both = nodes.unionByName(root)
    return materialize(both.withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")


def _dense(batches):
    """Dense rank inside a part of sorted ``k``, and the first key's mark."""
    import pyarrow as pa

    rank, last, first = 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("k")
        values = key.to_pylist() if pa.types.is_binary(key.type) else list(zip(*(key.field(i).to_pylist() for i in range(key.type.num_fields)), strict=True))
        out = np.empty(len(values), np.int64)
        for i, v in enumerate(values):
            if v != last:
                rank, last = rank + 1, v
            out[i] = rank
        yield pa.RecordBatch.from_arrays([pa.array(out), *(batch.column(c) for c in ("x1", "x2", "close", "depth", "a1", "a2", "own")), key], names=["m", "x1", "x2", "close", "depth", "a1", "a2", "own", "k"])


def _ranked(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with ``m``: the dense rank of ``k`` among all rows."""
    order = [F.col(c) for c in ("k", "x1", "x2", "close")]
    table = sort_written(rows, "trie-ranks", order, scan=_dense, schema=f"m long, x1 long, x2 long, close int, depth long, a1 long, a2 long, own long, k {kind}")
    summary = table.groupBy("_part").agg(F.max("m").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))
    # A key that goes on from the part before keeps its rank.
    total, last, out = 0, None, []
    for row in sorted(summary.collect(), key=lambda r: r["_part"]):
        base = total - (row["first"] == last)
        out.append((row["_part"], base))
        total, last = base + row["n"], row["last"]
    more = rows.sparkSession.createDataFrame(out, "_part int, _base long")
    return table.join(F.broadcast(more), "_part").withColumn("m", F.col("m") + F.col("_base")).drop("_part", "_base", "k")


def _deep_order(deep: DataFrame, deepest: int) -> DataFrame:
    """Rows beyond the first block with ``m``, the rank of their path behind it, and ``a``, the node where that begins."""
    rows, length = _ranked(deep, "binary"), BLOCK
    while length < deepest - BLOCK:
        # The second half of a doubled block follows the rank of its first half, which ends where a begins.
        second = F.floor((F.col("depth") - BLOCK - 1) / length) % 2 == 1
        firsts = rows.where(f"close = 0 AND (depth - {BLOCK}) % {length} = 0").select(F.col("x1").alias("_x1"), F.col("x2").alias("_x2"), F.col("m").alias("_m"), F.col("a1").alias("_a1"), F.col("a2").alias("_a2"))
        late = rows.where(second).join(firsts, (F.col("a1") == F.col("_x1")) & (F.col("a2") == F.col("_x2")))
        late = late.select("x1", "x2", "close", "depth", F.col("_a1").alias("a1"), F.col("_a2").alias("a2"), "own", F.struct(F.col("_m").alias("u"), F.col("m").alias("v")).alias("k"))
        early = rows.where(~second).select("x1", "x2", "close", "depth", "a1", "a2", "own", F.struct(F.col("m").alias("u"), F.lit(-1).cast("long").alias("v")).alias("k"))
        rows, length = _ranked(late.unionByName(early), "struct<u:long,v:long>"), 2 * length
    return rows


def intervals(nodes: DataFrame) -> DataFrame:
    """Two rows a node, its begin (close = 0) and its subtree's end (close = 1), with the columns (k, m) that order them:
    the path's first block, and the rank of what follows among all that have more (-1: nothing does)."""
    fresh = F.col("depth") % BLOCK == 0  # the turn above all others begins a block of its own
    opens = nodes.select("x1", "x2", F.lit(0).alias("close"), "depth", "a1", "a2", "own", F.col("path").alias("k"))
    ends = nodes.select("x1", "x2", F.lit(1).alias("close"), (F.col("depth") + 1).alias("depth"), *[F.when(fresh, F.col(f"x{i}")).otherwise(F.col(f"a{i}")).alias(f"a{i}") for i in (1, 2)], F.lit(0).cast("long").alias("own"), F.when(fresh, F.lit(_LAST)).otherwise(F.concat("path", F.lit(_LAST))).alias("k"))
    rows = opens.unionByName(ends)
    columns = ["x1", "x2", "close", "own", "k", "m"]
    shallow = rows.where(F.col("depth") <= BLOCK).withColumn("m", F.lit(-1).cast("long")).select(columns)
    deepest = (nodes.agg(F.max("depth")).first()[0] or 0) + 1
    if deepest <= BLOCK:
        return shallow
    anchors = nodes.where(F.col("depth") == BLOCK).select(F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("path").alias("k"))
    return _deep_order(rows.where(F.col("depth") > BLOCK), deepest).join(anchors, ["a1", "a2"]).select(columns).unionByName(shallow)


_SUMS = "x1 long, x2 long, close int, place long, leaves long, saved long, row long"


def _running(batches):
    """Sums inside a part, up to and with each row: nodes begun, leaves (an end right behind a begin) and savings."""
    import pyarrow as pa

    place = leaves = saved = row = 0
    before = 1  # what the part before ended with is added later
    for batch in batches:
        if not batch.num_rows:
            continue
        close, own = batch.column("close").to_numpy(), batch.column("own").to_numpy()
        leaf = (close == 1) & (np.concatenate([[before], close[:-1]]) == 0)
        sums = [s + np.cumsum(v) for s, v in ((place, 1 - close), (leaves, leaf), (saved, own))]
        place, leaves, saved, before = (int(s[-1]) for s in [*sums, close])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x1", "x2", "close")), *(pa.array(s.astype(np.int64)) for s in sums), pa.array(np.arange(row, row + len(close)))], names=[c.split()[0] for c in _SUMS.split(",")])
        row += len(close)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """x, preorder (from 0), subtree_end (the preorder behind the subtree), n_leaves, saved_tokens."""
    table = sort_written(materialize(intervals(nodes), "trie-intervals"), "trie-sums", [F.col("k"), F.col("m")], scan=_running, schema=_SUMS)
    ends = lambda f: f(F.struct("row", "close"))
    summary = table.groupBy("_part").agg(F.max("place").alias("place"), F.max("leaves").alias("leaves"), F.max("saved").alias("saved"), ends(F.min).alias("first"), ends(F.max).alias("last"))
    out, sums, last = [], (0, 0, 0), 1
    for r in sorted(summary.collect(), key=lambda r: r["_part"]):
        edge = int(last == 0 and r["first"]["close"] == 1)  # a leaf across the edge of two parts
        base = (sums[0], sums[1] + edge, sums[2])
        out.append((r["_part"], *base))
        sums, last = (base[0] + r["place"], base[1] + r["leaves"], base[2] + r["saved"]), r["last"]["close"]
    base = nodes.sparkSession.createDataFrame(out, "_part int, _p long, _l long, _s long")
    at = table.join(F.broadcast(base), "_part").select("x1", "x2", "close", (F.col("place") + F.col("_p")).alias("place"), (F.col("leaves") + F.col("_l")).alias("leaves"), (F.col("saved") + F.col("_s")).alias("saved"))
    pick = lambda c, side: F.max(F.when(F.col("close") == side, F.col(c)))
    spans = at.groupBy("x1", "x2").agg(*[pick(c, s).alias(f"{c}{s}") for c in ("place", "leaves", "saved") for s in (0, 1)])
    # A begin's sum of savings holds the node's own.
    return spans.select("x1", "x2", (F.col("place0") - 1).alias("preorder"), F.col("place1").alias("subtree_end"), (F.col("leaves1") - F.col("leaves0")).alias("n_leaves"), (F.col("saved1") - F.col("saved0")).alias("_below"))


_CHUNKS = "x1 long, x2 long, number long, chunk binary, sha string"


def _chunks(batches):
    """Of nodes that lie inside a part their members' digest, of the first and last node of a part chunks of joined ids."""
    import pyarrow as pa

    out: list[tuple] = []
    key, state, held, size, number, first = None, None, [], 0, 0, True

    def flush():
        nonlocal held, size, number
        if held:
            out.append((*key, number, b",".join(held), None))
            number, held, size = number + 1, [], 0

    def close(edge: bool):
        nonlocal held, size, number
        if edge or number:
            flush()
        else:
            out.append((*key, None, None, hashlib.sha256(b",".join(held)).hexdigest()))
        held, size, number = [], 0, 0

    def give():
        nonlocal out
        cols, out = list(zip(*out, strict=True)) or [()] * 5, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["x1", "x2", "number", "chunk", "sha"])

    for batch in batches:
        for x1, x2, conv in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "conv_id")), strict=True):
            if (x1, x2) != key:
                if key is not None:
                    close(first)
                    first = False
                key = (x1, x2)
            name = b"%d" % conv
            held.append(name)
            size += len(name) + 1
            if size >= CHUNK:
                flush()
        if out:
            yield give()
    if key is not None:
        close(True)
        yield give()


def _digests(batches):
    """sha256 over the chunks of each node, which come in order: a stream, no node is held."""
    import pyarrow as pa

    key = state = None
    for batch in batches:
        out = []
        for x1, x2, chunk in zip(*(batch.column(c).to_pylist() for c in ("x1", "x2", "chunk")), strict=True):
            if (x1, x2) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (x1, x2), hashlib.sha256()
            state.update(chunk)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["x1", "x2", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=["x1", "x2", "sha"])


def member_digests(ends: DataFrame) -> DataFrame:
    """x, sha of the conversations (conv_id) that end in each node."""
    order = [F.col("x1"), F.col("x2"), F.col("conv_id")]
    table = sort_written(ends, "trie-ends", order, scan=_chunks, schema=_CHUNKS)
    edges = table.where("chunk IS NOT NULL").select("x1", "x2", "_part", "number", "chunk")
    document_batches(ends.sparkSession)
    late = edges.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "_part", "number").mapInArrow(lean(_digests), "x1 long, x2 long, sha string")
    return table.where("sha IS NOT NULL").select("x1", "x2", "sha").unionByName(late)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end."""
    slim = materialize(turns(conversations), "turns")
    rows, convs = rebuild(in_turn_order(slim))
    named = name_prefixes(rows)
    nodes = distinct_nodes(named, convs)
    end = named.select("conv_id", F.struct("depth", "x1", "x2").alias("e"))
    zero = F.lit(0).cast("long")
    end = end.unionByName(convs.select("conv_id", F.struct(zero.alias("depth"), zero.alias("x1"), zero.alias("x2")).alias("e")))
    ends = end.groupBy("conv_id").agg(F.max("e").alias("e")).select("e.x1", "e.x2", "conv_id")
    digests = member_digests(materialize(ends, "ends"))
    children = nodes.where("depth > 0").groupBy("y1", "y2").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"y1": "x1", "y2": "x2"})
    out = nodes.drop("path").join(subtree_sums(nodes), ["x1", "x2"]).join(children, ["x1", "x2"], "left").join(digests, ["x1", "x2"], "left")
    # The root's many children need no join to know it.
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("_root"))
    parents = nodes.where("depth > 0").select(F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv_id").alias("parent_conv_id"))
    deep = out.where("depth > 1").join(parents, ["y1", "y2"])
    null = F.lit(None).cast("long")
    first = root.first()
    top = out.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first[0] if first else None).cast("long")).otherwise(null))
    return deep.unionByName(top.select(*deep.columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", (F.col("_below") + F.col("own")).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "preorder", "subtree_end"
    )


#: DuckDB: nodes as whole lists of turns; crc32 bit by bit.
_CRC = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT for i in range(8)], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
ORACLE = f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS v FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(v ORDER BY pos) AS l FROM own GROUP BY conv_id),
c AS (SELECT conv_id, l, {_CRC} % 4 AS h FROM whole),
made AS (SELECT c.conv_id, coalesce(b.l[1:c.h], []) || c.l[c.h + 1:] AS l FROM c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 20),
members AS (SELECT conv_id, l[1:d] AS p, d, d = len(l) AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM made)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM members GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own_sums AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.p[n.d].t, '[^\\x20\\x09-\\x0D]+')) END AS own FROM nodes n LEFT JOIN kids k ON k.p = n.p AND k.d = n.d),
up AS (SELECT p[1:a] AS p, a AS d, (n_children = 0)::INT AS leaf, own FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own_sums)),
sums AS (SELECT p, d, sum(leaf)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM up GROUP BY p, d)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN q.conv_id END AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ids) AS ends_sha256
FROM own_sums n JOIN sums s ON s.p = n.p AND s.d = n.d LEFT JOIN nodes q ON n.d > 0 AND q.d = n.d - 1 AND q.p = n.p[1:n.d - 1]
"""
