"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when 100 |X n Y| >= threshold |X u Y| over their sets of distinct
k-word shingles. Then |X n Y| >= need(X) = ceil(threshold |X| / 100), so under any
common order of shingles X and Y share at least l shingles among the first
|X| - need(X) + l of X and |Y| - need(Y) + l of Y (their l-prefixes). A document
whose l-prefix promises many candidates takes a larger l, and then a pair must
share min(l_X, l_Y) prefix shingles before it is verified.

1. *Digest*: one pass gives each text's set size and 128-bit set fingerprint (equal
   sets are one class from here on) and counts all shingles into ``BUCKETS`` counters,
   which only serve to spot hot shingles: those whose counter is above the median
   by more than ``HOT_ROWS``.
2. *Frequencies*: shingles meet in buckets by hash (as many as the corpus needs, so
   that a bucket holds about ``BUCKET_SHINGLES``), which gives each its exact number of classes.
   Those of one class alone go no further; hot ones pass uncounted, as the most frequent.
3. *Who may link*: a class that shares fewer than need shingles with all others together
   has no link and leaves.
4. *Prefixes*: shingles are ordered by (frequency, hash), rare first. l is at least 1 + LEAST_MATCH |X|
   and up to three times that where the frequencies promise costly company.
5. *Runs* of one shingle among the prefixes: up to ``RUN_PAIRS`` classes give all pairs of fitting
   size; a longer run links every class to its first one only (a star), so its output
   stays linear, and so does every salted run (shingles in more than ``SALT_ROWS`` classes), whose
   first ones are linked too. A pair of short runs stands if it shares enough prefix shingles;
   stars always stand. Every link lies inside a component of these edges: a family.
6. *Verification* compares whole sets inside each family, exactly. A family above
   ``BLOCK_DOCS`` is dealt into blocks by hash: blocks are compared within, delegates
   of all blocks with each other, and then every class outside the family's largest
   component with every block. Pairs inside one component need no comparison.
7. Components of the links.

Hashes are 64 bits (shingles) and 128 bits (sets, and texts where rows are told apart). Cases: null,
empty and blank texts have the empty set, link with nothing and are their own component; a null
doc_id never names a component unless the whole component is null; rows that share a doc_id (or have none)
are texts of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .reducer import bits_of, maybe
from .storage import discard, document_batches, lean, materialize
from .textkernel import Scan, as_bytes, mix, seeded, shingles, slices

BUCKETS = 1 << 18
COUNT_BLOCK = 1024
RUN_PAIRS = 32
LEAST_MATCH = 0.05
MOST_STEPS = 3
#: Occurrences above the usual counter from which a shingle is hot, and classes of a shingle in one run.
HOT_ROWS = 8192
SALT_ROWS = 1024
BUCKET_SHINGLES = 1 << 20
#: Shingles that a task holds before it sends them to their buckets.
SEND_SHINGLES = 1 << 19
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1 << 21

#: A prefix row's info: set size << 24 | l.
MATCH = (1 << 24) - 1
#: Frequencies from here on are a hot shingle's counter.
HOT = 1 << 40
_BUCKET_SHIFT = np.uint64(64 - (BUCKETS.bit_length() - 1))


def need(n: int, threshold: int) -> int:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-threshold * n // 100)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        a = mix(s).sum(dtype=np.uint64)
        b = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        pair = mix(np.array([a + np.uint64(len(s)), b], np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def _sets(texts, k: int):
    """(positions, sets) of slices of a batch."""
    texts = as_bytes(texts)
    for lo, hi in slices(texts):
        scan = Scan(texts[lo:hi])
        yield lo, shingles(scan.hashes(), scan.first, k)


DIGEST = "doc_id long, t1 long, t2 long, n long, fp1 long, fp2 long, block int, counts array<int>"


def _digest(k: int):
    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "t1", "t2", "n", "fp1", "fp2", "block", "counts"]
        types = [*[pa.int64()] * 6, pa.int32(), pa.list_(pa.int32())]
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            size, one, two = [], [], []
            for _, sets in _sets(batch.column(3).to_pylist(), k):
                full = [s for s in sets if len(s)]
                if full:
                    counts += np.bincount((np.concatenate(full) >> _BUCKET_SHIFT).astype(np.int64), minlength=BUCKETS)
                for s in sets:
                    a, b = fingerprint(s)
                    size.append(len(s)), one.append(a), two.append(b)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(size, types[3]), pa.array(one, types[4]), pa.array(two, types[5]), pa.nulls(m, types[6]), pa.nulls(m, types[7])], names=names)
        held = counts.reshape(-1, COUNT_BLOCK)
        at = np.flatnonzero(held.any(axis=1))
        if len(at):
            flat = np.minimum(held[at], np.iinfo(np.int32).max).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, COUNT_BLOCK, dtype=np.int32), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(at), types[i]) for i in range(6)], pa.array(at, pa.int32()), lists], names=names)

    return run


def least_match(n: int, threshold: int) -> int:
    """The smallest l of a set of n."""
    return min(need(n, threshold), 1 + int(LEAST_MATCH * n))


def asked_match(n: int, threshold: int) -> int:
    """The smallest l of any set that a set of n may link to (none is smaller than need(n))."""
    return least_match(need(n, threshold), threshold)


def choose_match(company: np.ndarray, alone: int, n: int, threshold: int) -> int:
    """The l of a set of n whose first ``alone`` shingles nobody else has and whose others, in order,
    bring ``company`` candidates each. Each step by the least l is taken to cut them to a
    quarter; l grows until they cost less than the prefix itself."""
    least, base = need(n, threshold), least_match(n, threshold)
    for step in range(1, MOST_STEPS):
        match = min(least, step * base)
        prefix = n - least + match
        if company[: max(0, prefix - alone)].sum() <= prefix * 4 ** (step - 1):
            return match
    return min(least, MOST_STEPS * base)


SENT = "bucket int, hot boolean, tokens binary, nodes binary, lengths binary"


def _send(k: int, buckets: int, counts):
    """Shingles of each class to their buckets: a row for a bucket and some classes, with the shingles
    of one class after another. Hot ones go to a bucket that the class names."""

    def run(batches):
        import pyarrow as pa

        rate = counts.value
        hot_bucket = rate > HOT_ROWS
        seen: set[int] = set()
        sets, names, total = [], [], 0

        def flush():
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            token = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), size)
            node = np.array(names, np.int64)
            hot = hot_bucket[(token >> _BUCKET_SHIFT).astype(np.int64)]
            home = np.where(hot, mix(node.view(np.uint64))[doc], token) % np.uint64(buckets)
            home = (home.astype(np.int64) << 1) | hot
            order = np.argsort(home.astype(np.uint16) if 2 * buckets <= 1 << 16 else home, kind="stable")
            home, token, doc = home[order], token[order], doc[order]
            new = np.ones(len(home), bool)
            new[1:] = (home[1:] != home[:-1]) | (doc[1:] != doc[:-1])
            run_at = np.flatnonzero(new)
            length = np.diff(np.append(run_at, len(home)))
            run_doc, run_home = doc[run_at], home[run_at]
            length = length.astype(np.uint32)
            cut = np.flatnonzero(np.append(True, run_home[1:] != run_home[:-1]))
            ends = np.append(cut[1:], len(run_home))
            first, nodes = np.append(run_at, len(home)), node[run_doc]
            where = run_home[cut]
            step = 4096
            for lo in range(0, len(cut), step):
                spans = list(zip(cut[lo : lo + step].tolist(), ends[lo : lo + step].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((where[lo : lo + step] >> 1).astype(np.int32)),
                        pa.array((where[lo : lo + step] & 1).astype(bool)),
                        pa.array([token[first[a] : first[b]].tobytes() for a, b in spans], pa.binary()),
                        pa.array([nodes[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([length[a:b].tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["bucket", "hot", "tokens", "nodes", "lengths"],
                )

        for batch in batches:
            for _, found in _sets(batch.column(0).to_pylist(), k):
                for s in found:
                    if not len(s):
                        continue
                    fp = fingerprint(s)[0]
                    if fp in seen:
                        continue
                    seen.add(fp)
                    sets.append(s), names.append(fp)
                    total += len(s)
                    if total >= SEND_SHINGLES:
                        yield from flush()
                        sets, names, total = [], [], 0
        if sets:
            yield from flush()

    return run


SHARED = "node long, token long, df long"


def _frequencies(counts):
    """Rows of :func:`_send` sorted by bucket: (node, token, number of its classes) of the
    shingles that more than one class has, and of the hot ones."""

    def run(batches):
        import pyarrow as pa

        rate = counts.value

        def emit(rows):
            for hot in (False, True):
                part = [r for r in rows if r[0] == hot]
                if not part:
                    continue
                token, node, length = (np.frombuffer(b"".join(r[i] for r in part), t) for i, t in ((1, np.uint64), (2, np.int64), (3, np.uint32)))
                node = np.repeat(node, length)
                order = np.lexsort((node, token))
                token, node = token[order], node[order]
                fresh = np.ones(len(token), bool)
                fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
                token, node = token[fresh], node[fresh]
                if hot:
                    df = HOT + rate[(token >> _BUCKET_SHIFT).astype(np.int64)].astype(np.int64)
                else:
                    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                    length = np.diff(np.append(begin, len(token)))
                    df = np.repeat(length, length)
                    more = df > 1
                    token, node, df = token[more], node[more], df[more]
                for lo in range(0, len(token), 1 << 16):
                    at = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(token[at].view(np.int64)), pa.array(df[at])], names=["node", "token", "df"])

        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from emit(rows)
                    now, rows = bucket, []
                rows.append(row)
        yield from emit(rows)

    return run


PREFIX = "token long, node long, info long, salt int"


def prefix(token: np.ndarray, df: np.ndarray, node: int, n: int, threshold: int):
    """(tokens, l, salts) of a class' l-prefix without those that it alone has; the others come
    sorted by (df, token)."""
    least, alone = need(n, threshold), n - len(token)
    exact = np.where(df >= HOT, df - HOT, df - 1)
    match = choose_match(exact, alone, n, threshold)
    take = max(0, n - least + match - alone)
    if take < asked_match(n, threshold):
        take = 0
    salts = exact[:take] // SALT_ROWS + 1
    return token[:take], match, np.where(salts > 1, 1 + (node & 0x7FFFFFFF) % salts, 0).astype(np.int32)


def _prefixes(threshold: int):
    """Rows of :func:`_frequencies` with the set size n, sorted by (node, df, token)."""

    def run(batches):
        import pyarrow as pa

        def emit(node, token, df, n):
            begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            out = []
            for a, b in zip(begin.tolist(), np.append(begin[1:], len(node)).tolist(), strict=True):
                t, match, salt = prefix(token[a:b], df[a:b], int(node[a]), int(n[a]), threshold)
                if len(t):
                    out.append((t, np.full(len(t), node[a]), np.full(len(t), int(n[a]) << 24 | match), salt))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "node", "info", "salt"])

        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "token", "df", "n")]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last class may go on
            if last:
                yield from emit(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
        if held is not None:
            yield from emit(*held)

    return run


def run_edges(token, salt, node, info, threshold: int):
    """Edges of whole runs, rows sorted by (token, salt, node) without repeats:
    (a, b, match, hot) arrays, and (token, first node) of the salted runs."""
    n = len(token)
    new = np.ones(n, bool)
    new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, n))
    run = np.repeat(np.arange(len(begin)), length)
    size, match = info >> 24, info & MATCH
    parts = []
    short = length[run] <= RUN_PAIRS
    for d in range(1, RUN_PAIRS):
        i = np.flatnonzero((run[:-d] == run[d:]) & short[:-d]) if n > d else np.zeros(0, np.int64)
        if not len(i):
            break
        small, large = np.minimum(size[i], size[i + d]), np.maximum(size[i], size[i + d])
        i = i[100 * small >= threshold * large]
        parts.append((node[i], node[i + d], np.minimum(match[i], match[i + d]), np.zeros(len(i), bool)))
    # Rows of a salted run miss their partners in other salts, so a short one gets a star too.
    hot = np.flatnonzero((~short | (salt > 0)) & ~new)
    parts.append((node[begin[run[hot]]], node[hot], match[hot], np.ones(len(hot), bool)))
    salted = begin[salt[begin] > 0]
    return [np.concatenate(x) for x in zip(*parts, strict=True)], (token[salted], node[salted])


def _runs(threshold: int):
    """Streams sorted rows; a run that reaches over batches is held back, or once
    longer than RUN_PAIRS, only its first row."""

    def run(batches):
        import pyarrow as pa

        def out(edges, salted):
            a, b, match, hot = edges
            m, s = len(a), len(salted[0])
            if m + s:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([a, salted[0]])), pa.array(np.concatenate([b, salted[1]])), pa.array(np.concatenate([match, np.zeros(s, np.int64)])), pa.array(np.concatenate([hot, np.ones(s, bool)])), pa.array(np.concatenate([np.zeros(m, bool), np.ones(s, bool)]))],
                    names=["a", "b", "match", "hot", "salted"],
                )

        empty = np.zeros(0, np.int64)
        held = [empty] * 4  # token, salt, node, info of the last run so far
        long_run = False
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "salt", "node", "info")]
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            keep = np.ones(len(rows[0]), bool)
            keep[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            rows = [x[keep] for x in rows]
            token, salt, node, info = rows
            if long_run:  # row 0 is the first of a long run; its members get their star here
                same = (token == token[0]) & (salt == salt[0])
                stop = len(same) if same.all() else int(np.argmin(same))
                yield from out([np.full(stop - 1, node[0]), node[1:stop], info[1:stop] & MATCH, np.ones(stop - 1, bool)], (empty, empty))
                if stop == len(same):
                    held = [x[:1] for x in rows]
                    # keep the last node, so that its repeats in the next batch are dropped
                    if stop > 1:
                        held = [np.concatenate([x[:1], x[-1:]]) for x in rows]
                    continue
                if salt[0] > 0:
                    yield from out([empty] * 3 + [np.zeros(0, bool)], (token[:1], node[:1]))
                rows = [x[stop:] for x in rows]
                token, salt, node, info = rows
                long_run = False
            last = int(np.flatnonzero((token != token[-1]) | (salt != salt[-1]))[-1]) + 1 if ((token != token[-1]) | (salt != salt[-1])).any() else 0
            if last:
                yield from out(*run_edges(token[:last], salt[:last], node[:last], info[:last], threshold))
            held = [x[last:] for x in rows]
            if len(held[0]) > RUN_PAIRS:
                yield from out([np.full(len(held[0]) - 1, held[2][0]), held[2][1:], held[3][1:] & MATCH, np.ones(len(held[0]) - 1, bool)], (empty, empty))
                held = [np.concatenate([x[:1], x[-1:]]) for x in held]
                long_run = True
        if len(held[0]):
            if long_run:
                if held[1][0] > 0:
                    yield from out([empty] * 3 + [np.zeros(0, bool)], (held[0][:1], held[2][:1]))
            else:
                yield from out(*run_edges(*held, threshold))

    return run


def linked(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Matrix of the exact links among some sets."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    flat, doc = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(flat)))
    # Shingles that the same documents hold are one column with a weight.
    with np.errstate(over="ignore"):
        held = np.add.reduceat(seeded(m, 23)[doc], begin)
    common = count > 1
    held, begin, count = held[common], begin[common], count[common]
    _, index, weight = np.unique(held, return_index=True, return_counts=True)
    begin, count = begin[index], count[index]
    inter = np.zeros((m, m))
    step = max(256, (1 << 22) // m)
    for lo in range(0, len(begin), step):
        b, c = begin[lo : lo + step], count[lo : lo + step]
        column = np.repeat(np.arange(len(b)), c)
        row = doc[np.repeat(b - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
        a = np.zeros((m, len(b)), np.float32)
        a[row, column] = 1.0
        inter += (a * weight[lo : lo + step].astype(np.float32)) @ a.T
    inter = np.rint(inter).astype(np.int64)
    link = 100 * inter >= threshold * (size[:, None] + size[None, :] - inter)
    np.fill_diagonal(link, False)
    return link


def _stars(link: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) positions of the components of a link matrix."""
    seen = np.zeros(len(link), bool)
    out = []
    for i in np.flatnonzero(link.any(axis=1)).tolist():
        if seen[i]:
            continue
        seen[i] = True
        front = np.array([i])
        while len(front):
            reach = link[front].any(axis=0) & ~seen
            seen |= reach
            front = np.flatnonzero(reach)
            out += [(i, j) for j in front.tolist()]
    return out


def _verify(k: int, threshold: int):
    """Rows (family, block, other, node, text) sorted by the first three: links of each such group."""

    def run(batches):
        import pyarrow as pa

        def flush(nodes, sets):
            if len(nodes) < 2:
                return None
            found = _stars(linked(sets, threshold))
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

        now, nodes, sets, have = None, [], [], set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            node = batch.column(3).to_pylist()
            for lo, found in _sets(batch.column(4).to_pylist(), k):
                for at, s in enumerate(found, lo):
                    if keys[at] != now:
                        if (out := flush(nodes, sets)) is not None:
                            yield out
                        now, nodes, sets, have = keys[at], [], [], set()
                    # Another row of the same doc_id isn't the class; a class counts once.
                    if len(s) and node[at] not in have and fingerprint(s)[0] == node[at]:
                        have.add(node[at])
                        nodes.append(node[at])
                        sets.append(s)
        if (out := flush(nodes, sets)) is not None:
            yield out

    return run


def _texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` (node, t1, ...) with the text of each, looked up by the text's hash."""
    near = maybe(docs.select(F.xxhash64("text").alias("_t1"), "text"), "_t1", bits_of(members.select("t1"), "t1"))

    def once(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for t in batch.column(0).to_pylist():
                fresh.append(t not in seen)
                seen.add(t)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    near = near.mapInArrow(lean(once), "_t1 long, text string")  # copies of a text move once a task
    return materialize(members.join(near, members["t1"] == near["_t1"]).drop("_t1"), "jaccard-texts")


def _compare(groups: DataFrame, k: int, threshold: int) -> DataFrame:
    """Exact links (spanning) of groups (family, block, other, node, text)."""
    rows = groups.select("family", "block", "other", "node", "text")
    rows = rows.repartition("family", "block", "other").sortWithinPartitions("family", "block", "other", "node")
    return rows.mapInArrow(lean(_verify(k, threshold)), "a long, b long")


def _rows(docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """doc_id, t1, t2 (128 bits of the text), n, fp1, fp2 and the component's name (k1, k2) of every row."""
    document_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")
    scanned = materialize(hashed.mapInArrow(lean(_digest(shingle)), DIGEST), "jaccard-digest")
    digest = scanned.where("block IS NULL").drop("block", "counts")
    counted = scanned.where("block IS NOT NULL").select("block", F.posexplode("counts").alias("at", "c")).where("c > 0")
    table = np.zeros(BUCKETS)
    # At most BUCKETS rows, whatever the input.
    for bucket, c in counted.groupBy((F.col("block") * COUNT_BLOCK + F.col("at")).alias("bucket")).agg(F.sum("c").alias("c")).toPandas().itertuples(index=False):
        table[bucket] = c
    usual = float(np.median(table))
    # As many as the corpus needs, and enough for all cores.
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(table.sum()) // BUCKET_SHINGLES + 1)
    counts = spark.sparkContext.broadcast(np.maximum(table - usual - 4 * usual**0.5 - 1, 0.0))

    classes = digest.where("n > 0").groupBy("fp1").agg(F.min("t1").alias("t1"), F.max("n").alias("n"))
    sent = docs.select("text").mapInArrow(lean(_send(shingle, buckets, counts)), SENT)
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    shared = materialize(sent.mapInArrow(lean(_frequencies(counts)), SHARED), "jaccard-shared")
    held = shared.groupBy("node").agg(F.count(F.lit(1)).alias("have"))
    able = held.join(classes, held["node"] == classes["fp1"]).where(F.col("have") >= F.ceil(F.lit(threshold) * F.col("n") / 100))
    able = materialize(able.select(F.col("node").alias("_able"), F.col("n").cast("int").alias("n")), "jaccard-able")
    few = maybe(shared, "node", bits_of(able, "_able"))
    rows = few.join(able, F.col("node") == F.col("_able")).select("node", "token", "df", "n")
    rows = rows.repartition("node").sortWithinPartitions("node", "df", "token").mapInArrow(lean(_prefixes(threshold)), PREFIX)
    rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    found = materialize(rows.mapInArrow(lean(_runs(threshold)), "a long, b long, match long, hot boolean, salted boolean"), "jaccard-runs")
    discard(shared, able)
    pairs = found.where("NOT salted").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("match").alias("match"), F.max("hot").alias("hot"))
    pairs = pairs.where("hot OR shared >= match").select("a", "b")
    heads = found.where("salted").select(F.col("a").alias("token"), F.col("b").alias("head"))
    first = heads.groupBy("token").agg(F.min("head").alias("first"))
    bridges = heads.join(first, "token").where("head <> first").select(F.col("first").alias("a"), F.col("head").alias("b"))
    families = components(pairs.unionByName(bridges), "jaccard-families").select("node", F.col("component").alias("family"))

    members = materialize(families.join(classes, families["node"] == classes["fp1"]).select("family", "node", "t1", "n"), "jaccard-members")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("family", blocks.alias("blocks"))
    placed = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = _texts(placed.select("family", "node", "t1", "blocks", "block"), docs)
    delegates = placed.where("blocks > 1").where(F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")) == 0)
    first_round = placed.withColumn("other", F.lit(0)).unionByName(delegates.withColumn("block", F.lit(-1)).withColumn("other", F.lit(0)))
    links = materialize(_compare(first_round, shingle, threshold), "jaccard-links")
    spent = [found, members, placed, links]

    wide = placed.where("blocks > 1")
    if not wide.isEmpty():
        known = components(links, "jaccard-known")
        wide = materialize(wide.select("family", "node", "blocks").join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-wide")
        tally = wide.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"))
        giant = tally.groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("giant"))
        rest = wide.join(giant, "family").where("component <> giant").select("family", "node")
        asks = rest.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("asks"))
        texts = placed.select("family", "node", "blocks", "block", "text")
        asking = rest.select(F.col("node").alias("_rest")).join(texts, F.col("_rest") == F.col("node")).join(asks, "family")
        asking = asking.withColumn("other", F.pmod(F.xxhash64("node", F.lit(2)), F.col("asks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        answering = texts.join(asks, "family").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        columns = ["family", "block", "other", "node", "text"]
        second = materialize(_compare(asking.select(columns).unionByName(answering.select(columns)), shingle, threshold), "jaccard-links2")
        links = links.unionByName(second)
        spent += [wide, second]
    roots = components(links, "jaccard-components")
    keyed = digest.join(roots, digest["fp1"] == roots["node"], "left")
    keyed = keyed.select("doc_id", "t1", "t2", "n", "fp1", "fp2", F.coalesce("component", "fp1").alias("k1"), F.when(F.col("component").isNull(), F.col("fp2")).otherwise(F.lit(0)).alias("k2"))
    out = materialize(keyed, "jaccard-rows")
    discard(*spent, scanned, roots)
    return out


def _least(rows: DataFrame, name: str, what) -> DataFrame:
    """(_1, _2, name): the least of a component's rows with a shingle. A table of its own, so that both sides of a join
    with it come by an exchange and a hot component can be split."""
    least = rows.where("n > 0").groupBy("k1", "k2").agg(F.min(what).alias(name))
    return materialize(least.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), name), f"jaccard-{name}")


def join(docs: DataFrame, shingle: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows = _rows(docs, shingle, threshold)
    least = _least(rows, "least", "doc_id")
    out = rows.join(least, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id (a null one only if no other is
    there), among several the smallest by hashes of set and text. Texts without words stay; of rows equal in
    doc_id and text one stays."""
    rows = _rows(docs, shingle, threshold)
    of_row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp1", "fp2", "t1", "t2")
    least = _least(rows, "winner", of_row)
    judged = rows.join(least, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n") > 0), "left")
    judged = judged.select("doc_id", "t1", "t2", (F.col("winner").eqNullSafe(of_row) | (F.col("n") == 0)).alias("kept"))
    tally = judged.groupBy("doc_id", "t1", "t2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    special = materialize(tally.where("NOT kept OR rows > 1").select(F.col("doc_id").alias("_id"), F.col("t1").alias("_1"), F.col("t2").alias("_2"), "kept"), "jaccard-special")
    bits = bits_of(special, "_1")
    # Most rows are neither dropped nor repeated, and never move.
    names = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text").cast("string")
    hashed = docs.select(F.struct(*names).alias("_doc"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(7), text).alias("_t2"))
    plain = maybe(hashed, "_t1", bits, member=False).select("_doc.*")
    rest = maybe(hashed, "_t1", bits)
    dropped = special.where("NOT kept")
    same = rest["_own"].eqNullSafe(dropped["_id"]) & (rest["_t1"] == dropped["_1"]) & (rest["_t2"] == dropped["_2"])
    rest = rest.join(dropped, same, "left_anti").dropDuplicates(["_own", "_t1", "_t2"]).select("_doc.*")
    return plain.unionByName(rest)
