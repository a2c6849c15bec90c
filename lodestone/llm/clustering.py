"""Centroid clustering by dual-tree Lloyd rounds, exact in integers.

Method. Vectors become integers, and each task puts its own into blocks with a cover tree over every block: nets of
points at scales 2**i, each point of a net farther than 2**i from all others of it and within 2**(i + 1) of
its parent in the next coarser net. The nets are prefixes of the farthest-first order, which has these properties at
every scale; what is left once a net has a point for every ``LEAF`` of the block falls to its nearest one, in a leaf.
The blocks are written once. Every round builds the same tree over the centroids and descends both trees
together: a pair of nodes is dropped if the least distance that their centres and radii allow is above the
greatest distance that any vector of the node can have to its nearest centroid. The leaves of pairs that
remain are compared exactly, in integers, and ties fall to the smaller number.

Scale. No row moves but a task's sums and counts, k x 64 numbers, which Spark adds up by cluster and component;
the driver holds k centroids, a parameter, and nothing that grows with the vectors. A block is a fixed number of
vectors, so memory doesn't grow either, and a lost task costs its own blocks. Equal vectors are a leaf of their
own, however many there are.

Defined results: vectors that are null, of another size, or with a null or non-finite component are left
out, and so are those with a component of ``LIMIT`` or more in size, whose squared distances would not fit a
long; a null id is hashed as no digits; repeated rows are vectors of their own; with fewer vectors than centroids
each of them is one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import prepare
from lodestone.session import materialize

SIZE = 64
SCALE = 256
#: Components are below this; 64 squares of differences of SCALE times it fit a long.
LIMIT = float(1 << 19)
BLOCK = 2048
#: Vectors of a block for each point of its finest net.
LEAF = 8
#: Pairs of a vector and a centroid that are compared at once.
AT_ONCE = 1 << 15

NODE = np.dtype([("center", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to those of ``y``, or to one row."""
    d = x - y
    return np.sqrt(np.einsum("ij,ij->i", d, d))


@dataclass(frozen=True)
class CoverTree:
    """Nodes from the root on, children next to each other; ``order`` are the points, those below a node being order[lo:hi]."""

    nodes: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int) -> CoverTree:
        x = points.astype(np.float64)
        net, owner, reach = _nets(x, max(1, len(x) // leaf))
        level = np.full(len(net), np.inf)
        level[1:] = np.ceil(np.log2(reach[1:])) - 1
        below: list[list[int]] = [[] for _ in net]
        for k in np.lexsort((np.arange(len(net)), -level)).tolist():
            if k:
                coarser = np.flatnonzero(level > level[k])
                below[coarser[_far(x[net[coarser]], x[net[k]]).argmin()]].append(k)
        # a node is a point and how many of its children lie in nodes above; the point itself goes on as the first child
        made, first, count, at = [(0, 0)], [], [], 0
        while at < len(made):
            k, used = made[at]
            group = [c for c in below[k][used:] if level[c] == level[below[k][used]]]
            first.append(len(made) if group else -1)
            count.append(len(group) + 1 if group else 0)
            made += [(k, used + len(group)), *((c, 0) for c in group)] if group else []
            at += 1
        nodes = np.zeros(len(made), NODE)
        nodes["child"], nodes["children"] = first, count
        size = np.zeros(len(made), np.int64)
        held = np.bincount(owner, minlength=len(net))
        for i in range(len(made) - 1, -1, -1):
            size[i] = size[first[i] : first[i] + count[i]].sum() if count[i] else held[made[i][0]]
        for i in range(len(made)):
            nodes["hi"][i] = nodes["lo"][i] + size[i]
            if count[i]:
                own = slice(first[i], first[i] + count[i])
                nodes["lo"][own] = nodes["lo"][i] + np.cumsum(size[own]) - size[own]
        by_owner = np.argsort(owner, kind="stable")
        edge = np.append(0, np.cumsum(held))
        order = np.empty(len(x), np.int64)
        for i in np.flatnonzero(nodes["children"] == 0).tolist():
            k = made[i][0]
            order[nodes["lo"][i] : nodes["hi"][i]] = by_owner[edge[k] : edge[k + 1]]
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        nodes["center"] = place[net[[k for k, _ in made]]]
        x = x[order]
        for i, n in enumerate(nodes.tolist()):
            nodes["radius"][i] = _far(x[n[1] : n[2]], x[n[0]]).max()
        return cls(nodes, order)


def _nets(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points in farthest-first order, which of them is nearest to each point, how far each was from those before it)."""
    net, reach = [0], [np.inf]
    near, owner = _far(x, x[0]), np.zeros(len(x), np.int64)
    while len(net) < most and near.max() > 0:
        k = int(near.argmax())
        reach.append(float(near[k]))
        d = _far(x, x[k])
        closer = d < near
        near[closer], owner[closer] = d[closer], len(net)
        net.append(k)
    return np.array(net), owner, np.array(reach)


def _opened(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``at``, child) for all children of the nodes."""
    n = nodes["children"][at].astype(np.int64)
    which = np.repeat(np.arange(len(at)), n)
    return which, np.repeat(nodes["child"][at] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def nearest(x: np.ndarray, nodes: np.ndarray, centroids: np.ndarray, tree: CoverTree) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each vector, and how many distances were compared exactly.

    ``x`` are the vectors in the order of their tree's ``nodes``; ``tree`` is that of ``centroids``.
    """
    xs, cs = x.astype(np.float64), centroids[tree.order].astype(np.float64)
    most = np.full(len(nodes), np.inf)  # that any vector below the node has to its nearest centroid
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(q):
        d = _far(xs[nodes["center"][q]], cs[tree.nodes["center"][c]])
        np.minimum.at(most, q, d + nodes["radius"][q])
        least = d - nodes["radius"][q] - tree.nodes["radius"][c]
        keep = least <= most[q] * (1 + 1e-9) + 1e-6  # a margin for rounding: only the exact comparison decides
        q, c, least = q[keep], c[keep], least[keep]
        q_leaf, c_leaf = nodes["children"][q] == 0, tree.nodes["children"][c] == 0
        leaves.append((q[q_leaf & c_leaf], c[q_leaf & c_leaf], least[q_leaf & c_leaf]))
        down = ~q_leaf & (c_leaf | (nodes["radius"][q] >= tree.nodes["radius"][c]))
        which, child = _opened(nodes, q[down])
        np.minimum.at(most, child, most[q[down]][which])
        other = ~down & ~c_leaf
        which_c, child_c = _opened(tree.nodes, c[other])
        q, c = np.concatenate([child, q[other][which_c]]), np.concatenate([c[down][which], child_c])
    q, c, least = (np.concatenate(v) for v in zip(*leaves, strict=True))
    keep = least <= most[q] * (1 + 1e-9) + 1e-6
    return _compared(x, nodes[q[keep]], centroids, tree, c[keep])


def _compared(x: np.ndarray, leaf: np.ndarray, centroids: np.ndarray, tree: CoverTree, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The least distances of the vectors of leaves to the centroids of leaves, pair by pair of ``leaf`` and ``c``."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    number = np.full(len(x), len(centroids))
    pairs = [np.zeros(0, np.int64)] * 2
    n = (leaf["hi"] - leaf["lo"]).astype(np.int64)
    row = np.repeat(leaf["lo"] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    node = np.repeat(c, n)
    m = (tree.nodes["hi"] - tree.nodes["lo"]).astype(np.int64)[node]  # over one where centroids are equal
    pairs = np.repeat(row, m), tree.order[np.repeat(tree.nodes["lo"][node] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
    for at in range(0, len(pairs[0]), AT_ONCE):
        i, k = (p[at : at + AT_ONCE] for p in pairs)
        d = x[i] - centroids[k]
        d = np.einsum("ij,ij->i", d, d)
        by = np.lexsort((k, d, i))
        by = by[np.append(True, i[by][1:] != i[by][:-1])]
        i, k, d = i[by], k[by], d[by]
        better = (d < best[i]) | ((d == best[i]) & (k < number[i]))
        best[i[better]], number[i[better]] = d[better], k[better]
    return number, best, len(pairs[0])


BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("nodes", pa.binary())])
BLOCKS_SQL = "ids array<long>, vectors binary, nodes binary"


def _block_task(block: int):
    def made(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        tree = CoverTree.of(x, LEAF)
        ids = ids.take(pa.array(tree.order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x[tree.order].astype("<i4").tobytes()]), pa.array([tree.nodes.tobytes()])], schema=BLOCKS)

    def run(batches):
        ids, vectors, held = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                ids.append(part.column("vec_id"))
                vectors.append(np.floor(SCALE * part.column("x").flatten().to_numpy().astype(np.float64)).astype(np.int64).reshape(part.num_rows, SIZE))
                held += part.num_rows
                if held >= block:
                    yield made(pa.concat_arrays(ids), np.concatenate(vectors))
                    ids, vectors, held = [], [], 0
        if held:
            yield made(pa.concat_arrays(ids), np.concatenate(vectors))

    return run


def _each_block(batches, centroids: np.ndarray):
    tree = CoverTree.of(centroids, 1)
    for b in batches:
        for ids, vectors, nodes in zip(b.column("ids"), b.column("vectors"), b.column("nodes"), strict=True):
            x = np.frombuffer(vectors.as_py(), "<i4").astype(np.int64).reshape(-1, SIZE)
            number, distance, _ = nearest(x, np.frombuffer(nodes.as_py(), NODE), centroids, tree)
            yield ids.values, x, number, distance


SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _round_task(centroids: np.ndarray):
    def run(batches):
        sums, n = np.zeros((len(centroids), SIZE), np.int64), np.zeros(len(centroids), np.int64)
        for _, x, number, _ in _each_block(batches, centroids):
            np.add.at(sums, number, x)
            n += np.bincount(number, minlength=len(n))
        held = np.flatnonzero(n)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], schema=SUMS)

    return run


def _assign_task(centroids: np.ndarray):
    def run(batches):
        for ids, _, number, distance in _each_block(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance)], schema=ASSIGNED)

    return run


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of means, of sums that Spark adds up as decimals."""
    parts = blocks.mapInArrow(_round_task(centroids), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("component", "sum"))
    totals = each.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(20,0)")).alias("sum")).collect()  # k x 64 rows
    out = centroids.copy()
    for r in totals:
        out[r["cluster"], r["component"]] = int(r["sum"]) // r["n"]
    return out


def kept(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable vectors."""
    usable = (F.size("embedding") == SIZE) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LIMIT))
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each usable vector, the centroids)."""
    spark = embeddings.sparkSession
    prepare(spark)
    vectors = kept(embeddings)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    blocks = materialize(vectors.mapInArrow(_block_task(block), BLOCKS_SQL), "blocks")
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, SIZE), np.int64)
    centroids = np.floor(SCALE * np.array([r["x"] for r in first], np.float64)).astype(np.int64)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    return materialize(blocks.mapInArrow(_assign_task(centroids), "vec_id long, cluster int, distance long"), "assigned"), centroids


def query(embeddings: DataFrame) -> DataFrame:
    """The contract's digest."""
    assigned, centroids = cluster(embeddings)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row for each of k clusters
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    of_cluster = embeddings.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """The contract in SQL, every vector against every centroid."""
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assign = f"SELECT rid, any_value(x) AS x, min(d) AS distance, arg_min(k, d * {k} + k) AS k FROM (SELECT v.rid, v.x, c.k, CAST({near} AS BIGINT) AS d FROM vectors v, {{c}} c) GROUP BY rid"
    steps = [
        f"""vectors AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * e::DOUBLE) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE}
        )""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, x FROM vectors ORDER BY k LIMIT {k})",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({assign.format(c=f'c{i}')})")
        steps.append(
            f"""c{i + 1} AS MATERIALIZED (
            SELECT o.k, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN (
                SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY nth) AS x
                FROM (SELECT k, nth, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, unnest(range(0, {SIZE})) AS nth FROM a{i}) GROUP BY k, nth) GROUP BY k
            ) m ON m.k = o.k)"""
        )
    steps.append(f"final AS MATERIALIZED ({assign.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(f.k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.k) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM final f JOIN vectors USING (rid) JOIN c{rounds} c ON c.k = f.k"""


ORACLE = oracle()
