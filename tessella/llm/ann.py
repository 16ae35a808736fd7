"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors: the graph of nearest neighbours is cut into parts of
about equal size (capacity-bound moves from a balanced start, each move keeping more
neighbours together), a small network learns which part a vector's neighbours lie in,
and the number of parts that a query must probe for the wanted recall is measured on
sample queries against brute force. Every vector is then indexed under the part that
the network finds most probable; queries go to their most probable parts, and all
vectors there are reranked by the exact inner product in double precision: first those
of the most probable part, then those of the others that reach the score of the k-th.

A part of more than ``leaf_rows`` vectors is cut again in the same way, by a network of its
own that is fitted in a task on a bounded sample of the part, level by level, so that
parts do not grow with the table; a query goes on to the most probable parts of each part
that it reached.

Parts and the queries sent to them are dealt into blocks of bounded size, so no task
holds a part. Of vectors that are equal bit for bit, only the smallest ids can be among
the nearest, so a block reranks each distinct vector once. A query that found fewer
than k goes to all parts, so that it misses none for want of probes.

Defined results: vectors that are null, zero or hold null or non-finite components take
no part, nor do vectors of another length than most have; ties go to the smaller id;
rows with a query's own id are not its candidates; rows with a null id take no part;
repeated rows are candidates of their own. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.session import lean, materialise, ship

#: Vectors that the parts and the network are fitted on at most.
SAMPLE_ROWS = 8192
#: Parts that one network tells apart at most, and vectors that a part is meant to have.
MAX_PARTS = 128
PART_ROWS = 2048
#: Vectors from which a part is cut again.
LEAF_ROWS = 1 << 16
#: Cells whose numbers of blocks are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
MEMBER_BLOCK = 8192
QUERY_BLOCK = 2048
WANTED_RECALL = 0.97


def _neighbours(base: np.ndarray, queries: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Places in ``base`` of each query's k greatest inner products; own: query i is base i and left out."""
    out = []
    for a in range(0, len(queries), 128):
        scores = queries[a : a + 128] @ base.T
        if own:
            scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        # A copy: a view would keep the places of all vectors, block after block.
        out.append(np.argpartition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, :k].copy())
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1, sweeps: int = 20) -> np.ndarray:
    """Part of each node: a balanced cut of the neighbour graph."""
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(10):
        near = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)
        for p in range(parts):
            if (near == p).any():
                centres[p] = x[near == p].mean(0)
    score = x @ centres.T - (centres**2).sum(1) / 2
    part, held = np.full(n, -1), np.zeros(parts, int)
    for i in np.argsort(-(np.partition(score, -min(2, parts), axis=1)[:, -1] - np.partition(score, -min(2, parts), axis=1)[:, -min(2, parts)])):
        for p in np.argsort(-score[i]):
            if held[p] < room:
                part[i], held[p] = p, held[p] + 1
                break
    for _ in range(sweeps):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            if held[best[i]] < room:
                held[part[i]] -= 1
                held[best[i]] += 1
                part[i], moved = best[i], moved + 1
        if moved < n // 1000:
            break
    return part


class Router:
    """A network of one hidden layer: probability of each part, for vectors of any length scaled to one."""

    def __init__(self, weights: tuple[np.ndarray, ...]):
        self.weights = weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(x @ a + b, 0) @ c + d

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, steps: int = 1500, batch: int = 256, rate: float = 3e-3) -> Router:
        dim, parts = x.shape[1], target.shape[1]
        w = [rng.normal(0, dim**-0.5 * 2, (dim, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            h = x[at] @ w[0] + w[1]
            active = np.maximum(h, 0)
            z = active @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            dz = (p / p.sum(1, keepdims=True) - target[at]) / batch
            dh = (dz @ w[2].T) * (h > 0)
            grads = [x[at].T @ dh, dh.sum(0), active.T @ dz, dz.sum(0)]
            for i, g in enumerate(grads):
                g = g + 1e-5 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (1 - step / (steps + 1)) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return cls(tuple(w))


def fit(sample: np.ndarray, parts: int, k: int, wanted: float = WANTED_RECALL, seed: int = 7) -> tuple[Router, int]:
    """The router, and how many parts a query probes for the wanted recall on sample queries."""
    rng = np.random.default_rng(seed)
    if parts < 2:
        return Router((np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))), 1
    graph = _neighbours(sample, sample, 10, own=True)
    part = balanced_parts(sample, graph, parts, rng)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(sample)), part] += 0.5
    asked = rng.permutation(len(sample))[: min(1024, len(sample) // 4)]
    learned = np.setdiff1d(np.arange(len(sample)), asked)
    router = Router.fit(sample[learned], target[learned], rng)
    home = router.logits(sample).argmax(1)
    order = np.argsort(-router.logits(sample[asked]), axis=1)
    true = home[_neighbours(sample, sample[asked], k + 1, own=False)]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    reached = np.take_along_axis(rank, true, axis=1)
    for probes in range(1, parts + 1):
        if (reached < probes).mean() >= wanted:
            break
    return router, probes


def _top(scores: np.ndarray, queries: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, owners: list[np.ndarray], k: int):
    """(query, vec, score) of each query's k best; vectors are distinct, owners[j] are the ids of vector j."""
    q_out, v_out, s_out = [], [], []
    for i, q in enumerate(q_ids):
        row = scores[i]
        wanted = min(k + 1, len(row))
        least = max(np.partition(row, len(row) - wanted)[len(row) - wanted], floors[i])
        at = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
        # Sums in a fixed order, so that a pair scores the same in every block.
        exact = (vectors[at] * queries[i]).sum(axis=1)
        at, exact = at[exact >= floors[i]], exact[exact >= floors[i]]
        ids = [owners[j][owners[j] != q][:k] for j in at]
        if not ids:
            continue
        flat = np.concatenate(ids)
        score = np.repeat(exact, [len(x) for x in ids])
        first = np.lexsort((flat, -score))[:k]
        q_out.append(np.full(len(first), q))
        v_out.append(flat[first])
        s_out.append(score[first])
    return np.concatenate([np.zeros(0, np.int64), *q_out]), np.concatenate([np.zeros(0, np.int64), *v_out]), np.concatenate([np.zeros(0), *s_out])


_FOUND = "query_id long, vec_id long, score double"


def _rerank(k: int):
    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not asked.num_rows or not members.num_rows:
            return empty
        read = lambda t: np.frombuffer(b"".join(t.column("packed").to_pylist()), np.float64).reshape(t.num_rows, -1)
        ids, packed = members.column("id").to_numpy(), members.column("packed").to_pylist()
        by_vector: dict[bytes, list[int]] = {}
        for i in np.argsort(ids, kind="stable"):
            same = by_vector.setdefault(packed[i], [])
            if len(same) <= k:
                same.append(int(ids[i]))
        vectors = np.frombuffer(b"".join(by_vector), np.float64).reshape(len(by_vector), -1)
        owners = [np.array(x) for x in by_vector.values()]
        queries, q_ids, floors = read(asked), asked.column("id").to_numpy(), asked.column("floor").to_numpy()
        out = [_top(queries[a : a + 256] @ vectors.T, queries[a : a + 256], q_ids[a : a + 256], floors[a : a + 256], vectors, owners, k) for a in range(0, len(q_ids), 256)]
        return pa.table({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def usable(vector: Column, dim: int | None = None) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(whole if dim is None else whole & (F.size(vector) == dim), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


_ROUTERS = "cell string, router binary"


def _fit_cell(part_rows: int, k: int, wanted: float):
    def run(key, sample):
        x = _matrix(sample.column("packed"))
        parts = max(2, min(MAX_PARTS, int(sample.column("n")[0].as_py()) // part_rows, len(x) // 16))
        router, probes = fit(x, parts, k, wanted)
        return pa.table({"cell": [key[0].as_py()], "router": [pickle.dumps((router.weights, probes))]})

    return run


def _send(all_probes: bool):
    """Rows of a cell to the most probable cell within it, or to as many as a query probes."""

    def run(rows: pa.Table, routers: pa.Table) -> pa.Table:
        out = {"id": [], "cell": [], "place": [], "packed": []}
        if rows.num_rows and routers.num_rows:
            weights, probes = pickle.loads(routers.column("router")[0].as_py())
            order = np.argsort(-Router(weights).logits(_matrix(rows.column("packed"))), axis=1, kind="stable")[:, : probes if all_probes else 1]
            for i, cell, place, packed, parts in zip(*(rows.column(c).to_pylist() for c in ("id", "cell", "place", "packed")), order.tolist()):
                for r, p in enumerate(parts):
                    out["id"].append(i)
                    out["cell"].append(f"{cell}.{p}")
                    out["place"].append(place * MAX_PARTS + r)
                    out["packed"].append(packed)
        return pa.table({"id": pa.array(out["id"], pa.int64()), "cell": pa.array(out["cell"], pa.string()), "place": pa.array(out["place"], pa.int64()), "packed": pa.array(out["packed"], pa.binary())})

    return run


_SENT = "id long, cell string, place long, packed binary"


def _cut_again(members: DataFrame, asked: DataFrame, leaf_rows: int, part_rows: int, sample_rows: int, k: int, wanted: float) -> tuple[DataFrame, DataFrame, bool]:
    """members and asked (id, cell, place, packed) with the cells above leaf_rows cut; whether any was."""
    large = materialise(members.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows).withColumn("deals", F.ceil(F.col("n") / MEMBER_BLOCK).cast("int")), "ann-large")
    if not large.limit(1).count():
        return members, asked, False
    held = members.join(large, "cell").withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))).where(F.col("rank") <= sample_rows)
    routers = materialise(held.select("cell", "n", "packed").groupBy("cell").applyInArrow(_fit_cell(part_rows, k, wanted), _ROUTERS), "ann-routers")
    dealt = routers.join(large, "cell").select("cell", "router", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))

    def sent(rows: DataFrame, all_probes: bool) -> DataFrame:
        placed = rows.join(large.select("cell", "deals"), "cell").withColumn("deal", F.pmod(F.xxhash64("id"), "deals").cast("int")).drop("deals")
        again = placed.groupBy("cell", "deal").cogroup(dealt.groupBy("cell", "deal")).applyInArrow(_send(all_probes), _SENT)
        return materialise(rows.join(large, "cell", "left_anti").select("id", "cell", "place", "packed").unionByName(again), "ann-sent")

    return sent(members, False), sent(asked, True), True


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, parts: int | None = None,
    wanted: float = WANTED_RECALL, leaf_rows: int = LEAF_ROWS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of every query (rows where is_query) among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.withColumn("_asks", is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce("_asks", F.lit(False)).alias("asks")).where("id IS NOT NULL")
    sizes = rows.where(usable(F.col("v"))).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(usable(F.col("v"), sizes.dim))
    sample = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    sample = sample.column("v").combine_chunks().flatten().to_numpy().reshape(-1, sizes.dim)
    if parts is None:
        parts = max(2 if len(sample) >= 128 else 1, min(MAX_PARTS, sizes.n // part_rows, len(sample) // 64))
    router, probes = fit(sample, parts, k, wanted)
    shared = spark.sparkContext.broadcast((router.weights, probes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, n_probes = shared.value
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            order = np.argsort(-Router(weights).logits(x), axis=1, kind="stable")
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            goes = [list(map(str, o[:n_probes].tolist())) if a else None for o, a in zip(order, asks)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(list(map(str, order[:, 0].tolist())), pa.string()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(goes, pa.list_(pa.string())),
            ], names=["id", "cell", "packed", "goes"])

    placed = materialise(rows.mapInArrow(lean(place), "id long, cell string, packed binary, goes array<string>"), "ann-placed")
    members = placed.select("id", "cell", F.lit(0).cast("long").alias("place"), "packed")
    asking = materialise(placed.where("goes IS NOT NULL").dropDuplicates(["id"]), "ann-asking")
    asked = asking.select("id", "packed", F.posexplode("goes").alias("place", "cell")).select("id", "cell", F.col("place").cast("long").alias("place"), "packed")
    cut = True
    while cut:
        members, asked, cut = _cut_again(members, asked, leaf_rows, part_rows, sample_rows, k, wanted)

    def nearest(queries: DataFrame) -> DataFrame:
        """queries: id, packed, cell to probe, floor (least score of interest)."""
        queries = materialise(queries, "ann-asked")
        q_blocks = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qs"))
        m_blocks = members.groupBy("cell").agg(F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("ms"))
        blocks = materialise(m_blocks.join(q_blocks, "cell"), "ann-blocks")
        blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_CELLS else blocks
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        sent = queries.join(blocks, "cell").select("id", "packed", "floor", "cell", F.pmod(F.xxhash64("id"), "qs").cast("int").alias("q"), each("ms").alias("m"))
        held = members.join(blocks, "cell").select("id", "packed", "cell", F.pmod(F.xxhash64("id"), "ms").cast("int").alias("m"), each("qs").alias("q"))
        keys = ["cell", "q", "m"]
        return sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_rerank(k), _FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    anything = F.lit(float("-inf"))
    found = materialise(ranked(nearest(asked.where("place = 0").select("id", "packed", "cell", anything.alias("floor")))), "ann-first")
    floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    others = asked.where("place > 0").join(floors, "id", "left").select("id", "packed", "cell", F.coalesce("least", anything).alias("floor"))
    found = materialise(ranked(found.drop("rank").unionByName(nearest(others))), "ann-found")
    cells = members.select("cell").distinct()
    short = asking.select("id", "packed").join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    # Each goes to all cells; fewer than k found is the exception, or the whole table has no more.
    if short.limit(1).count():
        again = ranked(nearest(short.crossJoin(cells).select("id", "packed", "cell", anything.alias("floor"))))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns: queries are the rows whose id is divisible by 20."""
    return search(vectors, F.col("vec_id") % 20 == 0)
