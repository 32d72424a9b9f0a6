"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard, and beam search.

Vectors get a last component sqrt(M^2 - |x|^2) (M: the largest norm of the shard) so that the largest inner product
with a query is the smallest Euclidean distance to (query, 0). Nodes are inserted in batches: a greedy search in the
graph so far proposes neighbours; robust pruning takes the nearest, drops every candidate that is ``ALPHA`` times nearer
to it than to the node, and goes on; links back are added and pruned in the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, written

#: Links of a node, beam while building and while searching, relaxation of the pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 96, 1.2
#: Distinct vectors of a shard, and queries that one task takes through a shard.
SHARD_ROWS, QUERY_ROWS = 8192, 65536
_EXPAND = 4


def _beam(x: np.ndarray, norm: np.ndarray, links: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: the ``beam`` nearest nodes found (ids, -1 for none) and their distances."""
    m, n = len(q), len(x)
    seen = np.zeros((m, n), bool)
    seen[:, entry] = True
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, norm[entry] - 2 * (q @ x[entry]), False
    live = np.arange(m)
    while len(live):
        d = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(d, min(_EXPAND, beam) - 1, axis=1)[:, :_EXPAND]
        open_ = np.isfinite(np.take_along_axis(d, pick, 1))
        keep = open_.any(axis=1)
        live, pick, open_ = live[keep], pick[keep], open_[keep]
        if not len(live):
            break
        at = np.take_along_axis(ids[live], pick, 1)
        done[live[:, None], pick] = True
        near = np.where(open_[:, :, None], links[at], -1).reshape(len(live), -1)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[live[:, None], near]
        row, col = np.nonzero(fresh)
        node = near[row, col]
        seen[live[row], node] = True
        new = np.full(near.shape, np.inf, np.float32)
        new[row, col] = norm[node] - 2 * np.einsum("ij,ij->i", x[node], q[live[row]])
        every = np.concatenate([dist[live], new], axis=1)
        best = np.argpartition(every, beam - 1, axis=1)[:, :beam]
        dist[live] = np.take_along_axis(every, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    dist = np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), np.take_along_axis(ids, order, 1), -1), dist


def _prune(x: np.ndarray, norm: np.ndarray, node: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of a pool of candidates (-1: none) for each node: at most ``degree`` diverse links."""
    valid = (pool >= 0) & (pool != node[:, None])
    v = x[np.maximum(pool, 0)]
    size = norm[np.maximum(pool, 0)]
    dist = norm[node][:, None] + size - 2 * np.einsum("bpd,bd->bp", v, x[node])
    dist = np.where(valid, np.maximum(dist, 0), np.inf)
    between = size[:, :, None] + size[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(node), degree), -1, np.int64)
    rows = np.arange(len(node))
    for k in range(degree):
        best = np.argmin(dist, axis=1)
        ok = np.isfinite(dist[rows, best])
        if not ok.any():
            break
        out[ok, k] = pool[rows[ok], best[ok]]
        gone = alpha * alpha * np.maximum(between[rows, best], 0) <= dist  # squared distances
        gone[rows, best] = True
        gone |= pool == pool[rows, best][:, None]
        dist = np.where(gone & ok[:, None], np.inf, dist)
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
                seed: int = 1) -> tuple[np.ndarray, int]:
    """Links (n, degree), -1 for none, and the node to start from."""
    x = augmented(vectors)
    n = len(x)
    norm = np.einsum("ij,ij->i", x, x)
    links = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    middle = x.mean(axis=0)
    entry = int(np.argmin(norm - 2 * (x @ middle)))
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        batch = order[done:done + min(256, max(1, done // 2))]
        found, _ = _beam(x, norm, links, entry, x[batch], beam)
        links[batch] = _prune(x, norm, batch, found, degree, alpha)
        done += len(batch)
        source = np.repeat(batch, degree)
        target = links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        node, count = target[first], np.diff(np.r_[first, len(target)])
        back = np.full((len(node), count.max()), -1, np.int64)
        back[np.repeat(np.arange(len(node)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for k in range(0, len(node), 256):
            some = node[k:k + 256]
            pool = np.concatenate([links[some], back[k:k + 256]], axis=1)
            full = (pool >= 0).sum(axis=1) > degree
            pool.sort(axis=1)
            links[some[~full]] = pool[~full][:, -degree:]  # -1 sorts first
            if full.any():
                links[some[full]] = _prune(x, norm, some[full], pool[full], degree, alpha)
    return links, entry


def augmented(vectors: np.ndarray) -> np.ndarray:
    size = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(size.max() - size, 0))[:, None]], axis=1).astype(np.float32)


def search_graph(vectors: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, k: int, beam: int) -> np.ndarray:
    """Ids (queries, k) of the nodes nearest by inner product, as the beam search finds them; -1 for none."""
    x = augmented(vectors)
    norm = np.einsum("ij,ij->i", x, x)
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    out = [_beam(x, norm, links, entry, q[i:i + 256], max(beam, k))[0][:, :k] for i in range(0, len(q), 256)]
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def usable(column) -> F.Column:
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return column.isNotNull() & finite & F.exists(column, lambda x: x != 0)


def build_index(vectors: DataFrame, copies: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> (dim, shard, node, entry, embedding, ids, links), a row per distinct vector.

    ``ids`` are the ``copies`` smallest ids that have the vector: no search for fewer neighbours can need more, so a
    vector that many rows share is one node. Vectors of different length are in shards of their own.
    """
    prepare(vectors)
    # row_number under a bound: a frequent vector is cut down to so many rows before the shuffle
    by = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(by)).where(F.col("r") <= copies)
    nodes = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding"))
    nodes = written(nodes, "vectors")
    # a task for each shard: a graph takes far longer than its few megabytes suggest
    tasks = max(1, -(-nodes.count() // shard_rows)) * 2
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    nodes = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda v: v[0]), kind="stable").reset_index(drop=True)
        links, entry = build_graph(np.stack(pdf.embedding.values).astype(np.float64))
        return pd.DataFrame({"dim": key[0], "shard": key[1], "node": np.arange(len(pdf)), "entry": entry,
                             "embedding": pdf.embedding, "ids": pdf.ids, "links": [x[x >= 0] for x in links]})

    schema = "dim int, shard int, node int, entry int, embedding array<double>, ids array<long>, links array<int>"
    return written(nodes.select("dim", "shard", "ids", "embedding").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, schema), "graph")


def search(queries: DataFrame, index: DataFrame, k: int, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query, itself left out; ties to the smaller vec_id.

    Every shard answers blocks of ``query_rows`` queries. A task reads a shard once and then its queries as a stream of
    Arrow batches, so it holds one shard and one batch, and blocks are large: the index is copied far less often than
    queries are. Scores are inner products in double precision; a vec_id with several vectors counts with its best.
    """
    prepare(queries)
    n = queries.count()
    blocks = max(1, -(-n // query_rows))
    none = F.lit(None)
    q = queries.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding")
    q = q.join(index.select("dim", "shard").distinct(), "dim").select(
        "dim", "shard", "block", F.lit(1).alias("kind"), F.lit(0).alias("node"), F.lit(0).alias("entry"), "vec_id", "embedding",
        none.cast("array<long>").alias("ids"), none.cast("array<int>").alias("links"))
    nodes = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "dim", "shard", "block", F.lit(0).alias("kind"), "node", "entry", F.lit(0).cast("long").alias("vec_id"), "embedding", "ids", "links")
    tasks = 2 * blocks * max(1, index.select("dim", "shard").distinct().count())
    place = ["dim", "shard", "block"]
    rows = nodes.unionByName(q).repartition(tasks, *place).sortWithinPartitions(*place, "kind", "node")

    def answer(graph: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        x, links, entry, ids = graph
        qs = np.stack(asked.embedding.values)
        found = search_graph(x, links, entry, qs, k + 1, beam)
        out = []
        for i, own in enumerate(asked.vec_id.values):
            nodes = found[i][found[i] >= 0]
            score = (x[nodes] * qs[i]).sum(axis=1)
            vec = np.concatenate([ids[j] for j in nodes])
            score = np.repeat(score, [len(ids[j]) for j in nodes])
            score, vec = score[vec != own], vec[vec != own]
            best = np.lexsort((vec, -score))[:k]
            out.append(pd.DataFrame({"query_id": np.full(len(best), own), "vec_id": vec[best], "score": score[best]}))
        return pd.concat(out)

    def opened(held: list[pd.DataFrame]) -> tuple:
        graph = pd.concat(held)
        links = np.full((len(graph), max(1, max(map(len, graph.links)))), -1, np.int64)
        for i, v in enumerate(graph.links.values):
            links[i, :len(v)] = v
        return np.stack(graph.embedding.values), links, int(graph.entry.iloc[0]), graph.ids.values

    def find(batches):
        at, held, graph = None, [], None  # a shard's nodes come before its queries
        for pdf in batches:
            for key, part in pdf.groupby([*place, "kind"], sort=True):
                if key[:3] != at:
                    at, held, graph = key[:3], [], None
                if key[3] == 0:
                    held.append(part)
                    continue
                if graph is None:
                    graph, held = opened(held), []
                yield answer(graph, part)

    found = rows.mapInPandas(find, "query_id long, vec_id long, score double").repartition("query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest of every row whose vec_id is divisible by ``every``, among all other rows, by inner product.

    ``vectors(vec_id, embedding)``. Vectors that are null, zero, or hold null or non-finite components, and rows
    without a vec_id, take no part; neither do pairs of different length. Rows that repeat a vec_id with its vector count
    once; of a vec_id with several vectors, as a query or a candidate, the best pair counts, and each vec_id is named once. Other columns are ignored; no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    return search(rows.where(F.col("vec_id") % every == 0), build_index(rows, k + 1), k)
