"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors form a class with the k + 1 least ids (no query can return a
later one), so copies cost nothing and ties come out by id. Classes are dealt to
shards of bounded size. In a shard every class is inserted by a greedy search
from the entry point, whose visited nodes are its proposed neighbours; robust
pruning keeps a proposal unless a kept one is closer to it by the factor ALPHA,
so edges stay diverse; reverse edges are added and pruned alike. A query runs a
beam search in each shard, with distances in double precision on the original
vectors, and the nearest over all shards are ranked.

Every query meets every shard, in blocks of queries, and each pair costs one beam
search, which hardly grows with the shard: larger shards cost less in all, until
a task takes too long to build one (SHARD; 3 ms a vector). Sending a query to
the shards of its nearest centroids only was measured: neighbours in many
dimensions lie in most cells (of 18 cells the nearest 8 hold 0.84 of the true
neighbours, 12 hold 0.96), so it would save little and lose much. No task holds
more than one shard and one block of queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, and neither do rows without an id; equal rows count
once; vectors of different length are never compared; fewer than k candidates
give fewer rows; an empty table gives none; no column of the caller but id and
vector is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutalog.llm.shared import written

#: Vectors in a shard, about, and queries in a block.
SHARD, BLOCK = 10_000, 20_000
DEGREE, BUILD_BEAM, ALPHA, QUERY_BEAM = 24, 48, 1.2, 128


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part, equal rows once."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vec"))).distinct()


def classes(points: DataFrame, k: int) -> DataFrame:
    """One row per different vector: vec, ids (its k + 1 least, ascending)."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    least = points.withColumn("__rank", rank).where(F.col("__rank") <= k + 1)
    return least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Graph:
    """A directed graph over the rows of x; distances are squared inside."""

    def __init__(self, x: np.ndarray, edges: list[np.ndarray] | None = None, entry: int | None = None):
        self.x, self.n = x, len(x)
        self.entry = entry if entry is not None else int(((x - x.mean(0)) ** 2).sum(1).argmin()) if len(x) else 0
        self.edges = edges if edges is not None else [np.zeros(0, np.int32) for _ in range(len(x))]

    def search(self, q: np.ndarray, beam: int) -> tuple[list[tuple[float, int]], list[int]]:
        """The beam nearest found, nearest first, and every node that was expanded."""
        x, edges = self.x, self.edges
        seen = np.zeros(self.n, bool)
        seen[self.entry] = True
        d = float(((x[self.entry] - q) ** 2).sum())
        open_, best, visited = [(d, self.entry)], [(-d, self.entry)], []
        while open_:
            d, node = heapq.heappop(open_)
            if len(best) >= beam and d > -best[0][0]:
                break
            visited.append(node)
            near = edges[node]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            gap = x[near] - q
            for e, v in zip(np.einsum("ij,ij->i", gap, gap).tolist(), near.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (-e, v))
                    heapq.heappush(open_, (e, v))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, v))
                    heapq.heappush(open_, (e, v))
        return sorted((-e, v) for e, v in best), visited

    def prune(self, p: int, proposed: np.ndarray) -> np.ndarray:
        """Robust pruning: nearest first, dropping what a kept neighbour covers by the factor ALPHA."""
        proposed = np.unique(proposed[proposed != p])
        y = self.x[proposed]
        norms = np.einsum("ij,ij->i", y, y)
        between = norms[:, None] + norms[None, :] - 2 * (y @ y.T)
        gap = y - self.x[p]
        own = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(own, kind="stable")
        own, between = own[order], between[np.ix_(order, order)]
        alive, kept = np.ones(len(order), bool), []
        at = 0
        while len(kept) < DEGREE:
            left = np.flatnonzero(alive[at:])
            if not len(left):
                break
            at += int(left[0])
            kept.append(at)
            alive &= ALPHA * ALPHA * between[at] > own
            alive[at] = False
        return proposed[order[kept]].astype(np.int32)

    def build(self) -> "Graph":
        for p in np.random.default_rng(5).permutation(self.n).tolist():
            if p == self.entry:
                continue
            _, visited = self.search(self.x[p], BUILD_BEAM)
            self.edges[p] = self.prune(p, np.concatenate([np.array(visited, np.int32), self.edges[p]]))
            for v in self.edges[p].tolist():
                grown = np.append(self.edges[v], np.int32(p))
                self.edges[v] = self.prune(v, grown) if len(grown) > 2 * DEGREE else grown
        return self


_GRAPH = "dim int, shard int, node int, vec array<double>, ids array<bigint>, edges array<int>, entry boolean"


def _built(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one shard as its graphs, one for each length of vectors."""
    for (dim, shard), pdf in pd.concat([pd.DataFrame(columns=["dim", "shard", "vec_id", "vec", "ids"]), *parts]).groupby(["dim", "shard"]):
        pdf = pdf.sort_values("vec_id", kind="stable").reset_index(drop=True)
        g = Graph(np.stack(pdf["vec"].to_numpy())).build()
        yield pd.DataFrame({"dim": dim, "shard": shard, "node": np.arange(g.n, dtype=np.int32), "vec": pdf["vec"], "ids": pdf["ids"], "edges": g.edges, "entry": np.arange(g.n) == g.entry})


def index(points: DataFrame, k: int = 10, shard_size: int = SHARD) -> DataFrame:
    """The graphs of all vectors as a table: dim, shard, node, vec, ids, edges, entry. k: most neighbours a query may ask for."""
    made = written(classes(points, k))
    shards = max(1, -(-made.count() // shard_size))
    first = F.col("ids")[0]
    rows = made.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64(first), F.lit(shards)).cast("int").alias("shard"), first.alias("vec_id"), "vec", "ids")
    # a task for each shard: small partitions would be merged otherwise, and building takes long for its bytes
    return written(rows.repartitionById(shards, "shard").mapInPandas(_built, _GRAPH))


def _found(k: int, beam: int):
    def run(key: tuple, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(graph) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        graph = graph.sort_values("node")
        g = Graph(np.stack(graph["vec"].to_numpy()), [np.asarray(e, np.int32) for e in graph["edges"]], int(graph["node"][graph["entry"]].iloc[0]))
        ids, out = list(graph["ids"]), []
        for query, q in zip(queries["vec_id"].tolist(), queries["vec"]):
            near, _ = g.search(np.asarray(q), beam)
            mine = sorted((np.sqrt(d), int(v)) for d, node in near for v in ids[node] if v != query)
            out += [(query, v, d) for d, v in mine[:k]]
        return pd.DataFrame(out, columns=names).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, beam: int = QUERY_BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, vec), itself left out."""
    blocks = max(1, -(-queries.count() // block))
    shards = graphs.groupBy("dim", "shard").agg(F.count("*").alias("n")).toDF("dim", "shard", "n").drop("n")
    asked = queries.withColumn("dim", F.size("vec")).join(shards, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    on = ["dim", "shard", "block"]
    asked = asked.select("vec_id", "vec", *(F.col(c).alias(f"q_{c}") for c in on))
    near = held.groupBy(*on).cogroup(asked.groupBy(*(f"q_{c}" for c in on))).applyInPandas(_found(k, beam), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
