"""Approximate nearest neighbours: a hierarchical small-world graph a shard, results merged."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidemesh.llm.common import saved, shared_dir, table


@dataclass(frozen=True)
class HnswParams:
    shard_rows: int = 16_384  # distinct vectors of a shard, on average
    degree: int = 24  # links a node gets; the bottom layer holds twice as many
    pool: int = 96  # nearest nodes from which links are chosen
    layer: int = 16  # a layer has about this share fewer nodes than the one below
    beam: int = 160  # nodes a search of the bottom layer keeps
    k: int = 20
    queries: int = 256  # of a block that is searched together
    part_queries: int = 4_096  # that one task takes to a shard


def _levels(keys: np.ndarray, layer: int) -> np.ndarray:
    """Top layer of each node: a hash of its vector, so it does not depend on order or on others."""
    z = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.minimum(np.floor(-np.log(u) / np.log(layer)), 8).astype(np.int8)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more component gives all vectors one length, so the largest product is the least distance."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1, keepdims=True), 0))])


def _links(x: np.ndarray, degree: int, most: int, pool: int) -> np.ndarray:
    """Flat neighbour array [n, most], -1 where empty, of one layer's nodes.

    Each node's ``pool`` nearest nodes are found block by block; a node nearer to an already chosen
    neighbour than to the node itself is passed over, so links also lead out of dense spots. Links
    run both ways as far as there is room, the nearest first.
    """
    n = len(x)
    flat = np.full((n, most), -1, dtype=np.int32)
    if n < 2:
        return flat
    pool = min(pool, n - 1)
    chosen: list[list[int]] = []
    for lo in range(0, n, 512):
        sims = x[lo : lo + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(lo, lo + len(sims))] = -np.inf
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        for row, cand in enumerate(near):
            among = x[cand] @ x[cand].T
            own = sims[row, cand]
            take: list[int] = []
            for c in range(len(cand)):
                if len(take) == degree:
                    break
                if not take or (among[c, take] < own[c]).all():
                    take.append(c)
            rest = [c for c in range(len(cand)) if c not in set(take)][: degree - len(take)]
            chosen.append([int(cand[c]) for c in take + rest])
    back: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    for i, js in enumerate(chosen):
        for j in js:
            back[j].append((float(-(x[i] @ x[j])), i))
    for i in range(n):
        both = list(dict.fromkeys(chosen[i] + [j for _, j in sorted(back[i])]))[:most]
        flat[i, : len(both)] = both
    return flat


def build(vectors: np.ndarray, keys: np.ndarray, p: HnswParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top down, each ``(nodes, neighbours)`` with neighbours as places in ``nodes``."""
    top = float((vectors * vectors).sum(axis=1).max())
    x, level = _lifted(vectors, top), _levels(keys, p.layer)
    layers = []
    for at in range(int(level.max()), -1, -1):
        nodes = np.flatnonzero(level >= at).astype(np.int32)
        layers.append((nodes, _links(x[nodes], p.degree, p.degree * (2 if at == 0 else 1), p.pool)))
    return layers


def search(queries: np.ndarray, vectors: np.ndarray, layers: list, beam: int) -> np.ndarray:
    """Places [queries, beam] of the nearest nodes found, -1 where there are none.

    All queries of a block walk the graph together: in the upper layers each keeps a few nodes, in
    the bottom one ``beam``; every step opens each query's best node that is not yet open, and it
    ends when no query has one left.
    """
    q = len(queries)
    entry = np.repeat(layers[0][0][:1][None, :], q, axis=0)
    for depth, (nodes, links) in enumerate(layers):
        width = beam if depth == len(layers) - 1 else 8
        place = np.full(len(vectors), -1, dtype=np.int64)
        place[nodes] = np.arange(len(nodes))
        held = np.full((q, width), -1, dtype=np.int64)
        score = np.full((q, width), -np.inf)
        opened = np.ones((q, width), dtype=bool)
        seen = np.zeros((q, len(nodes)), dtype=bool)
        e = place[entry[:, : min(width, entry.shape[1])]]
        ok = entry[:, : e.shape[1]] >= 0
        held[:, : e.shape[1]] = np.where(ok, e, -1)
        s = np.einsum("qd,qed->qe", queries, vectors[nodes[np.maximum(e, 0)]])
        score[:, : e.shape[1]] = np.where(ok, s, -np.inf)
        opened[:, : e.shape[1]] = ~ok
        r, c = np.nonzero(ok)
        seen[r, e[r, c]] = True
        while True:
            cand = np.where(opened, -np.inf, score)
            best = cand.argmax(axis=1)
            live = np.flatnonzero(np.isfinite(cand[np.arange(q), best]))
            if not len(live):
                break
            opened[live, best[live]] = True
            nxt = links[held[live, best[live]]]
            new = (nxt >= 0) & ~seen[live[:, None], np.maximum(nxt, 0)]
            r, c = np.nonzero(new)
            seen[live[r], nxt[r, c]] = True
            s = np.full(nxt.shape, -np.inf)
            s[r, c] = np.einsum("nd,nd->n", queries[live[r]], vectors[nodes[nxt[r, c]]])
            all_s = np.hstack([score[live], s])
            all_n = np.hstack([held[live], np.where(new, nxt, -1)])
            all_o = np.hstack([opened[live], ~new])
            keep = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            score[live] = np.take_along_axis(all_s, keep, 1)
            held[live] = np.take_along_axis(all_n, keep, 1)
            opened[live] = np.take_along_axis(all_o, keep, 1) | ~np.isfinite(score[live])
        entry = np.where(held >= 0, nodes[np.maximum(held, 0)], -1)
    return entry


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` of vectors that take part: no null or non-finite component, not all zero."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def index(df: DataFrame, folder: str, p: HnswParams = HnswParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Write and return ``(shards, members)``.

    Equal vectors are one node, whose ``node`` is their smallest id; ``members(node, vec_id)`` has
    every row. Nodes are dealt to shards by a hash of the vector, as many shards as the number of
    nodes asks for, and each shard is built in one task from its bounded part: ``shards(shard, dim,
    nodes, vectors, layers, links)`` holds the graph as flat arrays.
    """
    rows = usable(df, id_col, vec_col)
    dim = F.size("v")
    nodes = saved(rows.groupBy("v").agg(F.min("vec_id").alias("node")), f"{folder}/nodes")
    members = rows.join(nodes, "v").select("node", "vec_id")
    n = nodes.count()
    shards = max(1, -(-n // p.shard_rows))
    dealt = nodes.withColumns({"key": F.xxhash64("v"), "dim": dim}).withColumn("shard", F.expr(f"pmod(key, {shards})"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        x = np.stack(pdf.v.to_numpy()).astype(np.float64)
        layers = build(x, pdf.key.to_numpy(), p)
        return pd.DataFrame(
            {
                "shard": pdf.shard.iloc[:1].to_numpy(),
                "dim": [x.shape[1]],
                "nodes": [pdf.node.to_numpy(np.int64).tobytes()],
                "vectors": [x.tobytes()],
                "layers": [[a.tobytes() for a, _ in layers]],
                "links": [[b.tobytes() for _, b in layers]],
            }
        )

    built = dealt.select("shard", "dim", "node", "key", "v").groupBy("shard", "dim").applyInPandas(
        one, "shard long, dim int, nodes binary, vectors binary, layers array<binary>, links array<binary>"
    )
    return saved(built, f"{folder}/shards"), members


def nearest(
    queries: DataFrame, shards: DataFrame, members: DataFrame, p: HnswParams = HnswParams(), id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows but itself, nearest first.

    A query is sent to every shard of its dimension and the shards' results are merged: inner
    products in double precision on the original vectors, ties to the smaller id. Queries are dealt
    to parts of about ``part_queries``; a task has one shard and one part, so a graph is moved and
    loaded once a part, and no task grows with the table. Copies of a vector can only be among the
    first in the order of their ids, so of each node k + 1 members are looked up; none is left out
    that could be in a result. Queries without a usable vector get no rows; with fewer than k
    candidates all are returned.
    """
    q = usable(queries, id_col, vec_col).withColumn("dim", F.size("v"))
    parts = max(1, -(-q.count() // p.part_queries))
    last = shards.agg(F.max("shard")).first()[0]
    part = F.expr(f"pmod(xxhash64(vec_id, v), {parts}L)")
    sent = q.select("dim", part.alias("part"), F.explode(F.expr(f"sequence(0L, {last or 0}L)")).alias("shard"), "vec_id", "v")
    served = shards.select("*", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))

    def run(key, asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(shard):
            return pd.DataFrame({"query_id": [], "node": [], "score": []})
        t = next(shard.itertuples(index=False))
        ids, x = np.frombuffer(t.nodes, np.int64), np.frombuffer(t.vectors, np.float64).reshape(-1, t.dim)
        layers = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32).reshape(len(a) // 4, -1)) for a, b in zip(t.layers, t.links)]
        out = []
        for lo in range(0, len(asked), p.queries):
            block = asked.iloc[lo : lo + p.queries]
            qid, qv = block.vec_id.to_numpy(np.int64), np.stack(block.v.to_numpy()).astype(np.float64)
            found = search(qv, x, layers, max(p.beam, p.k + 1))
            r, c = np.nonzero(found >= 0)
            near = found[r, c]
            got = pd.DataFrame({"query_id": qid[r], "place": r, "node": ids[near], "score": (qv[r] * x[near]).sum(axis=1)})
            got = got.sort_values(["place", "score", "node"], ascending=[True, False, True])
            # one more than k nodes a shard: the query's own node may be among them
            out.append(got.groupby("place", sort=False).head(p.k + 1)[["query_id", "node", "score"]])
        return pd.concat(out)

    key = ["shard", "dim", "part"]
    found = sent.groupBy(*key).cogroup(served.groupBy(*key)).applyInPandas(run, "query_id long, node long, score double")
    order = [F.desc("score"), F.col("node")]
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(f"r <= {p.k + 1}")
    few = members.withColumn("m", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(f"m <= {p.k + 1}")
    best = near.join(few, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(f"rank <= {p.k}").select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    shards, members = index(rows, shared_dir(spark))
    return nearest(rows.where("vec_id % 20 = 0"), shards, members)


QUERIES = {"op7_hnsw": query}
ORACLES: dict[str, str] = {}
