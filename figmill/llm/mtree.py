"""Exact top-k inner products by best-first search of an M-tree.

With one more component, sqrt(most - norm), all vectors lie on one sphere and a query's
nearest ones have its highest inner products. The tree has a root page of routing
vectors, nodes of at most NODE_ROWS rows below each, and leaf pages. Every entry keeps
its distance to its parent, every page its covering radius: by the triangle inequality
both rule out pages and entries before a distance is computed. A query searches its
home node first; the bound that this gives decides which other nodes it visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.llm.common import first_by_hash, saved

#: Entries of the root page (chosen from ROOT_SAMPLE rows, first by a hash of their id), rows of a node and a leaf, queries of a block.
ROOT_ROWS, ROOT_SAMPLE, NODE_ROWS, LEAF_ROWS, QUERY_ROWS = 128, 4096, 4096, 128, 4096
#: Bounds are looser by this share of the sphere's radius, far more than distances lose by rounding; scores are whole numbers.
_SLACK = 1e-6
#: Vectors of this squared length or more could have scores that no long holds.
_LONGEST = 9.2e18


def _unpack(blobs, dims: int) -> np.ndarray:
    """Rows of numbers of at most ``dims`` components; shorter ones end in zeros."""
    out = np.zeros((len(blobs), dims))
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, dtype=np.int64)
        out[i, : len(x)] = x
    return out


class _Sphere:
    """Distances on the sphere of squared radius ``most``."""

    def __init__(self, most: float):
        self.most = float(most)
        self.slack = _SLACK * (1 + float(np.sqrt(self.most)))
        self.exact = self.most < 2**52  # doubles hold all sums

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of data vectors."""
        return np.sqrt(np.maximum(2 * self.most - 2 * (a @ b.T + np.outer(self.lift(a), self.lift(b))), 0))

    def asked(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Distances of queries (whose further component is 0) to data vectors."""
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.most - 2 * (q @ x.T), 0))

    def scores(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return x @ q if self.exact else x.astype(np.int64) @ q.astype(np.int64)

    def reach(self, norm: float, score: float) -> float:
        return float(np.sqrt(max(norm + self.most - 2 * score, 0)))


def _roots(sample: np.ndarray, sphere: _Sphere, count: int) -> np.ndarray:
    """Routing vectors: farthest-first over the sample."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = sphere.between(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, sphere.between(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def build_pages(ids: np.ndarray, x: np.ndarray, root: np.ndarray, sphere: _Sphere) -> list[tuple]:
    """Leaf pages of one node: (router, covering radius, router's distance to the root entry, entry ids, vectors, entry distances)."""
    rng = np.random.default_rng(len(ids))
    routers = x[np.sort(rng.choice(len(x), max(1, -(-2 * len(x) // LEAF_ROWS)), replace=False))]
    gaps = sphere.between(x, routers)
    own, pages = gaps.argmin(axis=1), []
    for r in range(len(routers)):
        rows = np.flatnonzero(own == r)
        rows = rows[np.argsort(gaps[rows, r], kind="stable")]
        for i in range(0, len(rows), LEAF_ROWS):  # a crowded router has several pages, by distance
            part = rows[i : i + LEAF_ROWS]
            pages.append((routers[r], float(gaps[part, r].max()), float(sphere.between(routers[r : r + 1], root[None, :])[0, 0]), ids[part], x[part], gaps[part, r]))
    return pages


def search(pages: list[tuple], q: np.ndarray, query_id: int, k: int, bound: float, to_root: float, sphere: _Sphere) -> list[tuple[float, int]]:
    """The query's ``k`` best (score, id) in the pages that may reach ``bound``, best page first."""
    norm, best = float(q @ q), []
    routers, radii, parents = pages[0]
    near = np.flatnonzero(np.abs(to_root - parents) - radii <= bound + sphere.slack)  # no distance is computed for the others
    if not len(near):
        return best
    gaps = sphere.asked(q[None, :], routers[near])[0]
    lower = np.maximum(gaps - radii[near], 0)
    for at in np.argsort(lower, kind="stable"):
        if lower[at] > bound + sphere.slack:
            break
        ids, x, own = pages[1][near[at]]
        rows = np.flatnonzero((np.abs(gaps[at] - own) <= bound + sphere.slack) & (ids != query_id))
        if not len(rows):
            continue
        scores = sphere.scores(x[rows], q)
        if len(best) == k:
            rows, scores = rows[scores >= best[-1][0]], scores[scores >= best[-1][0]]
        best = sorted([*best, *zip(scores.tolist(), ids[rows].tolist(), strict=True)], key=lambda s: (-s[0], s[1]))[:k]
        if len(best) == k:
            bound = min(bound, sphere.reach(norm, best[-1][0]))
    return best


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Each query's ``k`` highest inner products in ``vectors(vec_id, embedding)``: query_id, rank, vec_id, score.

    Components become floor(256 * x). Queries are rows whose vec_id is divisible by
    ``every``; all rows with another vec_id are candidates; ties go to the smaller
    vec_id. Rows with a null id, a null vector or a null or non-finite component take
    no part; shorter vectors end in zeros; a repeated query id is asked once, repeated
    candidates each count; other columns are ignored. Components are whole numbers of 64
    bits; a vector of squared length 9.2e18 or more, whose scores a long could not hold, takes
    no part either.
    """
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [np.floor(256 * np.array(v, dtype=np.float64)) for v in b["embedding"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [np.where(np.abs(r) < 2.0**62, r, 0).astype(np.int64).tobytes() for r in rows], "norm": [float((r * r).sum()) for r in rows], "dims": [len(r) for r in rows]})

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    points = saved(clean.mapInPandas(whole, "vec_id long, v binary, norm double, dims int").filter(F.col("norm") < _LONGEST), "vectors")
    most, dims = points.agg(F.coalesce(F.max("norm"), F.lit(0.0)), F.coalesce(F.max("dims"), F.lit(0))).first()
    sphere = _Sphere(most)
    sample = first_by_hash(points, ["vec_id", "v"], ROOT_SAMPLE, points.count()).toPandas()
    roots = _roots(_unpack(sample["v"], dims), sphere, ROOT_ROWS)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gaps = sphere.between(_unpack(b["v"], dims), roots)
            own = gaps.argmin(axis=1)
            yield pd.DataFrame({"entry": own, "gap": gaps[np.arange(len(b)), own], "vec_id": b["vec_id"], "v": b["v"]})

    placed = saved(points.mapInPandas(routed, "entry int, gap double, vec_id long, v binary"), "vectors-routed")
    radius, nodes = np.zeros(len(roots)), np.zeros(len(roots), dtype=np.int64)
    for r in placed.groupBy("entry").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():  # at most ROOT_ROWS rows
        radius[r["entry"]], nodes[r["entry"]] = r["radius"], -(-r["n"] // NODE_ROWS)
    # an entry with very many rows, alike or not, is dealt to several nodes
    counts = F.element_at(F.array(*[F.lit(int(max(1, n))) for n in nodes]), F.col("entry") + 1) if len(roots) else F.lit(1)
    node = F.pmod(F.xxhash64("vec_id"), counts).cast("int")
    placed = placed.withColumn("node", node)

    def paged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        entry, at = int(key[0]), int(key[1])
        pages = build_pages(rows["vec_id"].to_numpy(), _unpack(rows["v"], dims), roots[entry], sphere)
        blob = lambda a, t: np.ascontiguousarray(a, dtype=t).tobytes()
        return pd.DataFrame([(entry, at, blob(r, "i8"), rad, par, blob(i, "i8"), blob(x, "i8"), blob(g, "f8")) for r, rad, par, i, x, g in pages], columns=["entry", "node", "router", "radius", "parent", "ids", "vectors", "gaps"])

    tree = saved(placed.groupBy("entry", "node").applyInPandas(paged, "entry int, node int, router binary, radius double, parent double, ids binary, vectors binary, gaps binary"), "mtree")
    asked = placed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "entry", "node")).alias("x")).select(F.col("vec_id").alias("query_id"), "x.*")
    asked = saved(asked, "queries")

    def looked(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            q = _unpack(queries["v"], dims)
            pages = (
                (_unpack(rows["router"], dims), rows["radius"].to_numpy(), rows["parent"].to_numpy()),
                [(np.frombuffer(i, "i8"), np.frombuffer(x, "i8").reshape(-1, dims).astype(float), np.frombuffer(g, "f8")) for i, x, g in zip(rows["ids"], rows["vectors"], rows["gaps"], strict=True)],
            )
            to_root = sphere.asked(q, roots[int(rows["entry"].iloc[0])][None, :])[:, 0]
            for i, (query_id, bound) in enumerate(zip(queries["query_id"], queries["bound"], strict=True)):
                out += [(query_id, v, s) for s, v in search(pages, q[i], query_id, k, bound, to_root[i], sphere)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    def visits(queries: DataFrame) -> DataFrame:
        # a node is read once for every QUERY_ROWS queries that visit it, and not at all without one
        keys = ["entry", "node", "block"]
        asked_of = queries.groupBy("entry", "node").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        wide = tree.join(asked_of, ["entry", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        dealt = queries.join(asked_of, ["entry", "node"]).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.col("blocks")).cast("int")).drop("blocks")
        return wide.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(looked, "query_id long, vec_id long, score long")

    home = saved(visits(asked.withColumn("bound", F.lit(float("inf")))), "home-hits")
    bounds = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = _unpack(b["v"], dims)
            gaps = sphere.asked(q, roots)
            reach = np.array([sphere.reach(float(x @ x), w) if n >= k else np.inf for x, n, w in zip(q, b["n"], b["worst"], strict=True)])
            rows = []
            for i in range(len(b)):
                for e in np.flatnonzero((gaps[i] - radius <= reach[i] + sphere.slack) & (nodes > 0)):
                    rows += [(b["query_id"].iloc[i], b["v"].iloc[i], int(e), n, reach[i]) for n in range(nodes[e]) if (e, n) != (b["entry"].iloc[i], b["node"].iloc[i])]
            yield pd.DataFrame(rows, columns=["query_id", "v", "entry", "node", "bound"])

    others = asked.join(bounds, "query_id", "left").fillna(0, ["n", "worst"]).mapInPandas(further, "query_id long, v binary, entry int, node int, bound double")
    found = home.unionAll(visits(saved(others, "visits")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
