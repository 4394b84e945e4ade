"""Embedding near-duplicates by an inverted multi-index.

Vectors of each length have an index of their own, as no cosine joins two lengths; lengths of at most RESIDENTS vectors
have one cell. Each half of the unit vectors has a codebook (k-means on a bounded sample); the product of the two is a
grid of cells, and every vector lives in the cell of its nearest pair of centroids. As a query, a vector visits cells
in multi-sequence order (by the sum of its halves' distances) until the number of cells that the target recall needs:
that number is measured before the visits are made, on the links of at most CALIBRATE queries with all vectors, and on
copies of these queries moved to just the threshold, as far as a link can be: so there is evidence even where no query
has a link. The number goes as far as the whole grid, where every pair meets; below LEAST_RECALL the run fails, and the
least recall of all lengths is a column of the result. Every pair met is verified by cosine in double precision, after
each vector is scaled by its largest component, so that norms neither overflow nor underflow.

The grid grows with the number of vectors, so that cells keep about CELL vectors. Residents and visitors of a cell
meet in blocks, so a cell may hold any share of all vectors; a block sends on link counts and spanning links, never
all its pairs. Equal vectors are one node. Vectors travel in their own precision. Only codebooks and calibration
queries, both bounded, are broadcast.

Cases: vectors that are null, zero, empty, or hold null or non-finite components link with nothing. Repeated rows and
ids are separate vectors. A null id is the least of none: a component of null ids alone has a null component_id, and
its rows are kept. A pair at exactly the threshold is linked. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from factloom.llm.chosenpath import runs_of, spanning
from factloom.llm.common import cut, pick
from factloom.operators.graph import connected_components

THRESHOLD = 0.95
TARGET_RECALL, LEAST_RECALL = 0.995, 0.9
SAMPLE = 8192
CALIBRATE = 256
CELL = 10
MAX_CENTROIDS = 1024
MIN_VISITS = 8
RESIDENTS, VISITORS = 1024, 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        near = distances(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1))


class MultiIndex:
    """Two codebooks and the traversal of their grid."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return distances(x[:, :half], self.first), distances(x[:, half:], self.second)

    def home(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.argmin(axis=1) * len(self.second) + d2.argmin(axis=1)

    def visit(self, d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
        """The first cells of the multi-sequence order. The r-th cell joins the i-th and j-th nearest centroids with
        i j <= r, so only such pairs of ranks are merged."""
        o1, o2 = (np.argsort(d, axis=1, kind="stable")[:, :cells] for d in (d1, d2))
        i, j = np.nonzero(np.outer(np.arange(1, o1.shape[1] + 1), np.arange(1, o2.shape[1] + 1)) <= cells)
        step = max(1, (1 << 23) // len(i))
        if len(d1) > step:
            return np.concatenate([self.visit(d1[k : k + step], d2[k : k + step], cells) for k in range(0, len(d1), step)])
        sums = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        best = np.argsort(sums, axis=1, kind="stable")[:, :cells]
        return np.take_along_axis(o1, i[best], 1) * len(self.second) + np.take_along_axis(o2, j[best], 1)

    def rank(self, d1: np.ndarray, d2: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells come before a cell in each row's order."""
        own = np.take_along_axis(d1, cell[:, None] // len(self.second), 1) + np.take_along_axis(d2, cell[:, None] % len(self.second), 1)
        out = np.zeros(len(cell), np.int64)
        s2 = np.sort(d2, axis=1)
        for r in range(len(cell)):
            out[r] = np.searchsorted(s2[r], own[r] - d1[r] - 1e-12).sum()
        return out


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, vec_id and hash key of every row, the key null where the vector is not valid; node, size, copies, key
    and vector of distinct valid vectors)."""
    element = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind = "float" if isinstance(element, FloatType) else "double"
    raw = pick(vectors, vec_id=id_col, v=vector_col).withColumn("row_id", F.monotonically_increasing_id())
    v = F.transform("v", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # no negative zeros
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = raw.select("row_id", "vec_id", F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    key = [F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(k))).alias(f"k{k}") for k in (1, 2)]
    rows = cut(rows.select("*", *key))
    nodes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("k1").alias("k1"), F.first("k2").alias("k2"))
    return rows.drop("v"), cut(nodes.withColumn("size", F.size("v")))


def fit(nodes: DataFrame, n: int) -> MultiIndex:
    """Codebooks on the SAMPLE vectors, of n of one length, with the smallest hashes."""
    sample = [r["v"] for r in nodes.orderBy(F.xxhash64("v"), "node").limit(SAMPLE).select("v").collect()]
    x = unit(np.array(sample, np.float64))
    k = int(min(MAX_CENTROIDS, max(1, round((n / CELL) ** 0.5)), len(x)))
    half = max(1, x.shape[1] // 2)
    return MultiIndex(k_means(x[:, :half], k, 1), k_means(x[:, half:], k, 2) if x.shape[1] > half else np.zeros((1, 0)))


def moved(x: np.ndarray, threshold: float) -> np.ndarray:
    """Unit vectors at just the threshold's cosine from the rows of x, in random directions."""
    side = np.random.default_rng(5).normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((side * side).sum(axis=1, keepdims=True))
    side = np.divide(side, length, out=np.zeros_like(side), where=length > 1e-9)  # one dimension has no side
    return unit(threshold * x + max(0.0, 1 - threshold * threshold) ** 0.5 * side)


def visit_bounds(grid: int) -> np.ndarray:
    """Numbers of cells to choose from, each at most a tenth or one more than the one before, up to the whole grid."""
    out = [min(MIN_VISITS, grid)]
    while out[-1] < grid:
        out.append(min(grid, max(out[-1] + 1, out[-1] * 11 // 10)))
    return np.array(out)


def calibrate(nodes: DataFrame, shared, threshold: float) -> tuple[int, float]:
    """(cells to visit, measured recall): the mean over queries of the share of links met, where it is lower of true
    links with all vectors and of links with moved copies."""
    queries = nodes.orderBy(F.xxhash64("v", F.lit(1)), "node").limit(CALIBRATE).select("node", "v").collect()
    index = shared.value
    q = unit(np.array([r["v"] for r in queries], np.float64))
    q_id = np.array([r["node"] for r in queries])
    d1, d2 = index.halves(q)
    home = index.home(d1, d2)
    bounds = visit_bounds(len(index.first) * len(index.second))
    column = lambda met: np.searchsorted(bounds, met + 1)  # the first bound that meets the rank

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        table = np.zeros((len(q), len(bounds)), np.int64)
        for batch in batches:
            x = unit(np.stack(batch["v"].to_list()))
            a, b = np.nonzero(q @ x.T >= threshold)
            other = batch["node"].to_numpy()[b] != q_id[a]
            a, b = a[other], b[other]
            for at in range(0, len(a), 4096):
                i, j = a[at : at + 4096], b[at : at + 4096]
                e1, e2 = index.halves(x[j])
                met = np.minimum(index.rank(d1[i], d2[i], index.home(e1, e2)), index.rank(e1, e2, home[i]))
                np.add.at(table, (i, column(met)), 1)
        i, j = np.nonzero(table)
        yield pd.DataFrame({"q": i, "rank": j, "n": table[i, j]})

    counts = nodes.select("node", "v").mapInPandas(run, "q long, rank long, n long").groupBy("q", "rank").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((len(q), len(bounds)))
    for r in counts:
        table[r["q"], r["rank"]] = r["n"]
    near = moved(q, threshold)
    e1, e2 = index.halves(near)
    met = np.minimum(index.rank(d1, d2, index.home(e1, e2)), index.rank(e1, e2, home))
    copies = np.zeros_like(table)
    np.add.at(copies, (np.arange(len(q)), column(met)), 1)
    tables = [t[t.sum(axis=1) > 0] for t in (table, copies)]
    recall = np.min([(np.cumsum(t, axis=1) / t.sum(axis=1, keepdims=True)).mean(axis=0) for t in tables if len(t)], axis=0)
    k = min(int(np.searchsorted(recall, TARGET_RECALL)), len(bounds) - 1)
    return int(bounds[k]), float(recall[k])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (as measured, the same in each row) of every row."""
    rows, nodes = valid(vectors, id_col, vector_col)
    counts = {r["size"]: r["count"] for r in nodes.groupBy("size").count().collect()}  # a row for each length
    large = sorted(size for size, n in counts.items() if n > RESIDENTS)
    kind = np.float32 if dict(nodes.dtypes)["v"] == "array<float>" else np.float64
    schema = "size int, node long, copies long, home long, visits array<long>, x binary"
    sc, recall, places = vectors.sparkSession.sparkContext, 1.0, []
    for size in large:
        some = nodes.where(F.col("size") == size)
        shared = sc.broadcast(fit(some, counts[size]))
        cells, measured = calibrate(some, shared, threshold)
        if measured < LEAST_RECALL:
            raise RuntimeError(f"measured recall {measured:.4f} at {cells} cells is below {LEAST_RECALL}")
        recall = min(recall, measured)

        def place(batches: Iterator[pd.DataFrame], shared=shared, cells=cells) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    some = batch[at : at + 1024]
                    raw = np.stack(some["v"].to_list()).astype(kind)
                    d1, d2 = index.halves(unit(raw))
                    visits = index.visit(d1, d2, cells).astype(np.int64)
                    yield pd.DataFrame({"size": some["size"], "node": some["node"], "copies": some["copies"], "home": index.home(d1, d2), "visits": list(visits), "x": [r.tobytes() for r in raw]})

        places.append(some.mapInPandas(place, schema))

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"size": batch["size"], "node": batch["node"], "copies": batch["copies"], "home": 0, "visits": [[0]] * len(batch), "x": [np.asarray(v, kind).tobytes() for v in batch["v"]]})

    places.append(nodes.where(~F.col("size").isin(large) if large else F.lit(True)).mapInPandas(alone, schema))
    placed = cut(reduce(DataFrame.unionByName, places))
    residents = placed.groupBy("size", F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / RESIDENTS).cast("int").alias("r_parts"))
    visiting = placed.select("size", F.explode("visits").alias("cell")).groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("v_parts"))
    seat = ["size", "cell"]
    parts = cut(residents.join(visiting, seat))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    live = placed.withColumnRenamed("home", "cell").join(parts, seat).withColumn("r", part("r_parts")).withColumn("w", every("v_parts")).withColumn("home", F.col("cell"))
    guests = placed.withColumn("cell", F.explode("visits")).join(parts, seat).withColumn("w", part("v_parts")).withColumn("r", every("r_parts"))
    block = F.xxhash64("size", "cell", "r", "w").alias("block")
    none = F.array().cast("array<long>")
    meet = live.select(block, F.lit(0).alias("role"), "node", "copies", "home", "visits", "x").unionByName(guests.select(block, F.lit(1).alias("role"), "node", "copies", "home", none.alias("visits"), "x"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in runs_of(batches, "block"):
            out_a, out_b, out_n = [], [], []
            for _, rows in some.groupby("block", sort=False):
                role = rows["role"].to_numpy()
                here, there = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
                if not len(here) or not len(there):
                    continue
                x = unit(np.frombuffer(b"".join(rows["x"]), kind).reshape(len(rows), -1))
                node, copies, home = (rows[c].to_numpy() for c in ("node", "copies", "home"))
                i, j = np.nonzero(x[there] @ x[here].T >= threshold)
                i, j = there[i], here[j]
                other = node[i] != node[j]
                i, j = i[other], j[other]
                # A pair that meets both ways counts where the lesser id visits.
                visits = np.stack(rows["visits"].iloc[here].to_list())
                seat = np.zeros(len(rows), np.int64)
                seat[here] = np.arange(len(here))
                back = np.zeros(len(i), bool)
                step = max(1, (1 << 23) // visits.shape[1])
                for at in range(0, len(i), step):
                    back[at : at + step] = (visits[seat[j[at : at + step]]] == home[i[at : at + step], None]).any(axis=1)
                once = ~back | (node[i] < node[j])
                i, j = i[once], j[once]
                ids, where = np.unique(node, return_inverse=True)
                n = np.bincount(where[i], copies[j], len(ids)) + np.bincount(where[j], copies[i], len(ids))
                label = spanning(len(ids), where[i], where[j])
                got = np.flatnonzero(n)
                out_a.append(ids[got])
                out_b.append(ids[label[got]])
                out_n.append(n[got].astype(np.int64))
            empty = np.empty(0, np.int64)
            yield pd.DataFrame({"a": np.concatenate([empty, *out_a]), "b": np.concatenate([empty, *out_b]), "n": np.concatenate([empty, *out_n])})

    found = cut(meet.repartition("block").sortWithinPartitions("block").mapInPandas(compare, "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    joined = connected_components(found)
    known = nodes.drop("v").join(links, "node", "left").join(joined, "node", "left")
    known = known.select("k1", "k2", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = rows.join(known, ["k1", "k2"], "left").withColumn("component", F.coalesce("component", -1 - F.col("row_id")))
    full = cut(full.select("vec_id", "component", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    heads = full.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return full.join(heads, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall"))
