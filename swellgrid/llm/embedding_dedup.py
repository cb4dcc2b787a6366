"""Near-duplicate vectors: product quantisation behind an inverted file, exact cosine at the end.

Coarse cells are fitted on a bounded sample, one set for each dimension; every vector is
indexed.  A vector visits each cell that a neighbour at the threshold can fall into (``Cells``), by margins that follow how the
vectors of a cell spread and are widened until the links of the sample are seen.  Cells are dealt in blocks, so a large one is split among tasks.  In a block the
vectors form short inverted lists with residual codes of ``SUBSPACES`` subspaces; a visitor probes
lists by the same rule, reads its distances to their codes from look-up tables, and drops a pair only
if the triangle inequality with the stored quantisation error rules it out.  The rest are compared by
cosine in double precision.  Lists hold about ``LIST_VECTORS`` however many vectors there are; cells are as many as the sample
can tell apart, so beyond some ten million vectors they grow, and with them the work of a vector.  A task emits counts and a spanning forest of its links,
never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

THRESHOLD = 0.9
#: Most vectors that the cells are fitted on, and vectors of the sample per cell at least.
SAMPLE_VECTORS = 20_000
SAMPLE_PER_CELL = 8
#: Vectors of a cell and of a list that are aimed at.
CELL_VECTORS, LIST_VECTORS = 4096, 32
SUBSPACES, CODES = 8, 256
PROBE_SIGMA = 3.0
#: Vectors of the sample whose links are looked for to check the margins, and the share of them that has to be seen.
SAMPLE_QUERIES, SAMPLE_RECALL = 1024, 0.995
#: Base vectors and queries of a block.
BLOCK, QUERY_BLOCK = 4096, 16_384
_QUERIES_AT_ONCE, PAIRS_AT_ONCE = 1024, 1 << 20


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 2048] @ centres.T - half, axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.empty(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds if k > 1 else 1):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=x[:, i], minlength=len(centres)) for i in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Cells:
    """Centres of Voronoi cells and which of them a vector visits.

    A vector visits a cell if its distance to the plane that parts the cell from its own is within the margin: what a
    neighbour's displacement reaches along the line of both centres.  That is its length times ``PROBE_SIGMA`` deviations of the own
    cell's vectors along the line, as a share of their spread: about 1 / sqrt(dimensions) where they spread evenly and
    up to 1, when the margin is the exact bound, where they lie along few directions.  Without vectors an even spread is assumed.
    """

    def __init__(self, centres: np.ndarray, threshold: float, x: np.ndarray | None = None):
        self.centres, self.dim = centres, centres.shape[1]
        self.reach = np.sqrt(max(0.0, 2 - 2 * threshold))
        self.square = (centres**2).sum(1)
        gaps = np.sqrt(np.maximum(self.square[:, None] + self.square - 2 * centres @ centres.T, 0)) + 1e-12
        share = np.full(gaps.shape, 1 / self.dim) if x is None else self._spread(x, gaps)
        self.widest = 2 * self.reach * gaps
        self.margin = (self.widest * np.minimum(1, PROBE_SIGMA * np.sqrt(share))).astype(np.float32)

    def _spread(self, x: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Share of the variance of each cell's vectors that lies along the line to each other centre; of few vectors an upper bound."""
        home = self.home(x)
        out = np.ones(gaps.shape)
        for cell in np.unique(home):
            rest = x[home == cell] - self.centres[cell]
            total = (rest**2).sum()
            if total > 0:
                along = rest @ ((self.centres - self.centres[cell]) / gaps[cell][:, None]).T
                out[cell] = (along**2).sum(0) / total * (1 + 2 / np.sqrt(len(rest)))
        return np.maximum(out, 1 / self.dim)

    def home(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def probes(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which cells each vector visits: its own and those whose plane is near."""
        d = self.square - 2 * x @ self.centres.T
        own = np.arange(len(x))
        near = (d - d[own, home][:, None]) <= self.margin[home]
        near[own, home] = True
        return near

    def widened(self, x: np.ndarray, threshold: float) -> Cells:
        """Margins wide enough that of the links among the sampled vectors ``x`` at least ``SAMPLE_RECALL`` visit each other's cell."""
        home, queries = self.home(x), x[:SAMPLE_QUERIES]
        pairs = [np.nonzero(queries[i : i + 256] @ x.T >= threshold) for i in range(0, len(queries), 256)]
        q, other = np.concatenate([p[0] + 256 * k for k, p in enumerate(pairs)]), np.concatenate([p[1] for p in pairs])
        q, other = q[q != other], other[q != other]
        while len(q) and (self.margin < self.widest).any():
            seen = np.concatenate([self.probes(queries[i : i + 256], home[i : min(i + 256, len(queries))]) for i in range(0, len(queries), 256)])
            if seen[q, home[other]].mean() >= SAMPLE_RECALL:
                break
            self.margin = np.minimum(self.margin * 1.3, self.widest).astype(np.float32)
        return self


class Lists:
    """Inverted lists over the vectors of a block, with residual codes and look-up tables."""

    def __init__(self, base: np.ndarray, threshold: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.cells = Cells(_kmeans(base, max(1, len(base) // LIST_VECTORS), rng, rounds=3), threshold, base)
        self.home = self.cells.home(base)
        self.width = -(-base.shape[1] // SUBSPACES)
        rest = self.padded(base - self.cells.centres[self.home])
        self.codebooks = [_kmeans(rest[:, m], CODES, rng, rounds=3) for m in range(SUBSPACES)]
        self.codes = np.stack([_nearest(rest[:, m], self.codebooks[m]) for m in range(SUBSPACES)], axis=1)
        near = np.stack([self.codebooks[m][self.codes[:, m]] for m in range(SUBSPACES)], axis=1)
        errors = np.sqrt(((rest - near) ** 2).sum((1, 2)))
        centres = self.padded(self.cells.centres)[self.home]
        # |q - b'|^2 = |q|^2 + |b'|^2 - 2 q.b'; a pair may be near if that is at most (reach + error)^2.
        self.least = (((centres + near) ** 2).sum((1, 2)) + 1 - (self.cells.reach + errors + 1e-3) ** 2) / 2
        order = np.argsort(self.home, kind="stable")
        bounds = np.searchsorted(self.home[order], np.arange(len(self.cells.centres) + 1))
        self.members = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), SUBSPACES * self.width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), SUBSPACES, self.width)

    def candidates(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, members of a list and a table of both: the pairs that asymmetric distances can't rule out."""
        parts = self.padded(queries)
        tables = [(parts[:, m] @ self.codebooks[m].T).astype(np.float32) for m in range(SUBSPACES)]
        to_centre = queries @ self.cells.centres.T
        visits = self.cells.probes(queries, self.cells.home(queries))
        for place, members in enumerate(self.members):
            visitors = np.flatnonzero(visits[:, place])
            if not len(members):
                continue
            step = max(1, PAIRS_AT_ONCE // len(members))
            for own in (visitors[i : i + step] for i in range(0, len(visitors), step)):
                dot = np.repeat(to_centre[own, place][:, None], len(members), axis=1)
                for m, table in enumerate(tables):
                    dot += table[own][:, self.codes[members, m]]
                yield own, members, dot >= self.least[members]


def near_pairs(qx: np.ndarray, bx: np.ndarray, own: np.ndarray, members: np.ndarray, may: np.ndarray, threshold: float) -> np.ndarray:
    """The table of candidates with only those left whose cosine is at least ``threshold``."""
    if may.sum() * 4 > may.size:
        return may & (qx[own] @ bx[members].T >= threshold)
    i, j = np.nonzero(may)
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        may[a, b] = np.einsum("ij,ij->i", qx[own[a]], bx[members[b]]) >= threshold
    return may


def star_edges(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components of a table of links as (row, row it hangs on) and (column, row it hangs on)."""
    none = near.shape[0]
    rows = np.where(near.any(1), np.arange(none), none)
    while True:
        columns = np.where(near, rows[:, None], none).min(0)
        new = np.minimum(rows, np.where(near, columns[None, :], none).min(1))
        if (new == rows).all():
            i, j = np.flatnonzero(rows < none), np.flatnonzero(columns < none)
            return i, rows[i], j, columns[j]
        rows = new


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packer(kind: str):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, n, v array) -> (rep, n, v binary)."""
        for b in batches:
            v = [np.asarray(x, kind).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.binary())], names=["rep", "n", "v"])

    return packed


def fit_cells(sample: list[bytes], total: dict[int, int], kind: str, threshold: float, seed: int = 3) -> dict[int, Cells]:
    """Cells by number of bytes of a vector; vectors of a size that the sample lacks share one cell."""
    out = {}
    for size, n in total.items():
        own = [v for v in sample if len(v) == size]
        if own:
            cells = max(1, min(-(-n // CELL_VECTORS), len(own) // SAMPLE_PER_CELL))
            x = _unit(own, kind)
            out[size] = Cells(_kmeans(x, cells, np.random.default_rng(seed)), threshold, x).widened(x, threshold)
    return out


def _dealer(index, kind: str):
    """(rep, n, v) -> a base row for its cell and a query row for each cell that it visits, of those not above its own.

    A pair of two cells is so looked for from one side, where it counts for both ends.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.array([len(v) for v in whole.column(2).to_pylist()])
            for size in np.unique(sizes):
                alike = whole.take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, alike.num_rows, 1024):
                    b = alike.slice(at, 1024)
                    cells = index.value.get(int(size))
                    if cells is None:
                        row, home = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
                        place = home
                    else:
                        x = _unit(b.column(2).to_pylist(), kind)
                        home = cells.home(x)
                        row, place = np.nonzero(cells.probes(x, home) & (np.arange(len(cells.centres)) <= home[:, None]))
                    rows = np.concatenate([np.arange(b.num_rows), row])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), size), pa.int32()),
                            pa.array(np.concatenate([home, place]), pa.int32()),
                            pa.array(np.arange(len(rows)) >= b.num_rows),
                            pa.array(home[rows], pa.int32()),
                            *(b.column(c).take(pa.array(rows)) for c in range(3)),
                        ],
                        names=["size", "place", "query", "home", "rep", "n", "v"],
                    )

    return deal


def _matcher(kind: str, threshold: float):
    """One block of one cell -> (rep, root, links): weighted link counts and a spanning forest.

    A pair of two cells comes up in the lower one only, and one of the same cell counts when the smaller of its numbers asks, for
    both of its ends.  So either end has a link or neither.  Pairs are counted and joined list by list; none is kept.
    """

    def match(table: pa.Table) -> pa.Table:
        is_query = table["query"].to_numpy()
        q, b = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("rep", "root", "links")})
        if not len(q) or not len(b):
            return empty
        qx, bx = _unit(q["v"].to_pylist(), kind), _unit(b["v"].to_pylist(), kind)
        q_rep, b_rep, q_n, b_n = (t[c].to_numpy() for c in ("rep", "n") for t in (q, b))
        place, homes = table["place"][0].as_py(), q["home"].to_numpy()
        q_links, b_links = np.zeros(len(qx), np.int64), np.zeros(len(bx), np.int64)
        lists, edges = Lists(bx, threshold), []
        for at in range(0, len(qx), _QUERIES_AT_ONCE):
            for own, members, may in lists.candidates(qx[at : at + _QUERIES_AT_ONCE]):
                own = own + at
                mine = (homes[own] > place)[:, None] | (q_rep[own][:, None] < b_rep[members])
                near = near_pairs(qx, bx, own, members, may & mine, threshold)
                if near.any():
                    q_links[own] += near @ b_n[members]
                    b_links[members] += q_n[own] @ near
                    i, i_on, j, j_on = star_edges(near)
                    edges += [(own[i], own[i_on]), (members[j] + len(qx), own[j_on])]
        if not edges:
            return empty
        u, v = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
        rep = np.concatenate([q_rep, b_rep])
        root = rep.copy()
        while True:
            before = root.copy()
            np.minimum.at(root, v, root[u])
            np.minimum.at(root, u, root[v])
            if (root == before).all():
                break
        linked = np.unique(np.concatenate([u, v]))
        return pa.table({"rep": rep[linked], "root": root[linked], "links": np.concatenate([q_links, b_links])[linked]})

    return match


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_links, component_id, kept.

    ``n_links`` counts the other rows linked directly, at a cosine of ``threshold`` or more;
    ``component_id`` is the smallest id reachable by links, and ``kept`` whether it is the
    row's own.  Only vectors of one dimension are compared with each other.  Vectors that are null,
    empty or zero, or hold null or non-finite components link with nothing.  Rows that repeat an id
    count as vectors of their own; a null id counts as the largest.  An empty table gives no rows.
    """
    spark = df.sparkSession
    kind = "<f4" if "array<float>" in df.select(vec_col).schema[0].dataType.simpleString() else "<f8"
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    keys = {f"k{i}": F.when(F.col("fine"), F.xxhash64(F.lit(i), "v")) for i in (1, 2)}
    # The rows are written once, and so are their numbers.
    rows = materialize(rows.select("row", "id", "fine", *[c.alias(k) for k, c in keys.items()], F.when(F.col("fine"), F.col("v")).alias("v")), "vectors")
    # Equal vectors are one class with a weight; they all link with each other.
    classes = rows.where("fine").groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count("*").alias("n"), F.min("id").alias("low"), F.first("v").alias("v"))
    classes = materialize(classes, "vector-classes")
    width = np.dtype(kind).itemsize
    total = {r["d"] * width: r["c"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).collect()}
    packed = classes.select("rep", "n", "v").mapInArrow(_packer(kind), "rep long, n long, v binary")
    sample = [bytes(r["v"]) for r in packed.orderBy(F.xxhash64("v"), "rep").limit(SAMPLE_VECTORS).select("v").collect()]
    index = spark.sparkContext.broadcast(fit_cells(sample, total, kind, threshold))
    dealt = packed.mapInArrow(_dealer(index, kind), "size int, place int, query boolean, home int, rep long, n long, v binary")
    blocks = [F.ceil(F.greatest(c, F.lit(1)) / n).cast("int").alias(name) for name, c, n in (("bb", "nb", BLOCK), ("qb", "nq", QUERY_BLOCK))]
    dealt = materialize(dealt, "dealt")
    counts = materialize(dealt.groupBy("size", "place").agg(F.sum((~F.col("query")).cast("long")).alias("nb"), F.sum(F.col("query").cast("long")).alias("nq")).select("size", "place", *blocks), "cells")
    dealt = dealt.join(F.broadcast(counts), ["size", "place"])  # a row for each cell: SAMPLE_VECTORS / SAMPLE_PER_CELL, and one for each size
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("qb")).otherwise(F.col("bb"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("bb")).otherwise(F.col("qb")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.withColumn("b", F.when(F.col("query"), F.col("other")).otherwise(F.col("own"))).withColumn("q", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")))
    dealt = dealt.select("size", "place", "b", "q", "query", "home", "rep", "n", "v")
    found = materialize(dealt.groupBy("size", "place", "b", "q").applyInArrow(_matcher(kind, threshold), "rep long, root long, links long"), "vector-links")
    index.destroy()
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("k1", "k2", "rep", "n", "low").join(links, "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "rep")), "known")
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(materialize(lowest, "lowest"), "component").select("k1", "k2", F.col("n").alias("same"), F.coalesce("links", F.lit(0)).alias("links"), "component_id")
    out = rows.where("fine").select("id", "k1", "k2").join(materialize(known, "known"), ["k1", "k2"])
    out = out.select("id", (F.col("same") - 1 + F.col("links")).cast("bigint").alias("n_links"), "component_id")
    out = out.unionByName(rows.where("NOT fine").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))
