"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Distinct vectors of each group (label and dimension) are dealt to blocks, and pairs of blocks are compared as tiles.
Vectors are scaled to length one and rotated so that leading coordinates carry most; a tile first multiplies those, adds
the product of what is left of both lengths (the suffix norms), and gives up all pairs whose bound stays below the
threshold; the rest go on through further coordinates, and those that remain are verified by the cosine of the vectors
as given, in double precision. A tile returns numbers of links and a forest of them, never all pairs.

Defined cases: a null vector, one of zeros, one with a null or non-finite component, and one whose label is null link
with nothing; so do vectors of different dimension; a null id keeps its row, counts as a vector that others link to,
and never names a component (a component of null ids only is null); repeated rows are vectors of their own; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, scratch, shards, written

BLOCK = 2048
STRIPE = 256
PAIRS = 50_000
#: Dimensions of which the rotation is estimated; longer vectors keep their own order of coordinates.
PCA_DIMS = 1024


def units(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By dimension, the sum of the outer products of the unit vectors of a task."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        size = batch.column(1).to_numpy()
        for d in np.unique(size):
            v = units(_matrix(batch.column(0).filter(pa.array(size == d))))
            sums[int(d)] = sums.get(int(d), 0) + v.T @ v
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["dim", "sums"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
    return pa.table({"dim": table.column("dim")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def rotations(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension up to PCA_DIMS, the principal axes of all unit vectors, strongest first."""
    rows = distinct.where(F.col("dim") <= PCA_DIMS).select("v", "dim").mapInArrow(_moments, "dim int, sums binary").groupBy("dim").applyInArrow(_added, "dim int, sums binary").collect()  # one row per dimension
    return {r.dim: np.linalg.eigh(np.frombuffer(r.sums).reshape(r.dim, r.dim))[1][:, ::-1] for r in rows}


def _suffixes(r: np.ndarray, cuts: list[int]) -> np.ndarray:
    """By cut, the length of what follows it of each row."""
    return np.stack([np.sqrt((r[:, c:] ** 2).sum(axis=1)) for c in cuts], axis=1)


def near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> Iterator[np.ndarray]:
    """(row of a, row of b) with cosine >= threshold; a and b as given."""
    ua, ub = units(a), units(b)
    ra, rb = (ua, ub) if axes is None else (ua @ axes, ub @ axes)
    d = a.shape[1]
    cuts = sorted({min(d, max(1, d * k // 8)) for k in (1, 2, 4, 8)})
    sa, sb = _suffixes(ra, cuts), _suffixes(rb, cuts)
    least = threshold - 1e-9  # rounding of the rotation
    lead_b = np.concatenate([rb[:, : cuts[0]], sb[:, :1]], axis=1).T
    for lo in range(0, len(a), STRIPE):
        rows = slice(lo, lo + STRIPE)
        # the bound in one product: leading coordinates, then the suffix norm as one more
        bound = np.concatenate([ra[rows, : cuts[0]], sa[rows, :1]], axis=1) @ lead_b
        i, j = np.nonzero(bound >= least)
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS] + lo, j[at : at + PAIRS]
            product = np.zeros(len(x))
            done = 0
            for k, c in enumerate(cuts):
                product += np.einsum("ij,ij->i", ra[x, done:c], rb[y, done:c])
                keep = product + sa[x, k] * sb[y, k] >= least
                x, y, product, done = x[keep], y[keep], product[keep], c
            exact = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            if exact.any():
                yield np.stack([x[exact], y[exact]], axis=1)


_TILE = "node long, links long, root long"


def _tile(table: pa.Table, axes: dict[int, np.ndarray], threshold: float) -> pa.Table:
    own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
    v = _matrix(table.column("v").combine_chunks())
    same = i[0] == j[0]
    p, q = (np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0]))
    links, tree = np.zeros(len(node), np.int64), np.zeros((0, 2), np.int64)
    if len(p) and len(q):
        for pairs in near_pairs(v[p], v[q], axes.get(v.shape[1]), threshold):
            x, y = p[pairs[:, 0]], q[pairs[:, 1]]
            if same:
                x, y = x[x != y], y[x != y]
            np.add.at(links, x, n[y])
            if not same:
                np.add.at(links, y, n[x])
            if len(x):
                tree = forest(np.concatenate([tree, np.stack([node[x], node[y]], axis=1)]))
    root = dict(tree.tolist())
    some = np.flatnonzero(links)
    return pa.table({"node": node[some], "links": links[some], "root": pa.array([root.get(int(k)) for k in node[some]], pa.int64())})


def embedding_components(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component) for each row: the other vectors it links to directly, and the smallest id reachable."""
    spark = rows.sparkSession
    raw = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    marked = raw.withColumn("good", F.coalesce(good, F.lit(False)))
    key = [F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2")]
    vectors = marked.where("good").select("id", "label", F.size("v").alias("dim"), *key, "v")
    distinct = vectors.groupBy("label", "dim", "k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), scratch(spark, "embeddings-distinct"))
    axes = rotations(distinct)
    sizes = written(distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), scratch(spark, "embeddings-sizes"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    tiles = distinct.join(sizes, ["label", "dim"]).withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("label", "dim", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "n", "v").repartition(shards(distinct, 8), "label", "dim", "i", "j")

    def compared(table: pa.Table) -> pa.Table:
        return _tile(table, axes, threshold)

    found = written(tiles.groupBy("label", "dim", "i", "j").applyInArrow(compared, _TILE), scratch(spark, "embeddings-tiles"))
    joined = components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")), "embeddings")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = distinct.select("node", "label", "dim", "k1", "k2", "n", "first").join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    lowest = named.groupBy("root").agg(F.min("first").alias("low"))
    named = named.join(lowest, "root").select("label", "dim", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("low").alias("component"))
    named = written(named, scratch(spark, "embeddings-named"))
    linked = vectors.drop("v").join(named, ["label", "dim", "k1", "k2"]).select("id", "n_links", "component")
    alone = marked.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)
