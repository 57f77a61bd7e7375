"""Near-duplicate vectors by binary codes of random rotations (RaBitQ; Gao and Long, 2024).

A unit vector o is rotated at random; its code is the signs, as a vector of length 1, and the stored correction factor is f = <code, rotated o>.  For any other unit vector q,
<code, rotated q> / f estimates <o, q> without bias, and misses it by more than EPSILON * sqrt((1 - f^2) / f^2 / (d - 1)) hardly ever (below 1e-6).  Pairs whose upper bound reaches
the threshold are computed again in double precision; only these exact cosines decide.

Which pairs are estimated: equal vectors are one node.  The signs of several rotations are cut into bands of `bits` bits, and vectors meet if a band is equal.  bits grows with the logarithm
of the number of vectors, so a group stays small; there are so many bands that a pair at the threshold is missed with probability MISS.  A group of over CHUNK vectors (near copies) is
cut into chunks, and every pair of chunks is a task's work, so no task holds more than two.  Links are counted, not listed: a task returns sums of links and a forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm import text as T
from weblens.llm.graph import components
from weblens.llm.shared import partitions, saved
from weblens.llm.simhash import Forest

EPSILON, MISS, CHUNK, SEED = 5.0, 1e-5, 2048, 20240607
#: Groups up to this size are compared together, larger ones in blocks of so many rows.
SMALL, BLOCK = 48, 256
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(d: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    if (d, number) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([SEED, d, number]).standard_normal((d, d)))
        _rotations[d, number] = q * np.sign(np.diag(r))
    return _rotations[d, number]


def bands(units: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The number of each band of each vector: vectors x count."""
    d = units.shape[1]
    signs = np.concatenate([units @ rotation(d, k).T > 0 for k in range(-(-bits * count // d))], axis=1)[:, : bits * count]
    return signs.reshape(len(units), count, bits) @ (1 << np.arange(bits, dtype=np.int64))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _banded(bits: int, count: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for d in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                units = matrix(part.column("vector"))
                units /= np.sqrt((units * units).sum(1, keepdims=True))
                found = bands(units, bits, count)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * count, pa.int32()), pa.array(found.reshape(-1)))
                yield pa.record_batch([part.column("node"), part.column("weight"), part.column("vector"), lists], names=["node", "weight", "vector", "bands"])

    return go


class Group:
    """Compares vectors; links count where the pair's first common band is the one at hand."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, vectors: np.ndarray, found: np.ndarray, band: np.ndarray, threshold: float):
        self.node, self.weight, self.found, self.band, self.threshold = node, weight, found, band, threshold
        self.units = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
        d = vectors.shape[1]
        turned = self.units @ rotation(d, 0).T
        self.turned = turned.astype(np.float32)
        self.code = (np.where(turned > 0, 1.0, -1.0) / math.sqrt(d)).astype(np.float32)
        self.factor = (self.code * turned).sum(1)
        self.slack = EPSILON * np.sqrt(np.maximum(0, 1 - self.factor**2) / self.factor**2 / max(1, d - 1))
        self.links = np.zeros(len(node), np.int64)
        self.forest = Forest(len(node))

    def _count(self, a: np.ndarray, b: np.ndarray) -> None:
        band = int(self.band[a[0]]) if len(a) else 0
        if len(a) and (self.band[a] == band).all():
            earlier = np.zeros(len(a), bool)
            for k in range(band):
                earlier |= self.found[a, k] == self.found[b, k]
        else:
            earlier = ((self.found[a] == self.found[b]) & (np.arange(self.found.shape[1]) < self.band[a][:, None])).any(1)
        a, b = a[~earlier], b[~earlier]
        self.links += np.bincount(a, self.weight[b], len(self.links)).astype(np.int64) + np.bincount(b, self.weight[a], len(self.links)).astype(np.int64)
        self.forest.link(a, b)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        for low in range(0, len(a), 1 << 17):
            x, y = a[low : low + (1 << 17)], b[low : low + (1 << 17)]
            estimate = (self.code[x] * self.turned[y]).sum(1) / self.factor[x]
            near = estimate + self.slack[x] >= self.threshold
            x, y = x[near], y[near]
            near = (self.units[x] * self.units[y]).sum(1) >= self.threshold
            self._count(x[near], y[near])

    def block(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of rows a and rows b; if these are the same, each once."""
        for low in range(0, len(a), BLOCK):
            x = a[low : low + BLOCK]
            estimate = self.code[x] @ self.turned[b].T / self.factor[x, None]
            near = estimate + self.slack[x, None] >= self.threshold
            if a is b:
                near &= x[:, None] < b[None, :]
            again = np.flatnonzero(near.any(1))
            exact = self.units[x[again]] @ self.units[b].T >= self.threshold
            i, j = np.nonzero(exact & near[again])
            self._count(x[again[i]], b[j])


def _compare(threshold: float):
    def group(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        key, node, weight, band, chunk, left, right = (table.column(c).to_numpy() for c in ("key", "node", "weight", "band", "chunk", "left", "right"))
        lengths = table.column("vector").value_lengths().to_numpy()
        out = []
        for d in np.unique(lengths):
            own = np.flatnonzero(lengths == d)
            own = own[np.argsort(key[own], kind="stable")]
            part = table.take(pa.array(own))
            found = part.column("bands").flatten().to_numpy().reshape(len(own), -1)
            g = Group(node[own], weight[own], matrix(part.column("vector")), found, band[own], threshold)
            first = np.flatnonzero(np.append(True, np.diff(key[own]) != 0))
            size = np.diff(np.append(first, len(own)))
            cross = (left != right)[own]
            for k in np.flatnonzero((size > SMALL) | cross[first]):
                at = np.arange(first[k], first[k] + size[k])
                if cross[at[0]]:
                    g.block(at[chunk[own[at]] == left[own[at[0]]]], at[chunk[own[at]] == right[own[at[0]]]])
                else:
                    g.block(at, at)
            few = (size <= SMALL) & (size > 1) & ~cross[first]
            first, size = first[few], size[few]
            for step in range(1, int(size.max()) if len(size) else 0):
                wide = size > step
                n = size[wide] - step
                a = np.repeat(first[wide] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                g.pairs(a, a + step)
            met = np.flatnonzero(g.links)
            apart = np.flatnonzero(g.forest.root != np.arange(len(own)))
            sums, inverse = np.unique(g.node[met], return_inverse=True)
            n = np.bincount(inverse, g.links[met], len(sums)).astype(np.int64)
            edges = np.unique(np.stack([g.node[apart], g.node[g.forest.root[apart]]], 1), axis=0)
            edges = edges[edges[:, 0] != edges[:, 1]]
            columns = [np.append(sums, edges[:, 0]), np.append(sums, edges[:, 1]), np.append(n, np.zeros(len(edges), np.int64))]
            out.append(pa.record_batch([pa.array(c) for c in columns], names=["a", "b", "n"]))
        return out

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, rows in T.grouped(batches, "key"):
            held += rows
            size += sum(r.num_rows for r in rows)
            if size >= 4096:
                yield from group(held)
                held, size = [], 0
        if held:
            yield from group(held)

    return go


def near_duplicates(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of table: the id (integer), n_links (rows with another vector or id at a cosine >= threshold), component_id (smallest id reachable), kept (id = component_id).

    A vector that is null, empty, zero or holds null or non-finite components links with nothing, and neither do vectors of different length. Equal vectors link with each other. Rows that
    repeat an id count as vectors of their own. A null id: no links, component_id and kept are null. Other columns are ignored.
    """
    spark = table.sparkSession
    v = F.col("vector")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = saved(rows.withColumn("vector", F.when(sound, v)).withColumn("hash", F.xxhash64("vector")))
    real = rows.where("vector is not null")
    nodes = saved(real.groupBy("hash", "vector").agg(F.min("id").alias("node"), F.count("*").alias("weight")))
    n = max(2, nodes.count())
    bits = min(40, max(4, math.ceil(math.log2(n)) - 4))
    equal = (1 - math.acos(threshold) / math.pi) ** bits
    count = math.ceil(math.log(MISS) / math.log1p(-equal))
    kinds = dict(nodes.dtypes)
    banded = saved(nodes.mapInArrow(_banded(bits, count), f"node long, weight long, vector {kinds['vector']}, bands array<long>"))
    spread = banded.select("*", F.posexplode("bands").alias("band", "value")).withColumn("size", F.size("vector"))
    hot = spread.groupBy("size", "band", "value").count().where(F.col("count") > CHUNK).select("size", "band", "value", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    joined = spread.join(saved(hot), ["size", "band", "value"], "left").withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "chunks")).cast("int"))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    tasks = joined.withColumn("other", F.explode(others)).withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
    tasks = tasks.withColumn("key", F.xxhash64("size", "band", "value", "left", "right")).select("key", "node", "weight", "vector", "bands", "band", "chunk", "left", "right")
    met = tasks.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_compare(threshold), "a long, b long, n long")
    met = saved(met)
    links = met.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    groups = components(met.where("a <> b").select("a", "b"))
    named = nodes.join(links, "node", "left").join(groups, "node", "left").select("hash", F.col("vector").alias("v"), "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component"))
    named = named.withColumn("n", F.col("n") + F.col("weight") - 1).withColumnRenamed("hash", "h")
    out = rows.join(named, (F.col("hash") == F.col("h")) & (F.col("vector") == F.col("v")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
