"""Embedding near-duplicates by inverted lists with product-quantised residuals.

Unit vectors are dealt to coarse lists; within a list each holds the codes of
its residual by subspace.  A query goes to every list whose centroid is nearly
as near as its own, reads asymmetric distances from per-query tables, and ranks
what is left by exact cosine in double precision.

* The tables' distance is off by the residual's quantisation error at most, and
  that error is stored with the codes, so pruning by it loses no link.
* Probes: a partner at the threshold is the query turned by a known angle towards
  some direction.  It can live in another list only if that direction leads far
  enough from the query's nearest centroid to the other list's.  How far
  directions lead is taken from the sample's second moments, of the vectors and
  of their residuals, so data of low rank are probed as widely as they need; a
  list is searched if ``PROBE_SIGMA`` deviations reach it, and never beyond what
  any direction can.  ``exact=True`` takes that bound alone and loses no link.
  Every vector is indexed and every vector is a query.
* The centroids and codebooks are fitted on at most ``FIT_ROWS`` vectors; they
  are all that is broadcast.

Equal vectors with equal labels are one point with a multiplicity.  Lists beyond
``BLOCK`` points are split into pairs of blocks.  A task returns link counts and
a spanning forest of the links it found, never the pairs themselves.

Vectors that are null, empty, zero or hold null or non-finite components, and
rows with null labels, link with nothing.  Vectors of different lengths are
never compared.  Repeated rows and ids are vectors of their own, an empty table
gives none, and other columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._graph import components
from palisade.llm._spark import cut, parts, prepare, table

COSINE = 0.93
FIT_ROWS = 20_000
BLOCK = 2048
PROBE_SIGMA = 1.75
SUBSPACES = 8
CODEWORDS = 64
#: Points of the largest label for each coarse list.
PER_LIST = 96
#: As many lists as a sample of FIT_ROWS can place; beyond it lists grow, and are split into blocks, but nothing is left out.
MOST_LISTS = 4096


def _kmeans(x: np.ndarray, k: int, steps: int, unit: bool) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(steps):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c)).astype(float)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        full = n > 0
        c[full] = s[full] / n[full, None]
        if unit:
            size = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(size > 1e-12, c / np.maximum(size, 1e-12), c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _deviations(x: np.ndarray) -> np.ndarray:
    """A root of the second moments of directions: those of the rows, scaled to unit length on the whole."""
    moments = x.T @ x
    total = np.trace(moments)
    values, vectors = np.linalg.eigh(moments / total if total > 0 else np.eye(x.shape[1]) / x.shape[1])
    return vectors * np.sqrt(np.maximum(values, 0))


def _apart(points: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Distances of some of the points from all."""
    size = (points * points).sum(axis=1)
    return np.sqrt(np.maximum(size[which, None] + size - 2 * points[which] @ points.T, 0))


class Quantizer:
    """Coarse unit centroids and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, exact: bool = False):
        self.cosine, self.exact = cosine, exact
        self.coarse = _kmeans(sample, lists, 4, True)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        d = sample.shape[1]
        self.cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], CODEWORDS, 4, False) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        # Centroids in coordinates in which a distance is how far a direction of the data leads, one deviation.
        self.spreads = [] if exact else [self.coarse @ _deviations(m) for m in (sample, rest)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home list, codes, quantisation error) of unit vectors."""
        home = _nearest(x, self.coarse)
        rest = x - self.coarse[home]
        codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in self._parts()], axis=1).astype(np.uint8)
        near = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return home, codes, np.linalg.norm(rest - near, axis=1)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists in which partners of each vector can live."""
        s = x @ self.coarse.T
        home = s.argmax(axis=1)
        homes, at = np.unique(home, return_inverse=True)
        reach = _apart(self.coarse, homes)
        if not self.exact:
            reach = np.minimum(reach, PROBE_SIGMA * np.maximum.reduce([_apart(p, homes) for p in self.spreads]))
        margin = np.sqrt(1 - self.cosine**2) / self.cosine * reach + 1e-9
        return [np.flatnonzero(r >= r[h] - margin[i]) for r, h, i in zip(s, home, at, strict=True)]

    def _parts(self):
        return zip(self.cuts, self.cuts[1:], self.books, strict=False)

    def distances(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded points of one list."""
        rest = q - self.coarse[home]
        total = np.zeros((len(q), len(codes)))
        for i, (a, b, book) in enumerate(self._parts()):
            x = rest[:, a:b]
            lookup = (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)
            total += lookup[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r.values, np.float64) for r in rows])
    # Scaled first, so neither very large nor very small components are lost.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_ENTRY = "list int, node long, label int, copies long, home int, probes array<int>, code binary, error double, embedding array<double>"


def _index(model):
    def run(batches):
        quantizer = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(3))
            home, codes, error = quantizer.encode(x)
            probes = quantizer.probes(x)
            at = np.repeat(np.arange(len(x)), [len(p) for p in probes])
            take = pa.array(at)
            lists = np.concatenate(probes).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lists),
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    batch.column(2).take(take),
                    pa.array(home.astype(np.int32)[at]),
                    pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32())).take(take),
                    pa.array([c.tobytes() for c in codes], pa.binary()).take(take),
                    pa.array(error[at]),
                    pa.array(list(x), pa.list_(pa.float64())).take(take),
                ],
                names=["list", "node", "label", "copies", "home", "probes", "code", "error", "embedding"],
            )

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable place of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _search(model):
    """Groups of sorted rows (list, label, i, j, side...) to (node, links, hub)."""

    def group(rows: list) -> pa.RecordBatch | None:
        quantizer = model.value
        here, i, j = rows[0][0], rows[0][2], rows[0][3]
        side = np.array([r[4] for r in rows])
        home = np.array([r[7] for r in rows])
        nodes = np.array([r[5] for r in rows])
        copies = np.array([r[6] for r in rows], np.int64)
        x = np.array([r[11] for r in rows])
        codes = np.array([np.frombuffer(r[9], np.uint8) for r in rows])
        error = np.array([r[10] for r in rows])
        reach = np.sqrt(2 - 2 * quantizer.cosine) + 1e-6
        links = np.zeros(len(rows), np.int64)
        pa_, pb = [], []
        # Block i asks, block j is stored: each ordered pair of blocks is one group.
        asking = np.flatnonzero((side & 1) > 0)
        stored = np.flatnonzero(((side & 2) > 0) & (home == here))
        if not len(stored):
            return None
        goes = [set(rows[s][8]) for s in stored]
        for lo in range(0, len(asking), 512):
            q = asking[lo : lo + 512]
            near = quantizer.distances(x[q], here, codes[stored]) - error[stored]
            a, b = np.nonzero(near <= reach)
            a, s = q[a], stored[b]
            ok = a != s if i == j else np.ones(len(a), bool)
            a, s, b = a[ok], s[ok], b[ok]
            cos = np.einsum("ij,ij->i", x[a], x[s])
            ok = cos >= quantizer.cosine
            a, s, b = a[ok], s[ok], b[ok]
            np.add.at(links, a, copies[s])
            # The other way round is found in the asking point's own list, if the stored one asks there.
            back = np.fromiter((int(home[p]) not in goes[t] for p, t in zip(a, b, strict=True)), bool, len(a)) if len(a) else np.zeros(0, bool)
            np.add.at(links, s[back], copies[a[back]])
            pa_.append(a)
            pb.append(s)
        if not links.any():
            return None
        a, b = np.concatenate(pa_), np.concatenate(pb)
        root = _forest(len(rows), a, b)
        # Points that only tie others together count no link here but are part of the forest.
        keep = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(links[keep]), pa.array(nodes[root[keep]])], names=["node", "links", "hub"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    if len(rows) > 1 and (got := group(rows)) is not None:
                        yield got
                    rows, key = [], row[:4]
                rows.append(row)
        if len(rows) > 1 and (got := group(rows)) is not None:
            yield got

    return run


def _one_length(points: DataFrame, cosine: float, fit_rows: int, exact: bool) -> DataFrame:
    """(node, links, hub) of the links among points of one length."""
    spark = points.sparkSession
    largest = points.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    lists = int(min(MOST_LISTS, max(1, largest // PER_LIST)))
    sample = points.select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(fit_rows).select("embedding").toArrow()["embedding"].combine_chunks()
    model = spark.sparkContext.broadcast(Quantizer(_unit(sample), lists, cosine, exact))
    entries = cut(points.select("node", "label", "copies", "embedding").mapInArrow(_index(model), _ENTRY), "lists")
    sizes = entries.groupBy("list", "label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    dealt = entries.join(sizes, ["list", "label"]).withColumn("block", block)
    # Row by row: as asking (1) against every block, as stored (2) for every block; one row where both meet.
    asks = dealt.withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).select("*", F.col("block").alias("i"), F.when(F.col("j") == F.col("block"), 3).otherwise(1).alias("side"))
    stored = dealt.where((F.col("blocks") > 1) & (F.col("home") == F.col("list"))).withColumn("i", F.explode(F.expr("sequence(0, blocks - 1)"))).where("i <> block").select("*", F.col("block").alias("j"), F.lit(2).alias("side"))
    cols = ["list", "label", "i", "j", "side", "node", "copies", "home", "probes", "code", "error", "embedding"]
    ready = asks.select(cols).unionByName(stored.select(cols)).repartition(parts(spark), "list", "label", "i", "j").sortWithinPartitions("list", "label", "i", "j")
    return ready.mapInArrow(_search(model), "node long, links long, hub long")


def link_vectors(vectors: DataFrame, cosine: float = COSINE, fit_rows: int = FIT_ROWS, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    spark = prepare(vectors.sparkSession)
    source = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    sound = F.col("label").isNotNull() & F.coalesce(F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"), F.lit(False))
    rows = source.withColumn("node", F.when(sound, F.xxhash64("label", "embedding")))
    points = cut(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding")), "points")
    found = None
    for (size,) in points.select(F.size("embedding")).distinct().collect():
        part = _one_length(points.where(F.size("embedding") == size), cosine, fit_rows, exact)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, hub long")
    found = cut(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "group")
    named = points.select("node", "rep", "copies").join(counts, "node", "left").join(labels, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "group").select(F.col("node").alias("key"), "copies", "links", "component_id")
    out = rows.select("vec_id", "node").join(named, F.col("node") == F.col("key"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs by brute force, and their transitive closure.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(vec_id, q) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.q),
c AS (SELECT vec_id, min(q) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT c.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
