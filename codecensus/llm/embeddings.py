"""Embedding near-duplicates: tiles in principal-axis order, compared leading dimensions first."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import running_total
from .common import Batches, batch, joined, pick, prepare, saved, table
from .components import components

#: Vectors of a tile; leading axes whose ranges tell tiles apart; dimensions added per step.
TILE, BOX, STEP = 1024, 4, 8
#: Rounding that pruning allows for; what passes is confirmed on the vectors as given.
SLACK = 1e-9
SUMS = 8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by dimension, strongest first, from the summed second moments of all unit vectors (x, dim)."""

    def moments(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            dims = np.array(b.column("dim"))
            for d in np.unique(dims).tolist():
                x = _matrix(b.column("x").filter(pa.array(dims == d)), d)
                x = x / np.linalg.norm(x, axis=1)[:, None]
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield batch(dim=pa.array([d], pa.int32()), part=pa.array([zlib.crc32(m.tobytes()) % SUMS], pa.int32()), m=[m.tobytes()])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        m = sum(np.frombuffer(x) for x in group["m"])
        return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "m": [m.tobytes()]})

    rows = vectors.select("x", "dim").mapInArrow(moments, "dim int, part int, m binary").groupBy("dim", "part").applyInPandas(add, "dim int, m binary").collect()
    total: dict[int, np.ndarray] = {}
    for r in rows:
        total[r.dim] = total.get(r.dim, 0) + np.frombuffer(r.m)
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in total.items()}


def _survivors(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two rotated unit tiles whose product may reach ``least``.

    Products grow a few leading dimensions at a time; the rest is at most the product of the suffix norms. While many
    pairs are left whole tiles go on, later only the pairs.
    """
    dim = a.shape[1]
    ra, rb = (np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0)) for x in (a, b))
    s, k, i, j = np.zeros((len(a), len(b))), 0, None, None
    while k < dim:
        k, at = min(k + STEP, dim), k
        if i is None:
            s += a[:, at:k] @ b[:, at:k].T
            ok = s + (np.outer(ra[:, k], rb[:, k]) if k < dim else 0) >= least
            if ok.sum() * 16 < ok.size or k == dim:
                i, j = np.nonzero(ok)
                s = s[i, j]
        else:
            s += np.einsum("ij,ij->i", a[i, at:k], b[j, at:k])
            ok = s + (ra[i, k] * rb[j, k] if k < dim else 0) >= least
            i, j, s = i[ok], j[ok], s[ok]
        if i is not None and not len(i):
            break
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, links) from a written table (cid, label, dim, x, weight) of distinct vectors.

    Per pair of tiles that may hold a link: each linked class a, one class b of its group there, and how many vectors of
    other classes a is linked with. Pairs themselves stay inside the task.
    """
    basis = classes.sparkSession.sparkContext.broadcast(axes(classes))

    def rotate(batches: Batches) -> Batches:
        for b in batches:
            dims = np.array(b.column("dim"))
            for d in np.unique(dims).tolist():
                keep = pa.array(dims == d)
                x = _matrix(b.column("x").filter(keep), d)
                y = (x / np.linalg.norm(x, axis=1)[:, None]) @ basis.value[d]
                lead = np.pad(y[:, :BOX], ((0, 0), (0, max(0, BOX - d))))
                yield batch(cid=b.column("cid").filter(keep), label=b.column("label").filter(keep), dim=b.column("dim").filter(keep),
                            weight=b.column("weight").filter(keep), x=pa.array(list(x), pa.list_(pa.float64())), lead=pa.array(list(lead), pa.list_(pa.float64())))

    rows = classes.mapInArrow(rotate, "cid long, label int, dim int, weight long, x array<double>, lead array<double>")
    rows = running_total(rows, ["label", "dim"], [F.col("lead")[0], F.col("cid")], {"pos": F.lit(1)}, lambda d: saved(d, "ordered-vectors"))
    rows = saved(rows.withColumn("tile", (F.col("pos") / TILE).cast("long")), "tiles")
    box = [f(F.col("lead")[k]).alias(f"{n}{k}") for k in range(BOX) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = saved(rows.groupBy("label", "dim", "tile").agg(*box), "boxes")
    other = boxes.toDF(*[f"o_{c}" for c in boxes.columns])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"o_hi{k}"), F.col(f"o_lo{k}") - F.col(f"hi{k}")), F.lit(2)) for k in range(BOX)), F.lit(0.0))
    near = boxes.join(other, (F.col("label") == F.col("o_label")) & (F.col("dim") == F.col("o_dim")) & (F.col("tile") <= F.col("o_tile")) & (gap <= 2 - 2 * least + SLACK))
    near = saved(near.select("label", "dim", F.col("tile").alias("t1"), F.col("o_tile").alias("t2")).withColumn("pair", F.monotonically_increasing_id()), "tile-pairs")
    sides = near.select("pair", "label", "dim", F.col("t1").alias("tile"), F.lit(0).alias("side")).union(
        near.filter("t1 <> t2").select("pair", "label", "dim", F.col("t2").alias("tile"), F.lit(1).alias("side")))
    sent = rows.drop("lead", "pos").join(sides, ["label", "dim", "tile"]).select("pair", "side", "cid", "dim", "weight", "x")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "cid"])
        x = np.stack(group["x"].to_numpy())
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        y = unit @ basis.value[int(group["dim"].iloc[0])]
        side, cid, weight = group["side"].to_numpy(), group["cid"].to_numpy(), group["weight"].to_numpy()
        n0 = int((side == 0).sum())
        if n0 == len(y):
            i, j = _survivors(y, y, least - SLACK)
            i, j = i[i < j], j[i < j]
        else:
            i, j = _survivors(y[:n0], y[n0:], least - SLACK)
            j = j + n0
        ok = np.einsum("ij,ij->i", x[i], x[j]) / (np.linalg.norm(x[i], axis=1) * np.linalg.norm(x[j], axis=1)) >= least
        i, j = i[ok], j[ok]
        n = np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
        root, at = _roots(len(x), i, j), np.flatnonzero(n)
        return pd.DataFrame({"a": cid[at], "b": cid[root[at]], "links": n[at].astype(np.int64)})

    return saved(sent.groupBy("pair").applyInPandas(compare, "a long, b long, links long"), "links")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, n_copies.

    Links join vectors with one non-null label, one length and a cosine of ``least`` or more. Null, empty and zero vectors and
    those with null or non-finite components link with nothing. Equal vectors of a label form a class that is compared
    once and counted in full; repeated rows are vectors of their own. A null vec_id is never a component's id unless its
    component has no other, and then kept. Other columns are not read.
    """
    src = pick(vectors, "vec_id", "embedding", "label")
    src = src.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & finite & (F.size("x") > 0) & (square > 0) & (square < float("inf")), F.lit(False))
    src = src.withColumn("ok", ok).withColumns({"k1": F.xxhash64("label", "x"), "k2": F.xxhash64(F.lit(7), "x", "label")})
    keys = ["label", "k1", "k2"]
    cls = src.filter("ok").groupBy(*keys).agg(F.first("x").alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    cls = saved(cls.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("x")), "vector-classes")
    found = links(cls.select("cid", "label", "dim", "x", "weight"), least)
    comp = components(found.select("a", "b"))
    many = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    cls = cls.select("cid", *keys, "weight", "low").join(comp.withColumnRenamed("node", "cid"), "cid", "left").join(many.withColumnRenamed("node", "cid"), "cid", "left")
    cls = saved(cls.withColumn("component", F.coalesce("component", "cid")), "vector-components")
    lows = cls.groupBy("component").agg(F.min("low").alias("component_id"))
    cls = saved(cls.join(lows, "component").select(*keys, F.lit(True).alias("ok"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "weight"), "class-results")
    out = joined(src.drop("x"), cls, [*keys, "ok"])
    cid = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"),
                      F.col("vec_id").eqNullSafe(cid).alias("kept"), F.coalesce("weight", F.lit(1)).alias("n_copies"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
k AS (SELECT label, x, count(*) AS n_copies FROM v GROUP BY ALL)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept, k.n_copies::BIGINT AS n_copies
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a JOIN k ON k.label = v.label AND k.x = v.x
"""
