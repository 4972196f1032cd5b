"""Centroid clustering of integer vectors, in built-in functions.

A vector of floats becomes whole numbers, so that distances and means are exact and no result
depends on the order of a sum. For each literal centroid `zip_with` and `aggregate` give the
product with the vector, from that and the squares of both the squared distance follows, and the
smallest of the structs (distance, number) is the cluster. Sums of
the single components and a count, 40 rows in all, give the next centroids; they are combined
before the shuffle, so a cluster of any size is one row per task. Only centroids and their sums
come to the driver: their number is a parameter, not a property of the data.

The first centroids are the vectors with the smallest digests of their ids. Digests are even
over their range, so a bound on the digest that about four times as many vectors meet is read
off the count, and only those are ordered; if too few meet it, it is raised and the step run
again, which makes the choice exact.

Defined cases: a null vector, one of another length, and one with a null or non-finite component
are left out; so is one with a component whose whole number is 2^27 or more in size, for which
squared distances would not fit a long. A null id is digested as the empty id. Equal rows are
vectors of their own; equal ids are ordered by their vectors; of equal centroids the one with
the smaller number counts, the others stay empty and keep their place. Fewer vectors than
centroids make fewer centroids; an empty table has none and gives no rows. Other columns are
passed through, and the columns added replace columns of the same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.once import compute_once
from trailspark.llm.tables import saved

Centroids = list[tuple[int, ...]]

#: Whole numbers stay below this, so that the squared distance of up to 127 components, and every
#: sum on the way to it, is a long.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, vector: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """The rows whose vector counts, with `_v`: floor(scale * component) for each component."""

    def counts(x: Column) -> Column:
        size = F.abs(F.floor(x.cast("double") * scale).cast("double"))
        return F.coalesce(~F.isnan(x) & (size < LARGEST), F.lit(False))

    good = F.coalesce((F.size(vector) == dims) & F.forall(vector, counts), F.lit(False))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return compute_once(vectors.filter(good), _v=whole)


def _digest(vec_id: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def first_centroids(whole: DataFrame, n: int, k: int, vec_id: str = "vec_id", seed: str = "2:") -> Centroids:
    """The vectors, of `n` with `_v`, that have the `k` smallest digests of their ids."""
    keyed = whole.select(_digest(F.col(vec_id), seed).alias("digest"), "_v")
    share = min(1.0, 4 * k / n) if n else 1.0
    while True:
        near = keyed if share >= 1 else keyed.filter(F.col("digest") < F.lit(f"{int(share * 2**64):016x}"))
        # equal vectors of one id are counted, not carried: one such id may hold a third of all rows
        counted = near.groupBy("digest", "_v").agg(F.count("*").alias("n"))
        rows = counted.orderBy("digest", "_v").limit(k).collect()
        if share >= 1 or sum(r["n"] for r in rows) >= k:
            return [tuple(r["_v"]) for r in rows for _ in range(min(k, r["n"]))][:k]
        share *= 4


def _literal(centroids: Centroids) -> Column:
    """Structs of a centroid's components and the sum of their squares."""
    arrays = ("array(" + ",".join(f"{x}L" for x in c) + ")" for c in centroids)
    squares = (sum(x * x for x in c) for c in centroids)
    return F.expr("array(" + ",".join(f"named_struct('c', {a}, 'cc', {n}L)" for a, n in zip(arrays, squares)) + ")")


def _nearest(centroids: Centroids) -> Column:
    """Struct of the squared distance less the squares of the vector itself, and the cluster."""
    zero = F.lit(0).cast("bigint")

    def product(centroid: Column) -> Column:
        return F.aggregate(F.zip_with("_v", centroid, lambda x, c: x * c), zero, lambda total, term: total + term)

    return F.array_min(
        F.transform(
            _literal(centroids),
            lambda c, j: F.struct((c["cc"] - 2 * product(c["c"])).alias("distance"), j.alias("cluster")),
        )
    )


def assign(whole: DataFrame, centroids: Centroids) -> DataFrame:
    """Add `cluster` and `distance` (squared) of the nearest centroid to vectors `_v`."""
    nearest = compute_once(whole, _nearest=_nearest(centroids))
    own = F.aggregate("_v", F.lit(0).cast("bigint"), lambda total, x: total + x * x)
    added = {"cluster": F.col("_nearest.cluster"), "distance": F.col("_nearest.distance") + own}
    return nearest.withColumns(added).drop("_nearest")


def moved(whole: DataFrame, centroids: Centroids) -> Centroids:
    """One round: every centroid that has vectors moves to the floor of their mean."""
    dims = len(centroids[0])
    near = whole.select("_v", _nearest(centroids)["cluster"].alias("cluster"))
    sums = near.groupBy("cluster").agg(
        F.count("*").alias("n"), *(F.sum(F.get("_v", F.lit(d))).alias(f"s{d}") for d in range(dims))
    )
    after = list(centroids)
    for row in sums.collect():
        after[row["cluster"]] = tuple(row[f"s{d}"] // row["n"] for d in range(dims))
    return after


def fit_centroids(
    whole: DataFrame, k: int = 40, rounds: int = 5, vec_id: str = "vec_id", seed: str = "2:"
) -> Centroids:
    """Centroids of the vectors `_v` after `rounds` rounds; empty without vectors."""
    centroids = first_centroids(whole, whole.count(), k, vec_id, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(whole, centroids)
    return centroids


def centroid_digest(centroid: tuple[int, ...]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dims: int = 64,
    scale: int = 256,
    seed: str = "2:",
) -> tuple[DataFrame, Centroids]:
    """(vectors with `cluster` and `distance`, the centroids).

    The whole numbers are written once and read by every round: ids and vectors only, in about
    a third of the space of the floats. The last assignment reads the table as it was given.
    """
    if not 1 <= dims <= 127:
        raise ValueError("1 to 127 components")
    given = vectors.drop(*(c for c in ("cluster", "distance") if c not in (vec_id, vector)))
    whole = whole_vectors(given, vector, dims, scale)
    centroids = fit_centroids(saved(whole.select(vec_id, "_v"), "whole-vectors"), k, rounds, vec_id, seed)
    if not centroids:
        empty = whole.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("bigint")})
        return empty.filter("false").drop("_v"), []
    return assign(whole, centroids).drop("_v"), centroids


def with_inertia(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """Add `cluster_inertia` and `inertia`, sums of `distance` over its cluster and over all.

    `assigned` is read twice: give a saved table. There is one sum per centroid, so the sums
    are put in as literals.
    """
    rows = assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()
    total = {r["cluster"]: r["total"] for r in rows}
    sums = [total.get(j, 0) for j in range(len(centroids))]
    per_cluster = F.array(*(F.lit(s).cast("bigint") for s in sums)) if sums else F.array().cast("array<bigint>")
    return assigned.withColumns(
        {
            "cluster_inertia": F.get(per_cluster, F.col("cluster")),
            "inertia": F.lit(sum(sums)).cast("bigint"),
        }
    )
