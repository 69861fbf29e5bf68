"""Density clustering on a grid, with the exact result of DBSCAN.

Cells are so small that all rows of one cell are within the radius of each other (Gunawan, 2013).
A cell with enough rows is dense as a whole and needs no pairs. Only rows of thin cells are compared
with neighbouring cells. Which occupied cells are neighbours is found once, by a range search over boxes around cells, so the number of
columns does not multiply anything. Two cells are linked when some core rows are close; bounding boxes decide
most links, and boxes too full to compare row by row are split until they decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.stats import number
from lumenframe.operators.boxes import range_pairs
from lumenframe.operators.graph import connected_components
from lumenframe.session import cut_lineage

# Row pairs that two boxes may have before they are split instead of compared.
DIRECT_PAIRS = 10_000


def _square_gap(d: int, a: str, b: str) -> Column:
    return reduce(Column.__add__, [(F.col(f"{a}.x{i}") - F.col(f"{b}.x{i}")) * (F.col(f"{a}.x{i}") - F.col(f"{b}.x{i}")) for i in range(d)])


def _box_gaps(d: int) -> tuple[Column, Column]:
    """Smallest and largest squared distance between the boxes ``a`` and ``b``."""
    near, far = [], []
    for i in range(d):
        lo = F.greatest(
            F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"), F.lit(0.0)
        )
        hi = F.greatest(F.col(f"a.hi{i}") - F.col(f"b.lo{i}"), F.col(f"b.hi{i}") - F.col(f"a.lo{i}"))
        near.append(lo * lo)
        far.append(hi * hi)
    return reduce(Column.__add__, near), reduce(Column.__add__, far)


def _between_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared number of whole cells between the cells of a and b."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = np.maximum(np.abs(a[:, j : j + 1] - b[None, :, j]) - 1, 0.0)
        total += gap * gap
    return total


def _neighbours(cells: DataFrame, d: int) -> DataFrame:
    """``(cell, near)`` for occupied cells that may hold rows within the radius of each other, each cell with itself.

    The side of a cell is the radius over the root of d. At most root of d cells between two cells add up to no more than twice that root between
    their places.
    """
    found = range_pairs(cells, d, 2 * sqrt(d) + 1e-6, d * (1 + 1e-9), _between_cells, both=True)
    return cut_lineage(found.select(F.col("left").alias("cell"), F.col("right").alias("near")))


def dbscan(
    df: DataFrame, key: str, cols: Sequence[str], eps: float, min_samples: int = 5, *, direct_pairs: int | None = None
) -> DataFrame:
    """``(key, is_core, cluster)``; a cluster is named by its smallest core key, noise is -1.

    Keys are whole numbers from 0. A border row belongs to the smallest-named cluster it touches. A row
    with a null or NaN coordinate has no neighbours and is noise.
    """
    d = len(cols)
    side = eps / sqrt(d) * (1 - 1e-12)
    limit = DIRECT_PAIRS if direct_pairs is None else direct_pairs
    xs = [f"x{i}" for i in range(d)]
    place = F.array(*[F.floor(F.col(x) / F.lit(side)).cast("double") for x in xs])
    cell = F.array_join(F.transform(place, lambda v: v.cast("long").cast("string")), ",")
    points = df.select(F.col(key).cast("long").alias("key"), *[number(c).alias(x) for c, x in zip(cols, xs)])
    placed = reduce(Column.__and__, [F.col(x).isNotNull() for x in xs])
    unplaced = points.where(~placed).select("key", F.lit(False).alias("is_core"), F.lit(-1).cast("long").alias("cluster"))
    points = points.where(placed).withColumn("cell", cell)
    sizes = points.groupBy("cell").agg(F.count("*").alias("rows"))
    sized = cut_lineage(points.join(sizes, "cell"))
    near = _neighbours(sized.groupBy("cell").agg(F.first(place).alias("x")).withColumnRenamed("cell", "key"), d)
    dense = sized.where(F.col("rows") >= min_samples)
    thin = sized.where(F.col("rows") < min_samples)
    # Rows at the same place are merged before they are compared with anything.
    places = sized.groupBy("cell", *xs).agg(F.count("*").alias("weight"))
    met = thin.select("key", *xs, "cell").join(near, "cell").alias("a").join(
        places.alias("b"), F.col("a.near") == F.col("b.cell")
    )
    close = met.where(_square_gap(d, "a", "b") <= eps * eps)
    counted = close.groupBy("a.key").agg(F.sum("b.weight").alias("around")).where(F.col("around") >= min_samples)
    core = dense.select("key", "cell", *xs).union(thin.join(counted, "key", "left_semi").select("key", "cell", *xs))
    core = cut_lineage(core)
    names = core.groupBy("cell").agg(F.min("key").alias("name"))
    # Cells never hold more names than rows; the links are found between names.
    named = core.join(names, "cell")
    links = _links(named, names, d, eps, side, near.where("cell <> near"), limit)
    components = connected_components(names.select(F.col("name").alias("node")), links)
    labelled = named.join(components, F.col("name") == F.col("node")).select("key", "cell", *xs, F.col("component").alias("cluster"))
    labelled = cut_lineage(labelled)
    rest = thin.join(core.select("key"), "key", "left_anti")
    spots = labelled.select("cell", *xs, "cluster").distinct()
    touched = rest.select("key", *xs, "cell").join(near, "cell").alias("a").join(
        spots.alias("b"), F.col("a.near") == F.col("b.cell")
    ).where(_square_gap(d, "a", "b") <= eps * eps).groupBy("a.key").agg(F.min("b.cluster").alias("cluster"))
    border = rest.select("key").join(touched, "key", "left").select(
        "key", F.lit(False).alias("is_core"), F.coalesce("cluster", F.lit(-1)).alias("cluster")
    )
    return labelled.select("key", F.lit(True).alias("is_core"), "cluster").union(border).union(unplaced)


def _links(named: DataFrame, names: DataFrame, d: int, eps: float, side: float, near: DataFrame, limit: int) -> DataFrame:
    """``(src, dst)`` for neighbouring cells with core rows within the radius."""
    xs = [f"x{i}" for i in range(d)]
    spots = named.select("name", "cell", *xs).distinct().withColumn("box", F.lit(""))
    pairs = (
        names.select(F.col("name").alias("src"), "cell").join(near, "cell").drop("cell")
        .join(names.select(F.col("name").alias("dst"), "cell"), F.col("near") == F.col("cell"))
        .where("src < dst")
        .select("src", "dst", F.lit("").alias("src_box"), F.lit("").alias("dst_box"))
    )
    bounds = [F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)] + [F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)]
    found = []
    depth = 0
    while True:
        boxes = spots.groupBy("name", "box").agg(F.count("*").alias("n"), *bounds)
        near_, far_ = _box_gaps(d)
        a, b = boxes.alias("a"), boxes.alias("b")
        judged = (
            pairs.alias("p")
            .join(a, (F.col("p.src") == F.col("a.name")) & (F.col("p.src_box") == F.col("a.box")))
            .join(b, (F.col("p.dst") == F.col("b.name")) & (F.col("p.dst_box") == F.col("b.box")))
            .where(near_ <= eps * eps)
            .select("p.*", (far_ <= eps * eps).alias("sure"), (F.col("a.n") * F.col("b.n")).alias("work"))
        )
        judged = cut_lineage(judged)
        sure = judged.where("sure").select("src", "dst").distinct()
        left = judged.where(~F.col("sure")).join(sure, ["src", "dst"], "left_anti")
        s, t = spots.alias("a"), spots.alias("b")
        compared = (
            left.where(F.col("work") <= limit).alias("p")
            .join(s, (F.col("p.src") == F.col("a.name")) & (F.col("p.src_box") == F.col("a.box")))
            .join(t, (F.col("p.dst") == F.col("b.name")) & (F.col("p.dst_box") == F.col("b.box")))
            .where(_square_gap(d, "a", "b") <= eps * eps)
            .select("p.src", "p.dst").distinct()
        )
        done = cut_lineage(sure.union(compared).distinct())
        found.append(done)
        full = left.where(F.col("work") > limit).join(done, ["src", "dst"], "left_anti")
        if not full.limit(1).count():
            break
        # Split every box that is still open into 4 parts per axis.
        depth += 1
        grain = side / 4**depth
        part = F.concat_ws("_", *[F.floor(F.col(x) / F.lit(grain)).cast("string") for x in xs])
        open_boxes = full.select(F.col("src").alias("name"), F.col("src_box").alias("box")).union(
            full.select("dst", "dst_box")
        ).distinct()
        split = cut_lineage(
            spots.join(open_boxes, ["name", "box"], "left_semi").withColumns({"was": F.col("box"), "box": part})
        )
        kids = split.select("name", "was", "box").distinct()
        k, m = kids.alias("k"), kids.alias("m")
        pairs = (
            full.alias("p")
            .join(k, (F.col("p.src") == F.col("k.name")) & (F.col("p.src_box") == F.col("k.was")))
            .join(m, (F.col("p.dst") == F.col("m.name")) & (F.col("p.dst_box") == F.col("m.was")))
            .select("src", "dst", F.col("k.box").alias("src_box"), F.col("m.box").alias("dst_box"))
        )
        spots = split.drop("was")
    return reduce(DataFrame.union, found).distinct()
