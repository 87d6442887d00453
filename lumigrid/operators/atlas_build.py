"""From a label volume and a tree of structures to an atlas: ancestors, surface, frame, regions with sides, masks; rotation of volumes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from . import atlas

#: Number of what belongs to no region.
BACKGROUND = 1


def closure(tree: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of a tree (node, parent), each node its own ancestor at 0. Parents that aren't nodes end a path.

    Distances double each round, so a path of length n takes log2(n) joins; each round is written to the shared folder. A cycle raises.
    """
    spark = tree.sparkSession
    nodes = tree.select("node", "parent").distinct()
    known, paths = shared.save(nodes.join(nodes.select(F.col("node").alias("parent")), "parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")), "closure")
    whole, more, step = nodes.count(), known.count(), 1
    while more:
        far = known.filter(F.col("distance") == step).select(F.col("node").alias("mid"), F.col("ancestor").alias("near"), F.col("distance").alias("first"))
        ends = known.filter("distance > 0").select(F.col("node").alias("near"), "ancestor", F.col("distance").alias("second"))
        new = far.join(ends, "near").select(F.col("mid").alias("node"), "ancestor", (F.col("first") + F.col("second")).alias("distance")).filter(F.col("distance") > step)
        more = new.limit(1).count()
        if more:
            grown, path = shared.save(known.unionByName(new.filter(F.col("distance") <= 2 * step)).distinct(), "closure")
            shared.remove(spark, paths)
            known, paths, step = grown, path, 2 * step
        if step > 2 * whole:
            raise ValueError("the tree has a cycle")
    return known.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")))


def members(ancestors: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): all below any of ``roots`` (node), themselves included."""
    return ancestors.join(roots.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node").distinct()


def named(tree: DataFrame, wanted: list[int | str]) -> DataFrame:
    """(node) of a tree (node, name) by number or by name; what isn't there raises."""
    ids, names = [w for w in wanted if not isinstance(w, str)], [w for w in wanted if isinstance(w, str)]
    found = tree.filter(F.col("node").isin(ids) | F.col("name").isin(names)).select("node", "name")
    got = found.collect()  # no more than were asked for, and their namesakes
    lost = [w for w in wanted if not any(w in (r["node"], r["name"]) for r in got)]
    if lost:
        raise ValueError(f"unknown structures: {lost}")
    return found.select("node")


def surface(voxels: DataFrame, inside: DataFrame, by: tuple[str, ...] = ("ap", "ml"), depth: str = "dv", value: str = "idx") -> DataFrame:
    """The first voxel going down each column whose structure is in ``inside`` (node); 0 in columns without one."""
    mark = inside.select(F.col("node").alias("_node"), F.lit(1).alias("_in"))
    marked = voxels.join(mark, voxels[value] == mark["_node"], "left")
    return atlas.surface(marked, "_in = 1", by, depth, value)


def framed(px: DataFrame, shape: tuple[int, int], to: tuple[int, int], rows: tuple[float, float] = (0.0, 1.0), cols: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(r, c, ...) cut to fractions of its extent, resampled to ``to`` by nearest pixel, mirrored left to right."""
    (a, b), (c, d) = ((round(lo * n), round(hi * n)) for (lo, hi), n in ((rows, shape[0]), (cols, shape[1])))
    a, c = max(0, a), max(0, c)
    b, d = min(max(a + 1, b), shape[0]), min(max(c + 1, d), shape[1])
    cut = px.filter((F.col("r") >= a) & (F.col("r") < b) & (F.col("c") >= c) & (F.col("c") < d)).withColumns({"r": F.col("r") - a, "c": F.col("c") - c})
    return atlas.resample(cut, (b - a, d - c), to, flip=True)


def regions(labels: DataFrame, width: int, least: int = 15) -> tuple[DataFrame, DataFrame]:
    """Pixels (r, c, label) as (r, c, region_id), and the regions' names (region_id, name).

    Areas of at least ``least`` pixels get two numbers each by falling size (ties: the area that comes first in row order), left before right, cut at
    the middle column; empty and null labels and smaller areas are background.
    """
    some = F.col("label").isNotNull() & (F.col("label") != "")
    keyed = labels.filter(some).select((F.col("r") * width + F.col("c")).alias("key"), "label")
    areas = atlas.region_ids(keyed, least).select("label", ((F.col("region_id") - 2) * 2 + 2).alias("first"))
    right = (F.col("c") >= (width - 1) / 2.0).cast("long")
    px = labels.join(areas, "label", "left").select("r", "c", F.coalesce(F.col("first") + right, F.lit(BACKGROUND)).cast("long").alias("region_id"))
    two = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.lit("").alias("end")), F.struct(F.lit(1).alias("side"), F.lit("_R").alias("end"))))
    names = areas.select("label", "first", two.alias("s")).select((F.col("first") + F.col("s.side")).cast("long").alias("region_id"), F.concat("label", "s.end").alias("name"))
    ground = labels.sparkSession.createDataFrame([(BACKGROUND, "background")], "region_id long, name string")
    return px, names.unionByName(ground)


def brain_mask(px: DataFrame) -> DataFrame:
    """(r, c): pixels that belong to a region."""
    return px.filter(F.col("region_id") != BACKGROUND).select("r", "c")


def region_mask(px: DataFrame, names: DataFrame, wanted: list[int | str]) -> DataFrame:
    """(r, c) of regions by number or name; what isn't there raises."""
    found = named(names.select(F.col("region_id").alias("node"), "name"), wanted)
    return px.join(found.select(F.col("node").alias("region_id")), "region_id", "left_semi").select("r", "c")


def mask_bits(masks: DataFrame) -> DataFrame:
    """(r, c, bits): which of up to 63 masks (bit, r, c) hold a pixel, as one number; a union of some is a test of their bits."""
    one = F.call_function("shiftleft", F.expr("1L"), F.col("bit").cast("int"))
    return masks.select("r", "c", one.alias("m")).groupBy("r", "c").agg(F.bit_or("m").alias("bits"))


def _turn(degrees: float) -> tuple[float, float]:
    """Cosine and sine, exact at multiples of 90."""
    exact = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}
    return exact.get(degrees % 360) or (math.cos(math.radians(degrees)), math.sin(math.radians(degrees)))


def rotation(spark: SparkSession, shape: tuple[int, int], degrees: float) -> DataFrame:
    """(i, j, from_i, from_j): each place of a rotated plane and the nearest one it comes from, about the centre; places from outside are left out."""
    cos, sin = _turn(degrees)
    (n, m), half = shape, [(s - 1) / 2 for s in shape]
    i, j = F.floor(F.col("id") / m).cast("long"), F.pmod("id", F.lit(m)).cast("long")
    plane = spark.range(n * m).select(i.alias("i"), j.alias("j"))
    back: list[Column] = [cos * F.col("i") + sin * F.col("j") + (half[0] - (cos * half[0] + sin * half[1])), -sin * F.col("i") + cos * F.col("j") + (half[1] - (-sin * half[0] + cos * half[1]))]
    placed = plane.select("i", "j", *(b.alias(k) for b, k in zip(back, ("y", "x"), strict=True)))
    inside = (F.col("y") >= 0) & (F.col("y") <= n - 1) & (F.col("x") >= 0) & (F.col("x") <= m - 1)
    return placed.filter(inside).select("i", "j", F.floor(F.col("y") + 0.5).cast("long").alias("from_i"), F.floor(F.col("x") + 0.5).cast("long").alias("from_j"))


def tilt(voxels: DataFrame, shape: tuple[int, int, int], ap: float = 0.0, ml: float = 0.0, dv: float = 0.0) -> DataFrame:
    """A volume (ap, dv, ml, idx) rotated about its centre in turn about its three axes, nearest voxel, shape kept. Voxels of value 0 needn't be there.

    Each rotation is one equi-join with the index map of its plane; a voxel may go to several places.
    """
    size = dict(zip(("ap", "dv", "ml"), shape, strict=True))
    for degrees, (a, b) in ((ap, ("dv", "ml")), (ml, ("ap", "dv")), (dv, ("ap", "ml"))):
        if degrees:
            where = rotation(voxels.sparkSession, (size[a], size[b]), degrees).withColumnsRenamed({"from_i": a, "from_j": b})
            voxels = voxels.join(where, [a, b]).drop(a, b).withColumnsRenamed({"i": a, "j": b})
    return voxels.select("ap", "dv", "ml", "idx")


def build(voxels: DataFrame, tree: DataFrame, roots: list[int | str], shape: tuple[int, int], to: tuple[int, int], least: int = 15, rows: tuple[float, float] = (0.0, 1.0), cols: tuple[float, float] = (0.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Labels (r, c, region_id) and names of the surface of a volume (ap, dv, ml, idx): structures below ``roots`` of a tree (node, parent, name), named without their layer.

    ``shape``: (ap, ml) of the volume; ``to``: the atlas' rows and columns.
    """
    inside = members(closure(tree), named(tree, roots))
    top = surface(voxels, inside).select(F.col("ap").alias("r"), F.col("ml").alias("c"), "idx")
    base = tree.select(F.col("node").alias("idx"), atlas.without_layer(F.col("name")).alias("label"))
    grid = voxels.sparkSession.range(to[0] * to[1]).select(F.floor(F.col("id") / to[1]).cast("long").alias("r"), F.pmod("id", F.lit(to[1])).alias("c"))
    labels = framed(top.join(base, "idx", "left").select("r", "c", "label"), shape, to, rows, cols)
    return regions(grid.join(labels, ["r", "c"], "left"), to[1], least)


def save(folder: str, labels: DataFrame, names: DataFrame) -> None:
    """An atlas as tables: labels, names, outlines."""
    labels.write.mode("overwrite").parquet(f"{folder}/labels")
    names.write.mode("overwrite").parquet(f"{folder}/names")
    atlas.outline(labels).write.mode("overwrite").parquet(f"{folder}/outlines")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, names and outlines of an atlas that was saved; numbers without a name raise."""
    labels, names, outlines = (spark.read.parquet(f"{folder}/{n}") for n in ("labels", "names", "outlines"))
    lost = [r["region_id"] for r in labels.select("region_id").distinct().join(names, "region_id", "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"regions without a name: {lost}")
    return labels, names, outlines


def newest(files: DataFrame) -> DataFrame:
    """One row: the file (path, size_bytes, mtime) changed last (ties: the greater path), with how many files and bytes there are."""
    return files.agg(F.max(F.struct("mtime", "path"))["path"].alias("path"), F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def nearest(points: list[tuple[float, float]], at: DataFrame) -> DataFrame:
    """For each (id, r, c) of ``at`` the nearest of a person's control points: its place in the list and the squared distance; ties: the first."""
    far = [F.struct(((F.lit(r) - F.col("r")) * (F.lit(r) - F.col("r")) + (F.lit(c) - F.col("c")) * (F.lit(c) - F.col("c"))).alias("d2"), F.lit(i).alias("i")) for i, (r, c) in enumerate(points)]
    return at.select("id", F.array_min(F.array(*far)).alias("n")).select("id", "n.i", "n.d2")
