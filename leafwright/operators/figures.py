"""Figure regions: boxes of a page that lie close together, filtered and numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import checkpoint, per_row

GAP = 30.0
#: Boxes of a page that one task clusters at a time; pages with more go through joins, with the same result.
MOST_BOXES = 4000
#: Rounds of label propagation after which something is wrong; path compression halves the distance each round.
MOST_ROUNDS = 40
CORNERS = ["x0", "y0", "x1", "y1"]


def components(boxes: list[tuple[float, float, float, float]], gap: float) -> list[list[int]]:
    """Places of the boxes of each connected component of boxes at most ``gap`` apart both ways; a sweep from left to right with union-find."""
    root = list(range(len(boxes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    open_: list[int] = []
    for i in sorted(root, key=lambda i: boxes[i][0]):
        x0, y0, _, y1 = boxes[i]
        open_ = [j for j in open_ if x0 - boxes[j][2] <= gap]
        for j in open_:
            if max(y0, boxes[j][1]) - min(y1, boxes[j][3]) <= gap:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        open_.append(i)
    out: dict[int, list[int]] = {}
    for i in range(len(boxes)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def clustered(boxes: DataFrame, keys: list[str], gap: float = GAP) -> DataFrame:
    """keys, x0, y0, x1, y1, n_boxes of the connected components of boxes (box_id, x0, y0, x1, y1) at most ``gap`` apart both ways.

    Boxes with a null coordinate are left out, rows that occur twice count once.  One shuffle brings the boxes of a page
    together; pages of more than MOST_BOXES boxes are clustered by joins within the cells of a grid instead.
    """
    rows = boxes.dropna(subset=CORNERS).select(*keys, "box_id", *[F.col(c).cast("double").alias(c) for c in CORNERS])
    large = checkpoint(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > MOST_BOXES).drop("n"))
    if large.isEmpty():
        return _by_page(rows, keys, gap)
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(large[k])
    return _by_page(rows.join(large, on, "left_anti"), keys, gap).unionByName(_by_joins(rows.join(large, on, "left_semi"), keys, gap))


def _by_page(rows: DataFrame, keys: list[str], gap: float) -> DataFrame:
    pages = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("box_id", *CORNERS))).alias("b"))  # at most MOST_BOXES
    pages = pages.select(*keys, F.col("b.box_id").alias("ids"), *[F.col(f"b.{c}").alias(c) for c in CORNERS])
    pages = pages.withColumn("ids", F.transform("ids", lambda x: x.cast("string")))

    def cluster(ids: list, *corners: list) -> tuple:
        held = {i: b for i, b in zip(ids, zip(*corners))}
        found = list(held.values())
        groups = [[found[i] for i in g] for g in components(found, gap)]
        return [min(b[0] for b in g) for g in groups], [min(b[1] for b in g) for g in groups], [max(b[2] for b in g) for g in groups], [max(b[3] for b in g) for g in groups], [len(g) for g in groups]

    found = per_row(pages, keys, ["ids", *CORNERS], lambda: cluster, [*((f"_{c}", "array<double>") for c in CORNERS), ("_n", "array<int>")])
    each = found.select(*keys, F.explode(F.arrays_zip(*[f"_{c}" for c in CORNERS], "_n")).alias("g"))
    return each.select(*keys, *[F.col(f"g._{c}").alias(c) for c in CORNERS], F.col("g._n").cast("bigint").alias("n_boxes"))


def _by_joins(rows: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Boxes meet only within the same cell of a grid or in neighbouring ones, whose cells are as large as the page's
    largest box; labels are propagated along the pairs that are near."""
    rows = rows.dropDuplicates([*keys, "box_id"])
    cell = rows.groupBy(*keys).agg(F.greatest(F.max(F.col("x1") - F.col("x0")), F.max(F.col("y1") - F.col("y0"))).alias("cell")).withColumn("cell", F.col("cell") + gap + 1.0)
    rows = checkpoint(rows.join(cell, keys).withColumns({"gx": F.floor(F.col("x0") / F.col("cell")), "gy": F.floor(F.col("y0") / F.col("cell"))}))
    a = rows.alias("a")
    around = rows.withColumn("gx", F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1))).withColumn("gy", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1))).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.gx") == F.col("b.gx"), F.col("a.gy") == F.col("b.gy"), F.col("a.box_id") != F.col("b.box_id")]
    near = (F.greatest(F.col("a.x0"), F.col("b.x0")) - F.least(F.col("a.x1"), F.col("b.x1")) <= gap) & (F.greatest(F.col("a.y0"), F.col("b.y0")) - F.least(F.col("a.y1"), F.col("b.y1")) <= gap)
    edges = checkpoint(a.join(around, on).where(near).select(*[F.col(f"a.{k}") for k in keys], F.col("a.box_id").alias("u"), F.col("b.box_id").alias("v")).distinct())
    labels = rows.select(*keys, F.col("box_id").alias("u"), F.col("box_id").alias("root"))
    for _ in range(MOST_ROUNDS):
        other = labels.select(*keys, F.col("u").alias("v"), F.col("root").alias("near"))
        least = edges.join(other, [*keys, "v"]).groupBy(*keys, "u").agg(F.min("near").alias("near"))
        step = labels.join(least, [*keys, "u"], "left").select(*keys, "u", F.least("root", "near").alias("hook"), "root")
        # path compression: the label of one's label
        jump = step.select(*keys, F.col("u").alias("hook"), F.col("hook").alias("far"))
        step = checkpoint(step.join(jump, [*keys, "hook"], "left").select(*keys, "u", F.least("hook", "far").alias("new"), "root"))
        done = step.where("new <> root").limit(1).isEmpty()
        labels = step.select(*keys, "u", F.col("new").alias("root"))
        if done:
            break
    whole = rows.join(labels.withColumnRenamed("u", "box_id"), [*keys, "box_id"])
    return whole.groupBy(*keys, "root").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_boxes")).drop("root")


def figure_regions(regions: DataFrame, width: str, height: str) -> DataFrame:
    """The regions (x0, y0, x1, y1, n_boxes) that may be figures on a page of the given width and height.

    Large enough in points and against the page, of several drawings, and on upright pages not of few drawings in the
    margin at the top or bottom; landscape pages allow for slides.  Regions with equal whole-number corners count once.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    wide = F.col(width) > F.col(height)
    ratio = w * h / (F.col(width) * F.col(height))
    least, most, drawings = F.when(wide, 0.025).otherwise(0.05), F.when(wide, 0.98).otherwise(0.85), F.when(wide, 3).otherwise(5)
    middle = (F.col("y0") + F.col("y1")) / 2
    margin = ~wide & ((middle < 0.1 * F.col(height)) | (middle > 0.9 * F.col(height))) & (F.col("n_boxes") < 20)
    kept = regions.where((w * h >= 6400) & (w >= 50) & (h >= 50) & ratio.between(least, most) & (F.col("n_boxes") >= drawings) & ~margin)
    corners = {f"_{c}": F.col(c).cast("bigint") for c in ("x0", "y0", "x1", "y1")}
    keys = [c for c in regions.columns if c not in ("x0", "y0", "x1", "y1", "n_boxes")]
    return kept.withColumns(corners).dropDuplicates([*keys, *corners]).drop(*corners)


def image_regions(images: DataFrame) -> DataFrame:
    """The images (x0, y0, x1, y1) with enough area and no extreme proportions."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return images.where((w * h >= 6400) & (w / F.greatest(h, F.lit(1.0))).between(0.125, 8.0))


def numbered(figures: DataFrame, doc: str, page: str, per_page: int = 3, per_document: int = 25) -> DataFrame:
    """figures with figure_num: the first per_page of each page by (y0, x0), the first per_document of these by page."""
    order = [F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1")]
    on_page = figures.withColumn("_n", F.row_number().over(W.partitionBy(doc, page).orderBy(*order))).where(F.col("_n") <= per_page)
    return on_page.withColumn("figure_num", F.row_number().over(W.partitionBy(doc).orderBy(page, "_n"))).where(F.col("figure_num") <= per_document).drop("_n")


def whole_page_figures(pages: DataFrame, regions: DataFrame, doc: str, page: str, drawings: int = 10) -> DataFrame:
    """doc, page, x0, y0, x1, y1: on landscape pages (doc, page, width, height, n_drawings) of many drawings without any region one that takes most of the page."""
    slides = pages.where((F.col("width") > F.col("height")) & (F.col("n_drawings") >= drawings)).join(regions.select(doc, page).distinct(), [doc, page], "left_anti")
    at = {"x0": F.col("width") * 0.05, "y0": F.col("height") * 0.15, "x1": F.col("width") * 0.95, "y1": F.col("height") * 0.9}
    return slides.select(doc, page, *[v.alias(k) for k, v in at.items()])


def new_image_regions(images: DataFrame, regions: DataFrame, doc: str, page: str) -> DataFrame:
    """image_regions that aren't among the regions already, by page and whole-number corners; of equal ones the first box_id."""
    corner = [F.col(c).cast("bigint").alias(f"_{c}") for c in CORNERS]
    keys = [doc, page, *(f"_{c}" for c in CORNERS)]
    left = image_regions(images).select("*", *corner).join(regions.select(doc, page, *corner).distinct(), keys, "left_anti")
    rest = [c for c in images.columns if c not in (doc, page)]
    first = left.groupBy(*keys).agg(F.min_by(F.struct(*rest), "box_id").alias("b"))
    return first.select(doc, page, *[F.col(f"b.{c}") for c in rest])


def embedded_images(images: DataFrame, size: str = "size_bytes", least: int = 5000) -> DataFrame:
    """Images embedded in a page (x0, y0, x1, y1, size in bytes) with enough area and bytes and no extreme proportions; equal ones stay."""
    return image_regions(images).where(F.col(size) >= least)
