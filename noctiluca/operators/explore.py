"""What the explorer does with the map: filters, keyword search, view arithmetic, nearest point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions import text


def in_categories(df: DataFrame, active: list[str]) -> DataFrame:
    """Records of the active categories; an empty set means all."""
    return df.where(F.col("category").isin(*active)) if active else df


def matches(query: str) -> Column:
    """Whether every term of a query stands in title, abstract, authors or category; an empty query matches all."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract", "authors", "category")]))
    found = F.lit(True)
    for term in query.lower().split():
        found = found & F.contains(hay, F.lit(term))
    return found


def search(df: DataFrame, query: str = "", active: list[str] | None = None) -> DataFrame:
    return in_categories(df, active or []).where(matches(query))


def result_list(found: DataFrame, limit: int = schema.RESULT_LIMIT) -> DataFrame:
    """The first results in id order: a top-k, not a sort of everything."""
    return found.orderBy("paper_id").limit(limit)


def result_summary(df: DataFrame, query: str, active: list[str] | None = None) -> DataFrame:
    inside = F.col("category").isin(*active) if active else F.lit(True)
    return df.agg(F.count_if(F.coalesce(inside & matches(query), F.lit(False))).alias("matched"), F.count("*").alias("total"))


def selection(df: DataFrame, selected: int, query: str, active: list[str] | None = None) -> DataFrame:
    """The selected id if it is among the results, else the first of them."""
    return search(df, query, active).agg(F.coalesce(F.max(F.when(F.col("paper_id") == selected, F.col("paper_id"))), F.min("paper_id")).alias("selected"))


def min_max_scale(df: DataFrame, columns: tuple[str, ...] = ("x", "y"), floor: float = 1e-9) -> DataFrame:
    """Each column scaled to [0, 1] over its span, which counts as ``floor`` at least. The bounds are one row."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_lo_{c}")) / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(floor)))
    return out.drop(*bounds.columns)


def view_position(df: DataFrame, width: float, height: float, zoom: float = 1.0, pan_x: float = 0.0, pan_y: float = 0.0, focus: bool = False, pad: float = 28.0) -> DataFrame:
    """df with px, py: where a point of the unit square stands on a canvas; y runs downwards, zoom is kept in [0.7, 6],
    and with ``focus`` the points with is_match move towards the centre by 0.82."""
    zoom = min(6.0, max(0.7, zoom))
    w, h = max(1.0, width - 2 * pad), max(1.0, height - 2 * pad)
    cx, cy = width / 2, height / 2
    pull = F.when(F.col("is_match"), F.lit(0.82)).otherwise(F.lit(1.0)) if focus else F.lit(1.0)
    at = lambda base, centre, pan: centre + (base - centre) * pull * zoom + pan
    return df.withColumn("px", at(pad + F.col("x") * w, cx, pan_x)).withColumn("py", at(pad + (1 - F.col("y")) * h, cy, pan_y))


def nearest_points(probes: DataFrame, points: DataFrame, radius: float = 16.0, cell: float = 28.0) -> DataFrame:
    """(probe_id, point_id, distance): the nearest point closer than ``radius`` of each probe (probe_id, mx, my); ties by
    lower id; probes without one are left out. A range join by grid cell: as radius < cell, the nine cells around a probe
    hold all candidates, and the join is an equi-join."""
    if radius > cell:
        raise ValueError("the radius must not exceed the cell")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = probes.withColumn("_n", around).select("probe_id", "mx", "my", (F.floor(F.col("mx") / cell) + F.col("_n.i")).alias("gx"), (F.floor(F.col("my") / cell) + F.col("_n.j")).alias("gy"))
    right = points.select(F.col("id").alias("point_id"), "px", "py", F.floor(F.col("px") / cell).alias("gx"), F.floor(F.col("py") / cell).alias("gy"))
    dx, dy = F.col("mx") - F.col("px"), F.col("my") - F.col("py")
    near = left.join(right, ["gx", "gy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") < radius)
    return near.groupBy("probe_id").agg(F.min(F.struct("distance", "point_id")).alias("best")).select("probe_id", F.col("best.point_id").alias("point_id"), F.round("best.distance", 6).alias("distance"))


def colours(df: DataFrame, label: str = "category") -> DataFrame:
    """df with color, by a broadcast join with the palette (its size is fixed) and a default."""
    palette = df.sparkSession.createDataFrame(list(schema.COLORS.items()), f"{label} string, color string")
    return df.join(F.broadcast(palette), label, "left").withColumn("color", F.coalesce("color", F.lit(schema.DEFAULT_COLOR)))


def dates_shown(df: DataFrame) -> DataFrame:
    return df.withColumn("date_shown", text.display_date(F.col("published")))


def previews(points: DataFrame, count: int = 6) -> DataFrame:
    """(id, preview): the first recommended ids of each point that has recommendations."""
    return points.where("recommendations is not null").select("id", F.transform(F.slice("recommendations", 1, count), lambda r: r["id"]).alias("preview"))


def recommendation_links(points: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, rec_id, known, title): every recommendation of every point with the title of the record it leads to."""
    recs = points.select("id", F.explode("recommendations").alias("r")).select("id", F.col("r.id").alias("rec_id"))
    return recs.join(papers.select("paper_id", "title"), F.col("rec_id") == F.col("paper_id"), "left").select("id", "rec_id", F.col("paper_id").isNotNull().alias("known"), "title")
