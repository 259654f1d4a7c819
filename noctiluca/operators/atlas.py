"""The map's points with their recommendations, and the site's payload."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca import schema
from noctiluca.functions import text
from noctiluca.operators.explore import min_max_scale
from noctiluca.operators.stats import legend, site_stats

TEMPLATE = """<!doctype html><meta charset="utf-8"><title>Atlas</title><script src="data.js"></script>
<body><h1 id="t"></h1><p id="s"></p><ul id="l"></ul><script>
document.getElementById("t").textContent = ATLAS.title;
document.getElementById("s").textContent = ATLAS.stats.papers + " papers in " + ATLAS.stats.categories + " categories";
for (const [k, n] of Object.entries(ATLAS.counts)) { const e = document.createElement("li"); e.textContent = k + ": " + n; e.style.color = ATLAS.colors[k]; document.getElementById("l").append(e); }
</script></body>
"""


def atlas_points(papers: DataFrame, positions: DataFrame, nested: DataFrame) -> DataFrame:
    """(id, x, y, title, abstract, category, authors, published, url, color, recommendations): positions scaled to [0, 1],
    papers without a position left out, missing recommendations an empty list."""
    scaled = min_max_scale(positions).select("id", "x", "y")
    points = papers.join(scaled, papers["paper_id"] == scaled["id"]).withColumn("color", text.lookup(F.col("category"), schema.COLORS, schema.DEFAULT_COLOR))
    joined = points.join(nested.withColumnRenamed("src_id", "id"), "id", "left")
    empty = F.array().cast(nested.schema["recommendations"].dataType)
    return joined.select("id", "x", "y", "title", "abstract", "category", "authors", "published", "url", "color", F.coalesce("recommendations", empty).alias("recommendations"))


def write_site(points: DataFrame, folder: str, stamp: str, title: str = "Paper atlas", projection: str = "UMAP") -> Path:
    """Write data.js and index.html. The points are streamed from the executors one partition at a time and written as
    they come; the driver holds no more than that."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    stats = site_stats(points, stamp, projection).first().asDict()
    rows = legend(points).collect()
    with (out / "data.js").open("w", encoding="utf-8") as f:
        head = {"title": title, "stats": stats, "colors": {r["label"]: r["color"] for r in rows}, "counts": {r["label"]: r["n"] for r in rows}}
        f.write("window.ATLAS = " + json.dumps(head, ensure_ascii=False)[:-1] + ', "points": [')
        for i, r in enumerate(points.orderBy("id").select(F.to_json(F.struct(*points.columns)).alias("j")).toLocalIterator()):
            f.write((",\n" if i else "\n") + r["j"])
        f.write("\n]};\n")
    (out / "index.html").write_text(TEMPLATE, encoding="utf-8")
    return out / "index.html"
