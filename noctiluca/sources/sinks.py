"""Small results to files: metrics, folders, models, counters."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

log = logging.getLogger("noctiluca")
FOLDERS = ("figures", "metrics", "models", "site")


def make_folders(root: str) -> list[Path]:
    made = [Path(root) / f for f in FOLDERS]
    for p in made:
        p.mkdir(parents=True, exist_ok=True)
    return made


def save_json(data: dict | list, path: str) -> Path:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return out


def save_metrics(rows: DataFrame, path: str, most: int = 10_000) -> Path:
    """A small table of metrics as JSON; a table that isn't small raises."""
    got = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no metrics")
    return save_json(got, path)


def save_model(model: PipelineModel, path: str, metadata: dict | None = None) -> None:
    """A fitted model (its label names are part of it), overwriting, with a note of how it was made."""
    model.write().overwrite().save(path)
    if metadata is not None:
        save_json(metadata, f"{path}.json")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def report(title: str, rows: DataFrame, most: int = 20) -> None:
    log.info(title)
    for r in rows.limit(most).collect():
        log.info("  %s", r.asDict())
