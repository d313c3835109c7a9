"""Sinks: corpus, blocks, results and metrics as Parquet, with JSONL and CSV exports, and reports."""

from __future__ import annotations

import html
import json
import os
import tempfile

from pyspark.sql import DataFrame, functions as F


def write_corpus(df: DataFrame, path: str, order: str = "seq") -> None:
    """The corpus in order: ranges of the order become files, sorted inside."""
    df.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").parquet(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys sorted."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Packed blocks, a folder a split, so that a reader of one split reads nothing else."""
    blocks.write.mode("overwrite").partitionBy("split").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def layer_csv(tables: list[DataFrame], path: str) -> None:
    """Rows of several tables under the sorted union of their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    export_csv(out.select(*sorted(out.columns)), path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metric rows to the append-only table, partitioned for the filters of reports; an empty batch writes nothing."""
    if not rows.isEmpty():
        rows.write.mode("append").partitionBy("stage").parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Events of artifacts to their append-only table; an empty batch writes nothing."""
    if not rows.isEmpty():
        rows.write.mode("append").partitionBy("event_type").parquet(path)


def write_json(value, path: str) -> None:
    """A small driver file, written whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def line_chart(points: list[tuple[float, float]], title: str, width: int = 640, height: int = 200) -> str:
    """A small aggregated series as an SVG line."""
    points = sorted((x, y) for x, y in points if y is not None and y == y and abs(y) != float("inf"))
    if not points:
        return f"<svg width='{width}' height='{height}'><title>{html.escape(title)}</title></svg>"
    (x0, x1), ys = (points[0][0], points[-1][0]), [y for _, y in points]
    lo, hi = min(ys), max(ys)
    at = lambda x, y: f"{(x - x0) / ((x1 - x0) or 1) * width:.1f},{height - (y - lo) / ((hi - lo) or 1) * height:.1f}"
    return f"<svg width='{width}' height='{height}'><title>{html.escape(title)}</title><polyline fill='none' stroke='black' points='{' '.join(at(x, y) for x, y in points)}'/></svg>"


def markdown_summary(title: str, rows: list[dict]) -> str:
    """A table of a few aggregated rows."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    head = list(rows[0])
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(r[h]) for h in head) + " |" for r in rows)]) + "\n"
