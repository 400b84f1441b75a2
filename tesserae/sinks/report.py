"""Small results as text or JSON, and whether there are any."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render(sections: DataFrame) -> str:
    """A report of sections (pos, header, body) in order. Reports are bounded by their token budget."""
    rows = sections.orderBy("pos").select("header", "body").collect()
    return "\n\n".join((f"## {h}\n\n" if h else "") + b.strip() for h, b in rows) + "\n"


def write_inside(folder: str, name: str, content: str) -> Path:
    """Writes a file below a folder; names that lead out of it are refused."""
    root = Path(folder).resolve()
    path = (root / name).resolve()
    if not path.is_relative_to(root):
        raise ValueError(f"{name} is outside {folder}")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return path


def json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def exit_code(findings: DataFrame) -> int:
    """1 if there are findings, else 0; stops at the first row."""
    return 0 if findings.isEmpty() else 1
