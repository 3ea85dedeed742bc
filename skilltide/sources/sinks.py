"""Sinks: CSV tables, one CSV with a byte order mark, run metadata and Markdown reports, in directories that are never overwritten."""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


def campaign_directory(root: str, name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError("a campaign's name holds letters, digits, '_' and '-' only")
    return f"{root.rstrip('/')}/{name}"


def write_csv(frame: DataFrame, path: str) -> None:
    """Distributed CSV; an existing directory is an error."""
    frame.write.mode("errorifexists").csv(path, header=True, encoding="UTF-8", escape='"')


def csv_text(frame: DataFrame, mark: bool = False) -> bytes:
    """A small result as one CSV; ``mark`` puts the byte order mark that spreadsheets look for."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(frame.columns)
    writer.writerows(frame.toLocalIterator())
    return (codecs.BOM_UTF8 if mark else b"") + out.getvalue().encode()


def write_metadata(spark, values: Mapping[str, object], path: str) -> None:
    line = spark.createDataFrame([(json.dumps(values, ensure_ascii=False, sort_keys=True, default=str),)], "value string")
    line.coalesce(1).write.mode("errorifexists").text(path)


def markdown_table(frame: DataFrame, most: int = 1000) -> str:
    """A small report table; more than ``most`` rows are refused rather than cut."""
    rows = frame.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows belongs in a table")
    cells = [[*frame.columns], ["---"] * len(frame.columns), *([("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(c) + " |" for c in cells)


def campaign_report(title: str, best: DataFrame, errors: DataFrame) -> str:
    """Best configuration, then false positives and false negatives by falling coverage."""
    parts = [f"# {title}", "", "## Meilleure configuration", "", markdown_table(best)]
    for kind, name in (("FP", "Faux positifs"), ("FN", "Faux négatifs")):
        parts += ["", f"## {name}", "", markdown_table(errors.where(F.col("erreur") == kind).orderBy("rang"))]
    return "\n".join(parts) + "\n"


def table_diff_report(diff: DataFrame, blocking: bool) -> str:
    names = (("ajoutee", "Relations ajoutées"), ("supprimee", "Relations supprimées"), ("conservee", "Relations conservées"))
    parts = ["# Comparaison des tables de référence"]
    for kind, name in names:
        rows = diff.where(F.col("changement") == kind).orderBy("code_a", "code_b")
        lines = [f"- {r.code_a} — {r.code_b}" for r in rows.toLocalIterator()]
        parts += ["", f"## {name}", "", *(lines or ["- Aucune."])]
    return "\n".join([*parts, "", "## Décision", "", "BLOQUANT" if blocking else "VALIDE"]) + "\n"
