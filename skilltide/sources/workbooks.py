"""Job rows from files: CSV and Parquet as tables, workbooks by an Arrow adapter where a reader is installed."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SHEET
from ..operators.validation import MISSING_COLUMN, Finding, InvalidInput, require_valid

COLUMNS = "emploi_id string, emploi_intitule string, emploi_type string, emploi_effectif double, competence_id string, competence_intitule string, competence_description string, competence_niveau double"
CORPUS = "code_rome string, intitule string, competences string, nombre_competences int, statut_validation_pdf string, fichier_pdf string"


def _csv_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), "content")


def read_csv(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Rows of every CSV file under ``path``, with the file's name and the sheet's row number (2 is the first).

    Columns are found by their names in each file's own header; one that a file lacks is null
    there and named by :func:`csv_headers`. Levels and headcounts that are no numbers are null.
    """
    kinds = dict(c.split() for c in COLUMNS.split(", "))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                rows = list(csv.DictReader(io.StringIO(bytes(content).decode("utf-8-sig"), newline="")))
                out = {c: pd.Series([r.get(c) or None for r in rows], dtype=object) for c in kinds}
                for c in (c for c, kind in kinds.items() if kind == "double"):
                    out[c] = pd.to_numeric(out[c], errors="coerce").astype(float)
                yield pd.DataFrame(out | {"file": pd.Series([name] * len(rows), dtype=object), "row": range(2, len(rows) + 2)})

    return _csv_files(spark, path, glob).mapInPandas(run, f"{COLUMNS}, file string, row long")


def csv_headers(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """file, columns, n_rows of every CSV file: what :func:`column_diagnostics` judges."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                rows = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""))
                header = next(rows, [])
                yield pd.DataFrame({"file": pd.Series([name], dtype=object), "columns": [header], "n_rows": [sum(1 for r in rows if r)]})

    return _csv_files(spark, path, glob).mapInPandas(run, "file string, columns array<string>, n_rows long")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus CSV, its columns found by name: skills are parted by line breaks inside a cell."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    kinds = dict(c.split() for c in CORPUS.split(", "))
    absent = [c for c in kinds if c not in rows.columns]
    if absent:
        raise InvalidInput([Finding(path, None, c, MISSING_COLUMN) for c in absent])
    return rows.select(*(F.expr(f"try_cast({c} as {kind})").alias(c) for c, kind in kinds.items()))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the sheet of every .xlsx file under ``path``; needs a workbook reader on the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                sheets = pd.read_excel(io.BytesIO(content), sheet_name=None)
                if SHEET not in sheets:
                    raise ValueError(f"{name}: no sheet {SHEET}")
                sheet = sheets[SHEET].reindex(columns=names)
                yield sheet.assign(file=name, row=range(2, len(sheet) + 2))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, f"{COLUMNS}, file string, row long")


def read_jobs(rows: DataFrame, expected_role: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs, skills) of valid rows, one job a file; else InvalidInput with every diagnostic."""
    require_valid(rows, expected_role)
    key = F.xxhash64("file")
    jobs = rows.groupBy("file").agg(F.min_by(F.struct("emploi_id", "emploi_intitule", "emploi_type", "emploi_effectif"), "row").alias("j"))
    jobs = jobs.select(key.alias("job_id"), key.alias("ord"), F.col("j.emploi_type").alias("role"), F.col("j.emploi_intitule").alias("intitule"), F.col("j.emploi_effectif").cast("int").alias("effectif"), F.col("file").alias("source"))
    skills = rows.select(key.alias("job_id"), (F.col("row") - 2).alias("pos"), F.nullif(F.trim("competence_id"), F.lit("")).alias("skill_id"), F.col("competence_intitule").alias("intitule"), F.nullif(F.trim("competence_description"), F.lit("")).alias("description"), F.col("competence_niveau").cast("int").alias("niveau"))
    return jobs, skills


def read_pair(current: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two files with imposed roles."""
    a, c = read_jobs(current, "actuel"), read_jobs(target, "cible")
    return a[0].unionByName(c[0]), a[1].unionByName(c[1])


__all__ = ["InvalidInput", "csv_headers", "read_corpus", "read_csv", "read_jobs", "read_pair", "read_workbooks"]
