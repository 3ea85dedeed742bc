"""Row diagnostics of workbook rows, for any number of files at once.

Input: ``file``, ``row`` (the sheet's row number: 2 is the first) and the sheet's
columns. All rules run in one pass and their findings are one DataFrame; only
:func:`require_valid` raises, with all of them together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import REQUIRED_COLUMNS, ROLES


class Finding(NamedTuple):
    file: str | None
    row: int | None
    column: str
    rule: str


class InvalidInput(ValueError):
    """All diagnostics of an input that was refused."""

    def __init__(self, diagnostics: list):
        self.diagnostics = diagnostics
        super().__init__("; ".join(f"{d.file} row {d.row} {d.column}: {d.rule}" for d in diagnostics))


# Texts of the rules.
MISSING_COLUMN = "colonne obligatoire absente"
EMPTY_SHEET = "le fichier doit contenir au moins une compétence"
TEXT_RULE = "valeur texte obligatoire; une valeur composée uniquement d'espaces est vide"
ROLE_RULE = "valeur exacte attendue: 'actuel' ou 'cible'"
LEVEL_RULE = "entier obligatoire compris entre 1 et 4"
CONSTANT_RULE = "la valeur doit être identique sur toutes les lignes du fichier"
POSITIVE_RULE = "entier strictement positif obligatoire pour un emploi actuel"
INTEGER_RULE = "la valeur renseignée doit être un entier"
ALL_OR_NONE_RULE = "pour une cible, l'effectif doit être vide partout ou renseigné partout"


def as_integer(value: Column, kind: str) -> Column:
    """Whole numbers of numeric columns; text and booleans are no integers."""
    if kind in ("string", "boolean"):
        return F.lit(None).cast("long")
    number = value.cast("double")
    return F.when(number == F.floor(number), number.cast("long"))


def missing_columns(frame: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in frame.columns]


def _blank(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit(""))) == ""


def column_diagnostics(headers: DataFrame) -> DataFrame:
    """file, row, column, rule: required columns that a file's header lacks (file, columns), and files without rows (n_rows)."""
    required = F.array(*map(F.lit, REQUIRED_COLUMNS))
    lacking = headers.select("file", F.lit(None).cast("long").alias("row"), F.explode(F.array_except(required, "columns")).alias("column"), F.lit(MISSING_COLUMN).alias("rule"))
    empty = headers.where("n_rows = 0").select("file", F.lit(None).cast("long").alias("row"), F.lit("competence_intitule").alias("column"), F.lit(EMPTY_SHEET).alias("rule"))
    return lacking.unionByName(empty)


def job_diagnostics(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """job_id, rule of jobs that no plan may start with: another role, or no skill; and roles that nobody has (null job_id)."""
    odd = jobs.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).select("job_id", F.lit(ROLE_RULE).alias("rule"))
    bare = jobs.join(skills.select("job_id").distinct(), "job_id", "left_anti").select("job_id", F.lit(EMPTY_SHEET).alias("rule"))
    seen = jobs.agg(*(F.count_if(F.col("role") == r).alias(r) for r in ROLES))
    none = seen.select(F.explode(F.array_compact(F.array(*(F.when(F.col(r) == 0, F.lit(f"aucun emploi de type '{r}'")) for r in ROLES)))).alias("rule"))
    return odd.unionByName(bare).unionByName(none.select(F.lit(None).cast("long").alias("job_id"), "rule"))


def require_jobs(jobs: DataFrame, skills: DataFrame) -> None:
    """The guard before the plan: :class:`InvalidInput` where :func:`job_diagnostics` finds anything."""
    found = job_diagnostics(jobs, skills).take(1000)
    if found:
        raise InvalidInput([Finding(None if d.job_id is None else str(d.job_id), None, "emploi", d.rule) for d in found])


def row_diagnostics(rows: DataFrame, expected_role: str | None = None) -> DataFrame:
    """file, row, column, rule for every broken rule of a single row."""
    kinds = dict(rows.dtypes)

    def finding(bad: Column, column: str, rule: str) -> Column:
        return F.when(bad, F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule")))

    role = F.col("emploi_type").cast("string")
    level = as_integer(F.col("competence_niveau"), kinds["competence_niveau"])
    found = [finding(_blank(F.col(c)), c, TEXT_RULE) for c in ("emploi_intitule", "competence_intitule")]
    found.append(finding(~F.coalesce(role.isin(*ROLES), F.lit(False)), "emploi_type", ROLE_RULE))
    found.append(finding(~F.coalesce(level.between(1, 4), F.lit(False)), "competence_niveau", LEVEL_RULE))
    if expected_role:
        found.append(finding((F.col("row") == 2) & role.isin(*ROLES) & (role != expected_role), "emploi_type", f"ce fichier doit décrire un emploi de type '{expected_role}'"))
    return rows.select("file", "row", F.explode(F.array_compact(F.array(*found))).alias("d")).select("file", "row", "d.*")


def _first(column: Column, when: Column | None = None) -> Column:
    """Value of a file's first row (of those that ``when`` admits)."""
    at = F.struct("row", column.alias("v"))
    return F.min(F.when(when, at) if when is not None else at)


def constant_diagnostics(rows: DataFrame, columns: tuple[str, ...] = ("emploi_intitule", "emploi_type")) -> DataFrame:
    """Rows that differ from their file's first row; only of columns that are valid on every row of the file.

    Each file is summed up by a partial aggregation and joined back; no file is sorted in one task.
    """
    good = {c: F.col(c).isin(*ROLES) if c == "emploi_type" else ~_blank(F.col(c)) for c in columns}
    facts = rows.groupBy("file").agg(*(_first(F.col(c)).alias(f"f_{c}") for c in columns), *(F.min(F.coalesce(good[c], F.lit(False))).alias(f"ok_{c}") for c in columns))
    j = rows.join(facts, "file")
    found = [F.when(F.col(f"ok_{c}") & (F.col(c) != F.col(f"f_{c}.v")), F.lit(c)) for c in columns]
    return j.select("file", "row", F.explode(F.array_compact(F.array(*found))).alias("column")).withColumn("rule", F.lit(CONSTANT_RULE))


def headcount_diagnostics(rows: DataFrame) -> DataFrame:
    """Rules of ``emploi_effectif``: positive and constant for current jobs, all or none for targets."""
    kind = dict(rows.dtypes)["emploi_effectif"]
    value = F.col("emploi_effectif")
    absent = value.isNull() | (F.isnan(value) if kind in ("double", "float") else F.lit(False))
    r = rows.select("file", "row", F.col("emploi_type").alias("role"), absent.alias("absent"), as_integer(value, kind).alias("n"))
    r = r.withColumn("n", F.when(~F.col("absent"), F.col("n")))
    role = r.groupBy("file").agg(_first(F.col("role")).alias("r"), F.count_if("absent").alias("absents"), F.count(F.lit(1)).alias("rows")).select("file", F.col("r.v").alias("file_role"), "absents", "rows")
    r = r.join(role, "file")
    kept = F.col("n").isNotNull() & ~((F.col("file_role") == "actuel") & (F.col("n") <= 0))
    first = r.groupBy("file").agg(F.min(F.when(kept, F.struct("row", "n"))).alias("f"), F.count_if(kept).alias("kept"))
    r = r.join(first, "file")
    current, mixed = F.col("file_role") == "actuel", (F.col("file_role") == "cible") & (F.col("absents") != F.col("rows"))
    found = [
        F.when(F.col("absent") & current, POSITIVE_RULE), F.when(~F.col("absent") & F.col("n").isNull(), INTEGER_RULE), F.when(F.col("n").isNotNull() & current & (F.col("n") <= 0), POSITIVE_RULE),
        F.when(F.col("absent") & mixed, ALL_OR_NONE_RULE), F.when((F.col("kept") > 1) & F.col("n").isNotNull() & (F.col("n") != F.col("f.n")), CONSTANT_RULE),
    ]
    return r.select("file", "row", F.lit("emploi_effectif").alias("column"), F.explode(F.array_compact(F.array(*found))).alias("rule"))


def diagnostics(rows: DataFrame, expected_role: str | None = None) -> DataFrame:
    return row_diagnostics(rows, expected_role).unionByName(constant_diagnostics(rows)).unionByName(headcount_diagnostics(rows))


def require_valid(rows: DataFrame, expected_role: str | None = None) -> DataFrame:
    """``rows`` if nothing is wrong with them; else :class:`InvalidInput` with every diagnostic (at the API's edge only)."""
    absent = missing_columns(rows)
    if absent:
        raise InvalidInput([Finding(None, None, c, MISSING_COLUMN) for c in absent])
    if rows.isEmpty():
        raise InvalidInput([Finding(None, None, "competence_intitule", EMPTY_SHEET)])
    found = diagnostics(rows, expected_role).orderBy("file", "row", "column").collect()
    if found:
        raise InvalidInput(found)
    return rows


def supplied_matches(matches: DataFrame, target_skills: DataFrame, current_skills: DataFrame) -> DataFrame:
    """What is wrong with supplied matches (job_id_a, job_id_c, pos_a, pos_c): a target skill without a match, with several, unknown ones, and current skills of another job."""
    keys = ["job_id_c", "pos_c"]
    t = target_skills.select(F.col("job_id").alias("job_id_c"), F.col("pos").alias("pos_c"))
    n = matches.groupBy(*keys, "job_id_a").agg(F.count(F.lit(1)).alias("n"))
    jobs = matches.select("job_id_a", "job_id_c").distinct()
    lacking = jobs.join(t, "job_id_c").join(n, [*keys, "job_id_a"], "left_anti").select("job_id_a", *keys, F.lit("absente").alias("rule"))
    double = n.where("n > 1").select("job_id_a", *keys, F.lit("dupliquée").alias("rule"))
    extra = n.join(t, keys, "left_anti").select("job_id_a", *keys, F.lit("inconnue").alias("rule"))
    c = current_skills.select(F.col("job_id").alias("job_id_a"), F.col("pos").alias("pos_a"))
    foreign = matches.where("pos_a is not null").join(c, ["job_id_a", "pos_a"], "left_anti").select("job_id_a", *keys, F.lit("compétence actuelle étrangère").alias("rule"))
    return lacking.unionByName(double).unionByName(extra).unionByName(foreign)
