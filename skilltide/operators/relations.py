"""Undirected relations between professions: readers of two layouts, diagnostics, corpus assembly and table diff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, normalize_title, profession_code

# Columns of the two layouts, and severities.
LEGACY = ("Intitulé emploi actuel", "Code ROME emploi actuel", "Intitulé emploi cible", "Code ROME emploi cible")
TRUTH = ("code_emploi_a", "intitule_emploi_a", "code_emploi_b", "intitule_emploi_b", "similarite")
ERROR, WARNING = "erreur", "avertissement"
DESCRIPTIVE_FILE = r"(?i)^[A-Z]\d{4}\s-\s.+\.pdf$"


def canonical(rows: DataFrame) -> DataFrame:
    """row, code_a, title_a, code_b, title_b, label_text of either layout; ``row`` is the sheet's row number."""
    if set(TRUTH) <= set(rows.columns):
        a, ta, b, tb, label = TRUTH
        text = F.trim(F.col(label).cast("string"))
    else:
        missing = [c for c in LEGACY if c not in rows.columns]
        if missing:
            raise ValueError("missing columns: " + ", ".join(missing))
        ta, a, tb, b = LEGACY
        text = F.lit(None).cast("string")
    return rows.select("row", profession_code(F.col(a)).alias("code_a"), clean(F.col(ta)).alias("title_a"), profession_code(F.col(b)).alias("code_b"), clean(F.col(tb)).alias("title_b"), text.alias("label_text"))


def _pairs(c: DataFrame) -> DataFrame:
    p = c.where("code_a is not null and code_b is not null").withColumns({"lo": F.least("code_a", "code_b"), "hi": F.greatest("code_a", "code_b")})
    # The first row of a pair comes from an aggregation, so a pair repeated very often is not sorted in one task
    first = p.where("lo != hi").groupBy("lo", "hi").agg(F.min("row").alias("first_row"))
    return p.join(first, ["lo", "hi"], "left")


def edges(rows: DataFrame) -> DataFrame:
    """code_a < code_b, label: one row for each undirected pair, labelled by its first row; an invalid label gives no edge."""
    truth = set(TRUTH) <= set(rows.columns)
    p = _pairs(canonical(rows)).where("lo != hi and row = first_row")
    label = F.when(F.col("label_text") == "Oui", True).when(F.col("label_text") == "Non", False) if truth else F.lit(True)
    return p.select(F.col("lo").alias("code_a"), F.col("hi").alias("code_b"), label.alias("label")).where("label is not null")


def titles(rows: DataFrame) -> DataFrame:
    """code, titles (different, sorted) and the number of titles that differ after normalisation."""
    c = canonical(rows)
    t = c.select(F.col("code_a").alias("code"), F.col("title_a").alias("title")).union(c.select("code_b", "title_b")).where("code is not null and title != ''")
    t = t.withColumn("normal", normalize_title(F.col("title")))
    return t.groupBy("code").agg(F.array_sort(F.collect_set("title")).alias("titles"), F.countDistinct("normal").alias("n_titles"))


def relation_diagnostics(rows: DataFrame) -> DataFrame:
    """severity, code, subject, row of everything wrong with either layout."""
    truth = set(TRUTH) <= set(rows.columns)
    c, p = canonical(rows), _pairs(canonical(rows))
    level = ERROR if truth else WARNING

    def found(frame: DataFrame, severity: str, code: str, subject) -> DataFrame:
        return frame.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.alias("subject"), F.col("row").cast("long").alias("row"))

    none = F.lit(None).cast("string")
    parts = []
    for x in "ab":
        parts.append(found(c.where(f"code_{x} is null"), ERROR, "code_manquant", none))
        parts.append(found(c.where(f"code_{x} is not null and coalesce(title_{x}, '') = ''"), ERROR, "intitule_manquant", F.col(f"code_{x}")))
    parts.append(found(p.where("lo = hi"), level, "relation_reflexive", F.col("code_a")))
    parts.append(found(p.where("lo != hi and row > first_row"), level, "doublon_relation", F.col("code_a")))
    if truth:
        parts.append(found(c.where("coalesce(label_text, '') not in ('Oui', 'Non')"), ERROR, "similarite_invalide", none))
    odd = titles(rows).where("n_titles > 1").withColumn("row", F.lit(None).cast("long"))
    parts.append(found(odd, WARNING, "incoherence_code_intitule", F.col("code")))
    return reduce(DataFrame.unionByName, parts)


def codes(edge_table: DataFrame) -> DataFrame:
    return edge_table.select(F.col("code_a").alias("code")).union(edge_table.select("code_b")).distinct()


def corpus(relation_codes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus rows and diagnostics.

    ``relation_codes`` (code, intitule); ``files`` (file, code, file_code, title, competences array): of several
    files of a code the one with a descriptive name is taken if it is the only one, else the first by name, with an error.
    """
    f = files.where("code is not null").withColumn("descriptive", F.col("file").rlike(DESCRIPTIVE_FILE))
    facts = f.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if("descriptive").alias("n_d"), F.min("file").alias("first"), F.min(F.when(F.col("descriptive"), F.col("file"))).alias("first_d"), F.max(F.coalesce(F.col("file_code") != F.col("code"), F.lit(False))).alias("mismatch"))
    facts = facts.withColumn("file", F.when((F.col("n") > 1) & (F.col("n_d") == 1), F.col("first_d")).otherwise(F.col("first")))
    taken = facts.join(f.select("code", "file", "title", "competences"), ["code", "file"])
    j = relation_codes.join(taken, "code", "left")
    status = F.when(F.col("file").isNull(), "pdf_manquant").when(F.size("competences") == 0, "competences_absentes").when(F.col("mismatch"), "code_pdf_incoherent").otherwise("valide")
    rows = j.select(F.col("code").alias("code_rome"), "intitule", F.coalesce(F.array_join("competences", "\n"), F.lit("")).alias("competences"), F.coalesce(F.size("competences"), F.lit(0)).alias("nombre_competences"), status.alias("statut_validation_pdf"), F.col("file").alias("fichier_pdf"))

    def found(frame: DataFrame, severity: str, code: str, subject: str = "code", source: str = "file") -> DataFrame:
        return frame.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(subject).alias("subject"), F.col(source).alias("source"))

    differing = j.where("title is not null").where(normalize_title(F.col("title")) != normalize_title(F.col("intitule")))
    parts = [
        found(files.where("code is null"), ERROR, "code_pdf_absent"), found(files.where("file_code is not null and file_code != code"), ERROR, "code_pdf_incoherent"),
        found(facts.where("n > 1 and n_d = 1"), WARNING, "pdf_duplique_nom_descriptif_retenu"), found(facts.where("n > 1 and n_d != 1"), ERROR, "pdf_duplique"),
        found(j.where("file is null"), ERROR, "pdf_manquant"), found(j.where("file is not null and size(competences) = 0"), ERROR, "competences_absentes"),
        found(differing, WARNING, "intitule_pdf_different"), found(taken.join(relation_codes, "code", "left_anti"), WARNING, "pdf_code_non_reference"),
    ]
    return rows, reduce(DataFrame.unionByName, parts)


def prepared_skills(corpus_rows: DataFrame) -> DataFrame:
    """code, skill_pos, skill of a corpus that is valid throughout, with different codes and a skill each; else ValueError."""
    facts = corpus_rows.agg(F.count_if(F.col("statut_validation_pdf") != "valide").alias("bad"), F.count("code_rome").alias("n"), F.countDistinct("code_rome").alias("d")).first()
    if facts.bad:
        raise ValueError("the corpus is not valid throughout")
    if facts.n != facts.d:
        raise ValueError("a code is repeated in the corpus")
    lines = F.filter(F.transform(F.split(F.coalesce("competences", F.lit("")), r"\R|[\x1c-\x1e]"), lambda x: F.trim(x)), lambda x: x != "")
    if not corpus_rows.where(F.size(lines) == 0).isEmpty():
        raise ValueError("a code has no skill")
    return corpus_rows.select(F.col("code_rome").alias("code"), "intitule", F.posexplode(lines).alias("skill_pos", "skill"))


def fingerprint(skills: DataFrame) -> DataFrame:
    """One SHA-256 over all lines ``code TAB skill`` in order (a corpus identity: its lines meet in one value by definition)."""
    line = F.concat_ws("\t", "code", "skill")
    all_lines = F.array_sort(F.collect_list(F.struct("code", "skill_pos", line.alias("line"))))
    return skills.agg(F.sha2(F.array_join(F.transform(all_lines, lambda x: x["line"]), "\n"), 256).alias("fingerprint"))


def table_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """changement (ajoutee, supprimee, conservee), code_a, code_b of two undirected edge tables, by one full join."""
    o, n = (x.select(F.least("code_a", "code_b").alias("code_a"), F.greatest("code_a", "code_b").alias("code_b")).where("code_a != code_b").distinct().withColumn(k, F.lit(True)) for x, k in ((old, "o"), (new, "n")))
    change = F.when(F.col("o").isNull(), "ajoutee").when(F.col("n").isNull(), "supprimee").otherwise("conservee")
    return o.join(n, ["code_a", "code_b"], "full_outer").select(change.alias("changement"), "code_a", "code_b")


def unknown_codes(edge_table: DataFrame, corpus_codes: DataFrame) -> DataFrame:
    """Codes of relations that the corpus lacks: must be empty before a campaign."""
    return codes(edge_table).join(corpus_codes.select("code"), "code", "left_anti")
