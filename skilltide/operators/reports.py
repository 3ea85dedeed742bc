"""Denormalised result tables, each one projection over matches, selection and reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shown_level, shown_score
from ..model import NOT_COMPARABLE, RunParams, UNDER_BEST, UNDER_COVERAGE
from .matching import training
from .selection import status_text

SUCCESS = "succès"


def _titles(frame: DataFrame, jobs: DataFrame) -> DataFrame:
    for key, name in (("job_id_a", "Emploi_Actuel"), ("job_id_c", "Emploi_Cible")):
        frame = frame.join(jobs.select(F.col("job_id").alias(key), F.col("intitule").alias(name)), key)
    return frame


def _run(frame: DataFrame, params: RunParams) -> DataFrame:
    named = {"modele": F.lit(params.model), "Seuil_Sim": F.lit(float(params.similarity)), "Seuil_Couv": F.lit(float(params.coverage)), "Poids_Dense": F.lit(float(params.dense)), "Poids_Sparse": F.lit(float(params.sparse))}
    return frame.withColumns(named)


def percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value * 100)


def synthesis(selected: DataFrame, reuse: DataFrame, jobs: DataFrame, params: RunParams) -> DataFrame:
    """One row for each current job."""
    s = _titles(selected, jobs).join(reuse, ["job_id_a", "job_id_c"], "left")
    first = F.when(F.col("selected"), F.struct("rang", "g", "gs", "ecart_moyen"))
    kept = F.array_sort(F.collect_list(F.when(F.col("selected"), F.struct("rang", "Emploi_Cible", "r"))))
    t = s.groupBy("job_id_a", "Emploi_Actuel", "n_retenues").agg(kept.alias("k"), F.min(first).alias("f"), F.max(F.when(F.col("plus_proche"), F.col("Emploi_Cible"))).alias("Cible_La_Plus_Proche"), F.max(F.when(F.col("plus_proche"), F.col("g"))).alias("Score_Global_Cible_La_Plus_Proche"))
    t = t.withColumns({
        "Emplois_Cibles_Retenus": F.array_join(F.transform("k", lambda x: x["Emploi_Cible"]), " | "), "Statut": status_text(F.col("n_retenues")),
        "G_epfq": F.col("f.g"), "Gs_epfq": F.col("f.gs"), "Ecart_Moyen_epfq": F.col("f.ecart_moyen"),
        "R_epfq": F.nullif(F.array_join(F.transform("k", lambda x: F.concat(x["Emploi_Cible"], F.lit(": "), percent(x["r"]))), " | "), F.lit("")),
    })
    return _run(t.drop("k", "f"), params)


def matrix(selected: DataFrame, reuse: DataFrame, jobs: DataFrame, params: RunParams) -> DataFrame:
    """One row for each job pair, with the reason why it was not selected (the text speaks of the score even if a later key decided)."""
    s = _titles(selected, jobs).join(reuse, ["job_id_a", "job_id_c"], "left")
    why = F.when(F.col("selected"), "").when(~F.col("admissible"), UNDER_COVERAGE).otherwise(UNDER_BEST)
    t = s.select(
        "Emploi_Actuel", "Emploi_Cible", F.col("g").alias("G_epfq"), F.col("gs").alias("Gs_epfq"), F.col("ecart_moyen").alias("Ecart_Moyen_epfq"), F.col("admissible").alias("Est_Admissible"),
        F.col("selected").alias("Est_Selectionne"), F.col("plus_proche").alias("Est_Cible_La_Plus_Proche"), F.when(F.col("selected"), "retenue").otherwise("non retenue").alias("Statut_Selection"),
        why.alias("Raison_Non_Selection"), F.col("r").alias("R_epfq"),
    )
    return _run(t, params)


def level_state(seen: Column, gap: Column) -> Column:
    return F.when(~seen, "Sans correspondance sémantique").when(gap.isNull(), "Correspondance, niveau non comparable").otherwise("Correspondance, écart calculé")


def nearest_label(seen: Column, title: Column) -> Column:
    return F.when(title.isNull(), "N/A").when(seen, title).otherwise(F.concat(title, F.lit(" (plus proche, non reconnue)")))


def details(matches: DataFrame, selected: DataFrame, reuse: DataFrame, jobs: DataFrame, params: RunParams) -> DataFrame:
    """One row for each target skill of a retained target."""
    kept = selected.where("selected").select("job_id_a", "job_id_c", "g", "gs", "ecart_moyen")
    m = _titles(matches.join(kept, ["job_id_a", "job_id_c"]).join(reuse, ["job_id_a", "job_id_c"]), jobs)
    seen, gap = F.col("reconnue"), F.col("ecart")
    t = m.select(
        "Emploi_Actuel", F.col("Emploi_Cible").alias("Emploi_Cible_Retenu"), "pos_c", F.col("g").alias("G_epfq"), F.col("gs").alias("Gs_epfq"), F.col("ecart_moyen").alias("Ecart_Moyen_epfq"), F.col("r").alias("R_epfq"),
        F.col("intitule_c").alias("Competence_Cible"), shown_level(F.col("niveau_c")).alias("Niveau_Cible"), F.when(seen, F.col("intitule_a")).otherwise("N/A").alias("Competence_Actuelle_Correspondante"),
        F.when(seen, shown_level(F.col("niveau_actuel"))).otherwise("N/A").alias("Niveau_Actuel"), F.when(seen, "Reconnue").otherwise("Absente").alias("Decision"),
        F.when(~seen, "N/A").otherwise(F.coalesce(gap.cast("string"), F.lit(NOT_COMPARABLE))).alias("Ecart_Niveau"), level_state(seen, gap).alias("Etat_Comparaison_Niveau"),
        F.when(seen, F.col("statut")).otherwise("Absente").alias("Statut"), F.coalesce(training(F.col("statut"), gap), F.lit("")).alias("Recommandation_Formation"),
        nearest_label(seen, F.col("intitule_a")).alias("Competence_Actuelle_La_Plus_Proche"), F.col("score_dense").alias("Score_Dense_D_ac"), F.col("score_sparse").alias("Score_Sparse_L_ac"), F.col("score_hybride").alias("Score_Hybride_H_ac"),
    )
    return _run(t, params)


def display(matches: DataFrame, params: RunParams) -> DataFrame:
    """Matches with formatted values."""
    return matches.withColumns({
        "Score_Dense": shown_score(F.col("score_dense"), float(params.dense), "dense"), "Score_Sparse": shown_score(F.col("score_sparse"), float(params.sparse), "sparse"),
        "Score_Hybride": shown_score(F.col("score_hybride")), "Niveau_Actuel": shown_level(F.col("niveau_actuel")), "Ecart": F.coalesce(F.col("ecart").cast("string"), F.lit(NOT_COMPARABLE)),
        "Competence_Actuelle_La_Plus_Proche": nearest_label(F.col("reconnue"), F.col("intitule_a")),
    })


def export(matches: DataFrame, selected: DataFrame) -> DataFrame:
    """All analysed pairs; a recommendation only where the pair is selected."""
    m = matches.join(selected.select("job_id_a", "job_id_c", "selected"), ["job_id_a", "job_id_c"], "left")
    return m.withColumn("Recommandation_Formation", F.when(F.col("selected"), F.coalesce(training(F.col("statut"), F.col("ecart")), F.lit(""))).otherwise(""))


def engine_rows(model: str, selected: DataFrame, reuse: DataFrame, jobs: DataFrame, seconds: float | None = None, state: str = SUCCESS) -> DataFrame:
    """Rows of one engine for the comparison: retained pairs, or one empty row for a job without any."""
    s = _titles(selected, jobs).join(reuse, ["job_id_a", "job_id_c"], "left").where("selected or (n_retenues = 0 and rang = 1)")
    kept = F.col("selected")
    return s.select(
        F.lit(model).alias("modele"), "Emploi_Actuel", F.when(kept, F.col("Emploi_Cible")).otherwise("").alias("Emploi_Cible_Retenu"), F.when(kept, F.col("g")).alias("G_epfq"), F.when(kept, F.col("gs")).alias("Gs_epfq"),
        F.when(kept, F.col("ecart_moyen")).alias("Ecart_Moyen"), F.col("r").alias("R_epfq"), F.lit(seconds).cast("double").alias("Temps_Execution_s"), F.lit(state).alias("Statut"), F.lit("").alias("Detail_Erreur"),
    )


def failed_rows(model: str, state: str, error: str, current_jobs: DataFrame, seconds: float | None = None) -> DataFrame:
    return current_jobs.select(F.lit(model).alias("modele"), F.col("intitule").alias("Emploi_Actuel"), F.lit("").alias("Emploi_Cible_Retenu"), F.lit(seconds).cast("double").alias("Temps_Execution_s"), F.lit(state).alias("Statut"), F.lit(error).alias("Detail_Erreur"))


def engine_union(engines: list[DataFrame]) -> DataFrame:
    """UNION ALL of engines, failures included."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), engines)
