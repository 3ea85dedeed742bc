"""Campaigns: a similarity judged against labelled pairs by thresholds, and binary decisions of a model pair by pair."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from . import evaluation as ev
from . import products as pr
from . import relations as rl
from .engines import SUCCESS

# Labels of a decision and states of a row.
YES, NO, DONE, FAILED = "Oui", "Non", "succes", "erreur"


def pair_prompts(edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """code_a, code_b, relation_reference, prompt of each labelled pair: both jobs with their skills, and no label."""
    lines = F.transform(F.filter(F.split(F.coalesce("competences", F.lit("")), r"\R"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), x))
    text = F.concat(F.lit("Métier "), "code_rome", F.lit(" — "), "intitule", F.lit("\nCompétences :\n"), F.array_join(lines, "\n"))
    a, b = (corpus.select(F.col("code_rome").alias(f"code_{x}"), F.col("intitule").alias(f"intitule_{x}"), text.alias(f"text_{x}")) for x in "ab")
    p = edges.join(a, "code_a").join(b, "code_b")
    return p.select("code_a", "intitule_a", "code_b", "intitule_b", F.when(F.col("label"), YES).otherwise(NO).alias("relation_reference"), F.concat("text_a", F.lit("\n\n"), "text_b").alias("prompt"))


def decision_of(content: object) -> str:
    """The decision of an answer; a ValueError unless it is JSON with just that key and one of the two labels."""
    found = json.loads(content)  # type: ignore[arg-type]
    if not isinstance(found, dict) or set(found) != {"decision"} or found["decision"] not in (YES, NO):
        raise ValueError("JSON de décision invalide")
    return found["decision"]


def decisions(prompts: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``prompts`` with decision, statut, erreur, reponse_brute; a failed call is a row. ``make`` builds the client once in each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for batch in batches:
            ask = ask or make()
            rows = []
            for prompt in batch.column("prompt").to_pylist():
                try:
                    answer = ask(prompt)
                    rows.append((decision_of(answer), DONE, "", answer))
                except Exception as e:
                    rows.append(("", FAILED, str(e), ""))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(list(c), pa.string()) for c in columns)], [*batch.schema.names[:5], "decision", "statut", "erreur", "reponse_brute"])

    keys = ["code_a", "intitule_a", "code_b", "intitule_b", "relation_reference"]
    schema = ", ".join(f"{k} string" for k in [*keys, "decision", "statut", "erreur", "reponse_brute"])
    return prompts.select(*keys, "prompt").mapInArrow(run, schema)


def decision_metrics(decided: DataFrame) -> DataFrame:
    """Confusion metrics of the rows that succeeded, their number and that of errors."""
    good = decided.where(F.col("statut") == DONE).select((F.col("relation_reference") == YES).alias("label"), (F.col("decision") == YES).alias("predicted"))
    errors = decided.agg(F.count_if(F.col("statut") != DONE).alias("erreurs"), F.count(F.lit(1)).alias("paires"))
    m = ev.confusion(good.withColumn("_all", F.lit(1)), ["_all"])
    zeros = {c: 0 for c in ("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")}
    return errors.withColumn("_all", F.lit(1)).join(m, "_all", "left").drop("_all").fillna(zeros)


@dataclass(frozen=True)
class Campaign:
    """What a campaign found, and where it was written."""

    summary: DataFrame
    best: DataFrame
    errors: DataFrame
    path: str


class Refused(ValueError):
    """Inputs that no campaign may start with."""


def prepared(corpus: DataFrame, relation_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skills, edges) after every check: a valid corpus, a table without errors, no code that the corpus lacks."""
    bad = rl.relation_diagnostics(relation_rows).where(F.col("severity") == rl.ERROR).take(20)
    if bad:
        raise Refused("the table of relations has errors: " + "; ".join(f"{d.code} row {d.row}" for d in bad))
    edges, skills = rl.edges(relation_rows), rl.prepared_skills(corpus)
    unknown = [r.code for r in rl.unknown_codes(edges, skills.select("code").distinct()).orderBy("code").take(20)]
    if unknown:
        raise Refused("codes that the corpus lacks: " + ", ".join(unknown))
    return skills, edges


def run_grid(corpus: DataFrame, relation_rows: DataFrame, encode: Callable[[DataFrame], DataFrame], root: str, name: str, similarity: Sequence[float], coverage: Sequence[float], weights: tuple[float, float] = (1.0, 0.0)) -> Campaign:
    """Corpus to encoder to grid to files: summary, errors of the best configuration, metadata and a report.

    ``encode`` adds ``dense`` (and ``sparse`` where its weight is not 0) to skills with a column ``skill``.
    """
    spark, path = corpus.sparkSession, sinks.campaign_directory(root, name)
    skills, edges = prepared(corpus, relation_rows)
    print_of = rl.fingerprint(skills).first().fingerprint
    vectors = encode(skills)
    if "sparse" not in vectors.columns:
        vectors = vectors.withColumn("sparse", F.lit(None).cast("map<string,double>"))
    job = F.xxhash64("code")
    vectors = vectors.select(job.alias("job_id"), F.col("skill_pos").alias("pos"), "dense", "sparse")
    keyed = edges.select("code_a", "code_b", F.xxhash64("code_a").alias("a"), F.xxhash64("code_b").alias("b"), "label")
    asked = keyed.select(F.col("a").alias("code_a"), F.col("b").alias("code_b"), "label")
    covered = pr.job_coverages(vectors, asked, similarity, weights).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        summary = ev.coverage_grid(covered, coverage)
        best = ev.best_configuration(summary)
        found = best.first()
        if found is None:
            raise Refused("no labelled pair")
        at = covered.where(F.col("seuil_sim") == found.seuil_sim).withColumn("predicted", F.col("couverture") >= found.seuil_couv)
        named = at.withColumnsRenamed({"code_a": "a", "code_b": "b"}).join(keyed.select("a", "b", "code_a", "code_b"), ["a", "b"])
        errors = ev.top_errors(named.select("code_a", "code_b", "label", "couverture", "predicted"))
        sinks.write_csv(summary.orderBy("seuil_sim", "seuil_couv"), f"{path}/resume")
        sinks.write_csv(errors, f"{path}/erreurs")
        values = {"date_heure_utc": datetime.now(timezone.utc).isoformat(), "identifiant_campagne": name, "empreinte_corpus": print_of, "poids": list(weights), "meilleure_configuration": found.asDict(), "statut": SUCCESS}
        sinks.write_metadata(spark, values, f"{path}/metadonnees")
        report = spark.createDataFrame([(sinks.campaign_report(name, best, errors),)], "value string")
        report.coalesce(1).write.mode("errorifexists").text(f"{path}/rapport")
        return Campaign(spark.read.csv(f"{path}/resume", header=True, inferSchema=True), spark.createDataFrame([found], best.schema), spark.read.csv(f"{path}/erreurs", header=True), path)
    finally:
        covered.unpersist()


def run_decisions(corpus: DataFrame, relation_rows: DataFrame, make: Callable[[], Callable[[str], str]], root: str, name: str) -> DataFrame:
    """Every labelled pair asked once; decisions and metadata are written, and the metrics returned."""
    spark, path = corpus.sparkSession, sinks.campaign_directory(root, name)
    _, edges = prepared(corpus, relation_rows)
    # A model is asked once a pair: the answers are written first and read again
    sinks.write_csv(decisions(pair_prompts(edges, corpus), make), f"{path}/decisions")
    kept = spark.read.csv(f"{path}/decisions", header=True, escape='"', multiLine=True).fillna("")
    metrics = decision_metrics(kept)
    sinks.write_metadata(spark, {"identifiant_campagne": name, **metrics.first().asDict()}, f"{path}/metadonnees")
    return metrics
