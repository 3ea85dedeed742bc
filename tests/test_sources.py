"""Readers with several files, visual profiles, refused tables, guards, block products and campaigns."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilltide.functions.encode import fake_dense, fake_sparse
from skilltide.model import RunParams
from skilltide.operators import campaign as cp
from skilltide.operators import evaluation as ev
from skilltide.operators import products as pr
from skilltide.operators import relations as rl
from skilltide.operators import validation as vl
from skilltide.plans import source_queries as sq
from skilltide.sources import encoders, profiles, visual, workbooks
from skilltide.streaming import new_jobs


def test_sheets_are_built_in_many_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, "X") for k in range(1, 200)], "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    lines = sq.sheet_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and lines.count() == 11 * 199
    monkeypatch.setattr(sq, "SHEETS", 10)
    assert sq.sheet_lines(spark, str(tmp_path)).rdd.getNumPartitions() == 19


def test_csv_files_by_header_and_row(spark, tmp_path):
    head = "emploi_intitule,emploi_type,emploi_effectif,competence_intitule,competence_niveau"
    for i in range(4):
        (tmp_path / f"a{i}.csv").write_text(f"{head}\nJ{i},cible,,\"x\ny\",2\nJ{i},cible,,B,3\nJ{i},cible,,C,x\n")
    (tmp_path / "b.csv").write_text("competence_niveau,competence_intitule,emploi_type,emploi_intitule,other\n4,A,actuel,J,q\n")
    (tmp_path / "c.csv").write_text("﻿" + head + "\n")
    rows = workbooks.read_csv(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))
    got = sorted((r.file, r.row, r.emploi_intitule, r.competence_intitule, r.competence_niveau) for r in rows.collect())
    assert got == sorted([(f"a{i}.csv", n, f"J{i}", t, v) for i in range(4) for n, t, v in ((2, "x\ny", 2.0), (3, "B", 3.0), (4, "C", None))] + [("b.csv", 2, "J", "A", 4.0)])
    heads = workbooks.csv_headers(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))
    assert sorted((r.file, r.column, r.rule) for r in vl.column_diagnostics(heads).collect()) == [("b.csv", "emploi_effectif", vl.MISSING_COLUMN), ("c.csv", "competence_intitule", vl.EMPTY_SHEET)]


def test_corpus_by_header(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('fichier_pdf,code_rome,competences,intitule,statut_validation_pdf,nombre_competences\nf,M1000,"a\nb",T,valide,2\n')
    assert tuple(workbooks.read_corpus(spark, str(path)).first()) == ("M1000", "T", "a\nb", 2, "valide", "f")
    path.write_text("code_rome\nM1000\n")
    with pytest.raises(vl.InvalidInput):
        workbooks.read_corpus(spark, str(path))


def test_tables_that_are_refused(spark):
    head = ["Niveaux", "Intitulé de la compétence", "Détails de la compétence"]
    docs = {
        "good": [head, ["Expertise", "A", ""], ["", "", ""]],
        "bad": [head, ["Guru", "A", "d"], ["Expertise", "", "d"], ["Expertise", "A"]],
        "placed": [["Nom", "Texte", "Rang"], ["A", "d", "maîtrise"], ["B", "", "Application"]],
        "other": [["Nom", "Texte", "Rang"], ["A", "d", "haut"]],
    }
    rows = spark.createDataFrame([(d, i, c) for d, t in docs.items() for i, c in enumerate(t)], "doc string, row_no long, cells array<string>")
    assert sorted((r.doc, r.intitule, r.description, r.niveau) for r in profiles.table_profiles(rows).collect()) == [("good", "A", None, 4), ("placed", "A", "d", 3), ("placed", "B", None, 2)]
    found = sorted((r.doc, r.row_no, r.severity, r.code) for r in profiles.table_diagnostics(rows).collect())
    assert found == [("bad", 1, "erreur", "niveau_inconnu"), ("bad", 2, "erreur", "association_ambigue"), ("bad", 3, "erreur", "structure_inexploitable"), ("placed", 1, "avertissement", "colonnes_interpretees_par_position")]
    with pytest.raises(vl.InvalidInput):
        profiles.require_tables(rows)
    assert profiles.require_tables(rows.where("doc in ('good', 'placed')")).count() == 3


def chars(text, x0=50.0, bold=False, color=(0.0,), size=10.0):
    return [(c, x0 + 5 * i, x0 + 5 * i + 4.9, "F-Bold" if bold else "F", size, None if color is None else [*map(float, color)]) for i, c in enumerate(text) if c != " "]


def sheet(spark, docs):
    rows = [(d, p, n, 20.0 * n, float(c[0][1]), 600.0, 800.0, c) for d, pages in docs.items() for p, lines in enumerate(pages, 1) for n, c in enumerate(lines)]
    return spark.createDataFrame(rows, f"doc string, page int, line_no long, top double, x0 double, width double, height double, chars {visual.CHARS}")


def skill(title, level):
    return chars(title, bold=True) + chars(level, 450.0)


def test_visual_sections(spark):
    section, other = chars("Compétences digitales x", bold=True), chars("Compétences métier", bold=True)
    lines = sheet(spark, {
        "two pages": [[chars("intro"), section, chars("Blue", color=(0, 0, 1)), skill("Skill semi-", "Maîtrise"), chars("auto", bold=True), chars("Says", color=None)], [chars("2 sur 2"), chars("more"), skill("B", "application"), other, skill("No", "Expertise")]],
        "none": [[chars("text")]], "empty": [[section, other]], "unknown": [[section, skill("A", "haut")]], "loose": [[section, chars("text")]],
    })
    skills, found = visual.section_skills(lines)
    assert [(r.doc, r.pos, r.intitule, r.description, r.niveau) for r in skills.orderBy("pos").collect()] == [("two pages", 1, "Skill semi-auto", "Says more", 3), ("two pages", 2, "B", None, 2)]
    assert {(r.doc, r.code) for r in found.collect()} == {("none", "section_absente"), ("empty", "structure_inexploitable"), ("unknown", "niveau_inconnu"), ("loose", "association_ambigue"), ("loose", "structure_inexploitable"), ("unknown", "structure_inexploitable")}


@pytest.mark.parametrize("which", [0, 1])
def test_visual_sections_read_lines_once(spark, which):
    lines = sheet(spark, {"a": [[chars("Compétences digitales x", bold=True), skill("A", "Expertise")]]})
    plan = visual.section_skills(lines)[which]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan and "Union" not in plan


def test_visual_sections_exchange_once(spark):
    lines = sheet(spark, {"a": [[chars("Compétences digitales x", bold=True), skill("A", "Expertise")]]})
    plan = visual.section_skills(lines)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_visual_titles(spark):
    def big(text, size=14.0):
        return chars(text, bold=True, size=size)

    lines = sheet(spark, {"one": [[big("CHEF D07 v"), big("small", 9.0)]], "two": [[big("CHEF DE"), big("PROJET")]], "unclear": [[big("A"), big("B")]], "none": [[big("x", 8.0), big("TALENTSOFT x")]]})
    files = spark.createDataFrame([("one", "x.pdf"), ("two", "in/Chef de projet - D07.PDF"), ("unclear", "c.pdf"), ("none", "n.pdf")], "doc string, file string")
    titles, found = visual.header_titles(lines, files)
    assert sorted(tuple(r) for r in titles.collect()) == [("one", "CHEF D07", False), ("two", "CHEF DE PROJET", True)]
    assert sorted((r.doc, r.code) for r in found.collect()) == [("none", "structure_inexploitable"), ("unclear", "association_ambigue")]


def test_guards_before_the_plan(spark):
    jobs = spark.createDataFrame([(1, "actuel"), (2, "autre"), (3, "actuel")], "job_id long, role string")
    skills = spark.createDataFrame([(1,), (2,)], "job_id long")
    assert sorted((r.job_id or 0, r.rule) for r in vl.job_diagnostics(jobs, skills).collect()) == [(0, "aucun emploi de type 'cible'"), (2, vl.ROLE_RULE), (3, vl.EMPTY_SHEET)]
    with pytest.raises(vl.InvalidInput):
        vl.require_jobs(jobs, skills)


def scored_skills(n_jobs=7):
    r = np.random.default_rng(2)
    return [(j, p, r.normal(size=4).tolist(), {f"w{k}": float(r.integers(0, 3)) for k in r.integers(0, 9, r.integers(0, 5))}) for j in range(n_jobs) for p in range(1 + j % 3)]


@pytest.mark.parametrize("block", [2, 1024])
def test_block_products_equal_the_pair_table(spark, monkeypatch, block):
    monkeypatch.setattr(pr, "BLOCK_ROWS", block)
    rows = scored_skills()
    skills = spark.createDataFrame(rows, "job_id long, pos int, dense array<double>, sparse map<string,double>")
    edges = spark.createDataFrame([(a, b, (a + b) % 2 == 0) for a, b in itertools.permutations(range(7), 2) if (a, b) != (3, 4)], "code_a long, code_b long, label boolean")
    pairs = ev.job_skill_pairs(skills, edges).withColumn("h", 0.7 * F.col("dense") + 0.3 * F.col("sparse"))
    for got, want in ((pr.job_coverages(skills, edges, [0.1, 0.5]), ev.coverages(pairs, [0.1, 0.5])), (pr.job_coverages(skills, edges, [0.2], (0.7, 0.3)), ev.coverages(pairs, [0.2], "h")), (pr.job_scores(skills, edges, [1.0, 0.4]), ev.continuous(pairs, [1.0, 0.4]))):
        a, b = ({tuple(r[c] for c in got.columns[:4]): [r[c] for c in got.columns[4:]] for r in f.collect()} for f in (got, want))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    m = {(r.id_a, r.id_b): r.dense for r in pr.matrix(skills.select((F.col("job_id") * 10 + F.col("pos")).alias("id"), "dense")).collect()}
    ids = {j * 10 + p: v for j, p, v, _ in rows}
    assert m.keys() == {(a, b) for a in ids for b in ids if a <= b} and all(math.isclose(x, np.dot(ids[a], ids[b]), abs_tol=1e-12) for (a, b), x in m.items())


def test_sparse_rows(spark):
    rows = spark.createDataFrame([(1, {"a": 3.0, "b": 4.0, "c": 0.0})], "id long, sparse map<string,double>")
    assert sorted(tuple(r) for r in pr.sparse_rows(rows).collect()) == [(1, "a", 0.6), (1, "b", 0.8)]
    with pytest.raises(Exception):
        pr.sparse_rows(spark.createDataFrame([(1, {"a": 0.0})], "id long, sparse map<string,double>")).collect()


def campaign_inputs(spark):
    corpus = spark.createDataFrame([("M1000", "A", "python code\ndata", "valide"), ("M2000", "B", "python code", "valide"), ("M3000", "C", "mortar", "valide")], "code_rome string, intitule string, competences string, statut_validation_pdf string")
    relations = spark.createDataFrame([(2, "M1000", "A", "M2000", "B", "Oui"), (3, "M1000", "A", "M3000", "C", "Non"), (4, "M2000", "B", "M3000", "C", "Non")], ["row", *rl.TRUTH])
    return corpus, relations


def test_grid_campaign(spark, tmp_path):
    corpus, relations = campaign_inputs(spark)

    def encode(skills):
        return skills.withColumn("dense", fake_dense(F.col("skill"))).withColumn("sparse", fake_sparse(F.col("skill")))

    done = cp.run_grid(corpus, relations, encode, f"file://{tmp_path}", "first", [0.5, 0.9], [0.5, 0.9], (0.7, 0.3))
    assert done.summary.count() == 4 and done.best.first().f1 == 1.0 and done.errors.count() == 0
    values = json.loads(spark.read.text(f"{done.path}/metadonnees").first().value)
    assert values["identifiant_campagne"] == "first" and len(values["empreinte_corpus"]) == 64
    assert spark.read.text(f"{done.path}/rapport").first().value == "# first"
    with pytest.raises(Exception):
        cp.run_grid(corpus, relations, encode, f"file://{tmp_path}", "first", [0.5], [0.5])
    with pytest.raises(cp.Refused):
        cp.run_grid(corpus.where("code_rome != 'M3000'"), relations, encode, f"file://{tmp_path}", "second", [0.5], [0.5])
    with pytest.raises(cp.Refused):
        cp.run_grid(corpus, relations.withColumn("similarite", F.lit("?")), encode, f"file://{tmp_path}", "third", [0.5], [0.5])


def test_decision_campaign(spark, tmp_path):
    corpus, relations = campaign_inputs(spark)

    def make():
        def ask(prompt):
            if "M3000" in prompt and "M1000" in prompt:
                raise ConnectionError("no route")
            return '{"decision": "Oui"}'

        return ask

    r = cp.run_decisions(corpus, relations, make, f"file://{tmp_path}", "d").first()
    assert (r.paires, r.erreurs, r.tp, r.fp, r.fn, r.tn, r.precision) == (3, 1, 1, 1, 0, 0, 0.5)
    prompt = cp.pair_prompts(rl.edges(relations), corpus).where("code_b = 'M2000'").first().prompt
    assert "Oui" not in prompt and prompt.count("- python code") == 2
    for bad in ("Oui", '{"decision": "oui"}', '{"decision": "Oui", "x": 1}', "[]"):
        with pytest.raises(ValueError):
            cp.decision_of(bad)


def test_encoded_and_cached(spark, tmp_path):
    skills = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, t string")
    got = encoders.encoded(skills, "t", lambda: lambda texts: [[float(ord(t))] for t in texts])
    assert {r.id: r.dense for r in got.collect()} == {1: [97.0], 2: [98.0], 3: [97.0], 4: None}
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [encoders.cached(spark, f"file://{tmp_path}", k, make).count() for k in ("x", "x", "y")] == [3, 3, 3] and len(made) == 2


def test_arriving_jobs_are_matched_once(spark, tmp_path):
    schema = "job_id long, pos long, role string, skill_id string, intitule string, description string, niveau int, dense array<double>, sparse map<string,double>"

    def of(job, role, vectors):
        return [(job, p, role, f"{job}-{p}", f"S{p}", None, 2, v, {"a": 1.0}) for p, v in enumerate(vectors)]

    targets = spark.createDataFrame(of(10, "cible", [[1.0, 0.0], [0.0, 1.0]]) + of(11, "cible", [[-1.0, 0.0]]), schema)
    jobs = spark.createDataFrame([(10, 10), (11, 11)], "job_id long, ord long")
    for n, rows in enumerate((of(1, "actuel", [[1.0, 0.0], [0.0, 1.0]]), of(2, "actuel", [[-1.0, 0.0]]))):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        new_jobs.match_stream(stream, targets, jobs, RunParams(1, 0), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
        got = {(r.job_id_a, r.job_id_c) for r in spark.read.parquet(f"{tmp_path}/out").where("selected").collect()}
        assert got == {(1, 10), (2, 11)} if n else got == {(1, 10)}
