"""Relations, corpus, validation, profiles, sinks and engines on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from skilltide.functions.encode import fake_sparse
from skilltide.functions.text import clean_skill, join_fragments, level_of_label, normalize_title, profession_code, token_key
from skilltide.operators import engines as en
from skilltide.operators import evaluation as ev
from skilltide.operators import relations as rl
from skilltide.operators import validation as vl
from skilltide.sources import encoders, profiles, sinks, workbooks


def test_text_functions(spark):
    df = spark.createDataFrame([("É  lève ", " m 1000", "Maîtrise")], "a string, b string, c string")
    r = df.select(normalize_title(F.col("a")), profession_code(F.col("b")), level_of_label(F.col("c")), token_key(F.lit("Niveaux des compétences"), True), join_fragments(F.array(F.lit("a-"), F.lit("b"), F.lit("c"))), clean_skill(F.lit(" x  Transition numérique ")), fake_sparse(F.lit("The the cat a"))).first()
    assert list(r) == ["e leve", "M1000", 3, "NIVEAU DES COMPETENCE", "a-b c", "x", {"the": 0.5, "cat": 0.5}]


def test_relations(spark):
    legacy = spark.createDataFrame([(2, "Métier A", "m 1000", "Métier B", "M2000"), (3, "Métier B", "M2000", "Métier A", "M1000"), (4, "X", "M1", "Y", "M3000"), (5, "Z", "M3000", "Z", "M3000")], ["row", *rl.LEGACY])
    assert [tuple(r) for r in rl.edges(legacy).collect()] == [("M1000", "M2000", True)]
    found = sorted((r.severity, r.code, r.row) for r in rl.relation_diagnostics(legacy).collect() if r.row)
    assert found == [("avertissement", "doublon_relation", 3), ("avertissement", "relation_reflexive", 5), ("erreur", "code_manquant", 4)]
    truth = spark.createDataFrame([(2, "M1000", "A", "M2000", "B", "Oui"), (3, "M2000", "B", "M1000", "A", "Non"), (4, "M1000", "A", "M3000", "C", "Non"), (5, "M4000", "D", "M5000", "E", "?")], ["row", *rl.TRUTH])
    assert sorted(tuple(r) for r in rl.edges(truth).collect()) == [("M1000", "M2000", True), ("M1000", "M3000", False)]
    assert sorted(r.code for r in rl.relation_diagnostics(truth).collect()) == ["doublon_relation", "similarite_invalide"]


def test_table_diff(spark):
    old = spark.createDataFrame([("M1000", "M2000"), ("M2000", "M3000")], "code_a string, code_b string")
    new = spark.createDataFrame([("M1000", "M3000"), ("M2000", "M1000")], "code_a string, code_b string")
    diff = rl.table_diff(old, new)
    assert sorted(tuple(r) for r in diff.collect()) == [("ajoutee", "M1000", "M3000"), ("conservee", "M1000", "M2000"), ("supprimee", "M2000", "M3000")]
    assert "- M1000 — M3000" in sinks.table_diff_report(diff, True)


def test_ranking_metrics(spark):
    edges = spark.createDataFrame([("M1000", "M2000")], "code_a string, code_b string")
    ranks = spark.createDataFrame([("M1000", "M2000", 1), ("M2000", "M1000", 1)], "code string, item string, rang int")
    assert tuple(ev.recall_mrr(ranks, edges, 1).first()) == (2, 1.0, 1.0)


def test_auc(spark):
    df = spark.createDataFrame([(1, True, 0.5), (1, True, 0.9), (1, False, 0.5), (1, False, 0.1)], "k int, label boolean, score double")
    assert ev.auc(df, ["k"]).first().auc == 0.875


def test_campaign(spark):
    corpus = spark.createDataFrame([("M1000", "A", "python\ndata", "valide"), ("M2000", "B", "python\nstatistiques", "valide"), ("M3000", "C", "maçonnerie", "valide")], "code_rome string, intitule string, competences string, statut_validation_pdf string")
    skills = rl.prepared_skills(corpus)
    assert skills.count() == 5 and len(rl.fingerprint(skills).first()[0]) == 64
    with pytest.raises(ValueError):
        rl.prepared_skills(corpus.union(corpus))
    vectors = {"python": [1.0, 0.0], "data": [0.0, 1.0], "statistiques": [0.0, 1.0], "maçonnerie": [-1.0, 0.0]}
    rows = [(int(r.code[1]), r.skill_pos, vectors[r.skill], {r.skill: 1.0}) for r in skills.collect()]
    table = spark.createDataFrame(rows, "job_id long, pos int, dense array<double>, sparse map<string,double>")
    edges = spark.createDataFrame([(1, 2, True), (1, 3, False), (2, 3, False)], "code_a long, code_b long, label boolean")
    pairs = ev.job_skill_pairs(table, edges)
    grid = ev.threshold_grid(pairs, [0.8, 0.95], [0.8, 0.95])
    assert grid.count() == 4
    best = ev.best_configuration(grid).first()
    assert (best.f1, best.accuracy) == (1.0, 1.0)


def test_validation(spark):
    good = [("f", 2, "J", "actuel", 24.0, "A", 2.0), ("f", 3, "J", "actuel", 24.0, "B", 1.0)]
    bad = [("g", 2, "J", "actuel", 0.0, " ", 5.0), ("g", 3, "K", "actuel", None, "B", 1.5), ("h", 2, "J", "cible", None, "A", 1.0), ("h", 3, "J", "cible", 3.0, "A", 1.0)]
    schema = "file string, row long, emploi_intitule string, emploi_type string, emploi_effectif double, competence_intitule string, competence_niveau double"
    assert vl.require_valid(spark.createDataFrame(good, schema), "actuel").count() == 2
    found = sorted((r.file, r.row, r.column, r.rule) for r in vl.diagnostics(spark.createDataFrame(bad, schema)).collect())
    assert found == sorted([
        ("g", 2, "competence_intitule", vl.TEXT_RULE), ("g", 2, "competence_niveau", vl.LEVEL_RULE), ("g", 2, "emploi_effectif", vl.POSITIVE_RULE), ("g", 3, "competence_niveau", vl.LEVEL_RULE),
        ("g", 3, "emploi_effectif", vl.POSITIVE_RULE), ("g", 3, "emploi_intitule", vl.CONSTANT_RULE), ("h", 2, "emploi_effectif", vl.ALL_OR_NONE_RULE),
    ])
    with pytest.raises(vl.InvalidInput):
        vl.require_valid(spark.createDataFrame(bad, schema))
    with pytest.raises(vl.InvalidInput):
        vl.require_valid(spark.createDataFrame(good, schema), "cible")


def test_csv_jobs(spark, tmp_path):
    path = tmp_path / "job.csv"
    path.write_text('emploi_id,emploi_intitule,emploi_type,emploi_effectif,competence_id,competence_intitule,competence_description,competence_niveau\nE,J,actuel,24,C1,A,"x\ny",2\nE,J,actuel,24,,B,,1\n')
    jobs, skills = workbooks.read_jobs(workbooks.read_csv(spark, str(path)), "actuel")
    assert jobs.first().effectif == 24 and sorted((r.pos, r.intitule, r.description, r.niveau) for r in skills.collect()) == [(0, "A", "x\ny", 2), (1, "B", None, 1)]


def test_sheet_profiles(spark):
    pages = spark.createDataFrame([("d", 1, "M1000\nMETIER A\nDéfinition\nblah\nCompétences\nSavoir-faire\n• Première compétence Transition écologique\n• Compétence coupée"), ("d", 2, "suite de la compétence\n1/2 - © x\n• Deuxième compétence\n• Première compétence\nContextes de travail\n• Autre")], "doc string, page int, text string")
    r = profiles.sheet_profiles(profiles.lines(pages)).first()
    assert (r.code, r.title, r.competences) == ("M1000", "METIER A", ["Première compétence", "Compétence coupée suite de la compétence", "Deuxième compétence"])
    assert profiles.has_native_text(pages).first().readable


def test_section_and_table_profiles(spark):
    lines = ["M1000", "Titre", "Savoir-faire principaux", "• Faire", "suite", "Savoirs", "• Non", "Domaines d’expertise", "• Droit (Transition écologique)"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, line_no long, text string")
    got = [(r.intitule, r.source_section) for r in profiles.section_profiles(df).orderBy("pos").collect()]
    assert got == [("Faire suite", "Savoir-faire principaux"), ("Droit", "Domaines d’expertise")]
    assert profiles.profile_title(df, spark.createDataFrame([("d", "x - M1000.pdf")], "doc string, file string")).first().title == "Titre"
    rows = spark.createDataFrame([("t", 0, ["Compétence", "Détails de la compétence", "Niveau"]), ("t", 1, ["A", "d", "Expertise"]), ("t", 2, ["B", "", "maîtrise"]), ("t", 3, ["C", "", "?"])], "doc string, row_no long, cells array<string>")
    table = profiles.table_profiles(rows)
    assert [(r.intitule, r.description, r.niveau) for r in table.orderBy("row_no").collect()] == [("A", "d", 4), ("B", None, 3)]
    assert profiles.chained_profiles(table, profiles.section_profiles(df)).count() == 4


def test_engines(spark):
    def offline():
        raise en.Unavailable("no route")

    done = {e.model: e for e in en.run_engines({"ok": lambda: spark.range(3), "off": offline})}
    assert (done["ok"].state, done["ok"].result.count(), done["off"].state, done["off"].error) == ("succès", 3, "indisponible", "no route")


ANSWER = {"emploi_cible_retenu": "E1", "g_epfq": 0.5, "gs_epfq": 0.5, "ecart_moyen": 1, "r_epfq": 0.5, "correspondances": [
    {"competence_cible": "C1", "competence_actuelle": "A1", "statut": "Reconnue", "niveau_actuel": 1, "niveau_cible": 2, "ecart_niveau": 1, "statut_niveau": "niveau_insuffisant", "recommandation_formation": "x"},
    {"competence_cible": "C2", "competence_actuelle": "N/A", "statut": "Absente", "niveau_actuel": None, "niveau_cible": 3, "ecart_niveau": 3, "statut_niveau": "absente", "recommandation_formation": "y"}]}


def test_answers(spark):
    bad = json.loads(json.dumps(ANSWER))
    bad["correspondances"][0]["niveau_actuel"] = 4
    lacking = {**ANSWER, "correspondances": ANSWER["correspondances"][:1]}
    rows = [(i, t if isinstance(t, str) else json.dumps(t), {"A1": 1}, {"E1": {"C1": 2, "C2": 3}}) for i, t in enumerate([ANSWER, "{", bad, lacking, {**ANSWER, "g_epfq": 2}])]
    got = en.checked_answers(spark.createDataFrame(rows, "job_id long, answer string, current map<string,int>, targets map<string,map<string,int>>"))
    assert [r.state for r in got.orderBy("job_id").collect()] == ["succès", *["réponse LLM invalide"] * 4]
    assert en.transferred(got).count() == 2


def test_encoder_ladder():
    sizes = []

    def post(path, body):
        n = len(body["input"])
        sizes.append(n)
        if n > 2:
            raise en.RemoteError("too many")
        return {"data": [{"index": i, "embedding": [3.0, 4.0]} for i in reversed(range(n))]}

    assert encoders.encode(["a", "b", "c"], post, "m", tries=1) == [[0.6, 0.8]] * 3 and sizes == [3, 1, 2]
    with pytest.raises(en.RemoteError):
        encoders.decoded({"data": [{"index": 1, "embedding": [1.0]}]}, 1)
    assert encoders.exposes_sparse({"data": [{"lexical_weights": {}}]}) and not encoders.exposes_sparse({"data": []})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", 1)], "a string, b int")
    assert sinks.csv_text(df, True) == b"\xef\xbb\xbfa,b\n\xc3\xa9,1\n"
    with pytest.raises(ValueError):
        sinks.campaign_directory("/x", "../y")
    sinks.write_csv(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        sinks.write_csv(df, str(tmp_path / "t"))
    assert sinks.markdown_table(df).splitlines()[2] == "| é | 1 |"


def test_relation_diagnostics_query_keeps_titles(spark, monkeypatch):
    rows = [(2, "M0001", "Title 1", "M0002", "title  2", "Oui"), (3, "M0001", "Other", "M0003", "Title 3", "Non")]
    table = spark.createDataFrame(rows, "row long, code_emploi_a string, intitule_emploi_a string, code_emploi_b string, intitule_emploi_b string, similarite string")
    monkeypatch.setattr("skilltide.plans.data_queries.relation_rows", lambda s, d: table)
    from skilltide.plans.data_queries import src12_diagnostics

    assert [(r.code, r.subject) for r in src12_diagnostics(spark, "").collect()] == [("incoherence_code_intitule", "M0001")]
