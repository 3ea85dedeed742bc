"""Matching, selection and reverse control on hand-computed fixtures."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from skilltide.functions import similarity as sim
from skilltide.functions.text import skill_text
from skilltide.model import ARBITRATION, FULL_TRAINING, LIGHT_TRAINING, NO_TARGET, RunParams
from skilltide.operators import matching as mt
from skilltide.operators import selection as sl

SKILL = "job_id long, pos long, role string, skill_id string, intitule string, description string, niveau int, dense array<double>, sparse map<string,double>"


def analysed(spark, rows, params=RunParams()):
    skills = spark.createDataFrame(rows, SKILL)
    pairs = mt.skill_pairs(skills, params)
    best = mt.best_match(pairs)
    matches = mt.matches(best)
    jobs = skills.where("role = 'cible'").select("job_id", F.col("job_id").alias("ord")).distinct()
    selected = sl.selection(sl.ranking(sl.pair_scores(matches, params), jobs))
    return pairs, best, matches, selected


def skill(job, pos, role, title, level, dense, sparse, description=None):
    return (job, pos, role, f"{job}-{pos}", title, description, level, dense, sparse)


ORCHESTRA = [
    skill(1, 0, "actuel", "A1", 1, [1.0, 0.0, 0.0], {"x": 1.0}), skill(1, 1, "actuel", "A2", 4, [0.0, 1.0, 0.0], {"y": 1.0}), skill(2, 0, "actuel", "A3", 3, [1.0, 0.0, 0.0], {"x": 1.0}),
    skill(11, 0, "cible", "C1", 2, [1.0, 0.0, 0.0], {"x": 1.0}), skill(12, 0, "cible", "C2", 2, [0.0, 0.0, 1.0], {"z": 1.0}),
]


def test_orchestration(spark):
    pairs, _, matches, selected = analysed(spark, ORCHESTRA)
    assert {(r.job_id_a, r.job_id_c) for r in sl.retained(selected).collect()} == {(1, 11), (2, 11)}
    assert {r.job_id_a: r.r for r in sl.reuse(pairs, selected).collect()} == {1: 0.5, 2: 1.0}
    needs = sl.training_needs(matches, selected).collect()
    assert [(r.job_id_a, r.commentaire) for r in needs] == [(1, LIGHT_TRAINING)]
    absent = sl.not_reused(pairs, selected).collect()
    assert [(r.job_id_a, r.pos_a, r.type_non_reprise) for r in absent] == [(1, 1, "absente_de_toutes_les_cibles")]


def test_no_target_and_ties(spark):
    rows = [skill(1, 0, "actuel", "A", 2, [1.0, 0.0], {"x": 1.0}), skill(11, 0, "cible", "B", 2, [0.0, 1.0], {"y": 1.0}), skill(12, 0, "cible", "C", 2, [0.0, 1.0], {"y": 1.0})]
    _, _, matches, selected = analysed(spark, rows)
    assert {r.alerte for r in selected.collect()} == {NO_TARGET}
    assert selected.where("plus_proche").first().job_id_c == 11
    assert sl.training_needs(matches, selected).count() == 0
    rows = [skill(1, 0, "actuel", "A", 2, [1.0, 0.0], {"x": 1.0}), skill(11, 0, "cible", "B", 2, [1.0, 0.0], {"x": 1.0}), skill(12, 0, "cible", "C", 2, [1.0, 0.0], {"x": 1.0})]
    selected = analysed(spark, rows)[3]
    assert selected.where("selected").count() == 2 and {r.alerte for r in selected.collect()} == {ARBITRATION}


def test_status_rules(spark):
    rows = [
        skill(1, 0, "actuel", "LOW", 1, [1.0, 0.0, 0.0], {"l": 1.0}), skill(1, 1, "actuel", "OK", 3, [0.0, 1.0, 0.0], {"o": 1.0}), skill(1, 2, "actuel", "NONE", None, [0.0, 0.0, 1.0], {"n": 1.0}),
        skill(11, 0, "cible", "low", 2, [1.0, 0.0, 0.0], {"l": 1.0}), skill(11, 1, "cible", "ok", 2, [0.0, 1.0, 0.0], {"o": 1.0}),
        skill(11, 2, "cible", "none", 4, [0.0, 0.0, 1.0], {"n": 1.0}), skill(11, 3, "cible", "absent", 3, [0.5, 0.5, 0.5], {"q": 1.0}), skill(11, 4, "cible", "bare", None, [0.5, 0.5, 0.5], {"q": 1.0}),
    ]
    _, _, matches, selected = analysed(spark, rows)
    got = {r.pos_c: (r.statut, r.niveau_actuel, r.ecart) for r in matches.collect()}
    assert got == {0: ("niveau_insuffisant", 1, 1), 1: ("niveau_suffisant", 3, 0), 2: ("niveau_non_renseigne", None, None), 3: ("absente", 0, 3), 4: ("absente", 0, None)}
    s = selected.first()
    assert (s.n, s.n_reconnues, s.n_suffisantes) == (5, 3, 1) and s.ecart_moyen == pytest.approx((1 * 2 + 0 * 2 + 3 * 3) / 7)


def test_exact_boundary(spark):
    df = spark.createDataFrame([(0.9, 0.2999999999999997), (0.9, 0.3), (0.9, 0.3000000000000003), (0.0, 0.6)], "d double, l double")
    p = RunParams()
    got = [r[0] for r in df.select(sim.reaches(sim.hybrid_exact(F.col("d"), F.col("l"), p), p)).collect()]
    assert got == [False, True, True, False]
    low = RunParams(similarity=Fraction(1, 5))
    assert [r[0] for r in df.select(sim.reaches(sim.hybrid_exact(F.col("d"), F.col("l"), low), low)).collect()][3]


def test_weights():
    with pytest.raises(ValueError):
        RunParams(0.8, 0.3)
    with pytest.raises(ValueError):
        RunParams(1.2, -0.2)
    assert RunParams(0.7, 0.3).integers == (7, 3, 10)


def test_weight_zero_is_not_computed(spark):
    rows = [skill(1, 0, "actuel", "A", 2, [1.0, 0.0], {"x": 1.0}), skill(11, 0, "cible", "B", 2, [0.6, 0.8], {"x": 1.0})]
    dense = analysed(spark, rows, RunParams(1, 0))[0].first()
    sparse = analysed(spark, rows, RunParams(0, 1))[0].first()
    assert (dense.score_dense, dense.score_sparse, dense.score_hybride) == (0.6, None, 0.6)
    assert (sparse.score_dense, sparse.score_sparse, sparse.score_hybride) == (None, 1.0, 1.0)


def test_sparse_cosine(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.2}, {"a": 0.4, "c": 1.0}), ({"a": 1.0}, {"b": 1.0}), ({}, {"a": 1.0})], "x map<string,double>, y map<string,double>")
    got = [r[0] for r in df.select(sim.sparse_cosine(F.col("x"), F.col("y"), sim.sparse_norm(F.col("x")), sim.sparse_norm(F.col("y")))).collect()]
    assert got[0] == pytest.approx(10 / 29) and got[1:] == [0.0, 0.0]


def test_tie_break(spark):
    rows = [skill(1, 0, "actuel", "Zulu", 2, [1.0], {"x": 1.0}), skill(1, 1, "actuel", "Alpha", 2, [1.0], {"x": 1.0}), skill(1, 2, "actuel", "Beta", 1, [1.0], {"x": 1.0}), skill(11, 0, "cible", "T", 2, [1.0], {"x": 1.0})]
    pairs, best, _, _ = analysed(spark, rows)
    assert best.first().intitule_a == "Alpha"
    tie = mt.tie_report(pairs, best).first()
    assert (tie.n_tied, tie.tied) == (2, ["Alpha", "Zulu"])
    text = mt.tie_report(pairs, best).select(mt.tie_text(F.col("tied"), True)).first()[0]
    assert text.endswith("entre « Alpha », « Zulu » ; choix déterministe : « Alpha ».")


def test_skill_text(spark):
    df = spark.createDataFrame([("t", None), ("t", "  "), ("t", " d ")], "t string, d string")
    assert [r[0] for r in df.select(skill_text(F.col("t"), F.col("d"))).collect()] == ["t", "t", "t.  d "]


def test_training_text(spark):
    df = spark.createDataFrame([("absente", 3), ("niveau_insuffisant", 1), ("niveau_suffisant", 0)], "s string, g int")
    assert [r[0] for r in df.select(mt.training(F.col("s"), F.col("g"))).collect()] == [FULL_TRAINING, LIGHT_TRAINING, None]


def test_blocks_equal_broadcast(spark):
    l = spark.range(7).selectExpr("id as job_id_a", "id as pos_a")
    r = spark.range(5).selectExpr("id as job_id_c", "id as pos_c")
    both = [sorted(map(tuple, mt.blocks_crossed(l, r, size, 3).select("job_id_a", "job_id_c").collect())) for size in (0, 1 << 40)]
    assert both[0] == both[1] and len(both[0]) == 35
