"""Queries over the driver's tables for validation, relations, corpus and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import words
from ..functions.text import profession_code
from ..operators import relations as rl
from ..operators import validation as vl
from ..sources.driver import table


def workbook_rows(s: SparkSession, d: str) -> DataFrame:
    """Sheet rows from customers: a file for each nation, with broken rows among them."""
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("file"), (k + 1).alias("row"), F.when(k % 13 == 0, "  ").otherwise(F.concat(F.lit("Job "), F.col("c_nationkey").cast("string"))).alias("emploi_intitule"),
        F.when(k % 17 == 0, "autre").when(F.col("c_nationkey") % 2 == 0, "actuel").otherwise("cible").alias("emploi_type"), F.when(k % 5 != 0, F.floor(F.col("c_acctbal") / 1000).cast("double") + F.when(k % 7 == 0, 0.5).otherwise(0.0)).alias("emploi_effectif"),
        F.when(k % 19 == 0, None).otherwise(F.col("c_mktsegment")).alias("competence_intitule"), (k % 6).cast("double").alias("competence_niveau"),
    )


def val02_row_diagnostics(s, d):
    return vl.row_diagnostics(workbook_rows(s, d))


def val03_constant(s, d):
    rows = workbook_rows(s, d).withColumn("emploi_type", F.when(F.col("emploi_type") == "autre", "actuel").otherwise(F.col("emploi_type")))
    return vl.constant_diagnostics(rows)


def val04_headcount(s, d):
    return vl.headcount_diagnostics(workbook_rows(s, d))


def fn05_profession_code(s, d):
    k = F.col("p_partkey")
    raw = F.concat(F.when(k % 3 == 0, " m ").otherwise("k"), F.lpad((k % 10000).cast("string"), 4, "0"), F.when(k % 7 == 0, "x").otherwise(" "))
    return table(s, d, "part").select("p_partkey", profession_code(raw).alias("code"))


def relation_rows(s: SparkSession, d: str) -> DataFrame:
    """Labelled relations between customers' and dates' codes, one an order, in the truth table's layout."""
    a, b = F.col("o_custkey") % 97, F.dayofyear("o_orderdate") % 89

    def code(n):
        return F.when(n == 5, "bad").otherwise(F.concat(F.lit("M"), F.lpad(n.cast("string"), 4, "0")))

    label = F.when(F.col("o_orderpriority") == "1-URGENT", "Oui").when(F.col("o_orderpriority") == "5-LOW", "?").otherwise("Non")
    return table(s, d, "orders").select((F.col("o_orderkey") + 2).alias("row"), code(a).alias("code_emploi_a"), F.concat(F.lit("Title "), a.cast("string")).alias("intitule_emploi_a"), code(b).alias("code_emploi_b"), F.concat(F.lit("title  "), b.cast("string")).alias("intitule_emploi_b"), label.alias("similarite"))


def legacy(rows: DataFrame) -> DataFrame:
    return rows.select("row", *(F.col(o).alias(n) for o, n in zip(("intitule_emploi_a", "code_emploi_a", "intitule_emploi_b", "code_emploi_b"), rl.LEGACY, strict=True)))


def src11_relations(s, d):
    return rl.edges(legacy(relation_rows(s, d)))


def src12_truth(s, d):
    return rl.edges(relation_rows(s, d))


def src12_diagnostics(s, d):
    return rl.relation_diagnostics(relation_rows(s, d))


def src13_neighbours(s, d):
    from ..operators.evaluation import neighbours

    return neighbours(rl.edges(relation_rows(s, d)).where("label"))


def src14_corpus_status(s, d):
    codes = rl.codes(rl.edges(relation_rows(s, d))).select("code", F.concat(F.lit("Title "), F.col("code")).alias("intitule"))
    k = F.col("s_suppkey")
    code = F.concat(F.lit("M"), F.lpad((k % 90).cast("string"), 4, "0"))
    other = F.when(k % 11 == 0, "M9999").otherwise(code)
    files = table(s, d, "supplier").select(F.concat(code, F.when(k % 2 == 0, " - ").otherwise("_"), k.cast("string"), F.lit(".pdf")).alias("file"), code.alias("code"), other.alias("file_code"), F.lit(None).cast("string").alias("title"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("competences"))
    return rl.corpus(codes, files)[0]


def src19_fake_sparse(s, d):
    w = words(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(w).alias("n_words"), F.array_join(F.array_sort(w), " ").alias("words"))


def src19_fake_dense(s, d):
    from ..functions.encode import fake_dense
    from ..functions.similarity import bound

    v = bound(fake_dense(F.col("text")), lambda v: F.struct(F.round(v[0], 9).alias("first"), F.round(v[31], 9).alias("last"), F.size(v).alias("n")))
    return table(s, d, "documents").select("doc_id", v.alias("v")).select("doc_id", "v.first", "v.last", "v.n")


def st01_table_diff(s, d):
    rows = relation_rows(s, d)
    old, new = rl.edges(rows.where("row % 3 != 0")), rl.edges(rows.where("row % 3 != 1"))
    return rl.table_diff(old, new)


QUERIES = {f.__name__: f for f in (val02_row_diagnostics, val03_constant, val04_headcount, fn05_profession_code, src11_relations, src12_truth, src12_diagnostics, src13_neighbours, src14_corpus_status, src19_fake_sparse, src19_fake_dense, st01_table_diff)}

_WB = """WITH w AS (SELECT CAST(c_nationkey AS VARCHAR) AS file, c_custkey + 1 AS row, CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE 'Job ' || c_nationkey END AS t,
    CASE WHEN c_custkey % 17 = 0 THEN 'autre' WHEN c_nationkey % 2 = 0 THEN 'actuel' ELSE 'cible' END AS role,
    CASE WHEN c_custkey % 5 != 0 THEN floor(c_acctbal / 1000) + CASE WHEN c_custkey % 7 = 0 THEN 0.5 ELSE 0.0 END END AS e, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_mktsegment END AS s, c_custkey % 6 AS n FROM customer)"""
_TEXT, _SAME, _POS = "valeur texte obligatoire; une valeur composée uniquement d''espaces est vide", "la valeur doit être identique sur toutes les lignes du fichier", "entier strictement positif obligatoire pour un emploi actuel"
_RL = """WITH o AS (SELECT o_orderkey + 2 AS row, o_custkey % 97 AS a, dayofyear(o_orderdate) % 89 AS b, CASE o_orderpriority WHEN '1-URGENT' THEN 'Oui' WHEN '5-LOW' THEN '?' ELSE 'Non' END AS y FROM orders),
    c AS (SELECT row, y, CASE WHEN a != 5 THEN 'M' || lpad(CAST(a AS VARCHAR), 4, '0') END AS a, CASE WHEN b != 5 THEN 'M' || lpad(CAST(b AS VARCHAR), 4, '0') END AS b FROM o),
    q AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM c WHERE a IS NOT NULL AND b IS NOT NULL),
    f AS (SELECT lo, hi, min(row) AS fr, arg_min(y, row) AS y FROM q WHERE lo != hi GROUP BY lo, hi)"""
ORACLE_SQL = {
    "val02_row_diagnostics": f"""{_WB} SELECT file, row, 'emploi_intitule' AS "column", '{_TEXT}' AS rule FROM w WHERE trim(t) = '' UNION ALL SELECT file, row, 'competence_intitule', '{_TEXT}' FROM w WHERE trim(coalesce(s, '')) = ''
        UNION ALL SELECT file, row, 'emploi_type', 'valeur exacte attendue: ''actuel'' ou ''cible''' FROM w WHERE role = 'autre' UNION ALL SELECT file, row, 'competence_niveau', 'entier obligatoire compris entre 1 et 4' FROM w WHERE n NOT BETWEEN 1 AND 4""",
    "val03_constant": f"""{_WB}, v AS (SELECT file, row, t, CASE role WHEN 'autre' THEN 'actuel' ELSE role END AS role FROM w), g AS (SELECT file, arg_min(t, row) AS ft, arg_min(role, row) AS fr, min(trim(t) != '') AS ok FROM v GROUP BY file)
        SELECT file, row, 'emploi_intitule' AS "column", '{_SAME}' AS rule FROM v JOIN g USING (file) WHERE ok AND t != ft UNION ALL SELECT file, row, 'emploi_type', '{_SAME}' FROM v JOIN g USING (file) WHERE role != fr""",
    "val04_headcount": f"""{_WB}, i AS (SELECT *, CASE WHEN e = floor(e) THEN CAST(e AS BIGINT) END AS n1 FROM w), g AS (SELECT file, arg_min(role, row) AS fr, count(*) FILTER (WHERE e IS NULL) AS ab, count(*) AS c FROM i GROUP BY file),
        j AS (SELECT i.file, i.row, i.e, i.n1, fr, ab, c FROM i JOIN g USING (file)), h AS (SELECT file, arg_min(n1, row) AS fn, count(*) AS k FROM j WHERE n1 IS NOT NULL AND NOT (fr = 'actuel' AND n1 <= 0) GROUP BY file), k AS (SELECT j.*, fn, coalesce(k, 0) AS k FROM j LEFT JOIN h USING (file))
        SELECT file, row, 'emploi_effectif' AS "column", '{_POS}' AS rule FROM k WHERE e IS NULL AND fr = 'actuel' UNION ALL SELECT file, row, 'emploi_effectif', 'la valeur renseignée doit être un entier' FROM k WHERE e IS NOT NULL AND n1 IS NULL
        UNION ALL SELECT file, row, 'emploi_effectif', '{_POS}' FROM k WHERE n1 <= 0 AND fr = 'actuel' UNION ALL SELECT file, row, 'emploi_effectif', 'pour une cible, l''effectif doit être vide partout ou renseigné partout' FROM k WHERE e IS NULL AND fr = 'cible' AND ab != c
        UNION ALL SELECT file, row, 'emploi_effectif', '{_SAME}' FROM k WHERE k > 1 AND n1 IS NOT NULL AND n1 != fn""",
    "fn05_profession_code": "SELECT p_partkey, CASE WHEN p_partkey % 7 != 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'M' ELSE 'K' END || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') END AS code FROM part",
    "src11_relations": f"{_RL} SELECT lo AS code_a, hi AS code_b, true AS label FROM f",
    "src12_truth": f"{_RL} SELECT lo AS code_a, hi AS code_b, y = 'Oui' AS label FROM f WHERE y != '?'",
    "src12_diagnostics": f"""{_RL} SELECT 'erreur' AS severity, 'code_manquant' AS code, CAST(NULL AS VARCHAR) AS subject, row FROM c WHERE a IS NULL UNION ALL SELECT 'erreur', 'code_manquant', NULL, row FROM c WHERE b IS NULL
        UNION ALL SELECT 'erreur', 'relation_reflexive', a, row FROM q WHERE lo = hi UNION ALL SELECT 'erreur', 'doublon_relation', a, row FROM q JOIN f ON q.lo = f.lo AND q.hi = f.hi WHERE row > fr UNION ALL SELECT 'erreur', 'similarite_invalide', NULL, row FROM c WHERE y = '?'""",
    "src13_neighbours": f"{_RL} SELECT lo AS code, hi AS voisin FROM f WHERE y = 'Oui' UNION SELECT hi, lo FROM f WHERE y = 'Oui'",
    "src14_corpus_status": f"""{_RL}, e AS (SELECT lo, hi FROM f WHERE y != '?'), k AS (SELECT lo AS code FROM e UNION SELECT hi FROM e), z AS (SELECT s_suppkey AS k, 'M' || lpad(CAST(s_suppkey % 90 AS VARCHAR), 4, '0') AS code FROM supplier),
        g AS (SELECT code || CASE WHEN k % 2 = 0 THEN ' - ' ELSE '_' END || k || '.pdf' AS file, code, k % 11 = 0 AS bad, k % 2 = 0 AS descr, CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS n FROM z),
        h AS (SELECT code, CASE WHEN count(*) > 1 AND count(*) FILTER (WHERE descr) = 1 THEN min(file) FILTER (WHERE descr) ELSE min(file) END AS file, bool_or(bad) AS bad FROM g GROUP BY code)
        SELECT k.code AS code_rome, 'Title ' || k.code AS intitule, CASE WHEN n = 2 THEN 'x' || chr(10) || 'y' ELSE '' END AS competences, coalesce(n, 0) AS nombre_competences,
        CASE WHEN h.file IS NULL THEN 'pdf_manquant' WHEN n = 0 THEN 'competences_absentes' WHEN h.bad THEN 'code_pdf_incoherent' ELSE 'valide' END AS statut_validation_pdf, h.file AS fichier_pdf FROM k LEFT JOIN h ON k.code = h.code LEFT JOIN g ON g.file = h.file""",
    "src19_fake_sparse": r"""SELECT doc_id, len(ws) AS n_words, array_to_string(list_sort(ws), ' ') AS words FROM (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2)) AS ws FROM documents)""",
    "src19_fake_dense": """WITH h AS (SELECT doc_id, list_transform(range(32), lambda i: CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)::DOUBLE / 255 - 0.5) AS v FROM documents),
        l AS (SELECT doc_id, v, sqrt(32 * list_dot_product(v, v)) AS n FROM h) SELECT doc_id, round(v[1] / n, 9) AS first, round(v[32] / n, 9) AS last, 1024 AS n FROM l""",
    "st01_table_diff": f"""WITH o AS (SELECT o_orderkey + 2 AS row, o_custkey % 97 AS a, dayofyear(o_orderdate) % 89 AS b, CASE o_orderpriority WHEN '1-URGENT' THEN 'Oui' WHEN '5-LOW' THEN '?' ELSE 'Non' END AS y FROM orders),
        c AS (SELECT row, y, CASE WHEN a != 5 THEN 'M' || lpad(CAST(a AS VARCHAR), 4, '0') END AS a, CASE WHEN b != 5 THEN 'M' || lpad(CAST(b AS VARCHAR), 4, '0') END AS b FROM o), q AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND a != b),
        x AS (SELECT lo, hi, arg_min(y, row) AS y FROM q WHERE row % 3 != 0 GROUP BY lo, hi), z AS (SELECT lo, hi, arg_min(y, row) AS y FROM q WHERE row % 3 != 1 GROUP BY lo, hi)
        SELECT CASE WHEN p.lo IS NULL THEN 'ajoutee' WHEN r.lo IS NULL THEN 'supprimee' ELSE 'conservee' END AS changement, coalesce(p.lo, r.lo) AS code_a, coalesce(p.hi, r.hi) AS code_b
        FROM (SELECT * FROM x WHERE y != '?') p FULL JOIN (SELECT * FROM z WHERE y != '?') r ON p.lo = r.lo AND p.hi = r.hi""",
}
