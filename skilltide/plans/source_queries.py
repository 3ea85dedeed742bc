"""Queries over the driver's tables for readers, text functions, guards, decisions and block products, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import campaign as cp
from ..operators import engines as en
from ..operators import products as pr
from ..operators import relations as rl
from ..operators import validation as vl
from ..sources import driver, profiles, visual
from ..sources.driver import table
from .data_queries import _RL, relation_rows, workbook_rows
from .data_queries import ORACLE_SQL as DATA_SQL


def r6(name):
    return F.round(F.col(name), 6).alias(name)


# Text functions


def fn01_clean(s, d):
    raw = F.concat(F.lit("  "), "p_name", F.lit("\t  \n"), "p_brand", F.lit(" "))
    return table(s, d, "part").select("p_partkey", tx.clean(raw).alias("text"))


def _accented(c):
    return F.concat(F.lit("Éçà ô-"), c, F.lit(" Œuvre"))


def fn02_decompose(s, d):
    return table(s, d, "part").select("p_partkey", tx.decompose(_accented("p_name")).alias("text"))


def fn03_title_key(s, d):
    return table(s, d, "part").select("p_partkey", tx.normalize_title(F.concat(F.lit(" Élève/"), "p_name", F.lit("--"), "p_brand", F.lit("!"))).alias("text"))


def fn04_token_key(s, d):
    raw = F.concat(F.lit("Niveaux d’"), "p_name", F.lit("s / bus "), "p_brand")
    return table(s, d, "part").select("p_partkey", tx.token_key(raw, True).alias("singular"), tx.token_key(raw).alias("heading"))


def fn06_skill_label(s, d):
    k = F.col("p_partkey")
    badge = F.when(k % 3 == 0, "  Transition numérique ").when(k % 3 == 1, " transition ECOLOGIQUE").otherwise(" transition")
    return table(s, d, "part").select("p_partkey", tx.clean_skill(F.concat("p_name", badge)).alias("text"))


def fn07_fragments(s, d):
    parts = F.array("p_name", F.when(F.col("p_partkey") % 2 == 0, "semi-").otherwise("a/"), F.col("p_brand"), F.lit("end"))
    return table(s, d, "part").select("p_partkey", tx.join_fragments(parts).alias("text"))


def fn08_level(s, d):
    k = F.col("p_partkey")
    label = F.when(k % 5 == 0, " Sensibilisation").when(k % 5 == 1, "APPLICATION").when(k % 5 == 2, "Maîtrise ").when(k % 5 == 3, "expertise").otherwise("expert")
    return table(s, d, "part").select("p_partkey", tx.level_of_label(label).alias("niveau"))


def fn09_characters(s, d):
    """Bold, black and coloured characters of the lines of a sheet, as text."""
    v = visual.visual_lines(sheet_lines(s, d))
    return v.select("doc", "line_no", "bold_text", "plain_text", "right_text", "coloured")


def fn10_optional(s, d):
    return table(s, d, "part").select("p_partkey", tx.optional_text(F.when(F.col("p_partkey") % 3 == 0, "   ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))).alias("text"))


def fn16_l2(s, d):
    v = sim.bound(sim.l2_normalize(F.col("embedding").cast("array<double>")), lambda v: F.struct(F.round(v[0], 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"), F.round(sim.dot(v, v), 6).alias("square")))
    return table(s, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", "v.*")


def fn17_sparse_rows(s, d):
    rows = driver.skills(s, d).where(F.size("sparse") > 0).select(F.col("skill_id").alias("id"), "sparse")
    return pr.sparse_rows(rows).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("first"), F.max("token").alias("last"), F.round(F.sum("weight"), 6).alias("total"))


def _corpus(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.concat(F.char(65 + F.floor(k / 10000)), F.lpad((k % 10000).cast("string"), 4, "0"))
    text = F.concat("p_type", F.lit("\n \n  "), "p_brand", F.lit(" "))
    return table(s, d, "part").select(code.alias("code_rome"), F.col("p_name").alias("intitule"), text.alias("competences"), F.lit("valide").alias("statut_validation_pdf"))


def fn19_fingerprint(s, d):
    return rl.fingerprint(rl.prepared_skills(_corpus(s, d)))


def prj01_skill_text(s, d):
    k = F.col("p_partkey")
    description = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), "p_type"))
    return table(s, d, "part").select("p_partkey", tx.skill_text(F.col("p_name"), description).alias("text"))


# Readers


def src05_lines(s: SparkSession, d: str) -> DataFrame:
    """Table rows from orders: a document for each customer; of some the header is unknown, of some rows are broken."""
    k = F.col("o_orderkey")
    level = F.when(k % 11 == 0, "Guru").when(k % 4 == 0, "Expertise").when(k % 4 == 1, "MAITRISE").otherwise("application")
    cells = F.when(k % 13 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.col("o_orderpriority"), level, F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("Skill  "), k.cast("string")))))
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("doc"), k.alias("row_no"), cells.alias("cells"))
    heads = rows.groupBy("doc").agg(F.lit(-1).cast("long").alias("row_no")).where("doc % 5 != 0").withColumn("cells", F.array(F.lit("Détail  de la COMPÉTENCE"), F.lit("NIVEAUX"), F.lit("Intitulé de la compétence")))
    return rows.unionByName(heads)


def src05_table(s, d):
    return profiles.table_profiles(src05_lines(s, d))


def src05_findings(s, d):
    return profiles.table_diagnostics(src05_lines(s, d))


def _chars(text, bold: bool, color, x0: float):
    """Characters of a text one beside the other; a space is a gap."""
    at = F.sequence(F.lit(1), F.length(text))
    chars = F.transform(at, lambda i: F.struct(F.substring(text, i, F.lit(1)).alias("text"), (x0 + 5.0 * i).alias("x0"), (x0 + 5.0 * i + 4.8).alias("x1"), F.lit("Demo-Bold" if bold else "Demo").alias("font"), F.lit(10.0).alias("size"), color.alias("color")))
    return F.filter(chars, lambda c: c["text"] != " ")


#: Visual sheets that one task builds and reads.
SHEETS = 8192


def sheet_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of a visual sheet for each customer: chrome, section, skills of two title lines and a description over two pages, next section."""
    k = F.col("c_custkey")
    black, blue = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.2), F.lit(0.8))
    none = F.array().cast(visual.CHARS)
    c = table(s, d, "customer").withColumn("doc", k.cast("string"))
    # A few bytes of a customer become many lines, so customers are dealt out before: one task read a whole small file
    c = c.repartition(max(2 * s.sparkContext.defaultParallelism, c.count() // SHEETS), "doc")
    level = F.when(k % 7 == 0, F.lit("inconnu")).when(k % 2 == 0, F.lit("Maîtrise")).otherwise(F.lit("Expertise"))

    def line(page: int, no: int, chars):
        return F.struct(F.lit(page).alias("page"), F.lit(no).cast("long").alias("line_no"), chars.cast(visual.CHARS).alias("chars"))

    title = F.concat(F.lit("Skill "), "doc", F.lit(" semi-"))
    lines = [
        line(1, 0, _chars(F.lit("Talentsoft x"), False, black, 50.0)),
        line(1, 1, F.when(k % 11 == 0, none).otherwise(_chars(F.lit("COMPÉTENCES DIGITALES"), True, black, 50.0))),
        line(1, 2, _chars(F.lit("Category"), False, blue, 50.0)),
        line(1, 3, F.concat(_chars(title, True, black, 50.0), _chars(level, False, black, 450.0))),
        line(1, 4, _chars(F.lit("auto title"), True, black, 50.0)),
        line(1, 5, _chars(F.concat(F.lit("Says "), "c_mktsegment"), False, black, 50.0)),
        line(2, 0, _chars(F.lit("2 sur 3 pages"), False, black, 50.0)),
        line(2, 1, F.when(k % 13 == 0, _chars(F.lit("Stray bold"), True, black, 50.0)).otherwise(_chars(F.lit("and more"), False, black, 50.0))),
        line(2, 2, F.concat(_chars(F.lit("Second"), True, black, 50.0), _chars(F.lit("Application"), False, black, 450.0))),
        line(2, 3, _chars(F.lit("Compétences métier"), True, black, 50.0)),
        line(2, 4, F.concat(_chars(F.lit("Not this"), True, black, 50.0), _chars(F.lit("Expertise"), False, black, 450.0))),
    ]
    rows = c.select("doc", F.explode(F.array(*lines)).alias("l")).select("doc", "l.*")
    return rows.select("doc", "page", "line_no", (F.col("line_no") * 20.0).alias("top"), F.lit(50.0).alias("x0"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), "chars")


def src06_sections(s, d):
    return visual.section_skills(sheet_lines(s, d))[0]


def src06_findings(s, d):
    return visual.section_skills(sheet_lines(s, d))[1].select("doc", "code", "page")


def _titles(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, black = F.col("s_suppkey"), F.array(F.lit(0.0))
    one = F.concat(F.lit("EMPLOI "), k.cast("string"))
    # A title on one line, or on two neighbouring ones: then the file's name tells which candidate counts
    c = table(s, d, "supplier").select(k.cast("string").alias("doc"), k, F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(20.0).alias("top"), F.when(k % 4 == 3, F.lit("x")).otherwise(one).alias("t"), F.when(k % 4 == 3, 8.0).otherwise(14.0).alias("z")),
        F.struct(F.lit(1).cast("long").alias("line_no"), F.lit(40.0).alias("top"), F.lit("DEUX D07 v").alias("t"), F.when(k % 2 == 0, 14.0).otherwise(8.0).alias("z")),
        F.struct(F.lit(2).cast("long").alias("line_no"), F.lit(500.0).alias("top"), F.lit("BELOW").alias("t"), F.lit(30.0).alias("z")),
    )).alias("l")).select("doc", "s_suppkey", "l.*")
    chars = F.transform(_chars(F.col("t"), True, black, 50.0), lambda x: x.withField("size", F.col("z")))
    lines = c.select("doc", F.lit(1).alias("page"), "line_no", "top", F.lit(50.0).alias("x0"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), chars.cast(visual.CHARS).alias("chars"))
    name = F.when(k % 4 == 0, F.concat(F.lit("in/Emploi "), k.cast("string"), F.lit(" deux d07.PDF"))).when(k % 3 == 0, F.concat(F.lit("emploi "), k.cast("string"), F.lit(" - D07.pdf"))).otherwise("other.pdf")
    return lines, table(s, d, "supplier").select(k.cast("string").alias("doc"), name.alias("file"))


def src08_titles(s, d):
    return visual.header_titles(*_titles(s, d))[0]


def src08_findings(s, d):
    return visual.header_titles(*_titles(s, d))[1].select("doc", "code")


def src07_sections(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 9 == 0, "Savoir-faire principaux").when(k % 9 == 1, "Savoirs").when(k % 9 == 2, "Domaines d’expertise").when(k % 9 == 6, F.concat(F.lit("suite "), k.cast("string")))
    text = text.when(k % 9 == 7, "– x Transition écologique").otherwise(F.concat(F.lit("• "), "o_orderpriority", F.lit(" "), k.cast("string")))
    return profiles.section_profiles(table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("doc"), k.alias("line_no"), text.alias("text")))


def src09_native_text(s, d):
    return profiles.has_native_text(table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text"))


def src10_sheets(s, d):
    k = F.col("c_custkey")
    page = F.concat(F.lit("m"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("\nMETIER "), "c_mktsegment", F.lit("\nDéfinition\nblah\nCompétences\nSavoir-faire\n• A "), "c_mktsegment", F.lit(" Transition écologique\n• B "), k.cast("string"), F.lit("\nsuite\n1/2 - © x\n- A "), "c_mktsegment", F.lit("\nContextes de travail\n• Autre"))
    pages = table(s, d, "customer").select(k.alias("doc"), F.lit(1).alias("page"), page.alias("text"))
    return profiles.sheet_profiles(profiles.lines(pages)).select("doc", "code", "title", F.array_join("competences", "|").alias("competences"))


# Guards and contracts


def val01_columns(s, d):
    n = F.col("n_nationkey")
    columns = F.filter(F.array(*map(F.lit, [*vl.REQUIRED_COLUMNS, "competence_id"])), lambda c: ~((c == "emploi_type") & (n % 3 == 0)) & ~((c == "competence_niveau") & (n % 4 == 0)))
    return vl.column_diagnostics(table(s, d, "nation").select(F.col("n_name").alias("file"), columns.alias("columns"), (n % 5).alias("n_rows")))


def val05_role(s, d):
    return vl.row_diagnostics(workbook_rows(s, d), "actuel")


def val08_guards(s, d):
    role = F.when(F.col("c_custkey") % 9 == 0, "autre").otherwise("actuel")
    jobs = table(s, d, "customer").select(F.col("c_custkey").alias("job_id"), role.alias("role"))
    return vl.job_diagnostics(jobs, table(s, d, "orders").select(F.col("o_custkey").alias("job_id")))


def val09_supplied(s, d):
    """Matches of each target job's skills with the job before it, some left out, doubled, foreign or unknown."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("v"), F.floor(F.col("vec_id") / 10).cast("long").alias("j"), (F.col("vec_id") % 10).alias("pos"))
    t = v.where("j % 2 = 1")
    m = t.where("v % 13 != 0").select((F.col("j") - 1).alias("job_id_a"), F.col("j").alias("job_id_c"), F.col("pos").alias("pos_c"), F.when(F.col("v") % 11 == 0, F.col("pos") + 10).otherwise(F.col("pos")).alias("pos_a"), "v")
    more = m.where("v % 17 = 0").unionByName(m.where("v % 19 = 0").withColumn("pos_c", F.lit(99).cast("long")))
    current = v.where("j % 2 = 0").select(F.col("j").alias("job_id"), "pos")
    return vl.supplied_matches(m.unionByName(more).drop("v"), t.select(F.col("j").alias("job_id"), "pos"), current)


def _answers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    level = F.when(k % 7 == 2, 3).otherwise(1)
    item = F.struct(F.lit("C1").alias("competence_cible"), F.lit("A1").alias("competence_actuelle"), F.lit("Reconnue").alias("statut"), level.alias("niveau_actuel"), F.lit(2).alias("niveau_cible"), F.lit(1).alias("ecart_niveau"), F.lit("niveau_insuffisant").alias("statut_niveau"), F.col("s_name").alias("recommandation_formation"))
    g = F.when(k % 7 == 1, 2.0).otherwise(0.5)
    answer = F.to_json(F.struct(F.lit("E1").alias("emploi_cible_retenu"), g.alias("g_epfq"), F.lit(0.25).alias("gs_epfq"), F.lit(1.5).alias("ecart_moyen"), F.lit(0.5).alias("r_epfq"), F.when(k % 7 == 3, F.array().cast("array<struct<x:int>>").cast("string")).otherwise(None).alias("x"), F.array(item).alias("correspondances")))
    answer = F.when(k % 7 == 0, "{").otherwise(answer)
    one, two = F.create_map(F.lit("A1"), F.lit(1)), F.create_map(F.lit("C1"), F.lit(2))
    return table(s, d, "supplier").select(k.alias("job_id"), answer.alias("answer"), one.alias("current"), F.create_map(F.lit("E1"), two).alias("targets"))


def val10_answers(s, d):
    return en.checked_answers(_answers(s, d)).select("job_id", "state", "target", "g", "ecart_moyen")


def or02_transferred(s, d):
    return en.transferred(en.checked_answers(_answers(s, d))).select("job_id", "target", "g", "r", "competence_cible", "competence_actuelle", "niveau_actuel", "ecart_niveau", "recommandation_formation")


def val11_prepared(s, d):
    return rl.prepared_skills(_corpus(s, d)).select("code", "intitule", F.col("skill_pos").cast("long").alias("skill_pos"), "skill")


def val12_unknown(s, d):
    known = table(s, d, "supplier").select(F.concat(F.lit("M"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 4, "0")).alias("code")).distinct()
    return rl.unknown_codes(rl.edges(relation_rows(s, d)), known)


def jn07_orphans(s, d):
    """Jobs of current skills that no order's customer is: membership by a semi-join, orphans by an anti-join."""
    known = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    c = table(s, d, "customer").select("c_custkey")
    return c.join(known, "c_custkey", "left_semi").withColumn("kind", F.lit("membre")).unionByName(c.join(known, "c_custkey", "left_anti").withColumn("kind", F.lit("orphelin")))


def ag12_titles(s, d):
    rows = relation_rows(s, d).withColumn("intitule_emploi_b", F.concat("intitule_emploi_b", F.when(F.col("row") % 10 == 0, " bis").when(F.col("row") % 10 == 1, "!").otherwise("")))
    return rl.titles(rows).select("code", F.array_join("titles", "|").alias("titles"), "n_titles")


def st02_truth_union(s, d):
    e = rl.edges(relation_rows(s, d))
    return e.where("label").unionByName(e.where("not label")).select("code_a", "code_b").distinct()


def st03_distinct_order(s, d):
    """Different market segments of a nation in the order in which they are first seen."""
    c = table(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("at"))
    kept = F.array_sort(F.collect_list(F.struct("at", "c_mktsegment")))
    return c.groupBy("c_nationkey").agg(F.array_join(F.transform(kept, lambda x: x["c_mktsegment"]), "|").alias("segments"))


# Block products and campaigns


def jn04_matrix(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("dense"))
    return pr.matrix(v, 6)


def _model():
    """A stand-in for a service: answers by the digits of the two codes, and fails for some."""
    import re

    def ask(prompt: str) -> str:
        a, b = (int(x) for x in re.findall(r"Métier M(\d{4}) — ", prompt)[:2])
        if (a + b) % 7 == 0:
            raise ConnectionError("no route")
        return '{"decision": "%s"}' % ("peut-être" if (a + b) % 11 == 0 else "Oui" if (a * b) % 3 == 0 else "Non")

    return ask


def _campaign(s: SparkSession, d: str) -> DataFrame:
    edges = rl.edges(relation_rows(s, d))
    corpus = rl.codes(edges).select(F.col("code").alias("code_rome"), F.concat(F.lit("Title "), F.col("code")).alias("intitule"), F.lit("x\n\ny").alias("competences"))
    return cp.decisions(cp.pair_prompts(edges, corpus), _model)


def or04_decisions(s, d):
    return _campaign(s, d).select("code_a", "code_b", "relation_reference", "decision", "statut")


def or04_campaign(s, d):
    return cp.decision_metrics(_campaign(s, d)).select("paires", "erreurs", "tp", "fp", "fn", "tn", *(r6(x) for x in ("accuracy", "precision", "recall", "f1")))


QUERIES = {f.__name__: f for f in (
    fn01_clean, fn02_decompose, fn03_title_key, fn04_token_key, fn06_skill_label, fn07_fragments, fn08_level, fn09_characters, fn10_optional, fn16_l2, fn17_sparse_rows, fn19_fingerprint, prj01_skill_text,
    src05_table, src05_findings, src06_sections, src06_findings, src07_sections, src08_titles, src08_findings, src09_native_text, src10_sheets, val01_columns, val05_role, val08_guards, val09_supplied,
    val10_answers, or02_transferred, val11_prepared, val12_unknown, jn07_orphans, ag12_titles, st02_truth_union, st03_distinct_order, jn04_matrix, or04_decisions, or04_campaign,
)}

_T5 = """WITH r AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderpriority AS p, CASE WHEN o_orderkey % 11 = 0 THEN 'Guru' WHEN o_orderkey % 4 = 0 THEN 'Expertise' WHEN o_orderkey % 4 = 1 THEN 'MAITRISE' ELSE 'application' END AS l,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 4 WHEN o_orderkey % 4 = 1 THEN 3 ELSE 2 END AS n, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'Skill ' || o_orderkey END AS t, o_orderkey % 13 = 0 AS two FROM orders WHERE o_custkey % 5 != 0)"""
_CODE = "chr(CAST(65 + p_partkey // 10000 AS INTEGER)) || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0')"
_SHEET = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS doc, c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 4 END AS n,
    CASE WHEN c_custkey % 11 = 0 THEN 'section_absente' WHEN c_custkey % 7 = 0 OR c_custkey % 13 = 0 THEN 'x' END AS bad FROM customer)"""
_DECIDED = f"""{_RL}, e AS (SELECT lo AS code_a, hi AS code_b, y, CAST(substr(lo, 2) AS INTEGER) AS a, CAST(substr(hi, 2) AS INTEGER) AS b FROM f WHERE y != '?'),
    z AS (SELECT code_a, code_b, y AS relation_reference, CASE WHEN (a + b) % 7 = 0 OR (a + b) % 11 = 0 THEN 'erreur' ELSE 'succes' END AS statut, CASE WHEN (a + b) % 7 = 0 OR (a + b) % 11 = 0 THEN '' WHEN (a * b) % 3 = 0 THEN 'Oui' ELSE 'Non' END AS decision FROM e)"""
ORACLE_SQL = {
    "fn01_clean": "SELECT p_partkey, trim(regexp_replace('  ' || p_name || chr(9) || ' ' || p_brand || ' ', '\\s+', ' ', 'g')) AS text FROM part",
    "fn02_decompose": "SELECT p_partkey, upper(strip_accents('Éçà ô-' || p_name || ' Œuvre')) AS text FROM part",
    "fn03_title_key": "SELECT p_partkey, trim(regexp_replace(lower(strip_accents(' Élève/' || p_name || '--' || p_brand || '!')), '[^a-z0-9]+', ' ', 'g')) AS text FROM part",
    "fn04_token_key": """WITH w AS (SELECT p_partkey, regexp_extract_all(upper('Niveaux d’' || p_name || 's / bus ' || p_brand), '[A-Z0-9]+') AS w FROM part)
        SELECT p_partkey, array_to_string(list_transform(w, lambda x: CASE WHEN x = 'NIVEAUX' THEN 'NIVEAU' WHEN length(x) > 3 AND x LIKE '%S' THEN x[:-2] ELSE x END), ' ') AS singular, array_to_string(w, ' ') AS heading FROM w""",
    "fn06_skill_label": "SELECT p_partkey, trim(p_name) || CASE WHEN p_partkey % 3 = 2 THEN ' transition' ELSE '' END AS text FROM part",
    "fn07_fragments": "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' semi-' ELSE ' a/' END || p_brand || ' end' AS text FROM part",
    "fn08_level": "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 4 THEN NULL ELSE p_partkey % 5 + 1 END AS INTEGER) AS niveau FROM part",
    "fn09_characters": """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS doc, c_custkey AS k, c_mktsegment AS seg FROM customer)
        SELECT doc, 0::BIGINT AS line_no, '' AS bold_text, 'Talentsoft x' AS plain_text, '' AS right_text, false AS coloured FROM c UNION ALL SELECT doc, 1, 'COMPÉTENCES DIGITALES', '', '', false FROM c WHERE k % 11 != 0
        UNION ALL SELECT doc, 2, '', '', '', true FROM c UNION ALL SELECT doc, 3, 'Skill ' || k || ' semi-', l, l, false FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 'inconnu' WHEN k % 2 = 0 THEN 'Maîtrise' ELSE 'Expertise' END AS l FROM c)
        UNION ALL SELECT doc, 4, 'auto title', '', '', false FROM c UNION ALL SELECT doc, 5, '', 'Says ' || seg, '', false FROM c UNION ALL SELECT doc, 0, '', '2 sur 3 pages', '', false FROM c
        UNION ALL SELECT doc, 1, CASE WHEN k % 13 = 0 THEN 'Stray bold' ELSE '' END, CASE WHEN k % 13 = 0 THEN '' ELSE 'and more' END, '', false FROM c UNION ALL SELECT doc, 2, 'Second', 'Application', 'Application', false FROM c
        UNION ALL SELECT doc, 3, 'Compétences métier', '', '', false FROM c UNION ALL SELECT doc, 4, 'Not this', 'Expertise', 'Expertise', false FROM c""",
    "fn10_optional": "SELECT p_partkey, CASE WHEN p_partkey % 3 != 0 THEN trim(p_brand) END AS text FROM part",
    "fn16_l2": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[-1] / sqrt(list_dot_product(v, v)), 6) AS last, 1.0::DOUBLE AS square FROM v",
    "fn17_sparse_rows": r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2)) AS ws FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))
        SELECT CAST(doc_id AS VARCHAR) AS id, len(ws) AS n, list_min(ws) AS first, list_max(ws) AS last, round(sqrt(len(ws)::DOUBLE), 6) AS total FROM w WHERE len(ws) > 0""",
    "fn19_fingerprint": f"""WITH c AS (SELECT {_CODE} AS code, p_type, p_brand FROM part), l AS (SELECT code, 0 AS i, trim(p_type) AS t FROM c UNION ALL SELECT code, 1, trim(p_brand) FROM c)
        SELECT sha256(string_agg(code || chr(9) || t, chr(10) ORDER BY code, i)) AS fingerprint FROM l""",
    "prj01_skill_text": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_name || '.  ' || p_type ELSE p_name END AS text FROM part",
    "src05_table": f"{_T5} SELECT doc, k AS row_no, t AS intitule, p AS description, CAST(n AS INTEGER) AS niveau FROM r WHERE NOT two AND t != '' AND n IS NOT NULL",
    "src05_findings": f"""{_T5} SELECT doc, k AS row_no, 'erreur' AS severity, CASE WHEN two THEN 'structure_inexploitable' WHEN t = '' THEN 'association_ambigue' ELSE 'niveau_inconnu' END AS code,
        CASE WHEN two THEN 'trois cellules sont attendues, 2 trouvées' WHEN t = '' THEN 'détails ou niveau sans intitulé de compétence' ELSE 'compétence « ' || t || ' »: niveau non reconnu « Guru »' END AS message FROM r WHERE two OR t = '' OR n IS NULL""",
    "src06_sections": f"""{_SHEET} SELECT doc, 1::BIGINT AS pos, 'Skill ' || k || ' semi-auto title' AS intitule, 'Says ' || seg || ' and more' AS description, CAST(n AS INTEGER) AS niveau FROM c WHERE bad IS NULL
        UNION ALL SELECT doc, 2, 'Second', NULL, 2 FROM c WHERE bad IS NULL""",
    "src06_findings": f"""{_SHEET} SELECT doc, 'section_absente' AS code, 1 AS page FROM c WHERE k % 11 = 0 UNION ALL SELECT doc, 'niveau_inconnu', 1 FROM c WHERE k % 11 != 0 AND k % 7 = 0
        UNION ALL SELECT doc, 'association_ambigue', 1 FROM c WHERE k % 11 != 0 AND k % 7 = 0 UNION ALL SELECT doc, 'association_ambigue', 1 FROM c WHERE k % 11 != 0 AND k % 7 = 0
        UNION ALL SELECT doc, 'association_ambigue', 2 FROM c WHERE k % 11 != 0 AND (k % 13 = 0 OR k % 7 = 0)""",
    "src07_sections": """WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey AS no, o_orderkey % 9 AS m, o_orderpriority AS p FROM orders),
        t AS (SELECT *, CASE m WHEN 0 THEN 'Savoir-faire principaux' WHEN 2 THEN 'Domaines d’expertise' WHEN 1 THEN '' END AS turn FROM l),
        a AS (SELECT *, last_value(turn IGNORE NULLS) OVER w AS act, sum(CASE WHEN turn IS NOT NULL OR m != 6 THEN 1 ELSE 0 END) OVER w AS isl FROM t WINDOW w AS (PARTITION BY doc ORDER BY no)),
        g AS (SELECT doc, isl, act, min(no) AS pos, bool_or(m != 6) AS opened, string_agg(CASE m WHEN 6 THEN 'suite ' || no WHEN 7 THEN 'x Transition écologique' ELSE p || ' ' || no END, ' ' ORDER BY no) AS t FROM a WHERE turn IS NULL AND act != '' GROUP BY doc, isl, act)
        SELECT doc, pos, regexp_replace(t, '\\s*Transition écologique$', '') AS intitule, act AS source_section FROM g WHERE opened""",
    "src08_titles": """SELECT CAST(s_suppkey AS VARCHAR) AS doc, CASE WHEN s_suppkey % 4 = 0 THEN 'EMPLOI ' || s_suppkey || ' DEUX D07' ELSE 'EMPLOI ' || s_suppkey END AS title, s_suppkey % 2 = 0 AS by_filename
        FROM supplier WHERE s_suppkey % 4 IN (0, 1) OR s_suppkey % 4 = 2 AND s_suppkey % 3 = 0""",
    "src08_findings": "SELECT CAST(s_suppkey AS VARCHAR) AS doc, CASE WHEN s_suppkey % 4 = 3 THEN 'structure_inexploitable' ELSE 'association_ambigue' END AS code FROM supplier WHERE s_suppkey % 4 = 3 OR s_suppkey % 4 = 2 AND s_suppkey % 3 != 0",
    "src09_native_text": r"SELECT doc_id AS doc, CAST(length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS BIGINT) AS n_alnum, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) >= 20 AS readable FROM documents",
    "src10_sheets": "SELECT c_custkey AS doc, 'M' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS code, 'METIER ' || c_mktsegment AS title, 'A ' || c_mktsegment || '|B ' || c_custkey || ' suite' AS competences FROM customer",
    "val01_columns": """SELECT n_name AS file, CAST(NULL AS BIGINT) AS row, 'emploi_type' AS "column", 'colonne obligatoire absente' AS rule FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_name, NULL, 'competence_niveau', 'colonne obligatoire absente' FROM nation WHERE n_nationkey % 4 = 0
        UNION ALL SELECT n_name, NULL, 'competence_intitule', 'le fichier doit contenir au moins une compétence' FROM nation WHERE n_nationkey % 5 = 0""",
    "val05_role": f"{DATA_SQL['val02_row_diagnostics']} UNION ALL SELECT file, row, 'emploi_type', 'ce fichier doit décrire un emploi de type ''actuel''' FROM w WHERE row = 2 AND role = 'cible'",
    "val08_guards": """SELECT c_custkey AS job_id, 'valeur exacte attendue: ''actuel'' ou ''cible''' AS rule FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT c_custkey, 'le fichier doit contenir au moins une compétence' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT NULL, 'aucun emploi de type ''cible'''""",
    "val09_supplied": """WITH v AS (SELECT vec_id AS v, vec_id // 10 AS j, vec_id % 10 AS pos FROM embeddings), t AS (SELECT * FROM v WHERE j % 2 = 1), m AS (SELECT j - 1 AS ja, j AS jc, pos AS pc, CASE WHEN v % 11 = 0 THEN pos + 10 ELSE pos END AS pa, v FROM t WHERE v % 13 != 0),
        x AS (SELECT ja, jc, pc, pa FROM m UNION ALL SELECT ja, jc, pc, pa FROM m WHERE v % 17 = 0 UNION ALL SELECT ja, jc, 99, pa FROM m WHERE v % 19 = 0), n AS (SELECT ja, jc, pc, count(*) AS n FROM x GROUP BY ALL)
        SELECT j.ja AS job_id_a, t.j AS job_id_c, t.pos AS pos_c, 'absente' AS rule FROM (SELECT DISTINCT ja, jc FROM x) j JOIN t ON t.j = j.jc WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ja = j.ja AND n.jc = t.j AND n.pc = t.pos)
        UNION ALL SELECT ja, jc, pc, 'dupliquée' FROM n WHERE n > 1 UNION ALL SELECT ja, jc, pc, 'inconnue' FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.j = jc AND t.pos = pc)
        UNION ALL SELECT ja, jc, pc, 'compétence actuelle étrangère' FROM x WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.j = ja AND v.pos = pa AND v.j % 2 = 0)""",
    "val10_answers": """SELECT s_suppkey AS job_id, CASE WHEN s_suppkey % 7 IN (0, 1, 2, 3) THEN 'réponse LLM invalide' ELSE 'succès' END AS state, CASE WHEN s_suppkey % 7 > 3 THEN 'E1' END AS target, CASE WHEN s_suppkey % 7 > 3 THEN 0.5::DOUBLE END AS g, CASE WHEN s_suppkey % 7 > 3 THEN 1.5::DOUBLE END AS ecart_moyen FROM supplier""",
    "or02_transferred": """SELECT s_suppkey AS job_id, 'E1' AS target, 0.5::DOUBLE AS g, 0.5::DOUBLE AS r, 'C1' AS competence_cible, 'A1' AS competence_actuelle, 1 AS niveau_actuel, 1 AS ecart_niveau, s_name AS recommandation_formation FROM supplier WHERE s_suppkey % 7 > 3""",
    "val11_prepared": f"SELECT {_CODE} AS code, p_name AS intitule, 0::BIGINT AS skill_pos, trim(p_type) AS skill FROM part UNION ALL SELECT {_CODE}, p_name, 1, trim(p_brand) FROM part",
    "val12_unknown": f"{_RL} SELECT DISTINCT code FROM (SELECT lo AS code FROM f WHERE y != '?' UNION SELECT hi FROM f WHERE y != '?') WHERE code NOT IN (SELECT 'M' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 4, '0') FROM supplier)",
    "jn07_orphans": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'membre' ELSE 'orphelin' END AS kind FROM customer",
    "ag12_titles": f"""{_RL}, o2 AS (SELECT c.row, c.a, c.b, o.a AS na, o.b AS nb FROM c JOIN o ON c.row = o.row), t AS (SELECT a AS code, 'Title ' || na AS title, 'title ' || na AS norm FROM o2 WHERE a IS NOT NULL
        UNION ALL SELECT b, 'title ' || nb || CASE row % 10 WHEN 0 THEN ' bis' WHEN 1 THEN '!' ELSE '' END, 'title ' || nb || CASE row % 10 WHEN 0 THEN ' bis' ELSE '' END FROM o2 WHERE b IS NOT NULL)
        SELECT code, string_agg(DISTINCT title, '|' ORDER BY title) AS titles, count(DISTINCT norm) AS n_titles FROM t GROUP BY code""",
    "st02_truth_union": f"{_RL} SELECT lo AS code_a, hi AS code_b FROM f WHERE y != '?'",
    "st03_distinct_order": "SELECT c_nationkey, string_agg(s, '|' ORDER BY k) AS segments FROM (SELECT c_nationkey, c_mktsegment AS s, min(c_custkey) AS k FROM customer GROUP BY ALL) GROUP BY c_nationkey",
    "jn04_matrix": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.v, b.v), 6) AS dense FROM v a JOIN v b ON a.vec_id <= b.vec_id",
    "or04_decisions": f"{_DECIDED} SELECT code_a, code_b, relation_reference, decision, statut FROM z",
    "or04_campaign": f"""{_DECIDED}, m AS (SELECT count(*) AS paires, count(*) FILTER (WHERE statut = 'erreur') AS erreurs, count(*) FILTER (WHERE relation_reference = 'Oui' AND decision = 'Oui') AS tp, count(*) FILTER (WHERE relation_reference = 'Non' AND decision = 'Oui') AS fp,
        count(*) FILTER (WHERE relation_reference = 'Oui' AND decision = 'Non') AS fn, count(*) FILTER (WHERE relation_reference = 'Non' AND decision = 'Non') AS tn FROM z)
        SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m""",
}
