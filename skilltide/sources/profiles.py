"""Profiles from text lines: sheets with bullets, section profiles and tables, as distributed plans.

PDF geometry stays in an adapter (no PDF library is assumed): input is one row a
line, ``doc``, ``line_no``, ``text`` and, where known, ``bold``; or one row a table
row. Sections and bullets are found by windows inside a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.validation import Finding, InvalidInput
from ..functions.text import clean, clean_skill, join_fragments, level_of_label, normalize_title, profession_code, token_key

# Headings, bullets and header aliases of the document kinds.
SHEET_BULLET = r"^[•\-–]\s*(.+)$"
SHEET_FOOTER = r"(?i)^\d+\s*/\s*\d+\s*-\s*©"
SHEET_HEADINGS = ("Savoir-faire", "Savoir-faire principaux", "Savoir-faire secondaires", "Savoir-être professionnels", "Savoirs", "Domaines d'expertise", "Normes et procédés", "Techniques professionnelles")
PROFILE_BULLET = r"^[•●▪◦\-–—]\s*(.+)$"
PROFILE_BADGE = r"(?iu)\s*(?:[-–—]|\(|\[)?\s*Transition\s+(?:numérique|écologique)\s*(?:\)|\])?\s*$"
PROFILE_SECTIONS = {"SAVOIR FAIRE PRINCIPAUX": "Savoir-faire principaux", "DOMAINES D EXPERTISE": "Domaines d’expertise"}
PROFILE_STOPS = ("SAVOIR FAIRE SECONDAIRES", "SAVOIRS", "CONTEXTES DE TRAVAIL", "SECTEURS D ACTIVITE", "COMPETENCES", "SAVOIR ETRE PROFESSIONNELS", "NORMES ET PROCEDES", "TECHNIQUES PROFESSIONNELLES")
TABLE_ALIASES = {
    "intitule": ("Intitulé de la compétence", "Compétence digitale", "Compétence", "Intitulé compétence"),
    "description": ("Détails de la compétence", "Détail de la compétence", "Détails compétence", "Détail compétence", "Description de la compétence"),
    "niveau": ("Niveau", "Niveau de la compétence", "Niveau compétence"),
}
LEAST_CHARACTERS = 20
#: An exception names so many findings at most; the table of diagnostics holds them all.
MOST_FINDINGS = 1000


def lines(pages: DataFrame) -> DataFrame:
    """doc, line_no, text of pages (doc, page, text); line numbers go on over pages."""
    split = pages.select("doc", "page", F.posexplode(F.split("text", r"\R|[\x1c-\x1e]")).alias("i", "raw"))
    return split.select("doc", (F.col("page").cast("long") * (1 << 20) + F.col("i")).alias("line_no"), clean(F.col("raw")).alias("text")).where("text != ''")


def has_native_text(pages: DataFrame) -> DataFrame:
    """doc, n_alnum, readable: at least twenty letters or digits; scans are not read."""
    n = F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]", "")))
    return pages.groupBy("doc").agg(n.alias("n_alnum")).withColumn("readable", F.col("n_alnum") >= LEAST_CHARACTERS)


def sheet_profiles(sheet_lines: DataFrame) -> DataFrame:
    """doc, code, title, competences (different, in order) of profession sheets.

    The first line that is a code names the sheet; skills are the bullets between
    "Compétences" and "Contextes de travail"; lines that are no heading go on a bullet.
    """
    by = Window.partitionBy("doc").orderBy("line_no")
    s = sheet_lines.where(~F.col("text").rlike(SHEET_FOOTER)).withColumns({"found": profession_code(F.col("text")), "marker": normalize_title(F.col("text")), "bullet": F.regexp_extract("text", SHEET_BULLET, 1)})
    s = s.withColumn("first_code", F.min(F.when(F.col("found").isNotNull(), F.col("line_no"))).over(Window.partitionBy("doc")))
    turn = F.when(F.col("marker") == "competences", True).when(F.col("marker") == "contextes de travail", False)
    s = s.withColumn("inside", F.coalesce(F.last(turn, ignorenulls=True).over(by), F.lit(False)) & turn.isNull() & ~F.lower("text").startswith("fiche emploi ") & (F.coalesce(F.col("line_no") != F.col("first_code"), F.lit(True))))
    heading = ((F.length("text") < 70) & F.col("text").contains(",")) | F.col("text").isin(*SHEET_HEADINGS)
    starts = F.col("inside") & (F.col("bullet") != "")
    s = s.withColumn("island", F.sum(F.when(starts | turn.isNotNull(), 1).otherwise(0)).over(by))
    s = s.withColumn("piece", F.when(starts, F.col("bullet")).when(F.col("inside") & ~heading, F.col("text")))
    opened = s.groupBy("doc", "island").agg(F.max(starts).alias("opened"), F.min("line_no").alias("at"), F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("line_no", "piece")))).alias("p")).where("opened")
    skill = clean_skill(F.array_join(F.transform("p", lambda x: clean_skill(x["piece"])), " "))
    skills = opened.select("doc", "at", skill.alias("skill")).where("skill != ''").groupBy("doc").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "skill"))), lambda x: x["skill"])).alias("competences"))
    after = s.where(F.col("line_no") > F.col("first_code"))
    stop = after.where(F.col("marker").isin("definition", "competences", "acces a l emploi")).groupBy("doc").agg(F.min("line_no").alias("stop"))
    named = after.join(stop, "doc", "left").where("stop is null or line_no < stop").where(~F.lower("text").rlike("^(fiche emploi|emploi transition|cadre numérique)"))
    title = named.groupBy("doc").agg(F.min_by("text", "line_no").alias("title"))
    code = s.where("line_no = first_code").select("doc", F.col("found").alias("code"))
    docs = sheet_lines.select("doc").distinct()
    return docs.join(code, "doc", "left").join(title, "doc", "left").join(skills, "doc", "left").withColumn("competences", F.coalesce("competences", F.array().cast("array<string>")))


def section_profiles(profile_lines: DataFrame) -> DataFrame:
    """doc, pos, intitule, source_section: bullets of the two sections that count; bold lines and known headings end one; levels stay null."""
    by = Window.partitionBy("doc").orderBy("line_no")
    key = token_key(F.col("text"))
    section = F.try_element_at(F.create_map(*(F.lit(x) for kv in PROFILE_SECTIONS.items() for x in kv)), key)
    bold = F.coalesce(F.col("bold"), F.lit(False)) if "bold" in profile_lines.columns else F.lit(False)
    p = profile_lines.withColumns({"section": section, "bullet": F.regexp_extract("text", PROFILE_BULLET, 1)})
    turn = F.when(F.col("section").isNotNull(), F.col("section")).when(key.isin(*PROFILE_STOPS) | (bold & (F.col("bullet") == "")), F.lit(""))
    p = p.withColumn("turn", turn).withColumn("active", F.nullif(F.last("turn", ignorenulls=True).over(by), F.lit("")))
    p = p.withColumn("island", F.sum(F.when(F.col("turn").isNotNull() | (F.col("bullet") != ""), 1).otherwise(0)).over(by)).where("turn is null and active is not null")
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("bullet") != "", F.col("bullet")).otherwise(F.col("text")).alias("t"))))
    g = p.groupBy("doc", "island", "active").agg(parts.alias("p"), F.min("line_no").alias("pos"), F.max(F.col("bullet") != "").alias("opened")).where("opened")
    label = F.regexp_replace(F.regexp_replace(join_fragments(F.transform("p", lambda x: x["t"])), PROFILE_BADGE, ""), "^[ –—-]+|[ –—-]+$", "")
    return g.select("doc", "pos", label.alias("intitule"), F.col("active").alias("source_section")).where("intitule != ''")


def profile_title(profile_lines: DataFrame, filenames: DataFrame) -> DataFrame:
    """doc, title: the line after the code line, else the file's name without its reference."""
    w = Window.partitionBy("doc").orderBy("line_no")
    p = profile_lines.withColumn("next", F.lead("text").over(w)).where(profession_code(F.col("text")).isNotNull() & F.col("next").isNotNull())
    t = p.groupBy("doc").agg(F.min_by("next", "line_no").alias("title"))
    stem = F.trim(F.regexp_replace(F.regexp_replace("file", r"(?i)\.pdf$", ""), r"(?i)\s*[-–—]\s*[A-Z]\d+\s*$", ""))
    return filenames.join(t, "doc", "left").select("doc", F.coalesce("title", F.nullif(stem, F.lit(""))).alias("title"))


def _table(table_rows: DataFrame) -> DataFrame:
    """Rows below their header with the cells by role: doc, row_no, n_cells, placed, mapped, intitule, description, label, niveau.

    ``mapped``: a header above tells the roles; ``placed``: they are told by position.
    """
    roles = [(name, role) for role, names in TABLE_ALIASES.items() for name in names]
    names = F.array(*(F.struct(token_key(F.lit(name), True).alias("k"), F.lit(role).alias("v")) for name, role in roles))
    cells = F.transform("cells", lambda c: F.coalesce(clean(c), F.lit("")))
    # Headers are few and short: only rows of three short cells are looked up
    t = table_rows.withColumn("cells", cells).withColumn("n_cells", F.size("cells"))
    keys = [token_key(F.get("cells", F.lit(i)), True) for i in range(3)]
    t = t.withColumn("keys", F.array(*keys)).withColumn("known", names)
    t = t.withColumn("roles", F.transform("keys", lambda k: F.get(F.filter("known", lambda e: e["k"] == k), F.lit(0))["v"])).drop("keys", "known")
    whole = (F.col("n_cells") == 3) & F.forall("roles", lambda r: r.isNotNull()) & (F.size(F.array_distinct("roles")) == 3)
    w = Window.partitionBy("doc").orderBy("row_no")
    t = t.withColumn("header", F.coalesce(whole, F.lit(False)))
    t = t.withColumn("map", F.last(F.when(F.col("header"), F.col("roles")), ignorenulls=True).over(w)).withColumn("first", F.row_number().over(w) == 1)
    blank = F.forall("cells", lambda c: c == "")
    t = t.where(~F.col("header") & ~blank)

    def cell(role: str, place: int):
        by_role = F.get("cells", F.array_position("map", F.lit(role)).cast("int") - 1)
        return F.coalesce(F.when(F.col("map").isNotNull(), by_role).otherwise(F.get("cells", F.lit(place))), F.lit(""))

    t = t.withColumns({"intitule": cell("intitule", 0), "description": cell("description", 1), "label": cell("niveau", 2)})
    t = t.withColumn("niveau", level_of_label(F.col("label"))).withColumn("mapped", F.col("map").isNotNull())
    # By position only where no header comes first, the first row names three columns and every row below has a title and a level
    plain = t.where("not mapped").groupBy("doc").agg(
        F.min((F.col("n_cells") == 3) & (F.col("first") | (F.col("intitule") != "") & F.col("niveau").isNotNull())).alias("fits"),
        F.max(F.col("first") & F.forall("cells", lambda c: c != "") & F.col("niveau").isNull()).alias("named"), F.count(F.lit(1)).alias("n"),
    )
    t = t.join(plain.select("doc", (F.col("fits") & F.col("named") & (F.col("n") > 1)).alias("by_place")), "doc", "left")
    t = t.withColumn("placed", ~F.col("mapped") & F.coalesce("by_place", F.lit(False)))
    return t.where("mapped or (placed and not first)").drop("cells", "roles", "map", "header", "first", "by_place")


def table_diagnostics(table_rows: DataFrame) -> DataFrame:
    """doc, row_no, code, message of table rows that are refused, and of tables taken by position (severity ``avertissement``)."""
    t = _table(table_rows)
    shown = F.when(F.col("label") != "", F.col("label")).otherwise("valeur vide")
    code = F.when(F.col("n_cells") != 3, "structure_inexploitable").when(F.col("intitule") == "", "association_ambigue").when(F.col("niveau").isNull(), "niveau_inconnu")
    message = F.when(F.col("n_cells") != 3, F.format_string("trois cellules sont attendues, %d trouvées", "n_cells")).when(F.col("intitule") == "", F.lit("détails ou niveau sans intitulé de compétence")).otherwise(F.format_string("compétence « %s »: niveau non reconnu « %s »", "intitule", shown))
    found = t.withColumn("code", code).where("code is not null").select("doc", "row_no", F.lit("erreur").alias("severity"), "code", message.alias("message"))
    placed = t.where("placed").groupBy("doc").agg(F.min("row_no").alias("row_no"))
    return found.unionByName(placed.select("doc", "row_no", F.lit("avertissement").alias("severity"), F.lit("colonnes_interpretees_par_position").alias("code"), F.lit("colonne 1=nom de compétence, colonne 2=détail, colonne 3=niveau").alias("message")))


def table_profiles(table_rows: DataFrame) -> DataFrame:
    """doc, row_no, intitule, description, niveau of table rows (doc, row_no, cells).

    A row whose three cells are header aliases (after normalisation) maps the columns
    for the rows below it, over pages too; a table without header is taken by position
    if every row reads so. These are the readable rows: :func:`table_diagnostics` has a
    finding for every other one, and :func:`require_tables` refuses tables that have any.
    """
    t = _table(table_rows).where("n_cells = 3 and intitule != '' and niveau is not null")
    return t.select("doc", "row_no", "intitule", F.nullif("description", F.lit("")).alias("description"), "niveau")


def require_tables(table_rows: DataFrame) -> DataFrame:
    """:func:`table_profiles`, or InvalidInput with every finding."""
    found = table_diagnostics(table_rows).where("severity = 'erreur'").orderBy("doc", "row_no").take(MOST_FINDINGS)
    if found:
        raise InvalidInput([Finding(r.doc, r.row_no, r.code, r.message) for r in found])
    return table_profiles(table_rows)


def chained_profiles(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """Strategies in order: a document's table rows, else its section bullets; ``strategy`` tells which."""
    t = tables.select("doc", F.col("row_no").alias("pos"), "intitule", "description", "niveau", F.lit(None).cast("string").alias("source_section"), F.lit("tableau").alias("strategy"))
    s = sections.join(tables.select("doc").distinct(), "doc", "left_anti")
    return t.unionByName(s.select("doc", "pos", "intitule", F.lit(None).cast("string").alias("description"), F.lit(None).cast("int").alias("niveau"), "source_section", F.lit("rome").alias("strategy")))
