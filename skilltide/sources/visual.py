"""Profiles laid out visually: titles in the header and skills told by weight, colour and place of their characters.

Input is one row a line: ``doc``, ``page``, ``line_no``, ``top``, ``x0``, ``width``
and ``height`` (of the page) and ``chars``, an array of (text, x0, x1, font, size,
color). A PDF reader fills it; everything from there on is a plan of windows and
aggregations inside a document. A document with a finding gives diagnostics and
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, decompose, join_fragments, level_of_label, token_key

CHARS = "array<struct<text:string,x0:double,x1:double,font:string,size:double,color:array<double>>>"

# Section, headings and repeated lines of the layout, codes and texts of findings, and geometry.
SECTION = "COMPETENCES DIGITALES"
TOP_LEVEL = r"^COMPETENCES\s+.+(?:\s+X)?$"
CHROME = r"^(?:TALENTSOFT |HTTP://|HTTPS://|\d+\s+SUR\s+\d+(?:\s|$))"
NO_TITLE_START = r"^(?:RUBRIQUES|TALENTSOFT)"
REFERENCE_SUFFIX = r"(?i)\s*[-–—]\s*[A-Z]\d+\s*$"
DARK, GAP, LEFT, RIGHT, HEADER, TITLE_RIGHT, TITLE_SIZE, SAME_SIZE, LINE_GAP, SAME_X = 0.05, 0.8, 0.25, 0.72, 0.25, 0.65, 9.0, 0.1, 30.0, 4.0
ABSENT, AMBIGUOUS, UNKNOWN_LEVEL, UNUSABLE = "section_absente", "association_ambigue", "niveau_inconnu", "structure_inexploitable"


def is_black(char: Column) -> Column:
    """No colour, or no component above a twentieth."""
    color = char["color"]
    return color.isNull() | F.coalesce(F.array_max(color) <= DARK, F.lit(False))


def is_bold(char: Column) -> Column:
    return F.upper(F.coalesce(char["font"], F.lit(""))).contains("BOLD")


def picked(chars: Column, black: bool, bold: bool) -> Column:
    return F.filter(chars, lambda c: (is_black(c) == black) & (is_bold(c) == bold))


def is_coloured(chars: Column) -> Column:
    """Whether all visible characters are coloured: the line names a category."""
    visible = F.filter(chars, lambda c: F.trim(c["text"]) != "")
    return (F.size(visible) > 0) & ~F.exists(visible, is_black)


def chars_text(chars: Column) -> Column:
    """Text of characters; a gap between two of them is a space."""
    start = F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("x"))

    def add(done: Column, c: Column) -> Column:
        far = F.coalesce(c["x0"] - done["x"] > GAP, F.lit(False)) & (F.trim(c["text"]) != "")
        return F.struct(F.concat(done["t"], F.when(far, F.lit(" ")).otherwise(F.lit("")), F.coalesce(c["text"], F.lit(""))).alias("t"), F.coalesce(c["x1"], done["x"]).alias("x"))

    return clean(F.aggregate(chars, start, add)["t"])


def _texts(lines: DataFrame) -> DataFrame:
    """Lines with their text and what their characters tell, without the characters."""
    bold = picked(F.col("chars"), True, True)
    right = F.filter("chars", lambda c: ~is_bold(c) & (c["x0"] >= F.col("width") * RIGHT))
    return lines.withColumns({
        "text": chars_text(F.col("chars")), "bold_text": chars_text(bold), "bold_size": F.array_max(F.transform(bold, lambda c: c["size"])),
        "plain_text": chars_text(picked(F.col("chars"), True, False)), "right_text": chars_text(right), "coloured": is_coloured(F.col("chars")),
    }).drop("chars")


def visual_lines(lines: DataFrame) -> DataFrame:
    """Lines with their text, its key and what their characters tell; lines without text go."""
    return _texts(lines).where("text != ''").withColumn("key", decompose("text"))


def _finding(frame: DataFrame, code: str, message: Column) -> DataFrame:
    return frame.select("doc", F.lit(code).alias("code"), message.alias("message"), F.col("page").cast("int").alias("page"))


def _section(lines: DataFrame) -> DataFrame:
    """Every line with its kind (null outside the section), the skill it belongs to and its finding; documents meet once, by windows."""
    doc = Window.partitionBy("doc")
    by = doc.orderBy("page", "line_no")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("page", "line_no")
    v = _texts(lines).withColumns({"key": decompose("text"), "niveau": level_of_label(F.col("right_text"))})
    v = v.withColumn("heading", (F.col("text") != "") & (F.col("x0") <= F.col("width") * LEFT) & (F.col("bold_text") != ""))
    v = v.withColumn("opens", F.col("heading") & (F.regexp_replace("key", " X$", "") == SECTION)).withColumn("ends", F.col("heading") & (F.col("key") != SECTION) & F.col("key").rlike(TOP_LEVEL))
    v = v.withColumn("inside", (F.col("text") != "") & ~F.col("key").rlike(CHROME)).drop("text", "key", "heading", "x0", "width")

    s = v.withColumn("line", F.row_number().over(by)).withColumns({"start": F.max(F.when(F.col("opens"), place)).over(doc), "first_page": F.min("page").over(doc)})
    s = s.withColumn("inside", F.col("inside") & F.coalesce(place > F.col("start"), F.lit(False)))
    s = s.withColumn("stop", F.min(F.when(F.col("inside") & F.col("ends"), place)).over(doc))
    kind = F.when(F.col("niveau").isNotNull(), "level").when(F.col("bold_text") != "", "title").when(F.col("plain_text") != "", "text")
    s = s.withColumn("kind", F.when(F.col("inside") & ~F.col("coloured") & F.coalesce(place < F.col("stop"), F.lit(True)), kind))
    level = F.coalesce(F.col("kind") == "level", F.lit(False))
    s = s.withColumns({"island": F.sum(F.when(level, 1).otherwise(0)).over(by), "levels": F.count_if(level).over(doc), "texts": F.count_if(F.col("kind") == "text").over(before)})
    described = F.col("texts") > F.coalesce(F.max(F.when(level, F.col("texts"))).over(by), F.lit(0))
    s = s.withColumn("described", described)

    def found(code: str, message: Column, page: str = "page") -> Column:
        return F.struct(F.lit(code).alias("code"), message.alias("message"), F.col(page).cast("int").alias("page"))

    of_line = F.when(level & (F.col("bold_text") == ""), found(AMBIGUOUS, F.lit("un niveau reconnu n'est associé à aucun intitulé noir en gras")))
    of_line = of_line.when(F.expr("kind = 'title' and right_text != ''"), found(UNKNOWN_LEVEL, F.format_string("niveau non reconnu « %s » pour la compétence « %s »", "right_text", "bold_text")))
    of_line = of_line.when(F.expr("kind = 'title' and right_text = '' and (island = 0 or described)"), found(AMBIGUOUS, F.format_string("intitulé en gras sans niveau reconnu ni association certaine: « %s »", "bold_text")))
    of_line = of_line.when(F.expr("kind = 'text' and island = 0"), found(AMBIGUOUS, F.format_string("description sans compétence associée: « %s »", "plain_text")))
    of_doc = F.when(F.col("start").isNull(), found(ABSENT, F.lit("la section attendue « COMPÉTENCES DIGITALES » est absente"), "first_page"))
    of_doc = of_doc.when(F.col("levels") == 0, found(UNUSABLE, F.lit("la rubrique « COMPÉTENCES DIGITALES » ne contient aucune compétence exploitable"), "start.page"))
    s = s.withColumns({"of_line": of_line, "of_doc": F.when(F.col("line") == 1, of_doc)})
    return s.withColumn("good", ~F.max(F.col("of_line").isNotNull() | F.col("of_doc").isNotNull()).over(doc))


def section_skills(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skills, diagnostics): doc, pos, intitule, description, niveau of the section's skills.

    A level at the right opens a skill whose title is the line's bold text; bold
    lines go on with the title, plain ones with the description, over pages; the
    next heading of the top level ends the section.
    """
    s = _section(lines)
    diagnostics = s.select("doc", F.explode(F.array_compact(F.array("of_line", "of_doc"))).alias("f")).select("doc", "f.*")

    def parts(which: Column, text: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(which, F.struct("page", "line_no", F.col(text).alias("t")))))
        return join_fragments(F.transform(ordered, lambda x: x["t"]))

    built = s.where("good and kind is not null and island > 0").groupBy("doc", "island").agg(
        parts(F.col("kind") != "text", "bold_text").alias("intitule"), parts(F.col("kind") == "text", "plain_text").alias("description"), F.max("niveau").alias("niveau")
    )
    return built.select("doc", F.col("island").alias("pos"), "intitule", F.nullif("description", F.lit("")).alias("description"), "niveau"), diagnostics


def _header_title(text: Column) -> Column:
    """Without the lone mark after a sheet's code."""
    return F.regexp_replace(clean(text), r"(?i)(\b[A-Z]\d{2,4})\s+v$", "$1")


def header_titles(lines: DataFrame, filenames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(titles, diagnostics): doc, title, by_filename of documents with filenames (doc, file).

    Candidates are the bold header lines of the largest size, and neighbouring ones
    joined. Of several the one whose key equals that of the file's name is taken.
    """
    v = visual_lines(lines).where((F.col("page") == 1) & (F.col("top") <= F.col("height") * HEADER) & (F.col("x0") <= F.col("width") * TITLE_RIGHT) & (F.col("bold_size") >= TITLE_SIZE))
    v = v.where(~F.col("key").rlike(NO_TITLE_START))
    v = v.join(v.groupBy("doc").agg(F.max("bold_size").alias("largest")), "doc").where(F.abs(F.col("bold_size") - F.col("largest")) < SAME_SIZE)
    by = Window.partitionBy("doc").orderBy("top", "line_no")
    apart = (F.col("top") - F.lag("top").over(by) > LINE_GAP) | (F.abs(F.col("x0") - F.lag("x0").over(by)) > SAME_X)
    v = v.withColumn("cut", F.when(apart, 1).otherwise(0)).withColumn("island", F.sum("cut").over(by))
    pieces = F.array_sort(F.collect_list(F.struct("top", "line_no", F.col("text").alias("t"))))
    joined = v.groupBy("doc", "island").agg(pieces.alias("p")).where("size(p) > 1").select("doc", _header_title(join_fragments(F.transform("p", lambda x: x["t"]))).alias("title"))
    every = v.select("doc", _header_title(F.col("text")).alias("title")).unionByName(joined).distinct()
    every = every.withColumn("keys", F.array(token_key(F.col("title")), token_key(F.regexp_replace("title", REFERENCE_SUFFIX, ""))))

    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?i)\.pdf$", ""), REFERENCE_SUFFIX, "")
    wanted = filenames.select("doc", "file", token_key(stem).alias("reference"))
    same = F.expr("reference != '' and array_contains(keys, reference)")
    facts = wanted.join(every, "doc", "left").groupBy("doc", "file").agg(
        F.count("title").alias("n"), F.min("title").alias("only"), F.count_if(same).alias("n_same"), F.min(F.when(same, F.col("title"))).alias("named"), F.array_sort(F.collect_set("title")).alias("all")
    )
    title = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_same") == 1, F.col("named"))
    titles = facts.withColumn("title", title).where("title is not null").select("doc", "title", (F.col("n") > 1).alias("by_filename"))
    page = facts.withColumn("page", F.lit(1))
    several = F.format_string("plusieurs intitulés d'emploi sont possibles dans l'en-tête ; nom original « %s » ; intitulés candidats : %s", "file", F.array_join(F.transform("all", lambda x: F.concat(F.lit("« "), x, F.lit(" »"))), ", "))
    none = _finding(page.where("n = 0"), UNUSABLE, F.lit("l'intitulé de l'emploi actuel est introuvable dans l'en-tête"))
    return titles, none.unionByName(_finding(page.where("n > 1 and n_same != 1"), AMBIGUOUS, several))
