"""Text functions as column expressions; only Unicode decomposition needs an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import LEVELS

# The badge that ends a skill line, and formatting of absent values.
TRANSITION_SUFFIX = r"(?iu)\s*transition\s+(num[ée]rique|[ée]cologique)\s*$"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text.cast("string"), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def decompose(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, in capitals."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).upper())


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(T.StringType())
def _ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def normalize_title(text: Column) -> Column:
    """Lower-case ASCII words parted by single spaces: the key by which titles are compared."""
    return F.trim(F.regexp_replace(F.lower(_ascii(clean(text))), "[^a-z0-9]+", " "))


def token_key(text: Column, singular: bool = False) -> Column:
    """Capital words of a heading or header; ``singular`` drops the S of words over three letters."""
    words = F.regexp_extract_all(decompose(clean(text)), F.lit("[A-Z0-9]+"), 0)
    if singular:
        words = F.transform(words, lambda w: F.when(w == "NIVEAUX", "NIVEAU").when((F.length(w) > 3) & w.endswith("S"), F.regexp_replace(w, "S$", "")).otherwise(w))
    return F.array_join(words, " ")


def profession_code(text: Column) -> Column:
    """A letter and four digits after all spaces are gone, else null."""
    code = F.regexp_replace(F.upper(text.cast("string")), r"(?U)\s+", "")
    return F.when(code.rlike(r"^[A-Z]\d{4}$"), code)


def clean_skill(text: Column) -> Column:
    return F.trim(F.regexp_replace(clean(text), TRANSITION_SUFFIX, ""))


def join_fragments(parts: Column) -> Column:
    """Fragments of a title: glued after a hyphen or slash, else parted by a space."""
    def glue(done: Column, part: Column) -> Column:
        return F.when(done == "", part).when(done.rlike("[-/]$"), F.concat(done, part)).otherwise(F.concat(done, F.lit(" "), part))

    return F.aggregate(parts, F.lit(""), glue)


def level_of_label(label: Column) -> Column:
    known = F.create_map(*(F.lit(x).cast("string") if isinstance(x, str) else F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.try_element_at(known, F.lower(decompose(clean(label))))


def optional_text(text: Column) -> Column:
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def skill_text(title: Column, description: Column) -> Column:
    """Title, and the description as it stands where it is not blank."""
    return F.when(F.trim(F.coalesce(description, F.lit(""))) != "", F.concat_ws(". ", title, description)).otherwise(title)


def shown_score(value: Column, weight: float | None = None, part: str | None = None) -> Column:
    absent = F.lit(f"Non calculé, poids {part} = 0" if weight == 0 and part else "N/A")
    return F.when(value.isNotNull(), F.format_string("%.4f", value)).otherwise(absent)


def shown_gap(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", value)).otherwise(F.lit("Non calculable, niveau absent"))


def shown_level(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("Non renseigné"))
