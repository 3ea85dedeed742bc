"""Schemas, parameters and fixed values of the skill-matching model."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import lcm

from pyspark.sql import types as T

JOBS = T.StructType([
    T.StructField("job_id", T.LongType(), False), T.StructField("ord", T.LongType(), False), T.StructField("role", T.StringType(), False),
    T.StructField("intitule", T.StringType()), T.StructField("effectif", T.IntegerType()), T.StructField("source", T.StringType()),
])
SKILLS = T.StructType([
    T.StructField("job_id", T.LongType(), False), T.StructField("pos", T.LongType(), False), T.StructField("skill_id", T.StringType()),
    T.StructField("intitule", T.StringType(), False), T.StructField("description", T.StringType()), T.StructField("niveau", T.IntegerType()),
    T.StructField("source_section", T.StringType()),
])
DIAGNOSTICS = T.StructType([
    T.StructField("severity", T.StringType()), T.StructField("code", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("source", T.StringType()), T.StructField("row", T.LongType()),
])

# Sheet and columns of an input workbook, levels, and texts of the result tables.
SHEET = "Competences"
REQUIRED_COLUMNS = ("emploi_intitule", "emploi_type", "emploi_effectif", "competence_intitule", "competence_niveau")
OPTIONAL_COLUMNS = ("emploi_id", "competence_id", "competence_description")
ROLES = ("actuel", "cible")
LEVELS = {"sensibilisation": 1, "application": 2, "maitrise": 3, "expertise": 4}
NO_TARGET = "Aucun emploi cible ne correspond à cet emploi actuel"
ARBITRATION = "Plusieurs emplois cibles sont ex aequo ; le service RH devra trancher"
RETAINED = "Retenu"
FULL_TRAINING = "Formation complète nécessaire pour acquérir la compétence"
LIGHT_TRAINING = "Formation légère pour progresser d’un niveau"
LONG_TRAINING = "Parcours de formation conséquent"
UNDER_COVERAGE = "couverture inférieure au seuil"
UNDER_BEST = "score global inférieur à la meilleure cible admissible"
NOT_COMPARABLE = "Non calculable, niveau absent"
NOT_GIVEN = "Non renseigné"
IN_OTHER, IN_NONE = "presente_dans_une_autre_cible", "absente_de_toutes_les_cibles"
IN_OTHER_TEXT = "compétence actuelle absente de l'emploi cible sélectionné, mais présente dans une autre cible"
IN_NONE_TEXT = "compétence actuelle non reprise dans les emplois cibles analysés"
WEIGHT_TOLERANCE = 1e-9
GRID_THRESHOLDS = tuple(round(0.2 + 0.1 * i, 1) for i in range(8))
SWEEP_WEIGHTS = tuple(round(1 - 0.1 * i, 1) for i in range(11))


def exact(value: float | int | str | Fraction, name: str) -> Fraction:
    """A number as the rational that its decimal text names."""
    if isinstance(value, bool):
        raise ValueError(f"{name}: a boolean is no number")
    try:
        return value if isinstance(value, Fraction) else Fraction(str(value))
    except (ValueError, ZeroDivisionError) as e:
        raise ValueError(f"{name}: {value!r} is no finite number") from e


@dataclass(frozen=True)
class RunParams:
    """Weights and thresholds of a run; weights lie in [0, 1] and sum to 1, and are never renormalised."""

    dense: Fraction | float = Fraction(2, 3)
    sparse: Fraction | float = Fraction(1, 3)
    similarity: Fraction | float = Fraction(7, 10)
    coverage: Fraction | float = Fraction(7, 10)
    model: str = "default"

    def __post_init__(self):
        for name in ("dense", "sparse", "similarity", "coverage"):
            object.__setattr__(self, name, exact(getattr(self, name), name))
        for name in ("dense", "sparse"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"the {name} weight is outside [0, 1]")
        if abs(float(self.dense + self.sparse) - 1) > WEIGHT_TOLERANCE:
            raise ValueError("the weights do not sum to 1")

    @property
    def integers(self) -> tuple[int, int, int]:
        """Weights as integers over one denominator: (dense, sparse, denominator)."""
        w = lcm(self.dense.denominator, self.sparse.denominator)
        return int(self.dense * w), int(self.sparse * w), w
