"""Running several engines apart from each other, and the contract of categorical (language model) decisions."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Unavailable(RuntimeError):
    """A remote service cannot be reached."""


class InvalidAnswer(ValueError):
    """A language model's answer breaks the contract."""


class RemoteError(RuntimeError):
    """A remote service answered with an error."""


# States of an engine's run, and the keys of an answer.
STATES = ((Unavailable, "indisponible"), (InvalidAnswer, "réponse LLM invalide"), (RemoteError, "erreur API"), (Exception, "erreur"))
SUCCESS = "succès"
ANSWER_KEYS = frozenset({"emploi_cible_retenu", "g_epfq", "gs_epfq", "ecart_moyen", "r_epfq", "correspondances"})
ITEM_KEYS = frozenset({"competence_cible", "competence_actuelle", "statut", "niveau_actuel", "niveau_cible", "ecart_niveau", "statut_niveau", "recommandation_formation"})
LEVEL_STATES = frozenset({"absente", "niveau_non_renseigne", "niveau_insuffisant", "niveau_suffisant"})


@dataclass
class Execution:
    model: str
    state: str
    seconds: float
    result: DataFrame | None = None
    error: str = ""


def run_engines(engines: Mapping[str, Callable[[], DataFrame]]) -> list[Execution]:
    """Each engine by itself; Spark is lazy, so its result is computed (and kept) inside the isolation."""
    done = []
    for model, start in engines.items():
        began = time.perf_counter()
        try:
            result = start().persist(StorageLevel.MEMORY_AND_DISK)
            result.count()
        except Exception as e:
            cause = _cause(e)
            state = next(s for kind, s in STATES if isinstance(cause, kind))
            done.append(Execution(model, state, time.perf_counter() - began, error=str(cause)))
        else:
            done.append(Execution(model, SUCCESS, time.perf_counter() - began, result))
    return done


def _cause(error: Exception) -> Exception:
    """The engine's own error where it was raised inside a worker and arrives as text."""
    text = str(error)
    for kind in (Unavailable, InvalidAnswer, RemoteError):
        if isinstance(error, kind):
            return error
        mark = f"{kind.__name__}: "
        if mark in text:
            return kind(text.split(mark, 1)[1].split("\n", 1)[0])
    return error


def check_answer(text: object, current: Mapping[str, int | None], targets: Mapping[str, Mapping[str, int | None]]) -> dict:
    """The parsed answer, or :class:`InvalidAnswer`.

    ``current``: label to level of the current skills; ``targets``: job label to
    (skill label to level). Levels must be copied exactly, each skill of the chosen
    target decided exactly once.
    """
    def need(ok: bool, why: str) -> None:
        if not ok:
            raise InvalidAnswer(why)

    def whole(x: object) -> bool:
        return isinstance(x, int) and not isinstance(x, bool)

    need(isinstance(text, str), "the answer is no text")
    try:
        answer = json.loads(text)
    except json.JSONDecodeError as e:
        raise InvalidAnswer("the answer is no JSON") from e
    need(isinstance(answer, dict) and set(answer) == ANSWER_KEYS, "the answer needs exactly its six keys")
    job = answer["emploi_cible_retenu"]
    need(isinstance(job, str) and job in targets, "the chosen target was not offered")
    for key in ("g_epfq", "gs_epfq", "r_epfq", "ecart_moyen"):
        x = answer[key]
        need(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x >= 0 and (key == "ecart_moyen" or x <= 1), f"{key} is out of bounds")
    need(isinstance(answer["correspondances"], list), "correspondances is no list")
    left = dict(targets[job])
    for item in answer["correspondances"]:
        need(isinstance(item, dict) and set(item) == ITEM_KEYS, "a decision needs exactly its eight keys")
        skill, mine = item["competence_cible"], item["competence_actuelle"]
        need(isinstance(skill, str) and skill in left, "a target skill is unknown or repeated")
        need(item["statut"] in ("Reconnue", "Absente"), "the status is unknown")
        if item["statut"] == "Absente":
            need(mine == "N/A", "an absent skill names a current one")
            level = None
        else:
            need(isinstance(mine, str) and mine in current, "the current skill was not offered")
            level = current[mine]
        need(item["niveau_actuel"] == level and item["niveau_cible"] == left.pop(skill), "levels are not copied exactly")
        gap = item["ecart_niveau"]
        need(gap is None or whole(gap) and gap >= 0, "the gap is no whole number from 0")
        need(item["statut_niveau"] in LEVEL_STATES, "the level status is unknown")
        need(isinstance(item["recommandation_formation"], str) and bool(item["recommandation_formation"].strip()), "the recommendation is empty")
    need(not left, "a target skill is not decided")
    return answer


def checked_answers(answers: DataFrame) -> DataFrame:
    """answers (job_id, answer, current: map, targets: map of maps) with state, error and parsed fields; a bad answer becomes a row, not a failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for job, text, current, targets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    a = check_answer(text, dict(current), {k: dict(v) for k, v in targets})
                    rows.append((job, SUCCESS, None, a["emploi_cible_retenu"], *(float(a[k]) for k in ("g_epfq", "gs_epfq", "ecart_moyen", "r_epfq")), json.dumps(a["correspondances"], ensure_ascii=False)))
                except InvalidAnswer as e:
                    rows.append((job, "réponse LLM invalide", str(e), None, None, None, None, None, None))
            kinds = (pa.int64(), *(pa.string(),) * 3, *(pa.float64(),) * 4, pa.string())
            names = ["job_id", "state", "error", "target", "g", "gs", "ecart_moyen", "r", "correspondances"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    fields = answers.select(F.col("job_id").cast("long"), "answer", "current", "targets")
    return fields.mapInArrow(run, "job_id long, state string, error string, target string, g double, gs double, ecart_moyen double, r double, correspondances string")


def transferred(checked: DataFrame) -> DataFrame:
    """Decisions as the model gave them, one row a target skill; nothing is computed anew."""
    item = "array<struct<competence_cible:string,competence_actuelle:string,statut:string,niveau_actuel:int,niveau_cible:int,ecart_niveau:int,statut_niveau:string,recommandation_formation:string>>"
    rows = checked.where(F.col("state") == SUCCESS).withColumn("c", F.explode(F.from_json("correspondances", item)))
    return rows.select("job_id", "target", "g", "gs", "ecart_moyen", "r", "c.*")


def prompt(pairs: DataFrame) -> DataFrame:
    """job_id and the labelled text of a job's choices: pairs (job_id, kind A/E/C, label_no, text)."""
    line = F.concat(F.lit("["), F.col("kind"), F.col("label_no").cast("string"), F.lit("] "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("kind", "label_no", line.alias("line"))))
    return pairs.groupBy("job_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))
