"""Toxicity by noisy-channel deobfuscation.

Texts are restored first: tokens written with leetspeak, spacing or repeated
letters become character lattices, which a Viterbi search decodes under a
character trigram model counted over all documents (the lattice of any other
token has one path: itself). A decision list, learnt from labelled rows, then
scores the restored words; of a token with leet signs the words of its plain
letters count beside the restored ones.

The list holds the words, prefixes and suffixes whose share of toxic rows has a
high lower bound. Near copies of a toxic text are one family (two rows of equal
MinHash values in one of eight bands) and count once, so that words which merely
stand in a copied toxic text prove nothing. A text's score is the noisy-or of its
entries; a text without entries gets the share of toxic rows among such rows.

Only rows of ``labels`` outside the held-out fifth are learnt from, at most about
``sample`` of them; the character model and the scores read every whole text.

Edge cases: null and empty texts have no words and get the score of a text
without entries; without labelled toxic rows that score is 0; null labels teach
nothing; a row with a null id is scored like any other and is not held out;
several labels of one id count once, the largest; repeated rows are scored each.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, released, written
from .shingles import MinHasher, WordHash, shingle_set

#: What a leet sign may stand for (fixed values of the channel model).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Log cost of a substitution, a dropped repetition and a gap that stays between spaced letters.
SUBSTITUTED, REPEATED, GAP = -1.0, -0.7, -2.0
SYMBOLS = 64
_MARKED = re.compile(r"[0-9@$!|+(€£¡]")
_RUN = re.compile(r"([^\W\d_])\1\1")
_SPLIT = re.compile(r"[^\W_](?:[.\-_*~][^\W_]){2,}")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_LETTERS = re.compile(r"[^\W\d_]+")
_CORE = re.compile(r"^[^\w$@!|+(€£¡]+|(?<=[\W_])[$@!|+(€£¡](?=[$@!|+(€£¡])|[\W_]+$")


def symbol(c: str) -> int:
    """Of a lower-case character: 1-26 a-z, 27-36 digits, 37-63 other letters by code, 0 anything else."""
    if "a" <= c <= "z":
        return ord(c) - 96
    if "0" <= c <= "9":
        return ord(c) - 21
    return 37 + ord(c) % 27 if c.isalpha() else 0


@functools.cache
def symbol_table() -> np.ndarray:
    """The symbol of every code point."""
    return np.array([symbol(chr(i)) for i in range(0x110000)], np.uint8)


def _count_trigrams(texts: Iterable[str]) -> np.ndarray:
    points = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total, table = np.zeros(SYMBOLS**3, np.int64), symbol_table()
    for i in range(0, len(points), 1 << 20):
        p = points[max(0, i - 2) : i + (1 << 20)]
        s = table[p].astype(np.int32)
        s = s[~((s == 0) & (np.append(s[1:], 1) == 0))]  # one gap between words
        if len(s) > 2:
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    return total


def character_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """log P(c | a, b) as a cube, counted over the whole texts of all rows; 262,144 numbers however many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0):  # some texts at a time: a batch may hold tens of megabytes
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= 1 << 18:
                    total += _count_trigrams(held)
                    held, size = [], 0
            total += _count_trigrams(held)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], ["code", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[got.column("code").to_numpy()] = got.column("n").to_numpy()
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.02
    return np.log(cube / cube.sum(axis=2, keepdims=True)).astype(np.float32)


def decode(lattice: list[list[tuple[str, float]]], model) -> str:
    """Viterbi: the best string through a lattice of (output, log cost) choices; states are the last two symbols."""
    # A state keeps its path as (path before, output): a lattice of any length takes linear time
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in [*lattice, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for out, cost in choices:
                x, y, s = a, b, score + cost
                for c in out:
                    k = symbol(c)
                    if k or y:  # gaps in a row are one
                        s += model[(x * SYMBOLS + y) * SYMBOLS + k]
                        x, y = y, k
                if (x, y) not in after or after[x, y][0] < s:
                    after[x, y] = (s, (path, out))
        states = after
    path, found = max(states.values(), key=lambda v: v[0])[1], []
    while path is not None:
        path, out = path
        found.append(out)
    return "".join(reversed(found)).strip()


def _choices(token: str) -> list[list[tuple[str, float]]]:
    out, i = [], 0
    while i < len(token):
        c, n = token[i], 1
        while i + n < len(token) and token[i + n] == c:
            n += 1
        if c.isalpha() and n > 1:
            out.append([(c, REPEATED), (c * 2, 0.0 if n == 2 else REPEATED)])
        elif c in LEET and n > 2:  # a stretched sign is one or two letters, or stays as it is
            out.append([(c * n, 0.0), *((x * k, SUBSTITUTED + REPEATED) for x in LEET[c] for k in (1, 2))])
        else:
            out.extend([[(c, 0.0), *((x, SUBSTITUTED) for x in LEET.get(c, ""))]] * n)
        i += n
    return out


class Restorer:
    """Token to its restored words; what was decoded is kept, within a bound."""

    def __init__(self, model: np.ndarray):
        self.model = array("f", model.ravel().tobytes())

    def token(self, token: str) -> list[str]:
        """Of one lower-case token (split at white space)."""
        if token.isalpha():
            return [decode(_choices(token), self.model)] if _RUN.search(token) else [token]
        core = _CORE.sub("", token)
        if _SPLIT.fullmatch(core):
            return self.spaced(re.sub(r"[.\-_*~]", " ", core))
        found = []
        for part in re.split(r"[^\w$@!|+(€£¡]+|_", core):
            if not part or part.isalpha() and not _RUN.search(part):
                found += [part] if part else []
            elif _LETTERS.search(part) and (_MARKED.search(part) or _RUN.search(part)):
                found += _LETTERS.findall(decode(_choices(part), self.model))
                found += [w for w in _LETTERS.findall(part) if len(w) > 3]
            else:
                found += _LETTERS.findall(part)
        return found

    def spaced(self, letters: str) -> list[str]:
        """Of characters with a gap after each: the lattice may join or keep every gap."""
        lattice = []
        for c in letters.split():
            lattice += [[(c, 0.0), *((x, SUBSTITUTED) for x in LEET.get(c, ""))], [("", 0.0), (" ", GAP)]]
        return _LETTERS.findall(decode(lattice[:-1], self.model))

    def words(self, text: str) -> set[str]:
        """All restored words of a whole text."""
        text = text.lower()
        found: set[str] = set()
        for token in set(text.split()):
            found.update(self.token(token))
        for run in _SPACED.findall(text):
            found.update(self.spaced(run))
        return {unicodedata.normalize("NFC", w) for w in found}


def features(word: str) -> list[str]:
    """The word, and its prefixes and suffixes where it is longer."""
    n = len(word)
    return [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if n > k), *(f"{word[-k:]}$" for k in (5, 6) if n > k)]


def lower_bound(pos: float, n: float, z: float = 2.0) -> float:
    """Wilson's lower bound of the share pos / n."""
    if not n:
        return 0.0
    p = pos / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def families(keys: list[list[int]]) -> list[int]:
    """A number for each row's family: rows are one family if they share a key, directly or over other rows."""
    parent = list(range(len(keys)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, own in enumerate(keys):
        for k in own:
            parent[top(i)] = top(first.setdefault(k, i))
    return [top(i) for i in range(len(keys))]


class Scorer:
    """Noisy-or of a text's entries in the decision list."""

    def __init__(self, model: np.ndarray, entries: dict[str, float], base: float, most: int = 24 << 20):
        self.restorer, self.entries, self.base, self.most = Restorer(model), entries, base, most
        self.known: dict[str, tuple[str, ...]] = {}
        self.held = 0  # bytes of what is known, about

    def _hits(self, words: Iterable[str]) -> tuple[str, ...]:
        entries = self.entries
        return tuple(w for w in words if any(f in entries for f in features(w)))

    def __call__(self, text: str | None) -> float:
        if not text:
            return self.base
        text, known, hits = text.lower(), self.known, set()
        for token in set(text.split()):
            got = known.get(token)
            if got is None:
                got = self._hits(self.restorer.token(token))
                self.held += 160 + 4 * len(token)
                if self.held > self.most:
                    known.clear()
                    self.held = 0
                known[token] = got
            if got:
                hits.update(got)
        for run in _SPACED.findall(text):
            hits.update(self._hits(self.restorer.spaced(run)))
        if not hits:
            return self.base
        clean = 1.0
        for w in sorted(hits):
            clean *= 1 - max(self.entries.get(f, 0.0) for f in features(w))
        return 1 - clean


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str, text_col: str, label_col: str, sample: int, least: float = 0.58, seed: int = 4) -> tuple[dict[str, float], float]:
    """The decision list and the score of texts without entries, from at most about ``sample`` labelled rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n = known.count()
    part = int((1 << 30) * min(1.0, sample / max(1, n)))
    known = known.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, cache, hasher = Restorer(model), WordHash(), MinHasher(16)
        for batch in batches:
            names, keys = [], []
            for text in (t.as_py() for t in batch.column(1)):
                names.append(sorted({f for w in restorer.words(text or "") for f in features(w)}))
                sig = np.frombuffer(hasher(shingle_set(text, 3, cache)), "<u4").tolist()
                keys.append([i << 32 | k for i, k in enumerate(sig)])
            arrays = [batch.column(0), batch.column(2), pa.array(names, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "toxic", "names", "keys"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The sample's size is bounded by a parameter: its ids can be broadcast, and its toxic rows collected
    rows = texts.join(F.broadcast(known), "id").select("id", "text", "toxic").mapInArrow(released(run), "id long, toxic int, names array<string>, keys array<long>")
    rows = written(rows.dropDuplicates(["id"]), "toxicity-sample")
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1):
        return {}, 0.0
    seen = rows.select("toxic", F.explode("names").alias("name")).groupBy("name")
    seen = seen.agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") != 1).alias("neg"))
    # A lower bound of a half needs more toxic rows than others
    others = {r.name: r.neg for r in seen.where("pos >= 3 and pos > neg").collect()}
    keep = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in others], "name string"))
    held = rows.where("toxic = 1").select("id", "keys", F.explode_outer("names").alias("name")).join(keep, "name", "left_semi")
    held = held.groupBy("id").agg(F.first("keys").alias("keys"), F.collect_list("name").alias("names")).collect()
    holds: dict[str, set[int]] = {}
    for family, r in zip(families([r["keys"] for r in held]), held, strict=True):
        for f in r.names:
            holds.setdefault(f, set()).add(family)
    shares = {f: lower_bound(len(v), len(v) + others[f]) for f, v in sorted(holds.items())}
    # A prefix or suffix stands for a kind of word only if at least three such words are telling by themselves
    kinds = Counter(f for name in shares if name[0] == "=" for f in features(name[1:]) if f != name)
    shares = {f: p for f, p in shares.items() if f[0] == "=" or kinds[f] >= 3}
    entries = {f: p for f, p in shares.items() if p >= least}
    explained = sum(any(f in entries for f in r.names) for r in held)
    return entries, (counts[1] - explained) / max(1, sum(counts.values()) - explained)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = character_model(bounded(docs), text_col)
    entries, base = learn(docs, labels, model, id_col, text_col, label_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, entries, base)
        for batch in batches:
            scores = [scorer(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(released(run), "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose score is below a half, with all their columns and without a join."""
    model = character_model(bounded(docs), text_col)
    entries, base = learn(docs, labels, model, id_col, text_col, label_col, sample)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, entries, base)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
