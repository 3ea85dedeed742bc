"""MinHash near-duplicate detection with sequential Bayesian verification.

Banded MinHash gives candidates. Their signatures are compared in batches; after
each batch a pair is dropped once the posterior probability of reaching the
similarity threshold falls below the chosen miss probability. Survivors are
verified on their full shingle sets, so every link is exact.

No group is ever expanded into all its pairs. Equal shingle sets are one class.
First each class is held against the smallest member of a bucket, that with
which it shares most buckets (a star: one pair a class and round), which joins
nearly all of a group of copies. What could still join two components is then
compared in blocks of bounded bytes, whose pairs never leave their task: the
signatures tell which rows of a block have a likely partner, only those rows are
sent again with their full sets, and the block gives the links that join its
components. In each bucket the members outside its largest component (left) meet
all others (right). A bucket of few bytes is one block; the members of larger
buckets are dealt once into chunks, and left rows visit the chunks that hold a
member of one of their buckets. So no pair of candidates in different components
is left out, and what is shuffled grows with the rows and not with their pairs.

Edge cases: null or empty texts, and texts of white space only, have no shingles
and are linked with nothing; a text of fewer words than the shingle width is one
shingle; rows that repeat a document id get that document's component each; rows
with a null id get a null component and are kept; an empty table gives an empty
result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import bounded, drop_table, few, free_name, released, tidy, written
from .shingles import MinHasher, WordHash, shingle_set

BATCH = 16


def least_matches(size: int, similarity: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair) after each batch.

    With a uniform prior, P(s >= t | m of n match) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, size + 1, BATCH):
        total, m = 0.0, 0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if total >= miss:
                break
        out.append((n, m))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, size: int) -> DataFrame:
    """id, n_shingles, digest (of the whole set) and sig (2 bytes for each hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hasher = WordHash(), MinHasher(size)
        for batch in batches:
            counts, digests, sigs = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width, cache)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(hasher(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "digest", "sig"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        released(run), "id long, n_shingles long, digest binary, sig binary"
    )


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in batches:
            made = [shingle_set(t.as_py(), width, cache).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "members"])

    return docs.mapInArrow(released(run), "id long, members binary")


def _likely(pairs: DataFrame, size: int, bounds: list[tuple[int, int]]) -> DataFrame:
    """Sequential test of (a, b, sig_a, sig_b): signature batches until the posterior rules a pair out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(n, size) for i in (2, 3))
            alive, matches, start = np.arange(n), np.zeros(n, np.int64), 0
            for end, least in bounds:
                matches[alive] += (a[alive, start:end] == b[alive, start:end]).sum(axis=1)
                alive, start = alive[matches[alive] >= least], end
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return pairs.mapInArrow(released(run), "a long, b long")


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups, one by one, of rows that come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        edges = [0, *(1 + np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(i, j - i))
            if j < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class _Block:
    """The rows of one block: those with ``role`` 1 and 3 are right, those with 2 and 3 left.

    ``band`` is the number of the bucket's band where the block is one bucket, else -1.
    """

    def __init__(self, rows: pa.Table, size: int, per_band: int, ratio: tuple[int, int], bounds: list[tuple[int, int]]):
        self.ids, self.n, self.role = (rows[k].to_numpy() for k in ("id", "n", "role"))
        self.comp = rows["comp"].to_numpy().copy()
        self.band, self.ratio, self.bounds = int(rows["band"][0].as_py()), ratio, bounds
        self.sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), "<u2").reshape(len(rows), size)
        weights = np.random.default_rng(9).integers(1, 1 << 63, per_band, dtype=np.uint64) | np.uint64(1)
        self.keys = (self.sig.reshape(len(rows), -1, per_band).astype(np.uint64) * weights).sum(axis=2)
        self.right = np.flatnonzero(self.role != 2)
        self.left = np.flatnonzero(self.role != 1)

    def likely(self, i: int) -> np.ndarray:
        """Right rows of other components that share a band with row i and pass the sequential test, the most alike first.

        In a block that is one bucket, only those that share no earlier band: they meet there.
        """
        y = self.right
        least, most = np.minimum(self.n[i], self.n[y]), np.maximum(self.n[i], self.n[y])
        y = y[(self.comp[y] != self.comp[i]) & (self.ratio[1] * least >= self.ratio[0] * most)]
        if self.band < 0:
            y = y[(self.keys[y] == self.keys[i]).any(axis=1)]
        elif self.band:
            y = y[~(self.keys[y, : self.band] == self.keys[i, : self.band]).any(axis=1)]
        matches, start = np.zeros(len(y), np.int64), 0
        for end, least_m in self.bounds:
            if not len(y):
                break
            matches += (self.sig[y, start:end] == self.sig[i, start:end]).sum(axis=1)
            good = matches >= least_m
            y, matches, start = y[good], matches[good], end
        return y[np.argsort(-matches, kind="stable")]

    def partnered(self) -> np.ndarray:
        """Rows with a likely partner."""
        found = np.zeros(len(self.ids), bool)
        for i in self.left:
            y = self.likely(i)
            found[y] = True
            found[i] |= len(y) > 0
        return np.flatnonzero(found)

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Verified links that join components of the block; pairs that others have joined meanwhile are not looked at."""
        out = []
        for i in self.left:
            for j in self.likely(i):
                was, now = self.comp[j], self.comp[i]
                if was != now and _similar(sets[i], sets[j], *self.ratio):
                    out.append((min(self.ids[i], self.ids[j]), max(self.ids[i], self.ids[j])))
                    self.comp[self.comp == was] = now
        return out


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |A and B| >= num * |A or B| for sorted distinct hashes."""
    both = np.concatenate((x, y))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * shared >= num * (len(both) - shared)


def _partnered(blocks: DataFrame, *rule) -> DataFrame:
    """Of sorted block rows (g0, g1, g2, band, role, id, comp, n, sig) those with a likely partner in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, ["g0", "g1", "g2"]):
            found = _Block(rows, *rule).partnered()
            if len(found):
                yield from rows.select(["g0", "g1", "g2", "band", "role", "id", "comp", "n"]).take(pa.array(found)).combine_chunks().to_batches()

    return blocks.mapInArrow(released(run), "g0 long, g1 long, g2 long, band int, role int, id long, comp long, n long")


def _joining(blocks: DataFrame, *rule) -> DataFrame:
    """Links (a, b) that join components, of sorted block rows with their sets (members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches, ["g0", "g1", "g2"]):
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows["members"]]
            found = _Block(rows, *rule).links(sets)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return blocks.mapInArrow(released(run), "a long, b long")


def _linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Exact verdict on (a, b, set_a, set_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3), strict=True)
            verdict = [_similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), num, den) for pair in sets]
            keep = pa.array(np.flatnonzero(verdict), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return pairs.mapInArrow(released(run), "a long, b long")


def _relabelled(frame: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """``frame`` with its labels in ``key`` replaced where ``new`` (id, comp) has another; a hot label is split by Spark's skew join."""
    to = few(new.select(F.col("id").alias(key), F.col("comp").alias("_next")))
    return frame.join(to, key, "left").withColumn(key, F.coalesce("_next", key)).select(*frame.columns)


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of the nodes of ``links`` (a, b): comp is the least id reachable.

    Each step takes the least label among a node and its neighbours, then the
    label of that label. Only labels that are somebody's are looked up, so a
    component of any size costs one row there.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = written(edges.union(edges.select("v", "u")), "minhash-edges")
    labels = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "id"), "minhash-labels")
    while True:
        heard = edges.join(labels, edges.u == labels.id).select(F.col("v").alias("id"), "comp")
        best = written(labels.withColumnRenamed("comp", "was").withColumn("comp", F.col("was")).unionByName(heard.withColumn("was", F.lit(None).cast("long"))).groupBy("id").agg(F.max("was").alias("was"), F.min("comp").alias("comp")), "minhash-heard")
        used = best.select("comp").distinct().withColumnRenamed("comp", "id")
        jump = best.join(used, "id", "left_semi").select("id", "comp")
        seen = Observation()
        now = written(_relabelled(best, "comp", jump).observe(seen, F.count_if(F.col("comp") != F.col("was")).alias("changed")).select("id", "comp"), "minhash-labels")
        for old in (labels, best):
            drop_table(old)
        labels = now
        if not seen.get["changed"]:
            drop_table(edges)
            return labels


def joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after new links: solved on the components that the links touch, then handed down."""
    if comp is None:
        return components(links)
    for k in "ab":
        links = links.join(comp.select(F.col("id").alias(k), F.col("comp").alias(f"c_{k}")), k, "left").withColumn(f"c_{k}", F.coalesce(f"c_{k}", k))
    touched = written(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "minhash-touched")
    solved = components(touched)
    fresh = touched.select(F.col("a").alias("id")).union(touched.select("b")).distinct().withColumn("comp", F.col("id"))
    every = comp.unionByName(fresh.join(comp, "id", "left_anti"))
    out = written(_relabelled(every, "comp", solved), "minhash-components")
    for old in (touched, solved, comp):
        drop_table(old)
    return out


def _blocks(members: DataFrame, comp: DataFrame | None, brief: DataFrame, most: int) -> DataFrame:
    """Rows (g0, g1, g2, band, role, id, comp, n) of the blocks of buckets whose members are in several components.

    Blocks hold about ``most`` bytes of signatures and sets on either side.
    """
    seen = members.select("bucket", "band", "id").join(brief.select("id", "n", "weight"), "id")
    seen = seen.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")) if comp is not None else seen.withColumn("comp", F.col("id"))
    by = seen.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("w"))
    parts = by.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("w").alias("w_all"), F.max(F.struct("k", "comp")).alias("m"))
    parts = parts.where("parts > 1").select("bucket", "w_all", F.col("m.comp").alias("major"))
    active = written(seen.join(parts, "bucket").withColumn("is_left", F.expr("comp != major")), "minhash-active")

    whole = active.where(F.col("w_all") <= most).select(F.col("bucket").alias("g0"), F.lit(-1).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), "band", F.when(F.col("is_left"), 3).otherwise(1).alias("role"), "id", "comp", "n")

    large = active.where(F.col("w_all") > most)
    # Members are dealt by one of their buckets, so that a group's members stand together, then by hash
    home = written(large.groupBy("id").agg(F.min("bucket").alias("g0"), F.first("comp").alias("comp"), F.first("n").alias("n"), F.first("weight").alias("weight")), "minhash-home")
    dealt = home.join(home.groupBy("g0").agg(F.ceil(F.sum("weight") / most).alias("chunks")), "g0").withColumn("g1", F.pmod(F.xxhash64("id"), "chunks"))
    dealt = written(dealt.drop("chunks"), "minhash-dealt")
    held = large.select("bucket", "id").join(dealt.select("id", "g0", "g1"), "id").select("bucket", "g0", "g1").distinct()
    visits = large.where("is_left").select("bucket", "id").join(held, "bucket").select("id", "g0", "g1").distinct()
    visits = visits.join(dealt.select("id", "comp", "n", "weight"), "id")
    visits = written(visits, "minhash-visits")
    turns = visits.groupBy("g0", "g1").agg(F.ceil(F.sum("weight") / most).alias("turns"))
    left = visits.join(turns, ["g0", "g1"]).withColumn("g2", F.pmod(F.xxhash64("id", F.lit(1)), "turns")).withColumn("role", F.lit(2))
    right = dealt.join(turns, ["g0", "g1"]).withColumn("g2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).withColumn("role", F.lit(1))
    names = ["g0", "g1", "g2", "band", "role", "id", "comp", "n"]
    out = whole
    for side in (left, right):
        out = out.unionByName(side.withColumn("band", F.lit(-1)).select(*names))
    out = written(out, "minhash-blocks")
    for old in (active, home, dealt, visits):
        drop_table(old)
    return out


def _sorted(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("g0", "g1", "g2").sortWithinPartitions("g0", "g1", "g2", "id", "role")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: tuple[int, int] = (75, 100),
    width: int = 5,
    bands: int = 48,
    rows: int = 5,
    miss: float = 1e-6,
    block_bytes: int = 2 << 20,
    rounds: int = 2,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    With 48 bands of 5 rows, a pair at the threshold shares no band with a
    probability of 2e-6. ``miss`` is the posterior probability under which a
    candidate is dropped unverified; ``block_bytes`` bounds what is compared at
    once; ``rounds`` of stars come before the blocks, which alone would find all
    as well.
    """
    signed = written(signatures(bounded(docs), id_col, text_col, width, bands * rows), "minhash-signatures")
    reps = signed.where("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", F.col("n_shingles").alias("n"), "sig")).alias("m"))
    reps = written(reps.select("digest", "m.*"), "minhash-classes")
    every = written(signed.select("id", "n_shingles", "digest"), "minhash-rows")
    drop_table(signed)

    comp = _components(docs, reps, id_col, text_col, threshold, width, bands, rows, miss, block_bytes, rounds)
    classes = reps.select("digest", F.col("id").alias("component_id"))
    if comp is not None:
        known = comp.withColumnRenamed("id", "component_id")
        classes = classes.join(known, "component_id", "left").select("digest", F.coalesce("comp", "component_id").alias("component_id"))
    classes = written(classes, "minhash-verdicts")
    for old in (reps, *([comp] if comp is not None else [])):
        drop_table(old)
    # Rows without a set pass by the join; a hot digest is split by Spark's skew join
    out = every.where("digest is not null").join(classes, "digest", "left").unionByName(every.where("digest is null").withColumn("component_id", F.lit(None).cast("long")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _components(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int], width: int, bands: int, per_band: int, miss: float, block_bytes: int, rounds: int) -> DataFrame | None:
    """(id, comp) of the classes that are linked with another; None if there is none."""
    size, bits = bands * per_band, max(1, (bands - 1).bit_length())
    bounds = least_matches(size, threshold[0] / threshold[1], miss)

    # Buckets that hold at least two classes, each with its smallest id
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.shiftleft(F.xxhash64(i, F.substring("sig", i * (2 * per_band) + 1, F.lit(2 * per_band))), bits).bitwiseOR(i.cast("long")))
    banded = reps.select("id", F.explode(keys).alias("bucket"))
    full = banded.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket", "lo")
    members = banded.join(full, "bucket").withColumn("band", F.col("bucket").bitwiseAND((1 << bits) - 1).cast("int"))
    members = written(members, "minhash-members")
    nodes = written(members.select("id").distinct(), "minhash-nodes")
    if nodes.isEmpty():
        for old in (members, nodes):
            drop_table(old)
        return None
    one = few(nodes)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").join(one, "id", "left_semi")
    sets = written(_sets(texts, width).dropDuplicates(["id"]), "minhash-sets")
    brief = written(reps.join(one, "id", "left_semi").select("id", "n", "sig", (F.length("sig") + 8 * F.col("n")).alias("weight")), "minhash-briefs")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs
        for k in "ab":
            both = both.join(brief.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")), k)
        both = both.where(F.least("n_a", "n_b") * threshold[1] >= F.greatest("n_a", "n_b") * threshold[0])
        likely = _likely(both.select("a", "b", "sig_a", "sig_b"), size, bounds)
        for k in "ba":
            likely = likely.join(sets.select(F.col("id").alias(k), F.col("members").alias(f"set_{k}")), k)
        return _linked(likely.select("a", "b", "set_a", "set_b"), *threshold)

    comp: DataFrame | None = None

    def add(links: DataFrame, name: str) -> None:
        nonlocal comp
        links = written(links, name)
        if not links.isEmpty():
            comp = joined(comp, links)
        drop_table(links)
        tidy(docs.sparkSession)

    # Stars: members with the smallest ids of their buckets, that which they share most buckets with, as long as it could join components
    stars = members.where("id != lo").groupBy(F.col("lo").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    stars = written(stars, "minhash-stars")
    tried: list[DataFrame] = []
    for _ in range(rounds):
        apart = stars
        for k in "ab" if comp is not None else "":
            apart = apart.join(comp.select(F.col("id").alias(k), F.col("comp").alias(f"c_{k}")), k, "left").withColumn(f"c_{k}", F.coalesce(f"c_{k}", k))
        if comp is not None:
            apart = apart.where("c_a != c_b")
        for pairs in tried:
            apart = apart.join(pairs, ["a", "b"], "left_anti")
        pairs = written(apart.groupBy("b").agg(F.min_by("a", F.struct(-F.col("shared"), "a")).alias("a")).select("a", "b"), "minhash-pairs")
        tried.append(pairs)
        add(verified(pairs), "minhash-links")
    for old in (stars, *tried):
        drop_table(old)

    # Blocks: first which rows have a likely partner, by signatures alone, then links, by the full sets of those rows
    rule = (size, per_band, threshold, bounds)
    blocks = _blocks(members, comp, brief, block_bytes)
    drop_table(members)
    rows = written(_partnered(_sorted(blocks.join(brief.select("id", "sig"), "id").select(*blocks.columns, "sig")), *rule), "minhash-partnered")
    drop_table(blocks)
    rows_sets = rows.join(brief.select("id", "sig"), "id").join(sets, "id").select(*rows.columns, "sig", "members")
    add(_joining(_sorted(rows_sets), *rule), "minhash-links")
    for old in (rows, nodes, sets, brief):
        drop_table(old)
    return comp


def without_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Rows that repeat an id are one document: one of them stays. Rows with a null id stay.
    """
    found, key = near_duplicates(docs, id_col, **options), free_name(docs.columns, "_id")
    ids = written(found.groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("rows"), F.min("kept").alias("kept")), "minhash-verdicts")
    away = ids.where(F.col(key).isNotNull() & F.expr("rows > 1 or not kept")).select(key)
    again = ids.where(F.col(key).isNotNull() & F.expr("rows > 1 and kept")).select(key)
    rest = docs.join(few(away), docs[id_col] == F.col(key), "left_anti")
    if again.isEmpty():
        return rest
    return rest.unionByName(docs.join(few(again), docs[id_col] == F.col(key), "left_semi").dropDuplicates([id_col]))
