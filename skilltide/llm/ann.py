"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Largest inner product becomes smallest distance by one more component: vectors are
scaled by the largest norm of their range and completed to length 1, queries are
scaled to length 1. Ranges are powers of two with cells of their own, so that a few
long vectors do not push all others together. Each table cuts Gaussian projections
into cells of width ``width``. A query visits its own cell and then perturbed ones
in the order of estimated success (the sum of squared distances to the crossed cell
borders), ``probes`` in each table and range; the candidates of all tables are
merged and scored on the original vectors in double precision. Queries that find
fewer than ``k`` go on with ten times the probes and steps of two cells, and those
still short are held against every vector. Recall is measured on a bounded sample of
queries: a plan of probes that misses too many true neighbours gives way to the next
for all queries.

Equal vectors are one class with its ``k`` + 1 smallest ids (more can never be
among the k nearest), so copies cost nothing. Cells are dealt by hash over parts,
each with a bounded share of the index; a part scores its cells block by block
and passes on at most ``k`` + 1 classes for each query, so neither a hot cell nor
a query's candidates ever form one list.

Edge cases: vectors that are null, zero, hold null or non-finite components, or
have another length than most vectors take no part, neither do rows with a null
id; rows that repeat id and vector count once; fewer other ids than k give all of
them; ties go to the smaller id; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .shingles import mix

OUT = "query_id long, rank int, vec_id long, score double"


class Hasher:
    """Codes and probe sequences of ``tables`` p-stable hash tables of ``hashes`` projections each."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 9, step: int = 1):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width = tables, hashes, width
        self.project = rng.normal(size=(dim, tables * hashes))
        self.shift = rng.uniform(0, width, tables * hashes)
        self.factor = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1)
        self.moves = np.array([m for m in product(range(-step, step + 1), repeat=hashes)], np.int64)
        self.down = [(self.moves == -n).T.astype(float) for n in range(1, step + 1)]
        self.up = [(self.moves == n).T.astype(float) for n in range(1, step + 1)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Positions in units of cells: (rows, tables, hashes)."""
        return ((x @ self.project + self.shift) / self.width).reshape(len(x), self.tables, self.hashes)

    def names(self, cells: np.ndarray, table: int, band: np.ndarray) -> np.ndarray:
        """64-bit names of integer cells (..., hashes) of a table and of norm ranges (...)."""
        h = (cells.astype(np.int64).view(np.uint64) * self.factor).sum(axis=-1, dtype=np.uint64)
        h += mix(np.asarray(band, np.int64).view(np.uint64) + np.uint64(1 << 32))
        return mix(h + np.uint64((table + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)

    def probes(self, at: np.ndarray, table: int, n: int, bands: list[int]) -> np.ndarray:
        """Names of the n cells of each range likeliest to hold neighbours of each row, likeliest first."""
        base = np.floor(at[:, table])
        inside = at[:, table] - base
        cost = sum(((inside + i) ** 2) @ m for i, m in enumerate(self.down)) + sum(((i + 1 - inside) ** 2) @ m for i, m in enumerate(self.up))
        order = np.argsort(cost, axis=1, kind="stable")[:, :n]
        cells = base[:, None, :].astype(np.int64) + self.moves[order]
        return np.hstack([self.names(cells, table, np.full(cells.shape[:2], b, np.int64)) for b in bands])


def unit(x: np.ndarray, band: np.ndarray | None = None, longest: np.ndarray | None = None) -> np.ndarray:
    """Vectors (with their norm range 2**band and its longest norm over 2**band) or queries on the sphere where the nearest point has the largest inner product."""
    if band is None:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return np.hstack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))])
    y = np.ldexp(x, -band[:, None]) / longest[:, None]
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1, keepdims=True)))])


def _part(names: np.ndarray, parts: int) -> np.ndarray:
    return (names.view(np.uint64) >> np.uint64(33)).astype(np.int64) % parts


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _score(cells: pa.Table, asked: pa.Table, dim: int, keep: int) -> pa.Table:
    """Best ``keep`` classes of each query among the cells of one part."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
    if not len(cells) or not len(asked):
        return empty
    name = cells["name"].to_numpy()
    order = np.argsort(name, kind="stable")
    name, vectors, ids = name[order], _matrix(cells["vector"].combine_chunks().take(pa.array(order)), dim), cells["ids"].combine_chunks().take(pa.array(order)).to_pylist()
    least = np.array([np.frombuffer(i[:8], "<i8")[0] for i in ids])
    query_id, queries = asked["query_id"].to_numpy(), _matrix(asked["vector"].combine_chunks(), dim)
    wanted = [np.frombuffer(b, "<i8") for b in asked["names"].to_pylist()]
    who = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
    wanted = np.concatenate(wanted)
    by = np.argsort(wanted, kind="stable")
    wanted, who = wanted[by], who[by]
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    last = np.r_[first[1:], len(name)]
    best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(queries))]
    held = np.zeros(len(queries), np.int64)

    def shrink(q: int) -> None:
        score, row = (np.concatenate(x) for x in zip(*best[q], strict=True))
        _, one = np.unique(least[row], return_index=True)  # a class may stand in cells of several tables
        score, row = score[one], row[one]
        top = np.lexsort((least[row], -score))[:keep]
        best[q] = [(score[top], row[top])]
        held[q] = len(top)

    left, right = np.searchsorted(wanted, name[first], "left"), np.searchsorted(wanted, name[first], "right")
    for a, b, x, y in zip(first, last, left, right, strict=True):
        for i in range(x, y, 512):
            q = who[i : min(y, i + 512)]
            for j in range(a, b, 4096):
                rows = np.arange(j, min(b, j + 4096))
                scores = queries[q] @ vectors[rows].T
                if len(rows) > keep:
                    top = np.argpartition(-scores, keep - 1, axis=1)
                    edge = np.take_along_axis(scores, top[:, keep - 1 : keep], axis=1)
                else:
                    edge = np.full((len(q), 1), -np.inf)
                for n, one in enumerate(q):
                    good = np.flatnonzero(scores[n] >= edge[n] - 1e-9)
                    best[one].append((scores[n][good], rows[good]))
                    held[one] += len(good)
                    if held[one] > 2048:
                        shrink(one)
    out_id, out = [], []
    for q in range(len(queries)):
        if best[q]:
            shrink(q)
            row = best[q][0][1]
            exact = (vectors[row] * queries[q]).sum(axis=1)
            out_id.append(int(query_id[q]))
            out.append(b"".join(np.float64(s).tobytes() + len(ids[r]).to_bytes(4, "little") + ids[r] for s, r in zip(exact, row, strict=True)))
    return pa.table({"query_id": pa.array(out_id, pa.int64()), "found": pa.array(out, pa.binary())})


def _merged(k: int):
    """Rows (query_id, found) in order of query_id to the k nearest ids of each query."""

    def best(query: int, found: list[bytes]) -> list[tuple[int, int, int, float]]:
        seen: dict[int, float] = {}
        for data in found:
            i = 0
            while i < len(data):
                score, n = np.frombuffer(data, "<f8", 1, i)[0], int.from_bytes(data[i + 8 : i + 12], "little")
                for v in np.frombuffer(data, "<i8", n // 8, i + 12).tolist():
                    if v != query:
                        seen[v] = float(score)
                i += 12 + n
        top = heapq.nsmallest(k, seen.items(), key=lambda x: (-x[1], x[0]))
        return [(query, r, v, s) for r, (v, s) in enumerate(top, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

        now, found, rows = None, [], []
        for b in batches:
            for q, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if q != now:
                    if found:
                        rows += best(now, found)
                    now, found = q, []
                found.append(data)
            if len(rows) > 5000:
                yield batch(rows)
                rows = []
        if found:
            rows += best(now, found)
        if rows:
            yield batch(rows)

    return run


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes as rows of the one cell 0."""
    for b in batches:
        ids = [np.array(r, "<i8").tobytes() for r in b.column(1).to_pylist()]
        data = [np.array(r, "<f8").tobytes() for r in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids), pa.int64()), pa.array(ids, pa.binary()), pa.array(data, pa.binary())], ["name", "ids", "vector"])


def _plain_query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries that visit the one cell 0."""
    for b in batches:
        data = [np.array(r, "<f8").tobytes() for r in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bytes(8)] * len(data), pa.binary()), pa.array(data, pa.binary())], ["query_id", "names", "vector"])


def _short(queries: DataFrame, got: DataFrame, want: int) -> DataFrame:
    """Queries with fewer than ``want`` rows."""
    full = got.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= want).select("id")
    return queries.join(full, "id", "left_anti")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = 8, hashes: int = 6, width: float = 1.5, probes: int = 100, part_rows: int = 16_384, sample: int = 128, recall: float = 0.925, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``.

    A plan of probes is kept only if it finds the share ``recall`` of the true neighbours of ``sample`` queries;
    else the next one looks at more cells, and at last every query is held against every vector.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    lengths = v.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], OUT)
    dim = lengths[0].n
    v = v.where(F.size("v") == dim).withColumns({"h": F.xxhash64("v"), "g": F.hash("v")})

    # Classes of equal vectors, with their smallest ids: partly in shares of a class, then of all
    classes = written(v.groupBy("h", "g").agg(F.min(F.struct("id", "v")).alias("m"), F.count(F.lit(1)).alias("n")), "ann-classes")
    many = classes.where("n > 1").select("h", "g")
    copies = v.select("id", "h", "g").join(many, ["h", "g"]).distinct().withColumn("share", F.pmod(F.xxhash64("id"), F.lit(256)))
    for by in (["h", "g", "share"], ["h", "g"]):
        copies = copies.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    copies = copies.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = classes.join(copies, ["h", "g"], "left").select(F.col("m.v").alias("v"), F.coalesce("ids", F.array("m.id")).alias("ids"))
    # log2 of the norm, without overflow; a range reaches from 2**(band - 1/2) to 2**(band + 1/2)
    big = F.array_max(F.transform("v", F.abs))
    log = F.log2(big) + F.log2(F.aggregate(F.transform("v", lambda x: x / big), F.lit(0.0), lambda a, x: a + x * x)) / 2
    classes = written(classes.withColumn("log", log).select("v", "ids", F.round("log").cast("int").alias("band"), F.pow(F.lit(2.0), F.col("log") - F.round("log")).alias("size")), "ann-index")
    # At most some 2,100 ranges however many rows: the exponents of a double
    facts = classes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("longest")).collect()
    scale, rows = {r.band: r.longest for r in facts}, sum(r.n for r in facts)
    parts = max(32, -(-rows * tables // part_rows))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim + 1, tables, hashes, width)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                b = batch.slice(i, 2048)
                x = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                ids = [np.array(r, "<i8").tobytes() for r in b.column(1).to_pylist()]
                band = b.column(2).to_numpy(zero_copy_only=False)
                data = [r.tobytes() for r in x]
                at = np.floor(hasher.cells(unit(x, band, np.array([scale[n] for n in band.tolist()]))))
                for t in range(tables):
                    names = hasher.names(at[:, t], t, band)
                    yield pa.RecordBatch.from_arrays([pa.array(_part(names, parts)), pa.array(names), pa.array(ids, pa.binary()), pa.array(data, pa.binary())], ["part", "name", "ids", "vector"])

    def ask(step: int, n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, bands = Hasher(dim + 1, tables, hashes, width, step=step), sorted(scale)
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    b = batch.slice(i, 64)
                    x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                    at = hasher.cells(unit(x))
                    names = np.hstack([hasher.probes(at, t, n, bands) for t in range(tables)])
                    rows = []
                    for one, key, vector in zip(names, b.column(0).to_pylist(), x, strict=True):
                        part = _part(one, parts)
                        rows += [(int(p), key, one[part == p].tobytes(), vector.tobytes()) for p in np.unique(part)]
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "query_id", "names", "vector"])

        return run

    def ranked(cells: DataFrame, asked: DataFrame) -> DataFrame:
        found = cells.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda a, b: _score(a, b, dim, k + 1), "query_id long, found binary")
        return written(found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merged(k), OUT), "ann-found")

    def exact(asked: DataFrame) -> DataFrame:
        """Held against every vector: blocks of queries meet parts of the vectors, all in one cell."""
        blocks, shares = max(1, -(-asked.count() // 4096)), -(-rows // part_rows)
        cells = classes.mapInArrow(_plain, "name long, ids binary, vector binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        cells = cells.withColumn("part", F.col("block") * shares + F.pmod(F.xxhash64("vector"), F.lit(shares)))
        visits = asked.mapInArrow(_plain_query, "query_id long, names binary, vector binary")
        visits = visits.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        visits = visits.withColumn("part", F.col("share") + F.pmod(F.xxhash64("query_id"), F.lit(blocks)) * shares)
        number = F.col("part").cast("long").alias("part")
        return ranked(cells.select(number, "name", "ids", "vector"), visits.select(number, "query_id", "names", "vector"))

    queries = written(v.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    # What the index finds is measured on a bounded sample of queries, which are held against every vector
    truth = exact(queries.orderBy(F.xxhash64("id"), "id").limit(sample)).select("query_id", "vec_id")
    asked = truth.count()
    want = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    done, measured = [], False
    for step, n in ((1, probes), (2, 10 * probes)):
        cells = classes.mapInArrow(index, "part long, name long, ids binary, vector binary")
        got = ranked(cells, queries.mapInArrow(ask(step, n), "part long, query_id long, names binary, vector binary"))
        if not measured:
            if truth.join(got, ["query_id", "vec_id"], "left_semi").count() < recall * asked:
                continue  # the next plan looks at more cells
            measured = True
        short = written(_short(queries, got, want), "ann-short")
        done.append(got.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*got.columns))
        queries = short
        if short.isEmpty():
            break
    else:
        done.append(exact(queries))
    return reduce(DataFrame.unionByName, done)
