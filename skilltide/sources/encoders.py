"""Encoders: remote embedding services with retries and batch halving, a model loaded once a worker, and a table cache."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.engines import RemoteError, Unavailable

Post = Callable[[str, dict], dict]


def http_post(base_url: str, key: str | None = None, timeout: float = 60.0) -> Post:
    def post(path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(base_url.rstrip("/") + path, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise RemoteError(f"status {e.code}") from e
        except (OSError, ValueError) as e:
            raise Unavailable(str(e)) from e

    return post


def unit(vector: Sequence[float]) -> list[float]:
    length = math.sqrt(math.fsum(x * x for x in vector))
    if not length or not math.isfinite(length):
        raise RemoteError("a vector has no direction")
    return [x / length for x in vector]


def decoded(answer: dict, n: int) -> list[list[float]]:
    """Vectors of an answer in the order of its indices, normalised; all must have one length."""
    data = sorted(answer.get("data", ()), key=lambda x: x["index"])
    if [x["index"] for x in data] != list(range(n)):
        raise RemoteError("the answer does not hold one vector for each text")
    vectors = [unit(x["embedding"]) for x in data]
    if len({len(v) for v in vectors}) > 1:
        raise RemoteError("vectors of different lengths")
    return vectors


def encode(texts: Sequence[str], post: Post, model: str, batch: int = 32, tries: int = 3, wait: float = 0.0) -> list[list[float]]:
    """Batches; a batch that fails ``tries`` times is halved, down to single texts, then the error stands."""
    out: list[list[float]] = []
    todo = [list(texts[i : i + batch]) for i in range(0, len(texts), batch)][::-1]
    while todo:
        now = todo.pop()
        for attempt in range(tries):
            try:
                out += decoded(post("/embeddings", {"model": model, "input": now}), len(now))
                break
            except (RemoteError, Unavailable):
                if attempt + 1 < tries:
                    time.sleep(wait * 2**attempt)
        else:
            if len(now) == 1:
                raise RemoteError("a single text cannot be encoded")
            half = len(now) // 2
            todo += [now[half:], now[:half]]
    return out


def encoded(skills: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """``skills`` with ``dense``: each different text is encoded once; ``make`` builds the encoder once in each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or make()
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder(texts), pa.list_(pa.float64()))], ["_text", "dense"])

    texts = skills.select(F.col(text_col).alias("_text")).where("_text is not null").distinct()
    vectors = texts.mapInArrow(run, "_text string, dense array<double>")
    return skills.join(vectors, F.col(text_col) == F.col("_text"), "left").drop("_text")


def cached(spark, path: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Vectors kept as a table for a corpus fingerprint; a table of another corpus is not taken."""
    where = f"{path.rstrip('/')}/{fingerprint}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def exposes_sparse(answer: dict) -> bool:
    """Whether a service's answer seems to hold sparse weights, by the names of its keys."""
    names, todo = set(), [answer]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            names |= {str(k).lower() for k in x}
            todo += x.values()
        elif isinstance(x, list):
            todo += x[:8]
    return any("sparse" in n or "lexical" in n or n == "token_weights" for n in names)
