"""Packing into optimal length buckets, with DataFrame functions.

The global histogram of lengths goes to the driver (at most ``budget`` + 2 rows:
all lengths beyond the budget are one) and dynamic programming chooses the bucket boundaries that
minimise padding: with boundaries among the lengths that occur, the best last
bucket for each length is found on a lower envelope of lines, one pass for each
number of buckets. Inside a bucket, documents lie in an order seeded by hash and
every ``budget // boundary`` of them make a batch; a bucket is ranked shard by
shard, with offsets, so no bucket is sorted in one task.

Edge cases: null and empty texts have length 0 and cost no budget of their own;
a text longer than the budget is a batch of its own without padding, in a last
bucket (over_budget); equal lengths and repeated rows are packed each; rows with a
null id are packed like others, in an order by their texts; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .mixing import MOST_SHARDS, SHARD_ROWS, word_count


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding, from (length, rows)."""
    h = sorted(histogram)
    if not h:
        return []
    rows, words = [0], [0]  # of the lengths before each
    for length, n in h:
        rows.append(rows[-1] + n)
        words.append(words[-1] + length * n)
    n = len(h)
    best = [0] + [h[j - 1][0] * rows[j] - words[j] for j in range(1, n + 1)]
    picks = [[0] * (n + 1)]
    for k in range(2, min(buckets, n) + 1):
        # cost(j) = L_j N_j - S_j + min over i of (best_i + S_i) - N_i L_j: lines of falling slope, rising L_j
        lines: list[int] = []
        at, now, pick = 0, [0] * (n + 1), [0] * (n + 1)

        def meets_before(a: int, b: int, c: int, best=best) -> bool:
            """Line c overtakes a no later than b does."""
            va, vb, vc = (best[i] + words[i] for i in (a, b, c))
            return (vc - va) * (rows[b] - rows[a]) <= (vb - va) * (rows[c] - rows[a])

        for j in range(1, n + 1):
            if j - 1 >= k - 1:
                i = j - 1
                while len(lines) - at >= 2 and meets_before(lines[-2], lines[-1], i):
                    lines.pop()
                lines.append(i)
            length = h[j - 1][0]
            if not lines:
                now[j], pick[j] = best[j], picks[-1][j]
                continue
            while at + 1 < len(lines) and best[lines[at + 1]] + words[lines[at + 1]] - rows[lines[at + 1]] * length <= best[lines[at]] + words[lines[at]] - rows[lines[at]] * length:
                at += 1
            i = lines[at]
            now[j], pick[j] = length * rows[j] - words[j] + best[i] + words[i] - rows[i] * length, i
        best = now
        picks.append(pick)
    out, j = [], n
    for pick in reversed(picks):
        if j:
            out.append(h[j - 1][0])
            j = pick[j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 32_768, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, seed: int = 6) -> DataFrame:
    """doc_id, length, bucket, bucket_len, batch, batch_rows, padding, over_budget of every row.

    The length has the name of what it counts: ``length_col`` of the input, or n_words, the words of the text.
    """
    name = length_col or "n_words"
    length = F.coalesce(F.col(length_col).cast("long"), F.lit(0).cast("long")) if length_col else word_count(F.col(text_col))
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)) if text_col in docs.columns else F.xxhash64(F.lit(seed), F.col(id_col), length)
    d = written(docs.select(F.col(id_col).alias("doc_id"), length.alias("_length"), order.alias("_order")), "packing-lengths")
    # Every length beyond the budget counts as one more than it
    sizes = d.groupBy(F.least("_length", F.lit(budget + 1)).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = [(r.size, r.n) for r in sizes if r.size <= budget]
    ends = boundaries(histogram, buckets) or [0]
    counts = [0] * len(ends) + [sum(r.n for r in sizes if r.size > budget)]
    for size, n in histogram:
        counts[bisect.bisect_left(ends, size)] += n

    over = F.col("_length") > budget
    bucket = F.when(over, F.lit(len(ends))).otherwise(F.array_size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("_length"))))
    shards = F.element_at(F.array(*(F.lit(min(MOST_SHARDS, max(1, -(-n // SHARD_ROWS)))) for n in counts)), F.col("bucket") + 1)
    d = d.withColumn("bucket", bucket).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), shards))
    held = d.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select("bucket", "_shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("bucket", "_shard").orderBy("_order", "doc_id", "_length")
    d = d.withColumn("_rank", F.row_number().over(inside) - 1).join(offset, ["bucket", "_shard"])

    end = F.when(over, F.col("_length")).otherwise(F.get(F.array(*map(F.lit, ends)), F.col("bucket")).cast("long"))
    total = F.element_at(F.array(*map(F.lit, counts)), F.col("bucket") + 1).cast("long")
    most = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(end, F.lit(1))))
    number = F.floor((F.col("_offset") + F.col("_rank")) / most).cast("long")
    return d.select(
        "doc_id", F.col("_length").alias(name), "bucket", end.alias("bucket_len"), (F.col("bucket").cast("long") * F.lit(1 << 40) + number).alias("batch"),
        F.least(most, total - number * most).alias("batch_rows"), (end - F.col("_length")).alias("padding"), over.alias("over_budget"),
    )
