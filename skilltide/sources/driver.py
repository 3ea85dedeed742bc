"""The skill model over the driver's tables: a job of ten skills from each ten vectors, words from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import words


BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, pos, role, skill_id, intitule, description, niveau, dense, sparse, label of every vector."""
    v, e = F.col("vec_id"), table(spark, sf_dir, "embeddings")
    # Words are parted only in documents that a vector stands for; up to 8 MB of ids go to the texts, not the texts to the ids
    ids = e.select("vec_id")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    w = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(ids, "vec_id", "left_semi").select("vec_id", words(F.col("text")).alias("ws"))
    e = e.join(w, "vec_id", "left")
    job, ws = F.floor(v / 10).cast("long"), F.coalesce("ws", F.array().cast("array<string>"))
    return e.select(
        job.alias("job_id"), (v % 10).alias("pos"), F.when(job % 2 == 0, "actuel").otherwise("cible").alias("role"), v.cast("string").alias("skill_id"),
        F.concat(F.lit("Skill "), F.col("label").cast("string")).alias("intitule"), F.lit(None).cast("string").alias("description"),
        F.when(v % 7 != 0, (1 + v % 4).cast("int")).alias("niveau"), F.col("embedding").cast("array<double>").alias("dense"),
        F.map_from_arrays(ws, F.array_repeat(F.lit(0.5), F.size(ws))).alias("sparse"), "label",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor(F.col("vec_id") / 10).cast("long")
    return table(spark, sf_dir, "embeddings").select(v.alias("job_id")).distinct().select("job_id", F.col("job_id").alias("ord"), F.when(F.col("job_id") % 2 == 0, "actuel").otherwise("cible").alias("role"), F.concat(F.lit("Job "), F.col("job_id").cast("string")).alias("intitule"))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unordered job pair; it is positive if the first skills of both share their label."""
    first = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).cast("long").alias("job_id")).agg(F.min_by("label", "vec_id").alias("l"))
    a, b = first.select(F.col("job_id").alias("code_a"), F.col("l").alias("la")), first.select(F.col("job_id").alias("code_b"), F.col("l").alias("lb"))
    # Blocks meet blocks by an equi-join, so the range condition is no nested loop over whole tables
    blocks = max(4, first.count() // 2048)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = a.withColumn("_i", F.pmod(F.xxhash64("code_a"), F.lit(blocks))).withColumn("_j", every)
    b = b.withColumn("_j", F.pmod(F.xxhash64("code_b"), F.lit(blocks))).withColumn("_i", every)
    return a.join(b, ["_i", "_j"]).where("code_a < code_b").select("code_a", "code_b", (F.col("la") == F.col("lb")).alias("label"))


def written_at(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """When the tables of the skill model were last written."""
    jvm, times = spark.sparkContext._jvm, []
    for name in ("embeddings", "documents"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        times.append(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())
    return tuple(times)
