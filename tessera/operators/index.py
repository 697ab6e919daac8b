"""Stored indexes that searches read in part: cells of vectors, and postings in blocks with their largest weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lineage import cut
from tessera.operators import retrieval as R


# cells of vectors


def nearest_cell(centres: list[list[float]]):
    """A function of a vector column: the cell of largest cosine (the first of equals); null for a null or zero vector or one of another dimension."""

    @F.pandas_udf("int")
    def cell(vectors):
        import numpy as np
        import pandas as pd

        c = np.array(centres, float)
        c = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-300)
        out = np.full(len(vectors), -1)
        usable = np.flatnonzero([v is not None and len(v) == c.shape[1] and bool(np.any(v)) for v in vectors])
        for s in range(0, len(usable), 4096):
            part = usable[s : s + 4096]
            out[part] = np.argmax(np.stack([vectors.iloc[i] for i in part]).astype(float) @ c.T, axis=1)
        return pd.Series(out).where(out >= 0).astype("Int32")

    return cell


def write_ivf(chunks: DataFrame, path: str, nlist: int = 128, fit_rows: int = 100_000, seed: int = 42, batch: str = "first") -> None:
    """V6: fits nlist cells on about fit_rows of chunks(id, v, ...) and stores them and every chunk, cell by cell, under path.

    The sample's bound is all that reaches one fit; each chunk is then given its nearest cell.
    Null and zero vectors have no direction and are not stored, nor are those of another
    dimension than most.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = chunks.where(T.norm(F.col("v")) > 0)
    dims, n = usable.groupBy(F.size("v")).count().orderBy(F.desc("count"), F.desc("size(v)")).first()
    usable = usable.where(F.size("v") == dims)
    x = usable.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    fitted = KMeans(k=nlist, seed=seed, distanceMeasure="cosine", featuresCol="features").fit(x.sample(fit_rows / n, seed) if n > fit_rows else x)
    centres = [(i, [float(e) for e in v]) for i, v in enumerate(fitted.clusterCenters())]  # nlist vectors
    chunks.sparkSession.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    add_to_ivf(chunks, path, batch)


def add_to_ivf(chunks: DataFrame, path: str, batch: str) -> None:
    """Stores more chunks in the cells as they are. A batch that is written again replaces itself, so a retry adds nothing twice."""
    centres = [r["centre"] for r in chunks.sparkSession.read.parquet(f"{path}/centres").orderBy("cell").collect()]
    placed = chunks.withColumn("cell", nearest_cell(centres)("v")).where("cell is not null")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/chunks/batch={batch}")


def read_ivf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells(cell, centre), chunks with their cell, a partition column)."""
    return spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/chunks").drop("batch")


def ivf_search(index: tuple[DataFrame, DataFrame], filters: dict | None = None, nprobe: int = 16):
    """A first search for retrieve(): the stored index in place of the live chunks it is given, under the same filters."""
    cells, chunks = index
    return lambda q, live, k: R.ivf_topk(q, (cells, chunks.where(R.scalar_filter(filters))), k, nprobe)


# postings in blocks


def write_postings(docs: DataFrame, path: str, slice_rows: int = 256, heads: int = 128, buckets: int = 16) -> None:
    """V7: stores the words of docs(id, text), ids unique, as blocks of postings and each term's `heads` largest weights.

    Documents are dealt into slices of about slice_rows that hold documents of like length, so
    that largest weights differ between slices; a block is a term's postings in one slice. Hot
    terms have many blocks, none larger than a slice. Terms lie in folders by hash.
    """
    counted = docs.select("id", R.word_counts(F.col("text")).alias("c")).where(F.size("c") > 0)
    band = F.floor(4 * F.log2(F.aggregate("c", F.lit(0.0), lambda t, x: t + x["weight"])))
    counted = cut(counted.withColumn("band", band))
    parts = counted.groupBy("band").agg(F.ceil(F.count("*") / slice_rows).alias("parts"))  # four an octave of lengths: some hundred rows at most
    # a slice's counts go to one task as they are, where its blocks are made, so no posting is moved for them
    sliced = counted.join(F.broadcast(parts), "band").select("id", "c", (F.shiftleft(F.col("band"), 40) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("slice")).repartition("slice")
    posts = sliced.select("id", "slice", F.explode("c").alias("c")).select("id", "slice", "c.term", "c.weight")
    blocks = posts.groupBy("term", "slice").agg(F.max("weight").alias("top"), F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("block"))
    bucket = F.pmod(F.crc32("term"), F.lit(buckets)).cast("int").alias("bucket")
    blocks.select(bucket, "term", "slice", "top", "block").hint("rebalance", "bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    best = Window.partitionBy("term").orderBy(F.desc("weight"), "id")
    posts = counted.select("id", F.explode("c").alias("c")).select("id", "c.term", "c.weight")
    first = posts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= heads)
    first.select("term", "id", "weight", "r").write.mode("overwrite").parquet(f"{path}/heads")


def read_postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, heads)"""
    return spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/heads")


def asked_slices(q: DataFrame, index: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """query_id, slice, bound, floor, kept: every slice that holds a term of the query, and whether it can hold one of its k best.

    floor is the k-th best score known from the terms' largest weights alone, so k documents
    reach it; bound adds up the largest weights of the slice's blocks, so none of its documents
    passes it. Only block heads are read, no postings.
    """
    blocks, heads = index
    terms = q.select("query_id", "term", F.col("weight").alias("wq"))
    known = heads.join(R.small(terms), "term").groupBy("query_id", "id").agg(F.sum(F.col("wq") * F.col("weight")).alias("s"))
    best = Window.partitionBy("query_id").orderBy(F.desc("s"))
    floor = known.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("s").alias("floor"), F.count("*").alias("n"))
    floor = floor.select("query_id", F.when(F.col("n") == k, F.col("floor")).otherwise(0.0).alias("floor"))
    bounds = blocks.select("term", "slice", "top").join(R.small(terms), "term").groupBy("query_id", "slice").agg(F.sum(F.col("wq") * F.col("top")).alias("bound"))
    slack = 1e-9 + F.col("floor") * 1e-12  # scores tie to nine places; sums round
    return bounds.join(floor, "query_id").withColumn("kept", F.col("bound") >= F.col("floor") - slack)


def blockmax_topk(q: DataFrame, index: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """V7 from a stored index: the rows of sparse_topk, reading the postings of those slices only whose bound reaches the floor.

    Weights are at least 0, repeated (query, term) rows add up.
    """
    blocks, _ = index
    q = cut(q.groupBy("query_id", "term").agg(F.sum("weight").alias("weight")).where("weight > 0"))
    kept = asked_slices(q, index, k).where("kept").select("query_id", "slice")
    wanted = kept.join(q.select("query_id", "term", F.col("weight").alias("wq")), "query_id")
    # blocks of terms that nobody asks for never reach the shuffle
    met = blocks.join(R.small(q.select("term").distinct()), "term", "left_semi").join(wanted, ["term", "slice"])
    scored = met.select("query_id", "wq", F.explode("block").alias("p")).groupBy("query_id", F.col("p.id").alias("id")).agg(F.sum(F.col("p.weight") * F.col("wq")).alias("score"))
    return R.topk(scored, k)
