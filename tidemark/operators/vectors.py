"""Vector arithmetic on array columns: higher-order functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalised(a: Column) -> Column:
    """Length one; a zero vector stays zero."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))[0]


def centroids(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, centroid, size): the normalised mean of normalised vectors. Sums by position combine
    on the map side, so a large cluster costs one row of partial sums a task."""
    rows = df.select(key, F.posexplode(normalised(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    means = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("a"), F.max("n").alias("size"))
    return means.select(key, normalised(F.transform("a", lambda x: x["m"])).alias("centroid"), "size")


def cohesion(df: DataFrame, cents: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, cohesion_score): mean cosine of members to their centroid."""
    return df.join(cents.select(key, "centroid"), key).groupBy(key).agg(F.avg(dot(normalised(F.col(vector)), F.col("centroid"))).alias("cohesion_score"))


def batch_metrics(df: DataFrame, vector: str = "embedding", truncated: str | None = None) -> DataFrame:
    """Norm statistics, truncated share and mean pairwise cosine, from the sum of unit vectors:
    (|sum|^2 - m) / (n (n - 1)), so no pair is ever formed; 1 for a single vector."""
    rows = df.select(norm(F.col(vector)).alias("n"), normalised(F.col(vector)).alias("u"), (F.col(truncated).cast("int") if truncated else F.lit(0)).alias("t"))
    stats = rows.agg(
        F.count("*").alias("n_vectors"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"), F.min("n").alias("norm_min"), F.max("n").alias("norm_max"),
        F.avg("t").alias("truncated_ratio"), F.count_if(F.col("n") > 0).alias("m"),
    )
    sums = rows.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = F.col("n_vectors")
    pairwise = F.when(n <= 1, 1.0).otherwise((F.col("q") - F.col("m")) / (n * (n - 1)))
    return stats.crossJoin(F.broadcast(sums)).select("n_vectors", "norm_mean", "norm_std", "norm_min", "norm_max", "truncated_ratio", pairwise.alias("mean_pairwise_cosine"))  # one row each


def pool_chunks(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean of a document's chunk vectors, length one."""
    rows = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("a")).select(key, normalised(F.transform("a", lambda x: x["m"])).alias("embedding"))


def encode(df: DataFrame, backend, dimension: int, id_col: str = "doc_id", text_col: str = "text_used") -> DataFrame:
    """``backend``: list of texts -> list of vectors; made once for each task, checked for dimension."""

    def run(batches):
        import pandas as pd

        for b in batches:
            vectors = [list(map(float, v)) for v in backend(b[text_col].tolist())]
            if any(len(v) != dimension for v in vectors):
                raise ValueError(f"the encoder must give {dimension} numbers")
            yield pd.DataFrame({id_col: b[id_col], "embedding": vectors})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<double>")


def hashed_backend(dimension: int = 64):
    """A deterministic stand-in for a text encoder: hashed character trigrams."""

    def run(texts):
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dimension
            for i in range(max(1, len(t) - 2)):
                h = zlib.crc32(t[i : i + 3].encode())
                v[h % dimension] += 1.0 if h & 0x80000000 else -1.0
            out.append(v)
        return out

    return run


def check_model(embeddings: DataFrame, name: str, version: str) -> None:
    """Raises if stored vectors come from another model or version; reads two names at most."""
    other = embeddings.select("model_name", "model_version").distinct().limit(2).collect()
    if other and {tuple(r) for r in other} != {(name, version)}:
        raise ValueError("the stored vectors come from another model or version")
