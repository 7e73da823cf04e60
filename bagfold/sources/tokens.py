"""Bags of vectors as tables.

Canonical are the token table ``(id, pos, vec)`` and the bag table ``(id, vecs)``, one row an item; ids are always a column,
never a position. Parquet stores lists as values and offsets, so nothing else is needed to hold bags compactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VEC = "array<float>"


def split_suffix(split: str) -> str:
    """Stored tables of the test and dev splits have plain names, others end in ``_split``."""
    return "" if split in ("test", "dev") else f"_{split}"


def explode_bags(bags: DataFrame, id: str = "id", vecs: str = "vecs", dimension: int | None = None) -> DataFrame:
    """Token table of a bag table; vectors of another width than ``dimension`` are an error."""
    out = bags.select(F.col(id).alias("id"), F.posexplode(F.col(vecs)).alias("pos", "vec"))
    return checked(out, dimension)


def checked(tokens: DataFrame, dimension: int | None) -> DataFrame:
    if dimension is None:
        return tokens.withColumn("vec", F.col("vec").cast(VEC))
    wrong = F.raise_error(F.concat(F.lit(f"a vector should have {dimension} numbers; it has "), F.size("vec").cast("string"))).cast(VEC)
    return tokens.withColumn("vec", F.when(F.size("vec") == dimension, F.col("vec").cast(VEC)).otherwise(wrong))


def pack(tokens: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Bag table of a token table; with ``ids``, items without tokens are empty bags."""
    bags = tokens.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "vec"))), lambda t: t["vec"]).alias("vecs"))
    if ids is None:
        return bags
    return ids.select("id").join(bags, "id", "left").withColumn("vecs", F.coalesce("vecs", F.expr(f"cast(array() as array<{VEC}>)")))


def lengths(bags: DataFrame) -> DataFrame:
    return bags.select("id", F.size("vecs").cast("long").alias("length"))


def drop_empty(bags: DataFrame) -> DataFrame:
    return bags.filter(F.size("vecs") > 0)


def gather(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    """Tokens of the items in ``ids`` (ord, id), in that order; ids may repeat."""
    return ids.select("ord", "id").join(tokens, "id").select("ord", "id", "pos", "vec")


def sample_ids(ids: DataFrame, rate: float, seed: int) -> DataFrame:
    """max(1, int(n * rate)) ids without replacement: those of least seeded hash.

    Counts by the hash's first 16 bits tell where the sample ends; only the ids of that one part (a 65 536th of all) are sorted.
    """
    keyed = ids.select("id", F.xxhash64("id", F.lit(seed)).alias("hash")).withColumn("part", F.shiftright("hash", 48))
    sizes = sorted((r["part"], r["count"]) for r in keyed.groupBy("part").count().collect())  # 65 536 rows at most
    left = max(1, int(sum(c for _, c in sizes) * rate))
    for part, count in sizes:
        if count >= left:
            return keyed.filter(F.col("part") < part).select("id").unionByName(keyed.filter(F.col("part") == part).orderBy("hash", "id").limit(left).select("id"))
        left -= count
    return keyed.select("id")


def sample_rows(n: int, rate: float, seed: int) -> np.ndarray:
    """Positions of a sample as a NumPy generator draws them, for parity with array code."""
    return np.random.default_rng(seed).choice(n, size=max(1, int(n * rate)), replace=False)


def save_bags(bags: DataFrame, path: str) -> None:
    bags.write.mode("overwrite").parquet(path)


def load_bags(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """Saved bags with 32-bit vectors; the width is checked where a row is read."""
    bags = spark.read.parquet(path)
    if dimension is not None:
        odd = F.exists("vecs", lambda v: F.size(v) != dimension)
        bags = bags.filter(F.when(odd, F.raise_error(F.lit(f"a bag has a vector that isn't {dimension} wide")).cast("boolean")).otherwise(F.lit(True)))
    return bags.withColumn("vecs", F.col("vecs").cast(f"array<{VEC}>"))


def ensure_saved(spark: SparkSession, path: str, source: Callable[[], DataFrame | None]) -> DataFrame:
    """The bags at ``path``; written from ``source`` first if they are not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        bags = source()
        if bags is None:
            raise FileNotFoundError(f"{path} doesn't exist, and there is no source to make it from")
        save_bags(bags, path)
    return load_bags(spark, path)


def from_arrays(spark: SparkSession, items: list[tuple[object, np.ndarray]], id_type: str = "long") -> DataFrame:
    """Bag table of in-memory matrices (small inputs and tests)."""
    return spark.createDataFrame([(i, np.asarray(m, np.float32).tolist()) for i, m in items], f"id {id_type}, vecs array<{VEC}>")


def text_words(text: str) -> F.Column:  # type: ignore[name-defined]
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \n\t\r]+"), lambda x: x != "")


def vector_of(token, vectors: int) -> F.Column:  # type: ignore[name-defined]
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % vectors


def text_tokens(texts: DataFrame, vectors: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, token, vec_id): white-space tokens in lower case, each hashed to one of ``vectors`` vectors."""
    out = texts.select(F.col(id).alias("id"), F.posexplode(text_words(text)).alias("pos", "token"))
    return out.withColumn("vec_id", vector_of(F.col("token"), vectors))


def text_vector_ids(texts: DataFrame, vectors: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, vec_ids): the vectors of ``text_tokens`` in their order, a row a text, without a shuffle."""
    return texts.select(F.col(id).alias("id"), F.transform(text_words(text), lambda w: vector_of(w, vectors)).alias("vec_ids"))


def by_repetition(texts: DataFrame, id: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other row has, and the others with those without an id (None if there are none). Only ids are shuffled."""
    again = texts.groupBy(F.col(id).alias("again")).agg(F.count("*").alias("n")).filter("n > 1 or again is null").select("again")
    if again.isEmpty():
        return texts, None
    own = F.col(id) == F.col("again")
    return texts.filter(F.col(id).isNotNull()).join(again, own, "left_anti"), texts.join(again, F.col(id).eqNullSafe(F.col("again")), "left_semi")


def sampled_rows(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """The rows whose ids are in ``sample_ids``, found by the last hash and id of the sample, without a join."""
    keyed = rows.select("id", F.xxhash64("id", F.lit(seed)).alias("hash")).withColumn("part", F.shiftright("hash", 48))
    sizes = sorted((r["part"], r["count"]) for r in keyed.groupBy("part").count().collect())  # 65 536 rows at most
    left = max(1, int(sum(c for _, c in sizes) * rate))
    rows, own = rows.filter("id is not null"), F.xxhash64("id", F.lit(seed))
    for part, count in sizes:
        if count >= left:
            last = keyed.filter(F.col("part") == part).orderBy("hash", "id").limit(left).orderBy(F.desc("hash"), F.desc("id")).first()
            return rows.filter((own < last["hash"]) | ((own == last["hash"]) & (F.col("id") <= last["id"])))
        left -= count
    return rows
