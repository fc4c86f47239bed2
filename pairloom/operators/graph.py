"""Connected components and what follows from them: group ids, stable splits, leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.storage import discard, fresh_path, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is named by its smallest node.

    Alternates the large-star and small-star steps until the edge set no longer changes, so the number of rounds grows
    with the logarithm of a component's size. Each round aggregates before it joins back, and ends in a table of the
    shared folder, which goes when the next round has its own. Null ends are ignored, self loops give a component of one
    node, repeated edges count once.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    cur = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path=path)
    alone = cur.where("u = v").select("u")
    first, cur, state = path, cur.where("u <> v"), None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        before, path = path, fresh_path(spark, "edges")
        cur = materialise(small.where("u <> v").distinct(), path=path)
        if before != first:
            discard(before)
        row = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    # What is left are stars: every node but the least points to the least.
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    loops = alone.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return found.union(roots.union(loops)).groupBy("node").agg(F.min("component").alias("component"))


def shared_keys(rows: DataFrame, node: str, keys: list[Column]) -> DataFrame:
    """Edges ``a, b`` between the rows that share a value of a key: each with the least of them, so a key of any size
    adds no more edges than it has rows. Nulls are no values; keys seen once link nothing."""
    long = rows.select(F.col(node).alias("a"), F.posexplode(F.array(*(k.cast("string") for k in keys))).alias("kind", "value")).where("value is not null")
    least = long.groupBy("kind", "value").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b <> most")
    return long.join(least, ["kind", "value"]).where("a <> b").select("a", "b").distinct()


def group_id(sources: str | Column) -> Column:
    """From an array of source names: the hash of their sorted JSON list, written with a blank after each comma."""
    names = F.array_sort(F.array_distinct(F.transform(sources, lambda s: s.cast("string"))))
    return F.sha2(F.lower(F.concat(F.lit('["'), F.array_join(names, '", "'), F.lit('"]'))), 256)


def unit_hash(digest: Column) -> Column:
    """The first 64 bits of a hexadecimal digest as a fraction of 2^64."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_split(group: Column, seed: int = 42, train: float = 0.8, validation: float = 0.9) -> Column:
    """A split that depends on the group and seed alone."""
    v = unit_hash(F.sha2(F.lower(F.concat(F.lit(f"{seed}:"), group)), 256))
    return F.when(v < train, "train").when(v < validation, "validation").otherwise("test")


def leaks(rows: DataFrame, keys: list[str], split: str = "split", folded: tuple[str, ...] = ()) -> DataFrame:
    """``key, value, splits``: values of ``keys`` that occur in more than one split; those of ``folded`` whatever their case."""
    value = lambda k: F.lower(F.col(k).cast("string")) if k in folded else F.col(k).cast("string")
    long = rows.select(split, F.explode(F.array(*(F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in keys))).alias("x"))
    return long.where("x.value is not null").groupBy("x.key", "x.value").agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def one_split(rows: DataFrame, source: str, split: str = "split") -> DataFrame:
    """Each source with its split; an error names a source that has several."""
    by = rows.groupBy(source).agg(F.collect_set(split).alias("s"))
    problem = F.raise_error(F.concat(F.lit("several splits: "), F.col(source).cast("string"))).cast("string")
    return by.select(source, F.when(F.size("s") > 1, problem).otherwise(F.get("s", F.lit(0))).alias(split))
