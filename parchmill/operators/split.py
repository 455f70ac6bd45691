"""Group splits without leakage: shared-text pairs, connected components, exact-count assignment."""

from __future__ import annotations

import random
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmill.functions import text as tx
from parchmill.session import written

RATIOS = {"train": 0.8, "valid": 0.1, "test": 0.1}


def shared_text_pairs(df: DataFrame, group: str = "contract", text: str = "clause_text", min_shared: int = 3) -> DataFrame:
    """(a, b, shared): unordered pairs of groups of one company that share ``min_shared`` distinct texts or more.

    The company key is part of the join, so a text that stands in very many groups pairs only within a company; the
    result is the same as filtering afterwards, since the key depends on the group's name alone. Null names and texts
    join nothing.
    """
    names = df.select(F.col(group).alias("g"), F.col(text).alias("t")).where("g is not null and t is not null").distinct()
    keyed = names.withColumn("k", tx.company_key(F.col("g")))
    a, b = keyed.withColumnRenamed("g", "a"), keyed.withColumnRenamed("g", "b")
    pairs = a.join(b, ["k", "t"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.where(F.col("shared") >= min_shared)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of each node of the undirected ``edges`` (a, b); the root is the component's least node.

    Each round every node takes the least label of its neighbours and then the label of its label, so long chains
    shorten geometrically. Rounds are written to the shared folder to cut the lineage; only one number comes back.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        better = label.join(near, label["node"] == near["a"], "left").select("node", "root", F.least("root", "near").alias("new"))
        up = better.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        jumped = better.join(up, "new", "left").select("node", F.col("root").alias("old"), F.least("new", "jump").alias("root"))
        step = written(jumped, "labels")
        label = step.select("node", "root")
        if step.where("root <> old").isEmpty():
            return label
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def duplicate_groups(df: DataFrame, group: str = "contract", text: str = "clause_text", min_shared: int = 3) -> DataFrame:
    """(group, canonical) of the groups that are spellings of one another, by shared texts within a company."""
    found = components(shared_text_pairs(df, group, text, min_shared))
    return found.select(F.col("node").alias(group), F.col("root").alias("canonical"))


def numbered(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """Add the row's 0-based place in the total order, without gathering the rows in one task.

    Rows are range-partitioned and sorted; the partitions' row counts, one number each, give the offsets.
    """
    cols = [F.col(c) for c in order]
    spread = df.repartitionByRange(*cols).withColumn("__p", F.spark_partition_id())
    fixed = written(spread, "ranged")
    counts = fixed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(
        "__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before")
    )
    local = fixed.withColumn("__at", F.row_number().over(Window.partitionBy("__p").orderBy(*cols)))
    return local.join(before, "__p").withColumn(out, (F.col("__before") + F.col("__at") - 1).cast("bigint")).drop("__p", "__before", "__at")


def cuts(n: int, ratios: Mapping[str, float]) -> list[tuple[str, int]]:
    """Upper rank of each split; the last takes the remainder. Halves are rounded to even."""
    names, out, at = list(ratios), [], 0
    for name in names[:-1]:
        at += round(n * ratios[name])
        out.append((name, at))
    return [*out, (names[-1], n)]


def assign_groups(names: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = 42) -> DataFrame:
    """(name, split) of each distinct non-null name, by hash order and exact counts."""
    distinct = names.toDF("name").where("name is not null").distinct()
    ranked = numbered(distinct.withColumn("__h", tx.hash_order(seed, F.col("name"))), "__h", "name")
    # the total is the last rank plus one: one number to the driver
    n = ranked.agg(F.coalesce(F.max("rank") + 1, F.lit(0))).first()[0]
    split = F.lit(None).cast("string")
    for name, end in reversed(cuts(n, ratios)):
        split = F.when(F.col("rank") < end, F.lit(name)).otherwise(split)
    return ranked.select("name", split.alias("split"))


#: More names than this are not brought to the driver.
MAX_NAMES = 1_000_000


def split_exact(names: DataFrame, ratios: Mapping[str, float] = RATIOS, seed: int = 42) -> DataFrame:
    """(name, split) by :func:`assign_groups_exact`, whose generator only a driver can run: too many names are an error."""
    distinct = names.toDF("name").where("name is not null").distinct()
    n = distinct.limit(MAX_NAMES + 1).count()
    if n > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names: use assign_groups")
    chosen = assign_groups_exact([r[0] for r in distinct.toLocalIterator()], ratios, seed)
    return names.sparkSession.createDataFrame(sorted(chosen.items()), "name string, split string")


def assign_groups_exact(names: list[str], ratios: Mapping[str, float] = RATIOS, seed: int = 42) -> dict[str, str]:
    """The same split by a seeded Mersenne Twister shuffle of the sorted distinct names, on the driver.

    For the few thousand names that a driver holds; :func:`assign_groups` has no such bound.
    """
    order = sorted(set(names))
    random.Random(seed).shuffle(order)
    out, start = {}, 0
    for split, end in cuts(len(order), ratios):
        out |= dict.fromkeys(order[start:end], split)
        start = max(start, end)
    return out


def split_records(
    df: DataFrame,
    ratios: Mapping[str, float] = RATIOS,
    seed: int = 42,
    group: str = "contract",
    text: str = "clause_text",
    dedupe: bool = True,
    min_shared: int = 3,
) -> DataFrame:
    """Add ``split``: all rows of a group, and of its duplicate spellings, in one split. A null group gives a null split."""
    if dedupe:
        same = duplicate_groups(df, group, text, min_shared)
        mapped = df.join(same, group, "left").withColumn("canonical", F.coalesce("canonical", group))
    else:
        mapped = df.withColumn("canonical", F.col(group))
    where = assign_groups(mapped.select("canonical"), ratios, seed).withColumnRenamed("name", "canonical")
    return mapped.drop("split").join(where, "canonical", "left").drop("canonical")


def leakage(df: DataFrame, group: str = "contract", split: str = "split") -> DataFrame:
    """Each group with its rows, the splits it stands in, and whether that is more than one: none leaks if the split is sound."""
    n = F.countDistinct(split)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), n.alias("n_splits"), (n > 1).alias("leaks"))


def agreement(a: DataFrame, b: DataFrame, key: str = "id", split: str = "split") -> DataFrame:
    """How many keys two tables put in which splits: (split_a, split_b, n), null where one table lacks the key."""
    x, y = a.select(key, F.col(split).alias("split_a")), b.select(key, F.col(split).alias("split_b"))
    return x.join(y, key, "full").groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n"))


def split_counts(df: DataFrame, group: str = "contract", split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))
