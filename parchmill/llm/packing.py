"""Problem 8: fill containers of fixed capacity by hierarchical residual packing.

Each partition packs its own items best-fit, largest first, and emits the containers that are nearly full. What is left
travels on as items of its own: under-full containers are gathered by a tree that narrows ``FAN_IN`` to one and packs
them best-fit again, until one task holds the rest or a round saves nothing. Containers that none of the others fits into are
done and climb no further. Only (container, fill) pairs move between the levels, never items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import written

#: Containers filled to this share or more are emitted; the others are merged.
NEARLY_FULL = 0.995
#: Partitions of one level that feed one partition of the next.
FAN_IN = 32
#: Items a task packs together: bounds its memory, and is enough for best fit to close nearly all containers.
ROUND_ROWS = 200_000

PACKED = "item string, size bigint, container string, fill bigint"


def best_fit(items: list[str], sizes: list[int], capacity: int) -> tuple[list[str], dict[str, int]]:
    """Container of each item and fill of each container, best fit, largest first.

    A container bears the name of its first item, so names are unique without coordination. Ties go to the item that
    sorts first, so the same items always give the same containers.
    """
    order = sorted(range(len(items)), key=lambda k: (-sizes[k], items[k]))
    room: list[tuple[int, str]] = []  # sorted by space left
    name = [""] * len(items)
    fill: dict[str, int] = {}
    for k in order:
        at = bisect_left(room, (sizes[k], ""))
        if at < len(room):
            left, c = room.pop(at)
        else:
            left, c = capacity, items[k]
            fill[c] = 0
        name[k] = c
        fill[c] += sizes[k]
        if left > sizes[k] or not sizes[k]:
            insort(room, (left - sizes[k], c))
    return name, fill


def _pack(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= ROUND_ROWS:
                yield packed(pd.concat(held), capacity)
                held, rows = [], 0
        if rows:
            yield packed(pd.concat(held), capacity)

    return run


def packed(part: pd.DataFrame, capacity: int) -> pd.DataFrame:
    items, sizes = part["item"].tolist(), part["size"].tolist()
    name, fill = best_fit(items, sizes, capacity)
    return pd.DataFrame({"item": items, "size": sizes, "container": name, "fill": [fill[c] for c in name]})


def pieces(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """One row an item, or several for an item over ``capacity``: full pieces and the rest."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(capacity))).cast("int")
    return (
        df.select(F.col(key), F.col(size).cast("bigint").alias("__size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
        .withColumn("start", F.col("piece").cast("bigint") * capacity)
        .withColumn("size", F.least(F.col("__size") - F.col("start"), F.lit(capacity).cast("bigint")))
        .withColumn("item", F.concat_ws(".", F.col(key).cast("string"), F.col("piece").cast("string")))
        .drop("__size")
    )


def _under_full(packed_rows: DataFrame, capacity: int) -> DataFrame:
    """The containers that are not nearly full, once each, as items of their fill."""
    rows = packed_rows.where(F.col("fill") < F.lit(capacity * NEARLY_FULL))
    return rows.select(F.col("container").alias("item"), F.col("fill").alias("size")).distinct()


def fill_containers(df: DataFrame, key: str, size: str, capacity: int = 1024) -> DataFrame:
    """(key, piece, start, size, container): every item once, no container over ``capacity``.

    An item is split only if it alone exceeds the capacity. A null size counts as 0; items of size 0 take no room and
    are put where there is any. ``key`` must be unique and not null. An empty table gives an empty result; extra columns
    are dropped. Each level is written to the shared folder, so a lost executor costs one level at most.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    clean = df.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).alias("__n"))
    items = written(pieces(clean, key, "__n", capacity), "items")
    level = items.select("item", "size")
    first = written(level.mapInPandas(_pack(capacity), PACKED), "packed")
    width, moved, step_no = first.rdd.getNumPartitions(), None, 0
    under = _under_full(first, capacity)
    while True:
        least = under.agg(F.min("size")).first()[0]
        # what the least of them does not fit into takes no other either: it is as full as it gets
        open_ = under.where(F.col("size") + F.lit(least) <= capacity)
        n = open_.count() if least is not None else 0
        if n < 2:
            break
        # no task gets more than ROUND_ROWS on average, however much is under-full
        width, step_no = max(-(-width // FAN_IN), -(-n // ROUND_ROWS)), step_no + 1
        again = written(open_.repartition(width, F.xxhash64("item", F.lit(step_no))).mapInPandas(_pack(capacity), PACKED), "merged")
        step = again.where(F.col("item") != F.col("container")).select(F.col("item").alias("from"), F.col("container").alias("to"))
        saved = not step.isEmpty()
        if saved and moved is None:
            moved = step
        elif saved:  # where an earlier level put a container, and where that one went
            s = step.withColumnsRenamed({"from": "via", "to": "next"})
            onward = moved.join(s, F.col("to") == F.col("via"), "left").select("from", F.coalesce("next", "to").alias("to"))
            moved = onward.unionByName(step)
        if width == 1 or not saved:
            break
        under = _under_full(again, capacity)
    if moved is None:
        return items.join(first.select("item", "container"), "item").select(key, F.col("piece").cast("bigint").alias("piece"), "start", "size", "container")
    located = first.select("item", "container").join(moved, F.col("container") == F.col("from"), "left")
    located = located.select("item", F.coalesce("to", "container").alias("container"))
    return items.join(located, "item").select(key, F.col("piece").cast("bigint").alias("piece"), "start", "size", "container")
