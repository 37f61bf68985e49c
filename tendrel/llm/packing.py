"""Problem 7: filling containers of a fixed capacity with items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendrel.llm.tokens import VOCABULARY, with_tokens
from tendrel.session import materialise

#: A bin this full is finished where it is made.
FULL = 0.995
#: Most bins one task packs in a round; a round has as many tasks as that takes, whatever the number of items.
AT_ONCE = 50_000
#: A round that frees fewer than one bin in so many is the last.
WORTH = 1000

_ITEM = pa.struct([("id", pa.int64()), ("part", pa.int32()), ("size", pa.int32())])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each item, largest first, goes where it leaves least room. Returns the bins' item numbers.

    Bins wait in a list for each room; a bit set of the rooms in use gives the smallest that fits in one step.
    """
    waiting: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    rooms, done = 0, []
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            box = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            room, box = capacity, []
        box.append(i)
        left = room - size
        if left == 0:
            done.append(box)
        else:
            waiting[left].append(box)
            rooms |= 1 << left
    return done + [box for stack in waiting for box in stack]


def _pack(capacity: int):
    """One task's bins (used, items) packed into fuller ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[int] = []
        items: list[pa.Array] = []
        for b in batches:
            sizes.extend(b.column(0).to_pylist())
            items.append(b.column(1))
        if not sizes:
            return
        whole = pa.concat_arrays(items)
        bins = best_fit(sizes, capacity)
        flat = whole.flatten()
        starts = whole.offsets.to_pylist()
        base = starts[0]
        for at in range(0, len(bins), 10_000):
            order, offsets, used, merged = [], [0], [], []
            for box in bins[at : at + 10_000]:
                for i in box:
                    order.extend(range(starts[i] - base, starts[i + 1] - base))
                offsets.append(len(order))
                used.append(sum(sizes[i] for i in box))
                merged.append(len(box))
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.take(pa.array(order, pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), listed, pa.array(merged, pa.int32())], ["used", "items", "merged"])

    return run


_BINS = "used int, items array<struct<id:bigint,part:int,size:int>>, merged int"


def pack(items: DataFrame, capacity: int, full: float = FULL, at_once: int = AT_ONCE) -> DataFrame:
    """(used, items) of bins that hold every row (id, part, size) of items once; sizes are 1 to capacity.

    Hierarchical residual packing: each partition is packed by best fit; bins that are full to `full` are done, the
    others go on as items of their own into a round with a few partitions only, filled at random, and so on up the tree
    until one partition has been packed by itself or a round frees fewer than one bin in WORTH. No task ever gets more
    than about at_once bins, so if more than that stay underfull (say, all items over half the capacity) they stay as
    they are once packing them in other company no longer helps.
    """
    first = items.where((F.col("size") > 0) & (F.col("size") <= capacity)).select(F.col("size").cast("int").alias("used"), F.array(F.struct(F.col("id").cast("bigint").alias("id"), F.col("part").cast("int").alias("part"), F.col("size").cast("int").alias("size"))).alias("items"))
    done: DataFrame | None = None
    state = materialise(first.mapInArrow(_pack(capacity), _BINS))
    threshold = max(1, int(capacity * full))
    before: tuple[int, int] | None = None
    while True:
        finished = state.where(F.col("used") >= threshold).select("used", "items")
        done = finished if done is None else done.unionByName(finished)
        rest = state.where(F.col("used") < threshold).select("used", "items")
        count, room = rest.agg(F.count("*"), F.coalesce(F.sum(capacity - F.col("used")), F.lit(0))).first()
        tasks = -(-count // at_once)
        # less than one bin's room in all can't free a bin, nor can one task that had these bins before
        last = count <= 1 or room < capacity or before is not None and (before[1] == 1 or tasks > 1 and (before[0] - count) * WORTH < before[0])
        if last:
            return done.unionByName(rest)
        before = (count, tasks)
        spread = rest.coalesce(1) if tasks == 1 else rest.repartition(tasks)
        state = materialise(spread.mapInArrow(_pack(capacity), _BINS))


def fill_containers(df: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, used, key, part, parts, first_token, tokens): every text in a container of capacity tokens.

    A text larger than the capacity is cut into parts of just the capacity and a rest (part counts from 1, first_token
    from 0); all others stay whole. Null and empty texts and null keys take no room and are left out; repeated keys
    count once; other columns are ignored. A container is named by its least item, as key * 2**20 + part would sort.
    """
    docs = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("bigint").alias("id"), text)
    sized = with_tokens(docs, text, "id", vocabulary=vocabulary).dropDuplicates(["id"])
    parts = F.ceil(F.col("tokens") / capacity).cast("int")
    items = sized.select("id", parts.alias("parts"), "tokens", F.explode(F.sequence(F.lit(1), parts)).alias("part"))
    items = items.select("id", "part", F.least(F.lit(capacity), F.col("tokens") - (F.col("part") - 1) * capacity).cast("int").alias("size"))
    bins = pack(items, capacity)
    least = F.array_min("items")
    named = bins.select(F.concat_ws("-", least["id"], least["part"]).alias("container_id"), "used", F.explode("items").alias("i"))
    return named.select(
        "container_id", "used", F.col("i.id").alias(key), F.col("i.part").alias("part"), ((F.col("i.part") - 1) * capacity).alias("first_token"), F.col("i.size").alias("tokens")
    )


def fill_report(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, tokens, fill, fewest): how many containers there are, the share of their room in use, and how many
    that many tokens need at least."""
    each = containers.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    return each.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"), F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("fewest"),
    )
