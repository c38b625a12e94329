"""Items of varying size packed into containers of fixed capacity."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.session import checkpoint

#: Items in one packing task; fill from which a container is final; share of its items that a round must have placed
#: for another to follow.
TASK_ITEMS, NEARLY_FULL, LEAST_PLACED = 50_000, 0.99, 0.1


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (1 to ``capacity``): largest first, each into the fullest container it fits.

    Containers are kept by the room they have; a bit mask over rooms finds the smallest one that is enough.
    """
    out = np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        enough = mask >> size
        if enough:
            room = (enough & -enough).bit_length() - 1 + size
            container = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, container, opened = capacity, opened, opened + 1
        out[i] = container
        if room > size:
            by_room[room - size].append(container)
            mask |= 1 << (room - size)
    return out


def pack(items: DataFrame, item_id: str, size: str, capacities: dict[int, int], task_items: int = TASK_ITEMS) -> DataFrame:
    """Assign each item to a container, once for each capacity of ``capacities`` (by specification number).

    Result: ``spec_id, container_id`` (unique in a specification), ``item_id, part_no, size``. An item larger than the
    capacity is cut into full parts, each a container, and a rest that is packed like an item; no other item is cut.
    Items of null, zero or negative size take no room: they come out with null container and size 0. Rows that repeat
    an item are items of their own. Other columns are not carried along.

    Round by round: hash partitions of at most about ``task_items`` items are packed by best fit; containers nearly
    full are final; the items of the others go, with those of neighbouring partitions, into fewer partitions for
    another round. Rounds end when what is left was packed in one task, or when a round placed less than
    ``LEAST_PLACED`` of its items for good; their number has no bound. No task ever holds more than its share. Sizes
    are computed once and written to the checkpoint folder, and so is what a round leaves.
    """
    specs = F.array(*[F.struct(F.lit(k).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(capacities.items())])
    amount = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    # Ids may repeat or be null, so each row has a number of its own, which the checkpoint makes final.
    sized = checkpoint(items.select(F.col(item_id).alias("item_id"), amount.alias("amount")).withColumn("row", F.monotonically_increasing_id()))
    rows = sized.select("*", F.inline(specs))
    kind = rows.schema["item_id"].dataType.simpleString()
    whole = F.when(F.col("amount") > F.col("capacity"), F.floor(F.col("amount") / F.col("capacity")).cast("long")).otherwise(0)
    rows = rows.withColumn("whole", whole).withColumn("rest", F.col("amount") - F.col("whole") * F.col("capacity"))
    # Parts that are containers of their own, and items without size, in one pass; both come from the numbered rows.
    parts = F.transform(F.sequence(F.lit(1).cast("long"), F.col("whole")), lambda k: F.struct(F.concat_ws("-", F.lit("full"), "row", k).alias("container_id"), k.alias("part_no"), F.col("capacity").alias("size")))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("container_id"), F.lit(0).cast("long").alias("part_no"), F.lit(0).cast("long").alias("size")))
    placed = rows.filter((F.col("whole") > 0) | (F.col("amount") == 0)).select("spec_id", "item_id", F.inline(F.when(F.col("whole") > 0, parts).otherwise(nothing)))
    spread = F.xxhash64("item_id", "row", "spec_id")
    todo = rows.filter("rest > 0").select("spec_id", "capacity", "item_id", F.when(F.col("whole") > 0, F.col("whole") + 1).otherwise(0).alias("part_no"), F.col("rest").alias("size"), spread.alias("spread"))
    schema = f"spec_id int, capacity long, item_id {kind}, part_no long, size long, spread long, part int, container long, final boolean"

    def local(group: pd.DataFrame) -> pd.DataFrame:
        capacity = int(group["capacity"].iloc[0])
        sizes = group["size"].to_numpy(np.int64)
        container = best_fit(sizes, capacity)
        fill = np.bincount(container, weights=sizes)
        return group.assign(container=container, final=fill[container] >= NEARLY_FULL * capacity)

    done: list[DataFrame] = []
    left = {r["spec_id"]: r["n"] for r in todo.groupBy("spec_id").agg(F.count("*").alias("n")).collect()}
    turn = 0
    while left:
        tasks = {k: -(-n // task_items) for k, n in left.items()}
        count = F.try_element_at(F.create_map(*[F.lit(x) for kv in tasks.items() for x in kv]), F.col("spec_id"))
        # The task is a prefix of the hash, so fewer tasks merge neighbours. The shift keeps the product in range.
        part = F.shiftright(F.shiftrightunsigned("spread", 32) * count, 32).cast("int")
        packed = checkpoint(todo.drop("part").withColumn("part", part).groupBy("spec_id", "part").applyInPandas(local, schema))
        now = {r["spec_id"]: r["n"] for r in packed.filter("not final").groupBy("spec_id").agg(F.count("*").alias("n")).collect()}
        again = [k for k, n in now.items() if tasks[k] > 1 and n < (1 - LEAST_PLACED) * left[k]]
        on = F.col("final") | ~F.col("spec_id").isin(again) if again else F.lit(True)
        number = F.concat_ws("-", F.lit(f"r{turn}"), "part", "container")
        done.append(packed.filter(on).select("spec_id", number.alias("container_id"), "item_id", "part_no", "size"))
        left = {k: now[k] for k in again}
        todo = packed.filter(~on).drop("container", "final", "part") if again else todo
        turn += 1
    columns = ["spec_id", "container_id", "item_id", "part_no", "size"]
    return reduce(DataFrame.unionByName, [*done, placed.select(columns)])


def fill_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Per specification: containers, tokens, the share of room used, and the least number of containers possible."""
    room = F.try_element_at(F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv]), F.col("spec_id")).cast("long")
    out = packed.filter("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    out = out.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("n").alias("parts"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return out.select("spec_id", room.alias("capacity"), "containers", "parts", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * room)).alias("fill"), F.ceil(F.col("tokens") / room).alias("least_containers"))
