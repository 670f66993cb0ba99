"""Filling containers of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.session import cut

_NEVER = np.iinfo(np.int64).max


class Levels:
    """Open containers by fill level, and the rule that picks one.

    counts[l] is the number of open containers filled to l. An item of size s moves a container from level l to l + s, or
    begins one (l = 0), which changes the sum of the squares of counts over all levels between empty and
    full. The level with the least change is taken, the fullest among equals. With closing, the items are those
    that end a packing, when even levels are of no more use: then the fullest level with room is taken.
    """

    def __init__(self, capacity: int, closing: bool = False) -> None:
        self.capacity, self.closing = capacity, closing
        self.counts = np.zeros(capacity + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def level(self, size: int) -> int:
        """The level of the container that takes an item of 0 < size <= capacity; 0 for a new one."""
        top = self.capacity - size
        held = self.counts[: top + 1]
        if self.closing:
            open_ = np.flatnonzero(held)
            return int(open_[-1]) if open_.size else 0
        change = 2 * (self.counts[size:] - held) + 2
        change[top] -= 1  # a full container has no level
        change[held == 0] = _NEVER
        change[0] = 2 * self.counts[size] + 1 if top else 0
        return top - int(change[::-1].argmin())

    def put(self, size: int, new: int) -> int:
        """Places an item and returns its container: an open one, or the number new."""
        level = self.level(size)
        box = new
        if level:
            self.counts[level] -= 1
            box = self.stacks[level].pop()
        if level + size < self.capacity:
            self.counts[level + size] += 1
            self.stacks[level + size].append(box)
        return box


#: Containers of a group are numbered below this.
_ROOM = 1 << 24


def _pack_groups(items: DataFrame, capacity: int, order: list, closing: bool) -> DataFrame:
    """items (grp LONG, size LONG and others) with box: each group packed for itself, its items one at a time in order.

    A task goes through its groups one after the other and holds the open containers of one. The order is total, so a task
    that is run again gives the same boxes.
    """
    names = items.columns
    at, size_at = names.index("grp"), names.index("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, current, made = Levels(capacity, closing), None, 0
        for b in batches:
            boxes = np.zeros(b.num_rows, np.int64)
            for i, (group, size) in enumerate(zip(b.column(at).to_pylist(), b.column(size_at).to_pylist())):
                if group != current:
                    levels, current, made = Levels(capacity, closing), group, 0
                base = group * _ROOM
                if size:
                    if made >= _ROOM:
                        raise OverflowError(f"a group with more than {_ROOM} containers")
                    boxes[i] = levels.put(size, base + made)
                    made += int(boxes[i]) == base + made
                else:
                    boxes[i] = base  # no room is needed: the first container of the group
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(boxes)], names=[*names, "box"])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", box long"
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.repartition(parts, "grp").sortWithinPartitions("grp", *order).mapInArrow(run, spec)


def pack(items: DataFrame, capacity: int = 2048, key: str = "doc_id", group_rows: int = 1 << 16, fan_in: int = 8) -> DataFrame:
    """Puts every item into containers of capacity; an item above capacity is split, no other is.

    items: key (unique, not null) and size (BIGINT; null and negative count as 0); other columns are ignored.
    Returns key, piece (0, 1, ..), start (of the piece in its item), size (of the piece), container STRING. An item
    above capacity gives full pieces, each a container of its own, and a rest, which is packed like any item.
    Items of size 0 go to the first container of their group. An empty table gives no row.

    Items are dealt by a hash to groups of about group_rows, and each group is packed online in a hashed order, by the
    sum-of-squares rule. The containers that groups leave open are then packed as if each was an item, the
    largest first, in a number of groups smaller by fan_in each round, down to groups of group_rows; containers
    so full that not even the emptiest one would fit on top take no part. Only open containers, not items, are moved again.
    A container is named by the round it was last packed in, its group and its number there, so no two rounds share a name.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if not 1 <= group_rows <= _ROOM // 16:
        raise ValueError(f"group_rows must be from 1 to {_ROOM // 16}")
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long")
    items = cut(items.select(key, size.alias("whole")), "sizes")
    groups = -(-items.count() // group_rows) or 1
    full = F.when(F.col("whole") > capacity, F.floor(F.col("whole") / capacity)).otherwise(F.lit(0)).cast("int")
    pieces = items.withColumn("piece", full)
    rest = pieces.withColumn("size", F.col("whole") - F.col("piece") * F.lit(capacity)).where((F.col("size") > 0) | (F.col("piece") == 0))
    turn = F.xxhash64(key)
    rest = rest.select(key, "piece", "size", F.pmod(turn, F.lit(groups)).alias("grp"), turn.alias("turn"))
    placed = cut(_pack_groups(rest, capacity, ["turn", key], False).drop("turn", "grp"), "placed")

    # where each of the first round's containers is now: the round it was packed in last, and its number there
    moves = placed.groupBy("box").agg(F.sum("size").alias("size")).select(F.col("box").alias("first"), F.lit(0).alias("round"), "box", "size")
    rounds = 0
    while True:
        open_ = moves.where((F.col("size") < capacity) & (F.col("size") > 0)).select("round", "box", "size").distinct()
        least = open_.agg(F.min("size").alias("least")).scalar()
        open_ = cut(open_.where(F.col("size") + least <= capacity), "open")
        n, rounds = open_.count(), rounds + 1
        fewer = max(-(-groups // fan_in), -(-n // group_rows))
        if n < 2 or (rounds > 1 and fewer >= groups):
            break
        groups = max(fewer, 1)
        grp = F.pmod(F.xxhash64("round", "box"), F.lit(groups))
        dealt = open_.select(F.col("round").alias("own_round"), F.col("box").alias("own"), "size", grp.alias("grp"))
        packed = cut(_pack_groups(dealt, capacity, [F.desc("size"), "own_round", "own"], True).drop("grp"), "closed")
        sums = packed.groupBy("box").agg(F.sum("size").alias("total"))
        step = packed.join(sums, "box").select("own_round", "own", F.col("box").alias("next"), "total")
        moves = cut(
            moves.join(step, (moves["box"] == step["own"]) & (moves["round"] == step["own_round"]), "left").select(
                "first",
                F.when(F.col("next").isNull(), F.col("round")).otherwise(F.lit(rounds)).alias("round"),
                F.coalesce("next", "box").alias("box"),
                F.coalesce("total", "size").alias("size"),
            ),
            "moves",
        )
    name = F.concat_ws("-", F.concat(F.lit("c"), F.col("round")), F.col("last"))
    rests = placed.join(moves.select(F.col("first").alias("box"), "round", F.col("box").alias("last")), "box").select(key, "piece", "size", name.alias("container"))
    wholes = (
        pieces.where(F.col("piece") > 0)
        .select(key, F.explode(F.sequence(F.lit(0), F.col("piece") - 1)).alias("piece"))
        .select(key, "piece", F.lit(capacity).cast("long").alias("size"), F.concat_ws("-", F.lit("w"), F.col(key), F.col("piece")).alias("container"))
    )
    return rests.unionByName(wholes).select(key, "piece", (F.col("piece").cast("long") * capacity).alias("start"), "size", "container")
