"""Problem 9: filling containers of fixed capacity, best fit under conflicts.

Open containers are ordered by what room they have left. An item goes to the
tightest one it fits and has no conflict with: the search begins at the item's
size and moves on to the next larger room as long as a container's bitmaps
forbid it. A container never takes two copies of one text; among containers
about as tight it prefers one that has nothing of the item's source yet. Only
copies forbid, since a source may hold a third of all texts.

Copies are of one size and come one after another, so the search for one of
them goes on where that for the last one ended: however many copies there are,
each container is passed over once, and once more for each source among them.
All other items find a container without their source by a heap for the room
and the source, so that every container within the slack counts.

Shards of bounded size are packed side by side, large items first. Containers
that a shard leaves with room go apart again and are packed anew in fewer
shards, as long as that saves containers.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SHARD_ITEMS = 20_000
#: Containers at least so full are closed for good after a round; of the capacity.
CLOSED = 0.98
#: Packing anew ends when it saves a smaller share of the containers that were packed anew.
GAIN = 0.002
#: Room, as a share of the capacity, within which a fresh source is preferred to a tighter fit.
SOURCE_SLACK = 1 / 128


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, slack: float = SOURCE_SLACK) -> list[int]:
    """The container of each item, by number; items must not exceed the capacity.

    ``clusters`` names copies of one text (None: no copy of anything).
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    place = {c: i for i, c in enumerate(dict.fromkeys(clusters))}
    seen, twice = set(), {}
    for c in clusters:
        if c is not None and c in seen and c not in twice:
            twice[c] = 1 << len(twice)
        seen.add(c)
    rooms: list[tuple[int, int]] = []  # (room left, container), ascending
    room_of: list[int] = []
    #: by room and source the containers without the source, once they were asked for; what no longer holds is dropped when it comes up
    fresh: dict[int, dict[int, list[int]]] = {}
    has_source: list[int] = []
    has_cluster: list[int] = []
    out = [0] * len(sizes)
    near = int(capacity * slack)
    now, begin, passed = None, (0, -1), {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], place[clusters[i]], i)):
        size, sbit, cbit = sizes[i], source_bit[sources[i]], twice.get(clusters[i], 0)
        # what a copy was turned away from stays forbidden to the next copy of its size
        if not cbit or now != (size, cbit):
            now, begin, passed = (size, cbit), (size, -1), {}
        best = bisect_left(rooms, begin)
        while best < len(rooms) and has_cluster[rooms[best][1]] & cbit:
            best += 1
        if best == len(rooms):
            best = -1
        else:
            begin = rooms[best]
            if has_source[begin[1]] & sbit:
                most = begin[0] + near
                if cbit:  # the next copy of this source goes on where this one ends
                    at = bisect_left(rooms, max(begin, passed.get(sbit, begin)))
                    while at < len(rooms) and rooms[at][0] <= most and (has_cluster[rooms[at][1]] & cbit or has_source[rooms[at][1]] & sbit):
                        at += 1
                    passed[sbit] = rooms[at] if at < len(rooms) else (capacity + 1, -1)
                    if at < len(rooms) and rooms[at][0] <= most:
                        best = at
                else:
                    at = best
                    while at < len(rooms) and rooms[at][0] <= most:
                        room = rooms[at][0]
                        end = bisect_left(rooms, (room + 1, -1), at)
                        free = fresh.setdefault(room, {})
                        if sbit not in free:
                            free[sbit] = [b for _, b in rooms[bisect_left(rooms, (room, -1)) : end] if not has_source[b] & sbit]
                        heap = free[sbit]
                        while heap and (room_of[heap[0]] != room or has_source[heap[0]] & sbit):
                            heappop(heap)
                        if heap:
                            best = bisect_left(rooms, (room, heap[0]))
                            break
                        at = end
        if best < 0:
            box, room, begin = len(has_source), capacity, (capacity + 1, -1)
            has_source.append(0)
            has_cluster.append(0)
            room_of.append(capacity)
        else:
            room, box = rooms.pop(best)
        has_source[box] |= sbit
        has_cluster[box] |= cbit
        insort(rooms, (room - size, box))
        room_of[box] = room - size
        if size and room - size in fresh:
            for other, heap in fresh[room - size].items():
                if not has_source[box] & other:
                    heappush(heap, box)
        out[i] = box
    return out


def cut_oversized(items: DataFrame, size: str = "n_tokens", capacity: str = "capacity") -> DataFrame:
    """Items with ``piece_no``, ``first_token`` and ``tokens``: one row each, more where the capacity is exceeded.

    Only an item larger than a whole container is divided: into full
    containers and a rest.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / F.col(capacity))).cast("int")
    cut = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), parts - 1)))
    first = (F.col("piece_no") * F.col(capacity)).cast("long")
    return cut.withColumn("first_token", first).withColumn("tokens", F.least(F.col(capacity).cast("long"), F.col(size) - first))


def pack(items: DataFrame, shard_items: int = SHARD_ITEMS, closed: float = CLOSED) -> DataFrame:
    """``(window_id, container, doc_id, piece_no, first_token, tokens)``.

    ``items`` has ``window_id``, ``capacity``, ``doc_id``, ``piece_no``,
    ``first_token``, ``tokens`` (at most the capacity), ``source`` and
    ``cluster``. An item of no tokens takes no room but gets a container all
    the same. A null source counts as a source of its own.
    """
    keep = ["window_id", "capacity", "doc_id", "piece_no", "first_token", "tokens", "source", "cluster"]
    # written once: both what fills a container by itself and the rest are read from it, so that sizes are counted once
    items = materialize(items.select(*keep), "pack-items")
    full = items.where("tokens = capacity").select("window_id", F.concat_ws("-", F.col("window_id"), F.lit("f"), F.col("doc_id"), F.col("piece_no")).alias("container"), "doc_id", "piece_no", "first_token", "tokens")
    rest = items.where("tokens < capacity")
    done, number, before = [full], 0, None
    left = rest.count()
    kinds = {f.name: f.dataType.simpleString() for f in rest.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", container string, filled double"
    while left:
        windows = max(rest.select("window_id").distinct().count(), 1)
        shards = max(1, math.ceil(left / windows / shard_items))
        shard: Column = F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(number)), F.lit(shards)).cast("int")

        def run(key: tuple, pdf: pd.DataFrame, number: int = number) -> pd.DataFrame:
            capacity = int(pdf["capacity"].iloc[0])
            pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            clusters = [None if c != c or c is None else c for c in pdf["cluster"].tolist()]
            boxes = best_fit(pdf["tokens"].tolist(), pdf["source"].tolist(), clusters, capacity)
            pdf["container"] = [f"{key[0]}-{number}-{key[1]}-{b}" for b in boxes]
            pdf["filled"] = pdf.groupby("container")["tokens"].transform("sum") / capacity
            return pdf[[*keep, "container", "filled"]]

        out = rest.withColumn("_shard", shard).groupBy("window_id", "_shard").applyInPandas(lambda key, pdf: run(key, pdf.drop(columns="_shard")), schema)
        out = materialize(out, "pack-round")
        boxes = out.groupBy("container").agg(F.max("filled").alias("filled")).agg(F.count("*"), F.count_if(F.col("filled") < closed)).collect()[0]
        # the last shard, or packing anew saved next to nothing: what there is stays
        last = shards == 1 or before is not None and boxes[0] > (1 - GAIN) * before
        final = F.lit(True) if last else F.col("filled") >= closed
        done.append(out.where(final).select("window_id", "container", "doc_id", "piece_no", "first_token", "tokens"))
        if last:
            break
        rest, before = out.where(~final).select(*keep), boxes[1]
        left = rest.count()
        number += 1
    result = done[0]
    for df in done[1:]:
        result = result.unionByName(df)
    return result
