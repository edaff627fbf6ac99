"""P9: filling containers of fixed capacity.

Method: items are dealt into windows of about WINDOW containers with the same sum and mix of sizes; within a window
Karmarkar-Karp multiway differencing merges partial partitions with opposing imbalances into k near-equal ones, from
k = ceil(sum / capacity). Windows aim at SLACK less than their containers hold, and the smallest items, SLACK of all
tokens, go best fit into what the near-equal containers leave. Where a container exceeds the capacity nevertheless,
single items change places; what fits nowhere is differenced again with the last window, whose k rises until every item
has room (at sf0.01 raising k in every window instead fills 0.9889 of the smallest containers in place of 0.9973).

Only an item above the capacity is split: into full containers of its own, and the rest as an item. Items are
grouped by a hash into shards of about SHARD items, so no task holds more than a few thousand however skewed the
input; each shard leaves at most one window's worth of imbalance.

Defined cases. Null texts and empty ones have size 0 and are placed like any item. A capacity below 1 or null takes
nothing and gives no rows. Repeated ids are separate items of the same id. Extra columns are ignored; no documents or
no specs give no rows.
"""

from __future__ import annotations

import bisect
import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.session import written

WINDOW, SHARD, SLACK = 64, 16384, 0.04
#: Capacities that one expression holds; more are taken in turns.
SPECS = 500


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of item numbers with near-equal sums. A partial partition is its non-empty sums in falling order."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the smallest sums of one meet the largest of the other
            short, long = (a, b) if len(a) <= len(b) else (b, a)
            head, tail = long[: len(long) - over], long[len(long) - over :]
            # the smallest `over` sums of long take the smallest of short that have no empty place left
            pairs = zip(tail, reversed(short[len(short) - over :])) if len(short) >= over else zip(tail, reversed(short))
            merged = head + short[: len(short) - over] + [(x[0] + y[0], x[1] + y[1]) for x, y in pairs]
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) >= k else 0
        tick += 1
        heapq.heappush(heap, (least - merged[0][0], tick, merged))
    return [items for _, items in heap[0][2]] if heap else []


def exchange(groups: list[list[int]], loads: list[int], sizes: list[int], capacity: int) -> None:
    """Exchange single items of groups above the capacity for smaller ones of groups with room, the smallest enough difference first."""
    for g in sorted(range(len(groups)), key=lambda g: -loads[g]):
        for _ in range(8):
            excess = loads[g] - capacity
            if excess <= 0:
                break
            best = None
            for h, load in enumerate(loads):
                room = capacity - load
                if room <= 0:
                    continue
                for i in groups[g]:
                    for j in groups[h]:
                        d = sizes[i] - sizes[j]
                        if 0 < d <= room:
                            rank = (0, d) if d >= excess else (1, -d)
                            if best is None or rank < best[0]:
                                best = (rank, h, i, j, d)
            if best is None:
                break
            _, h, i, j, d = best
            groups[g].remove(i)
            groups[h].remove(j)
            groups[g].append(j)
            groups[h].append(i)
            loads[g] -= d
            loads[h] += d


def repair(groups: list[list[int]], sizes: list[int], capacity: int) -> list[int]:
    """Move single items out of groups above the capacity into the fullest groups that can take them; the items that fit nowhere."""
    loads = [sum(sizes[i] for i in g) for g in groups]
    exchange(groups, loads, sizes, capacity)
    out = []
    for g, load in enumerate(loads):
        while load > capacity:  # the smallest item that ends the excess, else the largest
            enough = [i for i in groups[g] if load - sizes[i] <= capacity]
            i = min(enough, key=lambda i: sizes[i]) if enough else max(groups[g], key=lambda i: sizes[i])
            groups[g].remove(i)
            load -= sizes[i]
            out.append(i)
        loads[g] = load
    free = sorted((capacity - load, g) for g, load in enumerate(loads))
    left = []
    for i in sorted(out, key=lambda i: -sizes[i]):
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at == len(free):
            left.append(i)
            continue
        space, g = free.pop(at)
        groups[g].append(i)
        bisect.insort(free, (space - sizes[i], g))
    return left


def fill(sizes: list[int], capacity: int, window: int = WINDOW, slack: float = SLACK) -> list[list[int]]:
    """Containers as lists of item numbers; every size is at most capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    total, held = sum(sizes), 0
    sand: list[int] = []
    while order and held + sizes[order[-1]] <= slack * total:
        held += sizes[order[-1]]
        sand.append(order.pop())
    target = max(1, int(window * capacity * (1 - slack)))
    n_full, rest = divmod(total - held, target)
    # all windows but the last get as much as is aimed at; the next item goes where most is missing
    room = [(-target, w) for w in range(n_full)] + ([(-rest, n_full)] if rest or not n_full else [])
    heapq.heapify(room)
    dealt: list[list[int]] = [[] for _ in room]
    for i in order:
        missing, w = room[0]
        dealt[w].append(i)
        heapq.heapreplace(room, (missing + sizes[i], w))
    out: list[list[int]] = []
    over: list[int] = []
    for w, items in enumerate(dealt):
        last = w + 1 == len(dealt)
        items = items + over if last else items
        own = [sizes[i] for i in items]
        k = max(1, -(-sum(own) // capacity))
        while items:
            groups = differencing(own, k)
            left = repair(groups, own, capacity)
            if not left or not last:
                break
            k += 1
        if items:
            over += [items[j] for j in left]
            out += [[items[j] for j in g] for g in groups if g]
    free = sorted((capacity - sum(sizes[i] for i in g), c) for c, g in enumerate(out))
    rest_of_sand = []
    for i in reversed(sand):  # falling sizes into the smallest room that takes them
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at == len(free):
            rest_of_sand.append(i)
            continue
        space, c = free.pop(at)
        out[c].append(i)
        bisect.insort(free, (space - sizes[i], c))
    if rest_of_sand:
        own = [sizes[i] for i in rest_of_sand]
        k = max(1, -(-sum(own) // capacity))
        while repair(groups := differencing(own, k), own, capacity):
            k += 1
        out += [[rest_of_sand[j] for j in g] for g in groups if g]
    return out


def _fill_shard(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["n_tokens", "doc_id", "start_token"], kind="stable").reset_index(drop=True)
    names = [""] * len(part)
    for c, items in enumerate(fill(part["n_tokens"].tolist(), int(part["capacity"].iloc[0]))):
        for i in items:
            names[i] = f"{key[0]}-{key[1]}-{c}"
    part["container_id"] = names
    return part[["spec_id", "doc_id", "piece_no", "start_token", "n_tokens", "container_id"]]


def assigned(sizes: DataFrame, specs: DataFrame, n_items: int, shard: int = SHARD) -> DataFrame:
    """spec_id, doc_id, piece_no, start_token, n_tokens, container_id for items (doc_id, n_tokens) and each capacity."""
    known = sorted({(int(r["spec_id"]), int(r["capacity"])) for r in specs.where("spec_id IS NOT NULL AND capacity >= 1").select("spec_id", "capacity").toLocalIterator()})
    # two uses, one pass over the texts; the row number tells repeated and null ids apart and stays as written
    sizes = written(sizes.select("doc_id", "n_tokens").withColumn("row", F.monotonically_increasing_id()), "sizes")
    turns = [known[i : i + SPECS] for i in range(0, len(known), SPECS)]
    each = [sizes.select("doc_id", "n_tokens", "row", F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in turn))).alias("spec")) for turn in turns]
    none = sizes.where("false").select("doc_id", "n_tokens", "row", F.struct(F.lit(0).cast("long").alias("spec_id"), F.lit(0).cast("long").alias("capacity")).alias("spec"))
    items = reduce(DataFrame.unionByName, each or [none]).select("doc_id", "n_tokens", "row", "spec.*")
    full = F.floor(F.col("n_tokens") / F.col("capacity"))
    whole = items.where("n_tokens >= capacity").select("spec_id", "doc_id", "row", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece_no"))
    whole = whole.select("spec_id", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"), F.concat_ws("-", "spec_id", F.lit("full"), "row", "piece_no").alias("container_id"))
    rest = items.where("n_tokens = 0 OR n_tokens % capacity > 0").select(
        "spec_id", "doc_id", full.cast("int").alias("piece_no"), (full * F.col("capacity")).cast("long").alias("start_token"), (F.col("n_tokens") % F.col("capacity")).alias("n_tokens"), "capacity",
        F.pmod(F.xxhash64("row"), F.lit(max(1, round(n_items / shard)))).alias("shard"),
    )
    schema = "spec_id long, doc_id long, piece_no int, start_token long, n_tokens long, container_id string"
    return rest.groupBy("spec_id", "shard").applyInPandas(_fill_shard, schema).unionByName(whole)


def summary(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, n_containers, n_tokens, fullest, fill (share of the containers' space in use, rounded to 4 places)."""
    loads = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("load"))
    per = loads.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("load").alias("n_tokens"), F.max("load").alias("fullest"))
    return per.join(specs.select("spec_id", "capacity").distinct(), "spec_id").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4))
