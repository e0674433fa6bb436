"""Documents put into containers of fixed capacity with little unused space (problem 8).

The configuration linear program over the histogram of lengths: a configuration is a multiset of lengths that fits into a
container, and every length must be covered as often as it occurs. Lengths are put into groups, each as long as its longest,
so that the program has a bounded number of rows; the shortest lengths, up to a share of all tokens, are kept back as filling.
Multiplicative weights hold a price per group, which falls as the group gets covered; each round prices configurations by a
bounded knapsack, solved by dynamic programming over the capacity, and adds the dearest to the fractional solution. The
prices give a lower bound, too; the rounds end when solution and bound are close. The solution is rounded systematically,
its containers get items of the groups, longest first, and what rounding leaves is placed, with the filling, best fit into
the room that is left or into further containers. All of this sees counts only, at most one per token of capacity; the
documents are then matched to the places of their length by rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.common import cut
from lodestack.llm.tokens import bpe_tokens

#: Groups of the linear program; shares of all tokens kept back as filling, of which the first that comes so near to the least
#: number of containers counts, else the best; steps of the weights, those that price new configurations, and how close solution
#: and bound must come; the salts that split the ranking of a hot length.
GROUPS, FILLINGS, NEAR, STEPS, PRICED, CLOSE, SALTS = 72, (0.35, 0.2, 0.0, 0.5), 0.001, 8000, (200, 25), 0.01, 64

#: Up to so many ranges of six numbers are broadcast (about 10 MB).
MOST_BROADCAST = 200_000


def best_configuration(sizes: np.ndarray, values: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """How often to take each size: the bounded knapsack of greatest value with room ``room``."""
    best = np.zeros(room + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for k in range(len(sizes)):
        left, lot = int(min(counts[k], room // sizes[k])), 1
        while left > 0:
            lot = min(lot, left)
            size = int(sizes[k]) * lot
            if size > room:
                break
            with_it = best[: room + 1 - size] + values[k] * lot
            take = with_it > best[size:] + 1e-12
            if take.any():
                best[size:] = np.where(take, with_it, best[size:])
                steps.append((k, lot, take))
            left -= lot
            lot *= 2
    out = np.zeros(len(sizes), dtype=np.int64)
    at = int(best.argmax())
    for k, lot, take in reversed(steps):
        size = int(sizes[k]) * lot
        if at >= size and take[at - size]:
            out[k] += lot
            at -= size
    return out


def best_fit(lengths: np.ndarray, sizes: np.ndarray, counts: np.ndarray, room: int, begun: list[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int]]]:
    """Best fit, the longest first, for all items of a length at once: containers of equal content are one group.

    ``begun`` are containers with room left. Groups lie in a table by the room they have left, so that there are about as many
    steps as lengths times gaps.
    """
    gaps: list[int] = []  # sorted, those that some group has
    groups: dict[int, list[list]] = {}
    size_of = dict(zip(lengths.tolist(), sizes.tolist(), strict=True))

    def put(gap: int, number: int, content: tuple) -> None:
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append([number, content])

    for number, configuration in begun:
        content = None
        for item in configuration.items():
            content = (item, content)
        put(room - sum(size_of[length] * n for length, n in configuration.items()), number, content)
    for k in range(len(sizes) - 1, -1, -1):
        size, length, left = int(sizes[k]), int(lengths[k]), int(counts[k])
        while left:
            at = bisect_left(gaps, size)
            if at == len(gaps):  # new containers, with as many of this length as go in
                each = min(room // size, left)
                put(room - each * size, left // each, ((length, each), None))
                left -= left // each * each
                continue
            gap = gaps[at]
            number, content = groups[gap].pop()
            each = min(gap // size, left)
            some = min(number, left // each)
            if number > some:
                groups[gap].append([number - some, content])
            elif not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            put(gap - each * size, some, ((length, each), content))
            left -= some * each
    out = []
    for own in groups.values():
        for number, content in own:
            configuration: dict[int, int] = {}
            while content is not None:
                (length, each), content = content
                configuration[length] = configuration.get(length, 0) + each
            out.append((number, configuration))
    return out


def grouped(sizes: np.ndarray, demand: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """The group of every size (ascending): runs of neighbours of about equal volume; where there are few sizes each is its own."""
    if len(sizes) <= most:
        return np.arange(len(sizes))
    volume = np.cumsum((sizes * demand)[::-1].astype(float))[::-1]  # from the longest down
    at = np.minimum((most * (1 - volume / volume[0])).astype(int), most - 1)
    return np.unique(at, return_inverse=True)[1]


def fractional(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    """``(configurations, how often to take each, a lower bound of their sum)``: the covering program by multiplicative weights.

    Every step takes the dearest configuration as often as covers one group, the sooner the more boldly. The first steps, and
    then some, look for it among all configurations, which also gives a bound; the others among those found before.
    """
    need = demand.astype(float)
    weight, cover = np.ones(len(sizes)), np.zeros(len(sizes))
    known: dict[bytes, int] = {}
    found = np.zeros((0, len(sizes)))
    amount = np.zeros(0)
    best, bound = (np.inf, amount), 0.0
    for k in range(STEPS):
        price = weight / need
        if k < PRICED[0] or k % PRICED[1] == 0:
            taken = best_configuration(sizes, price, demand, room)
            bound = max(bound, weight.sum() / float(taken @ price))
            if known.setdefault(taken.tobytes(), len(found)) == len(found):
                found, amount = np.vstack([found, taken]), np.append(amount, 0.0)
            if (least := float((cover / need).min())) > 0:
                if amount.sum() / least < best[0]:
                    best = amount.sum() / least, amount / least
                if best[0] <= (1 + CLOSE) * bound:
                    break
        at = int((found @ price).argmax())
        used = found[at] > 0
        times = float((need[used] / found[at][used]).min())
        amount[at] += times
        cover += times * found[at]
        weight *= np.exp(-max(0.02, 0.5 / (1 + k / 300)) * times * found[at] / need)
        weight = np.maximum(weight / weight.max(), 1e-300)
    amount = np.append(best[1], np.zeros(len(found) - len(best[1])))
    return list(found.astype(np.int64)), amount, bound


def rounded(amount: np.ndarray) -> np.ndarray:
    """Whole numbers whose partial sums are those of ``amount``, cut off."""
    sums = np.floor(np.cumsum(amount) + 1e-9).astype(np.int64)
    return np.diff(sums, prepend=0)


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, separator: int) -> list[tuple[int, dict[int, int]]]:
    """``(how many containers, {length: items in each})`` that together hold every item exactly once.

    Lengths lie between 0 and ``capacity``; ``separator`` tokens lie between two items of a container.
    """
    order = np.argsort(lengths)
    lengths, demand = np.asarray(lengths)[order].astype(np.int64), np.asarray(demand)[order].astype(np.int64)
    room = capacity + separator
    sizes = np.maximum(lengths + separator, 1)
    least = -(-int(sizes @ demand) // room)
    best, fewest = None, np.inf
    for share in FILLINGS:
        found = solved(lengths, sizes, demand, room, share)
        if (n := sum(times for times, _ in found)) < fewest:
            best, fewest = found, n
        if fewest <= (1 + NEAR) * least:
            break
    return best


def solved(lengths: np.ndarray, sizes: np.ndarray, demand: np.ndarray, room: int, share: float) -> list[tuple[int, dict[int, int]]]:
    """The program for all but the shortest lengths, rounded, and filled up with what is left; ``share`` of all tokens, and of the room, is for filling."""
    volume = np.cumsum(sizes * demand)
    first = int(np.searchsorted(volume, share * volume[-1]))
    left = demand.copy()
    begun: list[tuple[int, dict[int, int]]] = []
    group = grouped(sizes[first:], demand[first:])
    longest = np.array([sizes[first:][group == g].max() for g in range(group.max() + 1)])
    needed = np.bincount(group, weights=demand[first:]).astype(np.int64)
    part = room - int(share * room)
    found, amount, _ = fractional(np.minimum(longest, part), needed, part)
    places = [list(first + np.flatnonzero(group == g)) for g in range(len(longest))]  # in ``lengths``, the longest last
    by_use = sorted(range(len(found)), key=lambda k: (-amount[k], found[k].tobytes()))
    for k, times in zip(by_use, rounded(amount[by_use]).tolist(), strict=True):
        while times > 0:
            number, content = times, {}
            for g in np.flatnonzero(found[k]).tolist():
                wanted, own = int(found[k][g]), places[g]
                while own and not left[own[-1]]:
                    own.pop()
                if own and left[own[-1]] >= wanted:
                    content[own[-1]] = wanted
                    number = min(number, int(left[own[-1]]) // wanted)
                    continue
                number = 1  # a mixture
                for at in reversed(own):
                    some = min(wanted, int(left[at]))
                    if some:
                        content[at] = some
                        wanted -= some
                    if not wanted:
                        break
                if wanted:
                    content = {}
                    break
            if not content:
                break  # a group has run out: its partners are left for best fit
            for at, n in content.items():
                left[at] -= number * n
            begun.append((number, {int(lengths[at]): n for at, n in content.items()}))
            times -= number
    return best_fit(lengths, sizes, left, room, begun)


PLACE = "container_kind string, length int, first long, past long, per int, container long"


def places(histogram: list[tuple[str, int, int]], containers: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int, int]]:
    """For each kind and length the ranges of ranks ``first:past`` that go, ``per`` at a time, into containers from ``container`` on."""
    out = []
    for kind, capacity, separator in containers:
        own = [(length, n) for k, length, n in histogram if k == kind and n]
        if not own:
            continue
        lengths, demand = np.array([x for x, _ in own]), np.array([n for _, n in own])
        seen: dict[int, int] = {}
        container = 0
        for times, configuration in configurations(lengths, demand, capacity, separator):
            for length, per in configuration.items():
                first = seen.get(length, 0)
                out.append((kind, length, first, first + times * per, per, container))
                seen[length] = first + times * per
            container += times
    return out


def pack(documents: DataFrame, containers: DataFrame, tokens=bpe_tokens, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``container_kind, container_no, doc_id, piece_no, n_pieces, n_tokens``: every document in one container of each kind.

    A document longer than the capacity is cut into pieces of the capacity and a rest. Null texts and rows without id go nowhere; an empty text
    is an item of no tokens; repeated ids count once (with the longest text); tables without rows give none. Containers
    are numbered from 0 in each kind; those of capacity below 1 or null are no containers. The histogram on the driver has
    at most one row per token of capacity, however many documents there are.
    """
    kinds = [(k, int(c), int(s or 0)) for k, c, s in containers.where("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens", "separator_tokens").distinct().collect()]
    spark = documents.sparkSession
    counted = cut(documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), tokens(F.col(text)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")))
    settings = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c, _ in sorted(kinds)]) if kinds else F.array().cast("array<struct<container_kind:string,capacity:int>>")
    sized = counted.select("doc_id", "n", F.inline(settings))  # the kinds are a few settings
    pieces = F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1)).cast("int")
    cutting = sized.withColumn("n_pieces", pieces).withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    length = F.least(F.col("capacity").cast("long"), F.col("n") - (F.col("piece_no") - 1) * F.col("capacity")).cast("int")
    items = cutting.select("container_kind", "doc_id", "piece_no", "n_pieces", length.alias("length"), _salt(F.col("doc_id"), F.col("piece_no")).alias("salt"))

    cells = items.groupBy("container_kind", "length", "salt").agg(F.count("*").alias("n"))
    histogram = [tuple(row) for row in cells.groupBy("container_kind", "length").agg(F.sum("n").alias("n")).collect()]
    held = places(histogram, sorted(kinds)) if histogram else []
    ranges = spark.createDataFrame(pd.DataFrame(held, columns=[c.split()[0] for c in PLACE.split(", ")]), PLACE) if held else spark.createDataFrame([], PLACE)
    before = Window.partitionBy("container_kind", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("container_kind", "length", "salt").orderBy("doc_id", "piece_no")
    ranked = items.withColumn("r", F.row_number().over(own) - 1).join(offsets, ["container_kind", "length", "salt"]).withColumn("rank", F.col("r") + F.col("offset"))
    # the ranges come from lengths and configurations, of which there are some per token of capacity
    placed = ranked.join(F.broadcast(ranges) if len(held) <= MOST_BROADCAST else ranges, ["container_kind", "length"]).where("rank >= first and rank < past")
    number = F.col("container") + F.expr("(rank - first) div per")
    return placed.select("container_kind", number.alias("container_no"), "doc_id", "piece_no", "n_pieces", F.col("length").alias("n_tokens"))


def _salt(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_kind, n_containers, n_items, n_tokens, unused_share``: separators count as used."""
    per = packed.groupBy("container_kind", "container_no").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    joined = per.join(containers.select("container_kind", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator")).distinct(), "container_kind")
    used = F.sum(F.col("tokens") + (F.col("items") - 1) * F.col("separator"))
    return joined.groupBy("container_kind").agg(
        F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.round(1 - used / F.sum("capacity_tokens"), 6).alias("unused_share")
    )
