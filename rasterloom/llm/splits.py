"""Splits that keep related records together (problem 1).

Records are tied by the patient number in ``patient_id`` or ``case_id`` and by
``patch_idx`` within one ``build_id``; ties pass on. The components are balanced
over equal bins by the largest differencing method and whole bins go to splits.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.identity import patient_in_case, patient_in_id
from rasterloom.llm.graph import connected_components
from rasterloom.session import cut

#: Bins that the components are balanced over; shares are met to about 1 / BINS.
BINS = 100
#: Components that one part balances.
COMPONENTS_PER_PART = 20_000
#: Parts whose bins one task of the next level merges.
FAN_IN = 64


def record_groups(records: DataFrame) -> DataFrame:
    """Component of every record.

    Returns ``patch_id``, ``patient_id``, ``group_no`` (smallest patient number
    named in the component, null if it names none) and ``group_key``, a string
    that also names the components without a patient.

    Records without any patient number are tied by (build_id, patch_idx);
    records with neither form groups of their own. Null build or position ties
    nothing. Other columns are ignored. An empty table gives an empty table.

    The graph is contracted before it is searched: a position that several
    patients share becomes edges to its smallest patient, so that nodes are
    patients, not records.
    """
    r = records.select(
        "patch_id",
        "patient_id",
        "build_id",
        "patch_idx",
        patient_in_id(F.col("patient_id")).alias("p"),
        patient_in_case(F.col("case_id")).alias("q"),
    )
    named = (
        r.select("build_id", "patch_idx", F.explode(F.array_distinct(F.array_compact(F.array("p", "q")))).alias("num"))
        .where("build_id is not null and patch_idx is not null")
        .distinct()
    )
    # least number at every position that names one; combined map-side
    lowest = cut(named.groupBy("build_id", "patch_idx").agg(F.min("num").alias("low"), F.count("*").alias("n")))
    shared = named.join(lowest.where("n > 1").select("build_id", "patch_idx", "low"), ["build_id", "patch_idx"])
    edges = shared.select(F.col("num").alias("a"), F.col("low").alias("b")).unionByName(
        r.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    )
    comp = connected_components(edges)
    # a record without a number inherits one through its position
    bare = (F.col("p").isNull() & F.col("q").isNull())
    direct = r.where(~bare).withColumn("num", F.coalesce("p", "q"))
    via = r.where(bare).join(lowest.select("build_id", "patch_idx", F.col("low").alias("num")), ["build_id", "patch_idx"], "left")
    cols = ["patch_id", "patient_id", "build_id", "patch_idx", "num"]
    all_ = direct.select(cols).unionByName(via.select(cols))
    out = all_.join(comp, all_.num == comp.node, "left").withColumn("group_no", F.coalesce("component", "num"))
    key = (
        F.when(F.col("group_no").isNotNull(), F.concat(F.lit("P"), F.col("group_no")))
        .when(F.col("build_id").isNotNull() & F.col("patch_idx").isNotNull(), F.concat_ws(":", F.lit("B"), "build_id", "patch_idx"))
        .otherwise(F.concat(F.lit("R"), F.coalesce(F.col("patch_id").cast("string"), F.lit("?"))))
    )
    return out.select("patch_id", "patient_id", "group_no", key.alias("group_key"))


def contradictions(groups: DataFrame) -> DataFrame:
    """Records whose patient_id is not exactly that of their group; groups without a patient have none."""
    want = F.concat(F.lit("P_"), F.when(F.length(F.col("group_no").cast("string")) >= 5, F.col("group_no").cast("string")).otherwise(F.lpad(F.col("group_no").cast("string"), 5, "0")))
    return groups.where(F.col("group_no").isNotNull() & ~F.col("patient_id").eqNullSafe(want)).select("patch_id", "group_no")


def largest_differencing(weights: list[tuple[float, ...]]) -> tuple[list[float], list[list[int]]]:
    """Combine k-tuples of bin sums until one is left.

    Every input is a tuple of k sums (a single component is its weight and k - 1
    zeros). The two tuples with the largest spread are merged, largest bin with
    smallest bin, again and again. Returns the final sums and, for every input,
    the bin each of its slots ended in.
    """
    k = len(weights[0])
    tick = itertools.count()
    heap = []
    for i, w in enumerate(weights):
        order = sorted(range(k), key=lambda s: -w[s])
        sums = [w[s] for s in order]
        # a slot list per bin: (input, slot) pairs as a linked pair, flattened at the end
        heap.append((-(sums[0] - sums[-1]), next(tick), sums, [(i, s) if w[s] else None for s in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sa, ta = heapq.heappop(heap)
        _, _, sb, tb = heapq.heappop(heap)
        # an empty side adds no node, so the trees hold one node per input, not k
        merged = [(sa[j] + sb[k - 1 - j], tb[k - 1 - j] if ta[j] is None else ta[j] if tb[k - 1 - j] is None else (ta[j], tb[k - 1 - j])) for j in range(k)]
        merged.sort(key=lambda x: -x[0])
        sums = [m[0] for m in merged]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), next(tick), sums, [m[1] for m in merged]))
    _, _, sums, tree = heap[0]
    place = [[0] * k for _ in weights]
    for b, root in enumerate(tree):
        stack = [root]
        while stack:
            x = stack.pop()
            if x is None:
                continue
            if isinstance(x[0], int):
                place[x[0]][x[1]] = b
            else:
                stack.extend(x)
    return sums, place


def _balance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of each part over BINS bins, by largest differencing."""
    got = [f for f in frames if len(f)]
    if not got:
        return
    zeros = (0.0,) * (BINS - 1)
    for part, f in pd.concat(got).groupby("part"):
        f = f.sort_values(["n", "group_key"], ascending=[False, True])
        _, place = largest_differencing([(float(n), *zeros) for n in f["n"]])
        yield pd.DataFrame({"part": part, "group_key": f["group_key"], "n": f["n"], "slot": [p[0] for p in place]})


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bins of up to FAN_IN parts merged into one part's bins: where every slot of every part went."""
    got = [f for f in frames if len(f)]
    if not got:
        return
    for up, f in pd.concat(got).groupby("up"):
        sums: dict[int, list[float]] = {}
        for part, slot, n in zip(f["part"], f["slot"], f["n"]):
            sums.setdefault(part, [0.0] * BINS)[slot] = float(n)
        parts = sorted(sums)
        _, place = largest_differencing([tuple(sums[p]) for p in parts])
        yield pd.DataFrame([(up, p, s, place[i][s], int(sums[p][s])) for i, p in enumerate(parts) for s in range(BINS) if sums[p][s]], columns=["up", "part", "slot", "up_slot", "n"])


def allocate_bins(sums: list[float], shares: list[tuple[str, float]]) -> list[str]:
    """Whole bins to splits: heaviest bin first, to the split that lacks most rows; then bins change splits while that brings the shares nearer."""
    total = sum(sums) or 1.0
    whole = sum(s for _, s in shares) or 1.0
    lack = {name: total * share / whole for name, share in shares}
    out = [""] * len(sums)
    for b in sorted(range(len(sums)), key=lambda b: (-sums[b], b)):
        name = max(lack, key=lambda x: lack[x])
        out[b] = name
        lack[name] -= sums[b]
    while True:
        best = (1e-9, None)
        for b, n in enumerate(sums):
            mine = out[b]
            for name in lack:
                if name != mine:  # move bin b
                    gain = lack[mine] ** 2 + lack[name] ** 2 - (lack[mine] + n) ** 2 - (lack[name] - n) ** 2
                    best = max(best, (gain, (b, name, None)), key=lambda x: x[0])
            for c in range(b + 1, len(sums)):  # or swap it with bin c
                d = n - sums[c]
                if out[c] != mine and d:
                    gain = lack[mine] ** 2 + lack[out[c]] ** 2 - (lack[mine] + d) ** 2 - (lack[out[c]] - d) ** 2
                    best = max(best, (gain, (b, out[c], c)), key=lambda x: x[0])
        if best[1] is None:
            return out
        b, name, c = best[1]
        d = sums[b] - (0 if c is None else sums[c])
        lack[out[b]] += d
        lack[name] -= d
        if c is not None:
            out[c] = out[b]
        out[b] = name


def assign_splits(groups: DataFrame, plan: list[tuple[str, float]]) -> DataFrame:
    """Give every component, and so every record, one split.

    Components are dealt by hash to parts of about COMPONENTS_PER_PART, each part
    balances its own over BINS bins, and the bins of FAN_IN parts at a time are
    merged upward by the same method until one set of bins is left; only its BINS
    sums reach the driver, which allocates whole bins. The way back down is a
    join per level. A component heavier than a bin keeps its bin to itself and
    the plan's shares are then met as well as whole components allow. An empty
    plan gives null splits.
    Returns ``patch_id``, ``group_key``, ``split_name``.
    """
    spark = groups.sparkSession
    sizes = cut(groups.groupBy("group_key").agg(F.count("*").alias("n")))
    n_parts = max(1, -(-sizes.count() // COMPONENTS_PER_PART))
    parted = sizes.withColumn("part", F.pmod(F.xxhash64("group_key"), F.lit(n_parts)).cast("int")).repartitionById(n_parts, F.col("part"))
    placed = cut(parted.mapInPandas(_balance, "part int, group_key string, n long, slot int"))
    level = placed.groupBy("part", "slot").agg(F.sum("n").alias("n"))
    ways = []
    while n_parts > 1:
        n_parts = -(-n_parts // FAN_IN)
        up = level.withColumn("up", F.floor(F.col("part") / FAN_IN).cast("int")).repartitionById(n_parts, F.col("up"))
        way = cut(up.mapInPandas(_merge, "up int, part int, slot int, up_slot int, n long"))
        ways.append(way)
        level = way.groupBy(F.col("up").alias("part"), F.col("up_slot").alias("slot")).agg(F.sum("n").alias("n"))
    sums = [0.0] * BINS
    for r in level.collect():  # one part: BINS rows
        sums[r.slot] = float(r.n)
    names = allocate_bins(sums, plan) if plan else [None] * BINS
    split = spark.createDataFrame(list(enumerate(names)), "slot int, split_name string").withColumn("part", F.lit(0))
    for way in reversed(ways):
        top = split.select(F.col("part").alias("up"), F.col("slot").alias("up_slot"), "split_name")
        split = way.join(top, ["up", "up_slot"]).select("part", "slot", "split_name")
    by_group = placed.join(split, ["part", "slot"]).select("group_key", "split_name")
    return groups.select("patch_id", "group_key").join(by_group, "group_key")


def read_plan(split_plan: DataFrame) -> list[tuple[str, float]]:
    """The plan's rows, in the order of their names; rows without a name or share are left out."""
    return [(r.split_name, float(r.share)) for r in split_plan.where("split_name is not null and share is not null").orderBy("split_name").collect()]


def split_report(assigned: DataFrame, split_plan: DataFrame) -> DataFrame:
    """Records and share per split against the plan."""
    got = assigned.groupBy("split_name").agg(F.count("*").alias("n_records"), F.countDistinct("group_key").alias("n_groups"))
    total = got.agg(F.sum("n_records").alias("total"))
    return (
        split_plan.select("split_name", F.col("share").alias("target_share"))
        .join(got, "split_name", "left")
        .fillna(0, ["n_records", "n_groups"])
        .join(F.broadcast(total), how="left")  # one row
        .select("split_name", "target_share", "n_records", "n_groups", F.round(F.col("n_records") / F.col("total"), 4).alias("actual_share"))
    )
