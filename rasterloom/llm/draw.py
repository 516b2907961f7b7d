"""Sample matching target category proportions (problem 2): the cube method.

Units are drawn with inclusion probabilities that meet every cell's target in
expectation; the flight phase then moves the probabilities to 0 or 1 along
directions that keep every cell's total. It runs in every part on its own, what
stays unresolved merges upward, and the landing phase ends the rest.

The plan of the draws is joined, never turned into expressions: units are
classed by their categories, the few classes meet the cells, and the units meet
their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.identity import film_identity, name_key, within_one_edit
from rasterloom.session import cut

EPS = 1e-9
#: Names of at least so many letters may be one edit off.
TYPO_LETTERS = 7
#: Units that one part of the first flight takes; the number of parts follows from the units, not from the cluster.
UNITS_PER_PART = 200_000
#: Parts of unresolved units that one task of the next level takes.
FAN_IN = 16
#: What a class or a cell says where it does not name a category.
ANY = "*"


def films(samples: DataFrame) -> DataFrame:
    """Distinct cases (task, patient, side, view), one representative row id each.

    Rows of which one of the four cannot be read from any column are no case.
    """
    f = samples.select("sample_id", *[c.alias(n) for n, c in film_identity().items()]).dropna()
    return f.groupBy("f_task", "f_patient", "f_side", "f_view").agg(F.min("sample_id").alias("row_id"))


def _letters(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{L}]", ""))


def _shorter(k: Column) -> Column:
    """The word and every word with one letter left out: words one edit or swap apart have one of these in common."""
    at = F.sequence(F.lit(1), F.length(k))
    less = F.transform(at, lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
    return F.array_distinct(F.concat(F.array(k), less))


def spelt_names(spellings: DataFrame, names: DataFrame) -> DataFrame:
    """k, name: the listed name that a spelling (column ``k``, letters in lower case) means, where it means one.

    A name counts as it is, in the plural, or, from TYPO_LETTERS letters on, one
    edit off; exact spellings go first, then the first name in order. The
    candidates come from words with a letter left out, by an equality join.
    """
    want = names.where("roi_name is not null").select(F.col("roi_name").alias("name"), _letters(F.col("roi_name")).alias("w")).where("w <> ''").distinct()
    plural = want.select("name", "w", F.explode(F.array("w", F.concat("w", F.lit("s")), F.concat("w", F.lit("es")))).alias("k"))
    longest = want.agg(F.max(F.length("w"))).first()[0] or 0  # one number; a word that is longer by more than a plural's ending means no name
    k = spellings.select("k").where((F.col("k") != "") & (F.length("k") <= longest + 2)).distinct()
    exact = k.join(plural, "k").select("k", F.lit(0).alias("off"), "name")
    near = (
        k.select("k", F.explode(_shorter(F.col("k"))).alias("v"))
        .join(want.where(F.length("w") >= TYPO_LETTERS).select("name", "w", F.explode(_shorter(F.col("w"))).alias("v")), "v")
        .where(within_one_edit(F.col("k"), F.col("w")))
        .select("k", F.lit(1).alias("off"), "name")
    )
    return exact.unionByName(near).groupBy("k").agg(F.min(F.struct("off", "name")).alias("m")).select("k", "m.name")


def rois(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (file_id, roi_no) with every listed name that its rows spell: row_id, names.

    ``names``: a table with roi_name. Other names, null and empty ones belong to
    no cell. Null file_id or roi_no name no ROI. The few spellings are matched
    once each, not once per row.
    """
    r = rows.where("file_id is not null and roi_no is not null").select("roi_row_id", "file_id", "roi_no", name_key(F.col("name")).alias("k"))
    named = r.join(spelt_names(r, names), "k")
    return named.groupBy("file_id", "roi_no").agg(F.min("roi_row_id").alias("row_id"), F.array_sort(F.collect_set("name")).alias("names"))


def plan_cells(targets: DataFrame) -> DataFrame:
    """The cells: draw_id, cell_id, size, share, min_rows, need, kind, dim and the key that its units' classes hold.

    ``need`` is the greater of min_rows and the rounded share of the draw's
    size. Cells that name the same set of categories (``dim``) share the draw's
    size among them. A null size counts as 0, as does a null share or minimum
    where the other is given; cells without an id or a draw are left out, and so
    are those that give neither share nor minimum, as they want nothing.
    """
    t = targets.where("cell_id is not null and draw_id is not null and (share is not null or min_rows is not null)")
    size, share = F.coalesce(F.col("draw_size").cast("bigint"), F.lit(0)), F.coalesce(F.col("share").cast("double"), F.lit(0.0))
    least = F.coalesce(F.col("min_rows").cast("bigint"), F.lit(0))
    film = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit(ANY)) for c in ("task", "side", "view")])
    dim = F.concat(*[F.col(c).isNotNull().cast("int").cast("string") for c in ("task", "side", "view")])
    roi = F.col("roi_name").isNotNull()
    return t.select(
        F.col("draw_id").cast("int").alias("draw_id"), F.col("cell_id").cast("bigint").alias("cell_id"), size.alias("size"), share.alias("share"), least.alias("min_rows"),
        F.greatest(least, F.floor(share * size + 0.5).cast("bigint")).alias("need"),
        F.when(roi, "roi").otherwise("film").alias("kind"), F.when(roi, "roi").otherwise(dim).alias("dim"), F.when(roi, F.col("roi_name")).otherwise(film).alias("key"),
    )


def classed_units(samples: DataFrame, roi_rows: DataFrame, targets: DataFrame) -> DataFrame:
    """All units with their class: kind, class, keys (every cell key that the class answers to), row_id."""
    parts = ("f_task", "f_side", "f_view")
    masked = [F.concat_ws("|", *[F.col(c) if m >> i & 1 else F.lit(ANY) for i, c in enumerate(parts)]) for m in range(8)]
    f = films(samples).select(F.lit("film").alias("kind"), F.concat_ws("|", *parts).alias("class"), F.array(*masked).alias("keys"), "row_id")
    r = rois(roi_rows, targets.select("roi_name")).select(F.lit("roi").alias("kind"), F.concat_ws("|", "names").alias("class"), F.col("names").alias("keys"), "row_id")
    return f.unionByName(r)


def class_cells(units: DataFrame, cells: DataFrame) -> DataFrame:
    """kind, class, draw_id, cells (sorted) and n (units) of every class and draw that meet; sizes go with the classes, not the units."""
    classes = units.groupBy("kind", "class").agg(F.first("keys").alias("keys"), F.count("*").alias("n"))
    met = classes.select("kind", "class", "n", F.explode("keys").alias("key")).join(cells.select("kind", "key", "draw_id", "cell_id"), ["kind", "key"])
    return met.groupBy("kind", "class", "n", "draw_id").agg(F.array_sort(F.collect_set("cell_id")).alias("cells"))


def targets_within(size: float, share: np.ndarray, least: np.ndarray, available: np.ndarray) -> np.ndarray:
    """Whole rows to draw of each cell of one dimension.

    Every cell gets its minimum as far as there are rows; what is left of the
    draw's size is spread in proportion to the shares, no cell beyond its rows.
    Where the minima alone exceed the size, they are drawn all the same.
    """
    low, high = np.minimum(least, available).astype(float), available.astype(float)
    live = high[share > 0].sum() + low[share <= 0].sum()
    goal = min(float(size), live)
    if goal <= low.sum():
        return low
    level = lambda t: np.minimum(high, np.maximum(low, t * share))
    a, b = 0.0, 1.0
    while level(b).sum() < goal - 1e-6 and b < 1e300:
        b *= 2
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if level(m).sum() < goal else (a, m)
    exact = level(b)
    whole = np.floor(exact + 1e-6)
    rest = int(round(goal - whole.sum()))
    for k in np.lexsort((np.arange(len(exact)), whole - exact)):  # largest remainders get the last rows
        if rest > 0 and whole[k] < high[k]:
            whole[k] += 1
            rest -= 1
    return whole


def fit_odds(member: np.ndarray, n: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Inclusion probabilities of signatures (rows of ``member``: signature x cell) whose totals meet the goals.

    Raking, cell after cell, with no probability above 1; where cells don't
    overlap one round is exact.
    """
    pi = np.ones(len(n))
    for _ in range(500):
        before = pi.copy()
        for c in range(member.shape[1]):
            on = member[:, c]
            full = on & (pi >= 1)
            for _ in range(50):  # what is held at 1 leaves the rest to the others
                free = on & ~full
                have, want = (n[free] * pi[free]).sum(), goal[c] - n[full].sum()
                if want < 0:
                    full[:] = False
                    pi[on] *= goal[c] / max((n[on] * pi[on]).sum(), EPS)
                    break
                if have <= 0:
                    break
                pi[free] *= want / have
                over = free & (pi > 1)
                if not over.any():
                    break
                pi[over] = 1
                full |= over
        if np.abs(pi - before).max(initial=0) < 1e-12:
            break
    return np.clip(pi, 0, 1)


_PLAN_DDL = "draw_id int, cells array<bigint>, goals array<double>, pi double, cell_id bigint, available bigint, need bigint, goal bigint"


def _plan_draw(key, cells: pd.DataFrame, sigs: pd.DataFrame) -> pd.DataFrame:
    """One draw: the goal of every cell and the probability of every signature. Its rows are bounded by the plan, not by the units."""
    cells = cells.sort_values("cell_id").reset_index(drop=True)
    sigs = sigs.assign(t=[tuple(c) for c in sigs["cells"]]).sort_values("t").reset_index(drop=True)
    at = {c: i for i, c in enumerate(cells["cell_id"])}
    member = np.zeros((len(sigs), len(cells)), bool)
    for i, cs in enumerate(sigs["t"]):
        member[i, [at[c] for c in cs if c in at]] = True
    n = sigs["n"].to_numpy(float)
    available = (member * n[:, None]).sum(axis=0)
    goal = np.zeros(len(cells))
    for _, of in cells.groupby("dim").groups.items():
        i = np.asarray(of)
        goal[i] = targets_within(cells["size"][i].max(), cells["share"].to_numpy(float)[i], cells["min_rows"].to_numpy(float)[i], available[i])
    pi = fit_odds(member, n, goal)
    none = [None] * len(cells)
    per_cell = pd.DataFrame({"draw_id": cells["draw_id"], "cells": none, "goals": none, "pi": np.nan, "cell_id": cells["cell_id"], "available": available.astype(np.int64), "need": cells["need"], "goal": goal.astype(np.int64)})
    per_sig = pd.DataFrame({"draw_id": sigs["draw_id"], "cells": sigs["cells"], "goals": [[float(goal[at[c]]) for c in cs] for cs in sigs["t"]], "pi": pi})
    return pd.concat([per_cell, per_sig]).astype({"cell_id": "Int64", "available": "Int64", "need": "Int64", "goal": "Int64"})


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight on the probabilities ``pi`` with constraint rows ``x`` (units x cells).

    Units with the same cells are first moved in pairs (the direction e_i - e_j
    keeps every total); then windows of one unit more than there are constraints
    move along a null vector. At most as many units as constraints stay open.
    """
    pi = pi.copy()
    groups: dict[bytes, list[int]] = {}
    for i in np.flatnonzero((pi > EPS) & (pi < 1 - EPS)):
        groups.setdefault(x[i].tobytes(), []).append(i)
    for idx in groups.values():
        i = idx[0]
        for j in idx[1:]:
            up, down = min(1 - pi[i], pi[j]), min(pi[i], 1 - pi[j])
            step = up if rng.random() < down / (up + down) else -down
            pi[i] += step
            pi[j] -= step
            if not EPS < pi[i] < 1 - EPS:
                i = j
    while True:
        open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
        if len(open_) < 2:
            return pi
        win = open_[: x.shape[1] + 1]
        a = x[win].T.astype(float)
        _, s, vt = np.linalg.svd(a, full_matrices=True)
        rank = int((s > 1e-9).sum())
        if rank >= len(win):
            return pi
        u = vt[-1]
        p = pi[win]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > EPS, (1 - p) / u, np.where(u < -EPS, -p / u, np.inf)))
            down = np.min(np.where(u > EPS, p / u, np.where(u < -EPS, (p - 1) / u, np.inf)))
        pi[win] = p + (up if rng.random() < down / (up + down) else -down) * u


def land(pi: np.ndarray, x: np.ndarray, goals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """End the open units: constraints are given up one by one, the cheapest first.

    One unit more or less costs a cell the less the greater its goal is, so the
    cell with the greatest goal goes first; the draw's total (the last column)
    goes last.
    """
    keep = list(np.argsort(goals, kind="stable")) + [x.shape[1] - 1]  # the last of the cells is the cheapest
    pi = flight(pi, x[:, keep], rng)
    while ((pi > EPS) & (pi < 1 - EPS)).any():
        if len(keep) > 1:
            keep.pop(-2)
            pi = flight(pi, x[:, keep], rng)
        else:
            pi = np.where((pi > EPS) & (pi < 1 - EPS), rng.random(len(pi)) < pi, pi).astype(float)
    return pi


def _fly(last: bool, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        for draw, f in pd.concat(got).groupby("draw_id"):
            f = f.sort_values(["rank_key", "row_id"])
            goal_of = {c: g for cs, gs in zip(f["cells"], f["goals"]) for c, g in zip(cs, gs)}
            ids = sorted(goal_of)
            at = {c: i for i, c in enumerate(ids)}
            x = np.zeros((len(f), len(ids) + 1), np.uint8)
            x[:, -1] = 1  # the draw's total
            for i, cs in enumerate(f["cells"]):
                x[i, [at[c] for c in cs]] = 1
            rng = np.random.default_rng([seed, int(draw), len(f)])
            pi = f["pi"].to_numpy(float)
            pi = land(pi, x, np.array([goal_of[c] for c in ids]), rng) if last else flight(pi, x, rng)
            pi = np.where(pi >= 1 - EPS, 1.0, np.where(pi <= EPS, 0.0, pi))
            keep = pi > 0
            yield f.assign(pi=pi)[keep]

    return run


def cube_draw(samples: DataFrame, roi_rows: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Draw the units and report every cell.

    Returns the sample (draw_id, row_id, cells; row_id is the least sample_id or
    roi_row_id of the drawn unit) and the report (draw_id, cell_id, available,
    need, goal, drawn, residual, met, enough): ``need`` is the greater of
    min_rows and the rounded share, ``goal`` what the draw's size leaves for the
    cell, ``residual`` is drawn - need, ``met`` says if as many as needed were
    drawn, ``enough`` if as many exist at all. Empty tables draw nothing and
    report every cell with a need as not met. A rerun draws the same.
    """
    cells = cut(plan_cells(targets))
    units = cut(classed_units(samples, roi_rows, targets).select("kind", "class", "keys", "row_id"))
    classes = cut(class_cells(units, cells))
    sigs = classes.groupBy("draw_id", "cells").agg(F.sum("n").alias("n"))
    plan = cut(cells.groupBy("draw_id").cogroup(sigs.groupBy("draw_id")).applyInPandas(_plan_draw, _PLAN_DDL))
    odds = plan.where("cells is not null and pi > 0").select("draw_id", "cells", "goals", "pi")
    per_class = classes.select("kind", "class", "draw_id", "cells").join(odds, ["draw_id", "cells"])
    ranked = units.select("kind", "class", "row_id").join(per_class, ["kind", "class"]).withColumn("rank_key", F.xxhash64(F.lit(seed), "draw_id", "row_id"))
    # the parts follow from the units, so a rerun on another cluster draws the same
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // UNITS_PER_PART))
    # first flight: units of one signature have one probability, and moving them in pairs leaves the whole
    # part of their sum at 1, one unit with the fraction and the others at 0; a hot signature is dealt over all parts
    same = Window.partitionBy("draw_id", "cells", "part")
    ranked = ranked.withColumn("part", F.pmod("rank_key", F.lit(parts)).cast("int"))
    sums = ranked.withColumn("rn", F.row_number().over(same.orderBy("rank_key", "row_id"))).withColumn("s", F.count("*").over(same) * F.col("pi"))
    whole = F.floor(F.col("s") + EPS)
    flown = sums.withColumn("pi", F.when(F.col("rn") <= whole, 1.0).when((F.col("rn") == whole + 1) & (F.col("s") - whole > EPS), F.col("s") - whole)).where("pi is not null")
    cols = ["draw_id", "row_id", "cells", "goals", "pi", "rank_key", "part"]
    schema = "draw_id int, row_id bigint, cells array<bigint>, goals array<double>, pi double, rank_key bigint, part int"
    step = cut(flown.select(cols))
    done = step.where("pi = 1.0")
    while True:
        parts = -(-parts // FAN_IN)
        last = parts == 1
        # open units: at most one per signature and part, so each level is FAN_IN times smaller
        open_ = step.where("pi < 1.0").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).repartitionById(parts, F.col("part"))
        step = cut(open_.mapInPandas(_fly(last, seed), schema))
        done = done.unionByName(step.where("pi = 1.0"))
        if last:
            break
    sample = done.select("draw_id", "row_id", "cells")
    drawn = sample.select("draw_id", F.explode("cells").alias("cell_id")).groupBy("draw_id", "cell_id").agg(F.count("*").alias("drawn"))
    report = (
        plan.where("cell_id is not null").select("draw_id", "cell_id", "available", "need", "goal")
        .join(drawn, ["draw_id", "cell_id"], "left")
        .fillna(0, ["drawn"])
        .select(
            "draw_id", "cell_id", "available", "need", "goal", "drawn", (F.col("drawn") - F.col("need")).alias("residual"),
            (F.col("drawn") >= F.col("need")).alias("met"), (F.col("available") >= F.col("need")).alias("enough"),
        )
    )
    return sample, report


def unmet(report: DataFrame) -> DataFrame:
    """The cells that cannot be met: fewer units exist than they need."""
    return report.where("not enough").select("draw_id", "cell_id")
