"""Columns that read patients, sides, views, tasks and ROI names whatever their spelling.

All of them are plain Column expressions (whole-stage codegen, no Python).
Nulls, empty and unreadable values give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of the public CBIS-DDSM / INbreast catalogues.
TASKS = ("Calc-Test", "Calc-Training", "Mass-Test", "Mass-Training")
SIDES = ("LEFT", "RIGHT")


def _or_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def patient_in_id(c: Column) -> Column:
    """``P_00207``, `` p-207``, ``P 207``, ``207`` -> 207; anything else null."""
    digits = F.regexp_extract(c, r"^\s*(?:[Pp][\s_\-]*)?(\d+)\s*$", 1)
    return _or_null(digits).try_cast("bigint")


def patient_in_case(c: Column) -> Column:
    """The number after the ``P`` of a case id, e.g. ``Mass-Test_P_00038_LEFT_CC`` -> 38."""
    digits = F.regexp_extract(c, r"(?i)(?:^|[^a-z])p[\s_\-]*(\d+)", 1)
    return _or_null(digits).try_cast("bigint")


def side_of(c: Column) -> Column:
    """``l``, ``Left``, `` RIGHT`` ... -> LEFT / RIGHT."""
    s = F.upper(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return F.when(s.isin("L", "LEFT"), F.lit("LEFT")).when(s.isin("R", "RIGHT"), F.lit("RIGHT"))


def view_of(c: Column) -> Column:
    """``view CC``, ``M-L-O``, ``mlo`` ... -> the letters alone, upper case."""
    s = F.upper(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return _or_null(F.regexp_replace(s, "^VIEW", ""))


def task_of(c: Column) -> Column:
    """``MassTest``, ``calc_training``, ``Mass-Train`` ... -> the canonical task."""
    s = F.upper(F.regexp_replace(c, r"[^A-Za-z]", ""))
    kind = F.regexp_extract(s, r"^(CALC|MASS)", 1)
    part = F.regexp_extract(s, r"^(?:CALC|MASS)(TEST|TRAIN)", 1)
    return F.when(
        (kind != "") & (part != ""),
        F.concat(F.initcap(F.lower(kind)), F.lit("-"), F.when(part == "TEST", "Test").otherwise("Training")),
    )


def side_in_case(c: Column) -> Column:
    return _or_null(F.upper(F.regexp_extract(c, r"(?i)p[\s_\-]*\d+[\s_\-]+(left|right)(?![a-z])", 1)))


def view_in_case(c: Column) -> Column:
    return _or_null(F.upper(F.regexp_extract(c, r"(?i)p[\s_\-]*\d+[\s_\-]+(?:left|right)[\s_\-]+([a-z]+)(?![a-z])", 1)))


def task_in_case(c: Column) -> Column:
    return task_of(F.regexp_extract(c, r"(?i)((?:calc|mass)[\s_\-]*(?:test|train(?:ing)?))", 1))


def film_identity() -> dict[str, Column]:
    """task, patient, side and view of a cbis_samples row; what one column lacks is read from case_id."""
    case = F.col("case_id")
    return {
        "f_task": F.coalesce(task_of(F.col("task")), task_in_case(case)),
        "f_patient": F.coalesce(patient_in_id(F.col("patient_id")), patient_in_case(case)),
        "f_side": F.coalesce(side_of(F.col("side")), side_in_case(case)),
        "f_view": F.coalesce(view_of(F.col("view")), view_in_case(case)),
    }


def name_key(c: Column) -> Column:
    """Letters of an ROI name in lower case, e.g. ``  Lymph  Node 3`` -> ``lymphnode``."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))


def within_one_edit(a: Column, b: Column) -> Column:
    """True if one insertion, deletion, substitution or swap of neighbours at most turns a into b.

    Plain edit distance counts a swap as two, so a distance of two between
    strings of one length is a swap if both hold the same letters and their
    differing span has two letters: the longest common prefix and suffix leave
    exactly two positions.
    """
    n = F.length(a)
    letters = lambda s: F.array_join(F.array_sort(F.split(s, "")), "")
    swap = (
        (n == F.length(b))
        & (F.levenshtein(a, b) == 2)
        & (letters(a) == letters(b))
        & F.exists(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda i: F.concat(
                F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)
            )
            == b,
        )
    )
    return (F.levenshtein(a, b) <= 1) | swap
