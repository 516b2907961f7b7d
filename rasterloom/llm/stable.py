"""Reproducible sample that stays stable as data grows (problem 4): randomised block selection.

Cases get sequence numbers once and keep them: a ledger table holds every number
ever given and is only appended to. A hash of a block's number fixes, before any
row arrives, which positions of the block are chosen, so what was chosen stays
chosen whatever arrives later, in whatever order: rows of old releases, rows
without a release, repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rasterloom.llm.identity import film_identity
from rasterloom.session import cut, shared_folder

#: Positions of a block, a prime; TAKE of them are chosen in every block.
BLOCK = 101
TAKE = 10
#: Sub-ranges of a release that are numbered on their own, as hexadecimal digits of the key's hash.
BUCKET_DIGITS = 2

LEDGER_DDL = "case_name string, first_release int, seq bigint, delivery int"


def case_names(samples: DataFrame) -> DataFrame:
    """Canonical case of every row: ``<task>_P_<number>_<side>_<view>``; rows with an unreadable part have none."""
    f = film_identity()
    number = f["f_patient"].cast("string")
    padded = F.when(F.length(number) >= 5, number).otherwise(F.lpad(number, 5, "0"))
    name = F.concat(f["f_task"], F.lit("_P_"), padded, F.lit("_"), f["f_side"], F.lit("_"), f["f_view"])
    return samples.select("sample_id", "release_no", name.alias("case_name"))


def first_seen(samples: DataFrame) -> DataFrame:
    """case_name and first_release (null if no row of the case has one) of the distinct cases."""
    return case_names(samples).where("case_name is not null").groupBy("case_name").agg(F.min("release_no").alias("first_release"))


def number_cases(cases: DataFrame, base: int = 0) -> DataFrame:
    """Numbers from ``base``: case_name, first_release, seq.

    Order within one delivery: first release, hash of the name, name; cases
    without a release come last. No task sees more than one bucket of a release:
    bucket sizes are summed first (releases x 16^BUCKET_DIGITS rows) and each
    bucket is numbered from its offset.
    """
    cases = cut(
        cases.select("case_name", "first_release", F.md5("case_name").alias("h"), F.coalesce("first_release", F.lit(2147483647)).alias("rel"))
        .withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    )
    sizes = cases.groupBy("rel", "bucket").agg(F.count("*").alias("n"))
    # releases x 16^BUCKET_DIGITS rows, whatever the number of cases
    before = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("rel", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("rel", "bucket").orderBy("h", "case_name"))
    return (
        cases.withColumn("i", inside)
        .join(before.select("rel", "bucket", "start"), ["rel", "bucket"])
        .select("case_name", "first_release", (F.lit(base) + F.col("start") + F.col("i") - 1).cast("bigint").alias("seq"))
    )


def sequence_numbers(samples: DataFrame) -> DataFrame:
    """Numbers of a table that arrives as one delivery: case_name, first_release, seq from 0."""
    return number_cases(first_seen(samples))


class Ledger:
    """The numbers given so far, a Parquet table in a folder that all executors share.

    ``extend`` numbers the cases of a delivery that have no number yet, after
    all numbers given before, and appends them; nothing is ever rewritten. An
    append is committed as a whole, so a run that fails leaves the ledger as it
    was, and a delivery that is extended twice changes nothing the second time.
    One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """case_name, first_release (as known when it was numbered), seq, delivery; empty before the first delivery."""
        try:
            return self.spark.read.schema(LEDGER_DDL).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER_DDL)

    def extend(self, samples: DataFrame) -> int:
        """Number the delivery's new cases; returns how many there were. Rows that name no case are left out."""
        held = self.read()
        last, delivery = held.agg(F.max("seq"), F.max("delivery")).first()
        base = 0 if last is None else last + 1
        new = first_seen(samples)
        if last is not None:
            new = new.join(held.select("case_name"), "case_name", "left_anti")
        numbered = cut(number_cases(new, base))
        n = numbered.count()
        if n:
            numbered.withColumn("delivery", F.lit(0 if delivery is None else delivery + 1)).write.mode("append").parquet(self.path)
        return n

    def sample(self, seed: str = "rasterloom") -> DataFrame:
        """The chosen cases: case_name, first_release, seq, block_no, delivery."""
        return _picked(self.read(), seed).select("case_name", "first_release", "seq", "block_no", "delivery")


def chosen(seq: Column, seed: str, block: int = BLOCK, take: int = TAKE) -> Column:
    """True at the positions that the hash of the block's number chooses.

    The hash gives a start c and a stride a of the block's prime field; the
    chosen positions are c, c + a, ... (take of them), so every block, filled or
    not, has exactly ``take`` positions and each position has the same chance.
    """
    no, pos = F.floor(seq / block), F.pmod(seq, F.lit(block))
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), no.cast("string")))
    num = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("bigint")
    a, c = F.pmod(num(1), F.lit(block - 1)) + 1, F.pmod(num(9), F.lit(block))
    # pos = a * i + c with i < take; the take values of i are tried, as an inverse needs a loop too
    hits = [F.pmod(a * F.lit(i) + c, F.lit(block)) == pos for i in range(take)]
    out = hits[0]
    for x in hits[1:]:
        out = out | x
    return out


def _picked(numbers: DataFrame, seed: str) -> DataFrame:
    return numbers.where(chosen(F.col("seq"), seed)).withColumn("block_no", F.floor(F.col("seq") / BLOCK).cast("bigint"))


def stable_sample(samples: DataFrame, seed: str = "rasterloom", ledger: Ledger | None = None) -> DataFrame:
    """Chosen cases: case_name, first_release, seq, block_no. Empty for an empty table.

    With a ledger its numbers hold, after the table's new cases were appended.
    Without one the table counts as a first delivery: reruns and other
    partitionings choose the same, and later releases only add cases, but rows
    of an old release that arrive between two runs need the ledger to keep the
    numbers apart.
    """
    if ledger is None:
        s = sequence_numbers(samples)
    else:
        ledger.extend(samples)
        s = ledger.read()
    return _picked(s, seed).select("case_name", "first_release", "seq", "block_no")


def replay(samples: DataFrame, order: Column) -> Ledger:
    """A new ledger in the shared folder, extended once for each value of ``order`` (few, as months; null last)."""
    spark = samples.sparkSession
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    steps = samples.select(order.alias("step")).distinct().orderBy(F.asc_nulls_last("step")).collect()
    for r in steps:
        ledger.extend(samples.where(order.eqNullSafe(F.lit(r.step))))
    return ledger
