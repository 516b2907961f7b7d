"""Queries of the llm subpackage; every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import draw, encode, leak, overlap, residue, splits, stable
from rasterloom.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.contradictions(splits.record_groups(table(spark, d, "patch_metadata")))


def _p1_assigned(spark: SparkSession, d: str) -> DataFrame:
    groups = cut(splits.record_groups(table(spark, d, "patch_metadata")))
    return splits.assign_splits(groups, splits.read_plan(table(spark, d, "split_plan")))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return _p1_assigned(spark, d)


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every group of tied records with its size and the number of splits it is in."""
    return _p1_assigned(spark, d).groupBy("group_key").agg(F.count("*").alias("n_records"), F.countDistinct("split_name").alias("n_splits"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(_p1_assigned(spark, d), table(spark, d, "split_plan"))


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return draw.cube_draw(table(spark, d, "cbis_samples"), table(spark, d, "inbreast_rois"), table(spark, d, "draw_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return draw.unmet(_p2(spark, d)[1])


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[1]


def p2_available(spark: SparkSession, d: str) -> DataFrame:
    """What every cell needs and has, of the report of the draws."""
    return _p2(spark, d)[1].select("draw_id", "cell_id", "available", "need", "enough")


def p2_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the sample per cell of the draws whose cells do not overlap: what the report's goals say, drawn exactly."""
    sample, report = _p2(spark, d)
    per = sample.select("draw_id", F.explode("cells").alias("cell_id")).groupBy("draw_id", "cell_id").agg(F.count("*").alias("n_sampled"))
    films = table(spark, d, "draw_targets").where("roi_name is null").select("draw_id", "cell_id")
    both = report.join(films, ["draw_id", "cell_id"], "left_semi").join(per, ["draw_id", "cell_id"], "left").fillna(0, ["n_sampled"])
    return both.groupBy("draw_id").agg(F.sum("n_sampled").alias("n_sampled"), F.count_if(F.col("n_sampled") != F.col("drawn")).alias("n_differ"), F.count_if(F.col("n_sampled") != F.col("goal")).alias("n_off_goal"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[0].select("draw_id", "row_id")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return stable.stable_sample(table(spark, d, "cbis_samples"))


def p4_growth(spark: SparkSession, d: str) -> DataFrame:
    """Per release: cases known by then and how many of them are chosen."""
    s = stable.sequence_numbers(table(spark, d, "cbis_samples"))
    return s.groupBy("first_release").agg(F.count("*").alias("n_cases"), F.count_if(stable.chosen(F.col("seq"), "rasterloom")).alias("n_chosen"))


def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The table as it arrived, month by month, through a stored ledger: the chosen cases with the delivery that numbered them."""
    return stable.replay(table(spark, d, "cbis_samples"), F.date_format("received_at", "yyyy-MM")).sample()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found_pairs(overlap.cross_split_pairs(overlap.films_with_split(table(spark, d, "cbis_samples"))))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(overlap.films_with_split(table(spark, d, "cbis_samples")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked(leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), near=False))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leak.leak_report(leak.leaks(table(spark, d, "documents"), items), items)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents with an exact passage."""
    items = table(spark, d, "eval_items")
    return leak.leak_report(leak.leaks(table(spark, d, "documents"), items, near=False), items).select("item_id", "split_name", "n_docs")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents by kind of evidence and host."""
    docs = table(spark, d, "documents")
    hosts = docs.select("doc_id", F.expr(residue.HOST).alias("host"))
    return residue.residue(docs).join(hosts, "doc_id").groupBy("host", "kind").agg(F.countDistinct("doc_id").alias("n_docs"))


def p8_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Lines that recur within a host, with their documents."""
    return residue.line_counts(table(spark, d, "documents")).where(F.col("n_docs") >= residue.BOILERPLATE_DOCS)


_ALL = (
    p1_found, p1_splits, p1_groups, p1_report,
    p2_found, p2_report, p2_available, p2_drawn, p2_sample,
    p4_sample, p4_growth, p4_ledger,
    p5_found, p5_report,
    p6_ids,
    p7_found, p7_report, p7_items,
    p8_found, p8_report, p8_boilerplate,
)
QUERIES = {f.__name__: f for f in _ALL}
