"""Catalogue queries over names made from ``orders``, ``lineitem`` and ``cbis_samples``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import catalog as S
from rasterloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def files(spark: SparkSession, d: str) -> DataFrame:
    """Paths: a .dcm for every order, .xml, .roi and .tif for some."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    name = lambda tail: F.concat(F.lit("/in/"), F.col("k").cast("string"), F.lit(tail))
    kinds = F.array(
        F.when(F.col("k") % 10 == 9, F.concat(F.lit("/in/x"), F.col("k").cast("string"), F.lit(".dcm"))).otherwise(name("_a.DCM")),
        F.when(F.col("k") % 2 == 0, name(".xml")), F.when(F.col("k") % 4 == 0, name("_b.xml")), F.when(F.col("k") % 3 == 0, name(".roi")), F.when(F.col("k") % 5 == 0, name("_mask.tif")),
    )
    return o.select(F.explode(F.array_compact(kinds)).alias("path"))


PAIR = """p AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, '/in/' || o_orderkey || '_a.DCM' AS dicom_path,
 CASE WHEN o_orderkey % 4 = 0 THEN '/in/' || o_orderkey || '_b.xml' WHEN o_orderkey % 2 = 0 THEN '/in/' || o_orderkey || '.xml' END AS xml_path,
 CASE WHEN o_orderkey % 3 = 0 THEN '/in/' || o_orderkey || '.roi' END AS roi_path, CASE WHEN o_orderkey % 5 = 0 THEN '/in/' || o_orderkey || '_mask.tif' END AS mask_path
 FROM orders WHERE o_orderkey % 10 <> 9)"""


@query("pair_left_outer", f"WITH {PAIR} SELECT case_id, dicom_path, xml_path, roi_path, mask_path FROM p")
def pair_left_outer(spark, d):
    return S.pair_by_id(files(spark, d)).select("case_id", "dicom_path", "xml_path", "roi_path", "mask_path")


@query("pair_priority_mask", f"WITH {PAIR} SELECT mask_source, count(*) AS n_cases FROM (SELECT CASE WHEN mask_path IS NOT NULL THEN 'tif' WHEN xml_path IS NOT NULL THEN 'xml' ELSE 'none' END AS mask_source FROM p) GROUP BY mask_source")
def pair_priority_mask(spark, d):
    return S.mask_source(S.pair_by_id(files(spark, d))).groupBy("mask_source").agg(F.count("*").alias("n_cases"))


@query("pairing_summary", f"WITH {PAIR} SELECT count(*) AS n_cases, count(xml_path) AS n_xml, count(roi_path) AS n_roi, count(mask_path) AS n_mask FROM p")
def pairing_summary(spark, d):
    return S.pair_by_id(files(spark, d)).agg(F.count("*").alias("n_cases"), F.count("xml_path").alias("n_xml"), F.count("roi_path").alias("n_roi"), F.count("mask_path").alias("n_mask"))


def folders(spark: SparkSession, d: str) -> DataFrame:
    """Case folders in the public layout from order lines: line 1 is the mammogram, the others its ROIs."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    base = F.concat(
        F.when(F.col("k") % 2 == 0, "Calc-").otherwise("Mass-"), F.when(F.col("k") % 3 == 0, "Test").otherwise("Training"),
        F.lit("_P_"), F.lpad(F.col("k").cast("string"), 7, "0"), F.when(F.col("k") % 5 < 2, "_LEFT").otherwise("_RIGHT"), F.when(F.col("k") % 7 < 3, "_CC").otherwise("_MLO"),
    )
    folder = F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit("_"), F.col("n").cast("string")))
    path = lambda tail: F.concat(folder, F.lit(tail))
    one = lambda series, tail: F.struct(F.lit(series).alias("series"), path(tail).alias("path"))
    rows = (
        F.when(F.col("n") == 1, F.array(one("full mammogram images", "/1-1.dcm")))
        .when(F.col("n") % 2 == 0, F.array(one("cropped images", "/c/1-1.dcm"), one("ROI mask images", "/m/1-2.dcm")))
        .otherwise(F.array(one("ROI mask images", "/m/1-1.dcm"), one("ROI mask images", "/m/1-2.dcm")))
    )
    return li.distinct().select(folder.alias("folder"), F.explode(rows).alias("x")).select("folder", "x.series", "x.path")


@query("pair_case_rois", """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
 b AS (SELECT *, (CASE WHEN k % 2 = 0 THEN 'Calc-' ELSE 'Mass-' END) || (CASE WHEN k % 3 = 0 THEN 'Test' ELSE 'Training' END) || '_P_' || lpad(CAST(k AS VARCHAR), 7, '0') || (CASE WHEN k % 5 < 2 THEN '_LEFT' ELSE '_RIGHT' END) || (CASE WHEN k % 7 < 3 THEN '_CC' ELSE '_MLO' END) AS case_id FROM l),
 r AS (SELECT case_id, count(*) FILTER (WHERE n > 1) AS n_rois, min(CASE WHEN n > 1 THEN case_id || '_' || n || (CASE WHEN n % 2 = 0 THEN '/c/1-1.dcm' ELSE '/m/1-1.dcm' END) END) AS first_roi FROM b GROUP BY case_id HAVING bool_or(n = 1))
 SELECT case_id, case_id || '/1-1.dcm' AS dicom_path, CAST(n_rois AS INTEGER) AS n_rois, first_roi, CASE WHEN n_rois > 0 THEN left(first_roi, length(first_roi) - 10) || '/m/1-2.dcm' END AS first_mask FROM r""")
def pair_case_rois(spark, d):
    p = S.pair_case_folders(folders(spark, d))
    first = F.get("roi_entries", F.lit(0))
    return p.select("case_id", "dicom_path", F.size("roi_entries").alias("n_rois"), first["roi_path"].alias("first_roi"), first["mask_path"].alias("first_mask"))


@query("metadata_default_join", f"""WITH {PAIR}, m AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_mktsegment AS laterality, CAST(c_nationkey AS VARCHAR) AS "view", CASE WHEN c_nationkey % 4 = 0 THEN -1 ELSE c_nationkey END AS birads FROM customer)
 SELECT p.case_id, coalesce(laterality, '') AS laterality, coalesce("view", '') AS "view", CAST(coalesce(birads, -1) AS INTEGER) AS birads FROM p LEFT JOIN m ON m.case_id = p.case_id""")
def metadata_default_join(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("case_id"), F.col("c_mktsegment").alias("laterality"), F.col("c_nationkey").cast("string").alias("view"),
        F.coalesce(F.when(F.col("c_nationkey") % 4 == 0, "4a").otherwise(F.col("c_nationkey").cast("string")).try_cast("int"), F.lit(-1)).alias("birads"),
    )
    return S.with_case_metadata(S.pair_by_id(files(spark, d)).select("case_id"), c).select("case_id", "laterality", "view", "birads")


@query("exists_semi", "SELECT o_orderkey AS image_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def exists_semi(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")).join(li, "image_id", "left_semi")


@query("missing_anti", "SELECT o_orderkey AS image_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def missing_anti(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")).join(li, "image_id", "left_anti")


@query("subset_sample", f"WITH {PAIR} SELECT case_id FROM p ORDER BY md5('42:' || case_id), case_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM p)")
def subset_sample(spark, d):
    return S.sample_cases(S.pair_by_id(files(spark, d)), 0.1, 42)


@query("point_strings", r"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '(' || p_size || '.5, ' || p_partkey || ')' WHEN 1 THEN '( ' || p_size || ' ,' || p_partkey || '.25, 7)' WHEN 2 THEN '(-' || p_size || ', 1)' WHEN 3 THEN NULL ELSE 'none' END AS s FROM part)
 SELECT id, CAST(regexp_extract(s, '\(\s*([\d.]+)\s*,\s*([\d.]+)', 1) AS DOUBLE) AS x, CAST(regexp_extract(s, '\(\s*([\d.]+)\s*,\s*([\d.]+)', 2) AS DOUBLE) AS y FROM t WHERE regexp_matches(s, '\(\s*([\d.]+)\s*,\s*([\d.]+)')""")
def point_strings(spark, d):
    """Point texts "(x, y)" as numbers; others, negatives among them, are dropped."""
    from rasterloom.sources.plist import parse_point

    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    t = (
        F.when(k % 5 == 0, F.concat(F.lit("("), s, F.lit(".5, "), k.cast("string"), F.lit(")")))
        .when(k % 5 == 1, F.concat(F.lit("( "), s, F.lit(" ,"), k.cast("string"), F.lit(".25, 7)")))
        .when(k % 5 == 2, F.concat(F.lit("(-"), s, F.lit(", 1)")))
        .when(k % 5 == 4, F.lit("none"))
    )
    return table(spark, d, "part").select(k.alias("id"), parse_point(t).alias("p")).where("p is not null").select("id", "p.x", "p.y")
