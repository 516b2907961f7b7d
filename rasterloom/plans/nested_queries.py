"""Queries over nested annotation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.operators import nested
from rasterloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_children(table(spark, d, "xml_records"), table(spark, d, "cbis_samples"))


def p3_images(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_documents(table(spark, d, "xml_records")).where("kind = 'image'").select("record_id", "image_no")


def p3_rois(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_documents(table(spark, d, "xml_records")).where("kind = 'roi'").select("record_id", "image_no", "roi_no", "roi_type", "roi_name")


def p3_points(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_documents(table(spark, d, "xml_records")).where("kind = 'point'").select("record_id", "image_no", "roi_no", "point_no", "x", "y")


def p3_roi_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_roi_entries(table(spark, d, "cbis_samples")).select("record_id", "roi_no", "roi_path", "mask_path")


QUERIES = {f.__name__: f for f in (p3_found, p3_images, p3_rois, p3_points, p3_roi_entries)}

# -- the same by DuckDB's JSON functions: a parser, not an index -------------------


def _either(j: str, names: tuple[str, str]) -> str:
    return f"coalesce(json_extract({j}, '$.{names[0]}'), json_extract({j}, '$.{names[1]}'))"


def _elements(j: str) -> str:
    """Elements of a list; a lone value is a list of one, null an empty list."""
    return f"CASE WHEN {j} IS NULL OR json_type({j}) = 'NULL' THEN [] WHEN json_type({j}) = 'ARRAY' THEN CAST({j} AS JSON[]) ELSE [{j}] END"


def _exploded(src: str, keep: str, j: str, number: str) -> str:
    return f"(SELECT {keep}, CAST(i - 1 AS INTEGER) AS {number}, l[i] AS e FROM (SELECT {keep}, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {keep}, {_elements(j)} AS l FROM {src})))"


_NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _value(j: str) -> str:
    return f"CASE WHEN json_type({j}) IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST({j}->>'$' AS DOUBLE) WHEN json_type({j}) = 'VARCHAR' THEN {_text(f'({j}->>' + chr(39) + '$' + chr(39) + ')')} END"


def _text(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, {_NUM}) THEN CAST(trim({t}) AS DOUBLE) END"


_PAIR = r"'^\s*\(([^,]*),([^,)]*)(,[^)]*)?\)\s*$'"
_JSON = f"""WITH b AS (SELECT xml_id AS record_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM xml_records WHERE xml_id IS NOT NULL AND body IS NOT NULL),
 s AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END ELSE j END AS j FROM b),
 o AS (SELECT record_id, CASE WHEN json_type(j) <> 'OBJECT' THEN NULL WHEN json_exists(j, '$.Images') OR json_exists(j, '$.images') THEN j
   ELSE list_filter(list_transform(json_keys(j), lambda k: json_extract(j, '$."' || k || '"')), lambda x: json_type(x) = 'OBJECT' AND (json_exists(x, '$.Images') OR json_exists(x, '$.images')))[1] END AS j FROM s),
 im AS (SELECT * FROM {_exploded('o', 'record_id', _either('j', nested.IMAGES), 'image_no')} WHERE json_type(e) = 'OBJECT'),
 ro AS (SELECT * FROM {_exploded('im', 'record_id, image_no', _either('e', nested.ROIS), 'roi_no')} WHERE json_type(e) = 'OBJECT'),
 ty AS (SELECT record_id, image_no, roi_no, {_value(_either('e', nested.ROI_TYPE))} AS t, {_either('e', nested.ROI_NAME)} AS n FROM ro),
 rt AS (SELECT record_id, image_no, roi_no, CASE WHEN t = floor(t) AND abs(t) < 2147483648 THEN CAST(t AS INTEGER) ELSE -1 END AS roi_type, CASE WHEN json_type(n) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE n->>'$' END AS roi_name FROM ty),
 pe AS (SELECT *, e->>'$' AS txt FROM {_exploded('ro', 'record_id, image_no, roi_no', _either('e', nested.POINTS), 'point_no')}),
 xy AS (SELECT record_id, image_no, roi_no, point_no,
   CASE json_type(e) WHEN 'VARCHAR' THEN {_text(f"regexp_extract(txt, {_PAIR}, 1)")} WHEN 'OBJECT' THEN {_value("json_extract(e, '$.x')")} WHEN 'ARRAY' THEN {_value("json_extract(e, '$[0]')")} END AS x,
   CASE json_type(e) WHEN 'VARCHAR' THEN {_text(f"regexp_extract(txt, {_PAIR}, 2)")} WHEN 'OBJECT' THEN {_value("json_extract(e, '$.y')")} WHEN 'ARRAY' THEN {_value("json_extract(e, '$[1]')")} END AS y FROM pe),
 pt AS (SELECT * FROM xy WHERE x >= 0 AND y >= 0)"""
_ENTRIES = """SELECT sample_id AS record_id, CAST(i - 1 AS INTEGER) AS roi_no, roi_entries[i].roi_path AS roi_path, roi_entries[i].mask_path AS mask_path
FROM (SELECT sample_id, roi_entries, unnest(range(1, len(roi_entries) + 1)) AS i FROM cbis_samples)
WHERE length(trim(coalesce(roi_entries[i].roi_path, ''))) > 0 OR length(trim(coalesce(roi_entries[i].mask_path, ''))) > 0"""
ORACLES = {
    "p3_found": f"""{_JSON} SELECT 'image' AS kind, record_id, image_no, -1 AS roi_no, -1 AS point_no, -1 AS roi_type FROM im
 UNION ALL SELECT 'roi', record_id, image_no, roi_no, -1, roi_type FROM rt UNION ALL SELECT 'point', record_id, image_no, roi_no, point_no, -1 FROM pt
 UNION ALL SELECT 'roi_entry', record_id, -1, roi_no, -1, -1 FROM ({_ENTRIES})""",
    "p3_images": f"{_JSON} SELECT record_id, image_no FROM im",
    "p3_rois": f"{_JSON} SELECT record_id, image_no, roi_no, roi_type, roi_name FROM rt",
    "p3_points": f"{_JSON} SELECT record_id, image_no, roi_no, point_no, x, y FROM pt",
    "p3_roi_entries": _ENTRIES,
}
