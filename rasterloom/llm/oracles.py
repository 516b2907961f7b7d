"""DuckDB SQL of the llm queries that SQL can express."""

from __future__ import annotations

_PID = r"TRY_CAST(nullif(regexp_extract({c}, '^\s*(?:[Pp][\s_\-]*)?(\d+)\s*$', 1), '') AS BIGINT)"
_CASE_PID = r"TRY_CAST(nullif(regexp_extract({c}, '(?i)(?:^|[^a-z])p[\s_\-]*(\d+)', 1), '') AS BIGINT)"

_P1 = f"""WITH RECURSIVE r AS (SELECT patch_id, patient_id, build_id, patch_idx, {_PID.format(c='patient_id')} AS p, {_CASE_PID.format(c='case_id')} AS q FROM patch_metadata),
 named AS (SELECT DISTINCT build_id, patch_idx, n FROM (SELECT build_id, patch_idx, p AS n FROM r UNION ALL SELECT build_id, patch_idx, q FROM r) WHERE n IS NOT NULL AND build_id IS NOT NULL AND patch_idx IS NOT NULL),
 low AS (SELECT build_id, patch_idx, min(n) AS low FROM named GROUP BY ALL),
 e AS (SELECT p AS a, q AS b FROM r WHERE p <> q UNION SELECT n, low FROM named JOIN low USING (build_id, patch_idx) WHERE n <> low),
 both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 walk(a, m) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT t.b, w.m FROM walk w JOIN both_ t ON t.a = w.a WHERE w.m < t.b),
 comp AS (SELECT a, min(m) AS m FROM walk GROUP BY a),
 num AS (SELECT r.patch_id, r.patient_id, r.build_id, r.patch_idx, coalesce(r.p, r.q, l.low) AS n FROM r LEFT JOIN low l ON l.build_id = r.build_id AND l.patch_idx = r.patch_idx),
 g AS (SELECT patch_id, patient_id, build_id, patch_idx, coalesce(c.m, n) AS group_no FROM num LEFT JOIN comp c ON c.a = num.n)"""

_FILM = r"""film AS (SELECT sample_id, release_no, thumb, source,
  regexp_replace(upper(coalesce(task, '')), '[^A-Z]', '', 'g') AS t0, regexp_replace(upper(coalesce(side, '')), '[^A-Z]', '', 'g') AS s0,
  regexp_replace(regexp_replace(upper(coalesce("view", '')), '[^A-Z]', '', 'g'), '^VIEW', '') AS v0,
  """ + _PID.format(c="patient_id") + " AS p0, " + _CASE_PID.format(c="case_id") + r""" AS p1,
  regexp_replace(upper(regexp_extract(coalesce(case_id, ''), '(?i)((?:calc|mass)[\s_\-]*(?:test|train(?:ing)?))', 1)), '[^A-Z]', '', 'g') AS t1,
  upper(regexp_extract(coalesce(case_id, ''), '(?i)p[\s_\-]*\d+[\s_\-]+(left|right)', 1)) AS s1,
  upper(regexp_extract(coalesce(case_id, ''), '(?i)p[\s_\-]*\d+[\s_\-]+(?:left|right)[\s_\-]+([a-z]+)', 1)) AS v1 FROM cbis_samples),
 f AS (SELECT sample_id, release_no, thumb, source, coalesce(p0, p1) AS patient,
  CASE WHEN s0 IN ('L', 'LEFT') THEN 'LEFT' WHEN s0 IN ('R', 'RIGHT') THEN 'RIGHT' ELSE nullif(s1, '') END AS side, coalesce(nullif(v0, ''), nullif(v1, '')) AS "view",
  CASE WHEN tt LIKE 'CALCTEST%' THEN 'Calc-Test' WHEN tt LIKE 'CALCTRAIN%' THEN 'Calc-Training' WHEN tt LIKE 'MASSTEST%' THEN 'Mass-Test' WHEN tt LIKE 'MASSTRAIN%' THEN 'Mass-Training' END AS task
  FROM (SELECT *, CASE WHEN regexp_matches(t0, '^(CALC|MASS)(TEST|TRAIN)') THEN t0 ELSE t1 END AS tt FROM film))"""

_P2 = f"""WITH {_FILM},
 cases AS (SELECT DISTINCT task, patient, side, "view" FROM f WHERE task IS NOT NULL AND patient IS NOT NULL AND side IS NOT NULL AND "view" IS NOT NULL),
 nm AS (SELECT DISTINCT roi_name, regexp_replace(lower(roi_name), '[^a-z]', '', 'g') AS w FROM draw_targets WHERE roi_name IS NOT NULL),
 spelt AS (SELECT DISTINCT file_id, roi_no, regexp_replace(lower(name), '[^\\p{{L}}]', '', 'g') AS k FROM inbreast_rois WHERE file_id IS NOT NULL AND roi_no IS NOT NULL),
 rois AS (SELECT DISTINCT file_id, roi_no, roi_name FROM spelt JOIN nm ON k <> '' AND (k IN (w, w || 's', w || 'es') OR (length(w) >= 7 AND damerau_levenshtein(k, w) <= 1))),
 need AS (SELECT *, greatest(min_rows, CAST(floor(share * draw_size + 0.5) AS BIGINT)) AS n FROM draw_targets),
 have AS (SELECT cell_id, count(c.task) AS n FROM need d LEFT JOIN cases c ON d.roi_name IS NULL AND (d.side IS NULL OR d.side = c.side) AND (d.task IS NULL OR d.task = c.task) AND (d."view" IS NULL OR d."view" = c."view") WHERE d.roi_name IS NULL GROUP BY cell_id
   UNION ALL SELECT cell_id, count(r.roi_no) FROM need d LEFT JOIN rois r ON r.roi_name = d.roi_name WHERE d.roi_name IS NOT NULL GROUP BY cell_id)"""

_P4 = f"""WITH {_FILM},
 named AS (SELECT release_no, task || '_P_' || CASE WHEN length(CAST(patient AS VARCHAR)) >= 5 THEN CAST(patient AS VARCHAR) ELSE lpad(CAST(patient AS VARCHAR), 5, '0') END || '_' || side || '_' || "view" AS case_name FROM f),
 s AS (SELECT case_name, min(release_no) AS first_release FROM named WHERE case_name IS NOT NULL GROUP BY case_name),
 n AS (SELECT *, row_number() OVER (ORDER BY first_release, md5(case_name), case_name) - 1 AS seq FROM s),
 h AS (SELECT *, seq // 101 AS block_no, md5('rasterloom:' || seq // 101) AS m FROM n),
 ac AS (SELECT *, CAST('0x' || m[1:8] AS BIGINT) % 100 + 1 AS a, CAST('0x' || m[9:16] AS BIGINT) % 101 AS c FROM h),
 picked AS (SELECT *, EXISTS (SELECT 1 FROM range(10) t(i) WHERE (a * i + c) % 101 = seq % 101) AS chosen FROM ac)"""

_P4_LEDGER = f"""WITH {_FILM.replace('release_no, thumb', 'release_no, received_at, thumb')},
 named AS (SELECT release_no, coalesce(strftime(received_at, '%Y-%m'), '9999') AS month, task || '_P_' || CASE WHEN length(CAST(patient AS VARCHAR)) >= 5 THEN CAST(patient AS VARCHAR) ELSE lpad(CAST(patient AS VARCHAR), 5, '0') END || '_' || side || '_' || "view" AS case_name FROM f),
 arrived AS (SELECT case_name, min(month) AS month FROM named WHERE case_name IS NOT NULL GROUP BY case_name),
 s AS (SELECT case_name, month, min(release_no) AS first_release FROM named JOIN arrived USING (case_name, month) GROUP BY case_name, month),
 steps AS (SELECT month, dense_rank() OVER (ORDER BY month) - 1 AS delivery FROM (SELECT DISTINCT month FROM s)),
 n AS (SELECT *, row_number() OVER (ORDER BY month, first_release NULLS LAST, md5(case_name), case_name) - 1 AS seq FROM s JOIN steps USING (month)),
 h AS (SELECT *, seq // 101 AS block_no, md5('rasterloom:' || seq // 101) AS m FROM n),
 ac AS (SELECT *, CAST('0x' || m[1:8] AS BIGINT) % 100 + 1 AS a, CAST('0x' || m[9:16] AS BIGINT) % 101 AS c FROM h)
 SELECT case_name, first_release, seq, block_no, CAST(delivery AS INTEGER) AS delivery FROM ac WHERE EXISTS (SELECT 1 FROM range(10) t(i) WHERE (a * i + c) % 101 = seq % 101)"""

_P7 = r"""WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items),
 g AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i + 9], ' ') AS t FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 8)) AS i FROM w WHERE len(ws) >= 10)),
 hits AS (SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM g d JOIN g e ON d.t = e.t WHERE d.kind = 0 AND e.kind = 1)"""

ORACLES: dict[str, str] = {
    "p4_ledger": _P4_LEDGER,
    "p1_found": _P1 + " SELECT patch_id, group_no FROM g WHERE group_no IS NOT NULL AND patient_id IS DISTINCT FROM 'P_' || CASE WHEN length(CAST(group_no AS VARCHAR)) >= 5 THEN CAST(group_no AS VARCHAR) ELSE lpad(CAST(group_no AS VARCHAR), 5, '0') END",
    "p1_groups": _P1 + """ SELECT CASE WHEN group_no IS NOT NULL THEN 'P' || group_no WHEN build_id IS NOT NULL AND patch_idx IS NOT NULL THEN 'B:' || build_id || ':' || patch_idx ELSE 'R' || patch_id END AS group_key, count(*) AS n_records, 1 AS n_splits FROM g GROUP BY 1""",
    "p2_found": _P2 + " SELECT draw_id, cell_id FROM need JOIN have USING (cell_id) WHERE have.n < need.n",
    "p2_available": _P2 + " SELECT draw_id, cell_id, coalesce(have.n, 0) AS available, need.n AS need, coalesce(have.n, 0) >= need.n AS enough FROM need LEFT JOIN have USING (cell_id)",
    "p2_drawn": _P2 + """, per AS (SELECT draw_id, max(draw_size) AS size, sum(least(min_rows, have.n)) AS low, sum(have.n) AS live FROM need JOIN have USING (cell_id) WHERE roi_name IS NULL GROUP BY draw_id)
 SELECT draw_id, CAST(greatest(low, least(size, live)) AS BIGINT) AS n_sampled, 0 AS n_differ, 0 AS n_off_goal FROM per""",
    "p4_sample": _P4 + " SELECT case_name, first_release, seq, block_no FROM picked WHERE chosen",
    "p4_growth": _P4 + " SELECT first_release, count(*) AS n_cases, count(*) FILTER (WHERE chosen) AS n_chosen FROM picked GROUP BY first_release",
    "p5_found": f"""WITH {_FILM}, a AS (SELECT * FROM f WHERE task LIKE '%Test'), b AS (SELECT * FROM f WHERE task LIKE '%Training')
 SELECT DISTINCT least(a.sample_id, b.sample_id) AS sample_id_a, greatest(a.sample_id, b.sample_id) AS sample_id_b FROM a JOIN b ON (a.patient = b.patient AND a.side = b.side AND a."view" = b."view")
  OR (len(a.thumb) = 64 AND len(b.thumb) = 64 AND list_sum(list_transform(list_zip(a.thumb, b.thumb), lambda x: abs(x[1] - x[2]))) <= 30 * 64)""",
    "p5_report": f"""WITH {_FILM}, a AS (SELECT * FROM f WHERE task LIKE '%Test'), b AS (SELECT * FROM f WHERE task LIKE '%Training'),
 p AS (SELECT a.sample_id AS t, b.sample_id AS r FROM a JOIN b ON (a.patient = b.patient AND a.side = b.side AND a."view" = b."view")
  OR (len(a.thumb) = 64 AND len(b.thumb) = 64 AND list_sum(list_transform(list_zip(a.thumb, b.thumb), lambda x: abs(x[1] - x[2]))) <= 30 * 64)),
 hit AS (SELECT t AS sample_id, count(*) AS n FROM p GROUP BY t UNION ALL SELECT r, count(*) FROM p GROUP BY r)
 SELECT CASE WHEN task LIKE '%Test' THEN 'Test' ELSE 'Training' END AS split_name, source, count(*) AS n_rows, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs
 FROM f LEFT JOIN hit USING (sample_id) WHERE task IS NOT NULL GROUP BY 1, 2""",
    "p7_found": _P7 + " SELECT doc_id, item_id FROM hits",
    "p7_items": _P7 + " SELECT item_id, split_name, count(doc_id) AS n_docs FROM eval_items LEFT JOIN hits USING (item_id) GROUP BY item_id, split_name",
}
