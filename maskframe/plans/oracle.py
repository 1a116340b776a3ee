"""The queries' oracles in DuckDB SQL. Masks are pixel sets there, so both sides share no algorithm."""

from __future__ import annotations

from .queries import ANNOTATORS, COUNTS, FRAME_DAYS, GRID, MERGES, ORIGIN, PREDICTION, TILINGS, WEIGHTS

FRAMES = r"""
frames AS (
  SELECT o_orderkey, o_custkey, 'A' || (o_custkey % 5) || '-' ||
         CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y%m%d%H%M%S') || (['B', 'M', 'L'])[o_orderkey % 3 + 1] || 'h' ELSE 'plain-' || o_orderkey END ||
         (['.jpg', '.PNG', '.tiff', '.txt'])[o_orderkey % 4 + 1] AS base
  FROM orders),
stems AS (
  SELECT *, 'img/' || base AS path,
         coalesce(nullif(regexp_extract(base, '(\d{14}[A-Za-z]h)', 1), ''), regexp_extract(regexp_replace(base, '^(.+)\.[^.]*$', '\1'), '([^-]*)$', 1)) AS stem
  FROM frames)"""
#: Elliptic kernels of sides 3, 5 and 7, row by row.
KERNELS = {
    1: (".#.", "###", ".#."),
    2: ("..#..", "#####", "#####", "#####", "..#.."),
    3: ("...#...", ".#####.", "#######", "#######", "#######", ".#####.", "...#..."),
}
PIXELS = "px AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
INTERVALS = f"""
iv AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_quantity, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS n,
         l_returnflag AS flag, l_suppkey % 3 AS rater, date_diff('day', DATE '{ORIGIN}', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '{ORIGIN}', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e
  FROM lineitem)"""
TRACE = "tr AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
NUMBERED = "nb AS (SELECT o_orderkey, o_custkey, o_custkey || '_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS filament_id FROM orders)"


def _islands(source: str, out: str, keys: str) -> str:
    """Disjoint spans of the union by key."""
    return f"""
{out}_a AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM {source} WHERE s < e),
{out}_b AS (SELECT *, sum(CASE WHEN ahead >= s THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {out}_a),
{out} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {out}_b GROUP BY {keys}, island)"""


def _runs(source: str, keys: str, at: str) -> str:
    return f"""
SELECT {keys}, min({at}) AS s, max({at}) + 1 AS e
FROM (SELECT {keys}, {at}, {at} - row_number() OVER (PARTITION BY {keys} ORDER BY {at}) AS island FROM {source}) GROUP BY {keys}, island"""


def _instances(configs) -> str:
    """CTEs ending in inst(config, vec_id, label, pos): recursion over neighbours, the smallest offset names a component."""
    rows = ", ".join(f"({k}, {c.threshold}::DOUBLE, {c.min_area}, {c.merge_dist}, {c.max_instances}, {c.use_disk})" for k, c in enumerate(configs))
    return f"""
{PIXELS},
cfg(config, threshold, min_area, merge, most, disk) AS (VALUES {rows}),
kernel(reach, dx, dy) AS (VALUES {_values((reach, x - reach, y - reach) for reach, rows in KERNELS.items() for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#")}),
fg AS (
  SELECT config, vec_id, pos, pos // 8 AS x, pos % 8 AS y, merge FROM px JOIN cfg ON v >= threshold AND (NOT disk OR (pos // 8 - 3.5) ** 2 + (pos % 8 - 3.5) ** 2 <= 13)),
grown AS (
  SELECT config, vec_id, pos, x, y FROM fg WHERE merge = 0
  UNION SELECT config, vec_id, (x + dx) * 8 + y + dy, x + dx, y + dy FROM fg JOIN kernel ON merge = reach
  WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7),
reach AS (
  SELECT config, vec_id, pos, x, y, pos AS seed FROM grown
  UNION
  SELECT g.config, g.vec_id, g.pos, g.x, g.y, r.seed FROM reach r JOIN grown g ON g.config = r.config AND g.vec_id = r.vec_id AND abs(g.x - r.x) <= 1 AND abs(g.y - r.y) <= 1),
root AS (SELECT config, vec_id, pos, min(seed) AS seed FROM reach GROUP BY ALL),
lab AS (SELECT f.config, f.vec_id, f.pos, r.seed FROM fg f JOIN root r USING (config, vec_id, pos)),
size AS (SELECT config, vec_id, seed, count(*) AS area, min(pos) AS first FROM lab GROUP BY ALL),
kept AS (
  SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY config, vec_id ORDER BY area DESC, first) AS r, most FROM size s JOIN cfg USING (config) WHERE area >= min_area) WHERE r <= most),
named AS (SELECT *, row_number() OVER (PARTITION BY config, vec_id ORDER BY first) AS label FROM kept),
inst AS (SELECT l.config, l.vec_id, n.label, n.area, l.pos FROM lab l JOIN named n USING (config, vec_id, seed))"""


def _panoptic(configs) -> str:
    n = len(configs)
    return f"""
{_instances([*configs, *ANNOTATORS])},
pred AS (SELECT vec_id, rater, config, label AS pred, area AS pa, pos FROM inst, range({len(ANNOTATORS)}) AS t(rater) WHERE config < {n}),
truth AS (SELECT vec_id, i.config - {n} AS rater, t.config, label AS truth, area AS ta, pos FROM inst i, range({n}) AS t(config) WHERE i.config >= {n}),
pairs AS (
  SELECT vec_id, rater, config, pred, truth, count(*)::DOUBLE / (any_value(pa) + any_value(ta) - count(*)) AS iou
  FROM pred JOIN truth USING (vec_id, rater, config, pos) GROUP BY ALL),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, rater, config, pred ORDER BY iou DESC, truth) AS rank FROM pairs WHERE iou > 0.5) WHERE rank = 1),
sums AS (
  SELECT config, coalesce(tp, 0) AS tp, coalesce(p, 0) - coalesce(tp, 0) AS fp, coalesce(t, 0) - coalesce(tp, 0) AS fn, coalesce(s, 0) AS s
  FROM (SELECT config, count(*) AS p FROM (SELECT DISTINCT vec_id, rater, config, pred FROM pred) GROUP BY 1)
  FULL JOIN (SELECT config, count(*) AS t FROM (SELECT DISTINCT vec_id, rater, config, truth FROM truth) GROUP BY 1) USING (config)
  LEFT JOIN (SELECT config, count(*) AS tp, sum(iou) AS s FROM found GROUP BY 1) USING (config)),
pooled AS (
  SELECT config, tp, fp, fn, CASE WHEN tp + fp + fn = 0 THEN 0 ELSE s / (tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn) END AS pq,
         CASE WHEN tp = 0 THEN 0 ELSE s / tp END AS sq, CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp / (tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn) END AS rq
  FROM sums)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


def _mask_spans() -> str:
    """(mask, s, e) of the valid counts."""
    out = []
    for m, counts in enumerate(COUNTS):
        if sum(counts) == 64:
            out += [(m, sum(counts[:k]), sum(counts[: k + 1])) for k in range(1, len(counts), 2)]
    return _values(out)


#: Columns that the queries give as 32-bit integers and DuckDB would count in 64 bits.
NARROW = {
    "dilate_merge": "config label pos", "filaments_min_mean_max": "least most", "grid_tune": "config", "instance_filter": "label", "instances_from_prob": "label s e", "iou_matrix": "pred truth", "label_components_2d": "label pos",
    "mask_rle_runs": "s e", "pq_match": "rater pred truth", "soft_target": "pos", "threshold_mask": "pos", "top_k_instances": "label", "tta_mean": "pos",
}


def oracle_sql() -> dict[str, str]:
    narrow = lambda columns: ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns.split())
    return {k: f"SELECT * REPLACE ({narrow(NARROW[k])}) FROM ({sql})" if k in NARROW else sql for k, sql in _sql().items()}


def _sql() -> dict[str, str]:
    grid_rows = _values((k, f"{c.threshold}::DOUBLE", c.min_area, c.merge_dist) for k, c in enumerate(GRID))
    hann = "CASE WHEN {n} <= 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * ({i} + 1) / ({n} + 1)) END"
    union_a, union_r = _islands("(SELECT * FROM iv WHERE flag = 'A')", "ua", "l_orderkey"), _islands("(SELECT * FROM iv WHERE flag = 'R')", "ur", "l_orderkey")
    flip = "(VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS f(fx, fy)"
    return {
        "image_stem_parse": f"WITH {FRAMES} SELECT o_orderkey, stem, substr(stem, 1, 6) AS month, substr(stem, 1, 4) AS year FROM stems",
        "annotator_coalesce": """
SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) END, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END,
       CASE WHEN event_id % 7 <> 0 THEN nullif(event_type, '') END, 'img' || event_id) AS annotator
FROM events""",
        "prefix_annotator": f"WITH {FRAMES} SELECT o_orderkey, nullif(regexp_replace(split_part(base, stem, 1), '^[-_ ]+|[-_ ]+$', '', 'g'), '') AS annotator FROM stems",
        "submission_ids": f"WITH {NUMBERED} SELECT o_orderkey, filament_id FROM nb",
        "submission_id_parse": f"WITH {NUMBERED} SELECT o_orderkey, regexp_extract(filament_id, '^(.+)_([0-9]+)$', 1) AS stem, CAST(regexp_extract(filament_id, '^(.+)_([0-9]+)$', 2) AS BIGINT) AS n, true AS bad FROM nb",
        "working_size": "SELECT p_partkey, scale, greatest(32, CAST(round_even(p_size * scale, 0) AS INTEGER)) AS size FROM part, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) AS s(scale)",
        "polygon_normalize": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 2 END AS rings_kept, CASE WHEN vec_id % 3 = 0 THEN 8 ELSE 14 END AS numbers, CASE WHEN vec_id % 3 = 0 THEN v[1] ELSE v[13] END AS last_first
FROM v""",
        "config_list_parse": "SELECT r_regionkey, place, CASE place WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN r_regionkey + 0.5::DOUBLE ELSE 0.6::DOUBLE END AS value FROM region, (VALUES (0), (1), (2)) AS p(place)",
        "find_annotation_rank": """
WITH f AS (
  SELECT (['train_annotation_set', 'plain', 'de-ep/er'])[page_id % 3 + 1] || '/' || (['labels', 'Annotation', 'Train-Annotations', 'train'])[page_id % 4 + 1] || '_' || page_id || '.json' AS path FROM pages),
n AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS low FROM f)
SELECT path FROM n ORDER BY NOT contains(low, 'annotation'), NOT contains(low, 'train'), length(path), string_split(path, '/') LIMIT 1""",
        "list_images_filter": f"WITH {FRAMES} SELECT stem, max(path) AS path FROM stems WHERE lower(path) SIMILAR TO '.*\\.(jpg|jpeg|png|tif|tiff)' GROUP BY stem",
        "first_n_images": f"WITH {FRAMES} SELECT o_orderkey, stem FROM stems ORDER BY stem, o_orderkey LIMIT 25",
        "load_records": """
WITH im AS (
  SELECT doc_id, doc_id // 2 AS k, strftime(make_timestamp((1400000000 + doc_id // 2 * 3600) * 1000000), '%Y%m%d%H%M%S') || 'Bh' AS stem, 'A' || doc_id % 3 AS own,
         CASE WHEN doc_id % 5 <> 0 THEN 64 + doc_id % 7 ELSE 2048 END AS height
  FROM documents),
rows AS (
  SELECT im.*, l.doc_id AS ann, coalesce(CASE WHEN toxic = 1 THEN 'T' END, own) AS annotator
  FROM im LEFT JOIN (SELECT * FROM labels WHERE doc_id % 4 <> 3) l ON im.doc_id = l.doc_id WHERE k % 7 <> 0)
SELECT stem, annotator, 'img/' || stem || '.jpg' AS path, CAST(arg_min(height, doc_id) AS INTEGER) AS height, 48 AS width, CAST(count(ann) AS INTEGER) AS segmentations,
       CAST(coalesce(sum(CASE WHEN ann % 4 = 0 THEN 1 WHEN ann IS NOT NULL THEN 2 END), 0) AS INTEGER) AS rings, CAST(arg_min(ann % 9, doc_id) AS DOUBLE) AS first
FROM rows GROUP BY stem, annotator""",
        "loader_report": """
WITH m AS (SELECT printf('%09d', doc_id) AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT (SELECT count(*) FROM documents) AS images, (SELECT count(*) FROM labels) AS annotations, (SELECT count(*) FROM r) AS records, (SELECT count(DISTINCT doc_id) FROM r) AS physical_images,
       (SELECT count(DISTINCT source) FROM r) AS annotators, (SELECT count(*) FROM m) AS missing, (SELECT string_agg(stem, ',' ORDER BY stem) FROM (SELECT stem FROM m ORDER BY stem LIMIT 5)) AS missing_examples""",
        "group_by_stem": "SELECT conv_id, count(*) AS n, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id",
        "annotators_per_image": "SELECT roles, count(*) AS conversations FROM (SELECT conv_id, count(DISTINCT role) AS roles FROM conversations GROUP BY 1) GROUP BY roles",
        "top_annotators": "SELECT user_id, n FROM (SELECT user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) ORDER BY n DESC, f LIMIT 10",
        "filaments_min_mean_max": "SELECT count(*) AS records, count(*) AS frames, count(DISTINCT a) AS annotators, min(n) AS least, round_even(avg(n), 2) AS mean, max(n) AS most FROM (SELECT count(*) AS n, min(role) AS a FROM conversations GROUP BY conv_id)",
        "images_per_year": f"WITH {FRAMES} SELECT substr(stem, 1, 4) AS year, count(*) AS images FROM stems GROUP BY 1",
        "known_image_check": """
SELECT 'unknown' AS rule, CAST(o_custkey AS VARCHAR) AS image FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT 'undetected', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
        "split_holdout_months": """
WITH m AS (SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5(month) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, greatest(1, round_even(0.15::DOUBLE * sum(n) OVER (), 0)) AS target FROM m)
SELECT month, CASE WHEN before < target THEN 'val' ELSE 'train' END AS split, n AS images FROM b""",
        "zscore_normalize": f"""
WITH {TRACE}, st AS (
  SELECT *, value >= 20 OR max(CASE WHEN value >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 0 AS disk FROM tr),
z AS (SELECT *, avg(CASE WHEN disk THEN value END) OVER (PARTITION BY user_id) AS m, stddev_pop(CASE WHEN disk THEN value END) OVER (PARTITION BY user_id) AS d FROM st)
SELECT user_id, event_id, round_even(CASE WHEN disk THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, (value - m) / (d + 1e-6::DOUBLE))) ELSE 0.0::DOUBLE END, 6) AS z FROM z""",
        "disk_mask_1d": f"""
WITH {TRACE}, sm AS (SELECT user_id, i, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM tr),
lv AS (SELECT user_id, quantile_cont(v, 0.99) AS level FROM sm GROUP BY 1),
hi AS (SELECT user_id, i FROM sm JOIN lv USING (user_id) WHERE v > 0.25::DOUBLE * level OR level <= 0),
rn AS ({_runs("hi", "user_id", "i")})
SELECT user_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e - s DESC, s) AS r FROM rn) WHERE r = 1""",
        "soft_target": f"WITH {PIXELS} SELECT vec_id // 4 AS image, pos, round_even(avg(CASE WHEN v >= 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM px GROUP BY 1, 2 HAVING max(v) >= 0.05::DOUBLE",
        "soft_target_sweep": f"""
WITH {INTERVALS}, {_islands("iv", "u", "l_orderkey, rater")},
n AS (SELECT l_orderkey, count(DISTINCT rater) AS raters FROM iv GROUP BY 1),
ed AS (SELECT l_orderkey, place, sum(d) AS d FROM (SELECT l_orderkey, s AS place, 1 AS d FROM u UNION ALL SELECT l_orderkey, e, -1 FROM u) GROUP BY 1, 2),
sw AS (SELECT l_orderkey, place AS s, lead(place) OVER (PARTITION BY l_orderkey ORDER BY place) AS e, sum(d) OVER (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS depth FROM ed)
SELECT l_orderkey, s, e, round_even(depth::DOUBLE / raters, 6) AS share FROM sw JOIN n USING (l_orderkey) WHERE depth > 0 AND e IS NOT NULL""",
        "resize_area_half": f"WITH {PIXELS} SELECT vec_id, pos // 8 // 2 AS x, pos % 8 // 2 AS y, round_even(avg(v), 6) AS v FROM px GROUP BY 1, 2, 3",
        "threshold_mask": f"WITH {PIXELS} SELECT vec_id, pos FROM px WHERE v >= 0.1::DOUBLE AND (pos // 8 - 3.5) ** 2 + (pos % 8 - 3.5) ** 2 <= 13",
        "mask_rle_runs": f"WITH {PIXELS}, m AS (SELECT * FROM px WHERE v >= 0.05::DOUBLE) {_runs('m', 'vec_id', 'pos')}",
        "rle_counts_string": f"WITH {PIXELS}, m AS (SELECT * FROM px WHERE v >= 0.05::DOUBLE), r AS ({_runs('m', 'vec_id', 'pos')}) SELECT vec_id, string_agg(s || '-' || e, ',' ORDER BY s) AS runs, CAST(sum(e - s) AS BIGINT) AS area FROM r GROUP BY vec_id",
        "mask_union": f"WITH {INTERVALS}, {_islands('iv', 'u', 'l_orderkey')} SELECT l_orderkey, s, e FROM u",
        "mask_intersection": f"""
WITH {INTERVALS}, {union_a}, {union_r},
days AS (SELECT DISTINCT ua.l_orderkey, unnest(range(greatest(ua.s, ur.s), least(ua.e, ur.e))) AS d FROM ua JOIN ur ON ua.l_orderkey = ur.l_orderkey AND ua.s < ur.e AND ur.s < ua.e)
{_runs('days', 'l_orderkey', 'd')}""",
        "mask_complement": f"""
WITH {INTERVALS}, {_islands('iv', 'u', 'l_orderkey')},
g AS (SELECT l_orderkey, e AS s, coalesce(lead(s) OVER (PARTITION BY l_orderkey ORDER BY s), {FRAME_DAYS}) AS e FROM u
      UNION ALL SELECT l_orderkey, 0, min(s) FROM u GROUP BY 1
      UNION ALL SELECT l_orderkey, 0, {FRAME_DAYS} FROM iv WHERE l_orderkey NOT IN (SELECT l_orderkey FROM u) GROUP BY 1)
SELECT l_orderkey, s, e FROM g WHERE s < e""",
        "mask_area_bbox": f"WITH {PIXELS} SELECT vec_id, count(*) AS area, min(pos // 8) AS x_min, max(pos // 8) AS x_max, min(pos % 8) AS y_min, max(pos % 8) AS y_max FROM px WHERE v >= 0.1::DOUBLE GROUP BY 1",
        "instance_filter": f"WITH RECURSIVE {_instances_of(0.1, 3, 0, 64)} SELECT vec_id, label, count(*) AS area FROM inst GROUP BY 1, 2",
        "label_components_1d": f"""
WITH {TRACE}, m AS (SELECT user_id, i FROM tr WHERE value >= 50), r AS ({_runs('m', 'user_id', 'i')}),
n AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s) <= 1 THEN 0 ELSE 1 END AS new FROM r),
l AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS label FROM n)
SELECT user_id, CAST(label AS BIGINT) AS label, min(s) AS s, max(e) AS e, CAST(sum(e - s) AS BIGINT) AS area FROM l GROUP BY 1, 2""",
        "label_components_2d": f"WITH RECURSIVE {_instances_of(0.05, 0, 0, 64)} SELECT vec_id, label, pos FROM inst",
        "dilate_merge": f"WITH RECURSIVE {_instances(MERGES)} SELECT config, vec_id, label, pos FROM inst",
        "top_k_instances": f"WITH RECURSIVE {_instances_of(0.1, 1, 0, 2)} SELECT vec_id, label, count(*) AS area FROM inst GROUP BY 1, 2",
        "instances_from_prob": f"WITH RECURSIVE {_instances([PREDICTION])} {_runs('inst', 'vec_id, label', 'pos')}",
        "iou_matrix": f"""
WITH {INTERVALS}
SELECT a.l_orderkey, a.n AS pred, r.n AS truth, least(a.e, r.e) - greatest(a.s, r.s) AS inter,
       round_even((least(a.e, r.e) - greatest(a.s, r.s))::DOUBLE / (a.e - a.s + r.e - r.s - (least(a.e, r.e) - greatest(a.s, r.s))), 6) AS iou
FROM iv a JOIN iv r ON a.l_orderkey = r.l_orderkey AND a.flag = 'A' AND r.flag = 'R' AND a.s < r.e AND r.s < a.e""",
        "pq_match": f"WITH RECURSIVE {_panoptic([PREDICTION])} SELECT vec_id, rater, pred, truth, round_even(iou, 6) AS iou FROM found",
        "pq_pooled": f"WITH RECURSIVE {_panoptic([PREDICTION])} SELECT tp, fp, fn, round_even(pq, 5) AS pq, round_even(sq, 5) AS sq, round_even(rq, 5) AS rq FROM pooled",
        "grid_tune": f"WITH RECURSIVE {_panoptic(GRID)}, g(config, threshold, min_area, merge_dist) AS (VALUES {grid_rows}) SELECT config, threshold, min_area, merge_dist, round_even(pq, 5) AS pq FROM pooled JOIN g USING (config) ORDER BY round_even(pq, 5) DESC, config LIMIT 5",
        "dice_score": """
WITH l AS (SELECT CASE WHEN quality >= 0.5 THEN 1 ELSE 0 END AS p, CASE WHEN (quality + toxic) / 2.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS t FROM labels)
SELECT CASE WHEN sum(p + t) = 0 THEN 1.0 ELSE round_even(2.0::DOUBLE * sum(p * t) / sum(p + t), 6) END AS dice, count(*) AS n FROM l""",
        "bce_dice_loss": """
WITH e AS (SELECT event_type, (value - 100) / 50 AS z, CAST(event_id % 2 AS DOUBLE) AS t FROM events),
p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM e)
SELECT event_type, round_even(avg((1 - t) * z + (1 + 2 * t) * (ln(1 + exp(-abs(z))) + greatest(-z, 0))) + 1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1), 5) AS loss FROM p GROUP BY 1""",
        "tile_starts": f"""
WITH t(size, tile, stride) AS (VALUES {_values(TILINGS)})
SELECT size, tile, stride, CAST(start AS INTEGER) AS start FROM (
  SELECT DISTINCT size, tile, stride, unnest(CASE WHEN size <= tile THEN [0] ELSE list_append(range(0, size - tile + 1, stride), size - tile) END) AS start FROM t)""",
        "hann_window": f"SELECT n, i, round_even({hann.format(i='i', n='n')}, 6) AS w FROM range(1, 25) AS a(n), range(0, 24) AS b(i) WHERE i < n",
        "overlap_add": f"""
WITH {TRACE}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS size FROM tr),
st AS (SELECT DISTINCT user_id, size, unnest(CASE WHEN size <= 16 THEN [0] ELSE list_append(range(0, size - 15, 12), size - 16) END) AS start FROM c),
p AS (SELECT c.user_id, i, value + start % 7 AS p, greatest({hann.format(i='(i - start)', n='least(c.size, 16)')}, 1e-3::DOUBLE) AS w FROM c JOIN st ON c.user_id = st.user_id AND i >= start AND i < start + 16)
SELECT user_id, i, round_even(sum(p * w) / greatest(sum(w), 1e-6::DOUBLE), 5) AS p FROM p GROUP BY 1, 2""",
        "tta_mean": f"""
WITH {PIXELS}, f AS (SELECT vec_id, pos, fx, fy, (CASE WHEN fx = 1 THEN 7 - pos // 8 ELSE pos // 8 END) * 8 + CASE WHEN fy = 1 THEN 7 - pos % 8 ELSE pos % 8 END AS back, v FROM px, {flip})
SELECT vec_id, pos, round_even(avg(1 / (1 + exp(-v * (back % 3 + 1)))), 6) AS p FROM f GROUP BY 1, 2""",
        "validate_submission": f"""
WITH {NUMBERED},
sub AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'nonumber' ELSE filament_id END AS id, CASE WHEN o_orderkey % 60 = 6 THEN -1 ELSE o_orderkey % 4 END AS mask FROM nb),
ps AS (SELECT *, nullif(regexp_extract(id, '^(.+)_([0-9]+)$', 1), '') AS image FROM sub),
known AS (SELECT CAST(c_custkey AS VARCHAR) AS image FROM customer WHERE c_acctbal >= 0),
ms(mask, s, e) AS (VALUES {_mask_spans()}),
sp AS (SELECT image, s, e, max(e) OVER (PARTITION BY image ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM ps JOIN ms USING (mask) WHERE image IS NOT NULL)
SELECT 'illegal_characters' AS rule, image, id AS detail FROM ps WHERE mask = -1
UNION ALL SELECT 'duplicate_id', any_value(image), id FROM ps GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'bad_id', NULL, id FROM ps WHERE image IS NULL
UNION ALL SELECT 'unknown_image', image, id FROM ps WHERE image IS NOT NULL AND image NOT IN (SELECT image FROM known)
UNION ALL SELECT 'undecodable', image, id FROM ps WHERE mask IN (-1, 3)
UNION ALL SELECT DISTINCT 'overlap', image, NULL FROM sp WHERE ahead > s""",
        "prediction_summary": "SELECT (SELECT count(*) FROM customer) AS images, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS rows, (SELECT CAST(count(*) AS INTEGER) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS undetected",
        "best_checkpoint": "SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value > b",
        "epoch_log": "SELECT strftime(ts, '%Y-%m-%d') AS epoch, round_even(avg(value), 6) AS train_loss, count(*) AS steps FROM events GROUP BY 1",
        "crop_sampling": f"WITH {PIXELS} SELECT vec_id, CAST(i AS INTEGER) AS i, true AS inside, true AS holds, max(v) >= 0.2::DOUBLE AS can FROM px, range(4) AS t(i) GROUP BY vec_id, i",
        "synthetic_frames": """
SELECT strftime(make_timestamp((1400000000 + k * 86400 * 9) * 1000000), '%Y%m%d%H%M%S') || (['B', 'C', 'L', 'M', 'T', 'U'])[k % 6 + 1] || 'h' AS stem, 'A' || a AS annotator, CAST(96 AS INTEGER) AS h, CAST(96 AS INTEGER) AS w,
       true AS numbered, true AS filled, true AS disjoint
FROM range(12) AS f(k), range(1, 4) AS r(a) WHERE a <= 1 + k % 3""",
        "scorer_predict": f"WITH {PIXELS} SELECT vec_id, round_even(1 / (1 + exp(-sum(v * ([{', '.join(map(str, WEIGHTS))}])[pos + 1]::DOUBLE))), 6) AS p FROM px GROUP BY vec_id",
    }


def _instances_of(threshold: float, min_area: int, merge: int, most: int) -> str:
    from ..operators.panoptic import PostConfig

    return _instances([PostConfig(threshold, min_area, merge, False, most)])
