"""DuckDB texts of the derived input views; the Spark twins are in ``fixtures``."""

VIEWS: dict[str, str] = {}

VIEWS["fx_detections"] = """
SELECT o_orderkey*2+k AS det_id, CAST(floor(o_orderkey/20.0) AS BIGINT) AS image_id,
 CAST(CASE WHEN o_orderkey%11=0 THEN (o_custkey+1)%5 ELSE o_custkey%5 END AS INT) AS cls,
 CAST((o_orderkey*37+CASE WHEN o_orderkey%13=0 THEN 250 ELSE 0 END)%500+(o_orderkey*(7+k))%23-11 AS DOUBLE) AS x1,
 CAST((o_orderkey*61)%350+(o_orderkey*(5+k))%19-9 AS DOUBLE) AS y1,
 CAST((o_orderkey*37+CASE WHEN o_orderkey%13=0 THEN 250 ELSE 0 END)%500+40+(o_orderkey*13)%100+(o_orderkey*(3+k))%17-8 AS DOUBLE) AS x2,
 CAST((o_orderkey*61)%350+40+(o_orderkey*29)%80+(o_orderkey*(11+k))%21-10 AS DOUBLE) AS y2,
 CAST(((o_orderkey*2+k)*7919)%1000003 AS DOUBLE)/1000003 AS conf
FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) v"""

VIEWS["fx_ground_truth"] = """
SELECT o_orderkey AS gt_id, CAST(floor(o_orderkey/20.0) AS BIGINT) AS image_id, CAST(o_custkey%5 AS INT) AS cls,
 CAST((o_orderkey*37)%500 AS DOUBLE) AS x1, CAST((o_orderkey*61+CASE WHEN o_orderkey%7=0 THEN 175 ELSE 0 END)%350 AS DOUBLE) AS y1,
 CAST((o_orderkey*37)%500+40+(o_orderkey*13)%100 AS DOUBLE) AS x2,
 CAST((o_orderkey*61+CASE WHEN o_orderkey%7=0 THEN 175 ELSE 0 END)%350+40+(o_orderkey*29)%80 AS DOUBLE) AS y2
FROM orders"""

VIEWS["fx_labels"] = """
SELECT gt_id, image_id, CAST(640 AS BIGINT) AS w, CAST(480 AS BIGINT) AS h, cls, ((x1+x2)/2)/640 AS xc, ((y1+y2)/2)/480 AS yc,
 (x2-x1)/640 AS bw, (y2-y1)/480 AS bh FROM fx_ground_truth"""

VIEWS["fx_images"] = """
SELECT CAST(floor(o_orderkey/20.0) AS BIGINT) AS image_id,
 CAST(320+(floor(o_orderkey/20.0)*37)%640 AS BIGINT) AS w, CAST(240+(floor(o_orderkey/20.0)*53)%480 AS BIGINT) AS h,
 count(*) AS n_objects FROM orders GROUP BY 1, 2, 3"""

VIEWS["fx_obb"] = """
SELECT det_id, image_id, cls, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h,
 CAST(det_id%628 AS DOUBLE)/100-1.5 AS theta, conf FROM fx_detections"""

VIEWS["fx_segments"] = """
SELECT gt_id, image_id, cls, x1, y1, x2, y2,
 [{'x': x1, 'y': y1}, {'x': x2, 'y': y1+gt_id%7}, {'x': x2-gt_id%5, 'y': y2}, {'x': (x1+x2)/2, 'y': y2+gt_id%11}, {'x': x1-gt_id%9, 'y': y2-3}] AS pts
FROM fx_ground_truth"""

VIEWS["fx_tracks"] = """
SELECT s.*, CAST(abs((frame*17+track_id*29)%1280-640) AS DOUBLE) AS cx,
 CAST(abs((frame*11+track_id*53)%960-480) AS DOUBLE) AS cy,
 CAST(20+track_id%30 AS DOUBLE) AS w, CAST(30+track_id%40 AS DOUBLE) AS h
FROM (SELECT CAST(user_id%4 AS BIGINT) AS source_id, user_id AS track_id, event_id, ts, event_type AS cls_name, value,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame FROM events) s"""

VIEWS["fx_run_metrics"] = """
SELECT concat('run_', CAST(user_id%24 AS VARCHAR)) AS run_id, event_id, ts, user_id AS track_id, event_type AS technique,
 concat('angle_', CAST(event_id%5 AS VARCHAR)) AS reference_angle,
 least(CAST(100 AS DOUBLE), value) AS score, CAST(45+user_id%24 AS DOUBLE) AS score_threshold,
 value >= CAST(45+user_id%24 AS DOUBLE) AS is_correct,
 CASE WHEN event_id%17=0 THEN NULL ELSE CAST(event_id%200-100 AS DOUBLE)/100 END AS cosine_similarity,
 CASE WHEN event_id%3=0 THEN 'Good form' WHEN event_id%3=1 THEN 'Slow down and focus on form' ELSE '' END AS feedback_1
FROM events"""

VIEWS["fx_poses"] = """
SELECT CAST(floor(vec_id/10.0) AS BIGINT) AS seq_id, vec_id%10 AS frame, label,
 list_transform(range(0,17), lambda j: {'x': CAST(embedding[3*j+1] AS DOUBLE), 'y': CAST(embedding[3*j+2] AS DOUBLE),
 'c': CAST(abs(embedding[3*j+3])*8 AS DOUBLE)}) AS kpts FROM embeddings"""

VIEWS["fx_candidates"] = """
SELECT concat('v', CAST(doc_id%701 AS VARCHAR)) AS video_id, doc_id AS pos, text AS title, lang AS tags,
 source AS query_hit, n_chars AS view_count, concat('PT', CAST(doc_id%3 AS VARCHAR), 'H', CAST(doc_id%60 AS VARCHAR),
 'M', CAST((doc_id*7)%60 AS VARCHAR), 'S') AS duration_iso8601
FROM documents"""

VIEWS["fx_angles"] = """
SELECT 0 AS n,'front' AS angle UNION ALL SELECT 1,'left45' UNION ALL SELECT 2,'right45' UNION ALL
 SELECT 3,'side_left' UNION ALL SELECT 4,'side_right' UNION ALL SELECT 5,'side' UNION ALL SELECT 6,'behind'"""

VIEWS["fx_plan"] = """
SELECT t.technique, a.angle, CASE WHEN (length(t.technique)+a.n)%3=0 THEN 'todo' ELSE 'ready' END AS status,
 CASE WHEN (length(t.technique)+a.n)%4=0 THEN 'no' ELSE 'yes' END AS command_ready,
 concat('u', CAST(a.n AS VARCHAR), '|u', CAST(a.n%3 AS VARCHAR)) AS source_url_1,
 concat('u', CAST(a.n*2 AS VARCHAR)) AS source_url_2, n_events
FROM (SELECT event_type AS technique, count(*) AS n_events FROM events GROUP BY event_type) t CROSS JOIN fx_angles a"""

VIEWS["fx_norm"] = """
SELECT seq_id, frame, label, kpts, list_transform(z, lambda p: CASE WHEN p IS NULL THEN NULL ELSE {'x': p.x/s, 'y': p.y/s} END) AS pts, c AS center, s AS scale
FROM (SELECT *, CASE WHEN s2<1e-6 THEN 1 ELSE s2 END AS s FROM (SELECT *, CASE WHEN s1<1e-6 THEN coalesce(list_median(list_transform(list_filter(z, lambda p: p IS NOT NULL), lambda p: sqrt(p.x*p.x+p.y*p.y))),0) ELSE s1 END AS s2
FROM (SELECT *, CASE WHEN s0<1e-6 THEN coalesce(sqrt(pow(m[12].x-m[13].x,2)+pow(m[12].y-m[13].y,2)),0) ELSE s0 END AS s1
FROM (SELECT *, coalesce(sqrt(pow(m[6].x-m[7].x,2)+pow(m[6].y-m[7].y,2)),0) AS s0, list_transform(m, lambda p: CASE WHEN p IS NULL THEN NULL ELSE {'x': p.x-c.x, 'y': p.y-c.y} END) AS z
FROM (SELECT *, CASE WHEN m[12] IS NOT NULL AND m[13] IS NOT NULL THEN {'x': (m[12].x+m[13].x)/2, 'y': (m[12].y+m[13].y)/2}
 ELSE {'x': coalesce(list_avg(list_transform(list_filter(m, lambda p: p IS NOT NULL), lambda p: p.x)),0), 'y': coalesce(list_avg(list_transform(list_filter(m, lambda p: p IS NOT NULL), lambda p: p.y)),0)} END AS c
FROM (SELECT seq_id, frame, label, kpts, list_transform(kpts, lambda p: CASE WHEN p.c<0.2 THEN NULL ELSE {'x': p.x, 'y': p.y} END) AS m FROM fx_poses))))))"""

VIEWS["fx_seq"] = """
SELECT seq_id, arg_min(label, frame) AS technique, list(pts ORDER BY frame) AS frames, list(kpts ORDER BY frame) AS raw, count(*) AS n FROM fx_norm GROUP BY seq_id"""

VIEWS["fx_filled"] = """
WITH r AS (SELECT seq_id, frame, j, pts[j].x AS x, pts[j].y AS y FROM fx_norm CROSS JOIN range(1,18) q(j)),
w AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS px, last_value(y IGNORE NULLS) OVER a AS py, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS pf,
 first_value(x IGNORE NULLS) OVER b AS nx, first_value(y IGNORE NULLS) OVER b AS ny, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS nf FROM r
 WINDOW a AS (PARTITION BY seq_id, j ORDER BY frame ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY seq_id, j ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT seq_id, frame, j, CASE WHEN x IS NOT NULL THEN x WHEN px IS NULL AND nx IS NULL THEN 0 WHEN px IS NULL THEN nx WHEN nx IS NULL THEN px ELSE px+(nx-px)*(frame-pf)/(nf-pf) END AS x,
 CASE WHEN y IS NOT NULL THEN y WHEN py IS NULL AND ny IS NULL THEN 0 WHEN py IS NULL THEN ny WHEN ny IS NULL THEN py ELSE py+(ny-py)*(frame-pf)/(nf-pf) END AS y FROM w"""
