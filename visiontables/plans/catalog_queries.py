"""Catalogue and capture-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiontables.functions import text as T
from visiontables.operators import catalog as C
from visiontables.plans import fixtures as fx
from visiontables.registry import query

DUR = "((doc_id%3)*3600+(doc_id%60)*60+(doc_id*7)%60)"
NAMES_SQL = """n AS (SELECT doc_id, lang||['_behind','_rear01','_left45','_45_right','_left_side','_side_right','_front','_left','-right','_profile','_none',''][CAST(doc_id%12 AS INT)+1]||'_'||CAST(doc_id%100 AS VARCHAR)||'.mp4' AS name, lang AS technique FROM documents)"""


def names(spark, sf):
    arr = "array('_behind','_rear01','_left45','_45_right','_left_side','_side_right','_front','_left','-right','_profile','_none','')"
    return fx.table(spark, sf, "documents").selectExpr(
        "doc_id", f"concat(lang, {arr}[CAST(doc_id%12 AS INT)], '_', CAST(doc_id%100 AS STRING), '.mp4') AS name", "lang AS technique")


def norm_sql(c, camel=True, under=True):
    c = f"regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')" if camel else c
    return f"regexp_replace(trim(lower(regexp_replace({c}, '{'[-_]' if under else '-'}', ' ', 'g'))), '\\s+', '_', 'g')"


@query("fun14_normalize_key", "WITH p AS (SELECT p_partkey, p_name||'-'||p_type||'Kick_'||p_brand||'  x' AS t FROM part) SELECT p_partkey, "
       + f"{norm_sql('t')} AS full_key, {norm_sql('t', False)} AS no_camel, {norm_sql('t', False, False)} AS hyphen_only FROM p")
def fun14(spark, sf):
    t = F.expr("concat(p_name, '-', p_type, 'Kick_', p_brand, '  x')")
    return fx.table(spark, sf, "part").select("p_partkey", T.normalize_key(t).alias("full_key"), T.normalize_key(t, camel=False).alias("no_camel"),
                                              T.normalize_key(t, camel=False, underscore=False).alias("hyphen_only"))


@query("fun15_split_reference_key", """
SELECT p_partkey, replace(lower(p_name),' ','_') AS technique, CASE WHEN p_partkey%3=0 THEN NULL ELSE replace(lower(replace(p_brand,'#','_')),' ','_')||'_tail' END AS angle FROM part""")
def fun15(spark, sf):
    key = F.expr("concat(p_name, CASE WHEN p_partkey%3=0 THEN '' ELSE concat('__', replace(p_brand,'#','_'), '__tail') END)")
    tech, angle = T.split_reference_key(key)
    return fx.table(spark, sf, "part").select("p_partkey", tech.alias("technique"), angle.alias("angle"))


ANGLE_SQL = """CASE WHEN contains(name,'behind') OR contains(name,'rear') OR contains(name,'back') THEN 'behind' WHEN contains(name,'left45') OR contains(name,'45left') OR contains(name,'45_left') OR contains(name,'left_45') THEN 'left45'
 WHEN contains(name,'right45') OR contains(name,'45right') OR contains(name,'45_right') OR contains(name,'right_45') THEN 'right45' WHEN contains(name,'side_left') OR contains(name,'left_side') THEN 'side_left'
 WHEN contains(name,'side_right') OR contains(name,'right_side') THEN 'side_right' WHEN contains(name,'front') THEN 'front' WHEN regexp_matches(name,'(^|[_\\-.\\s])left($|[_\\-.\\s])') THEN 'side_left'
 WHEN regexp_matches(name,'(^|[_\\-.\\s])right($|[_\\-.\\s])') THEN 'side_right' WHEN contains(name,'side') OR contains(name,'profile') THEN 'side' END"""


@query("fun16_infer_angle", f"WITH {NAMES_SQL} SELECT doc_id, {ANGLE_SQL} AS angle, regexp_replace(regexp_replace(name,'\\.[^.]*$',''),'[^a-z0-9]+','_','g') AS fallback FROM n")
def fun16(spark, sf):
    return names(spark, sf).select("doc_id", T.infer_angle(F.col("name")).alias("angle"), T.fallback_angle(F.col("name")).alias("fallback"))


@query("fun17_iso_duration", f"SELECT pos, CAST((pos%3)*3600+(pos%60)*60+(pos*7)%60 AS BIGINT) AS seconds, CAST(CASE WHEN pos%2=0 THEN (pos*7)%60 ELSE 0 END AS BIGINT) AS odd FROM fx_candidates")
def fun17(spark, sf):
    odd = F.expr("CASE WHEN pos%2=0 THEN concat('PT', CAST((pos*7)%60 AS STRING), '.75S') ELSE concat('P1D', CAST(pos AS STRING)) END")
    return fx.candidates(spark, sf).select("pos", T.iso_duration_seconds(F.col("duration_iso8601")).alias("seconds"), T.iso_duration_seconds(odd).alias("odd"))


@query("fun18_video_id", """
SELECT page_id, CASE page_id%3 WHEN 0 THEN 'v'||CAST(page_id AS VARCHAR) WHEN 1 THEN 'w'||CAST(page_id AS VARCHAR) ELSE '' END AS video_id, regexp_extract(url,'[?&]page=([^&#]*)',1) AS page FROM pages""")
def fun18(spark, sf):
    link = F.expr("CASE page_id%3 WHEN 0 THEN concat('https://youtu.be/v', page_id) WHEN 1 THEN concat('https://www.youtube.com/watch?t=3&v=w', page_id) ELSE url END")
    page = F.coalesce(F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit("page")), F.lit(""))
    return fx.table(spark, sf, "pages").select("page_id", T.video_id(link).alias("video_id"), page.alias("page"))


STOP = ",".join(f"'{w}'" for w in T.SLUG_STOP_WORDS)


@query("fun19_slug_words", f"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(lower(text),'[^a-z0-9]+',' ','g'),' '), lambda w: w<>'' AND w NOT IN ({STOP}))[1:4],'_') AS slug FROM documents""")
def fun19(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", T.slug_words(F.col("text")).alias("slug"))


def view_sql(c):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({c},'{w}')" for w in ws) + f" THEN '{a}'" for a, ws in T.VIEW_TOKENS) + " ELSE 'front' END"


@query("fun20_view_bucket", f"WITH t AS (SELECT doc_id, lower(text||' '||lang||CASE doc_id%9 WHEN 0 THEN ' southpaw' WHEN 1 THEN ' Left Lead' WHEN 2 THEN ' from behind' WHEN 3 THEN ' side right' WHEN 4 THEN ' left profile' ELSE '' END) AS t FROM documents) SELECT doc_id, {view_sql('t')} AS bucket FROM t")
def fun20(spark, sf):
    t = F.expr("concat(text, ' ', lang, CASE doc_id%9 WHEN 0 THEN ' southpaw' WHEN 1 THEN ' Left Lead' WHEN 2 THEN ' from behind' WHEN 3 THEN ' side right' WHEN 4 THEN ' left profile' ELSE '' END)")
    return fx.table(spark, sf, "documents").select("doc_id", T.view_bucket(t).alias("bucket"))


@query("fun21_unique_name", """SELECT p_partkey, replace(p_name,' ','_')||CASE WHEN k=1 THEN '' ELSE '_'||CAST(k AS VARCHAR) END AS name
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""")
def fun21(spark, sf):
    d = fx.table(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("base"))
    return C.unique_name(d, "base", [F.col("p_partkey")], F.floor(F.col("p_partkey") / 4096)).select("p_partkey", "name")


@query("fun22_truthy_and_numbers", """
SELECT event_id, event_id%4 IN (1,2) AS keep, CASE WHEN event_id%5=0 THEN -1.0::DOUBLE ELSE value END AS f, CASE WHEN event_id%3=0 THEN 0 ELSE user_id END AS i FROM events""")
def fun22(spark, sf):
    e = fx.table(spark, sf, "events")
    flag = F.expr("CASE event_id%4 WHEN 0 THEN 'no' WHEN 1 THEN ' Yes ' WHEN 2 THEN 'KEEP' ELSE NULL END")
    num = F.expr("CASE WHEN event_id%10=0 THEN 'nan' WHEN event_id%5=0 THEN 'oops' ELSE concat(' ', CAST(value AS STRING)) END")
    whole = F.expr("CASE WHEN event_id%3=0 THEN '1.5' ELSE CAST(user_id AS STRING) END")
    return e.select("event_id", T.truthy(flag).alias("keep"), T.to_float(num, -1.0).alias("f"), T.to_int(whole).alias("i"))


@query("fun23_split_urls", """
SELECT doc_id, array_to_string(CASE WHEN doc_id%3=doc_id%7 THEN [a, c] ELSE [a, b, c] END, ' ') AS urls FROM (SELECT doc_id, 'u'||CAST(doc_id%3 AS VARCHAR) AS a, 'u'||CAST(doc_id%7 AS VARCHAR) AS b, lang AS c FROM documents)""")
def fun23(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id", "concat('u', doc_id%3, ' |;', 'u', doc_id%7, ',', 'u', doc_id%3, '\n') AS a", "lang AS b")
    return d.select("doc_id", F.array_join(T.split_urls(F.col("a"), F.col("b")), " ").alias("urls"))


TECHS = list(T.QUERY_TEMPLATES) + ["axe kick", "Spin-Elbow"]
TPL_SQL = " UNION ALL ".join(f"SELECT '{k}' AS technique, {i} AS k, '{t}' AS t" for k, v in T.QUERY_TEMPLATES.items() for i, t in enumerate(v))


@query("fun24_expand_queries", f"""
WITH tpl AS ({TPL_SQL}), p AS (SELECT DISTINCT p_size%10 AS s, p_partkey%7 AS a FROM part),
q AS (SELECT s, a, {TECHS}[s+1] AS raw, lower(replace(replace({TECHS}[s+1],'-',' '),'Spin','spin')) AS technique, {list(T.ANGLE_TEXTS.values())}[a+1] AS txt FROM p)
SELECT CAST(s AS INT) AS s, a, replace(t,'{{angle}}',txt) AS query FROM q JOIN tpl USING (technique) WHERE k<4
UNION ALL SELECT CAST(s AS INT), a, unnest([technique||' tutorial '||txt,'how to '||technique||' '||txt,technique||' technique '||txt]) FROM q WHERE technique NOT IN (SELECT technique FROM tpl)""")
def fun24(spark, sf):
    pick = lambda col, arr: F.element_at(F.array(*[F.lit(v) for v in arr]), (col + 1).cast("int"))
    p = fx.table(spark, sf, "part").selectExpr("p_size%10 AS s", "p_partkey%7 AS a").distinct()
    return p.select("s", "a", F.explode(T.expand_queries(pick(F.col("s"), TECHS), pick(F.col("a"), list(T.ANGLE_TEXTS)), 4)).alias("query"))


@query("fun25_compact_text", """
WITH t AS (SELECT p_partkey, regexp_replace(trim(p_name||'   '||p_type||'  '||p_brand||' (50%)'),'\\s+',' ','g') AS t FROM part)
SELECT p_partkey, CASE WHEN length(t)<=20 THEN t ELSE substring(t,1,19)||'…' END AS compact, regexp_replace(t,'[#()%]','_','g') AS clean FROM t""")
def fun25(spark, sf):
    t = F.expr("concat(p_name, '   ', p_type, '  ', p_brand, ' (50%)')")
    d = fx.table(spark, sf, "part").select("p_partkey", T.compact_text(t, 20).alias("compact"), T.compact_text(t, 500).alias("t"))
    return d.select("p_partkey", "compact", T.clean_str(F.col("t")).alias("clean"))


PROFILE_KEYS = ["Fighting Stance", "jab", "front-kick", "juggling"]


@query("fun32_capture_profile", f"""
WITH p AS (SELECT o_orderkey, {PROFILE_KEYS}[CAST(o_custkey%4 AS INT)+1] AS technique FROM orders)
SELECT o_orderkey, CASE technique WHEN 'juggling' THEN 'fixed' ELSE 'stance_cycle' END AS mode, 30 AS samples, CASE technique WHEN 'Fighting Stance' THEN 0.015 WHEN 'jab' THEN 0.03 WHEN 'front-kick' THEN 0.05 ELSE 0.02 END::DOUBLE AS energy,
 CASE technique WHEN 'Fighting Stance' THEN 0.10 WHEN 'jab' THEN 0.22 WHEN 'front-kick' THEN 0.28 ELSE 0.20 END::DOUBLE AS closure, CASE technique WHEN 'Fighting Stance' THEN 0.18 WHEN 'front-kick' THEN 0.38 ELSE 0.30 END::DOUBLE AS peak FROM p""")
def fun32(spark, sf):
    tech = F.element_at(F.array(*[F.lit(k) for k in PROFILE_KEYS]), (F.col("o_custkey") % 4 + 1).cast("int"))
    d = fx.table(spark, sf, "orders").select("o_orderkey", C.capture_profile(tech, {"num_video_sequence_samples": 30}).alias("p"))
    return d.select("o_orderkey", F.col("p.reference_sequence_mode").alias("mode"), F.col("p.num_video_sequence_samples").alias("samples"),
                    F.col("p.ref_min_motion_energy").alias("energy"), F.col("p.ref_min_return_closure").alias("closure"), F.col("p.ref_stance_peak_threshold").alias("peak"))


@query("fun33_effective_samples", "SELECT o_orderkey, CASE WHEN o_custkey%5=0 THEN greatest(o_orderkey%30,2) ELSE least(greatest(o_orderkey%30,2),greatest(o_custkey%25-1,2)) END AS samples FROM orders")
def fun33(spark, sf):
    frames = F.expr("CASE WHEN o_custkey%5=0 THEN NULL ELSE o_custkey%25 END")
    return fx.table(spark, sf, "orders").select("o_orderkey", C.effective_samples(F.col("o_orderkey") % 30, frames).cast("bigint").alias("samples"))


KEEP, REJECT = ["tion", "eau(x|an)", "ther(in|on)", "ing"], ["zz+", "qu[aei]r", "erenthe"]


def first_sql(c, pats):
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({c},'(?i){p}') THEN '{p}' END" for p in pats) + ")"


@query("flt07_classify_keywords", f"""
WITH m AS (SELECT pos, {first_sql("title||' '||tags", REJECT)} AS bad, {first_sql("title||' '||tags", KEEP)} AS good FROM fx_candidates)
SELECT pos, CASE WHEN bad IS NULL AND good IS NOT NULL THEN 'yes' ELSE 'no' END AS decision, coalesce(bad, good) AS pattern FROM m""")
def flt07(spark, sf):
    return fx.candidates(spark, sf).select("pos", T.classify_keywords(F.col("title"), F.col("tags"), keep=KEEP, reject=REJECT).alias("c")).select("pos", "c.*")


@query("flt07_default_keywords")
def flt07_default(spark, sf):
    return fx.candidates(spark, sf).select("pos", T.classify_keywords(F.col("title"), F.col("tags")).alias("c")).select("pos", "c.*")


@query("flt08_filter_duration_views", "SELECT pos FROM fx_candidates WHERE (pos%3)*3600+(pos%60)*60+(pos*7)%60 BETWEEN 120 AND 4000 AND view_count>=300")
def flt08(spark, sf):
    d = fx.candidates(spark, sf).withColumn("duration_seconds", T.iso_duration_seconds(F.col("duration_iso8601")))
    return C.filter_duration_views(d, 120, 4000, 300).select("pos")


@query("flt09_valid_plan_rows", "SELECT technique, angle FROM fx_plan WHERE command_ready='yes'")
def flt09(spark, sf):
    p = fx.plan(spark, sf).withColumn("record_reference_key", F.when(F.col("command_ready") == "yes", F.col("technique")).otherwise("")).withColumn("reference_key", F.lit(" "))
    return C.valid_plan_rows(p, ["source_url_1", "source_url_2"]).select("technique", "angle")


@query("joi14_plan_coverage", """
WITH s AS (SELECT event_type||CASE WHEN value>150 THEN '' ELSE '_drill' END AS technique, a.angle, count(*) AS samples FROM events LEFT JOIN fx_angles a ON a.n=event_id%9 GROUP BY 1,2)
SELECT p.technique, p.angle, status, coalesce(samples,0) AS samples FROM fx_plan p LEFT JOIN s USING (technique, angle)""")
def joi14(spark, sf):
    return coverage(spark, sf).select("technique", "angle", "status", "samples")


def coverage(spark, sf):
    # captures that scored low are drills, which no plan asks for; some samples carry an index after the angle
    arr = F.array(*[F.lit(a) for a in fx.ANGLES], F.lit("none"), F.lit("none"))
    e = fx.table(spark, sf, "events")
    s = e.select(F.expr("concat(event_type, CASE WHEN value>150 THEN '' ELSE '_drill' END)").alias("technique"), F.concat(F.get(arr, (F.col("event_id") % 9).cast("int")), F.expr("CASE WHEN event_id%2=0 THEN '_07' ELSE '' END")).alias("angle"))
    return C.plan_coverage(fx.plan(spark, sf), s)


COV_SQL = """WITH s AS (SELECT event_type||CASE WHEN value>150 THEN '' ELSE '_drill' END AS technique, a.angle, count(*) AS samples FROM events LEFT JOIN fx_angles a ON a.n=event_id%9 GROUP BY 1,2),
c AS (SELECT p.*, coalesce(samples,0) AS samples FROM fx_plan p LEFT JOIN s USING (technique, angle))"""


@query("agg32_coverage_report", COV_SQL + """ SELECT count(*) AS rows, count(*) FILTER (status='ready') AS ready, count(*) FILTER (status='ready' AND samples=0) AS missing, count(*) FILTER (status='ready' AND samples BETWEEN 1 AND 3) AS low,
 count(*) FILTER (status='ready' AND samples>=4) AS good, count(DISTINCT (technique, angle)) AS keys, count(DISTINCT (technique, angle)) FILTER (samples>0) AS covered, count(DISTINCT (technique, angle)) FILTER (samples>=4) AS well_covered FROM c""")
def agg32(spark, sf):
    return C.coverage_report(coverage(spark, sf))


@query("agg33_gap_targets", COV_SQL + " SELECT technique, angle, samples, 15-samples AS needed, CASE WHEN samples=0 THEN 0 ELSE 1 END AS tier FROM c WHERE status='ready' AND samples<15")
def agg33(spark, sf):
    return C.gap_targets(coverage(spark, sf), 15)


@query("agg31_preflight_sources", """
WITH n AS (SELECT fx_plan.*, len(list_distinct(['u'||CAST(a.n AS VARCHAR),'u'||CAST(a.n%3 AS VARCHAR),'u'||CAST(a.n*2 AS VARCHAR)])) AS d FROM fx_plan JOIN fx_angles a USING (angle))
SELECT technique, angle, CAST(d AS INT) AS distinct_sources, 3 AS required_sources FROM n WHERE command_ready='yes' AND d<3""")
def agg31(spark, sf):
    out = C.preflight_sources(fx.plan(spark, sf), 3, ["source_url_1", "source_url_2"], F.col("command_ready") == "yes")
    return out.select("technique", "angle", "distinct_sources", "required_sources")


@query("agg34_dedup_merge", """
WITH h AS (SELECT video_id, array_to_string(list_sort(list_distinct(list(query_hit))),'|') AS hits FROM fx_candidates GROUP BY 1)
SELECT video_id, pos, tags, view_count, hits AS query_hit FROM fx_candidates JOIN h USING (video_id) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY pos)=1""")
def agg34(spark, sf):
    return C.dedup_merge(fx.candidates(spark, sf).select("video_id", "pos", "tags", "view_count", "query_hit"))


@query("agg35_seed_inventory", f"WITH {NAMES_SQL}, a AS (SELECT technique, name, {ANGLE_SQL} AS angle FROM n) SELECT technique, angle, count(*) AS files, min(name) AS first_file, max(name) AS last_file FROM a WHERE angle IS NOT NULL GROUP BY 1,2")
def agg35(spark, sf):
    return C.seed_inventory(names(spark, sf))


@query("joi15_attach_details", """
SELECT c.pos, CASE WHEN d.n IS NULL THEN '' WHEN d.n%2=0 THEN 'hd' ELSE 'sd' END AS definition, coalesce(d.v,0) AS like_count FROM fx_candidates c
LEFT JOIN (SELECT video_id, count(*) AS n, sum(view_count)::BIGINT AS v FROM fx_candidates GROUP BY 1 HAVING count(*)>1) d USING (video_id)""")
def joi15(spark, sf):
    c = fx.candidates(spark, sf)
    d = c.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("view_count").alias("like_count")).where("n > 1")
    d = d.withColumn("definition", F.expr("CASE WHEN n%2=0 THEN 'hd' ELSE 'sd' END"))
    return C.attach_details(c, d, {"definition": "", "like_count": 0}).select("pos", "definition", "like_count")


PLANS_SQL = """ex AS (SELECT event_type AS technique, 'angle '||CAST(event_id%50 AS VARCHAR) AS angle, event_id AS pos, 'old'||CAST(event_id AS VARCHAR) AS notes FROM events WHERE event_id%2=0),
nw AS (SELECT upper(event_type) AS technique, 'angle_'||CAST(user_id%77 AS VARCHAR) AS angle, event_id AS pos, 'new'||CAST(event_id AS VARCHAR) AS notes FROM events WHERE event_id%2=1),
al AS (SELECT *, 0 AS part FROM ex UNION ALL SELECT *, 1 FROM nw), ky AS (SELECT *, lower(technique)||'#'||replace(angle,' ','_') AS key FROM al),
wn AS (SELECT key, arg_max({'technique': technique, 'angle': angle, 'pos': pos, 'notes': notes}, (part, pos)) AS w, min(part) AS fp FROM ky GROUP BY key)"""


def plans(spark, sf):
    """Two plans over all events: the even ones existing, the odd ones new."""
    e = fx.table(spark, sf, "events")
    old = e.where("event_id%2=0").selectExpr("event_type AS technique", "concat('angle ', event_id%50) AS angle", "event_id AS pos", "concat('old', event_id) AS notes")
    new = e.where("event_id%2=1").selectExpr("upper(event_type) AS technique", "concat('angle_', user_id%77) AS angle", "event_id AS pos", "concat('new', event_id) AS notes")
    return old, new


@query("set01_merge_plan", "WITH " + PLANS_SQL + """ SELECT 0 AS part, k.pos AS place, w.technique AS technique, w.angle AS angle, w.notes AS notes FROM ky k JOIN wn USING (key) WHERE k.part=0
UNION ALL SELECT 1, min(k.pos), any_value(w.technique), any_value(w.angle), any_value(w.notes) FROM ky k JOIN wn USING (key) WHERE fp=1 GROUP BY key""")
def set01(spark, sf):
    return C.merge_plan(*plans(spark, sf)).select("ord.part", F.col("ord.pos").alias("place"), "technique", "angle", "notes")


@query("set01_append_plan", "WITH " + PLANS_SQL + " SELECT part, pos AS place, notes FROM al")
def set01_append(spark, sf):
    return C.merge_plan(*plans(spark, sf), mode="append").select("ord.part", F.col("ord.pos").alias("place"), "notes")


@query("set02_merge_preview", "WITH " + PLANS_SQL + " SELECT count(*) FILTER (fp=0) AS updated, count(*) FILTER (fp=1) AS added FROM ky JOIN wn USING (key) WHERE part=1")
def set02(spark, sf):
    return C.merge_preview(*plans(spark, sf))


@query("top02_rank_candidates", "SELECT video_id, pos, row_number() OVER (ORDER BY view_count DESC, duration_iso8601 DESC, pos) AS place FROM fx_candidates")
def top02(spark, sf):
    from visiontables.operators.ordered import rank_rows
    d = fx.candidates(spark, sf).select("video_id", "pos", "view_count", "duration_iso8601")
    order = [F.col("view_count").desc(), F.col("duration_iso8601").desc(), F.col("pos")]
    return rank_rows(d, [], order, -F.floor(F.col("view_count") / 16), "place").select("video_id", "pos", "place")


@query("top03_top_urls", """
WITH r AS (SELECT tags AS technique, query_hit AS angle, 'https://www.youtube.com/watch?v='||video_id||'&p='||CAST(pos AS VARCHAR) AS url, row_number() OVER (PARTITION BY tags, query_hit ORDER BY view_count DESC, 'https://www.youtube.com/watch?v='||video_id||'&p='||CAST(pos AS VARCHAR)) AS k FROM fx_candidates)
SELECT technique, angle, coalesce(max(url) FILTER (k=1),'') AS source_url_1, coalesce(max(url) FILTER (k=2),'') AS source_url_2, coalesce(max(url) FILTER (k=3),'') AS source_url_3, '' AS source_url_4 FROM r WHERE k<=3 GROUP BY 1,2""")
def top03(spark, sf):
    d = fx.candidates(spark, sf).selectExpr("tags AS technique", "query_hit AS angle", "view_count", "concat('https://www.youtube.com/watch?v=', video_id, '&p=', pos) AS url")
    return C.top_urls(d, 3)


@query("top07_rotate_sources", """
SELECT doc_id, array_to_string(list_concat(u[CAST(k AS INT)+1:], u[1:CAST(k AS INT)]),' ') AS urls FROM (SELECT doc_id, doc_id%CASE WHEN doc_id%3=doc_id%7 THEN 2 ELSE 3 END AS k, CASE WHEN doc_id%3=doc_id%7 THEN ['u'||CAST(doc_id%3 AS VARCHAR), lang] ELSE ['u'||CAST(doc_id%3 AS VARCHAR),'u'||CAST(doc_id%7 AS VARCHAR),lang] END AS u FROM documents)""")
def top07(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", T.split_urls(F.expr("concat('u', doc_id%3, ';', 'u', doc_id%7)"), F.col("lang")).alias("u"))
    return d.select("doc_id", F.array_join(C.rotate_sources(F.col("u"), F.col("doc_id")), " ").alias("urls"))


@query("win20_next_index", """SELECT lang AS stem, 1+max(CASE WHEN doc_id%10=0 THEN 1 ELSE doc_id%37 END) AS next_index FROM documents GROUP BY 1""")
def win20(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("lang AS stem", "CASE WHEN doc_id%10=0 THEN lang ELSE concat(lang, '_', lpad(CAST(doc_id%37 AS STRING), 2, '0')) END AS name")
    return C.next_index(d)
