"""Registered queries, (spark, sf_dir) -> DataFrame over whole tables, and the same results in DuckDB's SQL."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.functions import words
from parley.operators import exports, fulltext, intervals, library, moments, search, writes
from parley.plans.derive import LINES_SQL, TURNS_SQL, lines, table, turns
from parley.plans.shared import exists, work_folder

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def on_turns(name: str, operator, sql: str | None = None, **kind):
    query(name, f"WITH {TURNS_SQL}{sql}" if sql else None)(lambda spark, sf_dir: operator(turns(spark, sf_dir), **kind))


def on_lines(name: str, operator, sql: str | None = None, **kind):
    query(name, f"WITH {LINES_SQL}{sql}" if sql else None)(lambda spark, sf_dir: operator(lines(spark, sf_dir), **kind))


on_turns("talk_time", intervals.talk_time, """
SELECT meeting_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, count(*) AS n_turns FROM turns GROUP BY 1, 2""")

on_turns("talk_share", intervals.talk_share, """, t AS (
SELECT meeting_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms FROM turns GROUP BY 1, 2)
SELECT meeting_id, speaker, talk_ms, talk_ms / greatest(1, CAST(sum(talk_ms) OVER (PARTITION BY meeting_id) AS BIGINT)) AS share FROM t QUALIFY talk_ms > 0""")

on_turns("speaker_count", intervals.speaker_count, "\nSELECT meeting_id, count(DISTINCT speaker) AS n_speakers FROM turns GROUP BY 1")

_BANDS = """, a AS (
SELECT *, coalesce(speaker <> lag(speaker) OVER o, true) AS new FROM turns {where} WINDOW o AS (PARTITION BY meeting_id ORDER BY start_ms, end_ms, turn_id)),
b AS (SELECT *, sum(new::INT) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, turn_id) AS run FROM a),
c AS (SELECT *, new OR start_ms - max(end_ms) OVER (PARTITION BY meeting_id, run ORDER BY start_ms, end_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {gap} AS begins FROM b),
d AS (SELECT *, sum(begins::INT) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, turn_id) AS island FROM c)
SELECT meeting_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_turns FROM d GROUP BY meeting_id, speaker, island"""
on_turns("merge_same_speaker", intervals.merge_same_speaker, _BANDS.format(where="WHERE end_ms > start_ms", gap=30_000))
on_turns("speaker_bands", intervals.speaker_bands, _BANDS.format(where="", gap=2000))

_GAPS = """g1 AS (SELECT *, coalesce(start_ms - max(end_ms) OVER (PARTITION BY meeting_id, speaker ORDER BY start_ms, end_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 800, true) AS begins FROM turns),
g2 AS (SELECT *, sum(begins::INT) OVER (PARTITION BY meeting_id, speaker ORDER BY start_ms, end_ms, turn_id) AS island FROM g1),
spans AS (SELECT meeting_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_turns FROM g2 GROUP BY meeting_id, speaker, island)"""
on_turns("merge_gaps", intervals.merge_gaps, f", {_GAPS} SELECT * FROM spans")

on_turns("overlap_flag", intervals.overlap_flag, """, p AS (
SELECT l.turn_id, sum(least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)) AS ms FROM turns l JOIN turns r
ON l.meeting_id = r.meeting_id AND l.speaker <> r.speaker AND l.start_ms < r.end_ms AND r.start_ms < l.end_ms GROUP BY 1)
SELECT turn_id, meeting_id, speaker, CAST(coalesce(ms, 0) AS BIGINT) AS shared_ms, coalesce(ms, 0) >= 200 AS overlap FROM turns LEFT JOIN p USING (turn_id)""")

on_turns("overlap_regions", intervals.overlap_regions, f""", {_GAPS},
m AS (SELECT meeting_id, t, d, sum(d) AS change FROM (SELECT meeting_id, start_ms AS t, 1 AS d FROM spans WHERE end_ms > start_ms UNION ALL SELECT meeting_id, end_ms, -1 FROM spans WHERE end_ms > start_ms) GROUP BY ALL),
n AS (SELECT *, sum(change) OVER (PARTITION BY meeting_id ORDER BY t, d) AS active FROM m),
o AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY meeting_id ORDER BY t, d), 0) AS was FROM n),
e AS (SELECT *, lead(t) OVER (PARTITION BY meeting_id ORDER BY t, d) AS until FROM (SELECT * FROM o WHERE (active >= 2) <> (was >= 2))),
r AS (SELECT meeting_id, t AS start_ms, until AS end_ms FROM e WHERE active >= 2 AND until - t >= 200)
SELECT r.meeting_id, r.start_ms, r.end_ms, array_to_string(list_sort(list(DISTINCT s.speaker)), ',') AS speakers
FROM r JOIN spans s ON r.meeting_id = s.meeting_id AND r.start_ms < s.end_ms AND s.start_ms < r.end_ms GROUP BY ALL""")

on_turns("relabel_speakers", intervals.relabel_speakers, """, f AS (SELECT meeting_id, speaker, min(start_ms) AS first_ms FROM turns GROUP BY 1, 2)
SELECT *, 'S' || row_number() OVER (PARTITION BY meeting_id ORDER BY first_ms, speaker) AS label FROM f""")

on_turns("asof_active_line", intervals.asof_active, """
SELECT p.meeting_id, p.turn_id AS probe_id, p.end_ms AS t, coalesce(f.turn_id, -1) AS active_id
FROM turns p ASOF LEFT JOIN (SELECT meeting_id, start_ms, max(turn_id) AS turn_id FROM turns GROUP BY 1, 2) f ON p.meeting_id = f.meeting_id AND p.end_ms >= f.start_ms""")

on_turns("asof_nearest_snap", intervals.asof_nearest, """, s AS (SELECT DISTINCT meeting_id, start_ms FROM turns),
b AS (SELECT p.meeting_id, p.turn_id, p.end_ms, f.start_ms AS back FROM turns p ASOF LEFT JOIN s f ON p.meeting_id = f.meeting_id AND p.end_ms >= f.start_ms),
a AS (SELECT b.*, f.start_ms AS ahead FROM b ASOF LEFT JOIN s f ON b.meeting_id = f.meeting_id AND b.end_ms <= f.start_ms),
n AS (SELECT *, CASE WHEN back IS NULL OR ahead - end_ms < end_ms - back THEN ahead ELSE back END AS near FROM a)
SELECT meeting_id, turn_id AS probe_id, end_ms AS t, CASE WHEN abs(near - end_ms) <= 20000 THEN near END AS snap_ms FROM n""")

on_turns("waveform_bins", intervals.waveform, """, c AS (
SELECT *, unnest(range(start_ms // 60000, (end_ms - 1) // 60000 + 1)) AS bin FROM turns WHERE end_ms > start_ms),
s AS (SELECT meeting_id, bin, speaker, CAST(sum(least(end_ms, (bin + 1) * 60000) - greatest(start_ms, bin * 60000)) AS BIGINT) AS ms, min((start_ms, turn_id)) AS first FROM c GROUP BY ALL)
SELECT meeting_id, bin, CAST(sum(ms) OVER (PARTITION BY meeting_id, bin) AS BIGINT) AS speech_ms, speaker FROM s
QUALIFY row_number() OVER (PARTITION BY meeting_id, bin ORDER BY ms DESC, first) = 1""")

_RASTER = """f0 AS (SELECT meeting_id, speaker, CAST(round_even(start_ms / 10000.0, 0) AS BIGINT) AS a, CAST(round_even(end_ms / 10000.0, 0) AS BIGINT) AS b FROM turns),
frames AS (SELECT DISTINCT meeting_id, speaker, unnest(range(a, b)) AS frame FROM f0 WHERE b > a)"""
on_turns("frame_raster", intervals.raster, f", {_RASTER} SELECT * FROM frames")
_MEDIAN = _RASTER + """, e AS (SELECT meeting_id, 0 AS lo, max(frame) AS hi FROM frames GROUP BY 1),
v AS (SELECT meeting_id, speaker, frame, lo, hi, unnest([frame - 1, frame, frame + 1]) AS cell FROM frames JOIN e USING (meeting_id)),
med AS (SELECT meeting_id, speaker, cell AS frame FROM v WHERE cell BETWEEN lo AND hi GROUP BY 1, 2, 3
HAVING sum(1 + (CASE WHEN frame = lo AND cell = lo THEN 1 ELSE 0 END) + (CASE WHEN frame = hi AND cell = hi THEN 1 ELSE 0 END)) > 1)"""
on_turns("median_filter", lambda t: intervals.median_filter(intervals.raster(t)), f", {_MEDIAN} SELECT * FROM med")
on_turns("active_runs", lambda t: intervals.active_runs(intervals.median_filter(intervals.raster(t)), 2), f""", {_MEDIAN},
r AS (SELECT *, frame - row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY frame) AS run FROM med)
SELECT meeting_id, speaker, min(frame) AS first, max(frame) + 1 AS last FROM r GROUP BY meeting_id, speaker, run HAVING count(*) >= 2""")
_CLOCK = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0')"
_MARKED = _CLOCK + " || '{1}' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"
#: Names that speakers were given; the other labels are shown as they are.
NAMES_SQL = "names AS (SELECT DISTINCT meeting_id, speaker AS label, 'Bot <' || meeting_id || '>' AS display FROM lines WHERE speaker = 'assistant' AND meeting_id % 2 = 0)"
_WHO = f""", {NAMES_SQL},
said AS (SELECT l.*, coalesce(display, speaker) AS who, row_number() OVER (PARTITION BY l.meeting_id ORDER BY start_ms, line_id) AS place FROM lines l LEFT JOIN names n ON l.meeting_id = n.meeting_id AND l.speaker = n.label)"""


def names(t):
    named = t.filter("speaker = 'assistant' AND meeting_id % 2 = 0").select("meeting_id", F.col("speaker").alias("label")).distinct()
    return named.withColumn("display", F.concat(F.lit("Bot <"), F.col("meeting_id").cast("string"), F.lit(">")))


_TXT = f"'[' || {_CLOCK.format('start_ms')} || '] ' || who || ': ' || text"
_SRT = f"place || chr(10) || {_MARKED.format('start_ms', ',')} || ' --> ' || {_MARKED.format('end_ms', ',')} || chr(10) || who || ': ' || text || chr(10)"
_VTT = f"{_MARKED.format('start_ms', '.')} || ' --> ' || {_MARKED.format('end_ms', '.')} || chr(10) || '<v ' || replace(who, '>', '') || '>' || replace(text, '-->', '->') || chr(10)"
on_lines("export_txt", lambda t: exports.txt(t, names(t)), f"{_WHO} SELECT meeting_id, line_id, {_TXT} AS line FROM said")
on_lines("export_srt", lambda t: exports.srt(t, names(t)), f"{_WHO} SELECT meeting_id, line_id, {_SRT} AS cue FROM said")
on_lines("export_vtt", lambda t: exports.vtt(t, names(t)), f"{_WHO} SELECT meeting_id, line_id, {_VTT} AS cue FROM said")
on_lines("export_documents", lambda t: exports.documents(t, names(t)), f"""{_WHO}
SELECT meeting_id, 'txt' AS format, string_agg({_TXT}, chr(10) ORDER BY line_id) || chr(10) AS document FROM said GROUP BY 1
UNION ALL SELECT meeting_id, 'srt', string_agg({_SRT}, chr(10) ORDER BY line_id) FROM said GROUP BY 1
UNION ALL SELECT meeting_id, 'vtt', 'WEBVTT' || chr(10) || chr(10) || string_agg({_VTT}, chr(10) ORDER BY line_id) FROM said GROUP BY 1""")
on_turns("export_rttm", exports.rttm, """
SELECT turn_id, 'SPEAKER ' || meeting_id || ' 1 ' || (start_ms // 1000) || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || ' ' || (greatest(0, end_ms - start_ms) // 1000) || '.' || lpad(CAST(greatest(0, end_ms - start_ms) % 1000 AS VARCHAR), 3, '0') || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS row FROM turns""")

#: What the search queries ask for: two words, and a phrase beside a word.
ASKED, PHRASE = "the er", "the_o an"
_TERMS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
_HITS = f"""w AS (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents),
h AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: starts_with(x, 'the'))) AS t0, len(list_filter(w, lambda x: starts_with(x, 'er'))) AS t1,
  len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND starts_with(w[i + 1], 'o'))) AS p0, len(list_filter(w, lambda x: starts_with(x, 'an'))) AS p1 FROM w)"""
_BM25 = """, s AS (SELECT count(*) AS n_docs, avg(n) AS avg_n, count(*) FILTER ({0}0 > 0) AS d0, count(*) FILTER ({0}1 > 0) AS d1 FROM h),
k AS (SELECT doc_id, greatest(ln((n_docs - d0 + 0.5) / (d0 + 0.5)), 1e-6) * {0}0 * 2.2 / ({0}0 + 1.2 * (0.25 + 0.75 * n / avg_n)) + greatest(ln((n_docs - d1 + 0.5) / (d1 + 0.5)), 1e-6) * {0}1 * 2.2 / ({0}1 + 1.2 * (0.25 + 0.75 * n / avg_n)) AS score FROM h, s WHERE {0}0 > 0 AND {0}1 > 0)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM k QUALIFY rank <= 50"""


def index(spark, sf_dir, name="documents", key="doc_id", columns=("text",)):
    """The written index of a table: made by the first query of a session that asks for it, read by all."""
    folder = f"{work_folder(spark)}/index-{hashlib.md5(f'{sf_dir} {name} {columns}'.encode()).hexdigest()}"
    if not exists(spark, f"{folder}/documents/_SUCCESS"):
        fulltext.write_index(table(spark, sf_dir, name), folder, key, columns)
    return fulltext.read_index(spark, folder)


def _ranked(found):
    return found.select(F.col("key").alias("doc_id"), F.row_number().over(Window.orderBy(F.desc("score"), "key")).alias("rank"))  # at most 50 rows


@query("fts_prefix_and", f"WITH {_HITS} SELECT doc_id FROM h WHERE t0 > 0 AND t1 > 0")
def _(spark, sf_dir):
    return fulltext.matching(index(spark, sf_dir)[0], ASKED).withColumnRenamed("key", "doc_id")


@query("fts_bm25_topk", f"WITH {_HITS}{_BM25.format('t')}")
def _(spark, sf_dir):
    return _ranked(fulltext.search(*index(spark, sf_dir), ASKED))


@query("fts_phrase_topk", f"WITH {_HITS}{_BM25.format('p')}")
def _(spark, sf_dir):
    return _ranked(fulltext.search(*index(spark, sf_dir), PHRASE))


@query("fts_acl", f"""WITH {_HITS} SELECT doc_id FROM h JOIN documents d USING (doc_id)
WHERE t0 > 0 AND t1 > 0 AND (doc_id % 7 = 3 OR lang = 'en' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AND source NOT LIKE '%1%'""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 7).alias("owner_id"), (F.col("lang") == "en").alias("everyone"))
    shares = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(3).alias("user_id"))
    may = fulltext.visible(docs, shares, 3, ~F.col("source").contains("1"))
    return fulltext.search(*index(spark, sf_dir), ASKED, top=None, visible=may).select(F.col("key").alias("doc_id"))


_PARTS = ("p_name", "p_type", "p_brand")


@query("fts_columns", f"""WITH t AS (SELECT p_partkey, {_TERMS.format('p_name')} AS a, {_TERMS.format('p_type')} AS b, {_TERMS.format('p_brand')} AS c FROM part),
h AS (SELECT p_partkey, len(a) + len(b) + len(c) AS n, len(list_filter(a || b || c, lambda x: starts_with(x, 's'))) AS t0,
  len(list_filter(range(1, len(a)), lambda i: a[i] = 'brand' AND starts_with(a[i + 1], '1'))) + len(list_filter(range(1, len(b)), lambda i: b[i] = 'brand' AND starts_with(b[i + 1], '1'))) + len(list_filter(range(1, len(c)), lambda i: c[i] = 'brand' AND starts_with(c[i + 1], '1'))) AS t1 FROM t)
SELECT p_partkey FROM h WHERE t0 > 0 AND t1 > 0""")
def _(spark, sf_dir):
    return fulltext.matching(index(spark, sf_dir, "part", "p_partkey", _PARTS)[0], "S brand_1").withColumnRenamed("key", "p_partkey")


on_lines("substring_search", search.substring_search, "\nSELECT meeting_id, line_id FROM lines WHERE contains(lower(text), 'the')", query=" The ")
on_lines("snippet_simple", lambda t: t.select("meeting_id", "line_id", search.snippet(F.col("text"), "the").alias("snippet")), """, a AS (SELECT *, instr(lower(text), 'the') AS place FROM lines)
SELECT meeting_id, line_id, CASE WHEN place > 0 THEN (CASE WHEN place - 60 > 1 THEN '…' ELSE '' END) || substring(text, CAST(greatest(place - 60, 1) AS BIGINT), CAST(least(place + 63, length(text) + 1) - greatest(place - 60, 1) AS BIGINT)) || (CASE WHEN place + 63 <= length(text) THEN '…' ELSE '' END) ELSE substring(text, 1, 120) END AS snippet FROM a""")
_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words.STOP.split()))) + "]"
_STEMS = f"""list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\\-]*'), lambda x: regexp_replace(x, '[''\\-]+$', '')),
lambda x: length(x) >= 3 AND (length(x) >= 4 OR regexp_matches(x, '[0-9]')) AND NOT list_contains({_STOP}, x)),
lambda x: substring(CASE WHEN x LIKE '%ing' AND length(x) > 6 THEN x[:-4] WHEN x LIKE '%ed' AND length(x) > 5 THEN x[:-3] WHEN x LIKE '%es' AND length(x) > 5 THEN x[:-3] WHEN x LIKE '%s' AND length(x) > 4 THEN x[:-2] ELSE x END, 1, 7)))"""
on_lines("salient_words", search.salient_words, f"\nSELECT meeting_id, line_id, array_to_string(list_sort({_STEMS}), ' ') AS words FROM lines")
on_lines("grounding", lambda t: search.grounding(t, t, t.groupBy("meeting_id").agg(F.max("end_ms").alias("end_ms"))), f""", w AS (SELECT *, {_STEMS} AS ws FROM lines),
p AS (SELECT c.meeting_id, c.line_id AS claim_id, len(list_distinct(flatten(list(list_intersect(c.ws, b.ws))))) AS k FROM w c JOIN w b
ON c.meeting_id = b.meeting_id AND b.line_id <> c.line_id AND b.start_ms <= c.start_ms + 90000 AND (CASE WHEN b.end_ms = 0 THEN b.start_ms ELSE b.end_ms END) >= c.start_ms - 90000 GROUP BY 1, 2)
SELECT w.meeting_id, w.line_id AS claim_id, CAST(len(ws) AS INT) AS n_words, CAST(coalesce(k, 0) AS INT) AS n_found, len(ws) > 0 AND coalesce(k, 0) >= CASE WHEN len(ws) <= 3 THEN 1 ELSE 2 END AS grounded FROM w LEFT JOIN p ON w.meeting_id = p.meeting_id AND w.line_id = p.claim_id""")


def _meetings(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("created"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query("access_levels", """WITH a AS (SELECT o_orderkey AS meeting_id, o_custkey AS user_id, 3 AS rank FROM orders
UNION ALL SELECT l_orderkey, l_suppkey, CASE WHEN l_linenumber % 2 = 1 THEN 2 ELSE 1 END FROM lineitem)
SELECT meeting_id, user_id, ['view', 'edit', 'owner'][greatest(max(rank), max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END))] AS access FROM a JOIN orders ON o_orderkey = meeting_id GROUP BY 1, 2""")
def _(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") % 2 == 1, "edit").otherwise("view")
    shares = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_suppkey").alias("user_id"), kind.alias("access"))
    everyone = F.when(F.col("state") == "F", "edit").when(F.col("state") == "P", "view")
    return library.access_levels(_meetings(spark, sf_dir).withColumn("everyone", everyone), shares)


@query("people_list", """SELECT c_custkey AS user_id, c_name AS name, coalesce(n, 0) AS n_meetings, CAST(coalesce(cents, 0) AS BIGINT) AS cents, coalesce(k, 0) AS n_shared FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1) ON c_custkey = o_custkey
LEFT JOIN (SELECT l_suppkey, count(*) AS k FROM lineitem GROUP BY 1) ON c_custkey = l_suppkey""")
def _(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    shares = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"))
    return library.people_list(users, _meetings(spark, sf_dir), shares)


@query("queue_pick", """WITH r AS (SELECT l_orderkey, min(l_linenumber * 7 + l_suppkey % 5) AS due FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
q AS (SELECT o_orderkey AS meeting_id, o_custkey % 50 AS worker, CASE WHEN o_orderkey % 5 > 0 THEN 'paused' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status, o_orderdate AS created FROM orders)
SELECT worker, meeting_id, status FROM q LEFT JOIN r ON l_orderkey = meeting_id WHERE status IN ('running', 'queued') OR (status = 'paused' AND coalesce(due, 0) <= 16)
QUALIFY row_number() OVER (PARTITION BY worker ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, created, meeting_id) = 1""")
def _(spark, sf_dir):
    status = F.when(F.col("meeting_id") % 5 > 0, "paused").when(F.col("state") == "P", "running").when(F.col("state") == "O", "queued").otherwise("done")
    m = _meetings(spark, sf_dir).withColumns({"status": status, "worker": F.col("owner_id") % 50})
    retries = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("meeting_id"), F.expr("l_linenumber * 7 + l_suppkey % 5").alias("retry_at"))
    return library.next_meetings(m, retries, F.lit(16), "worker")


@query("day_groups", """WITH t AS (SELECT max(CAST(o_orderdate AS DATE)) AS today FROM orders), a AS (SELECT o_orderkey AS meeting_id, CAST(o_orderdate AS DATE) AS day, today, today - CAST(o_orderdate AS DATE) AS age FROM orders, t)
SELECT meeting_id, CASE WHEN age = 0 THEN 'today' WHEN age = 1 THEN 'yesterday' WHEN age > 1 AND age < 7 THEN 'this week' ELSE strftime(day, '%Y-%m') END AS day_group FROM a""")
def _(spark, sf_dir):
    m = _meetings(spark, sf_dir).withColumn("day", F.to_date("created"))
    today = m.agg(F.max("day").alias("today"))  # one row
    return m.crossJoin(F.broadcast(today)).select("meeting_id", library.day_group(F.col("day"), F.col("today")).alias("day_group"))


@query("orphans_anti", "SELECT o_orderkey AS meeting_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(spark, sf_dir):
    return _meetings(spark, sf_dir).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id")), "meeting_id", "left_anti").select("meeting_id")


@query("queue_order", """WITH q AS (SELECT o_orderkey AS meeting_id, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'queued' WHEN 'F' THEN 'paused' END AS status, o_orderdate AS created, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS rank FROM orders)
SELECT meeting_id, status, created, rank FROM q WHERE rank IS NOT NULL""")
def _(spark, sf_dir):
    status = F.when(F.col("state") == "P", "running").when(F.col("state") == "O", "queued").when(F.col("state") == "F", "paused")
    return library.queue(_meetings(spark, sf_dir).withColumn("status", status))


@query("latest_events", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type")


@query("vote_top_name", """WITH v AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS meeting_id, 'S' || (1 + user_id % 8) AS label, event_type AS name, count(*) AS n, min(event_id) AS t FROM events GROUP BY 1, 2, 3)
SELECT meeting_id, label, name, n FROM v QUALIFY row_number() OVER (PARTITION BY meeting_id, label ORDER BY n DESC, t, name) = 1""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("turn"), "event_type").join(turns(spark, sf_dir).withColumnRenamed("turn_id", "turn"), "turn")
    return library.vote_top_name(e.select("meeting_id", F.col("speaker").alias("label"), F.col("event_type").alias("name"), F.col("turn").alias("t")))


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("cast(cast(ts as date) as string)").alias("meeting_id"), F.col("event_id").alias("frame_id"), F.col("event_id").alias("t"), F.floor(F.col("value") % 4).cast("int").alias("relevance"))


_FRAMES = "fr AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS meeting_id, event_id AS frame_id, event_id AS t, CAST(floor(value % 4) AS INT) AS relevance FROM events)"


@query("key_visuals_topk", f"WITH {_FRAMES} SELECT * FROM fr WHERE relevance >= 2 QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY relevance DESC, t, frame_id) <= 30")
def _(spark, sf_dir):
    return library.key_visuals(_frames(spark, sf_dir))


@query("cover_frame", f"WITH {_FRAMES} SELECT meeting_id, frame_id FROM fr QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY CASE WHEN coalesce(relevance, 1) <= 0 THEN 1 ELSE 0 END, t, frame_id) = 1")
def _(spark, sf_dir):
    return library.cover_frame(_frames(spark, sf_dir))


_ENDS = "ends AS (SELECT meeting_id, max(end_ms) AS end_ms FROM turns GROUP BY 1)"


def _ends(t):
    return t.groupBy("meeting_id").agg(F.max("end_ms").alias("end_ms"))


on_turns("scene_spans", lambda t: moments.scene_spans(t.withColumn("t", F.col("start_ms")), _ends(t)), f""", {_ENDS},
c AS (SELECT meeting_id, start_ms AS t FROM turns WHERE start_ms > 0 UNION ALL SELECT meeting_id, 0 FROM ends),
b AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY meeting_id ORDER BY t) >= 4000, true) AS begins FROM c),
k AS (SELECT meeting_id, t, sum(begins::INT) OVER (PARTITION BY meeting_id ORDER BY t) AS cluster FROM b),
g AS (SELECT meeting_id, cluster, min(t) AS lo, max(t) AS hi FROM k GROUP BY 1, 2),
s AS (SELECT meeting_id, hi AS start_ms, coalesce(lead(lo) OVER (PARTITION BY meeting_id ORDER BY cluster), end_ms) AS end_ms FROM g JOIN ends USING (meeting_id))
SELECT * FROM s WHERE end_ms > start_ms""")

on_turns("adaptive_cuts", lambda t: moments.adaptive_cuts(t.select("meeting_id", F.col("start_ms").alias("t"), F.expr("(end_ms - start_ms) div 500").alias("score"))), """, s AS (SELECT meeting_id, start_ms AS t, (end_ms - start_ms) // 500 AS score, turn_id FROM turns),
p AS (SELECT a.meeting_id, a.t, a.score, a.turn_id, list_sort(list(b.score) FILTER (b.turn_id <> a.turn_id)) AS o FROM s a JOIN s b ON a.meeting_id = b.meeting_id AND b.t BETWEEN a.t - 30000 AND a.t + 30000 GROUP BY 1, 2, 3, 4),
q AS (SELECT *, coalesce(len(o), 0) AS n, greatest(0, 60 - coalesce(len(o), 0)) AS z FROM p),
r AS (SELECT *, CASE WHEN (n + z) // 2 < z THEN 0 ELSE coalesce(o[(n + z) // 2 - z + 1], 0) END AS median FROM q)
SELECT meeting_id, t, score, CAST(median AS BIGINT) AS median, score > 300 OR (score >= 40 AND score >= 4 * median) AS cut FROM r""")

on_turns("fallback_sampling", lambda t: moments.fallback_samples(_ends(t), t.filter("end_ms - start_ms > 450000").select("meeting_id", F.col("start_ms").alias("t"))), f""", {_ENDS},
s AS (SELECT meeting_id, unnest(range(least(90000, end_ms // 2), greatest(end_ms, least(90000, end_ms // 2) + 1), 180000)) AS t FROM ends WHERE end_ms > 0)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM turns x WHERE x.end_ms - x.start_ms > 450000 AND x.meeting_id = s.meeting_id AND abs(x.start_ms - s.t) < 30000)""")


@query("hamming_neardup", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
p AS (SELECT x.vec_id AS frame_id, len(list_filter(range(1, 65), lambda i: x.b[i] <> y.b[i])) AS bits FROM e x JOIN e y ON x.vec_id <> y.vec_id)
SELECT frame_id, count(*) AS n_near, CAST(min(bits) AS INT) AS least_bits FROM p WHERE bits <= 20 GROUP BY 1""")
def _(spark, sf_dir):
    bits = [F.when(F.col("embedding")[i] > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    hash_ = bits[0]
    for b in bits[1:]:
        hash_ = hash_.bitwiseOR(b)
    return moments.hamming_neardup(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), hash_.alias("phash")), 20)


on_lines("greedy_windows", moments.greedy_windows, window_ms=60_000, most=400)
on_turns("dedupe_close", lambda t: moments.dedupe_close(t.select("meeting_id", F.col("start_ms").alias("t"))))


@query("rate_limit")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return moments.rate_limit(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("hit_id"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("at")), 86_400, 3)


@query("upsert_merge", """SELECT coalesce(n.l_orderkey, o.o_orderkey) AS id, CASE WHEN n.l_orderkey IS NOT NULL THEN n.q ELSE o.v END AS v, coalesce(o.first, n.l_orderkey) AS first
FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS v, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS first FROM orders) o
FULL JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) n ON o.o_orderkey = n.l_orderkey""")
def _(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("long").alias("v"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("first"))
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("v")).withColumn("first", F.col("id"))
    return writes.upsert(old, new, ["id"], fill=["first"])


_OLD = "SELECT event_id AS id, CAST(event_type AS VARCHAR) AS kind FROM events WHERE value < 300"
_NEW = "SELECT event_id AS id, CASE WHEN value < 50 THEN 'low' ELSE event_type END AS kind FROM events WHERE value > 20"


@query("snapshot_diff", f"""SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.kind <> n.kind""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    return writes.snapshot_diff(e.filter("value < 300").drop("value"), e.filter("value > 20").withColumn("kind", F.when(F.col("value") < 50, "low").otherwise(F.col("kind"))).drop("value"), "id")


_SEG_OLD = "SELECT turn_id AS segment_id, speaker, start_ms, end_ms, CAST(turn_id % 3 AS VARCHAR) AS sha, ['done', 'submitted', 'failed', 'pending'][CAST(turn_id % 4 AS INT) + 1] AS status FROM turns WHERE end_ms - start_ms < 200000"
_SEG_NEW = "SELECT 1000000 + turn_id AS segment_id, speaker, start_ms, end_ms, CAST(turn_id % 3 AS VARCHAR) AS sha FROM turns WHERE end_ms - start_ms > 20000"


@query("reconcile_segments", f"""WITH {TURNS_SQL}, o AS ({_SEG_OLD} QUALIFY row_number() OVER (PARTITION BY speaker, start_ms, end_ms, turn_id % 3 ORDER BY turn_id DESC) = 1), n AS ({_SEG_NEW})
SELECT coalesce(n.segment_id, o.segment_id) AS segment_id, CASE WHEN n.segment_id IS NULL THEN 'stale' WHEN o.segment_id IS NULL THEN 'pending' WHEN status = 'done' THEN 'kept' WHEN status = 'submitted' THEN 'in flight' WHEN status = 'failed' THEN 'retry' ELSE 'pending' END AS verdict
FROM o FULL JOIN n ON o.speaker = n.speaker AND o.start_ms = n.start_ms AND o.end_ms = n.end_ms AND o.sha = n.sha""")
def _(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("sha", (F.col("turn_id") % 3).cast("string"))
    status = F.element_at(F.array(*map(F.lit, ("done", "submitted", "failed", "pending"))), (F.col("turn_id") % 4 + 1).cast("int"))
    old = t.filter("end_ms - start_ms < 200000").select(F.col("turn_id").alias("segment_id"), "speaker", "start_ms", "end_ms", "sha", status.alias("status"), F.lit("j").alias("job"))
    new = t.filter("end_ms - start_ms > 20000").select((F.col("turn_id") + 1_000_000).alias("segment_id"), "speaker", "start_ms", "end_ms", "sha")
    return writes.reconcile(old, new)


@query("cascade_delete", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return writes.cascade_delete({"lines": table(spark, sf_dir, "lineitem")}, gone, "l_orderkey")["lines"].select("l_orderkey", "l_linenumber", "l_suppkey")


from parley import audio, queries  # noqa: E402, F401  registers the other queries
