"""Registered queries of column functions, logs, answers of services, filters and providers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import enrich, paths, registry, text
from lumenreel.operators import embedding, filters, intervals, segments, sync, vector
from lumenreel.plans.base import Tables, query, r6
from lumenreel.sources import files

# --- paths and times --------------------------------------------------------------------------------------------

query("last_component", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")(lambda t: t.pages.select("page_id", paths.last_component(F.col("url")).alias("name")))
MEDIA = "CASE page_id % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mov' WHEN 2 THEN '.txt' ELSE '' END"


def media(column: str = "url") -> Column:
    """A page's url with an extension that its id says."""
    i = F.col("page_id") % 4
    return F.concat(F.col(column), F.when(i == 0, ".MP4").when(i == 1, ".mov").when(i == 2, ".txt").otherwise(""))


query("is_video", f"SELECT page_id, regexp_matches(lower(regexp_extract(url || {MEDIA}, '([^/]*)$', 1)), '\\.(mp4|mov|mkv|avi|mxf|webm|m4v|ts|mts)$') AS video FROM pages")(lambda t: t.pages.select("page_id", paths.is_video(media()).alias("video")))
SITE = "regexp_extract(url, '^(https?://[^/]+)', 1)"
query("under_mount", f"SELECT page_id, starts_with(url, (SELECT min({SITE}) FROM pages) || '/') OR url = (SELECT min({SITE}) FROM pages) AS under FROM pages")(
    lambda t: t.pages.select("page_id", paths.under(F.col("url"), F.lit(t.pages.agg(F.min(F.regexp_extract("url", "^(https?://[^/]+)", 1))).first()[0])).alias("under"))
)
VOLUME = "CASE WHEN page_id % 3 = 0 THEN '/Volumes/disk ' || (page_id % 5) || '/a/' ELSE '/home/' END || page_id"


def volume_path() -> Column:
    i = F.col("page_id")
    return F.concat(F.when(i % 3 == 0, F.concat(F.lit("/Volumes/disk "), i % 5, F.lit("/a/"))).otherwise("/home/"), i)


query("mount_point", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/Volumes/disk ' || (page_id % 5) ELSE '/' END AS mount, CASE WHEN page_id % 3 = 0 THEN '/Volumes/new/a/' || page_id ELSE '/Volumes/new' || {VOLUME} END AS moved FROM pages")(
    lambda t: t.pages.select("page_id", paths.mount_point(volume_path()).alias("mount"), paths.remounted(volume_path(), F.lit("/Volumes/new")).alias("moved"))
)
query("srt_paths", "SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') || '.srt' AS \"primary\", '/srt/' || md5(url) || '.srt' AS fallback FROM pages")(
    lambda t: t.pages.select("page_id", files.srt_paths(F.col("url"), F.md5(F.encode("url", "utf-8")), "/srt").alias("p")).select("page_id", "p.primary", "p.fallback")
)
query("utc_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")(
    lambda t: t.events.select("event_id", text.utc_text(F.col("ts")).alias("at")).select("event_id", "at", F.unix_timestamp(text.utc_time(F.col("at"))).alias("seconds"))
)

# --- logs and frames --------------------------------------------------------------------------------------------

LINES = "'x pts_time:' || o_orderkey || '.25 y' || chr(10) || 'pts_time: ' || o_custkey || ' z' || chr(10) || 'Duration: 0' || (o_orderkey % 9) || ':1' || (o_orderkey % 7) || ':0' || (o_custkey % 8) || '.50, bitrate'"


def log_text() -> Column:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return F.concat(F.lit("x pts_time:"), k, F.lit(".25 y\npts_time: "), c, F.lit(" z\nDuration: 0"), k % 9, F.lit(":1"), k % 7, F.lit(":0"), c % 8, F.lit(".50, bitrate"))


query("log_parse", "SELECT o_orderkey, least(o_orderkey + 0.25, o_custkey)::DOUBLE AS first, greatest(o_orderkey + 0.25, o_custkey)::DOUBLE AS last, ((o_orderkey % 9) * 3600 + (10 + o_orderkey % 7) * 60 + o_custkey % 8 + 0.5)::DOUBLE AS duration FROM orders")(
    lambda t: t.orders.select("o_orderkey", files.log_cuts(log_text()).alias("c"), files.log_duration(log_text()).alias("duration")).select("o_orderkey", F.get("c", 0).alias("first"), F.get("c", 1).alias("last"), "duration")
)
SAYS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Output file does not contain any stream' WHEN '2-HIGH' THEN 'x DOES NOT contain any audio stream' WHEN '3-MEDIUM' THEN 'Stream map ''0:a'' matches no streams' WHEN '5-LOW' THEN 'Stream map ok' ELSE o_orderpriority END"


@query("no_audio", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS silent FROM orders")
def no_audio(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    says = F.when(p == "1-URGENT", "Output file does not contain any stream").when(p == "2-HIGH", "x DOES NOT contain any audio stream").when(p == "3-MEDIUM", "Stream map '0:a' matches no streams").when(p == "5-LOW", "Stream map ok").otherwise(p)
    return t.orders.select("o_orderkey", files.no_audio(says).alias("silent"))


FRAME = "'/t/scene_' || lpad((l_orderkey % 50)::VARCHAR, 3, '0') || '_frame_' || lpad(l_linenumber::VARCHAR, 2, '0') || CASE WHEN l_partkey % 5 = 0 THEN '.png' ELSE '.jpg' END"


@query("frame_groups", f"SELECT scene, string_agg(path, '|' ORDER BY path) AS frames FROM (SELECT DISTINCT (l_orderkey % 50)::INTEGER AS scene, {FRAME} AS path FROM lineitem WHERE l_partkey % 5 <> 0) GROUP BY scene")
def frame_groups(t: Tables) -> DataFrame:
    name = F.concat(F.lit("/t/scene_"), F.lpad((F.col("l_orderkey") % 50).cast("string"), 3, "0"), F.lit("_frame_"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.when(F.col("l_partkey") % 5 == 0, ".png").otherwise(".jpg"))
    return files.frame_groups(t.lineitem.select(name.alias("path")).distinct()).select("scene", F.array_join("frames", "|").alias("frames"))


# --- answers of services ----------------------------------------------------------------------------------------


@query("api_response", "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS said, CASE WHEN doc_id % 9 = 0 THEN source END AS error FROM documents")
def api_response(t: Tables) -> DataFrame:
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct("text")).alias("parts")).alias("content"))).alias("candidates")))
    failed = F.to_json(F.struct(F.struct(F.col("source").alias("message")).alias("error")))
    body = t.documents.select("doc_id", F.when(F.col("doc_id") % 9 == 0, failed).otherwise(said).alias("body"))
    return body.select("doc_id", text.response_text(F.col("body")).alias("said"), text.response_error(F.col("body")).alias("error"))


@query("embedding_response", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS one, round(2 * list_sum(embedding::DOUBLE[]), 4) AS two FROM embeddings")
def embedding_response(t: Tables) -> DataFrame:
    values = F.struct(F.col("embedding").alias("values"))
    both = t.embeddings.select("vec_id", F.to_json(F.struct(values.alias("embedding"))).alias("one"), F.to_json(F.struct(F.array(values, values).alias("embeddings"))).alias("two"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return both.select("vec_id", F.round(total(text.embedding_values(F.col("one"))), 4).alias("one"), F.round(total(F.flatten(text.embeddings_values(F.col("two")))), 4).alias("two"))


query("blob_round_trip", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, 4 * len(embedding) AS bytes FROM embeddings")(
    lambda t: t.embeddings.select("vec_id", vector.to_blob("embedding").alias("b")).select("vec_id", r6(F.aggregate(vector.from_blob("b"), F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"), F.octet_length("b").cast("long").alias("bytes"))
)
query("key_shape", "SELECT event_id, length(trim(k)) >= 10 AS ok FROM (SELECT event_id, '  ' || repeat('k', (event_id % 13)::INTEGER) || event_type || ' ' AS k FROM events)")(
    lambda t: t.events.select("event_id", text.is_key(F.concat(F.lit("  "), F.repeat(F.lit("k"), (F.col("event_id") % 13).cast("int")), F.col("event_type"), F.lit(" "))).alias("ok"))
)

# --- what detectors report --------------------------------------------------------------------------------------

LINE = "SELECT l_orderkey, l_linenumber, "


@query("max_face_area", LINE + "greatest(l_discount * l_tax, l_tax * l_tax) AS area FROM lineitem")
def max_face_area(t: Tables) -> DataFrame:
    face = lambda w, h: F.struct(F.col(w).alias("width"), F.col(h).alias("height"))
    return t.lineitem.select("l_orderkey", "l_linenumber", enrich.max_face_area(F.array(face("l_discount", "l_tax"), face("l_tax", "l_tax"))).alias("area"))


query("luminance", LINE + "round(0.2126::DOUBLE * (l_orderkey % 256) + 0.7152::DOUBLE * (l_partkey % 256) + 0.0722::DOUBLE * (l_suppkey % 256), 6) AS light FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", r6(enrich.luminance(F.col("l_orderkey") % 256, F.col("l_partkey") % 256, F.col("l_suppkey") % 256)).alias("light"))
)
query("palette", "SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS palette FROM (SELECT p_partkey, w, min(i) AS i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY ALL) GROUP BY p_partkey")(
    lambda t: t.part.select("p_partkey", enrich.palette(F.split("p_name", " ")).alias("palette"))
)
query("subjects", "SELECT event_id, CASE greatest(f, h) WHEN 0 THEN '' WHEN 1 THEN 'person' ELSE greatest(f, h) || ' people' END AS subjects FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 3 END AS f, user_id % 4 AS h FROM events)")(
    lambda t: t.events.select("event_id", F.array_join(enrich.subjects(F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 3).cast("int")), (F.col("user_id") % 4).cast("int")), "|").alias("subjects"))
)


@query("scene_and_objects", """WITH x AS (SELECT p_partkey, replace(p_brand, '#', '_') AS n, (p_size % 10) / 10.0::DOUBLE AS c FROM part UNION ALL SELECT p_partkey, 'sky_' || p_size, 0.35::DOUBLE FROM part UNION ALL SELECT p_partkey, 'low', 0.05::DOUBLE FROM part),
k AS (SELECT p_partkey, replace(n, '_', ' ') AS n, row_number() OVER (PARTITION BY p_partkey ORDER BY c DESC, n) AS r FROM x WHERE c >= 0.1)
SELECT p_partkey, max(n) FILTER (WHERE r = 1) AS scene, coalesce(string_agg(n, '|' ORDER BY r) FILTER (WHERE r > 1), '') AS objects FROM k GROUP BY p_partkey""")
def scene_and_objects(t: Tables) -> DataFrame:
    label = lambda n, c: F.struct(n.alias("identifier"), c.cast("double").alias("confidence"))
    labels = F.array(label(F.replace("p_brand", F.lit("#"), F.lit("_")), F.col("p_size") % 10 / 10.0), label(F.concat(F.lit("sky_"), "p_size"), F.lit(0.35)), label(F.lit("low"), F.lit(0.05)))
    return t.part.select("p_partkey", enrich.scene_and_objects(labels).alias("x")).select("p_partkey", "x.scene", F.array_join("x.objects", "|").alias("objects"))


NAMED = "CASE event_id % 8 WHEN 0 THEN 'red' WHEN 1 THEN 'orange' WHEN 2 THEN 'yellow' WHEN 3 THEN 'green' WHEN 4 THEN 'blue' WHEN 5 THEN 'purple' WHEN 6 THEN 'gray' END"
NUMBER = "CASE event_id % 8 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 1 END"


def color_name() -> Column:
    names = F.array(*map(F.lit, ("red", "orange", "yellow", "green", "blue", "purple", "gray")))
    return F.get(names, (F.col("event_id") % 8).cast("int"))


query("finder_tags", f"SELECT event_id, array_to_string(list_filter([event_type, CASE WHEN event_id % 2 = 0 THEN 'Red' ELSE 'mine' END], lambda x: x <> 'Red') || CASE WHEN c IS NULL THEN [] ELSE [upper(c[1]) || substr(c, 2) || chr(10) || n] END, '|') AS tags FROM (SELECT *, {NAMED} AS c, {NUMBER} AS n FROM events)")(
    lambda t: t.events.select("event_id", F.array_join(enrich.finder_tags(F.array(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "Red").otherwise("mine")), color_name()), "|").alias("tags"))
)
query("color_labels", f"SELECT event_id, {NAMED} AS color FROM events")(lambda t: t.events.select("event_id", enrich.color_or_null(F.coalesce(color_name(), F.lit("mauve"))).alias("color")))
query("status_order", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 4 ELSE -1 END::INTEGER AS place FROM orders")(
    lambda t: t.orders.select("o_orderkey", enrich.status_order(F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")).alias("place"))
)


@query("concurrency", """WITH x AS (SELECT event_id, 1 + event_id % 16 AS cores, CASE WHEN event_id % 7 = 0 THEN 'background' ELSE CASE event_id % 3 WHEN 0 THEN 'full_speed' WHEN 1 THEN 'balanced' ELSE 'background' END END AS mode, event_id % 4 AS heat, 300 + user_id % 5 * 300 AS mb FROM events),
b AS (SELECT *, CASE mode WHEN 'full_speed' THEN greatest(2, cores - 2) WHEN 'balanced' THEN greatest(1, cores // 2) ELSE greatest(1, cores // 4) END AS n FROM x),
w AS (SELECT *, CASE heat WHEN 0 THEN n WHEN 1 THEN greatest(1, n * 3 // 4) WHEN 2 THEN greatest(1, n // 2) ELSE 1 END AS m FROM b)
SELECT event_id, (CASE WHEN mb < 512 THEN 1 WHEN mb < 1024 THEN greatest(1, m // 2) ELSE m END)::INTEGER AS jobs FROM w""")
def concurrency(t: Tables) -> DataFrame:
    i = F.col("event_id")
    mode = F.when(i % 3 == 0, "full_speed").when(i % 3 == 1, "balanced").otherwise("background")
    heat = F.get(F.array(*map(F.lit, ("nominal", "fair", "serious", "critical"))), (i % 4).cast("int"))
    return t.events.select("event_id", enrich.concurrency((1 + i % 16).cast("int"), mode, i % 7 == 0, heat, 300 + F.col("user_id") % 5 * 300).alias("jobs"))


# --- texts ------------------------------------------------------------------------------------------------------

query("spoken", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ' said' END AS said FROM events")(
    lambda t: t.events.select("event_id", text.spoken(F.concat(F.lit("<|en|> "), F.when(F.col("event_id") % 4 == 0, "... !").otherwise(F.concat("event_type", F.lit(" said"))), F.lit("<|0.40|> "))).alias("said"))
)


@query("renumbered", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS idx FROM conversations WHERE turn % 3 <> 1 AND regexp_matches(text, '\\S')")
def renumbered(t: Tables) -> DataFrame:
    said = t.conversations.withColumn("text", F.when(F.col("turn") % 3 == 1, " \n ").otherwise(F.col("text")))
    return intervals.renumbered(said, "conv_id", "turn").select("conv_id", "turn", "idx")


@query("timed_runs", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS idx FROM conversations WHERE turn % 4 NOT IN (1, 2) AND regexp_matches(text, '\\S')")
def timed_runs(t: Tables) -> DataFrame:
    k = F.col("turn")
    rows = t.conversations.select("conv_id", "turn", "text", k.cast("double").alias("start"), F.when(k % 4 == 1, k - 1.0).when(k % 4 == 2, F.lit(float("nan"))).otherwise(k + 0.5).alias("end"))
    return intervals.timed_runs(rows, "conv_id").select("conv_id", "turn", "idx")


@query("tags_or_composed", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE p_type || '|' || p_brand END AS tags FROM part")
def tags_or_composed(t: Tables) -> DataFrame:
    tags = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("own"))).when(F.col("p_partkey") % 4 == 1, F.array().cast("array<string>"))
    return t.part.select("p_partkey", F.array_join(text.tags_or_composed(tags, {"scene": F.col("p_type"), "mood": F.col("p_brand")}), "|").alias("tags"))


SET = "array_to_string(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains([split_part(p_name, ' ', 1), p_brand], x)), '|')"
query("tags_removed", f"SELECT p_partkey, nullif({SET}, '') AS tags FROM part")(lambda t: t.part.select("p_partkey", F.array_join(sync.tags_removed(F.split("p_name", " "), F.array(F.get(F.split("p_name", " "), 0), F.col("p_brand"))), "|").alias("tags")))
query("tags_added", "SELECT p_partkey, string_agg(w, '|' ORDER BY i) AS tags FROM (SELECT p_partkey, w, min(i) AS i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ') || [trim(p_brand)]) AS w, generate_subscripts(string_split(p_name, ' ') || [p_brand], 1) AS i FROM part) GROUP BY ALL) GROUP BY p_partkey")(
    lambda t: t.part.select("p_partkey", F.array_join(sync.tags_added(F.split("p_name", " "), F.array(F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.lit("  "))), "|").alias("tags"))
)
query("tags_replaced", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS tags FROM part")(lambda t: t.part.select("p_partkey", F.array_join(sync.clean_tags(F.array(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(" "), "p_brand")).otherwise("  "))), "|").alias("tags")))
query("sample_frames", "SELECT event_id, greatest(1, least(3, (event_id % 40) // 5))::INTEGER AS n FROM events")(lambda t: t.events.select("event_id", F.size(segments.frame_times(F.lit(0.0), (F.col("event_id") % 40).cast("double"))).alias("n")))

# --- filters, options, providers, the field registry ------------------------------------------------------------


@query("lookup_by_path", "SELECT page_id, url FROM pages WHERE url = (SELECT max(url) FROM pages) ORDER BY page_id LIMIT 1")
def lookup_by_path(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", "url").orderBy("page_id").dropDuplicates(["url"])
    first = t.pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return filters.lookup(first.select("page_id", "url"), "url", rows.agg(F.max("url")).first()[0])


query("ordered_scan", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")(lambda t: filters.ordered(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate"))
query("status_filter", "SELECT o_orderkey, o_orderstatus = 'P' AS stuck FROM orders WHERE o_orderstatus <> 'F'")(
    lambda t: filters.with_status(t.orders, "F", column="o_orderstatus", other=True).select("o_orderkey", F.lit(False).alias("s")).join(filters.with_status(t.orders, "P", column="o_orderstatus").select("o_orderkey", F.lit(True).alias("p")), "o_orderkey", "left").select("o_orderkey", F.coalesce("p", "s").alias("stuck"))
)
query("union_ids", "SELECT doc_id AS clip_id FROM documents UNION SELECT vec_id FROM embeddings UNION SELECT page_id FROM pages")(
    lambda t: filters.union_ids(t.documents.select(F.col("doc_id").alias("clip_id")), t.embeddings.select(F.col("vec_id").alias("clip_id")), t.pages.select(F.col("page_id").alias("clip_id")))
)


@query("filter_introspection", "SELECT * FROM (VALUES (0, 0, true), (1, 1, false), (2, 4, false), (3, 1, false)) v(i, active, is_empty)")
def filter_introspection(t: Tables) -> DataFrame:
    made = [filters.ResultFilter(0), filters.ResultFilter(3), filters.ResultFilter(1, frozenset({"red"}), frozenset({"wide"}), frozenset({"calm"})), filters.ResultFilter(moods=frozenset({"x"}))]
    return t.spark.createDataFrame([(i, f.active, f.is_empty) for i, f in enumerate(made)], "i int, active int, is_empty boolean")


query("index_options", "SELECT event_id, event_id % 2 = 0 AS skip_stt, 'balanced' AS performance_mode, CASE WHEN event_id % 3 = 0 THEN 7 ELSE 30 END::INTEGER AS days FROM events")(
    lambda t: t.events.select("event_id", registry.options(F.when(F.col("event_id") % 6 == 5, F.lit(None).cast("string")).otherwise(F.concat(F.lit('{"skip_stt": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.when(F.col("event_id") % 3 == 0, ', "orphaned_retention_days": 7}').otherwise("}")))).alias("o")).select("event_id", "o.skip_stt", "o.performance_mode", F.col("o.orphaned_retention_days").alias("days"))
)


@query("fill_embeddings", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'hashing-64' WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 'hashing-64' END AS embedding_model, doc_id % 3 = 0 AND doc_id % 2 = 0 AS kept FROM documents")
def fill_embeddings(t: Tables) -> DataFrame:
    old = F.array(F.lit(1.0).cast("float"))
    held = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, old).alias("embedding"), F.when(F.col("doc_id") % 2 == 0, "hashing-64").otherwise("other").alias("embedding_model"))
    out = embedding.fill_embeddings(held, embedding.HashingProvider(64), F.col("text"))
    return out.select("doc_id", "embedding_model", F.coalesce(F.size("embedding") == 1, F.lit(False)).alias("kept"))


@query("field_registry", "SELECT * FROM (VALUES ('actions', true), ('colors', false), ('description', false), ('lighting', false), ('mood', false), ('objects', true), ('scene', false), ('shot_type', false), ('subjects', true)) v(name, is_array)")
def field_registry(t: Tables) -> DataFrame:
    kinds = registry.response_schema()["properties"]
    return t.spark.createDataFrame([(n, kinds[n]["type"] == "ARRAY") for n in registry.columns()], "name string, is_array boolean")


@query("generated_code", "SELECT 'UPDATE clips SET scene = ?, subjects = ?, actions = ?, objects = ?, mood = ?, shot_type = ?, lighting = ?, colors = ?, description = ?, tags = ? WHERE clip_id = ?' AS update_sql, 'scene string, subjects array<string>, actions array<string>, objects array<string>, mood string, shot_type string, lighting string, colors string, description string' AS record")
def generated_code(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(registry.update_sql("clips", "clip_id"), registry.record_type())], "update_sql string, record string")
