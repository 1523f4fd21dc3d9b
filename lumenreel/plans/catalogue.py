"""The registered queries of the core engine and their SQL, over the driver's tables.

Documents stand for clips, sources for folders, labels for ratings and colours, page urls for paths, events for
changes and cuts, conversations for transcripts, orders for rows to synchronise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import enrich, paths, text
from lumenreel.operators import embedding, facets, filters, fts, hierarchy, intervals, lifecycle, search, segments, sync, vector
from lumenreel.plans.base import HOURS, QUERIES, SQL, Tables, hours, query, r6
from lumenreel.sources import files, text_index
from lumenreel.streaming import events as ev

#: The query of the text and hybrid searches, and the number of results.
TERMS, K = "mit OR sur", 20


# --- full-text search -------------------------------------------------------------------------------------------


def bm25_sql(tokens: str, id_column: str, length: str, counts: list[str], total: str, limit: int = K) -> str:
    """BM25 in SQL: `tokens` yields the arrays, counts are the phrases' occurrences, total combines s0, s1, ..."""
    f = ", ".join(f"({c})::DOUBLE AS f{i}" for i, c in enumerate(counts))
    n = ", ".join(f"count(*) FILTER (WHERE f{i} > 0)::DOUBLE AS n{i}" for i in range(len(counts)))
    idf = "(CASE WHEN ln((nn - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) > 0 THEN ln((nn - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)"
    s = ", ".join(f"CASE WHEN f{i} > 0 THEN {idf.format(i=i)} * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) END AS s{i}" for i in range(len(counts)))
    return f"""WITH t AS ({tokens}), f AS (SELECT {id_column}, ({length})::DOUBLE AS dl, {f} FROM t),
g AS (SELECT count(*)::DOUBLE AS nn, avg(dl) AS avgdl, {n} FROM f), s AS (SELECT {id_column}, {s} FROM f, g)
SELECT {id_column}, round(-({total}), 6) AS rank FROM s WHERE ({total}) IS NOT NULL ORDER BY -({total}), {id_column} LIMIT {limit}"""


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({column}, ''))), '[\\p{{L}}\\p{{N}}]+')"


DOC_TOKENS = f"SELECT doc_id, {tokens_sql('text')} AS w FROM documents"


def one_sql(term: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{term}'))"


def fts_query(name: str, text_query: str, counts: list[str], total: str) -> None:
    @query(name, bm25_sql(DOC_TOKENS, "doc_id", "len(w)", counts, total))
    def run(t: Tables) -> DataFrame:
        return fts.search(t.documents, text_query, "doc_id", ("text",), K).select("doc_id", r6("rank").alias("rank"))


fts_query("fts_single", "mit", [one_sql("mit")], "s0")
fts_query("fts_and", "para que", [one_sql("para"), one_sql("que")], "s0 + s1")
fts_query("fts_or", "mit OR sur", [one_sql("mit"), one_sql("sur")], "coalesce(s0 + s1, s0, s1)")
fts_query("fts_not", "sur NOT avec", [one_sql("sur"), one_sql("avec")], "CASE WHEN s1 IS NULL THEN s0 END")
fts_query("fts_phrase", '"de la"', ["len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'de' AND w[i + 1] = 'la'))"], "s0")
fts_query("fts_prefix", "ung*", ["len(list_filter(w, lambda x: starts_with(x, 'ung')))"], "s0")
fts_query("fts_nested", 'mit OR (sur AND "de la") NOT avec', [one_sql("mit"), one_sql("sur"), "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'de' AND w[i + 1] = 'la'))", one_sql("avec")], "coalesce(s0 + (CASE WHEN s3 IS NULL THEN s1 + s2 END), s0, CASE WHEN s3 IS NULL THEN s1 + s2 END)")


fts_query("fts_accents", "à OR FÜR OR étude*", [one_sql("a"), one_sql("fur"), "len(list_filter(w, lambda x: starts_with(x, 'etude')))"], "coalesce(s0, 0) + coalesce(s1, 0) + coalesce(s2, 0) + CASE WHEN s0 IS NULL AND s1 IS NULL AND s2 IS NULL THEN NULL ELSE 0 END")
fts_query("fts_initial", "^le OR ^der", ["(len(w) > 0 AND w[1] = 'le')::INTEGER", "(len(w) > 0 AND w[1] = 'der')::INTEGER"], "coalesce(s0 + s1, s0, s1)")
fts_query("fts_plus", "de + la", ["len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'de' AND w[i + 1] = 'la'))"], "s0")
TURNS = f"SELECT conv_id * 1000 + turn AS id, {tokens_sql('role')} AS r, {tokens_sql('text')} AS w FROM conversations"


def turn_query(name: str, text_query: str, counts: list[str], total: str) -> None:
    @query(name, bm25_sql(TURNS, "id", "len(r) + len(w)", counts, total))
    def run(t: Tables) -> DataFrame:
        rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
        return fts.search(rows, text_query, "id", ("role", "text"), K).select("id", r6("rank").alias("rank"))


turn_query("fts_column", "text:mit role:assistant", [one_sql("mit"), "len(list_filter(r, lambda x: x = 'assistant'))"], "s0 + s1")
turn_query("fts_column_set", "{role text}: mit", ["len(list_filter(w, lambda x: x = 'mit')) + len(list_filter(r, lambda x: x = 'mit'))"], "s0")
turn_query("fts_column_other", "- role: (user OR mit)", ["len(list_filter(w, lambda x: x = 'user'))", one_sql("mit")], "coalesce(s0 + s1, s0, s1)")


@query("fts_index_search", SQL["fts_nested"])
def fts_index_search(t: Tables) -> DataFrame:
    index = fts.postings(t.documents, "doc_id", ("text",))
    found = fts.index_search(index, fts.doc_stats(t.documents, ("text",)), 'mit OR (sur AND "de la") NOT avec', "doc_id", ("text",), K)
    return found.select("doc_id", r6("rank").alias("rank"))


@query("fts_postings", f"SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits FROM (SELECT doc_id, unnest(w) AS term FROM ({DOC_TOKENS})) GROUP BY term")
def fts_postings(t: Tables) -> DataFrame:
    index = fts.postings(t.documents, "doc_id", ("text",))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("positions")).alias("n_hits"))


def stored_index(t: Tables, name: str) -> text_index.TextIndex:
    return text_index.TextIndex(t.spark, files.work_folder(t.spark, name), "doc_id", ("text",), "source")


@query("fts_stored", SQL["fts_nested"])
def fts_stored(t: Tables) -> DataFrame:
    index = stored_index(t, "fts-stored")
    index.build(t.documents)
    return index.search('mit OR (sur AND "de la") NOT avec', K).select("doc_id", r6("rank").alias("rank"))


@query("fts_maintained", bm25_sql(f"SELECT doc_id, {tokens_sql('text')} AS w FROM documents WHERE source <> 'src4'", "doc_id", "len(w)", [one_sql("mit"), one_sql("sur")], "coalesce(s0 + s1, s0, s1)"))
def fts_maintained(t: Tables) -> DataFrame:
    # other texts first, then all the true ones in their place; one folder is forgotten, another indexed anew
    index = stored_index(t, "fts-maintained")
    index.build(t.documents.withColumn("text", F.lit("mit sur")))
    index.upsert(t.documents)
    index.delete_folder("src4")
    index.rebuild_folder("src5", t.documents.filter("source = 'src5'"))
    index.compacted()
    index.discard()
    return index.search(TERMS, K).select("doc_id", r6("rank").alias("rank"))


@query("fts_blank", "SELECT doc_id, 0.0::DOUBLE AS rank FROM documents WHERE false")
def fts_blank(t: Tables) -> DataFrame:
    return fts.search(t.documents, "  \n ", "doc_id", ("text",), K)


# --- vectors and hybrid search ----------------------------------------------------------------------------------

QV = "(SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]"
SIM = f"coalesce(list_cosine_similarity(embedding::DOUBLE[], {QV}), 0)"


def query_vector(t: Tables) -> list[float]:
    return t.embeddings.filter("vec_id = 0").select("embedding").first()[0]


def similar(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", r6("similarity").alias("similarity"))


@query("vector_topk", f"SELECT vec_id, round({SIM}, 6) AS similarity FROM embeddings ORDER BY {SIM} DESC, vec_id LIMIT {K}")
def vector_topk(t: Tables) -> DataFrame:
    return similar(vector.top_k(t.embeddings, query_vector(t), K, "vec_id"))


@query("vector_topk_native", SQL["vector_topk"])
def vector_topk_native(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(x) for x in query_vector(t)])
    scored = t.embeddings.select("vec_id", vector.cosine(F.col("embedding"), q).alias("similarity"))
    return similar(scored.orderBy(F.desc("similarity"), "vec_id").limit(K))


@query("vector_topk_allowed", f"SELECT vec_id, round({SIM}, 6) AS similarity FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'fr' ORDER BY {SIM} DESC, vec_id LIMIT {K}")
def vector_topk_allowed(t: Tables) -> DataFrame:
    ids = t.documents.filter("lang = 'fr'").select(F.col("doc_id").alias("vec_id"))
    return similar(vector.top_k(vector.allowed(t.embeddings, ids, "vec_id"), query_vector(t), K, "vec_id", keep_unusable=False))


@query("vector_by_model", f"SELECT vec_id, round({SIM}, 6) AS similarity FROM embeddings WHERE label = 3 ORDER BY {SIM} DESC, vec_id LIMIT {K}")
def vector_by_model(t: Tables) -> DataFrame:
    return similar(vector.top_k(t.embeddings.filter("label = 3"), query_vector(t), K, "vec_id"))


@query("vector_store_load", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings WHERE len(embedding) = 64 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0")
def vector_store_load(t: Tables) -> DataFrame:
    return vector.loaded(t.embeddings, 64).select("vec_id", r6("norm").alias("norm"))


@query("vector_upsert", "WITH n AS (SELECT vec_id + 10 AS vec_id, list_reverse(embedding) AS embedding FROM embeddings), u AS (SELECT vec_id, embedding FROM embeddings ANTI JOIN n USING (vec_id) UNION ALL FROM n) SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM u WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def vector_upsert(t: Tables) -> DataFrame:
    old = t.embeddings.select("vec_id", "embedding")
    new = old.select((F.col("vec_id") + 10).alias("vec_id"), F.reverse("embedding").alias("embedding"))
    gone = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    rows = vector.removed(vector.upserted(old, new.union(new), "vec_id"), gone, "vec_id")
    return rows.select("vec_id", r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"))


@query("embed_centroid", "SELECT label, i::INTEGER AS place, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def embed_centroid(t: Tables) -> DataFrame:
    means = vector.centroids(t.embeddings, "label")
    return means.select("label", F.posexplode("embedding").alias("p", "x")).select("label", (F.col("p") + 1).alias("place"), r6("x").alias("x"))


TEXTS = bm25_sql(DOC_TOKENS, "doc_id", "len(w)", [one_sql("mit"), one_sql("sur")], "coalesce(s0 + s1, s0, s1)", 2 * K).replace("round(-(coalesce(s0 + s1, s0, s1)), 6)", "-(coalesce(s0 + s1, s0, s1))")


def hybrid_sql(w_text: float, w_vector: float, where: str = "true") -> str:
    texts = TEXTS.replace(f"IS NOT NULL ORDER BY", f"IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE {where}) ORDER BY")
    vectors = f"SELECT vec_id AS doc_id, {SIM} AS similarity FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE {where}) ORDER BY similarity DESC, vec_id LIMIT {2 * K}"
    if where == "true":
        vectors = f"SELECT vec_id AS doc_id, {SIM} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT {2 * K}"
    return f"""WITH a AS (SELECT * FROM ({texts})), b AS ({vectors}),
an AS (SELECT doc_id, rank, CASE WHEN max(-rank) OVER () > min(-rank) OVER () THEN (-rank - min(-rank) OVER ()) / (max(-rank) OVER () - min(-rank) OVER ()) ELSE 0 END AS x FROM a),
bn AS (SELECT doc_id, similarity, CASE WHEN max(similarity) OVER () > min(similarity) OVER () THEN (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) ELSE 0 END AS y FROM b),
m AS (SELECT coalesce(an.doc_id, bn.doc_id) AS doc_id, rank, similarity, {w_text}::DOUBLE * coalesce(x, 0) + {w_vector}::DOUBLE * coalesce(y, 0) AS score FROM an FULL JOIN bn ON an.doc_id = bn.doc_id)
SELECT h.doc_id, lang, source, round(rank, 6) AS rank, round(similarity, 6) AS similarity, round(score, 6) AS score FROM (SELECT * FROM m ORDER BY score DESC, doc_id LIMIT {K}) h JOIN documents USING (doc_id)"""


def hybrid(t: Tables, text_query: str, mode: str, where: str | None = None) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    keep = t.documents.filter(where).select("doc_id") if where else None
    hits = search.hybrid_search(t.documents, vectors, text_query, query_vector(t), mode, K, "doc_id", ("text",), keep)
    out = search.hydrated(hits, t.documents.select("doc_id", "lang", "source"), None, "doc_id")
    return out.select("doc_id", "lang", "source", r6("rank").alias("rank"), r6("similarity").alias("similarity"), r6("score").alias("score"))


query("hybrid_search", hybrid_sql(0.4, 0.6))(lambda t: hybrid(t, TERMS, "hybrid"))
query("hybrid_exact", hybrid_sql(0.9, 0.1))(lambda t: hybrid(t, '"mit" OR sur', "auto"))
query("hybrid_semantic", hybrid_sql(0.2, 0.8))(lambda t: hybrid(t, "mit  OR  sur", "auto"))
query("hybrid_filtered", hybrid_sql(0.4, 0.6, "lang <> 'de'"))(lambda t: hybrid(t, TERMS, "hybrid", "lang <> 'de'"))


@query("minmax_normalize", "SELECT doc_id, round(CASE WHEN max(n_chars) OVER () > min(n_chars) OVER () THEN (n_chars - min(n_chars) OVER ())::DOUBLE / (max(n_chars) OVER () - min(n_chars) OVER ()) ELSE 0 END, 6) AS x FROM documents")
def minmax_normalize(t: Tables) -> DataFrame:
    return vector.minmax(t.documents.select("doc_id", "n_chars"), "n_chars", "x").select("doc_id", r6("x").alias("x"))


@query("resolve_weights", "SELECT doc_id, CASE WHEN NOT has THEN 1.0 WHEN contains(q, '\"') THEN 0.9 WHEN length(q) > 10 THEN 0.2 ELSE 0.4 END::DOUBLE AS fts, CASE WHEN NOT has THEN 0.0 WHEN contains(q, '\"') THEN 0.1 WHEN length(q) > 10 THEN 0.8 ELSE 0.6 END::DOUBLE AS vec FROM (SELECT doc_id, doc_id % 7 <> 0 AS has, CASE WHEN doc_id % 5 = 0 THEN '\"' ELSE '' END || substr(text, 1, (doc_id % 20)::INTEGER) AS q FROM documents)")
def resolve_weights(t: Tables) -> DataFrame:
    q = F.concat(F.when(F.col("doc_id") % 5 == 0, '"').otherwise(""), F.substr("text", F.lit(1), (F.col("doc_id") % 20).cast("int")))
    a, b = search.weight_columns(q, F.col("doc_id") % 7 != 0)
    return t.documents.select("doc_id", a.alias("fts"), b.alias("vec"))


# --- filters, facets, votes -------------------------------------------------------------------------------------

CLIPS = "(SELECT d.doc_id AS clip_id, d.source AS source_folder, d.lang AS shot_type, coalesce(l.quality, 0) * 3 AS rating, CASE l.toxic WHEN 1 THEN 'red' WHEN 0 THEN 'blue' END AS color_label, CASE WHEN d.doc_id % 3 = 0 THEN 'calm' WHEN d.doc_id % 3 = 1 THEN '' END AS mood, 0.0::DOUBLE AS start_time, d.n_chars::DOUBLE AS end_time, p.url AS file_path FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id)"


def clips(t: Tables) -> DataFrame:
    rows = t.documents.drop("text").join(t.labels, "doc_id", "left").join(t.pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("file_path")), "doc_id", "left")
    mood = F.when(F.col("doc_id") % 3 == 0, "calm").when(F.col("doc_id") % 3 == 1, "")
    color = F.when(F.col("toxic") == 1, "red").when(F.col("toxic") == 0, "blue")
    return rows.select(F.col("doc_id").alias("clip_id"), F.col("source").alias("source_folder"), F.col("lang").alias("shot_type"), (F.coalesce("quality", F.lit(0)) * 3).alias("rating"), color.alias("color_label"), mood.alias("mood"), F.lit(0.0).alias("start_time"), F.col("n_chars").cast("double").alias("end_time"), "file_path")


query("folder_filter", f"SELECT clip_id, source_folder FROM {CLIPS} WHERE source_folder IN ('src1', 'src7')")(lambda t: filters.folder_filter(clips(t), ["src7", "src1"]).select("clip_id", "source_folder"))
query("folder_filter_empty", f"SELECT clip_id, source_folder FROM {CLIPS} WHERE false")(lambda t: filters.folder_filter(clips(t), []).select("clip_id", "source_folder"))
query("path_prefix_filter", f"SELECT clip_id, file_path FROM {CLIPS} WHERE starts_with(file_path, (SELECT regexp_extract(min(url), '^(https?://[^/]+)', 1) FROM pages) || '/')")(
    lambda t: filters.prefix_filter(clips(t), t.pages.agg(F.regexp_extract(F.min("url"), "^(https?://[^/]+)", 1)).first()[0]).select("clip_id", "file_path")
)
query("post_filter", f"SELECT clip_id, rating, color_label, shot_type FROM {CLIPS} WHERE rating >= 3 AND color_label = 'red' AND shot_type IN ('en', 'fr')")(
    lambda t: filters.ResultFilter(3, frozenset({"red"}), frozenset({"en", "fr"})).apply(clips(t)).select("clip_id", "rating", "color_label", "shot_type")
)
query("sort_duration", f"SELECT clip_id, end_time FROM {CLIPS} ORDER BY end_time - start_time DESC, clip_id")(lambda t: filters.sorted_results(clips(t), "duration", False).select("clip_id", "end_time"))
query("sort_rating", f"SELECT clip_id, rating FROM {CLIPS} ORDER BY rating, clip_id")(lambda t: filters.sorted_results(clips(t), "rating").select("clip_id", "rating"))
query("facet_topn", f"SELECT shot_type AS value, count(*) AS n FROM {CLIPS} WHERE shot_type <> '' GROUP BY shot_type ORDER BY n DESC, value LIMIT 20")(lambda t: facets.facet(clips(t), "shot_type"))
query("facets_all", f"SELECT 'shot_type' AS dimension, shot_type AS value, count(*) AS n FROM {CLIPS} WHERE shot_type <> '' GROUP BY 2 UNION ALL SELECT 'mood', mood, count(*) FROM {CLIPS} WHERE mood <> '' GROUP BY 2 UNION ALL SELECT 'rating', rating::VARCHAR, count(*) FROM {CLIPS} WHERE rating > 0 GROUP BY 2 UNION ALL SELECT 'color_label', color_label, count(*) FROM {CLIPS} WHERE color_label IS NOT NULL GROUP BY 2")(lambda t: facets.all_facets(clips(t)))
query("folder_stats", "SELECT source AS source_folder, count(DISTINCT lang) AS n_videos, count(*) AS n_clips FROM documents GROUP BY source")(lambda t: facets.folder_stats(t.documents.withColumnRenamed("source", "source_folder"), video="lang"))
TAGS = "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(list_concat(string_split(p_name, ' '), [trim(p_type)]), lambda x: trim(x) <> ''))) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag"
query("popular_tags", f"{TAGS} LIMIT 30")(lambda t: facets.popular_tags(t.part, F.split("p_name", " "), F.array("p_type")))
query("tag_suggestions", f"SELECT * FROM ({TAGS} LIMIT 30) WHERE tag <> 'no such tag' ORDER BY n DESC, tag LIMIT 12")(lambda t: facets.tag_suggestions(facets.popular_tags(t.part, F.split("p_name", " "), F.array("p_type")), ["no such tag"]))
query("majority_vote", "WITH c AS (SELECT user_id, event_type, count(*) AS n, max(value) AS value FROM events GROUP BY ALL) SELECT user_id, event_type, value FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, value DESC, event_type DESC) = 1")(lambda t: facets.majority_vote(t.events, "user_id", "event_type", "value"))
query("most_frequent", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")(lambda t: facets.most_frequent(t.events, "user_id", "event_type"))
query("run_summary", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_ok, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_failed, sum(o_custkey)::BIGINT AS clips, sum(o_orderkey)::BIGINT AS analyzed FROM orders")(lambda t: facets.run_summary(t.orders.select((F.col("o_orderstatus") == "F").alias("ok"), F.col("o_custkey").alias("clips_created"), F.col("o_orderkey").alias("clips_analyzed"))))
query("recent_searches", "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 20")(lambda t: facets.recent(t.events, "event_id").select("event_id", "event_type", "user_id"))
query("clip_counts", "SELECT o_custkey AS video_id, count(*) AS n FROM orders GROUP BY 1")(lambda t: t.orders.groupBy(F.col("o_custkey").alias("video_id")).agg(F.count(F.lit(1)).alias("n")))
query("latest_label", "SELECT d.source, arg_max(l.toxic, doc_id) AS toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL GROUP BY d.source")(lambda t: sync.latest_color(t.documents.select("doc_id", "source").join(t.labels, "doc_id"), "source", "doc_id", "toxic"))

FRAMES = "(SELECT o_custkey AS clip_id, o_orderkey AS frame, o_orderstatus AS scene, o_orderpriority AS shot_type, o_orderstatus AS lighting, [o_orderpriority, o_orderstatus] AS subjects, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS colors FROM orders)"


@query("collapsed_frames", f"""WITH f AS (SELECT * FROM {FRAMES}),
sc AS (SELECT clip_id, scene, count(*) n FROM f GROUP BY clip_id, scene QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, scene) = 1),
sh AS (SELECT clip_id, shot_type, count(*) n FROM f GROUP BY clip_id, shot_type QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, shot_type) = 1),
u AS (SELECT clip_id, frame, generate_subscripts(subjects, 1) AS i, unnest(subjects) AS s FROM f),
d AS (SELECT clip_id, s, min((frame, i)) AS pos FROM u GROUP BY ALL),
l AS (SELECT clip_id, string_agg(s, '|' ORDER BY pos) AS subjects FROM d GROUP BY clip_id)
SELECT f.clip_id, any_value(sc.scene) AS scene, any_value(sh.shot_type) AS shot_type, any_value(sc.scene) AS lighting, any_value(l.subjects) AS subjects, arg_min(f.colors, f.frame) FILTER (WHERE f.colors IS NOT NULL) AS colors
FROM f JOIN sc USING (clip_id) JOIN sh USING (clip_id) JOIN l USING (clip_id) GROUP BY f.clip_id""")
def collapsed_frames(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("frame"), F.col("o_orderstatus").alias("scene"), F.col("o_orderpriority").alias("shot_type"), F.col("o_orderstatus").alias("lighting"), F.array("o_orderpriority", "o_orderstatus").alias("subjects"), F.array("o_orderstatus").alias("objects"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("colors"))
    return facets.collapsed_frames(rows).select("clip_id", "scene", "shot_type", "lighting", F.array_join("subjects", "|").alias("subjects"), "colors")


# --- segments and intervals -------------------------------------------------------------------------------------

CUTS = f"SELECT user_id, list_sort(list({HOURS})) AS cuts, max({HOURS}) + 5 AS duration FROM events GROUP BY user_id"
DENOISED = "SELECT user_id, duration, list_reduce(list_transform(cuts, lambda c: [c]), lambda a, x: CASE WHEN x[1] - a[-1] >= 2.0 THEN list_concat(a, x) ELSE a END) AS c FROM cuts"
BETWEEN = "SELECT user_id, list_concat(CASE WHEN c[1] > 0.01 THEN [[0.0::DOUBLE, c[1]]] ELSE [] END, list_transform(range(1, len(c)), lambda i: [c[i], c[i + 1]]), CASE WHEN duration - c[-1] > 0.01 THEN [[c[-1], duration]] ELSE [] END) AS s FROM den"
MERGED = "SELECT user_id, list_reduce(s, lambda a, x: CASE WHEN a[-1] - a[-2] < 6.0 THEN list_concat(a[1:len(a) - 1], [x[2]]) ELSE list_concat(a, x) END) AS f FROM bet"
UNFLAT = "SELECT user_id, unnest(list_transform(range(0, len(f) // 2), lambda i: {'i': i, 's': f[2 * i + 1], 'e': f[2 * i + 2]})) AS x FROM mer"
PARTS = "SELECT user_id, x.i AS i, x.s AS s, x.e AS e, CASE WHEN x.e - x.s <= 30.0 THEN 1 ELSE greatest(1, floor((x.e - x.s) / 15.0::DOUBLE + 0.5::DOUBLE)::INTEGER) END AS n FROM unf"
SPLIT = "SELECT user_id, i, k, s + k * 15.0::DOUBLE AS start, CASE WHEN k = n - 1 THEN e ELSE s + (k + 1) * 15.0::DOUBLE END AS \"end\" FROM par, range(0, 1000) r(k) WHERE k < n"
WITH_CUTS = f"WITH cuts AS ({CUTS}), den AS ({DENOISED}), bet AS ({BETWEEN}), mer AS ({MERGED}), unf AS ({UNFLAT}), par AS ({PARTS}), spl AS ({SPLIT})"


def cut_table(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.collect_list(hours()).alias("cuts"), (F.max(hours()) + 5).alias("duration"))


def segment_rows(df: DataFrame, column: str) -> DataFrame:
    each = df.select("user_id", F.posexplode(column).alias("seg", "s"))
    return each.select("user_id", "seg", r6("s.start").alias("start"), r6("s.end").alias("end"))


def den(t: Tables) -> DataFrame:
    return cut_table(t).withColumn("c", segments.denoised(F.col("cuts"), 2.0))


def bet(t: Tables) -> DataFrame:
    return den(t).withColumn("b", segments.between(F.col("c"), F.col("duration")))


def mer(t: Tables) -> DataFrame:
    return bet(t).withColumn("m", segments.merged(F.col("b"), 6.0))


def spl(t: Tables) -> DataFrame:
    return segments.segment_table(cut_table(t), min_gap=2.0, min_length=6.0, max_length=30.0, part=15.0)


query("denoise_cuts", f"{WITH_CUTS} SELECT user_id, len(c)::INTEGER AS n, round(list_sum(c), 6) AS total FROM den")(lambda t: den(t).select("user_id", F.size("c").alias("n"), r6(F.aggregate("c", F.lit(0.0), lambda a, x: a + x)).alias("total")))
query("segments_from_cuts", f"{WITH_CUTS} SELECT user_id, (i - 1)::INTEGER AS seg, round(s[i][1], 6) AS start, round(s[i][2], 6) AS \"end\" FROM (SELECT user_id, s, unnest(range(1, len(s) + 1)) AS i FROM bet)")(lambda t: segment_rows(bet(t), "b"))
query("merge_short", f"{WITH_CUTS} SELECT user_id, x.i::INTEGER AS seg, round(x.s, 6) AS start, round(x.e, 6) AS \"end\" FROM unf")(lambda t: segment_rows(mer(t), "m"))
FULL = "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY i, k) - 1)::INTEGER AS seg, round(start, 6) AS start, round(\"end\", 6) AS \"end\" FROM spl"
query("split_long", f"{WITH_CUTS} {FULL}")(lambda t: segment_rows(mer(t).withColumn("p", segments.split(F.col("m"), 30.0, 15.0)), "p"))
query("segment_full", f"{WITH_CUTS} {FULL}")(lambda t: segment_rows(spl(t), "segments"))
query("frame_timestamps", f"{WITH_CUTS}, q AS (SELECT *, greatest(1, least(3, floor((\"end\" - start) / 5)::INTEGER)) AS n FROM spl) SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY i, k, j) - 1)::INTEGER AS frame, round(start + (\"end\" - start) / n * (j + 0.5::DOUBLE), 6) AS at FROM q, range(0, 3) r(j) WHERE j < n")(
    lambda t: spl(t).select("user_id", F.posexplode(F.flatten(F.transform("segments", lambda s: segments.frame_times(s["start"], s["end"])))).alias("frame", "at")).select("user_id", "frame", r6("at").alias("at"))
)
query("sample_ranges", f"{WITH_CUTS}, n AS (SELECT user_id, start, \"end\", row_number() OVER (PARTITION BY user_id ORDER BY i, k) - 2 AS p, count(*) OVER (PARTITION BY user_id) AS c FROM spl), w AS (SELECT * FROM n WHERE c > 1 AND p >= 0 AND p % greatest(1, (c - 1) // 3) = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p) <= 3) SELECT user_id, round(start, 6) AS start, round(least(start + 10, \"end\"), 6) AS \"end\" FROM w UNION ALL SELECT user_id, round((start + \"end\") / 2, 6), round(least((start + \"end\") / 2 + 10, \"end\"), 6) FROM n WHERE c = 1")(
    lambda t: spl(t).select("user_id", F.explode(segments.sample_ranges(F.col("segments"), 3, 10.0)).alias("s")).select("user_id", r6("s.start").alias("start"), r6("s.end").alias("end"))
)
OVERLAP = f"""WITH e AS (SELECT user_id, event_id, event_type, {HOURS} AS h FROM events),
s AS (SELECT user_id, event_id AS seg, h AS a, h + 3 AS b FROM e WHERE event_id % 4 = 0), t AS (SELECT user_id, event_id AS idx, h AS a, h + 2 AS b, event_type AS text FROM e WHERE event_id % 4 <> 0),
x AS (SELECT s.user_id, s.seg, nullif(trim(string_agg(t.text, ' ' ORDER BY t.idx)), '') AS text FROM s JOIN t ON s.user_id = t.user_id AND t.a < s.b AND t.b > s.a GROUP BY ALL)
SELECT s.user_id, s.seg, x.text FROM s LEFT JOIN x USING (user_id, seg)"""


def overlap(t: Tables, bins: float | None) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("video_id"), "event_id", "event_type", hours().alias("start"))
    s = e.filter("event_id % 4 = 0").select("video_id", F.col("event_id").alias("seg"), "start", (F.col("start") + 3).alias("end"))
    u = e.filter("event_id % 4 <> 0").select("video_id", F.col("event_id").alias("idx"), "start", (F.col("start") + 2).alias("end"), F.col("event_type").alias("text"))
    if bins:
        return intervals.overlap_join(s, u, bin_width=bins).groupBy("video_id", "seg").agg(F.max("text").alias("text")).withColumnRenamed("video_id", "user_id")
    return intervals.overlap_join(s, u).select(F.col("video_id").alias("user_id"), "seg", "text")


query("overlap_join", OVERLAP)(lambda t: overlap(t, None))
query("overlap_join_binned", OVERLAP)(lambda t: overlap(t, 24.0))
query("positional_zip", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) i FROM conversations), b AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) i FROM conversations) SELECT conv_id, turn, n::INTEGER AS n FROM a JOIN b USING (conv_id, i)")(
    lambda t: intervals.positional(t.conversations.select("conv_id", "turn"), t.conversations.select("conv_id", (-F.col("turn")).alias("back"), F.char_length("text").alias("n")), "conv_id", "turn", "back").select("conv_id", "turn", "n")
)

# --- subtitles --------------------------------------------------------------------------------------------------


def subtitles(t: Tables) -> DataFrame:
    """Whole texts with their line ends, less blank lines and blanks at the end: a blank line would end the subtitle."""
    start = F.col("turn") * F.lit(7.25)
    said = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\n\s*\n", "\n")
    said = F.regexp_replace(F.regexp_replace(said, r"^\s*\n", ""), r"\s+$", "")
    return t.conversations.select("conv_id", F.col("turn").alias("idx"), start.alias("start"), (start + 5.5).alias("end"), said.alias("text"))


TIME = "printf('%02d:%02d:%02d,%03d', (x // 3600000)::INTEGER, (x // 60000 % 60)::INTEGER, (x // 1000 % 60)::INTEGER, (x % 1000)::INTEGER)"
SAID = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\s*\n', chr(10), 'g'), '^\s*\n', ''), '\s+$', '')"
SUBS = f"(SELECT conv_id, turn, (turn * 7250)::BIGINT AS a, (turn * 7250 + 5500)::BIGINT AS b, {SAID} AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"
query("srt_format", f"SELECT conv_id, string_agg(n || chr(10) || {TIME.replace('x', 'a')} || ' --> ' || {TIME.replace('x', 'b')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM {SUBS} GROUP BY conv_id")(lambda t: files.format_srt(subtitles(t), "conv_id"))
# a subtitle without text isn't a whole block
query("srt_parse", f"SELECT conv_id, n::INTEGER AS idx, a / 1000.0::DOUBLE AS start, b / 1000.0::DOUBLE AS \"end\", text FROM {SUBS} WHERE text <> ''")(
    lambda t: files.parse_srt(files.format_srt(subtitles(t), "conv_id"), "srt", "conv_id").select("conv_id", "idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")
)

# --- synchronisation and lifecycle ------------------------------------------------------------------------------

query("sync_incremental", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")(
    lambda t: lifecycle.without(sync.after(t.orders, 500, "o_orderkey"), t.orders.filter("o_orderstatus = 'P'"), "o_custkey").select("o_orderkey", "o_custkey")
)
query("sync_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 500")(lambda t: sync.after(t.orders, 500, "o_orderkey", 500).select("o_orderkey"))
query("sync_cursor", "SELECT greatest(coalesce(max(o_orderkey), 500), 500)::BIGINT AS cursor FROM orders WHERE o_orderkey > 500")(lambda t: sync.new_cursor(sync.after(t.orders, 500, "o_orderkey"), 500, "o_orderkey"))
query("sync_upsert", "WITH n AS (SELECT o_orderkey + 3 AS o_orderkey, max(o_totalprice * 2) AS price FROM orders GROUP BY 1) SELECT o_orderkey, price FROM n UNION ALL SELECT o_orderkey, o_totalprice FROM orders ANTI JOIN n USING (o_orderkey)")(
    lambda t: sync.upsert(t.orders.select("o_orderkey", F.col("o_totalprice").alias("price")), t.orders.select((F.col("o_orderkey") + 3).alias("o_orderkey"), (F.col("o_totalprice") * 2).alias("price")), ["o_orderkey"], F.col("price"))
)
query("sync_exclude", "SELECT page_id, url FROM pages WHERE NOT EXISTS (SELECT 1 FROM pages f WHERE f.page_id % 10 = 0 AND starts_with(pages.url, regexp_extract(f.url, '^(https?://[^/]+/[^/?]+)', 1) || '/') AND regexp_extract(f.url, '^(https?://[^/]+/[^/?]+)', 1) <> '')")(
    lambda t: hierarchy.without_children(t.pages.select("page_id", "url"), t.pages.filter("page_id % 10 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[^/?]+)", 1).alias("folder")).filter("folder <> ''"), "url")
)
query("remove_folder", "SELECT doc_id, source FROM documents WHERE source <> 'src3'")(lambda t: sync.without_folder(t.documents, "src3", "source").select("doc_id", "source"))
query("path_rebase", "SELECT page_id, CASE WHEN starts_with(url, 'http:/') THEN 'https:' || substr(url, 6) ELSE url END AS url, starts_with(url, 'http:/') AS changed FROM pages")(lambda t: sync.rebase(t.pages.select("page_id", "url"), ["url"], "http:", "https:"))
SCAN = "(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'orphaned' ELSE 'pending' END AS status, n_chars AS size, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS old_size, doc_id % 7 AS mtime, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE doc_id % 7 END AS old_mtime, md5(text) AS new_hash, CASE WHEN doc_id % 2 = 0 THEN md5(text) WHEN doc_id % 11 <> 0 THEN 'other' END AS old_hash FROM documents)"


@query("skip_decision", f"""SELECT doc_id, CASE status WHEN 'completed' THEN CASE WHEN size = old_size AND mtime = old_mtime THEN 'skip' WHEN old_hash IS NOT NULL THEN CASE WHEN new_hash = old_hash THEN 'refresh' ELSE 'index' END WHEN size <> old_size THEN 'index' ELSE 'backfill' END
WHEN 'orphaned' THEN CASE WHEN new_hash = old_hash THEN 'recover' ELSE 'index' END ELSE 'index' END AS action FROM {SCAN}""")
def skip_decision(t: Tables) -> DataFrame:
    i, own = F.col("doc_id"), F.md5(F.encode("text", "utf-8"))
    status = F.when(i % 3 == 0, "completed").when(i % 3 == 1, "orphaned").otherwise("pending")
    old_hash = F.when(i % 2 == 0, own).when(i % 11 != 0, "other")
    args = (status, F.col("n_chars"), i % 7, own, F.when(i % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.when(i % 4 == 0, 9).otherwise(i % 7), old_hash)
    return t.documents.select("doc_id", lifecycle.decision(*args).alias("action"))


query("orphan_recover", "SELECT md5(text) AS file_hash, doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id DESC) = 1")(
    lambda t: lifecycle.newest_orphans(t.documents.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("file_hash"), F.col("n_chars").alias("orphaned_at"), F.when(F.col("doc_id") % 2 == 0, "orphaned").otherwise("completed").alias("index_status")), id_column="doc_id").select("file_hash", "doc_id")
)
query("cleanup_expired", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAYS")(
    lambda t: lifecycle.expired(t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "orphaned").otherwise("completed").alias("index_status"), F.col("o_orderdate").alias("orphaned_at")), F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'"), 30).select("o_orderkey")
)
query("mark_orphaned", "SELECT page_id, CASE WHEN url IN (SELECT url FROM pages WHERE page_id % 3 = 0) THEN 'orphaned' ELSE 'completed' END AS index_status FROM pages")(
    lambda t: lifecycle.orphaned(t.pages.select("page_id", F.col("url").alias("file_path"), F.lit("completed").alias("index_status"), F.lit(None).cast("timestamp").alias("orphaned_at")), t.pages.filter("page_id % 3 = 0").select(F.col("url").alias("file_path")), F.current_timestamp()).select("page_id", "index_status")
)
FOLDER = "regexp_extract(url, '^(https?://[^/]+(/[^/?]+)?)', 1)"


def folder_col() -> Column:
    return F.regexp_extract("url", "^(https?://[^/]+(/[^/?]+)?)", 1)


query("folder_relationship", f"SELECT page_id, CASE WHEN p = q THEN 'duplicate' WHEN starts_with(q, p || '/') THEN 'parent' WHEN starts_with(p, q || '/') THEN 'child' ELSE 'unrelated' END AS relation FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS p, regexp_replace({FOLDER}, '/+$', '') AS q FROM pages)")(lambda t: t.pages.select("page_id", paths.relationship(F.col("url"), folder_col()).alias("relation")))
query("nearest_parent", f"WITH r AS (SELECT DISTINCT {FOLDER} AS f FROM pages WHERE page_id % 2 = 0), p AS (SELECT DISTINCT url AS path FROM pages) SELECT path, (SELECT arg_max(f, length(f)) FROM r WHERE starts_with(path, f || '/')) AS parent FROM p")(
    lambda t: hierarchy.nearest_parent(t.pages.select(F.col("url").alias("path")), t.pages.filter("page_id % 2 = 0").select(folder_col().alias("folder")))
)
query("addition_plan", "SELECT CASE WHEN count(*) FILTER (WHERE starts_with(url, 'http:/')) > 0 THEN 'add_as_parent' ELSE 'normal' END AS action, NULL::VARCHAR AS parent, count(DISTINCT url) FILTER (WHERE starts_with(url, 'http:/'))::INTEGER AS n FROM pages")(
    lambda t: hierarchy.addition_plan(t.pages.select(F.col("url").alias("folder")).distinct(), "http:").select("action", "parent", F.size("children").alias("n"))
)
query("compare_labels", "SELECT doc_id, coalesce(CASE WHEN quality IS NOT NULL THEN quality + 4 END, 0)::INTEGER AS rating FROM documents LEFT JOIN labels USING (doc_id)")(lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", enrich.rating(F.col("quality") + 4).alias("rating")))

# --- scalar functions -------------------------------------------------------------------------------------------

PART_TAGS = "list_filter([trim(p_brand), trim(p_type)], lambda x: x <> '')"
query("compose_text", "SELECT p_partkey, array_to_string(list_filter([p_type, p_name, p_brand], lambda x: x <> ''), '. ') AS text FROM (SELECT p_partkey, p_type, replace(p_name, ' ', ', ') AS p_name, p_brand FROM part)")(
    lambda t: t.part.select("p_partkey", text.compose_text({"scene": F.col("p_type"), "subjects": F.split("p_name", " "), "mood": F.col("p_brand")}).alias("text"))
)
query("compose_tags", "SELECT p_partkey, string_agg(w, '|' ORDER BY i) AS tags FROM (SELECT p_partkey, w, min(i) AS i FROM (SELECT p_partkey, unnest(list_concat([p_type], string_split(p_name, ' '), [p_brand])) AS w, generate_subscripts(list_concat([p_type], string_split(p_name, ' '), [p_brand]), 1) AS i FROM part) WHERE trim(w) <> '' GROUP BY p_partkey, w) GROUP BY p_partkey")(
    lambda t: t.part.select("p_partkey", F.array_join(text.compose_tags({"scene": F.col("p_type"), "subjects": F.split("p_name", " "), "mood": F.col("p_brand")}), "|").alias("tags"))
)


@query("merge_fields", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, p_type) AS scene, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS subjects FROM part")
def merge_fields(t: Tables) -> DataFrame:
    local = {"scene": F.col("p_type"), "subjects": F.array("p_type")}
    remote = {"scene": F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), "subjects": F.when(F.col("p_partkey") % 3 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>"))}
    out = text.merge_fields(local, remote)
    return t.part.select("p_partkey", out["scene"].alias("scene"), F.array_join(out["subjects"], "|").alias("subjects"))


LINE = "SELECT l_orderkey, l_linenumber, "
query("shot_bucket", LINE + "CASE WHEN l_discount * 5 >= 0.40::DOUBLE THEN 'extreme close-up' WHEN l_discount * 5 >= 0.15::DOUBLE THEN 'close-up' WHEN l_discount * 5 >= 0.05::DOUBLE THEN 'medium close-up' WHEN l_discount * 5 >= 0.015::DOUBLE THEN 'medium shot' ELSE 'wide shot' END AS shot FROM lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", enrich.shot_bucket(F.col("l_discount") * 5).alias("shot")))
query("lighting_bucket", LINE + "CASE WHEN l_tax * 12 < 0.15::DOUBLE THEN 'very dark' WHEN l_tax * 12 < 0.3::DOUBLE THEN 'dark' WHEN l_tax * 12 < 0.7::DOUBLE THEN 'normal' WHEN l_tax * 12 < 0.85::DOUBLE THEN 'bright' ELSE 'very bright' END AS light FROM lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", enrich.lighting_bucket(F.col("l_tax") * 12).alias("light")))
query("nearest_color", """WITH a AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 37 % 256) / 255.0::DOUBLE AS r, (l_partkey * 11 % 256) / 255.0::DOUBLE AS g, (l_suppkey * 91 % 256) / 255.0::DOUBLE AS b FROM lineitem),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (greatest(r, g, b) + least(r, g, b)) / 2 AS l, greatest(r, g, b) - least(r, g, b) AS d FROM a),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE d / nullif(1 - abs(2 * l - 1), 0) END AS s, CASE WHEN hi = r THEN (g - b) / nullif(d, 0) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN 2 + (b - r) / nullif(d, 0) ELSE 4 + (r - g) / nullif(d, 0) END * 60 AS x FROM m)
SELECT l_orderkey, l_linenumber, CASE WHEN s < 0.12::DOUBLE THEN CASE WHEN l < 0.2::DOUBLE THEN 'black' WHEN l > 0.8::DOUBLE THEN 'white' ELSE 'gray' END WHEN x < 15 THEN 'red' WHEN x < 45 THEN 'orange' WHEN x < 75 THEN 'yellow' WHEN x < 150 THEN 'green' WHEN x < 195 THEN 'cyan' WHEN x < 260 THEN 'blue' WHEN x < 290 THEN 'purple' WHEN x < 330 THEN 'pink' ELSE 'red' END AS color FROM h""")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", enrich.nearest_color(F.col("l_orderkey") * 37 % 256, F.col("l_partkey") * 11 % 256, F.col("l_suppkey") * 91 % 256).alias("color"))
)
query("tags_to_text", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ' x' ELSE props END AS tags FROM events")(
    lambda t: t.events.select("event_id", text.tags_to_text(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('","x"]'))).otherwise(F.col("props"))).alias("tags"))
)
query("json_salvage", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")(
    lambda t: t.events.select("event_id", text.json_salvage(F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n``` done")), "k long")["k"].alias("k"))
)
query("timecodes", "SELECT event_id, printf('%d:%02d', (event_id // 60)::INTEGER, (event_id % 60)::INTEGER) AS code FROM events")(lambda t: t.events.select("event_id", text.timecode(F.col("event_id")).alias("code")))
query("locale_names", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'fr_FR' WHEN 'de' THEN 'de_DE' WHEN 'es' THEN 'es_ES' ELSE 'en_US' END AS locale FROM documents")(lambda t: t.documents.select("doc_id", enrich.locale(F.concat(F.upper("lang"), F.lit("-xx"))).alias("locale")))
query("file_hashes")(lambda t: t.documents.select("doc_id", files.content_hash(F.encode("text", "utf-8")).alias("file_hash")))
query("path_hashes", "SELECT page_id, format('{:016x}', list_reduce(list_prepend(5381::UHUGEINT, list_transform(string_split(url, ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (h * 33 + b) % 18446744073709551616::UHUGEINT)::UBIGINT) AS hash FROM pages")(lambda t: t.pages.select("page_id", text.path_hashes("url").alias("hash")))
WORD_HASHES = "SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM documents)"
DIMENSIONS = f"SELECT doc_id, h % 64 AS k, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM ({WORD_HASHES}) GROUP BY ALL"
query("embed_texts", f"WITH d AS ({DIMENSIONS}), l AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM d GROUP BY doc_id) SELECT doc_id, k::INTEGER AS place, round((x / l)::FLOAT::DOUBLE, 5) AS x FROM d JOIN l USING (doc_id) WHERE x <> 0")(
    lambda t: t.documents.select("doc_id", F.posexplode(embedding.embedded(embedding.HashingProvider(64), F.col("text"))).alias("place", "x")).filter("x <> 0").select("doc_id", "place", F.round(F.col("x").cast("double"), 5).alias("x"))
)

# --- events -----------------------------------------------------------------------------------------------------


def changes(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 97 == 0, "rescan").when(F.col("event_type") == "purchase", "removed").when(F.col("event_id") % 2 == 0, "added").otherwise("modified")
    return t.events.select(F.concat(F.lit("/f/"), F.col("user_id"), F.lit("/"), F.get_json_object("props", "$.k"), F.lit(".mp4")).alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("folder"))


CHANGES = "(SELECT '/f/' || user_id || '/' || (props->>'k') || '.mp4' AS path, CASE WHEN event_id % 97 = 0 THEN 'rescan' WHEN event_type = 'purchase' THEN 'removed' WHEN event_id % 2 = 0 THEN 'added' ELSE 'modified' END AS kind, event_id AS seq, user_id::VARCHAR AS folder FROM events)"
query("event_dedupe", f"SELECT path, arg_max(kind, seq) AS kind, min(seq) AS seq FROM {CHANGES} GROUP BY path")(lambda t: ev.deduplicated(changes(t)))
query("event_route", f"SELECT folder, path, kind, seq, CASE WHEN max(CASE WHEN kind = 'rescan' THEN 1 ELSE 0 END) OVER (PARTITION BY folder) = 1 THEN 'rescan' WHEN kind = 'removed' THEN 'orphan' ELSE 'index' END AS route FROM (SELECT folder, path, arg_max(kind, seq) AS kind, min(seq) AS seq FROM {CHANGES} GROUP BY folder, path)")(lambda t: ev.routed(ev.deduplicated_with_folder(changes(t))))
query("debounce", "SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR (epoch_us(n) - epoch_us(ts)) / 1e6 > 3600")(lambda t: ev.debounced(t.events, "user_id", "ts", 3600).select("event_id"))
query("sliding_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")(lambda t: ev.sliding_rate(t.events, "user_id", "ts", 7200).select("event_id", "in_window"))
query("windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda t: ev.windowed_counts(t.events).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n"))


# registered by being imported
from lumenreel.plans import details, library  # noqa: E402, F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
