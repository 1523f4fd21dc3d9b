"""The core engine's operators on small examples, and its full-text search against SQLite."""

import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumenreel.functions import enrich, paths, text
from lumenreel.operators import facets, filters, fts, hierarchy, intervals, lifecycle, search, segments, sync, vector
from lumenreel.plans import catalogue
from lumenreel.sources import files, text_index
from lumenreel.streaming import events as ev

CORPUS = [
    (1, "灯塔 海鸥 清晨", "一座白色灯塔立在岩石上", "Der Wärter öffnet das Tor", None),
    (2, "厨房 面包 烤箱", "刚出炉的面包冒着热气", None, "Bäckerei früh"),
    (3, "灯塔 楼梯", "A narrow stair winds up to the lamp of the old lighthouse", "mind your step on the stair", None),
    (4, "山谷 牧羊人 Größe", "Ein Hirte führt die Herde über den Pass", None, None),
    (5, None, "", "une échelle près du phare", "phare"),
]
COLUMNS = ("tags", "description", "transcript", "user_tags")


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0)])
    return row.select(column.alias("x")).first()[0]


def fts_hits(spark, df, query, **options):
    return [(r.clip_id, r["rank"]) for r in fts.search(df, query, "clip_id", COLUMNS, **options).collect()]


def sqlite(rows):
    """The same rows in SQLite's full-text search."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(tags, description, transcript, user_tags)")
    db.executemany("insert into t(rowid, tags, description, transcript, user_tags) values (?,?,?,?,?)", rows)
    return lambda query: db.execute("select rowid, rank from t where t match ? order by rank, rowid", (query,)).fetchall()


TABLE = "clip_id long, tags string, description string, transcript string, user_tags string"


@pytest.mark.parametrize(
    ("query", "hits"),
    [("灯塔", {1, 3}), ("stair", {3}), ("oven", set()), ("tags:山谷", {4}), ("厨房 OR 山谷", {2, 4}), ("灯塔 NOT 楼梯", {1}), ('"on the stair"', {3}), ("stair lamp", {3}), ("light*", {3}), ("warter", {1}), ("GRÖSSE OR große OR phare", {5, 4}), ("ECHELLE", {5}), ("  ", set())],
)
def test_fts_golden(spark, query, hits):
    df = spark.createDataFrame(CORPUS, TABLE)
    got = fts_hits(spark, df, query)
    assert {g for g, _ in got} == hits
    if query.strip():
        assert dict(got) == pytest.approx(dict(sqlite(CORPUS)(query)), rel=1e-9)


GRAMMAR = (
    *("cat", "cat dog", "cat OR (sun AND sea)", "cat OR (dog NOT sea)", '"cat dog"', "ca*", "tags:cat", "description:sun NOT tags:sea", '"sun ca"*', "CAFE tree", "(cat OR dog) AND sea", "cat NOT dog NOT sun", "sea AND cat OR sun"),
    *("^cat", "tags:^sun", "cat + dog", '"sun" + sea + ca *', "{tags description}: cat", "- tags : sun", "-{tags transcript}: sea dog", "{tags}: (cat OR sun)", "tags: (cat dog)", "^ca*", "cat+dog sun"),
    *("NEAR(cat dog)", "NEAR(cat dog, 1)", "NEAR(cat sun sea, 2)", 'NEAR("cat dog" sun, 3)', "tags: NEAR(cat sea, 0)", "NEAR(ca* dog, 1) OR sea", "NEAR(cat cat, 2)", "sun AND NEAR(dog sea, 1)", "NEAR(cat)", "NEAR(tree x1, 4) NOT sun", "NEAR (cat dog, 2) AND cat"),
)


def test_fts_equals_sqlite(spark, tmp_path):
    r = random.Random(5)
    vocabulary = ["cat", "dog", "sun", "sea", "car", "café", "x1", "tree", "cart"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randrange(0, 9))), " ".join(r.choices(vocabulary, k=r.randrange(0, 16))), None, None) for i in range(120)]
    df = spark.createDataFrame(rows, TABLE).cache()
    ask = sqlite(rows)
    index = text_index.TextIndex(spark, str(tmp_path / "index"), "clip_id", COLUMNS)
    index.build(df)
    for i, query in enumerate(GRAMMAR):
        want = ask(query)
        got = fts_hits(spark, df, query, limit=200)
        assert {a for a, _ in got} == {a for a, _ in want}, query
        assert dict(got) == pytest.approx(dict(want), rel=1e-9), query
        if i % 3 == 0:
            assert {x.clip_id: x["rank"] for x in index.search(query, 200).collect()} == pytest.approx(dict(want), rel=1e-9), query


def test_tokens_equal_sqlite(spark):
    # every letter, number and sign of the Latin, Greek and Cyrillic blocks between two letters
    letters = [chr(c) for c in (*range(0x20, 0x37F), *range(0x380, 0x528), *range(0x1E00, 0x2000), 0x301, 0x308, 0x4E2D, 0xAC00, 0xFF11) if unicodedata.category(chr(c))[0] not in "CM" or c in (0x301, 0x308)]
    texts = [(i, f"a{c}b") for i, c in enumerate(letters)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x)")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    db.executemany("insert into t(rowid, x) values (?, ?)", texts)
    want = {i: [] for i, _ in texts}
    for term, doc in db.execute("select term, doc from v order by doc, offset"):
        want[doc].append(term)
    got = {r.i: r.t for r in spark.createDataFrame(texts, "i long, x string").select("i", text.unicode_tokens("x").alias("t")).collect()}
    other = {texts[i][1]: (got[i], want[i], text.plain_query_tokens(texts[i][1])) for i in want if got[i] != want[i]}
    assert other == {}
    assert all(got[i] == text.plain_query_tokens(x) for i, x in texts)


def test_stored_index_is_maintained_by_generations(spark, tmp_path):
    def docs(*rows):
        return spark.createDataFrame(rows, "clip_id long, folder string, body string")

    def found(query):
        return {r.clip_id: r["rank"] for r in index.search(query).collect()}

    def fresh(query, *rows):
        return {r.clip_id: r["rank"] for r in fts.search(docs(*rows), query, "clip_id", ("body",)).collect()}

    index = text_index.TextIndex(spark, str(tmp_path / "index"), "clip_id", ("body",), "folder")
    assert found("harbour") == {}
    a = [(1, "/a", "the harbour at night"), (2, "/a", "the bridge"), (3, "/b", "harbour bridge and harbour wall")]
    index.build(docs(*a))
    assert found("harbour") == pytest.approx(fresh("harbour", *a)) and set(found("harbour")) == {1, 3}
    b = [(2, "/a", "a harbour crane"), (4, "/b", "night train")]
    index.upsert(docs(*b))
    now = [a[0], b[0], a[2], b[1]]
    assert found("harbour OR night") == pytest.approx(fresh("harbour OR night", *now)) and found("the bridge") == {}
    index.delete(docs(a[0]))
    assert found("night") == pytest.approx(fresh("night", *now[1:]))
    c = [(5, "/b", "night market by the harbour")]
    index.rebuild_folder("/b", docs(*c))
    now = [b[0], c[0]]
    assert found("harbour OR night OR bridge") == pytest.approx(fresh("harbour OR night OR bridge", *now))
    index.compacted()
    index.discard()
    assert found("harbour OR night") == pytest.approx(fresh("harbour OR night", *now)) and len(index._generations("postings")) == 1
    index.delete_folder("/b")
    assert set(found("harbour")) == {2} and index.stats().first().n_docs == 1
    # a change that fails before its last write isn't seen
    index._add(docs((9, "/a", "harbour harbour")), index._state()[1] + 1)
    assert set(found("harbour")) == {2}


@pytest.mark.parametrize("query", ["AND cat", ".", "'", "nocolumn:cat", "(a OR b) c", "a NOT", '"open', "(a", "a OR OR b", "{tags: x", "-tags x", "NEAR(a b", "NEAR(a b, c)", "a +", "^"])
def test_fts_syntax_errors(spark, query):
    df = spark.createDataFrame(CORPUS, TABLE)
    with pytest.raises(sqlite3.OperationalError):
        sqlite(CORPUS)(query)
    with pytest.raises(fts.FtsSyntaxError):
        fts_hits(spark, df, query)
    assert fts_hits(spark, df, query, on_error="empty") == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0, 0.0]), (3, [0.5, 0.5, 0.0, 0.0]), (4, [0.0, 1.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0, 1.0]), (6, [1.0]), (7, [0.0] * 4), (8, None)]
    df = spark.createDataFrame(rows, "clip_id long, embedding array<float>")
    q = [1.0, 0.0, 0.0, 0.0]
    assert [r.clip_id for r in vector.top_k(df, q, 2).collect()] == [1, 2]
    assert [r.clip_id for r in vector.top_k(vector.allowed(df, df.filter("clip_id = 3")), q, 2).collect()] == [3]
    assert vector.top_k(df, q, 10).count() == 8 and vector.top_k(df, q, 10, keep_unusable=False).count() == 5
    assert vector.top_k(df, [0.0] * 4, 2, keep_unusable=False).count() == 0
    native = {r.clip_id: r.s for r in df.select("clip_id", vector.cosine(F.col("embedding"), F.array(*map(F.lit, q))).alias("s")).collect()}
    assert native[2] == pytest.approx(0.9 / (0.82**0.5)) and native[6] == native[7] == native[8] == 0
    changes = spark.createDataFrame([(1, [0.0, 0.0, 1.0, 0.0], 1), (1, [0.0, 1.0, 1.0, 0.0], 2), (9, [2.0], 1)], "clip_id long, embedding array<float>, seq int")
    new = {r.clip_id: r.embedding for r in vector.upserted(df.withColumn("seq", F.lit(0)), changes, order="seq").collect()}
    assert len(new) == 9 and new[1] == [0.0, 1.0, 1.0, 0.0] and new[9] == [2.0]
    back = df.filter("embedding is not null").select("embedding", vector.from_blob(vector.to_blob("embedding")).alias("b"))
    assert all(r.embedding == r.b for r in back.collect())


def test_hybrid_scores(spark):
    clips = spark.createDataFrame([(1, "灯塔 海鸥 岩石"), (2, "灯塔 楼梯"), (3, "厨房 楼梯")], "clip_id long, tags string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [0.0, 0.6, 0.8]), (3, [1.0, 0.0, 0.0])], "clip_id long, embedding array<float>")
    run = lambda q, e, m="auto", **o: search.hybrid_search(clips, vectors, q, e, m, 10, "clip_id", ("tags",), **o).collect()
    got = run("灯塔", [0.0, 1.0, 0.0])
    assert {1, 2} <= {r.clip_id for r in got} and all(0 <= r.score <= 1 for r in got)
    assert [r.clip_id for r in run("灯塔", None)] == [2, 1] and all(r.score is None for r in run("灯塔", None))
    assert run("", [0.0, 1.0, 0.0], "fts") == [] and run("灯塔", None, "vector") == []
    assert [r.clip_id for r in run("灯塔", [0.0, 1.0, 0.0], "hybrid", keep=clips.filter("clip_id = 2"))] == [2]


@pytest.mark.parametrize(("query", "mode", "has", "want"), [("x", "fts", True, (1, 0)), ("x", "vector", True, (0, 1)), ('"白色灯塔"', "auto", True, (0.9, 0.1)), ("岩石上的白色灯塔和海鸥", "auto", True, (0.2, 0.8)), ("灯塔海鸥", "auto", True, (0.4, 0.6)), ("灯塔海鸥", "auto", False, (1, 0)), ("牧羊人和山谷", "auto", True, (0.2, 0.8)), ("stair light", "auto", True, (0.2, 0.8)), ("old lamp", "auto", True, (0.4, 0.6))])
def test_weights(spark, query, mode, has, want):
    assert search.resolve_weights(query, mode, has) == want
    if mode == "auto":
        a, b = search.weight_columns(F.lit(query), F.lit(has))
        assert (one(spark, a), one(spark, b)) == want


def test_filters_and_facets(spark):
    rows = spark.createDataFrame([(1, 1, "red", "close-up", "cheerful"), (2, 3, "blue", "close-up", "somber"), (3, 5, None, "wide shot", None), (4, 0, "red", "", "")], "clip_id long, rating int, color_label string, shot_type string, mood string").withColumn("source_folder", F.lit("/A"))
    ids = lambda f: [r.clip_id for r in f.apply(rows).orderBy("clip_id").collect()]
    assert ids(filters.ResultFilter(3)) == [2, 3] and ids(filters.ResultFilter(0)) == [1, 2, 3, 4]
    assert ids(filters.ResultFilter(colors=frozenset({"red"}))) == [1, 4] and filters.ResultFilter(0).is_empty and filters.ResultFilter(1, moods=frozenset({"x"})).active == 2
    assert filters.folder_filter(rows, []).count() == 0 and filters.folder_filter(rows, None).count() == 4 and filters.folder_filter(rows, ["/B"]).count() == 0
    found = {(r.dimension, r.value): r.n for r in facets.all_facets(rows, []).collect()}
    assert found == {("shot_type", "close-up"): 2, ("shot_type", "wide shot"): 1, ("mood", "cheerful"): 1, ("mood", "somber"): 1, ("rating", "1"): 1, ("rating", "3"): 1, ("rating", "5"): 1, ("color_label", "red"): 2, ("color_label", "blue"): 1}
    tags = spark.createDataFrame([(["灯塔", "海鸥"], ["best"]), (["灯塔", "灯塔"], ["best", "spare"]), (["山谷"], None)], "tags array<string>, user_tags array<string>")
    assert {r.tag: r.n for r in facets.popular_tags(tags, "tags", "user_tags").collect()} == {"灯塔": 2, "best": 2, "海鸥": 1, "spare": 1, "山谷": 1}
    votes = spark.createDataFrame([("a", "ja", -0.1), ("a", "ja", -0.2), ("a", "en", -0.5), ("b", "ja", -0.3), ("b", "en", -0.1)], "k string, language string, confidence double")
    assert {r.k: (r.language, r.confidence) for r in facets.majority_vote(votes, "k", "language", "confidence").collect()} == {"a": ("ja", -0.1), "b": ("en", -0.1)}


def pairs(spark, column):
    return [(s.start, s.end) for s in one(spark, column)]


def cuts(*values):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def segs(*values):
    return F.array(*[segments.segment(F.lit(float(a)), F.lit(float(b))) for a, b in values]).cast(segments.SEGMENTS)


def test_segments(spark):
    assert one(spark, segments.denoised(cuts(5, 15, 30, 60), 2)) == [5, 15, 30, 60]
    assert one(spark, segments.denoised(cuts(1, 1.5, 1.8, 2.1), 2)) == [1] and one(spark, segments.denoised(cuts(), 2)) == []
    assert pairs(spark, segments.between(cuts(5, 12.5, 45), F.lit(120.0))) == [(0, 5), (5, 12.5), (12.5, 45), (45, 120)]
    assert pairs(spark, segments.between(cuts(), F.lit(60.0))) == [(0, 60)] and len(pairs(spark, segments.between(cuts(30), F.lit(60.0)))) == 2
    assert pairs(spark, segments.split(segs((0, 45)), 30, 15)) == [(0, 15), (15, 30), (30, 45)]
    assert pairs(spark, segments.split(segs((0, 35)), 30, 15)) == [(0, 15), (15, 35)] and pairs(spark, segments.split(segs((0, 30)), 30, 15)) == [(0, 30)]
    assert pairs(spark, segments.sample_ranges(segs((0, 15), (15, 45), (45, 80), (80, 120)))) == [(15, 45), (45, 75), (80, 110)]
    assert pairs(spark, segments.sample_ranges(segs((0, 10), (10, 100)))) == [(10, 40)] and pairs(spark, segments.sample_ranges(segs((0, 60)))) == [(30, 60)]
    assert one(spark, segments.frame_times(F.lit(0.0), F.lit(12.0))) == [3.0, 9.0]


def model(times, duration):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= 0.3:
            kept.append(t)
    if not kept:
        out = [(0.0, duration)]
    else:
        edges = ([0.0] if kept[0] > 0.01 else []) + kept + ([duration] if duration - kept[-1] > 0.01 else [])
        out = list(zip(edges, edges[1:], strict=False))
    merged = []
    for a, b in out:
        if merged and merged[-1][1] - merged[-1][0] < 2:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    final = []
    for a, b in merged:
        if b - a <= 30:
            final.append((a, b))
            continue
        at = a
        while at < b:
            end = min(at + 15, b)
            if b - end < 7.5 and end < b:
                end = b
            final.append((at, end))
            at = end
    return final


def test_segmentation_against_a_model(spark):
    r = random.Random(2)
    rows = [(i, [round(r.uniform(0, 200), 2) for _ in range(r.randrange(0, 30))], 200.0 + i / 7) for i in range(200)]
    df = segments.segment_table(spark.createDataFrame(rows, "k int, cuts array<double>, duration double"))
    for row in df.collect():
        want = model(row.cuts, row.duration)
        assert [x for s in row.segments for x in s] == pytest.approx([x for s in want for x in s])


@pytest.mark.parametrize("bins", [None, 4.0])
def test_overlap(spark, bins):
    scenes = spark.createDataFrame([(1, 0, 5.0, 12.0), (2, 0, 0.0, 10.0), (2, 1, 10.0, 20.0), (3, 0, 0.0, 1.0)], "video_id long, seg int, start double, end double")
    said = spark.createDataFrame([(1, 1, 0.0, 8.0, "A"), (1, 2, 8.0, 15.0, "B"), (2, 1, 0.0, 5.0, "eins"), (2, 2, 5.0, 12.0, "zwei"), (2, 3, 12.0, 20.0, "drei"), (3, 1, 1.0, 2.0, "x")], "video_id long, idx int, start double, end double, text string")
    out = {}
    for r in intervals.overlap_join(scenes, said, bin_width=bins).collect():
        out[r.video_id, r.seg] = max(out.get((r.video_id, r.seg)) or "", r.text or "") or None
    assert out == {(1, 0): "A B", (2, 0): "eins zwei", (2, 1): "zwei drei", (3, 0): None}


def test_srt(spark):
    rows = spark.createDataFrame([(1, 5, 0.0, 1.5, "a\nb"), (1, 9, 3661.9999, 3700.0, "c"), (1, 2, -1.0, 0.5, "z")], "k long, idx int, start double, end double, text string")
    srt = files.format_srt(rows, "k")
    assert srt.first().srt == "1\n00:00:00,000 --> 00:00:00,500\nz\n\n2\n00:00:00,000 --> 00:00:01,500\na\nb\n\n3\n01:01:01,999 --> 01:01:40,000\nc\n"
    assert [(r.idx, r.start, r.end, r.text) for r in files.parse_srt(srt, "srt", "k").collect()] == [(1, 0, 0.5, "z"), (2, 0, 1.5, "a\nb"), (3, 3661.999, 3700, "c")]
    bad = spark.createDataFrame([("x\n\n1\n00:00:01,000 --> nope\nhi\n\n2\n00:00:01,000 --> 00:00:02,000\n",)], "srt string")
    assert files.parse_srt(bad).count() == 0
    assert text.path_hash("") == format(5381, "016x") and len(text.path_hash("/a/b" * 40)) == 16


def test_srt_queries_meet_whole_texts(spark, tmp_path):
    rows = [(1, 0, "user", "one line of more than thirty characters, to its end"), (1, 1, "assistant", "first line\n  second\nthird"), (2, 0, "user", "short"), (2, 1, "user", "\n\na\n \n\n  b\n\n"), (3, 0, "user", " \n ")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.queries()["srt_parse"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.idx, r.start, r.end, r.text) for r in got) == [(1, 1, 0, 5.5, rows[0][3]), (1, 2, 7.25, 12.75, rows[1][3]), (2, 1, 0, 5.5, "short"), (2, 2, 7.25, 12.75, "a\n  b")]
    whole = {r.conv_id: r.srt for r in catalogue.queries()["srt_format"](spark, str(tmp_path)).collect()}
    assert whole[1] == f"1\n00:00:00,000 --> 00:00:05,500\n{rows[0][3]}\n\n2\n00:00:07,250 --> 00:00:12,750\n{rows[1][3]}\n"


def test_logs_and_json(spark):
    assert one(spark, files.log_cuts(F.lit("x pts_time:12.5 y\npts_time: 3 z"))) == [3.0, 12.5]
    assert one(spark, files.log_duration(F.lit("Duration: 01:02:03.50, start"))) == 3723.5 and one(spark, files.log_duration(F.lit("none"))) is None
    assert one(spark, files.no_audio(F.lit("Stream map '0:a' MATCHES no streams"))) and not one(spark, files.no_audio(F.lit("ok")))
    salvaged = text.json_salvage(F.lit('Sure!\n```json\n{"scene": "beach", "subjects": ["a"]}\n```'), "scene string, subjects array<string>")
    assert one(spark, salvaged["scene"]) == "beach" and one(spark, text.json_salvage(F.lit("no"), "scene string")["scene"]) is None
    assert one(spark, text.response_text(F.lit('{"candidates":[{"content":{"parts":[{"text":"hi"}]}}]}'))) == "hi"
    assert one(spark, text.embeddings_values(F.lit('{"embeddings":[{"values":[1,2]},{"values":[3]}]}'))) == [[1, 2], [3]]
    assert one(spark, text.tags_to_text(F.lit('["a","b"]'))) == "a b" and one(spark, text.tags_to_text(F.lit("plain x"))) == "plain x"


def test_text_and_tags(spark):
    fields = {"scene": F.lit("beach"), "subjects": F.array(F.lit("a"), F.lit(""), F.lit("b")), "mood": F.lit("calm"), "description": F.lit("Sunny."), "objects": F.array().cast("array<string>")}
    assert one(spark, text.compose_text(fields, F.lit("hello"))) == "beach. Sunny.. a, b. calm. hello"
    assert one(spark, text.compose_tags(fields)) == ["beach", "a", "b", "calm"]
    merged = text.merge_fields({"scene": F.lit("l"), "subjects": F.array(F.lit("x"))}, {"scene": F.lit(None).cast("string"), "subjects": F.array(F.lit("r"))})
    assert one(spark, merged["scene"]) == "l" and one(spark, merged["subjects"]) == ["r"] and one(spark, merged["tags"]) == ["l", "r"]
    tags = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    assert one(spark, sync.tags_added(tags, F.array(F.lit(" c "), F.lit("")))) == ["a", "b", "c"] and one(spark, sync.tags_removed(tags, F.array(F.lit("b")))) == ["a", "a"]
    assert one(spark, sync.clean_tags(F.array(F.lit(" ")))) is None
    assert one(spark, text.spoken(F.lit("<|en|> hi <|0.00|>"))) == "hi" and one(spark, text.spoken(F.lit("<|x|> ..."))) == ""
    assert one(spark, text.timecode(F.lit(125.25), True)) == "2:05.25"
    assert one(spark, text.unicode_tokens(F.lit("Café x² a_b"))) == ["cafe", "x²", "a", "b"]


def test_enrichment(spark):
    shots = [one(spark, enrich.shot_bucket(F.lit(x))) for x in (0.4, 0.15, 0.05, 0.015, 0.01)]
    assert shots == ["extreme close-up", "close-up", "medium close-up", "medium shot", "wide shot"]
    assert [one(spark, enrich.lighting_bucket(F.lit(x))) for x in (0.1, 0.2, 0.5, 0.8, 0.9)] == ["very dark", "dark", "normal", "bright", "very bright"]
    colors = {(255, 0, 0): "red", (0, 255, 0): "green", (0, 0, 255): "blue", (255, 255, 255): "white", (0, 0, 0): "black", (128, 128, 128): "gray", (255, 255, 0): "yellow", (0, 255, 255): "cyan", (255, 128, 0): "orange", (255, 0, 128): "pink", (255, 0, 100): "red", (255, 0, 200): "pink"}
    for rgb, name in colors.items():
        assert one(spark, enrich.nearest_color(*map(F.lit, rgb))) == name
    labels = F.array(*[F.struct(F.lit(n).alias("identifier"), F.lit(c).alias("confidence")) for n, c in (("low", 0.05), ("a_b", 0.5), ("beach_x", 0.9))])
    got = one(spark, enrich.scene_and_objects(labels))
    assert got.scene == "beach x" and got.objects == ["a b"]
    assert one(spark, enrich.subjects(F.lit(2), F.lit(3))) == ["3 people"] and one(spark, enrich.subjects(F.lit(0), F.lit(1))) == ["person"] and one(spark, enrich.subjects(F.lit(0), F.lit(0))) == []
    assert one(spark, enrich.locale(F.lit("zh-Hans"))) == "zh_CN" and one(spark, enrich.locale(F.lit(None).cast("string"))) == "en_US"
    args = lambda c, m, p, t, mb: [F.lit(x) for x in (c, m, p, t, mb)]
    assert one(spark, enrich.concurrency(*args(8, "full_speed", False, "nominal", 9000))) == 6 and one(spark, enrich.concurrency(*args(8, "balanced", False, "fair", 9000))) == 3
    assert one(spark, enrich.concurrency(*args(8, "full_speed", True, "nominal", 700))) == 1 and one(spark, enrich.concurrency(*args(8, "full_speed", False, "serious", 9000))) == 3
    assert one(spark, enrich.finder_tags(F.array(F.lit("Red"), F.lit("x")), F.lit("blue"))) == ["x", "Blue\n4"]
    assert one(spark, enrich.palette(F.array(F.lit("red"), F.lit("blue"), F.lit("red")))) == "red blue"


def test_paths_and_hierarchy(spark):
    rel = lambda a, b: one(spark, paths.relationship(F.lit(a), F.lit(b)))
    assert [rel("/A", "/A/B"), rel("/A/B", "/A"), rel("/A", "/A/"), rel("/A", "/AB"), rel("/A", "/C")] == ["parent", "child", "duplicate", "unrelated", "unrelated"]
    folders = spark.createDataFrame([("/A",), ("/A/B",), ("/C/x",), ("/C/y/",)], "folder string")
    plan = lambda p: tuple(hierarchy.addition_plan(folders, p).first())
    assert plan("/A/") == ("duplicate", None, []) and plan("/A/B/c") == ("bookmark", "/A/B", []) and plan("/C") == ("add_as_parent", None, ["/C/x", "/C/y/"]) and plan("/Z") == ("normal", None, [])
    found = spark.createDataFrame([("/A/B/c/d",), ("/A/q",), ("/Z",)], "path string")
    assert {r.path: r.parent for r in hierarchy.nearest_parent(found, folders).collect()} == {"/A/B/c/d": "/A/B", "/A/q": "/A", "/Z": None}
    assert [r.folder for r in hierarchy.children(folders, "/C").collect()] == ["/C/x", "/C/y/"]
    moved = lambda p: one(spark, paths.rebased(F.lit(p).cast("string"), "/A/B/", "/new"))
    assert [moved(p) for p in ("/A/B/c", "/A/B", "/A/BC/c", None)] == ["/new/c", "/new", "/A/BC/c", None]
    assert one(spark, paths.remounted(F.lit("/Volumes/X/a/b"), F.lit("/Volumes/Y 1"))) == "/Volumes/Y 1/a/b" and one(spark, paths.under(F.lit("/a"), F.lit("/")))


def video_rows(spark, folder, n, first=1):
    rows = [(folder, i, f"{folder}/video{i}.mp4", f"video{i}.mp4") for i in range(first, n + 1)]
    return spark.createDataFrame(rows, "source_folder string, source_video_id long, file_path string, file_name string")


def test_sync(spark):
    folder = "/Volumes/Größe/Aufnahmen 1"
    videos = video_rows(spark, folder, 3)
    clips = spark.createDataFrame([(folder, v, v * 10 + c, c * 5.0) for v in (1, 2, 3) for c in range(2)], "source_folder string, source_video_id long, source_clip_id long, start_time double")
    none_v = videos.limit(0).withColumn("video_id", F.lit(1).cast("long"))
    none_c = clips.limit(0).withColumn("video_id", F.lit(1).cast("long")).withColumn("clip_id", F.lit(1).cast("long"))
    meta = spark.createDataFrame([], "folder_path string, last_synced_clip_rowid long, last_synced_video_rowid long, last_synced_at timestamp, volume_uuid string, volume_name string")
    now = F.to_timestamp(F.lit("2024-01-01"))
    first = sync.sync_folder(folder, videos, clips, none_v, none_c, meta, now)
    assert first["videos"].count() == 3 and first["clips"].filter("video_id is not null").count() == 6
    state = {k: spark.createDataFrame(first[k].collect(), first[k].schema) for k in ("videos", "clips", "meta")}
    again = sync.sync_folder(folder, videos, clips, state["videos"], state["clips"], state["meta"], now)
    assert again["synced_videos"].count() == 0 and again["synced_clips"].count() == 0 and again["meta"].first()["last_synced_video_rowid"] == 3
    forced = sync.sync_folder(folder, videos, clips, state["videos"], state["clips"], state["meta"], now, force=True)
    assert forced["videos"].count() == 3 and forced["clips"].count() == 6 and forced["synced_clips"].count() == 6
    child = spark.createDataFrame([(folder + "/video2.mp4",), ], "folder string")
    kids = video_rows(spark, folder, 2).withColumn("file_path", F.concat("file_path", F.lit("/x.mp4")))
    excluded = sync.sync_folder(folder, kids, clips, none_v, none_c, meta, now, child)
    assert excluded["videos"].count() == 1 and excluded["clips"].count() == 2 and excluded["meta"].first()["last_synced_video_rowid"] == 2
    empty = sync.sync_folder(folder, videos.limit(0), clips.limit(0), none_v, none_c, meta, now)
    assert empty["meta"].count() == 1
    other = sync.importable(videos.withColumn("source_folder", F.lit("/B")), state["videos"])
    assert other.count() == 0 and sync.without_folder(state["clips"], folder).count() == 0


def test_lifecycle(spark):
    schema = "video_id long, file_path string, index_status string, file_hash string, orphaned_at timestamp"
    t = "2024-01-0{}"
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    videos = spark.createDataFrame([(1, "/old1", "orphaned", "h", day(1)), (2, "/old2", "orphaned", "h", day(2)), (3, "/new", "pending", None, None), (4, "/x", "completed", "k", None)], schema)
    arrivals = spark.createDataFrame([("/new", "h")], "file_path string, file_hash string")
    got = {r.video_id: (r.file_path, r.index_status) for r in lifecycle.recovered(videos, arrivals).collect()}
    assert got == {1: ("/old1", "orphaned"), 2: ("/new", "completed"), 4: ("/x", "completed")} and t
    gone = lifecycle.orphaned(videos, spark.createDataFrame([("/x",)], "file_path string"), F.lit(day(9)))
    assert {r.video_id for r in gone.filter("index_status = 'orphaned'").collect()} == {1, 2, 4}
    assert [r.video_id for r in lifecycle.expired(videos, F.lit(day(12)), 10).collect()] == [1] and lifecycle.expired(videos, F.lit(day(12)), 0).count() == 0
    assert lifecycle.register(videos, spark.createDataFrame([("/x",), ("/y",), ("/y",)], "file_path string")).count() == 5
    scan = spark.createDataFrame([("/x", 5, 1), ("/z", 1, 1)], "file_path string, size long, mtime long")
    known = videos.withColumn("file_size", F.lit(5).cast("long")).withColumn("file_modified", F.lit(2).cast("long"))
    asked = []

    def hashes(df):
        asked.append(df.count())
        return df.withColumn("new_hash", F.lit("k"))

    assert {r.file_path: r.action for r in lifecycle.decided(scan, known, hashes).collect()} == {"/x": "refresh", "/z": "index"} and asked == [1]


def test_orphan_recover_takes_the_whole_table(spark, tmp_path, monkeypatch):
    rows = [(0, "a", 5), (1, "a", 9), (2, "a", 7), (3, "b", 1), (4, "c", 1), (6, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    taken, own = [], lifecycle.newest_orphans
    monkeypatch.setattr(lifecycle, "newest_orphans", lambda videos, **options: taken.append(videos) or own(videos, **options))
    assert sorted(r.doc_id for r in catalogue.queries()["orphan_recover"](spark, str(tmp_path)).collect()) == [2, 4]
    assert {r.doc_id: r.index_status for r in taken[0].collect()} == {i: "completed" if i % 2 else "orphaned" for i, _, _ in rows}


def test_events(spark, tmp_path):
    rows = [(1, "/f/x.mp4", "added", "/f"), (2, "/f/y.mp4", "removed", "/f"), (3, "/f/x.mp4", "modified", "/f"), (4, "/g/z.mp4", "added", "/g"), (5, "/g", "rescan", "/g"), (6, "/f/.clip-index/i.mp4", "added", "/f"), (7, "/f/n.txt", "added", "/f")]
    df = spark.createDataFrame(rows, "seq long, path string, kind string, folder string")
    batch = sorted((r.seq, r.path, r.kind, r.route) for r in ev.routed(ev.deduplicated_with_folder(ev.relevant(df))).collect())
    assert batch == [(1, "/f/x.mp4", "modified", "index"), (2, "/f/y.mp4", "removed", "orphan"), (4, "/g/z.mp4", "added", "rescan"), (5, "/g", "rescan", "rescan")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = ev.drain(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda rows, n: got.extend(rows.collect()), str(tmp_path / "check"))
    stream.awaitTermination(120)
    assert sorted((r.seq, r.path, r.kind, r.route) for r in got) == batch
    kind = lambda *a: one(spark, ev.classify(*map(F.lit, a)))
    assert [kind(False, False, False, True, False), kind(False, False, False, False, False), kind(True, True, False, True, False), kind(True, False, False, True, False)] == ["removed", None, "added", "modified"]


def test_sources(spark, tmp_path):
    for name in ("a.mp4", "b.MOV", "c.txt", "sub/d.mkv", "sub/.h.mp4"):
        p = tmp_path / "lib" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * len(name))
    found = [r.file_path.split("/lib/")[1] for r in files.scan_videos(spark, str(tmp_path / "lib")).collect()]
    assert found == ["a.mp4", "b.MOV", "sub/d.mkv"]
    assert files.scan_videos(spark, str(tmp_path / "lib"), [str(tmp_path / "lib/sub")]).count() == 2
    # names that begin with _, a link to a folder and one to a file, a loop, a hidden folder
    for name in ("_e.mp4", "sub/deep/f.MP4", ".trash/g.mp4"):
        p = tmp_path / "lib" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"y")
    (tmp_path / "away").mkdir()
    (tmp_path / "away" / "z.webm").write_bytes(b"zz")
    (tmp_path / "lib" / "link").symlink_to(tmp_path / "away")
    (tmp_path / "lib" / "sub" / "again.mp4").symlink_to(tmp_path / "lib" / "a.mp4")
    (tmp_path / "lib" / "sub" / "loop").symlink_to(tmp_path / "lib")
    found = {r.file_path: r.size for r in files.scan_videos(spark, str(tmp_path / "lib"), [str(tmp_path / "lib/sub/deep")]).collect()}
    assert {p.removeprefix(str(tmp_path)): n for p, n in found.items()} == {"/lib/_e.mp4": 1, "/lib/a.mp4": 5, "/lib/b.MOV": 5, "/lib/sub/d.mkv": 9, "/away/z.webm": 2}
    (tmp_path / "lib" / "sub" / "loop").unlink()
    (tmp_path / "lib" / "sub" / "again.mp4").unlink()
    import xxhash

    hashes = files.hashed_files(spark, str(tmp_path / "lib"))
    assert {r.file_hash for r in hashes.filter("file_path like '%/a.mp4'").collect()} == {xxhash.xxh3_128_hexdigest(b"xxxxx")}
    expected = hashes.withColumn("file_hash", F.when(F.col("file_path").like("%a.mp4"), "no").otherwise(F.col("file_hash"))).unionByName(spark.createDataFrame([("/gone", "z")], "file_path string, file_hash string"))
    assert {r.state for r in files.verified(expected, hashes).collect()} == {"valid", "modified", "missing"}
    assert files.open_table(spark, str(tmp_path / "db"), "clips").count() == 0 and files.open_table(spark, str(tmp_path / "db"), "clips").count() == 0
    frames = spark.createDataFrame([("/t/scene_002_frame_01.jpg",), ("/t/scene_001_frame_02.jpg",), ("/t/scene_001_frame_01.jpg",), ("/t/x.jpg",)], "path string")
    assert [(r.scene, len(r.frames)) for r in files.frame_groups(frames).collect()] == [(1, 2), (2, 1)]


@pytest.mark.parametrize("missing", ["lumenreel.llm", "corpus_pipeline", "zstandard"])
def test_entry_without_the_corpus_subpackage(monkeypatch, missing):
    import importlib
    import sys

    import __spark_entry__ as e

    # None in sys.modules makes an import fail, as a module that isn't there does
    for name in [n for n in sys.modules if n.startswith(("lumenreel.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    names = e.queries()
    assert "hybrid_search" in names and "pipeline" not in names and set(e.oracle_sql()) <= set(names)
    assert (missing == "corpus_pipeline" and importlib.util.find_spec("lumenreel.llm") is not None) or not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_registry_and_options(spark):
    from lumenreel.functions import registry

    assert set(registry.response_schema()["properties"]) == set(registry.columns()) and "subjects array<string>" in registry.record_type()
    assert registry.update_sql("clips", "clip_id").count("?") == 11 and all(c in registry.prompt() for c in registry.columns())
    got = one(spark, registry.options(F.lit('{"skip_stt": true, "orphaned_retention_days": 7}')))
    assert tuple(got) == (True, False, False, "balanced", 7) and tuple(one(spark, registry.options(F.lit(None).cast("string")))) == (False, False, False, "balanced", 30)


def test_embedding(spark):
    from lumenreel.operators import embedding

    clips = spark.createDataFrame([(1, "a b", None, None), (2, " ", None, None), (3, "c", [1.0], "hashing-8"), (4, "a b", [9.0], "other")], "clip_id long, t string, embedding array<float>, embedding_model string")
    got = {r.clip_id: r for r in embedding.fill_embeddings(clips, embedding.HashingProvider(8), F.col("t")).collect()}
    assert got[3].embedding == [1.0] and got[2].embedding is None and got[2].embedding_model is None
    assert got[1].embedding == got[4].embedding and len(got[1].embedding) == 8 and got[4].embedding_model == "hashing-8"
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, embedding array<float>")
    means = {r.clip_id: r.embedding for r in embedding.text_embeddings(clips.select("clip_id", "t"), words, "clip_id", "t").collect()}
    assert means == {1: [0.5, 0.5], 4: [0.5, 0.5]}


def test_command_line(spark, tmp_path, capsys):
    from lumenreel import __main__ as cli

    root = str(tmp_path / "lib")
    for command in ("init", "insert-mock", "embed", "facets"):
        cli.main([command, "--root", root])
    assert {r.clip_id for r in cli.found(spark, root, "platform", "fts", 5).collect()} == {1, 2}
    assert cli.found(spark, root, "zuruckbleiben", "fts", 5).first().clip_id == 2
    cli.main(["search", "--root", root, "--query", "lighthouse"])
    assert "ferry_harbour.webm" in capsys.readouterr().out
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "one.mp4").write_bytes(b"1")
    cli.main(["index", "--root", root, "--folder", str(tmp_path / "media")])
    assert "one.mp4" in capsys.readouterr().out and files.open_table(spark, root, "videos").count() == 5
    # by the stored index now
    assert {r.clip_id for r in cli.found(spark, root, "platform", "fts", 5).collect()} == {1, 2}
    everything = str(tmp_path / "all")
    cli.main(["init", "--root", everything])
    assert cli.synced(spark, everything, root) == {"videos": 5, "clips": 9} and cli.synced(spark, everything, root) == {"videos": 0, "clips": 0}
    clips = files.open_table(spark, everything, "clips").join(files.open_table(spark, everything, "videos").select("video_id", "file_name"), "video_id")
    assert {r.source_clip_id for r in clips.filter("file_name = 'viaduct.mkv'").collect()} == {5, 6, 7}
    cli.main(["sync", "--root", everything, "--folder", root, "--force"])
    assert "'clips': 9" in capsys.readouterr().out and files.open_table(spark, everything, "clips").count() == 9
    (tmp_path / "log").write_text("Duration: 00:01:00.00\npts_time:20\npts_time:20.1\n")
    cli.main(["segments", "--root", root, "--log", str(tmp_path / "log")])
    assert "20.0" in capsys.readouterr().out
