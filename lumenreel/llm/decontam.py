"""Benchmark decontamination: test items inside documents, by size-partitioned MinHash containment search.

Method, in DataFrame functions only. An item and a document are sets of hashed shingles of `size` words (runs of
letters and digits, in lower case); an item of fewer words is one shingle of all its words, and documents then show their
runs of so many words too. Items are partitioned by their number q of shingles; an item's sketch is its k smallest hashes
with k = q - ceil(q * containment) + 1, the least number with which a document that holds the required share of the item
must hold a hash of the sketch, however long the document is: no true pair is lost to chance. Each partition has a least
number of shingles that a document must have to hold one of its items, and a largest sketch hash. A document is asked only
about partitions that it is large enough for, and shows only hashes up to the largest of those, which an array filter
sees to before anything is exploded or joined. Candidates are verified on the shingles themselves, as text.

The sketches are broadcast only if their number is at most `broadcast_rows`, else joined by a shuffle.

Nulls: a null text or one without words matches nothing. contained() leaves out null ids, as it reports ids;
without_items() judges rows by their text, so it drops rows without an id, and rows that share one, each for itself. Items
with equal text are each reported; rows of documents that share an id are reported once, with the most that one of
them holds. Very long texts are taken whole; empty tables give no pairs. Extra columns are ignored by contained() and kept
by without_items(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, own, unwrapped, wrapped

#: Sketch hashes that may be broadcast (16 bytes each).
BROADCAST_ROWS = 2_000_000
#: Bounds of the partitions of items by their number of shingles.
SIZES = (8, 16, 32, 64, 128, 256, 1024)


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(hashed: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, one for each place, from the words' hashes; of fewer words: none."""
    places = F.slice(hashed, 1, F.greatest(F.size(hashed) - (size - 1), F.lit(0)))
    return F.transform(places, lambda h, i: F.xxhash64(F.lit(size), h, *[F.get(hashed, i + k) for k in range(1, size)]))


def shingles(words: Column, size: int) -> Column:
    """The distinct runs of `size` words as text; of fewer words: none."""
    # get() takes a place in a row's array as it is, where slice() would copy the whole array for each place
    run = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    return F.when(F.size(words) >= size, F.array_distinct(F.transform(places, run))).otherwise(F.array().cast("array<string>"))


def of_widths(make, source: Column, widths: list[int]) -> Column:
    """make(source, width) for each width, in one array."""
    return F.concat(*[make(source, w) for w in widths]) if len(widths) > 1 else make(source, widths[0])


def with_hashes(df: DataFrame, text: str, widths: list[int], out: str) -> DataFrame:
    """df with `out`, hashes of a text's shingles. The words' hashes are a column, so that they are made once a row."""
    held = df.withColumn("_hashed", F.transform(plain_words(F.col(text)), lambda w: F.xxhash64(w)))
    return held.withColumn(out, of_widths(shingle_hashes, F.col("_hashed"), widths)).drop("_hashed")


def with_shingles(df: DataFrame, text: str, widths: list[int], out: str) -> DataFrame:
    held = df.withColumn("_words", plain_words(F.col(text)))
    return held.withColumn(out, of_widths(shingles, F.col("_words"), widths)).drop("_words")


def sketches(items: DataFrame, containment: float, size: int) -> DataFrame:
    """(item_id, width, shingles, need, sketch, size_class) of each item with words; need: shingles that must be shared."""
    held = items.filter(F.col("item_id").isNotNull()).withColumn("_words", plain_words(F.col("text"))).filter(F.size("_words") > 0)
    held = held.withColumn("width", F.least(F.size("_words"), F.lit(size)))
    held = held.withColumn("_hashed", F.transform("_words", lambda w: F.xxhash64(w)))
    found, texts = F.array().cast("array<long>"), F.array().cast("array<string>")
    for w in range(1, size + 1):
        found = F.when(F.col("width") == w, shingle_hashes(F.col("_hashed"), w)).otherwise(found)
        texts = F.when(F.col("width") == w, shingles(F.col("_words"), w)).otherwise(texts)
    held = held.select("item_id", "width", texts.alias("shingles"), F.array_sort(F.array_distinct(found)).alias("hashes"))
    q = F.size("hashes")
    held = held.withColumn("need", F.ceil(q * F.lit(containment)).cast("int"))
    partition = sum((F.when(q > top, 1).otherwise(0) for top in SIZES), F.lit(0))
    return held.withColumn("sketch", F.slice("hashes", 1, q - F.col("need") + 1)).withColumn("size_class", partition).drop("hashes")


def shown(hashes: Column, classes: list[tuple[int, int]]) -> Column:
    """The hashes that a document shows, up to the largest top of the partitions (need, top) that it is large enough for."""
    if not classes:
        return F.array().cast("array<long>")
    limit = F.greatest(F.lit(-(2**63)), *[F.when(F.size(hashes) >= need, F.lit(top)) for need, top in classes])
    return F.filter(hashes, lambda h: h <= limit)


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, containment: float = 0.8, size: int = 5, broadcast_rows: int = BROADCAST_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): the pairs in which the document holds that share of the item's shingles."""
    scratch = Scratch(spark)
    held = scratch.keep(sketches(items.select("item_id", "text").distinct(), containment, size), "items")
    # of each partition of items the least need and the largest sketch hash, and the widths of short items: few rows
    tops = held.groupBy("size_class").agg(F.min("need").alias("need"), F.max(F.element_at("sketch", -1)).alias("top")).collect()
    widths = sorted({size} | {r["width"] for r in held.select("width").distinct().collect()})
    classes = [(r["need"], r["top"]) for r in tops]
    sketch = scratch.keep(held.select("item_id", F.explode("sketch").alias("hash")), "sketch")
    rows = sketch.count()
    texts = docs.filter(own(id_column).isNotNull()).select(own(id_column).alias("doc_id"), own(text_column).cast("string").alias("text"))
    # the outer form: for the inner one, a filter on the array would be pushed down and make the array many times
    hashed = with_hashes(texts, "text", widths, "hashes").select("doc_id", F.explode_outer(shown(F.col("hashes"), classes)).alias("hash")).filter("hash is not null")
    if rows <= broadcast_rows:
        found = hashed.join(F.broadcast(sketch.select("hash").distinct()), "hash")
        found = found.distinct().join(F.broadcast(sketch), "hash")
    else:
        found = hashed.distinct().join(sketch, "hash")
    candidates = scratch.keep(found.select("doc_id", "item_id").distinct(), "candidates")
    ids = candidates.select("doc_id").distinct()
    near = with_shingles(texts.join(ids, "doc_id", "left_semi"), "text", widths, "own").select("doc_id", "own")
    # each candidate document's shingles that any of its items has, then counted for each item
    both = near.join(candidates, "doc_id").join(held.select("item_id", "shingles", "need"), "item_id")
    exact = both.select("doc_id", "item_id", F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_shared"), F.size("shingles").cast("long").alias("n_item"))
    exact = exact.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(containment)))
    return exact.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def without_items(spark: SparkSession, docs: DataFrame, items: DataFrame, containment: float = 0.8, size: int = 5, text_column: str = "text") -> DataFrame:
    """The rows of docs in which no item is found. Rows are told by their text, so an id isn't needed."""
    text = own(text_column).cast("string")
    keyed = wrapped(docs, key=F.md5(F.encode(text, "utf-8")), text=text)
    found = contained(spark, keyed.select("key", "text"), items, containment, size, id_column="key").select("doc_id").distinct()
    return unwrapped(keyed.join(found, F.col("key") == F.col("doc_id"), "left_anti"), docs.columns, {})


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 5) AS width FROM b WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM i),
ds AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k+width-1], ' '))) AS s FROM d, widths WHERE len(w) >= width),
si AS (SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k+width-1], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item
FROM ds JOIN si USING (width, s) JOIN n USING (item_id) GROUP BY doc_id, item_id
HAVING count(*) >= ceil(any_value(n_item) * 0.8::DOUBLE)
"""
