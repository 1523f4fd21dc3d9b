"""Quality rules: a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Method, in DataFrame functions only. A text's tokens (runs of letters and digits, and runs of other characters that
aren't blank, in lower case) and pairs of tokens are hashed into `buckets`. Two multinomials over the buckets are
counted: of all documents (raw) and of the trusted ones (target), with partial counts before the shuffle, so a task
sends at most `buckets` rows. The target is smoothed towards the raw distribution, by `prior` n-grams of it, so that a
bucket without target counts weighs log(prior / (target n-grams + prior)) and a small target isn't taken for another
distribution: with a target like the corpus every weight is near 0 at any size of the two. A document's score is the mean of log(target / raw) over its n-grams, that is
normalised by length, and each document is compared with one fixed threshold. The table of weights has `buckets`
numbers at any size of the corpus and enters the plan as a scalar subquery.

A mean over all n-grams hides a few bad words in good prose, so toxic documents have a second log ratio: of the share
of toxic documents that have a token to the share of trusted ones. Tokens of a high ratio that enough toxic documents
have are markers. A document with two of them isn't kept, nor one with a single marker that many toxic documents have: one
marker of a small language alone may be chance. Markers are compared by 64-bit hash, not by bucket, as plain words share
buckets. Both sides are of good quality, so junk doesn't enter; there are at most (tokens of an average document) /
share markers.

Trusted documents are the labelled ones of good quality that aren't toxic, at most `trusted_rows` of them (those with
the least hash of the id); that bound is what makes their ids safe to broadcast. Counts of the raw corpus and scores
cover all documents and whole texts. Base rules (words, symbols, repeated lines and windows) come with it.

Nulls: a null text has no words and fails the base rules; a null id or label is never trusted. Repeated rows are
documents of their own. Very long texts are taken whole; an empty table gives no rows. Without trusted documents the ratio
is flat and every score is 0. Extra columns are kept; one that has the name of an output keeps its values under that name
with _input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import own, unwrapped, words_of, wrapped

#: Buckets of hashed n-grams, n-grams of the raw distribution that the target is smoothed by, and the mean log ratio that
#: a document must reach.
BUCKETS, PRIOR, THRESHOLD = 1 << 14, 16384.0, -0.3
#: Columns that judged() adds.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Labelled documents that the target is fitted on.
TRUSTED_ROWS = 20_000
#: A marker is in this share of the labelled toxic documents, in so many, and its log ratio reaches the next number; one that
#: the last share of them has is enough by itself.
MARKER_SHARE, MARKER_ROWS, MARKER_RATIO, STRONG_SHARE = 0.02, 5, 3.0, 0.1
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def ngram_hashes(text: Column) -> Column:
    """The hash of each token of a text."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKENS), F.lit(0)), lambda t: F.xxhash64(t))


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    hashed = docs.select(ngram_hashes(F.col(text)).alias("h"))
    previous = F.concat(F.array(F.lit(None).cast("long")), F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(0))))
    # single tokens and pairs in one pass: the pair with the token before; the first pairs with nothing
    both = hashed.select(F.explode_outer(F.arrays_zip(F.col("h"), previous.alias("p"))).alias("x")).select(F.col("x.h").alias("h"), F.col("x.p").alias("p")).filter("h is not null")
    each = both.select(F.explode(F.array(F.pmod("h", F.lit(buckets)), F.pmod(F.xxhash64("p", "h"), F.lit(buckets)))).alias("bucket")).select(F.col("bucket").cast("int"))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def trusted_ids(labels: DataFrame, id_column: str, rows: int, toxic: int = 0) -> DataFrame:
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == toxic) & own(id_column).isNotNull())
    return good.select(own(id_column).alias("trusted")).distinct().orderBy(F.xxhash64("trusted"), "trusted").limit(rows)


def weights(docs: DataFrame, trusted: DataFrame, buckets: int, prior: float) -> DataFrame:
    """One row: `weights`, log(target / raw) of each bucket in order. docs: (id, text); trusted: (trusted)."""
    chosen = docs.join(F.broadcast(trusted), F.col("id") == F.col("trusted"), "left_semi")
    raw = bucket_counts(docs, "text", buckets).select("bucket", F.col("n").alias("r"), F.lit(0).cast("long").alias("t"))
    target = bucket_counts(chosen, "text", buckets).select("bucket", F.lit(0).cast("long").alias("r"), F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t"))
    counts = raw.union(target).union(every).groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    row = counts.agg(F.array_sort(F.collect_list(F.struct("bucket", "r", "t"))).alias("all"), F.sum("r").alias("raw"), F.sum("t").alias("target"))

    def weight(x: Column) -> Column:
        share = x["r"] / F.col("raw")
        return F.log((x["t"] + prior * share) / (F.col("target") + prior)) - F.log(share)

    # no document has an n-gram in a bucket without raw counts
    return row.select(F.transform("all", lambda x: F.when((F.col("target") > 0) & (x["r"] > 0), weight(x)).otherwise(F.lit(0.0))).alias("weights"))


def markers(docs: DataFrame, toxic: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: `markers`, the hashes of tokens that tell toxic documents from trusted ones, and the `strong` among them."""
    ids = toxic.withColumn("toxic", F.lit(1)).union(trusted.withColumn("toxic", F.lit(0)))
    labelled = docs.join(F.broadcast(ids), F.col("id") == F.col("trusted"))
    sizes = labelled.agg(F.struct(F.coalesce(F.sum("toxic"), F.lit(0)).alias("x"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("t")).alias("sizes")).scalar()
    # the outer form, for the reason that kept_rows() gives
    each = labelled.select("toxic", F.explode_outer(F.array_distinct(ngram_hashes(F.col("text")))).alias("h")).filter("h is not null")
    counts = each.groupBy("h").agg(F.sum("toxic").alias("x"), F.sum(1 - F.col("toxic")).alias("t")).filter(F.col("x") >= MARKER_ROWS).withColumn("n", sizes)
    ratio = F.log((F.col("x") + 0.5) / (F.col("n.x") + 1)) - F.log((F.col("t") + 0.5) / (F.col("n.t") + 1))
    often = counts.filter((F.col("x") >= F.col("n.x") * MARKER_SHARE) & (F.col("n.t") > 0) & (ratio >= MARKER_RATIO))
    strong = F.when(F.col("x") >= F.col("n.x") * STRONG_SHARE, F.col("h"))
    return often.agg(F.struct(F.array_sort(F.collect_list("h")).alias("every"), F.array_sort(F.collect_list(strong)).alias("strong")).alias("markers"))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, of columns without clashing names, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    held = docs.withColumn("_words", words_of(F.col(text)))
    held = held.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.slice("_hashes", 1, F.greatest(F.size("_hashes") - 4, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(F.col("_hashes"), i + k) for k in range(1, 5)]))
    held = held.withColumn("_windows", windows)
    # in order of hash and place, a window repeats if a neighbour has its hash; each adds the words up to the next one
    ordered = F.array_sort(F.arrays_zip(F.col("_windows").alias("h"), F.sequence(F.lit(0), F.size("_windows") - 1).alias("i")))
    held = held.withColumn("_several", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    held = held.withColumn("_ordered", F.when(F.col("_several"), ordered))
    twice = F.filter("_ordered", lambda x, i: ((i > 0) & (F.get(F.col("_ordered"), i - 1)["h"] == x["h"])) | F.coalesce(F.get(F.col("_ordered"), i + 1)["h"] == x["h"], F.lit(False)))
    held = held.withColumn("_places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])
    held = held.withColumn("n_words", F.size("_words").cast("long"))
    held = held.withColumn("word_chars", F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"))
    held = held.withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"))
    filled = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = held.withColumn("_lines", filled)
    held = held.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    held = held.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    held = held.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return held.drop("_words", "_hashes", "_windows", "_several", "_ordered", "_places", "_lines")


def verdicts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """(row, base counts, base_failed, score, kept); row has the columns of docs.

    The outer form of explode() keeps the steps apart from what is done with the verdicts: a filter on one would be pushed
    below the steps that make it, each with the arrays before it made anew for every place.
    """
    held = wrapped(docs, id=own(id_column), text=own(text).cast("string"))
    trusted = trusted_ids(labels, id_column, trusted_rows)
    marks = markers(held.select("id", "text"), trusted_ids(labels, id_column, trusted_rows, 1), trusted).scalar()
    table = weights(held.select("id", "text"), trusted, buckets, prior).scalar()
    held = with_base(held).withColumn("_grams", ngram_hashes(F.col("text"))).withColumn("_weights", table).withColumn("_marks", marks)
    one = lambda h: F.get(F.col("_weights"), F.pmod(h, F.lit(buckets)).cast("int"))
    total = F.aggregate("_grams", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("last")), lambda a, h: F.struct((a["sum"] + one(h) + one(F.xxhash64(a["last"], h))).alias("sum"), h.alias("last")), lambda a: a["sum"])
    score = F.when(F.size("_grams") > 0, total / (2 * F.size("_grams"))).otherwise(F.lit(0.0))
    held = held.withColumn("_found", F.array_intersect("_grams", F.col("_marks.every")))
    toxic = (F.size("_found") >= 2) | F.arrays_overlap("_found", F.col("_marks.strong"))
    held = held.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold) & ~toxic)
    return held.select(F.explode_outer(F.array(F.struct("row", *BASE, "score", "kept"))).alias("x")).select("x.*")


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with the base counts, base_failed, score and kept. For options see verdicts()."""
    return unwrapped(verdicts(docs, labels, **options), docs.columns, {c: F.col(c) for c in [*BASE, "score", "kept"]})


def kept_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs whose verdict is to keep them, with their own columns."""
    return unwrapped(verdicts(docs, labels, **options).filter("kept"), docs.columns, {})
