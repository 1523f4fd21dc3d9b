r"""Secret scans: fixed patterns, and a battery of randomness tests over tokens of any look.

Method, in DataFrame functions only. The base kinds are regular expressions; places come from the lengths of the
pieces between matches. For the battery, each run of 20 or more characters of the base-64 alphabets is a candidate.
Its encoding is inferred (decimal, hexadecimal, base 32, lower case with digits, base 64), which gives the alphabet
of A symbols; then

* chi-squared: X = A / n * (sum of squared counts) - n, against its mean A - 1 for uniform symbols;
* runs of symbols above and below the middle of the alphabet;
* serial correlation of neighbours.

A candidate that fails one of the tests (z above `fails`: 3.3 turns away one random token in a thousand by each test) isn't
random. The others get the probability that a token of
that length whose symbols are distributed like written text shows an X so small, from the mean and the variance of the
number of equal pairs among independent symbols of written frequencies; short tokens can't show much, so the
test is aware of length. Discoveries are then controlled by Benjamini-Hochberg within classes of length: counts of
candidates by class and bin of the probability, a table of fixed size, give each class its limit. Every candidate of
all documents counts. The kind of these spans is `random`.

Nulls: a null text is empty. Null and repeated ids are rows of their own. Very long texts are taken whole: matches are
placed in blocks, so the work grows with their number. Extra columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, own

#: Kind, pattern, the group whose length counts, and its least length (fixed values).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Pattern, alphabet, and the chance that two symbols of written text in it are equal.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    (r"^[0-9]+$", DIGITS, 0.16),
    (r"^[0-9a-f]+$", DIGITS + "abcdef", 0.12),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.12),
    (r"^[A-Z2-7]+$", LOWER.upper() + "234567", 0.066),
    (r"^[0-9a-z]+$", LOWER + DIGITS, 0.066),
    (r"^[0-9A-Z]+$", LOWER.upper() + DIGITS, 0.066),
    (r"", LOWER.upper() + LOWER + DIGITS + "+/", 0.06),
)
#: Matches that one fold places.
BLOCK = 256
#: By how much the chance of three equal symbols of written text is over the square of that of two (from letters' frequencies).
SKEW = 0.24
#: Bins of the probability, a class and unit of -log p.
BINS, BIN = 256, 0.125


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, part) of each match of a pattern, in code points; part: the group's text.

    Matches are placed by adding up the lengths of gaps and matches, in blocks whose lengths are added up first: a fold that
    appends to an array copies it each time, so it must not run over all matches of a text.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), parts.alias("part"))
    none = F.array().cast("array<struct<start:int,end:int,part:string>>")
    # the last gap has no match after it
    reach = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))

    def placed(block: Column, at: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["gap"])
            span = F.struct(start.alias("start"), (start + F.length(x["whole"])).alias("end"), x["part"].alias("part"))
            return F.struct((a["at"] + reach(x)).alias("at"), F.when(x["whole"].isNotNull(), F.array_append(a["found"], span)).otherwise(a["found"]).alias("found"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step, lambda a: a["found"])

    def in_blocks(z: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int"))
        lengths = F.transform(numbers, lambda b: F.aggregate(F.slice(z, b * BLOCK + 1, BLOCK), F.lit(0), lambda n, x: n + reach(x)))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
        return F.flatten(F.zip_with(numbers, starts, lambda b, at: F.when(b.isNotNull(), placed(F.slice(z, b * BLOCK + 1, BLOCK), at)).otherwise(none)))

    # as a lambda's variable the matches are found once, however often they are used
    found = F.get(F.transform(F.array(zipped), lambda z: F.when(F.size(z) <= BLOCK, placed(z, F.lit(0))).otherwise(in_blocks(z))), 0)
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column, order: int) -> Column:
    """(start, kind, end) of each match of a base kind whose group is long enough."""
    kind, pattern, group, least = BASE[order]
    long_enough = F.filter(places(text, pattern, group), lambda x: F.length(x["part"]) >= least)
    return F.transform(long_enough, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end"))).alias(kind)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, by a logistic approximation (off by 0.0002 at most)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565992 * z * z * z)))


def battery(token: Column, fails: float) -> Column:
    """(class, bin) of a candidate; bin is null where a test fails."""
    alphabet, size, alike = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for pattern, letters, same in reversed(ENCODINGS):
        fits = token.rlike(pattern) if pattern else F.lit(True)
        alphabet, size, alike = F.when(fits, letters).otherwise(alphabet), F.when(fits, float(len(letters))).otherwise(size), F.when(fits, same).otherwise(alike)
    plain = F.translate(token, "-_", "+/")
    return F.struct(F.length(token).cast("double").alias("n"), size.alias("size"), alike.alias("alike"), F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.position(c, alphabet).cast("double") - 1).alias("v"), F.lit(fails).alias("fails"))


def measured(df: DataFrame) -> DataFrame:
    """Rows of one candidate each, with `class` and `bin` from the struct `t` of battery()."""
    n, size, v = F.col("t.n"), F.col("t.size"), F.col("t.v")
    run = F.aggregate(F.array_sort(v), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1.0)).alias("run"), (a["sum"] + F.when(x == a["last"], 2 * a["run"] + 1).otherwise(F.lit(1.0))).alias("sum")), lambda a: a["sum"])
    df = df.withColumn("x", size / n * run - n).withColumn("mean", F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n)
    middle, mean = size / 2, F.col("mean")
    walk = F.aggregate(
        v,
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("high"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("square")),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["high"] + F.when(x >= middle, 1.0).otherwise(0.0)).alias("high"),
            (a["runs"] + F.when(a["last"].isNotNull() & ((x >= middle) != (a["last"] >= middle)), 1.0).otherwise(0.0)).alias("runs"),
            (a["cross"] + F.coalesce((x - mean) * (a["last"] - mean), F.lit(0.0))).alias("cross"),
            (a["square"] + (x - mean) * (x - mean)).alias("square"),
        ),
    )
    df = df.withColumn("w", walk)
    high, low = F.col("w.high"), n - F.col("w.high")
    expected = 2 * high * low / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    chi = (F.col("x") - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    runs = F.abs(F.col("w.runs") - expected) / spread
    serial = F.when(F.col("w.square") > 0, F.abs(F.col("w.cross") / F.col("w.square")) * F.sqrt(n)).otherwise(F.lit(1e9))
    random = (chi < F.col("t.fails")) & (runs < F.col("t.fails")) & (serial < F.col("t.fails"))
    written = (size - 1) + (n - 1) * (size * F.col("t.alike") - 1)
    # equal pairs of n independent symbols: their number's variance, in units of X
    triples = SKEW * F.col("t.alike") * F.col("t.alike") * n * (n - 1) * (n - 2)
    wide = 2 * size / n * F.sqrt(n * (n - 1) / 2 * F.col("t.alike") * (1 - F.col("t.alike")) + triples)
    p = normal_cdf(F.greatest((F.col("x") - written) / wide, F.lit(-8.0)))
    units = F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-30))) / BIN), F.lit(BINS - 1)).cast("int")
    return df.withColumn("class", F.floor(F.log2(n) * 2).cast("int")).withColumn("bin", F.when(random, units))


def limits(found: DataFrame, rate: float) -> DataFrame:
    """(class, least): the least bin that Benjamini-Hochberg at `rate` lets through in each class."""
    counts = found.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))
    smaller = Window.partitionBy("class").orderBy(F.col("bin").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("class")
    passed = counts.withColumn("upto", F.sum("n").over(smaller)).withColumn("all", F.sum("n").over(every))
    passed = passed.filter(F.col("bin").isNotNull() & (F.exp(-F.col("bin") * BIN) <= rate * F.col("upto") / F.col("all")))
    return passed.groupBy("class").agg(F.min("bin").alias("least"))


def scanned(spark: SparkSession, docs: DataFrame, rate: float = 0.05, fails: float = 3.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row; spans are kind:start:end in code points."""
    scratch = Scratch(spark)
    held = docs.select(own(id_column).alias("doc_id"), F.coalesce(own(text_column).cast("string"), F.lit("")).alias("_t"))
    kinds = [base_spans(F.col("_t"), order) for order in range(len(BASE))]
    held = held.select("doc_id", *kinds, places(F.col("_t"), CANDIDATE).alias("candidates"))
    held = scratch.keep(held.withColumn("row", F.monotonically_increasing_id()), "found")
    each = held.filter(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.start", "c.end", battery(F.col("c.part"), fails).alias("t"))
    each = scratch.keep(measured(each).select("row", "start", "end", "class", "bin"), "candidates")
    passed = each.join(F.broadcast(limits(each, rate)), "class").filter("bin >= least")  # a row for each class of length
    more = passed.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(BASE)).alias("kind"), "end")).alias("random"))
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("random"))
    both = held.join(more, "row", "left")

    def joined(*spans: Column) -> Column:
        ordered = F.array_sort(F.concat(*spans))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    base = [F.col(k) for k, *_ in BASE]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return both.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE], F.sha2(joined(*base), 256).alias("base_sha256"), joined(*base, F.coalesce("random", none)).alias("spans"))
