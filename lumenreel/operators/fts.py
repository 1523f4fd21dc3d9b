"""Full-text search: a query language, BM25, and what a stored index needs.

A query is parsed into a tree of units (phrases, and groups of phrases near each other) under AND, OR and NOT. Over a
table, texts become token arrays once for each pass, behind a step that the optimiser doesn't copy; a phrase's occurrences
are an expression on them, so two passes without a shuffle give statistics and scores, and only the best rows meet in one
place. Over an index, only the phrases' postings are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions.text import plain_query_tokens, unicode_tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Bytes a core below which a table is dealt out anew.
SPREAD_BYTES = 16 << 20
#: Tokens that may lie between the phrases of a NEAR group that doesn't say (a fixed value of the query language).
NEAR_TOKENS = 10


class FtsSyntaxError(ValueError):
    """A query that can't be parsed."""


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row; the last may be a prefix; in all columns or some; perhaps only where a column begins."""

    terms: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases in one column with at most so many tokens between the first's end and the last's begin."""

    phrases: tuple[Phrase, ...]
    tokens: int
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Node:
    """AND, OR or NOT of two sides."""

    op: str
    left: Node | Phrase | Near
    right: Node | Phrase | Near


TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()*:^+{},-])|([^\s()*:"^+{},-]+))')
KEYWORDS = ("AND", "OR", "NOT")


class Parser:
    """Query text to a tree. Implicit AND binds closest, then NOT, AND, OR."""

    def __init__(self, text: str, columns: tuple[str, ...], tokens: Callable[[str], list[str]]):
        self.columns, self.tokens, self.parts, at = columns, tokens, [], 0
        text = text.rstrip()
        while at < len(text):
            found = TOKEN.match(text, at)
            if not found:
                raise FtsSyntaxError(f"unterminated string at {at}")
            kind = "string" if found[1] is not None else "mark" if found[2] else "word"
            self.parts.append((kind, found[1] or found[2] or found[3]))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.parts[self.at] if self.at < len(self.parts) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.parts[self.at - 1]

    def parse(self) -> Node | Phrase | Near | None:
        if not self.parts:
            return None
        tree = self.either()
        if self.peek()[0] != "end":
            raise FtsSyntaxError(f"unexpected {self.peek()[1]!r}")
        return tree

    def chain(self, op: str, below: Callable) -> Node | Phrase | Near:
        tree = below()
        while self.peek() == ("word", op):
            self.take()
            tree = Node(op, tree, below())
        return tree

    def either(self):
        return self.chain("OR", self.both)

    def both(self):
        return self.chain("AND", self.without)

    def without(self):
        return self.chain("NOT", self.implied)

    def starts_unit(self) -> bool:
        kind, value = self.peek()
        return (kind in ("string", "word") and value not in KEYWORDS) or (kind, value) in (("mark", "^"), ("mark", "{"), ("mark", "-"))

    def implied(self):
        if self.peek() == ("mark", "("):
            return self.group(None)
        tree = self.unit()
        while self.starts_unit() or self.peek() == ("mark", "("):
            if self.peek() == ("mark", "("):
                raise FtsSyntaxError("AND is needed before (")
            tree = Node("AND", tree, self.unit())
        return tree

    def group(self, columns):
        self.take()
        tree = self.either()
        self.expect(")")
        return within(tree, columns)

    def expect(self, mark: str) -> None:
        if self.peek() != ("mark", mark):
            raise FtsSyntaxError(f"{mark} is missing")
        self.take()

    def named(self) -> tuple[str, ...] | None:
        """The columns before a colon, if there are any: a name, a set in braces, or either after - for all others."""
        at, other = self.at, False
        if self.peek() == ("mark", "-"):
            self.take()
            other = True
        kind, value = self.peek()
        if (kind, value) == ("mark", "{"):
            self.take()
            names = []
            while self.peek()[0] in ("string", "word"):
                names.append(self.take()[1].strip('"'))
            self.expect("}")
        elif kind in ("string", "word"):
            names = [self.take()[1].strip('"')]
        else:
            names = []
        if not names or self.peek() != ("mark", ":"):
            if other or (kind, value) == ("mark", "{"):
                raise FtsSyntaxError("a column is missing before :")
            self.at = at
            return None
        self.take()
        known = {c.lower(): c for c in self.columns}
        for n in names:
            if n.lower() not in known:
                raise FtsSyntaxError(f"no such column: {n}")
        chosen = [known[n.lower()] for n in names]
        return tuple(c for c in self.columns if (c in chosen) != other)

    def unit(self):
        columns = self.named()
        if columns is not None and self.peek() == ("mark", "("):
            return self.group(columns)
        after = self.parts[self.at + 1] if self.at + 1 < len(self.parts) else ("end", "")
        if self.peek() == ("word", "NEAR") and after == ("mark", "("):
            return self.near(columns)
        return self.phrase(columns)

    def near(self, columns):
        self.take()
        self.take()
        found, tokens = [], NEAR_TOKENS
        while self.starts_unit():
            found.append(self.phrase(None))
        if self.peek() == ("mark", ","):
            self.take()
            kind, value = self.take() if self.at < len(self.parts) else ("end", "")
            if kind != "word" or not value.isdecimal():
                raise FtsSyntaxError("a number is missing after ,")
            tokens = int(value)
        self.expect(")")
        found = [p for p in found if p.terms]
        if len(found) == 1:
            return within(found[0], columns)
        return Near(tuple(found), tokens, columns) if found else Phrase((), columns=columns)

    def phrase(self, columns) -> Phrase:
        first = self.peek() == ("mark", "^")
        if first:
            self.take()
        terms = list(self.words())
        while self.peek() == ("mark", "+"):
            self.take()
            terms += self.words()
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(tuple(terms), prefix, columns, first)

    def words(self) -> list[str]:
        kind, value = self.peek()
        if kind not in ("string", "word") or value in KEYWORDS:
            raise FtsSyntaxError(f"a term is missing before {value!r}")
        self.take()
        if kind == "word" and not all(c.isalnum() or c == "_" or ord(c) > 127 for c in value):
            raise FtsSyntaxError(f"bad term {value!r}")
        return self.tokens(value[1:-1].replace('""', '"') if kind == "string" else value)


def within(tree, columns: tuple[str, ...] | None):
    """A tree whose units are looked for in these columns only."""
    if columns is None:
        return tree
    if isinstance(tree, Node):
        return Node(tree.op, within(tree.left, columns), within(tree.right, columns))
    both = columns if tree.columns is None else tuple(c for c in tree.columns if c in columns)
    return Near(tree.phrases, tree.tokens, both) if isinstance(tree, Near) else Phrase(tree.terms, tree.prefix, both, tree.first)


def parse(text: str, columns: tuple[str, ...] = (), tokens: Callable[[str], list[str]] = plain_query_tokens) -> Node | Phrase | Near | None:
    """The tree of a query; None of a blank one."""
    return Parser(text, columns, tokens).parse()


def units(tree: Node | Phrase | Near | None) -> list[Phrase | Near]:
    if not isinstance(tree, Node):
        return [] if tree is None else [tree]
    return list(dict.fromkeys(units(tree.left) + units(tree.right)))


def scored(tree) -> list[Phrase]:
    """The phrases that a score is made of."""
    return list(dict.fromkeys(p for u in units(tree) for p in (near_phrases(u) if isinstance(u, Near) else [u])))


def near_phrases(near: Near) -> list[Phrase]:
    return [within(p, near.columns) for p in near.phrases]


def fits(x: Column, phrase: Phrase, k: int) -> Column:
    last = k == len(phrase.terms) - 1
    return F.startswith(x, F.lit(phrase.terms[k])) if last and phrase.prefix else x == F.lit(phrase.terms[k])


def begins(tokens: Column, phrase: Phrase) -> Callable[[Column, Column], Column]:
    """Whether a phrase begins at a token and its place."""

    def here(x: Column, i: Column) -> Column:
        out = fits(x, phrase, 0)
        for k in range(1, len(phrase.terms)):
            out = out & F.coalesce(fits(F.get(tokens, i + k), phrase, k), F.lit(False))
        return out & (i == 0) if phrase.first else out

    return here


def occurrences(tokens: Column, phrase: Phrase) -> Column:
    """How often a phrase is in an array of tokens."""
    if not phrase.terms:
        return F.lit(0)
    if len(phrase.terms) == 1 and not phrase.first:
        return F.size(F.filter(tokens, lambda x: fits(x, phrase, 0)))
    return F.size(F.filter(tokens, begins(tokens, phrase)))


def places(tokens: Column, phrase: Phrase) -> Column:
    """Where a phrase begins, in order."""
    here = begins(tokens, phrase)
    at = F.transform(tokens, lambda x, i: F.when(here(x, i), i))
    return F.filter(at, lambda x: x.isNotNull())


def close_places(found: list[Column], phrases: tuple[Phrase, ...], tokens: int) -> list[Column]:
    """Of each phrase the places that lie with one of each other phrase in a stretch that is short enough.

    A stretch ends at a place m of some phrase, and each phrase has a place in it from m - tokens - its length on.
    """
    def reaches(q: Column, m: Column, p: Phrase) -> Column:
        return (q <= m) & (q >= m - tokens - len(p.terms))

    def has_one(f: Column, p: Phrase, m: Column) -> Column:
        return F.exists(f, lambda q: reaches(q, m, p))

    def whole(m: Column) -> Column:
        out = F.lit(True)
        for f, p in zip(found, phrases, strict=True):
            out = out & has_one(f, p, m)
        return out

    ends = F.filter(F.concat(*found), whole)

    def close(f: Column, p: Phrase) -> Column:
        return F.filter(f, lambda q: F.exists(ends, lambda m: reaches(q, m, p)))

    return [close(f, p) for f, p in zip(found, phrases, strict=True)]


def combined(tree: Node | Phrase | Near, score: dict) -> Column:
    """A tree's score from those of its units; null: no match."""
    if not isinstance(tree, Node):
        return score[tree]
    a, b = combined(tree.left, score), combined(tree.right, score)
    if tree.op == "AND":
        return a + b
    return F.when(b.isNull(), a) if tree.op == "NOT" else F.coalesce(a + b, a, b)


def weight_of(n: Column, rows: Column) -> Column:
    """The weight of a phrase that n of so many rows have."""
    raw = F.log((rows - n + 0.5) / (n + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def weighted(f: Column, weight: Column, length: Column, mean: Column) -> Column:
    """A phrase's share of a BM25 score; null where it doesn't occur."""
    return F.when(f > 0, weight * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean)))


def barrier(df: DataFrame, *columns: Column) -> DataFrame:
    """df's rows as these columns, made once: the optimiser copies nothing through an outer explode."""
    return df.select(F.explode_outer(F.array(F.struct(*columns))).alias("_x")).select("_x.*")


def spread(docs: DataFrame, *columns: str) -> DataFrame:
    """These columns of docs, dealt out to all cores where docs is too small for its files to be.

    Files are read by row groups, so one task would tokenise a table of a few. The exchange is bounded by SPREAD_BYTES a core,
    and passes over the same table share it.
    """
    rows, cores = docs.select(*columns), docs.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < SPREAD_BYTES * cores else rows


def counted_units(held: DataFrame, parts: list, columns: tuple[str, ...], kept: list[str]) -> DataFrame:
    """`kept` columns, and of the n-th unit _f{n} (a phrase) or _f{n}_{k} (the k-th phrase of a NEAR group)."""
    counts, length = [], sum((F.size(f"_t_{c}") for c in columns), F.lit(0)).alias("_dl")
    for i, unit in enumerate(parts):
        where = columns if unit.columns is None else unit.columns
        if isinstance(unit, Phrase):
            counts.append(sum((occurrences(F.col(f"_t_{c}"), unit) for c in where), F.lit(0)).alias(f"_f{i}"))
            continue
        close = [close_places([places(F.col(f"_t_{c}"), p) for p in unit.phrases], unit.phrases, unit.tokens) for c in where]
        for k in range(len(unit.phrases)):
            counts.append(sum((F.size(x[k]) for x in close), F.lit(0)).alias(f"_f{i}_{k}"))
    return barrier(held, *[F.col(k) for k in kept], length, *counts)


def total_score(tree, parts: list, idf: dict[Phrase, Column], length: Column, mean: Column) -> Column:
    """A tree's score from the columns of counted_units() and the phrases' weights."""
    scores = {}
    for i, unit in enumerate(parts):
        if isinstance(unit, Phrase):
            scores[unit] = weighted(F.col(f"_f{i}"), idf[unit], length, mean)
        else:
            scores[unit] = sum((weighted(F.col(f"_f{i}_{k}"), idf[p], length, mean) for k, p in enumerate(near_phrases(unit))), F.lit(0.0))
    return combined(tree, scores)


def ranked(docs: DataFrame, query: str, id_column: str, columns: tuple[str, ...], tokens: Callable[[Column], Column] = unicode_tokens, query_tokens: Callable[[str], list[str]] = plain_query_tokens, on_error: str = "raise") -> DataFrame:
    """(id, rank) of the rows that match; rank is the negative BM25 score. A blank query matches nothing."""
    empty = docs.select(id_column, F.lit(0.0).alias("rank")).limit(0)
    try:
        tree = parse(query.strip(), columns, query_tokens)
    except FtsSyntaxError:
        if on_error == "empty":
            return empty
        raise
    parts, phrases = units(tree), scored(tree)
    if not parts:
        return empty
    held = barrier(spread(docs, id_column, *columns), F.col(id_column), *[tokens(F.col(c)).alias(f"_t_{c}") for c in columns])
    # of a phrase in a NEAR group the weight comes from all rows that have the phrase
    alone = [p for p in phrases if p not in parts]
    counted = counted_units(held, [*parts, *alone], columns, [id_column])
    at = {p: f"_f{[*parts, *alone].index(p)}" for p in phrases}
    matched = [F.count_if(F.col(at[p]) > 0).cast("double").alias(f"_n{i}") for i, p in enumerate(phrases)]
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("_rows"), F.avg("_dl").alias("_mean"), *matched)
    both = counted.join(F.broadcast(stats))  # the statistics are one row
    idf = {p: weight_of(F.col(f"_n{i}"), F.col("_rows")) for i, p in enumerate(phrases)}
    return both.select(id_column, (-total_score(tree, parts, idf, F.col("_dl"), F.col("_mean"))).alias("rank")).filter("rank is not null")


def search(docs: DataFrame, query: str, id_column: str, columns: tuple[str, ...], limit: int = 50, **options) -> DataFrame:
    """The best `limit` matches, best first; ties by id."""
    return ranked(docs, query, id_column, columns, **options).orderBy("rank", id_column).limit(limit)


def token_rows(docs: DataFrame, id_column: str, columns: tuple[str, ...], tokens: Callable[[Column], Column], more: tuple[str, ...] = ()) -> DataFrame:
    """docs' id and `more` with dl, the number of tokens, and the arrays of tokens by column name."""
    held = barrier(spread(docs, *dict.fromkeys([id_column, *more, *columns])), F.col(id_column), *[F.col(c) for c in more], *[tokens(F.col(c)).alias(f"_t_{c}") for c in columns])
    return held.withColumn("dl", sum((F.size(f"_t_{c}") for c in columns), F.lit(0)))


def postings(docs: DataFrame, id_column: str, columns: tuple[str, ...], tokens: Callable[[Column], Column] = unicode_tokens, more: tuple[str, ...] = ()) -> DataFrame:
    """The inverted index: (term, id, more..., col, positions, dl). No shuffle: a text's tokens are grouped within its row.

    Places are sorted by token, so a term's places are neighbours: a term begins where the token before is another, and its
    places are the slice up to where the next term begins.
    """
    held = token_rows(docs, id_column, columns, tokens, more)
    parts = F.array(*[F.struct(F.lit(c).alias("col"), F.array_sort(F.transform(F.col(f"_t_{c}"), lambda t, i: F.struct(t.alias("t"), i.alias("i")))).alias("s")) for c in columns])
    each = held.select(id_column, *more, "dl", F.explode_outer(parts).alias("p")).select(id_column, *more, "dl", "p.col", F.col("p.s").alias("s"))
    starts = F.filter(F.transform("s", lambda x, i: F.when((i == 0) | (F.get(F.col("s"), i - 1)["t"] != x["t"]), i)), lambda i: i.isNotNull())
    each = barrier(each, F.col(id_column), *[F.col(c) for c in more], F.col("dl"), F.col("col"), F.col("s"), starts.alias("b"))
    terms = F.transform("b", lambda at, k: F.struct(F.get(F.col("s"), at)["t"].alias("term"), F.transform(F.slice("s", at + 1, F.coalesce(F.get(F.col("b"), k + 1), F.size("s")) - at), lambda x: x["i"]).alias("positions")))
    return each.select(id_column, *more, "dl", "col", F.explode(terms).alias("x")).select("x.term", id_column, *more, "col", "x.positions", "dl")


def doc_stats(docs: DataFrame, columns: tuple[str, ...], tokens: Callable[[Column], Column] = unicode_tokens) -> DataFrame:
    """One row: n_docs and mean length."""
    length = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
    return spread(docs, *columns).select(length.alias("dl")).agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg("dl").alias("avgdl"))


def wanted(phrases: list[Phrase]) -> Column:
    """Which rows of an index hold a term of the phrases."""
    out = F.lit(False)
    for p in phrases:
        for k in range(len(p.terms)):
            out = out | fits(F.col("term"), p, k)
    return out


def index_search(index: DataFrame, stats: DataFrame, query: str, id_column: str, columns: tuple[str, ...], limit: int = 50, query_tokens: Callable[[str], list[str]] = plain_query_tokens) -> DataFrame:
    """search() over an index: reads the postings of the query's terms only, and groups them by document once."""
    tree = parse(query.strip(), columns, query_tokens)
    parts, phrases = units(tree), scored(tree)
    if not any(p.terms for p in phrases):
        return index.select(id_column, F.lit(0.0).alias("rank")).limit(0)
    rows = index.filter(wanted(phrases)).groupBy(id_column).agg(F.first("dl").alias("_dl"), F.collect_list(F.struct("term", "col", "positions")).alias("_w"))

    def term_places(phrase: Phrase, column: str, k: int) -> Column:
        found = F.filter("_w", lambda w: (w["col"] == column) & fits(w["term"], phrase, k))
        return F.transform(F.flatten(F.transform(found, lambda w: w["positions"])), lambda x: x - k)

    def at(phrase: Phrase, column: str) -> Column:
        """Where a phrase begins in a column, from the document's postings."""
        out = None
        for k in range(len(phrase.terms)):
            found = term_places(phrase, column, k)
            out = found if out is None else F.array_intersect(out, found)
        if out is None:
            return F.array().cast("array<int>")
        return F.filter(out, lambda x: x == 0) if phrase.first else F.array_distinct(out)

    alone = [p for p in phrases if p not in parts]
    counts = []
    for i, unit in enumerate([*parts, *alone]):
        where = columns if unit.columns is None else unit.columns
        if isinstance(unit, Phrase):
            counts.append(sum((F.size(at(unit, c)) for c in where), F.lit(0)).alias(f"_f{i}"))
            continue
        close = [close_places([at(p, c) for p in unit.phrases], unit.phrases, unit.tokens) for c in where]
        counts += [sum((F.size(x[k]) for x in close), F.lit(0)).alias(f"_f{i}_{k}") for k in range(len(unit.phrases))]
    counted = barrier(rows, F.col(id_column), F.col("_dl"), *counts)
    n = counted.agg(*[F.count_if(F.col(f"_f{[*parts, *alone].index(p)}") > 0).cast("double").alias(f"_n{i}") for i, p in enumerate(phrases)])
    both = counted.join(F.broadcast(n)).join(F.broadcast(stats))  # one row each
    idf = {p: weight_of(F.col(f"_n{i}"), F.col("n_docs")) for i, p in enumerate(phrases)}
    total = total_score(tree, parts, idf, F.col("_dl"), F.col("avgdl"))
    return both.select(id_column, (-total).alias("rank")).filter("rank is not null").orderBy("rank", id_column).limit(limit)
