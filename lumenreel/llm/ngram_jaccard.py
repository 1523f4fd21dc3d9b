"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, with a class for each document.

Method. A document's shingles are hashed to 64 bits. The universe of hashes is partitioned: a shingle belongs to
segment hash % m. Two sets that reach the threshold differ in at most H elements, so of m segments at least m - H
are equal (pigeonhole). m depends on the band of set sizes, and a set appears in its own band and, as the smaller
partner, in the next one. For each band `allocate` weighs two ways by cost:

* whole segments, m = H + 1 + slack: a signature for each segment that isn't empty. Empty segments tell nothing and
  would put a share of all documents into one list, so they are skipped; `slack` says how many a document may have.
  The few documents with more of them index their empty segments too.
* one-deletion neighbourhoods, m = (H + 1) / 2 rounded up: of m segments one differs in at most one element, so a
  signature for each segment and for each segment less one element meet.

Equal sets share a node id and travel once for each batch; different sets that share a hash take a second one. Signatures are packed in numpy by bucket, one binary row
for each bucket and batch, and a task takes up its buckets one after another, sorted by Spark, so it holds one of them at
a time. A list of nodes with a common signature first gives links to one centre, which are verified on the sets
themselves; then to a member of the list's largest class. Lists whose nodes are then in one class are done, and in the
others each node outside of the largest class meets all nodes of the list: in blocks, one for each two chunks of the list,
which are dealt out by list and chunk. No pair of one list is left out: the result is exact. Before sets are fetched, a
pair's parity bitmaps are compared: each element flips one bit, so the number of different bits is at most the number of
different elements, and a pair with more than the threshold allows is no link.

Nulls: a null text is an empty set; a null id gets a null class and links with nothing. Rows that share an id are
one document with several texts: a link of one of them counts for all. Very long texts are taken whole; an empty table
gives no rows. Extra columns are ignored by jaccard_classes() and kept by first_of_class(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, WordHashes, binary_column, components, mixed, own, partitions_for, sequence_hashes, sliced, unwrapped, wrapped

ENTRY = np.dtype([("sig", "<u8"), ("node", "<i8"), ("size", "<i4"), ("role", "<i4")])
#: Roles: of its own band, of the band below, and the same two for a segment less one element.
OWN, BELOW, OWN_LESS, BELOW_LESS = 0, 1, 2, 3
#: Members of a list that travel in one row.
CHUNK = 2048
#: Signatures that a worker gathers before it packs them by bucket, and buckets for each partition of their shuffle.
FLUSH, BUCKETS = 1 << 18, 4
#: Node ids that several sets may have in common.
MOST_DOUBLES = 100_000


def bands(percent: int, up_to: int) -> list[tuple[int, int]]:
    """Ranges of set sizes; a set's partners of at least its size lie in its own range or the next."""
    out, low = [], 1
    while low <= up_to:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return out


def most_different(percent: int, high: int) -> int:
    """Elements in which two sets of at most `high` can differ: 100 * common >= percent * union."""
    return 2 * high * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def allocate(percent: int, high: int, documents: int) -> tuple[str, int, int]:
    """(way, segments, slack) that costs least for a band: signatures a set, and the list that a signature meets by chance.

    A segment of k elements is taken to meet a stranger's with probability 0.05 ** k.
    """
    differ = most_different(percent, high)

    def chance(size: float) -> float:
        return documents * 0.05 ** min(size, 20.0)

    halves = (differ + 2) // 2
    less = halves * (1 + high / halves) * (1 + chance(max(high / halves - 1, 0.5)))
    segments, slack = differ + 1, 0
    for slack in range(64):
        segments = differ + 1 + slack
        empty = segments * math.exp(-high / segments)
        tail = 1 - sum(math.exp(-empty) * empty**i / math.factorial(i) for i in range(slack + 1))
        if tail < 0.01 / math.sqrt(documents + 1):
            break
    whole = segments * (1 + chance(high / segments))
    return ("less", halves, 0) if less < whole else ("whole", segments, slack)


def shingle_set(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the words' shingles; of fewer words: one of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    found = hashes.of(words)
    if len(words) <= size:
        return sequence_hashes(found, len(words))
    return np.unique(sequence_hashes(found, size))


@dataclass(frozen=True)
class Nodes:
    """Node ids of sets: a hash of the size and the elements, or a second one where sets have the first in common."""

    doubles: frozenset[int] = frozenset()
    bits: int = 64

    def of(self, found: np.ndarray) -> int | None:
        """A set's node id; of an empty set none."""
        if not len(found):
            return None
        node = (xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found)) >> (64 - self.bits)) - 2**63
        return self.second(found) if node in self.doubles else node

    @staticmethod
    def second(found: np.ndarray) -> int | None:
        return xxhash.xxh3_64_intdigest(found.tobytes(), seed=2**63 + len(found)) - 2**63 if len(found) else None


def signatures(found: np.ndarray, band: int, high: int, percent: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's signatures in a band: of segments, and of segments less one element."""
    way, m, slack = allocate(percent, high, documents)
    segment = (mixed(found ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
    spread = mixed(found + np.uint64(band))
    total = np.zeros(m, np.uint64)
    np.add.at(total, segment, spread)
    place = mixed(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    if way == "less":
        return mixed(total ^ place), mixed((total[segment] - spread) ^ place[segment])
    count = np.bincount(segment, minlength=m)
    full = count > 0
    if m - int(full.sum()) <= slack:
        return mixed(total[full] ^ place[full]), found[:0]
    return mixed(total ^ place), found[:0]


def shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    hashes = WordHashes()
    for batch in sliced(batches):
        texts = binary_column(batch, "text")
        yield batch.column(0).to_pylist(), [shingle_set(t.lower().split(), hashes, size) for t in texts]


def parities(found: np.ndarray) -> bytes:
    """A set's parity bitmap: a power of two of bits, at least 64 and one for each element.

    Sets without common elements differ in about half the bits, far more than the threshold allows.
    """
    bits = 64
    while bits < len(found):
        bits *= 2
    at = (mixed(found ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of the least of their lengths; the halves of a longer one are joined by exclusive or."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least), np.uint8)
    for i, m in enumerate(maps):
        row = np.frombuffer(m, np.uint8)
        while len(row) > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out.view(np.uint64)


def may_link(one: np.ndarray, two: np.ndarray, size_one, size_two, percent: int) -> np.ndarray:
    """Whether bitmaps leave it open that sets of these sizes reach the threshold."""
    differ = np.bitwise_count(one ^ two).sum(axis=-1, dtype=np.int64)
    return differ * (100 + percent) <= (size_one + size_two) * (100 - percent)


def membership(docs: DataFrame, size: int, nodes: Nodes) -> DataFrame:
    """(doc_id, node, second, n_shingles, bits) of each row."""

    def run(batches):
        for ids, sets in shingled(batches, size):
            bits = [parities(s) if len(s) else None for s in sets]
            columns = [pa.array(x, pa.int64()) for x in (ids, map(nodes.of, sets), map(nodes.second, sets), map(len, sets))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary())], ["doc_id", "node", "second", "n_shingles", "bits"])

    return docs.mapInArrow(run, "doc_id long, node long, second long, n_shingles long, bits binary")


def told_apart(members: DataFrame, nodes: Nodes) -> tuple[DataFrame, Nodes]:
    """members and nodes after sets that share a node id have taken their second one.

    Of 10^10 different sets some three pairs share one of 64 bits, so what comes to the driver is a handful of numbers.
    """
    shared = members.groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b").select("node")
    doubles = frozenset(r["node"] for r in shared.limit(MOST_DOUBLES + 1).collect())
    if len(doubles) > MOST_DOUBLES:
        raise ValueError("too many sets share a hash; is it still one?")
    if not doubles:
        return members.drop("second"), nodes
    table = F.broadcast(members.sparkSession.createDataFrame([(d,) for d in doubles], "node long").withColumn("_double", F.lit(True)))
    own_node = F.when(F.col("_double"), F.col("second")).otherwise(F.col("node"))
    return members.join(table, "node", "left").withColumn("node", own_node).drop("second", "_double"), Nodes(doubles, nodes.bits)


def packed_signatures(docs: DataFrame, size: int, nodes: Nodes, percent: int, buckets: int, counts: dict[int, int], top: int) -> DataFrame:
    """(bucket, entries): the signatures of a batch's distinct sets, a row for each bucket."""
    ranges = bands(percent, top)
    lows = np.array([low for low, _ in ranges], np.int64)

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.concatenate(parts)
        bucket = (entries["sig"] >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blobs = [by_column(e) for e in np.split(entries, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "entries"])

    def run(batches):
        parts, held, seen = [], 0, set()
        for _, sets in shingled(batches, size):
            for node, s in {nodes.of(s): s for s in sets if len(s)}.items():
                if node in seen:
                    continue
                seen.add(node)
                band = int(np.searchsorted(lows, len(s), "right")) - 1
                for k, roles in ((band, (OWN, OWN_LESS)), (band + 1, (BELOW, BELOW_LESS))):
                    if k >= len(ranges):
                        continue
                    for sig, role in zip(signatures(s, k, ranges[k][1], percent, counts.get(k, 0)), roles, strict=True):
                        if len(sig):
                            entry = np.empty(len(sig), ENTRY)
                            entry["sig"], entry["node"], entry["size"], entry["role"] = sig, node, len(s), role
                            parts.append(entry)
                            held += len(sig)
            if held >= FLUSH:
                yield packed(parts)
                parts, held, seen = [], 0, set()
        if parts:
            yield packed(parts)

    return docs.mapInArrow(run, "bucket int, entries binary")


def by_column(entries: np.ndarray) -> bytes:
    """Entries with each field by itself: a node's entries are neighbours, so all but the signatures compress."""
    return b"".join(entries[f].tobytes() for f in ENTRY.names)


def from_columns(blob: bytes) -> np.ndarray:
    out, at = np.empty(len(blob) // ENTRY.itemsize, ENTRY), 0
    for f in ENTRY.names:
        out[f] = np.frombuffer(blob, ENTRY[f], len(out), at)
        at += ENTRY[f].itemsize * len(out)
    return out


LISTS = "list long, chunk int, nodes array<long>, sizes array<int>, roles array<int>"


def lists(packed: DataFrame, partitions: int) -> DataFrame:
    """Nodes with a common signature, centre first; long lists in chunks that repeat the centre."""

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket:
                    yield from lists_of(held)
                    bucket, held = b, []
                held.append(from_columns(blob.as_py()))
        yield from lists_of(held)

    found = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, LISTS)
    return found.dropDuplicates(["list", "chunk"])


def lists_of(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The lists of one bucket's entries."""
    if not held:
        return
    entries = np.concatenate(held)
    held.clear()
    entries = entries[np.lexsort((entries["role"], entries["node"], entries["sig"]))]
    entries = entries[np.r_[True, (np.diff(entries["node"]) != 0) | (entries["sig"][1:] != entries["sig"][:-1]) | (np.diff(entries["role"]) != 0)]]
    cuts = np.flatnonzero(np.r_[True, entries["sig"][1:] != entries["sig"][:-1], True])
    rows, seen = [], set()
    for at in np.flatnonzero(np.diff(cuts) > 1):
        part = entries[cuts[at] : cuts[at + 1]]
        if (part["node"] == part["node"][0]).all() or not (part["role"] % 2 == 0).any() or (part["role"] >= 2).all():
            continue
        key = xxhash.xxh3_64_intdigest(part["node"].tobytes() + part["role"].tobytes()) - 2**63
        if key in seen:
            continue
        seen.add(key)
        # the centre is a segment of the band's own sets if there is one
        head = part[np.argmin(part["role"])]
        rest = part[part["node"] != head["node"]]
        for chunk in range(0, len(rest), CHUNK):
            row = np.concatenate([[head], rest[chunk : chunk + CHUNK]])
            rows.append((key, chunk // CHUNK, row["node"].tolist(), row["size"].tolist(), row["role"].tolist()))
        if len(rows) >= 5000:
            yield arrow_lists(rows)
            rows = []
    if rows:
        yield arrow_lists(rows)


def arrow_lists(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["list", "chunk", "nodes", "sizes", "roles"])


def close(percent: int):
    """Whether sizes allow two sets to reach the threshold."""
    return 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")


def spokes(found: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's centre and each of its other nodes."""
    pairs = found.select(F.element_at("nodes", 1).alias("one"), F.element_at("sizes", 1).alias("size_a"), F.explode(F.slice(F.arrays_zip("nodes", "sizes"), 2, CHUNK)).alias("x"))
    pairs = pairs.select("one", F.col("x.nodes").alias("two"), "size_a", F.col("x.sizes").alias("size_b"))
    pairs = pairs.filter((F.col("one") != F.col("two")) & close(percent)).select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()
    both = pairs.join(maps.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("size").alias("s")), "a")
    both = both.join(maps.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("size").alias("t")), "b").select("a", "b", "x", "y", "s", "t")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y, s, t in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                one, two = folded([x, y])
                keep.append(bool(may_link(one, two, s, t, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def open_chunks(found: DataFrame, info: DataFrame) -> DataFrame:
    """(list, chunk, last, common, members) of the lists with nodes in different classes. info: (node, size, bits, label).

    common is the list's largest class, last its last chunk.
    """
    each = found.select("list", "chunk", F.explode("nodes").alias("node")).join(info.select("node", "label"), "node")
    counts = each.groupBy("list", "label").agg(F.count(F.lit(1)).alias("n"), F.max("chunk").alias("chunk"))
    several = counts.groupBy("list").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.max("chunk").alias("last"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").drop("labels")
    # a row for each chunk meets its list here; its members are looked up by node
    members = found.join(several, "list").select("list", "chunk", "last", "common", F.explode(F.arrays_zip("nodes", "roles")).alias("x"))
    members = members.select("list", "chunk", "last", "common", F.col("x.nodes").alias("node"), F.col("x.roles").alias("role")).join(info, "node")
    # last and common are the list's: as keys they let a filter on them reach the lists
    return members.groupBy("list", "chunk", "last", "common").agg(F.collect_list(F.struct("node", "size", "role", "label", "bits")).alias("members"))


def distinct_pairs(blocks: DataFrame, found) -> DataFrame:
    """The pairs that `found` makes of each row of blocks (a pa.RecordBatch and a row's number)."""

    def run(batches):
        tried: set[tuple[int, int]] = set()
        for batch in batches:
            for i in range(batch.num_rows):
                tried.update(found(batch, i))
                if len(tried) > 50_000:
                    yield arrow_pairs(tried)
                    tried = set()
        if tried:
            yield arrow_pairs(tried)

    return blocks.mapInArrow(run, "a long, b long").distinct()


def ray_pairs(found: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs of one member of a chunk's largest class and each node of other classes that may be links.

    There is at most a row for each member, and a centre of its own for each list, so a node that has many lists meets many
    centres.
    """
    chunks = open_chunks(found, info).select("members", "list")
    return distinct_pairs(chunks, lambda batch, i: rays(members_of(batch.column(0), i), batch.column(1)[i].as_py(), percent))


def crossing(found: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's nodes in different classes that may be links: each node outside of its largest class with all."""
    chunks = open_chunks(found, info)

    def within(batch, i: int) -> set[tuple[int, int]]:
        own, common = members_of(batch.column(0), i), batch.column(1)[i].as_py()
        return across(own, own, np.flatnonzero(own["label"] != common).tolist(), percent)

    def between(batch, i: int) -> set[tuple[int, int]]:
        one, two = members_of(batch.column(0), i), members_of(batch.column(1), i)
        return across(one, two, range(len(one["node"])), percent)

    short = distinct_pairs(chunks.filter("last = 0").select("members", "common"), within)
    long = chunks.filter("last > 0")
    strangers = long.select("list", "last", F.filter("members", lambda x: x["label"] != F.col("common")).alias("m1")).filter(F.size("m1") > 0)
    strangers = strangers.select("list", "m1", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"))
    blocks = strangers.join(long.select("list", "chunk", F.col("members").alias("m2")), ["list", "chunk"]).select("m1", "m2")
    return short.union(distinct_pairs(blocks, between)).distinct()


def arrow_pairs(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def members_of(column: pa.ListArray, i: int) -> dict:
    """One row's members as numpy columns, bitmaps as bytes."""
    structs = column.slice(i, 1).flatten()
    out = {k: v.to_numpy() for k, v in zip(("node", "size", "role", "label"), structs.flatten()[:4], strict=True)}
    return out | {"bits": structs.flatten()[4].to_pylist()}


def rays(members: dict, salt: int, percent: int) -> set[tuple[int, int]]:
    """Pairs of one member of the largest class and each node of other classes that may be links."""
    labels, counts = np.unique(members["label"], return_counts=True)
    common = members["label"] == labels[np.argmax(counts)]
    order = mixed(members["node"].astype(np.uint64) ^ np.uint64(salt & (2**64 - 1)))
    centre = np.flatnonzero(common)[np.argmin(order[common])]
    maps, others = folded(members["bits"]), np.flatnonzero(~common)
    sizes = members["size"].astype(np.int64)
    near = others[may_link(maps[others], maps[centre], sizes[others], sizes[centre], percent)]
    a = int(members["node"][centre])
    return {(min(a, b), max(a, b)) for b in members["node"][near].tolist()}


def across(one: dict, two: dict, chosen, percent: int) -> set[tuple[int, int]]:
    """Pairs of the chosen members of one and any of two, with different labels, that may be links."""
    maps = folded([*one["bits"], *two["bits"]])
    m1, m2 = maps[: len(one["node"])], maps[len(one["node"]) :]
    out: set[tuple[int, int]] = set()
    sizes = two["size"].astype(np.int64)
    for i in chosen:
        role, size = one["role"][i], int(one["size"][i])
        near = (two["label"] != one["label"][i]) & ((two["role"] % 2 == 0) | (role % 2 == 0)) & ((two["role"] < 2) | (role < 2))
        near = np.flatnonzero(near & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)))
        near = near[may_link(m2[near], m1[i], sizes[near], size, percent)]
        a = int(one["node"][i])
        out.update((min(a, b), max(a, b)) for b in two["node"][near].tolist())
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def linked(scratch: Scratch, docs: DataFrame, percent: int, size: int, bits: int = 64) -> tuple[DataFrame, DataFrame, Nodes]:
    """(doc_id, node, n_shingles) of each row of docs (doc_id, text), links (a, b) of nodes that connect each class, and Nodes."""
    partitions = partitions_for(docs)
    first = scratch.keep(membership(docs, size, Nodes(bits=bits)), "members")
    members, nodes = told_apart(first, Nodes(bits=bits))
    top = members.agg(F.max("n_shingles")).first()[0] or 0
    ranges = bands(percent, max(top, 1))
    # a count for each band: as many rows as there are bands, about log(largest set) / log(1 / threshold)
    low = F.array(*[F.lit(a) for a, _ in ranges])
    per_band = members.filter("n_shingles > 0").groupBy((F.size(F.filter(low, lambda x: x <= F.col("n_shingles"))) - 1).alias("band")).count()
    # rounded to a power of two, so that few distinct allocations arise
    counts = {r["band"]: 1 << int(r["count"]).bit_length() for r in per_band.toLocalIterator()}
    found = scratch.keep(lists(packed_signatures(docs, size, nodes, percent, partitions * BUCKETS, counts, top), partitions), "lists")
    # a table of its own, for a node that very many copies have
    listed = scratch.keep(found.select(F.explode("nodes").alias("node")).distinct(), "listed")
    maps = members.join(listed, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"), F.first("n_shingles").alias("size"))
    maps = scratch.keep(maps.filter("doc_id is not null"), "maps")
    slim = scratch.keep(members.drop("bits"), "members")
    scratch.drop(first, listed)

    def elements(batches):
        for _, sets in shingled(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(map(nodes.of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "elements"])

    # a shuffle at any size: the ids grow with the input, and texts of one id are few
    chosen = docs.join(maps.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    # one document for each node, so sets are written where they are made; ids that are repeated may add rows, which
    # only repeat a link
    sets = scratch.keep(chosen.mapInArrow(elements, "node long, elements binary").filter("node is not null"), "sets")
    links = scratch.keep(verified(spokes(found, maps, percent), sets, percent), "spokes")
    for candidates, name in ((ray_pairs, "rays"), (crossing, "crossing")):
        labels = components(links, scratch)
        info = scratch.keep(maps.join(labels, "node", "left").select("node", "size", "bits", F.coalesce("label", "node").alias("label")), "info")
        pairs = scratch.keep(candidates(found, info, percent), f"{name}-pairs")
        more = scratch.keep(verified(pairs, sets, percent), name)
        both = scratch.keep(links.select("a", "b").union(more.select("a", "b")), "so-far")
        scratch.drop(labels, info, pairs, more, links)
        links = both
    scratch.drop(sets, found, maps)
    return slim, links, nodes


def jaccard_classes(spark: SparkSession, docs: DataFrame, percent: int = 85, size: int = 4, id_column: str = "doc_id", text_column: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) of each row of docs.

    Documents are linked when 100 * common shingles >= percent * all shingles of the two; component_id is the smallest
    id that links reach. Words are runs of other than ASCII white space, with A-Z in lower case; fewer words than
    `size` are one shingle; no words: no shingle and no link. node is equal for equal sets, null for empty ones.
    """
    scratch = Scratch(spark)
    members, links, _ = linked(scratch, docs.select(own(id_column).cast("long").alias("doc_id"), own(text_column).cast("string").alias("text")), percent, size, bits)
    # links of rows that share an id
    repeated = members.filter("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    shared = members.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
    labels = components(links.union(shared), scratch)
    scratch.drop(links)
    classed = members.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    # a table of its own: Spark splits a class of very many rows in a join of two exchanges, not below an aggregate
    least = scratch.keep(classed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")), "least")
    out = classed.join(least, "class", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "node")


def first_of_class(spark: SparkSession, docs: DataFrame, percent: int = 80, size: int = 5, id_column: str = "doc_id", text_column: str = "text", bits: int = 64) -> DataFrame:
    """The rows of docs less those that are near copies of another: of each class one row stays.

    It is the one of the smallest id; rows without an id come after all others, in the order of a hash of their text, and
    rows with the same id and set in the order of their columns as JSON. Rows with the same id and other texts are
    documents of their own. Rows without words are linked with nothing and all stay, repeated ones too.
    """
    scratch = Scratch(spark)
    text = own(text_column).cast("string")
    # ids above all others for rows without one, equal for equal texts
    high = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)
    keyed = wrapped(docs, doc_id=F.coalesce(own(id_column).cast("long"), high), text=text)
    members, links, nodes = linked(scratch, keyed.select("doc_id", "text"), percent, size, bits)
    labels = components(links, scratch)
    filled = members.filter("node is not null")
    best = filled.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("class")).agg(F.min(F.struct("doc_id", "node")).alias("x"))
    best = scratch.keep(best.select("x.doc_id", "x.node"), "best")
    several = scratch.keep(members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "several")
    gone = filled.join(best, ["doc_id", "node"], "left_anti").select("doc_id").union(several).distinct()
    gone = scratch.keep(gone, "gone")
    scratch.drop(members, labels, links)
    out = keyed.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select("row")
    if not several.isEmpty():  # ids of several rows: the rows are told apart by their sets
        shared = with_node(keyed.join(several.hint("shuffle_hash"), "doc_id", "left_semi"), size, nodes)
        first = shared.join(best, ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.union(first.select("row")).union(shared.filter("node is null").select("row"))
    return unwrapped(out, docs.columns, {})


def with_node(rows: DataFrame, size: int, nodes: Nodes) -> DataFrame:
    """rows (row, doc_id, text) with `node`."""

    def run(batches):
        hashes = WordHashes()
        for batch in sliced(batches):
            sets = [shingle_set(t.lower().split(), hashes, size) for t in binary_column(batch, "text")]
            yield batch.append_column("node", pa.array(map(nodes.of, sets), pa.int64()))

    return rows.select("row", "doc_id", "text").mapInArrow(run, rows.select("row", "doc_id", "text").schema.add("node", "long"))
