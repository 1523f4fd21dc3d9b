"""Substring dedup: windows of words that repeat, found by super-k-mer partitioning.

Method. Of each window of `size` words the smallest hash among its runs of `inner` words is its minimiser.
Consecutive windows with the same minimiser travel together, as one packed string, to the bucket of that hash, so
all occurrences of a window meet there; a window's words are compared themselves, not hashes of them. In a batch,
equal strings travel once, with their earliest place, and the later places are marked at once, so a passage that
many documents share arrives at its bucket once for each batch.

Where a window starts is told by the document's id and the place in its text; what is marked is told by the id and the
text's hash. So rows that share an id are one document, in which the same place of two texts is neither earlier nor later,
and each row loses only its own words.

Nulls: a null text has no words. Rows with a null id are kept whole and take no part. Equal rows are judged alike. Very
long texts are taken whole; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, WordHashes, binary_column, mixed, own, partitions_for, sequence_hashes, sliced

#: Bytes of text that are cut into super-k-mers at a time, so that a worker's memory is bounded.
BATCH_BYTES = 24 << 20
HEAD = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("length", "<i4")])
#: Buckets for each partition of their shuffle.
BUCKETS = 8


def super_kmers(hashes: np.ndarray, size: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each run of windows with one minimiser."""
    mers = sequence_hashes(hashes, inner)
    windows = len(hashes) - size + 1
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    span = size - inner + 1
    # the minimum of `span` neighbours, by doubling
    least, width = mers, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return starts, np.diff(np.r_[starts, windows]), least[starts]


def chunks(batches):
    """Ids, hashes and texts, of a bounded number of bytes at a time."""
    rows, held = [], 0
    for batch in sliced(batches):
        for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "text"), strict=True):
            if i is None or not t:
                continue
            rows.append((i, h, t))
            held += len(t)
            if held >= BATCH_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def packed(docs: DataFrame, size: int, inner: int, buckets: int) -> DataFrame:
    """Rows of (bucket, heads, strings), and with bucket -1 marks: windows known to repeat an earlier one."""

    def run(batches):
        hashes = WordHashes()
        for group in chunks(batches):
            # the earliest of equal strings, by its place; others at the same place, of texts that share an id, travel too
            earliest: dict[bytes, tuple[int, int, int, int, int]] = {}
            beside: set[tuple[bytes, tuple[int, int, int, int, int]]] = set()
            marks: list[tuple[int, int, int, int]] = []
            for doc, h, text in group:
                words = text.split()
                if len(words) < size:
                    continue
                starts, counts, least = super_kmers(hashes.of(words), size, inner)
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                from_byte = np.r_[0, ends][starts].tolist()
                to_byte = (ends[starts + counts + size - 2] - 1).tolist()
                bucket = (mixed(least) % np.uint64(buckets)).tolist()
                for s, n, b, f, t in zip(starts.tolist(), counts.tolist(), bucket, from_byte, to_byte, strict=True):
                    key, at = joined[f:t], (doc, s, h, n, b)
                    was = earliest.setdefault(key, at)
                    if was is at or was == at:
                        continue
                    if was[:2] == at[:2]:
                        beside.add((key, at))
                    elif was[:2] < at[:2]:
                        marks.append((doc, h, s, n))
                    else:
                        marks.append((was[0], was[2], was[1], was[3]))
                        earliest[key] = at
            by_bucket: dict[int, list[tuple[bytes, tuple]]] = {}
            for key, at in (*earliest.items(), *beside):
                by_bucket.setdefault(at[4], []).append((key, at))
            rows = []
            for b, found in by_bucket.items():
                heads = np.array([(at[0], at[2], at[1], len(k)) for k, at in found], HEAD)
                rows.append((b, zstandard.ZstdCompressor(1).compress(by_column(heads)), zstandard.ZstdCompressor(1).compress(b"".join(k for k, _ in found))))
            del earliest, beside, by_bucket
            if marks:
                rows.append((-1, by_column(np.array(marks, HEAD)), b""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "heads", "strings"])

    return docs.mapInArrow(run, "bucket int, heads binary, strings binary")


def by_column(heads: np.ndarray) -> bytes:
    """Heads with each field by itself, which compresses."""
    return b"".join(heads[f].tobytes() for f in HEAD.names)


def from_columns(blob: bytes) -> np.ndarray:
    out, at = np.empty(len(blob) // HEAD.itemsize, HEAD), 0
    for f in HEAD.names:
        out[f] = np.frombuffer(blob, HEAD[f], len(out), at)
        at += HEAD[f].itemsize * len(out)
    return out


def repeated_in(entries: list[tuple[bytes, bytes]], size: int) -> np.ndarray:
    """Of one bucket's super-k-mers, the windows that start earlier elsewhere: runs of (doc, text, start, windows)."""
    ids: dict[bytes, int] = {}
    docs, texts, firsts, lengths, flat = [], [], [], [], []
    for heads, strings in entries:
        heads = from_columns(zstandard.ZstdDecompressor().decompress(heads))
        strings = zstandard.ZstdDecompressor().decompress(strings)
        at = 0
        for doc, text, start, length in heads.tolist():
            words = strings[at : at + length].split(b" ")
            at += length
            flat.append(np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int32, len(words)))
            docs.append(doc)
            texts.append(text)
            firsts.append(start)
            lengths.append(len(words))
    words = np.concatenate(flat)
    del flat, ids
    lengths = np.array(lengths)
    windows = lengths - size + 1
    offsets = np.r_[0, np.cumsum(lengths)[:-1]]
    before = np.r_[0, np.cumsum(windows)[:-1]]
    within = np.arange(windows.sum()) - np.repeat(before, windows)
    place = np.repeat(offsets, windows) + within
    doc = np.repeat(np.array(docs, np.int64), windows)
    text = np.repeat(np.array(texts, np.int64), windows)
    start = np.repeat(np.array(firsts, np.int64), windows) + within
    value = sequence_hashes(mixed(words.astype(np.uint64) + np.uint64(1)), size)[place]
    order = np.argsort(value)
    ordered = value[order]
    same = np.r_[False, ordered[1:] == ordered[:-1], False]
    # only windows whose hash occurs twice are looked at further
    order = order[same[1:] | same[:-1]]
    if not len(order):
        return np.empty(0, HEAD)
    order = order[np.lexsort((start[order], doc[order], value[order]))]
    group = np.cumsum(np.r_[True, value[order][1:] != value[order][:-1]]) - 1
    # rows of a group are in order of place; the first with equal words is the earliest
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    first = np.repeat(head, np.diff(np.r_[head, len(order)]))
    equal = np.ones(len(order), bool)
    for i in range(size):
        equal &= words[place[order] + i] == words[place[order[first]] + i]
    later = equal & ((doc[order] != doc[order[first]]) | (start[order] != start[order[first]]))
    for g in np.unique(group[~equal]):  # two sequences with one hash: compare each with all before it
        rows, known = np.flatnonzero(group == g), {}
        for r in rows:
            key, at = words[place[order[r]] : place[order[r]] + size].tobytes(), (doc[order[r]], start[order[r]])
            later[r] = known.setdefault(key, at) != at
    if not later.any():
        return np.empty(0, HEAD)
    found = np.zeros(int(later.sum()), HEAD)
    found["doc"], found["text"], found["start"] = doc[order[later]], text[order[later]], start[order[later]]
    found = np.unique(found)
    fresh = np.r_[True, (found["doc"][1:] != found["doc"][:-1]) | (found["text"][1:] != found["text"][:-1]) | (found["start"][1:] > found["start"][:-1] + 1)]
    runs = found[fresh].copy()
    at = np.flatnonzero(fresh)
    last = np.r_[at[1:] - 1, len(found) - 1]
    runs["length"] = found["start"][last] - found["start"][at] + 1
    return runs


RANGES = "doc_id long, text_hash long, start int, windows int"


def arrow_ranges(runs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(runs[k]) for k in ("doc", "text", "start", "length")], ["doc_id", "text_hash", "start", "windows"])


def repeats(docs: DataFrame, size: int, inner: int, partitions: int) -> DataFrame:
    """Runs of windows whose words also start earlier."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            for bucket, heads, strings in zip(*batch.columns, strict=True):
                bucket, heads = bucket.as_py(), heads.as_py()
                if bucket < 0:
                    yield arrow_ranges(from_columns(heads))
                    continue
                if bucket != at and held:
                    yield arrow_ranges(repeated_in(held, size))
                    held = []
                at = bucket
                held.append((heads, strings.as_py()))
        if held:
            yield arrow_ranges(repeated_in(held, size))

    found = packed(docs, size, inner, partitions * BUCKETS)
    spread = F.when(F.col("bucket") < 0, F.xxhash64("heads")).otherwise(F.col("bucket").cast("long"))
    # a task takes up its buckets one after another, so it holds one of them at a time
    return found.repartition(partitions, spread).sortWithinPartitions("bucket").mapInArrow(run, RANGES)


def without_repeats(spark: SparkSession, docs: DataFrame, size: int = 20, inner: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): each row's words, less those that a repeated window covers, joined by a space.

    A window is `size` consecutive words of a document; it repeats if its words also start earlier: in a document of
    a smaller id, or earlier in the same one. Windows are judged on the input. Words are runs of other than ASCII
    white space.
    """
    scratch = Scratch(spark)
    text = own(text_column).cast("string")
    docs = docs.select(own(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = scratch.keep(repeats(docs, size, inner, partitions_for(docs)), "ranges")
    # a text has at most one range for each bucket's run of its windows, so this is bounded by its length
    marked = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "windows")).alias("ranges"))

    def run(batches):
        for batch in sliced(batches):
            total, removed, texts = [], [], []
            for text, ranges in zip(binary_column(batch, "text"), batch.column(batch.schema.get_field_index("ranges")).to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in ranges or ():
                    if r["start"] < len(words):
                        gone[r["start"]] += 1
                        gone[min(r["start"] + r["windows"] + size - 1, len(words))] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                total.append(len(words))
                removed.append(int(covered.sum()))
                texts.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c] if ranges else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return docs.join(marked, ["doc_id", "text_hash"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def brute_force(rows: list[tuple], size: int = 20) -> list[tuple]:
    """What the operator should give for rows of (doc_id, text), by looking at every window; for tests."""
    first: dict[tuple, tuple] = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - size + 1) if doc is not None else ():
            key = tuple(words[i : i + size])
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - size + 1) if doc is not None else ():
            if first[tuple(words[i : i + size])] < (doc, i):
                gone.update(range(i, i + size))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
