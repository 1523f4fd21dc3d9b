"""Best-fit packing, certified by lower bounds on the bin counts.

Method. Documents become token ids and pieces of at most one sequence's length; only lengths travel. Each partition
packs its pieces by best-fit decreasing, and dual-feasible functions over its histogram of lengths give a lower bound on
its bins. A partition that meets its bound is certified: no packing of its pieces takes fewer sequences, so they are
settled, all but the emptiest one. Partitions with a gap give up their sequences that aren't full. What is given up is
dealt out anew, so partitions exchange documents, and packed again by best-fit decreasing, as long as that saves sequences,
more than one partition takes part and the sequences are more than the bound of all pieces together, which certifies the
whole. Partitions are bounded in rows. certificate() tells the bound of any table of pieces.

Nulls: a null text is an empty document (the end token alone); a null id is packed like any other. Repeated rows
are packed each for itself. Very long texts are cut into pieces; an empty table gives no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch, own, sliced

#: Pieces that one task packs.
PART_ROWS = 200_000
#: How the byte-level vocabulary cuts a text before merging (a fixed value of that vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary file: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_plain(made: dict) -> bool:
    """Whether a tokenizer file is of the kind that byte_letters(), PATTERN and ranked merges describe in full."""
    cut_up, model = made.get("pre_tokenizer") or {}, made["model"]
    plain = cut_up.get("type") == "ByteLevel" and cut_up.get("use_regex", True) and not cut_up.get("add_prefix_space")
    special = all(not t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    other = [made.get("normalizer"), made.get("truncation"), *[model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]]
    # each merge makes the next id, so ids rank pairs as the list of merges does
    ids = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model.get("merges", [])]
    return bool(plain and special and not any(other) and model.get("type", "BPE") == "BPE" and None not in ids and ids == sorted(ids))


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids for a byte-level BPE file.

    A file of the plain byte-level kind has its vocabulary run in a faster engine that gives the same ids; texts that
    engine refuses, and all other files, go to the file's own library.
    """

    @lru_cache(maxsize=1)
    def library():
        """The file's own library, which takes much memory, only when it is needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.asarray(library().encode(text, add_special_tokens=False).ids, "<u4")

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    if not is_plain(made):
        return slow
    import tiktoken

    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in k): v for k, v in made["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    del made, ranks

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), "<u4")
        except ValueError:  # the engine's pattern gives up on some very long runs of blanks
            return slow(text)

    return encode


def cut(total: int, most: int) -> list[int]:
    """Where the pieces of a document of `total` ids start; only the first may be shorter than `most`."""
    first = total % most or most
    return [0, *range(first, total, most)]


def pieces(docs: DataFrame, tokenizer_path: str, most: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's pieces."""

    def run(batches):
        encode = encoder(tokenizer_path)
        for batch in sliced(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                starts = cut(len(ids), most)
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].tolist()] if with_ids else ())))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each of the lengths, which come in falling order, and the number of bins."""
    open_bins: list[list[int]] = [[] for _ in range(most + 1)]
    mask, count = 0, 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        room = mask >> n
        if room:
            left = n + (room & -room).bit_length() - 1
            at = open_bins[left].pop()
            if not open_bins[left]:
                mask &= ~(1 << left)
        else:
            left, at, count = most, count, count + 1
        where[i], offset[i] = at, most - left
        if left > n:
            open_bins[left - n].append(at)
            mask |= 1 << (left - n)
    return where, offset, count


def lower_bound(count: np.ndarray) -> int:
    """The most bins that a family of dual-feasible functions proves are needed, of count[n] pieces of each length n.

    The last length is the most that a bin holds.
    """
    count, most = count.astype(np.int64), len(count) - 1
    x = np.arange(most + 1)
    best = -(-int((count * x).sum()) // most)
    for a in range(1, most // 2 + 1):  # what is over most - a fills a bin, what is under a counts nothing
        value = np.where(x > most - a, most, np.where(x < a, 0, x))
        best = max(best, -(-int((count * value).sum()) // most))
    for k in range(1, 64):  # parts of 1 / (k + 1) rounded down to parts of 1 / k
        whole = x * (k + 1) % most == 0
        value = np.where(whole, x * k, (x * (k + 1) // most) * most)
        best = max(best, -(-int((count * value).sum()) // (k * most)))
    return best


def certificate(rows: DataFrame, most: int) -> int:
    """The lower bound on the sequences of all pieces of a table with `length`, from a histogram of at most `most` rows."""
    count = np.zeros(most + 1, np.int64)
    for r in rows.groupBy("length").count().toLocalIterator():
        count[r["length"]] = r["count"]
    return lower_bound(count)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, part int, bins long, bound long"


def packed_once(rows: DataFrame, turn: int, parts: int, most: int) -> DataFrame:
    """One round: each of `parts` groups of rows packed by itself. open: given up to the exchange."""

    def run(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        where, offset, bins = best_fit_decreasing(lengths, most)
        used = np.bincount(where, weights=lengths, minlength=bins)
        bound = lower_bound(np.bincount(lengths, minlength=most + 1))
        given = used < most if bins > bound else (np.arange(bins) == np.argmin(used)) & (used < most)
        pdf["sequence_id"] = (turn << 52) + (int(key[0]) << 24) + where
        pdf["offset"], pdf["open"] = offset, given[where]
        pdf["bins"], pdf["bound"] = bins, bound
        return pdf[[c.split()[0] for c in PLACED.split(", ")]]

    part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(parts)).cast("int")
    return rows.withColumn("part", part).groupBy("part").applyInPandas(run, PLACED)


def packed(spark: SparkSession, docs: DataFrame, tokenizer_path: str, most: int = 1024, end_id: int = 2, part_rows: int = PART_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document."""
    scratch = Scratch(spark)
    docs = docs.select(own(id_column).cast("long").alias("doc_id"), own(text_column).cast("string").alias("text"))
    cut_up = scratch.keep(pieces(docs, tokenizer_path, most, end_id), "pieces")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # a piece of full length is a sequence of its own; its number is below 0, where no other is
    alone = cut_up.filter(F.col("length") == most).withColumn("offset", F.lit(0).cast("long"))
    alone = alone.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).select(out)
    settled, pool, turn = [alone], cut_up.filter(F.col("length") < most), 0
    least = certificate(pool, most)
    rows, before, closed = pool.count(), None, 0
    while rows:
        parts = -(-rows // part_rows)
        placed = scratch.keep(packed_once(pool.select("doc_id", "piece", "start", "length", "ids_crc32"), turn, parts, most), f"round{turn}")
        bins = placed.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        if before is not None and bins >= before.bins:
            settled.append(before.pool.select(out))
            break
        given = placed.filter("open")
        counts = given.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sequence_id").alias("bins")).first()
        if parts == 1 or not counts["rows"] or closed + bins == least:
            settled.append(placed.select(out))
            break
        settled.append(placed.filter("not open").select(out))
        closed += bins - counts["bins"]
        before, pool, rows, turn = Open(given, counts["bins"]), given, counts["rows"], turn + 1
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


class Open:
    """The sequences that a round gave up."""

    def __init__(self, pool: DataFrame, bins: int):
        self.pool, self.bins = pool, bins


def sequences(spark: SparkSession, docs: DataFrame, tokenizer_path: str, most: int = 1024, end_id: int = 2) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves."""
    placed = packed(spark, docs, tokenizer_path, most, end_id)
    cut_up = pieces(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), tokenizer_path, most, end_id, with_ids=True)
    both = placed.join(cut_up.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"]), ["doc_id", "piece", "ids_crc32"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return both.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
