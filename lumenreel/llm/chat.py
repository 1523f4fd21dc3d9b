r"""Chat formatting by columnar byte assembly.

A turn is `### role`, a line end, the text, `</turn>` and a line end. In texts and roles a backslash stands before
each backslash, each `###` and each `</turn>` (in roles before each line end too); the character after a backslash
is taken as it is when reading, so any text can be read back.

Method. The turns' texts lie in one Arrow buffer. Lengths of segments, cumulative offsets and the index of each
byte's place are computed in numpy, and headers, contents, escapes and ends are scattered into one preallocated
buffer, which becomes the output column as it is. The loss mask is a list of spans (code points) of the
assistant's texts.

Rows of a conversation are ordered by turn, then role and text; nulls first. Null text or role: empty. A null
conv_id is a conversation like any other; repeated rows are turns of their own. Very long texts are taken whole, but a
conversation is one output row, so one of 2 GB or more raises OverflowError. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import partitions_for, sliced

OPEN, CLOSE, ESCAPE = b"### ", b"</turn>\n", b"\\"
#: Control strings that are escaped in texts.
CONTROLS = (b"###", b"</turn>")
TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Bytes of text that are assembled at a time; a longer conversation is assembled alone.
BLOCK_BYTES = 4 << 20
FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def header(role: str) -> bytes:
    data = role.encode().replace(ESCAPE, ESCAPE * 2).replace(b"\n", b"\\\n")
    return OPEN + data.replace(b"###", b"\\###") + b"\n"


def escapes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether an escape goes before each byte; ends: of the segment each byte is in."""
    out = data == ESCAPE[0]
    place = np.arange(len(data))
    for control in CONTROLS:
        n = len(control)
        if len(data) < n:
            continue
        found = np.ones(len(data) - n + 1, bool)
        for i, byte in enumerate(control):
            found &= data[i : len(data) - n + 1 + i] == byte
        found &= place[: len(found)] + n <= ends[: len(found)]
        out[: len(found)] |= found
    return out


def assembled(ids: list, turns: list[int], roles: list[str], texts: list[bytes]) -> pa.RecordBatch:
    """Conversations of so many turns each, formatted into one buffer."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.r_[0, np.cumsum(sizes)]
    row = np.repeat(np.arange(len(texts)), sizes)
    marked = escapes(data, starts[1:][row])
    extra = np.cumsum(marked)
    before = np.r_[0, extra][starts]  # escapes before each text
    kinds = {r: header(r) for r in dict.fromkeys(roles)}
    heads = np.fromiter((len(kinds[r]) for r in roles), np.int64, len(roles))
    body = sizes + np.diff(before)
    segment = np.r_[0, np.cumsum(heads + body + len(CLOSE))]
    if segment[-1] >= 2**31:
        raise OverflowError(f"conversation {ids[0]} has {segment[-1]} bytes; a string holds less than 2 GB")
    out = np.empty(segment[-1], np.uint8)
    role = np.array([list(kinds).index(r) for r in roles]) if len(kinds) < 64 else None
    for k, head in enumerate(kinds.values()) if role is not None else ():
        at = segment[:-1][role == k]
        out[at[:, None] + np.arange(len(head))] = np.frombuffer(head, np.uint8)
    for at, r in zip(segment[:-1].tolist(), roles, strict=True) if role is None else ():
        out[at : at + len(kinds[r])] = np.frombuffer(kinds[r], np.uint8)
    content = segment[:-1] + heads
    place = np.arange(len(data)) + (content - starts[:-1] - before[:-1])[row] + extra
    out[place] = data
    out[place[marked] - 1] = ESCAPE[0]
    out[(content + body)[:, None] + np.arange(len(CLOSE))] = np.frombuffer(CLOSE, np.uint8)
    first = np.r_[0, np.cumsum(turns)]
    bounds = segment[first]
    points = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]  # code points before each byte
    losses, offsets = [], [0]
    says = np.array([r == "assistant" for r in roles])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.flatnonzero(says[a:b]) + a
        base = points[segment[a]]
        losses += [{"start": int(points[content[i]] - base), "end": int(points[content[i] + body[i]] - base)} for i in own.tolist()]
        offsets.append(len(losses))
    text = pa.StringArray.from_buffers(len(turns), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
    span = pa.array(losses, pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    loss = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), span)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(turns, pa.int64()), text, loss], ["conv_id", "n_turns", "formatted", "loss"])


def formatted(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) of each conversation in rows of (conv_id, turn, role, text)."""

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition(partitions_for(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        ids, counts, roles, texts, held = [], [], [], [], 0
        for batch in sliced(batches, 5000):
            body = batch.column(2).cast(pa.binary()).to_pylist()
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), body, strict=True):
                if not ids or ids[-1] != conv:
                    if held >= BLOCK_BYTES:
                        yield assembled(ids, counts, roles, texts)
                        ids, counts, roles, texts, held = [], [], [], [], 0
                    ids.append(conv)
                    counts.append(0)
                counts[-1] += 1
                roles.append(role)
                texts.append(text)
                held += len(text) + 16
        if ids:
            yield assembled(ids, counts, roles, texts)

    return rows.mapInArrow(run, FORMATTED)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


def digests(spoken: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: digests of the turns and of the text under the loss mask."""

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for conv, count, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = turns_of(text)
                if len(read) != count:
                    raise ValueError(f"conversation {conv}: {len(read)} turns read back of {count}")
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in read).encode()).hexdigest()
                learnt = "".join(unescaped(text[s["start"] : s["end"]]) for s in loss)
                rows.append((conv, count, whole, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spoken.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
