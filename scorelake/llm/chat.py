"""Chat text by columnar byte assembly, with its loss mask, and its reader.

A turn is ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. For a slice of turns the lengths of all
segments give their offsets by a running sum; one buffer is allocated and every segment is copied to its
place by index arrays, all turns at once; the buffer becomes the bytes of an Arrow column. Turns are sorted over
ranges of (conversation, turn), so a conversation of any length spreads over tasks; it comes out as blocks.

Control strings inside a text are escaped: ``<``, any backslashes, ``|`` takes one backslash more. In a role,
backslash, line end and ``<`` are written as a backslash and ``\\``, ``n`` or ``l``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import arrays as A
from scorelake.llm.storage import small_batches

BEGIN, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
TRAINED_ROLE = "assistant"
#: Blocks of one task are numbered from its partition times this.
BLOCKS_OF_TASK = 1 << 36

BLOCKS = "conv_id long, block long, text string, loss array<struct<start:int,length:int>>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_roles(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(roles, "\\", "\\\\")
    return pc.replace_substring(pc.replace_substring(roles, "\n", "\\n"), "<", "\\l")


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns end to end; where each begins (and the last ends); start and length of each text."""
    role_data, role_at = A.text_bytes(roles)
    text_data, text_at = A.text_bytes(texts)
    n = len(role_at) - 1
    length = np.empty((n, 5), np.int64)
    length[:, 0], length[:, 2], length[:, 4] = len(BEGIN), len(MIDDLE), len(END)
    length[:, 1], length[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(length.ravel())
    start = (ends - length.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for column, fixed in ((0, BEGIN), (2, MIDDLE), (4, END)):
        out[start[:, column, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for column, data, at in ((1, role_data, role_at), (3, text_data, text_at)):
        shift = np.repeat(start[:, column] - at[:-1], length[:, column])
        out[np.arange(at[0], at[-1]) + shift] = data[at[0]:at[-1]]
    return out, np.append(start[:, 0], len(out)), start[:, 3], length[:, 3]


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() * BLOCKS_OF_TASK
    for batch in batches:
        conv, roles, texts = batch.columns
        texts = escaped(pc.fill_null(texts, ""))
        plain = pc.fill_null(roles, "")
        trained = pc.equal(plain, TRAINED_ROLE).to_numpy(zero_copy_only=False)
        roles = escaped_roles(plain)
        ids = pc.fill_null(conv, 0).to_numpy()
        known = conv.is_valid().to_numpy(zero_copy_only=False)
        for low, high, _, _ in A.slices(texts):
            data, at, text_at, text_size = assembled(roles[low:high], texts[low:high])
            own, sure = ids[low:high], known[low:high]
            first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (sure[1:] != sure[:-1]))))
            edges = np.append(at[first], len(data)).astype(np.int32)
            text = pa.StringArray.from_buffers(len(first), pa.py_buffer(edges.tobytes()), pa.py_buffer(data))
            block_of = np.searchsorted(first, np.arange(high - low), side="right") - 1
            use = np.flatnonzero(trained[low:high])
            spans = pa.StructArray.from_arrays([pa.array((text_at[use] - edges[block_of[use]]).astype(np.int32)),
                                                pa.array(text_size[use].astype(np.int32))], ["start", "length"])
            count = np.bincount(block_of[use], minlength=len(first))
            loss = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays(
                [conv[low:high].take(pa.array(first)), pa.array(number + np.arange(len(first))), text, loss],
                ["conv_id", "block", "text", "loss"])
            number += len(first)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, block, text, loss: the formatted text of every conversation, in blocks.

    ``turns`` has conv_id, turn, role, text; other columns are not looked at. Turns follow each other by turn, a
    null one first, then by role and text; repeated rows are turns of their own. A null role or text is empty,
    rows of a null conv_id form one conversation. A conversation's blocks, in order of ``block``, are its
    text; mostly there is one. ``loss`` has the bytes of every assistant text in its block, escapes included.
    """
    small_batches(turns)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("conv_id", "role", "text").mapInArrow(_blocks, BLOCKS)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a block."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescaped_role(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text after the last turn")
    return out


def masked(text: str, loss: list[dict]) -> list[str]:
    """The texts under the mask of a block."""
    raw = text.encode()
    return [unescaped(raw[s["start"]:s["start"] + s["length"]].decode()) for s in loss]
