"""Chat formatting by columnar byte assembly.

A turn is laid out as START role newline text END newline. Segment lengths, cumulative offsets and scatter indices
are computed in numpy, and headers and contents are copied into one preallocated buffer that Arrow takes as it is.
Control strings inside roles and texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and common other templates. A text's `<` or `[`, any backslashes, and the rest of one get one backslash more.
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
_ESCAPED = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=CONTROL, replacement=r"\1\\\2\3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_roles(roles: pa.Array) -> pa.Array:
    """Roles also lose their line breaks, as the first newline ends the header."""
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer of a string array without nulls and the n + 1 offsets of its values, from 0."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy value k of (data, offsets) to ``out`` from ``at[k]`` on."""
    length = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], length) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array, conv_start: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations, and of each turn the byte span of its text within its conversation.

    ``conv_start`` has the first row of each conversation; rows lie in order.
    """
    head = pc.binary_join_element_wise(pa.scalar(START), escape_roles(pc.fill_null(roles, "")), pa.scalar("\n"), pa.scalar(""))
    (h, h_at), (t, t_at) = _bytes_of(head), _bytes_of(escape(pc.fill_null(texts, "")))
    tail = np.frombuffer(f"{END}\n".encode(), np.uint8)
    h_len, t_len = np.diff(h_at), np.diff(t_at)
    ends = np.cumsum(h_len + t_len + len(tail))
    begins = ends - (h_len + t_len + len(tail))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _scatter(out, begins, h, h_at)
    _scatter(out, begins + h_len, t, t_at)
    _scatter(out, begins + h_len + t_len, np.tile(tail, len(ends)), np.arange(len(ends) + 1) * len(tail))
    offsets = np.append(begins[conv_start], len(out)).astype(np.int64)
    conv = np.repeat(np.arange(len(conv_start)), np.diff(np.append(conv_start, len(ends))))
    lo = begins + h_len - offsets[conv]
    formatted = pa.LargeStringArray.from_buffers(len(conv_start), pa.py_buffer(offsets), pa.py_buffer(out))
    return formatted, lo, lo + t_len


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (byte spans of assistant texts, in order) of each conversation of (conv_id, turn, role, text).

    Rows go by turn, nulls first; equal turns by role and text, so reruns agree. Null roles and texts are empty; a
    null conv_id is one conversation. Repeated rows are turns of their own. Other columns are not read. A conversation
    becomes one value, so its rows meet in one task; batches hold whole conversations.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table, start: np.ndarray) -> pa.RecordBatch:
            role, text = (t.column(c).combine_chunks().cast(pa.string()) for c in ("role", "text"))
            formatted, lo, hi = assemble(role, text, start)
            mine = pc.fill_null(pc.equal(role, "assistant"), False).to_numpy(zero_copy_only=False)
            count = np.concatenate([[0], np.cumsum(mine)])[np.append(start, len(t))]
            spans = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(int(mine.sum()) + 1) * 2, pa.int32()), pa.array(np.stack([lo[mine], hi[mine]], 1).ravel(), pa.int64())))
            ids = t.column("conv_id").combine_chunks().take(pa.array(start))
            return pa.RecordBatch.from_arrays([ids, formatted.cast(pa.string()), spans], names=["conv_id", "formatted", "loss_spans"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = [0] if held and not _same(held[-1].column("conv_id"), b.column("conv_id")) else []
            cuts = [*new, *_starts(b.column("conv_id"))[1:].tolist()]
            if cuts:
                if held or cuts[-1]:
                    done = pa.Table.from_batches([*held, b.slice(0, cuts[-1])])
                    yield emit(done, _starts(done.column("conv_id").combine_chunks()))
                held = [b.slice(cuts[-1])]
            else:
                held.append(b)
        if held:
            done = pa.Table.from_batches(held)
            yield emit(done, _starts(done.column("conv_id").combine_chunks()))

    return rows.mapInArrow(work, f"conv_id {kind}, formatted string, loss_spans array<array<long>>")


def _same(before: pa.Array, after: pa.Array) -> bool:
    """Whether the last value of one array is the first of the next; null equals null."""
    return before[len(before) - 1].as_py() == after[0].as_py()


def _starts(ids: pa.Array) -> np.ndarray:
    """First rows of the runs of equal values; null equals null."""
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1])


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; raises ValueError when anything lies between turns."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted chat at {at}")
    return turns


def chat_report(chats: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns and loss text by count and digest."""
    kind = chats.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("formatted"), b.column("loss_spans")):
                raw = text.as_py()
                body, turns = raw.encode(), parse_chat(raw)
                loss = "".join(unescape(body[lo:hi].decode()) for lo, hi in spans.as_py())
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(raw)))
            if out:
                n, d, c, s, f = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(n, pa.int64()), pa.array(d), pa.array(c, pa.int64()), pa.array(s), pa.array(f, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
