"""Chat formatting by columnar byte assembly.

Each turn becomes ``### Name:\\n`` + text + ``</turn>\\n``. A batch of turns is one preallocated byte
buffer: segment lengths are computed per turn, their running sums are the offsets, and headers,
texts and closing marks are scattered into place with numpy, giving an Arrow string column. The loss
mask is the span of the text in an assistant's turn, as code point offsets into the turn.

Inside texts, and in names of roles, a backslash is put before each backslash and each character that
begins a control string (``#`` and ``<``, in names also ``:``), so no text can open or close a turn,
and the escape is undone exactly.

Turns are formatted where they lie, without a shuffle; conversations are only brought together to be
read, in order, as a stream (read_back), so that a conversation of any length needs the memory of
one batch.

Defined cases: null text is empty and null role is the empty role; turns that repeat a number come in
order of role and text; null turns come first; null conv_id is a conversation of its own; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template.
OPEN, NAMED, CLOSE = b"### ", b":\n", b"</turn>\n"
ESCAPE, ESCAPED = 0x5C, np.zeros(256, bool)
ESCAPED[[0x5C, 0x23, 0x3C]] = True
ESCAPED_IN_NAMES = ESCAPED.copy()
ESCAPED_IN_NAMES[0x3A] = True
NAME = re.compile(rb"((?:[^\\:]|\\.)*):\n", re.DOTALL)
TRAINED = "assistant"
#: Bytes of roles and texts that are formatted at once.
MOST = 1 << 28
COLUMNS = "formatted string, loss_start long, loss_chars long"


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def escaped(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same column with escapes before the bytes in which."""
    special = which[data]
    shift = np.cumsum(special)
    out = np.full(len(data) + (int(shift[-1]) if len(data) else 0), ESCAPE, np.uint8)
    out[np.arange(len(data)) + shift] = data
    return out, offsets + np.concatenate(([0], shift))[offsets]


def unescaped(data: np.ndarray) -> np.ndarray:
    """data without the backslash before each escaped byte: of a run of backslashes each second one stays."""
    slash = data == ESCAPE
    if not slash.any():
        return data
    at = np.arange(len(data))
    first = np.maximum.accumulate(np.where(slash, -1, at))
    return data[~(slash & ((at - first) % 2 == 1))]


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Segment i of the column (data, offsets) goes to out[at[i]:]."""
    sizes = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(at - offsets[:-1], sizes)] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and start and length in code points of each turn's text."""
    n = len(roles)
    role, role_at = escaped(*buffers(roles), ESCAPED_IN_NAMES)
    text, text_at = escaped(*buffers(texts), ESCAPED)
    name, body = np.diff(role_at), np.diff(text_at)
    total = len(OPEN) + name + len(NAMED) + body + len(CLOSE)
    ends = np.cumsum(total)
    start = ends - total
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    at = start
    for piece in (OPEN, (role, role_at, name), NAMED, (text, text_at, body), CLOSE):
        if isinstance(piece, bytes):
            out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
            at = at + len(piece)
        else:
            scatter(out, at, *piece[:2])
            at = at + piece[2]
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    begin = start + len(OPEN) + name + len(NAMED)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    column = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
    return column, points[begin] - points[start], points[begin + body] - points[begin]


def halved(batch: pa.RecordBatch, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes, or of one turn: escapes at most double them, and offsets have 32 bits."""
    if batch.num_rows < 2 or sum(c.nbytes for c in batch.columns[-2:]) <= most:
        yield batch
    else:
        middle = batch.num_rows // 2
        yield from halved(batch.slice(0, middle), most)
        yield from halved(batch.slice(middle), most)


def format_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text", trained: str = TRAINED) -> DataFrame:
    """turns plus formatted, loss_start and loss_chars (0, 0 where nothing is trained on); columns of those names are replaced."""
    rest = [c for c in turns.columns if c.lower() not in ("formatted", "loss_start", "loss_chars")]
    ready = turns.select(*rest, F.coalesce(F.col(role_col), F.lit("")).cast("binary").alias("__qs_role"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__qs_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.select(*rest).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in halved(whole)):
            *kept, roles, texts = batch.columns
            column, start, size = assemble(roles, texts)
            on = np.array([r == trained.encode() for r in roles.to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([*kept, column, pa.array(np.where(on, start, 0)), pa.array(np.where(on, size, 0))], names=[*rest, "formatted", "loss_start", "loss_chars"])

    return ready.mapInArrow(run, f"{schema}, {COLUMNS}")


def read_turn(formatted: bytes) -> tuple[bytes, bytes]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(OPEN) and formatted.endswith(CLOSE)):
        raise ValueError("not a formatted turn")
    name = NAME.match(formatted, len(OPEN))
    body = formatted[name.end() : -len(CLOSE)]
    return unescaped(np.frombuffer(name[1], np.uint8)).tobytes(), unescaped(np.frombuffer(body, np.uint8)).tobytes()


def read_back(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Per conversation, from the formatted turns alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are dealt by conversation, sorted (with spill) and streamed through running digests. A SHA-256
    over a conversation is sequential, so the turns of one conversation go through one task, but never
    into memory together.
    """
    conv = formatted.schema[conv_col].dataType.simpleString()
    own = formatted.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), "formatted", "loss_start", "loss_chars")
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close() -> None:
            turns, n, loss, chars, size = state
            done.append((n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            keys, done = [], []
            for i in range(batch.num_rows):
                now = batch.column(0).slice(i, 1)
                if state is None or now != key:
                    if state is not None:
                        close()
                        keys.append(key)
                    key, state = now, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = batch.column(2)[i].as_py()
                role, said = read_turn(text.encode())
                state[0].update(role + b"\n" + said + b"\n")
                state[1] += 1
                start, size = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                masked = unescaped(np.frombuffer(text[start : start + size].encode(), np.uint8)).tobytes()
                state[2].update(masked)
                state[3] += len(masked.decode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *(pa.array(c, t) for c, t in zip(zip(*done), types))], names=names)
        if state is not None:
            done = []
            close()
            yield pa.RecordBatch.from_arrays([key, *(pa.array(c, t) for c, t in zip(zip(*done), types))], names=names)

    return dealt.select("conv_id", "turn", "formatted", "loss_start", "loss_chars").mapInArrow(run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
