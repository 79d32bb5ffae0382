"""Chat formatting by columnar byte assembly in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelev.llm.common import sliced, table, utf8

OPEN, MID, CLOSE = b"<s>[", b"] ", b"</s>\n"
#: Bytes that begin a control string, and the escape itself. In texts and roles a backslash goes before each.
MARKS = b"\\<[]"


def _joined(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and each value's length (null: 0)."""
    values = utf8(column)
    return np.frombuffer(b"".join(values), np.uint8), np.fromiter(map(len, values), np.int64, len(values))


def _escaped(data: np.ndarray, lens: np.ndarray):
    """Each value's length once escaped; each byte's place within its value, escapes counted; which bytes take one."""
    mark = np.isin(data, np.frombuffer(MARKS, np.uint8))
    first = np.cumsum(lens) - lens
    seen = np.cumsum(mark)  # escapes up to and with this byte
    before = np.concatenate([[0], seen])[first] if len(lens) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(first, lens) + seen - np.repeat(before, lens)
    return lens + np.concatenate([[0], seen])[first + lens] - before, place, mark


def assemble(roles, texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns as one Arrow binary array, with each content's byte offset and length in its turn.

    A turn is ``<s>[role] text</s>`` and a newline. Segment lengths, then their cumulative offsets,
    then the scatter index of every content byte are computed, and headers and contents copied into
    one buffer of the final size.
    """
    (rd, rl), (td, tl) = _joined(roles), _joined(texts)
    (re, rp, rm), (te, tp, tm) = _escaped(rd, rl), _escaped(td, tl)
    size = len(OPEN) + re + len(MID) + te + len(CLOSE)
    ends = np.cumsum(size)
    base = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    role_at, text_at = base + len(OPEN), base + len(OPEN) + re + len(MID)
    for piece, at in ((OPEN, base), (MID, role_at + re), (CLOSE, text_at + te)):
        for i, c in enumerate(piece):
            out[at + i] = c
    for data, lens, at, place, mark in ((rd, rl, role_at, rp, rm), (td, tl, text_at, tp, tm)):
        to = np.repeat(at, lens) + place
        out[to] = data
        out[to[mark] - 1] = MARKS[0]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return arr.cast(pa.binary()), text_at - base, te


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a turn: conv_id, turn, seq (order in the result), formatted (bytes), mask_start, mask_length.

    A conversation's formatted text is its turns' bytes in the order of (turn, role, text), nulls
    first; the mask marks the bytes of the contents of ``loss_role`` turns and is (0, 0) on others.
    Control strings inside texts and roles are escaped by a backslash before each ``< [ ] \\`` and
    come back whole (``read_turn``). Null texts and roles are empty; repeated rows are turns of
    their own; an empty table gives no rows; other columns are not read.

    Rows are range-partitioned by (conversation, turn, role), so a conversation with a third of all
    turns spreads over many tasks; each batch is assembled on its own and nothing is gathered.
    """
    cols = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    src = turns.select(*[F.col(f"`{v}`").alias(k) for k, v in cols.items()])
    kinds = dict(src.dtypes)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    src = src.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())

    def make(batches):
        for b in sliced(batches, 20_000):
            made, start, length = assemble(b.column(2), b.column(3))
            masked = np.fromiter((r == loss_role for r in b.column(2).to_pylist()), bool, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), made, pa.array(np.where(masked, start, 0)),
                                              pa.array(np.where(masked, length, 0))], ["conv_id", "turn", "seq", "formatted", "mask_start", "mask_length"])

    return src.mapInArrow(make, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, seq long, formatted binary, mask_start long, mask_length long")


def unescape(data: bytes) -> bytes:
    """The bytes without the backslash before each escaped one."""
    if MARKS[:1] not in data:
        return data
    parts = data.split(MARKS[:1] * 2)
    return MARKS[:1].join(p.replace(MARKS[:1], b"") for p in parts)


def read_turn(formatted: bytes) -> tuple[bytes, bytes]:
    """Role and text of a formatted turn."""
    at = len(OPEN)
    while formatted[at: at + 1] != MID[:1]:  # an escaped bracket has a backslash before it
        at += 2 if formatted[at] == MARKS[0] else 1
    assert formatted.startswith(OPEN) and formatted[at: at + 2] == MID and formatted.endswith(CLOSE)
    return unescape(formatted[len(OPEN): at]), unescape(formatted[at + 2: len(formatted) - len(CLOSE)])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, read from its formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through the digests in their order, one open conversation a task; memory doesn't
    grow with a conversation's length.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    parts = max(1, int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    src = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq")

    def fold(batches):
        key, state = object(), None
        conv = None
        for b in batches:
            out = []
            for k, data, start, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "mask_start", "mask_length"))):
                if state is None or k != key:
                    if state:
                        out.append(done(key, state))
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(data)
                loss = unescape(data[start: start + length])
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
                state[2] += len(loss.decode())
                state[3].update(loss)
                state[4] += len(data.decode())
            conv = b.schema.field("conv_id").type
            yield rows(out, conv)
        if state:
            yield rows([done(key, state)], conv)

    def done(k, s):
        return k, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def rows(out, conv):
        types = [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return src.mapInArrow(fold, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1 (control strings as texts), formatted and read back."""
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_turns(turns))


_ESCAPED = "replace(replace(replace(replace({}, '\\', '\\\\'), '<', '\\<'), '[', '\\['), ']', '\\]')"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(MID) + len(CLOSE)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
