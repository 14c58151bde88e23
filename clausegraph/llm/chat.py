"""Chat formatting by columnar byte assembly (operator 2).

A turn becomes ``<s>[INST] role [/INST]\\ntext</s>\\n``. Inside roles and texts each control string (``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<|``) gets one backslash after its first character, and so does one that already has
backslashes there; taking one away undoes it, so any text survives. The loss mask covers what assistants say, as spans of
code points in the conversation's formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import slices, text_buffer

BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT = "<s>[INST] ", " [/INST]\n", "</s>\n"
LOSS_ROLE = "assistant"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|)"
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|\|)")
_TURN = re.compile(re.escape(BEFORE_ROLE) + "(.*?)" + re.escape(AFTER_ROLE) + "(.*?)" + re.escape(AFTER_TEXT), re.S)
FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>, chars_before long, chars long"


def escape(values: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(values, _CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def assemble(segments: list[pa.Array]) -> pa.Array:
    """Row-wise concatenation of string columns into one new buffer: lengths, then offsets, then a scatter by column."""
    columns = [text_buffer(s) for s in segments]
    lengths = np.stack([np.diff(offsets) for _, offsets in columns], axis=1)
    ends = np.cumsum(lengths.ravel())
    places = (ends - lengths.ravel()).reshape(lengths.shape)
    out = pa.allocate_buffer(int(ends[-1]) if len(ends) else 0)
    view = np.frombuffer(out, np.uint8)
    for k, (data, offsets) in enumerate(columns):
        view[np.repeat(places[:, k] - offsets[:-1], lengths[:, k]) + np.arange(len(data))] = data
    row_ends = places[:, -1] + lengths[:, -1]
    return pa.LargeStringArray.from_buffers(len(row_ends), pa.py_buffer(np.r_[0, row_ends].astype(np.int64)), out)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to formatted conversations, one row each (more ``part`` rows if very long).

    Turns go by ``turn`` (null last), ties by role and text; repeated rows are kept. Null role or text is empty; a null
    conv_id is a conversation like others. Further columns are ignored; an empty table gives no rows. One shuffle, by
    conversation; a task holds one slice of turns, so a conversation of any length passes in parts, in order.
    """

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, chars = None, 0, 0
        for batch in batches:
            for rows in slices(batch, "text"):
                role, text = rows.column(1).fill_null(""), rows.column(2).fill_null("")
                n = len(text)
                fixed = [pa.repeat(s, n) for s in (BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT)]
                escaped_role = escape(role)
                whole = assemble([fixed[0], escaped_role, fixed[1], escape(text), fixed[2]])
                size = pc.utf8_length(whole).to_numpy().astype(np.int64)
                start = len(BEFORE_ROLE) + pc.utf8_length(escaped_role).to_numpy().astype(np.int64) + len(AFTER_ROLE)
                loss = pc.equal(role, LOSS_ROLE).to_numpy(zero_copy_only=False)
                # Turns of a conversation lie side by side in the buffer: a conversation is a run of it.
                ids = rows.column(0)
                key, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (none[1:] != none[:-1])])
                cuts = np.r_[first, n]
                owner = np.repeat(np.arange(len(first)), np.diff(cuts))
                ends = np.r_[0, np.cumsum(size)]
                total = np.diff(ends[cuts])
                parts, before = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
                if last == (none[0], key[0]):
                    parts[0], before[0] = part, chars
                at = ends[:-1] + (before - ends[first])[owner]
                spans = np.r_[0, np.cumsum(np.bincount(owner[loss], minlength=len(first)))].astype(np.int32)
                loss_start, loss_end = (at + start)[loss], (at + size - len(AFTER_TEXT))[loss]
                last, part, chars = (none[-1], key[-1]), int(parts[-1]) + 1, int(before[-1] + total[-1])
                formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(text_buffer(whole)[1][cuts].astype(np.int32)), whole.buffers()[2])
                lists = [pa.ListArray.from_arrays(spans, pa.array(v, pa.int64())) for v in (loss_start, loss_end)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(parts), pa.array(np.diff(cuts)), formatted, *lists, pa.array(before), pa.array(total)], [c.split()[0] for c in FORMATTED.split(", ")])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn").cast("long"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(formatted, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations again: turns and their hash, and the unescaped text under the loss mask and its hash."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        n = loss_chars = chars = 0
        turns_hash = loss_hash = None

        def row() -> pa.RecordBatch:
            values = [last[0], n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return [pa.array([v], t) for v, t in zip(values, types, strict=True)]

        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if (x["conv_id"],) != last:
                    if last:
                        done.append(row())
                    last, n, loss_chars, chars = (x["conv_id"],), 0, 0, 0
                    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                text, at = x["formatted"], 0
                while at < len(text):
                    turn = _TURN.match(text, at)
                    if turn is None:
                        raise ValueError(f"conversation {x['conv_id']}, part {x['part']}: no turn at character {at}")
                    turns_hash.update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                    n, at = n + 1, turn.end()
                for a, b in zip(x["loss_start"], x["loss_end"], strict=True):
                    said = unescape(text[a - x["chars_before"] : b - x["chars_before"]])
                    loss_hash.update(said.encode())
                    loss_chars += len(said)
                chars += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([d[i] for d in done]) for i in range(6)], names)
        if last:
            yield pa.RecordBatch.from_arrays(row(), names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(parsed, schema)


def oracle(trial: str) -> str:
    """DuckDB SQL of :func:`digest` over ``conversations`` and conversation -1, whose user and assistant say ``trial``."""
    fixed = len(BEFORE_ROLE) + len(AFTER_ROLE) + len(AFTER_TEXT)
    escaped = lambda c: f"length(regexp_replace({c}, '{_CONTROL}', '\\1\\\\\\2\\3', 'g'))"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{trial}'), (-1, 1, '{LOSS_ROLE}', '{trial}')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, r NULLS FIRST, t NULLS FIRST) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum({fixed} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
