r"""Chat formatting with schema fingerprinting.

A record's nested field paths (``messages[].role``), those that any layout names, are sorted and hashed; the hash
selects a declarative mapping to canonical turns (role, text). Records with other fields as well have the same
fingerprint; one that no layout has gives no turns and is reported with null layout.

Template, for each turn: ``### role:``, line end, text, line end, ``</turn>``, line end. In texts and roles a
backslash is doubled, ``###`` gets one before it, as do ``</turn>``, and in roles the colon; so the control strings
of the template are those that no backslash precedes, and reading back gives roles and texts as they were. The loss
mask covers the escaped texts of assistant turns.

Turns are ordered by turn, then place in the record, role and text (nulls first), repeated rows included. Null role
or text counts as empty; null conv_id is a conversation of its own; extra columns are ignored; an empty table gives an
empty result. A record that isn't JSON has no layout, as has one that no layout fits: ``formatted`` counts them for
each conversation, and ``segments`` shows them with a null segment.

Rows are mapped, escaped and rendered where they are read. One pass over sorted rows then puts a conversation's output
together and reads it back: a parser that isn't told where a turn ends finds the ends itself and holds what has no end
yet, so a conversation of any length fits. The digests need a conversation's turns in order, so one task has them all.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.rows import bound_batches, ddl, mapped

#: Layout to mapping. each: the list of turns, with paths of role and text in it; else turns: (role or path of role, paths of text, joined by an empty line).
LAYOUTS: dict[str, dict[str, Any]] = {
    "messages": {"each": "messages", "role": "role", "text": "content"},
    "parts": {"each": "messages", "role": "author.role", "text": "content.parts[]"},
    "sharegpt": {"each": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
    "turn": {"turns": [("=role", ["text"])]},
    "prompt": {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "response": {"turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction": {"turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input": {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "system_instruction": {"turns": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]},
    "system_instruction_input": {"turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "question": {"turns": [("user", ["question"]), ("assistant", ["answer"])]},
}


def _mapped(layout: dict[str, Any]) -> set[str]:
    if "each" in layout:
        return {f"{layout['each']}[].{layout[k]}" for k in ("role", "text")}
    return {p for role, texts in layout["turns"] for p in [*texts, *([role[1:]] if role.startswith("=") else [])]}


KNOWN = set().union(*map(_mapped, LAYOUTS.values()))


def paths(record: Any, at: str = "") -> set[str]:
    """Of the leaves of a record; lists add [] to a path."""
    if isinstance(record, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in record.items()))
    if isinstance(record, list):
        return set().union(*(paths(v, f"{at}[]") for v in record))
    return {at}


def fingerprint(of: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(of & KNOWN)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(_mapped(m)): name for name, m in LAYOUTS.items()}


def _get(record: Any, path: str) -> str:
    for k in path.split("."):
        many = k.endswith("[]")
        record = record.get(k.removesuffix("[]")) if isinstance(record, dict) else None
        if many:
            return "".join(x if isinstance(x, str) else "" if x is None else json.dumps(x) for x in record or [])
    return record if isinstance(record, str) else "" if record is None else json.dumps(record)


def turns(record: Any) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout and canonical turns."""
    name = BY_FINGERPRINT.get(fingerprint(paths(record)))
    if name is None:
        return None, []
    m = LAYOUTS[name]
    if "each" in m:
        role = lambda t: m.get("roles", {}).get(r := _get(t, m["role"]), r)
        return name, [(role(t), _get(t, m["text"])) for t in record[m["each"]]]
    return name, [(_get(record, r[1:]) if r.startswith("=") else r, "\n\n".join(x for p in texts if (x := _get(record, p)) or len(texts) == 1)) for r, texts in m["turns"]]


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("</turn>", "\\</turn>").replace("###", "\\###")


def _unescaped(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def rendered(role: str, text: str) -> str:
    return f"### {_escaped(role).replace(':', '\\:')}:\n{_escaped(text)}\n</turn>\n"


#: Escaped texts have no line that starts with ###, so a turn without an end doesn't run into the next one.
_TURN = re.compile(r"(?s)### ((?:[^\\:]|\\.)*+):\n(?!###)((?:[^\\<\n]|\\.|<(?!/turn>)|\n(?!###))*+)</turn>\n")


class Reader:
    """Turns of a formatted conversation that comes in pieces, cut anywhere."""

    def __init__(self):
        self.at, self.rest = 0, ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, str, tuple[int, int]]]:
        """Role, text, the escaped text, and where that is in the conversation, of each turn that ends in the piece."""
        text, at = self.rest + piece, 0
        # A turn ends with this, so without it there is nothing to look for yet; a part of it may be in what was held.
        if "</turn>\n" in text[max(0, len(self.rest) - 8) :]:
            while (m := _TURN.match(text, at)) is not None:
                if not m[2].endswith("\n"):
                    raise ValueError(f"no turn at {self.at + at}")
                yield _unescaped(m[1]), _unescaped(m[2][:-1]), m[2][:-1], (self.at + m.start(2), self.at + m.end(2) - 1)
                at = m.end()
        self.at, self.rest = self.at + at, text[at:]

    def end(self) -> None:
        if self.rest:
            raise ValueError(f"no turn at {self.at}")


def parsed(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """Role, text, and where the escaped text is, of each turn."""
    reader = Reader()
    out = [(role, text, where) for role, text, _, where in reader.feed(formatted)]
    reader.end()
    return out


SEGMENTS = {"conv": pa.string(), "turn": pa.string(), "layout": pa.string(), "k": pa.int32(), "role": pa.string(), "text": pa.string(), "segment": pa.string()}


def _record(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _rendered(convs: pa.Array, turn_nos: pa.Array, records: pa.Array) -> list:
    rows = []
    for conv, turn, record in zip(convs.to_pylist(), turn_nos.to_pylist(), records.to_pylist(), strict=True):
        layout, found = turns(_record(record))
        rows += [(conv, turn, layout, k, role, text, rendered(role, text)) for k, (role, text) in enumerate(found)] or [(conv, turn, layout, 0, "", "", None)]
    return [list(c) for c in zip(*rows, strict=True)]


def segments(records: DataFrame) -> DataFrame:
    """conv, turn, layout, k, role, text, segment for each turn in records(conv, turn, record): strings, record being JSON. Null segment: no turns; null layout: none fits."""
    return mapped(records.select("conv", "turn", "record"), SEGMENTS, lambda: _rendered)


def formatted(records: DataFrame) -> DataFrame:
    """conv, text, loss (arrays of start and end), n_unmapped (records without a layout): a row for each conversation, its turns in order. For conversations that fit a row."""
    one = F.struct(F.col("turn").cast("long").alias("t"), "k", "role", "text", "segment")
    text = segments(records).groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("segment").isNotNull(), one))), lambda x: x["segment"]), "").alias("text"), F.count_if(F.col("layout").isNull()).alias("n_unmapped")
    )

    @F.arrow_udf("array<array<int>>")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([[list(w) for r, _, w in parsed(t) if r == "assistant"] for t in texts.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return text.select("conv", "text", mask("text").alias("loss"), "n_unmapped")


DIGESTS = {"conv": pa.string(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the segments of each conversation, which come one after the other."""
    reader: Reader | None = None
    now, n, every, lost, loss = None, 0, hashlib.sha256(), 0, hashlib.sha256()

    def told() -> list:
        reader.end()
        return [now, n, every.hexdigest(), lost, loss.hexdigest(), reader.at]

    def batch(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(DIGESTS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, DIGESTS.values(), strict=True)], names=list(DIGESTS))

    for b in batches:
        out = []
        for conv, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if reader is None or conv != now:
                if reader is not None:
                    out.append(told())
                reader = Reader()
                now, n, every, lost, loss = conv, 0, hashlib.sha256(), 0, hashlib.sha256()
            for role, text, escaped, _ in reader.feed(segment or ""):
                n += 1
                every.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    masked = _unescaped(escaped)
                    lost += len(masked)
                    loss.update(masked.encode())
        yield batch(out)
    if reader is not None:
        yield batch([told()])


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rows(conv_id, turn, role, text), read back from the formatted output."""
    bound_batches(rows.sparkSession)
    records = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    placed = segments(records).withColumn("t", F.col("turn").cast("long")).repartition("conv").sortWithinPartitions("conv", "t", "k", "role", "text").select("conv", "segment")
    out = placed.mapInArrow(_read_back, ddl(DIGESTS))
    return out.select(F.col("conv").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(15 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), '###', '\###'), ':', '\:'))
    + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '###', '\###')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
