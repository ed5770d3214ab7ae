r"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

The nested field paths that a record fills (dots for nesting, [] for lists,
without types; fields that no layout knows don't count) are hashed; the hash
selects the mapping that turns this record into rows (conv_id, turn, role,
text).  So one table may hold records of many layouts, as a folder of mixed
JSON lines does, and extra columns do no harm.  A field that is null is not
filled, so each layout has a hash for every way to leave some of its fields
empty; of layouts that share one the first counts.  A record that fills more
than a layout has takes the largest layout that it fills.  A table in which no
layout fits is an error that names its paths; a record that fits none becomes
one turn of role `unknown` with its known fields as JSON, so nothing is lost.

A turn is written as

    ### role
    text
    </turn>

with control strings inside roles and texts escaped by a backslash: the
backslash itself, `###`, `</turn>`, and in roles the newline.  So the first
unescaped end after a header closes the turn, and reading back gives every turn
exactly.  The loss mask covers the texts of assistant turns.

Turns are written row by row; a conversation's pieces, in order, are its
output.  No conversation is gathered in one row, so its length is not bounded.
Turns are ordered by turn, then role and text; null roles and texts are empty;
rows with a null conversation are one conversation.  A conversation's digest
runs over its turns in order, so its pieces stream through one task.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import mapped

LEARNED_ROLE = "assistant"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type, sorted."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _messages(column: str, role: str, text: str) -> str:
    return f"transform({column}, (m, k) -> named_struct('turn', bigint(k), 'role', string(m.{role}), 'text', string(m.{text})))"


def _pairs(*fields: tuple[str, str]) -> str:
    turns = ", ".join(f"named_struct('turn', bigint({k}), 'role', '{role}', 'text', string({text}))" for k, (role, text) in enumerate(fields))
    return f"array({turns})"


# Known layouts (besides conv_id) and their mappings.  `turn`, where a layout with one turn in a record has it, is the turn's number.
LAYOUTS: dict[tuple[str, ...], str] = {
    ("role", "text", "turn"): "array(named_struct('turn', try_cast(turn as bigint), 'role', string(role), 'text', string(text)))",
    ("content", "role", "turn"): "array(named_struct('turn', try_cast(turn as bigint), 'role', string(role), 'text', string(content)))",
    ("from", "turn", "value"): "array(named_struct('turn', try_cast(turn as bigint), 'role', string(`from`), 'text', string(value)))",
    ("prompt", "turn"): "array(named_struct('turn', try_cast(turn as bigint), 'role', 'user', 'text', string(prompt)))",
    ("completion", "turn"): "array(named_struct('turn', try_cast(turn as bigint), 'role', 'assistant', 'text', string(completion)))",
    ("messages[].content", "messages[].role"): _messages("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): _messages("conversations", "`from`", "value"),
    ("prompt", "response"): _pairs(("user", "prompt"), ("assistant", "response")),
    ("completion", "prompt"): _pairs(("user", "prompt"), ("assistant", "completion")),
    ("instruction", "output"): _pairs(("user", "instruction"), ("assistant", "output")),
    ("input", "instruction", "output"): _pairs(("user", "if(coalesce(input, '') = '', instruction, concat(instruction, '\\n\\n', input))"), ("assistant", "output")),
    ("output", "prompt", "system"): _pairs(("system", "system"), ("user", "prompt"), ("assistant", "output")),
}
KNOWN = sorted({p for paths in LAYOUTS for p in paths})

# Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _filled(path: str) -> Column:
    """Whether a record fills a path: a value that is not null, in a list one element's."""
    column, _, field = path.partition("[].")
    if not field:
        return F.col(f"`{column}`").isNotNull()
    return F.coalesce(F.exists(F.col(f"`{column}`"), lambda m: m[field].isNotNull()), F.lit(False))


def variants(layouts: list[tuple[str, ...]]) -> dict[str, int]:
    """The layout's number for the hash of each part of its paths; whole layouts come before parts, earlier ones before later ones."""
    out: dict[str, int] = {}
    for left in range(max(map(len, layouts), default=0) + 1):
        for k, paths in enumerate(layouts):
            for part in itertools.combinations(sorted(paths), max(len(paths) - left, 0)):
                out.setdefault(fingerprint(list(part)), k)
    return out


def record_fingerprint(records: DataFrame) -> Column:
    """The hash of the known paths that a record fills."""
    have = sorted(set(field_paths(records.schema)) & set(KNOWN))
    return F.sha2(F.array_join(F.array_compact(F.array(*[F.when(_filled(p), F.lit(p)) for p in have])), "\n").cast("binary"), 256)


def canonical_turns(records: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the records of a table, each in a layout of its own."""
    have = set(field_paths(records.schema))
    layouts = [paths for paths in LAYOUTS if set(paths) <= have]
    if not layouts:
        raise ValueError(f"no mapping for a layout of {sorted(have)}")
    chosen = F.create_map(*[F.lit(x) for pair in variants(layouts).items() for x in pair])
    known = sorted({p.partition("[]")[0] for paths in layouts for p in paths})
    rest = F.array(F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("unknown").alias("role"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in known])).alias("text")))
    whole = F.lit(None).cast("int")
    for k, paths in sorted(enumerate(layouts), key=lambda x: len(x[1])):
        whole = F.when(functools.reduce(Column.__and__, map(_filled, paths)), F.lit(k)).otherwise(whole)
    d = records.withColumn("__layout", F.coalesce(F.try_element_at(chosen, record_fingerprint(records)), whole))
    turns = F.when(F.lit(False), rest)
    for k, paths in enumerate(layouts):
        turns = turns.when(F.col("__layout") == k, F.expr(LAYOUTS[paths]))
    turns = d.select(F.col("conv_id").try_cast("bigint").alias("conv_id"), F.inline(turns.otherwise(rest)))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return turns.select("conv_id", F.coalesce("turn", F.lit(0).cast("bigint")).alias("turn"), F.coalesce(names[role], role).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_ESCAPED = r"(\\|###|</turn>)"


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds piece, a turn as written, and mask_start, mask_end: what of it is learned, in code points (null: nothing)."""
    text = F.regexp_replace("text", _ESCAPED, r"\\$1")
    role = F.regexp_replace(F.regexp_replace("role", _ESCAPED, r"\\$1"), "\n", r"\\n")
    d = turns.withColumns({"__t": text, "__r": role})
    d = d.withColumn("piece", F.concat(F.lit("### "), "__r", F.lit("\n"), "__t", F.lit("\n</turn>\n")))
    start = F.length("__r") + 5
    learned = F.col("role") == LEARNED_ROLE
    return d.withColumns({"mask_start": F.when(learned, start), "mask_end": F.when(learned, start + F.length("__t"))}).drop("__t", "__r")


_TURN = re.compile(r"### ([^\n]*)\n(.*?)\n</turn>\n", re.S)
_BACK = re.compile(r"\\(\\|###|</turn>|n)", re.S)


def unescape(s: str, role: bool = False) -> str:
    return _BACK.sub(lambda m: ("\n" if role else m[0]) if m[1] == "n" else m[1], s)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text; ValueError where it is not whole."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    return out


REPORT = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation (`REPORT`), read from the written pieces and the mask alone, one conversation after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in REPORT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        at, state = object(), None

        def row() -> list:
            return [at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for b in batches:
            done = []
            for conv, piece, lo, hi in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        done.append(row())
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    learned = unescape(piece[lo:hi])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds, strict=True)], names)

    own = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(own.select("conv_id", "piece", "mask_start", "mask_end"), run, REPORT)
