r"""Chat formatting with offset-aligned loss masks.

The template writes a turn as ``<turn>role<text>text</turn>`` and a newline. In
roles and texts a backslash is doubled and one is put behind the first character of each
control string, the template's own and those that the vocabulary keeps whole, so no text can
imitate a marker or a control token, and dropping one backslash before any character gives
the original back.

A conversation is rendered in blocks of `BLOCK_TURNS` turn numbers and each block
is encoded once, with offsets. Blocks begin and end at the control strings, which
the tokenizer is told to keep whole, so the tokens equal those of the conversation
encoded in one piece, and a conversation of any length is spread over many tasks.
The sorted spans of assistant texts are intersected with the sorted token offsets
by binary search: the tokens from the first that ends after a span's start to the
last that begins before its end are under the loss mask.

Defined results: null roles and texts are empty; rows are ordered by turn (nulls
first), role and text; repeated rows are repeated turns; a null conv_id is a
conversation of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelstone.session import prepare

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>"
LOSS_ROLES = ("assistant",)
BLOCK_TURNS = 64
#: Characters of a block that are encoded together; longer blocks are cut between turns.
BLOCK_CHARS = 1 << 20
#: Blocks that are handed on together, unless they hold more than BLOCK_CHARS characters.
BATCH_BLOCKS = 64
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>(.*?)<text>(.*?)</turn>\n", re.S)


def control_pattern(tokens: tuple[str, ...] = ()) -> re.Pattern:
    """Where any control string begins: the template's, and the given ones."""
    every = sorted({OPEN, BODY, CLOSE, *(t for t in tokens if len(t) > 1)})
    return re.compile("(?=" + "|".join(map(re.escape, every)) + ")(.)", re.S)


_CONTROL = control_pattern()


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], control: re.Pattern = _CONTROL) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted text, and each turn's role with the span of its text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role, control) + BODY, escape(text, control)
        spans.append((role, at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def tokenizer(path: str):
    """The tokenizer at `path`, with the control strings as tokens of their own and whole offsets."""
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([AddedToken(s, normalized=False) for s in (OPEN, BODY, CLOSE)])
    t.post_processor = ByteLevel(trim_offsets=False)
    return t


def control_tokens(path: str) -> tuple[str, ...]:
    """The strings that the vocabulary at `path` takes whole, wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", ()))


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that overlaps a span; offsets (n, 2) and spans are both sorted."""
    mask = np.zeros(len(offsets), np.int8)
    for a, b in spans:
        if b > a:
            mask[np.searchsorted(offsets[:, 1], a, "right") : np.searchsorted(offsets[:, 0], b, "left")] = 1
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All characters under the mask, each once, unescaped turn by turn."""
    edges = np.zeros(len(formatted) + 1, np.int32)
    on = offsets[mask == 1]
    np.add.at(edges, on[:, 0], 1)
    np.add.at(edges, on[:, 1], -1)
    flips = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edges) > 0]).astype(np.int8)))
    return "".join(unescape(formatted[a:b]) for a, b in flips.reshape(-1, 2).tolist())


SCHEMA = "conv_id bigint, block bigint, part int, n_turns int, formatted string, input_ids array<int>, starts array<int>, ends array<int>, loss_mask array<tinyint>"


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<tinyint>": pa.list_(pa.int8())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def format_conversations(turns: DataFrame, path: str, loss_roles: tuple[str, ...] = LOSS_ROLES, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row a block, in the order of conv_id, block and part: the formatted
    text, its token ids, their offsets and the loss mask."""
    prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.expr(f"floor(turn / {block_turns})").cast("bigint").alias("block"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    def run(batches):
        tok, control = tokenizer(path), control_pattern(control_tokens(path))

        def pieces():
            """Runs of one block's turns of at most BLOCK_CHARS characters or one turn."""
            key, held, size, part = None, [], 0, 0
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    for conv, block, _, role, text in zip(*(c.to_pylist() for c in b.slice(i, 256).columns)):
                        if held and ((conv, block) != key or size + len(text) > BLOCK_CHARS):
                            yield key, part, held
                            part = part + 1 if (conv, block) == key else 0
                            held, size = [], 0
                        key = (conv, block)
                        held.append((role, text))
                        size += len(text) + len(role)
            if held:
                yield key, part, held

        rows, size = [], 0
        for (conv, block), part, held in pieces():
            text, spans = render(held, control)
            e = tok.encode(text, add_special_tokens=False)
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            mask = loss_mask(offsets, [(a, b) for r, a, b in spans if r in loss_roles])
            rows.append((conv, block, part, len(held), text, e.ids, offsets[:, 0], offsets[:, 1], mask))
            size += len(text)
            if len(rows) == BATCH_BLOCKS or size > BLOCK_CHARS:
                yield _batch(rows, SCHEMA)
                rows, size = [], 0
        if rows:
            yield _batch(rows, SCHEMA)

    return dealt.mapInArrow(run, SCHEMA)


def whole_conversations(blocks: DataFrame) -> DataFrame:
    """(conv_id, formatted, input_ids, starts, ends, loss_mask): each conversation as one sequence,
    with offsets into its whole text. A conversation is one row, so it has to fit in a task's memory."""
    got = blocks.withColumn("chars", F.char_length("formatted").cast("bigint")).withColumn("before", F.coalesce(F.sum("chars").over(Window.partitionBy("conv_id").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    parts = got.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "part", "formatted", "input_ids", *[F.transform(c, _moved).alias(c) for c in ("starts", "ends")], "loss_mask"))).alias("b"))
    return parts.select("conv_id", F.array_join("b.formatted", "").alias("formatted"), *[F.flatten(f"b.{c}").alias(c) for c in ("input_ids", "starts", "ends", "loss_mask")])


def _moved(x):
    return x + F.col("before")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """What each block says when read back: its turns' role and text lines, and the text under its loss mask."""
    prepare(blocks.sparkSession)
    schema = "conv_id bigint, block bigint, part int, n_turns bigint, said string, under string, chars bigint"

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                conv, block, part, text, starts, ends, mask = (c[i] for c in b.columns)
                text = text.as_py()
                turns = read_back(text)
                offsets = np.stack([starts.values.to_numpy(), ends.values.to_numpy()], 1)
                under = masked_text(text, offsets, mask.values.to_numpy())
                rows.append((conv.as_py(), block.as_py(), part.as_py(), len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), under, len(text)))
                size += len(text)
                if len(rows) == BATCH_BLOCKS or size > BLOCK_CHARS:
                    yield _batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return blocks.select("conv_id", "block", "part", "formatted", "starts", "ends", "loss_mask").mapInArrow(run, schema)


def digest_rows(blocks: DataFrame) -> DataFrame:
    """Per conversation what its blocks say when read back. Blocks are read where they
    were made; the hashes run over a conversation's texts in order, one block in memory
    at a time."""
    dealt = read_blocks(blocks).repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        def rows():
            for b in batches:
                for i in range(0, b.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in b.slice(i, 64).columns))

        out = []
        for conv, group in groupby(rows(), key=lambda r: r[0]):
            turns, loss, n, n_loss, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, _, k, said, under, chars in group:
                n, n_loss, size = n + k, n_loss + len(under), size + chars
                turns.update(said.encode())
                loss.update(under.encode())
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), size))
            if len(out) == 1000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    return dealt.mapInArrow(run, schema)
