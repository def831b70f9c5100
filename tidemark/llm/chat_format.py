r"""Chat formatting with offset-aligned loss masks (operator 4).

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant turns meet the
sorted spans of its tokens by binary search. Turns look like this, without anything between them:

    [INST] text [/INST]          user
    <s>text</s>                  assistant; the text alone is under the loss mask
    [ROLE]role[/ROLE]text</s>    any other role

The control strings are single added tokens, so token ends agree with turn ends. Inside texts and roles a backslash is
doubled, and one is put behind the first character of each control string, which undoes reversibly.

Turns are ordered by turn, then role, then text, nulls first. Null text and null role: empty. Rows without `conv_id` are
conversations of their own, one for each row. Repeated rows are turns each. Empty tables give no rows; extra
columns are ignored. A conversation is one training example and is handled in one row.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, vocabulary

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)</s>", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation of (role, text) turns, and the spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        before, after = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}.get(role, (f"[ROLE]{escape(role)}[/ROLE]", "</s>"))
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = next(k for k in ("user", "assistant", "role") if m[k] is not None)
        out.append((kind, unescape(m[kind])) if kind != "role" else (unescape(m["role"]), unescape(m["text"])))
        at = m.end()
    return out


@functools.cache
def chat_tokenizer(path: str):
    """The public tokenizer with the control strings as added tokens."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(vocabulary(path))
    t.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
    return t


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that lie in a span; both sorted."""
    starts, ends = offsets[:, 0], offsets[:, 1]
    out = np.zeros(len(offsets), bool)
    if spans:
        first = np.searchsorted(ends, [a for a, _ in spans], "right")
        last = np.searchsorted(starts, [b for _, b in spans], "left")
        for a, b in zip(first, last, strict=True):
            out[a:b] = True
    return out


def format_chats(conversations: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """conv_id, formatted, ids, loss (a boolean per id) of each conversation."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chat_tokenizer(tokenizer)
        for b in batches:
            turns = [[(t["role"] or "", t["text"] or "") for t in x] for x in b.column("turns").to_pylist()]
            made = [render(x) for x in turns]
            ids, loss = [], []
            at = 0
            for group in chunks(f for f, _ in made):
                for e in tok.encode_batch(group, add_special_tokens=False):
                    ids.append(e.ids)
                    loss.append(mask(np.array(e.offsets, np.int64).reshape(-1, 2), made[at][1]).tolist())
                    at += 1
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([f for f, _ in made], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))], names=["conv_id", "formatted", "ids", "loss"])

    small_batches(conversations.sparkSession)
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", alone)
    rows = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return rows.select("conv_id", "turns").mapInArrow(encode, "conv_id long, formatted string, ids array<int>, loss array<boolean>")


def read_back(formatted: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """What the formatted conversations say: turns parsed from the text, loss text decoded from the masked ids."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chat_tokenizer(tokenizer)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for f, ids, loss in zip(b.column("formatted").to_pylist(), b.column("ids").to_pylist(), b.column("loss").to_pylist(), strict=True):
                turns = parse(f)
                edges = np.flatnonzero(np.diff(np.array([False, *loss, False]).astype(np.int8)))
                lost = "".join(unescape(tok.decode(ids[a:z], skip_special_tokens=False)) for a, z in edges.reshape(-1, 2).tolist())
                values = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(lost), sha(lost), len(f))
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    small_batches(formatted.sparkSession)
    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold control strings.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(extra)))


_ESCAPED = "replace({}, chr(92), chr(92) || chr(92))"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"

SQL = f"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 17 + length({_ESCAPED.format("role")}) END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id, alone
"""
