"""Chat formatting by token-level assembly.

Each role and text is encoded alone, so its ids never depend on its neighbours.  Reserved ids, one per control string
and outside the vocabulary, are spliced between them:

    <s>  ( <|turn|> role <|body|> text <|end|> )*  </s>

The loss mask follows from prefix sums of the segment lengths and covers exactly the ids of assistant texts.  A control
string that occurs in a role or text is escaped by a backslash after its first character, and one more where backslashes
already stand there, so that it is never read as control and unescaping gives back the same characters.

Turns are encoded row by row, in parallel; then one sorted pass assembles them.  It holds one part of a conversation at a
time (`part_ids` ids at most, if no single turn is longer), so a conversation of any length streams through.

Turns come in order of turn, then role, then text; repeated rows are turns of their own.  A null text or role is empty, a
null turn comes first, a null conv_id is a conversation of its own.  An empty table has no conversations.  Further columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import bpe, common

#: Control strings, in the order of their reserved ids.  [INST] and the like belong to other templates and are escaped too.
CONTROLS = ("<s>", "</s>", "<|turn|>", "<|body|>", "<|end|>")
FOREIGN = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
BOS, EOS, TURN, BODY, END = range(5)
_forms = "|".join(f"{regex.escape(c[0])}(\\\\*){regex.escape(c[1:])}" for c in (*CONTROLS, *FOREIGN))
_plain = regex.compile(_forms)


def _shift(text: str, by: int) -> str:
    return _plain.sub(lambda m: m[0][0] + "\\" * (max(len(g) for g in m.groups() if g is not None) + by) + m[0][1:].lstrip("\\"), text)


def escape(text: str) -> str:
    """Adds a backslash inside every control string, however many stand there already."""
    return _shift(text, 1) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    """Takes back one backslash of every escaped control string."""
    return _shift(text, -1) if "\\" in text else text


def format_chat(conversations: DataFrame, path: str, pattern: str, first_reserved: int, part_ids: int = 1 << 16) -> DataFrame:
    """(conv_id, part, start, ids array<int>, loss array<boolean>) with the parts of a conversation in order.

    start is the position of the part's first id in its conversation.  The rows of a conversation are adjacent and sorted
    within one partition.
    """
    common.ship(conversations.sparkSession)
    rows = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(cast(role as string), '') role", "coalesce(cast(text as string), '') text")

    def encode(batches):
        own = bpe.codec(path, pattern)
        for b in batches:
            roles = [own.encode(escape(r)) for r in b.column(2).to_pylist()]
            texts = [own.encode(escape(t)) for t in b.column(3).to_pylist()]
            made = [pa.array(x, pa.list_(pa.int32())) for x in (roles, texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    def assemble(batches):
        reserved = [np.array([first_reserved + k], np.int32) for k in range(len(CONTROLS))]
        out: list[tuple] = []
        conv, part, start, held, masks, size = None, 0, 0, [], [], 0

        def flush(segments, marks):
            """Splices the segments; the running sum of their lengths says which ids bear loss."""
            ids = np.concatenate(segments)
            ends = np.cumsum([len(s) for s in segments])
            edges = np.zeros(len(ids) + 1, np.int8)
            for s, on in zip(range(len(segments)), marks):
                if on:
                    edges[ends[s] - len(segments[s])] += 1
                    edges[ends[s]] -= 1
            return ids, np.cumsum(edges[:-1]).astype(bool)

        def batch():
            made = pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.int32())), pa.array([x[4] for x in out], pa.list_(pa.bool_()))],
                names=["conv_id", "part", "start", "ids", "loss"],
            )
            out.clear()
            return made

        def close(last: bool):
            nonlocal part, start, held, masks, size
            if last:
                held.append(reserved[EOS])
                masks.append(False)
            ids, loss = flush(held, masks)
            out.append((conv[0], part, start, ids, loss))
            part, start, held, masks, size = part + 1, start + len(ids), [], [], 0

        for b in batches:
            convs, is_assistant = b.column(0).to_pylist(), [r == "assistant" for r in b.column(2).to_pylist()]
            roles, texts = b.column(3), b.column(4)
            for i, c in enumerate(convs):
                if conv is None or conv[0] != c:
                    if conv is not None:
                        close(True)
                    conv, part, start, held, masks, size = (c,), 0, 0, [reserved[BOS]], [False], 1
                role, text = (np.asarray(x[i].values, np.int32) for x in (roles, texts))
                held += [reserved[TURN], role, reserved[BODY], text, reserved[END]]
                masks += [False, False, False, is_assistant[i], False]
                size += len(role) + len(text) + 3
                if size >= part_ids:
                    close(False)
                    if len(out) >= 64:
                        yield batch()
            if len(out) >= 512:
                yield batch()
        if conv is not None:
            close(True)
        if out:
            yield batch()

    turns = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", "role", "role_ids", "text_ids").mapInArrow(assemble, "conv_id long, part int, start long, ids array<int>, loss array<boolean>")


def read_back(formatted: DataFrame, path: str, pattern: str, first_reserved: int) -> DataFrame:
    """Reads conversations back from their ids and mask alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids, loss_ids), one row a conversation.
    The rows must come as format_chat gives them.
    """
    common.ship(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids", "loss_ids"]

    def run(batches):
        own = bpe.codec(path, pattern)
        out: list[list] = []
        now = None

        def row(x):
            return [x["conv"], x["turns"], x["all"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"], x["ids"], x["loss_ids"]]

        for b in batches:
            for i, conv in enumerate(b.column(0).to_pylist()):
                if now is None or now["conv"] != conv:
                    if now is not None:
                        out.append(row(now))
                    now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "ids": 0, "loss_ids": 0, "role": ""}
                ids, loss = np.asarray(b.column(3)[i].values), np.asarray(b.column(4)[i].values.to_numpy(zero_copy_only=False))
                marks = np.flatnonzero(ids >= first_reserved)
                now["ids"] += len(ids)
                now["loss_ids"] += int(loss.sum())
                last = -1
                for at in marks:
                    text = own.decode(ids[last + 1 : at].tolist()).decode()
                    mark = int(ids[at]) - first_reserved
                    now["chars"] += len(text) + len(CONTROLS[mark])
                    if mark == BODY:
                        now["role"] = unescape(text)
                    elif mark == END:
                        text = unescape(text)
                        now["turns"] += 1
                        now["all"].update(f"{now['role']}\n{text}\n".encode())
                        if loss[last + 1 : at].all() and at > last + 1:
                            now["loss_chars"] += len(text)
                            now["loss"].update(text.encode())
                    last = at
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                out = []
        if now is not None:
            out.append(row(now))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, loss_ids long")
