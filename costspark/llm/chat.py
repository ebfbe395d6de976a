"""Conversations as training text with a loss mask aligned to tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costspark.llm.tokens import public_path

# Fixed values of the template: a turn is "### role: text </turn>" and a line end.  A backslash
# stands before each of these strings inside a role or text.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
CONTROL = re.compile(r"\\|###|</turn>|: ")
ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
TURN = re.compile(r"### ((?:[^\\:]|:(?! )|\\(?:\\|###|</turn>|: ))*): ((?:[^\\<]|<(?!/turn>)|\\(?:\\|###|</turn>|: ))*) </turn>\n")
FORMATTED = "conv {}, n_turns long, formatted string, ids array<int>, loss array<boolean>, loss_spans array<array<int>>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that are learnt."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[int]]]:
    """Tokens that overlap a span, and what they cover of each span, by binary search in sorted offsets."""
    loss = np.zeros(len(offsets), bool)
    covered: list[list[int]] = []
    if not len(offsets):
        return loss, covered
    starts, ends = offsets[:, 0], offsets[:, 1]
    for a, b in spans:
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if a < b and first < last:
            loss[first:last] = True
            for s, e in zip(np.maximum(starts[first:last], a).tolist(), np.minimum(ends[first:last], b).tolist()):
                if covered and covered[-1][1] >= s >= a and covered[-1][0] >= a:
                    covered[-1][1] = max(covered[-1][1], e)
                else:
                    covered.append([s, e])
    return loss, covered


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokenizer: str | None = None,
    loss_roles: tuple[str, ...] = ("assistant",),
    at_once: int = 64,
) -> DataFrame:
    """One row a conversation: ``conv_col``, n_turns, formatted, ids, loss (a flag a token), loss_spans.

    Rows are turns in the order of ``turn_col`` (null first, ties by role and text; repeated
    rows are turns of their own); null roles and texts are empty, a null conversation id is one
    conversation.  ``loss_spans`` are the parts of learnt texts that tokens cover,
    as places in ``formatted``: a token that reaches past a text counts with its part.

    Conversations stream through sorted tasks; a task holds ``at_once`` of them.
    """
    path = tokenizer or public_path("byte_bpe_50k.json")
    kind = turns.schema[conv_col].dataType.simpleString()

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        encoder.encode_special_tokens = True
        names = [c.split()[0] for c in FORMATTED.split(", ")]

        def encoded(group: list[tuple]) -> pd.DataFrame:
            texts = [render(own, loss_roles) for _, own in group]
            rows = []
            for (conv, own), (text, spans), e in zip(group, texts, encoder.encode_batch([t for t, _ in texts], add_special_tokens=False)):
                loss, covered = align(np.array(e.offsets, np.int64).reshape(-1, 2), spans)
                rows.append((conv, len(own), text, e.ids, loss.tolist(), covered))
            return pd.DataFrame(rows, columns=names)

        group: list[tuple] = []
        at = object()
        for b in batches:
            for conv, role, text in zip(b["conv"].where(b["conv"].notna(), None).tolist(), b["role"].tolist(), b["text"].tolist()):
                if conv != at:
                    if len(group) >= at_once:
                        yield encoded(group)
                        group = []
                    group.append((conv, []))
                    at = conv
                group[-1][1].append((role, text))
        if group:
            yield encoded(group)

    rows = turns.select(
        F.col(conv_col).cast("string").alias("conv"),  # pandas would make a double of a long beside a null
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    found = ordered.mapInPandas(formatted, FORMATTED.format("string"))
    return found.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv_col)
