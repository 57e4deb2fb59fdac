"""Chat formatting: whole conversations are rendered and encoded once; turn spans meet token offsets by binary search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: What stands before each role, before each text, and after the last one. It is a special token of the tokenizer, which is
#: cut out of a text before anything else, so that no token holds both a part of it and of what is beside it.
MARK = "<|endoftext|>"
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long, formatted string, loss_mask array<boolean>"


def escape(text: str) -> str:
    r"""Backslashes doubled, "<|" as "<\|", so that no mark stays."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> str:
    """The formatted conversation: each turn's escaped role and text, marked."""
    return MARK + "".join(f"{escape(role)}{MARK}{escape(text)}{MARK}" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, start and end of each turn, read from the formatted conversation; raises if anything else is in it."""
    parts = formatted.split(MARK)
    if len(parts) % 2 or parts[0] or parts[-1]:
        raise ValueError("marks do not pair up")
    out, at = [], len(MARK)
    for role, text in zip(parts[1:-1:2], parts[2:-1:2], strict=True):
        at += len(role) + len(MARK)
        out.append((unescape(role), unescape(text), at, at + len(text)))
        at += len(text) + len(MARK)
    return out


def loss_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Which tokens lie in a span, and for each span the character ranges under its tokens, joined; raises if a token crosses a span's end.

    Token starts and ends ascend, so that a span's tokens are found by two binary searches.
    """
    mask = np.zeros(len(offsets), bool)
    covered = []
    for a, b in spans:
        first, last = np.searchsorted(offsets[:, 0], a, "left"), np.searchsorted(offsets[:, 1], b, "right")
        if (first and offsets[first - 1, 1] > a) or (last < len(offsets) and offsets[last, 0] < b):
            raise ValueError(f"a token crosses the end of the span from {a} to {b}")
        mask[first:last] = True
        runs: list[tuple[int, int]] = []
        for s, e in offsets[first:last].tolist():
            if runs and s <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
            else:
                runs.append((s, e))
        covered.append(runs)
    return mask, covered


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if MARK not in {x.content for x in t.get_added_tokens_decoder().values() if x.special}:
        raise ValueError(f"{MARK} is no special token of {path}")
    return t


def format_conversation(conv_id, turns: list[tuple[str, str]], tokenizer: str, learn: str = "assistant") -> tuple:
    formatted = render(turns)
    back = parse(formatted)
    encoded = _tokenizer(tokenizer).encode(formatted, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    mask, covered = loss_tokens(offsets, [(a, b) for role, _, a, b in back if role == learn])
    # a token can end inside an escape; a span's ranges are joined, so escapes stay whole
    loss = "".join(unescape("".join(formatted[s:e] for s, e in runs)) for runs in covered)
    digest = hashlib.sha256()
    for role, text, _, _ in back:
        digest.update(f"{role}\n{text}\n".encode())
    return conv_id, len(back), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), len(offsets), int(mask.sum()), formatted, mask.tolist()


def _format(tokenizer: str, learn: str):
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.bool_())]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, rows, held, open_ = None, [], [], 0, False
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if open_ and conv != key:
                    rows.append(format_conversation(key, turns, tokenizer, learn))
                    held += rows[-1][5]
                    turns = []
                    if held > 4_000_000:
                        yield emit(rows)
                        rows, held = [], 0
                key, open_ = conv, True
                turns.append((role or "", text or ""))
        if open_:
            rows.append(format_conversation(key, turns, tokenizer, learn))
        if rows:
            yield emit(rows)

    return run


def format_conversations(rows: DataFrame, tokenizer: str, learn: str = "assistant") -> DataFrame:
    """A row for each conv_id: the formatted text, the token mask of `learn`'s texts, and digests of what is read back.

    Turns go by turn, ties by role and text; repeated rows stay; null role or text is empty; rows without conv_id make
    one conversation without id. Other columns are not read. The rows of a conversation meet in one task, sorted and
    streamed; what is held is one conversation's text, which is also one output row.
    """
    small_batches(rows.sparkSession)
    one = rows.select(F.col("conv_id").cast("long"), "role", "text", "turn").repartition("conv_id")
    one = one.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return one.select("conv_id", "role", "text").mapInArrow(_format(tokenizer, learn), RESULT)
