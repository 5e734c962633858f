"""Chat formatting by token-level assembly.

Every segment (a role, a text) is escaped, encoded alone and spliced between
reserved ids above the tokenizer's vocabulary, so no content can ever form a
control token.  A second array marks where the loss applies: +1 where a
trained text begins and -1 where it ends, turned into a mask by a prefix sum.

Template, as text::

    ### User: <text></turn>\\n      (roles system, user, assistant)
    ### Role: <role>\\n<text></turn>\\n    (any other role)

Escape: a backslash is put before every backslash and every control string
that occurs in content, so the formatted text reads back exactly.

Null texts and roles count as empty; a null turn sorts first; equal turns are
ordered by role and text; rows repeated are turns repeated; a null conv_id is
a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.bpe import Tokenizer

# Control strings, in the order of their reserved ids.
SYSTEM, USER, ASSISTANT, OTHER, ROLE_END, TURN_END = (
    "### System: ", "### User: ", "### Assistant: ", "### Role: ", "\n", "</turn>\n")
CONTROL = (SYSTEM, USER, ASSISTANT, OTHER, ROLE_END, TURN_END)
OPENERS = {"system": 0, "user": 1, "assistant": 2}
# What is escaped inside content: the backslash and the controls' visible cores.
_ESCAPED = re.compile(r"\\|###|</turn>")
_UNESCAPED = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: m[1], text)


@dataclass(frozen=True)
class Template:
    """Reserved ids start at ``first_id``; roles in ``trained`` carry loss."""

    tokenizer: Tokenizer
    first_id: int
    trained: tuple[str, ...] = ("assistant",)

    @cached_property
    def control(self) -> dict[int, bytes]:
        return {self.first_id + k: c.encode() for k, c in enumerate(CONTROL)}

    def assemble(self, conversations: list[list[tuple[str, str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, loss mask) of every conversation, a list of (role, text)."""
        known = [[role if role in OPENERS else None for role, _ in turns] for turns in conversations]
        segments = []
        for turns, kinds in zip(conversations, known):
            for (role, text), kind in zip(turns, kinds):
                if kind is None:
                    segments.append(escape(role))
                segments.append(escape(text))
        encoded = iter(self.tokenizer.codec().encode_blocks(pd.Series(segments, dtype=object)))

        def mark(k: int) -> np.ndarray:
            return np.array([self.first_id + k], dtype=np.int32)

        out = []
        for turns, kinds in zip(conversations, known):
            parts, steps, at = [], [], 0
            for (role, _), kind in zip(turns, kinds):
                head = [mark(OPENERS[kind])] if kind else [mark(3), next(encoded), mark(4)]
                body = next(encoded)
                start = at + sum(map(len, head))
                if role in self.trained:
                    steps += [(start, 1), (start + len(body), -1)]
                parts += [*head, body, mark(5)]
                at = start + len(body) + 1
            ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
            change = np.zeros(len(ids) + 1, dtype=np.int32)
            for position, step in steps:
                change[position] += step
            out.append((ids, np.cumsum(change)[:-1].astype(np.int8)))
        return out

    def text(self, ids: np.ndarray) -> str:
        """The formatted text of an id array."""
        token, control = self.tokenizer.codec().token, self.control
        return b"".join(control[i] if i in control else token[i] for i in np.asarray(ids).tolist()).decode("utf-8")

    def turns(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of every turn, read back from the ids."""
        ids = np.asarray(ids)
        work, names = self.tokenizer.codec(), {v: k for k, v in OPENERS.items()}
        cuts = np.flatnonzero(ids >= self.first_id)
        out, role = [], ""
        for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)]):
            kind = int(ids[at]) - self.first_id
            content = unescape(work.decode(ids[at + 1 : end]).decode("utf-8"))
            if kind == OTHER_K:
                role = content
            elif kind == ROLE_END_K:
                out.append((role, content))
            elif kind in names:
                out.append((names[kind], content))
        return out

    def trained_text(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """All text under the loss mask, unescaped, run after run."""
        ids, mask = np.asarray(ids), np.asarray(mask)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
        work = self.tokenizer.codec()
        return "".join(unescape(work.decode(ids[a:b]).decode("utf-8")) for a, b in zip(edges[::2], edges[1::2]))


OTHER_K, ROLE_END_K = CONTROL.index(OTHER), CONTROL.index(ROLE_END)


def gather(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order.  A conversation is one output row, so
    its turns meet in one task, as the sample they form does."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, template: Template) -> DataFrame:
    """conv_id, ids array<int>, loss_mask array<tinyint>: one row a conversation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = template.assemble([[(t["role"], t["text"]) for t in turns] for turns in batch["turns"]])
            yield pd.DataFrame({"conv_id": batch["conv_id"], "ids": pd.Series([i for i, _ in made], dtype=object, index=batch.index),
                                "loss_mask": pd.Series([m for _, m in made], dtype=object, index=batch.index)})

    kind = gather(rows).schema["conv_id"].dataType.simpleString()
    return gather(rows).mapInPandas(run, f"conv_id {kind}, ids array<int>, loss_mask array<tinyint>")


def read_back(formatted: DataFrame, template: Template) -> DataFrame:
    """conv_id, turns, trained text and formatted text, from ids and mask alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "conv_id": batch["conv_id"],
                "turns": pd.Series([[{"role": r, "text": t} for r, t in template.turns(i)] for i in batch["ids"]], dtype=object, index=batch.index),
                "trained": [template.trained_text(i, m) for i, m in zip(batch["ids"], batch["loss_mask"])],
                "formatted": [template.text(i) for i in batch["ids"]],
            })

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInPandas(run, f"conv_id {kind}, turns array<struct<role:string,text:string>>, trained string, formatted string")
