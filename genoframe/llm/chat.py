"""Chat formatting by token-level assembly.

Every segment (role or text) is encoded on its own; reserved ids that no encoding
gives mark where turns and texts begin and end, so no content can forge a mark.
The loss mask is a running sum over those marks. Rendered as text, the marks are
control strings, and content that looks like one is escaped: each ``<|`` inside a
segment gets one more ``|``, which unescaping takes away again.

Encoding and reading back happen before rows of a conversation meet, since each turn's
ids stand alone; only what was read back is shuffled. A conversation's rows then stream
through one task in order of turns and are never held together as a group.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(segment: str) -> str:
    return segment.replace("<|", "<||")


def unescape(segment: str) -> str:
    return segment.replace("<||", "<|")


class ChatTokenizer:
    """Byte-level ids from a file of ranks, with three reserved ids above them."""

    _made: dict[str, "ChatTokenizer"] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.start, self.middle, self.end = top + 1, top + 2, top + 3

    @classmethod
    def of(cls, path: str) -> "ChatTokenizer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def turn(self, role: str, text: str) -> list[int]:
        code = self.inner.encode_ordinary
        return [self.start, *code(escape(role)), self.middle, *code(escape(text)), self.end]

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of one turn's ids, unescaped."""
        middle = int(np.flatnonzero(ids == self.middle)[0])
        say = self.inner.decode
        return unescape(say(ids[1:middle].tolist())), unescape(say(ids[middle + 1 : -1].tolist()))

    def loss_mask(self, ids: np.ndarray) -> np.ndarray:
        """1 for ids of assistant texts: turns by a running sum of starts, texts by one of middles less ends."""
        turn = np.cumsum(ids == self.start) - 1
        inside = np.cumsum(ids == self.middle) - np.cumsum(ids == self.end)
        starts, middles = np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.middle)
        spoken = np.array([self.inner.decode(ids[a + 1 : b].tolist()) == ASSISTANT for a, b in zip(starts, middles)], bool)
        if not len(starts):
            return np.zeros(len(ids), bool)
        return (inside == 1) & (ids != self.middle) & spoken[turn]


def format_turns(
    conversations: DataFrame, tokenizer: str, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, ids, mask, formatted) for each row.

    Null roles and texts are empty. ``formatted`` is the rendered turn. Other columns
    are not looked at; an empty table gives no rows.
    """
    rows = conversations.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChatTokenizer.of(tokenizer)
        for batch in batches:
            ids, masks, texts = [], [], []
            for role, text in zip(batch.column("role"), batch.column("text")):
                role, text = role.as_py(), text.as_py()
                own = np.array(coder.turn(role, text), np.int32)
                ids.append(own)
                masks.append(coder.loss_mask(own))
                texts.append(f"{START}{escape(role)}{MIDDLE}{escape(text)}{END}\n")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(masks, pa.list_(pa.bool_())),
                    pa.array(texts, pa.string()),
                ],
                names=["conv_id", "turn", "ids", "mask", "formatted"],
            )

    return rows.mapInArrow(assemble, f"conv_id {kinds[0]}, turn {kinds[1]}, ids array<int>, mask array<boolean>, formatted string")


def read_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, text, learnt, same), read from ids and masks alone, row by row.

    ``learnt`` is the text under the loss mask, null if nothing is; where it is the whole
    text of the turn, ``same`` says so and ``learnt`` is null as well.
    """
    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChatTokenizer.of(tokenizer)
        for batch in batches:
            roles, texts, learnt, same = [], [], [], []
            for ids, mask in zip(batch.column("ids"), batch.column("mask")):
                own, under = ids.values.to_numpy(), np.array(mask.values, bool)
                role, text = coder.read(own)
                spoken = unescape(coder.inner.decode(own[under].tolist())) if under.any() else None
                roles.append(role)
                texts.append(text)
                same.append(spoken is not None and spoken == text)
                learnt.append(None if same[-1] else spoken)
            columns = [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(learnt, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "learnt", "same"])

    rows = turns.select("conv_id", "turn", "ids", "mask")
    return rows.mapInArrow(read, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, text string, learnt string, same boolean")


def read_back(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Digests per conversation, read from ids and masks alone.

    Turns come by ``turn``, ties by the formatted text; null turns come first, and rows
    of a null conversation are one conversation.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    escaped = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("<||"))
    shown = F.concat(F.lit(START), escaped("role"), F.lit(MIDDLE), escaped("text"), F.lit(END), F.lit("\n"))
    # The order looks at the formatted text only where turns are equal.
    dealt = read_turns(turns, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "turn", shown)
    marks = len(START) + len(MIDDLE) + len(END) + 1

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state, any_open = None, None, False

        def closed(conv, s) -> pa.RecordBatch:
            values = [[conv], [s[0]], [s[1].hexdigest()], [s[2]], [s[3].hexdigest()], [s[4]]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, types)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        def merged(done: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(done).combine_chunks().to_batches()[0]

        for batch in batches:
            types = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for conv, role, text, learnt, same in zip(*(batch.column(c) for c in ("conv_id", "role", "text", "learnt", "same"))):
                conv, role, text = conv.as_py(), role.as_py(), text.as_py()
                if not any_open or conv != open_id:
                    if any_open:
                        done.append(closed(open_id, state))
                    open_id, any_open = conv, True
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                spoken = text if same.as_py() else learnt.as_py() or ""
                state[2] += len(spoken)
                state[3].update(spoken.encode())
                state[4] += marks + len(escape(role)) + len(escape(text))
            if done:
                yield merged(done)
        if any_open:
            yield closed(open_id, state)

    return dealt.mapInArrow(digest, schema)
