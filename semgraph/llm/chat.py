"""Chat formatting at the level of token ids.

A turn becomes ``ROLE role SEP text END``: the three control ids lie beyond the tokenizer's vocabulary and
are spliced between separately encoded segments, so no text can produce one and no token spans a border.
Loss masks are places, not strings: running sums of segment lengths give where each learnt text starts.

The rendered form spells the control ids (``### ``, ``: ``, ``</turn>``). Where a text holds such a string, an
escape sign breaks it, and the sign itself is doubled, so that reading back is exact. Texts are escaped
before they are encoded; what a model sees holds no control string but the template's own.

Rows go by turn, then role, then text; a null turn is first, a null role or text is empty, rows with a null
conv_id form one conversation, repeated rows are turns of their own. A conversation without rows does not
exist. Columns other than conv_id, turn, role and text are left out. A conversation is never gathered in
one place: segments are encoded where the rows are, and reading back streams through sorted rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the rendered form.
ROLE_TEXT, SEP_TEXT, END_TEXT = "### ", ": ", "</turn>\n"
ESCAPE = "\\"
#: What must not occur in a text as it stands: the header mark, and the end mark without its line end.
GUARDED = ("### ", "</turn>")

_TO_ESCAPE = re.compile("|".join(re.escape(s) for s in (ESCAPE, *GUARDED)))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)

TURN = "conv_id long, turn long, place string, role string, ids array<int>, text_at int, text_len int, learnt boolean, chars long"


def escape(text: str) -> str:
    """The sign is doubled; a guarded string gets one after its first letter, so that it no longer occurs."""
    return _TO_ESCAPE.sub(lambda m: m[0] + ESCAPE if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """Encoder and decoder of one tokenizer file; the control ids follow its vocabulary."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        first = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.role, self.sep, self.end = first, first + 1, first + 2

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([escape(t) for t in texts], add_special_tokens=False)]

    def decode(self, segments: list[list[int]]) -> list[str]:
        return [unescape(t) for t in self.tokenizer.decode_batch(segments, skip_special_tokens=False)]

    def fields(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Role and text segments of one turn, found by the control ids alone."""
        if ids[0] != self.role or ids[-1] != self.end:
            raise ValueError("not a turn")
        at = ids.index(self.sep)
        return ids[1:at], ids[at + 1 : -1]


def encode_turns(turns: DataFrame, vocabulary: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: its ids with the control ids, and where in them the text lies (``text_at``, ``text_len``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Template(vocabulary)
        for b in batches:
            roles, texts = b["role"].fillna("").tolist(), b["text"].fillna("").tolist()
            heads, bodies = t.encode(roles), t.encode(texts)
            spliced = [[t.role, *h, t.sep, *x, t.end] for h, x in zip(heads, bodies, strict=True)]
            fixed = len(ROLE_TEXT) + len(SEP_TEXT) + len(END_TEXT)
            yield pd.DataFrame({
                "conv_id": b["conv_id"].astype("Int64"), "turn": b["turn"].astype("Int64"), "place": b["place"],
                "role": roles, "ids": spliced, "text_at": [len(h) + 2 for h in heads], "text_len": [len(x) for x in bodies],
                "learnt": [r in learn for r in roles],
                "chars": [fixed + len(escape(r)) + len(escape(x)) for r, x in zip(roles, texts, strict=True)],
            })

    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    order = F.coalesce(F.col("text"), F.lit(""))  # where turn and role tie, the text decides
    return turns.select(*columns).withColumn("place", order).mapInPandas(run, TURN)


def format_chats(turns: DataFrame, vocabulary: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted turns with their place in the conversation's id sequence and the half-open span under the loss mask.

    ``starts`` is the running sum of the lengths before; ``loss_from`` and ``loss_to`` are null where nothing is learnt.
    """
    encoded = encode_turns(turns, vocabulary, learn)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "place")
    before = F.sum(F.size("ids").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = encoded.withColumn("starts", F.coalesce(before, F.lit(0).cast("long")))
    at = F.when(F.col("learnt"), F.col("starts") + F.col("text_at"))
    return out.withColumn("loss_from", at).withColumn("loss_to", at + F.col("text_len"))


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of every conversation, from the ids and loss spans alone.

    Rows of a conversation come sorted, and hashes are fed turn by turn: memory holds one batch of turns.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Template(vocabulary)
        now: object = run  # no conversation yet
        state: list = []

        def closed() -> list:
            n, turns, chars, learnt, rendered, ids = state
            return [None if now is None else now, n, turns.hexdigest(), chars, learnt.hexdigest(), rendered, ids]

        for b in batches:
            done = []
            ids = [list(map(int, x)) for x in b["ids"]]
            split = [t.fields(x) for x in ids]
            roles, texts = t.decode([s[0] for s in split]), t.decode([s[1] for s in split])
            spans = [
                x[int(lo - at) : int(hi - at)] if lo == lo and lo is not None else None
                for x, at, lo, hi in zip(ids, b["starts"], b["loss_from"], b["loss_to"], strict=True)
            ]
            masked = iter(t.decode([s for s in spans if s is not None]))
            for conv, role, text, span, chars, length in zip(
                b["conv_id"], roles, texts, spans, b["chars"], map(len, ids), strict=True
            ):
                conv = None if pd.isna(conv) else int(conv)
                if now is run or conv != now:
                    if now is not run:
                        done.append(closed())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if span is not None:
                    learnt = next(masked)
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += int(chars)
                state[5] += length
            if done:
                yield _frame(done)
        if now is not run:
            yield _frame([closed()])

    def _frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_ids"])
        return out.astype({"conv_id": "Int64"})

    need = formatted.select("conv_id", "starts", "ids", "loss_from", "loss_to", "chars")
    return need.repartition("conv_id").sortWithinPartitions("conv_id", "starts").mapInPandas(run, schema)
