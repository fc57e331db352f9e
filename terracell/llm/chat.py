"""Chat formatting by a finite-state machine over roles.

The template is data: how a turn opens and closes, which roles carry loss, and which role may follow
which. Turns come sorted by conversation and number; the machine walks over them, judges each
conversation's order, and emits each turn as segments of text with a loss flag of their own. Control
strings in a text are broken up with the escape character, and escape characters doubled, so that
reading back finds turns' ends only where the template put them and gives every text as it was.

Sorting within hashed partitions and walking over batches holds one turn at a time: a conversation
of any length, or one with a third of all turns, is streamed through, never gathered.

Defined results: null text is empty, null role is an empty role (which no order allows); rows of one
turn number are ordered by role and text, and repeated rows are turns of their own; an invalid order is
formatted all the same and flagged; a null conversation id is a conversation. Texts of any length are
formatted whole, an empty table gives an empty one, and columns other than the four are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows


@dataclass(frozen=True)
class Template:
    open_left: str = "<turn:"
    open_right: str = ">\n"
    close: str = "</turn>\n"
    escape: str = "\\"
    #: What a text may not hold unescaped: the beginnings of the template's own strings.
    control: tuple[str, ...] = ("<turn:", "</turn>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: From each state, the roles that may come and the state that each leads to.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("user", "assistant")

    def escaped(self, text: str) -> str:
        text = text.replace(self.escape, 2 * self.escape)
        for c in self.control:
            text = text.replace(c, c[0] + self.escape + c[1:])
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's texts in order, each with its loss flag."""
        name = self.escaped(role).replace(">", self.escape + ">")
        return [(self.open_left + name + self.open_right, False), (self.escaped(text), role in self.loss_roles), (self.close, False)]

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts, read back from formatted turns."""
        name = f"((?:{re.escape(self.escape)}.|[^>{re.escape(self.escape)}])*)"
        out, at, head = [], 0, re.compile(re.escape(self.open_left) + name + re.escape(self.open_right), re.S)
        while at < len(formatted):
            m = head.match(formatted, at)
            end = formatted.find(self.close.rstrip("\n"), m.end()) if m else -1
            if end < 0:
                raise ValueError(f"no turn at {at}")
            out.append((self.unescaped(m[1]), self.unescaped(formatted[m.end() : end])))
            at = end + len(self.close)
        return out


def format_turns(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn's segments (text, loss), and whether the machine allows it after those before it.

    ``allowed`` is of the move to this turn, ``ends`` whether a conversation may end here; rows of a
    conversation follow each other within a partition, in order, with ``turn_no`` from 0.
    """
    rows = df.select(df[conv].alias("conv"), df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number = object(), "start", 0
        for batch in batches:
            out = {"turn_no": [], "segments": [], "allowed": [], "ends": []}
            for c, r, t in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text"))):
                if c != now:
                    now, state, number = c, "start", 0
                state = template.moves.get(state, {}).get(r)
                out["turn_no"].append(number)
                out["segments"].append([{"text": x, "loss": y} for x, y in template.segments(r, t)])
                out["allowed"].append(state is not None)
                out["ends"].append(state in template.final)
                number += 1
            seg = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(out["turn_no"], pa.int64()), pa.array(out["segments"], seg), pa.array(out["allowed"], pa.bool_()), pa.array(out["ends"], pa.bool_())], ["conv", *out])

    schema = f"conv {kind}, turn_no bigint, segments array<struct<text:string,loss:boolean>>, allowed boolean, ends boolean"
    return map_rows(rows, run, schema).withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """One row a conversation from formatted turns in their order: counts and digests of what they say.

    Digests are fed turn by turn; a conversation's row comes out when the next one begins.
    """
    kind = formatted.schema[conv].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        now, open_ = None, None
        for batch in batches:
            done = []
            for c, seg, allowed, ends in zip(*(batch.column(k).to_pylist() for k in ("conv", "segments", "allowed", "ends"))):
                if open_ is None or c != now:
                    if open_ is not None:
                        done.append(_row(now, open_))
                    now, open_ = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, False]
                whole = "".join(s["text"] for s in seg)
                for role, text in template.turns(whole):
                    open_[0] += 1
                    open_[1].update(f"{role}\n{text}\n".encode())
                loss = template.unescaped("".join(s["text"] for s in seg if s["loss"]))
                open_[2] += len(loss)
                open_[3].update(loss.encode())
                open_[4] += len(whole)
                open_[5:] = [open_[5] and allowed, ends]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_row(now, open_), types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    df = formatted.select(formatted[conv].alias("conv"), "segments", "allowed", "ends")
    schema = f"conv {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    return map_rows(df, run, schema).withColumnRenamed("conv", conv)


def _row(conv, o: list) -> tuple:
    return conv, o[0], o[1].hexdigest(), o[2], o[3].hexdigest(), o[4], bool(o[5] and o[6])
