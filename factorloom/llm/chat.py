r"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn with this grammar, turns one after the other::

    user       [INST] text [/INST]\n
    assistant  [OUT] text </s>\n
    other      [TURN role] text [/TURN]\n        (role percent-encoded)

A deterministic parser reads the rendered text back. Where the recovered turns differ from the
source, the text of the turn conflicts with the grammar; its control strings are escaped by one
more backslash after their first character, which the parser takes away again, and the turn is
rendered anew until the round trip is identical. Only conflicting texts are changed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the grammar: what follows their first character, and that character.
CONTROL = r"(\[|<)(\\*)(INST\]|/INST\]|OUT\]|TURN [^\]\s]*\]|/TURN\]|/s>)"

_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(CONTROL.replace(r"(\\*)", r"(\\+)"))
_OPEN = re.compile(r"\[(INST|OUT|TURN ([^\]\s]*))\] ")
_CLOSE = {"INST": " [/INST]\n", "OUT": " </s>\n", "TURN": " [/TURN]\n"}


def escape(text: str) -> str:
    """Control strings, escaped or not, with one more backslash."""
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    """The inverse of `escape`."""
    return _ESCAPED.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def render(role: str, text: str) -> tuple[str, int]:
    """(the turn in the grammar, length of what stands before the text)."""
    kind = {"user": "INST", "assistant": "OUT"}.get(role, "TURN")
    head = f"[{kind}] " if kind != "TURN" else f"[TURN {quote(role, safe='')}] "
    return head + text + _CLOSE[kind], len(head)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text as (role, text, start, end); the span is that of the escaped text.

    Raises ValueError where the text does not follow the grammar.
    """
    turns, at = [], 0
    while at < len(rendered):
        m = _OPEN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        kind = m[1].split(" ")[0]
        close = _CLOSE[kind]
        start = m.end()
        end = rendered.find(close, start)
        if end < 0 or _CONTROL_BARE.search(rendered, start, end):
            raise ValueError(f"the turn at {at} does not end")
        role = {"INST": "user", "OUT": "assistant"}.get(kind) or unquote(m[2])
        turns.append((role if kind != "TURN" else unquote(m[2]), unescape(rendered[start:end]), start, end))
        at = end + len(close)
    return turns


_CONTROL_BARE = re.compile(CONTROL.replace(r"(\\*)", "()"))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of its text), escaped only if the plain form does not come back."""
    for form in (text, escape(text)):
        rendered, start = render(role, form)
        try:
            found = parse(rendered)
        except ValueError:
            continue
        if len(found) == 1 and found[0][:2] == (role, text):
            return rendered, start, start + len(form)
    raise ValueError("a turn does not survive the round trip")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input row: conv_id, turn, rendered, text_start, text_end, loss.

    The formatted conversation is the `rendered` of its rows in order (conv_id, turn, role, text); nothing
    has to be gathered, and the span, in code points of `rendered`, is under the loss mask where
    `loss` is true (role assistant). A null text or role counts as empty, a null turn comes
    first, repeated rows are turns of their own, and rows with a null conv_id are one
    conversation. Only the four named columns are read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, role, text = (batch.column(i) for i in range(4))
            done = [format_turn(r, t) for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)]
            columns = [
                conv,
                turn,
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
                pa.array([r == "assistant" for r in role.to_pylist()], pa.bool_()),
                role,
                text,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "rendered", "text_start", "text_end", "loss", "role", "text"])

    named = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    return named.mapInArrow(run, "conv_id long, turn long, rendered string, text_start long, text_end long, loss boolean, role string, text string")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Rows are dealt by conversation and sorted; a task then reads them as a stream and keeps two
    running digests, so a conversation of any length needs the memory of one turn. Raises if a
    rendered row is not one turn, or if its span is not that of the parsed turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, state = None, [], None
        for batch in batches:
            for conv, rendered, start, end, loss in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(state.row(now))
                    now, state = conv, _Digest()
                ((role, text, a, b),) = parse(rendered)
                if (a, b) != (start, end):
                    raise ValueError("a span does not fit its turn")
                state.add(role, text, unescape(rendered[start:end]) if loss else "", len(rendered))
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        if state is not None:
            out.append(state.row(now))
        yield _rows(out)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    plain = dealt.select("conv_id", "rendered", "text_start", "text_end", "loss")
    return plain.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class _Digest:
    def __init__(self):
        self.turns, self.chars, self.loss = 0, 0, 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, masked: str, chars: int) -> None:
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode())
        self.under.update(masked.encode())
        self.loss += len(masked)
        self.chars += chars

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss, self.under.hexdigest(), self.chars


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
