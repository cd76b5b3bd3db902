"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How one role's turn is written. ``before`` and ``after`` carry no loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Declarative template. ``other`` serves roles that it does not name; their
    name goes between the two halves of ``other.before``."""

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<s>", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
    #: state -> role -> next state. A conversation is valid if every turn has
    #: a transition and it ends in one of ``final``.
    states: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        """Every string that must not occur inside a text."""
        return [s for t in self.turns.values() for s in (t.before, t.after)] + list(self.other)


DEFAULT = ChatTemplate()
SEGMENTS = "array<struct<text:string,loss:boolean>>"


class Formatter:
    """Writes conversations by a template and reads them back.

    Templates that cannot be read back are refused: control strings need two
    characters and no backslash, no opening may begin another, and no closing
    may overlap itself.
    """

    def __init__(self, template: ChatTemplate = DEFAULT):
        self.template = template
        rest: dict[str, list[str]] = {}
        for c in template.controls():
            if len(c) < 2 or "\\" in c:
                raise ValueError("control strings need two characters and no backslash")
            rest.setdefault(c[0], []).append(re.escape(c[1:]))
        self._control = re.compile("|".join(f"{re.escape(a)}(?={'|'.join(b)})" for a, b in rest.items()))
        closers = [(r, t.before, t.after) for r, t in template.turns.items()] + [(None, template.other[0], template.other[2])]
        self._openers = closers
        openers = [x[1] for x in closers]
        for k, a in enumerate(openers):
            if any(b.startswith(a) for b in openers[:k] + openers[k + 1 :]):
                raise ValueError(f"{a!r} begins another role's opening, so it cannot be read back")
        for c in [x[2] for x in closers] + [template.other[1]]:
            # a text that ends in the closing's beginning would close early
            if any(c.endswith(c[:k]) for k in range(1, len(c))):
                raise ValueError(f"{c!r} overlaps itself, so it cannot be read back")

    def escape(self, text: str) -> str:
        """Doubles backslashes and puts one after a control string's first character."""
        return self._control.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, turns: Iterable[tuple[str, str]]) -> tuple[list[tuple[str, bool]], str | None]:
        """Text segments with loss flags, and what the state machine objects to."""
        state, error, out = "start", None, []
        for k, (role, text) in enumerate(turns):
            after = self.template.states.get(state, {}).get(role)
            if after is None:
                error = error or f"turn {k}: {role} after {state}"
            state = after or state
            if (t := self.template.turns.get(role)) is not None:
                before, close, loss = t.before, t.after, t.loss
            else:
                a, b, close = self.template.other
                before, loss = a + self.escape(role) + b, False
            out += [(before, False), (self.escape(text), loss), (close, False)]
        if error is None and state not in self.template.final:
            error = f"ends in {state}"
        return out, error

    def read_back(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns that a formatted conversation was made of."""
        at, turns = 0, []
        while at < len(formatted):
            role, before, close = next(x for x in self._openers if formatted.startswith(x[1], at))
            at += len(before)
            if role is None:
                end = formatted.index(self.template.other[1], at)
                role, at = self.unescape(formatted[at:end]), end + len(self.template.other[1])
            end = formatted.index(close, at)
            turns.append((role, self.unescape(formatted[at:end])))
            at = end + len(close)
        return turns


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: ChatTemplate = DEFAULT
) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, segments, valid, error.

    ``segments`` joined give ``formatted``; those with ``loss`` are the escaped
    texts to learn from. Rows are ordered by turn, then role and text, so ties
    and repeated rows have one result; nulls come first. A null role or text is
    empty, a null conversation id is an id of its own, an empty table gives no
    rows, and other columns are ignored. Turns out of order are formatted all
    the same; ``valid`` is false and ``error`` names the first.

    A conversation is one output value, so its rows meet in one task; the
    shuffle is on conversations and carries each text once.
    """
    rows = df.select(
        df[conv].alias("conv_id"),
        F.struct(df[turn].alias("turn"), F.coalesce(df[role].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("text")).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = Formatter(template)
        for b in batches:
            done = [write.segments((r["role"], r["text"]) for r in rows) for rows in b["rows"]]
            yield pd.DataFrame(
                {
                    "conv_id": b["conv_id"],
                    "n_turns": [len(s) // 3 for s, _ in done],
                    "formatted": ["".join(t for t, _ in s) for s, _ in done],
                    "segments": [[{"text": t, "loss": m} for t, m in s] for s, _ in done],
                    "valid": [e is None for _, e in done],
                    "error": pd.Series([e for _, e in done], dtype=object),
                }
            )

    kind = grouped.schema["conv_id"].dataType.simpleString()
    return grouped.mapInPandas(run, f"conv_id {kind}, n_turns bigint, formatted string, segments {SEGMENTS}, valid boolean, error string")


def chat_digests(formatted: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Digests of what :func:`format_chats` wrote, read back from its output."""

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Formatter(template)
        for b in batches:
            turns = [read.read_back(x) for x in b["formatted"]]
            learnt = ["".join(read.unescape(s["text"]) for s in x if s["loss"]) for x in b["segments"]]
            yield pd.DataFrame(
                {
                    "conv_id": b["conv_id"],
                    "n_turns": [len(t) for t in turns],
                    "turns_sha256": [digest("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns],
                    "loss_chars": [len(x) for x in learnt],
                    "loss_sha256": [digest(x) for x in learnt],
                    "formatted_chars": [len(x) for x in b["formatted"]],
                    "valid": b["valid"],
                }
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "segments", "valid").mapInPandas(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    )
