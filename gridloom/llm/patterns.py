"""Reads the regular expressions of rules, as far as their mandatory text needs it."""

from __future__ import annotations

from dataclasses import dataclass, field

_CLASSES = {"d": "0123456789", "s": " \t\n\x0b\x0c\r", "w": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}
_CONTROLS = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\a", "e": "\x1b"}
#: Escapes that match no character.
_ANCHORS = "bBAzZG"


@dataclass
class Node:
    """kind: chars (one of ``chars``; None: nothing is known of it), sequence, any of, or repeat (``low`` to ``high`` times; None: no bound)."""

    kind: str
    parts: list[Node] = field(default_factory=list)
    chars: frozenset[str] | None = None
    low: int = 1
    high: int | None = 1
    possessive: bool = False


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def next(self, n: int = 1) -> str:
        found = self.p[self.at : self.at + n]
        if len(found) < n:
            raise ValueError(f"the pattern ends too early: {self.p}")
        self.at += n
        return found

    def take(self, s: str) -> bool:
        hit = self.p.startswith(s, self.at)
        self.at += len(s) * hit
        return hit

    def branches(self) -> Node:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else Node("any of", parts)

    def sequence(self) -> Node:
        out = Node("sequence")
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            out.parts.append(self.repeated(self.atom()))
        return out

    def atom(self) -> Node:
        c = self.next()
        if c == "(":
            return self.group()
        if c == "[":
            return Node("chars", chars=self.bracket())
        if c == ".":
            return Node("chars")
        if c in "^$":
            return Node("sequence")
        if c == "\\":
            if self.p[self.at : self.at + 1] in tuple(_ANCHORS):
                self.next()
                return Node("sequence")
            return Node("chars", chars=self.escape())
        return Node("chars", chars=frozenset(c))

    def group(self) -> Node:
        nothing = False
        if self.take("?"):
            if any(self.take(x) for x in ("=", "!", "<=", "<!")):
                nothing = True  # looks around; matches no text of its own
            elif self.take("<") or self.take("P<"):
                while self.next() != ">":
                    pass
            elif not self.take(">"):
                while (c := self.next()) not in ":)":
                    if c == "x":
                        raise ValueError(f"patterns with comments are not read: {self.p}")
                if c == ")":  # flags alone
                    return Node("sequence")
        inner = self.branches()
        if self.next() != ")":
            raise ValueError(f"a group is not closed: {self.p}")
        return Node("sequence") if nothing else Node("sequence", [inner])

    def escape(self) -> frozenset[str] | None:
        c = self.next()
        if c == "x":
            return frozenset(chr(int(self.next(2), 16)))
        if c == "u":
            return frozenset(chr(int(self.next(4), 16)))
        if c in _CLASSES:
            return frozenset(_CLASSES[c])
        if c in _CONTROLS:
            return frozenset(_CONTROLS[c])
        if c in "pP" and self.take("{"):
            while self.next() != "}":
                pass
            return None
        return None if c.isalnum() else frozenset(c)

    def bracket(self) -> frozenset[str] | None:
        negated, known, found, first = self.take("^"), True, set(), True
        while first or not self.take("]"):
            first = False
            c = self.next()
            some = self.escape() if c == "\\" else frozenset(c)
            known = known and some is not None and c != "["
            if some and len(some) == 1 and self.p[self.at : self.at + 1] == "-" and self.p[self.at + 1 : self.at + 2] not in ("]", ""):
                self.next()
                d = self.next()
                end = self.escape() if d == "\\" else frozenset(d)
                known = known and end is not None and len(end) == 1
                if known:
                    some = frozenset(map(chr, range(ord(min(some)), ord(min(end)) + 1)))
            found |= some or set()
        return None if negated or not known else frozenset(found)

    def repeated(self, node: Node) -> Node:
        while self.at < len(self.p) and self.p[self.at] in "?*+{":
            c = self.next()
            if c == "{":
                bounds = ""
                while (d := self.next()) != "}":
                    bounds += d
                low, comma, high = bounds.partition(",")
                least, most = int(low or 0), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = Node("repeat", [node], low=least, high=most, possessive=self.take("+"))
            if not node.possessive:
                self.take("?")
        return node


def parse(pattern: str) -> Node:
    """The tree of ``pattern``; ValueError where it is no pattern that is read here. Case and flags do not matter to the tree."""
    reader = _Reader(pattern)
    out = reader.branches()
    if reader.at < len(pattern):
        raise ValueError(f"a bracket too many: {pattern}")
    return out


def loops_over_a_group(node: Node, many: int = 100) -> bool:
    """Whether more than one character's worth is repeated without bound (or over ``many`` times), other than possessively."""
    loose = node.kind == "repeat" and (node.high is None or node.high > many) and not node.possessive and node.parts[0].kind != "chars"
    return loose or any(loops_over_a_group(x, many) for x in node.parts)
