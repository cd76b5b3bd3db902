"""Small languages that name operators: `op(a=1) | op2` chains, `k=v,flag` arguments, JSON configurations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Op = Callable[..., DataFrame]


_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<text>'[^']*'|"[^"]*")|(?P<mark>[()\[\],=|]))""")
_WORDS = {"True": True, "False": False, "None": None}


class _Chain:
    """chain: op ("|" op)*; op: name ["(" [arg ("," arg)*] ")"]; arg: [name "="] value; value: number, text, True, False, None or a list."""

    def __init__(self, spec: str):
        self.spec, self.tokens, at = spec, [], 0
        while spec[at:].strip():
            m = _TOKEN.match(spec, at)
            if not m:
                raise ValueError(f"cannot read {spec[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def take(self, mark: str) -> bool:
        hit = bool(self.tokens) and self.tokens[0] == ("mark", mark)
        if hit:
            self.tokens.pop(0)
        return hit

    def need(self, kind: str) -> str:
        if not self.tokens or self.tokens[0][0] != kind:
            raise ValueError(f"a {kind} is missing in {self.spec!r}")
        return self.tokens.pop(0)[1]

    def value(self) -> Any:
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.value())
                if not self.take(",") and self.tokens[:1] != [("mark", "]")]:
                    raise ValueError(f"a list is not closed in {self.spec!r}")
            return out
        kind = self.tokens[0][0] if self.tokens else ""
        if kind == "name":
            word = self.need("name")
            if word not in _WORDS:
                raise ValueError(f"{word!r} is no value in {self.spec!r}")
            return _WORDS[word]
        if kind == "text":
            return self.need("text")[1:-1]
        number = self.need("number")
        return int(number) if re.fullmatch(r"[-+]?\d+", number) else float(number)

    def ops(self) -> list[tuple[str, list, dict]]:
        out: list[tuple[str, list, dict]] = []
        while self.tokens:
            name, args, named = self.need("name"), [], {}
            if self.take("("):
                while not self.take(")"):
                    if self.tokens[:1] and self.tokens[0][0] == "name" and self.tokens[1:2] == [("mark", "=")]:
                        key = self.need("name")
                        self.take("=")
                        named[key] = self.value()
                    else:
                        args.append(self.value())
                    if not self.take(",") and self.tokens[:1] != [("mark", ")")]:
                        raise ValueError(f"a bracket is not closed in {self.spec!r}")
            out.append((name, args, named))
            if self.tokens and not self.take("|"):
                raise ValueError(f"a | is missing in {self.spec!r}")
        return out


def parse_chain(spec: str, ops: Mapping[str, Op]) -> list[tuple[Op, list, dict]]:
    """Reads ``name(arg, key=value) | name``; only known names and plain values are accepted."""
    found = _Chain(spec).ops()
    if unknown := [name for name, _, _ in found if name not in ops]:
        raise ValueError(f"unknown operators {unknown}")
    return [(ops[name], args, named) for name, args, named in found]


def operator_names(ops: Mapping[str, Op]) -> list[str]:
    """The names that chains may use, in order."""
    return sorted(ops)


def apply_chain(df: DataFrame, spec: str, ops: Mapping[str, Op]) -> DataFrame:
    """Runs a chain left to right; the plan stays lazy."""
    return reduce(lambda d, op: op[0](d, *op[1], **op[2]), parse_chain(spec, ops), df)


def apply_configs(df: DataFrame, configs: str | list[dict], ops: Mapping[str, Op]) -> DataFrame:
    """A chain as JSON: a list of {"name": ..., "args": {...}}."""
    for c in json.loads(configs) if isinstance(configs, str) else configs:
        if c["name"] not in ops:
            raise ValueError(f"unknown operator {c['name']!r}")
        df = ops[c["name"]](df, **c.get("args", {}))
    return df


#: Marks in overrides: leave a setting out, or take the input's own.
CLEAR, FROM_INPUT = "CLEAR", "CLOBBER_WITH_INPUT_SPEC"


def merged_spec(base: dict[str, Any], overrides: Mapping[str, Any], given: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``overrides`` merged into it, nested objects key by key; CLEAR drops a key, FROM_INPUT takes that of ``given`` if it has one."""
    out = dict(base)
    for key, value in overrides.items():
        if isinstance(value, Mapping):
            inner, other = out.get(key), given.get(key)
            out[key] = merged_spec(inner if isinstance(inner, Mapping) else {}, value, other if isinstance(other, Mapping) else {})
        elif value == CLEAR:
            out.pop(key, None)
        elif value == FROM_INPUT:
            if key in given:
                out[key] = given[key]
        else:
            out[key] = value
    return out


def object_bounds(bounds: list[list[int | str | slice]]) -> list[tuple[slice, ...]]:
    """Objects given by a place, an interval (``"1:3"``) or a slice for each axis, as slices."""

    def one(v: int | str | slice) -> slice:
        if isinstance(v, slice):
            return v
        if isinstance(v, bool) or not isinstance(v, int | str):
            raise ValueError(f"{v!r} is no bound")
        if isinstance(v, int):
            return slice(v, v + 1)
        parts = [int(p) if p.strip() else None for p in v.split(":")]
        return slice(None, parts[0]) if len(parts) == 1 else slice(*parts)

    return [tuple(map(one, o)) for o in bounds]


def _strictly(kind: Any, text: str) -> Any:
    if kind is not bool:
        return kind(text)
    if text.lower() not in ("true", "false", ""):
        raise ValueError(f"{text!r} is neither true nor false")
    return text.lower() == "true"


def _typed(text: str) -> bool | int | float | str:
    """A value written as text: true or false in any case, else the first of int and float that reads it, else the text."""
    if (word := text.strip()).lower() in ("true", "false"):
        return word.lower() == "true"
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return text


def parse_args(text: str | None, lazy: bool = False, **spec: Any) -> dict[str, Any]:
    """``a=1,flag,b=x`` against ``spec``: name=default, or name=(default, type); the default's type holds otherwise.

    A bare name is true; true and false are strict. A single value without a
    name goes to the first of ``spec``, unless it is a name itself or there is
    no spec. Other names are an error or, if ``lazy``, get a guessed type.
    """
    kinds = {k: v if isinstance(v, tuple) else (v, type(v)) for k, v in spec.items()}
    items = [i for i in (text or "").split(",") if i]
    if len(items) == 1 and "=" not in items[0] and kinds and items[0] not in kinds:
        items = [f"{next(iter(kinds))}={items[0]}"]
    given = {key: value if eq else "True" for key, eq, value in (i.partition("=") for i in items)}
    if (unknown := given.keys() - kinds.keys()) and not lazy:
        raise ValueError(f"unknown arguments {sorted(unknown)}")
    out = {k: _strictly(kind, given[k]) if k in given else default for k, (default, kind) in kinds.items()}
    return out | {k: _typed(v) for k, v in given.items() if k not in kinds}


def typed_sequence(text: str, separator: str = ",") -> list[bool | int | float | str]:
    """Splits and reads each item as a boolean, an int or a float if it is one."""
    return [v.strip() if isinstance(v, str) else v for v in map(_typed, text.split(separator))]


def kebab(c: Column) -> Column:
    """PascalCase to kebab-case: a word begins at a capital after a small letter, and at the last of several capitals before one. Letters are a-z and A-Z."""
    small, capital = (lambda x: F.coalesce(x.between("a", "z"), F.lit(False))), (lambda x: F.coalesce(x.between("A", "Z"), F.lit(False)))

    def spelt(chars: Column) -> Column:
        at = lambda i: F.get(chars, i)
        begins = lambda x, i: capital(x) & (small(at(i - 1)) | (capital(at(i - 1)) & small(at(i + 1))))
        return F.array_join(F.transform(chars, lambda x, i: F.when(begins(x, i), F.concat(F.lit("-"), x)).otherwise(x)), "")

    return F.lower(spelt(F.split(c, "")))


def kebab_name(name: str) -> str:
    """:func:`kebab` of a string."""
    small, capital = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = []
    for i, ch in enumerate(name):
        before, after = name[i - 1] if i else " ", name[i + 1] if i + 1 < len(name) else " "
        if ch in capital and (before in small or (before in capital and after in small)):
            out.append("-")
        out.append(ch)
    return "".join(out).lower()


def json_pointer(c: Column, pointer: str) -> Column:
    """Value at a JSON pointer such as ``/a/0/b``."""
    path = "$"
    for part in filter(None, pointer.split("/")):
        part = part.replace("~1", "/").replace("~0", "~")
        path += f"[{part}]" if part.isdigit() else f".{part}"
    return F.get_json_object(c, path)
