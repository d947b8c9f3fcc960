"""Strict JSON parsing for the operators that walk documents in Arrow batches."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any


class Number(str):
    """A JSON number as written, with all its digits."""

    __slots__ = ()


def _refuse(token: str) -> None:
    raise ValueError(token)


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)


def parse(text: str | None) -> tuple[bool, Any]:
    """(True, value) of valid JSON, numbers as `Number`, of repeated keys the last; else (False, None).

    NaN and Infinity aren't JSON. Null is not JSON text. Nesting may be of any depth: what is deeper than the
    interpreter's limit is read by a loop.
    """
    if text is None:
        return False, None
    try:
        return True, _DECODER.decode(text)
    except RecursionError:
        pass
    except ValueError:
        return False, None
    try:
        return True, _loop(text)
    except (ValueError, IndexError):
        return False, None


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true)|(false)|(null)")


def _loop(text: str) -> Any:
    """The value of JSON text, with a stack of the open containers in place of recursion; ValueError or IndexError if it is none."""
    skip = lambda i: _SPACE.match(text, i).end()
    open_: list[Any] = []
    keys: list[str | None] = []  # the key that waits for a value in each open object

    def key(i: int) -> int:
        if text[i] != '"':
            raise ValueError(i)
        name, i = scanstring(text, i + 1)
        keys[-1] = name
        i = skip(i)
        if text[i] != ":":
            raise ValueError(i)
        return skip(i + 1)

    i = skip(0)
    while True:
        c = text[i]
        if c in "{[":
            value: Any = {} if c == "{" else []
            i = skip(i + 1)
            if text[i] != ("}" if c == "{" else "]"):
                open_.append(value)
                keys.append(None)
                if c == "{":
                    i = key(i)
                continue
            i += 1
        elif c == '"':
            value, i = scanstring(text, i + 1)
        else:
            if (m := _SCALAR.match(text, i)) is None:
                raise ValueError(i)
            value, i = Number(m[1]) if m[1] else True if m[2] else False if m[3] else None, m.end()
        while True:  # the value is whole: it goes into what is open, which may end behind it
            i = skip(i)
            if not open_:
                if i < len(text):
                    raise ValueError(i)
                return value
            owner = open_[-1]
            if isinstance(owner, list):
                owner.append(value)
            else:
                owner[keys[-1]] = value
            if text[i] == ",":
                i = skip(i + 1)
                if isinstance(owner, dict):
                    i = key(i)
                break
            if text[i] != ("]" if isinstance(owner, list) else "}"):
                raise ValueError(i)
            value, i = open_.pop(), i + 1
            keys.pop()


def unwrap(value: Any) -> Any:
    """What a string holds if it holds a JSON object, array or string, however often wrapped; else the value itself."""
    while type(value) is str and value.lstrip()[:1] in ("{", "[", '"'):
        ok, inner = parse(value)
        if not ok:
            break
        value = inner
    return value


def utf8(text: str | None) -> str | None:
    """`text` without lone surrogates, which escapes like \\ud800 can bring in and UTF-8 can't hold."""
    if text is None:
        return None
    try:
        text.encode()
        return str(text)
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
