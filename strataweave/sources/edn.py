"""A reader of EDN: vectors, lists, sets, maps, keywords, strings, numbers, #inst and other tags.

Keywords are strings of the class Keyword, without their colon; #inst is a number of
microseconds, and other tags are passed over for their value.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from typing import Any

#: Collections within collections beyond this are an error, not a stack overflow.
MAX_DEPTH = 100
_CLOSING = {"[": "]", "(": ")", "{": "}", "#{": "}"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_NAMED = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}
_TOKEN = re.compile(
    r"""(?P<gap>[\s,]+|;[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<open>\#?\{|[\[(])|(?P<close>[\])}])|(?P<drop>\#_)"""
    r"""|(?P<tag>\#[A-Za-z][^\s,"\[\](){};]*)|\\(?P<char>[A-Za-z0-9]+|\S)|(?P<atom>[^\s,"\[\](){};\\\#][^\s,"\[\](){};]*)""",
    re.S,
)


class EdnError(ValueError):
    pass


class Keyword(str):
    @property
    def local(self) -> str:
        """The name without its namespace."""
        return self.rpartition("/")[2] or str(self)


def micros_of(text: str) -> int:
    """Microseconds since the epoch of an ISO 8601 instant; without a zone it is UTC."""
    try:
        t = dt.datetime.fromisoformat(text)
    except ValueError as e:
        raise EdnError(f"{text!r} is no instant") from e
    t = t if t.tzinfo else t.replace(tzinfo=dt.UTC)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


def unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise EdnError(f"unreadable at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "gap":
            yield m.lastgroup, m[m.lastgroup]


def _atom(text: str) -> Any:
    if text[0] == ":":
        return Keyword(text[1:])
    if text in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[text]
    if re.fullmatch(r"[+-]?\d+N?", text):
        n = int(text.rstrip("N"))
        if text[-1] != "N" and not -(1 << 63) <= n < 1 << 63:
            raise EdnError("a number of more than 64 bits")
        return n
    if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?", text):
        return float(text.rstrip("M"))
    return text


def _value(tokens: Iterator[tuple[str, str]], kind: str, text: str, depth: int) -> Any:
    if depth > MAX_DEPTH:
        raise EdnError(f"more than {MAX_DEPTH} collections within each other")
    if kind == "open":
        items = list(_items(tokens, _CLOSING[text], depth + 1))
        if text != "{":
            return items
        if len(items) % 2:
            raise EdnError("a map with a key but no value")
        return {k if isinstance(k, str) else repr(k): v for k, v in zip(items[::2], items[1::2])}
    if kind == "string":
        return unescape(text[1:-1])
    if kind == "char":
        return _NAMED.get(text) or (chr(int(text[1:], 16)) if len(text) == 5 else text)
    if kind == "tag":
        inner = _value(tokens, *_next(tokens), depth + 1)
        return micros_of(inner) if text == "#inst" else inner
    if kind == "atom":
        return _atom(text)
    raise EdnError(f"unexpected {text!r}")


def _next(tokens: Iterator[tuple[str, str]]) -> tuple[str, str]:
    try:
        return next(tokens)
    except StopIteration:
        raise EdnError("the text ends within a value") from None


def _items(tokens: Iterator[tuple[str, str]], closing: str | None, depth: int) -> Iterator[Any]:
    """Values up to the closing bracket, or to the end of the text where closing is None."""
    for kind, text in tokens:
        if kind == "close" and text == closing:
            return
        if kind == "drop":
            _value(tokens, *_next(tokens), depth + 1)
        else:
            yield _value(tokens, kind, text, depth)
    if closing is not None:
        raise EdnError(f"no closing {closing}")


def parse(text: str) -> list[Any]:
    """All values of a text."""
    return list(_items(_tokens(text), None, 0))


def elements(text: str) -> Iterator[Any]:
    """One by one, the elements of the text's top-level vectors, and its other top-level values."""
    tokens = _tokens(text)
    for kind, token in tokens:
        if kind == "open" and token == "[":
            yield from _items(tokens, "]", 1)
        elif kind == "drop":
            _value(tokens, *_next(tokens), 1)
        else:
            yield _value(tokens, kind, token, 0)


def local_get(m: dict, name: str) -> Any:
    """The value of the first key of this local name, whatever its namespace."""
    return next((v for k, v in m.items() if Keyword(k).local == name), None)
