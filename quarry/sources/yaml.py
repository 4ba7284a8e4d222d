"""YAML of configuration files and front matter: block and flow maps and lists, quoted and block
scalars, comments, anchors, aliases and merge keys. What it doesn't read (tags, complex keys, directives, several
documents) raises ValueError, as does broken indentation; a key that comes twice has its last value.

A recursive descent: ``_Blocks`` reads by lines and indentation, ``_Flow`` by characters within brackets.
"""

from __future__ import annotations

import json
import re

ESCAPED = re.compile(r'"(?:[^"\\]|\\.)*"')
NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
HEADER = re.compile(r"([|>])([-+]?)([1-9]?)([-+]?)\s*(?:#.*)?")
NAMED = re.compile(r"([&*])([^\s,\[\]{}]+)\s*")


def scalar(s: str):
    """The value of a plain scalar."""
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    if NUMBER.fullmatch(s):
        return int(s) if re.fullmatch(r"[-+]?\d+", s) else float(s)
    if s[0] in "!%@`":
        raise ValueError(f"not read: {s!r}")
    return s


def quoted(s: str, at: int) -> tuple[str, int]:
    """The quoted string that begins at ``at``, and the place behind it."""
    if s[at] == "'":
        end = at + 1
        while (end := s.find("'", end)) >= 0 and s[end + 1 : end + 2] == "'":
            end += 2
        if end < 0:
            raise ValueError("a quote that isn't closed")
        return s[at + 1 : end].replace("''", "'"), end + 1
    found = ESCAPED.match(s, at)
    if found is None:
        raise ValueError("a quote that isn't closed")
    try:
        return json.loads(found[0], strict=False), found.end()
    except ValueError:
        return re.sub(r"\\(.)", r"\1", found[0][1:-1]), found.end()


class _Flow:
    """One flow collection."""

    def __init__(self, text: str, at: int, names: dict) -> None:
        self.text, self.at, self.names = text, at, names

    def _skip(self) -> str:
        while self.at < len(self.text) and (self.text[self.at].isspace() or (self.text[self.at] == "#" and self.text[self.at - 1 : self.at].isspace())):
            self.at = self.at + 1 if self.text[self.at] != "#" else (self.text.find("\n", self.at) + 1 or len(self.text))
        if self.at >= len(self.text):
            raise EOFError
        return self.text[self.at]

    def value(self):
        first = self._skip()
        if (found := NAMED.match(self.text, self.at)) is not None:
            self.at = found.end()
            if found[1] == "*":
                return known(self.names, found[2])
            self.names[found[2]] = out = self.value()
            return out
        if first == "[":
            return self._list()
        if first == "{":
            return self._map()
        if first in "\"'":
            out, self.at = quoted(self.text, self.at)
            return out
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in ",[]{}\n" and not (self.text[self.at] == ":" and self.text[self.at + 1 : self.at + 2] in (" ", ",", "]", "}", "\n", "")):
            self.at += 1
        return scalar(self.text[begin : self.at].split(" #")[0].strip())

    def _list(self) -> list:
        out = []
        self.at += 1
        while self._skip() != "]":
            item = self.value()
            if self._skip() == ":":  # a pair alone in a list
                self.at += 1
                item = {item: self.value()}
            out.append(item)
            self._next("]")
        self.at += 1
        return out

    def _map(self) -> dict:
        out = {}
        self.at += 1
        while self._skip() != "}":
            key, value = self.value(), None
            if self._skip() == ":":
                self.at += 1
                value = None if self._skip() in ",}" else self.value()
            put(out, key, value)
            self._next("}")
        self.at += 1
        return out

    def _next(self, end: str) -> None:
        mark = self._skip()
        if mark == ",":
            self.at += 1
        elif mark != end:
            raise ValueError(f"{mark!r} where , or {end} should be")


def known(names: dict, name: str):
    if name not in names:
        raise ValueError(f"no anchor {name}")
    return names[name]


def put(out: dict, key, value) -> None:
    """Set a key; a merge key gives what the map hasn't."""
    if isinstance(key, (dict, list)):
        raise ValueError("a key that is no scalar")
    if key == "<<":
        for part in value if isinstance(value, list) else [value]:
            if not isinstance(part, dict):
                raise ValueError("a merge of what is no map")
            for k, v in part.items():
                out.setdefault(k, v)
    else:
        out[key] = value


class _Blocks:
    """A document by its lines."""

    def __init__(self, content: str) -> None:
        self.lines, self.at, self.names = content.expandtabs(8).splitlines(), 0, {}

    def _peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that says something."""
        while self.at < len(self.lines):
            text = self.lines[self.at].strip()
            if text and not text.startswith("#"):
                return len(self.lines[self.at]) - len(self.lines[self.at].lstrip()), text
            self.at += 1
        return None

    def node(self, least: int):
        """What stands in lines indented by at least ``least``; None if nothing does."""
        here = self._peek()
        if here is None or here[0] < least:
            return None
        depth, text = here
        if text == "-" or text.startswith("- "):
            return self._list(depth)
        if self._key(text) is not None:
            return self._map(depth)
        self.at += 1
        return self._rest(text, depth - 1)

    def _key(self, text: str):
        """(key, what follows its colon) of a map's line; None if it is none."""
        if text[0] in "\"'":
            key, end = quoted(text, 0)
            after = text[end:].lstrip()
            return (key, after[1:].strip()) if after.startswith(":") and after[1:2] in ("", " ") else None
        if text[0] in "[{":
            return None
        found = re.match(r"(.*?):(?:\s+(.*)|$)", text)
        if found is None or " #" in found[1]:
            return None
        key = found[1].strip()
        return (key if key == "<<" else scalar(key), (found[2] or "").strip())

    def _map(self, depth: int) -> dict:
        out: dict = {}
        while (here := self._peek()) is not None and here[0] == depth:
            said = self._key(here[1])
            if said is None or here[1].startswith("- "):
                raise ValueError(f"no key in {here[1]!r}")
            self.at += 1
            put(out, said[0], self._rest(said[1], depth, in_map=True))
        self._ended(depth)
        return out

    def _list(self, depth: int) -> list:
        out = []
        while (here := self._peek()) is not None and here[0] == depth and (here[1] == "-" or here[1].startswith("- ")):
            rest = here[1][1:].strip()
            inner = depth + len(here[1]) - len(here[1][1:].lstrip()) if rest else depth + 1
            if rest and rest[0] not in "&*[{|>" and (rest.startswith("- ") or self._key(rest) is not None):
                self.lines[self.at] = " " * inner + rest  # a collection that begins behind the dash
                out.append(self.node(inner))
            else:
                self.at += 1
                out.append(self._rest(rest, depth))
        self._ended(depth)
        return out

    def _ended(self, depth: int) -> None:
        here = self._peek()
        if here is not None and here[0] > depth:
            raise ValueError(f"indentation of {here[1]!r}")

    def _rest(self, text: str, depth: int, in_map: bool = False):
        """The value whose first line goes on with ``text``, of an entry at ``depth``."""
        if (found := NAMED.match(text)) is not None:
            if found[1] == "*":
                return known(self.names, found[2])
            self.names[found[2]] = out = self._rest(text[found.end() :], depth, in_map)
            return out
        if text.startswith("#"):
            text = ""
        if not text:
            here = self._peek()
            same = in_map and here is not None and here[0] == depth and (here[1] == "-" or here[1].startswith("- "))
            return self._list(depth) if same else self.node(depth + 1)
        if (header := HEADER.fullmatch(text)) is not None:
            return self._scalar_block(header, depth)
        if text[0] in "[{":
            return self._flow(text)
        if text[0] in "\"'":
            out, end = quoted(text, 0)
            if text[end:].strip() and not text[end:].lstrip().startswith("#"):
                raise ValueError(f"more behind a quote: {text!r}")
            return out
        words = [text.split(" #")[0].strip()]
        while " #" not in text and (here := self._peek()) is not None and here[0] > depth and not in_map and self._key(here[1]) is None:
            words.append(here[1])  # a plain scalar over several lines
            self.at += 1
        return scalar(words[0]) if len(words) == 1 else " ".join(words)

    def _flow(self, text: str):
        while True:
            flow = _Flow(text, 0, dict(self.names))
            try:
                out = flow.value()
                rest = text[flow.at :].strip()
                if rest and not rest.startswith("#"):
                    raise ValueError(f"more behind a bracket: {rest!r}")
                self.names = flow.names
                return out
            except EOFError:
                if self.at >= len(self.lines):
                    raise ValueError("a bracket that isn't closed") from None
                text += "\n" + self.lines[self.at]
                self.at += 1

    def _scalar_block(self, header: re.Match, depth: int) -> str:
        keep, given = header[2] or header[4], header[3]
        rows = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip()) > depth):
            rows.append(self.lines[self.at])
            self.at += 1
        filled = [r for r in rows if r.strip()]
        indent = depth + int(given) if given else min((len(r) - len(r.lstrip()) for r in filled[:1]), default=0)
        rows = [r[indent:] if r.strip() else "" for r in rows]
        tail = len(rows) - len("\n".join(rows).rstrip("\n").split("\n")) if filled else len(rows)
        body, blank = rows[: len(rows) - tail], rows[len(rows) - tail :]
        if header[1] == "|":
            text = "\n".join(body)
        else:
            text, fresh = "", True
            for row in body:  # lines are folded to one, but for blank and indented ones
                if not row:
                    text, fresh = text + "\n", True
                elif row.startswith(" "):
                    text, fresh = text + ("" if fresh or text.endswith("\n") else "\n") + row + "\n", True
                else:
                    text, fresh = text + ("" if fresh else " ") + row, False
        if keep == "-" or not filled:
            return text
        return text + "\n" * (1 + len(blank) if keep == "+" else 1)


def parse(content: str):
    """The value of a document; an empty map for an empty one."""
    content = re.sub(r"\A﻿?---[ \t]*(?:\n|\Z)", "", content)
    blocks = _Blocks(re.sub(r"(?m)^\.\.\.\s*\Z", "", content))
    if blocks._peek() is None:
        return {}
    out = blocks.node(0)
    if (left := blocks._peek()) is not None:
        raise ValueError(f"indentation of {left[1]!r}")
    return out
