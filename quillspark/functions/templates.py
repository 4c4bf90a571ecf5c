"""Prompt templates: ``{{ path }}``, ``{% for x in path %}``, ``{% if path %} ... {% else %}``; anything undefined raises.

A template without loops or conditions compiles to a ``concat`` of columns and never leaves the JVM; others render in
Python. ``reads`` is what a template reads of ``root``: a set of fields, or None for the whole row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_PATH = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[(?:\d+|'[^']*'|\"[^\"]*\")\])*")
_STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(\d+)\]|\[(?:'([^']*)'|\"([^\"]*)\")\]")


class TemplateError(ValueError):
    """A template that can't be parsed, or a path that isn't there."""


def path_steps(path: str) -> list[str | int]:
    if not _PATH.fullmatch(path):
        raise TemplateError(f"not a path: {path!r}")
    name = re.match(r"\w+", path)[0]
    steps: list[str | int] = [name]
    for m in _STEP.finditer(path, len(name)):
        steps.append(int(m[2]) if m[2] is not None else m[1] or m[3] or m[4])
    return steps


def look_up(path: str, scope: dict):
    value = scope
    for step in path_steps(path):
        try:
            value = value[step]
        except (KeyError, IndexError, TypeError) as e:
            raise TemplateError(f"{path!r} is undefined") from e
    return value


def path_column(path: str, root: str | None = None) -> Column:
    """The column of a field path, ``root.`` left out."""
    steps = path_steps(path)
    if root is not None and steps[0] == root:
        steps = steps[1:]
    out = F.col(f"`{steps[0]}`")
    for s in steps[1:]:
        out = out[s]
    return out


@dataclass
class _Node:
    kind: str
    text: str = ""
    var: str = ""
    body: list | None = None
    other: list | None = None


class Template:
    def __init__(self, text: str, root: str = "input"):
        self.text, self.root = text, root
        self.tokens = [t for t in _TOKEN.split(text) if t]
        self.at = 0
        self.nodes = self._block(())
        self.plain = all(n.kind in ("text", "value") for n in self.nodes)

    def _block(self, ends: tuple[str, ...]) -> list[_Node]:
        out: list[_Node] = []
        while self.at < len(self.tokens):
            token = self.tokens[self.at]
            self.at += 1
            if token.startswith("{{"):
                path = token[2:-2].strip()
                path_steps(path)
                out.append(_Node("value", path))
            elif token.startswith("{%"):
                words = token[2:-2].strip("- \n\t").split()
                if words and words[0] in ends:
                    self.at -= 1
                    return out
                if len(words) == 4 and words[0] == "for" and words[2] == "in":
                    body = self._block(("endfor",))
                    self._close("endfor")
                    out.append(_Node("for", words[3], words[1], body))
                elif len(words) in (2, 3) and words[0] == "if" and (len(words) == 2 or words[1] == "not"):
                    body, other = self._block(("else", "endif")), []
                    if self.tokens[self.at : self.at + 1] and "else" in self.tokens[self.at]:
                        self.at += 1
                        other = self._block(("endif",))
                    self._close("endif")
                    if len(words) == 3:
                        body, other = other, body
                    out.append(_Node("if", words[-1], body=body, other=other))
                else:
                    raise TemplateError(f"unsupported: {token}")
            else:
                out.append(_Node("text", token))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return out

    def _close(self, end: str) -> None:
        if self.at >= len(self.tokens) or end not in self.tokens[self.at]:
            raise TemplateError(f"missing {end}")
        self.at += 1

    def render(self, **scope) -> str:
        return "".join(self._render(self.nodes, scope))

    def _render(self, nodes: list[_Node], scope: dict):
        for n in nodes:
            if n.kind == "text":
                yield n.text
            elif n.kind == "value":
                yield str(look_up(n.text, scope))
            elif n.kind == "for":
                for item in look_up(n.text, scope):
                    yield from self._render(n.body, scope | {n.var: item})
            else:
                yield from self._render(n.body if look_up(n.text, scope) else n.other, scope)

    @property
    def reads(self) -> frozenset[str] | None:
        """The fields of ``root`` that are read, or None if the whole row is."""
        found: set[str] = set()

        def walk(nodes, bound) -> bool:
            for n in nodes:
                if n.kind == "text":
                    continue
                steps = path_steps(n.text)
                if steps[0] == self.root and steps[0] not in bound:
                    if len(steps) == 1:
                        return False
                    found.add(str(steps[1]))
                for body in (n.body, n.other):
                    if body and not walk(body, bound | {n.var}):
                        return False
            return True

        return frozenset(found) if walk(self.nodes, frozenset()) else None

    def column(self) -> Column:
        """The rendered template as a column; only for templates of text and values."""
        if not self.plain:
            raise TemplateError("loops and conditions don't compile to a column")
        parts = [F.lit(n.text) if n.kind == "text" else F.coalesce(path_column(n.text, self.root).cast("string"), F.lit("None")) for n in self.nodes]
        return F.concat(*parts) if parts else F.lit("")
