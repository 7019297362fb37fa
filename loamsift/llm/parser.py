"""A pushdown parser for answers in Markdown and HTML: what is left open at the end, what is prose, and what is quoted."""

from __future__ import annotations

import re

# Elements whose end tag may not be left out.
ELEMENTS = set("a abbr article aside b blockquote button code details div dl em figure form h1 h2 h3 h4 h5 h6 i main mark ol pre s section select small span strong sub summary sup table tbody thead u ul".split())
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
QUOTES = {'"', "“", "„", "«"}

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,9}[.)])\s+")
#: A list mark without an item.
_BARE_ITEM = re.compile(r"^\s*(?:[-+•]|\*|\d{1,9}[.)])\s*[*_`\"(]*$")
_ROW = re.compile(r"^\s*\|")
_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
_TOKEN = re.compile(r"`+|\*+|_{2,}|[()\[\]{}“”«»„\"]|<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)(>|$)")


def cells(row: str) -> int:
    return len(re.findall(r"(?<!\\)\|", row.strip().strip("|"))) + 1


class Parse:
    """``open``: the stack at the end; ``tail``: what the last block is; ``prose``: the text without fenced code; ``plain``: the prose without inline code, quotations and tags."""

    def __init__(self, text: str) -> None:
        self.open: list[str] = []
        self.tail = "nothing"
        self.tags: list[str] = []
        prose: list[str] = []
        plain: list[str] = []
        fence = None
        block: list[str] = []
        self.stack: list[str] = []
        header = 0

        def close() -> None:
            if block:
                plain.append(self._inline("\n".join(block)))
                block.clear()

        last = ""
        for line in text.split("\n"):
            m = _FENCE.match(line)
            if fence:
                if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                    fence, self.tail = None, "code"
                continue
            if m:
                close()
                self.stack = []
                fence = m[1]
                continue
            prose.append(line)
            if not line.strip():
                close()
                header = 0
                continue
            last = line
            if _ROW.match(line):
                if not header:
                    close()
                    header = cells(line)
                self.tail = "table"
                block.append(line)
                continue
            header = 0
            if ITEM.match(line) or self.tail == "table":
                close()
            self.tail = "item" if ITEM.match(line) else "prose"
            block.append(line)
        # What is open in an earlier paragraph is a slip; what is open in the last one is still open.
        close()
        self.prose, self.plain = "\n".join(prose), "\n\n".join(plain)
        if fence:
            self.open = ["fence"]
        else:
            self.open = self.tags + (self.stack if self.tail != "code" else [])
            if self.tail != "code" and last:
                if _BARE_ITEM.match(last):
                    self.open.append("item")
                if self.tail == "table" and header and (cells(last) < header or not last.rstrip().endswith("|") and first_of_table(prose).rstrip().endswith("|")) and not _RULE.match(last):
                    self.open.append("row")

    def _inline(self, block: str) -> str:
        """Runs over a paragraph, keeps its own stack and the open elements, and gives back what is neither code nor quoted."""
        stack: list[str] = []
        begun: list[int] = []
        out: list[str] = []
        at = 0
        code = None
        for m in _TOKEN.finditer(block):
            t, i = m[0], m.start()
            if code is not None:
                if t == code:
                    at, code = m.end(), None
                continue
            quoted = next((b for s, b in zip(stack, begun) if s in QUOTES), None)
            if t[0] == "`":
                if quoted is None:
                    out.append(block[at:i] + " ")
                code, at = t, m.end()
            elif m[2]:
                if quoted is None:
                    out.append(block[at:i] + " ")
                at = m.end()
                name = m[2].lower()
                if not m[4]:
                    # A tag that the text breaks off in.
                    if name in ELEMENTS or m[1]:
                        stack.append("tag")
                        begun.append(i)
                elif name in ELEMENTS and not m[3].rstrip().endswith("/"):
                    if not m[1]:
                        self.tags.append(name)
                    elif name in self.tags:
                        del self.tags[len(self.tags) - 1 - self.tags[::-1].index(name) :]
            elif t[0] in "*_":
                mark = t[:2] if len(t) > 1 else t
                if mark == "*":
                    continue
                if mark in stack:
                    k = len(stack) - 1 - stack[::-1].index(mark)
                    del stack[k:], begun[k:]
                elif m.end() < len(block) and not block[m.end()].isspace() or m.end() == len(block) and (i == 0 or block[i - 1].isspace()):
                    stack.append(mark)
                    begun.append(i)
            elif stack and t == PAIRS.get(stack[-1]) or t == '"' and '"' in stack:
                k = len(stack) - 1 if t != '"' else len(stack) - 1 - stack[::-1].index('"')
                if stack[k] in QUOTES and quoted == begun[k]:
                    out.append(block[at : begun[k]] + " ")
                    at = m.end()
                del stack[k:], begun[k:]
            elif t in PAIRS or t == '"' and (i == 0 or not block[i - 1].isalnum()):
                stack.append(t)
                begun.append(i)
        if code is not None:
            stack.append("code")
        else:
            out.append(block[at:])
        self.stack = stack
        return "".join(out)


def first_of_table(lines: list[str]) -> str:
    """The first row of the table that the lines end with."""
    first = ""
    for line in reversed(lines):
        if _ROW.match(line):
            first = line
        elif line.strip() or first:
            break
    return first
