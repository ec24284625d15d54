"""Markdown as a flat list of blocks, each with the lines it stands on.

A block keeps only what the object parser asks for: headings of any depth,
lists with their items' first texts, tables by cells, fences, paragraphs and
the rest.  Text is cut out of the source by line numbers, never put together
again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

HEADING = re.compile(r"^ {0,3}(#+)(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`]*?)[ \t]*$")
RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
MARKER = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|)$")
QUOTE = re.compile(r"^ {0,3}>")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
HTML = re.compile(r"^ {0,3}<(?:!--|[?!/]?[A-Za-z])")
DELIMITERS = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class Item:
    start: int
    end: int
    text: str = ""
    nested: bool = False
    blocks: list[Block] = field(default_factory=list)


@dataclass
class Block:
    kind: str
    start: int
    end: int
    level: int = 0
    text: str = ""
    info: str = ""
    items: list[Item] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    inner: list[Block] = field(default_factory=list)


def cells(line: str) -> list[str]:
    """The cells of a table row; a bar in a backslash is one of the text."""
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", s)]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _interrupts(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    if HEADING.match(line) or FENCE.match(line) or RULE.match(line) or QUOTE.match(line):
        return True
    m = MARKER.match(line)
    return bool(m and (m[4] or "").strip() and (m[2] in "-*+" or m[2][:-1] == "1"))


def _item_lines(lines: list[str], at: int, width: int) -> int:
    """The line after the last one of the list item that starts at ``at``."""
    i, blank, lazy = at + 1, False, True
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            blank = True
        elif _indent(line) >= width:
            lazy, blank = not line[width:].startswith("    ") or lazy, False
        elif blank or not lazy or _interrupts(line) or MARKER.match(line):
            break
        i += 1
    while i > at + 1 and not lines[i - 1].strip():
        i -= 1
    return i


def scan(lines: list[str], offset: int = 0) -> list[Block]:
    """Blocks of the lines; ``offset`` is the number of the first one."""
    out: list[Block] = []
    i, n = 0, len(lines)
    add = lambda kind, a, b, **more: out.append(Block(kind, a + offset, b + offset, **more))
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if _indent(line) >= 4:
            j = i + 1
            while j < n and (not lines[j].strip() or _indent(lines[j]) >= 4):
                j += 1
            add("code", i, j)
            i = j
            continue
        if m := FENCE.match(line):
            close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            j = next((k for k in range(i + 1, n) if close.match(lines[k])), n)
            add("fence", i, min(j + 1, n), info=m[3], text="".join(x + "\n" for x in lines[i + 1:j]))
            i = min(j + 1, n)
            continue
        if m := HEADING.match(line):
            add("heading", i, i + 1, level=len(m[1]), text=(m[2] or "").strip())
            i += 1
            continue
        if RULE.match(line):
            add("rule", i, i + 1)
            i += 1
            continue
        if QUOTE.match(line):
            j = i + 1
            while j < n and lines[j].strip() and (QUOTE.match(lines[j]) or not _interrupts(lines[j])):
                j += 1
            add("quote", i, j, inner=scan([re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]], i + offset))
            i = j
            continue
        if HTML.match(line):
            comment = line.lstrip().startswith("<!--")
            j = next((k + 1 for k in range(i, n) if "-->" in lines[k]), n) if comment else next((k for k in range(i, n) if not lines[k].strip()), n)
            add("html", i, j)
            i = j
            continue
        if m := MARKER.match(line):
            i = _list(lines, i, m, out, offset)
            continue
        if "|" in line and i + 1 < n and DELIMITERS.match(lines[i + 1]) and "-" in lines[i + 1] and len(cells(line)) == len(cells(lines[i + 1])):
            j = i + 2
            while j < n and lines[j].strip() and not _interrupts(lines[j]):
                j += 1
            add("table", i, j, rows=[cells(x) for x in [line, *lines[i + 2:j]]])
            i = j
            continue
        j = i + 1
        while j < n and lines[j].strip() and not UNDERLINE.match(lines[j]) and not _interrupts(lines[j]):
            j += 1
        text = "\n".join(lines[i:j]).strip()
        if j < n and UNDERLINE.match(lines[j]):
            add("heading", i, j + 1, level=1 if "=" in lines[j] else 2, text=text)
            j += 1
        else:
            add("para", i, j, text=text)
        i = j
    return out


def _list(lines: list[str], i: int, m: re.Match, out: list[Block], offset: int) -> int:
    sign = m[2][-1]
    block = Block("ordered" if m[2][0].isdigit() else "bullets", i + offset, i + offset)
    while i < len(lines) and (m := MARKER.match(lines[i])) and m[2][-1] == sign and not RULE.match(lines[i]):
        space = len(m[3] or " ")
        width = len(m[1]) + len(m[2]) + (space if space <= 4 and (m[4] or "").strip() else 1)
        end = _item_lines(lines, i, width)
        own = [" " * width + lines[i][width:], *lines[i + 1:end]]
        inner = scan([x[width:] if _indent(x) >= width else x.lstrip(" ") for x in own], i + offset)
        item = Item(i + offset, end + offset, blocks=inner)
        if inner and inner[0].kind == "para":
            item.text = inner[0].text
            item.nested = len(inner) > 1 and inner[1].kind in ("bullets", "ordered")
        block.items.append(item)
        block.end = end + offset
        i = end
        while i < len(lines) and not lines[i].strip():
            i += 1
    out.append(block)
    return i if i < len(lines) or not block.items else block.end - offset
