"""Blocks of one text: plain text, Markdown and HTML as a flat list of headings, paragraphs, list items and table rows, and the text for a prompt.

A block is (kind, level, ordered, text, cells, parent): kind is heading, paragraph, quote, code, item, header or row; level is a heading's or an item's depth from 1;
cells are those of a table's row; parent is the place (from 0) of the item that an item lies below. Each parser reads its text once.

Nulls and edge cases: a null or empty text has no blocks; tags that aren't closed end with the text.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

BLOCK_TYPE = "array<struct<kind: string, level: int, ordered: boolean, text: string, cells: array<string>, parent: int>>"
# Tags whose content is left out, tags that end a run of text, the widest cell, what begins an item.
DROPPED = frozenset("script style nav svg form noscript template iframe head button select textarea object embed canvas".split())
BREAKING = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol table blockquote pre figure figcaption section article main header footer aside hr dl dt dd address details summary li body html".split())
WIDEST = 100
BULLET = re.compile(r"^(\s*)([•◦▪–\-*]|[0-9]{1,3}[.)]|[a-z][.)])\s+(\S.*)$")
CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")
FRONT = re.compile(r"^﻿?---\n(.*?)\n(?:---|\.\.\.)\n?", re.S)
RULE, HEADING, FENCE, TABLE_RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$"), re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$"), re.compile(r"^\s{0,3}(```+|~~~+)"), re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
MARKED_ITEM = re.compile(r"^(\s*)([-*+]|[0-9]{1,9}[.)])\s+(\S.*)?$")


def one_line(text: str) -> str:
    """Composed characters, no control characters, white space as one blank."""
    return " ".join(CONTROL.sub("", unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")).split())


def as_is(text: str) -> str:
    """Lines without control characters, blanks at their ends and empty ones around."""
    lines = CONTROL.sub("", unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")).split("\n")
    return "\n".join(x.rstrip() for x in lines).strip("\n")


def _block(kind, text, level=0, ordered=False, cells=None, parent=None):
    return [kind, level, ordered, text, cells, parent]


class _Items:
    """Puts items below the nearest earlier one that is shallower."""

    def __init__(self, out):
        self.out, self.open = out, []

    def add(self, indent, ordered, text):
        while self.open and self.open[-1][0] >= indent:
            self.open.pop()
        parent = self.open[-1][1] if self.open else None
        self.out.append(_block("item", text, len(self.open) + 1, ordered, None, parent))
        self.open.append((indent, len(self.out) - 1))

    def more(self, text):
        last = self.out[self.open[-1][1]]
        last[3] = one_line(f"{last[3]} {text}")


def text_blocks(text):
    """Paragraphs between blank lines, and lists: two blanks of indent are a level, an indented line goes on with the item before."""
    out = []
    for part in re.split(r"\n[^\S\n]*\n", (text or "").replace("\r\n", "\n").replace("\r", "\n")):
        prose, items, ordered = [], None, False

        def end_prose():
            if t := one_line(" ".join(prose)):
                out.append(_block("paragraph", t))
            prose.clear()

        for line in filter(str.strip, part.split("\n")):
            if m := BULLET.match(line):
                end_prose()
                if items is None:
                    items, ordered = _Items(out), m[2][0].isalnum()
                items.add(len(m[1].replace("\t", "    ")) // 2, ordered, one_line(m[3]))
            elif items is not None and re.match(r"\s{2,}\S", line):
                items.more(line)
            else:
                items = None
                prose.append(line)
        end_prose()
    return [tuple(b) for b in out]


def _inline(text):
    return one_line(re.sub(r"!\[([^\]]*)\]\([^)]*\)", lambda m: f"[image: {m[1].strip()}]", text))


def _cells(line):
    return [_inline(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def markdown_blocks(text):
    """Headings, paragraphs, quotes, fenced code, nested lists, tables and HTML (as its text), after the front matter."""
    out, lines, at = [], FRONT.sub("", (text or "").replace("\r\n", "\n").replace("\r", "\n"), count=1).split("\n"), 0
    prose, items, quote = [], None, False

    def end():
        nonlocal items, quote
        joined = "\n".join(prose)
        if t := _inline(re.sub(r"<[^>]*>", " ", joined) if joined.lstrip().startswith("<") else joined):
            out.append(_block("quote" if quote else "paragraph", t))
        prose.clear()
        quote = False

    while at < len(lines):
        line = lines[at]
        at += 1
        quoted = re.match(r"^ {0,3}> ?(.*)$", line)
        if prose and quote != bool(quoted):
            end()
        if quoted:
            items, quote, line = None, True, quoted[1]
        if not line.strip():
            end()
        elif m := FENCE.match(line):
            end()
            code = []
            while at < len(lines) and not lines[at].strip().startswith(m[1]):
                code.append(lines[at])
                at += 1
            at, items = at + 1, None
            if t := as_is("\n".join(code)):
                out.append(_block("code", t))
        elif (m := HEADING.match(line)) or (prose and not quote and re.match(r"^ {0,3}(=+|-+)\s*$", line)):
            title, level = (m[2] or "", len(m[1])) if m else ("\n".join(prose), 1 if "=" in line else 2)
            was = quote
            prose.clear() if not m else end()
            items = None
            if t := _inline(title):
                out.append(_block("quote", t) if was else _block("heading", t, level))
            quote = was
        elif RULE.match(line) and not prose:
            items = None
        elif "|" in line and at < len(lines) and TABLE_RULE.match(lines[at]) and "-" in lines[at] and len(_cells(line)) == len(_cells(lines[at])):
            end()
            items = None
            out.append(_block("header", "", cells=_cells(line)))
            at += 1
            while at < len(lines) and "|" in lines[at]:
                row = _cells(lines[at])[: len(out[-1][4])]
                out.append(_block("row", "", cells=row + [""] * (len(out[-1][4]) - len(row))))
                at += 1
        elif (m := MARKED_ITEM.match(line)) and not quote:
            end()
            indent = len(m[1].replace("\t", "    "))
            if items is None:
                items = _Items(out)
            items.add(indent, m[2][0].isdigit(), re.sub(r"^\[X\]", "[x]", _inline(m[3] or "")))
        elif items is not None and not quote and not prose and (line.startswith(" ") or lines[at - 2].strip()):
            items.more(_inline(line))
        else:
            items = None
            prose.append(line)
    end()
    return [tuple(b) for b in out]


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.dropped, self.lists, self.items, self.tables, self.quotes, self.pre, self.heading = [], [], [], [], [], [], 0, 0, 0

    def end_text(self):
        raw, self.text = "".join(self.text), []
        if self.tables:
            if self.tables[-1]["cell"] is not None:
                self.tables[-1]["cell"].append(raw)
        elif self.items:
            b = self.out[self.items[-1]]
            b[3] = one_line(f"{b[3]} {raw}")
        elif t := (as_is(raw) if self.pre else one_line(raw)):
            if self.heading and not self.quotes:
                self.out.append(_block("heading", t, self.heading))
            else:
                self.out.append(_block("code" if self.pre else "quote" if self.quotes else "paragraph", t))

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in DROPPED:
            self.dropped.append(tag)
        if self.dropped:
            return
        if tag == "img" and (alt := (attrs.get("alt") or "").strip()):
            self.text.append(f" [image: {alt}] ")
        if tag == "br":
            self.text.append("\n" if self.pre else " ")
        if tag not in BREAKING and tag not in ("tr", "td", "th", "thead", "tbody"):
            return
        self.end_text()
        if tag[0] == "h" and tag[1:].isdigit():
            self.heading = int(tag[1])
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.pre += 1
        elif tag in ("ul", "ol") and not self.tables:
            self.lists.append((tag == "ol", len(self.items)))
        elif tag == "li" and self.lists and not self.tables:
            ordered, above = self.lists[-1]
            del self.items[above:]
            self.out.append(_block("item", "", len(self.lists), ordered, None, self.items[-1] if self.items else None))
            self.items.append(len(self.out) - 1)
        elif tag == "table":
            self.tables.append({"rows": [], "cell": None, "head": False})
        elif self.tables and tag in ("thead", "tbody"):
            self.tables[-1]["head"] = tag == "thead"
        elif self.tables and tag == "tr":
            self.end_cell()
            self.tables[-1]["rows"].append([[], self.tables[-1]["head"], True])
        elif self.tables and tag in ("td", "th"):
            self.end_cell()
            t = self.tables[-1]
            t["rows"] = t["rows"] or [[[], t["head"], True]]
            t["rows"][-1][2] &= tag == "th"
            span = attrs.get("colspan") or "1"
            t["cell"], t["span"] = [], min(int(span), WIDEST) if span.isascii() and span.isdigit() else 1

    def end_cell(self):
        t = self.tables[-1]
        if t["cell"] is not None:
            t["rows"][-1][0] += [one_line(" ".join(t["cell"]))] + [""] * (t["span"] - 1)
            t["cell"] = None

    def handle_endtag(self, tag):
        if tag in self.dropped:
            del self.dropped[self.dropped.index(tag):]
            return
        if self.dropped or tag not in BREAKING and tag not in ("tr", "td", "th", "thead", "tbody"):
            return
        self.end_text()
        if tag[0] == "h" and tag[1:].isdigit():
            self.heading = 0
        elif tag == "blockquote":
            self.quotes = max(0, self.quotes - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
        elif tag in ("ul", "ol") and self.lists and not self.tables:
            del self.items[self.lists.pop()[1]:]
        elif tag == "li" and self.lists and not self.tables:
            del self.items[self.lists[-1][1]:]
        elif self.tables and tag in ("td", "th", "tr"):
            self.end_cell()
        elif self.tables and tag == "table":
            self.end_table()

    def end_table(self):
        self.end_cell()
        rows = [r for r in self.tables.pop()["rows"] if r[0]]
        if self.tables or self.items:  # a table in a cell or an item is its text
            self.text.append(" " + "; ".join(c for r in rows for c in r[0] if c) + " ")
            return
        for i, (cells, head, all_th) in enumerate(rows):
            self.out.append(_block("header" if i == 0 and (head or all_th) else "row", "", cells=cells))

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)


def html_blocks(html):
    """Blocks of a page without scripts, navigation and forms; empty items without items below are left out."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.end_text()
    while page.tables:
        page.end_table()
    page.end_text()
    parents = {b[5] for b in page.out}
    kept = [i for i, b in enumerate(page.out) if b[0] != "item" or b[3] or i in parents]
    place = {i: n for n, i in enumerate(kept)}
    return [(*page.out[i][:5], place.get(page.out[i][5])) for i in kept]


def prompt_text(blocks):
    """One text of all blocks: # before headings, - or a number before items, > before quotes, fences around code, | between cells."""
    out, numbers = [], {}
    for kind, level, ordered, text, cells, parent in blocks or []:
        numbers = {k: v for k, v in numbers.items() if k <= level} if kind == "item" else {}
        if kind == "heading":
            out.append("#" * level + " " + text)
        elif kind == "quote":
            out.append("> " + text)
        elif kind == "code":
            out += ["```", text, "```"]
        elif kind == "item":
            numbers[level] = numbers.get(level, 0) + 1 if ordered else 0
            out.append("  " * (level - 1) + (f"{numbers[level]}. " if ordered else "- ") + text)
        elif kind in ("header", "row"):
            out.append("| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |")
            if kind == "header":
                out.append("| " + " | ".join("---" for _ in cells) + " |")
        else:
            out.append(text)
    return "\n".join(out)
