"""Block structure of a document in the profile: CommonMark blocks and pipe tables, opaque inlines.

``read(text)`` returns the tree or raises ``Refused`` with the first code in line order. A document is read in one
pass over its lines; the state is the stack of open containers, so the cost is linear in the text times its depth.

Where several structural refusals apply, the one whose line comes first is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

CONFLICT = re.compile(r"(?:<{7,}|>{7,}|\|{7,})(?: |\Z)|={7,}\Z")
MARKER = re.compile(r"[ \t]*<!--[ \t]*#([a-z0-9][a-z0-9-]*)(?::(begin|end))?[ \t]*-->[ \t]*\Z")
HEADING = re.compile(r"(#{1,6})(?=[ \t]|\Z)")
FENCE = re.compile(r"(`{3,})(?=[^`]*\Z)|(~{3,})")
BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*\Z")
ITEM = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|\Z)", re.ASCII)
DELIMITER_CELL = re.compile(r":?-+:?\Z")
DELIMITER_SHAPE = re.compile(r"[|:\- \t\f\v]*-[|:\- \t\f\v]*\Z")
PIPE = re.compile(r"(?<!\\)\|")

# The element names that open an HTML block of the sixth kind.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
)
ATTRIBUTE = r"""(?:[ \t\n]+[A-Za-z_:][A-Za-z0-9_.:-]*(?:[ \t\n]*=[ \t\n]*(?:[^ \t\n"'=<>`]+|'[^']*'|"[^"]*"))?)"""
OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{ATTRIBUTE}*[ \t\n]*/?>"
CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*[ \t\n]*>"
HTML = re.compile(rf"<(?:(?:script|pre|style|textarea)(?:[ \t>]|\Z)|!--|\?|![A-Za-z]|!\[CDATA\[|/?(?:{BLOCK_TAGS.replace(' ', '|')})(?:[ \t]|/?>|\Z))", re.I)
HTML_TAG_LINE = re.compile(rf"(?:{OPEN_TAG}|{CLOSE_TAG})[ \t]*\Z")

_BLANKS = r"[ \t]*(?:\n[ \t]*)?"
_TITLE = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))"""
DEFINITION = re.compile(rf"\[(?=[^\]]*[^\s\]])(?:[^\[\]\\]|\\.){{1,999}}\]:{_BLANKS}(?:<(?:[^<>\\\n]|\\.)*>|(?!<)(?P<bare>[^\x00-\x20\x7f]+))(?:{_BLANKS}(?<=[ \t\n]){_TITLE}[ \t]*(?:\n|\Z)|[ \t]*(?:\n|\Z))", re.S)

CONTAINERS = ("document", "block_quote", "list", "list_item")


class Refused(Exception):
    """The document is outside the profile; ``args[0]`` is the code."""

    @property
    def code(self) -> str:
        return self.args[0]


@dataclass(eq=False)
class Block:
    """A node; ``start`` and ``end`` are 0-based lines, both included."""

    type: str
    start: int
    end: int
    parent: Block | None = None
    at: int = 0  # place among the parent's children
    children: list[Block] = field(default_factory=list)
    lines: list[tuple[str, bool]] = field(default_factory=list)  # of a paragraph: text and whether lazy
    content: str = ""
    level: int = 0
    rows: list[list[str]] = field(default_factory=list)
    marker: tuple[str, str | None] | None = None
    pieces: list[tuple[int, int, int, int]] = field(default_factory=list)  # line, first character, spaces before it, length
    mark: tuple = ()  # list: kind; item: content column; fence: character, length, indent

    @property
    def path(self) -> tuple[int, ...]:
        out, node = [], self
        while node.parent is not None:
            out.append(node.at)
            node = node.parent
        return tuple(reversed(out))

    def walk(self) -> Iterator[Block]:
        """All nodes below in document order."""
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))


class Cursor:
    """One line; columns count a tab up to the next multiple of four, of which a part may be consumed."""

    __slots__ = ("text", "pos", "col", "left")

    def __init__(self, text: str) -> None:
        self.text, self.pos, self.col, self.left = text, 0, 0, 0

    def indent(self) -> tuple[int, int]:
        """Columns and characters of white space ahead."""
        col, pos = self.col + self.left, self.pos
        while pos < len(self.text) and self.text[pos] in " \t":
            col = col + 1 if self.text[pos] == " " else col + 4 - col % 4
            pos += 1
        return col - self.col, pos - self.pos

    def eat(self, columns: int) -> None:
        """Skip up to so many columns of white space."""
        while columns > 0:
            if self.left:
                step = min(columns, self.left)
                self.left, self.col, columns = self.left - step, self.col + step, columns - step
            elif self.pos < len(self.text) and self.text[self.pos] in " \t":
                self.left = 1 if self.text[self.pos] == " " else 4 - self.col % 4
                self.pos += 1
            else:
                return

    def skip(self, characters: int) -> None:
        """Skip characters that aren't white space."""
        self.pos += characters
        self.col += characters

    def rest(self) -> str:
        return " " * self.left + self.text[self.pos :]

    def blank(self) -> bool:
        return not self.text[self.pos :].strip(" \t")


def lines_of(text: str) -> list[tuple[str, str]]:
    """(line, ending) for each line; a line ends at CRLF, CR or LF."""
    return [(a, b) for a, b in re.findall(r"([^\r\n]*)(\r\n|\r|\n|\Z)", text) if a or b]


def cells(line: str, lazy: bool = False) -> list[str]:
    """Trimmed cells between unescaped pipes; outer pipes hold no cell, but white space before a lazy line's pipe does."""
    line = line.rstrip(" \t") if lazy else line.strip(" \t")
    if line.startswith("|"):
        line = line[1:]
        if not line:
            return []
    parts = PIPE.split(line)
    if len(parts) > 1 and not parts[-1].strip(" \t"):
        parts.pop()
    return [p.strip(" \t") for p in parts]


def frontmatter(lines: list[tuple[str, str]]) -> tuple[int, int] | None:
    """First and last line of a leading fence, closed by the first later one."""
    if len(lines) < 2 or lines[0][0] != "---" or not lines[1][0].strip(" \t"):
        return None
    for i in range(1, len(lines)):
        if lines[i][0].rstrip(" \t") == "---":
            return 0, i
    return None


def check_conflicts(lines: list[tuple[str, str]]) -> None:
    for line, _ in lines:
        if CONFLICT.match(line):
            raise Refused("conflict-marker")


def is_definition(text: str) -> bool:
    """Whether a paragraph begins with a link reference definition."""
    found = DEFINITION.match(text)
    if not found:
        return False
    depth, bare = 0, re.sub(r"\\[!-/:-@\[-`{-~]", "", found["bare"] or "")
    for c in bare:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


class Reader:
    """The open containers and the open leaf while lines come in."""

    def __init__(self, first: int) -> None:
        self.root = Block("document", first, first)
        self.open, self.leaf = [self.root], None
        self.prefix: dict[int, tuple[int, bool, bool]] = {}  # line: end of the container prefix, first of an item, lazy

    def feed(self, n: int, text: str) -> None:
        line = Cursor(text)
        kept, whole = self._match(line, n)
        self.prefix[n] = (line.pos, False, not whole)
        if whole and self.leaf is not None and self._into_leaf(line, n):
            return
        lazy_ok = self.leaf is not None and self.leaf.type == "paragraph"
        self._starts(line, n, kept, whole, lazy_ok)

    def _match(self, line: Cursor, n: int) -> tuple[int, bool]:
        """How many open containers go on in this line, and whether all do."""
        for k, node in enumerate(self.open[1:], 1):
            width, chars = line.indent()
            if node.type == "block_quote":
                if width > 3 or line.text[line.pos + chars : line.pos + chars + 1] != ">":
                    return k, False
                line.eat(width)
                line.skip(1)
                line.eat(1)
                self._reach(node, n)
            elif node.type == "list_item":
                if line.blank():
                    if not node.children:
                        return k, False
                elif width < node.mark[0]:
                    return k, False
                line.eat(node.mark[0])
        return len(self.open), True

    def _reach(self, node: Block | None, n: int) -> None:
        while node is not None and node.end < n:
            node.end, node = n, node.parent

    def _into_leaf(self, line: Cursor, n: int) -> bool:
        """Give the line to an open fence or table; False leaves it to block starts."""
        leaf = self.leaf
        width, _ = line.indent()
        if leaf.type == "code_block":
            char, length, indent = leaf.mark
            bare = line.rest().strip(" \t")
            self._reach(leaf, n)
            if width < 4 and len(bare) >= length and not bare.strip(char):
                self.leaf = None
            else:
                line.eat(min(width, indent))
                leaf.content += line.rest() + "\n"
                leaf.pieces.append((n, line.pos, line.left, len(line.rest()) + 1))
            return True
        if leaf.type == "table":
            if line.blank():
                self.leaf = None
                return False
            row = line.rest()
            if not PIPE.search(row) or row.strip(" \t") == "|" or width > 3 or self._other_block(row.lstrip(" \t")):
                raise Refused("table-not-blank-below")
            self._row(leaf, cells(row))
            self._reach(leaf, n)
            return True
        return False

    @staticmethod
    def _other_block(bare: str) -> bool:
        return bool(bare[:1] == ">" or HEADING.match(bare) or FENCE.match(bare) or HTML.match(bare) or HTML_TAG_LINE.match(bare) or BREAK.match(bare) or ITEM.match(bare))

    @staticmethod
    def _row(table: Block, row: list[str]) -> None:
        row = [c.replace("\\|", "|") for c in row[: table.level]]
        table.rows.append(row + [""] * (table.level - len(row)))

    def _starts(self, line: Cursor, n: int, kept: int, whole: bool, lazy_ok: bool) -> None:
        """Open the blocks that the rest of the line begins, then place its text."""
        while True:
            width, chars = line.indent()
            bare = line.text[line.pos + chars :]
            if not bare:
                return self._blank(kept, whole)
            joins = whole and self.leaf is not None and self.leaf.type == "paragraph"
            if width > 3:
                if joins or lazy_ok:
                    return self._text(line, n, lazy=not whole)
                raise Refused("indented-code")
            if bare[0] == ">":
                line.eat(width)
                line.skip(1)
                line.eat(1)
                kept = self._push(Block("block_quote", n, n), kept)
                self.prefix[n] = (line.pos, self.prefix[n][1], False)
            elif found := HEADING.match(bare):
                text = bare[found.end() :].strip(" \t")
                pieces = [(n, len(line.text) - len(bare[found.end() :].lstrip(" \t")), 0, len(text))]
                text = re.sub(r"(?:^|[ \t]+)#+\Z", "", text).rstrip(" \t")
                return self._leaf(Block("heading", n, n, content=text, level=len(found[1]), pieces=pieces), kept)
            elif found := FENCE.match(bare):
                run = found[1] or found[2]
                self._leaf(Block("code_block", n, n, mark=(run[0], len(run), width)), kept, stays=True)
                return None
            elif HTML.match(bare) or (not joins and not lazy_ok and HTML_TAG_LINE.match(bare)):
                found = MARKER.match(bare)
                if not found:
                    self._definition()
                    raise Refused("raw-html")
                return self._leaf(Block("html_block", n, n, content=line.rest() + "\n", marker=(found[1], found[2])), kept)
            elif joins and UNDERLINE.match(bare):
                self._definition()
                raise Refused("setext-heading")
            elif BREAK.match(bare):
                return self._leaf(Block("thematic_break", n, n), kept)
            elif (found := ITEM.match(bare)) and self._may_begin(found, bare, joins):
                kept = self._item(line, found, n, kept, width)
                self.prefix[n] = (line.pos, True, False)
            elif joins and self._table(line, bare, n):
                return None
            else:
                return self._text(line, n, lazy=not whole) if joins or lazy_ok else self._paragraph(line, n, kept)
            whole, lazy_ok = True, False

    @staticmethod
    def _may_begin(found: re.Match, bare: str, joins: bool) -> bool:
        empty = not bare[found.end() :].strip(" \t")
        return not joins or not (empty or (found[2] is not None and int(found[2]) != 1))

    def _item(self, line: Cursor, found: re.Match, n: int, kept: int, width: int) -> int:
        line.eat(width)
        line.skip(found.end())
        space, _ = line.indent()
        empty = line.blank()
        pad = 1 if empty or space > 4 else space
        line.eat(pad)
        kind = found[1] or found[3]
        if self.open[kept - 1].type != "list" or self.open[kept - 1].mark != (kind,):
            kept = self._push(Block("list", n, n, mark=(kind,)), kept)
        return self._push(Block("list_item", n, n, mark=(width + found.end() + pad,)), kept)

    def _push(self, node: Block, kept: int) -> int:
        """Close what doesn't go on and open a container; returns the open depth."""
        kept = self._place(node, kept)
        self.open.append(node)
        return kept + 1

    def _place(self, node: Block, kept: int) -> int:
        self._close_leaf()
        if node.type != "list_item" and self.open[kept - 1].type == "list":
            kept -= 1
        del self.open[kept:]
        node.parent = self.open[-1]
        node.at = len(node.parent.children)
        node.parent.children.append(node)
        self._reach(node.parent, node.end)
        return kept

    def _leaf(self, node: Block, kept: int, stays: bool = False) -> None:
        self._place(node, kept)
        self.leaf = node if stays else None

    def _blank(self, kept: int, whole: bool) -> None:
        self._close_leaf()
        if not whole:
            del self.open[kept:]

    def _paragraph(self, line: Cursor, n: int, kept: int) -> None:
        node = Block("paragraph", n, n)
        self._line(node, line, n, False)
        self._leaf(node, kept, stays=True)

    def _text(self, line: Cursor, n: int, lazy: bool) -> None:
        self._line(self.leaf, line, n, lazy)
        self._reach(self.leaf, n)

    @staticmethod
    def _line(paragraph: Block, line: Cursor, n: int, lazy: bool) -> None:
        text = line.rest()
        paragraph.lines.append((text, lazy))
        bare = text.lstrip(" \t")
        paragraph.pieces.append((n, len(line.text) - len(bare), 0, len(bare) + 1))

    def _table(self, line: Cursor, bare: str, n: int) -> bool:
        """Turn the open paragraph into a table if this line delimits one under its last line."""
        paragraph, delimiter = self.leaf, line.rest()
        head, lazy = paragraph.lines[-1]
        if any(c in "\f\v" for c in head + delimiter):
            if DELIMITER_SHAPE.match(delimiter):
                raise Refused("ambiguous-table")
            return False
        shape = cells(delimiter)
        names = cells(head, lazy)
        if not shape or len(names) != len(shape) or not all(DELIMITER_CELL.match(c) for c in shape):
            return False
        if not PIPE.search(head) or not PIPE.search(bare):
            raise Refused("ambiguous-table")
        if len(paragraph.lines) > 1:
            raise Refused("table-not-blank-above")
        before = paragraph.parent.children[paragraph.at - 1] if paragraph.at else None
        if before is not None and before.end == paragraph.start - 1:
            raise Refused("table-not-blank-above")
        paragraph.type, paragraph.level, paragraph.lines = "table", len(shape), []
        self._row(paragraph, names)
        self._reach(paragraph, n)
        return True

    def _definition(self) -> None:
        if self.leaf is not None and self.leaf.type == "paragraph" and is_definition(self._joined(self.leaf)):
            raise Refused("link-reference-definition")

    @staticmethod
    def _joined(paragraph: Block) -> str:
        return "\n".join(t.lstrip(" \t") for t, _ in paragraph.lines).rstrip(" \t")

    def _close_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is not None and leaf.type == "paragraph":
            leaf.content = self._joined(leaf)
            leaf.lines = []
            if is_definition(leaf.content):
                raise Refused("link-reference-definition")


def read(text: str) -> tuple[Block, tuple[int, int] | None, list[tuple[str, str]], dict[int, tuple[int, bool, bool]]]:
    """(root, frontmatter lines, lines, prefixes) of a text whose U+0000 are replaced first."""
    text = text.replace("\0", "\ufffd")
    lines = lines_of(text)
    check_conflicts(lines)
    front = frontmatter(lines)
    first = front[1] + 1 if front else 0
    reader = Reader(first)
    for n in range(first, len(lines)):
        reader.feed(n, lines[n][0])
    reader._close_leaf()
    for node in [*reader.root.walk(), reader.root]:
        if node.marker and not lines[node.start][1]:
            node.content = node.content.removesuffix("\n")
        while node.start < node.end < len(lines) and not lines[node.end][0].strip(" \t"):
            node.end -= 1
    return reader.root, front, lines, reader.prefix
