"""Replace, insert or delete one top-level block of a document's text.

The new text is read back: an edit that does more than was asked is refused, never returned.
Refusals are those of the profile and, in order of their tests: bad-position, no-such-block, nested-node, then
not-one-block, changes-another-block, rebinds-name.
"""

from __future__ import annotations

from collections.abc import Sequence

from quire.functions.blocks import Block, Refused, lines_of
from quire.functions.naming import Document, document

Line = tuple[str, str]


def _blank(line: Line) -> bool:
    return not line[0].strip(" \t")


def _text(lines: Sequence[Line]) -> str:
    return "".join(a + b for a, b in lines)


def _block(doc: Document, path: Sequence[int]) -> int:
    """The index of the block at ``path``."""
    node = doc.root
    for k in path:
        if not 0 <= k < len(node.children):
            raise Refused("no-such-block")
        node = node.children[k]
    if not path:
        raise Refused("no-such-block")
    if len(path) > 1:
        raise Refused("nested-node")
    return path[0]


def _ending(before: Line | None, lines: list[Line]) -> str:
    """The ending of a new line: that of the line before it, else the file's first, else LF."""
    if before and before[1]:
        return before[1]
    return next((e for _, e in lines if e), "\n")


def _shape(block: Block) -> tuple:
    """What must not change in a block that isn't edited."""
    leaves = [(n.path[1:], n.type, n.level, n.marker, n.content, n.rows) for n in [block, *block.walk()] if n.type not in ("block_quote", "list", "list_item")]
    return block.type, block.end - block.start, leaves


def _names(doc: Document, place, skip: int | None) -> dict[str, tuple[bool, list]]:
    """Bindings with block numbers mapped by ``place``; names that block ``skip`` declares are left out."""
    return {
        name: (region, [(place(n.path[0]), *n.path[1:]) for n in bound])
        for name, (region, bound) in doc.names.items()
        if doc.declared[name].path[0] != skip
    }


def _accept(old: Document, text: str, at: int, span: tuple[int, int] | None, gone: bool, added: bool) -> str:
    """Read ``text`` back: block ``at`` was taken out (``gone``), put in (``added``) or both."""
    new = document(text)
    blocks = new.root.children
    if added and not (at < len(blocks) and (blocks[at].start, blocks[at].end) == span):
        raise Refused("not-one-block")
    before = [b for i, b in enumerate(old.root.children) if not (gone and i == at)]
    after = [b for i, b in enumerate(blocks) if not (added and i == at)]
    if old.frontmatter != new.frontmatter or list(map(_shape, before)) != list(map(_shape, after)):
        raise Refused("changes-another-block")
    shift = added - gone
    here = "edited"
    was = _names(old, lambda i: here if gone and i == at else i + shift if i >= at else i, at if gone else None)
    now = _names(new, lambda i: here if added and i == at else i, at if added else None)
    if was.keys() != now.keys():
        raise Refused("rebinds-name")
    for name, (region, bound) in was.items():
        there = now[name][1]
        if gone != added and region:
            bound, there = ([p for p in x if p[0] != here] for x in (bound, there))
        if bound != there or region != now[name][0]:
            raise Refused("rebinds-name")
    return text


def replace_block(text: str, node: Sequence[int], source: str) -> str:
    old = document(text)
    at = _block(old, node)
    block, lines = old.root.children[at], lines_of(text)
    fresh = [line for line, _ in lines_of(source)]
    if fresh == [line for line, _ in lines[block.start : block.end + 1]]:
        return text
    end = _ending(lines[block.start - 1] if block.start else None, lines)
    put = [(line, end) for line in fresh]
    if put:
        put[-1] = (put[-1][0], lines[block.end][1])
    result = _text([*lines[: block.start], *put, *lines[block.end + 1 :]])
    return _accept(old, result, at, (block.start, block.start + len(put) - 1), True, True)


def insert_block(text: str, source: str, before: Sequence[int] | None = None, after: Sequence[int] | None = None) -> str:
    old = document(text)
    if before is not None and after is not None:
        raise Refused("bad-position")
    blocks, lines = old.root.children, lines_of(text)
    if before is not None:
        at = _block(old, before)
        row = blocks[at].start
    else:
        at = len(blocks) if after is None else _block(old, after) + 1
        row = blocks[at - 1].end + 1 if blocks else len(lines)
    end = _ending(lines[row - 1] if row else None, lines)
    put = [(line, end) for line, _ in lines_of(source)]
    size = len(put)
    lead = row > 0 and not _blank(lines[row - 1])
    if lead:
        put.insert(0, ("", end))
    if row < len(lines) and not _blank(lines[row]):
        put.append(("", end))
    if row == len(lines) and lines and not lines[-1][1] and put:
        lines[-1] = (lines[-1][0], end)
        put[-1] = (put[-1][0], "")
    result = _text([*lines[:row], *put, *lines[row:]])
    return _accept(old, result, at, (row + lead, row + lead + size - 1), False, True)


def delete_block(text: str, node: Sequence[int]) -> str:
    old = document(text)
    at = _block(old, node)
    block, lines = old.root.children[at], lines_of(text)
    first, last = block.start, block.end
    below = last + 1
    while below < len(lines) and _blank(lines[below]):
        below += 1
    if below < len(lines):
        last = below - 1
    else:
        while first and _blank(lines[first - 1]):
            first -= 1
    kept = lines[:first] + lines[last + 1 :]
    if kept and last == len(lines) - 1 and not lines[-1][1]:
        kept[-1] = (kept[-1][0], "")
    return _accept(old, _text(kept), at, None, True, False)
