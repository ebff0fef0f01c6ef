"""Three-way merge of line lists: clean where the sides change different lines, a conflict where they don't."""

from __future__ import annotations

from difflib import SequenceMatcher


def _changes(base: list[str], side: list[str]) -> list[tuple[int, int, list[str]]]:
    """(first, stop, new lines) of each run of base lines that a side replaces."""
    ops = SequenceMatcher(None, base, side, autojunk=False).get_opcodes()
    return [(a, b, side[c:d]) for op, a, b, c, d in ops if op != "equal"]


def merge(base: str, ours: str, theirs: str) -> tuple[str, str]:
    """("clean" or "conflict", text). Changes that touch or overlap meet; equal ones are taken once."""
    lines = base.splitlines(keepends=True)
    sides = [_changes(lines, text.splitlines(keepends=True)) for text in (ours, theirs)]
    marked = sorted([(a, b, k, new) for k, changes in enumerate(sides) for a, b, new in changes], key=lambda c: c[:3])
    out, at, conflict = [], 0, False
    while marked:
        group = [marked.pop(0)]
        stop = group[0][1]
        while marked and marked[0][0] <= stop:
            group.append(marked.pop(0))
            stop = max(stop, group[-1][1])
        start = group[0][0]
        out += lines[at:start]
        at = stop
        texts = []
        for k in (0, 1):
            text, place = [], start
            for a, b, _, new in (c for c in group if c[2] == k):
                text += lines[place:a] + new
                place = b
            texts.append(text + lines[place:stop])
        mine, other = texts
        old = lines[start:stop]
        if mine == other or other == old:
            out += mine
        elif mine == old:
            out += other
        else:
            conflict = True
            ended = lambda x: x[:-1] + [x[-1] + "\n"] if x and not x[-1].endswith("\n") else x
            out += ["<<<<<<< ours\n", *ended(mine), "=======\n", *ended(other), ">>>>>>> theirs\n"]
    return "conflict" if conflict else "clean", "".join(out + lines[at:])
