"""Where a part of a text went: the line oracle, its two doubts, and quotes and names that look for their target.

A text is cut into parts: runs of non-blank lines, a fence with what it holds being one. The oracle maps
lines (longest matching blocks of line lists) along each leg of a merge and lets the legs vote; it never
looks at quotes. Quotes and names are the mechanisms that it judges.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import cached_property
from typing import NamedTuple

#: What is a fence, a heading, a marker of a region, and what a part's first line makes of it.
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")
REGION = re.compile(r"<!--\s*#([a-z0-9][a-z0-9-]*)\s*-->$")
KINDS = [("heading", re.compile(r"#{1,6}\s")), ("code", FENCE), ("table", re.compile(r"\|")), ("html", re.compile(r"<")), ("quote", re.compile(r">")), ("list", re.compile(r"[-*+]\s|\d+[.)]\s"))]
#: Types whose parts hold natural language.
PROSE = ("paragraph", "list", "quote")
CONFIDENT = ALIKE = 0.5
CONTEXT, SHORTEST = 48, 20
#: What a strict quote asks for: distance to the next best, context, distinct characters or distinct words.
MARGIN, AROUND, CHARACTERS, WORDS = 0.15, 0.30, 24, 8


class Part(NamedTuple):
    type: str
    first: int  # line numbers, the last one included
    last: int
    start: int  # code point of the first line
    content: str


class Version:
    """A text with its parts, names and lines, each found once."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    @cached_property
    def front(self) -> int:
        """Last line of a leading frontmatter, -1 without one."""
        if self.lines[0] != "---":
            return -1
        return next((k for k, x in enumerate(self.lines[1:], 1) if x.rstrip(" \t") == "---"), -1)

    @cached_property
    def parts(self) -> list[Part]:
        out, k = [], 0
        while k < len(self.lines):
            if not self.lines[k].strip():
                k += 1
                continue
            end = k
            if fence := FENCE.match(self.lines[k]):
                close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$")
                end = next((j for j in range(k + 1, len(self.lines)) if close.match(self.lines[j])), len(self.lines) - 1)
            else:
                while end + 1 < len(self.lines) and self.lines[end + 1].strip() and not FENCE.match(self.lines[end + 1]):
                    end += 1
            kind = "frontmatter" if k <= self.front else next((name for name, form in KINDS if form.match(self.lines[k].lstrip())), "paragraph")
            out.append(Part(kind, k, end, self.starts[k], "\n".join(self.lines[k : end + 1])))
            k = end + 1
        return out

    @cached_property
    def balanced(self) -> bool:
        """Whether every fence closes and there are two parts at least."""
        last = self.parts[-1] if self.parts else None
        open_ = last is not None and last.type == "code" and (last.first == last.last or not FENCE.match(self.lines[last.last]))
        return len(self.parts) >= 2 and not open_

    @cached_property
    def part_of_line(self) -> dict[int, int]:
        return {line: k for k, p in enumerate(self.parts) for line in range(p.first, p.last + 1)}

    @cached_property
    def headings(self) -> list[tuple[int, int, str]]:
        """(part, level, slug) of every heading line of a heading part."""
        out = []
        for k, p in enumerate(self.parts):
            for line in p.content.split("\n") if p.type == "heading" else ():
                if found := HEADING.match(line):
                    out.append((k, len(found[1]), re.sub(r"[^\w\s-]", "", found[2].lower()).strip().replace(" ", "-")))
        return out

    @cached_property
    def regions(self) -> list[tuple[str, int]]:
        """(name, part) of every marker line: the part of the first text line after it."""
        out = []
        for k, line in enumerate(self.lines):
            if found := REGION.match(line.strip()):
                after = next((j for j in range(k + 1, len(self.lines)) if self.lines[j].strip()), None)
                if after is not None and not REGION.match(self.lines[after].strip()):
                    out.append((found[1], self.part_of_line[after]))
        return out

    @cached_property
    def sections(self) -> list[tuple[int, int]]:
        """Each heading part and those up to the next heading of any level."""
        at = sorted({k for k, _, _ in self.headings})
        return [(a, b - 1) for a, b in zip(at, [*at[1:], len(self.parts)], strict=False)]

    @cached_property
    def names(self) -> dict[str, tuple[str, int, int]]:
        """What each name that stands for one thing stands for: (region or slug, first part, last part).

        A region's name hides headings of the same slug. A heading reaches to the next one that isn't
        below it; reading backwards, that is the nearest one noted for its level or a higher one.
        """
        follows, reach = [len(self.parts)] * 7, {}
        for part in sorted({k for k, _, _ in self.headings}, reverse=True):
            level = min(lv for k, lv, _ in self.headings if k == part)
            reach[part] = follows[level] - 1
            follows[level:] = [part] * (7 - level)
        places: dict[str, list[tuple[str, int, int]]] = {}
        for part, _, slug in self.headings:
            places.setdefault(slug, []).append(("slug", part, reach[part]))
        marked: dict[str, list[tuple[str, int, int]]] = {}
        for name, part in self.regions:
            marked.setdefault(name, []).append(("region", part, part))
        return {name: found[0] for name, found in {**places, **marked}.items() if len(found) == 1}

    def span(self, first: int, last: int) -> str:
        return self.text[self.parts[first].start : self.parts[last].start + len(self.parts[last].content)]


def line_map(a: Sequence[str], b: Sequence[str]) -> dict[int, int]:
    return {i + k: j + k for i, j, n in SequenceMatcher(None, a, b).get_matching_blocks() for k in range(n)}


class Oracle:
    """Descendants of base parts in the merged text, voted by two legs; one edit is a merge with its own base."""

    def __init__(self, base: Version, merged: Version, legs: tuple[Version, Version] | None = None):
        self.base, self.merged = base, merged
        self.maps = []
        for leg in legs or (merged, base):
            down = line_map(leg.lines, merged.lines)
            self.maps.append({i: down[j] for i, j in line_map(base.lines, leg.lines).items() if j in down})

    def mapped(self, first: int, last: int) -> tuple[int, list[list[int]]]:
        """How many text lines base parts first..last have, and where each leg takes them."""
        lines = [k for k in range(self.base.parts[first].first, self.base.parts[last].last + 1) if self.base.lines[k].strip()]
        return len(lines), [[m[k] for k in lines if k in m] for m in self.maps]

    def verdict(self, first: int, last: int) -> tuple[str, int | None]:
        """SURVIVED with the merged part, DELETED, or UNKNOWN."""
        n, by_leg = self.mapped(first, last)
        votes = set()
        for lines in by_leg:
            held = Counter(self.merged.part_of_line[x] for x in lines if x in self.merged.part_of_line)
            if n and len(lines) >= CONFIDENT * n and held:
                votes.add(min(held, key=lambda k: (-held[k], k)))
        if votes:
            return ("SURVIVED", votes.pop()) if len(votes) == 1 else ("UNKNOWN", None)
        if any(by_leg):
            return "UNKNOWN", None
        own = self.base.span(first, last)
        return ("UNKNOWN" if any(SequenceMatcher(None, own, p.content).ratio() >= ALIKE for p in self.merged.parts) else "DELETED"), None

    def split(self, first: int, last: int, unit_of_part: Callable[[int], int | None]) -> bool:
        """Whether the lines of confident legs end in two units or more."""
        n, by_leg = self.mapped(first, last)
        parts = {self.merged.part_of_line[x] for lines in by_leg if n and len(lines) >= CONFIDENT * n for x in lines if x in self.merged.part_of_line}
        return len({unit_of_part(p) for p in parts} - {None}) > 1


class Units:
    """Units of two versions in order (parts, or sections), and where each unit of the old one went."""

    def __init__(self, old: list[str], new: list[str], went: list[int | None]):
        self.old, self.new = old, new
        many_old, many_new = Counter(old), Counter(new)
        #: Units with a text of their own on both sides that went somewhere: a neighbour of this kind speaks for a place.
        self.firm = {a: b for a, b in enumerate(went) if b is not None and many_old[old[a]] == 1 and many_new[new[b]] == 1}

    def told_apart(self, own: int, place: int | None) -> bool:
        """Whether a unit's new place is told apart from all others with its old or new text by firm neighbours.

        A unit that is gone must have left no equal text behind.
        """
        if place is None:
            return self.old[own] not in self.new
        wanted = {self.old[own], self.new[place]}
        speak = {k: sum(self.firm.get(own + step) == k + step for step in (-1, 1)) for k, text in enumerate(self.new) if text in wanted or k == place}
        return all(n < speak[place] for k, n in speak.items() if k != place)


def quote_hits(base: Version, part: int, merged: Version, strict: bool) -> tuple[str, int | None]:
    """A quote with its context looks for its part: equal text, equal text in context, likest text."""
    p = base.parts[part]
    if strict and len(set(p.content)) < CHARACTERS and len(set(p.content.split())) < WORDS:
        return "low-entropy", None
    around = lambda v, q: (v.text[max(0, q.start - CONTEXT) : q.start], v.text[q.start + len(q.content) :][:CONTEXT])
    mine = around(base, p)
    context = lambda q: sum(SequenceMatcher(None, a, b).ratio() for a, b in zip(mine, around(merged, q), strict=True)) / 2
    equal = [k for k, q in enumerate(merged.parts) if q.content == p.content]
    if len(equal) == 1:
        return "exact", equal[0]
    score = {k: context(merged.parts[k]) for k in equal}
    status = "context"
    if not equal:
        status = "fuzzy"
        score = {k: r for k, q in enumerate(merged.parts) if (r := SequenceMatcher(None, p.content, q.content).ratio()) >= ALIKE}
    if not score:
        return "lost", None
    ranked = sorted(score, key=lambda k: (-score[k], k))
    best = ranked[0]
    if strict and len(ranked) > 1 and score[best] - score[ranked[1]] < MARGIN:
        return "ambiguous", None
    if strict and context(merged.parts[best]) < AROUND:
        return "no-context", None
    return status, best


def grade(truth: str, hit: bool, right: bool) -> str:
    """LOUD: refused though it survived. WRONG: resolved to another part, or to any part of what was deleted."""
    if truth == "SURVIVED":
        return "LOUD" if not hit else "correct" if right else "WRONG"
    return "WRONG" if hit else "correct"


Subject = NamedTuple("Subject", [("mech", str), ("name", str | None), ("kind", str), ("span", tuple[int, int]), ("units", Units | None), ("own", int), ("home", Callable[[int], int | None])])


def subjects(base: Version, merged: Version, oracle: Oracle) -> Iterator[Subject]:
    """Every part of the base, then every name of it, with the units among which doubts about it are settled."""
    went = lambda spans: [t if v == "SURVIVED" else None for v, t in (oracle.verdict(*s) for s in spans)]
    whole = [(k, k) for k in range(len(base.parts))]
    parts = Units([p.content for p in base.parts], [p.content for p in merged.parts], went(whole))
    section = {k: u for u, (a, b) in enumerate(merged.sections) for k in range(a, b + 1)}
    texts = [[v.span(*s) for s in v.sections] for v in (base, merged)]
    sections = Units(*texts, [section.get(t) for t in went(base.sections)])
    for k, p in enumerate(base.parts):
        yield Subject("Q", None, p.type, (k, k), parts, k, lambda x: x)
    for name, (kind, first, last) in sorted(base.names.items()):
        if kind == "region":
            yield Subject("R", name, "R:region", (first, last), parts, first, lambda x: x)
        else:
            yield Subject("R", name, "R:slug", (first, last), sections, next(u for u, (a, b) in enumerate(base.sections) if a <= first <= b), section.get)


def settled(subject: Subject, base: Version, oracle: Oracle) -> tuple[str, str, int | None]:
    """(verdict with its doubts, truth, target) of a subject."""
    truth, target = oracle.verdict(*subject.span)
    if truth != "SURVIVED":
        return truth, truth, target
    span = base.sections[subject.own] if subject.kind == "R:slug" else subject.span
    if not subject.units.told_apart(subject.own, subject.home(target)):
        return "UNDECIDABLE-REPEAT", truth, target
    return "UNDECIDABLE-SPLIT" if oracle.split(*span, subject.home) else truth, truth, target


def evaluate(before: str, after: str, legs: tuple[str, str] | None = None) -> list[dict]:
    """A record for each part (mechanism Q) and each name that is unique before (mechanism R).

    A part too short to be quoted has a record that says so and no verdict.
    """
    base, merged = Version(before), Version(after)
    sides = tuple(map(Version, legs)) if legs else None
    if not base.parts or not merged.parts:
        return []
    well = all(v.balanced for v in (base, merged, *(sides or ())))
    oracle, out = Oracle(base, merged, sides), []
    none = {f"{policy}_{x}": None for policy in ("naive", "hard") for x in ("status", "cls", "text")}
    for subject in subjects(base, merged, oracle):
        own = base.span(*subject.span)
        record = {"mech": subject.mech, "skip": None, "name": subject.name, "first": subject.span[0], "last": subject.span[1], "type": subject.kind, "unit": own, "wellformed": well, "prose": subject.mech == "R" or subject.kind in PROSE}
        if subject.mech == "Q" and len(own) < SHORTEST:
            out.append(record | none | {"skip": "short_quote", "oracle": None, "decided": False, "target": None, "target_text": None})
            continue
        verdict, truth, target = settled(subject, base, oracle)
        decided, hits = verdict in ("SURVIVED", "DELETED"), dict(none)
        if subject.mech == "Q":
            found = {policy: quote_hits(base, subject.own, merged, policy == "hard") for policy in ("naive", "hard")}
            found = {policy: (status, hit if hit is None else (hit, hit)) for policy, (status, hit) in found.items()}
        else:
            place = merged.names.get(subject.name)
            found = {"hard": ("RESOLVED", place[1:]) if place else ("#REF!", None)}
        for policy, (status, hit) in found.items():
            right = hit is not None and target is not None and hit[0] <= target <= hit[1]
            hits |= {f"{policy}_status": status, f"{policy}_cls": grade(truth, hit is not None, right) if decided else None, f"{policy}_text": merged.span(*hit) if hit else None}
        out.append(record | hits | {"oracle": verdict, "decided": decided, "target": target, "target_text": None if target is None else merged.parts[target].content})
    return out
