"""Names and slugs of a read document, and the refusals that concern them."""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import regex

from quire.functions import inlines
from quire.functions.blocks import Block, Reader, Refused, check_conflicts, frontmatter, lines_of, read

NAME = regex.compile(r"[a-z0-9][a-z0-9-]*")
CUSTOM_ID = regex.compile(r"\{#([^{}\s]+)\}\Z")
# The slug class is that of Unicode 13.0. These are the letters, marks, digits and connectors of later
# versions, by code point in hexadecimal; ranges run over what 13.0 leaves unassigned.
LATER = """
558 58B-58C 5C8-5C9 870-89F 8B5 8C8-8D2 B53-B54 C3C C5C-C5D CDC-CDD CF3 ECE 170D 1715-171F 180F 1AC1-1AF0 1B4C 1C89-1C8A
1DFA 208F 209D-209F 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7F4 AB6C-AB6D 10570-105F3 10780-107BF 10940-10959 10D40-10D85
10EC2-10EFF 10F70-10F85 11070-11075 110C2 1123F-11241 11380-113E2 116D0-116E3 11740-11746 11AB0-11ABF 11B0A-11BF9
11DB0-11DF1 11F00-11F5A 1246F 12475-1247F 12550-12FF0 1342F 13440-143FA 16100-16139 16A70-16AC9 16D40-16D79 16EA0-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CFF 18D09-1AFFE 1B11F-1B132 1B155 1B168 1CCF0-1CF46 1D127-1D128 1D250-1D281 1D6A6
1DF00-1DFFF 1E030-1E08F 1E290-1E2AE 1E4D0-1E7FE 2A6DE-2A6DF 2B735-2B73F 2B81E 2CEA2-2CEAD 2EBF0-2EE5D 31350-3FC3F
""".split()
NEW = "".join("-".join(f"\\U{int(end, 16):08x}" for end in ends.split("-")) for ends in LATER)
#: What a slug drops: all but word characters, as Ruby's \p{Word} has them, hyphens and spaces.
NOT_IN_SLUG = regex.compile(rf"[^\p{{Alphabetic}}\p{{M}}\p{{Nd}}\p{{Pc}}\- ]|[{NEW}]")
MARKUP = regex.compile(r"[*_`\[<&]")


def _slugged(text: str) -> str:
    return NOT_IN_SLUG.sub("", text.lower()).replace(" ", "-")


def slug(heading: str) -> str | None:
    """The heading's slug; None if it holds markup or nothing remains."""
    return None if MARKUP.search(heading) else _slugged(heading) or None


def rendered_slugs(heading: str) -> set[str]:
    """Slugs of the heading as a renderer shows it: tags gone, links and images reduced to their text."""
    found, cut = inlines.scan(heading), []
    cut += found.tags
    for link in found.links:
        cut += [(link.start, link.start + 1 + link.image), (link.close, link.end)]
    gone = {k for a, b in cut for k in range(a, b)}
    text = _slugged("".join(c for k, c in enumerate(heading) if k not in gone))
    return {text, text.replace("_", "")}


@dataclass
class Document:
    """A read document. ``names`` maps each marker's name to (is_region, bound nodes)."""

    text: str
    root: Block
    frontmatter: tuple[int, int] | None
    lines: list[tuple[str, str]]
    nodes: list[Block] = field(default_factory=list)
    names: dict[str, tuple[bool, list[Block]]] = field(default_factory=dict)
    declared: dict[str, Block] = field(default_factory=dict)
    prefix: dict[int, tuple[int, bool, bool]] = field(default_factory=dict)
    slugs: dict[str, list[Block]] = field(default_factory=lambda: defaultdict(list))

    def resolve(self, name: str) -> str | tuple[bool, list[Block]]:
        """A marker first, then a slug that one heading has."""
        if name in self.names:
            return self.names[name]
        hits = self.slugs.get(name, ())
        return (False, list(hits)) if len(hits) == 1 else f"#REF!({name})"


def leaf_key(node: Block) -> tuple[str, str] | None:
    """(type, text) by which versions are compared; None for nodes without text."""
    if node.type == "heading":
        return f"h{node.level}", unicodedata.normalize("NFC", node.content)
    if node.type == "table":
        return "table", "\n".join(" | ".join(c.replace("|", "\\|") for c in row) for row in node.rows)
    if node.type in ("paragraph", "code_block"):
        return {"paragraph": "p", "code_block": "code"}[node.type], unicodedata.normalize("NFC", node.content)
    return None


def _siblings(children: list[Block], doc: Document, faults: set[str]) -> None:
    """Bind the markers among the children of one container."""
    ends: dict[str, list[int]] = defaultdict(list)
    for i, node in enumerate(children):
        if node.marker and node.marker[1] == "end":
            ends[node.marker[0]].append(i)
    for i, node in enumerate(children):
        name, part = node.marker or (None, "end")
        if part == "end":
            continue
        if name in doc.names:
            faults.add("duplicate-name")
        if part is None:
            bound = [n for n in children[i + 1 : i + 2] if not n.marker]
        else:
            close = next((j for j in ends[name] if j > i), None)
            if close is None:
                faults.add("unpaired-region")
                bound = [node]
            else:
                ends[name].remove(close)
                bound = children[i + 1 : close]
        if not bound:
            faults.add("dangling-marker")
        doc.names[name], doc.declared[name] = (part is not None, bound), node
    if any(ends.values()):
        faults.add("unpaired-region")


def _shadowed(doc: Document) -> bool:
    """Whether a marker takes the slug of a heading that it neither binds nor begins right below."""
    for name, (_, bound) in doc.names.items():
        for heading in doc.slugs.get(name, ()):
            below = heading.parent.children[heading.at + 1 : heading.at + 2]
            if heading not in bound and not any(n.marker == (name, "begin") for n in below):
                return True
    return False


def _targets(doc: Document, scans: list[inlines.Scan]) -> set[str]:
    """Everything that a link to ``#name`` may mean in a renderer."""
    out, seen = {"top", *doc.names}, defaultdict(int)
    for node in doc.nodes:
        if node.type != "heading":
            continue
        variants = [node.content]
        if custom := CUSTOM_ID.search(node.content):
            out.add(custom[1])
            variants.append(node.content[: custom.start()].rstrip(" \t"))
        for base in set().union(*map(rendered_slugs, variants)):
            out.add(f"{base}-{seen[base]}" if seen[base] else base)
            seen[base] += 1
    return out.union(*(s.ids for s in scans))


def _dangling(doc: Document) -> bool:
    texts = [n.content for n in doc.nodes if n.type in ("paragraph", "heading")]
    texts += [c for n in doc.nodes if n.type == "table" for row in n.rows for c in row]
    scans = [inlines.scan(t) for t in texts if "](" in t or "<" in t]
    wanted = {x.destination[1:] for s in scans for x in s.links if not x.image and x.title != '"transclude"' and x.destination.startswith("#")}
    wanted = {w for w in wanted if NAME.fullmatch(w)}
    return bool(wanted) and not wanted <= _targets(doc, scans)


def document(text: str, check_links: bool = True) -> Document:
    """Read a document or raise Refused; annotation bodies are read with ``check_links`` off."""
    root, front, lines, prefix = read(text)
    doc = Document(text, root, front, lines, list(root.walk()), prefix=prefix)
    faults: set[str] = set()
    for container in [root, *doc.nodes]:
        if container.type in ("document", "block_quote", "list_item"):
            _siblings(container.children, doc, faults)
    for code in ("duplicate-name", "unpaired-region", "dangling-marker"):
        if code in faults:
            raise Refused(code)
    for node in doc.nodes:
        if node.type == "heading" and (s := slug(node.content)):
            doc.slugs[s].append(node)
    if _shadowed(doc):
        raise Refused("name-shadows-slug")
    if check_links and _dangling(doc):
        raise Refused("dangling-link")
    return doc


def _ref(node: Block) -> dict:
    return {"node": list(node.path), "type": node.type}


def _is_bare(heading: Block, name: str) -> bool:
    """Whether no region of that name begins right below the heading."""
    return not any(n.marker == (name, "begin") for n in heading.parent.children[heading.at + 1 : heading.at + 2])


class NameReader:
    """Names and slugs of a document that comes in pieces; refuses what ``document`` refuses.

    A block leaves memory once the next ones have begun: what stays is a marker's name with its targets, a slug
    with its first heading, the distinct contents of headings and links, and the line that is not yet whole.
    """

    def __init__(self) -> None:
        self.rest, self.line, self.reader = "", 0, None
        self.head: list[tuple[str, str]] | None = []  # lines of a frontmatter that may still close
        self.code: str | None = None
        self.conflict = False
        self.done, self.before = 0, None  # blocks taken, and a marker that awaits the next one
        self.names: dict[str, tuple[bool, list[dict]]] = {}
        self.open: dict[str, list[dict]] = {}
        self.slugs: dict[str, list] = {}  # count, first heading
        self.bare: Counter[str] = Counter()  # headings by slug that a marker must bind to take that name, less those so bound
        self.faults: set[str] = set()
        self.contents: Counter[str] = Counter()
        self.wanted: set[str] = set()
        self.ids: set[str] = set()

    def feed(self, text: str) -> None:
        """Take a piece; a line counts once its line feed has come."""
        text = self.rest + text
        cut = text.rfind("\n") + 1
        self.rest = text[cut:]
        self._lines(lines_of(text[:cut].replace("\0", "\ufffd")))

    def finish(self) -> str | None:
        """The document ends; its refusal code, if any."""
        self._lines(lines_of(self.rest.replace("\0", "\ufffd")))
        if self.head is not None:
            self._body(self.head)
        if self.conflict:
            return "conflict-marker"
        if self.code is None:
            try:
                self.reader._close_leaf()
                self._take(len(self.reader.root.children))
            except Refused as refused:
                self.code = refused.code
        return self.code or self._refusal()

    def _lines(self, lines: list[tuple[str, str]]) -> None:
        try:
            check_conflicts(lines)
        except Refused:
            self.conflict = True
        if self.conflict:
            return
        if self.head is not None:
            self.head += lines
            first = frontmatter(self.head)
            if len(self.head) < 2 or (first is None and self.head[0][0] == "---" and self.head[1][0].strip(" \t")):
                return
            lines, self.head = self.head, None
            self.line = first[1] + 1 if first else 0
            lines = lines[self.line :]
        self._body(lines)

    def _body(self, lines: list[tuple[str, str]]) -> None:
        self.head = None
        if self.reader is None:
            self.reader = Reader(self.line)
        if self.code is not None:
            return
        try:
            for text, _ in lines:
                self.reader.feed(self.line, text)
                self.line += 1
                self.reader.prefix.clear()
                if len(self.reader.root.children) > self.done + 100:
                    self._take(len(self.reader.root.children) - 2)  # a table looks at the block before it
        except Refused as refused:
            self.code = refused.code

    def _take(self, stop: int) -> None:
        """Note the blocks up to ``stop`` among the root's and let them go."""
        children = self.reader.root.children
        for k in range(self.done, stop):
            node, children[k] = children[k], None
            self._root(node)
            self._inside(node)
        self.done = max(self.done, stop)

    def _name(self, name: str, region: bool, targets: list[dict]) -> None:
        if name in self.names:
            self.faults.add("duplicate-name")
        self.names[name] = (region, targets)

    def _bind(self, name: str, targets: list[dict], node: Block) -> None:
        targets.append(_ref(node))
        if node.type == "heading" and slug(node.content) == name:
            self.bare[name] -= _is_bare(node, name)

    def _root(self, node: Block) -> None:
        """The marker before this block, then this block as a marker or as a part of open regions."""
        name, part = node.marker or (None, None)
        if self.before is not None:
            if node.marker:
                self.faults.add("dangling-marker")
            else:
                self._bind(self.before, self.names[self.before][1], node)
            self.before = None
        if node.marker and part == "end":
            if name in self.open:
                if not self.open.pop(name):
                    self.faults.add("dangling-marker")
            else:
                self.faults.add("unpaired-region")
        for region, targets in self.open.items():
            self._bind(region, targets, node)
        if node.marker and part != "end":
            targets: list[dict] = []
            self._name(name, part is not None, targets)
            if part is None:
                self.before = name
            else:
                self.open[name] = targets

    def _inside(self, node: Block) -> None:
        doc = Document("", node, None, [], [node, *node.walk()])
        for container in doc.nodes:
            if container.type in ("block_quote", "list_item"):
                _siblings(container.children, doc, self.faults)
        for name, (region, bound) in doc.names.items():
            self._name(name, region, targets := [])
            for n in bound:
                self._bind(name, targets, n)
        for n in doc.nodes:
            if n.type == "heading":
                self.contents[n.content] += 1
                if s := slug(n.content):
                    hits = self.slugs.setdefault(s, [0, _ref(n)])
                    hits[0] += 1
                    self.bare[s] += _is_bare(n, s)
            for text in [n.content] if n.type in ("paragraph", "heading") else [c for row in n.rows for c in row]:
                if "](" in text or "<" in text:
                    scan = inlines.scan(text)
                    self.ids |= set(scan.ids)
                    self.wanted |= {x.destination[1:] for x in scan.links if not x.image and x.title != '"transclude"' and x.destination.startswith("#")}

    def _refusal(self) -> str | None:
        if self.before is not None:
            self.faults.add("dangling-marker")
        if self.open:
            self.faults.add("unpaired-region")
        for code in ("duplicate-name", "unpaired-region", "dangling-marker"):
            if code in self.faults:
                return code
        if any(self.bare[name] > 0 for name in self.names):
            return "name-shadows-slug"
        wanted = {w for w in self.wanted if NAME.fullmatch(w)} - self.names.keys() - self.ids - {"top"}
        return "dangling-link" if wanted and not wanted <= self._rendered(wanted) else None

    def _rendered(self, wanted: set[str]) -> set[str]:
        """Those of the names that a renderer gives to headings; the n-th heading of a slug after the first has ``-n`` after it."""
        out, seen = set(), Counter()
        for content, count in self.contents.items():
            variants = [content]
            if custom := CUSTOM_ID.search(content):
                out.add(custom[1])
                variants.append(content[: custom.start()].rstrip(" \t"))
            for base in set().union(*map(rendered_slugs, variants)):
                seen[base] += count
        for w in wanted:
            base, _, n = w.rpartition("-")
            if seen[w] or (n.isascii() and n.isdigit() and n[0] != "0" and int(n) < seen[base]):
                out.add(w)
        return out

    def resolved(self) -> Iterator[tuple[str, bool, list[dict]]]:
        """(name, whether a region, targets): markers first, then slugs that one heading has."""
        for name, (region, targets) in self.names.items():
            yield name, region, targets
        for name, (count, first) in self.slugs.items():
            if count == 1 and name not in self.names:
                yield name, False, [first]
