"""The line oracle's tables against difflib and a plain vote."""

from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np

from quire.functions import lineage
from quire.operators import lineoracle


def blocks(a, b):
    return {(i + k, j + k) for i, j, n in SequenceMatcher(None, a, b).get_matching_blocks() for k in range(n)}


def edited(rng, lines, changes, words):
    out = list(lines)
    for _ in range(changes):
        at, kind = int(rng.integers(0, len(out) + 1)), rng.integers(0, 4)
        if kind == 0:
            out[at : at + int(rng.integers(1, 4))] = []
        elif kind == 1:
            out[at:at] = [str(w) for w in rng.choice(words, rng.integers(1, 4))]
        elif kind == 2 and len(out) > 3:
            cut = out[at : at + int(rng.integers(1, 6))]
            out[at : at + len(cut)] = []
            to = int(rng.integers(0, len(out) + 1))
            out[to:to] = cut
        else:
            out[at : at + 1] = [f"new {rng.integers(0, 10**6)}"]
    return out


def test_blocks_are_those_of_the_longest_match(spark):
    rng = np.random.default_rng(7)
    pairs = []
    for k in range(100):  # many equal lines: crossings of all kinds
        words = [f"w{x}" for x in range(int(rng.integers(2, 30)))] + ["", ""]
        a = [str(w) for w in rng.choice(words, rng.integers(0, 40))]
        pairs.append((a, edited(rng, a, int(rng.integers(0, 8)), words) if k % 2 else [str(w) for w in rng.choice(words, rng.integers(0, 40))]))
    for k in range(8):  # long enough for frequent lines
        a = [x for m in range(260) for x in (f"line {m if k % 2 else m % 90}", "")][: 240 + 20 * k]
        pairs.append((a, edited(rng, a, 25, ["", "line 3", "x"])))
    pairs += [([""] * 300, [""] * 280), (["a"] + [""] * 230 + ["b"], ["a"] + [""] * 220 + ["b"]), ([], ["a"]), (["x"], [])]
    frame = lambda side: spark.createDataFrame([(k, no, x) for k, p in enumerate(pairs) for no, x in enumerate(p[side])], "k long, no int, line string")
    got = defaultdict(set)
    for r in lineoracle.line_map(frame(0), frame(1), ["k"]).collect():
        got[r.k].add((r.i, r.j))
    for k, (a, b) in enumerate(pairs):
        assert got[k] == blocks(a, b), k


def test_a_long_pair_is_spread(spark, monkeypatch):
    monkeypatch.setattr(lineoracle, "RANGE", 1000)
    rng = np.random.default_rng(3)
    a = [f"line {k}" for k in range(20_000)]
    b = list(a)
    for at in sorted(rng.choice(20_000, 60, replace=False).tolist(), reverse=True):
        b[at : at + 2] = [f"edit {at}"]
    frame = lambda x: spark.createDataFrame([(1, k, line) for k, line in enumerate(x)], "k long, no int, line string")
    got = {(r.i, r.j) for r in lineoracle.line_map(frame(a), frame(b), ["k"]).collect()}
    assert got == blocks(a, b) and len(got) > 19_000


def brute(before, after, legs=None):
    base, new = lineage.Version(before), lineage.Version(after)
    out = []
    sides = [lineage.Version(x) for x in legs] if legs else [new, base]
    maps = []
    for side in sides:
        first, second = dict(blocks(base.lines, side.lines)), dict(blocks(side.lines, new.lines))
        maps.append({i: second[j] for i, j in first.items() if j in second})
    for k, p in enumerate(base.parts):
        lines = [x for x in range(p.first, p.last + 1) if base.lines[x].strip()]
        legs_ = [[m[x] for x in lines if x in m] for m in maps]
        held = [Counter(new.part_of_line[x] for x in leg if x in new.part_of_line) for leg in legs_]
        votes = {min(h, key=lambda t: (-h[t], t)) for h, leg in zip(held, legs_) if h and 2 * len(leg) >= len(lines)}  # noqa: B023
        every = {t for h, leg in zip(held, legs_) if 2 * len(leg) >= len(lines) for t in h}
        near = any(SequenceMatcher(None, p.content, q.content).ratio() >= 0.5 for q in new.parts)
        verdict = "SURVIVED" if len(votes) == 1 else "UNKNOWN" if votes or any(legs_) or near else "DELETED"
        out.append((k, verdict, next(iter(votes)) if len(votes) == 1 else None, len(every) > 1))
    return out


def test_verdicts_of_edits_and_merges(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(30):
        words = [f"word{x} here stands" for x in range(40)] + ["", "", "```", "# head", "- item"]
        base = [str(w) for w in rng.choice(words, rng.integers(1, 40))]
        ours, theirs = edited(rng, base, 3, words), edited(rng, base, 3, words)
        merged = edited(rng, ours, 3, words)
        rows.append((k, *("\n".join(x) for x in (base, merged, ours, theirs))))
    rows += [(100, None, "a", "a", "a"), (101, "a", None, "a", "a"), (102, "", "", "", ""), (103, "x y z", "", "", "")]
    frame = spark.createDataFrame(rows, "k long, before string, after string, ours string, theirs string")
    for legs in (None, ("ours", "theirs")):
        got = {(r.k, r.part, r.oracle, r.target, r.split) for r in lineoracle.line_oracle(frame, ["k"], legs=legs).collect()}
        want = {(r[0], *x) for r in rows if r[1] is not None and r[2] is not None for x in brute(r[1], r[2], r[3:] if legs else None)}
        assert got == want
        assert {x[2] for x in want} == {"SURVIVED", "UNKNOWN", "DELETED"}
