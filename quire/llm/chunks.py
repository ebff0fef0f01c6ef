"""Space-led chunks of texts: the units between which byte-level BPE never looks.

The public pattern (see ``public_tokenizers.PATTERN``) starts a new match before every space that
follows a character which is not white space. Cutting there leaves the matches as they are, so a
chunk (a word with its punctuation and the space before it) can be encoded once and reused. A text
in which some space follows white space is left whole: it is one chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.llm.words import plain

#: White space of any kind, then a space. Wider than needed is safe: such texts are not cut.
UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "

MARKS = frozenset(".,;:!?")


def cut_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each chunk in order, each text's end in these, the distinct chunks by code).

    A null text is empty. Joining a text's chunks gives the text back.
    """
    x = plain(texts)
    whole = np.asarray(pc.match_substring_regex(x, UNSAFE).cast(pa.uint8())).astype(bool)
    parts = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), x), " ")
    counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
    ends = np.cumsum(counts)
    d = parts.flatten().dictionary_encode()
    code = np.asarray(d.indices).astype(np.int64) * 2 + 1
    first = ends - counts
    code[first] -= 1
    bare = d.dictionary.to_numpy(zero_copy_only=False).tolist()
    seen = np.zeros(2 * len(bare), bool)
    seen[code] = True
    code = (np.cumsum(seen) - 1)[code]
    distinct = [" " + bare[u >> 1] if u % 2 else bare[u >> 1] for u in np.flatnonzero(seen).tolist()]
    if whole.any():
        at = np.flatnonzero(whole)
        code[first[at]] = len(distinct) + np.arange(len(at))
        distinct += x.filter(pa.array(whole)).to_numpy(zero_copy_only=False).tolist()
    return code, ends, distinct


def words_of(chunk: str, find: Callable[[str], list[str]]) -> list[str]:
    """The pattern's matches in a chunk; the commonest shapes need no pattern.

    Letters after an optional space are one match; one mark after them is another.
    """
    body = chunk[1:] if chunk[:1] == " " else chunk
    if body.isalpha():
        return [chunk]
    if body[-1:] in MARKS and body[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return find(chunk)


def gather(values: np.ndarray, begin: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[begin[c] : begin[c] + length[c]]`` over codes; also each piece's end."""
    n = length[code]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    place = np.repeat((begin[code] - (end - n)).astype(kind), n)
    place += np.arange(total, dtype=kind)
    return values.take(place), end
