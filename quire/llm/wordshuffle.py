"""Byte-level BPE by a global distinct-word shuffle.

1. Every text is cut into pre-tokens at their positions. A block (some texts of one task) lists its
   distinct words and keeps the position table as numbers into that list, so an occurrence is a number
   and only (block, word) pairs travel. Position tables are files of the shared folder: they stay where
   they are until the ids come.
2. The words of all blocks meet in one shuffle, by word. Each distinct word of the whole corpus is
   encoded once there; parts are as many as the texts need, so a task's words fit its memory.
3. The ids are joined back to the blocks by block number and reassembled by position.
4. Decoding joins each id with its bytes in the token-byte table, which every task holds: its size is
   the vocabulary's, not the corpus's.

A word that stands in every block is a row a block. Ids and words meet by the word itself, never by a
hash of it. Null texts are empty; empty texts give no ids; repeated rows stay, each on its own; an
empty table gives an empty one. A column of the input that clashes with a new one gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm import shared
from quire.llm.chunks import cut_chunks, gather, words_of
from quire.llm.packs import pack, unpack
from quire.llm.words import hashes, steps

#: Bytes of text in a block; one longer text is a block of its own. Larger blocks repeat fewer words.
BLOCK_BYTES = 12 << 20
#: (block, word) pairs that a task encodes at a time and hands on by block.
HELD = 200_000
#: Bytes of text for each part of the word shuffle.
PART_BYTES = 128 << 20
#: Word positions that a finishing task turns into ids at a time, whole texts only.
POSITIONS = 500_000


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding_of(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table, by id: all bytes, each token's begin and length in them."""
    ranks = ranks_of(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        table[rank] = word
    length = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(length) - length, length


def decode(ids: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids joined with the token-byte table: all bytes, and where each id's bytes end in them."""
    raw, begin, length = token_bytes(vocabulary)
    return gather(raw, begin, length, ids.astype(np.int64))


def pretokens(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word number of each position in order, each text's end in these, the distinct words)."""
    import regex

    code, ends, distinct = cut_chunks(texts)
    find, known, numbers, count = regex.compile(pattern).findall, {}, [], []
    for chunk in distinct:
        found = words_of(chunk, find)
        count.append(len(found))
        numbers += [known.setdefault(w, len(known)) for w in found]
    count = np.array(count, np.int64)
    flat, end = gather(np.array(numbers, np.int64), np.cumsum(count) - count, count, code)
    return flat, np.concatenate([[0], end])[ends], list(known)


def pack_words(words: pa.Array) -> bytes:
    return pack([np.asarray(pc.binary_length(words)).astype(np.int64), np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)])


def unpack_words(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(raw.astype(np.uint8)))


def position_table(docs: DataFrame, kept: list[str], pattern: str, parts: int, text_col: str) -> DataFrame:
    """Blocks of texts: block, place (its position file), rows (the kept columns), words (part, numbers and words)."""
    spark = docs.sparkSession
    folder = shared.new_folder(spark, "positions")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"block long, place string, rows array<{rows.schema['row'].dataType.simpleString()}>, words array<struct<part:int,data:binary>>"
    kind = pa.list_(pa.struct([("part", pa.int32()), ("data", pa.binary())]))

    def one_block(block: int, own: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        flat, ends, distinct = pretokens(texts, pattern)
        order = np.argsort(-np.bincount(flat, minlength=len(distinct)), kind="stable")  # frequent words get small numbers
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        words = pa.array([distinct[k] for k in order.tolist()], pa.string())
        # a name of its own, as another attempt of this task may meet its rows in another order
        place = f"{folder}/{block:016x}-{uuid.uuid4().hex}.bin"
        shared.write_arrays(place, {"packed": np.frombuffer(pack([number[flat], ends]), np.uint8)})
        deal = (hashes(words) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(deal, kind="stable")
        cuts = np.flatnonzero(np.diff(deal[by_part], prepend=-1, append=-1)).tolist() if len(words) else [0]
        dealt = [{"part": int(deal[by_part[a]]), "data": pack([np.diff(by_part[a:b], prepend=0)]) + pack_words(words.take(pa.array(by_part[a:b])))} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([place], pa.string()), rows, pa.array([dealt], kind)], names=["block", "place", "rows", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for own, texts in steps(batch.column(0), batch.column(1), BLOCK_BYTES):
                more = texts.nbytes
                if held and size + more > BLOCK_BYTES:
                    yield one_block(block, *(pa.concat_arrays(x) for x in zip(*held, strict=True)))
                    block, held, size = block + 1, [], 0
                held.append((own, texts))
                size += more
        if held:
            yield one_block(block, *(pa.concat_arrays(x) for x in zip(*held, strict=True)))

    return shared.cut(rows.mapInArrow(shared.lean(run), schema), "blocks")


def encode_words(blocks: DataFrame, vocabulary: str, pattern: str, parts: int) -> DataFrame:
    """(block, ids): the ids of the blocks' words, packed as (word number steps, lengths, ids). Each distinct word is encoded once."""
    words = blocks.select("block", F.inline("words")).repartition(parts, "part").select("block", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known, ids, length = None, {}, array("I"), array("I")
        held, size = [], 0

        def out() -> pa.RecordBatch:
            nonlocal enc
            enc = enc or encoding_of(vocabulary, pattern)
            block = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            number = np.concatenate([h[1] for h in held])
            coded = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
            place = np.empty(len(coded.dictionary), np.int64)
            for k, w in enumerate(coded.dictionary.to_pylist()):
                at = known.get(w)
                if at is None:
                    own = enc.encode_ordinary(w)
                    known[w] = at = len(length)
                    length.append(len(own))
                    ids.extend(own)
                place[k] = at
            sizes = np.array(length, np.int64)
            start, own = np.cumsum(sizes) - sizes, place[np.asarray(coded.indices)]
            order = np.lexsort((number, block))
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1)).tolist()
            values, names, data = np.array(ids, np.uint32), [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = order[a:b]
                names.append(int(block[mine[0]]))
                data.append(pack([np.diff(number[mine], prepend=0), sizes[own[mine]], gather(values, start, sizes, own[mine])[0]]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["block", "ids"])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (steps_,), (lengths, raw) = unpack(data)
                held.append((block, np.cumsum(steps_), unpack_words(lengths, raw)))
                size += len(steps_)
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return words.mapInArrow(shared.lean(run), "block long, ids binary")


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, finish: Callable[[np.ndarray, np.ndarray], list[pa.Array]], schema: str, text_col: str = "text", drop_text: bool = True) -> DataFrame:
    """The columns of ``docs`` and those that ``finish`` makes of all ids of some texts and each text's end in them."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    shared.bound_batches(docs.sparkSession)
    kept = [c for c in shared.keep_columns(docs, [f.name for f in new]) if not (drop_text and c == text_col)]
    parts = shared.parts_of(docs, text_col, PART_BYTES)
    blocks = position_table(docs, kept, pattern, parts, text_col)
    ids = encode_words(blocks, vocabulary, pattern, parts)
    none = lambda c: F.lit(None).cast(blocks.schema[c].dataType).alias(c)
    both = blocks.select("block", "place", "rows", F.lit(None).cast("binary").alias("ids")).union(ids.select("block", none("place"), none("rows"), "ids"))
    both = both.repartition(parts, "block").sortWithinPartitions("block", F.col("ids").isNotNull())
    fields = StructType([f for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema] + list(new))
    arrow = to_arrow_schema(fields)

    def finished(head: tuple, got: list) -> Iterator[pa.RecordBatch]:
        rows, flat, ends = head
        number = np.concatenate([np.cumsum(g[0]) for g in got]) if got else np.zeros(0, np.int64)
        own_length = np.concatenate([g[1] for g in got]) if got else number
        values = np.concatenate([g[2] for g in got]).astype(np.uint32) if got else np.zeros(0, np.uint32)
        begin, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        begin[number], length[number] = np.cumsum(own_length) - own_length, own_length
        first = 0
        while first < len(ends):  # some texts at a time: a block's ids are never held at once, here or in the JVM
            base = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + POSITIONS, side="right")))
            tokens, end = gather(values, begin, length, flat[base : ends[last - 1]])
            columns = [rows.field(k + 1).slice(first, last - first) for k in range(len(kept))] + finish(tokens, np.concatenate([[0], end])[ends[first:last] - base])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, got = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(3)[k].is_valid:
                    got += unpack(batch.column(3)[k].as_py())
                    continue
                if head is not None:
                    yield from finished(head, got)
                flat, ends = next(unpack(shared.open_arrays(batch.column(1)[k].as_py())[0]["packed"].tobytes()))
                head, got = (batch.column(2)[k].values, flat, ends), []
        if head is not None:
            yield from finished(head, got)

    return both.mapInArrow(shared.lean(run), fields)


def digests(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lower-case hex SHA-256 of each run of ``values`` that ends at ``ends``."""
    raw, at, out = memoryview(np.ascontiguousarray(values).view(np.uint8)), 0, []
    for end in (ends * values.itemsize).tolist():
        out.append(hashlib.sha256(raw[at:end]).hexdigest())
        at = end
    return pa.array(out, pa.string())


def id_digests(vocabulary: str) -> Callable[[np.ndarray, np.ndarray], list[pa.Array]]:
    """``finish`` for n_tokens long, ids_sha256 string, decoded_sha256 string."""

    def finish(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        raw, at = decode(ids, vocabulary)
        return [pa.array(np.diff(ends, prepend=0), pa.int64()), digests(ids.astype("<u4"), ends), digests(raw, np.concatenate([[0], at])[ends])]

    return finish


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, and the SHA-256 of its ids (little-endian 32 bits) and of the decoded bytes; the text goes."""
    return encode_documents(docs, vocabulary, pattern, id_digests(vocabulary), "n_tokens long, ids_sha256 string, decoded_sha256 string", text_col)


def bpe_ids(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``token_ids`` array<int> and ``decoded`` (the text from the ids)."""

    def finish(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        raw, at = decode(ids, vocabulary)
        cuts = np.concatenate([[0], at])[np.concatenate([[0], ends])].tolist()
        back = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))), pa.array(back, pa.string())]

    return encode_documents(docs, vocabulary, pattern, finish, "token_ids array<int>, decoded string", text_col, drop_text=False)
