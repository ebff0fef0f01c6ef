"""Token-ID / binary output: length-delimited records with masked checksums and an offset index.

File format (the public length-delimited record format): for each record a little-endian unsigned
64-bit length, the masked CRC-32C of those eight bytes, the payload, and the payload's masked
CRC-32C. A payload is one document: its id (signed 64-bit), whether it has one (one byte), the bytes
an id takes (one byte, 2 or 4), six zero bytes, then the token ids. Beside ``part-N.rec`` lies
``part-N.idx``: the offset of every record, so a shuffled reader seeks straight to any of them.

Null texts are empty (a document of the end id alone), a null document id sorts first and is read
back as null, repeated rows give repeated records, an empty table gives no file. Ids must be integers:
the order of the file is theirs. A text may hold the string of an added token, which is then one id.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.chunks import cut_chunks, gather, words_of
from quire.llm.crc32c import crc32c, masked
from quire.llm.words import steps

END_ID = 2
#: The letter of a space in the byte alphabet of byte-level BPE.
SPACE = "\u0120"
#: Distinct words whose ids a worker keeps between steps.
CACHE = 700_000
#: Bytes of text that a worker encodes at a time, and bytes of text in a file.
STEP = 8 << 20
PART_BYTES = 256 << 20


class WordEncoder:
    """Encodes each distinct word once with the tokenizers library and keeps its ids.

    For a byte-level BPE without normaliser the library's model takes a text word by word, a word
    being one match of the public pattern in its byte alphabet. A text that holds the string of an
    added token, and every text under another kind of tokenizer, is given to the library whole.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_word = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.find, self.model = regex.compile(public_tokenizers.PATTERN).findall, self.tokenizer.model
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.length = array("I"), array("I")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and each text's end in them."""
        whole = np.full(len(texts), not self.by_word)
        for content in self.added if self.by_word else []:
            whole |= np.asarray(pc.fill_null(pc.match_substring(texts, content), False).cast(pa.uint8())).astype(bool)
        if not whole.any():
            return self._by_word(texts)
        ids = iter([e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts.filter(pa.array(whole)), "").to_pylist(), add_special_tokens=False)])
        flat, ends = self._by_word(texts.filter(pa.array(~whole))) if not whole.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        rest = iter(np.split(flat, ends[:-1]) if len(ends) else [])
        each = [np.array(next(ids), np.uint32) if w else next(rest) for w in whole.tolist()]
        return np.concatenate(each), np.cumsum([len(x) for x in each], dtype=np.int64)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A chunk that is a known word is looked up once; others by their words. Chunks get their ids, then texts those of their chunks."""
        code, ends, distinct = cut_chunks(texts)
        if len(self.known) > CACHE:
            self.clear()
        get, find, numbers, count = self.known.get, self.find, [], []
        for chunk in distinct:
            k = get(chunk)
            if k is not None:
                numbers.append(k)
                count.append(1)
                continue
            words = words_of(chunk, find)
            count.append(len(words))
            for word in words:
                k = get(word)
                numbers.append(self._learn(word) if k is None else k)
        length = np.array(self.length, np.int64)
        ids, end = gather(np.array(self.ids, np.uint32), np.cumsum(length) - length, length, np.array(numbers, np.int64))
        last = np.concatenate([[0], end])[np.cumsum(count, dtype=np.int64)]
        begin = np.concatenate([np.zeros(min(1, len(last)), np.int64), last[:-1]])
        flat, end = gather(ids, begin, last - begin, code)
        return flat, np.concatenate([[0], end])[ends]

    def _learn(self, word: str) -> int:
        letters = word.replace(" ", SPACE) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(byte_alphabet())
        own = [t.id for t in self.model.tokenize(letters)]
        k = self.known[word] = len(self.length)
        self.length.append(len(own))
        self.ids.extend(own)
        return k


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> WordEncoder:
    """A worker's encoder; its words serve all tasks that the worker runs."""
    return WordEncoder(vocabulary)


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """Bytes to the letters of byte-level BPE: printable Latin-1 stands for itself, the rest follows U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def _width(flat: np.ndarray) -> int:
    return 2 if not len(flat) or flat.max() < 1 << 16 else 4


def frame(doc_ids: list, flat: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Framed records of documents, and each record's size."""
    width, begin = _width(flat), np.concatenate([[0], ends[:-1]])
    body = flat.astype(f"<u{width}").tobytes()
    payloads = [
        (0 if i is None else i).to_bytes(8, "little", signed=True) + bytes((i is not None, width)) + bytes(6) + body[a * width : b * width]
        for i, a, b in zip(doc_ids, begin.tolist(), ends.tolist(), strict=True)
    ]
    size = np.array([len(p) for p in payloads], np.int64)
    heads = size.astype("<u8")
    at = np.arange(len(payloads))
    head_sums = masked(crc32c(heads.view(np.uint8), at * 8, np.full(len(at), 8))).astype("<u4")
    data = np.frombuffer(b"".join(payloads), np.uint8)
    sums = masked(crc32c(data, np.cumsum(size) - size, size)).astype("<u4")
    out = []
    for k, p in enumerate(payloads):
        out += [heads[k].tobytes(), head_sums[k].tobytes(), p, sums[k].tobytes()]
    return b"".join(out), size + 16


def parse(raw: np.ndarray, offsets: np.ndarray) -> tuple[list, list[np.ndarray]]:
    """Document ids and token ids of the records at ``offsets``; raises on a wrong checksum."""
    heads = np.ascontiguousarray(np.stack([raw[o : o + 12] for o in offsets.tolist()]))
    size = heads[:, :8].copy().view("<u8")[:, 0].astype(np.int64)
    at = np.arange(len(offsets))
    good = masked(crc32c(np.ascontiguousarray(heads[:, :8]).reshape(-1), at * 8, np.full(len(at), 8))) == heads[:, 8:].copy().view("<u4")[:, 0]
    if not good.all():
        raise ValueError("a record's length does not match its checksum")
    tails = np.stack([raw[o : o + 4] for o in (offsets + 12 + size).tolist()]).view("<u4")[:, 0]
    if not (masked(crc32c(raw, offsets + 12, size)) == tails).all():
        raise ValueError("a record's payload does not match its checksum")
    ids, tokens = [], []
    for o, n in zip(offsets.tolist(), size.tolist(), strict=True):
        p = raw[o + 12 : o + 12 + n]
        ids.append(int.from_bytes(p[:8].tobytes(), "little", signed=True) if p[8] else None)
        tokens.append(p[16:].view(f"<u{int(p[9])}"))
    return ids, tokens


class _Out:
    """A file of the shared store under a temporary name until it is whole."""

    def __init__(self, uri: str):
        import os
        import uuid

        self.path, self.name = shared.local_path(uri), uri
        if self.path is not None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.part = f"{self.path}.{uuid.uuid4().hex}.part"
            self.file = open(self.part, "wb")
        else:
            from pyarrow import fs

            self.store, self.path_there = fs.FileSystem.from_uri(uri)
            self.store.create_dir(os.path.dirname(self.path_there), recursive=True)
            self.part = f"{self.path_there}.{uuid.uuid4().hex}.part"
            self.file = self.store.open_output_stream(self.part)

    def done(self) -> None:
        import os

        self.file.close()
        if self.path is not None:
            os.replace(self.part, self.path)
        else:
            self.store.move(self.part, self.path_there)


def _bytes_of(uri: str) -> np.ndarray:
    path = shared.local_path(uri)
    if path is not None:
        return np.memmap(path, np.uint8, mode="r")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), np.uint8)


def full(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of batches that take ``most`` bytes together: fewer, larger steps meet fewer distinct chunks in all."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))


def write_records(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, parts: int | None = None) -> list[tuple[int, int, int]]:
    """Encode all documents and write them in ascending id order; (part, records, tokens) per file.

    One range shuffle orders the documents; ties of the id are ordered by text, equal rows by their
    place in the input, so a hot id is spread over ranges. Only the list of files comes back.
    """
    spark = docs.sparkSession
    shared.bound_batches(spark)
    shared.integer_id(docs, id_col)
    n = parts or shared.parts_of(docs, text_col, PART_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("x"))
    rows = rows.select("i", "x", F.xxhash64("x").alias("h"), F.monotonically_increasing_id().alias("m"))
    rows = rows.repartitionByRange(n, "i", "h", "m").sortWithinPartitions("i", "h", "m").select("i", "x")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, out = TaskContext.get().partitionId(), None, None
        records = tokens = 0
        offsets, at = [], 0
        for some in full(batches, STEP):
            for ids, texts in steps(*some, STEP):
                if encoder is None:
                    encoder, out = encoder_of(vocabulary), _Out(f"{folder}/part-{part:05d}.rec")
                flat, ends = encoder.encode(texts)
                flat = np.insert(flat, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                data, sizes = frame(ids.to_pylist(), flat, ends)
                out.file.write(data)
                offsets.append(at + np.cumsum(sizes) - sizes)
                at, records, tokens = at + len(data), records + len(sizes), tokens + len(flat)
        if out is not None:
            out.done()
            index = _Out(f"{folder}/part-{part:05d}.idx")
            index.file.write(np.concatenate(offsets).astype("<u8").tobytes())
            index.done()
            yield pa.RecordBatch.from_pylist([{"part": part, "records": records, "tokens": tokens}], schema=pa.schema([("part", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64())]))

    return sorted(tuple(r) for r in rows.mapInArrow(shared.lean(write), "part int, records long, tokens long").collect())


def read_records(spark: SparkSession, folder: str, files: list[tuple[int, int, int]], batch: int = 1000) -> DataFrame:
    """Read files back through their index: doc_id, start, n_tokens, ids_crc32 per record."""
    before, plan = 0, []
    for part, _, tokens in files:
        plan.append((part, before))
        before += tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not plan:
        return spark.createDataFrame([], schema)
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(plan, len(plan)), "part int, before long")
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for job in rows.to_pylist():
                name, start = f"{folder}/part-{job['part']:05d}", job["before"]
                raw, offsets = _bytes_of(f"{name}.rec"), _bytes_of(f"{name}.idx").view("<u8").astype(np.int64)
                for k in range(0, len(offsets), batch):
                    ids, tokens = parse(raw, offsets[k : k + batch])
                    n = np.array([len(t) for t in tokens], np.int64)
                    crc = [zlib.crc32(t.astype("<u4").tobytes()) for t in tokens]
                    begin = start + np.cumsum(n) - n
                    start += int(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begin), pa.array(n), pa.array(crc, pa.int64())], schema=kind)

    return jobs.mapInArrow(shared.lean(read), schema)


def token_records(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode, write and read back: per document its place among all ids, its ids' count and CRC-32."""
    spark = docs.sparkSession
    folder = shared.new_folder(spark, "records")
    files = write_records(docs, folder, vocabulary, id_col, text_col, end_id)
    return read_records(spark, folder, files)
