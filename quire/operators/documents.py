"""Documents as a column: the parse projection, its flat forms, and edits.

The kernels are sequential within one text and independent between texts, so they run as Arrow-batched pandas UDFs
in the scan's own tasks and add no shuffle. A null text gives a null result; an empty one is an empty document.
Texts nested too deeply to read give neither acceptance nor a code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from quire.functions import edits
from quire.functions.blocks import Block, Refused
from quire.functions.kernels import bound_batches
from quire.functions.naming import Document, NameReader, document, leaf_key, slug
from quire.operators.tables import busy


def _struct(**fields) -> StructType:
    return StructType([StructField(k, t) for k, t in fields.items()])


REF = _struct(node=ArrayType(IntegerType()), type=StringType())
DOC = _struct(
    accept=BooleanType(),
    refusal=StringType(),
    frontmatter=_struct(first=IntegerType(), last=IntegerType()),
    blocks=ArrayType(_struct(type=StringType(), start=IntegerType(), end=IntegerType())),
    leaves=ArrayType(_struct(node=ArrayType(IntegerType()), type=StringType(), content=StringType(), ktype=StringType(), key=StringType())),
    names=MapType(StringType(), _struct(is_region=BooleanType(), targets=ArrayType(REF))),
    slugs=MapType(StringType(), ArrayType(REF)),
)
EDIT = _struct(text=StringType(), refusal=StringType())
LEAVES = ("paragraph", "heading", "code_block", "html_block", "table", "thematic_break")


def ref(node: Block) -> dict:
    return {"node": list(node.path), "type": node.type}


def _leaf(node: Block) -> dict:
    ktype, key = leaf_key(node) or (None, None)
    return ref(node) | {"content": key if node.type == "table" else node.content, "ktype": ktype, "key": key}


def _described(doc: Document) -> dict:
    front = doc.frontmatter
    return {
        "accept": True,
        "refusal": None,
        "frontmatter": front and {"first": front[0] + 1, "last": front[1] + 1},
        "blocks": [{"type": b.type, "start": b.start + 1, "end": b.end + 1} for b in doc.root.children],
        "leaves": [_leaf(n) for n in doc.nodes if n.type in LEAVES],
        "names": {k: {"is_region": region, "targets": [ref(n) for n in bound]} for k, (region, bound) in doc.names.items()},
        "slugs": {k: [ref(n) for n in hits] for k, hits in doc.slugs.items()},
    }


def describe(text: str | None, check_links: bool = True) -> dict:
    """One row of the parse projection; lines are counted from 1."""
    row = dict.fromkeys(DOC.names)
    if text is None:
        return row
    try:
        return _described(document(text, check_links))
    except Refused as refused:
        return row | {"accept": False, "refusal": refused.code}


def parse(text: Column | str, check_links: bool = True) -> Column:
    """A text as a struct of its blocks, leaves, names and slugs, or of its refusal code."""
    bound_batches()

    @F.pandas_udf(DOC)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(t, check_links) for t in texts], columns=DOC.names, dtype=object)

    return run(text)


def leaves(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row a leaf, in document order."""
    others = [c for c in docs.columns if c != doc]
    return docs.select(*others, F.posexplode(F.col(doc)["leaves"]).alias("ord", "leaf")).select(*others, "ord", "leaf.*")


def resolve(doc: Column, name: Column) -> Column:
    """A marker's targets first, then the one heading that has the slug, else ``#REF!(name)``."""
    marker, heading = F.try_element_at(doc["names"], name), F.try_element_at(doc["slugs"], name)
    one = lambda targets: F.to_json(targets[0])
    found = F.when(marker["is_region"], F.to_json(F.struct(marker["targets"].alias("region")))).when(marker.isNotNull(), one(marker["targets"]))
    return found.when(F.size(heading) == 1, one(heading)).otherwise(F.concat(F.lit("#REF!("), name, F.lit(")")))


def names_of(pieces: DataFrame, document: str, order: list[str], piece: str) -> DataFrame:
    """(document, name, is_region, targets) of all names that documents resolve, one row a name.

    A document is its pieces in order, a blank line between two; null pieces are left out. They are read as they
    come, so a worker holds a document's names and one block, not its text. A refused document has no names.
    """
    bound_batches()
    keys = [F.col(f"`{c}`") for c in (document, *order, piece)]
    rows = busy(pieces.where(keys[-1].isNotNull()).select(*keys), document).sortWithinPartitions(*keys)
    kept = pieces.select(keys[0]).schema[0]
    schema = StructType([kept, *_struct(name=StringType(), is_region=BooleanType(), targets=ArrayType(REF)).fields])
    kinds = to_arrow_schema(schema)

    def found(key, reader: NameReader) -> Iterator[pa.RecordBatch]:
        names = iter(() if reader.finish() else reader.resolved())
        while some := list(islice(names, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([key] * len(some), *zip(*some, strict=True)), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, None
        for batch in batches:
            own = zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            for now, texts in groupby(own, key=lambda x: x[0]):
                text = "\n\n".join(t for _, t in texts)
                if reader is not None and now == key:
                    reader.feed("\n\n" + text)
                    continue
                if reader is not None:
                    yield from found(key, reader)
                key, reader = now, NameReader()
                reader.feed(text)
        if reader is not None:
            yield from found(key, reader)

    return rows.select(keys[0], *keys[1:]).mapInArrow(run, schema)


def target(is_region: Column, targets: Column, name: Column) -> Column:
    """What ``resolve`` gives for a row of ``names_of`` that was joined by name."""
    found = F.when(is_region, F.to_json(F.struct(targets.alias("region")))).when(is_region.isNotNull(), F.to_json(targets[0]))
    return found.otherwise(F.concat(F.lit("#REF!("), name, F.lit(")")))


def text_slug(text: Column | str) -> Column:
    """The full slug of a heading's content (every script); null if it has none."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else slug(t))

    return run(text)


def _edited(call: Callable[[], str]) -> tuple[str | None, str | None]:
    try:
        return call(), None
    except Refused as refused:
        return None, refused.code


def _edit(run: Callable[..., str], *columns: Column) -> Column:
    """A struct (text, refusal) for each row; null where the text is null."""
    bound_batches()

    @F.pandas_udf(EDIT)
    def apply(*series: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else _edited(lambda t=t, rest=rest: run(t, *rest)) for t, *rest in zip(*series, strict=True)]
        return pd.DataFrame(rows, columns=EDIT.names, dtype=object)

    return apply(*columns)


def _path(node) -> list[int] | None:
    return None if node is None else [int(k) for k in node]


def replace_block(text: Column, node: Column, source: Column) -> Column:
    return _edit(lambda t, n, s: edits.replace_block(t, _path(n) or [], s or ""), text, node, source)


def insert_block(text: Column, source: Column, before: Column | None = None, after: Column | None = None) -> Column:
    none = F.lit(None).cast("array<int>")
    return _edit(
        lambda t, s, b, a: edits.insert_block(t, s or "", _path(b), _path(a)), text, source, none if before is None else before, none if after is None else after
    )


def delete_block(text: Column, node: Column) -> Column:
    return _edit(lambda t, n: edits.delete_block(t, _path(n) or []), text, node)


def register(spark) -> None:
    """Make the kernels callable from SQL as ``parse_document`` and ``document_slug``."""

    @F.pandas_udf(DOC)
    def parse_document(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(t) for t in texts], columns=DOC.names, dtype=object)

    @F.pandas_udf(StringType())
    def document_slug(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else slug(t))

    spark.udf.register("parse_document", parse_document)
    spark.udf.register("document_slug", document_slug)
