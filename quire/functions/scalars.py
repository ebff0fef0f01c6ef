"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFLICT = r"(?m)^(?:(?:<{7,}|>{7,}|\|{7,})(?: .*)?|={7,})\r?$"


def blob_id(text: Column, fmt: str = "sha1") -> Column:
    """The object id (``sha1`` or ``sha256``) of a blob: header with its byte length, a zero byte, the bytes."""
    data = F.encode(text, "UTF-8")
    whole = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data)
    return F.sha1(whole) if fmt == "sha1" else F.sha2(whole, 256)


def annotation_data(text: Column) -> Column:
    """Percent first, then line ends."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def annotation_property(text: Column) -> Column:
    return F.replace(F.replace(annotation_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of all occurrences, overlapping ones too."""
    n, m = F.length(text), F.length(needle)
    starts = F.when((n >= m) & (m > 0), F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, lambda i: F.substr(text, i, m) == needle), lambda i: i - 1)


def collapse(text: Column) -> Column:
    """Runs of tab, line feed, return and space become one space; a no-break space stays."""
    return F.regexp_replace(text, "[\\t\\n\\r ]+", " ")


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\t\\n\\r ]+"), lambda x: x != "")


def frontmatter_end(text: Column) -> Column:
    """Code points up to the end of a leading fence, -1 without one."""
    found = F.length(F.regexp_extract(text, r"(?s)^---\n.*?\n---[ \t]*(?:\n|$)", 0))
    return F.when(found > 0, found).otherwise(-1)


def has_conflict(text: Column) -> Column:
    """A column-0 run of 7 or more < > | before a space or line end, or of = alone on its line."""
    return text.rlike(CONFLICT)


def ascii_slug(text: Column) -> Column:
    """Slug of a heading in ASCII: null if it holds markup or nothing remains."""
    slug = F.replace(F.regexp_replace(F.lower(text), "[^a-z0-9 _-]", ""), F.lit(" "), F.lit("-"))
    return F.when(text.rlike(r"[*_`\[<&]") | (slug == ""), None).otherwise(slug)


def resolve_path(folder: Column, path: Column) -> Column:
    """``path`` relative to ``folder``: ``.`` and ``..`` are walked, empty segments stay.

    Null if absolute, with a colon in the first segment, or above the root.
    """
    start = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    step = lambda at, p: (
        F.when(at.isNull(), at)
        .when(p == ".", at)
        .when((p == "..") & (F.size(at) == 0), F.lit(None).cast("array<string>"))
        .when(p == "..", F.slice(at, 1, F.size(at) - 1))
        .otherwise(F.concat(at, F.array(p)))
    )
    walked = F.aggregate(F.split(path, "/"), start, step)
    return F.when(path.startswith("/") | F.contains(F.substring_index(path, "/", 1), F.lit(":")), None).otherwise(F.array_join(walked, "/"))


def exceeds(l1: Column, t1: Column, l2: Column, t2: Column) -> Column:
    """Whether 2 l1 / t1 beats 2 l2 / t2 by 0.15, in whole numbers."""
    wide = [c.cast("decimal(12,0)") for c in (l1, t1, l2, t2)]
    return 40 * wide[0] * wide[3] - 40 * wide[2] * wide[1] >= 3 * wide[1] * wide[3]
