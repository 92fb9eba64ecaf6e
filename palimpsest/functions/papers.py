"""Parts of a paper's plain text as native columns: sections, closing statements, table captions and formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings that stand alone on a line.
HEADINGS = ["abstract", "introduction", "background", r"methods?", r"materials?\s+and\s+methods?", r"results?", "discussion", r"conclusions?", r"references?", r"\d+\.?\s+\w+"]
# How each closing statement begins, its least and greatest length, and the words that end it.
STATEMENTS = {
    "acknowledgements": (r"acknowledge?ments?\s*", 50, 2000, "funding|references|conflicts"),
    "funding": (r"(?:funding|financial|grant)[^:]*", 30, 1500, "acknowledge|references|conflicts"),
    "conflicts": (r"(?:conflict|competing\s+interests?|declaration)[^:]*", 20, 500, "acknowledge|funding|references"),
    "author_contributions": (r"author\s+contrib[^:]*", 50, 1500, "acknowledge|funding|conflicts|references"),
}
_HEAD, _END = "\x1e", "\x1f"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sections(text: Column | str) -> Column:
    """(section, text) in order; what precedes the first heading belongs to none. No heading or null: no section.

    Headings are marked by two control characters, which the text itself loses first, and the text is split at them.
    """
    plain = F.translate(F.coalesce(_col(text), F.lit("")), _HEAD + _END, "")
    marked = F.regexp_replace(plain, rf"(?i)(?:^|\n)\s*({'|'.join(HEADINGS)})[^\S\n]*(?=\n)", f"{_HEAD}$1{_END}")
    parts = F.split(marked, _HEAD)
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.struct(_trim(F.substring_index(p, _END, 1)).alias("section"), _trim(F.substring_index(p, _END, -1)).alias("text")))


def statement(text: Column | str, kind: str) -> Column:
    """The first acknowledgements, funding, conflicts or author contributions of a text; null if it has none."""
    begin, least, most, stop = STATEMENTS[kind]
    return F.nullif(_trim(F.regexp_extract(_col(text), rf"(?is){begin}[:\n](.{{{least},{most}}}?)(?={stop}|\z)", 1)), F.lit(""))


def table_captions(text: Column | str) -> Column:
    """(number, caption) of each mention of a table that is followed by text on its line."""
    found = F.regexp_extract_all(_col(text), F.lit(r"(?:Table|TABLE)\s*\d+[.:]?\s*[^\n]+"), F.lit(0))
    head = r"^(?:Table|TABLE)\s*(\d+)[.:]?\s*"
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, head, 1).cast("int").alias("number"), _trim(F.regexp_replace(m, head, "")).alias("caption")))


def formulas(text: Column | str, display: bool = True) -> Column:
    """(raw, normalised) of formulas between double dollar signs, or between single ones; normalised: lower, no white space."""
    pattern = r"(?s)\$\$(.+?)\$\$" if display else r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"
    return F.transform(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1)), lambda m: F.struct(_trim(m).alias("raw"), F.lower(F.regexp_replace(m, r"\s+", "")).alias("normalised")))


def table_text(rows: Column) -> Column:
    """Rows of cells as lines of ``a | b``, white space inside a cell to one space; null for fewer than two rows."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: _trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))), " | "))
    return F.when(F.size(rows) >= 2, F.array_join(lines, "\n"))
