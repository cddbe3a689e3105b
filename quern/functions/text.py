"""Names, ids and captions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed sets of characters.
ASCENDERS, DESCENDERS, TALL_SIGNS = "bdfhijklt", "gjpqy,", "()[]\"'"
TYPES, SUFFIXES = {"image/jpeg": ".jpg", "image/png": ".png"}, (".jpg", ".jpeg", ".png")
#: Fixed sentences of a package's notes.
COVERED, LEFT_OUT, COMPLETE = " requested characters", " character(s) need a clearer rewrite and were left out of this font.", "Every requested character was included."


def codepoint(c: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))


def category(c: Column) -> Column:
    return F.when(c.rlike("^[A-Z]$"), "uppercase").when(c.rlike("^[a-z]$"), "lowercase").when(c.rlike("^[0-9]$"), "digit").otherwise("punctuation")


def is_tall(c: Column, kind: Column) -> Column:
    return kind.isin("uppercase", "digit") | ((kind == "lowercase") & c.isin(*ASCENDERS)) | ((kind == "punctuation") & c.isin(*TALL_SIGNS))


def is_descender(c: Column) -> Column:
    return c.isin(*DESCENDERS)


def postscript_name(family: Column, style: Column, fallback: str = "Font") -> Column:
    def kept(s):
        return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")

    return F.concat_ws("-", F.coalesce(F.nullif(kept(family), F.lit("")), F.lit(fallback)), kept(style))


def is_job_id(s: Column) -> Column:
    return s.rlike(r"^[0-9a-f]{32}\z")


def is_template_id(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9_]+\z")


def without_prefix(s: Column, prefix: str) -> Column:
    rest = F.substring(s, len(prefix) + 1, 1 << 30)
    return F.when(s.startswith(prefix) & (F.length(s) > len(prefix)), rest).otherwise(s)


def type_extension(kind: Column) -> Column:
    """The extension of an accepted content type, else null."""
    out = F.lit(None).cast("string")
    for name, extension in TYPES.items():
        out = F.when(kind == name, extension).otherwise(out)
    return out


def suffix_extension(name: Column) -> Column:
    """A file name's own extension in lower case if it is one of SUFFIXES, else .jpg."""
    own = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return F.when(own.isin(*SUFFIXES), own).otherwise(".jpg")


def coverage(good: Column, total: Column) -> Column:
    return F.concat(good.cast("string"), F.lit(" of "), total.cast("string"), F.lit(COVERED))


def coverage_note(bad: Column) -> Column:
    return F.when(bad > 0, F.concat(bad.cast("string"), F.lit(LEFT_OUT))).otherwise(COMPLETE)


def listed(value: Column) -> Column:
    """The parts of a comma-separated setting, trimmed, without empty ones; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def json_field(document: Column, key: str, default: str) -> Column:
    """A field of a JSON document as text, or the default where the document or the field is missing."""
    return F.coalesce(F.get_json_object(document, f"$.{key}"), F.lit(default))


def megabytes(n: Column) -> Column:
    """With one decimal, ties to even (format_string alone rounds them up). A whole number of bytes gives an exact quotient."""
    return F.format_string("%.1f", F.bround(n / 1048576, 1))
