"""Scalar functions as Column builders: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from florilege.functions.kernels import WHITE_SPACE

#: Unicode White_Space, as a Java character class.
_WHITE = f"[{WHITE_SPACE}]"
#: Markdown markup that is blanked: heading marks, emphasis and code marks, link brackets and link targets.
_MARKUP = r"(?md)^#{1,6}[\t\n\f\r ]|[*_`]{1,3}|!?\[|\]\([^)]*\)"
_TOKEN = "[A-Za-z0-9_]+"
FNV_SEED, FNV_PRIME = 2166136261, 16777619
#: Extensions by MIME type; every other one is a variant of code.
MIME_TYPES = {
    "text/markdown": [".md", ".markdown"],
    "application/pdf": [".pdf"],
    "text/plain": [".txt"],
    "image/png": [".png"],
    "image/jpeg": [".jpg", ".jpeg"],
    "image/tiff": [".tiff", ".tif"],
    "image/bmp": [".bmp"],
}
CODE_MIME = "text/plain; variant=code"


def short_id(name: Column) -> Column:
    """The first 16 hex digits of SHA-256: ids of documents (from the path) and collections (from the name)."""
    return F.left(F.sha2(name, 256), F.lit(16))


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.left(F.sha1(F.concat(document_id, F.lit(":"), index.cast("string"))), F.lit(16))


def extension(path: Column) -> Column:
    """From the last dot of the last path element; empty without one. A name that begins with its only dot is all extension."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def mime_type(path: Column) -> Column:
    """By extension, with regard to case."""
    ext, out = extension(path), None
    for mime, known in MIME_TYPES.items():
        out = F.when(ext.isin(known), mime) if out is None else out.when(ext.isin(known), mime)
    return out.otherwise(CODE_MIME)


def lowered(text: Column) -> Column:
    """Lower case with a dotted capital I becoming a plain i."""
    return F.lower(F.translate(text, "İ", "i"))


def tokens(text: Column) -> Column:
    """All runs of ASCII letters, digits and underscores of the lowered text, in order."""
    return F.regexp_extract_all(lowered(text), F.lit(_TOKEN), F.lit(0))


def unique_tokens(text: Column) -> Column:
    """Distinct tokens by first occurrence."""
    return F.array_distinct(tokens(text))


def features(toks: Column) -> Column:
    """The tokens and, after them, each neighbouring pair joined by an underscore."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.concat(toks, F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n), lambda a, b: F.concat(a, F.lit("_"), b)))


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of an ASCII string, as a long."""
    bytes_ = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(bytes_, F.lit(FNV_SEED).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def unicode_trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_WHITE}+", ""), f"{_WHITE}+$", "")


def blank_markdown(text: Column) -> Column:
    """Markup replaced by as many spaces as it has bytes, so that offsets stay; NUL becomes a space too."""
    between = F.split(text, _MARKUP, -1)
    marks = F.regexp_extract_all(text, F.lit(_MARKUP), F.lit(0))
    spaces = F.transform(marks, lambda m: F.repeat(F.lit(" "), F.octet_length(m)))
    parts = F.zip_with(between, spaces, lambda t, s: F.concat(t, F.coalesce(s, F.lit(""))))
    return F.translate(F.array_join(parts, ""), "\x00", " ")


def snippet(text: Column, n: int = 220) -> Column:
    """The text, or its first n bytes and an ellipsis; a character that the cut splits becomes U+FFFD."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) > n, F.concat(cut, F.lit("…"))).otherwise(text)


def page_number(boundaries: Column, start: Column) -> Column:
    """1 + the boundaries at or before ``start``; null if there are none at all."""
    return F.when(F.size(boundaries) > 0, F.size(F.filter(boundaries, lambda x: x <= start)) + 1).cast("int")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def three_digits(score: Column) -> Column:
    return F.format_string("%.3f", score)
