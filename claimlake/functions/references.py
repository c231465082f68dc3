"""Character references of HTML as column expressions: each is read once, so what one gives is never read as another."""
from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
#: Names that are frequent, looked up first; a map is searched in its order.
_OFTEN = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;", "mdash;", "ndash;", "hellip;", "rsquo;", "lsquo;", "ldquo;", "rdquo;", "copy;", "middot;")
#: Numbers between 0x80 and 0x9f count as bytes of code page 1252.
_PAGE_1252 = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _names() -> Column:
    ordered = {**{name: html5[name] for name in _OFTEN}, **html5}
    return F.from_json(F.lit(json.dumps(ordered)), "map<string,string>")


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference: the replacement character beyond Unicode, nothing for control characters."""
    hexadecimal = reference.rlike("^&#[xX]")
    digits = F.regexp_replace(F.regexp_extract(reference, "&#[xX]?([0-9a-fA-F]+)", 1), "^0+(?=.)", "")
    code = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint"))
    paged = F.element_at(F.from_json(F.lit(json.dumps({str(n): c for n, c in _PAGE_1252.items()})), "map<string,string>"), code.cast("string"))
    known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    nothing = code.between(1, 8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | (code == 0xB) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    character = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
    return F.when(paged.isNotNull(), paged).when(known & nothing, "").otherwise(character)


def decoded(text: Column, open_names: bool = True) -> Column:
    """Numeric and named references as characters; unknown ones stay. ``open_names``: named ones also without their semicolon where HTML allows that."""
    shape = _REFERENCE if open_names else _REFERENCE.replace("[A-Za-z0-9]*;?)", "[A-Za-z0-9]*;)")
    marks = F.regexp_extract_all(text, F.lit(f"({shape})"), F.lit(1))
    character = lambda r: F.when(F.substring(r, 2, 1) == "#", _numbered(r)).otherwise(F.coalesce(F.element_at(_names(), F.substring(r, F.lit(2), F.length(r))), r))
    joined = F.array_join(F.zip_with(F.split(text, shape, -1), F.transform(marks, character), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)
