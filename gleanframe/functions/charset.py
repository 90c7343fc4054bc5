"""The charset of page bytes, and their text, as column expressions.

A page's charset is found in the order of the HTML standard: a byte order mark, then the
``charset`` parameter of its Content-Type header, then a ``<meta charset>`` or ``<meta
http-equiv="Content-Type" content="...; charset=...">`` in its first ``PRESCAN_BYTES`` bytes, else
UTF-8. Labels are matched without regard to case and surrounding space; a label that names no
charset known here counts as absent, so the next way decides.

Decoding stays in the JVM: UTF-8 and UTF-16 by ``decode``; single-byte charsets by reading the
bytes as ISO-8859-1 (byte b becomes code point b) and translating code points 128 to 255 through
the charset's table, which Python's codec gives when the module loads. A byte a charset leaves
undefined keeps the code point of its value, as browsers do for windows-1252. A mark is not part of
the text. Malformed UTF-8 becomes U+FFFD; malformed UTF-16 (an odd byte count, a lone surrogate)
is an error of the query. Null bytes give null text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESCAN_BYTES = 1024

# Labels pages use for each charset, by the name it is decoded as here.
LABELS = {
    "utf-8": ("utf-8", "utf8", "unicode-1-1-utf-8"),
    "utf-16le": ("utf-16le", "utf-16"),
    "utf-16be": ("utf-16be",),
    "windows-1251": ("windows-1251", "cp1251", "x-cp1251", "win-1251"),
    "windows-1252": ("windows-1252", "cp1252", "iso-8859-1", "latin1", "l1", "us-ascii", "ascii"),
    "koi8-r": ("koi8-r", "koi8r", "koi8", "cskoi8r"),
    "iso-8859-5": ("iso-8859-5", "iso8859-5", "cyrillic"),
    "ibm866": ("ibm866", "cp866", "866"),
}
# The Python codec of each single-byte charset.
CODECS = {"windows-1251": "cp1251", "windows-1252": "cp1252", "koi8-r": "koi8_r", "iso-8859-5": "iso8859_5", "ibm866": "cp866"}

HIGH = "".join(map(chr, range(128, 256)))


def _upper_half(codec: str) -> str:
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


TABLES = {name: _upper_half(codec) for name, codec in CODECS.items()}
_PAIRS = [x for name, labels in LABELS.items() for label in labels for x in (label, name)]
_PARAMETER = r"""(?i)charset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)"""
_META = r"""(?i)<meta[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9._:-]+)"""


def charset_name(label: Column) -> Column:
    """The charset a label names, or null for none known here."""
    return F.element_at(F.create_map(*map(F.lit, _PAIRS)), F.lower(F.trim(label)))


def bom_charset(content: Column) -> Column:
    head = F.hex(content.substr(F.lit(1), F.lit(3)))
    return (
        F.when(head.startswith("EFBBBF"), F.lit("utf-8"))
        .when(head.startswith("FFFE"), F.lit("utf-16le"))
        .when(head.startswith("FEFF"), F.lit("utf-16be"))
    )


def header_charset(headers: Column) -> Column:
    """The charset of a Content-Type header in a map of headers (names in any case)."""
    types = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "content-type"))
    label = F.regexp_extract(F.try_element_at(types, F.lit(1)), _PARAMETER, 1)
    return charset_name(F.nullif(label, F.lit("")))


def meta_charset(content: Column) -> Column:
    head = F.decode(content.substr(F.lit(1), F.lit(PRESCAN_BYTES)), "ISO-8859-1")
    return charset_name(F.nullif(F.regexp_extract(head, _META, 1), F.lit("")))


def page_charset(content: Column, headers: Column | None = None) -> Column:
    ways = [bom_charset(content)]
    if headers is not None:
        ways.append(header_charset(headers))
    return F.coalesce(*ways, meta_charset(content), F.lit("utf-8"))


def decode_as(content: Column, charset: Column) -> Column:
    """Text of bytes in a charset named as in ``LABELS``; a leading mark of it is dropped."""
    mark = bom_charset(content)
    body = F.when(mark == charset, content.substr(F.when(mark == "utf-8", 4).otherwise(3), F.lit(1 << 30))).otherwise(content)
    latin = F.decode(content, "ISO-8859-1")
    out = (
        F.when(charset == "utf-16le", F.decode(body, "UTF-16LE"))
        .when(charset == "utf-16be", F.decode(body, "UTF-16BE"))
    )
    for name, table in TABLES.items():
        out = out.when(charset == name, F.translate(latin, HIGH, table))
    return out.otherwise(F.make_valid_utf8(body.cast("string")))


def page_text(content: Column, headers: Column | None = None) -> Column:
    """The text of page bytes in the charset they declare (see the module's text)."""
    return decode_as(content, page_charset(content, headers))
