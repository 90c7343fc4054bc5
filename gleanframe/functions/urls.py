"""URL and path scalars as Catalyst column expressions."""

from __future__ import annotations

import mimetypes
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanframe.functions.binding import constant, let
from gleanframe.functions.text import WS_EACH, blank_to_null

# RFC 3986 appendix B, with the scheme restricted to legal scheme characters.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"

# Fixed value: links that lead nowhere.
SKIPPED_PREFIXES = ("#", "javascript:", "mailto:", "tel:")
# Fixed value: schemes whose links can be relative to a page.
RELATIVE_SCHEMES = ("http", "https", "ftp", "file")

FILENAME_MAX = 160
COMPONENT_MAX = 100
URL_TOKEN_LENGTH = 12

# Content types of the document and image extensions that listings link to.
PINNED_CONTENT_TYPES = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".zip": "application/zip",
    ".rar": "application/vnd.rar",
    ".7z": "application/x-7z-compressed",
    ".txt": "text/plain",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".gif": "image/gif",
}
# Compression suffixes that hide the real extension, and one-word archives.
COMPRESSION_SUFFIXES = (".gz", ".Z", ".bz2", ".xz", ".br")
ARCHIVE_ALIASES = {".tgz": ".tar", ".taz": ".tar", ".tz": ".tar", ".tbz2": ".tar", ".txz": ".tar"}


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def url_scheme(url: Column) -> Column:
    return F.lower(url_part(url, 1))


def url_netloc(url: Column) -> Column:
    return url_part(url, 2)


def url_full_path(url: Column) -> Column:
    return url_part(url, 3)


def url_path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(url_full_path(url), ";[^/]*$", "")


def url_base(url: Column) -> Column:
    """The parts of a page URL that links are resolved against.

    Project it once per page and pass the column to :func:`join_url`, so that a page with
    many links is split once.
    """
    return F.struct(
        url.alias("url"),
        url_scheme(url).alias("scheme"),
        url_netloc(url).alias("netloc"),
        url_full_path(url).alias("path"),
        url_part(url, 4).alias("query"),
        url_part(url, 5).alias("fragment"),
    )


def _remove_dot_segments(path: Column) -> Column:
    parts = F.split(path, "/")
    # What is left so far is one text with a slash before every segment; an array would be copied each step.
    last = lambda acc: F.substring_index(acc, "/", -1)
    walked = F.aggregate(
        parts,
        F.lit(""),
        lambda acc, s: F.when(s == "..", F.left(acc, F.length(acc) - F.length(last(acc)) - 1))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.lit("/"), s)),
    )
    ends_open = F.element_at(parts, -1).isin(".", "..")
    return F.substr(F.when(ends_open, F.concat(walked, F.lit("/"))).otherwise(walked), F.lit(2))


def _merge_paths(base_path: Column, path: Column) -> Column:
    # A relative path is joined without doubled slashes; a rooted one is taken as it is.
    relative = F.regexp_replace(
        F.concat(F.regexp_replace(base_path, "[^/]*$", ""), path), "(?<=.)/{2,}", "/"
    )
    return let(
        F.when(path.startswith("/"), path).otherwise(relative),
        lambda p: F.coalesce(
            blank_to_null(F.when(p.rlike(_DOT_SEGMENT), _remove_dot_segments(p)).otherwise(p)),
            F.lit("/"),
        ),
    )


def _assemble(parts: Column) -> Column:
    """URL text of a struct of parts; empty parts leave no mark."""

    def marked(prefix: str, x: Column, suffix: str = "") -> Column:
        return F.when(x != "", F.concat(F.lit(prefix), x, F.lit(suffix))).otherwise(F.lit(""))

    netloc, path = parts["netloc"], parts["path"]
    unrooted = (netloc != "") & (path != "") & ~path.startswith("/")
    return F.concat(
        marked("", parts["scheme"], ":"),
        marked("//", netloc),
        F.when(unrooted, F.lit("/")).otherwise(F.lit("")),
        path,
        marked("?", parts["query"]),
        marked("#", parts["fragment"]),
    )


def join_url(base: Column, href: Column) -> Column:
    """Absolute form of a page link, or null for blank, fragment and script links.

    ``base`` is a :func:`url_base` struct.
    """
    value = F.btrim(href, F.lit(WS_EACH))
    skipped = "^(?:$|" + "|".join(SKIPPED_PREFIXES) + ")"

    def resolve(link: Column) -> Column:
        foreign = (link["scheme"] != "") & (
            (link["scheme"] != base["scheme"]) | ~link["scheme"].isin(*RELATIVE_SCHEMES)
        )
        own_host = link["netloc"] != ""
        own_path = own_host | (link["path"] != "")
        path = (
            F.when(own_host, link["path"])
            .when(own_path, _merge_paths(base["path"], link["path"]))
            .otherwise(base["path"])
        )
        query = F.when(own_path | (link["query"] != ""), link["query"]).otherwise(base["query"])
        joined = F.struct(
            base["scheme"].alias("scheme"),
            F.when(own_host, link["netloc"]).otherwise(base["netloc"]).alias("netloc"),
            path.alias("path"),
            query.alias("query"),
            link["fragment"].alias("fragment"),
        )
        return F.when(foreign, link["url"]).otherwise(let(joined, _assemble))

    return let(
        F.when(href.isNotNull(), value),
        lambda v: F.when(
            v.isNotNull() & ~v.rlike(skipped),
            let(url_base(reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), "\t\r\n", v)).withField("url", v), resolve),
        ),
    )


def absolute_url(page_url: Column, href: Column) -> Column:
    return join_url(url_base(page_url), href)


def percent_decode(x: Column) -> Column:
    """UTF-8 percent-decoding that keeps ``+`` and malformed escapes as they are."""

    def decode(v: Column) -> Column:
        escaped = F.regexp_replace(
            F.replace(v, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"
        )
        return F.when(F.contains(v, F.lit("%")), F.try_url_decode(escaped)).otherwise(v)

    return let(x, decode)


def filename_from_url(url: Column, fallback: str = "attachment") -> Column:
    parts = F.filter(
        F.split(percent_decode(url_path(url)), "/"), lambda s: (s != "") & (s != ".")
    )
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(fallback))


def safe_filename(x: Column, fallback: str = "attachment") -> Column:
    """Last path component with everything but letters, digits, ``_``, ``.`` and ``-`` replaced."""
    slashed = F.replace(percent_decode(x), F.lit("\\"), F.lit("/"))
    last = F.regexp_extract(slashed, "(?s)([^/]*)$", 1)
    name = F.btrim(F.regexp_replace(last, r"[^\p{L}\p{N}_.-]+", "-"), F.lit(".- "))
    return F.left(
        let(name, lambda n: F.when(n == "", F.lit(fallback)).otherwise(n)), F.lit(FILENAME_MAX)
    )


def safe_component(x: Column, fallback: str = "item") -> Column:
    name = F.replace(safe_filename(x, fallback), F.lit("."), F.lit("_"))
    return F.left(name, F.lit(COMPONENT_MAX))


def id_from_url(url: Column) -> Column:
    """Last non-empty path segment, else the URL itself."""
    parts = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), url)


def content_type_by_extension() -> dict[str, str]:
    """Extension table: the language's own default table with the pinned types on top."""
    table = dict(mimetypes.MimeTypes(filenames=()).types_map[True])
    table.update(PINNED_CONTENT_TYPES)
    return table


def content_type_for(filename: Column) -> Column:
    """Content type by extension, null if unknown; a compression suffix is looked through."""
    extension = r"^\.*[^.].*?(\.[^.]*)$"
    packed = r"(?s)^(\.*[^.].*)(?:" + "|".join(s.replace(".", r"\.") for s in COMPRESSION_SUFFIXES) + ")$"
    inner = F.when(filename.rlike(packed), F.regexp_extract(filename, packed, 1)).otherwise(filename)
    suffix = F.lower(F.regexp_extract(inner, "(?s)" + extension, 1))
    types = content_type_by_extension()
    types.update({alias: types[real] for alias, real in ARCHIVE_ALIASES.items()})
    return F.try_element_at(constant(types, "map<string,string>"), suffix)


def attachment_path(root: Column, source: Column, external_id: Column, url: Column, filename: Column) -> Column:
    """Where the file of one attachment lives below ``root``."""
    name = safe_filename(F.coalesce(blank_to_null(filename), filename_from_url(url)))
    token = F.left(F.sha1(url.cast("binary")), F.lit(URL_TOKEN_LENGTH))
    return F.concat_ws(
        "/", root, safe_component(source), safe_component(external_id), F.concat(token, F.lit("-"), name)
    )


def _form_decode(x: Column) -> Column:
    return F.coalesce(
        F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")), x
    )


def _form_encode(x: Column) -> Column:
    encoded = F.url_encode(x)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def cursor_query_url(url: Column, since: Column) -> Column:
    """List URL asking the portal for records published from the UTC day of ``since``.

    Other parameters stay in place; of a repeated one the last value is kept. A null
    ``since`` leaves the URL alone.
    """
    items = F.filter(F.split(url_part(url, 4), "&"), lambda s: s != "")
    pairs = F.transform(
        items,
        lambda s: F.struct(
            _form_decode(F.substring_index(s, "=", 1)).alias("k"),
            _form_decode(F.regexp_extract(s, "^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )
    day = F.date_format(F.to_utc_timestamp(since, F.current_timezone()), "dd.MM.yyyy")
    first = F.struct(F.lit("publishDateFrom").alias("k"), day.alias("v"))
    until = F.struct(F.lit("publishDateTo").alias("k"), F.lit("").alias("v"))
    has_until = F.exists(pairs, lambda p: p["k"] == "publishDateTo")
    all_pairs = F.concat(
        pairs, F.array(first), F.when(has_until, F.slice(F.array(until), 1, 0)).otherwise(F.array(until))
    )
    keys = F.array_distinct(F.transform(all_pairs, lambda p: p["k"]))
    encoded = F.transform(
        keys,
        lambda k: F.concat(
            _form_encode(k),
            F.lit("="),
            _form_encode(F.element_at(F.filter(all_pairs, lambda p: p["k"] == k), -1)["v"]),
        ),
    )
    parts = url_base(url).withField("query", F.array_join(encoded, "&"))
    return F.when(since.isNull(), url).otherwise(let(parts, _assemble))
