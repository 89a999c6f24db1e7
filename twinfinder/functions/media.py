"""Content types and media attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN_DURATION = -10.0

# Leading bytes (offset, hex) of common formats. All parts of an entry must match.
MAGIC = [
    ("image/png", [(0, "89504E470D0A1A0A")]),
    ("image/jpeg", [(0, "FFD8FF")]),
    ("image/gif", [(0, "47494638")]),
    ("image/bmp", [(0, "424D")]),
    ("image/tiff", [(0, "49492A00")]),
    ("image/tiff", [(0, "4D4D002A")]),
    ("image/webp", [(0, "52494646"), (8, "57454250")]),
    ("audio/vnd.wave", [(0, "52494646"), (8, "57415645")]),
    ("video/x-msvideo", [(0, "52494646"), (8, "41564920")]),
    ("audio/mpeg", [(0, "494433")]),
    ("audio/x-flac", [(0, "664C6143")]),
    ("audio/vorbis", [(0, "4F676753")]),
    ("video/mp4", [(4, "66747970")]),
    ("video/x-matroska", [(0, "1A45DFA3")]),
    ("application/pdf", [(0, "255044462D")]),
    ("application/zip", [(0, "504B0304")]),
    ("application/gzip", [(0, "1F8B")]),
]

# Content types by file suffix, used when no leading bytes match.
SUFFIXES = {
    "avi": "video/x-msvideo",
    "bmp": "image/bmp",
    "csv": "text/csv",
    "flac": "audio/x-flac",
    "gif": "image/gif",
    "gz": "application/gzip",
    "htm": "text/html",
    "html": "text/html",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "json": "application/json",
    "md": "text/x-web-markdown",
    "mkv": "video/x-matroska",
    "mov": "video/quicktime",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "ogg": "audio/vorbis",
    "pdf": "application/pdf",
    "png": "image/png",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "txt": "text/plain",
    "wav": "audio/vnd.wave",
    "webp": "image/webp",
    "xml": "application/xml",
    "zip": "application/zip",
}

# Kept attribute -> metadata names, the first present one wins.
ATTRIBUTES = {
    "title": ["dc:title"],
    "author": ["dc:creator"],
    "artist": ["xmpDM:artist"],
    "duration": ["xmpDM:duration"],
    "width": ["tiff:ImageWidth"],
    "height": ["tiff:ImageLength"],
    "pages": ["xmpTPg:NPages", "Page-Count"],
    "album": ["xmpDM:album"],
    "genre": ["xmpDM:genre"],
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def detect_mime(head: Column | str, name: Column | str) -> Column:
    """Content type by leading bytes, then by file suffix; a subset of what a detector library knows."""
    h = _c(head)
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for mime, parts in MAGIC:
        hit = F.lit(True)
        for offset, digits in parts:
            hit = hit & (F.substring(h, offset + 1, len(digits) // 2) == F.lit(bytearray.fromhex(digits)))
        result = result.when(hit, F.lit(mime))
    suffix = F.lower(F.regexp_extract(_c(name), r"\.([^./]+)$", 1))
    by_suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(result, F.try_element_at(by_suffix, suffix), F.lit("application/octet-stream"))


def pick_attributes(metadata: Column | str) -> Column:
    """The attributes worth keeping from a metadata map, without null and blank values."""
    m = _c(metadata)

    def value(name: str) -> Column:
        found = F.try_element_at(m, F.lit(name))
        return F.when(~found.rlike(r"^\p{javaWhitespace}*$"), found)

    picked = F.map_from_arrays(
        F.array(*map(F.lit, ATTRIBUTES)),
        F.array(*[F.coalesce(*map(value, names)) for names in ATTRIBUTES.values()]),
    )
    return F.map_filter(picked, lambda _, v: v.isNotNull())


def parse_duration(text: Column | str) -> Column:
    """Seconds as double; -10.0 when absent or not a number."""
    return F.coalesce(_c(text).try_cast("double"), F.lit(UNKNOWN_DURATION))


def area(image_size: Column | str) -> Column:
    d = _c(image_size)
    return d["width"].cast("bigint") * d["height"].cast("bigint")


def rank_area(image_size: Column | str) -> Column:
    """Area for ranking: records without dimensions count as -1."""
    return F.coalesce(area(image_size), F.lit(-1).cast("bigint"))


def dimension_text(image_size: Column | str) -> Column:
    d = _c(image_size)
    return F.concat_ws("x", d["width"], d["height"])
