"""Content hashes and fingerprint arithmetic, all as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed values of the hash definitions.
INLINE_LIMIT = 20
CHUNK_BYTES = 100 * 1024
FALLBACK_SKIP = 1024 * 1024
FALLBACK_PREFIX = "fallback:"
ID3_HEADER = 10
EMPTY_FRAME = "0" * 16
WHITESPACE = " \t\n\x0b\f\r"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_hex(content: Column | str) -> Column:
    """Lower-case hexadecimal digits of a binary or string value."""
    return F.lower(F.hex(_c(content)))


def content_hash(content: Column | str) -> Column:
    """Identity of a content: the bytes in hex when shorter than 20, their SHA-1 otherwise."""
    c = _c(content)
    return F.when(F.octet_length(c) < INLINE_LIMIT, to_hex(c)).otherwise(F.sha1(c))


def text_hash(text: Column | str, max_chars: int | None = None) -> Column:
    """SHA-256 of a text without case and whitespace; null for blank texts.

    Whole texts are hashed unless `max_chars` asks for a leading part.
    """
    t = _c(text)
    if max_chars is not None:
        t = F.substring(t, 1, max_chars)
    squeezed = reduce(lambda rest, space: F.replace(rest, F.lit(space), F.lit("")), WHITESPACE, F.lower(t))
    # Any other character is enough: what counts as blank includes all that is squeezed out.
    return F.when(t.rlike(r"\P{javaWhitespace}"), F.sha2(squeezed, 256))


def fallback_hash(content: Column | str) -> Column:
    """Hash of the 100 KiB that follow the first MiB; null when nothing follows."""
    c = _c(content)
    chunk = F.substring(c, FALLBACK_SKIP + 1, CHUNK_BYTES)
    return F.when(F.octet_length(chunk) > 0, F.concat(F.lit(FALLBACK_PREFIX), F.sha2(chunk, 256)))


def _byte(content: Column, position: int) -> Column:
    return F.conv(F.hex(F.substring(content, position, 1)), 16, 10).cast("int")


def audio_chunk_hash(content: Column | str) -> Column:
    """SHA-256 of the first 100 KiB behind the ten header bytes and, if present, the ID3 tag."""
    c = _c(content)
    tagged = (F.octet_length(c) >= ID3_HEADER) & (F.substring(c, 1, 3) == F.lit(bytearray(b"ID3")))
    # The tag length is four bytes of seven bits each, most significant first.
    length = reduce(
        lambda high, low: F.shiftleft(high, 7).bitwiseOR(low),
        [_byte(c, p).bitwiseAND(F.lit(0x7F)) for p in (7, 8, 9, 10)],
    )
    start = F.lit(ID3_HEADER + 1) + F.when(tagged, length).otherwise(F.lit(0))
    chunk = F.substr(c, start, F.lit(CHUNK_BYTES))
    return F.when(F.octet_length(chunk) > 0, F.sha2(chunk, 256))


def temporal_hash(frame10: Column | str, frame50: Column | str, frame90: Column | str, duration: Column | str) -> Column:
    """192-bit video fingerprint from the frame fingerprints at 10, 50 and 90 percent of a positive duration."""
    frames = [F.coalesce(_c(f), F.lit(EMPTY_FRAME)) for f in (frame10, frame50, frame90)]
    return F.when(_c(duration) > 0, F.concat(*frames))


def is_fallback(video_hash: Column | str) -> Column:
    return F.coalesce(_c(video_hash).startswith(FALLBACK_PREFIX), F.lit(False))


def hex64(digits: Column | str) -> Column:
    """Sixteen hex digits as a 64-bit word (two's complement); null for anything else."""
    d = _c(digits)
    return F.when(d.rlike("^[0-9a-fA-F]{16}$"), F.conv(d, 16, -10).cast("bigint"))


def hex_words(digits: Column | str, bits: int) -> list[Column]:
    """A fingerprint of `bits` bits as 64-bit words."""
    d = _c(digits)
    return [hex64(F.substring(d, 1 + 16 * i, 16)) for i in range(bits // 64)]


def word_hex(word: Column | str) -> Column:
    """A 64-bit word as sixteen lower-case hex digits."""
    return F.lpad(to_hex(_c(word)), 16, "0")


def hamming(left: list[Column], right: list[Column]) -> Column:
    """Number of differing bits between two equally long lists of 64-bit words."""
    return reduce(lambda a, b: a + b, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right, strict=True)])


def max_distance(bits: int, threshold: float) -> int:
    """Largest distance whose similarity still reaches `threshold` percent; -1 when none does."""
    return max((d for d in range(bits + 1) if (1.0 - d / bits) * 100.0 >= threshold), default=-1)
