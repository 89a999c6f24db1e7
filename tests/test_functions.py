import hashlib
import random

import pytest
from pyspark.sql import functions as F

from twinfinder.functions import hashing, image, media, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def binary(data):
    return F.lit(bytearray(data))


@pytest.mark.parametrize("data", [b"", b"abcdef", b"x" * 19, b"x" * 20, b"hello world " * 9])
def test_content_hash(spark, data):
    expected = data.hex() if len(data) < 20 else hashlib.sha1(data).hexdigest()
    assert one(spark, hashing.content_hash(binary(data)))[0] == expected


def test_published_sha1_through_hex(spark):
    assert one(spark, F.sha1(F.lit("hello world")))[0] == "2aae6c35c94fcfb415dbe95f408b9ce91ee846ed"
    assert one(spark, hashing.to_hex(binary(b"\x00\x0f\xff")))[0] == "000fff"


def test_text_hash_ignores_case_and_space(spark):
    got = one(
        spark,
        hashing.text_hash(F.lit("Hello \n World")),
        hashing.text_hash(F.lit("helloworld")),
        hashing.text_hash(F.lit(" \t\n")),
        hashing.text_hash(F.lit(" ")),
        hashing.text_hash(F.lit("abc def"), max_chars=3),
        hashing.text_hash(F.lit(None).cast("string")),
    )
    digest = hashlib.sha256(b"helloworld").hexdigest()
    assert list(got) == [digest, digest, None, None, hashlib.sha256(b"abc").hexdigest(), None]


def test_text_hash_covers_whole_text(spark):
    a, b = "x" * 6000 + "a", "x" * 6000 + "b"
    got = one(spark, hashing.text_hash(F.lit(a)), hashing.text_hash(F.lit(b)))
    assert got[0] == hashlib.sha256(a.encode()).hexdigest() != got[1]


def test_fallback_hash(spark):
    data = bytes(random.Random(1).randbytes(1024 * 1024 + 150_000))
    expected = "fallback:" + hashlib.sha256(data[1048576:1048576 + 102400]).hexdigest()
    got = one(spark, hashing.fallback_hash(binary(data)), hashing.fallback_hash(binary(data[:1048576])))
    assert list(got) == [expected, None]


def _id3(size):
    return b"ID3\x04\x00\x00" + bytes((size >> s) & 0x7F for s in (21, 14, 7, 0))


@pytest.mark.parametrize(
    "data, start",
    [
        (b"0123456789" + b"sound" * 50_000, 10),
        (_id3(300) + b"t" * 300 + b"sound" * 10, 310),
        (_id3(200_000) + b"t" * 200_000 + b"sound", 200_010),
        (_id3(50) + b"t" * 20, None),
        (b"0123456789", None),
        (b"ID3", None),
    ],
)
def test_audio_chunk_hash(spark, data, start):
    expected = None if start is None else hashlib.sha256(data[start:start + 102400]).hexdigest()
    assert one(spark, hashing.audio_chunk_hash(binary(data)))[0] == expected


def test_temporal_hash(spark):
    a, b = F.lit("a" * 16), F.lit("b" * 16)
    missing = F.lit(None).cast("string")
    got = one(spark, hashing.temporal_hash(a, missing, b, F.lit(3.0)), hashing.temporal_hash(a, a, b, F.lit(0.0)))
    assert list(got) == ["a" * 16 + "0" * 16 + "b" * 16, None]


def test_hex_words_and_hamming(spark):
    got = one(
        spark,
        hashing.hex64(F.lit("ffffffffffffffff")),
        hashing.hex64(F.lit("8000000000000001")),
        hashing.hex64(F.lit("garbage")),
        hashing.hamming([F.lit(-1).cast("bigint")], [F.lit(0).cast("bigint")]),
        hashing.word_hex(F.lit(255).cast("bigint")),
    )
    assert list(got) == [-1, -(2**63) + 1, None, 64, "00000000000000ff"]


@pytest.mark.parametrize(
    "bits, threshold, k",
    [(64, 100, 0), (64, 95, 3), (64, 90, 6), (64, 88, 7), (64, 85, 9), (64, 80, 12), (64, 70, 19), (64, 101, -1),
     (192, 95, 9), (192, 90, 19), (192, 88, 23), (192, 85, 28)],
)
def test_max_distance(bits, threshold, k):
    assert hashing.max_distance(bits, threshold) == k


def _turn(grid):
    return [grid[9 * (8 - x) + y] for y in range(9) for x in range(9)]


def _mirror(grid):
    return [grid[9 * y + 8 - x] for y in range(9) for x in range(9)]


def test_fingerprint_is_the_same_for_all_orientations(spark):
    rng = random.Random(5)
    grids = []
    for n in range(5):
        grid = [rng.randrange(256) for _ in range(81)]
        for flip in (grid, _mirror(grid)):
            for _ in range(4):
                grids.append((n, flip))
                flip = _turn(flip)
    df = spark.createDataFrame(grids, "n int, grid array<int>")
    got = df.select("n", "grid", image.canonical_grid("grid").alias("c"), image.dhash(image.canonical_grid("grid")).alias("f"))
    seen = {}
    for row in got.collect():
        seen.setdefault(row["n"], set()).add((tuple(row["c"]), row["f"]))
    assert all(len(s) == 1 for s in seen.values())
    for n, s in seen.items():
        best, shown = next(iter(s))
        assert best == max(tuple(g) for m, g in grids if m == n)
        bits = sum(1 << (8 * y + x) for y in range(8) for x in range(8) if best[9 * y + x] > best[9 * y + x + 1])
        assert shown == f"{bits:016x}"


def test_grid9(spark):
    got = one(
        spark,
        image.grid9(F.array(*[F.lit(v) for v in range(81)]), F.lit(9), F.lit(9)),
        image.grid9(F.array(F.lit(7)), F.lit(1), F.lit(1)),
        image.grid9(F.array(*[F.lit(v % 18 * 10) for v in range(18 * 18)]), F.lit(18), F.lit(18)),
        image.grid9(F.array(F.lit(1)), F.lit(0), F.lit(0)),
    )
    assert got[0] == list(range(81))
    assert got[1] == [7] * 81
    assert got[2][:9] == [5 + 20 * x for x in range(9)]
    assert got[3] is None


@pytest.mark.parametrize(
    "size, shown",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1536, "1.5 KB"), (1024**2, "1.0 MB"),
     (1024**3 * 5 // 2, "2.5 GB"), (2**50 - 1, "1024.0 TB"), (2**50, "1.0 PB"), (2**60, "1.0 EB"), (2**63 - 1, "8.0 EB")],
)
def test_format_size(spark, size, shown):
    assert one(spark, text.format_size(F.lit(size).cast("bigint")))[0] == shown


def test_paths(spark):
    names = ["a/b.txt", "b.txt", ".profile", "d/.profile", "noext", "x.y/noext", "a.b.c", "..x", "a.", "p/..x"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [tuple(r) for r in df.select(text.parent("p"), text.file_name("p"), text.replace_suffix("p", "jpg")).collect()]
    assert got == [
        ("a", "b.txt", "a/b.jpg"), ("", "b.txt", "b.jpg"), ("", ".profile", ".profile.jpg"),
        ("d", ".profile", "d/.profile.jpg"), ("", "noext", "noext.jpg"), ("x.y", "noext", "x.y/noext.jpg"),
        ("", "a.b.c", "a.b.jpg"), ("", "..x", "..jpg"), ("", "a.", "a.jpg"), ("p", "..x", "p/..jpg"),
    ]
    same = df.select(text.replace_suffix("p", None), text.replace_suffix("p", ".x")).first()
    assert tuple(same) == ("a/b.txt", "a/b.x")
    assert one(spark, text.join_path("/", F.lit("a")), text.join_path("/b/", F.lit("a")))[:] == ("/a", "/b/a")
    assert one(spark, text.format_date(F.lit(86_400_000).cast("bigint")))[0] == "1970-01-02 00:00:00"


def test_media(spark):
    got = one(
        spark,
        media.detect_mime(binary(b"\x89PNG\r\n\x1a\n...."), F.lit("x.txt")),
        media.detect_mime(binary(b"RIFF\0\0\0\0WAVE"), F.lit("x")),
        media.detect_mime(binary(b"hello"), F.lit("d/x.TXT")),
        media.detect_mime(binary(b"%PDF-1.4"), F.lit("x")),
        media.detect_mime(binary(b"hello"), F.lit("x")),
        media.parse_duration(F.lit("120.5")),
        media.parse_duration(F.lit("00:01:23")),
        media.parse_duration(F.lit(None).cast("string")),
    )
    assert list(got) == [
        "image/png", "audio/vnd.wave", "text/plain", "application/pdf", "application/octet-stream", 120.5, -10.0, -10.0
    ]
    meta = F.create_map(*[F.lit(x) for x in (
        "dc:title", "T", "dc:creator", " ", "Page-Count", "7", "xmpDM:duration", "00:01:23", "zzz", "1"
    )])
    assert one(spark, media.pick_attributes(meta))[0] == {"title": "T", "pages": "7", "duration": "00:01:23"}


def test_dimensions(spark):
    size = F.struct(F.lit(60_000).alias("width"), F.lit(60_000).alias("height"))
    none = F.lit(None).cast("struct<width:int,height:int>")
    got = one(spark, media.area(size), media.rank_area(none), media.dimension_text(size))
    assert list(got) == [3_600_000_000, -1, "60000x60000"]
