"""Difference hash of images, from pixel arrays to sixteen hex digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from twinfinder.functions.hashing import word_hex

SIDE = 9


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _orientations() -> list[list[int]]:
    """Cell numbers of the grid seen from its eight rotations and reflections."""
    grid = [[SIDE * y + x for x in range(SIDE)] for y in range(SIDE)]
    views = []
    for _ in range(4):
        mirrored = [list(column) for column in zip(*grid)]
        views += [grid, mirrored]
        grid = [row[::-1] for row in mirrored]
    return [[cell for row in view for cell in row] for view in views]


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_grid(grid: Column | str) -> Column:
    """The lexicographically largest of the eight orientations of a 9x9 grid of grey values."""
    def largest(g: Column) -> Column:
        return F.array_max(F.array(*[F.transform(F.lit(cells), lambda i: F.get(g, i)) for cells in _orientations()]))

    return _bind(_c(grid), largest)


def dhash(grid: Column | str) -> Column:
    """Sixteen hex digits: bit 8y+x tells whether cell (x,y) is brighter than its right neighbour, x and y below 8."""
    cells = F.lit([SIDE * (n // 8) + n % 8 for n in reversed(range(64))])  # highest bit first

    def word(g: Column) -> Column:
        return F.aggregate(
            cells,
            F.lit(0).cast("bigint"),
            lambda bits, c: F.shiftleft(bits, 1).bitwiseOR((F.get(g, c) > F.get(g, c + 1)).cast("bigint")),
        )

    return word_hex(_bind(_c(grid), word))


def grid9(pixels: Column | str, width: Column | str, height: Column | str) -> Column:
    """Bilinear reduction of a row-major grey image to 9x9 cells; null when the image has no pixels."""
    p, w, h = _c(pixels), _c(width).cast("int"), _c(height).cast("int")

    def axis(n: Column, length: Column) -> tuple[Column, Column, Column]:
        centre = (n + 0.5) * length / SIDE - 0.5
        inside = F.greatest(F.lit(0.0), F.least(centre, (length - 1).cast("double")))
        low = F.floor(inside).cast("int")
        return low, F.least(low + 1, length - 1), inside - low

    def cell(i: Column) -> Column:
        x0, x1, fx = axis(i % SIDE, w)
        y0, y1, fy = axis(F.floor(i / SIDE), h)
        top = F.get(p, y0 * w + x0) * (1 - fx) + F.get(p, y0 * w + x1) * fx
        bottom = F.get(p, y1 * w + x0) * (1 - fx) + F.get(p, y1 * w + x1) * fx
        return F.floor(top * (1 - fy) + bottom * fy + 0.5).cast("int")

    usable = (w > 0) & (h > 0) & (F.size(p) == w * h)
    return F.when(usable, F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), cell))
