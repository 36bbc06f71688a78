"""Column builders for image, video and audio geometry, and for packed numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnitudes of the eight unsigned 4-bit floating point codes.
FP4 = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)


def fitted(w: Column, h: Column, patch: int, rows: int) -> tuple[Column, Column]:
    """Width and height that keep an image within ``rows`` patches; smaller images stay as they are."""
    budget = rows * patch * patch
    scale = F.sqrt(F.lit(float(budget)) / (w * h))

    def side(x: Column) -> Column:
        whole = F.floor(x * scale)
        return F.when(w * h <= budget, x.cast("bigint")).otherwise(F.greatest(F.lit(patch), whole - whole % patch - patch).cast("bigint"))

    return side(w), side(h)


def rows_per_frame(frames: Column, temporal_patch: int, rows: int) -> Column:
    """The share of a clip's patch rows for each of its frames."""
    return F.greatest(F.lit(64), F.floor(F.lit(rows) / F.greatest(F.lit(1), F.floor(frames / temporal_patch))))


def patches(grid: Column) -> Column:
    """Product of a grid's sides."""
    return F.aggregate(grid, F.lit(1).cast("bigint"), lambda a, x: a * x)


def token_count(grids: Column, merge: int) -> Column:
    """Tokens of a sample: patch rows over all of its clips, merge x merge of them a token."""
    return F.floor(patch_rows(grids) / (merge * merge))


def patch_rows(grids: Column) -> Column:
    """Patch rows of a list of grids: the sum of their products."""
    return F.aggregate(F.transform(grids, patches), F.lit(0).cast("bigint"), lambda a, x: a + x)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def resampled(wave: Column, rate: int, to: int) -> Column:
    """A waveform at another rate: floor(size * to / rate) values interpolated between its ends."""
    def run(w: Column) -> Column:
        last = F.size(w) - 1
        n = F.floor(F.size(w) * to / F.lit(float(rate))).cast("int")

        def value(i: Column) -> Column:
            at = i * last / F.greatest(n - 1, F.lit(1)).cast("double")
            low = F.least(F.floor(at).cast("int"), last)
            a, b = F.get(w, low), F.get(w, F.least(low + 1, last))
            return a + (at - low) * (b - a)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.slice(w, 1, 0))

    return wave if rate == to else bound(wave, run)


def peak_normalised(wave: Column, rate: int, peak: float = 0.7, seconds: int = 30) -> Column:
    """A waveform scaled to ``peak`` and cut to ``seconds``; null if shorter than a quarter of a second."""
    return F.when(F.size(wave) >= rate // 4, _scaled(wave, rate, peak, seconds))


def _scaled(wave: Column, rate: int, peak: float, seconds: int) -> Column:
    """A waveform whose greatest value is made ``peak``, cut to ``seconds``; silence stays."""
    def run(w: Column) -> Column:
        top = F.array_max(F.transform(w, F.abs))
        return bound(F.when(top > 0, top).otherwise(1.0), lambda t: F.transform(F.slice(w, 1, rate * seconds), lambda x: x / t * peak))

    return bound(wave, run)


def prepared_audio(wave: Column, rate: int, to: int, peak: float = 0.7, seconds: int = 30) -> Column:
    """What a model takes of a waveform: resampled, normalised, cut; null if it comes with less than a quarter of a second's values."""
    return F.when(F.size(wave) >= to // 4, _scaled(resampled(wave, rate, to), to, peak, seconds))


def dequantised_fp4(packed: Column, scales: Column, block: int = 32) -> Column:
    """Values of packed 4-bit codes (low half first), each block times 2^(scale - 127)."""
    table = F.array(*[F.lit(x) for x in FP4])
    codes = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4).bitwiseAND(15))))
    sign = lambda c: F.when(c >= 8, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.transform(codes, lambda c, i: sign(c) * F.get(table, c % 8) * F.pow(F.lit(2.0), F.get(scales, F.floor(i / block).cast("int")) - 127))


def decoded_fp8(code: Column) -> Column:
    """The value of an 8-bit code of four exponent and three fraction bits; both codes of all ones are NaN."""
    low, exponent = code.bitwiseAND(7), F.shiftright(code, 3).bitwiseAND(15)
    size = F.when(exponent == 0, low / 8.0 * 2.0**-6).otherwise((low / 8.0 + 1) * F.pow(F.lit(2.0), exponent - 7))
    return F.when(code.bitwiseAND(127) == 127, F.lit(float("nan"))).otherwise(F.when(code >= 128, -size).otherwise(size))


def dequantised_fp8(codes: Column, scales: Column, width: int, block: int) -> Column:
    """A matrix of 8-bit codes (row by row, ``width`` a row) times the scale of each block x block square."""
    across = -(-width // block)

    def value(code: Column, i: Column) -> Column:
        square = F.floor(i / (width * block)) * across + F.floor(i % width / block)
        return decoded_fp8(code) * F.get(scales, square.cast("int"))

    return F.transform(codes, value)
