"""Pitch, interval, scale, key and meter functions. Ticks are integers, 480 to the quarter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER = 480
#: Scale steps by mode (minor: harmonic in scales, natural in scale degrees), key profiles, duration bins.
MAJOR = [0, 2, 4, 5, 7, 9, 11]
HARMONIC_MINOR = [0, 2, 3, 5, 7, 8, 11]
NATURAL_MINOR = [0, 2, 3, 5, 7, 8, 10]
PROFILE_MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
PROFILE_MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
DURATIONS = [60, 120, 180, 240, 360, 480, 720, 960, 1440, 1920, 2880]
SHARP_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def lits(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def floor_div(a: Column, b: int | Column) -> Column:
    """Integer division towards minus infinity."""
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b)).cast("long")


def pitch_class(p: Column) -> Column:
    return F.pmod(p, F.lit(12)).cast("int")


def octave(p: Column) -> Column:
    return (floor_div(p, 12) - 1).cast("int")


def interval_class(s: Column) -> Column:
    m = F.abs(s) % 12
    return F.least(m, 12 - m)


def is_consonant(s: Column) -> Column:
    return (F.abs(s) % 12).isin(0, 3, 4, 7, 8, 9)


def scale(root: Column, mode: Column, minor: list[int] = HARMONIC_MINOR) -> Column:
    """The seven pitch classes of a key, from the tonic up."""
    steps = F.when(mode == "major", lits(MAJOR)).otherwise(lits(minor))
    return F.transform(steps, lambda x: F.pmod(x + root, F.lit(12)).cast("int"))


def scale_degree(pc: Column, root: Column, mode: Column) -> Column:
    """1 to 7, or null outside the (harmonic) scale."""
    return F.nullif(F.array_position(scale(root, mode), pc.cast("int")).cast("int"), F.lit(0))


def nearest_bin(v: Column, bins: list[int] = DURATIONS) -> Column:
    """Index of the nearest bin, the lowest on ties."""
    ranked = F.transform(lits(bins), lambda b, i: F.struct(F.abs(b - v).alias("d"), i.alias("i")))
    return F.array_min(ranked)["i"]


def interval_kind(i: Column) -> Column:
    """0: leap down (-5 or less), 1: step down, 2: same, 3: up to 4, 4: leap up."""
    return F.when(i <= -5, 0).when(i < 0, 1).when(i == 0, 2).when(i <= 4, 3).otherwise(4)


def beats_per_measure(num: Column, den: Column) -> Column:
    """Compound meters (6, 9 or 12 eighths) count dotted beats."""
    compound = (den == 8) & (num > 3) & (num % 3 == 0)
    return F.when(compound, (num / 3).cast("int")).otherwise(num)


def ticks_per_measure(num: Column, den: Column) -> Column:
    return floor_div(num * 4 * QUARTER, den)


def length_bucket(bars: Column) -> Column:
    return F.when(bars <= 16, "short").when(bars <= 32, "medium").when(bars <= 64, "long").otherwise("extended")


def catalogue_form(bwv: Column) -> Column:
    """Form by catalogue number. Of 846 to 893 the odd numbers are the fugues, the even ones their preludes."""
    fugue = bwv.between(847, 893) & (bwv % 2 == 1) | bwv.isin(565, 1080)
    return F.when(bwv.between(250, 438), "chorale").when(bwv.between(772, 786), "invention").when(bwv.between(787, 801), "sinfonia").when(fugue, "fugue").when(bwv.between(525, 530), "trio_sonata")


def note_name(p: Column) -> Column:
    """C4 for 60."""
    return F.concat(F.element_at(lits(SHARP_NAMES), pitch_class(p) + 1), octave(p).cast("string"))


def parse_note(s: Column) -> Column:
    """MIDI number of a name such as C#4 or Bb3, or null."""
    letter = F.upper(F.regexp_extract(s, r"^([A-Ga-g])([#b]?)(-?\d+)$", 1))
    accidental, oct_ = F.regexp_extract(s, r"^([A-Ga-g])([#b]?)(-?\d+)$", 2), F.regexp_extract(s, r"^([A-Ga-g])([#b]?)(-?\d+)$", 3)
    step = F.element_at(F.create_map(*(x for k, v in zip("CDEFGAB", MAJOR, strict=True) for x in (F.lit(k), F.lit(v)))), letter)
    return F.when(letter != "", (oct_.cast("int") + 1) * 12 + step + F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0))


def in_range_score(v: Column, lo: float, hi: float) -> Column:
    """1 inside [lo, hi]; below it falls by 1/width, above it by half of that."""
    w = hi - lo
    return F.when(v.between(lo, hi), F.lit(1.0)).when(v < lo, F.greatest(F.lit(0.0), 1 - (lo - v) / w)).otherwise(F.greatest(F.lit(0.0), 1 - (v - hi) / (2 * w)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; null if one is constant."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    ab, aa, bb = total(F.zip_with(a, b, lambda x, y: x * y)), total(F.transform(a, lambda x: x * x)), total(F.transform(b, lambda x: x * x))
    sa, sb = total(a), total(b)
    spread = (n * aa - sa * sa) * (n * bb - sb * sb)
    return F.when(spread > 1e-12, (n * ab - sa * sb) / F.sqrt(spread))
