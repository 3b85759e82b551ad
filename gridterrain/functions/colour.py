"""Palettes, altitude ramps and the numeric colouring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridterrain.functions.numeric import float_floor_div

# The twelve colours dealt to areas (before softening) and the fallback.
PALETTE = [
    (255, 0, 0), (0, 0, 255), (0, 255, 0), (255, 255, 0), (255, 165, 0), (160, 32, 240),
    (165, 42, 42), (255, 192, 203), (0, 238, 238), (238, 0, 238), (238, 130, 238), (190, 190, 190),
]
DEFAULT_COLOUR = (128, 128, 128)
WHITE = (255, 255, 255)

# Breakpoints (altitude, colour) of each land ramp.
LAND_RAMPS = {
    "standard": [
        (-10, (0xFF, 0xFF, 0xEE)), (0, (0xFF, 0xFF, 0x99)), (60, (0xFF, 0xE9, 0xB3)),
        (180, (0xFF, 0xD9, 0xB3)), (300, (0xFF, 0xCC, 0x99)), (430, (0xFF, 0xBF, 0x80)),
        (610, (0xFF, 0xB3, 0x66)), (900, (0xFF, 0x99, 0x33)), (1350, (0xB3, 0x59, 0x00)),
    ],
    "trial": [
        (-10, (0xFF, 0xFF, 0xEE)), (0, (0xCC, 0xFF, 0xCC)), (180, (0xFF, 0xE9, 0xB3)),
        (300, (0xFF, 0xCC, 0x99)), (430, (0xFF, 0xBF, 0x80)), (610, (0xFF, 0xB3, 0x66)),
        (900, (0xFF, 0x99, 0x33)), (1350, (0xB3, 0x59, 0x00)),
    ],
    "greyscale": [(-10, (0xFF, 0xFF, 0xEE)), (0, (0xFF, 0xFF, 0xFF)), (1350, (0x00, 0x00, 0x00))],
    "red": [(-10, (0xFF, 0xFF, 0xEE)), (0, (0xFF, 0xFF, 0xFF)), (1350, (0xFF, 0x00, 0x00))],
    "blue": [(-10, (0xFF, 0xFF, 0xEE)), (0, (0xFF, 0xFF, 0xFF)), (1350, (0x00, 0x00, 0xFF))],
    "green": [(-10, (0xFF, 0xFF, 0xEE)), (0, (0xFF, 0xFF, 0xFF)), (1350, (0x00, 0xFF, 0x00))],
    "cyan": [(-10, (0xFF, 0xFF, 0xEE)), (0, (0xFF, 0xFF, 0xFF)), (1350, (0x00, 0xFF, 0xFF))],
    "yellow": [(-10, (0xFF, 0xFF, 0xEE)), (0, (0xFF, 0xFF, 0xFF)), (1350, (0xFF, 0xFF, 0x00))],
    "magenta": [(-10, (0xFF, 0xFF, 0xEE)), (0, (0xFF, 0xFF, 0xFF)), (1350, (0xFF, 0x00, 0xFF))],
}
# Water colour of each scheme.
WATER = {
    "standard": (0xCC, 0xE5, 0xFF), "trial": (0xCC, 0xE5, 0xFF), "greyscale": (0xCC, 0xE5, 0xFF),
    "red": (0xCC, 0xE5, 0xFF), "blue": (0xCC, 0xCC, 0xCC), "green": (0xCC, 0xCC, 0xCC),
    "cyan": (0x66, 0xFF, 0xCC), "yellow": (0xCC, 0xE5, 0xFF), "magenta": (0xCC, 0xE5, 0xFF),
}
NUMERIC = "numeric"
SCHEMES = [*LAND_RAMPS, NUMERIC]


def scheme_or_default(name: str) -> str:
    """Unknown or blank scheme names mean the standard one."""
    return name if name in SCHEMES else "standard"


def softened(channel: int) -> int:
    """Half way to white; full channels stay."""
    return channel if channel == 255 else int(channel + (255 - channel) * 0.5)


SOFT_PALETTE = [tuple(softened(v) for v in rgb) for rgb in PALETTE]


def pack(rgb: tuple[int, int, int]) -> int:
    return (rgb[0] << 16) | (rgb[1] << 8) | rgb[2]


def packed_palette(group: Column) -> Column:
    """Packed colour of a colour group 0..11; the fallback grey for null."""
    colours = F.array(*[F.lit(pack(rgb)) for rgb in SOFT_PALETTE])
    return F.coalesce(F.get(colours, group), F.lit(pack(DEFAULT_COLOUR)))


def unpack(packed: Column) -> list[Column]:
    """Columns r, g, b of a packed colour."""
    return [
        F.shiftright(packed, 16).cast("int").alias("r"),
        F.shiftright(packed, 8).bitwiseAND(255).cast("int").alias("g"),
        packed.bitwiseAND(255).cast("int").alias("b"),
    ]


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb``."""
    return F.format_string("#%02x%02x%02x", r, g, b)


def ramp_factors(scheme: str, lowest: Column, highest: Column) -> tuple[Column, Column]:
    """Factors that stretch [lowest, highest] to the ramp; null without a range to divide by."""
    stops = [s[0] for s in LAND_RAMPS[scheme]]
    return F.when(highest != 0, (max(stops) - 0.1) / highest), F.when(lowest != 0, (abs(min(stops)) - 0.1) / F.abs(lowest))


def _numeric_channels(alt: Column) -> list[Column]:
    size = F.abs(alt)
    high = alt >= 0
    off = size > 999
    stretch = F.when(size < 2.55, size * 100).when(size < 10, size * 25).when(size < 25.5, size * 10).otherwise(size)
    return [
        F.when(high, float_floor_div(size, F.lit(100.0)).cast("double")).when(off, 255.0).otherwise(stretch),
        F.when(high, size % 100).when(off, 255.0).otherwise(size),
        F.when(high, 0.0).otherwise(255.0),
    ]


def _ramp_channels(scheme: str, eff: Column) -> list[Column]:
    stops = LAND_RAMPS[scheme]
    lowest, highest = stops[0][0], stops[-1][0]
    out = []
    for ch, at_top in zip(range(3), (255.0, 0.0, 0.0)):
        value = F.when((eff < lowest) | (eff > highest), 0.0)
        for (lo_alt, lo), (hi_alt, hi) in zip(stops, stops[1:]):
            share = (eff - lo_alt) / float(hi_alt - lo_alt)
            value = value.when(eff < hi_alt, lo[ch] - (lo[ch] - hi[ch]) * share)
        out.append(value.otherwise(at_top))
    return out


def land_colour(
    scheme: str, alt: Column, factors: tuple[Column, Column] | None = None
) -> list[Column]:
    """Whole-number r, g, b of land at an altitude, optionally stretched by P21."""
    if scheme == NUMERIC:
        channels = _numeric_channels(alt)
    else:
        up, down = factors if factors else (F.lit(1.0), F.lit(1.0))
        channels = _ramp_channels(scheme, F.when(alt >= 0, alt * up).otherwise(alt * down))
    return [c.cast("int").alias(n) for c, n in zip(channels, "rgb")]


def water_colour(scheme: str, alt: Column) -> list[Column]:
    """Whole-number r, g, b of water."""
    if scheme == NUMERIC:
        return land_colour(scheme, alt)
    return [F.lit(v).alias(n) for v, n in zip(WATER[scheme], "rgb")]
