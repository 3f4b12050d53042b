"""Colours of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The qualitative palette, and the colours of functional categories.
PALETTE = (
    "#66c2a5 #fc8d62 #8da0cb #e78ac3 #a6d854 #ffd92f #e5c494 #b3b3b3 "
    "#1b9e77 #d95f02 #7570b3 #e7298a #66a61e #e6ab02 #a6761d #666666"
).split()
CATEGORY_COLORS = {
    "CDS": "#3775BA", "5'UTR": "#7BAFD4", "3'UTR": "#7BAFD4", "UTR": "#7BAFD4", "exon": "#B4C0E4",
    "intron": "#D8D8D8", "upstream": "#A6D854", "downstream": "#A6D854", "intergenic": "#F2F2F2",
}
OTHER_CATEGORY = "#cccccc"


def palette_color(index: Column) -> Column:
    """The colour of a 0-based index; the palette repeats."""
    return F.get(F.array(*[F.lit(c) for c in PALETTE]), F.pmod(index, F.lit(len(PALETTE))).cast("int"))


def category_color(category: Column) -> Column:
    colors = F.create_map(*[F.lit(x) for kv in CATEGORY_COLORS.items() for x in kv])
    return F.coalesce(F.try_element_at(colors, category), F.lit(OTHER_CATEGORY))


def is_dark(color: Column, threshold: float = 0.5) -> Column:
    """Whether the luminance of ``#rrggbb`` is under ``threshold``."""
    part = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("double") / 255
    return 0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6) < threshold
