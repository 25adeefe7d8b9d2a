"""Scalar expressions over pixels, objects, names and colours; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridmill.constants import MARKER_LOG_SCALE, MARKER_MIN_RADIUS


def pixel_index(x: Column, y: Column, width: Column | int) -> Column:
    """Row-major index."""
    return (y.cast("long") * width + x.cast("long")).cast("long")


def fixed_point(v: Column, scale: Column | int) -> Column:
    """Signed fixed point: the floor of the scaled value, never wrapped."""
    return F.floor(v * scale).cast("long")


def low_word(v: Column) -> Column:
    return v.bitwiseAND(F.lit(0xFFFFFFFF))


def high_word(v: Column) -> Column:
    return F.shiftrightunsigned(v, 32)


def join_words(low: Column, high: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32) + low.cast("long")


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.greatest(as_column(low), F.least(as_column(high), v))


def contrast_window(v: Column, low: Column, high: Column) -> Column:
    """0 at ``low``, 1 at ``high``, clamped; a window narrower than 1e-4 counts as that wide."""
    return clamp((v - low) / F.greatest(high - low, F.lit(1e-4)), 0.0, 1.0)


def with_low(low: Column, high: Column) -> Column:
    """A display window after its lower edge was moved: it stops at the upper one."""
    return F.struct(F.least(low, high).alias("low"), high.alias("high"))


def with_high(low: Column, high: Column) -> Column:
    """The same for the upper edge."""
    return F.struct(low.alias("low"), F.greatest(high, low).alias("high"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def marker_radius(area: Column) -> Column:
    return MARKER_MIN_RADIUS + MARKER_LOG_SCALE * F.log(area.cast("double"))


def argmax_class(probabilities: list[Column]) -> Column:
    """The class with the largest probability, the lowest of equals; null where unclassified."""
    top = F.greatest(*probabilities)
    out = F.lit(None).cast("int")
    for k, p in reversed(list(enumerate(probabilities))):
        out = F.when(p >= top, F.lit(k)).otherwise(out)
    return F.when(top >= 0, out)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def channel_name(name: Column, channel: Column, channels: Column) -> Column:
    """A source's only plane keeps its name."""
    return F.when(channels == 1, name).otherwise(F.concat(name, F.lit(" [ch"), channel.cast("string"), F.lit("]")))


def valid_color(text: Column) -> Column:
    return text.rlike("^#[0-9a-fA-F]{6}$")


def color_channels(text: Column) -> Column:
    """``#rrggbb`` (the sign may be missing) as three numbers; anything else is mid grey."""
    digits = F.regexp_extract(text, "^#?([0-9a-fA-F]{6})$", 1)
    part = lambda at: F.when(digits != "", F.conv(F.substring(digits, at, 2), 16, 10).cast("int")).otherwise(136)
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


#: The sixteen basic colour names of style sheets.
NAMED_COLORS = {
    "black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "white": "#ffffff", "maroon": "#800000", "red": "#ff0000", "purple": "#800080", "fuchsia": "#ff00ff",
    "green": "#008000", "lime": "#00ff00", "olive": "#808000", "yellow": "#ffff00", "navy": "#000080", "blue": "#0000ff", "teal": "#008080", "aqua": "#00ffff",
}


def css_color(text: Column) -> Column:
    """A style sheet's colour as four parts of 1: three, four, six or eight hexadecimal digits, ``rgb()`` or ``rgba()`` of plain
    numbers, a basic name or ``transparent``. Anything else, and null, is opaque red.
    """
    plain = F.lower(F.trim(text))
    named = F.create_map(*[F.lit(x) for pair in {**NAMED_COLORS, "transparent": "#00000000"}.items() for x in pair])
    plain = F.coalesce(named[plain], plain)
    plain = F.when(plain.rlike("^#[0-9a-f]{3,4}$"), F.regexp_replace(plain, "([0-9a-f])", "$1$1")).otherwise(plain)
    digits = F.regexp_extract(plain, "^#([0-9a-f]{6}(?:[0-9a-f]{2})?)$", 1)
    hexa = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("double") / 255.0
    pattern = r"^rgba?\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*(?:,\s*([0-9]*\.?[0-9]+)\s*)?\)$"
    number = lambda k: F.regexp_extract(plain, pattern, k).try_cast("double")
    part = lambda k: F.when(digits != "", hexa(2 * k - 1)).when(plain.rlike(pattern), F.least(number(k), F.lit(255.0)) / 255.0)
    opacity = F.when(F.length(digits) == 8, hexa(7)).when(plain.rlike(pattern), F.least(F.coalesce(number(4), F.lit(1.0)), F.lit(1.0)))
    return F.struct(F.coalesce(part(1), F.lit(1.0)).alias("r"), *[F.coalesce(part(k), F.lit(0.0)).alias(c) for k, c in ((2, "g"), (3, "b"))], F.coalesce(opacity, F.lit(1.0)).alias("a"))


def fixed_digits(v: Column, digits: int) -> Column:
    """A number below 10^20 as text with so many digits after the point; halves of its decimal text go away from zero."""
    return F.round(v.cast("decimal(38,18)"), digits).cast(f"decimal(38,{digits})").cast("string")


def trimmed_or_null(text: Column) -> Column:
    """Without surrounding white space of any kind; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+$", ""), F.lit(""))


def block_slice(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Bounds of a block of labels, ends exclusive, as the project format writes them."""
    return F.format_string("[%d:%d,%d:%d,0:1]", y0.cast("long"), (y1 + 1).cast("long"), x0.cast("long"), (x1 + 1).cast("long"))


def lane_name(i: Column) -> Column:
    return F.format_string("lane%04d", i.cast("long"))


def label_set_name(i: Column) -> Column:
    return F.format_string("labels%03d", i.cast("long"))


def key_uuid(content: Column) -> Column:
    """An identifier in the form of a random UUID that follows from ``content``, so that reruns agree."""
    digest = F.sha2(content.cast("binary"), 256)
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


def ctime(ts: Column) -> Column:
    """As C's ctime: the day of the month is padded with a space."""
    return F.concat(
        F.date_format(ts, "EEE MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss yyyy")
    )


def zoom(scale: Column, delta: Column, sensitivity: float = 0.01, least: float = 0.1, most: float = 32.0) -> Column:
    return clamp(scale * F.exp(-delta * sensitivity), least, most)


def to_board(client: Column, origin: Column, camera: Column, scale: Column) -> Column:
    return (client - origin - camera) / scale


def ease_out_cubic(t: Column) -> Column:
    return 1 - F.pow(1 - t, F.lit(3))


def client_pixel(client: Column, origin: Column, size: Column, shown: Column) -> Column:
    """The pixel under a pointer, for an image of ``size`` pixels shown ``shown`` wide."""
    return F.floor((client - origin) * size / shown).cast("int")


def register(spark: SparkSession) -> None:
    """The expressions that are useful in SQL text, as SQL functions; ``brush_disc`` is a table of the pixels a brush touches."""
    for statement in (
        "contrast_window(v DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN greatest(0D, least(1D, (v - lo) / greatest(hi - lo, 1e-4D)))",
        f"marker_radius(area DOUBLE) RETURNS DOUBLE RETURN {MARKER_MIN_RADIUS}D + {MARKER_LOG_SCALE}D * ln(area)",
        "luma(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN 0.299D * r + 0.587D * g + 0.114D * b",
        "pixel_index(x BIGINT, y BIGINT, width BIGINT) RETURNS BIGINT RETURN y * width + x",
        """brush_disc(cx INT, cy INT, radius DOUBLE, width INT, height INT) RETURNS TABLE (px INT, py INT) RETURN
             SELECT px, py FROM (SELECT cx + dx AS px, cy + dy AS py, dx, dy
               FROM (SELECT explode(sequence(-CAST(ceil(radius) AS INT), CAST(ceil(radius) AS INT))) AS dx)
               LATERAL VIEW explode(sequence(-CAST(ceil(radius) AS INT), CAST(ceil(radius) AS INT))) AS dy)
             WHERE px BETWEEN 0 AND width - 1 AND py BETWEEN 0 AND height - 1 AND dx * dx + dy * dy <= radius * radius
               AND (radius <> 1 OR (dx = 0 AND dy = 0) OR NOT (cx BETWEEN 0 AND width - 1 AND cy BETWEEN 0 AND height - 1))""",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {statement}")
