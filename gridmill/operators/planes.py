"""Sample planes of multichannel images, their ranges, and the intake of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.constants import DTYPE_MAX, FLOAT_SCALE, IMAGE_SUFFIXES
from gridmill.functions.scalars import channel_name


def deinterleave(df: DataFrame, samples: str, channels: int, keep: list[str]) -> DataFrame:
    """Interleaved samples as rows ``(…, channel, i, v)``; one channel is plain widening."""
    rows = df.select(*keep, F.posexplode(samples).alias("at", "sample"))
    return rows.select(
        *keep, (F.col("at") % channels).cast("int").alias("channel"), F.floor(F.col("at") / channels).cast("long").alias("i"), F.col("sample").cast("double").alias("v")
    )


def fan_out(sources: DataFrame) -> DataFrame:
    """One image for each channel of ``(name, channels, …)``, named by channel where there are several."""
    rows = sources.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
    return rows.withColumn("image_name", channel_name(F.col("name"), F.col("channel"), F.col("channels")))


def dtype_max(dtype: Column, data_max: Column) -> Column:
    """The sample type's largest value; floating types have the data's own."""
    table = F.create_map(*[F.lit(x) for pair in DTYPE_MAX.items() for x in pair])
    return F.coalesce(table[dtype].cast("double"), data_max)


def range_metadata(planes: DataFrame) -> DataFrame:
    """Adds to ``(dtype, data_min, data_max)``: largest value, fixed-point scale, display window, slider step."""
    top = dtype_max(F.col("dtype"), F.col("data_max"))
    whole = (top == F.floor(top)) & (top >= 255)
    floats = F.col("dtype").isin("float32", "float64")
    return planes.withColumns({
        "dtype_max": top, "scale": F.when(floats, FLOAT_SCALE).otherwise(1), "step": F.when(whole, 1.0).otherwise(top / 1000),
    })


def accepted(files: DataFrame, name: str = "name") -> DataFrame:
    """Files of the kinds that are read, whatever the case of their suffix."""
    return files.where(F.lower(name).rlike(IMAGE_SUFFIXES))


def intake(new: DataFrame, known: DataFrame) -> DataFrame:
    """Of new files ``(name, file_size, ord)`` those not known by name and size, the first of each."""
    first = F.row_number().over(Window.partitionBy("name", "file_size").orderBy("ord"))
    fresh = accepted(new).join(known.select("name", "file_size"), ["name", "file_size"], "left_anti")
    return fresh.withColumn("rank", first).where(F.col("rank") == 1).drop("rank")


def with_rank_errors(shapes: DataFrame, shape: str = "shape") -> DataFrame:
    """Adds ``error``: what is wrong with a row whose shape has more than two axes, else null; a null shape is such an error too. No data is copied for it."""
    rank = F.coalesce(F.size(shape), F.lit(-1))
    said = F.format_string("only two-dimensional images are read, not %d axes", rank)
    return shapes.withColumn("error", F.when(rank < 0, "no shape").when(rank > 2, said))


def planar_only(shapes: DataFrame, shape: str = "shape") -> DataFrame:
    """Rows of rank 2; more axes are an error, raised when such a row is met."""
    checked = F.when(F.size(shape) > 2, F.raise_error(F.lit("only two-dimensional images are read"))).otherwise(F.lit(True))
    return shapes.where(checked)
