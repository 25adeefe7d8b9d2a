"""The registered queries, each beside its SQL for a second engine (None where SQL cannot say it)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.constants import CLASS_COLORS
from gridmill.functions import scalars
from gridmill.operators import ccl, filters, forest, labels, objects, planes, raster, render, settings
from gridmill.plans import oracles as sql
from gridmill.plans import pipeline
from gridmill.plans.fixed import EMBED_FEATURES, FOREST, RASTER_FEATURES, SIGMA
from gridmill.shipping import ship
from gridmill.sinks import files, project, ranges
from gridmill.sources import images, tables, tiff
from gridmill.sources.project import Project
from gridmill.sources.tables import EVENTS_SIZE, SHIP_SIZE, events_raster, ship_raster, table
from gridmill.store import materialize, scratch
from gridmill.streaming import events as streams
from gridmill.streaming import progress, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Adding 0 makes a negative zero a plain one."""
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def _read_back(spark: SparkSession, df: DataFrame, read: Callable[[bytes], list], schema: str) -> DataFrame:
    """Rows that ``read`` finds in the files ``(file, content)``, read where the files are."""
    ship(spark)

    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in read(bytes(content))], columns=names)

    return df.select("file", "content").mapInPandas(run, schema)


def _pixels(df: DataFrame) -> DataFrame:
    return _longs(df, "x", "y", "i").select("image_id", "x", "y", "i", "v")


# --- sources -------------------------------------------------------------------------------------


@query(sql.select(sql.EVENTS, "SELECT image_id, x, y, i, v FROM r1"))
def raster_events(spark, sf_dir):
    return _pixels(events_raster(spark, sf_dir))


@query(sql.select(sql.SHIP, "SELECT image_id, x, y, i, v FROM r2"))
def raster_ship(spark, sf_dir):
    return _pixels(ship_raster(spark, sf_dir))


@query(sql.select(sql.EMBED, "SELECT image_id, x, y, i, v FROM r3"))
def raster_embed(spark, sf_dir):
    return _pixels(tables.embedding_raster(spark, sf_dir))


def _users(spark, sf_dir) -> int:
    return int(table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]) + 1


@query("""WITH c AS (SELECT CAST(user_id AS BIGINT) AS x, CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT) AS y, count(*) AS n FROM events GROUP BY 1, 2),
  w AS (SELECT max(user_id) + 1 AS w FROM events),
  g AS (SELECT a.range AS x, b.range AS y FROM range((SELECT w FROM w)) a, range(720) b)
  SELECT 'user_hour' AS image_id, g.x, g.y, CAST(g.y * w.w + g.x AS BIGINT) AS i, CAST(coalesce(c.n, 0) AS DOUBLE) AS v FROM g LEFT JOIN c ON c.x = g.x AND c.y = g.y, w""")
def raster_user_hour(spark, sf_dir):
    return _pixels(tables.user_hours(spark, sf_dir, _users(spark, sf_dir)))


@query(sql.select(sql.FILES, "SELECT ord, name, CAST(file_size AS BIGINT) AS file_size FROM fl WHERE regexp_matches(lower(name), '\\.(tiff?|png|jpe?g)$')"))
def intake_filter(spark, sf_dir):
    return planes.accepted(_files(spark, sf_dir))


def _files(spark, sf_dir) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".tif", ".TIFF", ".png", ".JPG", ".txt", ".jpeg.bak"))), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("img_"), F.col("doc_id") % 50, suffix).alias("name"), (F.col("n_chars") % 7).alias("file_size"))


@query(sql.select(sql.FILES, """SELECT ord, name, CAST(file_size AS BIGINT) AS file_size FROM (SELECT *, row_number() OVER (PARTITION BY name, file_size ORDER BY ord) AS r
  FROM fl WHERE regexp_matches(lower(name), '\\.(tiff?|png|jpe?g)$') AND ord >= 100
  AND NOT EXISTS (SELECT 1 FROM fl k WHERE k.ord < 100 AND k.name = fl.name AND k.file_size = fl.file_size)) WHERE r = 1"""))
def intake_dedup(spark, sf_dir):
    files = _files(spark, sf_dir)
    return planes.intake(files.where("ord >= 100"), files.where("ord < 100")).select("ord", "name", "file_size")


@query(sql.select(sql.FILES, """SELECT ord, c.range AS channel, CASE WHEN 1 + ord % 3 = 1 THEN name ELSE name || ' [ch' || c.range || ']' END AS image_name,
  regexp_replace(name, '\\.[^/.]+$', '') AS base FROM fl, range(3) c WHERE c.range < 1 + ord % 3"""))
def channel_names(spark, sf_dir):
    rows = planes.fan_out(_files(spark, sf_dir).withColumn("channels", (F.col("ord") % 3 + 1).cast("int")))
    return rows.select("ord", F.col("channel").cast("long").alias("channel"), "image_name", scalars.strip_extension(F.col("name")).alias("base"))


@query("SELECT vec_id, CAST((p.k - 1) % 4 AS BIGINT) AS channel, CAST((p.k - 1) // 4 AS BIGINT) AS i, CAST(embedding[p.k] AS DOUBLE) AS v FROM embeddings, (SELECT range AS k FROM range(1, 65)) p")
def deinterleave(spark, sf_dir):
    return _longs(planes.deinterleave(table(spark, sf_dir, "embeddings"), "embedding", 4, ["vec_id"]), "channel")


@query(sql.select(f"{sql.EVENTS},{sql.EMBED}", "SELECT image_id, min(v) AS data_min, max(v) AS data_max FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r3) GROUP BY 1"))
def minmax(spark, sf_dir):
    return raster.min_max(events_raster(spark, sf_dir).unionByName(tables.embedding_raster(spark, sf_dir)))


_DTYPES = ("uint8", "int8", "uint16", "int16", "uint32", "int32", "float32", "float64")


@query(sql.select(sql.EVENTS, f"""SELECT image_id, t.dtype, data_min, data_max, top AS dtype_max, CASE WHEN t.dtype LIKE 'float%' THEN 1000 ELSE 1 END AS scale,
  CASE WHEN top = floor(top) AND top >= 255 THEN 1.0 ELSE top / 1000 END AS step
  FROM (SELECT image_id, min(v) AS data_min, max(v) AS data_max FROM r1 GROUP BY 1) q,
  (VALUES {', '.join(f"('{d}', CAST({planes.DTYPE_MAX[d] if d in planes.DTYPE_MAX else 'NULL'} AS DOUBLE))" for d in _DTYPES)}) t(dtype, m),
  LATERAL (SELECT coalesce(t.m, q.data_max) AS top)"""))
def range_meta(spark, sf_dir):
    rows = raster.min_max(events_raster(spark, sf_dir)).withColumn("dtype", F.explode(F.array(*map(F.lit, _DTYPES))))
    return planes.range_metadata(rows)


@query("""SELECT p_partkey, CAST(round((0.299 * (p_partkey % 256) + 0.587 * (p_partkey * 7 % 256) + 0.114 * (p_size % 256)) * 1000) AS BIGINT) AS luma FROM part""")
def luma_expr(spark, sf_dir):
    key = F.col("p_partkey")
    grey = scalars.luma(key % 256, key * 7 % 256, F.col("p_size") % 256)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(grey * 1000).cast("long").alias("luma"))


@query(sql.select(sql.EVENTS, """SELECT image_id || '.tif [ch' || c.range || ']' AS image_id, x, y, i,
  CAST(CASE c.range WHEN 0 THEN CAST(v AS BIGINT) ELSE CAST(v AS BIGINT) * 7 + i END % 65536 AS DOUBLE) AS v FROM r1, range(2) c"""))
def src_tiff(spark, sf_dir):
    """Images of events with two channels of whole numbers, written as files and read back whole by Spark's file reader, channel by channel."""
    folder = scratch(spark, "event-files")
    v = F.col("v").cast("long")
    rows = events_raster(spark, sf_dir).withColumns({"c0": v % 65536, "c1": (v * 7 + F.col("i")) % 65536})
    ranges.save(files.tiff_ranges(rows, ["c0", "c1"], "u2", ".tif", *EVENTS_SIZE), folder)
    return _pixels(images.pixels(images.read_tiff_rows(spark, folder)))


@query(sql.select(sql.SHIP, "SELECT image_id || '.tif' AS image_id, x, y, i, v FROM r2 WHERE y BETWEEN 10 AND 29 AND image_id <> 'N'"))
def tiff_scan(spark, sf_dir):
    """Images of line items, written by ranges of pixels and scanned by strips; conditions on files and rows reach the scan."""
    folder = scratch(spark, "ship-files")
    ranges.save(files.tiff_ranges(ship_raster(spark, sf_dir), ["v"], "f8", ".tif", *SHIP_SIZE), folder)
    rows = images.scan_tiffs(spark, folder).where((F.col("y") >= 10) & (F.col("y") <= 29) & F.col("name").isin("A.tif", "R.tif"))
    return _pixels(images.pixels(rows))


# --- projections ---------------------------------------------------------------------------------


@query(sql.select(sql.SHIP, "SELECT image_id, x, y, y * 105 + x AS i FROM r2"))
def pixel_index(spark, sf_dir):
    rows = ship_raster(spark, sf_dir).select("image_id", "x", "y", scalars.pixel_index(F.col("x"), F.col("y"), SHIP_SIZE[0]).alias("i"))
    return _longs(rows, "x", "y")


@query(sql.select(sql.EMBED, "SELECT x, y, CAST(floor(v * 1000) AS BIGINT) AS fixed, CAST(floor(v * 1000) AS BIGINT) / 1000.0::DOUBLE AS decoded FROM r3"))
def fixed_point(spark, sf_dir):
    rows = tables.embedding_raster(spark, sf_dir).withColumn("fixed", scalars.fixed_point(F.col("v"), 1000))
    return _longs(rows.select("x", "y", "fixed", (F.col("fixed") / 1000).alias("decoded")), "x", "y")


@query("""SELECT o_orderkey, CAST(w % 4294967296 AS BIGINT) AS low, CAST(w // 4294967296 AS BIGINT) AS high, w AS joined
  FROM (SELECT o_orderkey, CAST(o_orderkey * 1000003 * 977 AS BIGINT) AS w FROM orders)""")
def u64_words(spark, sf_dir):
    word = (F.col("o_orderkey") * 1000003 * 977).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", scalars.low_word(word).alias("low"), scalars.high_word(word).alias("high"))
    return rows.withColumn("joined", scalars.join_words(F.col("low"), F.col("high")))


@query(sql.select(sql.EVENTS, "SELECT image_id, i, greatest(0.0, least(1.0, (v - 1.0) / greatest(4.0 - 1.0, 1e-4)))::DOUBLE AS grey, greatest(0.0, least(1.0, (v - 2.0) / 1e-4))::DOUBLE AS narrow FROM r1"))
def contrast_window(spark, sf_dir):
    grey = scalars.contrast_window(F.col("v"), F.lit(1.0), F.lit(4.0))
    return events_raster(spark, sf_dir).select("image_id", "i", grey.alias("grey"), scalars.contrast_window(F.col("v"), F.lit(2.0), F.lit(2.0)).alias("narrow"))


@query("""SELECT event_id, least(value, 40.0) AS low_moved, greatest(value, 60.0) AS high_moved FROM events""")
def window_edit(spark, sf_dir):
    """Each event's value as the new lower edge of a window up to 40, and as the new upper edge of one from 60 on."""
    value = F.col("value")
    low, high = scalars.with_low(value, F.lit(40.0)), scalars.with_high(F.lit(60.0), value)
    return table(spark, sf_dir, "events").select("event_id", low["low"].alias("low_moved"), high["high"].alias("high_moved"))


@query("SELECT x AS zoom_in, round(greatest(0.1, least(32.0, exp(-x * 0.01)))::DOUBLE, 9) AS scale, (x - 3.0 - 1.5) / 2.0 AS board, round(1 - power(1 - x / 100.0, 3), 9) AS eased FROM (SELECT CAST(p_size AS DOUBLE) AS x FROM part)")
def camera(spark, sf_dir):
    x = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select(
        x.alias("zoom_in"), scalars.zoom(F.lit(1.0), x).alias("scale"), scalars.to_board(x, F.lit(3.0), F.lit(1.5), F.lit(2.0)).alias("board"), scalars.ease_out_cubic(x / 100.0).alias("eased")
    )
    return _rounded(rows, "scale", "eased", digits=9)


@query("SELECT p_partkey, CAST(floor((p_retailprice - 10.0) * 50 / 200.0) AS INTEGER) AS px FROM part")
def client_pixel(spark, sf_dir):
    px = scalars.client_pixel(F.col("p_retailprice").cast("double"), F.lit(10.0), F.lit(50), F.lit(200.0))
    return table(spark, sf_dir, "part").select("p_partkey", px.alias("px"))


@query(sql.select(sql.EVENTS, """SELECT image_id, y * 24 + x AS i, greatest(0.0, least(1.0, (v - 1.0) / 3.0))::DOUBLE AS grey, round(1.5 + 1.6 * ln(v + 1), 9) AS radius,
  round(0.299 * v + 0.587 * x + 0.114 * y, 9)::DOUBLE AS luma FROM r1"""))
def sql_functions(spark, sf_dir):
    """The functions of SQL text."""
    scalars.register(spark)
    events_raster(spark, sf_dir).createOrReplaceTempView("gridmill_pixels")
    return spark.sql("SELECT image_id, pixel_index(x, y, 24) AS i, contrast_window(v, 1, 4) AS grey, round(marker_radius(v + 1), 9) AS radius, round(luma(v, x, y), 9) AS luma FROM gridmill_pixels")


@query("SELECT o_orderkey, strftime(o_orderdate, '%a %b ') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ') || strftime(o_orderdate, ' %H:%M:%S %Y') AS ctime FROM orders")
def project_time(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.ctime(F.col("o_orderdate")).alias("ctime"))


# --- filter bank -----------------------------------------------------------------------------------


def _kernel_sql() -> str:
    """The kernels of every scale that the sizes of parts name, with single precision at the same steps."""
    return """WITH s AS (SELECT DISTINCT p_size, CAST(p_size AS DOUBLE) / 10 AS sigma FROM part),
      k(name, share, ord) AS (VALUES ('k0', CAST(1 AS DOUBLE), 0), ('k1', CAST(1 AS DOUBLE), 1), ('k2', CAST(1 AS DOUBLE), 2), ('k0s', CAST(0.66 AS DOUBLE), 0)),
      g AS (SELECT p_size, name, ord, sigma * share AS sg, CAST(ceil((CAST(3 AS DOUBLE) + CAST(0.5 AS DOUBLE) * ord) * (sigma * share)) AS BIGINT) AS radius FROM s, k),
      d AS (SELECT *, CAST(unnest(range(-radius, radius + 1)) AS DOUBLE) AS x FROM g),
      b AS (SELECT *, exp(-(x * x) / (2 * sg * sg)) AS bell FROM d),
      f AS (SELECT *, CAST(CASE ord WHEN 0 THEN bell WHEN 1 THEN (-x / (sg * sg)) * bell ELSE (x * x / (sg * sg * sg * sg) - 1 / (sg * sg)) * bell END AS FLOAT) AS w0 FROM b),
      m AS (SELECT *, CASE WHEN ord = 2 THEN w0 - CAST(avg(CAST(w0 AS DOUBLE)) OVER (PARTITION BY p_size, name) AS FLOAT) ELSE w0 END AS w1 FROM f),
      n AS (SELECT *, CAST(sum(CASE ord WHEN 0 THEN bell WHEN 1 THEN x * w1 ELSE x * x * w1 / 2 END) OVER (PARTITION BY p_size, name) AS FLOAT) AS total FROM m)
    SELECT CAST(p_size AS BIGINT) AS size, name, CAST(x AS BIGINT) AS d, round(CAST(w1 / total AS DOUBLE), 5) + 0.0 AS w FROM n"""


@query(_kernel_sql())
def kernel_table(spark, sf_dir):
    """Kernels of the scales that a table names, a tenth of its sizes each, made by the tasks that hold the sizes."""
    ship(spark)

    def make(frames):
        for frame in frames:
            for size in frame["size"].tolist():
                yield pd.DataFrame([(size, n, d, w) for n, k in filters.kernels(size / 10).items() for d, w in k.items()], columns=["size", "name", "d", "w"])

    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("size")).distinct()
    return _rounded(sizes.mapInPandas(make, "size long, name string, d long, w double"), "w", digits=5)


def _features(spark, sf_dir) -> DataFrame:
    return filters.features(events_raster(spark, sf_dir), SIGMA)


def _round_sql(ctes: str, table_: str, names: list[str]) -> str:
    return sql.select(ctes, f"SELECT image_id, i, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in names)} FROM {table_}")


_H = ["h0", "h1", "h2", "h0s"]
_V = ["l", "lx", "lxx", "ly", "lxy", "lyy", "lsub"]


@query(_round_sql(sql.FILTERS, "hpass", _H))
def conv_h(spark, sf_dir):
    return _rounded(filters.horizontal(events_raster(spark, sf_dir), SIGMA), *_H).select("image_id", "i", *_H)


@query(_round_sql(sql.FILTERS, "vpass", _V))
def conv_v(spark, sf_dir):
    return _rounded(filters.vertical(filters.horizontal(events_raster(spark, sf_dir), SIGMA), SIGMA), *_V).select("image_id", "i", *_V)


@query(_round_sql(sql.FILTERS, "hpass", _H))
def conv_h_tiled(spark, sf_dir):
    """The same in tiles of 7 pixels with halos."""
    return _rounded(filters.horizontal(events_raster(spark, sf_dir), SIGMA, tile=7), *_H).select("image_id", "i", *_H)


@query(_round_sql(sql.FILTERS, "vpass", _V))
def conv_v_tiled(spark, sf_dir):
    rows = filters.horizontal(events_raster(spark, sf_dir), SIGMA, tile=7)
    return _rounded(filters.vertical(rows, SIGMA, tile=11), *_V).select("image_id", "i", *_V)


def _feature_query(name: str, columns: list[str]) -> None:
    def run(spark, sf_dir):
        return _rounded(_features(spark, sf_dir), *columns).select("image_id", "i", *columns)

    run.__name__ = name
    query(_round_sql(sql.FILTERS, "feat", columns))(run)


for _name, _columns in (
    ("feat_gaussian", ["f0"]), ("feat_log", ["f1"]), ("feat_gradmag", ["f2"]), ("feat_dog", ["f3"]), ("feat_structure", ["f4"]),
    ("feat_hessian", ["f6", "f7"]), ("features_all", ["v", "f0", "f1", "f2", "f3", "f4", "f5", "f6", "f7"]),
):
    _feature_query(_name, _columns)


@query(_round_sql(sql.FILTERS, "feat", RASTER_FEATURES))
def features_stored(spark, sf_dir):
    """Features written once to the shared folder and read from there."""
    stored = materialize(_features(spark, sf_dir), "features")
    return _rounded(stored, *RASTER_FEATURES).select("image_id", "i", *RASTER_FEATURES)


# --- labels ----------------------------------------------------------------------------------------


def _strokes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("image_id"), F.hour("ts").alias("x"), (F.dayofmonth("ts") - 1).alias("y"), (F.col("user_id") % 4).cast("int").alias("cls")
    )


def _painted(spark, sf_dir) -> DataFrame:
    mark = 7 * F.col("x") + 13 * F.col("y")
    return events_raster(spark, sf_dir).where(mark % 11 == 0).select("image_id", "x", "y", "i", (mark % 4).cast("int").alias("cls"))


def _brush_sql(r: float) -> str:
    return sql.select(sql.STROKES, f"""SELECT event_id, x + a.range AS px, y + b.range AS py FROM st, range(-2, 3) a, range(-2, 3) b
      WHERE event_id % 10 = 0 AND a.range * a.range + b.range * b.range <= {r * r} AND x + a.range BETWEEN 0 AND 23 AND y + b.range BETWEEN 0 AND 29""")


@query(_brush_sql(2.0).replace("event_id % 10 = 0 AND ", ""))
def brush_disc(spark, sf_dir):
    return _longs(labels.brush(_strokes(spark, sf_dir), 2.0, *EVENTS_SIZE), "px", "py").select("event_id", "px", "py")


@query(sql.select(sql.LATEST, "SELECT image_id, x, y, cls FROM last"))
def label_upsert(spark, sf_dir):
    return _longs(labels.keep_latest(_strokes(spark, sf_dir), ["ts", "event_id"]), "x", "y", "cls")


@query(sql.select(f"{sql.PAINTED}, {sql.STROKES}", "SELECT image_id, x, y, CAST(cls AS BIGINT) AS cls FROM lbl WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.image_id = lbl.image_id AND st.x = lbl.x AND st.y = lbl.y AND st.cls = 0)"))
def label_erase(spark, sf_dir):
    kept = labels.erase(_painted(spark, sf_dir), _strokes(spark, sf_dir).where("cls = 0"))
    return _longs(kept, "x", "y", "cls").select("image_id", "x", "y", "cls")


@query(sql.select(f"{sql.LATEST}", """SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
  '[' || min(y) || ':' || (max(y) + 1) || ',' || min(x) || ':' || (max(x) + 1) || ',0:1]' AS slice FROM last GROUP BY 1"""))
def label_bbox(spark, sf_dir):
    boxes = labels.bounding_boxes(labels.keep_latest(_strokes(spark, sf_dir), ["ts", "event_id"]))
    c = F.col
    return _longs(boxes.withColumn("slice", scalars.block_slice(c("x0"), c("x1"), c("y0"), c("y1"))), "x0", "x1", "y0", "y1")


@query(sql.select(sql.PAINTED, """SELECT b.image_id, gx.range AS x, gy.range AS y, CAST(coalesce(lbl.cls + 1, 0) AS BIGINT) AS code
  FROM (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lbl GROUP BY 1) b JOIN range(24) gx ON gx.range BETWEEN b.x0 AND b.x1 JOIN range(30) gy ON gy.range BETWEEN b.y0 AND b.y1
  LEFT JOIN lbl ON lbl.image_id = b.image_id AND lbl.x = gx.range AND lbl.y = gy.range"""))
def label_block(spark, sf_dir):
    return _longs(labels.blocks(_painted(spark, sf_dir)), "x", "y", "code").select("image_id", "x", "y", "code")


@query(sql.select(sql.PAINTED, "SELECT count(*) AS labels, count(*) >= 5 AS enough FROM lbl"))
def label_totals(spark, sf_dir):
    return labels.totals(_painted(spark, sf_dir))


@query(sql.select(f"{sql.FILTERS}, {sql.LATEST}, lbl AS (SELECT image_id, y * 24 + x AS i, cls FROM last)",
  "SELECT image_id, i, CAST(cls AS BIGINT) AS cls, " + ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in RASTER_FEATURES) + " FROM feat JOIN lbl USING (image_id, i)"))
def gather_features(spark, sf_dir):
    """Features where strokes left a label, on all images."""
    left = labels.keep_latest(_strokes(spark, sf_dir), ["ts", "event_id"]).select("image_id", scalars.pixel_index(F.col("x"), F.col("y"), EVENTS_SIZE[0]).alias("i"), "cls")
    return _longs(_rounded(pipeline.training_set(_features(spark, sf_dir), left), *RASTER_FEATURES), "cls")


@query(sql.select(f"{sql.FILTERS}, lbl AS (SELECT image_id, i, (7 * x + 13 * y) % 4 AS cls FROM r1 WHERE (7 * x + 13 * y) % 11 = 0)",
  "SELECT image_id, i, CAST(cls AS BIGINT) AS cls, " + ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in RASTER_FEATURES) + " FROM feat JOIN lbl USING (image_id, i)"))
def training_set(spark, sf_dir):
    rows = pipeline.training_set(_features(spark, sf_dir), _painted(spark, sf_dir).select("image_id", "i", "cls"))
    return _longs(_rounded(rows, *RASTER_FEATURES), "cls")


def _stroke_labels(spark, sf_dir) -> DataFrame:
    """What strokes left, with their order."""
    order = ["ts", "event_id"]
    return labels.keep_latest(_strokes(spark, sf_dir), order, order).withColumn("i", scalars.pixel_index(F.col("x"), F.col("y"), EVENTS_SIZE[0]))


@query(sql.select(sql.STROKES, """SELECT image_id, x, y, cls, row_number() OVER (ORDER BY image_id, ts, event_id) - 1 AS row FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY ts DESC, event_id DESC) AS r FROM st)
  WHERE r = 1"""))
def label_order(spark, sf_dir):
    """Labels as they were painted, image by image; a pixel that is painted again goes to the end."""
    rows = pipeline.numbered(_stroke_labels(spark, sf_dir), ["image_id", "ts", "event_id"])
    return _longs(rows, "x", "y", "cls").select("image_id", "x", "y", "cls", "row")


# --- forest ------------------------------------------------------------------------------------------


def _embed(spark, sf_dir) -> DataFrame:
    e = [F.col("embedding")[k].cast("double").alias(f) for k, f in enumerate(EMBED_FEATURES)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *e, (F.col("label") % 4).cast("int").alias("cls"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT t.range AS tree, k.range AS k, (t.range * 7919 + k.range * 104729 + 1) % 2147483648 AS s0, n FROM n, range(8) t, range((SELECT n FROM n)) k)
  SELECT tree, k, CAST(((((s0 * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) // 65536 % n AS BIGINT) AS row FROM s""")
def bootstrap(spark, sf_dir):
    return _longs(forest.bootstrap(table(spark, sf_dir, "embeddings"), 8), "tree")


@query(f"""WITH {sql.EMBED_ROWS}, c AS (SELECT vec_id % 7 AS g, cls, count(*) AS n FROM emb GROUP BY 1, 2)
  SELECT g, CAST(sum(n) AS BIGINT) AS size, round(1 - sum(CAST(n AS DOUBLE) * n) / power(CAST(sum(n) AS DOUBLE), 2), 9) AS gini FROM c GROUP BY 1""")
def gini(spark, sf_dir):
    return forest.class_shares(_embed(spark, sf_dir).withColumn("g", F.col("vec_id") % 7), "g").select("g", "size", F.round("gini", 9).alias("gini"))


@query(f"WITH {sql.EMBED_ROWS} SELECT vec_id % 97 AS g, count(DISTINCT cls) = 1 AS pure FROM emb GROUP BY 1")
def purity(spark, sf_dir):
    return forest.class_shares(_embed(spark, sf_dir).withColumn("g", F.col("vec_id") % 97), "g").select("g", "pure")


@query(f"""WITH {sql.EMBED_ROWS}, c AS (SELECT vec_id % 7 AS g, cls, count(*) AS n FROM emb GROUP BY 1, 2)
  SELECT g, CAST(cls AS BIGINT) AS majority FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, cls) AS r FROM c) WHERE r = 1""")
def majority_class(spark, sf_dir):
    shares = forest.class_shares(_embed(spark, sf_dir).withColumn("g", F.col("vec_id") % 7), "g")
    return _longs(shares.select("g", "majority"), "majority")


def _split_sql(groups: str) -> str:
    """Every midpoint's impurity by running counts, for rows grouped by ``g``."""
    long = " UNION ALL ".join(f"SELECT {groups} AS g, cls, {k} AS feature, {f} AS value FROM emb" for k, f in enumerate(EMBED_FEATURES))
    cell = ", ".join(f"sum(CASE WHEN cls = {c} THEN 1 ELSE 0 END) AS c{c}" for c in range(4))
    upto = ", ".join(f"CAST(sum(c{c}) OVER w AS DOUBLE) AS l{c}, CAST(sum(c{c}) OVER (PARTITION BY g, feature) AS DOUBLE) AS t{c}" for c in range(4))
    nl, nt = "(0 + l0 + l1 + l2 + l3)", "(0 + t0 + t1 + t2 + t3)"
    gl = " + ".join(["0.0", *(f"(l{c} / {nl}) * (l{c} / {nl})" for c in range(4))])
    gr = " + ".join(["0.0", *(f"((t{c} - l{c}) / ({nt} - {nl})) * ((t{c} - l{c}) / ({nt} - {nl}))" for c in range(4))])
    return f"""{sql.EMBED_ROWS}, long AS ({long}), cell AS (SELECT g, feature, value, {cell} FROM long GROUP BY 1, 2, 3),
      run AS (SELECT g, feature, (value + lead(value) OVER w) / 2 AS threshold, {upto} FROM cell WINDOW w AS (PARTITION BY g, feature ORDER BY value)),
      imp AS (SELECT g, feature, threshold, ({nl} / {nt}) * (1.0 - ({gl})) + (({nt} - {nl}) / {nt}) * (1.0 - ({gr})) AS impurity FROM run WHERE threshold IS NOT NULL),
      best AS (SELECT g, feature, threshold, impurity FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY impurity, feature, threshold) AS r FROM imp) WHERE r = 1)"""


@query(f"WITH {_split_sql('0')} SELECT CAST(feature AS BIGINT) AS feature, round(threshold, 9) AS threshold, round(impurity, 9) AS impurity FROM best")
def best_split(spark, sf_dir):
    best = forest.best_splits(_embed(spark, sf_dir).withColumn("g", F.lit(0)), EMBED_FEATURES, 4, ["g"])
    return best.select(F.col("feature").cast("long").alias("feature"), F.round("threshold", 9).alias("threshold"), F.round("impurity", 9).alias("impurity"))


@query(f"""WITH {_split_sql('vec_id % 5')}, side AS (SELECT emb.vec_id % 5 AS g, CASE WHEN CASE best.feature {' '.join(f'WHEN {k} THEN {f}' for k, f in enumerate(EMBED_FEATURES))} END < best.threshold THEN 0 ELSE 1 END AS side, cls
    FROM emb JOIN best ON best.g = emb.vec_id % 5), n AS (SELECT g, side, cls, count(*) AS n FROM side GROUP BY 1, 2, 3)
  SELECT g, CAST(side AS BIGINT) AS side, CAST(cls AS BIGINT) AS cls FROM (SELECT *, row_number() OVER (PARTITION BY g, side ORDER BY n DESC, cls) AS r FROM n) WHERE r = 1""")
def tree_depth1(spark, sf_dir):
    """Stumps of groups: the class on each side of the best split."""
    rows = _embed(spark, sf_dir).withColumn("g", F.col("vec_id") % 5)
    best = forest.best_splits(rows, EMBED_FEATURES, 4, ["g"])
    value = F.element_at(F.array(*EMBED_FEATURES), F.col("feature") + 1)
    sided = rows.join(best, "g").withColumn("side", F.when(value < F.col("threshold"), 0).otherwise(1))
    counts = sided.groupBy("g", "side", "cls").agg(F.count("*").alias("n"))
    top = counts.groupBy("g", "side").agg((-F.max(F.struct("n", (-F.col("cls")).alias("c")))["c"]).alias("cls"))
    return _longs(top, "side", "cls")


def _forest_ctes(trees: int, depth: int, samples: str = sql.EMBED_ROWS) -> str:
    """Bootstrap, then every open node of a level split at once; nodes are numbered by their paths, left before right.

    ``samples`` ends with ``emb``, whose ``vec_id`` orders the rows.
    """
    names = ", ".join(EMBED_FEATURES)
    side = f"CASE b.feature {' '.join(f'WHEN {k} THEN s.{f}' for k, f in enumerate(EMBED_FEATURES))} END < b.threshold"
    steps = [f"""{samples}, rows AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, {names}, cls FROM emb), n AS (SELECT count(*) AS n FROM emb),
      dr AS (SELECT t.range AS tree, k.range AS k, (t.range * 7919 + k.range * 104729 + 1) % 2147483648 AS s0, n FROM n, range({trees}) t, range((SELECT n FROM n)) k),
      bs AS (SELECT tree, CAST(((((s0 * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648) // 65536 % n AS BIGINT) AS row FROM dr),
      s0 AS (SELECT tree, '' AS path, {names}, cls FROM bs JOIN rows USING (row))"""]
    for d in range(depth + 1):
        steps.append(f"""c{d} AS (SELECT tree, path, cls, count(*) AS n FROM s{d} GROUP BY 1, 2, 3),
          t{d} AS (SELECT tree, path, sum(n) AS n, count(*) AS kinds, arg_min(cls, (-n, cls)) AS majority FROM c{d} GROUP BY 1, 2)""")
        if d == depth:
            steps.append(f"n{d} AS (SELECT tree, path, -1 AS feature, 0.0::DOUBLE AS threshold, majority AS cls FROM t{d})")
            continue
        body = _split_sql("g").split("long AS", 1)[1].replace("FROM emb", f"FROM e{d}")
        for name in ("cell", "run", "imp", "best"):
            body = body.replace(f"{name} AS (", f"{name}{d} AS (").replace(f"FROM {name} ", f"FROM {name}{d} ").replace(f"FROM {name})", f"FROM {name}{d})")
        body = body.replace("FROM long ", f"FROM long{d} ")
        steps.append(f"""e{d} AS (SELECT tree || ':' || path AS g, {names}, cls FROM s{d} JOIN (SELECT tree, path FROM t{d} WHERE n >= 2 AND kinds > 1) USING (tree, path)), long{d} AS {body},
          n{d} AS (SELECT t.tree, t.path, coalesce(b.feature, -1) AS feature, coalesce(b.threshold, 0.0)::DOUBLE AS threshold, CASE WHEN b.g IS NULL THEN majority ELSE -1 END AS cls
            FROM t{d} t LEFT JOIN best{d} b ON b.g = t.tree || ':' || t.path),
          s{d + 1} AS (SELECT s.tree, s.path || CASE WHEN {side} THEN 'L' ELSE 'R' END AS path, {", ".join(f"s.{f}" for f in EMBED_FEATURES)}, s.cls FROM s{d} s JOIN best{d} b ON b.g = s.tree || ':' || s.path)""")
    every = " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(depth + 1))
    return f"""{", ".join(steps)}, numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS node FROM ({every})),
      nodes AS (SELECT a.tree, a.node, CAST(a.feature AS BIGINT) AS feature, a.threshold, CASE WHEN a.feature < 0 THEN -1 ELSE a.node + 1 END AS "left", CASE WHEN a.feature < 0 THEN -1 ELSE r.node END AS "right", CAST(a.cls AS BIGINT) AS cls
      FROM numbered a LEFT JOIN numbered r ON r.tree = a.tree AND r.path = a.path || 'R')"""


def _forest_sql(trees: int, depth: int, samples: str = sql.EMBED_ROWS) -> str:
    return f"WITH {_forest_ctes(trees, depth, samples)} SELECT * FROM nodes"


@query(_forest_sql(8, 8))
def forest_train(spark, sf_dir):
    rows = pipeline.numbered(_embed(spark, sf_dir), ["vec_id"])
    return _longs(forest.train(rows, EMBED_FEATURES), "tree", "node", "feature", "left", "right", "cls")


@query(_forest_sql(8, 8))
def forest_train_by_levels(spark, sf_dir):
    """The same forest, grown by all executors together as beyond a task's samples."""
    rows = pipeline.numbered(_embed(spark, sf_dir), ["vec_id"])
    return _longs(forest.train_by_levels(rows, EMBED_FEATURES), "tree", "node", "feature", "left", "right", "cls")


def _raster_rows(labels_: str, order: str) -> str:
    """Labelled pixels as training rows: features of 6 digits, in single precision."""
    values = ", ".join(f"CAST(CAST(round({f}, 6) + 0.0 AS FLOAT) AS DOUBLE) AS {e}" for f, e in zip(RASTER_FEATURES, EMBED_FEATURES, strict=True))
    return f"{sql.FILTERS}, {labels_}, emb AS (SELECT row_number() OVER (ORDER BY {order}) AS vec_id, {values}, lbl.cls FROM feat JOIN lbl USING (image_id, i))"


_STROKE_LABELS = f"{sql.STROKES}, lbl AS (SELECT image_id, y * 24 + x AS i, cls, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY ts DESC, event_id DESC) AS r FROM st) WHERE r = 1)"


@query(_forest_sql(4, 5, _raster_rows(_STROKE_LABELS, "lbl.image_id, lbl.ts, lbl.event_id")))
def forest_in_painting_order(spark, sf_dir):
    """Trees draw rows by number, and rows are numbered as they were painted."""
    features = _rounded(_features(spark, sf_dir), *RASTER_FEATURES)
    rows = pipeline.training_set(features, _stroke_labels(spark, sf_dir))
    nodes = forest.train(pipeline.numbered(rows, ["image_id", "ts", "event_id"]), RASTER_FEATURES, forest.ForestConfig(4, 5))
    return _longs(nodes, "tree", "node", "feature", "left", "right", "cls")


_WALKED = f"""{_forest_ctes(8, 8, _raster_rows("lbl AS (SELECT image_id, i, (7 * x + 13 * y) % 4 AS cls FROM r1 WHERE (7 * x + 13 * y) % 11 = 0)", "lbl.image_id, lbl.i"))},
  fx AS (SELECT image_id, x, y, i, v, [{", ".join(f"round({f}, 6) + 0.0" for f in RASTER_FEATURES)}] AS f FROM feat),
  walk(image_id, i, tree, node) AS (SELECT image_id, i, t.range, 0::BIGINT FROM fx, range(8) t
    UNION ALL SELECT w.image_id, w.i, w.tree, CASE WHEN fx.f[n.feature + 1] < n.threshold THEN n."left" ELSE n."right" END FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
      JOIN fx ON fx.image_id = w.image_id AND fx.i = w.i WHERE n.feature >= 0),
  votes AS (SELECT w.image_id, w.i, n.cls, count(*) AS n FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY 1, 2, 3),
  m AS (SELECT votes.image_id, votes.cls, fx.x, fx.y, fx.i, fx.v FROM votes JOIN fx ON fx.image_id = votes.image_id AND fx.i = votes.i WHERE votes.n >= 4)"""


@query(sql.select(sql.components_of(_WALKED), "SELECT CAST(c.range AS BIGINT) AS cls, count(obj.label) AS objects FROM range(4) c LEFT JOIN obj ON obj.cls = c.range GROUP BY 1"))
def retrain(spark, sf_dir):
    """Train on painted pixels of all images, classify every pixel, count each class's objects."""
    painted = _painted(spark, sf_dir).select("image_id", "i", "cls")
    return _longs(pipeline.retrain_on(_rounded(_features(spark, sf_dir), *RASTER_FEATURES), painted, *EVENTS_SIZE), "cls")


_NODES = f"n(tree, node, feature, threshold, l, r, cls) AS (VALUES {', '.join(str(n) for n in FOREST)})"


@query(sql.select(f"""{sql.EMBED_ROWS}, {_NODES}, e AS (SELECT vec_id, CAST(unnest(range(8)) AS INTEGER) AS feature, unnest([{', '.join(EMBED_FEATURES)}]) AS v FROM emb),
  w0 AS (SELECT vec_id, tree, 0 AS node FROM emb, (SELECT DISTINCT tree FROM n)),
  w1 AS (SELECT vec_id, tree, CASE WHEN v < threshold THEN l ELSE r END AS node FROM w0 JOIN n USING (tree, node) JOIN e USING (vec_id, feature)),
  w2 AS (SELECT vec_id, tree, CASE WHEN v < threshold THEN l ELSE r END AS node FROM w1 JOIN n USING (tree, node) JOIN e USING (vec_id, feature)),
  w AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)""",
  "SELECT CAST(n.tree AS BIGINT) AS tree, CAST(n.node AS BIGINT) AS node, count(w.vec_id) AS reached FROM n LEFT JOIN w USING (tree, node) GROUP BY 1, 2"))
def forest_nodes(spark, sf_dir):
    """How many embeddings come by each node of a forest."""
    return _longs(forest.node_counts(_embed(spark, sf_dir), FOREST, EMBED_FEATURES), "tree", "node")


def _classified(spark, sf_dir) -> DataFrame:
    return forest.probabilities(_features(spark, sf_dir), FOREST, RASTER_FEATURES)


_P = ["p0", "p1", "p2", "p3"]
_ARGMAX = "CASE WHEN p0 >= greatest(p0, p1, p2, p3) THEN 0 WHEN p1 >= greatest(p0, p1, p2, p3) THEN 1 WHEN p2 >= greatest(p0, p1, p2, p3) THEN 2 ELSE 3 END"


@query(sql.select(sql.CLASSIFIED, "SELECT image_id, i, p0, p1, p2, p3 FROM prob"))
def forest_probs(spark, sf_dir):
    return _classified(spark, sf_dir).select("image_id", "i", *_P)


@query(sql.select(sql.CLASSIFIED, "SELECT image_id, i, p0, p1, p2, p3 FROM prob"))
def forest_probs_by_arrow(spark, sf_dir):
    """The same in Arrow batches, as for forests too large for an expression."""
    rows = forest.probabilities_by_arrow(_features(spark, sf_dir), FOREST, RASTER_FEATURES)
    return rows.select("image_id", "i", *_P)


@query(f"""WITH {_forest_ctes(8, 8)}, o AS (SELECT *, row_number() OVER (ORDER BY tree, node) - 1 AS slot, (row_number() OVER (ORDER BY tree, node) - 1) - node AS first FROM nodes)
  SELECT slot, CAST(feature AS BIGINT) AS feature, CASE WHEN feature < 0 THEN 0.0 ELSE threshold END::DOUBLE AS threshold,
    CAST(CASE WHEN feature < 0 THEN -1 ELSE first + "left" END AS BIGINT) AS "left", CAST(CASE WHEN feature < 0 THEN -(cls + 1) ELSE first + "right" END AS BIGINT) AS "right", node = 0 AS root FROM o""")
def forest_flat(spark, sf_dir):
    """A forest trained on embeddings in its flat layout, as it is handed to inference."""
    trained = forest.train(pipeline.numbered(_embed(spark, sf_dir), ["vec_id"]), EMBED_FEATURES)
    slots, roots = forest.to_flat(forest.collect_forest(trained))
    return spark.createDataFrame([(k, *map(float, slot[1:2]), slot[0], slot[2], slot[3], k in roots) for k, slot in enumerate(slots)], "slot long, threshold double, feature long, left long, right long, root boolean")


@query(f"WITH {sql.EMBED_PROB} SELECT vec_id, CAST({_ARGMAX} AS BIGINT) AS cls FROM prob")
def forest_predict(spark, sf_dir):
    rows = forest.probabilities(_embed(spark, sf_dir).drop("cls"), FOREST, EMBED_FEATURES)
    return rows.select("vec_id", scalars.argmax_class([F.col(p) for p in _P]).cast("long").alias("cls"))


@query(sql.select(sql.CLASSIFIED, f"SELECT image_id, i, CAST({_ARGMAX} AS BIGINT) AS cls FROM prob"))
def argmax_class(spark, sf_dir):
    return _longs(render.with_class(_classified(spark, sf_dir)).select("image_id", "i", "cls"), "cls")


# --- masks, components, objects ----------------------------------------------------------------------


def _labelled(spark, sf_dir) -> DataFrame:
    return ccl.label_components(raster.at_least_mean(events_raster(spark, sf_dir)), *EVENTS_SIZE)


def _objects(spark, sf_dir) -> DataFrame:
    return objects.object_stats(_labelled(spark, sf_dir))


def _class_objects(spark, sf_dir) -> DataFrame:
    return pipeline.class_objects(_classified(spark, sf_dir), *EVENTS_SIZE)


@query(sql.select(sql.CLASS_MASK, "SELECT image_id, CAST(cls AS BIGINT) AS cls, i FROM m"))
def mask_threshold(spark, sf_dir):
    return _longs(pipeline.class_masks(_classified(spark, sf_dir)).select("image_id", "cls", "i"), "cls")


@query(sql.select(sql.CLASSIFIED, " UNION ALL ".join(f"SELECT image_id, {c}::BIGINT AS cls, i FROM prob WHERE p{c} >= 0.25" for c in range(4))))
def mask_membership(spark, sf_dir):
    """At a quarter of the votes a pixel may be in several classes' masks."""
    return _longs(pipeline.class_masks(_classified(spark, sf_dir), threshold=0.25), "cls", "i").select("image_id", "cls", "i")


@query(sql.select(f"{sql.SHIP}, m AS (SELECT r2.image_id, r2.x, r2.y, r2.i FROM r2 JOIN (SELECT image_id, avg(v) AS a FROM r2 GROUP BY 1) q USING (image_id) WHERE r2.v >= q.a)",
  "SELECT a.image_id, a.i AS a, b.i AS b FROM m a JOIN m b ON b.image_id = a.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))"))
def neighbor_edges(spark, sf_dir):
    return ccl.neighbor_edges(raster.at_least_mean(ship_raster(spark, sf_dir)))


@query(sql.select(sql.OBJECTS, "SELECT image_id, i, label FROM lab"))
def ccl_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("image_id", "i", "label")


@query(sql.select(sql.OBJECTS, "SELECT image_id, i, label FROM lab"))
def ccl_tiles(spark, sf_dir):
    """The same components from tiles of 7 x 7 pixels, joined across their borders."""
    mask = raster.at_least_mean(events_raster(spark, sf_dir))
    return ccl.label_components(mask, *EVENTS_SIZE, tile=7).select("image_id", F.col("i").cast("long").alias("i"), "label")


@query(sql.select(sql.OBJECTS, "SELECT image_id, i, CAST(coalesce(lab.label, 0) AS BIGINT) AS label FROM r1 LEFT JOIN lab USING (image_id, i)"))
def ccl_label_map(spark, sf_dir):
    return ccl.label_map(events_raster(spark, sf_dir), _labelled(spark, sf_dir))


@query(sql.select(sql.OBJECTS, "SELECT image_id, max(label) AS max_label FROM lab GROUP BY 1"))
def max_label(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("image_id").agg(F.max("label").alias("max_label"))


_STATS = "label, area, total, sum_x, sum_y, min_v, max_v"


@query(sql.select(sql.OBJECTS, f"SELECT image_id, {_STATS} FROM obj"))
def object_stats(spark, sf_dir):
    return _objects(spark, sf_dir)


@query(sql.select(sql.OBJECTS, "SELECT image_id, label, area, sum_x / area AS cx, sum_y / area AS cy FROM obj"))
def object_centroids(spark, sf_dir):
    return objects.centroids(_objects(spark, sf_dir)).select("image_id", "label", "area", "cx", "cy")


@query(sql.select(sql.OBJECTS, "SELECT image_id, label, total / area / 2 AS avg_intensity, min_v / 2 AS min_intensity, max_v / 2 AS max_intensity FROM obj"))
def object_intensity(spark, sf_dir):
    return objects.intensities(_objects(spark, sf_dir), 2).select("image_id", "label", "avg_intensity", "min_intensity", "max_intensity")


@query(sql.select(sql.OBJECTS, "SELECT image_id, label, round(1.5 + 1.6 * ln(area), 9) AS radius FROM obj"))
def marker_radius(spark, sf_dir):
    return objects.markers(_objects(spark, sf_dir)).select("image_id", "label", F.round("radius", 9).alias("radius"))


@query(sql.select(sql.CLASS_OBJECTS, "SELECT image_id, CAST(cls AS BIGINT) AS cls, label, area FROM obj WHERE cls <> 1"))
def markers_visible(spark, sf_dir):
    visible = spark.createDataFrame([(1, False), (2, True)], "cls int, visible boolean")
    return _longs(objects.markers(_class_objects(spark, sf_dir), visible).select("image_id", "cls", "label", "area"), "cls")


@query(sql.select(sql.OBJECTS, "SELECT image_id, label, area, sum_x / area AS cx, round(1.5 + 1.6 * ln(area), 9) AS radius FROM obj WHERE label % 4 <> 1"))
def markers_shown(spark, sf_dir):
    """Objects of four classes, of which one is hidden and one has no setting."""
    visible = spark.createDataFrame([(1, False), (2, True), (3, True)], "cls int, visible boolean")
    found = _objects(spark, sf_dir).withColumn("cls", (F.col("label") % 4).cast("int"))
    return objects.markers(found, visible).select("image_id", "label", "area", "cx", F.round("radius", 9).alias("radius"))


_COUNTS = "SELECT c.range AS cls, count(obj.label) AS objects FROM range(4) c LEFT JOIN obj ON obj.cls = c.range GROUP BY 1"


@query(sql.select(sql.CLASS_OBJECTS, _COUNTS))
def class_counts(spark, sf_dir):
    return _longs(objects.class_counts(_class_objects(spark, sf_dir), 4), "cls")


@query(sql.select(sql.CLASS_OBJECTS, "SELECT coalesce(image_id, 'all') AS image_id, coalesce(CAST(cls AS VARCHAR), 'all') AS cls, count(*) AS objects, CAST(sum(area) AS BIGINT) AS area FROM obj GROUP BY ROLLUP (image_id, obj.cls)"))
def class_counts_rollup(spark, sf_dir):
    rows = objects.counts_rollup(_class_objects(spark, sf_dir))
    return rows.withColumns({"image_id": F.coalesce("image_id", F.lit("all")), "cls": F.coalesce(F.col("cls").cast("string"), F.lit("all"))})


@query(sql.select(sql.OBJECTS, f"SELECT image_id, {_STATS}, place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) AS place FROM obj) WHERE place <= 5"))
def largest_objects(spark, sf_dir):
    return _longs(objects.largest(_objects(spark, sf_dir), 5), "place")


@query(sql.select(sql.CLASS_OBJECTS, _COUNTS))
def pipeline_end_to_end(spark, sf_dir):
    return _longs(pipeline.count_objects(events_raster(spark, sf_dir), FOREST, *EVENTS_SIZE, SIGMA), "cls")


# --- output ------------------------------------------------------------------------------------------


@query(sql.select(sql.CLASSIFIED, f"SELECT image_id, i, CAST({_ARGMAX} + 1 AS BIGINT) AS code FROM prob"))
def segmentation(spark, sf_dir):
    return _longs(render.segmentation(_classified(spark, sf_dir)), "code").select("image_id", "i", "code")


@query(sql.select(sql.CLASSIFIED, "SELECT r1.image_id, r1.i, " + ", ".join(f"coalesce(prob.{p}, -1.0)::DOUBLE AS {p}" for p in _P) + " FROM r1 LEFT JOIN prob ON prob.image_id = r1.image_id AND prob.i = r1.i"))
def probabilities(spark, sf_dir):
    grid = events_raster(spark, sf_dir).select("image_id", "i")
    return render.stored_probabilities(grid, _classified(spark, sf_dir))


_EXPORT_SQL = sql.select(sql.CLASSIFIED, f"""SELECT image_id || '_segmentation.tif' AS file, i, CAST(0 AS BIGINT) AS channel, CAST({_ARGMAX} + 1 AS DOUBLE) AS v FROM prob
  UNION ALL SELECT image_id || '_probabilities.tif', i, c.range, CAST(CAST(CASE c.range WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS FLOAT) AS DOUBLE) FROM prob, range(4) c""")


def _export_ranges(spark, sf_dir) -> DataFrame:
    classified = materialize(_classified(spark, sf_dir), "classified")
    return files.segmentation_ranges(render.segmentation(classified), *EVENTS_SIZE).unionByName(files.probability_ranges(classified, *EVENTS_SIZE))


@query(_EXPORT_SQL)
def exported_files(spark, sf_dir):
    """What stands in the TIFF files that classified images are exported to: written by ranges, scanned by strips."""
    folder = scratch(spark, "export")
    ranges.save(_export_ranges(spark, sf_dir), folder)
    rows = images.scan_tiffs(spark, folder).select(F.col("name").alias("file"), "y", "x0", "width", F.col("channel").cast("long").alias("channel"), F.posexplode("row").alias("at", "v"))
    return rows.select("file", (F.col("y").cast("long") * F.col("width") + F.col("x0") + F.col("at")).alias("i"), "channel", "v")


@query(_EXPORT_SQL)
def archived_files(spark, sf_dir):
    """The same from the members of a ZIP file whose ranges were deflated in tasks."""
    folder = scratch(spark, "archive")
    ranges.save(files.zip_ranges(_export_ranges(spark, sf_dir), "images.zip"), folder)

    def members(frames):
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"file": z.namelist(), "content": [z.read(n) for n in z.namelist()]})

    found = spark.read.format("binaryFile").load(f"{folder}/images.zip").select("content").mapInPandas(members, "file string, content binary")

    def samples(content: bytes) -> list[tuple]:
        plane = tiff.decode(content).samples
        return [(k, c, float(v)) for (k, c), v in np.ndenumerate(plane.reshape(-1, plane.shape[2]))]

    return _read_back(spark, found, samples, "file string, i long, channel long, v double")


_RGB = [tuple(bytes.fromhex(c[1:])) for c in CLASS_COLORS]
_PALETTE = "pal(cls, r, g, b) AS (VALUES " + ", ".join(f"({k}, {r} / 255.0::DOUBLE, {g} / 255.0::DOUBLE, {b} / 255.0::DOUBLE)" for k, (r, g, b) in enumerate(_RGB)) + ")"


@query(sql.select(f"{sql.CLASSIFIED}, {_PALETTE}, q AS (SELECT *, {_ARGMAX} AS cls, greatest(0.0, least(1.0, (v - 1.0) / 3.0))::DOUBLE AS grey FROM prob)",
  "SELECT q.image_id, q.x, q.y, " + ", ".join(f"round(grey * 0.6 + {c} * 0.4, 9) AS {c}" for c in "rgb") + " FROM q JOIN pal USING (cls)"))
def composite(spark, sf_dir):
    shown = render.composite(_classified(spark, sf_dir), render.palette(spark), 1.0, 4.0)
    return _longs(_rounded(shown, "r", "g", "b", digits=9), "x", "y")

_STYLES = ["#ff595e", "FFCA3A", "#8ac92680", "#1982", " Navy ", "rgb(12, 300, 7)", "rgba(1,2,3,0.25)", "transparent", "#12", "nope"]
_PARSED = [(255, 89, 94, 1.0), (255, 0, 0, 1.0), (138, 201, 38, 128 / 255), (17, 153, 136, 34 / 255), (0, 0, 128, 1.0), (12, 255, 7, 1.0), (1, 2, 3, 0.25), (0, 0, 0, 0.0), (255, 0, 0, 1.0), (255, 0, 0, 1.0)]


@query("WITH c(k, r, g, b, a) AS (VALUES " + ", ".join(f"({k}, {r}, {g}, {b}, CAST({a!r} AS DOUBLE))" for k, (r, g, b, a) in enumerate(_PARSED)) + ") SELECT doc_id, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, round(a, 9) AS a FROM documents JOIN c ON k = doc_id % 10")
def css_colors(spark, sf_dir):
    """Ten ways to write a colour, three of them not valid."""
    style = F.element_at(F.array(*map(F.lit, _STYLES)), (F.col("doc_id") % 10 + 1).cast("int"))
    c = scalars.css_color(style)
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(c[x] * 255).cast("long").alias(x) for x in "rgb"], F.round(c["a"], 9).alias("a"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.125 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS eighth, CAST(CAST(l_quantity AS DECIMAL(38,4)) AS VARCHAR) AS quantity FROM lineitem")
def fixed_digits(spark, sf_dir):
    value = F.round(F.col("l_extendedprice").cast("double") / 8, 12)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.fixed_digits(value, 2).alias("eighth"), scalars.fixed_digits(F.col("l_quantity").cast("double"), 4).alias("quantity")
    )


@query(sql.select(f"{sql.CLASSIFIED}, pal(cls, r, g, b) AS (VALUES (0, 1.0, 0.0, 0.0), (1, 255 / 255.0, 202 / 255.0, 58 / 255.0), (2, 0.0, 128 / 255.0, 128 / 255.0), (3, 25 / 255.0, 130 / 255.0, 196 / 255.0)), q AS (SELECT *, {_ARGMAX} AS cls, greatest(0.0, least(1.0, (v - 1.0) / 3.0))::DOUBLE AS grey FROM prob)",
  "SELECT q.image_id, q.x, q.y, " + ", ".join(f"round(grey * 0.6 + CAST({c} AS DOUBLE) * 0.4, 9) AS {c}" for c in "rgb") + " FROM q JOIN pal USING (cls)"))
def composite_recolored(spark, sf_dir):
    """Two classes have new colours, one of them not valid; a fifth colour is ignored, a missing one changes nothing."""
    edits = spark.createDataFrame([(0, "no colour"), (2, "teal"), (3, None), (7, "lime")], "cls int, color string")
    shown = render.composite(_classified(spark, sf_dir), render.recolored(render.palette(spark), edits), 1.0, 4.0)
    return _longs(_rounded(shown, "r", "g", "b", digits=9), "x", "y")


@query(_brush_sql(2.0).replace("event_id % 10 = 0 AND ", ""))
def brush_function(spark, sf_dir):
    """The table function of SQL text, beside the operator."""
    scalars.register(spark)
    _strokes(spark, sf_dir).createOrReplaceTempView("gridmill_strokes")
    return spark.sql(f"SELECT event_id, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py FROM gridmill_strokes, LATERAL brush_disc(x, y, 2D, {EVENTS_SIZE[0]}, {EVENTS_SIZE[1]})")


_SAVED = """concat('{"labelColors":["#', substr(m, 1, 6), '","red","#', substr(m, 1, 5), '","#', upper(substr(m, 7, 6)), '","#111111"],"classNames":["  ', coalesce(source, ''), ' ","   ",', doc_id, ',"', coalesce(lang, ''), '","e"]}')"""
_BROKEN = """CASE doc_id % 5 WHEN 0 THEN m WHEN 1 THEN '[]' WHEN 2 THEN concat('{"labelColors":["#GG', substr(m, 1, 4), '","#', substr(m, 3, 6), '"],"classNames":["a",null]}') ELSE """ + _SAVED + " END"


@query(f"""WITH h AS (SELECT *, md5(coalesce(text, '')) AS m FROM documents), raw AS (SELECT doc_id, {_BROKEN} AS t FROM h), ok AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t END AS t FROM raw)
  SELECT doc_id, s.range AS slot,
    CASE WHEN regexp_full_match(json_extract_string(t, '$.labelColors[' || s.range || ']'), '#[0-9a-fA-F]{{6}}') THEN json_extract_string(t, '$.labelColors[' || s.range || ']') END AS color,
    nullif(trim(json_extract_string(t, '$.classNames[' || s.range || ']')), '') AS name FROM ok, range(4) s""")
def settings_sanitize(spark, sf_dir):
    """Settings made of documents, some of them broken, read leniently."""
    docs = table(spark, sf_dir, "documents").withColumn("m", F.md5(F.coalesce("text", F.lit(""))))
    clean = settings.sanitize(docs.select("doc_id", F.expr(_BROKEN).alias("raw")), "raw", 4)
    rows = clean.select("doc_id", F.posexplode(F.arrays_zip("label_colors", "class_names")).alias("slot", "s"))
    return rows.select("doc_id", F.col("slot").cast("long").alias("slot"), F.col("s.label_colors").alias("color"), F.col("s.class_names").alias("name"))


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '#00ff00' ELSE '#8ac926' END AS c, CASE WHEN doc_id % 2 = 0 THEN source END AS n FROM documents) "
  "SELECT doc_id, '{\"labelColors\":[' || coalesce('\"' || c || '\"', 'null') || ',\"#123456\"],\"classNames\":[' || coalesce('\"' || n || '\"', 'null') || ']}' AS written, "
  "coalesce(c, '#ff595e') || ',#123456,#8ac926,#1982c4' AS shown FROM d")
def settings_write(spark, sf_dir):
    """Saved settings as text, and what is shown: saved colours over the defaults."""
    color = F.when(F.col("doc_id") % 3 == 1, F.lit("#00ff00")).when(F.col("doc_id") % 3 == 2, F.lit("#8ac926"))
    colors, names = F.array(color, F.lit("#123456")), F.array(F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", settings.to_text(colors, names).alias("written"), F.array_join(settings.with_defaults(colors), ",").alias("shown"))


@query("SELECT f.range AS feature, s.range AS scale_index, f.range < 2 AND s.range < 2 AS selected FROM range(6) f, range(7) s")
def feature_selection(spark, sf_dir):
    """The selection that stands in the project file of the images of events."""
    return _longs(_exported(spark, sf_dir).selection(), "feature", "scale_index").select("feature", "scale_index", "selected")


def _ordered_images(spark, sf_dir) -> DataFrame:
    images = table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id")).distinct()
    return images.withColumn("ord", F.row_number().over(Window.orderBy("image_id")) - 1)


_ORDERED = "im AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS ord FROM (SELECT DISTINCT event_type AS image_id FROM events))"


@query(sql.select(_ORDERED, "SELECT image_id, CAST(CASE ord WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE ord END AS BIGINT) AS ord FROM im"))
def image_order(spark, sf_dir):
    """Two neighbours have changed places."""
    ord_ = F.col("ord")
    return _longs(_ordered_images(spark, sf_dir).withColumn("ord", F.when(ord_ == 1, 2).when(ord_ == 2, 1).otherwise(ord_)), "ord")


@query(sql.select(sql.EVENTS, "SELECT image_id, count(*) AS pixels FROM r1 WHERE image_id <> 'view' GROUP BY 1"))
def image_delete(spark, sf_dir):
    return events_raster(spark, sf_dir).where("image_id <> 'view'").groupBy("image_id").agg(F.count("*").alias("pixels"))


@query(sql.select(f"{_ORDERED}, {sql.LATEST}, bx AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM last GROUP BY 1)", """
  SELECT format('lane{:04d}', ord) AS lane, format('labels{:03d}', ord) AS label_set, regexp_replace(image_id, '\\.[^/.]+$', '') AS nickname, '1,30,24' AS shape,
    '[' || y0 || ':' || (y1 + 1) || ',' || x0 || ':' || (x1 + 1) || ',0:1]' AS block_slice FROM im LEFT JOIN bx USING (image_id)"""))
def ilp_manifest(spark, sf_dir):
    images = _ordered_images(spark, sf_dir).withColumns({"width": F.lit(EVENTS_SIZE[0]), "height": F.lit(EVENTS_SIZE[1])})
    return project.manifest(images, labels.bounding_boxes(labels.keep_latest(_strokes(spark, sf_dir), ["ts", "event_id"])))


@query("""WITH h AS (SELECT doc_id, sha256(doc_id || ':' || coalesce(text, '')) AS d FROM documents)
  SELECT doc_id, d[1:8] || '-' || d[9:12] || '-4' || d[14:16] || '-8' || d[18:20] || '-' || d[21:32] AS dataset_id FROM h""")
def dataset_ids(spark, sf_dir):
    """Identifiers of data sets, by place and content."""
    content = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.key_uuid(content).alias("dataset_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no shape' WHEN n_chars % 4 > 1 THEN 'only two-dimensional images are read, not ' || (n_chars % 4 + 1) || ' axes' END AS error FROM documents""")
def rank_guard(spark, sf_dir):
    """Images by the shapes that documents stand for: those with more than two axes are reported."""
    shape = F.when(F.col("doc_id") % 11 != 0, F.sequence(F.lit(0), (F.col("n_chars") % 4).cast("int")))
    return planes.with_rank_errors(table(spark, sf_dir, "documents").withColumn("shape", shape)).select("doc_id", "error")


_HEADS = [len(tiff.header(*EVENTS_SIZE, n, np.dtype(k))) for n, k in ((1, "u1"), (4, "f4"))]


@query(f"SELECT 2 * count(DISTINCT event_type) AS files, CAST(count(DISTINCT event_type) * ({sum(_HEADS)} + {EVENTS_SIZE[0] * EVENTS_SIZE[1]} * 17) AS BIGINT) AS bytes FROM events")
def export_progress(spark, sf_dir):
    """Files and bytes that a streamed export says it has written."""
    folder = scratch(spark, "export-stream")
    made = materialize(_export_ranges(spark, sf_dir), "export-ranges")
    spark.dataSource.register(ranges.RangeSink)
    stream = progress.observed(spark.readStream.schema(made.schema).parquet(made._gridmill_table))
    run = stream.writeStream.format("gridmill_ranges").option("path", f"{folder}/files").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    told = [p["observedMetrics"][progress.NAME] for p in run.recentProgress if progress.NAME in p["observedMetrics"]]
    return spark.createDataFrame([(sum(t["files"] for t in told), sum(t["bytes"] for t in told))], "files long, bytes long")


def _exported(spark, sf_dir) -> Project:
    """The images in their order, with their labels, in a project file that tasks wrote range by range."""
    painted = labels.keep_latest(_strokes(spark, sf_dir), ["ts", "event_id"])
    folder = scratch(spark, "project")
    ranges.save(project.project_ranges(events_raster(spark, sf_dir), painted, _ordered_images(spark, sf_dir), *EVENTS_SIZE, "now"), folder)
    return Project(spark, f"{folder}/project.ilp")


@query(sql.select(f"{sql.EVENTS}, {_ORDERED}", "SELECT format('lane{:04d}', ord) AS lane, image_id AS nickname, i, v FROM im JOIN r1 USING (image_id)"))
def project_planes(spark, sf_dir):
    """Raw data in an exported project file, by the paths its lanes name."""
    return _exported(spark, sf_dir).planes().withColumn("v", F.col("v").cast("double"))


@query(sql.select(f"{_ORDERED}, {sql.LATEST}, bx AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM last GROUP BY 1)", """
  SELECT format('labels{:03d}', ord) AS label_set, gx.range AS x, gy.range AS y, CAST(coalesce(last.cls + 1, 0) AS BIGINT) AS code FROM im JOIN bx USING (image_id)
    JOIN range(24) gx ON gx.range BETWEEN x0 AND x1 JOIN range(30) gy ON gy.range BETWEEN y0 AND y1
    LEFT JOIN last ON last.image_id = im.image_id AND last.x = gx.range AND last.y = gy.range"""))
def project_labels(spark, sf_dir):
    """Blocks of labels in an exported project file, at the places their slices name."""
    return _longs(_exported(spark, sf_dir).label_blocks(), "code")


def _project_texts_sql() -> str:
    """Texts of the file but for lanes' keys, which are hashes of their own, and paths made of them."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    whole = {
        "/ilastikVersion": "1.4.0", "/workflowName": "Pixel Classification", "/time": "now", "/Input Data/StorageVersion": "0.2", "/FeatureSelections/StorageVersion": "0.1",
        "/PixelClassification/StorageVersion": "0.1", "/PixelClassification/ClassifierFactory": project.CLASSIFIER_FACTORY.format(trees=8),
    }
    lane = {"__class__": "'ProjectInternalDatasetInfo'", "axistags": quoted(project.axis_tags("zyx")), "display_mode": "'default'", "location": "'ProjectInternal'", "nickname": "image_id"}
    parts = [f"SELECT {quoted(p)} AS path, {quoted(v)} AS value" for p, v in whole.items()]
    parts += [f"SELECT format('/Input Data/infos/lane{{:04d}}/Raw Data/{n}', ord), {v} FROM im" for n, v in lane.items()]
    return sql.select(_ORDERED, " UNION ALL ".join(parts))


@query(_project_texts_sql())
def project_texts(spark, sf_dir):
    """Texts of an exported project file."""
    return _exported(spark, sf_dir).texts().where(~F.col("path").rlike("(datasetId|filePath|inner_path)$"))


# --- stream operators, as batches ---------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return streams.debounced(table(spark, sf_dir, "events"), "30 minutes", ["user_id"])


@query("SELECT event_type, date_trunc('hour', ts) AS frame_ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def coalesce_latest(spark, sf_dir):
    return streams.latest_of_frame(table(spark, sf_dir, "events"), "1 hour", ["event_type"], "value", tie="event_id")


@query(sql.select(sql.STROKES, """SELECT image_id, x, y, cls FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY cls % 2 DESC, ts DESC, event_id DESC) AS r FROM st)
  WHERE r = 1 AND cls <> 3"""))
def label_store(spark, sf_dir):
    """Two batches of strokes through a store that is opened again in between; strokes of the last class erase."""
    strokes = _strokes(spark, sf_dir).withColumns({"batch": F.col("cls") % 2, "cls": F.when(F.col("cls") != 3, F.col("cls"))})
    folder = scratch(spark, "label-store")
    for k in range(2):
        streams.LabelStore(spark, "strokes", folder).apply(strokes.where(F.col("batch") == k).drop("batch"), k)
    return _longs(streams.LabelStore(spark, "strokes", folder).labels(), "x", "y", "cls")


@query(ORACLES["intake_dedup"])
def intake_streamed(spark, sf_dir):
    """Files that arrive in two folders' worth, through a stream that is started again; those known before are its first state."""
    arriving = _files(spark, sf_dir).where("ord >= 100").select("ord", "name", F.col("file_size").cast("long").alias("file_size"))
    folder = scratch(spark, "intake")
    own = state.stateful(spark, 4)
    known = _files(own, sf_dir).where("ord < 100").select("name", F.col("file_size").cast("long").alias("file_size"))
    half = arriving.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ord)")).first()[0] or 0
    for some in (F.col("ord") <= half, F.col("ord") > half):
        arriving.where(some).write.mode("append").parquet(f"{folder}/files")
        stream = state.intake_stream(own.readStream.schema(arriving.schema).parquet(f"{folder}/files"), known)
        fresh = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/new")
        fresh.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(arriving.schema).parquet(f"{folder}/new").select("ord", "name", "file_size")


@query(sql.select(sql.STROKES, """SELECT image_id, x, y, cls FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY ts DESC, event_id DESC) AS r FROM st)
  WHERE r = 1 AND cls <> 3"""))
def label_state(spark, sf_dir):
    """Strokes of two folders' worth through a stream that is stopped and started again from its checkpoint; labels are read from its state."""
    strokes = _strokes(spark, sf_dir).withColumn("cls", F.when(F.col("cls") != 3, F.col("cls")))
    folder = scratch(spark, "label-state")
    own = state.stateful(spark, 4)
    for half in range(2):
        strokes.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{folder}/strokes")
        stream = own.readStream.schema(strokes.schema).parquet(f"{folder}/strokes")
        changes = state.label_changes(stream, "60 days").writeStream.outputMode("update").format("noop")
        changes.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _longs(state.labels_in(spark, f"{folder}/checkpoint"), "x", "y", "cls").select("image_id", "x", "y", "cls")


@query("""WITH p AS (SELECT event_id AS seq, ts, user_id % 40 AS device, event_id % 3 AS pointer, CASE event_type WHEN 'view' THEN 'press' WHEN 'purchase' THEN 'release' ELSE 'move' END AS kind,
    event_id % 9 = 0 AS other FROM events),
  own AS (SELECT * FROM p WHERE pointer = 0),
  down AS (SELECT seq, count(*) FILTER (kind = 'press') AS n FROM (SELECT m.seq, q.pointer, arg_max(q.kind, (q.ts, q.seq)) AS kind
    FROM own m JOIN p q ON q.device = m.device AND q.kind <> 'move' AND (q.ts, q.seq) <= (m.ts, m.seq) GROUP BY 1, 2) GROUP BY 1),
  begun AS (SELECT m.seq, max((q.ts, q.seq)) AS at, arg_max(q.other, (q.ts, q.seq)) AS other FROM own m JOIN own q ON q.device = m.device AND q.kind = 'press' AND (q.ts, q.seq) <= (m.ts, m.seq) GROUP BY 1),
  ended AS (SELECT m.seq, max((q.ts, q.seq)) AS at FROM own m JOIN begun b ON b.seq = m.seq JOIN own q ON q.device = m.device AND q.kind = 'release' AND (q.ts, q.seq) <= (m.ts, m.seq)
    AND q.other = b.other AND (q.ts, q.seq) > b.at GROUP BY 1)
  SELECT m.seq AS event_id, m.device FROM own m LEFT JOIN down ON down.seq = m.seq LEFT JOIN begun b ON b.seq = m.seq LEFT JOIN ended e ON e.seq = m.seq
  WHERE m.kind = 'press' OR (m.kind = 'move' AND b.at IS NOT NULL AND e.at IS NULL AND m.other = b.other AND coalesce(down.n, 0) <= 1)""")
def primary_pointers(spark, sf_dir):
    """Groups of users as devices of three pointers: presses paint, moves pause while a second pointer is down."""
    kind = F.when(F.col("event_type") == "view", "press").when(F.col("event_type") == "purchase", "release").otherwise("move")
    event = F.col("event_id")
    pointers = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("device"), "ts", event.alias("seq"), (event % 3).alias("pointer"), (event % 3 == 0).alias("is_primary"), kind.alias("kind"),
        F.when(event % 9 == 0, "other").otherwise("one").alias("image_id"),
    )
    return state.painting(pointers).select(F.col("seq").alias("event_id"), "device")
