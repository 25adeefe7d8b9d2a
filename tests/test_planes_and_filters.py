import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.functions import scalars
from gridmill.operators import filters, labels, planes, raster, settings


def plane(spark, values, name="a"):
    h, w = values.shape
    rows = [(name, x, y, y * w + x, float(values[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, i long, v double")


def filtered(values, sigma):
    """Two passes with clamped ends, in numpy."""
    k = filters.kernels(sigma)

    def along(a, kernel):
        n = a.shape[1]
        return sum(w * a[:, np.clip(np.arange(n) + d, 0, n - 1)] for d, w in kernel.items())

    x = {n: along(values, k[n]) for n in k}
    down = lambda n, m: along(x[n].T, k[m]).T
    return {"l": down("k0", "k0"), "lx": down("k1", "k0"), "lxx": down("k2", "k0"), "ly": down("k0", "k1"), "lxy": down("k1", "k1"), "lyy": down("k0", "k2"), "lsub": down("k0s", "k0s")}


def test_min_max(spark):
    for values, want in (([0, 4000, 65535], (0, 65535)), ([-10, 0, 10], (-10, 10)), ([7, 7, 7, 7], (7, 7))):
        r = raster.min_max(plane(spark, np.array([values]))).first()
        assert (r.data_min, r.data_max) == want
    empty = plane(spark, np.array([[1.0]])).where("v > 5").groupBy().agg(F.coalesce(F.min("v"), F.lit(0.0)).alias("m"))
    assert empty.first().m == 0


def test_deinterleave(spark):
    df = spark.createDataFrame([(1, [10.0, 20.0, 30.0, 11.0, 21.0, 31.0])], "id int, s array<double>")
    got = sorted((r.channel, r.i, r.v) for r in planes.deinterleave(df, "s", 3, ["id"]).collect())
    assert got == [(0, 0, 10), (0, 1, 11), (1, 0, 20), (1, 1, 21), (2, 0, 30), (2, 1, 31)]
    assert [r.v for r in planes.deinterleave(df, "s", 1, ["id"]).orderBy("i").collect()] == [10, 20, 30, 11, 21, 31]


def test_more_than_two_axes_is_an_error(spark):
    assert planes.planar_only(spark.createDataFrame([([4, 3],)], "shape array<int>")).count() == 1
    with pytest.raises(Exception, match="two-dimensional"):
        planes.planar_only(spark.createDataFrame([([4, 3, 2],)], "shape array<int>")).collect()


def test_kernels():
    for sigma in (0.3, 1.0, 2.5):
        k = filters.kernels(sigma)
        assert abs(sum(k["k0"].values()) - 1) < 1e-6
        assert abs(sum(d * w for d, w in k["k1"].items()) - 1) < 1e-6
        assert abs(sum(k["k2"].values())) < 1e-6 and abs(sum(d * d * w / 2 for d, w in k["k2"].items()) - 1) < 1e-5
    with pytest.raises(ValueError):
        filters.half_kernel(0)
    assert max(filters.kernels(8.0)["k2"]) == 32
    with pytest.raises(ValueError):
        filters.kernels(8.1)


def test_features_match_numpy_and_each_other(spark):
    values = np.random.default_rng(3).random((12, 15)) * 50
    want = filtered(values, 1.0)
    rows = filters.features(plane(spark, values), 1.0).collect()
    for r in rows:
        w = {k: v[r.y, r.x] for k, v in want.items()}
        assert abs(r.f0 - w["l"]) < 1e-9 and abs(r.f1 - (w["lxx"] + w["lyy"])) < 1e-9
        assert abs(r.f2 - np.hypot(w["lx"], w["ly"])) < 1e-9 and abs(r.f3 - (w["l"] - w["lsub"])) < 1e-9
        assert abs(r.f1 - (r.f6 + r.f7)) < 1e-9 and abs(r.f4 - r.f2**2) < 1e-7 and abs(r.f5) < 1e-7 and r.f6 >= r.f7


def test_ramp_and_parabola(spark):
    y, x = np.mgrid[0:15, 0:15].astype(float)
    ramp = filters.features(plane(spark, 3 * x + 2 * y)).where("x = 7 and y = 7").first()
    assert abs(ramp.f2**2 - 13) < 1e-4
    bowl = filters.features(plane(spark, x * x)).where("x = 7 and y = 7").first()
    assert abs(bowl.f1 - 2) < 1e-4


def test_brush(spark):
    at = spark.createDataFrame([(0, 5, 5), (1, -1, 3), (2, 0, 0)], "s int, x int, y int")
    one = sorted((r.s, r.px, r.py) for r in labels.brush(at, 1, 10, 10).collect())
    assert one == [(0, 5, 5), (1, 0, 3), (2, 0, 0)]
    two = labels.brush(at.where("s = 0"), 2, 10, 10).count()
    assert two == sum(dx * dx + dy * dy <= 4 for dx in range(-2, 3) for dy in range(-2, 3))


def test_label_edits(spark):
    base = spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 2, 1)], "image_id string, x int, y int, cls int")
    new = spark.createDataFrame([("a", 2, 2, 3)], base.schema)
    assert sorted(map(tuple, labels.upsert(base, new).collect())) == [("a", 1, 1, 0), ("a", 2, 2, 3)]
    assert [tuple(r) for r in labels.erase(base, new).collect()] == [("a", 1, 1, 0)]


def test_settings(spark):
    rows = [(json,) for json in ('{"labelColors": ["#ff0000", "red", "#fff", "#GGGGGG", "#111111", "#222222"], "classNames": ["  Padded  ", " ", 42]}', "garbage", "null")]
    got = settings.sanitize(spark.createDataFrame(rows, "raw string"), "raw", 4).collect()
    assert got[0].label_colors == ["#ff0000", None, None, None] and got[0].class_names == ["Padded", None, "42", None]
    assert got[1].label_colors == [None] * 4 == got[2].class_names
    assert settings.sanitize(spark.createDataFrame(rows, "raw string"), "raw", 0).first().label_colors == []


def test_scalars(spark):
    scalars.register(spark)
    r = spark.sql("select contrast_window(5, 0, 10) a, marker_radius(1) b, luma(255, 255, 255) c, pixel_index(3, 2, 10) d").first()
    assert (r.a, r.b, round(r.c, 9), r.d) == (0.5, 1.5, 255.0, 23)
    one = spark.range(1)
    big = 5_242_800_000
    words = one.select(scalars.low_word(F.lit(big)).alias("lo"), scalars.high_word(F.lit(big)).alias("hi")).first()
    assert one.select(scalars.join_words(F.lit(words.lo), F.lit(words.hi))).first()[0] == big
    assert one.select(scalars.color_channels(F.lit("nope")).alias("c")).first().c == (136, 136, 136)
    assert one.select(scalars.argmax_class([F.lit(0.5), F.lit(0.5)])).first()[0] == 0
    assert one.select(scalars.client_pixel(F.lit(110.0), F.lit(10.0), F.lit(50), F.lit(200.0))).first()[0] == 25
    assert one.select(scalars.argmax_class([F.lit(-1.0), F.lit(-1.0)])).first()[0] is None


def test_colors_and_digits(spark):
    one = spark.range(1)
    color = lambda text: tuple(round(v * 255, 3) for v in one.select(scalars.css_color(F.lit(text).cast("string")).alias("c")).first().c)
    assert color("#0f8") == (0, 255, 136, 255) and color("#0f8c") == (0, 255, 136, 204)
    assert color("RGBA( 1 , 2,3, .5 )") == (1, 2, 3, 127.5) and color(" Teal ") == (0, 128, 128, 255)
    assert color("") == color(None) == color("rgb(1,2)") == (255, 0, 0, 255)
    text = lambda v, n: one.select(scalars.fixed_digits(F.lit(v), n)).first()[0]
    assert [text(2.0, 4), text(-1.25, 1), text(0.0004, 2), text(7.5, 0)] == ["2.0000", "-1.3", "0.00", "8"]


def test_brush_as_a_table_function(spark):
    scalars.register(spark)
    spots = [(k, x, y) for k, (x, y) in enumerate([(0, 0), (5, 3), (-1, 2), (7, 4)])]
    strokes = spark.createDataFrame(spots, "k int, x int, y int")
    strokes.createOrReplaceTempView("spots")
    for radius in (0.0, 1.0, 1.5, 3.0):
        want = sorted(tuple(r) for r in labels.brush(strokes, radius, 8, 5).select("k", "px", "py").collect())
        got = sorted(tuple(r) for r in spark.sql(f"select k, px, py from spots, lateral brush_disc(x, y, {radius}D, 8, 5)").collect())
        assert got == want


def test_unclassified_pixels_are_marked(spark):
    from gridmill.operators import render

    grid = plane(spark, np.array([[1.0, 2.0]]))
    some = grid.where("x = 1").withColumns({f"p{c}": F.lit(c / 6.0) for c in range(4)})
    got = {r.i: (r.p0, r.p1, r.p2, r.p3) for r in render.stored_probabilities(grid, some).collect()}
    assert got == {0: (-1.0,) * 4, 1: (0.0, 1 / 6, 2 / 6, 3 / 6)}


def test_pixels_of_a_large_image_are_neither_shuffled_nor_held(spark):
    """Tiles are dealt and made into pixels as they are read, by more tasks in a larger image."""
    width, height, values = 9_000, 600, {(0, 0): 2.0, (4_095, 7): 1.0, (4_096, 7): 3.0, (8_999, 599): 1.0}
    rows = spark.createDataFrame([(x, y) for (x, y), n in values.items() for _ in range(int(n))] + [(9_000, 0), (0, -1)], "x int, y int")
    pixels = raster.rasterize(rows, F.lit("a"), F.col("x"), F.col("y"), width, height)
    above = pixels._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Exchange" not in above and "Aggregate" not in above
    conf = "spark.sql.shuffle.partitions"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "1")
    try:
        few = raster.rasterize(rows, F.lit("a"), F.col("x"), F.col("y"), width, height)
        assert few.rdd.getNumPartitions() == 2
    finally:
        spark.conf.set(conf, before)
    found = pixels.agg(F.count("*"), F.count_distinct("i"), F.min("i"), F.max("i"), F.sum("v")).first()
    assert tuple(found) == (width * height, width * height, 0, width * height - 1, 7.0)
    assert {(r.x, r.y): r.v for r in pixels.where("v > 0").collect()} == values
