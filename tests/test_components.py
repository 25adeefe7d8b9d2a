import numpy as np
import pytest

from gridmill.operators import ccl, objects


def flood(mask):
    h, w = mask.shape
    label = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not label[y, x]:
                todo, name = [(y, x)], y * w + x + 1
                label[y, x] = name
                while todo:
                    b, a = todo.pop()
                    for d, c in ((b + 1, a), (b - 1, a), (b, a + 1), (b, a - 1)):
                        if 0 <= d < h and 0 <= c < w and mask[d, c] and not label[d, c]:
                            label[d, c] = name
                            todo.append((d, c))
    return label


def in_memory(mask):
    y, x = np.nonzero(mask)
    at = ccl.runs_to_roots(x, y)
    out = np.zeros(mask.shape, int)
    out[y, x] = y[at] * mask.shape[1] + x[at] + 1 if len(at) else 0
    return out


def frame(spark, mask, name="a", values=None):
    h, w = mask.shape
    rows = [(name, int(x), int(y), int(y * w + x), float(y * w + x if values is None else values)) for y, x in zip(*np.nonzero(mask), strict=True)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, i long, v double")


def text_mask(*lines):
    return np.array([[c == "#" for c in line] for line in lines])


SPIRAL = text_mask("#########", "........#", ".######.#", ".#....#.#", ".#.####.#", ".#......#", ".########")
BLOBS = text_mask("##..#", "##..#", ".....", "..##.")


def test_random_masks():
    rng = np.random.default_rng(1)
    for _ in range(50):
        mask = rng.random((29, 37)) < 0.55
        assert (in_memory(mask) == flood(mask)).all()


def test_shapes():
    serpentine = np.zeros((64, 64), bool)
    serpentine[::2] = True
    serpentine[1::4, -1] = serpentine[3::4, 0] = True
    assert len(np.unique(in_memory(serpentine))) == 2
    assert len(np.unique(in_memory(SPIRAL)[SPIRAL])) == 1
    assert sorted(np.unique(in_memory(text_mask("#.", ".#")))) == [0, 1, 4]
    assert sorted(np.unique(in_memory(BLOBS))) == [0, 1, 5, 18]
    assert not in_memory(np.zeros((4, 4), bool)).any()


@pytest.mark.parametrize(("tile", "few"), [(1024, 9), (4, 0), (7, 0), (4, 10**6)])
def test_tiles(spark, monkeypatch, tile, few):
    monkeypatch.setattr(ccl, "FEW_EDGES", few)
    mask = np.random.default_rng(tile).random((17, 23)) < 0.6
    both = frame(spark, mask).unionByName(frame(spark, SPIRAL, "b"))
    got = ccl.label_components(both, 23, 17, tile)
    want = flood(mask)
    for r in got.where("image_id = 'a'").collect():
        assert r["label"] == want[r["y"], r["x"]]
    assert got.where("image_id = 'b'").select("label").distinct().count() == 1


def test_last_pixel_is_an_object(spark):
    mask = np.zeros((3, 4), bool)
    mask[2, 3] = True
    assert ccl.label_components(frame(spark, mask), 4, 3).first()["label"] == 12


def test_stats(spark):
    base = frame(spark, BLOBS).selectExpr("image_id", "x", "y", "i", "v * 10 as v")
    out = {r["label"]: r for r in objects.object_stats(ccl.label_components(base, 5, 4)).collect()}
    assert (out[1].area, out[1].total, out[1].sum_x, out[1].sum_y, out[1].min_v, out[1].max_v) == (4, 120, 2, 2, 0, 60)
    assert (out[5].area, out[5].total) == (2, 130)
    assert (out[18].area, out[18].sum_x, out[18].sum_y) == (2, 5, 6)


def test_sums_pass_32_bits(spark):
    full = spark.range(80_000).selectExpr("'a' as image_id", "int(id % 400) as x", "int(id div 400) as y", "id as i", "65535D as v")
    r = objects.object_stats(ccl.label_components(full, 400, 200)).collect()
    assert len(r) == 1 and (r[0].area, r[0].total) == (80_000, 5_242_800_000)


def test_decode(spark):
    rows = spark.createDataFrame([(4, 8, 12), (100_000, 3_000_000_000, 6_000_000_000), (0, 1, 1)], "area long, sum_x long, sum_y long")
    assert sorted((r.cx, r.cy, r.area) for r in objects.centroids(rows).collect()) == [(2.0, 3.0, 4), (30000.0, 60000.0, 100_000)]


def test_no_mask(spark):
    empty = frame(spark, np.zeros((2, 2), bool))
    assert objects.object_stats(ccl.label_components(empty, 2, 2)).count() == 0
