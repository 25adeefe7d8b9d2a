"""SQL for a second engine: the same rasters, filter bank, components and forest as common table expressions."""

from __future__ import annotations

from gridmill.operators.filters import kernels
from gridmill.operators.forest import forest_text
from gridmill.plans.fixed import EMBED_FEATURES, FOREST, RASTER_FEATURES, SIGMA

EVENTS = """
r1c AS (SELECT event_type AS image_id, CAST(hour(ts) AS BIGINT) AS x, CAST(day(ts) - 1 AS BIGINT) AS y, count(*) AS n FROM events GROUP BY 1, 2, 3),
r1 AS (SELECT g.image_id, g.x, g.y, g.y * 24 + g.x AS i, CAST(coalesce(r1c.n, 0) AS DOUBLE) AS v
  FROM (SELECT e.image_id, gx.x, gy.y FROM (SELECT DISTINCT event_type AS image_id FROM events) e,
    (SELECT range AS x FROM range(24)) gx, (SELECT range AS y FROM range(30)) gy) g
  LEFT JOIN r1c ON r1c.image_id = g.image_id AND r1c.x = g.x AND r1c.y = g.y)"""

SHIP = """
r2c AS (SELECT l_returnflag AS image_id, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS x, CAST(l_quantity - 1 AS BIGINT) AS y, count(*) AS n
  FROM lineitem WHERE floor(l_extendedprice / 1000) BETWEEN 0 AND 104 AND l_quantity - 1 BETWEEN 0 AND 49 GROUP BY 1, 2, 3),
r2 AS (SELECT g.image_id, g.x, g.y, g.y * 105 + g.x AS i, CAST(coalesce(r2c.n, 0) AS DOUBLE) AS v
  FROM (SELECT e.image_id, gx.x, gy.y FROM (SELECT DISTINCT l_returnflag AS image_id FROM lineitem) e,
    (SELECT range AS x FROM range(105)) gx, (SELECT range AS y FROM range(50)) gy) g
  LEFT JOIN r2c ON r2c.image_id = g.image_id AND r2c.x = g.x AND r2c.y = g.y)"""

EMBED = """
r3 AS (SELECT 'embed' AS image_id, CAST(p.k - 1 AS BIGINT) AS x, CAST(vec_id AS BIGINT) AS y, CAST(vec_id * 64 + p.k - 1 AS BIGINT) AS i,
  CAST(embedding[p.k] AS DOUBLE) AS v FROM embeddings, (SELECT range AS k FROM range(1, 65)) p)"""

KERNEL = "kern(name, d, w) AS (VALUES " + ", ".join(f"('{n}', {d}, CAST({w!r} AS DOUBLE))" for n, k in kernels(SIGMA).items() for d, w in sorted(k.items())) + ")"


def _sum(kernel: str, column: str) -> str:
    return f"sum(CASE WHEN k.name = '{kernel}' THEN k.w * s.{column} END)"


FILTERS = f"""{EVENTS}, {KERNEL},
hpass AS (SELECT t.image_id, t.x, t.y, t.i, any_value(t.v) AS v, {_sum('k0', 'v')} AS h0, {_sum('k1', 'v')} AS h1, {_sum('k2', 'v')} AS h2, {_sum('k0s', 'v')} AS h0s
  FROM r1 t CROSS JOIN kern k JOIN r1 s ON s.image_id = t.image_id AND s.y = t.y AND s.x = greatest(0, least(23, t.x + k.d)) GROUP BY t.image_id, t.x, t.y, t.i),
vpass AS (SELECT t.image_id, t.x, t.y, t.i, any_value(t.v) AS v, {_sum('k0', 'h0')} AS l, {_sum('k0', 'h1')} AS lx, {_sum('k0', 'h2')} AS lxx,
    {_sum('k1', 'h0')} AS ly, {_sum('k1', 'h1')} AS lxy, {_sum('k2', 'h0')} AS lyy, {_sum('k0s', 'h0s')} AS lsub
  FROM hpass t CROSS JOIN kern k JOIN hpass s ON s.image_id = t.image_id AND s.x = t.x AND s.y = greatest(0, least(29, t.y + k.d)) GROUP BY t.image_id, t.x, t.y, t.i),
feat AS (SELECT image_id, x, y, i, v, l AS f0, lxx + lyy AS f1, sqrt(lx * lx + ly * ly) AS f2, l - lsub AS f3,
    (lx * lx + ly * ly) / 2 + sqrt((lx * lx - ly * ly) * (lx * lx - ly * ly) / 4 + lx * ly * (lx * ly)) AS f4,
    (lx * lx + ly * ly) / 2 - sqrt((lx * lx - ly * ly) * (lx * lx - ly * ly) / 4 + lx * ly * (lx * ly)) AS f5,
    (lxx + lyy) / 2 + sqrt((lxx - lyy) * (lxx - lyy) / 4 + lxy * lxy) AS f6,
    (lxx + lyy) / 2 - sqrt((lxx - lyy) * (lxx - lyy) / 4 + lxy * lxy) AS f7 FROM vpass)"""

CLASSIFIED = f"{FILTERS}, prob AS (SELECT *, {forest_text(FOREST, RASTER_FEATURES)} FROM feat)"
EMBED_ROWS = "emb AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {f}" for k, f in enumerate(EMBED_FEATURES)) + ", label % 4 AS cls FROM embeddings)"
EMBED_PROB = f"{EMBED_ROWS}, prob AS (SELECT *, {forest_text(FOREST, EMBED_FEATURES)} FROM emb)"

MASK = f"{EVENTS}, m AS (SELECT r1.image_id, 0 AS cls, r1.x, r1.y, r1.i, r1.v FROM r1 JOIN (SELECT image_id, avg(v) AS a FROM r1 GROUP BY 1) q USING (image_id) WHERE r1.v >= q.a)"


def components_of(ctes: str) -> str:
    """Adds ``lab``: the pixels of mask ``m`` with their component's label, by recursive closure."""
    return f"""{ctes},
edge AS (SELECT a.image_id, a.cls, a.i AS a, b.i AS b FROM m a JOIN m b ON b.image_id = a.image_id AND b.cls = a.cls AND b.y = a.y AND b.x = a.x + 1
  UNION ALL SELECT a.image_id, a.cls, a.i, b.i FROM m a JOIN m b ON b.image_id = a.image_id AND b.cls = a.cls AND b.x = a.x AND b.y = a.y + 1),
way AS (SELECT * FROM edge UNION ALL SELECT image_id, cls, b, a FROM edge),
reach(image_id, cls, i, r) AS (SELECT image_id, cls, i, i FROM m UNION SELECT reach.image_id, reach.cls, way.b, reach.r FROM reach JOIN way ON way.image_id = reach.image_id AND way.cls = reach.cls AND way.a = reach.i),
lab AS (SELECT m.image_id, m.cls, m.x, m.y, m.i, m.v, q.label FROM m JOIN (SELECT image_id, cls, i, min(r) + 1 AS label FROM reach GROUP BY 1, 2, 3) q USING (image_id, cls, i)),
obj AS (SELECT image_id, cls, label, count(*) AS area, CAST(sum(floor(v)) AS BIGINT) AS total, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y,
  CAST(min(floor(v)) AS BIGINT) AS min_v, CAST(max(floor(v)) AS BIGINT) AS max_v FROM lab GROUP BY 1, 2, 3)"""


OBJECTS = components_of(MASK)
CLASS_MASK = f"{CLASSIFIED}, m AS (" + " UNION ALL ".join(f"SELECT image_id, {c} AS cls, x, y, i, v FROM prob WHERE p{c} >= 0.5" for c in range(4)) + ")"
CLASS_OBJECTS = components_of(CLASS_MASK)

PAINTED = f"""{EVENTS}, lbl AS (SELECT image_id, x, y, (7 * x + 13 * y) % 4 AS cls FROM r1 WHERE (7 * x + 13 * y) % 11 = 0)"""
STROKES = "st AS (SELECT event_id, ts, event_type AS image_id, CAST(hour(ts) AS BIGINT) AS x, CAST(day(ts) - 1 AS BIGINT) AS y, CAST(user_id % 4 AS BIGINT) AS cls FROM events)"
LATEST = f"{STROKES}, last AS (SELECT image_id, x, y, cls FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY ts DESC, event_id DESC) AS r FROM st) WHERE r = 1)"

FILES = """fl AS (SELECT doc_id AS ord, 'img_' || (doc_id % 50) || list_value('.tif', '.TIFF', '.png', '.JPG', '.txt', '.jpeg.bak')[1 + doc_id % 6] AS name, n_chars % 7 AS file_size FROM documents)"""


def select(ctes: str, rest: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()} {rest}" if "reach(" in ctes else f"WITH {ctes.strip()} {rest}"
