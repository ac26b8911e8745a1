"""Common table expressions for the checking SQL."""

from __future__ import annotations

from harness.bindings import PX_OBS

BANDS = ["b03", "b04", "b05", "b08", "b11"]
INVALID = "(0, 1, 3, 8, 9, 10, 11)"


def r(expr: str, digits: int = 6) -> str:
    """Rounded, with negative zero folded into zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def nd(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} + {b}) > 1e-6 THEN ({a} - {b}) / ({a} + {b}) END"


def clip(x: str, lo="0.0", hi="1.0") -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {lo} THEN {lo} WHEN ({x}) > {hi} THEN {hi} ELSE ({x}) END"


PX = f"px AS (SELECT px_row AS r, px_col AS c, * FROM ({PX_OBS}))"
_fill = " AND ".join(f"{b} = 0" for b in BANDS)
MASKED = PX + f""", m AS (
  SELECT r, c, scene, scl, (scl NOT IN {INVALID} AND NOT ({_fill})) AS valid,
    {', '.join(f'{b} AS d{b[1:]}' for b in BANDS)}
  FROM px)"""
_refl = ", ".join(f"CASE WHEN valid THEN d{b[1:]} * 1e-4 END AS {b}" for b in BANDS)
REFL = MASKED + f", rf AS (SELECT r, c, scene, scl, valid, {_refl} FROM m)"
INDICES = REFL + f""", ix AS (
  SELECT *, {nd('b08', 'b04')} AS ndvi, {nd('b03', 'b08')} AS ndwi, {nd('b08', 'b05')} AS ndre,
    {nd('b08', 'b11')} AS ndmi FROM rf)"""

# Class scores, written as one row per (pixel, class) so the winner is picked by sorting.
_parts = f"""
    {clip('(ndwi - 0.10) / 0.35')} AS w1, {clip('(0.35 - ndvi) / 0.35')} AS w2, {clip('(0.0 - ndre) / 0.15')} AS w3,
    {clip('(ndvi - 0.35) / 0.35')} AS v1, {clip('(0.0 - ndwi) / 0.35')} AS v2, {clip('(0.28 - ndre) / 0.25')} AS v3,
    {clip('(ndvi - 0.20) / 0.25')} AS h1, {clip('(0.55 - ndvi) / 0.20')} AS h2, {clip('(0.28 - ndre) / 0.20')} AS h3,
    {clip('(ndwi + 0.20) / 0.40')} AS h4,
    {clip('(ndvi - 0.55) / 0.30')} AS q1, {clip('(ndre - 0.28) / 0.25')} AS q2, {clip('(ndmi - 0.08) / 0.25')} AS q3,
    {clip('(0.25 - ndwi) / 0.30')} AS q4"""


def scores(bonus: str = "") -> str:
    """CTE ``sc`` with columns s0..s3; ``bonus`` is added to s3 and clipped."""
    reed = "least(q1, q2, q3, q4)"
    s3 = clip(f"{reed} + {bonus}") if bonus else reed
    return f""", pt AS (SELECT *, {_parts} FROM ix WHERE valid AND ndvi IS NOT NULL AND ndwi IS NOT NULL
      AND ndre IS NOT NULL AND ndmi IS NOT NULL), sc AS (
  SELECT *, {clip('0.45 * w1 + 0.30 * w2 + 0.25 * w3')} AS s0,
    {clip('0.45 * v1 + 0.25 * v2 + 0.30 * v3 * greatest(v1, v2)')} AS s1,
    {clip('0.55 * least(h1, least(1.0, h2 + h3)) + 0.45 * h4', '0.0', '0.7')} AS s2,
    {s3} AS s3 FROM pt)"""


LABEL_TAIL = """, rk AS (
  SELECT r, c, scene, code, s, row_number() OVER (PARTITION BY r, c, scene ORDER BY s DESC, code) AS k,
    max(s) OVER (PARTITION BY r, c, scene) AS top
  FROM (SELECT r, c, scene, 0 AS code, s0 AS s FROM sc UNION ALL SELECT r, c, scene, 1, s1 FROM sc
        UNION ALL SELECT r, c, scene, 2, s2 FROM sc UNION ALL SELECT r, c, scene, 3, s3 FROM sc)),
 pick AS (
  SELECT r, c, scene, max(CASE WHEN k = 1 THEN code END) AS code, max(top) AS conf,
    max(top) - max(CASE WHEN k = 2 THEN s END) AS margin,
    sum(CASE WHEN s >= top - 0.10 THEN 1 ELSE 0 END) AS agree
  FROM rk GROUP BY r, c, scene),
 lab AS (
  SELECT m.r, m.c, m.scene, m.valid, p.code IS NOT NULL AS usable, coalesce(p.code, -1) AS label, p.conf, p.margin,
    coalesce(p.margin < 0.08 OR p.agree > 2, false) AS amb,
    coalesce(NOT (p.conf >= 0.60 AND p.margin >= 0.08 AND p.agree <= 2) OR p.code = 2, false) AS review,
    p.code IS NOT NULL AND NOT coalesce(p.margin < 0.08 OR p.agree > 2, false) AS trainable
  FROM m LEFT JOIN pick p USING (r, c, scene))"""
LABELS = INDICES + scores() + LABEL_TAIL

FRAME = "fr AS (SELECT CAST(floor(max(l_orderkey) / 120.0) AS BIGINT) + 1 AS hh, CAST(120 AS BIGINT) AS ww FROM lineitem)"
# Every full 32-px tile with stride 16, found by testing each pixel against each offset.
TILES = LABELS + f""", {FRAME}, tl AS (
  SELECT s.scene, ty.k * 16 AS top, tx.k * 16 AS lft
  FROM (SELECT DISTINCT scene FROM px) s, fr,
    (SELECT unnest(range(0, 100000)) AS k) ty, (SELECT unnest(range(0, 8)) AS k) tx
  WHERE ty.k * 16 + 32 <= fr.hh AND tx.k * 16 + 32 <= fr.ww),
 tp AS (
  SELECT tl.scene, tl.top, tl.lft, lab.r, lab.c, lab.usable, lab.review, lab.trainable, lab.label,
    CASE WHEN lab.trainable THEN lab.label ELSE -1 END AS mask
  FROM tl JOIN lab ON lab.scene = tl.scene AND lab.r >= tl.top AND lab.r < tl.top + 32
    AND lab.c >= tl.lft AND lab.c < tl.lft + 32)"""
_cnt = ", ".join(f"count(*) FILTER (WHERE label = {c}) AS label_{c}, count(*) FILTER (WHERE mask = {c}) AS mask_{c}"
                 for c in range(4))
TALLY = TILES + f""", ta AS (
  SELECT tl.scene, tl.top, tl.lft, count(tp.r) AS px, count(*) FILTER (WHERE usable) AS usable,
    count(*) FILTER (WHERE trainable) AS trainable, count(*) FILTER (WHERE review) AS review, {_cnt}
  FROM tl LEFT JOIN tp USING (scene, top, lft) GROUP BY tl.scene, tl.top, tl.lft)"""
