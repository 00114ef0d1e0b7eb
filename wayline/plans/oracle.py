"""The same queries as SQL for DuckDB over the shared test tables, written independently of the column expressions."""

from __future__ import annotations

#: Fixed values of the queries' calibration: the region, and the plane's nine coefficients as solved from its four points.
SOURCE = [[100, 250], [1000, 250], [1200, 480], [0, 480]]
H = [1.393939393939394, 0.7196969696969698, -240.90909090909093, 0.0, 4.659090909090909, -1086.3636363636365, 9.186815169423519e-20, 0.0022727272727272726, 1.0]

_D = """
base AS (SELECT event_id AS det_id, event_id % 4 AS cam_no, event_id // 32 AS frame_no, (event_id % 32) // 4 AS det_idx FROM events),
p0 AS (SELECT *, (det_idx + cam_no * 3 + frame_no // 40) % 12 AS person FROM base),
g0 AS (SELECT *, (person * 97 + frame_no * (3 + person % 3 * 4)) % 1100 AS x1, 100 + person % 3 * 20 + frame_no % 7 AS y1,
              CASE WHEN det_id % 53 = 0 THEN 30 ELSE 80 + person * 3 END AS w, 200 + person * 5 AS h
       FROM p0 WHERE (frame_no // 150 + person) % 3 <> 0),
d AS (SELECT g0.det_id, g0.cam_no % 2 AS site_id, concat('cam_', g0.cam_no) AS cam_name, g0.frame_no, g0.det_idx, g0.frame_no * 200 AS ts_ms, g0.person,
             g0.person + 100 * (g0.frame_no // 50) AS tid, g0.x1, g0.y1, g0.x1 + g0.w AS x2, g0.y1 + g0.h AS y2,
             CAST(30 + (g0.det_id * 7919) % 70 AS DOUBLE) / 100 AS conf, b.vec_id AS base_id,
             [CAST(b.embedding[i] AS DOUBLE) + CAST(n.embedding[i] AS DOUBLE) * 0.5::DOUBLE for i in range(1, 65)] AS emb
      FROM g0 JOIN embeddings b ON b.vec_id = g0.person * 30 JOIN embeddings n ON n.vec_id = 400 + g0.det_id % 97)"""

#: No three of four points on a line.
_FIXES = """coalesce(valid AND len(list_filter([[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]], lambda t: (p[t[2]][1] - p[t[1]][1]) * (p[t[3]][2] - p[t[1]][2]) = (p[t[2]][2] - p[t[1]][2]) * (p[t[3]][1] - p[t[1]][1]))) = 0, false)"""

_LOG = f"""
log AS (SELECT event_id AS seq, concat('cam_', user_id % 40) AS name, CASE WHEN event_id % 17 = 0 THEN 'delete' ELSE 'add' END AS action,
        CASE event_id % 5 WHEN 0 THEN CAST(event_id % 10 AS VARCHAR) WHEN 1 THEN concat('rtsp://host', event_id % 7, '/live')
             WHEN 2 THEN concat('uploads/clip ', event_id % 11, '.MP4') WHEN 3 THEN concat('uploads/clip_', event_id % 11, '.webm')
             ELSE concat('notes/(draft) ', event_id % 11, '.txt') END AS url,
        event_id % 2 = 0 AS loop_video,
        CASE event_id % 7 WHEN 0 THEN '[[100,250],[1000,250],[1200,480],[0,480]]' WHEN 1 THEN '[[1,2],[3,4],[5,6]]' WHEN 2 THEN '[[1,2],[3,4],[5,6],[7]]'
             WHEN 3 THEN '[1,2,3,4]' WHEN 4 THEN '[[0.5,1],[2,3],[4,5],[6,7.25]]' WHEN 5 THEN '' END AS points FROM events),
parsed AS (SELECT *, TRY_CAST(points AS DOUBLE[][]) AS p, lower(url) LIKE '%.mp4' OR lower(url) LIKE '%.webm' AS video FROM log),
checked AS (SELECT *, p IS NOT NULL AND len(p) = 4 AND len(list_filter(p, lambda x: len(x) = 2)) = 4 AS valid FROM parsed),
fixed AS (SELECT *, {_FIXES} AS fixes FROM checked),
added AS (SELECT * FROM fixed WHERE action = 'add' QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1),
gone AS (SELECT name, max(seq) AS seq FROM log WHERE action = 'delete' GROUP BY name),
state AS (SELECT a.* FROM added a LEFT JOIN gone g ON g.name = a.name AND g.seq > a.seq WHERE g.name IS NULL)"""


def _number(x: float) -> str:
    return f"{x!r}::DOUBLE"


_W = f"({_number(H[6])} * fx + {_number(H[7])} * fy + {_number(H[8])})"
_MAP = [f"CAST(trunc(({_number(H[k])} * fx + {_number(H[k + 1])} * fy + {_number(H[k + 2])}) / {_W}) AS BIGINT)" for k in (0, 3)]
_CENTER = "(x1 + x2) * 0.5::DOUBLE AS center_x, (y1 + y2) * 0.5::DOUBLE AS center_y"

#: All detections with geometry.
_S = f"""{_D},
s0 AS (SELECT *, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS fx, y2 AS fy FROM d),
s AS (SELECT *, greatest(1, x2 - x1) AS box_w, greatest(1, y2 - y1) AS box_h, {_CENTER}, {_MAP[0]} AS map_x, {_MAP[1]} AS map_y, person AS gid FROM s0)"""


def _inside(x: str, y: str) -> str:
    edges, crossings = [], []
    for (ax, ay), (bx, by) in zip(SOURCE, SOURCE[1:] + SOURCE[:1], strict=True):
        c = f"(({by} - {ay}) * ({x} - {ax}) - ({bx} - {ax}) * ({y} - {ay}))"
        edges.append(f"({c} = 0 AND {x} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {y} BETWEEN {min(ay, by)} AND {max(ay, by)})")
        crossings.append(f"CAST((({ay} > {y}) <> ({by} > {y})) AND {c} * sign({by} - {ay}) < 0 AS INTEGER)")
    return f"({' OR '.join(edges)} OR ({' + '.join(crossings)}) % 2 = 1)"


def _iou(a: str, b: str) -> str:
    shared = f"greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    area = lambda p: f"greatest(1, {p}x2 - {p}x1) * greatest(1, {p}y2 - {p}y1)"
    return f"(({shared}) / ({area(a)} + {area(b)} - {shared}))"


def _dist(*c: str) -> str:
    ax, ay, bx, by = c
    return f"sqrt(CAST(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}) AS DOUBLE))"


def _centers(a: str, b: str) -> str:
    return _dist(*[f"(({p}{c}1 + {p}{c}2) * 0.5::DOUBLE)" for p in (a, b) for c in ("x", "y")])


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def _clamp(x1: str, y1: str, x2: str, y2: str, w: int, h: int) -> list[str]:
    inside = lambda v, side: f"greatest(0, least(CAST(trunc({v}) AS BIGINT), {side - 1}))"
    a, b = inside(x1, w), inside(y1, h)
    end = lambda low, v, side: f"CASE WHEN {inside(v, side)} <= {low} THEN least({side - 1}, {low} + 1) ELSE {inside(v, side)} END"
    return [a, b, end(a, x2, w), end(b, y2, h)]


_CLAMPED = ", ".join(f"{e} AS {n}" for e, n in zip(_clamp("x1", "y1", "x2", "y2", 1280, 720), ("a1", "b1", "a2", "b2"), strict=True))
_CROP = ", ".join(
    f"{e} AS {n}"
    for e, n in zip(
        _clamp("a1 + trunc((a2 - a1) * 0.18::DOUBLE)", "b1 + trunc((b2 - b1) * 0.10::DOUBLE)", "a2 - trunc((a2 - a1) * 0.18::DOUBLE)", "b2 - trunc((b2 - b1) * 0.18::DOUBLE)", 1280, 720),
        ("x1", "y1", "x2", "y2"),
        strict=True,
    )
)
_CROPS = f"{_D}, c AS (SELECT det_id, {_CLAMPED} FROM d), k AS (SELECT det_id, {_CROP} FROM c WHERE a2 - a1 > 1 AND b2 - b1 > 1)"

_PAIRS = f"""{_D}, o AS (SELECT a.cam_name, a.frame_no, a.det_idx AS a, b.det_idx AS b, {_iou("a.", "b.")} AS iou
  FROM d a JOIN d b ON a.cam_name = b.cam_name AND a.frame_no = b.frame_no AND a.det_idx < b.det_idx WHERE {_iou("a.", "b.")} >= 0.35),
f AS (SELECT DISTINCT cam_name, frame_no, det_idx FROM (SELECT cam_name, frame_no, a AS det_idx FROM o UNION ALL SELECT cam_name, frame_no, b FROM o))"""

_PREVIOUS = f"""{_D}, n AS (SELECT *, row_number() OVER (PARTITION BY cam_name ORDER BY frame_no, det_idx) AS rn FROM d),
r AS (SELECT cam_name, frame_no, min(rn) AS r0 FROM n GROUP BY cam_name, frame_no),
c AS (SELECT a.cam_name, a.frame_no, a.det_idx, b.person AS gid, {_iou("a.", "b.")} AS iou, {_centers("a.", "b.")} AS dist
      FROM n a JOIN r ON r.cam_name = a.cam_name AND r.frame_no = a.frame_no JOIN n b ON b.cam_name = a.cam_name AND b.rn BETWEEN r.r0 - 60 AND r.r0 - 1),
v AS (SELECT cam_name, frame_no, det_idx, gid, iou * 2 - dist / 80 * 0.25 AS score FROM c WHERE iou >= 0.2 OR dist <= 80)"""

_CONSECUTIVE = f"""{_S}, u AS (SELECT * EXCLUDE (map_x, map_y), CASE WHEN det_id % 7 <> 0 THEN map_x END AS map_x, CASE WHEN det_id % 7 <> 0 THEN map_y END AS map_y FROM s),
q AS (SELECT *, lag(cam_name) OVER w AS l_cam, lag(ts_ms) OVER w AS l_ms, lag(map_x) OVER w AS l_x, lag(map_y) OVER w AS l_y, lag(box_w) OVER w AS l_w, lag(box_h) OVER w AS l_h
      FROM u WINDOW w AS (PARTITION BY person ORDER BY ts_ms, det_id)),
k AS (SELECT *, {_dist("map_x", "map_y", "l_x", "l_y")} AS dist, (ts_ms - l_ms) / 1000.0::DOUBLE AS idle,
             least(box_w, l_w) / greatest(box_w, l_w) >= 0.35 AND least(box_h, l_h) / greatest(box_h, l_h) >= 0.35 AS fits FROM q WHERE l_ms IS NOT NULL)"""

_PREDICT = f"""{_S}, q AS (SELECT *, lag(center_x) OVER w AS ax, lag(center_y) OVER w AS ay, lag(ts_ms) OVER w AS t1, lag(center_x, 2) OVER w AS bx, lag(center_y, 2) OVER w AS by_,
             lag(ts_ms, 2) OVER w AS t2, lag(box_w) OVER w AS lw, lag(box_h) OVER w AS lh FROM s WINDOW w AS (PARTITION BY cam_name, gid ORDER BY ts_ms, det_id)),
k AS (SELECT *, greatest((t1 - t2) / 1000.0::DOUBLE, 0.001::DOUBLE) AS dt, least(greatest((ts_ms - t1) / 1000.0::DOUBLE, 0), 0.25::DOUBLE) AS ahead FROM q),
m AS (SELECT *, coalesce(ax + (ax - bx) / dt * ahead, ax) AS px, coalesce(ay + (ay - by_) / dt * ahead, ay) AS py FROM k)"""

#: Greedy choice, a frame's pairs one after the other from the best: what is taken so far goes along as two lists.
_GREEDY = f"""{_PREVIOUS}, o AS (SELECT *, row_number() OVER (PARTITION BY cam_name, frame_no ORDER BY score DESC, det_idx DESC, gid DESC) AS k
   FROM (SELECT cam_name, frame_no, det_idx, gid, max(score) AS score FROM v GROUP BY cam_name, frame_no, det_idx, gid)),
t(cam_name, frame_no, k, dets, gids, det_idx, forced_gid) AS (
  SELECT DISTINCT cam_name, frame_no, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o
  UNION ALL SELECT n.cam_name, n.frame_no, n.k, CASE WHEN n.free THEN list_append(n.dets, n.det) ELSE n.dets END, CASE WHEN n.free THEN list_append(n.gids, n.gid) ELSE n.gids END,
                   CASE WHEN n.free THEN n.det END, CASE WHEN n.free THEN n.gid END
  FROM (SELECT t.cam_name, t.frame_no, o.k, t.dets, t.gids, o.det_idx AS det, o.gid, NOT list_contains(t.dets, o.det_idx) AND NOT list_contains(t.gids, o.gid) AS free
        FROM t JOIN o ON o.cam_name = t.cam_name AND o.frame_no = t.frame_no AND o.k = t.k + 1) n)"""

#: Templates after each sighting; an identity that was idle too long begins anew. rows: person, ts_ms, det_id, emb and what orders them.
_EMA = """ug AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY {order}) AS rn, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY person ORDER BY {order}) > 25000, true) AS opens,
              [x / sqrt(list_dot_product(emb, emb)) for x in emb] AS u FROM {rows}),
un AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY rn) AS life FROM ug),
mixed(person, rn, t) AS (SELECT person, rn, u FROM un WHERE opens
  UNION ALL SELECT z.person, z.rn, [x / sqrt(list_dot_product(z.v, z.v)) for x in z.v] FROM
    (SELECT e.person, n.rn, [e.t[i] * 0.9::DOUBLE + n.u[i] * 0.1::DOUBLE for i in range(1, 65)] AS v
     FROM mixed e JOIN un n ON n.person = e.person AND n.rn = e.rn + 1 AND NOT n.opens) z),
tm AS (SELECT person, t FROM mixed QUALIFY row_number() OVER (PARTITION BY person ORDER BY rn DESC) = 1)"""

#: Sightings with the place of their camera frame in their site's order.
_ORDERED = f"""{_S}, so AS (SELECT *, dense_rank() OVER (PARTITION BY site_id ORDER BY ts_ms, cam_name) AS o FROM s)"""

_OVERLAPPED = f"""ov AS (SELECT DISTINCT a.det_id FROM d a JOIN d b ON a.cam_name = b.cam_name AND a.frame_no = b.frame_no AND a.det_idx <> b.det_idx WHERE {_iou("a.", "b.")} >= 0.35)"""

#: Every camera frame with each identity alive before it, as its last sighting left it.
_KNOWN = f"""so AS (SELECT *, dense_rank() OVER (PARTITION BY site_id ORDER BY ts_ms, cam_name) AS o FROM s),
fr AS (SELECT DISTINCT site_id, cam_name, frame_no, ts_ms, o FROM so), pn AS (SELECT DISTINCT site_id, person FROM so),
fp AS (SELECT fr.*, pn.person AS gid FROM fr JOIN pn USING (site_id)),
kn AS (SELECT f.site_id, f.cam_name, f.frame_no, f.ts_ms, f.gid, x.det_id AS version, x.cam_name AS l_cam, x.ts_ms AS l_ms, x.map_x AS l_x, x.map_y AS l_y, x.box_w AS lw, x.box_h AS lh, x.conf AS l_score
       FROM fp f ASOF JOIN so x ON x.site_id = f.site_id AND x.person = f.gid AND f.o > x.o WHERE f.ts_ms - x.ts_ms <= 25000)"""

#: Every pending detection with each identity that passes its frame's gate.
_GATED = f"""{_GREEDY},
s0 AS (SELECT *, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS fx, y2 AS fy FROM d),
s AS (SELECT *, greatest(1, x2 - x1) AS box_w, greatest(1, y2 - y1) AS box_h, {_CENTER}, {_MAP[0]} AS map_x, {_MAP[1]} AS map_y, person AS gid FROM s0),
{_OVERLAPPED}, {_KNOWN},
fg AS (SELECT cam_name, frame_no, det_idx, forced_gid FROM t WHERE det_idx IS NOT NULL),
pe AS (SELECT so.*, ov.det_id IS NOT NULL AS overlap, CASE WHEN ov.det_id IS NOT NULL THEN fg.forced_gid END AS forced
       FROM so LEFT JOIN ov ON ov.det_id = so.det_id LEFT JOIN fg ON fg.cam_name = so.cam_name AND fg.frame_no = so.frame_no AND fg.det_idx = so.det_idx),
pq AS (SELECT pe.det_id, pe.det_idx, pe.emb, pe.map_x, pe.map_y, pe.center_x, pe.center_y, pe.box_w, pe.box_h, pe.overlap, pe.forced, kn.* FROM pe JOIN kn ON kn.cam_name = pe.cam_name AND kn.frame_no = pe.frame_no),
gt AS (SELECT DISTINCT cam_name, frame_no, gid, l_cam, l_ms FROM pq
       WHERE least(box_w, lw) / greatest(box_w, lw) >= 0.35 AND least(box_h, lh) / greatest(box_h, lh) >= 0.35
         AND {_dist("map_x", "map_y", "l_x", "l_y")} <= CASE WHEN cam_name = l_cam THEN 390 ELSE 520 END)"""

#: The scores of all those pairs.
_MOMENTS = f"""{_GATED},
pg AS (SELECT pq.* FROM pq JOIN gt ON gt.cam_name = pq.cam_name AND gt.frame_no = pq.frame_no AND gt.gid = pq.gid),
{_EMA.format(rows="(SELECT * REPLACE (person * 2 + site_id AS person) FROM so)", order="ts_ms, cam_name")},
al AS (SELECT p.det_id, p.gid, {_cos("p.emb", "m.t")} AS sim FROM pg p JOIN un v ON v.det_id = p.version JOIN mixed m ON m.person = v.person AND m.rn = v.rn
       UNION ALL SELECT p.det_id, p.gid, {_cos("p.emb", "q.emb")} FROM pg p JOIN un v ON v.det_id = p.version JOIN un q ON q.person = v.person AND q.life = v.life AND q.rn BETWEEN v.rn - 5 AND v.rn),
ap AS (SELECT det_id, gid, avg(sim) AS appearance FROM (SELECT *, row_number() OVER (PARTITION BY det_id, gid ORDER BY sim DESC) AS r FROM al) WHERE r <= 3 GROUP BY det_id, gid),
ri AS (SELECT s.cam_name, s.person, n.rn, s.center_x, s.center_y, s.ts_ms, s.box_w, s.box_h, lag(n.rn) OVER w AS b_rn, lag(s.center_x) OVER w AS bx, lag(s.center_y) OVER w AS by_, lag(s.ts_ms) OVER w AS bt
       FROM n JOIN s ON s.det_id = n.det_id WINDOW w AS (PARTITION BY s.cam_name, s.person ORDER BY n.rn)),
pr AS (SELECT p.*, r.r0 FROM pg p JOIN r ON r.cam_name = p.cam_name AND r.frame_no = p.frame_no),
pm AS (SELECT p.*, i.rn, i.center_x AS ax, i.center_y AS ay, i.ts_ms AS at_ms, i.box_w AS aw, i.box_h AS ah,
              CASE WHEN i.b_rn >= p.r0 - 60 THEN i.bx END AS bx, CASE WHEN i.b_rn >= p.r0 - 60 THEN i.by_ END AS by_, CASE WHEN i.b_rn >= p.r0 - 60 THEN i.bt END AS bt
       FROM pr p ASOF LEFT JOIN ri i ON i.cam_name = p.cam_name AND i.person = p.gid AND p.r0 > i.rn),
pk AS (SELECT *, rn IS NOT NULL AND rn >= r0 - 60 AS there, greatest((at_ms - bt) / 1000.0::DOUBLE, 0.001::DOUBLE) AS dt, least((ts_ms - at_ms) / 1000.0::DOUBLE, 0.25::DOUBLE) AS ahead,
              l_cam = cam_name AS same, coalesce(forced = gid, false) AS frozen, (ts_ms - l_ms) / 1000.0::DOUBLE AS idle, {_dist("map_x", "map_y", "l_x", "l_y")} AS mdist FROM pm),
sc AS (SELECT pk.*, ap.appearance,
              CASE WHEN there THEN greatest(-0.6::DOUBLE, 1 - least({_dist("center_x", "center_y", "coalesce(ax + (ax - bx) / dt * ahead, ax)", "coalesce(ay + (ay - by_) / dt * ahead, ay)")}
                   / greatest(40, sqrt(CAST(aw * aw + ah * ah AS DOUBLE)) * 0.75::DOUBLE), 1.6::DOUBLE)) ELSE 0.5::DOUBLE END AS motion,
              greatest(-0.4::DOUBLE, 1 - least(mdist / 468, 1.4::DOUBLE)) AS map, greatest(0, 1 - least(greatest(0, idle) / 25, 1)) AS time
       FROM pk JOIN ap ON ap.det_id = pk.det_id AND ap.gid = pk.gid),
fi AS (SELECT *, (0.42::DOUBLE - CASE WHEN overlap THEN 0.14::DOUBLE ELSE 0 END) * appearance + (0.42::DOUBLE + CASE WHEN overlap THEN 0.14::DOUBLE ELSE 0 END) * motion
              + 0.1::DOUBLE * map + 0.06::DOUBLE * time + CASE WHEN same THEN 0.1::DOUBLE + CASE WHEN idle <= 1.5 THEN 0.05::DOUBLE ELSE 0 END ELSE 0 END
              + CASE WHEN overlap AND frozen THEN 0.22::DOUBLE ELSE 0 END AS score FROM sc)"""

_ACCEPTED = "(appearance >= 0.82 OR (same AND score >= 0.22) OR (overlap AND frozen AND score >= 0.2) OR score >= 0.28)"

#: The best matching of each camera frame: identities come one after the other, each skipped or given to one of the detections that are still free (a set of bits).
#: The best way to each set is kept, with what it chose in base 16.
_MATCHED = f"""{_MOMENTS},
ix AS (SELECT cam_name, frame_no, gid, det_id, score, dense_rank() OVER (PARTITION BY cam_name, frame_no ORDER BY gid) AS j, dense_rank() OVER (PARTITION BY cam_name, frame_no ORDER BY det_id) - 1 AS i FROM fi),
sz AS (SELECT cam_name, frame_no, CAST(max(j) AS INTEGER) AS m, least(max(j), max(i) + 1) AS most FROM ix GROUP BY cam_name, frame_no),
dp(cam_name, frame_no, m, j, mask, total, picks) AS (
  SELECT cam_name, frame_no, m, 0, CAST(0 AS BIGINT), 0.0::DOUBLE, CAST(0 AS BIGINT) FROM sz
  UNION ALL SELECT cam_name, frame_no, any_value(m), j, mask, max(total), arg_max(picks, total) FROM
    (SELECT dp.cam_name, dp.frame_no, dp.m, dp.j + 1 AS j, dp.mask, dp.total, dp.picks FROM dp WHERE dp.j < dp.m
     UNION ALL SELECT dp.cam_name, dp.frame_no, dp.m, dp.j + 1, dp.mask + (CAST(1 AS BIGINT) << ix.i), dp.total + ix.score, dp.picks + (ix.i + 1) * (CAST(1 AS BIGINT) << (4 * dp.j))
     FROM dp JOIN ix ON ix.cam_name = dp.cam_name AND ix.frame_no = dp.frame_no AND ix.j = dp.j + 1 AND (dp.mask >> ix.i) & 1 = 0) w
    GROUP BY cam_name, frame_no, j, mask),
bt AS (SELECT dp.cam_name, dp.frame_no, arg_max(dp.picks, dp.total) AS picks FROM dp JOIN sz ON sz.cam_name = dp.cam_name AND sz.frame_no = dp.frame_no AND dp.j = sz.m
       WHERE bit_count(dp.mask) = sz.most GROUP BY dp.cam_name, dp.frame_no),
ma AS (SELECT ix.det_id, ix.gid FROM ix JOIN bt ON bt.cam_name = ix.cam_name AND bt.frame_no = ix.frame_no WHERE (bt.picks >> (4 * (ix.j - 1))) & 15 = ix.i + 1)"""

#: What each detection's hold, track and continuity offer, who is alive, and the choice by order of detection.
_LOCKS = f"""{_GREEDY},
s0 AS (SELECT *, CAST(trunc((x1 + x2) / 2) AS BIGINT) AS fx, y2 AS fy FROM d),
s AS (SELECT *, greatest(1, x2 - x1) AS box_w, greatest(1, y2 - y1) AS box_h, {_MAP[0]} AS map_x, {_MAP[1]} AS map_y FROM s0),
{_OVERLAPPED}, {_KNOWN}, ho AS (SELECT so.* FROM so JOIN ov ON ov.det_id = so.det_id),
of0 AS (SELECT a.det_id, 0 AS place, h.person AS gid, h.conf AS score, 'occlusion-hold' AS source FROM so a ASOF JOIN ho h ON a.cam_name = h.cam_name AND a.tid = h.tid AND a.o > h.o WHERE a.ts_ms - h.ts_ms <= 800
        UNION ALL SELECT a.det_id, 1, b.person, NULL, 'local-track' FROM so a ASOF JOIN so b ON a.cam_name = b.cam_name AND a.tid = b.tid AND a.o > b.o WHERE a.ts_ms - b.ts_ms <= 25000
        UNION ALL SELECT so.det_id, 2, t.forced_gid, 1.0, 'occlusion-forced' FROM so JOIN ov ON ov.det_id = so.det_id JOIN t ON t.cam_name = so.cam_name AND t.frame_no = so.frame_no AND t.det_idx = so.det_idx),
of1 AS (SELECT so.cam_name, so.frame_no, so.det_id, f.gid, coalesce(f.score, kn.l_score) AS score, f.source, row_number() OVER (PARTITION BY so.cam_name, so.frame_no ORDER BY so.det_idx, f.place) AS k
        FROM of0 f JOIN so ON so.det_id = f.det_id JOIN kn ON kn.cam_name = so.cam_name AND kn.frame_no = so.frame_no AND kn.gid = f.gid),
lk(cam_name, frame_no, k, dets, gids, det_id, gid, score, source) AS (
  SELECT DISTINCT cam_name, frame_no, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM of1
  UNION ALL SELECT w.cam_name, w.frame_no, w.k, CASE WHEN free THEN list_append(dets, det) ELSE dets END, CASE WHEN free THEN list_append(gids, g) ELSE gids END,
                   CASE WHEN free THEN det END, CASE WHEN free THEN g END, CASE WHEN free THEN w.score END, CASE WHEN free THEN w.source END
  FROM (SELECT lk.cam_name, lk.frame_no, f.k, lk.dets, lk.gids, f.det_id AS det, f.gid AS g, f.score, f.source, NOT list_contains(lk.dets, f.det_id) AND NOT list_contains(lk.gids, f.gid) AS free
        FROM lk JOIN of1 f ON f.cam_name = lk.cam_name AND f.frame_no = lk.frame_no AND f.k = lk.k + 1) w)"""

_LATEST = "SELECT gid, arg_max(greatest(0, least(map_x, 899)), ts_ms * 100000000 + det_id) AS map_x, arg_max(greatest(0, least(map_y, 599)), ts_ms * 100000000 + det_id) AS map_y, max(ts_ms) AS last_seen_ms"


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select}"


SQL: dict[str, str] = {
    "scan_detections": _with(_D, "SELECT det_id, cam_name, frame_no, det_idx, ts_ms, tid, x1, y1, x2, y2, conf FROM d"),
    "scan_replay": _with(_D, "SELECT det_id, CAST(l.range AS INTEGER) AS loop, cam_name, frame_no + l.range * (max(frame_no) OVER (PARTITION BY cam_name) + 1) AS frame_no, ts_ms + l.range * (max(frame_no) OVER (PARTITION BY cam_name) + 1) * 200 AS ts_ms FROM d, range(3) l"),
    "first_frame": _with(_D, "SELECT cam_name, frame_no, det_idx, det_id FROM d QUALIFY frame_no = min(frame_no) OVER (PARTITION BY cam_name)"),
    "ext_whitelist": _with(_LOG, "SELECT seq, url, CASE WHEN lower(url) LIKE '%.mp4' THEN '.mp4' ELSE '.webm' END AS extension FROM parsed WHERE video"),
    "parse_points": _with(_LOG, "SELECT seq, valid, CASE WHEN valid THEN p[1][1] END AS first_x, CASE WHEN valid THEN p[4][2] END AS last_y FROM checked"),
    "calib_valid": _with(_LOG, "SELECT seq, valid AS four_points, fixes AS calibrates FROM fixed"),
    "registry_upsert": _with(_LOG, "SELECT name, seq, url FROM added"),
    "registry_delete": _with(_LOG, "SELECT name, seq, url FROM state"),
    "registry_lookup": _with(_LOG, "SELECT name, seq, url, CASE WHEN video THEN 'video' ELSE 'camera' END AS source_type FROM state WHERE name = 'cam_7'"),
    "registry_listing": _with(_LOG, "SELECT name, url AS source, CASE WHEN video THEN 'video' ELSE 'camera' END AS source_type, CASE WHEN video THEN 'VIDEO' ELSE 'CAMERA' END AS badge, CASE WHEN video THEN CASE WHEN loop_video THEN 'Loop ON' ELSE 'Loop OFF' END END AS loop_badge, CASE WHEN fixes THEN 'Calibrated' ELSE 'Not Calibrated' END AS calibration_badge FROM state"),
    "camera_config": _with(_LOG, """SELECT name, '{"name":"' || name || '","source_type":"' || CASE WHEN video THEN 'video' ELSE 'camera' END || '","loop_video":' || loop_video || ',"has_homography":' || fixes || '}' AS config FROM state"""),
    "explode_boxes": _with(_D, "SELECT cam_name, frame_no, row_number() OVER (PARTITION BY cam_name, frame_no ORDER BY det_idx) - 1 AS det_idx, x1, y1, x2, y2 FROM d"),
    "trunc_box": _with(_D, "SELECT det_id, " + ", ".join(f"CAST(trunc({c} * 0.37::DOUBLE - 50.5::DOUBLE) AS BIGINT) AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM d"),
    "foot_point": _with(_D, "SELECT det_id, (x1 + x2) // 2 AS foot_x, y2 AS foot_y FROM d"),
    "local_id": _with(_D, "SELECT det_id, CASE WHEN det_id % 5 = 0 THEN det_idx ELSE tid END AS tid, CASE WHEN det_id % 3 <> 0 THEN conf END AS conf FROM d"),
    "box_wh": _with(_D, "SELECT det_id, greatest(1, x2 - 100 - x1) AS box_w, greatest(1, y2 - y1) AS box_h FROM d"),
    "bbox_center": _with(_D, f"SELECT det_id, {_CENTER} FROM d"),
    "clamp_bbox": _with(_D, "SELECT det_id, " + ", ".join(f"{e} AS {n}" for e, n in zip(_clamp("x1 - 60", "y1 + 40", "x2 - 20", "y2 + 40", 1000, 300), ("x1", "y1", "x2", "y2"), strict=True)) + " FROM d"),
    "crop_rect": _with(_CROPS, "SELECT det_id, x1, y1, x2, y2 FROM k"),
    "min_crop": _with(_CROPS, "SELECT det_id FROM k WHERE x2 - x1 >= 24 AND y2 - y1 >= 24"),
    "labels_fmt": _with(_D, "SELECT det_id, 'GID ' || person || CASE WHEN det_id % 3 <> 0 THEN printf(' %.2f', conf) ELSE '' END || ' | L' || tid AS label, printf('batch-match:%.2f', conf) || CASE WHEN det_id % 4 = 0 THEN ' | OCC' ELSE '' END AS detail, CASE WHEN det_id % 4 = 0 THEN 255 ELSE 0 END AS red FROM d"),
    "local_gid": _with(_D, "SELECT det_id, cam_name || '-' || tid AS gid, CAST(tid AS VARCHAR) AS tracker FROM d"),
    "annotated_rows": _with(
        _PAIRS,
        "SELECT det_id, 'GID ' || person AS label, printf('batch-match:%.2f', conf) || CASE WHEN o.at IS NOT NULL THEN ' | OCC' ELSE '' END AS detail, "
        "CASE WHEN o.at IS NOT NULL THEN 255 ELSE 0 END AS red FROM d LEFT JOIN (SELECT cam_name, frame_no, det_idx, det_idx AS at FROM f) o USING (cam_name, frame_no, det_idx)",
    ),
    "image_base64": _with(
        _LOG, "SELECT seq, CAST(strlen(c) AS BIGINT) AS length, base64(encode(c)) AS image_base64 FROM (SELECT seq, concat_ws('|', url, points) AS c FROM log)"
    ),
    "floorplan_default": _with(
        _LOG,
        "SELECT true AS uploaded, coalesce(arg_max(300 + seq * 7 % 701, seq), 900) AS width, coalesce(arg_max(200 + seq * 13 % 701, seq), 600) AS height "
        "FROM log WHERE points LIKE '[[%' UNION ALL SELECT false, 900, 600",
    ),
    "safe_filename": _with(_LOG, r"SELECT seq, coalesce(nullif(trim(regexp_replace(CASE WHEN seq % 9 = 0 THEN '/()/' ELSE url END, '[^\p{L}\p{N} ._-]', '', 'g')), ''), 'video_' || seq || '.mp4') AS name FROM log"),
    "url_kind": _with(_LOG, "SELECT seq, CAST(TRY_CAST(url AS BIGINT) AS VARCHAR) AS device, CASE WHEN video THEN 'video' ELSE 'camera' END AS source_type FROM parsed"),
    "fps_default": _with(_LOG, "SELECT seq, f AS fps, 1 / f AS delay FROM (SELECT seq, CAST(CASE WHEN seq % 11 = 0 OR seq % 5 = 0 OR seq % 4 < 2 THEN 25 ELSE (seq % 4 - 1) * 10 END AS DOUBLE) AS f FROM log)"),
    "conf_filter": _with(_D, "SELECT det_id, conf FROM d WHERE conf >= 0.55::DOUBLE"),
    "polygon_filter": _with(_S, f"SELECT det_id, fx AS foot_x, fy AS foot_y FROM s WHERE conf >= 0.55::DOUBLE AND {_inside('fx', 'fy')}"),
    "alive_semi": _with(_D, "SELECT det_id, person AS gid FROM d WHERE person IN (SELECT person FROM d GROUP BY person HAVING (SELECT max(ts_ms) FROM d) - max(ts_ms) <= 25000)"),
    "homography_fit": _with(
        f"{_LOG}, tg(i, x, y) AS (VALUES (0, 50, 50), (1, 850, 50), (2, 850, 550), (3, 50, 550))",
        "SELECT seq, CAST(i AS INTEGER) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM fixed, tg WHERE fixes",
    ),
    "project_floorplan": _with(_S, "SELECT det_id, map_x, map_y FROM s"),
    "bbox_iou": _with(_D, f"SELECT a.det_id, {_iou('a.', 'b.')} AS iou FROM d a JOIN d b ON a.cam_name = b.cam_name AND a.frame_no = b.frame_no AND b.det_idx = a.det_idx + 1"),
    "center_distance": _with(_D, f"SELECT a.det_id, {_centers('a.', 'b.')} AS dist FROM d a JOIN d b ON a.cam_name = b.cam_name AND a.frame_no = b.frame_no AND b.det_idx = a.det_idx + 1"),
    "map_distance": _with(_CONSECUTIVE, "SELECT det_id, dist FROM k"),
    "l2_normalize": _with(_D, "SELECT det_id, CASE WHEN det_id % 10 = 0 THEN 0.0::DOUBLE ELSE round(emb[1] / n, 6) END AS first, CASE WHEN det_id % 10 = 0 THEN 0.0::DOUBLE ELSE round(emb[64] / n, 6) END AS last, CASE WHEN det_id % 10 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length FROM (SELECT *, sqrt(list_dot_product(emb, emb)) AS n FROM d)"),
    "cosine_similarity": _with(_D, f"SELECT det_id, round({_cos('emb', 'e')}, 6) AS similarity FROM (SELECT d.*, CAST(v.embedding AS DOUBLE[]) AS e FROM d JOIN embeddings v ON v.vec_id = d.base_id)"),
    "ema_embedding": _with(f"{_D}, {_EMA.format(rows='d', order='ts_ms, cam_name, frame_no, det_idx')}", "SELECT person AS gid, round(t[1], 6) AS first, round(t[64], 6) AS last FROM tm", True),
    "gallery_ring": _with(_D, "SELECT person AS gid, det_id, round(emb[1] / sqrt(list_dot_product(emb, emb)), 6) AS first FROM d QUALIFY row_number() OVER (PARTITION BY person ORDER BY ts_ms DESC, det_id DESC) <= 6"),
    "gallery_topk": _with(f"{_D}, g AS (SELECT person, emb AS e FROM d QUALIFY row_number() OVER (PARTITION BY person ORDER BY ts_ms DESC, det_id DESC) <= 6), c AS (SELECT det_id, d.person, {_cos('d.emb', 'g.e')} AS sim FROM d JOIN g ON g.person = d.person)", "SELECT det_id, person AS gid, round(avg(sim), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY sim DESC) AS r FROM c) WHERE r <= 3 GROUP BY det_id, person"),
    "hsv_hist": "WITH h AS (SELECT event_id % 32 AS crop, (event_id * 7 % 180) // 15 * 16 + (event_id * 13 % 256) // 64 * 4 + (event_id * 31 % 256) // 64 AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT crop, bin, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY crop) AS DOUBLE)), 6) AS weight FROM h",
    "overlap_pairs": _with(_PAIRS, "SELECT * FROM o"),
    "overlap_flags": _with(_PAIRS, "SELECT * FROM f"),
    "pending_except": _with(_PAIRS, "SELECT det_id FROM d ANTI JOIN f USING (cam_name, frame_no, det_idx)"),
    "prev_candidates": _with(_PREVIOUS, "SELECT * FROM v"),
    "greedy_match": _with(_GREEDY, "SELECT cam_name, frame_no, det_idx, forced_gid FROM t WHERE det_idx IS NOT NULL", True),
    "attach_results": _with(_PREVIOUS, "SELECT d.det_id, max(v.score) AS best FROM d LEFT JOIN v USING (cam_name, frame_no, det_idx) GROUP BY d.det_id"),
    "pair_scores": _with(
        _MOMENTS, "SELECT det_id, gid, round(appearance, 6) AS appearance, round(motion, 6) AS motion, round(map, 6) AS map, round(time, 6) AS time, round(score, 6) AS score FROM fi", True
    ),
    "accept_match": _with(_MOMENTS, f"SELECT det_id, gid FROM fi WHERE {_ACCEPTED}", True),
    "candidate_gate": _with(_GATED, "SELECT cam_name, frame_no, gid, l_cam AS id_last_cam, l_ms AS id_last_ms FROM gt", True),
    "local_track_join": _with(
        _ORDERED,
        "SELECT a.det_id, CASE WHEN a.ts_ms - b.ts_ms <= 25000 THEN b.person END AS known_gid FROM so a ASOF LEFT JOIN so b ON a.cam_name = b.cam_name AND a.tid = b.tid AND a.o > b.o",
    ),
    "hold_interval_join": _with(
        f"{_ORDERED}, {_OVERLAPPED}, ho AS (SELECT so.* FROM so JOIN ov ON ov.det_id = so.det_id)",
        "SELECT a.det_id, h.person AS held_gid, h.ts_ms + 800 AS until_ms FROM so a ASOF JOIN ho h ON a.cam_name = h.cam_name AND a.tid = h.tid AND a.o > h.o WHERE a.ts_ms <= h.ts_ms + 800",
    ),
    "recent_match": _with(
        f"""{_S}, n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts_ms, cam_name, det_idx) AS rn, [x / sqrt(list_dot_product(emb, emb)) for x in emb] AS u FROM s),
        f AS (SELECT cam_name, frame_no, min(rn) AS r0 FROM n GROUP BY cam_name, frame_no),
        c AS (SELECT a.det_id, b.gid, b.rn, list_dot_product(a.u, b.u) - least({_dist("a.map_x", "a.map_y", "b.map_x", "b.map_y")} / 390, 1) * 0.10::DOUBLE
                     - least((a.ts_ms - b.ts_ms) / 1000.0::DOUBLE / 12, 1) * 0.08::DOUBLE AS score
              FROM n a JOIN f ON f.cam_name = a.cam_name AND f.frame_no = a.frame_no
              JOIN n b ON b.cam_name = a.cam_name AND b.rn BETWEEN f.r0 - 200 AND f.r0 - 1 AND a.ts_ms - b.ts_ms <= 12000
              WHERE least(a.box_w, b.box_w) / greatest(a.box_w, b.box_w) >= 0.35 AND least(a.box_h, b.box_h) / greatest(a.box_h, b.box_h) >= 0.35)""",
        "SELECT det_id, gid, round(score, 6) AS score FROM c WHERE score >= 0.36::DOUBLE QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY score DESC, rn DESC) = 1",
    ),
    "enrich_camera": _with(_S, "SELECT det_id, cam_name <> 'cam_3' AS calibrated, CASE WHEN cam_name <> 'cam_3' THEN map_x || ',' || map_y ELSE '' END AS map_pos FROM s"),
    "used_anti": _with(_D, "SELECT det_id, person AS gid FROM d WHERE NOT EXISTS (SELECT 1 FROM d u WHERE u.frame_no = d.frame_no AND u.person = d.person AND d.cam_name = 'cam_' || (CAST(u.cam_name[5:] AS INTEGER) + 1) % 4)"),
    "size_gate": _with(_CONSECUTIVE, "SELECT det_id, fits AS ok FROM k"),
    "can_match": _with(_CONSECUTIVE, "SELECT det_id, idle <= 25 AND fits AND (dist IS NULL OR dist <= CASE WHEN cam_name = l_cam THEN 390 ELSE 520 END) AS ok FROM k"),
    "time_score": _with(_CONSECUTIVE, "SELECT det_id, round(greatest(0, 1 - least(greatest(idle, 0) / 25, 1)), 6) AS score FROM k"),
    "map_score": _with(_CONSECUTIVE, "SELECT det_id, CASE WHEN dist IS NULL THEN 0.5::DOUBLE ELSE round(greatest(-0.4::DOUBLE, 1 - least(dist / 468, 1.4::DOUBLE)), 6) END AS score FROM k"),
    "recent_history": _with(_D, "SELECT cam_name, person AS gid, CAST(least(n, 3) - back + 1 AS INTEGER) AS place, det_id FROM (SELECT *, row_number() OVER (PARTITION BY cam_name, person ORDER BY ts_ms DESC, det_id DESC) AS back, count(*) OVER (PARTITION BY cam_name, person) AS n FROM d) WHERE back <= 3"),
    "predict_center": _with(_PREDICT, "SELECT det_id, round(px, 6) AS pred_x, round(py, 6) AS pred_y FROM m"),
    "motion_score": _with(_PREDICT, f"SELECT det_id, CASE WHEN px IS NULL THEN 0.5::DOUBLE ELSE round(greatest(-0.6::DOUBLE, 1 - least({_dist('center_x', 'center_y', 'px', 'py')} / greatest(40, sqrt(CAST(lw * lw + lh * lh AS DOUBLE)) * 0.75::DOUBLE), 1.6::DOUBLE)), 6) END AS score FROM m"),
    "ring60": _with(_D, "SELECT cam_name, det_id, ts_ms FROM d QUALIFY row_number() OVER (PARTITION BY cam_name ORDER BY ts_ms DESC, det_id DESC) <= 60"),
    "ring_append": _with(_D, "SELECT cam_name, det_id, ts_ms FROM (SELECT * FROM d WHERE frame_no % 2 = 1 UNION ALL SELECT * FROM d WHERE frame_no % 2 = 0 QUALIFY row_number() OVER (PARTITION BY cam_name ORDER BY ts_ms DESC, det_id DESC) <= 60) QUALIFY row_number() OVER (PARTITION BY cam_name ORDER BY ts_ms DESC, det_id DESC) <= 60"),
    "ring200": _with(_D, "SELECT cam_name, det_id, ts_ms FROM d ORDER BY ts_ms DESC, det_id DESC LIMIT 200"),
    "latest_position": _with(_S, f"{_LATEST} FROM s GROUP BY gid"),
    "active_map": _with(f"{_S}, l AS ({_LATEST} FROM s GROUP BY gid)", "SELECT * FROM l WHERE (SELECT max(last_seen_ms) FROM l) - last_seen_ms <= 700"),
    "global_map": _with(f"{_S}, l AS ({_LATEST} FROM s WHERE conf >= 0.55::DOUBLE AND {_inside('fx', 'fy')} GROUP BY gid)", "SELECT * FROM l WHERE (SELECT max(last_seen_ms) FROM l) - last_seen_ms <= 700"),
    "trail": _with(_S, "SELECT det_id, gid, count(*) OVER w AS n, first_value(map_x) OVER w AS from_x, CAST(sum(map_x) OVER w AS BIGINT) AS sum_x FROM s WINDOW w AS (PARTITION BY site_id, gid ORDER BY ts_ms, det_id ROWS 49 PRECEDING)"),
    "idle_sessions": _with(f"{_D}, b AS (SELECT person AS gid, ts_ms, det_id, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY person ORDER BY ts_ms, det_id) > 25000 THEN 1 ELSE 0 END AS opens FROM d), n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY gid ORDER BY ts_ms, det_id) AS BIGINT) AS session FROM b)", "SELECT gid, session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n FROM n GROUP BY gid, session"),
    "recent_window": _with(_D, "SELECT det_id, count(*) OVER (PARTITION BY cam_name ORDER BY ts_ms RANGE BETWEEN 12000 PRECEDING AND CURRENT ROW) AS remembered FROM d"),
    "optimal_assign": _with(_MATCHED, "SELECT ma.det_id, ma.gid, round(fi.score, 6) AS score FROM ma JOIN fi ON fi.det_id = ma.det_id AND fi.gid = ma.gid", True),
    "frame_match": _with(
        _MATCHED, f"SELECT fi.site_id, fi.cam_name, fi.frame_no, ma.det_id, ma.gid, round(fi.score, 6) AS score FROM ma JOIN fi ON fi.det_id = ma.det_id AND fi.gid = ma.gid WHERE {_ACCEPTED}", True
    ),
    "frame_locks": _with(_LOCKS, "SELECT cam_name, frame_no, det_id, gid, score, source FROM lk WHERE det_id IS NOT NULL", True),
    "hold_spans": _with(
        f"""{_D}, {_OVERLAPPED}, h AS (SELECT d.*, coalesce(lag(person) OVER w = person AND ts_ms - lag(ts_ms) OVER w <= 800, false) AS goes_on, lead(ts_ms) OVER w AS nxt
            FROM d JOIN ov ON ov.det_id = d.det_id WINDOW w AS (PARTITION BY cam_name, tid ORDER BY ts_ms)),
        i AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY cam_name, tid ORDER BY ts_ms) AS island FROM h)""",
        "SELECT cam_name, tid, min(person) AS held_gid, min(ts_ms) AS from_ms, least(max(ts_ms) + 800, coalesce(list(nxt ORDER BY ts_ms)[-1], max(ts_ms) + 800)) AS until_ms FROM i GROUP BY cam_name, tid, island",
    ),
    "calibration_at": _with(
        f"{_LOG}, {_D.strip()}, a AS (SELECT *, seq * 200 // 32 AS at, row_number() OVER (PARTITION BY name, seq * 200 // 32 ORDER BY seq DESC) AS newest FROM fixed)",
        "SELECT d.det_id, CASE WHEN a.action = 'add' THEN a.seq END AS seq, coalesce(a.action = 'add' AND a.fixes, false) AS calibrated "
        "FROM d ASOF LEFT JOIN (SELECT * FROM a WHERE newest = 1) a ON a.name = d.cam_name AND d.ts_ms > a.at",
    ),
    "crop_features": _with(
        f"""{_D}, c AS (SELECT det_id, det_id * 7 % 256 AS b, det_id * 13 % 256 AS g, det_id * 31 % 256 AS r FROM d), v AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS span FROM c),
        t AS (SELECT *, CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * span ELSE r - g + 4 * span END AS turn FROM v),
        h AS (SELECT *, CASE WHEN span = 0 THEN 0 ELSE CAST(floor(turn * 30 / greatest(span, 1) + 0.5::DOUBLE) AS BIGINT) END AS h0, CAST(floor(span * 255 / greatest(v, 1) + 0.5::DOUBLE) AS BIGINT) AS s FROM t),
        k AS (SELECT *, (CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END) % 180 // 15 * 16 + s // 64 * 4 + v // 64 AS bin FROM h)""",
        "SELECT det_id, CAST(897 AS INTEGER) AS n, bin AS upper, bin AS lower, round(floor(b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE + 0.5::DOUBLE) / 255 / 0.5::DOUBLE, 6) AS gray FROM k",
    ),
}
