"""Box, lens and court geometry as Column expressions (stay inside whole-stage code generation)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtloom import constants as C


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return hypot(ax - bx, ay - by)


@dataclass(frozen=True)
class Box:
    """The four columns of an xyxy box and what is derived from them."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "") -> Box:
        return Box(*[F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")])

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    @property
    def foot(self) -> tuple[Column, Column]:
        return self.cx, self.y2

    @property
    def width(self) -> Column:
        return F.greatest(self.x2 - self.x1, F.lit(1.0))

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)

    def contains(self, x: Column, y: Column, left: float = 0, top: float = 0, bottom: float = 0) -> Column:
        return x.between(self.x1 - left, self.x2 + left) & y.between(self.y1 - top, self.y2 + bottom)


def iou(a: Box, b: Box) -> Column:
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    inter = w * h
    union = a.area + b.area - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def undistort(x: Column, y: Column, lam: Column, px: Column, py: Column, diag: Column) -> tuple[Column, Column]:
    """Division lens model; a null or zero lambda leaves the point where it is."""
    qx, qy = x - px, y - py
    scale = F.lit(1.0) + F.coalesce(lam, F.lit(0.0)) * ((qx * qx + qy * qy) / (diag * diag))
    flat = lam.isNull() | (lam == 0)
    return F.when(flat, x).otherwise(qx / scale + px), F.when(flat, y).otherwise(qy / scale + py)


def project(x: Column, y: Column, h: list[Column]) -> tuple[Column, Column]:
    """Homography: nine coefficients, row major."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


H_COLUMNS = tuple(f"h{i}" for i in range(9))


def pixel_to_court(x: Column, y: Column) -> tuple[Column, Column]:
    """Full calibration (`lam px py diag h0..h8` columns present on the row)."""
    ux, uy = undistort(x, y, F.col("lam"), F.col("px"), F.col("py"), F.col("diag"))
    return project(ux, uy, [F.col(c) for c in H_COLUMNS])


def on_court(x: Column, y: Column, pad: float = C.COURT_PAD) -> Column:
    return x.between(-pad, C.COURT_LENGTH + pad) & y.between(-pad, C.COURT_WIDTH + pad)


def hull_distance(x: Column, y: Column, hull: Column) -> Column:
    """Signed distance of a point to a polygon (array of struct<x,y>): positive inside."""
    nxt = F.concat(F.slice(hull, 2, F.size(hull) - 1), F.slice(hull, 1, 1))
    edges = F.arrays_zip(hull.alias("a"), nxt.alias("b"))

    def segment(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
        t = F.when(length2 == 0, F.lit(0.0)).otherwise(
            ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length2
        )
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return distance(x, y, ax + t * (bx - ax), ay + t * (by - ay))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        straddles = (ay > y) != (by > y)
        return straddles & (x < (bx - ax) * (y - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) + ax)

    nearest = F.array_min(F.transform(edges, segment))
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.when(inside, nearest).otherwise(-nearest)


def in_hull(x: Column, y: Column, hull: Column, pad: float = C.HULL_PAD) -> Column:
    return hull.isNull() | (hull_distance(x, y, hull) >= -pad)


def zone_confidence(zone: Column, height: Column) -> Column:
    return zone * F.least(F.greatest(height / F.lit(260.0), F.lit(0.35)), F.lit(1.3))


def gated_team(team: Column, near: Column, height: Column) -> Column:
    """Team evidence counts only from near cameras and tall boxes; referees need less height."""
    return F.when(team == "REF", F.when(height >= 100, team)).when(near & (height >= 120), team)


def gated_jersey(jersey: Column, team: Column, near: Column, height: Column) -> Column:
    return F.when(near & (height >= 120) & (F.coalesce(team, F.lit("")) != "REF"), jersey)


def expanded_ball_distance(player: Box, bx: Column, by: Column, expand: float = C.POSSESS_EXPAND) -> Column:
    half_w = (player.x2 - player.x1) * expand / 2
    half_h = (player.y2 - player.y1) * expand / 2
    dx, dy = bx - player.cx, by - player.cy
    inside = (F.abs(dx) <= half_w) & (F.abs(dy) <= half_h)
    one = F.lit(1.0)
    return F.when(inside, F.lit(0.0)).otherwise(
        hypot(dx / F.greatest(half_w, one), dy / F.greatest(half_h, one))
    )


def hold_vote(player: Box, bx: Column, by: Column, imputed: Column) -> Column:
    """Vote weight of a box for holding the ball; null when the hold test fails."""
    dx = F.abs(bx - player.cx) / player.width
    held = (by <= player.y2) & (dx <= C.HOLD_D) & (by >= player.y1 - 0.1 * player.height)
    weight = F.when(imputed == 1, F.lit(0.5)).otherwise(F.lit(1.0))
    return F.when(held, weight * (F.lit(1.0) - 0.5 * dx))


def under_ball_weight(player: Box, bx: Column, by: Column, top_share: float | None = None) -> Column:
    """exp(-distance from the box top, in widths); null outside the gates."""
    w = player.width
    gate = bx.between(player.x1 - 0.6 * w, player.x2 + 0.6 * w) & (by <= player.y2)
    if top_share is not None:
        gate = gate & (by <= player.y1 + top_share * player.height)
    return F.when(gate, F.exp(-(hypot(bx - player.cx, by - player.y1) / w)))


def ankle_foot(box: Box, keypoints: Column, scores: Column, min_score: float = 0.5) -> tuple[Column, Column]:
    """Mean of the visible ankles lowered by 7% of the box height, else the box bottom."""
    ankles = F.filter(
        F.array(
            F.struct(keypoints[15]["x"].alias("x"), keypoints[15]["y"].alias("y"), scores[15].alias("s")),
            F.struct(keypoints[16]["x"].alias("x"), keypoints[16]["y"].alias("y"), scores[16].alias("s")),
        ),
        lambda k: k["s"] >= min_score,
    )
    n = F.size(ankles)
    zero = F.lit(0.0)
    mean_x = F.aggregate(ankles, zero, lambda acc, k: acc + k["x"]) / n
    mean_y = F.aggregate(ankles, zero, lambda acc, k: acc + k["y"]) / n
    return (
        F.when(n > 0, mean_x).otherwise(box.cx),
        F.when(n > 0, mean_y + 0.07 * box.height).otherwise(box.y2),
    )


def basket_distance(x: Column, y: Column) -> Column:
    left = distance(x, y, F.lit(C.BASKET_L[0]), F.lit(C.BASKET_L[1]))
    right = distance(x, y, F.lit(C.BASKET_R[0]), F.lit(C.BASKET_R[1]))
    return F.least(left, right)


def zone(dist: Column, bounds: tuple[float, float] = C.ZONE_BOUNDS) -> Column:
    return F.when(dist < bounds[0], "2PT").when(dist < bounds[1], "3PT").when(dist.isNotNull(), "4PT")


def zone_geometric(x: Column, y: Column) -> Column:
    """Court-line radii per side, used where no calibrated bounds exist."""
    left = distance(x, y, F.lit(C.BASKET_L[0]), F.lit(C.BASKET_L[1]))
    right = distance(x, y, F.lit(C.BASKET_R[0]), F.lit(C.BASKET_R[1]))
    near = F.least(left, right)
    four = F.when(left < right, F.lit(C.FOUR_PT_RADIUS["L"])).otherwise(F.lit(C.FOUR_PT_RADIUS["R"]))
    return F.when(near < C.THREE_PT_RADIUS, "2PT").when(near < four, "3PT").otherwise("4PT")


def in_free_throw_band(dist: Column, zone_name: Column) -> Column:
    return dist.between(*C.FT_BAND) & (zone_name == "2PT")


def yolo_to_xywh(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    return (cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def xyxy_to_yolo(box: Box, width: Column, height: Column) -> tuple[Column, ...]:
    return (
        box.cx / width, box.cy / height, (box.x2 - box.x1) / width, (box.y2 - box.y1) / height,
    )
