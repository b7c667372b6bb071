"""Cross-camera fusion over time: one table of tracks per game chunk, held as arrays and stepped frame by frame.

Spark gates, clusters and deals out the chunks; a task keeps its tracks as columns (motion, votes, appearance, last
sighting by camera), so gates, costs and updates of a frame are array expressions over all groups and tracks at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtloom.operators import kernels as K

#: Fixed values of the association model.
FUSION = {
    "dt": 1 / 30, "w_d": 1.0, "w_a": 3.0, "w_t": 1.0, "w_j": 8.0, "max_dist": 600.0, "gate_cost": 7.0, "lost_buffer": 60,
    "reentry_frames": 100000, "reentry_dist": 350.0, "reentry_score": 0.55, "merge_dist": 120.0, "min_hits": 4, "jersey_votes": 3,
    "decay": 0.98, "emit_coast": 0, "solo_clear": 150.0, "near_frames": 25,
}
#: Shadow radius as a share of `merge_dist`, most frames seen together, least likeness of one person,
#: frames within which two local ids of a camera are two people; votes and share that settle a team.
SHADOW_REACH, SHADOW_BOTH, SHADOW_LOOK, SHADOW_CAM, NUMBER_LOOK = 0.66, 0.3, 0.55, 12, 0.5
SETTLED_VOTES, SETTLED_SHARE, VOTE_FLOOR = 10, 0.8, 0.01
LIVE, LOST, GONE = 0, 1, 2
REFEREE = "REF"


@dataclass
class Frame:
    """The groups of one frame as columns, and their members as columns with the group's row in `group`."""

    number: int
    xy: np.ndarray
    mean: np.ndarray
    weight: np.ndarray
    team: list
    jersey: list
    look: np.ndarray            # rows of NaN where unknown
    first_look: np.ndarray
    group: np.ndarray
    cam: list
    track: list
    member_team: list
    member_jersey: list
    zone: np.ndarray
    member_look: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.bincount(self.group, minlength=len(self.xy))


def _leading(values: list) -> list:
    """Most frequent known value of each list, the first seen of equals."""
    return [max(dict.fromkeys(known), key=known.count) if (known := [v for v in vs if v is not None]) else None for vs in values]


def frames(pdf: pd.DataFrame) -> Iterator[Frame]:
    """Frames in order; columns frame, group_id, cam, track_id, cx, cy, team, jersey, score, zone_conf and maybe reid."""
    p = pdf.sort_values(["frame", "group_id", "cam", "track_id"], kind="stable")
    if not len(p):
        return
    team = [t if isinstance(t, str) and t else None for t in p["team"]]
    jersey = [None if pd.isna(j) or j < 0 else int(j) for j in p["jersey"]]
    raw = list(p["reid"]) if "reid" in p else [None] * len(p)
    width = next((len(v) for v in raw if v is not None), 1)
    none = np.full(width, np.nan)
    look = np.array([none if v is None else np.asarray(v, float) for v in raw]).reshape(len(p), width)
    frame, own, cam, track = p["frame"].to_numpy(), p["group_id"].to_numpy(), p["cam"].tolist(), p["track_id"].tolist()
    xy, zone = p[["cx", "cy"]].to_numpy(float), p["zone_conf"].to_numpy(float)
    weight = np.maximum(zone * p["score"].to_numpy(float), 1e-3)
    # all groups of the table at once; a frame is a slice of them
    first = np.concatenate(([True], frame[1:] != frame[:-1]))
    group = np.cumsum(first | np.concatenate(([True], own[1:] != own[:-1]))) - 1
    n = int(group[-1]) + 1
    total, count = np.bincount(group, weight, n), np.bincount(group, minlength=n)

    def mean(values: np.ndarray, share: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(group, c * share, n) for c in values.T], axis=1) / by[:, None]

    centre, middle = mean(xy, weight, total), mean(xy, np.ones(len(p)), count)
    known = ~np.isnan(look[:, 0])
    if known.any():
        with np.errstate(invalid="ignore", divide="ignore"):
            shared_look = mean(np.nan_to_num(look), known.astype(float), np.bincount(group, known, n))
        first_look = np.full((n, width), np.nan)
        at = np.flatnonzero(known)[::-1]
        first_look[group[at]] = look[at]            # of rows with one index the last is kept: the group's first
    else:
        shared_look = first_look = np.full((n, width), np.nan)
    edge = [*np.searchsorted(group, np.arange(n)).tolist(), len(p)]
    teams, numbers = (_leading([v[lo:hi] for lo, hi in zip(edge[:-1], edge[1:])]) for v in (team, jersey))
    cut = [*np.flatnonzero(first).tolist(), len(p)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        g, h = int(group[lo]), int(group[hi - 1]) + 1
        yield Frame(int(frame[lo]), centre[g:h], middle[g:h], total[g:h], teams[g:h], numbers[g:h], shared_look[g:h], first_look[g:h],
                    group[lo:hi] - g, cam[lo:hi], track[lo:hi], team[lo:hi], jersey[lo:hi], zone[lo:hi], look[lo:hi])


class Votes:
    """Fading votes for labels by track: for each a dictionary of the labels that hold votes, the one held longest first,
    and its leader, kept until its votes change. Tracks hold few labels, so plain numbers are faster than a matrix."""

    def __init__(self):
        self.labels: dict = {}
        self.held: list[dict] = []
        self.leader: list[tuple] = []       # (label or None, its votes, all votes)

    def new(self) -> None:
        self.held.append({})
        self.leader.append((None, 0.0, 0.0))

    def fade(self, row: int, by: float) -> None:
        votes = self.held[row]
        for label in list(votes):
            kept = votes[label] * by
            if kept < VOTE_FLOOR:
                del votes[label]
            else:
                votes[label] = kept

    def add(self, row: int, label, weight: float) -> None:
        self.labels.setdefault(label, len(self.labels))
        votes = self.held[row]
        if label in votes:
            votes[label] += weight
        elif weight != 0:
            votes[label] = weight

    def merge(self, into: int, source: int) -> None:
        for label, value in self.held[source].items():
            if value > 0:
                self.add(into, label, value)
        self.lead(into)

    def withdraw(self, row: int) -> None:
        self.held[row].clear()
        self.lead(row)

    def lead(self, row: int) -> None:
        """Find the leader of a row anew; of equal votes the label held longest."""
        votes, label, top, total = self.held[row], None, 0.0, 0.0
        for name in votes if len(votes) < 3 else sorted(votes, key=self.labels.get):       # sums in one order for all
            total += votes[name]
        if total != total:
            top = total
        else:
            for name, value in votes.items():
                if value > top:
                    label, top = name, value
        self.leader[row] = label, top, total


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with each row of `b`; NaN where either is unknown."""
    return a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None] + 1e-8)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a[:, None] - b[None]
    return np.hypot(d[..., 0], d[..., 1])


class CourtTracks:
    """Every track of a chunk; row order is id order. `step` takes a frame and returns the rows to report.

    Motion and looks are arrays over all tracks, so a frame's gates, costs and updates are array expressions; votes,
    sightings, counters and phases are plain values by track, as a frame changes few of them."""

    def __init__(self, **params):
        self.p = {**FUSION, **params}
        self.motion, self.spread = np.zeros((0, 2, 2)), np.zeros((0, 2, 2))
        self.team, self.jersey = Votes(), Votes()
        self.look, self.looks = np.zeros((0, 1)), False         # looks: any track has one
        self.hits, self.age, self.last, self.members, self.phase, self.entry, self.alias = ([] for _ in range(7))
        self.sights: list[dict] = []                            # last (frame, local track) by camera
        self.by_phase: dict[int, dict[int, None]] = {LIVE: {}, LOST: {}}        # rows by the time they came into it
        self.codes: dict = {None: 0}
        self.close: dict[tuple[int, int], tuple[int, int]] = {}
        self.entries = 0
        dt = self.p["dt"]
        still = K.PlanarFilter((0.0, 0.0), dt=dt)
        self.a, self.q, self.r, self.p0 = still.a, still.q, still.r, still.p

    # --- views
    def rows(self, phase: int) -> list[int]:
        """Tracks of a phase by the time they came into it."""
        return list(self.by_phase[phase])

    def xy(self, rows) -> np.ndarray:
        return self.motion[np.asarray(rows, dtype=int), 0]

    def team_of(self, row: int):
        return self.team.leader[row][0]

    def number_of(self, row: int):
        number, votes, _ = self.jersey.leader[row]
        return number if votes >= self.p["jersey_votes"] and self.team.leader[row][0] != REFEREE else None

    def numbers(self, rows) -> list:
        return [self.number_of(row) for row in rows]

    def root(self, row: int) -> int:
        while self.alias[row] != row:
            row = self.alias[row]
        return row

    def _code(self, labels: list) -> np.ndarray:
        """Labels as numbers, 0 where unknown."""
        codes = self.codes
        return np.array([codes.setdefault(label, len(codes)) for label in labels], dtype=int)

    # --- a frame
    def step(self, f: Frame) -> np.ndarray:
        live = self.rows(LIVE)
        at = np.array(live, dtype=int)
        self.motion[at] = self.a @ self.motion[at]
        self.spread[at] = self.a @ self.spread[at] @ self.a.T + self.q
        for row in live:
            self.age[row] += 1
        owner = self._assign(f, live, at)
        members: list[list[int]] = [[] for _ in owner]
        for m, g in enumerate(f.group.tolist()):
            members[g].append(m)
        self._observe(f, [g for g, row in enumerate(owner) if row >= 0], [row for row in owner if row >= 0], members)
        for g, row in enumerate(owner):
            if row < 0:
                back = self._returned(f, g)
                if back is None and not self._splinter(f, g):
                    back = self._new(f, g)
                if back is not None:
                    self._observe(f, [g], [back], members, moved=self.hits[back] > 0)
        self._retire(f.number)
        self._join_shadows(f.number)
        self._settle_numbers()
        return np.array([r for r in self.by_phase[LIVE] if self.hits[r] >= self.p["min_hits"] and self.age[r] <= self.p["emit_coast"]], dtype=int)

    def _assign(self, f: Frame, live: list[int], at: np.ndarray) -> list[int]:
        """Track of each group by the least total cost of distance, team, number and appearance, or -1."""
        p, out = self.p, [-1] * len(f.xy)
        if not live or not out:
            return out
        leaders = [self.team.leader[row] for row in live]
        settled = np.array([votes >= SETTLED_VOTES and lead >= SETTLED_SHARE * votes for _, lead, votes in leaders])
        team, number = self._code([x[0] for x in leaders]), self._code([self.number_of(row) for row in live])
        group_team, group_number = self._code(f.team)[:, None], self._code(f.jersey)[:, None]
        clash = (group_team != team) & (group_team > 0) & (team > 0)
        both = (group_number > 0) & (number > 0)
        apart = _apart(f.xy, self.motion[at, 0])
        cost = p["w_d"] * apart / 100.0 + p["w_t"] * clash - p["w_j"] * both
        if self.looks and self.look.shape[1] == f.look.shape[1]:
            cost = cost + np.nan_to_num(p["w_a"] * (1.0 - likeness(f.look, self.look[at])))
        never = (apart > p["max_dist"]) | (clash & settled) | (both & ((group_number != number) | clash))
        cost[never] = K.LARGE
        for g, t in K.assign(cost):
            if cost[g, t] < p["gate_cost"]:
                out[g] = live[t]
        return out

    def _observe(self, f: Frame, groups: list[int], rows: list[int], members: list[list[int]], moved: bool = True) -> None:
        """Give groups to their tracks: motion, votes, appearance and last sightings."""
        if not rows:
            return
        if moved:
            has, at = np.array(groups), np.array(rows)
            spread, motion = self.spread[at], self.motion[at]
            gain = spread[:, :, 0] / (spread[:, 0, 0] + self.r / np.maximum(f.weight[has], 1e-3))[:, None]
            self.motion[at] = motion + gain[:, :, None] * (f.xy[has] - motion[:, 0])[:, None, :]
            self.spread[at] = spread - gain[:, :, None] * spread[:, 0][:, None, :]
        team, jersey, decay, zones = self.team, self.jersey, self.p["decay"], f.zone
        for g, row in zip(groups, rows, strict=True):
            team.fade(row, decay)
            jersey.fade(row, decay)
            sights = self.sights[row]
            for m in members[g]:
                zone = float(zones[m])
                if f.member_team[m] is not None:
                    team.add(row, f.member_team[m], zone)
                if f.member_jersey[m] is not None:
                    jersey.add(row, f.member_jersey[m], zone)
                sights[f.cam[m]] = f.number, f.track[m]
            team.lead(row)
            jersey.lead(row)
            self.members[row] = len(members[g])
            self.hits[row] += 1
            self.age[row], self.last[row] = 0, f.number
        mine = np.array(sorted(m for g in groups for m in members[g]), dtype=int)
        known = mine[~np.isnan(f.member_look[mine, 0])]
        if len(known):
            if self.look.shape[1] != f.member_look.shape[1]:
                self.look = np.full((len(self.look), f.member_look.shape[1]), np.nan)
            owner = dict(zip(groups, rows))
            seen = np.array([owner[g] for g in f.group[known].tolist()])
            fresh = np.isnan(self.look[seen, 0])
            self.look[seen[fresh]] = 0.0
            np.add.at(self.look, seen, f.member_look[known] / (np.linalg.norm(f.member_look[known], axis=1)[:, None] + 1e-8))
            self.looks = True

    def _enter(self, row: int, phase: int) -> None:
        self.entries += 1
        self.by_phase.get(self.phase[row], {}).pop(row, None)
        self.phase[row], self.entry[row] = phase, self.entries
        if phase in self.by_phase:
            self.by_phase[phase][row] = None

    def _new(self, f: Frame, g: int) -> int:
        row = len(self.hits)
        self.motion = np.concatenate((self.motion, [[f.mean[g], [0.0, 0.0]]]))
        self.spread = np.concatenate((self.spread, [self.p0]))
        self.look = np.vstack((self.look, np.full((1, self.look.shape[1]), np.nan)))
        for x in (self.hits, self.age, self.members, self.phase, self.entry):
            x.append(0)
        self.last.append(-1)
        self.alias.append(row)
        self.team.new()
        self.jersey.new()
        self.sights.append({})
        self._enter(row, LIVE)
        return row

    def _splinter(self, f: Frame, g: int) -> bool:
        """A single camera's group close to a live track is a splinter of it, not a new person."""
        live = self.rows(LIVE)
        return bool(f.sizes[g] == 1 and live and _apart(f.mean[g : g + 1], self.xy(live)).min() < self.p["solo_clear"])

    def _returned(self, f: Frame, g: int) -> int | None:
        """The lost track within reach that number and appearance speak for most, if enough."""
        lost = self.rows(LOST)
        if not lost:
            return None
        team, number = f.team[g], f.jersey[g]
        near = np.flatnonzero(~(_apart(f.mean[g : g + 1], self.xy(lost))[0] > self.p["reentry_dist"])).tolist()
        if not near:
            return None
        like = None
        if self.looks and self.look.shape[1] == f.first_look.shape[1]:
            like = np.nan_to_num(likeness(f.first_look[g : g + 1], self.look[lost])[0])
        best, top = None, self.p["reentry_score"]
        for i in near:
            row = lost[i]
            its_team, its_number = self.team_of(row), self.number_of(row)
            if f.number - self.last[row] > self.p["reentry_frames"] or (None not in (team, its_team) and team != its_team) or (None not in (number, its_number) and number != its_number):
                continue
            score = float(number is not None and its_number == number) + (like[i] if like is not None else 0.0)
            if score > top:
                best, top = row, score
        if best is not None:
            self._enter(best, LIVE)
        return best

    def _retire(self, frame: int) -> None:
        for row in self.rows(LIVE):
            if self.age[row] > self.p["lost_buffer"]:
                self._enter(row, LOST)
        for row in self.rows(LOST):
            if frame - self.last[row] > self.p["reentry_frames"]:
                del self.by_phase[LOST][row]
                self.phase[row] = GONE

    def _absorb(self, a: int, b: int) -> tuple[int, int]:
        """Merge two live tracks into the one with more hits (the first of equals); returns (kept, merged)."""
        keep, drop = (a, b) if self.hits[a] >= self.hits[b] else (b, a)
        self.team.merge(keep, drop)
        self.jersey.merge(keep, drop)
        self.look[keep] = np.where(np.isnan(self.look[keep]), self.look[drop], self.look[keep] + np.nan_to_num(self.look[drop]))
        self.hits[keep] += self.hits[drop]
        mine = self.sights[keep]
        for cam, sight in self.sights[drop].items():
            if cam not in mine or sight[0] > mine[cam][0]:
                mine[cam] = sight
        self.by_phase.get(self.phase[drop], {}).pop(drop, None)
        self.phase[drop], self.alias[drop] = GONE, keep
        return keep, drop

    def _like(self, a: int, b: int) -> float:
        return float(likeness(self.look[[a]], self.look[[b]])[0, 0]) if self.looks else np.nan

    def _two_people(self, a: int, b: int, frame: int) -> bool:
        mine, its, since = self.sights[a], self.sights[b], frame - SHADOW_CAM
        if any(cam in its and mine[cam][0] >= since and its[cam][0] >= since and mine[cam][1] != its[cam][1] for cam in mine):
            return True
        number = self.number_of(a), self.number_of(b)
        return bool((None not in number and number[0] != number[1]) or self._like(a, b) < SHADOW_LOOK)

    def _join_shadows(self, frame: int) -> None:
        """Tracks that stay close for long but are seldom both observed are one person."""
        live = sorted(self.by_phase[LIVE])
        pairs: list[tuple[int, int]] = []
        if len(live) > 1:
            xy = self.xy(live)
            i, j = np.nonzero(_apart(xy, xy) <= SHADOW_REACH * self.p["merge_dist"])
            pairs = [(live[a], live[b]) for a, b in zip(i.tolist(), j.tolist()) if a < b]
            pairs.sort(key=lambda p: (self.entry[p[0]], self.entry[p[1]]))
        kept = {}
        for a, b in pairs:
            if self.phase[a] != LIVE or self.phase[b] != LIVE:
                continue
            n, both = self.close.get((a, b), (0, 0))
            n, both = n + 1, both + int(self.age[a] == 0 and self.age[b] == 0)
            if n >= self.p["near_frames"] and both <= SHADOW_BOTH * n and not self._two_people(a, b, frame):
                self._absorb(a, b)
            else:
                kept[a, b] = n, both
        self.close = kept

    def _settle_numbers(self) -> None:
        """One live track for a team and number: a shadow that looks alike is merged, else the lesser claim is withdrawn."""
        holder: dict[tuple, int] = {}
        for row, key in [(row, (self.team_of(row), self.number_of(row))) for row in self.by_phase[LIVE]]:
            if None in key:
                continue
            if key not in holder:
                holder[key] = row
                continue
            a = holder[key]
            keep, drop = (a, row) if self.hits[a] >= self.hits[row] else (row, a)
            if self._like(keep, drop) < NUMBER_LOOK or (self.age[keep] == 0 and self.age[drop] == 0):
                self.jersey.withdraw(drop)
            else:
                self._absorb(keep, drop)
            holder[key] = keep


REPORT = "frame long, gid long, cx double, cy double, team string, jersey long, n_members long, coasting boolean"


def report(tracks: CourtTracks, f: Frame) -> list[tuple]:
    """Rows of REPORT for a frame; ids count from 1."""
    rows = tracks.step(f).tolist()
    return [(f.number, r + 1, round(x, 1), round(y, 1), tracks.team_of(r), tracks.number_of(r), tracks.members[r], tracks.age[r] > 0)
            for r, (x, y) in zip(rows, tracks.xy(rows).tolist(), strict=True)]


def _fused(seen: Iterable[Frame], params: dict) -> pd.DataFrame:
    tracks = CourtTracks(**params)
    rows = [r for f in seen for r in report(tracks, f)]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])
    out["jersey"] = out["jersey"].astype("Int64")
    roots = [tracks.root(i) + 1 for i in range(len(tracks.alias))]           # merges hold for the frames before them
    out["gid"] = [roots[i - 1] for i in out["gid"]]
    return out.drop_duplicates(["frame", "gid"])


def fuse_groups(groups: DataFrame, keys: Sequence[str] = ("game", "chunk"), **params) -> DataFrame:
    """Fused tracks from clustered observations.

    `groups`: one row per (keys, frame, group_id, member) with cam, track_id, cx, cy, team, jersey, score, zone_conf and
    optionally reid (array<double>), as `votes.cluster_players` members exploded.
    """
    from courtloom.operators.tracking import per_group

    return per_group(groups, keys, lambda pdf: _fused(frames(pdf), params), REPORT)


def fusion_grid(groups: DataFrame, keys: Sequence[str], grid: list[dict]) -> DataFrame:
    """(config, keys, frame, gid) of the fusion under every configuration. A chunk's rows are dealt out and made into frames
    once, and its task runs all configurations over them."""
    from courtloom.operators.tracking import per_group

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = list(frames(pdf))
        return pd.concat([_fused(seen, g)[["frame", "gid"]].assign(config=i) for i, g in enumerate(grid)])

    return per_group(groups, keys, work, "config int, frame long, gid long")
