"""Names, labels, file stems and class vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtloom import constants as C


def stream_number(sid: Column) -> Column:
    return F.regexp_extract(sid, r"^#?n?(\d+)", 1).cast("long")


def stream_kit(sid: Column) -> Column:
    kit = F.regexp_extract(sid, r"([BW])$", 1)
    return F.when(kit != "", kit)


def last_name(name: Column) -> Column:
    """Last word without trailing question marks; an empty name is null."""
    word = F.element_at(F.split(F.trim(F.regexp_replace(name, r"\?+$", "")), r"\s+"), -1)
    return F.when(word != "", word)


def stem_tokens(stem: Column) -> Column:
    return F.split(stem, "_")


def stem_game(stem: Column) -> Column:
    return F.element_at(stem_tokens(stem), 1)


def stem_angle(stem: Column) -> Column:
    """First camera name among tokens 1..3."""
    near = F.slice(stem_tokens(stem), 2, 3)
    found = F.filter(near, lambda t: t.isin(*C.CAMERAS))
    return F.when(F.size(found) > 0, F.element_at(found, 1))


def is_image(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(C.IMAGE_SUFFIXES) + r")$")


def play_kind(cls: Column) -> Column:
    """shot / possession_flip / turnover / ignore."""
    return (
        F.when(cls.rlike("^(FG|3PT|4PT)_(MAKE|MISS)$"), "shot")
        .when(cls == "REBOUND", "possession_flip")
        .when(cls.isin("STEAL", "TURNOVER"), "turnover")
        .otherwise("ignore")
    )


def ground_truth_zone(cls: Column) -> Column:
    return F.when(cls.startswith("4PT"), "4PT").when(cls.startswith("3PT"), "3PT").otherwise("2PT")


def ground_truth_verdict(cls: Column) -> Column:
    return F.when(cls.contains("MAKE"), "MAKE").otherwise("MISS")


def shot_class(is_free_throw: Column, zone: Column, verdict: Column) -> Column:
    base = F.when(is_free_throw, "FREE_THROW").when(zone == "2PT", "FG").otherwise(F.coalesce(zone, F.lit("FG")))
    return F.concat(base, F.lit("_"), F.coalesce(verdict, F.lit("ATTEMPT")))


def confidence_tier(rq: Column, verdict: Column) -> Column:
    return F.when((rq <= 1.6) & verdict.isNotNull(), "high").otherwise("low")


def tier_confidence(tier: Column) -> Column:
    return F.when(tier == "high", F.lit(0.8)).otherwise(F.lit(0.4))


def player_label(team: Column, jersey: Column, gid: Column) -> Column:
    colour = F.coalesce(
        *[F.when(team == letter, name) for letter, name in C.TEAM_NAMES.items()], team, F.lit("?")
    )
    return F.when(jersey.isNotNull(), F.concat(colour, F.lit(" #"), jersey.cast("string"))).otherwise(
        F.concat(colour, F.lit(" id"), gid.cast("string"))
    )


def frame_of(seconds: Column, fps: float = C.FPS) -> Column:
    return F.bround(seconds * fps).cast("long")


def seconds_of(frame: Column, frame0: Column, fps: float = C.FPS) -> Column:
    return F.bround((frame - frame0) / F.lit(fps), 2)


def clock_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.concat(
        F.lpad(F.floor(whole / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")
    )


def source_role(names: Column) -> Column:
    """detection when every class name is a tracked one, rim when all are ball/hoop, else other."""
    lowered = F.transform(names, lambda n: F.lower(F.trim(n)))

    def only(vocabulary: tuple[str, ...]) -> Column:
        allowed = F.array(*[F.lit(v) for v in vocabulary])
        return (F.size(names) > 0) & (F.size(F.array_except(lowered, allowed)) == 0)

    return F.when(only(C.DETECTION_CLASSES), "detection").when(only(C.RIM_CLASSES), "rim").otherwise("other")


def hash_bucket(group: Column, seed: int | str, modulus: int = 1000) -> Column:
    """First 8 hex digits of md5('seed:group') modulo `modulus`."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), group.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % modulus


def in_validation(group: Column, seed: int | str, fraction: float) -> Column:
    return hash_bucket(group, seed) < fraction * 1000


def read_eligible(frame: Column, stride: int, height: Column, clipped_width: Column, score: Column) -> Column:
    return (frame % stride == 0) & (height >= 90) & (clipped_width >= 20) & (score >= 0.3)
