"""From a game's wide row to a model's features: differences of the sides, momentum, conference features, and their names.

A settings map says per group which lags count, whether the sides become a
difference and whether the group counts at all.  Every function is one
projection; what columns come out follows from the names alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOME, AWAY, AT_HOME, ON_ROAD = "_HT", "_VT", "_HT_at_home", "_VT_on_road"


@dataclass(frozen=True)
class Group:
    """``lags`` and ``location_lags`` name the windows; ``delta`` makes a difference of the sides."""

    lags: tuple[int, ...] = ()
    location_lags: tuple[int, ...] = ()
    delta: bool = True
    enabled: bool = True


@dataclass(frozen=True)
class Momentum:
    """``feature``'s delta over the short window less that over the long one."""

    feature: str
    short: int
    long: int

    @property
    def sources(self) -> tuple[str, str]:
        return f"{self.feature}_L{self.short}_delta", f"{self.feature}_L{self.long}_delta"

    @property
    def name(self) -> str:
        return f"{self.feature}_momentum_L{self.short}_L{self.long}_delta"


#: The groups in the order of their columns, the stem of a windowed group's columns, and the defaults.
STEMS = {
    "record": "record", "point_differential": "pts_diff_avg", "norm_point_differential": "norm_pts_diff_avg", "sos": "sos", "sos_adj_record": "sos_adj_record",
    "gds": "gds", "distance": "distance", "rested_days": None, "streak": None, "last_season_record": None, "adjusted_last_season_record": None, "indifference_flag": None,
}
LOCATED = ("record", "point_differential", "norm_point_differential", "sos_adj_record", "gds", "last_season_record", "adjusted_last_season_record")
DEFAULTS = {name: Group() for name in STEMS} | {
    "point_differential": Group(enabled=False),
    "sos": Group(delta=False),
    "gds": Group(enabled=False),
    "home_and_road": Group(delta=False),
    "indifference_flag": Group(delta=False, enabled=False),
    "neutral_court": Group(delta=False, enabled=False),
}
#: What the conference features are made of.
CONFERENCE_SOURCES = ("east_record_adjusted", "west_record_adjusted", "east_record_at_east", "west_record_at_west", "games_played_at_east", "games_played_at_west", "games_played_east_vs_west")
CONFERENCE_FEATURES = {"same": (), "different": ("home_conference_vs_away_conference_record", "games_played_at_home_conference"), "all": ("conference_diff_home_advantage_pct",)}


def feature_groups(features: Mapping[str, Mapping[str, Any]]) -> dict[str, Group]:
    """The settings' ``features`` over the defaults; a group that is not named keeps its defaults, other keys are ignored."""
    out = dict(DEFAULTS)
    for name in DEFAULTS.keys() & features.keys():
        given = {k: tuple(v) if isinstance(v, (list, tuple)) else v for k, v in features[name].items() if k in Group.__dataclass_fields__}
        out[name] = replace(out[name], **given)
    return out


def _bases(group: str, lags: Sequence[int]) -> list[str]:
    return [group] if STEMS[group] is None else [f"{STEMS[group]}_L{n}" for n in lags]


def _pairs(name: str, group: Group) -> list[tuple[str, str, str]]:
    """(delta, minuend, subtrahend) of a group."""
    out = [(f"{b}_delta", b + HOME, b + AWAY) for b in _bases(name, group.lags)]
    if name == "indifference_flag":  # a visitor without a stake is the home team's gain
        out = [(d, away, home) for d, home, away in out]
    if name in LOCATED:
        out += [(f"{b}_at_location_delta", b + AT_HOME, b + ON_ROAD) for b in _bases(name, group.location_lags)]
    return out


def create_deltas(table: DataFrame, groups: Mapping[str, Group]) -> DataFrame:
    """The table with the groups' deltas in place of the columns that they are made of.

    Pairs that the table lacks are skipped.  Columns of disabled groups go; groups without delta stay as they are.  Days
    at home and on the road are added up, not subtracted.
    """
    there, made, gone = set(table.columns), [], set()
    for name in STEMS:
        group = groups[name]
        pairs = [p for p in _pairs(name, group) if group.enabled and group.delta and {p[1], p[2]} <= there]
        made += [(F.col(a) - F.col(b)).alias(d) for d, a, b in pairs]
        gone |= {c for _, a, b in (_pairs(name, group) if not group.enabled else pairs) for c in (a, b)}
    stay = groups["home_and_road"]
    if stay.enabled and stay.delta:
        made.append((F.col("days_at_home") + F.col("days_on_road")).alias("days_at_home_delta"))
    if stay.delta or not stay.enabled:
        gone |= {"days_at_home", "days_on_road"}
    if not groups["neutral_court"].enabled:
        gone.add("neutral_court")
    return table.select(*[c for c in table.columns if c not in gone], *made)


def create_momentum(table: DataFrame, pairs: Sequence[Momentum]) -> DataFrame:
    """Each pair's two deltas become their difference."""
    gone = {c for p in pairs for c in p.sources}
    return table.select(*[c for c in table.columns if c not in gone], *[(F.col(p.sources[0]) - F.col(p.sources[1])).alias(p.name) for p in pairs])


def conference_features(table: DataFrame, which: str, home: str = "home_conf", away: str = "away_conf") -> DataFrame:
    """What a model of games in the ``same``, in ``different`` or in ``all`` conferences sees of the conferences."""
    if which not in CONFERENCE_FEATURES:
        raise ValueError(f"conference filter must be same, different or all, not {which!r}")
    if which == "same":
        return table.drop(*CONFERENCE_SOURCES, *CONFERENCE_FEATURES["different"], *CONFERENCE_FEATURES["all"])
    east = F.col(home) == "East"
    if which == "different":
        record = F.when(east, F.col("east_record_at_east")).otherwise(F.col("west_record_at_west"))
        games = F.when(east, F.col("games_played_at_east")).otherwise(F.col("games_played_at_west"))
        made = dict(zip(CONFERENCE_FEATURES["different"], (record, games), strict=True))
        return table.withColumns(made).drop(*CONFERENCE_SOURCES)
    side = {c: F.when(F.col(c) == "East", 1).when(F.col(c) == "West", 0) for c in (home, away)}
    edge = (side[home] - side[away]) * (F.col("east_record_adjusted") - F.col("west_record_adjusted"))
    return table.withColumn("conference_diff_home_advantage_pct", edge).drop(home, away, "east_record_adjusted", "west_record_adjusted")


def filter_by_conference(table: DataFrame, which: str, home: str = "home_conf", away: str = "away_conf") -> DataFrame:
    """Games within one conference, across conferences (an unknown one is different from all), or all of them."""
    same = F.coalesce(F.col(home) == F.col(away), F.lit(False))
    return table.filter(same) if which == "same" else table.filter(~same) if which == "different" else table


def resolve_features(groups: Mapping[str, Group], which: str, pairs: Sequence[Momentum] = ()) -> list[str]:
    """Names and order of the features that the settings ask for, whether or not a table has them."""
    out: list[str] = []
    for name in STEMS:
        group = groups[name]
        if group.enabled and group.delta:
            out += [d for d, *_ in _pairs(name, group)]
        elif group.enabled:
            out += [b + side for b in _bases(name, group.lags) for side in (HOME, AWAY)]
    stay = groups["home_and_road"]
    if stay.enabled:
        out += ["days_at_home_delta"] if stay.delta else ["days_at_home", "days_on_road"]
    if groups["neutral_court"].enabled:
        out.append("neutral_court")
    out += CONFERENCE_FEATURES.get(which, ())
    for p in pairs:
        out = [c for c in out if c not in p.sources] + [p.name]
    return out
