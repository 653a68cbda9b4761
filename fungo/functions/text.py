"""Names, labels and search on text columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fungo.plans.schema import FORMER_SIGN, TEAM_STATUSES


def literal_map(mapping: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(mapping.items())))


def looked_up(key: Column, mapping: dict, otherwise: Column) -> Column:
    """The label of a code, or `otherwise`."""
    return F.coalesce(F.try_element_at(literal_map(mapping), key), otherwise)


def translate_team(team: Column, team_map: dict[str, str]) -> Column:
    """An exact hit in the map; else a free agent or a returning player, with the former team where it is given; else the text itself."""
    closed = F.translate(F.substring(team, F.lit(1) + F.instr(team, FORMER_SIGN), F.char_length(team)), ")", "）")
    former = F.when((F.instr(team, FORMER_SIGN) > 0) & closed.contains("）"), F.substring_index(closed, "）", 1)).otherwise("")
    known = looked_up(former, team_map, former)

    def status(plain: str, label: str) -> Column:
        return F.when(former == "", F.lit(plain)).otherwise(F.concat(F.lit(f"{label} (former "), known, F.lit(")")))

    rest = team
    for mark, plain, label in reversed(TEAM_STATUSES):
        rest = F.when(team.contains(mark), status(plain, label)).otherwise(rest)
    return looked_up(team, team_map, rest)


def english_name(name: Column) -> Column:
    """What follows " / "; else the name without full-width parentheses."""
    after = F.regexp_extract(name, "^.*? / (.*)$", 1)
    return F.when(name.contains(" / "), after).otherwise(F.trim(F.regexp_replace(name, "（.+?）", "")))


def surname(name: Column) -> Column:
    """Text before the first comma."""
    return F.substring_index(name, ",", 1)


def matches_name(name: Column, text: str) -> Column:
    """Case-insensitive substring, taken literally."""
    return F.lower(name).contains(text.lower())
