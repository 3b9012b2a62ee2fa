"""Named time bands in which the opening and closing jumps of a day are looked for, as SQL predicates."""

from __future__ import annotations

BUILDING_KINDS = ["com", "res"]
DAY_KINDS = {"workday": "weekday <= 5", "weekend": "weekday > 5"}

# Commercial buildings open between 3 and 13 h and close at 3 h or later; residential ones at any hour.
OPENING = {"com": "hour BETWEEN 3 AND 13 AND ", "res": ""}
CLOSING = {"com": "hour >= 3 AND ", "res": ""}


def begin_bands() -> dict[str, str]:
    return {f"{kind}_begin_{day}": OPENING[kind] + test for kind in BUILDING_KINDS for day, test in DAY_KINDS.items()}


def end_bands() -> dict[str, str]:
    return {f"{kind}_end_{day}": CLOSING[kind] + test for kind in BUILDING_KINDS for day, test in DAY_KINDS.items()}
