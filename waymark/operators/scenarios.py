"""Registered cases of a sensitivity study, each changing one assumption."""

from __future__ import annotations

CASE_SCHEMA = "case_id string, changed string, walk_speed_kmh double, most_access_minutes double, most_transfer_minutes double"
# Ids, the assumption that each case changes, speed in km/h, and limits in minutes.
STANDARD = ("baseline", None, 4.8, 20.0, 10.0)
CASES = (STANDARD, ("walk_speed_3_6", "walk_speed_kmh", 3.6, 20.0, 10.0), ("walk_speed_1_8", "walk_speed_kmh", 1.8, 20.0, 10.0), ("access_walk_10", "most_access_minutes", 4.8, 10.0, 10.0), ("access_walk_30", "most_access_minutes", 4.8, 30.0, 10.0), ("transfer_walk_5", "most_transfer_minutes", 4.8, 20.0, 5.0), ("transfer_walk_15", "most_transfer_minutes", 4.8, 20.0, 15.0))
_FIELDS = ("walk_speed_kmh", "most_access_minutes", "most_transfer_minutes")


def case_errors(cases: tuple) -> list[str]:
    """What breaks the rules: the standard first, ids once, one labelled change each, no set of values twice."""
    found = []
    if not cases or cases[0][0] != "baseline" or cases[0][1] is not None:
        found.append("the first case is not the baseline")
    ids, values = [c[0] for c in cases], [c[2:] for c in cases]
    found += [f"repeated id: {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    found += [f"repeated values: {c[0]}" for k, c in enumerate(cases) if c[2:] in values[:k]]
    for c in cases[1:]:
        changed = [f for f, a, b in zip(_FIELDS, c[2:], cases[0][2:], strict=True) if a != b]
        if changed != [c[1]]:
            found.append(f"{c[0]} changes {changed or 'nothing'}")
    return found
