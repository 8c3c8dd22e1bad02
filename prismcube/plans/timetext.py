"""Time literals of queries and mappings, read on the driver."""

from __future__ import annotations

import calendar
import re

from .schema import QueryError

_CLOCK = r"(?:[T@ ](?P<h>\d{1,2})(?::(?P<mi>\d{1,2})(?::(?P<s>\d{1,2})(?:\.\d+)?)?)?)?\s*(?P<ap>[aApP][mM])?\s*(?P<z>Z|[-+]\d\d(?::?\d\d)?)?(?:\.\d+)?\s*"
_YMD = re.compile(r"\s*(?P<y>\d{4})(?:[-/](?P<m>\d{1,2})(?:[-/](?P<d>\d{1,2}))?)?" + _CLOCK)
_MDY = re.compile(r"\s*(?P<m>\d{1,2})[-/](?P<d>\d{1,2})[-/](?P<y>\d{4})" + _CLOCK)


def second_of(text: str) -> int:
    """Unix second of a time text; parts not given are 1 or 0, and the zone is UTC."""
    hit = _YMD.fullmatch(text) or _MDY.fullmatch(text)
    if not hit:
        raise QueryError(f"{text!r} is no time")
    n = {k: int(hit[k] or k in "md") for k in ("y", "m", "d", "h", "mi", "s")}
    n["mi"] = int(hit["mi"] or 0)
    if hit["ap"]:
        if n["h"] > 12:
            raise QueryError(f"{text!r} has an hour above 12 with a half of the day")
        n["h"] = n["h"] % 12 + (12 if hit["ap"].lower() == "pm" else 0)
    if not (1 <= n["m"] <= 12 and 1 <= n["d"] <= calendar.monthrange(max(n["y"], 1), n["m"])[1] and n["h"] < 24 and n["mi"] < 60 and n["s"] < 60):
        raise QueryError(f"{text!r} is no time")
    away = 0
    if hit["z"] and hit["z"] != "Z":
        digits = hit["z"][1:].replace(":", "")
        away = (int(digits[:2]) * 60 + int(digits[2:] or 0)) * (-60 if hit["z"][0] == "-" else 60)
    return calendar.timegm((n["y"], n["m"], n["d"], n["h"], n["mi"], n["s"])) - away
