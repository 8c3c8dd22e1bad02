"""Mixed timestamp texts to UTC instants.

Every text is reduced to its character-class mask (digits ``9``, letters ``A``,
all else kept). A distinct mask is compiled to a parser once per worker; all rows
of a mask are then converted together on a byte matrix. Local times go through
zone transition tables that the driver builds once from the JVM's rules and that
carry the version of those rules.

Defined results: null, blank, non-ASCII or unparsable text gives
``unreadable``, a text of any length is read; so does a text without a zone whose row has no known zone.
Repeated rows are judged apart, one result per input row; an empty table gives
an empty result. Only the named columns are read, so extra columns of any name
do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest form once fractions are cut to one digit (fixed by ``_FORMS``); what is longer has no form.
LONGEST = 64
#: Tables reach from year 1 to 2500. The last rules of a zone repeat with the calendar, every 400 years (CYCLE), beyond LAST.
FIRST, LAST, CYCLE = -62_135_596_800, 16_725_225_600, 12_622_780_800
INSTANT, AMBIGUOUS, NONEXISTENT, UNREADABLE = range(4)
OUTCOMES = np.array(["instant", "ambiguous", "nonexistent", "unreadable"])
MONTHS = {m: i + 1 for i, m in enumerate(["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"])}
MONTH_NAMES = {m: i + 1 for i, m in enumerate(["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"])}

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("A")

_TIME = r"(?P<h>9{1,2})(?::(?P<mi>99)(?::(?P<s>99)(?:[.,]9+)?)?)?(?P<ap> ?AA(?!A))?(?P<z> ?A| ?[-+]99(?::?99)?| ?A{3,5})?"
_DATES = [
    r"(?P<Y>9{4})(?P<sep>[-/.])(?P<m>9{1,2})(?P=sep)(?P<d>9{1,2})",
    r"(?P<a>9{1,2})(?P<sep>[-/.])(?P<b>9{1,2})(?P=sep)(?P<Y>9{4}|99)",
    r"(?P<d>9{1,2})[- ](?P<mon>A{3,9})[- ](?P<Y>9{4}|99)",
    r"(?P<mon>A{3,9}) (?P<d>9{1,2}),? (?P<Y>9{4}|99)",
]
_FORMS = [re.compile(rf"{d}(?:(?P<t>[ @A]|, ?| A){_TIME})?") for d in _DATES] + [
    re.compile(r"(?P<Y>9{4})(?P<m>99)(?P<d>99)(?P<t>[ A])(?P<h>99)(?P<mi>99)(?P<s>99)?(?P<z>A|[-+]99(?::?99)?)?")
]


@dataclass
class Zone:
    """Transition table of one time zone.

    ``local`` holds sorted local-time bounds; segment ``i`` starts at bound ``i - 1``.
    ``state`` says whether a local time in it is unique, doubled or skipped.
    """

    name: str
    version: str
    local: np.ndarray
    state: np.ndarray
    offset: np.ndarray

    def written(self, local: np.ndarray, summer: bool) -> np.ndarray:
        """Offsets of a standard or summer abbreviation as in force around local times: the
        least or greatest of those within a year; a zone without summer time then has an hour more."""
        within = local - np.maximum((local - LAST) // CYCLE + 1, 0) * CYCLE
        i = np.searchsorted(self.local, within, side="right")
        first, last = (np.searchsorted(self.local, within + d * 183 * 86400, side="right") for d in (-1, 1))
        low, high = self.offset[i].copy(), self.offset[i].copy()
        for step in range(int((last - first).max(initial=0)) + 1):
            o = self.offset[np.minimum(first + step, last)]
            low, high = np.minimum(low, o), np.maximum(high, o)
        return np.where(high > low, high, low + 3600) if summer else low

    def to_utc(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        within = local - np.maximum((local - LAST) // CYCLE + 1, 0) * CYCLE
        i = np.searchsorted(self.local, within, side="right")
        return self.state[i], local - self.offset[i]


def zone_from_transitions(name: str, version: str, first: int, changes: list[tuple[int, int]]) -> Zone:
    """A table from the offset at the start and ``(utc second, offset from then on)``."""
    bounds, state, offset, now = [], [INSTANT], [first], first
    for at, then in changes:
        if then != now:
            bounds += [at + min(now, then), at + max(now, then)]
            state += [AMBIGUOUS if then < now else NONEXISTENT, INSTANT]
            offset += [now, then]
            now = then
    return Zone(name, version, np.array(bounds, np.int64), np.array(state, np.int8), np.array(offset, np.int64))


def load_zones(spark: SparkSession, names: list[str]) -> dict[str, Zone]:
    """Transition tables of ``names`` from the JVM's zone rules; unknown names are left out."""
    j = spark._jvm.java.time
    out = {}
    for name in sorted({n for n in names if n}):
        try:
            rules = j.ZoneId.of(name).getRules()
        except Exception:  # noqa: BLE001 - an unknown zone name
            continue
        try:
            version = str(j.zone.ZoneRulesProvider.getVersions(name).lastEntry().getKey())
        except Exception:  # noqa: BLE001 - fixed offsets have no version
            version = "fixed"
        at = j.Instant.ofEpochSecond(FIRST)
        first, changes = rules.getOffset(at).getTotalSeconds(), []
        while (t := rules.nextTransition(at)) is not None and (s := t.toEpochSecond()) < LAST:
            changes.append((s, t.getOffsetAfter().getTotalSeconds()))
            at = t.getInstant()
        out[name] = zone_from_transitions(name, version, first, changes)
    return out


def _number(m: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(m), np.int64)
    for i in range(*span):
        out = out * 10 + (m[:, i] - 48)
    return out


def _words(m: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Upper-case text of a span of letters, one value per row."""
    part = np.ascontiguousarray(m[:, span[0] : span[1]])
    part = np.where((part >= 97) & (part <= 122), part - 32, part).astype(np.uint8)
    return part.view(f"S{part.shape[1]}").ravel()


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days from 1970-01-01 in the proleptic Gregorian calendar."""
    first = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1).astype("timedelta64[M]")
    return first.astype("datetime64[D]").astype(np.int64) + d - 1


@lru_cache(maxsize=4096)
def parser_of(mask: str):
    """The parser of a mask: a function from a byte matrix to field arrays, or None."""
    if mask and set(mask) == {"9"}:
        return "unix" if len(mask) <= 18 else None
    for form in _FORMS:
        if hit := form.fullmatch(mask):
            return {k: hit.span(k) for k, v in hit.groupdict().items() if v is not None}
    return None


def _convert(m: np.ndarray, spans: dict, dmy: np.ndarray):
    """valid, local second, zone kind (0 none, 1 offset, 2 abbreviation), offset, abbreviation."""
    n = len(m)
    ok = np.ones(n, bool)
    zero = np.zeros(n, np.int64)
    get = lambda k: _number(m, spans[k]) if k in spans else zero
    y = get("Y")
    if spans["Y"][1] - spans["Y"][0] == 2:
        y = y + 2000
    if "a" in spans:
        a, b = get("a"), get("b")
        mo, d = np.where(dmy, b, a), np.where(dmy, a, b)
    elif "mon" in spans:
        names, back = np.unique(_words(m, spans["mon"]), return_inverse=True)
        mo = np.array([MONTHS.get(x.decode()) or MONTH_NAMES.get(x.decode(), 0) for x in names], np.int64)[back.ravel()]
        d = get("d")
    else:
        mo, d = get("m"), get("d")
    h, mi, s = get("h"), get("mi"), get("s")
    if "t" in spans and (w := m[:, spans["t"][0] : spans["t"][1]]).size:
        letter = (w >= 65) & (w != 64)
        ok &= np.where(letter, (w == ord("T")) | (w == ord("t")), True).all(axis=1)
    ok &= (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (h <= 23) & (mi <= 59) & (s <= 59)
    mo = np.clip(mo, 1, 12)
    length = _days(y + (mo == 12), mo % 12 + 1, np.ones(n, np.int64)) - _days(y, mo, np.ones(n, np.int64))
    ok &= d <= length
    if "ap" in spans:
        ap = _words(m, (spans["ap"][1] - 2, spans["ap"][1]))
        ok &= ((ap == b"AM") | (ap == b"PM")) & (h <= 12)
        h = h % 12 + np.where(ap == b"PM", 12, 0)
    local = _days(y, mo, d) * 86400 + h * 3600 + mi * 60 + s
    kind, offset, abbr = np.zeros(n, np.int8), zero, None
    if "z" in spans:
        lo, hi = spans["z"]
        if (m[:, lo] == 32).all():
            lo += 1
        first = m[0, lo]
        if first in b"+-":
            hh, mm = _number(m, (lo + 1, lo + 3)), _number(m, (hi - 2, hi)) if hi - lo > 3 else zero
            ok &= (hh <= 18) & (mm <= 59)
            offset = np.where(m[:, lo] == ord("-"), -1, 1) * (hh * 3600 + mm * 60)
            kind[:] = 1
        else:
            abbr = _words(m, (lo, hi))
            utc = np.isin(abbr, [b"Z", b"UTC", b"GMT"])
            kind[:] = np.where(utc, 1, 2)
            ok &= utc | (hi - lo > 1)
    return ok, local, kind, offset, abbr


class Clock:
    """What a batch needs: per zone key its table, date order and zone abbreviations."""

    def __init__(self, zones: dict[str, Zone], keys: list[dict]):
        self.zones = [zones.get(k["zone"]) for k in keys]
        self.slot = {k["key"]: i for i, k in enumerate(keys)}
        self.dmy = np.array([k["dmy"] for k in keys] + [False])
        self.own = [{a.upper().encode(): o for a, o in k["abbr"].items()} for k in keys]
        # An abbreviation of another fleet's holds where all fleets that write it agree on its offset.
        self.any: dict[bytes, list] = {}
        for own in self.own:
            for a, (zone, summer) in own.items():
                if all(z.name != zone.name or was != summer for z, was in self.any.get(a, [])):
                    self.any.setdefault(a, []).append((zone, summer))

    def batch(self, values: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Outcome codes and UTC seconds of a batch of texts and their zone keys."""
        n = len(values)
        outcome, second = np.full(n, UNREADABLE, np.int8), np.zeros(n, np.int64)
        uniq = keys.dictionary_encode()
        lookup = np.array([self.slot.get(k, -1) for k in uniq.dictionary.to_pylist()] + [-1], np.int64)
        slot = lookup[uniq.indices.fill_null(len(lookup) - 1).to_numpy(zero_copy_only=False)]
        trimmed = pc.utf8_trim_whitespace(values.fill_null(""))
        size = pc.binary_length(trimmed).to_numpy(zero_copy_only=False)
        if (size > LONGEST).any():
            # A second may have any number of fraction digits; all other parts of a form have few characters.
            trimmed = pc.replace_substring_regex(trimmed, r"(:[0-9]{2}[.,][0-9])[0-9]+", r"\1")
            size = pc.binary_length(trimmed).to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(trimmed).to_numpy(zero_copy_only=False) & (size > 0) & (size <= LONGEST)
        for length in np.unique(size[plain]):
            rows = np.flatnonzero(plain & (size == length))
            part = trimmed.take(pa.array(rows)).cast(pa.binary()).cast(pa.binary(int(length)))
            m = np.frombuffer(part.buffers()[1], np.uint8, len(rows) * length, part.offset * length).reshape(-1, length)
            masks = np.ascontiguousarray(_CLASS[m]).view(f"S{length}").ravel()
            names, back = np.unique(masks, return_inverse=True)
            order = np.argsort(back, kind="stable")
            ends = np.cumsum(np.bincount(back, minlength=len(names)))
            for mask, lo, hi in zip(names, np.concatenate([[0], ends[:-1]]), ends):
                spans = parser_of(mask.decode("ascii"))
                if spans is not None:
                    at = order[lo:hi]
                    outcome[rows[at]], second[rows[at]] = self._rows(m[at], spans, slot[rows[at]])
        second[outcome != INSTANT] = 0
        return outcome, second

    def _rows(self, m: np.ndarray, spans, slot: np.ndarray):
        n = len(m)
        if spans == "unix":
            v = _number(m, (0, m.shape[1]))
            return np.full(n, INSTANT, np.int8), np.where(v < 10**11, v, np.where(v < 10**14, v // 1000, v // 10**6))
        ok, local, kind, offset, abbr = _convert(m, spans, self.dmy[slot])
        if abbr is not None and (kind == 2).any():
            offset = offset.copy()
            for a in np.unique(abbr[kind == 2]):
                for k in np.unique(slot[(abbr == a) & (kind == 2)]):
                    here = (abbr == a) & (kind == 2) & (slot == k)
                    own = self.own[k].get(a) if k >= 0 else None
                    each = [z.written(local[here], summer) for z, summer in ([own] if own else self.any.get(a, []))]
                    if each:
                        offset[here] = each[0]
                        ok[here] &= np.all([o == each[0] for o in each], axis=0)
                    else:
                        ok[here] = False
        outcome, second = np.full(n, INSTANT, np.int8), local - offset
        bare = kind == 0
        for k in np.unique(slot[bare]):
            here, zone = bare & (slot == k), self.zones[k] if k >= 0 else None
            if zone is None:
                ok[here] = False
            else:
                outcome[here], second[here] = zone.to_utc(local[here])
        outcome[~ok] = UNREADABLE
        return outcome, second


def clock_from_table(spark: SparkSession, zone_rows: list[dict], key: str, zone: str, date_order: str, std_abbr: str, dst_abbr: str) -> Clock:
    """A :class:`Clock` from rows of a zone-key table (a small table, one row per key)."""
    zones = load_zones(spark, [r[zone] for r in zone_rows])
    keys = []
    for r in sorted((r for r in zone_rows if r[key] is not None), key=lambda r: r[key]):
        z, abbr = zones.get(r[zone]), {}
        if z is not None:
            if r[std_abbr]:
                abbr[r[std_abbr]] = (z, False)
            if r[dst_abbr]:
                abbr[r[dst_abbr]] = (z, True)
        keys.append({"key": r[key], "zone": r[zone], "dmy": r[date_order] == "DMY", "abbr": abbr})
    return Clock(zones, keys)


def with_profiles(df: DataFrame, zone_key: str, zone_table: DataFrame, key: str, zone: str, date_order: str, std_abbr: str, dst_abbr: str) -> tuple[DataFrame, Clock]:
    """``df`` with ``profile``, which takes the place of its zone key, and the clock of the profiles.

    Zone, date order and abbreviations make a profile: there are few, bounded by the
    zones of the rules and the abbreviations in use, however many keys the table
    holds. Of several rows to a key the least holds.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (zone, date_order, std_abbr, dst_abbr)]
    named = zone_table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.concat_ws("\x01", *parts)).alias("profile"))
    rows = []
    for r in named.select("profile").distinct().collect():
        z, order, std, dst = r["profile"].split("\x01")
        rows.append({key: r["profile"], zone: z, date_order: order, std_abbr: std, dst_abbr: dst})
    clock = clock_from_table(zone_table.sparkSession, rows, key, zone, date_order, std_abbr, dst_abbr)
    return df.join(named, F.col(zone_key) == F.col("__key"), "left").drop("__key"), clock


def normalise_instants(df: DataFrame, row_key: str, value: str, zone_key: str, clock: Clock) -> DataFrame:
    """``(row_key, outcome, utc_second)``, one row per input row; no shuffle."""
    kind = df.schema[row_key].dataType
    schema = T.StructType([T.StructField(row_key, kind), T.StructField("outcome", T.StringType()), T.StructField("utc_second", T.LongType())])
    share = df.sparkSession.sparkContext.broadcast(clock)

    def convert(batches):
        own = share.value
        for b in batches:
            outcome, second = own.batch(b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(OUTCOMES[outcome]), pa.array(second)], names=[row_key, "outcome", "utc_second"])

    return df.select(F.col(row_key), F.col(value).cast("string"), F.col(zone_key)).mapInArrow(convert, schema)
