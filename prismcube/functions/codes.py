"""Column expressions that turn raw values into hierarchical codes and back.

A code of ``b`` bits per level and ``L`` levels is one long; the prefix at depth
``d`` is the code shifted right by ``b * (L - d)`` bits. Invalid input gives null,
and null rows are dropped when a cube is built.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latitude at which the square Mercator map ends.
MAX_LAT = 85.05113

#: The even bits of a byte moved together.
GATHER = [sum((i >> 2 * k & 1) << k for k in range(4)) for i in range(256)]


def _lit(n: int) -> Column:
    return F.lit(n).cast("long")


def spread(c: Column) -> Column:
    """Bits of a number below 2**31 moved to the even places: its binary digits read in base 4.

    The usual shift-and-mask chain names its argument twice at every step, which
    in generated code doubles the argument's code each time; this names it once.
    """
    return F.conv(F.bin(c.cast("long")), 4, 10).cast("long")


def spread_by_four(c: Column) -> Column:
    """Bits of a number below 2**15 moved to every fourth place."""
    return F.conv(F.bin(c.cast("long")), 16, 10).cast("long")


def gather(c: Column, bits: int = 62) -> Column:
    """Bits of the even places of a number below ``2**bits`` moved together, a byte at a time by table."""
    out = None
    for k in range(max(1, -(-bits // 8))):
        byte = (F.shiftright(c, 8 * k) if k else c).bitwiseAND(_lit(255)).cast("int")
        part = F.get(F.lit(GATHER).cast("array<bigint>"), byte)
        part = F.shiftleft(part, 4 * k) if k else part
        out = part if out is None else out.bitwiseOR(part)
    return out


def morton(x: Column, y: Column) -> Column:
    """Quadtree code of a cell; a label is the x bit plus twice the y bit."""
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def cell_x(code: Column, levels: int = 31) -> Column:
    return gather(code, 2 * levels)


def cell_y(code: Column, levels: int = 31) -> Column:
    return gather(F.shiftright(code, 1), 2 * levels)


def mercator_x(lon: Column) -> Column:
    """Longitude to [-1, 1]."""
    return lon / 180


def mercator_y(lat: Column) -> Column:
    """Latitude to Mercator's [-1, 1]."""
    return F.ln(F.tan(lat * F.pi() / 360 + F.pi() / 4)) / F.pi()


def lon_of(mx: Column) -> Column:
    return mx * 180


def lat_of(my: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(my * F.pi())) - F.pi() / 2)


def cell_bounds(level: Column, x: Column, y: Column) -> Column:
    """South, west, north and east of a bottom-up cell."""
    n = F.pow(F.lit(2.0), level)
    edge = lambda v: v / n * 2 - 1
    return F.struct(lat_of(edge(y)).alias("south"), lon_of(edge(x)).alias("west"), lat_of(edge(y + 1)).alias("north"), lon_of(edge(x + 1)).alias("east"))


def latlon(lat: Column, lon: Column, levels: int, f32: bool = False) -> Column:
    """Mercator quadtree code; ``f32`` rounds the input to single precision first."""
    if f32:
        lat, lon = lat.cast("float"), lon.cast("float")
    lat, lon = lat.cast("double"), lon.cast("double")
    n = 1 << levels
    cell = lambda m: F.least(F.floor((m + 1) / 2 * n), _lit(n - 1))
    good = lat.between(-MAX_LAT, MAX_LAT) & lon.between(-180, 180)
    return F.when(good, morton(cell(mercator_x(lon)), F.greatest(cell(mercator_y(lat)), _lit(0))))


def xy(x: Column, y: Column, levels: int, slippy: bool = False) -> Column:
    """Quadtree code of a cell; ``slippy`` counts y from the top."""
    n = 1 << levels
    x, y = x.cast("long"), y.cast("long")
    good = x.between(0, n - 1) & y.between(0, n - 1)
    return F.when(good, morton(x, (n - 1) - y if slippy else y))


def ipv4(text: Column) -> Column:
    """Dotted address to a number, or null."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.split(text, r"\.")
    value = sum((F.get(parts, F.lit(i)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(text.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"), value)


def hilbert_ip(text: Column, levels: int) -> Column:
    """Quadtree code of an IPv4 address laid along a Hilbert curve, y flipped.

    Walks the curve from its finest square outwards; a square's quarter says
    whether the walk so far is mirrored and turned.
    """
    if not 1 <= levels <= 16:
        raise ValueError("an address has 1 to 16 levels")
    t = F.shiftright(ipv4(text), 32 - 2 * levels)
    x = y = _lit(0)
    # Packed in one long per step, so that the expression stays linear in size.
    state = F.struct(x.alias("x"), y.alias("y"), t.alias("t"))
    steps = F.array(*[_lit(1 << k) for k in range(levels)])

    def step(s: Column, side: Column) -> Column:
        rx = F.shiftright(s["t"], 1).bitwiseAND(_lit(1))
        ry = s["t"].bitwiseXOR(rx).bitwiseAND(_lit(1))
        mx = F.when(rx == 1, side - 1 - s["x"]).otherwise(s["x"])
        my = F.when(rx == 1, side - 1 - s["y"]).otherwise(s["y"])
        turn = ry == 0
        nx, ny = F.when(turn, my).otherwise(s["x"]), F.when(turn, mx).otherwise(s["y"])
        return F.struct((nx + side * rx).alias("x"), (ny + side * ry).alias("y"), F.shiftright(s["t"], 2).alias("t"))

    end = F.aggregate(steps, state, step)
    return F.when(t.isNotNull(), morton(end["x"], ((1 << levels) - 1) - end["y"]))


def seconds(ts: Column) -> Column:
    """Whole seconds of a timestamp, with or without zone (taken as UTC)."""
    return F.unix_seconds(F.to_timestamp(ts) if isinstance(ts, str) else ts.cast("timestamp"))


def time_bin(second: Column, base: int, width: int, levels: int, add_minutes: int = 0) -> Column:
    """Bin since ``base``; null before it; wraps after 2**levels bins."""
    t = second.cast("long") + 60 * add_minutes - base
    return F.when(t >= 0, F.floor(t / width).cast("long").bitwiseAND(_lit((1 << levels) - 1)))


def unix_text(c: Column) -> Column:
    """Seconds of a numeric text, the fraction cut off."""
    return F.get(F.split(c.cast("string"), r"\."), F.lit(0)).try_cast("long")


def parse_time(c: Column) -> Column:
    """UTC second of a time text: Y-M-D or Y/M/D or M/D/Y, then parts of a clock, am/pm and zone."""
    ymd = r"\A\s*([0-9]{4})(?:[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?)?"
    mdy = r"\A\s*([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})"
    clock = r"(?:[T@ ]([0-9]{1,2})(?::([0-9]{1,2})(?::([0-9]{1,2})(?:\.[0-9]+)?)?)?)?\s*([aApP][mM])?\s*(Z|[-+][0-9]{2}(?::?[0-9]{2})?)?\s*\z"

    mark = "\u0001"
    one = F.regexp_replace(c, ymd + clock, mark.join(f"${i}" for i in range(1, 9)))
    both = F.regexp_replace(one, mdy + clock, mark.join(f"${i}" for i in (3, 1, 2, 4, 5, 6, 7, 8)))

    def read(p: Column) -> Column:
        num = lambda i, d: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(d))
        y, m, d = F.get(p, F.lit(0)).try_cast("int"), num(1, 1), num(2, 1)
        h, mi, s, ap, z = num(3, 0), num(4, 0), num(5, 0), F.lower(F.get(p, F.lit(6))), F.get(p, F.lit(7))
        half = F.when(ap == "", h).when(h > 12, F.lit(None)).otherwise(h % 12 + F.when(ap == "pm", 12).otherwise(0))
        digits = F.translate(z, "+-:Z", "")
        away = F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
        day = F.unix_date(F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("date")).cast("long")
        good = (F.size(p) == 8) & (half <= 23) & (mi <= 59) & (s <= 59)
        return F.when(good, day * 86400 + half * 3600 + mi * 60 + s - F.when(z.startswith("-"), -away).otherwise(away) * 60)

    # Bound in a lambda, so that the parts are taken from the text once.
    return F.get(F.transform(F.array(F.split(both, mark, -1)), read), F.lit(0))


def hour_label(ts: Column) -> Column:
    return F.hour(ts).cast("long")


def weekday_label(ts: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(ts) - 1).cast("long")


def prefix(code: Column, bits: int, levels: int, depth: int) -> Column:
    return F.shiftright(code, bits * (levels - depth)) if depth < levels else code


def path_text(pfx: Column, bits: int, depth: int, sep: str = ":") -> Column:
    """Labels of a prefix, outermost first."""
    mask = (1 << bits) - 1
    labels = [F.shiftright(pfx, bits * (depth - 1 - i)).bitwiseAND(_lit(mask)).cast("string") for i in range(depth)]
    return F.concat_ws(sep, *labels) if labels else F.lit("")


def path_array(pfx: Column, bits: int, depth: int) -> Column:
    mask = (1 << bits) - 1
    return F.array(*[F.shiftright(pfx, bits * (depth - 1 - i)).bitwiseAND(_lit(mask)).cast("int") for i in range(depth)])
