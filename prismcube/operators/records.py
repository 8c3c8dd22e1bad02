"""Delimited records: typed rows, and the rows that fail with the reason.

From a schema one anchored pattern for whole rows is generated. Rows that match
it are loaded from its groups. The rest meet the pattern's prefixes, field by
field; the first prefix that fails names the first broken field, and what stands
from there on gives the reason: ``quoting`` if its quotes do not balance into
fields, else ``column_count`` if it holds more or fewer fields than are left, else
``value``. All patterns run as JVM expressions in one pass without a shuffle; none
of them loops over a group, so very long rows are safe.

Defined results: a null record has no field and is a ``column_count`` failure;
an empty one has one empty field. Repeated rows are judged apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upto(n: int) -> str:
    """Pattern of the digits 0 to ``n``, leading zeros allowed."""
    text = str(n)
    forms = [f"[0-9]{{1,{len(text) - 1}}}"] if len(text) > 1 else []
    for i, c in enumerate(text):
        low = 1 if i == 0 and len(text) > 1 else 0
        rest = len(text) - 1 - i
        if int(c) > low:
            forms.append(f"{text[:i]}[{low}-{int(c) - 1}]" + (f"[0-9]{{{rest}}}" if rest else ""))
    return f"0*(?:{'|'.join([*forms, text])})"


@dataclass(frozen=True)
class Digits:
    """ASCII digits of a value of at most ``most``."""

    name: str
    most: int

    @property
    def pattern(self) -> str:
        return upto(self.most)

    @property
    def kind(self) -> str:
        return "int" if self.most < 2**31 else "bigint"


@dataclass(frozen=True)
class PlainDecimal:
    """Optional minus, digits, optional point and digits, within ``bound`` of zero."""

    name: str
    bound: int

    @property
    def pattern(self) -> str:
        return rf"-?(?:{upto(self.bound - 1)}(?:\.[0-9]+)?|0*{self.bound}(?:\.0+)?)"

    @property
    def kind(self) -> str:
        return "double"


class RecordSchema:
    """Patterns of a record of comma-separated fields."""

    def __init__(self, *fields: Digits | PlainDecimal):
        self.fields = fields
        each = [f'(?: *({f.pattern}) *|"({f.pattern})")' for f in fields]
        self.whole = rf"\A{','.join(each)}\z"
        self.sound = [rf"\A{','.join(each[: i + 1])}(?:,|\z)" for i in range(len(each))]
        self.prefixes = [rf"\A{','.join(each[: i + 1])}" + ("(?=,)" if i + 1 < len(each) else r"(?=,|\z)") for i in range(len(each))]

    def valid(self, line: Column) -> Column:
        return F.coalesce(line.rlike(self.whole), F.lit(False))

    def values(self, line: Column) -> list[Column]:
        out = []
        for i, f in enumerate(self.fields):
            text = F.concat(*[F.regexp_extract(line, self.whole, 2 * i + g) for g in (1, 2)])
            out.append(text.cast(f.kind).alias(f.name))
        return out

    def broken_field(self, line: Column) -> Column:
        """1-based position of the first broken field; one past the last for surplus fields."""
        out = F.lit(len(self.fields) + 1)
        for i in reversed(range(len(self.prefixes))):
            out = F.when(~line.rlike(self.prefixes[i]), F.lit(i + 1)).otherwise(out)
        return F.when(line.isNull(), F.lit(1)).otherwise(out)

    def rest(self, line: Column, broken: Column) -> Column:
        """What stands from the first broken field on; for surplus fields, from the first of them."""
        out = line
        for i in range(1, len(self.fields) + 1):
            out = F.when(broken == i + 1, F.regexp_replace(line, self.sound[i - 1], "")).otherwise(out)
        return out

    def reason(self, line: Column, broken: Column) -> Column:
        """Why a row fails whose field ``broken`` is the first that is not sound."""
        rest = self.rest(line, broken)
        # Cut at quotes: pieces with even index stand outside of quotes. An outside piece
        # is empty (a doubled quote, or an end of the row) or meets its neighbours with commas.
        cut = F.split(rest, '"', -1)
        last = F.size(cut) - 1
        outside = F.filter(cut, lambda _, i: i % 2 == 0)
        end = F.size(outside) - 1
        sound = F.transform(outside, lambda s, i: (s == "") | (((i == 0) | s.startswith(",")) & ((i == end) | s.endswith(","))))
        quotes = (last % 2 == 0) & ((last == 0) | F.forall(sound, lambda ok: ok))
        commas = F.length(F.array_join(outside, "")) - F.length(F.translate(F.array_join(outside, ""), ",", ""))
        short = F.coalesce(commas + 1 != len(self.fields) + 1 - broken, F.lit(True))
        return F.when(line.isNotNull() & ~quotes, "quoting").when(short, "column_count").otherwise("value")


def load_records(df: DataFrame, line: str, schema: RecordSchema, *keep: str) -> DataFrame:
    """Typed rows of the valid records, beside the columns ``keep``."""
    text = F.col(line)
    return df.where(schema.valid(text)).select(*[F.col(k) for k in keep], *schema.values(text))


def failed_records(df: DataFrame, line: str, schema: RecordSchema, *keep: str) -> DataFrame:
    """Columns ``keep``, ``reason`` and ``broken_field`` of the records that cannot be loaded."""
    text = F.col(line)
    failed = df.where(~schema.valid(text)).select(*[F.col(k) for k in keep], text.alias("__line"), schema.broken_field(text).alias("broken_field"))
    return failed.select(*keep, schema.reason(F.col("__line"), F.col("broken_field")).alias("reason"), "broken_field")
