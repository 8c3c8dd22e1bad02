"""Occurrences and records of every term, kept up to date by signed deltas.

The store is a folder that all executors share. ``postings`` are segments of signed
counts per record and term, in ranges of a hash of the record; ``counts`` are
occurrences and records per term, in ``PARTS`` parts by a hash of the term. A
manifest, written last, names the segments and the folder of every part, so a store
can be opened again, and a batch that fails half-way leaves no trace.

A batch of added, changed or deleted records is turned into signed counts per
record and term; what its records held before says which terms a record gains or
loses. A batch of few records reads only the row groups of its hashes, a larger
one the segments as a whole, once. The result, summed per term, is merged into the
parts of the counts that it touches; the other parts stay as they are. More than
``SEGMENTS`` segments are merged into one.

Defined results: null terms count for nothing; a record without terms counts as
a record. A null record id is no record: its terms occur, in no record. Repeated
deliveries add up, or with ``replace`` the batch's content takes the place of what
its records held; a record that the batch only deletes then holds nothing. Ties
need no rule as all counts are exact. A delta that takes away more than there is
leaves counts below zero, which later ones may make good; terms whose count is
zero or less are not returned. Empty batches change nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, names_in, scratch

#: Stands for "this record exists" among the terms of a record.
PRESENT = "\u0000"
#: Hashes of records, most of them named in a filter, parts of the counts, and segments before they are merged.
HASHES, NAMED, PARTS, SEGMENTS = 1 << 16, 512, 16, 8
_POSTINGS = "hash int, field string, record string, term string, o long, d long"
_COUNTS = "field string, term string, occurrences long, records long"


class TermStore:
    """Persistent counts of terms of several fields; an existing folder is opened again."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "terms")
        self.version, self.segments, self.parts = 0, [], {}
        done = [int(n.rsplit("-", 1)[1]) for n in names_in(spark, self.path) if n.startswith("manifest-")]
        for v in sorted(done, reverse=True):
            if "_SUCCESS" in names_in(spark, f"{self.path}/manifest-{v}"):
                m = json.loads(spark.read.text(f"{self.path}/manifest-{v}").first()[0])
                self.version, self.segments, self.parts = v, m["segments"], {int(k): p for k, p in m["parts"].items()}
                break

    def _commit(self) -> None:
        self.version += 1
        text = json.dumps({"segments": self.segments, "parts": self.parts})
        self.spark.createDataFrame([(text,)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.version}")

    def _new(self, kind: str) -> str:
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(*self.segments)

    def _raw(self, parts: list[int] | None = None) -> DataFrame:
        paths = [p for k, p in sorted(self.parts.items()) if parts is None or k in parts]
        reader = self.spark.read.schema(_COUNTS)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], _COUNTS)

    def apply(self, batch: DataFrame, replace: bool = False) -> None:
        """Merge a batch of ``(field, record, terms, sign)``; ``sign`` is 1 or -1."""
        terms = F.concat(F.array(F.lit(PRESENT)), F.coalesce(F.filter("terms", lambda t: t.isNotNull()), F.array().cast("array<string>")))
        flat = batch.select("field", F.col("record").cast("string").alias("record"), F.explode(terms).alias("term"), F.col("sign").cast("long").alias("sign"))
        # Partial counts come before the shuffle, so a record that holds many rows sends few.
        # With ``replace`` rows that delete say only that the record was touched.
        d = F.sum(F.greatest("sign", F.lit(0).cast("long")) if replace else F.col("sign"))
        delta = flat.groupBy("field", "record", "term").agg(d.alias("d")).withColumn("hash", F.pmod(F.xxhash64("record"), F.lit(HASHES)).cast("int"))
        zero = F.lit(0).cast("long")
        if self.segments:
            delta_at = self._new("batch")
            delta.write.parquet(delta_at)
            delta = self.spark.read.schema("field string, record string, term string, d long, hash int").parquet(delta_at)
            touched = delta.where(F.col("term") == PRESENT).select("hash", "field", "record")
            hashes = [r["hash"] for r in touched.select("hash").distinct().limit(NAMED + 1).collect()]
            old = self._postings()
            if len(hashes) <= NAMED:
                old = old.where(F.col("hash").isin(hashes))
            same = [old["hash"] == touched["hash"], old["field"] == touched["field"], old["record"].eqNullSafe(touched["record"])]
            old = old.join(touched, same, "left_semi").select("hash", "field", "record", "term", F.col("d").alias("o"), zero.alias("d"))
            both = old.unionByName(delta.withColumn("o", zero)).groupBy("hash", "field", "record", "term").agg(F.sum("o").alias("o"), F.sum("d").alias("d"))
            if replace:
                both = both.withColumn("d", F.col("d") - F.col("o"))
        else:
            delta_at, both = None, delta.withColumn("o", zero)
        segment = self._new("postings")
        both.where("d <> 0").select("hash", "field", "record", "term", "o", "d").repartitionByRange("hash").sortWithinPartitions("hash").write.parquet(segment)
        new = self.spark.read.schema(_POSTINGS).parquet(segment)
        gain = ((F.col("o") + F.col("d") > 0).cast("long") - (F.col("o") > 0).cast("long")) * F.col("record").isNotNull().cast("long")
        self._merge(new.groupBy("field", "term").agg(F.sum("d").alias("occurrences"), F.sum(gain).alias("records")))
        self.segments = [*self.segments, segment]
        self._commit()
        if delta_at:
            delete(self.spark, delta_at)
        if len(self.segments) > SEGMENTS:
            self.compact()

    def _merge(self, change: DataFrame) -> None:
        """Changes of terms into the parts of the counts that hold them."""
        part = F.pmod(F.xxhash64("field", "term"), F.lit(PARTS)).cast("int")
        fresh = self._new("change")
        change.withColumn("part", part).write.parquet(fresh)
        change = self.spark.read.schema(_COUNTS + ", part int").parquet(fresh)
        parts = [r["part"] for r in change.select("part").distinct().collect()]
        if parts:
            both = change.unionByName(self._raw(parts).withColumn("part", part)) if self.parts else change
            at = self._new("counts")
            summed = both.groupBy("part", "field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
            # Part by part, one file each and more where there is more.
            summed.repartition("part", F.pmod(F.xxhash64("term"), F.lit(4))).write.partitionBy("part").parquet(at)
            self.parts = self.parts | {k: f"{at}/part={k}" for k in parts}
        delete(self.spark, fresh)

    def compact(self) -> None:
        """One segment of what records hold, in place of all; nothing else changes."""
        if not self.segments:
            return
        segment, old = self._new("postings"), self.segments
        held = self._postings().groupBy("hash", "field", "record", "term").agg(F.sum("d").alias("d")).where("d <> 0")
        held.select("hash", "field", "record", "term", F.lit(0).cast("long").alias("o"), "d").repartitionByRange("hash").sortWithinPartitions("hash").write.parquet(segment)
        self.segments = [segment]
        self._commit()
        for s in old:
            delete(self.spark, s)

    def counts(self) -> DataFrame:
        """``field, term, occurrences, records, total_records``."""
        raw = self._raw().where("occurrences > 0")
        # One row per field.
        totals = raw.where(F.col("term") == PRESENT).select("field", F.col("records").alias("total_records"))
        return raw.where(F.col("term") != PRESENT).join(totals, "field")


def marked(counts: DataFrame, rare_below: int, common_above: float) -> DataFrame:
    """Counts with ``mark``: ``rare``, ``common`` or null. A rare term is not called common."""
    per = round(1 / common_above)
    common = F.col("records") * per > F.col("total_records")
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(common, "common"))


def batches_by_time(df: DataFrame, at: Column, shares: list[float]) -> list[DataFrame]:
    """``df`` cut at approximate quantiles of ``at``; null times go to the first batch. All rows are kept."""
    when = at.cast("timestamp").cast("double")
    cuts = df.agg(F.percentile_approx(when, shares, 1000)).first()[0] or []
    out, low = [], None
    for cut in [*sorted(set(cuts)), None]:
        want = F.lit(True) if cut is None else when < cut
        out.append(df.where(F.coalesce(want if low is None else want & (when >= low), F.lit(low is None))))
        low = cut
    return out
