"""Queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.problems import term
from ..plans.registry import Catalog
from ..session import materialise, scratch, table
from . import mixing, packing, rank_summary, term_counts, tokens, truncation

catalog = Catalog()

RARE_BELOW, COMMON_ABOVE = 5, 0.1
EPS = 0.005
PROBS = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
MEASURES = ["duration", "fare"]


def _terms(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str, Column]]:
    """Per field its table, name, record id and terms."""
    value = F.filter(F.array(term(F.col("type"))), lambda t: t.isNotNull())
    # Only ASCII letters count, so others must not become such in upper case.
    words = F.transform(F.regexp_extract_all(F.col("device"), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.upper)
    return [(table(spark, d, "crimes"), "crimes.type", "case_id", value), (table(spark, d, "paper"), "paper.device", "id", F.coalesce(words, F.array().cast("array<string>")))]


def _store(spark: SparkSession, d: str) -> term_counts.TermStore:
    """Counts after a first load and two later deltas, as the deliveries came in.

    The first delta also takes back the last deliveries of the first load, and the
    second delivers them again, so that changes and deletions take part.
    """
    store = term_counts.TermStore(spark)
    parts = []
    for df, field, record, terms in _terms(spark, d):
        parts.append(df.select(F.lit(field).alias("field"), F.col(record).cast("string").alias("record"), terms.alias("terms"), F.lit(1).cast("long").alias("sign"), "received_at"))
    first, last, second, third = (term_counts.batches_by_time(parts[0].unionByName(parts[1]), F.col("received_at"), [0.6, 0.7, 0.9]) + [parts[0].limit(0)] * 3)[:4]
    store.apply(first.unionByName(last))
    store.apply(second.unionByName(last.withColumn("sign", -F.col("sign"))))
    store.apply(third.unionByName(last))
    return store


_P1 = """
    WITH v AS (SELECT 'crimes.type' AS field, CAST(case_id AS VARCHAR) AS r, nullif(upper(trim(regexp_replace(type, '[ \\t]+', ' ', 'g'))), '') AS term FROM crimes
               UNION ALL SELECT 'paper.device', CAST(id AS VARCHAR), upper(unnest(regexp_extract_all(device, '[A-Za-z0-9]+'))) FROM paper),
         t AS (SELECT 'crimes.type' AS field, count(DISTINCT case_id) AS total_records FROM crimes UNION ALL SELECT 'paper.device', count(DISTINCT id) FROM paper),
         c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT r) AS records, total_records FROM v JOIN t USING (field) WHERE term IS NOT NULL GROUP BY field, term, total_records),
         m AS (SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN records * 10 > total_records THEN 'common' END AS mark FROM c)
"""


@catalog.query("p1_found", _P1 + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked(_store(spark, d).counts(), RARE_BELOW, COMMON_ABOVE).where("mark IS NOT NULL").select("field", "term", "mark")


@catalog.query("p1_counts", _P1 + "SELECT field, term, occurrences, records, total_records, mark FROM m")
def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked(_store(spark, d).counts(), RARE_BELOW, COMMON_ABOVE).select("field", "term", "occurrences", "records", "total_records", "mark")


@catalog.query(
    "p1_latest",
    """
    WITH v AS (SELECT case_id, nullif(upper(trim(regexp_replace(type, '[ \t]+', ' ', 'g'))), '') AS term, received_at FROM crimes WHERE case_id IS NOT NULL),
         l AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY received_at DESC, term DESC NULLS LAST) AS k FROM v)
    SELECT term, count(*) AS occurrences, count(*) AS records FROM l WHERE k = 1 AND term IS NOT NULL GROUP BY term""",
)
def p1_latest(spark: SparkSession, d: str) -> DataFrame:
    """Counts when a later delivery of a record takes the place of the one before."""
    df, field, record, terms = _terms(spark, d)[0]
    store = term_counts.TermStore(spark)
    flat = df.where(F.col(record).isNotNull()).select(F.lit(field).alias("field"), F.col(record).cast("string").alias("record"), terms.alias("terms"), "received_at")
    for batch in term_counts.batches_by_time(flat, F.col("received_at"), [0.7, 0.9]):
        last = batch.groupBy("field", "record").agg(F.max(F.struct("received_at", "terms")).alias("x")).select("field", "record", "x.terms", F.lit(1).cast("long").alias("sign"))
        store.apply(last, replace=True)
    return store.counts().select("term", "occurrences", "records")


_CHANGES = """
    WITH v AS (SELECT case_id, nullif(upper(trim(regexp_replace(type, '[ \t]+', ' ', 'g'))), '') AS term, received_at FROM crimes WHERE case_id IS NOT NULL),
         l AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY received_at DESC, term DESC NULLS LAST) AS k FROM v),
         h AS (SELECT term FROM l WHERE k = 1 AND term IS NOT NULL)
    SELECT term, count(*) AS occurrences, count(*) AS records, (SELECT count(*) FROM h) AS total_records FROM h GROUP BY term"""


@catalog.query("p1_changes", _CHANGES)
def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    """A later delivery replaces a record, or deletes it if it has no value; the store is opened again for every batch."""
    df, field, record, terms = _terms(spark, d)[0]
    path = scratch(spark, "terms")
    flat = df.where(F.col(record).isNotNull()).select(F.lit(field).alias("field"), F.col(record).cast("string").alias("record"), terms.alias("terms"), "received_at")
    for batch in term_counts.batches_by_time(flat, F.col("received_at"), [0.7, 0.9]):
        last = batch.groupBy("field", "record").agg(F.max(F.struct("received_at", "terms")).alias("x")).select("field", "record", "x.terms")
        term_counts.TermStore(spark, path).apply(last.withColumn("sign", F.when(F.size("terms") == 0, -1).otherwise(1)), replace=True)
    return term_counts.TermStore(spark, path).counts().select("term", "occurrences", "records", "total_records")


def _percentiles(keys: list[str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rank_summary.percentiles(rank_summary.summarise(table(spark, d, "taxi"), keys, MEASURES, EPS), keys, PROBS)

    return run


for _key in ("pickup_location", "batch_day", "fleet_id"):
    catalog.add(f"p2_{_key}", _percentiles([_key]))


def _of_days(spark: SparkSession, d: str) -> DataFrame:
    days = rank_summary.summarise(table(spark, d, "taxi"), ["fleet_id", "batch_day"], MEASURES, EPS / 2)
    return rank_summary.combine(days, ["fleet_id"], MEASURES, EPS / 2, EPS, 4096)


@catalog.query("p2_fleet_from_days")
def p2_fleet_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of fleets from summaries of their single days."""
    return rank_summary.percentiles(_of_days(spark, d), ["fleet_id"], PROBS)


def _within_sql(key: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT {key}, '{v}' AS field, unnest([{', '.join(map(str, PROBS))}]) AS prob, count({v}) AS n, true AS within FROM taxi WHERE NOT isnan({v}) GROUP BY {key}" for v in MEASURES
    )
    return f"SELECT {key}, field, CAST(prob AS DOUBLE) AS prob, n, within FROM ({each})"


def _within(spark: SparkSession, d: str, key: str, found: DataFrame) -> DataFrame:
    """Whether the true ranks of percentiles keep the promised error."""
    found = materialise(found, "within")
    long = table(spark, d, "taxi").select(key, F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).alias("v")) for v in MEASURES])).alias("x")).select(key, "x.*").where("NOT isnan(v)")
    counts = long.groupBy(key, "field", "v").agg(F.count(F.lit(1)).alias("c"))
    # One row per percentile of a key meets each of the key's values; a null key is a key.
    near = found.withColumnRenamed(key, "k_").withColumnRenamed("field", "f_")
    j = counts.join(near, F.col(key).eqNullSafe(F.col("k_")) & (F.col("field") == F.col("f_")))
    ranks = j.groupBy(key, "field", "prob", "n").agg(F.sum(F.when(F.col("v") < F.col("value"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto"))
    want = F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n") - F.lit(1e-9)))
    off = F.greatest(F.col("below") + 1 - want, want - F.col("upto"), F.lit(0))
    return ranks.select(key, "field", "prob", "n", (off <= EPS * F.col("n")).alias("within"))


for _key in ("fleet_id", "pickup_location", "batch_day"):

    def _check(spark: SparkSession, d: str, key: str = _key) -> DataFrame:
        found = rank_summary.percentiles(_of_days(spark, d), [key], PROBS) if key == "fleet_id" else _percentiles([key])(spark, d)
        return _within(spark, d, key, found)

    catalog.add("p2_fleet_within" if _key == "fleet_id" else f"p2_{_key}_within", _check, _within_sql(_key))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return materialise(tokens.count_tokens(table(spark, d, "documents"), "text", ["doc_id", "source"]), "tokens")


def _packs(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["pack_name"]: r["capacity_tokens"] for r in table(spark, d, "pack_sizes").collect()}


@catalog.query("p7_assignments")
def p7_assignments(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_sized(spark, d), table(spark, d, "mix_targets"), _packs(spark, d))


@catalog.query("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_assignments(spark, d), _packs(spark, d))


@catalog.query("p7_check", "SELECT pack_name, (SELECT count(*) FROM documents) AS pages, true AS whole, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS overfull, true AS full FROM pack_sizes")
def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What packing promises: all pages whole, none divided without need, no container overfull, little space unused."""
    sized, packs = _sized(spark, d), _packs(spark, d)
    packed = materialise(packing.pack_documents(sized, table(spark, d, "mix_targets"), packs), "packed")
    fill = packing.fill_report(packed, packs).select("pack_name", (F.col("used") >= 0.9).alias("full"))
    return packing.check_report(packed, sized, packs).join(fill, "pack_name")


@catalog.query("p8_check", "SELECT source, true AS repeats_kept, true AS once_a_pass, true AS share_met FROM mix_targets")
def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What mixing promises: repeats within bounds, a page once a pass, every quota met to less than a page."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    mixed, report = mixing.mix(sized, targets)
    pages = materialise(mixed, "mixed").groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pass").alias("passes"), F.max("n_tokens").alias("size"))
    pages = pages.join(targets.select("source", "max_repeats"), "source").groupBy("source").agg(F.min(F.col("n") <= F.col("max_repeats")).alias("repeats_kept"), F.min(F.col("n") == F.col("passes")).alias("once_a_pass"))
    longest = sized.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    met = report.join(longest, "source", "left").select("source", (F.abs(F.col("mixed_tokens") - F.col("quota_tokens")) <= F.coalesce("longest", F.lit(0)) + 1).alias("share_met"))
    yes = F.lit(True)
    return targets.select("source").join(pages, "source", "left").join(met, "source", "left").select("source", F.coalesce("repeats_kept", yes).alias("repeats_kept"), F.coalesce("once_a_pass", yes).alias("once_a_pass"), F.coalesce("share_met", F.lit(False)).alias("share_met"))


@catalog.query("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[0]


@catalog.query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[1]


@catalog.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_pages(table(spark, d, "documents"), "doc_id", "text", "source").where("log_odds > 0").select(F.col("key").alias("doc_id"))


@catalog.query("p9_sources")
def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut pages of each source."""
    pages = truncation.cut_pages(table(spark, d, "documents"), "doc_id", "text", "source")
    cut = F.sum((F.col("log_odds") > 0).cast("long"))
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), cut.alias("cut_pages"), (cut / F.count(F.lit(1))).alias("cut_share"), F.count("at_limit").alias("at_limit"))
