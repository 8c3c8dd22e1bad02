"""Pages cut off by field limits or broken transfers, and how often sources cut.

Length evidence. Per source, in characters and in UTF-8 bytes, every length that
stands out from the lengths just below it is a candidate limit. At each candidate
a log-normal distribution of lengths, right-censored there, is fitted by maximum
likelihood (expectation-maximisation on sufficient statistics). It says how many
pages would have that length by nature; the odds that the limit is real XX
A page at a real limit gets the posterior that its length is censored, not natural.
A limit that was raised later, or that holds for some feeds only, is found like one
that holds for all.

Ending evidence. A break may leave a remnant: a half-written character, entity or
escape, a mark of omission, or blanks. How often pages that close end with such
without being cut is learned per source. Below the remnant stand the last three
words, with names, numbers and characters that scans confuse folded. A break can
fall anywhere, so what cut pages end with is learned by breaking every page at
``TRIALS`` places of its whole text, chosen by hash; what whole pages end with is
learned from the pages, less the endings that so many breaks would leave. The
ratio of both rates is taken step by step: for the class of the ending (closing
mark, letter, digit, capitals; open quotation), the last word in it, the word
before, and the one before that. A word or a phrase that was never seen gets the rate at
which whole pages bring new ones. The page itself is left out of its own counts.

The share of cut pages is fitted per source by expectation-maximisation over the
evidence, drawn to that of the collection where a source has few pages. It, or at
a limit the censoring posterior, and the evidence give the log-odds.

Defined results: null, empty and blank texts are not cut; repeated pages count
each; a null source is a source of its own. Texts of equal content count once in
the fit of lengths, so that repeats do not look like a limit. Of a word longer
than ``REACH`` characters the last ``REACH`` count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Share of cut pages where the collection cannot tell it, and how many pages the collection's share weighs in that of a source.
PRIOR, WEIGHT = 0.05, 50.0
#: Fewest different pages at a limit; how often they exceed those of the lengths just below; bytes that a cut between characters may fall short of one; lengths below.
AT_LIMIT, STANDS_OUT, SHORT, BELOW = 3, 3.0, 3, 64
#: Characters of the last words, and places at which each page is broken to see what breaks leave.
REACH, TRIALS = 80, 8
#: Share of sources and units that have a limit.
LIMITED = 0.05
#: Share of breaks that leave blanks, and that leave another remnant.
LEAVES = 0.3
#: Weight of the rate of all words before in that of a pair, and of pairs in that of three words; least rate of new words.
PAIR, TRIPLE, NEW = 5.0, 2.0, 0.002
#: So many pages more than breaks explain, beside two standard deviations, may end alike by chance.
CHANCE = 2.5

#: Remnants of a broken transfer at the very end of a text (fixed forms of HTML, JSON, C and URL escapes).
_MARK = (
    r"\x{FFFD}|…|\.\.\.|\[\s*(?:\.\.\.|…)\s*\]|\[(?:truncated|cut|more)\]|--"
    r"|&#?[A-Za-z0-9]{0,8}|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]{0,2})?|(?<![0-9])%[0-9A-Fa-f]{0,2}|<[/!]?[A-Za-z]{0,10}"
)
REMNANT = rf"(?:\s|{_MARK})+\z"
_CLOSING = r"(?:[.!?][\"'”’»)\]]*|\)|[”»])\z"
#: Letters that scans take for each other, each group written as one.
_LIKE = {"o": "cea0(éèêëáàâäãóòôöåç", "1": "ltfijsíìîï", "h": "b", "n": "urmvwúùûüñ"}
_FROM, _TO = "".join(_LIKE.values()), "".join(k * len(v) for k, v in _LIKE.items())


def _fold(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), "n{2,}", "n")


def _opened(text: Column) -> Column:
    """Whether a quotation stands open at the end of a text."""
    one = lambda a, b: F.contains(text, F.lit(a)) & ~F.contains(F.substring_index(text, a, -1), F.lit(b))
    return one("“", "”") | one("«", "»")


def endings(df: DataFrame) -> DataFrame:
    """``df`` with ``kind`` of ending, ``word`` and ``words``, from ``tail`` and ``opened``.

    ``word`` is the kind and the last word, ``words`` the kind and the last three
    with names folded too; fewer words are filled up with ``^``.
    """
    tail = F.regexp_replace(F.col("tail"), r"\s+\z|(?<=\S)-\s+", "")
    df = df.withColumn("w", F.substring_index(F.regexp_replace(F.concat(F.lit("^ ^ ^ "), tail), r"\s+", " "), " ", -3)).drop("tail")
    df = df.withColumn("closed", F.col("w").rlike(_CLOSING))
    bare = F.when(F.col("closed"), F.regexp_replace("w", r"[.!?\"'”’»)\]]+\z", "")).otherwise(F.col("w"))
    # Dots inside of words, and digits that stand for letters, come from scanning.
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?<=\p{L})\.+(?=\p{L})", ""), r"(?<=\p{L})[0-9]|[0-9](?=\p{L}{2,})", "o")
    df = df.withColumn("w", F.regexp_replace(bare, "[0-9]+", "9"))
    named = F.regexp_replace(F.regexp_replace("w", r"\p{Lu}{2,}(?:['’]?\p{Lu}+)*", "@@"), r"\p{Lu}\p{Ll}{4,}", "@")
    df = df.withColumn("f", _fold(named)).withColumn("last", _fold(F.substring_index("w", " ", -1)))
    own, end = F.substring_index("f", " ", -1), F.right(F.col("w"), F.lit(1))
    shape = F.when(own.contains("@@"), "@@").when(own.contains("@"), "@").otherwise("w")
    mark = F.when(F.col("closed"), ".").when(end.rlike("[0-9]"), "9").when(end.rlike(r"\p{Lu}"), "A").when(end.rlike(r"\p{L}"), "a").otherwise(end)
    df = df.withColumn("kind", F.concat(F.when(F.col("opened"), "“").otherwise(""), mark, shape, F.lit("|")))
    return df.withColumns({"word": F.concat("kind", "last"), "words": F.concat("kind", "f")}).drop("w", "f", "last", "opened")


def length_fit(stats: pd.DataFrame) -> pd.DataFrame:
    """Log-odds that each candidate limit is real, and the posterior of a page there.

    ``stats`` has a row per candidate: ``limit``, ``m`` pages at it, ``above`` it,
    ``near`` pages expected there by the lengths just below, and number ``n``, sum
    ``s1`` and sum of squares ``s2`` of the logarithms of the lengths below.
    """
    erfc = np.vectorize(math.erfc, otypes=[float])
    n, m, above, near, s1, s2 = (stats[c].to_numpy(float) for c in ("n", "m", "above", "near", "s1", "s2"))
    limit, width = stats["limit"].to_numpy(float), stats["width"].to_numpy(float) + 1
    c, over = np.log(np.maximum(limit, 1)), m + above
    tot = np.maximum(n + over, 1)
    mu = (s1 + over * c) / tot
    var = np.maximum((s2 + over * c * c) / tot - mu**2, 1e-4)
    for _ in range(200):
        sd = np.sqrt(var)
        z = (c - mu) / sd
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.maximum(0.5 * erfc(z / math.sqrt(2)), 1e-300)
        e1, e2 = mu + sd * hazard, mu**2 + var + sd * hazard * (c + mu)
        mu = (s1 + over * e1) / tot
        var = np.maximum((s2 + over * e2) / tot - mu**2, 1e-4)
    surviving = 0.5 * erfc((c - mu) / np.sqrt(2 * var))
    density = np.exp(-0.5 * (c - mu) ** 2 / var) / np.sqrt(2 * math.pi * var) / np.maximum(limit, 1)
    natural = np.maximum(np.maximum(tot * density * width, near), 1e-3)
    odds = np.where(m > natural, m * np.log(np.maximum(m, 1) / natural) - (m - natural) - c + math.log(LIMITED), -50.0)
    real = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    cut = np.where(m >= AT_LIMIT, real * (1 - np.minimum(0.99, natural / np.maximum(m, 1))), 0.0)
    return stats.assign(odds=odds, posterior=cut, surviving=surviving)


def limits(pages: DataFrame) -> DataFrame:
    """``source, unit, limit, width, n, m, odds, posterior`` of every candidate limit."""
    lens = pages.select("source", "chars", "bytes", "same").distinct()
    each = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("limit"), F.lit(w).alias("width")) for u, w in (("chars", 0), ("bytes", SHORT))])
    hist = lens.select("source", F.explode(each).alias("x")).select("source", "x.*").groupBy("source", "unit", "limit", "width").agg(F.count(F.lit(1)).alias("c")).where("limit > 0")
    # As many rows to a source as it has different lengths.
    out = []
    for unit, width in (("chars", 0), ("bytes", SHORT)):
        w = Window.partitionBy("source").orderBy("limit")
        at, below, near = w.rangeBetween(-width, 0), w.rangeBetween(Window.unboundedPreceding, -width - 1), w.rangeBetween(-width - BELOW, -width - 1)
        log, c = F.log(F.col("limit").cast("double")), F.col("c").cast("double")
        total = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0.0))
        h = hist.where(F.col("unit") == unit).withColumns(
            {"m": total(c, at), "n": total(c, below), "s1": total(c * log, below), "s2": total(c * log * log, below), "all": total(c, Window.partitionBy("source")), "near": total(c, near) * (width + 1) / BELOW}
        )
        out.append(h.where((F.col("m") >= AT_LIMIT) & (F.col("m") >= STANDS_OUT * F.col("near"))).withColumn("above", F.col("all") - F.col("m") - F.col("n")).drop("all", "c"))
    stats = out[0].unionByName(out[1])
    fields = "source string, unit string, limit long, width int, m double, n double, s1 double, s2 double, near double, above double"
    cols = [x.split()[0] for x in fields.split(", ")]
    return stats.select(*cols).mapInPandas(lambda it: (length_fit(p) for p in it if len(p)), fields + ", odds double, posterior double, surviving double")


def _levels(df: DataFrame) -> DataFrame:
    kind = F.substring_index("words", "|", 1)
    tail = F.substring(F.col("words"), F.length(kind) + F.lit(2), F.length("words"))
    part = lambda k: F.concat(kind, F.lit("|"), F.substring_index(tail, " ", k))
    return df.withColumns({"kind": kind, "one": part(-1), "two": part(-2)})


def ending_odds(counts: DataFrame) -> DataFrame:
    """``word, words, evidence``: how much likelier breaks leave an ending than whole pages.

    ``counts`` has, per ``word`` and ``words``, the pages ``p`` that end so, those
    ``n`` of them that count for whole pages, and the trial breaks ``s``; it is read
    several times.
    """
    j = _levels(counts)
    kinds = j.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # A few hundred kinds at most: a character, a shape, and whether a quotation is open.
    seen = [(r["n"], r["s"]) for r in kinds.collect()]
    n, m = sum(x for x, _ in seen), sum(x for _, x in seen)
    e = j.where("p > 0")
    for k, col in (("0", "kind"), ("1", "word"), ("a", "one"), ("2", "two"), ("3", "words")):
        e = e.join(j.groupBy(col).agg(F.sum("p").alias("p_"), F.sum("n").alias("n" + k), F.sum("s").alias("s" + k)).where("p_ > 0").drop("p_"), col)
    e = materialise(e, "levels")
    # Whole pages hardly ever end in some of the ways that breaks leave, so there pages tell the share of breaks;
    # it is fitted to the evidence it leads to.
    rare = [(x, y) for x, y in seen if y >= max(1, 0.01 * m)]
    least = min(((x + math.sqrt(x) + 1) / y for x, y in rare), default=0.0)
    low = [(x, y) for x, y in rare if x <= 3 * least * y]
    start = min(0.5, (sum(x for x, _ in low) + 1) / (sum(y for _, y in low) + 1) * m / max(n, 1)) if low else PRIOR
    share = share_of_all(_evidence(e, start, n, m).select(F.round(F.col("evidence") * 4).cast("int").alias("e"), "n"), start)
    return _evidence(e, share, n, m).select("word", "words", "evidence")


def _evidence(e: DataFrame, share: float, n: int, m: int) -> DataFrame:
    """Evidence of endings if ``share`` of ``n`` pages are cut where ``m`` trial breaks fall."""
    f = share * n / max(m, 1)

    def left(k: str) -> Column:
        """Pages of a group that breaks do not explain, or none where chance could."""
        due = F.col("s" + k) * f
        return F.when(F.col("n" + k) - due > 2 * F.sqrt(due) + CHANCE, F.col("n" + k) - due).otherwise(0.0)

    def carried(e: DataFrame, k: str, col: str, of: str) -> DataFrame:
        """What is left in a group: at least what is left in its parts."""
        sums = e.groupBy(col).agg(F.sum(F.when(F.col("n" + of) > 0, F.col("n") * F.col("c" + of) / F.col("n" + of)).otherwise(0.0)).alias("parts"))
        return e.join(sums, col).withColumn("c" + k, F.greatest(left(k), "parts")).drop("parts")

    e = carried(e.withColumn("c3", left("3")), "1", "word", "3")
    e = carried(carried(e, "2", "two", "3"), "a", "one", "2")
    # New words of whole pages, by kind: what is left of pages with words not known, less what breaks leave of such.
    word = e.groupBy("kind", "word").agg(F.first("n1").alias("n"), F.first("s1").alias("s"), F.first("c1").alias("c"))
    known = word.groupBy("kind").agg(F.sum(F.when(F.col("c") >= 1, F.col("n")).otherwise(0)).alias("kn"), F.sum(F.when(F.col("c") >= 1, F.col("s")).otherwise(0)).alias("ks"), F.sum("c").alias("kc"))
    e = e.join(known, "kind")
    fresh = F.greatest(F.col("n0") - F.col("kn") - f * (F.col("s0") - F.col("ks")), F.lit(0.0))
    e = e.withColumn("new", F.greatest((fresh + 0.5) / (F.col("kc") + fresh + 1), F.lit(NEW))).withColumn("c0", F.col("kc") + fresh)
    # The page that ends so is left out of the counts.
    own = {"c" + k: F.when(F.col("n" + k) > 1, F.col("c" + k) * (1 - 1 / F.col("n" + k))).otherwise(0.0) for k in "1a23"}
    e = e.withColumns(own)
    q = lambda k, of: (F.col("s" + k) + 0.5) / (F.col("s" + of) + 1)
    fresh_word = F.col("new") * F.greatest("c0", F.lit(1.0))
    kind = F.log((F.col("s0") + 1) / (m + 10)) - F.log((F.col("c0") + 0.5) / (n + 10))
    last = F.log(q("1", "0")) - F.log((F.col("c1") + F.least(fresh_word * q("1", "0"), F.lit(0.5))) / (F.col("c0") + fresh_word + 0.5))

    def step(k: str, of: str, weight: float) -> Column:
        w = weight + NEW * F.col("c" + of)
        return F.log(q(k, of)) - F.log((F.col("c" + k) + w * q(k, of)) / (F.col("c" + of) + w))

    return e.select("word", "words", "n", (kind + last + step("2", "a", PAIR) + step("3", "2", TRIPLE)).alias("evidence"))


def share_fit(evidence: np.ndarray, pages: np.ndarray, start: float) -> float:
    """Share of cut pages of a source, from the evidence of its pages."""
    ratio, share = np.exp(np.clip(evidence, -40, 40)), start
    for _ in range(50):
        post = share * ratio / (share * ratio + 1 - share)
        share = float(((post * pages).sum() + WEIGHT * start) / (pages.sum() + WEIGHT))
    return share


def cut_pages(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, source, at_limit, remnant, closed, evidence, share, log_odds`` for every page; cut if above 0.

    ``evidence`` is that of the ending, ``share`` the source's share of pages cut
    away from limits, ``at_limit`` the posterior of a length at a limit.
    """
    base = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    t = F.col("text")
    # What a break left is looked for in the last characters; a longer run of it is blanks or marks all the same.
    rest = F.regexp_extract(F.right(t, F.lit(2 * REACH)), REMNANT, 0)
    base = base.withColumn("rest", F.coalesce(rest, F.lit("")))
    body = F.regexp_replace(F.left(t, F.length(t) - F.length("rest")), r"\s+\z", "")
    base = base.withColumn("body", F.coalesce(body, F.lit("")))
    blank = F.col("body") == ""
    rows = base.select(
        "key", "source", F.coalesce(F.length(t), F.lit(0)).alias("chars"), F.coalesce(F.octet_length(t), F.lit(0)).alias("bytes"), F.xxhash64(t).alias("same"), (t.isNull() | (F.trim(t) == "") | blank).alias("blank"),
        F.when(F.col("rest") == "", 0).when(F.col("rest").rlike(r"\A\s+\z"), 1).otherwise(2).alias("remnant"), F.right(F.col("body"), F.lit(REACH)).alias("tail"), _opened(F.col("body")).alias("opened"),
    )
    rows = materialise(endings(rows), "pages")

    # Limits; a cut between characters may fall short of one in bytes.
    real = limits(rows).where("posterior > 0.5")
    real = real.select("source", "unit", "posterior", F.explode(F.sequence(F.col("limit") - F.col("width"), F.col("limit"))).alias("len"))
    real = materialise(real.groupBy("source", "unit", "len").agg(F.max("posterior").alias("posterior")), "limits")
    for unit in ("chars", "bytes"):
        r = real.where(F.col("unit") == unit).select(F.col("source").alias("s_"), F.col("len").alias("len_"), F.col("posterior").alias("at_" + unit))
        rows = rows.join(r, F.col("source").eqNullSafe(F.col("s_")) & (F.col(unit) == F.col("len_")), "left").drop("s_", "len_")
    rows = rows.withColumn("at_limit", F.greatest("at_chars", "at_bytes"))
    whole = ~F.col("blank") & F.col("at_limit").isNull() & (F.col("remnant") == 0)

    # What pages end with, and what breaks anywhere in them would leave.
    places = F.transform(F.sequence(F.lit(1), F.lit(TRIALS)), lambda i: F.lit(1) + F.pmod(F.xxhash64("h", i), F.col("size")).cast("int"))
    broken = base.where(~blank).select("body", F.xxhash64("text").alias("h"), F.length("body").cast("long").alias("size")).select("body", places.alias("places"))
    left = F.transform("places", lambda at: F.struct(F.substring(F.substring(F.col("body"), F.lit(1), at), F.lit(-REACH), F.lit(REACH)).alias("tail"), _opened(F.substring(F.col("body"), F.lit(1), at)).alias("opened")))
    trial = endings(broken.select(F.explode(left).alias("x")).select("x.*")).groupBy("word", "words").agg(F.count(F.lit(1)).alias("s"))
    zero = F.lit(0).cast("long")
    ends = rows.where("NOT blank").groupBy("word", "words").agg(F.count(F.lit(1)).alias("p"), F.sum(whole.cast("long")).alias("n"))
    counts = ends.withColumn("s", zero).unionByName(trial.withColumns({"p": zero, "n": zero}))
    odds = ending_odds(materialise(counts.groupBy("word", "words").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("s").alias("s")), "endings"))

    # How often pages that close end with each remnant: per source, drawn to that of all, less what cuts at the end of sentences leave.
    kinds = rows.where("closed AND NOT blank").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("remnant") == k).cast("long")).alias(f"r{k}") for k in (1, 2)])
    every = kinds.agg(F.sum("n").alias("n"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2")).first()
    usual = lambda k: F.greatest(F.col(f"r{k}") - 0.002 * F.col("n") - 2, F.lit(0.0))
    mean = {k: max((every[f"r{k}"] or 0) - 0.002 * (every["n"] or 0), 0.5) / ((every["n"] or 0) + 1) for k in (1, 2)}
    kinds = kinds.select(F.col("source").alias("s_"), *[((usual(k) + WEIGHT * mean[k]) / (F.col("n") + WEIGHT)).alias(f"r{k}") for k in (1, 2)])
    rows = rows.join(odds, ["word", "words"], "left").join(kinds, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    r1, r2 = (F.coalesce(F.col(f"r{k}"), F.lit(mean[k])) for k in (1, 2))
    left_so = F.when(F.col("remnant") == 1, F.log(LEAVES / r1)).when(F.col("remnant") == 2, F.log(LEAVES / r2)).otherwise(F.log((1 - 2 * LEAVES) / F.greatest(1 - r1 - r2, F.lit(0.01))))
    rows = rows.select("key", "source", "blank", "at_limit", (F.col("remnant") > 0).alias("remnant"), "closed", (F.coalesce("evidence", F.lit(0.0)) + left_so).alias("evidence"))
    rows = materialise(rows, "evidence")

    # Shares of cut pages away from limits, from counts of rounded evidence.
    free = rows.where("NOT blank AND at_limit IS NULL").groupBy("source", F.round(F.col("evidence") * 4).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n"))
    start = share_of_all(free)

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s_": [p["source"].iloc[0]], "share": [share_fit(p["e"].to_numpy() / 4, p["n"].to_numpy(float), start)]})

    shares = free.groupBy("source").applyInPandas(fit, "s_ string, share double")
    rows = rows.join(shares, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    at, share = F.when(F.col("at_limit").isNotNull(), F.least("at_limit", F.lit(0.9999))), F.coalesce("share", F.lit(start))
    odds = F.when(at.isNotNull(), F.log(at / (1 - at)) + F.greatest("evidence", F.lit(-4.0))).otherwise(F.log(share / (1 - share)) + F.col("evidence"))
    return rows.select("key", "source", at.alias("at_limit"), "remnant", "closed", "evidence", share.alias("share"), F.when(F.col("blank"), F.lit(-20.0)).otherwise(odds).alias("log_odds"))


def share_of_all(counts: DataFrame, start: float = PRIOR) -> float:
    """Share of cut pages of the collection, from pages ``n`` per rounded evidence ``e`` (at most a few hundred values)."""
    rows = counts.groupBy(F.least(F.greatest("e", F.lit(-160)), F.lit(160)).alias("e")).agg(F.sum("n").alias("n")).collect()
    e, n = np.array([r["e"] / 4 for r in rows]), np.array([float(r["n"]) for r in rows])
    return share_fit(e, n, start) if len(rows) else start
