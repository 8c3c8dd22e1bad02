import random

import pandas as pd
import pytest

from prismcube.llm import tokens, truncation

SCHEMA = "doc_id long, text string, source string, ending string"
WORDS = "harbour market council railway opened visited against during several engineers bridge company river station people morning evening".split()


def page(r, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join(r.choice(WORDS) for _ in range(r.randrange(5, 12))).capitalize() + r.choice([".", ".", "!"]))
    lines, line = [], ""
    for w in " ".join(out).split():
        if len(line) + len(w) > 40:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    lines.append(line)
    if r.random() < 0.4:
        lines += [f"Sale by auction, at {r.randrange(99)} o'clock" for _ in range(r.randrange(1, 4))]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    rows, cut = [], set()
    for i in range(1500):
        s = r.choice(["free", "limited", "bytes"])
        t = page(r, r.randrange(100, 900))
        if s == "limited" and len(t) > 700:
            t = t[:700]
            cut.add(i)
        elif s == "bytes":
            t = t.replace("river", "rivière")
            if len(t.encode()) > 800:
                t = t.encode()[:800].decode(errors="ignore")
                cut.add(i)
        elif r.random() < 0.04:
            t = t[: r.randrange(40, len(t) - 20)] + r.choice(["", "", "…", " [...]", "�", "&#82", "\\u00", " "])
            cut.add(i)
        rows.append((i, t, s, "x"))
    return rows, cut


def test_finds_cut_pages(spark, corpus):
    rows, cut = corpus
    found = {r["key"] for r in truncation.cut_pages(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source").where("log_odds > 0").collect()}
    assert len(found & cut) / len(cut) > 0.93 and len(found & cut) / len(found) > 0.93


def test_closing_phrases_do_not_hide_cut_words(spark):
    r = random.Random(11)
    rows, cut = [], set()
    phrase = "so they met to the general satisfaction"
    for i in range(600):
        body = f"{phrase}\n".join(page(r, 60).rstrip("\n") + "\n" for _ in range(5))
        if i % 2:
            rows.append((i, body + phrase + ".", "a", "x"))
        elif i % 40 == 0:
            cut.add(i)
            rows.append((i, body + phrase[: -3 - i // 40 % 6], "a", "x"))
        else:
            rows.append((i, body.rstrip("\n") + ".", "a", "x"))
    found = {r["key"] for r in truncation.cut_pages(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source").where("log_odds > 0").collect()}
    assert cut <= found and len(found - cut) <= 6


def test_limits_are_found(spark, corpus):
    rows, _ = corpus
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("source", "length(text) AS chars", "octet_length(text) AS bytes", "xxhash64(text) AS same")
    best = {}
    for r in truncation.limits(df).where("posterior > 0.5").collect():
        best[r["source"]] = max(best.get(r["source"], (0,)), (r["odds"], r["unit"], r["limit"]))
    assert best["limited"][1:] == ("chars", 700) and best["bytes"][1:] == ("bytes", 800) and "free" not in best


def test_fit_recovers_a_censored_distribution():
    import numpy as np

    x = np.exp(np.random.default_rng(1).normal(6, 0.7, 20_000))
    c = 800.0
    low = np.log(x[x < c])
    s = pd.DataFrame({"limit": [c], "m": [float((x >= c).sum())], "n": [float(len(low))], "s1": [low.sum()], "s2": [(low**2).sum()], "width": [0], "above": [0.0], "near": [0.0]})
    out = truncation.length_fit(s).iloc[0]
    assert out.posterior > 0.99 and abs(out.surviving - (x >= c).mean()) < 0.01
    assert truncation.length_fit(s.assign(m=1.0)).iloc[0].posterior == 0
    # As many pages at a length as by nature, and as many above it: no limit.
    natural = s.assign(m=float(((x >= c) & (x < c + 1)).sum()), above=float((x >= c + 1).sum()))
    assert truncation.length_fit(natural).iloc[0].posterior < 0.01


def test_a_limit_that_was_raised_is_found(spark):
    r = random.Random(3)
    rows = []
    for i in range(800):
        t = page(r, r.randrange(100, 900))
        at = 500 if i % 2 else 800
        rows.append((i, t[:at], "s", "x"))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("source", "length(text) AS chars", "octet_length(text) AS bytes", "xxhash64(text) AS same")
    found = {r["limit"] for r in truncation.limits(df).where("posterior > 0.5 AND unit = 'chars'").collect()}
    assert found == {500, 800}


def test_a_source_that_closes_with_a_blank_is_not_cut(spark):
    r = random.Random(4)
    rows = [(i, page(r, 300) + ("\n" if i % 2 else ""), "blank" if i % 2 else "bare", "x") for i in range(400)]
    got = truncation.cut_pages(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source")
    assert got.where("log_odds > 0").count() <= 4


def test_recall_by_kind_of_break(spark):
    r = random.Random(9)
    kinds = ["", "…", "...", " [...]", " --", "\ufffd", "&#82", "&quo", "\\u00", "%2", "<b", " ", "\n"]
    rows, kind = [], {}
    for i in range(2000):
        t = page(r, r.randrange(150, 900))
        if i % 12 == 0:
            kind[i] = kinds[i // 12 % len(kinds)]
            t = t[: r.randrange(40, len(t) - 20)].rstrip() + kind[i]
        rows.append((i, t, "ab"[i % 2], "x"))
    found = {r["key"] for r in truncation.cut_pages(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source").where("log_odds > 0").collect()}
    marked, plain = [i for i, k in kind.items() if k], [i for i, k in kind.items() if not k]
    assert sum(i in found for i in marked) / len(marked) > 0.95
    assert sum(i in found for i in plain) / len(plain) > 0.8
    assert len(found - set(kind)) <= 0.05 * len(found)


def test_edges(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, " \n ", None, "x"), (4, "Whole.", None, "x"), (5, "z" * 300_000, "a", "x"), (4, "Whole.", None, "x"), (None, "Cut sho…", "b", "x")]
    got = truncation.cut_pages(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    odds = {(r["key"], r["source"]): r["log_odds"] for r in got}
    assert all(odds[k] < 0 for k in ((1, "a"), (2, "a"), (3, None), (4, None))) and odds[None, "b"] > 0
    assert truncation.cut_pages(spark.createDataFrame([], SCHEMA), "doc_id", "text", "source").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world, hello!"), (2, ""), (3, None), (4, "<|endoftext|> é漢" * 2000)], "id long, text string")
    got = {r["id"]: r["n"] for r in tokens.count_tokens(df, "text", ["id"], "n").collect()}
    enc = tokens.encoding(tokens.VOCABULARY)
    assert got == {1: len(enc.encode_ordinary("Hello world, hello!")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("<|endoftext|> é漢" * 2000))}
    assert enc.decode(enc.encode_ordinary("Hello world, hello!")) == "Hello world, hello!"
