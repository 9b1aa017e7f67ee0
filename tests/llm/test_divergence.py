"""op11: terms, shares, tiles and the whole audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowtide.llm import divergence


def brute(rows, min_docs, top):
    """rows of (text, lang, source), the definition word by word."""
    rows = [tuple(v or "" for v in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)) for t, _, _ in rows]
    in_docs = defaultdict(Counter)
    for words, (_, lang, _) in zip(found, rows):
        in_docs[lang].update(set(words))
    out = set()
    for lang in {r[1] for r in rows}:
        kept = {t for t, n in in_docs[lang].items() if n >= min_docs}
        v = len(kept)
        counts = {s: Counter() for _, l, s in rows if l == lang}
        for words, (_, l, s) in zip(found, rows):
            if l == lang:
                counts[s].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def rows():
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in ("ab", "Ö", "Zé", "k日") for b in ("", "x", "n'", "É") for c in ("", "q", "7w")]
    out = []
    for i in range(240):
        lang = rng.choice(["en", "en", "en", "de", None, "few"])
        source = None if i % 17 == 0 else f"s{rng.randint(0, 2 + i % 7)}"
        text = " ".join(rng.choice(words[: 5 + len(source or "") * 9]) for _ in range(rng.randint(0, 60)))
        out.append((None if i % 29 == 0 else text, lang, source))
    out += [("only here " * 3, "lone", "one"), ("", "bare", "x"), (None, "bare", "y"), ("Ab " * 5000, "en", "s1"), out[3], out[3]]
    return out


def result(df):
    got = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("groups, terms", [(256, 256), (2, 3)])
def test_audit_equals_the_definition(spark, groups, terms):
    # Tiles this small cut every language in many blocks and pairs of tiles.
    docs = spark.createDataFrame(rows(), "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS place", "3 AS item", "4 AS count")
    assert result(divergence.audit(docs, side=groups, block_terms=terms, most=50)) == brute(rows(), divergence.MIN_DOCS, divergence.TOP)


def test_registered_query_and_its_sql(spark, tmp_path):
    import duckdb

    from flowtide.llm import queries

    spark.createDataFrame([(i, *r) for i, r in enumerate(rows())], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({queries.ORACLE['op11_source_divergence']})").fetchall()
    got = result(queries.op11_source_divergence(spark, str(tmp_path)))
    assert got == set(wanted) == brute(rows(), 30, 50)


def test_empty_table_and_languages_without_kept_terms(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([("a b", "en", "x"), ("c", "en", None), (None, "en", "y")], schema)
    assert result(divergence.audit(few)) == brute([("a b", "en", "x"), ("c", "en", None), (None, "en", "y")], 30, 50)


def test_shares_are_exact_for_large_counts():
    counts = np.array([5, 7, 123_456_789_012, 4_000_000_000_000_000], np.int64)
    total = np.int64(8_999_999_999_999_999)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * int(c) // int(total) for c in counts]


def test_pair_sums_in_slabs(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1000, (7, 11)), rng.integers(0, 1000, (5, 11))
    whole = divergence.pair_sums(a, b)
    monkeypatch.setattr(divergence, "SLAB", 60)
    assert (divergence.pair_sums(a, b) == whole).all() and whole[2, 3] == abs(a[2] - b[3]).sum()
