"""The operators against brute force on a small table with nulls, empty and long texts, ties and repeated rows."""

import collections
import glob
import hashlib
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowtide.llm import common, encoders, fingerprints, jaccard, line_dedup, mixing, packing, quality, substrings, token_counts, token_store, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def library_ids(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_librarys_ids(path, docs):
    e = encoders.Encoder(path)
    odd = ["don't 'tis ...'s _x_ 12a3", "ΣΑΣ É́ İx", "\x01a b", "a\x1fb\x85c", "  a  b\t\tc", "'", "日本語 😀", "x" * 4000]
    for text in [*odd, *(t or "" for t in texts_of(docs).values())]:
        assert [*e.encode(text), 9] == library_ids(path, text, 9)


@pytest.mark.parametrize(("path", "ids"), [(BYTE, [31373, 220, 50256, 612]), (WORD, None)])
def test_special_tokens_as_the_library_gives_them(path, ids):
    e, t = encoders.Encoder(path, literal=False), Tokenizer.from_file(path)
    for text in ["hello <|endoftext|> there", "<|startoftext|>", "a<|endoftext|><|endoftext|>B 12", "<|EndOfText|> x", "<| endoftext|>", "none's here", "日<|endoftext|>"]:
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert ids is None or e.encode("hello <|endoftext|> there") == ids


def test_queries_give_the_librarys_ids(spark, tmp_path):
    from flowtide.llm import queries, stages

    from .conftest import SCHEMA

    text = "hello <|endoftext|> there <|startoftext|>"
    spark.createDataFrame([(1, text, "en", "s", len(text))], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want = {path: Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids for path in (BYTE, WORD)}
    assert queries.op4_packing(spark, str(tmp_path)).first()["ids_crc32"] == crc([*want[BYTE], packing.END_ID])
    assert queries.op9_token_store(spark, str(tmp_path)).first()["ids_crc32"] == crc([*want[WORD], token_store.END_ID])
    totals = {r["tokenizer"]: r["n_tokens"] for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    assert totals == {"byte_bpe_50k": len(want[BYTE]) + 1, "word_bpe_49k": len(want[WORD]) + 1}
    piece = stages.token_packing(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).first()
    assert bytes(piece["ids"]) == np.array([*want[BYTE], packing.END_ID], "<u4").tobytes()


# Quality


def brute_base(text):
    words = WORDS.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, dup = [x for x in (text or "").split("\n") if WORDS.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts_and_marks(docs, empty):
    field = quality.ChainField.plain()
    got = quality.judge(docs, field)
    assert {"row", "key", "drop"} <= set(got.columns) and got.columns.count("kept") == 1
    for r in got.collect():
        base = brute_base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert len(r["line_marks"]) == sum(bool(WORDS.search(x)) for x in (r["text"] or "").split("\n"))
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(empty, field).count() == 0


def test_viterbi_and_fit_against_all_paths():
    rng = np.random.default_rng(0)
    features = rng.normal(size=(6, 3))
    field = quality.ChainField(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    scores = features @ field.weights

    def value(path):
        return sum(scores[t, m] for t, m in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

    best = max(np.ndindex(*[2] * 6), key=value)
    lines = quality.Lines(np.concatenate([features, features]), np.ones(12), np.array([0, 6, 6, 12]))
    assert field.viterbi(lines).tolist() == [*best, *best]
    truth = [np.array([0, 0, 1, 1]), np.array([1, 1]), np.array([0])]
    x = [np.column_stack([np.ones(len(t)), t + 0.1 * rng.normal(size=len(t))]) for t in truth]
    fitted = quality.ChainField.fit(x, truth, steps=200)
    at = np.cumsum([0, *map(len, x)])
    assert fitted.viterbi(quality.Lines(np.concatenate(x), np.ones(at[-1]), at)).tolist() == np.concatenate(truth).tolist()


def test_quality_fit_without_labels_is_plain(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert (quality.fit_field(docs, labels).weights == quality.ChainField.plain().weights).all()


# Packing


def test_packing_round_trip(docs, empty):
    pieces = packing.pack(docs.union(docs.where("doc_id = 8")), BYTE, group_docs=20)
    rows = pieces.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts_of(docs).items():
        want = library_ids(BYTE, text, 0)
        parts = sorted(by_doc[doc], key=lambda r: r["start"])
        parts = parts[::2] if doc == 8 else parts
        assert b"".join(p["ids"] for p in parts) == np.array(want, "<u4").tobytes()
        assert all(p["doc_tokens"] == len(want) for p in parts)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) // 4
            at += p["length"]
        assert at <= 1024
    assert packing.pack(empty, BYTE).count() == 0


def test_first_fit_decreasing_against_a_plain_scan():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300).tolist()
    bins, want = [], {}
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        b = next((k for k, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
        bins += [0] * (b == len(bins))
        want[i] = (b, bins[b])
        bins[b] += sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(300)]


# Line dedup


def brute_lines(texts):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    owner, held = {}, collections.defaultdict(set)
    for d in sorted(texts):
        for x in (texts[d] or "").split("\n"):
            owner.setdefault(key(x), d)
            held[key(x)].add(d)
    out = {}
    for d, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or owner[key(x)] == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, empty):
    want = brute_lines(texts_of(docs))
    got = line_dedup.dedup_lines(docs)
    assert "row" in got.columns and "drop" in got.columns
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()} == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_keys_without_a_slot_are_dropped_all_the_same(docs, monkeypatch):
    monkeypatch.setattr(line_dedup.PerfectHash, "LEVELS", 0)
    shared = docs.sparkSession.createDataFrame([(0, 1, 2, 2, 7), (0, 3, 4, 5, 9)], "shard long, h1 long, h2 long, n_docs int, owner long")
    probes = pa.table({"doc": [7, 8, 9, 8], "h1": [1, 1, 3, 5], "h2": [2, 2, 4, 4]})
    rows = shared.toPandas()
    index = pa.table({"levels": [line_dedup.PerfectHash.of(np.array([], np.uint64)).dump()], "prints": [b""], "counts": [b""], "owners": [b""], "rest": [rows[["h1", "h2", "owner"]].to_numpy(np.int64).tobytes()]})
    assert line_dedup._probe(probes, index).to_pylist() == [{"doc": 8, "h1": 1, "h2": 2}]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    h = line_dedup.PerfectHash.of(keys)
    assert sorted(h.index(keys).tolist()) == list(range(5000))
    assert (line_dedup.PerfectHash.load(h.dump()).index(keys) == h.index(keys)).all()


# Token counts


def test_token_counts_are_idempotent(spark, docs, empty, tmp_path):
    counts = token_counts.count_tokens(docs, {"byte": BYTE, "word": WORD}, keep=["doc_id", "source", "lang"]).cache()
    for r in counts.collect():
        assert r["n_tokens"] == len(library_ids({"byte": BYTE, "word": WORD}[r["tokenizer"]], texts_of(docs)[r["doc_id"]], 0)) - 1
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    insert = counts.withColumns({"kind": F.lit("insert"), "old_tokens": F.lit(0)})
    for batch in ("a", "a"):
        rollup.commit(batch, insert)
    revised = counts.where("doc_id % 2 = 0").withColumns({"kind": F.lit("revise"), "old_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") + 5})
    gone = counts.where("doc_id % 2 = 1").withColumns({"kind": F.lit("delete"), "old_tokens": F.col("n_tokens"), "n_tokens": F.lit(None).cast("long")})
    for _ in range(2):
        rollup.commit("b", revised.unionByName(gone))
    got = {(r["source"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for r in counts.where("doc_id % 2 = 0").collect():
        want[r["source"], r["tokenizer"]][0] += 1
        want[r["source"], r["tokenizer"]][1] += r["n_tokens"] + 5
    assert got == {k: tuple(v) for k, v in want.items()}
    assert token_counts.count_tokens(empty, {"byte": BYTE}).count() == 0


def test_a_commit_that_dies_leaves_the_last_sums(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    insert = spark.createDataFrame([("s", None, "t", n, 0) for n in (3, 4, 4)], "source string, lang string, tokenizer string, n_tokens long, old_tokens long").withColumn("kind", F.lit("insert"))
    totals = lambda: [(r["source"], r["lang"], r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()]
    rollup.commit("a", insert)
    failing = insert.withColumn("n_tokens", F.raise_error(F.lit("executor lost")).cast("long"))
    for batch in ("a", "b"):
        with pytest.raises(Exception, match="executor lost"):
            rollup.commit(batch, failing)
        assert totals() == [("s", None, 3, 11)] and rollup.batches() == ["a"]
    # What a driver that died would leave: files without the mark of a complete version.
    (tmp_path / "rollup" / "batch=a" / "version-000000007-dead").mkdir()
    before = rollup.totals()
    for n in range(1, 4):
        rollup.commit("a", insert.limit(n))
        assert totals()[0][2] == n
    assert before.columns == rollup.totals().columns
    assert sum((p / "_SUCCESS").exists() for p in (tmp_path / "rollup" / "batch=a").iterdir()) == 2
    rollup.commit("a", insert.limit(0))
    assert totals() == []
    rollup.commit("b", insert.withColumn("kind", F.lit("unknown")))
    assert totals() == [] and rollup.batches() == ["a", "b"]


def test_token_count_query_equals_direct_sums(spark, docs, tmp_path):
    from flowtide.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    versions = {"byte_bpe_50k": BYTE, "word_bpe_49k": WORD}
    direct = token_counts.count_tokens(docs, versions, literal=False).groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    assert got == {(r["source"], r["lang"], r["tokenizer"]): (r["n"], r["n"] + r["t"]) for r in direct.collect()}


# Substrings


def brute_repeats(rows, n):
    count = collections.Counter(b[i : i + n] for _, b in rows for i in range(len(b) - n + 1))
    out = []
    for d, b in rows:
        mask = [False] * len(b)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                mask[i : i + n] = [True] * n
        spans, at = [], 0
        for gone, run in ((mask[i], 1) for i in range(len(b))):
            if gone:
                spans[-1:] = [(spans[-1][0], spans[-1][1] + 1)] if spans and sum(spans[-1]) == at else [*spans[-1:], (at, 1)]
            at += run
        out.append((d, bytes(x for x, g in zip(b, mask) if not g), spans))
    return sorted(out)


@pytest.mark.parametrize(("n", "gap"), [(400, 192), (60, 20)])
def test_substring_removal(docs, empty, n, gap):
    repeated = docs.union(docs.where("doc_id = 20"))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in repeated.select("doc_id", "text").collect()]
    got = substrings.remove_repeats(repeated, length=n, gap=gap).select("doc_id", F.col("kept").alias("k"), "spans", "n_bytes", "n_removed", "row").collect()
    assert sorted((r["doc_id"], bytes(r["k"]), [(s["start"], s["length"]) for s in r["spans"]]) for r in got) == brute_repeats(rows, n)
    assert all(r["n_bytes"] - r["n_removed"] == len(r["k"]) for r in got)
    assert substrings.remove_repeats(empty).count() == 0


# Mixing


def test_hypergeometric_draws(spark):
    total, good, draws, n = 40, 13, 17, 20_000
    one = lambda x: F.lit(x).cast("long")
    got = {r["x"]: r["count"] for r in spark.range(n).select(mixing.hypergeometric(one(total), one(good), one(draws), mixing._uniform(F.col("id"))).alias("x")).groupBy("x").count().collect()}
    for x in range(14):
        expected = n * math.comb(good, x) * math.comb(total - good, draws - x) / math.comb(total, draws)
        assert abs(got.get(x, 0) - expected) <= 5 * math.sqrt(expected) + 2
    assert spark.range(1).select(mixing.hypergeometric(one(0), one(0), one(0), F.lit(0.5)).alias("x")).first()["x"] == 0


def test_mixing_targets_and_spans(spark, docs, empty):
    mixed = mixing.mix(docs, block_words=64, shard_words=512)
    draws = [r.asDict() for r in mixed.draws.collect()]
    again = [r.asDict() for r in mixing.mix(docs, block_words=64, shard_words=512).draws.collect()]
    key = lambda r: (r["shard"], r["position"])
    assert sorted(draws, key=key) == sorted(again, key=key)
    sizes = {d: len(WORDS.findall(t or "")) for d, t in texts_of(docs).items()}
    taken, per_source, used = collections.Counter(), collections.Counter(), collections.Counter()
    for r in draws:
        taken[r["id"]] += r["n_words"]
        per_source[r["source"]] += r["n_words"]
        for w in range(r["first_word"], r["first_word"] + r["n_words"]):
            used[r["id"], r["round"], w] += 1
            assert w < sizes[r["id"]]
    assert set(used.values()) == {1}  # disjoint within a round
    assert all(taken[d] <= 3 * sizes[d] for d in sizes)
    targets = {r["source"]: r for r in mixed.sources.collect()}
    order = sorted(targets, key=lambda s: (s is None, (s or "").encode()))
    # Shares by weight, those above the cap cut there and the excess shared again.
    size = {s: targets[s]["source_size"] for s in order}
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        left = total - sum(3 * size[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[q] for q in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        want = 3 * size[s] if s in capped else share[s]
        assert targets[s]["target"] == pytest.approx(want) and abs(per_source[s] - want) <= 1
    shards = collections.defaultdict(list)
    for r in draws:
        shards[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())
    out = mixing.mixed_documents(docs.union(docs.where("doc_id = 14")), mixed)
    assert out.columns == docs.columns
    assert sum(len(WORDS.findall(r["text"])) for r in out.collect()) == sum(taken.values())
    nothing = mixing.mix(empty)
    assert nothing.draws.count() == 0 and mixing.mixed_documents(empty, nothing).count() == 0


# Token store


def test_token_store_round_trip(docs, empty):
    store = token_store.write_store(docs.union(docs.where("doc_id = 8")), WORD)
    at = 0
    rows = {r["doc_id"]: r for r in store.documents().collect()}
    texts = texts_of(docs)
    assert len(rows) == len(texts)
    for d in sorted(texts):
        ids = library_ids(WORD, texts[d], 2)
        assert (rows[d]["start"], rows[d]["n_tokens"], bytes(rows[d]["ids"])) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    packs = docs.sparkSession.read.parquet(f"{store.path}/documents").collect()
    stored = [d for r in packs for d, mine in zip(r["digests"], r["owned"], strict=True) if mine]
    assert len(stored) == len(set(stored)) == len({d for r in packs for d in r["digests"]})
    assert sum(r["n_docs"] for r in store.manifest().collect()) == len(texts)
    assert token_store.write_store(empty, WORD).documents().count() == 0


def test_token_store_files_ascend_and_open_from_their_path(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs, WORD, path=path)
    files = sorted(glob.glob(f"{path}/documents/part-*.parquet"))
    ids = [i for f in files for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert len(files) > 1 and ids == sorted(ids)
    store = token_store.TokenStore(spark, path)
    rows = sorted(store.documents().collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == ids
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]


@pytest.mark.parametrize("column", ["root", "own"])
def test_token_store_finds_damage(spark, docs, tmp_path, column):
    path = str(tmp_path / "store")
    token_store.write_store(docs, WORD, path=path)
    victim = sorted(glob.glob(f"{path}/documents/part-*.parquet"))[0]
    table = pq.read_table(victim)
    values = table.column(column).to_pylist()
    at = next(i for i, v in enumerate(values) if v)
    values[at] = bytes([values[at][0] ^ 1]) + values[at][1:]
    os.remove(f"{os.path.dirname(victim)}/.{os.path.basename(victim)}.crc")
    pq.write_table(table.set_column(table.schema.get_field_index(column), column, pa.array(values, pa.binary())), victim)
    with pytest.raises(Exception, match="match"):
        token_store.TokenStore(spark, path).documents().collect()


def test_chunks_follow_content():
    ids = np.random.default_rng(0).integers(0, 40_000, 20_000).astype("<u2")
    ends = token_store.cuts(ids)
    assert ends[-1] == 20_000 and all(b - a <= token_store.MOST for a, b in zip([0, *ends], ends))
    chunks = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.cuts(x)], token_store.cuts(x))}
    moved = np.concatenate((ids[:5], ids))
    assert len(chunks(ids) & chunks(moved)) >= len(ends) - 3


# Jaccard join


def brute_components(texts, words, num, den):
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("words", "num", "few", "block"), [(4, 85, 64, 512), (2, 20, 3, 4)])
def test_jaccard_components(docs, empty, monkeypatch, words, num, few, block):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs.union(docs.where("doc_id = 9")), words=words, num=num).collect()}
    assert got == brute_components(texts_of(docs), words, num, 100)
    assert jaccard.similar_components(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r["id"]: r["component"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}


# Fingerprints


def paragraphs(text):
    return set(re.findall(r"[^\n]{1,1000}", text or ""))


def test_fingerprints_recover_the_difference(docs, empty):
    rows = fingerprints.edited_versions(docs)
    got = {r["doc_id"]: r for r in fingerprints.compare(rows, "keys", "next_keys", first=2).collect()}
    texts = texts_of(docs)
    ids = sorted(texts)
    for i, d in enumerate(ids):
        nxt = texts[ids[(i + 1) % len(ids)]] or ""
        a, b = paragraphs(texts[d]), paragraphs(nxt)
        assert got[d]["likeness"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert (len(got[d]["only_a"]), len(got[d]["only_b"])) == (len(a - b), len(b - a))
        half = len(texts[d] or "") // 2
        assert got[d]["edited"] == (texts[d] or "")[: len(texts[d] or "") - half] + nxt[:half]
    assert fingerprints.compare(fingerprints.edited_versions(empty), "keys", "next_keys").count() == 0


def test_equal_texts_have_equal_fingerprints(docs):
    prints = collections.defaultdict(set)
    for r in docs.select("text", fingerprints.as_text(fingerprints.sketch(fingerprints.paragraph_keys(F.col("text")))).alias("p")).collect():
        prints[r["text"]].add(r["p"])
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_of_one_line_texts_keep_their_likeness(spark, tmp_path):
    from flowtide.llm import queries

    from .conftest import SCHEMA

    texts = {i: "".join(f"{i} {k} " for k in range(150))[:900] for i in range(3)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = lambda t: set(re.findall(r"[^\n]{1,240}", t))
    for r in queries.op2_fingerprints(spark, str(tmp_path)).collect():
        t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % 3]
        half = len(t) // 2
        a, b = pieces(t), pieces(t[: len(t) - half] + nxt[:half])
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_edited"] > 0


# Toxicity


@pytest.mark.parametrize("common", [1, 8, 1000])
def test_block_max_search_is_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 8, 500)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    terms = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in lengths])
    weights = toxicity._unit(offsets, rng.random(len(terms)) + 0.1).astype(np.float32).astype(float)
    index = toxicity.BlockMaxIndex.build(np.arange(500), rng.integers(0, 2, 500), offsets, terms, weights, 40)
    dense = np.zeros((500, 40))
    dense[np.repeat(np.arange(500), lengths), terms] = weights
    end = offsets[60]
    ids, scores = index.search(offsets[:61], terms[:end], weights[:end], 15, np.arange(60))
    for i in range(60):
        cosines = np.round(dense @ dense[i], 12)
        cosines[i] = 0
        want = [j for j in np.lexsort((np.arange(500), -cosines))[:15] if cosines[j] > 0]
        got = ids[i][ids[i] >= 0].tolist()
        assert got == want or np.allclose(scores[i][: len(got)], cosines[want], atol=1e-11)


def test_toxicity_held_out(spark):
    import random

    from .conftest import SCHEMA, prose

    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(1000 + i, rng.randint(20, 80)).split(" ")
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vilething", "badterm"]))
        rows.append((i, None if i == 399 else " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, counts = toxicity.fit(docs, marks, F.col("key") % 5 != 0)
    got = {r["key"]: r for r in toxicity.score(counts, model).collect()}
    held = [i for i in range(400) if i % 5 == 0]
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(e["example"] % 5 != 0 for r in got.values() for e in r["evidence"])
    nothing, few = toxicity.fit(docs, marks.where("toxic = 0"))
    assert len({r["score"] for r in toxicity.score(few, nothing).collect()}) == 1
    none, no_rows = toxicity.fit(docs.limit(0), marks)
    assert toxicity.score(no_rows, none).count() == 0
    # Contradicting labels, null ids and repeated rows; columns with names used inside.
    odd = marks.union(marks.where("key is null" if "key" in marks.columns else "doc_id is null")).union(spark.createDataFrame([(None, 1), (1, 1), (1, 0)], marks.schema))
    wide = docs.union(docs.where("doc_id < 3")).selectExpr("*", "'x' AS key", "1 AS _", "2 AS terms", "3 AS mark")
    again, counts = toxicity.fit(wide, odd, F.col("key") % 5 != 0)
    assert toxicity.score(counts, again).count() == 403
    assert all(e["example"] != 1 for r in toxicity.score(counts, again).collect() for e in r["evidence"])


def test_toxicity_searches_all_terms(spark):
    from .conftest import SCHEMA

    # No word tells the labels apart, and each but the last stands in two documents only.
    name = lambda i: chr(97 + i // 10) + chr(97 + i % 10)
    rows = [(i, f"{name(i // 2)}one {name(i // 2)}two {name(i // 2)}three {name(i)}own", "en", "s", 0) for i in range(40)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, i // 2 % 2) for i in range(0, 40, 2)], "doc_id long, toxic int")
    model, counts = toxicity.fit(docs, marks)
    for r in toxicity.score(counts, model).collect():
        assert r["evidence"][0]["example"] == r["key"] // 2 * 2 and r["evidence"][0]["label"] == r["key"] // 2 % 2


# The pipeline


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
    pieces = at.orderBy("doc_id", "start").collect()
    assert pieces and {r["doc_id"] for r in pieces} <= set(texts_of(docs))
    used = {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 1024


def test_batches_are_bounded_and_a_text_goes_to_python_once(spark):
    rows = [(i, f"{i}" + "x" * (1 << 20)) for i in range(12)] + [(12, None), (13, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    done = common.add_columns(texts, "text", lambda column: [[column.buffers()[2].size] * len(column)], "batch_bytes long")
    assert done.columns == ["doc_id", "text", "batch_bytes"]
    found = done.collect()
    assert sorted((r.doc_id, r.text) for r in found) == rows
    assert max(r.batch_bytes for r in found) < common.BATCH_BYTES + (2 << 20)
    assert ", c1, text#" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_that_is_no_string_passes_as_it_is(spark):
    numbers = spark.createDataFrame([(1, 10), (2, None)], "doc_id long, text long")
    done = common.add_columns(numbers, "text", lambda column: [column.to_pylist()], "seen string")
    assert done.dtypes == [("doc_id", "bigint"), ("text", "bigint"), ("seen", "string")]
    assert sorted(done.collect()) == [(1, 10, "10"), (2, None, None)]


def test_texts_together_give_the_librarys_ids_and_encode_a_word_once(docs):
    e = encoders.Encoder(WORD)
    odd = ["don't 'tis ...'s _x_ 12a3", "ΣΑΣ É́ İx", "\x01a \x02b", " (a), [b]_;12.3  c\n", "", "  ", "日本語 😀", "a\tb"]
    texts = [*odd, *(t or "" for t in texts_of(docs).values())]
    for some in (texts, odd[3:6], [""], []):
        assert [a.tolist() for a in e.arrays(some, 9, "<u2")] == [library_ids(WORD, t, 9) for t in some]
    fast, seen = e.fast, []

    class Counted:
        def encode_ordinary(self, text):
            seen.append(len(text))
            return fast.encode_ordinary(text)

    e.fast = Counted()
    assert len(e.arrays(["the same unchbess words, again"] * 1000, 9)) == 1000
    assert sum(seen) < 100


def test_chunks_of_streams_hashed_together():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 2000, n).astype("<u2") for n in (0, 1, 3, 4, 47, 48, 49, 50, 700, 9000, 2)]
    assert token_store._cuts_of(streams) == [token_store.cuts(s) for s in streams]
    for ids, ends in zip(streams[1:], token_store._cuts_of(streams[1:]), strict=True):
        sizes = np.diff([0, *ends]).tolist()
        want = [hashlib.blake2b(ids[a:b].astype("<u4").tobytes(), digest_size=16).digest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert token_store._digests(ids.astype("<u4").tobytes(), sizes) == want
