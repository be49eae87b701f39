"""Quality rules, collocations and the filter audit, held against SQL and plain loops."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import collocations, filter_audit, quality_rules, registry

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a a a a a", "en", "s", 9), (None, "a a a a a", "en", "s", 9), (3, " \t\n\r\v\f ", "en", "s", 7),
    (4, "one two three " * 5000, "de", "s", 70000), (5, "one two three " * 5000, "de", "s", 70000), (5, "one two three " * 5000, "de", "s", 70000),
    (6, "x\nx\n\ny\nx \n y", "", "s", 12), (7, "Ünï çodé 😀 😀 😀 😀 ß", "fr", "s", 20), (8, "#" * 5000, "fr", "s", 5000), (9, "A.B,C;D:E!F?G\nH\rI\vJ\fK\tL", "es", "s", 24),
]
CLASH = ["words_", "lines_", "failed", "n_words", "part", "text_", "A", "digest", "first_", "lang_", "size", "phrase", "range"]


@pytest.fixture
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    both = docs.union(docs.limit(3)).union(spark.createDataFrame(ODD, DOCS))
    return both.withColumns({c: F.lit("own") for c in CLASH})


def rows_of(df):
    return [(r.doc_id, r.text or "", r.lang) for r in df.select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", ["op11_quality_rules", "quality_rule_ablations", "op12_collocations", "op13_filter_audit"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.execute(registry.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


def test_ledger_by_loops(spark, odd):
    got = sorted(tuple(-1 if x is None else x for x in r) for r in quality_rules.ledger(odd).select("doc_id", *quality_rules.MEASURES[:5]).collect())
    want = []
    for d, t, _ in rows_of(odd):
        w = WORD.findall(t)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(three)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((-1 if d is None else d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len({j for i, x in enumerate(three) if n[x] > 1 for j in range(i, i + 3)})))
    assert got == sorted(want)


def test_rules_keep_good_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.op11_quality_rules(spark, SF).join(labels, "doc_id").toPandas()
    good = got[(got.quality == 1) & ~got.base_failed]
    assert len(good) and good.kept.all() and not got[got.base_failed].kept.any()
    assert got[got.quality == 0].kept.mean() < 0.2


def test_policies_on_masks(spark):
    """Each policy on every mask of a few rules, and ablations against a plain count."""
    masks = [0, 1, 2, 3, 16, 32, 32 | 256, 32 | 256 | 512, 64]
    book = spark.createDataFrame([(i, m) for i, m in enumerate(masks * 2)], "doc_id long, failed long")
    keeps = lambda p, m: m & p.always == 0 and bin(m & p.counted).count("1") <= p.forgiven
    for p in quality_rules.POLICIES:
        assert {r.failed for r in book.where(p.keeps(F.col("failed"))).collect()} == {m for m in masks if keeps(p, m)}
    for r in quality_rules.ablations(book).collect():
        p, bit = next(p for p in quality_rules.POLICIES if p.version == r.policy), quality_rules.bits([r.rule])
        less = quality_rules.Policy(p.version, p.always & ~bit, p.counted & ~bit, p.forgiven)
        kept, without = [sum(2 for m in masks if keeps(q, m)) for q in (p, less)]
        assert (r.kept, r.kept_without, r.sole, r.failed) == (kept, without, without - kept, sum(2 for m in masks if m & bit))
    assert {tuple(r)[2:] for r in quality_rules.ablations(book.limit(0)).collect()} == {(0, 0, 0, 0)}


def brute_phrases(rows):
    f = Counter()
    for _, t, lang in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update((lang if lang is not None else "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def brute_collocations(rows, first):
    f = brute_phrases(rows)
    n = Counter()
    for (g, w), c in f.items():
        n[g] += c * (len(w) == 1)
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 10}
    out = {}
    for (g, w), a in cands.items():
        if any(100 * c >= 50 * a for (h, x), c in cands.items() if h == g and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))):
            continue
        s, k = min((10**6 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(g, []).append((-s, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
    return sorted((g, i, p.decode(), -a, left, right, n[g], -s) for g, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:first], 1))


def test_collocations_by_loops(spark, odd, monkeypatch):
    rows = rows_of(odd)
    got = sorted(tuple(r) for r in collocations.collocations(odd, first=20).collect())
    assert got == brute_collocations(rows, 20)
    # several exchanges, many small fragments and shards
    monkeypatch.setattr(collocations, "RANGE", 3000)
    monkeypatch.setattr(collocations, "FAN", 1)
    assert sorted(tuple(r) for r in collocations.collocations(odd, first=20).collect()) == got
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_bitmaps_by_loops(monkeypatch):
    """Bitmaps with dense and sparse words, small batches, and a filter."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d.", "e,f", "ünf"], size)) for size in (0, 1, 2, 3, 500, 40, 4000)]
    langs = rng.integers(0, 2, len(texts))
    want = Counter()
    for t, g in zip(texts, langs):
        want.update({k: c for k, c in brute_phrases([(0, t, int(g))]).items()})
    salts = np.array([collocations._salt("x"), collocations._salt("y")])
    for batch in (1, 300, 1 << 17):
        monkeypatch.setattr(collocations, "BATCH", batch)
        shard = collocations.Shard([t.encode() for t in texts], langs, salts)
        word = [shard.data[a:b].tobytes().decode() for a, b in zip(shard.start, shard.end)]
        got = Counter({(int(shard.lang[i]), (word[i],)): int(shard.n[i]) for i in range(len(word))})
        for w, c in shard.phrases(3):
            got.update({(int(shard.lang[r[0]]), tuple(word[i] for i in r)): int(k) for r, k in zip(w, c)})
        assert got == want
        full = np.full(1 << (collocations.FILTER - 3), 255, np.uint8)
        assert sum(int(c.sum()) for _, c in shard.phrases(3, full)) == sum(c for (_, w), c in want.items() if len(w) == 3)
        assert not sum(int(c.sum()) for _, c in shard.phrases(3, full * 0))


def test_words_of_one_hash_stay_apart():
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    start = np.array([0, 3, 6, 9])
    number, first = collocations._numbered(np.zeros(4, np.uint64), data, start, start + 2, np.array([0, 0, 0, 0]))
    assert number.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]
    number, _ = collocations._numbered(np.zeros(4, np.uint64), data, start, start + 2, np.array([0, 0, 1, 0]))
    assert len(set(number.tolist())) == 4


def test_phrases_of_one_key_stay_apart():
    one = collocations.Counts(np.array([7, 7, 9], np.uint64), np.array([3, 4, 5]), np.array([1, 1, 2]), np.array([0, 0, 0]), np.frombuffer(b"abcx y", np.uint8), np.array([2, 3, 6]), ["en"])
    both = collocations.Counts.joined([collocations.Counts.unpacked(b) for c in (one, one) for _, b in c.fragments(3)]).summed()
    start = both.starts()
    assert sorted((both.data[a:b].tobytes(), int(c)) for a, b, c in zip(start, both.ends, both.counts)) == [(b"ab", 6), (b"c", 8), (b"x y", 10)]


def brute_audit(rows, marks):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    docs = []
    for d, t, g in rows:
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((g or "", {f for f in fails if fails[f]}, marks.get(d, (0, 0))))
    out, shapley = [], Counter()
    for part in {g for g, _, _ in docs}:
        own = [x for x in docs if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2][0] == 1 for x in gone), sum(x[2][1] == 1 for x in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_by_loops(spark, odd):
    """All orders applied one by one to rows with nulls, copies, repeated rows and repeated, null and clashing labels."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    both = labels.union(labels.limit(5)).union(spark.createDataFrame([(5, 1, 1), (None, 1, 1), (6, None, 1)], labels.schema)).withColumn("A", F.lit("own"))
    marks = {}
    for r in both.collect():
        if r.doc_id is not None:
            q, t = marks.get(r.doc_id, (0, 0))
            marks[r.doc_id] = (max(q, r.quality or 0), max(t, r.toxic or 0))
    got = sorted(tuple(r) for r in filter_audit.audit(filter_audit.five(odd, both), filter_audit.NAMES).collect())
    assert got == brute_audit(rows_of(odd), marks)


def test_audit_of_nothing(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert filter_audit.audit(filter_audit.five(odd.limit(0), labels), filter_audit.NAMES).count() == 0
    assert quality_rules.ledger(odd.limit(0)).count() == 0
    one = filter_audit.audit(filter_audit.five(odd.where("doc_id = 2 AND text = ''"), labels.limit(0)), filter_audit.NAMES)
    assert one.count() == 600 and one.agg(F.sum("good_lost")).first()[0] == 0
