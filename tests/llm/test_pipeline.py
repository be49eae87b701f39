import corpus_pipeline
from test_duplicates import brute_components, brute_cuts, words

from tidemill.llm import common, tokens

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [sorted((r.doc_id, r.text) for r in docs.collect())]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            kept.append(sorted((r.doc_id, r.text) for r in docs.collect()))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {d for d, _ in kept[1]}
    assert sum((d in left) == (quality[d] == 1) for d, _ in kept[0] if d in quality) >= 0.97 * len(quality)

    cut = brute_cuts(kept[1])
    lines = {(d, t): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut.get((d, t), ())) for d, t in kept[1]}
    assert kept[2] == sorted((d, x) for (d, t), x in lines.items() if x.strip() or not cut.get((d, t)))

    first = {d for (d, _, c) in brute_components(kept[2]) if d == c}
    assert kept[3] == [r for r in kept[2] if r[0] in first]

    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {d: b" ".join(words(t)) for d, t in kept[3]}
    whole = {d for d, t in text.items() if any(b" ".join(i) in t for i in items)}
    gone = {d for d, _ in kept[3]} - {d for d, _ in kept[4]}
    shared = {d for d, t in kept[3] if any({tuple(w[k : k + 5]) for k in range(len(w) - 4)} & {tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items for w in [words(t)])}
    assert whole <= gone <= shared and whole

    enc = tokens.encoder(tokens.default_tokenizer())
    n = {d: len(x) + 1 for (d, _), x in zip(kept[4], enc.encode([t for _, t in kept[4]]))}
    packed = docs.toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == n
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and packed.sequence_id.nunique() == -(-sum(n.values()) // 2048)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows and further columns pass all stages."""
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (None, "a b c d e f", None, None, 11)], docs.schema)
    from pyspark.sql import functions as F

    both = docs.union(docs.limit(3)).union(odd).withColumns({c: F.lit("own") for c in ("component_id", "key", "score", "removed", "cut_doc", "cut_lines", "said", "deal_", "th", "open")})
    both.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 2048


def small(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    spark.read.parquet(f"{SF}/documents.parquet").limit(60).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_results_outlive_later_runs(spark, tmp_path):
    """A result is read again after another run, and after a stage that failed; what nobody reads goes."""
    import os

    sf = small(spark, tmp_path)
    first = corpus_pipeline.run(spark, sf)
    rows = sorted(first.collect())
    second = corpus_pipeline.run(spark, sf)
    assert len(second.collect()) == len(rows)
    assert sorted(first.collect()) == rows
    try:
        corpus_pipeline.STAGES[1][1](spark, spark.range(3), sf)
    except Exception:
        pass
    assert sorted(first.where("length > 0").collect()) == rows
    derived = first.selectExpr("doc_id")  # reads what first does
    del first
    common.sweep(spark)
    assert derived.count() == len(rows)
    folder = common.shared_dir(spark).removeprefix("file://")
    before = len(os.listdir(folder))
    del derived, second
    for _ in range(3):
        common.sweep(spark)
    assert len(os.listdir(folder)) < before


def test_chained_stages_and_threads(spark, tmp_path):
    """Stages that read each other's lazy results, and two runs at once, give the rows of one run."""
    from concurrent.futures import ThreadPoolExecutor

    sf = small(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    rows = key(docs)
    with ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda _: corpus_pipeline.run(spark, sf), range(2)))
        assert all(got == rows for got in pool.map(key, runs))
