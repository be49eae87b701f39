"""Samples side by side, numbering at size, files and the command line."""

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill import __main__ as command
from tidemill import session
from tidemill.functions import sequence as S
from tidemill.operators import modality, overlap, stats, taxonomy
from tidemill.operators.vectorize import number_points, number_within, windows
from tidemill.plans import screen
from tidemill.sources import readers, writers

# A sample of one mode whose dip is published with it, 0.0203084.
ONE_MODE = """
    0.3501 -0.29131 0.18608 0.5766 0.33966 -0.67283 -0.53701 -1.0402 0.99728 -0.026054 -0.657 0.67775 -0.51083 0.446 1.5166 0.93776 -0.16016 -0.11384 1.9371 -0.1708
    0.30117 0.32599 0.92484 0.21529 0.36625 0.32215 2.689 0.87607 -0.87649 -1.2174 -1.6148 1.8401 -0.81893 0.99214 0.53382 -1.5267 2.0229 0.5523 1.8201 0.34264
    0.17956 -1.0193 0.037599 0.13712 -1.5211 -0.018918 0.16325 -0.72115 0.4106 -1.2126 -0.57374 0.10539 -0.6051 0.42179 -0.36281 -0.87412 0.93159 0.60004 0.57136 0.68511
    1.0094 0.99087 0.033691 -0.45027 -0.11066 1.2379 -1.1979 -0.56439 1.0433 0.846 -0.49554 -0.20682 -0.1558 -0.2754 -2.4432 -0.42732 0.30906 2.4516 -1.4626 -0.63554
    -0.38547 -0.94228 -0.67377 -1.9242 -0.11242 -0.51851 0.53498 0.057408 1.0658 1.6207 0.12185 -1.238 0.24413 1.3983 -0.095473 0.38762 -0.96631 1.5092 0.40383 -0.42214
    -1.674 -0.68763 -1.0272 -0.49256 0.34681 0.82935 0.15563 0.083714 0.37462 2.6532 0.33271 0.14077 1.5778 0.089548 -0.67298 0.93189 -0.35789 0.2021 0.87625 0.80795
    -1.6033 -2.3621 -0.7017 1.6519 0.23507 -0.15175 -0.15589 1.0382 0.33048 0.47581 -2.0905 -0.17403 0.019188 -0.86003 -0.022949 -0.60232 0.8699 -0.57081 1.3047 -0.042644
    0.89553 2.2849 0.066827 1.4946 -1.0725 1.8233 -1.2084 -0.065392 -0.32684 -1.1492 -1.308 0.64638 -1.3892 -1.3407 1.1289 0.0016961 0.37968 -0.90133 -0.19679 0.30694
    0.16746 1.7881 -0.62408 -0.14996 0.83222 0.94809 -1.9737 -0.39188 -0.67671 -0.016021 0.51517 0.44483 1.1409 0.44768 0.31544 0.94559 0.42866 -1.3246 0.10982 -1.6547
    1.1107 -2.1079 -0.54984 0.094261 -0.03822 1.8829 0.055461 -0.61389 0.58702 -1.2067 0.54533 0.25093 -0.39275 -0.62204 -1.1905 -1.8785 -0.42401 0.77724 -0.71393 1.5846
"""


def test_golden_dip():
    x = np.array(ONE_MODE.split(), float)
    d = modality.dip(x)
    assert len(x) == 200 and abs(d - 0.0203084) < 1e-7 and modality.p_value(d, 200) > 0.01


@pytest.mark.parametrize("parts", [8, 64, 200])
def test_numbers_are_dense(spark, tmp_path, parts):
    """0 to n - 1 without gap or repeat, in order, when written and read."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 1_500_000
        points = spark.range(n).select(F.xxhash64("id").alias("key"), F.lit("x").alias("at"), F.lit(1).alias("part"))
        number_points(points, "key").write.parquet(str(tmp_path / "out"))
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.columns == ["key", "at", "part", "pid"]
        assert got.agg(F.count("pid"), F.countDistinct("pid"), F.min("pid"), F.max("pid")).first() == (n, n, 0, n - 1)
        ends = got.groupBy(F.floor(F.col("pid") / 10_000).alias("g")).agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("g").collect()
        assert all(x.b <= y.a for x, y in zip(ends, ends[1:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_key_is_numbered_by_many(spark):
    rows = spark.range(5000).select(F.lit(1).alias("contig"), (F.col("id") * 7 % 5000).alias("win"))
    got = number_points(rows, "contig", "win")
    assert got.where("win <> pid").count() == 0 and got.count() == 5000
    assert number_points(rows.limit(0), "contig").count() == 0


def test_windows_keep_their_columns(spark):
    df = spark.createDataFrame([("x", "ACGTACGT")], "_n string, seq string")
    assert windows(df, 4, 2).first().asDict() == {"_n": "x", "win": 0, "win_from": 0, "win_to": 4}


def test_samples_are_annotated_by_themselves(spark):
    one = [("one", "o1", "1", 100, "x"), ("one", "o2", "2", 300, None)]
    mix = [("mix", "m1", "1", 50, "x"), ("mix", "m2", "1", 50, "good"), ("mix", "m3", "2", 70, None)]
    schema = "sample string, contig string, label string, len long, taxonomy string"
    both = taxonomy.annotate(spark.createDataFrame(one + mix, schema), "good", "sample").select("sample", "contig", "taxonomy", "confidence", "state", "estimated")
    alone = [r for rows in (one, mix) for r in taxonomy.annotate(spark.createDataFrame(rows, schema), "good").select("sample", "contig", "taxonomy", "confidence", "state", "estimated").collect()]
    assert sorted(both.collect()) == sorted(alone)
    state = {r.contig: (r.state, r.confidence) for r in both.collect()}
    assert state["o1"] == ("contamination", 1.0) and state["o2"][0] == "NA" and state["m3"][0] == "contamination"
    own = spark.createDataFrame([(*r, "h", "t") for r in mix], schema + ", here string, top string")
    got = taxonomy.annotate(own, "good")
    assert {r.here + r.top for r in got.collect()} == {"ht"}
    assert sorted(tuple(r) for r in taxonomy.flow(spark.createDataFrame(mix, schema), "sample").collect()) == [("mix", "1", "good", 50), ("mix", "1", "x", 50), ("mix", "2", "unknown", 70)]
    states = taxonomy.cluster_states(both.join(spark.createDataFrame(one + mix, schema).select("contig", "label"), "contig"), "sample").collect()
    assert {(r["sample"], r.label): r.state for r in states}["one", "1"] == "contamination"


@pytest.mark.parametrize("reference, part, index, want", [
    ([3, 3, 1, 0], [7, 7, 2, 5], [0, 1, 2, 3], [3, 3, 1, 0]),  # each takes the name at its first place
    ([3, 3, 1, 0], [7, 2, 2, 5], [0, 1, 2, 3], [3, 4, 4, 0]),  # 2 comes too late for 3 and gets the first free name
    ([1, 1, 1, 1], [9, 8, 7, 9], [0, 1, 2, 3], [1, 2, 3, 1]),  # fresh names in turn
    ([5, 0, 2], [4, 4], [2, 0], [2, 2]),  # names come from the rows that the part holds
    ([0, 1], [], [], []),
])
def test_labels_are_aligned_by_hand(reference, part, index, want):
    assert stats.align_labels(np.array(reference), np.array(part, int), np.array(index, int)).tolist() == want


def test_aligned_labels_are_new_names_of_the_same_classes():
    rng = np.random.default_rng(2)
    for _ in range(50):
        reference, part = rng.integers(0, 5, 40), rng.integers(0, 7, 25)
        index = np.sort(rng.choice(40, 25, replace=False))
        got = stats.align_labels(reference, part, index)
        assert ((got[:, None] == got) == (part[:, None] == part)).all()
        fresh = np.unique(got[got > reference.max()])
        assert fresh.tolist() == list(range(reference.max() + 1, reference.max() + 1 + len(fresh)))
        for label in np.unique(got[got <= reference.max()]):
            assert reference[index[np.flatnonzero(got == label)[0]]] == label
        assert set(np.unique(got)) >= {reference[index[np.flatnonzero(part == part[0])[0]]]}


def test_correlations_from_covariances():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = x @ rng.normal(size=(4, 3)) + rng.normal(size=(300, 3))
    cov = np.cov(np.concatenate((x, y), 1).T, bias=True)
    assert stats.canonical_of(cov, 4) == pytest.approx(stats.canonical_correlation(x, y)[2], abs=1e-9)


def test_four_digits(spark):
    x = [548.65, 524.65, 484.45, -108.55, 0.00015, 99995.0, 0.0, 1.0, -0.5, 1 / 3, 123.456, 9999.6, 12345.678, 0.00012346, 0.000012346, -1.0, 2e10, 100.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(S.significant(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [f"{v:.4g}" for v in x]


def test_more_files(spark, tmp_path):
    (tmp_path / "a.embl").write_text("ID   X1; SV 1; linear\nDE   d\nSQ   Sequence 8 BP;\n     acgt nn        6\n     gt            8\n//\nID   X2; SV 1\nSQ   Sequence\n     tt   2\n//\n")
    assert [tuple(r) for r in readers.read_embl(spark, str(tmp_path / "a.embl")).collect()] == [("X1", "acgtnngt"), ("X2", "tt")]
    (tmp_path / "a.gb").write_text("LOCUS       G1   8 bp DNA\nDEFINITION  x\nORIGIN\n        1 acgtac gt\n//\nLOCUS       G2 2 bp\nORIGIN      \n        1 cc\n//\n")
    assert [tuple(r) for r in readers.read_genbank(spark, str(tmp_path / "a.gb")).collect()] == [("G1", "acgtacgt"), ("G2", "cc")]
    (tmp_path / "r.txt").write_text("ACGT\nAC GT\n")
    assert [tuple(r) for r in readers.read_raw(spark, str(tmp_path / "r.txt")).collect()] == [("r.txt", "ACGTACGT")]
    assert readers.absolute_path(spark, "x/y").startswith("file:/") and readers.absolute_path(spark, "x/y").endswith("/x/y")
    df = spark.createDataFrame([("a", "ACGT"), ("b", "GG"), ("c", "T")], "id string, seq string")
    writers.write_chosen(df, spark.createDataFrame([("a",), ("c",), ("a",), ("z",)], "id string"), str(tmp_path / "out"))
    assert sorted((r.id, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "out")).collect()) == [("a", "ACGT"), ("c", "T")]
    for _ in range(2):
        writers.write_per_sample(spark.createDataFrame([("s", 1), ("t", 2)], "sample string, n int"), str(tmp_path / "per"))
    assert spark.read.json(str(tmp_path / "per")).count() == 4
    hits = spark.createDataFrame([(7, "a", 2, 3)], "hit_id long, contig string, start int, end int")
    assert [tuple(r) for r in screen.of_hit(df, hits, 7).collect()] == [("a", "CG")]


class Session:
    """A session as far as the shared folder asks it."""

    def __init__(self, master, folder=None):
        own = {"spark.checkpoint.dir": folder} if folder else {}
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: own.get(key, default)})()
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: type("Own", (), {"get": lambda _, key: None})()})()


def test_folders():
    assert session.shared_dir(Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_dir(Session("local[4]")).startswith("file://") and session.shared_dir(Session("local")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="share"):
            session.shared_dir(Session(master))


def test_options():
    args, unknown = command.parser().parse_known_args("-i a.fa -i b.fa -k 3 -vv --target-taxonomy x.* --other 1".split())
    assert args.input_fasta == ["a.fa", "b.fa"] and args.kmer == 3 and args.verbose == 2 and args.target_taxonomy == "x.*" and unknown == ["--other", "1"]
    assert [command.level(v, False) for v in (0, 1, 2, 3)] == [logging.WARNING, logging.INFO, logging.DEBUG, logging.DEBUG] and command.level(2, True) > logging.CRITICAL


def test_a_run(spark, tmp_path, monkeypatch):
    """Two files and one that isn't there: report, tables and classes; a sample that fails doesn't stop the other."""
    rng = np.random.default_rng(8)
    for name, p in (("a", [0.1, 0.4, 0.4, 0.1]), ("b", [0.3, 0.2, 0.2, 0.3])):
        (tmp_path / f"{name}.fa").write_text("".join(f">{name}{i}\n{''.join(rng.choice(list('ACGT'), 2500, p=p))}\n" for i in range(8)) + ">short\nACGT\n")
    (tmp_path / "tax").write_text("a0\tGood\nb1\tBad\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa\n{tmp_path}/none.fa\n")
    words = f"-i {tmp_path}/not-read.fa -I {tmp_path}/list -x {tmp_path}/tax -o {tmp_path}/out -k 2 -n 80 -b 2 --tsne-iterations 20 --null-samples 20 -X good -R 4".split()
    report = {r["sample"].split("/")[-1]: r for r in command.run(spark, command.parser().parse_args(words)).collect()}
    assert set(report) == {"a.fa", "b.fa"} and report["a.fa"].n == 8 and report["a.fa"].parameters.kmer == "2"
    own = report["a.fa"]
    assert {(c.method, c.k) for c in own.clusterings if c.method != "cc"} == {(m, k) for m in ("validity_sne", "validity_pca") for k in range(1, 6)}
    assert sum(c.likely for c in own.clusterings) == 3 and "points" not in own
    taxa = spark.read.json(f"{tmp_path}/out/taxonomies").where("sample like '%/a.fa'").collect()
    assert {r.asDict().get("identifier") for r in taxa} <= {"good", None} and len(taxa) == 8 and own.flow
    points = spark.read.json(f"{tmp_path}/out/points").where("sample like '%/a.fa'").count()
    assert points and all(len(c.labels) == points for c in own.clusterings)
    assert spark.read.json(f"{tmp_path}/out/contigs").count() == 18
    assert spark.read.json(f"{tmp_path}/out/scatter").count() == spark.read.json(f"{tmp_path}/out/points").count()
    assert "clean" in {p.name.removeprefix("class=") for p in (tmp_path / "out/classes").iterdir()}
    contigs = readers.read_fasta(spark, f"{tmp_path}/a.fa").select(F.lit("s").alias("sample"), F.monotonically_increasing_id().alias("contig_idx"), "id", "seq")
    found = screen.screen(contigs, screen.Options(kmer=2, target_points=80, subsamples=2, tsne_iterations=5, null_samples=10))
    label = found["points"].first().label
    assert 0 < screen.of_cluster(contigs, found, "s", label).count() <= 8

    def broken(*a, **k):
        raise RuntimeError("odd data")

    monkeypatch.setattr(screen.embed, "tsne", broken)
    import pandas as pd
    row = screen._test(screen.Options(), pd.DataFrame({"sample": "s", "bs_id": 0, "pid": range(5), "contig_idx": 0, "size": 9, "vec": list(np.eye(5))})).iloc[0]
    assert row.error == "RuntimeError: odd data" and json.dumps(row["sample"]) == '"s"'


def test_a_bad_file_stops_no_other(spark, tmp_path):
    """Of four files one has other letters and one is a broken archive: two are screened, four reported."""
    import gzip
    rng = np.random.default_rng(8)
    def fasta(letters="ACGT"):
        return "".join(f">c{i}\n{''.join(rng.choice(list(letters), 1500))}\n" for i in range(6))
    for name in ("a", "b"):
        (tmp_path / f"{name}.fa").write_text(fasta())
    (tmp_path / "odd.fa").write_text(fasta() + ">bad\nACGT!!\n")
    (tmp_path / "cut.fa.gz").write_bytes(gzip.compress(fasta("ACGTN").encode())[:700])
    words = " ".join(f"-i {tmp_path}/{x}" for x in ("a.fa", "odd.fa", "cut.fa.gz", "b.fa"))
    args = command.parser().parse_args(f"{words} -o {tmp_path}/out -k 2 -n 60 -b 1 --tsne-iterations 5 --null-samples 5 --strict-alphabet".split())
    report = {r["sample"].split("/")[-1]: r for r in command.run(spark, args).collect()}
    assert set(report) == {"a.fa", "b.fa", "odd.fa", "cut.fa.gz"}
    assert report["odd.fa"].error == "letters outside the alphabet in bad" and report["cut.fa.gz"].error
    assert report["a.fa"].n == report["b.fa"].n == 6 and not report["a.fa"].error


def test_contigs_of_one_id_keep_their_classes(spark):
    contigs = spark.createDataFrame([("s", 0, "x", "AAAA"), ("s", 1, "x", "CCCC"), ("s", 2, "y", "GG"), ("t", 0, "x", "TT")], "sample string, contig_idx long, id string, seq string")
    found = spark.createDataFrame([("s", 0, "x", "1", "clean", 1.0), ("s", 1, "x", "2", "contamination", 1.0)], "sample string, contig_idx long, contig string, label string, state string, confidence double")
    got = sorted((r["sample"], r.seq, r["class"]) for r in screen.decontaminated(contigs, found).collect())
    assert got == [("s", "AAAA", "clean"), ("s", "CCCC", "contamination"), ("s", "GG", "NA"), ("t", "TT", "NA")]
    got = sorted((r.seq, r["class"]) for r in screen.decontaminated(contigs.drop("contig_idx"), found).collect())
    assert got == [("AAAA", "contamination"), ("CCCC", "contamination"), ("GG", "NA"), ("TT", "NA")]


def test_ranks_of_one_key(spark):
    """A key that holds nearly all rows, null keys and ties are ranked by many tasks as by a window."""
    from pyspark.sql import Window

    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, "b").otherwise("a").alias("key"), (F.col("id") * 37 % 1009).alias("x"), "id")
    got = number_within(rows.repartition(8), ["key"], ["x", "id"], "r", "n")
    w = Window.partitionBy("key")
    want = rows.select("*", (F.row_number().over(w.orderBy("x", "id")) - 1).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = rows.repartitionByRange("key", "x", "id").where("key = 'a'").select(F.spark_partition_id().alias("p"))
        assert dealt.distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert number_within(rows.limit(0), ["key"], ["x"]).count() == 0


def test_binned_overlaps(spark):
    """Random, reversed, long and empty intervals meet as in a join of all pairs; many of one contig in seconds."""
    import time
    rng = np.random.default_rng(4)
    points = [(i, f"c{i % 3}", int(a), int(a) + int(w)) for i, (a, w) in enumerate(zip(rng.integers(0, 5000, 300), rng.choice([0, 50, 400, 4000], 300)))]
    hits = [(i, f"c{i % 4}", int(a), int(a) + int(w)) for i, (a, w) in enumerate(zip(rng.integers(0, 5000, 300), rng.choice([-30, 0, 90, 2000], 300)))]
    p = spark.createDataFrame(points, "pid long, contig string, win_from long, win_to long")
    h = spark.createDataFrame(hits, "hit_id long, contig string, start long, end long")
    want = sorted((i, j) for i, c, f, t in points for j, d, a, b in hits if c == d and (a <= f <= b or a <= t <= b or (a >= f and b <= t)))
    assert sorted((r.pid, r.hit_id) for r in overlap.touching(p, h).collect()) == want
    assert overlap.first_hits(p.limit(0), h).count() == 0 == overlap.first_hits(p, h.limit(0)).count()
    many = spark.range(100_000)
    p = many.select(F.col("id").alias("pid"), F.lit("c").alias("contig"), (F.col("id") * 250).alias("win_from"), (F.col("id") * 250 + 500).alias("win_to"))
    h = many.select(F.col("id").alias("hit_id"), F.lit("c").alias("contig"), (F.col("id") * 7919 % 25_000_000).alias("start"), (F.col("id") * 7919 % 25_000_000 + 120).alias("end"))
    began = time.time()
    assert overlap.first_hits(p, h).count() > 50_000 and time.time() - began < 60
