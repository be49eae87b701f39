import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.config import Options, window_params
from tidemill.functions import sequence as S
from tidemill.operators.vectorize import compose, dimensions, number_points, vectorize, windows


def rows(s):
    return [list(map(int, line.split())) for line in s.strip().splitlines()]


@pytest.mark.parametrize("k,n", [(2, 10), (3, 32), (4, 136)])
def test_dimensions(spark, k, n):
    got = S.kmer_dimensions(spark, k).collect()
    assert len(got) == 4**k and len({r.canonical for r in got}) == n == dimensions(k)[1]
    dim, _ = dimensions(k)
    assert [dim[i] for i in range(4**k)] == [r.dim for r in sorted(got, key=lambda r: r.kmer)]


def test_columns_of_pairs(spark):
    got = S.kmer_dimensions(spark, 2).select("canonical", "dim").distinct().orderBy("dim").collect()
    assert [r.canonical for r in got] == "AA AC AG AT CA CC CG GA GC TA".split()


def test_raw_counts():
    assert compose("CTGGA", 2, 5, 1)[2].tolist() == rows("0 0 1 0 1 1 0 1 0 0")
    assert compose("CGCGGCATTTACCTGACAGCGACGTAGTCT", 2, 8, 5)[2].tolist() == rows("""
        0 0 0 1 1 1 2 0 2 0
        2 1 0 1 1 1 0 0 0 1
        0 2 1 0 2 1 0 1 0 0
        0 2 1 0 1 0 1 1 1 0
        0 3 1 0 0 0 1 1 0 1""")
    assert compose("CGCGGCATTTACCTGACAGCGACGTAGTCT", 3, 15, 15)[2].shape == (2, 32)
    got = compose("GTGCGAGCTGAACGGGCAATGCAGGAAGAGTTCTACCTGGAACTGAAAGAA", 4, 10, 5)[2]
    assert got.shape == (9, 136) and (got.sum(1) == 7).all()


def test_normalised(spark):
    df = spark.createDataFrame([(1, "CTGAACGG")], "id int, seq string")
    got = [r.vec for r in vectorize(df, 2, 5, 2).orderBy("win").collect()]
    assert got == [[0.25, 0, 0.25, 0, 0.25, 0, 0, 0.25, 0, 0], [0.25, 0.25, 0, 0, 0, 0, 0.25, 0.25, 0, 0]]


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTNacgt", max_size=60), st.integers(1, 20), st.integers(1, 9), st.integers(1, 4))
def test_counts_by_brute_force(seq, width, step, k):
    seq = seq.upper()
    dim, d = dimensions(k)
    starts, ends, got = compose(seq, k, width, step)
    n = (len(seq) - width) // step + 1 if len(seq) >= width else 1
    assert len(got) == n
    for i in range(n):
        own = seq[i * step : min(len(seq), i * step + width)]
        want = np.zeros(d, int)
        for p in range(len(own) - k + 1):
            word = own[p : p + k]
            if set(word) <= set("ACGT"):
                want[dim[int("".join(str("ACGT".index(c)) for c in word), 4)]] += 1
        assert got[i].tolist() == want.tolist()
    turned = compose(seq[::-1].translate(str.maketrans("ACGT", "TGCA")), k, max(len(seq), 1), 1)[2]
    assert turned.tolist() == compose(seq, k, max(len(seq), 1), 1)[2].tolist()


def test_windows_and_points(spark):
    df = spark.createDataFrame([(2, "A" * 25), (1, "A" * 4), (3, "")], "id int, seq string")
    got = number_points(windows(df, 10, 5), "id", "win").orderBy("pid").collect()
    assert [(r.id, r.win_from, r.win_to, r.pid) for r in got] == [(1, 0, 4, 0), (2, 0, 10, 1), (2, 5, 15, 2), (2, 10, 20, 3), (2, 15, 25, 4), (3, 0, 0, 5)]


def test_scalars(spark):
    df = spark.createDataFrame([("acgtnRßX-",), ("",), (None,)], "s string")
    got = df.select(S.to_dna5(F.col("s")).alias("d"), S.gc_fraction(F.col("s")).alias("g")).collect()
    assert [r.d for r in got] == ["ACGTNNNNN", "", None] and [r.g for r in got] == [pytest.approx(2 / 9), None, None]
    assert window_params(10_001, 1000) == (22, 11) and window_params(5, 1000, 10) == (10, 5) and window_params(5000, 1000, 0, 3) == (10, 5)
    with pytest.raises(ValueError):
        window_params(1000, 1000)
    assert Options(min_length=5, subsamples=0).checked().min_length == 100
    with pytest.raises(ValueError):
        Options(tsne_dim=1).checked()
