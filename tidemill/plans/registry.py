"""Queries of the screening operators over the driver's tables, and the SQL that must give the same rows.

Documents stand for contigs, their source for a cluster's contig, lang for a label or a taxonomy;
embeddings for points, label for their cluster. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill import session
from tidemill.config import Options, window_params
from tidemill.functions import sequence as S
from tidemill.operators import cluster, distance, embed, graph, modality, overlap, spread_embed, stats, taxonomy, ward
from tidemill.operators.vectorize import kmer_totals, number_points, vectorize, windows
from tidemill.plans import screen as plan
from tidemill.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
def _query(name: str, sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.ship(spark)
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(c: Column | str) -> Column:
    """Rounded; a negative zero becomes zero."""
    return F.round(c, 6) + F.lit(0.0)


def contigs(t) -> DataFrame:
    return t("documents").where("text is not null").select("doc_id", S.to_dna5(F.col("text")).alias("seq"))


def points(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("pid"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


_SEQ = "upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g'))"
_C = f"WITH c AS (SELECT doc_id, {_SEQ} AS seq FROM documents WHERE text IS NOT NULL)"
_P = "WITH p AS (SELECT vec_id AS pid, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))))"
_DIM = "x AS (SELECT pid, label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM p)"

# --- projections, filters, scalar functions


@_query("o12_alphabet", f"{_C} SELECT doc_id, md5(seq) AS digest FROM c")
def _(t):
    return contigs(t).select("doc_id", F.md5("seq").alias("digest"))


@_query("o13_min_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS len FROM documents WHERE length(text) >= 100")
def _(t):
    return t("documents").where(F.length("text") >= Options().checked().min_length).select("doc_id", F.length("text").cast("long").alias("len"))


@_query("o14_split", f"{_C} SELECT doc_id, length(seq) >= 500 AS included FROM c")
def _(t):
    return plan.contig_stats(contigs(t), 500).select("doc_id", "included")


@_query("o15_gc_per_contig", f"{_C} SELECT doc_id, CAST(length(seq) AS BIGINT) AS len, round(CAST(length(regexp_replace(seq,'[^CG]','','g')) AS DOUBLE) / length(seq), 6) AS gc FROM c WHERE length(seq) >= 100")
def _(t):
    return plan.contig_stats(contigs(t), 100).where("included").select("doc_id", "len", _r("gc").alias("gc"))


@_query("o16_revcomp", f"{_C} SELECT doc_id, md5(translate(reverse(seq),'ACGT','TGCA')) AS digest FROM c")
def _(t):
    return contigs(t).select("doc_id", F.md5(S.reverse_complement(F.col("seq"))).alias("digest"))


_KMERS = "b(x) AS (VALUES ('A'),('C'),('G'),('T'))"
_COUNTED = "n AS (SELECT kmer, count(*) AS n FROM (SELECT substr(seq, CAST(i AS BIGINT), {k}) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM c)) WHERE kmer NOT LIKE '%N%' GROUP BY kmer)"


@_query("o17_all_kmers", f"{_C}, {_KMERS}, {_COUNTED.format(k=3)} SELECT kmer, coalesce(n, 0) AS n FROM (SELECT a.x || e.x || d.x AS kmer FROM b a, b e, b d) LEFT JOIN n USING (kmer)")
def _(t):
    """All words of three letters and how often the documents hold each."""
    return kmer_totals(contigs(t), 3)


@_query("o18_canonical_dict", f"{_C}, {_KMERS}, {_COUNTED.format(k=4)}, k AS (SELECT a.x||f.x||d.x||e.x AS kmer FROM b a, b f, b d, b e), l AS (SELECT kmer, least(kmer, translate(reverse(kmer),'ACGT','TGCA')) AS canonical FROM k) SELECT kmer, canonical, CAST(dense_rank() OVER (ORDER BY canonical) - 1 AS INT) AS dim, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY canonical) AS BIGINT) AS n FROM l LEFT JOIN n USING (kmer)")
def _(t):
    """The canonical dictionary with the documents' counts of both strands."""
    seen = kmer_totals(contigs(t), 4)
    words = S.kmer_dimensions(seen.sparkSession, 4).join(seen, "kmer")
    both = words.groupBy("canonical").agg(F.sum("n").alias("n"))
    return words.drop("n").join(both, "canonical").select("kmer", "canonical", F.col("dim").cast("int").alias("dim"), "n")


@_query("o19_window_params", "WITH s AS (SELECT sum(length(text)) AS bp FROM documents WHERE length(text) >= 100) SELECT CAST(bp AS BIGINT) AS total_bp, CAST(2 * ceil(bp / 1000.0) AS BIGINT) AS width, CAST(ceil(bp / 1000.0) AS BIGINT) AS step FROM s")
def _(t):
    total = t("documents").where(F.length("text") >= 100).agg(F.sum(F.length("text"))).first()[0]
    width, step = window_params(total, 1000)
    return t("region").sparkSession.createDataFrame([(total, width, step)], "total_bp long, width long, step long")


@_query("o21_fixed", "SELECT c_custkey, printf('%.4g', c_acctbal / 7) AS share FROM customer")
def _(t):
    return t("customer").select("c_custkey", S.significant(F.col("c_acctbal") / 7).alias("share"))


@_query("o23_regex_state", "SELECT c_custkey, regexp_full_match(lower(c_mktsegment), 'auto.*|build.*') AS clean FROM customer")
def _(t):
    return t("customer").select("c_custkey", S.regex_is(F.col("c_mktsegment"), "auto.*|build.*").alias("clean"))


_LINES = "SELECT c_custkey, concat_ws(';', 'root', 'cells', r_name, n_name, c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ';f;g;h;sp' || CAST(c_custkey % 50 AS VARCHAR) END AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_LIN = f"WITH l AS ({_LINES}), s AS (SELECT c_custkey, string_split(lineage, ';') AS f FROM l)"


def _lineages(t) -> DataFrame:
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tail = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(";f;g;h;sp"), (F.col("c_custkey") % 50).cast("string")))
    return rows.select("c_custkey", F.concat(F.concat_ws(";", F.lit("root"), F.lit("cells"), "r_name", "n_name", "c_mktsegment"), tail).alias("lineage")).select("c_custkey", *readers.lineage_fields())


@_query("o24_lineage_split", f"{_LIN} SELECT c_custkey, coalesce(f[3],'unknown') AS domain, coalesce(f[9],'unknown') AS species FROM s")
def _(t):
    return _lineages(t)


@_query("o25_substring", f"{_C} SELECT doc_id, substr(seq, CAST(doc_id % 50 + 1 AS BIGINT), 20) AS hit, substr(seq, CAST(doc_id % 50 + 2 AS BIGINT), 19) AS compat FROM c")
def _(t):
    start = (F.col("doc_id") % 50 + 1).cast("int")
    return contigs(t).select("doc_id", overlap.hit_text(F.col("seq"), start, start + 19).alias("hit"), overlap.hit_text(F.col("seq"), start, start + 19, compat=True).alias("compat"))


@_query("o27_perplexity", "SELECT source, CAST(floor(pow(ln(count(*)), 2)) AS BIGINT) AS perplexity FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", S.perplexity(F.col("n")).alias("perplexity"))


@_query("o28_column", f"{_P} SELECT pid, round(v[4], 6) AS x FROM p")
def _(t):
    return points(t).select("pid", _r(F.col("vec")[3]).alias("x"))


@_query("o29_without", f"{_P} SELECT pid, CAST(len(v) - 1 AS INT) AS width, round(list_sum(v) - v[6], 6) AS total FROM p WHERE pid <> 7")
def _(t):
    rest = F.filter("vec", lambda x, i: i != 5)
    return points(t).where("pid <> 7").select("pid", F.size(rest).alias("width"), _r(F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)).alias("total"))


# --- windows and compositions

_W, _STEP = 400, 200
_WIN = f"{_C}, w AS (SELECT doc_id, i, i*{_STEP} AS a, least(length(seq), i*{_STEP}+{_W}) AS b, substr(seq, i*{_STEP}+1, {_W}) AS s FROM (SELECT doc_id, seq, unnest(range(CASE WHEN length(seq) >= {_W} THEN (length(seq)-{_W})//{_STEP}+1 ELSE 1 END)) AS i FROM c))"
_KM = f"{_WIN}, m AS (SELECT doc_id, i, least(k, translate(reverse(k),'ACGT','TGCA')) AS kmer FROM (SELECT doc_id, i, substr(s, q, 2) AS k FROM (SELECT doc_id, i, s, unnest(range(1, length(s))) AS q FROM w)) WHERE regexp_full_match(k, '[ACGT][ACGT]'))"


@_query("o31_windows", f"{_WIN} SELECT doc_id, CAST(i AS INT) AS win, CAST(a AS INT) AS win_from, CAST(b AS INT) AS win_to FROM w")
def _(t):
    return windows(contigs(t), _W, _STEP).select("doc_id", "win", "win_from", F.col("win_to").cast("int").alias("win_to"))


def _counted(t, normalize: bool) -> DataFrame:
    long = vectorize(contigs(t), 2, _W, _STEP, normalize).select("doc_id", "win", F.posexplode("vec").alias("dim", "x"))
    names = F.broadcast(S.kmer_dimensions(t("region").sparkSession, 2).select("dim", F.col("canonical").alias("kmer")).distinct())
    return long.join(names, "dim")


@_query("o34_kmer_counts", f"{_KM} SELECT doc_id, CAST(i AS INT) AS win, kmer, count(*) AS n FROM m GROUP BY ALL")
def _(t):
    return _counted(t, False).where("x > 0").select("doc_id", "win", "kmer", F.col("x").cast("long").alias("n"))


@_query("o20_l1_normalise", f"{_KM}, n AS (SELECT doc_id, i, kmer, count(*) AS n FROM m GROUP BY ALL) SELECT doc_id, CAST(i AS INT) AS win, kmer, round(n / sum(n) OVER (PARTITION BY doc_id, i), 6) AS f FROM n")
def _(t):
    return _counted(t, True).where("x > 0").select("doc_id", "win", "kmer", _r("x").alias("f"))


@_query("o36_dense_vectors", f"{_KM}, d AS (SELECT unnest(['AA','AC','AG','AT','CA','CC','CG','GA','GC','TA']) AS kmer), n AS (SELECT doc_id, i, kmer, count(*) AS n FROM m GROUP BY ALL) SELECT w.doc_id, CAST(w.i AS INT) AS win, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ' ' ORDER BY d.kmer) AS counts FROM w CROSS JOIN d LEFT JOIN n ON n.doc_id = w.doc_id AND n.i = w.i AND n.kmer = d.kmer GROUP BY w.doc_id, w.i")
def _(t):
    return vectorize(contigs(t), 2, _W, _STEP, False).select("doc_id", "win", F.array_join(F.transform("vec", lambda x: x.cast("long").cast("string")), " ").alias("counts"))


@_query("o32_points", f"{_WIN} SELECT doc_id, CAST(i AS INT) AS win, row_number() OVER (ORDER BY doc_id, i) - 1 AS pid FROM w")
def _(t):
    return number_points(windows(contigs(t), _W, _STEP).select("doc_id", "win"), "doc_id", "win").select("doc_id", "win", "pid")


# --- aggregations


@_query("o37_totals", f"{_C} SELECT CAST(sum(length(seq)) AS BIGINT) AS num_basepairs, round(CAST(sum(length(regexp_replace(seq,'[^CG]','','g'))) AS DOUBLE) / sum(length(seq)), 6) AS gc_content FROM c WHERE length(seq) >= 100")
def _(t):
    return plan.sample_stats(contigs(t).withColumn("sample", F.lit("all")), 100).select("num_basepairs", _r("gc_content").alias("gc_content"))


@_query("o38_mean", f"{_P}, {_DIM} SELECT CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean FROM x GROUP BY dim")
def _(t):
    return stats.column_means(points(t)).select("dim", _r("mean").alias("mean"))


@_query("o39_covariance", f"{_P}, {_DIM} SELECT CAST(a.dim AS INT) AS i, CAST(b.dim AS INT) AS j, round(covar_pop(a.x, b.x), 6) + 0 AS cov FROM x a JOIN x b ON a.pid = b.pid AND a.dim <= b.dim GROUP BY a.dim, b.dim")
def _(t):
    _, _, cov = stats.moments(points(t))
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return t("region").sparkSession.createDataFrame(rows, "i int, j int, c double").select("i", "j", _r("c").alias("cov"))


@_query("o40_centroids", f"{_P}, {_DIM} SELECT label, CAST(dim AS INT) AS dim, count(*) AS n, round(avg(x), 6) AS mean FROM x GROUP BY label, dim")
def _(t):
    return cluster.centroids(points(t)).select("label", F.col("n"), F.posexplode("centre").alias("dim", "m")).select("label", "dim", "n", _r("m").alias("mean"))


_CEN = f"{_P}, {_DIM}, m AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY label, dim), c AS (SELECT label, list(m ORDER BY dim) AS v FROM m GROUP BY label), s AS (SELECT a.label, avg({_DIST}) AS s FROM p a JOIN c b ON a.label = b.label GROUP BY a.label)"
_WORST = f"{_CEN}, r AS (SELECT a.label, max((sa.s + sb.s) / {_DIST}) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY a.label)"


@_query("o41_scatter", f"{_CEN} SELECT label, round(s, 6) AS s FROM s")
def _(t):
    p = points(t)
    return cluster.scatter(p, cluster.centroids(p)).select("label", _r("s").alias("s"))


@_query("o42_davies_bouldin", f"{_WORST} SELECT round(avg(r), 6) AS db FROM r")
def _(t):
    return cluster.davies_bouldin(points(t)).select(_r("db").alias("db"))


@_query("o42c_davies_bouldin_compat", f"{_WORST}, w AS (SELECT label, count(*) AS w FROM (SELECT label, lag(label) OVER (ORDER BY pid) AS b FROM p) WHERE b IS NULL OR b <> label GROUP BY label) SELECT round(sum(r * w) / sum(w), 6) AS db FROM r JOIN w USING (label)")
def _(t):
    return cluster.davies_bouldin(points(t), compat=True).select(_r("db").alias("db"))


_LAB = "WITH l AS (SELECT source AS contig, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS label, n_chars AS size, doc_id FROM documents), m AS (SELECT contig, label, row_number() OVER (PARTITION BY contig ORDER BY count(*) DESC, label) AS k FROM l GROUP BY contig, label), v AS (SELECT contig, label FROM m WHERE k = 1)"


def _labels(t) -> DataFrame:
    label = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return t("documents").select(F.col("source").alias("contig"), label.alias("label"), F.col("n_chars").alias("size"), "doc_id")


@_query("o43_majority", f"{_LAB} SELECT contig, label FROM v")
def _(t):
    return cluster.majority_label(_labels(t))


@_query("o44_distinct", f"{_LAB} SELECT count(DISTINCT label) AS n FROM v")
def _(t):
    return cluster.majority_label(_labels(t)).agg(F.countDistinct("label").alias("n"))


@_query("o45_outliers", f"{_LAB}, z AS (SELECT contig, sum(size) AS size FROM l GROUP BY contig) SELECT v.label, CAST(sum(size) AS BIGINT) AS bp, sum(size) < 600000 AS outlier FROM v JOIN z USING (contig) GROUP BY v.label")
def _(t):
    rows = _labels(t)
    return cluster.outlier_clusters(cluster.majority_label(rows), rows.groupBy("contig").agg(F.sum("size").alias("size")), 600_000)


_FLAGS = "WITH f AS (SELECT user_id, value > 50 AS m, event_type IN ('purchase','click') AS s FROM events)"


@_query("o46_summary", f"{_FLAGS}, a AS (SELECT user_id, avg(CAST(s AS INT)) AS cc, avg(CAST(m AS INT)) AS d FROM f GROUP BY user_id) SELECT user_id, round(cc, 6) AS confidence_cc, round(d, 6) AS confidence_dip, CASE WHEN cc < 0.25 AND d < 0.25 THEN 'clean' WHEN cc > 0.75 OR d > 0.75 THEN 'contaminated' ELSE 'warning' END AS state FROM a")
def _(t):
    flags = t("events").select("user_id", (F.col("value") > 50).alias("is_multimodal"), F.col("event_type").isin("purchase", "click").alias("has_separated"))
    return modality.summarize(flags, "user_id").select("user_id", _r("confidence_cc").alias("confidence_cc"), _r("confidence_dip").alias("confidence_dip"), "state")


@_query("o47_background", f"{_LIN} SELECT round(avg(CASE WHEN f[3] = 'ASIA' THEN 1.0 ELSE 0.0 END), 6) AS bacterial_background FROM s")
def _(t):
    return taxonomy.background(_lineages(t).withColumn("domain", F.when(F.col("domain") == "ASIA", "Bacteria").otherwise(F.col("domain")))).select(_r("bacterial_background").alias("bacterial_background"))


_TAX = "t AS (SELECT d.doc_id AS contig, d.source AS label, d.n_chars AS len, CASE WHEN l.quality IS NULL THEN NULL ELSE d.lang END AS taxonomy FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)), z AS (SELECT label, sum(len) AS size FROM t GROUP BY label), f AS (SELECT taxonomy, t.label, sum(len) / max(size) AS f FROM t JOIN z USING (label) WHERE taxonomy IS NOT NULL GROUP BY taxonomy, t.label), g AS (SELECT taxonomy, label, 0.5*f + 0.5*f/sum(f) OVER (PARTITION BY taxonomy) AS confidence, f FROM f)"


def _tax(t) -> DataFrame:
    known = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return t("documents").join(known, "doc_id", "left").select(F.col("doc_id").alias("contig"), F.col("source").alias("label"), F.col("n_chars").alias("len"), F.when(F.col("q").isNotNull(), F.col("lang")).alias("taxonomy"))


@_query("o48_tax_freq", f"WITH {_TAX} SELECT taxonomy, label, round(f, 6) AS f, round(confidence, 6) AS confidence FROM g")
def _(t):
    return taxonomy.frequencies(_tax(t)).select("taxonomy", "label", _r("f").alias("f"), _r("confidence").alias("confidence"))


@_query("o49_first_label", "SELECT source AS contig, min_by(lang, doc_id) AS label FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy(F.col("source").alias("contig")).agg(F.min_by("lang", "doc_id").alias("label"))


@_query("o50_split_share", "WITH g AS (SELECT user_id, avg(CASE WHEN value <= 20 THEN 1.0 ELSE 0.0 END) AS s FROM events GROUP BY user_id) SELECT user_id, s >= 0.1 AS split FROM g")
def _(t):
    return t("events").groupBy("user_id").agg((F.avg(F.when(F.col("value") <= 20, 1.0).otherwise(0.0)) >= 0.1).alias("split"))


@_query("o51_species", f"{_LIN}, u AS (SELECT coalesce(f[9],'unknown') AS s FROM s) SELECT CASE WHEN bool_or(s = 'unknown') THEN '≥' ELSE '' END || CAST(count(DISTINCT s) AS VARCHAR) AS species FROM u")
def _(t):
    return taxonomy.species_summary(_lineages(t))


@_query("o52_ranges", f"{_P}, {_DIM} SELECT CAST(dim AS INT) AS dim, round(min(x), 6) AS low, round(max(x), 6) AS high FROM x GROUP BY dim")
def _(t):
    return points(t).select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(_r(F.min("x")).alias("low"), _r(F.max("x")).alias("high"))


# --- joins


@_query("o53_semi_join", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t("documents").join(t("labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "n_chars")


@_query("o55_by_name", "SELECT c_custkey FROM customer WHERE trim(c_mktsegment) IN (SELECT DISTINCT trim(c_mktsegment) FROM customer WHERE c_custkey < 3)")
def _(t):
    names = t("customer").where("c_custkey < 3").select(F.trim("c_mktsegment").alias("name"))
    return t("customer").join(names, F.trim("c_mktsegment") == F.col("name"), "left_semi").select("c_custkey")


_SLICES = "r AS (SELECT pid, row_number() OVER (ORDER BY md5(CAST(pid AS VARCHAR)), pid) - 1 AS r, count(*) OVER () AS n FROM (SELECT vec_id AS pid FROM embeddings)), q AS (SELECT *, CAST(floor(n * 0.75) AS BIGINT) AS m FROM r), s AS (SELECT pid, r, n, m, (n - m) // 10 AS step, unnest(range(11)) AS bs_id FROM q), k AS (SELECT pid, bs_id FROM s WHERE bs_id = 0 OR (r >= (bs_id-1)*step AND (r < (bs_id-1)*step + m OR bs_id = 10)))"


def _slices(t) -> DataFrame:
    return plan.slices(points(t).select(F.lit("all").alias("sample"), "pid"), 10, 0.75)


@_query("o74_slices", f"WITH {_SLICES} SELECT pid, CAST(bs_id AS INT) AS bs_id FROM k")
def _(t):
    return _slices(t).select("pid", "bs_id")


@_query("o56_gather", f"{_P}, {_SLICES} SELECT CAST(bs_id AS INT) AS bs_id, count(*) AS n, round(avg(v[1]), 6) AS x FROM k JOIN p USING (pid) GROUP BY bs_id")
def _(t):
    return points(t).join(_slices(t), "pid").groupBy("bs_id").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(F.col("vec")[0])).alias("x"))


@_query("o57_pdist", f"{_P} SELECT a.pid AS i, b.pid AS j, round({_DIST}, 6) AS dist FROM p a, p b")
def _(t):
    return distance.pairwise(points(t)).select("i", "j", _r("dist").alias("dist"))


@_query("o58_condensed", f"{_P} SELECT a.pid AS i, b.pid AS j, round({_DIST}, 6) AS dist FROM p a, p b WHERE a.pid < b.pid")
def _(t):
    return distance.pairwise(points(t), upper=True).select("i", "j", _r("dist").alias("dist"))


_KNN = _P + ", d AS (SELECT a.pid AS src, b.pid AS dst, " + _DIST + " AS dist FROM p a, p b WHERE a.pid <> b.pid), e AS (SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS k FROM d) WHERE k <= {k})"
_MUT = _KNN + ", u AS (SELECT a.src, a.dst, least(a.dist, b.dist) AS dist FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.dist > 0)"


@_query("o59_knn", _KNN.format(k=9) + " SELECT src, dst, round(dist, 6) AS dist FROM e")
def _(t):
    return distance.nearest(points(t), 9).select("src", "dst", _r("dist").alias("dist"))


@_query("o60_mutual_knn", _MUT.format(k=9) + " SELECT src, dst, round(dist, 6) AS dist FROM u")
def _(t):
    return distance.mutual(distance.nearest(points(t), 9)).select("src", "dst", _r("dist").alias("dist"))


_HITS = "h AS (SELECT doc_id AS hit_id, doc_id - doc_id % 2 AS contig, 10 + (doc_id * 37) % 900 AS a, 110 + (doc_id * 37) % 900 AS b FROM documents), n AS (SELECT doc_id AS contig, row_number() OVER (ORDER BY doc_id, i) - 1 AS pid, a AS f, b AS g FROM w), m AS (SELECT hit_id, min(pid) AS pid FROM h JOIN n USING (contig) WHERE f BETWEEN h.a AND h.b OR g BETWEEN h.a AND h.b OR (h.a >= f AND h.b <= g) GROUP BY hit_id)"


@_query("o61_overlap", f"{_WIN}, {_HITS} SELECT pid, max(hit_id) AS hit_id FROM m GROUP BY pid")
def _(t):
    start = 10 + (F.col("doc_id") * 37) % 900
    hits = t("documents").select(F.col("doc_id").alias("hit_id"), (F.col("doc_id") - F.col("doc_id") % 2).alias("contig"), start.alias("start"), (start + 100).alias("end"))
    own = number_points(windows(contigs(t), _W, _STEP), "doc_id", "win").withColumnRenamed("doc_id", "contig")
    return overlap.first_hits(own, hits)


@_query("o62_lookup", "WITH i AS (SELECT source, max(doc_id) AS idx FROM documents WHERE doc_id % 20 < 15 GROUP BY source) SELECT doc_id, coalesce(idx, 0) AS idx FROM documents LEFT JOIN i USING (source)")
def _(t):
    index = t("documents").where("doc_id % 20 < 15").groupBy("source").agg(F.max("doc_id").alias("idx"))
    return t("documents").join(index, "source", "left").select("doc_id", F.coalesce("idx", F.lit(0)).alias("idx"))


@_query("o63_left_default", "SELECT d.doc_id, coalesce(CAST(l.q AS VARCHAR), 'unknown') AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id)")
def _(t):
    known = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return t("documents").join(known, "doc_id", "left").select("doc_id", F.coalesce(F.col("q").cast("string"), F.lit("unknown")).alias("quality"))


@_query("o64_last_label", "SELECT source AS contig, max_by(lang, doc_id) AS label, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy(F.col("source").alias("contig")).agg(F.max_by("lang", "doc_id").alias("label"), F.size(F.collect_set("lang")).cast("long").alias("langs"))


@_query("o65_confidence", f"WITH {_TAX} SELECT t.contig, round(coalesce(g.confidence, -1), 6) AS confidence FROM t LEFT JOIN g ON g.taxonomy = t.taxonomy AND g.label = t.label")
def _(t):
    return taxonomy.with_confidence(_tax(t)).select("contig", _r("confidence").alias("confidence"))


_STATE = ", o AS (SELECT contig, label, CASE WHEN taxonomy IS NULL THEN 'NA' WHEN taxonomy = 'es' THEN 'clean' ELSE 'contamination' END AS own FROM t), y AS (SELECT *, bool_or(own = 'clean') OVER (PARTITION BY label) AS here, bool_or(own = 'clean') OVER () AS somewhere FROM o)"


@_query("o66_state_update", f"WITH {_TAX}{_STATE} SELECT contig, CASE WHEN own = 'NA' AND somewhere AND NOT here THEN 'contamination' ELSE own END AS state FROM y")
def _(t):
    return taxonomy.with_state(_tax(t), "es").select("contig", "state")


@_query("o68_outlier_anti", "WITH c AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) < (SELECT avg(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))) SELECT vec_id AS pid, label FROM embeddings WHERE label NOT IN (SELECT label FROM c)")
def _(t):
    n = points(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    small = n.join(F.broadcast(n.agg(F.avg("n").alias("a")))).where("n < a")
    return points(t).join(small, "label", "left_anti").select("pid", "label")


@_query("o71_propagate", f"WITH {_TAX}, b AS (SELECT label, taxonomy AS bt, confidence AS bc, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, taxonomy) AS k FROM g) SELECT t.contig, coalesce(t.taxonomy, bt) AS taxonomy, round(coalesce(g.confidence, bc, -1), 6) AS confidence FROM t LEFT JOIN g ON g.taxonomy = t.taxonomy AND g.label = t.label LEFT JOIN b ON b.label = t.label AND b.k = 1")
def _(t):
    return taxonomy.propagated(taxonomy.with_confidence(_tax(t))).select("contig", "taxonomy", _r("confidence").alias("confidence"))


@_query("o72_top_state", f"WITH {_TAX}, c AS (SELECT t.contig, t.label, t.taxonomy, g.confidence FROM t LEFT JOIN g ON g.taxonomy = t.taxonomy AND g.label = t.label), k AS (SELECT label, taxonomy AS state, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, contig) AS k FROM c WHERE taxonomy IS NOT NULL) SELECT DISTINCT t.label, coalesce(k.state, 'NA') AS state FROM t LEFT JOIN k ON k.label = t.label AND k.k = 1")
def _(t):
    return taxonomy.cluster_states(taxonomy.with_confidence(_tax(t)).withColumn("state", F.col("taxonomy")))


@_query("o75_label_encode", "WITH f AS (SELECT source, min(doc_id) AS d FROM documents GROUP BY source) SELECT doc_id, CAST(dense_rank() OVER (ORDER BY d) - 1 AS INT) AS label FROM documents JOIN f USING (source)")
def _(t):
    first = t("documents").groupBy("source").agg(F.min("doc_id").alias("d")).withColumn("label", (F.dense_rank().over(Window.orderBy("d")) - 1).cast("int"))
    return t("documents").join(first, "source").select("doc_id", "label")


@_query("o76_unique", "SELECT DISTINCT source FROM documents")
def _(t):
    return t("documents").select("source").distinct()


@_query("o77_choice", f"{_FLAGS}, a AS (SELECT user_id, avg(CAST(s AS INT)) AS cc, avg(CAST(m AS INT)) AS d FROM f GROUP BY user_id) SELECT user_id, CASE WHEN cc > d THEN 'cc' ELSE 'validity_sne' END AS method FROM a WHERE NOT (cc < 0.25 AND d < 0.25)")
def _(t):
    flags = t("events").select("user_id", (F.col("value") > 50).alias("is_multimodal"), F.col("event_type").isin("purchase", "click").alias("has_separated"))
    s = modality.summarize(flags, "user_id").where("state <> 'clean'")
    return s.select("user_id", F.when(F.col("confidence_cc") > F.col("confidence_dip"), "cc").otherwise("validity_sne").alias("method"))


@_query("o79d_symmetrise", _KNN.format(k=5) + ", b AS (SELECT src AS i, dst AS j, 1.0 / (1.0 + dist) AS p FROM e) SELECT i, j, round(sum(p) / 2, 6) AS p FROM (SELECT i, j, p FROM b UNION ALL SELECT j, i, p FROM b) GROUP BY i, j")
def _(t):
    e = distance.nearest(points(t), 5).select(F.col("src").alias("i"), F.col("dst").alias("j"), (1.0 / (1.0 + F.col("dist"))).alias("p"))
    return distance.symmetrized(e).select("i", "j", _r("p").alias("p"))


_TWO = "t AS (SELECT d.doc_id AS contig, d.source AS sample, d.lang AS label, d.n_chars AS len, CASE WHEN l.quality IS NULL THEN NULL WHEN d.n_chars % 3 = 0 THEN 'x' ELSE d.lang END AS taxonomy FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)), z AS (SELECT sample, label, sum(len) AS size FROM t GROUP BY ALL), f AS (SELECT sample, taxonomy, t.label, sum(len) / max(size) AS f FROM t JOIN z USING (sample, label) WHERE taxonomy IS NOT NULL GROUP BY ALL), g AS (SELECT *, 0.5 * f + 0.5 * f / sum(f) OVER (PARTITION BY sample, taxonomy) AS confidence FROM f), o AS (SELECT *, CASE WHEN taxonomy IS NULL THEN 'NA' WHEN taxonomy = 'es' THEN 'clean' ELSE 'contamination' END AS own FROM t), y AS (SELECT *, bool_or(own = 'clean') OVER (PARTITION BY sample, label) AS here, bool_or(own = 'clean') OVER (PARTITION BY sample) AS somewhere FROM o)"


@_query("o66_samples", f"WITH {_TWO} SELECT contig, sample, round(coalesce(g.confidence, -1), 6) AS confidence, CASE WHEN own = 'NA' AND somewhere AND NOT here THEN 'contamination' ELSE own END AS state FROM y LEFT JOIN g USING (sample, taxonomy, label)")
def _(t):
    """Confidences and states of several samples at once, each by itself."""
    known = t("labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    tax = F.when(F.col("q").isNull(), None).when(F.col("n_chars") % 3 == 0, "x").otherwise(F.col("lang"))
    rows = t("documents").join(known, "doc_id", "left").select(F.col("doc_id").alias("contig"), F.col("source").alias("sample"), F.col("lang").alias("label"), F.col("n_chars").alias("len"), tax.alias("taxonomy"))
    return taxonomy.with_state(taxonomy.with_confidence(rows, "sample"), "es", "sample").select("contig", "sample", _r("confidence").alias("confidence"), "state")


# --- graph, statistics, whole screens

_COMP = _MUT.format(k=3).replace("WITH p", "WITH RECURSIVE p") + ", reach(a, b) AS (SELECT pid, pid FROM p UNION SELECT r.a, u.dst FROM reach r JOIN u ON u.src = r.b), m AS (SELECT a AS pid, min(b) AS root FROM reach GROUP BY a)"


def _mutual_components(t) -> DataFrame:
    return graph.component_labels(points(t).select("pid"), distance.mutual(distance.nearest(points(t), 3)))


@_query("o86_components", _COMP + " SELECT pid, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS label FROM m")
def _(t):
    return _mutual_components(t).select("pid", F.col("label").cast("int").alias("label"))


@_query("o87_cc_estimator", _COMP + ", l AS (SELECT m.pid, dense_rank() OVER (ORDER BY root) - 1 AS k, p.label AS contig FROM m JOIN p USING (pid)), v AS (SELECT contig, k, row_number() OVER (PARTITION BY contig ORDER BY count(*) DESC, k) AS o FROM l GROUP BY contig, k) SELECT contig, CAST(k AS INT) AS label, (SELECT count(DISTINCT k) FROM v WHERE o = 1) AS clusters FROM v WHERE o = 1")
def _(t):
    own = _mutual_components(t).join(points(t).select("pid", F.col("label").alias("contig")), "pid")
    best = cluster.majority_label(own.select("contig", "label"))
    return best.join(F.broadcast(best.agg(F.countDistinct("label").alias("clusters")))).select("contig", F.col("label").cast("int").alias("label"), "clusters")  # one number


_COV = f"{_P}, {_DIM}, c AS (SELECT a.dim AS i, b.dim AS j, 64 * covar_pop(a.x, b.x) AS c FROM x a JOIN x b ON a.pid = b.pid GROUP BY a.dim, b.dim), s AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY a.i, b.j)"


@_query("o78_pca", f"{_COV} SELECT (SELECT round(sum(c), 4) FROM c WHERE i = j) AS p1, (SELECT round(sum(c), 4) FROM s WHERE i = j) AS p2, (SELECT round(sum(c.c * s.c), 4) FROM c JOIN s USING (i, j)) AS p3, (SELECT round(sum(c * c), 4) FROM s) AS p4, CAST(0 AS DOUBLE) AS aslant")
def _(t):
    """Sums of the axes' variances to the powers 1 to 4, which are the traces of the covariances' powers, and the greatest covariance of two axes."""
    width = len(points(t).first().vec)
    axes = stats.project(points(t), width).select(F.col("pc").alias("vec"))
    _, _, cov = stats.moments(axes)
    v = 64 * np.diag(cov)
    row = [*(float((v**k).sum()) for k in (1, 2, 3, 4)), float(np.abs(cov - np.diag(np.diag(cov))).max())]
    return t("region").sparkSession.createDataFrame([row], "p1 double, p2 double, p3 double, p4 double, aslant double").select(*[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("p1", "p2", "p3", "p4", "aslant")])


@_query("o78_pca_axes")
def _(t):
    width = len(points(t).first().vec)
    return stats.project(points(t), width).select(F.posexplode("pc").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("variance"))


@_query("o80_dip")
def _(t):
    return modality.with_p(modality.spread_dip(t("events"), "event_type", "value")).select("event_type", "dip", "p")


def _sample(t) -> DataFrame:
    return t("documents").where("text is not null").select(F.col("lang").alias("sample"), F.col("doc_id").alias("contig_idx"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("seq"))


#: Text has few k-mers of ACGT alone, so k is 2; all else is the default.
_FULL = Options(kmer=2, seed=1)


@_query("o73_estimate_k")
def _(t):
    return plan.screen(_sample(t), _FULL)["samples"].select("sample", "ward_k", "ward_clusters")


@_query("screen_e2e")
def _(t):
    return plan.screen(_sample(t), _FULL)["samples"].drop("outliers", "clusterings")


@_query("screen_annotated")
def _(t):
    tax = t("documents").join(t("labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").cast("string").alias("contig"), F.col("source").alias("taxonomy"))
    return plan.screen(_sample(t), _FULL, annotations=tax)["contigs"].select("sample", "contig", "label", "taxonomy", "confidence", "state")


# --- kernels over groups of points, joins of the report


def _per_label(t, f, schema: str) -> DataFrame:
    return points(t).groupBy("label").applyInPandas(f, schema)


def _embedded(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pid")
    y = embed.tsne(np.stack(group["vec"].to_numpy()), perplexity=min(10, (len(group) - 1) // 3), seed=1, theta=0.5 if len(group) >= embed._GRID_FROM else 0)
    return pd.DataFrame({"label": group["label"], "pid": group["pid"], "x": y[:, 0], "y": y[:, 1]})


_MERGED = """WITH RECURSIVE c AS (
  SELECT label, 0 AS step, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS id, CAST(count(*) OVER (PARTITION BY label) AS INT) AS points, 1 AS n,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, [vec_id] AS members, CAST(NULL AS INT) AS a, CAST(NULL AS INT) AS b, CAST(0 AS DOUBLE) AS h FROM embeddings
  UNION ALL (
  WITH p AS (SELECT x.label, x.id AS a, y.id AS b, sqrt(2.0 * x.n * y.n / (x.n + y.n) * list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1]-z[2])*(z[1]-z[2])))) AS h, x.n AS na, y.n AS nb, x.v AS va, y.v AS vb, x.members || y.members AS members, x.step, x.points
      FROM c x JOIN c y ON x.label = y.label AND x.id < y.id),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, a, b) AS k FROM p) WHERE k = 1)
  SELECT c.label, c.step + 1, c.id, c.points, c.n, c.v, c.members, NULL, NULL, 0.0 FROM c JOIN m ON c.label = m.label WHERE c.id NOT IN (m.a, m.b)
  UNION ALL SELECT label, step + 1, points + step, points, na + nb, list_transform(list_zip(va, vb), lambda z: (na * z[1] + nb * z[2]) / (na + nb)), members, a, b, h FROM m))"""


@_query("o88_ward", f"{_MERGED} SELECT label, step - 1 AS step, a, b, round(h, 6) AS height, n AS size FROM c WHERE a IS NOT NULL")
def _(t):
    found = ward.merges(points(t), "label")
    z = ward.steps(points(t), "label", found)
    return z.select("label", *[F.col(c).cast("int").alias(c) for c in ("step", "a", "b")], _r("height").alias("height"), F.col("size").cast("int").alias("size"))


@_query("o89_cut", f"{_MERGED} SELECT label, unnest(members) AS pid, CAST(dense_rank() OVER (PARTITION BY label ORDER BY list_min(members)) AS INT) AS cluster FROM c WHERE step = points - 3")
def _(t):
    return ward.cut(points(t), "label", ward.merges(points(t), "label"), 3).select("label", "pid", F.col("cluster").cast("int").alias("cluster"))


@_query("o82_multimodal")
def _(t):
    return modality.split_viewers(points(t), "label").select("label", "is_multimodal")


@_query("o79_tsne")
def _(t):
    return _per_label(t, _embedded, "label int, pid long, x double, y double")


@_query("o79_spread")
def _(t):
    """All points as one sample over many tasks, with fewer rounds than a screen takes."""
    return spread_embed.tsne(points(t), perplexity=30, seed=1, iterations=20)


@_query("o83_cca")
def _(t):
    """Correlations of the first half of the dimensions with the second, over all points."""
    _, _, cov = stats.moments(points(t))
    r = stats.canonical_of(cov, len(cov) // 2)
    return t("region").sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(r)], "k int, r double")


@_query("o67_point_labels", f"{_LAB} SELECT l.doc_id, v.label FROM l LEFT JOIN v USING (contig)")
def _(t):
    rows = _labels(t)
    return rows.select("doc_id", "contig").join(cluster.majority_label(rows), "contig", "left").select("doc_id", "label")


@_query("o69_export_classes", f"WITH {_TAX}, c AS (SELECT t.contig, t.label, t.taxonomy, g.confidence FROM t LEFT JOIN g ON g.taxonomy = t.taxonomy AND g.label = t.label), k AS (SELECT label, taxonomy AS state, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, contig) AS k FROM c WHERE taxonomy IS NOT NULL) SELECT t.contig AS doc_id, coalesce(k.state, 'NA') AS class FROM t LEFT JOIN k ON k.label = t.label AND k.k = 1")
def _(t):
    known = taxonomy.with_confidence(_tax(t)).withColumn("state", F.col("taxonomy"))
    texts = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))
    return plan.decontaminated(texts, known).select(F.col("id").alias("doc_id"), "class")
