"""The registered queries (see SURVEY §7) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import duck_ngrams, duck_strip_ws, duck_tokens
from ..operators import classify, cluster, compare, embed, evaluate, freq, hdbscan, naive_bayes, reduce, split
from ..sources import sinks
from ..operators.split import duck_split_sql
from ..sources import text as src
from . import classic, embedding
from .registry import register

# ------------------------------------------------------------------ helpers
def _top_k_sql(base: str, k: int, n: int = 1, stopwords=None, group: str = "label", with_kw: str = "WITH") -> str:
    """DuckDB twin of item_counts + top_k_per_group over ``base`` (row_id, <group>, text)."""
    g = group
    return f"""
{with_kw} b AS ({base}),
t0 AS (SELECT row_id AS rk, {g}, {duck_tokens("text", stopwords)} AS toks FROM b),
t AS (SELECT rk, {g}, {duck_ngrams("toks", n)} AS items FROM t0),
e AS (SELECT {g}, rk, pos, items[pos + 1] AS item
      FROM (SELECT {g}, rk, items, unnest(range(len(items))) AS pos FROM t)),
c AS (SELECT {g}, item, count(*) AS cnt,
             min(CAST(rk AS DECIMAL(38,0)) * CAST(1000000000 AS DECIMAL(38,0)) + pos) AS first
      FROM e GROUP BY {g}, item),
r AS (SELECT {g}, item, cnt,
             row_number() OVER (PARTITION BY {g} ORDER BY cnt DESC, first ASC) AS rank FROM c)
SELECT {g}, CAST(rank AS BIGINT) AS rank, item, CAST(cnt AS BIGINT) AS cnt FROM r WHERE rank <= {k}
"""


DOCS_BY_LANG = "SELECT doc_id AS row_id, lang AS label, text FROM documents"
CONV_BY_ROLE = (
    "SELECT CAST(conv_id AS DECIMAL(38,0)) * CAST(1000000000 AS DECIMAL(38,0)) + turn AS row_id, "
    "role AS label, text FROM conversations"
)


# ------------------------------------------------------------ S1 scan rules
@register(
    "labeled_messages",
    f"""
WITH l AS (SELECT doc_id AS row_id, {duck_strip_ws("lang || chr(9) || text")} AS line FROM documents),
p AS (SELECT row_id, line, strpos(line, chr(9)) AS tab FROM l WHERE line <> '')
SELECT row_id, substr(line, 1, tab - 1) AS label, substr(line, tab + 1) AS text FROM p WHERE tab > 0
""",
)
def labeled_messages(spark, sf):
    docs = src.load_text_table(spark, sf, "documents")
    lines = docs.select(F.col("doc_id").alias("row_id"), F.concat_ws("\t", "lang", "text").alias("value"))
    return src.parse_labelled_lines(lines, keep=("row_id",))


# ------------------------------------------------------------ tokens, counts
@register(
    "tokens_per_doc",
    f"""
WITH t AS (SELECT doc_id AS row_id, {duck_tokens("text")} AS toks FROM documents)
SELECT row_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM t
""",
)
def tokens_per_doc(spark, sf):
    return freq.tokens_per_row(src.documents_by_lang(spark, sf))


@register(
    "tokens_per_benchmark_item",
    f"""
WITH t AS (SELECT item_id AS row_id, {duck_tokens("text", True)} AS toks FROM benchmark)
SELECT row_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM t
""",
)
def tokens_per_benchmark_item(spark, sf):
    items = src.load_text_table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    return freq.tokens_per_row(items, stopwords=True)


@register("top_words_by_label", _top_k_sql(DOCS_BY_LANG, 25))
def top_words_by_label(spark, sf):
    return freq.top_words_by_label(src.documents_by_lang(spark, sf), k=25)


@register("top_words_nostop", _top_k_sql(DOCS_BY_LANG, 25, stopwords=True))
def top_words_nostop(spark, sf):
    return freq.top_words_by_label(src.documents_by_lang(spark, sf), k=25, stopwords=True)


@register("top_bigrams_by_label", _top_k_sql(DOCS_BY_LANG, 25, n=2, stopwords=True))
def top_bigrams_by_label(spark, sf):
    return freq.top_ngrams_by_label(src.documents_by_lang(spark, sf), n=2, k=25, stopwords=True)


@register("top_bigrams_with_stopwords", _top_k_sql(DOCS_BY_LANG, 25, n=2))
def top_bigrams_with_stopwords(spark, sf):
    return freq.top_ngrams_by_label(src.documents_by_lang(spark, sf), n=2, k=25)


@register("top_words_by_role", _top_k_sql(CONV_BY_ROLE, 25, stopwords=True))
def top_words_by_role(spark, sf):
    return freq.top_words_by_label(src.conversations_by_role(spark, sf), k=25, stopwords=True)


@register("top_trigrams_by_role", _top_k_sql(CONV_BY_ROLE, 10, n=3, stopwords=True))
def top_trigrams_by_role(spark, sf):
    return freq.top_ngrams_by_label(src.conversations_by_role(spark, sf), n=3, k=10, stopwords=True)


# ------------------------------------------------------- classic classifier
# Classifier input: documents joined to labels; label = toxic / clean.
CLS_SEED, CLS_RATIO, CLS_TOP_WORDS, CLS_POSITIVE = 42, 0.2, 2000, "toxic"
CLS_BASE = (
    "SELECT d.doc_id AS row_id, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS label, d.text "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
)


def _cls_ctes() -> str:
    """DuckDB CTEs: split, tok, vocab, bow, params, pred (NB on the test rows)."""
    return f"""
WITH split AS ({duck_split_sql(CLS_BASE, CLS_RATIO, CLS_SEED)}),
tok AS (SELECT row_id, label, shuffle_key, is_train, {duck_tokens("text", True)} AS tokens FROM split),
vc AS (SELECT term, count(*) AS cnt,
              min(CAST(shuffle_key AS DECIMAL(38,0)) * CAST(1000000000 AS DECIMAL(38,0)) + pos) AS first
       FROM (SELECT shuffle_key, pos, tokens[pos + 1] AS term
             FROM (SELECT shuffle_key, tokens, unnest(range(len(tokens))) AS pos FROM tok WHERE is_train))
       GROUP BY term),
v1 AS (SELECT term, cnt, row_number() OVER (ORDER BY cnt DESC, first ASC) AS freq_rank FROM vc),
vocab AS (SELECT term, CAST(cnt AS BIGINT) AS cnt, CAST(freq_rank AS BIGINT) AS freq_rank,
                 CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS feature_index
          FROM v1 WHERE freq_rank <= {CLS_TOP_WORDS}),
bow AS (SELECT DISTINCT w.row_id, w.term, v.feature_index
        FROM (SELECT row_id, unnest(tokens) AS term FROM tok) w JOIN vocab v ON v.term = w.term),
tr AS (SELECT row_id, label FROM tok WHERE is_train),
sizes AS (SELECT label, count(*) AS n_c FROM tr GROUP BY label),
tot AS (SELECT sum(n_c) AS n_all, count(*) AS n_labels FROM sizes),
ncw AS (SELECT t.label, b.term, count(*) AS n_cw FROM bow b JOIN tr t ON t.row_id = b.row_id GROUP BY t.label, b.term),
dfw AS (SELECT term, sum(n_cw) AS df_w FROM ncw GROUP BY term),
pr AS (SELECT s.label, v.term, s.n_c, coalesce(n.n_cw, 0) AS n_cw,
              CASE WHEN coalesce(d.df_w, 0) >= tot.n_all THEN 1 ELSE 2 END AS bins, tot.n_all, tot.n_labels
       FROM sizes s CROSS JOIN vocab v CROSS JOIN tot
       LEFT JOIN ncw n ON n.label = s.label AND n.term = v.term
       LEFT JOIN dfw d ON d.term = v.term),
params AS (SELECT label, term, CAST(n_c AS BIGINT) AS n_c, CAST(n_cw AS BIGINT) AS n_cw, bins,
                  ln((n_cw + 0.5) / (n_c + 0.5 * bins)) AS log_p_true,
                  ln((n_c - n_cw + 0.5) / (n_c + 0.5 * bins)) AS log_p_false,
                  ln((n_c + 0.5) / (n_all + 0.5 * n_labels)) AS log_prior FROM pr),
base AS (SELECT label, max(log_prior) + sum(log_p_false) AS base FROM params GROUP BY label),
gain AS (SELECT b.row_id, p.label, sum(p.log_p_true - p.log_p_false) AS gain
         FROM bow b JOIN params p ON p.term = b.term GROUP BY b.row_id, p.label),
test AS (SELECT row_id, label FROM tok WHERE NOT is_train),
sc AS (SELECT t.row_id, bs.label AS cand, bs.base + coalesce(g.gain, 0) AS score
       FROM test t CROSS JOIN base bs LEFT JOIN gain g ON g.row_id = t.row_id AND g.label = bs.label),
best AS (SELECT row_id, cand AS predicted FROM
           (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cand DESC) AS k FROM sc) WHERE k = 1),
pred AS (SELECT t.row_id, t.label, b.predicted FROM test t LEFT JOIN best b ON b.row_id = t.row_id)
"""


def _metrics_sql(pred: str, cid: str) -> str:
    return f"""
SELECT '{cid}' AS classifier_id,
       CASE WHEN total > 0 THEN correct / total ELSE 0.0 END AS accuracy,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
       CASE WHEN (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END) > 0
            THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END AS f1,
       CAST(correct AS BIGINT) AS correct, CAST(total AS BIGINT) AS total, CAST(tp AS BIGINT) AS tp,
       CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn
FROM (SELECT count(*) AS total,
             sum(CASE WHEN predicted = label THEN 1 ELSE 0 END) AS correct,
             sum(CASE WHEN predicted = '{CLS_POSITIVE}' AND label = '{CLS_POSITIVE}' THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN predicted = '{CLS_POSITIVE}' AND label <> '{CLS_POSITIVE}' THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN predicted <> '{CLS_POSITIVE}' AND label = '{CLS_POSITIVE}' THEN 1 ELSE 0 END) AS fn
      FROM {pred})
"""


def _prepared(spark, sf):
    return classic.prepare(src.documents_by_toxicity(spark, sf), CLS_RATIO, CLS_SEED, CLS_TOP_WORDS, stopwords=True)


@register("train_test_split", _cls_ctes() + "SELECT row_id, label, shuffle_key, is_train FROM tok")
def train_test_split(spark, sf):
    rows = split.seeded_split(src.documents_by_toxicity(spark, sf), CLS_RATIO, CLS_SEED)
    return rows.select("row_id", "label", "shuffle_key", "is_train")


@register("vocabulary", _cls_ctes() + "SELECT term, cnt, freq_rank, feature_index FROM vocab")
def vocabulary_q(spark, sf):
    return _prepared(spark, sf).vocab


@register("bow_features", _cls_ctes() + "SELECT row_id, term, feature_index FROM bow")
def bow_features(spark, sf):
    return _prepared(spark, sf).bow.select("row_id", "term", "feature_index")


@register(
    "nb_parameters",
    _cls_ctes()
    + "SELECT label, term, n_c, n_cw, bins, round(log_p_true, 6) AS log_p_true, "
    "round(log_p_false, 6) AS log_p_false, round(log_prior, 6) AS log_prior FROM params",
)
def nb_parameters(spark, sf):
    params = classic.naive_bayes_model(_prepared(spark, sf))
    return params.select(
        "label", "term", "n_c", "n_cw", "bins",
        *[F.round(c, 6).alias(c) for c in ("log_p_true", "log_p_false", "log_prior")],
    )


@register("nb_predictions", _cls_ctes() + "SELECT row_id, label, predicted FROM pred")
def nb_predictions(spark, sf):
    return classic.predictions(_prepared(spark, sf), "naive_bayes")


@register("nb_metrics", _cls_ctes() + _metrics_sql("pred", "naive_bayes"))
def nb_metrics(spark, sf):
    pred = classic.predictions(_prepared(spark, sf), "naive_bayes").withColumn("classifier_id", F.lit("naive_bayes"))
    return classify.confusion_metrics(pred, CLS_POSITIVE)


@register(
    "nb_informative",
    _cls_ctes()
    + """,
lv AS (SELECT term, true AS value, (n_cw + 0.5) / (n_c + 0.5 * bins) AS p FROM params WHERE n_cw > 0
       UNION ALL
       SELECT term, false AS value, (n_c - n_cw + 0.5) / (n_c + 0.5 * bins) AS p FROM params WHERE n_c - n_cw > 0),
ag AS (SELECT term, value, max(p) AS pmax, min(p) AS pmin FROM lv GROUP BY term, value HAVING min(p) > 0),
rk AS (SELECT *, row_number() OVER (ORDER BY pmin / pmax, term, CAST(value AS INT)) AS rank FROM ag)
SELECT CAST(rank AS BIGINT) AS rank, term, CAST(value AS VARCHAR) AS value, round(pmax / pmin, 6) AS ratio
FROM rk WHERE rank <= 20""",
)
def nb_informative(spark, sf):
    params = classic.naive_bayes_model(_prepared(spark, sf))
    out = naive_bayes.informative_features(params, 20)
    return out.select("rank", "term", "value", F.round("ratio", 6).alias("ratio"))


@register("lr_metrics")
def lr_metrics(spark, sf):
    return classic.compare_classifiers(_prepared(spark, sf), ["logistic_regression"], CLS_POSITIVE)


@register("svm_metrics")
def svm_metrics(spark, sf):
    return classic.compare_classifiers(_prepared(spark, sf), ["svm"], CLS_POSITIVE)


# Both objectives are convex: their gradient vanishes at the optimum alone. Per training row it is at most this.
STATIONARY = 1e-6


def _stationary(spark, sf, classifier_id):
    p = _prepared(spark, sf)
    small = F.abs("gradient") <= F.lit(STATIONARY * p.n_train)
    return classic.linear_residuals(p, classifier_id).select(F.coalesce("term", F.lit("(intercept)")).alias("term"), small.alias("stationary"))


_STATIONARY_SQL = _cls_ctes() + "SELECT term, TRUE AS stationary FROM vocab UNION ALL SELECT '(intercept)', TRUE"


@register("svm_stationarity", _STATIONARY_SQL)
def svm_stationarity(spark, sf):
    return _stationary(spark, sf, "svm")


@register("lr_stationarity", _STATIONARY_SQL)
def lr_stationarity(spark, sf):
    return _stationary(spark, sf, "logistic_regression")


@register("classifier_comparison")
def classifier_comparison(spark, sf):
    return classic.compare_classifiers(_prepared(spark, sf), ["naive_bayes", "svm", "logistic_regression"], CLS_POSITIVE)


@register("classifier_metric_series")
def classifier_metric_series(spark, sf):
    m = classic.compare_classifiers(_prepared(spark, sf), ["naive_bayes", "svm", "logistic_regression"], CLS_POSITIVE)
    return classify.metric_series(m)


# ------------------------------------------------------- cluster evaluation
# Assignment fixture: embeddings.label as the cluster, documents.lang as the
# label (vec_id = doc_id), the first two vector components as plot coordinates.
ASSIGN_SQL = (
    "SELECT e.vec_id AS row_id, d.lang AS label, d.text, CAST(e.label AS BIGINT) AS cluster_id, "
    "CAST(e.embedding[1] AS DOUBLE) AS x, CAST(e.embedding[2] AS DOUBLE) AS y "
    "FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"
)


def label_assignment(spark, sf):
    emb = src.load_table(spark, sf, "embeddings")
    docs = src.load_text_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return emb.join(docs, emb.vec_id == docs.doc_id).select(
        F.col("vec_id").alias("row_id"), F.col("lang").alias("label"), "text",
        F.col("label").cast("long").alias("cluster_id"),
        F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
    )


ALIGN_CTES = f"""
a AS ({ASSIGN_SQL}),
cnts AS (SELECT cluster_id, label, count(*) AS cnt FROM a GROUP BY cluster_id, label),
lt AS (SELECT label, sum(cnt) AS label_total, sum(sum(cnt)) OVER () AS n_all FROM cnts GROUP BY label),
sz AS (SELECT cluster_id, sum(cnt) AS cluster_size FROM cnts WHERE cluster_id <> -1 GROUP BY cluster_id),
t2 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cluster_size DESC, cluster_id DESC) AS rank FROM sz) WHERE rank <= 2),
t2b AS (SELECT * FROM t2 WHERE (SELECT count(*) FROM t2) >= 2),
mj AS (SELECT cluster_id, label AS majority_label, cnt AS label_in_cluster FROM
        (SELECT c.*, row_number() OVER (PARTITION BY c.cluster_id ORDER BY c.cnt DESC, c.label ASC) AS r
         FROM cnts c JOIN t2b ON t2b.cluster_id = c.cluster_id) WHERE r = 1),
al0 AS (SELECT t2b.rank, t2b.cluster_id, mj.majority_label, mj.label_in_cluster, lt.label_total, t2b.cluster_size,
               CAST(lt.n_all AS DOUBLE) AS n,
               CAST(mj.label_in_cluster AS DOUBLE) AS tp,
               CAST(t2b.cluster_size - mj.label_in_cluster AS DOUBLE) AS fp,
               CAST(lt.label_total - mj.label_in_cluster AS DOUBLE) AS fn
        FROM t2b JOIN mj ON mj.cluster_id = t2b.cluster_id JOIN lt ON lt.label = mj.majority_label),
al1 AS (SELECT *, (n - fp - fn) / n AS accuracy,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM al0),
al AS (SELECT CAST(rank AS BIGINT) AS rank, cluster_id, majority_label, accuracy, precision, recall,
              CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
              CAST(label_in_cluster AS BIGINT) AS label_in_cluster, CAST(label_total AS BIGINT) AS label_total,
              CAST(cluster_size AS BIGINT) AS cluster_size FROM al1)"""

SIL_CTES = """
p AS (SELECT row_id, cluster_id, x, y FROM a WHERE cluster_id <> -1),
dd AS (SELECT p1.row_id, p1.cluster_id AS own, p2.cluster_id AS other,
              sum(sqrt((p1.x - p2.x) * (p1.x - p2.x) + (p1.y - p2.y) * (p1.y - p2.y))) AS sum_d, count(*) AS cnt
       FROM p p1, p p2 GROUP BY p1.row_id, p1.cluster_id, p2.cluster_id),
st AS (SELECT row_id, max(CASE WHEN other = own THEN cnt END) AS own_cnt,
              max(CASE WHEN other = own THEN sum_d END) AS own_sum,
              min(CASE WHEN other <> own THEN sum_d / cnt END) AS b FROM dd GROUP BY row_id),
sv AS (SELECT CASE WHEN own_cnt <= 1 OR b IS NULL THEN 0.0
                   WHEN greatest(own_sum / (own_cnt - 1), b) > 0
                   THEN (b - own_sum / (own_cnt - 1)) / greatest(own_sum / (own_cnt - 1), b) ELSE 0.0 END AS s FROM st),
sil AS (SELECT CASE WHEN count(*) > 1 AND (SELECT count(DISTINCT cluster_id) FROM p) > 1 THEN avg(s) END AS silhouette,
               CAST(count(*) AS BIGINT) AS n_points FROM sv)"""


def _r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


@register("cluster_summary", f"""
WITH a AS ({ASSIGN_SQL})
SELECT CAST(count(*) AS BIGINT) AS n_messages, CAST(count(DISTINCT cluster_id) AS BIGINT) AS n_clusters_incl_noise,
       CAST(count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS BIGINT) AS n_clusters,
       CAST(sum(CASE WHEN cluster_id = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise FROM a""")
def cluster_summary(spark, sf):
    return evaluate.summary(label_assignment(spark, sf))


@register("cluster_sizes", f"""
WITH a AS ({ASSIGN_SQL})
SELECT cluster_id, CAST(count(*) AS BIGINT) AS cluster_size FROM a WHERE cluster_id <> -1 GROUP BY cluster_id""")
def cluster_sizes(spark, sf):
    return evaluate.cluster_sizes(label_assignment(spark, sf))


ALIGN_COLS = ("accuracy", "precision", "recall", "f1")


@register("cluster_label_alignment", f"""
WITH {ALIGN_CTES}
SELECT rank, cluster_id, majority_label, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, label_in_cluster, label_total, cluster_size FROM al""")
def cluster_label_alignment(spark, sf):
    return _r6(evaluate.alignment(label_assignment(spark, sf)), *ALIGN_COLS)


@register("silhouette", f"""
WITH a AS ({ASSIGN_SQL}), {SIL_CTES}
SELECT round(silhouette, 6) AS silhouette, n_points FROM sil""")
def silhouette_q(spark, sf):
    return _r6(evaluate.silhouette(label_assignment(spark, sf)), "silhouette")


@register("cluster_centroids", f"""
WITH a AS ({ASSIGN_SQL})
SELECT cluster_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, CAST(count(*) AS BIGINT) AS cluster_size
FROM a WHERE cluster_id <> -1 GROUP BY cluster_id""")
def cluster_centroids(spark, sf):
    return _r6(evaluate.centroids(label_assignment(spark, sf)), "cx", "cy")


CLUSTER_TOP_SQL = _top_k_sql(f"SELECT row_id, cluster_id, text FROM ({ASSIGN_SQL}) WHERE cluster_id <> -1",
                             3, n=3, stopwords=True, group="cluster_id")


@register("cluster_top_ngrams", CLUSTER_TOP_SQL)
def cluster_top_ngrams(spark, sf):
    return evaluate.cluster_top_ngrams(label_assignment(spark, sf), n=3, top_k=3)


@register("ngram_annotations", f"""
WITH top AS ({CLUSTER_TOP_SQL}),
a AS ({ASSIGN_SQL}),
cen AS (SELECT cluster_id, avg(x) AS cx, avg(y) AS cy FROM a WHERE cluster_id <> -1 GROUP BY cluster_id),
ext AS (SELECT max(y) - min(y) AS y_span FROM a),
rng AS (SELECT min(cnt) AS cmin, max(cnt) AS cmax FROM top WHERE cnt > 0),
kk AS (SELECT cluster_id, count(*) AS k FROM top GROUP BY cluster_id)
SELECT t.cluster_id, t.rank, t.item AS gram, t.cnt, round(c.cx, 6) AS x,
       round(c.cy + ((kk.k - 1) / 2.0 - (t.rank - 1)) * (CASE WHEN ext.y_span > 0 THEN ext.y_span * 0.02 ELSE 0.1 END), 6) AS y,
       round(CASE WHEN rng.cmax = rng.cmin THEN 11.0 ELSE 8.0 + (t.cnt - rng.cmin) * 6.0 / (rng.cmax - rng.cmin) END, 6) AS font_size
FROM top t JOIN cen c ON c.cluster_id = t.cluster_id JOIN kk ON kk.cluster_id = t.cluster_id, ext, rng""")
def ngram_annotations(spark, sf):
    assign = label_assignment(spark, sf)
    top = evaluate.cluster_top_ngrams(assign, n=3, top_k=3)
    return _r6(evaluate.annotations(assign, top), "x", "y", "font_size")


@register("scatter_series", f"""
WITH a AS ({ASSIGN_SQL})
SELECT row_id, CASE WHEN cluster_id = -1 THEN 'noise' ELSE 'cluster ' || CAST(cluster_id AS VARCHAR) END AS series,
       label, x, y FROM a""")
def scatter_series(spark, sf):
    return evaluate.scatter_series(label_assignment(spark, sf))


@register("cluster_metrics_text", f"""
WITH {ALIGN_CTES}, {SIL_CTES}
SELECT (CASE WHEN sil.silhouette IS NULL THEN 'Silhouette: n/a' ELSE printf('Silhouette: %.3f', sil.silhouette) END)
       || chr(10) ||
       (CASE WHEN (SELECT count(*) FROM al) > 0 THEN 'Top clusters:' || chr(10) ||
             (SELECT string_agg(printf('cluster %d (%s)', cluster_id, majority_label) || chr(10) ||
                                printf('  acc=%.3f prec=%.3f rec=%.3f', accuracy, precision, recall) || chr(10) ||
                                printf('  f1=%.3f label_in_cluster=%d label_total=%d', f1, label_in_cluster, label_total),
                                chr(10) ORDER BY rank) FROM al)
        ELSE 'Top clusters: N/A' END) AS metrics_text
FROM sil""")
def cluster_metrics_text(spark, sf):
    assign = label_assignment(spark, sf)
    return evaluate.metrics_text(evaluate.silhouette(assign), evaluate.alignment(assign))


# ------------------------------------------------ reduction and clustering
def _vectors(spark, sf):
    emb = src.load_table(spark, sf, "embeddings")
    return emb.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label")


def _dbscan_sql(eps: float, min_samples: int, cosine: bool = False) -> str:
    vec = "CAST(embedding AS DOUBLE[])"
    if cosine:
        dist = "1.0 - list_cosine_similarity(a.v, b.v)"
    else:
        dist = "list_distance(a.v, b.v)"
    return f"""
WITH RECURSIVE
p AS (SELECT vec_id AS row_id, {vec} AS v FROM embeddings),
nb AS (SELECT a.row_id AS a, b.row_id AS b FROM p a, p b WHERE {dist} <= {eps!r}),
cnt AS (SELECT a AS row_id, count(*) AS n FROM nb GROUP BY a),
core AS (SELECT row_id FROM cnt WHERE n >= {int(min_samples)}),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON c1.row_id = nb.a JOIN core c2 ON c2.row_id = nb.b),
reach(node, root) AS (
  SELECT row_id, row_id FROM core
  UNION
  SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM (SELECT DISTINCT root FROM comp)),
ccid AS (SELECT c.node AS row_id, n.cid FROM comp c JOIN num n ON n.root = c.root),
bord AS (SELECT nb.a AS row_id, min(cc.cid) AS cid FROM nb JOIN ccid cc ON cc.row_id = nb.b
         WHERE nb.a NOT IN (SELECT row_id FROM core) GROUP BY nb.a)
SELECT p.row_id, CAST(coalesce(cc.cid, bd.cid, -1) AS INTEGER) AS cluster_id
FROM p LEFT JOIN ccid cc ON cc.row_id = p.row_id LEFT JOIN bord bd ON bd.row_id = p.row_id
"""


DBSCAN_EPS, DBSCAN_MIN = 1.16, 5


@register("dbscan", _dbscan_sql(DBSCAN_EPS, DBSCAN_MIN))
def dbscan_q(spark, sf):
    out, _ = cluster.dbscan(_vectors(spark, sf), eps=DBSCAN_EPS, min_samples=DBSCAN_MIN)
    return out


@register("dbscan_cosine", _dbscan_sql(DBSCAN_EPS ** 2 / 2, DBSCAN_MIN, cosine=True))
def dbscan_cosine_q(spark, sf):
    out, _ = cluster.dbscan(_vectors(spark, sf), eps=DBSCAN_EPS ** 2 / 2, min_samples=DBSCAN_MIN, metric="cosine")
    return out


@register("dbscan_small_blocks", _dbscan_sql(1.14, 3))
def dbscan_small_blocks_q(spark, sf):
    """Same operator with tiny blocks (many block pairs) and another (eps, min_samples)."""
    out, _ = cluster.dbscan(_vectors(spark, sf), eps=1.14, min_samples=3, block_size=64)
    return out


def _reduced(df, k):
    return df.select("row_id", F.transform("reduced", lambda x: F.round(x, 6)).alias("reduced"))


@register("pca")
def pca_q(spark, sf):
    out, _ = reduce.pca(_vectors(spark, sf), 5)
    return _reduced(out, 5)


@register("svd")
def svd_q(spark, sf):
    out, _ = reduce.svd(_vectors(spark, sf), 5)
    return _reduced(out, 5)


@register("kernel_pca")
def kernel_pca_q(spark, sf):
    out, _ = reduce.kernel_pca(_vectors(spark, sf), 5)
    return _reduced(out, 5)


@register("kmeans")
def kmeans_q(spark, sf):
    red, _ = reduce.pca(_vectors(spark, sf), 5)
    out, _ = cluster.kmeans(red.select("row_id", F.col("reduced").alias("vec")), k=2, n_init=10, seed=42)
    return out


# --------------------------------------------------------------- embeddings
def _fresh_path(spark, name):
    import uuid

    from ..session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("embed_documents", """
SELECT doc_id AS row_id, lang AS label, CAST(64 AS BIGINT) AS dims,
       CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END AS norm FROM documents""")
def embed_documents(spark, sf):
    docs = src.documents_by_lang(spark, sf)
    out, _ = embed.embed_with_cache(spark, docs, embed.LocalHashEmbedder(64, 42), "local", "hash-64", {},
                                    _fresh_path(spark, "embed-cache"), batch_size=128)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("row_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(norm, 4).alias("norm"))


@register("embedding_cache_misses", """
SELECT DISTINCT sha256(coalesce(text, '')) AS text_hash FROM conversations
WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents)""")
def embedding_cache_misses(spark, sf):
    """Second run over documents + conversations after a first run over documents: only new texts miss."""
    cache = _fresh_path(spark, "embed-cache")
    prov, fp_args = embed.LocalHashEmbedder(16, 7), ("local", "hash-16", {})
    docs = src.documents_by_lang(spark, sf)
    embed.embed_with_cache(spark, docs, prov, *fp_args, cache, batch_size=256)
    both = docs.select("text").unionByName(src.load_table(spark, sf, "conversations").select("text"))
    return embed.cache_misses(spark, both, cache, embed.fingerprint(*fp_args)).select("text_hash")


# ------------------------------------------------------ runs and comparison
RUNS = (
    # run_id, provider, reduce algorithm, cluster algorithm
    ("given_labels", "openai", "pca", "given"),
    ("dbscan_euclid", "google", "kernel_pca", "dbscan"),
)


def _run_assignments(spark, sf):
    base = label_assignment(spark, sf)
    db, _ = cluster.dbscan(_vectors(spark, sf), eps=DBSCAN_EPS, min_samples=DBSCAN_MIN)
    return {
        "given_labels": base,
        "dbscan_euclid": base.drop("cluster_id").join(db.select("row_id", F.col("cluster_id").cast("long")), "row_id"),
    }


def _reports(spark, sf):
    parts = []
    assignments = _run_assignments(spark, sf)
    for run_id, provider, red, algo in RUNS:
        assign = assignments[run_id]
        params = {"eps": DBSCAN_EPS, "min_samples": DBSCAN_MIN, "metric": "euclidean"} if algo == "dbscan" else {}
        emb_meta = {"provider": provider, "provider_name": provider, "model": "given-64", "provider_params": "{}",
                    "batch_size": 128, "limit": 0, "source_path": "embeddings", "num_messages": None}
        cfg = compare.run_config(algo, params, 42, red, {}, 64, "stored", "pca", emb_meta)
        al, sil = evaluate.alignment(assign).cache(), evaluate.silhouette(assign).cache()  # ≤ 2 rows, 1 row
        parts.append(compare.build_report(run_id, cfg, al, sil, evaluate.metrics_text(sil, al)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    path = _fresh_path(spark, "reports")
    compare.write_reports(out, path)
    return compare.read_reports(spark, path)


def _compare_q(spark, sf, provider_filter="all"):
    flat = compare.flatten(_reports(spark, sf), provider_filter)
    flat = flat.withColumn("report_path", F.regexp_extract("report_path", "run_id=([^/]+)", 1))
    return _r6(flat, "silhouette", "accuracy", "precision", "recall", "f1")


def _run_sql(p: str, assign_sql: str) -> str:
    """Per-run CTEs (prefix ``p``): assignment, alignment, silhouette."""
    return f"""
{p}a AS ({assign_sql}),
{p}cnts AS (SELECT cluster_id, label, count(*) AS cnt FROM {p}a GROUP BY cluster_id, label),
{p}lt AS (SELECT label, sum(cnt) AS label_total, sum(sum(cnt)) OVER () AS n_all FROM {p}cnts GROUP BY label),
{p}sz AS (SELECT cluster_id, sum(cnt) AS cluster_size FROM {p}cnts WHERE cluster_id <> -1 GROUP BY cluster_id),
{p}t2 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cluster_size DESC, cluster_id DESC) AS rank FROM {p}sz) WHERE rank <= 2),
{p}t2b AS (SELECT * FROM {p}t2 WHERE (SELECT count(*) FROM {p}t2) >= 2),
{p}mj AS (SELECT cluster_id, label AS majority_label, cnt AS label_in_cluster FROM
        (SELECT c.*, row_number() OVER (PARTITION BY c.cluster_id ORDER BY c.cnt DESC, c.label ASC) AS r
         FROM {p}cnts c JOIN {p}t2b t ON t.cluster_id = c.cluster_id) WHERE r = 1),
{p}al AS (SELECT t.rank, t.cluster_id, m.majority_label, m.label_in_cluster, l.label_total, t.cluster_size,
               CAST(l.n_all AS DOUBLE) AS n, CAST(m.label_in_cluster AS DOUBLE) AS tp,
               CAST(t.cluster_size - m.label_in_cluster AS DOUBLE) AS fp,
               CAST(l.label_total - m.label_in_cluster AS DOUBLE) AS fn
        FROM {p}t2b t JOIN {p}mj m ON m.cluster_id = t.cluster_id JOIN {p}lt l ON l.label = m.majority_label),
{p}pts AS (SELECT row_id, cluster_id, x, y FROM {p}a WHERE cluster_id <> -1),
{p}dd AS (SELECT p1.row_id, p1.cluster_id AS own, p2.cluster_id AS other,
              sum(sqrt((p1.x - p2.x) * (p1.x - p2.x) + (p1.y - p2.y) * (p1.y - p2.y))) AS sum_d, count(*) AS cnt
       FROM {p}pts p1, {p}pts p2 GROUP BY p1.row_id, p1.cluster_id, p2.cluster_id),
{p}st AS (SELECT row_id, max(CASE WHEN other = own THEN cnt END) AS own_cnt,
              max(CASE WHEN other = own THEN sum_d END) AS own_sum,
              min(CASE WHEN other <> own THEN sum_d / cnt END) AS b FROM {p}dd GROUP BY row_id),
{p}sv AS (SELECT CASE WHEN own_cnt <= 1 OR b IS NULL THEN 0.0
                   WHEN greatest(own_sum / (own_cnt - 1), b) > 0
                   THEN (b - own_sum / (own_cnt - 1)) / greatest(own_sum / (own_cnt - 1), b) ELSE 0.0 END AS s FROM {p}st),
{p}sil AS (SELECT CASE WHEN count(*) > 1 AND (SELECT count(DISTINCT cluster_id) FROM {p}pts) > 1 THEN avg(s) END AS silhouette
       FROM {p}sv)"""


def _run_row(p: str, run_id: str, provider: str, red: str, algo: str) -> str:
    prov_tok = "gemini" if provider in ("google", "gemini") else provider
    red_tok = "kernelpca" if red == "kernel_pca" else red
    return f"""
SELECT '{algo}_{red_tok}_{prov_tok}' AS config_id, '{algo}' AS cluster_algorithm, '{red}' AS cluster_reduce,
       'pca' AS plot_reduce, '{provider}' AS embedding_provider, 'given-64' AS embedding_model,
       'stored' AS coords_source, CAST(42 AS BIGINT) AS seed, round(s.silhouette, 6) AS silhouette,
       CAST(a.cluster_id AS BIGINT) AS cluster_id, a.majority_label,
       round((a.n - a.fp - a.fn) / a.n, 6) AS accuracy,
       round(CASE WHEN a.tp + a.fp > 0 THEN a.tp / (a.tp + a.fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN a.tp + a.fn > 0 THEN a.tp / (a.tp + a.fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN a.tp > 0 THEN 2.0 * a.tp / (2.0 * a.tp + a.fp + a.fn) ELSE 0.0 END, 6) AS f1,
       CAST(a.label_in_cluster AS BIGINT) AS label_in_cluster, CAST(a.label_total AS BIGINT) AS label_total,
       CAST(a.cluster_size AS BIGINT) AS cluster_size, '{run_id}' AS report_path
FROM {p}al a, {p}sil s WHERE a.rank = 1"""


def _dbscan_cte(p: str, eps: float, min_samples: int) -> str:
    return f"""
{p}pv AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{p}nb AS (SELECT a.row_id AS a, b.row_id AS b FROM {p}pv a, {p}pv b WHERE list_distance(a.v, b.v) <= {eps!r}),
{p}core AS (SELECT a AS row_id FROM {p}nb GROUP BY a HAVING count(*) >= {int(min_samples)}),
{p}ce AS (SELECT nb.a, nb.b FROM {p}nb nb JOIN {p}core c1 ON c1.row_id = nb.a JOIN {p}core c2 ON c2.row_id = nb.b),
{p}reach(node, root) AS (
  SELECT row_id, row_id FROM {p}core
  UNION
  SELECT ce.b, r.root FROM {p}reach r JOIN {p}ce ce ON ce.a = r.node),
{p}comp AS (SELECT node, min(root) AS root FROM {p}reach GROUP BY node),
{p}num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM (SELECT DISTINCT root FROM {p}comp)),
{p}ccid AS (SELECT c.node AS row_id, n.cid FROM {p}comp c JOIN {p}num n ON n.root = c.root),
{p}bord AS (SELECT nb.a AS row_id, min(cc.cid) AS cid FROM {p}nb nb JOIN {p}ccid cc ON cc.row_id = nb.b
         WHERE nb.a NOT IN (SELECT row_id FROM {p}core) GROUP BY nb.a),
{p}lab AS (SELECT pv.row_id, CAST(coalesce(cc.cid, bd.cid, -1) AS BIGINT) AS cluster_id
FROM {p}pv pv LEFT JOIN {p}ccid cc ON cc.row_id = pv.row_id LEFT JOIN {p}bord bd ON bd.row_id = pv.row_id)"""


def _compare_sql(provider_filter: str = "all") -> str:
    ctes, rows = _compare_parts(provider_filter)
    return "WITH RECURSIVE " + ctes + "\n" + rows


def _compare_parts(provider_filter: str = "all") -> tuple[str, str]:
    dbs = _dbscan_cte("d_", DBSCAN_EPS, DBSCAN_MIN)
    assign_db = (f"SELECT b.row_id, b.label, b.text, l.cluster_id, b.x, b.y FROM ({ASSIGN_SQL}) b "
                 f"JOIN d_lab l ON l.row_id = b.row_id")
    ctes = ",".join([dbs, _run_sql("g_", ASSIGN_SQL), _run_sql("e_", assign_db)])
    rows = [_run_row("g_", *RUNS[0]), _run_row("e_", *RUNS[1])]
    keep = [r for r, run in zip(rows, RUNS)
            if provider_filter == "all" or ("gemini" if run[1] in ("google", "gemini") else run[1]) == provider_filter]
    return ctes, "\nUNION ALL\n".join(keep)


@register("compare_runs", _compare_sql())
def compare_runs(spark, sf):
    return _compare_q(spark, sf)


@register("compare_runs_filtered", _compare_sql("gemini"))
def compare_runs_filtered(spark, sf):
    return _compare_q(spark, sf, "gemini")


@register("run_metric_series", f"""
WITH RECURSIVE {_compare_parts()[0]},
cmp AS ({_compare_parts()[1]})
SELECT config_id, 'accuracy' AS metric, coalesce(CAST(accuracy AS DOUBLE), 0.0) AS value FROM cmp
UNION ALL SELECT config_id, 'f1', coalesce(CAST(f1 AS DOUBLE), 0.0) FROM cmp
UNION ALL SELECT config_id, 'silhouette', coalesce(CAST(silhouette AS DOUBLE), 0.0) FROM cmp""")
def run_metric_series(spark, sf):
    return compare.metric_series(_compare_q(spark, sf))


@register("assignments_tsv", f"""
WITH a AS ({ASSIGN_SQL})
SELECT label, cluster_id AS cluster, printf('%.6f', x) AS x, printf('%.6f', y) AS y, text FROM a""")
def assignments_tsv(spark, sf):
    return sinks.assignment_table(label_assignment(spark, sf))


# ------------------------------------------------------- HDBSCAN pieces
HDB_MIN_SAMPLES = 10


@register("core_distances", f"""
WITH p AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.row_id, list_distance(a.v, b.v) AS d FROM p a, p b),
r AS (SELECT row_id, d, row_number() OVER (PARTITION BY row_id ORDER BY d) AS k FROM d)
SELECT row_id, round(d, 6) AS core_distance FROM r WHERE k = {HDB_MIN_SAMPLES}""")
def core_distances_q(spark, sf):
    out = hdbscan.core_distances(_vectors(spark, sf), min_samples=HDB_MIN_SAMPLES)
    return out.select("row_id", F.round("core_distance", 6).alias("core_distance"))


def _mst_sql(k: int, rounds: int = 10) -> str:
    """Borůvka's rounds written out: components, their lightest edges by (w, lo, hi), pointers doubled to roots."""
    parts = [f"""p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dd AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM p a, p b),
cr AS (SELECT a, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM dd) WHERE r = {k}),
e AS MATERIALIZED (SELECT dd.a, dd.b, greatest(d, x.core, y.core) AS w FROM dd JOIN cr x ON x.a = dd.a JOIN cr y ON y.a = dd.b WHERE dd.a <> dd.b),
c0 AS MATERIALIZED (SELECT id, id AS c FROM p)"""]
    for i in range(rounds):
        parts.append(f"""b{i} AS MATERIALIZED (SELECT x.c, min(struct_pack(w := e.w, lo := least(e.a, e.b), hi := greatest(e.a, e.b))) AS m
  FROM e JOIN c{i} x ON x.id = e.a JOIN c{i} y ON y.id = e.b WHERE x.c <> y.c GROUP BY x.c)""")
        parts.append(f"""o{i} AS MATERIALIZED (SELECT b.c, CASE WHEN x.c = b.c THEN y.c ELSE x.c END AS o FROM b{i} b JOIN c{i} x ON x.id = b.m.lo JOIN c{i} y ON y.id = b.m.hi)""")
        parts.append(f"""r{i}_0 AS MATERIALIZED (SELECT s.c, CASE WHEN t.o = s.c AND s.c < s.o THEN s.c ELSE s.o END AS o FROM o{i} s JOIN o{i} t ON t.c = s.o)""")
        for j in range(10):
            parts.append(f"r{i}_{j + 1} AS MATERIALIZED (SELECT s.c, t.o FROM r{i}_{j} s JOIN r{i}_{j} t ON t.c = s.o)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.id, coalesce(r.o, c.c) AS c FROM c{i} c LEFT JOIN r{i}_10 r ON r.c = c.c)")
    picks = " UNION ".join(f"SELECT m FROM b{i}" for i in range(rounds))
    return "WITH " + ",\n".join(parts) + f"\nSELECT CAST(count(*) AS BIGINT) AS n_edges, round(sum(m.w), 6) AS total_weight FROM ({picks})"


@register("mst_total_weight", _mst_sql(HDB_MIN_SAMPLES))
def mst_total_weight_q(spark, sf):
    mst = hdbscan.mutual_reachability_mst(_vectors(spark, sf), min_samples=HDB_MIN_SAMPLES)
    return mst.agg(F.count(F.lit(1)).cast("long").alias("n_edges"), F.round(F.sum("w"), 6).alias("total_weight"))


@register("hdbscan")
def hdbscan_q(spark, sf):
    out, _ = hdbscan.hdbscan(_vectors(spark, sf), min_samples=5, min_cluster_size=8)
    return out


@register("hdbscan_cosine")
def hdbscan_cosine_q(spark, sf):
    out, _ = hdbscan.hdbscan(_vectors(spark, sf), min_samples=5, min_cluster_size=8, metric="cosine")
    return out


@register("core_distances_cosine", f"""
WITH p AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.row_id, CASE WHEN a.row_id = b.row_id THEN 0.0 ELSE 1.0 - list_cosine_similarity(a.v, b.v) END AS d FROM p a, p b),
r AS (SELECT row_id, d, row_number() OVER (PARTITION BY row_id ORDER BY d) AS k FROM d)
SELECT row_id, round(d, 6) AS core_distance FROM r WHERE k = {HDB_MIN_SAMPLES}""")
def core_distances_cosine_q(spark, sf):
    """Small blocks: many block pairs."""
    out = hdbscan.core_distances(_vectors(spark, sf), min_samples=HDB_MIN_SAMPLES, metric="cosine", block_size=64)
    return out.select("row_id", F.round("core_distance", 6).alias("core_distance"))


# ------------------------------------------------------------------ sweep
def _embedded_docs(spark, sf):
    emb = src.load_table(spark, sf, "embeddings")
    docs = src.load_text_table(spark, sf, "documents").select("doc_id", "lang", "text")
    return emb.join(docs, emb.vec_id == docs.doc_id).select(
        F.col("vec_id").alias("row_id"), F.col("lang").alias("label"), "text", "embedding")


@register("sweep")
def sweep_q(spark, sf):
    """Three algorithms over three reductions and two providers' vectors (the given ones and hashed words)."""
    given = _embedded_docs(spark, sf)
    docs = src.documents_by_lang(spark, sf)
    hashed, meta = embedding.run_embeddings(spark, docs, embed.LocalHashEmbedder(64, 42), "local", "hash-64", {}, _fresh_path(spark, "embed-cache"))
    algorithms = {"kmeans": {"n_clusters": 2, "n_init": 10}, "dbscan": {"eps": 0.2, "min_samples": 5}, "hdbscan": {"min_samples": 5, "min_cluster_size": 8}}
    specs = [embedding.ClusterSpec(a, p, 42, red, {}, 5) for red in ("pca", "kernel_pca", "svd") for a, p in algorithms.items()]
    tables = [(given, {"provider": "given", "provider_name": "given", "model": "given-64", "batch_size": 0, "limit": 0}), (hashed, meta)]
    flat = embedding.run_sweep(spark, tables, specs, _fresh_path(spark, "sweep"))
    return _r6(flat.withColumn("report_path", F.regexp_extract("report_path", "run_id=([^/]+)", 1)), "silhouette", "accuracy", "precision", "recall", "f1")
