"""Phase 3-4 queries: features, the classifier, scoring and metrics.

Fixture F2 (documents; class = language). The model used by the scoring queries is
one AdaGrad step from zero over all training rows: its weights are plain SQL
(w = -eta * g / sqrt(g^2 + eps) with g the mean gradient at sigmoid(0) = 0.5), so
DuckDB can check scoring end to end. Floats are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import features as FE
from ..operators import metrics as MT
from ..operators import model as MD
from ..session import scratch_path
from ..sources.store import VersionedStore
from . import oracle as Q
from .catalog import query

ETA, EPS, SEED, SHARE = MD.ETA, MD.EPS, 42, 0.2


def _r6(c):
    return F.round(c, 6) + F.lit(0.0)


# -- Spark side --------------------------------------------------------------------

def _docs(fx) -> DataFrame:
    """F2 with training text and row id."""
    return C.with_row_id(C.build_text(fx.labeled_text))


def _with_split(fx) -> DataFrame:
    return FE.stratified_holdout(_docs(fx), "category", "row_id", SHARE, SEED)


def _one_step(train: DataFrame) -> MD.Model:
    return MD.full_refit(train, steps=1)


def _scored(docs: DataFrame, model: MD.Model) -> DataFrame:
    return MD.score_ovr(docs.select("row_key", "text"), model, keep_text=False)


def _long(df: DataFrame, model: MD.Model, arr: str, out: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in model.classes])
    return df.select("row_key", F.posexplode(arr).alias("i", "v")).select(
        "row_key", F.element_at(names, F.col("i") + 1).alias("category"), _r6(F.col("v")).alias(out))


# -- SQL side ----------------------------------------------------------------------

_DOCS = f"""docs AS (
  SELECT row_key, {Q.text_of()} AS text, {Q.clean_field('category')} AS category,
         {Q.row_id_of(Q.text_of(), Q.clean_field('category'))} AS row_id
  FROM labeled_text)"""


def _feats(name: str, src: str, key: str, bits: int = 20) -> str:
    """CTE ``name``(key, bucket, x) of the texts in ``src``."""
    return f"""{name}_t AS (
  SELECT {key}, {Q.tokens_of('text')} AS t FROM {src}),
{name}_g AS (
  SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g
  FROM {name}_t),
{name}_tf AS (SELECT {key}, {Q.bucket_of('g', bits)} AS bucket, count(*) AS tf FROM {name}_g GROUP BY 1, 2),
{name} AS (
  SELECT {key}, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {key})) AS x FROM {name}_tf)"""


_SPLIT = f"""pairs AS (SELECT DISTINCT category, row_id FROM docs),
ranked AS (
  SELECT category, row_id,
         row_number() OVER (PARTITION BY category ORDER BY md5('{SEED}:' || row_id), row_id) AS pos,
         count(*) OVER (PARTITION BY category) AS n
  FROM pairs),
split AS (
  SELECT category, row_id, CASE WHEN pos <= round(n * {SHARE}) THEN 'test' ELSE 'train' END AS split
  FROM ranked)"""


def _step_sql(train_src: str, bits: int = 20) -> str:
    """CTEs of the one-step model trained on ``train_src`` (text, category, row_id):
    classes(class_id, cls), wt(bucket, class_id, cls, w), bias(class_id, cls, b)."""
    return f"""trows AS (
  SELECT row_id, min(text) AS text, min(category) AS category, count(*) AS weight
  FROM {train_src} GROUP BY row_id),
{_feats('tfeats', 'trows', 'row_id', bits)},
classes AS (
  SELECT category AS cls, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS class_id
  FROM (SELECT DISTINCT category FROM trows)),
ntot AS (SELECT sum(weight) AS n FROM trows),
resid AS (
  SELECT row_id, class_id, cls, (0.5 - CASE WHEN category = cls THEN 1.0 ELSE 0.0 END) * weight AS r
  FROM trows CROSS JOIN classes),
grad AS (
  SELECT bucket, class_id, cls, sum(x * r) / (SELECT n FROM ntot) AS g
  FROM tfeats JOIN resid USING (row_id) GROUP BY 1, 2, 3),
wt AS (SELECT bucket, class_id, cls, -{ETA} * g / sqrt(g * g + {EPS}) AS w FROM grad),
bias AS (
  SELECT class_id, cls, -{ETA} * g / sqrt(g * g + {EPS}) AS b
  FROM (SELECT class_id, cls, sum(r) / (SELECT n FROM ntot) AS g FROM resid GROUP BY 1, 2))"""


def _steps_sql(train_src: str, steps: int) -> str:
    """CTEs as of :func:`_step_sql` after ``steps`` steps from zero: wt and bias hold the last
    step's weights; every step is a CTE of its own."""
    one = _step_sql(train_src)
    cut = one.index("wt AS (")
    out = [one[:cut] + f"""w1 AS MATERIALIZED (SELECT bucket, class_id, cls, g * g AS q, -{ETA} * g / sqrt(g * g + {EPS}) AS w FROM grad),
b1 AS MATERIALIZED (SELECT class_id, cls, g * g AS q, -{ETA} * g / sqrt(g * g + {EPS}) AS b
  FROM (SELECT class_id, cls, sum(r) / (SELECT n FROM ntot) AS g FROM resid GROUP BY 1, 2))"""]
    for i in range(2, steps + 1):
        out.append(f"""d{i} AS MATERIALIZED (SELECT row_id, class_id, sum(x * w) AS m FROM tfeats JOIN w{i - 1} USING (bucket) GROUP BY 1, 2),
r{i} AS MATERIALIZED (
  SELECT t.row_id, c.class_id, c.cls,
         (1.0 / (1.0 + exp(-(coalesce(d.m, 0.0) + c.b))) - CASE WHEN t.category = c.cls THEN 1.0 ELSE 0.0 END) * t.weight AS r
  FROM trows t CROSS JOIN b{i - 1} c LEFT JOIN d{i} d ON d.row_id = t.row_id AND d.class_id = c.class_id),
g{i} AS MATERIALIZED (SELECT bucket, class_id, sum(x * r) / (SELECT n FROM ntot) AS g FROM tfeats JOIN r{i} USING (row_id) GROUP BY 1, 2),
u{i} AS MATERIALIZED (SELECT bucket, class_id, p.cls, p.w, p.q, coalesce(g, 0.0) + {MD.ALPHA} * p.w AS g FROM w{i - 1} p LEFT JOIN g{i} USING (bucket, class_id)),
w{i} AS MATERIALIZED (SELECT bucket, class_id, cls, q + g * g AS q, w - {ETA} * g / sqrt(q + g * g + {EPS}) AS w FROM u{i}),
b{i} AS MATERIALIZED (
  SELECT p.class_id, p.cls, p.q + s.g * s.g AS q, p.b - {ETA} * s.g / sqrt(p.q + s.g * s.g + {EPS}) AS b
  FROM b{i - 1} p JOIN (SELECT class_id, sum(r) / (SELECT n FROM ntot) AS g FROM r{i} GROUP BY 1) s USING (class_id))""")
    out.append(f"wt AS (SELECT bucket, class_id, cls, w FROM w{steps}), bias AS (SELECT class_id, cls, b FROM b{steps})")
    return ",\n".join(out)


def _score_sql(src: str, bits: int = 20) -> str:
    """CTEs scoring the rows of ``src`` (row_key, text) with the step model:
    marg(row_key, class_id, cls, m), prob(row_key, class_id, cls, p)."""
    return f"""{_feats('sfeats', src, 'row_key', bits)},
dots AS (SELECT row_key, class_id, sum(x * w) AS m FROM sfeats JOIN wt USING (bucket) GROUP BY 1, 2),
marg AS (
  SELECT s.row_key, c.class_id, c.cls, coalesce(dots.m, 0.0) + bias.b AS m
  FROM {src} s CROSS JOIN classes c JOIN bias ON bias.class_id = c.class_id
  LEFT JOIN dots ON dots.row_key = s.row_key AND dots.class_id = c.class_id),
sig AS (SELECT *, 1.0 / (1.0 + exp(-m)) AS s FROM marg),
prob AS (SELECT row_key, class_id, cls, s / sum(s) OVER (PARTITION BY row_key) AS p FROM sig),
ranked_p AS (
  SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY p DESC, class_id) AS rank FROM prob)"""


def _model_sql(*tail: str) -> str:
    return Q.with_fixtures(["labeled_text"], _DOCS, _step_sql("docs"), _score_sql("docs"), *tail)


# -- O36 ---------------------------------------------------------------------------
@query("tokenize_ngrams", Q.with_fixtures(["labeled_text"], _DOCS, f"""
toks AS (SELECT row_key, {Q.tokens_of('text')} AS t FROM docs)""") + """
SELECT row_key, token, count(*) AS n FROM (
  SELECT row_key, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS token
  FROM toks) g
GROUP BY 1, 2""")
def tokenize_ngrams(fx):
    return FE.tokenize_ngrams(_docs(fx), "row_key", counted=True)


# -- O37 ---------------------------------------------------------------------------
@query("hashed_tf", Q.with_fixtures(["labeled_text"], _DOCS, _feats("f", "docs", "row_key")) + """
SELECT row_key, bucket, tf FROM f_tf""")
def hashed_tf(fx):
    return FE.hashed_tf(_docs(fx), "row_key")


# -- O38 ---------------------------------------------------------------------------
@query("l2_normalize", Q.with_fixtures(["labeled_text"], _DOCS, _feats("f", "docs", "row_key")) + """
SELECT row_key, bucket, round(x, 6) + 0.0 AS x FROM f""")
def l2_normalize(fx):
    return FE.l2_normalize(FE.hashed_tf(_docs(fx), "row_key", rows=True), "row_key").select("row_key", "bucket", _r6(F.col("x")).alias("x"))


# -- O43 ---------------------------------------------------------------------------
@query("stratified_holdout", Q.with_fixtures(["labeled_text"], _DOCS, _SPLIT) + """
SELECT row_key, split FROM docs JOIN split USING (category, row_id)""")
def stratified_holdout(fx):
    return _with_split(fx).select("row_key", "split")


@query("stable_holdout", Q.with_fixtures(["labeled_text"], _DOCS) + f""",
seen AS (SELECT DISTINCT category, row_id, md5('{SEED}:' || row_id) AS h,
                category IN ('en', 'fr') AND substr(row_id, 1, 1) < '8' AS early FROM docs),
firsts AS (SELECT * FROM seen WHERE early OR category NOT IN (SELECT category FROM seen WHERE early)),
placed AS (
  SELECT category, h, row_number() OVER (PARTITION BY category ORDER BY h, row_id) AS pos,
         round(count(*) OVER (PARTITION BY category) * {SHARE}) AS held FROM firsts),
limits AS (
  SELECT category, CASE WHEN max(held) = 0 THEN least(min(h), '33333333') ELSE min(h) FILTER (pos > held) END AS threshold
  FROM placed GROUP BY category)
SELECT row_key, CASE WHEN md5('{SEED}:' || row_id) < threshold THEN 'test' ELSE 'train' END AS split
FROM docs JOIN limits USING (category)""")
def stable_holdout(fx):
    """Thresholds of a first delta, stored, then those of labels a second delta brings."""
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    docs = _docs(fx)
    early = F.col("category").isin("en", "fr") & (F.col("row_id").substr(1, 1) < "8")
    for delta in (docs.filter(early), docs):
        made = FE.holdout_thresholds(delta, store.load_holdout(), test_size=SHARE, seed=SEED)
        store.publish_tables({"holdout": made}, "holdout")
    return FE.stable_holdout(docs, store.load_holdout(), seed=SEED).select("row_key", "split")


# -- O40 ---------------------------------------------------------------------------
@query("register_classes", Q.with_fixtures(["labeled_text"], _DOCS) + """
SELECT CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS class_id, category
FROM (SELECT DISTINCT category FROM docs WHERE category IS NOT NULL)""")
def register_classes(fx):
    return MD.class_table(_docs(fx))


# -- O39 ---------------------------------------------------------------------------
@query("ovr_step", Q.with_fixtures(["labeled_text"], _DOCS, _step_sql("docs")) + """
SELECT bucket, cls AS category, round(w, 6) + 0.0 AS w FROM wt
UNION ALL SELECT -1, cls, round(b, 6) + 0.0 FROM bias""")
def ovr_step(fx):
    return _weights_long(fx, _one_step(_docs(fx)))


def _weights_long(fx, m: MD.Model) -> DataFrame:
    w = m.long_weights().select("bucket", m.class_name(F.col("class_id")).alias("category"), _r6(F.col("w")).alias("w"))
    bias = fx.spark.createDataFrame([(-1, c, float(b)) for c, b in zip(m.classes, m.intercept)],
                                    "bucket int, category string, w double")
    return w.unionByName(bias.select("bucket", "category", _r6(F.col("w")).alias("w")))


@query("ovr_two_steps", Q.with_fixtures(["labeled_text"], _DOCS, _steps_sql("docs", 2)) + """
SELECT bucket, cls AS category, round(w, 6) + 0.0 AS w FROM wt
UNION ALL SELECT -1, cls, round(b, 6) + 0.0 FROM bias""")
def ovr_two_steps(fx):
    """A step that starts from existing weights."""
    rows = MD.group_copies(_docs(fx))
    first = MD.ovr_step(rows, MD.empty_model(fx.spark, MD.register_classes(rows)))
    return _weights_long(fx, MD.ovr_step(rows, first))


# -- O45 ---------------------------------------------------------------------------
@query("score_ovr", _model_sql() + """
SELECT row_key, cls AS category, round(p, 6) + 0.0 AS prob FROM prob""")
def score_ovr(fx):
    docs = _docs(fx)
    m = _one_step(docs)
    return _long(_scored(docs, m), m, "prob", "prob")


# -- O46 ---------------------------------------------------------------------------
@query("softmax_scores", _model_sql() + """
SELECT row_key, cls AS category, round(e / sum(e) OVER (PARTITION BY row_key), 6) + 0.0 AS prob
FROM (SELECT row_key, cls, exp(m - max(m) OVER (PARTITION BY row_key)) AS e FROM marg) t""")
def softmax_scores(fx):
    docs = _docs(fx)
    m = _one_step(docs)
    sc = MD.softmax_scores(MD.score_margins(docs.select("row_key", "text"), m, keep_text=False), "m", "sm")
    return _long(sc, m, "sm", "prob")


# -- O47 ---------------------------------------------------------------------------
@query("top_k_categories", _model_sql() + """
SELECT row_key, rank, cls AS category, round(p, 6) + 0.0 AS prob FROM ranked_p WHERE rank <= 3""")
def top_k_categories(fx):
    docs = _docs(fx)
    m = _one_step(docs)
    sc = MD.top_k_categories(_scored(docs, m), m, 3)
    return sc.select("row_key", F.posexplode("top").alias("i", "t")).select(
        "row_key", (F.col("i") + 1).cast("long").alias("rank"), F.col("t.category").alias("category"),
        _r6(F.col("t.prob")).alias("prob"))


# -- O48 ---------------------------------------------------------------------------
_BATCH_COLS = """row_key,
  max(CASE WHEN rank = 1 THEN cls END) AS category,
  max(CASE WHEN rank = 1 THEN cls END) AS top1, round(max(CASE WHEN rank = 1 THEN p END), 6) + 0.0 AS p1,
  max(CASE WHEN rank = 2 THEN cls END) AS top2, round(max(CASE WHEN rank = 2 THEN p END), 6) + 0.0 AS p2,
  max(CASE WHEN rank = 3 THEN cls END) AS top3, round(max(CASE WHEN rank = 3 THEN p END), 6) + 0.0 AS p3"""


@query("score_batch", _model_sql() + f"""
SELECT {_BATCH_COLS} FROM ranked_p GROUP BY row_key""")
def score_batch(fx):
    docs = _docs(fx)
    m = _one_step(docs)
    sc, _rej = MD.score_batch(fx.labeled_text, m, "row_key")
    out = [F.col("row_key"), F.col("category")]
    for i in range(3):
        out += [F.col("top")[i]["category"].alias(f"top{i + 1}"),
                _r6(F.col("top")[i]["prob"]).alias(f"p{i + 1}")]
    return sc.select(*out)


# -- O32 ---------------------------------------------------------------------------
@query("suggestion_chips", _model_sql() + """
SELECT row_key, string_agg(cls, '|' ORDER BY rank) AS chips FROM ranked_p WHERE rank <= 3 GROUP BY row_key""")
def suggestion_chips(fx):
    from ..operators.sets import suggestion_chips as chips
    docs = _docs(fx)
    m = _one_step(docs)
    sc, _rej = MD.score_batch(fx.labeled_text, m, "row_key")
    return chips(sc, "category", "top").select("row_key", F.array_join("chips", "|").alias("chips"))


# -- O44 / O49 (train split -> test split) -----------------------------------------
def _holdout_scored(fx):
    d = _with_split(fx)
    train = d.filter(F.col("split") == "train")
    test = d.filter(F.col("split") == "test")
    m = _one_step(train)
    return d, MD.score_ovr(test.select("row_key", "text", "category"), m, keep_text=False), m


def _holdout_sql(model: str) -> str:
    return Q.with_fixtures(
        ["labeled_text"], _DOCS, _SPLIT,
        """train_docs AS (SELECT d.* FROM docs d JOIN split s USING (category, row_id) WHERE s.split = 'train')""",
        """test_docs AS (SELECT d.* FROM docs d JOIN split s USING (category, row_id) WHERE s.split = 'test')""",
        model, _score_sql("test_docs"),
        """pred AS (SELECT r.row_key, r.cls AS predicted, t.category
                   FROM ranked_p r JOIN test_docs t USING (row_key) WHERE rank = 1)""")


_HOLDOUT = _holdout_sql(_step_sql("train_docs"))


@query("evaluate", _HOLDOUT + """
SELECT CASE WHEN (SELECT count(*) FROM docs) >= 10 AND (SELECT count(DISTINCT category) FROM docs) >= 2
            THEN round(avg(CASE WHEN predicted = category THEN 1.0 ELSE 0.0 END), 6) + 0.0 ELSE 0.0 END AS accuracy,
       count(*) AS n, (SELECT count(DISTINCT category) FROM docs) AS classes
FROM pred""")
def evaluate(fx):
    d, scored, _m = _holdout_scored(fx)
    ev = MD.evaluate(scored, "category", "predicted", guard=d)
    return ev.select(_r6(F.col("accuracy")).alias("accuracy"), "n", "classes")


@query("class_metrics", _HOLDOUT + """,
conf AS (SELECT category AS l, predicted AS p, count(*) AS c FROM pred GROUP BY 1, 2),
per AS (
  SELECT cls AS category,
         coalesce((SELECT sum(c) FROM conf WHERE l = cls), 0) AS support,
         coalesce((SELECT sum(c) FROM conf WHERE l = cls AND p = cls), 0) AS tp,
         coalesce((SELECT sum(c) FROM conf WHERE p = cls), 0) AS pn
  FROM (SELECT DISTINCT l AS cls FROM conf UNION SELECT DISTINCT p FROM conf))
SELECT category, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp,
       CAST(pn - tp AS BIGINT) AS fp, CAST(support - tp AS BIGINT) AS fn,
       round(CASE WHEN pn > 0 THEN tp / pn ELSE 0 END, 6) + 0.0 AS precision,
       round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) + 0.0 AS recall,
       round(CASE WHEN pn > 0 AND support > 0 AND tp > 0
                  THEN 2 * (tp / pn) * (tp / support) / ((tp / pn) + (tp / support)) ELSE 0 END, 6) + 0.0 AS f1
FROM per""")
def class_metrics(fx):
    _d, scored, _m = _holdout_scored(fx)
    cm = MD.class_metrics(scored, "category", "predicted")
    return cm.select("category", "support", "tp", "fp", "fn",
                     *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


# -- O50 ---------------------------------------------------------------------------
_LEARNED = """learned AS (
  SELECT DISTINCT d.row_id FROM docs d JOIN labels l ON l.doc_id = d.row_key WHERE l.quality = 1)"""


@query("run_metrics", Q.with_fixtures(["labeled_text"], _DOCS, _LEARNED) + """
SELECT count(*) AS rows_read,
       count(*) FILTER (WHERE length(text) > 0 AND length(category) > 0) AS rows_valid,
       count(DISTINCT row_id) AS distinct_ids,
       count(*) FILTER (WHERE row_id NOT IN (SELECT row_id FROM learned)) AS rows_new,
       count(DISTINCT category) AS classes
FROM docs""")
def run_metrics(fx):
    docs = _docs(fx)
    learned = (docs.join(fx.t.labels.filter(F.col("quality") == 1)
                         .select(F.col("doc_id").alias("row_key")), "row_key", "left_semi")
               .select("row_id"))
    return MT.run_metrics(docs, learned)


# -- O52 ---------------------------------------------------------------------------
@query("acceptance_rate", Q.with_fixtures(["user_labels"]) + """
SELECT predicted AS category, count(*) AS labels,
       round(avg(CASE WHEN predicted = chosen_cat THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acceptance
FROM user_labels GROUP BY predicted""")
def acceptance_rate(fx):
    return MT.acceptance_rate(fx.user_labels, ["predicted"]).select(
        F.col("predicted").alias("category"), "labels", _r6(F.col("acceptance")).alias("acceptance"))


@query("acceptance_rate_missing", Q.with_fixtures(["user_labels_bad"]) + """
SELECT predicted AS category, count(*) AS labels,
       round(avg(CASE WHEN predicted = chosen_cat THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acceptance
FROM user_labels_bad GROUP BY predicted""")
def acceptance_rate_missing(fx):
    """Labels without a prediction count as not accepted."""
    return MT.acceptance_rate(fx.user_labels_bad, ["predicted"]).select(
        F.col("predicted").alias("category"), "labels", _r6(F.col("acceptance")).alias("acceptance"))


@query("acceptance_rate_daily", Q.with_fixtures(["user_labels"]) + """
SELECT CAST(created_at AS DATE) AS day, count(*) AS labels,
       round(avg(CASE WHEN predicted = chosen_cat THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS acceptance
FROM user_labels GROUP BY 1""")
def acceptance_rate_daily(fx):
    lab = fx.user_labels.withColumn("day", F.to_date("created_at"))
    return MT.acceptance_rate(lab, ["day"]).select(
        "day", "labels", _r6(F.col("acceptance")).alias("acceptance"))


# -- O53 ---------------------------------------------------------------------------
@query("user_timeline", Q.with_fixtures(["user_labels_x"]) + """
SELECT user_id, id, chosen_cat, rank FROM (
  SELECT user_id, id, chosen_cat,
         row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank
  FROM user_labels_x) t WHERE rank <= 5""")
def user_timeline(fx):
    return MT.user_timeline(fx.user_labels_x, 5).select("user_id", "id", "chosen_cat", "rank")


@query("user_expenses", Q.with_fixtures(["expenses"]) + """
SELECT expense_id, expense_date, amount FROM expenses
WHERE user_id = 10 AND expense_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'""")
def user_expenses(fx):
    return MT.user_expenses(fx.expenses, 10, "1994-01-01", "1996-12-31").select("expense_id", "expense_date", "amount")


@query("labels_of", Q.with_fixtures(["expenses", "user_labels_x"]) + """
SELECT id, expense_id, chosen_cat FROM user_labels_x
WHERE expense_id IN (SELECT expense_id FROM expenses WHERE amount > 100000)""")
def labels_of(fx):
    return MT.labels_of(fx.user_labels_x, fx.expenses.filter(F.col("amount") > 100000)).select("id", "expense_id", "chosen_cat")


# -- O27 over the row's own chips --------------------------------------------------
@query("match_chips", _model_sql(f"""
chips AS (SELECT row_key, list(cls ORDER BY rank) AS chips FROM ranked_p WHERE rank <= 3 GROUP BY row_key),
typed AS (SELECT row_key, chips, ' ' || upper(category) || chr(160) AS category FROM chips JOIN labeled_text USING (row_key))""") + f"""
SELECT row_key, coalesce(list_filter(chips, lambda c: {Q.normalized('c')} = {Q.normalized('category')})[1],
                         {Q.collapse_keep_case('category')}) AS category FROM typed""")
def match_chips(fx):
    from ..operators import sets as S
    docs = _docs(fx)
    sc, _rej = MD.score_batch(fx.labeled_text, _one_step(docs), "row_key")
    typed = fx.labeled_text.select("row_key", F.concat(F.lit(" "), F.upper("category"), F.lit("\u00a0")).alias("typed"))
    rows = S.suggestion_chips(sc, "category", "top").select("row_key", "chips").join(typed, "row_key")
    return S.match_chips(rows, "typed").select("row_key", F.col("typed").alias("category"))


# -- O39 / O45 with many classes ---------------------------------------------------
_MANY_BITS = 16
_VENDOR_ROWS = f"""vrows AS (
  SELECT expense_id AS row_key, {Q.text_of()} AS text, {Q.clean_field('vendor')} AS category,
         {Q.row_id_of(Q.text_of(), Q.clean_field('vendor'))} AS row_id FROM expenses)"""


_PAIR_ROWS = f"""prows AS (
  SELECT expense_id AS row_key, {Q.text_of()} AS text, {Q.clean_field("vendor || ' / ' || category")} AS category,
         {Q.row_id_of(Q.text_of(), Q.clean_field("vendor || ' / ' || category"))} AS row_id FROM expenses)"""


@query("ovr_update_blocks", Q.with_fixtures(["expenses"], _PAIR_ROWS, _steps_sql("prows", 2)) + """
SELECT bucket, count(*) AS classes, round(sum(w), 6) + 0.0 AS total, round(sum(w * w), 6) + 0.0 AS squares
FROM wt GROUP BY bucket
UNION ALL SELECT -1, count(*), round(sum(b), 6) + 0.0, round(sum(b * b), 6) + 0.0 FROM bias""")
def ovr_update_blocks(fx):
    """Every vendor and category a class (hundreds), 2^20 buckets, an update from existing
    weights; the weights are joined by shuffle, in blocks of classes."""
    pairs = fx.expenses.withColumn("category", F.concat_ws(" / ", "vendor", "category"))
    rows = MD.group_copies(C.with_row_id(C.build_text(pairs)))
    empty = MD.empty_model(fx.spark, MD.register_classes(rows), broadcast_bytes=0)
    m = MD.ovr_step(rows, MD.ovr_step(rows, empty))
    w = m.long_weights().select("bucket", "w").unionByName(
        fx.spark.createDataFrame([(-1, float(b)) for b in m.intercept], "bucket int, w double"))
    return w.groupBy("bucket").agg(F.count("*").alias("classes"), _r6(F.sum("w")).alias("total"),
                                   _r6(F.sum(F.col("w") * F.col("w"))).alias("squares"))


@query("score_many_classes", Q.with_fixtures(["expenses"], _VENDOR_ROWS, _step_sql("vrows", _MANY_BITS), _score_sql("vrows", _MANY_BITS)) + """
SELECT row_key, round(max(p), 6) + 0.0 AS best, count(*) AS classes FROM prob GROUP BY row_key""")
def score_many_classes(fx):
    """Every vendor a class; the weights are joined by shuffle, in blocks of classes."""
    rows = C.build_text(fx.expenses.withColumn("category", F.col("vendor")))
    rows = C.with_row_id(rows)
    m = MD.fit(MD.group_copies(rows), MD.empty_model(fx.spark, MD.register_classes(rows), _MANY_BITS, broadcast_bytes=0), 1)
    sc = MD.score_ovr(rows.select(F.col("expense_id").alias("row_key"), "text"), m, keep_text=False)
    return sc.select("row_key", _r6(F.array_max("prob")).alias("best"), F.size("prob").cast("long").alias("classes"))
