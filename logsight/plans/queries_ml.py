"""Catalogue: classifier training/scoring, TF-IDF vocabulary, projection,
legacy forest, reliability check."""
from __future__ import annotations

from pyspark.ml.feature import IndexToString
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.lineparse import to_canonical_events
from logsight.operators import legacy as LG
from logsight.operators import model as M
from logsight.operators.clean import preprocess
from logsight.operators.evaluation import classification_report
from logsight.plans import sql_blocks as S
from logsight.plans.catalog import register
from logsight.plans.inputs import FIXTURE_YEAR, clean_lines, parsed_lines
from logsight.operators.quantiles import exact_quantiles
from logsight.session import read_table, stage
from logsight.sources.fixtures import log_lines

_CACHE: dict = {}


def labelled_events(spark, sf_dir):
    """Preprocessed fixture lines with their rule label as label_original, the columns
    of the classifier staged once. A line keeps its own label: the parse carries it along."""
    p = parsed_lines(spark, sf_dir).filter(F.col("row_id").isNotNull())
    canon = to_canonical_events(p, label="label")
    rows = M.trainable_rows(preprocess(canon, assume_year=FIXTURE_YEAR))
    return stage(rows.select("row_id", "label_original", C.TEXT_FEATURE, *C.MODEL_NUMERIC_FEATURES), "train")


def fitted(spark, sf_dir):
    """The model, its test rows, all rows and its training rows."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        data = labelled_events(spark, sf_dir)
        tr, te = M.stratified_split(data)
        _CACHE[key] = (M.train(tr), te, data, tr)
    return _CACHE[key]


def trained(spark, sf_dir):
    return fitted(spark, sf_dir)[:3]


@register("train_eval")
def q_train_eval(spark, sf_dir):
    """ML3-ML5 + AGG15: held-out per-class report of the fitted classifier."""
    model, test, _ = trained(spark, sf_dir)
    pred = IndexToString(inputCol="prediction", outputCol="predicted", labels=M.class_labels(model)).transform(
        M.predict(model, test))
    return classification_report(pred, "label_original", "predicted")


@register("score_events")
def q_score_events(spark, sf_dir):
    """ML6 + PRJ9: every row scored, confidence floor applied."""
    model, _, data = trained(spark, sf_dir)
    return M.score(model, data).select("row_id", "predicted_category", "confidence", "is_anomaly",
                                       "low_confidence")


_TERMS_SQL = f"""WITH {S.clean_events_cte(FIXTURE_YEAR)},
tok AS (SELECT row_id, regexp_extract_all(event_clean, '\\b\\w\\w+\\b', 0) AS t FROM clean
        WHERE length(event_clean) > 0),
terms AS (SELECT row_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
          AS term FROM tok),
n AS (SELECT count(*) AS n FROM tok)
SELECT term, count(DISTINCT row_id) AS df, round(ln((n + 1.0) / (count(DISTINCT row_id) + 1.0)), 6) AS idf
FROM terms, n GROUP BY term, n HAVING count(DISTINCT row_id) >= 2"""


@register("tfidf_terms", _TERMS_SQL)
def q_tfidf_terms(spark, sf_dir):
    """ML1 vocabulary: word 1+2-gram document frequency (minDF 2) and IDF."""
    from pyspark.ml.feature import NGram, RegexTokenizer
    df = M.trainable_rows(clean_lines(spark, sf_dir, with_features=False)).select("row_id", C.TEXT_FEATURE)
    tok = RegexTokenizer(inputCol=C.TEXT_FEATURE, outputCol="_w", pattern=M.WORD_PATTERN, gaps=False)
    grams = NGram(n=2, inputCol="_w", outputCol="_b").transform(tok.transform(df))
    # the empty term stands once in every row: its frequency is the number of rows
    each = F.concat(F.array_distinct(F.concat("_w", "_b")), F.array(F.lit("")))
    terms = stage(grams.select(F.explode(each).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    n_docs = terms.filter("term = ''").select(F.col("df").alias("n"))
    # n_docs is one row
    out = terms.filter((F.col("term") != "") & (F.col("df") >= 2)).crossJoin(F.broadcast(n_docs))
    return out.select("term", "df", F.round(F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)), 6).alias("idf"))


_WEIGHTS_SQL = f"""WITH {S.clean_events_cte(FIXTURE_YEAR)},
tok AS (SELECT row_id, regexp_extract_all(lower(event_clean), '\\b\\w\\w+\\b', 0) AS t FROM clean
        WHERE length(event_clean) > 0),
terms AS (SELECT row_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
          AS term FROM tok),
tf AS (SELECT row_id, term, count(*) AS tf FROM terms GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
x AS (SELECT row_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM tok)) / (1.0 + df)) + 1) AS x FROM tf JOIN d USING (term))
SELECT row_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY row_id)), 6) AS weight FROM x"""


@register("tfidf_weights", _WEIGHTS_SQL)
def q_tfidf_weights(spark, sf_dir):
    """ML1: sublinear, smoothed and normalised weights of every row's terms."""
    out = M.tfidf_weights(clean_lines(spark, sf_dir, with_features=False))
    return out.select("row_id", "term", F.round("weight", 6).alias("weight"))


@register("model_text_vectors", _WEIGHTS_SQL)
def q_model_text_vectors(spark, sf_dir):
    """ML1 / ML3: the word vectors that the fitted pipeline gives every row, read back as (row, term, weight);
    the vocabulary is wide enough here for all terms of the lines."""
    rows = M.word_ngrams(M.trainable_rows(clean_lines(spark, sf_dir, with_features=False)).select("row_id", C.TEXT_FEATURE))
    out = M.vector_terms(M.fit_word_block(rows, word_vocab=1 << 20), rows)
    return out.select("row_id", "term", F.round("weight", 6).alias("weight"))


_NUM = ("dst_port", "bytes", "ip_event_count", "ip_rate_1min", "ip_fail_ratio", "event_length")


@register("scaled_numeric", f"""WITH {S.features_cte(FIXTURE_YEAR)},
m AS (SELECT {', '.join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in _NUM)} FROM feat),
f AS (SELECT row_id, {', '.join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _NUM)} FROM feat, m)
SELECT row_id, {', '.join(f"round(({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () > 1e-9 THEN stddev_pop({c}) OVER () ELSE 1 END), 5) AS {c}" for c in _NUM)}
FROM f""")
def q_scaled_numeric(spark, sf_dir):
    """ML2: numeric features, nulls filled with the median, scaled to mean 0 and deviation 1."""
    data = stage(clean_lines(spark, sf_dir).select("row_id", *_NUM), "numeric")
    out = data
    for st in M.numeric_stages(M.numeric_scale(data, list(_NUM)))[:1]:
        out = st.transform(out)
    return out.select("row_id", *[F.round(f"_num_{c}", 5).alias(c) for c in _NUM])


_QUARTILES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "shipped")


@register("numeric_quantiles", "WITH l AS (SELECT *, epoch(l_shipdate::TIMESTAMP) AS shipped FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {f}), 6) AS q{int(100 * f)}" for f in (0.01, 0.25, 0.5, 0.75, 0.99)) + " FROM l"
    for c in _QUARTILES))
def q_numeric_quantiles(spark, sf_dir):
    """AGG9 / ML2: exact quantiles of many columns of the largest table together, by narrowing brackets."""
    fractions = (0.01, 0.25, 0.5, 0.75, 0.99)
    table = read_table(spark, sf_dir, "lineitem").withColumn("shipped", F.expr("unix_date(CAST(l_shipdate AS DATE)) * 86400.0D"))
    found = exact_quantiles(table, list(_QUARTILES), fractions)
    rows = [(c, *[None if q is None else round(q, 6) for q in found[c]]) for c in _QUARTILES]
    return spark.createDataFrame(rows, "field string, " + ", ".join(f"q{int(100 * f)} double" for f in fractions))


@register("split_counts", f"""WITH {S.LINES_CTE}
SELECT label, count(*) - CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS train_rows,
       CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test_rows FROM lines GROUP BY label""")
def q_split_counts(spark, sf_dir):
    """ML4: rows of each class on either side of the exact stratified split."""
    tr, te = M.stratified_split(log_lines(spark, sf_dir).select("row_id", "label"), "label")
    both = tr.withColumn("t", F.lit(0)).unionByName(te.withColumn("t", F.lit(1)))
    return both.groupBy("label").agg(F.count_if(F.col("t") == 0).alias("train_rows"), F.count_if(F.col("t") == 1).alias("test_rows"))


@register("reliability", f"""WITH {S.features_cte(FIXTURE_YEAR)}
SELECT avg(CASE WHEN trim(coalesce(event_clean, '')) = '' AND ip_unique_ports = 0 AND ip_fail_ratio = 0
                 AND has_sql_tokens = 0 AND has_priv_tokens = 0
                 AND has_malware_tokens = 0 THEN 1.0 ELSE 0.0 END) AS unreliable_share,
       avg(CASE WHEN trim(coalesce(event_clean, '')) = '' AND ip_unique_ports = 0 AND ip_fail_ratio = 0
                 AND has_sql_tokens = 0 AND has_priv_tokens = 0
                 AND has_malware_tokens = 0 THEN 1.0 ELSE 0.0 END) > 0.9 AS warning
FROM feat""")
def q_reliability(spark, sf_dir):
    """AGG14 over the behavioural features."""
    return M.reliability_warning(clean_lines(spark, sf_dir))


@register("pca_2d")
def q_pca_2d(spark, sf_dir):
    """ML7: 2-D projection of all rows."""
    model, _, data = trained(spark, sf_dir)
    return M.project_2d(M.score(model, data))


@register("legacy_forest")
def q_legacy_forest(spark, sf_dir):
    """ML8L + ML9L: random forest over the eight legacy features; per-row
    class probability map."""
    kw = LG.parse_lines_keywords(log_lines(spark, sf_dir))
    feats = LG.extract_features(kw).join(
        log_lines(spark, sf_dir).select(F.col("row_id").alias("line_number"), "label"), "line_number")
    feats = stage(feats, "legacy-features")
    cols = ["hour", "day_of_week", "is_weekend", "ip_first_octet", "ip_second_octet", "attack_keyword_count",
            "has_attack_keywords", "line_length"]
    model = M.numeric_forest(feats, cols, "label", trees=50, depth=10)
    out = M.class_probabilities(model, feats)
    labels = model.stages[0].labels
    return out.select("line_number", "label", F.element_at(F.array(*[F.lit(x) for x in labels]),
                                                           F.col("prediction").cast("int") + 1).alias("predicted"),
                      "class_probabilities")


@register("analyse_categories")
def q_analyse_categories(spark, sf_dir):
    """PIPE2 + PIPE3: raw lines -> preprocess -> classifier -> severity ->
    statistics; returns the category breakdown of the staged scored table."""
    from logsight.plans.analyse import analyse
    from logsight.plans.inputs import canonical_lines
    model, _, _ = trained(spark, sf_dir)
    result = analyse(canonical_lines(spark, sf_dir), model, assume_year=FIXTURE_YEAR, with_report=False)
    return result.figures["category_breakdown"]


@register("model_card")
def q_model_card(spark, sf_dir):
    """SNK4: metrics record of the fitted classifier."""
    model, test, _, train_df = fitted(spark, sf_dir)
    return M.model_card(model, train_df, test)


_CHAR_SQL = f"""WITH {S.clean_events_cte(FIXTURE_YEAR)},
w AS (SELECT row_id, ' ' || unnest(list_filter(regexp_split_to_array(event_clean, '\\s+'), lambda x: x <> '')) || ' '
             AS pw FROM clean WHERE length(event_clean) > 0),
g AS (SELECT row_id, unnest(flatten(list_transform(range(3, 6), lambda n: list_transform(
             range(1, length(pw) - n + 2), lambda i: substr(pw, i, n))))) AS gram FROM w)
SELECT gram, count(DISTINCT row_id) AS df FROM g GROUP BY gram HAVING count(DISTINCT row_id) >= 3"""


@register("char_ngrams", _CHAR_SQL)
def q_char_ngrams(spark, sf_dir):
    """STR11 + ML1: character 3-5-grams inside space-padded words, document
    frequency (minDF 3) — the char_wb vocabulary of the classifier."""
    df = M.trainable_rows(clean_lines(spark, sf_dir, with_features=False)).select("row_id", C.TEXT_FEATURE)
    grams = df.select("row_id", F.explode(F.array_distinct(F.expr(M.char_wb_expr(C.TEXT_FEATURE)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= 3)
