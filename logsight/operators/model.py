"""Event classifier with Spark ML (ML1-ML9).

Feature plan (one ``Pipeline``): word 1+2-gram counts (tokens of two or more
word characters) and character 3-5-grams inside space-padded words, each
through ``CountVectorizer`` (minDF; the vocabulary size is an option) -> term
frequency 1 + ln(tf) (``SublinearTF``) -> inverse document frequency ln((n+1)/(df+1)) + 1 -> L2 ``Normalizer``; twelve numeric
behavioural features filled with their median and scaled by the population's
deviation; everything assembled into one vector for a multinomial
``LogisticRegression`` (``regParam = 1 / (C * n)`` matches an
inverse-regularisation strength ``C``). n-grams are built with SQL
higher-order functions, so no Python runs per row.

``tfidf_weights`` has the weights of the word block as rows, computed by joins;
``vector_terms`` reads the same rows back from the fitted model's vectors.
"""
from __future__ import annotations

from pyspark import SparkContext, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (IDF, PCA, CountVectorizer, ElementwiseProduct, HashingTF, IndexToString, NGram,
                                Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.operators.quantiles import exact_quantiles
from logsight.operators.severity import apply_confidence_floor
from logsight.session import stage

WORD_PATTERN = r"(?U)\b\w\w+\b"


def char_wb_expr(col: str = "event_clean", lo: int = 3, hi: int = 5) -> str:
    """SQL: character n-grams (lo..hi) inside each whitespace-separated word
    padded with one space on both sides; a padded word of length n < hi
    yields itself once for that n."""
    # a word is padded once, not for each of its n-grams
    return (f"flatten(transform(transform(filter(split(coalesce({col}, ''), '\\\\s+'), w -> w != ''), w -> concat(' ', w, ' ')), p -> "
            f"flatten(transform(sequence({lo}, {hi}), n -> CASE WHEN length(p) >= n THEN "
            f"transform(sequence(1, length(p) - n + 1), i -> substring(p, i, n)) ELSE array() END))))")


def wrap_vector(parts: Column) -> Column:
    """The inverse of ``unwrap_udt``: the struct of a vector's parts as a vector, null as null. A vector
    column holds that very struct, so a call that returns its argument is given the vector's type."""
    jvm = SparkContext._active_spark_context._jvm
    columns = jvm.org.apache.spark.sql.classic.ExpressionUtils
    none = jvm.PythonUtils.toSeq([])
    call = jvm.org.apache.spark.sql.catalyst.expressions.objects.StaticInvoke(
        jvm.java.lang.Class.forName("java.util.Objects"), jvm.org.apache.spark.ml.linalg.SQLDataTypes.VectorType(),
        "requireNonNull", jvm.PythonUtils.toSeq([columns.expression(parts._jc)]), none, True, True, True,
        jvm.scala.Option.empty())
    return Column(columns.column(call))


class SublinearTF(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term frequencies tf -> 1 + ln(tf) on a vector column; sparse vectors stay sparse.

    Built-in functions only, and no text in between: the weighed parts are the vector.
    A null vector stays null, an absent term (0) stays 0."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = F.unwrap_udt(F.col(self.getInputCol()))
        weights = F.transform(parts["values"], lambda tf: F.when(tf > 0, 1 + F.log(tf)).otherwise(F.lit(0.0)))
        return dataset.withColumn(self.getOutputCol(), wrap_vector(parts.withField("values", weights)))


#: The SQL stage of the word block.
WORD_TERMS_SQL = "SELECT *, concat(_words, _bigrams) AS _word_terms FROM __THIS__"


def text_stages(col: str = C.TEXT_FEATURE, word_min_df: float = 2, word_vocab: int = 20000,
                char_min_df: float = 3, char_vocab: int = 15000) -> list:
    """ML1: word and char_wb TF-IDF blocks, L2-normalised."""
    return [
        RegexTokenizer(inputCol=col, outputCol="_words", pattern=WORD_PATTERN, gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_words", outputCol="_bigrams"),
        SQLTransformer(statement=f"SELECT *, concat(_words, _bigrams) AS _word_terms, "
                                 f"{char_wb_expr(col)} AS _char_terms FROM __THIS__"),
        CountVectorizer(inputCol="_word_terms", outputCol="_word_tf", minDF=word_min_df, vocabSize=word_vocab),
        SublinearTF(inputCol="_word_tf", outputCol="_word_ltf"),
        IDF(inputCol="_word_ltf", outputCol="_word_tfidf"),
        Normalizer(inputCol="_word_tfidf", outputCol="word_features", p=2.0),
        CountVectorizer(inputCol="_char_terms", outputCol="_char_tf", minDF=char_min_df, vocabSize=char_vocab),
        SublinearTF(inputCol="_char_tf", outputCol="_char_ltf"),
        IDF(inputCol="_char_ltf", outputCol="_char_tfidf"),
        Normalizer(inputCol="_char_tfidf", outputCol="char_features", p=2.0),
    ]


def numeric_scale(df: DataFrame, features: list[str] = C.MODEL_NUMERIC_FEATURES) -> dict[str, tuple[float, float, float]]:
    """ML2: (median, mean, standard deviation) per feature, of the column after
    the median has filled its nulls; the deviation is the population's. A feature without
    values is constant 0. Mean and deviation follow from one aggregate of sums, the
    medians from ``exact_quantiles`` of all columns together."""
    medians = exact_quantiles(df, list(features))
    x = {c: F.col(c).cast("double") for c in features}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in features:
        aggs += [F.count(x[c]).alias(f"{c}__n"), F.avg(x[c]).alias(f"{c}__avg"), F.var_pop(x[c]).alias(f"{c}__var")]
    row = df.agg(*aggs).first()
    out = {}
    for c in features:
        n, k = row["_n"], row[f"{c}__n"]
        if not k:
            out[c] = (0.0, 0.0, 1.0)
            continue
        med, avg, var = medians[c][0] or 0.0, row[f"{c}__avg"], row[f"{c}__var"]
        mean = (k * avg + (n - k) * med) / n
        spread = (k * (var + (avg - mean) ** 2) + (n - k) * (med - mean) ** 2) / n
        out[c] = (med, mean, spread ** 0.5 if spread > 1e-18 else 1.0)
    return out


def numeric_stages(scale: dict[str, tuple[float, float, float]]) -> list:
    """ML2: median imputation and standard scaling as one SQL projection."""
    cols = ", ".join(f"(coalesce(CAST({c} AS DOUBLE), {med!r}D) - {mean!r}D) / {std!r}D AS _num_{c}"
                     for c, (med, mean, std) in scale.items())
    return [SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_num_{c}" for c in scale], outputCol="num_features", handleInvalid="keep")]


def tfidf_weights(df: DataFrame, text: str = C.TEXT_FEATURE, id_col: str = "row_id", min_df: int = 2) -> DataFrame:
    """ML1 as rows: (row_id, term, weight) of the word 1+2-grams, with term
    frequency 1 + ln(tf), inverse document frequency ln((1 + n) / (1 + df)) + 1, and rows of
    length 1. The number of rows with text travels with the terms as a term of its own."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD_PATTERN), 0)
    rows = trainable_rows(df).select(id_col, words.alias("_w"))
    pairs = F.when(F.size("_w") > 1, F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(
        " ", F.element_at("_w", i), F.element_at("_w", i + 1)))).otherwise(F.array().cast("array<string>"))
    terms = rows.select(id_col, F.explode(F.concat(F.col("_w"), pairs, F.array(F.lit("")))).alias("term"))
    tf = stage(terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = df_.filter("term = ''").agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]
    known = df_.filter((F.col("term") != "") & (F.col("df") >= min_df))
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1
    raw = tf.join(known, "term").withColumn("_x", (1 + F.log(F.col("tf"))) * idf)
    # a partition is the terms of one row
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(id_col)))
    return raw.filter(F.col(id_col).isNotNull()).select(id_col, "term", (F.col("_x") / length).alias("weight"))


def build_pipeline(n_train: int, scale: dict[str, tuple[float, float, float]], inverse_reg: float = 5.0,
                   max_iter: int = 2000, label: str = "label_original") -> Pipeline:
    """ML3: text + numeric features -> multinomial logistic regression."""
    indexer = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc",
                            handleInvalid="error")
    lr = LogisticRegression(featuresCol="features", labelCol="label_idx", family="multinomial",
                            regParam=1.0 / (inverse_reg * max(n_train, 1)), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-4)
    return Pipeline(stages=[indexer] + text_stages() + numeric_stages(scale) + [
        VectorAssembler(inputCols=["word_features", "char_features", "num_features"], outputCol="features"),
        lr])


def stratified_split(df: DataFrame, label: str = "label_original", test_fraction: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """ML4: deterministic split, exact per class: of the n rows of a class the
    round(n * test_fraction) with the lowest seeded hash of their row id are the test rows.

    The rows are numbered by (class, hash) in range partitions, so a class that holds a third of
    the rows is many partitions; the class sizes are a handful of counts."""
    from logsight.sources.rowid import dense_numbers
    name = F.coalesce(F.col(label), F.lit("")).alias("_label")
    keys = stage(df.select("row_id", name, F.xxhash64(F.col("row_id"), F.lit(seed)).alias("_u")), "split")
    counts = keys.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).orderBy("_label").collect()
    before, rows = 0, []
    for r in counts:
        rows.append((r["_label"], before, int(r["n"] * test_fraction + 0.5)))
        before += r["n"]
    limits = df.sparkSession.createDataFrame(rows, "_label string, _before long, _test long")
    numbered = dense_numbers(keys, ["_label", "_u", "row_id"], "_no").join(F.broadcast(limits), "_label")  # a row per class
    test = stage(numbered.filter(F.col("_no") <= F.col("_before") + F.col("_test")).select("row_id"), "test-rows")
    return df.join(test, "row_id", "left_anti"), df.join(test, "row_id", "left_semi")


def trainable_rows(df: DataFrame) -> DataFrame:
    """FLT4: rows with non-empty cleaned text."""
    return df.filter(F.length(F.coalesce(F.col(C.TEXT_FEATURE), F.lit(""))) > 0)


def train(df: DataFrame, label: str = "label_original", inverse_reg: float = 5.0,
          max_iter: int = 2000) -> PipelineModel:
    """ML5: fit the pipeline. The count of the rows sets the regularisation. The rows
    are written once: the count, the medians and the n-grams would each split them anew."""
    df = stage(df.select(label, C.TEXT_FEATURE, *C.MODEL_NUMERIC_FEATURES), "train-rows")
    stages = build_pipeline(df.count(), numeric_scale(df), inverse_reg, max_iter, label).getStages()
    indexer = stages[0].fit(df)
    text, tokens = _fit_text(stages[1:-1], indexer.transform(df))
    # the solver and its summary read the finished vectors, not the chain that makes them
    vectors = stage(PipelineModel(text[N_PREP:]).transform(tokens).select("label_idx", "features"), "train-vectors")
    return PipelineModel([indexer] + text + [stages[-1].fit(_indexed(vectors, indexer))])


#: Stages of ``text_stages`` that only make n-grams: tokenizer, bigrams, n-gram SQL.
N_PREP = 3


def _indexed(vectors: DataFrame, indexer) -> DataFrame:
    """The label column with the indexer's labels in its metadata, which a written table may not keep."""
    meta = {"ml_attr": {"vals": list(indexer.labels), "type": "nominal", "name": "label_idx"}}
    return vectors.withColumn("label_idx", F.col("label_idx").alias("label_idx", metadata=meta))


def _fit_text(stages: list, df: DataFrame) -> tuple[list, DataFrame]:
    """Fit ``text_stages`` (and the stages behind them) one by one. The n-grams are written once, if ``df`` does not
    have them, so the vocabulary and frequency passes do not rebuild them. Returns the fitted stages and the written n-grams."""
    tokens = df
    if "_word_terms" not in df.columns:
        # the words, the pairs and the text are parts of the n-grams by now
        tokens = stage(PipelineModel(stages[:N_PREP]).transform(df).drop("_words", "_bigrams", C.TEXT_FEATURE), "train-terms")
    fitted, data = list(stages[:N_PREP]), tokens
    for st in stages[N_PREP:]:
        if isinstance(st, IDF):
            # inverse document frequency ln((n + 1) / (df + 1)) + 1; a term has a weight where it has
            # a count, so the rows are counted by the counts, without weighing them first
            counts = st.getInputCol().replace("_ltf", "_tf")
            idf = st.copy({st.inputCol: counts}).fit(data).idf
            model = ElementwiseProduct(inputCol=st.getInputCol(), outputCol=st.getOutputCol(),
                                       scalingVec=Vectors.dense(idf.toArray() + 1.0))
        else:
            model = st.fit(data) if hasattr(st, "fit") else st
        fitted.append(model)
        data = model.transform(data)
    return fitted, tokens


def word_ngrams(df: DataFrame, col: str = C.TEXT_FEATURE) -> DataFrame:
    """The word n-grams of each row, made and written once, for ``fit_word_block`` and ``vector_terms``."""
    made = PipelineModel(_word_block()[:N_PREP]).transform(df)
    return stage(made.drop("_words", "_bigrams", col), "word-terms")


def _word_block(word_min_df: float = 2, word_vocab: int = 20000) -> list:
    """The stages of ``text_stages`` that the word block needs; the character n-grams are not made for it."""
    block = [st for st in text_stages(word_min_df=word_min_df, word_vocab=word_vocab)
             if not (st.hasParam("outputCol") and st.getOrDefault("outputCol").startswith(("_char", "char")))]
    block[N_PREP - 1] = SQLTransformer(statement=WORD_TERMS_SQL)
    return block


def fit_word_block(df: DataFrame, word_min_df: float = 2, word_vocab: int = 20000) -> PipelineModel:
    """ML1: the word block of the classifier alone, fitted on texts or on their ``word_ngrams``."""
    return PipelineModel(_fit_text(_word_block(word_min_df, word_vocab), df)[0])


def vector_terms(model: PipelineModel, df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(row, term, weight): the entries of the word vectors that ``model`` gives the rows of ``df`` (texts, or
    their ``word_ngrams``), by the fitted vocabulary (whose size is a bound of the model, so it is broadcast)."""
    words = next(st for st in model.stages if st.hasParam("vocabSize") and st.getOrDefault("outputCol") == "_word_tf")
    last = next(k for k, st in enumerate(model.stages) if st.hasParam("outputCol")
                and st.isDefined("outputCol") and st.getOrDefault("outputCol") == "word_features")
    first = next(k for k, st in enumerate(model.stages) if isinstance(st, RegexTokenizer))
    first += N_PREP if "_word_terms" in df.columns else 0
    rows = PipelineModel(model.stages[first:last + 1]).transform(df)
    parts = F.unwrap_udt(F.col("word_features"))
    entries = rows.select(id_col, F.explode(F.arrays_zip(parts["indices"].alias("i"), parts["values"].alias("x"))).alias("e"))
    names = df.sparkSession.createDataFrame(list(enumerate(words.vocabulary)), "i int, term string")
    return (entries.select(id_col, F.col("e.i").alias("i"), F.col("e.x").alias("weight"))
                   .join(F.broadcast(names), "i").select(id_col, "term", "weight"))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The fitted stages but for the label's indexer: rows may have no label, or a new one."""
    return PipelineModel(model.stages[1:]).transform(df)


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def score(model: PipelineModel, df: DataFrame,
          threshold: float = C.CONFIDENCE_ANOMALY_THRESHOLD) -> DataFrame:
    """ML6 + PRJ9: per row the arg-max class and its probability (4 dp), then
    the confidence floor. Missing numeric features are filled with 0."""
    for c in C.MODEL_NUMERIC_FEATURES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    out = predict(model, df)
    probs = vector_to_array(F.col("probability"))
    labels = IndexToString(inputCol="prediction", outputCol="predicted_category", labels=class_labels(model))
    out = labels.transform(out).withColumn("confidence", F.array_max(probs))
    drop = [c for c in out.columns if c.startswith("_") or c in (
        "word_features", "char_features", "num_features", "features", "rawPrediction", "probability",
        "prediction", "label_idx")]
    return apply_confidence_floor(out.drop(*drop), "predicted_category", "confidence", threshold)


def class_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """ML9L: map class -> probability (4 dp) per row."""
    out = predict(model, df)
    probs = F.transform(vector_to_array(F.col("probability")), lambda p: F.round(p, 4))
    return out.withColumn("class_probabilities", F.map_from_arrays(
        F.array(*[F.lit(x) for x in class_labels(model)]), probs))


def reliability_warning(scored: DataFrame, share: float = 0.9) -> DataFrame:
    """AGG14: share of rows with blank text and all-zero per-IP/token
    features; warns above ``share``. Features that are at least 1 for any row
    of an IP (its events, its rate, its users, of which "" is one) say nothing and are left out."""
    zero = [c for c in C.MODEL_NUMERIC_FEATURES
            if c.startswith(("ip_", "has_")) and c not in ("ip_event_count", "ip_rate_1min", "ip_unique_users")]
    blank = F.trim(F.coalesce(F.col(C.TEXT_FEATURE), F.lit(""))) == ""
    cond = blank
    for c in zero:
        cond = cond & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return (scored.agg(F.avg(cond.cast("double")).alias("unreliable_share"))
                  .withColumn("warning", F.col("unreliable_share") > share))


def project_2d(scored: DataFrame, buckets: int = 512, sample_rows: int | None = None, seed: int = 0) -> DataFrame:
    """ML7: 2-D PCA over word TF-IDF and raw numeric features, fitted on all
    rows and applied to all. Terms are hashed into ``buckets``, so none is left out.
    ``sample_rows`` thins the points of a plot, not the fit.

    The rows and their vectors are written once: the frequencies, the passes of the
    fit and the projection would each score every row anew."""
    scored = stage(scored.select("row_id", "predicted_category", C.TEXT_FEATURE, *C.MODEL_NUMERIC_FEATURES), "projected-rows")
    num = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS _n_{c}" for c in C.MODEL_NUMERIC_FEATURES)
    feats = Pipeline(stages=[
        RegexTokenizer(inputCol=C.TEXT_FEATURE, outputCol="_w", pattern=WORD_PATTERN, gaps=False),
        NGram(n=2, inputCol="_w", outputCol="_b"),
        SQLTransformer(statement=f"SELECT *, concat(_w, _b) AS _t, {num} FROM __THIS__"),
        HashingTF(inputCol="_t", outputCol="_tf", numFeatures=buckets),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_text"),
        VectorAssembler(inputCols=["_text"] + [f"_n_{c}" for c in C.MODEL_NUMERIC_FEATURES],
                        outputCol="_x", handleInvalid="keep"),
    ])
    vectors = stage(feats.fit(scored).transform(scored).select("row_id", "predicted_category", "_x"), "projected-vectors")
    pca = PCA(k=2, inputCol="_x", outputCol="_pc").fit(vectors)
    if sample_rows is not None:
        vectors = vectors.orderBy(F.xxhash64(F.col("row_id"), F.lit(seed))).limit(sample_rows)
    xy = vector_to_array(F.col("_pc"))
    return pca.transform(vectors).select("row_id", F.round(xy[0], 3).alias("x"), F.round(xy[1], 3).alias("y"),
                                         F.col("predicted_category").alias("category"))


def numeric_forest(df: DataFrame, features: list[str], label: str = "label", trees: int = 50,
                   depth: int = 10, seed: int = 42) -> PipelineModel:
    """ML8L: scaled numeric features -> random forest with balanced class
    weights (weights from one grouped count of a handful of classes)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total, k = sum(counts.values()), len(counts)
    weight = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(total / (k * n)))])
    weighted = df.withColumn("_w", weight[F.col(label)])
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features"),
        RandomForestClassifier(featuresCol="features", labelCol="label_idx", weightCol="_w",
                               numTrees=trees, maxDepth=depth, seed=seed),
    ])
    return pipe.fit(weighted)


def save_model(model: PipelineModel, path: str) -> str:
    """SNK3."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """SNK3: an absent model is an explicit error; any other error stays itself."""
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # noqa: BLE001
        if any(w in str(exc) for w in ("does not exist", "PATH_NOT_FOUND", "NoSuchFile", "FileNotFound")):
            raise FileNotFoundError(f"no trained model at {path}: train one first") from exc
        raise


def model_card(model: PipelineModel, train_df: DataFrame, test_df: DataFrame, label: str = "label_original",
               data_source: str = "", trained_at: str | None = None) -> DataFrame:
    """SNK4: one-row metrics record — accuracy, per-class precision / recall /
    F1 / support, row counts, features, where the data came from and when it was
    trained — ready to write as JSON."""
    from logsight.operators.evaluation import classification_report
    pred = IndexToString(inputCol="prediction", outputCol="_pred", labels=class_labels(model)).transform(
        predict(model, test_df))
    # the report and the accuracy read the same predictions: the model runs once
    pred = stage(pred.select(F.col(label), "_pred"), "card-predictions")
    per_class = classification_report(pred, label, "_pred", digits=3)
    acc = pred.agg(F.round(F.avg((F.col(label) == F.col("_pred")).cast("double")), 4).alias("accuracy"),
                   F.count(F.lit(1)).alias("test_rows"))
    classes = per_class.agg(F.sort_array(F.collect_list(F.struct("class", "precision", "recall", "f1",
                                                                 "support"))).alias("per_class"))
    n_train = train_df.agg(F.count(F.lit(1)).alias("train_rows"))
    one = [acc, classes, n_train]
    out = one[0].withColumn("_k", F.lit(1))
    for o in one[1:]:
        # each side is a single-row global aggregate
        out = out.join(o.withColumn("_k", F.lit(1)), "_k")
    return (out.drop("_k")
               .withColumn("model", F.lit("TF-IDF (word 1-2g + char_wb 3-5g) + scaled numeric + LogisticRegression"))
               .withColumn("numeric_features", F.array(*[F.lit(c) for c in C.MODEL_NUMERIC_FEATURES]))
               .withColumn("text_feature", F.lit(C.TEXT_FEATURE))
               .withColumn("corpus_rows", F.col("train_rows") + F.col("test_rows"))
               .withColumn("data_source", F.lit(data_source))
               .withColumn("trained_at", F.lit(trained_at) if trained_at else F.date_format(
                   F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")))
