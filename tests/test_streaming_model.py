"""Streaming equals batch; classifier invariants."""
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.plans import queries_ml as QM
from logsight.plans import queries_stream as QS
from logsight.plans.inputs import parsed_lines
from logsight.functions.timestamps import normalise_timestamp

SMOKE = "/root/testdata/sf0.001"


def test_stream_parse_equals_batch(spark):
    s = QS.q_stream_parse(spark, SMOKE).select("ts_raw", "src_ip", "event", "ts_sec")
    b = parsed_lines(spark, SMOKE).select("ts_raw", F.coalesce("src_ip", F.lit("unknown")).alias("src_ip"),
                                          F.coalesce("event", F.lit("")).alias("event"),
                                          normalise_timestamp("ts_raw", 2026).alias("ts_sec"))
    # every tenth line is delivered twice
    twice = parsed_lines(spark, SMOKE).filter("row_id % 10 = 0").count()
    assert sorted(s.distinct().collect(), key=repr) == sorted(b.distinct().collect(), key=repr)
    assert twice > 0 and s.count() == b.count() + twice


def test_classifier_accuracy_and_invariants(spark):
    rep = {r["class"]: r for r in QM.q_train_eval(spark, SMOKE).collect()}
    total = sum(r["support"] for r in rep.values())
    correct = sum(r["recall"] * r["support"] for r in rep.values())
    assert correct / total > 0.90
    sc = QM.q_score_events(spark, SMOKE)
    lo, hi = sc.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.0 <= lo <= hi <= 1.0
    cats = {r[0] for r in sc.select("predicted_category").distinct().collect()}
    assert cats <= set(C.ATTACK_CATEGORIES + [C.NORMAL_LABEL])


def test_class_probabilities_of_both_models(spark):
    from logsight.operators import model as M
    model, test, _ = QM.trained(spark, SMOKE)
    rows = M.class_probabilities(model, test.drop("label_original")).select("class_probabilities").limit(20).collect()
    labels = set(M.class_labels(model))
    assert all(set(r[0]) == labels and abs(sum(r[0].values()) - 1) < 0.01 for r in rows)


def test_split_is_exact_and_disjoint(spark):
    from logsight.operators import model as M
    df = spark.range(1000).selectExpr("id AS row_id", "CASE WHEN id % 10 = 0 THEN 'rare' ELSE 'often' END AS label")
    tr, te = M.stratified_split(df, "label")
    assert {r["label"]: r["count"] for r in te.groupBy("label").count().collect()} == {"rare": 20, "often": 180}
    assert tr.count() == 800 and tr.join(te, "row_id").count() == 0


def test_reliability_fires_on_blank_rows(spark):
    from logsight.operators import model as M
    cols = {c: 1.0 if c in ("ip_event_count", "ip_rate_1min", "ip_unique_users") else 0.0 for c in C.MODEL_NUMERIC_FEATURES}
    blank = spark.range(20).select(F.lit("  ").alias(C.TEXT_FEATURE), *[F.lit(v).alias(c) for c, v in cols.items()])
    assert M.reliability_warning(blank).first()["warning"]
    some = blank.withColumn(C.TEXT_FEATURE, F.lit("failed login"))
    assert not M.reliability_warning(blank.unionByName(some)).first()["warning"]


def test_absent_model_is_named(spark, tmpdir_path):
    import pytest
    from logsight.operators import model as M
    with pytest.raises(FileNotFoundError):
        M.load_model(tmpdir_path + "/none")


def test_sublinear_vectors_equal_plain_weights(spark):
    """The fitted word block against plain Python: 1 + ln tf, smoothed inverse frequency, rows of length 1."""
    import math
    import re
    from collections import Counter
    from logsight.operators import model as M
    texts = ["fail fail fail login root", "login root", "", "fail login", "x", "root root login fail port"]
    df = spark.createDataFrame(list(enumerate(texts)), f"row_id long, {C.TEXT_FEATURE} string")
    grams = []
    for t in texts:
        w = re.findall(r"\b\w\w+\b", t)
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    n_of = Counter(g for c in grams for g in c)
    want = {}
    for i, c in enumerate(grams):
        x = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + n_of[g])) + 1) for g, n in c.items() if n_of[g] >= 2}
        size = math.sqrt(sum(v * v for v in x.values()))
        want |= {(i, g): round(v / size, 9) for g, v in x.items()}
    got = {(r["row_id"], r["term"]): round(r["weight"], 9) for r in M.vector_terms(M.fit_word_block(df), df).collect()}
    assert got == want and max(len(c) for c in grams) > 3


def test_sublinear_of_null_dense_and_sparse_vectors(spark):
    import math
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructField, StructType
    from logsight.operators import model as M
    rows = [(Vectors.sparse(4, [1, 3], [1.0, 5.0]),), (Vectors.dense([0.0, 2.0]),), (Vectors.sparse(4, [], []),), (None,)]
    df = spark.createDataFrame(rows, StructType([StructField("tf", VectorUDT())]))
    out = [r["w"] for r in M.SublinearTF(inputCol="tf", outputCol="w").transform(df).collect()]
    assert out == [Vectors.sparse(4, [1, 3], [1.0, 1 + math.log(5)]), Vectors.dense([0.0, 1 + math.log(2)]),
                   Vectors.sparse(4, [], []), None]


def test_weights_have_rows_of_length_one(spark):
    from logsight.operators import model as M
    df = spark.createDataFrame([(1, "fail login root"), (2, "fail login"), (None, "fail root"), (3, "fail root root")],
                               f"row_id long, {C.TEXT_FEATURE} string")
    out = M.tfidf_weights(df)
    assert {r["row_id"]: round(r["n"], 9) for r in out.groupBy("row_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()} == {1: 1.0, 2: 1.0, 3: 1.0}
    # the terms are weighed and normed in one pass, without a join back by row
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_projection_and_analysis_read_written_scores(spark, monkeypatch):
    from logsight.operators import model as M
    from logsight.plans import analyse as A
    from logsight.plans.inputs import FIXTURE_YEAR, canonical_lines
    model, _, _ = QM.trained(spark, SMOKE)
    seen = []
    plain = A.assign_severity
    monkeypatch.setattr(A, "assign_severity", lambda df: seen.append(df) or plain(df))
    result = A.analyse(canonical_lines(spark, SMOKE), model, assume_year=FIXTURE_YEAR, with_report=False)
    # a bare scan: the severity's two readings do not run the model
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("UDF") == 0
    points = M.project_2d(result.scored)
    assert points.count() == result.scored.count()
    assert "event_clean" not in points._jdf.queryExecution().optimizedPlan().toString()


def test_char_ngrams_pad_a_word_once(spark):
    from logsight.operators import model as M
    assert M.char_wb_expr("t").count("concat(") == 1
    df = spark.createDataFrame([("a\U0001F600b  c",), (" x\tlogin\n",), ("",), (None,), ("é",)], "t string")
    got = [r["g"] for r in df.select(F.expr(M.char_wb_expr("t")).alias("g")).collect()]
    words = [["a\U0001F600b", "c"], ["x", "login"], [], [], ["é"]]
    assert got == [[f" {w} "[i:i + n] for w in ws for n in (3, 4, 5) for i in range(len(w) + 3 - n)] for ws in words]


def test_word_block_makes_no_character_ngrams(spark):
    from logsight.operators import model as M
    df = spark.createDataFrame([(1, "fail login root"), (2, "fail login fail"), (3, "root root")], f"row_id long, {C.TEXT_FEATURE} string")
    model = M.fit_word_block(df)
    assert "_char_terms" not in model.transform(df).columns
    made = M.word_ngrams(df)
    assert made.columns == ["row_id", "_word_terms"]
    rows = lambda m, d: sorted(map(tuple, M.vector_terms(m, d).collect()))
    assert rows(M.fit_word_block(made), made) == rows(model, df) != []


def test_the_written_ngrams_carry_no_texts(spark):
    from logsight.operators import model as M
    df = spark.createDataFrame([(1, "fail login"), (2, "fail root")], f"row_id long, {C.TEXT_FEATURE} string")
    stages, tokens = M._fit_text(M.text_stages(char_min_df=1, word_min_df=1), df)
    assert tokens.columns == ["row_id", "_word_terms", "_char_terms"]
    # the frequencies are those of the weighed terms: "fail" stands in both rows, the others in one
    import math
    weights = next(st for st in stages if st.hasParam("scalingVec")).getScalingVec().toArray()
    assert sorted(round(float(w), 9) for w in weights) == [1.0] + [round(math.log(1.5) + 1, 9)] * 4


def test_report_runs_its_predictions_once(spark):
    from logsight.operators.evaluation import classification_report
    runs = spark.sparkContext.accumulator(0)

    def guess(x):
        runs.add(1)
        return "ab"[x % 2]
    df = spark.range(20).selectExpr("int(id) AS x", "CASE WHEN id < 4 THEN NULL WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS label")
    out = classification_report(df.withColumn("p", F.udf(guess, "string")("x")), "label", "p").collect()
    assert runs.value == 20
    assert sorted((r["class"] or "", r["precision"], r["recall"], r["support"]) for r in out) == [
        ("", 0.0, 0.0, 4), ("a", 0.3, 0.6, 5), ("b", 0.6, 0.545455, 11)]


def test_sublinear_weights_pass_through_no_text(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructField, StructType
    from logsight.operators import model as M
    v = [Vectors.sparse(3, [0, 2], [1.0, 1e300]), Vectors.dense([0.1, 2.0]), None]
    df = spark.createDataFrame([(x,) for x in v], StructType([StructField("tf", VectorUDT())]))
    out = M.SublinearTF(inputCol="tf", outputCol="w").transform(df)
    assert "json" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.schema["w"].dataType == VectorUDT()
    # the parts alone, as they are, make the same vector
    assert [r["w"] for r in df.select(M.wrap_vector(F.unwrap_udt("tf")).alias("w")).collect()] == v


def test_lines_are_parsed_once_with_their_labels(spark, monkeypatch):
    import pytest
    lines = spark.createDataFrame([(1, "seen at 1786320000 Failed password for bob from 10.0.0.1", "Brute Force"),
                                   (2, "no label here", None), (None, "no id", "Normal"),
                                   (3, "seen at 1786320001 Accepted password for bob from 10.0.0.2", "Normal")],
                                  "row_id long, value string, label string")
    from logsight.functions.lineparse import parse_lines
    monkeypatch.setattr(QM, "parsed_lines", lambda *a: parse_lines(lines))
    seen = []

    def stop(df, **kw):
        seen.append(df)
        raise InterruptedError
    monkeypatch.setattr(QM, "preprocess", stop)
    with pytest.raises(InterruptedError):
        QM.labelled_events(spark, SMOKE)
    got = {r["row_id"]: r["label_original"] for r in seen[0].collect()}
    assert got == {1: "Brute Force", 2: None, 3: "Normal"}
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_the_fit_reads_written_rows(spark, monkeypatch):
    import pytest
    from logsight.operators import model as M
    cols = {c: F.col("id").cast("double") for c in C.MODEL_NUMERIC_FEATURES}
    df = spark.range(20).select(F.col("id").alias("row_id"), F.lit("a").alias("label_original"),
                                F.lit("failed login").alias(C.TEXT_FEATURE), *[v.alias(c) for c, v in cols.items()])
    tr, _ = M.stratified_split(df)
    seen = []

    def stop(df, *a):
        seen.append(df)
        raise InterruptedError
    monkeypatch.setattr(M, "numeric_scale", stop)
    with pytest.raises(InterruptedError):
        M.train(tr)
    # the passes of the fit do not split the rows again
    assert seen[0].count() == 16 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_model_card_does_not_split_again(spark, monkeypatch):
    from logsight.operators import model as M
    _, test, data = QM.trained(spark, SMOKE)

    def again(*a, **kw):
        raise AssertionError("split again")
    monkeypatch.setattr(M, "stratified_split", again)
    card = QM.q_model_card(spark, SMOKE).first()
    assert card["test_rows"] == test.count() and card["corpus_rows"] == data.count()
