"""The stages against plain versions of their rules, each on its own input."""
import importlib

import brute
from logsight.session import read_table

SMOKE = "/root/testdata/sf0.001"


def test_stages(spark, tmpdir_path):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = read_table(spark, SMOKE, "documents")
    bench = [(r.item_id, r.text) for r in read_table(spark, SMOKE, "benchmark").collect()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMOKE).write.parquet(f"{tmpdir_path}/{k}")
        out = spark.read.parquet(f"{tmpdir_path}/{k}")
        before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, out))
        rows = [(i, r.text) for i, r in before.items()]
        if k < 4:
            assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality rules":
            failed = {i for i, t in rows if (m := brute.measures(t))[0] < 20 or 100 * m[4] > 30 * m[0]}
            assert not failed & set(after)
            want = {i: text for i, _, kept, text in brute.line_rule([(i, r.source, r.text) for i, r in before.items()])[1] if kept}
            assert {i: r.text for i, r in after.items()} == want
        elif name == "near-copies":
            assert set(after) == {i for i, _, least in brute.simhash(rows) if i == least}
        elif name == "benchmark passages":
            assert set(after) == {r[0] for r in brute.contamination(rows, bench) if not r[5]}
        elif name == "personal data":
            assert set(after) == set(before) and not any(brute.personal(r.text) for r in after.values())
        else:
            got = sorted((r.doc_id, r.piece, r.length) for r in out.collect())
            from public_tokenizers import path
            from tokenizers import Tokenizer

            want = brute.token_pieces(Tokenizer.from_file(path("word_bpe_49k.json")), rows)
            assert got == sorted((i, p, n) for i, p, _, n, _ in want)
        docs = out


def test_run_is_the_stages(spark, tmpdir_path):
    """run() gives the rows that the stages give one after the other, each of which is held against its plain version above."""
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "near-copies", "benchmark passages", "personal data", "packing"]
    docs = read_table(spark, SMOKE, "documents")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SMOKE).write.parquet(f"{tmpdir_path}/{k}")
        docs = spark.read.parquet(f"{tmpdir_path}/{k}")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = [sorted(map(tuple, d.select(*columns).collect())) for d in (pipeline.run(spark, SMOKE), docs)]
    assert rows[0] == rows[1] and len(rows[0]) > 100
