import importlib.util
import os
import random
import re
import subprocess
import sys

import corpus_pipeline
import pytest
from common import brute_classes, frame, invented, words
from oracle import rows_of, rows_of_sql
from test_language import text

from velado.llm.registry import QUERIES, SQL

HOME = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.fixture
def tables(spark, tmp_path):
    rnd = random.Random(5)
    item = invented(rnd, 20)
    rows = [(k, text(rnd, ("en", "fr", "de")[k % 3], rnd.randrange(20, 90)), ("en", "fr", "de")[k % 3]) for k in range(90)]
    rows += [(200, None, "en"), (201, "123 456", "fr"), (202, "  ", None)]
    rows += [(300 + k, rows[k][1] + ("  " if k == 3 else ""), "en") for k in range(8)]
    w = (rows[20][1] + " " + rows[23][1]).split()
    rows.append((400, " ".join(w), "de"))
    rows.append((401, " ".join([*w[:-1], "changed"]), "de"))
    rows.append((500, f"{rows[30][1]} {item.upper()} {rows[33][1]}", "en"))
    d = str(tmp_path)
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, [r[:2] for r in rows], item


def test_stages_equal_brute_force(spark, tables):
    d, rows, item = tables
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = {}
    for k, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), k, t))
    rows = sorted((k, t) for _, k, t in map(min, groups.values()))
    rows = [r for r, c in zip(rows, brute_classes(rows), strict=True) if r[0] == c]
    wins = {tuple(w[i : i + 8]) for w in [words(item)] for i in range(len(w) - 7)}
    rows = [r for r in rows if not any(tuple(w[i : i + 8]) in wins for w in [words(r[1])] for i in range(len(w) - 7))]
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted(r.doc_id for r in got) == [k for k, _ in rows]
    assert all(r.round_trip and r.n_tokens > 0 for r in got)
    assert 303 in {r.doc_id for r in got} and not {3, 401, 500, 200, 201, 202} & {r.doc_id for r in got}


def test_stages_keep_columns(spark, tables):
    d, *_ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_empty_documents(spark, tables, tmp_path):
    d, *_ = tables
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0


def test_the_rest_does_without(tmp_path):
    """Without the folders of the corpus operators and the pipeline the entry module still imports."""
    names = [x for x in os.listdir(HOME) if x not in (".git", "corpus_pipeline.py", "tests", "velado")]
    for x in names:
        os.symlink(f"{HOME}/{x}", tmp_path / x)
    os.mkdir(tmp_path / "velado")
    for x in os.listdir(f"{HOME}/velado"):
        if x != "llm":
            os.symlink(f"{HOME}/velado/{x}", tmp_path / "velado" / x)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mask_email' in q and 'pipeline' not in q and not [x for x in q if x[:2] == 'op']; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    assert importlib.util.find_spec("velado.llm")


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(SQL[name], sf_dir)


def test_registered_queries_run(spark, sf_dir):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, f in QUERIES.items():
        assert f(spark, sf_dir).count() == n, name


def test_short_items(spark, tmp_path):
    """One item of fewer than eight words is no reason to drop a document; two are, and so is a window of a longer one."""
    d = str(tmp_path)
    spark.createDataFrame([(1, "common phrase"), (2, "Other one"), (3, "a b c d e f g h i"), (None, "q r s t u v w x"), (4, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(1, "with a common phrase in it"), (2, "the common phrase, and other one"), (3, "so: B C D E F G H I."), (4, "a b c d e f g"), (5, "q r s t u v w x"), (6, None)]
    docs = frame(spark, rows)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, d).collect()) == [1, 4, 6]


def test_the_last_stage_keeps_ids(spark, tables):
    import zlib

    import numpy as np
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = frame(spark, [(1, "one two"), (2, ""), (3, None)])
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, tables[0]).collect()}
    assert got[1].ids == model.encode("one two") and got[2].ids == got[3].ids == []
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got.values())
