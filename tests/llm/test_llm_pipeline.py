"""The pipeline's stages against plain versions, and the package's separation."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.llm import private_data
from tidemark.llm.queries import QUERIES, tokenizer_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: clean, toxic, copied and near-copied documents, and one with a card number."""
    root = str(tmp_path_factory.mktemp("corpus"))
    clean = [f"{chr(97 + i % 26)}{i}".join([" "] * 2) + " ".join(f"w{(i * 37 + k * k) % 991}" for k in range(40)) for i in range(120)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(clean)]
    rows += [(200 + i, clean[i] + " vile nasty", "en", "s1") for i in range(0, 60)]
    rows += [(300, clean[5], "en", "s2"), (301, clean[5].replace("w", "w", 1) + " tail", "en", None), (302, None, "en", "s0"),
             (303, "pay 4111 1111 1111 1111 now " + " ".join(f"c{k}" for k in range(30)), "en", "s3")]
    docs = spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(200 <= i < 260)) for i, *_ in rows if i < 260], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{root}/labels.parquet")
    return root


def test_pipeline_stages(spark, folder):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "private_data", "mixing", "packing"]
    state = {}
    for name, step in cp.STAGES:
        docs = step(spark, docs, folder).cache()
        state[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: [r.doc_id for r in state[n].select("doc_id").collect()]
    assert not [i for i in ids("toxicity") if 200 <= i < 260] and set(range(120)) <= set(ids("toxicity"))
    assert sorted(ids("ngram_jaccard")) == sorted([*range(120), 302, 303])
    private = {r.doc_id: r for r in state["private_data"].collect()}
    assert "[CARD]" in private[303].text and private[303].n_chars == len(private[303].text) and private[302].text is None
    assert not private_data.base_spans(private[303].text)[0]
    mixed = ids("mixing")
    assert set(mixed) <= set(ids("private_data")) and max(mixed.count(i) for i in set(mixed)) <= 2
    whole = Tokenizer.from_file(tokenizer_path())
    tokens = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in state["mixing"].collect())
    assert state["packing"].agg(F.sum("length")).first()[0] == tokens


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_imports_without_this_package(tmp_path):
    """A copy of the repository without the two folders and the pipeline still offers the other queries."""
    code = ("import shutil, sys; shutil.copytree(sys.argv[1], sys.argv[2] + '/r', ignore=lambda d, n: [x for x in n if x in "
            "('.git', 'llm', 'corpus_pipeline.py', '__pycache__')]); sys.path.insert(0, sys.argv[2] + '/r'); import __spark_entry__ as e; "
            "names = set(e.queries()); assert len(names) > 80 and not any(n.startswith('op') and n[2].isdigit() for n in names), names; "
            "assert 'pipeline' not in names and set(e.oracle_sql()) <= names")
    done = subprocess.run([sys.executable, "-B", "-c", code, ROOT, str(tmp_path)], capture_output=True, text=True, timeout=120, cwd=str(tmp_path),
                          env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-2000:]
