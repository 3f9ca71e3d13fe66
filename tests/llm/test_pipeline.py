import os
import random
import subprocess
import sys

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.helpers import edited, frame, odd, prose  # noqa: E402

ROOT = os.path.dirname(pipeline.__file__)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, prose(rng, rng.randrange(80, 300), 4000)) for i in range(120)]
    passage, item = prose(rng, 60, 4000), prose(rng, 40, 4000)
    rows += [(200 + i, f"{prose(rng, 70, 4000)} {passage} {prose(rng, 70, 4000)}") for i in range(5)]
    rows += [(300 + i, edited(rng, rows[3][1], 1)) for i in range(5)] + [(310, rows[4][1]), (311, rows[4][1])]
    rows += [(400 + i, f"{prose(rng, 50, 4000)} {item} {prose(rng, 50, 4000)}") for i in range(3)]
    rows += [(500 + i, " ".join(["!!! spam"] * 60)) for i in range(40)]
    rows += [(1000 + i, t) for i, t in odd(rng) if i]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows if i < 600], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_takes_effect(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    good = set(range(120))
    assert good <= set(seen["quality"]) and not set(range(500, 540)) & set(seen["quality"])
    near = set(seen["near_duplicates"])
    assert good <= near and not near & {300, 301, 302, 303, 304, 310, 311}
    assert set(seen["passages"]) == near
    # a window may reach over the passage's ends where the words beside it agree too
    assert len(seen["passages"][200].text.split()) == 200 and all(130 <= len(seen["passages"][i].text.split()) <= 140 for i in range(201, 205))
    assert all(seen["passages"][i].text == dict(rows)[i] for i in good)
    clean = set(seen["decontamination"])
    assert {400, 401, 402} & near and not {400, 401, 402} & clean and good <= clean
    assert set(seen["sequences"]) == clean


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.count() > 100 and "sequence_id" in out.columns


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_stands_without_this_subpackage():
    code = "import sys; sys.modules['quillspark.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op1') for k in n) and 'pipeline' not in n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
