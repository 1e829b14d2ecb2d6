"""Every stage of the pipeline against its operator's brute-force version, each on its own input."""

import pytest

import corpus_pipeline as cp
from tablelens.llm import language
from tablelens.session import materialize
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_exact_dedup import norm
from tests.llm.test_jaccard_join import brute as similar


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(materialize(stage(spark, out[-1], sf)))
    return [[tuple(r) for r in x.collect()] for x in out], out


def test_stages(spark, sf, steps):
    rows, frames = steps
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    ids = [[r[0] for r in x] for x in rows]
    clear = {r.doc_id for r in language.predict(frames[0]).where("accepted").collect()}
    assert set(ids[1]) == clear and len(clear) > 0.95 * len(ids[0])
    first = {}
    for r in sorted(rows[1]):
        first.setdefault(norm(r[1]), r[0])
    assert sorted(ids[2]) == sorted(first.values())
    assert sorted(ids[3]) == sorted({c for _, _, c in similar(rows[2])})
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(ids[4]) == sorted(r[0] for r in leaks(rows[3], bench) if not r[-1])
    assert sorted(ids[5]) == sorted(ids[4])


def test_run_is_all_stages(spark, sf, steps):
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(steps[0][-1])
