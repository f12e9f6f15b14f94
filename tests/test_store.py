"""The vector store data source: batches, upserts, failures."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.operators import payload
from docflow.sources import vector_store as S


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id string, values array<float>, doc string, place int")


def options(folder, **more):
    return {"path": str(folder), "collection": "c", "create": "collection", "pause": "0", **more}


def test_batches_end_with_the_document_and_its_batch():
    part = lambda docs: pa.record_batch({S.DOC: docs, S.BATCH: [0] * len(docs), "id": list(range(len(docs)))})
    cut = [t.column(S.DOC).to_pylist() for t in S.cut_batches(iter([part(["a", "a", "b"]), part([]), part(["b", "b", "b"]), part([None])]), 3)]
    assert cut == [["a", "a"], ["b", "b", "b"], ["b"], [None]]
    assert list(S.cut_batches(iter([]), 3)) == []


def test_upsert_and_failed_batches(spark, tmp_path):
    first = [(f"a{i}", [1.0, 2.0], "a", i) for i in range(1, 251)] + [("b1", [1.0, 2.0], None, None)]
    done = S.load(rows_of(spark, first), options(tmp_path), "doc", "place")
    assert payload.load_status(done).first().asDict() == {"sent": 251, "inserted": 251, "failed_batches": 0, "status": "success"}
    # the second batch of document a (100 rows) has a vector of another size: it fails whole, twice; the others are stored
    second = [(f"a{i}", [3.0, 4.0] if i != 150 else [3.0], "a", i) for i in range(1, 251)] + [("n1", None, "n", 1)]
    done = S.load(rows_of(spark, second), options(tmp_path), "doc", "place")
    assert payload.load_status(done).first().asDict() == {"sent": 251, "inserted": 151, "failed_batches": 1, "status": "partial_error"}
    assert done.where("error is not null").count() == 1
    stored = {r.id: r["values"] for r in S.stored(spark, str(tmp_path), "c").collect()}
    assert len(stored) == 252 and stored["b1"] == [1.0, 2.0] and stored["a100"] == [3.0, 4.0] and stored["a101"] == [1.0, 2.0] and stored["a250"] == [3.0, 4.0]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = rows_of(spark, [(f"a{i}", [float(i)], f"d{i}", 1) for i in range(400)])
    S.load(rows, options(tmp_path), "doc", "place")
    bad = rows.withColumn("values", F.transform("values", lambda x: F.when(x == 399, F.raise_error(F.lit("broken row"))).otherwise(x + 1)))
    with pytest.raises(Exception, match="broken row"):
        # prepared already, so only the write reads the broken row
        S.load(bad.where("id <> 'a399'").unionByName(bad.where("id = 'a399'")), options(tmp_path), "doc", "place")
    assert {r.id: r["values"] for r in S.stored(spark, str(tmp_path), "c").collect()} == {f"a{i}": [float(i)] for i in range(400)}
    pending = tmp_path / "c" / "_pending"
    assert not pending.exists() or not os.listdir(pending)
    assert sorted(os.listdir(tmp_path / "c" / "tenant=default")) == ["load=000001"]


def test_collections_and_tenants(spark, tmp_path):
    rows = rows_of(spark, [("a", [1.0], "a", 1)])
    with pytest.raises(LookupError):
        S.load(rows, options(tmp_path, create="nothing"))
    S.load(rows, options(tmp_path))
    with pytest.raises(LookupError):
        S.load(rows, options(tmp_path, create="nothing", tenant="t"))
    S.load(rows, options(tmp_path, create="tenant", tenant="t"))
    assert S.stored(spark, str(tmp_path), "c", "t").count() == 1 and S.stored(spark, str(tmp_path), "c").count() == 1
    none = S.load(rows.limit(0), options(tmp_path))
    assert payload.load_status(none).first().status == "success"
    with pytest.raises(Exception, match="append"):
        rows.withColumns({S.DOC: F.lit(""), S.BATCH: F.lit(0)}).write.format("vector_store").options(**options(tmp_path)).mode("overwrite").save()
