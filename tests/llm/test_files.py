import os
import re

import pyarrow as pa
import pytest
from common import corpus, frame

from velado.llm import exact_dedup as E
from velado.llm import files


def tables(spark):
    from velado.plans.cut import shared_folder

    folder = re.sub("^file:(//)?", "", shared_folder(spark))
    return {f"{at}/{x}" for at, _, names in os.walk(folder) for x in names}


def test_operator_7_writes_without_child_processes(spark):
    """Hadoop's writer, which starts `chmod` for each file, leaves a checksum beside each."""
    before = tables(spark)
    E.groups(frame(spark, corpus()), buckets=4)
    new = tables(spark) - before
    assert {x.split("/")[-2].rstrip("0123456789abcdef") for x in new} >= {"level0-", "level1-", "velado-digests-"}
    assert all(re.search(r"/part-\d+\.parquet$", x) for x in new)


@pytest.mark.parametrize("local", [True, False])
def test_table_in_any_store(spark, tmp_path, monkeypatch, local):
    if not local:
        monkeypatch.setattr(files, "local_path", lambda spark, path: None)
    odd = files.numbered(lambda batches: (b.filter(pa.array([x % 2 == 1 for x in b.column(0).to_pylist()])) for b in batches))
    found = files.saved(spark.range(0, 1001, 1, 7), odd, "id long, row long", f"file://{tmp_path}/a b%20c")
    rows = found.collect()
    assert sorted(r.id for r in rows) == list(range(1, 1001, 2)) and len({r.row for r in rows}) == 500
    assert files.saved(spark.range(3), lambda batches: iter(()), "id long", f"{tmp_path}/none").count() == 0


def test_a_file_is_whole_or_absent(tmp_path):
    batch = pa.RecordBatch.from_pydict({"n": pa.array(range(1000))})

    def broken():
        yield batch
        raise ValueError

    with pytest.raises(ValueError):
        files.write_file(broken(), str(tmp_path), 3, 1)
    assert os.listdir(tmp_path) == []
    for times in (2, 3):  # a task that runs again
        assert files.write_file(iter([batch] * times), str(tmp_path), 3, 5000) == 1000 * times
        assert os.listdir(tmp_path) == ["part-000003.parquet"]
    import pyarrow.parquet as pq

    assert pq.read_table(tmp_path / "part-000003.parquet").num_rows == 3000
