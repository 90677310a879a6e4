"""Where intermediates go."""

from pathlib import Path

import pytest

from netsieve import session


def test_no_machine_local_folder():
    root = Path(session.__file__).parent
    assert not [p for p in root.rglob("*.py") if "tempfile" in p.read_text() or "localCheckpoint" in p.read_text()]


def test_staged_tables_lie_in_the_shared_folder_and_can_be_dropped(spark):
    session.drop_staged(spark)
    staged = session.stage_table(spark.range(5), "numbers")
    (folder,) = {f.rsplit("/", 1)[0] for f in staged.inputFiles()}
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert shared.removeprefix("file:").rstrip("/") in folder.removeprefix("file:").replace("///", "/")
    assert staged.count() == 5
    assert session.drop_staged(spark) == 1


def test_a_table_can_be_dropped_by_itself(spark):
    first, second = (session.stage_table(spark.range(n), "part") for n in (3, 4))
    session.drop_table(first)
    assert second.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(first._staged_path).count()
    session.drop_table(second)
