import os

from rillwork.session import release, through_table


def test_work_folders_are_released(spark):
    t = through_table(spark.range(5).toDF("n"), "five")
    folder = t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert t.count() == 5 and os.path.isdir(folder)
    assert release(spark) >= 1 and not os.path.exists(folder) and release(spark) == 0
