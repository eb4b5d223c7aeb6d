"""Intermediate tables: written once, released one by one or all at once."""

from pathlib import Path

from quotelens.store import materialize, release, shared_dir, sweep


def test_tables_are_released_and_swept(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "quotelens" / spark.sparkContext.applicationId
    here = lambda name: list(folder.glob(f"{name}-*"))
    one, two = materialize(spark.range(5), "one"), materialize(spark.range(0).toDF("x"), "two")
    assert (one.count(), two.count(), two.columns) == (5, 0, ["x"]) and here("one") and here("two")
    release(one)
    assert not here("one") and here("two")
    sweep(spark)
    assert not folder.exists()
    assert materialize(spark.range(3), "three").count() == 3
