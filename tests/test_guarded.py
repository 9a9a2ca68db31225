"""Writes that leave nothing wrong behind, and runs that go on after they were stopped."""

import pytest
from pyspark.sql import functions as F

from refrain.operators import enrich
from refrain.sources import guarded
from refrain.sources.files import read_or_empty


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_damaged_input_leaves_no_output_and_the_former_one_stays(spark, tmp_path):
    path = str(tmp_path / "songs")
    rules = {"no artist": F.col("artist").isNull(), "no id": F.col("id").isNull()}
    good = spark.createDataFrame([(1, "Abba"), (2, "Kiss")], "id long, artist string")
    bad = spark.createDataFrame([(1, "Abba"), (None, None), (3, None)], "id long, artist string")
    with pytest.raises(guarded.RuleBroken) as told:
        guarded.write_checked(bad, path, rules)
    assert told.value.counts == {"no artist": 2, "no id": 1} and not list(tmp_path.iterdir())
    assert guarded.write_checked(good, path, rules) == 2
    for wrong in (lambda: guarded.write_checked(bad, path, rules), lambda: guarded.write_checked(good, path, rules, least_rows=5)):
        with pytest.raises(guarded.RuleBroken):
            wrong()
    assert rows(spark.read.parquet(path)) == [(1, "Abba"), (2, "Kiss")] and [p.name for p in tmp_path.iterdir()] == ["songs"]
    assert guarded.write_checked(good.limit(1), path, rules) == 1
    assert spark.read.parquet(path).count() == 1


def test_listing_rows_are_written_only_if_whole(spark, tmp_path):
    scraped = spark.createDataFrame([(7, "12", "A", "B"), (8, "x1", "A", None)], "post_id long, id string, artist string, song string")
    wrong = {"id not numeric": ~F.col("id").rlike(r"\A[0-9]+\z"), **{f"no {c}": F.col(c).isNull() for c in ("post_id", "artist", "song")}}
    with pytest.raises(guarded.RuleBroken) as told:
        guarded.write_checked(scraped, str(tmp_path / "out"), wrong)
    assert told.value.counts == {"id not numeric": 1, "no song": 1} and not list(tmp_path.iterdir())


class Stopped(RuntimeError):
    pass


def test_a_stopped_run_goes_on_and_equals_one_run(spark, tmp_path):
    todo = spark.range(200).select(F.col("id").alias("artist_id"))
    asked = []

    def ask(part):
        if asked is not None and len(asked) == 4:
            raise Stopped
        asked.append(1)
        return part.filter("artist_id % 7 <> 0").select("artist_id", (F.col("artist_id") * 2).alias("year"))

    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    with pytest.raises(Stopped):
        guarded.answer_in_batches(todo, ["artist_id"], twice, ask, 6)  # the first call tells the schema
    assert len(list((tmp_path / "twice").glob("batch=*"))) == 3
    plain = lambda part: part.filter("artist_id % 7 <> 0").select("artist_id", (F.col("artist_id") * 2).alias("year"))
    whole = rows(guarded.answer_in_batches(todo, ["artist_id"], twice, plain, 6))
    assert whole == rows(guarded.answer_in_batches(todo, ["artist_id"], once, plain, 6)) == rows(plain(todo))
    # A batch that is written again changes nothing, and all that is asked counts as asked.
    number = 2
    guarded.write_batch(plain(todo.filter(guarded.batch_of(["artist_id"], 6) == number)), twice, number)
    again = read_or_empty(spark, twice, "artist_id long, year long, batch int", "parquet")
    assert rows(again.drop("batch")) == whole
    assert enrich.worklist(todo, again, ["artist_id"]).count() == 200 - len(whole)


def test_answers_to_nothing(spark, tmp_path):
    todo = spark.range(0).select(F.col("id").alias("artist_id"))
    assert guarded.answer_in_batches(todo, ["artist_id"], str(tmp_path / "none"), lambda part: part, 3).count() == 0
