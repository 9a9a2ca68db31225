"""Plans that must hold at size: what is combined before a shuffle, and what is never shuffled."""

from pyspark.sql import functions as F

from refrain.operators import enrich, link, resolve
from refrain.operators.expand import wanted_keys

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_digests_hash_and_combine_narrow_rows_before_the_shuffle(spark):
    from refrain.plans import standins

    dump = link.prepare_dump(standins.dump(spark, SF))
    wanted = wanted_keys(standins.catalog(spark, SF))
    for found in (link.exact_asks(wanted, dump), link.prefix_asks(wanted, dump)):
        digested = plan(link.digest(found, ["asked", "how"]))
        assert "HashAggregate" in digested and "SortAggregate" not in digested and "ObjectHashAggregate" not in digested


def test_quality_and_row_survive_being_one_number(spark):
    rows = [("k", False, False, False, 5, 9_000_000_000_000_000_000), ("k", False, False, False, -1_000_000, 7), ("k", False, False, False, -1_000_000, 8),
            ("z", True, False, True, 90_000_000, 0)]
    df = spark.createDataFrame(rows, "key string, live boolean, variant_plain boolean, variant_asked boolean, base_quality long, row_no long")
    found = {r["key"]: (r["row_no"], r["base_quality"], r["seen"]) for r in link.digest(df, ["key"]).collect()}
    assert found == {"k": (7, -1_000_000, 3), "z": (0, 90_000_000, 1)}


def test_bucketed_lookups_are_not_shuffled(spark):
    from refrain.plans import query_resolve

    n = spark.range(500).select(F.col("id").cast("string").alias("recording_id"), (F.col("id") % 90 + 1900).cast("int").alias("year"))
    dates = enrich.keep_by_id(n, "recording_id", 4)
    works = enrich.keep_by_id(n.select("recording_id", F.lit("T").alias("title"), F.lit("eng").alias("language")), "recording_id", 4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matches, acts = query_resolve.matches(spark, SF), query_resolve.acts(spark, SF)
        decided = resolve.decide(matches, acts, dates=dates, works=works)
        assert plan(decided).count("hashpartitioning(recording_id") == 1
        assert decided.where("year is not null").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def _below(text, mark):
    """The part of a plan under the first line that holds ``mark``."""
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if mark in line)
    depth = lines[at].index("Exchange")
    rest = [line for line in lines[at + 1:]]
    end = next((i for i, line in enumerate(rest) if len(line) - len(line.lstrip(" :+-|")) <= depth), len(rest))
    return "\n".join(rest[:end])


def test_matches_move_by_recording_before_they_carry_the_records_of_their_credits(spark):
    from refrain.plans import query_resolve

    dates = enrich.keep_by_id(spark.range(50).select(F.col("id").cast("string").alias("recording_id"), F.lit(1999).alias("year")), "recording_id", 4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = _below(plan(resolve.decide(query_resolve.matches(spark, SF), query_resolve.acts(spark, SF), dates=dates)), "hashpartitioning(recording_id")
        assert "Scan parquet" in moved and "collect_list" not in moved and "post_id" in moved and "Join" not in moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_the_act_of_each_string_joins_by_its_size(spark):
    from refrain.plans import query_resolve

    text = plan(resolve.decide(query_resolve.matches(spark, SF), query_resolve.acts(spark, SF)))
    assert "hashpartitioning(artist#" not in text and "hashpartitioning(artist_id#" not in text


def test_repeated_and_unnumbered_matches_keep_their_lookups(spark):
    names = "post_id long, id long, artist string, song string, matched boolean, trusted boolean, placeholder boolean, how string, proposed string, credit string, recording string, recording_id string, title string, `from` string, language string, artist_ids array<string>"
    rows = [(p, 1, "A", "S", True, True, False, "exact", None, "C", "S", r, "S", None, None, ["a"]) for p, r in ((1, "r"), (1, "r"), (None, "r"), (2, None))]
    artists = spark.createDataFrame([("a", "A", "A", None, [], [])], "artist_id string, name string, sort_name string, disambiguation string, genres array<struct<name: string, count: int>>, aliases array<string>")
    dates = spark.createDataFrame([("r", 1990), ("r", 1990)], "recording_id string, year int")
    found = resolve.decide(spark.createDataFrame(rows, names), artists, dates=dates).select("post_id", "year", "case", F.size("known").alias("n")).collect()
    got = sorted(((r["post_id"] or 0, r["year"], r["case"], r["n"]) for r in found), key=str)
    # A repeated post meets the ids of both its rows, and each row both dates; an unnumbered one has none known.
    assert got == sorted([(1, 1990, "normal", 2)] * 8 + [(0, 1990, "normal", None)] * 2 + [(2, None, "normal", 1)], key=str)


def test_title_first_combines_bare_row_numbers_per_song(spark):
    from refrain.plans import standins

    songs, dump = standins.catalog(spark, SF), link.prepare_dump(standins.dump(spark, SF))
    found = link.link_title_first(songs, dump, classes=True)
    text = plan(found)
    assert "HashAggregate" in text and "SortAggregate" not in text and "hashpartitioning(post_id" in text
    # No title or credit is folded again by then: songs meet the nearest rows as kept strings.
    assert "regexp_replace" not in text and "levenshtein" not in text
    every = link.link_title_first(songs, dump).groupBy("post_id").agg(F.min("row_no").alias("row_no"))
    rows = {(r["post_id"], r["row_no"]) for r in found.collect()}
    assert rows and rows == {(r["post_id"], r["row_no"]) for r in every.collect()}


def test_collab_and_prefix_passes_fold_each_string_once(spark):
    from refrain.plans import standins

    songs, dump = standins.catalog(spark, SF), link.prepare_dump(standins.dump(spark, SF))
    ids = spark.createDataFrame([(f"brand{n}", f"a{n}") for n in range(1, 26)], "artist_key string, artist_id string")
    assert "regexp_replace" not in plan(link.link_collab(songs, dump, ids))
    assert "regexp_replace" not in plan(link.prefix_asks(spark.createDataFrame([("brand1", )], "key string"), dump))
