import json

import pytest
from pyspark.sql import functions as F

from refrain.functions.text import combined_lookup
from refrain.operators import favourites, overlay, quality
from refrain.sources import files, listing
from refrain.streaming import favourites as stream


def test_catalog_and_dump(spark, tmp_path):
    (tmp_path / "songs.json").write_text(json.dumps({
        "source": "x", "count": 1, "songs": [{"id": 7, "postId": 70, "artist": "ABBA", "song": "Waterloo"}],
    }, indent=2))
    assert files.read_catalog(spark, str(tmp_path / "songs.json")).collect()[0].asDict() == {
        "post_id": 70, "id": 7, "artist": "ABBA", "song": "Waterloo",
    }
    (tmp_path / "dump.csv").write_text(
        "id,artist_credit_id,artist_mbids,artist_credit_name,release_mbid,release_name,recording_mbid,recording_name,combined_lookup,score\n"
        '1,1,"a1, a2,a1",ABBA,r,"The ""Best"", of",m1,Waterloo,abbawaterloo,12\n'
        "2,1,a1,ABBA,r,x,m2,Blank,,3\n"
        "3,1,a1\n"
    )
    rows = files.read_dump(spark, str(tmp_path / "dump.csv")).collect()
    assert [(r.row_no, r.artist_ids, r.release, r.key, r.score) for r in rows] == [
        (1, ["a1", "a2"], 'The "Best", of', "abbawaterloo", 12)
    ]
    files.write_prepared_dump(files.read_dump(spark, str(tmp_path / "dump.csv")), str(tmp_path / "prepared"))
    assert spark.read.parquet(str(tmp_path / "prepared")).collect()[0].recording_key == "waterloo"


def test_optional_lists_and_names(spark, tmp_path):
    assert files.read_or_empty(spark, str(tmp_path / "none.json"), "a string").count() == 0
    rows = spark.range(50).selectExpr("id", "'n' || id AS name")
    files.write_with_provenance(rows, str(tmp_path / "out"), "a note", "id")
    back = files.read_or_empty(spark, str(tmp_path / "out/rows"), "id long, name string")
    assert sorted(map(tuple, back.collect())) == [(i, f"n{i}") for i in range(50)]
    (tmp_path / "one.json").write_text('{\n "a": "x"\n}')
    assert [r.a for r in files.read_or_empty(spark, str(tmp_path / "one.json"), "a string", "envelope").collect()] == ["x"]
    (tmp_path / "list.txt").write_text("# comment\n\n  Abba \nKiss\n")
    assert [r.artist for r in files.read_lines(spark, str(tmp_path / "list.txt")).collect()] == ["Abba", "Kiss"]
    (tmp_path / "names.json").write_text(json.dumps({"note": "n", "artists": {"m1": {"name": "P!nk", "slug": "pink"}, "m2": {"name": "Ye"}}}))
    assert sorted((r.artist_id, r.name, r.slug) for r in files.read_names(spark, str(tmp_path / "names.json")).collect()) == [
        ("m1", "P!nk", "pink"), ("m2", "Ye", None),
    ]


def test_overrides_are_three_state(spark, tmp_path):
    (tmp_path / "overrides.json").write_text(json.dumps({"overrides": [
        {"postId": 1, "artist": "", "why": "carol"}, {"postId": 2, "year": None}, {"postId": 3, "from": ""},
        {"postId": 4, "artists": [{"mbid": "m9", "name": "Nine"}]},
    ]}))
    overrides = files.read_overrides(spark, str(tmp_path / "overrides.json"))
    catalog = spark.createDataFrame([(i, i, "Venue", "Song") for i in range(1, 6)], "post_id long, id long, artist string, song string")
    corrections = spark.createDataFrame(
        [(i, "Fixed", None, None, "Show", None, ["m1"], None, ["pop"], 1999) for i in range(1, 5)],
        "post_id long, artist string, sort_as string, title string, `from` string, language string, artist_ids array<string>, "
        "artists array<struct<artist_id:string,name:string>>, genres array<string>, year int",
    )
    records = spark.createDataFrame([("m1", "One")], "artist_id string, name string")
    names = spark.createDataFrame([], "artist_id string, name string, slug string")
    rows = {r.post_id: r for r in overlay.compose(catalog, corrections, overrides, records, names).collect()}
    assert (rows[1].artist, rows[1].year, rows[1].artists) == ("", None, None)
    assert (rows[2].artist, rows[2].year, rows[2].genres) == ("Fixed", None, ["pop"])
    assert rows[3]["from"] is None and rows[2]["from"] == "Show"
    assert (rows[4].year, [a.name for a in rows[4].artists]) == (None, ["Nine"])
    assert (rows[5].artist, rows[5].corrected) == ("Venue", False)


def test_provenance(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    files.write_with_provenance(df, str(tmp_path / "out"), "a note", "k")
    assert spark.read.json(str(tmp_path / "out/rows")).count() == 2
    assert spark.read.json(str(tmp_path / "out/about")).first().note == "a note"


def test_listing(spark):
    spec = listing.ListingSpec(
        container='<div class="items[^>]*>', provider="songs", row='<div class="item ', post_id=r'data-post-id="(\d+)"',
        fields={"id": r'id">([\s\S]*?)</', "artist": r'artist">([\s\S]*?)</', "song": r'song">([\s\S]*?)</'},
    )
    row = '<div class="item " data-post-id="{}"><b class="id">{}</b><b class="artist">{}</b><b class="song">{}</b></div>'
    other = '<div class="items" data-nav="{&quot;query&quot;:{&quot;jet_smart_filters&quot;:&quot;other&quot;}}">' + row.format(9, 9, "x", "y")
    html = other + (
        '<div class="items" data-nav="{&quot;query&quot;:{&quot;jet_smart_filters&quot;:&quot;songs&quot;,&quot;posts_per_page&quot;:2}}" data-pages="1">'
        + row.format(1, 5, "Simon &amp; Garfunkel", "&#8217;Tis &amp;quot; &#x1F600; &bogus;") + row.format(2, "x", "A", " B&nbsp;")
    )
    pages = spark.createDataFrame([(1, html)], "page int, html string")
    rows = listing.extract_listing(pages, spec)
    assert [(r.post_id, r.id, r.artist, r.song) for r in rows.orderBy("place").collect()] == [
        (1, "5", "Simon & Garfunkel", "’Tis &quot; 😀 &bogus;"), (2, "x", "A", "B"),
    ]
    found = {r.rule: r.violations for r in listing.listing_violations(rows, listing.find_listing(pages, spec), ["artist", "song"]).collect()}
    assert found["id not numeric"] == 1 and sum(found.values()) == 1
    assert [r.entity for r in listing.unknown_entities(pages).collect()] == ["bogus"]


def test_one_large_envelope_is_read_by_many_tasks(spark, tmp_path):
    import json

    from refrain.sources import files

    songs = [{"id": k // 2, "postId": k, "artist": f"A {k}\n    }},", "song": '}},{"x' if k % 3 else None} for k in range(5_000)]
    for name, listed in (("all", songs), ("one", songs[:1]), ("none", [])):
        whole = {"source": "s", "fetchedAt": "t", "count": len(listed), "songs": listed}
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, indent=2, ensure_ascii=False))
        path, kept = str(tmp_path / f"{name}.json"), spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        try:
            found = files.read_indented_catalog(spark, path)
            assert found.rdd.getNumPartitions() > (4 if name == "all" else 0)
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, files.read_catalog(spark, path).collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_favourites_stream_equals_batch(spark, tmp_path):
    schema = "user_id long, ts long, event_id long, ids array<long>"
    events = [(u, t, 10 * t + u, sorted({(3 * t + u) % 7, (3 * t + u) % 7 + t % 3})) for t in range(40) for u in (1, 2, 3)]
    events += [(9, 1, 900, [1, 2]), (9, 30, 901, [2, 3]), (8, 2, 800, [])]
    first = [e for e in events if e[1] < 20]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for name, rows in (("a", None), ("b", [e for e in events if e[1] >= 20])):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream.start_favourites(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    changes = spark.read.parquet(str(tmp_path / "out"))
    held = sorted(map(tuple, stream.current_favourites(changes).select("user_id", "id").collect()))
    batch = favourites.fold_favourites(spark.createDataFrame(events, schema))
    assert held == sorted(map(tuple, batch.select("user_id", "id").collect()))
    assert [i for u, i in held if u == 9] == [1]
    stream.compact(changes, str(tmp_path / "compacted"))
    assert sorted(map(tuple, stream.current_favourites(spark.read.parquet(str(tmp_path / "compacted"))).select("user_id", "id").collect())) == held


def test_favourites_in_event_time_equal_batch_whatever_batch_they_come_in(spark, tmp_path):
    from datetime import datetime, timedelta

    schema = "user_id long, ts timestamp, event_id long, ids array<long>"
    start = datetime(2024, 1, 1)
    events = [(u, start + timedelta(minutes=t), 10 * t + u, sorted({(3 * t + u) % 7, (3 * t + u) % 7 + t % 3})) for t in range(40) for u in (1, 2, 3)]
    # Every third toggle comes a batch too late, within the delay; the last row only moves the clock on.
    batches = [[e for e in events if (e[2] // 10 + (5 if e[2] % 3 == 0 else 0)) // 10 == k] for k in range(5)]
    batches.append([(99, start + timedelta(days=2), 9_999, [1])])
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream.start_favourites(source, str(tmp_path / "out"), str(tmp_path / "state"), "20 minutes").awaitTermination(120)
    changes = spark.read.parquet(str(tmp_path / "out"))
    held = sorted(map(tuple, stream.current_favourites(changes).select("user_id", "id").collect()))
    batch = favourites.fold_favourites(spark.createDataFrame(events, schema))
    assert held == sorted(map(tuple, batch.select("user_id", "id").collect()))
    states = spark.read.format("statestore").load(str(tmp_path / "state"))
    waiting = [r[0] for r in states.select("value.groupState.waiting").collect()] if "groupState" in states.schema["value"].dataType.fieldNames() else []
    assert all(w in (None, "[]") or "9999" in w for w in waiting)


def test_search_of_many_queries_equals_one_at_a_time(spark):
    from refrain.operators import browse
    from refrain.plans import standins

    index = browse.search_index(standins.songs(spark, "/root/testdata/sf0.001"))
    asked = [" Anvil ", "brand#1", "b", "t a", "", "zzz", "ANVIL", "12"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    found = {}
    for r in browse.search_batch(queries, browse.postings(index), index).select("query", "title", "artist").collect():
        found.setdefault(r["query"], []).append((r["title"], r["artist"]))
    for q in asked:
        plain = sorted((r["title"], r["artist"]) for r in index.filter(browse.matches_query(q)).collect())
        assert sorted(found.get(q, [])) == plain


def test_verdict_precedence(spark):
    checks = spark.createDataFrame([
        ("a", "resolved", 1, None, "A", None, None, None), ("b", None, None, None, None, None, True, None),
        ("c", None, None, None, None, "a", None, None), ("d", "resolved", None, None, None, None, None, "unsure"),
        ("gone", "resolved", None, None, None, None, None, None),
    ], "artist string, status string, artist_count int, collaboration boolean, expect_name string, same_entity_as string, "
       "must_not_resolve boolean, observe_only string")
    one = [("A", "m1")]
    verdicts = spark.createDataFrame([
        ("a", "resolved", one, None), ("b", "resolved", one, None), ("c", "resolved", one, None), ("d", "ambiguous", [], None), ("e", "x", [], None),
    ], "artist string, status string, artists array<struct<name:string,artist_id:string>>, is_collaboration boolean")
    score = quality.score_verdicts(checks, verdicts).first()
    assert (score.passed, score.checked, score.failed, score.observed, score.unexpected) == (4, 6, 2, 1, 1)


def test_keys_of_files_agree_with_own(spark):
    df = spark.createDataFrame([("Björk", "Jóga")], "a string, b string")
    assert df.select(combined_lookup(F.col("a"), F.col("b"))).first()[0] == "bjorkjoga"


@pytest.mark.parametrize("name", ["resume_worklist", "variant_merge", "catalog_profile"])
def test_registered_queries_run(spark, name):
    import __spark_entry__ as registered

    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert registered.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
