"""Slugs chosen in turn, rows linked by shared numbers, display rows of favourites."""

from refrain.operators import favourites, link, linked, overlay


def test_slugs_are_claimed_across_names(spark):
    artists = spark.createDataFrame([
        ("a" * 9, 1, "Nirvana Group", None, None), ("b" * 9, 2, "Nirvana", "Group", "grunge"), ("c" * 9, 3, "Nirvana", "Person", None),
        ("d" * 9, 4, "Nirvana", "Person", "grunge"), ("e" * 9, 5, "Other", "Group", None), ("f" * 9, 6, "Curated", None, None),
        ("g" * 9, 7, "Taken", None, None), ("h" * 9, 8, None, None, None),
    ], "artist_id string, seq long, name string, type string, disambiguation string")
    names = spark.createDataFrame([("f" * 9, "Taken"), ("e" * 9, "")], "artist_id string, slug string")
    slugs = {r.artist_id[0]: r.slug for r in overlay.assign_slugs(artists, names).collect()}
    assert slugs == {
        "a": "nirvana-group", "b": "nirvana-grunge", "c": "nirvana-person", "d": "nirvana-dddddddd", "e": "other", "f": "taken",
        "g": "taken-gggggggg",
    }
    assert overlay.assign_slugs(artists.limit(0), names).count() == 0


def test_components_keep_scopes_apart(spark):
    edges = spark.createDataFrame([("x", i, i + 1) for i in range(20)] + [("y", 5, 9), ("y", 9, 5), ("y", 7, 7)], "s string, u long, v long")
    found = {(r.s, r.node): r.root for r in linked.components(edges, ("s",)).collect()}
    assert found == {("x", i): 0 for i in range(1, 21)} | {("y", 9): 5}


def test_components_deal_out_hot_centres_only(spark, monkeypatch):
    star = [("x", i, i + 1) for i in range(9)] + [("x", 100, i) for i in range(50, 90)] + [("y", 3, 4), (None, 1, 2)]
    edges = spark.createDataFrame(star, "s string, u long, v long")
    cold = {(r.s, r.node): r.root for r in linked.components(edges, ("s",)).collect()}
    assert "Generate" not in linked._large_star(edges, ("s",), len(star))._jdf.queryExecution().toString()
    monkeypatch.setattr(linked, "HOT_LINKS", 3)
    assert "Generate" in linked._large_star(edges, ("s",), len(star))._jdf.queryExecution().toString()
    hot = {(r.s, r.node): r.root for r in linked.components(edges, ("s",)).collect()}
    expected = {("x", i): 0 for i in range(1, 10)} | {("x", i): 50 for i in [*range(51, 90), 100]} | {("y", 4): 3}
    assert {k: v for k, v in cold.items() if k[0]} == {k: v for k, v in hot.items() if k[0]} == expected


def test_an_artist_string_of_many_ids(spark):
    asks = spark.createDataFrame([(1, "various", "stay"), (2, "various", "go"), (3, "abba", "stay")], "post_id long, artist_key string, recording_key string")
    ids = spark.createDataFrame([("various", f"i{n}") for n in range(1_000)] + [("abba", "i7")], "artist_key string, artist_id string")
    rows = spark.createDataFrame([(n, "stay" if n % 100 == 7 else "other", f"i{n}") for n in range(1_200)], "row_no long, recording_key string, artist_id string")
    found = sorted((r.post_id, r.row_no) for r in link.known_pairs(asks, rows, ids).collect())
    assert found == sorted([(1, n) for n in range(7, 1_000, 100)] + [(3, 7)])


def test_rows_of_favourite_numbers(spark):
    held = spark.createDataFrame([(1, 5), (1, 6), (1, 9), (2, 9)], "user_id long, id long")
    members = spark.createDataFrame([("a", "x", 5), ("a", "x", 6), ("a", "y", 9), ("b", "z", 9)], "variant_artist string, variant_title string, id long")
    rows = sorted((r.user_id, r.place, r.variant_artist, r.variant_title, r.first_id) for r in favourites.favourite_rows(held, members).collect())
    assert rows == [(1, 1, "a", "x", 5), (1, 2, "b", "z", 9), (2, 1, "b", "z", 9)]
