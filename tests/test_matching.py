import pytest

from refrain.plans.matching import match_catalog

SONGS = [
    (1, 1, "Abba", "Waterloo"), (2, 2, "Beatles", "Help"), (3, 3, "Belle & Sebastian", "Get me away"),
    (4, 4, "Fleetwod mac", "Dreams"), (5, 5, "Eagles", "Lying Eyes"), (6, 6, "Zara Larssn", "Lush Life"),
    (7, 7, "Ed Sheeran Ft. Eminem", "River"), (8, 8, "Eminem", "Stan"), (9, 9, "Ed Sheeran", "Shape of you"),
    (10, 10, "Abba", "Wateloo"), (11, 11, "Fleetwood Mac", "The Chain"), (12, 12, "Nobody", "Nothing"),
    (13, 13, "Steve", "Joker"), (14, 14, "Abba", "Waterloo"), (15, 15, "Madonna", "Secret"), (16, 16, "Madonna", "Vouge"),
    (17, 17, "Du", "Du hast (english)"), (18, 18, "Kygo Ft. Conrad", "Firestone"), (19, 19, "Kygo", "Higher love"),
]
DUMP = [
    (1, "r1", "ABBA", ["a1"], "Waterloo (German version)", "x", 5), (2, "r2", "ABBA", ["a1"], "Waterloo", "Waterloo", 9),
    (3, "r3", "The Beatles", ["b1"], "Help!", "Help!", 3), (4, "r4", "Belle and Sebastian", ["c1"], "Get Me Away", "x", 3),
    (5, "r5", "Fleetwood Mac", ["d1"], "Dreams", "Rumours", 3), (6, "r6", "Fleetwood Mac", ["d1"], "The Chain", "Rumours", 3),
    (7, "r7", "Eagles", ["e1"], "Lying Eyes", "1999-01-01: Live", 1), (8, "r8", "Eagles", ["e1"], "Lyin' Eyes", "Greatest", 4),
    (9, "r9", "Zara Larsson", ["z1"], "Lush Life", "So Good", 4),
    (10, "r10", "Eminem feat. Ed Sheeran", ["m1", "s1"], "River", "Revival", 4), (11, "r11", "Eminem", ["m1"], "Stan", "MMLP", 4),
    (12, "r12", "Ed Sheeran", ["s1"], "Shape of You", "Divide", 4), (13, "r13", "Steve Miller", ["q1"], "Joker", "x", 4),
    (14, "r14", "Steve Miller Band", ["q2"], "The Joker", "x", 4), (15, "r15", "Madonna", ["ma"], "Secret (Some Bizarre mix)", "x", 4),
    (16, "r16", "Madonna", ["ma"], "Vogue", "x", 4), (17, "r17", "Du", ["du"], "Du hast (English version)", "x", 4),
    (18, "r18", "Kygo feat. Conrad Sewell", ["k1", "k2"], "Firestone", "x", 4), (19, "r19", "Kygo & Whitney Houston", ["k1", "w1"], "Higher Love", "x", 4),
]
WANT = {
    1: ("exact", 2), 2: ("exact", 3), 3: ("exact", 4), 4: ("title-first", 5), 5: ("exact", 8), 6: ("title-first", 9),
    7: ("collab-scoped", 10), 8: ("exact", 11), 9: ("exact", 12), 10: ("near", 2), 11: ("exact", 6), 13: ("exact", 14),
    14: ("exact", 2), 15: ("version", 15), 16: ("near", 16), 17: ("exact", 17), 18: ("title-first", 18), 19: ("artist-scoped", 19),
}


@pytest.mark.parametrize("mode", ["fold", "total_order"])
def test_all_passes(spark, mode):
    songs = spark.createDataFrame(SONGS, "post_id long, id long, artist string, song string")
    dump = spark.createDataFrame(
        DUMP, "row_no long, recording_id string, credit string, artist_ids array<string>, recording string, release string, score long"
    )
    put = spark.createDataFrame(
        [(13, "Steve Miller Band", "The Joker", None, "eng", "wrong act")],
        "post_id long, artist string, title string, `from` string, language string, why string",
    )
    rows = {r.post_id: r for r in match_catalog(songs, dump, put, mode=mode).collect()}
    assert {p: (r.how, r.row_no) for p, r in rows.items() if r.matched} == WANT
    assert not rows[12].matched and rows[13].proposed == "wrong act" and rows[13].language == "eng"
    assert rows[15].title == "Secret" and rows[10].trusted


def test_scoping_by_title_equals_scoping_by_id(spark):
    from refrain.operators import link
    from refrain.operators.expand import allowed_language

    songs = spark.createDataFrame([(1, "Abba", "Stay"), (2, "Kiss & Abba", "Go"), (3, "Abba & Kiss", "Stay"), (4, "Nobody", "Stay")],
                                  "post_id long, artist string, song string")
    raw = spark.createDataFrame([
        (1, "r1", "ABBA", ["a1"], "Stay", "x", 5), (2, "r2", "ABBA", ["a2"], "Stay", "x", 4), (3, "r3", "Kiss, ABBA", ["k1", "a2"], "Go", "x", 4),
        (4, "r4", "ABBA, Kiss", ["a1", "k1"], "Stay", "x", 4), (5, "r5", "Other", ["o1"], "Stay", "x", 1),
    ], "row_no long, recording_id string, credit string, artist_ids array<string>, recording string, release string, score long")
    dump, allow = link.prepare_dump(raw), allowed_language(songs)
    ids = spark.createDataFrame([("abba", "a1"), ("abba", "a2"), ("kiss", "k1")], "artist_key string, artist_id string")

    def rows(df):
        return sorted((r.post_id, r.row_no, r.how) for r in df.select("post_id", "row_no", "how").distinct().collect())

    scoped = rows(link.link_scoped(songs, allow, dump, ids, classes=False))
    assert scoped == [
        (1, 1, 3), (1, 2, 3), (1, 4, 3), (2, 3, 4), (3, 1, 4), (3, 2, 4), (3, 4, 4)
    ]
    assert rows(link.link_collab(songs, dump, ids)) == [
        (2, 3, 5), (3, 4, 5)
    ]
