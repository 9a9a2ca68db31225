import random

import pytest
from pyspark.sql import functions as F

from refrain.operators import select as sel

SCHEMA = (
    "post_id long, pass int, rank int, how int, proposed boolean, venue_artist string, proposal_artist string, row_no long, "
    "credit string, live boolean, variant boolean, quality long"
)


def key(s):
    return "".join(c for c in s.lower() if c.isalnum())


def takes(e, n):
    """The displacement rules, written out from their description."""
    if e is None:
        return True
    if e["proposal_artist"] and e["venue_artist"] and not n["proposal_artist"]:
        new = key(n["credit"])
        if key(e["venue_artist"])[:12] in new and key(e["proposal_artist"])[:12] not in new:
            return False
    e_clean, n_clean = not (e["live"] or e["variant"]), not (n["live"] or n["variant"])
    if e_clean and not n_clean:
        return False
    attributed = False
    if n["proposal_artist"] and n["venue_artist"]:
        venue, put, held, new = (key(x) for x in (n["venue_artist"], n["proposal_artist"], e["credit"], n["credit"]))
        attributed = venue != put and venue[:12] in held and (put[:12] in new or new[:12] in put)
    if (
        (e["live"] and n_clean) or (e["variant"] and not n["variant"] and (n["rank"] <= e["rank"] + 1 or n["proposed"]))
        or (n_clean and n["quality"] < e["quality"] and n["rank"] <= e["rank"]) or (n["how"] < e["how"] and n_clean)
        or attributed or (n["proposed"] and n["how"] < e["how"])
    ):
        return True
    if n["rank"] != e["rank"]:
        return n["rank"] < e["rank"]
    if n["how"] != e["how"]:
        return n["how"] < e["how"]
    return n["quality"] < e["quality"]


def groups(rng, posts, with_proposals):
    rows = []
    for post in range(posts):
        numbers = sorted(rng.sample(range(200), rng.randint(1, 14)))
        for row_no in numbers:
            live, variant = rng.random() < 0.3, rng.random() < 0.3
            base = rng.randint(1, 8)
            put = with_proposals and rng.random() < 0.3
            rows.append({
                "post_id": post, "pass": 1, "rank": 99 if put else rng.randint(0, 3), "how": rng.randint(0, 2), "proposed": put,
                "venue_artist": "Steve Miller" if put else None, "proposal_artist": "Steve Miller Band" if put else None,
                "row_no": row_no, "credit": rng.choice(["Steve Miller", "Steve Miller Band", "Other"]), "live": live,
                "variant": variant, "quality": base + live * 50 + variant * 40,
            })
    return rows


def expected(rows):
    held = {}
    for n in sorted(rows, key=lambda r: (r["post_id"], r["row_no"])):
        if takes(held.get(n["post_id"]), n):
            held[n["post_id"]] = n
    return {post: n["row_no"] for post, n in held.items()}


def classes_of(df):
    return df.groupBy("post_id", "pass", "rank", "how", "proposed", "live", "variant", "venue_artist", "proposal_artist").agg(
        F.min_by(F.struct("row_no", "credit", "quality"), F.struct("quality", "row_no")).alias("m"),
        F.count(F.lit(1)).alias("seen"),
    ).select("post_id", "pass", "rank", "how", "proposed", "venue_artist", "proposal_artist", "m.row_no", "m.credit", "live",
             "variant", "m.quality", "seen")


def run(spark, with_proposals, **options):
    rng = random.Random(11 + with_proposals)
    rows = groups(rng, 400, with_proposals)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    best = sel.best_by_fold(classes_of(df), lambda posts: df.join(posts, "post_id", "left_semi"), **options)
    got = {r.post_id: r.row_no for r in best.collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("block_rows", [1, 3, 48])
@pytest.mark.parametrize("with_proposals", [False, True])
def test_fold_in_blocks_of_any_size(spark, with_proposals, block_rows):
    run(spark, with_proposals, block_rows=block_rows)


def test_fold_of_one_song_with_very_many_candidates(spark):
    rng = random.Random(9)
    rows = [{"post_id": 1, "pass": 1, "rank": rng.choice([0, 1, 1, 2, 99]), "how": rng.randint(0, 2), "proposed": False, "venue_artist": None,
             "proposal_artist": None, "row_no": k, "credit": "Other", "live": rng.random() < 0.9, "variant": rng.random() < 0.9, "quality": 5_000 - k}
            for k in range(1_500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert [r.row_no for r in sel.replay(df, 20).collect()] == [expected(rows)[1]]


def test_settled_posts_need_no_replay(spark):
    rows = groups(random.Random(5), 300, False)
    df = spark.createDataFrame(rows, SCHEMA)
    settled = {r.post_id: r.row_no for r in sel.settled_by_class(classes_of(df)).collect()}
    want = expected(rows)
    assert len(settled) > 60 and all(want[p] == n for p, n in settled.items())


def crowded(rng, posts, many, in_order):
    rows = groups(rng, posts, True)
    for post in range(posts):
        kinds = [r for r in rows if r["post_id"] == post]
        for k in range(many):
            row_no = 1_000 + k
            base = row_no if in_order else rng.randint(1, 10_000)
            r = dict(rng.choice(kinds), row_no=row_no)
            rows.append({**r, "quality": base + r["live"] * 50_000 + r["variant"] * 40_000})
    return rows


@pytest.mark.parametrize("in_order", [True, False])
def test_few_candidates_of_crowded_songs_are_replayed(spark, monkeypatch, in_order):
    rows = crowded(random.Random(21), 40, 200, in_order)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    replay, replayed = sel.replay, []

    def counted(candidates, *more):
        replayed.append(candidates.count())
        return replay(candidates, *more)

    monkeypatch.setattr(sel, "replay", counted)
    best = sel.best_by_fold(classes_of(df), lambda posts: df.join(posts.select("post_id"), "post_id", "left_semi"))
    assert {r.post_id: r.row_no for r in best.collect()} == expected(rows)
    assert sum(replayed) < len(rows) / 3


def test_candidates_without_a_quality_set_no_bounds(spark):
    rows = [{**r, "quality": None if r["row_no"] % 40 == 0 else r["quality"]} for r in crowded(random.Random(3), 20, 40, False)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    named = sel.named_artists(df)
    bounds = sel.deciding(sel.kinds_of_posts(df, named))
    known = {r.post_id for r in bounds.filter("since is not null").collect()}
    assert not known & {r["post_id"] for r in rows if r["quality"] is None}
    left = sel.within(df.join(bounds, "post_id")).drop("since", "until")
    whole, part = ({(r.post_id, r.row_no) for r in sel.replay(d, 16, named).collect()} for d in (df, left))
    assert whole == part


def test_a_crowded_key_is_folded_like_all_its_candidates(spark, monkeypatch):
    from refrain.operators import link
    from refrain.operators.expand import allowed_language, wanted_keys

    rng = random.Random(8)
    songs = spark.createDataFrame([(1, "Abba", "Stay"), (2, "The Abba", "Stay (remix)"), (3, "Abba", "The stay"), (4, "ABBA & Kiss", "Stay")],
                                  "post_id long, artist string, song string")
    put = spark.createDataFrame([(3, "The Abba", "Stay", None, None, "by ear"), (4, "Abba", "Stay", None, None, "by ear")],
                                "post_id long, artist string, title string, `from` string, language string, why string")
    raw = spark.createDataFrame([
        (k, f"r{k}", rng.choice(["ABBA", "The ABBA", "Abba and Kiss"]), ["a1"], rng.choice(["Stay", "Stay", "Stay (remix)", "Stay / Go", "Stays", "The Stay"]),
         rng.choice(["Live at home", "Stay", "x", "y"]), rng.choice([k, rng.randint(1, 500)])) for k in range(500)
    ], "row_no long, recording_id string, credit string, artist_ids array<string>, recording string, release string, score long")
    dump, allow = link.prepare_dump(raw).localCheckpoint(), allowed_language(songs, put)
    wanted = wanted_keys(songs, put).localCheckpoint()
    rows = link.link_exact(wanted, dump, classes=False).unionByName(link.link_prefix(wanted, dump, classes=False)).localCheckpoint()
    whole = {r.post_id: (r.row_no, r.rank, r.how, r.proposed) for r in sel.replay(rows).collect()}
    replay, replayed = sel.replay, []

    def counted(candidates, *more):
        replayed.append(candidates.count())
        return replay(candidates, *more)

    monkeypatch.setattr(sel, "replay", counted)
    best = link.link_keys(wanted, allow, dump, "fold").collect()
    assert {r.post_id: (r.row_no, r.rank, r.how, r.proposed) for r in best} == whole and len(whole) == 4
    assert sum(replayed) < rows.count() / 8
