"""Choosing one dump row per song from graded candidates.

Two ways to choose are offered. ``total_order`` is a plain lexicographic minimum and works
under any partitioning. ``fold`` keeps the order-dependent displacement rules: candidates
arrive in dump order and each may or may not push out the one held. The fold first settles
every song whose best class of candidates cannot be displaced, from per-class minima alone.
For the others the classes, told apart by credit too, show from where on candidates can still
decide (``deciding``); only those are replayed, in blocks of rows whose effect is summarised
and then chained.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.text import name_key
from refrain.session import cut_lineage

# One candidate: how it was asked for, how it was found and which row it is.
ENTRY = [
    "rank", "how", "rewrites", "proposed", "why", "from", "language", "venue_artist", "proposal_artist",
]
ROW = ["row_no", "recording_id", "credit", "artist_ids", "recording", "release", "score"]
#: Candidates of one song that are folded together before summaries are chained; it decides the cost only.
BLOCK_ROWS = 16


def how_index(how: Column) -> Column:
    return F.array_position(F.array(*[F.lit(h) for h in fixed.HOWS]), how).cast("int") - 1


def how_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(h) for h in fixed.HOWS]), index + 1)


def best_by_total_order(candidates: DataFrame) -> DataFrame:
    """Lowest (not clean, how, rank, quality, row_no) per post; a hash-partitioned minimum."""
    payload = F.struct(*[c for c in candidates.columns if c not in ("post_id", "seen")])
    order = F.struct(
        (F.col("live") | F.col("variant")).cast("int"), "how", "rank", "quality", "row_no", F.col("proposed").cast("int")
    )
    return (
        candidates.groupBy("post_id").agg(F.min_by(payload, order).alias("m")).select("post_id", "m.*")
    )


def best_first(candidates: DataFrame) -> DataFrame:
    """The earliest dump row per post, for passes that stop at their first hit."""
    payload = F.struct(*[c for c in candidates.columns if c not in ("post_id", "seen")])
    return (
        candidates.groupBy("post_id").agg(F.min_by(payload, F.struct("row_no", "how")).alias("m"))
        .select("post_id", "m.*")
    )


def named_artists(candidates: DataFrame) -> DataFrame:
    """post_id, song_artist, put_artist: the catalogue's artist and the proposed one, for posts with a proposal."""
    return candidates.filter("proposed").groupBy("post_id").agg(
        F.max("venue_artist").alias("song_artist"), F.max("proposal_artist").alias("put_artist")
    )


def with_credit_flags(candidates: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Whether each credit names the catalogue's artist or the proposed one (first 12 key letters).

    Both artists come from the song's proposal and are compared with every candidate of the song; ``named`` tells them
    where only some of the candidates are at hand.
    """
    named = named_artists(candidates) if named is None else named
    credit, venue, put = (name_key(F.col(c)) for c in ("credit", "song_artist", "put_artist"))

    def holds(outer: Column, inner: Column) -> Column:
        return F.coalesce(F.contains(outer, F.substring(inner, 1, 12)), F.lit(False))

    has_artist = F.col("proposal_artist").isNotNull() & F.col("venue_artist").isNotNull()
    return candidates.join(named, "post_id", "left").withColumns({
        "names_venue": holds(credit, venue) & F.coalesce(venue != "", F.lit(False)),
        "names_proposed": holds(credit, put),
        "inside_proposed": holds(put, credit),
        "attributes": has_artist,
        "attributed": has_artist & F.coalesce((venue != "") & (put != "") & (venue != put), F.lit(False)),
    }).drop("song_artist", "put_artist")


def accepts(e: Column, n: Column) -> Column:
    """Whether candidate ``n`` displaces the held ``e`` (both structs; ``e`` may be null).

    The two flags about the held credit are taken against the artists of the entry that
    carries them, which every entry of one song shares.
    """
    e_clean = ~e["live"] & ~e["variant"]
    n_clean = ~n["live"] & ~n["variant"]
    stolen_back = e["attributes"] & ~n["attributes"] & n["names_venue"] & ~n["names_proposed"]
    upgrade = (
        (e["live"] & n_clean)
        | (e["variant"] & ~n["variant"] & ((n["rank"] <= e["rank"] + 1) | n["proposed"]))
        | (n_clean & (n["quality"] < e["quality"]) & (n["rank"] <= e["rank"]))
        | ((n["how"] < e["how"]) & (n_clean | n["proposed"]))
        | (n["attributed"] & e["names_venue"] & (n["names_proposed"] | n["inside_proposed"]))
    )
    plain = (n["rank"] < e["rank"]) | (
        (n["rank"] == e["rank"])
        & ((n["how"] < e["how"]) | ((n["how"] == e["how"]) & (n["quality"] < e["quality"])))
    )
    return e.isNull() | (~stolen_back & ~(e_clean & ~n_clean) & (upgrade | plain))


STEP = [
    "rank", "how", "proposed", "live", "variant", "names_venue", "names_proposed", "inside_proposed", "attributes",
    "attributed", "quality",
]


def settled_by_class(classes: DataFrame) -> DataFrame:
    """Posts whose fold has one possible outcome, with that outcome.

    ``classes`` holds, per post and (rank, how, live, variant), the first row of lowest quality.
    Within one class only a lower quality displaces, so a post with a single class is settled.
    Otherwise a clean class that has both the lowest rank and the best how of all clean
    candidates accepts over anything held, if no variant sits more than one rank below it; once
    held, only a better quality at the same rank could displace it. If no such row exists the
    fold must end on the class's own best row, whatever the order.
    """
    clean = ~F.col("live") & ~F.col("variant")
    bounds = classes.groupBy("post_id").agg(
        F.min(F.when(clean, F.col("rank"))).alias("low_rank"),
        F.min(F.when(clean, F.col("how"))).alias("low_how"),
        F.min(F.when(F.col("variant") & ~F.col("live"), F.col("rank"))).alias("variant_rank"),
        F.max("proposed").alias("has_proposal"),
        F.min(F.when(clean, F.struct("rank", "quality"))).alias("rank_quality"),
        F.count(F.lit(1)).alias("classes"), F.sum("seen").alias("all_seen"),
        F.min_by(
            F.struct(*[c for c in classes.columns if c not in ("post_id", "seen")]),
            F.struct((~clean).cast("int"), "rank", "how", "quality", "row_no"),
        ).alias("m"),
    )
    unbeaten = (
        F.col("low_rank").isNotNull()
        & (F.col("m.rank") == F.col("low_rank")) & (F.col("m.how") == F.col("low_how"))
        & (F.col("low_rank") <= F.coalesce(F.col("variant_rank") + 1, F.col("low_rank")))
        & (F.col("rank_quality.quality") >= F.col("m.quality"))
    )
    return bounds.filter(
        (F.col("all_seen") == 1) | (~F.col("has_proposal") & ((F.col("classes") == 1) | F.coalesce(unbeaten, F.lit(False))))
    ).select("post_id", "m.*")


def _kind(e: Column) -> Column:
    """All that decides between two candidates but the quality, as one value."""
    return F.concat_ws(",", *[e[c].cast("int").cast("string") for c in STEP[:-1]])


def _place(row_no: str = "row_no") -> Column:
    """Where a candidate stands in the order of the fold."""
    return F.struct(F.col("pass").cast("int").alias("pass"), F.col(row_no).alias("row_no"), F.col("proposed").cast("int").alias("put"))


def _steps(candidates: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """post_id and n (kind, what decides, and the row's place) for every candidate."""
    rows = with_credit_flags(candidates, named).withColumn("quality", F.col("quality").cast("double"))
    decides = F.struct(*[F.col(c) for c in STEP])
    return rows.select("post_id", _place().alias("place"), _kind(decides).alias("kind"), decides.alias("n"))


def kinds_of_posts(rows: DataFrame, named: DataFrame) -> DataFrame:
    """post_id, k: all that decides but the quality (n), its least and most quality, the first row of the least, the last row.

    ``rows`` are candidates, or digests of them that tell credits apart: the first row of lowest quality, with the last row
    (``last_row``) and by how much the highest quality exceeds the lowest (``spread``). Where one has no quality or row
    number, there is no most.
    """
    if "last_row" not in rows.columns:
        rows = rows.withColumns({"last_row": F.col("row_no"), "spread": F.when(F.col("row_no").isNotNull(), F.lit(0))})
    rows = with_credit_flags(rows, named).withColumn("quality", F.col("quality").cast("double"))
    most = F.col("quality") + F.col("spread")
    found = rows.groupBy("post_id", *STEP[:-1]).agg(
        F.min(F.struct("quality", _place().alias("place"))).alias("m"), F.max(_place("last_row")).alias("last"),
        F.when(F.count(most) == F.count(F.lit(1)), F.max(most)).alias("most"),
    )
    n = F.struct(*STEP[:-1]).alias("n")
    return found.select("post_id", F.struct(n, F.col("m.quality").alias("least"), "most", F.col("m.place").alias("first"), "last").alias("k"))


def _bound(place: Column, after: int) -> Column:
    return F.struct(place["pass"].alias("pass"), place["row_no"].alias("row_no"), place["put"].alias("put"), F.lit(after).alias("after"))


def deciding(kinds: DataFrame) -> DataFrame:
    """post_id, since, until (either may be null): the candidates whose fold, from nothing held, ends as that of all.

    Of two kinds one takes over from the other always, only by a lower quality (so always or never if the bounds of both
    are apart), or never. Where a kind has no bounds nothing is known of its post.

    - If the first row of lowest quality of a kind J takes over from all that may be held, it is held once it has come:
      nothing before it counts. If no kind can take over from it afterwards, it is the winner.
    - If every row of J takes over from every other kind: after a row of another kind that takes over from all of J, nothing
      of J is held, so the first row of J that follows is held next. Nothing up to that other row counts, if any J follows.
    """
    j, x = F.col("j"), F.col("x")
    pairs = kinds.withColumnRenamed("k", "j").join(kinds.withColumnRenamed("k", "x"), "post_id")
    low, high = F.lit(float("-inf")), F.lit(float("inf"))

    def at(k: Column, quality: Column) -> Column:
        return F.struct(*[k["n"][c].alias(c) for c in STEP[:-1]], quality.alias("quality"))

    def sure(condition: Column) -> Column:
        return F.coalesce(j["most"].isNotNull() & x["most"].isNotNull() & condition, F.lit(False))

    same = j["n"] == x["n"]
    plainly, if_lower = accepts(at(x, low), at(j, j["least"])), accepts(at(x, high), at(j, j["least"]))
    least_takes, all_take = (plainly | (if_lower & (j[bound] < x["least"])) for bound in ("least", "most"))
    always, by_quality = accepts(at(j, low), at(x, x["least"])), accepts(at(j, high), at(x, x["least"]))
    harmless = ~by_quality | (~always & (x["least"] >= j["least"])) | (x["last"] < j["first"]) | (same & (x["last"] == j["first"]))
    every = always | (by_quality & (x["most"] < j["least"]))
    least = by_quality & (x["least"] < j["least"])
    ends = F.greatest(*[F.when(sure(~same & out & (place < j["last"])), _bound(place, 1)) for out, place in ((every, x["last"]), (always | least, x["first"]))])
    judged = pairs.groupBy("post_id", "j").agg(
        F.min(sure(same | least_takes)).alias("least_takes"), F.min(sure(same | all_take)).alias("all_take"),
        F.min(sure(harmless)).alias("unbeaten"), F.max(ends).alias("cleared"))
    held = F.when(F.col("least_takes"), _bound(F.col("j.first"), 0))
    since = F.greatest(held, F.when(F.col("all_take"), F.col("cleared")))
    return judged.groupBy("post_id").agg(F.max(since).alias("since"), F.max(F.when(F.col("unbeaten"), held)).alias("until")).select(
        "post_id", F.coalesce("until", "since").alias("since"), "until")


def within(rows: DataFrame) -> DataFrame:
    """The rows between since and until; a null bound is none."""
    place = _bound(_place(), 0)
    return rows.filter(F.coalesce(place >= F.col("since"), F.lit(True)) & F.coalesce(place <= F.col("until"), F.lit(True)))


def _blocks(steps: DataFrame, block_rows: int) -> DataFrame:
    """post_id, block (0, 1, ... per post in order), steps: at most ``block_rows`` candidates each, in order.

    A range of (post, place) is numbered where it lies, so the candidates of one post never meet in one place.
    """
    ranged = cut_lineage(steps.repartitionByRange("post_id", "place").withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part", "post_id").orderBy("place")) - 1
    blocks = ranged.withColumn("local", F.floor(inside / block_rows)).groupBy("post_id", "part", "local").agg(
        F.array_sort(F.collect_list(F.struct("place", "kind", "n"))).alias("steps")
    )
    sizes = ranged.groupBy("post_id", "part").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("size"))
    before = F.sum("size").over(Window.partitionBy("post_id").orderBy("part")) - F.col("size")
    total = F.sum("size").over(Window.partitionBy("post_id"))
    starts = sizes.select("post_id", "part", before.alias("before"), total.alias("blocks"))
    return blocks.join(starts, ["post_id", "part"]).select(
        "post_id", (F.col("before") + F.col("local")).alias("block"), "blocks", "steps"
    )


def _held(e: Column) -> Column:
    return F.struct(e["place"].alias("place"), e["kind"].alias("kind"), e["n"]["quality"].alias("quality"))


def _with_ends(steps: Column, kind: str) -> Column:
    """Every step of a block with the row that is held at the block's end once this one is."""
    def prepended(seen: Column, e: Column) -> Column:
        taker = F.get(F.filter(seen, lambda later: accepts(e["n"], later["n"])), F.lit(0))
        entry = F.struct(e["n"].alias("n"), F.coalesce(taker["end"], _held(e)).alias("end"))
        return F.concat(F.array(entry), seen)

    return F.aggregate(F.reverse(steps), F.array().cast(kind), prepended)


def block_effects(blocks: DataFrame) -> DataFrame:
    """post_id, block, kind, floor, ceiling, end: what a block does to whatever is held when it starts.

    A held candidate of ``kind`` and a quality in (floor, ceiling] ends as the row ``end``; where no interval holds
    it, it stays. Kind and quality decide alone, and the quality only by comparison: of one kind, a step takes over
    from every quality, from all higher than its own, or from none. The empty kind is nothing held yet.
    """
    every, low, high = F.lit(""), F.lit(float("-inf")), F.lit(float("inf"))
    element = blocks.select(F.transform("steps", lambda e: F.struct(e["n"].alias("n"), _held(e).alias("end"))).alias("s")).schema["s"].dataType.simpleString()
    known = blocks.filter("blocks > 1").select("post_id", F.explode("steps").alias("e")).groupBy("post_id").agg(
        F.collect_set(F.struct(F.col("e.kind").alias("kind"), F.struct(*[F.col(f"e.n.{c}").alias(c) for c in STEP[:-1]]).alias("n"))).alias("kinds")
    )
    ended = blocks.select("post_id", "block", _with_ends(F.col("steps"), element).alias("ends"))
    first = ended.filter("block = 0").select(
        "post_id", "block", every.alias("kind"), low.alias("floor"), high.alias("ceiling"), F.col("ends")[0]["end"].alias("end")
    )

    def at(k: Column, quality: Column) -> Column:
        return F.struct(*[k["n"][c].alias(c) for c in STEP[:-1]], quality.alias("quality"))

    kind = first.select(F.struct("floor", "ceiling", "end").alias("s")).schema["s"].dataType.simpleString()

    def taken(k: Column) -> Column:
        def step(state: Column, e: Column) -> Column:
            always = accepts(at(k, low), e["n"])
            below = accepts(at(k, high), e["n"]) & (e["n"]["quality"] < state["open"])
            floor = F.when(always, low).otherwise(e["n"]["quality"])
            more = F.struct(floor.alias("floor"), state["open"].alias("ceiling"), e["end"].alias("end"))
            moved = F.struct(floor.alias("open"), F.concat(state["taken"], F.array(more)).alias("taken"))
            return F.when((state["open"] > low) & (always | below), moved).otherwise(state)

        return F.aggregate("ends", F.struct(high.alias("open"), F.array().cast(f"array<{kind}>").alias("taken")), step)["taken"]

    of_kinds = ended.filter("block > 0").join(known, "post_id").select("post_id", "block", F.explode("kinds").alias("k"), "ends")
    rest = of_kinds.select("post_id", "block", F.col("k.kind").alias("kind"), F.explode(taken(F.col("k"))).alias("t"))
    return first.unionByName(rest.select("post_id", "block", "kind", "t.floor", "t.ceiling", "t.end"))


def chained(effects: DataFrame) -> DataFrame:
    """The effects of neighbouring blocks as those of one block: first the even one, then the odd one after it."""
    paired = effects.withColumn("pair", F.floor(F.col("block") / 2))
    first, then = (paired.filter(F.col("block") % 2 == k).drop("block") for k in (0, 1))
    after = then.select("post_id", "pair", *[F.col(c).alias(f"then_{c}") for c in ("kind", "floor", "ceiling", "end")])
    inside = (F.col("then_floor") < F.col("end.quality")) & (F.col("end.quality") <= F.col("then_ceiling"))
    same = [first["post_id"] == after["post_id"], first["pair"] == after["pair"], first["end"]["kind"] == after["then_kind"], inside]
    went_on = first.join(after, reduce(Column.__and__, same), "left").select(
        first["post_id"], first["pair"], "kind", "floor", "ceiling", F.coalesce("then_end", "end").alias("end")
    )
    least = first.groupBy("post_id", "pair", "kind").agg(F.min("floor").alias("open"))
    ceiling = F.least("ceiling", F.coalesce("open", F.lit(float("inf"))))
    untouched = then.join(least, ["post_id", "pair", "kind"], "left").withColumn("ceiling", ceiling).filter("floor < ceiling").drop("open")
    both = went_on.unionByName(untouched).withColumnRenamed("pair", "block")
    # Neighbouring intervals that end alike are one.
    order = Window.partitionBy("post_id", "block", "kind").orderBy(F.desc("ceiling"))
    begins = F.coalesce((F.lag("end").over(order) != F.col("end")) | (F.lag("floor").over(order) != F.col("ceiling")), F.lit(True))
    runs = both.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    return runs.groupBy("post_id", "block", "kind", "run").agg(
        F.min("floor").alias("floor"), F.max("ceiling").alias("ceiling"), F.first("end").alias("end")
    ).drop("run")


def replay(candidates: DataFrame, block_rows: int = BLOCK_ROWS, named: DataFrame | None = None) -> DataFrame:
    """The fold of any number of candidates per post, in (pass, row_no, proposed) order.

    Blocks of rows are summarised apart, and neighbouring summaries chained, twice as many rows each round, until one
    block per post is left; what it makes of nothing held is the winner.
    """
    blocks = cut_lineage(_blocks(_steps(candidates, named), block_rows))
    effects, most = cut_lineage(block_effects(blocks)), blocks.agg(F.max("block")).first()[0] or 0
    while most:
        effects, most = cut_lineage(chained(effects)), most // 2
    won = effects.filter("kind = ''").select("post_id", "end.place.*")
    same = (candidates["post_id"] == won["post_id"]) & (candidates["pass"] == won["pass"]) & (candidates["row_no"] == won["row_no"]) & (
        candidates["proposed"].cast("int") == won["put"])
    return candidates.join(won, same, "left_semi")


def best_by_fold(
    classes: DataFrame, rows_of: Callable[[DataFrame], DataFrame], block_rows: int = BLOCK_ROWS,
    digests_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The ordered displacement fold over any number of candidates.

    ``classes`` is the per-class digest with ``seen`` rows behind each entry; ``rows_of`` returns
    the full candidates of the posts it is given: those that the classes alone do not settle. The posts
    come with the bounds that ``digests_of``, by default the candidates themselves, sets them
    (``deciding``); it may leave out candidates beyond.
    """
    classes = cut_lineage(classes)
    settled = cut_lineage(settled_by_class(classes))
    unsettled = cut_lineage(classes.select("post_id").distinct().join(settled.select("post_id"), "post_id", "left_anti"))
    digests = cut_lineage((digests_of or rows_of)(unsettled))
    named = cut_lineage(named_artists(digests))

    def bounded(rows: DataFrame) -> DataFrame:
        return cut_lineage(unsettled.join(deciding(cut_lineage(kinds_of_posts(rows, named))), "post_id", "left"))

    bounds = bounded(digests)
    rows = cut_lineage(within(rows_of(bounds).join(bounds, "post_id")).drop("since", "until"))
    # What is left is a fold again, of which the kinds may now say more.
    rows = cut_lineage(within(rows.join(bounded(rows), "post_id")).drop("since", "until"))
    return settled.unionByName(replay(rows, block_rows, named).select(*settled.columns))


def best_match(
    classes: DataFrame, rows_of: Callable[[DataFrame], DataFrame] | None = None, mode: str = "fold",
    digests_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One winner per post_id, by ``fold``, ``total_order`` or ``first``."""
    if mode == "total_order":
        return best_by_total_order(classes)
    if mode == "first":
        return best_first(classes)
    if mode != "fold" or rows_of is None:
        raise ValueError("mode is fold (with rows_of), total_order or first")
    return best_by_fold(classes, rows_of, digests_of=digests_of)
