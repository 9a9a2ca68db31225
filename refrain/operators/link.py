"""Linkage joins between a catalogue and a very large dump.

Every join is an equi-join. Dump rows are digested before they meet the catalogue: for one
asking key only the first row of lowest quality per (how, live, variant) class can win, so a
key shared by a third of the dump still sends a handful of rows on. Each operator can give
that digest (``classes``), whose rows are known by number and fetched for winners only, or all
candidate rows, which only the ordered fold needs and only for a few songs.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.names import artist_fragments, has_article, lead_artist
from refrain.functions.similarity import (
    credit_parts, keys_accept_title, near_blocks, near_by, near_probes, nearly_same, tolerance,
)
from refrain.functions.text import combined_lookup, combined_lookup_of
from refrain.functions.titles import (
    is_live_release, is_variant_recording, medley_head, strip_annotation, title_alternatives,
)
from refrain.operators.expand import PROPOSAL_FIELDS
from refrain.operators.select import ROW, best_match, within
from refrain.session import cut_lineage, dealt_out

HOW = {name: index for index, name in enumerate(fixed.HOWS)}
GRADED = ["live", "variant_plain", "variant_asked"]
#: More than any row number, and no more than fits beside a quality in one number.
_ROWS = Decimal(10) ** 19


def prepare_dump(dump: DataFrame) -> DataFrame:
    """Dump rows with the keys and grades all passes share; write it out once and reuse it.

    Needs row_no, recording_id, credit, artist_ids, recording, release, score; ``key`` is kept
    where the dump brings one. Own blank keys need no filter: no join asks for them.
    """
    key = combined_lookup(F.col("credit"), F.col("recording"))
    if "key" in dump.columns:
        key, dump = F.col("key"), dump.filter(F.col("key") != "")
    recording, release = F.col("recording"), F.col("release")
    graded = dealt_out(dump).withColumn("bare", strip_annotation(recording)).select(
        *ROW, key.alias("key"), combined_lookup(recording).alias("recording_key"),
        combined_lookup(F.col("bare")).alias("bare_key"),
        combined_lookup(F.col("credit")).alias("credit_key"), is_live_release(release).alias("live"),
        is_variant_recording(recording, F.lit(False)).alias("variant_plain"),
        is_variant_recording(recording, F.lit(True)).alias("variant_asked"),
        combined_lookup(release).alias("release_key"),
    )
    base = (
        F.col("score") + F.when(F.col("live"), fixed.LIVE_PENALTY).otherwise(0)
        - F.when(F.col("release_key") == F.col("bare_key"), fixed.TITLE_RELEASE_BONUS).otherwise(0)
    )
    return graded.withColumn("base_quality", base).drop("release_key")


def digest(rows: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """First row of lowest quality per key and class, with the number of rows behind it.

    Within a class the variant penalty is constant, so the base quality decides. Quality and row are one number of
    fixed width, so the minimum is hashed and combined before the shuffle and nothing is sorted; what else is known of
    the row is fetched for winners only (``with_rows``). Told apart ``by`` more columns, a class also has its last row and
    by how much its highest quality exceeds the lowest (null if one of its rows has no quality or number).
    """
    whole = F.col("base_quality").cast("decimal(18,0)") * F.lit(_ROWS).cast("decimal(20,0)")
    packed = (whole + F.col("row_no").cast("decimal(19,0)")).cast("decimal(38,0)")
    whole_class = F.count(packed) == F.count(F.lit(1))
    more = [F.max("row_no").alias("last_row"), F.when(whole_class, F.max("base_quality")).alias("most")] if by else []
    least = rows.groupBy(*keys, *by, *GRADED).agg(F.min(packed).alias("m"), F.count(F.lit(1)).alias("seen"), *more)
    row_no = F.pmod("m", F.lit(_ROWS).cast("decimal(20,0)"))
    quality = ((F.col("m") - row_no).cast("decimal(38,0)") / F.lit(_ROWS).cast("decimal(20,0)"))
    quality = quality.cast("bigint")
    bounds = ["last_row", (F.col("most") - quality).alias("spread")] if by else []
    return least.select(*keys, *by, *GRADED, row_no.cast("bigint").alias("row_no"), quality.alias("base_quality"), "seen", *bounds)


def with_rows(best: DataFrame, dump: DataFrame, allow: DataFrame) -> DataFrame:
    """Winners, known by row_no, with what the dump says of their rows."""
    known = [*ROW, *GRADED, "live", "variant", "quality"]
    rows = best.select(*[c for c in best.columns if c == "row_no" or c not in known]).join(dump.select(*ROW, *GRADED, "base_quality"), "row_no")
    return _shaped(_graded(rows.join(allow, "post_id")))


def _graded(rows: DataFrame) -> DataFrame:
    """Fix ``variant`` and ``quality`` by whether the song asks for a language version."""
    variant = F.when(F.col("allow_language"), F.col("variant_asked")).otherwise(F.col("variant_plain"))
    return rows.withColumn("variant", variant).withColumn(
        "quality", F.col("base_quality") + F.when(variant, fixed.VARIANT_PENALTY).otherwise(0)
    ).drop("variant_plain", "variant_asked", "base_quality", "allow_language")


def _candidates(rows: DataFrame, number: int) -> DataFrame:
    """Uniform candidate columns for a later pass, whose entries carry no rewriting; of the row what is known."""
    plain = rows.withColumns({
        "rank": F.lit(0), "rewrites": F.array().cast("array<string>"), "proposed": F.lit(False), "pass": F.lit(number),
        **{n: F.lit(None).cast(t) for n, t in PROPOSAL_FIELDS.items()},
    })
    return _shaped(plain)


def _shaped(rows: DataFrame) -> DataFrame:
    known = [c for c in [*ROW, "live", "variant", "quality"] if c in rows.columns]
    columns = ["post_id", "pass", "rank", "how", "rewrites", "proposed", *PROPOSAL_FIELDS, *known]
    return rows.select(*[F.col(f"`{c}`") for c in columns], *[c for c in ("seen", "last_row", "spread") if c in rows.columns])


# --- pass 1: artist and title together -------------------------------------------------


def prefix_asks(keys: DataFrame, dump: DataFrame) -> DataFrame:
    """Dump rows whose key is not wanted, under the longest wanted key that heads it, graded.

    Only four kinds of head can be graded at all: the key without its bracket, the medley's
    first half, and heads at most two letters short. Those are probed by equality, once; a probe
    that hits is kept if no longer wanted key heads the row too.
    """
    credit, recording = F.col("credit"), F.col("recording")
    stripped = combined_lookup_of(credit, strip_annotation(recording))
    medley = combined_lookup_of(credit, strip_annotation(medley_head(recording)))
    probed = dump.withColumn("version", F.array(stripped, medley)).withColumn(
        "shortest", F.greatest(F.lit(1), F.length(combined_lookup(credit, recording)) - 2)
    )
    size = F.length("key")
    heads = F.when(F.col("shortest") < size, F.transform(
        F.sequence(F.col("shortest"), size - 1), lambda n: F.substring(F.col("key"), F.lit(1), n)
    ))
    probes = F.concat("version", F.coalesce(heads, F.array().cast("array<string>")))
    probed = probed.withColumn("asked", F.explode(F.array_distinct(F.filter(
        probes,
        lambda p: p.isNotNull() & (p != "") & (p != F.col("key")) & F.startswith(F.col("key"), p),
    )))).withColumn(
        "how", F.when(F.array_contains("version", F.col("asked")), HOW["version"]).otherwise(HOW["spelling"])
    ).drop("version", "shortest")
    known = keys.select("key").distinct()
    hits = cut_lineage(probed.join(known.withColumnRenamed("key", "asked"), "asked", "left_semi"))
    longer = hits.select("key", "asked").distinct().withColumn("n", F.explode(
        F.sequence(F.length("asked") + 1, F.length("key"))
    )).select(F.col("key").alias("whole"), "asked", F.substring(F.col("key"), F.lit(1), F.col("n")).alias("key"))
    outdone = longer.join(known, "key", "left_semi").select(F.col("whole").alias("key"), "asked").distinct()
    return hits.join(outdone, ["key", "asked"], "left_anti")


def exact_asks(keys: DataFrame, dump: DataFrame) -> DataFrame:
    """Dump rows under a wanted key, graded exact."""
    known = keys.select("key").distinct()
    return dump.join(known, "key", "left_semi").withColumn("asked", F.col("key")).withColumn("how", F.lit(HOW["exact"]))


def _answered(wanted: DataFrame, asked: DataFrame) -> DataFrame:
    rows = wanted.withColumnRenamed("key", "asked").join(asked, "asked").withColumn("pass", F.lit(1))
    return _shaped(_graded(within(rows) if "since" in rows.columns else rows))


def link_exact(wanted: DataFrame, dump: DataFrame, classes: bool = True) -> DataFrame:
    """Candidates whose combined key is wanted as it stands."""
    asked = exact_asks(wanted, dump)
    return _answered(wanted, digest(asked, ["asked", "how"]) if classes else asked)


def link_prefix(wanted: DataFrame, dump: DataFrame, classes: bool = True) -> DataFrame:
    """Candidates reached through the longest wanted head of their key."""
    asked = prefix_asks(wanted, dump)
    return _answered(wanted, digest(asked, ["asked", "how"]) if classes else asked)


def link_keys(wanted: DataFrame, allow: DataFrame, dump: DataFrame, mode: str = "fold") -> DataFrame:
    """Pass 1: the best row per song over exact and prefix candidates."""
    asked = exact_asks(wanted, dump).unionByName(prefix_asks(wanted, dump))
    if mode == "fold":  # which reads them three times
        asked = cut_lineage(asked)
    classes = _answered(wanted, digest(asked, ["asked", "how"]))

    def asked_of(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
        entries = wanted.join(posts, "post_id")
        return entries, asked.join(entries.select(F.col("key").alias("asked")).distinct(), "asked", "left_semi")

    def digests_of(posts: DataFrame) -> DataFrame:
        entries, rows = asked_of(posts)
        return _answered(entries, digest(rows, ["asked", "how"], ("credit",)))

    return with_rows(best_match(classes, lambda posts: _answered(*asked_of(posts)), mode, digests_of), dump, allow)


# --- learning which ids an artist string means ------------------------------------------


def trusted_songs(catalog: DataFrame, best: DataFrame) -> DataFrame:
    found = best.filter(F.col("how") != HOW["loose"]).select("post_id", "how", "credit", "artist_ids")
    return catalog.select("post_id", "artist").join(found, "post_id")


def learn_ids(catalog: DataFrame, best: DataFrame, again: bool = False) -> DataFrame:
    """(artist_key, artist_id): what each artist string, lead and credited part turned out to name.

    The second round (``again``) learns the credits of title-first hits instead of credit parts.
    """
    known = trusted_songs(catalog, best)
    lead = combined_lookup_of(lead_artist(F.col("artist")))
    own = known.select(combined_lookup(F.col("artist")).alias("artist_key"), F.explode("artist_ids").alias("artist_id"))
    leads = known.select(lead.alias("artist_key"), F.get("artist_ids", F.lit(0)).alias("artist_id"))
    if again:
        more = known.filter((F.col("how") == HOW["title-first"]) & (F.size("artist_ids") > 0)).select(
            combined_lookup(F.col("credit")).alias("artist_key"), F.explode("artist_ids").alias("artist_id")
        )
    else:
        parts = artist_fragments(F.col("credit"))
        more = known.filter((F.size(parts) > 1) & (F.size(parts) == F.size("artist_ids"))).select(
            F.explode(F.arrays_zip(parts.alias("part"), F.col("artist_ids").alias("artist_id"))).alias("z")
        ).select(combined_lookup(F.col("z.part")).alias("artist_key"), F.col("z.artist_id").alias("artist_id"))
    return own.unionByName(leads).unionByName(more).filter(
        F.col("artist_key").isNotNull() & F.col("artist_id").isNotNull()
    ).distinct()


def unmatched(catalog: DataFrame, best: DataFrame) -> DataFrame:
    return catalog.join(best.select("post_id"), "post_id", "left_anti")


def unmatched_or_poor(catalog: DataFrame, best: DataFrame) -> DataFrame:
    """Songs with no row, or held by a live or variant one."""
    good = best.filter(~F.col("live") & ~F.col("variant")).select("post_id")
    return catalog.join(good, "post_id", "left_anti")


# --- passes 2 and 3b: the artist is known, the title alone places the song ---------------


def _title_keys() -> Column:
    return F.array_distinct(F.transform(title_alternatives(F.col("song")), lambda title: combined_lookup(title)))


def known_pairs(asks: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``asks`` (artist_key, recording_key, ...) with the rows of that title by an id the string names.

    A string may name very many ids, but an id goes by few strings. So the asked titles' ids are
    looked up to the strings they go by, and only (string, title, id) triples that a song asks for
    meet the songs and the rows.
    """
    known = rows.select("recording_key", "artist_id").distinct().join(ids, "artist_id")
    asked = asks.select("artist_key", "recording_key").distinct()
    triples = known.join(asked, ["artist_key", "recording_key"], "left_semi")
    return asks.join(triples, ["artist_key", "recording_key"]).join(rows, ["recording_key", "artist_id"])


def _scoped_asks(songs: DataFrame, ids: DataFrame) -> DataFrame:
    """(post_id, artist_key, recording_key, via_lead): each title form under the own string if known, else the lead."""
    keyed = songs.select(
        "post_id", combined_lookup(F.col("artist")).alias("own_key"),
        combined_lookup_of(lead_artist(F.col("artist"))).alias("lead_key"), F.explode(_title_keys()).alias("recording_key"),
    ).filter(F.col("recording_key") != "")
    known = ids.select(F.col("artist_key").alias("own_key")).distinct()
    own = keyed.join(known, "own_key", "left_semi").withColumn("via_lead", F.lit(False))
    lead = keyed.join(known, "own_key", "left_anti").filter(F.col("lead_key").isNotNull()).withColumn("via_lead", F.lit(True))
    return own.unionByName(lead).select(
        "post_id", F.when(F.col("via_lead"), F.col("lead_key")).otherwise(F.col("own_key")).alias("artist_key"),
        "recording_key", "via_lead",
    )


def _by_title_and_id(dump: DataFrame) -> DataFrame:
    """Dump rows per credited id, kept where the key ends with the recording's own key."""
    return dump.filter(F.endswith("key", "recording_key")).select(
        "*", F.posexplode("artist_ids").alias("at", "artist_id")
    ).withColumn("first", F.col("at") == 0).drop("at")


def link_scoped(
    songs: DataFrame, allow: DataFrame, dump: DataFrame, ids: DataFrame, number: int = 2, classes: bool = True,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Candidates by known artist id (or the lead's, which then must be credited first) and whole title."""
    asks = _scoped_asks(songs, ids)
    rows = _by_title_and_id(dump).join(asks.select("recording_key").distinct(), "recording_key", "left_semi")
    if classes:
        rows = digest(rows, ["recording_key", "artist_id", "first"], by)
    joined = known_pairs(asks, rows, ids).filter(~F.col("via_lead") | F.col("first")).join(allow, "post_id")
    how = F.when(F.col("via_lead"), HOW["lead-scoped"]).otherwise(HOW["artist-scoped"])
    found = _candidates(_graded(joined.withColumn("how", how)), number)
    return found if classes else found.dropDuplicates(["post_id", "row_no"])


def upgrade_scoped(
    songs: DataFrame, allow: DataFrame, dump: DataFrame, ids: DataFrame, best: DataFrame, mode: str = "fold"
) -> DataFrame:
    """Pass 2 winners, starting from the row a song already holds."""
    held = _shaped(best)
    known = held.drop(*[c for c in ROW if c != "row_no"]).join(songs, "post_id", "left_semi")
    classes = link_scoped(songs, allow, dump, ids).unionByName(known.withColumn("seen", F.lit(1).cast("long")))

    def rows_of(posts: DataFrame) -> DataFrame:
        again = songs.join(posts, "post_id", "left_semi")
        return link_scoped(again, allow, dump, ids, classes=False).unionByName(held.join(again, "post_id", "left_semi"))

    def digests_of(posts: DataFrame) -> DataFrame:
        again = songs.join(posts, "post_id", "left_semi")
        own = held.drop(*[c for c in ROW if c not in ("row_no", "credit")]).join(again, "post_id", "left_semi").withColumns({
            "seen": F.lit(1).cast("long"), "last_row": F.col("row_no"),
            "spread": F.when(F.col("row_no").isNotNull(), F.lit(0)).cast("long")})
        return link_scoped(again, allow, dump, ids, by=("credit",)).unionByName(own)

    return with_rows(best_match(classes, rows_of, mode, digests_of), dump, allow)


# --- pass 2b: every named part of a collaboration must be credited, in any order ----------


def link_collab(songs: DataFrame, dump: DataFrame, ids: DataFrame) -> DataFrame:
    """Candidates, by row_no, crediting all known parts of the artist string, at least two of them.

    Rows are found through the first known part and kept when every part finds one of its ids
    among the row's credits; the sets of ids are looked up, never gathered.
    """
    parts = songs.select("post_id", F.posexplode(artist_fragments(F.col("artist"))).alias("part_no", "part")).select(
        "post_id", "part_no", combined_lookup(F.col("part")).alias("part_key"),
        F.when(~has_article(F.col("part")), combined_lookup_of(F.concat(F.lit("The "), F.col("part")))).alias("the_key"),
    )
    known = ids.select("artist_key").distinct()
    own = parts.join(known.withColumnRenamed("artist_key", "part_key"), "part_key", "left_semi").select(
        "post_id", "part_no", F.col("part_key").alias("artist_key")
    )
    article = parts.join(own, ["post_id", "part_no"], "left_anti").join(
        known.withColumnRenamed("artist_key", "the_key"), "the_key", "left_semi"
    ).select("post_id", "part_no", F.col("the_key").alias("artist_key"))
    named = cut_lineage(own.unionByName(article))
    needed = named.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("needed"), F.min_by("artist_key", "part_no").alias("artist_key")
    ).filter("needed >= 2")
    asks = cut_lineage(needed.join(songs, "post_id").select(
        "post_id", "needed", "artist_key", F.explode(_title_keys()).alias("recording_key")
    ).filter(F.col("recording_key") != ""))
    rows = _by_title_and_id(dump).join(asks.select("recording_key").distinct(), "recording_key", "left_semi")
    firsts = rows.groupBy("recording_key", "artist_id", "artist_ids").agg(F.min("row_no").alias("row_no"))
    firsts = cut_lineage(firsts)
    pairs = cut_lineage(known_pairs(asks, firsts, ids).drop("artist_id", "artist_key").dropDuplicates(["post_id", "row_no"]))
    credited = pairs.select("post_id", "row_no", F.explode("artist_ids").alias("artist_id"))
    held = credited.join(named, "post_id").join(ids, ["artist_key", "artist_id"], "left_semi").groupBy(
        "post_id", "row_no"
    ).agg(F.count_distinct("part_no").alias("held"))
    joined = pairs.join(held, ["post_id", "row_no"]).filter(F.col("held") == F.col("needed")).select("post_id", "row_no")
    return _candidates(joined.withColumn("how", F.lit(HOW["collab-scoped"])), 3)


# --- pass 3: an exact title whose credit is close enough ---------------------------------


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), v))


def _credit_blocks() -> Column:
    """Blocks (own_key, lead_key) can meet a credit in; together they cover every accepted pair."""
    own, lead = F.col("own_key"), F.col("lead_key")
    by_lead = F.concat(
        F.array(
            F.concat(F.lit("h"), F.least(F.length(lead), F.lit(5)).cast("string"), F.lit(":"), F.substring(lead, 1, 5)),
            F.concat(F.lit("l="), lead),
        ),
        _tagged("n", near_probes("lead_key")), _tagged("l", near_probes("lead_key")),
    )
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("h5:"), F.substring(own, 1, 5)), F.concat(F.lit("="), own)),
        _tagged("n", near_probes("own_key")),
        F.when(F.coalesce(lead, F.lit("")) != "", by_lead).otherwise(F.array().cast("array<string>")),
    ))


def _artist_blocks() -> Column:
    """Blocks of a credit (credit_key, credit_lead)."""
    credit = F.col("credit_key")
    heads = F.transform(
        F.sequence(F.lit(1), F.least(F.greatest(F.length(credit), F.lit(1)), F.lit(5))),
        lambda n: F.concat(F.lit("h"), n.cast("string"), F.lit(":"), F.substring(credit, F.lit(1), n)),
    )
    return F.array_distinct(F.concat(
        heads, F.array(F.concat(F.lit("="), credit), F.concat(F.lit("l="), F.col("credit_lead"))),
        _tagged("n", near_blocks("credit_key")), _tagged("l", near_blocks("credit_lead")),
    ))


def link_title_first(songs: DataFrame, dump: DataFrame, classes: bool = False) -> DataFrame:
    """Candidates, by row_no, with the song's exact title and a credit close to its artist string.

    Songs and credits meet on (title, block), never on the title alone; the predicate is then
    checked once per pair of distinct strings. ``classes`` keeps the earliest row per song, combined
    as bare numbers before any song's rows are brought together.
    """
    titles = cut_lineage(
        songs.select("post_id", "artist", F.explode(_title_keys()).alias("asked")).filter(F.length("asked") >= 4)
    )
    known = titles.select("asked").distinct()
    rows = dump.withColumn("asked", F.explode(F.array_distinct(F.array("recording_key", "bare_key")))).filter(
        F.endswith("key", "asked")
    ).join(known, "asked", "left_semi")
    firsts = cut_lineage(rows.groupBy("asked", "credit").agg(F.min("row_no").alias("row_no")))
    parts = credit_parts(F.lit(""), F.col("credit"), lead_artist)
    credits = firsts.select("asked", "credit").withColumns({
        "credit_key": parts["credit"], "credit_lead": parts["credit_lead"]
    })
    asks = titles.select("asked", "artist").distinct().withColumns({
        "own_key": combined_lookup(F.col("artist")), "lead_key": combined_lookup_of(lead_artist(F.col("artist"))),
    })
    left = asks.withColumn("block", F.explode(_credit_blocks()))
    right = credits.withColumn("block", F.explode(_artist_blocks()))
    pairs = left.join(right, ["asked", "block"]).filter(keys_accept_title(
        F.col("own_key"), F.col("credit_key"), F.col("lead_key"), F.col("credit_lead"), F.col("asked")
    )).select("asked", "artist", "credit").distinct()
    nearest = cut_lineage(
        pairs.join(firsts, ["asked", "credit"]).groupBy("asked", "artist").agg(F.min("row_no").alias("row_no"))
    )
    joined = titles.join(nearest, ["asked", "artist"]).select("post_id", "row_no")
    if classes:
        joined = joined.groupBy("post_id").agg(F.min("row_no").alias("row_no"))
    return _candidates(joined.withColumn("how", F.lit(HOW["title-first"])), 4)


# --- pass 4: a misspelled title by a known artist -----------------------------------------


def learn_credits(catalog: DataFrame, best: DataFrame) -> DataFrame:
    """(artist_key, credit_key, artist_id): how known artists' rows are credited."""
    known = trusted_songs(catalog, best)
    credit = combined_lookup(F.col("credit")).alias("credit_key")
    own = known.select(combined_lookup(F.col("artist")).alias("artist_key"), credit, F.col("artist_ids").alias("ids"))
    lead = known.select(
        combined_lookup_of(lead_artist(F.col("artist"))).alias("artist_key"), credit,
        F.array_compact(F.array(F.get("artist_ids", F.lit(0)))).alias("ids"),
    ).filter(F.col("artist_key").isNotNull() & (F.size("ids") > 0))
    return own.unionByName(lead)


def reach_artists(songs: DataFrame, known: DataFrame) -> DataFrame:
    """(post_id, title_key, artist_key): known artists by own or lead key, else within tolerance."""
    wants = songs.select(
        "post_id", combined_lookup_of(strip_annotation(F.col("song"))).alias("title_key"),
        F.explode(F.array_compact(F.array_distinct(F.array(
            combined_lookup(F.col("artist")), combined_lookup_of(lead_artist(F.col("artist")))
        )))).alias("wanted_key"),
    ).filter(F.length("title_key") >= 4)
    strings = wants.select("wanted_key").distinct()
    same = strings.join(known.select(F.col("artist_key").alias("wanted_key")), "wanted_key", "left_semi").withColumn(
        "artist_key", F.col("wanted_key")
    )
    slack = tolerance(F.col("wanted_key"))
    misspelled = strings.join(same.select("wanted_key"), "wanted_key", "left_anti").filter(slack > 0)
    near = misspelled.withColumn("block", F.explode(near_probes("wanted_key"))).join(
        known.select("artist_key", F.explode(near_blocks("artist_key")).alias("block")), "block"
    ).filter(near_by(F.col("artist_key"), F.col("wanted_key"), slack)).select("wanted_key", "artist_key").distinct()
    return wants.join(same.unionByName(near), "wanted_key").select("post_id", "title_key", "artist_key").distinct()


def link_near(
    songs: DataFrame, allow: DataFrame, dump: DataFrame, credits: DataFrame, classes: bool = True, by: tuple[str, ...] = (),
) -> DataFrame:
    """Candidates by a reachable artist whose title is a plausible misspelling.

    Strings meet strings first: distinct dump keys of the reachable ids are cut behind every
    known credit, and what is left meets the wanted titles on (credit, block). Only the pairs
    that pass fetch rows, once per credited id.
    """
    reach = cut_lineage(reach_artists(songs, credits.select("artist_key").distinct()))
    spelled = credits.join(reach.select("artist_key").distinct(), "artist_key", "left_semi")
    heads = cut_lineage(
        spelled.filter(F.col("credit_key") != "").select("artist_key", F.col("credit_key").alias("head")).distinct()
    )
    members = cut_lineage(spelled.select("artist_key", F.explode("ids").alias("artist_id")).distinct())
    by_id = dump.select("*", F.explode("artist_ids").alias("artist_id")).join(
        members.select("artist_id").distinct(), "artist_id", "left_semi"
    )
    # A key is cut only where a credit of its own id's artists can end, not at every letter.
    cuts = members.join(heads, "artist_key").groupBy("artist_id").agg(F.collect_set(F.length("head")).alias("cuts"))
    keys = by_id.select("key", "artist_id").distinct().join(cuts, "artist_id").select("key", F.explode("cuts").alias("cut")).filter(
        F.col("cut") < F.length("key")
    ).distinct().select("key", F.substring(F.col("key"), F.lit(1), F.col("cut")).alias("head")).join(
        heads.select("head").distinct(), "head", "left_semi"
    ).withColumn("rest", F.substring(F.col("key"), F.length("head") + 1, F.length("key")))
    titles = reach.select("title_key", "artist_key").distinct()
    asked = titles.join(heads, "artist_key")
    near = asked.select("head", "title_key").distinct().withColumn("block", F.explode(near_blocks("title_key"))).join(
        keys.select("head", "rest").distinct().withColumn("block", F.explode(near_probes("rest"))), ["head", "block"]
    ).filter(nearly_same(F.col("rest"), F.col("title_key"))).select(
        "head", "title_key", F.concat("head", "rest").alias("key")
    ).distinct()
    pairs = cut_lineage(asked.join(near, ["head", "title_key"]).select("artist_key", "title_key", "key").distinct())
    rows = by_id.join(pairs.select("key").distinct(), "key", "left_semi")
    if classes:
        rows = digest(rows, ["key", "artist_id"], by)
    hits = pairs.join(members, "artist_key").join(rows, ["key", "artist_id"])
    joined = reach.join(hits, ["artist_key", "title_key"]).join(allow, "post_id").withColumn("how", F.lit(HOW["near"]))
    found = _candidates(_graded(joined), 6)
    return found if classes else found.dropDuplicates(["post_id", "row_no"])


def best_near(songs: DataFrame, allow: DataFrame, dump: DataFrame, credits: DataFrame, mode: str = "fold") -> DataFrame:
    classes = link_near(songs, allow, dump, credits)

    def rows_of(posts: DataFrame) -> DataFrame:
        return link_near(songs.join(posts, "post_id", "left_semi"), allow, dump, credits, classes=False)

    def digests_of(posts: DataFrame) -> DataFrame:
        return link_near(songs.join(posts, "post_id", "left_semi"), allow, dump, credits, by=("credit",))

    return with_rows(best_match(classes, rows_of, mode, digests_of), dump, allow)
