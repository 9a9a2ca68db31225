"""Registered linkage queries, each with the SQL its result is checked against."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators import link
from refrain.operators.expand import allowed_language, wanted_keys
from refrain.operators.select import best_match, how_name
from refrain.plans import matching, standins
from refrain.session import cut_lineage, dealt_out


def key(text: str) -> str:
    """The combined key of ASCII text in checking SQL."""
    return f"regexp_replace(lower({text}), '[^a-z0-9_]+', '', 'g')"


def bare(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s*[(\[][^()\[\]]*[)\]]\s*$', ''))"


LEAD = r"trim(regexp_split_to_array(artist, '\s*&\s*')[1])"
HOW_NAMES = (
    "['exact','version','spelling','artist-scoped','lead-scoped','collab-scoped','title-first','near','loose']"
)

INPUTS = f"""
cat AS MATERIALIZED (SELECT *, CASE WHEN artist LIKE '%&%' THEN {LEAD} END AS lead FROM ({standins.sql(standins.CATALOG)})),
dump AS MATERIALIZED (SELECT *, {key('credit || recording')} AS key, {key('recording')} AS recording_key,
    {key(bare('recording'))} AS bare_key, {key('credit')} AS credit_key,
    release LIKE 'Live at %' AS live, recording LIKE '%(remix)' AS variant,
    score + CASE WHEN release LIKE 'Live at %' THEN 50000000 ELSE 0 END
      + CASE WHEN recording LIKE '%(remix)' THEN 40000000 ELSE 0 END
      - CASE WHEN {key('release')} = {key(bare('recording'))} THEN 1000000 ELSE 0 END AS quality
    FROM ({standins.sql(standins.DUMP)}))"""


def wanted_sql(name: str, source: str, artist: str, title: str) -> str:
    """CTEs for the expanded keys of (post_id, artist, title) rows."""
    return f"""
{name}_a0 AS (SELECT post_id, {artist} AS v, 0 AS seq, '' AS r FROM {source}),
{name}_a1 AS (SELECT * FROM {name}_a0 UNION ALL SELECT post_id, 'The ' || v, seq + 2, r || ',artist-article-added'
    FROM {name}_a0 WHERE NOT regexp_matches(v, '(?i)^(the|a|an)\\s+')),
{name}_a2 AS (SELECT * FROM {name}_a1 UNION ALL SELECT post_id, replace(v, '&', ' and '), seq + 10, r || ',ampersand-spelled-out'
    FROM {name}_a1 WHERE v LIKE '%&%'),
{name}_t0 AS (SELECT post_id, {title} AS v, 0 AS seq, '' AS r FROM {source} UNION ALL
    SELECT post_id, {bare(title)}, 1, ',annotation-stripped' FROM {source} WHERE {bare(title)} <> {title}),
{name}_t1 AS (SELECT * FROM {name}_t0
    UNION ALL SELECT post_id, regexp_replace(v, '(?i)^(the|a|an)\\s+', ''), 2 + 3 * seq, r || ',title-article-dropped'
      FROM {name}_t0 WHERE regexp_matches(v, '(?i)^(the|a|an)\\s+')
    UNION ALL SELECT post_id, w.a || ' ' || v, 2 + 3 * seq + w.n, r || ',title-article-added'
      FROM {name}_t0, (VALUES ('The', 0), ('A', 1), ('An', 2)) w(a, n) WHERE NOT regexp_matches(v, '(?i)^(the|a|an)\\s+')),
{name}_t2 AS (SELECT * FROM {name}_t1
    UNION ALL SELECT post_id, replace(v, '&', ' and '), seq + 10, r || ',ampersand-spelled-out' FROM {name}_t1 WHERE v LIKE '%&%'
    UNION ALL SELECT post_id, regexp_replace(v, '(?i)\\sand\\s', ' & ', 'g'), seq + 20, r || ',ampersand-spelled-out'
      FROM {name}_t1 WHERE regexp_matches(v, '(?i)\\sand\\s')),
{name} AS MATERIALIZED (SELECT post_id, key, rank, rewrites FROM (
    SELECT a.post_id, {key('a.v || t.v')} AS key, len(string_split(a.r || t.r, ',')) - 1 AS rank,
        substring(a.r || t.r, 2) AS rewrites, row_number() OVER (PARTITION BY a.post_id, {key('a.v || t.v')}
        ORDER BY len(string_split(a.r || t.r, ',')), a.seq * 1000 + t.seq) AS n
    FROM {name}_a2 a JOIN {name}_t2 t USING (post_id)) WHERE n = 1)"""


WANTED = wanted_sql("wanted", "cat", "artist", "song")
ASKED = f"""
keys AS MATERIALIZED (SELECT DISTINCT key FROM wanted),
heads AS MATERIALIZED (SELECT d.row_no, max_by(k.key, length(k.key)) AS asked FROM dump d
    JOIN keys k ON starts_with(d.key, k.key) WHERE d.key NOT IN (SELECT key FROM keys) GROUP BY d.row_no),
graded AS (SELECT h.row_no, h.asked, CASE
    WHEN {key('d.credit || ' + bare('d.recording'))} = h.asked THEN 1
    WHEN d.recording LIKE '% / %' AND {key("d.credit || string_split(d.recording, ' / ')[1]")} = h.asked THEN 1
    WHEN length(d.key) - length(h.asked) <= 2 THEN 2 END AS how FROM heads h JOIN dump d USING (row_no)),
asked AS MATERIALIZED (SELECT row_no, key AS asked, 0 AS how FROM dump WHERE key IN (SELECT key FROM keys)
    UNION ALL SELECT row_no, asked, how FROM graded WHERE how IS NOT NULL),
candidates AS MATERIALIZED (SELECT w.post_id, w.rank, w.rewrites, a.how, d.* FROM wanted w
    JOIN asked a ON a.asked = w.key JOIN dump d USING (row_no))"""
BEST_ORDER = "(live OR variant), how, rank, quality, row_no"
BEST1 = f"""
best1 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {BEST_ORDER}) AS n
    FROM candidates) WHERE n = 1)"""
PASS_ONE = f"WITH RECURSIVE {INPUTS}, {WANTED}, {ASKED}, {BEST1}"


def learned_sql(name: str, best: str, more: str) -> str:
    return f"""
{name} AS MATERIALIZED (SELECT DISTINCT k AS artist_key, i AS artist_id FROM (
    SELECT {key('c.artist')} AS k, unnest(string_split(b.ids, ',')) AS i FROM cat c JOIN {best} b USING (post_id)
    UNION ALL SELECT {key('c.lead')}, string_split(b.ids, ',')[1] FROM cat c JOIN {best} b USING (post_id) WHERE c.lead IS NOT NULL
    {more}))"""


IDS1 = learned_sql("ids1", "best1", f"""
    UNION ALL SELECT {key("unnest(string_split(b.credit, ' feat. '))")}, unnest(string_split(b.ids, ',')) FROM best1 b
      WHERE b.credit LIKE '% feat. %'""")
TITLES = f"""
titles AS MATERIALIZED (SELECT DISTINCT post_id, k FROM (SELECT post_id, {key('song')} AS k FROM cat
    UNION ALL SELECT post_id, {key(bare('song'))} FROM cat) WHERE k <> '')"""


def scoped_sql(name: str, posts: str, ids: str) -> str:
    """CTE of scoped candidates for the posts of a relation."""
    return f"""
{name} AS MATERIALIZED (SELECT DISTINCT t.post_id, 0 AS rank, '' AS rewrites, CASE WHEN s.via THEN 4 ELSE 3 END AS how, d.*
    FROM (SELECT c.post_id, i.artist_id, false AS via FROM cat c JOIN {ids} i ON i.artist_key = {key('c.artist')}
        UNION ALL SELECT c.post_id, i.artist_id, true FROM cat c JOIN {ids} i ON i.artist_key = {key('c.lead')}
        WHERE {key('c.artist')} NOT IN (SELECT artist_key FROM {ids})) s
    JOIN ({posts}) p USING (post_id) JOIN titles t USING (post_id)
    JOIN dump d ON d.recording_key = t.k AND ends_with(d.key, t.k)
      AND CASE WHEN s.via THEN string_split(d.ids, ',')[1] = s.artist_id ELSE list_contains(string_split(d.ids, ','), s.artist_id) END)"""


def best_sql(name: str, source: str, order: str = BEST_ORDER) -> str:
    return f"""
{name} AS MATERIALIZED (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {order}) AS n
    FROM ({source})) WHERE n = 1)"""


FIELDS = "post_id, rank, rewrites, how, row_no, ids, credit, recording, release, live, variant, quality"
PASS_TWO = f"""{PASS_ONE}, {IDS1}, {TITLES},
{scoped_sql('scoped2', 'SELECT post_id FROM cat WHERE post_id NOT IN (SELECT post_id FROM best1 WHERE NOT live AND NOT variant)', 'ids1')},
{best_sql('best2', f'SELECT {FIELDS} FROM best1 UNION ALL SELECT {FIELDS} FROM scoped2')}"""

PARTS = f"""
parts AS (SELECT post_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM
    (SELECT post_id, regexp_split_to_array(artist, '\\s*&\\s*') AS parts FROM cat WHERE artist LIKE '%&%')),
required AS MATERIALIZED (SELECT post_id, place, list(DISTINCT artist_id) AS need FROM (
    SELECT p.post_id, p.place, i.artist_id FROM parts p JOIN ids1 i ON i.artist_key = {key('p.part')}
    UNION ALL SELECT p.post_id, p.place, i.artist_id FROM parts p JOIN ids1 i ON i.artist_key = {key("'The ' || p.part")}
      WHERE {key('p.part')} NOT IN (SELECT artist_key FROM ids1)) GROUP BY post_id, place)"""


def collab_sql(name: str, posts: str) -> str:
    return f"""{PARTS},
{name} AS MATERIALIZED (SELECT t.post_id, 0 AS rank, '' AS rewrites, 5 AS how, d.* FROM titles t
    JOIN ({posts}) USING (post_id) JOIN dump d ON d.recording_key = t.k AND ends_with(d.key, t.k)
    WHERE (SELECT count(*) FROM required r WHERE r.post_id = t.post_id) >= 2
      AND NOT EXISTS (SELECT 1 FROM required r WHERE r.post_id = t.post_id
        AND NOT list_has_any(r.need, string_split(d.ids, ','))))"""


def near_sql(a: str, b: str) -> str:
    """nearly_same(a, b) in checking SQL."""
    return f"""(CASE WHEN length({b}) >= 12 THEN levenshtein({a}, {b}) <= 2 WHEN length({b}) >= 7 THEN levenshtein({a}, {b}) <= 1
      ELSE length({a}) = length({b}) AND levenshtein({a}, {b}) = 2 AND damerau_levenshtein({a}, {b}) = 1 END)"""


def title_first_sql(name: str, posts: str) -> str:
    own, lead, credit_lead = "c.own_key", "c.lead_key", "d.credit_lead"
    strict = (f"({own} = d.credit_key OR {near_sql(own, 'd.credit_key')} OR (c.lead_key IS NOT NULL AND "
              f"({lead} = {credit_lead} OR {near_sql(lead, credit_lead)})))")
    close = (f"({own} = d.credit_key OR {near_sql(own, 'd.credit_key')} "
             f"OR (length({own}) >= 5 AND length(d.credit_key) >= 5 AND (starts_with({own}, d.credit_key) OR starts_with(d.credit_key, {own}))) "
             f"OR (c.lead_key IS NOT NULL AND (starts_with(d.credit_key, {lead}) OR {near_sql('d.credit_key', lead)} "
             f"OR {lead} = {credit_lead} OR {near_sql(lead, credit_lead)})))")
    return f"""
{name} AS MATERIALIZED (SELECT c.post_id, 0 AS rank, '' AS rewrites, 6 AS how, d.* EXCLUDE (credit_lead)
    FROM (SELECT post_id, {key('artist')} AS own_key, {key('lead')} AS lead_key FROM cat JOIN ({posts}) USING (post_id)) c
    JOIN titles t USING (post_id)
    JOIN (SELECT *, {key("string_split(credit, ' feat. ')[1]")} AS credit_lead FROM dump) d
      ON (d.recording_key = t.k OR d.bare_key = t.k) AND ends_with(d.key, t.k)
    WHERE length(t.k) >= 4 AND {close} AND (length(t.k) >= 8 OR {strict}))"""


def near_pass_sql(name: str, posts: str, best: str) -> str:
    return f"""
spelled AS MATERIALIZED (SELECT DISTINCT {key('c.artist')} AS artist_key, b.credit_key, unnest(string_split(b.ids, ',')) AS artist_id
      FROM cat c JOIN (SELECT b.*, {key('b.credit')} AS credit_key FROM {best} b) b USING (post_id)
    UNION SELECT {key('c.lead')}, {key('b.credit')}, string_split(b.ids, ',')[1] FROM cat c JOIN {best} b USING (post_id) WHERE c.lead IS NOT NULL),
asks AS MATERIALIZED (SELECT DISTINCT post_id, title_key, unnest([own, lead_key]) AS k FROM (
    SELECT post_id, {key(bare('song'))} AS title_key, {key('artist')} AS own, {key('lead')} AS lead_key FROM cat JOIN ({posts}) USING (post_id))
    WHERE length(title_key) >= 4),
reach AS MATERIALIZED (SELECT DISTINCT a.post_id, a.title_key, s.artist_key FROM asks a
    JOIN (SELECT DISTINCT artist_key FROM spelled) s ON s.artist_key = a.k OR (
      a.k NOT IN (SELECT artist_key FROM spelled) AND length(a.k) >= 7
      AND levenshtein(s.artist_key, a.k) <= CASE WHEN length(a.k) >= 12 THEN 2 ELSE 1 END)),
{name} AS MATERIALIZED (SELECT DISTINCT r.post_id, 0 AS rank, '' AS rewrites, 7 AS how, d.* FROM reach r
    JOIN (SELECT DISTINCT artist_key, credit_key FROM spelled) h USING (artist_key)
    JOIN dump d ON starts_with(d.key, h.credit_key) AND length(d.key) > length(h.credit_key)
    WHERE {near_sql('substring(d.key, length(h.credit_key) + 1)', 'r.title_key')}
      AND EXISTS (SELECT 1 FROM spelled m WHERE m.artist_key = r.artist_key AND list_contains(string_split(d.ids, ','), m.artist_id)))"""


def left_open(best: str) -> str:
    return f"SELECT post_id FROM cat WHERE post_id NOT IN (SELECT post_id FROM {best})"


def both(a: str, b: str) -> str:
    return f"SELECT {FIELDS} FROM {a} UNION ALL SELECT {FIELDS} FROM {b}"


ALL_PASSES = f"""{PASS_TWO},
{collab_sql('collab', left_open('best2'))},
{best_sql('collab1', 'SELECT * FROM collab', 'row_no')}, best3 AS MATERIALIZED ({both('best2', 'collab1')}),
{title_first_sql('first', left_open('best3'))},
{best_sql('first1', 'SELECT * FROM first', 'row_no')}, best4 AS MATERIALIZED ({both('best3', 'first1')}),
{learned_sql('ids2', 'best4', f'''
    UNION ALL SELECT {key('b.credit')}, unnest(string_split(b.ids, ',')) FROM best4 b WHERE b.how = 6''')},
{scoped_sql('scoped5', left_open('best4'), 'ids2')},
{best_sql('scoped1', 'SELECT * FROM scoped5', 'row_no')}, best5 AS MATERIALIZED ({both('best4', 'scoped1')}),
{near_pass_sql('near', left_open('best5'), 'best5')},
{best_sql('near1', 'SELECT * FROM near')}, best6 AS MATERIALIZED ({both('best5', 'near1')})"""

FOLD = f"""{PASS_ONE},
steps AS MATERIALIZED (SELECT post_id, rank, how, live, variant, quality, row_no,
    row_number() OVER (PARTITION BY post_id ORDER BY row_no) AS n FROM candidates),
fold AS (
    SELECT post_id, n, rank, how, live, variant, quality, row_no FROM steps WHERE n = 1
    UNION ALL
    SELECT e.post_id, n.n, CASE WHEN ok THEN n.rank ELSE e.rank END, CASE WHEN ok THEN n.how ELSE e.how END,
        CASE WHEN ok THEN n.live ELSE e.live END, CASE WHEN ok THEN n.variant ELSE e.variant END,
        CASE WHEN ok THEN n.quality ELSE e.quality END, CASE WHEN ok THEN n.row_no ELSE e.row_no END
    FROM fold e JOIN steps n ON n.post_id = e.post_id AND n.n = e.n + 1,
    LATERAL (SELECT NOT (NOT (e.live OR e.variant) AND (n.live OR n.variant)) AND (
        (e.live AND NOT (n.live OR n.variant))
        OR (e.variant AND NOT n.variant AND n.rank <= e.rank + 1)
        OR (NOT (n.live OR n.variant) AND n.quality < e.quality AND n.rank <= e.rank)
        OR (n.how < e.how AND NOT (n.live OR n.variant))
        OR n.rank < e.rank OR (n.rank = e.rank AND (n.how < e.how OR (n.how = e.how AND n.quality < e.quality)))) AS ok) x)
SELECT post_id, row_no, rank, {HOW_NAMES}[how + 1] AS how FROM fold
QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY n DESC) = 1"""

# The whole match with the ordered fold and proposals: every step sees the row held and the next one.
_PUT = f"""put AS MATERIALIZED (SELECT * FROM ({standins.sql(standins.PROPOSALS)}) WHERE why IS NOT NULL)"""
_ENTRIES = """entries AS MATERIALIZED (SELECT post_id, key, rank, rewrites, false AS proposed FROM wanted
    UNION ALL SELECT post_id, key, 99, rewrites, true FROM putkeys)"""
_ASKED_BY_ENTRY = ASKED.replace("FROM wanted", "FROM entries").replace("w.rewrites", "w.rewrites, w.proposed")
FOLD_FIELDS = f"{FIELDS}, proposed"


def fold_sql(name: str, source: str) -> str:
    """CTEs for the ordered fold of rows (FOLD_FIELDS and pass) into one per post."""
    state = ["rank", "how", "live", "variant", "quality", "row_no", "pass", "proposed", "on_venue"]
    venue, put, credit = key("c.artist"), key("p.artist"), key("s.credit")
    return f"""
{name}_steps AS MATERIALIZED (SELECT s.*, row_number() OVER (PARTITION BY s.post_id ORDER BY pass, row_no, proposed) AS n,
    {venue} <> '' AND contains({credit}, substring({venue}, 1, 12)) AS on_venue,
    coalesce(contains({credit}, substring({put}, 1, 12)), false) AS on_put, coalesce(contains(substring({put}, 1, 12), {credit}), false) AS in_put,
    proposed AND {venue} <> '' AND {put} <> '' AND {venue} <> {put} AS attributed
    FROM ({source}) s JOIN cat c USING (post_id) LEFT JOIN put p USING (post_id)),
{name}_fold AS (SELECT post_id, n, {', '.join(state)} FROM {name}_steps WHERE n = 1
    UNION ALL
    SELECT e.post_id, n.n, {', '.join(f'CASE WHEN ok THEN n.{c} ELSE e.{c} END' for c in state)}
    FROM {name}_fold e JOIN {name}_steps n ON n.post_id = e.post_id AND n.n = e.n + 1,
    LATERAL (SELECT NOT (e.live OR e.variant) AS e_clean, NOT (n.live OR n.variant) AS n_clean) k,
    LATERAL (SELECT NOT (e.proposed AND NOT n.proposed AND n.on_venue AND NOT n.on_put) AND NOT (e_clean AND NOT n_clean) AND (
        (e.live AND n_clean) OR (e.variant AND NOT n.variant AND (n.rank <= e.rank + 1 OR n.proposed))
        OR (n_clean AND n.quality < e.quality AND n.rank <= e.rank) OR (n.how < e.how AND (n_clean OR n.proposed))
        OR (n.attributed AND e.on_venue AND (n.on_put OR n.in_put))
        OR n.rank < e.rank OR (n.rank = e.rank AND (n.how < e.how OR (n.how = e.how AND n.quality < e.quality)))) AS ok) x),
{name} AS MATERIALIZED (SELECT {FOLD_FIELDS} FROM {name}_steps SEMI JOIN
    (SELECT post_id, pass, row_no, proposed FROM {name}_fold QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY n DESC) = 1)
    USING (post_id, pass, row_no, proposed))"""


def later(source: str, number: int) -> str:
    """Candidates of a later pass, none of them from a proposal."""
    return f"SELECT {FIELDS}, false AS proposed, {number} AS pass FROM {source}"


def first_hits(name: str, source: str) -> str:
    return best_sql(name, f"SELECT {FIELDS}, false AS proposed FROM {source}", "row_no")


def with_both(a: str, b: str) -> str:
    return f"SELECT {FOLD_FIELDS} FROM {a} UNION ALL SELECT {FOLD_FIELDS} FROM {b}"


ALL_PASSES_FOLD = f"""WITH RECURSIVE {INPUTS}, {WANTED}, {_PUT}, {wanted_sql('putkeys', 'put', 'artist', 'title')}, {_ENTRIES}, {_ASKED_BY_ENTRY},
{fold_sql('best1', f'SELECT {FOLD_FIELDS}, 1 AS pass FROM candidates')}, {IDS1}, {TITLES},
{scoped_sql('scoped2', 'SELECT post_id FROM cat WHERE post_id NOT IN (SELECT post_id FROM best1 WHERE NOT live AND NOT variant)', 'ids1')},
{fold_sql('upgraded', f"""SELECT {FOLD_FIELDS}, 1 AS pass FROM best1 WHERE post_id IN (SELECT post_id FROM scoped2)
    UNION ALL {later('scoped2', 2)}""")},
best2 AS MATERIALIZED (SELECT * FROM upgraded UNION ALL SELECT {FOLD_FIELDS} FROM best1 WHERE post_id NOT IN (SELECT post_id FROM upgraded)),
{collab_sql('collab', left_open('best2'))}, {first_hits('collab1', 'collab')}, best3 AS MATERIALIZED ({with_both('best2', 'collab1')}),
{title_first_sql('first', left_open('best3'))}, {first_hits('first1', 'first')}, best4 AS MATERIALIZED ({with_both('best3', 'first1')}),
{learned_sql('ids2', 'best4', f"""
    UNION ALL SELECT {key('b.credit')}, unnest(string_split(b.ids, ',')) FROM best4 b WHERE b.how = 6""")},
{scoped_sql('scoped5', left_open('best4'), 'ids2')}, {first_hits('scoped1', 'scoped5')}, best5 AS MATERIALIZED ({with_both('best4', 'scoped1')}),
{near_pass_sql('near', left_open('best5'), 'best5')}, {fold_sql('near1', later('near', 6))},
best6 AS MATERIALIZED ({with_both('best5', 'near1')})"""
# What is published of the matches.
MATCHED = f"""{ALL_PASSES_FOLD}
    SELECT c.post_id, b.row_no IS NOT NULL AS matched, b.row_no, {HOW_NAMES}[b.how + 1] AS how, b.credit,
        CASE WHEN b.row_no IS NULL THEN NULL WHEN p.title IS NOT NULL THEN p.title
            WHEN b.how = 1 AND b.recording LIKE '% / %' THEN string_split(b.recording, ' / ')[1]
            ELSE replace(b.recording, ' (remix)', '') END AS title,
        CASE WHEN b.row_no IS NOT NULL THEN p."from" END AS "from", CASE WHEN b.row_no IS NOT NULL THEN p.language END AS language,
        CASE WHEN b.proposed THEN p.why END AS proposed, CASE WHEN b.row_no IS NOT NULL THEN b.how < 8 OR p.why IS NOT NULL END AS trusted
    FROM cat c LEFT JOIN best6 b USING (post_id) LEFT JOIN put p USING (post_id)"""

WINNER = f"post_id, row_no, rank, {HOW_NAMES}[how + 1] AS how, rewrites, credit, recording"


class Inputs:
    """The linkage inputs over one folder; the prepared dump and the keys are materialised on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.songs = cut_lineage(dealt_out(standins.catalog(spark, sf_dir)))
        self.raw = standins.dump(spark, sf_dir)
        self.allow = allowed_language(self.songs)

    @cached_property
    def dump(self) -> DataFrame:
        return cut_lineage(link.prepare_dump(self.raw))

    @cached_property
    def wanted(self) -> DataFrame:
        return cut_lineage(wanted_keys(self.songs))

    def best(self) -> DataFrame:
        return cut_lineage(link.link_keys(self.wanted, self.allow, self.dump, "total_order"))

    def winners(self, found: DataFrame, mode: str) -> DataFrame:
        return _winners(link.with_rows(best_match(found, mode=mode), self.dump, self.allow))


def _winners(best: DataFrame) -> DataFrame:
    return best.select(
        "post_id", "row_no", "rank", how_name(F.col("how")).alias("how"),
        F.array_join("rewrites", ",").alias("rewrites"), "credit", "recording",
    )


def key_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wanted_keys(standins.catalog(spark, sf_dir)).select(
        "post_id", "key", "rank", F.array_join("rewrites", ",").alias("rewrites")
    )


def link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: dirty catalogue to dump by expanded keys, best row per song."""
    songs, dump = standins.catalog(spark, sf_dir), cut_lineage(link.prepare_dump(standins.dump(spark, sf_dir)))
    best = best_match(link.link_exact(cut_lineage(wanted_keys(songs)), dump), mode="total_order")
    return _winners(link.with_rows(best, dump, allowed_language(songs)))


def link_prefix_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs, dump = standins.catalog(spark, sf_dir), cut_lineage(link.prepare_dump(standins.dump(spark, sf_dir)))
    best = best_match(link.link_prefix(cut_lineage(wanted_keys(songs)), dump), mode="total_order")
    return _winners(link.with_rows(best, dump, allowed_language(songs)))


def link_best_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winners(Inputs(spark, sf_dir).best())


def link_best_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return link.link_keys(i.wanted, i.allow, i.dump, "fold").select(
        "post_id", "row_no", "rank", how_name(F.col("how")).alias("how")
    )


def learned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return link.learn_ids(i.songs, i.best())


def link_artist_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped candidates for songs without a clean row, best per song."""
    i = Inputs(spark, sf_dir)
    best = i.best()
    ids = cut_lineage(link.learn_ids(i.songs, best))
    found = link.link_scoped(link.unmatched_or_poor(i.songs, best), i.allow, i.dump, ids)
    return i.winners(found, "total_order")


def link_collab_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free collaborations over all songs, earliest row per song."""
    i = Inputs(spark, sf_dir)
    return i.winners(link.link_collab(i.songs, i.dump, cut_lineage(link.learn_ids(i.songs, i.best()))), "first")


def link_title_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact title with a close enough credit over all songs, earliest row per song."""
    i = Inputs(spark, sf_dir)
    return i.winners(link.link_title_first(i.songs, i.dump, classes=True), "first")


def link_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelled titles by known artists for songs the first pass left open."""
    i = Inputs(spark, sf_dir)
    best = i.best()
    credits = cut_lineage(link.learn_credits(i.songs, best))
    return i.winners(link.link_near(link.unmatched(i.songs, best), i.allow, i.dump, credits), "total_order")


def match_all_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole offline match in total-order mode."""
    matches = matching.match_catalog(standins.catalog(spark, sf_dir), standins.dump(spark, sf_dir), mode="total_order")
    return matches.filter("matched").select("post_id", "row_no", "how", "credit", "recording")


WORK = f"CASE WHEN p_partkey % 3 = 0 AND p_size NOT IN (5, 6) THEN upper(replace({standins.DUMP[1]['recording']}, ' (remix)', '')) WHEN p_partkey % 3 = 1 THEN 'Entirely different words' END"


def match_with_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published titles of the whole match, with the works that the recordings are of."""
    works = standins.table(spark, sf_dir, "part").selectExpr(f"{standins.DUMP[1]['recording_id']} AS recording_id", f"{WORK} AS title")
    matches = matching.match_catalog(standins.catalog(spark, sf_dir), standins.dump(spark, sf_dir), works=works, mode="total_order")
    return matches.filter("matched").select("post_id", "row_no", "how", "recording", "title")


def match_all_passes_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole offline match with the ordered fold and proposals."""
    matches = matching.match_catalog(
        standins.catalog(spark, sf_dir), standins.dump(spark, sf_dir), standins.proposals(spark, sf_dir)
    )
    return matches.select(
        "post_id", "matched", "row_no", "how", "credit", "title", "from", "language", "proposed", "trusted"
    )


QUERIES = {
    "key_expansion": (key_expansion, f"WITH {INPUTS}, {WANTED} SELECT * FROM wanted"),
    "link_exact": (link_exact, f"""WITH {INPUTS}, {WANTED},
        candidates AS (SELECT w.post_id, w.rank, w.rewrites, 0 AS how, d.* FROM wanted w JOIN dump d USING (key)), {BEST1}
        SELECT {WINNER} FROM best1"""),
    "link_prefix_graded": (link_prefix_graded, f"""WITH {INPUTS}, {WANTED}, {ASKED},
        {best_sql('graded1', 'SELECT * FROM candidates WHERE how > 0')} SELECT {WINNER} FROM graded1"""),
    "link_best_total_order": (link_best_total_order, f"{PASS_ONE} SELECT {WINNER} FROM best1"),
    "link_best_fold": (link_best_fold, FOLD),
    "learned_ids": (learned_ids, f"{PASS_ONE}, {IDS1} SELECT artist_key, artist_id FROM ids1"),
    "link_artist_scoped": (link_artist_scoped, f"{PASS_TWO}, {best_sql('s1', 'SELECT * FROM scoped2')} SELECT {WINNER} FROM s1"),
    "link_collab_scoped": (link_collab_scoped, f"""{PASS_TWO}, {collab_sql('collab', 'SELECT post_id FROM cat')},
        {best_sql('c1', 'SELECT * FROM collab', 'row_no')} SELECT {WINNER} FROM c1"""),
    "link_title_first": (link_title_first, f"""WITH {INPUTS}, {TITLES}, {title_first_sql('first', 'SELECT post_id FROM cat')},
        {best_sql('f1', 'SELECT * FROM first', 'row_no')} SELECT {WINNER} FROM f1"""),
    "link_near": (link_near, f"""{PASS_ONE}, {near_pass_sql('near', left_open('best1'), 'best1')},
        {best_sql('n1', 'SELECT * FROM near')} SELECT {WINNER} FROM n1"""),
    "match_all_passes": (match_all_passes, f"""{ALL_PASSES}
        SELECT post_id, row_no, {HOW_NAMES}[how + 1] AS how, credit, recording FROM best6"""),
    "match_with_works": (match_with_works, f"""{ALL_PASSES}
        SELECT post_id, row_no, {HOW_NAMES}[how + 1] AS how, recording, CASE WHEN lower(work) = lower(replace(recording, ' (remix)', '')) THEN work
            WHEN how = 1 AND recording LIKE '% / %' THEN string_split(recording, ' / ')[1] ELSE replace(recording, ' (remix)', '') END AS title
        FROM best6 JOIN (SELECT p_partkey AS row_no, {WORK} AS work FROM part) USING (row_no)"""),
    "match_all_passes_fold": (match_all_passes_fold, MATCHED),
}
