"""Registered queries over keys, titles and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.names import artist_fragments, lead_artist
from refrain.functions.similarity import names_agree, nearly_same, titles_corroborate
from refrain.functions.text import ascii_key, combined_lookup, name_key, slugify, title_key, title_key_loose
from refrain.functions.titles import (
    is_live_release, is_variant_recording, match_quality, medley_head, published_title, strip_annotation,
    title_from_recording,
)
from refrain.operators.link import prepare_dump
from refrain.plans import standins
from refrain.plans.query_link import INPUTS, bare, key

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def fold(text: str) -> str:
    """Marks dropped from Latin-1 letters in checking SQL."""
    return f"translate({text}, '{ACCENTED}', '{PLAIN}')"


def match_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and part names that fold to one key, whole texts compared."""
    texts = standins.table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), combined_lookup(F.col("text")).alias("key")
    )
    parts = standins.table(spark, sf_dir, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
        combined_lookup(F.col("p_brand"), F.col("p_name")).alias("key"),
    )
    hashed = texts.unionByName(parts).select("kind", "id", F.md5("key").alias("key_hash"), F.length("key").alias("key_length"))
    return hashed.groupBy("kind", "key_hash", "key_length").agg(
        F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id")
    ).filter("members > 1")


def title_key_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return standins.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(title_key(text)).alias("title_hash"), F.md5(title_key_loose(text)).alias("loose_hash"),
        F.md5(name_key(text)).alias("name_hash"), F.md5(ascii_key(text)).alias("ascii_hash"),
        F.md5(slugify(text)).alias("slug_hash"), F.length(title_key(text)).alias("title_length"),
    )


def recording_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live, variant and quality grades, bare titles and medley heads of every dump row."""
    dump = standins.dump(spark, sf_dir)
    recording, release, no = F.col("recording"), F.col("release"), F.lit(False)
    return dump.select(
        "row_no", is_live_release(release).cast("int").alias("live"),
        is_variant_recording(recording, no).cast("int").alias("variant"),
        match_quality(F.col("score"), release, recording, no).alias("quality"),
        strip_annotation(recording).alias("bare"), medley_head(recording).alias("head"),
        lead_artist(F.col("credit")).alias("lead"), F.array_join(artist_fragments(F.col("credit")), "|").alias("parts"),
        title_from_recording(recording)["title"].alias("own_title"),
    )


def published_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title to publish per part: its dump recording beside its name as the linked work."""
    rows = standins.dump(spark, sf_dir).join(
        standins.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.col("p_name").alias("work")), "row_no"
    )
    how = F.when(F.col("row_no") % 2 == 0, "version").otherwise("exact")
    return rows.select("row_no", published_title(F.col("recording"), F.col("work"), how).alias("p")).select(
        "row_no", "p.title", F.col("p.source").alias("source")
    )


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each catalogue title against its dump recording: near, corroborating, agreeing names."""
    rows = standins.catalog(spark, sf_dir).select("post_id", "artist", "song").join(
        prepare_dump(standins.dump(spark, sf_dir)).select(F.col("row_no").alias("post_id"), "credit", "recording", "recording_key"),
        "post_id",
    )
    return rows.select(
        "post_id", nearly_same(F.col("recording_key"), combined_lookup(F.col("song"))).cast("int").alias("near"),
        titles_corroborate(F.col("song"), F.col("recording")).cast("int").alias("corroborates"),
        names_agree(F.col("artist"), F.col("credit")).cast("int").alias("agree"),
    )


def _contained(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


def corroborate_sql(a: str, b: str) -> str:
    """titles_corroborate on title keys in checking SQL."""
    x, y = (f"regexp_replace(replace({k}, 'you', 'u'), 'anymore$', '')" for k in (a, b))
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN false WHEN {a} = {b} THEN true
        WHEN {_contained(a, b)} THEN least(length({a}), length({b})) >= least(8, greatest(4, floor(greatest(length({a}), length({b})) * 0.45)))
        WHEN {x} = {y} THEN true WHEN {_contained(x, y)} THEN least(length({x}), length({y})) >= 8
        ELSE levenshtein({x}, {y}) <= greatest(2, floor(least(length({x}), length({y})) * 0.25)) END"""


def _alnum(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^a-z0-9]+', '', 'g')"


_KEY = f"""regexp_replace({fold("replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g')), 'ß', 'ss')")}, '\\p{{M}}+', '', 'g')"""
_TITLE = f"regexp_replace(lower({fold('text')}), '[^a-z0-9]+', '', 'g')"
_SLUG = (
    f"regexp_replace(regexp_replace(replace(replace(replace(lower(regexp_replace({fold('text')}, '[‘’'']', '', 'g')), '$', 's'), "
    "'æ', 'ae'), '&', ' and '), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g')"
)
_NEAR = """(CASE WHEN length({b}) >= 12 THEN levenshtein({a}, {b}) <= 2 WHEN length({b}) >= 7 THEN levenshtein({a}, {b}) <= 1
    ELSE length({a}) = length({b}) AND levenshtein({a}, {b}) = 2 AND damerau_levenshtein({a}, {b}) = 1 END)"""

QUERIES = {
    "match_key_collisions": (match_key_collisions, f"""
        SELECT kind, key_hash, key_length, count(*) AS members, min(id) AS first_id FROM (
          SELECT kind, id, md5(key) AS key_hash, length(key) AS key_length FROM (
            SELECT 'document' AS kind, doc_id AS id, {_KEY} AS key FROM documents
            UNION ALL SELECT 'part', p_partkey, {key('p_brand || p_name')} FROM part))
        GROUP BY ALL HAVING count(*) > 1"""),
    "title_key_variants": (title_key_variants, f"""
        SELECT doc_id, md5(t) AS title_hash, md5(regexp_replace(replace(t, 'you', 'u'), 'anymore$', '')) AS loose_hash,
            md5(t) AS name_hash, md5({_alnum('text')}) AS ascii_hash,
            md5(CASE WHEN slug = '' THEN 'artist' ELSE slug END) AS slug_hash, length(t) AS title_length
        FROM (SELECT doc_id, text, {_TITLE} AS t, {_SLUG} AS slug FROM documents)"""),
    "recording_grades": (recording_grades, f"""WITH {INPUTS}
        SELECT row_no, CAST(live AS INT) AS live, CAST(variant AS INT) AS variant, quality, {bare('recording')} AS bare,
            CASE WHEN recording LIKE '% / %' THEN string_split(recording, ' / ')[1] END AS head,
            CASE WHEN credit LIKE '% feat. %' THEN string_split(credit, ' feat. ')[1] END AS lead,
            replace(credit, ' feat. ', '|') AS parts,
            CASE WHEN recording LIKE '%(remix)' THEN {bare('recording')} ELSE recording END AS own_title FROM dump"""),
    "published_titles": (published_titles, f"""WITH {INPUTS},
        own AS (SELECT d.row_no, p.p_name AS work, d.recording, CASE
            WHEN d.row_no % 2 = 0 AND d.recording LIKE '% / %' THEN string_split(d.recording, ' / ')[1]
            WHEN d.recording LIKE '%(remix)' THEN {bare('d.recording')} ELSE d.recording END AS title
          FROM dump d JOIN part p ON p.p_partkey = d.row_no),
        keyed AS (SELECT *, {_alnum(bare('recording'))} AS a, {_alnum('work')} AS b, {_alnum('title')} AS t FROM own),
        chosen AS (SELECT *, (CASE WHEN a = b THEN true
            WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) >= least(8, greatest(4, floor(greatest(length(a), length(b)) * 0.45)))
            ELSE levenshtein(a, b) <= greatest(2, floor(least(length(a), length(b)) * 0.25)) END)
            AND (t = b OR (row_no % 2 = 1 AND NOT ({corroborate_sql('t', 'b')}))) AS takes FROM keyed)
        SELECT row_no, CASE WHEN takes THEN work ELSE title END AS title,
            CASE WHEN takes THEN 'work' ELSE 'recording' END AS source FROM chosen"""),
    "title_similarity": (title_similarity, f"""WITH {INPUTS},
        pairs AS (SELECT c.post_id, d.recording_key AS dk, {key('c.song')} AS ck, {_alnum('c.song')} AS a,
            {_alnum('d.recording')} AS b, {_alnum('c.artist')} AS x, {_alnum('d.credit')} AS y
          FROM cat c JOIN dump d ON d.row_no = c.post_id)
        SELECT post_id, CAST({_NEAR.format(a='dk', b='ck')} AS INT) AS near, CAST({corroborate_sql('a', 'b')} AS INT) AS corroborates,
            CAST({_contained('x', 'y')} AS INT) AS agree FROM pairs"""),
}
