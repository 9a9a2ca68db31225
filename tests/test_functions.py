import unicodedata

from pyspark.sql import functions as F

from refrain.functions import labels, names, text, titles
from tests.test_similarity import check


def test_keys(spark):
    check(spark, text.combined_lookup, [
        (("Lou Bega", "Mambo No. 5"), "loubegamambono5"), (("Zoë ", "ß Æ_ﬁ"), "zoessae_fi"), (("ŒÅ", "½ Ђ"), "oea1⁄2ђ"),
    ])
    check(spark, text.title_key, [(("Smörgås ø ﬁ",), "smorgasfi"), (("Ой",), "")])
    check(spark, text.title_key_loose, [(("Call You Anymore",), "callu")])
    check(spark, text.name_key, [(("JAŸ-Z",), "jayz")])
    check(spark, text.ascii_key, [(("L.A. Wömän",), "lawmn")])


def test_slugs(spark):
    check(spark, text.slugify, [
        (("A$AP & Björn’s",), "asap-and-bjorns"), (("!!!",), "artist"), (("P!nk",), "p-nk"), (("Øyvind Æ",), "oyvind-ae"),
    ])


def test_brackets(spark):
    check(spark, titles.strip_annotation, [(("Stay (remix) ",), "Stay"), (("A (b) c",), "A (b) c"), (("(x)",), "")])
    check(spark, titles.trailing_bracket, [(("A (b) [c]",), "c"), (("A ()",), ""), (("A",), None)])
    check(spark, lambda c: titles.is_variant_recording(c, F.lit(False)), [
        (("Waterloo (German version)",), True), (("In da Club",), False), (("Hold (The Eliel mix)",), True),
        (("I Do Not Hook Up (Bimbo Jones)",), True), (("Sweet Dreams (Are Made of This)",), False), (("X (2010)",), True),
        (("A vs B",), True), (("X (feat. Y)",), True), (("If I Was / Walk On By",), False),
    ])
    check(spark, lambda c: titles.is_variant_recording(c, F.lit(True)), [(("Du hast (English version)",), False)])
    check(spark, titles.asks_for_language_version, [(("Du hast (english)",), True), (("Waterloo",), False)])
    check(spark, titles.is_live_release, [
        (("1999-01-01: Berlin",), True), (("Live in Atlanta",), True), (("Radio City Hall",), True), (("Olive",), False),
        (("Éliveé",), True),
    ])


def test_published_title(spark):
    def title(recording, work, how):
        return titles.published_title(recording, work, how)["title"]

    check(spark, title, [
        (("Lady Marmalade (Thunderpuss Thunderdub)", "x", "version"), "Lady Marmalade"),
        (("If I Was Your Woman / Walk On By", "x", "version"), "If I Was Your Woman"),
        (("Mambo no5", "Mambo No. 5", "exact"), "Mambo No. 5"),
        (("How Come U Don't Call Me Anymore", "How Come You Don't Call Me", "exact"), "How Come U Don't Call Me Anymore"),
        (("Hold You Down", "Hold You Down (The Eliel mix)", "version"), "Hold You Down"),
        (("För fet för ett fuck", "För fet...", "exact"), "För fet för ett fuck"),
        (("Song / Excerpt From 'Other'", "x", "exact"), "Song"),
    ])
    check(spark, titles.source_annotation, [
        (('Stay (from "Frozen" soundtrack)',), "Frozen"), (("Stay (live)",), None),
    ])


def test_artists(spark):
    check(spark, names.lead_artist, [
        (("2 Pac feat. KC & Jo Jo",), "2 Pac"), (("Abba",), None), (("Peabo Bryson & Regina Bell",), "Peabo Bryson"), (("& x",), None),
    ])
    check(spark, lambda a: F.array_join(names.artist_fragments(a, greedy=True), "|"), [
        (("Adam & The Ants",), "Adam|The Ants"), (("Abba",), ""), (("A & Bo",), ""),
    ])
    check(spark, names.artist_annotation_source, [
        (("Enya (fellowship Of The Ring Soundtrack)",), "The Fellowship of the Ring"), (("Chess (Linda Eder)",), None),
    ])
    check(spark, lambda n, a: names.display_name(n, F.split(a, "\\|"), F.lit(None).cast("string")), [
        (("JAŸ-Z", "Jay Z|Jay-Z|Jay - Z"), "Jay-Z"), (("A★Teens", "A Teens"), "A★Teens"), (("a‐ha", "A Ha"), "a-ha"),
        (("911", "911 (US)"), "911"), (("宇多田", "Hikaru|Utada"), "Hikaru"),
    ])
    check(spark, names.letter_bucket, [(("abba",), "A"), (("Åsa",), "#"), (("2 Pac",), "#")])
    check(spark, names.is_placeholder, [(("[Disney]",), True), (("Disney",), False)])


def test_labels(spark):
    check(spark, labels.genre_label, [(("r&b",), "R&B"), (("hip hop",), "Hip hop"), (("synth-pop",), "Synth-Pop"), (("new wave",), "New Wave")])
    check(spark, lambda y: labels.decade_label(labels.decade_key(y.cast("int"))), [(("1987",), "80s"), (("2004",), "00s")])
    check(spark, lambda f: F.array_join(labels.categories_from_show(f), "|"), [
        (("Mary Poppins",), "Disney|Musical"), (("Eurovision",), "Eurovision"), (("Goldfinger",), "James Bond"), (("Jaws",), ""),
    ])


def test_title_variants(spark):
    check(spark, lambda t: F.array_join(titles.title_variants(t), "|"), [(
        ("Call U Anymore",), "Call U Anymore|Call You Anymore|Call U|Call You"
    )])


def test_every_code_point_is_decomposed(spark):
    letters = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000)) if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rows = [("".join(letters[i : i + 40]),) for i in range(0, len(letters), 40)]
    found = spark.createDataFrame(rows, "t string").select("t", text.unmarked(F.col("t")).alias("got")).collect()
    assert len(letters) > 149_000
    for r in found:
        assert r["got"] == "".join(p for p in unicodedata.normalize("NFKD", r["t"]) if unicodedata.category(p)[0] != "M")


def test_decomposed_keys_of_a_file_meet_own_keys(spark):
    rows = [("서울의 달",), ("𝐁𝐨𝐥𝐝 ① ㎏",), ("ﷺ ﬁn",), ("Ǆ Ⅷ",), ("plain",)]
    found = spark.createDataFrame(rows, "t string").select("t", text.combined_lookup(F.col("t")).alias("key")).collect()
    for r in found:
        low = "".join(c for c in r["t"] if c == "_" or unicodedata.category(c)[0] in "LN").lower()
        assert r["key"] == "".join(p for p in unicodedata.normalize("NFKD", low) if unicodedata.category(p)[0] != "M")
