"""Catalogue rows out of listing pages, as one job over a (page, html) table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.text import bind, js_trim

ENTITY = r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);"


@dataclass(frozen=True)
class ListingSpec:
    """How a site marks its listing: container tag, provider name, row tag and field patterns.

    Every pattern is a Java regular expression; field patterns have one group.
    """

    container: str
    provider: str
    row: str
    post_id: str
    fields: dict[str, str]


def _decode_one(entity: Column) -> Column:
    """The text of one ``&...;`` entity, itself when unknown."""
    body = F.substring(entity, F.lit(2), F.length(entity) - 2)
    names = F.create_map(*[F.lit(x) for item in fixed.NAMED_ENTITIES.items() for x in item])
    code = (
        F.when(body.rlike(r"\A#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("int"))
        .when(body.rlike(r"\A#"), F.substring(body, F.lit(2), F.length(body)).try_cast("int"))
    )
    return F.coalesce(F.try_element_at(names, body), _code_point(code), entity)


def _code_point(code: Column) -> Column:
    """A character from its number; Spark's ``char`` stops at 255, UTF-32 covers the rest."""
    return F.when(code.between(0, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """All known entities decoded in one pass, so that decoded text is never decoded again."""
    cut = F.split(text, ENTITY, -1)
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    decoded = bind(F.struct(cut.alias("cut"), found.alias("found")), lambda k: F.concat(
        F.get(k["cut"], F.lit(0)),
        F.array_join(F.transform(k["found"], lambda e, i: F.concat(_decode_one(e), F.get(k["cut"], i + 1))), ""),
    ))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def find_listing(pages: DataFrame, spec: ListingSpec) -> DataFrame:
    """(page, listing, total_pages, per_page): the container whose data-nav names the provider."""
    parts = pages.select("page", F.explode(F.split("html", f"(?={spec.container})", -1)).alias("listing")).filter(
        F.col("listing").rlike(rf"\A{spec.container}")
    ).withColumn("tag", F.regexp_extract("listing", rf"\A({spec.container})", 1))
    nav = F.from_json(
        decode_entities(F.regexp_extract("tag", 'data-nav="([^"]*)"', 1)),
        "query struct<jet_smart_filters:string,posts_per_page:string>",
    )
    return parts.withColumn("nav", nav).filter(F.col("nav.query.jet_smart_filters") == spec.provider).select(
        "page", "listing", F.regexp_extract("tag", r'data-pages="(\d+)"', 1).try_cast("int").alias("total_pages"),
        F.col("nav.query.posts_per_page").try_cast("int").alias("per_page"),
    )


def extract_rows(listings: DataFrame, spec: ListingSpec) -> DataFrame:
    """(page, place, post_id, fields...): rows of each listing, fields read from the front of a row."""
    rows = listings.select("page", F.posexplode(F.filter(
        F.split("listing", f"(?={spec.row})", -1), lambda chunk: chunk.rlike(rf"\A{spec.row}")
    )).alias("place", "chunk"))
    return rows.select(
        "page", "place", F.nullif(F.regexp_extract("chunk", spec.post_id, 1), F.lit("")).try_cast("long").alias("post_id"),
        *[F.when(F.col("chunk").rlike(p), js_trim(decode_entities(F.regexp_extract("chunk", p, 1)))).alias(n)
          for n, p in spec.fields.items()],
    )


def extract_listing(pages: DataFrame, spec: ListingSpec) -> DataFrame:
    return extract_rows(find_listing(pages, spec), spec)


def listing_violations(rows: DataFrame, listings: DataFrame, required: list[str]) -> DataFrame:
    """(rule, violations): every integrity rule of a scrape; any count above zero is a failed scrape."""
    songs = rows.withColumn("id_ok", F.coalesce(F.col("id").rlike(r"\A[0-9]+\z"), F.lit(False))).withColumn("row", F.lit(1))
    shape = listings.select("total_pages", "per_page", F.lit(1).alias("listing"))
    row, listing = F.col("row").isNotNull(), F.col("listing").isNotNull()
    rules = {
        "no post id": F.count_if(row & F.col("post_id").isNull()), "id not numeric": F.count_if(row & ~F.col("id_ok")),
        **{f"no {c}": F.count_if(row & F.col(c).isNull()) for c in required},
        "no page count": F.count_if(listing & (F.coalesce("total_pages", F.lit(0)) < 1)),
        "no page size": F.count_if(listing & (F.coalesce("per_page", F.lit(0)) < 1)),
        "too few songs": F.when(
            F.count_distinct("post_id") < F.max(F.col("total_pages") * F.col("per_page") - F.col("per_page")), 1
        ).otherwise(0).cast("long"),
    }
    counted = songs.unionByName(shape, allowMissingColumns=True).agg(*[c.alias(n) for n, c in rules.items()])
    return counted.unpivot([], [f"`{n}`" for n in rules], "rule", "violations")


def unknown_entities(pages: DataFrame, column: str = "html") -> DataFrame:
    """(entity, occurrences, pages): named entities the table does not know."""
    found = pages.select("page", F.explode(F.regexp_extract_all(column, F.lit(ENTITY), F.lit(1))).alias("entity"))
    return found.filter(
        ~F.startswith("entity", F.lit("#")) & ~F.col("entity").isin(*fixed.NAMED_ENTITIES)
    ).groupBy("entity").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("page").alias("pages"))
