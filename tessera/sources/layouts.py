"""What site adapters read from pages: links to details, cards of listings, and details in four layouts.

Pages are (page_id, url, html); ``source_url`` is where the site's list is.  A
page whose layout is not the expected one gives a status and no facts: nothing is
taken from another part of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.operators.storage import settled
from tessera.sources import elements as el

# Bounds, labels and wording of the layouts.
LONGEST_CARD, LONGEST_DETAIL = 1_500, 100_000
LENGTH = r"[0-9۰-۹]+(?:[.٫/][0-9۰-۹]+)?\s*(?:ساعت|دقیقه)(?:\s*و\s*نیم)?"
QUESTIONS, DESCRIPTION, BUY = "سوالات متداول", "توضیحات", "خرید بلیت"
HOSTS = ("میزبان", "برگزار کننده", "برگزارکننده")
MONEY = ("تومان", "ریال", "رایگان")
ABOUT = "درباره این"


@dataclass(frozen=True)
class Site:
    """A site's settings: which addresses are details, where the content is, what to leave out, which layout."""

    prefixes: tuple[str, ...]
    selector: str
    exclude: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    layout: str = "generic"
    longest: int | None = LONGEST_DETAIL  # characters of a detail's text; None for any length

    def skip(self) -> Column:
        general = el.unseen() | el.one_of((*el.ASIDES, *self.exclude))
        return general | LAYOUTS[self.layout].skip()


def _no() -> Column:
    return F.lit(False)


@dataclass(frozen=True)
class Layout:
    """How a site's detail pages are built."""

    parts: Callable[[DataFrame, str, Site], DataFrame]  # the subtrees that make up the text, in order: (key, open, stop)
    skip: Callable[[], Column] = _no
    heading: Callable[[], Column] = lambda: el.matches("h1")
    fields: Callable[[DataFrame, DataFrame, str, Site], DataFrame] | None = None  # (key, name, value)
    native_ids: bool = True
    first_heading: bool = False


# ---- lists


def _anchors(found: DataFrame, pages: DataFrame, source_url: Column, site: Site) -> DataFrame:
    hrefs = found.where("tag = 'a'").where(el.attr("href") != "").join(pages.select("page_id", F.col("url").alias("_page"), source_url.alias("_source")), "page_id")
    return hrefs.withColumn("link", keys.detail_address(keys.joined_address(el.attr("href"), F.col("_page")), F.col("_source"), site.prefixes, site.drop)).where("link is not null")


def discovered(pages: DataFrame, source_url: Column, site: Site) -> DataFrame:
    """(page_id, link, nth) of the details a list links to, each once, in page order."""
    links = _anchors(el.parsed(pages), pages, source_url, site).groupBy("page_id", "link").agg(F.min("open").alias("_at"))
    return links.select("page_id", "link", F.row_number().over(Window.partitionBy("page_id").orderBy("_at")).alias("nth"))


def cards(pages: DataFrame, source_url: Column, site: Site) -> DataFrame:
    """(page_id, link, text): an item's own card on its list, the text of the one link to it.

    Links without text count for nothing; a link with several texts is ambiguous
    and has no card, nor has one whose text is no single item's.
    """
    found = el.parsed(pages)
    links = _anchors(found, pages, source_url, site)
    said = el.texts(found, links, "page_id", site.skip()).withColumnRenamed("node", "open")
    rows = links.select("page_id", "open", "link").join(said, ["page_id", "open"])
    one = rows.groupBy("page_id", "link").agg(F.min("text").alias("text"), F.max("text").alias("_other"))
    return one.where((F.col("text") == F.col("_other")) & (F.char_length("text") <= LONGEST_CARD)).drop("_other")


# ---- details


def details(pages: DataFrame, source_url: Column, site: Site) -> DataFrame:
    """Per page: (page_id, status, text, title, title_is_heading, external_id, links, structured, fields).

    ``status`` is ok, or why nothing was read: not_a_detail, region (no single
    content region of the layout), text (none, or too much), headings (several).
    ``fields`` maps names to exact slices of the text.
    """
    layout, key = LAYOUTS[site.layout], "page_id"
    approved = pages.withColumn("_link", keys.detail_address(F.col("url"), source_url, site.prefixes, site.drop))
    found = settled(el.parsed(approved.where("_link is not null")))
    parts = layout.parts(found, key, site)
    kept = el.retained(el.within(found, parts, key), key, site.skip())
    said = el.content(kept, key)
    text = said.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "\n").alias("text"))
    heads = el.texts(found, kept.where(layout.heading()).select(key, "open", "stop"), key, site.skip())
    if layout.first_heading:
        first = heads.groupBy(key).agg(F.min_by("text", "node").alias("h"))
        heads = first.select(key, F.when(~F.col("h").isin(DESCRIPTION, QUESTIONS), F.array("h")).otherwise(F.array()).alias("heads"))
    else:
        heads = heads.groupBy(key).agg(F.collect_list("text").alias("heads"))
    hrefs = kept.where("tag = 'a'").where(el.attr("href") != "").join(pages.select(key, F.col("url").alias("_page")), key)
    hrefs = hrefs.withColumn("link", keys.joined_address(el.attr("href"), F.col("_page"))).where(F.col("link").rlike(r"^(?i:https?)://[^/?#@\s]+(?:[/?#]|$)"))
    links = hrefs.groupBy(key, "link").agg(F.min("open").alias("at")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "link"))), lambda x: x["link"]).alias("links"))
    data = found.where((F.col("tag") == "script") & (el.attr("type") == "application/ld+json")).select(key, F.lit(True).alias("structured")).distinct()
    one = parts.select(key, F.lit(True).alias("_region")).distinct()
    rows = approved.select(key, "url", "_link").join(one, key, "left").join(text, key, "left").join(heads, key, "left").join(links, key, "left").join(data, key, "left")
    if layout.fields:
        said = layout.fields(found, parts, key, site).where("value <> ''").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("_fields"))
        rows = rows.join(said, key, "left")
        fields = F.map_filter("_fields", lambda _, v: F.contains(F.col("text"), v))
    else:
        fields = F.lit(None)
    n = F.size(F.coalesce("heads", F.array().cast("array<string>")))
    long = F.char_length("text") > site.longest if site.longest else F.lit(False)
    status = (
        F.when(F.col("_link").isNull(), "not_a_detail").when(F.col("_region").isNull(), "region")
        .when(F.col("text").isNull() | long, "text").when(n > 1, "headings").otherwise("ok")
    )
    ok = lambda c: F.when(F.col("status") == "ok", c)
    segment = F.regexp_extract(F.col("url"), r"^[a-z]+://[^/?#]*(?:/[^?#]*)?/([^/?#]+)/?$", 1)
    native = F.nullif(segment, F.lit("")) if layout.native_ids else F.lit(None).cast("string")
    return rows.withColumn("status", status).select(
        key, "status", ok(F.col("text")).alias("text"), ok(F.coalesce(F.get("heads", 0), F.split_part("text", F.lit("\n"), F.lit(1)))).alias("title"), ok(n > 0).alias("title_is_heading"),
        ok(F.coalesce(native, F.sha2("url", 256))).alias("external_id"), ok(F.coalesce("links", F.array().cast("array<string>"))).alias("links"),
        ok(F.coalesce("structured", F.lit(False))).alias("structured"), ok(F.coalesce(fields.cast("map<string,string>"), F.create_map().cast("map<string,string>"))).alias("fields"),
    )


def _generic_parts(found: DataFrame, key: str, site: Site) -> DataFrame:
    return el.only(el.regions(found, key, site.selector, site.skip()), key).select(key, "open", "stop")


def _panel_parts(found: DataFrame, key: str, site: Site) -> DataFrame:
    """The one panel, wherever it is: before its script runs it may be inside a hidden wrapper."""
    return el.only(found.where(el.matches(site.selector)), key).select(key, "open", "stop")


def _panel_skip() -> Column:
    return el.one_of((".mobile-only", ".event-detail-comments")) | ((F.col("tag") == "a") & el.attr("href").rlike("^/(profile|login)"))


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("‌"), F.lit(" ")), r"(?U)\s+", " "))


# A region whose one child with a bold heading holds sections under such headings.

BOLD, CAPTIONED, LABEL = ".font-black", ".q-item__label--caption", ".q-item__label"


def _container(found: DataFrame, key: str, site: Site) -> DataFrame:
    main = _generic_parts(found, key, site)
    children = found.where("tag is not null").join(main.select(key, F.col("open").alias("parent")), [key, "parent"])
    bold = found.where(el.matches(BOLD)).select(key, F.col("open").alias("_b")).join(children.select(key, "open", "stop"), key).where("_b between open and stop").select(key, "open", "stop").distinct()
    return el.only(bold, key)


def _children(found: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """The elements directly in the given ones."""
    return found.where("tag is not null").join(of.select(key, F.col("open").alias("parent")), [key, "parent"])


def _hosts(found: DataFrame, key: str, site: Site) -> DataFrame:
    """The sections of cards in the container whose one caption says that they name the organizer."""
    box = _container(found, key, site)
    cards_ = el.within(found, box, key).where(el.matches(".q-card")).drop("node")
    sections = el.within(found, cards_, key).where(el.matches(".q-item__section--main")).drop("node").dropDuplicates([key, "open"])
    captions = el.within(found, sections, key).where(el.matches(CAPTIONED)).withColumnRenamed("node", "section")
    said = el.texts(found, captions.drop("section"), key, el.unseen()).select(key, F.col("node").alias("open"), F.col("text").alias("said"))
    only = captions.join(said, [key, "open"]).groupBy(key, "section").agg(F.collect_list(folded(F.col("said"))).alias("c")).where(F.size("c") == 1).where(F.get("c", 0).isin(*HOSTS[1:]))
    return sections.join(only.select(key, F.col("section").alias("open")), [key, "open"])


def _section_parts(found: DataFrame, key: str, site: Site) -> DataFrame:
    children = found.join(_container(found, key, site).select(key, F.col("open").alias("parent")), [key, "parent"])
    said = el.texts(found, children, key, el.unseen()).select(key, F.col("node").alias("open"), F.col("text").alias("said"))
    ends = children.where(el.matches(BOLD)).join(said, [key, "open"]).where(F.col("said") == QUESTIONS).groupBy(key).agg(F.min("open").alias("_end"))
    kept = children.join(ends, key, "left").where("_end is null or open < _end").select(key, "open", "stop")
    return kept.union(_hosts(found, key, site).select(key, "open", "stop"))


def _section_skip() -> Column:
    return el.one_of((".q-icon", ".q-list", ".q-card"))


def _section_fields(found: DataFrame, parts: DataFrame, key: str, site: Site) -> DataFrame:
    children = _children(found, key, _container(found, key, site))
    shown = el.texts(found, children, key, site.skip()).select(key, F.col("node").alias("open"), F.col("text").alias("said"))
    rows = children.withColumn("bold", el.matches(BOLD)).join(shown, [key, "open"], "left")
    rows = rows.withColumn("_titles", F.sum(F.col("bold").cast("int")).over(Window.partitionBy(key).orderBy("open").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_before", F.lag("bold").over(Window.partitionBy(key).orderBy("open"))).withColumn("_said", F.lag("said").over(Window.partitionBy(key).orderBy("open")))
    header = rows.where("_before and _titles = 1").select(key, "open", "stop")
    slots = _children(found, key, header)
    values = el.texts(found, slots, key, site.skip()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]).alias("v"))
    values = values.where((F.size("v") >= 2) & F.get("v", 0).rlike("[0-9۰-۹]"))
    rest = F.slice("v", 2, F.size("v"))
    lengths, others = F.filter(rest, lambda x: x.rlike(f"^(?:{LENGTH})$")), F.filter(rest, lambda x: ~x.rlike(f"^(?:{LENGTH})$"))
    area = F.when((F.size(others) == 1) & (F.char_length(F.get(others, 0)) <= 120) & ~F.get(others, 0).rlike(LENGTH), F.get(others, 0))
    pairs = F.array(F.struct(F.lit("source_date_text").alias("name"), F.get("v", 0).alias("value")), F.struct(F.lit("duration_text").alias("name"), F.when(F.size(lengths) == 1, F.get(lengths, 0)).alias("value")), F.struct(F.lit("area_text").alias("name"), area.alias("value")))
    out = values.select(key, F.inline(pairs))
    described = rows.where(F.col("_before") & (F.col("_said") == DESCRIPTION)).groupBy(key).agg(F.min_by("said", "open").alias("value")).select(key, F.lit("description_text").alias("name"), "value")
    names = el.within(found, _hosts(found, key, site), key).where(el.matches(LABEL) & ~el.matches(CAPTIONED)).drop("node")
    said = el.texts(found, names, key, el.unseen()).groupBy(key).agg(F.collect_list("text").alias("n")).where(F.size("n") == 1)
    return out.union(described).union(said.select(key, F.lit("organizer_name"), F.get("n", 0)))


# An article with its title, and beside it a booking panel.


def _article(found: DataFrame, key: str) -> DataFrame:
    titles = found.where(el.matches("h1")).select(key, F.col("open").alias("_h"))
    return el.only(found.where(el.matches("article")).join(titles, key).where("_h between open and stop").select(key, "open", "stop", "parent").distinct(), key)


def _article_host(found: DataFrame, key: str) -> DataFrame:
    """(key, label, name): rows of the article's one organizer section."""
    section = el.only(el.within(found, _article(found, key), key).where((F.col("tag") == "section") & (el.attr("id") == "organizer")).drop("node"), key)
    label = el.only(_children(found, key, section).where("tag = 'p'"), key)
    name = el.only(el.within(found, section, key).where("tag = 'h3'").drop("node"), key)
    said = el.texts(found, label, key, el.unseen()).where(folded(F.col("text")).isin(*HOSTS)).select(key)
    named = el.texts(found, name, key, el.unseen()).select(key, F.col("text").alias("value"))
    box = lambda df, alias: df.select(key, F.struct("open", "stop").alias(alias))
    return box(label, "label").join(box(name, "name"), key).join(said, key).join(named, key)


def _article_price(found: DataFrame, key: str) -> DataFrame:
    """(key, open, stop, value) of the one price of the one panel beside the article that sells tickets."""
    beside = _article(found, key).select(key, "parent")
    panel = el.only(found.where("tag = 'aside'").join(beside, [key, "parent"]), key)
    inside = el.within(found, panel, key)
    seen = el.unseen() & (F.col("tag") != "button")
    sells = el.texts(found, inside.where("tag = 'button'").drop("node"), key, seen).where(F.col("text") == BUY).select(key).distinct()
    paragraphs = inside.where("tag = 'p'").drop("node")
    said = el.texts(found, paragraphs, key, el.unseen()).where(F.contains("text", F.lit(MONEY[0])))
    return el.only(paragraphs.join(said.select(key, F.col("node").alias("open"), F.col("text").alias("value")), [key, "open"]), key).join(sells, key).select(key, "open", "stop", "value")


def _article_parts(found: DataFrame, key: str, site: Site) -> DataFrame:
    host = _article_host(found, key)
    own = _article(found, key).select(key, "open", "stop")
    return own.union(host.select(key, "label.open", "label.stop")).union(host.select(key, "name.open", "name.stop")).union(_article_price(found, key).select(key, "open", "stop"))


def _article_skip() -> Column:
    rating = (F.col("tag") == "p") & F.trim(F.coalesce("own", F.lit(""))).rlike(r"^[\d۰-۹٫.]+ از ۵ · [\d۰-۹]+ نظر$")
    return F.coalesce((F.col("tag").isNotNull()) & ((el.attr("aria-labelledby") == "event-reviews-heading") | (el.attr("id") == "organizer") | rating), F.lit(False))


def _article_fields(found: DataFrame, parts: DataFrame, key: str, site: Site) -> DataFrame:
    article = _article(found, key)
    inside = el.within(found, article, key).drop("node")
    sections = inside.where("tag = 'section'").where(~site.skip())
    heads = el.within(inside, sections, key).where("tag = 'h2'").withColumnRenamed("node", "section")
    said = el.texts(inside, heads.drop("section"), key, el.unseen()).select(key, F.col("node").alias("open"), F.col("text").alias("said"))
    about = heads.join(said, [key, "open"]).withColumn("_n", F.row_number().over(Window.partitionBy(key, "section").orderBy("open"))).where("_n = 1").where(folded(F.col("said")).startswith(ABOUT)).select(key, F.col("section").alias("open"))
    bodies = el.only(el.within(inside, sections.join(about, [key, "open"]), key).where(el.matches(".rich-text-content")).drop("node"), key)
    described = el.texts(inside, bodies, key, site.skip()).select(key, F.lit("description_text").alias("name"), F.col("text").alias("value"))
    clocks = inside.where((F.col("tag") == "svg") & F.contains(el.attr("class"), F.lit("lucide-clock"))).select(key, "parent").distinct()
    tiles = inside.where("tag = 'p'").join(clocks, [key, "parent"])
    length = F.regexp_extract("text", rf"^({LENGTH})(?:\s|$)", 1)
    lengths = el.texts(inside, tiles, key, el.unseen()).select(key, length.alias("value")).where("value <> ''")
    lengths = el.only(lengths, key).select(key, F.lit("duration_text"), "value")
    host = _article_host(found, key).select(key, F.lit("organizer_name"), "value")
    return described.union(lengths).union(host).union(_article_price(found, key).select(key, F.lit("price_text"), "value"))


LAYOUTS = {
    "generic": Layout(_generic_parts, native_ids=False),
    "panel": Layout(_panel_parts, _panel_skip),
    "sections": Layout(_section_parts, _section_skip, lambda: el.matches(BOLD), _section_fields, first_heading=True),
    "article": Layout(_article_parts, _article_skip, fields=_article_fields),
}
