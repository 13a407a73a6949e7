"""Images and evidence of pages and feed items: tags are taken once, with their attributes, and looked up by name; linked data is
read as Variant. No page is parsed outside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public names of a page's image, in the order in which they count.
IMAGE_NAMES = (("og:image", "og:image:url", "og:image:secure_url"), ("twitter:image", "twitter:image:src"), ("image",))
#: Any tag of these kinds, quoted values being taken whole; no backtracking.
TAG = "(?i)<(?:meta|link|img|source)[\\s/](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
ATTRIBUTE = "[^\\s\"'<>/=]+\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s\"'<>=]+)"
SCRIPT = "(?is)<script[^<>]*>.*?</script>"
#: Names of attributes under which images wait to be loaded.
LAZY = "^data-([a-z-]*-)?(src|original|image)$"
MOST_IMAGES = 12


def image_reason(url: Column) -> Column:
    """ok, or why a link is no article image."""
    low = F.lower(url)
    return (
        F.when(low.rlike("\\.svg"), "vector").when(low.rlike("logo|icon|sprite|avatar|placeholder|pixel"), "decorative")
        .when(url.rlike("[?&]w=[0-9]{1,2}(&|$)"), "small").when(~low.rlike("\\.(jpe?g|png|webp)"), "not_an_image").otherwise("ok")
    )


REASON_SQL = """CASE WHEN regexp_matches(lower({u}), '\\.svg') THEN 'vector' WHEN regexp_matches(lower({u}), 'logo|icon|sprite|avatar|placeholder|pixel') THEN 'decorative'
  WHEN regexp_matches({u}, '[?&]w=[0-9]{{1,2}}(&|$)') THEN 'small' WHEN NOT regexp_matches(lower({u}), '\\.(jpe?g|png|webp)') THEN 'not_an_image' ELSE 'ok' END"""


def resolved(url: Column, base: Column) -> Column:
    """A link as a page at base means it; null if it is empty."""
    plain = F.trim(F.regexp_replace(url, "&amp;", "&"))
    origin = F.regexp_extract(base, "^([a-z]+://[^/]+)", 1)
    return F.nullif(F.when(plain.rlike("^https?://"), plain).when(plain.startswith("//"), F.concat(F.lit("https:"), plain)).when(plain == "", plain)
                    .when(plain.startswith("/"), F.concat(origin, plain)).otherwise(F.concat(origin, F.lit("/"), plain)), F.lit(""))


def resolved_sql(u: str, base: str) -> str:
    plain, origin = f"trim(replace({u}, '&amp;', '&'))", f"regexp_extract({base}, '^([a-z]+://[^/]+)', 1)"
    return f"CASE WHEN regexp_matches({plain}, '^https?://') THEN {plain} WHEN starts_with({plain}, '//') THEN 'https:' || {plain} WHEN {plain} = '' THEN NULL WHEN starts_with({plain}, '/') THEN {origin} || {plain} ELSE {origin} || '/' || {plain} END"


def tags(html: Column) -> Column:
    """The meta, link, img and source tags of a page, in order: (kind, attributes), attributes being (key, value)."""

    def pair(text: Column) -> Column:
        value = F.trim(F.regexp_replace(text, "^[^=]*=", ""))
        return F.struct(F.lower(F.trim(F.substring_index(text, "=", 1))).alias("key"), F.regexp_replace(value, "^[\"']|[\"']$", "").alias("value"))

    parsed = lambda tag: F.struct(
        F.lower(F.regexp_extract(tag, "^<([A-Za-z]+)", 1)).alias("kind"), F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), pair).alias("attributes")
    )
    return F.transform(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), parsed)


def attribute(tag: Column, *names: str) -> Column:
    """The first of a tag's attributes of these names that it has."""
    return F.coalesce(*[F.get(F.filter(tag["attributes"], _keyed(n)), F.lit(0))["value"] for n in names])


def _keyed(name: str):
    return lambda a: a["key"] == name


def meta_values(found: Column, names: tuple[str, ...], by: tuple[str, ...] = ("property", "name", "itemprop")) -> Column:
    """What the meta tags of a name say, in order."""
    named = F.filter(found, lambda t: (t["kind"] == "meta") & F.lower(attribute(t, *by)).isin(*names))
    return F.filter(F.transform(named, lambda t: attribute(t, "content")), lambda v: v.isNotNull())


def linked_data(html: Column) -> Column:
    """The objects of a page's JSON-LD as Variants: top ones, members of a top array, and those of their graphs."""
    scripts = F.filter(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(0)), lambda s: F.lower(F.regexp_extract(s, "^<[^>]*>", 0)).contains("ld+json"))
    parsed = F.transform(scripts, lambda s: F.try_parse_json(F.regexp_replace(s, "(?is)^<[^>]*>|</script>$", "")))
    listed = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array(F.try_variant_get(v, path, "variant")))
    tops = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), lambda v: listed(v, "$")))
    nested = lambda v: F.concat(F.array(v), F.filter(listed(v, "$['@graph']"), lambda g: g.isNotNull()))
    return F.flatten(F.transform(tops, nested))


def linked_images(node: Column) -> Column:
    """Links under image, thumbnailUrl and primaryImageOfPage: texts, objects with an address, or lists of both."""
    plain = lambda v: F.try_variant_get(v, "$", "string")
    address = lambda v: F.coalesce(*[F.try_variant_get(v, f"$['{k}']", "string") for k in ("url", "contentUrl", "@id")], F.when(~plain(v).rlike("^[\\[{]"), plain(v)))
    of = lambda k: F.coalesce(F.try_variant_get(node, f"$.{k}", "array<variant>"), F.array(F.try_variant_get(node, f"$.{k}", "variant")))
    return F.filter(F.transform(F.concat(*map(of, ("image", "thumbnailUrl", "primaryImageOfPage"))), address), lambda u: u.isNotNull())


def image_links(html: Column) -> Column:
    """Every image a page names: meta and link tags, JSON-LD, then images, source sets and lazy sources. Attributes stand in any
    order and in either quotes."""
    found = tags(html)
    of = lambda *kinds: F.filter(found, lambda t: t["kind"].isin(*kinds))
    pages = F.filter(of("link"), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), "[ \t\r\n]+"), "image_src"))
    sets = F.flatten(F.transform(of("img", "source"), lambda t: F.split(F.coalesce(attribute(t, "srcset"), F.lit("")), ",")))
    lazy = F.flatten(F.transform(of("img"), lambda t: F.transform(F.filter(t["attributes"], lambda a: a["key"].rlike(LAZY)), lambda a: a["value"])))
    every = F.concat(
        meta_values(found, IMAGE_NAMES[0]), meta_values(found, IMAGE_NAMES[1]), meta_values(found, IMAGE_NAMES[2], ("itemprop",)), F.transform(pages, lambda t: attribute(t, "href")),
        F.flatten(F.transform(linked_data(html), linked_images)), F.transform(of("img"), lambda t: attribute(t, "src")),
        F.transform(sets, lambda e: F.regexp_extract(F.trim(e), "^([^ \t\r\n]+)", 1)), lazy,
    )
    return F.filter(every, lambda u: u.isNotNull() & (u != ""))


def attribute_sql(tag: str, *names: str) -> str:
    one = lambda n: f"nullif(regexp_extract({tag}, '(?i)[\\s\"'']{n}\\s*=\\s*(\"[^\"]*\"|''[^'']*'')', 1), '')"
    return f"coalesce({', '.join(f'({one(n)})[2:-2]' for n in names)})"


def image_links_sql(html: str) -> str:
    """The same by plain SQL: tags by their kind, an attribute by its name, linked data as JSON."""
    of = lambda kinds: f"regexp_extract_all({html}, '(?i)<(?:{kinds})[\\s/](?:[^<>\"'']|\"[^\"]*\"|''[^'']*'')*>')"
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    meta = lambda names, *by: f"list_transform(list_filter({of('meta')}, lambda t: lower({attribute_sql('t', *by)}) IN ({listed(names)})), lambda t: {attribute_sql('t', 'content')})"
    page = f"list_transform(list_filter({of('link')}, lambda t: list_contains(string_split(lower({attribute_sql('t', 'rel')}), ' '), 'image_src')), lambda t: {attribute_sql('t', 'href')})"
    sets = f"list_transform(flatten(list_transform({of('img|source')}, lambda t: string_split(coalesce({attribute_sql('t', 'srcset')}, ''), ','))), lambda e: regexp_extract(trim(e), '^([^ \\t\\r\\n]+)', 1))"
    lazy = f"flatten(list_transform({of('img')}, lambda t: list_transform(regexp_extract_all(t, '(?i)\\sdata-(?:[a-z-]*-)?(?:src|original|image)\\s*=\\s*(\"[^\"]*\"|''[^'']*'')', 1), lambda v: v[2:-2])))"
    links = f"flatten(list_transform({linked_data_sql(html)}, lambda n: flatten(list_transform([n->'$.image', n->'$.thumbnailUrl', n->'$.primaryImageOfPage'], lambda x: list_transform({listed_sql('x')}, lambda e: CASE json_type(e) WHEN 'OBJECT' THEN coalesce(e->>'$.url', e->>'$.contentUrl', e->>'$.\"@id\"') ELSE e->>'$' END)))))"
    src = f"list_transform({of('img')}, lambda t: {attribute_sql('t', 'src')})"
    parts = (meta(IMAGE_NAMES[0], "property", "name", "itemprop"), meta(IMAGE_NAMES[1], "property", "name", "itemprop"), meta(IMAGE_NAMES[2], "itemprop"), page, links, src, sets, lazy)
    return f"list_filter(list_concat({', '.join(parts)}), lambda u: u IS NOT NULL AND u <> '')"


def listed_sql(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def linked_data_sql(html: str) -> str:
    scripts = f"list_filter(list_transform(list_filter(regexp_extract_all({html}, '(?is)<script[^<>]*>.*?</script>'), lambda s: contains(lower(regexp_extract(s, '^<[^>]*>')), 'ld+json')), lambda s: regexp_replace(regexp_replace(s, '^<[^>]*>', ''), '(?i)</script>$', '')), lambda j: json_valid(j))"
    tops = f"flatten(list_transform({scripts}, lambda j: {listed_sql('CAST(j AS JSON)')}))"
    graph = "n->'$.\"@graph\"'"
    return f"flatten(list_transform({tops}, lambda n: list_concat([n], list_filter({listed_sql(graph)}, lambda g: g IS NOT NULL))))"


def images(html: Column, base: Column, most: int = MOST_IMAGES) -> Column:
    """The different article images of a page, in order."""
    links = F.transform(image_links(html), lambda u: resolved(u, base))
    return F.slice(F.array_distinct(F.filter(links, lambda u: u.isNotNull() & (image_reason(u) == "ok"))), 1, most)


def first_image(fields: list[Column], html: Column, base: Column) -> Column:
    """The first article image among media fields (arrays of links), then those in the item's HTML."""
    named = F.filter(F.flatten(F.array(*fields)), lambda u: u.isNotNull() & (image_reason(u) == "ok"))
    return F.coalesce(F.get(named, F.lit(0)), F.get(images(html, base), F.lit(0)), F.lit(""))
