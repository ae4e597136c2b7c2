"""Metadata of a raw article, from fallback chains over its VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import coerce as C

#: Sites whose relative addresses are known.
SITES = {"nj": "https://www.nj.com", "lehighvalleylive": "https://www.lehighvalleylive.com"}
#: Fixed value: how a category label begins.
LABEL = "Category name:"
FIELDS = ("external_id", "url", "sections", "categories", "tags", "title", "website", "publish_date", "datetime", "first_publish_date", "thumb")


def external_id(doc: Column) -> Column:
    """Not stripped; null only if the last fallback is missing."""
    return C.to_str(C.first_truthy(C.child(doc, "_id"), C.child(doc, "external_id"), C.child(doc, "id")))


def website(doc: Column) -> Column:
    return C.opt_str(C.first_truthy(C.child(doc, "website"), C.child(doc, "canonical_website")))


def base_url(site: Column, sites: dict[str, str] | None = None) -> Column:
    pairs = [F.lit(x) for pair in (SITES if sites is None else sites).items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), site) if pairs else F.lit(None).cast("string")


def site_data(doc: Column, site: Column) -> Column:
    return F.try_element_at(F.try_variant_get(doc, "$.websites", "map<string,variant>"), site)


def absolute(address: Column, base: Column) -> Column:
    return C.let(address, lambda a: F.when(base.isNotNull() & a.startswith("/"), F.concat(base, a)).otherwise(a))


def url(doc: Column, own_site: Column, base: Column) -> Column:
    own = C.child(doc, "url")
    other = C.first_truthy(C.child(own_site, "website_url"), C.child(doc, "website_url"), C.child(doc, "canonical_url"))
    found = C.let(other, lambda o: F.when(C.truthy(o), F.when(C.is_string(o), absolute(C.to_str(o), base)).otherwise(C.to_str(o))))
    return C.blank_to_null(F.when(C.truthy(own), C.to_str(own)).otherwise(found))


def title(doc: Column) -> Column:
    return C.opt_str(C.first_truthy(C.child(doc, "headlines.basic"), C.child(doc, "headline"), C.child(doc, "title")))


def publish_date(doc: Column) -> Column:
    return C.opt_iso(C.first_truthy(C.child(doc, "additional_properties.publish_date"), C.child(doc, "created_date")))


def dated(doc: Column, field: str, published: Column) -> Column:
    own = C.child(doc, "additional_properties." + field)
    return C.iso(F.when(C.truthy(own), C.opt_str(own)).otherwise(published))


def sections(doc: Column, own_site: Column) -> Column:
    names = F.array(C.opt_str(C.child(own_site, "website_section.name")), C.opt_str(C.child(own_site, "website_section.additional_properties.original.site.site_section")))
    return C.merge_list(F.array_distinct(C.present(names)), C.str_list(C.child(doc, "sections")))


def tags(doc: Column) -> Column:
    slugs = F.transform(C.items(C.child(doc, "taxonomy.tags")), lambda t: C.opt_str(C.child(t, "slug")))
    return C.merge_list(C.present(slugs), C.str_list(C.child(doc, "tags")))


def label_name(label: Column) -> Column:
    """What follows the label's beginning, or null."""
    return C.let(label, lambda x: F.when(x.startswith(LABEL), C.blank_to_null(F.substring(x, len(LABEL) + 1, 2**31 - 1))))


def categories(doc: Column) -> Column:
    entries = F.filter(C.items(C.child(doc, "additional_properties.product_categories.iab_taxonomy")), C.is_array)
    names = F.transform(entries, lambda e: label_name(C.to_str(F.try_variant_get(e, "$[0]", "variant"))))
    return C.merge_list(C.present(names), C.str_list(C.child(doc, "categories")))


def thumb(doc: Column, base: Column) -> Column:
    images = F.filter(C.items(C.child(doc, "content_elements")), lambda e: F.try_variant_get(e, "$.type", "string") == "image")
    first = F.get(C.present(F.transform(images, lambda e: C.opt_str(C.child(e, "additional_properties.thumbnailResizeUrl")))), 0)
    return F.coalesce(absolute(first, base), C.opt_str(C.child(doc, "thumb")))


def fragments(doc: Column) -> Column:
    """The contents of the text elements, in order; null where one is missing or no string."""
    texts = F.filter(C.items(C.child(doc, "content_elements")), lambda e: F.try_variant_get(e, "$.type", "string") == "text")
    return F.transform(texts, lambda e: F.when(C.is_string(C.child(e, "content")), F.try_variant_get(e, "$.content", "string")))


def _object_or_false(v: Column) -> Column:
    return ~C.truthy(v) | C.is_object(v)


def shape_problems(doc: Column, own_site: Column) -> Column:
    """Names of the places whose shape a strict run does not accept; a permissive run takes them as absent."""
    taxonomy, sites, elements = C.child(doc, "taxonomy"), C.child(doc, "websites"), C.child(doc, "content_elements")
    section = C.child(own_site, "website_section")
    site = C.child(section, "additional_properties.original.site")
    rules = {
        "headlines": ~_object_or_false(C.child(doc, "headlines")),
        "additional_properties": ~_object_or_false(C.child(doc, "additional_properties")),
        "additional_properties.product_categories": ~_object_or_false(C.child(doc, "additional_properties.product_categories")),
        "taxonomy": taxonomy.isNotNull() & ~C.is_object(taxonomy),
        "taxonomy.tags": (C.truthy(C.child(taxonomy, "tags")) & ~C.is_array(C.child(taxonomy, "tags"))) | F.exists(C.items(C.child(taxonomy, "tags")), lambda t: ~C.is_object(t)),
        "websites": ~_object_or_false(sites),
        "websites.<website>": own_site.isNotNull() & ~C.is_object(own_site),
        "website_section": ~_object_or_false(section),
        "website_section.additional_properties": ~_object_or_false(C.child(section, "additional_properties")),
        "website_section.additional_properties.original": ~_object_or_false(C.child(section, "additional_properties.original")),
        "website_section.additional_properties.original.site": site.isNotNull() & ~C.is_object(site),
        "content_elements": (C.truthy(elements) & ~C.is_array(elements)) | F.exists(C.items(elements), lambda e: ~C.is_object(e)),
        "content_elements.content": F.exists(C.items(elements), lambda e: (F.try_variant_get(e, "$.type", "string") == "text") & C.truthy(C.child(e, "content")) & ~C.is_string(C.child(e, "content"))),
    }
    return C.present(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
