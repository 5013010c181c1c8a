"""Structured data of one HTML document as column expressions: JSON-LD nodes as an array of JSON texts, and what they say.

Nodes are the elements of a block's ``@graph`` or list, or the block itself.  A block that is no JSON has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of businesses at a place, lower case; types of articles; fields that carry a price.
LOCAL_TYPES = [
    "localbusiness", "medicalbusiness", "medicalclinic", "dentist", "physician", "physiotherapy", "healthandbeautybusiness", "daycare",
    "store", "restaurant", "cafeorcoffeeshop", "foodestablishment", "legalservice", "attorney", "accountingservice", "financialservice",
    "homeandconstructionbusiness", "plumber", "electrician", "roofingcontractor", "hvacbusiness", "movingcompany", "realestateagent",
    "travelagency", "automotivebusiness", "autorepair", "beautysalon", "hairsalon", "nailsalon", "daspa", "dayspa", "gym", "exercisegym",
    "sportsactivitylocation", "lodgingbusiness", "hotel", "professionalservice", "veterinarycare", "childcare", "emergencyservice",
    "selfstorage", "shoppingcenter", "petstore", "librarysystem", "radiostation", "televisionstation",
]
ARTICLE = r"Article$|^BlogPosting$|^Report$"
PRICE_FIELDS = ["price", "priceRange", "lowPrice", "highPrice", "priceSpecification"]
_NONE = "array<string>"


def nothing() -> Column:
    return F.array().cast(_NONE)


def blocks(html: Column) -> Column:
    """The texts of a page's JSON-LD blocks."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def elements(json: Column) -> Column:
    """A JSON list's elements, or the one object, as JSON texts (texts without their quotes)."""
    t = F.trim(F.coalesce(json, F.lit("")))
    return F.coalesce(F.when(t.startswith("["), F.from_json(t, _NONE)).when(t.startswith("{"), F.array(t)), nothing())


def is_object(node: Column) -> Column:
    return F.coalesce(F.ltrim(node).startswith("{"), F.lit(False))


def nodes(html: Column) -> Column:
    """All nodes of a page, in order."""
    valid = F.filter(blocks(html), is_json)
    found = F.transform(valid, lambda b: F.when(get(b, "@graph").startswith("["), elements(get(b, "@graph"))).otherwise(elements(b)))
    return F.filter(F.flatten(found), is_object)


def get(node: Column, field: str) -> Column:
    return F.get_json_object(node, f"$.{field}")


def given(value: Column) -> Column:
    """Whether a field says anything: not absent, empty, false or 0."""
    return F.coalesce(~F.trim(value).isin("", "[]", "{}", "false", "0", "null"), F.lit(False))


def kinds(node: Column) -> Column:
    """A node's types."""
    t = get(node, "@type")
    return F.coalesce(F.when(t.startswith("["), F.from_json(t, _NONE)).when(t.isNotNull(), F.array(t)), nothing())


def is_a(node: Column, *types: str) -> Column:
    return F.arrays_overlap(kinds(node), F.array(*map(F.lit, types)))


def is_article(node: Column) -> Column:
    return F.exists(kinds(node), lambda t: t.rlike(ARTICLE))


def is_local(node: Column) -> Column:
    return F.exists(kinds(node), lambda t: F.lower(F.trim(t)).isin(LOCAL_TYPES))


def people(found: Column) -> Column:
    """Persons among the nodes, and in their author, founder and medicalSpecialist fields."""
    inner = lambda n: F.concat(*[elements(get(n, f)) for f in ("founder", "author", "medicalSpecialist")])
    return F.filter(F.concat(found, F.flatten(F.transform(found, inner))), lambda n: is_object(n) & is_a(n, "Person"))


def values(node: Column, field: str) -> Column:
    """A field's values: a list's elements, or the one value."""
    v = get(node, field)
    return F.when(v.isNull(), nothing()).when(v.startswith("["), elements(v)).otherwise(F.array(v))


def author_names(found: Column) -> Column:
    """Names of all authors, sorted, each once."""
    named = lambda a: F.trim(F.when(is_object(a), get(a, "name")).otherwise(a))
    every = F.flatten(F.transform(found, lambda n: F.transform(values(n, "author"), named)))
    return F.array_sort(F.array_distinct(F.filter(every, given)))


def author_states(found: Column) -> Column:
    """``linked``, ``unlinked`` or ``missing`` for each author of the articles (of all nodes, where there is no article).

    An author given by its @id alone is looked up among the nodes.
    """
    articles = F.filter(found, is_article)
    sources = F.when(F.size(articles) > 0, articles).otherwise(F.filter(found, lambda n: get(n, "author").isNotNull()))

    def at(key: Column) -> Column:
        return F.try_element_at(F.filter(found, lambda n: get(n, "@id") == key), F.lit(-1))

    def state(a: Column) -> Column:
        short = F.coalesce(F.size(F.json_object_keys(a)), F.lit(9)) <= 2
        who = F.when(is_object(a), F.coalesce(F.when(short & get(a, "@id").isNotNull(), at(get(a, "@id"))), a)).otherwise(at(a))
        told = given(get(who, "sameAs")) | given(get(who, "jobTitle")) | given(get(who, "hasCredential"))
        return F.when(F.coalesce(is_a(who, "Person", "Organization") & told, F.lit(False)), "linked").otherwise("unlinked")

    one = lambda n: F.when(get(n, "author").isNull(), F.array(F.lit("missing"))).otherwise(F.transform(values(n, "author"), state))
    return F.flatten(F.transform(sources, one))


def first(json: Column) -> Column:
    """The object, or a list's first one."""
    return F.try_element_at(elements(json), F.lit(1))


def locality(node: Column) -> Column:
    return F.nullif(F.trim(get(first(get(node, "address")), "addressLocality")), F.lit(""))


def city(found: Column) -> Column:
    """The place of a local business' address, else of any address."""
    local = F.filter(F.transform(F.filter(found, is_local), locality), lambda c: c.isNotNull())
    own = lambda n: F.when(F.exists(kinds(n), lambda t: F.lower(F.trim(t)) == "postaladdress"), F.nullif(F.trim(get(n, "addressLocality")), F.lit("")))
    other = F.filter(F.transform(found, lambda n: F.coalesce(own(n), locality(n))), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(local, F.lit(1)), F.try_element_at(other, F.lit(1)))


def has_geo(node: Column) -> Column:
    geo = first(get(node, "geo"))
    return F.coalesce(get(geo, "latitude").isNotNull() & get(geo, "longitude").isNotNull(), F.lit(False))


def faq_entries(found: Column) -> Column:
    """The entries of all FAQ pages."""
    return F.flatten(F.transform(F.filter(found, lambda n: is_a(n, "FAQPage")), lambda n: elements(get(n, "mainEntity"))))


def price_fields(found: Column) -> Column:
    """How many price fields say something."""
    count = lambda n: sum((given(get(n, f)).cast("int") for f in PRICE_FIELDS), F.lit(0))
    return F.aggregate(found, F.lit(0), lambda s, n: s + count(n))
