"""Column functions on text, links and time. Blanks and word characters are ASCII classes, so that every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a title's subject, in the languages of the feeds.
STOPWORDS = (
    "the and for that with was are this from has have had will not but its his her they their after over new says said about into more than you your who "
    "der die das und den von mit auf ist des dem ein eine nicht für les des est une que dans pour pas sur par avec qui los las del una por con para"
).split()


def clean(text: Column) -> Column:
    """Tags out, blanks to one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "), "[ \t\r\n]+", " "))


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def title_tokens(title: Column, limit: int = 12) -> Column:
    """The first words of three letters or more that are no stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.slice(F.filter(words(F.regexp_replace(title, "&amp;", " and ")), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), 1, limit)


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? before a blank."""
    return F.filter(F.split(F.regexp_replace(clean(text), "([.!?]) ", "$1\u0001"), "\u0001"), lambda s: s != "")


def summary(text: Column, limit: int = 260) -> Column:
    """The first two sentences. They are sought in the text's first characters, up to a tag that is not closed there; where
    these hold neither a third sentence nor more than `limit` characters, in the whole text."""
    two = lambda parts: F.array_join(F.slice(parts, 1, 2), " ")
    start = F.regexp_replace(F.substring(text, 1, 4 * limit), "<[^>]*$", "")
    # as the variable of a transform, the parts are worked out once
    said = F.transform(F.array(sentences(start)), lambda parts: F.when((F.size(parts) > 2) | (F.length(two(parts)) > limit + 1), two(parts)).otherwise(two(sentences(text))))
    return F.trim(F.substring(F.get(said, F.lit(0)), 1, limit))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a blank. Shifted copies are zipped, so the tokens are worked out n times in all and not
    once for each run."""
    out = tokens
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.filter(out, lambda x: x.isNotNull())


def overlap(a: Column, b: Column) -> Column:
    """Shared elements as a share of the smaller set; 0 if one is empty."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def pair_score(a: Column, b: Column) -> Column:
    """The greater of Jaccard and 0.65 containment + 0.35 Jaccard."""
    j = jaccard(a, b)
    return F.greatest(j, 0.65 * overlap(a, b) + 0.35 * j)


def distinct_names(names: Column) -> Column:
    """The first of the entries that are equal without case, in order."""
    low = F.transform(names, lambda x: F.lower(x))
    return F.filter(names, lambda x, k: F.array_position(low, F.lower(x)) == k + 1)


def stable_hash(text: Column, size: int = 40) -> Column:
    return F.substring(F.sha1(text), 1, size)


def domain(link: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(link, "^[a-zA-Z]+://([^/?#:]+)", 1)), "^www\\.", "")


#: Query parameters that only track.
TRACKING = "^(utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|ref)$"


def canonical_url(link: Column) -> Column:
    """Lower-cased host without www, no fragment, no tracking parameters, the rest sorted, no slash at the end."""
    bare = F.regexp_replace(F.trim(link), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([a-zA-Z]+)://", 1))
    path = F.regexp_replace(F.regexp_extract(bare, "^[a-zA-Z]+://[^/?]+([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)))
    return F.concat(scheme, F.lit("://"), domain(bare), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def slug(text: Column, limit: int = 80) -> Column:
    folded = F.translate(F.lower(text), "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, limit), "-$", "")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def half_up(x: Column) -> Column:
    """To the nearest whole number, halves upwards, also below zero."""
    return F.floor(x + 0.5)


def age_hours(published: Column, now: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(published)) / 3.6e9


def base_score(weight: Column, hours_old: Column, max_hours: float = 48.0) -> Column:
    """70 to 94: 0.6 freshness + 0.25 source weight + 0.15 recency step."""
    old = F.greatest(F.lit(0.0), hours_old)
    fresh = F.greatest(F.lit(0.0), 1 - old / max_hours)
    step = F.when(old <= 2, 1.0).when(old <= 6, 0.7).when(old <= 12, 0.35).otherwise(0.1)
    part = clamp(0.6 * fresh + 0.25 * clamp((weight - 0.85) / 0.45, 0.0, 1.0) + 0.15 * step, 0.0, 1.0)
    return half_up(70 + 24 * part).cast("long")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))
