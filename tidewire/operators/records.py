"""Records by schema: rule rows say how each field of an entity is read and what must hold; they are compiled to columns.

A schema is data: a tuple of Field for each entity. normalised() reads landed rows (texts under any of a field's names) into typed
columns; failures_of() and warnings_of() name what a record breaks. Nothing is read row by row outside the engine."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.sources.feeds import parsed_time


class Field(NamedTuple):
    """kind: text, upper, slug (of `of`), enum (values), clamp (low, high), number, count (not negative), least (low or more),
    time, unless_false, flag, json, joined (of, by "-"), hashed (prefix in default, of, by ":"). `also`: other names of the field.
    default: a value, or "=name" for another field's. `of` names fields; with "?" as they were given."""

    name: str
    kind: str = "text"
    also: tuple[str, ...] = ()
    default: str | None = ""
    values: tuple[str, ...] = ()
    of: tuple[str, ...] = ()
    required: bool = False
    low: float | None = None
    high: float | None = None


#: When a record was made that doesn't say.
MADE = "2026-05-12T00:00:00.000Z"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
TIMES = (Field("created_at", "time", ("createdAt",), MADE), Field("updated_at", "time", ("updatedAt",), MADE))
INDEX = ("watch", "noindex", "index")
FEEDS = ("rss", "atom", "sitemap", "api", "html")
COVERAGE = ("primary", "nearby", "statewide", "regional")
#: The fields of each entity, their allowed values and bounds.
SCHEMAS: dict[str, tuple[Field, ...]] = {
    "city": (
        Field("name", also=("city",), required=True), Field("state_abbr", "upper", ("state",), required=True), Field("state_name", also=("stateName",), required=True), Field("slug", "slug", of=("name",), required=True),
        Field("state_slug", "slug", of=("state_name", "state_abbr"), required=True), Field("id", "joined", of=("slug", "state_abbr"), required=True), Field("county_name", also=("countyName",)), Field("timezone"),
        Field("latitude", "number", ("lat",)), Field("longitude", "number", ("lon",)), Field("population", "number"), Field("coverage_score", "clamp", ("coverageScore",), "0", low=0, high=100),
        Field("index_status", "enum", default="watch", values=INDEX), Field("last_fresh_story_at", "time", ("lastFreshStoryAt",), None), *TIMES,
    ),
    "local_source": (
        Field("name", required=True), Field("slug", "slug", of=("name",), required=True), Field("id", "joined", of=("slug",), required=True), Field("homepage_url", also=("homepageUrl",)),
        Field("source_type", "enum", default="other", values=("local_news", "tv", "radio", "official_city", "official_county", "police_fire", "school", "transit", "weather", "event", "blog", "community", "sports", "other")),
        Field("trust_level", "enum", default="unknown", values=("official", "established_publisher", "community", "blog", "unknown")),
        Field("crawl_status", "enum", default="pending_review", values=("active", "paused", "blocked_by_robots", "failed", "pending_review")),
        Field("robots_checked_at", "time", ("robotsCheckedAt",), None), Field("last_successful_fetch_at", "time", ("lastSuccessfulFetchAt",), None), Field("last_failed_fetch_at", "time", ("lastFailedFetchAt",), None), *TIMES,
    ),
    "source_feed": (
        Field("source_id", also=("sourceId",), required=True), Field("feed_type", "enum", default="rss", values=FEEDS), Field("id", "joined", of=("source_id", "feed_type"), required=True), Field("url", required=True),
        Field("active", "unless_false"), Field("fetch_frequency_minutes", "least", ("fetchFrequencyMinutes",), "15", low=1), Field("last_fetched_at", "time", ("lastFetchedAt",), None), Field("next_fetch_at", "time", ("nextFetchAt",), None),
        Field("etag"), Field("last_modified_header", also=("lastModifiedHeader",)), *TIMES,
    ),
    "source_city_coverage": (
        Field("source_id", also=("sourceId",), required=True), Field("city_id", also=("cityId",), required=True), Field("confidence", "clamp", default="0", low=0, high=100), Field("coverage_type", "enum", default="regional", values=COVERAGE),
    ),
    "source_fetch_run": (
        Field("source_feed_id", also=("sourceFeedId",), required=True), Field("started_at", "time", ("startedAt",), MADE), Field("id", "hashed", default="fetch-run-", of=("source_feed_id", "started_at"), required=True), Field("finished_at", "time", ("finishedAt",), None),
        Field("status", "enum", default="skipped", values=("success", "failed", "skipped")), Field("status_code", "number", ("statusCode",)), Field("items_found", "count", ("itemsFound",), "0", low=0), Field("items_new", "count", ("itemsNew",), "0", low=0), Field("error_message", also=("errorMessage",)),
    ),
    "input_signal": (
        Field("canonical_url", also=("canonicalUrl", "url"), required=True), Field("original_url", also=("originalUrl",), default="=canonical_url"), Field("title", required=True), Field("source_id", also=("sourceId",), required=True), Field("source_feed_id", also=("sourceFeedId",), required=True),
        Field("id", "hashed", default="signal-", of=("canonical_url", "title"), required=True), Field("excerpt", also=("summary",)), Field("author"), Field("published_at", "time", ("publishedAt",), None), Field("discovered_at", "time", ("discoveredAt",), MADE), Field("fetched_at", "time", ("fetchedAt",), None),
        Field("city_candidates_json", "json", ("cityCandidates",), "[]"), Field("topic_candidates_json", "json", ("topicCandidates",), "[]"), Field("entities_json", "json", ("entities",), "{}"), Field("language", default="en"),
        Field("signal_status", "enum", default="new", values=("new", "classified", "clustered", "rejected", "expired_private")), Field("rejection_reason", also=("rejectionReason",)), Field("created_at", "time", ("createdAt",), "=discovered_at"), Field("updated_at", "time", ("updatedAt",), "=discovered_at"),
    ),
    "story_cluster": (
        Field("headline", also=("title",), required=True), Field("city_id", also=("cityId",), required=True), Field("slug", "slug", of=("headline",), required=True), Field("id", "hashed", default="cluster-", of=("city_id", "slug"), required=True), Field("primary_topic", also=("primaryTopic",), default="general_local"), Field("summary"),
        Field("confidence_label", "enum", default="developing", values=("official", "confirmed_multiple_sources", "reported_one_source", "community_source", "developing", "low_confidence")), Field("urgency", "enum", default="normal", values=("breaking", "high", "normal", "low")),
        Field("first_seen_at", "time", ("firstSeenAt",), MADE), Field("last_updated_at", "time", ("lastUpdatedAt",), "=first_seen_at"), Field("public_started_at", "time", ("publicStartedAt",), None), Field("expires_at", "time", ("expiresAt",), None),
        Field("public_status", "enum", default="live", values=("live", "expired", "hidden", "rejected")), Field("index_status", "enum", default="noindex", values=("noindex", "index")), Field("source_count", "count", ("sourceCount",), "0", low=0), Field("official_source_count", "count", ("officialSourceCount",), "0", low=0),
        Field("latest_signal_id", also=("latestSignalId",)), Field("image_url", also=("imageUrl", "thumbnail_url", "thumbnailUrl")), Field("image_alt", also=("imageAlt",)), Field("created_at", "time", ("createdAt",), "=first_seen_at"), Field("updated_at", "time", ("updatedAt",), "=first_seen_at"),
    ),
    "story_cluster_signal": (
        Field("story_cluster_id", also=("storyClusterId",), required=True), Field("input_signal_id", also=("inputSignalId",), required=True), Field("source_id", also=("sourceId",), required=True), Field("is_primary", "flag", ("isPrimary",)), Field("added_at", "time", ("addedAt",), MADE),
    ),
    "story_cluster_event": (
        Field("event_type", "enum", default="source_added", values=("first_seen", "source_added", "official_update", "summary_updated", "confidence_changed", "expired")), Field("story_cluster_id", also=("storyClusterId",), required=True), Field("event_time", "time", ("eventTime",), MADE),
        Field("id", "hashed", default="cluster-event-", of=("story_cluster_id?", "event_time?", "event_type"), required=True), Field("description"), Field("created_at", "time", ("createdAt",), MADE),
    ),
    "city_topic_coverage": (
        Field("city_id", also=("cityId",), required=True), Field("topic", default="general_local", required=True), Field("id", "hashed", default="city-topic-", of=("city_id?", "topic?"), required=True), Field("fresh_story_count_24h", "count", ("freshStoryCount24h",), "0", low=0), Field("fresh_story_count_7d", "count", ("freshStoryCount7d",), "0", low=0),
        Field("source_count_7d", "count", ("sourceCount7d",), "0", low=0), Field("official_source_count_7d", "count", ("officialSourceCount7d",), "0", low=0), Field("coverage_score", "clamp", ("coverageScore",), "0", low=0, high=100), Field("index_status", "enum", default="watch", values=INDEX), Field("last_updated_at", "time", ("lastUpdatedAt",), MADE),
    ),
    "user_submitted_source": (
        Field("submitted_url", also=("submittedUrl",), required=True), Field("id", "hashed", default="submitted-source-", of=("submitted_url",), required=True), Field("submitted_city", also=("submittedCity",)), Field("submitted_email_optional", also=("submittedEmailOptional",)),
        Field("status", "enum", default="pending", values=("pending", "approved", "rejected")), Field("notes"), Field("created_at", "time", ("createdAt",), MADE), Field("reviewed_at", "time", ("reviewedAt",), None),
    ),
    "public_signal": (
        Field("sourceType", "enum", default="manual_public_signal", values=("google_trends", "manual_public_signal", "public_forum", "search_console")), Field("topic", also=("query",), required=True), Field("sourceUrl", required=True),
    ),
}


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\r\n]+", " "))


def given(df: DataFrame, field: Field) -> Column:
    """The first of a field's names that is there and not empty; null if there is none."""
    found = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (field.name, *field.also) if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _number(text: Column) -> Column:
    """A finite number; null if it is none."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def normalised(df: DataFrame, schema: tuple[Field, ...]) -> DataFrame:
    """Landed rows as records of a schema, one column for each field in its order."""
    out: dict[str, Column] = {}
    by_name = {f.name: f for f in schema}

    def part(name: str) -> Column:
        return F.coalesce(given(df, by_name[name[:-1]]), F.lit("")) if name.endswith("?") else F.coalesce(out[name].cast("string"), F.lit(""))

    for f in schema:
        raw = given(df, f)
        if f.kind == "upper":
            value = F.upper(spaced(raw))
        elif f.kind == "slug":
            value = spaced(F.coalesce(raw, *[F.nullif(T.slug(out[o], 1 << 20), F.lit("")) for o in f.of]))
        elif f.kind == "enum":
            value = F.when(raw.isin(*f.values), raw).otherwise(f.default)
        elif f.kind == "clamp":
            value = F.coalesce(T.clamp(_number(F.coalesce(raw, F.lit(f.default))), float(f.low), float(f.high)), F.lit(float(f.low)))
        elif f.kind == "number":
            value = _number(raw)
        elif f.kind in ("count", "least"):
            number = _number(raw)
            value = F.coalesce(F.greatest(F.lit(0.0), number) if f.kind == "count" else F.when(number >= f.low, number), F.lit(float(f.default)))
        elif f.kind == "time":
            fallback = F.lit(None).cast("string") if f.default is None else out[f.default[1:]] if f.default.startswith("=") else F.lit(f.default)
            value = F.coalesce(F.date_format(parsed_time(raw), ISO), fallback)
        elif f.kind == "unless_false":
            value = F.coalesce(F.lower(raw) != "false", F.lit(True))
        elif f.kind == "flag":
            value = F.coalesce(F.lower(raw) == "true", F.lit(False))
        elif f.kind == "json":
            value = F.when(F.try_parse_json(raw).isNotNull(), raw).otherwise(f.default)
        elif f.kind == "joined":
            made = F.array_join(F.filter(F.array(*[F.lower(part(o)) for o in f.of]), lambda x: x != ""), "-")
            value = spaced(F.coalesce(raw, made))
        elif f.kind == "hashed":
            made = F.concat(F.lit(f.default), T.stable_hash(F.concat_ws(":", *map(part, f.of)), 16))
            value = spaced(F.coalesce(raw, made))
        else:
            fallback = out[f.default[1:]] if f.default and f.default.startswith("=") else F.lit(f.default)
            value = spaced(F.coalesce(raw, fallback))
        out[f.name] = value
    return df.select(*[c.alias(n) for n, c in out.items()])


def failures_of(df: DataFrame, schema: tuple[Field, ...]) -> Column:
    """What a record breaks, in the order of its fields: required, invalid (of a list), out of bounds (a number that is none breaks
    no bound)."""
    checks = []
    for f in schema:
        raw = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast("string")
        if f.required:
            checks.append(F.when(spaced(raw.cast("string")) == "", f"{f.name} is required"))
        if f.kind == "enum":
            checks.append(F.when(~F.coalesce(raw.isin(*f.values), F.lit(False)), f"{f.name} is invalid"))
        if f.low is not None:
            number = _number(raw.cast("string"))
            broken = (number < f.low) | (number > f.high) if f.high is not None else number < f.low
            checks.append(F.when(broken, f"{f.name} is out of bounds"))
    return F.array_compact(F.array(*checks))


def named(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order; a rule that is null does not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
