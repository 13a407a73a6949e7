"""Records by schema: every entity from odd input, its failures, and what normalising mends."""

import hashlib

import pytest

from tidewire.operators import records

HASH = lambda x: hashlib.sha1(x.encode()).hexdigest()[:16]
#: entity -> (row as it lands, what the record holds of it).
LANDED = {
    "city": ({"city": "  San  José ", "state": "ca", "stateName": "California", "coverageScore": "140", "lat": "x", "lon": "-121.9"}, {"id": "san-jose-ca", "name": "San José", "slug": "san-jose", "state_abbr": "CA", "state_slug": "california", "coverage_score": 100.0, "latitude": None, "longitude": -121.9, "index_status": "watch", "created_at": records.MADE, "last_fresh_story_at": None}),
    "local_source": ({"name": "City Desk", "source_type": "newspaper", "trust_level": "official", "robotsCheckedAt": "2024-01-02T03:04:05Z"}, {"id": "city-desk", "source_type": "other", "trust_level": "official", "crawl_status": "pending_review", "robots_checked_at": "2024-01-02T03:04:05.000Z"}),
    "source_feed": ({"sourceId": "desk", "feed_type": "carrier", "active": "false", "fetchFrequencyMinutes": "0.5", "url": "u"}, {"id": "desk-rss", "feed_type": "rss", "active": False, "fetch_frequency_minutes": 15.0}),
    "source_city_coverage": ({"sourceId": "a", "cityId": "b", "confidence": "-3", "coverage_type": "nearby"}, {"source_id": "a", "city_id": "b", "confidence": 0.0, "coverage_type": "nearby"}),
    "source_fetch_run": ({"sourceFeedId": "f", "itemsFound": "-2", "items_new": "7", "statusCode": "200", "status": "odd"}, {"id": "fetch-run-" + HASH(f"f:{records.MADE}"), "items_found": 0.0, "items_new": 7.0, "status_code": 200.0, "status": "skipped"}),
    "input_signal": ({"url": "https://a/b", "title": "T", "entities": '{"a": 1}', "cityCandidates": "not json", "discoveredAt": "2024-05-01", "language": ""}, {"id": "signal-" + HASH("https://a/b:T"), "original_url": "https://a/b", "entities_json": '{"a": 1}', "city_candidates_json": "[]", "created_at": "2024-05-01T00:00:00.000Z", "language": "en"}),
    "story_cluster": ({"title": "Big Fire!", "cityId": "c", "firstSeenAt": "2024-05-01T10:00:00Z", "thumbnailUrl": "t", "urgency": "low"}, {"id": "cluster-" + HASH("c:big-fire"), "slug": "big-fire", "updated_at": "2024-05-01T10:00:00.000Z", "image_url": "t", "urgency": "low", "confidence_label": "developing", "public_status": "live", "index_status": "noindex"}),
    "story_cluster_signal": ({"storyClusterId": "c", "inputSignalId": "s", "sourceId": "o", "isPrimary": "true"}, {"is_primary": True, "added_at": records.MADE}),
    "story_cluster_event": ({"storyClusterId": "c", "eventTime": "soon", "event_type": "expired"}, {"id": "cluster-event-" + HASH("c:soon:expired"), "event_time": records.MADE, "event_type": "expired"}),
    "city_topic_coverage": ({"cityId": "c", "topic": "", "freshStoryCount24h": "3.0"}, {"id": "city-topic-" + HASH("c:"), "topic": "general_local", "fresh_story_count_24h": 3.0}),
    "user_submitted_source": ({"submittedUrl": "u", "status": "approved"}, {"id": "submitted-source-" + HASH("u"), "status": "approved"}),
    "public_signal": ({"query": "q", "sourceUrl": "https://x"}, {"topic": "q", "sourceType": "manual_public_signal"}),
}


@pytest.mark.parametrize("kind", sorted(records.SCHEMAS))
def test_every_entity_is_normalised_and_whole(spark, kind):
    row, want = LANDED[kind]
    df = spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in row))
    got = records.normalised(df, records.SCHEMAS[kind])
    assert got.columns == [f.name for f in records.SCHEMAS[kind]]
    found = got.first().asDict()
    assert {k: found[k] for k in want} == want
    # a row with nothing in it gives a record of defaults, which lacks just what is required
    empty = records.normalised(spark.createDataFrame([(None,)], "nothing string"), records.SCHEMAS[kind])
    missing = {f.name for f in records.SCHEMAS[kind] if f.required and f.kind not in ("hashed", "joined") and not f.default}
    named = {x.removesuffix(" is required") for x in empty.select(records.failures_of(empty, records.SCHEMAS[kind])).first()[0]}
    assert missing <= named and all(n in {f.name for f in records.SCHEMAS[kind] if f.required} for n in named)


def test_failures_name_what_is_broken(spark):
    df = spark.createDataFrame([("c", "", "s", "odd", 120.0), ("c", "n", "s", "index", None)], "id string, name string, slug string, index_status string, coverage_score double")
    got = [r[0] for r in df.select(records.failures_of(df, records.SCHEMAS["city"])).collect()]
    assert got[0] == ["name is required", "state_abbr is required", "state_name is required", "state_slug is required", "coverage_score is out of bounds", "index_status is invalid"]
    assert got[1] == ["state_abbr is required", "state_name is required", "state_slug is required"]
