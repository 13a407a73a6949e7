"""Cities that a signal may be about: evidence of six kinds, each found by a join on its own key, folded in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators import local
from tidewire.operators.editorial import evidence_score
from tidewire.operators.lookup import phrases_in
from tidewire.operators.shuffles import join_unique, saved

#: Points of evidence, boosts by kind of coverage, and the least score that counts.
POINTS = {"named": 82, "county": 66, "neighbourhood": 72, "official_source": 78, "other_source": 58, "existing": 60}
COVERAGE_BOOSTS = {"primary": 16, "nearby": 9, "statewide": 7, "regional": 6}
OTHER_COVERAGE, STATE_BOOST, LEAST = 6, 7, 35


def said(text: Column) -> Column:
    """Lower-cased words between blanks; plus, dot and hyphen are part of words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+.-]+", " ")), F.lit(" "))


def _phrase(name: Column) -> Column:
    return F.trim(said(name))


def city_candidates(signals: DataFrame, cities: DataFrame, coverage: DataFrame, sources: DataFrame) -> DataFrame:
    """signals (signal_id, text, source_id, lat, lon, existing array<struct<city_id, confidence>>), cities (city_id, name,
    state_abbr, state_name, county_name, neighbourhoods, lat, lon), coverage (ord, source_id, city_id, coverage_type, confidence),
    sources (source_id, source_type, text) -> (signal_id, city_id, confidence), 35 or more.

    In order: what the signal had; its source's coverage, in the order of the rows, each with a boost for official sources; the
    city's name, with boosts for its state; its county; its neighbourhoods; its name in the source's own text; its distance. A
    proof raises the confidence to its points, a boost adds to what is there, and nothing goes beyond 100."""
    rows = saved(signals.withColumn("said", said(F.col("text"))), "candidate-signals")
    known = saved(cities, "candidate-cities")
    texts = rows.select(F.col("signal_id").alias("id"), "said")
    names = known.select("city_id", _phrase(F.col("name")).alias("phrase"), _phrase(F.col("state_abbr")).alias("abbr"), _phrase(F.col("state_name")).alias("state"))
    counties = known.select("city_id", _phrase(F.col("county_name")).alias("phrase"))
    areas = known.select("city_id", F.explode("neighbourhoods").alias("area")).select("city_id", _phrase(F.col("area")).alias("phrase"))
    found = saved(phrases_in(texts, names.select("phrase").union(counties.select("phrase")).union(areas.select("phrase")).distinct()), "candidate-phrases")
    by = lambda phrases: found.join(phrases, "phrase").withColumnRenamed("id", "signal_id")
    proof = lambda df, at, points, nr=F.lit(0): df.select("signal_id", "city_id", F.struct(F.lit(at).alias("at"), nr.cast("long").alias("nr"), F.lit(0).alias("part")).alias("ord"), F.lit("max").alias("kind"), points.cast("double").alias("points"))
    boost = lambda df, at, points, part, nr=F.lit(0): df.select("signal_id", "city_id", F.struct(F.lit(at).alias("at"), nr.cast("long").alias("nr"), F.lit(part).alias("part")).alias("ord"), F.lit("boost").alias("kind"), points.cast("double").alias("points"))

    had = rows.select("signal_id", F.posexplode("existing").alias("nr", "x")).select("signal_id", "nr", "x.city_id", F.coalesce("x.confidence", F.lit(POINTS["existing"])).alias("points")).join(known.select("city_id"), "city_id", "left_semi")
    kinds = sources.select("source_id", F.coalesce(F.col("source_type"), F.lit("")).alias("source_type"), said(F.col("text")).alias("said"))
    of = F.coalesce(*[F.when(F.col("coverage_type") == k, v) for k, v in COVERAGE_BOOSTS.items()], F.lit(OTHER_COVERAGE))
    # coverage and the cities that a source names are gathered by source: a signal meets one row
    covered = coverage.join(known.select("city_id"), "city_id", "left_semi").join(kinds.select("source_id", "source_type"), "source_id", "left")
    per_source = covered.groupBy("source_id").agg(F.collect_list(F.struct("ord", "city_id", F.coalesce("confidence", F.lit(0)).alias("points"), F.when(F.col("source_type").isin("official_city", "official_county"), of).alias("boost"))).alias("rows"))
    own = join_unique(rows.select("signal_id", "source_id"), per_source, "source_id").select("signal_id", F.explode("rows").alias("c")).select("signal_id", "c.*")
    mentions = phrases_in(kinds.select(F.col("source_id").alias("id"), "said"), names.select("phrase").distinct()).join(names, "phrase").join(kinds.select(F.col("source_id").alias("id"), "source_type"), "id")
    per_text = mentions.groupBy(F.col("id").alias("source_id")).agg(F.collect_list(F.struct("city_id", F.when(F.startswith("source_type", F.lit("official")), POINTS["official_source"]).otherwise(POINTS["other_source"]).alias("points"))).alias("rows"))
    by_source = join_unique(rows.select("signal_id", "source_id"), per_text, "source_id").select("signal_id", F.explode("rows").alias("c")).select("signal_id", "c.*")
    named = by(names).join(rows.select("signal_id", "said"), "signal_id")
    tells = lambda c: (F.col(c) != "") & F.contains("said", F.concat(F.lit(" "), c, F.lit(" ")))
    places = known.where("lat is not null and lon is not null").select(F.col("city_id").alias("place_id"), "lat", "lon")
    near = local.in_bands(rows.where("lat is not null and lon is not null").select(F.col("signal_id").alias("point_id"), "lat", "lon"), places)
    near = near.select(F.col("point_id").alias("signal_id"), F.col("place_id").alias("city_id"), "score")

    evidence = [
        proof(had.where("points > 0"), 0, F.col("points"), F.col("nr")), proof(own.where("points > 0"), 1, F.col("points"), F.col("ord")), boost(own.where("boost is not null"), 1, F.col("boost"), 1, F.col("ord")),
        proof(named, 2, F.lit(POINTS["named"])), boost(named.where(tells("abbr")), 2, F.lit(STATE_BOOST), 1), boost(named.where(tells("state")), 2, F.lit(STATE_BOOST), 2),
        proof(by(counties), 3, F.lit(POINTS["county"])), proof(by(areas).distinct(), 4, F.lit(POINTS["neighbourhood"])), proof(by_source, 5, F.col("points")), proof(near, 6, F.col("score")),
    ]
    scored = evidence_score(reduce(DataFrame.unionByName, evidence), ["signal_id", "city_id"])
    return scored.where(F.col("score") >= LEAST).withColumnRenamed("score", "confidence")
