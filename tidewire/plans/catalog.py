"""All registered queries over the given tables, and their DuckDB SQL."""

from tidewire.plans import cards, checks, desk, editorial, feed, intake, local, media, readers, records, rules, signals, stories, streams, texts, writing

PARTS = (feed, local, stories, texts, readers, streams, editorial, desk, signals, rules, media, cards, writing, intake, checks, records)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
