"""Titles and texts that are alike: candidate pairs by shared tokens, copy risk, stuffing, repetition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text as T
from tidewire.operators.shuffles import beside, join_unique, saved


def title_classes(items: DataFrame, hours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """items (id, title_tokens) -> (id, class) and (class, k): items of three different tokens or more, equal sets of tokens
    being one class, named after its least id. With `hours`, items have published_at; each stretch of so many hours, its
    number in classes as `bucket`, has classes of its own. Both are saved tables."""
    bucket = F.lit(0) if hours is None else F.floor(F.unix_seconds("published_at") / (hours * 3600))
    spot = F.struct(F.array_sort(F.array_distinct("title_tokens")).alias("k"), bucket.cast("long").alias("bucket"))
    named = saved(items.select("id", spot.alias("spot")).where(F.size("spot.k") >= 3), "title-sets")
    kinds = saved(named.groupBy("spot").agg(F.min("id").alias("class"), F.count("*").alias("n")), "title-kinds")
    members = join_unique(named, kinds.select("spot", "class"), "spot", counts=kinds.select("spot", "n")).select("id", "class")
    return saved(members, "title-members"), kinds.select("class", "spot.k", *([] if hours is None else ["spot.bucket"]))


def needed(n: Column) -> Column:
    """How many tokens linked titles share at least, the shorter one having n: 3 of 3, 4 of up to 6, else 5."""
    return F.when(n <= 3, 3).when(n <= 6, 4).otherwise(5)


def title_links(classes: DataFrame, cell: int = 8000) -> DataFrame:
    """classes (class, k) -> (a, b, shared, score), a < b once: 5 shared tokens, or 4 at containment 0.62, or 3 at score 0.72.
    Classes with a `bucket` are linked within one and to the neighbouring ones only.

    Linked classes share as many tokens as the shorter one needs, so they share one of each one's tokens but its most frequent
    ones, one less than that: by those, rarest first, they meet, longer ones only where they are sought with that need. A pair
    counts where its rarest shared token is. Tokens are compared by numbers. A token of many classes is dealt to cells of
    `cell` by `cell`."""
    timed = "bucket" in classes.columns
    placed = classes.select("class", "k", (F.col("bucket") if timed else F.lit(0)).alias("bucket"))
    frequency = saved(placed.select(F.explode("k").alias("token")).groupBy("token").agg(F.count("*").alias("df")).withColumn("number", F.monotonically_increasing_id()), "title-tokens")
    each = join_unique(placed.select("class", "bucket", F.explode("k").alias("token")), frequency, "token", counts=frequency.select("token", F.col("df").alias("n")))
    ranked = each.groupBy("class", "bucket").agg(F.array_sort(F.collect_list(F.struct("df", "number"))).alias("by_df"))  # a dozen tokens
    rows = saved(ranked.withColumns({"k": F.transform("by_df", lambda x: x["number"]), "need": needed(F.size("by_df"))}), "title-ranked")
    sought = lambda need: F.explode(F.filter(F.slice("by_df", 1, F.size("by_df") - need + 1), lambda x: x["df"] > 1))
    parts = F.ceil(F.col("x.df") / cell)
    own = F.pmod(F.xxhash64("class"), parts)
    every = F.sequence(F.lit(0).cast("long"), parts - 1)
    side = lambda s: [F.col("class").alias(s), F.col("k").alias(f"k{s}"), F.col("need").alias(f"n{s}"), F.col("x.number").alias("token")]
    asks = rows.select("class", "k", "need", "bucket", sought(F.col("need")).alias("x"))
    near = F.explode(F.array(*[F.col("bucket") + d for d in ((-1, 0, 1) if timed else (0,))])).alias("bucket")
    left = asks.select("*", own.alias("row")).select(*side("a"), F.col("need").alias("need"), "row", "bucket", F.explode(every).alias("column"))
    left = left.select(*[c for c in left.columns if c != "bucket"], near)
    answers = rows.withColumn("as", F.explode(F.sequence(F.lit(3), "need"))).select("class", "k", "need", "as", "bucket", sought(F.col("as")).alias("x"))
    right = answers.select("*", own.alias("column")).select(*side("b"), F.col("as").alias("need"), "column", "bucket", F.explode(every).alias("row"))
    met = left.join(right.hint("merge"), ["need", "token", "bucket", "row", "column"]).where((F.col("nb") > F.col("na")) | (F.col("a") < F.col("b")))
    both = F.array_intersect("ka", "kb")  # in the order of ka: rarest first
    found = met.select("a", "b", F.size("ka").alias("na"), F.size("kb").alias("nb"), "token", F.struct(F.size(both).alias("shared"), F.get(both, F.lit(0)).alias("first")).alias("both"))
    pairs = found.where((F.col("both.first") == F.col("token")) & (F.col("both.shared") >= 3)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb", "both.shared")
    contained, union = F.col("shared") / F.least("na", "nb"), F.col("na") + F.col("nb") - F.col("shared")
    j = F.col("shared") / union
    scored = pairs.select("a", "b", "shared", contained.alias("containment"), F.greatest(j, 0.65 * contained + 0.35 * j).alias("score"))
    return scored.where((F.col("shared") >= 5) | ((F.col("shared") >= 4) & (F.col("containment") >= 0.62)) | (F.col("score") >= 0.72)).select("a", "b", "shared", "score")


class AlikeTitles:
    """Titles by group (a city and topic), found by the tokens that alike ones must share."""

    def __init__(self, alike: Callable[[int, int, int], bool]):
        self.alike = alike  # whether titles of n and m tokens that share k are alike; then they are if they share more
        self.titles: dict[int, frozenset[str]] = {}
        self.sizes: dict[tuple, dict[str, dict[int, list[int]]]] = {}  # group -> token -> size of title -> those that have it
        self.needs: dict[int, dict[int, int]] = {}

    def need(self, n: int, m: int) -> int:
        """How many tokens alike titles of n and m tokens share at least; one more than there are if none are alike."""
        known = self.needs.setdefault(n, {})
        if m not in known:
            known[m] = next((k for k in range(1, min(n, m) + 1) if self.alike(k, n, m)), min(n, m) + 1)
        return known[m]

    def add(self, group: tuple, number: int, tokens: frozenset[str]) -> None:
        self.titles[number] = tokens
        if tokens:
            at, m = self.sizes.setdefault(group, {}), len(tokens)
            for t in tokens:
                at.setdefault(t, {}).setdefault(m, []).append(number)

    def remove(self, group: tuple, number: int) -> None:
        """The oldest of a list is found at once, and mostly it is the one that goes."""
        tokens = self.titles.pop(number)
        if tokens:
            at, m = self.sizes[group], len(tokens)
            for t in tokens:
                (having := at[t][m]).remove(number)
                if not having:
                    del at[t][m]
                    if not at[t]:
                        del at[t]
            if not at:
                del self.sizes[group]

    def met(self, group: tuple, tokens: set[str]) -> Iterator[tuple[int, Iterable[int]]]:
        """By size, the titles of the group that can be alike, and how many tokens they have to share. One of m tokens lacks at
        most `spare` of those that titles of its size have, so it has two of any `spare` and two: those of the fewest titles."""
        at, by_size = self.sizes.get(group), {}
        if not at or not tokens:
            return
        for t in tokens:
            if t in at:
                for m, having in at[t].items():
                    if m in by_size:
                        by_size[m].append(having)
                    else:
                        by_size[m] = [having]
        n = len(tokens)
        known = self.needs.setdefault(n, {})
        for m, lists in by_size.items():
            need = known.get(m) or self.need(n, m)
            spare = len(lists) - need
            if spare < 0:
                continue
            lists.sort(key=len)
            if need == 1:
                yield need, set().union(*lists)
                continue
            once, twice = set(lists[0]), set()
            for having in lists[1 : spare + 2]:
                twice.update(once.intersection(having))
                once.update(having)
            if twice:
                yield need, twice

    def near(self, group: tuple, tokens: set[str]) -> set[int]:
        """The titles of the group that are alike."""
        titles = self.titles
        return {x for need, met in self.met(group, tokens) for x in met if len(tokens & titles[x]) >= need}


def link_score(shared: int, n: int, m: int) -> float:
    """The score of two titles that may be in one cluster; 0 for others."""
    union = n + m - shared
    contained = shared / min(n, m)
    score = max(shared / union, 0.65 * contained + 0.35 * shared / union)
    return score if shared >= 5 or (shared >= 4 and contained >= 0.62) or (shared >= 3 and score >= 0.72) else 0.0


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def title_forest(classes: DataFrame, cell: int = 50_000) -> DataFrame:
    """classes (class, k, bucket) -> (a, b): as few links as connect what title_links() connects, so less than one for each
    row read, however many are alike. A bucket's classes are dealt to cells of about `cell`. A task holds one cell; the rest of
    the bucket and the next bucket stream by. What is connected there already is not linked again."""
    sizes = beside(classes.groupBy("bucket").agg(F.ceil(F.count("*") / cell).alias("parts")))
    own = F.pmod(F.xxhash64("class"), F.col("parts"))
    placed = classes.join(sizes, "bucket").select("class", "k", "bucket", own.alias("cell"))
    before = sizes.select((F.col("bucket") + 1).alias("bucket"), (F.col("parts") - 1).alias("last"))
    every = lambda last: F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)))
    rows = placed.select("bucket", "cell", F.lit(0).alias("visits"), "class", "k")
    rows = rows.union(placed.select("bucket", every(F.col("cell") - 1).alias("cell"), F.lit(1), "class", "k"))
    rows = rows.union(placed.join(before, "bucket").select(F.col("bucket") - 1, every(F.col("last")).alias("cell"), F.lit(1), "class", "k"))
    width = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, "bucket", "cell").sortWithinPartitions("bucket", "cell", "visits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = titles = None
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root[x]) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            links = []
            buckets, cells, visits, numbers, sets = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "cell", "visits", "class", "k"))
            for bucket, cell, visiting, number, k in zip(buckets, cells, visits, numbers, sets, strict=True):
                if (bucket, cell) != home:
                    home, titles, root = (bucket, cell), AlikeTitles(lambda k, n, m: link_score(k, n, m) > 0), {}
                tokens, mine = frozenset(k), None
                for need, met in titles.met((), tokens):
                    for other in met:
                        if (mine is None or root[other] != mine and top(other) != mine) and len(tokens & titles.titles[other]) >= need:
                            links.append((other, number))
                            theirs = top(other)
                            if mine is None:
                                mine = theirs
                            else:
                                root[theirs] = mine
                if not visiting:
                    root[number] = number if mine is None else mine
                    titles.add((), number, tokens)
            yield pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=LINK)

    return dealt.mapInArrow(run, "a long, b long")


def title_pairs(items: DataFrame, hours: int = 30) -> DataFrame:
    """(a, b, shared, score), a < b: items of one class or of linked ones, within `hours` of each other. This has a row for
    each pair; who needs groups takes classes and links."""
    members, classes = title_classes(items, hours)
    width = hours * 3600
    placed = saved(members.join(items.select("id", F.unix_micros("published_at").alias("us")), "id"), "title-placed")
    equal = classes.select(F.col("class").alias("a"), F.col("class").alias("b"), F.size("k").alias("shared"), F.lit(1.0).alias("score"))
    links = title_links(classes).union(equal)
    left = placed.select(F.col("class").alias("a"), F.col("id").alias("ia"), F.col("us").alias("ua"))
    right = placed.select(F.col("class").alias("b"), F.col("id").alias("ib"), F.col("us").alias("ub"))
    met = left.join(links, "a").join(right, "b").where((F.abs(F.col("ua") - F.col("ub")) <= width * 1000000) & ((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib"))))
    return met.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "shared", "score")


def sharing(items: DataFrame, least: Column, hours: int, group: str = "category") -> DataFrame:
    """items (id, published_at, k, group) -> (id, other): items of the same group within `hours` that share `least` (a column
    of items, 1 or more) of the tokens k of id, or more.

    An item asks by all but its `least` - 1 most frequent tokens, of which partners share one; a token answers within its
    group and the neighbouring time buckets only."""
    width = hours * 3600
    asks = items.withColumns({"least": least, "bucket": F.floor(F.unix_seconds("published_at") / width)})
    frequency = items.select(group, F.explode("k").alias("token")).groupBy(group, "token").agg(F.count("*").alias("df")).where("df > 1")
    each = asks.select("id", group, "least", F.size("k").alias("n"), F.explode("k").alias("token")).join(frequency, [group, "token"], "left")
    ranked = each.groupBy("id", "least", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("by_df"))
    rare = ranked.select("id", F.explode(F.slice("by_df", 1, F.greatest(F.lit(1), F.col("n") - F.col("least") + 1))).alias("x")).where("x.df > 1").select("id", "x.token")
    left = rare.join(asks, "id").select("id", F.col("published_at").alias("ta"), F.col("k").alias("ka"), "least", group, "token", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = asks.select(F.col("id").alias("other"), F.col("published_at").alias("tb"), F.col("k").alias("kb"), group, "bucket", F.explode("k").alias("token"))
    near = F.abs(F.unix_micros("ta") - F.unix_micros("tb")) <= width * 1000000
    met = left.join(right, [group, "bucket", "token"]).where((F.col("id") != F.col("other")) & near & (F.size(F.array_intersect("ka", "kb")) >= F.col("least")))
    return met.select("id", "other").distinct()


def rare_tokens(items: DataFrame, group: str) -> DataFrame:
    """items (id, k, least, group) -> (id, rare): all tokens of k but the `least` - 1 most frequent ones of the group. Who shares
    `least` tokens with id shares one of these; tokens that no other item has are left out."""
    frequency = items.select(group, F.explode("k").alias("token")).groupBy(group, "token").agg(F.count("*").alias("df")).where("df > 1")
    each = items.select("id", group, "least", F.size("k").alias("n"), F.explode("k").alias("token")).join(frequency, [group, "token"], "left")
    ranked = each.groupBy("id", "least", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("by_df"))
    rare = F.slice("by_df", 1, F.greatest(F.lit(1), F.col("n") - F.col("least") + 1))
    return ranked.select("id", F.transform(F.filter(rare, lambda x: x["df"] > 1), lambda x: x["token"]).alias("rare"))


def sharing_between(asks: DataFrame, items: DataFrame, low: int, high: int, group: str = "category") -> DataFrame:
    """asks (id, us, source, k, least, rare, group) and items (id, us, source, k, group) -> (id, other): other items of the group
    and of other sources that share `least` tokens, from `low` to `high` microseconds (included) after id."""
    width = high - low + 1
    bucket = lambda us: F.floor(us / width).cast("long")
    left = asks.select("id", F.col("us").alias("ua"), F.col("source").alias("sa"), F.col("k").alias("ka"), "least", group, F.explode("rare").alias("token"))
    left = left.withColumn("bucket", F.explode(F.array(bucket(F.col("ua") + low), bucket(F.col("ua") + low) + 1)))
    right = items.select(F.col("id").alias("other"), F.col("us").alias("ub"), F.col("source").alias("sb"), F.col("k").alias("kb"), group, bucket(F.col("us")).alias("bucket"), F.explode("k").alias("token"))
    near = (F.col("ub") - F.col("ua")).between(low, high)
    met = left.join(right, [group, "bucket", "token"]).where((F.col("id") != F.col("other")) & (F.col("sa") != F.col("sb")) & near & (F.size(F.array_intersect("ka", "kb")) >= F.col("least")))
    return met.select("id", "other").distinct()


def stuffing(tokens: Column) -> Column:
    """The greatest count of one token, if it is 4 or more, or 28 % of 6 tokens or more; else 0."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    def step(x: Column, w: Column) -> Column:
        run = F.when(x["last"] == w, x["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(x["most"], run).alias("most"))

    most = F.aggregate(F.array_sort(tokens), start, step, lambda x: x["most"])  # runs of the sorted tokens, in one pass
    return F.when((most >= 4) | ((F.size(tokens) >= 6) & (most >= 0.28 * F.size(tokens))), most).otherwise(0)


def repeats_recent(rows: DataFrame, group: str, order: str, back: int = 12) -> DataFrame:
    """Whether a row's first four words, or one of its four-grams, occur in the `back` rows before it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-back, -1)
    opening = F.array_join(F.slice("tokens", 1, 4), " ")
    marked = rows.withColumns({"opening": opening, "grams": F.array_distinct(T.ngrams(F.col("tokens"), 4))})
    recent = F.array_distinct(F.flatten(F.collect_list("grams").over(w)))
    return marked.withColumns({
        "same_opening": F.array_contains(F.collect_list("opening").over(w), F.col("opening")),
        "shared_grams": F.size(F.array_intersect("grams", recent)),
    })
