"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the pattern of sources they belong to (an array; a plain source is a pattern of one). The flow
network has one node a pattern and one a source: a pattern offers its words once at cost 0, a second time at cost 1, a
third at cost 2 (convex repetition costs), and every source draws its quota. Only pattern totals reach the driver; their
number is checked against ``MAX_PATTERNS``.

Selection is seeded: whole rounds take every document of a pattern; for the fractional round documents are met in the order of a
keyed hash, and one is taken while it fits into what is left. The first that does not fit ends a stretch; behind it only documents
that fit go on, for ``STRETCHES`` stretches, and one last document is taken if it brings the pattern nearer to its words, be it over them. A stretch is a few numbers a pattern (from where, to where, greatest size), so taking is a test of
each row by itself and no text is moved.

The running totals are distributed: hash order is cut into ``BUCKETS`` ranges, totals of ranges are accumulated, and a
window runs inside the one range of a pattern that holds the end of a stretch, so a hot source is spread over all ranges.

Null text has size 0; a null source, an empty array and an array of nulls are one source of their own, last in order. Documents of size 0 take
0. Rows that repeat an id are taken or left together where their sizes are equal. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, word_count

MAX_REPEATS = 3
MAX_PATTERNS = 1_000_000
BUCKETS = 4096
STRETCHES = 5
BROADCAST_PATTERNS = 50_000


def source_targets(sizes: dict[str | None, int], max_repeats: int = MAX_REPEATS, weights: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Quotas: all words shared by weight; a source stops at ``max_repeats`` times its size and the excess is reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, targets = float(sum(sizes.values())), [s for s in order], {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > max_repeats * sizes[s]]
        if not full:
            return targets | {s: per * weight[s] for s in open_}
        for s in full:
            targets[s] = float(max_repeats * sizes[s])
            left -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return targets


def route(patterns: dict[tuple, int], targets: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple[tuple, object], int]:
    """Min-cost flow from patterns (words, convex repetition costs) to source quotas: words for each (pattern, source).

    Successive cheapest augmenting paths over (pattern -> source) edges with residual rerouting between sources.
    """
    flow: dict[tuple[tuple, object], int] = {}
    used = dict.fromkeys(patterns, 0)
    need = {s: round(t) for s, t in targets.items()}
    members: dict[object, list[tuple]] = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)
    # lends[s][other]: the patterns that s shares with another source which draws from them, so that it may draw elsewhere instead
    lends: dict[object, dict[object, dict[tuple, None]]] = {s: {} for s in need}

    def change(p: tuple, s: object, by: int) -> None:
        before = flow.get((p, s), 0)
        flow[p, s] = before + by
        if (before > 0) != (before + by > 0):
            for other in p:
                if other != s:
                    held = lends[other].setdefault(s, {})
                    if by > 0:
                        held[p] = None
                    else:
                        held.pop(p, None)

    for level in range(max_repeats):  # all words at one repetition cost before any at the next: convex costs
        cap = {p: (level + 1) * size for p, size in patterns.items()}
        first = dict.fromkeys(need, 0)  # of each source, its first pattern that may have room: none gets room back within a level

        def room(s: object, cap=cap, first=first) -> tuple | None:
            own = members.get(s, ())
            while first[s] < len(own) and used[own[first[s]]] >= cap[own[first[s]]]:
                first[s] += 1
            return own[first[s]] if first[s] < len(own) else None

        for s in sorted(need, key=lambda x: (x is None, str(x))):
            while need[s] > 0:
                # the shortest way from a pattern with room to source s, over sources that draw elsewhere
                ways, back, found = deque([s]), {s: None}, None
                while ways:
                    at = ways.popleft()
                    if (p := room(at)) is not None:
                        found = (p, at)
                        break
                    for other, shared in lends[at].items():
                        if shared and other not in back:
                            back[other] = (next(iter(shared)), at)
                            ways.append(other)
                if found is None:
                    break
                p, at = found
                path, node, push = [], at, min(need[s], cap[p] - used[p])
                while node != s:
                    via, nxt = back[node]
                    path.append((via, node, nxt))
                    push = min(push, flow[via, node])
                    node = nxt
                change(p, at, push)
                used[p] += push
                for via, donor, taker in path:
                    change(via, donor, -push)
                    change(via, taker, push)
                need[s] -= push
    return {k: n for k, n in flow.items() if n}


def _taken(at, size):
    """Whether one of the stretches takes a document, or it is the one that brings its pattern nearest."""
    by_stretch = F.exists("stretches", lambda s: (s["after"].isNull() | (at > s["after"])) & (s["until"].isNull() | (at < s["until"])) & (size <= s["most"]))
    return F.coalesce(by_stretch, F.lit(False))


def _nearest(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """key, extra: of each pattern the untaken document that brings its words nearest to what is wanted, if one does; it may overshoot by less than is missing."""
    quota = quota.filter("left > 0").select("key", "left", "stretches")
    flagged = rows.join(F.broadcast(quota) if quota.count() <= BROADCAST_PATTERNS else quota, "key").filter("size > 0").withColumn("in", _taken(F.col("at"), F.col("size")))
    rest = flagged.groupBy("key").agg((F.first("left") - F.coalesce(F.sum(F.when(F.col("in"), F.col("size"))), F.lit(0))).alias("rest")).filter("rest > 0")
    rest = materialize(rest, "mix-rest")
    fits = flagged.filter(~F.col("in")).join(F.broadcast(rest) if rest.count() <= BROADCAST_PATTERNS else rest, "key").filter("size < 2 * rest")
    return fits.groupBy("key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), F.col("at"))).alias("m")).select("key", F.col("m.at").alias("extra"))


def _stretches(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """key, stretches (after, until, most): the documents of a pattern that its fractional round takes.

    ``rows``: key, at (the place in hash order), size. ``rest``: key, left, the words that are wanted.
    """
    place = "struct<h:bigint,k:bigint,size:bigint>"
    state = materialize(rest.select("key", "left", F.lit(None).cast(place).alias("after")), "mix-rest")
    out = None
    for number in range(STRETCHES):
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("left")) & (F.col("after").isNull() | (F.col("at") > F.col("after")))
        open_ = rows.join(F.broadcast(state) if state.count() <= BROADCAST_PATTERNS else state, "key").filter(fits)
        open_ = open_.withColumn("bucket", F.shiftright(F.col("at.h"), 52))  # BUCKETS ranges of the hash, in order
        before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        ranges = open_.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        end = ranges.filter(F.col("before") + F.col("words") > F.col("left")).groupBy("key").agg(F.min(F.struct("bucket", "before")).alias("end"))
        end = end.select("key", "end.bucket", "end.before")
        within = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        inside = open_.join(end, ["key", "bucket"]).withColumn("seen", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        edge = inside.filter(F.col("seen") + F.col("size") > F.col("left")).groupBy("key").agg(F.min(F.struct("at", "seen")).alias("edge"))
        # rows that tie with the edge stay out with it
        taken = inside.join(edge, "key").filter(F.col("at") < F.col("edge.at")).groupBy("key").agg(F.max(F.col("seen") + F.col("size")).alias("taken"))
        edge = edge.join(taken, "key", "left").join(end, "key").select("key", F.col("edge.at").alias("until"), F.coalesce("taken", "before").alias("taken"))
        done = materialize(state.join(edge, "key", "left"), "mix-rest")  # a row a pattern, so that plans do not pile up on the driver
        stretch = done.select("key", F.lit(number).alias("number"), "after", "until", F.col("left").alias("most"))
        out = stretch if out is None else out.unionAll(stretch)
        state = done.filter("until IS NOT NULL").select("key", (F.col("left") - F.col("taken")).alias("left"), F.col("until").alias("after"))
    return out.groupBy("key").agg(F.collect_list(F.struct("after", "until", "most")).alias("stretches"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies (and the ``keep`` columns of the input).

    ``source_col`` may be a string or an array of strings (overlapping sources).
    """
    array = dict(docs.dtypes)[source_col].startswith("array")
    alone = F.array(F.lit(None).cast("string"))
    pattern = F.array_sort(F.array_distinct(F.col(source_col).cast("array<string>"))) if array else F.array(F.col(source_col).cast("string"))
    pattern = F.filter(pattern, lambda x: x.isNotNull()) if array else pattern
    pattern = F.when(F.coalesce(F.size(pattern), F.lit(0)) > 0, pattern).otherwise(alone)
    rows = docs.select(F.col(id_col).alias("doc_id"), pattern.alias("__pattern"), word_count(text_col).alias("size"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    place = F.struct(F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"), F.xxhash64(F.lit(~seed), F.col("doc_id")).alias("k"), F.col("size"))
    rows = rows.withColumns({"key": F.to_json(F.struct("__pattern")), "at": place})
    sizes_only = materialize(rows.select("key", "__pattern", "at", "size"), "mix-sizes")
    totals = sizes_only.groupBy("__pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["__pattern"]): r["words"] for r in totals}
    sizes: dict[str | None, int] = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes, max_repeats, weights)
    if any(len(p) > 1 for p in patterns):  # shared words count once in the total that is handed out
        scale = sum(patterns.values()) / max(1.0, sum(targets.values()))
        targets = {s: t * min(1.0, scale) for s, t in targets.items()}
    drawn: dict[tuple, int] = dict.fromkeys(patterns, 0)
    for (p, _), words in route(patterns, targets, max_repeats).items():
        drawn[p] += words
    plan = [
        (list(p), float(sum(targets[s] for s in p)), int(sum(sizes[s] for s in p)), drawn[p] // words if words else 0, drawn[p] % words if words else 0)
        for p, words in patterns.items()
    ]
    quota = docs.sparkSession.createDataFrame(plan, "__pattern array<string>, target double, source_size long, rounds long, left long")
    quota = quota.withColumn("key", F.to_json(F.struct("__pattern"))).drop("__pattern")
    sized = sizes_only.select("key", "at", "size")
    quota = materialize(quota.join(_stretches(sized, quota.filter(F.col("left") > 0).select("key", "left")), "key", "left"), "mix-quota")
    quota = materialize(quota.join(_nearest(sized, quota), "key", "left").drop("left"), "mix-quota")
    release(sizes_only)
    out = rows.join(F.broadcast(quota) if len(plan) <= BROADCAST_PATTERNS else quota, "key")
    at, size = F.col("at"), F.col("size")
    taken = _taken(at, size) | F.coalesce(at == F.col("extra"), F.lit(False))
    copies = F.when(size > 0, F.col("rounds") + taken.cast("long")).otherwise(F.lit(0)).cast("long")
    own = ("size", "source_size", "target", "taken", "copies", "doc_id")
    return out.select("doc_id", size, "source_size", "target", (size * copies).alias("taken"), copies.alias("copies"), *[F.col(f"__keep_{c}").alias(f"{c}_in" if c in own else c) for c in keep])
