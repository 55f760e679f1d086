"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, title-case names and units become typed placeholders, other words are lower-cased and lose their outer
punctuation. Windows of ``window`` canonical words of the documents are hash-joined with the items' windows, so a
re-parameterised question still matches its item. Windows are also joined with names as ordinary words, which finds
copies in another case. Slot consistency tells it from a chance match: a slot value of the
item should meet one value in the document and the other way round; ``slot_agreement`` is the share of slots that do.

A document is contaminated by an item when ``share`` is at least ``min_share``, or a run of matched windows next to
each other holds ``min_run`` words, and
``slot_agreement`` reaches ``min_agreement``. Both are judged for each occurrence of the item in the document
and for all of them together, and the best is reported: a document may hold two variants of one item. An item of 5 to ``window`` - 1 words is one window of all its words. A
shorter one is found where a whole line of a document says its very words (case and outer punctuation aside); its words
alone, inside a longer line, prove nothing. ``share`` is the largest of three: matched windows among all, among those that may match as templates (with
``min_literal`` literal words), and matched words among all words of the item (a changed word takes only itself, not
the eight windows around it). Windows with fewer literal words match by their very words only.

Null texts match nothing; rows without an id are not checked; rows that repeat an id count as one document; extra
columns are ignored; empty tables give no matches.

Item windows, and the ids of candidates, are broadcast only while their counted number is at most ``BROADCAST_WINDOWS``; beyond it Spark
shuffles both sides. Documents that lack too many of an item's longest runs of three or two words to
reach ``min_share`` or ``min_run`` are left out first (an exact bound, see ``_candidates``); windows of the others are probed in the
map stage, and only hits move on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as WindowSpec
from pyspark.sql import functions as F

from .common import SPACE, materialize, parts

WINDOW = 8
MIN_SHARE = 0.5
MIN_RUN = 32
MIN_LITERAL = 4
MIN_AGREEMENT = 0.5
BROADCAST_WINDOWS = 500_000
UNITS = "km kg cm mm mg ml lb lbs oz ft mi mph kmh kph hz khz mhz ghz kb mb gb tb kw kwh mw usd eur gbp inr percent meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms ounce ounces pound pounds liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents degree degrees"
SHORTEST = 5
RUN = 3
LETTERS = r"^[\p{L}\p{M}]+$"
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"


def _lone_marks_out(text: Column) -> Column:
    """Words of punctuation only vanish."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<![^\x20\x09-\x0D])[\p{P}\p{S}]+(?![^\x20\x09-\x0D])", "")


def _bare(text: Column) -> Column:
    """Outer punctuation of all words goes."""
    return F.regexp_replace(text, r"(?<![^\x20\x09-\x0D])[\p{P}\p{S}]+|[\p{P}\p{S}]+(?![^\x20\x09-\x0D])", "")


def _split(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def canonical_words(text: Column, names: bool = True) -> Column:
    """``names``: whether title-case words become placeholders; the places of words are the same with and without."""
    start, rest = r"(?<![^\x20\x09-\x0D])[\p{P}\p{S}]*", r"[^\x20\x09-\x0D]*"
    t = _lone_marks_out(text)
    t = F.regexp_replace(t, start + r"\p{Nd}" + rest, NUMBER)
    if names:
        t = F.regexp_replace(t, start + r"\p{Lu}\p{Ll}" + rest, NAME)
    t = _bare(F.lower(t))
    t = F.regexp_replace(t, r"(?<![^\x20\x09-\x0D])(?:" + UNITS.replace(" ", "|") + r")(?![^\x20\x09-\x0D])", UNIT)
    return _split(t)


def raw_words(text: Column) -> Column:
    """The same words as ``canonical_words``, as they stand but for case and outer punctuation."""
    return _split(_bare(F.lower(_lone_marks_out(text))))


def _windows(words: Column, length: int, named: bool | str) -> Column:
    """Hashes of all windows; their place is their index."""
    n = F.size(words) - (length - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.lit(named), F.slice(words, i, length))))


def _key(piece: Column, length: Column) -> Column:
    """Hash of the longest three neighbouring words of letters only, else of the longest two, or null."""

    def longest(k: int) -> Column:
        at = F.sequence(F.lit(1), length - (k - 1))
        runs = F.transform(at, lambda i: F.struct(F.aggregate(F.slice(piece, i, k), F.lit(0), lambda n, w: n + F.length(w)).alias("n"), F.slice(piece, i, k).alias("words")))
        best = F.array_max(F.filter(runs, lambda r: F.forall(r["words"], lambda w: w.rlike(LETTERS))))["words"]
        return F.when((length >= k) & best.isNotNull(), F.xxhash64(*[best[i] for i in range(k)]))

    return F.coalesce(longest(3), longest(2))


def _candidates(docs: DataFrame, known: DataFrame, min_share: float, min_run: int) -> DataFrame | None:
    """doc_id of all documents that can reach ``min_share`` or ``min_run`` of some item; None when that cannot be told by words.

    The key of a window is its longest three (else two) neighbouring literal words of letters only. A document that matches
    enough windows holds their keys, hence at least as many as the most frequent keys of the item that make up those
    windows. Windows without a key are taken as matched.
    """
    per_key = known.groupBy("item_id", "n_windows", "n_eligible", "length", "word").agg(F.count(F.lit(1)).alias("n"))
    item = WindowSpec.partitionBy("item_id")
    before = F.coalesce(F.sum("n").over(item.orderBy(F.desc("n"), "word").rowsBetween(WindowSpec.unboundedPreceding, -1)), F.lit(0))
    keyless = F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))).over(item), F.lit(0))
    # the fewest windows that can make up the share of eligible windows, the share of words, or the run
    words = F.col("n_windows") + F.col("length") - 1
    fewest = F.least(F.when(F.col("n_eligible") > 0, F.col("n_eligible") * min_share), words * min_share / F.col("length"), F.greatest(F.lit(1), min_run - F.col("length") + 1))
    keys = per_key.withColumn("required", F.ceil(fewest) - keyless)
    named = keys.filter("word IS NOT NULL").withColumn("needed", (before < F.col("required")).cast("int"))
    named = named.withColumn("needed", F.sum("needed").over(item))
    if keys.filter("required <= 0").limit(1).count():
        return None
    side = named.select("word", "item_id", "needed")
    said = docs.select("doc_id", F.split(F.lower(F.col("text")), r"[^\p{L}\p{M}]+").alias("words"))
    pairs = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    threes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    said = said.select("doc_id", F.explode(F.concat(threes, pairs)).alias("word"))
    found = said.join(F.broadcast(side) if side.count() <= BROADCAST_WINDOWS else side, "word")
    found = found.groupBy("doc_id", "item_id", "needed").agg(F.count_distinct("word").alias("n"))
    return found.filter("n >= needed").select("doc_id").distinct()


def _measured(groups: DataFrame) -> DataFrame:
    """n_matched and share of some places."""
    at = lambda p: F.array_distinct(F.transform(p, lambda x: x["item_pos"]))
    said = F.array_distinct(F.flatten(F.transform(at(F.col("places")), lambda x: F.sequence(x, x + F.col("length") - 1))))
    eligible = F.size(at(F.filter("places", lambda x: x["eligible"])))
    share = F.greatest(F.col("n_matched") / F.col("n_windows"), F.when(F.col("n_eligible") > 0, eligible / F.col("n_eligible")), F.size(said) / (F.col("n_windows") + F.col("length") - 1))
    return groups.withColumn("n_matched", F.size(at(F.col("places"))).cast("long")).withColumn("share", share)


def _occurrences(pairs: DataFrame) -> DataFrame:
    """The places of each pair by occurrence, and all of them as one: kind, number, places, n_matched, share, run.

    Runs are for ``min_run``. Occurrences are read in two ways: places whose offsets (doc_pos minus item_pos) are neighbours, and stretches of
    the document in which the place in the item does not go back (so words put in between do not part them).
    """
    at = pairs.select("doc_id", "item_id", "length", "n_windows", "n_eligible", F.explode("places").alias("p"))
    pair = WindowSpec.partitionBy("doc_id", "item_id")
    offset, near = F.col("p.doc_pos") - F.col("p.item_pos"), F.floor(F.col("length") / 2)
    by_offset, by_place = pair.orderBy(offset), pair.orderBy("p.doc_pos", "p.item_pos")
    at = at.withColumns({"apart": (offset - F.lag(offset).over(by_offset) > near).cast("int"), "back": (F.lag("p.item_pos").over(by_place) - F.col("p.item_pos") > near).cast("int")})
    at = at.withColumns({"cluster": F.sum(F.coalesce("apart", F.lit(0))).over(by_offset.rangeBetween(WindowSpec.unboundedPreceding, 0)), "stretch": F.sum(F.coalesce("back", F.lit(0))).over(by_place.rowsBetween(WindowSpec.unboundedPreceding, 0))})
    # a run: places of one offset without a gap
    in_offset = WindowSpec.partitionBy("doc_id", "item_id", offset).orderBy("p.doc_pos")
    at = at.withColumn("gap", F.col("p.doc_pos") - F.dense_rank().over(in_offset))
    run = F.shiftleft(offset.cast("long"), 32) + F.col("gap")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("long").alias("number")) for k, n in enumerate((F.lit(0), F.col("cluster"), F.col("stretch"), run))])
    at = at.select("doc_id", "item_id", "length", "n_windows", "n_eligible", "p", F.inline(kinds))
    out = at.groupBy("doc_id", "item_id", "kind", "number").agg(F.first("length").alias("length"), F.first("n_windows").alias("n_windows"), F.first("n_eligible").alias("n_eligible"), F.collect_set("p").alias("places"))
    return _measured(out).withColumn("run", F.when(F.col("kind") == RUN, F.col("n_matched") + F.col("length") - 1).otherwise(0))


def _short(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """(doc_id, item_id) of items of under ``SHORTEST`` words as whole lines of documents; None without such items."""
    said = lambda words: F.xxhash64(F.lit("line"), words)
    known = items.filter((F.size("raw") > 0) & (F.size("raw") < SHORTEST)).select("item_id", said(F.col("raw")).alias("key"))
    n = known.count()
    if not n:
        return None
    lines = texts.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", r"[\n\r]+"), lambda line: said(raw_words(line))))).alias("key"))
    return lines.join(F.broadcast(known) if n <= BROADCAST_WINDOWS else known, "key").select("doc_id", "item_id").distinct()


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_share: float = MIN_SHARE, min_agreement: float = MIN_AGREEMENT, min_literal: int = MIN_LITERAL, min_run: int = MIN_RUN) -> DataFrame:
    """One row per contaminated (doc_id, item_id): n_matched, n_windows, share, n_slots, slot_agreement."""
    slots = [NUMBER, NAME, UNIT]
    said = F.col(item_text_col)
    items = items.select(F.col(item_col).alias("item_id"), canonical_words(said).alias("words"), canonical_words(said, names=False).alias("plain"), raw_words(said).alias("raw")).filter("item_id IS NOT NULL")
    all_items, all_texts = items, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window))).filter(F.col("length") >= SHORTEST)
    n = F.size("words") - F.col("length") + 1
    at = items.select("item_id", "words", "plain", "raw", "length", n.alias("n_windows"), F.explode(F.sequence(F.lit(1), n)).alias("item_pos"))
    literal = lambda piece: F.size(F.filter(piece, lambda w: ~w.isin(slots))) >= F.least(F.lit(min_literal), F.col("length") - 1)
    at = at.withColumns({c: F.slice(c, F.col("item_pos"), F.col("length")) for c in ("words", "plain", "raw")}).withColumns({"by_name": literal(F.col("words")), "by_word": literal(F.col("plain"))})
    at = at.withColumn("n_eligible", F.count_if(F.col("by_name") | F.col("by_word")).over(WindowSpec.partitionBy("item_id")))
    at = materialize(at.withColumn("word", F.when(F.col("by_name"), _key(F.col("words"), F.col("length"))).otherwise(_key(F.col("plain"), F.col("length")))), "item-windows")
    kinds = {"words": (True, "by_name"), "plain": (False, "by_word"), "raw": ("raw", "NOT by_name AND NOT by_word")}
    keyed = lambda c: at.filter(kinds[c][1]).select(F.lit(c).alias("by"), F.xxhash64(F.lit(kinds[c][0]), c).alias("key"), "item_id", "item_pos", "length", "n_windows", "n_eligible", (F.lit(c) != "raw").alias("eligible"))
    known = keyed("words").unionAll(keyed("plain")).unionAll(keyed("raw"))
    sizes = {(r["length"], r["by"]): r["count"] for r in known.groupBy("length", "by").count().collect()}  # at most three times window rows
    small = sum(sizes.values()) <= BROADCAST_WINDOWS
    texts = all_texts
    some = _candidates(texts, at, min_share, min_run)
    if some is not None:
        some = materialize(some, "candidate-ids")
        few = F.broadcast(some) if some.count() <= BROADCAST_WINDOWS else some
        texts = materialize(texts.join(few, "doc_id", "left_semi").repartition(parts(docs.sparkSession)), "candidates")
    whole = texts.select("doc_id", canonical_words(F.col("text")).alias("words"), canonical_words(F.col("text"), names=False).alias("plain"), raw_words(F.col("text")).alias("raw"))
    hits = None
    for length, column in sorted(sizes) or [(window, "words")]:
        side = known.filter((F.col("length") == length) & (F.col("by") == column)).drop("length", "by")
        probe = whole.select("doc_id", F.posexplode(_windows(F.col(column), length, kinds[column][0])).alias("pos", "key"))
        found = probe.join(F.broadcast(side) if small else side, "key").select("doc_id", "item_id", (F.col("pos") + 1).alias("doc_pos"), "item_pos", F.lit(length).alias("length"), "n_windows", "n_eligible", "eligible")
        hits = found if hits is None else hits.unionAll(found)
    pairs = hits.groupBy("doc_id", "item_id").agg(
        F.first("n_windows").alias("n_windows"), F.first("n_eligible").alias("n_eligible"), F.first("length").alias("length"),
        F.collect_set(F.struct("item_pos", "doc_pos", "eligible")).alias("places"),
    )
    pairs = _measured(pairs).filter((F.col("share") >= min_share) | (F.col("n_matched") + F.col("length") - 1 >= min_run))
    groups = materialize(_occurrences(pairs).filter((F.col("share") >= min_share) | (F.col("run") >= min_run)), "occurrences")
    # the slots: words of the item and of the document at matched places; below an explode each text is split once
    key = ["doc_id", "item_id", "kind", "number"]
    found = groups.join(items.select("item_id", F.col("words").alias("kinds"), "raw"), "item_id").join(texts, "doc_id")
    found = found.withColumn("said", raw_words(F.col("text"))).select(*key, "length", "kinds", "raw", "said", F.explode("places").alias("p"))
    found = found.select(*key, "kinds", "raw", "said", "p", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("k"))
    i, d = F.col("p.item_pos") + F.col("k"), F.col("p.doc_pos") + F.col("k")
    slots_at = found.filter(F.get("kinds", i - 1).isin(slots)).select(*key, i.alias("i"), d.alias("d"), F.get("raw", i - 1).alias("a"), F.get("said", d - 1).alias("b")).distinct()
    values = slots_at.groupBy(*key, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    of_a, of_b = WindowSpec.partitionBy(*key, "a"), WindowSpec.partitionBy(*key, "b")
    values = values.withColumn("as", F.count(F.lit(1)).over(of_a)).withColumn("bs", F.count(F.lit(1)).over(of_b))
    agreed = values.groupBy(*key).agg(F.sum("n").alias("n_slots"), F.sum(F.when((F.col("as") == 1) & (F.col("bs") == 1), F.col("n")).otherwise(0)).alias("agree"))
    out = groups.select(*key, "n_matched", "n_windows", "share").join(agreed, key, "left")
    out = out.select("doc_id", "item_id", "n_matched", F.col("n_windows").cast("long").alias("n_windows"), "share", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce(F.col("agree") / F.col("n_slots"), F.lit(1.0)).alias("slot_agreement"))
    columns = out.columns[2:]
    best = out.filter(F.col("slot_agreement") >= min_agreement).groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "slot_agreement", "n_matched", "n_slots", "n_windows")).alias("best"))
    best = best.select("doc_id", "item_id", *[f"best.{c}" for c in columns])
    short = _short(all_texts, all_items)
    if short is None:
        return best
    one = F.lit(1).cast("long")
    short = short.select("doc_id", "item_id", one.alias("n_matched"), one.alias("n_windows"), F.lit(1.0).alias("share"), F.lit(0).cast("long").alias("n_slots"), F.lit(1.0).alias("slot_agreement"))
    return best.unionByName(short)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    found = matches(docs, items, **options).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs[options.get("id_col", "doc_id")] == found["__found"], "left_anti")
