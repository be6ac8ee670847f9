"""Near duplicates by bottom-k sketches.

One hash function orders all 5-word shingles; a document's sketch is the ``K`` smallest of its hashes. Inverted
lists of retained values give the documents whose sketches overlap, the sketch of the union estimates the
Jaccard similarity of a pair, and pairs that may reach the limit are settled on their full shingle sets.

Nothing is lost to hot lists. Two sets at the limit share at least ``least_shared`` retained values (but
for a chance below 1e-6), so it is enough to look a document up under its rarest values, that many fewer
than all; passages that thousands of documents share are among the frequent ones. Documents that meet
nobody in the lists of the small sketch are done. The others are looked up once more with a sketch of
``WIDE`` values, for most of them the whole set, which also tells how much a document can share with
anybody: copies with too many edits of their own leave the lists of their group. Inside a list only
comparisons with a hub are made: first with its most typical member, then with members that are not
connected to the rest yet, more of them each round; members that meet in many long lists are compared in one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import blocks, discard, grams, lists, lower, mix, ranked, scratch, span_hash, stored, word_spans
from paytrace.operators.topology import weak_components

WORDS = 5
PERCENT = 85
K = 32
WIDE = 1_024
CHANCE = 1e-7  # that two sets at the limit share fewer of the retained values of their union than is asked for
LONG_LIST = 2_000  # comparisons left in a list from which what its members share with the first hub is counted
SET_OF_LISTS = 128  # shingles of the largest member for each set into which its long lists are dealt
PAIRS_PER_ROW = 32  # comparisons per list row up to which the rest is compared in one round


def _surely_shared(k: int, percent: int) -> int:
    """Largest m for which fewer than m of ``k`` union values, each in both sets with chance ``percent`` %, have a chance below ``CHANCE``."""
    p, total, m = percent / 100, 0.0, 0
    while p < 1:
        total += math.exp(math.lgamma(k + 1) - math.lgamma(m + 1) - math.lgamma(k - m + 1) + m * math.log(p) + (k - m) * math.log(1 - p))
        if total > CHANCE:
            return m
        m += 1
    return k


@dataclass(frozen=True)
class Limit:
    """The similarity asked for and what it implies for sketches of ``K`` and ``WIDE`` values."""

    percent: int = PERCENT

    @property
    def at_k(self) -> int:
        return _surely_shared(K, self.percent)

    @property
    def at_wide(self) -> int:
        return _surely_shared(WIDE, self.percent)

    @property
    def small(self) -> int:
        """Sets up to this size have unions that the wide sketch retains as a whole."""
        return math.floor(WIDE * self.percent / 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 63-bit shingle hashes and the index of each document's first one.

    A text of fewer words than a shingle has its whole sequence as the only one; without words it has none.
    """
    small = lower(data)
    starts, ends, first = word_spans(small, offsets)
    words = span_hash(small, starts, ends)
    full, at = grams(words, first, WORDS)
    owner = np.searchsorted(first, at, "right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        full = np.concatenate([full, span_hash(words, first[short], first[short + 1])])
        owner = np.concatenate([owner, short])
    full >>= np.uint64(1)
    order = np.lexsort((full, owner))
    full, owner = full[order], owner[order]
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
    return full[new].astype(np.int64), np.searchsorted(owner[new], np.arange(len(offsets)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in blocks(batch.column(1)):
            values, first = shingle_sets(data, offsets)
            count = np.diff(first)
            prints = []
            for seed in (1, 2):  # a set's fingerprint: sums of its scrambled members
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values.astype(np.uint64) + np.uint64(seed)))])
                prints.append(mix(total[first[1:]] - total[first[:-1]]).astype(np.int64))
            kept = np.minimum(count, K)
            behind = np.concatenate([[0], np.cumsum(kept)])
            pick = np.arange(behind[-1]) - np.repeat(behind[:-1] - first[:-1], kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), pa.array(count.astype(np.int64)), pa.array(prints[0]),
                 pa.array(prints[1]), lists(values[pick], behind)],
                names=["doc_id", "n_shingles", "print_a", "print_b", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in blocks(batch.column(1)):
            values, first = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), lists(values, first)], names=["id", "full"])


def least_shared(n: Column, k: int, shared_at_k: int, percent: int = PERCENT) -> Column:
    """Retained values that a document of ``n`` shingles shares at least with any other at the limit.

    A union of at most ``k`` shingles is retained as a whole, with ``percent`` % of ``n`` in both sets; the chance
    bound ``shared_at_k`` holds for larger unions only.
    """
    whole = F.ceil(n * percent / 100)
    return F.when(n <= math.floor(k * percent / 100), whole).otherwise(F.least(whole, F.lit(shared_at_k))).cast("int")


def _lookups(nodes: DataFrame, k: int, shared_at_k: int, percent: int) -> DataFrame:
    """(value, id, n, met, common): each node under its rarest retained values, values of a single node left out.

    ``met`` is the number of retained values that other nodes have too. ``common`` adds up how many nodes
    share each of them: in a group of copies it is largest for the original.
    """
    each = nodes.select("id", "n", F.explode("sketch").alias("value"))
    often = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1").withColumnRenamed("value", "v")
    known = each.join(often, F.col("v") == F.col("value")).groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))  # k at most
    met, least = F.size("values"), least_shared(F.col("n"), k, shared_at_k, percent)
    # values that no other node has are the rarest
    looked_up = (met - least + 1).cast("int")
    common = F.aggregate("values", F.lit(0).cast("long"), lambda total, v: total + v["df"])
    picked = known.where(looked_up > 0).select(
        "id", "n", met.alias("met"), common.alias("common"), F.explode(F.slice("values", F.lit(1), looked_up)).alias("s"))
    return picked.select(F.col("s.value").alias("value"), "id", "n", "met", "common")


def _may_share(n: Column, met: Column, other_n: Column, limit: Limit) -> Column:
    """Whether a node can share enough with one of ``other_n`` shingles, as far as its own sketch tells."""
    exact = met * (100 + limit.percent) >= (n + other_n) * limit.percent
    return F.when((n <= limit.small) & (other_n <= limit.small), exact).otherwise(exact | (met >= limit.at_wide)) & (
        F.least(n, other_n) * 100 >= F.greatest(n, other_n) * limit.percent)


def _meetings(rows: DataFrame, hubs: DataFrame, allowed: Column, limit: Limit) -> DataFrame:
    """Pairs (a, b) of list members with the hubs of their list, where both can share enough.

    Two sets share at most what each has of the list's first hub, and outside of it what others have too. Two
    members that meet in several long lists are compared in the first of them only.
    """
    fits = _may_share(F.col("n"), F.col("met"), F.col("hn"), limit) & _may_share(F.col("hn"), F.col("hmet"), F.col("n"), limit)
    most = F.least("of_first", "hof_first") + F.least(F.col("met") - F.col("of_first"), F.col("hmet") - F.col("hof_first"))
    known = (F.col("n") <= limit.small) & (F.col("hn") <= limit.small) & F.col("of_first").isNotNull() & F.col("hof_first").isNotNull()
    fits &= ~known | (most * (100 + limit.percent) >= (F.col("n") + F.col("hn")) * limit.percent)
    fits &= F.col("own").isNull() | (F.get(F.array_intersect("own", "hown"), F.lit(0)) == F.col("value"))
    return rows.join(hubs, (F.col("v") == F.col("value")) & (F.col("id") != F.col("hid")) & allowed & fits).select(
        F.least("id", "hid").alias("a"), F.greatest("id", "hid").alias("b"))


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """Of the pairs (a, b) those at the limit: estimated on the sketch of the union, then settled on full sets."""
    sketch = nodes.select("id", "sketch")
    both = pairs.join(sketch.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(
        sketch.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    agree = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    least = F.when(F.size(F.array_union("sa", "sb")) >= K, F.lit(limit.at_k)).otherwise(1)
    likely = both.where(agree >= least).select("a", "b")
    full = likely.join(sets.withColumnsRenamed({"id": "a", "full": "fa"}), "a").join(
        sets.withColumnsRenamed({"id": "b", "full": "fb"}), "b")
    common = F.size(F.array_intersect("fa", "fb")).cast("long")
    union_size = F.size("fa") + F.size("fb") - common
    return full.where(common * 100 >= union_size * limit.percent).select("a", "b").distinct()


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The smallest label within two links of each node; nodes of one label are connected, which saves comparisons."""
    ways = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("next")),
                                          F.struct(F.col("b").alias("id"), F.col("a").alias("next")))).alias("w")).select("w.*")
    own = ways.select("id").distinct().withColumn("label", F.col("id"))
    if labels is not None:
        own = own.unionByName(labels).groupBy("id").agg(F.min("label").alias("label"))
    for _ in range(2):
        heard = ways.join(own.withColumnRenamed("id", "next"), "next").select("id", "label")
        own = own.unionByName(heard).groupBy("id").agg(F.min("label").alias("label"))
    return stored(own, "labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _open_lists(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists whose members have several labels: value, id, n, met, first, u, stray, strays, members.

    In each list the members of its most frequent label are connected already, so whatever is left to
    compare has a member with another label, a stray, on one side. ``u`` is a hash that orders them.
    """
    left = _labelled(rows.select("value", "id", "n", "met", F.col("hid").alias("first")), labels)
    counts = left.groupBy("value", "label").agg(F.count("*").alias("c")).groupBy(F.col("value").alias("v")).agg(
        F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("members"))
    counts = counts.withColumn("strays", F.col("members") - F.col("main.c")).where("strays > 0")
    u = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return left.join(counts, F.col("v") == F.col("value")).select(
        "value", "id", "n", "met", "first", u.alias("u"), (F.col("label") != F.col("main.label")).alias("stray"), "strays", "members")


def _with_first_hub(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``of_first``, the shingles shared with the list's first hub, in lists where many comparisons are left."""
    asked = left.where(F.col("strays") * F.col("members") > LONG_LIST).select("id", "first").distinct()
    both = asked.join(sets, "id").join(sets.withColumnsRenamed({"id": "first", "full": "hub"}), "first")
    shared = both.select("id", "first", F.size(F.array_intersect("full", "hub")).alias("of_first"))
    return left.join(shared, ["id", "first"], "left")


def _with_own_lists(left: DataFrame) -> DataFrame:
    """Adds ``own``: the long lists of a member, those with fewest strays first; null in short lists.

    Copies meet in as many lists as they share passages. Every two of them with unlike labels are compared in each list that has
    both, so one of these lists is enough: the first. Lists are dealt into sets, more of them where members are large, and each
    set has a first list of its own: what a row holds stays short.
    """
    long = left.where(F.col("strays") * F.col("members") > LONG_LIST)
    largest = long.groupBy(F.col("value").alias("v")).agg(F.max("n").alias("largest"))
    sets = F.ceil(F.least("largest", F.lit(WIDE)) / SET_OF_LISTS)
    named = left.join(largest, F.col("v") == F.col("value"), "left").withColumn(
        "part", F.when(F.col("largest").isNotNull(), sets * WIDE + F.pmod("value", sets))).drop("v", "largest")
    own = named.where("part IS NOT NULL").groupBy("id", "part").agg(
        F.sort_array(F.collect_list(F.struct("strays", "value"))).alias("each"))
    return named.join(own.select("id", "part", F.col("each.value").alias("own")), ["id", "part"], "left").drop("part")


def links(nodes: DataFrame, texts: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """Verified pairs (a, b) that connect all nodes that are connected; not every pair inside a component.

    ``nodes``: id, n, sketch. ``texts``: id, text.
    """
    first = _lookups(nodes, K, limit.at_k, limit.percent).select("value", "id")
    meet = first.groupBy(F.col("value").alias("v")).agg(F.count("*").alias("members")).where("members > 1")
    suspects = stored(first.join(meet, F.col("v") == F.col("value")).select("id").distinct(), "suspects")
    sets = stored(texts.join(suspects, "id", "left_semi").select("id", "text").mapInArrow(
        _sets, "id long, full array<long>"), "sets")
    wide = sets.select("id", F.size("full").cast("long").alias("n"), F.slice("full", 1, WIDE).alias("sketch"))
    rows = stored(_lookups(wide, WIDE, limit.at_wide, limit.percent), "lists")
    hub = rows.groupBy(F.col("value").alias("v")).agg(
        F.max(F.struct("common", "id", "n", "met")).alias("h"), F.min("n").alias("low"), F.count("*").alias("members"))
    hub = hub.where("members > 1").select(
        "v", F.col("h.id").alias("hid"), F.col("h.n").alias("hn"), F.col("h.met").alias("hmet"), "low")
    # members that cannot share enough even with the smallest that fits leave the list
    smallest = F.greatest(F.col("low"), F.ceil(F.col("n") * limit.percent / 100))
    starred = stored(rows.join(hub, F.col("v") == F.col("value")).where(
        _may_share(F.col("n"), F.col("met"), smallest, limit) | (F.col("id") == F.col("hid"))).drop("v", "low"), "starred")
    fits = _may_share(F.col("n"), F.col("met"), F.col("hn"), limit) & _may_share(F.col("hn"), F.col("hmet"), F.col("n"), limit)
    pairs = starred.where((F.col("id") != F.col("hid")) & fits).select(
        F.least("id", "hid").alias("a"), F.greatest("id", "hid").alias("b")).distinct()
    found = stored(_verified(pairs, nodes, sets, limit), "links")
    labels = _relabel(None, found)
    left = stored(_open_lists(starred.where("id <> hid"), labels), "open")
    left = stored(_with_own_lists(stored(_with_first_hub(left, sets), "open")), "open")
    done, hubs_a_list = 0, 4
    while True:
        rows = left.where(F.col("strays") > done)  # a list is finished when all its strays have been hubs
        work = rows.agg(F.sum("strays").alias("pairs"), F.count("*").alias("rows")).first()  # each row meets its list's strays
        if not work["rows"]:
            return found
        rest_now = work["pairs"] <= PAIRS_PER_ROW * work["rows"]
        rows = _labelled(rows, labels)
        # hubs of this round: strays in a slice of the hash range; of two strays the earlier one is the hub
        start, until = F.lit(float(done)) / F.col("strays"), F.lit(1.0) if rest_now else F.lit(float(hubs_a_list)) / F.col("strays")
        hubs = rows.where(F.col("stray") & (F.col("u") >= start) & (F.col("u") < until)).select(
            F.col("value").alias("v"), F.col("id").alias("hid"), F.col("n").alias("hn"), F.col("met").alias("hmet"),
            F.col("of_first").alias("hof_first"), F.col("own").alias("hown"),
            F.col("u").alias("hu"), F.col("label").alias("hl"))
        later = ~F.col("stray") | (F.col("u") > F.col("hu")) | ((F.col("u") == F.col("hu")) & (F.col("id") > F.col("hid")))
        new = stored(_verified(_meetings(rows, hubs, later & (F.col("label") != F.col("hl")), limit).distinct(), nodes, sets, limit), "links")
        found = found.unionByName(new)
        if rest_now:
            return found
        labels = _relabel(labels, new)
        done, hubs_a_list = hubs_a_list, hubs_a_list * 8


def components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Links need ``100 * shared >= percent * union`` on full sets of distinct 5-word shingles of lower-cased (A-Z)
    words. Texts with equal sets are one node, named after their smallest doc_id. Null and empty texts have no
    shingles and are linked with nothing; a null doc_id links with nothing, has component_id null and is kept.
    Rows of one doc_id get the component of their own text. Very long texts are hashed section by section. Columns other
    than doc_id and text are ignored; an empty table gives an empty result.
    """
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(given.mapInArrow(
        _sketches, "doc_id long, n_shingles long, print_a long, print_b long, sketch array<long>"), "sketches")
    same = ["n_shingles", "print_a", "print_b"]
    nodes = stored(rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*same).agg(
        F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch")).withColumnRenamed("n_shingles", "n"), "nodes")
    found = links(nodes, given.select(F.col("doc_id").alias("id"), "text"), Limit(percent))
    groups = weak_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    smallest = groups.select(F.col("account_id").alias("id"), "component")
    named = nodes.join(smallest, "id", "left").select(
        F.col("n").alias("n_shingles"), "print_a", "print_b", F.coalesce("component", "id").alias("component"))
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    linked = rows.where(usable).join(named, same).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _numbered(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__id``: the doc_id, but a number of its own for each further text of a doc_id with several texts."""
    number = F.col("doc_id").cast("long")
    texts = documents.select(number.alias("d"), F.xxhash64("text").alias("k")).where("d IS NOT NULL")
    several = stored(texts.groupBy("d").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first <> last"), "several")
    if several.isEmpty():
        return documents.withColumn("__id", number)
    further = ranked(texts.distinct().join(several, "d").where("k <> first").select("d", "k"), ["d", "k"], "at", "further")
    ends = documents.agg(F.max(number).alias("top"), F.min(number).alias("low")).first()
    fresh = F.lit(ends.top + 1) + F.col("at") if ends.top < 1 << 62 else F.lit(ends.low - 1) - F.col("at")
    own = stored(further.select("d", "k", fresh.alias("fresh")), "further")
    same = (number == F.col("d")) & (F.xxhash64("text") == F.col("k"))
    return documents.join(own, same, "left").withColumn("__id", F.coalesce("fresh", number)).drop("d", "k", "fresh")


def keep(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, all columns as they were; rows without a doc_id all stay.

    A row is known by its doc_id and its text: of two rows with one doc_id and unlike texts both stay, of repeated rows
    one. The row with the smallest doc_id of its group stays; a doc_id with several texts stands for the first of them (by
    hash) there. An empty table gives an empty result.
    """
    clash = [c for c in ("d", "k", "fresh") if c in documents.columns]
    named = documents.select(*[F.col(f"`{c}`").alias(f"__own_{c}" if c in clash else c) for c in documents.columns])
    numbered = _numbered(named)
    with scratch() as kept:
        judged = kept(stored(components(numbered.select(F.col("__id").alias("doc_id"), "text"), percent).select("doc_id", "kept"), "judged"))
    gone = stored(judged.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    again = stored(judged.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__again")).agg(
        F.count("*").alias("n")).where("n > 1").select("__again"), "again")
    discard(judged)
    rest = numbered.join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    single = rest.join(again, F.col("__id") == F.col("__again"), "left_anti")
    repeated = rest.join(again, F.col("__id") == F.col("__again"), "left_semi").dropDuplicates(["__id"])
    both = single.unionByName(repeated)
    return both.select(*[F.col(f"`__own_{c}`" if c in clash else f"`{c}`").alias(c) for c in documents.columns])
