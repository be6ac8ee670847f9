"""Time-ordered flow tracing: which receipt funded which payment.

A payment takes one earlier receipt of its account, the one with the longest chain behind it (the
newest on ties), and uses it up. Its choice depends on chains that were built elsewhere, so the whole
network is one sequence; but it depends only on strictly earlier transfers, so repeating the
per-account step until nothing changes ends in the one right answer.

Which receipts fit a payment by time and amount depends on nothing else, so accounts are spread over all tasks for
it. What is left to do in order is small: one task per window walks the payments that have a choice and notes, per transfer, its depth or that
it is used up. Pairs are not listed for an account in whose windows too many meet; its receipts wait in a tree over their amounts.

Where a caller limits the inbox, accounts are dealt into parts of about ``task_rows`` events. A part is replayed in one pass over
its events in time order, with one inbox per account; payers announce the chain lengths of payments that leave their part, and a part is
replayed again when an announcement for it changed. An account's timeline beyond ``chunk_rows`` is cut into chunks; its inbox is announced
from chunk to chunk in the same way.
"""

from __future__ import annotations

from array import array
from collections import OrderedDict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.exprs import bucket, dbl
from ..sources.session import cut, drop_folder, new_folder, tabled

CHUNK_ROWS = 200_000
TASK_ROWS = 100_000
BOX = "array<struct<t:bigint,units:bigint,tx:string,depth:int>>"
EVENT = ["t", "sender", "receiver", "units", "tx", "kind", "account", "chunk", "to", "window", "depth", "box", "turn", "part"]
EVENT_SCHEMA = ("t bigint, sender string, receiver string, units bigint, tx string, kind int, account string, chunk int, to int, "
                f"window int, depth int, box {BOX}, turn int, part int")
ORDER = ["part", "t", "sender", "receiver", "units", "tx", "kind", "turn"]
OUT = ["t", "sender", "receiver", "units", "tx", "kind", "account", "chunk", "window", "depth", "box", "turn", "heard", "funded_by", "wait", "sort", "part"]
OUT_SCHEMA = ("t bigint, sender string, receiver string, units bigint, tx string, kind int, account string, chunk int, "
              f"window int, depth int, box {BOX}, turn int, heard boolean, funded_by string, wait bigint, sort string, part int")
_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()
OUT_TYPES = [_LONG, _TEXT, _TEXT, _LONG, _TEXT, _INT, _TEXT, _INT, _INT, _INT,
             pa.list_(pa.struct([("t", _LONG), ("units", _LONG), ("tx", _TEXT), ("depth", _INT)])), _INT, pa.bool_(), _TEXT, _LONG, _TEXT, _INT]
OPENING, KNOWN, PAYMENT, RECEIPT, CLOSING = range(-1, 4)  # kinds of rows, in the order in which rows of one transfer are read
FIRST, LAST = -(1 << 62), 1 << 62
KEY = ["t", "sender", "receiver", "units", "tx"]
PAIRS_A_PAYMENT = 256  # receipts inside the window of an account's payments, on average, up to which those that fit are listed
PAIRS_AT_ONCE = 2_000_000
RANK_BITS = 40  # a tree's number is a depth and a rank
LISTED, HOT_RECEIPT, HOT_PAYMENT = range(3)
TOLD = "window int, kind int, rank bigint, first bigint, t bigint, account bigint, low bigint, high bigint, receipts array<bigint>"
TOLD_TYPES = [_INT, _INT, _LONG, _LONG, _LONG, _LONG, _LONG, _LONG, pa.list_(_LONG)]
NEVER = float("nan")  # the time of a transfer without one: neither earlier nor later than any other


def _units(amount: Column) -> Column:
    """Amount in 1/10,000 units: the ratio test is then exact integer arithmetic."""
    return (amount * 10000).cast("bigint")


def _chunks(use: DataFrame, chunk_rows: int) -> DataFrame:
    """(account, hour, chunk) of accounts too long for one chunk; hours never straddle two chunks."""
    side = F.explode(F.array("sender", "receiver"))
    load = use.select(side.alias("account"), bucket("t", fixed.HOUR).alias("hour")).groupBy("account", "hour").count()
    whole = load.groupBy("account").agg(F.sum("count").alias("n")).where(F.col("n") > chunk_rows).select("account")
    hours = Window.partitionBy("account").orderBy("hour")
    upto = hours.rowsBetween(Window.unboundedPreceding, -1)
    cut_at = F.floor(F.coalesce(F.sum("count").over(upto), F.lit(0)) / chunk_rows)
    # A busy hour can jump over a multiple of ``chunk_rows``; ranking makes the chunk numbers dense.
    return load.join(whole, "account", "left_semi").withColumn("cut_at", cut_at).select(
        "account", "hour",
        (F.dense_rank().over(Window.partitionBy("account").orderBy("cut_at")) - 1).alias("chunk"))


class _Inbox:
    """Unused receipts of one account, kept per chain depth in the order they came.

    A payment is served from the deepest level down, each level from its newest end, and stops at the first
    fit. Beyond ``room`` receipts the oldest leaves. Times only rise, so with a ``window`` a receipt older than that can fund
    nothing any more and leaves as well, before any younger one. Levels are linked lists by key: a receipt is taken
    out anywhere in constant time.
    """

    def __init__(self, room: int, held=(), window: int | None = None):
        self.room, self.window, self.levels, self.waiting, self.count = room, window, {}, OrderedDict(), 0
        for receipt in held:
            self.put(*receipt)

    def put(self, t: int, units: int, tx: str, depth: int) -> None:
        self._expire(t)
        self.count += 1
        self.levels.setdefault(depth, OrderedDict())[self.count] = (t, units, tx)
        self.waiting[self.count] = (depth, t)
        if len(self.waiting) > self.room:
            self._take(next(iter(self.waiting)))

    def _expire(self, t: int) -> None:
        while self.window is not None and self.waiting:
            key, (_, came) = next(iter(self.waiting.items()))
            if not t - came > self.window:  # a receipt without a time stays until there is no room
                return
            self._take(key)

    def _take(self, key: int) -> None:
        level, _ = self.waiting.pop(key)
        shelf = self.levels[level]
        del shelf[key]
        if not shelf:
            del self.levels[level]

    def serve(self, t: int, units: int, window: int) -> tuple[int, str | None, int | None]:
        """Depth, id and waiting time of the receipt that funds a payment; depth 0 if none does."""
        self._expire(t)
        for level in sorted(self.levels, reverse=True):
            for key, (came, size, tx) in reversed(self.levels[level].items()):
                if t - came > window:
                    break
                if came < t and 7 * size <= 10 * units <= 11 * size:
                    self._take(key)
                    return level, tx, t - came
        return 0, None, None

    def rest(self) -> list[tuple[int, int, str, int]]:
        """What is left, oldest first."""
        return [(*self.levels[level][key], level) for key, (level, _) in self.waiting.items()]


def _box(held) -> list[tuple[int, int, str, int]]:
    return [(NEVER if h["t"] is None else int(h["t"]), int(h["units"]), h["tx"], int(h["depth"])) for h in held]


def _replay(windows: list[int], min_units: int, max_inbox: int, turn: int):
    """Replays parts in time order as they stream by; emits funded payments and announcements that changed.

    Holds the inboxes of one part. An announcement is written twice: to the part that has to hear it and, to be
    compared with in a later replay, to the part that made it.
    """

    def step(batches):
        part, shelves, current, known, here = None, {}, None, {}, None
        for rows in batches:
            out = []
            for t, sender, receiver, units, tx, kind, account, chunk, to, window, depth, box, _, at in zip(*(rows.column(c).to_pylist() for c in EVENT)):
                if at != part:
                    part, shelves, current = at, {}, None
                if tx != current:
                    current, known, here = tx, {}, None
                event = (t, sender, receiver, units, tx)
                t = NEVER if t is None else t
                if kind == KNOWN:
                    known[int(window)] = int(depth) if box is None else _box(box)
                elif kind == OPENING:
                    shelves[int(window), account, chunk] = _Inbox(max_inbox, _box(box), int(window))
                elif kind == PAYMENT:
                    here = {}
                    for w in windows:
                        shelf = shelves.get((w, account, chunk))
                        behind, source, wait = shelf.serve(t, units, w) if shelf else (0, None, None)
                        here[w] = behind + 1
                        if source is not None:
                            out.append((*event, PAYMENT, account, chunk, w, behind + 1, None, turn, False, source, wait, "result", part))
                        if to >= 0 and to != part and behind + 1 != known.get(w, 1):
                            for heard, where in ((False, part), (True, to)):
                                out.append((*event, KNOWN, account, chunk, w, behind + 1, None, turn, heard, None, None, "said", where))
                elif kind == RECEIPT:
                    for w in windows:
                        length = here[w] if here is not None else known.get(w, 1)
                        shelf = shelves.get((w, account, chunk))
                        if shelf is None:
                            shelf = shelves[w, account, chunk] = _Inbox(max_inbox, window=w)
                        shelf.put(t, units, tx, length)
                else:
                    for w in windows:
                        shelf = shelves.get((w, account, chunk))
                        rest = shelf.rest() if shelf else []
                        if rest != known.get(w, []):
                            held = [dict(t=None if a != a else a, units=b, tx=c, depth=d) for a, b, c, d in rest]
                            out.append((*event, KNOWN, account, chunk, w, None, held, turn, False, None, None, "said", part))
                            out.append((FIRST, *event[1:], OPENING, account, chunk + 1, w, None, held, turn, True, None, None, "said", to))
            told = zip(*out) if out else ((),) * len(OUT)
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(told, OUT_TYPES)], names=OUT)

    return step


def _funding_of_short_inboxes(use: DataFrame, windows: list[int], min_units: int, max_inbox: int, chunk_rows: int, task_rows: int) -> DataFrame:
    """(window, tx, depth, funded_by, wait) of funded payments where an inbox holds ``max_inbox`` receipts: parts announce depths in rounds."""
    spark = use.sparkSession
    split = cut(_chunks(use, chunk_rows))
    hot = not split.isEmpty()

    def placed(df: DataFrame, key: str, name: str) -> DataFrame:
        if not hot:
            return df.withColumn(name, F.lit(0))
        where = split.select(F.col("account").alias(key), F.col("hour").alias("__h"), F.col("chunk").alias(name))
        df = df.withColumn("__h", bucket("t", fixed.HOUR)).join(where, [key, "__h"], "left").drop("__h")
        return df.withColumn(name, F.coalesce(name, F.lit(0)))

    # Only accounts that both receive and pay can forward anything.
    payers = use.select(F.col("sender").alias("receiver")).distinct().withColumn("pays_on", F.lit(True))
    collectors = use.where(F.col("units") >= min_units).select(F.col("receiver").alias("sender")).distinct().withColumn("was_paid", F.lit(True))
    use = cut(placed(placed(use, "sender", "s_chunk"), "receiver", "r_chunk").join(payers, "receiver", "left").join(collectors, "sender", "left"))
    as_receipt = F.col("pays_on").isNotNull() & (F.col("units") >= min_units)
    parts = max(1, -(-2 * use.count() // task_rows))

    def part_of(account: str, chunk: Column) -> Column:
        return F.pmod(F.xxhash64(account, chunk), F.lit(parts)).cast("int")

    own, target = part_of("sender", F.col("s_chunk")), part_of("receiver", F.col("r_chunk"))
    unknown = [F.lit(None).cast("int").alias("window"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast(BOX).alias("box"), F.lit(-1).alias("turn")]

    def event(kind: int, account: str, chunk: str, to: Column, part: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(account).alias("account"), F.col(chunk).cast("int").alias("chunk"), to.alias("to"), part.alias("part"))

    sides = F.array_compact(F.array(
        F.when(F.col("was_paid").isNotNull(), event(PAYMENT, "sender", "s_chunk", F.when(as_receipt, target).otherwise(-1), own)),
        F.when(as_receipt, event(RECEIPT, "receiver", "r_chunk", F.lit(-1), target))))
    events = use.select("t", "sender", "receiver", "units", "tx", F.explode(sides).alias("e")).select(
        "t", "sender", "receiver", "units", "tx", "e.kind", "e.account", "e.chunk", "e.to", *unknown, "e.part")
    if hot:  # every chunk but an account's last hands its inbox on
        ends = split.groupBy("account").agg(F.max("chunk").alias("final"))
        marks = split.select("account", "chunk").distinct().join(ends, "account").where("chunk < final")
        events = events.unionByName(marks.select(
            F.lit(LAST).alias("t"), F.lit("").alias("sender"), F.lit("").alias("receiver"), F.lit(0).cast("bigint").alias("units"),
            F.concat_ws(" ", F.lit("carry"), "chunk", "account").alias("tx"), F.lit(CLOSING).alias("kind"), "account", F.col("chunk").cast("int").alias("chunk"),
            part_of("account", F.col("chunk").cast("int") + 1).alias("to"), *unknown, part_of("account", F.col("chunk").cast("int")).alias("part")))
    folder = new_folder(spark, "flow")
    events.repartition(min(parts, 4096), "part").write.partitionBy("part").parquet(f"{folder}/events")
    written = spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events")
    last: dict[int, int] = {}  # the round that replayed a part last; parts are events / task_rows
    todo, turn = list(range(parts)), 0
    while todo:
        live = written.where(F.col("part").isin(todo))
        if turn:
            told = spark.read.schema(OUT_SCHEMA).parquet(f"{folder}/out").where((F.col("sort") == "said") & F.col("part").isin(todo))
            live = live.unionByName(told.withColumn("to", F.lit(-1)).select(*EVENT))
        # by range, as hashing few numbers would put several parts into one task and none into others
        ready = live.repartitionByRange(min(len(todo), 4096), "part").sortWithinPartitions(*ORDER)
        ready.mapInArrow(_replay(list(windows), min_units, max_inbox, turn), OUT_SCHEMA).write.mode("append").partitionBy(
            "turn", "sort", "part").parquet(f"{folder}/out")
        last |= dict.fromkeys(todo, turn)
        said = spark.read.schema(OUT_SCHEMA).parquet(f"{folder}/out").where(f"turn = {turn} AND sort = 'said' AND heard")
        todo = [r.part for r in said.select("part").distinct().collect()]
        turn += 1
    results = spark.read.schema(OUT_SCHEMA).parquet(f"{folder}/out").where("sort = 'result'")
    if turn > 1:
        valid = spark.createDataFrame(list(last.items()), "part int, turn int")
        results = results.join(valid, ["part", "turn"], "left_semi")
    known = cut(results.select("window", "tx", "depth", "funded_by", "wait"))
    drop_folder(spark, folder)
    return known


def _ranked(use: DataFrame, folder: str) -> DataFrame:
    """The transfers that have a time, numbered from 0 in the order of replay; ``same`` tells copies of one transfer."""
    spark = use.sparkSession
    timed = use.where("t IS NOT NULL").select(*KEY, F.xxhash64("receiver", "tx").alias("same"))
    timed.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{folder}/ranked")
    rows = spark.read.parquet(f"{folder}/ranked")
    piece = F.shiftright("at", 33)
    counts = sorted((r.piece, r.n) for r in rows.groupBy(piece.alias("piece")).agg(F.count("*").alias("n")).collect())  # tasks of the sort
    before, passed = {}, 0
    for at, n in counts:
        before[at] = passed - (at << 33)
        passed += n
    if not before:
        return rows.withColumn("rank", F.col("at"))
    return rows.withColumn("rank", F.col("at") + F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[piece])


def _candidates(windows: list[int], min_units: int):
    """Per payment and window the receipts that could fund it, for the accounts of a task.

    An account in whose windows receipts and payments meet too often to list the pairs is told event by event: its receipts by
    their place in the order of amounts (``low`` of ``high``), its payments by the range of places that fit.
    """

    def step(batches):
        held = [[], [], [], [], [], []]
        for batch in batches:
            for column, kept in zip(batch.columns, held):
                kept.append(column)
        if not held[0]:
            return
        names = pa.chunked_array(held[0]).combine_chunks().dictionary_encode()
        code = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        t, units, rank, same, pays = (pa.chunked_array(kept).to_numpy(zero_copy_only=False) for kept in held[1:])
        order = np.lexsort((rank, code))
        code, t, units, rank, same, pays = (x[order] for x in (code, t, units, rank, same, pays.astype(bool)))
        got = ~pays & (units >= min_units)
        r_code, r_t, r_units, r_rank = (x[got] for x in (code, t, units, rank))
        p_code, p_t, p_units, p_rank, p_same = (x[pays] for x in (code, t, units, rank, same))
        if not len(r_rank) or not len(p_rank):
            return
        # copies of a transfer follow each other; ``first`` is the rank of the first of them
        copy = np.r_[False, (p_rank[1:] == p_rank[:-1] + 1) & (p_code[1:] == p_code[:-1]) & (p_t[1:] == p_t[:-1]) & (p_units[1:] == p_units[:-1])
                     & (p_same[1:] == p_same[:-1])]
        p_first = p_rank[np.maximum.accumulate(np.where(copy, 0, np.arange(len(copy))))]
        # times of an account as places in one sorted array of numbers
        times = np.unique(np.r_[r_t, p_t])
        width = len(times) + 1
        r_key = r_code * width + np.searchsorted(times, r_t)
        end = np.searchsorted(r_key, p_code * width + np.searchsorted(times, p_t))
        for window in windows:
            start = np.searchsorted(r_key, p_code * width + np.searchsorted(times, p_t - window))
            pairs = end - start
            accounts = int(max(r_code[-1], p_code[-1])) + 1
            hot = np.bincount(p_code, pairs, accounts) > PAIRS_A_PAYMENT * np.bincount(p_code, minlength=accounts)
            listed = np.flatnonzero((pairs > 0) & ~hot[p_code])
            upto = np.cumsum(pairs[listed])
            low = 0
            while low < len(listed):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
                mine = listed[low:high]
                low = high
                payment = np.repeat(mine, pairs[mine])
                receipt = np.arange(len(payment)) - np.repeat(np.cumsum(pairs[mine]) - pairs[mine] - start[mine], pairs[mine])
                fits = (7 * r_units[receipt] <= 10 * p_units[payment]) & (10 * p_units[payment] <= 11 * r_units[receipt])
                payment, receipt = payment[fits], receipt[fits]
                found, sizes = np.unique(payment, return_counts=True)
                yield _told(window, LISTED, p_rank[found], p_first[found], p_t[found], receipts=(np.r_[0, np.cumsum(sizes)], r_rank[receipt]))
            for account in np.flatnonzero(hot):
                r, p = slice(*np.searchsorted(r_code, [account, account + 1])), slice(*np.searchsorted(p_code, [account, account + 1]))
                sizes = np.sort(r_units[r])
                place = np.empty(len(sizes), np.int64)
                place[np.argsort(r_units[r], kind="stable")] = np.arange(len(sizes))
                name = int(r_rank[r][0])
                yield _told(window, HOT_RECEIPT, r_rank[r], r_rank[r], r_t[r], name, place, np.full(len(sizes), len(sizes)))
                # 7 size <= 10 units <= 11 size
                yield _told(window, HOT_PAYMENT, p_rank[p], p_first[p], p_t[p], name, np.searchsorted(sizes, -(-10 * p_units[p] // 11)),
                            np.searchsorted(sizes, 10 * p_units[p] // 7, "right"))

    return step


def _told(window: int, kind: int, rank, first, t, account: int = -1, low=None, high=None, receipts=None) -> pa.RecordBatch:
    n = len(rank)
    listed = pa.array([None] * n, TOLD_TYPES[-1]) if receipts is None else pa.ListArray.from_arrays(
        pa.array(receipts[0].astype(np.int32)), pa.array(receipts[1], pa.int64()))
    nought = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, window, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(rank, pa.int64()), pa.array(first, pa.int64()),
         pa.array(t, pa.int64()), pa.array(np.full(n, account, np.int64)), pa.array(nought if low is None else low, pa.int64()),
         pa.array(nought if high is None else high, pa.int64()), listed], names=[c.split()[0] for c in TOLD.split(", ")])


class _Shelf:
    """Waiting receipts of an account of many, as a tree over their amounts with the deepest, then newest, of each branch at the top.

    A receipt is taken in once time has passed it, as it funds strictly later payments; one older than the window leaves.
    """

    def __init__(self, places: int, window: int):
        self.places, self.window, self.tree = places, window, array("q", bytes(16 * places))
        self.coming, self.waiting = deque(), deque()

    def _set(self, place: int, value: int) -> None:
        tree, at = self.tree, place + self.places
        tree[at] = value
        while at > 1:
            at >>= 1
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                return
            tree[at] = top

    def best(self, t: int, low: int, high: int, depth) -> int:
        """Rank of the receipt that funds a payment at ``t``, -1 if none does. ``depth`` by rank, 0 for a receipt that is used up."""
        while self.coming and self.coming[0][0] < t:
            came, rank, place = self.coming.popleft()
            self._set(place, depth[rank] << RANK_BITS | rank)
            self.waiting.append((came, place))
        while self.waiting and t - self.waiting[0][0] > self.window:
            self._set(self.waiting.popleft()[1], 0)
        top, a, b = 0, low + self.places, high + self.places
        while a < b:
            if a & 1:
                top = max(top, self.tree[a])
                a += 1
            if b & 1:
                b -= 1
                top = max(top, self.tree[b])
            a >>= 1
            b >>= 1
        return top & ((1 << RANK_BITS) - 1) if top else -1


def _served(transfers: int):
    """Serves the payments of a window one after another; the state is one number a transfer."""

    def step(batches):
        served, depth, shelves, places = None, None, {}, {}
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            kind, rank, first = (column.tolist() for column in columns[1:4])
            window, t, account, low, high = (column.tolist() for column in (columns[0], *columns[4:])) if any(kind) else (columns[0].tolist(), *[()] * 4)
            receipts = batch.column(8)
            offsets, values = receipts.offsets.to_numpy().tolist(), receipts.values.to_numpy(zero_copy_only=False).tolist()
            out = []
            for i, p in enumerate(rank):
                if window[i] != served:
                    served, depth, shelves, places = window[i], array("i", [1]) * transfers, {}, {}
                if kind[i] == LISTED:
                    deepest, best = 1, -1
                    for r in values[offsets[i]:offsets[i + 1]]:  # oldest first
                        if depth[r] >= deepest:
                            deepest, best = depth[r], r
                elif kind[i] == HOT_RECEIPT:
                    shelf = shelves.get(account[i])
                    if shelf is None:
                        shelf = shelves[account[i]] = _Shelf(high[i], served)
                    shelf.coming.append((t[i], p, low[i]))
                    places[p] = low[i]
                    continue
                else:
                    shelf = shelves.get(account[i])
                    best = -1 if shelf is None else shelf.best(t[i], low[i], high[i], depth)
                    if best >= 0:
                        deepest = depth[best]
                        shelf._set(places.pop(best), 0)
                if best >= 0:
                    depth[best] = 0
                    depth[p] = deepest + 1
                    out.append((served, p, best, deepest + 1))
                if first[i] < p:  # copies of a transfer bring what the last of them brought
                    for q in range(first[i], p):
                        depth[q] = depth[p]
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (_INT, _LONG, _LONG, _INT))], names=["window", "p", "r", "depth"])

    return step


def _funding(use: DataFrame, windows: list[int], min_units: int, task_rows: int) -> DataFrame:
    """(window, tx, depth, funded_by, wait) of funded payments.

    Which receipts fit a payment by time and amount is found for all accounts at once. Which of them is left, and how deep it is,
    depends on the payments before: a task per window walks the payments that have a choice in time order. It holds four bytes a transfer.
    """
    spark = use.sparkSession
    folder = new_folder(spark, "flow")
    ranked = _ranked(use, folder)
    sides = F.explode(F.array(F.struct(F.col("sender").alias("account"), F.lit(True).alias("pays")),
                              F.struct(F.col("receiver").alias("account"), F.lit(False).alias("pays")))).alias("s")
    events = ranked.select("t", "units", "rank", "same", sides).where(
        F.col("s.account").isNotNull() & (F.col("s.pays") | (F.col("units") >= min_units))).select("s.account", "t", "units", "rank", "same", "s.pays")
    transfers = ranked.count()
    parts = min(max(1, -(-2 * transfers // task_rows)), 4096)
    events.repartition(parts, "account").mapInArrow(_candidates(windows, min_units), TOLD).write.parquet(f"{folder}/told")
    told = spark.read.schema(TOLD).parquet(f"{folder}/told")
    turns = None
    for window in windows:
        mine = told.where(F.col("window") == window).repartition(1).sortWithinPartitions("rank", "kind").mapInArrow(
            _served(transfers), "window int, p bigint, r bigint, depth int")
        turns = mine if turns is None else turns.unionByName(mine)
    turns.write.parquet(f"{folder}/served")
    served = spark.read.schema("window int, p bigint, r bigint, depth int").parquet(f"{folder}/served")
    payment = ranked.select(F.col("rank").alias("p"), "tx", F.col("t").alias("paid"))
    receipt = ranked.select(F.col("rank").alias("r"), F.col("tx").alias("funded_by"), F.col("t").alias("came"))
    known = tabled(served.join(payment, "p").join(receipt, "r").where("tx IS NOT NULL AND funded_by IS NOT NULL").select(
        "window", "tx", "depth", "funded_by", (F.col("paid") - F.col("came")).alias("wait")))
    drop_folder(spark, folder)
    return known


def trace(tx: DataFrame, windows=(fixed.FAST_WINDOW, fixed.SLOW_WINDOW), min_amount=fixed.FLOW_MIN_AMOUNT,
          max_inbox: int | None = None, chunk_rows: int = CHUNK_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every transfer that can take part, with its chain depth and the receipt that funded it.

    Columns: window, tx, account (receiver), sender, t, amount, depth, funded_by, wait. A transfer below 0.7 x ``min_amount`` has
    depth 1 and is left out. Events are ordered by (t, sender, receiver, amount, id). Every receipt inside the window waits for a payment, or,
    with ``max_inbox``, an account's last so many.
    """
    min_units = int(min_amount * 10000)
    use = tx.select(
        F.col("transaction_id").alias("tx"), F.col("sender_id").alias("sender"), F.col("receiver_id").alias("receiver"),
        "t", _units(F.col("amount")).alias("units")).where(F.col("units") >= min_units * 7 // 10)
    if max_inbox is None:
        use = tabled(use)
        known = _funding(use, list(windows), min_units, task_rows)
    else:
        known = _funding_of_short_inboxes(use, list(windows), min_units, max_inbox, chunk_rows, task_rows)
    each = F.explode(F.array(*[F.lit(w) for w in windows])).alias("window")
    return use.select(each, "tx", F.col("receiver").alias("account"), "sender", "t", "units").join(
        known, ["window", "tx"], "left").select(
        "window", "tx", "account", "sender", "t", (F.col("units") / F.lit(10000)).cast("decimal(18,4)").alias("amount"),
        F.coalesce("depth", F.lit(1)).alias("depth"), "funded_by", "wait")


def paths(traced: DataFrame, max_path: int = fixed.FLOW_MAX_PATH) -> DataFrame:
    """Funded transfers with the last ``max_path`` hops of their chain, oldest first.

    Pointer doubling: three joins give eight hops. ``hops`` holds sender, time and amount per hop;
    ``members`` are the hop senders and the final receiver.
    """
    hop = F.array(F.struct("sender", "t", "amount"))
    traced = traced if "window" in traced.columns else traced.withColumn("window", F.lit(0))
    key = ["window", "tx"]
    funded = traced.where("funded_by IS NOT NULL")
    used = tabled(funded.select("window", F.col("funded_by").alias("tx")))
    roots = traced.join(used, key, "left_semi").where("funded_by IS NULL")
    rows = ["window", "tx", "account", "sender", "t", "amount", "depth", "funded_by", "wait", "hops", "back"]
    grown = tabled(funded.unionByName(roots).withColumn("hops", hop).withColumn("back", F.col("funded_by")).select(*rows))
    reach = 1
    while reach < max_path:
        prior = grown.select("window", F.col("tx").alias("back"), F.col("hops").alias("prior"), F.col("back").alias("further"))
        # rows that have reached the start of their chain look for nothing; their missing key would send them all to one task
        longer = grown.where("back IS NOT NULL").join(prior, ["window", "back"], "left").select(
            *rows[:-2], F.when(F.col("prior").isNull(), F.col("hops")).otherwise(F.concat("prior", "hops")).alias("hops"), F.col("further").alias("back"))
        grown = longer.unionByName(grown.where("back IS NULL"))
        reach *= 2
        grown = grown if reach >= max_path else tabled(grown)
    hops = F.slice("hops", -F.least(F.size("hops"), F.lit(max_path)), max_path)
    funded = grown.where("funded_by IS NOT NULL").withColumn("hops", hops)
    return funded.withColumn("path", F.col("hops.sender")).withColumn("members", F.concat("path", F.array("account"))).drop("back")


def loops(chain_paths: DataFrame) -> DataFrame:
    """Payments that return to an account already on their path, around three or more accounts."""
    at = F.array_position("path", F.col("account")).cast("int")
    found = chain_paths.withColumn("at", at).where("at > 0").withColumn(
        "loop", F.slice("path", F.col("at"), F.size("path"))).where(F.size("loop") >= 3)
    return found.select(
        "window", "tx", "t", F.col("loop").alias("nodes"), F.size("loop").alias("length"),
        (F.col("t") - F.element_at("hops", F.col("at"))["t"]).alias("duration_seconds"),
        dbl(F.element_at("hops", F.col("at"))["amount"]).alias("first_amount"), dbl("amount").alias("closing_amount"))


def distinct_loops(*found: DataFrame) -> DataFrame:
    """One row per set of accounts: the earliest loop, fast traces before slow ones."""
    rows = None
    for rank, df in enumerate(found):
        part = df.withColumn("pass", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    pick = F.min(F.struct("pass", "t", "tx", "nodes", "length", "duration_seconds", "first_amount", "closing_amount"))
    best = rows.groupBy(F.array_sort("nodes").alias("key")).agg(pick.alias("b")).select("b.*")
    return best.select(
        "nodes", "length", F.round(dbl("duration_seconds"), 1).alias("loop_duration_seconds"),
        F.round(F.col("closing_amount") / F.greatest("first_amount", F.lit(1e-9)), 3).alias("amount_retained_ratio"), "t", "tx")


def accounts(chain_paths: DataFrame, found_loops: DataFrame) -> DataFrame:
    """Per account: forwards, forwarded amount, mean wait, longest chain, times on a loop."""
    forwards = chain_paths.groupBy(F.col("sender").alias("account_id")).agg(
        F.count("*").alias("forward_count"), dbl(F.sum("amount")).alias("forwarded_amount"),
        F.avg("wait").alias("dwell_mean"))
    chain = chain_paths.select(F.explode("members").alias("account_id"), "depth").groupBy("account_id").agg(
        F.max("depth").alias("chain_length"))
    cycles = found_loops.select(F.explode("nodes").alias("account_id")).groupBy("account_id").agg(
        F.count("*").alias("cycle_count"))
    out = chain.join(forwards, "account_id", "left").join(cycles, "account_id", "left")
    return out.na.fill({"forward_count": 0, "forwarded_amount": 0.0, "dwell_mean": -1.0, "cycle_count": 0})


def chain_details(chain_paths: DataFrame, min_hops: int = 3, limit: int | None = None) -> DataFrame:
    """Chains of at least ``min_hops`` that do not return to their own path, earliest first.

    All of them, or the first ``limit`` if a caller asks for a page.
    """
    rows = chain_paths.where((F.col("depth") >= min_hops) & ~F.array_contains("path", F.col("account"))).select(
        F.col("members").alias("chain_path"), F.col("depth").alias("hops"), F.col("t").alias("end_time"),
        dbl("amount").alias("amount"), "tx")
    return rows if limit is None else rows.orderBy("end_time", "tx").limit(limit)


def circular_accounts(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Accounts on any traced loop."""
    both = fast.select("account_id", "cycle_count").unionByName(slow.select("account_id", "cycle_count"))
    return both.where("cycle_count > 0").select("account_id").distinct()


def chain_accounts(fast: DataFrame, slow: DataFrame, min_fast: int = 3, min_slow: int = 4) -> DataFrame:
    """Accounts on a long enough chain in either pass, with the longest length seen."""
    f = fast.select("account_id", F.col("chain_length").alias("f"))
    s = slow.select("account_id", F.col("chain_length").alias("s"))
    both = f.join(s, "account_id", "full").na.fill(0, ["f", "s"])
    return both.where((F.col("f") >= min_fast) | (F.col("s") >= min_slow)).select(
        "account_id", F.greatest("f", "s").alias("chain_length"))
