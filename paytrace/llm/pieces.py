"""SentencePiece encoding and decoding with numpy, for models of merged pieces with byte fallback.

Texts are cut into words wherever two neighbouring characters occur together in no piece. Each distinct word
gets a Viterbi pass: all new words of one length advance together, one end position at a time; hashes of the substrings that end there probe the sorted keys of all pieces; a found piece is a
candidate if merging by rank would leave it and the best last piece before it side by side; the longest
candidate and its length are kept as state and backpointer. For every prefix exactly one piece passes that
test, so the path read back from the end is what merging pair by pair gives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paytrace.llm.common import mix, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GAP = "▁"  # stands for a space
GAP_CODE = ord(GAP)
CHARS = 1_000_000  # characters whose words are looked up together, unless one text alone is longer
CACHE = 200_000  # words whose pieces a task remembers
DIRECT = 1 << 10  # code points below are looked up in square tables
SIEVE = 1 << 20
MEMO = 1 << 21
NEVER = 1 << 40
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))


@dataclass
class Pieces:
    """Arrays of one model; its size is that of the vocabulary."""

    names: list[str]
    byte_ids: np.ndarray
    is_byte: np.ndarray
    is_text: np.ndarray  # pieces that stand for characters
    rank: np.ndarray  # order of merging, -1 for single characters
    left: np.ndarray
    right: np.ndarray
    keys: np.ndarray  # sorted hashes of the pieces that merging can produce
    key_ids: np.ndarray
    longest: int
    pair_keys: np.ndarray  # left id * size + right id
    pair_ranks: np.ndarray
    ids: dict[str, int]
    gap_ids: dict[int, int]  # runs of spaces
    sieve: np.ndarray  # which low bits occur among ``keys``
    near: np.ndarray  # pairs of low code points that are neighbours in a piece
    far: np.ndarray  # the same for all code points, as sorted numbers
    memo: np.ndarray  # pairs of pieces tested before, by a hash; bit 0 holds the result
    words: dict[int, int] = field(default_factory=dict)  # by hash, of the words met so far
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))


def _key_table(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums of rows of code points."""
    n, length = codes.shape
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(length, _RADIX)]))[:length]
    out = np.zeros((n, length + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power, axis=1, out=out[:, 1:])
    return out


def _keys_between(table: np.ndarray, start: int, end: int) -> np.ndarray:
    undo = np.uint64(pow(int(_INVERSE), start, 1 << 64))
    return mix((table[:, end] - table[:, start]) * undo + np.uint64(end - start))


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def merge(symbols: list[str], ranks: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Merges neighbours by rank, leftmost first, until no pair is known; the result and the last pair merged."""
    parts: list[str | None] = list(symbols)
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < len(parts) and (joined := parts[i] + parts[j]) in ranks:
            heapq.heappush(heap, (ranks[joined], i, j, joined))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    last = None
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != joined:
            continue
        last = (parts[i], parts[j])
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p is not None], last


def load(path: str = MODEL) -> Pieces:
    """Reads a model file; it must merge pieces, fall back to bytes, mark spaces and leave characters as they are."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap
            or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces):
        raise ValueError(f"{path} is not a byte-fallback merge model without normalisation")
    names = [p.piece for p in model.pieces]
    kind = np.array([p.type for p in model.pieces])
    size = len(names)
    is_byte, is_text = kind == 6, kind == 1
    byte_ids = np.zeros(256, np.int32)
    for i in np.flatnonzero(is_byte):
        byte_ids[int(names[i][1:-1], 16)] = i
    scores = np.array([p.score for p in model.pieces])
    spaces = np.array([set(n) == {GAP} and len(n) > 1 for n in names])
    by_score = sorted(np.flatnonzero(is_text & ~spaces), key=lambda i: (-scores[i], i))
    ids = {names[i]: int(i) for i in np.flatnonzero(is_text)}
    rank = np.full(size + 1, -1, np.int64)
    ranks: dict[str, float] = {}
    for at, i in enumerate(by_score):
        if len(names[i]) > 1:
            rank[i] = at
            ranks[names[i]] = at
    left, right = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
    reached, pairs = [], {}
    for i in by_score:
        name = names[i]
        for cut in range(1, len(name)):
            a, b = ids.get(name[:cut]), ids.get(name[cut:])
            if a is not None and b is not None:
                pairs[a * (size + 1) + b] = rank[i]
        if len(name) == 1:
            reached.append(i)
            continue
        parts, last = merge(list(name), ranks)
        if parts == [name] and last[0] in ids and last[1] in ids:
            left[i], right[i] = ids[last[0]], ids[last[1]]
            reached.append(i)
    keys = np.concatenate([_keys_between(_key_table(_codes([names[i]], len(names[i]))), 0, len(names[i])) for i in reached])
    order = np.argsort(keys)
    pair_keys = np.array(sorted(pairs), np.int64)
    gaps = {len(names[i]): int(i) for i in np.flatnonzero(spaces & is_text)}
    sieve = np.zeros(SIEVE, bool)
    sieve[(keys & np.uint64(SIEVE - 1)).astype(np.int64)] = True
    neighbours = np.array(sorted({(ord(a) << 21) | ord(b) for i in reached for a, b in zip(names[i], names[i][1:])}), np.int64)
    near = np.zeros((DIRECT, DIRECT), bool)
    low = neighbours[((neighbours >> 21) < DIRECT) & ((neighbours & 0x1FFFFF) < DIRECT)]
    near[low >> 21, low & 0x1FFFFF] = True
    return Pieces(names, byte_ids, is_byte, is_text, rank, left, right, keys[order], np.array(reached)[order],
                  max(len(names[i]) for i in reached), pair_keys, np.array([pairs[k] for k in pair_keys.tolist()], np.int64),
                  ids, gaps, sieve, near, neighbours, np.full(MEMO, -1, np.int64))


def _pair_rank(m: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a * (len(m.names) + 1) + b
    at = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
    return np.where(m.pair_keys[at] == key, m.pair_ranks[at], NEVER)


def compatible(m: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``side_by_side``, remembered in a table of fixed size."""
    pair = (a * (len(m.names) + 1) + b) * 2
    slot = (mix(pair.astype(np.uint64)) & np.uint64(MEMO - 1)).astype(np.int64)
    held = m.memo[slot]
    ok = (held & 1).astype(bool)
    new = np.flatnonzero((held & ~1) != pair)
    ok[new] = side_by_side(m, a[new], b[new])
    m.memo[slot[new]] = pair[new] | ok[new]
    return ok


def side_by_side(m: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves ``a`` and ``b`` side by side.

    Both are taken apart from the boundary outwards, the later merge first. Two pieces that met at the
    boundary must not have had a merge of their own that ranks before the merge that was just undone.
    """
    ok = np.ones(len(a), bool)
    a, b, live = a.copy(), b.copy(), np.arange(len(a))
    limit = np.full(len(a), NEVER, np.int64)
    while len(live):
        x, y = a[live], b[live]
        clash = _pair_rank(m, x, y) < limit[live]
        ok[live[clash]] = False
        live, x, y = live[~clash], x[~clash], y[~clash]
        rx, ry = m.rank[x], m.rank[y]
        whole = (rx < 0) & (ry < 0)
        live, x, y, rx, ry = live[~whole], x[~whole], y[~whole], rx[~whole], ry[~whole]
        undo_left = rx > ry
        limit[live] = np.where(undo_left, rx, ry + 1)
        a[live] = np.where(undo_left, m.right[x], x)
        b[live] = np.where(undo_left, y, m.left[y])
    return ok


def _find(m: Pieces, keys: np.ndarray) -> np.ndarray:
    """Piece of each key, the number behind the last piece where there is none."""
    out = np.full(len(keys), len(m.names), np.int64)
    rows = np.flatnonzero(m.sieve[(keys & np.uint64(SIEVE - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(m.keys, keys[rows]), len(m.keys) - 1)
    out[rows] = np.where(m.keys[at] == keys[rows], m.key_ids[at], len(m.names))
    return out


def _viterbi(m: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words of one length, one word a row of ``codes``: all ids in a row, and the number of each word's."""
    unknown = len(m.names)
    n, length = codes.shape
    table = _key_table(codes)
    last = np.full((length + 1, n), -1, np.int64)
    back = np.ones((length + 1, n), np.int64)
    for end in range(1, length + 1):
        for width in range(1, min(end, m.longest) + 1):
            start = end - width
            piece = _find(m, _keys_between(table, start, end))
            rows = np.flatnonzero((piece < unknown) & ((last[start] >= 0) if start else True)) if width > 1 else np.arange(n)
            if start and len(rows):
                before, here = last[start, rows], piece[rows]
                fits = before >= 0
                known = fits & (before < unknown) & (here < unknown)
                fits[known] = compatible(m, before[known], here[known])
                rows = rows[fits]
            last[end, rows] = piece[rows]
            back[end, rows] = width
    path, every, ends = [], np.arange(n), np.full(n, length)
    while (ends > 0).any():
        path.append(np.where(ends > 0, last[ends, every], -2))
        ends = ends - np.where(ends > 0, back[ends, every], 0)
    found = np.stack(path[::-1], axis=1)
    odd = np.flatnonzero((found == unknown).any(axis=1) | (found == -1).any(axis=1))
    used = found >= 0
    if not len(odd):
        return found[used], used.sum(axis=1)
    rows = [r[u] for r, u in zip(found, used)]
    for i in odd:
        rows[i] = np.array(_spelled(m, "".join(map(chr, codes[i])), rows[i] if (found[i] != -1).all() else None), np.int64)
    return np.concatenate(rows), np.array([len(r) for r in rows])


def _spelled(m: Pieces, word: str, path: np.ndarray | None) -> list[int]:
    """Ids of a word with characters outside the vocabulary, which become bytes. Without a path it is merged pair by pair."""
    if path is None:
        parts, _ = merge(list(word), {m.names[k]: m.rank[k] for k in np.flatnonzero(m.rank >= 0)})
    else:
        parts, at = [], 0
        for k in path.tolist():
            parts.append(word[at:at + (len(m.names[k]) if k < len(m.names) else 1)])
            at += len(parts[-1])
    return [k for p in parts for k in ([m.ids[p]] if p in m.ids else m.byte_ids[list(p.encode())].tolist())]


def _learn(m: Pieces, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of distinct words in the task's table, to which the new ones are added."""
    if len(m.words) > CACHE:
        m.words, m.starts, m.counts, m.flat = {}, m.starts[:0], m.counts[:0], m.flat[:0]
    names = hashes.tolist()
    new = np.array([i for i, h in enumerate(names) if h not in m.words], np.int64)
    length = (ends - starts)[new]
    order = np.argsort(length, kind="stable")
    new, length = new[order], length[order]
    flats, counts = [m.flat], [m.counts]
    known = len(m.words)
    at = 0
    while at < len(new):
        step = max(1, 1_000_000 // (int(length[at]) * 8))
        until = min(at + step, int(np.searchsorted(length, length[at], "right")))
        rows = new[at:until]
        ids, n = _viterbi(m, codes[starts[rows][:, None] + np.arange(length[at])])
        flats.append(ids.astype(np.int32))
        counts.append(n.astype(np.int64))
        at = until
    m.words.update(zip(hashes[new].tolist(), range(known, known + len(new))))
    m.flat, m.counts = np.concatenate(flats), np.concatenate(counts)
    m.starts = np.cumsum(m.counts) - m.counts
    return np.array([m.words[h] for h in names], np.int64)


def _gaps(m: Pieces, n: int) -> list[int]:
    """Pieces of a run of ``n`` spaces that nothing else merged with: all runs rank alike, so the leftmost merge wins."""
    if n <= 1:
        return [m.ids[GAP]] * n
    parts, _ = merge([GAP] * n, {GAP * k: 0.0 for k in m.gap_ids})
    return [m.gap_ids.get(len(p), m.ids[GAP]) for p in parts]


def _boundaries(m: Pieces, codes: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character but the first of all."""
    a, b = codes[:-1], codes[1:]
    low = (a < DIRECT) & (b < DIRECT)
    joined = m.near[np.where(low, a, 0), np.where(low, b, 0)] & low
    rest = np.flatnonzero(~low)
    key = (a[rest].astype(np.int64) << 21) | b[rest]
    at = np.minimum(np.searchsorted(m.far, key), len(m.far) - 1)
    joined[rest] = (m.far[at] == key) & (b[rest] != GAP_CODE)  # a space begins a word, also after a space
    return ~joined


def encode(m: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the index of each text's first id. Null reads as empty."""
    codes = np.frombuffer("".join(GAP + t for t in texts if t).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes = np.where(codes == 32, np.uint32(GAP_CODE), codes)
    begins = np.ones(len(codes), bool)
    begins[1:] = _boundaries(m, codes)
    begins[edge[:-1][size > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(codes))
    hashes, one, which = np.unique(span_hash(mix(codes.astype(np.uint64) + np.uint64(1)), starts, ends), return_index=True,
                                   return_inverse=True)
    at = _learn(m, hashes, codes, starts[one], ends[one])[which]
    n = m.counts[at]
    behind = np.concatenate([[0], np.cumsum(n)])
    out = m.flat[np.arange(behind[-1]) - np.repeat(behind[:-1] - m.starts[at], n)]
    first = behind[np.searchsorted(starts, edge)]
    gap = m.ids[GAP]
    if not ((out[1:] == gap) & (out[:-1] == gap)).any():
        return out, first
    parts = [_join_gaps(m, out[a:b]) for a, b in zip(first[:-1], first[1:])]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _join_gaps(m: Pieces, ids: np.ndarray) -> np.ndarray:
    """Replaces spaces in a row that merged with nothing else by the pieces of runs."""
    gap = ids == m.ids[GAP]
    if not (gap[1:] & gap[:-1]).any():
        return ids
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gap, [False]]).astype(np.int8)))
    parts, at = [], 0
    for a, b in edges.reshape(-1, 2):
        parts += [ids[at:a], np.array(_gaps(m, int(b - a)), np.int32)]
        at = b
    return np.concatenate([*parts, ids[at:]])


def decode(m: Pieces, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """Text of each run of ids; ids that stand for no text give nothing, broken bytes a replacement character."""
    spelled = [n.replace(GAP, " ").encode() if t else b"" for n, t in zip(m.names, m.is_text)]
    for value, k in enumerate(m.byte_ids.tolist()):
        spelled[k] = bytes([value])
    size = np.array([len(s) for s in spelled], np.int64)
    table = np.frombuffer(b"".join(spelled), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    n = size[ids]
    behind = np.concatenate([[0], np.cumsum(n)])
    data = table[np.arange(behind[-1]) - np.repeat(behind[:-1] - start[ids], n)].tobytes()
    ends = behind[first]
    texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
    return [t[1:] if t.startswith(" ") else t for t in texts]


def _slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts or lists have about ``limit`` entries together."""
    lengths = pc.utf8_length if pa.types.is_string(batch.column(column).type) else pc.list_value_length
    total = np.cumsum(pc.fill_null(lengths(batch.column(column)), 0).to_numpy())
    row = 0
    while row < batch.num_rows:
        done = total[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(row, end - row)
        row = end


def encode_documents(documents: DataFrame, path: str = MODEL, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, n_pieces, ids and round_trip (the ids decode to the text; U+2581 reads as a space) per row.

    Null and empty texts have no ids and round_trip true. The model file is read once, on the driver;
    tasks get its arrays. Repeated rows get equal ids; an empty table gives an empty result.
    """
    held = documents.sparkSession.sparkContext.broadcast(load(path))
    given = documents.select(*columns, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in _slices(batch, len(columns), CHARS):
                texts = part.column(len(columns)).to_pylist()
                ids, first = encode(m, texts)
                same = [a == (b or "").replace(GAP, " ") for a, b in zip(decode(m, ids, first), texts)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(columns))], pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))),
                     pa.array(same, pa.bool_())], names=[*columns, "n_pieces", "ids", "round_trip"])

    schema = documents.select(*columns, F.lit(0).cast("long").alias("n_pieces"), F.array(F.lit(0)).alias("ids"),
                              F.lit(True).alias("round_trip")).schema
    return given.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with ``ids``; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in _slices(batch, 1, CHARS):
                runs = part.column(1)
                flat = runs.flatten().to_numpy(zero_copy_only=False)
                sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
                texts = decode(m, flat, np.concatenate([[0], np.cumsum(sizes)]))
                known = pc.is_valid(runs).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t if k else None for t, k in zip(texts, known)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")
