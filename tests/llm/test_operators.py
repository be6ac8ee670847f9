"""Brute-force twins, held-out accuracy and round trips of the text operators on small tables."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

import corpus_pipeline
from paytrace.llm import extract, langid, masked_lm, mixing, neardup, neighbours, pieces, quality, shards, toxicity
from paytrace.llm.common import stored
from paytrace.llm.queries import QUERIES

from ..conftest import SF
from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def words(seed, n, vocabulary=4_000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def groups_of(rows):
    """Smallest reachable doc_id by comparing all pairs of full shingle sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    best = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return {(i, len(sets[i]), best[i], best[i] == i) for i in sets}


def test_near_duplicates_match_all_pairs(docs):
    draw = random.Random(1)
    rows, passage = [], words(0, 60)
    for base in range(12):
        text = words(base + 100, draw.choice([4, 5, 9, 30, 120, 400]))
        for _ in range(draw.choice([1, 2, 3])):
            copy = [w if draw.random() > 0.01 else "x" + w for w in text]
            rows.append((len(rows), " ".join(copy).upper() if draw.random() < 0.3 else "\n".join(copy)))
    chain = words(7, 200)  # every copy of the copy before: ends that are not similar are still connected
    for step in range(12):
        chain = [w if i % 200 != (step * 17) % 200 else f"c{step}" for i, w in enumerate(chain)]
        rows.append((len(rows), " ".join(chain)))
    for k in range(30):  # a passage that many share, in texts that differ
        rows.append((len(rows), " ".join(words(k + 500, 25) + passage)))
    for _ in range(25):  # a large group of near copies
        copy = list(passage) * 3
        copy[draw.randrange(180)] = f"n{draw.random()}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    got = neardup.components(docs(rows))
    assert set(rows_of(got, "doc_id", "n_shingles", "component_id", "kept")) == groups_of(rows)


def test_lists_of_unlike_members_end(docs, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS_PER_ROW", 0)  # every round compares with a few hubs only
    passage = words(3, 90)
    rows = [(k, " ".join(passage + words(k + 50, 25))) for k in range(40)]
    rows += [(k + 40, " ".join(passage + words(k + 50, 25)[:-1] + ["end"])) for k in range(40)]
    got = neardup.components(docs(rows))
    assert set(rows_of(got, "doc_id", "n_shingles", "component_id", "kept")) == groups_of(rows)


def test_members_of_many_long_lists_meet_once(spark, monkeypatch):
    """Two members are compared in the first of their long lists, in all rounds together; a short list loses nothing."""
    from paytrace.llm import neardup
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "LONG_LIST", 10)
    lists = {1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [1, 2, 3, 4, 5], 4: [2, 5], 5: [2, 5]}
    rows = [(value, i, 100, 90, 0, i / 10, True, len(ids), len(ids), None) for value, ids in lists.items() for i in ids]
    left = neardup._with_own_lists(spark.createDataFrame(
        rows, "value long, id long, n long, met int, first long, u double, stray boolean, strays long, members long, of_first int"))
    assert left.count() == len(rows)
    assert {tuple(r.own) for r in left.where("value <= 3 AND id < 5").collect()} == {(1, 2, 3)}
    assert left.where("value > 3 AND own IS NOT NULL").isEmpty()
    hubs = left.select(F.col("value").alias("v"), F.col("id").alias("hid"), F.col("n").alias("hn"), F.col("met").alias("hmet"),
                       F.col("of_first").alias("hof_first"), F.col("own").alias("hown"))
    met = [tuple(r) for r in neardup._meetings(left, hubs, F.col("id") < F.col("hid"), neardup.Limit(80)).collect()]
    assert sorted(met) == sorted([*((a, b) for a in range(1, 6) for b in range(a + 1, 6)), (2, 5), (2, 5)])


def test_near_duplicates_about_as_wide_as_the_sketch(docs):
    draw, rows = random.Random(8), []
    for n in (740, 780, 830, 871, 900, 925, 952, 1_000, 1_060, 1_100):
        for share in (0.853, 0.867, 0.89, 0.93):
            text = words(len(rows) + 900, n + 4, 1 << 30)
            rows.append((len(rows), " ".join(text)))
            rows.append((len(rows), " ".join(text[:math.ceil(n * share) + 4])))  # a cut copy
            edited = list(text)  # and one of equal length, each edit changes up to five shingles
            for at in draw.sample(range(n), int(n * (1 - share) / 10)):
                edited[at] = f"e{at}"
            rows.append((len(rows), " ".join(edited)))
    got = neardup.components(docs(rows))
    assert set(rows_of(got, "doc_id", "n_shingles", "component_id", "kept")) == groups_of(rows)


def test_near_duplicates_odd(odd, nothing):
    got = neardup.components(odd)
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} >= {(None, None, True), (1, 1, True), (4, 4, True), (5, 4, False)}
    assert neardup.components(nothing).count() == 0
    kept = neardup.keep(odd)
    assert kept.columns == odd.columns
    assert rows_of(kept, "doc_id") == sorted([(None,), (None,), (1,), (2,), (3,), (4,), (6,), (7,), (8,), (9,)], key=repr)


def test_one_doc_id_with_unlike_texts_loses_neither(docs):
    a, b, c = (" ".join(words(k, 60)) for k in (1, 2, 3))
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (9, c), (9, " ".join(words(4, 50))), (9, c), (11, b), (None, a), (None, a)]
    kept = rows_of(neardup.keep(docs(rows)), "doc_id", "text")
    assert [r for r in kept if r[0] is None] == [(None, a)] * 2
    left = [t for i, t in kept if i is not None]
    assert (1, a) in kept and (5, a) not in kept and sum(t in (b, b + " more") for t in left) == 1
    assert sorted(left) == sorted({a, c, rows[5][1], next(t for t in left if t.startswith(b))})
    assert (2**63 - 1, a) in rows_of(neardup.keep(docs([(2**63 - 1, a), (2**63 - 1, b)])), "doc_id", "text")


def test_limits_of_other_similarities(docs):
    assert neardup.Limit(85) == neardup.Limit() and (neardup.Limit().at_k, neardup.Limit().at_wide) == (15, 808)
    text, rows = words(70, 304, 1 << 30), []  # 300 shingles; a copy cut to 246 has 0.82 of them
    rows = [(1, " ".join(text)), (2, " ".join(text[:250])), (3, " ".join(text[:240] + words(71, 64, 1 << 30)))]
    assert rows_of(neardup.components(docs(rows), 80), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]
    assert rows_of(neardup.components(docs(rows)), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 3)]
    assert rows_of(neardup.keep(docs(rows), 80), "doc_id") == [(1,), (3,)]


def test_shards_tell_sources_with_a_common_start_apart(docs):
    rows = [(i, "x" * 100, "en", f"https://host-{i % 8}.example") for i in range(800)]
    got = shards.place(docs(rows)).toPandas()
    source = {i: s for i, _, _, s in rows}
    mixed = got.groupby("curve")["doc_id"].agg(lambda ids: len({source[i] for i in ids}))
    assert (mixed == 1).all() and got.groupby("shard")["doc_id"].agg(lambda ids: len({source[i] for i in ids})).max() <= 2


def test_shards(docs, odd, nothing):
    assert shards.place(nothing).count() == 0
    for table, n in ((docs([(i, "x" * (i % 50), "en", f"s{i % 3}") for i in range(500)]), 500), (odd, len(odd_rows()))):
        got = shards.place(table).toPandas()
        assert len(got) == n
        counts = got.groupby("shard")["slot"].agg(["count", "min", "max"])
        assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()
        assert counts["count"].max() - counts["count"].min() <= 1
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id}
    for r in shards.place(odd).where("doc_id IS NOT NULL").collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))


def test_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    cells = spark.range(4096).select(*[F.shiftright("id", 4 * d).bitwiseAND(F.lit(15)).cast("int").alias(c) for d, c in enumerate("abc")])
    path = cells.select("a", "b", "c", shards.curve_index([F.col(c) for c in "abc"]).alias("h")).orderBy("h").collect()
    assert [r.h for r in path] == list(range(4096))
    assert all(sum(abs(p[i] - q[i]) for i in range(3)) == 1 for p, q in zip(path, path[1:]))


def test_mixing_meets_targets(docs, odd, nothing):
    assert mixing.balance(nothing).count() == 0
    rows = [(i, " ".join(words(i, 1 + i * 7 % 90)), "en", f"s{i % 7 if i % 3 else 0}") for i in range(900)]
    got = mixing.balance(docs(rows)).toPandas()
    again = mixing.balance(docs(rows).repartition(7)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), own=("size", "sum"))
    assert (abs(sums["taken"] - sums["target"]) <= 0.01 * sums["target"] + 90).all()
    assert math.isclose(sums["target"].sum(), sums["own"].sum(), rel_tol=1e-12)
    assert (sums["target"] <= 3 * sums["own"]).all() and (got["taken"] <= 3 * got["size"]).all()
    weights = dict(zip(sorted(sums.index), itertools.cycle((5, 2, 1))))
    left, open_, want = sums["own"].sum(), set(weights), {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if share * weights[s] > 3 * sums["own"][s]}
        for s in over or open_:
            want[s] = 3 * sums["own"][s] if over else share * weights[s]
        left -= sum(want[s] for s in over)
        open_ = open_ - over if over else set()
    assert all(math.isclose(want[s], sums["target"][s], rel_tol=1e-9) for s in want)
    repeated = mixing.repeat(docs(rows))
    assert repeated.count() == got["copies"].sum() and repeated.columns == docs(rows).columns
    assert len(mixing.balance(odd).collect()) == len(odd_rows())
    assert mixing.repeat(odd).columns == odd.columns


def test_quality_counts(docs, odd, nothing):
    assert quality.judge(nothing).count() == 0
    line = "Copyright all rights reserved by the owners of this site for ever and ever and so on until the very last day"
    rows = [(i, "\n".join([" ".join(words(i, 30)), line, "Other"])) for i in range(60)]
    rows += [(60 + i, line.upper() + f"\nend{i} x") for i in range(5)]
    rows += [(70, "a b c d e f g h " * 6), (71, "#*$ %&|<> [x]"), (72, None)]
    got = {r.doc_id: r for r in quality.judge(docs(rows)).collect()}
    for i, text in rows:
        w = WORD.findall(text or "")
        used = [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for p in range(k, k + 8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(used) - len(set(used)), len(covered))
        assert tuple(got[i][m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i].base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in got if i >= 60)
    assert all(not got[60 + i].base_failed for i in range(5))  # rejected for what is left without the common line
    kept = quality.keep(odd)
    assert kept.columns == odd.columns
    assert rows_of(kept, "doc_id") == sorted([(None,), (4,), (4,), (5,), (7,)], key=repr)


def test_common_lines_leave_the_text(docs):
    line = "Copyright all rights reserved"
    rows = [(i, "\n".join([" ".join(words(i, 15)), f" {line.upper()}", "", f"Own {i}", line, " ".join(words(i + 99, 15))])) for i in range(40)]
    rows += [(40, " ".join(words(300, 30)) + "\nno such\tline\n"), rows[0]]
    got = quality.keep(docs(rows)).collect()
    want = [(i, "\n".join(x for x in text.split("\n") if x.strip().lower() != line.lower())) for i, text in rows]
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_language_held_out(spark, odd, nothing):
    got = langid.languages(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    both = both[both["held_out"]]
    assert (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (both["lang_pred"] == both["lang"]).mean() > 0.9
    assert got["score"].between(0, 1).all()
    assert langid.languages(nothing).count() == 0
    named = langid.languages(odd.select("doc_id", "text", "lang"))
    assert {r.doc_id: r.lang_pred for r in named.collect() if r.doc_id in (1, 2, 3, 9)} == dict.fromkeys((1, 2, 3, 9), "und")
    assert langid.keep(odd).columns == odd.columns


def test_language_keeps_like_and_rare_labels(docs):
    labels = ["en", "en-AU", "en-GB", "en-NZ", "en-US", "en-ZA"]  # one language under six names
    rows = [(i, " ".join(f"{w}lish" for w in words(i, 40, 300)), labels[i % 6]) for i in range(300)]
    rows += [(300 + i, f"слово{i} текст{i}", f"rare{i}") for i in range(300)]  # more labels than 256, of one short text each
    rows += [(600, "".join(random.Random(9).choices("abcdefghijkmnopqrtuvxyz ", k=400)), "en"), (601, "12 -- 34", "en")]
    assert rows_of(langid.keep(docs(rows)), "doc_id") == sorted([(i,) for i in range(600)], key=repr)
    assert len(langid.train(docs(rows)).langs) > 200


def test_toxicity_held_out(docs, spark, nothing):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        text = words(i, draw.randrange(20, 120), 800)
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            text.insert(draw.randrange(len(text)), draw.choice(["horrid", "vile", "nasty"]) + draw.choice(["", "ly", "ness"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "vile nasty horrid")]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.rate_documents(docs(rows), marks).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    held = got[got["held_out"] & got["doc_id"].lt(1200)]
    hit = held["predicted"] == (held["doc_id"] % 5 == 0)
    assert hit.mean() > 0.97
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert toxicity.rate_documents(nothing, marks).count() == 0
    unlabelled = toxicity.rate_documents(docs(rows[:5]), marks.where("false"))
    assert [r.score for r in unlabelled.collect()] == [0.5] * 5


def test_masked_model_beats_word_shares(docs, nothing, odd):
    draw = random.Random(4)
    rows = []
    for i in range(300):
        start, text = draw.randrange(40), []
        for k in range(120):
            text.append(f"t{(start + k) % 40}")
        rows.append((i, " ".join(text)))
    table = docs(rows)
    known = masked_lm.vocabulary(table)
    trained = masked_lm.train(table, known)
    plain = masked_lm.score(table, known, masked_lm.start_weights(known)).groupBy().avg("per_token").first()[0]
    learned = masked_lm.score(table, known, trained).groupBy().avg("per_token").first()[0]
    assert plain == pytest.approx(-math.log(40), abs=0.1)
    assert learned > plain + 1
    shuffled = docs([(0, " ".join(draw.sample(rows[0][1].split(), 120)))])
    assert masked_lm.score(shuffled, known, trained).first()["per_token"] < learned - 0.5
    assert masked_lm.score_documents(nothing).count() == 0
    got = {r.doc_id: r for r in masked_lm.score_documents(odd).collect()}
    assert len(got) == len({r[0] for r in odd_rows()})
    assert (got[1].n_tokens, got[1].log_likelihood, got[1].per_token) == (0, 0.0, None)


def test_chances_sum_to_one():
    known = masked_lm.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full(masked_lm.SIZE, 1 / masked_lm.SIZE))
    w = {k: v + np.random.default_rng(1).normal(0, 0.3, v.shape).astype(np.float32) for k, v in masked_lm.start_weights(known).items()}
    context = np.tile(np.array([[1, 5, 9, masked_lm.EDGE]]), (masked_lm.SIZE, 1))
    assert np.exp(masked_lm.log_chances(w, np.arange(masked_lm.SIZE), context)).sum() == pytest.approx(1, abs=1e-4)


def test_neighbours_recall(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(30, 24))
    vectors = centres[draw.integers(0, 30, 1500)] + 0.6 * draw.normal(size=(1500, 24))
    vectors[100:160] = vectors[100]  # a group of equal vectors
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(3000, None, 0), (3050, [0.0] * 24, 0), (3100, [float("nan")] * 24, 0), (3150, [1.0] * 23 + [float("inf")], 0), (None, rows[0][1], 0),
             (3200, [1.0, None], 0), (3250, [], 0), rows[50]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    for q, found in got.items():
        like = unit @ unit[q]
        like[q] = -2
        best = np.lexsort((np.arange(1500), -like.round(12)))[:5]
        hits += len(set(best.tolist()) & {v for v, _ in found})
        assert all(s == pytest.approx(like[v], abs=1e-12) for v, s in found)
    assert hits / (5 * len(got)) >= 0.9
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105] and [v for v, _ in got[150]] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0)], "vec_id long, embedding array<double>, rank int")
    assert rows_of(neighbours.nearest(few), "query_id", "rank", "vec_id") == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(few.where("false")).count() == 0
    assert neighbours.nearest(few.where("vec_id = 0")).count() == 0


def test_pieces_equal_the_library(spark, odd, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    draw = random.Random(5)
    texts = ["", " ", "   ", " a", "a   b", "a  ", "\n", "x\x00y", "𝄞 𝄞", "  𝄞", "<s> <0x0A> ▁", "a" * 40, "=" * 33, "tttt", " " * 40 + "y", "世界 日本"]
    texts += ["".join(draw.choice("abcdeéñ \n\t▁tionghes世ü0123и") for _ in range(draw.randrange(60))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    model = pieces.load()
    ids, first = pieces.encode(model, [*texts, None])
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [*library.encode(texts), []]
    assert pieces.decode(model, ids, first) == [t.replace("▁", " ") for t in texts] + [""]
    got = pieces.encode_documents(odd)
    assert got.where("NOT round_trip").count() == 0 and got.count() == len(odd_rows())
    assert set(rows_of(pieces.decode_documents(got).where("doc_id > 3"), "doc_id", "text")) == {r[:2] for r in odd_rows() if (r[0] or 0) > 3}
    assert pieces.encode_documents(nothing).count() == 0


def test_side_by_side_is_merging():
    model = pieces.load()
    draw = np.random.default_rng(6)
    some = model.key_ids[draw.integers(0, len(model.key_ids), (3000, 2))]
    ranks = {model.names[i]: int(model.rank[i]) for i in np.flatnonzero(model.rank >= 0)}
    for (a, b), ok in zip(some, pieces.side_by_side(model, some[:, 0], some[:, 1])):
        assert ok == (pieces.merge(list(model.names[a] + model.names[b]), ranks)[0] == [model.names[a], model.names[b]])


def _page(path, body):
    return f"http://h.example/{path}", f"<html><head><title>t</title><script>var a='<p>';</script></head><body>{body}</body></html>"


def test_main_text(spark):
    menu = "<p>Home page of us</p><div>Our menu</div>"
    pages = [
        _page("a/1", f"{menu}<p>First text &amp; more</p><p>Copyright us</p>"),
        _page("a/2", f"{menu}<p>Second text</p><p>Copyright us</p>"),
        _page("b/1", "<nav><ul><li>x</li></ul></nav><div class='ad'>buy</div><article><h1>Head</h1><p><b>One\n two<br><p>Three</p>"
                     "<div class='comments'>me</div><form>f</form></article><footer>&copy;</footer>"),
        _page("b/2", "<article><h1>Head</h1><p>Other</p></article><aside>s</aside>"),
        _page("c/1", "<p>Same</p>"), _page("c/1", "<p>Same</p>"), (None, "<p>no url</p>"), ("http://x/", None), ("http://x/1", ""),
    ]
    rows = [(i, *p, 1) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, n_chars int")).collect()}
    assert got[0] == "First text & more" and got[1] == "Second text"
    assert got[2] == "Head\n\nOne two\n\nThree" and got[3] == "Head\n\nOther"
    assert got[4] == got[5] == "Same" and got[6] == "no url" and got[7] == got[8] == ""
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extract(empty).count() == 0


def test_main_text_differences_every_page(spark):
    """Lines that nothing marks: beside a small article card, past copies of the page, inside of a page with an article."""
    menu = "<div>Start</div><div>All of our departments and their opening hours</div>"
    card = "<article><p>Read next</p></article>"
    long = "<article><h1>Title</h1><p>{}</p><p>The.</p></article>"
    pages = [
        _page("a/1", f"{menu}<p>What this page is about, in some words</p>{card}<p>Imprint</p>"),
        _page("a/2", f"{menu}<p>Something else altogether, and not short</p>{card}<p>Imprint</p>"),
        _page("b/1", "<div>Top</div><p>Copied</p>"), _page("b/2", "<div>Top</div><p>Copied</p>"), _page("b/3", "<div>Top</div><p>Copied</p>"),
        _page("b/4", "<div>Top</div><p>Original</p>"),
        _page("c/1", f"{menu}{long.format('One')}<div>{'x' * 60}</div>"), _page("c/2", f"{menu}{long.format('Two, longer than all that stands around it, by far')}"),
    ]
    rows = [(i, *p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "What this page is about, in some words\n\nRead next"
    assert got[1] == "Something else altogether, and not short\n\nRead next"
    assert got[2] == got[3] == got[4] == "Copied" and got[5] == "Original"
    assert got[6] == f"Title\n\nOne\n\nThe.\n\n{'x' * 60}"
    assert got[7] == "Title\n\nTwo, longer than all that stands around it, by far\n\nThe."


def test_shared_lines_in_halves():
    draw = random.Random(8)
    for _ in range(300):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(40))] for _ in range(2))
        whole, halved = extract.shared_lines(a, b), extract.shared_lines(a, b, cells=16)
        assert len(whole) == len(halved)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in sorted(halved)))
    assert len(extract.shared_lines(list(range(20_000)), list(range(5, 20_005)))) == 19_995


def test_shared_lines_are_longest():
    draw = random.Random(7)
    for _ in range(400):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(10))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = extract.shared_lines(a, b)
        assert len(found) == table[-1][-1]
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in sorted(found)))


def test_train_step_equals_its_gradient_class_by_class():
    """One plain pass per position, over words of a few classes only and over all."""
    draw = np.random.default_rng(10)
    words = masked_lm.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full(masked_lm.SIZE, 1 / masked_lm.SIZE))
    for top in (3, masked_lm.SIZE):
        w = masked_lm.start_weights(words)
        w["word"] += draw.normal(0, 0.1, w["word"].shape).astype(np.float32)
        w["cls"] += draw.normal(0, 0.1, w["cls"].shape).astype(np.float32)
        past = {k: np.full(v.shape, 1e-2, np.float32) for k, v in w.items()}
        ids, context = draw.integers(0, top, 90), draw.integers(0, 9, (90, 2 * masked_lm.SIDE)).astype(np.int32)
        grads = {k: np.zeros(v.shape) for k, v in w.items()}
        for i, around in zip(ids, context):
            c, k = i % masked_lm.CLASSES, i // masked_lm.CLASSES
            h = np.tanh(w["bend"] + sum(w["look"][p, x] for p, x in enumerate(around)).astype(float))
            top_, low = (np.exp(logits - logits.max()) for logits in (w["cls"] @ h + w["cls0"], w["word"][c] @ h + w["word0"][c]))
            top_, low = top_ / top_.sum(), low / low.sum()
            top_[c] -= 1
            low[k] -= 1
            back = (top_ @ w["cls"] + low @ w["word"][c]) * (1 - h * h)
            grads["cls"] += np.outer(top_, h)
            grads["cls0"] += top_
            grads["word"][c] += np.outer(low, h)
            grads["word0"][c] += low
            grads["bend"] += back
            for p, x in enumerate(around):
                grads["look"][p, x] += back
        want = {k: w[k] - masked_lm.STEP * g / np.sqrt(1e-2 + g * g) for k, g in grads.items()}
        masked_lm.train_step(w, past, ids, context)
        for k, g in grads.items():
            assert np.allclose(w[k], want[k], atol=1e-4), k
            assert np.allclose(past[k], 1e-2 + g * g, rtol=1e-3, atol=1e-5), k
        calls = []

        class Counted(np.ndarray):
            def __array_ufunc__(self, ufunc, method, *given, **options):
                calls.append(ufunc)
                plain = [x.view(np.ndarray) if isinstance(x, Counted) else x for x in given]
                if "out" in options:
                    options["out"] = tuple(x.view(np.ndarray) if isinstance(x, Counted) else x for x in options["out"])
                return getattr(ufunc, method)(*plain, **options)

        masked_lm.train_step({k: v.view(Counted) for k, v in w.items()}, {k: v.view(Counted) for k, v in past.items()}, ids, context)
        assert len(calls) < 100  # no arithmetic on whole weights class by class


def test_one_sort_finds_the_words_of_all_tables(monkeypatch):
    """The tables of all positions are updated together, words that occur once and words that occur often."""
    draw = np.random.default_rng(3)
    words = masked_lm.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full(masked_lm.SIZE, 1 / masked_lm.SIZE))
    w = masked_lm.start_weights(words)
    w["word"] += draw.normal(0, 0.1, w["word"].shape).astype(np.float32)
    past = {k: np.full(v.shape, 1e-2, np.float32) for k, v in w.items()}
    before, held = w["look"].copy(), past["look"].copy()
    ids = draw.integers(0, masked_lm.SIZE, 60)
    context = np.where(draw.random((60, 2 * masked_lm.SIDE)) < 0.5, 7, draw.integers(0, masked_lm.SIZE + 1, (60, 2 * masked_lm.SIDE))).astype(np.int32)
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *given, **options: sorts.append(1) or plain(*given, **options))
    masked_lm.train_step(w, past, ids, context)
    assert len(sorts) == 2  # by class, and by table and word
    for p in range(2 * masked_lm.SIDE):
        moved = np.flatnonzero((w["look"][p] != before[p]).any(axis=1))
        assert set(moved) == set(context[:, p])
        assert set(np.flatnonzero((past["look"][p] != held[p]).any(axis=1))) == set(context[:, p])


def test_language_training_is_lean_in_the_driver(spark):
    """Cells reach the driver as columns, also in a session without Arrow for pandas."""
    draw = np.random.default_rng(9)
    texts = [(i, bytes(draw.integers(97, 123, 20_000, np.uint8)).decode(), "ab"[i % 2]) for i in range(8)]
    docs = spark.createDataFrame([(i + 100 * k, *row) for i, *row in texts for k in range(12)], "doc_id long, text string, lang string")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    tracemalloc.start()
    try:
        model = langid.train(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")
    assert model.langs == ["a", "b"] and (model.cells != 0).sum() > 100_000
    assert peak < 64e6


def test_pipeline(spark, odd):
    """The stages of the pipeline on odd rows, which every operator above also meets alone, and run() on the sample."""
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "language", "near_duplicates", "source_mix", "token_ids"]
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == odd.columns, name
    assert docs.count() >= 1
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out["round_trip"].all() and len(out) > 100
    judged = {r.doc_id for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    assert set(out["doc_id"]) <= judged


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
