import hashlib
import itertools
import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat, langid, lm, mixing, packing, sharding, toxicity
from gristmill.llm.wordbpe import load


def held_out(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


# --- language ID


def segmentations(word):
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        piece, out = word[0], []
        for c, cut in zip(word[1:], cuts, strict=True):
            if cut:
                out.append(piece)
                piece = c
            else:
                piece += c
        yield [*out, piece]


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "aba", "▁", "▁a", "▁ab", "ba"]
    model = langid.PieceModel.blank(pieces, ["p", "q"])
    rng = np.random.default_rng(1)
    model.probs = rng.dirichlet(np.ones(len(pieces) + 1), 2).T
    row = {p: int(np.searchsorted(model.keys, np.uint64(langid._hash_piece(p)))) for p in pieces}
    for word in ("ab", "aba", "abab", "xab", "b"):
        expect = np.zeros(2)
        for parts in segmentations("▁" + word):
            if all(p in row or len(p) == 1 for p in parts):
                expect += np.prod([model.probs[row.get(p, len(pieces))] for p in parts], axis=0)
        assert np.allclose(model.words([word])[0], np.log(expect))
    words, counts = ["ab", "abax", "bababab" * 2], np.array([[1.0, 2.0], [3.0, 0.0], [0.5, 1.0]])
    _, expected = model.forward(words, counts)
    brute = np.zeros_like(expected)
    for word, n in zip(words, counts, strict=True):
        ways = [[row.get(p, len(pieces)) for p in x] for x in segmentations("▁" + word) if all(p in row or len(p) == 1 for p in x)]
        weights = np.array([np.prod(model.probs[w], axis=0) for w in ways])
        for w, share in zip(ways, weights / weights.sum(0), strict=True):
            np.add.at(brute, w, share * n)
    assert np.allclose(expected, brute)


def test_long_words_are_summed_whole():
    pieces = ["a", "b", "ab", "aba", "▁", "▁a", "▁ab", "ba"]
    model = langid.PieceModel.blank(pieces, ["p", "q"])
    rng = np.random.default_rng(2)
    model.probs = rng.dirichlet(np.ones(len(pieces) + 1), 2).T
    row = {p: int(np.searchsorted(model.keys, np.uint64(langid._hash_piece(p)))) for p in pieces}
    word = "".join(rng.choice(list("abx"), 500))
    marked, logs = "▁" + word, [[0.0, 0.0]]
    for t in range(1, len(marked) + 1):  # the plain recursion, in logs
        ways = [(row.get(marked[t - n : t], len(pieces)), t - n) for n in (1, 2, 3) if t >= n and (n == 1 or marked[t - n : t] in row)]
        logs.append([math.log(sum(math.exp(logs[u][g] - logs[-1][g]) * model.probs[i, g] for i, u in ways)) + logs[-1][g] for g in (0, 1)])
    assert np.allclose(model.alone(word), logs[-1]) and np.allclose(model.words(["ab", word])[1], logs[-1])
    assert np.allclose(model.forward([word, "ab"])[0], logs[-1]) and len(model.words([])) == 0


def test_fit_raises_the_likelihood():
    texts = {"x": ["abab aba abba"] * 3, "y": ["baba bbb abb"] * 3}
    pieces = ["a", "b", "ab", "ba", "bb", "▁", "▁a", "▁b"]
    scores = [langid.fit(texts, pieces, rounds=n, prior=1e-9).words(["abab", "aba", "abba"])[:, 0].sum() for n in (1, 2, 5)]
    assert scores[0] < scores[1] <= scores[2] + 1e-9


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.langid_query(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_every_training_language_is_sampled(spark):
    copies = spark.range(3000).selectExpr("concat('c', id % 20) AS lang", "concat('one text of ', id % 20) AS text")
    long = spark.range(9).selectExpr("'long' AS lang", "concat(repeat('word ', 20), id) AS text")
    many = spark.range(5000).selectExpr("'many' AS lang", "concat('text ', id) AS text")
    rows = copies.unionByName(long).unionByName(many)
    got = langid.sample_texts(rows, "text", "lang", 4, 150)
    assert got.keys() == {"long", "many", *(f"c{i}" for i in range(20))}
    assert all(got[f"c{i}"] == [f"one text of {i}"] for i in range(20))
    assert len(got["many"]) == 4 and len(got["long"]) == 2
    assert langid.sample_texts(rows, "text", "lang", 4, 1)["long"] == got["long"][:1]


def test_langid_odd_rows(odd, empty):
    model = langid.train(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    und = {r.id for r in rows if r.lang_pred == "und"}
    assert und == {3, 4, 5} and all(r.score == 0 for r in rows if r.id in und)
    assert {r.lang_pred for r in rows if r.id in (1, 2)} == {"en"}
    assert langid.langid_query(empty).count() == 0
    assert [r.lang_pred for r in langid.identify(odd, langid.train(empty)).collect()] == ["und"] * odd.count()
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5})


# --- chat


def as_turns(rows):
    return [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]


def test_chat_round_trip_and_machine(spark):
    rows = [
        (1, 0, "system", "be <kind> \\b \\l \\g"),
        (1, 1, "user", "\\### </turn>\n<turn assistant>\nhi"),
        (1, 2, "assistant", "\\\\</turn>\n ü 😀"),
        (2, 0, "assistant", None),
        (2, 0, "assistant", None),
        (2, None, "to>ol", ""),
        (None, 1, None, "x"),
        (3, 0, "user", "only asks"),
        (4, 0, "user", "q"),
        (4, 1, "assistant", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as turns", "2 as segments")
    read = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    for conv in (1, 2, None, 3, 4):
        expect = as_turns([r for r in rows if r[0] == conv])
        assert [(t.role, t.text) for t in read[conv].turns] == expect
        assert "".join(s.text for s in read[conv].segments) == read[conv].formatted
        loss = [s.text for s in read[conv].segments if s.loss]
        assert len(loss) == sum(role == "assistant" for role, _ in expect)
    assert {c: r.valid for c, r in read.items()} == {1: True, 2: False, None: False, 3: False, 4: True}
    told = {r.conv_id: r for r in chat.digest(df).collect()}
    assert told[1].loss_sha256 == hashlib.sha256("\\\\</turn>\n ü 😀".encode()).hexdigest()
    assert told[1].loss_chars == 14 and told[2].n_turns == 3
    said = "".join(f"{a}\n{b}\n" for a, b in as_turns([r for r in rows if r[0] == 1]))
    assert told[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digest(df.limit(0)).count() == 0


def test_chat_query_adds_the_probe(spark, sf):
    rows = chat.chat_query(spark.read.parquet(f"{sf}/conversations.parquet")).filter("conv_id = -7").collect()
    assert rows[0].n_turns == 2 and rows[0].loss_chars == len(chat.PROBE)
    assert rows[0].loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()


# --- mixing


def brute_targets(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mix_targets_and_fixed_size(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mix_query(rows).collect()
    sizes, taken, most, target = Counter(), Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    expect = brute_targets(sizes, mixing.WEIGHTS, 1.5, 2.0)
    for s, x in expect.items():
        assert target[s] == pytest.approx(x, rel=1e-9)
        assert abs(taken[s] - x) <= most[s] / 2 + 1e-6
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix_query(rows).collect())


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, None: 100}, {"a": 1, "b": 50, "c": 3, "d": 8}, {"a": 0, "b": 4}, {"a": 7}, {"a": 5, "b": 5, "c": 5, "d": 5}])
def test_targets_by_running_sums(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes, mixing.WEIGHTS, 1.5, 2.0))


def test_mix_odd_rows(odd, empty):
    mixed = mixing.mix_query(odd).collect()
    assert len(mixed) == odd.count()
    assert all(r.size == 0 and r.taken == 0 for r in mixed if r.doc_id in (3, 4, 5))
    took = mixing.take_mix(odd)
    assert took.columns == odd.columns and took.count() == sum(r.copies for r in mixed)
    assert mixing.mix_query(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_inclusion_follows_the_probabilities(spark):
    """Sources alike but for their ids are repetitions of one experiment.  Order
    sampling of a fixed size meets its probabilities as a source grows."""
    words = {1: 2, 2: 10, 3: 40}
    rows = [(1000 * s + i, "w " * words[i % 3 + 1], f"s{s:03}") for s in range(40) for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sized = df.select("source", mixing.word_count("text").alias("size")).withColumn("__k", F.length(F.bin("size")))
    targets = mixing.source_targets(sized, "source", (1.0,), 0.8)
    plan = {r["__k"]: r["__whole"] + r["__p"] for r in mixing.expected_copies(sized, targets).filter("__s = 's000'").collect()}
    assert [plan[k] / plan[2] for k in (4, 6)] == pytest.approx([2.0, 4.0])  # square roots of 4 and 16
    assert sum(plan[n.bit_length()] * n for n in words.values()) == pytest.approx(0.8 * sum(words.values()))
    got = mixing.mix_sources(df, weights=(1.0,), share=0.8).groupBy("size").agg(F.avg("copies").alias("c"), F.max("copies").alias("most")).collect()
    for r in got:
        assert r.c == pytest.approx(plan[r["size"].bit_length()], abs=0.03) and r.most <= 2


def test_mix_ranks_equal_rows_by_file(spark):
    one = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit("x").alias("size"), F.lit("y").alias("row"))
    got = mixing.mix_sources(one.repartition(7), share=0.5)
    assert got.columns == ["doc_id", "text", "source", "row", "size", "source_size", "target", "copies", "taken"]
    assert abs(got.agg(F.sum("taken")).first()[0] - 4500) <= 1.5
    assert mixing.take_mix(one, share=0.5).columns == one.columns


# --- toxicity


def brute_segments(scores):
    """Maximal-scoring segments by their recursive definition."""
    def best(lo, hi):
        top, at = 0.0, None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > top + 1e-12:
                    top, at = total, (i, j)
        return at

    out, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        if (at := best(lo, hi)) is not None:
            out.append(at)
            todo += [(lo, at[0]), (at[1] + 1, hi)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_segments_are_the_maximal_ones(seed):
    rng = np.random.default_rng(seed)
    model = toxicity.ToxicModel(drift=0.3)
    scores = np.where(rng.random(60) < 0.3, rng.random(60) * 2 + 0.01, -0.3)
    found = model.segments([(int(i), float(scores[i])) for i in np.flatnonzero(scores > 0)])
    assert [(a, b) for a, b, _ in found] == brute_segments(scores.tolist())
    assert all(s == pytest.approx(scores[a : b + 1].sum()) for a, b, s in found)


def test_evidence_grows_with_score_and_falls_with_length():
    m = toxicity.ToxicModel()
    assert m.evidence([], 100) == 0
    assert m.evidence([(0, 0, 9.0)], 100) > m.evidence([(0, 0, 7.0)], 100) > m.evidence([(0, 0, 7.0)], 400)
    assert m.evidence([(0, 0, 6.0), (50, 50, 6.0)], 100) > m.evidence([(0, 0, 6.0)], 100)


def test_evidence_counts_all_segments_of_a_long_text():
    m = toxicity.ToxicModel(rate=0.02, decay=3.2)
    assert m.evidence([(200 * i, 200 * i, 1.0) for i in range(100)], 20_000) > 50


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity_query(docs, labels).join(labels, "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.95 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_build_by_its_formulas():
    counts = {"poison": (9, 1), "pois*": (9, 2), "the": (20, 80), "fresh": (4, 0)}
    m = toxicity.build(counts, (20, 80), 5000, strength=10.0, z=1.0, least_score=0.2)
    base = 0.2

    def low(a, b, prior):
        alpha, beta = a + 10 * prior, b + 10 * (1 - prior)
        return alpha / (alpha + beta), math.log(alpha / beta) - math.log(base / (1 - base)) - math.sqrt(1 / (a + 10 * base) + 1 / (b + 10 * (1 - base)))

    stem, score = low(9, 2, base)
    expect = {"pois*": score, "poison": low(9, 1, stem)[1], "fresh": low(4, 0, base)[1]}
    assert m.score == pytest.approx({k: v for k, v in expect.items() if v > 0.2}) and "the" in m.known
    p = {"poison": (1 + 10 * (1 - stem) * base) / 5000, "fresh": (0 + 10 * (1 - base) * base) / 5000}
    p = {k: v for k, v in p.items() if k in m.score}
    assert m.rate == pytest.approx(max(1e-5, sum(p.values())))
    assert m.reach == pytest.approx(min(1.0, sum(v * math.exp(m.decay * m.score[k]) for k, v in p.items())))
    law = sum(v * math.exp(m.decay * m.score[k]) for k, v in p.items()) + (1 - sum(p.values())) * math.exp(-m.decay * m.drift)
    assert law == pytest.approx(1.0, abs=1e-6) and m.decay > 0.05


def test_a_labelled_row_repeated_often_stays_one(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "if(id % 4 = 0, 'vile words here', 'kind words here') as text")
    many = docs.unionByName(spark.range(10_000).selectExpr("0L as doc_id", "'vile words here' as text"))
    labels = spark.range(400).selectExpr("id as doc_id", "int(id % 4 = 0) as toxic")
    sample = toxicity.labelled_sample(many, labels, 1000)
    assert sample.count() == sample.select("id").distinct().count() == toxicity.labelled_sample(docs, labels, 1000).count()
    a, b = toxicity.train(many, labels), toxicity.train(docs, labels)
    assert a == b and a.probability(a.evidence(a.segments([(0, a.of_token("vile"))]), 3)) > 0.3


def test_chance_finds_few_passages_in_clean_texts():
    """Shuffled tokens without evidence for anything: significant passages are rare."""
    rng = np.random.default_rng(4)
    scores, rates = np.array([0.7, 1.5, 2.5]), np.array([0.02, 0.004, 0.0005])
    law = lambda x: (rates * np.exp(x * scores)).sum() + (1 - rates.sum()) * math.exp(-x * 0.2) - 1
    low, high = 0.01, 10.0
    for _ in range(80):
        low, high = ((low + high) / 2, high) if law((low + high) / 2) < 0 else (low, (low + high) / 2)
    m = toxicity.ToxicModel(drift=0.2, reach=float((rates * np.exp(low * scores)).sum()), decay=low)
    hit = 0
    for _ in range(400):
        drawn = rng.choice(4, 500, p=[*rates, 1 - rates.sum()])
        segments = m.segments([(int(i), float(scores[drawn[i]])) for i in np.flatnonzero(drawn < 3)])
        hit += any(m.significant(x[2], 500) for x in segments)
    assert hit <= 0.05 * 400


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (2, 1, 0), (3, 1, None), (None, 1, 1), (8, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_query(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.toxicity_query(empty, labels).count() == 0
    assert toxicity.toxicity_query(odd, labels.limit(0)).count() == odd.count()
    kept = toxicity.drop_toxic(odd, odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


# --- packing


def test_encoder_matches_the_library(spark):
    encoder = load(packing.vocabulary_path())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", "It's we'll I'D don't", "<|endoftext|> a<|startoftext|>b", "naïve İstanbul ÄÖÜ ß", "ΑΣ ΣΑΣ 中文 字", "áé ẖ H̱", "x" * 300, "1234 5.6%", "tab\tnew\nline\x1cfs nbsp", "ab cd"]
    got = encoder.encode_many([t.encode() for t in texts], end=0)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t[:80])


def check_packing(rows, capacity):
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in spans.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def test_packing_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.packing_query(docs).collect()
    encoder = load(packing.vocabulary_path())
    expect = {}
    for r in docs.collect():
        ids = np.array([*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for i, at in enumerate(range(0, len(ids), 2048)):
            expect[r.doc_id, i] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expect
    used, least = check_packing(rows, 2048), -(-sum(x[1] for x in expect.values()) // 2048)
    assert used <= math.ceil(1.01 * least) + 1


def test_packing_odd_rows(odd, empty):
    rows = packing.pack(odd, capacity=64, with_ids=True).collect()
    check_packing(rows, 64)
    pieces = Counter(r.doc_id for r in rows)
    assert pieces[3] == pieces[4] == pieces[5] == 1 and pieces[2] == 2 and pieces[6] == -(-5001 // 64)
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(k) for n, k in zip(rng.integers(1, 101, 40), rng.integers(1, 500, 40), strict=True)}
    found = packing.plan(histogram, 100)
    count = Counter()
    for config, n in found:
        assert sum(config) <= 100
        for x in config:
            count[x] += n
    assert count == Counter(histogram)
    # Lengths over a half can't share a sequence, so best fit on all lengths is the yardstick.
    sizes = np.array(sorted(histogram))
    plain = packing.best_fit(sizes, np.array([histogram[int(n)] for n in sizes]), 100, Counter())
    assert sum(n for _, n in found) <= 1.01 * sum(plain.values()) + 1


@pytest.mark.parametrize("seed", range(2))
def test_covering_serves_all_but_the_rounding(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 501, 200))
    demand = rng.integers(1, 2000, len(sizes))
    chosen, left = packing.covering(sizes, demand, sizes / 500, 500)
    served = np.zeros(len(sizes), np.int64)
    for config, n in chosen.items():
        assert n >= 1 and sizes[list(config)].sum() <= 500
        np.add.at(served, list(config), n)
    assert (served + left == demand).all() and (left >= 0).all()
    assert left @ sizes <= 0.005 * (demand @ sizes)


def test_price_finds_the_best_knapsack():
    sizes, values = np.array([3, 4, 5]), np.array([4.0, 5.0, 7.0])
    chosen = packing.price(values, sizes, np.array([9, 9, 9]), 10)
    best = max(sum(values[list(c)]) for r in range(4) for c in itertools.combinations_with_replacement(range(3), r) if sizes[list(c)].sum() <= 10)
    assert sum(values[chosen]) == best


# --- language model


def brute_tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def test_lm_counts_and_base_score(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    train = Counter(w for r in rows.values() if not held_out(r.doc_id, 7) for w in brute_tokens(r.text))
    total, words = sum(train.values()), len(train)
    got = lm.lm_query(docs).collect()
    assert len(got) == len(rows)
    better = 0
    for r in got:
        own = brute_tokens(rows[r.doc_id].text)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held_out(r.doc_id, 7), len(own), total)
        assert r.n_known == sum(w in train for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (total + words + 1)) for w in own))
        better += r.score > r.base_score
    assert better >= 0.95 * len(got)


def test_lm_predictions_sum_to_one():
    rng = np.random.default_rng(0)
    words, contexts, counts = lm._pairs(rng.integers(0, 30, 4000).astype(np.uint64), rng.integers(0, 9, 4000).astype(np.uint16) * np.uint16(300), np.ones(4000, np.int64))
    process, shard = lm.Process(), lm.Shard(words, contexts, counts)

    def totals():
        found = shard.totals()
        return lm.Totals(found[:3], found[3:], len(shard.words))

    process.history.append(totals())
    for number in range(3):
        shard.sweep(process, process.history[-1], number)
        process.history.append(totals())
    now = process.history[-1]
    base = process.base(now.words)[1] * process.back_off(2, now)[0][0]
    for context in np.unique(contexts).tolist():
        back, own = [process.back_off(i, now) for i in range(3)], shard.probabilities(process, now, 2)
        one = back[1][0][context >> 8] * own
        hit = shard.rooms[1] == context >> 8
        one[shard.to_word[hit]] = shard.probabilities(process, now, 1)[hit]
        two = back[0][0][context] * one
        hit = shard.rooms[0] == context
        two[shard.to_word[shard.to_one[hit]]] = shard.probabilities(process, now, 0)[hit]
        unseen = base * back[1][0][context >> 8] * back[0][0][context]
        assert two.sum() + unseen == pytest.approx(1.0)


def one_by_one(customers, pull, parent, discount, rng):
    """Tables after seating customers singly: the process as defined."""
    n = t = 1
    while n < customers:
        w = pull + discount * t * parent
        t += rng.random() < w / (w + n - discount * t)
        n += 1
    return t


def test_seating_bounds_and_repeats():
    rng = np.random.default_rng(6)
    customers = rng.integers(1, 5000, 2000)
    parent = rng.random(2000) * 0.1
    pull, keys = 20 * parent, rng.integers(0, 2**63, 2000).astype(np.uint64)
    tables = lm.seat(customers, pull, parent, 0.8, keys)
    assert (tables >= 1).all() and (tables <= customers).all()
    assert (tables == lm.seat(customers, pull, parent, 0.8, keys)).all() and (tables[customers == 1] == 1).all()


@pytest.mark.parametrize(("customers", "pull", "parent"), [(2, 0.5, 0.1), (12, 3.0, 0.3), (300, 5.0, 0.05)])
def test_seating_follows_the_process(customers, pull, parent):
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64)
    got = lm.seat(np.full(4000, customers), np.full(4000, pull), np.full(4000, parent), 0.8, keys)
    expect = np.array([one_by_one(customers, pull, parent, 0.8, rng) for _ in range(2000)])
    assert got.mean() == pytest.approx(expect.mean(), rel=0.05)
    assert got.std() == pytest.approx(expect.std(), rel=0.15)


def test_binomial_draws():
    rng = np.random.default_rng(5)
    for n, p in ((1, 0.3), (20, 0.05), (40, 0.6), (5000, 0.1)):
        x = lm.binomial(np.full(20_000, n), np.full(20_000, p), rng.random(20_000))
        assert x.min() >= 0 and x.max() <= n
        assert x.mean() == pytest.approx(n * p, rel=0.03) and x.std() == pytest.approx(math.sqrt(n * p * (1 - p)), rel=0.05)


def test_lm_odd_rows(odd, empty):
    rows = lm.lm_query(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5)) and all(r.score < 0 for r in rows)
    assert lm.lm_query(empty).count() == 0
    unseen = lm.score_texts(odd, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in unseen)


def test_lm_model_is_neither_joined_nor_dealt_twice(spark, sf):
    """Memory: a table of hot shards made on the driver starts further Python processes on
    every executor, and a join with it moves the whole model once more."""
    plan = lm.lm_query(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD" not in plan


@pytest.mark.parametrize("texts", [["one two two three"] * 3, ["the cat " * 400, "", None, "a b c the " * 90], [f"word{i % 9}" for i in range(70_000)]])
def test_lm_tokens_travel_whole_and_narrow(monkeypatch, texts):
    monkeypatch.setattr(lm.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts, pa.string())], ["id", "held", "text"])
    (packed,) = lm._packed_batches([batch], 3, {})
    tokens = pd.DataFrame([r for r in packed.to_pylist() if r["shard"] >= 0])
    n = sum(len(x) // 2 for x in tokens.contexts)
    assert n == sum(len(brute_tokens(x)) for x in texts)
    assert sum(map(len, tokens.docs)) <= (4 if len(texts) > 1 << 16 else 2) * n
    distinct = {w for x in texts for w in brute_tokens(x)}
    assert sum(map(len, tokens.words)) <= 8 * len(distinct) + n // 8 + 3

    # They are read back for every text; without a model each has probability one.
    nothing = [np.zeros(x, np.int64) for x in (1 << 16, 256, 1)]
    process, seen = lm.Process(history=[lm.Totals(nothing, nothing, 0)] * 3), set()
    for p in set(tokens["shard"]):
        for r in lm._score_shard(pd.DataFrame(), tokens[tokens["shard"] == p], process).itertuples():
            docs = lm._numbers(r.docs, len(r.base) // 8)
            assert (lm._numbers(r.known, len(docs)) == 0).all() and np.allclose(np.frombuffer(r.score), 0)
            seen.update(docs.tolist())
    assert seen == set(range(len(texts)))


@pytest.mark.parametrize("top", [0, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**40])
def test_lm_narrow_numbers_come_back(top):
    x = np.array([0, top, 1], np.int64)
    assert (lm._numbers(lm._narrow(x), 3) == x).all()
    assert len(lm._numbers(lm._narrow(x[:0]), 0)) == 0
    # Sums don't stop at the width of what is summed.
    words, contexts = np.array([5, 5, 5], np.uint64), np.array([1, 2, 3], np.uint16)
    assert lm.Shard(words, contexts, lm._numbers(lm._narrow(x), 3)).counts.tolist() == [top + 1]
    assert lm._pairs(words, contexts[:1].repeat(3), lm._numbers(lm._narrow(x), 3))[2].tolist() == [top + 1]


# --- sharding


def test_sharding_odd_rows(odd, empty):
    rows = sharding.shard(odd, limit=100).collect()
    assert len(rows) == odd.count()
    used = Counter()
    for r in rows:
        used[r.shard, r.page] += r.bytes
    for r in rows:
        assert r.shard_bytes == used[r.shard, r.page]
        assert r.oversized == (r.shard_bytes > 100) and (not r.oversized or r.bytes == r.shard_bytes)
    assert sharding.shard(empty).count() == 0


def test_identical_rows_are_paged(spark):
    df = spark.range(1000, numPartitions=7).select(F.lit(5).alias("doc_id"), F.lit("0123456789").alias("text"))
    rows = sharding.shard(df, limit=64).collect()
    pages = Counter(r.page for r in rows)
    assert len({r.shard for r in rows}) == 1 and max(pages.values()) == 6 and sum(pages.values()) == 1000 and len(pages) == 167
    assert not any(r.oversized for r in rows)


def test_only_oversized_buckets_split(spark, sf):
    rows = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet"), limit=20_000).collect()
    size = {r.shard: r.shard_bytes for r in rows}
    for name in size:
        parent = name[:-1]
        assert sum(n for s, n in size.items() if s.startswith(parent)) > 20_000


def test_write_shards(spark, tmp_path, odd):
    sharding.write_shards(odd, f"{tmp_path}/shards", limit=200)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.drop("shard_id").columns == odd.columns
    assert back.count() == odd.count()
    named = {r.doc_id: r.shard for r in sharding.shard(odd, limit=200).collect()}
    assert all(r.shard_id.split("-")[0] == "s" + named[r.doc_id] for r in back.select("doc_id", "shard_id").collect())


def test_equal_rows_are_written_in_pages(spark, tmp_path):
    same = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("ten bytes.").alias("text"))
    sharding.write_shards(same, f"{tmp_path}/shards", limit=64)
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/shards").groupBy("shard_id").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) == 6 and len(sizes) == 500
