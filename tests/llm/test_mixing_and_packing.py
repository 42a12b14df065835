"""op7, op10 and the pipeline against their contracts."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from matchlens.llm import mixing, packing, store

from .conftest import SF


def targets(sizes):
    """Water-filling, plainly. sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        got = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and got[s] > 3 * sizes[s]}
        if not over:
            return got
        capped |= over


def check_mix(rows, truth):
    by_source = defaultdict(int)
    for _, source, size in truth:
        by_source[source] += size
    want = targets(by_source)
    source = {i: s for i, s, _ in truth}
    size = {i: n for i, _, n in truth}
    taken = defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by_source[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in by_source:
        assert abs(taken[s] - want[s]) <= max(n for i, x, n in truth if x == s) + 1e-6


def test_mix_meets_targets_and_reruns_agree(spark, docs, words):
    rows = mixing.query(spark, SF).collect()
    check_mix(rows, [(r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.collect()])
    again = mixing.decisions(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["size"] * r["copies"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_mix_caps_small_sources(spark):
    draw = random.Random(0)
    truth = [(i, draw.choice(["a", "b", "c", None, "d", "e"]) if i > 3 else "tiny", draw.randint(0, 40)) for i in range(3000)]
    table = spark.createDataFrame([(i, s, "w " * n) for i, s, n in truth], "doc_id long, source string, text string")
    got = mixing.decisions(table)
    rows = got.withColumn("taken", F.col("size") * F.col("copies")).collect()
    check_mix(rows, truth)


def test_mix_keeps_expectations(spark):
    units = spark.createDataFrame([(i, "s", 10 + i % 5, 1) for i in range(200)], "doc_id long, source string, size long, n long")
    total = sum(10 + i % 5 for i in range(200))
    goal = spark.createDataFrame([("s", total, 1.0, 0.4 * total)], "source string, source_size long, weight double, target double")
    runs = [mixing.rounded(units, goal, seed).agg(F.sum("copies")).first()[0] / 200 for seed in range(5)]
    assert abs(np.mean(runs) - 0.4) < 0.03


def test_mix_edges(odd, none):
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns and mixing.mix(none).count() == 0
    d = {(r["doc_id"], r["source"]): r for r in mixing.decisions(odd).collect()}
    assert d[1, None]["size"] == 0 and d[7, None]["n"] == 2
    n7 = sum(1 for r in taken.collect() if r["doc_id"] == 7)
    assert n7 == d[7, None]["copies"] <= 6


@pytest.mark.parametrize("seed", range(40))
def test_patterns_place_every_piece(seed):
    draw = random.Random(seed)
    size = draw.choice([8, 50, 128])
    histogram = {n: draw.choice([1, 2, 5, 1000]) for n in draw.sample(range(1, size + 1), draw.randint(1, 8))}
    placed = defaultdict(int)
    for slots, packs in packing.patterns(histogram, size):
        assert packs > 0 and sum(n * t for n, t in slots) <= size
        for n, t in slots:
            placed[n] += t * packs
    assert placed == histogram


def untouched(path=None):
    return Tokenizer.from_file(path or packing.vocabulary())


def test_words_give_the_tokenizer_s_ids(texts):
    ids = packing.WordIds(packing.vocabulary())
    odd = ["", "a b \x1c x y z q", "e ́a", "ΑΣ Σ", "<|endoftext|> hi", "1234 don't I'LL we've", "İstanbul ﬁ", " \n\t"]
    all_ = odd + list(texts.values())
    plain = untouched().encode_batch(all_, add_special_tokens=False)
    assert [list(x) for x in ids(all_)] == [[*x.ids, 1] for x in plain]


def test_known_words_with_a_stop():
    """A chunk may bring nothing new but known words with a stop."""
    ids = packing.WordIds(packing.vocabulary())
    for t in ("hello world", ".", "hello world.", "world, hello.", "<|endoftext|>", "hello <|endoftext|>."):
        assert list(ids([t])[0]) == [*untouched().encode(t, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_one_at_a_time(seed):
    """Special tokens in any case, Turkish capitals, marks and rare letters, in any order and any grouping."""
    draw = random.Random(seed)
    parts = ["a", "B", "İ", "ı", "é", "e\u0301", "\u0307", "Σ", "ǰ", "\u0345", "ᾳ", "\U0001e94a", "日", ".", ",", "..", "'s", "1", " ", "\n", "\x1c", "\u2028", "<|endoftext|>",
             "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "K", "ﬁ", "ß", "ẞ", "\u0130\u0307"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 9))) for _ in range(700)]
    ids, plain = packing.WordIds(packing.vocabulary()), untouched()
    at = 0
    while at < len(texts):
        some = texts[at:at + draw.choice([1, 1, 2, 40])]
        for t, got in zip(some, ids(some)):
            assert list(got) == [*plain.encode(t, add_special_tokens=False).ids, 1], t
        at += len(some)


def check_pieces(rows, texts, path):
    tokenizer = untouched(path)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(r["length"] for r in rows) / (2048 * len(by_sequence))


def test_packing(spark, texts, odd, none):
    assert check_pieces(packing.query(spark, SF).collect(), texts, packing.vocabulary()) > 0.97
    single = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(single, packing.vocabulary()).collect(), {r["doc_id"]: r["text"] for r in single.collect()}, packing.vocabulary())
    assert packing.pack(none, packing.vocabulary()).count() == 0


def test_pipeline_stages(spark, docs, odd, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "mix", "pack"]
    for start in (docs, odd, none):
        t = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            t = store.staged(stage(spark, t, SF))
            assert t.columns == start.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, t, SF).collect()
        assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in t.collect()}


def test_run_equals_its_stages(spark, docs):
    t = docs
    for _, stage in corpus_pipeline.STAGES:
        t = store.staged(stage(spark, t, SF))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, t.collect()))
