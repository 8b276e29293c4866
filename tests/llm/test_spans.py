"""Shared spans against a search of every window."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evispark.llm import spans
from evispark.llm.codepoints import chunks, decode, encode


def plain(records, span):
    """(rec -> shared characters) by looking at every window of every record."""
    owner, shared = {}, set()
    for rec, text in records.items():
        for i in range(len(text or "") - span + 1):
            if owner.setdefault(text[i : i + span], rec) != rec:
                shared.add(text[i : i + span])
    out = {}
    for rec, text in records.items():
        marked = bytearray(len(text or ""))
        for i in range(len(marked) - span + 1):
            if text[i : i + span] in shared:
                marked[i : i + span] = b"\1" * span
        if any(marked):
            out[rec] = sum(marked)
    return out


def found(spark, records, span=20, k=10, direct=8):
    rows = [(rec, text, "x") for rec, text in records.items() for _ in range(1 + rec % 2)]  # every other row twice
    df = spark.createDataFrame(rows, "rec long, text string, seed string")
    matches = spans.shared_matches(df, span, k, direct)
    kept = spans.passages(matches, k).where(F.col("end_a") - F.col("start_a") >= span)
    both = kept.select(F.explode(F.array(F.struct(F.col("rec_a").alias("rec"), F.col("start_a").alias("start"), F.col("end_a").alias("end")), F.struct(F.col("rec_b").alias("rec"), F.col("start_b").alias("start"), F.col("end_b").alias("end")))).alias("s")).select("s.*").distinct()
    return {r.rec: r.n_shared for r in spans.shared_characters(both).collect()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé漢") for _ in range(n))
    passages = [word(rng.randint(15, 60)) for _ in range(4)] + ["y" * 50, "ab" * 20]
    records = {}
    for i in range(24):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(word(rng.randint(0, 30)))
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            parts.append(p[a : len(p) - rng.randint(0, 5)])
        records[i] = "".join(parts)
    records |= {100: "", 101: None, 102: "q" * 19, 103: "q" * 19, 104: "z" * 30 + "z" * 30, 105: "one " * 15, 106: "one " * 15}
    return records


@pytest.mark.parametrize("direct", [8, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_every_window(spark, seed, direct):
    records = corpus(seed)
    assert found(spark, records, direct=direct) == plain(records, 20)


def test_a_passage_in_a_third_of_all_records(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(70))
    records = {i: "".join(rng.choice("ijklmnop") for _ in range(40)) + (passage if i % 3 == 0 else "") + "".join(rng.choice("qrst") for _ in range(30)) for i in range(90)}
    got = found(spark, records, direct=2)
    assert got == plain(records, 20) and set(got) == set(range(0, 90, 3))


def test_repeats_inside_one_record_are_no_case(spark):
    part = "abcdefghijklmnopqrstuvwxyz"
    assert found(spark, {1: part * 3, 2: "other text " * 1}) == {}
    assert spans.exact_spans(spark.createDataFrame([], "rec long, text string")).count() == 0


def test_chains_join_ordered_matches_over_gaps():
    ordered = [(0, 0, 0, 0), (120, 125, 0, 0), (900, 20_000, 0, 0)]
    assert spans.chain(ordered, 100, 0.05) == [0, 0, 1]
    crossed = [(0, 300, 0, 0), (300, 0, 0, 0)]
    assert spans.chain(crossed, 100, 0.05) == [0, 1]
    two = spans._stretches((1, 2), [(0, 0, 0, 10, False), (105, 112, 0, 10, False)], 100, 0.05)
    assert {t[2] for t in two} == {0} and len(two) == 2  # one fuzzy passage of two exact stretches


def test_seeds_cover_every_window():
    rng = random.Random(3)
    for text in ["".join(rng.choice("ab") for _ in range(400)), "y" * 400, "x" * 30 + "y" * 50 + "z" * 40]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        rows, places, _ = spans.seed_places(points, np.array([0, len(points)]), 10, 11)
        marked = set(places.tolist())
        for i in range(len(text) - 19):
            assert marked & set(range(i, i + 11)) or len(set(text[i : i + 20])) <= 2


def test_code_points_round_trip():
    texts = pa.array(["", None, "aé漢😀", "x" * 50, "ö"])
    points, offsets = decode(texts)
    assert encode(points, offsets).to_pylist() == ["", "", "aé漢😀", "x" * 50, "ö"]
    parts = list(chunks(texts, 8))
    assert sum(map(len, parts)) == 5 and pa.concat_arrays([p.cast(pa.string()) for p in parts]).to_pylist() == texts.to_pylist()


@pytest.mark.parametrize("apart", [150, 250, 400])
def test_edited_passages_are_chained(spark, apart):
    """Passages of 1,600 characters with one edit in every ``apart`` characters: one fuzzy passage over all of it."""
    rng = random.Random(apart)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows, planted = [], 0
    for i in range(40):
        passage = word(1_600)
        edited = list(passage)
        for at in range(rng.randint(20, apart), 1_600, apart):
            edited[at : at + 1] = rng.choice(["", "Z", "ZZZ"])
        rows += [(2 * i, word(300) + passage + word(200)), (2 * i + 1, word(100) + "".join(edited))]
        planted += 1
    rows += [(1_000 + i, word(2_000)) for i in range(20)]
    found = spans.passages(spans.shared_matches(spark.createDataFrame(rows, "rec long, text string")))
    per = {}
    for r in found.collect():
        assert r.rec_a // 2 == r.rec_b // 2 and not r.star
        per.setdefault((r.rec_a, r.passage), []).append((r.start_a, r.end_a))
    whole = sum(len(s) > 1 and max(b for _, b in s) - min(a for a, _ in s) >= 1_600 - 2 * apart for s in per.values())
    assert whole >= {150: 0.0, 250: 0.9, 400: 0.9}[apart] * planted


def test_a_passage_in_half_of_all_records(spark):
    """Hot seeds: every record is found, with as many links as records, and no more."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    hot = word(260)
    rows = [(i, word(rng.randint(0, 150)) + (hot if i % 2 else word(260)) + word(rng.randint(0, 150))) for i in range(400)]
    matches = spans.shared_matches(spark.createDataFrame(rows, "rec long, text string")).collect()
    assert {r for m in matches for r in (m.rec_a, m.rec_b)} == {i for i in range(400) if i % 2} and any(m.star for m in matches)
    pairs = {(m.rec_a, m.rec_b) for m in matches}
    assert len(pairs) <= 5 * 200, len(pairs)  # all pairs would be 19,900
