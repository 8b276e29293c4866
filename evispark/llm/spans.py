"""Long exact spans shared between records, by seeds, chains and alignment.

1. Seeds.  A rolling hash runs over every k-mer of a record; in each window of
   w consecutive k-mers the smallest hash is a seed.  With w = span - k + 1
   every span of ``span`` characters holds a seed at the same place in each
   record that has it, so no shared span lacks a common seed.
2. Join.  Occurrences of one seed in different records meet.  A seed in few
   records meets all of them.  A seed in many (a hot passage) is split further
   by the whole windows of ``span`` characters around it, and each window's
   records meet two of their own only; records that share a span share a
   window, so none is lost and the work stays linear.
3. Chains.  The ordered matches of a record pair are chained with gap costs by
   a Fenwick tree over the second record's positions.
4. Alignment.  Every match of a chain is extended letter by letter.  Exact
   spans of at least ``span`` characters are the result; a chain whose matches
   lie on several diagonals is a fuzzy passage.

An occurrence carries the text around it, up to span - k characters on each
side, which is as far as its part of any shared span can reach without coming
to the next seed.  So no record's whole text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.codepoints import chunks, decode
from evispark.plans import broadcast_if_small, staged

SPAN, K = 200, 100
#: a seed at up to so many places pairs them all; beyond it, windows do (exactly)
DIRECT = 8
#: most repeated seeds that are broadcast; more are joined by shuffling
SEEDS = 1_000_000
#: characters of gap that cost as much as one matched character gains
GAP_COST = 0.05

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _doubling_hash(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-mer, mixed at each doubling so that low bits are as good as high ones.

    A hash of 2m characters comes from two of m; any k is two overlapping powers of two.
    """
    h = _mix(points.astype(np.uint64) + _BASE)
    m = 1
    while 2 * m <= k:
        h = _mix(h[:-m] * _BASE + h[m:])
        m *= 2
    if m < k:
        h = _mix(h[: len(h) - (k - m)] * _BASE + h[k - m :])
    return h


def _sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest value of some window of w values.

    Equal smallest values all count, so that the choice depends on the window's
    content alone.  In periodic text they would be as many as the characters:
    of equal values at one constant step those within a window of either end and
    one in about every half window stay, close enough for their surroundings to
    cover the stretch, whatever phase another text's stretch begins at.  A window without any lies inside the periodic stretch, where the
    stretch's other seeds match as far as its own would.
    """
    n = len(h)
    if n <= w:
        return np.flatnonzero(h == h.min()) if n else np.empty(0, np.int64)
    blocks = -(-n // w) * w
    padded = np.full(blocks, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = h
    square = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    places = np.flatnonzero(_could_be(h, low, w))
    if len(places) < 3:
        return places
    step = np.diff(places)
    tied = (h[places[1:]] == h[places[:-1]]) & (step < w)
    inner = np.zeros(len(places), bool)
    inner[1:-1] = tied[1:] & tied[:-1] & (step[1:] == step[:-1])
    first = places[np.maximum.accumulate(np.where(inner, 0, np.arange(len(places))))]
    last = places[np.minimum.accumulate(np.where(inner, len(places) - 1, np.arange(len(places)))[::-1])[::-1]]
    part = (places - first) // max(1, w // 2)
    inner[1:] &= part[1:] == part[:-1]
    inner &= (places - first >= w) & (last - places >= w)
    return places[~inner]


def _could_be(h: np.ndarray, low: np.ndarray, w: int) -> np.ndarray:
    """Whether h[i] is the smallest of at least one window; equal smallest values all count."""
    n, m = len(h), len(low)
    # the largest window minimum among windows that hold i equals h[i] exactly if i is the smallest of one
    blocks = -(-(m + w - 1) // w) * w + w
    padded = np.zeros(blocks, np.uint64)
    padded[w - 1 : w - 1 + m] = low  # windows i-w+1 .. i stand at i .. i+w-1
    square = padded.reshape(-1, w)
    ahead = np.maximum.accumulate(square, axis=1).ravel()
    behind = np.maximum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.maximum(behind[:n], ahead[w - 1 : w - 1 + n])
    return best == h


def seed_places(points: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, hash) of the seeds of each row of a code-point array."""
    rows, places, values = [], [], []
    if len(points) >= k:
        hashes = _doubling_hash(points, k)
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1]) - k + 1
            if b - a < w:  # shorter than a span: it can share none
                continue
            at = _sliding_argmin(hashes[a:b], w)
            rows.append(np.full(len(at), i))
            places.append(at)
            values.append(hashes[a + at])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def seeds(records: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(rec, seed, place) of each record's seeds; ``records`` has (rec, text).

    Null texts and texts below ``span`` characters have none.
    """
    w = span - k + 1
    kind = records.schema["rec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(batch.column(1)):
                owners = batch.column(0).slice(at, len(part))
                at += len(part)
                rows, places, values = seed_places(*decode(part), k, w)
                yield pa.RecordBatch.from_arrays([owners.take(pa.array(rows)), pa.array(values.view(np.int64)), pa.array(places, pa.int32())], ["rec", "seed", "place"])

    return records.select("rec", "text").mapInArrow(run, f"rec {kind}, seed long, place int")


def surroundings(records: DataFrame, occurrences: DataFrame, span: int, k: int) -> DataFrame:
    """(rec, seed, place, hot, left, text): occurrences with the text around them.

    ``text`` is the k-mer with up to span - k characters on either side, of
    which ``left`` stand before it.  A record's places meet its text as one
    list, which the text's length bounds, so a text is read once however many
    places it has.
    """
    around = span - k
    kind = records.schema["rec"].dataType.simpleString()
    places = occurrences.groupBy("rec").agg(F.collect_set(F.struct("seed", "place", "hot")).alias("at"))
    names = ["rec", "seed", "place", "hot", "left", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.slice(low, 64)
                lists = part.column(2)
                seed, place, hot = lists.flatten().flatten()
                counts = lists.value_lengths().to_numpy(zero_copy_only=False)
                starts = place.to_numpy(zero_copy_only=False)
                left = np.minimum(starts, around)
                owners = np.repeat(np.arange(len(part)), counts)
                whole = part.column(1).to_pylist()
                texts = [whole[o][a - b : a + k + around] for o, a, b in zip(owners.tolist(), starts.tolist(), left.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners)), seed, place, hot, pa.array(left, pa.int32()), pa.array(texts, pa.string())], names)

    # a record that was delivered twice is read once; the join has brought its rows together
    joined = records.select("rec", "text").join(places, "rec").dropDuplicates(["rec"]).select("rec", "text", "at")
    return joined.mapInArrow(run, f"rec {kind}, seed long, place int, hot boolean, left int, text string")


def shared_matches(records: DataFrame, span: int = SPAN, k: int = K, direct: int = DIRECT) -> DataFrame:
    """(rec_a, rec_b, place_a, place_b, before, after, star): matches of seeds of two records.

    ``before`` and ``after`` are the characters by which the match extends on
    each side, at most span - k.  rec_a < rec_b.  Records without a key are none;
    a key that comes twice counts once.  A seed at more than ``direct`` places
    is not paired in full: there each record meets the first and the last record
    of each of its windows, and ``star`` is true, so that records with one
    window are those that share a partner in it.

    Seeds are staged as numbers.  Their counts combine before the shuffle, so a
    seed that stands in a third of all records is one row per task there, and
    the joins on it are plain ones, which adaptive execution splits.
    """
    light = staged(seeds(records, span, k).where("rec is not null and seed is not null"))
    # only the seed and its count are shuffled; what stands once leaves here
    repeated = light.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    again = staged(light.join(broadcast_if_small(staged(repeated), SEEDS), "seed").distinct())
    shared = again.groupBy("seed").agg(F.min("rec").alias("low"), F.max("rec").alias("high"), F.count("*").alias("places")).where("low < high")
    occurrences = again.join(shared.select("seed", (F.col("places") > direct).alias("hot")), "seed")
    met = staged(surroundings(records, occurrences, span, k))

    few = met.where("not hot").select("seed", "rec", "place", "left", "text")
    a = few.select("seed", *[F.col(c).alias(f"{c}_a") for c in ("rec", "place", "left", "text")])
    b = few.select("seed", *[F.col(c).alias(f"{c}_b") for c in ("rec", "place", "left", "text")])
    pairs = a.join(b, "seed").where("rec_a < rec_b").drop("seed")
    direct_matches = _extended(pairs, ["rec_a", "rec_b", "place_a", "place_b"], k).withColumn("star", F.lit(False))
    return direct_matches.unionByName(_star_matches(met.where("hot").drop("hot"), span, k))


def _star_matches(hot: DataFrame, span: int, k: int) -> DataFrame:
    """Matches of occurrences of hot seeds, at most two partners per occurrence and window of ``span``.

    Occurrences with one surrounding text are a class, known by 128 bits of it;
    inside a passage that was copied often they are all one class.  A class in
    several records links each of them to its first (the first to its last).
    Between classes, every window of ``span`` characters around the seed links
    each class to the first and the last record that has the window.  Records
    that share a span share a window, so each of them gets a partner with that
    whole span.  Texts are compared once per pair of classes; the members of a
    class meet the result as numbers.
    """
    hot = hot.withColumn("around", F.unhex(F.md5("text")))
    of = ["seed", "left", "around"]
    place = F.struct("rec", "place", "left", "around")
    classes = hot.groupBy(*of).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.first("text").alias("text"))
    inside = classes.where("low.rec < high.rec").select(*of, "low", "high")
    windows = classes.where(F.char_length("text") >= span).select(*of, "low", "high", F.explode(F.transform(
        F.sequence(F.lit(0), F.char_length("text") - span),
        lambda at: F.struct((F.col("left") - at).alias("shift"), F.unhex(F.md5(F.substring("text", at + 1, F.lit(span)))).alias("window")),
    )).alias("w")).select(*of, "low", "high", "w.*")
    met = ["seed", "shift", "window"]
    ends = windows.groupBy(*met).agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count("*").alias("n")).where("n > 1 and first.rec < last.rec")
    between = windows.select(*of, *met[1:]).join(ends, met).select(*of, F.col("first").alias("low"), F.col("last").alias("high")).distinct()
    partners = inside.unionByName(between).distinct()
    # every class is compared with the classes of its partners, once
    to = partners.select(*of, F.explode(F.array("low", "high")).alias("o")).select(*of, F.col("o.left").alias("left_o"), F.col("o.around").alias("around_o")).distinct()
    text = classes.select(*of, "text")
    others = text.select("seed", F.col("left").alias("left_o"), F.col("around").alias("around_o"), F.col("text").alias("text_o"))
    both = to.join(text, of).join(others, ["seed", "left_o", "around_o"])
    reach = _extended(both.select("seed", "left", "around", "left_o", "around_o", F.col("text").alias("text_a"), F.col("text_o").alias("text_b"), F.col("left").alias("left_a"), F.col("left_o").alias("left_b")), [*of, "left_o", "around_o"], k)
    # a record meets the first one of a window, the first one itself the last
    stars = partners.select(*of, F.col("low.rec").alias("rec_low"), F.posexplode(F.array("low", "high")).alias("is_high", "o")).select(*of, "rec_low", "is_high", F.col("o.rec").alias("rec_o"), F.col("o.place").alias("place_o"), F.col("o.left").alias("left_o"), F.col("o.around").alias("around_o"))
    stars = stars.join(reach, [*of, "left_o", "around_o"]).select(*of, "rec_low", "is_high", "rec_o", "place_o", "before", "after")
    links = hot.select(*of, "rec", "place").join(stars, of).where(F.col("is_high") == (F.col("rec") == F.col("rec_low")).cast("int"))
    first = F.col("rec") < F.col("rec_o")
    sides = [F.when(first if side == "a" else ~first, F.col(c)).otherwise(F.col(f"{c}_o")).alias(f"{c}_{side}") for c in ("rec", "place") for side in "ab"]
    return links.select(*sides, "before", "after", F.lit(True).alias("star")).distinct()


def _extended(pairs: DataFrame, keep: list[str], k: int) -> DataFrame:
    """``keep``, before, after: each pair of texts extended letter by letter; pairs whose k-mers differ (equal hashes) leave."""
    fields = "".join(f"{c} {pairs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            left_a, left_b = column["left_a"].to_pylist(), column["left_b"].to_pylist()
            same, before, after = [], [], []
            for i, (x, y, la, lb) in enumerate(zip(column["text_a"].to_pylist(), column["text_b"].to_pylist(), left_a, left_b)):
                if x[la : la + k] != y[lb : lb + k]:
                    continue
                same.append(i)
                before.append(_common(x[:la][::-1], y[:lb][::-1]))
                after.append(_common(x[la + k :], y[lb + k :]))
            taken = pa.array(same, pa.int64())
            yield pa.RecordBatch.from_arrays([column[c].take(taken) for c in keep] + [pa.array(before, pa.int32()), pa.array(after, pa.int32())], [*keep, "before", "after"])

    return pairs.mapInArrow(run, f"{fields}before int, after int")


def _common(x: str, y: str) -> int:
    """Length of the common start."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n  # x[:low] == y[:low], x[:high] != y[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def chain(matches: list[tuple[int, int, int, int]], k: int, gap: float = GAP_COST) -> list[int]:
    """A chain number for each (place_a, place_b, before, after), sorted by place_a, then place_b.

    score(i) = k + max(0, score(j) - gap * (a_i - a_j + b_i - b_j)) over matches j
    before i in both records; the best j comes from a Fenwick tree of largest
    score + gap * (a + b) by place_b.  A match that gains nothing starts a chain.
    """
    order = sorted({b for _, b, _, _ in matches})
    rank = {b: i + 1 for i, b in enumerate(order)}
    size = len(order)
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (size + 1)
    numbers: list[int] = []
    score: list[float] = []
    count = 0
    for i, (a, b, _, _) in enumerate(matches):
        best, at = (-1.0, -1), rank[b]
        while at > 0:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        gained = best[0] - gap * (a + b) if best[1] >= 0 else 0.0
        if best[1] >= 0 and gained > 0:
            numbers.append(numbers[best[1]])
            score.append(k + gained)
        else:
            numbers.append(count)
            score.append(float(k))
            count += 1
        entry, at = (score[i] + gap * (a + b), i), rank[b]
        while at <= size:
            if entry > tree[at]:
                tree[at] = entry
            at += at & -at
    return numbers


def passages(matches: DataFrame, k: int = K, gap: float = GAP_COST) -> DataFrame:
    """(rec_a, rec_b, passage, start_a, end_a, start_b, end_b, star): the exact stretches of each chain.

    Matches are sorted by record pair within partitions and streamed, so a pair
    with many matches is held alone, and pairs cost no group overhead.  A chain
    gives one row per exact stretch, the matches of one diagonal whose
    extensions meet; several stretches under one passage number are a fuzzy
    passage.  ``star`` says that the pair comes from a seed in many records, of
    which each meets some only (see ``shared_matches``).
    """
    kind = matches.schema["rec_a"].dataType.simpleString()
    names = ["rec_a", "rec_b", "passage", "start_a", "end_a", "start_b", "end_b", "star"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pair, held = None, []
        for batch in batches:
            for a, b, *match in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != pair:
                    if held:
                        out += _stretches(pair, held, k, gap)
                    pair, held = (a, b), []
                held.append(tuple(match))
            if len(out) > 50_000:
                yield _rows(out)
                out = []
        if held:
            out += _stretches(pair, held, k, gap)
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out))
        types = [schema_type, schema_type, *[pa.int32()] * 5, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind]
    ordered = matches.select("rec_a", "rec_b", "place_a", "place_b", "before", "after", "star").repartition("rec_a", "rec_b").sortWithinPartitions("rec_a", "rec_b", "place_a", "place_b")
    return ordered.mapInArrow(run, f"rec_a {kind}, rec_b {kind}, passage int, start_a int, end_a int, start_b int, end_b int, star boolean")


def _stretches(pair: tuple, found: list[tuple[int, int, int, int, bool]], k: int, gap: float) -> list[tuple]:
    """The exact stretches of a pair's chains."""
    star = any(m[4] for m in found)
    matches = list(dict.fromkeys(m[:4] for m in found))
    numbers = chain(matches, k, gap)
    lines: dict[tuple[int, int], list[list[int]]] = {}
    for number, (a, b, before, after) in zip(numbers, matches):
        start, end = a - before, a + k + after
        found = lines.setdefault((number, b - a), [])
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [(*pair, n, s, e, s + d, e + d, star) for (n, d), found in lines.items() for s, e in found]


def exact_spans(records: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(rec, start, end): per record, where it shares at least ``span`` characters with another record.

    One row per stretch and partner; ``records`` has (rec, text), rows of a record that repeat count once.
    """
    found = passages(shared_matches(records, span, k), k).where(F.col("end_a") - F.col("start_a") >= span)
    both = F.array(
        F.struct(F.col("rec_a").alias("rec"), F.col("start_a").alias("start"), F.col("end_a").alias("end")),
        F.struct(F.col("rec_b").alias("rec"), F.col("start_b").alias("start"), F.col("end_b").alias("end")),
    )
    return found.select(F.explode(both).alias("s")).select("s.*").distinct()


def shared_characters(spans: DataFrame) -> DataFrame:
    """(rec, n_spans, n_shared): distinct merged stretches of each record and their characters."""
    w = Window.partitionBy("rec").orderBy("start", "end")
    ahead = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("ahead", ahead).select("rec", (F.col("ahead").isNull() | (F.col("start") > F.col("ahead"))).cast("int").alias("new"), F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("ahead", F.lit(0)))).alias("added"))
    return merged.groupBy("rec").agg(F.sum("new").alias("n_spans"), F.sum("added").alias("n_shared"))
