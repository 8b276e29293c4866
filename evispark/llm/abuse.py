"""Abusive, hateful or sexual content, by weak supervision.

Texts become arrays of tokens: letters in the one form, lower case, without
accents.  Every distinct token is classed once: by general word lists in four
languages, by the shape of compounds, and by undoing disguises (digits and
signs for letters, masked, stretched, spaced and run-together letters).  Voters
look at the classes in each passage (a sentence): which stand in it, and which
stand near which.  Three voters speak against: clinical, reporting and quoting
context.

A generative label model is fitted to the counts of all vote patterns of the
corpus, passages without any vote included: the share of each kind of abuse, how
often each voter fires in each and in ordinary passages, and the correlations of
voters given the class, by which voters that repeat each other share weight.  A linear classifier
over words, word pairs and votes is trained on its posteriors for a bounded
sample of passages, and scores every passage of every document.  A document's
score is that of its worst passage.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.abuse_words import LISTS, MORPHOLOGY
from evispark.llm.codepoints import chunks, decode
from evispark.llm.lookalikes import one_form_array
from evispark.llm.words import mix, span_hashes
from evispark.plans import staged

#: passages that train the classifier, of those with a vote for abuse and of those without
TRAIN_PASSAGES = (20_000, 40_000)
#: tokens of a passage; a longer sentence gives several, its voters see across their borders
PASSAGE = 128
BITS = 18
THRESHOLD = 0.5
#: distinct tokens that a worker remembers; more are classed again, with the same result
REMEMBERED = 400_000

CLASSES = (*LISTS, "disguised", "number")
BIT = {name: 1 << i for i, name in enumerate(CLASSES)}
_INSULT = BIT["insult_en"] | BIT["insult_de"] | BIT["insult_fr"] | BIT["insult_es"] | BIT["slur"]
_CONTEMPT = BIT["contempt"] | BIT["contempt_romance"]
_DOUBTFUL = BIT["animal"] | BIT["sexual_weak"]
_STRONG = _INSULT | BIT["vulgar"] | BIT["sexual"] | BIT["curse"] | _CONTEMPT | _DOUBTFUL

VOTERS = (
    "insult_en", "insult_de", "insult_fr", "insult_es", "slur", "vulgar", "explicit", "contempt_noun", "you_insult",
    "threat", "death_wish", "group_hate", "silencing", "belittling", "gossip", "disguised",
    "clinical", "reporting", "quoting",
)
VOTE = {name: 1 << i for i, name in enumerate(VOTERS)}
AGAINST = ("clinical", "reporting", "quoting")
_FOR = sum(VOTE[v] for v in VOTERS if v not in AGAINST)


@functools.cache
def _bare() -> np.ndarray:
    """Each code point in lower case without its accent; other characters stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    for point in (*range(0x41, 0x5B), *range(0xC0, 0x530), *range(0x1E00, 0x1F00)):
        table[point] = ord(unicodedata.normalize("NFD", chr(point).lower())[0])
    for shown, plain in ("øo", "Øo", "đd", "łl", "ßs", "’'", "‘'"):
        table[ord(shown)] = ord(plain)
    return table


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: 1 a letter, 2 a digit, 3 a sign that may stand for a letter, 4 a blank, 5 a line feed, 6 a sentence end, 7 a closing quote, 0 others."""
    table = np.zeros(0x110000, np.uint8)
    table[ord("a") : ord("z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for kind, signs in ((3, "@$*#%&+"), (4, " \t\xa0"), (5, "\n"), (6, ".!?…"), (7, "\"'”»)")):
        table[[ord(c) for c in signs]] = kind
    table[ord("!")] = 8  # a letter inside a word, a sentence end behind one
    return table


def _fold(text: str) -> str:
    points, _ = decode(one_form_array(pa.array([text])))
    return _bare()[points].astype("<u4").tobytes().decode("utf-32-le")


@functools.cache
def lexicon() -> dict[str, int]:
    """Each listed word with the bits of its classes."""
    out: dict[str, int] = {}
    for name, words in LISTS.items():
        for word in _fold(words).split():
            out[word] = out.get(word, 0) | BIT[name]
    return out


@functools.cache
def _strong_by_length() -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for word, bits in lexicon().items():
        if bits & _STRONG:
            out.setdefault(len(word), []).append(word)
    return out


@functools.cache
def _longest() -> int:
    return max(map(len, lexicon()))


_LEET = (str.maketrans("013457@$!8", "oieastasib"), str.maketrans("013457@$!8", "oleastaslb"))
_RUNS = re.compile(r"([a-z])\1{2,}")
_MASKS = frozenset("*#%&+@$!0123456789")


def word_bits(word: str) -> int:
    """The classes of a word of letters, by list or by shape."""
    bits = lexicon().get(word, 0)
    if not bits:
        for name, shape in MORPHOLOGY.items():
            if shape.fullmatch(word):
                bits |= BIT[name]
    return bits


def undisguised(token: str) -> str | None:
    """The strong listed word, or words, behind a disguised token, or None."""
    token = token.strip("*#%&+").rstrip("!")
    letters = sum(map(str.isalpha, token))
    if letters * 3 < len(token) or len(token) < 3:
        return None
    forms = [token.translate(t) for t in _LEET] if not token.isalpha() else [token]
    forms += [_RUNS.sub(r"\1", f) for f in forms] + [_RUNS.sub(r"\1\1", f) for f in forms]
    for form in forms:  # three characters may well be a code
        if word_bits(form) & _STRONG and (len(form) > 3 or word_bits(form) & ~_DOUBTFUL & _STRONG):
            return form
    for form in forms:
        if apart := _apart(form):
            return apart
    if len(token) > 3 and any(c in "*#%&+@$!" for c in token):  # a masked letter may be any
        for form in (token, _RUNS.sub(r"\1", token)):
            for word in _strong_by_length().get(len(form), ()):
                if all(c == w or c in _MASKS for c, w in zip(form, word)) and any(c == w for c, w in zip(form, word)):
                    return word
    return None


def _apart(letters: str) -> str | None:
    """Letters written together as listed words, one of them strong; an article may stand before them."""
    words = lexicon()
    best: list[list[str] | None] = [[]] + [None] * len(letters)
    for end in range(1, len(letters) + 1):
        for start in range(max(0, end - _longest()), end):
            piece = letters[start:end]
            if best[start] is not None and ((piece in words and len(piece) > 2) or (start == 0 and piece in ("a", "an", "un"))):
                best[end] = [*best[start], piece]
                break
    parts = best[-1]
    return " ".join(parts) if parts and any(words.get(x, 0) & _STRONG for x in parts) else None


def token_class(token: str) -> tuple[int, str]:
    """(classes, the word that counts as the feature) of a raw token."""
    plain = token.strip("*#%&+!")
    if plain.isdigit():
        return BIT["number"], "0"
    if bits := word_bits(plain):
        return bits, plain
    odd = not token.isalpha() or _RUNS.search(token)
    word = undisguised(token) if odd else None
    if word is None:
        return (0, plain) if plain.isalpha() else (BIT["number"], "0")
    bits = 0
    for part in word.split():
        bits |= word_bits(part)
    return bits | BIT["disguised"], word.split()[-1]


def _feature(word: str) -> int:
    h = 0
    for c in word:
        h = (h * 0x100000001B3 ^ ord(c)) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([h], np.uint64))[0] >> np.uint64(64 - BITS))


class _Known:
    """The classes of the tokens that this worker has seen, by hash."""

    def __init__(self) -> None:
        self.hashes, self.bits, self.feature = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)

    def classed(self, hashes: np.ndarray, read) -> tuple[np.ndarray, np.ndarray]:
        """(classes, features) of tokens; ``read`` gives the text of the token at a place."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            found = [token_class(read(i)) for i in first[new].tolist()]
            if len(self.hashes) > REMEMBERED:
                self.__init__()
                return self.classed(hashes, read)
            order = np.argsort(merged := np.concatenate([self.hashes, distinct[new]]))
            self.hashes = merged[order]
            self.bits = np.concatenate([self.bits, np.array([b for b, _ in found], np.int64)])[order]
            self.feature = np.concatenate([self.feature, np.array([_feature(w) for _, w in found], np.int32)])[order]
            at = np.searchsorted(self.hashes, distinct)
        return self.bits[at][back], self.feature[at][back]


_known = _Known()


def read_tokens(texts: pa.Array) -> dict[str, np.ndarray]:
    """Tokens of texts: row, sentence (both rising), bits, feature."""
    points, offsets = decode(one_form_array(texts))
    points = _bare()[points]
    n = len(points)
    kind = _kinds()[points]
    mark = kind == 8
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = (kind >= 1) & (kind <= 3) | mark
    borders = np.zeros(n + 1, bool)
    borders[offsets] = True
    edge = letter[1:] != letter[:-1]
    starts = np.flatnonzero(letter[1:-1] & (edge[:-1] | borders[:-1]))
    ends = np.flatnonzero(letter[1:-1] & (edge[1:] | borders[1:])) + 1
    if len(starts):
        count = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
        real = count[ends] > count[starts]  # signs alone are no token
        starts, ends = starts[real], ends[real]
    # a sentence ends behind . ! ? and closing quotes before a blank, and at an empty line
    blank = (kind == 4) | (kind == 5)
    after_blank = np.append(blank[1:], True)
    after_quote = np.append(kind[1:] == 7, False) & np.append(after_blank[1:], True)
    final = ((kind == 6) | mark) & (after_blank | after_quote)
    feeds = np.flatnonzero(kind == 5)
    empty = np.zeros(n, bool)
    if len(feeds) > 1:
        dark = np.cumsum(~blank)
        empty[feeds[1:]] = dark[feeds[1:]] == dark[feeds[:-1]]
    breaks = np.cumsum(np.concatenate([[0], final | empty])[:-1] if n else np.empty(0, np.int64)) + np.cumsum(borders[:n])
    hashes = span_hashes(points, starts, ends)
    raw = points.astype("<u4").tobytes().decode("utf-32-le", "replace")
    bits, feature = _known.classed(hashes, lambda i: raw[starts[i] : ends[i]])
    bits = bits.copy()
    _undo_spacing(raw, points, kind, starts, ends, bits)
    return {"row": np.searchsorted(offsets, starts, "right") - 1, "sentence": breaks[starts] if len(starts) else starts, "bits": bits, "feature": feature}


def _undo_spacing(raw: str, points: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray) -> None:
    """Give letters written apart (i d i o t, i.d.i.o.t, i-d-i-o-t) the classes of their word, at the first letter."""
    if len(starts) < 3:
        return
    single = ends - starts == 1
    gap = (starts[1:] - ends[:-1] == 1) & single[1:] & single[:-1]
    between = np.where(gap, points[ends[:-1]], 0)
    apart = gap & np.isin(between, [32, ord("."), ord("-"), ord("_"), ord("/"), ord("|"), ord(",")])
    at = np.flatnonzero(apart)
    if not len(at):
        return
    runs = np.split(at, np.flatnonzero((np.diff(at) > 1) | (between[at[1:]] != between[at[:-1]])) + 1)
    for run in runs:
        first, last = int(run[0]), int(run[-1]) + 1
        if last - first < 2:
            continue
        word = "".join(raw[starts[i]] for i in range(first, last + 1))
        found = word if word_bits(word) & _STRONG else undisguised(word)
        if found:
            bits[first : last + 1] = 0
            for part in found.split():
                bits[first] |= word_bits(part)
            bits[first] |= BIT["disguised"]


def _near(a: np.ndarray, b: np.ndarray, sentence: np.ndarray, before: int, after: int) -> np.ndarray:
    """Tokens of ``a`` with another token of ``b`` at most ``before`` ahead of them or ``after`` behind, in one sentence."""
    hit = np.zeros(len(a), bool)
    at, place = np.flatnonzero(a), np.flatnonzero(b)
    if not len(at) or not len(place):
        return hit
    left = np.searchsorted(place, at) - 1
    right = np.searchsorted(place, at, "right")
    if before:
        ok = left >= 0
        near = place[np.maximum(left, 0)]
        hit[at] |= ok & (at - near <= before) & (sentence[near] == sentence[at])
    if after:
        ok = right < len(place)
        near = place[np.minimum(right, len(place) - 1)]
        hit[at] |= ok & (near - at <= after) & (sentence[near] == sentence[at])
    return hit


def votes(bits: np.ndarray, sentence: np.ndarray) -> dict[str, np.ndarray]:
    """For each voter, the tokens at which it fires."""
    is_ = lambda *names: (bits & sum(BIT[n] for n in names)) != 0
    near = lambda a, b, before, after: _near(a, b, sentence, before, after)
    insult, animal, contempt = (bits & _INSULT) != 0, is_("animal"), (bits & _CONTEMPT) != 0
    curse, vulgar, sexual, weak = is_("curse"), is_("vulgar"), is_("sexual"), is_("sexual_weak")
    you, person, copula, kind = is_("you"), is_("person"), is_("copula"), is_("kind")
    noun = insult | animal
    bad = noun | contempt | curse | vulgar | is_("rubbish")
    clinical = is_("clinical")
    out = {name: is_(name) for name in ("insult_en", "insult_de", "insult_fr", "insult_es", "slur", "vulgar")}
    act = is_("sexact")
    out["explicit"] = (act & near(act, person | you, 0, 2)) | (sexual & (near(sexual, weak | sexual | you | person, 5, 5))) | (weak & near(weak, sexual, 6, 6)) | (weak & near(weak, weak, 6, 6) & near(weak, you | person, 4, 4))
    out["contempt_noun"] = (noun & (near(noun, contempt | curse, 3, 0) | (is_("insult_fr", "insult_es", "animal") & near(noun, is_("contempt_romance") | vulgar, 0, 2)))) | (noun & near(noun, kind, 3, 0) & ~near(noun, clinical, 6, 6))
    linked = near(you, copula, 3, 3)
    out["you_insult"] = (is_("thou") & near(is_("thou"), animal, 0, 1)) | (you & near(you, insult | is_("rubbish", "curse"), 4, 5)) | (is_("you_are") & near(is_("you_are"), animal | contempt, 0, 3)) | (you & linked & near(you, animal | contempt, 0, 5)) | (you & near(you, animal | contempt, 3, 3) & (linked | near(you, contempt | curse, 3, 3) | near(you, is_("like"), 1, 1)))
    violent, body = is_("violent", "violent_you"), is_("body")
    aimed = is_("violent_you") | (violent & near(violent, you, 5, 4))
    out["threat"] = (aimed & (near(aimed, body | is_("weapon"), 5, 6) | near(aimed, is_("i"), 6, 2))) | (is_("weapon") & near(is_("weapon"), you, 4, 5) & near(is_("weapon"), body, 4, 4)) | (
        is_("live") & near(is_("live"), is_("find"), 6, 0) & near(is_("live"), you, 4, 4)
    )
    die = is_("die")
    out["death_wish"] = is_("die_you") | (die & near(die, is_("self"), 1, 2)) | (die & near(die, you, 3, 0) & near(die, is_("want", "i", "too"), 6, 0)) | (is_("without") & near(is_("without"), you, 0, 1) & near(is_("without"), is_("better"), 7, 0))
    group, degraded = is_("group"), is_("degraded", "rubbish") | insult | contempt
    tied = group & near(group, copula, 0, 5)
    out["group_hate"] = (group & near(group, degraded, 0, 7) & (tied | near(group, contempt | is_("curse"), 2, 0))) | (group & near(group, contempt | insult, 0, 6) & near(group, is_("too"), 0, 4)) | (group & near(group, is_("rejected"), 0, 12) & (tied | near(group, is_("degraded", "animal"), 0, 10))) | (group & near(group, is_("slur"), 2, 2))
    shut = is_("shut")
    out["silencing"] = (shut & near(shut, is_("mouth"), 0, 2) & (near(shut, bad, 8, 8) | near(shut, you, 2, 2))) | is_("leave_you") | (is_("vulgar") & near(is_("vulgar"), is_("off"), 0, 2)) | (is_("leave") & near(is_("leave"), is_("vulgar"), 0, 4))
    out["belittling"] = (is_("nobody") & near(is_("nobody"), is_("want"), 0, 3) & near(is_("nobody"), you | bad, 8, 8)) | (kind & near(kind, is_("rubbish", "vulgar") | insult, 0, 3)) | (is_("like") & near(is_("like"), you, 0, 1) & (near(is_("like"), noun | contempt, 5, 0) | (near(is_("like"), is_("group"), 1, 0) & near(is_("like"), is_("never"), 0, 5)))) | (animal & near(animal, is_("better"), 0, 5))
    out["gossip"] = is_("sleeps") & near(is_("sleeps"), is_("boss"), 0, 5) & near(is_("sleeps"), person | insult, 12, 6)
    out["disguised"] = is_("disguised") & ((bits & _STRONG) != 0)
    out["clinical"], out["reporting"], out["quoting"] = clinical & near(clinical, clinical, 12, 12), is_("reporting"), is_("quoting")
    return out


def passages(texts: pa.Array) -> dict[str, np.ndarray]:
    """Passages of texts: owner (row), lengths, votes; and the words (features) of all."""
    read = read_tokens(texts)
    row, sentence, bits, feature = read["row"], read["sentence"], read["bits"], read["feature"]
    n = len(row)
    if not n:
        return {"owner": np.empty(0, np.int64), "lengths": np.empty(0, np.int32), "votes": np.empty(0, np.int32), "words": feature}
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    inside = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    opens = inside % PASSAGE == 0
    piece = np.cumsum(opens) - 1
    at = np.flatnonzero(opens)
    fired = np.zeros(len(at), np.int32)
    for name, mask in votes(bits, sentence).items():
        fired[piece[mask]] |= VOTE[name]
    return {"owner": row[at], "lengths": np.diff(np.append(at, n)).astype(np.int32), "votes": fired, "words": feature}


def read_passages(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, lengths, votes, words): each document's passages as word features and fired voters.

    The three lists hold, passage by passage, the number of words, the votes,
    and the words themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                found = passages(texts)
                ends = np.concatenate([[0], np.cumsum(np.bincount(found["owner"], minlength=len(part)))]).astype(np.int32)
                word_ends = np.concatenate([[0], np.cumsum(found["lengths"])])[ends].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(v.astype(np.int32))) for e, v in ((ends, found["lengths"]), (ends, found["votes"]), (word_ends, found["words"]))]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *lists], ["doc_id", *keep, "lengths", "votes", "words"])

    kept = "".join(f"{c} {documents.schema[c].dataType.simpleString()}, " for c in keep)
    return documents.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id long, {kept}lengths array<int>, votes array<int>, words array<int>")


def pattern_counts(read: DataFrame) -> DataFrame:
    """(votes, n): how often each vote pattern occurs among all passages; at most 2^19 rows, some hundreds in practice."""
    return read.select(F.explode("votes").alias("votes")).groupBy("votes").agg(F.count("*").alias("n"))


#: least share of a voter's lone firings that are right over the whole corpus; how much more is estimated
ACCURACY = 0.9
#: the kinds of abuse that the label model tells apart, each with the voters that look for it
KINDS = {
    **{f"insult_{x}": (f"insult_{x}", "vulgar", "contempt_noun", "you_insult", "silencing", "belittling", "disguised") for x in ("en", "de", "fr", "es")},
    "scorn": ("contempt_noun", "you_insult", "silencing", "belittling"),
    "sexual": ("explicit", "gossip"),
    "threat": ("threat", "death_wish"),
    "hate": ("group_hate", "slur"),
}


class LabelModel:
    """P(abusive | votes) from voters of unknown accuracy, fitted by EM over the counts of vote patterns.

    A passage is ordinary or of one of the ``KINDS`` of abuse.  Parameters are
    the share of each class and how often each voter fires in it; they are
    estimated from the patterns of all passages, those without votes included.
    Beta priors say what voters are for: those for abuse fire in ordinary
    passages hardly ever (one in ten thousand, as sure as a thousand passages),
    a kind's own voters in two of five of its passages, context voters seldom in
    abusive ones; and of the passages in which a voter fires alone, no more than
    1 - ``ACCURACY`` are ordinary.  A passage without a vote for abuse counts as
    ordinary, else a class could grow out of silence.  Voters whose firings go
    together within a class, beyond what the class explains, share their weight:
    the log odds of a voter are divided by 1 plus the sum of its positive
    correlations, given the class, with those that fire (or are silent) with it;
    they are estimated anew in each round.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> None:
        fired = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)
        n = counts.astype(float)
        against = np.array([v in AGAINST for v in VOTERS])
        own = np.array([[v in voters for v in VOTERS] for voters in KINDS.values()])
        hits = np.vstack([np.where(against, 3.0, 0.1), np.where(own, 2.0, np.where(against, 0.5, 0.3))])
        of = np.vstack([np.where(against, 10.0, 1000.0), np.where(own, 5.0, np.where(against, 20.0, 10.0))])
        self.rates, self.shares = hits / of, np.array([0.99] + [0.01 / len(KINDS)] * len(KINDS))
        lone = n @ (fired * (fired[:, ~against].sum(1, keepdims=True) == 1))
        self.correlations = np.zeros((len(VOTERS), len(VOTERS)))
        silent, ordinary = ~fired[:, ~against].any(1), np.eye(len(self.shares))[0]
        for _ in range(rounds):
            logs = np.log(self.shares) + self._log_odds(fired)
            q = np.exp(logs - logs.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[silent] = ordinary
            weight = n[:, None] * q
            self.shares = (weight.sum(0) + 1) / (n.sum() + len(self.shares))
            self.rates = (weight.T @ fired + hits) / (weight.sum(0)[:, None] + of)
            most = ((1 - ACCURACY) * lone + hits[0]) / (weight[:, 0].sum() + of[0])
            self.rates[0] = np.where(against, self.rates[0], np.minimum(self.rates[0], most))
            # by what the voters are for, none counts the other way
            self.rates[1:] = np.where(against, np.minimum(self.rates[1:], self.rates[0]), np.maximum(self.rates[1:], self.rates[0]))
            self.correlations = self._given_class(fired, weight)
        self.patterns, self.posterior = patterns, 1 - q[:, 0]

    def _log_odds(self, fired: np.ndarray) -> np.ndarray:
        """The log likelihood of each pattern in each class against the ordinary one."""
        on, off = np.log(self.rates / self.rates[0]), np.log((1 - self.rates) / (1 - self.rates[0]))
        together = np.maximum(self.correlations, 0)
        silent = 1 - fired
        return (fired / (1 + fired @ together)) @ on.T + (silent / (1 + silent @ together)) @ off.T

    def _given_class(self, fired: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Correlations of the voters within the classes of abuse, pooled."""
        out = np.zeros((len(VOTERS), len(VOTERS)))
        for w, mean in zip(weight.T[1:], self.rates[1:]):
            centred = fired - mean
            out += (centred * w[:, None]).T @ centred
        spread = np.sqrt(np.maximum(np.diag(out), 1e-9))
        out = out / np.outer(spread, spread) * weight[:, 1:].sum() / (weight[:, 1:].sum() + 20)
        np.fill_diagonal(out, 0)
        return out

    def table(self) -> dict[int, float]:
        return dict(zip(self.patterns.tolist(), self.posterior.tolist()))

    def weights(self) -> tuple[np.ndarray, float]:
        """(log odds that a voter adds by firing alone, log odds of a passage in which none fires)."""
        alone = np.vstack([np.zeros(len(VOTERS)), np.eye(len(VOTERS))])
        logs = np.log(self.shares) + self._log_odds(alone)
        top = logs[:, 1:].max(1)
        odds = top + np.log(np.exp(logs[:, 1:] - top[:, None]).sum(1)) - logs[:, 0]
        return odds[1:] - odds[0], float(odds[0])


def features(words: np.ndarray, lengths: np.ndarray, fired: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, passage) of all words, neighbouring pairs of words and votes of many passages."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    words = words.astype(np.int64)
    inside = owner[:-1] == owner[1:]
    pairs = ((words[:-1] * 1_000_003 + words[1:] * 7 + 1) & ((1 << BITS) - 1))[inside]
    at, owners = [words, pairs], [owner, owner[:-1][inside]]
    for voter in range(len(VOTERS)):
        on = np.flatnonzero(fired >> voter & 1)
        at.append(np.full(len(on), vote_place(voter)))
        owners.append(on)
    return np.concatenate(at), np.concatenate(owners)


def vote_place(voter: int) -> int:
    """The feature of a voter, beyond those of the words."""
    return (1 << BITS) + voter


def train(at: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray, first: np.ndarray, bias: float, rounds: int = 120, rate: float = 0.2, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels (full batches, AdaGrad).

    ``weight`` is what each passage stands for.  The voters begin with ``first``,
    their weights of the label model; all weights are drawn back to where they
    began, so that words which few passages hold stay near 0.
    """
    size = (1 << BITS) + len(VOTERS)
    weights = np.zeros(size)
    weights[1 << BITS :] = first
    start = weights.copy()
    square, square_bias = np.full(size, 1e-3), 1e-3
    total = weight.sum()
    importance = weight / total * len(labels)
    for _ in range(rounds):
        score = bias + np.bincount(owner, weights[at], len(labels))
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * importance
        gradient = np.bincount(at, error[owner], size) + decay * len(labels) * (weights - start)
        square += gradient**2
        weights -= rate * gradient / np.sqrt(square)
        square_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(square_bias)
    return weights, float(bias)


def fit(read: DataFrame, sample: tuple[int, int] = TRAIN_PASSAGES) -> tuple[np.ndarray, float, LabelModel]:
    """The classifier of a corpus: label model over all passages, training on at most ``sample`` of them.

    Passages with and without a vote for abuse are drawn apart, by the smallest
    hashes of document and place, and weighted back to their numbers in the
    corpus; each has at most ``PASSAGE`` words, so the sample is bounded.
    """
    counted = pattern_counts(read).collect()  # one row per vote pattern
    patterns, counts = np.array([r.votes for r in counted] or [0], np.int64), np.array([r.n for r in counted] or [1], np.int64)
    model = LabelModel(patterns, counts)
    first, bias = model.weights()
    placed = read.select("doc_id", F.posexplode("votes").alias("place", "votes")).withColumn("h", F.xxhash64("doc_id", "place"))
    parts = []
    for wanted, most in zip((True, False), sample):
        side = placed.where(((F.col("votes").bitwiseAND(F.lit(_FOR)) != 0) == F.lit(wanted)))
        parts.append(side.orderBy("h", "doc_id", "place").limit(most).select("doc_id", "place"))
    chosen = parts[0].unionByName(parts[1])
    held = _passages_at(read, chosen)
    table = held.toArrow()  # at most sample passages of at most PASSAGE words
    if not table.num_rows:
        return np.concatenate([np.zeros(1 << BITS), first]), bias, model
    fired = table.column("votes").to_numpy().astype(np.int64)
    words = table.column("words").combine_chunks()
    lengths = words.value_lengths().to_numpy(zero_copy_only=False)
    posterior = model.table()
    labels = np.array([posterior.get(v, 0.0) for v in fired.tolist()])
    voted = (fired & _FOR) != 0
    n_voted = counts[(patterns & _FOR) != 0].sum()
    weight = np.where(voted, n_voted / max(1, voted.sum()), (counts.sum() - n_voted) / max(1, (~voted).sum()))
    weights, bias = train(*features(words.flatten().to_numpy(zero_copy_only=False), lengths, fired), labels, weight, first, bias)
    return weights, bias, model


def _passages_at(read: DataFrame, chosen: DataFrame) -> DataFrame:
    """(votes, words) of the passages at (doc_id, place)."""
    places = chosen.groupBy("doc_id").agg(F.collect_set("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired, words = [], []
            for lengths, voted, all_words, at in zip(*(batch.column(i) for i in range(4))):
                ends = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())])
                held = all_words.values.to_numpy()
                for place in sorted(at.as_py()):
                    fired.append(voted.values[place].as_py())
                    words.append(held[ends[place] : ends[place + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.int32()), pa.array(words, pa.list_(pa.int32()))], ["votes", "words"])

    met = read.select("doc_id", "lengths", "votes", "words").join(F.broadcast(places), "doc_id")  # at most the sampled passages
    return met.dropDuplicates(["doc_id"]).select("lengths", "votes", "words", "places").mapInArrow(run, "votes int, words array<int>")


def score_documents(documents: DataFrame, sample: tuple[int, int] = TRAIN_PASSAGES, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, score, review): a score from 0 to 1 for every document; review from ``threshold`` on.

    ``documents`` has (doc_id, text); the columns named in ``keep`` go along,
    others are ignored.  Null, empty and blank texts score 0.  Whole texts are
    read, of any length; repeated rows give a row each; an empty table gives
    none.  Texts are read once: their passages are staged as numbers, from
    which the label model, the classifier and the scores come.  Only the counts
    of vote patterns and the sample are shuffled.
    """
    read = staged(read_passages(documents, keep))
    weights, bias, _ = fit(read, sample)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    sent = documents.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used].astype(np.float32), bias))  # at most 2^18 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, values, start = sent.value
        dense = np.zeros((1 << BITS) + len(VOTERS), np.float32)
        dense[place] = values
        for batch in batches:
            for low in range(0, len(batch), 2_000):
                part = batch.slice(low, 2_000)
                counts = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                lengths, fired, words = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                at, owner = features(words, lengths, fired)
                sums = start + np.bincount(owner, dense[at], len(lengths))
                worst = np.full(len(part), -np.inf)
                np.maximum.at(worst, np.repeat(np.arange(len(part)), counts), sums)
                scores = np.where(np.isneginf(worst), 0.0, 1 / (1 + np.exp(-np.clip(worst, -30, 30))))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[4:], pa.array(scores), pa.array(scores >= threshold)], ["doc_id", *keep, "score", "review"])

    kept = "".join(f"{c} {documents.schema[c].dataType.simpleString()}, " for c in keep)
    return read.select("doc_id", "lengths", "votes", "words", *keep).mapInArrow(run, f"doc_id long, {kept}score double, review boolean")
