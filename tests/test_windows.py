"""Term spans and passages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.functions import windows


def test_term_spans_keep_source_places():
    text = "Allocations were concealed. Café allocating"
    assert [text[a:b] for a, b in windows.term_spans(text, "allocation")] == ["Allocations", "allocating"]
    assert [text[a:b] for a, b in windows.term_spans(text, "cafe", stemmed=False)] == ["Café"]
    assert windows.term_spans("", "x") == [] and windows.term_spans("x", "") == []


@pytest.mark.parametrize("text", ["follow-up", "follow up", "followup", "follow-\nup"])
def test_hyphen_variants(text):
    assert windows.variant_spans(f"the {text}.", "follow-up") == [(4, 4 + len(text))]
    assert windows.variant_spans("unfollow-up", "follow-up") == []


def test_two_far_clusters():
    text = "\n".join(["match here"] + [f"line {i} of filler text" for i in range(60)] + ["another match"])
    spans = [(0, 5), (text.rindex("match"), len(text))]
    one, two = windows.passages(text, spans)
    assert one["first_line"] == 1 and two["last_line"] == 62 and one["end"] < two["start"]
    assert all(len(text[p["start"] : p["end"]].encode()) <= 512 for p in (one, two))


def test_long_lines_and_truncation():
    text = "é" * 3000
    found = windows.passages(text, [(0, 3000)])
    assert found[0]["truncated"] and len(text[: found[0]["end"]].encode()) == 2048
    assert not windows.passages("x" * 3000, [(10, 20)])[0]["truncated"]
    assert windows.passages("abc", []) == []


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab é\n"), min_size=1, max_size=400), st.lists(st.tuples(st.integers(0, 399), st.integers(1, 60)), max_size=6))
def test_passages_hold_their_matches(text, raw):
    spans = [(a, min(len(text), a + n)) for a, n in raw if a < len(text)]
    found = windows.passages(text, spans, 40, 80)
    for a, b in spans:
        held = [p for p in found if p["start"] <= a and (b <= p["end"] or p["truncated"])]
        assert held or any(p["truncated"] for p in found)
    assert [p["start"] for p in found] == sorted(p["start"] for p in found)
