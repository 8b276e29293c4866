"""Navigation entries of sources: headings, captions, leads and excerpts, with running furniture left out.

Lines are rows; what a line needs of its neighbours comes from windows over one
page.  Furniture is counted by signature, and the heading that holds at an entry
is carried first within blocks of pages and then from block to block, so that no
window runs over a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.plans import staged

PAGE = ["source_id", "page"]
#: pages over which one window carries a heading
BLOCK = 200
#: Characters of an entry, lines of an excerpt, characters and words of a heading.
TEXT, EXCERPT, HEADING, WORDS = 512, 5, 120, 10
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
# The forms of dates, page marks, captions, headings, contents rows, references and versions.
DATE = rf"\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|\d{{1,2}}\s+{_MONTH}\s+\d{{4}}|{_MONTH}\s+\d{{1,2}},\s+\d{{4}})\b"
PAGE_MARK = r"^(?:page\s+\d+(?:\s+of\s+\d+)?|version\s+\S+)$"
PAGE_COUNT = r"\bpage\s+\d+(?:\s+of\s+\d+)?\b"
CAPTION = r"^(?:figure|table)\s+(?:[a-z]*\d+|[ivx]+)[.:]?\s+\S.+"
NUMBERED = r"^(?:\d+[.)]\s*|\d+(?:\.\d+)+\s+)[A-Z][^.!?:;]{0,119}$"
NUMBER = r"^\d+(?:\.\d+)*[.)]?$"
CONTENTS = r"^.{2,180}?\.{2,}\s*\d{1,4}\s*$"
REFERENCE = r"\b(?:see|refer\s+to|described\s+in|reported\s+in|according\s+to)\s+(?:section|subsection|appendix|table|figure|page|pages|the\s+protocol|the\s+sap)\b"
VERSION = r"\b(?:version|revision|edition|amendment|protocol\s+version|sap\s+version)\b|\bv\d+(?:\.\d+)*\b"
# The words that tell what a date is of, the first that fits.
DATE_KINDS = [
    ("unblinded access|accessed unblinded|unblinded to|unblinded on|unblinding date", "unblinded_access"), ("finaliz|finalis", "finalization"), ("approv", "approval"), ("submitted|registry submission", "submission"),
    ("posted|posting", "posting"), ("retriev|downloaded", "retrieval"), ("capture", "capture"), ("version|revision|edition", "version"), ("amend", "amendment"), ("cutoff|cut-off|last data", "cutoff"), ("template|form", "template"),
]
#: Fixed value: headings of participant flow.
FLOW = r"\b(?:consort|(?:patient|participant|subject|study)\s+(?:flow|disposition)|(?:follow[- ]up|outcome)\s+(?:status|availability|ascertainment))\b"


def _like(text: Column, pattern: str) -> Column:
    """Whether a pattern stands in a text, without regard to case."""
    return text.rlike(f"(?i){pattern}")


def date_kind(text: Column) -> Column:
    """What the date in a line is of, null if the line has no date or does not say."""
    kind = F.when(~_like(text, DATE), None)
    for words, name in DATE_KINDS:
        kind = kind.when(F.lower(text).rlike(words), name)
    return kind


def page_lines(pages: DataFrame) -> DataFrame:
    """(source_id, page, line_no, raw, line, before, after): lines from 1 with the trimmed lines around them."""
    text = F.regexp_replace(F.regexp_replace("text", r"\R", "\n"), "\n$", "")  # a closing line end opens no line
    cut = pages.where(F.col("text") != "").dropDuplicates(PAGE).select(*PAGE, F.split(text, "\n", -1).alias("raws"))
    trimmed = cut.withColumn("lines", F.transform("raws", lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    at = F.posexplode("raws").alias("at", "raw")
    beside = lambda step: F.get("lines", F.col("at") + step)
    return trimmed.select(*PAGE, "lines", at).select(
        *PAGE, (F.col("at") + 1).alias("line_no"), "raw", beside(0).alias("line"), F.when(F.col("at") > 0, beside(-1)).alias("before"), beside(1).alias("after"),
    )


def useful_lines(lines: DataFrame) -> DataFrame:
    """The lines that are no page marks and no furniture.

    A line is furniture if its like, page numbers and dates aside, is one of the
    first two or last two lines of two or more pages of its source; the first of
    its kind stays.
    """
    full = lines.where("line <> ''").withColumn("signature", F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace("line", f"(?i){PAGE_COUNT}|{DATE}", "#"), r"\s+", " ")), r"^ | $", "")))
    from_top = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no"))
    from_end = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("line_no")))
    placed = full.withColumn("edge", (from_top <= 2) | (from_end <= 2))
    repeated = placed.groupBy("source_id", "signature").agg(F.count_distinct(F.when(F.col("edge"), F.col("page"))).alias("n"), F.min(F.struct("page", "line_no")).alias("first")).where("n >= 2")
    kept = placed.where(~_like(F.col("line"), PAGE_MARK) | _like(F.col("line"), VERSION)).join(repeated.select("source_id", "signature", "first"), ["source_id", "signature"], "left")
    return kept.where(F.col("first").isNull() | ((F.col("page") == F.col("first.page")) & (F.col("line_no") == F.col("first.line_no")))).drop("signature", "first", "edge")


def navigation(pages: DataFrame) -> DataFrame:
    """(source_id, page, start_line, end_line, kind, date_kind, text, section): the navigation entries of each source.

    Kinds are page_excerpt, contents_lead, version_lead, date_lead,
    cross_reference_lead and heading_candidate.  A section number alone on its
    line makes a heading with the line that follows.  ``section`` is the last
    heading at or before the entry.  Null and empty pages have none; repeated
    rows of a page count once.
    """
    useful = staged(useful_lines(page_lines(pages)))
    line, low = F.col("line"), F.lower("line")
    blank_before, blank_after = F.coalesce(F.col("before"), F.lit("")) == "", F.coalesce(F.col("after"), F.lit("")) == ""
    n_words = lambda c: F.size(F.split(c, r"\s+"))
    ends = r"[.:;?!]$"
    title = F.col("after")
    split_heading = (
        line.rlike(NUMBER) & blank_before & title.rlike(r"^\p{Lu}") & (F.char_length(title) <= HEADING) & (n_words(title) <= WORDS) & ~title.rlike(ends) & ~title.rlike("[@;]")
    )
    caption = _like(line, CAPTION)
    heading = (F.char_length(line) <= HEADING) & (caption | ~line.rlike(ends)) & ~line.rlike("[@;]") & (caption | line.rlike(NUMBERED) | (blank_before & blank_after & (n_words(line) <= WORDS)))
    entry = lambda kind, condition, end=F.col("line_no"), text=line: F.when(condition, F.struct(F.lit(kind).alias("kind"), end.alias("end_line"), text.alias("text")))
    kinds = F.array(
        entry("contents_lead", low.isin("contents", "table of contents") | line.rlike(CONTENTS)), entry("version_lead", _like(line, VERSION)), entry("date_lead", date_kind(line).isNotNull()), entry("cross_reference_lead", _like(line, REFERENCE)),
        entry("heading_candidate", split_heading, F.col("line_no") + 1, F.concat("raw", F.lit("\n"), F.col("after"))), entry("heading_candidate", heading),
    )
    found = useful.select(*PAGE, F.col("line_no").alias("start_line"), F.explode(F.array_compact(kinds)).alias("e")).select(*PAGE, "start_line", "e.end_line", "e.kind", "e.text")
    place = [*PAGE, "start_line", "end_line", "text"]
    excerpts = _excerpts(useful).join(found.where("kind <> 'heading_candidate'").select(*place).distinct(), place, "left_anti")
    return carried(excerpts.unionByName(found)).select(*PAGE, "start_line", "end_line", "kind", F.when(F.col("kind") == "date_lead", date_kind(F.col("text"))).alias("date_kind"), bounded(F.col("text")).alias("text"), bounded(F.col("section")).alias("section"))


def _excerpts(useful: DataFrame) -> DataFrame:
    """The first useful line of each page with those of the next four lines that fit an entry, blanks between."""
    opens = Window.partitionBy(*PAGE)
    near = useful.withColumn("opens", F.min("line_no").over(opens)).where(F.col("line_no") < F.col("opens") + EXCERPT)
    held = near.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("held"))  # at most five lines
    start = F.struct(F.get("held", F.lit(0))["line"].alias("text"), F.get("held", F.lit(0))["line_no"].alias("end"), F.lit(True).alias("open"))

    def add(done: Column, line: Column) -> Column:
        text = F.concat(done["text"], F.lit(" "), line["line"])
        fits = done["open"] & (F.char_length(text) <= TEXT)
        return F.struct(F.when(fits, text).otherwise(done["text"]).alias("text"), F.when(fits, line["line_no"]).otherwise(done["end"]).alias("end"), fits.alias("open"))

    joined = held.withColumn("e", F.aggregate(F.slice("held", 2, EXCERPT), start, add))
    return joined.select(*PAGE, F.get("held", F.lit(0))["line_no"].alias("start_line"), F.col("e.end").alias("end_line"), F.lit("page_excerpt").alias("kind"), F.col("e.text").alias("text"))


def bounded(text: Column) -> Column:
    """A text cut to the length of an entry, with a mark where it was cut."""
    mark = " … [omitted]"
    return F.when(F.char_length(text) <= TEXT, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, TEXT - len(mark))), F.lit(mark)))


def carried(entries: DataFrame) -> DataFrame:
    """``entries`` with ``section``, the text of the last heading at or before each in its source."""
    order = ["page", "start_line", "kind", "shorter"]
    blocked = entries.withColumn("shorter", -F.col("end_line")).withColumn("block", F.floor(F.col("page") / BLOCK)).withColumn("mark", F.when(F.col("kind") == "heading_candidate", F.col("text")))
    inside = Window.partitionBy("source_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = blocked.groupBy("source_id", "block").agg(F.max(F.when(F.col("mark").isNotNull(), F.struct(*order, "mark")))["mark"].alias("mark"))
    ahead = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    before = last.select("source_id", "block", F.last("mark", ignorenulls=True).over(ahead).alias("earlier"))
    return blocked.join(before, ["source_id", "block"]).withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(inside), "earlier")).drop("block", "mark", "earlier", "shorter")


def flow_captions(entries: DataFrame, pages: DataFrame, reads: DataFrame, reach: int = 79, most: int = 20) -> DataFrame:
    """(source_id, page, start_line, end_line, place): the first windows below headings of participant flow that were not read whole.

    A window reaches ``reach`` lines below its heading, or to the page's end.
    ``reads`` has (source_id, page, first, last).
    """
    from evispark.operators import intervals

    n_lines = page_lines(pages).groupBy(*PAGE).agg(F.max("line_no").alias("n_lines"))
    found = entries.where((F.col("kind") == "heading_candidate") & _like(F.col("text"), FLOW)).join(n_lines, PAGE)
    windows = found.select(*PAGE, F.col("start_line").cast("long").alias("first"), F.least(F.col("end_line") + reach, "n_lines").cast("long").alias("last")).distinct()
    keyed = windows.withColumn("start_line", F.col("first"))
    beside = keyed.select(*PAGE, "start_line").join(reads, PAGE).select(*PAGE, "start_line", "first", "last")
    open_ = intervals.coverage(keyed, beside, [*PAGE, "start_line"]).where("state <> 'delivered'").select(*PAGE, "start_line").join(windows.withColumn("start_line", F.col("first")), [*PAGE, "start_line"])
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("page", "start_line"))
    return open_.withColumn("place", place).where(F.col("place") <= most).select(*PAGE, "start_line", F.col("last").alias("end_line"), "place")
