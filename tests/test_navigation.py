"""Navigation entries by kind, furniture, carried headings and unread flow captions."""

from evispark.operators import navigation

PAGES = "source_id string, page int, text string"
ONE = "Trial Report\n\n1.2\nIntroduction\nSome prose about the trial; it goes on.\n\nTable IV: Baseline data.\n3. Methods used\nSee Section 4 for details\nPage 1 of 9"
TWO = "Trial Report\n\nParticipant flow\n\nProtocol version 2.0 amended 3 May 2031\nApproved on 2031-05-03\nResults .......... 12\nPage 2 of 9"


def entries(spark, rows):
    return [tuple(r) for r in navigation.navigation(spark.createDataFrame(rows, PAGES)).orderBy("source_id", "page", "start_line", "kind", "end_line").collect()]


def test_kinds_furniture_and_sections(spark):
    got = entries(spark, [("s", 1, ONE), ("s", 1, ONE), ("s", 2, TWO), ("s", 3, None), ("s", 4, ""), ("t", 1, "no entry of its own, as it is prose that ends;")])
    short = [(s, p, a, b, k, d, t[:24], c) for s, p, a, b, k, d, t, c in got]
    assert short == [
        ("s", 1, 1, 1, "heading_candidate", None, "Trial Report", "Trial Report"),
        ("s", 1, 1, 5, "page_excerpt", None, "Trial Report 1.2 Introdu", "Trial Report"),
        ("s", 1, 3, 4, "heading_candidate", None, "1.2\nIntroduction", "1.2\nIntroduction"),
        ("s", 1, 7, 7, "heading_candidate", None, "Table IV: Baseline data.", "Table IV: Baseline data."),
        ("s", 1, 8, 8, "heading_candidate", None, "3. Methods used", "3. Methods used"),
        ("s", 1, 9, 9, "cross_reference_lead", None, "See Section 4 for detail", "3. Methods used"),
        ("s", 2, 3, 3, "heading_candidate", None, "Participant flow", "Participant flow"),
        ("s", 2, 3, 7, "page_excerpt", None, "Participant flow Protoco", "Participant flow"),
        ("s", 2, 5, 5, "date_lead", "version", "Protocol version 2.0 ame", "Participant flow"),
        ("s", 2, 5, 5, "version_lead", None, "Protocol version 2.0 ame", "Participant flow"),
        ("s", 2, 6, 6, "date_lead", "approval", "Approved on 2031-05-03", "Participant flow"),
        ("s", 2, 7, 7, "contents_lead", None, "Results .......... 12", "Participant flow"),
        ("t", 1, 1, 1, "page_excerpt", None, "no entry of its own, as ", None),
    ]


def test_headings_are_carried_over_blocks(spark):
    rows = [("s", p, "Opening\n\n" + f"Part {p}\n\nprose that ends." if p in (1, 450) else f"plain prose {p} that ends, nothing else.") for p in range(1, 900)]
    sections = {r[1]: r[7] for r in entries(spark, rows) if r[4] == "page_excerpt"}
    assert sections[449] == "Part 1" and sections[899] == "Part 450"


def test_flow_captions_that_were_read_leave(spark):
    pages = spark.createDataFrame([("s", 1, "Patient disposition\n\na\nb"), ("s", 2, "x\n\nOutcome ascertainment\n\ny"), ("s", 3, "Disposition\n\nc"), ("u", 1, "CONSORT\n\nz")], PAGES)
    reads = spark.createDataFrame([("s", 1, 1, 3), ("s", 1, 3, 9), ("s", 2, 4, 5), ("u", 1, 1, 2)], "source_id string, page int, first long, last long")
    got = navigation.flow_captions(navigation.navigation(pages), pages, reads).collect()
    assert {(r.source_id, r.page, r.start_line, r.end_line, r.place) for r in got} == {("s", 2, 3, 5, 1), ("u", 1, 1, 3, 1)}
