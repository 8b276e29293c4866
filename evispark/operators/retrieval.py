"""Ranked lexical retrieval over pages.

A page is indexed in two columns, its text and its searchable form where that
differs, as Porter stems of words without accents.  The index is staged once;
documents' counts and lengths and all queries of a batch read it.  A query's
terms are phrases of one or more words.  Queries are a stated, bounded set,
broadcast after a count, so that the index never shuffles by term; only hits
leave the map side.  Phrase frequency, number of pages and mean length are those
of the pages that are searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.plans import broadcast_if_small, staged

#: Robertson and Zaragoza's usual constants
K1, B = 1.2, 0.75
#: most query terms that are broadcast
QUERY_TERMS = 100_000
#: most sources whose reading order is broadcast
SOURCES = 200_000
#: Feedback terms and sources, suggestions per term and in all, result limit.
FEEDBACK_TERMS, FEEDBACK_SOURCES, PER_TERM, SUGGESTIONS, LIMIT = 16, 64, 3, 8, 100
PAGE = ["source_id", "page"]


def plain_terms(column):
    """ASCII words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9]+)"), 1)


def index(pages: DataFrame, stemmed: bool = True) -> DataFrame:
    """(source_id, page, terms, length): each page's terms in order and their number, staged.

    Unstemmed, the text's own words make the only column.  Pages without a text
    are not indexed.
    """
    terms = T.column("search_terms")(F.col("text")) if stemmed else T.column("plain_tokens")(F.col("text"))
    held = pages.where(F.col("text").isNotNull()).select(*PAGE, terms.alias("terms"))
    return staged(held.withColumn("length", F.size(F.filter("terms", lambda t: t != "")).cast("long")))


def query_phrases(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """(query_id, mode, n_phrases, phrase, n_words, at, term): the words of each query's phrases.

    In mode 'phrase' all words of the query are one phrase.
    """
    parts = T.column("stemmed_phrases" if stemmed else "query_phrases")(F.col("query"))
    phrases = F.when((F.col("mode") == "phrase") & (F.size(parts) > 0), F.array(F.flatten(parts))).otherwise(parts)
    each = queries.select("query_id", "mode", phrases.alias("phrases")).select("query_id", "mode", F.size("phrases").alias("n_phrases"), F.posexplode("phrases").alias("phrase", "words"))
    return each.select("query_id", "mode", "n_phrases", "phrase", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "term"))


def phrase_hits(indexed: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, mode, n_phrases, phrase, source_id, page, length, tf): how often each phrase stands in each page.

    In mode 'prefix' a phrase's last word is the beginning of the page's word;
    beginnings of any length count.
    """
    wanted = broadcast_if_small(phrases, QUERY_TERMS)
    places = indexed.select(*PAGE, "length", F.posexplode("terms").alias("pos", "held"))
    begins = (F.col("mode") == "prefix") & (F.col("at") == F.col("n_words") - 1)
    whole = wanted.where(~begins)
    # page words meet beginnings by equality, at the lengths that the queries have
    begun = phrases.where(begins)
    lengths = sorted(r[0] for r in begun.select(F.char_length("term")).distinct().collect())  # at most the longest query word
    columns = ["query_id", "mode", "n_phrases", "phrase", "n_words", "at", *PAGE, "length", "pos"]
    met = places.join(whole, F.col("held") == F.col("term")).select(*columns)
    if lengths:
        starts = F.explode(F.filter(F.array(*[F.when(F.char_length("held") >= n, F.substring("held", 1, n)) for n in lengths]), lambda x: x.isNotNull()))
        met = met.unionByName(places.withColumn("start_of", starts).join(broadcast_if_small(begun, QUERY_TERMS), F.col("start_of") == F.col("term")).select(*columns))
    keys = ["query_id", "mode", "n_phrases", "phrase", *PAGE, "length"]
    one = met.where("n_words = 1").groupBy(*keys).agg(F.count("*").alias("tf"))
    runs = met.where("n_words > 1").groupBy(*keys, (F.col("pos") - F.col("at")).alias("start"), "n_words").agg(F.count("*").alias("n")).where("n = n_words")
    return one.unionByName(runs.groupBy(*keys).agg(F.count("*").alias("tf")))


def scores(pages: DataFrame, queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """(query_id, mode, source_id, page, score, n_matched, n_phrases): BM25 of pages with a query's phrases.

    Modes 'any' (one phrase is enough), 'all' (every phrase), 'phrase' (all
    words in a row) and 'prefix' (a word begins with a query word).  A phrase
    that half of the pages or more hold weighs 1e-6, as negative weights would
    rank its absence.  score is larger for better pages.
    """
    indexed = index(pages, stemmed)
    hits = phrase_hits(indexed, query_phrases(queries, stemmed))
    frequency = F.broadcast(hits.groupBy("query_id", "phrase").agg(F.count("*").alias("df")))  # one row per phrase of the counted queries
    total = indexed.agg(F.count("*").alias("n_pages"), F.avg("length").alias("mean_length"))
    odds = F.log((F.col("n_pages") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(odds > 0, odds).otherwise(F.lit(1e-6))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    found = (
        hits.join(frequency, ["query_id", "phrase"]).crossJoin(F.broadcast(total))  # one row
        .groupBy("query_id", "mode", "n_phrases", *PAGE)
        .agg(F.sum(part).alias("score"), F.count("*").alias("n_matched"))
    )
    return found.where((F.col("mode") != "all") | (F.col("n_matched") == F.col("n_phrases"))).select("query_id", "mode", *PAGE, "score", "n_matched", "n_phrases")


def phrase_pages(pages: DataFrame, queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """(query_id, source_id, page, n_hits): pages with a query's words in a row, by token positions."""
    asked = query_phrases(queries.withColumn("mode", F.lit("phrase")), stemmed)
    return phrase_hits(index(pages, stemmed), asked).select("query_id", *PAGE, F.col("tf").alias("n_hits"))


def literal_pages(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source_id, page, spans): pages with a query's exact wording, unscored.

    A page is looked through only if it holds the query's longest word; a query
    without words stands nowhere.
    """
    asked = broadcast_if_small(queries.select("query_id", "query", T.column("literal_anchor")(F.col("query")).alias("anchor")).where("anchor is not null"), QUERY_TERMS)
    held = pages.where(F.col("text").isNotNull())
    met = held.select(*PAGE, F.explode(T.column("literal_words")(F.col("text"))).alias("anchor")).join(asked, "anchor").select("query_id", "query", *PAGE)
    found = met.join(held.select(*PAGE, "text"), PAGE).select("query_id", *PAGE, T.column("literal_spans")(F.col("text"), F.col("query")).alias("spans"))
    return found.where(F.size("spans") > 0)


def reading_order(sources: DataFrame) -> DataFrame:
    """(source_id, role_place, path): what orders sources for reading; ``sources`` has (source_id, role, path).

    A source that is listed twice counts by its first place.
    """
    from evispark.operators.projections import role_rank

    place = F.min(F.struct(role_rank(F.col("role")).alias("role_place"), F.lower("path").alias("path"))).alias("p")
    return sources.groupBy("source_id").agg(place).select("source_id", "p.role_place", "p.path")


def ranked(found: DataFrame, limit: int = LIMIT, decimals: int = 4, order: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` pages of each query: rank and rank within the source.

    Ties go by the sources' reading order (role, path without case, id; sources
    that ``order`` does not list come last), then by page; without ``order`` by
    source id.  Scores are compared at ``decimals`` places, so that the order of
    summation cannot decide.
    """
    rounded = found.withColumn("score", F.round("score", decimals))
    ties = [F.asc("source_id"), F.asc("page")]
    if order is not None:
        rounded = rounded.join(broadcast_if_small(order, SOURCES), "source_id", "left")
        ties = [F.asc_nulls_last("role_place"), F.asc_nulls_last("path"), *ties]
    top = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *ties))).where(F.col("rank") <= limit)
    return top.drop("role_place", "path").withColumn("source_rank", F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy("rank")))


def result_page(hits: DataFrame, offset: int, limit: int) -> DataFrame:
    """Ranks offset + 1 to offset + limit of each query, and whether more follow."""
    last = Window.partitionBy("query_id")
    return hits.withColumn("truncated", F.max("rank").over(last) > offset + limit).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def cursor(session, offset: int):
    """An opaque cursor bound to a session identity."""
    return F.concat(F.lit("sc_"), F.substring(session, 8, 16), F.lit(f"_{offset}"))


def term_feedback(pages: DataFrame, queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """(query_id, source_id, phrase, n_pages): pages per source that hold each of a query's first 16 terms."""
    first = query_phrases(queries.withColumn("mode", F.lit("any")), stemmed).where(F.col("phrase") < FEEDBACK_TERMS)
    return phrase_hits(index(pages, stemmed), first).groupBy("query_id", "source_id", "phrase").agg(F.count("*").alias("n_pages"))


def feedback_sources(feedback: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, source_id, place): sources for feedback, those with hits first, at most 64."""
    matched = hits.select("query_id", "source_id").distinct().withColumn("hit", F.lit(0))
    known = feedback.select("query_id", "source_id").distinct().join(matched, ["query_id", "source_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.coalesce("hit", F.lit(1)), "source_id")
    return known.withColumn("place", F.row_number().over(w)).where(F.col("place") <= FEEDBACK_SOURCES).select("query_id", "source_id", "place")


def spelling_catalogue(pages: DataFrame) -> DataFrame:
    """(word, n_pages, source_id, page): words of 5 to 40 ASCII letters, their pages and the first of them."""
    words = pages.select(*PAGE, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("word")).where(F.col("word").rlike("^[a-z]{5,40}$"))
    return words.groupBy("word").agg(F.count("*").alias("n_pages"), F.min(F.struct(*PAGE)).alias("first")).select("word", "n_pages", "first.source_id", "first.page")


def suggestions(terms: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(term, word, distance, place): words within one edit of a term (two, from ten letters on).

    Terms and words meet where they agree on one of their deletion variants, so
    no term is compared with the whole catalogue: two words within d edits
    share a variant with at most d letters left out.
    """
    import pyarrow as pa

    def variants(words: pa.Array) -> pa.Array:
        out = []
        for word in words.to_pylist():
            kept = {word}
            level = {word}
            for _ in range(2 if len(word or "") >= 8 else 1):
                level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
                kept |= level
            out.append(sorted(kept) if word else [])
        return pa.array(out, pa.list_(pa.string()))

    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([T.osa_distance(x, y, 2) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    variants.__annotations__ = {"words": pa.Array, "return": pa.Array}
    distance.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    cut, apart = F.arrow_udf(variants, "array<string>"), F.arrow_udf(distance, "int")
    left = terms.where(F.col("term").rlike("^[a-z]{5,40}$")).select("term", F.explode(cut("term")).alias("v"))
    right = catalogue.select("word", "n_pages", F.explode(cut("word")).alias("v"))
    near = left.join(right, "v").where("term <> word").select("term", "word", "n_pages").distinct()
    near = near.withColumn("distance", apart("term", "word")).where(F.col("distance") <= F.when(F.length("term") <= 9, 1).otherwise(2))
    w = Window.partitionBy("term").orderBy("distance", F.desc("n_pages"), "word")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= PER_TERM).select("term", "word", "distance", "place")


def reading_leads(pages: DataFrame, questions: DataFrame, k: int = 4, stemmed: bool = True, order: DataFrame | None = None) -> DataFrame:
    """The best ``k`` pages of each question by its words of at least five letters."""
    long = F.array_join(F.filter(plain_terms(F.col("query")), lambda w: F.length(w) >= 5), " ")
    return ranked(scores(pages, questions.select("query_id", F.lit("any").alias("mode"), long.alias("query")), stemmed), k, order=order)


def lines(pages: DataFrame) -> DataFrame:
    """(source_id, page, line_no, start, line): the lines of each page from 1, with their first character's place."""
    cut = pages.select(*PAGE, F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    w = Window.partitionBy(*PAGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select(*PAGE, (F.col("at") + 1).alias("line_no"), F.coalesce(F.sum(F.char_length("line") + 1).over(w), F.lit(0)).alias("start"), "line")


def match_clusters(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source_id, page, cluster, first_line, last_line, n_lines): lines with query terms, neighbours joined."""
    terms = F.explode(F.array_distinct(plain_terms(F.col("query")))).alias("term")
    wanted = broadcast_if_small(queries.select("query_id", terms).distinct(), QUERY_TERMS)
    cut = pages.select(*PAGE, F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    hit = cut.select(*PAGE, (F.col("at") + 1).alias("line_no"), F.explode(F.array_distinct(plain_terms(F.col("line")))).alias("term"))
    hit = hit.join(wanted, "term").select("query_id", *PAGE, "line_no").distinct()
    w = Window.partitionBy("query_id", *PAGE).orderBy("line_no")
    new = hit.withColumn("new", (F.col("line_no") > F.coalesce(F.lag("line_no").over(w), F.lit(-1)) + 1).cast("int"))
    islands = new.withColumn("cluster", F.sum("new").over(w))
    return islands.groupBy("query_id", *PAGE, "cluster").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"))


def select_lines(pages: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, text): lines first to last of a page, from 1; windows without any character but blanks leave."""
    asked = windows.where("start_line >= 1 and end_line >= start_line").select("window_id", *PAGE, "start_line", "end_line")
    cut = F.slice(F.split("text", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return asked.join(pages.select(*PAGE, "text"), PAGE).select("window_id", F.array_join(cut, "\n").alias("text")).where(F.trim(F.regexp_replace("text", "\n", " ")) != "")


def continuations(candidates: DataFrame, included: DataFrame) -> DataFrame:
    """(session, next_rank): the first rank of each session that was not included yet."""
    return candidates.join(included, ["session", "rank"], "left_anti").groupBy("session").agg(F.min("rank").alias("next_rank"))


def windows_within(pages: DataFrame, most_bytes: int = 512) -> DataFrame:
    """(source_id, page, n_lines, n_bytes): whole lines from the first on that fit the bytes, per page."""
    cut = lines(pages)
    w = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumn("bytes", F.sum(F.octet_length("line") + 1).over(w)).where(F.col("bytes") <= most_bytes)
    return summed.groupBy(*PAGE).agg(F.count("*").alias("n_lines"), F.max("bytes").alias("n_bytes"))
