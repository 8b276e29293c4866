"""Projections, predicates and leaf tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles in reading order, and the file-name parts that name a role.
ROLES = ["main_article", "registry", "supplement", "sap", "protocol", "other"]
ROLE_PARTS = [("disclosure", "other"), ("protocol", "protocol"), ("sap", "sap"), ("analysis", "sap"), ("supp", "supplement"), ("appendix", "supplement"), ("registry", "registry"), ("nct", "registry")]
#: Keys that a shared record must not hold.
PRIVATE_KEYS = ("answer_label", "restricted", "reference", "api_key", "path", "password")


def role_rank(role: Column) -> Column:
    """The place of a role in reading order, 5 for unknown ones."""
    place = F.array_position(F.array(*map(F.lit, ROLES)), role)
    return F.when(place > 0, place - 1).otherwise(len(ROLES) - 1)


def role_of_path(path: Column) -> Column:
    """The role that a file's name, without its suffix and without regard to case, suggests; the first rule that fits.

    A PDF without a telling name is the main article, anything else is other.
    """
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, role in ROLE_PARTS:
        out = out.when(stem.contains(part), role)
    return out.when(name.rlike(r".\.pdf$"), "main_article").otherwise("other")


def listed_sources(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Sources of each key in reading order: role, path without case, id."""
    w = Window.partitionBy(*keys).orderBy(role_rank(F.col("role")), F.lower("path"), "source_id")
    return sources.withColumn("place", F.row_number().over(w))


def leaf_table(records: DataFrame, key: str, body: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, value) of every leaf of a JSON body, the path as a JSON pointer; keys in ``skip`` leave with all below.

    In a pointer "~" stands as "~0" and "/" as "~1", so names of any characters
    are told apart.  Unreadable and null bodies have no leaves.
    """
    from evispark.operators.nested import nodes

    tree = nodes(records, key, body, None, pointers=True).where(~F.col("kind").isin("object", "array"))
    out = tree.select(F.col("key").alias(key), F.col("schema_path").alias("path"), "value")
    for name in skip:
        held = "/" + name.replace("~", "~0").replace("/", "~1")
        out = out.where(~(F.concat("path", F.lit("/")).contains(held + "/")))
    return out


def leaks_path(text: Column) -> Column:
    """Whether a text begins like a drive or network path."""
    return text.rlike(r"^[A-Za-z]:[\\/]") | text.startswith("\\\\")


def private_leaves(leaves: DataFrame, key: str) -> DataFrame:
    """(key, path): leaves below a private key, without regard to case, or with a slash or backslash in the value."""
    named = F.lower("path").rlike(f"(^|/)({'|'.join(PRIVATE_KEYS)})(/|$)")
    return leaves.where(named | F.col("value").rlike(r"[/\\]")).select(key, "path")


def first_true(limits: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds, null if none does."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in limits])


def same_wording(a: Column, b: Column) -> Column:
    """Equal without regard to case and runs of blanks."""
    form = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return form(a).eqNullSafe(form(b))


def missing_fields(names: list[str]) -> Column:
    """The names of the columns that are null."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))


def label_words(key: Column) -> Column:
    """A camel-case key as a sentence of words, without a closing Struct: studyFirstSubmitDate is Study first submit date."""
    spaced = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(key, "Struct$", ""), r"(?<=[a-z0-9])(?=[A-Z])", " "), r"\s+", " ")))
    return F.when(spaced == "", key).otherwise(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30)))


def measurement(value: Column, spread: Column, low: Column, high: Column, comment: Column) -> Column:
    """value (spread) (low to high) [comment], with what is known; one bound alone is shown, too."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    wrap = lambda known, *parts: F.when(known, F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts])).otherwise("")
    return F.concat(
        text(value), wrap(spread.isNotNull(), " (", spread, ")"), wrap(low.isNotNull() | high.isNotNull(), " (", low, " to ", high, ")"), wrap(F.coalesce(comment.cast("string") != "", F.lit(False)), " [", comment, "]")
    )


def table_rows(cells: Column, width: Column) -> Column:
    """A table row in Markdown: cells padded to the width, pipes escaped, line breaks as blanks."""
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    clean = F.transform(padded, lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def identity(json_text: Column) -> Column:
    """A content identity: the hash of canonical JSON, as text."""
    return F.concat(F.lit("sha256:"), F.sha2(json_text, 256))


def source_identity(trial: Column, path: Column, digest: Column) -> Column:
    """The identity of a source by trial, path and content hash, joined by NUL."""
    return F.concat(F.lit("source_"), F.sha2(F.concat_ws("\x00", trial, path, digest), 256))


def handle(source_id: Column, prefix: str = "sh_") -> Column:
    """A short handle: the prefix and 16 hexadecimal digits of an identity."""
    return F.concat(F.lit(prefix), F.regexp_extract(source_id, "([0-9a-f]{16})[0-9a-f]*$", 1))


def harvested(text: Column) -> Column:
    """The distinct identities and handles in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(sha256:[0-9a-f]{64}|\b[a-z]{2}_[0-9a-f]{16}\b)"), 1)))


def projection_hash(pages: DataFrame, sources: DataFrame, recipe: str) -> DataFrame:
    """(source_id, projection_hash, page_count): the identity of a source's text projection.

    ``pages`` has (source_id, page, text), ``sources`` (source_id, sha256,
    media_type), ``recipe`` names the extraction.  It is the hash of canonical
    JSON of these with the hashes of the page texts in page order; a null text
    counts as empty, repeated rows of a page once, sources without pages have
    none.  Pages reach one task per source as hashes, sorted, and are fed to the
    digest one by one, so no source is held in memory.
    """
    each = pages.select("source_id", "page", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).dropDuplicates(["source_id", "page"])
    known = sources.groupBy("source_id").agg(F.min(F.struct("sha256", "media_type")).alias("s"))
    ordered = each.join(known, "source_id").select("source_id", "s.sha256", "s.media_type", "page", "h").repartition("source_id").sortWithinPartitions("source_id", "page")
    text = lambda value: json.dumps(value, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, digest, tail, n = None, None, "", 0
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if source is not None:
                digest.update(f"]{tail}".encode())
                for column, value in zip(out, (source, f"sha256:{digest.hexdigest()}", n)):
                    column.append(value)

        for batch in batches:
            for source_id, sha, media, _, h in zip(*(c.to_pylist() for c in batch.columns)):
                if source_id != source:
                    close()
                    source, n = source_id, 0
                    digest = hashlib.sha256(f'{{"media_type":{text(media)},"page_hashes":['.encode())
                    tail = f',"recipe":{text(recipe)},"source_sha256":{text(sha)}}}'
                digest.update(f'{"," if n else ""}"sha256:{h}"'.encode())
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["source_id", "projection_hash", "page_count"])

    return ordered.mapInArrow(run, "source_id string, projection_hash string, page_count long")


def reproduced(projections: DataFrame, stated: DataFrame) -> DataFrame:
    """(source_id, state): 'same', 'differs' or 'missing' for each stated (source_id, projection_hash) against the recomputed ones."""
    found = projections.select("source_id", F.col("projection_hash").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("projection_hash"), "same").otherwise("differs")
    return stated.join(found, "source_id", "left").select("source_id", state.alias("state"))


def canonical_json():
    """(text) -> canonical JSON of a JSON text: sorted keys, no blanks, letters as they are; null for what is no JSON."""
    from evispark.operators.nested import parse_json

    @F.arrow_udf("string")
    def canonical(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts.to_pylist():
            try:
                out.append(None if value is None else json.dumps(parse_json(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "replace").decode())
            except (ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.string())

    return canonical


def date_lead(line: Column) -> tuple[Column, Column]:
    """(date text, kind) of a dated line."""
    date = F.regexp_extract(line, r"(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}|\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})", 1)
    low = F.lower(line)
    kind = F.when(low.contains("amend"), "amendment").when(low.contains("version"), "version").when(low.contains("regist"), "registration").when(low.contains("enrol"), "enrolment").otherwise("date")
    return date, kind
