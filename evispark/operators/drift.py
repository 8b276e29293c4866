"""Schemas that drift between files.

The catalogue holds, for each producer (kind), file, field and type, whether
the field stood there.  Lifespans are islands over the producer's ordered
files; their starts and endings are the changes.  A field that ends where a
field with mostly the same values starts was renamed; the renames form the
alias table from which the casts of one consistent table come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.plans import broadcast_if_small, cut_lineage

#: largest catalogue of changed fields that is broadcast; a larger one is joined with salt
CATALOGUE_ROWS = 100_000
_SALTS = 32


def normal_kind(column):
    """Lower case, no surrounding blanks, '-' as '_'."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), "-", "_")


def json_type(variant_type):
    """string, number, boolean, array or object for a type name of schema_of_variant; null for null."""
    t = F.upper(variant_type)
    return (
        F.when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", F.lit(None).cast("string"))
        .when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)"), "number")
        .otherwise("string")
    )


def payload_fields(records: DataFrame) -> DataFrame:
    """(kind, file, field, type, value) of each non-null top-level field of each readable payload.

    ``records`` has (kind, file, payload).  Unreadable, cut-off and null
    payloads and payloads that are no object give nothing.
    """
    spark = records.sparkSession
    read = records.select("kind", "file", F.try_parse_json("payload").alias("v")).where(
        F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    )
    fields = read.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).alias("e"))
    return fields.select(
        "kind", "file", F.col("e.key").alias("field"), json_type(F.schema_of_variant(F.col("e.value"))).alias("type"),
        F.col("e.value").alias("variant"),
    ).where(F.col("type").isNotNull())


def catalogue(records: DataFrame) -> DataFrame:
    """(kind, file, seq, field, type): each field of each file with its type.

    seq numbers the files of a kind in name order, files without a readable
    payload included.  A field that has several types in one file has the most
    frequent one, the first by name among equals.  Partial counts run before
    the shuffle, so a hot kind or file sends one row per field and task.
    """
    files = records.where(F.col("kind").isNotNull() & F.col("file").isNotNull()).select("kind", "file").distinct()
    files = files.withColumn("seq", F.row_number().over(Window.partitionBy("kind").orderBy("file")))
    counts = payload_fields(records).groupBy("kind", "file", "field", "type").agg(F.count("*").alias("n"))
    main = Window.partitionBy("kind", "file", "field").orderBy(F.desc("n"), "type")
    typed = counts.withColumn("place", F.row_number().over(main)).where("place = 1")
    return typed.join(files, ["kind", "file"]).select("kind", "file", "seq", "field", "type")


def lifespans(fields: DataFrame) -> DataFrame:
    """(kind, field, type, first_seq, last_seq) of each unbroken run of a field with one type."""
    w = Window.partitionBy("kind", "field").orderBy("seq")
    new = (F.lag("seq").over(w).isNull() | (F.col("seq") != F.lag("seq").over(w) + 1) | (F.col("type") != F.lag("type").over(w))).cast("int")
    islands = fields.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return islands.groupBy("kind", "field", "type", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).drop("island")


def changes(records: DataFrame, rename_share: float = 0.5) -> DataFrame:
    """(kind, export_file, field, change, new_field) of every change between a file and the one before.

    ``records`` has (kind, file, payload); further columns are ignored, rows
    may repeat, an empty table gives no changes.  change is 'added', 'removed',
    'retyped' or 'renamed'.  A field gone and a field new in one file with one
    type are renamed if at least ``rename_share`` of the new one's distinct
    values in that file stood under the old one in an earlier file; a field
    takes part in one rename, that with the largest share, the first names
    among equals.
    """
    fields = cut_lineage(catalogue(records))
    files = records.where(F.col("kind").isNotNull() & F.col("file").isNotNull()).select("kind", "file").distinct()
    files = cut_lineage(files.withColumn("seq", F.row_number().over(Window.partitionBy("kind").orderBy("file"))))
    runs = lifespans(fields)
    last = files.groupBy("kind").agg(F.max("seq").alias("final"))

    starts = runs.where("first_seq > 1").select("kind", "field", "type", F.col("first_seq").alias("seq"))
    endings = runs.join(last, "kind").where("last_seq < final").select("kind", "field", "type", (F.col("last_seq") + 1).alias("seq"))
    retyped = starts.alias("s").join(endings.alias("e"), ["kind", "field", "seq"]).select("kind", "seq", "field", F.lit("retyped").alias("change"), F.lit("").alias("new_field"))
    same = ["kind", "field", "seq"]
    new = starts.join(endings.select(*same), same, "left_anti")
    gone = endings.join(starts.select(*same), same, "left_anti")

    pairs = gone.select("kind", "seq", "type", F.col("field").alias("old")).join(new.select("kind", "seq", "type", F.col("field").alias("fresh")), ["kind", "seq", "type"])
    renamed = cut_lineage(_renames(records, files, cut_lineage(pairs), rename_share))

    plain = [
        side.join(renamed.select("kind", "seq", F.col(name).alias("field")), ["kind", "seq", "field"], "left_anti")
        .select("kind", "seq", "field", F.lit(change).alias("change"), F.lit("").alias("new_field"))
        for side, name, change in ((new, "fresh", "added"), (gone, "old", "removed"))
    ]
    moved = renamed.select("kind", "seq", F.col("old").alias("field"), F.lit("renamed").alias("change"), F.col("fresh").alias("new_field"))
    found = plain[0].unionByName(plain[1]).unionByName(retyped).unionByName(moved)
    return found.join(files, ["kind", "seq"]).select("kind", F.col("file").alias("export_file"), "field", "change", "new_field")


def _renames(records: DataFrame, files: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """(kind, seq, old, fresh) of the pairs whose values agree."""
    wanted = pairs.select("kind", F.col("old").alias("field")).union(pairs.select("kind", F.col("fresh").alias("field"))).distinct()
    small = broadcast_if_small(wanted, CATALOGUE_ROWS)
    values = payload_fields(records)
    if small is wanted:  # too many changed fields to broadcast: salt both sides, as few kinds hold most rows
        values = values.withColumn("salt", F.pmod(F.xxhash64(F.to_json("variant")), F.lit(_SALTS)))
        small = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
        values = values.join(small, ["kind", "field", "salt"]).drop("salt")
    else:
        values = values.join(small, ["kind", "field"])
    # the distinct values leave the map side as fingerprints; equal values meet by them
    distinct = values.select("kind", "file", "field", F.xxhash64(F.to_json("variant"), F.length(F.to_json("variant"))).alias("value")).distinct()
    distinct = cut_lineage(distinct.join(broadcast_if_small(files, CATALOGUE_ROWS), ["kind", "file"]).select("kind", "seq", "field", "value"))

    ahead = pairs.select("kind", "seq", "old", F.col("fresh").alias("field")).join(distinct, ["kind", "seq", "field"])
    first = distinct.groupBy("kind", F.col("field").alias("old"), "value").agg(F.min("seq").alias("first_seq"))
    met = (
        ahead.join(first, ["kind", "old", "value"], "left")
        .groupBy("kind", "seq", "old", F.col("field").alias("fresh"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("first_seq") < F.col("seq")).alias("hits"))
        .where(F.col("hits") >= share * F.col("n"))
        .withColumn("part", F.col("hits") / F.col("n"))
    )
    by_old = Window.partitionBy("kind", "seq", "old").orderBy(F.desc("part"), "fresh")
    by_new = Window.partitionBy("kind", "seq", "fresh").orderBy(F.desc("part"), "old")
    return met.withColumn("a", F.row_number().over(by_old)).withColumn("b", F.row_number().over(by_new)).where("a = 1 and b = 1").select("kind", "seq", "old", "fresh")


def alias_table(changed: DataFrame) -> DataFrame:
    """(kind, field, name): the last name of each renamed field, its renames followed in file order.

    A later rename of a name takes the place of an earlier one; a field that got
    its first name back is in no row, the names it had between are.
    """

    def last_names(moves: list) -> list[tuple[str, str]]:
        names: dict[str, str] = {}
        for move in moves:
            names |= {field: move["new_field"] for field, name in names.items() if name == move["field"]}
            names |= {move["field"]: move["new_field"], move["new_field"]: move["new_field"]}
        return [(field, name) for field, name in names.items() if field != name]

    resolve = F.udf(last_names, "array<struct<field: string, name: string>>")
    moves = changed.where("change = 'renamed'").groupBy("kind").agg(F.sort_array(F.collect_set(F.struct("export_file", "field", "new_field"))).alias("moves"))
    return cut_lineage(moves.select("kind", F.explode(resolve("moves")).alias("e")).select("kind", "e.field", "e.name"))


def text_type(text):
    """string, number, boolean, array or object for a JSON text; null for null."""
    head = F.substring(text, 1, 1)
    return (
        F.when(head == '"', "string").when(head == "{", "object").when(head == "[", "array").when(head.isin("t", "f"), "boolean")
        .when(head != "n", "number")
    )


def cast_text(text, target):
    """A JSON text as one of type ``target``, null where it has no such form.

    Everything has a form as string (its own JSON text) and as array (a list of
    one); a number or boolean may stand in a string, and 1 and 0 are booleans.
    """
    own = text_type(text)
    said = F.when(own == "string", F.trim(F.regexp_replace(text, '^"|"$', ""))).otherwise(text)
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return (
        F.when(own == target, text).when(target == "string", quoted).when(target == "array", F.concat(F.lit("["), text, F.lit("]")))
        .when((target == "number") & (own == "string") & said.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), said)
        .when((target == "boolean") & F.lower(said).isin("true", "1"), "true").when((target == "boolean") & F.lower(said).isin("false", "0"), "false")
    )


def consistent_table(records: DataFrame, keys: list[str], aliases: DataFrame) -> DataFrame:
    """One row per record with its fields under one name each.

    ``records`` has ``keys`` plus (kind, file, payload).  Returns ``keys``, kind,
    file, readable and three maps from the field's last name to a JSON text:
    ``fields`` has the value as delivered; ``typed`` has it cast to the one type
    of its kind and name, that of most of their values, the first by name among
    equals; ``uncast`` has the delivered text where the cast fails.  Null and
    absent fields are both absent.  Two fields of a record that share a name
    keep the one under the newest name.
    """
    small = broadcast_if_small(aliases, CATALOGUE_ROWS)
    spark = records.sparkSession
    parsed = records.dropDuplicates(keys).withColumn("v", F.try_parse_json("payload"))
    is_object = F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    wide = parsed.withColumn("v", F.when(is_object, F.col("v"))).lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()).alias("e"))
    named = wide.select(*keys, "kind", "file", F.col("v").isNotNull().alias("readable"), F.col("e.key").alias("field"), F.to_json("e.value").alias("value")).join(small, ["kind", "field"], "left")
    best = named.groupBy(*keys, "kind", "file", "readable", F.coalesce("name", "field").alias("name")).agg(F.max_by("value", F.when(F.col("field") == F.coalesce("name", "field"), 1).otherwise(0)).alias("value"))
    value = F.when(F.col("value") != "null", F.col("value"))
    counts = best.withColumn("type", text_type(value)).where("type is not null and kind is not null").groupBy("kind", "name", "type").agg(F.count("*").alias("n"))
    chosen = counts.groupBy("kind", "name").agg(F.min(F.struct(-F.col("n"), "type"))["type"].alias("type"))
    held = best.join(broadcast_if_small(cut_lineage(chosen), CATALOGUE_ROWS), ["kind", "name"], "left").withColumn("cast", cast_text(value, F.coalesce("type", text_type(value))))
    pairs = lambda of, where: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull() & value.isNotNull() & where, F.struct("name", of.alias("value"))))))
    done = F.col("cast").isNotNull()
    return held.groupBy(*keys, "kind", "file", "readable").agg(pairs(value, F.lit(True)).alias("fields"), pairs(F.col("cast"), done).alias("typed"), pairs(value, ~done).alias("uncast"))
