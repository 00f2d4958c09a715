"""Small functions on columns; all of them native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type ids of the database's catalogue.
BOOL, INTS, FLOATS, JSONS = 16, (20, 21, 23), (700, 701, 1700), (114, 3802)


def parse_oid(value: Column, oid: Column) -> Column:
    """(value, bad): text of a column by its type id. Booleans become true or false, numbers
    their usual form, everything else stays; a number that doesn't parse gives null and bad."""
    number = F.when(oid.isin(*INTS), value.try_cast("bigint").cast("string")).when(oid.isin(*FLOATS), value.try_cast("double").cast("string"))
    parsed = F.when(oid == BOOL, F.when(value == "t", "true").when(value.isNotNull(), "false")).when(oid.isin(*INTS, *FLOATS), number).otherwise(value)
    return F.struct(parsed.alias("value"), (value.isNotNull() & parsed.isNull()).alias("bad"))


def parse_flex_time(text: Column) -> Column:
    """Epoch milliseconds of a date with time in a blank or T form, with or without a
    fraction; without a zone the blank form is UTC. Null if it is none of these. Needs the
    session's zone to be UTC."""
    short = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    day = r"^\d{4}-\d{2}-\d{2}"
    clock = r"\d{2}:\d{2}:\d{2}(\.\d+)?"
    zoned = F.when(text.rlike(rf"{day} {clock}[+-]\d{{2}}(:?\d{{2}})?$"), F.try_to_timestamp(short, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]X")))
    iso = F.when(text.rlike(rf"{day}T{clock}(Z|[+-]\d{{2}}:\d{{2}})$"), F.try_to_timestamp(short, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX")))
    plain = F.when(text.rlike(rf"{day} {clock}$"), F.try_to_timestamp(short, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")))
    return F.unix_millis(F.coalesce(zoned, iso, plain))


def sanitize_doc(doc: Column) -> Column:
    """An image made fit for a document index: an empty object under ``metadata`` becomes an
    empty string, and texts under names that end in _at or time, or are timestamp, become
    epoch milliseconds if they parse."""

    def clean(key: Column, value: Column) -> Column:
        timely = key.endswith("_at") | key.endswith("time") | (key == "timestamp")
        return F.when((key == "metadata") & value.rlike(r"^\s*\{\s*\}\s*$"), "").when(timely, F.coalesce(parse_flex_time(value).cast("string"), value)).otherwise(value)

    return F.transform_values(doc, clean)


def quote_ident(name: Column, style: str = "double") -> Column:
    """A table name quoted part by part, split at its first dot, inner quotes doubled."""
    q = {"double": '"', "backtick": "`"}[style]
    quote = lambda part: F.concat(F.lit(q), F.replace(part, F.lit(q), F.lit(q + q)), F.lit(q))
    dot = F.locate(".", name)
    return F.when(dot > 0, F.concat(quote(F.substring(name, F.lit(1), dot - 1)), F.lit("."), quote(F.substring(name, dot + 1, F.length(name))))).otherwise(quote(name))


def split_table_ident(name: Column, default: str = "public") -> Column:
    """(schema, table) of a name, split at its first dot."""
    dot = F.locate(".", name)
    return F.struct(
        F.when(dot > 0, F.substring(name, F.lit(1), dot - 1)).otherwise(F.lit(default)).alias("schema"),
        F.when(dot > 0, F.substring(name, dot + 1, F.length(name))).otherwise(name).alias("tbl"),
    )


def msg_id(instance: Column, offset: Column, *ordinals: Column) -> Column:
    """Identity of a message: instance, offset and any ordinals; null without an offset."""
    return F.when(F.coalesce(offset, F.lit("")) != "", F.concat_ws("-", instance, offset, *[o.cast("string") for o in ordinals]))


def topic_of(subject: Column, prefix: str = "cdc") -> Column:
    """The second token of a subject that starts with the prefix, else empty."""
    parts = F.split(subject, r"\.")
    return F.when((F.element_at(parts, 1) == prefix) & (F.size(parts) > 1), F.try_element_at(parts, F.lit(2))).otherwise(F.lit(""))


def dlq_subject(subject: Column) -> Column:
    return F.concat(F.lit("dlq."), subject)


def json_field(data: Column, *names: str) -> Column:
    """The named top-level fields of a JSON text as a struct of strings, in one parse."""
    return F.from_json(data, ", ".join(f"`{n}` string" for n in names))


def decode_payload(data: Column) -> Column:
    """Text of base64 data, or the data itself where it is none."""
    return F.coalesce(F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string")), data)


def parse_metrics_line(line: Column) -> Column:
    """(name, labels, value) of a line of metrics text; null for comments, blanks and lines
    that don't parse."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)"
    pairs = F.regexp_extract_all(F.regexp_extract(line, pattern, 2), F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*="[^"]*")'), F.lit(1))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_extract(p, r'="([^"]*)"$', 1))))
    value = F.regexp_extract(line, pattern, 3).try_cast("double")
    return F.when(
        ~F.coalesce(line, F.lit("")).rlike(r"^\s*(#|$)") & value.isNotNull(),
        F.struct(F.regexp_extract(line, pattern, 1).alias("name"), labels.alias("labels"), value.alias("value")),
    )


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
