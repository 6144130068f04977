"""CSV records that fail to parse: separated from the loadable ones, with the reason.

Records are read permissively under an explicit schema that keeps the raw text of whatever does not fit.  The parser
is lenient about quotes, so the records it flags and all records with a quote are classified again by structure:
split at quotes, the pieces outside a quoted field must start and end at a comma.  That needs one linear pass in the
JVM, no backtracking pattern, so very long records are safe.

Reasons, the first that applies: ``quoting`` (a NULL record counts here too), ``column_count``, ``bad_id``,
``bad_price``.  Values are not trimmed.  Repeated records all come out.  An empty record has one field.  Columns
``parsed`` and ``reason`` that come along are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoskein.functions.typed import CURRENCY, INTEGER, matches


RECORD = T.StructType(
    [
        T.StructField(name, T.LongType() if name == "id" else T.StringType())
        for name in (
            "id", "last_scraped", "name", "neighbourhood_cleansed", "room_type",
            "latitude", "longitude", "price", "minimum_nights", "number_of_reviews",
        )
    ]
)
CORRUPT = "_corrupt"
OPTIONS = {
    "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1",
}


def well_formed(raw: Column) -> Column:
    """Whether quoted fields are enclosed whole with quotes inside doubled and unquoted fields hold no quote."""
    pieces = F.split(raw, '"', -1)
    last = F.size(pieces) - 1

    def outside(piece: Column, i: Column) -> Column:
        starts = (i == 0) | (piece == "") | piece.startswith(",")
        ends = (i == last) | (piece == "") | piece.endswith(",")
        # an empty piece between two quotes is a doubled quote, at the ends of the record it is nothing
        return starts & ends

    return (last % 2 == 0) & F.forall(F.transform(pieces, lambda p, i: (i % 2 == 1) | outside(p, i)), lambda ok: ok)


def field_count(raw: Column) -> Column:
    """Fields of a well-formed record: commas outside of quotes, and one."""
    pieces = F.split(raw, '"', -1)
    commas = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))).otherwise(0))
    return F.aggregate(commas, F.lit(1), lambda acc, n: acc + n)


def classified(lines: DataFrame, raw: str = "raw_line", schema: T.StructType = RECORD) -> DataFrame:
    """``lines`` with ``parsed`` (a struct of ``schema`` and the corrupt text) and ``reason``, NULL where the record loads."""
    keeping = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    text = F.col(raw)
    parsed = F.from_csv(text, keeping.simpleString()[7:-1].replace(":", " "), OPTIONS)
    read = lines.withColumn("parsed", parsed)
    first = field_text(text, 1)
    price = field_text(text, [f.name for f in schema.fields].index("price") + 1)
    suspect = F.col(f"parsed.{CORRUPT}").isNotNull() | text.contains('"')
    broken = text.isNull() | (suspect & ~well_formed(text))
    bad_id = ~(matches(F.coalesce(first, F.lit("")), INTEGER) & F.col("parsed.id").isNotNull())
    bad_price = (F.coalesce(price, F.lit("")) != "") & ~matches(price, CURRENCY)
    reason = (
        F.when(broken, "quoting")
        .when(field_count(text) != len(schema.fields), "column_count")
        .when(bad_id, "bad_id")
        .when(bad_price, "bad_price")
    )
    return read.withColumn("reason", reason)


def field_text(raw: Column, number: int) -> Column:
    """The text of the field (from 1) of a well-formed record, quotes taken off; NULL if there is none.

    Commas inside quotes are first put out of reach by a control character that a record cannot hold in its shape.
    """
    pieces = F.split(raw, '"', -1)
    shielded = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(","), F.lit("\x00"))).otherwise(p)), '"')
    field = F.replace(F.get(F.split(shielded, ",", -1), F.lit(number - 1)), F.lit("\x00"), F.lit(","))
    quoted = field.startswith('"') & field.endswith('"') & (F.length(field) >= 2)
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def failed_records(lines: DataFrame) -> DataFrame:
    return classified(lines).where("reason is not null")


def loaded_records(lines: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """The valid rows, typed by the schema, with the columns that came along with the line (a field of the record takes precedence)."""
    kept = [c for c in lines.columns if c != "raw_line" and c not in schema.names]
    return classified(lines, schema=schema).where("reason is null").select(*kept, *[F.col(f"parsed.{f.name}").alias(f.name) for f in schema.fields])
