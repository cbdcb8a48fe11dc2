"""The triple schema and the column expressions every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
ANALYTICS = "urn:semgraph:analytics#"

RDF_TYPE = RDF + "type"
RDFS_LABEL = RDFS + "label"
RDFS_COMMENT = RDFS + "comment"
OWL_NOTHING = OWL + "Nothing"
IN_COMMUNITY = ANALYTICS + "inCommunity"
IN_COHORT = ANALYTICS + "inCohort"

IRI, BNODE, LITERAL = "iri", "bnode", "literal"

TRIPLE_SCHEMA = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("inferred", T.BooleanType()),
        T.StructField("source_table", T.StringType()),
    ]
)
TRIPLE_COLUMNS = TRIPLE_SCHEMA.fieldNames()

# Fixed value: text that counts as a number when literals are compared.
NUMBER_PATTERN = r"^-?[0-9]+(\.[0-9]+)?$"


def xsd_for(dtype: T.DataType) -> str | None:
    """XSD datatype a Spark column type maps to; None is a plain string literal."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return XSD + "integer"
    if isinstance(dtype, T.DecimalType):
        return XSD + "decimal"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return XSD + "double"
    if isinstance(dtype, T.BooleanType):
        return XSD + "boolean"
    if isinstance(dtype, T.DateType):
        return XSD + "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return XSD + "dateTime"
    if isinstance(dtype, T.BinaryType):
        return XSD + "hexBinary"
    return None


def lexical(col: Column, dtype: T.DataType, *, iso: bool = False) -> Column:
    """Text form of a column value. ``iso`` writes timestamps with a ``T`` separator."""
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError("nested columns have no single text form: select a leaf column")
    text = col.cast("string")
    if iso and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.replace(text, F.lit(" "), F.lit("T"))
    return text


def iri_encode(col: Column) -> Column:
    """Percent-encode everything outside ``A-Za-z0-9._~-`` (UTF-8 bytes, upper-case hex)."""
    encoded = F.url_encode(col)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def iri_decode(col: Column) -> Column:
    return F.url_decode(F.replace(col, F.lit("+"), F.lit("%2B")))


def needs_encoding(dtype: T.DataType) -> bool:
    """Integers, dates and booleans print only unreserved characters."""
    return not isinstance(
        dtype,
        (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType, T.DecimalType),
    )


def iri_local_name(iri: str) -> str:
    return iri.rstrip("/").replace("#", "/").rsplit("/", 1)[-1]


def local_name(col: Column) -> Column:
    return F.regexp_extract(F.rtrim(col, F.lit("/")), "[^#/]+$", 0)


def fallback_label(iri: Column) -> Column:
    """``.../Employee/42`` gives ``Employee/42``; ``...#Thing`` gives ``Thing``."""
    after_hash = F.substring_index(iri, "#", -1)
    parts = F.filter(F.split(F.rtrim(iri, F.lit("/")), "/"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    before = F.try_element_at(parts, F.lit(-2))
    two = before.isNotNull() & ~before.startswith("http:") & ~before.startswith("https:")
    by_path = F.when(two, F.concat_ws("/", before, last)).otherwise(F.coalesce(last, iri))
    return F.when(F.contains(iri, F.lit("#")), F.when(after_hash == "", iri).otherwise(after_hash)).otherwise(by_path)


def number(text: Column) -> Column:
    """Numeric value of a literal, NULL unless the text is plainly a number."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def extracted_number(text: Column) -> Column:
    """Numeric value after dropping everything but digits, dot, exponent and minus."""
    return F.nullif(F.regexp_replace(text, "[^0-9.eE-]", ""), F.lit("")).try_cast("double")


def is_bnode(col: Column) -> Column:
    return col.startswith("_:")


def text_literal(value: str) -> str:
    """A Spark SQL string literal holding ``value``."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    """A backtick-quoted column name, so dots and spaces in it stay part of the name."""
    return "`" + name.replace("`", "``") + "`"
