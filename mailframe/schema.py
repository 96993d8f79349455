"""The table of parsed mails: one row a message, its parts flattened into an array in the order of the tree."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

TEXT, TEXTS = StringType(), ArrayType(StringType())


def _struct(**fields) -> StructType:
    return StructType([StructField(name.rstrip("_"), kind) for name, kind in fields.items()])


PAIRS = ArrayType(_struct(name=TEXT, value=TEXT))
PART = _struct(
    part_path=ArrayType(IntegerType()), depth=IntegerType(), content_type=TEXT, disposition=TEXT, filename=TEXT, charset=TEXT, encoding=TEXT, boundary=TEXT,
    headers=PAIRS, is_body=BooleanType(), is_attachment=BooleanType(), text=TEXT, size=LongType(), payload=BinaryType(), error=TEXT,
)
MESSAGE = _struct(
    path=TEXT, msg_id=TEXT, subject=TEXT, defect=TEXTS, from_=TEXT, to=TEXTS, cc=TEXTS, delivered_to=TEXTS, date_iso=TEXT, received=TEXTS,
    headers=PAIRS, parts=ArrayType(PART), warnings=TEXTS, error=TEXT,
)
