"""Rows that every text operator must survive."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    # Names that operators use for their own columns.
    T.StructField("id", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("n_words", T.StringType()),
    T.StructField("text_sha256", T.StringType()),
    T.StructField("a.b c", T.StringType()),
])
LONG = "word another thing, Éloge of the longest\ttext in all.\n" * 4000
TEXTS = [
    (1, "the same text twice over here"), (2, "the same text twice over here"),
    (2, "the same text twice over here"), (3, None), (4, ""), (5, " \n\t "), (6, LONG),
    (7, LONG), (None, "no id but a text"), (None, "no id but a text"), (8, "The Same Text"),
    (9, "x"), (10, "Released under the MIT License. mit license, MIT-license"),
    (11, "日本語のテキスト and ▁ some <|endoftext|> more"), (12, "12345 !!!"),
    (13, "a b"), (13, "another text of the same id"), (14, "don't DON'T l'été 'tis"),
]


def messy(spark, rows=TEXTS):
    data = [(i, t, "en" if n % 3 else None, "7", n, "k", "s", "w", "h", "c")
            for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
