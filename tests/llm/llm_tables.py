"""Folder, schema and helpers shared by the tests of the training-data operators."""

import public_tokenizers
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " hash string, print string, score string, predicted string, component_id string, kept string, y string"
)


def tokenizer(name):
    return public_tokenizers.path(name)


def of(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*[F.col(c) for c in columns]) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
