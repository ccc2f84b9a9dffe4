"""Small tables with nulls, empty and long texts, ties and repeated rows."""

import json

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, **tables):
    """Parquet tables as the driver names them; returns the folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def docs(spark, texts, ids=None, lang="en", source="s"):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang if isinstance(lang, str) or lang is None else lang[k], source if isinstance(source, str) or source is None else source[k], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def rows(df):
    return [json.loads(x) for x in df.toJSON().collect()]
