"""Texts that every operator must take: nulls, empty, long, tied and repeated rows, clashing extra columns."""

from pathlib import Path

import duckdb

LINE = "the quick brown fox jumps over the lazy dog and runs away from it all"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two three four"), (6, LINE), (7, LINE), (7, LINE), (None, LINE), (None, None),
    (8, (LINE + "\n") * 40), (9, " ".join(f"w{i}" for i in range(30_000))), (10, "été ÉTÉ naïve 中文 words " * 5), (11, "x " * 3000), (12, "a  b\n\n c\t\t<|endoftext|> d "),
    (13, "Under the MIT License. under THE mit-license; apache license, version 2.0 CC BY-NC"), (14, "#*$%&|<> !!! " * 9), (15, LINE.upper()),
]


def frame(spark, rows, extra=True):
    """Rows of documents with extra columns, some with names that operators use themselves."""
    docs = spark.createDataFrame([(i, t, "en", None if i == 6 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "n_words", "kept", "size", "copies", "template", "id", "rank"):
            docs = docs.selectExpr("*", f"'clash' as {name}")
    return docs


def documents(sf):
    return duckdb.sql(f"select doc_id, text, source from read_parquet('{sf}/documents.parquet')").fetchall()


def same_as_sql(spark, name, sf):
    """The query's rows equal its SQL's, whatever their order."""
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    got = entry.queries()[name](spark, sf)
    sql = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert key(map(tuple, got.select(*names).collect())) == key(sql.fetchall())
