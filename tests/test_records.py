"""Quoted line breaks in files that are read in many small splits."""

import random

import pytest
from pyspark.sql import functions as F

from utterfold.sources import files
from utterfold.sources.records import quote_effect, read_lines, splits_of
from utterfold.streaming.corpus import stream_corpus

SETTING = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, "64")
    yield
    spark.conf.set(SETTING, before)


def field(rng, separator):
    kind = rng.random()
    if kind < 0.3:
        inside = "".join(rng.choices(["a", "b c", "\n", '""', separator, "\n\n", "é"], k=rng.randint(0, 9)))
        return f'"{inside}"', inside.replace('""', '"')
    if kind < 0.4:
        return 'six" tall', 'six" tall'
    word = "".join(rng.choices("xyz ", k=rng.randint(1, 30)))
    return word, word


def delimited(seed, separator, n=150):
    rng = random.Random(seed)
    lines, rows = [], []
    for i in range(n):
        fields = [(str(i), str(i)), field(rng, separator), field(rng, separator)]
        lines.append(separator.join(raw for raw, _ in fields))
        rows.append(tuple(value for _, value in fields))
    return "\n".join(lines) + "\n", rows


def rows_of(df):
    return sorted(((int(r[0]), *(x or "" for x in r[1:])) for r in df.collect()))


@pytest.mark.parametrize("seed, kind", [(1, "csv"), (2, "tsv"), (3, "csv"), (4, "tsv")])
def test_splits_give_the_records_that_were_written(spark, tmp_path, small_splits, seed, kind):
    content, rows = delimited(seed, files.SEPARATORS[kind])
    path = str(tmp_path / f"a.{kind}")
    (tmp_path / f"a.{kind}").write_text(content, encoding="utf8", newline="")
    df = files.read_corpus(spark, path, columns=["i", "a", "b"], na_tokens=None)
    assert read_lines(spark.read, path).select("split").distinct().count() > 20
    assert rows_of(df) == sorted((int(i), a, b) for i, a, b in rows)
    assert df.count() == len(rows)


def test_header_of_every_file_and_a_record_over_many_splits(spark, tmp_path, small_splits):
    folder = tmp_path / "in"
    folder.mkdir()
    long = "line\n" * 200
    (folder / "a.csv").write_text(f'"i","a\nb"\n1,"{long}"\n2,x\n', newline="")
    (folder / "b.csv").write_text(f'"i","a\nb"\n\n3,"{long}""{long}"\n', newline="")
    # a header as long as several splits
    df = files.read_corpus(spark, str(folder), "csv", na_tokens=None)
    assert df.columns == ["i", "a\nb"]
    assert rows_of(df) == [(1, long), (2, "x"), (3, f'{long}"{long}')]


def test_carriage_returns(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('i,a\r\n1,"x\r\ny"\r\n2,z\r\n', newline="")
    df = files.read_corpus(spark, str(tmp_path / "a.csv"))
    assert rows_of(df) == [(1, "x\r\ny"), (2, "z")]


@pytest.mark.parametrize("splits", ["64", "134217728"])
@pytest.mark.parametrize("tail", ['c,z\nd,w\n', "c,z\n" * 100])
def test_unclosed_quote_fails_everywhere(spark, tmp_path, splits, tail):
    before = spark.conf.get(SETTING)
    content = f'a,x\nb,"y\n{tail}'
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(content)
    (tmp_path / "s.csv").write_text("id,text\n" + content)
    spark.conf.set(SETTING, splits)
    try:
        with pytest.raises(Exception, match="unclosed quote"):
            files.read_corpus(spark, str(folder), "csv", ["text", "label"]).count()
        with pytest.raises(Exception, match="unclosed quote"):
            files.read_scoring_input(spark, str(tmp_path / "s.csv")).collect()
        with pytest.raises(Exception, match="unclosed quote|larger than"):
            run = (
                stream_corpus(spark, str(folder), ["text", "label"], "csv")
                .writeStream.format("parquet")
                .option("path", str(tmp_path / "out"))
                .option("checkpointLocation", str(tmp_path / "progress"))
                .trigger(availableNow=True)
                .start()
            )
            run.awaitTermination()
    finally:
        spark.conf.set(SETTING, before)


def test_states_of_splits_are_composed_in_order(spark):
    lines = [("f", s, a, x) for s, a, x in [
        (0, 0, 'a,"b'), (0, 1, "c"),          # opens
        (10, 2, "d"),                          # stays inside
        (20, 3, 'e",f'), (20, 4, 'g,"h'),      # closes and opens again
        (30, 5, 'i'), (30, 6, '","j'),         # a line that closes and opens
        (40, 7, 'k"'),                         # closes
        (50, 8, 'l,m"n'),                      # a stray quote does nothing outside
    ]]
    df = spark.createDataFrame(lines, "file string, split long, at long, line string")
    got = {r["split"]: (r["begins"], r["ends"], r["closed"], r["opened"])
           for r in splits_of(df.repartition(3), ",").collect()}
    assert got == {
        0: (0, 1, None, 0), 10: (1, 1, None, None), 20: (1, 1, 3, 4),
        30: (1, 1, None, None), 40: (1, 0, 7, None), 50: (0, 0, None, None),
    }


@pytest.mark.parametrize("line, out, inside", [
    ("plain", 0, 1), ('a,"b', 1, 0), ('"a""', 1, 0), ('"a"', 0, 0), ('"a"x,"b', 1, 1),
    ('x"y', 0, 0), ('x",y', 0, 0), ('","', 0, 1), ('""', 0, 1), ('"",""', 0, 1), ('a,""",b', 1, 0),
])
def test_effect_of_a_line(spark, line, out, inside):
    code = spark.range(1).select(quote_effect(F.lit(line), ",").alias("c")).first()["c"]
    assert (code & 1, code >> 1 & 1) == (out, inside)


def test_long_quoted_lines_need_no_deep_stack(spark):
    line = F.concat(F.lit('"'), F.repeat(F.lit('a""'), 200_000), F.lit('",'), F.repeat(F.lit('"b",'), 200_000))
    assert spark.range(1).select(quote_effect(line, ",").alias("c")).first()["c"] == 0
