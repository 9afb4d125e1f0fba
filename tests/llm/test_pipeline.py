"""Every stage of the pipeline against a plain version, on the smallest tables and a fixture."""

import hashlib
import itertools
import re

import numpy as np
import pytest
import corpus_pipeline
from utterfold.llm import toxicity
from utterfold.llm.queries import tokenizer_description

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size)


def plain_lines(texts):
    """What is left of each text when later runs of lines go; emptied texts are left out."""
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    first, gone = {}, {i: set() for i in lines}
    for i in sorted(lines):
        for size in (1, 2, 3):
            for at in range(len(lines[i]) - size + 1):
                run = tuple(lines[i][at : at + size])
                if size < 3 and sum(len(re.findall(r"\S+", x)) for x in run) <= 50:
                    continue
                if first.setdefault((size, run), (i, at)) != (i, at):
                    gone[i].update(range(at, at + size))
    out = {}
    for i, t in texts.items():
        left = "\n".join(x for at, x in enumerate(lines[i]) if at not in gone[i])
        if not gone[i]:
            out[i] = t
        elif left or not t:
            out[i] = left
    return out


def plain_near(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: t for i, t in texts.items() if find(i) == i}


def plain_leaks(texts, items):
    def words(text):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    windows = set()
    for item in items:
        found = words(item)
        size = min(10, len(found))
        windows |= {tuple(found[i : i + size]) for i in range(len(found) - size + 1) if size}
    sizes = {len(w) for w in windows}

    def clean(text):
        found = words(text)
        return not any(
            tuple(found[i : i + n]) in windows for n in sizes for i in range(len(found) - n + 1)
        )

    return {i: t for i, t in texts.items() if clean(t)}


def test_each_stage_on_the_smallest_tables(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    model = toxicity.fit_toxicity(
        docs, labels.where(~toxicity.held_out("doc_id")).select("doc_id", "toxic")
    )
    kept = STAGES["toxicity"](spark, docs, FOLDER)
    before, after = rows_of(docs), rows_of(kept)
    sure = {i: model.score(t or "") for i, t in before.items()}
    assert {i for i in before if sure[i] < 0.499} <= set(after)
    assert not {i for i in before if sure[i] > 0.501} & set(after)

    cut = STAGES["line_dedup"](spark, kept, FOLDER)
    assert cut.dtypes == docs.dtypes
    assert rows_of(cut) == plain_lines(after)

    near = STAGES["minhash"](spark, cut, FOLDER)
    assert rows_of(near) == plain_near(rows_of(cut))

    clean = STAGES["decontamination"](spark, near, FOLDER)
    assert rows_of(clean) == plain_leaks(rows_of(near), benchmark)

    tokenizer = Tokenizer.from_str(tokenizer_description())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    texts = rows_of(clean)
    for row in STAGES["bpe"](spark, clean, FOLDER).collect():
        ids = tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Nulls, empty texts, repeated rows, chains of near copies, emptied copies."""
    folder = str(tmp_path_factory.mktemp("tables"))
    base = [f"word{i}" for i in range(120)]
    passage = " ".join(f"shared{i}" for i in range(60))
    item = "the quick brown fox jumps over the lazy dog again today"
    texts = [None, "", "", "a\nb\nc\nd", "a\nb\nc\nd", "x\na\nb\nc", passage, passage + " tail",
             f"start\n{passage}\nend", "x " + item.upper() + "!", item[:20]]
    chain = list(base)
    for i in range(6):
        chain[10 * i] = f"new{i}"
        texts.append(" ".join(chain))
    rows = [(i, t, "en", None if i % 2 else "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(len(rows))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return folder


def test_odd_rows(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    texts = rows_of(docs)
    cut = STAGES["line_dedup"](spark, docs, odd_tables)
    assert rows_of(cut) == plain_lines(texts)
    assert 4 not in rows_of(cut) and {0, 1, 2} <= set(rows_of(cut))
    near = STAGES["minhash"](spark, docs, odd_tables)
    assert rows_of(near) == plain_near(texts)
    clean = STAGES["decontamination"](spark, docs, odd_tables)
    assert rows_of(clean) == plain_leaks(texts, ["the quick brown fox jumps over the lazy dog again today"])
    assert corpus_pipeline.run(spark, odd_tables).count() > 5


def test_empty_tables(spark, odd_tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{odd_tables}/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_emptied_copies_go_and_empty_texts_stay(spark):
    from utterfold.llm import line_dedup

    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, ""), (4, None), (5, "a\nb\nc\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(line_dedup.with_lines_cut(df)) == {1: "a\nb\nc", 2: "", 3: "", 4: None, 5: "d"}
    assert set(rows_of(line_dedup.with_lines_cut(df, drop_emptied=True))) == {1, 3, 4, 5}
