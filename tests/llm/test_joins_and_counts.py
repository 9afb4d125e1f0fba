"""N-gram join, collocations and the filter audit against brute force, and at their edges."""

import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from utterfold.llm import collocations, filter_audit, ngram_join
from utterfold.llm.skew import hot_keys, salted_join

LONG = " ".join(f"w{i}" for i in range(40_000))
CLASHING = ["class", "n", "size", "at", "lang_", "part", "mask", "shingle", "key", "copies", "bucket",
            "bits", "_c1", "possible", "digest", "pos", "a", "b", "rank"]


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, size):
    words = words_of(text)
    size = min(size, len(words))
    return frozenset(
        tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size
    )


def brute_components(rows, size=4, percent=85):
    """``(id, set size, component)`` per row, all pairs compared."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            members[find(i)].append(rows[i][0])
    out = []
    for i, (doc_id, _) in enumerate(rows):
        if not sets[i]:
            out.append((doc_id, 0, doc_id))
        else:
            ids = [x for x in members[find(i)] if x is not None]
            out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def joined(df, **options):
    found = ngram_join.similar_documents(df, **options)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr)


def near_copies(seed):
    """Families with edits of all strengths, chains, shared passages and common words."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)] + ["the", "of", "and"] * 40
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for family in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 20, 80, 200]))
        if family % 3 == 0:
            base = base + passage
        rows.append(base)
        for _ in range(rng.randint(0, 9)):
            copy = list(rng.choice(rows[-3:]))
            for _ in range(rng.randint(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < len(rows) - 30
    assert joined(df) == want
    if seed == 1:
        assert joined(df, words=2, percent=60) == brute_components(rows, 2, 60)


def test_join_of_a_large_group_where_few_are_linked(spark):
    """All share most shingles with a base, and only some with each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"own{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_components(rows)
    assert 1 < len({c for _, _, c in want}) < 150
    assert joined(df) == want


def test_join_edges(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [
        (1, ""), (2, None), (3, ten), (4, ten.upper()), (4, ten), (None, ten), (None, "alone here"),
        (5, "a b"), (6, "A\tb"), (7, LONG), (8, LONG + " end"), (9, " \n "), (10, "ß é ten"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(with_clashes(df)) == brute_components(rows)
    assert joined(df.limit(0)) == []
    links, members = ngram_join.joined_sets(df)
    assert links.columns == ["a", "b", "overlap"] and links.count() == 1
    assert members.where("set_id IS NULL").count() == 3


def test_salted_join_deals_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, 3000, ["k"])
    assert [(r["k"], r["copies"]) for r in hot.collect()] == [(7, 334)]
    lookup = counts.where("k < 1500")
    inner = salted_join(rows, lookup, ["k"], F.col("id"))
    assert inner.count() == 1500 and inner.where("k = 7 AND n = 1000").count() == 1000
    left = salted_join(rows, lookup, ["k"], F.col("id"), "left", hot)
    assert left.count() == 3000 and left.where("n IS NULL").count() == 1500


def brute_collocations(rows, least, longest, listed):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        held = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        scored = []
        for p, a in candidates.items():
            if held[p] >= a:
                continue
            cuts = []
            for k in range(1, len(p)):
                left, right = counts[p[:k]], counts[p[k:]]
                cuts.append((Fraction(1000 * a * n[lang], left * right).__floor__(), k, left, right))
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:listed], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(df, **options):
    found = collocations.collocations(df, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        words = []
        for _ in range(rng.randint(0, 120)):
            words.append(rng.choice(["a", "b", "c d", "New York City", "é ü", "x, y", "p.", "q\tr", "\n", "#1",
                                     "in spite of all that", "  "]))
        rows.append((" ".join(words), rng.choice(["en", "fr", None, ""])))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    for least, listed in ((8, 2000), (20, 7)):
        want = brute_collocations(rows, least, 5, listed)
        assert len(want) > 20
        assert mined(df, least=least, listed=listed) == want
    assert mined(df, least=8, longest=3) == brute_collocations(rows, 8, 3, 2000)


def test_collocations_edges(spark, monkeypatch):
    rows = [(None, "en"), ("", None), ("one", "en"), ("\x01 a\x02 b " * 30, "en"),
            (" ".join(["so so"] * 40_000), "en"), ("x y. " * 9, None), ("x y. " * 9, None)]
    schema = "text string, lang string"
    df = spark.createDataFrame(rows, schema)
    want = brute_collocations(rows, 10, 5, 2000)
    assert want and mined(with_clashes(df), least=10) == want
    assert mined(df.limit(0)) == []
    assert mined(spark.createDataFrame([(None, None), (".,;", "en")], schema), least=1) == []
    # words and pieces across the stretches in which a long text is coded
    monkeypatch.setattr(collocations.WordCoder, "PIECE", 50)
    coder = collocations.WordCoder()
    texts = ["ab cd. ef" * 30, "gh " * 40, "., " * 40, "x" * 200 + " y"]
    row = collocations._block(coder, "en", texts)
    whole = collocations._block(_whole_coder(), "en", texts)
    assert row[1] == whole[1] and row[2] == whole[2]


def _whole_coder():
    coder = collocations.WordCoder()
    coder.PIECE = 1 << 20
    return coder


def test_scores_past_64_bits_are_exact(spark):
    big = 10**13 + 7
    row = spark.createDataFrame([(big, big + 9, [big], [big + 2])],
                                "a long, n long, lefts array<long>, rights array<long>")
    got = row.select(collocations._best_cut().alias("c")).first()["c"]
    assert got["score"] == 1000 * big * (big + 9) // (big * (big + 2))


def brute_audit(rows, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    judged = []
    for doc_id, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = ""
        failed += "A" if len(words) < 50 else ""
        failed += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else ""
        failed += "D" if re.search("[#$%&*|]", t) else ""
        failed += "E" if doc_id is not None and doc_id > least[t] else ""
        judged.append((source or "", failed, doc_id in good, doc_id in toxic))
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in judged}:
            mine = [j[1:] for j in judged if j[0] == part]
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                reached = [j for j in mine if not before & set(j[0])]
                removed = [j for j in reached if letter in j[0]]
                out[part, order, step] = [
                    len(reached) - len(removed), len(removed),
                    sum(letter in j[0] and bool(before & set(j[0])) for j in mine),
                    sum(j[0] == letter for j in mine),
                    sum(j[1] for j in removed), sum(j[2] for j in removed),
                ]
    for (part, order, step), values in out.items():
        letter = order[step - 1]
        values.append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == letter))
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    found = filter_audit.audit(docs, labels).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        kind = rng.random()
        if kind < 0.3 and rows:
            text = rng.choice(rows)[1]
        else:
            pool = ["aa", "Bb", "cc", "$", "é"] if kind < 0.6 else [f"w{j}" for j in range(400)] + ["X"]
            text = " ".join(rng.choices(pool, k=rng.choice([0, 5, 49, 50, 51, 120])))
        rows.append((i // 2 if i % 40 == 0 else i, text, rng.choice(["s1", "s2", None, ""])))
    rows += [(None, rows[0][1], "s1"), (None, None, None), (1000, LONG, "s1"), (1001, LONG, "s1"),
             (7, rows[7][1], "s1"), (7, rows[7][1], "s1")]
    labels = [(i, i % 3, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    assert audited(with_clashes(docs), known) == want
    # a sketch of one bucket for each size, and one that clears nothing
    monkeypatch.setattr(filter_audit, "sketch_size", lambda n: 8)
    assert audited(docs, known) == want
    assert audited(docs.limit(0), known) == {}
    assert set(audited(docs, known.limit(0))) == set(want)


def test_sketch_clears_only_single_texts(spark):
    rows = [(f"text {i}",) for i in range(2000)] + [(f"text {i}",) for i in range(0, 2000, 10)]
    texts = spark.createDataFrame(rows, "text string").repartition(8)
    cells = filter_audit.sketch_size(len(rows))
    sketch = filter_audit.repeat_sketch(texts, cells)
    found = filter_audit.with_possible_repeats(texts, sketch, cells)
    possible = Counter(r["text"] for r in found.where("possible").select("text").collect())
    assert {f"text {i}" for i in range(0, 2000, 10)} <= set(possible)
    assert len(possible) < 400
    assert filter_audit.sketch_size(0) == 1 << 15
    assert filter_audit.sketch_size(10**12) == filter_audit.MAX_CELLS
