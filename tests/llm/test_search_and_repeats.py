"""Operators 11 to 13 against brute force on small tables with every odd row."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from kinloom.llm import ball_search, collocations, queries, suffix_dedup
from kinloom.llm.rolling import Roller, sliding_min
from kinloom.shared import scratch

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score long, t1 long, spans string, q int"


def table(spark, texts, langs=("en",)):
    rows = [(i if i % 11 else 5, t, langs[i % len(langs)], None, 0, 1, 2, "x", 3) for i, t in enumerate(texts)]
    rows.append((None, texts[0], None, None, 0, 1, 2, "x", 3))
    return spark.createDataFrame(rows, CLASHING).repartition(3), [(r[0], r[1], r[2]) for r in rows]


# --- 11: repeated byte strings


def plain_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts(rng):
    words = ["".join(rng.choice("abcdé漢😀 ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(300) for _ in range(4)]
    texts = [line(rng.randint(1, 200)) for _ in range(20)] + [None, "", "x" * 399, "x" * 400, "y" * 900, "ab" * 700, "\n", " "]
    for _ in range(40):
        t = rng.choice(base)
        a = rng.randint(0, len(t))
        texts.append(line(rng.randint(0, 40)) + t[a : rng.randint(a, len(t))] + line(rng.randint(0, 60)))
    return texts + [base[0]] * 5 + [base[1] + base[1]]


@pytest.mark.parametrize(("length", "q", "seed"), [(400, 100, 1), (50, 12, 2), (31, 31, 3), (9, 2, 4)])
def test_repeated_bytes(spark, length, q, seed):
    df, rows = table(spark, repeating_texts(random.Random(seed)))
    got = suffix_dedup.dedup_bytes(df, length=length, q=q).collect()
    digest = [(r["id"] if r["id"] is not None else -1, r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got]
    want = [(r[0] if r[0] is not None else -1, *w) for r, w in zip(rows, plain_removed([r[1] for r in rows], length))]
    assert sorted(digest) == sorted(want)


def test_long_texts_are_cut_into_blocks_without_loss(spark, monkeypatch):
    rng = random.Random(5)
    piece = "".join(rng.choice("abcdef") for _ in range(700))
    long = lambda n: "".join(rng.choice("ghijkl") for _ in range(n))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 9)  # in this process; workers keep theirs, so places are made here
    data = (long(300) + piece + long(900) + piece + long(20)).encode()
    found = list(suffix_dedup.places(np.frombuffer(data, np.uint8), np.array([0, len(data)]), Roller(11), 400, 100))
    windows = sorted(w for place, _, lo, hi in found for p, a, b in zip(place, lo, hi) for w in range(p - b, p - a + 1))
    assert windows == list(range(len(data) - 400 + 1))
    monkeypatch.undo()
    texts = [long(1 << 18) + piece + long(1 << 18), long(100) + piece]
    df, rows = table(spark, texts)
    got = {(r["id"], r["n_bytes"]): r["spans"] for r in suffix_dedup.dedup_bytes(df.where("doc_id IS NOT NULL")).collect()}
    assert [(s["begin"], s["end"]) for s in got[(5, len(texts[0]))]] == [(1 << 18, (1 << 18) + 700)]
    assert [(s["begin"], s["end"]) for s in got[(1, 800)]] == [(100, 800)]


def test_equal_windows_point_to_the_same_place():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 3, 400, dtype=np.uint8)
    data = np.concatenate([one, rng.integers(0, 3, 100, dtype=np.uint8), one])
    shift = {}
    for place, key, lo, hi in suffix_dedup.places(data, np.array([0, len(data)]), Roller(11), 400, 20):
        for p, k, a, b in zip(place, key, lo, hi):
            shift.update({p - d: (d, k) for d in range(a, b + 1)})
    assert shift[0] == shift[500]
    assert sliding_min(np.array([3, 1, 2, 5, 4, 6]), 3).tolist() == [1, 1, 2, 4]


def test_no_texts_no_spans(spark):
    empty = spark.createDataFrame([], CLASHING)
    assert suffix_dedup.dedup_bytes(empty).count() == 0
    with pytest.raises(ValueError, match="longer"):
        suffix_dedup.repeated_spans(empty, length=5, q=6)


def test_cells_of_a_common_passage_are_split_among_tasks(spark, monkeypatch):
    low = {"skewJoin.skewedPartitionThresholdInBytes": "1k", "skewJoin.skewedPartitionFactor": "2", "advisoryPartitionSizeInBytes": "1k"}
    plans = []

    def noted(df, *args, **kwargs):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(suffix_dedup, "written", noted)
    for k, v in low.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        one = "if(id < 3000, 0, id)"
        cells = spark.range(0, 4000, 1, 8).selectExpr("id AS t1", "0 AS t2", "id AS pos", "0 AS lo", "9 AS hi", f"{one} AS key", f"{one} AS u")
        assert noted(suffix_dedup._shared(cells, ["key"])).where("key = 0").count() == 3000
        repeated, rest = suffix_dedup._classes(cells)
        assert (repeated.count(), rest.count(), rest.where("key = 0").count()) == (3000, 1001, 1)
    finally:
        for k in low:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert len(joins) == 2
    assert all("skew=true" in p for p in joins)


# --- 12: ranked search


def plain_search(docs, items, top):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, collections.Counter(cut(t))) for i, t, *_ in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        scored.sort()
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(scored[:top])]
    return out


def searched(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Straße", "É", "漢字", "ABC", "abc"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(n))
    texts = [text(rng.randint(0, 60)) for _ in range(150)] + [None, "", "...", "ABC abc Abc"] + [text(9)] * 30 + [text(5000)]
    items = [("a", text(8)), ("b", text(30)), ("a", "abc"), (None, "w1 w2"), ("none", None), ("void", "?!"), ("new", "unseen"), ("one", "É")]
    return table(spark, texts), items


@pytest.mark.parametrize("block", [1, 3, 512])
def test_search_finds_what_scoring_all_finds(spark, block):
    (df, rows), items = searched(spark)
    found = ball_search.ranked_search(df, spark.createDataFrame(items, "item_id string, text string"), top=7, block_items=block)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_search(rows, items, 7), key=key)


def random_tree(rng, docs=300, vocabulary=40, leaf=8):
    centres = rng.integers(0, 10**9, (6, vocabulary)) * (rng.random((6, vocabulary)) < 0.2)
    dense = centres[rng.integers(0, 6, docs)] + (rng.random((docs, vocabulary)) < 0.05) * rng.integers(0, 10**7, (docs, vocabulary))
    dense[5:40] = dense[5]  # copies
    starts = np.concatenate([[0], np.cumsum((dense > 0).sum(1))])
    return dense, ball_search.Tree(starts, np.nonzero(dense)[1], dense[dense > 0], leaf)


def test_no_document_scores_above_the_bound_of_its_balls():
    rng = np.random.default_rng(7)
    dense, tree = random_tree(rng)
    assert sorted(np.concatenate([d for d, *_, below in tree.nodes if below is None])) == list(range(300))
    items = (rng.random((40, 25)) < 0.2).astype(np.int8)
    reach = np.sqrt(items.sum(0))
    for docs, cols, centre, radius, _ in tree.nodes:
        assert ((dense[docs] @ items).max(0) <= centre @ items[cols] + reach * radius).all()


def test_subtrees_below_the_floor_go_unseen():
    rng = np.random.default_rng(8)
    dense, tree = random_tree(rng)
    items = (rng.random((40, 1)) < 0.3).astype(np.int8)
    exact = np.sort((dense @ items)[:, 0])[::-1]
    best = ball_search._Best(1, 10)
    seen = ball_search.search(tree, items, best.floor, lambda d, o, s: best.take(d, np.zeros(len(d), bool), o, s))
    assert best.score[0].tolist() == exact[:10].tolist()
    assert seen < sum(n[4] is None for n in tree.nodes)


def test_large_sums_stay_exact():
    y = np.array([2**53 + 1, 2, 2**53 + 3], np.int64)
    tree = ball_search.Tree(np.array([0, 2, 3]), np.array([0, 1, 0]), y)
    assert tree.scores(np.array([0, 1]), np.array([0, 1]), np.array([[1], [1]], np.int8))[:, 0].tolist() == [2**53 + 3, 2**53 + 3]


def test_search_of_nothing(spark):
    (df, _), items = searched(spark)
    items = spark.createDataFrame(items, "item_id string, text string")
    assert ball_search.ranked_search(df.limit(0), items).count() == 0
    assert ball_search.ranked_search(df, items.limit(0)).count() == 0


# --- 13: collocations


def plain_phrases(rows, least, longest, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = collections.defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(a, inside[p[i : i + k]])
        rows = []
        for p, a in found.items():
            if 100 * inside[p] < 50 * a:
                s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrased(spark):
    rng = random.Random(9)
    words = ["the", "of", "Stone", "river", "É", "漢", "x" * 30, "😀", "a'b", "und"]
    text = lambda n: "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ", "\x1f "]) for _ in range(n))
    texts = [text(rng.randint(0, 80)) for _ in range(80)] + [None, "", " \t.\n", "stone", "river of the stone " * 400] + ["new york city"] * 12 + [f"rare{i} pair" for i in range(40)]
    return table(spark, texts, ("en", "de", None))


@pytest.mark.parametrize(("shards", "least", "longest"), [(1, 10, 3), (3, 10, 3), (5, 3, 3), (2, 4, 2), (4, 5, 4)])
def test_collocations(spark, shards, least, longest):
    df, rows = phrased(spark)
    got = collocations.collocations(df, least=least, longest=longest, top=150, shards=shards)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, longest, 150)


def test_longer_phrases_begin_before_shorter_ones_end(spark):
    df, _ = table(spark, ["the river of stone"] * 200, ("und",))
    with scratch(spark):
        found, steps = collocations.counted(df, shards=5)
        assert {(r["phrase"], r["a"]) for r in found[3].collect()} == {("the river of", 201), ("river of stone", 201)}
    assert steps == 7  # level by level it would be fifteen scans


def test_filters_miss_nothing_and_crowded_ones_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(10)
    h = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    bits = np.zeros(1 << 13, np.uint8)
    at = collocations.Filter.places(h, 8 * len(bits)).astype(np.int64)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    assert collocations.Filter(bits).has(h).all()
    assert not collocations.Filter(bits).has(rng.integers(0, 1 << 64, 5000, dtype=np.uint64)).all()
    df, rows = phrased(spark)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 4)  # filters that let nearly all phrases pass
    monkeypatch.setattr(collocations, "BITS_EACH", 0)
    got = collocations.collocations(df, top=150)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 10, 3, 150)


def test_counters_of_longer_phrases_have_no_text_and_go_when_their_circle_is_over(spark, monkeypatch):
    from pyspark.sql import functions as F

    df, rows = phrased(spark)
    write, left = collocations.write, []

    def watched(written, path, by=()):
        write(written, path, by)
        if "counters" in path:
            found = spark.read.parquet(path).withColumn("k", F.expr("meta % 32")).where("k > 1")
            assert "phrase" not in found.columns or found.where("phrase IS NOT NULL").count() == 0
            left.append(dict(found.where("a < 10").groupBy("k").count().collect()))

    monkeypatch.setattr(collocations, "write", watched)
    assert sorted(map(tuple, collocations.collocations(df, top=150).collect())) == plain_phrases(rows, 10, 3, 150)
    assert any(3 in x for x in left) and not left[-1]


def test_words_of_one_hash_are_counted_with_another(spark, monkeypatch):
    df, rows = phrased(spark)
    monkeypatch.setattr(collocations, "HASHES", ((13, 4), (17, 64)))
    assert sorted(map(tuple, collocations.collocations(df, top=150).collect())) == plain_phrases(rows, 10, 3, 150)
    monkeypatch.setattr(collocations, "HASHES", ((13, 4),))
    with pytest.raises(ValueError, match="one hash"):
        collocations.collocations(df, top=150)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    import pyarrow as pa

    text = b"\n".join(b"word%d of a piece" % i for i in range(40)) + b"\n" + b"y" * 200
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text, b"short"])], ["lang", "text"])
    parts = [(lang, t) for langs, texts in collocations._chunks([batch]) for lang, t in zip(langs, texts)]
    assert b"".join(t for lang, t in parts if lang == "en").split() == text.split()
    assert all(t.endswith(b"\n") for _, t in parts) and max(len(t) for _, t in parts) <= 202


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**12, 10**12 + 1, 10**12 + 7), (3, 7, 5)], "a long, l long, r long")
    got = [r[0] for r in df.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * 10**24 // ((10**12 + 1) * (10**12 + 7)), 10**6 * 9 // 35]


def test_no_documents_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], CLASHING)).count() == 0


def test_queries_have_the_columns_of_their_contracts(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_suffix_buckets(spark, sf).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
