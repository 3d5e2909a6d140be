"""Each operator against a plain version of itself on a small table with every odd row."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.llm import bpe, common, fingerprint, line_dedup, mixing, quality_gam, quality_rules, sharding, simhash, toxicity, warc
from kinloom.llm.queries import tokenizer
from kinloom.shared import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long"
WORDS = "the of and stone river cloud bright under over walks sings slow green paper light house winter song".split()


def make_rows():
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + "."
    passage = [line(12) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [line(rng.randint(3, 14)) for _ in range(rng.randint(1, 9))]
        if i % 6 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage
        rows.append((i, "\n".join(lines), "en", f"s{i % 5}" if i % 3 else "s0"))
    rows += [(100 + i, rows[0][1], "en", "s0") for i in range(25)]  # copies
    base = rows[5][1].split(" ")
    rows += [(200 + i, " ".join([*base[:-1], base[-1] + "x" * i]), "en", "s1") for i in range(12)]  # near copies
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t ", "en", None), (303, "one", "en", "s2"), (304, "one two", "en", "s2"), (None, "no id at all here", "en", "s3")]
    rows += [(305, "a a a a a a a a\n" * 6, "en", "s4"), (305, "a a a a a a a a\n" * 6, "en", "s4"), (306, "é漢😀 " * 40, "fr", "ß"), (307, " ".join(WORDS * 400), "en", "s0")]
    rows += [(308, "x\ny\nz\nx\ny\nz\nx\ny\nz\n\nq", "en", "s2"), (309, "Home | About | Contact\n" + "bright stone under winter cloud sings. " * 20, "en", "s2")]
    return [(*r, len(r[1] or ""), 0.5, 7) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, rows, empty):
    got = fingerprint.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    text = collections.defaultdict(set)
    for r in rows:
        text[r[0]].add(r[1] or "")
    order = sorted({r[0] for r in rows if r[0] is not None})
    order = [None, *order]
    for r in got:
        own = text[r["doc_id"]].pop() if len(text[r["doc_id"]]) == 1 else None
        text[r["doc_id"]].add(own)
        after = order[(order.index(r["doc_id"]) + 1) % len(order)] if r["doc_id"] != 305 else 305
        q = len(own) // 4
        nexts = [own[: len(own) - q] + t[:q] for t in [*text[after], *(text[306] if r["doc_id"] == 305 else ())]]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] in {hashlib.sha256(n.encode()).hexdigest() for n in nexts}
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[next(iter(text[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    long = next(r for r in got if r["doc_id"] == 0)
    assert long["near_edited"] > 0.2
    assert {r["near_next"] for r in got if 100 <= (r["doc_id"] or 0) < 124} == {1.0}
    assert fingerprint.fingerprint_documents(empty).count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs ('q') and ints ('i'), given as (value, kind)."""
    import struct

    import xxhash

    seed = 42
    for v, kind in values:
        seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack(f"<{kind}", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_signature(text, place=fingerprint.PLACE):
    """Order MinHash by its definition: for each part the two elements that come next on its circle, in the order of the text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return [0] * fingerprint.PARTS
    h = [spark_hash((w, "s")) for w in words]
    top = lambda x: (x & (1 << 64) - 1) >> (place + 1)
    drop = max(0, int(np.ceil(np.log2(len(words) + 1))) - place)
    kmers = sorted((top(spark_hash(*[(x, "q") for x in h[i : i + fingerprint.K]])), i >> drop) for i in range(max(1, len(h) - fingerprint.K + 1)))
    seen, elements = collections.Counter(), []
    for x, at in kmers:
        elements.append((x, seen[x], at))
        seen[x] += 1
    out = []
    for c in range(fingerprint.CIRCLES):
        ring = sorted((top(spark_hash((x, "q"), (n, "i"), *([(c, "i")] if c else []))), at) for x, n, at in elements)
        for arc in range(fingerprint.ARCS):
            first = next((i for i, (x, _) in enumerate(ring) if x * fingerprint.ARCS >> (63 - place) >= arc), 0)
            a, b = ring[first], ring[(first + 1) % len(ring)]
            if a[1] > b[1]:
                a, b = b, a
            out.append(spark_hash((a[0], "q"), (b[0], "q")) & 0x7FFFFFFF)
    return out


def test_signature_equals_plain_order_minhash(spark, rows, monkeypatch):
    for place in (fingerprint.PLACE, 7):  # 7: a text of more than 127 words keeps its places to within a power of two
        monkeypatch.setattr(fingerprint, "PLACE", place)
        df = spark.createDataFrame([(r[1],) for r in rows], "t string").dropDuplicates()
        got = fingerprint.signatures(df.withColumn("u", F.col("t")), {"s": "u"}).collect()
        assert len(got) > 60
        for r in got:
            assert list(r["s"]) == plain_signature(r["t"], place), r["t"]


def independent_likeness(a, b, hashes=512):
    """Order MinHash with a hash of its own for each part."""
    def elements(text):
        words, seen, out = text.split(), collections.Counter(), []
        for i in range(max(1, len(words) - fingerprint.K + 1)):
            k = " ".join(words[i : i + fingerprint.K])
            out.append(spark_hash((k, "s"), (seen[k], "i")))
            seen[k] += 1
        return np.array(out, np.int64).view(np.uint64)

    def parts(h):
        for i in range(hashes):
            x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
            yield tuple(h[np.sort(np.argpartition(x ^ (x >> np.uint64(32)), 1)[:2])])

    return np.mean([x == y for x, y in zip(parts(elements(a)), parts(elements(b)), strict=True)])


def test_likeness_is_near_that_of_independent_hashes(spark):
    """Short and long texts, edited a little and a lot: unbiased, and off by sampling 64 parts."""
    rng = random.Random(12)
    pairs = []
    for n in (12, 30, 100, 400):
        for _ in range(40):
            w = [f"{rng.choice(WORDS)}{rng.randint(0, 50)}" for _ in range(n)]
            v = [*w[: n - n // rng.choice((3, 4, 10))], *(f"new{rng.random()}" for _ in range(n // 4))]
            pairs.append((n, " ".join(w), " ".join(v)))
    df = fingerprint.signatures(spark.createDataFrame(pairs, "n int, a string, b string").withColumns({"x": F.col("a"), "y": F.col("b")}), {"s": "x", "t": "y"})
    off = collections.defaultdict(list)
    for r in df.select("n", "a", "b", fingerprint.likeness(F.col("s"), F.col("t")).alias("l")).collect():
        off[r["n"]].append(r["l"] - independent_likeness(r["a"], r["b"]))
    for n, d in off.items():
        assert np.mean(np.abs(d)) < 0.07 and abs(np.mean(d)) < 0.03, (n, np.mean(np.abs(d)), np.mean(d))
    assert np.mean(np.abs(sum(off.values(), []))) < 0.055


def test_fingerprints_of_ids_that_repeat(spark, monkeypatch):
    """A third of the rows without an id, a third with one id, large ids: neighbours as in the sorted table."""
    monkeypatch.setattr(fingerprint, "STRETCH", 10)
    rng = random.Random(13)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) for _ in range(240)]
    made = [(None if i < 80 else 1 << 60 if i < 160 else (1 << 60) + i, t) for i, t in enumerate(texts)]
    got = fingerprint.fingerprint_documents(spark.createDataFrame(made, "doc_id long, text string").repartition(3))
    order = sorted(made, key=lambda r: (-(1 << 63) if r[0] is None else r[0], spark_hash((r[1], "s"))))
    want = collections.Counter()
    for i, (d, t) in enumerate(order):
        q, nxt = len(t) // 4, order[(i + 1) % len(order)][1]
        want[d, hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in got.collect()) == want


def test_fingerprints_tell_order(spark):
    w = [f"w{i}" for i in range(400)]
    a, b = " ".join(w), " ".join(w[200:] + w[:200])  # the same k-mers but for a few, in another order
    df = fingerprint.signatures(spark.createDataFrame([(1, a), (2, b), (3, a)], "i int, t string"), {"s": "t"})
    s = {r["i"]: r["s"] for r in df.collect()}
    assert s[1] == s[3]
    same = np.mean(np.array(s[1]) == np.array(s[2]))
    assert 0.2 < same < 0.8  # a MinHash of k-mer sets would find nearly all parts equal


def auc(score, label):
    """How often a row of label 1 scores above one of label 0, ties by half."""
    pos, neg = score[label == 1], score[label == 0]
    return ((pos[:, None] > neg[None, :]).mean() + (pos[:, None] >= neg[None, :]).mean()) / 2


@pytest.mark.parametrize("module,label,cut,want,recall", [(toxicity, "toxic", 0.5, 0.9, 0.75), (quality_gam, "quality", 0.3, 0.9, 0.95)])
def test_classifiers(spark, docs, rows, empty, module, label, cut, want, recall):
    """Held-out figures that a constant answer misses: its AUC is a half, and one of its two recalls is zero."""
    d = "/root/testdata/sf0.1"
    full, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = module.train(full, labels)
    out = module.score(full, model).join(labels, "doc_id").where("held_out").toPandas()
    y, said = out[label].to_numpy(), out["predicted"].to_numpy()
    assert len(y) > 500 and 0 < y.mean() < 1
    assert auc(out["score"].to_numpy(), y) > want
    assert said[y == 1].mean() > recall and (1 - said[y == 0]).mean() > 0.75
    assert ((out["score"] >= cut) == (out["predicted"] == 1)).all()
    odd = module.score(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    for r in odd:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert module.score(empty, model).count() == 0
    none = module.train(empty, labels)
    assert {round(r["score"], 6) for r in module.score(docs, none).collect()} == {0.5}


def test_labelled_sample_is_bounded(spark, empty):
    """Ids that repeat, with equal and other texts, and a text of a megabyte: no more rows than asked for."""
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(WORDS) for _ in range(20)) for i in range(300)}
    made = [(i, t + str(k % 3)) for i, t in texts.items() for k in range(6)] + [(7, " ".join(str(rng.random()) for _ in range(60_000)))] + [(None, "x")]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(300)] + [(None, 1, 1), (5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    summarise = lambda texts: pa.array([len(t) for t in texts], pa.int64())
    for most in (10, 40, 100_000):
        got = common.labelled_sample(docs, labels, "toxic", most, summarise, "long").collect()
        allowed = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5}
        assert len(got) == min(most, sum(d in allowed for d, _ in made if d is not None))
        assert {r["id"] for r in got} <= allowed
    for module in (toxicity, quality_gam):
        model = module.train(docs, labels, max_rows=40)
        assert module.score(docs, model).count() == len(made)


def test_scores_are_plain_sums(spark):
    rng = np.random.default_rng(2)
    slot = np.full(toxicity.BUCKETS, -1, np.int32)
    slot[:50] = rng.permutation(50)
    m = toxicity.FactorizationMachine(0.3, slot, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 8)).astype(np.float32))
    rows = [np.unique(rng.integers(0, 70, k)) for k in (0, 1, 5, 40)]
    for b, s in zip(rows, m.scores(rows), strict=True):
        at = [slot[x] for x in b if slot[x] >= 0]
        z = 0.3 + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(at, 2))
        assert abs(s - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-5
    x = rng.normal(size=(200, len(quality_gam.FEATURES)))
    gam = quality_gam.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), rounds=5, pair_rounds=5)
    assert gam.pairs
    for v, s in zip(x[:20], gam.logits(x[:20]), strict=True):
        bin_of = lambda cuts, i: sum(c <= v[i] for c in cuts[i])  # noqa: B023, E731
        z = gam.intercept + sum(t[bin_of(gam.edges, i)] for i, t in enumerate(gam.tables)) + sum(t[bin_of(gam.coarse, i), bin_of(gam.coarse, j)] for i, j, t in gam.pairs)
        assert abs(z - s) < 1e-9


def test_a_term_that_matters_beside_another_alone(spark):
    """'group' is as common in both classes; it turns an insult toxic and a threat harmless."""
    rng = random.Random(3)
    made, labels = [], []
    for i in range(4000):  # of rows with 'group' 0.3 are toxic, as of those without
        insult, threat, group = rng.random() < 0.3, rng.random() < 3 / 7, rng.random() < 0.5
        words = [rng.choice(WORDS) for _ in range(8)] + ["insult"] * insult + ["threat"] * threat + ["group"] * group
        rng.shuffle(words)
        made.append((i, " ".join(words)))
        labels.append((i, int((insult and group) or (threat and not group and not insult))))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {t: m.scores([toxicity.terms(t)])[0] for t in ("insult group", "insult", "threat", "threat group", "group", "")}
    assert score["insult group"] > 0.5 < score["threat"]
    assert max(score["insult"], score["threat group"], score["group"], score[""]) < 0.5


def test_quality_filter_keeps_columns(spark, docs):
    d = "/root/testdata/sf0.01"
    model = quality_gam.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    kept = quality_gam.keep_quality(docs, model)
    assert kept.schema == docs.schema
    want = {r["doc_id"] for r in quality_gam.score(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_factorization_machine_learns_a_pair():
    """Each of two terms leans to label 1, but both together mean 0: beyond additive weights."""
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.3
        docs.append(np.unique(np.concatenate([[11] * int(a), [22] * int(b), rng.integers(100, 400, 6)]).astype(np.int32)))
        y.append(float(a != b))
    m = toxicity.fit(docs, np.array(y), np.array([11, 22, *range(100, 130)]), epochs=60)
    keys = ((), (11,), (22,), (11, 22))
    score = dict(zip(keys, m.scores([np.array(k, np.int32) for k in keys]), strict=True))
    assert score[(11,)] > 0.5 < score[(22,)] and score[(11, 22)] < 0.5 > score[()]


def test_bpe(docs, rows, empty):
    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs, path, pattern).collect()
    want = collections.Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert bpe.round_trip(empty, path, pattern).count() == 0
    machine = bpe.BytePairTransducer(ranks, pattern, max_states=500, max_words=50)  # tables that are cleared again and again
    rng = random.Random(1)
    alphabet = "abcdefgh THE the ing \n\t  '’s'll é漢字😀²½ⅷ\x85\xa0 \x1c0123!?--_~٣ʰ"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert list(memoryview(machine.encode(s)).cast("I")) == enc.encode_ordinary(s)


def test_streaming_decode():
    path, _ = tokenizer()
    ranks = bpe.read_ranks(path)
    rng = random.Random(2)
    decoder = bpe.StreamingDecoder(ranks)
    for _ in range(2000):
        raw = bytes(rng.randrange(256) for _ in range(rng.randint(0, 10))) + "é漢😀".encode()[: rng.randint(0, 9)]
        ids = [ranks[bytes([b])] for b in raw]
        assert "".join(decoder.feed(ids)) + decoder.finish() == raw.decode("utf-8", "replace")
        assert decoder.decode(np.array(ids, np.int64)) == raw.decode("utf-8", "replace")
        assert decoder.decode_bytes(ids) == raw


def plain_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs, rows, empty):
    fp = {r[1]: plain_simhash(r[1]) for r in rows}
    part = plain_components(set(fp.values()))
    least = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            least[part[fp[r[1]]]].append(r[0])
    want = collections.Counter((r[0], fp[r[1]], min(least[part[fp[r[1]]]], default=None)) for r in rows)
    got = collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_all_balls(spark):
    """Random words of 64 bits and others at 1 to 4 bits: the components of all pairs."""
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        a = rng.getrandbits(64)
        fps.add(a)
        for d in (1, 2, 3, 3, 4):
            fps.add(a ^ sum(1 << b for b in rng.sample(range(64), d)))
    want = plain_components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = plain_union(fps, [(r["src"] % (1 << 64), r["dst"] % (1 << 64)) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()])
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == groups(want)


def plain_union(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_simhash_dedup(docs, rows, empty):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    fp = {r[1]: plain_simhash(r[1]) for r in rows}
    part = plain_components(set(fp.values()))
    least = {}
    for r in rows:
        k = part[fp[r[1]]]
        least[k] = min(least.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(None if a else b for a, b in least.values())
    assert simhash.deduplicated(empty).count() == 0


def test_quality_rules(docs, rows, empty):
    got = collections.Counter(tuple(r)[:7] for r in quality_rules.apply_rules(docs).collect())
    want = collections.Counter()
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    by_id = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert "Home" not in by_id[309]["cleaned_text"] and by_id[309]["lost"] > 0
    assert quality_rules.apply_rules(empty).count() == 0


def test_line_rules_in_four_languages(spark):
    prose = ["A bright river sings under the stone house, and over the hills.", "Le vent passe sur la rivière, et la maison reste claire.", "Der Fluss singt unter dem hellen Haus, und der Wind geht weiter über das Land.", "El río canta bajo la casa clara."]
    prose = [" ".join(f"{'abcd'[k]}{w}" for w in x.split()) for k in range(4) for x in prose]  # no window of words twice
    bad = ["Home | About | Contact", "Accueil • Recherche • Plan du site", "Startseite › Kontakt › Impressum", "Inicio → Buscar → Siguiente", "Tous droits réservés 2024", "Alle Rechte vorbehalten", "Todos los derechos reservados.", "###*** $$$ %%%", "WOW!!! NOW!!! YES!!!"]
    menu = ["Produits", "Über uns", "Precios bajos"]  # entries of a list, known by their form alone
    rows = [(1, "\n".join(prose)), (2, "\n".join([*prose, *bad])), (3, "\n".join([*prose, *menu])), (4, "\n".join([*prose, *menu[:2], prose[0], menu[2]])), (5, "\n".join([*prose[:5], *bad * 6]))]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["cleaned_text"] == got[2]["cleaned_text"] == got[3]["cleaned_text"] == rows[0][1]
    assert got[4]["cleaned_text"] == rows[3][1]  # two entries are no run
    assert got[1]["kept"] and got[2]["kept"] and got[1]["lost"] == 0 < got[3]["lost"] and not got[5]["kept"]


@pytest.mark.parametrize("bits", [4, 8, 16, 64])
def test_repeats_are_verified_by_their_words(spark, monkeypatch, bits):
    """With few bits dozens of unlike windows share a hash and alternate in the text."""
    monkeypatch.setattr(quality_rules, "HASH_BITS", bits)
    rng = random.Random(bits)
    once = " ".join(f"w{i}" for i in range(3000))
    texts = [once, once + " w7 w8 w9 w10", "", "a", "a a", "a a a", "a a a a", *[" ".join(f"v{rng.randrange(9)}" for _ in range(rng.randint(3, 400))) for _ in range(20)]]

    def plain(text):
        w = text.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(windows)
        return len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)})

    got = quality_rules.apply_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def best_flow(words, distinct, quotas, repeats):
    """(most words, least cost) over every way to take words, by trying all of them."""
    keys = sorted(words)
    step = lambda p: [c for c, w in enumerate(mixing.readings(distinct[p], sum(repeats * n for (q, _), n in words.items() if q == p))) for _ in range(w)]
    cost = {p: step(p) for p in distinct}
    best = (0, 0)
    for take in itertools.product(*[range(repeats * words[k] + 1) for k in keys]):
        by_source, by_pattern = collections.Counter(), collections.Counter()
        for (p, s), n in zip(keys, take, strict=True):
            by_source[s] += n
            by_pattern[p] += n
        if all(by_source[s] <= quotas[s] for s in by_source):
            best = max(best, (sum(take), -sum(sum(cost[p][:n]) for p, n in by_pattern.items())))
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(11)
    for _ in range(25):
        words = {("ab", "a"): rng.randint(0, 3), ("ab", "b"): rng.randint(1, 3), ("a", "a"): rng.randint(0, 3), ("b", "b"): rng.randint(0, 2)}
        words = {k: n for k, n in words.items() if n}
        distinct = {p: rng.randint(1, sum(n for (q, _), n in words.items() if q == p)) for p in {p for p, _ in words}}
        quotas = {"a": rng.randint(0, 9), "b": rng.randint(0, 9)}
        got = mixing.route(words, distinct, quotas, 2)
        assert all(got[k] <= 2 * words[k] for k in words)
        by_source = {s: sum(n for (_, t), n in got.items() if t == s) for s in "ab"}
        assert all(by_source[s] <= quotas[s] for s in "ab")
        cost = 0
        for p in distinct:
            n = sum(x for (q, _), x in got.items() if q == p)
            steps = [c for c, w in enumerate(mixing.readings(distinct[p], sum(2 * x for (q, _), x in words.items() if q == p))) for _ in range(w)]
            cost += sum(steps[:n])
        assert (sum(got.values()), -cost) == best_flow(words, distinct, quotas, 2)


def test_targets():
    got = mixing.fill_targets({"a": 10, "b": 1000, None: 500}, {"a": 5, "b": 2, None: 1}, 1510)
    assert got["a"] == 30 and abs(sum(got.values()) - 1510) < 1e-9 and abs(got["b"] / got[None] - 2) < 1e-9
    assert mixing.cycled_weights(["b", None, "a", "c"]) == {"a": 5, "b": 2, "c": 1, None: 5}


def test_every_pattern_of_many_is_routed(spark):
    """325 patterns, each pair of 26 sources with two texts of its own: sources end within a document of their targets."""
    rng, rows = random.Random(12), []
    for a, b in itertools.combinations("abcdefghijklmnopqrstuvwxyz", 2):
        for k in range(2):
            text = f"{a}{b}{k} " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 49)))
            rows += [(len(rows), text, a), (len(rows) + 1, text, b)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), F.col("source")).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert len(got) == len(rows) and max(r["copies"] for r in got) <= 3
    # A stretch ends within half a document of its place, and a source has a stretch in each of 25 patterns.
    assert all(abs(taken[s] - t) <= 25 * 25 for s, t in target.items())
    assert sum(abs(taken[s] - t) for s, t in target.items()) <= 26 * 50


def test_a_mix_of_too_many_pairs_is_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y"), (3, "c", "z")], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "MAX_PAIRS", 3)
    assert mixing.mix(docs, F.col("source")).count() == 3
    monkeypatch.setattr(mixing, "MAX_PAIRS", 2)
    with pytest.raises(ValueError, match="pairs"):
        mixing.mix(docs, F.col("source"))


def test_mixing(docs, rows, empty):
    def run():
        return mixing.mix(docs, F.col("source")).collect()

    got, again = run(), run()
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, again)) and len(got) == len(rows)
    taken, target, largest, sizes = collections.Counter(), {}, collections.Counter(), collections.Counter()
    for r in got:
        s = r["source"]
        assert 0 <= r["copies"] <= 3
        taken[s] += r["size"] * r["copies"]
        sizes[s] += r["size"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 or all(target[s] <= 3 * sizes[s] + 1e-9 for s in target)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] + 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = collections.Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +want
    assert mixing.mix(empty, F.col("source")).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_of_shared_texts(spark):
    """x and y hold the same 200 texts, x 200 more: quotas that fresh words fill take no text twice."""
    text = lambda i: " ".join([f"t{i}"] * (5 + i % 7))
    made = [(i, text(i), "x") for i in range(400)] + [(1000 + i, text(i), "y") for i in range(200)] + [(2000, text(3), "y")]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(4)
    quotas = {"x": sum(5 + i % 7 for i in range(400)) - 700, "y": 700}  # all words, each once
    got = mixing.mix(docs, F.col("source"), quotas=lambda own: quotas).collect()
    taken, texts = collections.Counter(), collections.Counter()
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        i = 3 if r["doc_id"] == 2000 else r["doc_id"] % 1000
        texts[i] += r["copies"] if r["size"] else 0
    assert all(abs(taken[s] - q) <= 2 * 11 for s, q in quotas.items())  # two stretches of texts of 11 words at most
    alone = sum(r["copies"] for r in got if r["source"] == "x" and r["doc_id"] >= 200)
    assert alone >= 199  # x takes what y does not hold
    assert sum(n > 1 for n in texts.values()) <= 4  # but where stretches end, or 3, which y holds twice
    want = collections.Counter({r["doc_id"]: r["copies"] for r in got})
    mixed = mixing.mixed_documents(docs)
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs, F.col("source")).collect()})
    assert sum(want.values()) > 0


def test_mixing_cuts_a_text_that_most_rows_share(spark):
    made = [(i, "the same five words here", "x") for i in range(900)] + [(1000 + i, f"others are {i}", "y") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string"), F.col("source"), quotas=lambda own: {"x": 1234, "y": 900}).collect()
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
    assert abs(taken["x"] - 1234) <= 5 and taken["y"] == 900


def test_warc(spark, empty):
    pages = [(i, f"http://e.org/{i}", f"<p>{i}</p>" * 50) for i in range(40)] + [(50 + i, "http://e.org/c", "same é") for i in range(9)]
    pages += [(60, None, None), (61, "u", ""), (62, "a\r\nb: c", "x"), (None, "n", "same é"), (63, "big", "z" * 3_000_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_bytes int").repartition(3)
    path = fresh_path(spark, "warc-test")
    index = warc.write_archives(df, path)
    got = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    assert len(got) == len(pages)
    import base64

    for p in pages:
        body = (p[2] or "").encode()
        r = got[p[0]]
        same = sorted(q[0] for q in pages if (q[2] or "") == (p[2] or "") and q[0] is not None)
        first = same[0]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == p[0] else ("revisit", first))
    entries = {r["page_id"]: r for r in warc.read_index(spark, path).collect()}
    assert len(entries) == len(pages)
    for p in pages:  # every record by its identifier, through one frame
        entry, r = entries[p[0]], got[p[0]]
        assert entry["record_id"] == warc.record_id(p[0]) and entry["bundle"].startswith(f"{path}/bundles/")
        head, payload = warc.read_record(entry["bundle"], entry["frame_offset"], entry["frame_bytes"], entry["record_offset"])
        assert head["WARC-Record-ID"] == f"<{entry['record_id']}>" and head["WARC-Type"] == r["record_type"]
        assert payload == ((p[2] or "").encode() if r["record_type"] == "response" else b"")
        assert r["refers_to"] is None or head["WARC-Refers-To"] == f"<{warc.record_id(r['refers_to'])}>"
    least = warc.write_archives(df, f"{path}-least", min_bytes=100)  # smaller payloads are all responses
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_archives(least).collect()}
    assert set(kinds.values()) == {"response"} and len(kinds) == len(pages)
    none = spark.createDataFrame([], df.schema)
    assert warc.archive_round_trip(spark, none).count() == 0


def plain_line_dedup(rows, short=False):
    """(row, numbers of the lines that go) of every row: windows seen in an earlier row, or before in the same one."""
    sha = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:15], 16) if t is not None else 0
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1]))):
        full = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((r[1] or "").split("\n"))]
        full = [(i, x) for i, x in full if x]
        windows = [full[j : j + 3] for j in range(len(full) - 2)] or ([full] if short and full else [])
        gone = set()
        for w in windows:
            key = tuple(x for _, x in w)
            if key in seen:
                gone.update(i for i, _ in w)
            seen.add(key)
        out.append((r, sorted(gone)))
    return out


def cut_lines(text, gone):
    return None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in set(gone))


@pytest.fixture(scope="module")
def shared_rows(rows):
    """Rows with repeated passages under one id, under null ids, and equal in all columns or in id and text alone."""
    passage = "a bright river\nsings under stone\n\nover the green house"
    more = [(5, passage + "\nend", "en", "s0"), (5, "begin\n" + passage, "en", "s0"), (None, passage, "en", "s1"), (None, passage + "\n" + passage, "en", "s1")]
    more += [(None, passage, "en", "s1")] * 3 + [(None, passage, "fr", "s1"), (900, "x y z\n" * 3, "en", "s2"), (900, "x y z\n" * 3, "en", "s2"), (901, "only one line", "en", "s2"), (901, "only one line", "en", "s2")]
    return rows + [(*r, len(r[1] or ""), 0.5, 7) for r in more]


@pytest.mark.parametrize("short", [False, True])
def test_line_dedup(spark, shared_rows, empty, short):
    docs = spark.createDataFrame(shared_rows, SCHEMA).repartition(3)
    got = line_dedup.judged(docs, short=short).select("doc.doc_id", F.col("doc.text").alias("was"), "n_lines", "gone", "text").collect()
    want = collections.Counter((r[0], r[1], tuple(gone), cut_lines(r[1], gone)) for r, gone in plain_line_dedup(shared_rows, short))
    assert collections.Counter((r["doc_id"], r["was"], tuple(r["gone"]), r["text"]) for r in got) == want
    assert sum(len(k[2]) * n for k, n in want.items()) > 60
    assert all(r["n_lines"] == len(r["was"].split("\n")) for r in got if r["was"] is not None)
    clean = line_dedup.cleaned_documents(docs, short=short)
    assert clean.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect() if r["text"] is not None)
    assert line_dedup.dedup_lines(empty, short=short).count() == 0


def test_line_dedup_takes_any_column_name(spark, shared_rows):
    names = ["doc_id", "text", "_lines", "gone", "o", "doc", "later.w"]
    docs = spark.createDataFrame(shared_rows, SCHEMA).toDF(*names)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == names
    want = collections.Counter((r[0], cut_lines(r[1], gone), *r[2:]) for r, gone in plain_line_dedup(shared_rows))
    assert collections.Counter(map(tuple, out.collect())) == want


@pytest.mark.parametrize("bundles", [8, 10_240])
def test_sharding(docs, rows, empty, bundles):
    got = sharding.shard_documents(docs, n_shards=5, bundles=bundles).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by_crc = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    load = collections.Counter()
    for r in got:
        by_crc[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in by_crc.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for r in got:
        groups[r["text_crc32"]] += r["size"]
    total = sum(load.values())
    alone = [n for n in groups.values() if n * bundles > total]
    assert (len(alone) < len(groups)) == (bundles == 8)  # with 8 most groups go in bundles
    assert max(load.values()) <= total / 5 + max([*groups.values(), *([total / bundles + max(groups.values())] if bundles == 8 else ())])
    assert sharding.shard_documents(empty, bundles=bundles).count() == 0


def test_shards_are_balanced(spark):
    """Many small groups: bundles even out to within a part in a hundred."""
    rng = random.Random(15)
    made = [(i, "x" * rng.randint(0, 400) + str(i % 1500)) for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(made, "doc_id long, text string"), n_shards=8, bundles=512).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    load = [r["n"] for r in got]
    assert len(load) == 8 and max(load) < 1.01 * sum(load) / 8


def test_rows_repeated_in_shards(spark, monkeypatch):
    """A row that half of all repeat is made again in pieces; slots stay gapless."""
    monkeypatch.setattr(common, "COPIES", 100)
    made = [(7, "hot")] * 1500 + [(None, None)] * 3 + [(i, f"text {i}") for i in range(1500)]
    got = sharding.shard_documents(spark.createDataFrame(made, "doc_id long, text string"), n_shards=5, bundles=64).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in made)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fingerprints_of_repeated_rows(spark, monkeypatch):
    """Folded rows have the results of a plain walk through the rows in order."""
    monkeypatch.setattr(common, "COPIES", 10)
    long = lambda n: " ".join(f"n{n} m{i}" for i in range(40))
    made = [(5, long(5))] * 45 + [(None, "")] * 4 + [(9, long(9))] * 2 + [(i, long(i)) for i in (1, 3, 4, 6, 8, 12)]
    got = fingerprint.fingerprint_documents(spark.createDataFrame(made, "doc_id long, text string")).collect()
    rows = sorted(made, key=lambda r: (r[0] is not None, r[0] or 0))
    want = collections.Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(text) // 4
        want[i, len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) == 44


def test_lpt():
    got = sharding.lpt([(7, ("a",)), (5, ("b",)), (4, ("c",)), (3, ("d",))], 2)
    assert got == {("a",): 0, ("b",): 1, ("c",): 1, ("d",): 0}


def plain_jaccard_components(texts):
    """Every text's component over all pairs of five-word Jaccard 0.8 or more, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return label


def test_pipeline_near_dedup_against_all_pairs(spark, rows, empty):
    import corpus_pipeline

    rng = random.Random(9)
    made = list(rows)
    for i in range(60):  # one to six words of 120 to 200 differ: Jaccard from 0.9 down to below 0.8
        words = [f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(rng.randint(120, 200))]
        made.append((1000 + 2 * i, " ".join(words), "en", "s0", 1, 0.5, 7))
        for at in rng.sample(range(len(words)), 1 + i % 6):
            words[at] = f"other{i}"
        made.append((1001 + 2 * i, " ".join(words), "en", "s0", 1, 0.5, 7))
    made = [r for r in made if r[0] is not None]
    label = plain_jaccard_components([r[1] for r in made])
    least = {}
    for r, k in zip(made, label):
        least[k] = min(least.get(k, r[0]), r[0])
    planted = sum(least[label[k]] != r[0] for k, r in enumerate(made) if r[0] >= 1000)
    assert 20 < planted < 60
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(made, empty.schema), "")
    assert got.columns == empty.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0


def test_pipeline_line_dedup_takes_short_texts(spark, docs, rows, empty):
    import corpus_pipeline

    long = "a passage of many words on a single line " * 8
    made = [r for r in rows if r[0] is not None]
    texts = [long, long + "\n\nsecond", long + "\nsecond", long, f"first\n{long}\nsecond\nthird", "second\n" + long, "\n " + long + "\n", "", " \n ", None]
    made += [(2000 + i, t, "en", "s0", len(t or ""), 0.5, 7) for i, t in enumerate(texts)]
    out = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(made, empty.schema), "")
    got = {(r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] >= 2000}
    want = list(texts)
    want[2], want[3], want[6] = "", "", "\n"  # repeated whole texts; 2004 and 2005 hold the line among others
    assert got == {(2000 + i, t) for i, t in enumerate(want)}
    want = collections.Counter((r[0], cut_lines(r[1], gone)) for r, gone in plain_line_dedup(made, short=True))
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def test_bpe_tables_stay_bounded():
    """Long random pieces make states without end: tables are emptied within a piece, and ids stay right."""
    import tiktoken

    path, pattern = tokenizer()
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    machine = bpe.BytePairTransducer(ranks, pattern, max_states=300, max_words=20)
    rng = random.Random(7)
    for n in (1, 65, 20_000):
        for alphabet in ("etaoinshr", "漢字", "a", " "):
            text = "".join(rng.choice(alphabet) for _ in range(n)) + " " + " ".join(f"w{rng.random()}" for _ in range(40))
            assert list(memoryview(machine.encode(text)).cast("I")) == enc.encode_ordinary(text)
            assert len(machine.states) <= 300 and len(machine.words) <= 20 and len(machine.pair) <= 600
            assert all(len(w) <= bpe.MAX_WORD for w in machine.words)


def test_pipeline_stages_against_plain_versions(spark, tmp_path, shared_rows, empty):
    """Each stage on what the one before kept of the odd rows: null and shared ids, copies, empty texts, clashing columns."""
    import tiktoken

    import corpus_pipeline

    sf = f"file://{tmp_path}"
    spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame(shared_rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{sf}/documents.parquet")
    key = lambda r: (r["doc_id"], r["text"])
    count = lambda df: collections.Counter(map(key, df.collect()))
    (_, quality), (_, lines), (_, near), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    model = quality_gam.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = quality(spark, docs, sf)
    scores = model.scores(np.array([quality_gam.features(r[1]) for r in shared_rows]))
    assert count(kept) == collections.Counter((r[0], r[1]) for r, s in zip(shared_rows, scores, strict=True) if s >= 0.3)
    assert kept.columns == docs.columns and kept.count() > 60

    rows = [tuple(r) for r in kept.collect()]
    cleaned = lines(spark, spark.createDataFrame(rows, SCHEMA), sf)
    want = collections.Counter((r[0], cut_lines(r[1], gone)) for r, gone in plain_line_dedup(rows, short=True))
    assert count(cleaned) == want and cleaned.columns == docs.columns

    rows = [tuple(r) for r in cleaned.collect()]
    single = near(spark, spark.createDataFrame(rows, SCHEMA), sf)
    least = {}
    for r, k in zip(rows, plain_jaccard_components([r[1] for r in rows]), strict=True):
        least[k] = min(least.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    assert collections.Counter(r["doc_id"] for r in single.collect()) == collections.Counter(None if a else b for a, b in least.values())
    assert single.columns == docs.columns

    rows = [tuple(r) for r in single.collect()]
    mixed = mix(spark, spark.createDataFrame(rows, SCHEMA), sf)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own, taken = collections.Counter(), collections.Counter()
    for r in rows:
        own[r[3]] += size(r[1])
    for r in mixed.collect():
        taken[r["source"]] += size(r["text"])
    targets = mixing.fill_targets(dict(own), mixing.cycled_weights(own), sum(own.values()))
    assert all(abs(taken[s] - targets[s]) <= max(size(r[1]) for r in rows if r[3] == s) for s in own)
    assert max(count(mixed).values()) <= 3 and mixed.columns == docs.columns

    path, pattern = tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in tokens(spark, mixed, sf).collect())
    assert got == collections.Counter((r["doc_id"], len(enc.encode_ordinary(r["text"] or ""))) for r in mixed.collect())
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_encoded_documents(spark, rows):
    import tiktoken

    path, pattern = tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = bpe.encode_documents(spark.createDataFrame(rows, SCHEMA), path, pattern).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"]) for r in got) == collections.Counter((r[0], tuple(x := enc.encode_ordinary(r[1] or "")), len(x)) for r in rows)
