"""Operator 1: document fingerprints by Order MinHash.

Marcais et al., "Locality-sensitive hashing for the edit distance" (2019): of the occurrence-
numbered k-mers of a text, each of the signature's parts selects the few of least hash, keeps them
in the order of the text and hashes that tuple. Unlike MinHash it tells texts apart whose k-mers
are the same in another order. Here k-mers are of K words, numbered so that the second of two
equal k-mers is another element than the first.

A hash of each element serves ARCS parts: a part begins at its point of the circle of hashes and
selects the next two elements from there. Sorting a text's elements CIRCLES times thus replaces a
pass for each part, which whole texts could not afford, and short texts fill every part as well.
Parts of a circle are not independent where a text has few elements; the README has the error.

Only DataFrame functions run here. Elements are packed into longs (hash above, place in the text
below), which Spark sorts as primitive arrays.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import repeated, words
from kinloom.shared import written

#: Words of a k-mer; circles of hashes, and parts of a signature that begin on one; each part takes two elements.
K, CIRCLES, ARCS = 5, 4, 16
PARTS = CIRCLES * ARCS
#: Low bits of a packed element that hold its place; the hash keeps 39 bits. In texts of more than
#: 2^24 words places are kept to within a power of two.
PLACE = 24
#: Rows of a stretch of neighbouring ids that one task looks at together.
STRETCH = 1000
#: The bound on stretches; beyond it they hold more rows.
MAX_STRETCHES = 20_000
#: Rows of a stretch that are looked at to cut stretches, on the average.
SAMPLED = 20


def _pack(h: Column, place: Column) -> Column:
    """39 bits of the hash above the place; not negative."""
    return F.shiftleft(F.shiftrightunsigned(h, PLACE + 1), PLACE).bitwiseOR(place.cast("long"))


def signatures(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """df with an array<int> column of PARTS hashes for each {new column: text column}, whose text
    columns are dropped.

    Texts of fewer than K words have their whole sequence as one element; texts without a word and
    nulls have a signature of zeros. Equal texts have equal signatures. Temporary columns begin
    with _omh_. Each step refers more than once to what the step before has made, so that the
    optimizer keeps it as a column and does not repeat it for every element.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in texts.values()]
    each = list(texts)
    col = lambda name, k: F.col(f"_omh_{name}{k}")

    def step(df: DataFrame, **make) -> DataFrame:
        return df.select(*keep, *[f(k).alias(f"_omh_{name}{k}") for k in range(len(each)) for name, f in make.items()])

    place = F.lit((1 << PLACE) - 1).cast("long")
    high = lambda x: F.shiftright(x, PLACE)
    changes = lambda name, k, of, value: F.filter(
        F.transform(col(name, k), lambda x, i: F.when((i == 0) | (of(F.get(col(name, k), i - 1)) != of(x)), value(x, i))), lambda v: v.isNotNull()
    )
    kept = lambda name: lambda k: col(name, k)
    df = step(df, w=lambda k: F.transform(words(F.col(f"`{texts[each[k]]}`")), lambda w: F.xxhash64(w)))

    def kmers(k):
        w = col("w", k)
        drop = F.greatest(F.ceil(F.log2(F.size(w) + 1)).cast("int") - PLACE, F.lit(0))
        kmer = lambda i: _pack(F.xxhash64(*[F.get(w, i + j) for j in range(K)]), F.call_function("shiftright", i, drop))
        return F.when(F.size(w) > 0, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0))), kmer)))

    # Sorted, equal k-mers stand together in the order of the text; f: where their runs begin.
    df = step(df, s=kmers)
    df = step(df, s=kept("s"), f=lambda k: changes("s", k, high, lambda x, i: i))

    def occurrences(k):
        s, f = col("s", k), col("f", k)
        runs = F.transform(f, lambda i, r: F.sequence(F.lit(0), F.coalesce(F.get(f, r + 1), F.size(s)) - i - 1))
        return F.when(F.size(s) > F.size(f), F.flatten(runs))

    df = step(df, s=kept("s"), o=occurrences)

    def elements(c):
        def sort(k):
            s, o, salt = col("s", k), col("o", k), [F.lit(c)] if c else []
            element = lambda n: lambda x, i: _pack(F.xxhash64(high(x), n(i), *salt), x.bitwiseAND(place))
            return F.sort_array(F.when(o.isNull(), F.transform(s, element(lambda i: F.lit(0)))).otherwise(F.transform(s, element(lambda i: F.get(o, i)))))

        return sort

    circles = range(CIRCLES)
    df = step(df, **{f"e{c}_": elements(c) for c in circles})
    # Arcs of the circle that have elements, as arc * 2^32 + the place of their first.
    arc = lambda x: F.shiftright(x, 63 - (ARCS - 1).bit_length())
    begins = lambda c: lambda k: changes(f"e{c}_", k, arc, lambda x, i: F.shiftleft(arc(x), 32).bitwiseOR(i.cast("long")))
    df = step(df, **{f"e{c}_": kept(f"e{c}_") for c in circles}, **{f"b{c}_": begins(c) for c in circles})

    def starts(c):
        """Each arc begins at its first element or that of the next arc that has one; past the last, at 0."""

        def fill(k):
            b = col(f"b{c}_", k)
            gap = lambda x, r: (F.shiftright(x, 32) - F.coalesce(F.shiftright(F.get(b, r - 1), 32), F.lit(-1))).cast("int")
            filled = F.flatten(F.transform(b, lambda x, r: F.array_repeat(x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"), gap(x, r))))
            return F.slice(F.concat(filled, F.array_repeat(F.lit(0), ARCS)), 1, ARCS)

        return fill

    df = step(df, **{f"e{c}_": kept(f"e{c}_") for c in circles}, **{f"a{c}_": starts(c) for c in circles})

    def tuples(k):
        def of(c):
            e, a = col(f"e{c}_", k), col(f"a{c}_", k)

            def part(i):
                x, y = F.get(e, i), F.get(e, F.pmod(i + 1, F.size(e)))
                ahead = x.bitwiseAND(place) <= y.bitwiseAND(place)
                return F.when(ahead, F.xxhash64(high(x), high(y))).otherwise(F.xxhash64(high(y), high(x))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

            return F.when(e.isNotNull() & a.isNotNull(), F.transform(a, part)).otherwise(F.array_repeat(F.lit(0), ARCS))

        return F.concat(*map(of, circles))

    df = step(df, t=tuples)
    return df.select(*keep, *[col("t", k).alias(name) for k, name in enumerate(each)])


def likeness(a: Column, b: Column) -> Column:
    """The share of parts that two signatures have in common."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / PARTS


def as_text(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), ""))


def _edges(keys: DataFrame) -> list[tuple[int, int]]:
    """Rows (k, h) at which stretches begin, the first of all at the front: some of a sample by hash."""
    n, least = keys.agg(F.count("*"), F.min(F.struct("k", "h"))).first()
    if not n:
        return [(0, 0)]
    share = max(2, min(MAX_STRETCHES, n // STRETCH))
    part = min(1.0, SAMPLED * share / n)
    sample = sorted({tuple(r) for r in keys.where(F.pmod(F.xxhash64("h", "k"), F.lit(1 << 30)) < part * (1 << 30)).select("k", "h").collect()})
    cuts = {sample[i * len(sample) // share] for i in range(1, share)} if sample else set()
    return [tuple(least), *sorted(cuts - {tuple(least)})]


def _folded(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, bool]:
    """rows with copies, and whether any were folded: of rows equal in k and h that occur more than twice two stay, of which the
    first stands for all but the last. What follows a copy is a copy, so those are alike."""
    many = keys.groupBy("k", "h").agg(F.count("*").alias("n")).where("n > 2")
    if many.isEmpty():  # as it should be: no rows are equal in id and text
        return rows.withColumn("copies", F.lit(1).cast("long")), False
    joined = rows.join(written(many, "many"), ["k", "h"], "left")
    kinds = joined.where("n IS NOT NULL").groupBy("k", "h", "doc_id").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    weights = F.filter(F.array(F.col("n") - 1, F.lit(1).cast("long")), lambda x: x > 0)
    folded = kinds.select("doc_id", "text", "k", "h", F.explode(weights).alias("copies"))
    return joined.where("n IS NULL").select("doc_id", "text", "k", "h", F.lit(1).cast("long").alias("copies")).unionByName(folded), True


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window, bool]:
    """Rows dealt to stretches of neighbours in the order of id and text hash, and the window over a stretch.

    Stretches begin at rows that occur. The row at which the next stretch begins is dealt to the
    former, too, as a ghost, and the first row of all as a ghost to the last stretch. So texts are
    shuffled once, and no task sees more than its stretches.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("k")).withColumn("h", F.xxhash64("text"))
    keys = written(rows.select("k", "h"), "keys")
    edges = _edges(keys)
    rows, folded = _folded(rows, keys)
    # Found in two steps, among every 100th edge and then among 100.
    groups = [edges[i : i + 100] for i in range(0, len(edges), 100)]
    listed = lambda pick, kind: F.from_json(F.lit(json.dumps(pick)), kind)
    coarse = [listed([g[0][x] for g in groups], "array<bigint>") for x in (0, 1)]
    fine = [F.get(listed([[e[x] for e in g] for g in groups], "array<array<bigint>>"), F.col("c")) for x in (0, 1)]
    below = lambda k, h: F.size(F.filter(k, lambda x, i: (x < F.col("k")) | ((x == F.col("k")) & (F.get(h, i) <= F.col("h"))))) - 1
    rows = rows.withColumn("c", below(*coarse))
    rows = rows.withColumn("f", below(*fine)).withColumn("own", F.col("c") * 100 + F.col("f"))
    begins = (F.get(fine[0], F.col("f")) == F.col("k")) & (F.get(fine[1], F.col("f")) == F.col("h"))
    places = F.array(
        F.struct(F.col("own").alias("stretch"), F.lit(0).alias("ghost")),
        F.when(begins & (F.col("own") > 0), F.struct((F.col("own") - 1).alias("stretch"), F.lit(1).alias("ghost"))),
        F.when(begins & (F.col("own") == 0), F.struct(F.lit(len(edges) - 1).alias("stretch"), F.lit(2).alias("ghost"))),
    )
    dealt = rows.select("doc_id", "text", "k", "h", "copies", F.explode(F.array_compact(places)).alias("p")).select("doc_id", "text", "k", "h", "copies", "p.*")
    return dealt, Window.partitionBy("stretch").orderBy("ghost", "k", "h", F.desc("copies")), folded


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next row's, in the order of doc_id; after the last row comes the first. Null ids
    come first and rows that share an id follow each other by a hash of their text. A null text is
    the empty text. Rows equal in id and text follow each other: two are fingerprinted, and the first
    of them is made again for the others at the end. An empty table gives an empty result; other columns are not read.
    """
    dealt, stretch, folded = _neighbours(docs, id_col, text_col)
    quarter = F.floor(F.length("text") / 4).cast("int")
    both = dealt.withColumn("next", F.lead("text").over(stretch)).select(
        "doc_id", "stretch", "ghost", "k", "h", "copies", F.length("text").cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter)).alias("edited"),
    )
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    signed = signatures(both, {"sig": "text", "edited_sig": "edited"})
    signed = signed.withColumn("next_sig", F.lead("sig").over(stretch)).where("ghost = 0")
    out = signed.select(
        "copies", "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
    return repeated(out, "copies", "copy").drop("copies", "copy") if folded else out.drop("copies")
