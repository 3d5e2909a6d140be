"""Operator 9: removing passages that repeat, by overlapping windows of three lines.

Every three consecutive lines that hold a word form a window, hashed to 128 bits. Windows are
counted over all documents with map-side combining; those seen more than once keep their smallest
document. A window is a later occurrence if that document is smaller, or if the same document has
it before. Lines that later occurrences cover are merged and removed.

Windows are moved without their text, as hashes and a place, and the join with the repeated windows
is an equi-join that adaptive execution can split, so a passage in a third of all documents is no
bottleneck. What is gathered for a document is a set of its own windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.shared import written

#: A null id orders before every other.
NO_ID = -(1 << 63)
TRIMMED = " \t\r\x0b\x0c"
#: Copies of one row that a task makes at once.
CHUNK = 4096


def _order(id_: Column, text: Column) -> Column:
    """Rows in order: by id, null first, then by 60 bits of the text's SHA-256; one number, which
    aggregates by hashing where a pair would have to be sorted."""
    t = F.coalesce(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), F.lit(0))
    d = F.coalesce(id_.cast("long"), F.lit(NO_ID))
    return (d.cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + t.cast("decimal(19,0)")).cast("decimal(38,0)")


def _full(text: Column) -> Column:
    """The lines that hold a word, trimmed, with their numbers."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(TRIMMED)).alias("x"), i.alias("i")))
    return F.filter(lines, lambda s: s["x"] != "")


def _windows(docs: DataFrame, short: bool) -> DataFrame:
    """o (order), j (place among the lines that hold a word), h1, h2 of every window; with `short` a
    text of one or two such lines is a window too."""
    cut = docs.select("o", F.transform(_full(F.col("text")), lambda s: s["x"]).alias("x")).where(F.size("x") >= (1 if short else 3))

    def window(j):
        at = [F.get("x", j + k) for k in range(3)]  # hashes pass over the nulls behind a short text's end
        return F.struct(j.alias("j"), F.xxhash64(*at).alias("h1"), F.xxhash64(F.lit(31), *at).alias("h2"))

    last = F.greatest(F.size("x") - 3, F.lit(0))
    return cut.select("o", F.explode(F.transform(F.sequence(F.lit(0), last), window)).alias("w")).select("o", "w.*")


def later_windows(docs: DataFrame, short: bool = False) -> DataFrame:
    """o, copies, later for each order of docs (o, text) with a repeated window: how many rows share
    it, and the places of the windows that go."""
    windows = _windows(docs, short)
    seen = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("o").alias("first")).where("n > 1").select("h1", "h2", "first")
    hits = windows.join(seen, ["h1", "h2"]).select("o", F.struct("h1", "h2", "j", (F.col("o") > F.col("first")).alias("later")).alias("w"))
    per = hits.groupBy("o").agg(F.greatest(F.count_if(F.col("w.j") == 0), F.lit(1)).alias("copies"), F.array_sort(F.collect_set("w")).alias("w"))
    # Sorted by hash and place, a window that the same document has before stands behind it.
    before = lambda x, i: F.coalesce((F.get("w", i - 1)["h1"] == x["h1"]) & (F.get("w", i - 1)["h2"] == x["h2"]), F.lit(False))
    gone = F.filter("w", lambda x, i: x["later"] | before(x, i))
    return per.select("o", "copies", F.transform(gone, lambda x: x["j"]).alias("later")).where((F.size("later") > 0) | (F.col("copies") > 1))


def _copies(rows: DataFrame) -> DataFrame:
    """doc, gone of rows that others equal in id and text: all but one lose every window.

    Rows equal in all columns are counted, not moved, and made again in pieces of CHUNK, so that a
    row that a third of all rows repeat is not gathered in one task.
    """
    rows = rows.withColumn("x", F.xxhash64("doc"))
    kinds = rows.groupBy("o", "x").agg(F.count("*").alias("n"), F.first("doc").alias("doc"), F.first("later").alias("later"))
    first = rows.groupBy("o").agg(F.min("x").alias("first"))
    chunks = kinds.join(first, "o").select("doc", "later", "n", (F.col("x") == F.col("first")).alias("leads"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("c"))
    k = F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("c") * CHUNK + CHUNK, F.col("n")) - 1))
    out = chunks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("doc", "later", "leads", k.alias("k"))
    return out.select("doc", "later", (~F.col("leads") | (F.col("k") > 0)).alias("all"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """doc (a row's columns), n_lines, gone (sorted numbers of the lines that go) and text (what is
    left) of every row of docs.

    Lines end at \\n and compare without outer white space; blank lines are no part of windows and
    stay. A text with fewer than three lines loses none, or with `short` all if an earlier document
    consists of the same lines. Documents are ordered by id, null first, and rows that share an id
    by a hash of their text; of rows equal in both one counts as the first. A null text stays null,
    without lines. An empty table gives an empty result. Columns of docs may have any names.
    """
    c = {x: F.col(f"`{x}`") for x in docs.columns}
    packed = docs.select(F.struct(*c.values()).alias("doc"), _order(c[id_col], c[text_col]).alias("o"))
    slim = docs.select(_order(c[id_col], c[text_col]).alias("o"), c[text_col].alias("text")).where("text IS NOT NULL")
    found = written(later_windows(slim, short), "later-windows")
    joined = packed.join(found.hint("merge"), "o", "left")  # at every size: what is found grows with the documents
    many = found.where("copies > 1")
    if many.isEmpty():  # as it should be: no rows are equal in id and text
        rows = joined.select("doc", "later", F.lit(False).alias("all"))
    else:
        rows = joined.where("copies IS NULL OR copies = 1").select("doc", "later", F.lit(False).alias("all")).unionByName(_copies(joined.where("copies > 1")))
    text = F.col("doc")[text_col]
    touched = F.col("all") | (F.size("later") > 0)
    rows = rows.select("doc", "all", "later", F.split(text, "\n").alias("lines"), F.when(touched, F.transform(_full(text), lambda s: s["i"])).alias("full"))
    covered = F.array_distinct(F.flatten(F.transform("later", lambda j: F.slice("full", j + 1, 3))))
    enough = F.size("full") >= (1 if short else 3)
    gone = F.when(F.col("full").isNull(), F.array().cast("array<int>")).when(F.col("all"), F.when(enough, F.col("full")).otherwise(F.array().cast("array<int>"))).otherwise(F.array_sort(covered))
    rows = rows.select("doc", "lines", gone.alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return rows.select(
        "doc", F.size("lines").alias("n_lines"), "gone",
        F.when(F.size("gone") == 0, text).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("text"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """docs with cleaned text; every row and column is kept. See `judged` for odd rows."""
    out = judged(docs, id_col, text_col, short)
    return out.select(*[F.col("text" if c == text_col else f"doc.`{c}`").alias(c) for c in docs.columns])


def cleaned_documents(docs: DataFrame, short: bool = False) -> DataFrame:
    """dedup_lines on documents; n_chars follows the text."""
    out = dedup_lines(docs, short=short)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
