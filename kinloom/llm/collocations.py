"""Operator 13: collocations by dynamic itemset counting.

The documents are dealt to shards, which are scanned in a circle: shard 0, 1, ..., 0, 1, ... Every scan
counts phrases of all lengths that are active. Words are active from the start; a longer phrase becomes
active in the scan after both of its subphrases (without its last, without its first word) have reached the
threshold, and stays active for one full circle, so that every shard is counted once for it, however late
it began. A phrase can only reach the threshold if both subphrases do, so none is missed.

Scans tell active phrases by bit filters of bounded size over hashes of phrases: for each scan before which
phrases of a length reached the threshold, those that had by then. A phrase is let in by the first scan whose
filters hold both subphrases, rightly or not, and as filters only grow, it is counted in that scan and the others
of one circle, and in none after. So what a filter lets pass wrongly is counted needlessly, never twice, and a
counter that is below the threshold when its circle is over goes.

Most counters are of longer phrases that occur a few times, so these have no text: a counter's key is two hashes of
64 bits, of the phrase without its last word and of that word with its language. Words are counted by their text, and
what reaches the threshold gets its own from the subphrase and the word. Should two words have one hash, the
count begins again with other hashes.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm.rolling import REACH, Roller, mixed, signed
from kinloom.shared import fresh_path, remove, scratch, write, written

LEAST = 10
LONGEST = 3
TOP = 2000
SHARDS = 3
#: A candidate with LEAST_SHARE percent of its occurrences in a longer one goes.
LEAST_SHARE = 50
#: Bytes of text whose phrases a task sums at a time; bits of a filter for each phrase of its first scan, and at most.
CHUNK, BITS_EACH, MOST_BITS = 2 << 20, 32, 1 << 27
#: Rows, or phrases, that are turned into other forms at a time.
SLICE, PIECE = 512, 1 << 16

_MAP = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c for c in range(256))
_NEXT = np.uint64(0x9E3779B97F4A7C15)
#: Seeds and bits of the hashes of words; the next are taken if two words have one hash.
HASHES = ((13, 64), (17, 64), (19, 64))
#: What a counter's meta holds besides its number of words, by the bits above which it stands: let in (the first scan
#: whose filters let it pass), since (the scan after which a >= least, plus 1).
_LET_IN, _SINCE = 5, 24
_KEY = "p long, w long, a long, meta long"
_KINDS = "lang string, phrase string, " + _KEY


def _chunks(batches):
    """(langs, bytes, where each text begins) of about CHUNK bytes; texts end by a line feed. Longer texts
    are cut at ends of pieces, which no phrase crosses."""
    langs, texts, size = [], [], 0
    for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            a = 0
            while a < len(text):
                e = len(text)
                if e - a > CHUNK:
                    e = text.rfind(b"\n", a, a + CHUNK) + 1 or text.find(b"\n", a + CHUNK) + 1 or e
                langs.append(lang)
                texts.append(text[a:e] + b"\n")
                size, a = size + e - a + 1, e
                if size >= CHUNK:
                    yield langs, texts
                    langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


class Words:
    """The words of some texts: begin, end, lang (number), piece, and h, a hash of word and lang."""

    def __init__(self, langs: list[str], texts: list[bytes], roller: Roller, bits: int = 64):
        import xxhash

        self.data = d = np.frombuffer(b"".join(texts), np.uint8)
        blank = (d == 32) | (d == 10)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        self.begin, self.end = edge[::2], edge[1::2]
        self.langs, number = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        ends = np.cumsum([len(t) for t in texts])
        self.lang = number[np.searchsorted(ends, self.begin, "right")]
        breaks = np.flatnonzero(d == 10)
        self.piece = np.searchsorted(breaks, self.begin)
        h = np.empty(len(self.begin), np.uint64)
        block = REACH // 2
        for b in range(0, len(d), block):
            a, e = np.searchsorted(self.begin, [b, b + block])
            if a < e:
                sums = roller.sums(d[b : b + REACH])
                begin, end = self.begin[a:e] - b, self.end[a:e] - b
                h[a:e] = roller.hashes(sums, begin, np.minimum(end, len(sums) - 1))
                for k in np.flatnonzero(end - begin >= block):  # it may reach beyond the sums
                    h[a + k] = xxhash.xxh3_64_intdigest(d[self.begin[a + k] : self.end[a + k]].tobytes())
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.langs], np.uint64)
        self.h = mixed(mixed(h) ^ seeds[self.lang]) >> np.uint64(64 - bits)

    def texts(self, first: np.ndarray, k: int):
        """Arrow strings of the phrases of k words that begin at word `first`, and their places in it."""
        begin, end = self.begin[first], self.end[first + k - 1]
        plain = np.ones(len(first), bool)
        for j in range(k - 1):
            plain &= self.begin[first + j + 1] - self.end[first + j] == 1
        every = np.flatnonzero(plain)
        for at in (every[a : a + PIECE] for a in range(0, len(every), PIECE)):
            length = (end - begin)[at]
            offset = np.concatenate([[0], np.cumsum(length)])
            place = np.arange(offset[-1]) - np.repeat(offset[:-1] - begin[at], length)
            yield at, pa.Array.from_buffers(pa.large_utf8(), len(at), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(self.data[place])]).cast(pa.utf8())
        at = np.flatnonzero(~plain)
        if len(at):
            words = lambda i: b" ".join(self.data[self.begin[i + j] : self.end[i + j]].tobytes() for j in range(k))
            yield at, pa.array([words(i).decode("utf-8", "surrogatepass") for i in first[at]], pa.utf8())


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each different value a place where it is and its count; and for each place the value's number."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], np.diff(np.append(np.flatnonzero(new), len(x))), number


def _joined(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of a phrase lengthened by a word or phrase."""
    return mixed(h * _NEXT + more)


class Filter:
    """Bits set at two places for each phrase."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @staticmethod
    def places(h: np.ndarray, n_bits: int) -> np.ndarray:
        mask = np.uint64(n_bits - 1)
        return np.concatenate([h & mask, (h >> np.uint64(37)) & mask])

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in np.split(self.places(h, 8 * len(self.bits)).astype(np.int64), 2):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _n_bits(n: int) -> int:
    n_bits = 1 << 12
    while n_bits < min(BITS_EACH * n, MOST_BITS):
        n_bits *= 2
    return n_bits


def _hash_of(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the phrases whose counters (p, w, meta) are in a batch."""
    p, w, meta = (batch.column(c).to_numpy() for c in ("p", "w", "meta"))
    return np.where(meta % (1 << _LET_IN) == 1, w.view(np.uint64), _joined(p.view(np.uint64), w.view(np.uint64)))


def _filter(phrases: DataFrame, n_bits: int, before: Filter | None) -> Filter:
    """Of phrases (p, w, meta) and of those before. Its bits, MOST_BITS at most, reach the driver."""

    def run(batches):
        for batch in batches:
            at = np.unique(Filter.places(_hash_of(batch), n_bits).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "b"])

    found = phrases.select("p", "w", "meta").mapInArrow(run, "at int, b long").groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    bits = before.bits.view(np.int64).copy() if before else np.zeros(n_bits // 64, np.int64)
    bits[found.column("at").to_numpy()] |= found.column("b").to_numpy()
    return Filter(bits.view(np.uint8))


def _scan(step: int, words_too: bool, known: dict[int, list[tuple[int, Filter]]], longest: int, shards: int, seed: int, n: int):
    """A task's counts (lang and phrase of words, p, w, a, meta) of active phrases. known: for each length with longer
    phrases to look for, the filters and the scans from which they hold. n: bits of a word's hash."""

    def let_in(h: np.ndarray, filters: list[tuple[int, Filter]]) -> np.ndarray:
        """The first scan whose filter a phrase passes, or -1."""
        out = np.full(len(h), -1)
        for scan, f in reversed(filters):  # each passes what the one before does
            out[f.has(h)] = scan
        return out

    def run(batches):
        roller = Roller(seed)
        for langs, texts in _chunks(batches):
            words = Words(langs, texts, roller, n)
            if not len(words.begin):
                continue
            first, c, own = _unique(words.h)
            if words_too:
                for at, text in words.texts(first, 1):
                    one = first[at]
                    columns = [pa.array(words.langs.tolist(), pa.utf8()).take(pa.array(words.lang[one])), text, np.zeros(len(at), np.int64), signed(words.h[one]), c[at], np.ones(len(at), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["lang", "phrase", "p", "w", "a", "meta"])
            # own: the exact number of the phrase of k words at word `at` here, first at `first`; h: its hash.
            at, h, k, since = np.arange(len(words.begin)), words.h, 1, np.zeros(len(words.begin), np.int64)
            while k < longest and k in known and len(at):
                let = let_in(h[first], known[k])[own]
                passes = np.flatnonzero(let >= 0)
                # A filter may pass a phrase wrongly before its own words or subphrases were let in.
                at, h, own, let = at[passes], h[passes], own[passes], np.maximum(let, since)[passes]
                both = np.flatnonzero(np.diff(at) == 1)
                both = both[words.piece[at[both]] == words.piece[at[both] + k]] if len(both) else both
                # A longer phrase is told by its first subphrase and the next, which shares all but the ends.
                first, c, own = _unique(own[both].astype(np.int64) << 32 | own[both + 1])
                let = np.maximum(let[both], let[both + 1])
                p, w, at, k, since = h[both], words.h[at[both] + k], at[both], k + 1, let
                active = let[first] > step - shards
                one = first[active]
                if len(one):
                    text = [pa.nulls(len(one), pa.utf8())] * 2 if words_too else []
                    columns = [signed(p[one]), signed(w[one]), c[active], k + (let[one] << _LET_IN)]
                    yield pa.RecordBatch.from_arrays([*text, *map(pa.array, columns)], ["lang", "phrase"][: len(text)] + ["p", "w", "a", "meta"])
                h = _joined(p, w)

    return run


def _bits(name: str, low: int, high: int = 63) -> Column:
    return F.shiftright(name, low) % F.lit(1 << high - low)


def _k() -> Column:
    return _bits("meta", 0, _LET_IN)


def _added(counters: DataFrame, shards: int, step: int, least: int) -> DataFrame:
    """The sums of counters after scan `step`. Longer phrases that stayed below go once their circle is over."""
    sums = counters.groupBy(*[c for c in counters.columns if c not in ("a", "meta")]).agg(F.sum("a").alias("a"), F.max("meta").alias("meta"))
    now = (F.col("a") >= least) & (F.col("meta") < 1 << _SINCE)
    sums = sums.withColumn("meta", F.col("meta") + F.when(now, F.lit((step + 1) << _SINCE)).otherwise(F.lit(0)))
    return sums.where((_k() == 1) | (F.col("a") >= least) | (_bits("meta", _LET_IN, _SINCE) > step - shards + 1))


def _dealt(docs: DataFrame, id_col: str, text_col: str, lang_col: str, shards: int) -> str:
    """Folder of the documents' lower-cased bytes with pieces and words marked, by shard."""

    def run(batches):
        for batch in (b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
            texts = [t.encode("utf-8", "surrogatepass").translate(_MAP) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("shard"), pa.array(texts, pa.binary())], ["lang", "shard", "text"])

    c = {x: F.col(f"`{x}`") for x in (id_col, text_col, lang_col)}
    shard = F.pmod(F.xxhash64(c[id_col], c[text_col]), F.lit(shards)).cast("int").alias("shard")
    rows = docs.where(c[text_col].isNotNull()).select(F.coalesce(c[lang_col], F.lit("und")).alias("lang"), shard, c[text_col].alias("text"))
    path = fresh_path(docs.sparkSession, "shards")
    write(rows.mapInArrow(run, "lang string, shard int, text binary"), path, ("shard",))
    return path


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS) -> tuple[dict[int, DataFrame], int]:
    """Counters (lang, phrase, a) by number of words, and the scans it took: of all words, and of longer phrases
    that occur `least` times or more. To be called within a scratch(), as its files go with that."""
    if not (1 <= shards <= 31 and 1 <= longest <= 31):
        raise ValueError("shards and words of a phrase are 31 at most")
    folder = _dealt(docs, id_col, text_col, lang_col, shards)
    for hashes in HASHES:
        found = _scanned(docs.sparkSession, folder, least, longest, shards, *hashes)
        if found:
            return found
    raise ValueError("two words have one hash in each of HASHES")


def _scanned(spark: SparkSession, folder: str, least: int, longest: int, shards: int, seed: int, n: int) -> tuple[dict[int, DataFrame], int] | None:
    """What counted() returns; None if two words have one hash."""
    paths: dict[int, str] = {}
    known: dict[int, list[tuple[int, Filter]]] = {}
    words, reached = spark.createDataFrame([], _KINDS), None

    def tables(lengths: list[int], columns: list[str]) -> DataFrame | None:
        """Counters of some lengths; a scan's counters of all lengths lie together."""
        found = [spark.read.schema(_KINDS).parquet(p).select(columns).where(_k().isin(*[k for k in lengths if paths.get(k) == p])) for p in sorted({paths[k] for k in lengths if k in paths})]
        return reduce(DataFrame.unionByName, found) if found else None

    for step in count():
        for k, new in {r["k"]: r["n"] for r in reached.groupBy("k").agg(F.count("*").alias("n")).collect()}.items() if reached else ():
            before = known[k][-1][1] if k in known else None
            known.setdefault(k, []).append((step, _filter(reached.where(F.col("k") == k), 8 * len(before.bits) if before else _n_bits(new), before)))
        active = [k for k in known if max(known[j][-1][0] for j in known if j <= k) > step - shards]
        if step >= shards and not active:
            break
        grown, columns = [k + 1 for k in active], _names(_KEY)
        if step < shards:
            grown, columns = [1, *grown], _names(_KINDS)
        shard = f"{folder}/shard={step % shards}"
        scanned = spark.read.schema("lang string, text binary").parquet(shard) if _exists(spark, shard) else spark.createDataFrame([], "lang string, text binary")
        # Phrases of k + 1 words are looked for among those of k, so lengths below go along without new ones of their own.
        along = {k: known[k] for k in known if k <= max(active, default=0)}
        rows = scanned.mapInArrow(_scan(step, step < shards, along, longest, shards, seed, n), _KINDS if step < shards else _KEY)
        old = tables(grown, columns)
        path, before = fresh_path(spark, "counters"), set(paths.values())
        write(_added(rows.unionByName(old) if old is not None else rows, shards, step, least), path)
        paths |= dict.fromkeys(grown, path)
        if step == shards - 1:
            words = written(tables([1], _names(_KINDS)), "words")
            paths.pop(1)
            if not words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                return None
        remove(spark, sorted(before - set(paths.values())))
        new = spark.read.schema(_KINDS).parquet(path).where((_bits("meta", _SINCE) == step + 1) & (_k() < longest))
        reached = written(new.select("p", "w", "meta", _k().cast("int").alias("k")), "reached")
    out = {1: words.select("lang", "phrase", "a")}
    often = words.where(F.col("a") >= least)
    heads, tails = often.select("lang", F.col("phrase").alias("head"), F.col("w").alias("p")), often.select(F.col("phrase").alias("tail"), "w")
    for k in range(2, longest + 1):
        if k not in paths:
            out[k] = spark.createDataFrame([], "lang string, phrase string, a long")
            continue
        found = tables([k], _names(_KEY)).where(F.col("a") >= least).join(heads.hint("merge"), "p").join(tails.hint("merge"), "w")
        found = written(found.select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "p", "w", "a", "meta"), "texts", tidy=True)
        out[k] = found.select("lang", "phrase", "a")
        heads = found.mapInArrow(_headed, "lang string, head string, p long")
    return out, step


def _names(kinds: str) -> list[str]:
    return [x.split()[0] for x in kinds.split(", ")]


def _headed(batches):
    """Phrases and their hashes, as the beginnings of longer ones."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase"), pa.array(signed(_hash_of(batch)))], ["lang", "head", "p"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exact for counts below 10^15."""
    wide = lambda x: x.cast("decimal(15,0)")
    over = (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (wide(l) * wide(r)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's `top` phrases by score, a and phrase.

    Texts are lower-cased (A-Z) and split into pieces at .,;:!? and line ends, and these into words at
    spaces and tabs. A null text has no words, a null lang is `und`; repeated rows count as often as they
    are there. Empty tables give an empty result. The id only deals rows to shards; other columns are
    not read. Of scores of a phrase's cuts the lowest counts, of equals the one after the fewest words.
    """
    spark = docs.sparkSession
    with scratch(spark):
        found, _ = counted(docs, id_col, text_col, lang_col, least, longest, shards)
        totals = written(found[1].groupBy("lang").agg(F.sum("a").alias("n")), "totals", tidy=True)  # a row for each lang
        ranked = None
        for k in range(2, longest + 1):
            words = F.split("phrase", " ")
            cuts = found[k].withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
            cuts = cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ")).withColumn("rest", F.array_join(F.slice(words, F.col("cut") + 1, F.lit(k)), " "))
            parts = None
            for j in range(1, k):
                df = found[j].select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
                df = df.where(F.col("f") >= least) if j == 1 else df
                parts = df if parts is None else parts.unionByName(df)
            cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")).hint("merge"), ["lang", "first"])
            cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")).hint("merge"), ["lang", "rest"])
            cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
            least_cut = F.min(F.struct("score", "cut", "a", "l", "r")).alias("m")
            one = cuts.groupBy("lang", "phrase").agg(least_cut).select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
            longer = None
            for j in range(k + 1, longest + 1):
                inner = F.explode(F.transform(F.sequence(F.lit(0), F.lit(j - k)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " "))).alias("phrase")
                df = found[j].select("lang", inner, F.col("a").alias("most"))
                longer = df if longer is None else longer.unionByName(df)
            if longer is not None:
                most = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
                one = one.join(most.hint("merge"), ["lang", "phrase"], "left").where(f"most IS NULL OR 100 * most < {LEAST_SHARE} * a").drop("most")
            ranked = one if ranked is None else ranked.unionByName(one)
        order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        salted = Window.partitionBy("lang", "salt").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        ranked = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
        return written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True, tidy=True)
