"""Operator 6: mixing overlapping sources to target weights by min-cost flow.

Sources overlap where they hold the same text. Rows are summed by membership pattern, the set of
sources that hold their text, and by their own source. A min-cost flow routes each pattern's words
to the quotas of its sources: a row counts for its own source, and the k-th reading of a pattern's
distinct words costs more than the one before, which is convex, so a source fills its quota with
texts of its own before it takes what another source has taken already, and nothing is repeated
while fresh words can fill the quota. The flow sees patterns and sources, not documents.

Selection is by a seeded hash, whose upper half is that of the text. The flow of a pattern is laid
out in hash order, one source's stretch behind another's; only the hashes at which stretches end are
looked for, by histograms of BITS bits that narrow down LEVELS times. Taking documents is then a
map over rows: no row is sorted or gathered, however many share a text.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import n_words
from kinloom.shared import written

#: A hash has BITS * LEVELS bits; a histogram that reaches the driver has 2^BITS counts for each end of a stretch.
BITS, LEVELS = 5, 12
HASHES = 1 << BITS * LEVELS
#: The bound on pairs of a pattern and one of its sources, which the driver routes. All of them are routed;
#: a mix that has more is refused, as to route only some would give other results.
MAX_PAIRS = 1 << 17


def fill_targets(sizes: dict, weights: dict, total: float, cap: float = 3.0) -> dict:
    """Share `total` by weight; a target stops at cap times its size, its excess is shared again."""
    target, open_, left = {}, sorted(sizes, key=lambda s: (s is None, s or "")), float(total)
    while open_:
        unit = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / unit for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = cap * float(sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def cycled_weights(sources, cycle=(5, 2, 1)) -> dict:
    """Weights by rank in code point order, null last."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


@dataclass
class Flow:
    """Maximum flow by shortest augmenting paths (Dinic), to which capacity may be added and more sent."""

    ends: list = field(default_factory=list)
    room: list = field(default_factory=list)
    out: dict = field(default_factory=lambda: defaultdict(list))

    def arc(self, a, b, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.ends))
            self.ends.append(y)
            self.room.append(c)
        return len(self.ends) - 2

    def used(self, i: int) -> int:
        return self.room[i ^ 1]

    def _depths(self, start, end) -> dict:
        depth, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for i in self.out[x]:
                y = self.ends[i]
                if self.room[i] > 0 and y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        return depth

    def send(self, start, end) -> None:
        while end in (depth := self._depths(start, end)):
            at, path, x = defaultdict(int), [], start
            while True:
                if x == end:
                    least = min(self.room[i] for i in path)
                    for i in path:
                        self.room[i] -= least
                        self.room[i ^ 1] += least
                    full = next(k for k, i in enumerate(path) if not self.room[i])
                    x = self.ends[path[full] ^ 1]
                    del path[full:]
                arcs = self.out[x]
                while at[x] < len(arcs) and not (self.room[arcs[at[x]]] > 0 and depth.get(self.ends[arcs[at[x]]]) == depth[x] + 1):
                    at[x] += 1
                if at[x] < len(arcs):
                    path.append(arcs[at[x]])
                    x = self.ends[path[-1]]
                elif path:
                    x = self.ends[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def readings(distinct: int, most: int) -> list[int]:
    """Widths of the steps of a pattern's cost, up to `most` words: the first three readings of its
    distinct words are a step each, then steps double."""
    widths, k = [], 0
    while most > 0:
        widths.append(min(most, distinct * (1 if k < 3 else 1 << (k - 2))))
        most -= widths[-1]
        k += 1
    return widths


def route(words: dict, distinct: dict, quotas: dict, repeats: int = 3) -> dict:
    """{(pattern, source): words to take}, from the words of rows by (pattern, source) and the words of
    distinct texts by pattern. As much as quotas allow, none of a (pattern, source) above `repeats`
    times its words, at the least cost."""
    net, links, total = Flow(), {}, defaultdict(int)
    for (p, s), n in words.items():
        links[p, s] = net.arc(("p", p), ("s", s), repeats * n)
        total[p] += repeats * n
    for s, q in quotas.items():
        net.arc(("s", s), "end", round(q))
    steps = {p: readings(distinct[p], most) for p, most in total.items()}
    # Only the arcs into patterns cost, a step as much as its number, and what patterns can send is a
    # polymatroid: to send all that goes through at one cost before the next is of least cost in all.
    for step in range(max(map(len, steps.values()), default=0)):
        for p, widths in steps.items():
            if step < len(widths):
                net.arc("start", ("p", p), widths[step])
        net.send("start", "end")
    return {k: net.used(i) for k, i in links.items()}


def stretches(routed: dict, words: dict) -> dict:
    """{(pattern, source): [(from, to), ...]}: positions in the words of its rows in hash order, one for
    each time that they are gone through. A pattern's next source begins where the last one ended."""
    out, ended = {}, defaultdict(float)
    for (p, s), taken in sorted(routed.items(), key=str):
        size, parts = words[p, s], []
        at = round(ended[p] % 1 * size)
        end = at + taken
        while at < end:
            stop = min(end, (at // size + 1) * size)
            parts.append((at % size, at % size + stop - at))
            at = stop
        ended[p] = end / size
        out[p, s] = parts
    return out


def _key(source: Column) -> Column:
    """A source as text, null apart from every string."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _hash(seed: int, id_: Column, text: Column) -> Column:
    half = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *c), 64 - BITS * LEVELS // 2)
    return F.shiftleft(half(text), BITS * LEVELS // 2).bitwiseOR(half(id_, text))


def _cuts(slim: DataFrame, wanted: set) -> dict:
    """{(pattern, s, position): hash}: rows with a smaller hash lie before the position, to within half
    of the rows of one hash. Every level sums the rows of 2^BITS ranges within the range in which the
    position fell before; the sums are what reaches the driver."""
    spark = slim.sparkSession
    at = {w: (0, 0) for w in wanted}  # range so far, words before it
    for level in range(LEVELS):
        below = BITS * (LEVELS - level - 1)
        if not level:
            near = slim
        elif level == 1:
            places = sorted({(p, s, r) for (p, s, _), (r, _) in at.items()})
            near = slim.join(F.broadcast(spark.createDataFrame(places, "pattern string, s string, r long")), ["pattern", "s"])  # two for each stretch
            near = written(near.where(F.shiftright("h", below + BITS) == F.col("r")).select("pattern", "s", "h", "size"), "near-cuts")
        sums: dict = defaultdict(dict)
        for r in near.groupBy("pattern", "s", F.shiftright("h", below).alias("r")).agg(F.sum("size").alias("n")).collect():
            sums[r["pattern"], r["s"], r["r"] >> BITS][r["r"]] = r["n"]
        for (p, s, position), (r, before) in at.items():
            for k, n in sorted(sums[p, s, r].items()):
                if before + n > position:
                    break
                before += n
            at[p, s, position] = (k, before)
        if level:
            keep = sorted({(p, s, r) for (p, s, _), (r, _) in at.items()})
            last = {(p, s, position): k + (2 * (position - before) > sums[p, s, k >> BITS][k]) for (p, s, position), (k, before) in at.items()}
            near = near.join(F.broadcast(spark.createDataFrame(keep, "pattern string, s string, r long")), ["pattern", "s"]).where(F.shiftright("h", below) == F.col("r")).drop("r")
    return last if wanted else {}


def _plan(docs: DataFrame, source: Column, quotas, repeats: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slim rows; g and pattern of texts that two or more sources hold; a row for each pattern and source
    with the stretches of hashes that are taken)."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    slim = written(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), source.cast("string").alias("source"), n_words(text).alias("size"), _hash(seed, F.col(f"`{id_col}`"), text).alias("h"), F.xxhash64(text).alias("g"))
        .withColumn("s", _key(F.col("source"))),
        "mix",
    )
    held = slim.groupBy("g").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("s")).alias("all"))
    held = written(held.select("g", "size", F.to_json("all").alias("pattern"), (F.size("all") > 1).alias("shared")), "held")
    shared = held.where("shared").select("g", "pattern")
    slim = written(_with_pattern(slim, shared, F.to_json(F.array("s"))), "patterns")
    pairs = slim.groupBy("pattern", "s").agg(F.sum("size").alias("n"), F.first("source").alias("source"))
    sums = {(r["pattern"], r["s"]): r for r in pairs.limit(MAX_PAIRS + 1).collect()}
    if len(sums) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of a membership pattern and a source; group sources before mixing them")
    distinct = {r["pattern"]: r["n"] for r in held.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}  # at most as many
    name = {s: r["source"] for (_, s), r in sums.items()}
    sizes: dict = defaultdict(int)
    for (_, s), r in sums.items():
        sizes[name[s]] += r["n"]
    targets = (quotas or (lambda own: fill_targets(own, cycled_weights(own), sum(own.values()), repeats)))(dict(sizes))
    words = {k: r["n"] for k, r in sums.items() if r["n"]}
    parts = stretches(route(words, distinct, {s: targets.get(name[s], 0) for s in name}, repeats), words)
    cuts = _cuts(slim, {(p, s, x) for (p, s), ab in parts.items() for y in ab for x in y if 0 < x < words[p, s]})
    rows = []
    for p, s in sums:
        taken = [(cuts[p, s, a] if a else 0, cuts[p, s, b] if b < words[p, s] else HASHES) for a, b in parts.get((p, s), [])]
        rows.append((p, s, sizes[name[s]], float(targets.get(name[s], 0)), taken))
    return slim, shared, spark.createDataFrame(rows, "pattern string, s string, source_size long, target double, parts array<struct<lo bigint, hi bigint>>")


def _with_pattern(rows: DataFrame, shared: DataFrame, own: Column) -> DataFrame:
    """rows (g, s, ...) with their pattern; moved only where sources share texts."""
    if shared.isEmpty():
        return rows.withColumn("pattern", own)
    return rows.join(shared.hint("merge"), "g", "left").withColumn("pattern", F.coalesce("pattern", own))


def _copies() -> Column:
    return F.size(F.filter("parts", lambda x: (x["lo"] <= F.col("h")) & (F.col("h") < x["hi"])))


def mix(docs: DataFrame, source: Column, quotas=None, repeats: int = 3, seed: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often it is taken) for every row.

    source: the source of a row (null is a source like others). quotas: function from {source: words}
    to {source: target}; default: weights 5, 2, 1 in code point order, sharing all words, none above
    `repeats` times its source. A null or empty text has size 0. Rows equal in id and text share
    their fate. Each stretch of the flow ends within half a document of its quota, and a source has
    as many stretches as it has patterns. An empty table gives an empty result. Other columns of docs
    are not read. What reaches the driver has a row for each pattern and source of it, MAX_PAIRS at
    most; more are an error.
    """
    slim, _, plan = _plan(docs, source, quotas, repeats, seed, id_col, text_col)
    return slim.join(F.broadcast(plan), ["pattern", "s"]).select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 13) -> DataFrame:
    """The rows of documents as the mix takes them: left out, once, or repeated.

    Sources are the column `source`. The columns of docs are returned as they are. Where no text is
    shared between sources, a document's fate follows from its source and hash, so no text is moved.
    """
    _, shared, plan = _plan(docs, F.col("source"), None, 3, seed, "doc_id", "text")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _hash(seed, F.col("doc_id"), F.col("text")).alias("h"), F.xxhash64("text").alias("g"), _key(F.col("source").cast("string")).alias("s")
    )
    rows = _with_pattern(rows, shared, F.to_json(F.array("s")))
    taken = rows.join(F.broadcast(plan), ["pattern", "s"]).select("doc", _copies().alias("n"))  # MAX_PAIRS rows
    return taken.select("doc", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))))).select("doc.*")
