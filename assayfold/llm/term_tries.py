"""Source divergence audit on mergeable radix tries.

Every task counts its documents' terms in byte tries, one a language: a term's leaf has a counter for each source and one
for its documents. A trie is cut by prefix into segments (its leaves in byte order, each with the depth at which its path
leaves that of the leaf before it); segments of a prefix meet in one task and are merged into one trie again, whose
traversal in UTF-8 order streams the leaves that enough documents have. Divergences follow from the merged ranges in exact whole
numbers: sums over terms for pairs of sources, the best terms for each.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Kept, bounded_batches

#: Documents of a kept term; parts of a whole probability; terms listed of a source.
DOCUMENTS, WHOLE, LISTED = 3, 1_000_000_000, 200
#: Counters of a task's tries after which they are handed on; bytes of a prefix, and leaves of one that is cut deeper; leaves of a merging task.
LEAVES, DEPTH, HEAVY, SHARE = 1_000_000, 3, 1 << 20, 1 << 18
#: Bytes of text that are counted at a time.
TEXTS = 16 << 20
#: Counts (terms times sources) that are compared at a time, and in a task: each task sends back a row a pair.
AT_ONCE, COMPARED = 1 << 18, 1 << 21
#: What is no ASCII stays, letters of ASCII are lowered, and the rest, between terms, becomes spaces.
_letters = bytes(k if k >= 128 or 97 <= k <= 122 else 32 for k in bytes(range(256)).lower())
SEGMENT = "lang string, prefix binary, leaves long, sources array<string>, shared array<int>, edges array<binary>, docs array<long>, width array<int>, at array<int>, n array<long>"
RANGE = "lang string, prefix binary, terms array<string>, sources array<string>, totals array<long>, width array<int>, at array<int>, n array<long>"


class Radix:
    """A byte trie with joined edges; leaves are numbered in the order they come."""

    def __init__(self):
        self.edge, self.kids, self.leaf, self.leaves = [b""], [{}], [-1], 0

    def extend(self, terms: Iterable[bytes]) -> list[int]:
        """The numbers of the terms' leaves, which are made where there are none. In byte order, a term's path is taken up where
        it leaves that of the term before it."""
        edges, kids, leaf, out = self.edge, self.kids, self.leaf, []
        nodes, paths = [0], [b""]
        for term in terms:
            while not term.startswith(paths[-1]):
                nodes.pop()
                paths.pop()
            node, at, size = nodes[-1], len(paths[-1]), len(term)
            while at < size:
                here = kids[node]
                if here is None:
                    here = kids[node] = {}
                below = here.get(term[at])
                if below is None:
                    below = here[term[at]] = len(edges)
                    edges.append(term[at:])
                    kids.append(None)
                    leaf.append(-1)
                    at = size
                else:
                    edge = edges[below]
                    if not term.startswith(edge, at):  # the edge forks where it leaves the term
                        same = 1
                        while at + same < size and edge[same] == term[at + same]:
                            same += 1
                        fork = here[term[at]] = len(edges)
                        edges.append(edge[:same])
                        kids.append({edge[same]: below})
                        leaf.append(-1)
                        edges[below], below, edge = edge[same:], fork, edge[:same]
                    at += len(edge)
                    if at < size:
                        nodes.append(below)
                        paths.append(term[:at])
                node = below
            if leaf[node] < 0:
                leaf[node], self.leaves = self.leaves, self.leaves + 1
            out.append(leaf[node])
        return out

    def walk(self) -> Iterator[tuple[int, bytes, int]]:
        """(shared, term, leaf) in byte order; shared is the depth at which a term's path leaves that of the term before it."""
        todo, shared = [(0, b"")], 0
        while todo:
            node, above = todo.pop()
            if shared < 0:
                shared = len(above)
            path = above + self.edge[node]
            if self.leaf[node] >= 0:
                yield shared, path, self.leaf[node]
                shared = -1
            if kids := self.kids[node]:
                todo += [(kids[k], path) for k in sorted(kids, reverse=True)]


class Tally:
    """A trie with its leaves' counters: documents, and occurrences by source. Counters come in as arrays, and are added up
    when enough have come."""

    #: Counters after which those of one leaf and source are added up.
    LOOSE = 1 << 20

    def __init__(self):
        self.trie, self.known, self.places = Radix(), {}, {}
        self.docs = np.zeros(1024, np.int64)
        self.loose, self.size, self.held = [], 0, 0

    def leaves(self, terms: Collection[bytes]) -> np.ndarray:
        """The terms' leaves; a path is walked once, then its end is known."""
        known = self.known
        new = sorted(term for term in terms if term not in known)
        known.update(zip(new, self.trie.extend(new)))
        out = [known[term] for term in terms]
        if self.trie.leaves > len(self.docs):
            self.docs = np.concatenate([self.docs, np.zeros(self.trie.leaves + len(self.docs), np.int64)])
        return np.array(out, np.int64)

    def add(self, leaves: np.ndarray, sources: np.ndarray, n: np.ndarray) -> None:
        """Occurrences of leaves in sources (places given by `place`)."""
        self.loose.append((leaves, sources, n))
        self.size += len(n)
        if self.size - self.held > self.LOOSE:
            self.counters()

    def place(self, source: str) -> int:
        return self.places.setdefault(source, len(self.places))

    def counters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, source, occurrences), each leaf and source once."""
        if not self.loose:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        leaf, source, n = (np.concatenate([x[k] for x in self.loose]) for k in range(3))
        order = np.lexsort((source, leaf))
        leaf, source, n = leaf[order], source[order], n[order]
        first = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (source[1:] != source[:-1])])
        self.loose = [(leaf[first], source[first], np.add.reduceat(n, first))]
        self.size = self.held = len(first)
        return self.loose[0]

    def in_order(self, least: int = 0) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(shared, terms, documents, counters a leaf, source and occurrences by counter) in byte order, of the leaves with at
        least so many documents. Where leaves are left out, shared no longer tells from which."""
        found = list(self.trie.walk())
        leaves = np.array([x[2] for x in found], np.int64)
        stay = np.flatnonzero(self.docs[leaves] >= least)
        rank = np.full(self.trie.leaves, -1, np.int64)
        rank[leaves[stay]] = np.arange(len(stay))
        leaf, source, n = self.counters()
        at = rank[leaf]
        order = np.argsort(at, kind="stable")
        order = order[at[order] >= 0]
        width = np.bincount(at[order], minlength=len(stay))
        return [found[k][0] for k in stay], [found[k][1] for k in stay], self.docs[leaves[stay]], width, source[order], n[order]


def _types(schema: str) -> list[tuple[str, pa.DataType]]:
    known = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    known |= {f"array<{k}>": pa.list_(t) for k, t in known.items()}
    return [(name, known[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = _types(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], [name for name, _ in types])


def _cut(
    lang: str,
    names: list[str],
    shared: list[int],
    terms: list[bytes],
    docs: np.ndarray,
    width: np.ndarray,
    source: np.ndarray,
    n: np.ndarray,
    depth: int,
) -> Iterator[tuple]:
    """Segments of leaves in byte order, one for every prefix of `depth` bytes; a segment's first leaf has its whole term, and
    sources are those that the segment has."""
    starts = [k for k, t in enumerate(terms) if not k or shared[k] < depth and t[:depth] != terms[k - 1][:depth]]
    ends = np.concatenate([[0], np.cumsum(width)])
    for a, b in zip(starts, [*starts[1:], len(terms)]):
        lo, hi = ends[a], ends[b]
        used, at = np.unique(source[lo:hi], return_inverse=True)
        edges = [terms[a], *(t[s:] for t, s in zip(terms[a + 1 : b], shared[a + 1 : b]))]
        yield lang, terms[a][:depth], b - a, [names[k] for k in used], [0, *shared[a + 1 : b]], edges, docs[a:b], width[a:b], at, n[lo:hi]


def _terms(row: dict) -> list[bytes]:
    """A segment's terms again."""
    out, term = [], b""
    for same, edge in zip(row["shared"], row["edges"]):
        term = term[:same] + edge
        out.append(term)
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of segments; numbers as arrays."""
    for k in range(len(batch)):
        row = {name: batch.column(name)[k].as_py() for name in ("lang", "prefix", "sources", "shared", "edges")}
        yield row | {name: batch.column(name).slice(k, 1).flatten().to_numpy() for name in ("docs", "width", "at", "n")}


def _in_batches(rows: Iterator[tuple], schema: str, size: int = 512) -> Iterator[pa.RecordBatch]:
    own: list[tuple] = []
    for row in rows:
        own.append(row)
        if len(own) == size:
            yield _batch(own, schema)
            own = []
    if own:
        yield _batch(own, schema)


def _plant(tallies: dict[str, Tally], texts: list[bytes], groups: list[tuple[str, str]]) -> None:
    """Count texts of letters and spaces in the tries of their languages; groups are each text's (lang, source)."""
    split = pc.split_pattern(pa.array(texts, pa.binary()).cast(pa.string()), " ")
    found = split.flatten().dictionary_encode()
    term, words = found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.binary())
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    stay = pc.not_equal(words, b"").to_numpy(zero_copy_only=False)[term] if len(words) else np.zeros(0, bool)
    term, doc, size = term[stay], doc[stay], max(1, len(words))
    names = list(dict.fromkeys(groups))
    langs = list(dict.fromkeys(lang for lang, _ in names))
    group = np.array(_places(groups, names), np.int64)
    lang = np.array(_places([g for g, _ in groups], langs), np.int64)
    own, n = _distinct(group[doc] * size + term)
    once, _ = _distinct(doc * size + term)
    seen, docs = _distinct(lang[once // size] * size + once % size)
    leaf = np.zeros(size, np.int64)
    for k, name in enumerate(langs):
        tally = tallies.setdefault(name, Tally())
        mine = slice(*np.searchsorted(seen, [k * size, (k + 1) * size]))
        ids = seen[mine] % size
        leaf[ids] = leaves = tally.leaves(words.take(pa.array(ids)).to_pylist())
        tally.docs[leaves] += docs[mine]
        for g, (of, source) in enumerate(names):
            if of == name:
                its = slice(*np.searchsorted(own, [g * size, (g + 1) * size]))
                tally.add(leaf[own[its] % size], np.full(len(n[its]), tally.place(source), np.int64), n[its])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each occurs; keys are sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])


def _places(values: list, among: list) -> list[int]:
    place = {v: k for k, v in enumerate(among)}
    return [place[v] for v in values]


def _count(limit: int, depth: int):
    """Documents (text, lang, source) to segments. Every language of a task also has one without a prefix or leaves, that
    names the sources seen, those without terms too."""

    def handed(tallies: dict[str, Tally]) -> Iterator[tuple]:
        for lang, tally in tallies.items():
            names = list(tally.places)
            yield lang, b"", 0, names, [], [], [], [], [], []
            yield from _cut(lang, names, *tally.in_order(), depth)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tallies: dict[str, Tally] = {}
        texts, groups, size = [], [], 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(k) for k in range(3))):
                texts.append(text.as_buffer().to_pybytes().translate(_letters))
                groups.append((lang.as_py(), source.as_py()))
                size += len(texts[-1])
                if size > TEXTS:
                    _plant(tallies, texts, groups)
                    texts, groups, size = [], [], 0
                    if sum(tally.size for tally in tallies.values()) > limit:
                        for tally in tallies.values():
                            tally.counters()
                        if sum(tally.size for tally in tallies.values()) > limit:
                            yield from handed(tallies)
                            tallies.clear()
        if texts:
            _plant(tallies, texts, groups)
        yield from handed(tallies)

    return lambda batches: _in_batches(rows(batches), SEGMENT)


def _recut(depth: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in _rows(batch):
                yield from _cut(row["lang"], row["sources"], row["shared"], _terms(row), row["docs"], row["width"], row["at"], row["n"], depth)

    return lambda batches: _in_batches(rows(batches), SEGMENT)


def _merge(least: int):
    """Segments sorted by language and prefix to one range a prefix, with the terms of `least` documents or more."""

    def merged(lang: str, prefix: bytes, tally: Tally) -> tuple | None:
        _, terms, _, width, source, n = tally.in_order(least)
        if not terms:
            return None
        totals = np.zeros(len(tally.places), np.int64)
        np.add.at(totals, source, n)
        return lang, prefix, [t.decode() for t in terms], list(tally.places), totals, width, source, n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, tally = None, Tally()
        for batch in batches:
            for row in _rows(batch):  # a row at a time: a merged trie is there once, its segments are not
                if at is not None and at != (row["lang"], row["prefix"]):
                    yield merged(*at, tally)
                    tally = Tally()
                at = row["lang"], row["prefix"]
                leaves = tally.leaves(_terms(row))
                tally.docs[leaves] += row["docs"]
                mine = np.array([tally.place(source) for source in row["sources"]], np.int64)
                tally.add(np.repeat(leaves, row["width"]), mine[row["at"]], row["n"])
        if at is not None:
            yield merged(*at, tally)

    return lambda batches: _in_batches((r for r in rows(batches) if r), RANGE)


def probabilities(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + 1) / (total + terms)) in longs, by long division in base 1000."""
    over = np.asarray(total, np.int64) + terms
    out, rest = np.divmod(counts.astype(np.int64) + 1, over)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + digit
    return out + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), exact in longs as long as neither is above 3 * 10^9."""
    return (p - q) ** 2 // q


def _compare(listed: int):
    """Ranges with their language's sources and totals to the task's own sums for pairs of sources, and its best terms."""

    def table(rows: list[dict]) -> tuple[np.ndarray, list[str]]:
        """Occurrences by term and source of the language."""
        place = {s: k for k, s in enumerate(rows[0]["all"])}
        terms = [t for r in rows for t in r["terms"]]
        counts, first = np.zeros((len(terms), len(place)), np.int64), 0
        for r in rows:
            mine = np.array([place[s] for s in r["sources"]], np.int64)
            counts[first + np.repeat(np.arange(len(r["terms"])), r["width"]), mine[r["at"]]] = r["n"]
            first += len(r["terms"])
        return counts, terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, str, str], int] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

        def compare(rows: list[dict]) -> None:
            lang, names, v = rows[0]["lang"], rows[0]["all"], rows[0]["v"]
            counts, terms = table(rows)
            n = np.array(rows[0]["n_all"], np.int64)
            p = probabilities(counts, n, v)
            q = probabilities(counts.sum(1), int(n.sum()), v)
            for h, other in enumerate(names):
                for g, f in enumerate(divergences(p, p[:, h : h + 1]).sum(0).tolist()):
                    if g != h:
                        pairs[lang, names[g], other] = pairs.get((lang, names[g], other), 0) + f
            for g, name in enumerate(names):
                high = np.flatnonzero((counts[:, g] > 0) & (p[:, g] > q))
                f = divergences(p[high, g], q[high])
                if len(high) > listed:  # all that tie with the last stay
                    stay = f >= np.partition(f, len(f) - listed)[len(f) - listed]
                    high, f = high[stay], f[stay]
                own = best.get((lang, name), []) + [(-x, terms[k].encode()) for x, k in zip(f.tolist(), high.tolist())]
                best[lang, name] = sorted(own)[:listed]

        for batch in batches:
            own: list[dict] = []
            for row in batch.to_pylist():
                if own and (row["lang"] != own[0]["lang"] or sum(len(r["terms"]) for r in own) * len(own[0]["all"]) > AT_ONCE):
                    compare(own)
                    own = []
                own.append(row)
            if own:
                compare(own)
        rows = [(lang, g, "pair", h, f) for (lang, g, h), f in pairs.items()]
        rows += [(lang, g, "term", term.decode(), -f) for (lang, g), own in best.items() for f, term in own]
        yield _batch(rows, "lang string, source string, part string, item string, value long")

    return run


def audit(docs: DataFrame, least: int = DOCUMENTS, listed: int = LISTED, leaves: int = LEAVES, depth: int = DEPTH, heavy: int = HEAVY) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from the others, and its own terms.

    A row of docs is a document, whatever its doc_id; null text, lang and source count as ''. A language keeps the terms
    of `least` of its documents. With p the smoothed share of a term in a source, q that of another source (part `pair`)
    or of the language (part `term`), a term's divergence is floor((p - q)^2 / q). Pairs sum it over all kept terms, 0
    without any; part `term` lists the `listed` terms that lie highest above the language. Ranks go by value, then by
    item in byte order. A language with one source has no pairs, an empty table no rows; other columns are ignored.
    Prefixes with more than `heavy` leaves are cut deeper until none is, or a prefix is a term.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = Kept(spark, "tries")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    tries = kept.put(rows.mapInArrow(_count(leaves, depth), SEGMENT), "segments")
    groups = kept.put(tries.where("leaves = 0").select("lang", F.explode("sources").alias("source")).distinct(), "groups")
    segments = tries.where("leaves > 0")
    while True:
        sizes = segments.groupBy("lang", "prefix").agg(F.sum("leaves").alias("all"))
        large = sizes.where((F.col("all") > heavy) & (F.length("prefix") == depth))
        total, n_large = sizes.agg(F.sum("all"), F.count_if((F.col("all") > heavy) & (F.length("prefix") == depth))).first()
        if not n_large:
            break
        depth *= 2
        left = segments.join(large, ["lang", "prefix"], "left_anti")
        deeper = segments.join(large, ["lang", "prefix"], "left_semi").select(*segments.columns).mapInArrow(_recut(depth), SEGMENT)
        segments = kept.put(left.select(*segments.columns).unionByName(deeper), "segments")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // SHARE))
    sorted_ = segments.repartitionByRange(n, "lang", "prefix").sortWithinPartitions("lang", "prefix")
    ranges = kept.put(sorted_.mapInArrow(_merge(least), RANGE), "ranges")
    kept.drop("segments")
    terms = ranges.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    totals = ranges.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(
        F.sum("x.totals").alias("n")
    )
    known = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("s"))
    langs = kept.put(known.groupBy("lang").agg(F.array_sort(F.collect_list("s")).alias("s")).join(terms, "lang"), "langs")
    compared = langs.agg(F.sum(F.col("v") * F.size("s"))).first()[0] or 0
    # one row a language, salted: a language's ranges need not meet in one task where Spark does not broadcast the few rows
    salts = 64
    langs = langs.select(
        "lang", F.col("s.source").alias("all"), F.col("s.n").alias("n_all"), "v", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    dealt = ranges.withColumn("salt", F.pmod(F.xxhash64("prefix"), F.lit(salts)).cast("int")).join(langs, ["lang", "salt"])
    parts = dealt.select("lang", "terms", "sources", "width", "at", "n", "all", "n_all", "v").repartition(1 + compared // COMPARED)
    found = kept.put(parts.mapInArrow(_compare(listed), "lang string, source string, part string, item string, value long"), "found")
    kept.drop("ranges")
    kept.drop("langs")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # the contract asks for every pair of a language's sources, with terms or without
    every = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("part", F.lit("pair"))
    pairs = every.join(sums, ["lang", "source", "part", "item"], "left").fillna(0, ["value"])
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(*names).unionByName(best.select(*names))
