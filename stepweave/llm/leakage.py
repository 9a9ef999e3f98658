"""Documents that hold passages of held-out items.

A prefix-filtered set join. Items and documents become words of a normal form (signs of
scripts without spaces singly), their runs of SHINGLE words shingles. Every document is read
once; of its shingles those that items have travel on, with the words around them, and all
of them are counted. Items of the same words are one text. The shingles of a text are
ordered by rarity, over all documents and texts; a document that holds LEAST of it shares at
least `need` of its shingles, so one of its prefix, all but the need - 1 most frequent ones:
documents and texts are joined on prefixes. Of the pairs those are verified whose document
has enough of the words that only this item has, as many shingles of items as needed (length) and as many of this text within a window of
its size (position). Verification aligns: equal shingles become runs, runs go on over single
changed words, and the best PIECES pieces that don't overlap in the item, wherever in the
document and in whatever order, must hold LEAST of it.

A filter of bits, made of the items' shingles, keeps other shingles from travelling. It is
sent to every executor if the items have up to FILTERED shingles, else none is used and the
join alone decides: the result is the same.

Defined results: null or blank documents and items match nothing; an item shorter than
SHINGLE words matches nothing; sentences with which several items begin are no part of them;
repeated documents and items are found each by its own id.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.cluster import cut, spread

#: Words of a shingle; share of an item that must be found, in at most PIECES pieces.
SHINGLE, LEAST, PIECES = 3, 1 / 3, 2
#: A word is an item's own if at most so many different items have it; a piece needs such words, and most of those in its reach must match.
OWN_ITEMS, OWN_WORDS, OWN_SHARE = 1, 2, 0.6
#: Items that begin with the same whole sentence: from so many on it is a stock opening.
STOCK_ITEMS = 3
#: A shingle that an item has more often begins only runs that no other goes on to.
REPEATED = 4
#: Words between two runs of a piece, and signs of a script without spaces; words around shingles that travel with them.
GAP, GAP_SIGNS, AROUND = 2, 4, 8
#: Most shingles of items for which a filter is made (8 MB of bits).
FILTERED = 4_000_000

_SINGLE = "぀-ヿ㐀-鿿豈-﫿฀-๿"
_WORD = re.compile(rf"[{_SINGLE}]|(?:(?![{_SINGLE}])[^\W_])+(?:[̀-ͯऀ-ःऺ-ॏ]|(?:(?![{_SINGLE}])[^\W_]))*")
_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrtbf]|\\(?=[\"'\\/])")
_IN_NUMBER = re.compile(r"(?<=\d)[.,:'’  ](?=\d)")
_SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+\s*")


def words(text: str) -> list[str]:
    """Words of the normal form: no case, signs, escapes, separators in numbers."""
    if "\\" in text:
        text = _ESCAPES.sub(lambda m: chr(int(m[1], 16)) if m[1] else " " if m[0] != "\\" else "", text)
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if "&" in text:
        text = html.unescape(text)
    text = unicodedata.normalize("NFKC", text).casefold()
    text = re.sub("[­​-‏⁠﻿]", "", text)
    return _WORD.findall(_IN_NUMBER.sub("", text))


def word_hashes(ws: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each word; known keeps those of the words before."""
    if len(known) > 1_000_000:
        known.clear()
    out = np.empty(len(ws), np.uint64)
    for i, w in enumerate(ws):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of SHINGLE words, from the words' hashes."""
    n = len(h) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


class Filter:
    """A set of 64-bit hashes as bits: it holds all of them, and few others (about one in 400)."""

    def __init__(self, hashes: np.ndarray | None, made: tuple[int, np.ndarray] | None = None):
        if made is not None:
            self.size, self.bits = made
            return
        self.size = max(16, int(len(hashes) * 16 - 1).bit_length()) if len(hashes) else 16
        self.bits = np.zeros(1 << (self.size - 3), np.uint8)
        for at in self._places(hashes.astype(np.int64)):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        h = hashes.view(np.uint64)
        mask = np.uint64((1 << self.size) - 1)
        for shift in (0, 17, 34):
            yield (h >> np.uint64(shift)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.size) & mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def openings(text: str) -> list[str]:
    """The beginnings of a text that end with one of its first four sentences."""
    leading = [m.group() for m in _SENTENCE.finditer(text)][:4]
    return ["".join(leading[: k + 1]) for k in range(len(leading))]


def needed(ws: list[str]) -> int:
    """Different shingles that any LEAST of an item, in PIECES pieces with a changed word in each, leaves whole."""
    lengths = sorted(map(len, ws), reverse=True)
    enough, total = 0, 0
    while total < LEAST * sum(lengths):
        total += lengths[enough]
        enough += 1
    n = len(ws) - SHINGLE + 1
    repeated = n - len({tuple(ws[k : k + SHINGLE]) for k in range(n)})
    return max(1, min(enough, int(LEAST * len(ws))) - (SHINGLE - 1) * PIECES - SHINGLE * PIECES - repeated)


def texts_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, key of every item with enough words; key, words, own (words), need, n (shingles) of every different text)."""
    wanted = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    texts = cut(wanted.select("text").distinct())

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, x.strip(), len(x)) for t in b.text for x in openings(t) if len(x) < len(t)]
            yield pd.DataFrame(rows, columns=["text", "opening", "size"]).astype({"size": "int64"})

    begun = texts.mapInPandas(lead, "text string, opening string, size bigint").where("opening <> ''")
    stock = begun.groupBy("opening").agg(F.count("*").alias("n")).where(F.col("n") >= STOCK_ITEMS).select("opening")
    skipped = begun.join(stock, "opening").groupBy("text").agg(F.max("size").alias("size"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, size in zip(b.text, b["size"]):
                w = words(t[0 if pd.isna(size) else int(size) :])
                if len(w) >= SHINGLE:
                    rows.append((t, xxhash.xxh3_128_hexdigest(" ".join(w)), w, needed(w), len({tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)})))
            yield pd.DataFrame(rows, columns=["text", "key", "words", "need", "n"])

    known = cut(texts.join(skipped, "text", "left").select("text", "size").mapInPandas(read, "text string, key string, words array<string>, need int, n int"))
    distinct = known.groupBy("key").agg(F.first("words").alias("words"), F.first("need").alias("need"), F.first("n").alias("n"))
    having = distinct.select("key", F.explode(F.array_distinct("words")).alias("word"))
    own = having.join(having.groupBy("word").agg(F.count("*").alias("in_texts")).where((F.col("in_texts") <= OWN_ITEMS) & (F.length("word") > 1)), "word").groupBy("key").agg(F.collect_list("word").alias("own"))
    # an item without own words is told from the others by none: all its words count
    index = distinct.join(own, "key", "left").select("key", "words", "need", "n", F.coalesce("own", F.array_distinct("words")).alias("own"))
    return wanted.join(known.select("text", "key"), "text").select("item_id", "key"), cut(index)


def shingles_of(index: DataFrame) -> DataFrame:
    """key, need, n, shingle: the different shingles of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            for key, ws, need, n in zip(b.key, b["words"], b.need, b.n):
                yield pd.DataFrame({"key": key, "need": need, "n": n, "shingle": np.unique(shingle_hashes(word_hashes(list(ws), known)))})

    return index.select("key", "words", "need", "n").mapInPandas(run, "key string, need int, n int, shingle bigint")


def own_hashes(index: DataFrame) -> DataFrame:
    """key, own (hash of one of its own words), least (how many of them a document must have)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            yield pd.DataFrame({"key": b.key, "own": word_hashes(list(b.word), known).view(np.int64), "least": b.least})

    return index.select("key", F.explode("own").alias("word"), F.least(F.lit(OWN_WORDS), F.size("own")).alias("least")).mapInPandas(run, "key string, own bigint, least int")


def filters(index: DataFrame, shingles: DataFrame, most: int) -> tuple[Filter | None, Filter | None, int]:
    """Filters of the items' shingles and own words, if there are at most so many, and the fewest own words that any item needs."""

    first = index.agg(F.min(F.least(F.lit(OWN_WORDS), F.size("own"))).alias("least"), F.sum(F.size("own")).alias("own"), F.sum("n").alias("n")).first()
    if not first.n or first.n > most or first.own > most:
        return None, None, first.least or 1
    # at most `most` numbers
    both = [np.array(df.distinct().toPandas().iloc[:, 0], np.int64) for df in (shingles.select("shingle"), own_hashes(index).select("own"))]
    return Filter(both[0]), Filter(both[1]), first.least


_HITS = "kind string, doc_id bigint, doc_key bigint, owns array<bigint>, shingles array<bigint>, at array<int>, starts array<int>, parts array<string>, shingle bigint, n bigint"
#: Words that are looked up at a time.
CHUNK = 100_000


def hits(documents: DataFrame, of_items: Filter | None, of_own: Filter | None, least: int) -> DataFrame:
    """One pass over the documents. kind 'd': documents that items' shingles and own words stand in, these, the places of the shingles, and the words around them; kind 'n': how many documents have a shingle, part by part."""
    spark = documents.sparkSession
    # plain arrays: a class of ours could not be read where the package is not installed
    sent = spark.sparkContext.broadcast([f and (f.size, f.bits) for f in (of_items, of_own)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_items, of_own = (made and Filter(None, made) for made in sent.value)
        part, number = TaskContext.get().partitionId(), 0
        known: dict[str, int] = {}
        counts: Counter = Counter()
        columns = [c.split()[0] for c in _HITS.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype(dict.fromkeys(["doc_id", "doc_key", "shingle", "n"], "Int64"))

        def counted() -> pd.DataFrame:
            out = frame([("n", *[None] * 7, s, n) for s, n in counts.items()])
            counts.clear()
            return out

        def looked_up(held: list[tuple[int | None, int, list[str]]]) -> list[tuple]:
            """The rows of some documents, whose words are looked up together."""
            rows = []
            h = word_hashes([w for _, _, ws in held for w in ws], known)
            s = shingle_hashes(h)
            ends = np.cumsum([len(ws) for _, _, ws in held])
            of = np.searchsorted(ends, np.arange(len(s)), side="right")
            # a shingle ends in the document in which it begins
            inside = ends[of] - np.arange(len(s)) >= SHINGLE if len(s) else np.zeros(0, bool)
            at = np.flatnonzero(inside & of_items.holds(s) if of_items else inside)
            own_at = np.flatnonzero(of_own.holds(h.view(np.int64))) if of_own else np.arange(len(h))
            own_in = np.searchsorted(ends, own_at, side="right")
            for d in np.unique(of[at]):
                first = ends[d] - len(held[d][2])
                x, y = np.searchsorted(at, [first, ends[d]])
                here = at[x:y]
                counts.update(np.unique(s[here]).tolist())
                x, y = np.searchsorted(own_in, [d, d + 1])
                owns = np.unique(h[own_at[x:y]].view(np.int64))
                if len(owns) < least:
                    continue
                doc_id, number, ws = held[d]
                # parts: shingles with AROUND words on either side, joined where they meet
                breaks = np.flatnonzero(np.diff(here) > 2 * AROUND + SHINGLE)
                starts = np.maximum(0, here[np.concatenate([[0], breaks + 1])] - first - AROUND).tolist()
                stops = np.minimum(len(ws), here[np.concatenate([breaks, [len(here) - 1]])] - first + SHINGLE + AROUND).tolist()
                rows.append(("d", doc_id, (part << 40) + number, owns.tolist(), s[here].tolist(), (here - first).tolist(), starts, [" ".join(ws[i:j]) for i, j in zip(starts, stops)], None, None))
            return rows

        held: list[tuple[int | None, int, list[str]]] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.doc_id, b.text):
                number += 1
                ws = words(text)
                if len(ws) >= SHINGLE:
                    held.append((doc_id, number, ws))
                    size += len(ws)
                if size >= CHUNK:
                    if rows := looked_up(held):
                        yield frame(rows)
                    held, size = [], 0
            if len(counts) > 200_000:
                yield counted()
        if held and (rows := looked_up(held)):
            yield frame(rows)
        if counts:
            yield counted()

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return cut(spread(texts).mapInPandas(run, _HITS))


def _onward(item: list[str], doc: list[str], k: int, p: int) -> list[tuple[int, int, int]]:
    """Equal runs (k, p, length) that follow from k and p on, each over a gap of changed words after the one before."""
    out = []
    while True:
        best = None
        for total in range(1, 2 * GAP_SIGNS + 1):
            for gi in range(max(0, total - GAP_SIGNS), min(GAP_SIGNS, total) + 1):
                gd = total - gi
                if k + gi >= len(item) or p + gd >= len(doc) or item[k + gi] != doc[p + gd]:
                    continue
                if max(gi, gd) > GAP and not all(len(x) == 1 for x in item[k : k + gi] + doc[p : p + gd]):
                    continue
                n = 1
                while k + gi + n < len(item) and p + gd + n < len(doc) and item[k + gi + n] == doc[p + gd + n]:
                    n += 1
                # one word alone follows only one changed word, and a sign nothing
                if n > 1 and (n > 2 or len(item[k + gi]) > 1) or gi == gd == 1 and len(item[k + gi]) > 1:
                    best = max(best or (0, 0, 0, 0), (n, -total, gi, gd))
            if best:
                break
        if not best:
            return out
        n, _, gi, gd = best
        out.append((k + gi, p + gd, n))
        k, p = k + gi + n, p + gd + n


def runs(item: list[str], places: dict[int, list[int]], shingles: list[int], at: list[int], doc: list[str], start: int) -> list[tuple[int, int, int]]:
    """Equal runs (k in the item, p in the part, length) of at least SHINGLE words: shingles of one diagonal that follow each other.

    A shingle that the item has more than REPEATED times goes on with the runs that reach
    it; only where none does it begins one, at its first place in the item.
    """
    latest: dict[int, list[int]] = {}
    active: list[list[int]] = []  # runs that the shingle before belongs to
    out: list[list[int]] = []
    before = -2

    def begin(k: int, p: int) -> list[int] | None:
        if doc[p : p + SHINGLE] != item[k : k + SHINGLE]:
            return None
        run = latest[p - k] = [k, p, SHINGLE]
        out.append(run)
        return run

    for s, p in zip(shingles, at):
        p -= start
        active, before = active if p == before + 1 else [], p
        ks = places.get(s, ())
        here: list[list[int]] = []
        if len(ks) > REPEATED:
            for run in active:
                k = run[0] + p - run[1]
                if k + SHINGLE <= len(item) and item[k + SHINGLE - 1] == doc[p + SHINGLE - 1]:
                    run[2] += 1
                    here.append(run)
            ks = () if here else ks[:1]
        for k in ks:
            run = latest.get(p - k)
            if run and run[1] + run[2] >= p + SHINGLE - 1:
                run[2] = p + SHINGLE - run[1]
            else:
                run = begin(k, p)
            if run:
                here.append(run)
        active = here
    return [tuple(r) for r in out]


def pieces(item: list[str], own: set[str], places: dict[int, list[int]], shingles: list[int], at: list[int], starts: list[int], parts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(first word, word after the last, words, letters, own words) of every part of the item that stands in the document as running text."""
    found: set[tuple[int, int, int, int, int]] = set()
    backwards = item[::-1]
    for n, (start, part) in enumerate(zip(starts, parts)):
        begin = bisect_right(at, start - 1)
        end = bisect_right(at, starts[n + 1] - 1) if n + 1 < len(starts) else len(at)
        doc = part.split(" ")
        reverse = doc[::-1]
        done: set[tuple[int, int]] = set()
        for k, p, size in sorted(runs(item, places, shingles[begin:end], at[begin:end], doc, start), key=lambda r: (-r[2], r[1])):
            if (k, p) in done:
                continue
            back = [(len(item) - x - z, len(doc) - y - z, z) for x, y, z in _onward(backwards, reverse, len(item) - k, len(doc) - p)]
            blocks = [*back[::-1], (k, p, size), *_onward(item, doc, k + size, p + size)]
            done.update((x + i, y + i) for x, y, z in blocks for i in range(z))
            matched = [x + i for x, _, z in blocks for i in range(z)]
            first, last = matched[0], matched[-1] + 1
            hit, reach = sum(item[x] in own for x in matched), sum(item[x] in own for x in range(first, last))
            if len(matched) > SHINGLE and len(matched) >= 0.75 * (last - first) and hit and hit >= OWN_SHARE * reach:
                found.add((first, last, len(matched), sum(len(item[x]) for x in matched), hit))
    return sorted(found)


def coverage(item: list[str], own: set[str], found: list[tuple[int, int, int, int, int]]) -> float:
    """Share of the item's words, or of its letters if that is more, that its best one or two pieces that don't overlap hold."""
    best = 0.0
    for value, whole in ((2, len(item)), (3, sum(map(len, item)))):
        by_end = sorted(found, key=lambda x: x[1])
        ends = [x[1] for x in by_end]
        most: list[int] = []
        for x in by_end:
            most.append(max(x[value], most[-1] if most else 0))
        for x in found:
            before = bisect_right(ends, x[0])
            if before:
                best = max(best, (x[value] + most[before - 1]) / whole)
            elif x[4] >= min(OWN_WORDS, len(own)):
                best = max(best, x[value] / whole)
    return best


def _near(places: dict[int, list[int]], shingles: list[int], at: list[int], need: int, length: int) -> bool:
    """Whether a window of the item's length holds the item's shingles that the larger of PIECES pieces must have."""
    here = [p for s, p in zip(shingles, at) if s in places]
    most = -(-need // PIECES)
    return any(here[i + most - 1] - here[i] < 2 * length for i in range(len(here) - most + 1))


def leaks(documents: DataFrame, items: DataFrame, filtered: int = FILTERED) -> DataFrame:
    """doc_id, item_id, coverage."""
    ids, index = texts_of(items)
    ids = cut(ids)
    shingles = cut(shingles_of(index))
    there = hits(documents, *filters(index, shingles, filtered))
    in_documents = there.where("kind = 'n'").groupBy("shingle").agg(F.sum("n").alias("n_documents"))
    in_texts = shingles.groupBy("shingle").agg(F.count("*").alias("n_texts"))
    ranked = shingles.join(in_texts, "shingle").join(in_documents, "shingle", "left").withColumn("often", F.col("n_texts") + F.coalesce("n_documents", F.lit(0)))
    # a window holds the shingles of one text
    prefix = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("often", "shingle"))).where("rank <= n - need + 1").select("key", "need", "shingle")
    docs = there.where("kind = 'd'").drop("kind", "shingle", "n")
    # the item's own words, which a piece must hold
    owners = own_hashes(index)
    owned = docs.select("doc_key", F.explode("owns").alias("own")).join(owners, "own").groupBy("doc_key", "key").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("doc_key", "key")
    met = docs.select("doc_key", F.size(F.array_distinct("shingles")).alias("m"), F.explode(F.array_distinct("shingles")).alias("shingle")).join(prefix, "shingle").where("m >= need").select("doc_key", "key").distinct().join(owned, ["doc_key", "key"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            rows = []
            for doc_id, doc_key, key, ws, own, need, found, at, starts, parts in zip(b.doc_id, b.doc_key, b.key, b["words"], b.own, b.need, b.shingles, b["at"], b.starts, b.parts):
                ws, own, found, at = list(ws), set(own), [int(x) for x in found], [int(x) for x in at]
                places: dict[int, list[int]] = {}
                for k, s in enumerate(shingle_hashes(word_hashes(ws, known)).tolist()):
                    places.setdefault(s, []).append(k)
                if _near(places, found, at, need, len(ws)):
                    share = coverage(ws, own, pieces(ws, own, places, found, at, [int(x) for x in starts], list(parts)))
                    if share >= LEAST:
                        rows.append((doc_id, doc_key, key, share))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_key", "key", "coverage"]).astype({"coverage": float, "doc_id": "Int64"})

    pairs = docs.join(met, "doc_key").join(index, "key").select("doc_id", "doc_key", "key", "words", "own", "need", "shingles", "at", "starts", "parts")
    sure = pairs.mapInPandas(verify, "doc_id bigint, doc_key bigint, key string, coverage double")
    return sure.join(ids, "key").select("doc_id", "item_id", "coverage")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that give it away and the largest coverage."""
    return leaks(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("coverage").alias("most_coverage"))
