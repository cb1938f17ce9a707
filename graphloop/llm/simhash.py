"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints within two differing bits differ in at most two of them, so they
share at least six: the guaranteed minimum. A posting of one positional byte would hold a 256th of the corpus, so postings
are made selective by taking five positional bytes at a time. ``CHOICES`` are eleven sets of five positions of which any two
bytes leave one untouched, so a pair that reaches the minimum meets in at least one posting. There the positional bytes that
two fingerprints share are tallied (five or more), pairs under the minimum dropped, and the rest verified bit by bit.

A posting with more than ``CROWDED`` entries is not tallied but refined: its entries are dealt again by each of its three
other positional bytes. Of these a pair that reaches the minimum shares one, so it meets again; only two bytes are free
then, so a refined posting holds at most 65,536 distinct fingerprints whatever the corpus, and is tallied block by block.

Two bits reach copies that differ in case, spacing or a word of a long text. A text with a few words edited differs in some
seven bits of 64, and no count of shared bytes is guaranteed there. ``near_duplicates`` therefore takes a ``similarity`` as
well, for callers who want texts linked by the Jaccard similarity of their five-word shingles (``near_copies``). That search
is exact: a prefix-filter join. With the shingles of all texts in one order, two texts of that similarity share a shingle
among the first of both, however the rest differs; every pair that meets so, and whose sizes and places allow the
similarity, is verified on the whole shingle sets, except where both are in one component already, which a further link
can't change. Rounds with the least and the greatest member of each posting come first, so that large groups are one
component before the pairs that are left are made; these rounds save work and decide nothing.

Only distinct fingerprints are indexed, each standing for all documents that have it. Defined cases: a text that is null,
empty or without words has fingerprint zero, linked like any other; fewer than three words are one shingle; a null
identifier keeps its fingerprint and gets the component of its class; repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloop.llm.common import materialise, prepare, release
from graphloop.llm.components import components

SHINGLE, SEED, MAX_BITS, POSITIONS = 3, 42, 2, 8
#: Hashes counted at once, the posting size above which a posting is refined, and entries tallied against each other at once.
CHUNK, CROWDED, BLOCK = 1 << 15, 2048, 512
#: For ``near_copies``: words of a shingle; of how many texts one has its shingles counted for the order, and the most
#: shingles that it tells apart; rounds with leaders. All but the first are a matter of speed alone.
WIDE, COUNTED, TOLD, ROUNDS = 5, 3, 500_000, 2
#: Bits, as a power of two, of the map that tells shingles of one text only from the others (8 MB, whatever the corpus), and
#: the parts of a set's histogram.
MAP_BITS, PARTS = 26, 256
#: The positions that are left out, three at a time: every two positions are together in one of these.
LEFT_OUT = [(0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5), (7, 0, 1), (7, 2, 3), (7, 4, 5), (7, 6, 0)]
CHOICES = [tuple(p for p in range(POSITIONS) if p not in out) for out in LEFT_OUT]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def _majority(words: list[bytes]) -> int:
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = _hashes(words[at : at + CHUNK + SHINGLE - 1] if n > 1 else words, SHINGLE)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """64 bits; each is 1 if set in over half the shingles' hashes."""
    return _majority(_words(text))


def fingerprints(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of ``ident`` and fp, the fingerprint as a signed 64-bit number."""
    prepare(df.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return df.select(F.col(ident), fp(F.coalesce(F.col(text), F.lit(""))).alias("fp"))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of the runs of ``WIDE`` words, made from one hash a word; sorted. Of no words: none."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(WIDE, len(w))
    n = len(w) - size + 1
    h = w[:n]
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def prefix_length(n: int, similarity: float) -> int:
    """How many of the first of ``n`` shingles two texts of that similarity can't all differ in."""
    return n - max(1, math.ceil(similarity * n - 1e-6)) + 1


def sketches(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows of ``ident`` and fp, and of the set of five-word shingles: digest and size (0: no words)."""
    prepare(df.sparkSession)

    @F.pandas_udf("fp long, digest long, size int")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = _words(t)
                wide = shingle_set(words)
                rows.append((*np.array([_majority(words), _digest(wide)], np.uint64).view(np.int64).tolist(), len(wide)))
            yield pd.DataFrame(rows, columns=["fp", "digest", "size"])

    return df.select(F.col(ident), sketch(F.coalesce(F.col(text), F.lit(""))).alias("_s")).select(ident, "_s.*")


def _digest(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes())


def _sets(texts: DataFrame, row, fields: str, only=None) -> DataFrame:
    """``row(digest, set)`` gives columns for each text (columns _h and _t); fields: their names and types.

    only: a broadcast map of bits; texts whose bit of _h isn't set are passed over.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = range(batch.num_rows) if only is None else np.nonzero(_set_bits(only.value, batch.column(0).to_numpy().view(np.uint64)))[0].tolist()
            held, size = [], 0
            for k in wanted:
                wide = shingle_set(_words(batch.column(1)[k].as_py()))
                held.append(row(np.uint64(_digest(wide)).astype(np.int64), wide))
                size += len(wide)
                if size > 1 << 15:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return texts.select("_h", "_t").mapInArrow(made, fields)


def _set_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit in a ``_bitmap`` is set."""
    at = keys >> np.uint64(64 - MAP_BITS)
    return bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For the order of shingles alone: the frequent ones of a fixed share of the texts, sorted, with their counts; at most
    ``TOLD``. A share, and not a number, so that what is frequent doesn't depend on the size of the corpus."""
    counted = texts.filter(F.pmod(F.xxhash64("_h"), F.lit(COUNTED)) == 0)
    each = _sets(counted, lambda _, wide: pa.RecordBatch.from_arrays([pa.array(wide.view(np.int64))], ["key"]), "key long")
    counts = materialise(each.groupBy("key").count().filter("count > 3"), "counts")
    least, left = 4, TOLD
    for r in sorted(counts.groupBy(F.least("count", F.lit(100_000)).alias("c")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["c"]):
        left -= r["k"]
        if left < 0:
            least = r["c"] + 1
            break
    found = counts.filter(F.col("count") >= least).toArrow()
    release(counts)
    keys, times = found["key"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order]


def histogram(wide: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of ``PARTS`` parts of all hashes, as bytes; 255 stands for that or more."""
    return np.minimum(np.bincount((wide >> np.uint64(56)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _at_least(similarity: float, shared: float, both: int) -> bool:
    return shared >= similarity * (both - shared) - 1e-9


def _joined(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) of digests with these columns of both, _<column>_a and _<column>_b."""
    one, two = (sets.select(F.col("digest").alias(f"_{k}"), *[F.col(c).alias(f"_{c}_{k}") for c in columns]) for k in "ab")
    return pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))


def _allowed(pairs: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose histograms allow that similarity: two sets share no more in any part than the lesser has there."""

    @F.pandas_udf("boolean")
    def allowed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right, n, m in batches:
            x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, PARTS) for v in (left, right))
            least = np.minimum(x, y)
            bound = np.where((least == 255).any(1), np.minimum(n, m), least.sum(1, dtype=np.int64))
            yield pd.Series([_at_least(similarity, s, b) for s, b in zip(bound.tolist(), (n + m).tolist(), strict=True)], dtype=bool)

    return _joined(pairs, parts, "parts", "size").filter(allowed("_parts_a", "_parts_b", "_size_a", "_size_b")).select("a", "b").distinct()


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose whole shingle sets (digest, wide) have at least that Jaccard similarity."""

    @F.pandas_udf("boolean")
    def reached(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                out.append(_at_least(similarity, len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)))
            yield pd.Series(out, dtype=bool)

    return _joined(pairs, sets, "wide").filter(reached("_wide_a", "_wide_b")).select("a", "b").distinct()


def _bitmap(keys: DataFrame) -> np.ndarray:
    """2^``MAP_BITS`` bits, as words of 64; those of the keys' first bits are set."""
    at = F.shiftrightunsigned("key", 64 - MAP_BITS)
    words = keys.select(F.shiftrightunsigned(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def _possible(one: str, two: str, similarity: float) -> Column:
    """Whether sizes and places of a shared shingle allow that similarity; true for the first that a pair of it shares."""
    n, m, i, j = F.col(f"{one}.size"), F.col(f"{two}.size"), F.col(f"{one}.place"), F.col(f"{two}.place")
    return F.least(n - i, m - j) * (1 + similarity) >= (n + m) * similarity - 1e-6


def near_copies(df: DataFrame, sketched: DataFrame, similarity: float, text: str = "text", ident: str = "doc_id") -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (fa, fb) between fingerprints, which join the same fingerprints as all pairs of that similarity.

    sketched: ``sketches`` of ``df``. A shingle set is told by its digest, and read from the row of its least identifier;
    rows without an identifier or words take no part. The second list has the tables to release when the first is used.
    """
    own = sketched.filter(F.col(ident).isNotNull() & (F.col("size") > 0))
    chosen = materialise(own.groupBy("digest").agg(F.min(ident).alias("_id"), F.min("fp").alias("f")).select("digest", F.xxhash64("_id").alias("_h"), "f"), "chosen")
    of = chosen.select(F.col("digest").alias("_d"), "f")
    # One set of shingles may have several fingerprints.
    found = [own.select("digest", "fp").distinct().join(of, F.col("digest") == F.col("_d")).select(F.col("fp").alias("fa"), F.col("f").alias("fb"))]
    # Texts are never shuffled: they are read where they lie, once for each table that is made of them.
    texts = df.filter(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(ident)).alias("_h"), F.col(text).alias("_t"))
    common, times = _common(texts)
    send = df.sparkSession.sparkContext.broadcast

    def first(wide: np.ndarray) -> np.ndarray:
        often = np.zeros(len(wide), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, wide), len(common) - 1)
            often = np.where(common[at] == wide, times[at], 0)
        return wide[np.lexsort((wide, often))][: prefix_length(len(wide), similarity)]

    # Most shingles are in one text only. They are told by a count of shingles alone and, of fixed size, a map of those that
    # aren't, which keeps the wider rows of postings few. Copies and what the map lets pass wrongly go with the second count.
    counted = _sets(texts, lambda _, wide: pa.RecordBatch.from_arrays([pa.array(first(wide).view(np.int64))], ["key"]), "key long")
    seen = send(_bitmap(counted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")))

    def posted(digest: np.int64, wide: np.ndarray) -> pa.RecordBatch:
        keys = first(wide)
        place = np.nonzero(_set_bits(seen.value, keys))[0]
        n = len(place)
        return pa.RecordBatch.from_arrays([pa.array(keys[place].view(np.int64)), pa.array(np.full(n, digest)), pa.array(np.full(n, len(wide), np.int32)), pa.array(place.astype(np.int32))], ["key", "digest", "size", "place"])

    postings = materialise(_sets(texts, posted, "key long, digest long, size int, place int").distinct(), "postings")
    seen.destroy()
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("_key"))
    left = materialise(postings.join(shared, F.col("key") == F.col("_key"), "left_semi").withColumn("group", F.col("digest")), "buckets")
    release(postings)

    def sets_of(digests: DataFrame, row, fields: str, label: str) -> DataFrame:
        """Sets of these digests (column _d), and a few more, read from the row of each one's least identifier."""
        rows = digests.distinct().join(chosen, F.col("_d") == F.col("digest")).select(F.col("_h").alias("key"))
        only = send(_bitmap(rows))
        out = materialise(_sets(texts, row, fields, only).dropDuplicates(["digest"]), label)
        only.destroy()
        return out

    histograms = lambda digest, wide: pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([histogram(wide)], pa.binary()), pa.array([len(wide)], pa.int32())], ["digest", "parts", "size"])
    wholes = lambda digest, wide: pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([wide.tobytes()], pa.binary())], ["digest", "wide"])
    parts = sets_of(left.select(F.col("digest").alias("_d")), histograms, "digest long, parts binary, size int", "histograms")
    member = F.struct("group", "digest", "size", "place")
    links, used = None, [chosen]
    for k in range(ROUNDS + 1):
        if left.isEmpty():
            break
        if k < ROUNDS:
            # The least place has the fewest shingles of its own before, so it is the nearest to what a bucket's texts are made of.
            least, other = F.struct("place", "digest"), F.struct(F.xxhash64("digest", F.lit(k)), "digest")
            leaders = left.groupBy("key").agg(F.min_by(member, least).alias("lo"), F.min_by(member, other).alias("hi")).withColumnRenamed("key", "_key")
            led = left.select("key", member.alias("y")).join(leaders, F.col("key") == F.col("_key")).select("y", F.explode(F.array("lo", "hi")).alias("x"))
        else:
            x = left.select(F.col("key").alias("_key"), member.alias("x"))
            led = left.select("key", member.alias("y")).join(x, (F.col("key") == F.col("_key")) & (F.col("x.group") < F.col("y.group")) & _possible("x", "y", similarity)).select("x", "y")
        met = led.filter((F.col("x.group") != F.col("y.group")) & _possible("x", "y", similarity))
        pairs = materialise(met.select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")).distinct(), "pairs")
        few = materialise(_allowed(pairs, parts, similarity), "allowed")
        release(pairs)
        sets = sets_of(few.select(F.explode(F.array("a", "b")).alias("_d")), wholes, "digest long, wide binary", "shingles")
        linked = materialise(_alike(few, sets, similarity), "links")
        release(few)
        release(sets)
        used.append(linked)
        two = of.select(F.col("_d").alias("_e"), F.col("f").alias("fb"))
        found.append(linked.join(of, F.col("a") == F.col("_d")).join(two, F.col("b") == F.col("_e")).select(F.col("f").alias("fa"), "fb"))
        if k == ROUNDS:
            break
        links = linked if links is None else links.union(linked)
        grouped = components(links)
        used.append(grouped)
        moved = left.drop("group").join(grouped, F.col("digest") == F.col("node"), "left").select("key", "digest", "size", "place", F.coalesce("component", "digest").alias("group"))
        moved = materialise(moved, "moved")
        mixed = moved.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select(F.col("key").alias("_key"))
        # A leader has met its whole bucket, and needs to meet nobody there again.
        done = leaders.select(F.col("_key").alias("_led"), F.col("lo.digest").alias("_lo"), F.col("hi.digest").alias("_hi"))
        rest = moved.join(mixed, F.col("key") == F.col("_key"), "left_semi").join(done, F.col("key") == F.col("_led"))
        rest = rest.filter(~F.col("digest").isin(F.col("_lo"), F.col("_hi"))).select(*moved.columns)
        before, left = left, materialise(rest, "buckets")
        release(before)
        release(moved)
    release(parts)
    used.append(left)
    return found, used


def _tally(entries: np.ndarray) -> Iterator[np.ndarray]:
    """Links (a, b), a < b, of one posting. entries: distinct fingerprints, sorted."""
    for i in range(0, len(entries), BLOCK):
        left = entries[i : i + BLOCK]
        for j in range(i, len(entries), BLOCK):
            x = left[:, None] ^ entries[None, j : j + BLOCK]
            shared = (x.view(np.uint8).reshape(*x.shape, POSITIONS) == 0).sum(-1, dtype=np.uint8)  # positional bytes in common
            a, b = np.nonzero((shared >= POSITIONS - MAX_BITS) & (np.bitwise_count(x) <= MAX_BITS))
            ordered = a + i < b + j
            yield np.stack([left[a[ordered]], entries[j + b[ordered]]], 1)


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (mask >> 63 << 64)


def _postings(rows: DataFrame, keys: list[tuple[int, ...]], crowded: int | None) -> DataFrame:
    """Rows (a, b, k) from rows (fp, k): links (k null), and the entries of postings over ``crowded`` (a; b null).

    keys: the positions that each k stands for. Postings are runs of a sorted stream, of which at most ``crowded`` entries
    (65,536 without) are held at a time.
    """
    masks = F.array(*[F.lit(_mask(p)) for p in keys])
    keyed = rows.select("k", F.col("fp").bitwiseAND(F.get(masks, F.col("k").cast("int"))).alias("bytes"), "fp")
    ordered = keyed.repartition("k", "bytes").sortWithinPartitions("k", "bytes", "fp")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(a: np.ndarray, b: np.ndarray | None, k: int | None) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(n, pa.int8()) if k is None else pa.array(np.full(n, k, np.int8))], ["a", "b", "k"])

        held: list[np.ndarray] = []
        now, size, over = None, 0, False

        def ended() -> Iterator[np.ndarray]:
            if size > 1 and not over:
                yield from _tally(np.unique(np.concatenate(held).view(np.uint64)))

        found: list[np.ndarray] = []
        for own in batches:
            k, key, fp = (own.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if not len(k):
                continue
            starts = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1]))[0] + 1, [len(k)]])
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if (k[s], key[s]) != now:
                    found += ended()
                    held, now, size, over = [], (k[s], key[s]), 0, False
                size += e - s
                held.append(fp[s:e])
                if crowded is not None and size > crowded:
                    over = True
                    yield batch(np.concatenate(held), None, int(k[s]))
                    held = []
            if found:
                both = np.concatenate(found).view(np.int64)
                found = []
                yield batch(both[:, 0], both[:, 1], None)
        found += ended()
        if found:
            both = np.concatenate(found).view(np.int64)
            yield batch(both[:, 0], both[:, 1], None)

    return ordered.mapInArrow(stream, "a long, b long, k tinyint")


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b) with a < b as unsigned numbers: all pairs of distinct fingerprints (column fp) within ``MAX_BITS`` bits.

    The table that it writes, named by ``_scratch_path``, is for ``release``.
    """
    spark = prepare(distinct.sparkSession)
    # Each row becomes eleven, so the rows are dealt evenly first instead of over the few tasks that their own size asks for.
    dealt = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = F.explode(F.array(*[F.lit(k).cast("tinyint") for k in range(len(CHOICES))])).alias("k")
    first = materialise(_postings(dealt.select("fp", places), CHOICES, crowded), "tallied")
    refined = [(*chosen, p) for chosen, out in zip(CHOICES, LEFT_OUT, strict=True) for p in out]
    again = first.filter("b is null").select(F.col("a").alias("fp"), F.explode(F.array(*[(F.col("k") * 3 + i).cast("tinyint") for i in range(3)])).alias("k")).distinct()
    pairs = first.filter("b is not null").select("a", "b").union(_postings(again, refined, None).select("a", "b")).distinct()
    out = materialise(pairs, "pairs")
    release(first)
    return out


def near_duplicates(df: DataFrame, text: str = "text", ident: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """Rows of ``ident``, fingerprint (16 hexadecimal digits) and component_id, the least identifier that links reach.

    Fingerprints link at ``MAX_BITS`` bits or fewer; with ``similarity``, texts of that similarity link as well. The rows are
    a table in the shared folder, for ``release``; all other tables are deleted here.
    """
    fps = materialise(fingerprints(df, text, ident) if similarity is None else sketches(df, text, ident), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min(ident).alias("least")), "classes")
    used = [fps, classes, links(classes.select("fp"))]
    pairs = used[-1]
    if similarity is not None:
        more, scratch = near_copies(df, fps, similarity, text, ident)
        used += scratch
        for own in more:
            pairs = pairs.union(own.filter("fa <> fb"))
    # Links between classes are told by the classes' least identifiers; a class of null identifiers alone takes part by none.
    of = classes.filter("least is not null")
    named = pairs.join(of.select(F.col("fp").alias("a"), F.col("least").alias("la")), "a").join(of.select(F.col("fp").alias("b"), F.col("least").alias("lb")), "b")
    moved = components(named, "la", "lb")
    used.append(moved)
    label = classes.join(moved, F.col("least") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("component_id"))
    whole = fps.join(label, F.col("fp") == F.col("_fp"), "left").select(ident, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    out = materialise(whole, "components")
    for x in used:
        release(x)
    return out
