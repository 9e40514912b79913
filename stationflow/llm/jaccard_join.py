"""N-gram Jaccard join: a size-aware heavy-light self-join, exact at any threshold.

A document's set is its distinct n-word shingles (64-bit hashes); documents with equal sets are
one class from the start. Two sets link when their Jaccard similarity reaches the threshold t.

* Light sets, up to a boundary size, are matched by enumeration: for every pair of sizes the
  needed overlap o is fixed, so both sets emit all their o-subsets and share one exactly when
  they link.
* Heavy sets are matched through inverted lists: every set lists its first |s| - ceil(t|s|) + L
  shingles in one global order, and a linked pair shares at least L of them. Rare shingles come
  first in that order; the most frequent ones, counted over all documents, come last.
* The boundary is the largest size at which enumeration still emits no more keys than scanning
  would read list entries, from the sizes and list lengths of the data.

Only components are needed, so each list first compares its members with one leader, the member
that has the list's shingle earliest: edits make rare shingles, and these come first, so it has
the fewest edits. While lists still hold many pairs of different components, each compares its
members with another leader, of its largest component. Then only members of different components
are compared pairwise; a long list of one component costs nothing more. A pair is a candidate
only if the parity sketches of its sets allow it: their Hamming distance never exceeds the
symmetric difference, so no link is lost. Every candidate pair is verified on the whole sets.

A list of a shingle that is in ``HOT_LIST`` documents or more is dealt in parts. Texts are
shingled again for each pass (counts, names, lists, verification): the sets are larger than the texts.

Defined results: null texts and texts without words have an empty set and link with nothing;
documents with 1 to n - 1 words have their whole sequence as one shingle; rows that repeat are
equal sets; a null doc_id takes part and never names a component unless its class has no other
id; very long texts are read whole; an empty table gives no rows; extra columns are ignored. Sets are merged by a 96-bit
name and verified by 48 bits of each shingle's hash: of 10^11 sets two share a name with a chance of 10^-7, and
within a pair of sets of 1000 shingles a wrong match has one of 10^-9.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as graph
from .common import cut, map_arrow, row_slices, stored, text_buffers
from .components import components
from .words import WHITE, document_words, mix, shingle_hashes

#: Frequent shingles that are ordered last by their counts (bounds what is sent to the tasks).
FREQUENT = 65_536
#: Shingles that the counting pass aggregates before it emits counts, and list entries that a linked pair must share.
COUNTED, SHARED = 1 << 21, 3
#: Sizes beyond this are never enumerated; keeps the number of subsets of one set in the hundreds.
LIGHT_MOST = 24
#: 64-bit words of a set's parity sketch.
SKETCH = 8
#: Another round with leaders is worth its shuffles while lists hold more pairs of different components than this many an entry.
PAIRS_EACH = 16
#: Lists of shingles in this many documents or more are dealt in parts.
HOT_LIST, PARTS = 1 << 20, 64
#: Bits of the filter of documents whose sets are fetched for verification.
FILTER_BITS = 1 << 24


def ceil_share(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def needed(a: int, b: int, t: tuple[int, int]) -> int:
    """The least overlap at which sets of sizes a and b reach t = num / den."""
    return -(-t[0] * (a + b) // (t[0] + t[1]))


def partners(s: int, most: int, t: tuple[int, int]) -> list[int]:
    """Sizes up to ``most`` that can link with size s."""
    return [b for b in range(1, most + 1) if min(s, b) * t[1] >= max(s, b) * t[0]]


def subset_sizes(s: int, most: int, t: tuple[int, int]) -> list[int]:
    return sorted({o for b in partners(s, most, t) if (o := needed(s, b, t)) <= min(s, b)})


def choose_boundary(sizes: dict[int, int], list_length: float, t: tuple[int, int]) -> int:
    """The largest size up to which enumerating costs no more than scanning lists of that mean length."""
    best = 0
    for most in range(1, LIGHT_MOST + 1):
        keys = sum(n * sum(math.comb(s, o) for o in subset_sizes(s, most, t)) for s, n in sizes.items() if s <= most)
        read = sum(n * (s - ceil_share(s, *t) + SHARED) * list_length for s, n in sizes.items() if s <= most)
        if keys <= read:
            best = most
    return best


def document_sets(column: pa.Array, n: int):
    """Sorted distinct shingle hashes of each text of a column."""
    raw, offsets = text_buffers(column)
    for i, j in row_slices(offsets):
        words, first = document_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WHITE)
        hashes, of = shingle_hashes(words, first, n)
        at = np.searchsorted(of, np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(hashes[at[k] : at[k + 1]])


def digest(s: np.ndarray) -> bytes:
    """A 96-bit name of a set that depends on all its members: of 10^11 sets, two share one with a chance of 10^-7."""
    with np.errstate(over="ignore"):
        h = mix(s + mix(np.arange(len(s), dtype=np.uint64)))
        both, summed = np.bitwise_xor.reduce(h), h.sum(dtype=np.uint64)
        return mix(np.array([both + summed * np.uint64(3) + np.uint64(len(s)), summed ^ mix(both + np.uint64(len(s)))], np.uint64)).astype(">u8").tobytes()[:12]


def parity_sketch(s: np.ndarray) -> list[int]:
    """64 x ``SKETCH`` bits: the parity of the members that fall on each."""
    at = (mix(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingle, count) of the most frequent shingles of all documents, and the mean length of a list.

    Each task counts about ``COUNTED`` shingles together and passes on those it saw twice or more.
    """

    def run(batches):
        def emit(sets):
            keys, counts = np.unique(np.concatenate(sets), return_counts=True)
            twice = counts > 1
            total = np.append(keys[twice].view(np.int64), 0), np.append(counts[twice], -len(keys))  # a negative count carries the number of lists
            return pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1].astype(np.int64))], ["token", "n"])

        held, size = [], 0
        for b in batches:
            for s in document_sets(b.column(0), n):
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    parts = map_arrow(docs.select("text"), run, "token bigint, n bigint")
    counts = parts.groupBy("token", (F.col("n") < 0).alias("lists")).agg(F.sum("n").alias("n"))
    counts = cut(counts)
    sums = counts.agg(F.sum(F.when(F.col("lists"), -F.col("n"))).alias("lists"), F.sum(F.when(~F.col("lists"), F.col("n").cast("double") * F.col("n"))).alias("squares")).first()
    top = counts.where(~F.col("lists")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    lists = float(sums["lists"] or 1)
    return top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy(), (lists + float(sums["squares"] or 0)) / lists


def _entries(s: np.ndarray, boundary: int, t: tuple[int, int], frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place in the set's order) of every list that a set is in; subset keys have place -1."""
    n, keys = len(s), []
    if n <= boundary:
        salt = mix(s)
        for o in subset_sizes(n, boundary, t):
            chosen = np.array(list(combinations(range(n), o)))
            with np.errstate(over="ignore"):
                keys.append(mix(salt[chosen].sum(1, dtype=np.uint64) * np.uint64(2 * o + 1) + np.uint64(o)))
    n_light = sum(map(len, keys))
    if n > boundary or n * t[1] >= (boundary + 1) * t[0]:
        at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
        hot = frequent[at] == s if len(frequent) else np.zeros(n, bool)
        last = s[hot][np.argsort(rank[at[hot]], kind="stable")] if len(frequent) else s[:0]
        keys.append(np.concatenate([s[~hot], last])[: n - ceil_share(n, *t) + min(SHARED, ceil_share(n, *t))])
    whole = np.concatenate(keys) if keys else s[:0]
    return whole, np.concatenate([np.full(n_light, -1), np.arange(len(whole) - n_light)])


def pack_set(s: np.ndarray) -> bytes:
    """The upper 48 bits of each member, in order; enough within one pair of sets."""
    return np.ascontiguousarray((s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_set(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _pairs_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(d, members) of every class that occurs in ``pairs``: one document's set each.

    A fixed-size bitmap of the wanted documents drops the others where they are read; documents
    that pass it by chance are dropped by the joins, which both use one exchange of the sets. Where
    a quarter of the bitmap is set it would pass too many, so the texts are joined with the wanted
    rows before they are shingled.
    """
    wanted = pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct().join(classes, "d").select("d", "row")
    slot = F.pmod("row", F.lit(FILTER_BITS))
    words = wanted.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    full = int(np.bitwise_count(bitmap.view(np.uint64)).sum()) > FILTER_BITS // 4
    sent = docs.sparkSession.sparkContext.broadcast(np.full(1, ~np.uint64(0)) if full else bitmap.view(np.uint64))

    def run(batches):
        for b in batches:
            slots = b.column(1).to_numpy()
            hit = sent.value[0 if full else slots // 64] >> (slots % 64).astype(np.uint64) & np.uint64(1) == 1
            rows = np.flatnonzero(hit)
            if len(rows):
                sets = list(document_sets(b.column(0).take(pa.array(rows)), n))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([pack_set(s) for s in sets], pa.binary())], ["d", "members"])

    texts = docs.select("text", F.xxhash64("text").alias("row"))
    if full:
        texts = texts.join(wanted.select("row").distinct(), "row", "left_semi")
    fetched = map_arrow(texts.select("text", F.pmod("row", F.lit(FILTER_BITS)).alias("slot")), run, "d binary, members binary")
    return fetched.groupBy("d").agg(F.first("members").alias("members"))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    sets = _pairs_sets(docs, classes, pairs, n)
    if pairs.count() >= graph.HUB_LINKS:
        sets = stored(sets)  # one leader may be in most pairs: written, both sides are exchanges that Spark can split
    sides = pairs.join(sets.select(F.col("d").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("d").alias("b"), F.col("members").alias("y")), "b")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = unpack_set(x), unpack_set(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * t[1] >= (len(x) + len(y) - both) * t[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(map_arrow(sides.select("a", "b", "x", "y"), run, "a binary, b binary"))


def join_components(docs: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """doc_id, n_shingles, row (the text's hash) and component_id of every row."""
    docs = docs.select("doc_id", "text")
    frequent, count, list_length = frequent_shingles(docs, n)
    order = np.argsort(frequent)
    by_count = np.empty(len(frequent), np.int64)
    by_count[np.lexsort((frequent, count))] = np.arange(len(frequent))
    frequent, rank = frequent[order], by_count[order]
    hot = np.sort(frequent[count[order] >= HOT_LIST])

    sketch = [f"s{i}" for i in range(SKETCH)]

    def name(batches):
        for b in batches:
            sets = [(len(s), digest(s), *parity_sketch(s)) for s in document_sets(b.column(1), n)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), *(pa.array([x[i] for x in sets], pa.binary() if i == 1 else pa.int64()) for i in range(2 + SKETCH))], ["doc_id", "row", "n", "d", *sketch])

    def listed(boundary):
        def run(batches):
            for b in batches:
                known, keys, places, ds, sizes = set(), [], [], [], []
                for s in document_sets(b.column(0), n):
                    if len(s) and (d := digest(s)) not in known:
                        known.add(d)
                        key, place = _entries(s, boundary, t, frequent, rank)
                        keys.append(key)
                        places.append(place)
                        ds.append(d)
                        sizes.append(len(s))
                if keys:
                    of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                    key, part = np.concatenate(keys), np.array([1 + d[0] % PARTS for d in ds], np.int32)[of]
                    part[~np.isin(key, hot)] = 0
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part), pa.array(ds, pa.binary()).take(pa.array(of)), pa.array(np.array(sizes, np.int32)[of]), pa.array(np.concatenate(places).astype(np.int32))], ["key", "part", "d", "n", "place"])

        return run

    rows = cut(map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("row")), name, "doc_id bigint, row bigint, n bigint, d binary, " + ", ".join(f"{x} bigint" for x in sketch)))
    size_counts = {r["n"]: r["count"] for r in rows.where(F.col("n").between(1, LIGHT_MOST)).groupBy("n").count().collect()}
    boundary = choose_boundary(size_counts, list_length, t)
    # written once: it is joined several times, by leaders that may be in most pairs too
    classes = cut(rows.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), *[F.first(x).alias(x) for x in sketch]))
    entries = map_arrow(docs.select("text"), listed(boundary), "key bigint, part int, d binary, n int, place int")
    by_key = entries.repartition("key", "part")
    # two light sets share one subset of the needed size; other pairs share SHARED entries among the first n - overlap + SHARED of both
    sizes = "n_a", "n_b"
    overlap = f"CAST(-floor(-{t[0]}.0D * (n_a + n_b) / {t[0] + t[1]}) AS INT)"
    light = f"greatest(n_a, n_b) <= {boundary}"
    heavy = " AND ".join(f"place_{x} >= 0 AND place_{x} < n_{x} - {overlap} + least({SHARED}, {overlap})" for x in "ab")
    alike = " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in sketch) + f" <= n_a + n_b - 2 * {overlap}"
    fits = f"(least(n_a, n_b) * {t[1]}L >= greatest(n_a, n_b) * {t[0]}L AND ({light} AND place_a < 0 AND place_b < 0 OR NOT ({light}) AND {heavy}))"
    candidate = F.expr(f"c_a != c_b AND {fits}")
    one = F.struct("d", "n", "place")  # the same columns on both sides, so the exchange is used twice
    ends = by_key.groupBy("key", "part").agg(F.min(one).alias("x"), F.max(one).alias("y"), F.count("*").alias("listed")).where("part > 0 OR x.d != y.d")
    # a list of two is only of use if its two sets can be a pair
    several = ends.select("key", "part", "listed", *[F.col(f"{c}.{k}").alias(f"{k}_{x}") for c, x in (("x", "a"), ("y", "b")) for k in ("n", "place")]).where(f"part > 0 OR listed > 2 OR {fits}").select("key", "part")
    shared = stored(by_key.join(several, ["key", "part"]).select("key", "d", "n", "place").distinct())
    enough = F.expr(f"keys >= IF({light}, 1, least({SHARED}, {overlap}))")
    fields = ["d", "n", "place", "c"]
    sides = {x: classes.select(F.col("d").alias(f"d_{x}"), *[F.col(k).alias(f"{k}_{x}") for k in sketch]) for x in "ab"}

    def compared(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of both sides' entries that can link, by ``key``, sizes, places and components."""
        left = left.select(F.col("key").alias("key_a"), *[F.col(k).alias(f"{k}_a") for k in fields], *[F.col(k).alias(f"{k}_a") for k in sketch if k in left.columns])
        right = right.select(F.col("key").alias("key_b"), *[F.col(k).alias(f"{k}_b") for k in fields], *[F.col(k).alias(f"{k}_b") for k in sketch if k in right.columns])
        return left.join(right, (F.col("key_a") == F.col("key_b")) & candidate)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("d_a", "d_b").alias("a"), F.greatest("d_a", "d_b").alias("b")).distinct()

    def with_leaders(lists: DataFrame, leaders: DataFrame) -> DataFrame:
        met = compared(lists, leaders).select("d_a", "d_b", "n_a", "n_b").distinct()
        return ordered(met.join(sides["a"], "d_a").join(sides["b"], "d_b").where(alike))

    # edits make rare shingles, which come first: the member that has a list's shingle earliest is nearest to the common text
    central = F.struct(F.col("place").alias("early"), F.xxhash64("key", "d").alias("m"), *fields)
    lists = shared.withColumn("c", F.col("d"))
    leaders = lists.groupBy("key").agg(F.min(central).alias("low")).select("key", *[F.col(f"low.{k}").alias(k) for k in fields])
    # a written side is an exchange of its own, so that Spark can split a hot list in the join
    tested = cut(with_leaders(lists, cut(leaders) if len(hot) else leaders))
    links = _verified(docs, classes, tested, n, t)
    n_links, turn = links.count(), 0
    # of two sets the smaller one (or an equal one) has a shared key among these
    first = F.expr(f"place < n - CAST(-floor(-{2 * t[0]}.0D * n / {t[0] + t[1]}) AS INT) + {SHARED}")
    while True:
        found = components(links)
        lists = shared.join(found.withColumnRenamed("node", "d"), "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component")
        # of each list that has several components: the pairs across them and a member of the largest
        other = F.struct(F.xxhash64(F.lit(turn), "key", "d").alias("m"), *fields)
        by_part = lists.groupBy("key", "c").agg(F.count("*").alias("size"), F.count_if(first).alias("firsts"), F.min(other).alias("low"))
        sums = F.count("*").alias("parts"), F.sum("size").alias("entries"), (F.sum("size").cast("double") * F.sum("firsts") - F.sum(F.col("size").cast("double") * F.col("firsts"))).alias("pairs")
        mixed = cut(by_part.groupBy("key").agg(*sums, F.max(F.struct("size", "low")).alias("top")).where("parts > 1"))
        open_ = cut(lists.join(mixed.select("key"), "key", "left_semi"))
        left_over = mixed.agg(F.sum("pairs").alias("pairs"), F.sum("entries").alias("entries")).first()
        if (left_over["pairs"] or 0) <= PAIRS_EACH * (left_over["entries"] or 0):
            break
        more = cut(with_leaders(open_, mixed.select("key", *[F.col(f"top.low.{k}").alias(k) for k in fields])).join(tested, ["a", "b"], "left_anti"))
        new = _verified(docs, classes, more, n, t)
        tested, turn, before = tested.union(more), turn + 1, n_links
        links = links.union(new)
        n_links += new.count()
        if n_links == before:
            break
    # what is still apart is compared pairwise
    sketched = open_.join(classes.select("d", *sketch), "d")
    met = compared(sketched.where(first), sketched).where(F.expr("(n_a < n_b OR n_a = n_b AND d_a < d_b) AND " + alike))
    across = met.groupBy("d_a", "d_b", *sizes).agg(F.count("*").alias("keys")).where(enough)
    rest = cut(ordered(across).join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        found = components(links.union(_verified(docs, classes, rest, n, t)))
    whole = classes.join(found.withColumnRenamed("node", "d"), "d", "left").select("d", "least", F.coalesce("component", "d").alias("c"), F.col("component").isNotNull().alias("linked"))
    least = cut(whole.where("linked").groupBy("c").agg(F.min("least").alias("component_id")))
    by_class = whole.join(least, "c", "left").select("d", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(by_class, "d", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "row", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns.

    Rows that repeat an id and a text stay once; documents without words all stay. A null id is
    the smallest of a component that has no other id; such rows stay unless their texts are equal.
    """
    found = join_components(docs, n, t)
    first = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row")).distinct()
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["kept_id"]) & (F.xxhash64(docs["text"]) == first["kept_row"]), "left_semi")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])
