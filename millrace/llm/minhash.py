"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its word shingles; its signature has ``K`` coordinates, the least
value of each of ``K`` hash functions over the set. Documents with one set share a
representative. Representatives are posted under every coordinate-value pair that more than
one of them has. Two sets with similarity s agree in each coordinate with probability s, so
pairs are wanted that collide at least ``T`` times; ``T`` is set so low that a pair at the
threshold falls short with a probability of about 1 in 100,000.

*Prefix*: with a document's pairs in order of rising frequency, two documents that collide
T times share one among the first K - T + 1 of each, so only those are posted. Pairs that
nobody else has fill most prefixes and need no posting, and a frequent passage comes last.

*Skip*: what is asked is who is linked to whom, not all pairs. First every posting meets its
list's most central document, the one whose coordinates are most frequent, and in long lists
some others. After these links' components are known, lists inside one component
are skipped; in the others only documents outside the list's largest component meet those of
other components. So a group of n near copies costs about n comparisons and not n squared,
and no pair of different components goes untested.

*Bound*: every document also has an odd sketch: each shingle flips one of ``ODD`` bits. Two
sketches differ in at most as many bits as the sets differ in shingles, so pairs whose
sketches differ in more than the threshold allows are not built; no link is lost by it.

Collisions are counted on the full signatures; pairs of T and more are confirmed on the full
shingle sets (64-bit hashes of the shingles).

Results for odd input: a null or wordless text has an empty set and links with nothing; a
text with fewer words than a shingle has is one shingle; a null id counts as a vertex of its
own kind: it is linked with nothing and stays its own component (null); repeated rows are
copies of one another; where one doc_id names several texts, each row has its own text's
size and component; an empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import each, map_texts
from .common import columns_of, connected_components, documents, drop, row_of, sized, written

#: Coordinates, and the probability with which a pair at the threshold may miss its collisions.
K, MISS = 24, 1e-5
#: Partners of one document that are compared in one place.
PARTNERS = 1024
#: Postings of a list from which some more documents, by a hash, are met first beside its most central one.
LONG_LIST, MORE_PIVOTS = 32, 5
#: Bits of the odd sketch, a multiple of 64.
ODD = 512
_MASK = (1 << 64) - 1


def needed(percent: int) -> int:
    """The collisions asked of a pair: as many as one at the threshold falls short of with a
    probability of ``MISS`` at most. At least one: below 39 percent that alone is missed more
    often, with (1 - percent / 100) ** K."""
    p, below = percent / 100, 0.0
    for t in range(K + 1):
        below += comb(K, t) * p**t * (1 - p) ** (K - t)
        if below > MISS:
            return max(1, t)
    return K


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the hash functions, from a fixed seed."""
    rng = np.random.default_rng(20)
    return rng.integers(0, _MASK, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, _MASK, n, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.k = words
        self.weight = np.array([pow(0x9E3779B97F4A7C15 | 1, 2 * i + 1, 1 << 64) for i in range(words)], dtype=np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        # bytes.lower() and bytes.split() know A-Z and x20 x09-x0D only
        found = text.encode("utf-8", "replace").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        k = self.k
        if len(h) < k:  # the whole sequence; the length keeps it apart from longer ones
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
        n = len(h) - k + 1
        s = np.zeros(n, np.uint64)
        for i in range(k):
            s += _mix(h[i : i + n] + self.weight[i]) * self.weight[i]
        return np.unique(_mix(s))


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, set_id, sig, odd``: size and 128-bit digest of the set, K coordinates, odd sketch."""

    def setup():
        shingles = Shingler(words)
        mul, add = _constants(K)

        def call(text: str) -> tuple:
            s = shingles(text)
            if not len(s):
                return 0, None, None, None
            low = np.full(K, _MASK, np.uint64)
            for at in range(0, len(s), 4096):
                low = np.minimum(low, ((s[at : at + 4096, None] ^ add) * mul).min(axis=0))
            odd = np.packbits(np.bincount((s & np.uint64(ODD - 1)).view(np.int64), minlength=ODD).astype(np.uint8) & 1)
            return len(s), _digest(s), low.view(np.int64).tolist(), odd.view(np.int64).tolist()

        return each(call)

    return map_texts(_texts(docs), None, "n long, set_id binary, sig array<long>, odd array<long>", setup=setup)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _collisions(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _close(na: str, nb: str, oa: str, ob: str, percent: int) -> Column:
    """Whether sets of these sizes and odd sketches can reach the threshold."""
    na, nb = F.col(na), F.col(nb)
    apart = sum((F.bit_count(F.col(oa)[i].bitwiseXOR(F.col(ob)[i])) for i in range(ODD // 64)), F.lit(0))
    return (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)) & (F.lit(100 + percent) * apart <= F.lit(100 - percent) * (na + nb))


def postings(reps: DataFrame, t: int) -> DataFrame:
    """``key, id, n, odd, weight``: the prefix of each representative's coordinate-value pairs by
    rising frequency, without those nobody shares. ``key`` is a hash of coordinate and value:
    two pairs with one key would only add candidates. ``weight`` sums the logarithms of the
    frequencies of its pairs: in a group of copies the least changed one has the most."""
    tokens = reps.select("id", F.posexplode("sig").alias("c", "v")).select("id", F.xxhash64("c", "v").alias("key"))
    # a table of its own: right above an aggregation AQE could not split a value that very many share
    shared = written(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "minhash-shared")
    known = tokens.join(shared, "key")
    ordered = known.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"), F.sum(F.log("df")).alias("weight"))
    room = F.lit(K - t + 1) - (F.lit(K) - F.size("keys"))
    listed = ordered.where(room > 0).join(reps.select("id", "n", "odd"), "id")
    return listed.select("id", "n", "odd", "weight", F.explode(F.slice("keys", 1, room)).alias("k")).select("k.key", "id", "n", "odd", "weight")


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, t: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that collide t times and whose full sets reach the threshold."""
    sig_a = reps.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    sig_b = reps.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    near = pairs.join(sig_a, "a").join(sig_b, "b").where(_collisions("sa", "sb") >= t)
    near = written(near.select("a", "b", "na", "nb"), "minhash-near")
    # the end with more pairs is the hub: its set goes once to each block of its partners, and
    # only the other end's goes with the pair
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg")).where("deg > 1")
    ends = written(ends, "minhash-degrees")
    deg = lambda side: ends.select(F.col("id").alias(side), F.col("deg").alias(f"d{side}"))
    sides = near.join(sized(deg("a")), "a", "left").join(sized(deg("b")), "b", "left")
    more = F.coalesce("db", F.lit(1)) > F.coalesce("da", F.lit(1))
    blocks = F.ceil(F.greatest(F.coalesce("da", F.lit(1)), F.coalesce("db", F.lit(1))) / F.lit(PARTNERS)).cast("int")
    pairs = sides.select("a", "b", "na", "nb", F.when(more, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(more, F.col("a")).otherwise(F.col("b")).alias("leaf"), blocks.alias("blocks"))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("leaf"), F.col("blocks")).cast("int"))
    leaves = pairs.join(sets.select(F.col("id").alias("leaf"), F.col("shingles").alias("xl")), "leaf")
    hubs = written(pairs.select("hub", "block").distinct(), "minhash-hubs")
    hubs = hubs.join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("xh")), "hub")
    both = leaves.join(hubs, ["hub", "block"]).withColumn("common", F.size(F.array_intersect("xl", "xh")))
    both = both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common")))
    found = written(both.select("a", "b"), "minhash-confirmed")
    drop(near, ends)
    return found


def linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``."""
    return _grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, set_id, n_shingles, component_id, first_set``: a row's set, the least doc_id of
    its component, and of that one's sets in the component the least. A vertex is a set, since a
    doc_id may name several."""
    t = needed(percent)
    sig = written(signatures(docs, words), "minhash-signatures")
    own = sig.where("n > 0 and doc_id is not null")
    reps = own.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()), "minhash-representatives")
    posted = written(postings(reps.select("id", "n", "sig", "odd"), t), "minhash-postings")
    active = written(posted.select("id").distinct(), "minhash-active")
    few = reps.join(sized(active), "id", "left_semi").select("id", "n", "sig", "set_id", "doc")
    few = written(few, "minhash-candidates")

    def setup():
        shingles = Shingler(words)

        def call(text: str) -> tuple:
            found = shingles(text)
            return _digest(found), found.view(np.int64).tolist()

        return each(call)

    of = few.select(F.col("doc").alias("doc_id"))
    wanted = _texts(docs).join(sized(of), "doc_id", "left_semi")
    sets = map_texts(wanted.select("text"), None, "set_id binary, shingles array<long>", setup=setup).dropDuplicates(["set_id"])
    sets = written(sets.join(sized(few.select("set_id", "id")), "set_id").select("id", "shingles"), "minhash-sets")

    central = F.max(F.struct("weight", "id", "n", "odd"))
    others = [F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id", "n", "odd")) for r in range(MORE_PIVOTS)]
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[x.alias(f"p{i}") for i, x in enumerate([central, *others])])
    chosen = F.array(*[F.struct(f"p{i}.id", f"p{i}.n", f"p{i}.odd") for i in range(MORE_PIVOTS + 1)])
    pivot = lists.where("c > 1").select(F.col("key").alias("_k"), F.explode(F.when(F.col("c") < LONG_LIST, F.slice(chosen, 1, 1)).otherwise(F.array_distinct(chosen))).alias("p"))
    pivot = pivot.select("_k", F.col("p.id").alias("a"), F.col("p.n").alias("pn"), F.col("p.odd").alias("po"))
    pivot = written(pivot, "minhash-pivots")  # a table of its own, so that AQE can split a long list
    stars = posted.join(pivot, (F.col("key") == F.col("_k")) & (F.col("id") != F.col("a")) & _close("n", "pn", "odd", "po", percent))
    stars = stars.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    links = confirmed(stars.distinct(), few, sets, t, percent)
    label = written(connected_components(links), "minhash-label")

    known = posted.join(label.select(F.col("id").alias("_i"), "component"), F.col("id") == F.col("_i"), "left")
    known = written(known.select("key", "id", "n", "odd", F.coalesce("component", "id").alias("comp")), "minhash-known")
    parts = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    largest = parts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("big"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    largest = written(largest, "minhash-largest")
    mixed = written(known.join(largest.select(F.col("key").alias("_k"), "big"), F.col("key") == F.col("_k")).drop("_k"), "minhash-mixed")
    small = mixed.where("comp <> big").select(F.col("key").alias("_k"), F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("odd").alias("_odd"), F.col("comp").alias("_comp"))
    apart = (F.col("key") == F.col("_k")) & (F.col("comp") != F.col("_comp")) & ((F.col("comp") == F.col("big")) | (F.col("_id") < F.col("id")))
    apart &= _close("n", "_n", "odd", "_odd", percent)
    rest = mixed.join(small, apart).select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()
    more = confirmed(rest, few, sets, t, percent)
    if not more.isEmpty():
        # links between the components found so far
        named = label.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        up = more.join(named, F.col("a") == F.col("_i"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
        up = up.join(named, F.col("b") == F.col("_i"), "left").select("a", F.coalesce("_c", "b").alias("b"))
        over = written(connected_components(up), "minhash-over")
        top = over.select(F.col("id").alias("_r"), F.col("component").alias("_t"))
        all_ids = label.select("id", "component").union(over.join(label, "id", "left_anti").select("id", F.col("id").alias("component")))
        label = written(all_ids.join(top, F.col("component") == F.col("_r"), "left").select("id", F.coalesce("_t", "component").alias("component")), "minhash-label")

    drop(posted, active, few, sets, pivot, links, known, largest, mixed, more)
    first = label.join(reps.select("id", "doc", "set_id"), "id").groupBy(F.col("component").alias("_c")).agg(F.min(F.struct("doc", "set_id")).alias("first"))
    first = written(first, "minhash-first")
    final = reps.select("set_id", "doc", "id").join(label.select(F.col("id").alias("_i"), "component"), F.col("id") == F.col("_i"), "left")
    final = final.join(sized(first), F.col("component") == F.col("_c"), "left")
    final = final.select(F.col("set_id").alias("_s"), F.coalesce("first.doc", "doc").alias("component_id"), F.coalesce("first.set_id", "set_id").alias("first_set"))
    out = sig.join(final, (F.col("set_id") == F.col("_s")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "set_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "first_set")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group, its smallest id, and all columns.

    Rows that repeat the id that stays and its set are copies of it; they can't be told apart
    and stay. Where a doc_id names texts that go and texts that stay, its rows are told apart
    by their sets.
    """
    rows = _grouped(docs.select("doc_id", "text"), words, percent)
    goes = F.coalesce((F.col("doc_id") != F.col("component_id")) | (F.col("set_id") != F.col("first_set")), F.lit(False))
    rows = rows.select("doc_id", "set_id", goes.alias("goes"))
    gone = rows.groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_and("goes").alias("_all"), F.bool_or("goes").alias("_some"))
    gone = written(gone.where("_some").select("_gone", "_all"), "minhash-gone")
    partly = gone.where("not _all").select("_gone")
    # all columns in one struct, so that none of theirs clashes with ours
    packed = docs.select(row_of(docs, "text"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rest = packed.join(sized(gone), F.col("id") == F.col("_gone"), "left_anti").select(*columns_of(docs, text=F.col("text")))
    if partly.isEmpty():
        return rest
    pairs = rows.where("goes").join(sized(partly), F.col("doc_id") == F.col("_gone"), "left_semi").select(F.col("doc_id").alias("_gone"), F.col("set_id").alias("_set")).distinct()
    pairs = written(pairs, "minhash-gone-sets")

    def setup():
        shingles = Shingler(words)
        return each(lambda text: (_digest(shingles(text)),))

    apart = packed.join(sized(partly), F.col("id") == F.col("_gone"), "left_semi")
    apart = map_texts(apart, None, "_own binary", setup=setup, keep=True)
    apart = apart.join(sized(pairs), (F.col("id") == F.col("_gone")) & (F.col("_own") == F.col("_set")), "left_anti")
    return rest.unionByName(apart.select(*columns_of(docs, text=F.col("text"))))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir), 3, 85)


#: All documents that share a shingle; for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
        ELSE list_transform(range(1, len(l) - 1), lambda i: concat(l[i], ' ', l[i + 1], ' ', l[i + 2])) END)) AS x FROM w
), n AS (
    SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.c + y.c - k)
), r AS (
    SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), m AS (
    SELECT id, min(c) AS component_id FROM r GROUP BY id
)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
