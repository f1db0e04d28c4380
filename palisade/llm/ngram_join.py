"""Size-aware heavy-light join of word n-gram sets by Jaccard similarity.

Two sets of sizes n and m are linked when they share at least c(n, m) elements, the least number that the similarity
asks for. Light sets enumerate their subsets of the sizes c that a partner can ask for: two light sets that are
linked share such a subset. Heavy sets are scanned along inverted lists. Sizes fall into bands, each band splits the
elements' hash range into more blocks than a linked pair can have differing elements, and a list holds the sets
that have the same elements in one block: two linked sets share the list of some block, and a set needs only its
fullest blocks, one more than it can differ in. A list of one block is as rare as all its elements together, where
the list of a single frequent n-gram would hold a great part of the corpus. The boundary
between light and heavy is the largest size at which enumerating still costs no more rows than scanning.

Equal sets meet on one list for the whole set and need no check. On every other list each set is paired with the
list's smallest id, first within a batch, which leaves one place a batch of a hot list to shuffle, and then among
batches; pairs are checked on the sets themselves. Sets that share a list but lie in different components after
that are compared through what they differ from their group's centre in. So no group gives all its pairs, and no link
between components is missed.

Nulls and empty texts: no elements, no links. A row whose id is null is returned with a null component and linked
with nothing. Rows that repeat an id are one node with several sets. Elements are 64-bit hashes. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import map_batches, materialize, mix64, prepare, table, texts_of, word_hashes
from palisade.llm.components import components

#: Rows that checking the pairs of a heavy set is taken to cost, beside its rows on lists.
CHECK_COST = 16
#: One block in so many is to spare, so that sets can leave their emptier blocks out.
SPARE = 6
#: Ratio between the sizes in a band.
BAND = 1.4
#: Text that gives a bucket's places, and the bounds of how many buckets there are.
BUCKET_TEXT, LEAST_BUCKETS, MOST_BUCKETS = 32 << 20, 64, 1 << 15
HEADS, DOCS, SETTLED, COPIES, NAMELESS = range(5)
#: Elements of a group's sets that one task takes; sets, and elements of sets, that a larger group's centre is taken from.
GROUP_ELEMENTS, SAMPLE, SAMPLE_ELEMENTS = 1 << 20, 64, 1 << 18
LINK, MEMBER, LISTED = range(3)
_DIFFERENCES = "kind int, b bigint, element bigint, a bigint, component bigint, other bigint, slack bigint, reach bigint, low bigint, most bigint, indexed boolean"
#: Size of the filter of ids whose sets are compared: 1 MiB.
FILTER_BITS = 1 << 23
_U = np.uint64


class Plan:
    """Who must meet whom: linked is p * union <= q * intersection, that is, a similarity of p / q or more."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.boundary = 0
        while self.boundary < 64 and self._light_rows(self.boundary + 1) <= self._heavy_rows(self.boundary + 1):
            self.boundary += 1

    def partners(self, n: int) -> tuple[int, int]:
        return -(-self.p * n // self.q), self.q * n // self.p

    def overlap(self, n: int, m: int) -> int:
        return -(-self.p * (n + m) // (self.p + self.q))

    def differing(self, n: int, m: int) -> int:
        return (n + m) * (self.q - self.p) // (self.p + self.q)

    def subset_sizes(self, n: int) -> list[int]:
        low, high = self.partners(n)
        return sorted({c for m in range(max(1, low), high + 1) if (c := self.overlap(n, m)) <= min(n, m)})

    def _light_rows(self, n: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n))

    def _heavy_rows(self, n: int) -> float:
        return CHECK_COST + 1.3 * self._blocks(int(n * BAND))

    def _blocks(self, most: int) -> int:
        differing = self.differing(most, most)
        return differing + 2 + differing // SPARE

    def band(self, n: int) -> tuple[int, int, int]:
        """Number, least and greatest size of the band of heavy size n."""
        low, i = self.boundary + 1, 0
        while True:
            high = max(low, int(low * BAND))
            if n <= high:
                return i, low, high
            low, i = high + 1, i + 1

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """Band, blocks and most differing elements, for every band in which a set of size n may be or have its larger partner."""
        out, m, high = [], max(n, self.boundary + 1), self.partners(n)[1]
        while m <= high:
            i, _, most = self.band(m)
            out.append((i, self._blocks(most), self.differing(n, min(high, most))))
            m = most + 1
        return out


def elements(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `words` words in a row, or of the whole sequence if it is shorter."""
    split = [t.lower().split() for t in texts]
    hashes, out, at = word_hashes([w for s in split for w in s]), [], 0
    for s in split:
        h = hashes[at : at + len(s)]
        at += len(s)
        if not len(h):
            out.append(h)
            continue
        width = min(words, len(h))
        acc = mix64(h[: len(h) - width + 1], width)
        for j in range(1, width):
            acc = mix64(acc ^ h[j : len(h) - width + 1 + j], width)
        out.append(np.unique(acc))
    return out


class Lists:
    """The lists that a set is on."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self._bands: dict[int, list] = {}
        self._edges: dict[int, np.ndarray] = {}

    def _cuts(self, blocks: int) -> np.ndarray:
        if blocks not in self._edges:
            self._edges[blocks] = np.array([(k << 64) // blocks for k in range(1, blocks)], _U)
        return self._edges[blocks]

    def whole(self, found: np.ndarray) -> tuple[int, int]:
        with np.errstate(over="ignore"):
            a, b = mix64(found, 11).sum(dtype=_U), mix64(found, 12).sum(dtype=_U)
        return int(mix64(np.array([a]), 13)[0]), int(b)

    def of(self, found: np.ndarray) -> np.ndarray:
        n, plan = len(found), self.plan
        if n not in self._bands:
            self._bands[n] = plan.bands(n)
        out = []
        with np.errstate(over="ignore"):
            mixed = mix64(found, 3)
            run = np.concatenate([np.zeros(1, _U), np.cumsum(mixed, dtype=_U)])
            for band, blocks, differing in self._bands[n]:
                ends = np.concatenate([[0], np.searchsorted(found, self._cuts(blocks)), [n]])
                filled = ends[1:] - ends[:-1]
                keys = mix64((run[ends[1:]] - run[ends[:-1]]) ^ mix64(np.arange(blocks, dtype=_U), 2 * band + 101), 5)
                # The fullest blocks, one more than may differ, and those as full: some block of at least the greater of
                # two sets' bounds is alike in both.
                least = np.partition(filled, blocks - 1 - differing)[blocks - 1 - differing] if differing < blocks else 0
                out.append(keys[filled >= least])
            if n <= plan.boundary:
                for c in plan.subset_sizes(n):
                    sums = [sum(x) & (2**64 - 1) for x in combinations(mixed.tolist(), c)]
                    out.append(mix64(np.array(sums, _U), 1000 + c))
        return np.concatenate(out) if out else np.zeros(0, _U)


def _listed(df: DataFrame, plan: Plan, words: int, buckets: int) -> DataFrame:
    """Packed rows (bucket, kind, keys, ids, more), a few for each batch and bucket.

    HEADS: places on lists, keys are the lists' last 48 bits; DOCS: documents with their whole set's hash, more is the
    set's size. A batch sends only the smallest id of those that share a list, or a whole set; what it has settled
    itself, SETTLED places and COPIES, is spread over buckets as it is.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        lists = Lists(plan)
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        sets: list = [None] * len(ids)
        for at in range(0, len(ids), 200):
            sets[at : at + 200] = elements(texts[at : at + 200], words)
        head: dict[tuple[int, int], int] = {}
        docs, copies, keys, owners = [], [], [], []
        for i in sorted((i for i in range(len(ids)) if ids[i] is not None), key=lambda i: ids[i]):
            if not len(sets[i]):
                copies.append((ids[i], 0, ids[i]))
                continue
            whole = lists.whole(sets[i])
            first = head.setdefault(whole, ids[i])
            if first != ids[i]:
                copies.append((ids[i], len(sets[i]), first))
                continue
            docs.append((*whole, ids[i], len(sets[i])))
            own = np.unique(lists.of(sets[i]))
            keys.append(own)
            owners.append(np.full(len(own), ids[i], np.int64))
        nameless = [len(s) for i, s in zip(ids, sets, strict=True) if i is None]
        key = np.concatenate(keys) if keys else np.zeros(0, _U)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        by = np.argsort(key, kind="stable")  # owners stay in ascending order
        key, owner = key[by], owner[by]
        start = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        lead = owner[np.flatnonzero(start)[np.cumsum(start) - 1]] if len(key) else owner
        bucket = ((key >> _U(48)).astype(np.int64) * buckets) >> 16
        out: list[tuple] = []
        first = lead == owner
        for k, (a, b) in _runs(bucket[first]):
            out.append((k, HEADS, key[first][a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), owner[first][a:b].tobytes(), b""))
        listed = (bucket << 48) | (key & _U((1 << 48) - 1)).astype(np.int64)
        spread = int(mix64(np.array([len(key)], _U), ids[0] or 0 if ids else 0)[0] % _U(buckets))
        if not first.all():
            out.append((spread, SETTLED, listed[~first].tobytes(), owner[~first].tobytes(), lead[~first].tobytes()))
        if copies:
            c = np.array(copies, np.int64)
            out.append((spread, COPIES, c[:, 2].tobytes(), c[:, 0].tobytes(), c[:, 1].tobytes()))
        if nameless:
            out.append((spread, NAMELESS, b"", b"", np.array(nameless, np.int64).tobytes()))
        if docs:
            h = np.array([d[:2] for d in docs], _U)
            own, size = np.array([d[2] for d in docs], np.int64), np.array([d[3] for d in docs], np.int64)
            where = ((h[:, 0] >> _U(48)).astype(np.int64) * buckets) >> 16
            by = np.argsort(where, kind="stable")
            for k, (a, b) in _runs(where[by]):
                out.append((k, DOCS, h[by][a:b].tobytes(), own[by][a:b].tobytes(), size[by][a:b].tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return {n: pa.array(list(c), t) for n, c, t in zip(("bucket", "kind", "keys", "ids", "more"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)}

    return map_batches(df, rows, "bucket int, kind int, keys binary, ids binary, more binary")


def _runs(sorted_: np.ndarray):
    """Each value of a sorted array with its first and last place."""
    if len(sorted_):
        starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sorted_)], strict=True):
            yield int(sorted_[a]), (a, b)


def _met(listed: DataFrame) -> DataFrame:
    """Documents (n >= 0), and the places on lists of two or more (n = -1): list, id, and the id it is paired with.

    A bucket holds about as many places at any input size; a place is 14 bytes.
    """

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bucket, kinds = key[0].as_py(), rows.column("kind").to_numpy()
        cat = lambda kind, name: b"".join(x for k, x in zip(kinds, rows.column(name).to_pylist(), strict=True) if k == kind)
        ints = lambda kind, name: np.frombuffer(cat(kind, name), np.int64)
        parts = []  # n, list, id, lead, settled

        wide = np.zeros((len(ints(HEADS, "ids")), 8), np.uint8)
        wide[:, :6] = np.frombuffer(cat(HEADS, "keys"), np.uint8).reshape(-1, 6)
        k, ids = wide.view(np.int64).ravel(), ints(HEADS, "ids")
        order = np.lexsort((ids, k))
        k, ids = k[order], ids[order]
        starts = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        lead = ids[np.flatnonzero(starts)[np.cumsum(starts) - 1]] if len(k) else ids
        on = lead != ids
        parts.append((np.full(on.sum(), -1), (bucket << 48) | k[on], ids[on], lead[on], np.zeros(on.sum(), bool)))

        h, ids, n = np.frombuffer(cat(DOCS, "keys"), _U).reshape(-1, 2), ints(DOCS, "ids"), ints(DOCS, "more")
        order = np.lexsort((ids, h[:, 1], h[:, 0]))
        h, ids, n = h[order], ids[order], n[order]
        starts = np.concatenate([[True], (h[1:] != h[:-1]).any(1)]) if len(h) else np.zeros(0, bool)
        lead = ids[np.flatnonzero(starts)[np.cumsum(starts) - 1]] if len(h) else ids
        parts.append((n, np.zeros(len(n), np.int64), ids, lead, np.zeros(len(n), bool)))

        ids = ints(SETTLED, "ids")
        parts.append((np.full(len(ids), -1), ints(SETTLED, "keys"), ids, ints(SETTLED, "more"), np.ones(len(ids), bool)))
        ids = ints(COPIES, "ids")
        parts.append((ints(COPIES, "more"), np.zeros(len(ids), np.int64), ids, ints(COPIES, "keys"), np.zeros(len(ids), bool)))
        out = [np.concatenate(c) for c in zip(*parts, strict=True)]
        named = pa.table([pa.array(c) for c in out], names=["n", "list", "id", "lead", "settled"])
        bare = ints(NAMELESS, "more")
        null = pa.nulls(len(bare), pa.int64())
        return pa.concat_tables([named, pa.table([pa.array(bare), null, null, null, pa.array(np.zeros(len(bare), bool))], names=named.column_names)])

    return listed.groupBy("bucket").applyInArrow(meet, "n bigint, list bigint, id bigint, lead bigint, settled boolean")


def _places(met: DataFrame) -> DataFrame:
    """Places with their list's smallest id of all. What a batch has settled follows that batch's smallest id on the list."""
    heads, settled = met.where("n < 0 AND NOT settled").select("list", "id", "lead"), met.where("n < 0 AND settled").select("list", "id", F.col("lead").alias("near"))
    tops = heads.select("list", F.col("id").alias("near"), F.col("lead").alias("top"))
    moved = settled.join(tops, ["list", "near"], "left").select("list", "id", F.coalesce("top", "near").alias("lead"))
    return heads.unionByName(moved)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit for each of FILTER_BITS hashes of ids; FILTER_BITS / 8 bytes at any input size. Set bits may be others' too."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out


def _grams(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The sets of all ids in pairs. Texts stay where they are: a filter of fixed size leaves out most others, the join the rest."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted-ids")
    bits = docs.sparkSession.sparkContext.broadcast(_filter(wanted))
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))

    def sets(batch: pa.RecordBatch) -> dict | None:
        at = batch.column(2).to_numpy()
        keep = np.flatnonzero((bits.value[at >> 6] >> (at & 63)) & 1)
        if not len(keep):
            return None
        batch = batch.take(pa.array(keep))
        texts, found = texts_of(batch.column(1)), []
        for i in range(0, len(texts), 200):
            found += elements(texts[i : i + 200], words)
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        flat = np.concatenate(found).view(np.int64)
        return {"id": batch.column(0), "grams": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    near = map_batches(docs.where("id IS NOT NULL").select("id", "text", bit.alias("bit")), sets, "id bigint, grams array<bigint>")
    return near.join(wanted, "id", "left_semi")


def _sets_of(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    both = pairs.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    return both.join(grams.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")


def _checked(pairs: DataFrame, grams: DataFrame, plan: Plan) -> DataFrame:
    """pairs with the sizes n and m of their sets, how many elements are in one only, and whether they are linked."""
    n, m = F.size("x").cast("long"), F.size("y").cast("long")
    sized = _sets_of(pairs, grams).select("a", "b", "x", "y", n.alias("n"), m.alias("m"))
    apart = F.col("n") + F.col("m") - 2 * F.size(F.array_intersect("x", "y"))
    linked = F.col("apart") * (plan.p + plan.q) <= (F.col("n") + F.col("m")) * (plan.q - plan.p)
    return sized.withColumn("apart", apart).select("a", "b", "n", "m", "apart", linked.alias("linked"))


def ngram_join(df: DataFrame, words: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row; linked are rows of a similarity of p / q or more."""
    prepare(df.sparkSession)
    plan = Plan(p, q)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    met = materialize(_met(_listed(docs, plan, words, min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_TEXT))))), "lists")
    equal = met.where("n > 0 AND id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    pairs = _places(met).select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = materialize(pairs.join(equal, ["a", "b"], "left_anti"), "pairs")
    grams = materialize(_grams(pairs, docs, words), "grams")
    checked = materialize(_checked(pairs, grams, plan), "checked")
    links = equal.unionByName(checked.where("linked").select("a", "b"))
    found = materialize(components(links), "components")
    rows = met.where("n >= 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"))
    rows = rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = _crossing(checked, found, grams, plan)
    if more is not None and not more.isEmpty():
        merged = materialize(components(more), "merged").select(F.col("id").alias("component"), F.col("component").alias("least"))
        rows = rows.join(merged, "component", "left").withColumn("component", F.coalesce("least", "component"))
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def _crossing(checked: DataFrame, found: DataFrame, grams: DataFrame, plan: Plan) -> DataFrame | None:
    """Pairs of components between which a link exists, among the sets that share a list but not its smallest id's
    component; None if there are no such sets.

    The sets paired with one id are a group. A group has a centre, the elements that more than half of its sets hold, and
    a set is described by its r differences from it, rarest in the group first. With D and E the differences of sets of
    sizes n and m, |X ^ Y| = |D| + |E| - 2 |D & E|, so the pair is linked if and only if
    slack(X) + slack(Y) <= 2 t |D & E|, where slack = r t - n c, t = p + q and c = q - p. Two consequences:
    if the slacks add up to 0 or less the pair is linked whatever it shares, and the set of least slack stands for all;
    else the first difference that both hold is at a place of X with slack(Y) <= reach = 2 t (r - place + 1) - slack(X),
    and the same the other way. The pair is looked for among the set of less slack's first n c / t + 1 differences, which
    are its own rare changes. So a group of near copies that are all a little too far apart costs about its changes.

    Groups of up to GROUP_ELEMENTS elements are done where they meet. Larger ones are split by a hash, take centre and
    order from a sample that each part gets, and list their differences for a join.
    """
    t, c = plan.p + plan.q, plan.q - plan.p
    rows = checked.select("a", "b", "n").join(found.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    groups = rows.groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"), F.max("n").alias("most"))
    parts = F.ceil(F.col("elements") / F.lit(GROUP_ELEMENTS)).alias("parts")
    # The join's key isn't the grouping's, so that a large group's rows can be split among tasks.
    open_ = groups.where("lo <> hi").select(F.bitwise_not("b").alias("_j"), "rows", "elements", "most", parts)
    rows = rows.select("a", "b", "component").distinct().withColumn("_j", F.bitwise_not("b")).join(open_, "_j").drop("_j")
    rows = materialize(rows, "open")
    if rows.isEmpty():
        return None
    part, every = F.pmod(F.xxhash64("a"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    share = F.greatest(F.lit(1.0), F.least(F.lit(float(SAMPLE)), F.col("rows") * F.lit(float(SAMPLE_ELEMENTS)) / F.col("elements")))
    sampled = (F.col("parts") > 1) & (F.pmod(F.xxhash64("a", F.lit(1)), F.col("rows")) < share)
    dealt = rows.select("a", "b", "component", "most", "parts", part.alias("own"), sampled.alias("sampled"), F.explode(F.when(sampled, every).otherwise(F.array(part))).alias("part"))
    dealt = dealt.join(grams.select(F.col("id").alias("a"), "grams"), "a")

    def differ(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _differences(key[0].as_py(), rows, t, c)

    met = materialize(dealt.groupBy("b", "part").applyInArrow(differ, _DIFFERENCES), "differences")
    here = met.where(F.col("kind") == LINK).select("component", "other")
    members = met.where(F.col("kind") == MEMBER).withColumn("_j", F.bitwise_not("b"))
    least = members.groupBy("_j").agg(F.min(F.struct("slack", "component")).alias("least"))
    sure = members.join(least, "_j").where(F.col("slack") + F.col("least.slack") <= 0).select("component", F.col("least.component").alias("other"))
    listed = met.where(F.col("kind") == LISTED)
    mixed = listed.groupBy("b", "element").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("b", "element")
    listed = listed.join(mixed, ["b", "element"], "left_semi")
    width, upper = F.col("most") * c + 1, F.least("reach", "slack")
    step = lambda x: F.floor(x / width)
    index = listed.where("indexed").select("b", "element", step(F.col("slack")).alias("step"), *(F.col(k).alias(f"l_{k}") for k in ("a", "component", "slack", "reach")))
    probe = listed.where(F.col("low") <= upper).select("b", "element", F.explode(F.sequence(step(F.col("low")), step(upper))).alias("step"), *(F.col(k).alias(f"r_{k}") for k in ("a", "component", "slack", "reach")))
    near = (F.col("l_component") != F.col("r_component")) & (F.col("l_slack") <= F.least("r_slack", "r_reach")) & (F.col("r_slack") <= F.col("l_reach"))
    pairs = index.join(probe, ["b", "element", "step"]).where(near).select(F.col("l_a").alias("a"), F.col("r_a").alias("b"), F.col("l_component").alias("component"), F.col("r_component").alias("other")).distinct()
    pairs = materialize(pairs, "wanted")
    linked = _checked(pairs.select("a", "b").distinct(), grams, plan).where("linked").select("a", "b")
    far = pairs.join(linked, ["a", "b"], "left_semi").select("component", "other")
    every = here.unionByName(sure).unionByName(far).where("component <> other")
    return materialize(every.select(F.col("component").alias("a"), F.col("other").alias("b")).distinct(), "linked-more")


def _differences(b: int, rows: pa.Table, t: int, c: int) -> pa.Table:
    """LINK rows of a group that is whole; MEMBER and LISTED rows of a part of one."""
    ids, component = rows.column("a").to_numpy(), rows.column("component").to_numpy()
    sets = rows.column("grams").combine_chunks()
    offsets, flat = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
    most, whole = int(rows.column("most")[0].as_py()), rows.column("parts")[0].as_py() == 1
    own = (rows.column("part").to_numpy() == rows.column("own").to_numpy()) if not whole else np.ones(len(ids), bool)
    drawn = rows.column("sampled").to_numpy(zero_copy_only=False) if not whole else own
    flat = flat[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = np.diff(offsets)
    distinct, code = np.unique(flat, return_inverse=True)
    held = np.bincount(code[np.repeat(drawn, n)], minlength=len(distinct))
    centre = 2 * held > drawn.sum()
    order = np.lexsort((distinct, np.where(centre, drawn.sum() - held, held)))  # rarest difference first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    core = np.sort(rank[centre])
    is_core = centre[order]
    found = []
    for i in range(len(ids)):
        mine = np.sort(rank[code[offsets[i] : offsets[i + 1]]])
        kept = mine[is_core[mine]]
        found.append(np.sort(np.concatenate([mine[~is_core[mine]], np.setdiff1d(core, kept, assume_unique=True)])))
    r = np.array([len(f) for f in found], np.int64)
    slack = r * t - n * c
    # A partner is at most as much nearer to the centre as the two may differ.
    low = np.maximum(r * t - (n + 2 * most) * c, slack.min() if whole else -most * c)
    # The first places that can be a pair's first shared difference: of the set of less slack, or of the other.
    length = np.minimum(r, np.maximum(n * c // t + 1, (2 * t * (r + 1) - slack - low) // (2 * t)))
    length = np.where(own, length, 0)
    who = np.repeat(np.arange(len(ids)), length)
    place = np.arange(len(who)) - np.repeat(np.cumsum(length) - length, length) + 1
    element = np.concatenate([f[:k] for f, k in zip(found, length, strict=True)]) if len(who) else np.zeros(0, np.int64)
    reach = 2 * t * (r[who] - place + 1) - slack[who]
    indexed = (place - 1) * t <= n[who] * c
    if not whole:
        members = np.flatnonzero(own)
        null = lambda k: pa.nulls(k, pa.int64())
        col = lambda x, y: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x), y if isinstance(y, pa.Array) else pa.array(y)])
        m, k = len(members), len(who)
        return pa.table({
            "kind": pa.array(np.concatenate([np.full(m, MEMBER), np.full(k, LISTED)]), pa.int32()),
            "b": np.full(m + k, b, np.int64),
            "element": col(null(m), distinct[order[element]]),
            "a": col(ids[members], ids[who]),
            "component": col(component[members], component[who]),
            "other": null(m + k),
            "slack": col(slack[members], slack[who]),
            "reach": col(null(m), reach),
            "low": col(null(m), low[who]),
            "most": np.full(m + k, most, np.int64),
            "indexed": pa.concat_arrays([pa.nulls(m, pa.bool_()), pa.array(indexed)]),
        })
    links = _links_within(found, component, slack, who, element, reach, indexed, low, t)
    bare = pa.nulls(len(links), pa.int64())
    return pa.table({
        "kind": pa.array(np.full(len(links), LINK), pa.int32()), "b": np.full(len(links), b, np.int64), "element": bare, "a": bare,
        "component": np.array([x for x, _ in links], np.int64), "other": np.array([y for _, y in links], np.int64),
        "slack": bare, "reach": bare, "low": bare, "most": bare, "indexed": pa.nulls(len(links), pa.bool_()),
    })


def _links_within(found: list[np.ndarray], component: np.ndarray, slack: np.ndarray, who: np.ndarray, element: np.ndarray, reach: np.ndarray, indexed: np.ndarray, low: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Enough of the linked pairs of components of a whole group to connect all that are linked."""
    root = {int(x): int(x) for x in np.unique(component)}
    links: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(i: int, j: int) -> None:
        x, y = find(int(component[i])), find(int(component[j]))
        if x != y:
            root[x] = y
            links.append((x, y))

    least = int(np.argmin(slack))
    for i in np.flatnonzero(slack + slack[least] <= 0):
        join(i, least)
    base, span = int(slack.min()), int(slack.max() - slack.min()) + 2
    at = np.flatnonzero(indexed)
    keys = element[at] * span + (slack[who[at]] - base)
    by = np.argsort(keys, kind="stable")
    at, keys = at[by], keys[by]
    top = np.minimum(reach, slack[who])
    probes = np.flatnonzero((top >= base) & (low[who] <= top))
    start = np.searchsorted(keys, element[probes] * span + (low[who[probes]] - base))
    stop = np.searchsorted(keys, element[probes] * span + (top[probes] - base), "right")
    some = stop > start
    probes, start, stop = probes[some], start[some], stop[some]
    tried: set[tuple[int, int]] = set()
    cuts = np.concatenate([[0], np.cumsum(stop - start)])
    at_probe = 0
    while at_probe < len(probes):
        upto = max(at_probe + 1, int(np.searchsorted(cuts, cuts[at_probe] + 2_000_000, "right")) - 1)
        size = stop[at_probe:upto] - start[at_probe:upto]
        right = np.repeat(probes[at_probe:upto], size)
        left = at[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[at_probe:upto], size)]
        x, y = who[left], who[right]
        for i, j in {(int(i), int(j)) for i, j in zip(*(z[(component[x] != component[y]) & (slack[y] <= reach[left])] for z in (x, y)), strict=True)} - tried:
            tried.add((i, j))
            if find(int(component[i])) != find(int(component[j])):
                shared = len(np.intersect1d(found[i], found[j], assume_unique=True))
                if slack[i] + slack[j] <= 2 * t * shared:
                    join(i, j)
        at_probe = upto
    return links


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), words=3, p=90, q=100)
