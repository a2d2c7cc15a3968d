"""Exact n-gram Jaccard self-join by prefixes under several global token orders.

A document is its set of distinct word n-grams.  Two sets of Jaccard similarity at least t share a token within the first
``n - ceil(t n) + 1`` tokens of each, under *any* total order of tokens.  Three orders are used; all sort by class
first (seen once, seldom, often), then by three different hashes.  Pairs must meet in the first order's prefixes and have
common prefix tokens under the second and third too; the survivors are verified on the whole sets.

* Classes come from counts over all documents, kept as two Bloom filters of fixed size.  A filter that says "maybe" too
  often moves tokens to another class: still one global order, so results never change, only the number of candidates.
  That of frequent tokens holds the most frequent ones that it has room for, so the tokens of the largest groups come last
  however large the corpus is.  A full filter of repeated tokens leaves tokens seen once among the prefixes, which costs
  no more than to send the prefixes whole.
* Tokens seen once never enter a candidate, so nothing is emitted for them.
* Identical sets are one node.  A prefix token's group first links each member to one leader (the member with the fewest
  tokens of its own), which takes a pair per member.  Only members that are still in different components
  are paired after that.  Groups that would give more than ``PAIRS_PER_ROW`` such pairs a member are compared in blocks of
  bounded size inside tasks, by products of incidence matrices, and give a spanning forest of links.
* Links become components by star contraction.  No group is emitted pair by pair and nothing of the corpus goes to the
  driver but the filters' segments, of a size fixed by parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SegmentedBloom, buckets_for, by_batch, by_group, cleaned, discard, few_tasks, materialise, mix64, small_batches
from .graph import components
from .textkit import ngram_hashes, words

RARE_BITS, OFTEN_BITS = 1 << 26, 1 << 24
#: A token of more sets than this is frequent, if it is among the most frequent ones with so many bits of the filter each.
OFTEN, OFTEN_ENTRY = 16, 12
PAIRS_PER_ROW = 16
#: A block holds about so many tokens and sets, so a task that compares two of them has a bound whatever the sets' sizes.
BLOCK_TOKENS, BLOCK_SETS = 200_000, 500
FLUSH_TOKENS = 1 << 20
ORDER_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each document; with fewer words the whole sequence counts as one."""
    for w in words(texts):
        grams = ngram_hashes(w.hashes, n)
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield ngram_hashes(w.hashes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


class Sets:
    """doc_id, n, digest, tokens; a task sends the tokens of each distinct set once."""

    schema = "doc_id long, n long, digest binary, tokens binary"

    def __init__(self, n: int):
        self.n = n

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            ids, k = batch.column(0), 0
            sizes, digests, tokens, held = [], [], [], 0
            for s in shingle_sets(batch.column(1), self.n):
                raw = s.tobytes()
                d = hashlib.blake2b(raw, digest_size=16).digest() if len(s) else None
                new = d is not None and d not in sent
                if new:
                    sent.add(d)
                    held += len(raw)
                sizes.append(len(s))
                digests.append(d)
                tokens.append(raw if new else None)
                if held > 4 << 20 or len(sizes) == 4096:
                    yield self._batch(ids.slice(k, len(sizes)), sizes, digests, tokens)
                    k += len(sizes)
                    sizes, digests, tokens, held = [], [], [], 0
            if sizes:
                yield self._batch(ids.slice(k, len(sizes)), sizes, digests, tokens)

    def _batch(self, ids, sizes, digests, tokens) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "n", "digest", "tokens"])


class TokenKeys:
    """Map side of the counts: sorted distinct 40-bit token keys by bucket, as 32-bit differences."""

    schema = "bucket int, keys binary"

    def __init__(self, buckets: int):
        self.bits = buckets.bit_length() - 1

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                if (raw := x.as_py()) is not None:
                    held.append(np.frombuffer(raw, np.uint64) >> np.uint64(24))
                    size += len(held[-1])
                    if size > FLUSH_TOKENS:
                        yield from self._flush(held)
                        held, size = [], 0
        if size:
            yield from self._flush(held)

    def _flush(self, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(keys, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(40 - self.bits))
        for b in range(1 << self.bits):
            part, c = keys[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]
            if len(part):
                steps = np.diff(part, prepend=np.uint64(b << (40 - self.bits)))
                wide = np.flatnonzero(steps > np.uint64(0xFFFFFFFF))
                many = np.flatnonzero(c > 1)
                blob = np.array([len(part), len(wide), len(many)], np.uint32).tobytes() + steps.astype(np.uint32).tobytes()
                blob += wide.astype(np.uint32).tobytes() + (steps[wide] >> np.uint64(32)).astype(np.uint32).tobytes()
                blob += many.astype(np.uint32).tobytes() + c[many].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "keys"])


def unpack_keys(blob: bytes, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(blob, np.uint32)
    n, wide, many = (int(v) for v in x[:3])
    steps = x[3 : 3 + n].astype(np.uint64)
    at = 3 + n
    steps[x[at : at + wide]] += x[at + wide : at + 2 * wide].astype(np.uint64) << np.uint64(32)
    at += 2 * wide
    counts = np.ones(n, np.int64)
    counts[x[at : at + many]] = x[at + many : at + 2 * many]
    return np.uint64(bucket << (40 - bits)) + np.cumsum(steps), counts


class TokenClasses:
    """Reduce side of the counts: the bucket's segments of the two filters."""

    schema = "bucket int, twice binary, often binary"

    def __init__(self, buckets: int, rare_bits: int, often_bits: int, often: int):
        self.buckets, self.rare_bits, self.often_bits, self.often = buckets, rare_bits, often_bits, often

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, bits = int(pdf["bucket"].iloc[0]), self.buckets.bit_length() - 1
        parts = [unpack_keys(x, bucket, bits) for x in pdf["keys"]]
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([p[1] for p in parts]))
        keys = keys << np.uint64(24)
        twice, often = filters(self.buckets, self.rare_bits, self.often_bits)
        least, room = self.often, max(1, often.segment // OFTEN_ENTRY)
        if (counts > least).sum() > room:
            least = max(least, int(np.partition(counts, -room)[-room]))
        return pd.DataFrame({"bucket": [bucket], "twice": [twice.segment_bytes(keys[counts > 1], bucket)], "often": [often.segment_bytes(keys[counts > least], bucket)]})


def filters(buckets: int, rare_bits: int, often_bits: int) -> tuple[SegmentedBloom, SegmentedBloom]:
    return SegmentedBloom(rare_bits, buckets, 2), SegmentedBloom(often_bits, buckets, 3)


class Prefixes:
    """Prefix tokens of each distinct set under each order, without tokens that no other document has."""

    schema = "digest binary, n long, own long, a array<long>, b array<long>, c array<long>"

    def __init__(self, shared, percent: int):
        self.shared, self.percent = shared, percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, often = self.shared.value
        for batch in batches:
            rows: list[tuple] = []
            for digest, raw in zip(batch.column(0), batch.column(1), strict=True):
                raw = raw.as_py()
                if not raw:
                    continue
                s = np.frombuffer(raw, np.uint64)
                keys = s >> np.uint64(24) << np.uint64(24)
                shared = twice.contains(keys)
                own = len(s) - int(shared.sum())
                p = len(s) - -(-self.percent * len(s) // 100) + 1 - own
                if p <= 0:
                    continue
                s, keys = s[shared], keys[shared]
                hot = often.contains(keys)
                found = []
                for seed in ORDER_SEEDS:
                    order = np.lexsort((mix64(s ^ np.uint64(seed)), hot))[:p]
                    found.append(s[order].view(np.int64))
                if len(found[0]):
                    rows.append((digest.as_py(), len(raw) // 8, own, *found))
                if len(rows) == 512:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "n", "own", "a", "b", "c"])


class Verify:
    """Pairs with both sets -> the pairs that link."""

    schema = "u long, v long"

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= self.percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])


class BlockLinks:
    """All pairs between two blocks by incidence products; gives a spanning forest of the links."""

    schema = "u long, v long"

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
        sizes = np.array([len(s) for s in sets])
        left = pdf["left"].to_numpy(bool)
        tokens, back, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        keep = seen[back] > 1
        row, back = row[keep], back[keep]
        order = np.argsort(back, kind="stable")
        row, back = row[order], back[order]
        back = np.cumsum(np.diff(back, prepend=back[:1]) > 0)
        same = bool(pdf["same"].iloc[0])
        ia, ib = (np.arange(len(sets)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        label = list(range(len(sets)))
        if not len(ia) or not len(ib) or not len(back):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        both = np.zeros((len(ia), len(ib)), np.float32)
        ta, tb = np.full(len(sets), -1), np.full(len(sets), -1)
        ta[ia], tb[ib] = np.arange(len(ia)), np.arange(len(ib))
        step = 2048
        for lo in range(0, int(back[-1]) + 1, step):
            i, j = np.searchsorted(back, [lo, lo + step])
            r, c = row[i:j], back[i:j] - lo
            a, b = np.zeros((len(ia), step), np.float32), np.zeros((len(ib), step), np.float32)
            m = ta[r] >= 0
            a[ta[r][m], c[m]] = 1
            m = tb[r] >= 0
            b[tb[r][m], c[m]] = 1
            both += a @ b.T

        def root(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        comps, first = pdf["component"].to_numpy(), {}
        for k, c in enumerate(comps.tolist()):
            label[k] = first.setdefault(c, k)
        nodes, out = pdf["node"].to_numpy(), []
        for k, x in enumerate(ia.tolist()):
            inter = both[k].astype(np.int64)
            hits = ib[100 * inter >= self.percent * (sizes[x] + sizes[ib] - inter)]
            for y in hits[comps[hits] != comps[x]].tolist():
                p, q = root(x), root(y)
                if p != q:
                    label[p] = q
                    out.append((nodes[x], nodes[y]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if its counted size is within bounds, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Join:
    def __init__(self, docs: DataFrame, n: int, percent: int, rare_bits: int, often_bits: int, often: int):
        self.percent, self.spark = percent, docs.sparkSession
        self.tasks, self.few = few_tasks(docs, 1), few_tasks(docs)
        self.sets = materialise(docs.mapInArrow(by_batch(Sets(n)), Sets.schema), "sets")
        known = self.sets.where("digest is not null and doc_id is not null")
        self.classes = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes", self.tasks)
        buckets = buckets_for(self.sets, 256)
        twice, often_f = filters(buckets, rare_bits, often_bits)
        with cleaned(self.spark):
            counted = self.sets.select("tokens").where("tokens is not null").mapInArrow(by_batch(TokenKeys(buckets)), TokenKeys.schema)
            segments = counted.groupBy("bucket").applyInPandas(by_group(TokenClasses(buckets, rare_bits, often_bits, often)), TokenClasses.schema).collect()  # the filters' own bits
        for r in segments:
            twice.place(r["bucket"], r["twice"])
            often_f.place(r["bucket"], r["often"])
        self.shared = self.spark.sparkContext.broadcast((twice, often_f))
        prefixes = self.sets.select("digest", "tokens").where("tokens is not null").mapInArrow(by_batch(Prefixes(self.shared, percent)), Prefixes.schema)
        prefixes = prefixes.dropDuplicates(["digest"]).join(self.classes, "digest")
        self.nodes = materialise(prefixes.select("node", "digest", "n", "own", "a", "b", "c"), "nodes", self.tasks)

    def fits(self, x: str, y: str):
        return F.least(F.col(x), F.col(y)) * 100 >= self.percent * F.greatest(F.col(x), F.col(y))

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) that meet in the second and third order too."""
        side = lambda k: self.nodes.select(F.col("node").alias(k), F.col("b").alias(f"b{k}"), F.col("c").alias(f"c{k}"))
        both = pairs.join(side("u"), "u").join(side("v"), "v")
        return both.where(F.arrays_overlap("bu", "bv") & F.arrays_overlap("cu", "cv")).select("u", "v").distinct()

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """(node, digest, tokens) of the wanted nodes."""
        keys = materialise(wanted.distinct().join(self.classes, "node").select("node", "digest"), "wanted", self.few)
        found = self.sets.where("tokens is not null").select("digest", "tokens").join(_small(keys), "digest")
        return found.dropDuplicates(["node", "digest"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """The candidate pairs that link, verified on whole sets."""
        pairs = materialise(pairs, "pairs", self.few)
        both = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
        got = materialise(self.fetch(both), "fetched", self.tasks)
        side = lambda k: got.select(F.col("node").alias(k), F.col("tokens").alias(f"t{k}"))
        ready = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv")
        out = materialise(ready.mapInArrow(by_batch(Verify(self.percent)), Verify.schema), "links", self.tasks)
        discard(got)
        discard(pairs)
        return out

    def stars(self) -> DataFrame:
        g = self.nodes.select("node", "n", "own", F.explode("a").alias("token"))
        lead = g.groupBy("token").agg(F.min(F.struct("own", (-F.col("n")).alias("m"), "node")).alias("lead"), F.count("*").alias("k")).where("k > 1")
        lead = materialise(lead.select("token", "lead"), "leads", self.few)  # so that a token of very many sets can be split
        pairs = g.join(lead, "token").select("node", "n", F.col("lead.node").alias("l"), (-F.col("lead.m")).alias("ln"))
        pairs = pairs.where((F.col("node") != F.col("l")) & self.fits("n", "ln"))
        return self.filtered(pairs.select(F.greatest("node", "l").alias("u"), F.least("node", "l").alias("v")).distinct())

    def rest(self, labels: DataFrame) -> list[DataFrame]:
        """Links between components that the stars left apart."""
        node = self.nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        node = materialise(node.select("node", "n", "component", "a"), "labelled", self.tasks)
        g = node.select("node", "n", "component", F.explode("a").alias("token"))
        sizes = g.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token")
        sizes = sizes.agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.count("*").alias("parts")).where("parts > 1")
        sizes = materialise(sizes.select("token", (F.expr("m * m - sq") > 2 * PAIRS_PER_ROW * F.col("m")).alias("dense")), "groups", self.few)
        light = materialise(g.join(sizes.where("not dense"), "token").select("node", "n", "component", "token"), "light", self.few)
        x = light.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"), "token")
        y = light.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"), "token")
        pairs = x.join(y, "token").where((F.col("cu") != F.col("cv")) & (F.col("u") > F.col("v")) & self.fits("nu", "nv"))
        found = [self.links(self.filtered(pairs.select("u", "v").distinct()))]
        heavy = materialise(g.join(sizes.where("dense"), "token").select("node", "n", "component", "token"), "heavy", self.few)
        if heavy.isEmpty():
            return found
        lead = heavy.groupBy("token").agg(F.min("node").alias("v"))
        area = components(heavy.join(lead, "token").select(F.col("node").alias("u"), "v"), tasks=self.few)
        own = heavy.select("node", "n", "component").distinct().join(area.select("node", F.col("component").alias("area")), "node")
        # Sizes in steps of 1/t: only sets of the same or the next step can link.
        own = materialise(own.withColumn("step", F.floor(F.log(F.col("n")) / float(np.log(100 / self.percent)) + 1e-9).cast("int")), "areas", self.few)
        blocks = own.groupBy("area", "step").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
        near = lambda d, k: blocks.select("area", (F.col("step") + d).alias("step"), F.col("blocks").alias(k))
        own = own.join(blocks, ["area", "step"]).join(near(-1, "above"), ["area", "step"], "left").join(near(1, "below"), ["area", "step"], "left")
        own = own.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        span = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
        own = own.withColumns({"_own": span("blocks"), "_above": span("above"), "_below": span("below")})
        jobs = F.concat(
            F.expr("transform(_own, j -> struct(step as s, 0 as d, least(i, j) as p, greatest(i, j) as q, i <= j as left, i = j as same))"),
            F.expr("transform(_above, j -> struct(step as s, 1 as d, i as p, j as q, true as left, false as same))"),
            F.expr("transform(_below, j -> struct(step - 1 as s, 1 as d, j as p, i as q, false as left, false as same))"),
        )
        got = materialise(self.fetch(own.select("node")), "fetched", self.tasks)
        tasks = own.select("node", "component", "area", F.explode(jobs).alias("job")).join(got.select("node", "tokens"), "node")
        tasks = tasks.select("node", "component", "tokens", "area", "job.s", "job.d", "job.p", "job.q", "job.left", "job.same")
        found.append(materialise(tasks.groupBy("area", "s", "d", "p", "q").applyInPandas(by_group(BlockLinks(self.percent)), BlockLinks.schema), "links", self.tasks))
        return found


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_gram: int = 4, percent: int = 85, rare_bits: int = RARE_BITS, often_bits: int = OFTEN_BITS, often: int = OFTEN
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two documents link when 100 * intersection >= percent * union of their sets of word n-grams.  Texts without words
    (null, empty, blank) have no n-gram and link with nothing.  Rows of one id are one document that links by any of its
    texts; repeated rows are rows of one id.  A row without an id links with nothing and has no component.  Texts of any length are one
    set.  An empty table gives no rows.  Other columns are not looked at.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    join = _Join(base, words_per_gram, percent, rare_bits, often_bits, often)
    # Rows of one id: their classes' nodes are one document.
    ids = join.sets.where("digest is not null and doc_id is not null").select("doc_id", "digest").join(join.classes, "digest")
    twice = ids.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    alike = ids.join(twice, "doc_id").select(F.col("node").alias("u"), F.col("lo").alias("v"))
    links = join.links(join.stars()).unionByName(alike)
    labels = materialise(components(links, tasks=join.few), "labels")
    more = join.rest(labels)
    edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    for x in more:
        edges = edges.unionByName(x)
    final = components(edges, tasks=join.few)
    labelled = join.classes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    rows = join.sets.select("doc_id", "n", "digest").join(labelled, "digest", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
