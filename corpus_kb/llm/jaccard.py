"""Jaccard join of word-shingle sets by universe partition and pigeonhole.

Two sets of at most u shingles whose similarity is at least num/den differ in at most H shingles. Hashing the universe into m = H + 1
segments, some segment must be equal in both. Sizes fall into bands, one band reaching as far as similar sets can differ in size; a
set is indexed under the partition of its own band and of the next, so any similar pair meets under the larger one's.

A segment's *allocation* says how much of the H differences its index entries can rule out: 1 for the hash of the segment's
subset, 2 if the subsets with one shingle deleted are indexed too, 0 if the segment is too dear to index: it is empty, or
its subset is among the frequent ones of a sample. The sum has to reach H + 1. Deletions are added to the first segments in order, as few as make up
for the dear ones; the same order on both sides makes the guarantee hold for any list of dear subsets:

* of a pair, take the set with the shorter run of deletion segments. Where it allots 1 its equal partner is indexed; where it allots 2 a
  difference of one is met by its deletions and the partner's subset or the other way round, none of which is dear;
* a set that cannot reach H + 1 indexes all its entries, dear ones included; one that cannot reach it even so also indexes its
  H + 1 smallest shingles, of which any two similar sets share one.

Entries of equal sets are collapsed first, and those of one batch of documents before the exchange, so groups of copies and frequent passages
reach the exchange once a batch. Entries are told by 48 bits of their hash and exchanged in packs, one for each batch and bucket of hashes; two that share these bits
become one group, which adds comparisons and loses none. In each group of equal entries every member is compared with the smallest, through bit maps whose
difference is a lower bound of that of the sets, and exactly where these leave it open. The links give components;
then in each group that still spans several components members of different components are compared in the same two steps. Members of one component need no further comparison,
so every link that matters for the components is found, and no group is expanded into all its pairs.

Rows: null, empty and blank texts have no shingles and are linked with nothing; a text with fewer words than a shingle is one shingle; rows that
repeat an id are reported each and share the links of their id; rows with a null id are linked with nothing and have a
null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_kb.llm.common import binary_text, materialize, small_batches, whole_words

#: Similarity as a fraction, words a shingle, where the caller does not give them.
NUM, DEN, WORDS = 85, 100, 4
#: Documents whose entries are counted to find dear ones, and the count from which one is dear.
SAMPLE_DOCS, DEAR = 20_000, 20
#: Texts whose entries are combined before the exchange, words a worker keeps, slots of id bit maps, rows of one block comparison.
COMBINE, KEPT_WORDS, SLOT_BITS, BLOCK = 1000, 100_000, 23, 1500
#: Bytes of an entry's hash in a pack, members that one task found in a pack, and the buckets: so many where that keeps them above the least size, more where they would pass the greatest (shingles).
KEY_BYTES, PACK, BUCKETS, LEAST_BUCKET, MOST_BUCKET = 6, 50_000, 1024, 20_000, 500_000
#: Ids that are broadcast, some 50 bytes each.
SENT_IDS = 1_000_000
#: Words of a set's bit map.
BITS = tuple(f"b{i}" for i in range(16))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_KNOWN = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted different 64-bit shingle hashes of a text."""
    found = whole_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(_KNOWN) > KEPT_WORDS:
        _KNOWN.clear()
    h = np.fromiter(map(_KNOWN.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _A
        out ^= out >> np.uint64(31)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return den * common >= num * (len(a) + len(b) - common)


@lru_cache(maxsize=None)
def band_top(band: int, num: int = NUM, den: int = DEN) -> int:
    """Largest size of a band; the next one starts behind it."""
    return 0 if band < 0 else (band_top(band - 1, num, den) + 1) * den // num


def band_of(size: int, num: int = NUM, den: int = DEN) -> int:
    band = 0
    while band_top(band, num, den) < size:
        band += 1
    return band


def differences(band: int, num: int = NUM, den: int = DEN) -> int:
    """Most shingles that two similar sets of this band or the one below can differ in."""
    return 2 * band_top(band, num, den) * (den - num) // (den + num)


def entries(found: np.ndarray, band: int, dear: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set under a band's partition, and which of them are plain subsets of segments."""
    most = differences(band, num, den)
    if not most or not len(found):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    m = most + 1
    salt = np.uint64(band * int(_B) & 0xFFFFFFFFFFFFFFFF)
    segment = (mix(found ^ salt) % np.uint64(m)).astype(np.int64)
    order = np.argsort(segment.astype(np.uint16) if m < 65536 else segment, kind="stable")
    value, segment = mix(found[order] + _B), segment[order]
    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    names, counts, sums = segment[first], np.diff(np.concatenate([first, [len(segment)]])), np.add.reduceat(value, first)
    name_salt = mix(names.astype(np.uint64) + salt + _A)
    plain = mix(sums + name_salt)
    of = np.repeat(np.arange(len(names)), counts)
    if not len(dear) and len(names) == m:
        return plain, np.ones(m, bool)  # nothing is dear: every segment allots 1

    def is_dear(x: np.ndarray) -> np.ndarray:
        if not len(dear):
            return np.zeros(len(x), bool)
        return dear[np.minimum(np.searchsorted(dear, x), len(dear) - 1)] == x

    plain_dear = is_dear(plain)
    short = most + 1 - int((~plain_dear).sum())
    if short <= 0:
        return plain[~plain_dear], np.ones(int((~plain_dear).sum()), bool)
    cut = mix(sums[of] - value + name_salt[of])
    cut_empty = counts[of] == 1
    cut_dear = cut_empty | is_dear(cut)
    twice = ~plain_dear & (np.bincount(of, cut_dear, len(names)) == 0)
    reach = np.flatnonzero(np.cumsum(twice) >= short)
    if len(reach):
        inside = ~cut_dear & (of <= reach[0])
        return np.concatenate([plain[~plain_dear], cut[inside]]), np.concatenate([np.ones(int((~plain_dear).sum()), bool), np.zeros(int(inside.sum()), bool)])
    every = [plain, cut[~cut_empty]]
    if 2 * len(names) - int((counts == 1).sum()) < most + 1:
        every.append(mix((found[: most + 1] ^ _C) + salt))
    return np.concatenate(every), np.concatenate([np.ones(len(plain), bool), np.zeros(sum(map(len, every[1:])), bool)])


def bitmap(found: np.ndarray) -> np.ndarray:
    """1024 bits, each the parity of the number of shingles that hash to it: two of them differ in no more bits than the sets."""
    parity = np.bincount((mix(found + _C) >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(parity.astype(bool)).view(np.int64)


def _slots(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.int64).view(np.uint64) * _A >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_bits(ids: DataFrame) -> np.ndarray:
    """Packed bit map of the slots that the ids (column ``id``) fall into: bounded, and never misses one."""
    found = ids.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(b["id"].to_numpy())))], names=["slot"]) for b in batches), "slot long")
    bits = np.zeros(1 << SLOT_BITS, bool)
    bits[found.distinct().toArrow()["slot"].to_numpy()] = True
    return np.packbits(bits)


def _chosen(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    slots = _slots(batch["doc_id"].to_numpy())
    return batch.filter(pa.array((bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)))


def narrow_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text()).where(F.col("doc_id").isNotNull())


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, text) whose id may be among ``ids``: no text is shuffled to find them."""
    shared, narrow = docs.sparkSession.sparkContext.broadcast(slot_bits(ids)), narrow_texts(docs)
    return narrow.mapInArrow(lambda batches: (_chosen(b, shared.value) for b in batches), narrow.schema)


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, signature of the set (two 64-bit sums) and its bit map, one row a document."""
    names = ["doc_id", "n", "s0", "s1", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3 + len(BITS)), np.int64)
            for i, text in enumerate(batch["text"]):
                found = shingles(text.as_py(), words)
                rows[i, 0] = len(found)
                rows[i, 1:3] = np.array([mix(found).sum(dtype=np.uint64), mix(found ^ _B).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                rows[i, 3:] = bitmap(found)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(rows[:, j]) for j in range(rows.shape[1]))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text()).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names[1:]))


def dear_entries(docs: DataFrame, firsts: DataFrame, rows: int = SAMPLE_DOCS, least: int = DEAR, *, words: int = WORDS, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Subsets of segments that ``least`` of a bounded sample of different sets have. Any list leaves the join exact; it only moves work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            keys = [none]
            for text in batch["text"]:
                found = shingles(text.as_py(), words)
                band = band_of(len(found), num, den)
                keys += [k[p] for k, p in (entries(found, band, none, num, den), entries(found, band + 1, none, num, den))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["key"])

    sample = firsts.select(F.col("first").alias("doc_id")).orderBy(F.xxhash64("first"), "first").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text()).join(F.broadcast(sample), "doc_id", "left_semi")
    counted = texts.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= least)
    return np.sort(counted.select("key").toArrow()["key"].to_numpy().view(np.uint64))


def buckets_of(shingles: int) -> int:
    """Buckets of entries for so many shingles in all: a task holds one at a time."""
    return max(1, min(BUCKETS, shingles // LEAST_BUCKET), -(-shingles // MOST_BUCKET))


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    """The last ``width`` bytes of each number, the first bytes of all numbers first: those are equal or in order and compress well."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T)


def _numbers(planes: np.ndarray) -> np.ndarray:
    rows = np.zeros((planes.shape[1], 8), np.uint8)
    rows[:, 8 - len(planes) :] = planes.T
    return rows.view(">u8").reshape(-1).astype(np.int64)


def groups(docs: DataFrame, ids: DataFrame, dear: np.ndarray, words: int = WORDS, num: int = NUM, den: int = DEN, buckets: int = BUCKETS) -> DataFrame:
    """(entry, id, center): members of groups of equal entries, each with a smaller member of the group; chains end at its smallest.

    Only documents of ``ids`` are indexed (a few others may slip in through the bit map; they are copies and find their own kind).
    """
    shared = docs.sparkSession.sparkContext.broadcast((dear, slot_bits(ids)))

    def packs(bucket: list[int], settled: bool, pack: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([settled] * len(pack), pa.bool_()), pa.array(pack, pa.binary())], names=["bucket", "settled", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dear, bits = shared.value
        for whole in batches:
            whole = _chosen(whole, bits)
            for start in range(0, whole.num_rows, COMBINE):
                batch = whole.slice(start, COMBINE)
                keys, ids = [], []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    found = shingles(text.as_py(), words)
                    if len(found):
                        band = band_of(len(found), num, den)
                        both = np.concatenate([entries(found, band, dear, num, den)[0], entries(found, band + 1, dear, num, den)[0]])
                        keys.append(both >> np.uint64(64 - 8 * KEY_BYTES))
                        ids.append(np.full(len(both), doc_id, np.int64))
                if not sum(map(len, keys)):
                    continue
                key, doc = np.concatenate(keys), np.concatenate(ids)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                head = np.concatenate([[True], key[1:] != key[:-1]])
                center = doc[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
                # members found here go to places of their own, so a frequent entry is not exchanged to one task
                settled = np.flatnonzero(~head & (doc != center))
                planes = np.concatenate([_planes(x, w) for x, w in ((key[settled], KEY_BYTES), (doc[settled], 8), (center[settled], 8))])
                cuts = range(0, len(settled), PACK)
                yield packs([int(mix(np.uint64([doc[0] & 0x7FFFFFFFFFFFFFFF, k]))[0] % np.uint64(buckets)) for k in cuts], True, [planes[:, k : k + PACK].tobytes() for k in cuts])
                key, doc = key[head], doc[head]
                bucket = (key.astype(float) * (buckets / 2 ** (8 * KEY_BYTES))).astype(np.int64)
                planes = np.concatenate([_planes(key, KEY_BYTES), _planes(doc, 8)])
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                yield packs(bucket[first].tolist(), False, [planes[:, i:j].tobytes() for i, j in zip(first, [*first[1:], len(key)], strict=True)])

    def members(key: np.ndarray, doc: np.ndarray, center: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, center)], names=["entry", "id", "center"])

    def met(held: list[bytes]) -> pa.RecordBatch:
        planes = np.concatenate([np.frombuffer(x, np.uint8).reshape(KEY_BYTES + 8, -1) for x in held], 1)
        key, doc = _numbers(planes[:KEY_BYTES]), _numbers(planes[KEY_BYTES:])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        least = doc[np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))]
        other = doc != least
        return members(key[other], doc[other], least[other])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, settled, pack in zip(batch["bucket"].to_pylist(), batch["settled"].to_pylist(), batch["pack"], strict=True):
                if settled:
                    planes = np.frombuffer(pack.as_py(), np.uint8).reshape(KEY_BYTES + 16, -1)
                    yield members(*map(_numbers, (planes[:KEY_BYTES], planes[KEY_BYTES:-8], planes[-8:])))
                    continue
                if bucket != at and held:
                    yield met(held)
                    held = []
                at = bucket
                held.append(pack.as_py())
        if held:
            yield met(held)

    rows = narrow_texts(docs).mapInArrow(run, "bucket long, settled boolean, pack binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "entry long, id long, center long")


def possible(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Pairs (a, b) that sizes and bit maps do not tell apart; an id with several texts is held by any of them."""
    def of(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), *(F.col(x).alias(f"{x}_{name}") for x in ("n", *BITS)))

    both = F.col("n_a") + F.col("n_b")
    apart = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in BITS), F.lit(0))
    near = (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")) & (apart * (den + num) <= both * (den - num))
    return pairs.join(of("b").hint("merge"), "b").join(of("a").hint("merge"), "a").where(near).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Pairs (a, b) of ids whose texts (doc_id, text) are similar, compared exactly."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch["left"], batch["right"], strict=True):
                a = a.as_py()
                if a != last:
                    last, one = a, shingles(a, words)
                keep.append(similar(one, shingles(b.as_py(), words), num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # merge joins: the many partners of one text are split, and nothing depends on fitting a table into memory
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id that each linked id reaches; alternating stars, written after every round."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        near = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(near, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        both = small.select("u", "v").unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(large, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).select("id", F.least("id", "component").alias("component"))


def crossing(members: DataFrame, direct: DataFrame, labels: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Pairs of different components in one group that neither have been compared yet nor can be told apart by the bit maps."""
    of = labels.select(F.col("id").alias("a"), F.col("component").alias("low"))
    to = labels.select(F.col("id").alias("b"), F.col("component").alias("high"))
    apart = direct.join(of, "a", "left").join(to, "b", "left").where(F.coalesce("low", "a") != F.coalesce("high", "b")).select(F.col("a").alias("center"), F.col("b").alias("id"))
    mixed = members.join(apart, ["id", "center"], "left_semi").select("entry").distinct()
    part = materialize(members.join(mixed, "entry", "left_semi"), "mixed")
    # groups with the same smallest member are looked at together, so a pair that shares many entries is met once
    roots = part.groupBy("entry").agg(F.min("center").alias("root"))
    rooted = part.join(roots, "entry").groupBy("root", "id").agg(F.max((F.col("center") == F.col("root")).cast("int")).alias("met_root"))
    everyone = materialize(rooted.unionByName(rooted.select("root", F.col("root").alias("id"), F.lit(0).alias("met_root")).distinct()), "rooted")
    sizes = everyone.groupBy("root").agg(F.count("*").alias("size")).where("size > 2")
    narrow = sets.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("n", *BITS)).alias("s"))
    named = everyone.join(sizes, "root").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # large groups are cut into blocks; every two blocks meet in a task
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda d: F.least(F.col("mine"), d) * F.col("blocks") + F.greatest(F.col("mine"), d)))
    rows = named.join(narrow, "id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("mine", mine).withColumn("met", met)
    placed = rows.select("root", "met", "id", "met_root", "component", "mine", "s.*").repartition("root", "met").sortWithinPartitions("root", "met")
    return placed.mapInArrow(partial(_compare_groups, num=num, den=den), "a long, b long").distinct()


def _compare_groups(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs within each run of equal (root, met); a pair that several groups of the task hold is told once."""
    names = ("root", "met", "id", "met_root", "component", "mine", "n", *BITS)
    held, told = None, set()

    def pairs(x: np.ndarray) -> None:
        root, ids, met, label, mine, n, bits = x[0, 0], x[:, 2], x[:, 3] == 1, x[:, 4], x[:, 5], x[:, 6], x[:, 7:].view(np.uint64)
        two = mine.min() != mine.max()
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            j = j[(label[j] != label[i]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))]
            # the root has been compared with those that met it directly
            j = j[~met[j]] if ids[i] == root else j[ids[j] != root] if met[i] else j
            j = j[mine[j] != mine[i]] if two else j
            if len(j):
                j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64) * (den + num) <= (n[i] + n[j]) * (den - num)]
                told.update((min(int(ids[i]), int(k)), max(int(ids[i]), int(k))) for k in ids[j])

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([p[c] for p in told], pa.int64()) for c in (0, 1)], names=["a", "b"])
        told.clear()
        return out

    for batch in batches:
        table = np.stack([batch[c].cast(pa.int64()).to_numpy() for c in names], 1)
        held = table if held is None else np.concatenate([held, table])
        cuts = np.flatnonzero((held[1:, 0] != held[:-1, 0]) | (held[1:, 1] != held[:-1, 1])) + 1
        first = 0
        for cut in cuts.tolist():
            pairs(held[first:cut])
            first = cut
        held = held[first:]
        if len(told) > 500_000:
            yield flush()
    if held is not None and len(held):
        pairs(held)
    yield flush()


def join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: shingles of ``words`` words, linked from a similarity of num/den."""
    with small_batches(docs.sparkSession):
        sets = materialize(sets_of(docs, words), "sets")
        found = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        firsts = materialize(found.groupBy("n", "s0", "s1").agg(F.min("doc_id").alias("first")), "firsts")
        dear = dear_entries(docs, firsts, words=words, num=num, den=den)
        total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        members = materialize(groups(docs, firsts.select(F.col("first").alias("id")), dear, words, num, den, buckets_of(total)), "groups")
        direct = materialize(members.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "pairs")

        def compared(pairs: DataFrame) -> DataFrame:
            texts = materialize(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id"))), "texts")
            return materialize(verified(pairs, texts, words, num, den), "links")

        links = compared(materialize(possible(direct, sets, num, den), "possible"))
        cross = materialize(crossing(members, direct, components(links), sets, num, den).join(direct, ["a", "b"], "left_anti"), "pairs")
        labels = components(links.unionByName(compared(cross)))
    named = firsts.join(labels.withColumnRenamed("id", "first"), "first", "left").select("n", "s0", "s1", F.coalesce("component", "first").alias("component"))
    return sets.join(named, ["n", "s0", "s1"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, most: int = SENT_IDS) -> DataFrame:
    """The row with the smallest id of each component, with all columns; of rows that repeat an id one stays; rows with a null id all stay.

    Ids that are dropped or repeated go to the rows where their counted number is at most ``most``; beyond it rows and kept ids are shuffled.
    """
    rows = join(docs, words, num, den).where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    found = materialize(rows.agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n")), "kept")
    named, kept = docs.where(F.col("doc_id").isNotNull()), found.where("kept").select("doc_id")
    moved = found.where("n > 1 or not kept").select("doc_id")
    if moved.count() <= most:
        again = named.join(F.broadcast(found.where("n > 1 and kept").select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        one = named.join(F.broadcast(moved), "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
    else:
        one = named.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
