"""Near duplicates by MinHash with tensored banding, candidates verified on full sets.

Signatures: two small collections of ``tables`` sub-keys, each made of ``rows`` minhashes
of a text's word shingles.  Every pair of a sub-key of the first and one of the second
collection is the key of one table, so ``tables ** 2`` tables of ``2 * rows`` minhashes
cost only ``2 * tables * rows`` minhash computations.  With the defaults (20 and 4: 400
tables from 160 minhashes) two texts of similarity 0.8 share a table with probability
0.99995 (0.16 at 0.4, 0.02 at 0.3).

Candidates: texts with equal sets are one class, represented by its smallest id.  Every
representative is paired with the smallest one (the centre) in each of its tables'
buckets, and every such pair is verified on full sets before anything is chained: a centre
meets its partners in places of bounded size.  No pairs of a bucket are emitted.

What is left are buckets whose other members fall in several of the components found so
far (a bucket of two never does).  Only these components are chained to clusters; the texts
of a cluster are dealt into blocks of bounded number and size, and every two blocks of a
cluster meet in one place, where sets are intersected in full.  A union-find that starts
from the components skips pairs that are connected, and only links of a spanning forest
come out; components of all links are the result.  No cap drops pairs: a centre with many
partners has more places, a large cluster more blocks.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing (their rows' component is their id); fewer than ``words`` words are one shingle; an id that several rows have is one
document with all their texts: it is linked by each of them, and each row has a result
row; rows with a null id are left out of linking, have a null component and are kept; an
empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import components, hashing, storage

U64 = np.uint64
_SEEDS = np.random.default_rng(0xD0C5).integers(1, 2**63, 4096, dtype=np.uint64) * U64(2) + U64(1)


def minhashes(shingles: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """``(texts with shingles, n)`` minhashes: the least of ``seed * shingle`` modulo 2**64."""
    sizes = sizes[sizes > 0]
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out = np.empty((len(sizes), n), U64)
    if len(sizes):
        for k in range(n):
            out[:, k] = np.minimum.reduceat(shingles * _SEEDS[k], first)
    return out


def sub_keys(shingles: np.ndarray, sizes: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """``(texts with shingles, 2 * tables)`` sub-keys: the first collection, then the second."""
    mins = minhashes(shingles, sizes, 2 * tables * rows)
    out = np.empty((len(mins), 2 * tables), np.int64)
    for t in range(2 * tables):
        key = np.full(len(mins), t, U64)
        for r in range(rows):
            key = hashing.mix(key * U64(0x9E3779B97F4A7C15) + mins[:, t * rows + r])
        out[:, t] = key.view(np.int64)
    return out


#: Texts and bytes that a worker hashes at once.
_SLICE_ROWS = 512


def _slices(batch, text_at: int):
    """Parts of a batch of few rows each, with the bytes and offsets of their texts."""
    for at in range(0, batch.num_rows, _SLICE_ROWS):
        part = batch.slice(at, _SLICE_ROWS)
        yield part, *hashing.utf8_batch(part.column(text_at))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted and concatenated, and their numbers."""
    return hashing.distinct_sets(*hashing.shingle_hashes(*hashing.word_hashes(data, offsets), words))


def signatures(docs: DataFrame, words: int, tables: int, rows: int) -> DataFrame:
    """``(id, n, d1, d2, a array<long>, b array<long>)`` of each row; digests and keys null without shingles."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part, data, offsets in _slices(batch, 1):
                sets, sizes = shingle_sets(data, offsets, words)
                some = sizes > 0
                keys = sub_keys(sets, sizes, tables, rows)
                first = np.concatenate(([0], np.cumsum(sizes[some])))[:-1]
                digests = [np.add.reduceat(hashing.mix(sets * s), first) if len(first) else np.zeros(0, U64) for s in _SEEDS[-2:]]
                place = pa.array(np.where(some, np.cumsum(some) - 1, -1), mask=~some)
                lists = lambda k: pa.FixedSizeListArray.from_arrays(pa.array(k.reshape(-1), pa.int64()), tables).cast(pa.list_(pa.int64())).take(place)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), *(pa.array(d.view(np.int64)).take(place) for d in digests), lists(np.ascontiguousarray(keys[:, :tables])), lists(np.ascontiguousarray(keys[:, tables:]))],
                    ["id", "n", "d1", "d2", "a", "b"],
                )

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, a array<long>, b array<long>")


def bucket_keys(representatives: DataFrame) -> DataFrame:
    """``(id, key, least, n)``: the shared buckets of each representative, their smallest one and number of entries.

    A table's bucket can only be shared where both of its sub-keys are, so sub-keys that
    one text alone has go first, and tables are formed from the rest.
    """
    positions = lambda c, first: F.transform(c, lambda x: F.struct(F.lit(first).alias("first"), x.alias("sub")))
    parts = representatives.select("id", F.explode(F.concat(positions("a", True), positions("b", False))).alias("k")).select("id", "k.first", "k.sub")
    shared = parts.groupBy("sub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sub")
    shared = parts.join(storage.materialize(shared, "sub-keys"), "sub")
    side = lambda first: F.collect_set(F.when(F.col("first") == first, F.col("sub")))
    keyed = shared.groupBy("id").agg(side(True).alias("a"), side(False).alias("b"))
    keyed = keyed.select("id", F.explode("a").alias("x"), "b").select("id", "x", F.explode("b").alias("y"))
    keyed = storage.materialize(keyed.select("id", F.xxhash64("x", "y").alias("key")), "keys")
    buckets = keyed.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = storage.materialize(keyed.join(storage.materialize(buckets, "buckets"), "key").filter("id > least").select("id", "key", "least", "n"), "bucket-keys")
    storage.discard(keyed)
    return out


def centre_links(texts: DataFrame, pairs: DataFrame, words: int, percent: int, place_texts: int = 512) -> DataFrame:
    """Those of the pairs ``(u, v)`` (``v`` the centre) that are similar on full sets.

    ``texts``: ``(id, text)``; an id of several texts is compared by each of them.
    """
    import pyarrow as pa

    places = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / place_texts).cast("long").alias("places"))
    places = storage.materialize(places, "centres")
    partners = pairs.join(places, "v").select(F.col("u").alias("id"), "v", F.pmod(F.xxhash64("u"), F.col("places")).alias("place"), F.lit(1).alias("turn"))
    centres = places.select(F.col("v").alias("id"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"), F.lit(0).alias("turn"))
    met = storage.materialize(partners.unionByName(centres), "meetings")
    met = texts.join(storage.sized(met), "id").select("v", "place", "turn", "id", "text")
    met = met.repartition("v", "place").sortWithinPartitions("v", "place", "turn", "id")

    def run(batches):
        key, centre = None, []
        for batch in batches:
            for part, data, offsets in _slices(batch, 4):
                hashes, sizes = shingle_sets(data, offsets, words)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                found = []
                for i, (v, place, turn, u) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)))):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    if turn == 0:
                        if (v, place) != key:
                            key, centre = (v, place), []
                        centre.append(own.copy())
                    elif any(similar(own, c, percent) for c in centre):
                        found.append((u, v))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

    return met.mapInArrow(run, "u long, v long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether ``100 * |A & B| >= percent * |A | B|`` of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def verified_links(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``(u, v)`` of a spanning forest of similar texts within each pair of blocks.

    ``texts``: ``(cluster, blocks, id, component, text)``; texts of one component are linked already.
    """
    import pyarrow as pa

    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "id", "component", "text")
    groups = dealt.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "id")

    def compare(ids, known, sets):
        """Spanning forest of the texts of one group."""
        n = len(ids)
        sizes = np.array([len(s) for s in sets])
        if n == 2:
            return [(ids[1], ids[0])] if known[0] != known[1] and similar(sets[0], sets[1], percent) else []
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        _, first, of = np.unique(np.array(known), return_index=True, return_inverse=True)
        root = first[of]
        mark = np.zeros(len(every), bool)
        links = []
        for x in range(n - 1):
            rest = np.arange(x + 1, n)
            small, large = np.minimum(sizes[rest], sizes[x]), np.maximum(sizes[rest], sizes[x])
            rest = rest[(100 * small >= percent * large) & (root[rest] != root[x])]
            if not len(rest):
                continue
            mine = place[bounds[x] : bounds[x + 1]]
            mark[mine] = True
            if len(rest) * 4 >= n - x:
                held = np.add.reduceat(mark[place[bounds[x + 1] :]], bounds[x + 1 : n] - bounds[x + 1], dtype=np.int64)[rest - x - 1]
            else:
                held = np.array([np.count_nonzero(mark[place[bounds[y] : bounds[y + 1]]]) for y in rest])
            mark[mine] = False
            for y in rest[100 * held >= percent * (sizes[rest] + sizes[x] - held)]:
                a, b = root[x], root[y]
                if a != b:
                    root[root == max(a, b)] = min(a, b)
                    links.append((ids[y], ids[x]))
        return links

    def run(batches):
        key, ids, known, sets = None, [], [], []

        def done():
            order = sorted(range(len(ids)), key=ids.__getitem__)
            found = compare(*([x[i] for i in order] for x in (ids, known, sets))) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for part, data, offsets in _slices(batch, 5):
                hashes, sizes = shingle_sets(data, offsets, words)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                for i, new in enumerate(zip(*(part.column(c).to_pylist() for c in range(5)))):
                    if new[:3] != key:
                        if len(ids) > 1:
                            yield done()
                        key, ids, known, sets = new[:3], [], [], []
                    if sizes[i]:
                        ids.append(new[3])
                        known.append(new[4])
                        sets.append(hashes[bounds[i] : bounds[i + 1]].copy())
        if len(ids) > 1:
            yield done()

    return groups.mapInArrow(run, "u long, v long")


def _remaining(keys: DataFrame, found: DataFrame, sizes: DataFrame, block_texts: int, block_shingles: int) -> DataFrame:
    """``(id, cluster, blocks, component)`` of the components that share a bucket with another one, beside its centre.

    A component counts once in a bucket, however many of its texts are there.
    """
    of = F.coalesce("component", "id")
    held = keys.filter("n > 2").select("id", "key").join(found.withColumnRenamed("node", "id"), "id", "left").select(of.alias("u"), "key").distinct()
    held = storage.materialize(held, "component-keys")
    open_ = held.groupBy("key").agg(F.min("u").alias("v"), F.max("u").alias("high")).filter("v < high").select("key", "v")
    met = held.join(storage.materialize(open_, "open-buckets"), "key").filter("u > v").select("u", "v").distinct()
    clusters = storage.materialize(components.connected_components(met), "clusters")
    clusters = clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")).unionByName(clusters.select("component", F.col("component").alias("cluster")).distinct())
    members = clusters.join(found, "component").select(F.col("node").alias("id"), "cluster", "component")
    members = members.unionByName(clusters.select(F.col("component").alias("id"), "cluster", "component")).join(sizes, "id")
    # blocks grow with their cluster (up to 32 times), so that its texts are not copied to ever more places
    n = F.count(F.lit(1))
    block = F.greatest(F.lit(block_texts), F.least(F.lit(32 * block_texts), F.floor(n / 32)))
    blocks = F.greatest(F.ceil(n / block), F.ceil(F.sum("n") / block_shingles))
    dealt = members.groupBy("cluster").agg(blocks.cast("long").alias("blocks"))
    return storage.materialize(members.join(dealt, "cluster").select("id", "cluster", "blocks", "component"), "members")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, tables: int = 20, rows: int = 4, block_texts: int = 128, block_shingles: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row.

    Two texts are linked when ``100 * |A & B| >= percent * |A | B|`` of their sets of
    ``words``-word shingles; ``component_id`` is the smallest id reachable over links.
    """
    storage.bound_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    signed = storage.materialize(signatures(texts, words, tables, rows), "signatures")
    some = signed.filter("n > 0 and id is not null")
    same = ["d1", "d2", "n"]
    classes = storage.materialize(some.groupBy(*same).agg(F.min("id").alias("least")), "classes")
    # ids of several rows: they are one document; whole texts are only then made distinct
    often = some.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{name}_{c}") for c in same for name, f in (("low", F.min), ("high", F.max))]).filter("rows > 1")
    often = storage.materialize(often.select("id", F.expr(" or ".join(f"low_{c} < high_{c}" for c in same)).alias("differ")), "repeated-ids")
    repeated, differing = often.agg(F.count(F.lit(1)), F.count(F.when(F.col("differ"), True))).first()
    representatives = some.join(classes.withColumnRenamed("least", "id"), [*same, "id"], "left_semi")
    if repeated:
        representatives = representatives.dropDuplicates([*same, "id"])
        texts = texts.withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"]).drop("hash")
    keys = bucket_keys(representatives)
    pairs = storage.materialize(keys.select(F.col("id").alias("u"), F.col("least").alias("v")).distinct(), "pairs")
    links = centre_links(texts, pairs, words, percent)
    if differing:
        own = some.join(often.filter("differ"), "id").join(classes, same).select("id", "least").distinct()
        own = storage.materialize(own, "texts-of-ids")
        links = links.unionByName(own.join(own.groupBy("id").agg(F.min("least").alias("v")), "id").select(F.col("least").alias("u"), "v"))
    found = storage.materialize(components.connected_components(links), "components")
    sizes = some.groupBy("id").agg(F.max("n").alias("n"))
    members = _remaining(keys, found, sizes, block_texts, block_shingles)
    storage.discard(keys)
    links = verified_links(texts.join(storage.sized(members), "id"), words, percent)
    links = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)
    linked = storage.materialize(components.connected_components(links), "components")
    classes = classes.join(linked.withColumnRenamed("node", "least"), "least", "left")
    classes = storage.materialize(classes.select(*same, F.coalesce("component", "least").alias("component")), "classes")
    out = signed.select("id", *same).join(classes, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def near_duplicates_sql(words: int = 5, percent: int = 80) -> str:
    """DuckDB SQL of :func:`near_duplicates` over ``documents`` with distinct, not null ids: all texts that share a shingle are compared."""
    return f"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {words - 1}, least(len(w), 1)) + 1),
                                                        lambda i: array_to_string(w[i:i + {words - 1}], ' '))) AS s
            FROM texts
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS u, b.doc_id AS v
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
        ), reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
        )
        SELECT s.doc_id, len(s.s) AS n_shingles, component_id, s.doc_id = component_id AS kept
        FROM sets s JOIN least USING (doc_id)
    """


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest (or null), with all their columns, whatever their names."""
    marked = near_duplicates(docs, id_column=id_column, text_column=text_column, **options)
    dropped = storage.materialize(marked.filter("not kept").select(F.col(f"`{id_column}`").alias("id")).distinct(), "dropped")
    whole = storage.carried(docs, id=F.col(f"`{id_column}`").cast("long"))
    return whole.join(storage.sized(dropped), "id", "left_anti").select("row.*")
