"""Deduplication, mixing and media on small tables, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkdr.llm import components, exact_dedup, media, mixing, near_dedup, rules, span_dedup, storage

SCHEMA = "doc_id long, text string, source string, component string, n int"  # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 7) for i, t, s in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.12 else "") for _ in range(n))


def corpus(seed, n=120):
    rng = random.Random(seed)
    rows = [(0, None, "a"), (1, "", None), (2, "  \n", "b"), (3, "One Two", "a"), (4, "one two", "a")]
    texts = []
    for i in range(5, n):
        kind = rng.random()
        if texts and kind < 0.2:
            text = rng.choice(texts)
        elif texts and kind < 0.6:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, max(1, len(words) // 20))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
            text = " ".join(words)
        else:
            text = prose(rng, rng.randint(1, 120))
        texts.append(text)
        rows.append((i, text, rng.choice(["a", "b", "c", None])))
    rows.append((n, prose(rng, 20_000), "long"))
    return rows


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


@pytest.mark.parametrize("seed,broadcast", [(0, 500_000), (1, 0)])
def test_exact_dedup_against_brute_force(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(storage, "BROADCAST_KEYS", broadcast)
    rows = corpus(seed)
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").encode().translate(LOWER)].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for body, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(body).hexdigest()
    kept = exact_dedup.drop_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(v) for v in groups.values())


def test_exact_dedup_repeated_rows_and_empty_table(spark):
    rows = [(1, "A b", "s"), (1, "a B", "s"), (1, "other", "s"), (None, "a b", "s")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in got) == [(False, 1, 1, True), (False, 1, 3, True), (False, 1, 3, True), (True, 1, 3, False)]
    assert exact_dedup.drop_duplicates(frame(spark, rows)).count() == 2
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0 and exact_dedup.drop_duplicates(frame(spark, [])).count() == 0


def shingles_of(text, k):
    w = words_of(text)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_roots(rows, k, percent):
    """Smallest reachable id of each id; an id of several rows is linked by each of their texts."""
    sets = [(i, shingles_of(t, k)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            same = len(a & b)
            if a and b and 100 * same >= percent * (len(a) + len(b) - same):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def brute_components(rows, k, percent):
    roots = brute_roots(rows, k, percent)
    return {i: (len(shingles_of(t, k)), roots[i]) for i, t, _ in rows}


@pytest.mark.parametrize("seed,words,blocks", [(0, 4, 256), (1, 5, 256), (2, 4, 3), (3, 4, 3)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, seed, words, blocks):
    monkeypatch.setattr(storage, "BROADCAST_KEYS", 500_000 if seed else 0)
    rows = corpus(seed)
    want = brute_components(rows, words, 80)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, rows), words=words, block_texts=blocks).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def near_values(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or -1, r.kept) for r in df.collect())


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    rows = [(7, "a b", "s"), (7, "a b", "s"), (9, "A  B", "s"), (8, None, "s"), (6, "", "s"), (None, "a b", "s")]
    got = near_values(near_dedup.near_duplicates(frame(spark, rows)))
    assert got == [(False, 6, 0, 6, True), (False, 7, 1, 7, True), (False, 7, 1, 7, True), (False, 8, 0, 8, True), (False, 9, 1, 7, False), (True, 0, 1, -1, True)]
    kept = near_dedup.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 6), (False, 7), (False, 7), (False, 8), (True, None)]
    odd = frame(spark, rows).select("doc_id", "text", F.lit(1).alias("__id"), F.lit(2).alias("id"), F.lit(3).alias("row"), F.lit(4).alias("a name.with dot"))
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3, 4)}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_near_duplicates_of_repeated_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(storage, "BROADCAST_KEYS", broadcast)
    rng = random.Random(6)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(5, b, "s"), (5, a, "s"), (9, a + " z", "s"), (10, b + " z", "s"), (12, c, "s"), (11, c + " y", "s"), (11, a + " y", "s"), (13, None, "s"), (13, c, "s"), (5, a, "s"), (20, "own text of its own", "s"), (None, a, "s")]
    roots = brute_roots(rows, 5, 80)
    assert {roots[i] for i in (5, 9, 10, 11, 12, 13)} == {5}
    root = lambda i, t: i if i is None or not t else roots[i]
    want = sorted((i is None, i or 0, len(shingles_of(t, 5)), root(i, t) or -1, root(i, t) == i) for i, t, _ in rows)
    for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(3)):
        assert near_values(near_dedup.near_duplicates(df)) == want


def test_texts_that_share_a_minor_part_do_not_chain(spark, monkeypatch):
    """Texts of pairwise similarity near 0.4: buckets of two are settled by their own comparison."""
    rng = random.Random(8)
    furniture = prose(rng, 60)
    rows = [(i, furniture + " " + prose(rng, 45, 5_000), "s") for i in range(60)] + [(100, furniture + " " + prose(rng, 3), "s"), (101, furniture, "s")]
    seen = []
    keep = near_dedup.verified_links
    monkeypatch.setattr(near_dedup, "verified_links", lambda texts, *rest: (seen.append(texts.select("cluster", "id").distinct().count()), keep(texts, *rest))[1])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_roots(rows, 5, 80)
    assert got[101] == 100
    print("compared in full:", seen)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(i + 1, i) for i in range(60)], [(i, 0) for i in range(1, 40)] + [(100, 99)]])
def test_connected_components(spark, links):
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "u long, v long").repartition(3)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def sentences_of(text):
    raw, out, current = (text or "").encode(), [], []
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    for n, (a, b) in enumerate(spans):
        w = raw[a:b]
        current.append(w.translate(LOWER))
        after = raw[b : spans[n + 1][0]] if n + 1 < len(spans) else b"\n"
        if w[-1:] in b".!?" or len(w) > 1 and w[-1:] in b"\"')]" and w[-2:-1] in b".!?" or b"\n" in after:
            out.append(current)
            current = []
    return out


def brute_spans(spark, rows, span, least):
    """Per row its sentences and those removed; spans and passages compared word by word."""
    keys = spark.createDataFrame([(i, t) for i, t, _ in rows], "i long, t string").select("i", "t", F.xxhash64(F.coalesce("t", F.lit(""))).alias("k")).collect()
    texts = {}
    for r in keys:
        texts[(r.i is None, r.i or 0, r.k)] = r.t
    first, result = {}, {}
    for place in sorted(texts):
        s = sentences_of(texts[place])
        words, at = [w for x in s for w in x], [0]
        for x in s:
            at.append(at[-1] + len(x))
        own, gone = {}, set()
        for a in range(len(s) - span + 1):
            key = tuple(words[at[a] : at[a + span]])
            others = [first[key]] if key in first else []
            others += [own[key]] if key in own else []
            for other, p in others:
                left = right = 0
                while at[a] - left > 0 and p - left > 0 and words[at[a] - left - 1] == other[p - left - 1]:
                    left += 1
                q, z = p + len(key), at[a + span]
                while z + right < len(words) and q + right < len(other) and words[z + right] == other[q + right]:
                    right += 1
                if left + len(key) + right >= least:
                    gone.update(range(a, a + span))
            own.setdefault(key, (words, at[a]))
        for key, value in own.items():
            first.setdefault(key, value)
        result[place] = (s, gone)
    return [result[(r.i is None, r.i or 0, r.k)] for r in keys]


def check_spans(spark, rows, **options):
    out = collections.Counter((r.doc_id, r.n_sentences, r.n_removed, r.n_words, r.n_words_removed, tuple(words_of(r.text))) for r in span_dedup.remove_repeated_spans(frame(spark, rows), **options).collect())
    want = collections.Counter()
    for (i, _, _), (s, gone) in zip(rows, brute_spans(spark, rows, options.get("span", 3), options.get("least_words", 0))):
        kept = tuple(w for n, x in enumerate(s) if n not in gone for w in x)
        total = sum(map(len, s))
        want[i, len(s), len(gone), total, total - len(kept), kept] += 1
    assert out == want
    return out


PASSAGE = "Alpha beta gamma delta. Epsilon zeta eta theta! Iota kappa lambda mu? Nu xi omicron pi. "


@pytest.mark.parametrize("seed,span,least", [(0, 2, 0), (1, 3, 0), (2, 2, 15), (3, 2, 50)])
def test_span_dedup_against_brute_force(spark, seed, span, least):
    rng = random.Random(seed)
    rows = corpus(seed)
    rows += [(1000 + i, prose(rng, 30) + ".\n" + PASSAGE * 3 + "\n" + prose(rng, 20), "p") for i in range(4)]
    # a passage whose ends are joined to other words
    middle = prose(rng, 25).replace(".", "") + " " + PASSAGE + prose(rng, 25).replace(".", "")
    rows += [(1100 + i, prose(rng, 30 + i) + " own" + str(i) + " " + middle + " other" + str(i) + " " + prose(rng, 9) + ".", "p") for i in range(3)]
    rows.append((2000, "Same here now. " * 12, "r"))
    rows += [(5, PASSAGE * 2, "s"), (5, PASSAGE + PASSAGE.upper(), "s"), (5, PASSAGE * 2, "s"), (5, "Own words. " + PASSAGE * 2, "s"), (None, PASSAGE * 2, "s"), (None, "Other. " + PASSAGE * 2, None), (None, None, "s")]
    out = check_spans(spark, rows, span=span, least_words=least)
    assert any(x[2] for x in out) and any(x[0] is None and x[2] == x[1] > 0 for x in out) == (least < 50)


def test_span_dedup_small_cases(spark):
    short = "One two three four five. Six seven eight nine ten eleven. Twelve thirteen fourteen fifteen six seven."
    got = {x[0]: x[2] for x in check_spans(spark, [(i, short, "s") for i in (3, 1, 2)])}
    assert got == {1: 0, 2: 3, 3: 3}
    # one long sentence is no run of several
    long = "word " * 45 + "end."
    assert not any(x[2] for x in check_spans(spark, [(1, long, "s"), (2, long, "s")], span=2))
    assert span_dedup.remove_repeated_spans(frame(spark, [])).count() == 0
    assert span_dedup.remove_repeated_spans(frame(spark, []), least_words=50).count() == 0
    # of passages of 50 words and more all but the first go, furniture stays
    rng = random.Random(1)
    passage, furniture = prose(rng, 60) + ". And so on.", "Read more here. Share this page."
    rows = [(i, prose(rng, 40) + ". " + furniture + " " + (passage if i < 3 else "") + " " + prose(rng, 30) + ".", "s") for i in range(9)]
    got = {x[0]: x[4] for x in check_spans(spark, rows, span=2, least_words=50)}
    assert all(got[i] == 0 for i in (0, *range(3, 9))) and all(got[i] >= 40 for i in (1, 2))


def water(sizes, weights, cap=3):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i] + 1e-9]
        for i in full or open_:
            target[i] = cap * sizes[i] if full else weights[i] * unit
        if not full:
            break
        open_ -= set(full)
    return target


@pytest.mark.parametrize("seed", range(2))
def test_mixing_meets_targets(spark, seed):
    rows = corpus(seed, 300)
    out = {r.doc_id: r for r in mixing.mix(frame(spark, rows), block_words=4, shard_words=500).collect()}
    again = {r.doc_id: r for r in mixing.mix(frame(spark, rows).repartition(5), block_words=4, shard_words=500).collect()}
    assert out == again and len(out) == len(rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    size = {i: len(words_of(t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = [sum(size[i] for i in size if source[i] == s) for s in names]
    targets = water(sizes, [n % 3 + 1 for n in range(len(names))])
    for s, total, target in zip(names, sizes, targets):
        own = [out[i] for i in out if source[i] == s]
        assert all(r.size == size[r.doc_id] and r.source_size == total and abs(r.target - target) < 1e-6 * max(1, target) for r in own)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 8, (s, target)
    mixed = mixing.apply_mix(frame(spark, rows), block_words=4, shard_words=500)
    assert mixed.columns == frame(spark, rows).columns
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert all(counts[i] == (int(r.taken / r.size + 0.5) if r.size else 1) for i, r in out.items())


def odd_names(spark, rows):
    """Rows with columns whose names the operators might use themselves."""
    names = ["row", "id", "__id", "__sha", "sha", "__gone", "gone_id", "__copies", "copies", "copy", "hash", "sn", "size", "n_words", "score", "a name", "with.dot", "component"]
    return frame(spark, rows).select("doc_id", "text", "source", *[F.lit(n).alias(name) for n, name in enumerate(names)])


def test_whole_rows_stay_whole(spark):
    rows = [(1, "a b c d", "s"), (2, "A b c d", "s"), (3, "other words here", None), (None, "null id text", "s"), (4, None, "s"), (None, None, None), (5, "a b", "s"), (5, "c d", "s")]
    docs = odd_names(spark, rows)
    bare = rules.RuleModel(2.0, [], 0.9)
    for out, ids in (
        (exact_dedup.drop_duplicates(docs), [None, 2, 3, 4, 5, 5]),
        (near_dedup.drop_near_duplicates(docs), [None, None, 1, 3, 4, 5, 5]),
        (rules.keep_quality(docs, bare), [None, None, 1, 2, 3, 4, 5, 5]),
        (mixing.apply_mix(docs), None),
    ):
        assert out.columns == docs.columns
        got = out.collect()
        assert {tuple(r)[3:] for r in got} == {tuple(range(len(docs.columns) - 3))}
        if ids is not None:
            assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0)) == ids
    # rows without words stay once in the mix
    assert sum(r.text is None for r in mixing.apply_mix(docs).collect()) == 2


def test_mixing_of_repeated_and_null_ids(spark):
    rows = [(1, "w " * 40, "a"), (1, "x " * 30, "a"), (None, "y " * 50, "a"), (None, "z " * 10, "b"), (2, "v " * 60, "b"), (1, "w " * 40, "b")]
    out = mixing.mix(frame(spark, rows)).collect()
    again = mixing.mix(frame(spark, rows[::-1]).repartition(4)).collect()
    place = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.taken)
    assert sorted(map(place, out)) == sorted(map(place, again)) and len(out) == len(rows)
    for size in (120, 110):
        own = [r for r in out if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    # blocks come from all over a stream, not from one run
    long = mixing.mix(frame(spark, [(i, "w " * 40, "a") for i in range(200)] + [(i, "w " * 40, "b") for i in range(200, 400)]), shard_words=10**6).collect()
    partly = [r for r in long if r.source_size == 8000 and r.doc_id < 200 and 0 < r.taken < 40]
    assert len(partly) > 100


def test_mixing_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = mixing.mix(frame(spark, [(1, None, None), (2, "", "a"), (3, " ", "b")])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (3, 0, 0, 0.0, 0)]
    # one source of a third of all rows and one that stops at three times its size
    rows = mixing.mix(frame(spark, [(i, "w " * 50, "a") for i in range(40)] + [(100, "w " * 10, "b"), (101, "w", None)])).collect()
    assert 28 <= sum(r.taken for r in rows if r.doc_id == 100) <= 30 and sum(r.taken for r in rows if r.doc_id == 101) <= 3


def sainte_lague(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        i = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_against_highest_quotients(spark, seed):
    rng = random.Random(seed)
    weights = [rng.choice([0.0, rng.random() ** 4 * 1000, rng.random()]) for _ in range(rng.randint(1, 40))] + [1.7]
    seats = rng.choice([0, 1, 7, 60, 1000])
    df = spark.createDataFrame([(0, i, w, seats) for i, w in enumerate(weights)], "g int, k int, w double, seats long")
    got = {r.k: r.q for r in mixing.apportion(df, ["g"], ["k"], "w", "seats", "q").collect()}
    assert [got[i] for i in range(len(weights))] == sainte_lague(weights, seats)


GEAR = np.random.default_rng(0x6EA2).integers(0, 2**32, 256, dtype=np.uint32).tolist()


def naive_chunks(payload):
    """Byte by byte: a rolling gear hash of the last 32 bytes, cuts of 1 to 16 KiB."""
    out, begin, h = [], 0, 0
    for i, byte in enumerate(payload):
        h = ((h << 1) + GEAR[byte]) % 2**32
        size = i + 1 - begin
        if i + 1 < len(payload) and (size >= 1024 and h >> 21 == 0 or size == 16_384):
            out.append(payload[begin : i + 1])
            begin = i + 1
    return [*out, payload[begin:]]


def naive_medium(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    chunks = naive_chunks(payload)
    head = b"CDC8\x01" + len(raw).to_bytes(8, "big") + len(chunks).to_bytes(4, "big")
    file = head + b"".join(hashlib.sha256(c).digest() + len(c).to_bytes(4, "big") for c in chunks) + b"".join(dict.fromkeys(chunks))
    levels = collections.Counter(x // 16 for x in payload)
    feature = f"chunks:{len(chunks)};levels:" + ",".join(str(levels[i]) for i in range(16))
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature)


def media_values(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in rows)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_media_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(storage, "BROADCAST_KEYS", broadcast)
    rng = random.Random(3)
    shared = prose(rng, 2_000)
    rows = corpus(1) + [(5000 + i, prose(rng, 300) + shared + prose(rng, 300), "m") for i in range(4)] + [(6000, "z" * 60_000, "m")]
    got = media.store_and_read(frame(spark, rows)).collect()
    assert media_values(got) == sorted((False, i, *naive_medium(t)) for i, t, _ in rows)
    listed, stored = media.store(frame(spark, rows))
    kept = media.lent_chunks(stored).collect()
    assert kept and len(kept) == len({r.digest for r in kept})
    # every chunk is kept once: the own bytes add up to the distinct chunks of all texts
    expand = zstandard.ZstdDecompressor()
    held = sum(len(expand.decompress(r.own)) for r in stored.collect())
    every = {c for _, t, _ in rows for c in naive_chunks(media.payload_of((t or "").encode()))}
    assert held == sum(map(len, every)) and stored.count() == len({t or "" for _, t, _ in rows})
    assert media_values(media.read_back(listed, stored).collect()) == media_values(got)
    assert media.store_and_read(frame(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_media_of_repeated_and_null_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(storage, "BROADCAST_KEYS", broadcast)
    rng = random.Random(4)
    a, b = prose(rng, 3_000), prose(rng, 2_000)
    rows = [(5, a, "s"), (5, b, "s"), (9, a, "s"), (5, a, "s"), (None, b + a, None), (None, a, "s"), (None, None, "s"), (None, None, "s"), (7, "", "s"), (8, b + "x", "s")]
    got = media.store_and_read(frame(spark, rows)).collect()
    assert media_values(got) == sorted((i is None, i or 0, *naive_medium(t)) for i, t, _ in rows)


def test_media_tells_of_damage_in_the_store(spark):
    rng = random.Random(5)
    shared = prose(rng, 4_000)
    listed, stored = media.store(frame(spark, [(1, shared + "one", "s"), (2, shared + "two", "s")]))
    swap = stored.withColumn("own", F.when(F.size("lent") > 0, F.lit(zstandard.ZstdCompressor().compress(b"q" * 60_000))).otherwise(F.col("own")))
    with pytest.raises(Exception, match="does not match its digest"):
        media.read_back(listed, swap).collect()


def test_media_detects_damage():
    payload = media.payload_of(b"some text " * 900)
    chunks = media.chunks_of(payload)
    recipe, _ = media.make_recipe(9000, chunks)
    assert b"".join(chunks) == payload and all(len(c) <= media.MOST for c in chunks)
    assert media.restore(recipe, media.own_chunks(recipe, payload, ()), {})[0] == payload
    with pytest.raises(ValueError):
        media.restore(recipe, b"x" + payload[1:], {})
    # an insertion early on leaves later chunks alone
    rng = random.Random(0)
    base = bytes(rng.randrange(97, 123) for _ in range(40_000))
    a, b = media.chunks_of(base), media.chunks_of(b"inserted" + base)
    assert len(set(a) & set(b)) >= len(a) - 3


def test_hash_of_words_and_sets_is_stable_over_batches(spark):
    rows = corpus(2)
    one = {r.id: (r.n, r.d1, r.d2) for r in near_dedup.signatures(frame(spark, rows).select(F.col("doc_id").alias("id"), "text").coalesce(1), 4, 2, 2).collect()}
    many = {r.id: (r.n, r.d1, r.d2) for r in near_dedup.signatures(frame(spark, rows).select(F.col("doc_id").alias("id"), "text").repartition(7), 4, 2, 2).collect()}
    assert one == many
