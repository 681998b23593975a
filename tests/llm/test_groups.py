"""SimHash groups, fingerprints and archives against brute force."""

import hashlib
import io
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from zonalvec.llm import archives, components, fingerprint, neardup, simhash
from zonalvec.llm import jaccard as joins
from zonalvec.llm.common import new_folder

from . import helpers


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) * 2 > len(shingles) for b in range(64)]
    return sum(1 << b for b, one in enumerate(bits) if one)


def brute_components(ids, fps, max_bits=4):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= max_bits:
                root[find(a)] = find(b)
    least = {}
    for a in range(len(fps)):
        least[find(a)] = min(least.get(find(a), ids[a]), ids[a])
    return [least[find(a)] for a in range(len(fps))]


def near_texts():
    base = helpers.prose(400, 9).split()
    out = [" ".join(base)]
    for k in range(25):
        w = list(base)
        w[17 * (k % 20)] = f"changed{k}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark):
    texts = helpers.tricky_texts() + near_texts() + ["a b c", "A  B\tc", "x y z w v"]
    ids = [1000 - 3 * i for i in range(len(texts))]
    got = {r.doc_id: r for r in simhash.near_duplicates(helpers.documents(spark, texts, ids).repartition(4)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    for i, f, c in zip(ids, fps, brute_components(ids, fps)):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == c, i
    kept = neardup.one_per_group(helpers.documents(spark, texts, ids))
    assert {r.doc_id for r in kept.collect()} == set(brute_components(ids, fps))
    assert kept.columns == helpers.documents(spark).columns


def test_near_duplicates_of_repeats_and_nothing(spark):
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0
    assert simhash.near_duplicates(helpers.repeated(spark)).count() == 6
    # An id with two different texts keeps both.
    given = helpers.repeated(spark)
    assert Counter((r.doc_id, r.text) for r in neardup.one_per_group(given).collect()) == brute_kept([(r.doc_id, r.text) for r in given.collect()])
    assert neardup.one_per_group(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize(("segments", "together"), [(3, 1), (5, 2), (6, 3)])
def test_links_are_all_pairs_within_four_bits(spark, segments, together):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.int64)}
    for f in list(fps)[:60]:
        for n in range(1, 7):
            g = f
            for b in rng.choice(64, n, replace=False):
                g ^= 1 << int(b)
            fps.add(g - (1 << 64) if g >> 63 else g)
    rows = sorted(fps)
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in rows], "fp long"), 4, segments, together).collect()]
    expected = {(a, b) for a in rows for b in rows if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == expected and expected
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 6, segments, together)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, k) for k in range(201, 260)] + [(5, 5), (1, 0)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {k: 200 for k in range(201, 260)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def weights(text):
    import re

    return Counter(w for w in re.split(fingerprint.SEPARATORS, (text or "").lower()) if w)


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints(spark):
    texts = helpers.tricky_texts() + [helpers.prose(200, k) for k in range(60)]
    docs = helpers.documents(spark, texts).repartition(3)
    rows = fingerprint.fingerprinted(docs).select("*", fingerprint.likeness(F.col("sig"), F.col("edited_sig")).alias("e"), fingerprint.likeness(F.col("sig"), F.col("next_sig")).alias("n"), fingerprint.as_text(F.col("sig")).alias("fp")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    errors = []
    for i, t in enumerate(texts):
        t, follow = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + follow[:k]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        for estimate, truth in ((got[i].e, jaccard(weights(t), weights(edited))), (got[i].n, jaccard(weights(t), weights(follow)))):
            errors.append(estimate - truth)
            assert abs(estimate - truth) < 5 * (truth * (1 - truth) / fingerprint.SAMPLES) ** 0.5 + 1e-9, (i, estimate, truth)
    assert abs(np.mean(errors)) < 0.03
    assert got[6].fp == got[7].fp and len(got[6].fp) == 4 * fingerprint.SAMPLES


def test_fingerprints_of_repeats_one_and_nothing(spark):
    assert fingerprint.fingerprinted(helpers.empty(spark)).count() == 0
    one = fingerprint.fingerprinted(helpers.documents(spark, ["abcd efgh"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one.sig == one.next_sig
    rows = fingerprint.fingerprinted(helpers.repeated(spark)).collect()
    assert Counter(r.doc_id for r in rows) == {4: 2, 7: 2, None: 1, 9: 1}
    assert len({tuple(r.sig) for r in rows if r.doc_id == 4}) == 1


def brute_samples(text, samples):
    """The least ln a of each sample, from the same draws, one term at a time; None without terms."""
    import math

    lns = [math.log((i + 0.5) / 4096) for i in range(4096)]
    out = [math.inf] * samples
    for word, n in weights(text).items():
        term = xxhash64_of_spark(word.encode(), 42)
        for k in range(samples):
            h = xxhash64_of_spark(k, xxhash64_of_spark(term, 42))
            u = [lns[h >> s & 4095] for s in (0, 12, 24, 36)]
            r, ln_c, b = -u[0] - u[1], math.log(-u[2] - u[3]), (h >> 48) / 65536
            out[k] = min(out[k], ln_c - r * (math.floor(math.log(n) / r + b) + 1 - b))
    return out


def xxhash64_of_spark(value, seed):
    """Of bytes, of an unsigned 64-bit number below 2**31 as an int, or of others as a long."""
    if isinstance(value, bytes):
        return xxhash.xxh64_intdigest(value, seed)
    return xxhash.xxh64_intdigest(struct.pack("<I" if value < 1 << 31 else "<Q", value), seed)


def test_samples_are_those_of_brute_force(spark):
    texts = ["alpha beta beta gamma", helpers.prose(80, 3), "über naïve über über", "x"]
    words = [(i, w, n) for i, t in enumerate(texts) for w, n in weights(t).items()]
    terms = spark.createDataFrame(words, "i int, word string, weight long").select("i", F.xxhash64("word").alias("term"), "weight")
    got = {r.i: r.mins for r in fingerprint.signatures(terms, ["i"]).collect()}
    for i, t in enumerate(texts):
        np.testing.assert_allclose(got[i], brute_samples(t, fingerprint.SAMPLES), rtol=1e-9, atol=1e-9)


def test_an_outlier_and_repeated_ids_are_spread(spark):
    ids = [*range(300), 1 << 60, *[7] * 300, *[None] * 200]
    texts = [helpers.prose(5, i) if i < 500 else "same text" for i in range(len(ids))]
    rows, order, _ = fingerprint.with_successors(helpers.documents(spark, texts, ids).repartition(4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == len(ids) and max(sizes) < 2 * len(ids) / 4
    after = {r.key: (r.doc_id, r.next_key) for r in order.collect()}
    assert len(after) == len({n for _, n in after.values()}) == len(ids)
    at, seen = next(iter(after)), []
    for _ in ids:  # one ring in id order, nulls first
        seen.append(after[at][0])
        at = after[at][1]
    first = max(range(len(seen)), key=lambda i: (seen[i - 1] == 1 << 60, i))
    assert seen[first:] + seen[:first] == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_successor_over_gaps(spark):
    ids = [0, 1, 10**12, 10**12 + 5, -(10**15), 7 * 10**15]
    texts = [f"word{i} " * 8 for i in range(6)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.fingerprinted(helpers.documents(spark, texts, ids)).collect()}
    order = sorted(range(6), key=lambda i: ids[i])
    for at, i in enumerate(order):
        t, f = texts[i], texts[order[(at + 1) % 6]]
        assert got[ids[i]] == hashlib.sha256((t[: len(t) - len(t) // 4] + f[: len(t) // 4]).encode()).hexdigest()


def pages(spark):
    long, other = "<html>" + helpers.prose(60, 3) + "</html>", "<p>" + helpers.prose(80, 4)
    rows = [(5, "http://a.b/c d?e=ü", long), (3, None, long), (9, "u", long), (3, "again", long), (4, "x\ny", None), (6, "", ""), (7, "z", "short"), (8, "z", "short"), (11, "o", other), (None, "n", other), (None, "m", "only " * 40), (12, "é", "日本" * 60)]
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n int, record_type string")


def test_archives(spark):
    folder = new_folder(spark, "warc-test")
    files = archives.write(pages(spark).repartition(5), folder)
    rows = archives.read(files, folder, with_payload=True).collect()
    given = pages(spark).collect()
    assert sum(r.records for r in files.collect()) == len(rows) == len(given)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in rows) == Counter((g.page_id, len((g.html or "").encode()), sha(g.html)) for g in given)
    for r in rows:
        own = [g for g in given if sha(g.html) == r.payload_digest]
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and r.refers_to is None
        else:
            assert r.payload_bytes >= 100 and r.payload is None and r.refers_to == min(g.page_id for g in own if g.page_id is not None)
    long = [r for r in rows if r.payload_digest == sha(given[0].html)]
    assert sorted((r.page_id, r.record_type) for r in long) == [(3, "response"), (3, "revisit"), (5, "revisit"), (9, "revisit")]
    assert Counter(r.record_type for r in rows if r.payload_bytes < 100) == {"response": 4}
    assert {r.url for r in rows} >= {"http://a.b/c d?e=ü", "x\ny", "é"}


def test_archive_format(spark):
    folder = new_folder(spark, "warc-test")
    archives.write(pages(spark).coalesce(1), folder).collect()
    from pathlib import Path

    for path in Path(folder.removeprefix("file://")).glob("*.warc.zst"):
        raw = path.read_bytes()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        at, n = 8 + size, 0
        while at < len(raw):  # every record is a frame of its own
            one = coder.decompressobj()
            text = one.decompress(raw[at:])
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            at, n = len(raw) - len(one.unused_data), n + 1
        assert n == sum(1 for _ in archives.records(io.BytesIO(raw)))


def test_dictionary_is_trained_from_many_records():
    many = [archives.record(i, "u", helpers.prose(60, i).encode(), "0" * 64, None, False) for i in range(400)]
    assert archives.dictionary(many).dict_id() != 0
    assert len(archives.dictionary(many[:1]).as_bytes()) > 0


def test_archives_of_nothing(spark):
    folder = new_folder(spark, "warc-test")
    files = archives.write(pages(spark).limit(0), folder)
    assert files.count() == 0 and archives.read(files, folder).count() == 0


def shingles(text, n=5):
    w = simhash.words_of(text)
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def brute_kept(rows):
    """(id, text): the row of least id, nulls last, of each group of rows with the same words or a likeness of 0.8 or more."""
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    sets = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4:
                root[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a])
    return Counter(min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in groups.values())


@pytest.mark.parametrize("leaf", [256, 4])
def test_one_per_group_keeps_the_rows_of_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(joins, "LEAF", leaf)
    rng = np.random.default_rng(8)
    rows, base = [], [f"w{x}" for x in rng.integers(0, 3000, 150)]
    for k in range(60):  # variants of one text, some closer to it than to each other; null and repeated ids, repeated rows
        w = list(base)
        for at in rng.choice(len(w), k % 5, replace=False):
            w[at] = f"new{k}{at}"
        rows.append((None if k % 7 == 0 else k // 2, " ".join(w)))
    rows += [(100 + k, helpers.prose(30 + k, 70 + k)) for k in range(20)] + rows[:5] + [(7, None), (None, ""), (7, "same id"), (7, "other words")]
    expected = brute_kept(rows)
    for parts in (1, 5):
        order = rng.permutation(len(rows))
        docs = helpers.documents(spark, [rows[i][1] for i in order], [rows[i][0] for i in order]).withColumn("_key", F.lit(1)).withColumn("bucket_", F.lit("x")).repartition(parts)
        kept = neardup.one_per_group(docs)
        got = kept.collect()
        assert kept.columns == docs.columns and len(got) == sum(expected.values())
        # Of rows with the same words and id any one may stay.
        plain = lambda t: " ".join((t or "").lower().split())
        assert Counter(r.doc_id for r in got) == Counter(e for (e, _), n in expected.items() for _ in range(n))
        assert {plain(r.text) for r in got if r.doc_id is not None} == {plain(t) for (i, t) in expected if i is not None}


def test_one_per_group_links_five_word_likeness(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 300)) for _ in range(20)]
    near, far = [], []
    for text in base:
        for to, changes in ((near, 5), (far, 16)):
            w = text.split()
            for at in range(10, 290, 280 // changes)[:changes]:
                w[at] = "changed"
            to.append(" ".join(w))
    assert all(likeness(a, b) >= 0.8 for a, b in zip(base, near)) and all(likeness(a, b) < 0.7 for a, b in zip(base, far))
    assert max((brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() for a, b in zip(base, near)) > 5
    kept = {r.doc_id for r in neardup.one_per_group(helpers.documents(spark, base + near + far)).collect()}
    assert kept == set(range(20)) | set(range(40, 60))


def template_family(rng, n=400, pairs=60):
    """Texts that share 300 of 400 words with all others, and near copies of some at 0.8 to 0.85."""
    core = [f"c{x}" for x in rng.integers(0, 900, 300)]
    texts = [core[:150] + [f"o{k}x{i}" for i in range(50)] + core[150:] + [f"e{k}x{i}" for i in range(50)] for k in range(n)]
    for k in range(pairs):
        w = list(texts[k])
        for at in range(7):
            w[20 + 55 * at] = f"new{k}x{at}"
        texts.append(w)
    return [" ".join(t) for t in texts]


def test_templates_lose_no_link_and_order_does_not_matter(spark):
    rng = np.random.default_rng(12)
    texts = template_family(rng)
    planted = [likeness(texts[k], texts[400 + k]) for k in range(60)]
    assert min(planted) >= 0.8 and max(planted) < 0.86 and 0.4 < likeness(texts[0], texts[1]) < 0.8
    kept = []
    for order in (np.arange(len(texts)), rng.permutation(len(texts))):
        docs = helpers.documents(spark, [texts[i] for i in order], [int(i) for i in order]).repartition(6)
        kept.append({r.doc_id for r in neardup.one_per_group(docs).collect()})
    assert kept == [set(range(400))] * 2


def test_of_rows_with_one_id_the_same_stays_in_any_order(spark):
    w = helpers.prose(60, 1).split()
    a, b = " ".join(w), " ".join([*w[:-1], "other"])
    assert likeness(a, b) >= 0.8
    kept = [[r.text for r in neardup.one_per_group(helpers.documents(spark, t, [5, 5])).collect()] for t in ([a, b], [b, a])]
    assert kept[0] == kept[1] and len(kept[0]) == 1


def test_one_row_of_each_group_whatever_its_id(spark):
    a, b, c, d, e = (helpers.prose(60, k) for k in range(50, 55))
    rows = [(None, a), (None, b), (None, c), (3, c), (8, d), (8, e), (8, d)]
    kept = neardup.one_per_group(helpers.documents(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == {(None, a): 1, (None, b): 1, (3, c): 1, (8, d): 1, (8, e): 1}


def test_null_ids_bridge_their_neighbours(spark, monkeypatch):
    def fixed(docs):
        return docs.select("doc_id", F.col("text").cast("long").alias("fp"))

    monkeypatch.setattr(simhash, "fingerprints", fixed)
    got = simhash.near_duplicates(helpers.documents(spark, ["0", "15", "255"], [5, None, 9])).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 5, None: 5, 9: 5}
