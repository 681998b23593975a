"""The registered queries: columns, types and rows against brute force over a whole small table."""

import hashlib
import zlib

import numpy as np
import pytest

from zonalvec.llm import fingerprint, packing, queries, simhash
from zonalvec.llm.common import table

from .test_groups import brute_components, brute_fingerprint

DATA = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_warc_archives": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op12_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def given(spark):
    return sorted((r.doc_id, r.text or "") for r in table(spark, DATA, "documents").collect())


def result(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split(", ")) <= {f"{c} {t}" for c, t in df.dtypes}
    return df.collect()


@pytest.mark.parametrize("name", ["op3_license_scan", "op4_quality_classifier", "op5_warc_archives", "op6_benchmark_decontamination", "op9_language_id"])
def test_columns(spark, name):
    rows = result(spark, name)
    assert len(rows) == table(spark, DATA, "pages" if "op5" in name else "documents").count()


def test_fingerprints(spark, given):
    rows = {r.doc_id: r for r in result(spark, "op1_document_fingerprints")}
    assert len(rows) == len(given)
    fingerprints = {}
    for at, (i, t) in enumerate(given):
        follow, k = given[(at + 1) % len(given)], len(t) // 4
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + follow[1][:k]).encode()).hexdigest()
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * fingerprint.SAMPLES and 0 <= r.near_edited <= 1
        parts = lambda f: [f[p : p + 4] for p in range(0, len(f), 4)]
        same = lambda a, b: np.mean([x == y for x, y in zip(parts(a), parts(b))])
        assert r.near_next == pytest.approx(same(r.fingerprint, rows[follow[0]].fingerprint)) and r.near_edited == pytest.approx(same(r.fingerprint, r.edited_fingerprint))
        assert fingerprints.setdefault(t, r.fingerprint) == r.fingerprint


def test_ranked_search(spark, given):
    from .test_joins import brute_search

    items = {r.item_id: r.text for r in table(spark, DATA, "benchmark").collect()}
    assert sorted(tuple(r) for r in result(spark, "op12_ranked_search")) == brute_search(given, items)


def test_shards(spark, given):
    rows = {r.doc_id: r for r in result(spark, "op2_sharding")}
    slots = {}
    for i, t in given:
        raw = t.encode()
        assert (rows[i].size, rows[i].text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and rows[i].law == "rows" and rows[i].grown_shard is None
        slots.setdefault(rows[i].shard, []).append(rows[i].slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_packing(spark, given):
    from tokenizers import Tokenizer

    coder, rows = Tokenizer.from_file(packing.tokenizer_path()), result(spark, "op7_packing")
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in given:
        ids, at = np.array([*coder.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_chat(spark):
    rows = queries.QUERIES["op8_chat_formatting"](spark, DATA).collect()
    turns = table(spark, DATA, "conversations")
    assert len(rows) == turns.count() and {r.conv_id for r in rows} == {r.conv_id for r in turns.select("conv_id").distinct().collect()}
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    for own in by.values():
        text = "".join(r.rendered for r in sorted(own, key=lambda r: r.turn))
        roles = [x.split("|>")[0] for x in text.split("<|") if x and not x.startswith("end")]
        assert roles[-1] == "assistant" and roles[roles[0] == "system" :: 2] == ["user"] * len(roles[roles[0] == "system" :: 2])


def test_simhash(spark, given):
    rows = {r.doc_id: r for r in result(spark, "op10_simhash_near_dedup")}
    fps = [brute_fingerprint(t) for _, t in given]
    for (i, _), f, c in zip(given, fps, brute_components([i for i, _ in given], fps)):
        assert (rows[i].fingerprint, rows[i].component_id) == (f"{f:016x}", c)
    assert simhash.MAX_BITS == 4
