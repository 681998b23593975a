"""License scan, decontamination, sharding and packing against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest


from zonalvec.llm import decontaminate, licenses, packing, sharding
from zonalvec.llm import queries as llm

from .. import oracle
from . import helpers

FIND = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return FIND.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, name):
    columns, got = oracle.rows(llm.QUERIES[name](spark, data).toPandas())
    expected_columns, expected = oracle.rows(oracle.connection(data).execute(llm.ORACLE_SQL[name]).df())
    assert columns == expected_columns and got == expected and got


def test_licenses(spark):
    texts = ["Released UNDER the MIT-License. under the mit license", "cc by nc cc by nc", "the under mit license", None, "", "GNU General Public License, version 3", "under the mit", "Apache License Version 2.0 " + helpers.prose(300)]
    got = {r.doc_id: r for r in licenses.scan(helpers.documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        base = sorted(s for p in licenses.BASE.values() for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        assert got[i].n_words == len(w)
        assert sorted(p.start for p in got[i].places or [] if p.base) == base
    assert {p.label for p in got[5].places} == {"gpl-3"}
    assert licenses.scan(helpers.empty(spark)).count() == 0
    assert licenses.scan(helpers.repeated(spark)).count() == 6


def test_license_labels(spark):
    texts = ["SPDX-License-Identifier: Apache-2.0", "GPLv3", "MIT License", "in no event will the authors be held", "see the terms in no event will the authors be held liable",
             "This wor\u212a is licensed under the GNU General Public License version 2", "permission is hereby granted free of charge to any person obtaining a copy", "under the MIT licen\u017fe",
             "Provided AS IS, without any express or implied warranty. In no event will the authors be held liable"]
    got = {r.doc_id: sorted({p.label for p in r.places or []}) for r in licenses.scan(helpers.documents(spark, texts)).collect()}
    # The zlib phrase alone is less than half of its template; the long s is not an s.
    assert got == {0: ["apache-2"], 1: ["gpl-3"], 2: ["mit"], 3: [], 4: [], 5: ["gpl-2"], 6: ["mit"], 7: [], 8: ["zlib"]}


def test_only_a_to_z_are_lower_cased(spark):
    got = licenses.scan(helpers.documents(spark, ["\u212aING Ünder İ THE"])).first()
    assert got.n_words == len(words("\u212aING Ünder İ THE"))
    rows = helpers.documents(spark, ["\u212aING ÄB"]).select(licenses.words_of().alias("w")).first()
    assert rows.w == words("\u212aING ÄB")


def test_license_index_begins_with_the_rarest_words():
    t = licenses.templates()
    index = licenses.index(t, {w: 10 for w in "under the license".split()})
    assert [w for w in index if (0, t[0]["key"].index(w) if w in t[0]["key"] else -1) in index[w]][:2] == ["mit", "license"]
    assert index["mit"][0] == (0, 2)


def judged(texts, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w and i is not None else 0):
            windows[tuple(w[k : k + window])].add(str(i))
    out = []
    for t in texts:
        w, hit, who = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    who |= own
        out.append((len(w), len(hit), sorted(who)))
    return out


@pytest.mark.parametrize("block_nodes", [1 << 20, 500])
def test_decontamination(spark, block_nodes):
    passage = helpers.prose(14, 50)
    items = [(1, passage), (2, passage.upper()), (3, "short item"), (4, None), (None, "alpha beta"), (10, helpers.prose(25, 51)), (3, "short item"), (5, "  ,. ")]
    texts = helpers.tricky_texts() + [f"X, {passage.replace(' ', '  -- ')}! SHORT\nitem short item", helpers.prose(500, 60) + " " + helpers.prose(25, 51) + " end", "short", "short-item"]
    df = decontaminate.scan(helpers.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_nodes=block_nodes)
    got = {r.row.doc_id: r for r in df.withColumn("n_hit", decontaminate.hit_words()).collect()}
    for i, (n, hit, who) in enumerate(judged(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, who), i
        for s in got[i].spans:
            assert words(texts[i][s.start_char : s.end_char]) == words(texts[i])[s.first : s.end]
    kept = decontaminate.without_contaminated(helpers.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, hit, _) in enumerate(judged(texts, items)) if not hit}
    assert kept.columns == helpers.documents(spark).columns


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(helpers.empty(spark), none).count() == 0
    assert decontaminate.without_contaminated(helpers.repeated(spark), none).count() == 6


def test_permutation():
    for n in (1, 2, 3, 5, 24, 97, 1000, 4099):
        p = sharding.permuted(np.arange(n), n)
        assert sorted(p) == list(range(n))
        assert (sharding.permuted(p, n, back=True) == np.arange(n)).all()
    p = sharding.permuted(np.arange(4096), 4096)
    assert abs(np.corrcoef(np.arange(4096), p)[0, 1]) < 0.1


@pytest.mark.parametrize("make", [helpers.documents, helpers.repeated, helpers.empty])
def test_sharding(spark, make):
    docs = make(spark)
    rows = sharding.sharded(docs, 5).collect()
    assert len(rows) == docs.count()
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert not rows or max(map(len, by.values())) - (min(map(len, by.values())) if len(by) == 5 else 0) <= 1
    again = {(r.row, r.shard, r.slot) for r in sharding.sharded(docs.repartition(3), 5).collect()}
    assert again == {(r.row, r.shard, r.slot) for r in rows}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    coder = packing.Encoder(packing.tokenizer_path())
    texts = [t for t in helpers.tricky_texts() if t is not None] + ["é é ª² ½ don't DON'T I'll 'S ...?! a_b", "x　y z", "Σίσυφος ΟΔΥΣΣΕΥΣ", "<|startoftext|>a<|endoftext|>", "İstanbul ﬁ Å"]
    for t in texts:
        ids = np.frombuffer(coder.encode(t), f"<u{coder.width}").tolist()
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids + [2], t


@pytest.mark.parametrize("window", [4096, 16])
def test_packing(spark, tokenizer, window):
    docs = helpers.documents(spark).repartition(3)
    rows = [r.asDict() for r in packing.pack(docs, window, with_ids=True).collect()]
    expected = {d.doc_id: tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2] for d in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for d, ids in expected.items():
        own = sorted(by_doc[d], key=lambda r: r["start"])
        assert sum((r["ids"] for r in own), []) == ids and all(r["doc_tokens"] == len(ids) for r in own)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for q, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or q == len(by_sequence) - 1
        assert {r["sequence_length"] for r in own} == {window if at == window or at & (at - 1) else at}


def test_packing_of_repeats_and_nothing(spark):
    assert packing.pack(helpers.empty(spark)).count() == 0
    assert packing.pack(helpers.repeated(spark)).filter("start = 0").count() == 6
