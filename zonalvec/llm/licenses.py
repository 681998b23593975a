"""License scan with a positional rare-token index, in DataFrame operations only.

The index posts every word of short licence templates: word -> (template, position). The document frequency of every
template word is counted over all documents. For each file, the templates whose mandatory key phrase could stand in it
are those with all key words among the file's words; of each, the two key words with the highest IDF are looked up, so
a file is looked up by its own rarest licence words. The places of these words in the file, less their posted positions,
are the starts at which a template may lie; the starts that both words give are kept, and there the key phrase must stand
word for word, and besides it ``LEAST_SHARE`` of all the template's words at their relative positions. All of it happens
within a document's row: no text is shuffled.

A phrase that stands in full has all of its words in the file and both rare words at the same shift, so no occurrence
is missed, whatever the frequencies are.

Defined cases: a null text is empty; texts without words have no places, null first and last words, empty
labels and score 0; repeated rows are each scanned; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The phrases whose places are counted, and their labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: label, template, its mandatory key phrase. Notices as they are commonly worded, names and identifiers of licences.
NOTICES: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2", "http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
    ("bsd-2", "bsd 2 clause license", "bsd 2 clause"),
    ("bsd-3", "bsd 3 clause license", "bsd 3 clause"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose"),
    ("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "gplv2", "gplv2"),
    ("gpl-3", "gplv3", "gplv3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("epl-2", "eclipse public license 2 0", "eclipse public license 2 0"),
    ("cc0-1", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("boost-1", "boost software license version 1 0", "boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
]

#: Identifiers of an SPDX line and their labels.
SPDX = {
    "mit": "mit", "apache 2 0": "apache-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc": "isc", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl-3",
    "mpl 2 0": "mpl-2", "epl 2 0": "epl-2", "cc0 1 0": "cc0-1", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "unlicense": "unlicense", "bsl 1 0": "boost-1", "zlib": "zlib",
}
SPDX_LINE = "spdx license identifier"

#: Share of a template's words, the key phrase's included, that must stand at an alignment.
LEAST_SHARE = 0.5
#: Rarest key words by which a file is looked up for a template.
RAREST = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates() -> list[dict]:
    """Templates as words, their key phrase's place in them, and whether they are base phrases."""
    out = [{"label": k, "words": p.split(), "key": p.split(), "key_at": 0, "base": True} for k, p in BASE.items()]
    lines = [(label, f"{SPDX_LINE} {name}", f"{SPDX_LINE} {name}") for name, label in SPDX.items()]
    for label, text, key in NOTICES + lines:
        w, k = text.split(), key.split()
        out.append({"label": label, "words": w, "key": k, "key_at": next(i for i in range(len(w)) if w[i : i + len(k)] == k), "base": False})
    return out


def words_of(text="text"):
    """Words of the whole text, with A-Z alone lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents in which each template word occurs; one row a template word comes to the driver."""
    found = docs.select(F.explode(F.array_intersect(words_of(), F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in found.collect()}


def index(all_templates: list[dict], frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position) for the first place of each key word, rarest words first."""
    out: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(all_templates):
        for i, w in enumerate(t["key"]):
            if n not in [m for m, _ in out.get(w, [])]:
                out.setdefault(w, []).append((n, t["key_at"] + i))
    return {w: out[w] for w in sorted(out, key=lambda w: (frequency.get(w, 0), w))}


def _quoted(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _templates_sql(all_templates: list[dict]) -> str:
    """The templates as one SQL array of structs."""
    rows = [f"named_struct('n', {n}, 'label', '{t['label']}', 'base', {str(t['base']).lower()}, 'words', {_quoted(t['words'])}, 'key', {_quoted(sorted(set(t['key'])))}, 'phrase', {_quoted(t['key'])}, 'key_at', {t['key_at']})" for n, t in enumerate(all_templates)]
    return "array(" + ", ".join(rows) + ")"


def _index_sql(postings: dict[str, list[tuple[int, int]]]) -> str:
    """The index as one SQL array of (word, template, position), rarest words first."""
    return "array(" + ", ".join(f"named_struct('w', '{w}', 'n', {n}, 'r', {r})" for w, own in postings.items() for n, r in own) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places): places are structs of label, base, start (of the template) and share (of its
    words that stand there), for every alignment whose key phrase stands in full."""
    everything = templates()
    vocabulary = sorted({w for t in everything for w in t["words"]})
    if not all(re.fullmatch("[a-z0-9]+", w) for w in vocabulary):
        raise ValueError("templates are lower-case ASCII words")
    postings = index(everything, document_frequencies(docs, vocabulary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of().alias("words"))
    # The file's licence words, and the templates all of whose key words are among them.
    rows = rows.withColumn("own", F.expr(f"array_intersect(words, {_quoted(list(postings))})"))
    rows = rows.withColumn("could", F.when(F.size("own") > 0, F.expr(f"filter({_templates_sql(everything)}, t -> size(array_except(t.key, own)) = 0)")))
    # For each its rarest words with their postings, and the places of all these words in the file.
    rows = rows.withColumn("could", F.when(F.size("could") > 0, F.expr(f"transform(could, t -> struct(t, slice(filter({_index_sql(postings)}, p -> p.n = t.n), 1, {RAREST}) as rare))")))
    rows = rows.withColumn("asked", F.expr("array_distinct(flatten(transform(could, c -> transform(c.rare, p -> p.w))))"))
    rows = rows.withColumn("at", F.when(F.size("asked") > 0, F.expr("filter(transform(words, (w, i) -> if(array_contains(asked, w), named_struct('w', w, 'i', i), null)), x -> x is not null)")))
    starts = "transform(c.rare, p -> transform(filter(at, x -> x.w = p.w), x -> x.i - p.r))"
    both = f"aggregate({starts}, {starts}[0], (a, b) -> array_intersect(a, b))"
    share = "size(filter(sequence(0, size(c.t.words) - 1), j -> get(words, s + j) <=> c.t.words[j])) / cast(size(c.t.words) as double)"
    stands = f"filter({both}, s -> s + c.t.key_at >= 0 and slice(words, s + c.t.key_at + 1, size(c.t.phrase)) = c.t.phrase)"
    found = f"flatten(transform(could, c -> transform({stands}, s -> named_struct('label', c.t.label, 'base', c.t.base, 'start', cast(s as long), 'share', {share}))))"
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(f"filter({found}, p -> p.base or p.share >= {LEAST_SHARE}D)").alias("places"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).withColumn("places", F.coalesce("places", F.expr("cast(array() as array<struct<label:string,base:boolean,start:bigint,share:double>>)")))
    base = F.expr("transform(filter(places, p -> p.base), p -> p.start)")
    labels = lambda which: F.array_join(F.array_sort(F.array_distinct(F.expr(f"transform({which}, p -> p.label)"))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        labels("filter(places, p -> p.base)").alias("base_labels"), labels("places").alias("labels"),
        F.coalesce(F.array_max(F.expr("transform(places, p -> p.share)")), F.lit(0.0)).alias("score"),
    )
