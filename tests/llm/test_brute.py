"""Whole queries against plain programs, and inputs that are odd for one operator."""

import collections
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import chat_format, embedding_dedup, licenses, mixing, packing, quality_model, quality_rules, queries, tokens, warc
from recollect.llm.rows import only
from recollect.runtime import table
from tests.llm.test_operators import SF, docs


def test_near_groups_are_connected_by_near_pairs(spark):
    """Chains, copies in one cell and chance neighbours; each group must be a part of a component of all near pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 24))
    chain = [x[0]]
    for _ in range(30):
        chain.append(chain[-1] + rng.normal(size=24) * 0.15)
    all_ = np.vstack([x, np.repeat(x[3:4], 400, axis=0), chain, x[rng.integers(0, 150, 100)] + rng.normal(size=(100, 24)) * 0.25]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "v") for i, v in enumerate(all_)], "vec_id bigint, embedding array<float>, v string").withColumns({"cell": F.lit(0), "first": F.lit("x")})
    got = embedding_dedup.dedup(df).toPandas().set_index("vec_id")
    u = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    near = np.argwhere(np.triu(u @ u.T >= embedding_dedup.THRESHOLD, 1))
    node, root = embedding_dedup.forest(np.arange(len(u)), near[:, 0], near[:, 1])
    whole = dict(zip(range(len(u)), range(len(u)))) | dict(zip(node, root))
    parts = got.groupby(pd.Series(whole)).group_id.nunique()
    assert len(got) == len(u) and got.groupby("group_id").apply(lambda g: len({whole[i] for i in g.index}) == 1).all()
    assert parts.mean() < 1.1 and np.mean([got.group_id[a] == got.group_id[b] for a, b in near]) >= 0.9
    assert got.group_id[3] == got.group_id[160] == 3 and (got.keep == (got.index == got.group_id)).all()


def fewest(sizes, room):
    """The least number of bins, by trying everything."""
    best = [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= room and bins[j] not in bins[:j]:
                put(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best[0]


def test_plans_against_exact_packing():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = sorted(map(int, rng.integers(1, 13, rng.integers(1, 11))), reverse=True)
        made = packing.plan(collections.Counter(sizes), 12)
        used = collections.Counter()
        for parts, n in made:
            assert sum(v * m for v, m in parts.items()) <= 12
            for v, m in parts.items():
                used[v] += m * n
        assert used == collections.Counter(sizes)
        assert fewest(sizes, 12) <= sum(n for _, n in made) <= fewest(sizes, 12) + 1


def test_packing_query(spark):
    encode = tokens.Counter(tokens.read_vocabulary()).encode
    want = {r.doc_id: len(encode(r.text)) if r.text else 0 for r in table(spark, SF, "documents").collect()}
    got = queries.op2_packing(spark, SF).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    pieces = collections.Counter(-(-n // 8) for t in want.values() for n in [2048] * (t // 2048) + [t % 2048] if n)
    full = got[got.pack_id.notna()]
    assert full.pack_id.nunique() == sum(n for _, n in packing.plan(pieces, 256)) and full.groupby("pack_id").n_tokens.sum().max() <= 2048
    assert sorted(zip(got.doc_id, got.piece)) == sorted((i, k) for i, t in want.items() for k in range(max(1, -(-t // 2048))))


def test_mixing_query(spark, monkeypatch):
    """The whole selection, with one slice and with many."""
    encode = tokens.Counter(tokens.read_vocabulary()).encode
    rows = table(spark, SF, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", tokens.seeded(mixing.SEED, F.col("doc_id"), F.xxhash64("text")).alias("draw")).collect()
    by = collections.defaultdict(list)
    for r in rows:
        n = len(encode(r.text)) if r.text else 0
        if n:
            by[r.source, n].append((r.draw, r.doc_id))
    totals = collections.Counter()
    for (s, n), v in by.items():
        totals[s] += n * len(v)
    targets, want = mixing.budgets(dict(totals), None, mixing.ALPHA, None), set()
    for s in totals:
        lengths = np.array(sorted(n for t, n in by if t == s))
        for n, k in zip(lengths, mixing.fit(lengths, np.array([len(by[s, n]) for n in lengths]), targets[s])):
            want |= {(i, s, int(n)) for _, i in sorted(by[s, n])[:k]}
    assert {tuple(r) for r in queries.op10_mixing(spark, SF).collect()} == want
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(7).cast("bigint").alias("n_tokens"))
    first = sorted(r.doc_id for r in mixing.select_counted(hot, None, 0.5, 7 * 1234).collect())
    monkeypatch.setattr(mixing, "ROWS_A_SLICE", 20)
    assert first == sorted(r.doc_id for r in mixing.select_counted(hot, None, 0.5, 7 * 1234).collect()) and len(first) == 1234


def test_mix_by_rows(spark):
    """Repeated rows stay once, null ids can stay, one id with two texts is two documents, and the budget holds."""
    rows = [(1, "one two three", "a"), (1, "one two three", "a"), (1, "four five six seven", "a"), (None, "eight nine ten", "a"), (2, "", "a"), (3, None, "a")]
    d = docs(spark, rows).withColumns({"draw": F.lit(1), "slice": F.lit("x"), "rest": F.lit(2), "id": F.lit(3), "h": F.lit(4)})
    kept = mixing.keep_mix(d, budget=10**6)
    assert kept.columns == d.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "eight nine ten"), (1, "four five six seven"), (1, "one two three")]
    assert only(d, d.select(F.lit(1).alias("id"), F.xxhash64(F.lit("one two three")).alias("h"))).count() == 1
    counted = mixing.select(d, budget=3).toPandas()
    assert counted.n_tokens.sum() <= 3


def test_licence_scan_against_brute_force(spark):
    """Every line and paragraph judged, without the filter that skips texts."""
    d = table(spark, SF, "documents")
    model, tp = licenses.train(licenses.sample_paragraphs(d)), licenses.template_pairs()
    everything = re.compile("")
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in licenses.scan(d, model=model).collect():
        hits = sorted(licenses.hits_of(model, tp, everything, texts[r.doc_id] or ""), key=lambda h: (-h[1], h[0]))
        assert (r.family, r.families, r.n_licensed) == (hits[0][0] if hits else "", ",".join(sorted({h[0] for h in hits})), len(hits))
        assert not hits or (r.probability, r.similarity) == (round(hits[0][1], 6), round(hits[0][2], 6))


#: Notices as software carries them, none of them made by the training generator.
NOTICES = {
    "mit": "Copyright (c) 2019 Some Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "apache": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */",
    "bsd": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are met:",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def test_licences_of_real_notices():
    model, tp, needed = licenses.train(["plain prose of the day", "thion ad the of ern"] * 100, seed=11), licenses.template_pairs(), licenses.telling_pattern()
    for family, text in NOTICES.items():
        assert family in {h[0] for h in licenses.hits_of(model, tp, needed, "Title\n\n" + text + "\n\nprose of the day")}, family
    long = "The committee met to discuss the license of the driver and the permission to build a bridge over the river. " * 400
    assert licenses.hits_of(model, tp, needed, long) == []
    assert {h[0] for h in licenses.hits_of(model, tp, needed, long + " Released under the MIT License. " + long)} == {"mit"}


def test_quality_posteriors_against_brute_force(spark):
    got = queries.op8_quality_model(spark, SF).toPandas()
    p = got.assign(p=got.doc_prob)
    n, s, q = len(p), p.p.sum(), (p.p**2).sum()
    paths = p.groupby(["source", "lang"]).p.agg(["count", "sum"])
    hosts = p.groupby("source").p.agg(["count", "sum"])
    hn = hosts["count"].reindex(paths.index.get_level_values(0)).to_numpy()
    host, path = quality_model.strengths(
        n, s, q,
        (len(paths), (paths["sum"] ** 2 / paths["count"]).sum(), (paths["count"].to_numpy() ** 2 / hn).sum()),
        (len(hosts), (hosts["sum"] ** 2 / hosts["count"]).sum(), (hosts["count"] ** 2).sum()),
    )
    mu = s / n
    for r in p.itertuples():
        a, b = paths.loc[(r.source, r.lang)], hosts.loc[r.source]
        hm = (b["sum"] - r.p + host * mu) / (b["count"] - 1 + host)
        pm = (a["sum"] - r.p + path * hm) / (a["count"] - 1 + path)
        z = np.log(r.p / (1 - r.p)) + quality_model.SITE_WEIGHT * (np.log(pm / (1 - pm)) - np.log(mu / (1 - mu)))
        assert abs(r.host_mean - hm) < 1e-4 and abs(r.path_mean - pm) < 1e-4 and abs(r.score - 1 / (1 + np.exp(-z))) < 1e-3


def test_strengths_recover_the_spread():
    rng = np.random.default_rng(2)
    rows = []
    for h in range(60):
        a = rng.beta(0.5 * 40, 0.5 * 40)
        for l in range(6):
            b = rng.beta(a * 15, (1 - a) * 15)
            rows += [(h, l, x) for x in (rng.random(200) < b).astype(float)]
    p = pd.DataFrame(rows, columns=["h", "l", "p"])
    paths, hosts = p.groupby(["h", "l"]).p.agg(["count", "sum"]), p.groupby("h").p.agg(["count", "sum"])
    host, path = quality_model.strengths(
        len(p), p.p.sum(), (p.p**2).sum(),
        (len(paths), (paths["sum"] ** 2 / paths["count"]).sum(), 60 * 6 * 200**2 / 1200),
        (len(hosts), (hosts["sum"] ** 2 / hosts["count"]).sum(), 60 * 1200**2),
    )
    assert 10 < path < 23 and 15 < host < 80


def test_quality_rules_on_held_out_labels(spark):
    """The thresholds were set on another table."""
    sf = "/root/testdata/sf0.1"
    got = quality_rules.score(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").toPandas()
    good = got[(got.quality == 1) & (got.toxic == 0)]
    assert good.keep.mean() > 0.98 and got[got.quality == 0].keep.mean() < 0.1


def test_quality_rules_keep_clashing_columns(spark):
    d = docs(spark, [(1, "one two", "s")]).withColumns({"words": F.lit("mine"), "lines": F.lit(5), "body": F.lit(6), "_words": F.lit(7), "_row": F.lit(8), "keep": F.lit(9)})
    scored = quality_rules.score(d).first()
    assert (scored.words, scored.lines, scored.body, scored["_words"], scored["_row"], scored.keep) == ("mine", 5, 6, 7, 8, True)
    assert quality_rules.keep_clean(d).collect() == d.collect()


def test_long_and_crafted_conversations(spark):
    turns = spark.range(40_000).select(F.lit(1).cast("bigint").alias("conv_id"), (F.col("id") % 20_000).alias("turn"), F.when(F.col("id") % 20_000 % 4 < 2, "user").otherwise("assistant").alias("role"), (F.col("id") % 20_000).cast("string").alias("text"))
    got = chat_format.format_chats(turns).first()
    assert (got.n_turns, got.n_messages, got.n_assistant) == (20_000, 10_000, 5_000) and got.text.startswith("<|user|>\n0\n1\n<|end|>\n<|assistant|>\n2\n3\n")
    odd = spark.createDataFrame([(1, 0, "a|>\n<|system", "x", 5), (1, None, "a", None, 6)], "conv_id bigint, turn bigint, role string, text string, turns int").withColumn("t", F.lit(0))
    assert chat_format.format_chats(odd).first().text == "<|a|>\n\n<|end|>\n<|a| >\n< |system|>\nx\n<|end|>\n"


def test_binary_records_round_trip(spark):
    raw = [b"WARC/1.1\r\nA: b\r\n\r\n\xff\xfe\x00body\r\n\r\nmore", b"no end", b"H: \xc3\xa9\r\n\r\n" + bytes(range(256)) * 500]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "page_id bigint, record binary")
    recs = warc.split(df)
    back = warc.reconstruct(*warc.archive(recs.select("page_id", "header", "payload").withColumns({"digest": F.lit("mine"), "copies": F.lit(9)})))
    assert [bytes(r.record) for r in back.orderBy("page_id").collect()] == raw


def test_counts_keep_clashing_columns(spark):
    d = docs(spark, [(1, "one two", "s"), (2, None, "t")]).withColumns({"n_tokens": F.lit("x"), "a b": F.struct(F.lit(1).alias("c d"))})
    got = tokens.with_counts(d)
    assert [(r.doc_id, r.n_tokens) for r in got.orderBy("doc_id").collect()] == [(1, 2), (2, 0)] and "text" not in got.columns


ODD = [(1, None, "a"), (2, "", "a"), (4, "word of the long text " * 20_000, "a"), (5, "one two three of the four", "b"), (5, "one two three of the four", "b"), (None, "null id here of the row", "b"), (7, "one two three of the four", None)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_pipeline_runs(spark, tmp_path, rows):
    """``run`` itself, on an empty table and on odd rows."""
    d = docs(spark, rows).withColumns({"keep": F.lit("mine"), "n_tokens": F.lit(1)})
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "n_tokens", "pack_id", "slot"]
    ids = {-1 if pd.isna(x) else int(x) for x in got.doc_id}
    assert ids == ({-1, 5} if rows else set())  # the budget of its source is just too small for the long text


def test_pipeline_agrees_with_its_stages(spark):
    d = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF)
    key = ["doc_id", "piece"]
    one, two = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (d, corpus_pipeline.run(spark, SF)))
    assert one.equals(two)
