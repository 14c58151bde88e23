"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausegraph.llm import ann, bpe, catalog, chat, common, langid, licenses, mixing, neardup, packing, quality, sstable, topk

BYTE, WORD, PIECE = (catalog.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LONG = " ".join(f"mot{i}" for i in range(9000))
ODD = [None, "", " ", "\n\t", "a \n b", " x  y\n\n z  \n", "<|endoftext|> hi", "It's 12,345 they'll! ΌΣΟΣ İx 日本語 é ̈x", "ẞ ĳ ŉ Ǆ Ⅳ ªº", "one", "one two three", LONG, LONG]
SCHEMA = "doc_id long, text string, lang string, source string, row_id string, size string, place int, score double, key string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 1, 0.5, "k") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "fr" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}") for i, t in enumerate(ODD)] + [(None, "sans nom", None, None), (3, "again three", "fr", "s1"), (3, "again three", "fr", "s1")]
    path = common.scratch(spark, "odd")
    table(spark, rows).write.parquet(path)
    return spark.read.parquet(path), rows


@pytest.fixture(scope="module")
def empty(spark):
    path = common.scratch(spark, "empty")
    table(spark, []).write.parquet(path)
    return spark.read.parquet(path)


def ids_of(path, texts):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return [e.ids + [2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_exact(path):
    enc = bpe.Encoder(path)
    ids, at = enc.encode(pa.array(ODD))
    assert [ids[a:b].tolist() + [2] for a, b in zip(at[:-1], at[1:], strict=True)] == ids_of(path, ODD)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_sstable(spark, odd, empty):
    docs, rows = odd
    path = common.scratch(spark, "t")
    sstable.write_shards(docs, path, BYTE, shard_bytes=20_000)
    got = sorted(sstable.digest(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert len({r["shard"] for r in got}) > 1
    own = defaultdict(Counter)
    for (i, t, *_), ids in zip(rows, ids_of(BYTE, [r[1] for r in rows]), strict=True):
        own[i][len(ids), crc(ids)] += 1
    at, found = 0, defaultdict(Counter)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        found[r["doc_id"]][r["n_tokens"], r["ids_crc32"]] += 1
    assert found == own
    hits = sstable.lookup(spark, path, [3, 9, 77]).collect()
    assert sorted(h["doc_id"] for h in hits) == [3, 3, 3, 9]
    assert next(h["ids"] for h in hits if h["doc_id"] == 9) == ids_of(BYTE, ["one"])[0]
    everything = [None, *range(-3, 200)]
    sought = sstable.seek(spark, path, everything)
    whole = sstable.read_shards(spark, path).orderBy("shard", "row").collect()
    assert Counter((i, ids.tobytes()) for i, ids in sought) == Counter((r["doc_id"], bytes(r["ids"])) for r in whole if r["doc_id"] in set(everything))
    path = common.scratch(spark, "t")
    sstable.write_shards(empty, path, BYTE)
    assert sstable.seek(spark, path, [1, None]) == []
    assert sstable.digest(spark, path).count() == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    odd_texts = [said, "[\\INST] <\\\\s> <s>[[INST]<|x|>", None, "", "é\n" * 3000, "plain"]
    rows = [(c, t, ("user", "assistant", None)[(c + t) % 3], odd_texts[(c * 7 + t) % 6], 1) for c in range(40) for t in range(c % 5 + 1)] + [(None, 0, "assistant", "no id", 1), (1, None, "assistant", "last", 1), (1, None, "assistant", "last", 1)]
    rows += [(99, t, ("user", "assistant")[t % 2], f"{t}é[INST]" * 3000, 1) for t in range(100)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    formatted = common.materialise(chat.format_conversations(turns), "t")
    found = formatted.collect()
    assert not [r for r in found if r["formatted"].count("<s>") != r["n_turns"]]
    assert max(r["part"] for r in found if r["conv_id"] == 99) > 0  # longer than a slice
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
        own[r[0]].append(r)
    assert got.keys() == own.keys()
    for c, rs in own.items():
        loss = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(rs), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_conversations(turns.limit(0))).count() == 0


def test_licenses(spark, odd, empty):
    docs, rows = odd
    assert [r["n_matches"] for r in licenses.scan(docs).collect()] == [0] * len(rows)
    assert licenses.scan(empty).count() == 0
    texts = ["Intro.\nReleased under the MIT License.\nEnd.", "licensed UNDER the apache license; version 2 0", licenses.TEMPLATES["ISC"], "Released under the MIT", "MIT License", None]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = []
    for t in texts:
        best = []
        for unit in {u for u in [*(t or "").split("\n"), t or ""] if u}:
            own = licenses.bigrams(licenses.normal_words(unit))
            for name, text in licenses.TEMPLATES.items():
                other = licenses.bigrams(licenses.normal_words(text))
                dice = 2 * len(own & other) / (len(own) + len(other)) if own else 0
                if dice >= 0.8:
                    best.append((-dice, name))
        want.append((min(best)[1], -min(best)[0]) if best else (None, None))
    assert [(r["license"], r["score"]) for r in got] == want


def test_published_licence_texts(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version {} of the License, or\n    (at your option) any later version."
    texts = {
        "GPL-3.0-notice": "<one line to give its name>\n\n    " + gpl.format(3) + "\n\n    This program is distributed in the hope that it will be useful.",
        "GPL-2.0-notice": "Code.\n\n" + gpl.format(2),
        "LGPL-2.1-notice": "Code.\n\n" + gpl.format("2.1").replace("program", "library").replace("GNU", "GNU Lesser"),
        "AGPL-3.0-notice": "Code.\n\n" + gpl.format(3).replace("GNU", "GNU Affero"),
        "GPL-3.0-title": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007",
        "BSD-redistribution": "Copyright 2001 A.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Source",
        "BSD-3-Clause-conditions": "Copyright 2001 A.\n\n" + licenses.TEMPLATES.get("BSD-3-Clause-conditions", "").replace("copyright holder", "University"),
        "BSL-1.0-title": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission",
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).collect()
    assert [r["license"] for r in sorted(got, key=lambda r: r["doc_id"])] == list(texts)


def test_mixing(spark, odd, empty):
    docs, rows = odd
    mixed = mixing.mix(docs, block_words=64, shard_blocks=8)
    got = mixing.digest(mixed).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.digest(mixing.mix(docs, block_words=64, shard_blocks=8)).collect()), key=str)
    sizes = sum(r["size"] for r in got)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert all(t <= 2 * s + 1e-9 for s, t in targets)
    assert abs(sum(r["taken"] for r in got) - 1.5 * sizes) <= len(targets)
    placed = mixed.rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("position").alias("top"), F.countDistinct("block").alias("b")).collect()
    assert all(r["top"] == r["n"] - 1 for r in placed) and len(placed) > 1
    assert mixing.digest(mixing.mix(empty)).count() == 0


def test_blocks_are_permuted_by_seed(spark):
    for blocks in (1, 2, 5, 7, 100, 4099, 1000002, 1000004, 1000003 * 1000033):
        orders = set()
        for seed in ("a", "b", "c", "d"):
            f, s = spark.range(1).select(*mixing.permutation(seed, F.lit("=x"), F.lit(blocks).cast("long"))).first()
            seen = [(i * f + s) % blocks for i in range(min(blocks, 5000))]
            assert len(set(seen)) == len(seen) and 0 <= s < blocks
            assert blocks < 7 or f % blocks not in (1, blocks - 1)
            orders.add(tuple(seen[:50]))
        assert blocks < 7 or len(orders) > 2


def test_hypergeometric(spark):
    n, k, drawn = 60, 25, 18
    uniform = F.shiftrightunsigned(F.xxhash64("id"), 11) * F.lit(2.0**-53)
    x = spark.range(20000).select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(drawn), uniform).alias("x")).groupBy("x").count().collect()
    chance = {i: math.comb(k, i) * math.comb(n - k, drawn - i) / math.comb(n, drawn) for i in range(drawn + 1)}
    assert all(abs(r["count"] / 20000 - chance[r["x"]]) < 0.015 for r in x)


def near_classes(rows, shingle, percent):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(256)).lower()))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common_ >= percent * (len(sets[i]) + len(sets[j]) - common_):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return sets, [root(i) for i in range(len(rows))]


def test_neardup_many_tiles(spark, monkeypatch):
    """Tiles of three sets: a bucket of one large component and strangers, and of several components."""
    monkeypatch.setattr(neardup, "TILE", 3)
    rng = np.random.default_rng(15)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(100)]
        for _ in range(40):  # 15 to 24 words of the end differ: some pairs alike, some apart, in the same buckets
            own = list(base)
            for p in rng.choice(100, int(rng.integers(0, 6)), replace=False):
                own[p] = f"n{rng.integers(1e6)}"
            rows.append(" ".join(own))
    rows = list(enumerate(rows))
    path = common.scratch(spark, "t")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    for percent in (80, 90):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.read.parquet(path), 4, percent).collect()}
        label = near_classes(rows, 4, percent)[1]
        assert got == dict(enumerate(label)) and len(set(label)) > 5


def test_neardup(spark, odd, empty):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(2000)}" for _ in range(120)]
    rows = []
    for e in range(60):  # near copies of all distances, links between them, ties, exact copies, short texts
        own = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 8)):
            own[p] = f"n{rng.integers(1e6)}"
        rows.append(" ".join(own))
    rows += [" ".join(f"v{rng.integers(1e6)}" for _ in range(int(rng.integers(1, 40)))) for _ in range(60)] + rows[:5] + ["a b", "A  B", "a", None, "", " "]
    rows = list(enumerate(rows))
    path = common.scratch(spark, "t")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    for shingle in (4, 5):
        got = {r["doc_id"]: r for r in neardup.digest(neardup.near_duplicates(spark.read.parquet(path), shingle, 80)).collect()}
        sets, label = near_classes(rows, shingle, 80)
        order = {i: min(j for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))}
        assert {i: (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in got} == {i: (len(sets[i]), order[i], order[i] == i) for i in order}
    docs, own = odd
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(own) and sum(r["kept"] for r in found) == len({(r[1] or "").strip() or i for i, r in enumerate(own)})
    assert neardup.near_duplicates(empty).count() == 0


@pytest.fixture
def splits_change(spark, monkeypatch):
    """After each table written, scans are split otherwise, as when executors are lost or join."""
    import corpus_pipeline

    name, written = "spark.sql.files.maxPartitionBytes", [0]
    before = spark.conf.get(name)

    def changing(*args, **options):
        made = common.materialise(*args, **options)
        written[0] += 1
        spark.conf.set(name, ("128MB", "16KB", "40KB")[written[0] % 3])
        return made

    for module in (neardup, mixing, corpus_pipeline):
        monkeypatch.setattr(module, "materialise", changing)
        if hasattr(module, "numbered"):  # writes a table too
            monkeypatch.setattr(module, "numbered", lambda *a, own=module.numbered: (own(*a), spark.conf.set(name, "16KB"))[0])
    yield
    spark.conf.set(name, before)


def many_files(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        text = [f"w{rng.integers(1e6)}" for _ in range(int(rng.integers(60, 200)))]
        rows += [(3 * i, " ".join(text), "en", f"s{i % 2}"), (3 * i + 1, " ".join([*text[:-1], "last"]), "en", f"s{i % 2}"), (3 * i + 2, f"lone {i} " * 3, "en", "s0")]
    path = common.scratch(spark, "t")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(9, "doc_id").write.parquet(path)
    return rows, path


def test_rows_keep_their_numbers_when_splits_change(spark, splits_change):
    import corpus_pipeline

    rows, path = many_files(spark)
    first = {r["doc_id"]: r["component_id"] for r in neardup.digest(neardup.near_duplicates(spark.read.parquet(path))).collect()}
    label = near_classes([r[:2] for r in rows], 5, 80)[1]
    assert first == {r[0]: rows[label[i]][0] for i, r in enumerate(rows)}
    docs = spark.read.parquet(path).withColumn("n_chars", F.length("text").cast("long")).withColumn("row_id", F.lit("theirs"))
    single = corpus_pipeline.keep_distinct(spark, docs, DATA)
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted({rows[i][0] for i in label})
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    sizes = {r[0]: len(r[1].split()) for r in rows}
    got = Counter()
    for r in mixed:
        got[r["doc_id"]] += len(r["text"].split())
    want = {r["doc_id"]: r["taken"] for r in mixing.digest(mixing.mix(docs)).collect() if r["taken"]}
    assert got == want and all(n <= 2 * sizes[i] for i, n in got.items())


def test_registers_estimate():
    rng = np.random.default_rng(1)
    for size in (3, 20, 200, 5000):
        same, other = rng.integers(0, 2**63, 9 * size).astype(np.uint64), rng.integers(0, 2**63, 2 * size).astype(np.uint64)
        cls = neardup.size_class(10 * size)
        a, b = (neardup.registers(np.unique(np.r_[same, o]), cls) for o in (other[:size], other[size:]))
        got, used = neardup.estimate(a[None], b[None])
        assert abs(got[0] - 9 / 11) < 0.09 and used[0] > 400


def test_quality(spark, odd, empty):
    docs, rows = odd
    good = [(i, " ".join(f"mot{(i * 7 + j) % 50}" for j in range(60)), None, None) for i in range(100, 180)]
    bad = [(i, "$$$ ### !!! " * 30, None, None) for i in range(200, 280)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs.union(table(spark, good + bad)), labels).collect()
    assert len(got) == len(rows) + 160 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["doc_id"]: r["predicted"] for r in got if (r["doc_id"] or 0) >= 100} == {r[0]: 1 for r in good} | {r[0]: 0 for r in bad}
    assert len({r["score"] for r in quality.classify(docs, labels.limit(0)).collect()}) >= 1
    assert quality.classify(empty, labels.limit(0)).count() == 0
    x, at = quality.passages(pa.array(["a b " * 200, "", None]))
    assert np.diff(at).tolist() == [5, 1, 1] and np.isfinite(x).all()


def test_quality_gradient():
    rng = np.random.default_rng(0)
    x, bags, y = rng.normal(size=(40, quality.FEATURES)), np.arange(0, 41, 4), np.arange(10) % 2 * 1.0
    x[bags[:-1] + 1, 3] = np.where(y > 0, 4, -4)  # one passage of each bag tells
    model = quality.fit(x, bags, y, epochs=200)
    assert ((model.forward(x, bags)["p"] > 0.5) == (y > 0)).all()


def test_langid(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs, PIECE)
    got = langid.digest(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    own, rows = odd
    found = langid.digest(own, model).collect()
    assert len(found) == len(rows) and {r["lang_pred"] for r in found if r["doc_id"] in (0, 1, 2, 3) and r["score"] == 0} == {"und"}
    none = langid.learn(empty, PIECE)
    assert {r["lang_pred"] for r in langid.digest(own, none).collect()} == {"und"}
    assert langid.digest(empty, none).count() == 0


def toy_pieces(count=1):
    pieces = sorted(["a", "b", "ab", "▁", "▁a", "bababababababa"])
    model = langid.Model([f"x{k}" for k in range(count)], pieces, np.zeros((len(pieces) + 2, count)), np.zeros(count))
    p = [dict(zip(pieces, np.random.default_rng(k).dirichlet(np.ones(len(pieces))), strict=True)) for k in range(count)]
    for k in range(count):
        model.probabilities[1 : len(pieces) + 1, k] = [p[k][pieces[i]] for i in model.finder().order]
    model.probabilities[-1] = langid.UNKNOWN
    return model, p


def log_total(word, p):
    sums = [Decimal(1)]
    for e in range(1, len(word) + 1):
        sums.append(sum(sums[e - n] * Decimal(p.get(word[e - n : e], langid.UNKNOWN if n == 1 else 0)) for n in range(1, min(14, e) + 1)))
    return float(sums[-1].ln())


def test_forward_sums_all_segmentations(monkeypatch):
    words = ["▁ab", "▁abab", "▁bba", "▁zz" + "ab" * 40, "▁" + "bababababababab" * 30 + "z" * 50, "a", "▁" + "日本" * 60]
    for window, cells, sums in ((4096, 1 << 18, 16 << 20), (16, 64, 2000)):  # long words go in many windows, few words at once
        for name, value in (("WINDOW", window), ("CELLS", cells), ("SUMS", sums)):
            monkeypatch.setattr(langid, name, value)
        for count in (1, 100):
            model, p = toy_pieces(count)
            got = model.log_words(words)
            assert got.shape == (len(words), count)
            assert all(math.isclose(got[i, k], log_total(w, p[k]), rel_tol=1e-9) for i, w in enumerate(words) for k in range(0, count, 33))


def test_expected_pieces():
    model, (p,) = toy_pieces()
    names = [None] + [model.pieces[i] for i in model.finder().order] + ["?"]
    words = ["▁abababababababab", "▁abzb", "▁b"]

    def ways(word):
        if not word:
            yield [], 1.0
        for n in range(1, len(word) + 1):
            q = p.get(word[:n], langid.UNKNOWN if n == 1 else 0)
            for rest, r in ways(word[n:]) if q else ():
                yield [word[:n] if word[:n] in p else "?", *rest], q * r

    want, weight = Counter(), [2.0, 3.0, 1.0]
    for w, times in zip(words, weight, strict=True):
        every = list(ways(w))
        total = sum(q for _, q in every)
        for parts, q in every:
            for x in parts:
                want[x] += times * q / total
    got, total = langid.occurrences(model.finder(), words, np.log(np.maximum(model.probabilities[:, 0], 1e-300)), np.array(weight))
    assert all(math.isclose(g, want[n], rel_tol=1e-9, abs_tol=1e-12) for n, g in zip(names, got, strict=True))
    assert np.allclose(total, [log_total(w, p) for w in words])


def vectors(spark, rng, n, dim=8):
    rows = [(i, [float(v) for v in rng.integers(-3, 4, dim) / 4]) for i in range(n)]  # many ties and equal vectors
    rows += [(n, None), (n + 1, [1.0] * (dim - 1) + [float("nan")]), (n + 2, [None] + [1.0] * (dim - 1)), (n + 3, [0.0] * dim), (None, [1.0] * dim), (20, [0.5] * dim), (n + 4, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def usable(rows):
    return [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]


def test_topk(spark):
    rows, df = vectors(spark, np.random.default_rng(2), 300)
    want = set()
    ok = [(i, np.floor(64 * v).astype(int)) for i, v in usable(rows)]
    for q, x in ((i, v) for i, v in ok if i % 20 == 0):
        if q == 20:
            continue  # an id that repeats: several queries of one name
        best = sorted((-int(x @ v), i) for i, v in ok if i != q and len(v) == len(x))[:20]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = {tuple(r) for r in topk.top_k(df.withColumn("score", F.lit(1))).collect() if r["query_id"] != 20}
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 1, 2)")).where("query_id = 0").collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_topk_many_blocks(spark):
    """Small blocks: pruning, compaction, several runs and groups; components from a byte to some that need whole numbers of 64 bits."""
    rng = np.random.default_rng(12)
    for top, dim in ((3, 40), (1e3, 40), (1e6, 24)):
        rows = [(i, [float(v) for v in rng.normal(size=dim) * top / (1 + i % 7)]) for i in range(700)]
        rows += [(20 * i, rows[3][1]) for i in range(3)] + [(1000 + i, rows[5][1]) for i in range(40)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
        ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
        ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok], object)
        want = Counter()
        for q, x in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
            score = m @ np.array(x, object)
            best = sorted((-s, i) for i, s in zip(ids.tolist(), score, strict=True) if i != q)[:20]
            want.update((q, r, i, -s) for r, (s, i) in enumerate(best, 1))
        got = Counter(tuple(r) for r in topk.top_k(df, candidates=32, queries=8, run=4, group=2).collect())
        assert got == want
    huge = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge).collect()


def test_ann_recall(spark):
    rng = np.random.default_rng(3)
    rows, df = vectors(spark, rng, 600)
    got = defaultdict(dict)
    for r in ann.search(df).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    ok = [(i, v) for i, v in usable(rows) if np.any(v)]
    hit = asked = 0
    for q, x in ((i, v) for i, v in ok if i % 20 == 0 and i != 20):
        best = sorted((-float(np.dot(v, x)), i) for i, v in ok if i != q and len(v) == len(x))[:20]
        assert all(abs(s - dict((i, -t) for t, i in sorted((-float(np.dot(v, x)), i) for i, v in ok if len(v) == len(x)))[i]) < 1e-12 for i, s in got[q].values() if i != 20)
        hit += len({i for _, i in best} & {i for i, _ in got[q].values()})
        asked += len(best)
    assert hit >= 0.9 * asked
    assert ann.search(df.limit(0)).count() == 0


def test_repeated_ids_keep_their_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 8) / 4]) for i in range(300)]
    own = [2.0] * 8  # best of all for itself: 30 rows of id 40 with one vector, and of id 60 with as many vectors as rows
    rows += [(40, own)] * 30 + [(60, [2.0] * 7 + [2 + i / 64]) for i in range(30)] + [(20, [0.5] * 8)] + [(i, [1.0] * 8) for i in (7, 7, 7, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    ok = [(i, np.array(v)) for i, v in rows]

    def want(scale):
        lists = Counter()
        for q, x in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
            best = sorted((-float(scale(np.array(x)) @ scale(v)), i) for i, v in ok if i != q)[:20]
            lists[q, tuple((i, -s) for s, i in best)] += 1
        return lists

    def lists(found):
        by = defaultdict(lambda: defaultdict(list))
        for r in found:
            by[r["query_id"]][r["rank"]].append((r["vec_id"], float(r["score"])))
        return by

    def ranked(counted):
        by = defaultdict(lambda: defaultdict(list))
        for (q, best), n in counted.items():
            for rank, hit in enumerate(best, 1):
                by[q][rank] += [hit] * n
        return by

    order = lambda by: {q: {rank: sorted(hits) for rank, hits in ranks.items()} for q, ranks in by.items()}
    assert order(lists(topk.top_k(df).collect())) == order(ranked(want(lambda v: np.floor(64 * v).astype(int))))
    assert order(lists(ann.search(df).collect())) == order(ranked(want(lambda v: v)))  # a beam wider than the table finds all


def test_pack_fills_sequences():
    rng = np.random.default_rng(4)
    sizes = [int(s) for s in rng.integers(1, 9000, 400)]
    made = packing.pack(sizes)
    used = [sum(n for _, _, n in s) for s in made]
    assert sorted(used)[1:] == [4096] * (len(made) - 1) and sum(used) == sum(sizes)
    parts = defaultdict(list)
    for s in made:
        for item, at, n in s:
            parts[item].append((at, n))
    for item, ps in parts.items():
        at = 0
        for a, n in sorted(ps):
            assert a == at and n > 0
            at += n
        assert at == sizes[item]


def test_pack_looks_at_every_sequence():
    sizes = [2000] + [300] * 1305  # the sequence of the long piece is the dearest of 97, and the only one that has room
    bins = packing.pack(sizes, linear=0.0)
    room, cost, held = [4096] * (len(bins) - 1) + [sum(sizes) - 4096 * (len(bins) - 1)], [0] * len(bins), [[] for _ in bins]
    for item, n in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        at = 0
        while n:
            able = [b for b in range(len(bins)) if room[b] >= n]
            b = min(able, key=lambda b: (cost[b], b)) if able else max(range(len(bins)), key=lambda b: (room[b], -b))
            take = min(n, room[b])
            held[b].append((item, at, take))
            room[b], cost[b], at, n = room[b] - take, cost[b] + take * take, at + take, n - take
    assert bins == held and [take for _, _, take in bins[0]][:7] == [2000] + [300] * 6


def test_packing(spark, odd, empty):
    docs, rows = odd
    got = packing.pack_documents(docs, WORD, window_tokens=20_000).collect()
    sequences = defaultdict(list)
    for r in got:
        assert crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and s[0]["padded_to"] == (at if at & (at - 1) == 0 else 4096)
    want, found = Counter(), Counter()
    for (i, *_), ids in zip(rows, ids_of(WORD, [r[1] for r in rows]), strict=True):
        want[i] += len(ids)
    for r in got:
        found[r["doc_id"]] += r["length"]
    assert found == want
    assert packing.pack_documents(empty, WORD).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    result = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, DATA).collect()), key=key) == sorted(result.fetchall(), key=key)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = common.materialise(stage["quality"](spark, docs, DATA), "t")
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()
    named = common.materialise(stage["language"](spark, kept, DATA), "t")
    assert named.columns == docs.columns and named.count() == kept.count()  # all are in learned languages
    single = common.materialise(stage["neardup"](spark, named, DATA), "t")
    rows = [(r["doc_id"], r["text"]) for r in named.orderBy("doc_id").collect()]
    label = near_classes(rows, 5, 80)[1]
    assert {r["doc_id"] for r in single.collect()} == {rows[i][0] for i in set(label)}
    mixed = common.materialise(stage["mixing"](spark, single, DATA), "t")
    size = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert mixed.columns == docs.columns and abs(size(mixed) - 1.5 * size(single)) <= 20
    packed = stage["packing"](spark, mixed, DATA)
    tokens = sum(len(i) for i in ids_of(WORD, [r["text"] for r in mixed.collect()]))
    assert packed.select(F.sum("length")).first()[0] == tokens


FOREIGN = [
    "Witamy w naszym sklepie internetowym, gdzie znajdziesz najlepsze produkty", "Benvenuti nel nostro negozio online, dove troverete i migliori prodotti", "xkjq wzvb qqpt zzrf klmw brtx", "これは日本語の文章です。東京に行きました。", "12 34 ++",
]


def test_pipeline_stages_take_any_columns(spark):
    """Columns named as the stages name their own; nulls, empty texts, repeated rows, ties, no rows; foreign texts go."""
    import corpus_pipeline

    names = ["row_id", "epoch", "words", "took", "all_words", "quality_score", "lang_pred", "lang_score", "lang_fit", "doc_key"]
    real = spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL").limit(150).select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(900 + i, t, None, None, 1) for i, t in enumerate([*FOREIGN, None, "", " \n"])] + [(None, None, None, None, None), (7, "again", "en", "s", 5), (7, "again", "en", "s", 5)]
    docs = real.union(spark.createDataFrame(odd, real.schema)).select("*", *[F.lit(n).alias(n) for n in names])
    path = common.scratch(spark, "t")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, DATA), "t")
        assert stage(spark, docs.limit(0), DATA).count() == 0
        if name == "packing":
            continue
        assert out.columns == docs.columns
        found = out.collect()
        assert all(r[n] == n for r in found for n in names)
        ids = [r["doc_id"] for r in found]
        if name == "language":
            assert not {900 + i for i in range(len(FOREIGN))} & set(ids) and len([i for i in ids if i is not None and i < 900]) >= 148
        if name == "neardup":
            assert ids.count(7) == 1 + len([r for r in real.collect() if r["doc_id"] == 7]) and {905, 906, 907, None} <= set(ids)
