import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from pitchframe.llm.mixing import mix

TABLES = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")
def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if name != "tokens" else docs.collect()
        docs = P.settle(stage(spark, docs, TABLES), name.replace(" ", "-"))
        if name != "tokens":
            assert docs.columns == P.COLUMNS
        kept[name] = (before, docs.collect())
    before, after = kept["language"]
    assert {r["doc_id"] for r in after} == {d for d, r in before.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    before, after = kept["near copies"]
    sets = {d: shingles(r["text"]) for d, r in before.items()}
    stays = {r["doc_id"] for r in after}
    ids = sorted(sets)
    linked = {d: d for d in ids}
    for i in ids:
        for j in ids:
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = max(linked[i], linked[j]), min(linked[i], linked[j])
                linked = {d: new if c == old else c for d, c in linked.items()}
    assert stays == {d for d, c in linked.items() if d == c}
    before, after = kept["decontaminate"]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    leaks = {d for d, r in before.items() if any(f" {plain(i)} " in f" {plain(r['text'])} " for i in items)}
    assert leaks and {r["doc_id"] for r in after} == set(before) - leaks
    before, after = kept["mixture"]
    rows = spark.createDataFrame(list(before.values()), "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r["doc_id"]: r["copies"] for r in mix(rows).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, n in copies.items() for _ in range(n))
    before, after = kept["tokens"]
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    texts = sorted(before, key=lambda r: r["doc_id"])
    for row, given in zip(sorted(after, key=lambda r: r["start"]), texts, strict=True):
        ids = tokenizer.encode(given["text"], add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert tuple(row) == (given["doc_id"], start, len(ids), crc)
        start += len(ids)


def test_null_and_repeated_rows_go_through(spark, make_docs, awkward, tmp_path):
    for name, rows in (("some", awkward), ("none", [])):
        folder = tmp_path / name
        make_docs([(*r, "en", "s") for r in rows]).write.parquet(f"{folder}/documents.parquet")
        items = spark.createDataFrame([(1, "a question of six words or more? an answer.")], "item_id long, text string")
        items.write.parquet(f"{folder}/benchmark.parquet")
        out = P.run(spark, str(folder)).collect()
        assert {r["doc_id"] for r in out} <= {r[0] for r in rows}
        assert not rows or 4 in {r["doc_id"] for r in out} and 5 not in {r["doc_id"] for r in out}


FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.",
    "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił.",
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
    "道可道 非常道 名可名 非常名 无名天地之始 有名万物之母",
    "Het was een koude dag in april en de klokken sloegen dertien uur toen hij door de deur naar binnen ging.",
    "xkcd qwrtz bnmpl ghjkv zxcvb mnbtr plkjh gfdsq wrtpz kjhgf dsqwr tpzxc vbnml",
    "ivqou wxeyab kuzoj pafyqe tugwiz oxomeh yqibud zevkoa juwipy qaxofe",
]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
@pytest.mark.parametrize("langs, label", [(["en"], "en"), (["en", "fr", "es", "de"], None)])
def test_foreign_and_junk_texts_go_however_many_languages(spark, langs, label):
    tables = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{tables}/documents.parquet").select(*P.COLUMNS).where(P.F.col("lang").isin(langs))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(-1 - n, text, label, "s", len(text)) for n, text in enumerate(FOREIGN)]
    docs = clean.unionByName(spark.createDataFrame(rows, schema))
    kept = {r["doc_id"] for r in P.language(spark, docs, tables).select("doc_id").collect()}
    assert not [FOREIGN[-1 - i] for i in kept if i < 0]
    texts = {r["doc_id"] for r in clean.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert len(texts - kept) <= 0.002 * len(texts)
