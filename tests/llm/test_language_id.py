import zlib

from pitchframe.llm.language_id import Backoff, identify_languages, learnable, predict, train

TONGUES = {"xx": ("ka", "lo", "mi"), "yy": ("tu", "re", "san"), "zz": ("pel", "vor", "dok")}


def labelled(prose):
    return [(n * 1000 + i, prose(n * 1000 + i, 25, s), lang) for n, (lang, s) in enumerate(TONGUES.items()) for i in range(60)]


def test_held_out_texts(make_docs, prose):
    rows = labelled(prose)
    got = {r["doc_id"]: r for r in identify_languages(make_docs(rows)).collect()}
    for doc_id, _, lang in rows:
        assert got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert got[doc_id]["lang_pred"] == lang and 0 <= got[doc_id]["score"] <= 1


def test_held_out_labels_and_other_columns_are_not_used(make_docs, prose):
    rows = labelled(prose)
    wrong = [(d, t, "yy" if zlib.crc32(str(d).encode()) % 5 == 0 else lang, "yy") for d, t, lang in rows]
    right = {r["doc_id"]: tuple(r) for r in identify_languages(make_docs(rows)).collect()}
    assert {r["doc_id"]: tuple(r) for r in identify_languages(make_docs(wrong)).collect()} == right


def test_awkward_rows(make_docs, awkward, prose):
    rows = labelled(prose) + [(d, t) for d, t in awkward] + [(77, "123 ²² !?")]
    got = identify_languages(make_docs(rows)).collect()
    assert len(got) == len(rows)
    undetermined = [r for r in got if r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in undetermined} == {1, 2, 3, 77, None} and all(r["score"] == 0 for r in undetermined)
    assert identify_languages(make_docs([])).count() == 0
    assert {r["lang_pred"] for r in identify_languages(make_docs(awkward)).collect()} == {"und"}


def test_words_before_shorter_and_shorter_pieces():
    rows = [("a", 0, "cat", 1.0), ("b", 0, "dog", 1.0), ("b", 3, "cat", 0.5), ("b", 3, "xyz", 0.5), ("a", 1, "q", 0.1)]
    model = Backoff(rows)
    assert model.score("cat").tolist() == [1.0, 7.0]
    assert model.score("wxyzw").tolist() == [7.0, 0.5]
    assert model.score("qq").tolist() == [0.1, 7.0]
    assert model.score("kk").tolist() == [7.0, 7.0]


def test_the_model_is_bounded(make_docs, prose):
    model = train(learnable(make_docs(labelled(prose))), sample_docs=20, words=10, ngrams=4)
    assert 0 < len(model) <= 3 * (10 + 4 * 5)
    assert predict(make_docs([(1, "kalomi")]), model, ["doc_id"]).first()["lang_pred"] == "xx"


def test_a_model_holds_a_table_for_each_length():
    rows = [("a", 0, "cat", 1.0), ("b", 0, "cat", 2.0), ("b", 0, "dog", 9.0), ("b", 4, " dog", 0.5)]
    model = Backoff(rows)
    assert {n: t.tolist() for n, t in model.tables.items()} == {0: [[1.0, 2.0], [7.0, 7.0]], 4: [[7.0, 0.5]]}
    assert model.known("cat").tolist() == [1.0, 1.0] and model.known("dog").tolist() == [0.0, 0.5]
