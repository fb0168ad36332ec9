import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pitchframe.llm.common import new_path
from pitchframe.llm.token_files import Encoder, read_document, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_words_and_whole_texts_encode_alike():
    rng = random.Random(5)
    parts = ["a", "Th", "é", "ñ", " ", " ", "\n", "\t", "  ", "'s", "!", "1", "²", "漢", "<|endoftext|>", "\x1c", "\xa0", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    own = Encoder(PATH, 2)
    whole = own.encode_whole(texts)
    for start in range(0, len(texts), 500):
        assert own.encode(pa.array(texts[start : start + 500], pa.large_string())) == whole[start : start + 500]


def test_round_trip_and_places(spark, make_docs, awkward, prose):
    rows = awkward + [(i, prose(i, 30)) for i in range(100, 160)]
    path = new_path(spark, "tokens")
    write_token_files(make_docs(rows), path, PATH, end_id=2, vocabulary=50_257)
    found = sorted((tuple(r) for r in read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start = 0
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(ids_of(t))
    for doc_id, at, n, crc in found:
        assert at == start
        assert (n, crc) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in texts[doc_id]]
        start += n
    assert read_document(spark, path, 120) == texts[120]
    assert sorted(read_document(spark, path, 5)) == sorted(texts[5])
    assert read_document(spark, path, 99_999) == []


def test_a_wrong_dictionary_is_refused(spark, make_docs, prose):
    path, other = new_path(spark, "tokens"), new_path(spark, "tokens")
    for where, seed in ((path, 1), (other, 2)):
        write_token_files(make_docs([(i, prose(i + seed * 100, 60)) for i in range(60)]), where, PATH, 2, 50_257)
    mixed = new_path(spark, "mixed")
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{mixed}/blocks")
    spark.read.parquet(f"{other}/dictionary").write.parquet(f"{mixed}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        read_token_files(spark, mixed).collect()


def test_empty_table(spark, make_docs):
    path = new_path(spark, "tokens")
    write_token_files(make_docs([]), path, PATH, end_id=2, vocabulary=50_257)
    assert read_token_files(spark, path).count() == 0


def test_words_are_cut_at_signs_and_known_once():
    """A word with ten signs behind it was ten words before, each looked up and learned in Python."""
    words, signs = ["lorem", "über", "ñandú", "x"], [".", ",", "!?", "$$$", ").", "_a", "-b", "...", ";", ":"]
    texts = [f"{w}{s} {w}{s}\n{w}{s}" for w in words for s in signs]
    texts += ["don't.", "it's 'st.", "a.b.c", "é.x", "3.14,5", "\nlorem.", " lorem.", "", "a\x01.b c", "\t\tlorem. x", "a\n\n.b", "\r\na"]
    texts += ["a<|endoftext|>b", "x.<|endoftext|>", "lorem <|endof", "a\n b.", "á\nb", "×.a ÷,", "a\n!b\n中. 中,"]
    own = Encoder(PATH, 2)
    assert own.encode(pa.array(texts, pa.large_string())) == own.encode_whole(texts)
    known = len(own.words)
    assert known < 120
    rng = random.Random(5)
    mixed = ["".join(rng.choice([*words, *signs, " ", " ", "\n", "'", "7", "́", "\t"]) for _ in range(30)) for _ in range(3_000)]
    assert own.encode(pa.array(mixed, pa.large_string())) == own.encode_whole(mixed)
