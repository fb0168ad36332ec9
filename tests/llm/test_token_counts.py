import random

import public_tokenizers
import sentencepiece

from pitchframe.llm.token_counts import PieceModel, count_tokens, stretches

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_are_the_library_s():
    rng = random.Random(2)
    parts = ["a", "b", "the", "é", "ñ", " ", " ", "\n", "\t", "   ", "'s", "1", "²", "漢", "<s>", "<0x0A>", "\x00", "▁", "ing", "zz"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["ab" * 500, "=" * 1000, "thequickbrown" * 100, " " * 300, "er" * 40, ""]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert PieceModel(PATH).count([(t, True) for t in texts]) == [len(e) for e in library.encode(texts)]


def test_stretches_of_a_long_text_add_up(prose):
    text = prose(3, 4000).replace(" lo ", "  lo \n")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert sum(PieceModel(PATH).count(list(stretches(text, 500)))) == len(library.encode(text))


def test_awkward_rows(make_docs, awkward):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = count_tokens(make_docs(awkward), PATH, limit=100).collect()
    expected = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in awkward]
    assert sorted(map(tuple, found), key=str) == sorted([(*e, e[2] > 100) for e in expected], key=str)
    assert count_tokens(make_docs([]), PATH).count() == 0
