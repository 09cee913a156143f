import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from brooktext.llm.pieces import Encoder, decode_pieces, encode_pieces, piece_table

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_like_the_library():
    library, e = sentencepiece.SentencePieceProcessor(model_file=PATH), Encoder(PATH)
    rng = random.Random(6)
    words = "the of and a to in is you that it he was for on are as with his they be this have from or one had by word but not what all were we when".split()
    docs = ["", "  ", " a b", "a  b", "▁x ▁", "a\x00b", "<s>hi</s>", "<0x41>", "aaaaaaaaaaaaaaaaaaaa", "中文字 テスト 😀😀 x", "\n\n\n .", "x" * 5000, " " * 300 + "end"]
    docs += ["".join(rng.choice("abcdeéñ .,\n01!?-_<>/=()中の😀\t  tnshriou") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    docs += [" ".join("".join(rng.choices(words, k=rng.randint(1, 4))).capitalize() for _ in range(20)) for _ in range(500)]
    ids, ends = e.encode(docs)
    back = e.decode(ids, ends)
    for k, t in enumerate(docs):
        want = library.encode(t)
        assert ids[ends[k] : ends[k + 1]].tolist() == want, t
        assert back[k] == library.decode(want), t


def test_white_space_like_the_library():
    """Runs of marks, alone and before words, whose merges have equal scores; all of them go through the suffix array."""
    library, e = sentencepiece.SentencePieceProcessor(model_file=PATH), Encoder(PATH)
    e.model.merged = None  # nothing is merged piece by piece once the model is loaded
    rng = random.Random(7)
    docs = [" " * n + word + " " * m for n in range(50) for word in ("", "the", "中", "\t", ".", "x  y") for m in (0, 1, 2, 15, 33)]
    parts = ["    ", " ", "  ", "\n", "if", "the", "(x)", "中", "return", "\t", "\n        ", "▁", "😀"]
    docs += ["".join(rng.choice([*parts, " " * rng.randint(1, 40)]) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    with open(__file__) as f:
        docs.append(f.read())
    ids, ends = e.encode(docs)
    for k, t in enumerate(docs):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t), t


def test_tables(odd, empty, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert piece_table(empty, PATH).count() == 0
    for df in (odd, docs):
        texts = sorted((repr(r.doc_id), r.text or "") for r in df.collect())
        want = sorted((i, len(library.encode(t)), zlib.crc32(np.array(library.encode(t), "<u4").tobytes())) for i, t in texts)
        got = piece_table(df, PATH).collect()
        assert sorted((repr(r.doc_id), r.n_pieces, r.ids_crc32) for r in got) == want and all(r.round_trip for r in got)


def test_columns(odd):
    coded = encode_pieces(odd.withColumnRenamed("label", "ids"), PATH, check="same")
    assert coded.columns == [*(c for c in odd.columns if c != "label"), "ids", "same"] and coded.where("not same").count() == 0
    for r in decode_pieces(coded, PATH).collect():
        assert r.decoded == (r.text or "")
