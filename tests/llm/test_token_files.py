import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brooktext.llm import token_files
from brooktext.llm.shared import file_system, new_folder
from brooktext.llm.token_files import TokenFile, WordEncoder, read_token_files, token_table, vocabulary_splits_words, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows, path=PATH):
    tokenizer, start, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_words_like_the_library():
    assert vocabulary_splits_words(PATH) and not vocabulary_splits_words(public_tokenizers.path("byte_bpe_50k.json"))
    e = WordEncoder(PATH, True)
    rng = random.Random(4)
    alphabet = "ab' sStTdllreve.,!*12é́ñ中 \n\tΣİ|<>\x1c\x85\xa0"
    docs = ["", "   ", "don't 'tis it's 'S's", "<|endoftext|>k", "x" * 500 + ". yy**", "ǅ ŉ ß ẞ ﬁ ½ ①"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert e.serialized(docs) == e.whole(docs)


def test_marks_that_compose_once_lower_cased():
    e = WordEncoder(PATH, True)
    rng = random.Random(41)
    letters, marks = "aTtHhJjWwYyZzSsΑαЖжIiǄ", [chr(c) for c in (0x300, 0x301, 0x302, 0x307, 0x308, 0x30A, 0x30C, 0x323, 0x327, 0x331, 0x345)]
    docs = ["T\u0308", "x H\u0331y", "J\u030c W\u030a.", "Y\u030a!"]
    docs += ["".join(rng.choice(letters) + rng.choice(["", "", rng.choice(marks), rng.choice(marks) + rng.choice(marks), " ", "."]) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    assert e.serialized(docs) == e.whole(docs)


def test_table_like_brute_force(odd, empty, docs):
    assert token_table(empty, PATH).count() == 0
    for df in (docs, odd.where("doc_id is not null"), odd):
        got = [tuple(r)[:4] for r in token_table(df, PATH).collect()]
        want = brute([(r.doc_id, r.text) for r in df.collect()])
        assert sorted(got, key=lambda r: r[1]) == want


def test_files_are_sized_by_the_count_and_part_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 8)
    rows = [(7, f"{k % 90:02d} one id, many texts") for k in range(180)] + [(7, None), (7, ""), (None, "no id"), (None, "no id, second"), (3, "z"), (9, "a")]
    folder = new_folder(spark, "tokens-test")
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, PATH, 1)
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/files.json") as f:
        listed = json.loads(f.read())["files"]
    assert len(listed) > 12 and max(n for *_, n in listed) < 40 and [s for _, s, _ in listed] == sorted(s for _, s, _ in listed)
    got = sorted((tuple(r)[:4] for r in read_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert got == brute(rows)


def test_other_tokenizers(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    some = docs.limit(40)
    assert sorted((tuple(r) for r in token_table(some, path).collect()), key=lambda r: r[1]) == brute([(r.doc_id, r.text) for r in some.collect()], path)


def test_single_documents_and_the_dictionary(spark, docs):
    folder = new_folder(spark, "tokens-test")
    write_token_files(docs, folder, PATH, 1, partitions=3)
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/files.json") as f:
        listed = json.loads(f.read())
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, *_ in listed["files"]:
        f = TokenFile(folder, name)
        seen += f.doc_id.tolist()
        for i in f.doc_id.tolist()[::7]:
            (k,) = f.find(i)
            assert f.ids(k).tolist() == tokenizer.encode(texts[i], add_special_tokens=False).ids + [1]
        assert f.find(10**9) == []
        with pytest.raises(ValueError):
            TokenFile(folder, name, b"another dictionary")
    assert seen == sorted(texts) and read_token_files(spark, folder).count() == len(texts)
