"""Token-id files: a frame for each document under one shared zstandard dictionary.

A dictionary is trained once on the serialized ids of a bounded sample of documents (`SAMPLE_DOCS`, those of the lowest
hashes of the id, about, `SAMPLE_IDS` ids each). Every document's ids are then compressed on their own with it, so that a
short document can be read by itself: its frame's place stands in the file's offset index.

A file, numbers little-endian:
  header  magic "BTOK1\\0\\0\\0", bytes an id u32, 0 u32, SHA-256 of the dictionary (32 bytes)
  frames  one zstandard frame a document, in ascending order of doc_id (nulls first)
  index   of n documents: doc_id i64[n], is null u8[n], ids i64[n], frame's offset i64[n], frame's length i64[n]
  footer  n u64, index's offset u64, magic
Next to the files lie dictionary-<hash>.zdict and files.json, which lists the files in order with the number of ids
before each. Each file is the work of one task under a name of its own; only files of committed tasks are listed.

Defined results: null and empty texts are the end id alone; repeated rows and equal ids keep a frame each, ordered by
text; a text of any length is one frame; an empty table gives no files and no rows; other columns, whatever their names,
are left out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, delete, file_system, give_back, hash_sample, new_folder, small_batches, texts, tidy

MAGIC = b"BTOK1\0\0\0"
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES, LEVEL = 2000, 4096, 64 << 10, 3
KNOWN_WORDS, CHUNK_CHARS, JOINED = 600_000, 4 << 20, 2_000
FILE_DOCS, BEGINNING = 100_000, 64
#: Marks that may end a word; none begins a contraction.
MARKS = ".,;:!?*$%&#|)\""
#: Lower-case letters of the Latin and Cyrillic blocks, which every Unicode version holds for letters.
LETTERS = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{481}\x{48a}-\x{52f}]+$"


class Table:
    """Strings with their ids, laid end to end; string 0 is the empty one, without ids."""

    def __init__(self, dtype: np.dtype):
        self.strings, self.ids, self.start = pa.array([""]), np.zeros(0, dtype), np.zeros(2, np.int64)

    def grown(self, strings: list[str], ids: list[bytes]) -> Table:
        out = Table(self.ids.dtype)
        out.strings = pa.concat_arrays([self.strings, pa.array(strings, pa.string())])
        out.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.ids.dtype)])
        out.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) // self.ids.dtype.itemsize for x in ids], dtype=np.int64)])
        return out

    def places(self, strings: pa.Array) -> np.ndarray:
        """Where each string stands, -1 for none."""
        return pc.index_in(strings, value_set=self.strings).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def gathered(ids: np.ndarray, start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the table's rows one after another, and where each row's begin and end."""
    size = np.diff(start)[rows]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    return ids[np.repeat(start[rows] - ends[:-1], size) + np.arange(ends[-1])], ends


class WordEncoder:
    """tokenizers' ids of whole texts, serialized, through a table of words.

    Only for a tokenizer that drops white space, never looks across it, keeps runs of letters apart from marks and ends
    them with "</w>" (`split_words` says so; otherwise whole texts are encoded). Each stretch between white space then
    has ids of its own; new runs of letters are encoded many at a time, parted at their ends. Texts that lower-casing
    and splitting would not treat as the tokenizer does are encoded whole."""

    def __init__(self, path: str, split_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library's own would only hold memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.split_words = Tokenizer.from_file(path), split_words
        self.runs = Tokenizer(self.tokenizer.model)  # for runs of lower-case letters, which need no other step
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.known = Table(self.dtype)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def letters(self, runs: list[str]) -> list[bytes]:
        """The ids of runs of letters."""
        out = []
        for lo in range(0, len(runs), JOINED):
            part = runs[lo : lo + JOINED]
            ids = np.array(self.runs.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(cuts) != len(part):
                out += self.whole(part)
                continue
            raw, at = ids.tobytes(), 0
            for cut in cuts.tolist():
                out.append(raw[at:cut])
                at = cut
        return out

    @staticmethod
    def plain(text: str) -> bool:
        """Whether lower() and splitting at white space do what the tokenizer does to the text before it merges."""
        if text.isascii():
            return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        if any(c in text for c in ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", "\u0130")):
            return False
        # lower-casing comes after composing, so what only composes once it is lower-cased stays as it is in the tokenizer
        return unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower())

    def serialized(self, docs: list[str]) -> list[bytes]:
        if not self.split_words:
            return self.whole(docs)
        plain = [self.plain(t) for t in docs]
        lists = pc.utf8_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(docs, plain, strict=True)], pa.string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        runs = pc.utf8_rtrim(words, MARKS)
        split = pc.match_substring_regex(runs, LETTERS)
        marked = pc.and_(split, pc.not_equal(pc.binary_length(words), pc.binary_length(runs))).to_numpy(zero_copy_only=False)
        marks = pa.array([w[len(r) :] for w, r in zip(words.filter(pa.array(marked)).to_pylist(), runs.filter(pa.array(marked)).to_pylist(), strict=True)], pa.string())
        keys = pa.concat_arrays([pc.if_else(split, runs, words), marks]).dictionary_encode()
        table, at = self.known, self.known.places(keys.dictionary)
        if (new := at < 0).any():
            missing = keys.dictionary.filter(pa.array(new))
            letters = pc.match_substring_regex(missing, LETTERS)
            parts = [(missing.filter(letters).to_pylist(), self.letters), (missing.filter(pc.invert(letters)).to_pylist(), self.whole)]
            at[new] = len(table.strings) + np.argsort(np.argsort(~letters.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            table = table.grown([w for ws, _ in parts for w in ws], [x for ws, encode in parts for x in encode(ws)])
            if len(table.strings) <= KNOWN_WORDS:
                self.known = table
        at = at[keys.indices.to_numpy()]
        rows = np.zeros((len(words), 2), np.int64)
        rows[:, 0] = at[: len(words)]
        rows[marked, 1] = at[len(words) :]
        ids, ends = gathered(table.ids, table.start, rows.ravel())
        ids, ends = gathered(ids, ends[::2], coded.indices.to_numpy())
        raw, cuts = ids.tobytes(), (ends[lists.offsets.to_numpy()] * self.width).tolist()
        return [raw[cuts[i] : cuts[i + 1]] if p else self.whole([t])[0] for i, (t, p) in enumerate(zip(docs, plain, strict=True))]


@functools.lru_cache(2)
def encoder_for(path: str) -> WordEncoder:
    """The process's encoder: what one task has learned serves the worker's next."""
    return WordEncoder(path, vocabulary_splits_words(path))


def vocabulary_splits_words(path: str) -> bool:
    """Whether the tokenizer file drops white space before it merges (word_bpe_49k.json does)."""
    with open(path) as f:
        spec = json.load(f)
    steps = [s for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and "[^\\s" in steps[0]["pattern"].get("Regex", "") and not steps[-1].get("add_prefix_space")


def train_dictionary(df: DataFrame, path: str, end_id: int, n_rows: int) -> bytes:
    """The shared dictionary, from a bounded sample of df's n_rows. With too little to train on: the sample's bytes as they are."""
    import zstandard

    encoder = encoder_for(path)
    rows = hash_sample(df, n_rows, SAMPLE_DOCS, "id").limit(2 * SAMPLE_DOCS).select(F.substring(F.coalesce("text", F.lit("")), 1, 8 * SAMPLE_IDS).alias("text")).collect()
    end = np.array([end_id], encoder.dtype).tobytes()
    data = [s[: SAMPLE_IDS * encoder.width] + end for s in encoder.serialized([r.text for r in rows])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, data).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(data) or end * 8)[:DICTIONARY_BYTES].ljust(8, b"\0")


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", id_col: str = "doc_id", partitions: int | None = None) -> None:
    """Encodes every text, appends end_id, and writes the files in ascending order of id_col, then text. One shuffle, by range.

    Files come to about `FILE_DOCS` documents at most (or to `partitions` files), so that what a task keeps of its index is bounded;
    rows that share an id are parted too, unless their first `BEGINNING` characters are the same."""
    import zstandard

    spark = small_batches(df.sparkSession)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    src = df.select(df[id_col].cast("long").alias("id"), df[text].cast("string").alias("text"))
    n_rows = src.select("id").count()
    raw = train_dictionary(src, tokenizer, end_id, n_rows)
    digest = hashlib.sha256(raw).digest()
    with fs.open_output_stream(f"{root}/dictionary-{digest.hex()}.zdict") as f:
        f.write(raw)

    def run(batches):
        encoder = encoder_for(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_content_size=True)
        ids, sizes, lengths, null, first, out = array("q"), array("q"), array("q"), bytearray(), None, None
        for k, b in enumerate(batches):
            if k % 8 == 7:
                give_back()
            if out is None and b.num_rows:
                fs, root = file_system(folder)
                name = f"{uuid.uuid4().hex}.btok"
                out = fs.open_output_stream(f"{root}/{name}")
                out.write(MAGIC + struct.pack("<II", encoder.width, 0) + digest)
                first = b.column("id")[0].as_py(), b.column("beginning")[0].as_py()
            docs = texts(b)
            for part in chunks(docs, CHUNK_CHARS):
                for s in encoder.serialized(part):
                    frame = packer.compress(s + end)
                    out.write(frame)
                    sizes.append(len(s) // encoder.width + 1), lengths.append(len(frame))
            ids.frombytes(b.column("id").fill_null(0).to_numpy().tobytes())
            null += b.column("id").is_null().to_numpy(zero_copy_only=False).tobytes()
        if out is None:
            return
        n, head = len(ids), 48
        length = np.array(lengths, "<i8")
        offset = head + np.concatenate([np.zeros(1, "<i8"), np.cumsum(length)])
        for x in (np.array(ids, "<i8"), np.frombuffer(null, np.uint8), np.array(sizes, "<i8"), offset[:-1].astype("<i8"), length):
            out.write(x.tobytes())
        out.write(struct.pack("<QQ", n, int(offset[-1])) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(first[:1], pa.int64()), pa.array(first[1:], pa.string()), pa.array([n], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["name", "first", "beginning", "docs", "ids"])

    row = "name string, first long, beginning string, docs long, ids long"
    src = src.withColumn("beginning", F.substring("text", 1, BEGINNING))
    if not partitions and n_rows > FILE_DOCS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        partitions = -(-n_rows // FILE_DOCS)
    ranged = src.repartitionByRange(*([partitions] if partitions else []), "id", "beginning")
    ranged.sortWithinPartitions("id", "text").mapInArrow(tidy(run), row).write.parquet(f"{folder}/_packed")
    rows = spark.read.schema(row).parquet(f"{folder}/_packed").collect()  # one a file
    delete(spark, f"{folder}/_packed")
    listed, start = [], 0
    for r in sorted(rows, key=lambda r: (r.first is not None, r.first or 0, r.beginning is not None, r.beginning or "")):
        listed.append([r.name, start, r.docs])
        start += r.ids
    with fs.open_output_stream(f"{root}/files.json") as f:
        f.write(json.dumps({"dictionary": digest.hex(), "files": listed}).encode())


class TokenFile:
    """One file opened for reading: whole, or document by document through its index."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None):
        import zstandard

        fs, root = file_system(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        head, size = self.file.read_at(48, 0), self.file.size()
        tail = self.file.read_at(24, size - 24)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{name} isn't a whole token file")
        self.dtype = np.dtype(f"<u{struct.unpack_from('<I', head, 8)[0]}")
        if dictionary is None:
            with fs.open_input_file(f"{root}/dictionary-{head[16:48].hex()}.zdict") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != head[16:48]:
            raise ValueError(f"{name} was written with another dictionary")
        n, at = struct.unpack("<QQ", tail[:16])
        index = self.file.read_at(size - 24 - at, at)
        self.null = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.doc_id, self.n_ids, self.offset, self.length = (np.frombuffer(index, "<i8", n, k) for k in (0, 9 * n, 17 * n, 25 * n))
        self.codec = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return np.frombuffer(self.codec.decompress(self.file.read_at(int(self.length[k]), int(self.offset[k]))), self.dtype)

    def find(self, doc_id: int) -> list[int]:
        nulls = int(self.null.sum())
        lo, hi = (nulls + int(np.searchsorted(self.doc_id[nulls:], doc_id, side)) for side in ("left", "right"))
        return list(range(lo, hi))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/files.json") as f:
        listed = json.loads(f.read())["files"]

    def run(batches):
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                f = TokenFile(folder, name)
                starts = start + np.concatenate([np.zeros(1, np.int64), np.cumsum(f.n_ids)])
                for lo in range(0, len(f.doc_id), 2000):
                    part = range(lo, min(len(f.doc_id), lo + 2000))
                    got = [f.ids(k) for k in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(f.doc_id[lo : lo + 2000], mask=f.null[lo : lo + 2000]), pa.array(starts[lo : lo + len(part)]),
                            pa.array([len(x) for x in got], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = spark.createDataFrame([(n, s) for n, s, _ in listed], "name string, start long")
    return files.repartition(max(1, len(listed))).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(df: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    folder = new_folder(df.sparkSession, "tokens")
    write_token_files(df, folder, tokenizer, end_id, text, id_col)
    return read_token_files(df.sparkSession, folder)
