"""Token ids in flat binary files (operator 1).

A folder holds, for every range of ids, `<part>-<attempt>.bin` (token ids, unsigned 16 or 32 bits, little-endian, nothing else)
and `<part>-<attempt>.idx` (64-bit numbers: the count of documents n, n ids, n + 1 offsets in tokens from the start of the part),
and the table `manifest` with a row per part: part, name, docs, tokens, bits, base. `base` is the prefix sum of the tokens of
earlier parts, so document k of a part starts at base + offset[k]. A file counts only if the manifest names it: tasks write under
a name of their own, and what a lost or repeated attempt left behind is never read.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.llm.common import handed_back, small_batches

#: Stands for a null id in an .idx file (a fixed value).
NULL_ID = -(2**63)


def filesystem(uri: str):
    """(file system, path) of a URI; local files, and whatever stores pyarrow can reach."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


#: Words whose ids a worker keeps at hand, over all its tasks; beyond it only those of the batch at hand stay, so memory is bounded.
MOST_WORDS = 150_000
#: Marks tokens that end a word (a fixed value of such vocabularies).
WORD_END = "</w>"

#: First code point beyond Latin letters (a fixed value of Unicode).
BEYOND_LATIN = "\u0250"

_stores: dict = {}


def plain(word: str) -> bool:
    """Whether a word is, and stays in composed lower case, Latin letters alone, so that no tokenizer parts it or joins it to a neighbour."""
    if not word.isalpha():
        return False
    if word.isascii():
        return True
    made = unicodedata.normalize("NFC", word).lower()
    return made.isalpha() and max(made) < BEYOND_LATIN


class WordIds:
    """Ids of texts as bytes.

    A tokenizer that drops blanks never joins what a space or line feed parts; for one like that, distinct words are encoded once.
    Words of plain letters are encoded many at a time: each ends in one token that the vocabulary marks as a word's end, which
    parts them again, and should their number ever differ, the words go one by one. All other words are encoded whole, and other
    tokenizers encode whole texts.
    """

    def __init__(self, vocabulary: str, bits: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.type, self.known = Tokenizer.from_file(vocabulary), {16: "H", 32: "I"}[bits], {"": b""}
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_word = all(one(f"{a} {b}\n{a}") == one(a) + one(b) + one(a) for a, b in (("ab", "cd"), ("x.", "'s"), (",", "9")))
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends[[k for w, k in words.items() if w.endswith(WORD_END)]] = True

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.type, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lists = [text.replace("\n", " ").split(" ") for text in texts]
        words: set[str] = {""}
        for some in lists:
            words.update(some)
        if len(self.known) > MOST_WORDS:
            self.known = {w: self.known[w] for w in words.intersection(self.known)}
        self.learn(words.difference(self.known))
        return [b"".join(map(self.known.__getitem__, some)) for some in lists]

    def learn(self, words: set[str]) -> None:
        """Encodes new words. A closing comma or full stop after plain letters is always a token apart."""
        letters, closed, rest = [], [], []
        for w in words:
            if plain(w):
                letters.append(w)
            elif w[-1] in ",." and plain(w[:-1]):
                closed.append(w)
            else:
                rest.append(w)
        letters += {w[:-1] for w in closed}.difference(self.known, words)
        rest += [p for p in ",." if p not in self.known and p not in words]
        lots = [letters[at : at + 400] for at in range(0, len(letters), 400)]
        width = array(self.type).itemsize
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(lot) for lot in lots], add_special_tokens=False), strict=True):
            ids = e.ids
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(lot) or not ids or stops[-1] != len(ids):
                rest += lot
                continue
            data, places = self.pack(ids), (stops * width).tolist()
            self.known.update(zip(lot, [data[i:j] for i, j in zip([0, *places], places, strict=False)], strict=True))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = self.pack(e.ids)
        for w in closed:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1]]


def word_ids(vocabulary: str, bits: int) -> WordIds:
    """A worker's store, which its later tasks go on with."""
    if (vocabulary, bits) not in _stores:
        _stores.clear()
        _stores[vocabulary, bits] = WordIds(vocabulary, bits)
    return _stores[vocabulary, bits]


def _writer(path: str, vocabulary: str, end_id: int, bits: int):
    def run(batches):
        ids = word_ids(vocabulary, bits)
        end = ids.pack([end_id])
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        fs, root = filesystem(path)
        out, docs, ends = None, [], [0]
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.bin", buffer_size=1 << 20)
            for doc, data in zip(batch.column(0).to_pylist(), ids.encode([text or "" for text in batch.column(1).to_pylist()]), strict=True):
                data += end
                out.write(data)
                docs.append(NULL_ID if doc is None else doc)
                ends.append(ends[-1] + len(data) * 8 // bits)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array([len(docs), *docs, *ends], "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(docs)], "tokens": [ends[-1]]})

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files of docs in ascending id order to `path` (a folder that all executors share); gives the manifest.

    Null or empty texts give the end id alone. Null ids come first. Rows that repeat an id stay, ordered by text. An empty table
    gives an empty manifest. Ids are cast to 64-bit integers. Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    bits = 16 if max(Tokenizer.from_file(vocabulary).get_vocab_size() - 1, end_id) < 2**16 else 32
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(lambda b: handed_back(_writer(path, vocabulary, end_id, bits)(b)), "part bigint, name string, docs bigint, tokens bigint").write.parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts.select("*", F.lit(bits).alias("bits"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part bigint, name string, docs bigint, tokens bigint, bits int, base bigint").parquet(f"{path}/manifest")


def _bytes_of(fs, path: str, start: int, stop: int):
    """A slice of a file: memory-mapped where the store allows it, else read at its place."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r", start, (stop - start,)) if stop > start else np.empty(0, np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at(stop - start, start), np.uint8)


def map_tokens(spark: SparkSession, path: str, make, fields: dict[str, pa.DataType], schema: str, docs_at_once: int = 2000) -> DataFrame:
    """(doc_id, start, n_tokens, ...): a row per document, with what make(ids as unsigned 32-bit array) gives for `fields`."""
    manifest = read_manifest(spark, path)
    n = manifest.count()

    def run(batches):
        fs, root = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                file = f"{root}/{row['name']}"
                index = np.frombuffer(_bytes_of(fs, f"{file}.idx", 0, 8 * (2 * row["docs"] + 2)), "<i8")
                docs, ends = index[1 : row["docs"] + 1], index[row["docs"] + 1 :]
                width = row["bits"] // 8
                for at in range(0, row["docs"], docs_at_once):
                    e = ends[at : at + docs_at_once + 1]
                    ids = np.asarray(_bytes_of(fs, f"{file}.bin", int(e[0]) * width, int(e[-1]) * width)).view(f"<u{width}").astype("<u4")
                    some = docs[at : at + docs_at_once]
                    made = [make(ids[i - e[0] : j - e[0]]) for i, j in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
                    columns = [pa.array([None if d == NULL_ID else d for d in some.tolist()], pa.int64()), pa.array(row["base"] + e[:-1]), pa.array(np.diff(e))]
                    columns += [pa.array([m[k] for m in made], t) for k, t in enumerate(fields.values())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", *fields])

    return manifest.repartitionByRange(max(1, n), "part").mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {schema}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<bigint>), from the files."""
    return map_tokens(spark, path, lambda ids: (ids.tolist(),), {"ids": pa.list_(pa.int64())}, "ids array<bigint>", 200)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum is over the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return map_tokens(spark, path, lambda ids: (zlib.crc32(ids.tobytes()),), {"ids_crc32": pa.int64()}, "ids_crc32 bigint")
