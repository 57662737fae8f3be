"""Token-id files with a shared zstandard dictionary.

File format (little endian): the 8-byte magic; each document's ids as
unsigned 16-bit integers (32-bit if the header says so), compressed on its own
with the shared dictionary; then the index, one row per document (doc_id,
1 if it has an id, byte offset, compressed bytes, ids); then the footer
(SHA-256 of the dictionary, id width, index offset, documents, magic). A
document is read through one index row without touching the others."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, new_folder, pieces
from .filesystem import create, open_read, resolve
from .spanmemo import LibraryEncoder, worker_encoder

MAGIC = b"LLMIDS1\n"
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
FOOTER = struct.Struct("<32sBQQ8s")
#: Bounds of the sample that the dictionary is trained on, and its size.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 2_000, 4_096, 64 << 10
LEVEL = 3


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary from the serialized ids of about SAMPLE_DOCS texts (chosen
    by a hash, SAMPLE_CHARS characters each, never more than twice as many);
    few samples make a raw dictionary, none an empty one."""
    total = docs.count()
    share = F.lit(int(min(1.0, SAMPLE_DOCS / max(total, 1)) * (1 << 30)))
    rows = (docs.where((F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) < share) & (F.length("text") > 0))
            .select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_DOCS).collect())
    encoder = LibraryEncoder(tokenizer_path, keeps_space=False)
    width = id_width(encoder.tok.get_vocab_size())
    samples = []
    for _, _, data, off in pieces(pa.array([r.text for r in rows], pa.string())):
        ids, counts = encoder.encode(data, off)
        samples += [x.astype(width).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def id_width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


MANIFEST = "part int, path string, n_docs long, n_tokens long, first_id long, last_id long"


def _zdict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_file(folder: str, stem: str, docs: Iterator[tuple[int | None, np.ndarray]], raw_dict: bytes, width: str) -> tuple[str, int, int]:
    """Writes (doc_id, ids) in the order given; path, documents and ids."""
    zdict = _zdict(raw_dict)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict) if zdict else zstandard.ZstdCompressor(level=LEVEL)
    path, out = create(folder, stem, ".ids")
    index: list[tuple] = []
    with out:
        out.write(MAGIC)
        at, total = len(MAGIC), 0
        for doc_id, ids in docs:
            blob = packer.compress(ids.astype(width).tobytes())
            out.write(blob)
            index.append((doc_id or 0, doc_id is not None, at, len(blob), len(ids)))
            at += len(blob)
            total += len(ids)
        out.write(np.array(index, INDEX).tobytes())
        out.write(FOOTER.pack(hashlib.sha256(raw_dict).digest(), int(width[-1]), at, len(index), MAGIC))
    return path, len(index), total


def dictionary_path(folder: str, digest: bytes) -> str:
    """The dictionary's file beside the id files, named by its hash."""
    return f"{folder.rstrip('/')}/{digest.hex()}.zdict"


def store_dictionary(folder: str, raw_dict: bytes) -> None:
    system, root = resolve(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(dictionary_path(root, hashlib.sha256(raw_dict).digest()), compression=None) as out:
        out.write(raw_dict)


def load_dictionary(folder: str, digest: bytes) -> bytes:
    """The stored dictionary of that hash; an error if it's missing or another."""
    system, root = resolve(folder)
    with system.open_input_stream(dictionary_path(root, digest), compression=None) as f:
        raw = f.read()
    if hashlib.sha256(raw).digest() != digest:
        raise ValueError(f"{folder}: the dictionary {digest.hex()} is damaged")
    return raw


class IdFile:
    """Random access to a token-id file; without `raw_dict` the dictionary is
    read from the file's folder."""

    def __init__(self, path: str, raw_dict: bytes | None = None):
        self.file = open_read(path)
        size = self.file.size()
        if size < FOOTER.size:
            raise ValueError(f"{path}: not a token-id file")
        digest, width, at, n, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a token-id file")
        if raw_dict is None:
            raw_dict = load_dictionary(path.rsplit("/", 1)[0], digest)
        if digest != hashlib.sha256(raw_dict).digest():
            raise ValueError(f"{path}: not a token-id file of this dictionary")
        self.width = f"<u{width}"
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), INDEX)
        zdict = _zdict(raw_dict)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zdict) if zdict else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, k: int) -> int | None:
        return int(self.index[k]["doc_id"]) if self.index[k]["has_id"] else None

    def find(self, doc_id: int) -> range:
        """The places of a document; rows without an id stand before all others."""
        nulls = int(len(self) - np.count_nonzero(self.index["has_id"]))
        known = self.index["doc_id"][nulls:]
        return range(nulls + int(np.searchsorted(known, doc_id, "left")), nulls + int(np.searchsorted(known, doc_id, "right")))

    def ids(self, k: int) -> np.ndarray:
        row = self.index[k]
        blob = self.file.read_at(int(row["bytes"]), int(row["offset"]))
        return np.frombuffer(self.unpacker.decompress(blob, max_output_size=max(1, int(row["ids"]) * int(self.width[-1]))), self.width).astype("<u4")


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int) -> tuple[DataFrame, bytes]:
    """Encodes every whole text, appends end_id, and writes the ids to files
    in ascending order of doc_id (nulls first; equal ids by hash of the text):
    one file per range of ids. Gives the manifest (part, path, n_docs,
    n_tokens, first and last id), part in order of the ids, and the dictionary;
    both are stored in the folder too.

    docs: doc_id, text (further columns are ignored). Null and empty texts have
    the end id alone; repeated rows are written as often as they come; no rows
    give no files."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw_dict = train_dictionary(docs, tokenizer_path)
    store_dictionary(folder, raw_dict)
    shared = docs.sparkSession.sparkContext.broadcast(raw_dict)
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer_path, False)
        width = id_width(max(encoder.tok.get_vocab_size(), end_id + 1))

        span = [None, None]  # of the ids that are not null

        def encoded():
            end = np.array([end_id], np.uint32)
            for b in batches:
                for lo, hi, data, off in pieces(b.column("text")):
                    ids, counts = encoder.encode(data, off)
                    stops = np.cumsum(counts)
                    for doc_id, stop, n in zip(b.column("doc_id")[lo:hi].to_pylist(), stops.tolist(), counts.tolist()):
                        if doc_id is not None:
                            span[:] = [doc_id if span[0] is None else span[0], doc_id]
                        yield doc_id, np.concatenate([ids[stop - n:stop], end])

        part = TaskContext.get().partitionId()
        path, n_docs, n_tokens = write_file(folder, f"part-{part:06d}", encoded(), shared.value, width)
        if n_docs:
            yield batch(schema, [part], [path], [n_docs], [n_tokens], [span[0]], [span[1]])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = docs.withColumn("_tie", tie).repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest"), raw_dict


def document_ids(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each of its rows) from a folder of token-id
    files; any session can read them, the files hold all that is needed."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    out = []
    for row in files.orderBy("part").select("path").collect():  # one file, two at an edge, more for an id of very many rows
        file = IdFile(row["path"])
        out += [file.ids(k) for k in file.find(doc_id)]
    return out


def read_token_files(manifest: DataFrame, raw_dict: bytes) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32
    of every document in the files. The sum over files is one row per file."""
    shared = manifest.sparkSession.sparkContext.broadcast(raw_dict)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "path", before.cast("long").alias("start"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                file = IdFile(path, shared.value)
                for lo in range(0, len(file), 10_000):
                    some = range(lo, min(lo + 10_000, len(file)))
                    counts = file.index["ids"][lo:lo + len(some)].astype(np.int64)
                    crc = [zlib.crc32(file.ids(k).tobytes()) for k in some]
                    yield batch(schema, [file.doc_id(k) for k in some], start + np.cumsum(counts) - counts, counts, crc)
                    start += int(counts.sum())

    return files.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the token-id files to a new shared folder and reads them back."""
    manifest, raw_dict = write_token_files(docs, tokenizer_path, new_folder(docs.sparkSession, "token-ids"), end_id)
    return read_token_files(manifest, raw_dict)
