"""Token ids in files of length-delimited binary records, with an offset index.

A record is one document, in ascending key order over all files:

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked crc32 of the length bytes
    payload  key (int64), then ids (unsigned 16 or 32 bits, little-endian)
    check    4 bytes: masked crc32 of the payload
    end      1 byte, 0x0A

The end byte lets Spark's text writer, with its commit protocol, write the files on
any file system; nothing is opened by path on an executor. The masked checksum is
the crc rotated right by 15 bits plus a constant, so that a checksum inside a payload
is not mistaken for one around it. `offset_index` reads the files, checks every record
and keeps where each lies; `read_by_index` reads the records of chosen index rows.

Null texts count as empty: such a document has only the end id. Equal keys keep one
record for each row. Null keys are refused by an error, as records need a number.
Key columns may have any name; other columns are left out.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from smeltry.llm.common import parts_for, shared_folder, table, text_bytes
from smeltry.llm.piece_bpe import Chunks
from smeltry.llm.sentence_pieces import _slices

#: Text bytes that go into one file.
FILE_BYTES = 16 << 20
#: Fixed value of the masking of checksums.
MASK_DELTA = 0xA282EAD8

# White space of the Unicode standard, at which a text may be cut between words.
_WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = regex.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_EACH_WHITE = [c for c in map(chr, range(0x3001)) if regex.fullmatch(f"[{_WHITE}]", c)]
#: White space before a space, and beside a line end.
_SPACED = [c + " " for c in _EACH_WHITE]
_LINED = [c + "\n" for c in _EACH_WHITE] + ["\n" + c for c in _EACH_WHITE if c != "\n"]
#: Marks that the pattern takes for themselves behind a word.
_MARKS = tuple(",.;:!?)")


class ByteLevel:
    """Byte-level BPE of a tokenizer file, by chunks that are remembered.

    The split pattern never joins a character and white space after it, so each run of
    white space with the word behind it can be encoded alone. Texts that hold an added
    token's string are encoded whole.
    """

    def __init__(self, path: str, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = kind
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        alphabet = {b: t for b, t in enumerate(self._alphabet())}
        self.letters = str.maketrans({chr(b): t for b, t in alphabet.items()})
        self.space = alphabet[0x20]
        self.tokens = Chunks(self._token)
        #: By the word behind one space, and by the run of white space with its word.
        self.words, self.runs = Chunks(self._word), Chunks(self._run)
        self.line_end = self._token("\n")

    @staticmethod
    def _alphabet() -> list[str]:
        """Byte-level letters: printable Latin-1 stands for itself, the rest follows from 256."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind == '<u2' else 'I'}", *ids)

    def _token(self, token: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(token.encode().decode("latin-1").translate(self.letters))])

    def _word(self, word: str) -> bytes:
        if word.isascii():
            # the pattern keeps ASCII letters together, and these letters stand for themselves
            if word.isalpha():
                return self._pack([t.id for t in self.model.tokenize(self.space + word)])
            if word.endswith(_MARKS) and word[:-1].isalpha():
                return self.words[word[:-1]] + self.tokens[word[-1]]
        first, *rest = self.pattern.findall(" " + word)
        if not rest:
            return self._token(first)
        # the word itself without the marks behind it, or a mark that stands first
        head = self.words[first[1:]] if len(first) > 1 else self.tokens[first]
        return b"".join((head, *map(self.tokens.__getitem__, rest)))

    def _run(self, run: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(run)))

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return b"".join((self.runs[first], *map(self.words.__getitem__, rest)))

    def encode(self, text: str) -> bytes:
        """Packed ids of a text, as the tokenizer gives them without special tokens added."""
        if not text:
            return b""
        if any(x in text for x in self.added):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if text[0] == " " or any(pair in text for pair in _SPACED):
            out = b"".join(map(self.runs.__getitem__, _CHUNK.findall(text)))
        else:
            # a line end between words is a token of its own
            lines = [text] if text[0] == "\n" or text[-1] == "\n" or any(pair in text for pair in _LINED) else text.split("\n")
            out = self.line_end.join([self._line(line) for line in lines])
        for known in (self.words, self.runs, self.tokens):
            known.keep_small()
        return out


@lru_cache(maxsize=4)
def load(path: str, kind: str) -> ByteLevel:
    return ByteLevel(path, kind)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), b"\n"))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """Payload of the record at an offset and the offset behind it; raises where a check fails."""
    size = bytes(data[at : at + 8])
    (n,) = struct.unpack("<Q", size)
    (check,) = struct.unpack_from("<I", data, at + 8)
    payload = data[at + 12 : at + 12 + n]
    if check != masked(size) or len(payload) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload) or data[at + 16 + n] != 10:
        raise ValueError(f"broken record at {at}")
    return payload, at + 17 + n


def write_records(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text", wide: bool = False) -> None:
    """Encodes every text and writes record files in ascending key order.

    `wide` takes 32 bits an id; else 16, for vocabularies of up to 65,536.
    """
    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    kind = "<u4" if wide else "<u2"

    def run(batches):
        model = load(tokenizer, kind)
        tail = b"" if end_id is None else np.asarray([end_id], kind).tobytes()
        for part in _slices(batches):
            keys, texts = part.column("key").to_pylist(), part.column("text").to_pylist()
            out = [frame(struct.pack("<q", k) + model.encode(x or "") + tail)[:-1] for k, x in zip(keys, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    files = parts_for(text_bytes(source), FILE_BYTES)
    ordered = source.repartitionByRange(files, "key").sortWithinPartitions("key")
    ordered.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.text(path)


def _records(wide: bool, with_ids: bool):
    kind = "<u4" if wide else "<u2"

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                at = start = 0
                rows: list[tuple] = []
                while at < len(data):
                    payload, behind = unframe(data, at)
                    ids = np.frombuffer(payload, kind, offset=8).astype("<u4")
                    rows.append((path, at, behind - at, struct.unpack_from("<q", payload)[0], start, len(ids), zlib.crc32(ids), ids.tobytes() if with_ids else None))
                    start += len(ids)
                    at = behind
                    if at == len(data) or len(rows) == 2000:
                        columns = list(zip(*rows, strict=True))
                        types = [pa.string(), *[pa.int64()] * 6, pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "at", "n_bytes", "doc_id", "in_file", "n_tokens", "ids_crc32", "ids"])
                        rows = []

    return run


_FIELDS = "path string, at long, n_bytes long, doc_id long, in_file long, n_tokens long, ids_crc32 long, ids binary"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def offset_index(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """A row for each record: path, at (offset), n_bytes, doc_id, start (ids of all records before), n_tokens, ids_crc32.

    Every record's checks are verified. One row for each file, never one for each record,
    meets in the running total over files.
    """
    rows = _files(spark, path).mapInArrow(_records(wide, False), _FIELDS).drop("ids")
    # names don't sort: part-100000 stands before part-10001
    totals = rows.groupBy("path").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    before = totals.select("path", (F.sum("n").over(Window.orderBy("lo", "hi", "path")) - F.col("n")).alias("before"))
    return rows.join(before, "path").select("path", "at", "n_bytes", "doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def write_index(spark: SparkSession, path: str, index_path: str, wide: bool = False) -> DataFrame:
    offset_index(spark, path, wide).write.parquet(index_path)
    return spark.read.parquet(index_path)


def read_by_index(spark: SparkSession, path: str, index: DataFrame, wide: bool = False, order: Column | None = None) -> DataFrame:
    """doc_id and packed ids (unsigned 32 bits) of the records in `index`, in a shuffled or other order."""
    found = _files(spark, path).mapInArrow(_records(wide, True), _FIELDS).select("path", "at", "doc_id", "n_tokens", "ids")
    chosen = found.join(index.select("path", "at"), ["path", "at"], "left_semi").drop("path", "at")
    return chosen if order is None else chosen.sort(order)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_records(table(spark, sf_dir, "documents"), f"{path}/records", public_tokenizers.path("byte_bpe_50k.json"))
    index = write_index(spark, f"{path}/records", f"{path}/index")
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")
