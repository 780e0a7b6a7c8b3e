"""Token ids in Arrow files of fixed-size lists (operator 2).

Documents are range-sorted by doc_id; each range is one file of record batches
with two columns of fixed-size lists: ``ids`` (uint16, or uint32 for more than
65,536 ids) and ``mask`` (bits, set on ids and not on the filling of the last
sequence).  A list of equal length needs no
offsets, so sequence i of a memory-mapped file is found by arithmetic and read
without a copy.  An index file beside it has doc_id, start and n_tokens of each
document, and a manifest gives the ids before each file.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.files import Committed, open_fs
from tessera.llm.scratch import Scratch, partitions

#: fixed values: the format of the tokenizer's vocabulary file
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_END = "\u0250"
CACHE_BYTES = 256 << 20
_ENTRY_BYTES = 240  # what an entry of a table takes beside the bytes of its word and ids
DEFAULT = "byte_bpe_50k.json"
TARGET_BYTES = 64 << 20


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, each distinct word once.

    The pre-tokenizer never joins over the blank before a word, so a text is cut
    there, and the ids of a piece do not depend on what surrounds it.  Pieces are
    kept in a bounded table; a new one is cut by the pre-tokenizer, and each part is
    encoded by the model of the tokenizers library.  Texts in which blanks meet other
    white space, or that hold the special token, go through the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path) as f:
            settings = json.load(f)
        model, before = settings["model"], settings.get("pre_tokenizer") or {}
        # the rules below are those of byte-level pieces; other files go through the library whole
        self.plain = model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not settings.get("normalizer") and not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout"))
        self.special = [t["content"] for t in settings.get("added_tokens") or []]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # the narrowest type that holds all ids
        self.type = np.dtype("<u2") if max([*model["vocab"].values(), *[t["id"] for t in settings.get("added_tokens") or []]]) < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0) if self.plain else None  # the pieces have a table of their own
        self.whole = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.control = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
        self.lines = re.compile(r"(?<=\S)\n(?=\S)")
        self.pattern = regex.compile(PATTERN)
        self.split = self.whole.pre_tokenizer.pre_tokenize_str if self.plain else None
        self.bytes = 0
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _part(self, letters: str) -> bytes:
        got = self.parts.get(letters)
        if got is None:
            got = self.parts[letters] = self._ids(letters)
            self.bytes += len(letters) + len(got) + _ENTRY_BYTES
        return got

    def _letters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(self.letters)

    def _piece(self, word: str, blank: str) -> bytes:
        """Ids of ``blank + word``; ``blank`` is a blank or nothing.  A line break between two other signs is a part of its own."""
        if "\n" not in word:
            return self._line(word, blank)
        first, *rest = self.lines.split(word)
        return b"".join([self._line(first, blank), *[x for line in rest for x in (self._part(self.letters[10]), self._line(line, ""))]])

    def _line(self, word: str, blank: str) -> bytes:
        """Words of Latin letters are one part, also with a full stop or comma after them; other ASCII is cut by
        the pre-tokenizer's pattern, and what is left by the pre-tokenizer itself."""
        lead = self.letters[32] if blank else ""
        if word.isalpha() and max(word) < LATIN_END:
            return self._part(lead + self._letters(word))
        if word[-1:] in (".", ",") and word[:-1].isalpha() and max(word) < LATIN_END:
            return self._part(lead + self._letters(word[:-1])) + self._part(word[-1])
        text = blank + word
        if text.isascii() and not self.control.search(text):
            return b"".join([self._part(self._letters(x)) for x in self.pattern.findall(text)])
        return b"".join([self._part(letters) for letters, _ in self.split(text)])

    def _new(self, table: dict[str, bytes], word: str, blank: str) -> bytes:
        """A word that is one part is in this table alone, and words with a full stop or comma are made from it."""
        stem = word[:-1] if word[-1:] in (".", ",") else word
        if not stem.isalpha() or not (stem.isascii() or max(stem) < LATIN_END):
            got = self._piece(word, blank)
        elif stem is word:
            got = self._ids((self.letters[32] if blank else "") + self._letters(word))
        else:
            got = (table.get(stem) or self._new(table, stem, blank)) + self._part(word[-1])
        table[word] = got
        self.bytes += len(word) + len(got) + _ENTRY_BYTES
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned ids of ``type``."""
        if not text:
            return b""
        if not self.plain or any(x in text for x in self.special):
            return self._whole(text)
        if self.bytes > CACHE_BYTES:
            self.first.clear()
            self.after.clear()
            self.parts.clear()
            self.bytes = 0
        head, *rest = text.split(" ")
        after = self.after
        out = list(map(after.get, rest))
        missing = [i for i, x in enumerate(out) if x is None]
        # blanks that meet other white space: such words are never in the table
        if any(not rest[i] or rest[i][0].isspace() for i in missing):
            return self._whole(text)
        for i in missing:
            out[i] = after.get(rest[i]) or self._new(after, rest[i], " ")
        if head:
            out.insert(0, self.first.get(head) or self._new(self.first, head, ""))
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.type).tobytes()


_encoders: dict[str, Encoder] = {}


def located(tokenizer: str) -> str:
    """The place of a vocabulary file on this machine: a path, or the name of one of the public files."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(tokenizer))


def encoder(tokenizer: str) -> Encoder:
    path = located(tokenizer)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


MANIFEST = "shard int, path string, docs long, tokens long, sequences long"


def _schema(length: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _writer(root: str, tokenizer: str, end_id: int, length: int, rows_a_batch: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], enc.type).tobytes()
        store, base = open_fs(root)
        shard = TaskContext.get().partitionId()
        path = f"{base}/part-{shard:06d}"
        width = enc.type.itemsize
        schema, block = _schema(length, enc.type), rows_a_batch * length * width
        docs = tokens = sequences = 0
        held: list[bytes] = []
        size = 0
        with Committed(store, f"{path}.arrow") as ids_file, Committed(store, f"{path}.index.arrow") as index_file, pa.ipc.new_file(ids_file.sink, schema) as ids_out, pa.ipc.new_file(index_file.sink, INDEX) as index_out:

            def flush(data: bytes, last: bool) -> bytes:
                nonlocal sequences
                cut = len(data) if last else len(data) // block * block
                for at in range(0, cut, block):
                    flat = np.frombuffer(data[at : min(at + block, cut)], enc.type)
                    n = -(-len(flat) // length)
                    ids, mask = np.zeros(n * length, enc.type), np.zeros(n * length, bool)
                    ids[: len(flat)], mask[: len(flat)] = flat, True
                    ids_out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))
                    sequences += n
                return data[cut:]

            for batch in batches:
                found: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text or "") + end
                    n = len(ids) // width
                    found.append((doc_id, tokens, n))
                    docs, tokens, size = docs + 1, tokens + n, size + len(ids)
                    held.append(ids)
                    if size >= block:
                        held = [flush(b"".join(held), False)]
                        size = len(held[0])
                if found:
                    index_out.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=INDEX))
            flush(b"".join(held), True)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "docs": docs, "tokens": tokens, "sequences": sequences}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("sequences", pa.int64())]))

    return write


def write_tokens(docs: DataFrame, root: str, scratch: Scratch, tokenizer: str, end_id: int = 2, length: int = 2048, rows_a_batch: int = 64) -> DataFrame:
    """Write the files of ``docs`` below ``root``; returns the manifest (one row a file) with ``base``, the ids before it."""
    spark = docs.sparkSession
    store, base = open_fs(root)
    store.create_dir(base, recursive=True)
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(partitions(spark), -(-total // TARGET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest = scratch.table(rows.mapInArrow(_writer(root, tokenizer, end_id, length, rows_a_batch), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return scratch.table(manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "based")


def read_sequences(path: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences ``first`` to ``last`` (exclusive) of a file, and how many ids each has.

    Random access: the batches that hold them are found by their number, and none
    other is read.  Inside one batch of a memory-mapped file the ids are not copied.
    """
    found = Sequences(path)
    return found.rows(first, last), found.lengths(first, last)


class Sequences:
    def __init__(self, path: str):
        store, local = open_fs(path) if "://" in path else (None, path)
        if store is None or store.type_name == "local":
            self.source = pa.memory_map(f"{local}.arrow")
        else:
            self.source = store.open_input_file(f"{local}.arrow")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.type = np.dtype(self.reader.schema.field("ids").type.value_type.to_pandas_dtype())
        self.a_batch = len(self.reader.get_batch(0)) if self.reader.num_record_batches else 1
        self._at, self._ids, self._mask = -1, np.zeros((0, self.length), self.type), np.zeros(0, np.uint8)

    def _load(self, k: int) -> None:
        if self._at != k:
            batch = self.reader.get_batch(k)
            bits = batch.column(1).flatten()
            self._ids = batch.column(0).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)
            self._mask = np.frombuffer(bits.buffers()[1], np.uint8)[bits.offset // 8 :]
            self._at = k

    def _parts(self, first: int, last: int) -> Iterator[slice]:
        for k in range(first // self.a_batch, -(-last // self.a_batch)):
            self._load(k)
            yield slice(max(0, first - k * self.a_batch), min(last - k * self.a_batch, len(self._ids)))

    def rows(self, first: int, last: int) -> np.ndarray:
        parts = [self._ids[at] for at in self._parts(first, last)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros((0, self.length), self.type), *parts])

    def lengths(self, first: int, last: int) -> np.ndarray:
        """The set bits of each sequence's mask."""
        a = self.length // 8
        parts = [np.bitwise_count(self._mask[at.start * a : at.stop * a].reshape(-1, a)).sum(axis=1) for at in self._parts(first, last)]
        return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file's stream; fails where the mask has none."""
        first, last = start // self.length, -(-(start + n) // self.length)
        lengths = self.lengths(first, last)
        at = slice(start - first * self.length, start - first * self.length + n)
        got = self.rows(first, last).reshape(-1)[at]
        if len(got) != n or (n and (lengths[:-1] != self.length).any()) or (n and at.stop > (len(lengths) - 1) * self.length + lengths[-1]):
            raise ValueError("the file holds fewer ids than its index says")
        return got


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(root)
        scheme = "" if store.type_name == "local" else root.split("://")[0] + "://"
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                sequences = Sequences(scheme + path)
                with store.open_input_file(f"{path}.index.arrow") as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                        sums = [zlib.crc32(sequences.tokens(int(s), int(n)).astype("<u4")) for s, n in zip(starts, counts, strict=True)]
                        yield pa.record_batch([part.column("doc_id"), pa.array(starts + base), part.column("n_tokens"), pa.array(sums, pa.int64())], schema=OUT)

    return read


def read_documents(manifest: DataFrame, root: str) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    return manifest.select("shard", "path", "base").repartitionByRange(n, "shard").mapInArrow(_read(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_documents(spark: SparkSession, docs: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """Write all of ``docs`` and read them back.

    ``tokenizer`` is a path or the name of a public vocabulary file, looked up on each
    worker.  A null text is empty and has the end id alone.  Rows of one doc_id follow
    each other by a hash of their texts; rows without an id come first.  An empty table
    gives files without sequences and an empty result.  Other columns are ignored.
    """
    scratch = Scratch(spark, "tokens")
    root = scratch.path("files")
    return read_documents(write_tokens(docs, root, scratch, tokenizer), root)
