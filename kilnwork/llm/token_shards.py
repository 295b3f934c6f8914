"""Token ids in binary shards, with a minimal perfect hash from document keys to places in the shards.

Layout of a folder (integers are little-endian):

- shard-PPPPPP-KKKK.bin: 16 bytes (b"TOKS", version 1, bytes an id: 2 or 4, number of ids as a 64-bit integer), then the ids, 2 bytes
  each where the vocabulary has at most 65,536 ids and 4 bytes otherwise. Shards are cut at document ends after SHARD_TOKENS ids;
  in the order of their names they hold the documents in ascending doc_id.
- directory/ (Parquet): copy (0, 1, .. among rows of equal doc_id), doc_id, part, cut (the shard's two numbers), at, n_tokens.
- index-NNNNNN.mph: the keys (doc_id, copy) whose hash falls in bucket N: a seed under which the bucket's keys have distinct 64-bit
  hashes, a minimal perfect hash of those, then for each of its places a 32-bit fingerprint, the shard's numbers, the first id and the
  number of ids. Look-up: bucket, place, fingerprint, one read.

Tasks write under a name of their own and rename at the end. A task that runs again, after an executor is lost, writes the same
bytes under the same name.

Texts are cut before a space that follows a printable ASCII or Latin letter. No rule of the tokenizer's splitting pattern joins
characters across such a place, so the ids of the pieces are the ids of the text. A worker remembers the words that it has encoded; those
of a lot of texts that it does not know are encoded together, joined again, and parted by the bytes that each id stands for.
Texts with a special token's string are encoded whole, and so is everything where the vocabulary file asks for another splitting or
for normalising.

Rows are dealt in ranges of (doc_id, hash of the text), so that an id on a third of all rows is many tasks; copies of an id that
spans several are numbered through by the counts of each range.

Defined results: a null or empty text has the end id alone; equal doc_ids are kept as copies, ordered by their text's hash; a null
doc_id comes first; an empty table gives an empty folder and no rows; further columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnwork.llm.mph import MinimalPerfectHash
from kilnwork.llm.shared import table, work_dir, written
from kilnwork.llm.words import mix

SHARD_TOKENS = 8 << 20
BUCKET_KEYS = 200_000
END_ID = 0
#: Bytes that a worker's memory of words may take, and what an entry takes besides its text and ids.
REMEMBERED, _ENTRY = 160 << 20, 200
#: Bytes of text in a lot, about, and words in a string that is encoded.
LOT, JOINED = 4 << 20, 64
_MAGIC = b"TOKS"
_SAFE = re.compile(r"(?<=[!-~À-ɏ])(?= )")
_encoders: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """Ids by word. turn(), at half of REMEMBERED bytes, makes the newer entries the older ones and lets those go."""

    def __init__(self):
        self.older, self.bytes = {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.older[word]
        self.bytes += _ENTRY + 4 * len(ids)
        return ids

    def put(self, words: dict[str, bytes]) -> None:
        self.update(words)
        self.bytes += _ENTRY * len(words) + sum(map(len, words)) + sum(map(len, words.values()))

    def turn(self) -> None:
        if self.bytes >= REMEMBERED // 2:
            self.older, self.bytes = dict(self), 0
            self.clear()


class Encoder:
    """Texts to ids through the tokenizers library, with a memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = _Memo()
        spec = json.loads(self.tokenizer.to_str())
        splits = spec.get("pre_tokenizer") or {}
        usual = splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space") and splits.get("use_regex", True)
        model = spec.get("model") or {}
        self.by_words = bool(usual and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges"))
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # a byte-level token has a character for each byte
        self.bytes_of[list(vocab.values())] = [len(x) for x in vocab]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, plain: list[str]) -> None:
        """Remembers the ids of a space and each of these words, all of which _ends_well()."""
        if not plain:
            return
        strings = [" " + " ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        # where each word's bytes end in all strings together: a space is one byte, and between strings nothing is left out
        sizes = np.fromiter(map(len, map(str.encode, plain)), np.int64, len(plain)) + 1
        ends, upto = np.cumsum(sizes), np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(upto, ends) + 1
        if not (upto[cuts - 1] == ends).all():
            raise ValueError("the vocabulary joins characters across words")
        data, to = ids.astype(self.kind).tobytes(), (cuts * self.width).tolist()
        self.memo.put({w: data[a:b] for w, a, b in zip(plain, [0, *to[:-1]], to, strict=True)})

    def _by_pieces(self, text: str) -> bytes:
        """Ids of a text with blanks at which it must not be cut."""
        out = []
        for piece in _SAFE.split(text):
            word = piece[1:] if piece[:1] == " " and piece[1:2] not in ("", " ") else None
            ids = None if word is None else self.memo.get(word, self.memo.older.get(word))
            if ids is None:
                ids = self.whole(piece)
                if word is not None and _ends_well(word):
                    self.memo.put({word: ids})
            out.append(ids)
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        simple = [k for k, x in enumerate(texts) if self.by_words and not any(s in x for s in self.special)]
        known = set(simple)
        out = [b"" if k in known else self.whole(x) for k, x in enumerate(texts)]
        if not simple:
            return out
        lists = pa.compute.split_pattern(pa.array([texts[k] for k in simple], pa.string()), " ")
        offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # words that a text must not be cut after are never remembered
        well = [_ends_well(w) for w in words]
        self._learn([w for w, good in zip(words, well, strict=True) if good and w not in self.memo and w not in self.memo.older])
        get = self.memo.__getitem__
        ids = [get(w) if good else b"" for w, good in zip(words, well, strict=True)]
        first, last, bad = offsets[:-1], offsets[1:] - 1, ~np.array(well)[at]
        amiss = np.add.reduceat(bad, first, dtype=np.int64) > bad[last]
        # the ids of all words but first ones (they have no space before them), one after another
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        many = sizes[at]
        many[first] = 0
        ends = np.cumsum(many)
        source = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - many), many) + np.arange(int(ends[-1]))
        data = np.frombuffer(b"".join(ids), self.kind)[source].tobytes()
        upto = [0, *(ends[last] * self.width).tolist()]
        for n, k in enumerate(simple):
            if amiss[n]:
                out[k] = self._by_pieces(texts[k])
            else:
                middle = data[upto[n] : upto[n + 1]]
                tail = self.whole(" " + words[at[last[n]]]) if bad[last[n]] and last[n] > first[n] else b""
                out[k] = self.whole(words[at[first[n]]]) + middle + tail
        self.memo.turn()
        return out

    def one(self, text: str) -> bytes:
        return self([text])[0]


def _ends_well(word: str) -> bool:
    """Whether a text may be cut after a word: it ends in a printable ASCII or Latin letter."""
    return "!" <= word[-1:] <= "~" or "À" <= word[-1:] <= "ɏ"


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _fs(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The store that a folder's address names, as pyarrow opens it: a bare path is a mounted folder, s3a and s3n are s3, abfss is abfs."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return pa.fs.FileSystem.from_uri(f"file://{folder}")
    return pa.fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3', 'abfss': 'abfs'}.get(scheme, scheme)}:{rest}")


def _lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of lots of consecutive texts of about LOT bytes."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lot = (np.cumsum(sizes, dtype=np.int64) - sizes) // LOT
    cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(sizes)]
    yield from ((a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for x in parts:
            out.write(x)
    fs.move(own, f"{root}/{name}")


def _get(folder: str, name: str) -> bytes:
    fs, root = _fs(folder)
    with fs.open_input_stream(f"{root}/{name}") as x:
        return x.read()


def shard_name(part: int, cut: int) -> str:
    return f"shard-{part:06d}-{cut:04d}.bin"


def read_shard(folder: str, part: int, cut: int) -> np.ndarray:
    data = _get(folder, shard_name(part, cut))
    if data[:4] != _MAGIC:
        raise ValueError("not a token shard")
    return np.frombuffer(data, f"<u{data[5]}", int.from_bytes(data[8:16], "little"), 16)


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes (doc_id, text) into shards and returns the directory, written."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], own.kind).tobytes()
        held: list[bytes] = []
        size = cut = copy = 0
        last: object = scan

        def flush() -> None:
            nonlocal held, size, cut
            if held:
                _put(folder, shard_name(part, cut), [_MAGIC + bytes([1, own.width, 0, 0]) + (size // own.width).to_bytes(8, "little"), *held])
                held, size, cut = [], 0, cut + 1

        for batch in batches:
            for low, n in _lots(batch.column("text")):
                rows = batch.slice(low, n)
                ids = rows.column("doc_id").to_pylist()
                out: list[tuple] = []
                for doc_id, data in zip(ids, own([x or "" for x in rows.column("text").to_pylist()]), strict=True):
                    copy = copy + 1 if doc_id == last else 0
                    last = doc_id
                    out.append((copy, doc_id, part, cut, size // own.width, len(data) // own.width + 1))
                    held += [data, end]
                    size += len(data) + len(end)
                    if size // own.width >= shard_tokens:
                        flush()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["copy", "doc_id", "part", "cut", "at", "n_tokens"])
        flush()

    _fs(folder)  # an address that pyarrow cannot open fails here, not in the tasks
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_text_key")).repartitionByRange("doc_id", "_text_key").sortWithinPartitions("doc_id", "_text_key")
    placed = written(ordered.drop("_text_key").mapInArrow(scan, "copy int, doc_id long, part int, cut int, at long, n_tokens long"), f"{folder}/places")
    return written(_through(placed), f"{folder}/directory")


def _through(placed: DataFrame) -> DataFrame:
    """placed, with the copies of ids that span several ranges numbered through. Such an id is a range's first or last, so there are two a range at most."""
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    ends = placed.groupBy("part").agg(F.array(F.min(key), F.max(key)).alias("ends"))
    edge = ends.select(F.explode("ends.doc_id").alias("edge")).distinct()
    counts = placed.join(F.broadcast(edge), F.col("doc_id").eqNullSafe(F.col("edge"))).groupBy("edge", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("edge").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("edge", F.col("part").alias("edge_part"), F.sum("n").over(before).cast("int").alias("base")).filter("base > 0")
    same = F.col("doc_id").eqNullSafe(F.col("edge")) & (F.col("part") == F.col("edge_part"))
    return placed.join(F.broadcast(base), same, "left").withColumn("copy", F.col("copy") + F.coalesce("base", F.lit(0))).select(*placed.columns)


_PLACE = np.dtype([("print", "<u4"), ("part", "<u4"), ("cut", "<u4"), ("n_tokens", "<u8"), ("at", "<u8")])


def write_index(directory: DataFrame, folder: str, bucket_keys: int = BUCKET_KEYS) -> int:
    """Writes the index of a directory; the number of its buckets."""
    buckets = max(1, -(-directory.count() // bucket_keys))

    def build(key, rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("copy", "ascending")])
        seed, keys = 0, _keys(rows, 0)
        while len(np.unique(keys)) < len(keys):
            seed += 1
            keys = _keys(rows, seed)
        hashed = MinimalPerfectHash.build(keys)
        places = np.zeros(len(keys), _PLACE)
        at = hashed(keys)
        places["print"][at] = _print(keys)
        for name in ("part", "cut", "n_tokens", "at"):
            places[name][at] = rows.column(name).to_numpy()
        _put(folder, f"index-{key[0].as_py():06d}.mph", [seed.to_bytes(8, "little"), hashed.to_bytes(), places.tobytes()])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    done = directory.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, "bucket int, n long")
    written(done, f"{folder}/buckets")
    return buckets


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int")


def _keys(rows: pa.Table, seed: int) -> np.ndarray:
    """64-bit hashes of (doc_id, copy), a null doc_id being a value of its own."""
    ids, u = rows.column("doc_id"), np.uint64
    numbers = ids.fill_null(0).to_numpy().astype(np.int64).view(u)
    null = ids.is_null().to_numpy().astype(u)
    with np.errstate(over="ignore"):
        return mix(mix(numbers + u(seed) * u(0x9E3779B97F4A7C15)) + rows.column("copy").to_numpy().astype(u) * u(0xD1B54A32D192ED03) + null * u(0x8CB92BA72F3D8DD7))


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(0xF1)) >> np.uint64(32)).astype(np.uint32)


class Index:
    """One bucket of the index. places(rows): where the ids of each (doc_id, copy) are; print 0 and n_tokens 0 for one that is not there."""

    def __init__(self, data: bytes):
        self.seed = int.from_bytes(data[:8], "little")
        self.hashed, at = MinimalPerfectHash.from_bytes(data[8:])
        self.table = np.frombuffer(data, _PLACE, offset=8 + at)

    def places(self, rows: pa.Table) -> np.ndarray:
        keys = _keys(rows, self.seed)
        at = self.hashed(keys)
        out = self.table[np.maximum(at, 0)].copy() if len(self.table) else np.zeros(len(keys), _PLACE)
        out[(at < 0) | (out["print"] != _print(keys))] = np.zeros(1, _PLACE)
        return out


def lookup(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """For each row of `keys` (doc_id, copy): part, cut, at, n_tokens from the index, null where the key is unknown."""
    names = [c for c in keys.columns]

    def ask(key, rows):
        found = Index(_get(folder, f"index-{key[0].as_py():06d}.mph")).places(rows)
        none = found["n_tokens"] == 0
        out = {n: rows.column(n) for n in names}
        out |= {n: pa.array(found[n].astype(np.int64), mask=none) for n in ("part", "cut", "at", "n_tokens")}
        return pa.table(out)

    schema = ", ".join(f"`{n}` {t}" for n, t in keys.dtypes) + ", part long, cut long, at long, n_tokens long"
    return keys.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(ask, schema)


def read_back(found: DataFrame, folder: str) -> DataFrame:
    """(doc_id, copy, part, cut, at, n_tokens, ids_crc32) read from the shards at the places found: each shard is opened once."""

    def read(key, rows):
        ids = read_shard(folder, key[0].as_py(), key[1].as_py())
        at, n = rows.column("at").to_numpy(), rows.column("n_tokens").to_numpy()
        crc = [zlib.crc32(ids[a : a + m].astype("<u4").tobytes()) for a, m in zip(at, n, strict=True)]
        return rows.select(["doc_id", "copy", "part", "cut", "at", "n_tokens"]).append_column("ids_crc32", pa.array(crc, pa.int64()))

    return found.filter("part IS NOT NULL").groupBy("part", "cut").applyInArrow(read, "doc_id long, copy int, part long, cut long, at long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes shards and index for docs, and returns what the files say of each document: doc_id, copy, start, n_tokens, ids_crc32."""
    folder = folder or work_dir(docs.sparkSession)
    directory = write_shards(docs, folder, path or default_tokenizer())
    buckets = write_index(directory, folder)
    back = read_back(lookup(directory.select("doc_id", "copy"), folder, buckets), folder)
    sizes = directory.groupBy("part", "cut").agg(F.sum("n_tokens").alias("size"))
    order = Window.orderBy("part", "cut").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("size").over(order), F.lit(0))).select("part", "cut", "base")
    return back.join(bases, ["part", "cut"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "copy")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
