"""BPE encoding and decoding through a table of distinct words.

Every text is split into words, a word being a run of white space and the run of other characters
behind it. No pre-token of the byte-level pattern reaches across such a boundary (none holds a
non-space followed by a space), so encoding words one by one equals encoding the text, whatever
Unicode version the pattern's classes follow. Each distinct word is encoded once:

* common words (those of a sample of rows) into a table of bounded bytes that every task gets;
* any other word where a shuffle by word has gathered its places, from where its ids go back to
  their texts by position.

Which words are common decides only how they travel. A text travels once for all its copies in a
task, not as text but as the numbers of its words in the table with holes for the others; it meets
the ids for its holes by a 64-bit hash and its length, and what was found joins all rows of that text. Decoding joins every id to its piece.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, chunks, give_back, lean, small_batches, utf8
from .words import SPACE, span_hashes

# White space as Unicode has it, without U+180E, which is not.
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
PIECE = f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
# The same beyond ASCII in UTF-8: characters of two and of three bytes.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Rows in the sample that common words come from, about; common words and their bytes, at most.
SAMPLE_TEXTS, COMMON_WORDS, COMMON_BYTES = 60_000, 2_000_000, 48_000_000
#: Words that are hashed together, and words of whole texts that are digested together, so that no passing array grows with table or batch.
_AT_ONCE = 200_000
#: A text's key: 64 bits of hash and its bytes. Texts that agree in both but not in 64 further bits stop the job.
_KEY = ("_k1", "_len")
_FOUND = "_k1 long, _len int, n_tokens long, ids_sha256 binary, decoded_sha256 binary"


def split_words(text: str = "text"):
    """The words of a text, which joined give the text; null has none."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), F.array().cast("array<string>"))


def pieces_of(tokenizer_json: str) -> dict[int, bytes]:
    """id -> the bytes it stands for; the byte alphabet follows from a rule."""
    told = json.loads(tokenizer_json)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves,
    rest = sorted(set(range(256)) - set(shown))  # the others in order from code point 256 up
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    pieces = {i: bytes(alphabet[c] for c in piece) for piece, i in told["model"]["vocab"].items()}
    return pieces | {t["id"]: t["content"].encode() for t in told["added_tokens"]}


def vocabulary(spark, tokenizer_json: str) -> DataFrame:
    """id, piece; its size is the tokenizer's, whatever the input."""
    return spark.createDataFrame(sorted(pieces_of(tokenizer_json).items()), "id int, piece binary")


#: What a Python worker keeps between tasks: the tokenizer or one of the two columns of the table of words.
_KEPT: dict = {}


def encode_words(tokenizer_json: str, words: list[str]) -> list[list[int]]:
    """Ids of each word as the library gives them, without special tokens added, cut or padded."""
    library = _once(tokenizer_json, _tokenizer)
    return [e.ids for i in range(0, len(words), 2000) for e in library.encode_batch(words[i : i + 2000], add_special_tokens=False)]


def _tokenizer(tokenizer_json: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer_json)
    made.no_truncation()
    made.no_padding()
    return made


def word_table(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """word, n, ids for each distinct word of a column ``word``."""

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return pa.array(encode_words(tokenizer_json, column.to_pylist()), pa.list_(pa.int32()))

    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("ids", ids("word"))


def word_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the words of texts side by side in UTF-8 begin; a word ends where the next begins."""
    space = SPACE[data]
    at = np.nonzero((data == 0xC2) | (data - 0xE1 < 3))[0]
    if len(at):
        padded = np.append(data, np.zeros(2, np.uint8)).astype(np.uint32)
        two, three = (padded[at] << 8) + padded[at + 1], (padded[at] << 16) + (padded[at + 1] << 8) + padded[at + 2]
        for n, code in ((2, two), (3, three)):
            found = at[np.isin(code, [int.from_bytes(w) for w in _WIDE if len(w) == n])]
            for k in range(n):
                space[found + k] = True
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[ends[:-1][np.diff(ends) > 0]] = True
    return np.nonzero(begin)[0]


def words_of(column: pa.Array):
    """For slices of a text column: start, number of texts, their words as an Arrow dictionary array, and where each text's begin."""
    for start, n in chunks(column):
        data, ends = utf8(column.slice(start, n))
        at = word_starts(data, ends)
        places = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, places, pa.py_buffer(data)])
        yield start, n, words.dictionary_encode(), np.searchsorted(at, ends)


class CommonWords:
    """Words by number, found by hash and compared by value."""

    def __init__(self, words: pa.Array):
        self.words = words.cast(pa.binary())
        hashes = np.zeros(len(words), np.uint64)
        for k in range(0, len(words), _AT_ONCE):
            hashes[k : k + _AT_ONCE] = self.hashed(self.words.slice(k, _AT_ONCE))
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    def __len__(self) -> int:
        return len(self.words)

    @staticmethod
    def hashed(words: pa.Array) -> np.ndarray:
        data, ends = utf8(words)
        return span_hashes(data, ends[:-1], ends[1:])

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, or len(self)."""
        if not len(self) or not len(words):
            return np.full(len(words), len(self))
        wanted = self.hashed(words)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self) - 1)
        rows = self.order[at]
        same = pc.equal(self.words.take(pa.array(rows)).cast(pa.large_binary()), words).to_numpy(zero_copy_only=False).copy()
        for i in np.nonzero(~same & (self.hashes[at] == wanted))[0].tolist():  # other words with that hash lie behind
            for j in range(at[i] + 1, len(self)):
                if self.hashes[j] != wanted[i]:
                    break
                if self.words[self.order[j]].as_py() == words[i].as_py():
                    rows[i], same[i] = self.order[j], True
                    break
        return np.where(same, rows, len(self))


def _common(docs: DataFrame, tokenizer_json: str, sample_texts: int, common_words: int, common_bytes: int) -> pa.Table:
    """word, ids of the words most frequent in a sample of rows, most frequent first; bounded in rows and bytes."""

    def counted(batches):
        for batch in batches:
            for _, _, words, _ in words_of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))], ["word", "n"])

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return pa.array(encode_words(tokenizer_json, [w.decode() for w in column.to_pylist()]), pa.list_(pa.int32()))

    share = min(1.0, sample_texts / max(1, docs.count()))
    some = docs.select("text").where(F.rand(5) < share)  # by row, so that copies are in it in proportion
    table = some.mapInArrow(lean(counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    spread = table.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("bytes")).orderBy(F.desc("n"))
    least, words, size = 1 << 62, 0, 0
    for row in spread.collect():  # 10,000 rows at most
        words, size = words + row["words"], size + row["bytes"]
        if words > common_words or size > common_bytes:
            break
        least = row["n"]
    got = table.where(F.col("n") >= least).withColumn("ids", ids("word")).toArrow()
    table.unpersist()
    order = pc.sort_indices(got.select(["n", "word"]), [("n", "descending"), ("word", "ascending")])
    got, made = got.drop_columns("n"), {}
    for c in ("word", "ids"):  # a column at a time, which then goes
        column = got.column(c).take(order)
        made[c] = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
        got = got.drop_columns(c)
        del column
        give_back()
    return pa.table(made)


def _packed(column: pa.ChunkedArray) -> bytes:
    """A column as compressed Arrow bytes, to be sent to every executor."""
    table = pa.table({"x": column})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Array:
    table = pa.ipc.open_stream(pa.BufferReader(packed), options=pa.ipc.IpcReadOptions(use_threads=False)).read_all()
    column = table.column("x")
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _once(told: bytes | str, make):
    """``make`` of what was told, made once a worker; whatever else the worker kept goes first, back to the machine."""
    key = make, hash(told)
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make(told)
        give_back()
    return _KEPT[key]


def _table_of_words(packed: bytes) -> CommonWords:
    return CommonWords(_unpacked(packed))


def encode_digest(docs: DataFrame, tokenizer_path: str, sample_texts: int = SAMPLE_TEXTS, common_words: int = COMMON_WORDS, common_bytes: int = COMMON_BYTES) -> DataFrame:
    """All columns of ``docs`` but text, plus n_tokens, ids_sha256 and decoded_sha256 of the text.

    Defined cases: null and empty texts have no token, and the hashes of nothing; repeated rows each
    get their row, their text being encoded once; null ids pass through; an empty table gives an
    empty result; columns named like the ones added are replaced.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        told = f.read()
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    others = [F.col("__aside").getField(c).alias(c) for c in docs.columns if c != "text"]
    docs, _ = aside(docs, "text")
    text = F.coalesce("text", F.lit(""))  # a null text counts as an empty one: neither has a token
    keyed = docs.withColumn("_k1", F.xxhash64(F.lit(1), text)).withColumn("_len", F.octet_length(text))
    small_batches(docs.sparkSession)
    table = _common(docs, told, sample_texts, common_words, common_bytes)
    sc = docs.sparkSession.sparkContext
    words, ids = _packed(table.column("word")), _packed(table.column("ids"))
    del table
    give_back()  # the driver's Python keeps what is sent, not what it was made of
    shared_words, shared_ids = sc.broadcast(words), sc.broadcast((ids, told))
    texts = keyed.select(*_KEY, F.xxhash64(F.lit(2), text).alias("_k2"), "text")
    narrow = "<u2" if max(pieces_of(told), default=0) < 1 << 16 else "<i4"

    def coded(batches, rare: bool):
        """Of every text: its words' numbers, compressed; or (word, position) of every word that the table lacks."""
        import zstandard

        common, z, seen = _once(shared_words.value, _table_of_words), zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in _KEY)))
            fresh = []
            for i, k in enumerate(keys):  # copies in one task travel once
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if len(seen) > 500_000:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64())) if len(fresh) < len(keys) else batch
            for start, n, words, first in words_of(batch.column("text")):
                mine = [batch.column(k).slice(start, n) for k in _KEY]
                number = common.find(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                if rare:
                    lost = np.nonzero(number == len(common))[0]
                    row = np.searchsorted(first, lost, "right") - 1
                    lacked = words.dictionary.take(words.indices.take(pa.array(lost)))
                    yield pa.RecordBatch.from_arrays([lacked.cast(pa.binary()), *(k.take(pa.array(row)) for k in mine), pa.array(lost - first[row], pa.int32())], ["word", *_KEY, "at"])
                else:
                    planes = number.astype("<u4").view(np.uint8).reshape(-1, 4)
                    more = batch.column("_k2").slice(start, n).to_pylist()
                    packed = [k.to_bytes(8, "little", signed=True) + z.compress(planes[a:b, :3].T.tobytes()) for k, a, b in zip(more, first, first[1:])]
                    yield pa.RecordBatch.from_arrays([*mine, pa.array(np.full(n, -1), pa.int32()), pa.array(packed, pa.binary())], [*_KEY, "at", "told"])

    def encode(batches):
        """Rows sorted by word: each word is encoded at its first row."""
        last, ids = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            fresh = [w for w in words if w != last]
            known = dict(zip(fresh, (np.array(x, narrow).tobytes() for x in encode_words(shared_ids.value[1], [w.decode() for w in fresh]))))
            if last is not None:
                known.setdefault(last, ids)
            last = batch.column("word")[-1].as_py()
            ids = known[last]
            of = pa.array([known[w] for w in words], pa.binary()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*_KEY, "at")), of], [*_KEY, "at", "told"])

    def finish(batches):
        """Rows sorted by text and position: the numbers of a text's words, then the ids for its holes in order."""
        table = pieces = names = rest = None
        for batch in batches:
            if table is None:
                table = _once(shared_ids.value[0], _unpacked)
                by_id = pieces_of(shared_ids.value[1])
                pieces = pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())
                names = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            begins = np.nonzero(t.column("at").to_numpy() == -1)[0]
            if not len(begins):
                rest = t
                continue
            k = [t.column(c).to_numpy() for c in _KEY]
            last = begins[-1]
            while last and all(c[last] == c[last - 1] for c in k):  # the last text may go on in the next batch
                last -= 1
            if last:
                yield from _digested(t.slice(0, last), table, pieces, names, narrow)
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield from _digested(rest, table, pieces, names, narrow)

    row = "_k1 long, _len int, at int, told binary"
    places = texts.mapInArrow(lean(lambda b: coded(b, True)), "word binary, _k1 long, _len int, at int")
    rare = places.repartition("word").sortWithinPartitions("word").mapInArrow(lean(encode), row)
    numbers = texts.mapInArrow(lean(lambda b: coded(b, False)), row)
    met = numbers.unionByName(rare).repartition(*_KEY).sortWithinPartitions(*_KEY, "at").mapInArrow(lean(finish), _FOUND)
    told_hex = [F.lower(F.hex(c)).alias(c) for c in ("ids_sha256", "decoded_sha256")]
    return keyed.drop("text").join(met, list(_KEY), "left").select(*others, "n_tokens", *told_hex)


def _digested(t: pa.Table, table: pa.Array, pieces: pa.Array, names: pa.Array, narrow: str):
    """n_tokens and digests of whole texts from their sorted rows, some texts at a time; repeated rows, of copies, count once."""
    import zstandard

    t = t.combine_chunks()
    k = [t.column(c).to_numpy() for c in (*_KEY, "at")]
    fresh = np.ones(len(k[0]), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in k], axis=0)
    for i in np.nonzero(~fresh & (k[-1] == -1))[0].tolist():
        if t.column("told")[i].as_py()[:8] != t.column("told")[i - 1].as_py()[:8]:
            raise RuntimeError("two texts agree in length and hash; another seed of the hash tells them apart")
    t = t.filter(pa.array(fresh)) if not fresh.all() else t
    begins = np.nonzero(t.column("at").to_numpy() == -1)[0]
    told, unz = t.column("told"), zstandard.ZstdDecompressor()
    planes, size, start = [], 0, 0
    for i, begin in enumerate(begins.tolist()):
        planes.append(np.frombuffer(unz.decompress(told[begin].as_py()[8:]), np.uint8).reshape(3, -1))
        size += planes[-1].shape[1]
        if size >= _AT_ONCE or i + 1 == len(begins):
            end = begins[i + 1] if i + 1 < len(begins) else t.num_rows
            yield _some_digested(t.slice(start, end - start), planes, table, pieces, names, narrow)
            planes, size, start = [], 0, end


def _some_digested(t: pa.Table, planes: list[np.ndarray], table: pa.Array, pieces: pa.Array, names: pa.Array, narrow: str) -> pa.RecordBatch:
    own = t.column("at").to_numpy() == -1
    first = np.concatenate([[0], np.cumsum([p.shape[1] for p in planes])])
    number = np.concatenate([p[0] + (p[1].astype(np.int64) << 8) + (p[2].astype(np.int64) << 16) for p in planes])
    data, ends = utf8(t.column("told").filter(pa.array(~own)).combine_chunks())
    holes = np.nonzero(number == len(table))[0]
    if len(holes) != len(ends) - 1:
        raise RuntimeError(f"{len(holes)} words lack ids, {len(ends) - 1} came")
    late = pa.ListArray.from_arrays(pa.array(ends // np.dtype(narrow).itemsize, pa.int32()), pa.array(np.frombuffer(data.tobytes(), narrow).astype(np.int32)))
    used, at = np.unique(number, return_inverse=True)  # only the words of these texts are copied out of the table
    used = used[used < len(table)]
    at[holes] = len(used) + np.arange(len(holes))
    of = pa.concat_arrays([table.take(pa.array(used)), late]).take(pa.array(at))
    flat, in_words = of.flatten(), np.concatenate([[0], np.cumsum(of.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return _hashed(t.select(list(_KEY)).filter(pa.array(own)), _joined(names, flat), _joined(pieces, flat), in_words[first].tolist())


def _joined(strings: pa.Array, ids: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Every id joined to its string: the strings' bytes side by side, and where each begins."""
    taken = strings.take(ids)
    _, at, data = taken.buffers()
    return memoryview(data) if data is not None else memoryview(b""), np.frombuffer(at, np.int64, len(taken) + 1)


def _hashed(kept: pa.Table, names, pieces, ends) -> pa.RecordBatch:
    n, ids, texts = [], [], []
    for a, b in zip(ends, ends[1:]):
        n.append(b - a)
        ids.append(hashlib.sha256(names[0][names[1][a] : max(names[1][a], names[1][b] - 1)]).digest())
        decoded = bytes(pieces[0][pieces[1][a] : pieces[1][b]]).decode("utf-8", "replace")
        texts.append(hashlib.sha256(decoded.encode()).digest())
    keys = [kept.column(k).combine_chunks() for k in _KEY]
    return pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], [*_KEY, "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """key, ids array<int> of (key, text), one row per key; words join the table of distinct words by a shuffle."""
    with open(tokenizer_path, encoding="utf-8") as f:
        told = f.read()
    at = docs.select(key, F.posexplode(split_words()).alias("at", "word"))
    joined = at.join(word_table(at.select("word"), told), "word")
    back = joined.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return docs.select(key).join(back, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def decode(ids: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """key, text of (key, ids array<int>), one row per key: ids join the vocabulary and their pieces join in order."""
    with open(tokenizer_path, encoding="utf-8") as f:
        pieces = vocabulary(ids.sparkSession, f.read())
    spread = ids.select(key, F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces), "id")  # of fixed size
    back = spread.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    told = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    return ids.select(key).join(back.select(key, told.cast("string").alias("text")), key, "left").na.fill("", ["text"])
