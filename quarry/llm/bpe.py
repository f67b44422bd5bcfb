"""BPE encoding and decoding over a table of distinct words.

1. Documents are split into the tokenizer's words and packed into blocks: a
   block holds its own list of distinct words and, for each document, the
   positions of its words in that list.  Blocks are bounded in text bytes.
2. The words of all blocks are dealt and sorted by word: the table of distinct
   words, each with the blocks that hold it.  Each word is encoded once.
3. The ids go back to the blocks and are joined to the words there, and each
   document's ids follow from its word positions.  Ids are decoded by a join with the
   id-to-piece table, which the vocabulary bounds: a broadcast one in the
   blocks, ``decode`` for tables of ids.

What is shuffled is the compressed blocks and one row per block and distinct
word; a frequent word has one row a block, never one a mention.

The tokenizer drops white space and lower-cases, so the ids of a text are
those of its words in a row.  Words of texts up to U+017F are found by the
tokenizer's own expression; elsewhere (and where a special string stands) a
run between ASCII white space is one word, which the library splits further.

A null text is an empty one: no ids, decoded "".  Repeated rows each get a
row.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, worker_memo

BLOCK_BYTES = 32 << 20
LISTED_BYTES = 4 << 20      # of a block whose ids and texts are returned: they are in memory until its last document

# The normalizer and the split of the tokenizer file, for which
# the splitting into words below is right.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters up to U+017F: no mark composes with another, letters are known,
#: and but for one, lower case stays in the range.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACES = "\t-\r \x85\xa0"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
BEYOND = re.compile("[^\x00-\u017f]|\u0130")
RUN = re.compile("[^\x20\t-\r]+")


def split_words(text: str, special: re.Pattern) -> list[str]:
    """Words whose ids in a row are the ids of the text."""
    if BEYOND.search(text) is None and special.search(text) is None:
        return WORD.findall(text.lower())
    out = []
    for run in RUN.findall(text):
        if BEYOND.search(run) is None and special.search(run) is None:
            out += WORD.findall(run.lower())
        else:
            out.append(run)
    return out


def special_strings(tokenizer_json: str) -> re.Pattern:
    added = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
    return re.compile("|".join(map(re.escape, added)) if added else "(?!)")


def check_rules(tokenizer_json: str) -> None:
    """Raise where the file's rules are not those that this module knows."""
    rules = json.loads(tokenizer_json)
    norm = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    split = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if norm != NORMALIZERS or split[:1] != [SPLIT] or rules.get("decoder") is not None:
        raise ValueError("this tokenizer normalises, splits or decodes by other rules")


def _library(json_text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return worker_memo("bpe", hash(json_text), lambda: Tokenizer.from_str(json_text))


def id_type(vocabulary: int):
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


class _Places(dict):
    """Word -> place in the order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _pack(block: int, ids: list, lens: list[int], places: _Places, index: list):
    import zstandard
    flat = np.concatenate(index) if index else np.zeros(0, np.uint32)
    known = np.array([i is not None for i in ids], np.uint8)
    id64 = np.array([i if i is not None else 0 for i in ids], np.int64)
    body = (np.uint64(len(ids)).tobytes() + known.tobytes() + id64.tobytes() + np.array(lens, np.uint32).tobytes()
            + np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes())
    z = zstandard.ZstdCompressor(level=3)
    return pa.record_batch({
        "block": pa.array([block], pa.int64()),
        "vocab": pa.array([z.compress("\n".join(places).encode("utf-8"))], pa.binary()),
        "body": pa.array([z.compress(body)], pa.binary())})


def _unpack(body: bytes):
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    at = 8
    known = np.frombuffer(raw, np.uint8, n, at)
    at += n
    ids = np.frombuffer(raw, np.int64, n, at)
    at += 8 * n
    lens = np.frombuffer(raw, np.uint32, n, at)
    at += 4 * n
    planes = np.frombuffer(raw, np.uint8, -1, at).reshape(4, -1)
    index = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
    return [int(i) if k else None for i, k in zip(ids, known)], lens, index


def _words_of(vocab: bytes) -> list[str]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(vocab).decode("utf-8")
    return raw.split("\n") if raw else []


def pack_blocks(docs: DataFrame, special: re.Pattern, text: str = "text", key: str = "doc_id",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, vocab, body)``, dealt by block: documents as positions in
    their block's words.  No word holds a line feed."""
    def pack(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, lens, index, size, places = [], [], [], 0, _Places()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = split_words(t, special) if t else []
                ids.append(i)
                lens.append(len(ws))
                index.append(np.fromiter(map(places.__getitem__, ws), np.uint32, len(ws)))
                size += len(t or "") + 64
                if size >= block_bytes:
                    yield _pack(base + n, ids, lens, places, index)
                    ids, lens, index, size, places, n = [], [], [], 0, _Places(), n + 1
        if ids:
            yield _pack(base + n, ids, lens, places, index)
        del ids, lens, index, places
        give_back()

    return (docs.select(F.col(key).cast("long"), F.col(text).cast("string").alias("text"))
            .mapInArrow(pack, "block long, vocab binary, body binary").repartition("block"))


def _word_rows(blocks: DataFrame) -> DataFrame:
    """``(block, word)``, dealt by word.  Takes the blocks whole, so that one
    shuffle of the blocks serves this and the last step."""
    def rows(batches):
        for b in batches:
            for block, vocab in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = _words_of(vocab)
                for i in range(0, len(ws), 1 << 16):
                    part = ws[i:i + (1 << 16)]
                    yield pa.record_batch({"block": pa.array([block] * len(part), pa.int64()), "word": pa.array(part, pa.string())})

    return blocks.mapInArrow(rows, "block long, word string").repartition("word")


def encode_words(rows: DataFrame, tokenizer_json: str) -> DataFrame:
    """``(block, word)`` to ``(block, word, ids)``.  Rows are dealt by word and
    sorted, so a word's rows stand together: the library encodes it at the
    first of them and the others share the ids (a binary of ``id_type``)."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches):
        tok = _library(shared.value)
        kind = id_type(tok.get_vocab_size())
        last = coded = None
        for b in batches:
            runs = pc.run_end_encode(b.column(1), run_end_type=pa.int32())
            distinct = runs.values.to_pylist()
            got = [np.array(e.ids, kind).tobytes()
                   for e in tok.encode_batch(distinct[distinct[0] == last:], add_special_tokens=False)]
            if distinct[0] == last:
                got.insert(0, coded)
            last, coded = distinct[-1], got[-1]
            many = np.diff(runs.run_ends.to_numpy(), prepend=0)
            ids = pa.array(got, pa.binary()).take(pa.array(np.repeat(np.arange(len(got)), many)))
            yield pa.record_batch({"block": b.column(0), "word": b.column(1), "ids": ids})

    return rows.sortWithinPartitions("word").mapInArrow(encode, "block long, word string, ids binary")


def piece_list(tokenizer_json: str) -> list[str]:
    """The piece of each id, added tokens included."""
    from tokenizers import Tokenizer
    by = {i: p for p, i in Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).items()}
    return [by.get(i, "") for i in range(max(by, default=-1) + 1)]


def pieces(spark, tokenizer_json: str) -> DataFrame:
    """``(id, piece)``."""
    return spark.createDataFrame(list(enumerate(piece_list(tokenizer_json))), "id int, piece string")


def decode(coded: DataFrame, table: DataFrame, key: str = "word", ids: str = "ids") -> DataFrame:
    """Joins ids with their pieces: ``(key, ids, decoded)`` with pieces parted
    by one space, as the library decodes where the file names no decoder.
    ``key`` is unique; the piece table is bounded by the vocabulary."""
    spread = coded.repartition(key).select(key, F.posexplode_outer(ids).alias("pos", "id"))
    got = spread.join(F.broadcast(table), "id", "left")
    return got.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id", "piece")))).alias("got")
    ).select(key, F.col("got.id").alias(ids),
             F.array_join(F.col("got.piece"), " ").alias("decoded"))


def encode_decode(docs: DataFrame, tokenizer_json: str, text: str = "text", key: str = "doc_id",
                  digest: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns ``key``, ``n_tokens`` and either ``ids`` and ``decoded`` or, with
    ``digest``, the SHA-256 of both (decimal ids parted by one space)."""
    check_rules(tokenizer_json)
    blocks = pack_blocks(docs, special_strings(tokenizer_json), text, key, BLOCK_BYTES if digest else LISTED_BYTES)
    rows = _word_rows(blocks)
    back = encode_words(rows, tokenizer_json)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, piece_list(tokenizer_json)))

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        json_text, piece = shared.value
        kind = id_type(len(piece))
        known = dict(zip(right.column("word").to_pylist(), right.column("ids").to_pylist()))
        doc_ids, n, a, b = [], [], [], []
        for vocab, body in zip(left.column("vocab").to_pylist(), left.column("body").to_pylist()):
            coded = []
            for w in _words_of(vocab):
                got = known.get(w)
                if got is None:      # the block was made anew, from rows in another order
                    got = np.array(_library(json_text).encode(w, add_special_tokens=False).ids, kind).tobytes()
                coded.append(got)
            size = np.fromiter(map(len, coded), np.int64, len(coded)) // kind().itemsize     # ids of each word
            start = np.cumsum(size) - size
            flat = np.frombuffer(b"".join(coded), kind).astype(np.int32)
            listed_ids = flat.tolist()
            each = [listed_ids[i:i + m] for i, m in zip(start.tolist(), size.tolist())]
            texts = [piece[x[0]] if len(x) == 1 else " ".join([piece[i] for i in x]) for x in each]
            decimal = [str(x[0]) if len(x) == 1 else " ".join(map(str, x)) for x in each] if digest else None
            del listed_ids, each
            block(body, size, start, flat, texts, decimal, doc_ids, n, a, b)
            del texts, decimal, flat, coded
        del known
        give_back()
        return pa.table({key: pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                         **({"ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
                            if digest else
                            {"ids": pa.array(a, pa.list_(pa.int32())), "decoded": pa.array(b, pa.string())})})

    def block(body, size, start, flat, texts, decimal, doc_ids, n, a, b):
        keys, lens, index = _unpack(body)
        # words without ids leave no trace
        ends = np.concatenate(([0], np.cumsum(size[index] > 0)))[np.cumsum(lens, dtype=np.int64)]
        index = index[size[index] > 0]
        begin = 0
        for k, end in zip(keys, ends.tolist()):
            at = index[begin:end]
            begin = end
            many = size[at]
            doc_ids.append(k)
            n.append(int(many.sum()))
            listed = at.tolist()
            decoded = " ".join([texts[i] for i in listed])
            if digest:
                a.append(hashlib.sha256(" ".join([decimal[i] for i in listed]).encode()).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
            else:
                skip = np.repeat(start[at] - (np.cumsum(many) - many), many)
                a.append(flat[skip + np.arange(len(skip))])
                b.append(decoded)

    tail = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return (blocks.groupBy("block").cogroup(back.groupBy("block"))
            .applyInArrow(assemble, f"{key} long, n_tokens long, {tail}"))
