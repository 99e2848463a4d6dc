"""Token ids as ORC: run-length encoded integers, row indexes, and Bloom filters on doc_id.

Documents are dealt out in ranges of doc_id and sorted, so each ORC file holds one range and its
stripes and row groups have narrow doc_id statistics; readers of some documents skip the rest by
these and by the Bloom filters, and stripes are read in parallel. Ids never move after they are
written: the start of a document is its start within its file plus the sum of the files before.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, table, written

#: Words whose ids a task keeps; beyond it starts afresh.
CACHE_WORDS = 900_000


def _put(a: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """a, or a longer copy of it, with new from position at on."""
    if at + len(new) > len(a):
        a = np.concatenate([a, np.zeros(max(len(a), len(new)), a.dtype)])
    a[at : at + len(new)] = new
    return a


@cache
def encoder_of(path: str) -> WordEncoder | TextEncoder:
    """The encoder of this worker process, which keeps what it has learnt from task to task."""
    return WordEncoder(path) if is_word_bpe(path) else TextEncoder(path)


#: A normalizer and a split for which the ids of a text are those of its words in turn, with end-of-word marks.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def is_word_bpe(path: str) -> bool:
    """Whether WordEncoder is right for a tokenizer: it is of the one form that it is made for."""
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    model = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    return (
        form["normalizer"] == WORD_NORMALIZER and form["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": WORD_SPLIT}
        and form["truncation"] is None and form["padding"] is None and all(form["model"].get(k) == v for k, v in model.items())
        and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in form["added_tokens"])
    )


class TextEncoder:
    """Encodes whole texts with any tokenizer of the library, without truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id behind it, and the number of them for each text."""
        end = [] if end_id is None else [end_id]
        ids = [[*one, *end] for one in self._raw(texts)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n


class WordEncoder(TextEncoder):
    """Encodes whole texts with a tokenizer of the form is_word_bpe, each distinct word once.

    Such a one drops white space and splits on it first, so the ids of a text are those of
    its words in turn. Lower-case ASCII words go to the tokenizer's model, which its normalizer and
    byte mapping leave as they are; other letters-only words (one unit of its split) go to it by the
    dozen and are told apart by the end-of-word marks of their last tokens; a full stop or
    comma after a letter is a unit of its own. Texts with special-token marks or control
    characters that count as space for Python alone go to the library whole.
    """

    def __init__(self, path: str, end_of_word: str = "</w>"):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(end_of_word)]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)

    def _store(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.at)
        self.starts, self.lengths = _put(self.starts, n, self.used + np.cumsum(lengths) - lengths), _put(self.lengths, n, lengths)
        self.flat, self.used = _put(self.flat, self.used, flat), self.used + len(flat)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def _store_lists(self, words: list[str], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._store(words, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stored words in turn, and the number of each."""
        n = self.lengths[at].astype(np.int64)
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)], n

    def _learn(self, words: list[str]) -> None:
        marked = [w for w in words if w[-1] in ".," and w[-2:-1].isalpha()]
        units = set(words).difference(marked).union(w[:-1] for w in marked).union(".,")
        units = list(units.difference(self.at))
        letters = [w for w in units if w.isascii() and w.isalpha() and w.islower()]  # as they are for the model itself
        model = self.tokenizer.model
        self._store_lists(letters, [[t.id for t in model.tokenize(w)] for w in letters])
        units = list(set(units).difference(letters))
        plain, odd = [w for w in units if w.isalpha()], [w for w in units if not w.isalpha()]
        ids = self._raw([" ".join(plain[i : i + 50]) for i in range(0, len(plain), 50)])
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        cuts = np.flatnonzero(self.ends[flat]) + 1
        if len(cuts) == len(plain):
            self._store(plain, flat, np.diff(cuts, prepend=0))
        else:
            self._store_lists(plain, self._raw(plain))
        self._store_lists(odd, self._raw(odd))
        pairs = np.array([k for w in marked for k in (self.at[w[:-1]], self.at[w[-1]])], np.int64)
        flat, n = self._gather(pairs)
        self._store(marked, flat, n.reshape(-1, 2).sum(1))

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id behind it, and the number of them for each text."""
        if len(self.at) > CACHE_WORDS:
            self.clear()
        if "" not in self.at:
            self._store_lists([""], [[] if end_id is None else [end_id]])
            self._store_lists([" "], [[]])  # what stands beside white space at a text's ends
        marked = [i for i, text in enumerate(texts) if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")]
        plain = pa.array(texts, pa.string())
        if marked:
            plain = pc.if_else(pa.array(np.isin(np.arange(len(texts)), marked)), "", plain)
        parts = pc.utf8_split_whitespace(pc.if_else(pc.string_is_ascii(plain), pc.ascii_lower(plain), plain))
        coded = parts.flatten().dictionary_encode()
        words = [w or " " for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [words[i] for i in missing]
            self._learn(new)
            at[missing] = [self.at[w] for w in new]
        ends = np.asarray(parts.offsets)[1:]
        whole = [" " + texts[i] for i in marked]  # no word has a space
        for key in whole:
            if key not in self.at:
                self._store_lists([key], self._raw([key[1:]]))
        # each text's words, or itself if it is marked, and the end
        at = np.insert(at[coded.indices.to_numpy()], np.concatenate([ends[marked], ends]), [*(self.at[k] for k in whole), *[self.at[""]] * len(texts)])
        bounds = np.concatenate([[0], ends + np.arange(1, len(texts) + 1) + np.cumsum(np.bincount(marked, minlength=len(texts)))])
        ids, n = self._gather(at)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[bounds])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes doc_id, part, start_in_part, n_tokens, ids as ORC files, one range of doc_id each.

    A null or empty text gives end_id alone. A null doc_id sorts first. Repeated ids and
    repeated rows are kept, in order of id and then of a hash of the text. Other columns are not
    read. An empty table writes an empty one. tokenizer is a file of the tokenizers library, of any form: word by
    word where that gives the same ids (is_word_bpe), else by whole texts.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids, n = encoder.encode([t or "" for t in piece.column(1).to_pylist()], end_id)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    (
        ordered.mapInArrow(encode, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, part, start (ids of all documents before), n_tokens, ids.

    where, on doc_id, is pushed to the ORC reader, which skips stripes and row groups.
    """
    stored = spark.read.orc(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.coalesce(F.sum("part_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select(F.col("part").alias("file_part"), before.alias("base")), "token-parts")
    rows = stored if where is None else stored.where(where)
    return rows.join(parts, rows["part"] == parts["file_part"]).select(
        "doc_id", "part", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def _ids_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        crc = [zlib.crc32(np.ascontiguousarray(flat[a:b], "<u4")) for a, b in zip(offsets, offsets[1:])]
        n = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents as they are read back from files; null, empty and repeated rows as in write_tokens."""
    import public_tokenizers

    spark, path = docs.sparkSession, new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(_ids_crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op7_token_orc(spark, sf_dir: str) -> DataFrame:
    """Token ids of every document, written and read back: token_digest of documents."""
    return token_digest(table(spark, sf_dir, "documents"))
