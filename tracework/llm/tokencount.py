"""Token counts without token ids: pieces are counted once per distinct pre-token, joined to per-document frequencies and summed."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, partitions, real_id, tidy, written

LIMIT = 2048
#: Words of the documents that one chunk holds, and bytes of text whose distinct words one bucket takes.
CHUNK_WORDS, BUCKET_BYTES = 1_000_000, 64_000_000
_BLANKS = "\t\n\x0b\x0c\r "


def load(path: str):
    """The library's tokenizer, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def check(path: str) -> None:
    """Raise unless the tokenizer drops white space and encodes what stands between alike alone and in its text."""
    tok = load(path)
    loose = [t for t in tok.get_added_tokens_decoder().values() if t.lstrip or t.rstrip or t.single_word or any(b in t.content for b in _BLANKS)]
    words = ["a", "It's", "'", "s", "9", "é", "́", "<", "日本", "Σ", "<|", "x_y"]
    size = {w: len(tok.encode(w, add_special_tokens=False)) for w in words}
    apart = all(len(tok.encode(f"{b}{x}{b}{y}{b}", add_special_tokens=False)) == size[x] + size[y] for b in _BLANKS for x, y in itertools.product(words, words))
    if loose or not apart:
        raise ValueError(f"{path}: white space is part of its pieces, so words can't be counted alone")


def _planes(values: np.ndarray) -> bytes:
    """Non-negative numbers by their bytes: all lowest ones, then all second ones, and so on; what is zero packs away."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    split = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(split.T).tobytes()


def _values(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    return sum(plane.astype(np.int64) << (8 * i) for i, plane in enumerate(raw))


class _Numbered(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_CHUNK = "chunk binary, bucket int, words binary, ids binary, sizes binary, pairs binary, steps binary, times binary"


def _frequencies(buckets: int):
    def flush(docs, seqs, vocabulary: _Numbered) -> pa.RecordBatch:
        words = list(vocabulary)
        at = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
        # words are numbered by bucket, so replies in the order of buckets are in the order of words
        by = np.argsort(at, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[by] = np.arange(len(words))
        sizes = np.array([len(s) for s in seqs], np.int64)
        doc = np.repeat(np.arange(len(seqs)), sizes)
        most = max(len(words), 1)
        pair, times = np.unique(doc * most + rank[np.concatenate(seqs)], return_counts=True)
        doc, word = pair // most, pair % most
        first = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
        step = np.diff(word, prepend=0)
        step[first] = word[first]
        ids = np.array([k for k, _ in docs], np.int64).tobytes()
        blobs = [ids, _planes(np.array([n for _, n in docs], np.int64)), _planes(np.bincount(doc, minlength=len(docs))), _planes(step), _planes(times)]
        full, heads = np.unique(at[by], return_index=True)
        lists = [b" ".join(words[i] for i in by[a:b].tolist()) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(words)], strict=False)]
        # a chunk is known by what it holds, so a task that runs again names it alike
        name = xxhash.xxh3_128_digest(b"\0".join([*blobs, *lists]))
        rows = [(name, int(b), text, *[None] * 5) for b, text in zip(full, lists, strict=True)] + [(name, -1, None, *blobs)]
        kinds = [pa.binary(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _CHUNK.split(", ")])

    def run(batches):
        docs, seqs, vocabulary, held = [], [], _Numbered(), 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py()
                parts = raw.split()
                docs.append((k, len(raw)))
                seqs.append(np.fromiter(map(vocabulary.__getitem__, parts), np.int64, len(parts)))
                held += len(parts) + 1
                if held >= CHUNK_WORDS:
                    yield flush(docs, seqs, vocabulary)
                    docs, seqs, vocabulary, held = [], [], _Numbered(), 0
        if docs:
            yield flush(docs, seqs, vocabulary)

    return run


def _pieces(path: str):
    """Every word of a bucket is encoded once, whichever chunks send it; long ones are remembered by a hash."""

    def run(batches):
        tok, known = load(path), {}
        for batch in batches:
            replies = []
            for text in batch.column(2).to_pylist():
                words = text.split(b" ")
                names = [w if len(w) <= 32 else xxhash.xxh3_128_digest(w) + b" " for w in words]
                new = [(n, w) for n, w in dict(zip(names, words, strict=True)).items() if n not in known]
                for at in range(0, len(new), 10_000):
                    some = new[at : at + 10_000]
                    encoded = tok.encode_batch_fast([w.decode("utf-8", "replace") for _, w in some], add_special_tokens=False)
                    known.update((n, len(e)) for (n, _), e in zip(some, encoded, strict=True))
                replies.append(_planes(np.fromiter(map(known.__getitem__, names), np.int64, len(names))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(replies, pa.binary())], names=["chunk", "bucket", "pieces"])

    return run


def _sums(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            replies = sorted((r["bucket"], r["pieces"]) for r in row["replies"] or ())
            pieces = np.concatenate([_values(p) for _, p in replies]) if replies else np.empty(0, np.int64)
            pairs, times = _values(row["pairs"]), _values(row["times"])
            total = np.cumsum(_values(row["steps"]))
            begin = np.cumsum(pairs) - pairs
            # steps start anew in each document
            word = total - np.repeat(np.r_[0, total][begin], pairs)
            sums = np.r_[0, np.cumsum(pieces[word] * times)]
            out.append((ids, _values(row["sizes"]), sums[begin + pairs] - sums[begin]))
        cols = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    ``tokenizer`` is the path of a ``tokenizers`` JSON file that drops white space, so that words
    between ASCII white space are encoded alike alone and in their text (else ValueError); the file must lie
    at that path on every executor. Three relations meet: chunks of documents hold
    per-document word frequencies; a chunk's distinct words go to the bucket of their hash, where each word of the
    corpus is encoded once; the numbers of pieces come back to the chunk, are joined to its frequencies and
    summed. A word goes to its bucket once a chunk, so a word that all documents have is no burden.

    No begin, end or added special tokens; special strings inside a text count as the library takes
    them. Null texts count as empty. Rows that share an id are counted each; other columns are ignored.
    """
    check(tokenizer)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(id_column(id_col).alias("k"), text.alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-n_bytes // BUCKET_BYTES))
    chunks = written(rows.mapInArrow(tidy(_frequencies(buckets)), _CHUNK))
    words = chunks.where("bucket >= 0").select("chunk", "bucket", "words").repartitionById(buckets, F.col("bucket"))
    replies = words.mapInArrow(tidy(_pieces(tokenizer)), "chunk binary, bucket int, pieces binary")
    replies = replies.groupBy("chunk").agg(F.collect_set(F.struct("bucket", "pieces")).alias("replies"))
    held = chunks.where("bucket = -1").drop("bucket", "words").join(replies, "chunk", "left")
    out = held.mapInArrow(_sums, "k long, n_bytes long, n_tokens long")
    return out.select(real_id("k").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
