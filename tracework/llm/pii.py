"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that disclose them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, id_column, real_id, tidy, written

KINDS = ("email", "ip", "card", "phone")
#: Chance that any term of the corpus passes for disclosing though it meets its entity by accident.
ALPHA = 0.05
#: Shares of an entity's information that a term may disclose before it is generalised, and before it is removed.
GENERALISE, REMOVE = 0.85, 0.95
#: Bytes of terms and their counts that a worker holds before it sends them on.
COUNTED_BYTES = 48_000_000

# The patterns, each begun where a run of its characters begins, so that no text takes quadratic time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) in code points, by kind, then begin; a match that fails its test is dropped, not retried."""
    out, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            begin = m.start()
            while begin > last and _LOCAL.match(text, begin - 1):
                begin -= 1
            if begin < m.start():
                out.append((0, begin, m.end()))
                last = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _entity(kind: int, value: str) -> int:
    """Signed 64-bit number of an entity: its kind and its value without what only lays it out."""
    plain = value.lower() if kind < 2 else _NOT_DIGIT.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - 2**63


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, begin, end) of the whole text's words of two characters or more outside all spans, numbers left out."""
    taken, at, low, out = sorted((a, b) for _, a, b in spans), 0, 0, []
    for w in _WORD.finditer(text):
        x, y = w.span()
        while at < len(taken) and taken[at][0] < y:
            low = max(low, taken[at][1])
            at += 1
        if x >= low and y - x > 1 and not w[0].isdigit():
            out.append((w[0].lower(), x, y))
    return out


def origins(terms: list[str]) -> tuple[int, ...]:
    """Three min-hashes of the terms' trigrams: most are equal for near copies, few for texts that only share a passage."""
    if not terms:
        return 0, 0, 0
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(terms[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(terms) - 2))], np.uint64)
    return tuple(int((h * np.uint64(odd)).min()) - 2**63 for odd in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


_FOUND = "k long, t long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, entities array<long>, origin1 long, origin2 long, origin3 long, near array<struct<term:string,begin:int,end:int>>"


def _find(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(10)]
        ends, near = [0], ([], [], [])
        for text in batch.column(2):
            text = text.as_py() or ""
            spans = base_spans(text)
            line = joined(spans)
            for kind in range(4):
                cols[kind].append(sum(s[0] == kind for s in spans))
            terms = terms_of(text, spans) if spans else []
            for col, value in zip(cols[4:], (line, hashlib.sha256(line.encode()).hexdigest(), sorted({_entity(k, text[a:b]) for k, a, b in spans}), *origins([t for t, _, _ in terms])), strict=True):
                col.append(value)
            for col, values in zip(near, zip(*terms, strict=True), strict=False):
                col.extend(values)
            ends.append(len(near[0]))
        places = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(near, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["term", "begin", "end"])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int64())] + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1)] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)],
            names=["k", "t", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "entities", "origin1", "origin2", "origin3", "near"],
        )


def _words(raw: str) -> tuple[str, ...]:
    return tuple({w for w in _WORD.findall(raw.lower()) if len(w) > 1 and not w.isdigit()})


def _frequencies(batches):
    words, counts, held = Remembered(_words), Counter(), 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if text:
                before = len(counts)
                terms = set(chain.from_iterable(map(words.__getitem__, set(text.split()))))
                counts.update(terms)
                # a new term takes its characters and some 150 bytes; of long ones more than a text's own share is never counted
                held += (len(counts) - before) * 150 + (sum(map(len, terms)) if len(counts) > before else 0)
                if held >= COUNTED_BYTES:
                    yield flush()
                    counts, held = Counter(), 0
    yield flush()


def frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many documents each term of the corpus stands. A partition adds up its counts before they are sent; one pass counts all terms."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(tidy(_frequencies), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def _accident(n_origins, m, n, n_docs: int):
    """Upper bound of log2 of the chance that ``m`` of an entity's ``n_origins`` documents hold a term of ``n`` documents.

    C(n_origins, m) (n / n_docs)^m, the binomial by its entropy bound, which is exact where all of them hold it.
    """
    rest = n_origins - m
    ways = m * F.log2(n_origins / m) + F.when(rest > 0, rest * F.log2(n_origins / F.nullif(rest, F.lit(0)))).otherwise(0.0)
    return ways + m * F.log2(F.least(n / F.lit(n_docs), F.lit(1.0)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row for each row of ``docs``: k, t (hash of the text), counts of the base kinds, base and base_sha256, and ``terms``: (begin, end, removed) of disclosing terms.

    A term t discloses the share PMI(c; t) / IC(c) of an entity c, with IC(c) = -log2 p(c) and
    PMI(c; t) = log2 p(c, t) / (p(c) p(t)), probabilities from document frequencies over the whole
    corpus; p(c, t) counts documents that hold both, however far apart. A share above ``generalise``
    (``remove``) marks t wherever it stands in the documents of c, unless the two may have met by
    accident: the chance of that, times the number of terms beside all documents' entities, must
    not exceed ``alpha``. Copies and near copies of one text are one document there, so they disclose nothing
    by themselves, and the words of an entity's only document hardly ever do.
    """
    rows = docs.select(id_column(id_col).alias("k"), text_hash(text_col).alias("t"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = written(rows.mapInArrow(tidy(_find), _FOUND))
    n_docs = found.count()
    by = ("origin1", "origin2", "origin3")
    held = found.where(F.size("entities") > 0).select("k", "t", *by, F.explode("entities").alias("entity"), F.array_distinct(F.transform("near", lambda x: x.term)).alias("near"))
    met = [F.count("*").alias("n"), F.sort_array(F.array(*map(F.count_distinct, by)))[1].alias("origins")]
    tests = held.agg(F.sum(F.size("near"))).first()[0] or 1
    sure = F.lit(float(np.log2(alpha / max(tests, 1))))
    entities = held.groupBy("entity").agg(*met).withColumnsRenamed({"n": "n_entity", "origins": "entity_origins"})
    # no term can do better than to stand in every document of its entity and in no other
    entities = written(entities.where((F.col("n_entity") < n_docs) & (_accident(F.col("entity_origins"), F.col("entity_origins"), F.col("entity_origins"), n_docs) <= sure)))
    pairs = held.join(entities.select("entity"), "entity", "left_semi").select("entity", *by, F.explode("near").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(*met).withColumnRenamed("n", "n_both")
    # the same bound for each term; one that fails it needs no count over the corpus
    told = pairs.join(entities, "entity").withColumn("known", F.least("origins", "entity_origins"))
    told = written(told.where(_accident(F.col("entity_origins"), F.col("known"), F.col("known"), n_docs) <= sure))
    # without a term to judge there is nothing to count
    counts = docs.sparkSession.createDataFrame([], "term string, n long") if told.isEmpty() else frequencies(docs, text_col)
    information = F.log2(F.lit(n_docs) / F.col("n_entity"))
    share = (information + F.log2(F.least(F.col("n_both") / F.col("n"), F.lit(1.0)))) / information
    others = F.greatest(F.col("n") - F.col("n_both"), F.lit(0))
    told = written(told.join(counts, "term")).withColumn("share", share).where(F.col("share") > generalise)
    told = told.where(_accident(F.col("entity_origins"), F.col("known"), others + F.col("known"), n_docs) <= sure).select("entity", "term", (F.col("share") > remove).alias("removed"))
    marks = held.select("k", "t", "entity").join(told, "entity").groupBy("k", "t", "term").agg(F.max("removed").alias("removed"))
    marks = marks.groupBy("k", "t").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("told"))
    terms = F.transform(F.filter("near", lambda x: F.map_contains_key("told", x.term)), lambda x: F.struct(x.begin.alias("begin"), x.end.alias("end"), F.element_at("told", x.term).alias("removed")))
    out = found.join(marks, ["k", "t"], "left").withColumn("terms", F.when(F.col("told").isNotNull(), terms))
    return out.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms"))).drop("entities", *by, "near", "told")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and ``term`` spans), n_terms of every whole text.

    Null texts are empty. Repeated rows are judged each; rows that share an id are told apart by their texts.
    A null id is an id of its own. Other columns are ignored. A text of any length is read in linear time.
    """
    out = find(docs)
    line = F.array_join(F.transform(F.coalesce("terms", F.array().cast("array<struct<begin:int,end:int,removed:boolean>>")), lambda t: F.concat_ws(":", F.lit("term"), t.begin, t.end)), ",")
    return out.select(
        real_id("k").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(line, F.lit(""))).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"),
    )


def sanitised(text: str, base: str, terms: list[tuple[int, int, bool]]) -> str:
    """``text`` with entities replaced by their kind and disclosing terms by ``<term>``, or removed."""
    cuts = []
    for span in filter(None, (base or "").split(",")):
        kind, a, b = span.split(":")
        cuts.append((int(a), int(b), f"<{kind}>"))
    cuts += [(a, b, "" if gone else "<term>") for a, b, gone in terms]
    parts, last = [], 0
    for a, b, mark in sorted(cuts):
        if b <= last:
            continue
        parts += [text[last : max(a, last)], mark]
        last = b
    return "".join([*parts, text[last:]])
