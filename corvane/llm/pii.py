"""Personal data: four kinds of spans by rule, and terms that disclose them by corpus statistics.

Base spans are emails, IP addresses, card numbers and phone numbers. The method
then protects what discloses them. Protected values e (entities) are whole values and the
two parts of an email, its local part and its host. For an entity e and a term t of the
same document, document counts over the whole corpus give

    PMI(e; t) = log2 p(e, t) / (p(e) p(t)),   IC(e) = -log2 p(e)

and t discloses e if PMI(e; t) > ALPHA * IC(e), that is p(e | t) > p(e)^(1 - ALPHA).
p(e | t) is estimated from the other documents, as who reads a document without e has
only these: the document at hand is left out, and half a document in which e is as likely
as anywhere is added, (n - 1 + p(e)/2) / (docs - 1/2) for n of docs documents of t. So a
term that e's document alone holds tells nothing, at any size of the corpus. A text
counts as much as it and its copies. Disclosing terms are removed as spans of kind
``term``, at all their places in documents with e.

Terms are letters only, four at least, lower-cased, from anywhere in the document;
places inside base spans count but need no removal of their own. Document counts of
terms are summed on the executors before they are shuffled, for terms that passed a
fixed-size bitmap of candidates. As t in n of d documents can disclose e only if
d * p(e)^(1 - ALPHA) < n, and e is in no fewer than n, (e, t) pairs beyond that are
never formed. Only rows that hold a span meet a shuffle.

Defined cases: null text counts as empty (``masked`` leaves it null); ids may be null or
repeat (each row is one document); without entities no term is removed; an empty table
gives an empty one; other columns may have any name but those that start with two
underscores, and in ``find`` those of its results.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, let_go, prepare, shared_value, written

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA = 0.9
#: Bits of the bitmap that preselects terms (a fixed size; collisions cost only work).
BITMAP = 1 << 20
#: Words whose terms a task remembers.
REMEMBERED = 200_000
_TRACE = re.compile(r"[0-9@]")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{4,}")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rule-based spans, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    if not _TRACE.search(text):
        return out
    free = 0
    if "@" in text:
        for m in _AT.finditer(text):  # a local part is the whole run before its @, as far as no earlier match took it
            start = m.start()
            while start > free and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entities(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """The protected values of base spans: each value, and an email's parts."""
    out = set()
    for start, kind, end in spans:
        value = text[start:end].lower()
        out.add(f"{KINDS[kind]}:{value if kind < 2 else _digits(value)}")
        if kind == 0:
            local, _, host = value.partition("@")
            out |= {f"local:{local}", f"host:{host}"}
    return out


def _hash(value: str) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")))))


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Every term of a text -> its places outside all base spans (which are sorted)."""
    out: dict[str, list[tuple[int, int]]] = defaultdict(list)
    k, end = 0, 0  # spans that start before the term's end, and the furthest end of those
    for m in _TERM.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            end = max(end, spans[k][2])
            k += 1
        places = out[m[0].lower()]
        if a >= end:
            places.append((a, b))
    return out


_FOUND = "__row bigint, kinds array<bigint>, spans array<struct<s:int,k:int,e:int>>, base_sha256 string, __same bigint, __entities array<bigint>, __terms array<struct<t:string,at:array<struct<s:int,e:int>>>>"


def _finder(keep: tuple[str, ...], named: str):
    def run(batches):
        terms_type = pa.list_(pa.struct([("t", pa.string()), ("at", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))]))
        span_type = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        let_go()
        for part, texts in chunks(batches, named):
            counts, spans, digests, same, held, terms = [], [], [], [], [], []
            for text in (t or "" for t in texts):
                found = base_spans(text)
                counts.append([sum(k == x for _, k, _ in found) for x in range(4)])
                spans.append([{"s": s, "k": k, "e": e} for s, k, e in found])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest())
                same.append(_hash(text) if found else 0)
                held.append(sorted(map(_hash, entities(text, found))))
                terms.append([{"t": t, "at": [{"s": a, "e": b} for a, b in at]} for t, at in terms_of(text, found).items()] if found else [])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in (*keep, "__row")), pa.array(counts, pa.list_(pa.int64())), pa.array(spans, span_type), pa.array(digests, pa.string()), pa.array(same, pa.int64()), pa.array(held, pa.list_(pa.int64())), pa.array(terms, terms_type)],
                names=[*keep, "__row", "kinds", "spans", "base_sha256", "__same", "__entities", "__terms"])
    return run


class _Terms(dict):
    """Word as it stands -> its term if the bitmap has it, else None."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> tuple[str, ...]:
        terms = {m[0].lower() for m in _TERM.finditer(word)}
        self[word] = out = tuple(t for t in terms if self.bits[term_bit(t)])
        return out


def term_bit(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=3) % BITMAP


def _counter(shared):
    def run(batches):
        let_go()
        known, counts = _Terms(np.unpackbits(np.frombuffer(shared.value, np.uint8))), Counter()
        for _, texts in chunks(batches, "text"):
            if len(known) > REMEMBERED:
                known.clear()
            for text in texts:
                counts.update({t for found in map(known.__getitem__, set(text.split())) if found for t in found})
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["t", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["t", "n"])
    return run


def _bits(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted({term_bit(t) for t in batch.column("t").to_pylist()}), pa.int32())], names=["bit"])


def _based(docs: DataFrame, keep: tuple[str, ...], name: str, kept: str | None = None) -> DataFrame:
    """``keep`` columns, the base spans of every row, and what its terms' search needs, written.

    ``kept`` names the one of ``keep`` that holds the text, which then goes to the workers once.
    """
    text = [] if kept else [F.col("text").alias("__text")]
    source = docs.select(*(F.col(f"`{c}`") for c in keep), *text, F.monotonically_increasing_id().alias("__row"))
    types = dict(source.dtypes)
    return written(source.mapInArrow(_finder(keep, kept or "__text"), "".join(f"`{c}` {types[c]}, " for c in keep) + _FOUND), f"{name}-found")


def _disclosing(found: DataFrame, docs: DataFrame, alpha: float, name: str) -> DataFrame | None:
    """(__row, more): the term spans of rows that have any; None if no row holds an entity with a term."""
    spark = docs.sparkSession
    with_terms = found.where("size(spans) > 0").select("__row", F.explode("__terms").alias("x")).select("__row", "x.t", "x.at")
    bits = np.zeros(BITMAP, np.uint8)
    bits[[r["bit"] for r in with_terms.select("t").mapInArrow(_bits, "bit int").distinct().collect()]] = 1
    if not bits.any():
        return None
    shared = shared_value(spark, np.packbits(bits).tobytes())
    number = F.lit(float(max(1, docs.count())))
    held_by = found.where("size(spans) > 0").select("__row", F.col("__same").alias("same"), F.explode("__entities").alias("e"))
    held = held_by.groupBy("e").agg(F.count(F.lit(1)).alias("held"))
    least = F.pow(F.col("held") / number, F.lit(1 - alpha))  # p(e | t) of a disclosing term is above this
    held = written(held.select("e", (F.col("held") / number).alias("p"), least.alias("least"), (F.col("held") / least).alias("below")), f"{name}-held")
    below = held.agg(F.max("below")).first()[0]
    terms = docs.where("text is not null").select("text").mapInArrow(_counter(shared), "t string, n bigint").groupBy("t").agg(F.sum("n").alias("docs"))
    rare = with_terms.select("__row", "t").join(terms.where(F.col("docs") < below), "t")
    met = written(held_by.join(held, "e").join(rare, "__row").where(F.col("docs") < F.col("below")).select("__row", "same", "e", "t", "p", "least", "docs"), f"{name}-pairs")
    pairs = met.groupBy("e", "t", "same").agg(F.count(F.lit(1)).alias("n"), F.first("p").alias("p"), F.first("least").alias("least"), F.first("docs").alias("docs"))
    pairs = pairs.groupBy("e", "t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.first("p").alias("p"), F.first("least").alias("least"), F.first("docs").alias("docs"))
    one = F.col("n") / F.col("texts")  # documents of a text
    told = pairs.where((F.col("n") - one * (1 - F.col("p") / 2)) / (F.greatest("docs", "n") - one / 2) > F.col("least")).select("e", "t")
    disclosing = met.select("__row", "e", "t").join(told, ["e", "t"]).select("__row", "t").distinct()
    places = with_terms.join(disclosing, ["__row", "t"]).select("__row", F.explode("at").alias("p"))
    return places.groupBy("__row").agg(F.collect_set(F.struct(F.col("p.s").alias("s"), F.lit(4).alias("k"), F.col("p.e").alias("e"))).alias("__more"))


def _all_spans(found: DataFrame, docs: DataFrame, alpha: float, name: str) -> DataFrame:
    """``found`` with the term spans among ``spans``; rows without a span are not shuffled."""
    added = _disclosing(found, docs, alpha, name)
    if added is None:
        return found
    rest = [c for c in found.columns if c != "spans"]
    spans = F.array_sort(F.concat("spans", F.coalesce("__more", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    some = found.where("size(spans) > 0").join(added, "__row", "left").select(*(F.col(f"`{c}`") for c in rest), spans.alias("spans"))
    return found.where("size(spans) = 0").unionByName(some)


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA, name: str = "pii") -> DataFrame:
    """``keep`` columns, ``kinds`` (counts of the four base kinds), ``base_sha256`` and ``spans`` (s, k, e), terms included."""
    prepare(docs.sparkSession)
    out = _all_spans(_based(docs, keep, name), docs, alpha, name)
    return out.select(*(F.col(f"`{c}`") for c in keep), "kinds", "base_sha256", "spans")


def spans_text(spans="spans"):
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _masked(batches):
    let_go()
    for part, texts in chunks(batches, "text"):
        out = []
        for text, spans in zip(texts, part.column("__spans").to_pylist(), strict=True):
            if text is None or not spans:
                out.append(text)
                continue
            at, pieces = 0, []
            for s, k, e in sorted((x["s"], x["k"], x["e"]) for x in spans):
                if s >= at:
                    pieces += [text[at:s], f"[{KINDS[k].upper()}]"]
                at = max(at, e)
            out.append("".join(pieces) + text[at:])
        yield part.drop_columns(["__spans", "text"]).append_column("text", pa.array(out, pa.string()))


def masked(docs: DataFrame, alpha: float = ALPHA, name: str = "pii") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns stay.

    The search writes each document beside its base spans, so that masking reads it there
    and only documents with spans are joined with their terms.
    """
    prepare(docs.sparkSession)
    own = {c: f"__{k}" for k, c in enumerate(docs.columns)}  # names that clash with no result
    source = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()), F.col("text"))
    found = _based(source, tuple(own.values()), name, own["text"])
    spans = _all_spans(found, source, alpha, name)
    types = dict(docs.dtypes)
    ready = spans.select(*(F.col(own[c]).alias(own[c]) for c in docs.columns if c != "text"), F.col(own["text"]).alias("text"), F.col("spans").alias("__spans"))
    schema = ", ".join([*(f"{own[c]} {types[c]}" for c in docs.columns if c != "text"), "text string"])
    out = ready.mapInArrow(_masked, schema)
    return out.select(*(F.col("text" if c == "text" else own[c]).alias(c) for c in docs.columns))
