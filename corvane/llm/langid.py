"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word (with one space before it) scores the sum over all of its segmentations
into pieces, by the forward algorithm; a text is the product of its words. The
probabilities are fitted by expectation-maximisation over all word counts of a
bounded sample of labelled texts; the expected counts of a round are summed on
the executors, and only pieces' sums reach the driver. Every language that the rows name
is learned: the model grows with languages (0.4 MB each), not with documents.

Pieces of any length are paths of a trie; a step in it is a look-up of an exact
(node, byte) key, so the forward pass runs over all distinct words of a run of
texts at once and follows only what the vocabulary holds.

Defined cases: null text, or text without a letter -> ``und`` with score 0;
null or unseen languages are not learned; ties go to the language that sorts
first; an empty training table makes every prediction ``und``.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, fold, held, let_go, shared_value, unit_hash, written

UNDETERMINED = "und"
#: Bytes of the longest piece that a vocabulary may have (a longer one is an error).
LONGEST = 1 << 16
#: Words longer than this are summed in logarithms, one by one, as products of so many small numbers underflow.
LONG_WORD = 32
#: Bound of the training sample: texts a language.
TEXTS = 1500
ROUNDS = 4
#: Expected counts are summed as whole multiples of 1 / UNIT, so that a sum doesn't depend on its order.
UNIT = 1 << 24
#: Words whose scores a task remembers, and bytes of text that it scores at once.
REMEMBERED, SCORED_BYTES = 150_000, 1 << 20
_LETTER = regex.compile(r"\p{L}")


def vocabulary_keys(content: bytes) -> list[int]:
    """Sorted keys of a tiktoken-format vocabulary's pieces (all single bytes included): their bytes behind a 1."""
    tokens = {base64.b64decode(line.split()[0]) for line in content.splitlines() if line.strip()}
    tokens |= {bytes([b]) for b in range(256)}
    if max(map(len, tokens)) > LONGEST:
        raise ValueError(f"a piece of the vocabulary has more than {LONGEST} bytes")
    return sorted(int.from_bytes(b"\1" + t, "big") for t in tokens if t)


class Lattice:
    """All segmentations of words of equal length, position by position."""

    def __init__(self, keys: list[int]):
        self.size, nodes, edges = len(keys), {b"": 0}, {}
        ends = []
        for key in keys:
            token = key.to_bytes((key.bit_length() + 7) // 8, "big")[1:]
            at = 0
            for n in range(1, len(token) + 1):
                up, at = at, nodes.setdefault(token[:n], len(nodes))
                edges[up << 8 | token[n - 1]] = at
            ends.append(at)
        #: Where no edge leads on, and the piece that ends at a node (``size`` if none).
        self.nowhere = len(nodes)
        self.piece = np.full(len(nodes) + 1, self.size, np.int32)
        self.piece[ends] = np.arange(self.size)
        keys, child = np.fromiter(edges, np.uint64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        del nodes, edges
        order = np.argsort(keys)
        keys, child = keys[order], child[order]
        self.bits = int(np.ceil(np.log2(len(keys) + 2))) + 4
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        first = np.concatenate(([True], slot[order][1:] != slot[order][:-1]))
        self.key, self.at = np.full(1 << self.bits, ~np.uint64(0)), np.full(1 << self.bits, self.nowhere, np.int32)
        self.key[slot[order[first]]], self.at[slot[order[first]]] = keys[order[first]], child[order[first]]
        rest = np.sort(order[~first])
        self.more, self.more_at = keys[rest], child[rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The node behind each node and byte, ``nowhere`` where the vocabulary has none."""
        keys = (nodes.astype(np.uint64) << np.uint64(8)) | data
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.at[slot], self.nowhere)
        if len(self.more):
            place = np.minimum(np.searchsorted(self.more, keys), len(self.more) - 1)
            out = np.where(self.more[place] == keys, self.more_at[place], out)
        return out

    def rows(self, words: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, end) -> words and their pieces there, for words of one length as a matrix of bytes; by start."""
        n, out = words.shape[1], {}
        for i in range(n):
            which, node = np.arange(len(words)), np.zeros(len(words), np.int32)
            for j in range(i + 1, n + 1):
                node = self.step(node, words[which, j - 1])
                on = node != self.nowhere
                which, node = which[on], node[on]
                if not len(which):
                    break
                row = self.piece[node]
                ends = row < self.size
                if ends.any():
                    out[i, j] = which[ends], row[ends]
        return out

    def forward(self, words: np.ndarray, p: np.ndarray, rows: dict) -> np.ndarray:
        alpha = np.zeros((words.shape[1] + 1, len(words), p.shape[1]))
        alpha[0] = 1
        for (i, j), (which, row) in rows.items():
            alpha[j, which] += alpha[i, which] * p[row]
        return alpha

    def expected(self, words: np.ndarray, counts: np.ndarray, p: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected piece counts of (word, count) pairs of one language (p has one column)."""
        rows, n = self.rows(words), words.shape[1]
        alpha = self.forward(words, p, rows)
        beta = np.zeros(alpha.shape)
        beta[n] = 1
        for (i, j), (which, row) in reversed(rows.items()):
            beta[i, which] += p[row] * beta[j, which]
        weight = counts[:, None] / np.maximum(alpha[n], 1e-300)
        for (i, j), (which, row) in rows.items():
            np.add.at(out, row, (alpha[i, which] * p[row] * beta[j, which] * weight[which])[:, 0])

    def expected_long(self, word: bytes, count: float, logp: np.ndarray, out: np.ndarray) -> None:
        """The same for one long word, with logarithms of the probabilities."""
        start, end, row = self.spans(word)
        alpha = self._sums(start, end, row, logp, len(word))
        turned = np.argsort(-start, kind="stable")
        beta = self._sums(len(word) - end[turned], len(word) - start[turned], row[turned], logp, len(word))[::-1]
        np.add.at(out, row, count * np.exp(alpha[start] + logp[row] + beta[end] - alpha[-1])[:, 0])

    def log_scores(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """Log of each word's sum over segmentations, a column for each language."""
        out = np.zeros((len(words), p.shape[1]))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        logp = None
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            if n > LONG_WORD:
                logp = np.log(np.maximum(p, 1e-300)) if logp is None else logp
                for k in which.tolist():
                    out[k] = self._sums(*self.spans(words[k]), logp, n)[-1]
                continue
            for part in np.array_split(which, 1 + len(which) // 4_000):
                block = np.frombuffer(b"".join([words[k] for k in part.tolist()]), np.uint8).reshape(len(part), n)
                out[part] = np.log(np.maximum(self.forward(block, p, self.rows(block))[n], 1e-300))
        return out

    def spans(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in a word, by end."""
        data = np.frombuffer(word, np.uint8)
        at, node, starts, ends, rows = np.arange(len(data)), np.zeros(len(data), np.int32), [], [], []
        for length in range(1, len(data) + 1):
            on = at + length <= len(data)
            at, node = at[on], node[on]
            node = self.step(node, data[at + length - 1])
            on = node != self.nowhere
            at, node = at[on], node[on]
            if not len(at):
                break
            row = self.piece[node]
            whole = row < self.size
            starts.append(at[whole])
            ends.append(at[whole] + length)
            rows.append(row[whole])
        start, end, row = map(np.concatenate, (starts, ends, rows))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], row[order]

    @staticmethod
    def _sums(start: np.ndarray, end: np.ndarray, row: np.ndarray, logp: np.ndarray, n: int) -> np.ndarray:
        """Log of the sum over all segmentations of each beginning of a word of n bytes; spans come by end."""
        out, value = np.zeros((n + 1, logp.shape[1])), logp[row]
        bound = np.searchsorted(end, np.arange(1, n + 2)).tolist()
        for j in range(1, n + 1):
            a, b = bound[j - 1], bound[j]
            x = out[start[a:b]] + value[a:b]
            top = x.max(axis=0)
            out[j] = top + np.log(np.exp(x - top).sum(axis=0))
        return out


def _expecting(shared):
    """Expected piece counts of a task's (lang, w, n) rows under the probabilities of the last round."""
    def run(batches):
        let_go("langid")
        keys, langs, p = shared.value
        lattice, place = _lattice(keys), {lang: c for c, lang in enumerate(langs)}
        out, logp = np.zeros((len(langs), lattice.size + 1)), np.log(np.maximum(p, 1e-300))
        for batch in batches:
            known = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            data = [b" " + w.encode() for w in batch.column("w").to_pylist()]
            number = batch.column("n").to_numpy().astype(np.float64)
            lengths = np.fromiter(map(len, data), np.int64, len(data))
            for c in np.unique(known).tolist():
                for n in np.unique(lengths[known == c]).tolist():
                    which = np.flatnonzero((known == c) & (lengths == n))
                    if n > LONG_WORD:
                        for k in which.tolist():
                            lattice.expected_long(data[k], number[k], logp[:, c : c + 1], out[c])
                        continue
                    for some in np.array_split(which, 1 + len(which) // 4_000):
                        block = np.frombuffer(b"".join(data[k] for k in some.tolist()), np.uint8).reshape(len(some), n)
                        lattice.expected(block, number[some], p[:, c : c + 1], out[c])
        out[:, -1] = 0
        c, piece = np.nonzero(out)
        units = np.rint(out[c, piece] * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(piece, pa.int32()), pa.array(units, pa.int64())], names=["c", "piece", "units"])
    return run


def fit(counts: DataFrame, keys: list[int], langs: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (a column for each language, a last row of zeros) of a table of word counts (lang, w, n)."""
    p = np.full((len(keys) + 1, len(langs)), 1.0 / len(keys))
    p[-1] = 0
    for _ in range(rounds if langs else 0):
        shared = shared_value(counts.sparkSession, (keys, langs, p))
        found = counts.mapInArrow(_expecting(shared), "c int, piece int, units bigint").groupBy("c", "piece").agg(F.sum("units").alias("units")).toArrow()
        got = np.full(p.shape, 0.1)  # every piece keeps some probability in every language
        got[found.column("piece").to_numpy(), found.column("c").to_numpy()] += found.column("units").to_numpy() / UNIT
        got[-1] = 0
        p = got / got.sum(axis=0)
        shared.unpersist()
    return p


def learn(docs: DataFrame, ranks_path: str, learn_where=None, texts: int = TEXTS):
    """Fit on at most about ``texts`` documents a language, chosen by a hash of the id (bounded sample).

    ``learn_where`` is a condition on ``docs`` (held-out rows excluded). All words of
    the sample count.
    """
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn_where is not None:
        usable = usable.where(learn_where)
    number = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sorted(number.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, texts / n))).otherwise(share)
    sample = usable.where(unit_hash("doc_id") < share)
    found = sample.select("lang", F.explode(F.split("text", r"[\s]+")).alias("w")).where("w <> ''")
    counts = written(found.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")), "langid-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    with open(ranks_path, "rb") as file:
        keys = vocabulary_keys(file.read())
    p = fit(counts, keys, langs)
    return shared_value(spark, (keys, langs, p, np.full(len(langs), -np.log(max(1, len(langs))))))


def _lattice(keys: list[int]) -> Lattice:
    """The lattice of a vocabulary, built once in a worker."""
    return held("langid", "lattice", keys, lambda: Lattice(keys))


def predict(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",), name: str | None = None) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (posterior of that language given equal priors).

    With ``name`` the two are called ``<name>_pred`` and ``<name>_score``.
    """
    pred_name, score_name = (f"{name}_pred", f"{name}_score") if name else ("lang_pred", "score")
    # A text that is kept goes to the workers once.
    named = "text" if "text" in keep else "__text"
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(named))
    types = dict(source.dtypes)

    def run(batches):
        let_go("langid")
        keys, langs, p, prior = model.value
        lattice = _lattice(keys)
        place: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for part, texts in chunks(batches, named, SCORED_BYTES):
            if len(place) > REMEMBERED:
                place, scores = {}, np.zeros((0, len(langs)))
            words = [(t or "").split() for t in texts]
            new = list(set(chain.from_iterable(words)).difference(place))
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            scores = np.concatenate((scores, lattice.log_scores([b" " + w.encode() for w in new], p)))
            pred, post = [], []
            for text, found in zip(texts, words, strict=True):
                if text is None or not langs or not _LETTER.search(text):
                    pred.append(UNDETERMINED)
                    post.append(0.0)
                    continue
                total = scores[np.fromiter(map(place.__getitem__, found), np.int64, len(found))].sum(axis=0) + prior
                best = int(np.argmax(total))
                pred.append(langs[best])
                post.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(post, pa.float64())], names=[*keep, pred_name, score_name])

    head = "".join(f"`{c}` {types[c]}, " for c in keep)
    return source.mapInArrow(run, head + f"{pred_name} string, {score_name} double")


def held_out(parts: int = 3, remainder: int = 1):
    return fold("doc_id", parts) == remainder
