"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all words and word beginnings of the labelled examples. A term's weight in a
text is its TF-IDF, times how far the labels tie it to toxicity; a term without such a
tie keeps a small share of its weight, so none is left out. Examples that are alike lie
in one block of the inverted index, which holds for each term the largest weight of
every block: a query reads blocks in order of their upper bound until no block can reach
its k-th neighbour. Distance-weighted votes of the neighbours give the score, which a
logistic fit on the examples (each judged without itself) calibrates.
"""

from __future__ import annotations

import pickle
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.llm.common import first_by_hash, give_back, release, saved

#: Bounds of the fit: labelled examples of each class (first by a hash of doc_id) and distinct terms of all of them together.
EXAMPLES_EACH, EXAMPLE_TERMS = 3000, 4_000_000
#: Neighbours that vote, most examples of a block, texts judged at a time.
NEIGHBOURS, BLOCK, TEXTS = 15, 64, 128
#: Share of the examples from which on a term is frequent, most such terms, blocks that are read for a first bound, and the margin of single precision.
OFTEN, FREQUENT, FIRST_BLOCKS, _MARGIN = 1 / 24, 1536, 4, 1e-5
#: Share of its TF-IDF that a term without any tie to toxicity keeps; chi-square at which a tie counts by half; the prior's vote.
LOOSE, HALF_CHI, PRIOR_VOTE = 0.02, 40.0, 0.2
#: Words whose terms a worker remembers.
WORDS = 100_000
#: Code points of the word beginnings that are terms beside whole words.
BEGINNINGS = (4, 5)
_CLEAN = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words_of(text: str | None) -> Counter:
    """Counts of the words of a whole text: lower case, ASCII marks dropped."""
    return Counter((text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split())


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings of 4 and 5 code points, if it is longer."""
    out = [word]
    if word.isascii():
        return out + [word[:n] + b"*" for n in BEGINNINGS if len(word) > n]
    if len(word) > BEGINNINGS[0]:
        chars = word.decode("utf-8", "surrogatepass")
        out += [chars[:n].encode("utf-8", "surrogatepass") + b"*" for n in BEGINNINGS if len(chars) > n]
    return out


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in words_of(text).items():
        for t in terms_of(word):
            out[t] += n
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + count), one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Index:
    """Block-max inverted index of unit vectors (terms, weights).

    Rows that are alike lie in one block. Of a frequent term, a block holds all its rows'
    weights, so that many queries read a block in one product; of other terms, postings are
    read as they are. A query's bound for a block is the most that its rows get from other
    terms, and the frequent terms' largest weights in the block. Bounds and products are in
    single precision with a margin; the rows that remain are compared exactly.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK, frequent: int = FREQUENT):
        self.size, self.terms = len(vectors), terms
        row = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in vectors])
        term = np.concatenate([np.zeros(0, np.int32), *(t.astype(np.int32) for t, _ in vectors)])
        weight = np.concatenate([np.zeros(0, np.float32), *(w.astype(np.float32) for _, w in vectors)])
        blocks = _alike(row, term, weight, self.size, terms, block)
        self.rows = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)  # place -> row
        self.edges = np.cumsum([0, *map(len, blocks)])
        place = np.empty(self.size, np.int64)
        place[self.rows] = np.arange(self.size)
        self.place = place
        order = np.lexsort((term, place[row]))
        self.frequent, self.place = frequent, place
        # the vectors by place; all else is made where it is used
        self.term, self.weight = term[order], weight[order]
        self.start = np.searchsorted(place[row[order]], np.arange(self.size + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in _OPENED}

    def vector(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.start[self.place[row]], self.start[self.place[row] + 1])
        return self.term[at].astype(np.int64), self.weight[at].astype(float)

    def _open(self) -> None:
        at, term = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.start)), self.term
        counts = np.bincount(term, minlength=self.terms)
        often = np.argsort(-counts, kind="stable")[: self.frequent]
        often = often[counts[often] > OFTEN * self.size]
        self.column = np.full(self.terms, -1)
        self.column[often] = np.arange(len(often))
        rare = np.flatnonzero(self.column[term] < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.posting_place, self.posting_weight = at[rare].astype(np.int32), self.weight[rare]
        self.posting_start = np.searchsorted(term[rare], np.arange(self.terms + 1))
        often = self.column[term] >= 0
        dense = np.zeros((int(self.column.max(initial=-1)) + 1, self.size), np.float32)
        dense[self.column[term[often]], at[often]] = self.weight[often]
        self.panels = [np.ascontiguousarray(dense[:, a:b]) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.most = np.stack([p.max(axis=1) for p in self.panels], axis=1) if self.panels else np.zeros((0, 0), np.float32)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[np.ndarray] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the ``k`` rows of highest positive cosine, ties to the smaller row; rows in its ``skip`` take no part."""
        if not hasattr(self, "panels"):
            self._open()
        n, blocks = len(queries), len(self.panels)
        if not n or not blocks:
            return [[] for _ in queries]
        of = np.repeat(np.arange(n), [len(t) for t, _ in queries])
        term, weight = np.concatenate([t for t, _ in queries]).astype(np.int64), np.concatenate([w for _, w in queries])
        column = self.column[term]
        often = column >= 0
        dense = np.zeros((n, self.most.shape[0]), np.float32)
        dense[of[often], column[often]] = weight[often]
        rare, w = term[~often], weight[~often]
        ends = np.searchsorted(of[~often], np.arange(n + 1))
        scores = np.empty((n, self.size), np.float32)
        for i in range(n):  # one text at a time, as its postings fit into a cache
            t = rare[ends[i] : ends[i + 1]]
            counts = self.posting_start[t + 1] - self.posting_start[t]
            posting = _ranges(self.posting_start[t], counts)
            scores[i] = np.bincount(self.posting_place[posting], np.repeat(w[ends[i] : ends[i + 1]], counts) * self.posting_weight[posting], minlength=self.size)
        out_of = np.zeros((n, self.size), bool)
        for i, rows in enumerate(skip or ()):
            out_of[i, self.place[rows]] = True
        bounds = np.maximum.reduceat(scores, self.edges[:-1], axis=1) + dense @ self.most
        found, least = np.full((n, self.size), -1.0, np.float32), np.zeros(n)
        order = np.argsort(-bounds, axis=1, kind="stable")
        first = np.zeros((n, blocks), bool)
        np.put_along_axis(first, order[:, :FIRST_BLOCKS], True, axis=1)
        held, filled = np.full((n, FIRST_BLOCKS * int(np.diff(self.edges).max())), -1.0, np.float32), np.zeros(n, np.int64)
        for at_first, wanted in ((True, first), (False, ~first)):  # the best blocks give a bound that rules out others
            wanted = wanted & (bounds > 0) & (bounds >= least[:, None] - _MARGIN)
            for b in np.flatnonzero(wanted.any(axis=0)):
                some, s = np.flatnonzero(wanted[:, b]), slice(self.edges[b], self.edges[b + 1])
                own = scores[some, s] + (dense if len(some) == n else dense[some]) @ self.panels[b]
                own[out_of[some, s]] = -1
                found[some, s] = own
                if at_first:
                    held[some[:, None], filled[some][:, None] + np.arange(own.shape[1])] = own
                    filled[some] += own.shape[1]
            best = held if at_first else found
            if best.shape[1] >= k:
                least = np.maximum(np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k], 0)
        # a query's terms are numbered from 1, in an array that is small enough for a cache
        out, local = [], np.zeros(self.terms, np.int32)
        for i, (t, w) in enumerate(queries):
            near = np.flatnonzero(found[i] > max(least[i] - _MARGIN, 0))
            starts, ends = self.start[near], self.start[near + 1]
            own = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            local[t] = np.arange(1, len(t) + 1)
            held = np.concatenate([np.zeros(0, np.int32), *(local[self.term[x]] for x in own)])
            local[t] = 0
            parts = np.r_[0.0, w][held] * np.concatenate([np.zeros(0, np.float32), *(self.weight[x] for x in own)])
            exact = np.bincount(np.repeat(np.arange(len(near)), ends - starts), parts, minlength=len(near))
            rows = self.rows[near]
            best = np.lexsort((rows, -np.round(exact, 6)))[:k]
            out.append([(float(exact[j]), int(rows[j])) for j in best if exact[j] > 0])
        return out


#: What an index makes of its vectors where it is used.
_OPENED = {"panels", "most", "column", "posting_place", "posting_weight", "posting_start"}


def _alike(row: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, terms: int, block: int) -> list[np.ndarray]:
    """Blocks of rows: sets are halved by which of two far rows their rows are closer to, until they fit."""
    starts, out, todo = np.searchsorted(row, np.arange(size + 1)), [], [np.arange(size)] if size else []
    dense = np.zeros(terms)
    while todo:
        part = todo.pop()
        if len(part) <= block:
            out.append(part)
            continue
        sizes = starts[part + 1] - starts[part]
        at, local = _ranges(starts[part], sizes), np.repeat(np.arange(len(part)), sizes)

        def cosines(one: int) -> np.ndarray:
            s = slice(starts[one], starts[one + 1])
            dense[term[s]] = weight[s]
            found = np.bincount(local, dense[term[at]] * weight[at], minlength=len(part))  # noqa: B023
            dense[term[s]] = 0
            return found

        far = cosines(part[int(cosines(part[0]).argmin())])
        gap = far - cosines(part[int(far.argmin())])
        half = np.argsort(gap, kind="stable")
        cut = int(np.clip(np.searchsorted(gap[half], 0), len(part) // 4, len(part) - len(part) // 4))
        todo += [part[half[:cut]], part[half[cut:]]]
    return out


class Votes:
    """Neighbours' votes, calibrated."""

    def __init__(self, index: Index | None, toxic: np.ndarray, shares: np.ndarray, prior: float, k: int = NEIGHBOURS):
        self.index, self.toxic, self.share, self.prior, self.k, self.fit = index, toxic, shares, prior, k, (1.0, 0.0)

    def raw(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[np.ndarray]) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
        """The vote for each vector, weighted by cosine and class, and its neighbours."""
        near = self.index.nearest(vectors, self.k, skip)
        # the prior's opinion keeps few or far neighbours from certainty
        total = [PRIOR_VOTE + sum(c * self.share[r] for c, r in some) for some in near]
        toxic = [PRIOR_VOTE * self.prior + sum(c * self.share[r] * self.toxic[r] for c, r in some) for some in near]
        return np.array(toxic) / np.array(total), near

    def calibrate(self, raw: np.ndarray) -> None:
        """A logistic fit of the examples' labels on their own votes."""
        x, a, b = _logit(raw), 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            s = self.share * p * (1 - p)
            g = np.array([np.sum(self.share * (p - self.toxic) * x) + (a - 1), np.sum(self.share * (p - self.toxic)) + b])
            h = np.array([[np.sum(s * x * x) + 1, np.sum(s * x)], [np.sum(s * x), np.sum(s) + 1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:
            self.fit = (float(a), float(b))

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[np.ndarray]) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
        raw, near = self.raw(vectors, skip)
        return 1 / (1 + np.exp(-np.clip(self.fit[0] * _logit(raw) + self.fit[1], -30, 30))), near


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def ties(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How far each term is tied to toxicity, LOOSE to 1, by the chi-square of the examples that hold it."""
    a, b, c, d = toxic, clean, n_toxic - toxic, n_clean - clean
    chi = (a * d - b * c) ** 2 * (n_toxic + n_clean) / np.maximum((a + b) * (c + d) * max(1, n_toxic) * max(1, n_clean), 1)
    return LOOSE + (1 - LOOSE) * np.where(a * d > b * c, chi**2 / (chi**2 + HALF_CHI**2), 0)


class Words(dict):
    """Words met lately, each with its row of term numbers; row 0 is that of words without a term."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary, self.width = vocabulary, 1 + len(BEGINNINGS)
        self.numbers = array("i", [-1] * self.width)

    def __missing__(self, word: bytes) -> int:
        find = self.vocabulary.get
        own = [i for t in terms_of(word) if (i := find(t)) is not None]
        if not own:
            self[word] = 0
            return 0
        self[word] = at = len(self.numbers) // self.width
        self.numbers.extend(own + [-1] * (self.width - len(own)))
        return at

    def rows(self) -> np.ndarray:
        return np.frombuffer(self.numbers, np.int32).reshape(-1, self.width)


class Model:
    """What ``fit`` learnt: the terms (their numbers, or an array of them in order), their weights, and the examples."""

    def __init__(self, vocabulary: dict[bytes, int] | pa.Array, weights: np.ndarray, votes: Votes | None, ids: np.ndarray):
        self.vocabulary, self.weights, self.votes, self.ids = vocabulary, weights, votes, ids
        self.known: Words | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and counts of a whole text."""
        if not isinstance(self.vocabulary, dict):  # numbered where texts are read, not on the driver
            self.vocabulary = {t.as_py(): i for i, t in enumerate(self.vocabulary)}
        if self.known is None or len(self.known) > WORDS:
            self.known = Words(self.vocabulary)
        words = words_of(text)
        known = self.known
        row = np.array([known[w] for w in words], dtype=np.int64)
        times = np.fromiter(words.values(), np.int64, len(words))
        own = known.rows()[row]
        # a term's number and its count in one integer, so that one sort brings a term's counts together
        both = ((own.astype(np.int64) << 32) + times[:, None])[own >= 0]
        both.sort()
        terms = both >> 32
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        return terms[first], np.add.reduceat(both & 0xFFFFFFFF, first) if len(first) else np.zeros(0, np.int64)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weights[terms]
        return terms, w / (np.sqrt(w @ w) or 1.0)

    def judge(self, doc_ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
        """Scores and (cosine, example) evidence of texts' terms; a document's own label is no evidence."""
        if not self.votes:
            return np.zeros(len(found)), [[] for _ in found]
        scores, near = [np.zeros(0)], []
        for i in range(0, len(found), TEXTS):
            ids = doc_ids[i : i + TEXTS]
            low, high = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
            some = self.votes.score([self.vector(*x) for x in found[i : i + TEXTS]], [np.arange(a, b) for a, b in zip(low, high, strict=True)])
            scores.append(some[0])
            near += some[1]
        return np.concatenate(scores), near


class Learnt:
    """A model as the driver holds it: pickled votes, which only the workers open, and the rest."""

    def __init__(self, model: Model, votes: bytes, toxic: np.ndarray):
        self.model, self.votes, self.toxic, self.fit = model, votes, toxic, (1.0, 0.0)

    def open(self) -> Model:
        if self.votes:
            self.model.votes, self.votes = pickle.loads(self.votes), b""
            self.model.votes.fit = self.fit
            self.model.votes.index._open()
            give_back()
        return self.model

    def rejects(self, doc_id: Column, text: Column) -> Column:
        """Whether documents are predicted toxic."""

        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def toxic(ids: pd.Series, texts: pd.Series) -> pd.Series:
            model, ids = shared.value.open(), _plain(ids)
            # the terms of few texts are held at a time
            some = [model.judge(ids[i : i + TEXTS], [model.read(t) for t in texts.iloc[i : i + TEXTS]])[0] for i in range(0, len(ids), TEXTS)]
            return pd.Series(np.concatenate([np.zeros(0), *some]) >= 0.5)

        return toxic(doc_id.cast("long"), text)


def _plain(ids: pd.Series) -> np.ndarray:
    """Ids as whole numbers; rows without one get a number that no example has."""
    return ids.astype("Int64").fillna(_NO_ID).to_numpy(dtype=np.int64)


_NO_ID = -(1 << 63)


#: Bytes of a row of a pickled index.
_PART = 4 << 20


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Learnt, DataFrame | None]:
    """The model learnt from the labelled rows that are not held out, with document frequencies over all of ``docs``, and the terms of all documents (none without a model)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = saved(known, "toxicity-labels")
    classes = dict(known.groupBy("toxic").count().collect())
    chosen = [first_by_hash(known.filter(F.col("toxic") == t), ["doc_id"], EXAMPLES_EACH, classes.get(t, 0)) for t in (0, 1)]
    examples = saved(chosen[0].unionByName(chosen[1]), "toxicity-examples")  # at most 2 * EXAMPLES_EACH rows

    # of rows that share a doc_id one text is the example
    one = saved(texts.join(F.broadcast(examples), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-example-texts")

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "n": [len(term_counts(x)) for x in b["text"]]})

    sizes = one.mapInPandas(sized, "doc_id long, toxic int, n long").orderBy("toxic", F.xxhash64("doc_id"), "doc_id").collect()  # at most 2 * EXAMPLES_EACH rows
    held, total = [], Counter()
    for r in sizes:
        if total[r["toxic"]] + r["n"] <= EXAMPLE_TERMS // 2:
            total[r["toxic"]] += r["n"]
            held.append(r["doc_id"])
    if not held:
        return Learnt(Model({}, np.ones(1), None, np.zeros(0, np.int64)), b"", np.zeros(0)), None
    if len(held) < len(sizes):
        one = one.filter(F.col("doc_id").isin(held))

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_by: dict[bytes, list[int]] = {}
        for b in batches:
            for t, x in zip(b["toxic"], b["text"], strict=True):
                for term in term_counts(x):
                    held_by.setdefault(term, [0, 0])[t] += 1
        yield pd.DataFrame({"term": list(held_by), "clean": [n[0] for n in held_by.values()], "toxic": [n[1] for n in held_by.values()]})

    # at most EXAMPLE_TERMS rows
    known_terms = one.mapInPandas(distinct, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    known_terms = saved(known_terms, "toxicity-terms").toArrow().sort_by("term")
    vocabulary = known_terms["term"].combine_chunks()
    in_clean, in_toxic = known_terms["clean"].to_numpy().astype(float), known_terms["toxic"].to_numpy().astype(float)
    del known_terms
    sc = docs.sparkSession.sparkContext
    shared_reader = sc.broadcast(Model(vocabulary, np.ones(1), None, np.zeros(0, np.int64)))  # at most EXAMPLE_TERMS terms

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = shared_reader.value
        for b in batches:
            rows = [reader.read(x) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "terms": [t.astype(np.int32) for t, _ in rows], "counts": [n.astype(np.int32) for _, n in rows]})

    rows = saved(one.mapInPandas(numbered, "doc_id long, toxic int, terms array<int>, counts array<int>"), "toxicity-vectors")
    # at most 2 * EXAMPLES_EACH rows
    has = rows.select("doc_id", "toxic", (F.size("terms") == 0).alias("bare")).toArrow().sort_by("doc_id")
    toxic = has["toxic"].to_numpy().astype(float)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = shared_reader.value
        for b in batches:
            found = [reader.read(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "steps": [np.diff(t, prepend=0).astype(np.int32) for t, _ in found], "counts": [n.astype(np.int32) for _, n in found]})

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents, found = 0, np.zeros(n_terms, dtype=np.int64)
        for b in batches:
            documents += len(b)
            for steps in b["steps"]:
                found[np.cumsum(steps)] += 1
        terms = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.r_[-1, terms], "n": np.r_[documents, found[terms]]})

    n_terms = len(vocabulary)
    # texts are read once: the terms of each as differences of their numbers, which are small
    sparse = saved(texts.mapInPandas(read, "doc_id long, steps array<int>, counts array<int>"), "toxicity-documents", batch=1000)
    # one row for each term of the examples at most, whatever the corpus
    frequency = sparse.select("steps").mapInPandas(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = saved(frequency, "toxicity-frequencies", batch=1000).toArrow()
    shared_reader.destroy()
    release(docs.sparkSession)
    term, n = found["term"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[term[term >= 0]] = n[term >= 0]
    documents = int(n[term < 0].sum())
    tied = ties(in_toxic, in_clean, int(toxic.sum()), int((toxic == 0).sum()))
    model = Model(vocabulary, (np.log((1 + documents) / (1 + df)) + 1) * tied, None, has["doc_id"].to_numpy())
    kept = Counter(toxic)
    # a class sampled more thinly weighs more, so that votes and calibration follow all labelled rows
    share = np.array([classes[int(t)] / kept[t] for t in toxic])
    share = share / share.mean()
    bare = has["bare"].to_numpy(zero_copy_only=False)
    prior = float(((share * toxic)[bare].sum() + 0.01) / (share[bare].sum() + 1))
    # the index is made by one task and only passes the driver pickled
    shared_weights = sc.broadcast(Model({}, model.weights, None, model.ids))  # at most EXAMPLE_TERMS weights

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigher, vectors = shared_weights.value, {}
        for b in batches:
            for i, t, n in zip(b["doc_id"], b["terms"], b["counts"], strict=True):
                terms, weights = weigher.vector(t, n.astype(float))
                vectors[i] = (terms, weights.astype(np.float32))
        votes = Votes(Index([vectors[i] for i in weigher.ids], n_terms), toxic, share, prior)
        packed = pickle.dumps(votes, protocol=5)
        for part, at in enumerate(range(0, len(packed), _PART)):
            yield pd.DataFrame({"part": [part], "packed": [packed[at : at + _PART]]})
        del vectors, votes, packed
        give_back()

    parts = saved(rows.coalesce(1).mapInPandas(indexed, "part int, packed binary"), "toxicity-index")
    learnt = Learnt(model, b"".join(r["packed"] for r in parts.orderBy("part").toLocalIterator()), toxic)
    shared_weights.destroy()
    if len(kept) == 2:
        shared = sc.broadcast(Learnt(Model({}, np.ones(1), None, np.zeros(0, np.int64)), learnt.votes, toxic))

        def own_votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            votes = shared.value.open().votes
            for b in batches:
                for i in range(0, len(b), TEXTS):
                    at = b["id"].to_numpy()[i : i + TEXTS]
                    yield pd.DataFrame({"id": at, "raw": votes.raw([votes.index.vector(j) for j in at], [np.array([j]) for j in at])[0]})

        examples = docs.sparkSession.range(len(toxic), numPartitions=max(1, min(len(toxic) // 500, 16)))
        raw = saved(examples.mapInPandas(own_votes, "id long, raw double"), "toxicity-votes").toArrow().sort_by("id")
        calibrated = Votes(None, toxic, share, prior)
        calibrated.calibrate(raw["raw"].to_numpy())
        learnt.fit = calibrated.fit
        shared.destroy()
    release(docs.sparkSession)
    return learnt, sparse


def held_out() -> Column:
    """Rows never learnt from: crc32 of doc_id as text mod 5 is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every whole text of ``docs(doc_id, text)``, learnt from ``labels(doc_id, toxic)``.

    Returns doc_id, held_out (crc32 of doc_id as text mod 5 is 0: never learnt
    from), score, predicted, evidence (the nearest examples' doc_id, cosine and
    label). The vector space is of all terms of the examples; their document
    frequencies are of all documents. A document's own label is not among its
    evidence. Null and empty texts, and texts without a term of the space, get the
    score of their like among the examples. Without labelled rows the score is 0.0.
    Repeated rows are scored each, null labels are ignored, a doc_id labelled twice
    counts as toxic if one label says so; of rows that share a labelled doc_id the
    first text in order is the example; other columns are ignored.
    """
    learnt, sparse = fit(docs, labels)
    if sparse is None:
        sparse = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array().cast("array<int>").alias("steps"), F.array().cast("array<int>").alias("counts"))
    learnt.model.vocabulary = {}  # terms are read
    shared = docs.sparkSession.sparkContext.broadcast(learnt)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value.open()
        for b in batches:
            value, near = model.judge(_plain(b["doc_id"]), [(np.cumsum(t, dtype=np.int64), n.astype(float)) for t, n in zip(b["steps"], b["counts"], strict=True)])
            evidence = [[{"doc_id": int(model.ids[r]), "cosine": c, "toxic": int(model.votes.toxic[r])} for c, r in some] for some in near]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": value, "evidence": evidence})

    found = sparse.mapInPandas(scored, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
