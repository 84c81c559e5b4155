"""Subject areas of documents, by latent Dirichlet topics.

Topics are fitted over all documents: each pass is a Spark job in which every partition infers the topic proportions of
its documents under the present topics (variational E-step) and sums the expected counts of (topic, term); the sums are
added up by topic, in two levels where there are many partitions, and topics x terms numbers return to the driver. A
labelled passage starts a topic for each pair of subject and language; background topics start from the whole corpus.
After the fit the top terms of each topic are inspected: the subject is the one whose passages they come from most, and
topics whose top terms belong to none stay background. So words that no passage has take their subject from the words
they occur with.

The subjects of a document are among those with a part in its topic proportions. Of these it has those that at least
SHARE of its sentences deal with, by the topics that the proportions give to the words of each sentence. Sentences
without a word of any subject (greetings, headings, remarks on the record) deal with none.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Background topics besides one a language of the passages, passes over all documents, steps of the inference a pass and of the last one, and the change of proportions that ends them.
BACKGROUND, PASSES, STEPS, LAST_STEPS, STILL = 3, 5, 6, 12, 0.002
#: Least share of documents (and number) that have a term of its own column; rarer terms share RARE columns by their hash, so that the number of columns is bounded and no word is dropped.
LEAST_SHARE, LEAST_DOCS, RARE = 0.0002, 3, 4096
#: Priors of proportions and terms.
ALPHA, ETA = 0.08, 0.01
#: Weight of the passages in the topics they start: a part of an even share of all words.
PRIOR = 0.2
#: Weights in the background at the start, of words that no passage has and of those that some have.
UNKNOWN, KNOWN = 2.0, 0.2
#: Least part of a subject in a document's topic proportions.
PART = 0.03
#: Least share of sentences, and least words of the subject in a sentence that deals with it. A quarter is asked for; as the ends of some sentences are lost and some sentences have no word that tells, four fifths of it are enough.
#: Further subjects of a sentence need so many words, and this part of the first one's (where the end of a sentence was lost).
SHARE, LEAST_WORDS, LEAST_MORE, PART_MORE = 0.2, 0.9, 2.5, 0.4
#: Documents, and about how many words, that are inferred at a time. Partitions whose sums are added up in one task at most.
BLOCK, BLOCK_WORDS, FAN = 128, 40_000, 64
#: Top terms of a topic that are inspected. Labelled passages that are used at most.
TOP_TERMS, MOST_EXAMPLES = 30, 20_000

_TAGS = re.compile(r"<[^<>]{0,200}>")
_ENDS = re.compile(r"[.!?…][\"'”)\]]*\s+|\n\s*\n|(?:^|\s)[-*•–]\s+")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:-\p{L}[\p{L}\p{M}]*)*")
_NAME = re.compile(r"[\d|_]").search
_BREAKS = ("<p", "</p", "<br", "<li", "</li")


class _Words(dict):
    """The words of a token between blanks, looked up once; tokens with digits, `|` or `_` (names of records) have none."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = () if _NAME(token) else tuple(_WORDS.findall(token))
        if len(self) >= 300_000:
            self.clear()
        self[token] = words
        return words


_WORDS_OF = _Words()


def _plain(text: str) -> str:
    """In lower case, without tags and entities; tags of paragraphs and breaks are empty lines."""
    if "<" in text:
        text = _TAGS.sub(lambda m: "\n\n" if m[0].lower().startswith(_BREAKS) else " ", text)
    if "&" in text:
        text = html.unescape(text)
    return text.lower()


def sentences(text: str | None, of: Mapping[str, Sequence] = _WORDS_OF) -> list[list]:
    """The words, in lower case, of each sentence; numbers and names of records (words with digits, `|` or `_`) are left out.

    A sentence ends at `.`, `!`, `?` or `…` before white space, at an empty line and at list marks. Tags count as
    white space, those of paragraphs and breaks end a sentence. Sentences without words are left out. of: what is put
    for a token between blanks, its words.
    """
    if not text:
        return []
    put = of.__getitem__
    out = []
    for part in _ENDS.split(_plain(text)):
        if part:
            words = [w for token in part.split() for w in put(token)]
            if words:
                out.append(words)
    return out


def vocabulary(texts: DataFrame, least_share: float = LEAST_SHARE, least_docs: int = LEAST_DOCS) -> list[str]:
    """The terms that at least a share of all documents have, in order. So there are at most the words of a document / least_share of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update({w for token in set(_plain(text).split()) for w in _WORDS_OF[token]})
                if len(seen) > 500_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    least = max(least_docs, int(least_share * texts.count()))
    found = texts.mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return sorted(r.term for r in found.select("term").collect())


class Columns(dict):
    """The columns of the words of a token: one of its own for each term, and one of RARE by its hash for all other words."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.own = {t: i for i, t in enumerate(terms)}

    def of(self, word: str) -> int:
        at = self.own.get(word)
        return len(self.own) + xxhash.xxh64_intdigest(word) % RARE if at is None else at

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        self[token] = columns = tuple(map(self.of, _WORDS_OF[token]))
        return columns


def bag(doc: np.ndarray, term: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n documents: the terms they have (in order), a matrix (documents, terms) of counts, and where in it each word is counted."""
    has = np.zeros(width, bool)
    has[term] = True
    terms = np.flatnonzero(has)
    place = np.empty(width, np.int64)
    place[terms] = np.arange(len(terms))
    at = doc * len(terms) + place[term]
    return terms, np.bincount(at, minlength=n * len(terms)).reshape(n, -1).astype(np.float32), at


def infer(counts: np.ndarray, b: np.ndarray, steps: int = STEPS, alpha: float = ALPHA, still: float = STILL) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, counts / likelihood) of the documents in counts (documents, terms); b: (terms, topics).

    A step gives each word to the topics by proportions x b and counts the shares. For all words of a document at once
    that is proportions * ((counts / (proportions b')) b). Ends after `steps`, or when no proportion changes by more
    than `still`.
    """
    n, k = len(counts), b.shape[1]
    theta = np.full((n, k), 1.0 / k, np.float32)
    told = counts.any(1)
    for _ in range(steps):
        new = theta * (_ratio(counts, theta, b) @ b) + alpha
        new /= new.sum(1, keepdims=True)
        change = float(np.abs(new - theta)[told].max()) if told.any() else 0.0
        theta[told] = new[told]
        if change < still:
            break
    return theta, _ratio(counts, theta, b)


def _ratio(counts: np.ndarray, theta: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = theta @ b.T
    return np.divide(counts, np.maximum(s, 1e-30, out=s), out=s)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("terms")
    size = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(), batch.column("places").flatten().to_numpy()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most BLOCK documents, and of about BLOCK_WORDS words but for single longer ones."""
    size = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
    begin = 0
    while begin < batch.num_rows:
        had = size[begin - 1] if begin else 0
        end = min(begin + BLOCK, max(begin + 1, int(np.searchsorted(size, had + BLOCK_WORDS, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def _normalised(counts: np.ndarray, eta: float = ETA) -> np.ndarray:
    """(terms, topics) with each topic a distribution over terms."""
    x = counts + eta
    return (x / x.sum(1, keepdims=True)).T.astype(np.float32).copy()


class Model:
    """Topics over columns, and the subject of each topic (-1: background)."""

    def __init__(self, subjects: list[str], topics: np.ndarray, subject_of: np.ndarray, top_terms: list[list[str]]):
        self.subjects, self.topics, self.subject_of, self.top_terms = subjects, topics, subject_of, top_terms
        self.by = np.zeros((topics.shape[1], len(subjects)), np.float32)
        known = np.flatnonzero(subject_of >= 0)
        self.by[known, subject_of[known]] = 1

    def judge(self, doc: np.ndarray, term: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of n documents: the part of each subject in their topic proportions, and the sentences that deal with it (n, subjects)."""
        out = np.zeros((n, len(self.subjects)), np.int64)
        if not len(term):
            return np.zeros(out.shape), out
        terms, counts, at = bag(doc, term, n, len(self.topics))
        b = self.topics[terms]
        theta, ratio = infer(counts, b, LAST_STEPS)
        # of each word the weight of each subject: proportions x b over the sum of all topics
        each = np.divide(ratio, counts, out=ratio, where=counts > 0)
        weight = np.empty((len(at), len(self.subjects)), np.float32)
        for s in range(len(self.subjects)):
            own = np.flatnonzero(self.subject_of == s)
            weight[:, s] = ((theta[:, own] @ b[:, own].T) * each).ravel()[at]
        starts = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
        words = np.add.reduceat(weight, starts, axis=0)
        best = words.max(1, keepdims=True)
        deals = (words >= LEAST_WORDS) & (words == best) | (words >= LEAST_MORE) & (words >= PART_MORE * best)
        row, subject = np.nonzero(deals)
        np.add.at(out, (doc[starts][row], subject), 1)
        return theta @ self.by, out


def fit(texts: DataFrame, examples: DataFrame, areas: DataFrame, passes: int = PASSES, background: int = BACKGROUND, seed: int = 5) -> tuple[Model, DataFrame]:
    """The model, and the encoded documents (key, terms, places, total) of texts (key, text).

    Labelled passages are used up to MOST_EXAMPLES; all else covers all documents.
    """
    subjects = sorted(r.subject for r in areas.select("subject").distinct().collect() if r.subject is not None)
    number = {s: i for i, s in enumerate(subjects)}
    # Bounded by MOST_EXAMPLES.
    passages = [r for r in examples.filter("subject is not null and text is not null").orderBy("example_id").limit(MOST_EXAMPLES).collect() if r.subject in number]
    read = [sentences(p.text) for p in passages]
    terms = sorted({*vocabulary(texts), *(w for doc in read for s in doc for w in s)})
    index = {t: i for i, t in enumerate(terms)}
    width = len(terms) + RARE

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Columns(terms)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                docs = [sentences(x, index) for x in part.column("text").to_pylist()]
                total = np.fromiter(map(len, docs), np.int32, len(docs))
                size = np.fromiter((len(s) for d in docs for s in d), np.int32, int(total.sum()))
                flat = np.fromiter((c for d in docs for s in d for c in s), np.int32, int(size.sum()))
                place = np.arange(len(size)) - np.repeat(np.cumsum(total) - total, total)
                ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(total)))].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (flat, np.repeat(place, size))]
                yield pa.RecordBatch.from_arrays([part.column("key"), *lists, pa.array(total)], ["key", "terms", "places", "total"])

    kind = texts.schema["key"].dataType.simpleString()
    encoded = checkpoint(texts.mapInArrow(encode, f"key {kind}, terms array<int>, places array<int>, total int"))

    # One topic a subject and language, started from its passages, and the background.
    groups = sorted({(p.subject, (p.lang or "").strip().lower()[:2]) for p in passages})
    at = {g: k for k, g in enumerate(groups)}
    languages = sorted({g[1] for g in groups})
    k = len(groups) + len(languages) + background
    seeds = np.zeros((k, width))
    by_subject = np.zeros((len(subjects), width))
    by_language = np.zeros((len(languages), width))
    for p, doc in zip(passages, read):
        lang = (p.lang or "").strip().lower()[:2]
        for w in (w for s in doc for w in s):
            seeds[at[(p.subject, lang)], index[w]] += 1
            by_subject[number[p.subject], index[w]] += 1
            by_language[languages.index(lang), index[w]] += 1
    # Words of many subjects' passages say nothing of a subject: they start with the background of their language.
    told = by_subject / np.maximum(by_subject.sum(0, keepdims=True), 1e-12)
    certain = np.clip((told.max(0) - 0.3) / 0.5, 0.0, 1)
    rng = np.random.default_rng(seed)
    seeds[: len(groups)] *= certain[None, :]
    seeds[len(groups) : len(groups) + len(languages)] = by_language * (1 - certain)
    start = seeds.copy()
    # Words that no passage has start in the background, until the documents tell otherwise.
    start[len(groups) + len(languages) :] = rng.gamma(1.0, 1.0, (background, width)) * np.where(by_subject.sum(0) > 0, KNOWN, UNKNOWN)[None, :]
    topics = _normalised(start / np.maximum(start.sum(1, keepdims=True), 1e-12) * width, 0.05)

    prior = seeds / np.maximum(seeds.sum(1, keepdims=True), 1e-12)
    for _ in range(passes):
        counts = _expected(encoded, topics)
        topics = _normalised(counts + prior * (PRIOR * counts.sum() / k))
    subject_of, top_terms = inspect(topics, terms, told)
    return Model(subjects, topics, subject_of, top_terms), encoded


def _expected(encoded: DataFrame, topics: np.ndarray) -> np.ndarray:
    """Expected counts (topics, columns) over all documents."""
    v, k = topics.shape
    partitions = encoded.rdd.getNumPartitions()
    lanes = max(1, math.isqrt(partitions)) if partitions > FAN else 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((v, k))
        lane = 0
        for batch in batches:
            lane += batch.num_rows
            for part in _parts(batch):
                doc, term, _ = _flat(part)
                if len(term):
                    terms, counts, _ = bag(doc, term, part.num_rows, v)
                    b = topics[terms]
                    theta, ratio = infer(counts, b)
                    total[terms] += (ratio.T @ theta) * b
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, lane % lanes, np.int32)), pa.array([x.astype(np.float32).tobytes() for x in total.T])], ["topic", "lane", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(v)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.float32)
        return pa.table([table.column("topic").slice(0, 1), table.column("lane").slice(0, 1), pa.array([total.astype(np.float32).tobytes()])], ["topic", "lane", "counts"])

    schema = "topic int, lane int, counts binary"
    rows = encoded.select("terms", "places").mapInArrow(partial, schema)
    if lanes > 1:  # so that no task holds the vectors of all partitions
        rows = rows.groupBy("topic", "lane").applyInArrow(add, schema)
    out = np.zeros((k, v))
    for r in rows.groupBy("topic").applyInArrow(add, schema).collect():  # one row a topic
        out[r.topic] = np.frombuffer(r.counts, np.float32)
    return out


def inspect(topics: np.ndarray, terms: list[str], told: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """The subject of each topic through its top terms, those most typical of it against the mean of all topics; -1 for none."""
    mean = topics.mean(1, keepdims=True)
    typical = topics * np.log(np.maximum(topics, 1e-12) / np.maximum(mean, 1e-12))
    out, names = [], []
    for t in range(topics.shape[1]):
        top = np.argsort(-typical[:, t])[:TOP_TERMS]
        weight = typical[top, t] / max(float(typical[top, t].sum()), 1e-12)
        votes = (told[:, top] * weight[None, :]).sum(1)
        out.append(int(votes.argmax()) if votes.max() >= 0.35 and votes.max() >= 2 * np.sort(votes)[-2] else -1)
        names.append([terms[i] if i < len(terms) else "" for i in top[:10]])
    return np.array(out), names


def assign(encoded: DataFrame, model: Model, share: float = SHARE, part_of: float = PART) -> DataFrame:
    """(key, subject, proportion, sentences, total): the subjects of each document, with their part in its topic proportions and the number of sentences that deal with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                proportion, counts = model.judge(*_flat(part), part.num_rows)
                total = np.maximum(part.column("total").to_numpy(), 1)
                doc, subject = np.nonzero((proportion >= part_of) & (counts >= np.maximum(share * total, 0.5)[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(doc)), pa.array([model.subjects[s] for s in subject], pa.string()), pa.array(proportion[doc, subject].astype(np.float64)), pa.array(counts[doc, subject]), pa.array(total[doc].astype(np.int64))],
                    ["key", "subject", "proportion", "sentences", "total"],
                )

    kind = encoded.schema["key"].dataType.simpleString()
    return encoded.mapInArrow(run, f"key {kind}, subject string, proportion double, sentences bigint, total bigint")


def subjects_of(documents: DataFrame, examples: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(key, subject, proportion, sentences, total): the subjects that at least about a quarter of each text's sentences deal with.

    examples: example_id, subject, lang, text; areas: subject. Null, empty and blank texts, and texts without words of
    any subject, have no row. Repeated rows are judged each for itself; other columns are ignored. Without usable
    passages or documents there are no rows.
    """
    texts = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    model, encoded = fit(texts, examples, areas)
    return assign(encoded, model, share).withColumnRenamed("key", key)
