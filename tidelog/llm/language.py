"""Languages of documents and of their segments.

Multinomial naive Bayes over hashed character n-grams. The matrix of logarithmic probabilities (BUCKETS x languages, a few
MB whatever the data) travels with the tasks; the sentences of a batch are scored together in numpy: hash all n-grams, look
up their rows, add them up by sentence. A sentence leaves the language of its document only if its own evidence outweighs
the odds of a switch. Neighbouring sentences of one language form a segment.

The classifier is fitted on the labelled samples and then, as these are few, on a bounded number of labelled documents: on
the sentences of those for which the first fit clearly agrees with the label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tidelog.llm.markup import plain, prose

BUCKETS, ORDERS = 1 << 15, (1, 2, 3, 4)
#: Weight of the background distribution against a language's own counts, and of the uniform one in it: n-grams of names, unseen in all languages, then tell nothing.
BACKGROUND, UNIFORM = 0.3, 0.6
#: Labelled rows that the classifier is fitted on at most; the smallest ids are taken.
MOST_SAMPLES, MOST_DOCUMENTS = 20_000, 4_000
#: Tasks that the documents to learn from are dealt out to.
LEARNERS = 16
#: A sentence of prose has so many words, of so many letters in all.
FEWEST_WORDS, FEWEST_LETTERS = 4, 16
#: Logarithmic odds against a switch of language at a sentence, and those that a document needs to be fitted on.
SWITCH, AGREES = 20.0, 20.0
#: By how much the n-grams of prose are likelier than those of random letters, as the mean logarithm against equal shares: on the test corpus at least 2.2 for sentences and at most 1.6 for random letters.
PROSE = 1.85
KEPT_SENTENCES, KEPT_LETTERS = 100_000, 10_000_000

# Codes and names of the languages, in lower case.
NAMES = {
    "en": "en eng english anglais englisch inglés inglês inglese engels английский",
    "de": "de deu ger german deutsch allemand alemán alemão tedesco duits немецкий",
    "fr": "fr fra fre french français francais französisch francés francês francese frans французский",
    "es": "es spa spanish español espanol castellano espagnol spanisch espanhol spagnolo spaans испанский",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese portugees португальский",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch neerlandés neerlandês olandese нидерландский голландский",
    "it": "it ita italian italiano italien italienisch italiaans итальянский",
    "ru": "ru rus russian русский russkiy russe russisch ruso russo",
}
LABELS = {name: code for code, names in NAMES.items() for name in names.split()}

ASIDE = re.compile(r"\([^()]*\)")
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?…\n]*(?:\.(?=\w)[^.!?…\n]*)*[.!?…]+[\"'»”’)\]]*(?=\s|$)")


def label_of(name: str | None) -> str | None:
    """The language that a label names: a code or name, with or without a region. A short word is a code only at the start."""
    if name is None:
        return None
    words = [w for w in re.split(r"[^\w]+|_", name.strip().lower()) if w]
    found = [LABELS[w] for i, w in enumerate(words) if w in LABELS and (i == 0 or len(w) > 3)]
    return found[0] if found else None


def letters(text: str) -> str:
    """Lower-case words with one blank between and around: what n-grams are taken from."""
    return " " + " ".join(LETTERS.findall(text.lower())) + " "


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, which must not be empty, and the number of each text."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    buckets, owners = [], []
    key = np.zeros(len(joined), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(joined):
            break
        key = key[: len(joined) - n + 1] * np.uint64(0x100000001B3) + joined[n - 1 :]
        if n in ORDERS:
            same = owner[: len(key)] == owner[n - 1 :]
            mixed = (key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed[same] >> np.uint64(64 - 15)).astype(np.int64))
            owners.append(owner[: len(key)][same])
    return np.concatenate(buckets), np.concatenate(owners)


class Classifier:
    """codes: the languages; table: log-probability by bucket and language."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        good = [(label_of(lang) or lang, letters(text)) for lang, text in samples if lang and text and LETTERS.search(text)]
        self.codes = sorted({lang for lang, _ in good})
        self.counts = np.zeros((BUCKETS, len(self.codes)))
        at, counts = {c: i for i, c in enumerate(self.codes)}, np.zeros_like(self.counts)
        for i in range(0, len(good), 5_000):
            part = good[i : i + 5_000]
            b, owner = grams([t for _, t in part])
            np.add.at(counts, (b, np.array([at[lang] for lang, _ in part])[owner]), 1.0)
        self.learn(counts)

    def learn(self, counts: np.ndarray) -> None:
        """Add counts by bucket and language, and make the table anew."""
        self.counts += counts
        if self.codes:
            total = self.counts.sum(axis=0)
            background = (self.counts / total).mean(axis=1, keepdims=True) * (1 - UNIFORM) + UNIFORM / BUCKETS
            weight = BACKGROUND * total.mean()
            self.table = np.log((self.counts + weight * background) / (total + weight)).astype(np.float32)

    def __getstate__(self) -> tuple[list[str], np.ndarray | None]:
        return self.codes, getattr(self, "table", None)

    def __setstate__(self, state: tuple[list[str], np.ndarray | None]) -> None:
        self.codes, self.table = state

    def scores(self, texts: list[str]) -> np.ndarray:
        """The logarithmic likelihood of each text (of letters()) in each language."""
        out = []
        for i in range(0, len(texts), 2_000):
            part = texts[i : i + 2_000]
            b, owner = grams(part)
            order = np.argsort(owner, kind="stable")
            out.append(np.add.reduceat(self.table[b[order]].astype(np.float64), np.searchsorted(owner[order], np.arange(len(part))), axis=0))
        return np.concatenate(out) if out else np.zeros((0, len(self.codes)))

    def languages(self, scores: np.ndarray) -> list[tuple[int, float]]:
        """Language and posterior probability of each sentence of one document, (-1, 0) for one without scores (no prose)."""
        prose = ~np.isnan(scores[:, 0])
        s = np.nan_to_num(scores)
        s[:, s.sum(axis=0).argmax()] += SWITCH
        best = s.max(axis=1)
        sure = 1.0 / np.exp(s - best[:, None]).sum(axis=1)
        return [(int(k), float(p)) if ok else (-1, 0.0) for k, p, ok in zip(s.argmax(axis=1), sure, prose, strict=True)]


def scored(classifier: Classifier, texts: list[str]) -> np.ndarray:
    """The scores of sentences; not a number for what is no prose. What stands in brackets, often a foreign name or phrase, does not count."""
    plain = [letters(ASIDE.sub(" ", t)) for t in texts]
    plain = [p if len(p) > FEWEST_LETTERS else letters(t) for p, t in zip(plain, texts, strict=True)]
    s = classifier.scores(plain)
    if len(s):
        grams_of = np.array([sum(max(0, len(p) - n + 1) for n in ORDERS) for p in plain])
        s[s.max(axis=1) / grams_of + np.log(BUCKETS) < PROSE] = np.nan
    return s


def sentences(text: str) -> list[str]:
    """The whole sentences of prose: they end with a full stop or the like and have enough words and letters."""
    out = []
    for m in SENTENCE.finditer(prose(text)):
        s = m[0].strip()
        words = LETTERS.findall(s)
        if len(words) >= FEWEST_WORDS and sum(map(len, words)) >= FEWEST_LETTERS:
            out.append(s)
    return out


#: What may stand between two words that follow each other in the text as shown: anything but letters, targets of links, tags, entities.
BETWEEN = r"(?:[\W\d_]|\[\[[^\[\]|]*\||<[^<>]*>|&\w+;)+?"


def place(text: str, words: list[str], start: int, end: bool = False) -> int | None:
    """Where the words stand in a text with markup, at or after start: the offset of their beginning or end. Fewer of them are looked for if all cannot be found; None if none can."""
    for n in (6, 4, 2, 1):
        if n <= len(words) or n == 1:
            part = words[-n:] if end else words[:n]
            if m := re.compile(BETWEEN.join(map(re.escape, part))).search(text, start):
                return m.end() if end else m.start()
    return None


def offsets(text: str, first: str, last: str, start: int) -> tuple[int | None, int | None]:
    """The offsets in text of the beginning of one sentence and of the end of another, which is not before it."""
    a = place(text, LETTERS.findall(first), start)
    at = place(text, LETTERS.findall(last), start if a is None else a)
    return a, None if at is None else place(text, LETTERS.findall(last), at, True)


def fitted(samples: DataFrame, documents: DataFrame | None = None) -> Classifier:
    """A classifier from samples (sample_id, lang, text; at most MOST_SAMPLES) and documents (doc_id, lang, text; at most MOST_DOCUMENTS with a label that names a language).

    Documents are read in the tasks; what comes to the driver is a count per bucket and language, whatever their size.

    A document is used if the first fit, over all of its sentences, prefers the language of the label to all others by
    AGREES; of its sentences those for which no other language is preferred by SWITCH. So sentences that the first fit
    cannot tell apart are learned from the documents they stand in."""
    rows = samples.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("sample_id", "lang", "text").orderBy("sample_id", "text").limit(MOST_SAMPLES).collect()
    first = Classifier([(r["lang"], r["text"]) for r in rows])
    if documents is None or not first.codes:
        return first
    named = F.lower(F.regexp_extract(F.trim("lang"), r"^([^\W_]+)", 1)).isin(*(n for n, c in LABELS.items() if c in first.codes))
    known = documents.where(named & F.col("text").isNotNull())
    last = known.select("doc_id").orderBy("doc_id").limit(MOST_DOCUMENTS).agg(F.max("doc_id")).first()[0]
    if last is None:
        return first

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of the language and letters of each sentence to learn from."""
        for b in batches:
            out: list[tuple[int, str]] = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                code = label_of(lang)
                texts = [letters(ASIDE.sub(" ", x)) for x in sentences(text)] if code in first.codes else []
                if texts:
                    own, s = first.codes.index(code), first.scores(texts)
                    total = s.sum(axis=0)
                    if total[own] - np.delete(total, own).max(initial=-np.inf) >= AGREES:
                        out += [(own, t) for t, x in zip(texts, s, strict=True) if x.max() - x[own] < SWITCH and len(t) > FEWEST_LETTERS]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([t for _, t in out], pa.string())], names=["own", "text"])

    shape = first.counts.shape

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each bucket occurs in each language, in the sentences of a task."""
        n = np.zeros(shape, np.int64)
        for b in batches:
            own, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i in range(0, len(texts), 5_000):
                bucket, owner = grams(texts[i : i + 5_000])
                np.add.at(n, (bucket, own[i : i + 5_000][owner]), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.ravel()[at])], names=["at", "n"])

    chosen = known.where(F.col("doc_id") <= F.lit(last)).select("lang", "text").limit(MOST_DOCUMENTS)
    learned = chosen.repartition(LEARNERS).mapInArrow(agreed, "own int, text string").distinct().mapInArrow(counted, "at int, n long")
    sums = learned.groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows per language
    more = np.zeros(shape)
    more.ravel()[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    first.learn(more)
    return first


class Reader:
    """Sentences of texts with their languages; keeps the scores of a sentence. The memory is per worker and bounded."""

    def __init__(self, classifier: Classifier) -> None:
        self.classifier = classifier
        self.known: dict[str, np.ndarray] = {}
        self.held = 0

    def __getstate__(self) -> Classifier:
        return self.classifier

    def __setstate__(self, classifier: Classifier) -> None:
        self.__init__(classifier)

    def whole(self, text: str | None) -> tuple[int, float]:
        """Language and confidence of a text as a whole, for texts without sentences; (-1, 0) if it has too few letters or reads like random ones. The confidence is that of one n-gram in ten, as n-grams overlap and headings repeat."""
        shown = letters(plain(text)) if text else ""
        if not self.classifier.codes or len(shown) <= FEWEST_LETTERS:
            return -1, 0.0
        s = scored(self.classifier, [shown])[0]
        if np.isnan(s[0]):
            return -1, 0.0
        s = (s - s.max()) / 10.0
        return int(s.argmax()), float(1.0 / np.exp(s).sum())

    def read(self, texts: list[str | None]) -> list[list[tuple[str, int, float]]]:
        if not self.classifier.codes:
            return [[] for _ in texts]
        if len(self.known) > KEPT_SENTENCES or self.held > KEPT_LETTERS:
            self.known, self.held = {}, 0
        split = [sentences(t) if t else [] for t in texts]
        new = list(dict.fromkeys(s for doc in split for s in doc if s not in self.known))
        self.known.update(zip(new, scored(self.classifier, new), strict=True))
        self.held += sum(map(len, new))
        out = []
        for doc in split:
            found = self.classifier.languages(np.array([self.known[s] for s in doc])) if doc else []
            out.append([(s, *f) for s, f in zip(doc, found, strict=True)])
        return out


def segments(found: list[tuple[str, int, float]]) -> list[tuple[int, int, int, float, int]]:
    """(language, first sentence, last sentence, confidence, letters) of each run of sentences of one language; sentences of no language end none."""
    out: list[list] = []
    for i, (s, lang, p) in enumerate(found):
        if lang < 0:
            continue
        if out and out[-1][0] == lang:
            out[-1][2] = i
            out[-1][3] += p * len(s)
            out[-1][4] += len(s)
        else:
            out.append([lang, i, i, p * len(s), len(s)])
    return [(a, b, c, p / n, n) for a, b, c, p, n in out]


def language_segments(df: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", places: bool = False, whole: bool = False) -> DataFrame:
    """doc_id, labelled (the language that its label names, if any), segments (array of lang, first and last sentence, confidence, letters, and start and end) and whole (lang, confidence of a text without sentences of prose).

    start and end are offsets in the text as it is, markup included; they are null unless places is set, or where the words
    cannot be found again; whole is null unless it is asked for. A text without whole sentences of prose has no segments; null and empty ones have no language at
    all. The language of a document is that of most letters: see document_languages."""
    reader = Reader(fitted(samples, df.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))))
    codes = reader.classifier.codes
    fields = [("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("confidence", pa.float64()), ("letters", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    kind, one = pa.list_(pa.struct(fields)), pa.struct([("lang", pa.string()), ("confidence", pa.float64())])

    def row(raw: str | None, found: list[tuple[str, int, float]]) -> list[dict]:
        out, at = [], 0
        for k, i, j, p, n in segments(found):
            start, end = offsets(raw, found[i][0], found[j][0], at) if places else (None, None)
            at = end or start or at
            out.append({"lang": codes[k], "first": i, "last": j, "confidence": p, "letters": n, "start": start, "end": end})
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [row(t, found) for t, found in zip(texts, reader.read(texts), strict=True)]
            all_ = [(-1, 0.0) if r or not whole else reader.whole(t) for t, r in zip(texts, rows, strict=True)]
            all_ = [{"lang": codes[k], "confidence": p} if k >= 0 else None for k, p in all_]
            labels = [label_of(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(rows, kind), pa.array(all_, one)], names=[doc_id, "labelled", "segments", "whole"])

    schema = f"{doc_id} {df.schema[doc_id].dataType.simpleString()}, labelled string, segments array<struct<lang: string, first: int, last: int, confidence: double, letters: int, start: int, end: int>>, whole struct<lang: string, confidence: double>"
    return df.select(doc_id, F.col(text).cast("string").alias(text), F.col(lang).cast("string").alias(lang)).mapInArrow(read, schema)


def document_languages(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, labelled, lang (that of most letters of prose or, without prose, of the text as a whole; null: neither), confidence, mixed (whether its prose has several) and has_prose."""
    s = F.expr("transform(array_distinct(transform(segments, s -> s.lang)), l -> struct(aggregate(filter(segments, s -> s.lang = l), 0L, (n, s) -> n + s.letters) AS letters, l AS lang, aggregate(filter(segments, s -> s.lang = l), 0D, (c, s) -> c + s.confidence * s.letters) AS weight))")
    top = F.array_max(s)
    lang, confidence = F.coalesce(top["lang"], F.col("whole.lang")), F.coalesce(top["weight"] / top["letters"], F.col("whole.confidence"))
    return found.select(doc_id, "labelled", lang.alias("lang"), confidence.alias("confidence"), (F.size(s) > 1).alias("mixed"), (F.size("segments") > 0).alias("has_prose"))


def mislabelled(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang of the languages of each document that has several, or one that its label does not name."""
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    case = (F.size(langs) > 1) | ((F.size(langs) == 1) & ~F.coalesce(langs[0] == F.col("labelled"), F.lit(False)))
    return found.where(case).select(doc_id, F.explode(langs).alias("lang"))
