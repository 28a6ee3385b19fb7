"""Toxicity scores: gradient-boosted trees over dense features of the text, with isotonic calibration.

Features are densities of two lexicons (plain and after undoing look-alike characters), lexicon words near a second-person
word, capitals, exclamation and other marks, obfuscated and spelled-out words. They are counted on the bytes of whole texts
in numpy batches. One lexicon is a fixed list. The other is learned: words, and beginnings of words, that toxic rows of the
sample hold more often than the others, weighted by the lower bound of their log-odds (`SURE` standard errors). A row that
the trees are fitted on is described by the lexicon learned from the half of the sample that it is not in.

Lexicon, trees and calibration learn from at most `most` labelled ids (a bounded sample in the order of a hash of the id;
rows whose crc32(id) mod 5 is 0 are never taken), a quarter of which only calibrates. The learned lexicon has at most TERMS
terms, chosen among the CANDIDATES terms that most toxic rows hold. All documents are scored.

Defined results: null and empty texts get the score of a text without any word. Very long texts are read whole, one at a time.
Labels that are null are left out; of several for one id the largest counts. Where several rows share a labelled id, the one
with the smallest features is learned from. A null id counts as the empty text, and so is held out. Equal margins get equal
scores. Without any label all scores are 0.5. An empty table gives no rows. Repeated rows each get their row; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import forget
from .boosting import Boosted, Isotonic
from .common import Rolling, lists, mix, signed, stored, text_chunks, text_of, word_spans
from .quality_rules import LOWER, NOT_LETTER, _hash, per_text

#: The classifier's sample of labelled rows.
MOST = 40_000
# fixed values: insults and slurs of general use, by language
INSULTS = {
    "de": "arschloch idiot dumm dummkopf trottel abschaum dreck ekelhaft erbärmlich wertlos versager depp vollidiot hirnlos lächerlich schwachkopf widerlich",
    "en": "asshole bastard bitch clown coward creep crap cretin damn disgusting dumb dumbass failure filth filthy fool freak garbage hate hateful hell idiot idiots idiotic imbecile jerk liar loser losers lunatic moron morons moronic pathetic pig psycho retard rotten scum scumbag shame shit shut sick stupid suck sucks terrible trash ugly useless vermin vile weirdo worthless wretched",
    "es": "idiota imbécil estúpido estúpida basura asqueroso asquerosa patético patética inútil perdedor escoria payaso tonto tonta maldito cobarde cerdo mierda",
    "fr": "idiot idiote imbécile stupide ordure déchet dégoûtant pathétique minable inutile perdant raclure clown crétin connard salaud merde ridicule lâche",
}
# fixed values: second-person words
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine euch ihr sie tu te ti tus vous toi ton votre tes usted ustedes vos"
NEAR = 4
FEATURES = 20
#: Bytes of the beginnings of words that are terms; bounds of the learned lexicon; standard errors and least weights of its terms.
BEGINNINGS, TERMS, CANDIDATES = (4, 5, 6, 7), 4096, 100_000
SURE, WEAK, STRONG = 3.0, 0.5, 1.5
#: A term that fewer rows hold cannot reach WEAK.
LEAST_ROWS = 7
LOOKALIKE = LOWER.copy()
for _from, _to in zip(b"013457@$!|", b"oieastasil", strict=True):
    LOOKALIKE[_from] = _to
NOT_LOOKALIKE = NOT_LETTER.copy()
NOT_LOOKALIKE[list(b"013457@$|!*")] = False


class Lexicon:
    """Hashed terms and their weights, with a bitmap that settles most lookups."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights = terms[order], weights[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `hashes` are terms, and which terms they are."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at):
            return at, at
        term = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[term] == hashes[at]
        return at[same], term[same]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        out[self.places(hashes)[0]] = True
        return out


NO_TERMS = Lexicon(np.zeros(0, np.uint64), np.zeros(0))


@cache
def fixed_lexicons() -> tuple[Lexicon, Lexicon]:
    """Insults and second-person words."""
    insults, persons = (np.unique(_hash(w)) for w in (sorted({w for x in INSULTS.values() for w in x.split()}), SECOND_PERSON.split()))
    return Lexicon(insults, np.ones(len(insults))), Lexicon(persons, np.ones(len(persons)))


def word_terms(low: Rolling, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes): the whole words, then their beginnings where they are longer."""
    yield np.arange(len(starts)), low.ranges(starts, ends)
    for k in BEGINNINGS:
        at = np.flatnonzero(ends - starts > k)
        yield at, mix(low.ranges(starts[at], starts[at] + k) + np.uint64(k))


def features(data: np.ndarray, offsets: np.ndarray, learned: Lexicon) -> np.ndarray:
    """One row of dense features for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(data):
        return out
    insults, persons = fixed_lexicons()
    starts, ends, owner = word_spans(data, offsets, NOT_LETTER)
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    low = Rolling(LOWER[data])
    weight, person, insult = np.zeros(len(starts)), np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    for k, (at, hashes) in enumerate(word_terms(low, starts, ends)):
        if k == 0:
            insult, person = insults.has(hashes), persons.has(hashes)
        found, term = learned.places(hashes)
        np.maximum.at(weight, at[found], learned.weights[term])
    out[:, 16] = np.bincount(owner, weight, n)
    out[:, 17] = 1000 * out[:, 16] / words
    np.maximum.at(out[:, 18], owner, weight)
    out[:, 19] = 1000 * np.bincount(owner[weight >= STRONG], minlength=n) / words
    insult |= weight >= STRONG
    n_insult = np.bincount(owner[insult], minlength=n)
    out[:, 0] = n_insult
    out[:, 1] = 1000 * n_insult / words
    # insults with a second-person word up to NEAR words away in the same text
    at = np.flatnonzero(person)
    place = np.flatnonzero(insult)
    if len(at) and len(place):
        i = np.searchsorted(at, place)
        close = np.zeros(len(place), bool)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(at) - 1)):
            close |= (np.abs(at[j] - place) <= NEAR) & (owner[at[j]] == owner[place])
        out[:, 2] = np.bincount(owner[place[close]], minlength=n)
    out[:, 3] = 1000 * np.bincount(owner[person], minlength=n) / words
    # look-alike characters undone
    s2, e2, o2 = word_spans(data, offsets, NOT_LOOKALIKE)
    if len(s2):
        shown, meant = low.ranges(s2, e2), Rolling(LOOKALIKE[data]).ranges(s2, e2)
        plain, undone = (insults.has(h) | learned.has(h) for h in (shown, meant))
        out[:, 4] = np.bincount(o2[undone & ~plain], minlength=n)
        odd = per_range(np.isin(data, np.frombuffer(b"013457@$|*", np.uint8)), s2, e2)
        letters = per_range(~NOT_LETTER[data], s2, e2)
        inner = (odd > 0) & (letters >= 2) & (e2 - s2 <= 24) & ~NOT_LETTER[data[np.maximum(e2 - 1, 0)]]
        out[:, 5] = 1000 * np.bincount(o2[inner], minlength=n) / words
    upper = (data >= 0x41) & (data <= 0x5A)
    letter = np.maximum(per_text(~NOT_LETTER[data], offsets), 1)
    out[:, 6] = per_text(upper, offsets) / letter
    if len(starts):
        shout = (per_range(upper, starts, ends) == ends - starts) & (ends - starts >= 3)
        out[:, 7] = 1000 * np.bincount(owner[shout], minlength=n) / words
        out[:, 8] = np.bincount(owner[shout & insult], minlength=n)
        single = ends - starts == 1
        spelled = single[:-2] & single[1:-1] & single[2:] & (owner[:-2] == owner[2:]) if len(single) > 2 else np.zeros(0, bool)
        out[:, 9] = 1000 * np.bincount(owner[:-2][spelled], minlength=n) / words if len(spelled) else 0
    size = np.maximum(np.diff(offsets), 1)
    out[:, 10] = 1000 * per_text(data == 0x21, offsets) / size
    out[:, 11] = 1000 * per_text(data == 0x3F, offsets) / size
    out[:, 12] = 1000 * per_text((data > 0x20) & (data < 0x7F) & NOT_LETTER[data], offsets) / size
    runs = np.zeros(len(data), bool)
    runs[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & ~NOT_LETTER[data[2:]]
    out[:, 13] = 1000 * per_text(runs, offsets) / size
    out[:, 14] = np.log1p(np.bincount(owner, minlength=n))
    # most insults in any ten words that follow each other
    if len(place):
        dense = np.concatenate([[False, False], (place[2:] - place[:-2] <= 30) & (owner[place[2:]] == owner[place[:-2]])]) if len(place) > 2 else np.zeros(len(place), bool)
        out[:, 15] = np.bincount(owner[place[dense]], minlength=n)
    return out


def per_range(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def sampled_labels(labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most `most` labelled ids that may be learned from, in the order of a hash."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(target).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def term_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of each text's distinct terms."""
    starts, ends, owner = word_spans(data, offsets, NOT_LETTER)
    if not len(starts):
        return owner, np.zeros(0, np.uint64)
    at, hashes = map(np.concatenate, zip(*word_terms(Rolling(LOWER[data]), starts, ends), strict=True))
    text = owner[at]
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def weighed(terms: np.ndarray, rows: np.ndarray, totals: np.ndarray) -> Lexicon:
    """The lexicon of terms with their numbers of (other, toxic) rows."""
    (other, toxic), (all_other, all_toxic) = rows.T + 0.5, totals + 1.0
    weight = np.log(toxic / all_toxic) - np.log(other / all_other) - SURE * np.sqrt(1 / toxic + 1 / other)
    best = np.lexsort((terms, -weight))[:TERMS]
    best = best[weight[best] >= WEAK]
    return Lexicon(terms[best], weight[best]) if totals.min() > 0 else NO_TERMS


def learned_lexicons(sample: DataFrame) -> list[Lexicon]:
    """sample(y, fold, text) -> the lexicons learned from fold 1, from fold 0 and from both."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch["text"]):
                terms, rows = np.unique(term_rows(data, offsets)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(rows)], names=["term", "n"])

    listed = sample.where("y = 1").select("text").mapInArrow(seen, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "term").limit(CANDIDATES).select("term")
    terms = np.sort(np.array([r[0] for r in listed.collect()], np.int64).view(np.uint64))
    totals = np.zeros((2, 2))
    for fold, y, n in sample.groupBy("fold", "y").count().collect():
        totals[fold, y] = n
    if not len(terms):
        return [NO_TERMS] * 3
    shared = sample.sparkSession.sparkContext.broadcast(Lexicon(terms, np.zeros(len(terms))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = shared.value, None
        for batch in batches:
            kind = batch["fold"].to_numpy() * 2 + batch["y"].to_numpy()
            for lo, _, data, offsets in text_chunks(batch["text"]):
                text, hashes = term_rows(data, offsets)
                at, term = known.places(hashes)
                add = np.bincount(kind[lo + text[at]] * len(terms) + term, minlength=4 * len(terms))
                sums = add if sums is None else sums + add
        if sums is not None:
            cell = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[cell])], names=["cell", "n"])

    rows = np.zeros(4 * len(terms))
    for cell, n in sample.select("fold", "y", "text").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        rows[cell] = n
    rows = rows.reshape(2, 2, -1).transpose(0, 2, 1)
    return [weighed(terms, rows[1], totals[1]), weighed(terms, rows[0], totals[0]), weighed(terms, rows.sum(axis=0), totals.sum(axis=0))]


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = MOST) -> tuple[Boosted, Isotonic, Lexicon]:
    # bounded by `most` ids; the texts are read three times
    labelled = F.broadcast(sampled_labels(labels, target, most))
    sample = docs.select("doc_id", text_of().alias("text")).join(labelled, "doc_id")
    sample = stored(sample.select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold"), "text"), "labelled")
    lexicons = learned_lexicons(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold in (0, 1):
                part = batch.filter(pc.equal(batch["fold"], fold))
                for lo, hi, data, offsets in text_chunks(part["text"]):
                    x = features(data, offsets, shared.value[fold])
                    yield pa.RecordBatch.from_arrays([*(part[c].slice(lo, hi - lo) for c in ("doc_id", "y")), lists(x.ravel(), np.full(len(x), FEATURES), pa.float64())], names=["doc_id", "y", "f"])

    # what comes back is a short row for each sampled id
    kind = dict(docs.dtypes)["doc_id"]
    rows = sample.mapInArrow(run, f"doc_id {kind}, y int, f array<double>").groupBy("doc_id").agg(F.min("y"), F.min("f")).select("min(y)", "min(f)").collect()
    forget(sample)
    x = np.array([r[1] for r in rows]).reshape(-1, FEATURES)
    y = np.array([r[0] for r in rows], float)
    order = np.lexsort((*x.T[::-1], y))  # the order of rows does not matter to the model
    x, y = x[order], y[order]
    part = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~part])) < 2:
        model = Boosted(rounds=0).fit(x[:0], y[:0])
        return model, Isotonic().fit(np.zeros(len(y)), y), NO_TERMS
    model = Boosted().fit(x[~part], y[~part])
    return model, Isotonic().fit(model.margin(x[part]), y[part]), lexicons[2]


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most=most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, calibrated, learned = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                score = calibrated(model.margin(features(data, offsets, learned)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["held_out"].slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
