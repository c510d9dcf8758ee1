"""Language of documents and of their sentences by hyperdimensional profiles (problem 10).

Every character has a fixed random vector of +1 and -1. A character n-gram is the product (binding) of its
characters' vectors, each rotated by its place; a text is the sum (bundling) of its n-grams; a language is the sum of
its sample texts. A sentence goes to the language whose prototype has the greatest cosine with it. Each language has
two prototypes, of the text as written and without accents, as documents come both ways.

As bundling is linear, the product of a text with a prototype is the sum over its n-grams of the products of each
n-gram with the prototype; those are kept in a table, so that a batch costs one lookup per n-gram.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.lineage import Cuts

#: Dimension of the vectors; the longest n-gram.
DIMENSION, LONGEST = 2048, 4
#: Weight of n-grams by length; at index 0 that of a letter's block (its code divided by 128).
WEIGHTS = (0.1, 0.5, 1.0, 1.0, 0.8)
#: Marks a block among the codes of n-grams: no n-gram has this private sign in its last place.
BLOCK = np.uint64(0xF8FF << 48)
#: Fewest words (letters where a script has no blanks) of a sentence, after identifiers are taken out.
LEAST_WORDS, LEAST_SIGNS = 3, 6
#: A sentence in another language than its document's main one counts from this lead in cosine on.
LEAD = 0.08
#: Bound on the labelled sentences of each language that prototypes are refined with.
LABELLED_SENTENCES = 600
#: About how many documents, by a hash of the text, are searched for labelled sentences.
LABELLED_DOCUMENTS = 20_000
#: Pieces of text, and sentences with their cosines, that one task keeps.
KEPT = 200_000
#: Factor on cosines where prototypes are corrected.
SHARPNESS = 15.0
#: Rounds of correction, and of the earlier passes, whose prototypes only choose the sentences of the next.
ROUNDS, CHOOSING_ROUNDS = 150, 60
#: Share of its pull from which a sentence counts as confused.
CONFUSED = 0.02

_FENCE = re.compile(r"^[ \t]*(?:>[ \t]*)*(`{3,}|~{3,})", re.M)
_INLINE = re.compile(r"`[^`\n]*`")
_IDENTIFIER = re.compile(r"(?<![^\W\d_])(?:[A-Za-z0-9_$.:\-]*(?:[A-Za-z0-9]_|_[A-Za-z0-9]|[a-z0-9][A-Z]|::|/|[A-Za-z]\.[A-Za-z])[A-Za-z0-9_$/.:\-]*[A-Za-z0-9_$]|https?://\S+)(?:\(\))?")
_QUOTED = re.compile(r"(?<!\w)([\"'“„«‘(])[^\"'“”«»‘’().!?。\n]{1,60}[\"'”“»’)](?!\w)")
_MARK = re.compile(r"^[ \t]*(?:>[ \t]*|[-*+][ \t]+|\d+[.)][ \t]+|#{1,6}[ \t]+|\|)*")
_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?:\s+|$)|(?<=[。！？])[」』）]*")
_TERMINAL = re.compile(r"[.!?…。！？][\"'”’»)\]」』）]*\s*$")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_KEEP = re.compile(r"[^\w\s]|\d|_", re.U)


def prose(text: str) -> Iterator[str]:
    """The lines of a text outside fenced code; a fence without an end runs to the end."""
    fence = ""
    for line in text.splitlines():
        at = _FENCE.match(line)
        if at:
            mark = at.group(1)
            if not fence:
                fence = mark
                continue
            if mark[0] == fence[0] and len(mark) >= len(fence):
                fence = ""
            continue
        if not fence:
            yield line


def _pieces(text: str) -> Iterator[str]:
    """What ends like a sentence or a line, without list marks and identifiers."""
    for line in prose(text):
        line = _MARK.sub("", line)
        if not line.strip():
            continue
        if "`" in line:
            line = _INLINE.sub(" ", line)
        yield from filter(None, _END.split(_IDENTIFIER.sub(" ", line)))


def _whole(piece: str) -> str:
    """The piece as a sentence, or nothing if it is no whole one."""
    if not _TERMINAL.search(piece):
        return ""
    # A quoted phrase inside a sentence tells nothing of the sentence's language.
    bare = _QUOTED.sub(" ", piece)
    piece = bare if len(_WORD.findall(bare)) >= LEAST_WORDS or len(_WIDE.findall(bare)) >= LEAST_SIGNS else piece
    wide = len(_WIDE.findall(piece))
    return piece.strip() if wide >= LEAST_SIGNS or (wide == 0 and len(_WORD.findall(piece)) >= LEAST_WORDS) else ""


def sentences(text: str) -> list[str]:
    """Whole sentences: they end with a full stop or the like, and have some words besides identifiers."""
    return [s for s in map(_whole, _pieces(text)) if s]


class Splitter:
    """Normal sentences of texts; what became of a piece is kept for when it comes again, up to a number of pieces."""

    def __init__(self, most: int = KEPT):
        self._known: dict[str, str] = {}
        self._most = most

    def __call__(self, text: str) -> list[str]:
        known, out = self._known, []
        for piece in _pieces(text):
            found = known.get(piece)
            if found is None:
                if len(known) >= self._most:
                    known.clear()
                found = known[piece] = normal(_whole(piece))
            if found:
                out.append(found)
        return out


def normal(text: str) -> str:
    """Lower case letters and single blanks."""
    text = unicodedata.normalize("NFC", text).lower().replace("’", "'")
    return " ".join(_KEEP.sub(" ", text.replace("'", " ")).split())


def fold(text: str) -> str:
    """Without accents; letters that do not decompose stay."""
    kept = "".join(c for c in unicodedata.normalize("NFD", text) if not ("̀" <= c <= "ͯ"))
    return unicodedata.normalize("NFC", kept)


class Space:
    """The vectors of characters and n-grams; the same in every process."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension
        self._letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            self._letters[code] = np.random.default_rng(1_000_003 + code).choice(np.array([-1, 1], np.int8), self.dimension)
        return self._letters[code]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of n-grams, coded as base 2**16 numbers of characters' codes (characters beyond 2**16 are folded in)."""
        out = np.ones((len(ids), self.dimension), np.int8)
        for place in range(LONGEST):
            codes = (ids >> np.uint64(16 * place)) & np.uint64(0xFFFF)
            for code in np.unique(codes):
                if code:
                    out[codes == code] *= np.roll(self.letter(int(code)), place)
        return out


def gram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of all texts: their codes, the number of their text, and their weights. Texts are padded with blanks."""
    joined = "".join(f"\n {t} " for t in texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes = np.where(raw > 0xFFFF, (raw & 0x7FFF) | 0x8000, raw).astype(np.uint64)
    breaks = raw == 10
    owner = np.cumsum(breaks) - 1
    ids, owners, weights = [], [], []
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        code, bad = np.zeros(m, np.uint64), np.zeros(m, bool)
        for place in range(n):
            code |= codes[place : place + m] << np.uint64(16 * place)
            bad |= breaks[place : place + m]
        if n == 1:
            bad |= code == 32
            # Letters beyond Latin also count as their block, so that unseen signs of a script still tell the script.
            block = ~bad & (raw[:m] > 0x24F)
            ids.append((raw[:m][block].astype(np.uint64) >> np.uint64(7)) | BLOCK)
            owners.append(owner[:m][block])
            weights.append(np.full(len(ids[-1]), WEIGHTS[0], np.float32))
        ids.append(code[~bad])
        owners.append(owner[:m][~bad])
        weights.append(np.full(len(ids[-1]), WEIGHTS[n], np.float32))
    return np.concatenate(ids), np.concatenate(owners), np.concatenate(weights)


def bundle(texts: list[str], space: Space) -> np.ndarray:
    """The sum of the n-gram vectors of the texts."""
    ids, _, weights = gram_ids(texts)
    total = np.zeros(space.dimension, np.float64)
    unique, back = np.unique(ids, return_inverse=True)
    mass = np.bincount(back, weights, len(unique)).astype(np.float32)
    for at in range(0, len(unique), 2048):
        total += mass[at : at + 2048] @ space.grams(unique[at : at + 2048]).astype(np.float32)
    return total


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


class Profiles:
    """Prototypes of languages and the table of products with n-grams."""

    def __init__(self, names: list[str], prototypes: np.ndarray, centred: bool = False, table_limit: int = 400_000):
        """``prototypes``: two rows per language, as written and without accents."""
        self.names, self.raw, self.centred = names, unit(prototypes), centred
        # What all languages share tells nothing: the mean of the prototypes is taken off each.
        self.prototypes = (self.raw if centred else unit(self.raw - self.raw.mean(axis=0))).astype(np.float32)
        self.space, self.limit = Space(prototypes.shape[1]), table_limit
        self._ids, self._table = np.zeros(0, np.uint64), np.zeros((0, len(prototypes)), np.float32)

    def _place(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the table for codes; new ones are added."""
        at = np.searchsorted(self._ids, ids)
        known = at < len(self._ids)
        known[known] = self._ids[at[known]] == ids[known]
        if known.all():
            return at
        new = np.unique(ids[~known])
        if len(self._ids) + len(new) > self.limit:
            kept = np.unique(at[known])
            self._ids, self._table = self._ids[kept], self._table[kept]
        rows = [self.space.grams(new[a : a + 2048]).astype(np.float32) @ self.prototypes.T for a in range(0, len(new), 2048)]
        all_ids, table = np.concatenate([self._ids, new]), np.concatenate([self._table, *rows])
        order = np.argsort(all_ids)
        self._ids, self._table = all_ids[order], table[order]
        return np.searchsorted(self._ids, ids)

    def best(self, rows: np.ndarray) -> np.ndarray:
        """Cosine of unit vectors with every language (the greater of its two prototypes)."""
        out = rows @ self.prototypes.T
        return np.maximum(out[:, 0::2], out[:, 1::2])

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of every text with every language (the greater of its two prototypes)."""
        if not texts:
            return np.zeros((0, len(self.names)), np.float32)
        ids, owners, weights = gram_ids(texts)
        pair = owners.astype(np.int64) * (1 << 32) + self._place(ids)
        order = np.argsort(pair, kind="stable")
        pair, weights = pair[order], weights[order]
        out = np.zeros((len(texts), self._table.shape[1]), np.float32)
        if not len(pair):
            return out[:, 0::2]
        # Each n-gram of a text once, with its mass.
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        mass = np.add.reduceat(weights, first)
        own, gram = pair[first] >> 32, pair[first] & 0xFFFFFFFF
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        here = own[starts]
        out[here] = np.add.reduceat(self._table[gram] * mass[:, None], starts, axis=0)
        # Vectors of different n-grams are orthogonal but for noise, so the squared length is D times that of the counts.
        out[here] /= np.sqrt(np.add.reduceat(mass * mass, starts) * self.space.dimension)[:, None]
        return np.maximum(out[:, 0::2], out[:, 1::2])


class Scores:
    """Cosines of sentences with every language; those of a sentence are kept for when it comes again."""

    def __init__(self, profiles: Profiles, most: int = KEPT):
        self._profiles, self._most = profiles, most
        self._place: dict[str, int] = {}
        self._rows = np.zeros((1024, len(profiles.names)), np.float32)

    def of(self, texts: list[str]) -> np.ndarray:
        """One row a text."""
        new = list(dict.fromkeys(t for t in texts if t not in self._place))
        if len(self._place) + len(new) > self._most:
            self._place.clear()
            new = list(dict.fromkeys(texts))
        start = len(self._place)
        if start + len(new) > len(self._rows):
            self._rows = np.concatenate([self._rows[:start], np.zeros((max(len(new), start), self._rows.shape[1]), np.float32)])
        for at in range(0, len(new), 2048):
            self._rows[start + at : start + at + len(new[at : at + 2048])] = self._profiles.cosines(new[at : at + 2048])
        self._place.update(zip(new, range(start, start + len(new))))
        return self._rows[[self._place[t] for t in texts]]


def label_codes(reference: list[dict]) -> dict[str, str]:
    """Lower-case label to language: the code, ISO code, English and native name of every language."""
    out: dict[str, str] = {}
    for row in reference:
        for key in ("lang", "iso3", "name_en", "name_native"):
            if row.get(key) and str(row[key]).strip():
                out.setdefault(str(row[key]).strip().lower(), row["lang"])
    return out


def label_language(label: str | None, codes: dict[str, str]) -> str | None:
    """The language a label names, without regard to case, outer blanks and what follows the first ``-`` or ``_``."""
    if label is None:
        return None
    whole = label.strip().lower()
    return codes.get(re.split(r"[-_]", whole, maxsplit=1)[0].strip())


def fit_reference(reference: list[dict], dimension: int = DIMENSION) -> Profiles:
    """Prototypes of the sample texts of every language."""
    texts: dict[str, list[str]] = {}
    for row in reference:
        if row.get("lang") and row.get("sample_text"):
            texts.setdefault(row["lang"], []).append(normal(row["sample_text"]))
    names, space = sorted(texts), Space(dimension)
    rows = [f for name in names for f in (bundle(texts[name], space), bundle([fold(t) for t in texts[name]], space))]
    return Profiles(names, np.array(rows).reshape(-1, dimension))


def split_documents(documents: DataFrame, codes: dict[str, str], text: str, label: str) -> DataFrame:
    """``lang, sentences`` of documents whose label names a language and that have a sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = Splitter()
        for batch in batches:
            rows = ((label_language(lab, codes), body) for lab, body in zip(batch["label"], batch["text"]))
            found = ((lang, list(dict.fromkeys(split(body)))) for lang, body in rows if lang is not None)
            yield pd.DataFrame([r for r in found if r[1]], columns=["lang", "sentences"])

    known = documents.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).filter("label is not null and text is not null")
    return known.mapInPandas(run, "lang string, sentences array<string>")


def labelled_sentences(profiles: Profiles, split: DataFrame, per_language: int) -> DataFrame:
    """``lang, sentence``: at most ``per_language`` different sentences, the most frequent first, of documents (from
    ``split_documents``) that as a whole are nearest to the language their label names."""
    names = profiles.names
    start = split.sparkSession.sparkContext.broadcast(profiles.raw)
    centred = profiles.centred

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = Scores(Profiles(names, start.value, centred))
        for batch in batches:
            counts: Counter = Counter()
            for lang, own in zip(batch["lang"], batch["sentences"]):
                own = list(own)
                cos = np.average(here.of(own), axis=0, weights=[len(t) for t in own])
                if names[int(cos.argmax())] == lang:
                    counts.update((lang, t) for t in own)
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "sentence", "n"])

    found = split.mapInPandas(pick, "lang string, sentence string, n int").groupBy("lang", "sentence").agg(F.sum("n").alias("n"))
    # A sentence that occurs under several labels belongs to the one it has most often; documents in several languages
    # would teach the wrong one otherwise.
    best = F.struct("n", F.xxhash64("lang"))
    found = found.groupBy("sentence").agg(F.max_by("lang", best).alias("lang"), F.max("n").alias("n"))
    window = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.xxhash64("sentence"), "sentence")
    return found.withColumn("k", F.row_number().over(window)).filter(F.col("k") <= per_language).select("lang", "sentence")


def vectors(texts: list[str], space: Space) -> np.ndarray:
    """One unit vector per text."""
    out = np.zeros((len(texts), space.dimension), np.float32)
    for at in range(0, len(texts), 256):
        ids, owners, weights = gram_ids(texts[at : at + 256])
        unique, back = np.unique(ids, return_inverse=True)
        mass = np.zeros((len(texts[at : at + 256]), len(unique)), np.float32)
        np.add.at(mass, (owners, back), weights)
        for k in range(0, len(unique), 2048):
            out[at : at + 256] += mass[:, k : k + 2048] @ space.grams(unique[k : k + 2048]).astype(np.float32)
    return unit(out).astype(np.float32)


def retrain(profiles: Profiles, langs: list[str], texts: list[str], rounds: int = ROUNDS, rate: float = 0.4, foreign: float = 0.2) -> Profiles:
    """Prototypes from labelled sentences: bundled, then corrected where a sentence is nearer to a wrong one.

    A correction adds the sentence to its own prototype and takes it off the wrong ones. Sentences that another language
    leads by more than ``foreign`` are taken for foreign ones in a document of several languages and left out.
    """
    if not texts:
        return profiles
    own = np.array([profiles.names.index(x) for x in langs])
    rows = np.concatenate([vectors(texts, profiles.space), vectors([fold(t) for t in texts], profiles.space)])
    at = np.concatenate([2 * own, 2 * own + 1])
    # The samples weigh like a few sentences; they matter where a language has hardly any labelled text.
    many, share = np.arange(len(rows)), 1 / np.bincount(at, minlength=2 * len(profiles.names))[at]
    protos = 0.1 * profiles.raw.astype(np.float64)
    np.add.at(protos, at, rows * share[:, None])
    centre = Profiles(profiles.names, protos).prototypes
    # Corrections, softened: every sentence pulls its own prototype and pushes each other one by how far it is confused
    # with it; languages weigh alike however much text they have.
    weight = share.astype(np.float32)
    some, part = many, rows
    for turn in range(rounds):
        # All sentences are looked at in every tenth round; in between those that are confused, as the others hardly pull.
        whole = turn % 10 == 0 or turn == rounds // 2
        if whole:
            some, part = many, rows
        own = at[some]
        cos = part @ centre.T
        if turn == rounds // 2:
            lead = np.maximum(cos[:, 0::2], cos[:, 1::2]).max(axis=1) - np.maximum(cos[many, at], cos[many, at ^ 1])
            weight = (share * (lead <= foreign)).astype(np.float32)
        logits = SHARPNESS * cos
        line = np.arange(len(some))
        logits[line, own ^ 1] = -np.inf
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pull = -p
        pull[line, own] += 1
        centre = unit(centre + rate / (1 + turn / 20) * ((pull * weight[some, None]).T @ part)).astype(np.float32)
        if whole:
            some = many[(pull[line, own] > CONFUSED) & (weight > 0)]
            part = rows[some]
    return Profiles(profiles.names, centre, centred=True)


def fit(documents: DataFrame, reference: list[dict], text: str = "text", label: str = "lang", per_language: int = LABELLED_SENTENCES, bound: int = LABELLED_DOCUMENTS, passes: int = 2) -> Profiles:
    """Prototypes of the sample texts, refined with a bounded sample of labelled sentences.

    About ``bound`` documents, chosen by a hash of their text, are searched, and at most ``per_language`` sentences a
    language reach the driver. With no labelled document the samples alone serve.
    """
    profiles, codes = fit_reference(reference), label_codes(reference)
    documents = documents.select(F.col(label), F.col(text)).filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    total = documents.count()
    if total > bound:
        documents = documents.filter(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(1_000_000 * bound / total))
    # Split once for both passes.
    split = Cuts(documents.sparkSession, "languages").cut(split_documents(documents, codes, text, label))
    for turn in range(passes):
        rows = labelled_sentences(profiles, split, per_language).collect()
        rows.sort()
        profiles = retrain(profiles if profiles.centred is False else fit_reference(reference), [r["lang"] for r in rows], [r["sentence"] for r in rows], ROUNDS if turn == passes - 1 else CHOOSING_ROUNDS)
    return profiles


def judge(cos: np.ndarray, sizes: np.ndarray, lead: float = LEAD) -> tuple[np.ndarray, int]:
    """Language of every sentence of one document, and the main language.

    The main language has most text among the sentences' nearest languages; a sentence is in another language only if
    that one leads the main language by ``lead``.
    """
    best = cos.argmax(axis=1)
    mass = np.bincount(best, sizes, cos.shape[1])
    main = int(np.argmax(mass))
    lead_of = cos[np.arange(len(best)), best] - cos[:, main]
    return np.where(lead_of >= lead, best, main), main


SEGMENTS = "doc_id bigint, label string, label_lang string, segment int, lang string, confidence double, n_sentences int, n_signs int"


def segments(documents: DataFrame, profiles: Profiles, codes: dict[str, str], text: str = "text", label: str = "lang", ident: str = "doc_id") -> DataFrame:
    """One row per run of sentences in one language: ``doc_id, label, label_lang, segment, lang, confidence, n_sentences, n_signs``.

    ``confidence`` is between 0 and 1: how far the segment's language leads the next one in mean cosine, on a logistic
    scale. Documents without a sentence (null, empty, code or identifiers only) have no row. Repeated documents are
    each judged. Texts of any length are read whole, in one task each; nothing is shuffled.
    """
    names = profiles.names
    start = documents.sparkSession.sparkContext.broadcast(profiles.raw)
    centred = profiles.centred

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, here = Splitter(), Scores(Profiles(names, start.value, centred))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                yield pd.DataFrame(_segments_of(batch.iloc[at : at + 1024], split, here, names, codes), columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    rows = documents.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    return rows.filter(F.col("text").isNotNull()).mapInPandas(run, SEGMENTS)


def _segments_of(batch: pd.DataFrame, split: Splitter, scores: Scores, names: list[str], codes: dict[str, str]) -> list[tuple]:
    texts, counts = [], []
    for body in batch["text"]:
        own = split(body)
        texts += own
        counts.append(len(own))
    cos = scores.of(texts)
    sizes = np.array([len(t) for t in texts], float)
    out, at = [], 0
    for doc, label, n in zip(batch["doc_id"], batch["label"], counts):
        rows, weights = cos[at : at + n], sizes[at : at + n]
        at += n
        if not n:
            continue
        lang, _ = judge(rows, weights)
        edges = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1], True])
        label = None if label is None or label != label else label
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            mean = np.average(rows[a:b], axis=0, weights=weights[a:b])
            top = int(lang[a])
            rest = np.delete(mean, top)
            margin = mean[top] - (rest.max() if len(rest) else 0)
            out.append((doc, label, label_language(label, codes), k, names[top], float(1 / (1 + np.exp(-40 * margin))), int(b - a), int(weights[a:b].sum())))
    return out


def document_issues(parts: DataFrame) -> DataFrame:
    """``doc_id, issue, lang, confidence`` from ``segments``: documents in several languages, and missing or wrong labels."""
    per = parts.groupBy("doc_id", "label_lang", "lang").agg(
        F.sum("n_sentences").alias("n"), (F.sum(F.col("confidence") * F.col("n_signs")) / F.sum("n_signs")).alias("confidence")
    )
    # A document has at most as many rows here as there are languages.
    whole = per.groupBy("doc_id", "label_lang").agg(F.collect_list(F.struct("lang", "confidence")).alias("langs"))
    issue = F.when(F.size("langs") > 1, "mixed").when(F.col("label_lang").isNull(), "missing").when(F.col("label_lang") != F.col("langs")[0]["lang"], "wrong")
    return whole.withColumn("issue", issue).filter("issue is not null").select("doc_id", "issue", F.explode("langs").alias("x")).select("doc_id", "issue", "x.lang", "x.confidence")
