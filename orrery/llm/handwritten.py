"""Files that nobody here wrote by hand (problem 7): a linear support-vector classifier.

Features are hashed character n-grams of the text without its opening comments (where generators and copies give
themselves away), path components, what the repository's ignore list says of the path, the shape of the lines and
statements. Labels come from what is masked: the openings, texts that also stand in another repository, and shapes that
no hand writes; the classifier carries them over to files without such marks. Repositories, not files, are split into
training and validation. The margin alone finds files; an exact check behind it only takes back those whose opening says
that own hands keep them, or which the repository takes back from its ignore list.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.globs import ignore_rules, ignored_by
from orrery.lineage import Cuts

#: Buckets of character n-grams and of all other features; length of the n-grams.
TEXT_BUCKETS, OTHER_BUCKETS, GRAM = 1 << 14, 1 << 12, 4
#: Bounds on the labelled files of each class the classifier is fitted with, and on the bytes of their features.
LABELLED_FILES, LABELLED_BYTES = 2200, 48_000_000
#: Bytes of one feature on its way to the driver.
FEATURE_BYTES = 6
#: A body shorter than this tells nothing by being repeated.
LEAST_BODY = 200

# How openings of files name a generator, a foreign project, or own hands.
GENERATED = re.compile(
    r"code generated (?:by|from)\b[^\n]*|@generated\b|<auto-?generated>|auto-?generated (?:file|code|by|from)|automatically (?:created|generated|produced)|this (?:file|code|module) (?:was|is) (?:auto-?)?(?:automatically )?(?:produced|generated|created)"
    r"|^\W*generated (?:by|from|with)\b|(?:manual|hand) (?:edits|changes) (?:are|will be) (?:lost|overwritten)|changes (?:are|will be) (?:lost|overwritten)|do not (?:edit|modify)(?: this file| manually| by hand|[.!]?\s*$)",
    re.I | re.M,
)
FOREIGN = re.compile(
    r"^\W*@?[\w./-]+@v?\d+\.\d+|^\W*upstream:|imported unmodified|\(c\)[^\n]*\bcontributors\b|^\s*/\*!\s*\S+ v?\d+\.\d|^\W*[\w.-]+ v?\d+\.\d+\.\d+ [-|(]|\bvendored from\b|\bcopied (?:verbatim |unmodified )?from\b|permission is (?:hereby )?granted",
    re.I | re.M,
)
OWN = re.compile(r"\b(?:we (?:now )?(?:write|wrote|maintain)|written by hand|hand-?written|owned by|maintained by (?:us|the)|ask before|kept by hand)\b", re.I)

_SPACE_BLOCK = re.compile(r"\s*/\*.*?\*/[ \t]*(?:\n|$)", re.S)
_LINE = re.compile(r"[ \t]*(?:(?://|#)[^\n]*)?(?:\n|$)")


def opening_end(text: str) -> int:
    """Where the comments and blank lines a file opens with end."""
    at, size = 0, len(text)
    while at < size:
        m = _LINE.match(text, at)
        if m and m.end() > at and not text.startswith("#[", at) and not text.startswith("#!", at):
            at = m.end()
            continue
        m = _SPACE_BLOCK.match(text, at)
        if not m:
            break
        at = m.end()
    return at


def opening_kind(opening: str) -> str:
    """``generated``, ``foreign``, ``own`` or empty."""
    return "generated" if GENERATED.search(opening) else "foreign" if FOREIGN.search(opening) else "own" if OWN.search(opening) else ""


_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NUMBER = re.compile(r"-?\b(?:0[xX][\da-fA-F]+|\d[\d_.]*)\b,?")
_STATEMENT = re.compile(r"\b(?:def|func|fn|function|return|if|for|while|switch|match|class|struct|interface|try|raise|throw|import|use)\b")


def shape(body: str) -> tuple[str, list[str]]:
    """A kind no hand writes (``minified``, ``data`` or empty) and coarse features of the lines.

    Minified: hardly any blanks, many marks and long lines. Data: mostly literals, with hardly a statement around them;
    code that holds one long literal is no data.
    """
    size = max(1, len(body))
    lines = body.count("\n") + 1
    longest = max(map(len, body.split("\n")))
    blanks = sum(body.count(c) for c in " \t\n") / size
    digits = sum(body.count(c) for c in "0123456789") / size
    marks = sum(body.count(c) for c in "(){}[];,=+?:&|!<>") / size
    bare = _STRING.sub("", body)
    literal = (size - len(_NUMBER.sub("", bare)) - 2 * body.count('""')) / size
    statements = len(_STATEMENT.findall(bare))
    kind = ""
    if size >= 400:
        if blanks < 0.09 and marks > 0.15 and longest > 200 and statements:
            kind = "minified"
        elif literal > 0.45 and statements <= 2:
            kind = "data"
    tokens = [
        f"blanks:{int(blanks * 20)}", f"digits:{int(digits * 20)}", f"marks:{int(marks * 20)}", f"literal:{int(literal * 5)}",
        f"mean:{len(bin(size // lines)) - 2}", f"statements:{min(12, int(20 * statements / lines))}",
    ]
    return kind, tokens


def path_tokens(path: str) -> list[str]:
    """Components of a path below the repository, their neighbours, and the parts of the file's name."""
    parts = path.split("/")[1:]
    out = [f"dir:{p.lower()}" for p in parts[:-1]] + [f"under:{a.lower()}/{b.lower()}" for a, b in zip(parts, parts[1:-1])]
    if parts:
        name = parts[-1].lower()
        bits = name.split(".")
        out += [f"bit:{x}" for x in bits[1:]] + [f"ext:{'.'.join(bits[1:])}", f"ends:{re.split('[_-]', bits[0])[-1]}", f"last2:{'_'.join(re.split('[_-]', bits[0])[-2:])}"]
        out += [f"name:{bits[0]}"] if len(parts) > 1 and bits[0] in ("index", "main", parts[-2].lower()) else []
        out += ["name:directory"] if len(parts) > 1 and bits[0] == parts[-2].lower() else []
    return out


@lru_cache(maxsize=4096)
def _rules(lines: tuple[str, ...]):
    return ignore_rules(lines)


def ignore_tokens(path: str, lines: tuple[str, ...]) -> list[str]:
    """What the ignore list says of the path: the words of the remark over the rule, or that the rule takes back."""
    rule = ignored_by(_rules(lines), path.partition("/")[2])
    if rule is None:
        return ["ignored:no"]
    if rule.negated:
        return ["ignored:taken back"]
    return [f"remark:{w}" for w in re.findall(r"\w+", rule.remark)] or ["ignored:plain"]


def bucket(token: str) -> int:
    """The bucket of a feature other than n-grams."""
    return TEXT_BUCKETS + int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "little") % OTHER_BUCKETS


_bucket = lru_cache(maxsize=200_000)(bucket)


def text_features(body: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of the n-grams of a whole body: damped counts, of length one altogether."""
    raw = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
    if len(raw) < GRAM:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    # Digits count as one digit: which number it is tells nothing.
    raw = np.where((raw >= 48) & (raw <= 57), 48, raw).astype(np.uint32)
    n = len(raw) - GRAM + 1
    code = raw[:n].copy()
    for k in range(1, GRAM):
        code = code * np.uint32(0x01000193) ^ raw[k : k + n] * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    counts = np.bincount(code % np.uint32(TEXT_BUCKETS), minlength=TEXT_BUCKETS)
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]).astype(np.float32)
    return at.astype(np.int32), value / np.linalg.norm(value)


def features(body: str, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All features of a file."""
    at, value = text_features(body)
    other = np.array([_bucket(t) for t in tokens], np.int32)
    return np.concatenate([at, other]), np.concatenate([value, np.full(len(other), OTHER_WEIGHT, np.float32)])


#: Value of a feature other than n-grams, whose values have length one together.
OTHER_WEIGHT = 0.35


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, penalty: float = 1e-3, steps: int = 80, tolerance: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear support-vector classifier: squared hinge loss, classes weighted alike.

    Quasi-Newton steps of limited memory, until the gradient is ``tolerance`` of the first one or ``steps`` are made.
    """
    size = TEXT_BUCKETS + OTHER_BUCKETS + 1
    lengths = np.array([len(a) + 1 for a, _ in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.concatenate([np.append(a, size - 1) for a, _ in rows]).astype(np.int32)
    value = np.concatenate([np.append(v, 1) for _, v in rows]).astype(np.float32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    sign = np.where(labels, 1.0, -1.0)
    share = np.where(labels, 0.5 / max(1, labels.sum()), 0.5 / max(1, (~labels).sum()))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        slack = np.maximum(0, 1 - sign * np.add.reduceat(value * w.astype(np.float32)[at], starts))
        pull = (-2 * share * sign * slack).astype(np.float32)
        # Rows beyond the margin pull nothing.
        held = np.flatnonzero(slack > 0)
        if 2 * len(held) < len(rows):
            where = np.concatenate([np.arange(starts[r], starts[r] + lengths[r]) for r in held] or [np.zeros(0, int)])
            grad = np.bincount(at[where], value[where] * pull[owner[where]], size)
        else:
            grad = np.bincount(at, value * pull[owner], size)
        return float(share @ slack**2 + penalty / 2 * (w @ w)), grad + penalty * w

    w = np.zeros(size)
    now, grad = loss(w)
    first, pairs = np.linalg.norm(grad), []
    for _ in range(steps):
        if np.linalg.norm(grad) <= tolerance * first:
            break
        step, kept = grad.copy(), []
        for s, y, rho in reversed(pairs):
            kept.append(rho * (s @ step))
            step -= kept[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            step *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(kept)):
            step += (a - rho * (y @ step)) * s
        slope, length = grad @ step, 1.0
        for _ in range(30):
            new = w - length * step
            then, fresh = loss(new)
            if then <= now - 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, y = new - w, fresh - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-10:]
        w, now, grad = new, then, fresh
    return w


SIGNALS = "file_path string, repo string, kind string, shape string, ignored string, body_hash string, body_size int, suspect boolean, tokens array<string>, body string"
_SUSPECT = re.compile(r"(?i)(?:^|/)(?:vendor\w*|third[-_]?party|node_modules|_vendor|godeps|external|deps|gen|generated|__generated__|autogen|dist|bundles?)(?:/|$)|\.(?:min|gen|g|pb|generated)\.|_pb2|_generated|_gen\.")


def signals(files: DataFrame) -> DataFrame:
    """What labels are made from, all features but n-grams, and the body, of each of ``file_path, repo, text, ignore_extra``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, repo, text, lines in zip(batch["file_path"], batch["repo"], batch["text"], batch["ignore_extra"]):
                text = plain(text)
                end = opening_end(text)
                body = text[end:].strip()
                kind, shapes = shape(body)
                ignored = ignore_tokens(path, tuple(lines) if lines is not None else ())
                flat = "".join(body.split()).encode("utf-8", "replace")
                tokens = path_tokens(path) + ignored + shapes
                suspect = bool(_SUSPECT.search(path.partition("/")[2]))
                out.append((path, repo, opening_kind(text[:end]), kind, ignored[0], hashlib.blake2b(flat, digest_size=12).hexdigest(), len(body), suspect, tokens, body))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGNALS.split(", ")])

    return files.mapInPandas(run, SIGNALS)


def plain(text: str | None) -> str:
    """Without byte order mark and carriage returns."""
    text = text or ""
    return (text[1:] if text.startswith("﻿") else text).replace("\r\n", "\n")


VERDICTS = "file_path string, repo string, score double, foreign boolean, reason string"


def _labelled(marks: DataFrame, labelled: int) -> list[tuple[int, bool]]:
    """Hash of the path and label of the files to be fitted with: of each class those with the smallest hashes, at most
    ``labelled``, and no more than ``LABELLED_BYTES`` of features together."""
    marks = marks.drop("body")
    # Copies: one row a body, pre-aggregated.
    groups = marks.filter(F.col("body_size") >= LEAST_BODY).groupBy("body_hash").agg(F.min("repo").alias("least"), F.max("repo").alias("most"))
    copied = groups.filter(F.col("least") != F.col("most")).select("body_hash", F.lit(True).alias("copied"))
    marks = marks.join(copied, "body_hash", "left").fillna(False, ["copied"])
    foreign = (F.col("kind").isin("generated", "foreign")) | F.col("copied") | (F.col("shape") != "")
    own = (F.col("kind") == "own") | (F.col("kind") == "") & ~F.col("suspect") & (F.col("ignored").isin("ignored:no", "ignored:plain", "ignored:taken back"))
    own = own | (F.col("ignored") == "ignored:taken back") & (F.col("kind") == "")
    marks = marks.withColumn("label", F.when(foreign & (F.col("kind") != "own"), True).when(own, False)).filter("label is not null")
    key = F.xxhash64("file_path").alias("key")
    weight = (F.least(F.col("body_size"), F.lit(TEXT_BUCKETS)) + F.size("tokens")) * FEATURE_BYTES
    parts = [marks.filter(F.col("label") == x).select(key, "label", weight.alias("bytes")).orderBy("key").limit(labelled) for x in (True, False)]
    out, used = [], {True: 0, False: 0}
    for row in parts[0].unionByName(parts[1]).orderBy("key").collect():
        used[row["label"]] += row["bytes"]
        if used[row["label"]] <= LABELLED_BYTES:
            out.append((row["key"], row["label"]))
    return out


def train(marks: DataFrame, labelled: int = LABELLED_FILES) -> tuple[np.ndarray | None, dict]:
    """Weights fitted on the labelled files of ``marks`` (from ``signals``), None where a class has none, and the report of
    the validation: a quarter of the repositories is held out of a trial fitted in the same way."""
    spark = marks.sparkSession
    # At most 2 * ``labelled`` hashes of eight bytes.
    wanted = spark.sparkContext.broadcast(dict(_labelled(marks, labelled)))

    def vectorise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, repo, body, tokens in zip(*(batch[c] for c in ("key", "repo", "body", "tokens"))):
                if key in wanted.value:
                    a, v = features(body, list(tokens))
                    out.append((repo, wanted.value[key], a.astype(np.uint16).tobytes(), v.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["repo", "label", "at", "value"])

    sample = marks.select(F.xxhash64("file_path").alias("key"), "repo", "body", "tokens").mapInPandas(vectorise, "repo string, label boolean, at binary, value binary").collect()
    sample.sort(key=lambda r: (r["repo"] or "", r["label"], bytes(r["at"])))
    labels = np.array([r["label"] for r in sample], bool)
    report = {"labelled": len(sample), "foreign": int(labels.sum()), "held_out": 0, "accuracy": None, "false_alarms": 0, "missed": 0}
    if not len(sample) or labels.all() or not labels.any():
        return None, report
    rows = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["value"], np.float32)) for r in sample]
    held = np.array([int(hashlib.blake2b((r["repo"] or "").encode(), digest_size=2).hexdigest(), 16) % 4 == 0 for r in sample])
    if held.any() and not held.all() and labels[~held].any() and not labels[~held].all():
        trial = fit([x for x, h in zip(rows, held) if not h], labels[~held])
        said = np.array([score(trial, a, v) > 0 for (a, v), h in zip(rows, held) if h])
        report |= {"held_out": int(held.sum()), "accuracy": float((said == labels[held]).mean()), "false_alarms": int((said & ~labels[held]).sum()), "missed": int((~said & labels[held]).sum())}
    return fit(rows, labels), report


def read(files: DataFrame) -> DataFrame:
    """``signals`` of the files with a path, written once: all later passes read this table."""
    return Cuts(files.sparkSession, "handwritten").cut(signals(files.select("file_path", "repo", "text", "ignore_extra").filter("file_path is not null")))


def judge(files: DataFrame, labelled: int = LABELLED_FILES) -> tuple[DataFrame, dict]:
    """``file_path, repo, score, foreign, reason`` of every file, and what validation found.

    ``files``: current versions ``file_path, repo, text`` and ``ignore_extra array<string>`` (may be null). A null text
    counts as empty; empty and nearly empty files are hand-written unless path and list say otherwise. Paths must be
    unique. With no labelled file of one class nothing is found. A file is found if its margin is above 0 and no exact
    sign of own hands takes it back; ``reason`` names the sign that goes with the verdict.

    Scale: the texts are shuffled once (to find current versions) by the caller, written once with their signals, and
    read twice: for the sample and for the margins. Copies are found by a hash of the body, pre-aggregated. Of each class
    at most ``labelled`` files and ``LABELLED_BYTES`` of sparse features reach the driver; the weights, a fixed number,
    are broadcast.
    """
    spark = files.sparkSession
    marks = read(files)
    fitted, report = train(marks, labelled)
    if fitted is None:
        return spark.createDataFrame([], VERDICTS), report
    weights = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, repo, body, kind, own_shape, ignored, tokens in zip(*(batch[c] for c in ("file_path", "repo", "body", "kind", "shape", "ignored", "tokens"))):
                s = score(weights.value, *features(body, list(tokens)))
                own = kind == "own" or ignored == "ignored:taken back" and kind == ""
                verdict = s > 0 and not own
                out.append((path, repo, float(s), verdict, (kind or own_shape or "classifier") if verdict else kind if own else ""))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICTS.split(", ")])

    return marks.select("file_path", "repo", "body", "kind", "shape", "ignored", "tokens").mapInPandas(run, VERDICTS), report


def score(weights: np.ndarray, at: np.ndarray, value: np.ndarray) -> float:
    """The margin of one file."""
    return float(weights[at] @ value + weights[-1])
