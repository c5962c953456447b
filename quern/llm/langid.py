"""Languages of documents and of their lines, by a bidirectional recurrent network over bytes.

The network is trained on a bounded sample of the rows whose label names a language, then labels every
byte of every text. What a document's positions say is pooled over its lines, and a line stands out
where most of its characters are in another language than most of the document's.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bigru import PAD, BiGRU

#: Further codes and names of languages, beside those that the Java runtime lists for each two-letter code.
OTHER_CODES = {"alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de", "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy", "nb": "no", "nn": "no", "nob": "no", "nno": "no", "castilian": "es", "flemish": "nl"}

#: Rows of each language that the network is trained on, at most; one window of WINDOW characters is cut from each of PARTS places of a row.
ROWS, PARTS, WINDOW = 1000, 4, 240
HIDDEN, STEPS, BATCH, LENGTH, RATE, ROUNDS = 24, 750, 256, 32, 0.05, 3
#: Bytes labelled together, the neighbourhood that each piece sees on either side, and pieces in step.
PIECE, AROUND, PIECES = 224, 16, 1024
#: Lines below this many characters are never reported.
LEAST_LINE = 20


def spellings() -> dict[str, str]:
    """The two-letter code of every spelling: codes, three-letter codes and English names, in lower case, as the session's Java runtime knows them."""
    java = SparkSession.active().sparkContext._jvm.java.util.Locale
    out: dict[str, str] = {}
    for code in map(str, java.getISOLanguages()):
        if len(code) == 2:
            locale = java.forLanguageTag(code)
            for text in (code, str(locale.getISO3Language()), str(locale.getDisplayLanguage(java.ENGLISH)).lower()):
                out.setdefault(text, code)
    return out | OTHER_CODES


def language_code(label: Column) -> Column:
    """The two-letter code that a label names: as code, with region, as three letters or as English name, of any language; else null."""
    own = F.lower(F.trim(label))
    base = F.when(own.rlike(r"^[a-z]{2,3}([-_].*)?$"), F.regexp_extract(own, r"^[a-z]+", 0)).otherwise(own)
    names = F.create_map(*[F.lit(x) for pair in sorted(spellings().items()) for x in pair])
    return F.try_element_at(names, base)


def training_rows(documents: DataFrame, text: str = "text", label: str = "lang", rows: int = ROWS) -> pd.DataFrame:
    """(code, part) windows of a bounded sample of labelled rows: about `rows` rows of each language, chosen by a hash of the text.

    Every language that a label names is learnt, however rare; one with `rows` rows or less gives all of them.
    A row gives PARTS windows at places spread over the whole text. The driver gets at most about
    1.5 x rows x languages x PARTS windows of 240 characters.
    """
    named = documents.select(language_code(F.col(label)).alias("code"), F.col(text).alias("text")).filter("code is not null and length(text) > 0")
    counts = {r["code"]: r["count"] for r in named.groupBy("code").count().collect()}  # a row for each language
    if not counts:
        return pd.DataFrame({"code": [], "part": []})
    share = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, min(1.0, rows / n))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = named.filter(chance < F.coalesce(F.try_element_at(share, F.col("code")), F.lit(0.0)))
    start = lambda k: F.greatest(F.lit(0), F.length("text") - WINDOW) * k / max(1, PARTS - 1)
    parts = F.array(*[F.substring("text", (start(k) + 1).cast("int"), F.lit(WINDOW)) for k in range(PARTS)])
    return chosen.select("code", F.explode(F.array_distinct(parts)).alias("part")).orderBy("code", "part").toPandas()


def _varied(text: str, rng: np.random.Generator) -> str:
    """At times the spellings that texts come in: capitals, lost accents, decomposed accents."""
    kind = rng.integers(12)
    if kind == 0:
        return text.upper()
    if kind == 1:
        return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    if kind == 2:
        return unicodedata.normalize("NFD", text)
    if kind == 3:
        return "".join(c for c in unicodedata.normalize("NFD", text.upper()) if not unicodedata.combining(c))
    return text


def _windows(texts: list[bytes], rng: np.random.Generator) -> np.ndarray:
    out = np.full((len(texts), LENGTH), PAD, np.int32)
    for i, t in enumerate(texts):
        at = int(rng.integers(max(1, len(t) - LENGTH + 1)))
        piece = np.frombuffer(t, np.uint8)[at : at + LENGTH]
        out[i, : len(piece)] = piece
    return out.T.copy()


def _draws(parts: list[list[bytes]], rng: np.random.Generator):
    """Batches with each language as often as the others, in windows of LENGTH bytes; parts of two windows are joined at times, mostly by a line feed, so that changes of language are learnt."""

    def draw(_: int) -> tuple[np.ndarray, np.ndarray]:
        of = rng.integers(len(parts), size=BATCH)
        texts = [parts[c][int(rng.integers(len(parts[c])))] for c in of]
        symbols = _windows(texts, rng)
        labels = np.where(symbols == PAD, -1, of[None, :])
        mixed = np.flatnonzero(rng.random(BATCH) < 0.25)
        other = rng.permutation(mixed)
        cut = int(rng.integers(LENGTH // 4, LENGTH - LENGTH // 4))
        symbols[cut:, mixed], labels[cut:, mixed] = symbols[cut:, other], labels[cut:, other]
        if rng.random() < 0.7:
            symbols[cut, mixed], labels[cut, mixed] = 10, -1
        return symbols, labels

    return draw


def train(sample: pd.DataFrame, seed: int = 7, steps: int = STEPS) -> BiGRU:
    """The network fitted to labelled windows; after each round but the last, windows that it clearly gives to another language leave the sample, as their label is likely wrong or they are mixed."""
    rng = np.random.default_rng(seed)
    classes = sorted(sample["code"].unique())
    net = BiGRU(classes, HIDDEN, seed)
    groups = [[t.encode("utf-8", "replace") for t in sample.loc[sample["code"] == c, "part"]] for c in classes]
    kept = groups
    for rounds in range(ROUNDS):
        net.fit(_draws(_variants(kept, rng), rng), steps // ROUNDS, RATE * 0.7**rounds)
        if rounds < ROUNDS - 1:
            votes = [pooled(net, group) for group in groups]
            good = [[t for t, v in zip(g, of, strict=True) if v[c] > 0.5 * v.max()] for c, (g, of) in enumerate(zip(groups, votes, strict=True))]
            kept = [k if len(k) > len(g) // 4 else g for k, g in zip(good, groups, strict=True)]
    return net


def _variants(groups: list[list[bytes]], rng: np.random.Generator) -> list[list[bytes]]:
    return [[*g, *(_varied(t.decode("utf-8", "replace"), rng).encode("utf-8", "replace") for t in g)] for g in groups]


def pooled(net: BiGRU, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities of each text's positions."""
    out = np.zeros((len(texts), len(net.classes)), np.float64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for at, probs in label_bytes(net, np.frombuffer(b"".join(texts), np.uint8)):
        own = owner[at : at + len(probs)]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[cut]] += np.add.reduceat(probs, cut, axis=0, dtype=np.float64)
    return out / np.maximum(1, out.sum(1, keepdims=True))


def label_bytes(net: BiGRU, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, probabilities (n, C)) of consecutive stretches of `data`, each position labelled once.

    The bytes are cut into pieces, which run through the network side by side; each also sees AROUND
    bytes before and after it.
    """
    span = PIECE * PIECES
    for first in range(0, len(data), span):
        part = data[first : first + span]
        pieces = -(-len(part) // PIECE)
        wide = np.full(pieces * PIECE + 2 * AROUND, PAD, np.int32)
        lo, hi = max(0, first - AROUND), min(len(data), first + len(part) + AROUND)
        wide[AROUND - (first - lo) : AROUND - (first - lo) + hi - lo] = data[lo:hi]
        index = np.arange(pieces)[None, :] * PIECE + np.arange(PIECE + 2 * AROUND)[:, None]
        probs = net.probabilities(wide[index])[AROUND : AROUND + PIECE]
        yield first, probs.transpose(1, 0, 2).reshape(pieces * PIECE, -1)[: len(part)]


_LETTER_STARTS = np.zeros(256, bool)
_LETTER_STARTS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xE0)]] = True


def line_counts(net: BiGRU, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, line number from 1, characters, mean letters given to each class (lines, C)) for all lines of all texts.

    Only letters count, once a character, each with its probabilities: digits, marks and blanks belong to no language.
    """
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(data == 10)
    last = np.cumsum([len(r) for r in raw]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    text_of = np.searchsorted(last, ends)
    first_line = np.searchsorted(text_of, np.arange(len(texts)))
    number = np.arange(len(ends)) - first_line[text_of] + 1
    chars_before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = chars_before[ends] - chars_before[starts]
    chars = chars - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 13))
    counts = np.zeros((len(ends), len(net.classes)))
    for at, probs in label_bytes(net, data):
        here = _LETTER_STARTS[data[at : at + len(probs)]]
        probs[~here] = 0
        line = np.searchsorted(ends, np.arange(at, at + len(probs)))
        cut = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        counts[line[cut]] += np.add.reduceat(probs, cut, axis=0, dtype=np.float64)
    return text_of, number, chars, counts


_FOUND = "doc_id bigint, seg_no int, found_lang string, confidence double, given string"


def _judge(state: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = BiGRU.of(state)
        codes = np.array(net.classes, dtype=object)
        for batch in batches:
            ids, texts, given = (batch.column(i).to_pylist() for i in range(3))
            for part in _parts(texts):
                yield _found(net, codes, ids[part], texts[part], given[part])

    return run


def _parts(texts: list[str], most: int = 1 << 21) -> Iterator[slice]:
    """Slices of at most about `most` characters; a longer text is a slice of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(first, i)
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def _found(net: BiGRU, codes: np.ndarray, ids: list, texts: list[str], given: list) -> pa.RecordBatch:
    text_of, number, chars, counts = line_counts(net, texts)
    whole = np.zeros((len(texts), len(codes)))
    np.add.at(whole, text_of, counts)
    total = whole.sum(1)
    main = whole.argmax(1)
    known = total > 0
    letters = counts.sum(1)
    best = counts.argmax(1)
    away = known[text_of] & (chars >= LEAST_LINE) & (best != main[text_of]) & (letters > 0)
    other = letters - counts[np.arange(len(best)), main[text_of]]
    away &= other > letters / 2
    docs, lines = np.flatnonzero(known), np.flatnonzero(away)
    doc = np.r_[docs, text_of[lines]].astype(int)
    seg = np.r_[np.zeros(len(docs), np.int32), number[lines].astype(np.int32)]
    found = [*codes[main[docs]], *codes[best[lines]]]
    sure = np.r_[whole[docs, main[docs]] / total[docs], counts[lines, best[lines]] / letters[lines]]
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[i] for i in doc], pa.int64()), pa.array(seg, pa.int32()), pa.array(found, pa.string()), pa.array(sure, pa.float64()), pa.array([given[i] for i in doc], pa.string())],
        ["doc_id", "seg_no", "found_lang", "confidence", "given"],
    )


def find_languages(documents: DataFrame, net: BiGRU | None = None, doc: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, seg_no, found_lang, confidence, given): the main language of every document (seg_no 0) and the lines in another one.

    `confidence` is the share of the letters' probabilities that the language got; `given` is the code that
    the label names, or null. Line n of the text split at line feeds is seg_no n, empty lines counted;
    lines under 20 characters have no row, nor have texts that are null, empty or without a letter. Rows
    with the same id are judged each on their own. Without `net` one is trained on the labelled rows; if
    no label names a language, the result is empty.
    """
    if net is None:
        sample = training_rows(documents, text, label)
        if not len(sample):
            return documents.sparkSession.createDataFrame([], _FOUND)
        net = train(sample)
    rows = documents.select(F.col(doc).cast("bigint"), F.col(text), language_code(F.col(label)).alias("given")).filter(F.length(text) > 0)
    return rows.mapInArrow(_judge(net.state()), _FOUND)


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, seg_no, found_lang): documents whose label doesn't name the language found, and all lines in another."""
    return found.filter((F.col("seg_no") > 0) | F.col("given").isNull() | (F.col("given") != F.col("found_lang"))).select("doc_id", "seg_no", "found_lang")


def save(spark: SparkSession, net: BiGRU, path: str) -> None:
    """Writes a trained network to a folder of any file system, as one small JSON row."""
    state = net.state()
    text = json.dumps({"classes": state["classes"], "hidden": state["hidden"], "parameters": [{"shape": p.shape, "values": p.astype(float).ravel().tolist()} for p in state["parameters"]]})
    spark.createDataFrame([(text,)], "net string").write.parquet(path)


def load(spark: SparkSession, path: str) -> BiGRU:
    """A network that `save` wrote, equal in every parameter."""
    state = json.loads(spark.read.parquet(path).first()[0])
    return BiGRU.of(state | {"parameters": [np.array(p["values"], np.float32).reshape(p["shape"]) for p in state["parameters"]]})
