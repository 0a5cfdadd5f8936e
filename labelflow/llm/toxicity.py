"""Toxicity by noisy-channel deobfuscation: Viterbi restores disguised words, a trained scorer judges the text.

Channel. A disguised word is a lattice over its characters: a digit or sign may stand for the letters it
resembles, ``*`` for any vowel, a mark between letters for nothing, a run of one letter for one or two of it,
a space between single letters for nothing. Source. A character trigram model over all texts of the corpus,
counted in Spark. Viterbi takes the likeliest letters. Only words that look disguised are decoded; all
others are their own restoration. A digit or sign that touches a letter at either end of a word may be a letter or
a mark, so such a word counts as written without it and as decoded: with every sign read one for one, and by Viterbi,
which may also drop signs that are common punctuation. Two or more exclamation marks at the end are left to Viterbi.

Scorer. Words and word beginnings of the restored texts are counted per label over a bounded, documented sample
of the labelled rows (``sample`` per class, by hash of the id). The evidence of a feature is its smoothed log odds; a
text's evidence is that of its three strongest distinct words; a logistic fit on evidence from the other half of the
sample turns it into a probability, so evidence is never fitted to the rows it came from.

Null and empty texts have no evidence. Without training rows of both labels every score is 0. Labels
of repeated ids count as toxic if any is. Repeated documents are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.session import materialize

SAMPLE = 6000
CUTOFF = 0.7
STEMS = (4, 5, 6)
LEAST_ROWS = 3
MOST_FEATURES = 50_000
SYMBOLS = 27  # 0 is anything but a letter, 1 to 26 are a to z
TOP = 3

# Letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
MARKS = set(".-_*'`~^,:;/\\#=·​‌‍­")
SWAP, ERASE, SPLIT, KEEP = -1.0, -0.7, -0.7, -4.0

INNER = re.compile(r"[^\W\d_][^\w\s]{0,3}[0-9@$!|+(€£¡*._'`~^,:;/\\#=·​‌‍­-]+[^\W\d_]|([^\W\d_])\1\1|^[@$!|+(€£¡0-9][^\W\d_]{2}")
SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+*])(?:[ .\-_*]{1,3}(?:[^\W_]|[@$!|+*])){3,}(?!\S)")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…«»“”„‘’¿¡·"
PLAIN = "".join(c for c in EDGES if c not in LOOKS)
DOUBTFUL = set("!|+(¡")  # may be punctuation where they touch a word's end
_SIGNS = "[" + re.escape("".join(LOOKS)) + "]"
EDGED = re.compile(rf"^{_SIGNS}+[^\W\d_]|[^\W\d_]{_SIGNS}+$")
SHOUT = re.compile(r"!{2,}$")
RUNS = re.compile(r"(.)\1\1", re.DOTALL)


def letter_table() -> np.ndarray:
    """Symbol of each code point up to U+024F; accents are dropped."""
    import unicodedata

    table = np.zeros(0x250, dtype=np.int64)
    for code in range(0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
    return table


def _codes(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 0)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): character trigrams of all texts, at most SYMBOLS**3 rows; each task sends its sums only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        sums = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                c = np.concatenate([[0, 0], _codes(text.as_py() or "", table), [0]])
                sums += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(seen, pa.int64()), "n": pa.array(sums[seen], pa.int64())})

    return docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol given the two before it, smoothed with the bigram's and the symbol's."""
    counts = np.zeros(SYMBOLS**3)
    for row in trigram_counts(docs).collect():  # at most SYMBOLS**3 rows
        counts[row["gram"]] = row["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


class Decoder:
    """Viterbi over the character lattice of one word or one run of spaced characters."""

    def __init__(self, model: np.ndarray, memory: int = 50_000):
        self.model = model.tolist()
        self.table = letter_table()
        self.known: dict[tuple, str] = {}
        self.seen: dict[str, tuple[str, ...]] = {}
        self.memory = memory

    def _choices(self, word: str, each: bool = False, loose: bool = False) -> list[list[tuple[str, float]]]:
        """Per run of equal characters: what it may stand for and at what cost. ``each``: one letter a sign, up to two;
        ``loose``: doubtful signs at either end may stand for nothing."""
        steps = []
        at = 0
        while at < len(word):
            end = at
            while end < len(word) and word[end] == word[at]:
                end += 1
            c, n = word[at], end - at
            if c.isspace():
                steps.append([("", SPLIT), (" ", KEEP)])
            elif c in LOOKS or c in MARKS:
                options = [(x * min(n, 2), SWAP) for x in LOOKS.get(c, "")]
                if c in LOOKS and n > 1 and not each:
                    options += [(x, SWAP) for x in LOOKS[c]]
                if c in MARKS or not options or loose and c in DOUBTFUL and (at == 0 or end == len(word)):
                    options.append(("", ERASE))
                steps.append(options)
            elif n >= 3:
                steps.append([(c, 0.0), (c * 2, -0.5)])
            else:
                steps.append([(c * n, 0.0)])
            at = end
        return steps

    def _symbol(self, c: str) -> int:
        code = ord(c)
        return int(self.table[code]) if code < len(self.table) else 0

    def restore(self, word: str, each: bool = False, loose: bool = False) -> str:
        got = self.known.get((word, each, loose))
        if got is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            got = self.known[word, each, loose] = self._viterbi(word, each, loose)
        return got

    def _viterbi(self, word: str, each: bool, loose: bool) -> str:
        model = self.model
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in self._choices(word, each, loose):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in best.items():
                for text, cost in options:
                    x, y, total = a, b, score + cost
                    for c in text:
                        z = self._symbol(c)
                        total += model[x][y][z]
                        x, y = y, z
                    # an erased character is paid for like a letter of average likelihood
                    total -= 0.0 if text else 1.0
                    if (x, y) not in new or new[x, y][0] < total:
                        new[x, y] = (total, (path, text))
            best = new
        ends = {s: (v[0] + model[s[0]][s[1]][0], v[1]) for s, v in best.items()}
        path = max(ends.values(), key=lambda v: v[0])[1]
        parts = []
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def words(self, text: str | None) -> set[str]:
        """Distinct words of the restored text, lower case, without marks at their ends."""
        low = (text or "").lower()
        found = set()
        for run in SPACED.findall(low):
            found.update(self.restore(run).split())
        for word in set(low.split()):
            forms = self.seen.get(word)
            if forms is None:
                if len(self.seen) >= self.memory:
                    self.seen.clear()
                forms = self.seen[word] = tuple(self._forms(word))
            found.update(forms)
        found.discard("")
        return found

    def _forms(self, word: str) -> set[str]:
        """What a lower-case word counts as."""
        bare = word.strip(EDGES)
        found = {bare}
        if not (bare.isalpha() and not RUNS.search(bare)) and INNER.search(word):
            found.add(self.restore(bare))
        core = word.strip(PLAIN)
        if EDGED.search(core):
            found.add(self.restore(core, loose=True))
            shown = SHOUT.sub("", core)
            if EDGED.search(shown):
                found.add(self.restore(shown))
                found.add(self.restore(shown, each=True))
        return found


def features(word: str) -> list[str]:
    return [word] + [word[:n] + "+" for n in STEMS if len(word) >= n]


def word_evidence(word: str, evidence: dict[str, float]) -> float:
    best = evidence.get(word, 0.0)
    for n in STEMS:
        if len(word) >= n:
            best = max(best, evidence.get(word[:n] + "+", 0.0))
    return best


def top_evidence(words: set[str], evidence: dict[str, float]) -> list[float]:
    """The largest evidence of distinct words, largest first; words that only share a stem count each."""
    found = sorted((e for e in (word_evidence(w, evidence) for w in words) if e > 0), reverse=True)[:TOP]
    return found + [0.0] * (TOP - len(found))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, fold): up to ``sample`` rows of each label, by the smallest hash of the id, without those
    held out."""
    toxic = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = toxic.where(~held_out("doc_id")).withColumn("rank", F.xxhash64("doc_id"))
    chosen = None
    for value in (0, 1):
        part = toxic.where(F.col("toxic") == value).orderBy("rank", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    chosen = materialize(chosen, "chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows
    return materialize(rows.select("text", "toxic", F.pmod("rank", F.lit(2)).cast("int").alias("fold")), "training")


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _log_odds(toxic, clean, n_toxic, n_clean):
    return np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((clean + 0.5) / (n_clean + 1.0))


class Scorer:
    """Evidence of features and the logistic fit on the top evidence of a text."""

    def __init__(self, model: np.ndarray, evidence: dict[str, float], weights: np.ndarray | None):
        self.model, self.evidence, self.weights = model, evidence, weights

    def score(self, tops: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(tops))
        return 1 / (1 + np.exp(-np.clip(tops @ self.weights[1:] + self.weights[0], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    model = language_model(docs)
    rows = training_rows(docs, labels, sample)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(sent.value)
        for frame in frames:
            for text, toxic, fold in zip(frame["text"], frame["toxic"], frame["fold"]):
                seen = {f for w in decoder.words(text) for f in features(w)}
                yield pd.DataFrame({"feature": list(seen), "toxic": toxic, "fold": fold}).astype(
                    {"feature": object, "toxic": "int32", "fold": "int32"})

    sizes = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    size = lambda toxic, folds: sum(sizes.get((toxic, f), 0) for f in folds)
    if not all(size(t, (0, 1)) for t in (0, 1)):
        return Scorer(model, {}, None)
    spread = rows.repartition(max(2, spark.sparkContext.defaultParallelism))
    long = spread.mapInPandas(unfold, "feature string, toxic int, fold int")
    cell = lambda t, f: F.sum(((F.col("toxic") == t) & (F.col("fold") == f)).cast("long")).alias(f"n{t}{f}")
    table = long.groupBy("feature").agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))
    rate = (F.col("n10") + F.col("n11")) / size(1, (0, 1)) / ((F.col("n00") + F.col("n01") + 1) / size(0, (0, 1)))
    strong = table.where(F.col("n10") + F.col("n11") >= LEAST_ROWS).where(rate > 1)
    counted = strong.orderBy(rate.desc(), "feature").limit(MOST_FEATURES).toPandas()

    def evidence(folds: tuple[int, ...]) -> dict[str, float]:
        toxic = sum(counted[f"n1{f}"].to_numpy(dtype=float) for f in folds)
        clean = sum(counted[f"n0{f}"].to_numpy(dtype=float) for f in folds)
        odds = _log_odds(toxic, clean, size(1, folds), size(0, folds))
        # an estimate counts as much as the rows behind it allow
        odds *= toxic / (toxic + 3)
        return {f: float(o) for f, o, n in zip(counted["feature"], odds, toxic) if o > 0.5 and n > 0}

    halves = [evidence((0,)), evidence((1,))]
    tables = spark.sparkContext.broadcast(halves)

    def summarize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(sent.value)
        for frame in frames:
            tops = [top_evidence(decoder.words(t), tables.value[1 - f]) for t, f in zip(frame["text"], frame["fold"])]
            out = pd.DataFrame(np.array(tops, dtype=float).reshape(-1, TOP), columns=["e0", "e1", "e2"])
            yield out.assign(toxic=frame["toxic"].to_numpy())

    tops = spread.mapInPandas(summarize, "e0 double, e1 double, e2 double, toxic int").toPandas()  # at most 2 * sample rows
    weights = _logistic(tops[["e0", "e1", "e2"]].to_numpy(), tops["toxic"].to_numpy(dtype=float))
    return Scorer(model, evidence((0, 1)), weights)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Newton's method with a small ridge."""
    order = np.lexsort((*x.T, y))
    x, y = np.column_stack([np.ones(len(x)), x])[order], y[order]
    share = np.full(len(y), 1 / max(1, len(y)))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - ridge @ w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_rows(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The columns of docs without the text, and the score of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    others = [c for c in docs.columns if c != "text"]
    types = dict(docs.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        decoder = Decoder(own.model)
        for batch in batches:
            tops = [top_evidence(decoder.words(t.as_py()), own.evidence) for t in batch.column("text")]
            score = own.score(np.array(tops, dtype=float).reshape(-1, TOP))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in others} | {"score": pa.array(score, pa.float64())})

    return docs.mapInArrow(work, ", ".join(f"`{c}` {types[c]}" for c in others) + ", score double")


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    scored = score_rows(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted")
    )


def restore_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, restored): texts with every disguised word replaced by what Viterbi makes of it."""
    sent = docs.sparkSession.sparkContext.broadcast(language_model(docs))
    types = dict(docs.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)

        def one(word: str) -> str:
            bare, core = word.strip(EDGES), word.strip(PLAIN)
            if EDGED.search(core):
                got = decoder.restore(core, loose=True)
                return word if got == bare else got
            return decoder.restore(bare) if bare and INNER.search(bare) else word

        for batch in batches:
            out = []
            for text in batch.column("text"):
                whole = SPACED.sub(lambda m: decoder.restore(m.group()), (text.as_py() or "").lower())
                out.append("".join(one(p) for p in re.split(r"(\s+)", whole)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "restored": pa.array(out, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {types['doc_id']}, text string, restored string")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """Rows of docs whose score stays below the cutoff, with the columns of docs."""
    scorer = train(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        decoder = Decoder(own.model)
        for batch in batches:
            tops = [top_evidence(decoder.words(t.as_py()), own.evidence) for t in batch.column("text")]
            yield batch.filter(pa.array(own.score(np.array(tops, dtype=float).reshape(-1, TOP)) < cutoff))

    return docs.mapInArrow(work, schema)
