"""Personal data by weak supervision: labelers vote, EM weighs them, a trained classifier decides.

Base spans follow fixed rules per kind and always stay. Further candidates are what the rules match but do not
accept, and looser forms (phone numbers without ``+``, addresses written with "at" and "dot"). Four labelers
vote 1, 0 (no opinion) or -1 on every candidate: its form, a gazetteer (domain endings, calling codes, area codes,
card prefixes, reserved addresses), the words before it, and the characters around it. All candidates are counted
per vote pattern (at most 3**4 a kind); EM over these counts estimates per kind how reliable each labeler is, and a
logistic span classifier is fitted to the posterior of every pattern. A candidate is added if its probability
reaches ``threshold`` and it touches no other span.

A labeler's reliability is estimated under a Beta prior that points its way (``TRUST``) and weighs ``PRIOR_SHARE`` as
much as the kind's candidates, so the two classes cannot change places or turn into kinds, however few patterns a kind
has. A loose form cannot start inside a base match, so base spans are not counted a second time.

Positions are code points, ends exclusive. Null texts count as empty and have no spans. Repeated rows are
labelled and counted each. The patterns are written with possessive parts so that long runs of digits or
letters cost linear time; they match what the plain forms match.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.session import materialize

# The base kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._-]{1,40}\x20?[(\[]at[)\]]\x20?[a-z0-9-]{2,40}"
    r"(?:\x20?[(\[]dot[)\]]\x20?[a-z]{2,12}|\.[a-z]{2,12})",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# What a loose form may not start in; such matches are found first and left out.
AVOIDED = {"email": (BASE["email"], "@"), "phone": (BASE["phone"], "+")}
LABELERS = ("form", "gazetteer", "context", "edges")
# Generic endings (any two letters are a country's), calling codes of the numbering zones, prefixes of
# card issuers, reserved and private address blocks.
ENDINGS = (
    r"(?i)(?:\.|dot[)\]]\x20?)(com|org|net|edu|gov|mil|int|info|biz|name|pro|museum|coop|aero|jobs|mobi|travel|app|dev"
    r"|xyz|online|site|shop|store|tech|blog|cloud|club|news|agency|company|email|live|space|world|[a-z]{2})$"
)
CALLING = (
    r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[234][0-9]|25[0-8]|26[0-9]|29[01789]"
    r"|35[0-9]|37[0-9]|38[0-35-79]|42[0136]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|80[08]|85[02356]|87[0-9]|88[0-38]"
    r"|96[0-9]|97[0-79]|99[0-9])"
)
AREA = r"^\(?[2-9][0-9]{2}[)\x20.-]+[2-9][0-9]{2}"
CARDS = r"^(4|5[0-8]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47689]|30[0-5]|35(2[89]|[3-8])|6011|6[2-9])"
RESERVED = r"^0*(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
PRIVATE = r"^0*(10\.|192\.0*168\.|172\.0*(1[6-9]|2[0-9]|3[01])\.)"
CUES = {
    "email": r"(?i)(e-?mail|mail|mailto|contact|contacto|contatto|kontakt|correo|courriel|posta|write|reach|at|adresse)\W*$",
    "ip": r"(?i)(\bip|ipv4|address|adresse|dirección|indirizzo|host|server|serveur|servidor|from|client|login|logged in)\W*$",
    "card": r"(?i)(card|karte|carte|carta|tarjeta|cartão|visa|mastercard|amex|maestro|credit|debit|kreditkarte)(?:\W+(no|nr|number|nummer|numéro|número))?\W*$",
    "phone": r"(?i)(phone|tel|tél|call|fax|mobile?|cell|handy|telefon|teléfono|téléphone|telefono|telefone|rufen|whatsapp|sms|dial)"
    r"(?:\W+(no|nr|at|me|us|number|nummer))?\W*$",
}
AGAINST = r"(?i)(version|isbn|issn|order|invoice|token|key|sha|id|no|page|ref|serial|build|release|=|#|\$|€)\W*$"
TAIL = 24
RUN = 256
THRESHOLD = 0.9
# How often each labeler is expected to be right where it has an opinion, before any text is seen.
TRUST = {"form": 0.95, "gazetteer": 0.75, "context": 0.9, "edges": 0.7}
PRIOR_SHARE = 0.5
TOLERANCE = 1e-9
MOST_ROUNDS = 10_000


def _barrier(rows: DataFrame, name: str, value) -> DataFrame:
    """Adds a column that is computed once, however often later expressions use it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _found(rows: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Adds column ``name``: array of (start, end, what, before, after) of the pattern's matches in ``body``."""
    has = F.col("body").rlike(needs)
    none = F.array().cast("array<string>")
    rows = _barrier(rows, "m", F.when(has, F.regexp_extract_all("body", F.lit(pattern), 0)).otherwise(none))
    gaps = F.transform(
        F.split("body", pattern, -1),
        lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(TAIL)).alias("tail"), F.left(g, F.lit(2)).alias("head")),
    )
    rows = _barrier(rows, "g", F.when(F.size("m") > 0, gaps))
    lengths = F.transform("m", lambda w, i: F.length(w) + F.get("g", i)["n"])
    rows = _barrier(rows, "l", lengths)
    runs = F.transform(
        F.sequence(F.lit(0), F.size("l"), F.lit(RUN)),
        lambda b: F.aggregate(F.slice("l", b + 1, F.lit(RUN)), F.lit(0), lambda t, x: t + x),
    )
    rows = _barrier(rows, "r", runs)
    sums = F.transform("r", lambda x, i: F.aggregate(F.slice("r", F.lit(1), i), F.lit(0), lambda t, y: t + y))
    rows = _barrier(rows, "s", sums)

    def span(w, i):
        run = F.floor(i / RUN).cast("int")
        into = F.aggregate(F.slice("l", run * RUN + 1, i % RUN), F.lit(0), lambda t, x: t + x)
        start = F.get("s", run) + into + F.get("g", i)["n"]
        return F.struct(
            start.cast("long").alias("start"), (start + F.length(w)).cast("long").alias("end"), w.alias("what"),
            F.get("g", i)["tail"].alias("before"), F.get("g", i + 1)["head"].alias("after"),
        )

    rows = _barrier(rows, name, F.transform("m", span))
    return rows.drop("m", "g", "l", "r", "s")


def _luhn(digits):
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda t, x: t + x) % 10 == 0


def _accepts(kind: str, what):
    digits = F.regexp_replace(what, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return what.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def candidates(rows: DataFrame) -> DataFrame:
    """Adds to rows with a text ``body``: ``base``, the accepted spans (k, start, end), and ``votes``, all
    candidates with the labelers' votes; k is the place of the kind in KINDS."""
    kept = rows.columns
    for kind in KINDS:
        rows = _found(rows, kind, BASE[kind], {"email": "@", "phone": r"\+"}.get(kind, "[0-9]"))
    for kind, pattern in LOOSE.items():
        rows = _found(rows, f"loose_{kind}", f"{AVOIDED[kind][0]}|(?:{pattern})", {"email": r"(?i)[(\[]at[)\]]"}.get(kind, "[0-9]"))

    def marked(kind: str, spans, form):
        k = KINDS.index(kind)
        return F.transform(spans, lambda s: F.struct(
            F.lit(k).alias("k"), s["start"].alias("start"), s["end"].alias("end"), form(s["what"]).alias("form"),
            _gazetteer(kind, s["what"]).alias("gazetteer"),
            F.when(s["before"].rlike(CUES[kind]), 1).when(s["before"].rlike(AGAINST), -1).otherwise(0).alias("context"),
            F.when(s["before"].rlike(r"[\w@/.-]$") | s["after"].rlike(r"^[\w@/]"), -1).otherwise(1).alias("edges"),
        ))

    listed = [marked(k, F.col(k), lambda w, k=k: F.when(_accepts(k, w), 1).otherwise(-1)) for k in KINDS]
    listed += [marked(k, F.filter(f"loose_{k}", _without(AVOIDED[k][1])), lambda w: F.lit(0)) for k in LOOSE]
    # single digits and short numbers are no candidates for cards
    wide = F.filter(F.concat(*listed), lambda s: (s["form"] == 1) | (s["k"] != KINDS.index("card"))
                    | (s["end"] - s["start"] >= 13))
    rows = _barrier(rows.withColumn("of", wide), "spans", F.col("of"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["form"] == 1),
                                    lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    return rows.select(*kept, base.alias("base"), F.col("spans").alias("votes"))


def _without(sign: str):
    return lambda s: ~s["what"].contains(sign)


def _gazetteer(kind: str, what):
    if kind == "email":
        return F.when(what.rlike(ENDINGS), 1).otherwise(0)
    if kind == "phone":
        plus = F.when(what.rlike(CALLING), 1).otherwise(-1)
        return F.when(what.startswith("+"), plus).when(what.rlike(AREA), 1).otherwise(-1)
    if kind == "card":
        return F.when(F.regexp_replace(what, "[^0-9]", "").rlike(CARDS), 1).otherwise(-1)
    return F.when(what.rlike(RESERVED), -1).when(what.rlike(PRIVATE), 0).otherwise(1)


def pattern_counts(found: DataFrame) -> dict[tuple[int, ...], int]:
    """How many candidates have each kind and votes; at most len(KINDS) * 3**4 entries."""
    votes = found.select(F.explode("votes").alias("v")).select("v.k", *[f"v.{x}" for x in LABELERS])
    rows = votes.groupBy("k", *LABELERS).agg(F.count("*").alias("n")).collect()
    return {tuple(r[:-1]): r["n"] for r in rows}


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def estimate(counts: dict[tuple[int, ...], int], tolerance: float = TOLERANCE) -> dict[tuple[int, ...], float]:
    """Posterior of every pattern: per kind, votes are independent given the truth and 0 says nothing.

    Ends when no posterior moves by more than ``tolerance``. Without candidates the result is empty.
    """
    trust = [TRUST[name] for name in LABELERS]
    ways = {p: sum(v * math.log(t / (1 - t)) for v, t in zip(p[1:], trust)) for p in counts}
    posterior = {p: _sigmoid(ways[p]) for p in counts}
    for kind in sorted({p[0] for p in counts}):
        mine = sorted(p for p in counts if p[0] == kind)
        weight = PRIOR_SHARE * sum(counts[p] for p in mine) + 2
        for _ in range(MOST_ROUNDS):
            true = sum(counts[p] * posterior[p] for p in mine)
            whole = sum(counts[p] for p in mine)
            base = math.log((true + weight / 2) / (whole - true + weight / 2))
            odds = dict.fromkeys(mine, base)
            for at, t in enumerate(trust, 1):
                yes, said = [0.0, 0.0], [0.0, 0.0]  # votes of 1, and votes, where it is false and where it is true
                for p in mine:
                    if p[at]:
                        for truth, share in ((1, posterior[p]), (0, 1 - posterior[p])):
                            said[truth] += counts[p] * share
                            yes[truth] += counts[p] * share * (p[at] == 1)
                hit, slip = ((yes[k] + weight * x) / (said[k] + weight) for k, x in ((1, t), (0, 1 - t)))
                for p in mine:
                    if p[at]:
                        odds[p] += math.log(hit / slip) if p[at] == 1 else math.log((1 - hit) / (1 - slip))
            new = {p: _sigmoid(odds[p]) for p in mine}
            moved = max(abs(new[p] - posterior[p]) for p in mine)
            posterior.update(new)
            if moved <= tolerance:
                break
    return posterior


def _features(pattern: tuple[int, ...]) -> list[float]:
    """1, then per kind: the kind, and each labeler's yes and no."""
    row = [1.0]
    for k in range(len(KINDS)):
        here = pattern[0] == k
        row += [float(here)] + [float(here and vote == way) for vote in pattern[1:] for way in (1, -1)]
    return row


def fit(counts: dict[tuple[int, ...], int], posterior: dict[tuple[int, ...], float], ridge: float = 1e-4) -> list[float]:
    """Weights of the span classifier: logistic regression on the patterns by Newton steps until they end.

    A pattern weighs by its share of its kind, smoothed so that rare patterns are fitted too.
    """
    rows = [(np.array(_features(p)), math.sqrt(n), posterior[p]) for p, n in sorted(counts.items())]
    w = np.zeros(len(_features((0, *[0] * len(LABELERS)))))
    if not rows:
        return w.tolist()
    x, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    kinds = [p[0] for p, _ in sorted(counts.items())]
    mass = {k: sum(r[1] for r, q in zip(rows, kinds) if q == k) for k in kinds}
    n = np.array([r[1] / mass[k] for r, k in zip(rows, kinds)])

    def loss(v):
        z = x @ v
        return float(n @ (np.logaddexp(0, z) - y * z) + ridge / 2 * v @ v)

    for _ in range(MOST_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * w
        if np.abs(slope).max() <= 1e-9:
            break
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
    return w.tolist()


def train(found: DataFrame) -> list[float]:
    counts = pattern_counts(found)
    return fit(counts, estimate(counts))


def _probability(s, weights: list[float]):
    width = 1 + 2 * len(LABELERS)
    total = F.lit(0.0)
    for k in range(len(KINDS)):
        own = weights[1 + k * width : 1 + (k + 1) * width]
        here = F.lit(weights[0] + own[0])
        for i, name in enumerate(LABELERS):
            here = here + F.when(s[name] == 1, own[1 + 2 * i]).when(s[name] == -1, own[2 + 2 * i]).otherwise(0.0)
        total = F.when(s["k"] == k, here).otherwise(total)
    return 1 / (1 + F.exp(-total))


def label_spans(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds to rows with a text ``body``: ``base`` and ``spans``, which holds the base and the added spans."""
    kept = rows.columns
    found = materialize(candidates(rows), "candidates")
    weights = train(found)

    def likely(s):
        apart = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return (s["form"] != 1) & (_probability(s, weights) >= threshold) & apart

    plain = F.transform(F.filter("votes", likely),
                        lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    rows = _barrier(found, "added", F.array_sort(plain))
    apart = F.filter("added", lambda s: ~F.exists(
        "added", lambda o: (o < s) & (o["start"] < s["end"]) & (s["start"] < o["end"])))
    rows = _barrier(rows, "own", apart)
    return rows.select(*kept, "base", F.array_sort(F.concat("base", "own")).alias("spans"))


def joined(spans: str):
    """``kind:start:end`` of each span, by kind as listed and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(k: int):
    return lambda s: s["k"] == k


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row: counts of the base spans, their
    digest, and all spans as text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    labelled = label_spans(rows, threshold).select("doc_id", "base", "spans")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return labelled.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def mask(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span replaced by its kind in brackets, and n_chars of the new text.

    Overlapping spans of different kinds become one stretch under the kind that starts first. A null text
    becomes empty.
    """
    columns = docs.columns
    aside = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c != "text"]
    spans = label_spans(docs.select(*aside, F.coalesce("text", F.lit("")).alias("body")), threshold)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))
    rows = _barrier(spans, "o", order)
    empty = F.array().cast("array<struct<start: bigint, end: bigint, k: int>>")

    def merge(done, s):
        last = F.element_at(done, -1)
        overlaps = F.when(F.size(done) > 0, s["start"] < last["end"]).otherwise(False)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["k"].alias("k"))
        return F.when(overlaps, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(
            F.concat(done, F.array(s)))

    rows = _barrier(rows, "u", F.aggregate("o", empty, merge))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    parts = F.transform("u", lambda s, i: F.concat(
        F.substring("body", F.when(i == 0, F.lit(0)).otherwise(F.get("u", i - 1)["end"]).cast("int") + 1,
                    (s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("u", i - 1)["end"])).cast("int")),
        F.get(names, s["k"])))
    rest = F.substring("body", F.element_at("u", -1)["end"].cast("int") + 1, F.length("body"))
    text = F.when(F.size("u") == 0, F.col("body")).otherwise(F.concat(F.array_join(parts, ""), rest))
    rows = _barrier(rows, "new", text)
    out = {c: F.col(f"c{i}") for i, c in enumerate(columns) if c != "text"} | {"text": F.col("new")}
    if "n_chars" in out:
        out["n_chars"] = F.length("new").cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*[out[c].alias(c) for c in columns])
