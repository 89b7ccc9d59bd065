"""Personal data by weak supervision, with column expressions only.

Each kind has a pattern for its *base* form, whose matches that pass a check are personal data for
certain, and one for written-out forms ("a (at) b (dot) org", "1[.]2[.]3[.]4"). All matches are
candidates. Four labelers vote on each, for, against or not at all: its structure (pattern and
check), a gazetteer (endings of domains, issuers of cards, codes of places), its context (words
before it) and its edges (what it touches). Votes are counted over all documents; expectation
maximisation over the counts estimates how reliable each labeler is for each kind, and how probable
each pattern of votes makes personal data. Base spans are certain there, and so are base forms whose
check fails, as no personal data. A logistic classifier of
span features is then trained on these probabilities, and what it accepts joins the base spans.

Counting is the only shuffle, of at most as many rows as there are patterns. Every kind's patterns
run only over texts that hold what no match can do without, and none steps back over long runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.staging import Stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("structure", "gazetteer", "context", "edges")
#: Characters before a candidate that its context is taken from.
CONTEXT = 40
#: Score from which a candidate beyond the base spans is taken.
ACCEPTED = 0.5
#: Right and wrong votes that every labeler is taken to have cast beforehand, and the ridge on weights.
RIGHT, WRONG, RIDGE = 4.0, 1.0, 0.1
ROUNDS = 100

# Endings of domains, first digits of card issuers, calling codes.
DOMAIN_ENDINGS = (
    "com org net edu gov mil int info biz io co eu uk de fr es it pt nl be ch at se no dk fi ie pl cz gr cy ru ua us ca "
    "mx br ar au nz jp cn kr in za"
).split()
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9])"
CALLING_CODES = r"^(?:00)?(?:1[2-9]|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Words that speak for a kind when they stand before a candidate, and against any.
CUES = {
    "email": "e-?mail|mail|contact|write|correo|courriel|kontakt|adresse",
    "ip": "ip|host|server|client|login|address|adresse|servidor|serveur",
    "card": "card|visa|mastercard|credit|debit|payment|tarjeta|carte|karte",
    "phone": "tel|phone|call|mobile|cell|fax|whatsapp|telefon|teléfono|téléphone|móvil",
}
AGAINST = "version|release|isbn|issn|doi|serial|order|invoice|sku|build|revision|section|chapter"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# A run of an address's characters is tried once, from where it begins or where the last match ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_AT, _DOT = (rf" ?(?:\({x}\)|\[{x}\]|\{{{x}\}}| {x} ) ?" for x in ("(?:at|AT)", "(?:dot|DOT)"))
_EMAIL_WORDS = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++(?![A-Za-z0-9._%+-]*+@)"
)
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_IP_WORDS = r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}+){3}(?!\.?[0-9])"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_CARD_WORDS = r"(?<![0-9])(?<![0-9][ -])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PHONE_WORDS = r"(?<![0-9+().-])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
# The base form goes first, but for cards: each number is one's base form, and none that passes lies
# in a written-out card. No written-out form takes characters of a base match.
_PATTERNS = {
    "email": f"{_EMAIL}|{_EMAIL_WORDS}", "ip": f"{_IP}|{_IP_WORDS}",
    "card": f"{_CARD_WORDS}|{_CARD}", "phone": f"{_PHONE}|{_PHONE_WORDS}",
}
_NEEDED = {
    "email": lambda text: text.contains("@") | text.rlike(r"[(\[{ ](?:dot|DOT)[)\]} ]"),
    "ip": lambda text: text.rlike(r"[0-9](?:\.|[\[(](?:\.|dot)[\])])[0-9]++(?:\.|[\[(](?:\.|dot)[\])])[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[ -]?[0-9]){12}|[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}"),
    "phone": lambda text: text.contains("+") | text.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
}
_CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body in which a value is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def _ends(lengths: Column) -> Column:
    """Running totals: of chunks first, then within each, so that long arrays stay cheap."""

    def within(s: Column) -> Column:
        def end(_: Column, i: Column) -> Column:
            chunk = F.floor(i / _CHUNK).cast("int")
            return F.get(s["before"], chunk) + _sum(F.slice(s["lengths"], chunk * _CHUNK + 1, i % _CHUNK + 1))

        return F.transform(s["lengths"], end)

    def chunked(n: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor(F.size(n) / _CHUNK).cast("int"))
        sums = F.transform(chunks, lambda c: _sum(F.slice(n, c * _CHUNK + 1, F.lit(_CHUNK))))
        before = _let(sums, lambda t: F.transform(t, lambda _, c: _sum(F.slice(t, F.lit(1), c))))
        return _let(F.struct(n.alias("lengths"), before.alias("before")), within)

    return _let(lengths, chunked)


def located(text: Column, pattern: str) -> Column:
    """A pattern's matches in order: start, end, text, and what stands before and after each."""
    pair = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("parts"),
    )

    def spans(s: Column) -> Column:
        lengths = F.transform(s["found"], lambda m, i: (F.length(F.get(s["parts"], i)) + F.length(m)).cast("long"))
        return _let(
            _ends(lengths),
            lambda ends: F.transform(
                s["found"],
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    m.alias("text"),
                    F.lower(F.right(F.get(s["parts"], i), F.lit(CONTEXT))).alias("before"),
                    F.left(F.get(s["parts"], i + 1), F.lit(1)).alias("after"),
                ),
            ),
        )

    return _let(pair, spans)


def passes_luhn(digits: Column) -> Column:
    """Whether a number's digits pass the check of payment cards."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _vote(good: Column, bad: Column | None = None) -> Column:
    if bad is None:
        return F.when(good, 1).otherwise(-1)
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _structure(kind: str, m: Column, digits: Column) -> Column:
    """For: the base form and its check. Against: one of the forms, but no check passes."""
    text = m["text"]
    if kind == "email":
        return _vote(text.contains("@"), F.lit(False))
    if kind == "ip":
        plain = text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
        return _vote(plain, ~text.rlike(rf"^{_OCTET}(?:[^0-9]+{_OCTET}){{3}}$"))
    if kind == "card":
        return F.when(~passes_luhn(digits), -1).when(text.rlike("[._/]"), 0).otherwise(1)
    size = F.length(digits)
    return _vote(text.startswith("+") & size.between(9, 15), text.startswith("+"))


def _gazetteer(kind: str, m: Column, digits: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.regexp_extract(m["text"], "[A-Za-z0-9-]+$", 0)).isin(DOMAIN_ENDINGS))
    if kind == "ip":
        first = F.regexp_extract(m["text"], "^0*([0-9]*)", 1)
        return _vote((F.length(first) <= 3) & F.coalesce(first.try_cast("int").between(1, 223), F.lit(False)))
    return _vote(digits.rlike(CARD_ISSUERS if kind == "card" else CALLING_CODES))


def _marked(kind: str, m: Column) -> Column:
    """A candidate with its votes and the other features of its span."""
    digits = F.regexp_replace(m["text"], "[^0-9]", "")
    cue = m["before"].rlike(rf"(?:^|[^a-z])(?:{CUES[kind]})[^a-z]{{0,12}}$")
    against = m["before"].rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]{{0,12}}$")
    touched = m["before"].rlike(r"[\p{L}0-9_/=\"]$") | m["after"].rlike(r"[\p{L}0-9_/=@\"]")
    return _let(
        F.struct(m.alias("m"), digits.alias("digits")),
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["m"]["start"].alias("start"),
            s["m"]["end"].alias("end"),
            _structure(kind, s["m"], s["digits"]).alias("structure"),
            _gazetteer(kind, s["m"], s["digits"]).alias("gazetteer"),
            _vote(cue, against).alias("context"),
            _vote(~touched).alias("edges"),
            s["m"]["text"].rlike("[ (_/-]").alias("spaced"),
            (F.length(s["m"]["text"]) >= 16).alias("long"),
        ),
    )


def _of_kind(kind: str, text: Column) -> Column:
    found = located(text, _PATTERNS[kind])
    if kind == "card":
        size = lambda m: F.length(F.regexp_replace(m["text"], "[^0-9]", ""))
        found = F.filter(found, lambda m: size(m).between(13, 19))
    marked = F.transform(found, lambda m: _marked(kind, m))
    return F.when(_NEEDED[kind](text), marked)


def add_candidates(docs: DataFrame, name: str = "candidates", text: str = "text") -> DataFrame:
    """Add all candidates of a text, kind by kind and by start; a null text has none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    nothing = F.array().cast(
        "array<struct<kind:string,start:bigint,end:bigint,structure:int,gazetteer:int,context:int,"
        "edges:int,spaced:boolean,long:boolean>>"
    )
    return docs.withColumn(name, F.concat(*[F.coalesce(_of_kind(k, whole), nothing) for k in KINDS]))


@dataclass(frozen=True)
class Model:
    """What the votes say: reliabilities by kind and labeler, and the classifier's weights by kind.

    A reliability is the share of a labeler's votes that agree with what a candidate probably is.
    """

    reliability: dict[tuple[str, str], float] = field(default_factory=dict)
    weights: dict[str, tuple[float, ...]] = field(default_factory=dict)


_FEATURES = (
    lambda c: F.lit(1.0),
    lambda c: (c["structure"] == 1).cast("double"),
    lambda c: (c["structure"] == -1).cast("double"),
    lambda c: c["gazetteer"].cast("double"),
    lambda c: c["context"].cast("double"),
    lambda c: c["edges"].cast("double"),
    lambda c: c["spaced"].cast("double"),
    lambda c: c["long"].cast("double"),
)


def _features(row) -> list[float]:
    return [
        1.0, float(row["structure"] == 1), float(row["structure"] == -1), float(row["gazetteer"]),
        float(row["context"]), float(row["edges"]), float(row["spaced"]), float(row["long"]),
    ]


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of patterns of votes, and the reliabilities of the labelers.

    The first column is the structure: a vote there, of 1 or of -1, is certain. No vote (0) says
    nothing. The start is the balance of votes; RIGHT and WRONG votes beforehand keep shares off 0
    and 1 and stand for a kind of which nothing certain was seen.
    """
    known = votes[:, 0] != 0
    open_ones = counts * ~known
    certain = (votes[:, 0] == 1).astype(float)
    p = np.where(known, certain, 1 / (1 + np.exp(-votes.sum(axis=1, dtype=float))))
    for _ in range(ROUNDS):
        share = ((p * open_ones).sum() + WRONG) / (open_ones.sum() + 2 * WRONG)
        odds = np.full(len(votes), math.log(share / (1 - share)))
        for column in votes[:, 1:].T:
            yes = {v: (p * counts)[column == v].sum() + (RIGHT if v == 1 else WRONG) for v in (1, -1)}
            no = {v: ((1 - p) * counts)[column == v].sum() + (WRONG if v == 1 else RIGHT) for v in (1, -1)}
            for v in (1, -1):
                odds[column == v] += math.log(yes[v] / sum(yes.values())) - math.log(no[v] / sum(no.values()))
        last, p = p, np.where(known, certain, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        if np.abs(p - last).max() < 1e-9:
            break
    agree = np.where(votes == 1, p[:, None], 1 - p[:, None]) * (votes != 0) * counts[:, None]
    cast = ((votes != 0) * counts[:, None]).sum(axis=0)
    return p, (agree.sum(axis=0) + RIGHT) / (cast + RIGHT + WRONG)


def regress(features: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic weights for probable labels, with a ridge, by Newton's method."""
    w = np.zeros(features.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (counts * (p - targets)) + RIDGE * w
        bend = (features * (counts * p * (1 - p))[:, None]).T @ features + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 4 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(marked: DataFrame, name: str = "candidates") -> Model:
    """Estimate the labelers and train the classifier on all candidates of a table.

    What reaches the driver is one count for each pattern of votes and features of a kind, of which
    there are at most 1,296. A kind without candidates gets no weights and so no spans.
    """
    columns = ("kind", *LABELERS, "spaced", "long")
    candidate = marked.select(F.explode(name).alias("c")).select(*[F.col("c")[c].alias(c) for c in columns])
    rows = candidate.groupBy(*columns).count().orderBy(*columns).collect()
    reliability, weights = {}, {}
    for kind in KINDS:
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        counts = np.array([r["count"] for r in own], float)
        p, agree = estimate(np.array([[r[x] for x in LABELERS] for r in own]), counts)
        reliability |= {(kind, x): float(a) for x, a in zip(LABELERS, agree, strict=True)}
        weights[kind] = tuple(regress(np.array([_features(r) for r in own]), p, counts).tolist())
    return Model(reliability, weights)


def score(candidate: Column, model: Model) -> Column:
    """The classifier's probability that a candidate is personal data."""
    out = F.lit(0.0)
    for kind, weights in model.weights.items():
        total = sum((F.lit(w) * f(candidate) for w, f in zip(weights, _FEATURES, strict=True)), F.lit(0.0))
        out = F.when(candidate["kind"] == kind, 1 / (1 + F.exp(-total))).otherwise(out)
    return out


def add_spans(marked: DataFrame, model: Model, name: str = "personal", candidates: str = "candidates") -> DataFrame:
    """Replace the candidates by a struct of ``base`` and ``spans``, each of kind, start and end.

    Spans are the base ones and those candidates that the classifier accepts, unless a base span
    overlaps them. Positions count code points; the end is exclusive.
    """
    span = lambda c: F.struct(*[c[x].alias(x) for x in ("kind", "start", "end")])

    def joined(s: Column) -> Column:
        free = lambda c: ~F.exists(s["base"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        kept = F.filter(s["all"], lambda c: (c["structure"] == 1) | ((score(c, model) >= ACCEPTED) & free(c)))
        return F.struct(F.transform(s["base"], span).alias("base"), F.transform(kept, span).alias("spans"))

    base = F.filter(candidates, lambda c: c["structure"] == 1)
    pair = F.struct(F.col(candidates).alias("all"), base.alias("base"))
    others = [c for c in marked.columns if c not in (name, candidates)]
    return marked.select(*[F.col(f"`{c}`") for c in others], _let(pair, joined).alias(name))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(
    docs: DataFrame, keep: list[str] | None = None, name: str = "personal", text: str = "text"
) -> DataFrame:
    """Add the personal data of every whole text, with a model trained on the same table.

    Null, empty and very long texts, null ids and repeated rows are all rows like others, an empty
    table gives an empty one, and an older column of the new one's name is replaced. Only the
    columns in ``keep`` come back. Texts are read once: candidates are written to a staged table.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    held = "candidates"
    while held in kept or held == name:
        held = f"_{held}"
    marked = add_candidates(docs, held, text).select(*[F.col(f"`{c}`") for c in kept], held)
    staged = Stage(docs.sparkSession).write(marked, "candidates")
    return add_spans(staged, train(staged, held), name, held)
