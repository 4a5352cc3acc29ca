"""Operator 2, personal data by weak supervision, in DataFrame expressions only.

Four base kinds are found by fixed patterns and checks. Beside them, loose patterns give candidates of five more
kinds, most of which are nothing of the sort: long tokens (secrets), numbers (identity), words after a title (names),
words beside a number (addresses) and urls with an @ (credentials). Four labelers vote on each: a regex for strict
forms, gazetteers in four languages, the marks around it, its shape. The votes and four features form a pattern
of bits, so the whole corpus is summed up by at most 5 * 2^8 counts. For each kind, expectation-maximisation
over these estimates the labelers' hit and false-alarm rates (with weak Beta priors instead of bounds), and its posteriors
train a logistic classifier over the bits, classes weighted alike. The classifier goes into the final projection
as the set of patterns that it accepts. No shuffle besides the counts.

Positions come from splitting a text at its matches: a match starts where the pieces and matches before
it end. Patterns are possessive and look behind, so a run of word characters is scanned once. Sums along a text's matches
go by groups of matches, so a text with many spans costs far less than their number squared.

Defined results: a null or empty text has no spans; long texts are searched whole; equal rows get equal
spans; null ids pass through; a corpus without candidates of a kind adds no spans of it; other columns ride along, only an
older column `_pii` is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
_LOCAL = r"[A-Za-z0-9._%+-]"
#: A match can only begin where a run begins or where the last match ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){15}", "phone": r"\+[0-9]"}
_SPAN = "array<struct<start:int,end:int>>"

CONTEXT = 40
ADDED = ("secret", "identity", "name", "address", "credential")
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|Señora?|Sra?|Don|Doña|Monsieur|Madame|Mme|Mlle)\.?[ ]"
_CAP = r"\p{Lu}\p{L}++"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_FORMED = rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-])|[0-9]{{8}}-?[A-Z](?![A-Za-z0-9])|{_IBAN}"
_STREET = r"(?:[Ss]treet|Avenue|Ave|Road|Lane|Drive|Boulevard|rue|avenue|boulevard|place|Calle|Avenida|Plaza|Paseo|\p{L}*(?:straße|strasse|weg|platz|allee|gasse))"
#: Everything that could be of an added kind, and much that is not, in one pass.
CANDIDATE = "(?<![A-Za-z0-9])(?:" + "|".join([
    r"[a-z]{2,12}://[^\s/@]{1,200}+@",
    rf"{_TITLE}{_CAP}(?:[ ]{_CAP})?+",
    _FORMED,
    rf"[0-9]{{1,5}},?[ ](?:(?:rue|avenue|boulevard|place)[ ](?:(?:de|du|des|la)[ ]){{0,2}}+)?{_CAP}(?:[ ]{_CAP}){{0,3}}+",
    rf"{_CAP}[ ](?:(?:de|del|la)[ ]){{0,2}}+(?:{_CAP},?[ ])?[0-9]{{1,4}}(?![0-9A-Za-z@-]|[.,:][0-9])",
    r"(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{12,}+|[A-Za-z]{16,}+|[0-9]{9,}+",
]) + ")"
#: Words of the gazetteers, in English, German, Spanish and French.
SECRET_WORDS = "password passwd pwd token secret api_key apikey api-key credential bearer private_key access_key passwort kennwort schlüssel geheim contraseña clave secreto mot_de_passe clé secrète jeton".split()
IDENTITY_WORDS = "ssn social_security passport iban identity tax_id sozialversicherung ausweis reisepass steuer konto dni nif nie pasaporte seguridad_social cuenta sécurité_sociale passeport carte_d'identité compte".split()
ADDRESS_WORDS = "address lives_at resident street adresse wohnhaft anschrift wohnt dirección domicilio vive_en domicile habite demeurant".split()
GIVEN_NAMES = "james mary john anna robert linda david sarah hans peter ursula klaus petra jürgen maría josé carmen antonio lucía juan ana jean marie pierre michel sophie luc claire".split()
SCHEMES = "http https ftp sftp ssh postgres postgresql mysql mongodb redis amqp smtp imap".split()


#: Matches that are summed together.
GROUP = 128


def _running(values: Column, zero: Column, op) -> Column:
    """op's running totals along an array of whole numbers: by groups, whose totals are summed first, so that n values cost
    n * GROUP + (n / GROUP)^2 steps and no array is ever appended to."""

    def of(v: Column) -> Column:
        fold = lambda from_, n: F.aggregate(F.slice(v, from_, n), zero, op)
        if_long = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / GROUP).cast("int")), lambda g: fold(g * GROUP + 1, F.lit(GROUP)))
        starts = let(if_long, lambda sums: F.transform(sums, lambda _, g: F.aggregate(F.slice(sums, F.lit(1), g), zero, op)))
        within = lambda s: F.transform(v, lambda _, i: op(s[F.floor(i / GROUP).cast("int")], fold(F.floor(i / GROUP).cast("int") * GROUP + 1, i % GROUP + 1)))
        return F.when(F.size(v) > 0, let(starts, within)).otherwise(F.array().cast("array<int>"))

    return let(values, of)


def _split(t: Column, pattern: str, keep) -> Column:
    """Spans of pattern in t, with keep(match) deciding, as an array of structs; extra fields from keep's caller."""

    def spans(m: Column, pieces: Column) -> Column:
        widths = F.transform(m, lambda x, i: F.length(pieces[i]) + F.length(x))
        ends = _running(widths, F.lit(0), lambda a, x: a + x)
        found = lambda e: F.transform(m, lambda x, i: F.struct(
            x.alias("m"), F.right(pieces[i], F.lit(CONTEXT)).alias("before"), F.left(pieces[i + 1], F.lit(2)).alias("after"),
            (e[i] - F.length(x)).cast("int").alias("start"), e[i].cast("int").alias("end")))
        return F.filter(let(ends, found), lambda z: keep(z["m"]))

    p = F.lit(pattern)
    found = lambda m: F.when(F.size(m) > 0, let(F.split(t, pattern), lambda pieces: spans(m, pieces)))
    return let(F.regexp_extract_all(t, p, F.lit(0)), found)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Luhn's check over a string of digits."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda a, i: a + let(F.substring(d, -i, F.lit(1)).cast("int"), lambda x: F.when(i % 2 == 1, x).when(x > 4, x * 2 - 9).otherwise(x * 2)),
    )
    return total % 10 == 0


def _checked(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: let(F.ltrim(p, F.lit("0")), lambda z: F.when(F.length(z) > 3, F.lit(False)).otherwise(F.coalesce(z.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Checked spans of one base kind, in code points, end exclusive."""
    t = F.coalesce(text, F.lit(""))
    found = F.when(t.rlike(NEEDS[kind]), _split(t, PATTERNS[kind], lambda m: _checked(kind, m)))
    return F.coalesce(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.array().cast(_SPAN))


def candidates(text: Column) -> Column:
    """What could be of an added kind, with what stands around, its kind and its pattern of bits."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<m:string,before:string,after:string,start:int,end:int>>")
    found = F.coalesce(_split(t, CANDIDATE, lambda m: F.lit(True)), none)
    kind = lambda c: F.struct(*[c[k].alias(k) for k in ("m", "before", "after", "start", "end")], _kind(c["m"]).alias("kind"), F.lower(c["before"]).alias("low"))
    bits = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), pattern_of(c).alias("p"))
    return F.transform(F.transform(found, kind), bits)


def _kind(m: Column) -> Column:
    """The place in ADDED of a candidate's kind."""
    out = F.when(F.contains(m, F.lit("://")), 4).when(m.rlike("^" + _TITLE), 2).when(m.rlike(f"^(?:{_FORMED}|[0-9]+)$"), 1)
    return out.when(F.contains(m, F.lit(" ")), 3).otherwise(0)


def _by_kind(c: Column, *votes: Column) -> Column:
    out = F.when(c["kind"] == 0, votes[0])
    for k, v in enumerate(votes[1:], 1):
        out = out.when(c["kind"] == k, v)
    return F.coalesce(out, F.lit(False))


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(?<!\p{L})(?:" + "|".join(w.replace("_", "[ _-]") for w in words) + r")")


def labelers(c: Column) -> list[Column]:
    """The votes on a candidate, in the order of the pattern's bits: strict form, gazetteer, marks, shape."""
    m, low = c["m"], c["low"]
    form = _by_kind(
        c,
        m.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|eyJ)[A-Za-z0-9]{16,})$") & m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
        m.rlike(f"^(?:{_FORMED})$"),
        m.rlike(rf"{_TITLE}{_CAP}[ ]{_CAP}$"),
        m.rlike(rf"(?:^|[ ]){_STREET}(?:[ ]|$)"),
        m.rlike(r"://[^:@]+:[^@]+@$"),
    )
    gazetteer = _by_kind(c, _any(low, SECRET_WORDS), _any(low, IDENTITY_WORDS), _any(F.lower(m), GIVEN_NAMES), _any(low, ADDRESS_WORDS), m.rlike(f"^(?:{'|'.join(SCHEMES)})://"))
    mark = low.rlike(r"[=:]\s*[\"']?$")
    marks = _by_kind(c, mark, mark | low.rlike(r"n[º°o]\.?\s*$"), c["after"].rlike(r"^[,;.:)\n]"), mark | c["after"].rlike(r"^[,;.\n]"), mark | low.rlike(r"[\s\"'(<]$"))
    turns = F.regexp_count(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"))
    shape = _by_kind(c, turns >= 3, m.rlike("[A-Z -]"), F.length(m) >= 12, F.regexp_count(m, F.lit(" ")) >= 2, m.rlike(":[^:@]{6,}@$"))
    return [form, gazetteer, marks, shape]


def features(c: Column) -> list[Column]:
    """Further bits that only the classifier sees."""
    m = c["m"]
    return [F.length(m) >= 20, m.rlike("^[0-9a-f]+$"), m.rlike("^[0-9A-Z]+$"), F.length(_digits(m)) * 4 >= F.length(m)]


LABELERS, BITS = 4, 8
#: Beta priors of the labelers' hits and false alarms and of the share of true candidates, in pseudo-counts (yes, no).
HIT, MISS, SHARE = (8.0, 2.0), (1.0, 9.0), (1.0, 19.0)


def pattern_of(c: Column) -> Column:
    out = c["kind"] * (1 << BITS)
    for i, bit in enumerate([*labelers(c), *features(c)]):
        out = out + F.when(F.coalesce(bit, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
    return out


@dataclass
class Model:
    """What EM learned of one kind's labelers, and its classifier: bias and a weight for each bit."""

    prior: float = SHARE[0] / sum(SHARE)
    hit: list[float] = field(default_factory=lambda: [HIT[0] / sum(HIT)] * LABELERS)
    miss: list[float] = field(default_factory=lambda: [MISS[0] / sum(MISS)] * LABELERS)
    weights: list[float] = field(default_factory=lambda: [0.0] * (BITS + 1))

    def accepts(self, bits: int) -> bool:
        return self.weights[0] + sum(w for j, w in enumerate(self.weights[1:]) if (bits >> j) & 1) > 0


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(counts: dict[int, int], rounds: int = 100) -> Model:
    """EM over the counts of one kind's bit patterns, then a logistic regression on its posteriors.

    counts has at most 2^BITS entries, whatever the corpus. The priors decide only where there is little to see: with no true
    candidate, hits stay at their prior and false alarms follow the data. A kind whose candidates amount to less than half a
    true one accepts nothing."""
    model = Model()
    vote = {p: [(p >> j) & 1 for j in range(LABELERS)] for p in counts}
    total, post = sum(counts.values()), {}
    for _ in range(rounds):
        for p, v in vote.items():
            z = math.log(model.prior / (1 - model.prior))
            z += sum(math.log(h / f) if x else math.log((1 - h) / (1 - f)) for x, h, f in zip(v, model.hit, model.miss))
            post[p] = _sigmoid(z)
        yes = sum(post[p] * n for p, n in counts.items())
        on = [sum(post[p] * n * v[j] for (p, n), v in zip(counts.items(), vote.values())) for j in range(LABELERS)]
        all_ = [sum(n * v[j] for n, v in zip(counts.values(), vote.values())) for j in range(LABELERS)]
        model.prior = (yes + SHARE[0]) / (total + sum(SHARE))
        model.hit = [(x + HIT[0]) / (yes + sum(HIT)) for x in on]
        model.miss = [(x - y + MISS[0]) / (total - yes + sum(MISS)) for x, y in zip(all_, on)]
    yes = sum(post[p] * n for p, n in counts.items())
    if yes < 0.5:
        model.weights[0] = -1.0
        return model
    # Both classes weigh the same, so that few true candidates among many still teach; no candidate at all stands
    # for an ordinary one.
    rows = [([1, *((p >> j) & 1 for j in range(BITS))], post[p], post[p] * n / yes, (1 - post[p]) * n / max(total - yes, 1e-9) if total - yes > 0.5 else 0.0) for p, n in counts.items()]
    rows.append(([1] + [0] * BITS, 0.0, 0.0, 0.5))
    w = model.weights
    for _ in range(3000):
        grad = [0.01 * x for x in w]
        for x, _, up, down in rows:
            s = _sigmoid(sum(a * b for a, b in zip(w, x)))
            err = down * s - up * (1 - s)
            grad = [g + err * b for g, b in zip(grad, x)]
        w = [a - 0.3 * g for a, g in zip(w, grad)]
    model.weights = w
    return model


def train(docs: DataFrame, text: str = "text") -> dict[str, Model]:
    """Models by kind, from the counts of bit patterns over all candidates of all texts (at most 5 * 2^BITS rows come back)."""
    seen = docs.select(F.explode(F.transform(candidates(F.col(text)), lambda c: c["p"])).alias("p")).groupBy("p").count()
    of: dict[int, dict[int, int]] = {k: {} for k in range(len(ADDED))}
    for r in seen.collect():
        of[r["p"] >> BITS][r["p"] & ((1 << BITS) - 1)] = r["count"]
    return {kind: fit(of[k]) for k, kind in enumerate(ADDED)}


def find(docs: DataFrame, models: dict[str, Model], text: str = "text") -> DataFrame:
    """docs plus `_pii`: a struct with the base spans of each kind and, under each kind of ADDED, the accepted candidates that no
    base span holds whole."""
    t = F.col(text)
    accepted = [(k << BITS) + bits for k, kind in enumerate(ADDED) for bits in range(1 << BITS) if models[kind].accepts(bits)]
    base = F.struct(*[base_spans(t, k).alias(k) for k in KINDS])

    def add(b: Column) -> Column:
        taken = F.concat(*[b[k] for k in KINDS])
        free = lambda c: let(taken, lambda x: ~F.exists(x, lambda s: (s["start"] <= c["start"]) & (c["end"] <= s["end"])))
        of = lambda new, k: F.transform(F.filter(new, lambda c: c["kind"] == k), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
        new = F.filter(F.filter(candidates(t), lambda c: c["p"].isin(accepted)), free)
        return let(new, lambda n: F.struct(*[b[k].alias(k) for k in KINDS], *[of(n, k).alias(kind) for k, kind in enumerate(ADDED)]))

    return docs.withColumn("_pii", let(base, add))


def listed(pii: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the given kinds, comma-joined."""
    def one(kind: str) -> Column:
        return F.transform(pii[kind], lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(one, kinds)), ",")


def redact(text: Column, pii: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans keep the first."""
    t = F.coalesce(text, F.lit(""))

    def one(kind: str) -> Column:
        return F.transform(pii[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind}]").alias("by")))

    def joined(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))

        def parts(end: Column) -> Column:
            at = lambda i: F.when(i == 0, 0).otherwise(F.get(end, i - 1))
            piece = F.transform(s, lambda x, i: F.when(x["start"] >= at(i), F.concat(F.substring(t, at(i) + 1, x["start"] - at(i)), x["by"])).otherwise(F.lit("")))
            return F.concat(F.array_join(piece, ""), F.substring(t, end[F.size(end) - 1] + 1, F.length(t)))

        return let(reach, parts)

    every = F.concat(*map(one, (*KINDS, *ADDED)))
    return let(every, lambda e: F.when(F.size(e) > 0, let(F.sort_array(e), joined)).otherwise(text))


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    pii = F.col("_pii")
    counts = [F.size(pii[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(pii, KINDS), 256).alias("base_sha256"), listed(pii, (*KINDS, *ADDED)).alias("spans"), *[F.size(pii[k]).cast("long").alias(f"n_{k}") for k in ADDED])
