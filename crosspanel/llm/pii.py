r"""Personal data found by expressions, checksums and context words (operator 4).

Native columns only. An expression proposes spans, a validator confirms them
(octets of an ip, Luhn for a card, digit count for a phone, mod 97 for an iban)
and words close before a span move its score. The base kinds stay whatever
their score; the further ones (iban, ssn) stay from ``MIN_SCORE`` on.

Positions: ``split`` gives the gaps between matches, so a match starts at the
lengths of all gaps and matches before it (code points, end exclusive). The
expressions are the plain ones made linear: runs are possessive and may start
only at the border of a run or, with ``\G``, where the last match ended, which
finds the same leftmost matches without trying every position of a long run.

Null and empty texts have no spans. Overlapping spans of different kinds are
all reported. Masking replaces the confirmed spans of one kind after the other,
each searched in what the kinds before it left. Context counts as it stands in
the unmasked text: a value that has it there is masked wherever it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import free_name

_LOCAL = "A-Za-z0-9._%+-"
_EDGE = (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])")
_IBAN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"

#: kind: expression, a text that every match holds, score of a confirmed match, context words that raise it.
KINDS: dict[str, tuple[str, str, float, str]] = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|courriel|correo"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, "ip|address|host|server|adresse"),
    "card": ("[0-9](?:[ -]?[0-9])++", "", 0.8, "card|visa|credit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, "tel|phone|call|fax|telefon|llam"),
    "iban": (_IBAN.join(_EDGE), "", 0.9, "iban|bank|account|konto|compte|cuenta"),
    "ssn": ("[0-9]{3}-[0-9]{2}-[0-9]{4}".join(_EDGE), "-", 0.3, "ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")
MIN_SCORE, CONTEXT_CHARS, CONTEXT_GAIN = 0.6, 40, 0.4


def luhn(digits: Column) -> Column:
    """Every second digit from the right doubles; the digit sum must be a multiple of ten."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, k: acc + F.when(
        (n - k) % 2 == 0, F.substr(digits, k, F.lit(1)).cast("int")).otherwise(
        (F.substr(digits, k, F.lit(1)).cast("int") * 2) % 10
        + F.floor(F.substr(digits, k, F.lit(1)).cast("int") * 2 / 10).cast("int")))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """The first four characters go last, letters count from 10; the number is 1 modulo 97."""
    compact = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    left = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda acc, k: F.when(
            F.substr(turned, k, F.lit(1)).rlike("[0-9]"), (acc * 10 + F.substr(turned, k, F.lit(1)).cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(F.substr(turned, k, F.lit(1))) - 55) % 97))
    return F.length(compact).between(15, 34) & (left == 1)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (
            F.length(F.regexp_replace(p, "^0+", "")) <= 3)
            & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _confirmed(kind: str):
    return lambda m: _valid(kind, m.value)


def _chosen(kind: str, kept: dict[str, str]):
    """Matches to mask: the confirmed ones; of a kind that needs context, values that have it in the unmasked text."""
    if kind in kept:
        return lambda m: F.array_contains(kept[kind], m.value)
    return _confirmed(kind)


def _masked(kind: str, kept: dict[str, str]):
    return lambda gap, m: F.concat(gap, F.when(_chosen(kind, kept)(m), f"[{kind.upper()}]").otherwise(m.value))


def _numbered(text: Column, kind: str) -> Column:
    """The expression's matches as (value, i); none where the text lacks what each match holds."""
    expression, holds, *_ = KINDS[kind]
    values = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    values = F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("i")))
    none = F.array().cast("array<struct<value: string, i: int>>")
    held = text.contains(holds) if holds else text.isNotNull()
    return F.when(held, values).otherwise(none)


def _score(m: Column, gaps: Column, kind: str) -> Column:
    """The kind's score, more with its context words near."""
    _, _, base, words = KINDS[kind]
    near = F.lower(F.concat(
        F.right(F.get(gaps, m.i), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(gaps, m.i + 1), F.lit(CONTEXT_CHARS))))
    return F.least(F.lit(1.0), F.lit(base) + F.when(near.rlike(words), CONTEXT_GAIN).otherwise(0.0))


_BLOCK = 256


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def _lengths(values: Column, gaps: Column) -> Column:
    """Lengths of each match with the gap before it."""
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.length(g) + F.length(v.value))


def _sums(lengths: Column) -> Column:
    """Sums by blocks, so that a start needs few additions however many matches a text has."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int")),
                       lambda b: _sum(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))


def _placed(good: Column, gaps: Column, lengths: Column, sums: Column, kind: str) -> Column:
    """Spans of the confirmed matches."""
    def span(m: Column) -> Column:
        whole = F.floor(m.i / _BLOCK).cast("int")
        before = _sum(F.slice(sums, F.lit(1), whole)) + _sum(
            F.slice(lengths, whole * _BLOCK + 1, m.i - whole * _BLOCK))
        start = before + F.length(F.get(gaps, m.i))
        return F.struct(
            start.alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"),
            (start + F.length(m.value)).alias("end"), F.lit(kind).alias("kind"), m.value.alias("value"),
            _score(m, gaps, kind).alias("score"))

    return F.transform(good, span)


_SPANS = "array<struct<start: int, rank: int, end: int, kind: string, value: string, score: double>>"


def find_personal_data(docs: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(doc_id, spans) of each row of ``docs(doc_id, text)``; spans ordered by start, then kind as listed."""
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumns({f"all_{k}": _numbered(F.col("text"), k) for k in kinds})
    out = out.withColumns({f"good_{k}": F.filter(f"all_{k}", _confirmed(k)) for k in kinds})
    out = out.withColumns({f"gaps_{k}": F.when(
        F.size(f"good_{k}") > 0, F.split("text", KINDS[k][0], -1)) for k in kinds})
    out = out.withColumns({f"lengths_{k}": _lengths(F.col(f"all_{k}"), F.col(f"gaps_{k}")) for k in kinds})
    out = out.withColumns({f"sums_{k}": _sums(F.col(f"lengths_{k}")) for k in kinds})
    none = F.array().cast(_SPANS)
    placed = [F.when(F.size(f"good_{k}") > 0, _placed(
        *(F.col(f"{c}_{k}") for c in ("good", "gaps", "lengths", "sums")), k)).otherwise(none) for k in kinds]
    sure = F.filter(F.concat(*placed), lambda s: s.kind.isin(*BASE) | (s.score >= MIN_SCORE))
    return out.select("doc_id", F.array_sort(sure).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(kind: str, kept: dict[str, str]):
    """A text with the kind's confirmed matches replaced; ``kept`` names the columns of values with context."""
    def rebuilt(gaps: Column, matches: Column) -> Column:
        put = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, _masked(kind, kept))
        return F.concat(F.array_join(put, ""), F.element_at(gaps, -1))

    def body(text: Column) -> Column:
        return _let(_numbered(text, kind), lambda matches: F.when(
            F.exists(matches, _chosen(kind, kept)),
            _let(F.split(text, KINDS[kind][0], -1), lambda gaps: rebuilt(gaps, matches))).otherwise(text))
    return body


def _kept(text: Column, kind: str) -> Column:
    """Values of the kind's confirmed matches with enough of a score."""
    sure = lambda gaps: lambda m: _valid(kind, m.value) & (_score(m, gaps, kind) >= MIN_SCORE)
    return _let(_numbered(text, kind), lambda matches: F.when(
        F.exists(matches, _confirmed(kind)),
        _let(F.split(text, KINDS[kind][0], -1), lambda gaps: F.transform(F.filter(matches, sure(gaps)), lambda m: m.value)))
        .otherwise(F.array().cast("array<string>")))


#: What may hold a whole ssn goes before it, an ip, which may end within one, after it; an ip gone may show cards and phones.
MASKED = ("iban", "email", "card", "phone", "ssn", "ip", "card", "phone")


def mask(docs: DataFrame, kinds: tuple[str, ...] = MASKED) -> DataFrame:
    """``docs`` with confirmed personal data in ``text`` replaced by [KIND]; n_chars, where there is one, follows; other columns stay, whatever their names."""
    text = F.col("text").cast("string")
    names = {k: free_name(docs, f"kept_{k}") for k in kinds if KINDS[k][2] < MIN_SCORE}
    out = docs.withColumns({name: _kept(text, k) for k, name in names.items()})
    for k in kinds:
        text = _let(text, _without(k, names))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))
