"""Secret scan in DataFrame expressions alone.

Base rules find assignments, access keys and long hexadecimal runs.  Beyond them, candidate strings of a character
class are scanned by a sliding window whose Shannon entropy is kept up by incremental counts: one character enters,
one leaves, and only their two terms of the sum change.  Windows above the class's threshold make a span unless the
candidate is on the allow-list.  Base spans and placeholders part candidates: what is left on either side of one is a
candidate of its own.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_NAMES = "password|passwd|secret|token|api_?key"
#: Letters of the names in either case, ASCII only.
_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _NAMES)
ASSIGN = f"({_EITHER})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Folds over a text's matches append in blocks of this many.
BLOCK = 256
#: Texts are cut, and windows slid, in stretches of this many characters.
STRETCH = 1024
#: Entropy terms are multiples of one part in UNIT; a count of n is kept as the character ZERO + n.
UNIT, ZERO = 1 << 32, 48


@dataclass(frozen=True)
class CharClass:
    """Candidates of a class of ASCII characters, their window (of at most 64), and the entropy in bits from which it counts."""

    kind: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", "(?<![A-Za-z0-9+/_-])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![A-Za-z0-9+/_-])", 24, 3.0),
    CharClass("entropy_base64", "[A-Za-z0-9+/_-]{20,}", 20, 3.75),
)

_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: Candidates that match one of these whole are no secrets.
ALLOWED = (
    "[^0-9]+",  # words, identifiers and paths without a digit
    "[0-9_+/-]+",  # numbers, dates, telephone numbers
    _UUID,
)
#: What paths and names in lower case with short numbers at their parts' ends never have; a candidate without it is no
#: secret.  Patterns here repeat single characters only: Java's repeated groups recurse, and long texts overflow its stack.
ODD = "[^a-z0-9/_-]|[0-9][a-z]|[0-9]{5}"
#: Stretches of these are no part of a candidate: placeholders, alphabets, and whole UUIDs, which may have one inside.
PLACEHOLDERS = (f"(?<![A-Za-z0-9+/_-]){_UUID}(?![A-Za-z0-9+/_-])", "EXAMPLE", "example", "0123456789", "abcdefghij", "ABCDEFGHIJ")


@dataclass(frozen=True)
class Rules:
    classes: tuple[CharClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    order: tuple[str, ...] = field(default=KINDS)
    placeholders: tuple[str, ...] = PLACEHOLDERS
    odd: str = ODD


_SPAN = "struct<start:int,rank:int,stop:int,what:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"
_STRINGS = "cast(array() as array<string>)"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _blockwise(n: str, zero: str, kind: str, entry: str, end: str = "acc") -> str:
    """SQL: fold i = 0 .. n - 1 (at least one) into (pos, out); ``entry`` gives the next (pos, entry) from ``a.pos`` and i.

    Entries go in blocks of BLOCK, so that appending one costs no more however many there are.
    """
    inner = f"""aggregate(sequence(c * {BLOCK}, least((c + 1) * {BLOCK}, {n}) - 1), named_struct('pos', acc.pos, 'out', {kind}),
        (a, i) -> {_let("e", entry, "named_struct('pos', e.pos, 'out', concat(a.out, array(e.entry)))")})"""
    return f"""aggregate(sequence(0, ({n} - 1) div {BLOCK}), named_struct('pos', {zero}, 'out', {kind}),
        (acc, c) -> {_let("r", inner, "named_struct('pos', r.pos, 'out', concat(acc.out, r.out))")}, acc -> {end})"""


def _matches(text: str, pattern: str, rank: int, group: int = 0) -> Column:
    """Array of (start, rank, stop, group's text) of the leftmost non-overlapping matches.

    What lies between matches comes from ``split``, so the offsets are running sums of lengths.
    """
    p = _literal(pattern)
    entry = f"""named_struct('pos', a.pos + length(m.gap[i]) + length(m.hit[i]), 'entry', named_struct(
        'start', a.pos + length(m.gap[i]), 'rank', {rank}, 'stop', a.pos + length(m.gap[i]) + length(m.hit[i]), 'what', m.what[i]))"""
    found = f"named_struct('hit', regexp_extract_all({text}, {p}, 0), 'gap', split({text}, {p}, -1), 'what', regexp_extract_all({text}, {p}, {group}))"
    run = _let("m", found, _blockwise("size(m.hit)", "0", _NONE, entry, "acc.out"))
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN {run} ELSE {_NONE} END")


def _windows(c: CharClass, rank: int, spans: str) -> str:
    """SQL: the spans of high entropy within candidates ``spans`` of class ``c``.

    The window's counts are a byte string with a place per ASCII code, of which a step overwrites two.  Terms n log2 n are
    integers in units of 2^-32, so that sums are exact wherever a window stands.
    """
    terms = ", ".join(f"{round(x * math.log2(x) * UNIT) if x else 0}L" for x in range(c.window + 2))
    limit = math.floor(c.window * (math.log2(c.window) - c.bits) * UNIT) + (UNIT >> 20)
    code = lambda i: f"ascii(cast(substring(d.x, {i} + 1, 1) as string))"
    count = lambda n, k: f"ascii(cast(substring({n}, {k} + 1, 1) as string)) - {ZERO}"
    changed = lambda w, k, v, by: f"named_struct('n', overlay({w}.n, cast(char({ZERO} + {v} + {by}) as binary), {k} + 1, 1), 'sum', {w}.sum + d.f[{v} + {by}] - d.f[{v}])"
    left = f"if(e.out < 0, named_struct('n', w.n, 'sum', w.sum), {_let('v', count('w.n', 'e.out'), changed('w', 'e.out', 'v', -1))})"
    moved = f"if(e.out = e.in, named_struct('n', w.n, 'sum', w.sum), {_let('o', left, _let('u', count('o.n', 'e.in'), changed('o', 'e.in', 'u', 1)))})"
    high = f"i >= {c.window - 1} AND r.sum <= {limit}L"
    after = f"named_struct('n', r.n, 'sum', r.sum, 'first', if(w.first < 0 AND {high}, cast(i as int) - {c.window - 1}, w.first), 'last', if({high}, cast(i as int) + 1, w.last))"
    step = _let("e", f"named_struct('out', if(i >= {c.window}, {code(f'i - {c.window}')}, -1), 'in', {code('i')})", _let("r", moved, after))
    zero = f"named_struct('n', cast(repeat(char({ZERO}), 128) as binary), 'sum', 0L, 'first', -1, 'last', -1)"
    inner = f"aggregate(sequence(c * {STRETCH}, least((c + 1) * {STRETCH}, length(d.x)) - 1), acc, (w, i) -> {step})"
    scan = _let("d", f"named_struct('x', cast(s.what as binary), 'f', array({terms}))", f"aggregate(sequence(0, (length(d.x) - 1) div {STRETCH}), {zero}, (acc, c) -> {inner})")
    hits = f"transform({spans}, s -> named_struct('s', s, 'w', {scan}))"
    return f"transform(filter({hits}, h -> h.w.last >= 0), h -> named_struct('start', h.s.start + h.w.first, 'rank', {rank}, 'stop', h.s.start + h.w.last, 'what', h.s.what))"


def _cut(a: str, b: str) -> str:
    """SQL: characters a .. b - 1 of the text whose stretches are ``d.b``, without walking it from its start."""
    first, last = f"cast({a} div {STRETCH} as int)", f"cast(({b} - 1) div {STRETCH} as int)"
    return f"""CASE WHEN {b} <= {a} THEN '' WHEN {first} = {last} THEN substring(d.b[{first}], {a} % {STRETCH} + 1, {b} - {a}) ELSE concat(
        substring(d.b[{first}], {a} % {STRETCH} + 1), array_join(slice(d.b, {first} + 2, {last} - {first} - 1), ''), substring(d.b[{last}], 1, ({b} - 1) % {STRETCH} + 1)) END"""


def _rewritten(text: str, spans: str, piece: str) -> str:
    """SQL: ``text`` with ``piece`` for each of the sorted ``spans`` (d.s[i], a.pos where the ones before end) and the gap before it."""
    entry = f"named_struct('pos', greatest(a.pos, d.s[i].stop), 'entry', {piece})"
    end = f"array_join(concat(acc.out, array({_cut('acc.pos', 'd.n')})), '')"
    given = f"named_struct('s', {spans}, 'n', length({text}), 'b', regexp_extract_all({text}, '(?s).{{1,{STRETCH}}}', 0))"
    return f"CASE WHEN size({spans}) > 0 THEN {_let('d', given, _blockwise('size(d.s)', '0', _STRINGS, entry, end))} ELSE {text} END"


def _blanked(text: str, spans: str) -> Column:
    """``text`` with a blank for every character of the sorted ``spans``, so that offsets stay."""
    return F.expr(_rewritten(text, spans, f"concat({_cut('a.pos', 'd.s[i].start')}, repeat(' ', greatest(0, d.s[i].stop - greatest(a.pos, d.s[i].start))))"))


def scan(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), and ``base`` and ``added``: arrays of (start, rank, stop, what).

    They are sorted by start, then kind.  Null texts count as empty; a text without a match has empty arrays; every row
    stays, repeated ones too; an empty table gives none.  Columns of ``docs`` may have any name.
    """
    rank = {k: i for i, k in enumerate(rules.order)}
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    out = out.withColumn("_assign", _matches("_text", ASSIGN, rank["assign"], 2))
    out = out.withColumn("_access", _matches("_text", ACCESS, rank["access"])).withColumn("_hex", _matches("_text", HEX, rank["hex"]))
    long_enough = {"_assign": "length(s.what) >= 8", "_access": "s.stop - s.start >= 16", "_hex": "true"}
    base = ", ".join(f"filter({c}, s -> {cond})" for c, cond in long_enough.items())
    out = out.withColumn("base", F.expr(f"array_sort(concat({base}))"))
    suspect = [f"NOT s.what RLIKE {_literal(f'^(?:{a})$')}" for a in rules.allowed] + ([f"s.what RLIKE {_literal(rules.odd)}"] if rules.odd else [])
    held = _matches("_text", "|".join(rules.placeholders), 0) if rules.placeholders else F.expr(_NONE)
    out = out.withColumn("_held", held).withColumn("_taken", F.expr("array_sort(concat(base, _held))")).withColumn("_rest", _blanked("_text", "_taken"))
    names = []
    for c in rules.classes:
        name = f"_{c.kind}"
        if names:  # a stretch that an earlier class reports isn't reported again
            out = out.withColumn("_rest", _blanked("_rest", names[-1]))
        out = out.withColumn(name, _matches("_rest", c.pattern, rank[c.kind]))
        out = out.withColumn(name, F.expr(f"filter({name}, s -> {' AND '.join(suspect) or 'true'})"))
        out = out.withColumn(name, F.expr(f"CASE WHEN size({name}) > 0 THEN {_windows(c, rank[c.kind], name)} ELSE {_NONE} END"))
        names.append(name)
    return out.withColumn("added", F.expr(f"array_sort(concat({', '.join(names)}))")).select("row", "base", "added")


def _listed(spans: str, rules: Rules) -> str:
    kinds = ", ".join(f"'{k}'" for k in rules.order)
    return f"array_join(transform({spans}, s -> concat(array({kinds})[s.rank], ':', s.start, ':', s.stop)), ',')"


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base and added) and n_entropy, a row per document.

    Null texts count as empty and have no span; repeated rows and null doc_ids stay as they are; an empty table gives no
    rows; other columns aren't read.
    """
    found = scan(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", rules)
    count = lambda kind: F.expr(f"cast(size(filter(base, s -> s.rank = {rules.order.index(kind)})) as bigint)")
    return found.select(
        "row.doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.expr(f"sha2({_listed('base', rules)}, 256)").alias("base_sha256"),
        F.expr(_listed("array_sort(concat(base, added))", rules)).alias("spans"), F.size("added").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; spans that overlap or touch count as one.

    A text without a span stays as it is, a null text null.  Every row stays, repeated ones too, and so do all other
    columns, whatever their names.
    """
    found = scan(docs, text, rules).select("row", F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("_text"), F.expr("array_sort(concat(base, added))").alias("_spans"))
    piece = f"if(d.s[i].start > a.pos OR i = 0, concat({_cut('a.pos', 'd.s[i].start')}, {_literal(mark)}), '')"
    clean = F.expr(f"CASE WHEN size(_spans) > 0 THEN {_rewritten('_text', '_spans', piece)} ELSE row.`{text}` END")
    return found.select(*[(clean if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"))
