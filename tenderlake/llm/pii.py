"""Personal data: base patterns, high-recall candidates, and boosted trees that choose among them.

All work on texts is column expressions. Three steps:

1. *Base spans*: four patterns, leftmost and non-overlapping per kind, with a check of each match. They
   always stay. Where a pattern could start inside a run of its own characters, a look-behind (or the end
   of the match before) pins it to the run's start: the matches are the same and scanning stays linear.
2. *Candidates*: looser patterns that also take written-out signs and missing prefixes, and overlap freely.
   Each is described by a few small numbers of its format and of the text around it.
3. *Boosted trees*: candidates over valid base spans are examples, candidates over failed base matches or
   over base spans of another kind are counterexamples; both are counted per combination of features over
   all texts. The combinations are a fixed grid, so the counts stay small however large the table is, and
   trees fitted on them weigh every candidate of the corpus. A threshold per kind, the lowest with
   ``precision`` on these counts, selects further spans among candidates that meet no base span.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import free_name

KINDS = ("email", "ip", "card", "phone")

# Fixed: the four base patterns, in the form that scans linearly.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A text without these has no match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{1,2}", "phone": r"\+[0-9]"}

LOOSE = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?"
        r"[A-Za-z0-9-]{1,64}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,64}+)+"
    ),
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:[.,] ?[0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ .-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|00)?[0-9(][0-9() ./-]{6,20}[0-9](?![0-9A-Za-z])",
}
# A text without any of these has neither base matches nor candidates, so it is not looked through again.
ANY = r"[0-9@]|[(\[]at[)\]]"
CONTEXT = 24
CUES = r"(?i)(?:mail|tel|phone|fon|call|mobil|fax|card|carte|karte|tarjeta|visa|ip|host|server|contact)[^A-Za-z]*$"
FEATURES = {
    "kind": 4, "digits": 6, "seps": 4, "groups": 5, "lead": 2, "parens": 2,
    "sum_ok": 2, "octets": 2, "before": 3, "after": 3, "cue": 2,
}


def _quote(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def matches(text: str, pattern: str, needs: str) -> str:
    """SQL: the pattern's matches in column ``text`` as structs (start, end, value), in order.

    Starts are code points; they add up from the lengths of the pieces between matches.
    """
    q = _quote(pattern)
    empty = "cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"
    found = f"""aggregate(
        zip_with(split({text}, {q}, -1), regexp_extract_all({text}, {q}, 0),
                 (gap, hit) -> named_struct('gap', length(gap), 'hit', hit)),
        named_struct('at', 0L, 'found', {empty}),
        (s, x) -> if(x.hit is null, s, named_struct(
            'at', s.at + x.gap + length(x.hit),
            'found', concat(s.found, array(named_struct(
                'start', s.at + x.gap, 'end', s.at + x.gap + length(x.hit), 'value', x.hit))))),
        s -> s.found)"""
    return f"case when {text} rlike {_quote(needs)} then {found} else {empty} end"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(number: str) -> str:
    """SQL: whether a text of digits passes the Luhn check."""
    digit = f"cast(substr(reverse({number}), i, 1) as int)"
    twice = f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit})"
    return (
        f"aggregate(sequence(1, length({number})), 0, (s, i) -> s + if(i % 2 = 1, {digit}, {twice})) % 10 = 0"
    )


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CHECKS = {
    "email": "true",
    "ip": f"x.value rlike r'^{OCTET}(?:\\.{OCTET}){{3}}$'",
    "card": f"{luhn(digits('x.value'))}",
    "phone": f"length({digits('x.value')}) between 9 and 15",
}


def base_spans(text: str) -> Column:
    """Struct of one array per kind: base matches with a flag whether they pass their check."""
    fields = [
        f"transform({matches(text, BASE[kind], NEEDS[kind])}, x -> named_struct("
        f"'start', x.start, 'end', x.end, 'ok', {CHECKS[kind]})) as {kind}"
        for kind in KINDS
    ]
    return F.struct(*(F.expr(field) for field in fields))


def _features(kind: str, text: str) -> dict[str, str]:
    number = digits("x.value")
    count = f"length({number})"
    edge = lambda c: f"case when {c} = '' or {c} rlike r'^\\s$' then 0 when {c} rlike '^[A-Za-z0-9]$' then 2 else 1 end"  # noqa: E731, E501
    return {
        "kind": str(KINDS.index(kind)),
        "digits": f"case when {count} < 7 then 0 when {count} < 9 then 1 when {count} < 12 then 2"
        f" when {count} < 13 then 3 when {count} < 16 then 4 else 5 end",
        "seps": f"least(length(x.value) - {count}, 9) div 3",
        "groups": "least(size(regexp_extract_all(x.value, '[0-9]+', 0)), 4)",
        "lead": r"cast(x.value rlike r'^(?:\+|00)' as int)",
        "parens": r"cast(x.value rlike r'[(\[]' as int)",
        "sum_ok": f"cast({count} between 13 and 19 and {luhn(number)} as int)",
        "octets": f"cast(x.value rlike r'^{OCTET}(?:[.,] ?{OCTET}){{3}}$' as int)",
        "before": edge(f"if(x.start = 0, '', substr({text}, cast(x.start as int), 1))"),
        "after": edge(f"substr({text}, cast(x.end as int) + 1, 1)"),
        "cue": f"cast(substr({text}, greatest(cast(x.start as int) - {CONTEXT - 1}, 1),"
        f" least(cast(x.start as int), {CONTEXT})) rlike {_quote(CUES)} as int)",
    }


def candidates(text: str, base: str) -> Column:
    """Array of candidates of all kinds: span, features, and label.

    The label is 1 over a valid base span of the kind, 0 over a failed one or over a valid one of another
    kind, and NULL where no base pattern matches.
    """
    parts = []
    for kind in KINDS:
        meets = "y.start < x.end and x.start < y.end"
        own = f"exists({base}.{kind}, y -> y.ok and {meets})"
        failed = f"exists({base}.{kind}, y -> not y.ok and {meets})"
        other = " or ".join(f"exists({base}.{k}, y -> y.ok and {meets})" for k in KINDS if k != kind)
        features = ", ".join(f"'{n}', cast({e} as int)" for n, e in _features(kind, text).items())
        parts.append(
            f"transform({matches(text, LOOSE[kind], LOOSE_NEEDS[kind])}, x -> named_struct("
            f"'start', x.start, 'end', x.end,"
            f" 'label', case when {own} then 1 when {failed} or {other} then 0 end, {features}))"
        )
    return F.expr("concat(" + ", ".join(parts) + ")")


LOOSE_NEEDS = {
    "email": r"@|[(\[]at[)\]]",
    "ip": r"[0-9][.,] ?[0-9]",
    "card": r"[0-9][ .-]{0,2}[0-9]",
    "phone": "[0-9]",
}


# --- boosted trees on counts -------------------------------------------------------------------------


class Boosted:
    """Trees of two levels on weighted cells; ``sql`` is their sum as an expression."""

    def __init__(self, trees: list, bias: float, thresholds: dict[int, float]):
        self.trees, self.bias, self.thresholds = trees, bias, thresholds

    def sql(self, x: str) -> str:
        def node(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            name, cut, low, high = tree
            return f"if({x}.{name} <= {cut}, {node(low)}, {node(high)})"

        terms = [f"{self.bias!r}D", *map(node, self.trees)]
        return f"1D / (1D + exp(-({' + '.join(terms)})))"

    def threshold(self, x: str) -> str:
        cases = " ".join(f"when {k} then {t!r}D" for k, t in sorted(self.thresholds.items()))
        return f"case {x}.kind {cases} else 2D end" if cases else "2D"


def fit(cells: list[dict], rounds: int = 40, rate: float = 0.3, precision: float = 0.99) -> Boosted:
    """Boost logistic trees on cells of ``FEATURES`` values with counts ``ones`` and ``zeros``."""
    ones, zeros = (sum(c[n] for c in cells) for n in ("ones", "zeros"))
    if not ones:
        return Boosted([], -20.0, {})
    bias = math.log((ones + 1) / (zeros + 1))
    raw = [bias] * len(cells)
    splits = {name: range(size - 1) for name, size in FEATURES.items()}
    trees = []
    for _ in range(rounds):
        slope, bend = [], []
        for cell, value in zip(cells, raw, strict=True):
            p = 1 / (1 + math.exp(-value))
            n = cell["ones"] + cell["zeros"]
            slope.append(cell["ones"] - n * p)
            bend.append(n * p * (1 - p))
        tree = _grow(cells, range(len(cells)), slope, bend, splits, 2, rate)
        trees.append(tree)
        for i, cell in enumerate(cells):
            node = tree
            while not isinstance(node, float):
                node = node[2] if cell[node[0]] <= node[1] else node[3]
            raw[i] += node
    scores: dict[int, list] = defaultdict(list)
    for cell, value in zip(cells, raw, strict=True):
        scores[cell["kind"]].append((1 / (1 + math.exp(-value)), cell["ones"], cell["zeros"]))
    thresholds = {}
    for kind, rows in scores.items():
        hit = miss = 0
        for score, one, zero in sorted(rows, reverse=True):
            hit, miss = hit + one, miss + zero
            if hit and hit >= precision * (hit + miss):
                thresholds[kind] = max(0.5, math.floor(score * 1e9) / 1e9)
    return Boosted(trees, bias, thresholds)


def _grow(cells, rows, slope, bend, splits, depth: int, rate: float):
    total, curve = sum(slope[i] for i in rows), sum(bend[i] for i in rows)
    gain_of = lambda g, h: g * g / (h + 1.0)
    best = None
    if depth:
        for name, cuts in splits.items():
            sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
            for i in rows:
                s = sums[cells[i][name]]
                s[0] += slope[i]
                s[1] += bend[i]
            g = h = 0.0
            for cut in cuts:
                if cut in sums:
                    g, h = g + sums[cut][0], h + sums[cut][1]
                gain = gain_of(g, h) + gain_of(total - g, curve - h) - gain_of(total, curve)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, name, cut)
    if best is None:
        return float(rate * total / (curve + 1.0))
    _, name, cut = best
    sides = [i for i in rows if cells[i][name] <= cut], [i for i in rows if cells[i][name] > cut]
    low, high = (_grow(cells, side, slope, bend, splits, depth - 1, rate) for side in sides)
    return name, cut, low, high


def _searched(text: str) -> Column:
    return F.expr(f"if({text} rlike {_quote(ANY)}, {text}, '')")


def learn(df: DataFrame, text: str = "text", precision: float = 0.99) -> Boosted:
    """Fit the trees on the candidates of every text of ``df``, counted per combination of features."""
    plain = df.select(_searched(text).alias("t"))
    rows = plain.select("t", base_spans("t").alias("b")).select(F.explode(candidates("t", "b")).alias("c"))
    cells = (
        rows.where("c.label is not null")
        .groupBy(*(F.col(f"c.{name}").alias(name) for name in FEATURES))
        .agg(
            F.sum(F.col("c.label").cast("long")).alias("ones"),
            F.sum((1 - F.col("c.label")).cast("long")).alias("zeros"),
        )
    )
    # One row per combination of features at most: a fixed grid.
    order = [*FEATURES]
    found = sorted((r.asDict() for r in cells.collect()), key=lambda r: [r[n] for n in order])
    return fit(found, precision=precision)


def find_personal_data(
    df: DataFrame, text: str = "text", out: str = "spans", model: Boosted | None = None
) -> DataFrame:
    """Add ``out``: an array of structs (kind, start, end, base), by kind as in ``KINDS``, then start.

    ``start`` and ``end`` are code points, end exclusive; ``base`` tells whether a base pattern found the
    span. NULL and empty texts have no spans. Rows are judged one by one, so repeated rows get equal spans,
    and an empty table stays empty (its model selects nothing). An existing column ``out`` is replaced.
    """
    model = model or learn(df, text)
    t, b, c = free_name(df, "pii_text", "pii_base", "pii_candidates")
    base = ", ".join(
        f"transform(filter({b}.{kind}, x -> x.ok), x -> named_struct("
        f"'kind', '{kind}', 'start', x.start, 'end', x.end, 'base', true))"
        for kind in KINDS
    )
    names = ", ".join(f"'{kind}'" for kind in KINDS)
    clear = " and ".join(
        f"not exists({b}.{kind}, y -> y.ok and y.start < x.end and x.start < y.end)" for kind in KINDS
    )
    chosen = f"""transform(filter({c}, x -> x.label is null and {clear} and {model.sql("x")} >= {model.threshold("x")}),
        x -> named_struct('score', -({model.sql("x")}), 'start', x.start, 'end', x.end, 'kind', x.kind))"""
    blank = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,base:boolean>>)"
    added = f"""aggregate(array_sort({chosen}), {blank},
        (s, x) -> if(exists(s, y -> y.start < x.end and x.start < y.end), s, concat(s, array(named_struct(
            'kind', element_at(array({names}), x.kind + 1), 'start', x.start, 'end', x.end, 'base', false)))))"""
    ordered = f"""array_sort(concat({base}, {added}), (l, r) -> case
        when l.kind = r.kind then cast(sign(l.start - r.start) as int)
        else cast(array_position(array({names}), l.kind) - array_position(array({names}), r.kind) as int) end)"""
    kept = [F.col(name) for name in df.columns if name != out]
    return (
        df.withColumn(t, _searched(text))
        .withColumn(b, base_spans(t))
        .withColumn(c, candidates(t, b))
        .select(*kept, F.expr(ordered).alias(out))
    )


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace each span of ``text`` by its kind in brackets; overlapping spans become one replacement.

    NULL texts stay NULL. Other columns are unchanged.
    """
    pieces = f"""aggregate(array_sort(transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))),
        named_struct('at', 0L, 'out', cast(array() as array<string>)),
        (s, x) -> named_struct(
            'at', greatest(s.at, x.end),
            'out', if(x.start < s.at, s.out, concat(s.out, array(
                substr({text}, cast(s.at as int) + 1, cast(x.start - s.at as int)), '[' || upper(x.kind) || ']')))),
        s -> array_join(concat(s.out, array(substr({text}, cast(s.at as int) + 1))), ''))"""
    return df.withColumn(text, F.expr(f"if({text} is null or size({spans}) = 0, {text}, {pieces})"))
